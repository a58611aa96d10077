"""A corpus pipeline: filter, deduplicate, decontaminate and pack ``documents``.

Each stage takes ``(spark, docs, sf_dir)``.  All but the last return the
columns of ``documents``; every stage's result is written as Parquet in the
shared folder and read again as the next one's documents.

Every stage takes rows with null ids, null, empty and very long texts, equal
rows, no rows, and further columns of any name, which it passes on unchanged
(the last returns pieces and ignores them).  What becomes of a row without
text is said at each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomquery.llm import decontaminate, jaccard_join, packing, quality, toxicity
from loomquery.llm.common import durable
from loomquery.llm.queries import tokenizer_path


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def _verdict(docs: DataFrame) -> str:
    """A column name that ``docs`` doesn't have."""
    name, taken = "verdict", {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def _only(docs: DataFrame, scored: DataFrame, keep) -> DataFrame:
    """The rows of ``scored`` that are kept, with the columns of ``docs``."""
    return scored.where(keep).select(*["`" + c.replace("`", "``") + "`" for c in docs.columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score of 0.5 or more go.

    A row without text scores as any text without a word of the lexicon, and
    so stays with them; equal texts fare alike.
    """
    model, out = toxicity.train(docs, _labels(spark, sf_dir)), _verdict(docs)
    return _only(docs, toxicity.score(docs, model, out_col=out), F.col(f"{out}.predicted") == 0)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a quality score below 0.3 go.

    A row without text has the score of margin 0, so the fitted intercept
    decides for all such rows alike; equal texts fare alike.
    """
    model, out = quality.train(docs, _labels(spark, sf_dir)), _verdict(docs)
    return _only(docs, quality.score(docs, model, out_col=out), F.col(f"{out}.predicted") == 1)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of linked documents (five words, 0.8) stays: the one with the smallest id.

    Rows without words are linked with nothing and all stay; of equal rows one
    stays.  Rows of null or equal ids fall together only if their texts do.
    """
    return jaccard_join.deduplicate(docs, rule=jaccard_join.Rule(5, 4, 5))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth or more are benchmark passages go; rows without words stay."""
    benchmark, out = spark.read.parquet(f"{sf_dir}/benchmark.parquet"), _verdict(docs)
    return _only(docs, decontaminate.scan(docs, benchmark, out_col=out), ~F.col(f"{out}.contaminated"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All remaining documents as token pieces in sequences of at most 2048 tokens; one without text is its end id alone."""
    return packing.pack(packing.pieces(docs, tokenizer_path()))


STAGES = [
    ("toxicity", drop_toxic),
    ("quality_classifier", keep_quality),
    ("ngram_jaccard_join", deduplicate),
    ("benchmark_decontamination", drop_contaminated),
    ("best_fit_packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: Trained models and a tokenizer decide, which SQL cannot express; tests hold the stages against brute force.
ORACLE_SQL = None
