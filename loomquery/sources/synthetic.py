"""A small labelled corpus made by rule, for benchmarks and tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Topic, its words, and three queries for it.
TOPICS = (
    ("harbour", ("harbour", "vessel", "anchor", "cargo", "pilot", "quay"), ("cargo vessel in the harbour", "pilot at the quay", "anchor of a vessel")),
    ("orchard", ("orchard", "apple", "blossom", "cider", "graft", "harvest"), ("apple harvest in the orchard", "cider from apple blossom", "graft in an orchard")),
    ("railway", ("railway", "signal", "platform", "carriage", "timetable", "junction"), ("railway signal at the junction", "carriage at the platform", "timetable of the railway")),
    ("pottery", ("pottery", "kiln", "glaze", "clay", "wheel", "firing"), ("glaze and firing of clay", "kiln of the pottery", "clay on the wheel")),
    ("beekeeping", ("beekeeping", "hive", "swarm", "honey", "queen", "smoker"), ("honey from the hive", "swarm and its queen", "smoker for beekeeping")),
    ("glacier", ("glacier", "moraine", "crevasse", "meltwater", "icefall", "snowline"), ("meltwater under the glacier", "crevasse at the icefall", "moraine near the snowline")),
    ("weaving", ("weaving", "loom", "warp", "shuttle", "heddle", "selvedge"), ("shuttle through the warp", "heddle of the loom", "selvedge in weaving")),
    ("astronomy", ("astronomy", "telescope", "nebula", "eclipse", "parallax", "comet"), ("nebula in the telescope", "eclipse and comet", "parallax in astronomy")),
)


def dataset(spark: SparkSession, docs_per_topic: int = 50) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``documents`` (index, document, label, doc_key), ``queries`` (query_id, query) and ``qrels`` (query_id, index).

    Every document of a topic is relevant to each of its queries.
    """
    topics = spark.createDataFrame([(i, n, list(w), list(q)) for i, (n, w, q) in enumerate(TOPICS)], "topic long, label string, words array<string>, asked array<string>")
    queries = topics.select("topic", F.posexplode("asked").alias("k", "query")).select((F.col("topic") * 3 + F.col("k")).alias("query_id"), "query", "topic")
    n = F.lit(docs_per_topic)
    rows = topics.select("topic", "label", "words", F.explode(F.sequence(F.lit(0), n - 1)).alias("i"))

    def word(k: int):
        return F.element_at("words", (F.pmod(F.xxhash64("label", "i", F.lit(k)), F.lit(6)) + 1).cast("int"))

    docs = rows.select(
        (F.col("topic") * n + F.col("i")).alias("index"),
        F.format_string("Report %d on the %s: %s and %s near the %s.", "i", "label", word(0), word(1), word(2)).alias("document"),
        "label",
        F.substring(F.md5(F.concat_ws("-", "label", "i")), 1, 12).alias("doc_key"),
        "topic",
    )
    return docs.drop("topic"), queries.select("query_id", "query"), queries.join(docs, "topic").select("query_id", "index")
