"""Contract queries of the training-data operators, one for each operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, jaccard_join, language_id, license_scan, mpeg_audio, oracles, packing, quality, sharding, toxicity, warc
from .common import durable, id_remainder


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License evidence of every document."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = license_scan.scan(docs).select("doc_id", "license.*")
    return found.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join("labels", ",").alias("labels"),
        "score",
        F.size("detections").alias("n_detections"),
    )


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 4-word shingle sets have a Jaccard similarity of at least 0.85."""
    return jaccard_join.join(_table(spark, sf_dir, "documents"), rule=jaccard_join.Rule(4, 17, 20))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages in every document."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.scan(docs, _table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "leak.n_words", "leak.n_hit",
        F.size("leak.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("leak.items", ",").cast("binary"), 256).alias("items_sha256"),
        "leak.contaminated",
    )


def tokenizer_path() -> str:
    """Place of the public tokenizer that the packing query uses."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as token pieces packed in sequences of at most 2048."""
    parts = packing.pieces(_table(spark, sf_dir, "documents"), tokenizer_path(), capacity=2048, end_id=0)
    return packing.pack(parts, capacity=2048)


def op7_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text stored as an MPEG audio stream, then parsed from the stored bytes."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    n_bytes = F.octet_length(F.coalesce("text", F.lit(""))).cast("long")
    stored = durable(mpeg_audio.encode(docs).select("doc_id", n_bytes.alias("n_bytes"), "media"), "media")
    read = mpeg_audio.decode(stored, offsets=True).select("doc_id", "n_bytes", "audio.*")
    feature = F.concat_ws(
        ";",
        *(F.concat(F.lit(f"{name}="), F.col(name).cast("string")) for name in ("frames", "samples", "duration_us", "crc_ok", "crc_bad", "skipped", "vbr", "table", "table_frames", "table_bytes", "id3v1")),
        F.concat(F.lit("tlen="), F.col("tags")["TLEN"]),
        F.concat(F.lit("last_frame_at="), F.element_at("offsets", -1).cast("string")),
        F.concat(F.lit("seek_crc32="), F.crc32(F.array_join("offsets", ",").cast("binary")).cast("string")),
    )
    return read.select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature")
    )


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document."""
    docs = _table(spark, sf_dir, "documents")
    model = language_id.train(docs, hold_out=(4, 2))
    held_out = (id_remainder("doc_id", 4) == 2).alias("held_out")
    found = language_id.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out, F.col("language.lang").alias("lang_pred"), "language.score", "language.langs")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, _table(spark, sf_dir, "labels"), hold_out=(5, 0))
    found = toxicity.score(docs, model, threshold=0.5)
    return found.select("doc_id", (id_remainder("doc_id", 5) == 0).alias("held_out"), "toxicity.score", "toxicity.predicted")


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, _table(spark, sf_dir, "labels"), hold_out=(5, 0))
    found = quality.score(docs, model, threshold=0.3)
    return found.select("doc_id", (id_remainder("doc_id", 5) == 0).alias("held_out"), "quality_score.score", "quality_score.predicted")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written as a WARC record and read back."""
    read = warc.round_trip(spark, _table(spark, sf_dir, "pages"), min_revisit_bytes=0)
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 contiguous shards of near-equal bytes."""
    placed = sharding.shard_by_bytes(_table(spark, sf_dir, "documents"), shards=24)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scan": op1_license_scan,
    "op2_ngram_jaccard_join": op2_ngram_jaccard_join,
    "op3_decontamination": op3_decontamination,
    "op4_packing": op4_packing,
    "op5_language_id": op5_language_id,
    "op6_warc": op6_warc,
    "op7_media_columns": op7_media_columns,
    "op8_toxicity": op8_toxicity,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_sharding": op10_sharding,
}

ORACLE_SQL: dict[str, str] = {
    "op1_license_scan": oracles.OP1,
    "op2_ngram_jaccard_join": oracles.OP2,
    "op3_decontamination": oracles.OP3,
    "op6_warc": oracles.OP6,
    "op10_sharding": oracles.OP10,
}
