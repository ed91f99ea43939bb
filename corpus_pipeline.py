"""The corpus pipeline: quality rules, near-duplicates, benchmark decontamination, secrets, BPE."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from brightfield.llm import bpe, decontaminate, nearcopies, quality, queries, secrets
from brightfield.llm.common import arrow_rows, condensed, discard, quoted


#: Rows in the batches that the pipeline's jobs hand to Python: whole texts are long, and a batch is held on both sides.
ARROW_ROWS = 500


def short_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects; null and empty texts are rejected, repeated rows share their verdict."""
    return quality.keep_good(docs)


def near_copies_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class, that with the smallest doc_id; of rows that share it, the least hash of text and row decides. Null texts count as empty."""
    short_batches(spark)
    return nearcopies.keep_one(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark table; null and empty texts and columns of any name pass."""
    short_batches(spark)
    return decontaminate.drop_contaminated(docs, queries.table(spark, sf_dir, "benchmark"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; the text of every span found is replaced by [SECRET]. Null and empty texts stay as they are."""
    short_batches(spark)
    return secrets.redact(docs)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its ids and the text they decode to; null texts count as empty, repeated rows give equal results."""
    short_batches(spark)
    made = bpe.bpe_encode(docs, queries.vocabulary(), keep=[c for c in docs.columns if c != "text"])
    return made.select(*(quoted(c) for c in made.columns))


STAGES = [
    ("quality rules", quality_stage),
    ("MinHash near-dedup", near_copies_stage),
    ("benchmark decontamination", benchmark_stage),
    ("secret scans", secrets_stage),
    ("BPE encoding and decoding", bpe_stage),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over documents; each result is written as Parquet and read again, and the one before it removed. The session's batch size is left as it was."""
    docs = queries.table(spark, sf_dir, "documents")
    with arrow_rows(spark, ARROW_ROWS):
        for name, stage in STAGES:
            before, docs = docs, condensed(lambda: stage(spark, docs, sf_dir), name.replace(" ", "-"), ARROW_ROWS)  # noqa: B023
            discard(before)
    return docs
