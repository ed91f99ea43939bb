"""Movies, footprints and traces derived from generic tables: a vector of 64 numbers is an 8 x 8 frame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _session(c):
    return F.when(F.col(c) % 2 == 0, "a").otherwise("b").alias("session")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frame rows (session, frame, h, w, px)."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(_session("vec_id"), F.expr("vec_id div 2").alias("frame"), F.lit(8).alias("h"), F.lit(8).alias("w"), F.col("embedding").alias("px"))


def pixels(frame_rows: DataFrame) -> DataFrame:
    """Pixel rows of frame rows."""
    each = frame_rows.select("session", "frame", "w", F.posexplode("px").alias("p", "v"))
    return each.select("session", "frame", F.expr("cast(p div w as int)").alias("y"), (F.col("p") % F.col("w")).alias("x"), F.col("v").cast("double").alias("v"))


def movie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels(frames(spark, sf_dir))


def footprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select(_session("vec_id"), F.col("label").cast("long").alias("unit_id"), F.posexplode("embedding").alias("p", "v"))
    mean = e.groupBy("session", "unit_id", F.expr("cast(p div 8 as int)").alias("y"), F.expr("p % 8").alias("x")).agg(F.avg(F.col("v").cast("double")).alias("a"))
    return mean.where("a > 0")


def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = footprints(spark, sf_dir).join(movie(spark, sf_dir), ["session", "y", "x"])
    return both.groupBy("session", "unit_id", "frame").agg(F.sum(F.col("a") * F.col("v")).alias("v"))


def motion(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(_session("vec_id"), F.expr("vec_id div 2").alias("frame"), (10 * F.col("embedding")[0].cast("double")).alias("dy"), (10 * F.col("embedding")[1].cast("double")).alias("dx"))


def days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A trace of 30 days per user: the sum of values, zero where there is none."""
    e = table(spark, sf_dir, "events")
    made = e.groupBy("user_id", F.datediff("ts", F.lit("2024-01-01").cast("date")).alias("frame")).agg(F.sum("value").alias("v"))
    grid = e.select("user_id").distinct().select("user_id", F.explode(F.sequence(F.lit(0), F.lit(29))).alias("frame"))
    joined = grid.join(made, ["user_id", "frame"], "left")
    return joined.select(F.concat(F.lit("s"), (F.col("user_id") % 2).cast("string")).alias("session"), F.col("user_id").alias("unit_id"), F.col("frame").cast("long").alias("frame"), F.coalesce("v", F.lit(0.0)).alias("v"))


def background(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    m = movie(spark, sf_dir)
    low = m.join(m.groupBy("session").agg(F.min("v").alias("lo")), "session").withColumn("d", F.col("v") - F.col("lo"))
    return low.groupBy("session", "y", "x").agg(F.avg("d").alias("b")), low.groupBy("session", "frame").agg(F.avg("d").alias("f"))
