"""Final cleanup and export."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brightfield.operators.base import PIXEL, UNIT
from brightfield.operators.merge import merge_edges, merge_footprints, merge_groups, merge_traces
from brightfield.operators.reject import regions
from brightfield.operators.segment import basin_label
from brightfield.operators.tiles import _grow, peaks
from brightfield.sources.storage import materialize


def trim_halo(footprints: DataFrame, share: float = 0.25) -> DataFrame:
    """Pixels above share * the unit's peak."""
    return footprints.join(peaks(footprints), UNIT).where(F.col("a") > share * F.col("peak")).select(*UNIT, "y", "x", "a")


def split_fragments(footprints: DataFrame, h: int, w: int, drop: int = 25, ratio: float = 0.30, mode: str = "split") -> DataFrame:
    """(session, unit_id, fragment, y, x, a): connected blobs; those of max(2 * drop, 30) pixels or more are split at their peaks too.

    Fragments stay with `drop` pixels or more and at least ratio * the unit's largest, the largest always.
    Fragments are numbered by size within their unit; mode 'lump' puts those that stay together as one, number 1.
    """
    blobs = regions(footprints, 4).withColumn("blob", F.dense_rank().over(W.partitionBy(*UNIT).orderBy("region"))).drop("region")
    blobs = materialize(blobs, "blobs")
    # each large blob is a unit of its own while it is split
    size = blobs.groupBy(*UNIT, "blob").agg(F.count("*").alias("n"))
    large = blobs.join(size.where(F.col("n") >= max(2 * drop, 30)), [*UNIT, "blob"], "left_semi")
    basins = basin_label(large, 5, 0.0, 0.0, h, w, [*UNIT, "blob"]).drop("a")
    parts = blobs.join(basins, [*UNIT, "blob", "y", "x"], "left").withColumn("basin", F.coalesce("basin", F.lit(0)))
    n = parts.groupBy(*UNIT, "blob", "basin").agg(F.count("*").alias("n"), F.min(F.struct("y", "x")).alias("first"))
    top = W.partitionBy(*UNIT)
    ranked = n.withColumn("fragment", F.row_number().over(top.orderBy(F.desc("n"), "first"))).withColumn("most", F.max("n").over(top))
    keep = ranked.where(((F.col("n") >= drop) & (F.col("n") >= ratio * F.col("most"))) | (F.col("fragment") == 1))
    made = parts.join(keep.select(*UNIT, "blob", "basin", "fragment"), [*UNIT, "blob", "basin"])
    return made.select(*UNIT, F.lit(1).alias("fragment") if mode == "lump" else "fragment", "y", "x", "a")


def fragment_id() -> Column:
    return F.shiftleft(F.col("unit_id").cast("long"), 32) + F.col("fragment")


def fragment_ids(fragments: DataFrame) -> DataFrame:
    """Lineage (session, unit_id, parent_unit_id, fragment): stable ids, the parent's above the lower 32 bits and the fragment's number in them."""
    return fragments.select("session", fragment_id().alias("unit_id"), F.col("unit_id").alias("parent_unit_id"), "fragment").distinct()


def merge_guarded(footprints: DataFrame, traces: DataFrame, lineage: DataFrame, containment: float = 0.30, r: float = 0.70, most: int = 5000, guard: bool = True) -> DataFrame:
    """Groups of fragments as in merge_groups; with the guard, fragments of one parent are never linked directly."""
    edges = merge_edges(footprints, traces, containment, r)
    if guard:
        parent = lambda n, p: lineage.select("session", F.col("unit_id").alias(n), F.col("parent_unit_id").alias(p))
        edges = edges.join(parent("u1", "p1"), ["session", "u1"]).join(parent("u2", "p2"), ["session", "u2"]).where("p1 <> p2")
    return merge_groups(footprints, traces, containment, r, most, edges.select("session", "u1", "u2", "containment", "r"))


def cut_seams(footprints: DataFrame, h: int, w: int, distance: float = 2) -> DataFrame:
    """Each pixel goes to its strongest owner (the smallest id on ties); pixels whose 8-neighbourhood holds two owners are seams, and what lies within `distance` of a seam is dropped."""
    owner = footprints.groupBy(*PIXEL).agg(F.max_by(F.struct("unit_id", "a"), F.struct("a", (-F.col("unit_id")).alias("n"))).alias("o")).select(*PIXEL, "o.unit_id", "o.a")
    steps = F.explode(F.array(*(F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy in (-1, 0, 1) for dx in (-1, 0, 1))))
    near = owner.select("session", "unit_id", "y", "x", steps.alias("o")).select("session", "unit_id", (F.col("y") + F.col("o.dy")).alias("y"), (F.col("x") + F.col("o.dx")).alias("x"))
    seam = near.groupBy(*PIXEL).agg(F.min("unit_id").alias("lo"), F.max("unit_id").alias("hi")).where("lo <> hi").select(*PIXEL).join(owner.select(*PIXEL), PIXEL, "left_semi")
    return owner.join(_grow(seam, distance, h, w), PIXEL, "left_anti").select(*UNIT, "y", "x", "a")


def cleanup(footprints: DataFrame, traces: DataFrame, h: int, w: int, share: float = 0.25, drop: int = 25, ratio: float = 0.30, containment: float = 0.30, r: float = 0.70, most: int = 5000, seam: float = 2) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Halo trim, fragments, guarded merge, seam cut: (footprints, traces, lineage) with the ids of merged groups."""
    fragments = materialize(split_fragments(trim_halo(footprints, share), h, w, drop, ratio), "fragments")
    lineage = fragment_ids(fragments)
    a = fragments.select("session", fragment_id().alias("unit_id"), "y", "x", "a")
    c = traces.withColumnRenamed("unit_id", "parent_unit_id").join(lineage, ["session", "parent_unit_id"]).select(*UNIT, "frame", "v")
    groups = materialize(merge_guarded(a, c, lineage, containment, r, most), "cleanup-groups")
    made = cut_seams(merge_footprints(a, groups), h, w, seam)
    kept = made.select(*UNIT).distinct()
    ancestry = groups.join(lineage, UNIT).select("session", F.col("group_id").alias("unit_id"), "parent_unit_id").distinct()
    return made, merge_traces(c, groups, "mean").join(kept, UNIT, "left_semi"), ancestry.join(kept, UNIT, "left_semi")


def export(tables: dict[str, DataFrame], path: str) -> None:
    """One Parquet table by name, partitioned by session, and its schema, which a table without rows needs; statistics and metadata go the same way as tables of their own."""
    for name, df in tables.items():
        df.write.mode("overwrite").partitionBy("session").parquet(f"{path}/{name}")
        df.sparkSession.createDataFrame([(df.schema.json(),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/schemas/{name}")


def read_export(spark, path: str, name: str) -> DataFrame:
    schema = T.StructType.fromJson(json.loads(spark.read.text(f"{path}/schemas/{name}").first()[0]))
    return spark.read.schema(schema).parquet(f"{path}/{name}").select(*schema.names)


def export_summary(footprints: DataFrame, traces: DataFrame, n_before: DataFrame) -> DataFrame:
    """Per session: units, retained percentage, mean size, mean and deviation of peak amplitudes, greatest value of the maximum projection and mean of the mean trace."""
    unit = footprints.groupBy(*UNIT).agg(F.count("*").alias("size"))
    amp = traces.groupBy(*UNIT).agg(F.max("v").alias("peak"))
    a = unit.join(amp, UNIT).groupBy("session").agg(F.count("*").alias("units"), F.avg("size").alias("mean_size"), F.avg("peak").alias("mean_peak"), F.stddev_pop("peak").alias("std_peak"))
    p = footprints.groupBy("session").agg(F.max("a").alias("projection_max"))
    t = traces.groupBy("session").agg(F.avg("v").alias("mean_trace"))
    return a.join(p, "session").join(t, "session").join(n_before, "session").withColumn("retained_percent", 100.0 * F.col("units") / F.col("n_before")).drop("n_before")


def size_histogram(footprints: DataFrame, low: float, high: float, bins: int) -> DataFrame:
    """(session, bin, n): sizes in equal bins; 0 and bins + 1 hold what lies outside."""
    size = footprints.groupBy(*UNIT).agg(F.count("*").alias("size"))
    return size.groupBy("session", F.width_bucket("size", F.lit(low), F.lit(high), F.lit(bins)).alias("bin")).agg(F.count("*").alias("n"))
