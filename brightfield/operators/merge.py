"""Merging of units by overlap and correlation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from brightfield.operators.base import PIXEL, UNIT
from brightfield.operators.graph import assign_components


def overlap_pairs(footprints: DataFrame) -> DataFrame:
    """(session, u1, u2, n, containment, jaccard) of units with a common pixel: those that meet in a pixel are paired, no others."""
    a = footprints.select(*PIXEL, F.col("unit_id").alias("u1"))
    b = footprints.select(*PIXEL, F.col("unit_id").alias("u2"))
    common = a.join(b, PIXEL).where("u1 < u2").groupBy("session", "u1", "u2").agg(F.count("*").alias("n"))
    size = footprints.groupBy(*UNIT).agg(F.count("*").alias("size"))
    both = common.join(size.select("session", F.col("unit_id").alias("u1"), F.col("size").alias("s1")), ["session", "u1"]).join(size.select("session", F.col("unit_id").alias("u2"), F.col("size").alias("s2")), ["session", "u2"])
    return both.select("session", "u1", "u2", "n", (F.col("n") / F.least("s1", "s2")).alias("containment"), (F.col("n") / (F.col("s1") + F.col("s2") - F.col("n"))).alias("jaccard"))


def trace_corr(traces: DataFrame, pairs: DataFrame) -> DataFrame:
    """Pearson r of the pairs' traces; null where a trace is constant. Sums are exact in one pass over common frames."""
    x = pairs.select("session", "u1", "u2").join(traces.select("session", F.col("unit_id").alias("u1"), "frame", F.col("v").alias("x")), ["session", "u1"])
    y = x.join(traces.select("session", F.col("unit_id").alias("u2"), "frame", F.col("v").alias("y")), ["session", "u2", "frame"])
    return y.groupBy("session", "u1", "u2").agg(F.corr("x", "y").alias("r"))


def merge_edges(footprints: DataFrame, traces: DataFrame, containment: float, r: float) -> DataFrame:
    close = overlap_pairs(footprints).where(F.col("containment") >= containment)
    return close.join(trace_corr(traces, close), ["session", "u1", "u2"]).where(F.col("r") >= r).select("session", "u1", "u2", "containment", "r")


def merge_groups(footprints: DataFrame, traces: DataFrame, containment: float = 0.3, r: float = 0.75, most: int = 5000, edges: DataFrame | None = None) -> DataFrame:
    """(session, unit_id, group_id, split): components of the edges; a group whose union has more than `most` pixels falls back to single units."""
    links = merge_edges(footprints, traces, containment, r) if edges is None else edges
    parts = assign_components(footprints, links)
    union = footprints.join(parts, UNIT).groupBy("session", "component").agg(F.countDistinct("y", "x").alias("pixels"), F.countDistinct("unit_id").alias("units"))
    large = (F.col("pixels") > most) & (F.col("units") > 1)
    return parts.join(union, ["session", "component"]).select(*UNIT, F.when(large, F.col("unit_id")).otherwise(F.col("component")).alias("group_id"), large.alias("split"))


def merge_report(groups: DataFrame, edges: DataFrame) -> DataFrame:
    """Per session: edges, groups of several units, units that went into them and groups that were split."""
    sizes = groups.groupBy("session", "group_id").agg(F.count("*").alias("n"))
    a = sizes.groupBy("session").agg(F.count_if(F.col("n") > 1).alias("merged_groups"), F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)).alias("merged_units"))
    b = groups.groupBy("session").agg(F.count_if("split").alias("split_units"))
    c = edges.groupBy("session").agg(F.count("*").alias("edges"))
    return a.join(b, "session").join(c, "session", "left").withColumn("edges", F.coalesce("edges", F.lit(0)))


def merge_footprints(footprints: DataFrame, groups: DataFrame) -> DataFrame:
    """Footprints summed within their group, which gives the new unit_id."""
    return footprints.join(groups.select(*UNIT, "group_id"), UNIT).groupBy("session", F.col("group_id").alias("unit_id"), "y", "x").agg(F.sum("a").alias("a"))


def merge_traces(traces: DataFrame, groups: DataFrame, how: str = "sum") -> DataFrame:
    """Traces summed or averaged within their group."""
    f = F.avg if how == "mean" else F.sum
    return traces.join(groups.select(*UNIT, "group_id"), UNIT).groupBy("session", F.col("group_id").alias("unit_id"), "frame").agg(f("v").alias("v"))


def common_units(*tables: DataFrame) -> DataFrame:
    """(session, unit_id) that all tables have."""
    out = tables[0].select(*UNIT).distinct()
    for t in tables[1:]:
        out = out.join(t.select(*UNIT).distinct(), UNIT, "left_semi")
    return out


def align_by_position(first: DataFrame, second: DataFrame) -> DataFrame:
    """(session, unit_1, unit_2): the k-th unit of one with the k-th of the other, on request alone."""
    by = W.partitionBy("session").orderBy("unit_id")
    number = lambda t, n: t.select(*UNIT).distinct().select("session", F.col("unit_id").alias(n), F.row_number().over(by).alias("k"))
    return number(first, "unit_1").join(number(second, "unit_2"), ["session", "k"]).select("session", "unit_1", "unit_2")



