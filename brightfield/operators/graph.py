"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brightfield.sources.storage import discard, materialize


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of all nodes with an edge; component is the smallest node. Nodes are of any type with an order.

    Every round, nodes link their larger neighbours to the smallest one around them, first all of them
    (large star), then the smaller ones (small star). The smallest neighbour is a pre-aggregated minimum, and
    the join that hands it out lets Spark split a hot node. Rounds grow with the logarithm of the longest
    chain; each is written, so that lineage stays short, and takes the place of the one before. Self-loops
    and repeated edges change nothing.
    """
    now = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    now = materialize(now, "components", compact=True)
    while not _stars(now):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialize(large.where("u <> v").distinct(), "components", compact=True)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        superseded = [now, large]
        now = materialize(small.where("u <> v").distinct(), "components", compact=True)
        discard(*superseded)
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _stars(edges: DataFrame) -> bool:
    """Whether every node either points to one other or is pointed at."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("from"), F.lit(0).alias("to")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("from"), F.lit(1).alias("to")))
    return ends.groupBy("node").agg(F.sum("from").alias("from"), F.max("to").alias("to")).where("from > 1 or (from = 1 and to = 1)").isEmpty()


def assign_components(nodes: DataFrame, edges: DataFrame, name: str = "component") -> DataFrame:
    """nodes (session, unit_id) with the smallest unit_id of their component over edges (session, u1, u2); a node without an edge is its own."""
    pairs = edges.select(F.struct("session", F.col("u1").alias("unit_id")).alias("a"), F.struct("session", F.col("u2").alias("unit_id")).alias("b"))
    found = connected_components(pairs).select("node.session", "node.unit_id", F.col("component.unit_id").alias(name))
    return nodes.select("session", "unit_id").distinct().join(found, ["session", "unit_id"], "left").withColumn(name, F.coalesce(name, "unit_id"))


def greedy_groups(nodes: DataFrame, edges: DataFrame, name: str, most: int | None = None) -> DataFrame:
    """nodes (session, unit_id, size) with the unit that takes them, as if units were asked from the smallest on.

    A unit that no smaller one has taken is a seed and takes its free larger neighbours by edges (session, u1, u2; u1 < u2), smallest first; with
    `most`, those that would lift the sum of its sizes beyond it stay free. In a round every unit decides that has no smaller undecided neighbour and
    whose neighbours have none either, so that no two take the same: the outcome is that of the sequence, and no task sees more than one unit's
    neighbours. The smallest undecided unit of each session always decides. Rounds are as many as the longest chain of units that wait for
    one another; each is written and takes the place of the one before.
    """
    sizes = nodes.select("session", "unit_id", F.col("size").cast("long").alias("size"))
    of = lambda u, s: sizes.select("session", F.col("unit_id").alias(u), F.col("size").alias(s))
    left = materialize(edges.select("session", "u1", "u2").distinct().join(of("u1", "s1"), ["session", "u1"]).join(of("u2", "s2"), ["session", "u2"]), "greedy-edges", compact=True)
    taken = None
    while not left.isEmpty():
        smaller = left.groupBy("session", F.col("u2").alias("u")).agg(F.min("u1").alias("a"))
        beside = left.join(smaller.select("session", F.col("u").alias("u2"), F.col("a").alias("first")), ["session", "u2"]).join(smaller.select("session", F.col("u").alias("u1"), F.col("a").alias("above")), ["session", "u1"], "left")
        free = F.col("above").isNull() & (F.col("first") == F.col("u1"))
        near = F.sort_array(F.collect_list(F.struct(F.col("u2").alias("u"), F.col("s2").alias("s"))))
        ready = beside.groupBy("session", "u1").agg(F.min(free).alias("free"), F.first("s1").alias("size"), near.alias("near")).where("free")
        if most is None:
            takes = F.transform("near", lambda v: v["u"])
        else:
            start = F.struct(F.col("size").alias("total"), F.array().cast("array<long>").alias("units"))
            add = lambda st, v: F.when(st["total"] + v["s"] <= most, F.struct((st["total"] + v["s"]).alias("total"), F.concat(st["units"], F.array(v["u"])).alias("units"))).otherwise(st)
            takes = F.aggregate("near", start, add)["units"]
        decided = materialize(ready.select("session", F.col("u1").alias("seed"), takes.alias("units")), "greedy-round", compact=True)
        won = decided.select("session", F.explode("units").alias("unit_id"), F.col("seed").alias("taken_by"))
        gone = decided.select("session", F.explode(F.concat(F.array("seed"), "units")).alias("u"))
        past = left
        left = left.join(gone.withColumnRenamed("u", "u1"), ["session", "u1"], "left_anti").join(gone.withColumnRenamed("u", "u2"), ["session", "u2"], "left_anti")
        left = materialize(left, "greedy-edges", compact=True)
        discard(past)
        taken = won if taken is None else taken.unionByName(won)
    discard(left)
    units = nodes.select("session", "unit_id").distinct()
    if taken is None:
        return units.withColumn(name, F.col("unit_id"))
    return units.join(taken, ["session", "unit_id"], "left").select("session", "unit_id", F.coalesce("taken_by", "unit_id").alias(name))
