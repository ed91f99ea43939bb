"""Ranks and gaps of a session's values out of counts and extremes of buckets: no task sorts or holds a session."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brightfield.operators.arrays import small
from brightfield.sources.storage import discard, materialize

#: Buckets that one array holds at most.
BUCKETS = 4096
#: Levels in which neighbouring buckets are put together: enough for 2^36 of them.
LEVELS = 3


def _bucket(v: Column, lo: Column, hi: Column, n: Column) -> Column:
    """The number, below n, of v's bucket among equal ones of [lo, hi]; halves are taken, since hi - lo may be no finite number."""
    width = hi / 2 - lo / 2
    return F.when(width == 0, F.when(v > lo, 1).otherwise(0)).otherwise(F.least(F.floor((v / 2 - lo / 2) / width * n), n - 1)).cast("long")


def value_at_rank(values: DataFrame, ranks: DataFrame, column: str) -> DataFrame:
    """(session, value): the k-th smallest of a stored table's values, ranks (session, k) from 1 and at most the session's rows.

    Every round counts the values between two bounds in buckets and goes on between the least and greatest value of the bucket that the rank
    falls into, until these are one. A round leaves out at least one distinct value and commonly all but one in BUCKETS; values of many scales take a round for every few of them.
    """
    ends = values.groupBy("session").agg(F.min(column).alias("lo"), F.max(column).alias("hi"))
    now = materialize(ranks.join(ends, "session").select("session", F.col("k").cast("long").alias("k"), "lo", "hi"), "rank", compact=True)
    while not now.where("lo < hi").isEmpty():
        inside = values.join(small(now.where("lo < hi")), "session").where(F.col(column).between(F.col("lo"), F.col("hi")))
        b = _bucket(F.col(column), F.col("lo"), F.col("hi"), F.lit(BUCKETS))
        counted = inside.groupBy("session", "k", b.alias("b")).agg(F.count("*").alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi"))
        line = F.sort_array(F.collect_list(F.struct("b", "n", "lo", "hi")))
        unknown = F.lit(None).cast("double")
        begin = F.struct(F.col("k").alias("k"), unknown.alias("lo"), unknown.alias("hi"))
        go = lambda st, e: F.when(st["lo"].isNotNull(), st).when(st["k"] <= e["n"], F.struct(st["k"].alias("k"), e["lo"].alias("lo"), e["hi"].alias("hi"))).otherwise(F.struct((st["k"] - e["n"]).alias("k"), unknown.alias("lo"), unknown.alias("hi")))
        found = counted.groupBy("session", "k").agg(line.alias("line")).select("session", F.aggregate("line", begin, go).alias("s")).select("session", "s.*")
        past = now
        now = materialize(found.unionByName(now.where("lo = hi")), "rank", compact=True)
        discard(past)
    return now.select("session", F.col("lo").alias("value"))


def largest_gap(values: DataFrame, column: str) -> DataFrame:
    """(session, middle): the middle of the largest gap between neighbouring values; of equal gaps the lowest. The value itself where all are equal.

    n values have a gap of at least their spread by n - 1, so that none of the largest lies within one of 2 n equal buckets: each bucket's
    extremes are enough. Neighbouring buckets are put together by BUCKETS, level by level.
    """
    ends = values.groupBy("session").agg(F.min(column).alias("lo"), F.max(column).alias("hi"), F.count("*").alias("n"))
    b = _bucket(F.col(column), F.col("lo"), F.col("hi"), 2 * F.col("n"))
    least = F.min(column)
    now = values.join(small(ends), "session").groupBy("session", b.alias("b")).agg(least.alias("a"), F.max(column).alias("z"), F.struct(F.lit(0.0).alias("gap"), (-least).alias("low"), least.alias("middle")).alias("best"))
    between = lambda e, f: F.struct((f["a"] - e["z"]).alias("gap"), (-e["z"]).alias("low"), (e["z"] / 2 + f["a"] / 2).alias("middle"))
    for _ in range(LEVELS):
        line = now.groupBy("session", F.expr(f"b div {BUCKETS}").alias("b")).agg(F.sort_array(F.collect_list(F.struct("a", "z", "best"))).alias("line"))
        others = F.size("line") - 1
        gaps = F.zip_with(F.slice("line", 1, others), F.slice("line", 2, others), between)
        best = F.array_max(F.concat(F.transform("line", lambda e: e["best"]), gaps))
        now = line.select("session", "b", F.element_at("line", 1)["a"].alias("a"), F.element_at("line", -1)["z"].alias("z"), best.alias("best"))
    return now.select("session", F.col("best")["middle"].alias("middle"))
