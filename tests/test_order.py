"""Ranks and gaps by buckets against sorted lists."""

import math
import random

import pytest

from brightfield.operators import frames, order
from brightfield.sources.storage import materialize


@pytest.fixture(scope="module")
def given():
    rnd = random.Random(3)
    made = {f"uniform{n}": [rnd.random() for _ in range(n)] for n in (3, 4, 99, 100, 101, 7000)}
    made["two"] = [1.0, 2.0]
    made["equal"] = [4.5] * 50
    made["ties"] = [float(rnd.randint(0, 3)) for _ in range(300)]
    made["equal gaps"] = [float(v) for v in range(64)] * 3
    made["scales"] = [10.0 ** rnd.randint(-9, 9) for _ in range(500)]
    made["far"] = [rnd.gauss(0, 1) for _ in range(998)] + [1e300, -1e300]
    made["widest"] = [-1.7e308, 1.7e308, 0.0, 1.0] * 40
    return made


def plain_threshold(scores):
    """The middle of the largest gap among sorted scores of ranks up to 99 %."""
    s = sorted(scores)
    m = math.floor(0.99 * len(s))
    gaps = [(s[k] - s[k - 1], -k, s[k - 1] / 2 + s[k] / 2) for k in range(1, m)]
    return max(gaps)[2] if gaps else None


def test_threshold_is_that_of_the_sorted_scores(spark, given):
    """Ties, one value, few values, far outliers and many scales; scores that are no number take no part."""
    rows = [(s, f, v) for s, values in given.items() for f, v in enumerate(values)]
    odd = [("uniform99", 1000, float("nan")), ("uniform99", 1001, float("inf")), ("equal", 1000, None), ("none", 0, None)]
    table = spark.createDataFrame(rows + odd, "session string, frame long, score double").repartition(7)
    made = frames.gap_threshold(table)
    got = {r.session: r.threshold for r in made.collect()}
    assert got == {s: t for s, values in given.items() if (t := plain_threshold(values)) is not None}
    assert "two" not in got and "Window" not in made._jdf.queryExecution().optimizedPlan().toString()
    assert frames.gap_threshold(table.limit(0)).count() == 0


def test_value_at_rank(spark, given):
    rows = [(s, v) for s, values in given.items() for v in values]
    table = materialize(spark.createDataFrame(rows, "session string, v double"))
    for part in (0.0, 0.31, 0.99, 1.0):
        k = {s: max(1, math.floor(part * len(values))) for s, values in given.items()}
        ranks = spark.createDataFrame(list(k.items()), "session string, k long")
        got = {r.session: r.value for r in order.value_at_rank(table, ranks, "v").collect()}
        assert got == {s: sorted(values)[k[s] - 1] for s, values in given.items()}
