"""Planted footprints through fragments, guarded merges, seams and the whole cleanup; shapes with known hulls and ellipses."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from brightfield.functions.kernels import hull_area
from brightfield.operators import cleanup, reject

H = W = 40


def bump(cy, cx, r, top=1.0):
    """Pixels of a disk whose values fall from the centre."""
    return {(y, x): top * (1 - 0.5 * ((y - cy) ** 2 + (x - cx) ** 2) / (r * r)) for y in range(H) for x in range(W) if (y - cy) ** 2 + (x - cx) ** 2 <= r * r}


def table(spark, units, session="s"):
    rows = [(session, u, y, x, float(a)) for u, px in units.items() for (y, x), a in px.items()]
    return spark.createDataFrame(rows, "session string, unit_id long, y int, x int, a double")


def test_fragments_of_planted_units(spark):
    """Two cells that touch are cut between their peaks; far pieces stay by size; the largest piece of a small unit stays whatever its size."""
    left, right = bump(10, 10, 5), bump(10, 19, 5, 0.8)
    far, speck = bump(30, 30, 3), {(0, 39): 0.9, (1, 39): 0.9}
    tiny = {(35, 5): 1.0, (35, 6): 0.5, (39, 0): 1.0}
    a = table(spark, {1: {**left, **right, **far, **speck}, 2: tiny})
    got = {}
    for r in cleanup.split_fragments(a, H, W, 25, 0.3).collect():
        got.setdefault((r.unit_id, r.fragment), {})[r.y, r.x] = r.a
    both = set(left) | set(right)
    assert {k: len(v) for k, v in got.items()} == {(1, 1): len(got[1, 1]), (1, 2): len(got[1, 2]), (1, 3): len(far), (2, 1): 2}
    assert set(got[1, 1]) | set(got[1, 2]) == both and not set(got[1, 1]) & set(got[1, 2]) and set(got[1, 3]) == set(far)
    of = lambda y, x: next(f for f in (1, 2) if (y, x) in got[1, f])
    assert of(10, 10) != of(10, 19) and all(of(y, x) == of(10, 10) for y, x in left if x < 14) and all(of(y, x) == of(10, 19) for y, x in right if x > 15)
    whole = cleanup.split_fragments(a, H, W, 25, 0.3, mode="lump").where("unit_id = 1").collect()
    assert {(r.y, r.x) for r in whole} == both | set(far) and {r.fragment for r in whole} == {1}
    # a ratio that the far piece misses, and a bound that all but the largest miss
    assert {r.fragment for r in cleanup.split_fragments(a, H, W, 25, 0.9).where("unit_id = 1").collect()} == {1, 2}
    assert cleanup.split_fragments(a, H, W, 500, 0.3).select("unit_id", "fragment").distinct().count() == 2
    ids = cleanup.fragment_ids(cleanup.split_fragments(a, H, W, 25, 0.3)).collect()
    assert {(r.parent_unit_id, r.fragment) for r in ids} == set(got) and len({r.unit_id for r in ids}) == 4


def waves(spark, shapes, n=40):
    rows = [("s", u, t, float(f(t))) for u, f in shapes.items() for t in range(n)]
    return spark.createDataFrame(rows, "session string, unit_id long, frame long, v double")


def test_guarded_merge_of_planted_fragments(spark):
    """1 and 2 are siblings, 3 overlaps both and moves with them, 4 overlaps 3 and moves otherwise, 5 is far away."""
    cell = bump(10, 10, 5)
    units = {1: cell, 2: {p: a for p, a in cell.items() if p[0] > 7}, 4: {p: a for p, a in cell.items() if p[1] > 7}, 5: bump(30, 30, 4)}
    move = lambda t: np.sin(t / 3)
    c = waves(spark, {1: move, 2: lambda t: 2 * move(t) + 0.01 * t, 3: lambda t: move(t) + 0.02 * (t % 2), 4: lambda t: np.cos(t / 2), 5: move})
    lineage = spark.createDataFrame([("s", u, p) for u, p in ((1, 10), (2, 10), (3, 11), (4, 12), (5, 13))], "session string, unit_id long, parent_unit_id long")

    def groups(given, **how):
        return {r.unit_id: r.group_id for r in cleanup.merge_guarded(table(spark, given), c, lineage, **how).collect()}

    assert groups(units) == {1: 1, 2: 2, 4: 4, 5: 5}
    assert groups(units, guard=False) == {1: 1, 2: 1, 4: 4, 5: 5}
    # through a fragment of another parent siblings do meet
    assert groups({**units, 3: cell}) == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5}
    assert groups({**units, 3: cell}, most=20) == {u: u for u in (1, 2, 3, 4, 5)}


def test_cleanup_of_planted_units(spark):
    """Two parents share a cell and move alike; one of them holds a second cell; a third unit lies over its edge. Halo, fragments, merge, seam and traces."""
    cell, second, other = bump(10, 10, 5), bump(10, 28, 5), bump(10, 17, 4, 0.9)
    halo = {(25, x): 0.05 for x in range(40)}
    a = table(spark, {1: {**cell, **second, **halo}, 2: {p: 0.5 * v for p, v in cell.items()}, 3: other})
    move = {1: lambda t: np.sin(t / 3), 2: lambda t: 3 * np.sin(t / 3), 3: lambda t: np.cos(t / 2)}
    made, traces, ancestry = cleanup.cleanup(a, waves(spark, move), H, W, drop=10, seam=1)
    got = {}
    for r in made.collect():
        got.setdefault(r.unit_id, {})[r.y, r.x] = r.a
    parents = {}
    for r in ancestry.collect():
        parents.setdefault(r.unit_id, set()).add(r.parent_unit_id)
    owner = {p: u for u, px in got.items() for p in px}
    assert len(got) == 3 and sorted(map(sorted, parents.values())) == [[1], [1, 2], [3]]
    assert parents[owner[10, 10]] == {1, 2} and parents[owner[10, 28]] == {1} and parents[owner[10, 18]] == {3}
    assert all(abs(v - 1.5 * cell[p]) < 1e-9 for p, v in got[owner[10, 10]].items()) and not any(p[0] == 25 for p in owner)
    # nothing is left within a pixel of where two units touch
    strongest = {p: max(((v, -u) for u, px in ((1, {q: 1.5 * v for q, v in cell.items()}), (2, second), (3, other)) if p in px for v in [px[p]])) for p in {**cell, **second, **other}}
    lot = {p: -u for p, (_, u) in strongest.items()}
    near = lambda p: [(p[0] + i, p[1] + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    seam = {p for p in lot if len({lot[q] for q in near(p) if q in lot}) > 1}
    cut = {(y + i, x + j) for y, x in seam for i, j in ((0, 0), (0, 1), (1, 0), (0, -1), (-1, 0))}
    assert set(owner) == set(lot) - cut and seam
    t = {(r.unit_id, r.frame): r.v for r in traces.collect()}
    assert all(abs(t[owner[10, 10], k] - 2 * np.sin(k / 3)) < 1e-9 and abs(t[owner[10, 18], k] - np.cos(k / 2)) < 1e-9 for k in range(40))


def test_shapes_of_planted_regions(spark):
    """Solidity and eccentricity of the largest region: a bar, an L, a cross, a disk and a ring with a larger piece elsewhere."""
    bar = {(y, x): 1.0 for y in range(2) for x in range(8)}
    corner = {(y, x): 1.0 for y in range(6) for x in range(6) if y < 2 or x < 2}
    diagonal = {(k, k): 1.0 for k in range(7)}
    disk = bump(20, 20, 9)
    small = {(30, 30): 9.0, (30, 31): 9.0}
    got = {r.unit_id: r for r in reject.shape_props(table(spark, {1: bar, 2: corner, 3: diagonal, 4: disk, 5: {**small, **bar}})).collect()}
    vy, vx = (4 - 1) / 12 + 1 / 12, (64 - 1) / 12 + 1 / 12
    assert got[1].solidity == pytest.approx(1) and got[1].eccentricity == pytest.approx(np.sqrt(1 - vy / vx)) and got[1].size == 16
    assert got[2].solidity == pytest.approx(20 / (36 - 0.5 * 4 * 4))
    assert got[3].solidity == pytest.approx(7 / 13) and got[3].eccentricity == pytest.approx(np.sqrt(1 - (1 / 12) / (2 * 4 + 1 / 12)))
    assert got[4].eccentricity == pytest.approx(0, abs=1e-6) and 0.9 < got[4].solidity <= 1
    assert (got[5].solidity, got[5].eccentricity, got[5].size) == (pytest.approx(1), got[1].eccentricity, 18)


def test_hulls_against_half_planes():
    """The hull's area against counting fine points that no edge through two corners leaves out."""
    rng = np.random.default_rng(4)
    for _ in range(20):
        n = int(rng.integers(1, 7))
        y, x = rng.integers(0, 6, n), rng.integers(0, 6, n)
        corners = np.unique(np.concatenate([np.stack([y + a, x + b], 1) for a in (0, 1) for b in (0, 1)]), axis=0).astype(float)
        gy, gx = (g.ravel() for g in np.mgrid[0:7:0.05, 0:7:0.05] + 0.025)
        inside = np.ones(len(gy), dtype=bool)
        for p in corners:
            for q in corners:
                side = (q[0] - p[0]) * (corners[:, 1] - p[1]) - (q[1] - p[1]) * (corners[:, 0] - p[0])
                if (p != q).any() and (side <= 1e-12).all():
                    inside &= (q[0] - p[0]) * (gx - p[1]) - (q[1] - p[1]) * (gy - p[0]) <= 0
        assert hull_area(y, x) == pytest.approx(inside.sum() * 0.05**2, abs=0.35)


def test_unit_without_fragments_is_no_row(spark):
    assert cleanup.split_fragments(table(spark, {1: {(0, 0): 1.0}}).limit(0), H, W).count() == 0
    one = cleanup.split_fragments(table(spark, {1: {(0, 0): 1.0}}), H, W).select(F.sum("a")).first()[0]
    assert one == 1.0
