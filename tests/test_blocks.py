"""Block sums and products, the factors, bases and updates that rest on them, against plain numpy."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from brightfield.functions import images
from brightfield.operators import arrays, background, blocks, factor, stencil, tiles

H, W = 5, 7


def movie_of(spark, images):
    """Frame rows of {session: frames x pixels}."""
    rows = [(s, t, H, W, [float(v) for v in x[t]]) for s, x in images.items() for t in range(len(x))]
    return spark.createDataFrame(rows, "session string, frame long, h int, w int, px array<double>").repartition(5)


@pytest.fixture()
def small_blocks(monkeypatch):
    for module in (blocks, background):
        monkeypatch.setattr(module, "TILE_PIXELS", 8)
    monkeypatch.setattr(blocks, "TILE_FRAMES", 6)
    monkeypatch.setattr(blocks, "SPREAD", 2)
    monkeypatch.setattr(background, "GRAM_BLOCK", 9)


def planted(rng, n, rank):
    x = rng.normal(size=(n, rank)) * np.array([9.0, 6.0, 4.0, 2.0, 1.0])[:rank] @ rng.normal(size=(rank, H * W))
    return x + 0.01 * rng.normal(size=x.shape) + 3.0


def test_sums_of_arrays(spark):
    rows = [(f"k{i % 3}", i % 2, [float(i), 2.0 * i]) for i in range(50)]
    df = spark.createDataFrame(rows, "a string, b int, v array<double>").repartition(7)
    want = {}
    for a, b, v in rows:
        want[a, b] = np.add(want.get((a, b), 0), v).tolist()
    assert {(r.a, r.b): r.v for r in blocks.summed(df, ["a", "b"]).collect()} == want
    least = {r.a: r.v for r in blocks.summed(df.drop("b"), ["a"], np.minimum).collect()}
    assert least == {f"k{k}": [float(k), 2.0 * k] for k in range(3)}
    assert blocks.summed(df.limit(0), ["a", "b"]).count() == 0


def test_svd_in_blocks(spark, small_blocks):
    """Singular triples of sessions of different length, one with fewer frames than the sketch has columns, and one of rank 2."""
    rng = np.random.default_rng(2)
    images = {"a": planted(rng, 40, 5), "b": planted(rng, 8, 5), "c": np.outer(np.arange(20), np.ones(H * W)) + np.outer(np.cos(np.arange(20)), np.arange(H * W))}
    got = factor.randomized_svd(movie_of(spark, images), 3, 4, oversample=6).toPandas()
    for s, x in images.items():
        u, sv, vt = np.linalg.svd(x, full_matrices=False)
        part = got[got["session"] == s]
        values = part[part["part"] == "S"].sort_values("k")["value"].to_numpy()
        n = 2 if s == "c" else 3
        assert np.allclose(values[:n], sv[:n], rtol=1e-8) and (values[n:] < 1e-5 * sv[0]).all()
        v = part[part["part"] == "V"].pivot(index="index", columns="k", values="value").sort_index().to_numpy()[:, :n]
        left = part[part["part"] == "U"].pivot(index="index", columns="k", values="value").sort_index().to_numpy()[:, :n]
        assert np.allclose(np.abs((v * vt[:n].T).sum(axis=0)), 1, atol=1e-8) and (v[np.abs(v).argmax(axis=0), range(n)] > 0).all()
        assert np.allclose(left * values[:n] @ v.T, (u[:, :n] * sv[:n]) @ vt[:n], atol=1e-6)


def test_svd_runs_one_python_worker_a_task(spark, small_blocks, monkeypatch):
    """No stage chains kernels in workers of their own, and what is made of the triples starts none."""
    made, seen = [], lambda f: lambda *a, **b: made.append(f(*a, **b)) or made[-1]
    monkeypatch.setattr(blocks, "summed", seen(blocks.summed))
    monkeypatch.setattr(factor, "discard", lambda *tables: None)
    svd = factor.randomized_svd(movie_of(spark, {"a": planted(np.random.default_rng(2), 40, 5)}), 3, 1, oversample=6)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert len(made) == 8
    for df in made:
        stages = plan(df).split("== Initial Plan ==")[-1].split("Exchange")
        assert len(stages) > 2 and max(s.count("MapInArrow") for s in stages) == 1
    parts = plan(factor.nndsvd(svd, W))
    assert "Scan parquet" in parts and "MapInArrow" not in parts and "ExistingRDD" not in parts


@pytest.mark.parametrize("least", ["HELD_BYTES", "SMALL_BYTES"])
def test_svd_beyond_what_is_held(spark, small_blocks, monkeypatch, least):
    frames = movie_of(spark, {"a": planted(np.random.default_rng(2), 40, 5), "b": planted(np.random.default_rng(3), 9, 2)})
    make = lambda: factor.randomized_svd(frames, 2, 2, oversample=6).toPandas().set_index(["session", "part", "k", "index"])["value"].sort_index()
    want = make()
    monkeypatch.setattr(blocks, least, 64)
    got = make()
    assert got.index.equals(want.index) and np.allclose(got, want, atol=1e-8)


def test_gathered_sums_are_passed_on(monkeypatch):
    batches = [pa.RecordBatch.from_arrays([pa.array([i % 5]), arrays.lists(np.array([[float(i), 1.0]]))], names=["k", "v"]) for i in range(40)]
    for held, rows in ((1 << 20, 5), (48, 40)):  # 48 bytes: three keys of two numbers; the fourth is passed on with them
        monkeypatch.setattr(blocks, "HELD_BYTES", held)
        got = [(b.column(0)[0].as_py(), b.column(1)[0].as_py()) for b in blocks.gathering(1)(iter(batches))]
        total = {k: np.sum([v for at, v in got if at == k], axis=0).tolist() for k, _ in got}
        assert len(got) == rows and total == {k: [float(sum(range(k, 40, 5))), 8.0] for k in range(5)}


def test_whitening_of_a_dependent_basis():
    rng = np.random.default_rng(0)
    z = rng.normal(size=(50, 4)) * [1, 1e-6, 1e6, 1]
    made = z @ blocks.whitening({"s": z.T @ z})["s"]
    assert np.allclose(made.T @ made, np.eye(4), atol=1e-8)
    z[:, 3] = z[:, 0]
    z[:, 1] = 0
    made = z @ blocks.whitening({"s": z.T @ z})["s"]
    g = made.T @ made
    assert np.allclose(sorted(np.diag(g)), [0, 0, 1, 1], atol=1e-8) and np.allclose(g, np.diag(np.diag(g)), atol=1e-8)


def test_basis_in_blocks(spark, small_blocks):
    rng = np.random.default_rng(3)
    images = {"a": planted(rng, 40, 3), "b": planted(rng, 25, 3), "flat": np.ones((4, H * W))}
    frames = movie_of(spark, images)
    for movie in (frames, arrays.as_pixels(frames)):
        got = background.lowrank_basis(movie, H, W, 3).toPandas()
        for s, x in images.items():
            part = got[got["session"] == s].sort_values(["mode", "y", "x"])
            assert np.allclose(part[part["mode"] == -1]["value"], x.mean(axis=0))
            modes = part[part["mode"] >= 0]["value"].to_numpy().reshape(-1, H * W)
            vt = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)[2][:3]
            assert len(modes) == (0 if s == "flat" else 3) and (len(modes) == 0 or np.allclose(np.abs((modes * vt).sum(axis=1)), 1, atol=1e-8))
    left = background.lowrank_subtract(arrays.as_pixels(frames), background.lowrank_basis(frames, H, W, 3), False).toPandas()
    assert left[left["session"] != "flat"]["v"].abs().max() < 0.1 and len(left) == 69 * H * W
    again = frames.where("session = 'a'").unionByName(frames.where("session = 'a'"))
    assert background.lowrank_basis(again, H, W, 1).where("mode = -1").count() == H * W


def plain_update(x, c, f, places, penalties, min_std, least):
    """Lasso of each pixel, one at a time, over the grid of penalties."""
    regress = np.vstack([f, c])
    regress = regress - regress.mean(axis=1, keepdims=True)
    norm = np.sqrt((regress**2).sum(axis=1))
    z = regress / norm[:, None]
    out = {}
    for p in places:
        m, s = x[:, p].mean(), x[:, p].std()
        if s < min_std:
            continue
        y = (x[:, p] - m) / s
        total = weight = 0.0
        for alpha in np.logspace(np.log10(penalties[0]), np.log10(penalties[1]), penalties[2]):
            b = tiles.lasso(z @ z.T, (z @ y)[:, None], len(y) * alpha)[:, 0]
            left = max(((y - z.T @ b) ** 2).sum(), 1e-12)
            total, weight = total + b / left, weight + 1 / left
        for k, a in enumerate((total / weight * s / norm)[1:]):
            if a > least:
                out[k, p // W, p % W] = a
    return out


def test_spatial_update_against_plain(spark, monkeypatch):
    """Two sessions and overlapping clusters: planted footprints, frame rows and pixel rows, one pass or many, against one pixel at a time."""
    rng = np.random.default_rng(4)
    n, foot = 60, {0: [0, 1, 7, 8], 1: [8, 9, 15], 2: [25, 26, 33, 34]}
    groups = {10: ([0, 1], [0, 1, 2, 7, 8, 9, 15, 16]), 20: ([1, 2], [9, 15, 25, 26, 27, 33, 34])}
    images, traces, back, want = {}, [], [], {}
    for s in "ab":
        c, f = np.abs(rng.normal(size=(3, n))), np.abs(rng.normal(size=n))
        x = 2.0 + 0.3 * f[:, None] + 0.02 * rng.normal(size=(n, H * W))
        for u, p in foot.items():
            x[:, p] += c[u][:, None]
        x[:, 16] = 5.0
        images[s] = x
        traces += [(s, u, t, float(c[u, t])) for u in range(3) for t in range(n)]
        back += [(s, t, float(f[t])) for t in range(n)]
        for units, places in groups.values():
            for (k, y, col), a in plain_update(x, c[units], f, places, (1e-6, 1e-2, 10), 0.1, 1e-8).items():
                want.setdefault((s, units[k], y, col), []).append(a)
    frames = movie_of(spark, images)
    given = (
        spark.createDataFrame(traces, "session string, unit_id long, frame long, v double"),
        spark.createDataFrame(back, "session string, frame long, f double"),
        spark.createDataFrame([(s, u, g) for s in "ab" for g, (units, _) in groups.items() for u in units], "session string, unit_id long, cluster_id long"),
        spark.createDataFrame([(s, g, p // W, p % W) for s in "ab" for g, (_, places) in groups.items() for p in places], "session string, cluster_id long, y int, x int"),
    )
    for movie, most in ((frames, 1 << 20), (frames, 5), (arrays.as_pixels(frames), 1 << 20)):
        monkeypatch.setattr(tiles, "PASS_PIXELS", most)
        got = {}
        for r in tiles.spatial_update(movie, *given).collect():
            got.setdefault((r.session, r.unit_id, r.y, r.x), []).append(r.a)
        assert got.keys() == want.keys() and all(np.allclose(sorted(got[i]), sorted(want[i]), rtol=1e-6, atol=1e-9) for i in want)
    large = {i for i, a in got.items() if max(a) > 0.5}
    assert large == {(s, u, p // W, p % W) for s in "ab" for u, places in foot.items() for p in places}
    plan = tiles.spatial_update(frames, *given)._jdf.queryExecution().toString()
    assert "posexplode(px" not in plan  # the movie's pixels are never rows
    empty = tiles.spatial_update(frames.limit(0), *given)
    assert empty.count() == 0 and tiles.spatial_update(frames, *given[:3], given[3].limit(0)).count() == 0


@pytest.mark.parametrize("k", [1, 3, 5, 7, 9, 11, 13])
def test_median_network(monkeypatch, k):
    rng = np.random.default_rng(k)
    monkeypatch.setattr(images, "MEDIAN_PLANE", 100)
    for wide in (rng.normal(size=(20 + k, 17 + k)), rng.integers(0, 5, (k, k)).astype(float), rng.integers(0, 200, (9 + k, 3 + k)).astype(float)):
        windows = np.lib.stride_tricks.sliding_window_view(wide, (k, k))
        assert np.array_equal(images.box_median(wide, k), np.median(windows, axis=(2, 3)))


def test_merges_of_any_lengths():
    rng = np.random.default_rng(1)
    for m in range(9):
        for n in range(9):
            a, b = np.sort(rng.integers(0, 9, (m, 30)), axis=0), np.sort(rng.integers(0, 9, (n, 30)), axis=0)
            got = images.merged(list(a), list(b))
            assert m + n == len(got) and (m + n == 0 or np.array_equal(np.stack(got), np.sort(np.concatenate([a, b]), axis=0)))


def test_extremes_over_any_offsets():
    rng = np.random.default_rng(2)
    stack = rng.normal(size=(3, 9, 11))
    for offsets in (stencil.disk(3), stencil.disk(2.5), [(0, 0, 1.0)], [(0, -2, 1.0), (0, 0, 1.0), (0, 1, 1.0), (1, -3, 1.0), (-2, 4, 1.0)], stencil.box(5)):
        for op, fill in ((np.minimum, np.inf), (np.maximum, -np.inf)):
            wide = np.pad(stack, ((0, 0), (5, 5), (5, 5)), constant_values=fill)
            want = op.reduce([wide[:, 5 + dy : 14 + dy, 5 + dx : 16 + dx] for dy, dx, _ in offsets])
            assert np.array_equal(images.extreme(stack, offsets, op, "ignore"), want)


def test_cleaning_in_one_pass_is_the_steps_one_by_one(spark):
    rng = np.random.default_rng(3)
    frames = movie_of(spark, {"a": rng.integers(0, 99, (6, H * W)), "b": rng.normal(size=(4, H * W))})
    for background_, make in (("tophat", stencil.tophat_background), ("uniform", stencil.uniform_background)):
        low = stencil.min_subtract(frames, H, W)
        for order, want in (("background-denoise", stencil.median_denoise(make(low, 3, H, W), 3, H, W)), ("denoise-background", make(stencil.median_denoise(low, 3, H, W), 3, H, W))):
            get = lambda df: {(r.session, r.frame): r.px for r in df.collect()}
            assert get(stencil.preprocess(frames, H, W, order, background_)) == get(want)
