"""Kernels and operators without SQL, against planted truth and invariants."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from brightfield.functions import kernels as k
from brightfield.operators import background, cleanup, factor, ingest, merge, motion, reject, segment, tiles, traces
from brightfield.sources import fixtures as fx

SF = "/root/testdata/sf0.001"


def blob(h, w, cy, cx, s=3.0):
    y, x = np.mgrid[:h, :w]
    return np.exp(-((y - cy) ** 2 + (x - cx) ** 2) / (2 * s * s)) + 0.3 * np.sin(y / 3.0) * np.cos(x / 4.0)


def test_phase_shift_finds_planted_shift():
    rng = np.random.default_rng(0)
    img = np.fft.fft2(rng.standard_normal((32, 32)))
    ky, kx = np.fft.fftfreq(32)[:, None], np.fft.fftfreq(32)[None, :]
    smooth = img * (np.abs(ky) < 0.45) * (np.abs(kx) < 0.45)
    a = np.fft.ifft2(smooth).real
    b = np.fft.ifft2(smooth * np.exp(-2j * np.pi * (ky * 1.37 + kx * -2.61))).real
    dy, dx = k.phase_shift(a, b)
    assert abs(-dy - 1.37) < 0.05 and abs(-dx + 2.61) < 0.05


def test_motion_tree_recovers_whole_pixel_moves(spark):
    rng = np.random.default_rng(1)
    base = rng.standard_normal((16, 16))
    moves = [(0, 0), (1, 0), (1, -2), (0, -1), (2, 1), (-1, 1), (0, 2)]
    rows = [("s", i, 16, 16, [float(v) for v in np.roll(base, m, axis=(0, 1)).ravel()]) for i, m in enumerate(moves)]
    frames = spark.createDataFrame(rows, "session string, frame long, h int, w int, px array<float>")
    got = {r.frame: (r.dy, r.dx) for r in motion.estimate_motion(frames, upsample=10).collect()}
    for i in range(1, len(moves)):
        assert np.allclose(np.subtract(got[i], got[0]), np.subtract(moves[i], moves[0]), atol=0.6)
    pairs = {r.frame: (r.dy, r.dx) for r in motion.pair_shift(frames, block=3).collect()}
    assert sorted(pairs) == list(range(1, len(moves)))
    for i in pairs:
        assert np.allclose(pairs[i], np.subtract(moves[i], moves[i - 1]), atol=0.05)


def test_deconvolution_finds_planted_spikes():
    g = np.array([1.6, -0.64])
    spikes = np.zeros(300)
    spikes[[20, 90, 91, 200]] = [1.0, 2.0, 1.0, 1.5]
    c = np.convolve(spikes, k.impulse(g, 300))[:300]
    rng = np.random.default_rng(2)
    made = k.deconvolve(c + 0.5 + 0.01 * rng.standard_normal(300), g, 0.01, 1.0, iters=3000)
    assert (made["s"] >= 0).all() and (made["c"] >= 0).all()
    assert np.corrcoef(made["c"], c)[0, 1] > 0.99
    assert abs(made["b"] - 0.5) < 0.2


def test_certificate_of_deconvolution():
    """The gap against a slow exact solution: never under the true distance, small where the iteration ended, large where it was cut off."""
    rng = np.random.default_rng(6)
    for g, sigma, lam in (([1.6, -0.64], 0.1, 1.0), ([0.9], 0.3, 0.5), ([0.5], 0.0, 0.0)):
        g, n = np.array(g), 60
        spikes = np.where(rng.random(n) < 0.1, rng.uniform(1, 3, n), 0.0)
        y = np.convolve(spikes, k.impulse(g, n))[:n] + 0.5 + sigma * rng.standard_normal(n)
        full, short = k.deconvolve(y, g, sigma, lam, iters=20000, zero=0.0), k.deconvolve(y, g, sigma, lam, iters=20, zero=0.0)
        # coordinate descent over all columns at once: the responses, the constant and the decay
        h = k.impulse(g, n)
        m = np.column_stack([np.concatenate([np.zeros(i), h[: n - i]]) for i in range(n)] + [np.ones(n), full["decay"]])
        weight = np.concatenate([np.full(n, lam * sigma), [0, 0]])
        x, left, squares = np.zeros(n + 2), y.copy(), (m * m).sum(axis=0)
        for _ in range(3000):
            for i in range(n + 2):
                new = max(0.0, x[i] + (m[:, i] @ left - weight[i]) / squares[i])
                left -= m[:, i] * (new - x[i])
                x[i] = new
        best = 0.5 * left @ left + weight @ x
        energy = 0.5 * y @ y
        for made in (full, short):
            r = y - made["c"] - made["b"] - made["c0"] * made["decay"]
            value = 0.5 * r @ r + lam * sigma * made["s"].sum()
            assert value - best <= (made["gap"] + 1e-9) * energy
        assert full["gap"] <= 1e-5 and full["kkt"] < 1e-3 and short["gap"] >= full["gap"]


def test_baseline_is_the_best_allowed():
    rng = np.random.default_rng(7)
    for _ in range(300):
        u, decay = rng.normal(size=12) + rng.choice([-1, 0, 1]), rng.uniform(0, 0.95) ** np.arange(12)
        b, c0 = k.baseline(u, decay)
        value = lambda b, c0: ((u - b - c0 * decay) ** 2).sum()  # noqa: B023, E731
        assert b >= 0 and c0 >= 0
        assert all(value(b, c0) <= value(x, z) + 1e-9 for x in (0.0, b + 0.01, max(0.0, b - 0.01), 0.5) for z in (0.0, c0 + 0.01, max(0.0, c0 - 0.01), 0.5))


def test_ar_coefficients_are_stable():
    rng = np.random.default_rng(3)
    x = np.zeros(4000)
    for t in range(2, 4000):
        x[t] = 1.2 * x[t - 1] - 0.4 * x[t - 2] + rng.standard_normal()
    g = k.ar_coefficients(x, 2)
    assert np.allclose(g, [1.2, -0.4], atol=0.1)
    assert np.abs(np.roots([1, *-g])).max() < 1


def test_hull_of_a_rectangle():
    y, x = np.mgrid[:3, :5]
    assert k.hull_area(y.ravel(), x.ravel()) == 15


def test_svd_is_orthonormal_and_ordered(spark):
    svd = factor.randomized_svd(fx.frames(spark, SF), 3).toPandas()
    for _, part in svd.groupby("session"):
        s = part[part.part == "S"].sort_values("k")["value"].to_numpy()
        assert (np.diff(s) <= 1e-9).all()
        v = part[part.part == "V"].pivot(index="index", columns="k", values="value").to_numpy()
        assert np.allclose(v.T @ v, np.eye(3), atol=1e-6)
    e = fx.frames(spark, SF).where("session = 'a'").toPandas()
    exact = np.linalg.svd(np.stack(e["px"]).astype(float), compute_uv=False)[:3]
    s = svd[(svd.session == "a") & (svd.part == "S")].sort_values("k")["value"].to_numpy()
    assert np.allclose(s, exact, rtol=2e-2)
    parts = factor.nndsvd(factor.randomized_svd(fx.frames(spark, SF), 3), 8)
    assert parts.agg(F.min("value")).first()[0] >= 0


def test_lowrank_modes_are_orthonormal(spark):
    basis = background.lowrank_basis(fx.movie(spark, SF), 8, 8, 3, 2).where("session = 'a' and mode >= 0").toPandas()
    v = basis.pivot(index=["y", "x"], columns="mode", values="value").to_numpy()
    assert np.allclose(v.T @ v, np.eye(3), atol=1e-8)


def test_lowrank_sample_spans_long_sessions(spark):
    # two pixels; the one of x = 1 moves only after frame 4,000; session b is short and starts late
    long = spark.range(5001).select(F.lit("a").alias("session"), F.col("id").alias("frame"))
    short = spark.range(7, 10).select(F.lit("b").alias("session"), F.col("id").alias("frame"))
    x = F.explode(F.array(F.lit(0), F.lit(1))).alias("x")
    v = F.when((F.col("x") == 1) & ((F.col("frame") >= 4000) | (F.col("session") == "b")), F.col("frame") % 7).otherwise(F.lit(1)).cast("double").alias("v")
    movie = long.unionByName(short).select("session", "frame", F.lit(0).alias("y"), x).select("*", v)
    frames = {s: [r.frame for r in background.sampled_frames(movie.where("x = 0"), 2).where(F.col("session") == s).sort("frame").collect()] for s in "ab"}
    assert frames == {"a": list(range(0, 5001, 3)), "b": [7, 9]}

    def values(rank):
        return {(r.session, r.mode, r.x): r.value for r in background.lowrank_basis(movie, 1, 2, rank, 2).collect()}

    late = lambda step: float(np.mean([f % 7 if f >= 4000 else 1 for f in range(0, 5001, step)]))
    alone, modes = values(0), values(1)
    assert alone["a", -1, 1] == pytest.approx(late(2)) and modes["a", -1, 1] == pytest.approx(late(3))
    assert modes["a", 0, 1] == pytest.approx(1) and modes["a", 0, 0] == pytest.approx(0)
    assert alone["b", -1, 0] == alone["b", -1, 1] == 1.0


def test_lasso_recovers_planted_weights():
    rng = np.random.default_rng(4)
    x = rng.standard_normal((500, 4))
    w = np.array([[1.0, 0.0, 0.5, 0.0], [0.0, 2.0, 0.0, 0.3]]).T
    y = x @ w
    assert np.allclose(tiles.lasso(x.T @ x, x.T @ y, 1e-6, 50), w, atol=1e-3)


def test_spatial_update_finds_planted_footprints(spark):
    rng = np.random.default_rng(5)
    c = np.abs(rng.standard_normal((2, 200)))
    rows = [("s", t, y, x, float(c[0, t] * (x < 3) + c[1, t] * (x >= 3))) for t in range(200) for y in range(2) for x in range(6)]
    movie = spark.createDataFrame(rows, "session string, frame long, y int, x int, v double")
    tr = spark.createDataFrame([("s", u, t, float(c[u, t])) for u in range(2) for t in range(200)], "session string, unit_id long, frame long, v double")
    bg = spark.createDataFrame([("s", t, 0.0) for t in range(200)], "session string, frame long, f double")
    cl = spark.createDataFrame([("s", 0, 0), ("s", 1, 0)], "session string, unit_id long, cluster_id long")
    mask = spark.createDataFrame([("s", 0, y, x) for y in range(2) for x in range(6)], "session string, cluster_id long, y int, x int")
    got = tiles.spatial_update(movie, tr, bg, cl, mask, min_std=0.01).where("a > 0.5").collect()
    assert {(r.unit_id, r.x) for r in got} == {(0, 0), (0, 1), (0, 2), (1, 3), (1, 4), (1, 5)}


def test_basins_partition_regions_with_a_peak(spark):
    a = fx.footprints(spark, SF)
    labels = segment.basin_label(a, 2, 0.3, 1.0, 8, 8)
    assert labels.count() == labels.select("session", "unit_id", "y", "x").distinct().count()
    assert labels.agg(F.min("basin")).first()[0] == 1
    # what is left out are whole regions without a peak
    key = ["session", "unit_id", "y", "x"]
    out = reject.regions(a, 4).join(labels.select(*key, "basin"), key, "left").groupBy("session", "unit_id", "region").agg(F.count("basin").alias("held"), F.count("*").alias("n"))
    assert out.where("held > 0 and held < n").isEmpty() and out.where("held > 0").count() > 0


def test_greedy_groups_are_partitions(spark):
    a = fx.footprints(spark, SF)
    c = tiles.centroids(a).join(reject.unit_sizes(a), ["session", "unit_id"])
    got = segment.centroid_merge(c, 0.4, 5, 9, 80).toPandas()
    assert not got.duplicated(["session", "unit_id"]).any()
    sizes = got.merge(c.toPandas(), on=["session", "unit_id"])
    groups = sizes.groupby(["session", "group_id"])
    assert all(len(g) == 1 or g["size"].sum() <= 80 for _, g in groups)
    clusters = tiles.cluster_units(a, 5, 0.35, 0.5).toPandas()
    assert len(clusters) == a.select("session", "unit_id").distinct().count()


def test_growth_cap_and_reindex_bijection(spark):
    a = fx.footprints(spark, SF)
    sizes = a.select("session", "unit_id", F.lit(4).alias("size")).distinct()
    assert tiles.growth_cap(a, sizes, 2).groupBy("session", "unit_id").count().agg(F.max("count")).first()[0] <= 8
    m = fx.movie(spark, SF)
    index = ingest.frame_index(m, m.where("frame % 3 = 0").select("session", "frame").distinct(), 10).toPandas()
    for _, part in index.sort_values("frame").groupby("session"):
        assert part["new_frame"].tolist() == list(range(len(part)))


def test_whole_table_queries_see_every_unit(spark, monkeypatch):
    from brightfield.plans import catalog, unit_queries

    rows = [("a", u, y, x, 1.0) for u, xs in ((5, (0, 1, 2)), (6, (3, 4, 5))) for y in range(8) for x in xs]
    planted = spark.createDataFrame([*rows, *[("a", u, 7 - y, 7, 1.0) for u in (9,) for y in range(2)]], "session string, unit_id long, y int, x int, a double")
    monkeypatch.setattr(unit_queries, "foot", lambda spark, sf: planted)
    got = {(r.unit_id, r.y, r.x) for r in catalog.QUERIES["e04_cut_seams_all"](spark, SF).collect()}
    assert got == {(u, y, x) for u, xs in ((5, (0, 1)), (6, (4, 5))) for y in range(8) for x in xs} | {(9, 6, 7), (9, 7, 7)}
    large = spark.createDataFrame([("a", 9, k // 8, k % 8, 1.0) for k in range(30)], planted.schema)
    wide = planted.where("unit_id <> 9").unionByName(large)
    monkeypatch.setattr(unit_queries, "foot", lambda spark, sf: wide)
    (row,) = catalog.QUERIES["e07_export_summary_kept"](spark, SF).collect()
    assert (row.units, row.mean_size) == (1, 30.0) and row.retained_percent == pytest.approx(100 / 3, abs=1e-6)


@pytest.mark.parametrize("n", [1, 17])
def test_merge_does_not_depend_on_partitions(spark, n):
    a, t = fx.footprints(spark, SF), fx.traces(spark, SF)
    want = sorted(map(tuple, merge.merge_groups(a, t, 0.5, 0.3, 64).collect()))
    assert sorted(map(tuple, merge.merge_groups(a.repartition(n), t.repartition(n), 0.5, 0.3, 64).collect())) == want


def test_empty_inputs(spark):
    a, t, m = fx.footprints(spark, SF).limit(0), fx.traces(spark, SF).limit(0), fx.movie(spark, SF).limit(0)
    assert traces.extract_traces(m, a).count() == 0
    assert merge.merge_groups(a, t).count() == 0
    assert reject.trace_snr(t).count() == 0
    assert cleanup.trim_halo(a).count() == 0
    assert traces.temporal_update(t).count() == 0


def test_flat_and_short_traces(spark):
    t = spark.createDataFrame([("s", 1, f, 2.0) for f in range(5)] + [("s", 2, 0, 1.0)], "session string, unit_id long, frame long, v double")
    assert {r.snr for r in reject.trace_snr(t).collect()} == {0.0}
    assert {r.skew for r in reject.trace_skew(t).collect()} == {0.0}
    assert {r.drift for r in reject.drift_ratio(t).collect()} == {0.0}
    assert traces.noise_psd(t).count() == 2


@pytest.mark.parametrize("shape", [(8, 8), (9, 8), (8, 9), (7, 15), (16, 6)])
def test_shift_from_half_spectra(shape):
    """Against the upsampled correlation over whole spectra, at each point of the fine grid around its peak."""
    rng = np.random.default_rng(sum(shape))
    for _ in range(20):
        a = rng.normal(size=shape)
        b = k.warp(a, *rng.uniform(-2, 2, 2)) + 0.1 * rng.normal(size=shape)
        got = k.phase_shift(a, b)
        cross = np.fft.fft2(a) * np.conj(np.fft.fft2(b))
        cross /= np.maximum(np.abs(cross), 1e-12 * np.abs(cross).max())
        ky, kx = np.fft.fftfreq(shape[0]), np.fft.fftfreq(shape[1])
        value = lambda y, x: abs((np.exp(2j * np.pi * (ky[:, None] * y + kx[None, :] * x)) * cross).sum())  # noqa: B023, E731
        around = [value(got[0] + i / 100, got[1] + j / 100) for i in range(-3, 4) for j in range(-3, 4)]
        assert value(*got) >= max(around) - 1e-9
        coarse = np.abs(np.fft.ifft2(cross)).max() * cross.size
        assert value(*got) >= coarse - 1e-9


def test_deconvolution_of_many_windows(spark, monkeypatch):
    """Windows that are worked on together, of several lengths and over the ends of batches, come out as one by one, and faster."""
    import time

    from brightfield.operators import traces as tr

    rng = np.random.default_rng(5)
    rows = [("a", u, t, 0, t, 1, float(v)) for u in range(40) for t, v in enumerate(rng.exponential(2.0, 20 + u % 3) * (rng.random(20 + u % 3) < 0.5))]
    monkeypatch.setattr(tr, "WINDOW_VALUES", 100)
    df = spark.createDataFrame(rows, "session string, unit_id long, frame long, chunk long, local long, n_chunks long, v double").repartition(3)
    got = {(r.unit_id, r.frame): r for r in tr.deconvolve_chunks(df, iters=300).collect()}
    assert len(got) == len(rows)
    for u in range(40):
        y = np.array([r[-1] for r in rows if r[1] == u])
        g = k.ar_coefficients(y - y.mean(), 2)
        alone = k.deconvolve(y, g, float(np.sqrt(k.power(y)[np.arange(len(y) // 2 + 1) / len(y) > 0.25].mean() / len(y))), 1e-2, 300)
        assert np.allclose([got[u, t].c for t in range(len(y))], alone["c"], atol=1e-9) and np.allclose([got[u, t].s for t in range(len(y))], alone["s"], atol=1e-9)
        assert np.allclose(got[u, 0].g, g) and abs(got[u, 0].gap - alone["gap"]) < 1e-9
        assert np.allclose([got[u, t].c0 for t in range(len(y))], alone["c0"] * alone["decay"], atol=1e-9)
    y = rng.exponential(2.0, (400, 20)) * (rng.random((400, 20)) < 0.5)
    g = np.tile([0.5, 0.1], (400, 1))
    began = time.perf_counter()
    k.deconvolve_all(y, g, np.full(400, 0.3), 1e-2, 300)
    together = time.perf_counter() - began
    for a, b in zip(y, g, strict=True):
        k.deconvolve(a, b, 0.3, 1e-2, 300)
    assert together < (time.perf_counter() - began - together) / 3
