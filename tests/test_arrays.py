"""Frame rows against pixel rows, kernels against plain loops, plans without a shuffle."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from brightfield.functions import images
from brightfield.functions import kernels as k
from brightfield.operators import arrays, background, ingest, motion, reject, segment, stencil, traces

H, W = 6, 9


@pytest.fixture(scope="module")
def movie(spark):
    rng = np.random.default_rng(0)
    rows = [(s, f, H, W, [float(round(v, 3)) for v in rng.normal(5, 2, H * W)]) for s in "ab" for f in range(12 if s == "a" else 5)]
    return spark.createDataFrame(rows, "session string, frame long, h int, w int, px array<double>").repartition(3).cache()


def plain(df):
    rows = arrays.as_pixels(df) if arrays.is_frames(df) else df
    return {(r.session, r.frame, r.y, r.x): r.v for r in rows.collect()}


OPERATORS = {
    "stencil": lambda m: stencil.stencil(m, [(-1, 2, 1.0), (0, 0, 2.0), (1, -1, 0.5)], "mean", "ignore", H, W),
    "median": lambda m: stencil.median_denoise(m, 3, H, W),
    "gaussian": lambda m: stencil.gaussian_denoise(m, 5, H, W),
    "wide gaussian": lambda m: stencil.gaussian_image(m, 3.0, H, W),
    "bilateral": lambda m: stencil.bilateral_denoise(m, 3, H, W, 75.0, 1.0),
    "diffusion": lambda m: stencil.anisotropic_denoise(m, 2, 0.5, 0.1, H, W),
    "tophat": lambda m: stencil.tophat_background(m, 2, H, W),
    "uniform": lambda m: stencil.uniform_background(m, 4, H, W),
    "minimum": lambda m: stencil.min_subtract(m, H, W),
    "preprocess": lambda m: stencil.preprocess(m, H, W, "denoise-background", "tophat", 2, 3),
    "ring": lambda m: background.ring_background(m, H, W, 2, 1, 7),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_both_forms_agree(movie, name):
    a, b = plain(OPERATORS[name](movie)), plain(OPERATORS[name](arrays.as_pixels(movie)))
    assert a.keys() == b.keys() and len(a) == 17 * H * W
    assert all(abs(a[i] - b[i]) < 1e-9 for i in a)


@pytest.mark.parametrize("name", ["stencil", "median", "gaussian", "wide gaussian", "bilateral", "diffusion", "tophat", "uniform"])
def test_frame_rows_are_not_shuffled(movie, name):
    plan = OPERATORS[name](movie)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "rangepartitioning" not in plan


@pytest.mark.parametrize("border", stencil.BORDERS)
@pytest.mark.parametrize("how", ["sum", "mean", "min", "max", "median"])
def test_neighbourhood_against_loops(border, how):
    rng = np.random.default_rng(1)
    image = rng.normal(size=(5, 7))
    offsets = [(dy, dx, float(rng.uniform(0.5, 2))) for dy in range(-3, 4) for dx in range(-4, 5) if rng.random() < 0.4]

    def place(c, n):
        if border == "reflect":
            c = c % (2 * n)
            return c if c < n else 2 * n - 1 - c
        if border == "reflect101":
            c = c % (2 * n - 2)
            return c if c < n else 2 * n - 2 - c
        return min(max(c, 0), n - 1) if border == "replicate" else (c if 0 <= c < n else None)

    want = np.zeros_like(image)
    for y in range(5):
        for x in range(7):
            near = [(g, image[place(y + dy, 5), place(x + dx, 7)]) for dy, dx, g in offsets if place(y + dy, 5) is not None and place(x + dx, 7) is not None]
            v = [b for _, b in near]
            want[y, x] = {"sum": sum(g * b for g, b in near), "mean": sum(g * b for g, b in near) / sum(g for g, _ in near), "min": min(v), "max": max(v), "median": float(np.median(v))}[how]
    assert np.allclose(images.neighbourhood(np.stack([image, -image]), offsets, how, border)[0], want)


def test_box_median_against_the_general_one():
    stack = np.random.default_rng(2).normal(size=(2, 9, 6))
    for ry, rx in ((1, 1), (2, 1), (3, 4)):
        box = [(dy, dx, 1.0) for dy in range(-ry, ry + 1) for dx in range(-rx, rx + 1)]
        for border in ("replicate", "reflect"):
            wide = images.padded(stack, ry, rx, border)
            want = np.median(np.stack([wide[:, ry + dy : ry + dy + 9, rx + dx : rx + dx + 6] for dy, dx, _ in box]), axis=0)
            assert (images.neighbourhood(stack, box, "median", border) == want).all()


def test_shift_of_frame_rows(spark, movie):
    moves = spark.createDataFrame([(s, f, 0.25 * f - 1, 2.0 - 0.5 * f) for s in "ab" for f in range(10)], "session string, frame long, dy double, dx double")
    frames, pixels = plain(motion.apply_shift(movie, moves, H, W)), plain(motion.apply_shift(arrays.as_pixels(movie), moves, H, W))
    assert len(frames) == 15 * H * W and all(abs(frames[i] - pixels[i]) < 1e-9 for i in frames)
    given = plain(movie)
    # frame 4 moves by (0, 0), frame 8 of session a by (1, -2)
    assert all(abs(frames["a", 4, y, x] - given["a", 4, y, x]) < 1e-9 for y in range(H) for x in range(W))
    assert all(frames["a", 8, y, x] == (pytest.approx(given["a", 8, y - 1, x + 2]) if y >= 1 and x + 2 < W else 0) for y in range(H) for x in range(W))
    plan = motion.apply_shift(movie, moves, H, W)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan


def footprints(spark):
    rows = [(s, u, y, x, 1.0 + y + 0.1 * x) for s in "abc" for u in (3, 1, 2) for y in range(u, u + 3) for x in range(2 * u, 2 * u + 2)]
    return spark.createDataFrame(rows, "session string, unit_id long, y int, x int, a double")


def test_traces_of_both_forms(spark, movie, monkeypatch):
    a = footprints(spark)
    get = lambda m: {(r.session, r.unit_id, r.frame): r.v for r in traces.extract_traces(m, a).collect()}
    frames, pixels = get(movie), get(arrays.as_pixels(movie))
    assert frames.keys() == pixels.keys() and len(frames) == 17 * 3 and all(abs(frames[i] - pixels[i]) < 1e-9 for i in frames)
    monkeypatch.setattr(arrays, "SMALL_ROWS", 2)  # too many weights to hand out
    joined = get(movie)
    assert all(abs(frames[i] - joined[i]) < 1e-9 for i in frames)


def test_noise_and_modes_of_both_forms(spark, movie, monkeypatch):
    pixels = arrays.as_pixels(movie)
    b = pixels.groupBy("session", "y", "x").agg(F.avg("v").alias("b"))
    f = arrays.frame_means(movie).withColumnRenamed("v", "f")
    assert {(r.session, r.frame): round(r.f, 9) for r in f.collect()} == {(r.session, r.frame): round(r.v, 9) for r in arrays.frame_means(pixels).collect()}
    get = lambda m: {(r.session, r.y, r.x): r.sn for r in reject.noise_map(m, b, f, H, W).collect()}
    one, two = get(movie), get(pixels)
    assert one.keys() == two.keys() and all(abs(one[i] - two[i]) < 1e-6 for i in one)
    basis = background.lowrank_basis(pixels, H, W, 2).cache()
    one, two = plain(background.lowrank_subtract(movie, basis, False)), plain(background.lowrank_subtract(pixels, basis, False))
    assert one.keys() == two.keys() and all(abs(one[i] - two[i]) < 1e-9 for i in one)
    # what is left has no part along a mode
    modes = {(r.session, r.mode, r.y, r.x): r.value for r in basis.collect()}
    assert all(abs(sum(one[s, f, y, x] * modes[s, 0, y, x] for y in range(H) for x in range(W))) < 1e-8 for s, f in (("a", 3), ("b", 1)))


def test_incomplete_images_are_refused(movie):
    with pytest.raises(Exception, match="not complete"):
        stencil.median_denoise(arrays.as_pixels(movie).where("x <> 1 or frame <> 2"), 3, H, W).collect()


def test_patches_equal_whole_images():
    """Smoothing and peaks within a footprint's surroundings are those of the whole image, also at the border and with a kernel wider than the image."""
    rng = np.random.default_rng(3)
    for sigma in (0.0, 0.8, 4.0):
        for _ in range(20):
            h, w = int(rng.integers(4, 30)), int(rng.integers(4, 30))
            n = int(rng.integers(1, 8))
            y, x = np.unravel_index(np.sort(rng.choice(min(h, 9) * w, n, replace=False)), (min(h, 9), w))
            a = rng.uniform(0.1, 2, n).round(1)
            dense = np.zeros((h, w))
            dense[y, x] = a
            taps = stencil.gaussian_taps(sigma)
            wide = dense
            for axis in (0, 1):
                at = images.mirrored(np.arange(wide.shape[axis])[:, None] + np.arange(len(taps)) - len(taps) // 2, wide.shape[axis])
                wide = np.moveaxis((np.moveaxis(wide, axis, 0)[at] * np.array(taps).reshape(1, -1, 1)).sum(1), 0, axis)
            patch = images.Patch(y, x, a, taps, 2, h, w)
            yy, xx = np.mgrid[patch.y0 : patch.y0 + patch.v.shape[0], patch.x0 : patch.x0 + patch.v.shape[1]]
            assert np.allclose(patch.v, wide[yy, xx])
            outside = wide.copy()
            outside[yy, xx] = 0
            assert np.allclose(outside, 0)


def flooded(y, x, v, peaks):
    """Flooding by the rule: of all labelled pixels with an open neighbour the greatest goes next, the earliest labelled of equal ones."""
    value = dict(zip(zip(y.tolist(), x.tolist(), strict=True), v.tolist(), strict=True))
    starts = sorted(zip(peaks[0].tolist(), peaks[1].tolist(), strict=True))
    name = {p: k for k, p in enumerate(starts, 1)}
    shore = list(starts)
    while shore:
        best = max(shore, key=lambda p: (value[p], -list(name).index(p)))
        shore.remove(best)
        i, j = best
        for q in ((i - 1, j), (i, j - 1), (i, j + 1), (i + 1, j)):
            if q in value and q not in name:
                name[q] = name[best]
                shore.append(q)
    return [name.get(p, 0) for p in value]


def test_basins_are_flooded():
    """Random footprints of few values, full of plateaus and ridges, in one piece or several, against plain flooding; and by hand."""
    y, x = (c.ravel() for c in np.mgrid[:1, :9])
    v = np.array([1, 3, 2, 1, 2, 4, 3, 1, 1.5])
    assert images.basins(y, x, v, (np.array([0, 0]), np.array([1, 5]))).tolist() == [1, 1, 1, 2, 2, 2, 2, 2, 2]
    assert images.basins(y, x, np.ones(9), (np.array([0, 0]), np.array([0, 8]))).tolist() == [1] * 5 + [2] * 4
    assert images.basins(y, x, v, (np.zeros(0, int), np.zeros(0, int))).tolist() == [0] * 9
    rng = np.random.default_rng(9)
    for _ in range(150):
        h, w = int(rng.integers(1, 9)), int(rng.integers(1, 9))
        held = np.flatnonzero(rng.random(h * w) < rng.choice([0.6, 1.0]))
        if not len(held):
            continue
        y, x = held // w, held % w
        v = rng.integers(1, rng.choice([2, 4, 50]), len(held)).astype(float)
        at = np.sort(rng.choice(len(held), min(len(held), int(rng.integers(1, 4))), replace=False))
        assert images.basins(y, x, v, (y[at], x[at])).tolist() == flooded(y, x, v, (y[at], x[at]))


def test_peaks_of_several_settings(spark):
    a = footprints(spark)
    got = segment.peak_search(a, [(1, 0.0, 0.0), (2, 0.5, 1.0)], H, W, skip=2).collect()
    for r in got:
        each = segment.local_peaks(a.where("unit_id <> 2"), r.min_distance, r.threshold_rel, r.sigma, H, W).where(F.col("session") == r.session).count()
        assert r.mean_peaks == each / 2
    assert sum(r.best for r in got) == 3


def test_downsampling_then_trimming(spark):
    """Two files of 10 and 7 frames, every third kept: 4 + 3 frames; places 1 to 5 of those, of which 40 % stay."""
    rows = [("s", f // 10, f, y, x, float(f)) for f in range(17) for y in range(2) for x in range(2)]
    movie = spark.createDataFrame(rows, "session string, file long, frame long, y int, x int, v double")
    small = ingest.stride_downsample(movie, 3, 2, 2, 2, 2)
    assert sorted((r.frame, r.original_frame, r.v) for r in small.collect()) == [(i, f, float(f)) for i, f in enumerate([0, 3, 6, 9, 10, 13, 16])]
    cut = ingest.trim_frames(small, 1, 6, 40.0)
    assert sorted((r.frame, r.original_frame) for r in cut.collect()) == [(0, 3), (1, 6)]
    # a range behind the end is clamped to nothing and then ignored; percentages are cut down
    assert ingest.trim_frames(small, 50, 60, 100.0).count() == 7
    assert ingest.trim_frames(small, 5, 3, 50.0).count() == 3
    assert ingest.trim_frames(small, -4, 2, 100.0).count() == 2


def test_ar_of_a_trace_with_a_baseline_and_a_tail():
    rng = np.random.default_rng(3)
    x = np.zeros(2400)
    for t in range(2, 2400):
        x[t] = 1.2 * x[t - 1] - 0.5 * x[t - 2] + rng.standard_normal()
    g = k.ar_coefficients(x, 2)
    assert np.allclose(g, [1.2, -0.5], atol=0.08)
    assert np.allclose(k.ar_coefficients(x + 1000.0, 2), g, atol=1e-6)
    assert np.allclose(k.ar_coefficients(np.concatenate([x[:2000], x[:2000].mean() + np.zeros(0)]), 2), k.ar_coefficients(x[:2000], 2))
    tail = np.concatenate([x[:2000] - x[:2000].mean(), np.tile([1.0, -1.0], 200)])
    assert np.allclose(k.ar_coefficients(tail, 2), k.ar_coefficients(tail[:2000], 2), atol=1e-6)
    assert k.ar_coefficients(np.full(50, 3.3), 2).tolist() == pytest.approx([0.9, 0.81])
    assert k.ar_coefficients(np.zeros(0), 1).tolist() == [0.9]


def test_components_against_flooding():
    rng = np.random.default_rng(5)
    for connectivity in (4, 8):
        for _ in range(30):
            mask = rng.random((7, 11)) < 0.5
            mask[0, 0] = True
            y, x = np.nonzero(mask)
            where = {(a, b): i for i, (a, b) in enumerate(zip(y.tolist(), x.tolist(), strict=True))}
            want = [-1] * len(y)
            for i in range(len(y)):
                todo = [i] if want[i] < 0 else []
                while todo:
                    j = todo.pop()
                    if want[j] < 0:
                        want[j] = i
                        todo += [where[p] for dy in (-1, 0, 1) for dx in (-1, 0, 1) if (dy == 0 or dx == 0 or connectivity == 8) and (p := (y[j] + dy, x[j] + dx)) in where]
            assert images.components(y, x, connectivity).tolist() == want


def test_chosen_units(spark):
    scores = spark.createDataFrame([(s, u, (u * 7) % 5, float((u * 3) % 7)) for s in "ab" for u in range(20)], "session string, unit_id long, size long, snr double")
    pick = lambda mode, seed=0, n=3: {s: [r.unit_id for r in traces.choose_units(scores.repartition(n), 4, mode, seed).where(F.col("session") == s).sort("unit_id").collect()] for s in "ab"}
    units = range(20)
    for mode, key in (("largest", lambda u: (-(u * 7 % 5), u)), ("smallest", lambda u: (u * 7 % 5, u)), ("best_snr", lambda u: (-(u * 3 % 7), u)), ("worst_snr", lambda u: (u * 3 % 7, u))):
        assert pick(mode)["a"] == sorted(sorted(units, key=key)[:4])
    assert pick("random", 1) == pick("random", 1, 7) != pick("random", 2)
    assert len(pick("random")["b"]) == 4
