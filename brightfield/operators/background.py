"""Crop and background."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brightfield.operators.arrays import SMALL_ROWS, as_frames, as_pixels, is_frames, lists, pixel_sums, small, stacks, with_image
from brightfield.operators.base import FRAME, PIXEL
from brightfield.operators.blocks import ARRAY_ROWS, TILE_PIXELS, summed
from brightfield.operators.stencil import gaussian_image, stencil
from brightfield.sources.storage import materialize

#: Most frames of a session that enter the decomposition: their Gram matrix is solved in one task.
MOST_FRAMES = 2000


def crop_window(h: int, w: int, factor: float, yoff: int = 0, xoff: int = 0, least: int = 10) -> tuple[int, int, int, int]:
    half = max(least, int(min(h, w) * factor / 2))
    cy, cx = h // 2 + yoff, w // 2 + xoff
    return max(0, cy - half), min(h, cy + half), max(0, cx - half), min(w, cx + half)


def crop_square(movie: DataFrame, h: int, w: int, factor: float, yoff: int = 0, xoff: int = 0, least: int = 10) -> DataFrame:
    """The window of half side max(least, int(min(h, w) * factor / 2)) around the shifted centre, clipped to the image."""
    y0, y1, x0, x1 = crop_window(h, w, factor, yoff, xoff, least)
    return movie.where((F.col("y") >= y0) & (F.col("y") < y1) & (F.col("x") >= x0) & (F.col("x") < x1))


def mask_circle(movie: DataFrame, h: int, w: int, factor: float) -> DataFrame:
    """Zero outside the inscribed circle's share."""
    r = max(1.0, factor * min(h, w) / 2)
    away = (F.col("y") - (h - 1) / 2) ** 2 + (F.col("x") - (w - 1) / 2) ** 2
    return movie.withColumn("v", F.when(F.sqrt(away) <= r, F.col("v")).otherwise(F.lit(0.0)))


def ring(radius: float, width: float) -> list[tuple[int, int, float]]:
    outer, inner = float(radius), max(1.0, float(radius) - float(width))
    r = math.ceil(outer)
    found = [(dy, dx) for dy in range(-r, r + 1) for dx in range(-r, r + 1) if inner <= math.hypot(dy, dx) <= outer] or [(0, 0)]
    return [(dy, dx, 1.0 / len(found)) for dy, dx in found]


def ring_background(movie: DataFrame, h: int, w: int, radius: float = 12, width: float = 4, n: int = 1000, clip: bool = True) -> DataFrame:
    """v minus the ring average of the mean image of the first n frames, no less than 0 if clipped."""
    first = movie.where(F.col("frame") < n)
    if is_frames(movie):
        sums = pixel_sums(first, h, w, lambda stack: [stack, np.full((h, w), float(len(stack)))], ["v", "n"])
        mean = sums.select(*PIXEL, (F.col("v") / F.col("n")).alias("v"))
    else:
        mean = first.groupBy(*PIXEL).agg(F.avg("v").alias("v"))
    low = stencil(mean, ring(radius, width), "sum", "reflect", h, w)
    if is_frames(movie):
        left = lambda v, low: F.greatest(v - low, F.lit(0.0)) if clip else v - low
        return with_image(movie, low, h, w, "low").select(*(F.zip_with(F.col("px").cast("array<double>"), "low", left).alias("px") if c == "px" else c for c in movie.columns))
    left = F.col("v") - F.col("low")
    return movie.join(low.withColumnRenamed("v", "low"), PIXEL).select(*FRAME, "y", "x", (F.greatest(left, F.lit(0.0)) if clip else left).alias("v"))


def sampled_frames(movie: DataFrame, stride: int, most: int | None = MOST_FRAMES) -> DataFrame:
    """Every stride-th frame of a session from its first to its last; the stride grows until no more than `most` frames are left (None: it stays)."""
    first, last = F.min("frame").alias("first"), F.max("frame").alias("last")
    step = F.lit(stride).cast("long")
    if most is not None:
        step = F.greatest(step, F.ceil((F.col("last") - F.col("first") + 1) / most))
    span = movie.groupBy("session").agg(first, last).select("session", "first", step.alias("step"))
    return movie.join(F.broadcast(span), "session").where((F.col("frame") - F.col("first")) % F.col("step") == 0).drop("first", "step")


#: Frames on a side of a block of the Gram matrix (512 KB).
GRAM_BLOCK = 256


def lowrank_basis(movie: DataFrame, h: int, w: int, rank: int, stride: int = 1, sigma: float = 0.0) -> DataFrame:
    """(session, mode, y, x, value): mode -1 is the mean image, modes 0..rank-1 are orthonormal spatial modes by falling energy.

    Every stride-th frame, optionally smoothed. For modes the stride grows with the session, so that MOST_FRAMES
    at most are spread over all of it; a mean image alone takes every stride-th frame. The sampled frames are dealt out by blocks of
    pixels; a task adds up the Gram matrix of all its blocks and passes on the upper triangle in blocks of frames, which meet in two
    steps. The eigenvectors (a bounded problem per session) weight the frames to modes, in sums that tasks make where frames lie.
    """
    sample = sampled_frames(movie, stride, MOST_FRAMES if rank > 0 else None)
    if rank <= 0 and not is_frames(movie) and sigma <= 0:
        return sample.groupBy(*PIXEL).agg(F.avg("v").alias("value")).select("session", F.lit(-1).alias("mode"), "y", "x", "value")
    frames = sample.select("session", "frame", "px") if is_frames(movie) else as_frames(sample.select("session", "frame", "y", "x", "v"), h, w).select("session", "frame", "px")
    if sigma > 0:
        frames = gaussian_image(frames.withColumn("h", F.lit(h)).withColumn("w", F.lit(w)), sigma, h, w).select("session", "frame", "px")
    frames = materialize(frames, "basis-frames", ARRAY_ROWS)
    counts = frames.groupBy("session").agg(F.count("*").alias("n"))
    image = pixel_sums(frames, h, w, lambda stack: [stack], ["s"]).join(F.broadcast(counts), "session").select("session", F.lit(-1).alias("mode"), "y", "x", (F.col("s") / F.col("n")).alias("value"))
    if rank <= 0:
        return image
    if counts.where(F.col("n") > MOST_FRAMES).count():
        raise ValueError(f"a session has more than {MOST_FRAMES} rows for its sampled frames; frame numbers must be different")

    def strips(batches):
        for batch in batches:
            for session, frame, px in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                x = px.values.to_numpy(zero_copy_only=False)
                n = -(-len(x) // TILE_PIXELS)
                parts = pa.array([x[i * TILE_PIXELS : (i + 1) * TILE_PIXELS] for i in range(n)], type=pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([pa.array([session] * n), pa.array([frame] * n, type=pa.int64()), pa.array(range(n), type=pa.int32()), parts], names=["session", "frame", "pb", "x"])

    def gram(batches):
        now, rows, total = None, [], None

        def add():
            x = np.stack(rows)
            x -= x.mean(axis=0)
            return x @ x.T if total is None else total + x @ x.T

        def blocks(session):
            for i in range(0, len(total), GRAM_BLOCK):
                for j in range(i, len(total), GRAM_BLOCK):
                    yield pa.RecordBatch.from_arrays([pa.array([session]), pa.array([i], type=pa.int32()), pa.array([j], type=pa.int32()), lists(total[i : i + GRAM_BLOCK, j : j + GRAM_BLOCK].reshape(1, -1))], names=["session", "i", "j", "g"])

        for batch in batches:
            for session, pb, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if (session, pb) != now:
                    if now is not None:
                        total, rows = add(), []
                        if session != now[0]:
                            yield from blocks(now[0])
                            total = None
                    now = session, pb
                rows.append(x.values.to_numpy(zero_copy_only=False))
        if now is not None:
            total = add()
            yield from blocks(now[0])

    n = int(frames.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = frames.mapInArrow(strips, "session string, frame long, pb int, x array<double>").repartition(n, "session", "pb").sortWithinPartitions("session", "pb", "frame")
    total = summed(dealt.select("session", "pb", "x").mapInArrow(gram, "session string, i int, j int, g array<double>"), ["session", "i", "j"])

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        size = int(pdf["i"].max()) + round(len(pdf.loc[(pdf["i"] == pdf["i"].max()) & (pdf["j"] == pdf["i"].max()), "g"].iloc[0]) ** 0.5)
        g = np.zeros((size, size))
        for i, j, part in zip(pdf["i"], pdf["j"], pdf["g"], strict=True):
            part = part.reshape(min(GRAM_BLOCK, size - i), -1)
            g[i : i + len(part), j : j + part.shape[1]] = part
            g[j : j + part.shape[1], i : i + len(part)] = part.T
        values, vectors = np.linalg.eigh(g)
        top = np.argsort(values)[::-1][:rank]
        top = top[values[top] > 1e-12 * max(values.max(), 1e-300)]
        weights = vectors[:, top] / np.sqrt(values[top])
        weights -= weights.mean(axis=0)  # centred frames have no part along their mean
        return pd.DataFrame({"session": pdf["session"].iloc[0], "place": np.arange(size, dtype=np.int64), "weights": list(weights)})

    solved = total.groupBy("session").applyInPandas(solve, "session string, place long, weights array<double>")
    # a frame's place in its session, of MOST_FRAMES at most
    place = frames.select("session", "frame").withColumn("place", F.row_number().over(W.partitionBy("session").orderBy("frame")).cast("long") - 1)
    weights = place.join(solved, ["session", "place"]).select("session", "frame", "weights")
    weights = materialize(weights, "basis-weights", compact=True)
    largest = weights.agg(F.max(F.size("weights"))).first()[0] or 0
    names = [f"m{i}" for i in range(largest)]
    if not names:
        return image

    def moments(stack, given):
        g = np.array([[*r, *[0.0] * (largest - len(r))] for r in given.tolist()])
        return [np.tensordot(g[:, i], stack, axes=1) for i in range(largest)]

    made = pixel_sums(frames.join(small(weights), ["session", "frame"]), h, w, moments, names, ("weights",))
    raw = made.select("session", "y", "x", F.posexplode(F.array(*names)).alias("mode", "value"))
    held = weights.groupBy("session").agg(F.max(F.size("weights")).alias("n"))
    # a mode's largest value is positive; sessions with fewer modes have no others
    raw = raw.join(F.broadcast(held), "session").where("mode < n")
    sign = raw.groupBy("session", "mode").agg(F.signum(F.max_by("value", F.struct(F.abs("value"), -F.col("y"), -F.col("x")))).alias("sign"))
    return image.unionByName(raw.join(F.broadcast(sign), ["session", "mode"]).select("session", "mode", "y", "x", (F.col("value") * F.col("sign")).alias("value")))


def lowrank_subtract(movie: DataFrame, basis: DataFrame, clip: bool = True) -> DataFrame:
    """v minus the mean image and the frame's projection on the modes.

    Frame rows are projected one by one while the basis is small (SMALL_ROWS values), which every task then
    holds, and pixel rows are gathered to frames for it; otherwise pixels are joined with the mean image and the modes as an array each.
    """
    if basis.count() <= SMALL_ROWS:
        if is_frames(movie):
            return _project(movie, basis, clip)
        size = basis.agg(F.max("y") + 1, F.max("x") + 1).first()
        return as_pixels(_project(as_frames(movie.select(*FRAME, "y", "x", "v"), *size), basis, clip)) if size[0] else movie.limit(0)
    rows = as_pixels(movie) if is_frames(movie) else movie
    mean = basis.where("mode = -1").select(*PIXEL, F.col("value").alias("mean"))
    modes = basis.where("mode >= 0").groupBy(*PIXEL).agg(F.sort_array(F.collect_list(F.struct("mode", "value"))).alias("s")).select(*PIXEL, F.col("s.mode").alias("mode"), F.col("s.value").alias("value"))
    centred = rows.join(mean, PIXEL).select(*FRAME, "y", "x", (F.col("v") - F.col("mean")).alias("c")).join(modes, PIXEL, "left")
    # one row a frame and mode, from sums that combine before the shuffle
    scores = centred.select(*FRAME, "c", F.explode(F.arrays_zip("mode", "value")).alias("e")).groupBy(*FRAME, F.col("e.mode").alias("mode")).agg(F.sum(F.col("c") * F.col("e.value")).alias("score"))
    scores = scores.groupBy(*FRAME).agg(F.transform(F.sort_array(F.collect_list(F.struct("mode", "score"))), lambda s: s["score"]).alias("score"))
    fit = F.aggregate(F.zip_with("score", "value", lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    left = F.col("c") - F.coalesce(fit, F.lit(0.0))
    return centred.join(scores, FRAME, "left").select(*FRAME, "y", "x", (F.greatest(left, F.lit(0.0)) if clip else left).alias("v"))


def _project(movie: DataFrame, basis: DataFrame, clip: bool) -> DataFrame:
    table = basis.select("session", "mode", "y", "x", F.col("value").cast("double").alias("value")).toArrow().to_pandas()
    held = {}
    for session, part in table.groupby("session"):
        wide = part.pivot(index=["y", "x"], columns="mode", values="value").sort_index()
        held[session] = (wide[-1].to_numpy(), wide.drop(columns=-1).to_numpy())
    given = movie.sparkSession.sparkContext.broadcast(held)
    keys = [c for c in movie.columns if c != "px"]
    place = keys.index("session")
    schema = T.StructType([*(movie.schema[c] for c in keys), T.StructField("px", T.ArrayType(T.DoubleType()))])

    def run(batches):
        known = given.value
        for batch in batches:
            session = np.array(batch.column(place).to_pylist(), dtype=object)
            for s in sorted(set(session.tolist()) & set(known)):
                mean, modes = known[s]
                for part, stack in stacks(batch.filter(pa.array(session == s)), 1, len(mean)):
                    c = stack[:, 0] - mean
                    c = c - c @ modes @ modes.T
                    yield pa.RecordBatch.from_arrays([*part.columns[:-1], lists(np.maximum(c, 0.0) if clip else c)], names=[*keys, "px"])

    return movie.select(*keys, F.col("px").cast("array<double>").alias("px")).mapInArrow(run, schema)


def background_qc(before: DataFrame, after: DataFrame) -> DataFrame:
    """Mean images before, after and removed, and the first winsorised to its 2nd and 98th percentile."""
    a = before.groupBy(*PIXEL).agg(F.avg("v").alias("before"))
    b = after.groupBy(*PIXEL).agg(F.avg("v").alias("after"))
    both = a.join(b, PIXEL)
    cut = both.groupBy("session").agg(F.percentile("before", F.lit(0.02)).alias("lo"), F.percentile("before", F.lit(0.98)).alias("hi"))
    return both.join(cut, "session").select(*PIXEL, "before", "after", (F.col("before") - F.col("after")).alias("removed"), F.least(F.greatest("before", "lo"), F.col("hi")).alias("winsorised"))
