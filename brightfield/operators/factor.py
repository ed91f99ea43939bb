"""Factor initialisation: decomposition of the movie into footprints and traces."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from brightfield.functions.kernels import power
from brightfield.operators import blocks
from brightfield.operators.arrays import is_frames, small
from brightfield.operators.base import FRAME, PIXEL, UNIT
from brightfield.sources.storage import arrow_rows, discard, materialize


def shift_nonneg(movie: DataFrame, every: int = 1) -> DataFrame:
    """Every n-th frame, minus the session's least value, plus 1e-6; NaN counts as 0. Frame rows or pixel rows."""
    if is_frames(movie):
        clean = movie.where(F.col("frame") % every == 0).withColumn("px", F.transform(F.col("px").cast("array<double>"), lambda v: F.nanvl(F.coalesce(v, F.lit(0.0)), F.lit(0.0))))
        low = clean.groupBy("session").agg(F.min(F.array_min("px")).alias("low"))
        return clean.join(small(low), "session").withColumn("px", F.transform("px", lambda v: v - F.col("low") + 1e-6)).drop("low")
    clean = movie.where(F.col("frame") % every == 0).withColumn("v", F.nanvl(F.coalesce("v", F.lit(0.0)), F.lit(0.0)))
    low = clean.groupBy("session").agg(F.min("v").alias("low"))
    return clean.join(low, "session").select(*FRAME, "y", "x", (F.col("v") - F.col("low") + 1e-6).alias("v"))


def randomized_svd(frame_rows: DataFrame, n: int, iters: int = 5, seed: int = 42, oversample: int = 10) -> DataFrame:
    """(session, part, k, index, value): the n leading singular triples of each session's frames x pixels matrix X.

    part 'U' by frame, 'S' by 0, 'V' by pixel y * w + x. A seeded sketch of n + oversample columns goes through `iters` power iterations.
    The movie is cut into stored tiles once; the basis is a table of pixel blocks and its image a table of frame blocks, and either
    is made from the other by a join with the tiles and a two-step sum. Both are made orthonormal by Cholesky factors of
    their summed k x k Gram matrices, the last basis twice. Nothing of the size of a frame or a trace reaches the driver.
    """
    spark = frame_rows.sparkSession
    tiles = blocks.cut_tiles(frame_rows, "svd-tiles")
    widths = tiles.groupBy("session", "pb").agg(F.max(F.expr("size(x) div size(frames)")).alias("width")).groupBy("session").agg(F.sum("width").alias("p"))
    heights = tiles.where("pb = 0").groupBy("session").agg(F.sum(F.size("frames")).alias("f"))
    shape = {r.session: (r.p, r.f) for r in widths.join(heights, "session").collect()}  # one row a recording
    k = {s: min(n + oversample, p, f) for s, (p, f) in shape.items()}
    basis_values, score_values = (sum(size[i] * k[s] for s, size in shape.items()) for i in (0, 1))
    basis = blocks.random_blocks(tiles, k, seed, "svd-basis")
    turn = blocks.whitening(blocks.grams(basis))
    for _ in range(iters):
        scores = blocks.times_pixels(tiles, basis, turn, basis_values, "svd-scores")
        past = basis
        basis = blocks.times_frames(tiles, scores, blocks.whitening(blocks.grams(scores)), score_values, basis_values, "svd-basis")
        discard(past, scores)
        turn = blocks.whitening(blocks.grams(basis))
    again = blocks.whitening(blocks.grams(basis, turn))
    turn = {s: t @ again[s] for s, t in turn.items()}
    scores = blocks.times_pixels(tiles, basis, turn, basis_values, "svd-scores")
    rows, right, left = [], {}, {}
    for session, g in blocks.grams(scores).items():  # X Q has the singular values and right vectors of X within the basis
        values, vectors = np.linalg.eigh(g)
        top = np.argsort(values)[::-1][:n]
        root = np.sqrt(np.maximum(values[top], 0))
        rows += [(session, "S", i, 0, float(x)) for i, x in enumerate(root)]
        right[session], left[session] = turn[session] @ vectors[:, top], vectors[:, top] / np.where(root > 1e-12, root, np.inf)
    signs = {s: np.ones(m.shape[1]) for s, m in right.items()}
    pixels = basis.select("session", F.col("pb").cast("long").alias("b"), "z")
    with arrow_rows(spark, blocks.ARRAY_ROWS):
        for r in _triples(pixels, right, False).groupBy("session", "k").agg(F.max_by("value", F.struct(F.abs("value"), -F.col("index"))).alias("most")).collect():  # n rows a recording
            signs[r.session][r.k] = -1.0 if r.most < 0 else 1.0
    v = _triples(pixels, {s: m * signs[s] for s, m in right.items()}, False)
    frames = tiles.where("pb = 0").select("session", F.col("fb").alias("b"), "frames")
    u = _triples(scores.select("session", F.col("fb").alias("b"), "z").join(frames, ["session", "b"]), {s: m * signs[s] for s, m in left.items()}, True)
    columns = zip(*rows, strict=True) if rows else [()] * 5
    kinds = {"session": pa.string(), "part": pa.string(), "k": pa.int32(), "index": pa.int64(), "value": pa.float64()}
    small = spark.createDataFrame(pa.table([pa.array(c, type=t) for c, t in zip(columns, kinds.values(), strict=True)], names=list(kinds)))  # rows of Python would start workers
    made = small.unionByName(u.select("session", F.lit("U").alias("part"), "k", "index", "value")).unionByName(v.select("session", F.lit("V").alias("part"), "k", "index", "value"))
    made = materialize(made, "svd", blocks.ARRAY_ROWS)
    discard(tiles, basis, scores)
    return made


def _triples(table: DataFrame, turns: dict[str, np.ndarray], frames: bool) -> DataFrame:
    """(session, k, index, value) of blocks (session, b, z) times their session's matrix: index is the frame, or the place of the pixel."""

    def run(batches):
        for batch in batches:
            for r, s in enumerate(batch.column(0).to_pylist()):
                z = batch.column(2)[r].values.to_numpy().reshape(-1, len(turns[s])) @ turns[s]
                index = batch.column(3)[r].values.to_numpy() if frames else batch.column(1)[r].as_py() * blocks.TILE_PIXELS + np.arange(len(z))
                at, ks = np.meshgrid(index, np.arange(z.shape[1], dtype=np.int32), indexing="ij")
                yield pa.RecordBatch.from_arrays([pa.array([s] * z.size), pa.array(ks.ravel()), pa.array(at.ravel()), pa.array(z.ravel())], names=["session", "k", "index", "value"])

    return table.mapInArrow(run, "session string, k int, index long, value double")


def nndsvd(svd: DataFrame, width: int, sparsity: float = 0.05, spatial: bool = True) -> DataFrame:
    """(session, part, k, index, value) of non-negative footprints 'V' and traces 'U' from singular triples.

    Component 0 takes absolute values times sqrt(s0). The others split each vector at sparsity * max|.| + 1e-6
    into a positive and a negative part, choose the pair with the larger product of norms (plus 0.1 times the
    negated sum of distances from the peak, weighted by the footprint) and scale it to unit norms times sqrt(s).
    """
    s = svd.where("part = 'S'").select("session", "k", F.sqrt("value").alias("root"))
    vectors = svd.where("part <> 'S'")
    by = ["session", "k", "part"]
    top = vectors.groupBy(*by).agg((sparsity * F.max(F.abs("value")) + 1e-6).alias("t"))
    halves = vectors.where("k > 0").join(top, by).select(*by, "index", F.explode(F.array(F.struct(F.lit(1).alias("sign"), F.when(F.col("value") > F.col("t"), F.col("value")).otherwise(0.0).alias("value")), F.struct(F.lit(-1).alias("sign"), F.when(F.col("value") < -F.col("t"), -F.col("value")).otherwise(0.0).alias("value")))).alias("h")).select(*by, "index", "h.sign", "h.value")
    stats = halves.groupBy(*by, "sign").agg(F.sqrt(F.sum(F.col("value") ** 2)).alias("norm"), F.max_by("index", F.struct("value", -F.col("index"))).alias("peak"))
    norms = stats.groupBy("session", "k", "sign").agg(F.product("norm").alias("norm"), F.min("norm").alias("least"))
    peak = stats.where("part = 'V'").select("session", "k", "sign", "peak")
    away = F.sqrt((F.expr(f"index div {width}") - F.expr(f"peak div {width}")) ** 2 + (F.col("index") % width - F.col("peak") % width) ** 2)
    compact = halves.where("part = 'V'").join(peak, ["session", "k", "sign"]).groupBy("session", "k", "sign").agg((-F.sum(F.col("value") * away)).alias("compact"))
    score = F.when(F.col("norm") > 0, F.col("norm") + (0.1 * F.col("compact") if spatial else 0.0)).otherwise(F.lit(float("-inf")))
    chosen = norms.join(compact, ["session", "k", "sign"]).where("norm > 0").groupBy("session", "k").agg(F.max_by("sign", F.struct(score.alias("s"), "sign")).alias("sign"))
    rest = halves.join(chosen, ["session", "k", "sign"]).join(stats.select(*by, "sign", "norm"), [*by, "sign"]).join(s, ["session", "k"])
    first = vectors.where("k = 0").join(s, ["session", "k"]).select("session", "part", "k", "index", (F.col("root") * F.abs("value")).alias("value"))
    return first.unionByName(rest.select("session", "part", "k", "index", (F.col("root") * F.col("value") / F.col("norm")).alias("value")))


def background_factor(footprints: DataFrame, traces: DataFrame, component: int = 0) -> tuple[DataFrame, DataFrame]:
    """The background component's footprint as (session, y, x, b) and trace as (session, frame, f)."""
    return footprints.where(F.col("unit_id") == component).select(*PIXEL, F.col("a").alias("b")), traces.where(F.col("unit_id") == component).select(*FRAME, F.col("v").alias("f"))


def component_stats(footprints: DataFrame, traces: DataFrame) -> DataFrame:
    """Per component: size, peak, trace deviation, energy, and the cumulative share of energy by falling energy."""
    a = footprints.groupBy(*UNIT).agg(F.count("*").alias("size"), F.max("a").alias("peak"), F.sum(F.col("a") ** 2).alias("a2"))
    c = traces.groupBy(*UNIT).agg(F.stddev_pop("v").alias("trace_std"), F.sum(F.col("v") ** 2).alias("c2"))
    both = a.join(c, UNIT).withColumn("energy", F.col("a2") * F.col("c2"))
    by = W.partitionBy("session")
    run = by.orderBy(F.desc("energy"), "unit_id").rowsBetween(W.unboundedPreceding, 0)
    return both.select(*UNIT, "size", "peak", "trace_std", "energy", (F.sum("energy").over(run) / F.sum("energy").over(by)).alias("explained"))


def overlap_map(footprints: DataFrame) -> DataFrame:
    return footprints.groupBy(*PIXEL).agg(F.count("*").alias("n_units"))


def power_spectrum(traces: DataFrame) -> DataFrame:
    """(session, unit_id, k, power): the periodogram |X_k|^2 / n of each trace at its positive frequencies. A trace is one group: one recording's frames."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        v = pdf.sort_values("frame")["v"].to_numpy()
        p = power(v)[1:] / len(v)
        return pd.DataFrame({"session": pdf["session"].iloc[0], "unit_id": pdf["unit_id"].iloc[0], "k": np.arange(1, len(p) + 1), "power": p})

    return traces.groupBy(*UNIT).applyInPandas(run, "session string, unit_id long, k long, power double")
