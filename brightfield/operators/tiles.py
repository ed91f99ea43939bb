"""Local tiling and the spatial update."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from brightfield.operators.arrays import STACK_BYTES, as_frames, is_frames, lists, pixel_sums, small
from brightfield.operators.base import FRAME, PIXEL, UNIT
from brightfield.operators.blocks import summed
from brightfield.operators.graph import greedy_groups
from brightfield.operators.merge import overlap_pairs
from brightfield.operators.reject import regions
from brightfield.operators.stencil import disk
from brightfield.sources.storage import materialize


def _grow(pixels: DataFrame, radius: float, h: int, w: int) -> DataFrame:
    """Distinct rows whose y, x lie within the disk of another row with the same keys."""
    keys = [c for c in pixels.columns if c not in ("y", "x")]
    offsets = F.explode(F.array(*(F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx, _ in disk(radius))))
    wide = pixels.select(*keys, "y", "x", offsets.alias("o")).select(*keys, (F.col("y") + F.col("o.dy")).alias("y"), (F.col("x") + F.col("o.dx")).alias("x"))
    return wide.where((F.col("y") >= 0) & (F.col("y") < h) & (F.col("x") >= 0) & (F.col("x") < w)).distinct()


def peaks(footprints: DataFrame) -> DataFrame:
    return footprints.groupBy(*UNIT).agg(F.max("a").alias("peak"))


def dilate(footprints: DataFrame, h: int, w: int, radius: float = 3, share: float = 0.1) -> DataFrame:
    """(session, unit_id, y, x) within the disk of a pixel above share * peak."""
    core = footprints.join(peaks(footprints), UNIT).where(F.col("a") > share * F.col("peak")).select(*UNIT, "y", "x")
    return _grow(core, radius, h, w)


def dilation_report(footprints: DataFrame, dilated: DataFrame) -> DataFrame:
    before = footprints.groupBy(*UNIT).agg(F.count("*").alias("before"))
    after = dilated.groupBy(*UNIT).agg(F.count("*").alias("after"))
    return before.join(after, UNIT).withColumn("ratio", F.col("after") / F.col("before"))


def valid_units(footprints: DataFrame, area: int = 20, share: float = 0.1) -> DataFrame:
    """(session, unit_id) with enough pixels and a peak of at least `share` of the session's."""
    unit = footprints.groupBy(*UNIT).agg(F.count("*").alias("size"), F.max("a").alias("peak"))
    top = unit.groupBy("session").agg(F.max("peak").alias("top"))
    return unit.join(top, "session").where((F.col("size") >= area) & (F.col("peak") / F.col("top") >= share)).select(*UNIT)


def centroids(footprints: DataFrame) -> DataFrame:
    total = F.sum("a")
    return footprints.groupBy(*UNIT).agg((F.sum(F.col("a") * F.col("y")) / total).alias("cy"), (F.sum(F.col("a") * F.col("x")) / total).alias("cx"))


def knn(points: DataFrame, k: int, cell: float) -> DataFrame:
    """(session, unit_id, neighbour, d, rank): the k nearest centroids of each unit, itself included.

    Units look for neighbours in rings of grid cells of the given side: one ring around their own first. Those
    whose k-th neighbour may lie farther than the rings reach look again with twice the rings, until all are done.
    """
    total = points.groupBy("session").agg(F.count("*").alias("n"))
    points = materialize(points, "knn-points")
    todo, out, ring = points, None, 1
    grid = lambda c: F.floor(F.col(c) / cell)
    while True:
        step = F.sequence(F.lit(-ring), F.lit(ring))
        wide = todo.select(*UNIT, "cy", "cx", grid("cy").alias("gy"), grid("cx").alias("gx")).withColumn("dy", F.explode(step)).withColumn("dx", F.explode(step)).select(*UNIT, "cy", "cx", (F.col("gy") + F.col("dy")).alias("gy"), (F.col("gx") + F.col("dx")).alias("gx"))
        other = points.select("session", F.col("unit_id").alias("neighbour"), F.col("cy").alias("ny"), F.col("cx").alias("nx"), grid("cy").alias("gy"), grid("cx").alias("gx"))
        d = F.sqrt((F.col("cy") - F.col("ny")) ** 2 + (F.col("cx") - F.col("nx")) ** 2)
        near = wide.join(other, ["session", "gy", "gx"]).select(*UNIT, "neighbour", d.alias("d"))
        ranked = near.withColumn("rank", F.row_number().over(W.partitionBy(*UNIT).orderBy("d", "neighbour"))).where(F.col("rank") <= k)
        ranked = materialize(ranked, "knn-ring")
        # done: k found within what the rings surely cover, or all there are
        state = ranked.groupBy(*UNIT).agg(F.count("*").alias("found"), F.max("d").alias("far")).join(total, "session")
        done = state.where(((F.col("found") == k) & (F.col("far") <= ring * cell)) | (F.col("found") == F.col("n"))).select(*UNIT)
        part = ranked.join(done, UNIT, "left_semi")
        out = part if out is None else out.unionByName(part)
        todo = materialize(todo.join(done, UNIT, "left_anti"), "knn-todo")
        if todo.isEmpty():
            return out
        ring *= 2


def cluster_units(footprints: DataFrame, k: int = 10, jaccard: float = 0.2, cell: float = 10.0) -> DataFrame:
    """(session, unit_id, cluster_id): from the lowest id on, each free unit is a seed and takes its free k nearest whose Jaccard overlap with it suffices, in rounds over the edges (`greedy_groups`)."""
    pairs = overlap_pairs(footprints).where(F.col("jaccard") >= jaccard).select("session", "u1", "u2")
    # a smaller neighbour is always taken or a seed by the time a unit is asked
    near = knn(centroids(footprints), k, cell).select("session", F.col("unit_id").alias("u1"), F.col("neighbour").alias("u2"))
    units = footprints.select(*UNIT).distinct().withColumn("size", F.lit(0))
    return greedy_groups(units, pairs.join(near, ["session", "u1", "u2"], "left_semi"), "cluster_id")


def cluster_mask(footprints: DataFrame, clusters: DataFrame, h: int, w: int, radius: float, share: float) -> DataFrame:
    """(session, cluster_id, y, x): pixels above share of the cluster's summed peak, dilated."""
    total = footprints.join(clusters, UNIT).groupBy("session", "cluster_id", "y", "x").agg(F.sum("a").alias("a"))
    top = total.groupBy("session", "cluster_id").agg(F.max("a").alias("top"))
    core = total.join(top, ["session", "cluster_id"]).where(F.col("a") > share * F.col("top")).select("session", "cluster_id", "y", "x")
    return _grow(core, radius, h, w)


def cluster_bounds(mask: DataFrame, h: int, w: int, padding: int = 20, least: int = 40) -> DataFrame:
    """(session, cluster_id, y0, y1, x0, x1) around the mask: padded (the exclusive end is the largest index plus padding), at least `least` wide where the frame allows, clamped."""
    box = mask.groupBy("session", "cluster_id").agg(F.min("y").alias("ya"), F.max("y").alias("yb"), F.min("x").alias("xa"), F.max("x").alias("xb"))
    out = box.select("session", "cluster_id", *(c for a, size in (("y", h), ("x", w)) for c in (F.greatest(F.lit(0), F.col(a + "a") - padding).alias(a + "0"), F.least(F.lit(size), F.col(a + "b") + padding).alias(a + "1"))))
    for a, size in (("y", h), ("x", w)):
        short = F.lit(least) - (F.col(a + "1") - F.col(a + "0"))
        low = F.when(short > 0, F.greatest(F.lit(0), F.col(a + "0") - F.floor(short / 2).cast("int"))).otherwise(F.col(a + "0"))
        out = out.withColumn(a + "n", low).withColumn(a + "1", F.when(short > 0, F.least(F.lit(size), F.col(a + "n") + least)).otherwise(F.col(a + "1"))).withColumn(a + "0", F.col(a + "n")).drop(a + "n")
    return out


def bounds_summary(bounds: DataFrame, clusters: DataFrame) -> DataFrame:
    """Per session and measure (height, width, area, units): mean, median, min, max and population deviation over clusters."""
    n = clusters.groupBy("session", "cluster_id").agg(F.count("*").cast("double").alias("units"))
    size = bounds.join(n, ["session", "cluster_id"]).select("session", "cluster_id", (F.col("y1") - F.col("y0")).cast("double").alias("height"), (F.col("x1") - F.col("x0")).cast("double").alias("width"), ((F.col("y1") - F.col("y0")) * (F.col("x1") - F.col("x0"))).cast("double").alias("area"), "units")
    long = size.unpivot(["session", "cluster_id"], ["height", "width", "area", "units"], "measure", "value")
    return long.groupBy("session", "measure").agg(F.avg("value").alias("mean"), F.percentile("value", F.lit(0.5)).alias("median"), F.min("value").alias("min"), F.max("value").alias("max"), F.stddev_pop("value").alias("std"))


def suggest_spatial(movie: DataFrame, footprints: DataFrame, h: int, w: int, n_frames: int = 1000) -> DataFrame:
    """Per session: mean scores of the units' shapes and noise quantiles, and the penalties and least deviation that follow from them.

    score = 0.3 connectivity (share of the largest region) + 0.3 compactness (area over bounding box) + 0.2
    circularity (4 pi area / perimeter^2; perimeter: pixels that a 1-pixel cross adds) + 0.2 mean of the
    footprint's lag-1 autocorrelations along y and x.
    """
    region = regions(footprints).groupBy(*UNIT, "region").agg(F.count("*").alias("n"))
    conn = region.groupBy(*UNIT).agg((F.max("n") / F.sum("n")).alias("conn"), F.sum("n").alias("area"))
    box = footprints.groupBy(*UNIT).agg(((F.max("y") - F.min("y") + 1) * (F.max("x") - F.min("x") + 1)).alias("box"), F.avg("a").alias("m"))
    grown = _grow(footprints.select(*UNIT, "y", "x"), 1, h, w).groupBy(*UNIT).agg(F.count("*").alias("grown"))
    centred = footprints.join(box, UNIT).select(*UNIT, "y", "x", (F.col("a") - F.col("m")).alias("d"))
    energy = centred.groupBy(*UNIT).agg(F.sum(F.col("d") ** 2).alias("energy"))
    auto = None
    for axis in ("y", "x"):
        near = centred.withColumn(axis, F.col(axis) + 1).withColumnRenamed("d", "e")
        part = centred.join(near, [*UNIT, "y", "x"]).groupBy(*UNIT).agg(F.sum(F.col("d") * F.col("e")).alias("c"))
        auto = part if auto is None else auto.unionByName(part)
    corr = auto.groupBy(*UNIT).agg((F.sum("c") / 2).alias("c")).join(energy, UNIT).select(*UNIT, F.when(F.col("energy") > 0, F.col("c") / F.col("energy")).otherwise(0.0).alias("corr"))
    unit = conn.join(box, UNIT).join(grown, UNIT).join(corr, UNIT, "left").select(*UNIT, "conn", (F.col("area") / F.col("box")).alias("comp"), F.least(F.lit(1.0), 4 * math.pi * F.col("area") / F.greatest(F.col("grown") - F.col("area"), F.lit(1)) ** 2).alias("circ"), F.coalesce("corr", F.lit(0.0)).alias("corr"))
    score = unit.withColumn("score", 0.3 * F.col("conn") + 0.3 * F.col("comp") + 0.2 * F.col("circ") + 0.2 * F.col("corr")).groupBy("session").agg(*(F.avg(c).alias(c) for c in ("conn", "comp", "circ", "corr", "score")))
    std = movie.where(F.col("frame") < n_frames).groupBy(*PIXEL).agg(F.stddev_pop("v").alias("s")).groupBy("session").agg(F.percentile("s", F.lit(0.25)).alias("p25"), F.percentile("s", F.lit(0.5)).alias("p50"), F.percentile("s", F.lit(0.75)).alias("p75"))
    return score.join(std, "session").select("session", "conn", "comp", "circ", "corr", "score", F.col("p75").alias("std_high"), F.col("p50").alias("std_mid"), (0.5 * F.col("p25")).alias("std_low"), *(((2 - F.col("score")) * p).alias(n) for n, p in (("penalty_high", 1e-4), ("penalty_mid", 1e-5), ("penalty_low", 1e-6))))


def lasso(xtx: np.ndarray, xty: np.ndarray, penalty: float, sweeps: int = 10) -> np.ndarray:
    """Non-negative coordinate descent for all columns of xty at once."""
    out = np.zeros_like(xty)
    for _ in range(sweeps):
        for k in range(len(xtx)):
            if xtx[k, k] > 0:
                out[k] = np.maximum(0.0, (xty[k] - xtx[k] @ out + xtx[k, k] * out[k] - penalty) / xtx[k, k])
    return out


#: Pixels of clusters that one pass over the movie serves (every task holds their places); more clusters take more passes.
PASS_PIXELS = 1 << 20


def spatial_update(movie: DataFrame, traces: DataFrame, background: DataFrame, clusters: DataFrame, mask: DataFrame, penalties: tuple[float, float, int] = (1e-6, 1e-2, 10), min_std: float = 0.1, least: float = 1e-8) -> DataFrame:
    """(session, unit_id, y, x, a): non-negative lasso of each masked pixel's trace on its cluster's traces and the background's.

    Frame rows are cut to the pixels of each cluster where they lie and multiplied with the frame's traces, a block of frames at a
    time; tasks pass on one pixels x traces matrix a cluster, and these are summed. Pixel rows are gathered to frames first. A row then holds
    all sums of a cluster, and the solver takes it for penalties spaced evenly on the log scale (threshold frames * penalty),
    weights the solutions by the inverse of their residual and scales back. Pixels whose deviation is under min_std take no part.
    """
    frames = movie if is_frames(movie) else gathered(movie)
    member = clusters.select("session", "cluster_id", "unit_id")
    regress = traces.join(member, UNIT).select("session", "cluster_id", "unit_id", "frame", "v").unionByName(background.join(member.select("session", "cluster_id").distinct(), "session").select("session", "cluster_id", F.lit(-1).cast("long").alias("unit_id"), "frame", F.col("f").alias("v")))
    # Centred sums are formed from means, which keeps cancellation small
    mean = regress.groupBy("session", "cluster_id", "unit_id").agg(F.avg("v").alias("m"))
    x = regress.join(mean, ["session", "cluster_id", "unit_id"]).select("session", "cluster_id", "unit_id", "frame", (F.col("v") - F.col("m")).alias("x"))
    one = F.sort_array(F.collect_list(F.struct("cluster_id", "unit_id", "x")))
    at = materialize(x.groupBy(*FRAME).agg(one.alias("s")).select(*FRAME, "s.cluster_id", "s.unit_id", "s.x"), "update-traces", 500)
    order = {}  # the traces of each cluster in order: as many rows as units, clusters and sessions
    for r in at.select("session", F.explode(F.arrays_zip("cluster_id", "unit_id")).alias("e")).select("session", "e.*").distinct().orderBy("session", "cluster_id", "unit_id").collect():
        order.setdefault((r.session, r.cluster_id), []).append(r.unit_id)
    size = {r.session: (r.h, r.w) for r in frames.groupBy("session").agg(F.max(F.expr("size(px) div w")).cast("int").alias("h"), F.max("w").alias("w")).collect()}
    h, w = (max((v[i] for v in size.values()), default=0) for i in (0, 1))
    if len(set(size.values())) > 1:
        raise ValueError("sessions of different sizes need a call each")
    if not h:
        return traces.select("session", "unit_id", F.lit(0).alias("y"), F.lit(0).alias("x"), F.lit(0.0).alias("a")).limit(0)
    squares = gram_of_traces(at, order)
    sums = pixel_sums(frames.select("session", "px"), h, w, lambda v: [v, v * v, np.ones(v.shape[1:]) * len(v)], ["s1", "s2", "n"])
    m = F.col("s1") / F.col("n")
    stats = sums.select(*PIXEL, m.alias("m"), F.sqrt(F.greatest(F.lit(0.0), F.col("s2") / F.col("n") - m * m)).alias("s")).where(F.col("s") >= min_std)
    masked = materialize(mask.select("session", "cluster_id", "y", "x").distinct().join(stats, PIXEL), "update-pixels")
    counts = masked.groupBy("session", "cluster_id").count().orderBy("session", "cluster_id").collect()  # one row a cluster
    passes, held = [[]], 0
    for r in counts:
        if held and held + r["count"] > PASS_PIXELS:
            passes.append([])
            held = 0
        passes[-1].append((r.session, r.cluster_id))
        held += r["count"]
    grid = np.logspace(np.log10(penalties[0]), np.log10(penalties[1]), penalties[2])
    joined = frames.select(*FRAME, "px").join(small(at), FRAME)
    made = None
    for wanted in passes:
        names = movie.sparkSession.createDataFrame(wanted or [("", -1)], "session string, cluster_id long")
        table = masked.join(F.broadcast(names), ["session", "cluster_id"]).orderBy("session", "cluster_id", "y", "x").toArrow().to_pandas()  # PASS_PIXELS rows, or one cluster's
        places = {key: ((part["y"] * w + part["x"]).to_numpy(), part["m"].to_numpy(), part["s"].to_numpy()) for key, part in table.groupby(["session", "cluster_id"]) if key in order}
        part = joined.mapInArrow(cross_kernel(places, order, h, w), "session string, cluster_id long, cross array<double>, trace array<double>")
        solved = summed(part, ["session", "cluster_id"]).join(squares, ["session", "cluster_id"]).mapInArrow(solver(places, order, grid, least, w), "session string, unit_id long, y int, x int, a double")
        made = solved if made is None else made.unionByName(solved)
    return made


def gathered(movie: DataFrame) -> DataFrame:
    """Frame rows of pixel rows, whose images must be complete."""
    h, w = movie.agg(F.max("y") + 1, F.max("x") + 1).first()
    return as_frames(movie.select(*FRAME, "y", "x", "v"), h or 0, w or 0)


def gram_of_traces(at: DataFrame, order: dict) -> DataFrame:
    """(session, cluster_id, gram, n): the traces x traces matrix of products of each cluster and its number of frames, from rows of frames."""

    def run(batches):
        held: dict = {}
        for batch in batches:
            for key, x in by_cluster(batch, order, (0, 2, 3, 4)):
                total = held.setdefault(key, [np.zeros((x.shape[1], x.shape[1])), np.zeros(1)])
                total[0] += x.T @ x
                total[1] += len(x)
        for (session, cluster), (g, n) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([session]), pa.array([cluster]), lists(g.reshape(1, -1)), lists(n.reshape(1, -1))], names=["session", "cluster_id", "gram", "n"])

    rows = at.select("session", "frame", "cluster_id", "unit_id", "x").mapInArrow(run, "session string, cluster_id long, gram array<double>, n array<double>")
    return summed(rows, ["session", "cluster_id"])


def by_cluster(batch: pa.RecordBatch, order: dict, columns: tuple[int, int, int, int]):
    """((session, cluster), frames x traces) of rows with arrays of clusters, units and values; a trace without a value has 0."""
    session, clusters, units, values = (batch.column(i) for i in columns)
    names = np.array(session.to_pylist(), dtype=object)
    row = np.asarray(pc.list_parent_indices(clusters), dtype=np.int64)
    flat = pd.DataFrame({"row": row, "cluster": np.asarray(clusters.flatten()), "unit": np.asarray(units.flatten()), "x": np.asarray(values.flatten())})
    for s in sorted(set(names.tolist())):
        mine = np.flatnonzero(names == s)
        local = np.full(len(names), -1)
        local[mine] = np.arange(len(mine))
        for c, part in flat[local[flat["row"]] >= 0].groupby("cluster"):
            listed = np.array(order[s, c])
            x = np.zeros((len(mine), len(listed)))
            x[local[part["row"]], np.searchsorted(listed, part["unit"])] = part["x"]
            yield (s, c), x


def cross_kernel(places: dict, order: dict, h: int, w: int):
    """Products of each cluster's traces with its pixels, and sums of the traces, over the frames of a task."""

    def run(batches):
        held: dict = {}
        for batch in batches:
            px = batch.column(2).cast(pa.list_(pa.float64()))
            lead = batch.select([0, 3, 4, 5])
            step = max(1, STACK_BYTES // (8 * h * w))
            for i in range(0, batch.num_rows, step):
                rows = px.slice(i, step)
                if len(rows.flatten()) != len(rows) * h * w:
                    raise ValueError(f"images of {h} x {w} pixels are not complete")
                v = rows.flatten().to_numpy(zero_copy_only=False).reshape(-1, h * w)
                names = np.array(lead.column(0).slice(i, step).to_pylist(), dtype=object)
                for key, x in by_cluster(lead.slice(i, step), order, (0, 1, 2, 3)):
                    if key in places:
                        total = held.setdefault(key, [np.zeros((x.shape[1], len(places[key][0]))), np.zeros(x.shape[1])])
                        total[0] += x.T @ v[names == key[0]][:, places[key][0]]
                        total[1] += x.sum(axis=0)
        for (session, cluster), (cross, trace) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([session]), pa.array([cluster]), lists(cross.reshape(1, -1)), lists(trace.reshape(1, -1))], names=["session", "cluster_id", "cross", "trace"])

    return run


def solver(places: dict, order: dict, grid: np.ndarray, least: float, w: int):
    """Solutions of all pixels of a cluster from its sums."""

    def run(batches):
        for batch in batches:
            for session, cluster, cross, trace, gram, n in zip(*(c.to_pylist() for c in batch.columns[:2]), *batch.columns[2:], strict=True):
                units, (place, m, s), n = np.array(order[session, cluster]), places[session, cluster], n.values.to_numpy()[0]
                xtx = gram.values.to_numpy().reshape(len(units), -1)
                norm = np.sqrt(np.maximum(np.diag(xtx), 1e-300))
                centred = (cross.values.to_numpy().reshape(len(units), -1) - trace.values.to_numpy()[:, None] * m) / s
                xty, square = centred / norm[:, None], xtx / norm[:, None] / norm[None, :]
                total, weights = 0.0, 0.0
                for alpha in grid:
                    b = lasso(square, xty, n * alpha)
                    left = np.maximum(n - 2 * (b * xty).sum(0) + (b * (square @ b)).sum(0), 1e-12)
                    total, weights = total + b / left, weights + 1 / left
                a = total / weights * s[None, :] / norm[:, None]
                k, p = np.nonzero((a > least) & (units >= 0)[:, None])
                yield pa.RecordBatch.from_arrays([pa.array([session] * len(k), type=pa.string()), pa.array(units[k]), pa.array((place[p] // w).astype(np.int32)), pa.array((place[p] % w).astype(np.int32)), pa.array(a[k, p])], names=["session", "unit_id", "y", "x", "a"])

    return run


def growth_cap(updated: DataFrame, sizes: DataFrame, factor: float = 3.0) -> DataFrame:
    """At most factor * size pixels of a unit (sizes: session, unit_id, size), the brightest first; a cap of 0 is none."""
    rank = F.row_number().over(W.partitionBy(*UNIT).orderBy(F.desc("a"), "y", "x"))
    cap = F.floor(F.coalesce("size", F.lit(0)) * factor)
    return updated.join(sizes, UNIT, "left").withColumn("k", rank).where((cap == 0) | (F.col("k") <= cap)).select(*UNIT, "y", "x", "a")


def replace_tiles(footprints: DataFrame, updates: DataFrame, boxes: DataFrame) -> DataFrame:
    """Pixels inside a unit's box (session, unit_id, y0, y1, x0, x1) come from the updates; units without a box keep theirs."""
    inside = footprints.join(boxes, UNIT).where("y >= y0 and y < y1 and x >= x0 and x < x1").select(*UNIT, "y", "x")
    kept = footprints.join(inside, [*UNIT, "y", "x"], "left_anti").select(*UNIT, "y", "x", "a")
    return kept.unionByName(updates.join(boxes, UNIT).where("y >= y0 and y < y1 and x >= x0 and x < x1").select(*UNIT, "y", "x", "a"))


def overlap_split(footprints: DataFrame) -> DataFrame:
    """Values over the number of units that cover the pixel, counted before."""
    n = footprints.groupBy(*PIXEL).agg(F.count("*").alias("n"))
    return footprints.join(n, PIXEL).select(*UNIT, "y", "x", (F.col("a") / F.col("n")).alias("a"))


def trace_floor(traces: DataFrame) -> DataFrame:
    """Traces minus the session's least value."""
    low = traces.groupBy("session").agg(F.min("v").alias("low"))
    return traces.join(low, "session").select(*UNIT, "frame", (F.col("v") - F.col("low")).alias("v"))
