"""Movies as frame rows: key columns with h, w and px, an array of h * w values row by row.

An operator on single images takes frame rows or pixel rows (keys, y, x, v) and gives back the same form. Frame
rows are worked on where they lie, by a numpy kernel and without a shuffle; pixel rows are gathered once, one
image to a row.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brightfield.operators.base import FRAME, UNIT

#: Bytes of images that a kernel works on at once.
STACK_BYTES = 1 << 24
#: Rows of a small side (weights of footprints, frame motions) that are handed to every task: some 30 MB. Larger sides are joined.
SMALL_ROWS = 1 << 20
#: Bytes of images, one a session, that are broadcast to a join with frames; beyond, Spark shuffles or splits.
SMALL_BYTES = 1 << 26


def is_frames(img: DataFrame) -> bool:
    return "px" in img.columns


def as_frames(img: DataFrame, h: int, w: int) -> DataFrame:
    """Frame rows of complete images in pixel rows."""
    keys = [c for c in img.columns if c not in ("y", "x", "v")]
    px = F.transform(F.sort_array(F.collect_list(F.struct("y", "x", F.col("v").cast("double").alias("v")))), lambda s: s["v"])
    return img.groupBy(*keys).agg(px.alias("px")).select(*keys, F.lit(h).alias("h"), F.lit(w).alias("w"), "px")


def as_pixels(frames: DataFrame) -> DataFrame:
    keys = [c for c in frames.columns if c not in ("h", "w", "px")]
    each = frames.select(*keys, "w", F.posexplode("px").alias("p", "v"))
    return each.select(*keys, F.expr("cast(p div w as int)").alias("y"), (F.col("p") % F.col("w")).alias("x"), F.col("v").cast("double").alias("v"))


def cut(frames: DataFrame, h: int, w: int, rows: tuple[int, int, int], columns: tuple[int, int, int]) -> tuple[DataFrame, int, int]:
    """Frame rows with the rows and columns in (from, to, step) alone, and their new height and width."""
    ys, xs = range(*rows), range(*columns)
    if len(ys) == h and len(xs) == w:
        return frames, h, w
    y, x = (lambda i: F.floor(i / w)), (lambda i: i % w)
    inside = lambda v, i: (y(i) >= ys.start) & (y(i) < ys.stop) & ((y(i) - ys.start) % ys.step == 0) & (x(i) >= xs.start) & (x(i) < xs.stop) & ((x(i) - xs.start) % xs.step == 0)
    made = frames.withColumn("px", F.filter("px", inside)).withColumn("h", F.lit(len(ys))).withColumn("w", F.lit(len(xs)))
    return made, len(ys), len(xs)


def stacks(batch: pa.RecordBatch, h: int, w: int):
    """(slice of the batch, its images as doubles (n, h, w)) in parts of bounded size; px is the last column."""
    step = max(1, STACK_BYTES // (8 * h * w))
    for at in range(0, batch.num_rows, step):
        part = batch.slice(at, step)
        values = part.column(part.num_columns - 1).flatten().to_numpy(zero_copy_only=False)
        if len(values) != part.num_rows * h * w:
            raise ValueError(f"images of {h} x {w} pixels are not complete")
        yield part, values.reshape(part.num_rows, h, w)


def lists(values: np.ndarray) -> pa.Array:
    """A list per row of a matrix."""
    n, size = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * size), pa.array(np.ascontiguousarray(values).reshape(-1)))


def map_images(img: DataFrame, h: int, w: int, kernel: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """kernel over stacks (n, h, w) of images; keys stay."""
    frames = img if is_frames(img) else as_frames(img, h, w)
    keys = [c for c in frames.columns if c != "px"]
    schema = T.StructType([*(frames.schema[c] for c in keys), T.StructField("px", T.ArrayType(T.DoubleType()))])

    def run(batches):
        for batch in batches:
            for part, stack in stacks(batch, h, w):
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], lists(kernel(stack).reshape(part.num_rows, h * w))], names=[*keys, "px"])

    made = frames.select(*keys, F.col("px").cast("array<double>").alias("px")).mapInArrow(run, schema)
    return made if is_frames(img) else as_pixels(made)


def pixel_sums(frames: DataFrame, h: int, w: int, moments: Callable[..., list[np.ndarray]], names: list[str], extra: tuple[str, ...] = (), how: str = "sum") -> DataFrame:
    """(session, y, x, names...): sums (or least values) over frames of images that moments(stack, *extra columns) gives, each (n, h, w) or (h, w).

    A task reduces the frames of a batch first; Spark adds up the parts by session and pixel.
    """
    reduce = np.sum if how == "sum" else np.min
    schema = T.StructType([T.StructField("session", T.StringType()), *(T.StructField(n, T.ArrayType(T.DoubleType())) for n in names)])

    def run(batches):
        held: dict[str, list[np.ndarray]] = {}
        for batch in batches:
            for part, stack in stacks(batch, h, w):
                session = np.array(part.column(0).to_pylist(), dtype=object)
                columns = [part.column(i + 1).to_numpy(zero_copy_only=False) for i in range(len(extra))]
                for s in set(session.tolist()):
                    mine = session == s
                    made = [m if m.ndim == 2 else reduce(m, axis=0) for m in moments(stack[mine], *(c[mine] for c in columns))]
                    held[s] = made if s not in held else [a + b if how == "sum" else np.minimum(a, b) for a, b in zip(held[s], made, strict=True)]
            while len(held) > 8:  # a task of many sessions holds few at a time
                s, made = held.popitem()
                yield pa.RecordBatch.from_arrays([pa.array([s]), *(lists(m.reshape(1, -1)) for m in made)], names=["session", *names])
        for s, made in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([s]), *(lists(m.reshape(1, -1)) for m in made)], names=["session", *names])

    parts = frames.select("session", *extra, F.col("px").cast("array<double>").alias("px")).mapInArrow(run, schema)
    each = parts.select("session", F.posexplode(F.arrays_zip(*names)).alias("p", "e")).select("session", "p", "e.*")
    total = each.groupBy("session", "p").agg(*((F.sum(n) if how == "sum" else F.min(n)).alias(n) for n in names))
    return total.select("session", F.expr(f"cast(p div {w} as int)").alias("y"), (F.col("p") % w).alias("x"), *names)


def with_image(frames: DataFrame, image: DataFrame, h: int, w: int, name: str) -> DataFrame:
    """Frames beside their session's image (session, y, x, v) as an array column; broadcast while all sessions' images are small."""
    one = as_frames(image, h, w).select("session", F.col("px").alias(name))
    n = image.select("session").distinct().count()
    return frames.join(F.broadcast(one) if n * h * w * 8 <= SMALL_BYTES else one, "session")


def map_units(footprints: DataFrame, keys: list[str], kernel: Callable[..., pd.DataFrame], columns: str) -> DataFrame:
    """keys and the rows that kernel(y, x, a) makes of each footprint, given as arrays by (y, x): work within its pixels, in many units a task."""
    one = footprints.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("y", "x", "a"))).alias("s")).select(*keys, "s.y", "s.x", "s.a")
    schema = T.StructType([*(footprints.schema[k] for k in keys), *T.StructType.fromDDL(columns).fields])

    def run(batches):
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                made = kernel(np.asarray(row[-3], dtype=np.int64), np.asarray(row[-2], dtype=np.int64), np.asarray(row[-1], dtype=np.float64))
                yield pd.DataFrame({**dict(zip(keys, row, strict=False)), **made}, index=range(len(next(iter(made.values())))))[schema.names]

    return one.mapInPandas(run, schema)


def small(side: DataFrame) -> DataFrame:
    """The side with a broadcast hint if its rows are few enough."""
    return F.broadcast(side) if side.count() <= SMALL_ROWS else side


def unit_sums(movie: DataFrame, weights: DataFrame) -> DataFrame:
    """(session, unit_id, frame, v): sum over pixels of weight * value, weights (session, unit_id, y, x, g).

    Frame rows are multiplied with the sparse weights of their session, which every task holds while they are
    few (SMALL_ROWS); otherwise, and for pixel rows, pixels are joined.
    """
    if not is_frames(movie) or weights.count() > SMALL_ROWS:
        rows = as_pixels(movie) if is_frames(movie) else movie
        return rows.join(weights, ["session", "y", "x"]).groupBy(*UNIT, "frame").agg(F.sum(F.col("g") * F.col("v")).alias("v"))
    table = weights.select("session", F.col("unit_id").cast("long").alias("unit_id"), F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), F.col("g").cast("double").alias("g")).orderBy("session", "unit_id").toArrow()
    session = np.array(table.column("session").to_pylist(), dtype=object)
    unit, y, x, g = (table.column(c).to_numpy() for c in ("unit_id", "y", "x", "g"))
    held = {}
    for s in set(session.tolist()):
        mine = session == s
        u = unit[mine]
        starts = np.flatnonzero(np.concatenate([[True], u[1:] != u[:-1]]))
        held[s] = (u[starts], starts, y[mine], x[mine], g[mine])
    given = movie.sparkSession.sparkContext.broadcast(held)
    schema = "session string, unit_id long, frame long, v double"

    def run(batches):
        known = given.value
        for batch in batches:
            session, frame, width = (batch.column(i).to_pylist() for i in range(3))
            for s in sorted(set(session) & set(known)):
                units, starts, py, px, weight = known[s]
                rows = [i for i, other in enumerate(session) if other == s]
                step = max(1, STACK_BYTES // (8 * len(py)))
                for at in range(0, len(rows), step):
                    part = rows[at : at + step]
                    made = np.zeros((len(part), len(py)))
                    for k, i in enumerate(part):
                        image = batch.column(3)[i].values.to_numpy(zero_copy_only=False)
                        place = py * width[i] + px
                        inside = (px < width[i]) & (place < len(image))
                        made[k, inside] = image[place[inside]]
                    sums = np.add.reduceat(made * weight, starts, axis=1)
                    frames = np.repeat(np.array([frame[i] for i in part], dtype=np.int64), len(units))
                    yield pa.RecordBatch.from_arrays([pa.array([s] * len(frames)), pa.array(np.tile(units, len(part))), pa.array(frames), pa.array(sums.reshape(-1))], names=["session", "unit_id", "frame", "v"])

    return movie.select("session", F.col("frame").cast("long").alias("frame"), "w", "px").mapInArrow(run, schema)


def frame_means(movie: DataFrame) -> DataFrame:
    """(session, frame, v): the mean of each frame, of frame or pixel rows."""
    if is_frames(movie):
        return movie.select(*FRAME, (F.aggregate("px", F.lit(0.0), lambda a, v: a + v) / F.size("px")).alias("v"))
    return movie.groupBy(*FRAME).agg(F.avg("v").alias("v"))
