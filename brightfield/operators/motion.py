"""Motion estimation and correction."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brightfield.functions.kernels import phase_shift, spectra_shift, warp
from brightfield.operators.arrays import as_frames, as_pixels, is_frames, lists, small, stacks
from brightfield.operators.base import FRAME
from brightfield.operators.blocks import ARRAY_ROWS
from brightfield.sources.storage import materialize


def pair_shift(frame_rows: DataFrame, upsample: int = 100, block: int = 500) -> DataFrame:
    """(session, frame, dy, dx): the motion of each frame against the one before it, by phase correlation to 1 / upsample pixel.

    Frames come in blocks that begin with the last frame of the block before, so that no window holds a
    session. Motion is minus the shift that aligns the frame; a first frame has none.
    """
    here = frame_rows.select("session", "frame", "h", "w", "px", F.expr(f"frame div {block}").alias("block"))
    edge = here.where(F.col("frame") % block == block - 1).withColumn("block", F.col("block") + 1)
    by = W.partitionBy("session", "block").orderBy("frame")
    pairs = here.unionByName(edge).withColumn("before", F.lag("px").over(by)).where("before is not null and frame div " + str(block) + " = block")

    def run(batches):
        for pdf in batches:
            moves = [phase_shift(np.reshape(b, (h, w)), np.reshape(p, (h, w)), upsample) for b, p, h, w in zip(pdf["before"], pdf["px"], pdf["h"], pdf["w"], strict=True)]
            yield pd.DataFrame({"session": pdf["session"], "frame": pdf["frame"], "dy": [-m[0] for m in moves], "dx": [-m[1] for m in moves]})

    return pairs.select("session", "frame", "h", "w", "px", "before").mapInPandas(run, "session string, frame long, dy double, dx double")


def _register(images: np.ndarray, alt: np.ndarray | None, alt_error: float, upsample: int) -> np.ndarray:
    """Motion of each image of a group (n, h, w) against the middle one, summed outward and centred to zero mean.

    images holds the templates or frames, alt the mean of the first and last below them (None: the same): where the two estimates of a
    step differ by more than alt_error pixels, the smaller stands. Each stack is transformed once for all its registrations.
    """
    n, shape = len(images), images.shape[1:]
    mid = n // 2
    spectra = np.fft.rfft2(images)
    others = None if alt is None else np.fft.rfft2(alt)
    moves = np.zeros((n, 2))
    for i in [*range(mid - 1, -1, -1), *range(mid + 1, n)]:
        near = i + 1 if i < mid else i - 1
        step = -np.array(spectra_shift(spectra[near], spectra[i], shape, upsample))
        if others is not None:
            other = -np.array(spectra_shift(others[near], others[i], shape, upsample))
            if np.abs(step - other).max() > alt_error and np.hypot(*other) < np.hypot(*step):
                step = other
        moves[i] = moves[near] + step
    return moves - moves.mean(axis=0)


def estimate_motion(frame_rows: DataFrame, npart: int = 3, alt_error: float = 5.0, upsample: int = 100, agg: str = "mean") -> DataFrame:
    """(session, frame, dy, dx) from a tree of groups of npart.

    Within a group every member registers to its neighbour towards the middle; members are warped by their
    motion and averaged (or their maximum taken) to the group's template, beside which the first and the
    last member go up. Templates are grouped again until one is left; the motion of every level is added to
    all frames below it. Groups are bounded, so each level is one grouped pass with a written result; images stay Arrow arrays.
    """
    schema = "session string, node long, dy double, dx double, top boolean, h int, w int, px array<double>, first array<double>, last array<double>"

    def group(table: pa.Table) -> pa.Table:
        table = table.sort_by("node")
        h, w = table.column("h")[0].as_py(), table.column("w")[0].as_py()
        session, node = table.column("session")[0].as_py(), table.column("node").to_numpy()
        px, *ends = (table.column(c).combine_chunks() for c in ("px", "first", "last"))
        stack = lambda c: c.flatten().to_numpy(zero_copy_only=False).reshape(len(node), h, w)
        px = stack(px)
        first, last = (px, px) if ends[0].null_count else map(stack, ends)  # frames have no ends below them
        moves = _register(px, None if first is px else (first + last) / 2, alt_error, upsample)
        moved = [warp(p, *m) for p, m in zip(px, moves, strict=True)]
        template = np.max(moved, axis=0) if agg == "max" else np.mean(moved, axis=0)
        n, up = len(node), int(node[0]) // npart
        images = [pa.array([None] * n + [x.ravel()], type=pa.list_(pa.float64())) for x in (template, warp(first[0], *moves[0]), warp(last[-1], *moves[-1]))]
        plain = [pa.array([session] * (n + 1)), pa.array([*node, up], type=pa.int64()), pa.array([*moves[:, 0], 0.0]), pa.array([*moves[:, 1], 0.0]), pa.array([False] * n + [True]), pa.array([h] * (n + 1), type=pa.int32()), pa.array([w] * (n + 1), type=pa.int32())]
        return pa.Table.from_arrays([*plain, *images], names=["session", "node", "dy", "dx", "top", "h", "w", "px", "first", "last"])

    px = F.col("px").cast("array<double>")
    level = frame_rows.select("session", F.col("frame").alias("node"), "h", "w", px.alias("px"), *(F.lit(None).cast("array<double>").alias(c) for c in ("first", "last")))
    total = frame_rows.select("session", "frame", F.col("frame").alias("node"), F.lit(0.0).alias("dy"), F.lit(0.0).alias("dx"))
    while True:
        made = materialize(level.groupBy("session", F.expr(f"node div {npart}").alias("parent")).applyInArrow(group, schema), "motion-level", ARRAY_ROWS)
        step = made.where("not top").select("session", "node", F.col("dy").alias("my"), F.col("dx").alias("mx"))
        total = total.join(step, ["session", "node"]).select("session", "frame", F.expr(f"node div {npart}").alias("node"), (F.col("dy") + F.col("my")).alias("dy"), (F.col("dx") + F.col("mx")).alias("dx"))
        level = made.where("top").select("session", "node", "h", "w", "px", "first", "last")
        if level.groupBy("session").count().where("count > 1").isEmpty():
            return total.select("session", "frame", "dy", "dx")


def apply_shift(movie: DataFrame, motion: DataFrame, h: int, w: int) -> DataFrame:
    """Every frame with a motion translated by (dy, dx), bilinear; what comes from outside the image is 0. Frame rows stay where they are."""
    frames = movie if is_frames(movie) else as_frames(movie, h, w)
    keys = [c for c in frames.columns if c != "px"]
    schema = T.StructType([*(frames.schema[c] for c in keys), T.StructField("px", T.ArrayType(T.DoubleType()))])

    def run(batches):
        for batch in batches:
            for part, stack in stacks(batch, h, w):
                dy, dx = (part.column(len(keys) + i).to_numpy() for i in range(2))
                moved = np.stack([warp(image, -a, -b) for image, a, b in zip(stack, dy, dx, strict=True)]) if part.num_rows else stack
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keys)], lists(moved.reshape(part.num_rows, h * w))], names=[*keys, "px"])

    both = frames.join(small(motion.select(*FRAME, F.col("dy").cast("double").alias("dy"), F.col("dx").cast("double").alias("dx"))), FRAME)
    made = both.select(*keys, "dy", "dx", F.col("px").cast("array<double>").alias("px")).mapInArrow(run, schema)
    return made if is_frames(movie) else as_pixels(made)


def motion_summary(motion: DataFrame, bad: DataFrame) -> DataFrame:
    """Mean, population deviation and extremes by axis, and the number of bad frames."""
    stats = motion.groupBy("session").agg(*(f(c).alias(f"{n}_{c}") for c in ("dy", "dx") for n, f in (("mean", F.avg), ("std", F.stddev_pop), ("min", F.min), ("max", F.max))))
    return stats.join(bad.groupBy("session").agg(F.count("*").alias("n_bad")), "session", "left").withColumn("n_bad", F.coalesce("n_bad", F.lit(0)).cast("long"))
