"""Matrices of frames x pixels in blocks: sums of partial arrays, tiles, products and orthonormal bases that no task holds whole.

A block is a row with keys and an array column. Products join tiles with the blocks of the other factor; what
reaches one task, or the driver, is k x k for a recording, whatever the number of frames and pixels.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brightfield.operators.arrays import SMALL_BYTES, lists
from brightfield.sources.storage import arrow_rows, materialize

#: Frames and pixels of a tile at most (1 MB of doubles), and values in a row of partial sums.
TILE_FRAMES, TILE_PIXELS, PART_VALUES = 128, 1024, 1 << 16
#: Tasks among which the partial sums of one key are dealt before they meet.
SPREAD = 16
#: Rows with arrays that Spark hands to Python at once: some 16 MB.
ARRAY_ROWS = 16
#: Bytes of sums that a kernel holds before it passes them on.
HELD_BYTES = 1 << 24


def chained(*kernels: Callable) -> Callable:
    """Kernels one after another in one Python worker: each mapInArrow of a task would have a worker of its own."""

    def run(batches: Iterator[pa.RecordBatch]):
        for kernel in kernels:
            batches = kernel(batches)
        yield from batches

    return run


def _row(key: tuple, total: list[np.ndarray], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*(pa.array([k], type=schema.field(i).type) for i, k in enumerate(key)), *(lists(t.reshape(1, -1)) for t in total)], names=schema.names)


def gathering(n_keys: int) -> Callable:
    """A kernel that adds up the arrays of rows with equal keys in any order; what it holds is passed on, and begun anew, beyond HELD_BYTES."""

    def run(batches: Iterator[pa.RecordBatch]):
        held, size, schema = {}, 0, None
        for batch in batches:
            schema = batch.schema
            keys = list(zip(*(batch.column(i).to_pylist() for i in range(n_keys)), strict=True))
            for r, key in enumerate(keys):
                given = [batch.column(i)[r].values.to_numpy(zero_copy_only=False) for i in range(n_keys, batch.num_columns)]
                if key in held:
                    for t, g in zip(held[key], given, strict=True):
                        t += g
                else:
                    held[key] = [np.array(g, dtype=np.float64) for g in given]
                    size += sum(t.nbytes for t in held[key])
                    if size > HELD_BYTES:
                        yield from (_row(k, t, schema) for k, t in held.items())
                        held, size = {}, 0
        yield from (_row(k, t, schema) for k, t in held.items())

    return run


def adding(n_keys: int, op: Callable = np.add) -> Callable:
    """A kernel that adds up the arrays of neighbouring rows with equal keys; it holds the sums of one key."""

    def run(batches: Iterator[pa.RecordBatch]):
        now, total, schema = None, [], None
        for batch in batches:
            schema = batch.schema
            keys = list(zip(*(batch.column(i).to_pylist() for i in range(n_keys)), strict=True))
            for r, key in enumerate(keys):
                given = [batch.column(i)[r].values.to_numpy(zero_copy_only=False) for i in range(n_keys, batch.num_columns)]
                if key == now:
                    for t, g in zip(total, given, strict=True):
                        op(t, g, out=t)
                else:
                    if now is not None:
                        yield _row(now, total, schema)
                    now, total = key, [np.array(g, dtype=np.float64) for g in given]
        if now is not None:
            yield _row(now, total, schema)

    return run


def summed(parts: DataFrame, keys: list[str], op: Callable = np.add, combined: bool = False, last: Callable | None = None, adds: tuple[str, ...] = ()) -> DataFrame:
    """keys and the array columns (doubles) summed value by value: within tasks first, then, if tasks are many, in SPREAD tasks a key, then in one.

    `combined` parts are summed within tasks already. `last` is a kernel for the sums, run where the last of them are made; it adds the array columns `adds`.
    """
    names = [c for c in parts.columns if c not in keys]
    n = int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    fields = lambda df, ks, cs: T.StructType([*(df.schema[k] for k in ks), *(T.StructField(c, T.ArrayType(T.DoubleType())) for c in cs)])
    made = parts.select(*keys, *names)
    if not combined:
        made = made.sortWithinPartitions(*keys).mapInArrow(adding(len(keys), op), fields(parts, keys, names))
    if n > SPREAD:
        made = made.withColumn("salt", F.spark_partition_id() % SPREAD)
    for ks in ([*keys, "salt"], keys) if n > SPREAD else (keys,):
        end = last is not None and ks is keys
        kernel = chained(adding(len(ks), op), last) if end else adding(len(ks), op)
        made = made.select(*ks, *names).repartition(n, *ks).sortWithinPartitions(*ks).mapInArrow(kernel, fields(made, ks, [*names, *adds] if end else names))
    return made


def cut_tiles(frames: DataFrame, label: str) -> DataFrame:
    """(session, fb, pb, frames, x): frame rows (session, frame, px) in stored tiles of up to TILE_FRAMES x TILE_PIXELS, made where the frames lie."""

    def run(batches):
        place, made = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            session = np.array(batch.column(0).to_pylist(), dtype=object)
            for s in sorted(set(session.tolist())):
                mine = batch.filter(pa.array(session == s))
                frame, px = np.asarray(mine.column(1)), mine.column(2)
                for at in range(0, len(frame), TILE_FRAMES):
                    x = np.stack([px[i].values.to_numpy(zero_copy_only=False) for i in range(at, min(len(frame), at + TILE_FRAMES))])
                    for pb in range(0, x.shape[1], TILE_PIXELS):
                        yield pa.RecordBatch.from_arrays([pa.array([s]), pa.array([place + made]), pa.array([pb // TILE_PIXELS], type=pa.int32()), pa.array([frame[at : at + TILE_FRAMES]]), lists(x[:, pb : pb + TILE_PIXELS].reshape(1, -1))], names=["session", "fb", "pb", "frames", "x"])
                    made += 1

    rows = frames.select("session", F.col("frame").cast("long").alias("frame"), F.col("px").cast("array<double>").alias("px"))
    return materialize(rows.mapInArrow(run, "session string, fb long, pb int, frames array<long>, x array<double>"), label, ARRAY_ROWS)


def _joined(tiles: DataFrame, blocks: DataFrame, key: str, values: int) -> DataFrame:
    """Tiles beside the block of their key; blocks are broadcast if all their values are few."""
    given = blocks.select("session", key, F.col("z").alias("given"))
    return tiles.select("session", "fb", "pb", F.size("frames").alias("n"), "x").join(F.broadcast(given) if 8 * values <= SMALL_BYTES else given, ["session", key])


def _product(tiles: DataFrame, blocks: DataFrame, key: str, other: str, turns: dict[str, np.ndarray], values: int, held: bool, label: str) -> DataFrame:
    """(session, other, z, g): tiles times blocks z, each turned by its session's k x k matrix first; g is z^T z of the block.

    If tiles of one product are neighbours or all products of a task are few (`held`), they are summed where they are made, else once they are sorted.
    """

    def run(batches):
        for batch in batches:
            session, n = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for r, s in enumerate(session):
                x = batch.column(3)[r].values.to_numpy().reshape(n[r], -1)
                q = batch.column(4)[r].values.to_numpy().reshape(x.shape[1] if key == "pb" else n[r], -1) @ turns[s]
                made = x @ q if key == "pb" else x.T @ q
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(r, 1), batch.column(1).slice(r, 1), lists(made.reshape(1, -1))], names=["session", other, "z"])

    schema = f"session string, {other} {'int' if other == 'pb' else 'long'}, z array<double>"
    parts = _joined(tiles, blocks, key, values).select("session", other, "n", "x", "given").mapInArrow(chained(run, gathering(2)) if held else run, schema)
    return materialize(summed(parts, ["session", other], combined=held, last=_with_gram(other, {s: t.shape[1] for s, t in turns.items()}), adds=("g",)), label, ARRAY_ROWS)


def _with_gram(key: str, k: dict[str, int]) -> Callable:
    def run(batches):
        for batch in batches:
            for r, s in enumerate(batch.column(0).to_pylist()):
                z = batch.column(2)[r].values.to_numpy().reshape(-1, k[s])
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(r, 1) for i in range(3)), lists((z.T @ z).reshape(1, -1))], names=["session", key, "z", "g"])

    return run


def grams(blocks: DataFrame, turns: dict[str, np.ndarray] | None = None) -> dict[str, np.ndarray]:
    """Each session's k x k sum of g, or of z^T z for blocks z times their session's matrix."""

    def run(batches):
        for batch in batches:
            for r, s in enumerate(batch.column(0).to_pylist()):
                z = batch.column(1)[r].values.to_numpy().reshape(-1, len(turns[s])) @ turns[s]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(r, 1), lists((z.T @ z).reshape(1, -1))], names=["session", "g"])

    parts = blocks.select("session", "g" if turns is None else "z").mapInArrow(gathering(1) if turns is None else chained(run, gathering(1)), "session string, g array<double>")
    with arrow_rows(blocks.sparkSession, ARRAY_ROWS):
        return {r.session: np.reshape(r.g, (round(len(r.g) ** 0.5), -1)) for r in summed(parts, ["session"], combined=True).collect()}


def whitening(gram: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Matrices that make blocks with these sums orthonormal: inverse Cholesky factors, or, where a basis is dependent, of its independent part with zero columns for the rest."""
    made = {}
    for s, g in gram.items():
        scale = np.sqrt(np.maximum(np.diag(g), 0))
        unit = np.where(scale > 0, 1 / np.where(scale > 0, scale, 1), 0)
        even = g * unit[:, None] * unit[None, :]
        try:
            made[s] = unit[:, None] * np.linalg.inv(np.linalg.cholesky(even)).T
            if not np.isfinite(made[s]).all() or np.linalg.cond(even) > 1e13:
                raise np.linalg.LinAlgError
        except np.linalg.LinAlgError:
            values, vectors = np.linalg.eigh(even)
            good = values > 1e-13 * max(values.max(), 1e-300)
            made[s] = unit[:, None] * vectors * np.where(good, 1 / np.sqrt(np.where(good, values, 1)), 0)
    return made


def random_blocks(tiles: DataFrame, k: dict[str, int], seed: int, label: str) -> DataFrame:
    """(session, pb, z, g): seeded normal numbers for every block of pixels."""

    def run(batches):
        for batch in batches:
            for s, pb, width in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                z = np.random.default_rng([seed, pb]).standard_normal((width, k[s]))
                yield pa.RecordBatch.from_arrays([pa.array([s]), pa.array([pb], type=pa.int32()), lists(z.reshape(1, -1)), lists((z.T @ z).reshape(1, -1))], names=["session", "pb", "z", "g"])

    widths = tiles.groupBy("session", "pb").agg(F.max(F.expr("size(x) div size(frames)")).alias("width"))
    return materialize(widths.mapInArrow(run, "session string, pb int, z array<double>, g array<double>"), label, ARRAY_ROWS)


def times_pixels(tiles: DataFrame, basis: DataFrame, turns: dict[str, np.ndarray], values: int, label: str) -> DataFrame:
    """X Q by blocks of frames, for Q by blocks of pixels. Tiles lie by blocks of frames, and stay so if the basis is broadcast."""
    return _product(tiles, basis, "pb", "fb", turns, values, 8 * values <= SMALL_BYTES, label)


def times_frames(tiles: DataFrame, scores: DataFrame, turns: dict[str, np.ndarray], values: int, basis_values: int, label: str) -> DataFrame:
    """X^T Y by blocks of pixels, for Y by blocks of frames; the product has basis_values numbers."""
    return _product(tiles, scores, "fb", "pb", turns, values, 8 * basis_values <= HELD_BYTES, label)
