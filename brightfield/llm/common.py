"""Helpers that the corpus operators share: shared-folder tables, text batches, row keys."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from brightfield.sources import storage
from brightfield.sources.storage import arrow_rows, discard, new_dir, scratch, shared_dir  # noqa: F401

#: Bytes of text that a kernel works on at once; a longer text is a batch of its own.
BATCH_BYTES = 1 << 20


def materialize(df: DataFrame, label: str, rows: int = 1000, compact: bool = False) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back; `rows` bounds Arrow batches, `compact` tables are small beside their input."""
    return storage.materialize(df, label, rows, compact)


def condensed(make: Callable[[], DataFrame], label: str, rows: int = 1000, compact: bool = False) -> DataFrame:
    """make() as a table in the shared folder; the tables that it wrote on its way are removed once it is there."""
    return storage.condensed(make, label, rows, compact)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened until none is a column of df whatever its case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slices(batch: pa.RecordBatch, text: str, limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of an Arrow batch with up to `limit` bytes of text each (one row at least)."""
    if not batch.num_rows:
        return
    col = batch.column(batch.schema.get_field_index(text))
    sizes = np.asarray(pc.fill_null(pc.binary_length(col), 0), dtype=np.int64)
    start, held = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if held and held + size > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += size
    yield batch.slice(start)


def map_rows(df: DataFrame, run: Callable, fields: list[T.StructField]) -> DataFrame:
    """df.mapInArrow(run) for columns of any name: tasks see c0, c1, ..., and what they yield is named by `fields`, column by column."""
    names = [f"c{i}" for i in range(len(fields))]

    def plain(batches):
        for batch in run(batches):
            yield pa.RecordBatch.from_arrays(batch.columns, names=names)

    schema = T.StructType([T.StructField(n, f.dataType, f.nullable) for n, f in zip(names, fields, strict=True)])
    made = df.toDF(*(f"c{i}" for i in range(len(df.columns)))).mapInArrow(plain, schema)
    return made.toDF(*(f.name for f in fields))


def map_texts(df: DataFrame, text: str, kernel: Callable[[], Callable], outputs: T.StructType, keep: list[str] | None = None) -> DataFrame:
    """Adds columns that a per-task kernel makes from lists of texts (None for null).

    kernel() is called once a task and returns list[str | None] -> list of columns in the order of
    `outputs`. `keep` lists the input columns that stay (default all); an output replaces an input
    column of the same name.
    """
    kept = [c for c in (df.columns if keep is None else keep) if c not in outputs.names]
    arrow = [to_arrow_type(f.dataType) for f in outputs.fields]
    n = len(kept)

    def run(batches):
        apply = kernel()
        for batch in batches:
            for part in slices(batch, batch.schema.names[n]):
                made = apply(part.column(n).to_pylist())
                cols = [m if isinstance(m, pa.Array) else pa.array(m, type=t) for m, t in zip(made, arrow, strict=True)]
                yield pa.RecordBatch.from_arrays(part.columns[:n] + cols, names=[f"c{i}" for i in range(n + len(cols))])

    return map_rows(df.select(*(quoted(c) for c in kept), quoted(text)), run, [df.schema[c] for c in kept] + list(outputs.fields))


def filesystem(uri: str):
    """(pyarrow file system, path) of a URI; plain paths are local."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else "file://" + uri)


def commit_files(spark: SparkSession, root: str, listed: list[dict]) -> None:
    """Makes files that tasks left under temporary names (temporary, path and more) the content of a folder.

    The list is written first, as manifest.pending.json; then the files get their names, manifest.json appears, and what failed tasks
    left is removed. finish_files goes on from any point at which this was broken off.
    """
    fs, base = filesystem(root)
    with fs.open_output_stream(f"{base}/manifest.pending.json") as f:
        f.write(json.dumps(listed).encode())
    finish_files(spark, root)


def finish_files(spark: SparkSession, root: str) -> None:
    """Completes a commit whose list is there; without one it does nothing. Names are given by tasks, each of which can be repeated."""
    from pyarrow.fs import FileSelector, FileType

    fs, base = filesystem(root)
    pending = f"{base}/manifest.pending.json"
    if fs.get_file_info(pending).type == FileType.NotFound:
        return
    with fs.open_input_stream(pending) as f:
        listed = json.loads(f.read())

    def rename(batches):
        out, _ = filesystem(root)
        for batch in batches:
            for old, new in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if out.get_file_info(old).type != FileType.NotFound:
                    out.move(old, new)
            yield batch.slice(0, 0)

    if listed:
        moves = spark.createDataFrame([(x["temporary"], x["path"]) for x in listed], "old string, new string")
        moves.repartition(min(len(listed), partitions(spark))).mapInArrow(rename, "old string, new string").count()
    with fs.open_output_stream(f"{base}/manifest.new.json") as f:
        f.write(json.dumps([{k: v for k, v in x.items() if k != "temporary"} for x in listed]).encode())
    fs.move(f"{base}/manifest.new.json", f"{base}/manifest.json")
    fs.delete_file(pending)
    for found in fs.get_file_info(FileSelector(base)):
        if found.base_name.startswith("_temporary-"):
            fs.delete_file(found.path)
