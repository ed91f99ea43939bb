"""Tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset, local runs get a temporary folder and clusters an error, since no machine's own folder is shared."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = getattr(sc, "_brightfield_dir", None)
        if base is None:
            base = sc._brightfield_dir = "file://" + tempfile.mkdtemp(prefix="spark-")
            sc.setCheckpointDir(base)
    return base.rstrip("/")


def new_dir(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


@contextmanager
def arrow_rows(spark: SparkSession, rows: int | None):
    """Within it, jobs hand Python batches of so many rows: texts and arrays are long, and a batch is held on both sides."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    if rows is not None:
        spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


#: Tables written since the last `scratch` began, outermost first.
_held: list[list[DataFrame]] = []


@contextmanager
def scratch():
    """Tables materialized within are removed at its end, once what was made of them is written; nothing that it leaves may read them."""
    _held.append([])
    try:
        yield
    finally:
        discard(*_held.pop())


def condensed(make: Callable[[], DataFrame], label: str, rows: int | None = None, compact: bool = False) -> DataFrame:
    """make() written to the shared folder; the tables that it wrote on its way are removed then."""
    with scratch():
        made = _write(make(), label, rows, compact)
    if _held:
        _held[-1].append(made)
    return made


def materialize(df: DataFrame, label: str = "step", rows: int | None = None, compact: bool = False) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage is cut and lost executors cost nothing. `rows` bounds Arrow batches.

    `compact` is for tables that are small beside their input, such as those of a round: four tasks a core write them,
    and not a file for every shuffle partition.
    """
    made = _write(df, label, rows, compact)
    if _held:
        _held[-1].append(made)
    return made


def _write(df: DataFrame, label: str, rows: int | None, compact: bool) -> DataFrame:
    path = new_dir(df.sparkSession, label)
    if compact:
        df = df.coalesce(max(8, 4 * df.sparkSession.sparkContext.defaultParallelism))
    with arrow_rows(df.sparkSession, rows):
        df.write.parquet(path)
    made = df.sparkSession.read.schema(df.schema).parquet(path)
    made.stored_at = path
    return made


def _file_system(spark: SparkSession, path: str):
    name = spark._jvm.org.apache.hadoop.fs.Path(path)
    return name.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), name


def exists(spark: SparkSession, path: str) -> bool:
    fs, name = _file_system(spark, path)
    return fs.exists(name)


def remove(spark: SparkSession, path: str) -> None:
    fs, name = _file_system(spark, path)
    fs.delete(name, True)


def discard(*tables: DataFrame) -> None:
    """Removes materialized tables whose last reader has been written; others are left alone."""
    for df in tables:
        path = getattr(df, "stored_at", None)
        if path:
            remove(df.sparkSession, path)
