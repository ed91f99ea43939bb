"""Sources and ingest: manifests, frame selection, catalogues and parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from brightfield.operators.arrays import cut, is_frames, small
from brightfield.operators.base import FRAME, SESSION
from brightfield.sources.storage import new_dir

FALLBACK_FPS = 10.0


def frame_manifest(files: DataFrame, pattern: str) -> DataFrame:
    """Files whose name matches, in natural order, with reconciled frame counts and the offset of their first frame in the stream.

    The header's count stands unless it is 0 or missing or differs by more than 5 % from duration times rate.
    """
    parts = F.split("rate", "/")
    fps = F.when(F.col("rate").rlike(r"^\d+/[1-9]\d*$"), parts[0].cast("double") / F.get(parts, F.lit(1)).cast("double")).otherwise(FALLBACK_FPS)
    made = files.where(F.col("file").rlike(pattern)).withColumn("number", F.regexp_extract("file", r"(\d+)", 1).cast("long")).withColumn("fps", fps)
    timed = F.round(F.col("duration") * F.col("fps")).cast("long")
    header = F.coalesce(F.col("nb_frames").cast("long"), F.lit(0))
    made = made.withColumn("n_frames", F.when((header == 0) | (F.abs(timed - header) > 0.05 * header), timed).otherwise(header))
    before = W.partitionBy("session").orderBy("number", "file").rowsBetween(W.unboundedPreceding, -1)
    return made.withColumn("offset", F.coalesce(F.sum("n_frames").over(before), F.lit(0)))


def _renumbered(movie: DataFrame, index: DataFrame) -> DataFrame:
    """Frames of the index with their new numbers; original_frame keeps the first number a frame ever had."""
    made = movie.join(small(index), FRAME)
    if "original_frame" not in movie.columns:
        made = made.withColumn("original_frame", F.col("frame"))
    return made.drop("frame").withColumnRenamed("new_frame", "frame")


def stride_downsample(movie: DataFrame, every: int, dh: int, dw: int, h: int, w: int) -> DataFrame:
    """The first of every `every` frames within each file (column file), and every dh-th row and dw-th column.

    Frames, rows and columns are renumbered from 0; frames by their order among all that are kept of a session.
    Frame rows (h, w, px) or pixel rows.
    """
    numbered = movie.select("session", "file", "frame").distinct().withColumn("k", F.row_number().over(W.partitionBy("session", "file").orderBy("frame")) - 1)
    index = frame_index(numbered.where(F.col("k") % every == 0))
    if is_frames(movie):
        return cut(_renumbered(movie, index), h, w, (0, h // dh * dh, dh), (0, w // dw * dw, dw))[0]
    few = movie.where((F.col("y") % dh == 0) & (F.col("x") % dw == 0) & (F.col("y") < h // dh * dh) & (F.col("x") < w // dw * dw))
    return _renumbered(few, index).withColumn("y", F.expr(f"cast(y div {dh} as int)")).withColumn("x", F.expr(f"cast(x div {dw} as int)"))


def trim_frames(movie: DataFrame, start: int, end: int, percent: float) -> DataFrame:
    """Of each session the frames whose place is in [start, end), then the first int(n * (percent / 100)) of those; renumbered from 0.

    Both bounds are clamped to the session's frames, and a range that is empty then leaves the session whole.
    """
    index = frame_index(movie)
    n = index.groupBy("session").agg(F.count("*").alias("n"))
    s, e = F.least(F.lit(max(start, 0)), F.col("n")), F.least(F.lit(end), F.col("n"))
    range_ = n.select("session", F.when(e > s, s).otherwise(0).alias("first"), F.when(e > s, e - s).otherwise(F.col("n")).alias("held"))
    range_ = range_.select("session", "first", F.least("held", F.floor(F.col("held") * F.lit(percent / 100.0))).alias("keep"))
    place = F.col("new_frame") - F.col("first")
    kept = index.join(range_, "session").where((place >= 0) & (place < F.col("keep"))).select("session", "frame", place.cast("long").alias("new_frame"))
    return _renumbered(movie, kept)


def blank_fill(movie: DataFrame, expected: DataFrame) -> DataFrame:
    """Frames missing of the expected (session, n_frames, h, w) become zeros."""
    frames = expected.select("session", "h", "w", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_frames") - 1)).alias("frame"))
    gone = frames.join(movie.select("session", "frame").distinct(), FRAME, "left_anti")
    blank = gone.select("session", "frame", "w", F.explode(F.sequence(F.lit(0), F.col("h") * F.col("w") - 1)).alias("p"))
    return movie.select("session", "frame", "y", "x", "v").unionByName(blank.select("session", "frame", F.expr("cast(p div w as int)").alias("y"), (F.col("p") % F.col("w")).alias("x"), F.lit(0.0).alias("v")))


def luma(rgb: DataFrame) -> DataFrame:
    """Grey value of columns r, g, b by the BT.601 weights."""
    return rgb.withColumn("v", 0.299 * F.col("r") + 0.587 * F.col("g") + 0.114 * F.col("b")).drop("r", "g", "b")


def ingest_report(manifest: DataFrame, read: DataFrame) -> DataFrame:
    """Per file its issues: no frames, under 95 % of the expected, corrupt frames; with its place in the stream."""
    both = manifest.join(read, ["session", "file"], "left").withColumn("n_read", F.coalesce("n_read", F.lit(0))).withColumn("n_corrupt", F.coalesce("n_corrupt", F.lit(0)))
    issue = F.concat_ws("; ", F.when(F.col("n_read") == 0, "no frames"), F.when((F.col("n_read") > 0) & (F.col("n_read") < 0.95 * F.col("n_frames")), "frames missing"), F.when(F.col("n_corrupt") > 0, "corrupt frames"))
    return both.select("session", "file", "n_frames", "n_read", F.col("offset").alias("first_frame"), (F.col("offset") + F.col("n_frames") - 1).alias("last_frame"), issue.alias("issues"))


def frame_index(frames: DataFrame, bad: DataFrame | None = None, block: int = 1000) -> DataFrame:
    """Map of frames, without the bad ones, to 0..n-1 in each session (frame, new_frame), from counts of blocks: no window holds a whole session."""
    kept = frames.select("session", "frame").distinct()
    kept = (kept if bad is None else kept.join(bad, FRAME, "left_anti")).withColumn("block", F.expr(f"frame div {block}"))
    before = W.partitionBy("session").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    offsets = kept.groupBy("session", "block").count().withColumn("offset", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    within = F.row_number().over(W.partitionBy("session", "block").orderBy("frame")) - 1
    return kept.withColumn("k", within).join(offsets, ["session", "block"]).select("session", "frame", (F.col("offset") + F.col("k")).cast("long").alias("new_frame"))


def frame_reindex(movie: DataFrame, bad: DataFrame) -> DataFrame:
    """The movie without its bad frames, renumbered; original_frame keeps the old number."""
    made = movie.join(frame_index(movie, bad), FRAME)
    return made.withColumnRenamed("frame", "original_frame").withColumnRenamed("new_frame", "frame")


def session_catalog(paths: DataFrame, start_animal: int = 0, start_session: int = 0) -> DataFrame:
    """animal, session number and label from the last folder of a path: <int>_<int>... or T<int>...; from a label on, in numeric order."""
    last = F.element_at(F.filter(F.split("path", "/"), lambda p: p != ""), -1)
    made = paths.withColumn("folder", last)
    pair = F.col("folder").rlike(r"^\d+_\d+")
    made = made.withColumn("animal", F.when(pair, F.regexp_extract("folder", r"^(\d+)_(\d+)", 1)).when(F.col("folder").rlike(r"^T\d+"), F.lit("0")).cast("long"))
    made = made.withColumn("number", F.when(pair, F.regexp_extract("folder", r"^(\d+)_(\d+)", 2)).when(F.col("folder").rlike(r"^T\d+"), F.regexp_extract("folder", r"^T(\d+)", 1)).cast("long"))
    found = made.where("animal is not null and number is not null")
    later = (F.col("animal") > start_animal) | ((F.col("animal") == start_animal) & (F.col("number") >= start_session))
    return found.where(later).select("path", "animal", "number", F.concat_ws("_", F.col("animal").cast("string"), F.col("number").cast("string")).alias("label"))


def params_load(raw: DataFrame) -> DataFrame:
    """One row per (session, step, param) of nested JSON in column json: {"steps": {step: {param: value}}}."""
    steps = F.from_json("json", "struct<steps:map<string,map<string,string>>>")["steps"]
    each = raw.select("session", F.explode(steps).alias("step", "params"))
    return each.select("session", "step", F.explode("params").alias("param", "value"))


def params_merge(saved: DataFrame, new: DataFrame, unsettable: list[str] = ()) -> DataFrame:
    """New values over saved ones. An empty, 0 or null new value loses to a non-empty saved one, false loses to a saved true unless the parameter is listed; a scoped override (column scoped in new) always wins."""
    keys = ["session", "step", "param"]
    both = saved.withColumnRenamed("value", "old").join(new.select(*keys, F.col("value").alias("now"), "scoped"), keys, "full_outer")
    empty = F.col("now").isNull() | F.col("now").isin("", "0", "0.0", "null")
    filled = F.col("old").isNotNull() & ~F.col("old").isin("", "0", "0.0", "null")
    downgrade = (F.col("now") == "false") & (F.col("old") == "true") & ~F.col("param").isin(*unsettable) if unsettable else (F.col("now") == "false") & (F.col("old") == "true")
    value = F.when(F.coalesce("scoped", F.lit(False)), F.col("now")).when((empty & filled) | F.coalesce(downgrade, F.lit(False)), F.col("old")).otherwise(F.coalesce("now", "old"))
    return both.select(*keys, value.alias("value"))


def write_movie(movie: DataFrame, path: str, layout: str = "frames", block: int = 1000, tile: int = 64) -> None:
    """Parquet in blocks of frames, or of frames by spatial tile; range-partitioned, so that a partition writes few files."""
    made = movie.withColumn("block", F.expr(f"frame div {block}"))
    keys = ["session", "block"]
    if layout == "tiles":
        made = made.withColumn("tile_y", F.expr(f"y div {tile}")).withColumn("tile_x", F.expr(f"x div {tile}"))
        keys = ["session", "tile_y", "tile_x", "block"]
    made.repartitionByRange(*keys, "frame").sortWithinPartitions(*keys, "frame", "y", "x").write.mode("overwrite").partitionBy(*keys).parquet(path)


def read_movie(spark, path: str) -> DataFrame:
    return spark.read.parquet(path).select(F.col("session").cast("string").alias("session"), "frame", "y", "x", "v")


def movie_round_trip(movie: DataFrame, layout: str) -> DataFrame:
    path = new_dir(movie.sparkSession, f"movie-{layout}")
    write_movie(movie, path, layout, block=100, tile=4)
    return read_movie(movie.sparkSession, path)
