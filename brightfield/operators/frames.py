"""Frame quality: artifacts, motion outliers, validation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brightfield.operators import order
from brightfield.operators.arrays import small
from brightfield.operators.base import FRAME, finite
from brightfield.sources.storage import materialize


def linesplit_basic(movie: DataFrame, cols: int = 20, k: float = 2.0) -> DataFrame:
    """Frames whose mean over the left columns exceeds the session's mean of that series by k population deviations."""
    left = movie.where(F.col("x") < cols).groupBy(*FRAME).agg(F.avg("v").alias("left_mean"))
    stats = left.groupBy("session").agg(F.avg("left_mean").alias("m"), F.stddev_pop("left_mean").alias("s"))
    return left.join(stats, "session").where(F.col("left_mean") > F.col("m") + k * F.col("s")).select("session", "frame", "left_mean")


def linesplit_scores(movie: DataFrame, sigma: float, percent: float, c0: float, c1: float) -> DataFrame:
    """Per frame the deviation of its row profile from the profile's Gaussian trend.

    Rows count whose mean over the movie exceeds `percent` of the largest; columns are the central share
    [W * c0, W * c1). The trend's weights reach 4 sigma and are normalised over the rows that exist.
    """
    rows = movie.groupBy("session", "y").agg(F.avg("v").alias("m"))
    top = rows.groupBy("session").agg(F.max("m").alias("top"))
    signal = rows.join(top, "session").where(F.col("m") > percent * F.col("top")).groupBy("session").agg(F.sort_array(F.collect_list("y")).alias("ys")).select("session", F.posexplode("ys").alias("r", "y"))
    width = movie.groupBy("session").agg((F.max("x") + 1).alias("w"))
    central = movie.join(width, "session").where((F.col("x") >= F.floor(F.col("w") * c0)) & (F.col("x") < F.floor(F.col("w") * c1)))
    profile = central.join(signal, ["session", "y"]).groupBy("session", "frame", "r").agg(F.avg("v").alias("p"))
    reach = int(4 * sigma + 0.5)
    near = profile.select("session", "frame", "r", "p", F.explode(F.sequence(F.lit(-reach), F.lit(reach))).alias("d"))
    spread = near.select("session", "frame", (F.col("r") + F.col("d")).alias("r"), F.exp(-(F.col("d") * F.col("d")) / (2.0 * sigma * sigma)).alias("g"), "p")
    trend = spread.groupBy("session", "frame", "r").agg((F.sum(F.col("g") * F.col("p")) / F.sum("g")).alias("t"))
    return profile.join(trend, ["session", "frame", "r"]).groupBy(*FRAME).agg(F.stddev_pop(F.col("p") - F.col("t")).alias("score"))


def gap_threshold(scores: DataFrame) -> DataFrame:
    """Per session the middle of the largest gap within the lowest 99 % of sorted scores; of equal gaps the lowest.

    Scores that are no finite number take no part; a session with fewer than three others has no threshold. The
    table is read several times and is stored first, unless it is already.
    """
    stored = scores if hasattr(scores, "stored_at") else materialize(scores.select("session", "score"), "scores")
    real = stored.where(finite(F.col("score"))).select("session", "score")
    ranks = real.groupBy("session").agg(F.floor(0.99 * F.count("*")).alias("k")).where("k > 1")
    top = order.value_at_rank(real, ranks, "score")
    low = real.join(small(top), "session").where(F.col("score") <= F.col("value")).select("session", "score")
    return order.largest_gap(low, "score").withColumnRenamed("middle", "threshold")


def linesplit_advanced(movie: DataFrame, sigma: float = 2.0, percent: float = 0.1, c0: float = 0.25, c1: float = 0.75, threshold: float | None = None) -> DataFrame:
    """Frames whose score exceeds the threshold, given or found in the largest gap."""
    scores = linesplit_scores(movie, sigma, percent, c0, c1)
    if threshold is not None:
        return scores.where(F.col("score") > threshold)
    scores = materialize(scores, "scores")
    return scores.join(small(gap_threshold(scores)), "session").where("score > threshold").select("session", "frame", "score")


def motion_outliers(motion: DataFrame, k: float = 5.0) -> DataFrame:
    """Frames with |dy| > mean(dy) + k * std(dy), or so for dx: signed mean, population deviation, one side of the absolute value."""
    stats = motion.groupBy("session").agg(F.avg("dy").alias("my"), F.stddev_pop("dy").alias("sy"), F.avg("dx").alias("mx"), F.stddev_pop("dx").alias("sx"))
    bad = (F.abs("dy") > F.col("my") + k * F.col("sy")) | (F.abs("dx") > F.col("mx") + k * F.col("sx"))
    return motion.join(stats, "session").where(bad).select("session", "frame")


def motion_abs_limits(motion: DataFrame, k: float = 5.0, dy: tuple = (None, None), dx: tuple = (None, None)) -> DataFrame:
    """Motion outliers and the frames outside the optional limits."""
    outside = F.lit(False)
    for name, (low, high) in (("dy", dy), ("dx", dx)):
        if low is not None:
            outside = outside | (F.col(name) < low)
        if high is not None:
            outside = outside | (F.col(name) > high)
    return motion_outliers(motion, k).union(motion.where(outside).select("session", "frame")).distinct()


def removed_frames(index: DataFrame, bad: DataFrame, split: DataFrame) -> DataFrame:
    """One list in original numbering: bad frames (new numbering) through the index, and line-split ones; reason is 'motion', 'split' or both."""
    moved = bad.withColumnRenamed("frame", "new_frame").join(index, ["session", "new_frame"]).select("session", "frame", F.lit("motion").alias("reason"))
    return moved.union(split.select("session", "frame", F.lit("split").alias("reason"))).distinct().groupBy(*FRAME).agg(F.concat_ws(",", F.array_sort(F.collect_set("reason"))).alias("reason"))


def movie_validate(movie: DataFrame, every: int = 1) -> DataFrame:
    """Per session: means of the pixels' means and deviations over frames, extremes, and the count and percentage of values that are no numbers."""
    real = ~(F.isnan("v") | F.col("v").isin(float("inf"), float("-inf")))
    sample = movie.where(F.col("frame") % every == 0)
    pixel = sample.groupBy("session", "y", "x").agg(F.avg(F.when(real, F.col("v"))).alias("m"), F.stddev_pop(F.when(real, F.col("v"))).alias("s"), F.min(F.when(real, F.col("v"))).alias("lo"), F.max(F.when(real, F.col("v"))).alias("hi"), F.count_if(~real).alias("odd"), F.count("*").alias("n"))
    return pixel.groupBy("session").agg(F.avg("m").alias("mean"), F.avg("s").alias("std"), F.min("lo").alias("min"), F.max("hi").alias("max"), F.sum("odd").alias("n_odd"), (100.0 * F.sum("odd") / F.sum("n")).alias("percent_odd"))


def nan_guard(df: DataFrame, columns: list[str]) -> DataFrame:
    """NaN, infinities and nulls of the columns become 0; n_replaced counts them in each row."""
    odd = [F.isnan(c) | F.col(c).isin(float("inf"), float("-inf")) | F.col(c).isNull() for c in columns]
    counted = df.withColumn("n_replaced", sum((o.cast("int") for o in odd), F.lit(0)))
    return counted.withColumns({c: F.when(o, F.lit(0.0)).otherwise(F.col(c)) for c, o in zip(columns, odd, strict=True)})

