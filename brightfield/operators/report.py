"""Reports on runs and curation of units."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from brightfield.operators.base import FRAME, PIXEL, UNIT, finite


def step_counts(counts: DataFrame, steps: list[str]) -> DataFrame:
    """Sessions by steps: the count of the latest run of each."""
    last = counts.groupBy("session", "step").agg(F.max_by("n", "run").alias("n"))
    return last.groupBy("session").pivot("step", steps).agg(F.first("n"))


def qc_alignment(footprints: DataFrame, traces: DataFrame, rate: float = 10.0) -> DataFrame:
    """Per session: units of either table, empty footprints, traces that are not finite or all zero, whether ids agree, and minutes recorded."""
    a = footprints.groupBy(*UNIT).agg(F.max("a").alias("peak"))
    c = traces.groupBy(*UNIT).agg(F.count_if(~finite(F.col("v"))).alias("odd"), F.count_if(F.col("v") != 0).alias("live"))
    both = a.withColumn("has_a", F.lit(True)).join(c.withColumn("has_c", F.lit(True)), UNIT, "full_outer")
    made = both.groupBy("session").agg(F.count("has_a").alias("n_footprints"), F.count("has_c").alias("n_traces"), F.count_if(F.col("has_a") & (F.col("peak") <= 0)).alias("n_empty"), F.count_if(F.col("has_c") & (F.col("odd") > 0)).alias("n_odd"), F.count_if(F.col("has_c") & (F.col("live") == 0)).alias("n_silent"), F.count_if(F.col("has_a") & F.col("has_c")).alias("n_common"))
    mode = F.when((F.col("n_common") == F.col("n_footprints")) & (F.col("n_common") == F.col("n_traces")), "exact").when(F.col("n_common") > 0, "by id").otherwise("none")
    minutes = traces.groupBy("session").agg((F.countDistinct("frame") / rate / 60).alias("minutes"))
    return made.withColumn("alignment", mode).join(minutes, "session", "left")


def qc_scale(traces: DataFrame, mode: str = "range") -> DataFrame:
    """Traces scaled to 0..0.9 by their range, or z-scores; a flat trace is 0."""
    s = traces.groupBy(*UNIT).agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.avg("v").alias("m"), F.stddev_pop("v").alias("s"))
    if mode == "range":
        v = F.when(F.col("hi") > F.col("lo"), (F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * 0.9).otherwise(0.0)
    else:
        v = F.when(F.col("s") > 0, (F.col("v") - F.col("m")) / F.col("s")).otherwise(0.0)
    return traces.join(s, UNIT).select(*UNIT, "frame", v.alias("v"))


FAILED = r"^Step (\S+) (failed|incomplete)"


def failure_scan(lines: DataFrame) -> DataFrame:
    """(session, line_no, step, status, error): failed or incomplete steps of ordered log lines with the last error text before them; a text serves one step."""
    step = F.regexp_extract("text", FAILED, 1)
    status = F.regexp_extract("text", FAILED, 2)
    error = F.when(F.col("text").rlike("(?i)error|exception|traceback"), F.col("text"))
    marked = lines.withColumn("step", step).withColumn("status", status).withColumn("is_step", F.col("status") != "").withColumn("err", F.when(F.col("status") == "", error))
    by = W.partitionBy("session").orderBy("line_no")
    # what follows a failed step up to the next one is a group of its own
    grouped = marked.withColumn("part", F.sum(F.col("is_step").cast("int")).over(by.rowsBetween(W.unboundedPreceding, -1)))
    grouped = grouped.withColumn("part", F.coalesce("part", F.lit(0)))
    last = F.last("err", ignorenulls=True).over(W.partitionBy("session", "part").orderBy("line_no").rowsBetween(W.unboundedPreceding, 0))
    return grouped.withColumn("error", last).where("is_step").select("session", "line_no", "step", "status", "error")


def failure_counts(failures: DataFrame) -> DataFrame:
    return failures.groupBy("step", "status").agg(F.count("*").alias("n"))


def batch_summary(catalog: DataFrame, runs: DataFrame) -> DataFrame:
    """Per catalogued session: status (OK, FAILED, TIMEOUT or MISSING) and minutes of its last run."""
    last = runs.groupBy("label").agg(F.max_by(F.struct("code", "seconds", "timed_out"), "run").alias("r"))
    status = F.when(F.col("r").isNull(), "MISSING").when(F.col("r.timed_out"), "TIMEOUT").when(F.col("r.code") != 0, "FAILED").otherwise("OK")
    return catalog.join(last, "label", "left").select("label", status.alias("status"), (F.coalesce(F.col("r.seconds"), F.lit(0.0)) / 60).alias("minutes"))


def batch_totals(summary: DataFrame) -> DataFrame:
    return summary.agg(F.count("*").alias("sessions"), F.count_if(F.col("status") == "OK").alias("ok"), F.count_if(F.col("status") != "OK").alias("attention"), F.sum("minutes").alias("minutes"))


def smooth_trace(traces: DataFrame, window: int, method: str) -> DataFrame:
    """Traces smoothed by 'gaussian' (sigma window / 6, taps to 4 sigma, mirrored), 'moving' (edge values repeated), 'exponential' (alpha 2 / (window + 1)) or 'both' (exponential forward, then backward)."""
    if method in ("exponential", "both"):
        alpha = 2.0 / (window + 1)

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("frame")
            out = _exponential(pdf["v"].to_numpy(), alpha)
            if method == "both":
                out = _exponential(out[::-1], alpha)[::-1]
            return pdf[["session", "unit_id", "frame"]].assign(v=out)

        return traces.groupBy(*UNIT).applyInPandas(run, "session string, unit_id long, frame long, v double")
    n = traces.groupBy(*UNIT).agg(F.min("frame").alias("first"), F.max("frame").alias("last"))
    if method == "gaussian":
        sigma = window / 6.0
        reach = int(4 * sigma + 0.5)
        taps = [(d, math.exp(-d * d / (2 * sigma * sigma))) for d in range(-reach, reach + 1)]
    else:
        taps = [(d, 1.0) for d in range(-(window // 2), window - window // 2)]
    total = sum(g for _, g in taps)
    table = F.explode(F.array(*(F.struct(F.lit(d).alias("d"), F.lit(g / total).alias("g")) for d, g in taps)))
    want = traces.select(*UNIT, F.col("frame").alias("to"), table.alias("o")).join(n, UNIT)
    at = F.col("to") + F.col("o.d")
    if method == "gaussian":
        at = F.when(at < F.col("first"), 2 * F.col("first") - 1 - at).when(at > F.col("last"), 2 * F.col("last") + 1 - at).otherwise(at)
    else:
        at = F.greatest(F.col("first"), F.least(F.col("last"), at))
    pulled = want.select(*UNIT, "to", at.alias("frame"), F.col("o.g").alias("g"))
    return pulled.join(traces, [*UNIT, "frame"]).groupBy(*UNIT, F.col("to").alias("frame")).agg(F.sum(F.col("g") * F.col("v")).alias("v"))


def _exponential(v: np.ndarray, alpha: float) -> np.ndarray:
    out = np.empty(len(v))
    for i, x in enumerate(v):
        out[i] = x if i == 0 else alpha * x + (1 - alpha) * out[i - 1]
    return out


def thin_zscore(traces: DataFrame, t0: float, t1: float, fps: float, every: int = 1) -> DataFrame:
    """(session, unit_id, seconds, v): every n-th frame with t0 <= seconds < t1, as z-scores of what is kept; flat traces are 0."""
    kept = traces.where((F.col("frame") / fps >= t0) & (F.col("frame") / fps < t1) & (F.col("frame") % every == 0))
    s = kept.groupBy(*UNIT).agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"))
    return kept.join(s, UNIT).select(*UNIT, (F.col("frame") / fps).alias("seconds"), F.when(F.col("s") > 0, (F.col("v") - F.col("m")) / F.col("s")).otherwise(0.0).alias("v"))


def dominant_unit(footprints: DataFrame, peak: float = 0.8) -> DataFrame:
    """(session, y, x, a, unit_id): footprints scaled to a common peak, their maximum and the unit that has it (smallest id on ties)."""
    top = footprints.groupBy(*UNIT).agg(F.max("a").alias("top"))
    scaled = footprints.join(top, UNIT).where("top > 0").select(*UNIT, "y", "x", (F.col("a") / F.col("top") * peak).alias("a"))
    return scaled.groupBy(*PIXEL).agg(F.max("a").alias("a"), F.max_by("unit_id", F.struct("a", (-F.col("unit_id")).alias("n"))).alias("unit_id"))


def area_at(footprints: DataFrame, share: float = 0.2) -> DataFrame:
    """(session, unit_id, area): pixels above share * peak."""
    top = footprints.groupBy(*UNIT).agg(F.max("a").alias("top"))
    return footprints.join(top, UNIT).groupBy(*UNIT).agg(F.count_if(F.col("a") > share * F.col("top")).alias("area"))


def activity_image(footprints: DataFrame, traces: DataFrame, frames: list[int], brightness: float = 1.0, share: float = 0.05) -> DataFrame:
    """(session, frame, y, x, v): at each frame activity scaled over units to 0..1, over brightness, at most 1, times the footprint clamped to 1 where above share of its peak; the greatest over units."""
    c = traces.where(F.col("frame").isin(frames))
    s = c.groupBy(*FRAME).agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    level = c.join(s, FRAME).select(*UNIT, "frame", F.when(F.col("hi") > F.col("lo"), F.least(F.lit(1.0), (F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) / brightness)).otherwise(0.0).alias("level"))
    top = footprints.groupBy(*UNIT).agg(F.max("a").alias("top"))
    shape = footprints.join(top, UNIT).where(F.col("a") > share * F.col("top")).select(*UNIT, "y", "x", F.least(F.lit(1.0), F.col("a")).alias("a"))
    return shape.join(level, UNIT).groupBy(*FRAME, "y", "x").agg(F.max(F.col("a") * F.col("level")).alias("v"))


def hide_units(df: DataFrame, hidden: DataFrame) -> DataFrame:
    """df without the hidden (session, unit_id); ids stay as they are."""
    return df.join(hidden.select(*UNIT), UNIT, "left_anti")
