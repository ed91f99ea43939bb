"""Trace extraction, normalisation and the temporal update."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from brightfield.functions.kernels import ar_coefficients, deconvolve_all, power
from brightfield.operators.arrays import lists, small, unit_sums
from brightfield.operators.base import FRAME, PIXEL, UNIT, finite


def extract_traces(movie: DataFrame, footprints: DataFrame) -> DataFrame:
    """c[t, k] = sum over pixels of a / sum(a) * v; units whose weights sum to 0 are left out."""
    total = footprints.groupBy(*UNIT).agg(F.sum("a").alias("total")).where("total <> 0")
    weight = footprints.join(total, UNIT).select(*UNIT, "y", "x", (F.col("a") / F.col("total")).alias("g"))
    return unit_sums(movie, weight)


def trace_stats(traces: DataFrame) -> DataFrame:
    return traces.groupBy(*UNIT).agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.max("v").alias("max"), F.min("v").alias("min"), (F.max("v") - F.min("v")).alias("range"))


def trace_stats_averages(traces: DataFrame) -> DataFrame:
    return trace_stats(traces).groupBy("session").agg(*(F.avg(c).alias(c) for c in ("mean", "std", "max", "min", "range")))


def footprint_norms(footprints: DataFrame, mode: str) -> DataFrame:
    how = {"max": F.max("a"), "l1": F.sum(F.abs("a")), "l2": F.sqrt(F.sum(F.col("a") ** 2))}[mode]
    return footprints.groupBy(*UNIT).agg(how.alias("norm"))


def normalize_footprints(footprints: DataFrame, traces: DataFrame, mode: str = "max") -> tuple[DataFrame, DataFrame]:
    """Footprints over their norm and traces times it; a norm of 0 or less leaves the footprint, the trace is multiplied all the same."""
    norms = footprint_norms(footprints, mode)
    a = footprints.join(norms, UNIT).select(*PIXEL, "unit_id", F.when(F.col("norm") > 0, F.col("a") / F.col("norm")).otherwise(F.col("a")).alias("a"))
    return a, traces.join(norms, UNIT).select(*UNIT, "frame", (F.col("v") * F.col("norm")).alias("v"))


def select_components(footprints: DataFrame, traces: DataFrame, least: int, most_units: int, background: int | None = 0) -> DataFrame:
    """(session, unit_id) that are not the background, have `least` pixels or more and no value that is no number, the first most_units by id."""
    a = footprints.groupBy(*UNIT).agg(F.count("*").alias("size"), F.count_if(~finite(F.col("a"))).alias("odd_a"))
    c = traces.groupBy(*UNIT).agg(F.count_if(~finite(F.col("v"))).alias("odd_c"))
    good = a.join(c, UNIT).where((F.col("size") >= least) & (F.col("odd_a") == 0) & (F.col("odd_c") == 0))
    if background is not None:
        good = good.where(F.col("unit_id") != background)
    return good.withColumn("k", F.row_number().over(W.partitionBy("session").orderBy("unit_id"))).where(F.col("k") <= most_units).select(*UNIT)


def degenerate_flags(footprints: DataFrame, traces: DataFrame) -> DataFrame:
    """Per unit the first reason to drop it, else null: nan, empty or flat."""
    a = footprints.groupBy(*UNIT).agg(F.count_if(~finite(F.col("a"))).alias("odd_a"), F.max("a").alias("peak"))
    c = traces.groupBy(*UNIT).agg(F.count_if(~finite(F.col("v"))).alias("odd_c"), F.stddev_pop("v").alias("std"))
    both = a.join(c, UNIT, "full_outer")
    reason = F.when((F.coalesce("odd_a", F.lit(0)) > 0) | (F.coalesce("odd_c", F.lit(0)) > 0), "nan").when(F.coalesce("peak", F.lit(0.0)) <= 0, "empty").when(F.coalesce("std", F.lit(0.0)) < 1e-10, "flat")
    return both.select(*UNIT, reason.alias("reason"))


def drop_degenerate(footprints: DataFrame, traces: DataFrame, most_units: int | None = None) -> DataFrame:
    """(session, unit_id) of the units without a reason to drop them, the first most_units by id."""
    good = degenerate_flags(footprints, traces).where("reason is null").select(*UNIT)
    if most_units is None:
        return good
    return good.withColumn("k", F.row_number().over(W.partitionBy("session").orderBy("unit_id"))).where(F.col("k") <= most_units).select(*UNIT)


def project_yra(movie: DataFrame, footprints: DataFrame, b: DataFrame, f: DataFrame) -> DataFrame:
    """sum over pixels of a * v minus f * (sum of a * b); no other unit's part is subtracted."""
    ay = unit_sums(movie, footprints.select(*UNIT, "y", "x", F.col("a").alias("g"))).withColumnRenamed("v", "ay")
    ab = footprints.join(b, PIXEL).groupBy(*UNIT).agg(F.sum(F.col("a") * F.col("b")).alias("ab"))
    return ay.join(ab, UNIT, "left").join(small(f), FRAME).select(*UNIT, "frame", (F.col("ay") - F.coalesce("ab", F.lit(0.0)) * F.col("f")).alias("v"))


def frame_window(traces: DataFrame, n_frames: int, mode: str, seed: int = 0) -> DataFrame:
    """n_frames frames of each session from the start, middle, end or a seeded place; highest_variance acts as middle."""
    span = traces.groupBy("session").agg(F.min("frame").alias("lo"), (F.max("frame") + 1).alias("hi"))
    room = F.greatest(F.col("hi") - F.col("lo") - n_frames, F.lit(0))
    start = {"start": F.lit(0), "end": room, "random": F.pmod(F.xxhash64("session", F.lit(seed)), room + 1)}.get(mode, F.expr(f"greatest(hi - lo - {n_frames}, 0) div 2"))
    return traces.join(span.select("session", (F.col("lo") + start).alias("from")), "session").where((F.col("frame") >= F.col("from")) & (F.col("frame") < F.col("from") + n_frames)).drop("from")


def choose_units(scores: DataFrame, n: int, mode: str = "random", seed: int = 0) -> DataFrame:
    """(session, unit_id) of n units of each session from their scores (session, unit_id, size, snr): 'random' by seed, 'best_snr', 'worst_snr', 'largest' or 'smallest'; ties by id.

    A random choice is the first n by a hash of id and seed, so that it depends on neither order nor partitions.
    """
    keys = {"random": [F.xxhash64("session", "unit_id", F.lit(seed))], "best_snr": [F.desc("snr")], "worst_snr": [F.asc("snr")], "largest": [F.desc("size")], "smallest": [F.asc("size")]}[mode]
    nth = F.row_number().over(W.partitionBy("session").orderBy(*keys, "unit_id"))
    return scores.withColumn("nth", nth).where(F.col("nth") <= n).select(*UNIT)


def pair_correlations(traces: DataFrame) -> DataFrame:
    """(session, u1, u2, r) of all pairs of the units given: a sampled few."""
    a = traces.select("session", F.col("unit_id").alias("u1"), "frame", F.col("v").alias("x"))
    b = traces.select("session", F.col("unit_id").alias("u2"), "frame", F.col("v").alias("y"))
    return a.join(b, FRAME).where("u1 < u2").groupBy("session", "u1", "u2").agg(F.corr("x", "y").alias("r"))


def yra_validate(yra: DataFrame, units: DataFrame, n_frames: int, mode: str = "middle") -> DataFrame:
    """Per session of the sampled units and frames: mean, deviation and extremes, and mean and median of the pairs' correlations."""
    sample = frame_window(yra.join(units, UNIT, "left_semi"), n_frames, mode)
    stats = sample.groupBy("session").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.min("v").alias("min"), F.max("v").alias("max"))
    r = pair_correlations(sample).groupBy("session").agg(F.avg("r").alias("mean_r"), F.percentile("r", F.lit(0.5)).alias("median_r"))
    return stats.join(r, "session", "left")


def normalize_trace(traces: DataFrame) -> DataFrame:
    stats = traces.groupBy(*UNIT).agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"))
    return traces.join(stats, UNIT).select(*UNIT, "frame", ((F.col("v") - F.col("m")) / (F.col("s") + 1e-8)).alias("v"))


def noise_psd(traces: DataFrame) -> DataFrame:
    """(session, unit_id, sigma): root of the mean power at frequencies above 0.25 over n; that of the differences over sqrt(2) where there is no such frequency."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        v = pdf.sort_values("frame")["v"].to_numpy()
        n = len(v)
        high = power(v)[np.arange(n // 2 + 1) / n > 0.25]
        sigma = np.sqrt(high.mean() / n) if len(high) else (np.diff(v).std() / np.sqrt(2) if n > 1 else 0.0)
        return pd.DataFrame({"session": [pdf["session"].iloc[0]], "unit_id": [pdf["unit_id"].iloc[0]], "sigma": [float(sigma)]})

    return traces.groupBy(*UNIT).applyInPandas(run, "session string, unit_id long, sigma double")


def ar_coeffs(traces: DataFrame, p: int, segment: int = 1000) -> DataFrame:
    """(session, unit_id, g): AR(p) coefficients, the median of Yule-Walker solutions by whole segment of the centred trace, shrunk by 0.95 until stable."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        g = ar_coefficients(pdf.sort_values("frame")["v"].to_numpy(), p, segment)
        return pd.DataFrame({"session": [pdf["session"].iloc[0]], "unit_id": [pdf["unit_id"].iloc[0]], "g": [g.tolist()]})

    return traces.groupBy(*UNIT).applyInPandas(run, "session string, unit_id long, g array<double>")


def overlap_chunks(traces: DataFrame, size: int = 10000, overlap: int = 100) -> DataFrame:
    """Adds chunk, local (place in it) and n_chunks: windows of `size` frames every size - overlap, until the end is reached; a frame gets a row in each of its windows."""
    step = size - overlap
    n = traces.groupBy("session").agg((F.max("frame") + 1).alias("n")).select("session", F.greatest(F.lit(1), F.ceil((F.col("n") - size) / step) + 1).cast("long").alias("n_chunks"))
    last = F.least(F.expr(f"frame div {step}"), F.col("n_chunks") - 1)
    first = F.greatest(F.lit(0), F.ceil((F.col("frame") - size + 1) / step)).cast("long")
    return traces.join(n, "session").withColumn("chunk", F.explode(F.sequence(first, last))).withColumn("local", F.col("frame") - F.col("chunk") * step)


def merge_chunks(chunks: DataFrame, size: int, overlap: int, columns: list[str]) -> DataFrame:
    """Windows without half of the overlap at inner edges: one row a frame again. Units are joined by id, present in a window or not."""
    half = overlap // 2
    early = (F.col("chunk") == 0) | (F.col("local") >= half)
    late = (F.col("chunk") == F.col("n_chunks") - 1) | (F.col("local") < size - (overlap - half))
    return chunks.where(early & late).select(*UNIT, "frame", *columns)


def merge_ar(chunk_ar: DataFrame) -> DataFrame:
    """g averaged by lag over the windows that have it."""
    return chunk_ar.select(*UNIT, F.posexplode("g").alias("lag", "g")).groupBy(*UNIT, "lag").agg(F.avg("g").alias("g"))


#: Values of the windows that a task deconvolves at once, and rows that it gathers for them.
WINDOW_VALUES = 1 << 16
DECONVOLVED = "session string, unit_id long, frame long, chunk long, local long, n_chunks long, c double, s double, b double, c0 double, g array<double>, gap double, kkt double"


def deconvolve_chunks(chunks: DataFrame, p: int = 2, lam: float = 1e-2, iters: int = 5000, zero: float = 5e-4, tol: float = 1e-5) -> DataFrame:
    """Deconvolution of each unit's window: c, s and the baseline b + c0 * decay by frame, with the window's certificate.

    A window is done when its duality gap, as a share of its energy, is `tol` at most, or after `iters` rounds; see `certificates`.
    Windows of equal length are worked on together, at most WINDOW_VALUES values or one window at once.
    """
    keys = ["session", "unit_id", "chunk"]
    names = ["session", "unit_id", "frame", "chunk", "local", "n_chunks"]

    def solved(rows: pa.Table):
        """Batches of the windows, all whole, in rows sorted by window and frame."""
        v = rows.column("v").to_numpy()
        starts = _starts(rows)
        length = np.diff(np.append(starts, len(v)))
        for n in np.unique(length):
            windows = starts[length == n]
            some = max(1, WINDOW_VALUES // int(n))
            for first in range(0, len(windows), some):
                place = windows[first : first + some, None] + np.arange(n)
                y = v[place]
                g = np.array([ar_coefficients(x - x.mean(), p) if n > p + 1 else np.zeros(p) for x in y])
                high = power(y)[:, np.arange(n // 2 + 1) / n > 0.25]
                sigma = np.sqrt(high.mean(axis=1) / n) if high.shape[1] else np.zeros(len(y))
                made = deconvolve_all(y, g, sigma, lam, iters, zero, tol)
                wide = lambda k, n=n, made=made: pa.array(np.repeat(made[k], n))
                values = [pa.array(made["c"].ravel()), pa.array(made["s"].ravel()), wide("b"), pa.array((made["c0"][:, None] * made["decay"]).ravel()), lists(np.repeat(g, n, axis=0)), wide("gap"), wide("kkt")]
                mine = rows.select(names).take(pa.array(place.ravel())).combine_chunks()
                yield from pa.Table.from_arrays([*mine.columns, *values], names=[*names, "c", "s", "b", "c0", "g", "gap", "kkt"]).to_batches()

    def run(batches):
        held = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= WINDOW_VALUES:
                rows = pa.Table.from_batches(held)
                last = int(_starts(rows)[-1])  # the last window may go on in the next batch
                yield from solved(rows.slice(0, last))
                held = rows.slice(last).to_batches()
        if held:
            yield from solved(pa.Table.from_batches(held))

    rows = chunks.select(F.col("session").cast("string").alias("session"), *(F.col(c).cast("long").alias(c) for c in names[1:]), F.col("v").cast("double").alias("v"))
    return rows.repartition(*keys).sortWithinPartitions(*keys, "frame").mapInArrow(run, DECONVOLVED)


def _starts(rows: pa.Table) -> np.ndarray:
    """Where a window begins in rows sorted by window."""
    new = np.arange(rows.num_rows) == 0
    for name in ("session", "unit_id", "chunk"):
        code = rows.column(name).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
        new[1:] |= code[1:] != code[:-1]
    return np.flatnonzero(new)


def certificates(deconvolved: DataFrame) -> DataFrame:
    """(session, unit_id, chunk, frames, gap, kkt) of deconvolved windows: how far each is from its optimum at most, and its largest breach of the optimality conditions."""
    return deconvolved.groupBy(*UNIT, "chunk").agg(F.count("*").alias("frames"), F.max("gap").alias("gap"), F.max("kkt").alias("kkt"))


def temporal_update(yra: DataFrame, size: int = 10000, overlap: int = 100, p: int = 2, lam: float = 1e-2, iters: int = 500, zero: float = 5e-4, normalise: bool = True) -> DataFrame:
    """(session, unit_id, frame, c, s, b, c0): windows, deconvolution and merging; units whose spikes sum to `zero` or less are dropped."""
    traces = normalize_trace(yra) if normalise else yra
    merged = merge_chunks(deconvolve_chunks(overlap_chunks(traces, size, overlap), p, lam, iters, zero), size, overlap, ["c", "s", "b", "c0"])
    active = merged.groupBy(*UNIT).agg(F.sum("s").alias("total")).where(F.col("total") > zero)
    return merged.join(active, UNIT, "left_semi")


def suggest_temporal(footprints: DataFrame, traces: DataFrame, noise: DataFrame, yra: DataFrame, units: DataFrame) -> DataFrame:
    """Per session suggestions from sampled units: medians of noise, snr, lag-1 and lag-2 autocorrelation, crossing rate and agreement with the projection; then p, sparsity levels, iterations and zero thresholds."""
    a = footprints.join(units, UNIT, "left_semi").join(noise, PIXEL).groupBy(*UNIT).agg((F.sum(F.col("a") * F.col("sn")) / F.count("*")).alias("noise"))
    c = traces.join(units, UNIT, "left_semi")
    by = W.partitionBy(*UNIT).orderBy("frame")
    stats = c.groupBy(*UNIT).agg(F.stddev_pop("v").alias("std"), (F.percentile("v", F.lit(0.5)) + 2 * F.stddev_pop("v")).alias("level"), F.avg("v").alias("mean"))
    lagged = c.join(stats, UNIT).withColumn("l1", F.lag("v", 1).over(by)).withColumn("l2", F.lag("v", 2).over(by))
    acf = lambda lag: F.sum((F.col("v") - F.col("mean")) * (F.col(lag) - F.col("mean"))) / F.sum((F.col("v") - F.col("mean")) ** 2)
    cross = F.avg(((F.col("v") > F.col("level")) & (F.col("l1") <= F.col("level"))).cast("double"))
    shape = lagged.groupBy(*UNIT).agg(acf("l1").alias("r1"), acf("l2").alias("r2"), F.coalesce(cross, F.lit(0.0)).alias("rate"), F.first("std").alias("std"))
    agree = c.join(yra.withColumnRenamed("v", "w"), [*UNIT, "frame"]).groupBy(*UNIT).agg(F.corr("v", "w").alias("agree"))
    unit = shape.join(a, UNIT).join(agree, UNIT, "left").withColumn("snr", F.col("std") / F.greatest("noise", F.lit(1e-12)))
    mid = lambda x: F.percentile(x, F.lit(0.5)).alias(x)
    out = unit.groupBy("session").agg(*(mid(x) for x in ("noise", "snr", "r1", "r2", "rate", "agree")))
    snr = F.greatest("snr", F.lit(1e-6))
    return out.select("session", "noise", "snr", "r1", "r2", "rate", "agree", F.when(F.col("r2") > 0.5 * F.col("r1"), 2).otherwise(1).alias("p"), *((F.lit(x) / snr).alias(n) for n, x in (("sparse_high", 0.1), ("sparse_mid", 0.05), ("sparse_low", 0.01))), (200 + 300 * F.least(F.lit(1.0), 10 * F.col("rate"))).cast("long").alias("max_iters"), *((F.col("noise") * x).alias(n) for n, x in (("zero_low", 0.01), ("zero_mid", 0.05), ("zero_high", 0.1))))


def spike_summary(spikes: DataFrame) -> DataFrame:
    """Per unit the shares of positive and of zero spikes and whether fewer than 80 % are zero (column s)."""
    return spikes.groupBy(*UNIT).agg(F.avg((F.col("s") > 0).cast("double")).alias("active"), F.avg((F.col("s") == 0).cast("double")).alias("silent")).withColumn("dense", F.col("silent") < 0.8)


def spike_totals(spikes: DataFrame) -> DataFrame:
    return spike_summary(spikes).groupBy("session").agg(F.avg("silent").alias("sparsity"), F.count_if(F.col("active") > 0.2).alias("n_busy"))


def temporal_summary(deconvolved: DataFrame, ar: DataFrame, threshold: float = 1e-3) -> DataFrame:
    """Per session: mean, deviation and extremes of c, mean of s and share above the threshold, and mean g of the first two lags."""
    c = deconvolved.groupBy("session").agg(F.avg("c").alias("c_mean"), F.stddev_pop("c").alias("c_std"), F.min("c").alias("c_min"), F.max("c").alias("c_max"), F.avg("s").alias("s_mean"), F.avg((F.col("s") > threshold).cast("double")).alias("s_share"))
    g = ar.groupBy("session").agg(F.avg(F.when(F.col("lag") == 0, F.col("g"))).alias("g1"), F.avg(F.when(F.col("lag") == 1, F.col("g"))).alias("g2"))
    return c.join(g, "session", "left")
