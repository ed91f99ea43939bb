"""Queries of factors, traces, merging, rejection and noise."""

from __future__ import annotations

from pyspark.sql import functions as F

from brightfield.operators import factor as fa
from brightfield.operators import merge as me
from brightfield.operators import reject as re
from brightfield.operators import traces as tr
from brightfield.plans.image_queries import REFLECT, around, grid
from brightfield.plans.registry import query, rnd
from brightfield.sources import fixtures as fx

R = lambda e: f"round({e}, 6) + 0.0"


def rounded(df, *names):
    return df.withColumns({n: rnd(n) for n in names})


def deconvolved(spark, sf):
    """A stand-in for deconvolved traces: c is the day trace, s its increases."""
    d = fx.days(spark, sf)
    from pyspark.sql import Window as W

    return d.select("session", "unit_id", "frame", F.col("v").alias("c"), F.greatest(F.col("v") - F.coalesce(F.lag("v").over(W.partitionBy("session", "unit_id").orderBy("frame")), F.lit(0.0)), F.lit(0.0)).alias("s"))


DEC = "dec AS (SELECT session, unit_id, frame, v AS c, greatest(v - coalesce(lag(v) OVER (PARTITION BY session, unit_id ORDER BY frame), 0), 0) AS s FROM days)"


@query("d01_shift_nonneg", "WITH s AS (SELECT session, frame, y, x, CASE WHEN (frame + x) % 40 = 0 THEN 0.0 ELSE v END AS v FROM movie WHERE frame % 2 = 0) SELECT session, frame, y, x, round(v - min(v) OVER (PARTITION BY session) + 1e-6, 6) + 0.0 AS v FROM s", ("movie",))
def d01(spark, sf):
    m = fx.movie(spark, sf).withColumn("v", F.when((F.col("frame") + F.col("x")) % 40 == 0, float("nan")).otherwise(F.col("v")))
    return rounded(fa.shift_nonneg(m, 2), "v")


@query("d02_randomized_svd")
def d02(spark, sf):
    return rounded(fa.randomized_svd(fx.frames(spark, sf), 4), "value")


@query("d03_nndsvd")
def d03(spark, sf):
    return rounded(fa.nndsvd(fa.randomized_svd(fx.frames(spark, sf), 4), 8), "value")


@query("d04_background_spatial", "SELECT session, y, x, round(a, 6) + 0.0 AS b FROM foot WHERE unit_id = 0", ("foot",))
def d04(spark, sf):
    return rounded(fa.background_factor(fx.footprints(spark, sf), fx.traces(spark, sf))[0], "b")


@query("d04_background_temporal", "SELECT session, frame, round(v, 6) + 0.0 AS f FROM traces WHERE unit_id = 0", ("traces",))
def d04f(spark, sf):
    return rounded(fa.background_factor(fx.footprints(spark, sf), fx.traces(spark, sf))[1], "f")


@query("d05_component_stats", f"""WITH a AS (SELECT session, unit_id, count(*) AS size, max(a) AS peak, sum(a * a) AS a2 FROM foot GROUP BY 1, 2), c AS (SELECT session, unit_id, stddev_pop(v) AS trace_std, sum(v * v) AS c2 FROM traces GROUP BY 1, 2),
e AS (SELECT *, a2 * c2 AS energy FROM a JOIN c USING (session, unit_id))
SELECT session, unit_id, size, {R('peak')} AS peak, {R('trace_std')} AS trace_std, {R('energy')} AS energy, {R('sum(energy) OVER (PARTITION BY session ORDER BY energy DESC, unit_id ROWS UNBOUNDED PRECEDING) / sum(energy) OVER (PARTITION BY session)')} AS explained FROM e""", ("traces",))
def d05(spark, sf):
    return rounded(fa.component_stats(fx.footprints(spark, sf), fx.traces(spark, sf)), "peak", "trace_std", "energy", "explained")


@query("d05_overlap_map", "SELECT session, y, x, count(*) AS n_units FROM foot GROUP BY ALL", ("foot",))
def d05m(spark, sf):
    return fa.overlap_map(fx.footprints(spark, sf))


_DFT = "dft AS (SELECT session, unit_id, k, (sum(v * cos(2 * pi() * k * frame / 30)) ** 2 + sum(v * sin(2 * pi() * k * frame / 30)) ** 2) AS p FROM {src} CROSS JOIN (SELECT unnest(range(0, 16)) AS k) GROUP BY ALL)"


@query("d06_power_spectrum", f"WITH {_DFT.format(src='days')} SELECT session, unit_id, k, {R('p / 30')} AS power FROM dft WHERE k > 0", ("days",))
def d06(spark, sf):
    return rounded(fa.power_spectrum(fx.days(spark, sf)), "power")


_X01 = "x01 AS (SELECT session, unit_id, frame, sum(a / t * v) AS v FROM movie JOIN foot USING (session, y, x) JOIN (SELECT session, unit_id, sum(a) AS t FROM foot GROUP BY 1, 2) USING (session, unit_id) GROUP BY ALL)"


@query("x01_extract_traces", f"WITH {_X01} SELECT session, unit_id, frame, round(v, 6) + 0.0 AS v FROM x01", ("movie", "foot"))
def x01(spark, sf):
    return rounded(tr.extract_traces(fx.frames(spark, sf), fx.footprints(spark, sf)), "v")


_STATS = ("mean", "std", "max", "min", "range")
_X02 = "st AS (SELECT session, unit_id, avg(v) AS mean, stddev_pop(v) AS std, max(v) AS max, min(v) AS min, max(v) - min(v) AS range FROM traces GROUP BY 1, 2)"


@query("x02_trace_stats", f"WITH {_X02} SELECT session, unit_id, {', '.join(f'{R(c)} AS {c}' for c in _STATS)} FROM st", ("traces",))
def x02(spark, sf):
    return rounded(tr.trace_stats(fx.traces(spark, sf)), *_STATS)


@query("x02_trace_stats_averages", f"WITH {_X02} SELECT session, {', '.join(f'{R(f'avg({c})')} AS {c}' for c in _STATS)} FROM st GROUP BY 1", ("traces",))
def x02a(spark, sf):
    return rounded(tr.trace_stats_averages(fx.traces(spark, sf)), *_STATS)


@query("x03_normalize_footprints", f"SELECT session, y, x, unit_id, {R('a / sqrt(sum(a * a) OVER (PARTITION BY session, unit_id))')} AS a FROM foot", ("foot",))
def x03(spark, sf):
    return rounded(tr.normalize_footprints(fx.footprints(spark, sf), fx.traces(spark, sf), "l2")[0], "a")


@query("x03_normalize_traces", f"SELECT session, unit_id, frame, {R('v * n')} AS v FROM traces JOIN (SELECT session, unit_id, sqrt(sum(a * a)) AS n FROM foot GROUP BY 1, 2) USING (session, unit_id)", ("traces",))
def x03c(spark, sf):
    return rounded(tr.normalize_footprints(fx.footprints(spark, sf), fx.traces(spark, sf), "l2")[1], "v")


@query("x04_select_components", "SELECT session, unit_id FROM (SELECT session, unit_id, row_number() OVER (PARTITION BY session ORDER BY unit_id) AS k FROM (SELECT session, unit_id FROM foot WHERE unit_id NOT IN (0, 4) GROUP BY 1, 2 HAVING count(*) >= 30)) WHERE k <= 4", ("foot",))
def x04(spark, sf):
    t = fx.traces(spark, sf).withColumn("v", F.when((F.col("unit_id") == 4) & (F.col("frame") == 7), float("nan")).otherwise(F.col("v")))
    return tr.select_components(fx.footprints(spark, sf), t, 30, 4)


@query("x05_drop_degenerate", "SELECT DISTINCT session, unit_id FROM foot WHERE unit_id NOT IN (3, 5, 7) AND unit_id <= 8", ("foot",))
def x05(spark, sf):
    t = fx.traces(spark, sf).withColumn("v", F.when((F.col("unit_id") == 3) & (F.col("frame") == 7), float("inf")).when(F.col("unit_id") == 5, 1.0).otherwise(F.col("v")))
    a = fx.footprints(spark, sf).withColumn("a", F.when(F.col("unit_id") == 7, 0.0).otherwise(F.col("a")))
    return tr.drop_degenerate(a, t, 6)


@query("x05_degenerate_reasons", "SELECT session, CASE unit_id WHEN 3 THEN 'nan' WHEN 5 THEN 'flat' WHEN 7 THEN 'empty' END AS reason, count(*) AS n FROM (SELECT DISTINCT session, unit_id FROM foot) GROUP BY ALL", ("foot",))
def x05r(spark, sf):
    t = fx.traces(spark, sf).withColumn("v", F.when((F.col("unit_id") == 3) & (F.col("frame") == 7), float("inf")).when(F.col("unit_id") == 5, 1.0).otherwise(F.col("v")))
    a = fx.footprints(spark, sf).withColumn("a", F.when(F.col("unit_id") == 7, 0.0).otherwise(F.col("a")))
    return tr.degenerate_flags(a, t).groupBy("session", "reason").agg(F.count("*").alias("n"))


OVER = "ov AS (SELECT session, u1, u2, n, n * 1.0 / least(s1, s2) AS containment, n * 1.0 / (s1 + s2 - n) AS jaccard FROM (SELECT a.session, a.unit_id AS u1, b.unit_id AS u2, count(*) AS n FROM foot a JOIN foot b USING (session, y, x) WHERE a.unit_id < b.unit_id GROUP BY ALL) JOIN (SELECT session, unit_id AS u1, count(*) AS s1 FROM foot GROUP BY ALL) USING (session, u1) JOIN (SELECT session, unit_id AS u2, count(*) AS s2 FROM foot GROUP BY ALL) USING (session, u2))"
CORR = "co AS (SELECT a.session, a.unit_id AS u1, b.unit_id AS u2, corr(a.v, b.v) AS r FROM traces a JOIN traces b USING (session, frame) WHERE a.unit_id < b.unit_id GROUP BY ALL)"
THRESHOLDS = (0.55, 0.3)
EDGES = f"ed AS (SELECT session, u1, u2 FROM ov JOIN co USING (session, u1, u2) WHERE containment >= {THRESHOLDS[0]} AND r >= {THRESHOLDS[1]})"
COMPONENTS = "bi AS (SELECT session, u1 AS p, u2 AS q FROM ed UNION SELECT session, u2, u1 FROM ed), rc AS (SELECT DISTINCT session, unit_id, unit_id AS c FROM foot UNION SELECT rc.session, bi.q, rc.c FROM rc JOIN bi ON rc.session = bi.session AND rc.unit_id = bi.p), cc AS (SELECT session, unit_id, min(c) AS component FROM rc GROUP BY 1, 2)"
GROUPS = "gr AS (SELECT session, unit_id, CASE WHEN px > 50 AND n > 1 THEN unit_id ELSE component END AS group_id, px > 50 AND n > 1 AS split FROM cc JOIN (SELECT session, component, count(DISTINCT y * 8 + x) AS px, count(DISTINCT unit_id) AS n FROM cc JOIN foot USING (session, unit_id) GROUP BY 1, 2) USING (session, component))"
MERGE = f"WITH RECURSIVE {OVER}, {CORR}, {EDGES}, {COMPONENTS}, {GROUPS} "


@query("g01_overlap_pairs", f"WITH {OVER} SELECT session, u1, u2, n, {R('containment')} AS containment, {R('jaccard')} AS jaccard FROM ov", ("foot",))
def g01(spark, sf):
    return rounded(me.overlap_pairs(fx.footprints(spark, sf)), "containment", "jaccard")


@query("g02_trace_corr", f"WITH {CORR} SELECT session, u1, u2, {R('r')} AS r FROM co", ("traces",))
def g02(spark, sf):
    return rounded(me.trace_corr(fx.traces(spark, sf), me.overlap_pairs(fx.footprints(spark, sf))), "r")


def groups(spark, sf):
    return me.merge_groups(fx.footprints(spark, sf), fx.traces(spark, sf), *THRESHOLDS, 50)


@query("g03_merge_groups", MERGE + "SELECT session, unit_id, group_id, split FROM gr", ("traces",))
def g03(spark, sf):
    return groups(spark, sf)


@query("g03_merge_report", MERGE + """, sz AS (SELECT session, group_id, count(*) AS n FROM gr GROUP BY 1, 2)
SELECT session, (SELECT count(*) FROM sz WHERE sz.session = g.session AND n > 1) AS merged_groups, (SELECT coalesce(sum(n), 0)::BIGINT FROM sz WHERE sz.session = g.session AND n > 1) AS merged_units, count(*) FILTER (split) AS split_units, (SELECT count(*) FROM ed WHERE ed.session = g.session) AS edges FROM gr g GROUP BY 1""", ("traces",))
def g03r(spark, sf):
    return me.merge_report(groups(spark, sf), me.merge_edges(fx.footprints(spark, sf), fx.traces(spark, sf), *THRESHOLDS))


@query("g04_merge_footprints", MERGE + f"SELECT session, group_id AS unit_id, y, x, {R('sum(a)')} AS a FROM foot JOIN gr USING (session, unit_id) GROUP BY ALL", ("traces",))
def g04(spark, sf):
    return rounded(me.merge_footprints(fx.footprints(spark, sf), groups(spark, sf)), "a")


@query("g04_merge_traces", MERGE + f"SELECT session, group_id AS unit_id, frame, {R('avg(v)')} AS v FROM traces JOIN gr USING (session, unit_id) GROUP BY ALL", ("traces",))
def g04t(spark, sf):
    return rounded(me.merge_traces(fx.traces(spark, sf), groups(spark, sf), "mean"), "v")


@query("g05_common_units", "SELECT DISTINCT session, unit_id FROM traces WHERE unit_id % 3 <> 0 AND unit_id <> 4", ("traces",))
def g05(spark, sf):
    t = fx.traces(spark, sf)
    return me.common_units(fx.footprints(spark, sf), t.where("unit_id % 3 <> 0"), t.where("unit_id <> 4"))


@query("g05_align_by_position", "SELECT a.session, a.unit_id AS unit_1, b.unit_id AS unit_2 FROM (SELECT session, unit_id, dense_rank() OVER (PARTITION BY session ORDER BY unit_id) AS k FROM (SELECT DISTINCT session, unit_id FROM foot)) a JOIN (SELECT session, unit_id, dense_rank() OVER (PARTITION BY session ORDER BY unit_id) AS k FROM (SELECT DISTINCT session, unit_id FROM foot WHERE unit_id % 3 <> 0)) b USING (session, k)", ("foot",))
def g05p(spark, sf):
    a = fx.footprints(spark, sf)
    return me.align_by_position(a, a.where("unit_id % 3 <> 0"))


@query("r01_trace_skew", f"WITH m AS (SELECT session, unit_id, avg(v) AS m, stddev_pop(v) AS s FROM traces GROUP BY 1, 2) SELECT session, unit_id, {R('avg(((v - m) / s) ** 3)')} AS skew FROM traces JOIN m USING (session, unit_id) GROUP BY 1, 2", ("traces",))
def r01(spark, sf):
    return rounded(re.trace_skew(fx.traces(spark, sf)), "skew")


_SNR = "sn AS (SELECT session, unit_id, coalesce(CASE WHEN any_value(n) >= 3 AND 1.4826 * quantile_cont(abs(v - med), 0.5) > 1e-12 THEN (any_value(top) - any_value(med)) / (1.4826 * quantile_cont(abs(v - med), 0.5)) END, 0) AS snr FROM traces JOIN (SELECT session, unit_id, count(*) AS n, quantile_cont(v, 0.5) AS med, max(v) AS top FROM traces GROUP BY 1, 2) USING (session, unit_id) GROUP BY 1, 2)"


@query("r02_trace_snr", f"WITH {_SNR} SELECT session, unit_id, {R('snr')} AS snr FROM sn", ("traces",))
def r02(spark, sf):
    return rounded(re.trace_snr(fx.traces(spark, sf)), "snr")


_DRIFT = f"dm AS (SELECT session, unit_id, frame, v - avg(v) OVER (PARTITION BY session, unit_id) AS v FROM days), {_DFT.format(src='dm')}, dr AS (SELECT session, unit_id, sum(p) FILTER (k < 3) / sum(p) AS drift FROM dft GROUP BY 1, 2)"


@query("r03_drift_ratio", f"WITH {_DRIFT} SELECT session, unit_id, {R('drift')} AS drift FROM dr", ("days",))
def r03(spark, sf):
    return rounded(re.drift_ratio(fx.days(spark, sf), 0.2), "drift")


@query("r04_shape_props")
def r04(spark, sf):
    return rounded(re.shape_props(fx.footprints(spark, sf)), "solidity", "eccentricity")


def scores(spark, sf):
    a, t = fx.footprints(spark, sf), fx.traces(spark, sf)
    u = ["session", "unit_id"]
    return re.unit_sizes(a).join(re.trace_skew(t), u).join(re.trace_snr(t), u).withColumn("drift", F.col("unit_id") / 10).withColumn("solidity", F.col("size") / 64)


_SCORES = f"{_SNR}, sk AS (SELECT session, unit_id, avg(((v - m) / s) ** 3) AS skew FROM traces JOIN (SELECT session, unit_id, avg(v) AS m, stddev_pop(v) AS s FROM traces GROUP BY 1, 2) USING (session, unit_id) GROUP BY 1, 2), sc AS (SELECT *, unit_id / 10 AS drift, size / 64 AS solidity FROM (SELECT session, unit_id, count(*) AS size FROM foot GROUP BY 1, 2) JOIN sk USING (session, unit_id) JOIN sn USING (session, unit_id))"


@query("r05_quarantine", f"WITH {_SCORES}, fl AS (SELECT *, (skew < 0.0)::INT + (snr < 3.0)::INT + (drift > 0.6)::INT + (solidity < 0.45)::INT AS n_flags FROM sc) SELECT session, unit_id, n_flags, n_flags >= 2 AND NOT bool_and(n_flags >= 2) OVER (PARTITION BY session) AS quarantined FROM fl", ("traces",))
def r05(spark, sf):
    return re.quarantine(scores(spark, sf), 0.0, 3.0, 0.6, 0.45, require_large=False, min_flags=2)


@query("r06_quarantine_footprint", f"SELECT session, y, x, {R('sum(a)')} AS a FROM foot WHERE unit_id % 2 = 1 GROUP BY ALL", ("foot",))
def r06(spark, sf):
    a = fx.footprints(spark, sf)
    flags = a.select("session", "unit_id", (F.col("unit_id") % 2 == 1).alias("quarantined")).distinct()
    return rounded(re.quarantine_combine(a, fx.traces(spark, sf), flags)[0], "a")


@query("r06_quarantine_trace", f"SELECT session, frame, {R('sum(v)')} AS v FROM traces WHERE unit_id % 2 = 1 GROUP BY ALL", ("traces",))
def r06t(spark, sf):
    a = fx.footprints(spark, sf)
    flags = a.select("session", "unit_id", (F.col("unit_id") % 2 == 1).alias("quarantined")).distinct()
    return rounded(re.quarantine_combine(a, fx.traces(spark, sf), flags)[1], "v")


_Q = ", ".join(f"{R(f'quantile_cont(value, {q})')} AS {n}" for n, q in (("min", 0.0), ("p5", 0.05), ("p25", 0.25), ("median", 0.5), ("p75", 0.75), ("p95", 0.95), ("max", 1.0)))


@query("r07_score_percentiles", f"WITH {_SCORES}, lo AS (SELECT session, 'skew' AS score, skew AS value, skew < 0.0 AS f FROM sc UNION ALL SELECT session, 'snr', snr, snr < 3.0 FROM sc UNION ALL SELECT session, 'drift', drift, drift > 0.6 FROM sc) SELECT session, score, {_Q}, {R('avg(value)')} AS mean, {R('avg(f::INT)')} AS failing FROM lo GROUP BY 1, 2", ("traces",))
def r07(spark, sf):
    made = re.score_percentiles(scores(spark, sf).select("session", "unit_id", "skew", "snr", "drift"), {"skew": ("<", 0.0), "snr": ("<", 3.0), "drift": (">", 0.6)})
    return rounded(made, *(c for c in made.columns if c not in ("session", "score")))


_NORM9 = f"(SELECT sum(exp(-(dy * dy + dx * dx) / 2.0)) FROM ({grid(4, 4)}))"


@query("n01_noise_map", f"""WITH lf AS (SELECT session, y, x, stddev_pop(v - b * f) AS s, any_value(b) AS b FROM movie JOIN bg_b USING (session, y, x) JOIN bg_f USING (session, frame) GROUP BY ALL),
sc AS (SELECT session, y, x, CASE WHEN b > avg(b) OVER (PARTITION BY session) THEN s * 1.5 ELSE s END AS v FROM lf)
SELECT session, y, x, {R(f'sum(v * g) / {_NORM9}')} AS sn FROM ({around('sc', 'session', grid(4, 4, g='exp(-(dy * dy + dx * dx) / 2.0)'), REFLECT)}) GROUP BY ALL""", ("movie", "bg_b", "bg_f"))
def n01(spark, sf):
    b, f = fx.background(spark, sf)
    return rounded(re.noise_map(fx.frames(spark, sf), b, f, 8, 8), "sn")


_SIZE = "sz AS (SELECT session, unit_id, count(*) AS size FROM foot GROUP BY 1, 2)"


@query("n02_size_summary", f"WITH {_SIZE} SELECT session, count(*) AS n, {R('avg(size)')} AS mean, {R('stddev_samp(size)')} AS std, min(size) AS min, {R('quantile_cont(size, 0.25)')} AS p25, {R('quantile_cont(size, 0.5)')} AS median, {R('quantile_cont(size, 0.75)')} AS p75, max(size) AS max, count(*) FILTER (size < 30) AS small, count(*) FILTER (size > 33) AS large, count(*) FILTER (size BETWEEN 30 AND 33) AS valid, 0::BIGINT AS n_odd FROM sz GROUP BY 1", ("foot",))
def n02(spark, sf):
    return rounded(re.size_summary(fx.footprints(spark, sf), 30, 33), "mean", "std", "p25", "median", "p75")


@query("n03_size_filter", f"WITH {_SIZE} SELECT t.session, t.unit_id, frame, {R('v')} AS v FROM traces t JOIN sz USING (session, unit_id) WHERE size BETWEEN 30 AND 33", ("traces",))
def n03(spark, sf):
    return rounded(fx.traces(spark, sf).join(re.size_filter(fx.footprints(spark, sf), 30, 33), ["session", "unit_id"], "left_semi"), "v")


def metrics(spark, sf):
    a = fx.days(spark, sf).where("frame < 7").select("session", "unit_id", F.col("frame").alias("y"), F.lit(0).alias("x"), F.col("v").alias("a"))
    return re.component_metrics(a, deconvolved(spark, sf))


_MET = f"{DEC}, mt AS (SELECT * FROM (SELECT session, unit_id, sum(s) AS spikes, var_pop(c) AS variance FROM dec GROUP BY 1, 2) JOIN (SELECT session, unit_id, sum(v) AS weight FROM days WHERE frame < 7 GROUP BY 1, 2) USING (session, unit_id))"


@query("n04_component_filter", f"WITH {_MET} SELECT session, unit_id FROM mt WHERE spikes > 800 AND variance > 1500 AND weight > 300", ("days",))
def n04(spark, sf):
    return re.component_filter(metrics(spark, sf), 800, 1500, 300)


_MED = lambda c: f"CASE WHEN kept < 0.2 * n THEN round({c}, 7) + 0.0 END"


# metrics to 6 decimals: whether a sum in floating point is above a bound that it meets exactly depends on the order of its terms
@query("n04_component_report", f"WITH {_MET}, r6 AS (SELECT session, round(spikes, 6) AS spikes, round(variance, 6) AS variance, round(weight, 6) AS weight FROM mt), cn AS (SELECT session, count(*) AS n, count(*) FILTER (spikes > 1200 AND variance > 3000 AND weight > 600) AS kept, count(*) FILTER (spikes <= 1200) AS few_spikes, count(*) FILTER (variance <= 3000) AS flat, count(*) FILTER (weight <= 600) AS faint, quantile_cont(spikes, 0.5) AS a, quantile_cont(variance, 0.5) AS b, quantile_cont(weight, 0.5) AS c FROM r6 GROUP BY 1) SELECT session, n, kept, few_spikes, flat, faint, {_MED('a')} AS median_spikes, {_MED('b')} AS median_variance, {_MED('c')} AS median_weight FROM cn", ("days",))
def n04r(spark, sf):
    return re.component_report(metrics(spark, sf), 1200, 3000, 600)


@query("n05_size_mask", f"WITH {_SIZE} SELECT session, count(*) AS units, count(*) FILTER (size BETWEEN 30 AND 33) AS units_kept, sum(size)::BIGINT AS pixels, coalesce(sum(size) FILTER (size BETWEEN 30 AND 33), 0)::BIGINT AS pixels_kept, {R('coalesce(sum(size) FILTER (size BETWEEN 30 AND 33), 0) / sum(size)')} AS retained FROM sz GROUP BY 1", ("foot",))
def n05(spark, sf):
    return rounded(re.size_mask(fx.footprints(spark, sf), 30, 33), "retained")


_YRA = "yra AS (SELECT ay.session, ay.unit_id, ay.frame, ay.v - coalesce(ab, 0) * f AS v FROM traces ay LEFT JOIN (SELECT session, unit_id, sum(a * b) AS ab FROM foot JOIN bg_b USING (session, y, x) GROUP BY 1, 2) USING (session, unit_id) JOIN bg_f USING (session, frame))"
_YUSES = ("movie", "foot", "traces", "bg_b", "bg_f")


def yra(spark, sf):
    b, f = fx.background(spark, sf)
    return tr.project_yra(fx.frames(spark, sf), fx.footprints(spark, sf), b, f)


def agreement(spark, sf):
    both = fx.traces(spark, sf).join(yra(spark, sf).withColumnRenamed("v", "w"), ["session", "unit_id", "frame"])
    return both.groupBy("session", "unit_id").agg(F.corr("v", "w").alias("r"))


@query("n06_final_filter", f"WITH {_SIZE}, {_SNR}, {_YRA}, ag AS (SELECT session, unit_id, corr(t.v, y.v) AS r FROM traces t JOIN yra y USING (session, unit_id, frame) GROUP BY 1, 2) SELECT session, unit_id FROM sz JOIN sn USING (session, unit_id) JOIN ag USING (session, unit_id) WHERE size >= 29 AND snr >= 3.0 AND r >= 0.2", _YUSES)
def n06(spark, sf):
    return re.final_filter(fx.footprints(spark, sf), re.trace_snr(fx.traces(spark, sf)), 29, 3.0, agreement(spark, sf), 0.2)


@query("n07_drop_inactive", "SELECT session, unit_id FROM traces GROUP BY 1, 2 HAVING avg(v) > 0.0", ("traces",))
def n07(spark, sf):
    return re.drop_inactive(fx.traces(spark, sf), 0.0)


@query("t01_project_yra", f"WITH {_YRA} SELECT session, unit_id, frame, {R('v')} AS v FROM yra", _YUSES)
def t01(spark, sf):
    return rounded(yra(spark, sf), "v")


@query("t02_yra_validate", f"""WITH {_YRA}, sm AS (SELECT y.session, unit_id, frame, v FROM yra y JOIN (SELECT session, max(frame) + 1 AS n FROM yra GROUP BY 1) USING (session) WHERE unit_id < 6 AND frame >= (n - 60) // 2 AND frame < (n - 60) // 2 + 60),
rr AS (SELECT session, avg(r) AS mean_r, quantile_cont(r, 0.5) AS median_r FROM (SELECT a.session, a.unit_id, b.unit_id, corr(a.v, b.v) AS r FROM sm a JOIN sm b USING (session, frame) WHERE a.unit_id < b.unit_id GROUP BY 1, 2, 3) GROUP BY 1)
SELECT session, {R('avg(v)')} AS mean, {R('stddev_pop(v)')} AS std, {R('min(v)')} AS min, {R('max(v)')} AS max, {R('any_value(mean_r)')} AS mean_r, {R('any_value(median_r)')} AS median_r FROM sm JOIN rr USING (session) GROUP BY 1""", _YUSES)
def t02(spark, sf):
    y = yra(spark, sf)
    return rounded(tr.yra_validate(y, y.select("session", "unit_id").distinct().where("unit_id < 6"), 60, "highest_variance"), "mean", "std", "min", "max", "mean_r", "median_r")


def unit_scores(spark, sf):
    return re.unit_sizes(fx.footprints(spark, sf)).join(re.trace_snr(fx.traces(spark, sf)), ["session", "unit_id"])


@query("t02_yra_validate_smallest", f"""WITH {_YRA}, few AS (SELECT session, unit_id FROM (SELECT session, unit_id, row_number() OVER (PARTITION BY session ORDER BY count(*), unit_id) AS nth FROM foot GROUP BY 1, 2) WHERE nth <= 4), sm AS (SELECT y.session, unit_id, frame, v FROM yra y JOIN few USING (session, unit_id) JOIN (SELECT session, max(frame) + 1 AS n FROM yra GROUP BY 1) USING (session) WHERE frame >= (n - 60) // 2 AND frame < (n - 60) // 2 + 60),
rr AS (SELECT session, avg(r) AS mean_r, quantile_cont(r, 0.5) AS median_r FROM (SELECT a.session, a.unit_id, b.unit_id, corr(a.v, b.v) AS r FROM sm a JOIN sm b USING (session, frame) WHERE a.unit_id < b.unit_id GROUP BY 1, 2, 3) GROUP BY 1)
SELECT session, {R('avg(v)')} AS mean, {R('stddev_pop(v)')} AS std, {R('min(v)')} AS min, {R('max(v)')} AS max, {R('any_value(mean_r)')} AS mean_r, {R('any_value(median_r)')} AS median_r FROM sm JOIN rr USING (session) GROUP BY 1""", _YUSES)
def t02_smallest(spark, sf):
    y = yra(spark, sf)
    return rounded(tr.yra_validate(y, tr.choose_units(unit_scores(spark, sf), 4, "smallest"), 60, "highest_variance"), "mean", "std", "min", "max", "mean_r", "median_r")


@query("t03_normalize_trace", f"SELECT session, unit_id, frame, {R('(v - avg(v) OVER w) / (stddev_pop(v) OVER w + 1e-8)')} AS v FROM days WINDOW w AS (PARTITION BY session, unit_id)", ("days",))
def t03(spark, sf):
    return rounded(tr.normalize_trace(fx.days(spark, sf)), "v")


@query("t04_noise_psd", f"WITH {_DFT.format(src='days')} SELECT session, unit_id, {R('sqrt(avg(p) / 30)')} AS sigma FROM dft WHERE k > 7.5 GROUP BY 1, 2", ("days",))
def t04(spark, sf):
    return rounded(tr.noise_psd(fx.days(spark, sf)), "sigma")


@query("t05_ar_coeffs", f"""WITH c AS (SELECT session, unit_id, frame, v - avg(v) OVER (PARTITION BY session, unit_id) AS z FROM days),
l AS (SELECT session, unit_id, z, lead(z, 1) OVER w AS z1, lead(z, 2) OVER w AS z2 FROM c WINDOW w AS (PARTITION BY session, unit_id ORDER BY frame)),
r AS (SELECT session, unit_id, sum(z * z) AS r0, sum(z * z1) AS r1, sum(z * z2) AS r2 FROM l GROUP BY 1, 2)
SELECT session, unit_id, {R('(r1 * r0 - r1 * r2) / (r0 * r0 - r1 * r1)')} AS g1, {R('(r0 * r2 - r1 * r1) / (r0 * r0 - r1 * r1)')} AS g2 FROM r""", ("days",))
def t05(spark, sf):
    return tr.ar_coeffs(fx.days(spark, sf), 2).select("session", "unit_id", rnd(F.col("g")[0]).alias("g1"), rnd(F.col("g")[1]).alias("g2"))


@query("t05_ar_coeffs_segments", f"""WITH c AS (SELECT session, unit_id, frame, frame // 7 AS seg, v - avg(v) OVER (PARTITION BY session, unit_id) AS z FROM days),
l AS (SELECT session, unit_id, seg, z, lead(z, 1) OVER w AS z1 FROM c WHERE frame < 28 WINDOW w AS (PARTITION BY session, unit_id, seg ORDER BY frame)),
r AS (SELECT session, unit_id, seg, coalesce(sum(z * z1), 0) / sum(z * z) AS g FROM l GROUP BY 1, 2, 3)
SELECT session, unit_id, {R('median(g)')} AS g1 FROM r GROUP BY 1, 2""", ("days",))
def t05_segments(spark, sf):
    return tr.ar_coeffs(fx.days(spark, sf), 1, 7).select("session", "unit_id", rnd(F.col("g")[0]).alias("g1"))


@query("t06_overlap_chunks", "SELECT session, unit_id, frame, v, chunk, frame - chunk * 6 AS local, 5::BIGINT AS n_chunks FROM days CROSS JOIN (SELECT unnest(range(0, 5)) AS chunk) WHERE frame >= chunk * 6 AND frame < chunk * 6 + 10", ("days",))
def t06(spark, sf):
    return tr.overlap_chunks(fx.days(spark, sf), 10, 4)


@query("t07_deconvolve")
def t07(spark, sf):
    made = tr.deconvolve_chunks(tr.overlap_chunks(fx.days(spark, sf), 100, 10))
    return made.select("session", "unit_id", "frame", *(rnd(c, 4).alias(c) for c in ("c", "s", "b", "c0")))


@query("t07_certificates", "SELECT session, unit_id, 0::BIGINT AS chunk, count(*) AS frames, true AS near_optimum FROM days GROUP BY ALL", ("days",))
def t07_certificates(spark, sf):
    made = tr.certificates(tr.deconvolve_chunks(tr.overlap_chunks(fx.days(spark, sf), 100, 10)))
    return made.select("session", "unit_id", "chunk", "frames", (F.col("gap") <= 1e-4).alias("near_optimum"))


@query("t08_merge_chunks", "SELECT session, unit_id, frame, v FROM days", ("days",))
def t08(spark, sf):
    return tr.merge_chunks(tr.overlap_chunks(fx.days(spark, sf), 10, 4), 10, 4, ["v"])


@query("t08_merge_ar", f"WITH c AS (SELECT session, unit_id, frame % 4 AS chunk, [avg(v), max(v)] AS g FROM days GROUP BY ALL) SELECT session, unit_id, (i - 1)::INT AS lag, round(avg(g[i]), 9) + 0.0 AS g FROM c CROSS JOIN (SELECT unnest([1, 2]) AS i) GROUP BY 1, 2, 3", ("days",))
def t08g(spark, sf):
    c = fx.days(spark, sf).groupBy("session", "unit_id", F.expr("frame % 4").alias("chunk")).agg(F.array(F.avg("v"), F.max("v")).alias("g"))
    return tr.merge_ar(c).withColumn("g", rnd("g", 9))


@query("t09_temporal_update")
def t09(spark, sf):
    made = tr.temporal_update(fx.days(spark, sf), 20, 4)
    return made.select("session", "unit_id", "frame", *(rnd(c, 4).alias(c) for c in ("c", "s", "b", "c0")))


@query("t09_certificates", "SELECT session, unit_id, chunk, count(*) AS frames, true AS near_optimum FROM days JOIN (SELECT unnest([0, 1])::BIGINT AS chunk) ON frame >= 16 * chunk AND frame < 16 * chunk + 20 GROUP BY ALL", ("days",))
def t09_certificates(spark, sf):
    made = tr.certificates(tr.deconvolve_chunks(tr.overlap_chunks(tr.normalize_trace(fx.days(spark, sf)), 20, 4)))
    return made.select("session", "unit_id", "chunk", "frames", (F.col("gap") <= 1e-4).alias("near_optimum"))


_T10 = ("noise", "snr", "r1", "r2", "rate", "agree")


@query("t10_suggest_temporal", f"""WITH {_YRA}, a AS (SELECT session, unit_id, sum(a * b) / count(*) AS noise FROM foot JOIN bg_b USING (session, y, x) WHERE unit_id < 7 GROUP BY 1, 2),
s AS (SELECT session, unit_id, stddev_pop(v) AS std, quantile_cont(v, 0.5) + 2 * stddev_pop(v) AS lev, avg(v) AS m FROM traces WHERE unit_id < 7 GROUP BY 1, 2),
l AS (SELECT t.*, s.*, lag(v, 1) OVER w AS l1, lag(v, 2) OVER w AS l2 FROM traces t JOIN s USING (session, unit_id) WINDOW w AS (PARTITION BY t.session, t.unit_id ORDER BY frame)),
h AS (SELECT session, unit_id, sum((v - m) * (l1 - m)) / sum((v - m) ** 2) AS r1, sum((v - m) * (l2 - m)) / sum((v - m) ** 2) AS r2, coalesce(avg((v > lev AND l1 <= lev)::INT), 0) AS rate, any_value(std) AS std FROM l GROUP BY 1, 2),
g AS (SELECT session, unit_id, corr(t.v, y.v) AS agree FROM traces t JOIN yra y USING (session, unit_id, frame) GROUP BY 1, 2),
u AS (SELECT *, std / greatest(noise, 1e-12) AS snr FROM h JOIN a USING (session, unit_id) LEFT JOIN g USING (session, unit_id)),
o AS (SELECT session, {', '.join(f'quantile_cont({c}, 0.5) AS {c}' for c in _T10)} FROM u GROUP BY 1)
SELECT session, {', '.join(f'{R(c)} AS {c}' for c in _T10)}, CASE WHEN r2 > 0.5 * r1 THEN 2 ELSE 1 END AS p, {R('0.1 / greatest(snr, 1e-6)')} AS sparse_high, {R('0.05 / greatest(snr, 1e-6)')} AS sparse_mid, {R('0.01 / greatest(snr, 1e-6)')} AS sparse_low, floor(200 + 300 * least(1.0, 10 * rate))::BIGINT AS max_iters, {R('noise * 0.01')} AS zero_low, {R('noise * 0.05')} AS zero_mid, {R('noise * 0.1')} AS zero_high FROM o""", _YUSES)
def t10(spark, sf):
    b, _ = fx.background(spark, sf)
    t = fx.traces(spark, sf)
    made = tr.suggest_temporal(fx.footprints(spark, sf), t, b.withColumnRenamed("b", "sn"), yra(spark, sf), t.select("session", "unit_id").distinct().where("unit_id < 7"))
    return rounded(made, *_T10, "sparse_high", "sparse_mid", "sparse_low", "zero_low", "zero_mid", "zero_high")


@query("t10_suggest_temporal_all", f"""WITH {_YRA}, a AS (SELECT session, unit_id, sum(a * b) / count(*) AS noise FROM foot JOIN bg_b USING (session, y, x) GROUP BY 1, 2),
s AS (SELECT session, unit_id, stddev_pop(v) AS std, quantile_cont(v, 0.5) + 2 * stddev_pop(v) AS lev, avg(v) AS m FROM traces GROUP BY 1, 2),
l AS (SELECT t.*, s.*, lag(v, 1) OVER w AS l1, lag(v, 2) OVER w AS l2 FROM traces t JOIN s USING (session, unit_id) WINDOW w AS (PARTITION BY t.session, t.unit_id ORDER BY frame)),
h AS (SELECT session, unit_id, sum((v - m) * (l1 - m)) / sum((v - m) ** 2) AS r1, sum((v - m) * (l2 - m)) / sum((v - m) ** 2) AS r2, coalesce(avg((v > lev AND l1 <= lev)::INT), 0) AS rate, any_value(std) AS std FROM l GROUP BY 1, 2),
g AS (SELECT session, unit_id, corr(t.v, y.v) AS agree FROM traces t JOIN yra y USING (session, unit_id, frame) GROUP BY 1, 2),
u AS (SELECT *, std / greatest(noise, 1e-12) AS snr FROM h JOIN a USING (session, unit_id) LEFT JOIN g USING (session, unit_id)),
o AS (SELECT session, {', '.join(f'quantile_cont({c}, 0.5) AS {c}' for c in _T10)} FROM u GROUP BY 1)
SELECT session, {', '.join(f'{R(c)} AS {c}' for c in _T10)}, CASE WHEN r2 > 0.5 * r1 THEN 2 ELSE 1 END AS p, {R('0.1 / greatest(snr, 1e-6)')} AS sparse_high, {R('0.05 / greatest(snr, 1e-6)')} AS sparse_mid, {R('0.01 / greatest(snr, 1e-6)')} AS sparse_low, floor(200 + 300 * least(1.0, 10 * rate))::BIGINT AS max_iters, {R('noise * 0.01')} AS zero_low, {R('noise * 0.05')} AS zero_mid, {R('noise * 0.1')} AS zero_high FROM o""", _YUSES)
def t10_all(spark, sf):
    b, _ = fx.background(spark, sf)
    t = fx.traces(spark, sf)
    made = tr.suggest_temporal(fx.footprints(spark, sf), t, b.withColumnRenamed("b", "sn"), yra(spark, sf), t.select("session", "unit_id").distinct())
    return rounded(made, *_T10, "sparse_high", "sparse_mid", "sparse_low", "zero_low", "zero_mid", "zero_high")


_SP = f"{DEC}, sp AS (SELECT session, unit_id, avg((s > 0)::INT) AS active, avg((s = 0)::INT) AS silent FROM dec GROUP BY 1, 2)"


# increases to 6 decimals: two equal sums in floating point, added up in other orders, can differ and would count as a spike
@query("t11_spike_summary", f"WITH {DEC}, sp AS (SELECT session, unit_id, avg((round(s, 6) > 0)::INT) AS active, avg((round(s, 6) = 0)::INT) AS silent FROM dec GROUP BY 1, 2) SELECT session, unit_id, {R('active')} AS active, {R('silent')} AS silent, silent < 0.8 AS dense FROM sp", ("days",))
def t11(spark, sf):
    return rounded(tr.spike_summary(rounded(deconvolved(spark, sf), "s")), "active", "silent")


@query("t11_spike_totals", f"WITH {_SP} SELECT session, {R('avg(silent)')} AS sparsity, count(*) FILTER (active > 0.2) AS n_busy FROM sp GROUP BY 1", ("days",))
def t11t(spark, sf):
    return rounded(tr.spike_totals(deconvolved(spark, sf)), "sparsity")


_T12 = {"c_mean": "avg(c)", "c_std": "stddev_pop(c)", "c_min": "min(c)", "c_max": "max(c)", "s_mean": "avg(s)", "s_share": "avg((s > 0.001)::INT)"}


@query("t12_temporal_summary", f"WITH {DEC}, g AS (SELECT session, unit_id, frame::INT AS lag, v AS g FROM days WHERE frame < 2) SELECT session, {', '.join(f'{R(e)} AS {n}' for n, e in _T12.items())}, (SELECT {R('avg(g)')} FROM g WHERE g.session = d.session AND lag = 0) AS g1, (SELECT {R('avg(g)')} FROM g WHERE g.session = d.session AND lag = 1) AS g2 FROM dec d GROUP BY 1", ("days",))
def t12(spark, sf):
    ar = fx.days(spark, sf).where("frame < 2").select("session", "unit_id", F.col("frame").cast("int").alias("lag"), F.col("v").alias("g"))
    return rounded(tr.temporal_summary(deconvolved(spark, sf), ar), *_T12, "g1", "g2")



