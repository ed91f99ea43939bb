"""Queries of ingest and frame quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from brightfield.operators import frames as fr
from brightfield.operators import ingest
from brightfield.plans.registry import query, rnd
from brightfield.sources import fixtures as fx

_MANIFEST = """
WITH files AS (SELECT p_brand AS session, 'msCam' || p_partkey || '.avi' AS file, p_partkey AS number, CASE WHEN p_partkey % 11 = 0 THEN 0 ELSE p_size * 40 END AS header,
  p_retailprice AS duration, CASE WHEN p_partkey % 5 = 0 THEN 10.0 ELSE 30.0 END AS fps FROM part WHERE p_partkey % 13 <> 0),
manifest AS (SELECT session, file, number, fps, CASE WHEN header = 0 OR abs(round(duration * fps) - header) > 0.05 * header THEN round(duration * fps)::BIGINT ELSE header::BIGINT END AS n_frames FROM files)
"""


def manifest(spark, sf):
    p = fx.table(spark, sf, "part")
    name = F.concat(F.when(F.col("p_partkey") % 13 == 0, "other").otherwise("msCam"), F.col("p_partkey").cast("string"), F.lit(".avi"))
    files = p.select(F.col("p_brand").alias("session"), name.alias("file"), F.when(F.col("p_partkey") % 11 == 0, "0").otherwise((F.col("p_size") * 40).cast("string")).alias("nb_frames"), F.col("p_retailprice").alias("duration"), F.when(F.col("p_partkey") % 5 == 0, "N/A").otherwise("30/1").alias("rate"))
    return ingest.frame_manifest(files, r"^msCam\d+\.avi$")


@query("i01_frame_manifest", _MANIFEST + "SELECT session, file, fps, n_frames, (coalesce(sum(n_frames) OVER (PARTITION BY session ORDER BY number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS first_frame FROM manifest")
def i01(spark, sf):
    return manifest(spark, sf).select("session", "file", "fps", "n_frames", F.col("offset").alias("first_frame"))


def filed_movie(spark, sf):
    return fx.movie(spark, sf).withColumn("file", F.expr("frame div 50"))


@query("i02_stride_downsample", """WITH kept AS (SELECT session, frame, row_number() OVER (PARTITION BY session ORDER BY frame) - 1 AS place FROM (SELECT DISTINCT session, frame FROM movie WHERE (frame % 50) % 4 = 0))
SELECT session, place AS frame, frame AS original_frame, y // 2 AS y, x // 3 AS x, v FROM movie JOIN kept USING (session, frame) WHERE y % 2 = 0 AND x % 3 = 0 AND x < 6""", ("movie",))
def i02(spark, sf):
    return ingest.stride_downsample(filed_movie(spark, sf), 4, 2, 3, 8, 8).drop("file")


@query("i03_trim_frames", """WITH places AS (SELECT session, frame, row_number() OVER (PARTITION BY session ORDER BY frame) - 1 AS place FROM (SELECT DISTINCT session, frame FROM movie)),
held AS (SELECT session, frame, place - 20 AS place, count(*) OVER (PARTITION BY session) AS n FROM places WHERE place BETWEEN 20 AND 199)
SELECT session, place AS frame, frame AS original_frame, y, x, v FROM movie JOIN held USING (session, frame) WHERE place < floor(n * CAST(0.35 AS DOUBLE))""", ("movie",))
def i03(spark, sf):
    return ingest.trim_frames(fx.movie(spark, sf), 20, 200, 35.0)


@query("i03_trim_downsampled", """WITH a AS (SELECT DISTINCT session, frame FROM movie WHERE (frame % 50) % 4 = 0), b AS (SELECT session, frame, rank() OVER (PARTITION BY session ORDER BY frame) - 1 AS place, count(*) OVER (PARTITION BY session) AS n FROM a),
c AS (SELECT session, frame, place - 11 AS place FROM b WHERE place >= 11 AND place < least(61, n))
SELECT session, place AS frame, frame AS original_frame, y // 2 AS y, x // 2 AS x, v FROM movie JOIN c USING (session, frame) WHERE y % 2 = 0 AND x % 2 = 0""", ("movie",))
def i03_downsampled(spark, sf):
    return ingest.trim_frames(ingest.stride_downsample(filed_movie(spark, sf), 4, 2, 2, 8, 8).drop("file"), 11, 61, 100.0)


@query("i04_blank_fill", "SELECT session, frame, y, x, CASE WHEN frame % 7 = 3 THEN 0.0 ELSE v END AS v FROM movie", ("movie",))
def i04(spark, sf):
    m = fx.movie(spark, sf)
    expected = m.groupBy("session").agg((F.max("frame") + 1).alias("n_frames"), (F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"))
    return ingest.blank_fill(m.where("frame % 7 <> 3"), expected)


@query("i04_luma", "SELECT l_orderkey, l_linenumber, round(0.299 * l_quantity + 0.587 * l_discount * 100 + 0.114 * l_tax * 100, 6) + 0.0 AS v FROM lineitem")
def i04_luma(spark, sf):
    rgb = fx.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("r"), (F.col("l_discount") * 100).alias("g"), (F.col("l_tax") * 100).alias("b"))
    return ingest.luma(rgb).withColumn("v", rnd("v"))


@query("i05_ingest_report", _MANIFEST + """, m2 AS (SELECT *, coalesce(sum(n_frames) OVER (PARTITION BY session ORDER BY number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o, CASE WHEN number % 17 = 0 THEN 0 WHEN number % 7 = 0 THEN n_frames // 2 ELSE n_frames END AS n_read, CASE WHEN number % 17 <> 0 AND number % 19 = 0 THEN 2 ELSE 0 END AS bad FROM manifest)
SELECT session, file, n_frames, n_read::BIGINT AS n_read, o::BIGINT AS first_frame, (o + n_frames - 1)::BIGINT AS last_frame,
  concat_ws('; ', CASE WHEN n_read = 0 THEN 'no frames' END, CASE WHEN n_read > 0 AND n_read < 0.95 * n_frames THEN 'frames missing' END, CASE WHEN bad > 0 THEN 'corrupt frames' END) AS issues FROM m2""")
def i05(spark, sf):
    m = manifest(spark, sf)
    read = m.where("number % 17 <> 0").select("session", "file", F.when(F.col("number") % 7 == 0, F.expr("n_frames div 2")).otherwise(F.col("n_frames")).alias("n_read"), F.when(F.col("number") % 19 == 0, 2).otherwise(0).alias("n_corrupt"))
    return ingest.ingest_report(m, read).withColumn("n_read", F.col("n_read").cast("long"))


@query("i06_frame_reindex", "SELECT session, y, x, v, frame AS original_frame, (dense_rank() OVER (PARTITION BY session ORDER BY frame) - 1)::BIGINT AS frame FROM movie WHERE frame % 9 <> 4", ("movie",))
def i06(spark, sf):
    m = fx.movie(spark, sf)
    return ingest.frame_reindex(m, m.where("frame % 9 = 4").select("session", "frame").distinct())


@query("i07_session_catalog", """SELECT '/data/' || CASE WHEN c_custkey % 10 = 0 THEN 'T' || c_custkey ELSE c_nationkey || '_' || c_custkey END || '_Processed' AS path,
  (CASE WHEN c_custkey % 10 = 0 THEN 0 ELSE c_nationkey END)::BIGINT AS animal, c_custkey AS number, CASE WHEN c_custkey % 10 = 0 THEN 0 ELSE c_nationkey END || '_' || c_custkey AS label FROM customer
  WHERE (CASE WHEN c_custkey % 10 = 0 THEN 0 ELSE c_nationkey END) > 5 OR ((CASE WHEN c_custkey % 10 = 0 THEN 0 ELSE c_nationkey END) = 5 AND c_custkey >= 100)""")
def i07(spark, sf):
    c = fx.table(spark, sf, "customer")
    stem = F.when(F.col("c_custkey") % 10 == 0, F.concat(F.lit("T"), F.col("c_custkey").cast("string"))).otherwise(F.concat_ws("_", F.col("c_nationkey").cast("string"), F.col("c_custkey").cast("string")))
    return ingest.session_catalog(c.select(F.concat(F.lit("/data/"), stem, F.lit("_Processed")).alias("path")), 5, 100)


def params(spark, sf, last: bool):
    e = fx.table(spark, sf, "events")
    pick = F.max_by if last else F.min_by
    json = F.concat(F.lit('{"steps":{"'), F.col("event_type"), F.lit('":'), F.col("props"), F.lit("}}"))
    made = e.groupBy(F.col("user_id").alias("session"), "event_type").agg(pick(json, F.struct("ts", "event_id")).alias("json"))
    return ingest.params_load(made)


@query("i08_params_load", "SELECT user_id AS session, event_type AS step, 'k' AS param, json_extract_string(arg_max(props, ROW(ts, event_id)), '$.k') AS value FROM events GROUP BY ALL")
def i08(spark, sf):
    return params(spark, sf, True)


@query("i09_params_merge", """WITH o AS (SELECT user_id AS session, event_type AS step, json_extract_string(arg_min(props, ROW(ts, event_id)), '$.k') AS old FROM events WHERE event_type <> 'view' GROUP BY ALL),
n AS (SELECT user_id AS session, event_type AS step, json_extract_string(arg_max(props, ROW(ts, event_id)), '$.k') AS raw FROM events WHERE event_type <> 'click' GROUP BY ALL),
m AS (SELECT session, step, CASE WHEN raw::INT % 3 = 0 THEN '0' WHEN raw::INT % 3 = 1 THEN 'false' ELSE raw END AS now, session % 5 = 0 AS scoped FROM n),
s AS (SELECT session, step, CASE WHEN old::INT % 2 = 0 THEN 'true' ELSE old END AS old FROM o)
SELECT session, step, 'k' AS param, CASE WHEN coalesce(scoped, false) THEN now WHEN (now IS NULL OR now IN ('', '0', '0.0', 'null')) AND old IS NOT NULL AND old NOT IN ('', '0', '0.0', 'null') THEN old
  WHEN coalesce(now = 'false' AND old = 'true', false) THEN old ELSE coalesce(now, old) END AS value FROM s FULL JOIN m USING (session, step)""")
def i09(spark, sf):
    old = params(spark, sf, False).where("step <> 'view'").withColumn("value", F.when(F.col("value").cast("int") % 2 == 0, "true").otherwise(F.col("value")))
    k = F.col("value").cast("int") % 3
    new = params(spark, sf, True).where("step <> 'click'").withColumn("value", F.when(k == 0, "0").when(k == 1, "false").otherwise(F.col("value"))).withColumn("scoped", F.col("session") % 5 == 0)
    return ingest.params_merge(old, new)


@query("i10_movie_frames", "SELECT session, frame, y, x, v FROM movie", ("movie",))
def i10(spark, sf):
    return ingest.movie_round_trip(fx.movie(spark, sf), "frames")


@query("i10_movie_tiles", "SELECT session, frame, y, x, v FROM movie", ("movie",))
def i10_tiles(spark, sf):
    return ingest.movie_round_trip(fx.movie(spark, sf), "tiles")


@query("f01_linesplit_basic", "WITH l AS (SELECT session, frame, avg(v) AS m FROM movie WHERE x < 3 GROUP BY 1, 2), s AS (SELECT session, avg(m) AS a, stddev_pop(m) AS d FROM l GROUP BY 1) SELECT session, frame, round(m, 6) + 0.0 AS left_mean FROM l JOIN s USING (session) WHERE m > a + 1.5 * d", ("movie",))
def f01(spark, sf):
    return fr.linesplit_basic(fx.movie(spark, sf), 3, 1.5).withColumn("left_mean", rnd("left_mean"))


@query("f02_linesplit_advanced", """WITH r AS (SELECT session, y, avg(v) AS m FROM movie GROUP BY 1, 2), t AS (SELECT session, max(m) AS top FROM r GROUP BY 1),
s AS (SELECT session, y, row_number() OVER (PARTITION BY session ORDER BY y) AS r FROM r JOIN t USING (session) WHERE m > -2.0 * top),
p AS (SELECT session, frame, r, avg(v) AS p FROM movie JOIN s USING (session, y) WHERE x >= 2 AND x < 6 GROUP BY 1, 2, 3),
g AS (SELECT a.session, a.frame, a.r, any_value(a.p) - sum(exp(-((a.r - b.r) ** 2) / 2.0) * b.p) / sum(exp(-((a.r - b.r) ** 2) / 2.0)) AS d FROM p a JOIN p b ON a.session = b.session AND a.frame = b.frame AND abs(a.r - b.r) <= 4 GROUP BY 1, 2, 3),
sc AS (SELECT session, frame, stddev_pop(d) AS score FROM g GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER w AS k, lead(score) OVER w AS nx, count(*) OVER (PARTITION BY session) AS n FROM sc WINDOW w AS (PARTITION BY session ORDER BY score, frame)),
th AS (SELECT session, arg_max((score + nx) / 2, ROW(nx - score, -k)) AS th FROM k WHERE k < floor(0.99 * n) GROUP BY 1)
SELECT session, frame, round(score, 6) + 0.0 AS score FROM sc JOIN th USING (session) WHERE score > th""", ("movie",))
def f02(spark, sf):
    return fr.linesplit_advanced(fx.movie(spark, sf), 1.0, -2.0, 0.25, 0.75).withColumn("score", rnd("score"))


_OUT = "o AS (SELECT session, frame FROM motion JOIN (SELECT session, avg(dy) AS my, stddev_pop(dy) AS sy, avg(dx) AS mx, stddev_pop(dx) AS sx FROM motion GROUP BY 1) USING (session) WHERE abs(dy) > my + 1.5 * sy OR abs(dx) > mx + 1.5 * sx)"


@query("f03_motion_outliers", f"WITH {_OUT} SELECT * FROM o", ("motion",))
def f03(spark, sf):
    return fr.motion_outliers(fx.motion(spark, sf), 1.5)


@query("f04_motion_abs_limits", f"WITH {_OUT} SELECT * FROM o UNION SELECT session, frame FROM motion WHERE dy < -1.0 OR dx > 1.2", ("motion",))
def f04(spark, sf):
    return fr.motion_abs_limits(fx.motion(spark, sf), 1.5, (-1.0, None), (None, 1.2))


@query("f05_removed_frames", f"""WITH {_OUT}, ix AS (SELECT session, frame, dense_rank() OVER (PARTITION BY session ORDER BY frame) - 1 AS nf FROM motion WHERE frame % 5 <> 2),
b AS (SELECT ix.session, ix.frame, 'motion' AS reason FROM ix JOIN o ON ix.session = o.session AND ix.nf = o.frame UNION SELECT session, frame, 'split' FROM motion WHERE frame % 5 = 2)
SELECT session, frame, string_agg(reason, ',' ORDER BY reason) AS reason FROM b GROUP BY 1, 2""", ("motion",))
def f05(spark, sf):
    m = fx.motion(spark, sf)
    split = m.where("frame % 5 = 2").select("session", "frame")
    return fr.removed_frames(ingest.frame_index(m, split), fr.motion_outliers(m, 1.5), split)


@query("f06_movie_validate", """WITH s AS (SELECT session, y, x, CASE WHEN (frame + y + x) % 50 = 0 THEN NULL ELSE v END AS v FROM movie WHERE frame % 3 = 0),
p AS (SELECT session, y, x, avg(v) AS m, stddev_pop(v) AS s, min(v) AS lo, max(v) AS hi, count(*) - count(v) AS odd, count(*) AS n FROM s GROUP BY 1, 2, 3)
SELECT session, round(avg(m), 6) + 0.0 AS mean, round(avg(s), 6) + 0.0 AS std, min(lo) AS min, max(hi) AS max, sum(odd)::BIGINT AS n_odd, round(100.0 * sum(odd) / sum(n), 6) + 0.0 AS percent_odd FROM p GROUP BY 1""", ("movie",))
def f06(spark, sf):
    m = fx.movie(spark, sf).withColumn("v", F.when((F.col("frame") + F.col("y") + F.col("x")) % 50 == 0, float("nan")).otherwise(F.col("v")))
    return fr.movie_validate(m, 3).select("session", rnd("mean").alias("mean"), rnd("std").alias("std"), "min", "max", "n_odd", rnd("percent_odd").alias("percent_odd"))


@query("f07_nan_guard", "SELECT session, frame, y, x, CASE WHEN (frame + x) % 20 < 2 THEN 0.0 ELSE v END AS v, CASE WHEN (frame + x) % 20 < 2 THEN 1 ELSE 0 END AS n_replaced FROM movie", ("movie",))
def f07(spark, sf):
    k = (F.col("frame") + F.col("x")) % 20
    return fr.nan_guard(fx.movie(spark, sf).withColumn("v", F.when(k == 0, float("nan")).when(k == 1, float("inf")).otherwise(F.col("v"))), ["v"])
