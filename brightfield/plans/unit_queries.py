"""Queries of segmentation, tiling, cleanup, reports and curation."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from brightfield.operators import cleanup as cl
from brightfield.operators import report as rp
from brightfield.operators import segment as sg
from brightfield.operators import tiles as ti
from brightfield.operators.ingest import session_catalog
from brightfield.operators.reject import shape_props, size_filter, unit_sizes
from brightfield.plans.image_queries import _DENSE, IGNORE, REFLECT, around, grid
from brightfield.plans.registry import query, rnd
from brightfield.plans.trace_queries import COMPONENTS, CORR, EDGES, GROUPS, OVER, THRESHOLDS, R, rounded
from brightfield.sources import fixtures as fx
from brightfield.sources.storage import new_dir

foot = fx.footprints

_NORM = sum(math.exp(-d * d / 2.0) for d in range(-4, 5)) ** 2
_SMOOTH = f"{_DENSE}, sm AS (SELECT session, unit_id, y, x, sum(v * g) / {_NORM} AS v FROM ({around('dense', 'session, unit_id', grid(4, 4, g='exp(-(dy * dy + dx * dx) / 2.0)'), REFLECT)}) GROUP BY ALL)"


def peak_sql(img: str, name: str, d: int, t: float) -> str:
    """Peaks of an image by the same rule; two float images are compared with a margin, which ties of exact copies do not need."""
    return f"{name} AS (SELECT session, unit_id, y, x, any_value(here) AS v FROM ({around(img, 'session, unit_id', grid(d, d), IGNORE)}) JOIN (SELECT session, unit_id, max(v) AS pk FROM {img} GROUP BY 1, 2) USING (session, unit_id) GROUP BY ALL HAVING max(v) <= any_value(here) + 1e-12 AND any_value(here) > {t} * any_value(pk) AND any_value(here) > 0)"


@query("s01_local_peaks", f"WITH {_SMOOTH}, {peak_sql('sm', 'pk', 2, 0.4)} SELECT session, unit_id, y, x, {R('v')} AS v FROM pk", ("foot",))
def s01(spark, sf):
    return rounded(sg.local_peaks(foot(spark, sf), 2, 0.4, 1.0, 8, 8), "v")


@query("s02_peak_search", f"""WITH {_SMOOTH}, {peak_sql('sm', 'p0', 1, 0.3)}, {peak_sql('sm', 'p1', 2, 0.3)}, {peak_sql('dense', 'p2', 1, 0.5)},
u AS (SELECT session, count(DISTINCT unit_id) AS n FROM foot WHERE unit_id <> 0 GROUP BY 1),
m AS (SELECT session, 0 AS k, 1 AS d, 0.3 AS t, 1.0 AS s, count(*) AS c FROM p0 WHERE unit_id <> 0 GROUP BY 1 UNION ALL SELECT session, 1, 2, 0.3, 1.0, count(*) FROM p1 WHERE unit_id <> 0 GROUP BY 1 UNION ALL SELECT session, 2, 1, 0.5, 0.0, count(*) FROM p2 WHERE unit_id <> 0 GROUP BY 1)
SELECT session, d AS min_distance, t::DOUBLE AS threshold_rel, s::DOUBLE AS sigma, {R('c / n')} AS mean_peaks, k = arg_min(k, ROW(-c, k)) OVER (PARTITION BY session) AS best FROM m JOIN u USING (session)""", ("foot",))
def s02(spark, sf):
    return rounded(sg.peak_search(foot(spark, sf), [(1, 0.3, 1.0), (2, 0.3, 1.0), (1, 0.5, 0.0)], 8, 8), "mean_peaks")


@query("s03_basin_label")
def s03(spark, sf):
    return rounded(sg.basin_label(foot(spark, sf), 2, 0.3, 1.0, 8, 8), "a")


def labels(spark, sf):
    """Footprints with the image's quadrant as basin."""
    return foot(spark, sf).withColumn("basin", F.expr("(y div 4) * 2 + x div 4"))


_LAB = "lb AS (SELECT *, (y // 4) * 2 + x // 4 AS basin FROM foot)"


@query("s04_basin_filter", f"WITH {_LAB} SELECT session, unit_id, basin, y, x, {R('a')} AS a FROM lb WHERE (session, unit_id, basin) IN (SELECT (session, unit_id, basin) FROM lb GROUP BY session, unit_id, basin HAVING count(*) >= 8)", ("foot",))
def s04(spark, sf):
    return rounded(sg.basin_filter(labels(spark, sf), 8), "a")


@query("s05_component_table", f"WITH {_LAB}, l2 AS (SELECT session, unit_id, CASE WHEN unit_id % 2 = 0 THEN 0 ELSE basin END AS basin, y, x, a FROM lb) SELECT session, unit_id, basin, count(*) AS size, {R('max(a)')} AS peak, {R('CASE WHEN count(*) < 20 THEN avg(y) ELSE sum(a * y) / sum(a) END')} AS cy, {R('CASE WHEN count(*) < 20 THEN avg(x) ELSE sum(a * x) / sum(a) END')} AS cx FROM l2 GROUP BY ALL", ("foot",))
def s05(spark, sf):
    made = labels(spark, sf).withColumn("basin", F.when(F.col("unit_id") % 2 == 0, F.lit(0)).otherwise(F.col("basin")))
    return rounded(sg.component_table(made), "peak", "cy", "cx")


_CC = "rc AS (SELECT session, unit_id, y, x, y * 8 + x AS r FROM foot UNION SELECT f.session, f.unit_id, f.y, f.x, rc.r FROM rc JOIN foot f ON f.session = rc.session AND f.unit_id = rc.unit_id AND abs(f.y - rc.y) + abs(f.x - rc.x) = 1), cc AS (SELECT session, unit_id, y, x, min(r) AS r FROM rc GROUP BY ALL)"


@query("s06_connected_components", f"WITH RECURSIVE {_CC} SELECT session, unit_id, (r // 8)::INT AS region_y, (r % 8)::INT AS region_x, count(*) AS n FROM cc GROUP BY ALL", ("foot",))
def s06(spark, sf):
    return sg.region_table(foot(spark, sf))


_CEN = "ce AS (SELECT session, unit_id, sum(a * y) / sum(a) AS cy, sum(a * x) / sum(a) AS cx FROM foot GROUP BY 1, 2)"


_CC8 = _CC.replace("abs(f.y - rc.y) + abs(f.x - rc.x) = 1", "greatest(abs(f.y - rc.y), abs(f.x - rc.x)) = 1")


@query("r04_eccentricity", f"""WITH RECURSIVE {_CC8}, rg AS (SELECT session, unit_id, r, count(*) AS n, var_pop(y) + 1 / 12 AS vy, var_pop(x) + 1 / 12 AS vx, covar_pop(y, x) AS c FROM cc GROUP BY ALL),
mn AS (SELECT session, unit_id, sum(n)::BIGINT AS size, arg_min({{'vy': vy, 'vx': vx, 'c': c}}, ROW(-n, r)) AS m FROM rg GROUP BY 1, 2),
gp AS (SELECT session, unit_id, size, (m.vy + m.vx) / 2 AS mid, sqrt(((m.vy - m.vx) / 2) ** 2 + m.c ** 2) AS gap FROM mn)
SELECT session, unit_id, size, {R('sqrt(greatest(0, 1 - (mid - gap) / (mid + gap)))')} AS eccentricity FROM gp""", ("foot",))
def r04_eccentricity(spark, sf):
    return rounded(shape_props(foot(spark, sf)).drop("solidity"), "eccentricity")


def greedy_sql(edges: str, units: str, name: str, most: int) -> str:
    """The sequence as a recursion: one edge (session, u1, u2, s1, s2) after the other, with the owners and added sizes of all units (ids under 64) in lists."""
    return f"""nr AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY u1, u2) AS k FROM {edges}),
st AS (SELECT session, 0::BIGINT AS k, list_transform(range(64), lambda x: -1::BIGINT) AS owner, list_transform(range(64), lambda x: 0::BIGINT) AS added FROM (SELECT DISTINCT session FROM {units}) UNION ALL
 SELECT session, k, CASE WHEN take THEN list_transform(range(64), lambda x: CASE WHEN x = u2 THEN u1 ELSE owner[x + 1] END) ELSE owner END, CASE WHEN take THEN list_transform(range(64), lambda x: added[x + 1] + CASE WHEN x = u1 THEN s2 ELSE 0 END) ELSE added END
 FROM (SELECT st.session, nr.k, owner, added, u1, u2, s2, owner[u1 + 1] = -1 AND owner[u2 + 1] = -1 AND s1 + added[u1 + 1] + s2 <= {most} AS take FROM st JOIN nr ON nr.session = st.session AND nr.k = st.k + 1)),
fin AS (SELECT session, arg_max(owner, k) AS owner FROM st GROUP BY 1)
SELECT session, unit_id, CASE WHEN owner[unit_id + 1] = -1 THEN unit_id ELSE owner[unit_id + 1] END AS {name} FROM {units} JOIN fin USING (session)"""


_CLOSE = f"{_CEN}, sz AS (SELECT session, unit_id, count(*) AS size FROM foot GROUP BY ALL HAVING count(*) >= 9), cz AS (SELECT * FROM ce JOIN sz USING (session, unit_id)), ed AS (SELECT a.session, a.unit_id AS u1, b.unit_id AS u2, a.size AS s1, b.size AS s2 FROM cz a JOIN cz b ON a.session = b.session AND a.unit_id < b.unit_id WHERE sqrt((a.cy - b.cy) ** 2 + (a.cx - b.cx) ** 2) < 0.4 AND greatest(a.size, b.size) < 5 * least(a.size, b.size))"


@query("s07_centroid_merge", f"WITH RECURSIVE {_CLOSE}, {greedy_sql('ed', 'sz', 'group_id', 80)}", ("foot",))
def s07(spark, sf):
    c = ti.centroids(foot(spark, sf)).join(unit_sizes(foot(spark, sf)), ["session", "unit_id"])
    return sg.centroid_merge(c, 0.4, 5, 9, 80)


def grown(src: str, keys: str, r: float, name: str) -> str:
    return f"{name} AS (SELECT DISTINCT {keys}, y + dy AS y, x + dx AS x FROM {src} CROSS JOIN ({grid(int(r), int(r), f'dy * dy + dx * dx <= {r * r}')}) WHERE y + dy BETWEEN 0 AND 7 AND x + dx BETWEEN 0 AND 7)"


_PEAK = "pk AS (SELECT session, unit_id, max(a) AS peak FROM foot GROUP BY 1, 2)"
_DIL = f"{_PEAK}, co AS (SELECT f.* FROM foot f JOIN pk USING (session, unit_id) WHERE a > 0.6 * peak), {grown('co', 'session, unit_id', 1, 'dl')}"


@query("k01_dilate", f"WITH {_DIL} SELECT session, unit_id, y::INT AS y, x::INT AS x FROM dl", ("foot",))
def k01(spark, sf):
    return ti.dilate(foot(spark, sf), 8, 8, 1, 0.6)


@query("k01_dilation_report", f"WITH {_DIL} SELECT session, unit_id, b AS before, c AS after, {R('c / b')} AS ratio FROM (SELECT session, unit_id, count(*) AS b FROM foot GROUP BY 1, 2) JOIN (SELECT session, unit_id, count(*) AS c FROM dl GROUP BY 1, 2) USING (session, unit_id)", ("foot",))
def k01r(spark, sf):
    a = foot(spark, sf)
    return rounded(ti.dilation_report(a, ti.dilate(a, 8, 8, 1, 0.6)), "ratio")


@query("k02_valid_units", f"WITH {_PEAK} SELECT session, unit_id FROM (SELECT session, unit_id, count(*) AS n, any_value(peak) / max(any_value(peak)) OVER (PARTITION BY session) AS rel FROM foot JOIN pk USING (session, unit_id) GROUP BY 1, 2) WHERE n >= 30 AND rel >= 0.6", ("foot",))
def k02(spark, sf):
    return ti.valid_units(foot(spark, sf), 30, 0.6)




@query("k03_centroids", f"WITH {_CEN} SELECT session, unit_id, {R('cy')} AS cy, {R('cx')} AS cx FROM ce", ("foot",))
def k03(spark, sf):
    return rounded(ti.centroids(foot(spark, sf)), "cy", "cx")


@query("k04_knn", f"WITH {_CEN}, d AS (SELECT a.session, a.unit_id, b.unit_id AS neighbour, sqrt((a.cy - b.cy) ** 2 + (a.cx - b.cx) ** 2) AS d FROM ce a JOIN ce b USING (session)) SELECT session, unit_id, neighbour, {R('d')} AS d, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY session, unit_id ORDER BY d, neighbour) AS rank FROM d) WHERE rank <= 4", ("foot",))
def k04(spark, sf):
    return rounded(ti.knn(ti.centroids(foot(spark, sf)), 4, 0.5), "d")


_NEAR = f"{_CEN}, {OVER}, kn AS (SELECT session, u1, u2, row_number() OVER (PARTITION BY session, u1 ORDER BY d, u2) AS rank FROM (SELECT a.session, a.unit_id AS u1, b.unit_id AS u2, sqrt((a.cy - b.cy) ** 2 + (a.cx - b.cx) ** 2) AS d FROM ce a JOIN ce b USING (session))), ed AS (SELECT session, u1, u2, 0 AS s1, 0 AS s2 FROM ov JOIN kn USING (session, u1, u2) WHERE rank <= 5 AND jaccard >= 0.35), un AS (SELECT DISTINCT session, unit_id FROM foot)"


@query("k05_cluster_units", f"WITH RECURSIVE {_NEAR}, {greedy_sql('ed', 'un', 'cluster_id', 0)}", ("foot",))
def k05(spark, sf):
    return ti.cluster_units(foot(spark, sf), 5, 0.35, 0.5)


def clusters(spark, sf):
    return foot(spark, sf).select("session", "unit_id", (F.col("unit_id") % 4).alias("cluster_id")).distinct()


_MASK = f"cs AS (SELECT session, unit_id % 4 AS cluster_id, y, x, sum(a) AS a FROM foot GROUP BY ALL), ck AS (SELECT c.session, c.cluster_id, y, x FROM cs c JOIN (SELECT session, cluster_id, max(a) AS t FROM cs GROUP BY 1, 2) USING (session, cluster_id) WHERE a > 0.85 * t), {grown('ck', 'session, cluster_id', 1, 'mk')}"
_BOX = f"""{_MASK}, b0 AS (SELECT session, cluster_id, greatest(0, min(y) - 1) AS ya, least(8, max(y) + 1) AS yb, greatest(0, min(x) - 1) AS xa, least(8, max(x) + 1) AS xb FROM mk GROUP BY 1, 2),
b1 AS (SELECT session, cluster_id, CASE WHEN 6 - (yb - ya) > 0 THEN greatest(0, ya - (6 - (yb - ya)) // 2) ELSE ya END AS y0, ya, yb, CASE WHEN 6 - (xb - xa) > 0 THEN greatest(0, xa - (6 - (xb - xa)) // 2) ELSE xa END AS x0, xa, xb FROM b0),
bx AS (SELECT session, cluster_id, y0, CASE WHEN 6 - (yb - ya) > 0 THEN least(8, y0 + 6) ELSE yb END AS y1, x0, CASE WHEN 6 - (xb - xa) > 0 THEN least(8, x0 + 6) ELSE xb END AS x1 FROM b1)"""


def bounds(spark, sf):
    return ti.cluster_bounds(ti.cluster_mask(foot(spark, sf), clusters(spark, sf), 8, 8, 1, 0.85), 8, 8, 1, 6)


@query("k06_cluster_mask", f"WITH {_MASK} SELECT session, cluster_id, y::INT AS y, x::INT AS x FROM mk", ("foot",))
def k06m(spark, sf):
    return ti.cluster_mask(foot(spark, sf), clusters(spark, sf), 8, 8, 1, 0.85)


@query("k06_cluster_bounds", f"WITH {_BOX} SELECT session, cluster_id, y0::INT AS y0, y1::INT AS y1, x0::INT AS x0, x1::INT AS x1 FROM bx", ("foot",))
def k06(spark, sf):
    return bounds(spark, sf).select("session", "cluster_id", *(F.col(c).cast("int").alias(c) for c in ("y0", "y1", "x0", "x1")))


@query("k07_bounds_summary", f"""WITH {_BOX}, sz AS (SELECT session, (y1 - y0)::DOUBLE AS height, (x1 - x0)::DOUBLE AS width, ((y1 - y0) * (x1 - x0))::DOUBLE AS area, n::DOUBLE AS units FROM bx JOIN (SELECT session, unit_id % 4 AS cluster_id, count(DISTINCT unit_id) AS n FROM foot GROUP BY 1, 2) USING (session, cluster_id)),
l AS (UNPIVOT sz ON height, width, area, units INTO NAME measure VALUE value)
SELECT session, measure, {R('avg(value)')} AS mean, {R('quantile_cont(value, 0.5)')} AS median, min(value) AS min, max(value) AS max, {R('stddev_pop(value)')} AS std FROM l GROUP BY 1, 2""", ("foot",))
def k07(spark, sf):
    return rounded(ti.bounds_summary(bounds(spark, sf), clusters(spark, sf)), "mean", "median", "std")


_K08 = ("conn", "comp", "circ", "corr", "score")


@query("k08_suggest_spatial", f"""WITH RECURSIVE {_CC}, cn AS (SELECT session, unit_id, max(n) / sum(n) AS conn, sum(n) AS area FROM (SELECT session, unit_id, r, count(*) AS n FROM cc GROUP BY ALL) GROUP BY 1, 2),
bo AS (SELECT session, unit_id, (max(y) - min(y) + 1) * (max(x) - min(x) + 1) AS box, avg(a) AS m FROM foot GROUP BY 1, 2),
gr AS (SELECT session, unit_id, count(*) AS grown FROM (SELECT DISTINCT session, unit_id, y + dy AS y, x + dx AS x FROM foot CROSS JOIN ({grid(1, 1, 'dy * dy + dx * dx <= 1')}) WHERE y + dy BETWEEN 0 AND 7 AND x + dx BETWEEN 0 AND 7) GROUP BY 1, 2),
dd AS (SELECT session, unit_id, y, x, a - m AS d FROM foot JOIN bo USING (session, unit_id)),
au AS (SELECT p.session, p.unit_id, sum(p.d * q.d) / 2 AS c FROM dd p JOIN dd q ON p.session = q.session AND p.unit_id = q.unit_id AND ((q.y = p.y + 1 AND q.x = p.x) OR (q.x = p.x + 1 AND q.y = p.y)) GROUP BY 1, 2),
un AS (SELECT session, unit_id, conn, area / box AS comp, least(1.0, 4 * pi() * area / greatest(grown - area, 1) ** 2) AS circ, coalesce(c / e, 0) AS corr FROM cn JOIN bo USING (session, unit_id) JOIN gr USING (session, unit_id) LEFT JOIN au USING (session, unit_id) JOIN (SELECT session, unit_id, sum(d * d) AS e FROM dd GROUP BY 1, 2) USING (session, unit_id)),
sc AS (SELECT session, avg(conn) AS conn, avg(comp) AS comp, avg(circ) AS circ, avg(corr) AS corr, avg(0.3 * conn + 0.3 * comp + 0.2 * circ + 0.2 * corr) AS score FROM un GROUP BY 1),
sd AS (SELECT session, quantile_cont(s, 0.25) AS p25, quantile_cont(s, 0.5) AS p50, quantile_cont(s, 0.75) AS p75 FROM (SELECT session, y, x, stddev_pop(v) AS s FROM movie WHERE frame < 100 GROUP BY ALL) GROUP BY 1)
SELECT session, {', '.join(f'round({c}, 9) + 0.0 AS {c}' for c in _K08)}, {R('p75')} AS std_high, {R('p50')} AS std_mid, {R('0.5 * p25')} AS std_low, round((2 - score) * 1e-4, 10) AS penalty_high, round((2 - score) * 1e-5, 10) AS penalty_mid, round((2 - score) * 1e-6, 10) AS penalty_low FROM sc JOIN sd USING (session)""", ("foot", "movie"))
def k08(spark, sf):
    made = rounded(ti.suggest_spatial(fx.movie(spark, sf), foot(spark, sf), 8, 8, 100), "std_high", "std_mid", "std_low").withColumns({c: rnd(c, 9) for c in _K08})
    return made.withColumns({c: F.round(c, 10) for c in ("penalty_high", "penalty_mid", "penalty_low")})


@query("l01_spatial_update")
def l01(spark, sf):
    _, f = fx.background(spark, sf)
    mask = ti.cluster_mask(foot(spark, sf), clusters(spark, sf), 8, 8, 1, 0.5)
    return rounded(ti.spatial_update(fx.movie(spark, sf), fx.traces(spark, sf), f, clusters(spark, sf), mask, min_std=0.01), "a")


@query("l02_growth_cap", f"WITH k AS (SELECT *, row_number() OVER (PARTITION BY session, unit_id ORDER BY a DESC, y, x) AS k, floor((unit_id % 4) * 2.5) AS cap FROM foot) SELECT session, unit_id, y, x, {R('a')} AS a FROM k WHERE cap = 0 OR k <= cap", ("foot",))
def l02(spark, sf):
    a = foot(spark, sf)
    return rounded(ti.growth_cap(a, a.select("session", "unit_id", (F.col("unit_id") % 4).alias("size")).distinct(), 2.5), "a")


@query("l03_replace_tiles", f"SELECT session, unit_id, y, x, {R('CASE WHEN unit_id % 2 = 0 AND y >= 2 AND y < 6 AND x >= 1 AND x < 5 THEN 2 * a ELSE a END')} AS a FROM foot WHERE NOT (unit_id % 2 = 0 AND y >= 2 AND y < 6 AND x >= 1 AND x < 5 AND a < 0.01)", ("foot",))
def l03(spark, sf):
    a = foot(spark, sf)
    boxes = a.where("unit_id % 2 = 0").select("session", "unit_id", F.lit(2).alias("y0"), F.lit(6).alias("y1"), F.lit(1).alias("x0"), F.lit(5).alias("x1")).distinct()
    return rounded(ti.replace_tiles(a, a.where("a >= 0.01").withColumn("a", 2 * F.col("a")), boxes), "a")


@query("l04_overlap_split", f"SELECT session, unit_id, y, x, {R('a / count(*) OVER (PARTITION BY session, y, x)')} AS a FROM foot", ("foot",))
def l04(spark, sf):
    return rounded(ti.overlap_split(foot(spark, sf)), "a")


@query("l05_trace_floor", f"SELECT session, unit_id, frame, {R('v - min(v) OVER (PARTITION BY session)')} AS v FROM traces", ("traces",))
def l05(spark, sf):
    return rounded(ti.trace_floor(fx.traces(spark, sf)), "v")


@query("e01_trim_halo", f"WITH {_PEAK} SELECT session, unit_id, y, x, {R('a')} AS a FROM foot JOIN pk USING (session, unit_id) WHERE a > 0.25 * peak", ("foot",))
def e01(spark, sf):
    return rounded(cl.trim_halo(foot(spark, sf)), "a")


@query("e02_split_fragments")
def e02(spark, sf):
    return rounded(cl.split_fragments(foot(spark, sf), 8, 8, 4), "a")


def fragments(spark, sf):
    f = cl.split_fragments(foot(spark, sf), 8, 8, 4, mode="lump")
    a = f.select("session", cl.fragment_id().alias("unit_id"), "y", "x", "a")
    lineage = cl.fragment_ids(f)
    c = fx.traces(spark, sf).withColumnRenamed("unit_id", "parent_unit_id").join(lineage, ["session", "parent_unit_id"]).select("session", "unit_id", "frame", "v")
    return a, c, lineage


@query("e03_merge_guarded")
def e03(spark, sf):
    return cl.merge_guarded(*fragments(spark, sf), 0.5, 0.3)


_GUARDED = EDGES.replace("WHERE", "WHERE u1 % 3 <> u2 % 3 AND")


@query("e03_merge_lineage", f"WITH RECURSIVE {OVER}, {CORR}, {_GUARDED}, {COMPONENTS}, {GROUPS} SELECT session, unit_id, group_id, split FROM gr", ("traces",))
def e03_lineage(spark, sf):
    """Units as fragments of three parents; those of one parent are not linked directly."""
    a = foot(spark, sf)
    lineage = a.select("session", "unit_id", (F.col("unit_id") % 3).alias("parent_unit_id")).distinct()
    return cl.merge_guarded(a, fx.traces(spark, sf), lineage, *THRESHOLDS, most=50)


@query("e04_cut_seams", f"""WITH o AS (SELECT session, y, x, arg_min(unit_id, ROW(-a, unit_id)) AS unit_id, max(a) AS a FROM foot WHERE unit_id < 3 AND (y < 3 OR unit_id <> 1) GROUP BY ALL),
s AS (SELECT p.session, p.y, p.x FROM o p JOIN o q ON p.session = q.session AND abs(p.y - q.y) <= 1 AND abs(p.x - q.x) <= 1 GROUP BY 1, 2, 3 HAVING min(q.unit_id) <> max(q.unit_id))
SELECT session, unit_id, y, x, {R('a')} AS a FROM o WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.session = o.session AND (s.y - o.y) ** 2 + (s.x - o.x) ** 2 <= 0)""", ("foot",))
def e04(spark, sf):
    return rounded(cl.cut_seams(foot(spark, sf).where("unit_id < 3 and (y < 3 or unit_id <> 1)"), 8, 8, 0), "a")


@query("e04_cut_seams_all", f"""WITH o AS (SELECT session, y, x, arg_min(unit_id, ROW(-a, unit_id)) AS unit_id, max(a) AS a FROM foot GROUP BY ALL),
s AS (SELECT p.session, p.y, p.x FROM o p JOIN o q ON p.session = q.session AND abs(p.y - q.y) <= 1 AND abs(p.x - q.x) <= 1 GROUP BY 1, 2, 3 HAVING min(q.unit_id) <> max(q.unit_id))
SELECT session, unit_id, y, x, {R('a')} AS a FROM o WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.session = o.session AND (s.y - o.y) ** 2 + (s.x - o.x) ** 2 <= 0)""", ("foot",))
def e04_all(spark, sf):
    return rounded(cl.cut_seams(foot(spark, sf), 8, 8, 0), "a")


@query("e05_cleanup")
def e05(spark, sf):
    return rounded(cl.cleanup(foot(spark, sf), fx.traces(spark, sf), 8, 8, drop=4, containment=0.5, r=0.3, seam=0)[0], "a")


@query("e06_export", f"SELECT session, unit_id, y, x, {R('a')} AS a FROM foot", ("foot",))
def e06(spark, sf):
    path = new_dir(spark, "export")
    a = foot(spark, sf)
    cl.export({"footprints": a, "sizes": unit_sizes(a)}, path)
    return rounded(cl.read_export(spark, path, "footprints").select("session", "unit_id", "y", "x", "a"), "a")


@query("e07_export_summary", f"""WITH u AS (SELECT session, unit_id, count(*) AS size FROM foot WHERE unit_id % 3 <> 0 GROUP BY 1, 2), p AS (SELECT session, unit_id, max(v) AS peak FROM traces WHERE unit_id % 3 <> 0 GROUP BY 1, 2)
SELECT session, count(*) AS units, {R('avg(size)')} AS mean_size, {R('avg(peak)')} AS mean_peak, {R('stddev_pop(peak)')} AS std_peak, (SELECT {R('max(a)')} FROM foot f WHERE f.session = u.session AND unit_id % 3 <> 0) AS projection_max, (SELECT {R('avg(v)')} FROM traces t WHERE t.session = u.session AND unit_id % 3 <> 0) AS mean_trace, {R('100.0 * count(*) / (SELECT count(DISTINCT unit_id) FROM foot f WHERE f.session = u.session)')} AS retained_percent FROM u JOIN p USING (session, unit_id) GROUP BY 1""", ("traces",))
def e07(spark, sf):
    a, t = foot(spark, sf), fx.traces(spark, sf)
    n = a.groupBy("session").agg(F.countDistinct("unit_id").alias("n_before"))
    made = cl.export_summary(a.where("unit_id % 3 <> 0"), t.where("unit_id % 3 <> 0"), n)
    return rounded(made, *(c for c in made.columns if c not in ("session", "units")))


@query("e07_export_summary_kept", f"""WITH u AS (SELECT session, unit_id, count(*) AS size FROM foot GROUP BY 1, 2 HAVING count(*) BETWEEN 30 AND 33), f AS (SELECT * FROM foot SEMI JOIN u USING (session, unit_id)), t AS (SELECT * FROM traces SEMI JOIN u USING (session, unit_id)), p AS (SELECT session, unit_id, max(v) AS peak FROM t GROUP BY 1, 2)
SELECT session, count(*) AS units, {R('avg(size)')} AS mean_size, {R('avg(peak)')} AS mean_peak, {R('stddev_pop(peak)')} AS std_peak, (SELECT {R('max(a)')} FROM f WHERE f.session = u.session) AS projection_max, (SELECT {R('avg(v)')} FROM t WHERE t.session = u.session) AS mean_trace, {R('100.0 * count(*) / (SELECT count(DISTINCT unit_id) FROM foot WHERE foot.session = u.session)')} AS retained_percent FROM u JOIN p USING (session, unit_id) GROUP BY 1""", ("traces",))
def e07_kept(spark, sf):
    a, t = foot(spark, sf), fx.traces(spark, sf)
    n = a.groupBy("session").agg(F.countDistinct("unit_id").alias("n_before"))
    kept = size_filter(a, 30, 33)
    made = cl.export_summary(a.join(kept, ["session", "unit_id"], "left_semi"), t.join(kept, ["session", "unit_id"], "left_semi"), n)
    return rounded(made, *(c for c in made.columns if c not in ("session", "units")))


@query("e07_size_histogram", "SELECT session, CASE WHEN n < 25 THEN 0 WHEN n >= 40 THEN 6 ELSE floor((n - 25) / 3.0)::BIGINT + 1 END AS bin, count(*) AS n FROM (SELECT session, unit_id, count(*) AS n FROM foot GROUP BY 1, 2) GROUP BY ALL", ("foot",))
def e07h(spark, sf):
    return cl.size_histogram(foot(spark, sf), 25.0, 40.0, 5)


STEPS = ["click", "error", "purchase", "signup", "view"]


@query("q01_step_counts", "WITH c AS (SELECT user_id AS session, event_type AS step, date_diff('day', TIMESTAMP '2024-01-01', date_trunc('day', ts)) AS run, count(*) AS n FROM events GROUP BY ALL), l AS (SELECT session, step, arg_max(n, run) AS n FROM c GROUP BY 1, 2) SELECT session, " + ", ".join(f"max(n) FILTER (step = '{s}') AS {s}" for s in STEPS) + " FROM l GROUP BY 1")
def q01(spark, sf):
    e = fx.table(spark, sf, "events")
    counts = e.groupBy(F.col("user_id").alias("session"), F.col("event_type").alias("step"), F.datediff("ts", F.lit("2024-01-01").cast("date")).alias("run")).agg(F.count("*").alias("n"))
    return rp.step_counts(counts, STEPS)


@query("q02_qc_alignment", f"""WITH a AS (SELECT session, unit_id, max(CASE WHEN unit_id = 2 THEN 0 ELSE a END) AS peak FROM foot WHERE unit_id <> 5 GROUP BY 1, 2), c AS (SELECT DISTINCT session, unit_id FROM traces WHERE unit_id <> 6),
b AS (SELECT session, unit_id, a.unit_id IS NOT NULL AS ha, c.unit_id IS NOT NULL AS hc, peak FROM a FULL JOIN c USING (session, unit_id)),
s AS (SELECT session, count(*) FILTER (peak IS NOT NULL) AS n_footprints, (SELECT count(*) FROM c WHERE c.session = b.session) AS n_traces, count(*) FILTER (peak <= 0) AS n_empty, (SELECT count(*) FROM c WHERE c.session = b.session AND unit_id = 3) AS n_odd, (SELECT count(*) FROM c WHERE c.session = b.session AND unit_id = 4) AS n_silent FROM b GROUP BY 1),
k AS (SELECT session, count(*) AS n_common FROM a JOIN c USING (session, unit_id) GROUP BY 1)
SELECT session, n_footprints, n_traces, n_empty, n_odd, n_silent, n_common, 'by id' AS alignment, {R('(SELECT count(DISTINCT frame) FROM traces t WHERE t.session = s.session) / 10.0 / 60')} AS minutes FROM s JOIN k USING (session)""", ("traces",))
def q02(spark, sf):
    a = foot(spark, sf).where("unit_id <> 5").withColumn("a", F.when(F.col("unit_id") == 2, 0.0).otherwise(F.col("a")))
    t = fx.traces(spark, sf).where("unit_id <> 6").withColumn("v", F.when((F.col("unit_id") == 3) & (F.col("frame") == 1), float("nan")).when(F.col("unit_id") == 4, 0.0).otherwise(F.col("v")))
    return rounded(rp.qc_alignment(a, t), "minutes")


@query("q03_qc_scale_range", f"SELECT session, unit_id, frame, {R('CASE WHEN max(v) OVER w > min(v) OVER w THEN (v - min(v) OVER w) / (max(v) OVER w - min(v) OVER w) * 0.9 ELSE 0 END')} AS v FROM days WINDOW w AS (PARTITION BY session, unit_id)", ("days",))
def q03(spark, sf):
    return rounded(rp.qc_scale(fx.days(spark, sf)), "v")


@query("q03_qc_scale_zscore", f"SELECT session, unit_id, frame, {R('CASE WHEN stddev_pop(v) OVER w > 0 THEN (v - avg(v) OVER w) / stddev_pop(v) OVER w ELSE 0 END')} AS v FROM days WINDOW w AS (PARTITION BY session, unit_id)", ("days",))
def q03z(spark, sf):
    return rounded(rp.qc_scale(fx.days(spark, sf), "zscore"), "v")


def failures(spark, sf):
    e = fx.table(spark, sf, "events")
    text = F.when(F.col("event_type") == "error", F.concat(F.lit("Error: code "), F.col("props"))).when(F.col("event_type") == "signup", F.concat(F.lit("Step s"), (F.col("event_id") % 7).cast("string"), F.when(F.col("event_id") % 2 == 0, " failed").otherwise(" incomplete"))).otherwise("progress")
    return rp.failure_scan(e.select(F.col("user_id").alias("session"), F.struct("ts", "event_id").alias("line_no"), text.alias("text"))).withColumn("line_no", F.col("line_no.event_id"))


_FAIL = """f AS (SELECT user_id AS session, event_id AS line_no, event_type, 'Error: code ' || props AS err, 's' || event_id % 7 AS step, CASE WHEN event_id % 2 = 0 THEN 'failed' ELSE 'incomplete' END AS status,
  coalesce(sum((event_type = 'signup')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS part, ts FROM events),
g AS (SELECT session, part, max(line_no) FILTER (event_type = 'signup') AS line_no, any_value(step) FILTER (event_type = 'signup') AS step, any_value(status) FILTER (event_type = 'signup') AS status, arg_max(err, ROW(ts, line_no)) FILTER (event_type = 'error') AS error FROM f GROUP BY 1, 2)"""


@query("q04_failure_scan", f"WITH {_FAIL} SELECT session, line_no, step, status, error FROM g WHERE line_no IS NOT NULL")
def q04(spark, sf):
    return failures(spark, sf)


@query("q04_failure_counts", f"WITH {_FAIL} SELECT step, status, count(*) AS n FROM g WHERE line_no IS NOT NULL GROUP BY 1, 2")
def q04c(spark, sf):
    return rp.failure_counts(failures(spark, sf))


def summary(spark, sf):
    c = fx.table(spark, sf, "customer")
    catalog = session_catalog(c.select(F.concat(F.lit("/data/"), F.col("c_nationkey").cast("string"), F.lit("_"), F.col("c_custkey").cast("string"), F.lit("_Processed")).alias("path")))
    o = fx.table(spark, sf, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"))
    runs = o.select(F.concat_ws("_", F.col("c_nationkey").cast("string"), F.col("c_custkey").cast("string")).alias("label"), F.col("o_orderkey").alias("run"), (F.col("o_orderkey") % 3).alias("code"), (F.col("o_totalprice") / 100).alias("seconds"), (F.col("o_orderkey") % 11 == 0).alias("timed_out"))
    return rp.batch_summary(catalog, runs)


_BATCH = """r AS (SELECT o_custkey, arg_max(o_orderkey, o_orderkey) AS k, arg_max(o_totalprice / 100, o_orderkey) AS sec FROM orders GROUP BY 1),
b AS (SELECT c_nationkey || '_' || c_custkey AS label, CASE WHEN k IS NULL THEN 'MISSING' WHEN k % 11 = 0 THEN 'TIMEOUT' WHEN k % 3 <> 0 THEN 'FAILED' ELSE 'OK' END AS status, coalesce(sec, 0) / 60 AS minutes FROM customer LEFT JOIN r ON o_custkey = c_custkey)"""


@query("q05_batch_summary", f"WITH {_BATCH} SELECT label, status, {R('minutes')} AS minutes FROM b")
def q05(spark, sf):
    return rounded(summary(spark, sf), "minutes")


@query("q05_batch_totals", f"WITH {_BATCH} SELECT count(*) AS sessions, count(*) FILTER (status = 'OK') AS ok, count(*) FILTER (status <> 'OK') AS attention, round(sum(minutes), 4) AS minutes FROM b")
def q05t(spark, sf):
    return rp.batch_totals(summary(spark, sf)).withColumn("minutes", F.round("minutes", 4))


_GT = sum(math.exp(-d * d / 2.0) for d in range(-4, 5))


@query("b01_smooth_gaussian", f"SELECT a.session, a.unit_id, a.frame, {R(f'sum(exp(-(d * d) / 2.0) * b.v) / {_GT}')} AS v FROM days a CROSS JOIN (SELECT unnest(range(-4, 5)) AS d) JOIN days b ON a.session = b.session AND a.unit_id = b.unit_id AND b.frame = CASE WHEN a.frame + d < 0 THEN -1 - (a.frame + d) WHEN a.frame + d > 29 THEN 59 - (a.frame + d) ELSE a.frame + d END GROUP BY 1, 2, 3", ("days",))
def b01(spark, sf):
    return rounded(rp.smooth_trace(fx.days(spark, sf), 6, "gaussian"), "v")


@query("b01_smooth_moving", f"SELECT a.session, a.unit_id, a.frame, {R('avg(b.v)')} AS v FROM days a CROSS JOIN (SELECT unnest(range(-2, 3)) AS d) JOIN days b ON a.session = b.session AND a.unit_id = b.unit_id AND b.frame = greatest(0, least(29, a.frame + d)) GROUP BY 1, 2, 3", ("days",))
def b01m(spark, sf):
    return rounded(rp.smooth_trace(fx.days(spark, sf), 5, "moving"), "v")


@query("b01_smooth_exponential", f"SELECT a.session, a.unit_id, a.frame, {R('sum(b.v * CASE WHEN b.frame = 0 THEN 0.6 ** a.frame ELSE 0.4 * 0.6 ** (a.frame - b.frame) END)')} AS v FROM days a JOIN days b ON a.session = b.session AND a.unit_id = b.unit_id AND b.frame <= a.frame GROUP BY 1, 2, 3", ("days",))
def b01e(spark, sf):
    return rounded(rp.smooth_trace(fx.days(spark, sf), 4, "exponential"), "v")


@query("b01_smooth_both", f"""WITH f AS (SELECT a.session, a.unit_id, a.frame, sum(b.v * CASE WHEN b.frame = 0 THEN 0.6 ** a.frame ELSE 0.4 * 0.6 ** (a.frame - b.frame) END) AS v FROM days a JOIN days b ON a.session = b.session AND a.unit_id = b.unit_id AND b.frame <= a.frame GROUP BY 1, 2, 3)
SELECT a.session, a.unit_id, a.frame, {R('sum(b.v * CASE WHEN b.frame = 29 THEN 0.6 ** (29 - a.frame) ELSE 0.4 * 0.6 ** (b.frame - a.frame) END)')} AS v FROM f a JOIN f b ON a.session = b.session AND a.unit_id = b.unit_id AND b.frame >= a.frame GROUP BY 1, 2, 3""", ("days",))
def b01b(spark, sf):
    return rounded(rp.smooth_trace(fx.days(spark, sf), 4, "both"), "v")


@query("b02_thin_zscore", f"WITH k AS (SELECT * FROM days WHERE frame / 2.0 >= 3 AND frame / 2.0 < 12 AND frame % 2 = 0) SELECT session, unit_id, {R('frame / 2.0')} AS seconds, {R('CASE WHEN stddev_pop(v) OVER w > 0 THEN (v - avg(v) OVER w) / stddev_pop(v) OVER w ELSE 0 END')} AS v FROM k WINDOW w AS (PARTITION BY session, unit_id)", ("days",))
def b02(spark, sf):
    return rounded(rp.thin_zscore(fx.days(spark, sf), 3, 12, 2.0, 2), "seconds", "v")


@query("b03_dominant_unit", f"WITH {_PEAK}, s AS (SELECT session, unit_id, y, x, a / peak * 0.8 AS a FROM foot JOIN pk USING (session, unit_id)) SELECT session, y, x, {R('max(a)')} AS a, arg_min(unit_id, ROW(-a, unit_id)) AS unit_id FROM s GROUP BY ALL", ("foot",))
def b03(spark, sf):
    return rounded(rp.dominant_unit(foot(spark, sf)), "a")


@query("b04_area_at", f"WITH {_PEAK} SELECT session, unit_id, count(*) FILTER (a > 0.5 * peak) AS area FROM foot JOIN pk USING (session, unit_id) GROUP BY 1, 2", ("foot",))
def b04(spark, sf):
    return rp.area_at(foot(spark, sf), 0.5)


@query("b05_activity_image", f"WITH {_PEAK}, c AS (SELECT session, unit_id, frame, CASE WHEN max(v) OVER w > min(v) OVER w THEN least(1.0, (v - min(v) OVER w) / (max(v) OVER w - min(v) OVER w) / 0.7) ELSE 0 END AS l FROM traces WHERE frame IN (3, 50, 120) WINDOW w AS (PARTITION BY session, frame)) SELECT session, frame, y, x, {R('max(least(1.0, a) * l)')} AS v FROM foot JOIN pk USING (session, unit_id) JOIN c USING (session, unit_id) WHERE a > 0.05 * peak GROUP BY ALL", ("traces",))
def b05(spark, sf):
    return rounded(rp.activity_image(foot(spark, sf), fx.traces(spark, sf), [3, 50, 120], 0.7), "v")


@query("b06_hide_units", f"SELECT session, unit_id, frame, {R('v')} AS v FROM traces WHERE unit_id NOT IN (1, 6)", ("traces",))
def b06(spark, sf):
    t = fx.traces(spark, sf)
    return rounded(rp.hide_units(t, t.where("unit_id in (1, 6)").select("session", "unit_id").distinct()), "v")

