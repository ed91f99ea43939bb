"""Queries of stencils, motion, crop and background."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from brightfield.operators import background as bg
from brightfield.operators import motion as mo
from brightfield.operators import stencil as st
from brightfield.operators.arrays import as_pixels, is_frames
from brightfield.operators.frames import motion_outliers
from brightfield.plans.registry import query, rnd
from brightfield.sources import fixtures as fx

REFLECT = "CASE WHEN {c} < 0 THEN -1 - ({c}) WHEN {c} > 7 THEN 15 - ({c}) ELSE {c} END"
REFLECT101 = "CASE WHEN {c} < 0 THEN -({c}) WHEN {c} > 7 THEN 14 - ({c}) ELSE {c} END"
REPLICATE = "greatest(0, least(7, {c}))"
IGNORE = "{c}"


def around(img: str, keys: str, offsets: str, border: str) -> str:
    """SQL rows (keys, y, x, v, g): the values around each pixel of img."""
    on = " AND ".join(f"t.{k} = s.{k}" for k in keys.split(", "))
    ks = ", ".join(f"t.{k}" for k in keys.split(", "))
    return f"SELECT {ks}, t.y, t.x, t.v AS here, s.v, o.g, o.dy, o.dx FROM {img} t CROSS JOIN ({offsets}) o JOIN {img} s ON {on} AND s.y = {border.format(c='t.y + o.dy')} AND s.x = {border.format(c='t.x + o.dx')}"


def grid(ry: int, rx: int, where: str = "true", g: str = "1.0") -> str:
    return f"SELECT dy, dx, {g} AS g FROM (SELECT unnest(range(-{ry}, {ry + 1})) AS dy) CROSS JOIN (SELECT unnest(range(-{rx}, {rx + 1})) AS dx) WHERE {where}"


def shown(df):
    return (as_pixels(df) if is_frames(df) else df).select("session", "frame", "y", "x", rnd("v").alias("v"))


FR = "session, frame"
OUT = "SELECT session, frame, y, x, round(v, 6) + 0.0 AS v FROM r"


@query("p01_stencil", f"WITH r AS (SELECT session, frame, y, x, max(v) AS v FROM ({around('movie', FR, grid(1, 2), IGNORE)}) GROUP BY ALL) {OUT}", ("movie",))
def p01(spark, sf):
    return shown(st.stencil(fx.frames(spark, sf), [(dy, dx, 1.0) for dy in (-1, 0, 1) for dx in range(-2, 3)], "max", "ignore", 8, 8))


_MIN = "m AS (SELECT session, frame, y, x, v - min(v) OVER (PARTITION BY session, y, x) AS v FROM movie)"


@query("p02_min_subtract", f"WITH {_MIN} SELECT session, frame, y, x, round(v, 6) + 0.0 AS v FROM m", ("movie",))
def p02(spark, sf):
    return shown(st.min_subtract(fx.frames(spark, sf), 8, 8))


@query("p03_median_denoise", f"WITH r AS (SELECT session, frame, y, x, quantile_cont(v, 0.5) AS v FROM ({around('movie', FR, grid(1, 1), REPLICATE)}) GROUP BY ALL) {OUT}", ("movie",))
def p03(spark, sf):
    return shown(st.median_denoise(fx.frames(spark, sf), 3, 8, 8))


_S = 0.3 * ((5 - 1) * 0.5 - 1) + 0.8
_G = f"exp(-(dy * dy + dx * dx) / {2 * _S * _S})"


@query("p04_gaussian_denoise", f"WITH r AS (SELECT session, frame, y, x, sum(v * g) / {sum(math.exp(-d * d / (2 * _S * _S)) for d in range(-2, 3)) ** 2} AS v FROM ({around('movie', FR, grid(2, 2, g=_G), REFLECT101)}) GROUP BY ALL) {OUT}", ("movie",))
def p04(spark, sf):
    return shown(st.gaussian_denoise(fx.frames(spark, sf), 5, 8, 8))


@query("p05_bilateral_denoise", f"WITH a AS ({around('movie', FR, grid(1, 1, 'dy * dy + dx * dx <= 1', 'exp(-(dy * dy + dx * dx) / 11250.0)'), REFLECT101)}), r AS (SELECT session, frame, y, x, sum(v * g * exp(-((v - here) ** 2) / 0.02)) / sum(g * exp(-((v - here) ** 2) / 0.02)) AS v FROM a GROUP BY ALL) {OUT}", ("movie",))
def p05(spark, sf):
    return shown(st.bilateral_denoise(fx.frames(spark, sf), 3, 8, 8, 75.0, 0.1))


def _diffuse(src: str, dst: str) -> str:
    step = lambda f, line, along: f"coalesce({f}(v) OVER (PARTITION BY session, frame, {line} ORDER BY {along}) - v, 0)"
    parts = [step(f, *a) for a in (("y", "x"), ("x", "y")) for f in ("lag", "lead")]
    return f"{dst} AS (SELECT session, frame, y, x, v + 0.1 * (" + " + ".join(f"d{i} * exp(-((d{i} / 0.2) ** 2))" for i in range(4)) + ") AS v FROM (SELECT *, " + ", ".join(f"{p} AS d{i}" for i, p in enumerate(parts)) + f" FROM {src}))"


@query("p06_anisotropic_denoise", f"WITH {_diffuse('movie', 'd1')}, {_diffuse('d1', 'r')} {OUT}", ("movie",))
def p06(spark, sf):
    return shown(st.anisotropic_denoise(fx.frames(spark, sf), 2, 0.2, 0.1, 8, 8))


_DISK = grid(2, 2, "dy * dy + dx * dx <= 4")


@query("p07_tophat_background", f"WITH e AS (SELECT session, frame, y, x, min(v) AS v FROM ({around('movie', FR, _DISK, IGNORE)}) GROUP BY ALL), o AS (SELECT session, frame, y, x, max(v) AS low FROM ({around('e', FR, _DISK, IGNORE)}) GROUP BY ALL), r AS (SELECT session, frame, y, x, v - low AS v FROM movie JOIN o USING (session, frame, y, x)) {OUT}", ("movie",))
def p07(spark, sf):
    return shown(st.tophat_background(fx.frames(spark, sf), 2, 8, 8))


def _uniform(src: str, dst: str) -> str:
    return f"{dst} AS (SELECT session, frame, y, x, any_value(here) - avg(v) AS v FROM ({around(src, FR, grid(1, 1), REFLECT)}) GROUP BY ALL)"


@query("p08_uniform_background", f"WITH {_uniform('movie', 'r')} {OUT}", ("movie",))
def p08(spark, sf):
    return shown(st.uniform_background(fx.frames(spark, sf), 3, 8, 8))


@query("p09_preprocess", f"WITH {_MIN}, {_uniform('m', 'u')}, r AS (SELECT session, frame, y, x, quantile_cont(v, 0.5) AS v FROM ({around('u', FR, grid(1, 1), REPLICATE)}) GROUP BY ALL) {OUT}", ("movie",))
def p09(spark, sf):
    return shown(st.preprocess(fx.frames(spark, sf), 8, 8))


_DENSE = "dense AS (SELECT u.session, u.unit_id, g.y, g.x, coalesce(f.a, 0) AS v FROM (SELECT DISTINCT session, unit_id FROM foot) u CROSS JOIN (SELECT y, x FROM (SELECT unnest(range(8))::INT AS y) CROSS JOIN (SELECT unnest(range(8))::INT AS x)) g LEFT JOIN foot f USING (session, unit_id, y, x))"
_NORM = sum(math.exp(-d * d / 2.0) for d in range(-4, 5)) ** 2


@query("p10_gaussian_image", f"WITH {_DENSE} SELECT session, unit_id, y, x, round(sum(v * g) / {_NORM}, 6) + 0.0 AS v FROM ({around('dense', 'session, unit_id', grid(4, 4, g='exp(-(dy * dy + dx * dx) / 2.0)'), REFLECT)}) GROUP BY ALL", ("foot",))
def p10(spark, sf):
    return st.gaussian_image(st.densify(fx.footprints(spark, sf), 8, 8), 1.0, 8, 8).select("session", "unit_id", "y", "x", rnd("v").alias("v"))


@query("m01_pair_shift")
def m01(spark, sf):
    return mo.pair_shift(fx.frames(spark, sf), block=100)


@query("m01_known_shifts", "SELECT vec_id::VARCHAR AS session, 1::BIGINT AS frame, (vec_id % 5 - 2)::DOUBLE AS dy, (vec_id % 7 - 3)::DOUBLE AS dx FROM embeddings")
def m01_known(spark, sf):
    """Each vector as an image and, as the next frame, the image moved by known whole pixels, what leaves on one side coming in on the other."""
    e = fx.table(spark, sf, "embeddings").select("vec_id", "embedding")
    moved = F.expr("transform(sequence(0, 63), p -> embedding[cast(pmod(p div 8 - vec_id % 5 + 2, 8) * 8 + pmod(p % 8 - vec_id % 7 + 3, 8) as int)])")
    both = e.select(F.col("vec_id").cast("string").alias("session"), F.explode(F.array(F.struct(F.lit(0).cast("long").alias("frame"), F.col("embedding").alias("px")), F.struct(F.lit(1).cast("long").alias("frame"), moved.alias("px")))).alias("f"))
    made = mo.pair_shift(both.select("session", "f.frame", F.lit(8).alias("h"), F.lit(8).alias("w"), "f.px"))
    return made.select("session", "frame", rnd("dy").alias("dy"), rnd("dx").alias("dx"))


@query("m02_estimate_motion")
def m02(spark, sf):
    return mo.estimate_motion(fx.frames(spark, sf))


@query("m03_apply_shift", """WITH b AS (SELECT m.*, dy, dx FROM movie m JOIN motion USING (session, frame)),
p AS (SELECT t.session, t.frame, t.y, t.x, coalesce(sum(s.v * (1 - abs(t.y - t.dy - s.y)) * (1 - abs(t.x - t.dx - s.x))), 0) AS v FROM b t LEFT JOIN movie s ON s.session = t.session AND s.frame = t.frame AND abs(t.y - t.dy - s.y) < 1 AND abs(t.x - t.dx - s.x) < 1 GROUP BY ALL)
SELECT session, frame, y, x, round(v, 6) + 0.0 AS v FROM p""", ("movie", "motion"))
def m03(spark, sf):
    return shown(mo.apply_shift(fx.frames(spark, sf), fx.motion(spark, sf), 8, 8))


_R = lambda e: f"round({e}, 6) + 0.0"


@query("m04_motion_summary", f"""WITH o AS (SELECT session, count(*) AS n FROM motion JOIN (SELECT session, avg(dy) AS my, stddev_pop(dy) AS sy, avg(dx) AS mx, stddev_pop(dx) AS sx FROM motion GROUP BY 1) USING (session) WHERE abs(dy) > my + 1.5 * sy OR abs(dx) > mx + 1.5 * sx GROUP BY 1)
SELECT session, {', '.join(f"{_R(f'{f}({c})')} AS {n}_{c}" for c in ('dy', 'dx') for n, f in (('mean', 'avg'), ('std', 'stddev_pop'), ('min', 'min'), ('max', 'max')))}, coalesce(any_value(o.n), 0)::BIGINT AS n_bad FROM motion LEFT JOIN o USING (session) GROUP BY 1""", ("motion",))
def m04(spark, sf):
    m = fx.motion(spark, sf)
    made = mo.motion_summary(m, motion_outliers(m, 1.5))
    return made.select("session", *(rnd(c).alias(c) for c in made.columns if c not in ("session", "n_bad")), "n_bad")


@query("c01_crop_square", "SELECT * FROM movie WHERE y >= 2 AND y < 8 AND x >= 0 AND x < 6", ("movie",))
def c01(spark, sf):
    return bg.crop_square(fx.movie(spark, sf), 8, 8, 0.75, 1, -1, 1)


@query("c02_mask_circle", "SELECT session, frame, y, x, CASE WHEN sqrt((y - 3.5) ** 2 + (x - 3.5) ** 2) <= 3.2 THEN v ELSE 0.0 END AS v FROM movie", ("movie",))
def c02(spark, sf):
    return bg.mask_circle(fx.movie(spark, sf), 8, 8, 0.8)


_RING = grid(3, 3, "sqrt(dy * dy + dx * dx) <= 3 AND sqrt(dy * dy + dx * dx) >= 2")
_RINGED = f"im AS (SELECT session, y, x, avg(v) AS v FROM movie WHERE frame < 100 GROUP BY ALL), rg AS (SELECT session, y, x, avg(v) AS low FROM ({around('im', 'session', _RING, REFLECT)}) GROUP BY ALL), r AS (SELECT session, frame, y, x, greatest(v - low, 0) AS v FROM movie JOIN rg USING (session, y, x))"


@query("c03_ring_background", f"WITH {_RINGED} {OUT}", ("movie",))
def c03(spark, sf):
    return shown(bg.ring_background(fx.frames(spark, sf), 8, 8, 3, 1, 100))


@query("c04_lowrank_basis")
def c04(spark, sf):
    return bg.lowrank_basis(fx.movie(spark, sf), 8, 8, 3, 2).withColumn("value", rnd("value"))


@query("c05_lowrank_subtract", f"WITH im AS (SELECT session, y, x, avg(v) AS m FROM movie WHERE frame % 2 = 0 GROUP BY ALL), r AS (SELECT session, frame, y, x, greatest(v - m, 0) AS v FROM movie JOIN im USING (session, y, x)) {OUT}", ("movie",))
def c05(spark, sf):
    return shown(bg.lowrank_subtract(fx.frames(spark, sf), bg.lowrank_basis(fx.movie(spark, sf), 8, 8, 0, 2)))


@query("c05_lowrank_subtract_modes")
def c05_modes(spark, sf):
    return shown(bg.lowrank_subtract(fx.frames(spark, sf), bg.lowrank_basis(fx.frames(spark, sf), 8, 8, 2, 2)))


@query("c06_background_qc", f"WITH {_RINGED}, q AS (SELECT session, y, x, avg(m.v) AS before, avg(r.v) AS after FROM movie m JOIN r USING (session, frame, y, x) GROUP BY ALL), k AS (SELECT session, quantile_cont(before, 0.02) AS lo, quantile_cont(before, 0.98) AS hi FROM q GROUP BY 1) SELECT session, y, x, {_R('before')} AS before, {_R('after')} AS after, {_R('before - after')} AS removed, {_R('least(greatest(before, lo), hi)')} AS winsorised FROM q JOIN k USING (session)", ("movie",))
def c06(spark, sf):
    m = fx.movie(spark, sf)
    made = bg.background_qc(m, bg.ring_background(m, 8, 8, 3, 1, 100))
    return made.select("session", "y", "x", *(rnd(c).alias(c) for c in ("before", "after", "removed", "winsorised")))
