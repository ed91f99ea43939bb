"""Segmentation of footprints into basins, components and merged cells."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brightfield.functions.images import Patch, basins
from brightfield.operators.arrays import map_units
from brightfield.operators.base import UNIT
from brightfield.operators.graph import greedy_groups
from brightfield.operators.reject import regions
from brightfield.operators.stencil import gaussian_taps


def local_peaks(footprints: DataFrame, min_distance: int, threshold_rel: float, sigma: float, h: int, w: int) -> DataFrame:
    """(session, unit_id, y, x, v): pixels of the smoothed image that equal the largest value within min_distance in either direction, exceed threshold_rel of the peak and 0, the first by (y, x) among equal neighbours."""
    taps = gaussian_taps(sigma)

    def find(y, x, a):
        patch = Patch(y, x, a, taps, min_distance, h, w)
        py, px = patch.peaks(min_distance, threshold_rel)
        return {"y": py, "x": px, "v": patch.at(py, px)}

    return map_units(footprints, UNIT, find, "y int, x int, v double")


def peak_search(footprints: DataFrame, grid: list[tuple[int, float, float]], h: int, w: int, skip: int | None = 0) -> DataFrame:
    """(session, min_distance, threshold_rel, sigma, mean_peaks, best): the mean number of peaks per component for each setting; the largest is best (ties: the first setting). All settings are tried on a footprint in one pass."""
    units = footprints if skip is None else footprints.where(F.col("unit_id") != skip)

    def count(y, x, a):
        return {"k": np.arange(len(grid)), "peaks": [len(Patch(y, x, a, gaussian_taps(s), d, h, w).peaks(d, t)[0]) for d, t, s in grid]}

    rated = map_units(units, UNIT, count, "k int, peaks long").groupBy("session", "k").agg(F.avg("peaks").alias("mean_peaks"))
    best = rated.groupBy("session").agg(F.max_by("k", F.struct("mean_peaks", -F.col("k"))).alias("best_k"))
    setting = F.element_at(F.array(*(F.struct(F.lit(d).alias("min_distance"), F.lit(t).alias("threshold_rel"), F.lit(s).alias("sigma")) for d, t, s in grid)), F.col("k") + 1)
    return rated.join(best, "session").withColumn("g", setting).select("session", "g.*", "mean_peaks", (F.col("k") == F.col("best_k")).alias("best"))


def basin_label(footprints: DataFrame, min_distance: int, threshold_rel: float, sigma: float, h: int, w: int, keys: list[str] = UNIT) -> DataFrame:
    """(session, unit_id, y, x, a, basin): the footprint's pixels with their basin, numbered from 1 within the unit.

    Basins are flooded from the peaks of the smoothed image, greatest pixels first, within the footprint. Pixels that no peak
    reaches, those of a region without one, belong to no basin and are left out. `keys` name a unit.
    """
    taps = gaussian_taps(sigma)

    def label(y, x, a):
        patch = Patch(y, x, a, taps, max(min_distance, 1), h, w)
        basin = basins(y, x, patch.at(y, x), patch.peaks(min_distance, threshold_rel))
        held = basin > 0
        return {"y": y[held], "x": x[held], "a": a[held], "basin": basin[held]}

    return map_units(footprints, keys, label, "y int, x int, a double, basin int")


def basin_filter(labels: DataFrame, min_size: int) -> DataFrame:
    """Basins of min_size pixels or more; every survivor stays, whatever its number."""
    keep = labels.groupBy(*UNIT, "basin").count().where(F.col("count") >= min_size)
    return labels.join(keep, [*UNIT, "basin"], "left_semi")


def component_table(labels: DataFrame) -> DataFrame:
    """Per basin: size, peak and centroid, weighted by value, or plain below 20 pixels or where the weights sum to 0."""
    total = F.sum("a")
    plain = (F.count("*") < 20) | (total == 0)
    return labels.groupBy(*UNIT, "basin").agg(F.count("*").alias("size"), F.max("a").alias("peak"), F.when(plain, F.avg("y")).otherwise(F.sum(F.col("a") * F.col("y")) / total).alias("cy"), F.when(plain, F.avg("x")).otherwise(F.sum(F.col("a") * F.col("x")) / total).alias("cx"))


def region_table(footprints: DataFrame, connectivity: int = 4) -> DataFrame:
    """(session, unit_id, region_y, region_x, n): connected regions by their smallest pixel."""
    return regions(footprints, connectivity).groupBy(*UNIT, F.col("region.y").alias("region_y"), F.col("region.x").alias("region_x")).agg(F.count("*").alias("n"))


def centroid_edges(components: DataFrame, distance: float) -> DataFrame:
    """(session, u1, u2, d) of components closer than `distance`: centroids meet in grid cells of that side, each in its own and the eight around."""
    cell = components.select("session", "unit_id", "cy", "cx", "size", F.floor(F.col("cy") / distance).alias("gy"), F.floor(F.col("cx") / distance).alias("gx"))
    steps = F.explode(F.array(*(F.struct(F.lit(a).alias("dy"), F.lit(b).alias("dx")) for a in (-1, 0, 1) for b in (-1, 0, 1))))
    wide = cell.select("session", F.col("unit_id").alias("u2"), F.col("cy").alias("cy2"), F.col("cx").alias("cx2"), "gy", "gx", steps.alias("o")).select("session", "u2", "cy2", "cx2", (F.col("gy") + F.col("o.dy")).alias("gy"), (F.col("gx") + F.col("o.dx")).alias("gx"))
    d = F.sqrt((F.col("cy") - F.col("cy2")) ** 2 + (F.col("cx") - F.col("cx2")) ** 2)
    return cell.join(wide, ["session", "gy", "gx"]).where((F.col("unit_id") < F.col("u2")) & (d < distance)).select("session", F.col("unit_id").alias("u1"), "u2", d.alias("d"))


def centroid_merge(components: DataFrame, distance: float = 25, ratio: float = 5, least: int = 9, most: int = 5000) -> DataFrame:
    """(session, unit_id, group_id): from the lowest id on, each free component absorbs later free ones that are close, of similar size and within the total; those under `least` pixels are left out.

    The order is that of the sequence; rounds over the candidate edges find it (`greedy_groups`).
    """
    good = components.where(F.col("size") >= least)
    size = lambda u, name: good.select("session", F.col("unit_id").alias(u), F.col("size").alias(name))
    near = centroid_edges(good, distance).join(size("u1", "s1"), ["session", "u1"]).join(size("u2", "s2"), ["session", "u2"])
    near = near.where(F.greatest("s1", "s2") < ratio * F.least("s1", "s2")).select("session", "u1", "u2")
    return greedy_groups(good, near, "group_id", most)
