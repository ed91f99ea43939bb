"""Registered queries of the imaging operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brightfield.operators import merge, reject, tiles
from brightfield.plans import image_queries, ingest_queries, trace_queries, unit_queries  # noqa: F401
from brightfield.plans.registry import QUERIES, SQL
from brightfield.sources import fixtures as fx

__all__ = ["QUERIES", "SQL", "flagship"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From movie and footprints to merged units: traces, overlap, correlation, groups, then size, centroid and signal-to-noise ratio."""
    movie, foot = fx.movie(spark, sf_dir), fx.footprints(spark, sf_dir)
    from brightfield.operators.traces import extract_traces

    traces = extract_traces(movie, foot)
    groups = merge.merge_groups(foot, traces, 0.5, 0.3, 64)
    a, c = merge.merge_footprints(foot, groups), merge.merge_traces(traces, groups)
    unit = ["session", "unit_id"]
    made = reject.unit_sizes(a).join(tiles.centroids(a), unit).join(reject.trace_snr(c), unit)
    return made.select(*unit, "size", *(F.round(x, 6).alias(x) for x in ("cy", "cx", "snr")))
