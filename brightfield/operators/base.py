"""Column names and small helpers shared by the operators.

Movies are pixel rows (session, frame, y, x, v), footprints (session, unit_id, y, x, a) with a > 0 only,
traces (session, unit_id, frame, v). Every operator groups by session, so that one job serves many recordings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SESSION = ["session"]
FRAME = ["session", "frame"]
PIXEL = ["session", "y", "x"]
UNIT = ["session", "unit_id"]


def per_session(df: DataFrame, *aggregates: Column) -> DataFrame:
    return df.groupBy("session").agg(*aggregates)


def finite(c: Column) -> Column:
    return ~(F.isnan(c) | c.isin(float("inf"), float("-inf")) | c.isNull())
