"""Sums that meet a bound exactly decide alike in whatever order their terms come."""

import duckdb
import numpy as np
import pandas as pd
from tests.conftest import same

from brightfield.plans import catalog


def events(path, days):
    """A table of one user's events, a list of values a day, and DuckDB over it."""
    rows = [(7, pd.Timestamp("2024-01-01 12:00") + pd.Timedelta(days=d), v) for d, values in enumerate(days) for v in values]
    path.mkdir()
    pd.DataFrame(rows, columns=["user_id", "ts", "value"]).astype({"ts": "datetime64[us]"}).to_parquet(path / "events.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW events AS SELECT * FROM '{path}/events.parquet'")
    return c


def added(values):
    total = 0.0
    for v in values:
        total += v
    return total


def apart(total, seed=0):
    """Values of 2 decimals that sum to `total` exactly, and to more than it in one order and to it at most in the other."""
    rng = np.random.default_rng(seed)
    while True:
        cents = rng.integers(1, total * 5, 19)
        values = [float(c) / 100 for c in [*cents, total * 100 - cents.sum()]]
        if added(values) > total >= added(values[::-1]):
            return values


def test_report_at_its_bounds(spark, tmp_path):
    for name, bound in (("few_spikes", 1200), ("faint", 600)):
        values = apart(bound)
        for turn in (values, values[::-1]):
            path = tmp_path / f"{name}{turn is values}"
            c = events(path, [turn])
            ours, theirs = same(catalog.QUERIES["n04_component_report"](spark, str(path)), c, catalog.SQL["n04_component_report"])
            assert ours == theirs
            row = catalog.QUERIES["n04_component_report"](spark, str(path)).first()
            assert row[name] == 1
            assert row["kept"] == 0 and row["median_spikes"] == bound


def test_spikes_of_equal_days(spark, tmp_path):
    """The second day has the values of the first in another order, and no increase."""
    values = apart(600)
    for turn in ([values[::-1], values], [values, values[::-1]]):
        path = tmp_path / f"{turn[0] is values}"
        c = events(path, turn)
        ours, theirs = same(catalog.QUERIES["t11_spike_summary"](spark, str(path)), c, catalog.SQL["t11_spike_summary"])
        assert ours == theirs
        assert (ours[0][0], ours[0][3]) == (0.033333, 0.966667)
