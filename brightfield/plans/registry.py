"""Registration of queries beside their SQL; fixtures as DataFrames and as common table expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: Fixtures in SQL; each may use those before it.
CTES = {
    "movie": "movie AS (SELECT CASE WHEN vec_id % 2 = 0 THEN 'a' ELSE 'b' END AS session, vec_id // 2 AS frame, ((i - 1) // 8)::INT AS y, ((i - 1) % 8)::INT AS x, embedding[i]::DOUBLE AS v FROM (SELECT vec_id, embedding, unnest(generate_series(1, 64)) AS i FROM embeddings))",
    "foot": "foot AS (SELECT * FROM (SELECT CASE WHEN vec_id % 2 = 0 THEN 'a' ELSE 'b' END AS session, label::BIGINT AS unit_id, ((i - 1) // 8)::INT AS y, ((i - 1) % 8)::INT AS x, avg(embedding[i]::DOUBLE) AS a FROM (SELECT vec_id, label, embedding, unnest(generate_series(1, 64)) AS i FROM embeddings) GROUP BY ALL) WHERE a > 0)",
    "traces": "traces AS (SELECT f.session, f.unit_id, m.frame, sum(f.a * m.v) AS v FROM foot f JOIN movie m USING (session, y, x) GROUP BY ALL)",
    "motion": "motion AS (SELECT CASE WHEN vec_id % 2 = 0 THEN 'a' ELSE 'b' END AS session, vec_id // 2 AS frame, 10 * embedding[1]::DOUBLE AS dy, 10 * embedding[2]::DOUBLE AS dx FROM embeddings)",
    "days": "days AS (SELECT s.session, s.unit_id, f.frame, coalesce(sum(e.value), 0) AS v FROM (SELECT DISTINCT 's' || (user_id % 2) AS session, user_id AS unit_id FROM events) s CROSS JOIN (SELECT unnest(range(0, 30)) AS frame) f LEFT JOIN events e ON e.user_id = s.unit_id AND date_diff('day', TIMESTAMP '2024-01-01', date_trunc('day', e.ts)) = f.frame GROUP BY ALL)",
    "bg_b": "bg_b AS (SELECT session, y, x, avg(v - lo) AS b FROM movie JOIN (SELECT session, min(v) AS lo FROM movie GROUP BY 1) USING (session) GROUP BY 1, 2, 3)",
    "bg_f": "bg_f AS (SELECT session, frame, avg(v - lo) AS f FROM movie JOIN (SELECT session, min(v) AS lo FROM movie GROUP BY 1) USING (session) GROUP BY 1, 2)",
}
NEEDS = {"traces": ["foot", "movie"], "bg_b": ["movie"], "bg_f": ["movie"]}


def with_fixtures(uses: tuple[str, ...], body: str) -> str:
    names: list[str] = []
    for u in uses:
        names += [n for n in [*NEEDS.get(u, []), u] if n not in names]
    parts = [CTES[n] for n in CTES if n in names]
    body = body.strip()
    if body.upper().startswith("WITH "):
        head, body = "WITH RECURSIVE " if body.upper().startswith("WITH RECURSIVE ") else "WITH ", body.split(None, 2 if body.upper().startswith("WITH RECURSIVE ") else 1)[-1]
        return head + ", ".join([*parts, body])
    return ("WITH " + ", ".join(parts) + " " if parts else "") + body


def query(name: str, sql: str | None = None, uses: tuple[str, ...] = ()):
    """Registers f(spark, sf_dir) under a name, with SQL after the fixtures it uses."""

    def register(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = with_fixtures(uses, sql)
        return f

    return register


def rnd(c: Column | str, digits: int = 6) -> Column:
    """Rounded for comparison, without a negative zero."""
    return F.round(F.col(c) if isinstance(c, str) else c, digits) + F.lit(0.0)
