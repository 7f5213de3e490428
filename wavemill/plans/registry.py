"""The registered queries of the signal operators, each with its SQL where SQL expresses it.

Doubles are rounded on both sides, so that the order of sums does not show.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

ORDER = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate"
LOW = "(abs(q) & 255)"


def _lines(track: str) -> str:
    return f"""SELECT {track} AS track_id, 0 AS ch, row_number() OVER (PARTITION BY {track} ORDER BY {ORDER}) - 1 AS idx,
    round(l_extendedprice * 100)::BIGINT - 5295000 AS q, (round(l_extendedprice * 100)::BIGINT - 5295000) / 8388608::DOUBLE AS x FROM lineitem"""


VIEWS = {
    "supp": _lines("l_suppkey"),
    "flag": _lines("l_returnflag"),
    "whole": _lines("0"),
    "usr": "SELECT user_id AS track_id, 0 AS ch, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx, 2 * value / max(value) OVER (PARTITION BY user_id) - 1 AS x FROM events",
    "fr": "SELECT label AS track_id, vec_id AS frame_no, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS n FROM embeddings",
    "spectra": """SELECT track_id, frame_no, k, sqrt(re * re + im * im) AS mag FROM (SELECT track_id, frame_no, k::INTEGER AS k, sum(x * cos(2 * pi() * ((n * k) % 64) / 64)) AS re,
    sum(x * sin(2 * pi() * ((n * k) % 64) / 64)) AS im FROM fr, range(33) t(k) GROUP BY ALL)""",
    "spec": """SELECT track_id, idx AS k, CASE WHEN abs(x) > 1e-10 THEN 20 * log10(abs(x)) ELSE -200 END - CASE WHEN idx >= 300 + track_id * 37 % 260 THEN 40 ELSE 0 END AS db,
    count(*) OVER (PARTITION BY track_id) AS bins FROM supp""",
}
NEEDS = {"spectra": ["fr"], "spec": ["supp"]}


def with_views(sql: str, *names: str) -> str:
    order: list[str] = []
    for n in names:
        order += [x for x in [*NEEDS.get(n, []), n] if x not in order]
    ctes = ",\n".join(f"{n} AS ({VIEWS[n]})" for n in order)
    body = sql.strip()
    if not order:
        return body
    return f"WITH {ctes},\n{body[5:]}" if body.startswith("WITH ") else f"WITH {ctes}\n{body}"


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[(F.round(c, digits) + F.lit(0.0)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


def add(name: str, query: Query, sql: str | None = None, *views: str, digits: int = 6) -> None:
    """Register a query; its SQL is rounded to the same digits by ``r`` in its text."""
    QUERIES[name] = lambda spark, sf_dir: rounded(query(spark, sf_dir), digits)
    if sql is not None:
        SQL[name] = with_views(sql, *views)


def queries() -> dict[str, Query]:
    from wavemill.plans import files, levels, lsb, ordered, rules, spectral, streams  # noqa: F401  they register themselves

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(SQL)
