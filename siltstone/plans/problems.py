"""Queries p1 to p3 over the test tables: the general data-preparation operators with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions.instants import duck_instant_ms, instant_ms
from siltstone.operators import features, salted, sessions
from siltstone.sources.tables import spread, table

SESSION_GAP_MS = 1_800_000
FOUND_ONE_IN = 25
SETTINGS_MS = (0, 1_000, 60_000, 300_000, 1_800_000, 7_200_000, 43_200_000, 259_200_000)

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of event_type and severity, neither null, that hold at least 4 % of all rows."""
    return salted.keys_holding(table(spark, d, "siem_events"), ["event_type", "severity"], FOUND_ONE_IN).drop("n_rows")


def p1_counts(spark: SparkSession, d: str) -> DataFrame:
    """Rows, first and last delivery of every pair of event_type and severity."""
    rows, at = salted.count(), F.col("_created_at")
    return salted.salted_aggregate(
        table(spark, d, "siem_events"),
        ["event_type", "severity"],
        {"n_rows": rows, "first_created": salted.smallest(at), "last_created": salted.largest(at), "mean_rev": salted.mean(F.col("_rev"))},
    )


def p2_features(spark: SparkSession, d: str) -> DataFrame:
    """Counts, recency (-1: never) and totals of every src_ip for each event_type."""
    return features.feature_table(table(spark, d, "siem_events"), "src_ip", "event_type", instant_ms(F.col("_received_at")), unseen=-1)


def _tree(spark: SparkSession, d: str) -> DataFrame:
    arrivals = spread(table(spark, d, "siem_events").select("src_ip", "_received_at"))
    return sessions.session_tree(arrivals, "src_ip", instant_ms(F.col("_received_at")))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Sessions of every src_ip, cut at 30 minutes of silence."""
    return sessions.cut(_tree(spark, d), SESSION_GAP_MS).select("src_ip", "start_ms", "end_ms")


def p3_sessions(spark: SparkSession, d: str) -> DataFrame:
    """The same with duration and number of events."""
    return sessions.cut(_tree(spark, d), SESSION_GAP_MS)


def p3_settings(spark: SparkSession, d: str) -> DataFrame:
    """Sessions and their longest duration for several gap settings, all from one tree."""
    tree = _tree(spark, d)
    holds = {t: (F.col("gap_ms") <= t) & (F.col("parent_gap_ms") > t) for t in SETTINGS_MS}
    one = tree.agg(*(c for t, h in holds.items() for c in (F.count_if(h).alias(f"n{t}"), F.max(F.when(h, F.col("end_ms") - F.col("start_ms"))).alias(f"d{t}"))))
    rows = F.array(*(F.struct(F.lit(t).cast("bigint").alias("gap_ms"), F.col(f"n{t}").alias("n_sessions"), F.col(f"d{t}").alias("longest_ms")) for t in SETTINGS_MS))
    return one.select(F.inline(rows))


QUERIES: dict[str, Query] = {f.__name__: f for f in (p1_found, p1_counts, p2_features, p3_found, p3_sessions, p3_settings)}

_MS = duck_instant_ms("_received_at")


def _sessions_sql(gap_ms: int) -> str:
    return f"""
        select src_ip, min(ms) as start_ms, max(ms) as end_ms, count(*) as n_events, max(ms) - min(ms) as duration_ms
        from (select src_ip, ms, sum(case when ms - before > {gap_ms} then 1 else 0 end) over (partition by src_ip order by ms rows unbounded preceding) as s
              from (select src_ip, ms, lag(ms) over (partition by src_ip order by ms) as before
                    from (select src_ip, {_MS} as ms from siem_events) where src_ip is not null and ms is not null))
        group by src_ip, s"""


ORACLES: dict[str, str] = {
    "p1_found": f"""select event_type, severity from siem_events where event_type is not null and severity is not null
        group by all having count(*) * {FOUND_ONE_IN} >= (select count(*) from siem_events)""",
    "p1_counts": """select event_type, severity, count(*) as n_rows, min(_created_at) as first_created, max(_created_at) as last_created, avg(_rev) as mean_rev
        from siem_events group by event_type, severity""",
    "p2_features": f"""
        with e as (select src_ip, event_type, {_MS} as ms from siem_events),
             now as (select max(ms) as now_ms from e),
             types as (select distinct event_type from e where event_type is not null),
             cells as (select src_ip, event_type, count(*) as n, max(ms) as last from e where src_ip is not null group by all),
             totals as (select src_ip, cast(sum(n) as bigint) as n_events, max(now_ms) - max(last) as since_ms, count(event_type) as n_types,
                               cast(coalesce(sum(n) filter (event_type is null), 0) as bigint) as n_other from cells, now group by src_ip),
             grid as (select t.src_ip, y.event_type, coalesce(c.n, 0) as n, coalesce(now_ms - c.last, -1) as since
                      from totals t cross join types y cross join now left join cells c on c.src_ip = t.src_ip and c.event_type = y.event_type)
        select t.*, g.counts, g.since from totals t join
            (select src_ip, list(n order by event_type) as counts, list(since order by event_type) as since from grid group by src_ip) g using (src_ip)""",
    "p3_found": f"select src_ip, start_ms, end_ms from ({_sessions_sql(SESSION_GAP_MS)})",
    "p3_sessions": _sessions_sql(SESSION_GAP_MS),
    "p3_settings": " union all ".join(
        f"select cast({t} as bigint) as gap_ms, count(*) as n_sessions, max(duration_ms) as longest_ms from ({_sessions_sql(t)})" for t in SETTINGS_MS
    ),
}
