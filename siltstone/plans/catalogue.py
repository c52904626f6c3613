"""Queries of the filter language, pipelines, distinct, mutations and rollups over the test tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions.paths import Frame
from siltstone.operators import distinct as D
from siltstone.operators import mutations as M
from siltstone.operators import pipeline as P
from siltstone.operators import query as Q
from siltstone.operators import rollup as R
from siltstone.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: Columns of the implicit row order of typed tables.
ROW_ORDER = {"events": ["event_id"], "lineitem": ["l_orderkey", "l_linenumber"], "orders": ["o_orderkey"], "customer": ["c_custkey"], "event_types": ["_id"]}


def _add(name: str, make: Query, sql: str) -> None:
    QUERIES[name], ORACLES[name] = make, sql


def _frame(spark: SparkSession, d: str, name: str) -> Frame:
    return Frame(table(spark, d, name))


def _matches(name: str, source: str, filter_spec: dict, columns: list[str], sql: str) -> None:
    """All rows that match, whole tables: the filter without the service's limit on a page."""

    def make(spark: SparkSession, d: str) -> DataFrame:
        frame = _frame(spark, d, source)
        found = Q.matching(frame, Q.parse_query({"filter": filter_spec}))
        return Q.project(found, columns).select(*(f"`{c}`" for c in columns))

    _add(name, make, sql)


def _counts(name: str, source: str, filter_spec: dict, where: str) -> None:
    _add(name, lambda s, d: Q.run(_frame(s, d, source), {"filter": filter_spec, "count_only": True}), f'select count(*) as "count" from {source} where {where}')


def _pages(name: str, source: str, request: dict, sql: str) -> None:
    _add(name, lambda s, d: Q.run(_frame(s, d, source), request, ROW_ORDER.get(source, [])), sql)


def _pipes(name: str, source: str, stages: list, sql: str, **rounded: int) -> None:
    """``rounded``: digits of columns whose sums depend on the order of their parts."""

    def make(spark: SparkSession, d: str) -> DataFrame:
        df = P.run(_frame(spark, d, source), stages, ROW_ORDER.get(source, []))
        return df.withColumns({c: F.round(F.col(c), n) for c, n in rounded.items()}) if rounded else df

    _add(name, make, sql)


def _distincts(name: str, source: str, path: str, sql: str, filter_spec: dict | None = None, **how) -> None:
    _add(name, lambda s, d: D.distinct(_frame(s, d, source), path, filter_spec, **how), sql)


_EVENTS, _VALUES = ["event_id", "event_type", "value"], "select event_id, event_type, value from events where "

_matches("filter_eq", "events", {"event_type": "click"}, _EVENTS, _VALUES + "event_type = 'click'")
_matches("filter_ne", "events", {"event_type": {"$ne": "click"}}, _EVENTS, _VALUES + "event_type <> 'click'")
_matches("filter_range_num", "events", {"value": {"$gte": 10, "$lt": 50}}, _EVENTS, _VALUES + "value >= 10 and value < 50")
_matches("filter_in", "events", {"event_type": {"$in": ["click", "view"]}}, _EVENTS, _VALUES + "event_type in ('click', 'view')")
_matches("filter_nin", "events", {"event_type": {"$nin": ["click", "view"]}}, _EVENTS, _VALUES + "event_type not in ('click', 'view')")
_matches("filter_regex", "events", {"event_type": {"$regex": "^(c|p)"}}, _EVENTS, _VALUES + "regexp_matches(event_type, '^(c|p)')")
_matches(
    "filter_and_or_not",
    "events",
    {"$and": [{"$or": [{"event_type": "click"}, {"value": {"$gt": 100}}]}, {"$not": {"user_id": 8}}]},
    _EVENTS,
    _VALUES + "(event_type = 'click' or value > 100) and user_id <> 8",
)
_matches(
    "filter_ts_range",
    "events",
    {"event_type": "click", "ts": {"$gte": "2024-01-10T00:00:00", "$lt": "2024-01-20T00:00:00"}},
    _EVENTS,
    _VALUES + "event_type = 'click' and ts >= timestamp '2024-01-10' and ts < timestamp '2024-01-20'",
)
_add(
    "filter_nested_json",
    lambda s, d: Q.matching(_frame(s, d, "events"), Q.parse_query({"filter": {"props.k": {"$gte": 90}}})).df.select(
        "event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint").alias("props.k")
    ),
    """select event_id, cast(json_extract(props, '$.k') as bigint) as "props.k" from events where cast(json_extract(props, '$.k') as bigint) >= 90""",
)
_counts("filter_json_missing", "events", {"props.missing": {"$exists": False}}, "json_extract(props, '$.missing') is null")
_add(
    "filter_contains_labels",
    lambda s, d: Q.run(Frame(table(s, d, "siem_events").select(F.split("query", r"\.").alias("labels"))), {"filter": {"labels": {"$contains": "example"}}, "count_only": True}),
    """select count(*) as "count" from siem_events where list_contains(string_split(query, '.'), 'example')""",
)
_counts("filter_contains_array", "embeddings", {"embedding": {"$contains": 0.0}}, "list_contains(embedding, 0.0)")
_counts("count_only", "events", {"event_type": {"$in": ["click", "purchase"]}, "value": {"$gt": 20}}, "event_type in ('click', 'purchase') and value > 20")

# Missing values: siem_events has nulls in severity, query, network and its members.
_counts("null_eq", "siem_events", {"severity": "low"}, "severity = 'low'")
_counts("null_ne", "siem_events", {"severity": {"$ne": "low"}}, "severity is not null and severity <> 'low'")
_counts("null_nin", "siem_events", {"severity": {"$nin": ["low", "high", None]}}, "severity is not null and severity not in ('low', 'high')")
_counts("null_not", "siem_events", {"$not": {"severity": "low"}}, "not coalesce(severity = 'low', false)")
_counts(
    "null_not_or",
    "siem_events",
    {"$not": {"$or": [{"severity": "low"}, {"network.dst_port": {"$gt": 1000}}]}},
    "not (coalesce(severity = 'low', false) or coalesce(network.dst_port > 1000, false))",
)
_counts("exists_nested", "siem_events", {"network.action": {"$exists": True}}, "network.action is not null")
_counts("exists_not_nested", "siem_events", {"network.dst_port": {"$exists": False}}, "network.dst_port is null")
_counts("missing_column", "siem_events", {"no.such.path": {"$ne": 1}}, "false")
_counts("type_mismatch", "siem_events", {"network.dst_port": "443"}, "false")
_counts("nested_in", "siem_events", {"network.dst_port": {"$in": [22, 443, "443", 80.0]}}, "network.dst_port in (22, 443, 80)")
_counts("nested_and_range", "siem_events", {"network.action": "reject", "network.dst_port": {"$gte": 100, "$lte": 5000}}, "network.action = 'reject' and network.dst_port between 100 and 5000")
_counts("regex_domain", "siem_events", {"query": {"$regex": r"^[a-z0-9-]+\.[a-z-]+\.example$"}}, r"regexp_matches(query, '^[a-z0-9-]+\.[a-z-]+\.example$')")
_counts("regex_unanchored", "siem_events", {"message": {"$regex": r"\d{3} (seen|bei)"}}, r"regexp_matches(message, '\d{3} (seen|bei)')")
_counts("string_order", "siem_events", {"_created_at": {"$gte": "2026-01-10", "$lt": "2026-01-12"}}, "_created_at >= '2026-01-10' and _created_at < '2026-01-12'")
_counts("compound_eq", "siem_events", {"event_type": "firewall", "severity": "high"}, "event_type = 'firewall' and severity = 'high'")
_counts("compound_range", "siem_events", {"event_type": "dns", "_received_at": {"$gte": "2026-01-15T00:00:00Z"}}, "event_type = 'dns' and _received_at >= '2026-01-15T00:00:00Z'")
_counts("and_empty", "siem_events", {"$and": []}, "true")
_counts("or_empty", "siem_events", {"$or": []}, "false")
_matches(
    "deep_struct",
    "ip_enrichment",
    {"enrichment.src.abuse_score": {"$gt": 50}, "enrichment.src.geo_country": {"$regex": "^[A-Z]"}},
    ["_id", "enrichment.src.geo_country", "enrichment.src.abuse_score"],
    """select _id, enrichment.src.geo_country as "enrichment.src.geo_country", enrichment.src.abuse_score as "enrichment.src.abuse_score"
       from ip_enrichment where enrichment.src.abuse_score > 50 and regexp_matches(enrichment.src.geo_country, '^[A-Z]')""",
)

_pages(
    "sort_limit_offset",
    "events",
    {"sort": [{"value": "desc"}], "limit": 20, "offset": 5, "fields": ["event_id", "value"]},
    "select event_id, value from events order by value desc, event_id limit 20 offset 5",
)
_pages("sort_missing_first", "event_types", {"sort": [{"severity": "asc"}], "limit": 30, "fields": ["severity"]}, "select _id, severity from event_types order by severity asc nulls first, _id limit 30")
_pages("sort_missing_last", "event_types", {"sort": [{"category": "desc"}, {"name": "asc"}], "limit": 400, "fields": ["category", "name"]}, "select _id, category, name from event_types order by category desc nulls last, name limit 400")
_pages(
    "filter_sort_limit",
    "events",
    {"filter": {"event_type": "purchase"}, "sort": [{"ts": "desc"}], "limit": 50, "fields": ["event_id", "ts", "user_id"]},
    "select event_id, ts, user_id from events where event_type = 'purchase' order by ts desc, event_id limit 50",
)
_pages("default_page", "events", {}, "select * from events order by event_id limit 100")
_pages("limit_clamped", "events", {"limit": 50_000, "fields": ["event_id"]}, "select event_id from events order by event_id limit 10000")
_add(
    "point_lookup",
    lambda s, d: Q.run(_frame(s, d, "event_types"), {"filter": {"_id": "019b864d-bc00-7015-81ab-ebcc0000002a"}}, ["_id"]),
    "select * from event_types where _id = '019b864d-bc00-7015-81ab-ebcc0000002a'",
)

_distincts("distinct_path", "events", "event_type", "select distinct event_type as value from events")
_distincts("distinct_filtered", "orders", "o_orderpriority", "select distinct o_orderpriority as value from orders where o_orderstatus = 'F'", {"o_orderstatus": "F"})
_distincts("distinct_nested", "siem_events", "network.action", "select distinct network.action as value from siem_events where network.action is not null")
_distincts("distinct_capped", "siem_events", "src_ip", "select distinct src_ip as value from siem_events where src_ip is not null order by value limit 25", limit=25)

_pipes(
    "match_group_sort_limit",
    "events",
    [{"$match": {"event_type": "error"}}, {"$group": {"_id": "user_id", "n": {"$count": {}}}}, {"$sort": {"n": "desc", "_id": 1}}, {"$limit": 10}],
    "select user_id as _id, count(*) as n from events where event_type = 'error' group by 1 order by _id, n desc limit 10",
)
_pipes("group_count", "events", [{"$group": {"_id": "event_type", "n": {"$count": {}}}}], "select event_type as _id, count(*) as n from events group by 1")
_pipes(
    "group_all_acc",
    "lineitem",
    [{"$group": {"_id": "l_returnflag", "n": {"$count": {}}, "s": {"$sum": "l_extendedprice"}, "a": {"$avg": "l_discount"}, "lo": {"$min": "l_shipdate"}, "hi": {"$max": "l_quantity"}}}],
    "select l_returnflag as _id, count(*) as n, round(sum(l_extendedprice), 2) as s, round(avg(l_discount), 4) as a, min(l_shipdate) as lo, max(l_quantity) as hi from lineitem group by 1",
    s=2,
    a=4,
)
_pipes(
    "group_null_id",
    "events",
    [{"$group": {"_id": None, "n": {"$count": {}}, "total": {"$sum": "value"}}}],
    "select cast(null as varchar) as _id, count(*) as n, round(sum(value), 2) as total from events having count(*) > 0",
    total=2,
)
_pipes("group_literal", "events", [{"$group": {"_id": 5, "n": {"$count": {}}, "most": {"$max": "value"}}}], "select 5 as _id, count(*) as n, max(value) as most from events having count(*) > 0")
_pipes(
    "group_multi_key",
    "lineitem",
    [{"$group": {"_id": {"a": "l_linestatus", "b": "l_returnflag"}, "n": {"$count": {}}}}],
    "select struct_pack(a := l_linestatus, b := l_returnflag) as _id, count(*) as n from lineitem group by 1",
)
_pipes(
    "group_collect",
    "lineitem",
    [{"$group": {"_id": "l_returnflag", "statuses": {"$collect": "l_linestatus"}}}],
    "select l_returnflag as _id, list_sort(list(distinct l_linestatus)) as statuses from lineitem group by 1",
)


def _ports(spark: SparkSession, d: str) -> DataFrame:
    stages = [{"$group": {"_id": "severity", "ports": {"$collect": "network.dst_port"}, "n": {"$count": {}}}}]
    return P.run(_frame(spark, d, "siem_events"), stages, mark_truncated=True)


_add(
    "group_collect_marked",
    _ports,
    """select severity as _id, coalesce(list_sort(list(distinct network.dst_port) filter (network.dst_port is not null))[:1000], []) as ports, count(*) as n,
        count(distinct network.dst_port) > 1000 as _truncated_ports from siem_events group by 1""",
)
#: Its SQL cuts without a mark; group_collect_marked is the same with it.
_add(
    "group_collect_nulls",
    lambda s, d: _ports(s, d).drop("_truncated_ports"),
    "select severity as _id, coalesce(list_sort(list(distinct network.dst_port) filter (network.dst_port is not null))[:1000], []) as ports, count(*) as n from siem_events group by 1",
)
_pipes(
    "group_having",
    "events",
    [{"$group": {"_id": "user_id", "n": {"$count": {}}}}, {"$match": {"n": {"$gt": 12}}}],
    "select user_id as _id, count(*) as n from events group by 1 having count(*) > 12",
)
_pipes(
    "group_group",
    "events",
    [{"$group": {"_id": {"t": "event_type", "u": "user_id"}, "n": {"$count": {}}}}, {"$group": {"_id": "n", "pairs": {"$count": {}}}}],
    "select n as _id, count(*) as pairs from (select count(*) as n from events group by event_type, user_id) group by 1",
)
_pipes(
    "skip_limit_pipeline",
    "events",
    [{"$sort": {"event_id": 1}}, {"$skip": 3}, {"$limit": 7}],
    "select * from events order by event_id limit 7 offset 3",
)
_pipes("limit_skip_pipeline", "events", [{"$sort": {"value": -1}}, {"$limit": 20}, {"$skip": 15}], "select * from (select * from events order by value desc, event_id limit 20) order by value desc, event_id offset 15")
_pipes(
    "sum_int_as_double",
    "events",
    [{"$group": {"_id": "event_type", "total": {"$sum": "user_id"}, "nothing": {"$sum": "event_type"}}}],
    "select event_type as _id, sum(cast(user_id as double)) as total, cast(0 as double) as nothing from events group by 1",
)
_pipes(
    "group_nested_null",
    "siem_events",
    [{"$group": {"_id": "network.action", "n": {"$count": {}}, "first": {"$min": "_received_at"}, "port": {"$avg": "network.dst_port"}}}],
    "select network.action as _id, count(*) as n, min(_received_at) as first, round(avg(network.dst_port), 4) as port from siem_events group by 1",
    port=4,
)
_pipes(
    "task_revisions",
    "tasks",
    [{"$match": {"status": {"$exists": True}}}, {"$group": {"_id": {"p": "priority", "s": "status"}, "n": {"$count": {}}, "last": {"$max": "_rev"}}}, {"$match": {"_id.p": {"$gte": 2}}}],
    "select struct_pack(p := priority, s := status) as _id, count(*) as n, max(_rev) as last from tasks where status is not null and priority >= 2 group by priority, status",
)
_pipes(
    "log_levels",
    "app_logs",
    [{"$match": {"level": {"$regex": "(?i)^(err|warn)"}}}, {"$group": {"_id": "level", "n": {"$count": {}}}}, {"$sort": {"n": -1}}],
    "select level as _id, count(*) as n from app_logs where regexp_matches(level, '^(err|warn)', 'i') group by 1",
)

_add(
    "delete_by_query_rest",
    lambda s, d: M.survivors(_frame(s, d, "events"), {"event_type": "click"}).select("event_id", "event_type"),
    "select event_id, event_type from events where not coalesce(event_type = 'click', false)",
)
_add(
    "delete_rest_nulls",
    lambda s, d: M.survivors(_frame(s, d, "siem_events"), {"severity": {"$ne": "low"}}).select("_id", "severity"),
    "select _id, severity from siem_events where not coalesce(severity <> 'low', false)",
)
_add(
    "update_by_query",
    lambda s, d: M.updated(_frame(s, d, "events"), {"event_type": "click"}, {"$set": {"event_type": "tap"}}).select("event_id", "event_type"),
    "select event_id, case when event_type = 'click' then 'tap' else event_type end as event_type from events",
)
_add(
    "update_nested",
    lambda s, d: M.updated(_frame(s, d, "ip_enrichment"), {"src_ip": {"$regex": r"^10\."}}, {"$set": {"enrichment.src.geo_country": "ZZ"}}).select(
        "_id", "_rev", F.col("enrichment.src.geo_country").alias("country"), F.col("enrichment.src.abuse_score").alias("score")
    ),
    r"""select _id, _rev + case when coalesce(regexp_matches(src_ip, '^10\.'), false) then 1 else 0 end as _rev,
        case when coalesce(regexp_matches(src_ip, '^10\.'), false) then 'ZZ' else enrichment.src.geo_country end as country, enrichment.src.abuse_score as score from ip_enrichment""",
)
_add(
    "ttl_rest",
    lambda s, d: M.retained(_frame(s, d, "events"), "ts", "2024-01-15T00:00:00").select("event_id", "ts"),
    "select event_id, ts from events where not coalesce(ts < timestamp '2024-01-15', false)",
)
_add(
    "ttl_text_rest",
    lambda s, d: M.retained(_frame(s, d, "siem_events"), "_created_at", "2026-01-12T00:00:00.000Z").select("_id", "_created_at"),
    "select _id, _created_at from siem_events where not coalesce(_created_at < '2026-01-12T00:00:00.000Z', false)",
)


def _rolled(name: str, source: str, paths: list[str], stages: list, sql: str) -> None:
    def make(spark: SparkSession, d: str) -> DataFrame:
        made, parsed = R.build(_frame(spark, d, source), paths), P.parse_pipeline(stages)
        return R.group_counts(made, parsed[: R.covers_group(made, parsed)])

    _add(name, make, sql)


_rolled(
    "bitmap_counts",
    "events",
    ["event_type"],
    [{"$match": {"event_type": {"$ne": "view"}}}, {"$group": {"_id": "event_type", "n": {"$count": {}}}}],
    "select event_type as _id, count(*) as n from events where event_type <> 'view' group by 1",
)
_rolled(
    "rollup_not_nested",
    "siem_events",
    ["severity", "network.action"],
    [{"$match": {"$not": {"network.action": "reject"}}}, {"$group": {"_id": "severity", "n": {"$count": {}}}}],
    "select severity as _id, count(*) as n from siem_events where not coalesce(network.action = 'reject', false) group by 1",
)
_add(
    "rollup_count_or",
    lambda s, d: R.count(R.build(_frame(s, d, "siem_events"), ["severity", "event_type"]), Q.parse_query({"filter": {"$or": [{"severity": "6"}, {"event_type": {"$ne": "firewall"}}]}, "count_only": True})),
    "select count(*) as \"count\" from siem_events where coalesce(severity = '6', false) or coalesce(event_type <> 'firewall', false)",
)
_add(
    "doc_time_range",
    lambda s, d: Q.id_range(_frame(s, d, "siem_events")),
    "select min(_id) as oldest, max(_id) as newest, count(*) as n from siem_events",
)
