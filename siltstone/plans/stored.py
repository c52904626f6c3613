"""Queries over stored collections: layouts, rollups and mutations on copies of the test tables, with their SQL.

The copies are written to the shared folder through the collections' own ways in. Those that are only read are made once for
a session and directory; every query that changes one makes its own.
"""

from __future__ import annotations

import datetime
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions.paths import Frame
from siltstone.operators import pipeline as P
from siltstone.operators import query as Q
from siltstone.operators import rollup as R
from siltstone.sources.catalog import Accelerator, Catalog, Collection
from siltstone.sources.scratch import scratch_root
from siltstone.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

ROLLED = ["severity", "network.action"]
_MADE: dict[tuple[str, str], Collection] = {}


def _add(name: str, sql: str) -> Callable[[Query], Query]:
    def keep(make: Query) -> Query:
        QUERIES[name], ORACLES[name] = make, sql
        return make

    return keep


def _empty(spark: SparkSession, fields: list[str] = ()) -> Collection:
    """A new collection in a warehouse of its own, which goes when the session ends."""
    root = f"{scratch_root(spark)}/warehouse-{uuid.uuid4().hex}"
    catalog = Catalog(spark, root, Accelerator(bool(fields), list(fields)))
    catalog.create("c")
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return catalog.collection("c")


def _events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "siem_events").select(F.col("_id").alias("eid"), "event_type", "severity", "src_ip", "network", F.col("_created_at").alias("at"))


def _texts(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct("*")).alias("t"))


def _stored(spark: SparkSession, d: str) -> Collection:
    """All siem_events: a part before an index is made and two appended after, then compacted; with a rollup."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _MADE:
        c, events = _empty(spark, ROLLED), _events(spark, d)
        parts = [F.col("severity") == "low", F.col("severity") != "low", F.col("severity").isNull()]
        c.create_index("kind", ["event_type", "severity"])
        c.create_index("at", ["event_type", "at"])
        c.ingest(_texts(events.filter(parts[0])), "t")
        c.create_index("port", ["network.dst_port"])
        for part in parts[1:]:
            c.ingest(_texts(events.filter(part)), "t")
        c.compact()
        _MADE[key] = c
    return _MADE[key]


def _found(c: Collection, request: dict, order: list[str] = ()) -> DataFrame:
    """The ``eid`` of the matches, by way of the layout and the rollup; with ``order``, of the request's page."""
    asked, m = Q.parse_query(request), c.manifest()
    frame = c.narrowed(asked.filter, m, c.covered_files(asked.filter, m))
    rows = Frame(Q.page(frame, asked, ["_id"]), "doc") if order else Q.matching(frame, asked)
    return rows.df.select(rows.field("eid").string.alias("eid"))


def _finds(name: str, filter_spec: dict, where: str) -> None:
    _add(name, f"select _id as eid from siem_events where {where}")(lambda s, d: _found(_stored(s, d), {"filter": filter_spec}))


_finds("laid_out_eq", {"event_type": "dns"}, "event_type = 'dns'")
_finds("laid_out_in", {"severity": {"$in": ["high", "6"]}}, "severity in ('high', '6')")
_finds("laid_out_range", {"network.dst_port": {"$gte": 400, "$lt": 9000}}, "network.dst_port >= 400 and network.dst_port < 9000")
_finds("laid_out_compound_eq", {"event_type": "firewall", "severity": "high"}, "event_type = 'firewall' and severity = 'high'")
_finds("laid_out_compound_range", {"event_type": "dns", "at": {"$gte": "2026-01-12"}}, "event_type = 'dns' and _created_at >= '2026-01-12'")
_finds("rollup_documents", {"severity": {"$ne": "low"}, "network.action": "reject", "network.dst_port": {"$gt": 1000}}, "severity <> 'low' and network.action = 'reject' and network.dst_port > 1000")


@_add("laid_out_sorted", "select _id as eid from siem_events where event_type = 'firewall' order by network.dst_port desc nulls last, _id limit 50")
def laid_out_sorted(spark: SparkSession, d: str) -> DataFrame:
    """A page by the order of a layout."""
    request = {"filter": {"event_type": "firewall"}, "sort": [{"network.dst_port": "desc"}, {"eid": "asc"}], "limit": 50}
    return _found(_stored(spark, d), request, ["eid"])


@_add("rollup_stored_groups", "select severity as _id, count(*) as n from siem_events where network.action <> 'reject' group by 1")
def rollup_stored_groups(spark: SparkSession, d: str) -> DataFrame:
    """A group count from the stored joint counts alone."""
    c = _stored(spark, d)
    kept, stages = c.rollup(c.manifest()), P.parse_pipeline([{"$match": {"network.action": {"$ne": "reject"}}}, {"$group": {"_id": "severity", "n": {"$count": {}}}}])
    groups = R.group_counts(kept, stages[: R.covers_group(kept, stages)])
    return groups.select(F.variant_get("_id", "$", "string").alias("_id"), "n")


@_add("rollup_stored_count", "select count(*) as \"count\" from siem_events where coalesce(severity <> 'low', false) or coalesce(network.action = 'reject', false)")
def rollup_stored_count(spark: SparkSession, d: str) -> DataFrame:
    """A count from the stored joint counts alone."""
    c = _stored(spark, d)
    return R.count(c.rollup(c.manifest()), Q.parse_query({"filter": {"$or": [{"severity": {"$ne": "low"}}, {"network.action": "reject"}]}, "count_only": True}))


@_add(
    "rollup_sizes",
    " union all ".join(f"select '{p}' as field, count(distinct {p}) + max(case when {p} is null then 1 else 0 end) as cardinality, count(*) as total_positions from siem_events" for p in ROLLED),
)
def rollup_sizes(spark: SparkSession, d: str) -> DataFrame:
    """What storage information says of the rollup."""
    said = _stored(spark, d).storage_info()["scan_accelerator"]
    return spark.createDataFrame([(c["field"], c["cardinality"], said["total_positions"]) for c in said["bitmap_columns"]], "field string, cardinality long, total_positions long")


@_add(
    "rollup_after_writes",
    """select coalesce(severity, 'none') as _id, count(*) as n from siem_events where not coalesce(network.action = 'reject', false) group by 1
       union all select 'new', 2""",
)
def rollup_after_writes(spark: SparkSession, d: str) -> DataFrame:
    """The same after inserts, a delete and an update by query; the counts are carried on, not made anew."""
    c, events = _empty(spark, ROLLED), _events(spark, d)
    for part in (F.col("severity").isNull(), F.col("severity") == "low", F.col("severity") != "low"):
        c.ingest(_texts(events.filter(part)), "t")
    c.bulk_insert([{"severity": "new"}, {"severity": "new", "network": {"action": 5}}])
    c.delete_by_query({"network.action": "reject"})
    c.update_by_query({"severity": {"$exists": False}}, {"$set": {"severity": "none"}})
    kept, stages = c.rollup(c.manifest()), P.parse_pipeline([{"$group": {"_id": "severity", "n": {"$count": {}}}}])
    return R.group_counts(kept, stages).select(F.variant_get("_id", "$", "string").alias("_id"), "n")


@_add(
    "stored_life",
    """with t as (select name, category, status, severity, row_number() over (order by name) as k from event_types)
       select name, case when k = 1 then null else category end as category,
              case when k = 1 then 'replaced' when k = 2 then null else status end as status,
              case when k = 1 then null when severity >= 3 then 9 else severity end as severity,
              case when k <> 1 and severity >= 3 then 'a' end as deep,
              1 + case when k in (1, 2) then 1 else 0 end + case when k <> 1 and severity >= 3 then 1 else 0 end as rev
       from t where k <> 3 and not (k > 4 and coalesce(status = 'active', false))
       union all select 'added', null, null, null, null, 1""",
)
def stored_life(spark: SparkSession, d: str) -> DataFrame:
    """Bulk insert, insert, replace, patch, deletes and updates by id and by query, and what is left of event_types."""
    c, rows = _empty(spark), table(spark, d, "event_types").select("name", "category", "status", "severity").orderBy("name").collect()
    c.bulk_insert([{k: v for k, v in r.asDict().items() if v is not None} | {"k": i + 1} for i, r in enumerate(rows)])
    c.insert({"name": "added", "k": 0})
    ids = {r["k"]: r["_id"] for r in c.frame().df.select("_id", F.try_variant_get("doc", "$.k", "int").alias("k")).filter("k in (1, 2, 3)").collect()}
    c.replace(ids[1], {"name": c.get(ids[1])["name"], "status": "replaced", "k": 1, "_rev": 1})
    c.patch(ids[2], {"status": None})
    c.delete(ids[3])
    c.delete_by_query({"k": {"$gt": 4}, "status": "active"})
    c.update_by_query({"severity": {"$gte": 3}}, {"$set": {"severity": 9, "deep.er": "a"}})
    f = c.frame()
    fields = {"category": "category", "status": "status", "severity": "severity", "deep": "deep.er", "name": "name"}
    columns = [(F.try_variant_get("doc", "$.severity", "bigint") if n == "severity" else f.field(p).string).alias(n) for n, p in fields.items()]
    return f.df.select(*columns, F.col("_rev").alias("rev"))


@_add("stored_lookup", "select name, category, status, severity from event_types where name = (select max(name) from event_types)")
def stored_lookup(spark: SparkSession, d: str) -> DataFrame:
    """One document by its id."""
    c = _empty(spark)
    rows = [r.asDict() for r in table(spark, d, "event_types").select("name", "category", "status", "severity").collect()]
    for half in (rows[::2], rows[1::2]):
        c.bulk_insert(half)
    last = max(r["name"] for r in rows)
    one = c.get(c.documents(Q.page(c.frame(), Q.parse_query({"filter": {"name": last}}), ["_id"]))[0]["_id"])
    return spark.createDataFrame([tuple(one[n] for n in ("name", "category", "status", "severity"))], "name string, category string, status string, severity long")


@_add("stored_retention", "select _id as eid from siem_events where not coalesce(_created_at < '2026-01-10T00:00:00+00:00', false)")
def stored_retention(spark: SparkSession, d: str) -> DataFrame:
    """What a retention of ten days leaves on the twentieth."""
    c = _empty(spark)
    c.ingest(_texts(_events(spark, d)), "t")
    c.set_ttl(10, "at")
    c.cleanup(datetime.datetime(2026, 1, 20, tzinfo=datetime.UTC))
    f = c.frame()
    return f.df.select(f.field("eid").string.alias("eid"))
