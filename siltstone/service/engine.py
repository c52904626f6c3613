"""Every request of the service as a method that returns the data and meta of its envelope."""

from __future__ import annotations

import datetime
import json
import threading
import time
import uuid
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

import siltstone
from siltstone import errors as E
from siltstone import messages as M
from siltstone.functions.paths import Frame
from siltstone.limits import DISTINCT_LIMIT, MAX_ANSWER_ROWS, QUERY_TIMEOUT_S
from siltstone.operators import distinct as D
from siltstone.operators import pipeline as P
from siltstone.operators import query as Q
from siltstone.operators import rollup as R
from siltstone.operators.filters import All, Test, parse
from siltstone.sources.catalog import Accelerator, Catalog, Collection

# When slow writes are reported, and when no more.
SLOW_WRITE_MS, FAST_WRITE_MS, FAST_WRITES = 5_000, 500, 3


@dataclass
class Answer:
    """``data`` and ``meta`` of an envelope."""

    data: object
    meta: dict = field(default_factory=dict)

    def envelope(self) -> dict:
        """The whole answer."""
        return {"ok": True, "data": self.data, "meta": {k: v for k, v in self.meta.items() if v is not None}}


def error_envelope(error: E.EngineError) -> dict:
    """The answer for an error."""
    return {"ok": False, "error": {"code": error.code, "message": str(error)}, "meta": {}}


class Pressure:
    """"high" from one slow write until three fast ones in a row."""

    def __init__(self):
        self.state, self._fast = "normal", 0

    def write(self, ms: float) -> None:
        """Takes note of a write."""
        self._fast = self._fast + 1 if ms < FAST_WRITE_MS else 0
        if ms > SLOW_WRITE_MS:
            self.state = "high"
        elif self._fast >= FAST_WRITES:
            self.state = "normal"


def with_json(df: DataFrame) -> DataFrame:
    """One JSON text a row; NULL members are left out, and VARIANT ones are rendered as they are."""
    return df.select(F.to_json(F.struct(*(F.col(f"`{c}`") for c in df.columns))).alias("j")) if df.columns else df.select(F.lit("{}").alias("j"))


class Engine:
    """The service over a catalog."""

    def __init__(self, spark: SparkSession, root: str, timeout_s: float = QUERY_TIMEOUT_S, accelerator: Accelerator | None = None):
        self.spark, self.catalog, self.timeout_s = spark, Catalog(spark, root, accelerator), timeout_s
        self.lifetime, self.pressure, self.last_cleanup = Counter(), Pressure(), None
        self._began = time.monotonic()

    # System

    def info(self) -> Answer:
        """Name, version and age."""
        return Answer({"name": "siltstone", "version": siltstone.__version__, "uptime_seconds": self.uptime, "data_directory": self.catalog.root})

    @property
    def uptime(self) -> int:
        return int(time.monotonic() - self._began)

    def health(self) -> Answer:
        """Whether the service works, and whether writes are slow."""
        alive, broken = not self.spark.sparkContext._jsc.sc().isStopped(), self.catalog.broken
        said = {"status": "healthy" if alive and not broken else "degraded", "write_pressure": self.pressure.state, "scan_accelerator_ready": self.catalog.accelerator.enabled}
        return Answer(said | ({"warning": f"a commit failed, writes are refused until a restart: {broken}"} if broken else {}))

    def _all(self) -> list[Collection]:
        return [self.catalog.collection(n) for n in self.catalog.names()]

    def stats(self) -> Answer:
        """Totals over all collections and since the start."""
        own = [(c, c.manifest()) for c in self._all()]
        rolled = {m.name: c.rollup_columns(m) for c, m in own}
        return Answer(
            {
                "collection_count": len(own),
                "total_documents": sum(m.rows for _, m in own),
                "uptime_seconds": self.uptime,
                "storage_poisoned": bool(self.catalog.broken),
                "memory_config": self._memory(),
                "lifetime": {n: self.lifetime[n] for n in ("requests", "inserts", "queries", "deletes")},
                "ttl": {"active_policies": sum(m.ttl is not None for _, m in own), "last_cleanup_run": self.last_cleanup},
                "scan_accelerator": {
                    "ready": self.catalog.accelerator.enabled,
                    "total_positions": sum(m.rows for _, m in own if rolled[m.name]),
                    "bitmap_columns": [{"collection": n, **c} for n, columns in rolled.items() for c in columns],
                },
            }
        )

    def _memory(self) -> dict:
        """Spark's memory for storage, the row groups that writers hold, and the tasks that can write or compact at once."""
        sc = self.spark.sparkContext
        cache = sum(m._1() for m in sc._jvm.scala.jdk.javaapi.CollectionConverters.asJava(sc._jsc.sc().getExecutorMemoryStatus()).values())
        group, tasks = sc._jsc.hadoopConfiguration().getInt("parquet.block.size", 128 << 20) >> 20, sc.defaultParallelism
        return {"cache_size_mb": cache >> 20, "max_write_buffer_mb": group * tasks, "max_memtable_mb": group, "flush_workers": tasks, "compaction_workers": tasks}

    def metrics_text(self) -> str:
        """Nine metrics in the text exposition format."""
        manifests = [c.manifest() for c in self._all()]
        rows = [
            ("uptime_seconds", "Seconds since the start", "gauge", self.uptime),
            ("documents_total", "Documents in all collections", "gauge", sum(m.rows for m in manifests)),
            ("collections_total", "Collections", "gauge", len(manifests)),
            *((f"{n}_total", f"{n.capitalize()} since the start", "counter", self.lifetime[n]) for n in ("requests", "inserts", "queries", "deletes")),
            ("storage_poisoned", "Whether the storage refuses writes", "gauge", int(bool(self.catalog.broken))),
            ("ttl_active_policies", "Active retention policies", "gauge", sum(m.ttl is not None for m in manifests)),
        ]
        return "".join(f"# HELP siltstone_{n} {h}\n# TYPE siltstone_{n} {k}\nsiltstone_{n} {v}\n" for n, h, k, v in rows)

    # Collections

    def list_collections(self) -> Answer:
        """All collections."""
        return Answer([c.info() for c in self._all()])

    def create_collection(self, name: str) -> Answer:
        """A new, empty collection."""
        return Answer(self.catalog.create(name))

    def collection_info(self, name: str) -> Answer:
        """One collection."""
        return Answer(self.catalog.collection(name).info())

    def drop_collection(self, name: str) -> Answer:
        """Removes a collection with all that belongs to it."""
        self.catalog.drop(name)
        return Answer({"dropped": True, "name": name})

    def storage_info(self, name: str) -> Answer:
        """What a collection holds and takes."""
        return Answer(self.catalog.collection(name).storage_info())

    def list_indexes(self, name: str) -> Answer:
        """The indexes of a collection."""
        return Answer(self.catalog.collection(name).manifest().indexes)

    def create_index(self, name: str, index: str, fields: list[str] | None = None, field: str | None = None) -> Answer:
        """An index on one or more paths; ``fields`` goes before ``field``."""
        if fields is None and field is None:
            raise E.InvalidIndex(M.INDEX_FIELDS)
        return Answer(self.catalog.collection(name).create_index(index, fields if fields is not None else [field]))

    def drop_index(self, name: str, index: str) -> Answer:
        """Removes an index."""
        self.catalog.collection(name).drop_index(index)
        return Answer({"dropped": True, "name": index})

    def get_ttl(self, name: str) -> Answer:
        """A collection's retention."""
        return Answer(self.catalog.collection(name).manifest().ttl or {"enabled": False})

    def set_ttl(self, name: str, retention_days: int, field: str = "_created_at") -> Answer:
        """Sets a collection's retention."""
        return Answer(self.catalog.collection(name).set_ttl(retention_days, field))

    def delete_ttl(self, name: str) -> Answer:
        """Ends a collection's retention."""
        self.catalog.collection(name).delete_ttl()
        return Answer({"deleted": True})

    def cleanup(self, now: datetime.datetime | None = None) -> dict[str, int]:
        """Runs retention on all collections; documents removed by collection."""
        gone = {c.name: c.cleanup(now) for c in self._all() if c.manifest().ttl}
        self.last_cleanup = int(time.time())
        self.lifetime["deletes"] += sum(gone.values())
        return gone

    def get_rollup(self, name: str) -> Answer:
        """The paths whose joint counts are kept, with their sizes where the rollup is in use."""
        c = self.catalog.collection(name)
        m = c.manifest()
        return Answer({"rollup": m.rollup, "in_use": c.rollup(m) is not None, "bitmap_columns": c.rollup_columns(m)})

    def set_rollup(self, name: str, paths: list[str] | None = None) -> Answer:
        """Keeps the joint counts of paths; without any, of the categorical ones that are found."""
        c = self.catalog.collection(name)
        if paths is None:
            return Answer({"rollup": c.detect_rollup(self.catalog.accelerator.sample_rows, self.catalog.accelerator.max_cardinality)})
        c.set_rollup(paths)
        return Answer({"rollup": paths})

    # Documents

    def _wrote(self, kind: str, n: int, began: float) -> None:
        self.lifetime[kind] += n
        self.pressure.write((time.monotonic() - began) * 1000)

    def insert(self, name: str, document: object) -> Answer:
        """Adds a document."""
        began = time.monotonic()
        made = self.catalog.collection(name).insert(document)
        self._wrote("inserts", 1, began)
        return Answer(made)

    def bulk_insert(self, name: str, documents: object) -> Answer:
        """Adds the valid ones of several documents."""
        if not isinstance(documents, list):
            raise E.InvalidDocument("documents must be an array")
        began = time.monotonic()
        inserted, bad = self.catalog.collection(name).bulk_insert(documents)
        self._wrote("inserts", inserted, began)
        return Answer({"inserted": inserted, "errors": bad})

    def get(self, name: str, doc_id: str) -> Answer:
        """A document by id."""
        return Answer(self.catalog.collection(name).get(doc_id))

    def replace(self, name: str, doc_id: str, document: object) -> Answer:
        """Replaces a document."""
        return Answer(self.catalog.collection(name).replace(doc_id, document))

    def patch(self, name: str, doc_id: str, patch: object) -> Answer:
        """Patches a document."""
        return Answer(self.catalog.collection(name).patch(doc_id, patch))

    def delete(self, name: str, doc_id: str) -> Answer:
        """Removes a document."""
        began = time.monotonic()
        self.catalog.collection(name).delete(doc_id)
        self._wrote("deletes", 1, began)
        return Answer({"deleted": True})

    def delete_by_query(self, name: str, filter_spec: object) -> Answer:
        """Removes all matches."""
        parse(filter_spec)
        n, ms = self._timed(lambda: self.catalog.collection(name).delete_by_query(filter_spec))
        self.lifetime["deletes"] += n
        return Answer({"deleted": n}, {"duration_ms": ms})

    def update_by_query(self, name: str, filter_spec: object, update: object) -> Answer:
        """Updates all matches."""
        n, ms = self._timed(lambda: self.catalog.collection(name).update_by_query(filter_spec, update))
        return Answer({"updated": n}, {"duration_ms": ms})

    # Queries

    def _timed(self, work: Callable) -> tuple[object, float]:
        """The result of ``work`` and its milliseconds. Its jobs are cancelled when the timeout ends (0: never)."""
        began, tag, late = time.monotonic(), f"request-{uuid.uuid4().hex}", threading.Event()

        def cancel() -> None:
            late.set()
            self.spark.sparkContext.cancelJobsWithTag(tag)

        timer = threading.Timer(self.timeout_s, cancel) if self.timeout_s else None
        self.spark.sparkContext.addJobTag(tag)
        try:
            if timer:
                timer.start()
            result = work()
        except Exception as e:
            if late.is_set():
                raise E.QueryTimeout(f"{self.timeout_s:g} seconds") from e
            raise
        finally:
            if timer:
                timer.cancel()
            self.spark.sparkContext.removeJobTag(tag)
        return result, round((time.monotonic() - began) * 1000, 3)

    def query(self, name: str, request: dict) -> Answer:
        """A page of documents, or their count."""
        asked, c = Q.parse_query(request), self.catalog.collection(name)
        m = c.manifest()
        used, strategy = access_path(asked, m.indexes)
        self.lifetime["queries"] += 1

        def work() -> tuple[object, int, int]:
            nonlocal strategy, used
            kept = c.rollup(m) if asked.count_only else None
            if kept and R.covers_count(kept, asked):
                used, strategy = None, "bitmap"
                return None, R.count(kept, asked).first()[0], 0
            files = c.covered_files(asked.filter, m)
            if files is not None:
                strategy = strategy or "bitmap"
            if not (m.files if files is None else files):
                return None if asked.count_only else [], 0, 0
            frame, scanned = c.narrowed(asked.filter, m, files), m.rows if files is None else sum(m.files[f] for f in files)
            if asked.count_only or not asked.limit:
                return None if asked.count_only else [], Q.count(frame, asked).first()[0], scanned
            seen = Observation()
            page = Q.page(frame, Q.Query(asked.filter, asked.sort, asked.limit, asked.offset, None, False), ["_id"], seen)
            if asked.fields is None:
                return Collection.documents(page), seen.get["total"], scanned
            wanted = dict.fromkeys(["_id", *asked.fields])
            found = Frame(page, "doc")
            rows = page.select(*(F.to_json(F.struct(found.field(f).value.alias("v"))).alias(f"c{i}") for i, f in enumerate(wanted))).collect()
            return [{f: v for f, j in zip(wanted, r, strict=True) for v in json.loads(j).values()} for r in rows], seen.get["total"], scanned

        (docs, total, scanned), ms = self._timed(work)
        meta = {"duration_ms": ms, "total_count": total, "docs_scanned": scanned, "index_used": used, "scan_strategy": strategy}
        if docs is None:
            return Answer({"count": total}, meta)
        return Answer(docs, meta | {"returned_count": len(docs), "has_more": True if asked.offset + len(docs) < total and strategy == "index_sorted" else None})

    def aggregate(self, name: str, pipeline: object) -> Answer:
        """The rows of a pipeline."""
        stages, c = P.parse_pipeline(pipeline), self.catalog.collection(name)
        m = c.manifest()
        self.lifetime["queries"] += 1

        def work() -> tuple[list, int, str | None, int]:
            kept = c.rollup(m)
            covered, scanned = R.covers_group(kept, stages) if kept else 0, 0
            if covered:
                rows = R.group_counts(kept, stages[:covered])
                grouped = P.outcome(Frame(rows), stages[covered:], [], True) if stages[covered:] else P.Outcome(rows)
                done = P.Outcome(grouped.df, grouped.groups or rows, grouped.collected)
            else:
                lead = stages[0].spec if stages[0].name == "$match" else All(())
                files = c.covered_files(lead, m)
                scanned = m.rows if files is None else sum(m.files[f] for f in files)
                frame = c.narrowed(lead, m, files)
                frame = Frame(frame.df.select(*(F.col(f"`{n}`") for n in frame.df.columns if not n.startswith(".ix"))), "doc")
                done = P.outcome(frame, stages, ["_id"], True)
            raw = done.groups is None
            most = done.df.limit(MAX_ANSWER_ROWS + 1)
            docs = Collection.documents(most) if raw else [_shown(json.loads(r["j"]), done) for r in with_json(most).collect()]
            if len(docs) > MAX_ANSWER_ROWS:
                raise E.InvalidPipeline(f"The result has more than {MAX_ANSWER_ROWS} rows; a $limit is needed")
            last = max((i for i, s in enumerate(stages) if s.name == "$group"), default=0)
            groups = 0 if raw else len(docs) if all(s.name == "$sort" for s in stages[last + 1 :]) else done.groups.count()
            how = {0: None, 1: "bitmap_aggregate", 2: "bitmap_filtered_aggregate"}[covered]
            return docs, groups, how, scanned

        (docs, groups, how, scanned), ms = self._timed(work)
        return Answer(docs, {"duration_ms": ms, "docs_scanned": scanned, "groups": groups, "scan_strategy": how})

    def distinct(self, name: str, path: str, filter_spec: dict | None = None, limit: int = DISTINCT_LIMIT) -> Answer:
        """Different values of a path."""
        if not isinstance(path, str) or not isinstance(limit, int) or limit < 0:
            raise E.InvalidQuery("field must be a path and limit a non-negative integer")
        if limit > MAX_ANSWER_ROWS:
            raise E.InvalidQuery(f"limit must be at most {MAX_ANSWER_ROWS}")
        c = self.catalog.collection(name)
        m = c.manifest()
        node = parse(filter_spec) if filter_spec is not None else All(())
        frame = c.narrowed(node, m, c.covered_files(node, m))
        self.lifetime["queries"] += 1
        rows, ms = self._timed(lambda: with_json(D.distinct(frame, path, filter_spec, limit).select(F.struct("value").alias("v"))).collect())
        values = [json.loads(r["j"])["v"].get("value") for r in rows]
        used = next((i["name"] for i in m.indexes if i["fields"] == [path]), None) if filter_spec is None else None
        return Answer({"field": path, "values": values, "count": len(values), "truncated": 0 < limit <= len(values)}, {"duration_ms": ms, "docs_scanned": m.rows, "index_used": used})


def _shown(row: dict, done: P.Outcome) -> dict:
    """A group as the service shows it: null ``_id`` and results, and cut-off collections marked."""
    out = {"_id": row.get("_id")}
    for n in done.df.columns:
        if n != "_id" and not n.startswith("_truncated_"):
            out[n] = row.get(n)
            if n in done.collected and row.get(f"_truncated_{n}"):
                out[n] = {"values": row[n], "_truncated": True}
    return out


def access_path(query: Q.Query, indexes: list[dict]) -> tuple[str | None, str | None]:
    """The index whose layout narrows the scan of a query, and what kind of access that is."""
    node = query.filter
    tests = [t for t in ([node] if isinstance(node, Test) else node.parts if isinstance(node, All) else ()) if isinstance(t, Test)]
    equal = {t.path for t in tests if t.op == "$eq"}
    ranged = {t.path for t in tests if t.op in ("$gt", "$gte", "$lt", "$lte")}
    for i in indexes:
        lead = 0
        while lead < len(i["fields"]) and i["fields"][lead] in equal:
            lead += 1
        rest = i["fields"][lead:]
        if query.sort and not query.count_only and rest and rest[0] == query.sort[0][0]:
            return i["name"], "index_sorted"
        if lead >= 2:
            return i["name"], "compound_eq"
        if lead and rest and rest[0] in ranged:
            return i["name"], "compound_range"
    for i in indexes:
        if i["fields"][0] in equal | ranged | {t.path for t in tests if t.op == "$in"}:
            return i["name"], None
    return None, None
