"""Collections, mutations, layouts, rollups and the service, also over HTTP."""

from __future__ import annotations

import dataclasses
import datetime
import json
import logging
import shutil
import threading
import time
import urllib.error
import urllib.request

import pytest
from pyspark.sql import functions as F

from siltstone import errors as E
from siltstone.operators.filters import parse
from siltstone.service.engine import Engine, Pressure, access_path
from siltstone.service.http import serve
from siltstone.operators.query import parse_query
from siltstone.service import __main__ as main
from siltstone.sources import files
from siltstone.sources.catalog import Accelerator, Collection, Manifest, generated_ids, id_millis, merge_patch, set_path
from siltstone.streaming.ingest import ingest_lines


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    return Engine(spark, f"file://{tmp_path_factory.mktemp('warehouse')}", timeout_s=120)


def fill(engine, name, documents):
    engine.create_collection(name)
    assert engine.bulk_insert(name, documents).data["inserted"] == len(documents)


def test_document_life(engine):
    engine.create_collection("users.v1#$-x")
    name = "users.v1#$-x"
    made = engine.insert(name, {"name": "Ann", "age": 30, "_id": "mine", "deep": {"a": None}}).data
    assert made["_rev"] == 1 and made["_id"] != "mine" and id_millis(made["_id"]) > 1_700_000_000_000
    assert engine.get(name, made["_id"]).data == dict(sorted(made.items()))
    new = engine.replace(name, made["_id"], {"name": "Bob", "_rev": 1}).data
    assert new["_rev"] == 2 and new["_created_at"] == made["_created_at"] and "age" not in new
    with pytest.raises(E.DocumentConflict, match="Expected rev 1, current is 2"):
        engine.replace(name, made["_id"], {"_rev": 1})
    with pytest.raises(E.InvalidDocument):
        engine.patch(name, made["_id"], [1])
    patched = engine.patch(name, made["_id"], {"name": None, "mail": "x", "deep": {"n": {"kept": None}}}).data
    assert patched["_rev"] == 3 and "name" not in patched and patched["deep"] == {"n": {"kept": None}}
    assert engine.collection_info(name).data["doc_count"] == 1
    assert engine.delete(name, made["_id"]).data == {"deleted": True}
    for call in (engine.get, engine.delete):
        with pytest.raises(E.DocumentNotFound):
            call(name, made["_id"])
    assert engine.collection_info(name).data["doc_count"] == 0
    assert engine.drop_collection(name).data["dropped"]
    with pytest.raises(E.CollectionNotFound):
        engine.collection_info(name)


@pytest.mark.parametrize("name", ["", "_x", "a b", "a/b", None, 5])
def test_names(engine, name):
    with pytest.raises(E.InvalidDocument):
        engine.create_collection(name)


def test_bulk_takes_the_valid_ones(engine):
    engine.create_collection("bulk")
    said = engine.bulk_insert("bulk", [{"a": 1}, "text", {"a": 2}, 7, {"a": "x" * (17 << 20)}]).data
    assert said == {"inserted": 2, "errors": ["Document 1: must be a JSON object", "Document 3: must be a JSON object", "Document 4: exceeds 16 MB size limit"]}
    assert engine.query("bulk", {"count_only": True}).data == {"count": 2}
    with pytest.raises(E.InvalidDocument):
        engine.bulk_insert("bulk", [{}] * 10_001)
    with pytest.raises(E.DocumentTooLarge):
        engine.insert("bulk", {"a": "x" * (17 << 20)})
    with pytest.raises(E.CollectionExists):
        engine.create_collection("bulk")


EVENTS = [{"event_type": ["firewall", "dns", "auth", "wifi"][i % 4], "severity": i % 5, "network": {"action": ["block", "allow"][i % 2], "port": i}, "at": f"2026-01-{1 + i % 28:02d}"} for i in range(60)] + [{"event_type": "odd"}]


@pytest.fixture(scope="module")
def events(engine):
    fill(engine, "events", EVENTS)
    return "events"


def answers(engine, name):
    plain = lambda docs: [{k: v for k, v in d.items() if not k.startswith("_") or k == "_id" and not isinstance(v, str)} for d in docs]
    count = lambda f: engine.query(name, {"filter": f, "count_only": True}).data["count"]
    pipe = lambda p: sorted(engine.aggregate(name, p).data, key=repr)
    group = {"$group": {"_id": "event_type", "n": {"$count": {}}}}
    return [
        count({"event_type": "dns"}),
        count({"event_type": {"$ne": "dns"}}),
        count({"event_type": {"$in": ["dns", "auth", "dns"]}}),
        count({"event_type": "dns", "severity": {"$gte": 2}}),
        count({"$or": [{"event_type": "odd"}, {"network.action": "allow"}]}),
        count({"$not": {"network.action": "allow"}}),
        count({"severity": {"$gt": 1, "$lte": 3}}),
        count({"at": {"$gte": "2026-01-10", "$lt": "2026-01-12"}}),
        plain(engine.query(name, {"filter": {"event_type": "dns"}, "sort": [{"network.port": "desc"}], "limit": 5}).data),
        [d.get("network.port") for d in engine.query(name, {"sort": [{"network.port": "asc"}], "limit": 4, "fields": ["network.port"]}).data],
        pipe([group]),
        pipe([{"$match": {"network.action": {"$ne": "allow"}}}, group]),
        pipe([{"$match": {"event_type": "dns"}}, {"$group": {"_id": {"s": "severity", "t": "event_type"}, "n": {"$count": {}}, "m": {"$max": "at"}, "c": {"$collect": "severity"}}}]),
        engine.distinct(name, "severity").data["values"],
        engine.distinct(name, "event_type", {"severity": 3}, 2).data,
    ]


def test_accelerators_never_change_answers(engine, events):
    before = answers(engine, events)
    assert before[0] == 15 and before[1] == 46 and before[9] == [None, 0, 1, 2]
    engine.create_index(events, "type_sev", ["event_type", "severity"])
    engine.create_index(events, "at", field="at")
    assert answers(engine, events) == before
    engine.set_rollup(events, ["event_type", "network.action", "severity"])
    assert answers(engine, events) == before
    meta = engine.aggregate(events, [{"$match": {"severity": 3}}, {"$group": {"_id": "event_type", "n": {"$count": {}}}}]).meta
    assert meta["scan_strategy"] == "bitmap_filtered_aggregate" and meta["docs_scanned"] == 0 and meta["groups"] == 4
    assert engine.query(events, {"count_only": True, "filter": {"severity": 3}}).meta["scan_strategy"] == "bitmap"
    assert engine.query(events, {"filter": {"event_type": "dns", "severity": {"$gt": 1}}}).meta["scan_strategy"] == "compound_range"
    assert {c["field"]: c["cardinality"] for c in engine.storage_info(events).data["scan_accelerator"]["bitmap_columns"]} == {"event_type": 5, "network.action": 3, "severity": 6}
    with pytest.raises(E.IndexExists):
        engine.create_index(events, "at2", ["at"])
    with pytest.raises(E.IndexExists):
        engine.create_index(events, "at", ["severity"])
    for bad in ({"index": "a b", "fields": ["x"]}, {"index": "", "fields": ["x"]}, {"index": "n", "fields": []}, {"index": "n", "fields": [""]}, {"index": "n"}):
        with pytest.raises(E.InvalidIndex):
            engine.create_index(events, **bad)
    assert engine.drop_index(events, "at").data == {"dropped": True, "name": "at"}
    with pytest.raises(E.IndexNotFound):
        engine.drop_index(events, "at")
    assert [i["name"] for i in engine.list_indexes(events).data] == ["type_sev"]
    assert answers(engine, events) == before


def test_rollup_paths_are_found(engine):
    fill(engine, "found", [{"kind": "ab"[i % 2], "deep": {"x": i % 3, "y": {"z": 1}}, "list": [1], "id": f"u{i}", "_own": 1, "mixed": [i, "s"][i % 2]} for i in range(1200)])
    c = engine.catalog.collection("found")
    assert c.detect_rollup() == ["kind", "deep.x"]
    assert engine.query("found", {"filter": {"deep.x": 1}, "count_only": True}).meta["scan_strategy"] == "bitmap"
    assert engine.query("found", {"filter": {"deep.x": 1}, "count_only": True}).data == {"count": 400}


def test_rollups_follow_every_commit(spark, tmp_path):
    engine = Engine(spark, f"file://{tmp_path}", timeout_s=120, accelerator=Accelerator(fields=["kind", "deep.x"]))
    plain = Engine(spark, f"file://{tmp_path}", timeout_s=120, accelerator=Accelerator(enabled=False))
    engine.create_collection("r")
    group = [{"$group": {"_id": "kind", "n": {"$count": {}}}}]
    filters = [{"kind": "a"}, {"kind": {"$ne": "a"}}, {"$not": {"deep.x": 1}}, {"kind": "a", "n": {"$gte": 30}}, {"$and": [{"deep.x": {"$exists": True}}, {"n": {"$lt": 12}}]}, {"n": 3}, {}]

    def same():
        for f in filters:
            a, b = (e.query("r", {"filter": f, "limit": 1000}) for e in (engine, plain))
            assert a.data == b.data and a.meta["total_count"] == b.meta["total_count"] == len(a.data)
            assert engine.query("r", {"filter": f, "count_only": True}).data == plain.query("r", {"filter": f, "count_only": True}).data
        a, b = (e.aggregate("r", group) for e in (engine, plain))
        assert sorted(a.data, key=repr) == sorted(b.data, key=repr) and a.meta["groups"] == len(b.data)
        assert a.meta["scan_strategy"] == "bitmap_aggregate" and "docs_scanned" in a.meta and b.meta["docs_scanned"] > 0

    for lo, kind in ((0, "a"), (20, "b"), (40, None)):
        engine.bulk_insert("r", [{"kind": kind, "n": lo + i, "deep": {"x": i % 2} if lo else 5} for i in range(20)])
        same()
    c, said = engine.catalog.collection("r"), engine.query("r", {"filter": {"kind": "b", "n": {"$gte": 25}}, "limit": 3, "sort": [{"n": "asc"}]})
    assert (said.meta["scan_strategy"], said.meta["docs_scanned"], said.meta["total_count"]) == ("bitmap", 20, 15) and [d["n"] for d in said.data] == [25, 26, 27]
    assert engine.query("r", {"filter": {"kind": "never", "n": 1}}).meta["docs_scanned"] == 0
    assert engine.aggregate("r", [{"$match": {"kind": "b", "n": {"$gte": 25}}}, {"$group": {"_id": None, "s": {"$sum": "n"}}}]).meta["docs_scanned"] == 20
    assert engine.delete_by_query("r", {"kind": "b", "n": {"$lt": 25}}).data == {"deleted": 5}
    same()
    assert engine.update_by_query("r", {"deep": 5}, {"$set": {"kind": "z"}}).data == {"updated": 20}
    same()
    parts = c.manifest().rollup_parts
    engine.replace("r", engine.query("r", {"limit": 1}).data[0]["_id"], {"kind": "q"})
    assert parts.keys() < c.manifest().rollup_parts.keys()
    same()
    c.compact()
    m = c.manifest()
    assert len(m.rollup_parts) == 1 and not m.rollup_dead and set(m.spans) == set(m.files)
    same()
    c.vacuum()
    same()
    engine.create_index("r", "n", field="n")
    same()
    stats = engine.stats().data
    assert stats["scan_accelerator"]["total_positions"] == 55 and {(x["field"], x["cardinality"]) for x in stats["scan_accelerator"]["bitmap_columns"]} == {("kind", 4), ("deep.x", 3)}
    assert all(x["memory_bytes"] > 0 for x in engine.storage_info("r").data["scan_accelerator"]["bitmap_columns"]) and stats["memory_config"]["cache_size_mb"] > 0
    assert engine.get_rollup("r").data["in_use"] and not plain.get_rollup("r").data["in_use"] and not plain.health().data["scan_accelerator_ready"]
    assert engine.delete_by_query("r", {}).data == {"deleted": 55}
    assert engine.query("r", {"filter": {"kind": "z"}}).data == [] and engine.aggregate("r", group).data == []
    assert engine.storage_info("r").data["oldest_doc"] is None


def test_categorical_paths_are_found_with_enough_rows(spark, tmp_path):
    engine = Engine(spark, f"file://{tmp_path}", timeout_s=120, accelerator=Accelerator(sample_rows=100, max_cardinality=5))
    fill(engine, "auto", [{"kind": "ab"[i % 2], "user": f"u{i}"} for i in range(80)])
    c = engine.catalog.collection("auto")
    assert not c.manifest().rollup and not c.manifest().profiled
    engine.bulk_insert("auto", [{"kind": "c", "user": f"v{i}"} for i in range(80)])
    assert c.manifest().rollup == ["kind"] and engine.query("auto", {"filter": {"kind": "c"}, "count_only": True}).meta["scan_strategy"] == "bitmap"
    engine.set_rollup("auto", [])
    engine.bulk_insert("auto", [{"kind": "c"}])
    assert c.manifest().rollup == [] and engine.query("auto", {"filter": {"kind": "c"}, "count_only": True}).data == {"count": 81}


def test_a_failed_commit_ends_writing(spark, tmp_path):
    engine = Engine(spark, f"file://{tmp_path}", timeout_s=120)
    fill(engine, "p", [{"a": 1}])
    c = engine.catalog.collection("p")
    whole, c._files._fs = c._files._fs, None
    c._files.names, c._files.read = (lambda f: ["1.json"]), (lambda f: json.dumps(dataclasses.asdict(m)))
    m = Manifest("p", "now", version=1)
    with pytest.raises(AttributeError):
        c.commit(m)
    c._files._fs = whole
    del c._files.names, c._files.read
    for write in (lambda: engine.insert("p", {"a": 2}), lambda: engine.set_ttl("p", 3)):
        with pytest.raises(E.StoragePoisoned):
            write()
    assert engine.query("p", {}).data[0]["a"] == 1
    health = engine.health().data
    assert health["status"] == "degraded" and "warning" in health and engine.stats().data["storage_poisoned"] and "storage_poisoned 1" in engine.metrics_text()


def test_answers_have_a_bound(engine, monkeypatch):
    import siltstone.service.engine as S

    fill(engine, "bound", [{"n": i} for i in range(30)])
    monkeypatch.setattr(S, "MAX_ANSWER_ROWS", 20)
    with pytest.raises(E.InvalidPipeline):
        engine.aggregate("bound", [{"$match": {"n": {"$gte": 0}}}])
    with pytest.raises(E.InvalidPipeline):
        engine.aggregate("bound", [{"$group": {"_id": "n", "c": {"$count": {}}}}])
    with pytest.raises(E.InvalidQuery):
        engine.distinct("bound", "n", None, 21)
    said = engine.aggregate("bound", [{"$group": {"_id": "n", "c": {"$count": {}}}}, {"$sort": {"_id": 1}}, {"$limit": 3}])
    assert [d["_id"] for d in said.data] == [0, 1, 2] and said.meta["groups"] == 30
    assert engine.query("bound", {"limit": 0}).meta["total_count"] == 30


def test_options(tmp_path):
    (tmp_path / "keys").write_text("# mine\n\n one \ntwo\n")
    o = main.options(["--data-dir", "x", "--api-key", "zero", "--api-key-file", str(tmp_path / "keys"), "--tls", "--bitmap-fields", "a,b", "--no-bitmap", "--log-file", str(tmp_path / "log"), "-l", "warn"])
    assert main.api_keys(o) == ["zero", "one", "two"] and o.no_bitmap and o.bitmap_max_cardinality == 1000
    assert main.tls_context(main.options(["-d", "x"])) is None
    if shutil.which("openssl"):
        assert main.tls_context(o) is not None
    main.logging_to(o)
    logging.getLogger("siltstone.http").warning("kept")
    logging.getLogger("siltstone.http").info("left out")
    assert (tmp_path / "log").read_text().count("\n") == 1


def test_layout_conditions_reach_the_scan(engine):
    fill(engine, "laid", [{"t": "abc"[i % 3], "n": i} for i in range(30)])
    engine.create_index("laid", "t", ["t", "n"])
    c = engine.catalog.collection("laid")
    m = c.manifest()
    plan = c.narrowed(parse({"t": "a", "n": {"$gt": 5}}), m).df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(.ix0.s,a)" in plan.replace("`", "") and "GreaterThan(.ix1.n,5.0)" in plan.replace("`", "")


def test_delete_and_update_by_query_rewrite_only_what_matches(engine):
    fill(engine, "logs", [{"level": "info", "n": i} for i in range(10)])
    engine.bulk_insert("logs", [{"level": "error", "n": i, "src": "x"} for i in range(10)])
    c = engine.catalog.collection("logs")
    before = set(c.manifest().files)
    said = engine.update_by_query("logs", {"level": "error"}, {"$set": {"src.geo.code": "ZZ", "n": 5, "_created_at": "2020"}})
    assert said.data == {"updated": 10}
    assert len(before & set(c.manifest().files)) == 1
    docs = engine.query("logs", {"filter": {"src.geo.code": "ZZ"}}).data
    assert len(docs) == 10 and all(d["_rev"] == 2 and d["n"] == 5 and d["_created_at"] == "2020" and d["src"] == {"geo": {"code": "ZZ"}} for d in docs)
    assert engine.delete_by_query("logs", {"level": "info", "n": {"$lt": 4}}).data == {"deleted": 4}
    assert engine.delete_by_query("logs", {"level": "none"}).data == {"deleted": 0}
    assert engine.collection_info("logs").data["doc_count"] == 16
    for bad in ({}, {"$inc": {"n": 1}}, [], {"$set": {"_id": "x"}}, {"$set": {"_rev": "x"}}):
        with pytest.raises(E.InvalidQuery):
            engine.update_by_query("logs", {}, bad)
    c.compact()
    assert len(c.manifest().files) == 1 and engine.collection_info("logs").data["doc_count"] == 16
    assert c.vacuum() > 0
    assert len(engine.query("logs", {"filter": {"level": "error"}}).data) == 10


def test_retention(engine):
    fill(engine, "old", [{"at": t} for t in ("2026-01-01T00:00:00+00:00", "2026-01-09T23:59:59+00:00", "2026-01-10T00:00:00+00:00", "zz", 5)] + [{"other": 1}])
    assert engine.get_ttl("old").data == {"enabled": False}
    with pytest.raises(E.InvalidDocument):
        engine.set_ttl("old", 0)
    assert engine.set_ttl("old", 10, "at").data == {"retention_days": 10, "field": "at", "enabled": True}
    assert engine.cleanup(datetime.datetime(2026, 1, 20, tzinfo=datetime.UTC))["old"] == 2
    assert engine.collection_info("old").data["doc_count"] == 4
    assert engine.delete_ttl("old").data == {"deleted": True}
    assert "old" not in engine.cleanup()
    engine.set_ttl("old", 1, "at")
    engine.drop_collection("old")
    engine.create_collection("old")
    assert engine.get_ttl("old").data == {"enabled": False}


def test_one_of_two_writers_wins(engine, monkeypatch):
    engine.create_collection("race")
    c = engine.catalog.collection("race")
    m = c.manifest()
    other = Collection(c.spark, c._files, engine.catalog.root, "race")
    c.commit(m)
    with pytest.raises(E.DocumentConflict):
        other.commit(m)
    monkeypatch.setattr(files, "OBJECT_STORES", {"file"})
    n = c.manifest()
    assert c.commit(n).version == n.version + 1 == c.manifest().version
    with pytest.raises(E.DocumentConflict):
        other.commit(n)
    assert not engine.catalog.broken


def test_ingest_and_stream(engine, spark, tmp_path):
    engine.create_collection("lines")
    c = engine.catalog.collection("lines")
    texts = spark.createDataFrame([('{"a": 1}',), ("[1]",), ("{",), (None,), ('{"a": 2, "a": 3}',), ('{"b": {"c": "é"}}',)], "t string").repartition(3)
    assert c.ingest(texts, "t") == (2, 4)
    ids = [r["_id"] for r in c.frame().df.select("_id").collect()]
    assert len(set(ids)) == 2 and all(id_millis(i) for i in ids)
    assert spark.range(0, 1000, 1, 7).select(generated_ids(5).alias("i")).distinct().count() == 1000
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.txt").write_text('{"s": 1}\nnothing\n{"s": 2}\n')
    for want in (2, 2):
        ingest_lines(spark, str(tmp_path / "in"), c, str(tmp_path / "check")).awaitTermination()
        assert engine.query("lines", {"filter": {"s": {"$exists": True}}, "count_only": True}).data["count"] == want
    assert c.ingest(texts, "t", str(tmp_path / "check"), 0) == (0, 0)


def test_timeout_cancels(spark, tmp_path):
    slow = Engine(spark, f"file://{tmp_path}", timeout_s=0.5)
    sleep = F.udf(lambda i: time.sleep(0.05), "string")
    with pytest.raises(E.QueryTimeout):
        slow._timed(lambda: spark.range(4000).select(sleep("id")).collect())


def test_pressure():
    p = Pressure()
    for ms, want in ((100, "normal"), (6000, "high"), (100, "high"), (100, "high"), (900, "high"), (100, "high"), (100, "high"), (100, "normal")):
        p.write(ms)
        assert p.state == want


def test_access_paths():
    made = [{"name": "i", "fields": ["a", "b", "c"]}, {"name": "j", "fields": ["z"]}]
    path = lambda r: access_path(parse_query(r), made)
    assert path({"filter": {"a": 1}, "sort": [{"b": "asc"}]}) == ("i", "index_sorted")
    assert path({"filter": {"a": 1, "b": 2}}) == ("i", "compound_eq")
    assert path({"filter": {"a": 1, "b": {"$gt": 2}}}) == ("i", "compound_range")
    assert path({"filter": {"z": {"$in": [1]}}}) == ("j", None)
    assert path({"filter": {"q": 1}}) == path({"filter": {"$or": [{"a": 1}]}}) == (None, None)


def test_merging_and_setting():
    assert merge_patch({"a": 1, "b": {"c": 1}}, {"a": None, "b": {"d": {"e": None}}}) == {"b": {"c": 1, "d": {"e": None}}}
    assert merge_patch({"a": 1}, [1]) == [1]
    d = {"a": 5}
    set_path(d, "a.b.c", 1)
    set_path(d, ".".join("x" * 21), 1)
    assert d == {"a": {"b": {"c": 1}}}


def test_http(engine):
    server = serve(engine, port=0, keys=["secret"], metrics_public=True)
    threading.Thread(target=server.serve_forever, daemon=True).start()

    def call(method, path, body=None, key="secret"):
        url = f"http://127.0.0.1:{server.server_port}{path}"
        headers = {"Authorization": f"Bearer {key}"} if key else {}
        data = None if body is None else body.encode() if isinstance(body, str) else json.dumps(body).encode()
        try:
            with urllib.request.urlopen(urllib.request.Request(url, data, headers, method=method)) as r:
                text, status = r.read().decode(), r.status
                assert r.headers["X-Request-Id"]
        except urllib.error.HTTPError as e:
            text, status = e.read().decode(), e.code
        return status, json.loads(text) if text[:1] == "{" else text

    try:
        assert call("GET", "/_health", key=None)[1]["data"]["status"] == "healthy"
        assert "siltstone_documents_total" in call("GET", "/_metrics", key=None)[1]
        assert call("GET", "/_stats", key=None)[0] == 401 and call("GET", "/", key="wrong")[1]["error"]["code"] == "UNAUTHORIZED"
        assert call("GET", "/")[1]["data"]["name"] == "siltstone"
        assert call("POST", "/_collections", {"name": "web"})[0] == 201
        assert call("POST", "/_collections", {"name": "web"})[1]["error"]["code"] == "COLLECTION_EXISTS"
        assert call("POST", "/web/docs", "{bad")[1]["error"]["code"] == "INVALID_QUERY"
        status, said = call("POST", "/web/docs", {"n": 1, "t": {"x": "a"}})
        assert status == 201
        url = f"/web/docs/{said['data']['_id']}"
        assert call("POST", "/web/docs/_bulk", {"documents": [{"n": 2}, 1]})[1]["data"]["inserted"] == 1
        assert call("GET", url)[1]["data"]["n"] == 1
        assert call("PUT", url, {"n": 5})[1]["data"]["_rev"] == 2
        assert call("PATCH", url, {"m": 6})[1]["data"]["_rev"] == 3
        assert call("POST", "/web/query", {"filter": {"n": {"$gte": 2}}, "fields": ["n"]})[1]["meta"]["total_count"] == 2
        assert call("POST", "/web/aggregate", {"pipeline": [{"$group": {"_id": None, "s": {"$sum": "n"}}}]})[1]["data"] == [{"_id": None, "s": 7.0}]
        assert call("POST", "/web/distinct", {"field": "n", "limit": 2})[1]["data"] == {"field": "n", "values": [2, 5], "count": 2, "truncated": True}
        assert call("POST", "/web/query", {"filter": {"n": {"$x": 1}}})[0] == 400
        assert call("POST", "/web/indexes", {"name": "n", "field": "n"})[0] == 201
        assert call("GET", "/web/indexes")[1]["data"][0]["fields"] == ["n"]
        assert call("DELETE", "/web/indexes/n")[0] == 200
        assert call("PUT", "/web/ttl", {"retention_days": 3})[1]["data"]["field"] == "_created_at"
        assert call("GET", "/web/ttl")[1]["data"]["enabled"] and call("DELETE", "/web/ttl")[0] == 200
        assert call("POST", "/web/docs/_update_by_query", {"filter": {"n": 2}, "update": {"$set": {"n": 3}}})[1]["data"] == {"updated": 1}
        assert call("POST", "/web/docs/_delete_by_query", {"filter": {"n": 3}})[1]["data"] == {"deleted": 1}
        assert call("GET", "/web/storage")[1]["data"]["doc_count"] == 1
        assert call("DELETE", url)[0] == 200 and call("GET", url)[0] == 404
        assert any(c["name"] == "web" for c in call("GET", "/_collections")[1]["data"])
        assert call("PUT", "/web/rollup", {"fields": ["n"]})[1]["data"] == {"rollup": ["n"]} and call("GET", "/web/rollup")[1]["data"]["rollup"] == ["n"]
        assert call("DELETE", "/web/rollup")[1]["data"] == {"rollup": []}
        assert [call(*r)[0] for r in (("PUT", "/web/query", {}), ("PATCH", "/", {}), ("GET", "/web/docs"))] == [405] * 3
        assert [call(*r)[0] for r in (("GET", "/web/nothing"), ("GET", "/a/b/c/d"))] == [404] * 2 and call("GET", "/web/no")[1]["error"]["code"] == "NOT_FOUND"
        assert call("DELETE", "/web")[0] == 200 and call("GET", "/web")[0] == 404
    finally:
        server.shutdown()
