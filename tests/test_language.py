"""Filters, ordering, queries and pipelines over schemaless and typed rows."""

from __future__ import annotations

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from siltstone import errors as E
from siltstone.functions.dialect import translate
from siltstone.functions.paths import Frame
from siltstone.operators import distinct as D
from siltstone.operators import pipeline as P
from siltstone.operators import query as Q
from siltstone.operators import rollup as R
from siltstone.operators.filters import compile_filter, parse
from siltstone.plans import catalogue
from tests.canon import matches

# Documents with every type at one path, missing and null fields, and awkward names.
VALUES = [1, 1.0, "1", True, False, None, [1], [1, "a", None], [], {"b": 1}, {"b": {"c": "x"}}, {}, 0.1 + 0.2, 0.3, -0.0, 0, 2**53 + 1, 2**53, "a\n", "é", "a\rb", "", -5, 2.5, "zz"]
DOCUMENTS = [{"_id": f"{i:03d}", "a": v} for i, v in enumerate(VALUES)] + [{"_id": "100"}, {"_id": "101", "a": {"b": None}}, {"_id": "102", "x y": 1, "k$": "v", "tags": ["t", 1, 1.5]}]


def variants(spark, documents):
    rows = [(d["_id"], json.dumps({k: v for k, v in d.items() if k != "_id"})) for d in documents]
    return Frame(spark.createDataFrame(rows, "_id string, j string").select("_id", F.parse_json("j").alias("doc")).cache(), "doc")


@pytest.fixture(scope="module")
def frame(spark):
    return variants(spark, DOCUMENTS)


def random_filter(rng, depth=0):
    r = rng.random()
    if depth < 3 and r < 0.35:
        if r < 0.1:
            return {"$not": random_filter(rng, depth + 1)}
        return {rng.choice(["$and", "$or"]): [random_filter(rng, depth + 1) for _ in range(rng.randint(0, 3))]}
    path = rng.choice(["a", "a", "a", "a.b", "a.b.c", "tags", "x y", "k$", "none", "_id"])
    op = rng.choice(["", "$eq", "$ne", "$gt", "$gte", "$lt", "$lte", "$in", "$nin", "$exists", "$contains", "$regex"])
    v = rng.choice([*VALUES, "t", "v", "101"])
    if op == "":
        return {path: "x" if isinstance(v, dict) else v}
    if op in ("$in", "$nin"):
        v = rng.choice([[rng.choice(VALUES) for _ in range(rng.randint(0, 4))], 5])
    if op == "$regex":
        v = rng.choice(["^a", "1", "^$", "[a-z]", 7])
    return {path: {op: v}}


def test_random_filters_mean_what_the_canon_says(frame):
    rng = random.Random(20)
    specs = [random_filter(rng) for _ in range(240)]
    for lo in range(0, len(specs), 40):
        part = specs[lo : lo + 40]
        row = frame.df.agg(*(F.sort_array(F.collect_list(F.when(compile_filter(parse(s), frame), F.col("_id")))).alias(f"f{i}") for i, s in enumerate(part))).first()
        for i, s in enumerate(part):
            assert row[i] == [d["_id"] for d in DOCUMENTS if matches(s, d)], s


def test_typed_rows_take_null_for_missing(spark):
    df = spark.createDataFrame([(1, "low", (22,), [1.5, None]), (2, None, (None,), None), (3, "high", None, []), (4, "", (443,), [2.0])], "id int, sev string, net struct<port: bigint>, v array<double>")
    f = Frame(df)
    cases = {
        '{"sev": {"$ne": "low"}}': [3, 4],
        '{"sev": {"$nin": ["low", null]}}': [3, 4],
        '{"$not": {"sev": "low"}}': [2, 3, 4],
        '{"sev": {"$exists": false}}': [2],
        '{"sev": null}': [],
        '{"sev": {"$ne": null}}': [1, 3, 4],
        '{"net.port": {"$gt": 22.5}}': [4],
        '{"net.port": "22"}': [],
        '{"net.port": 22.0}': [1],
        '{"net.port": {"$exists": true}}': [1, 4],
        '{"net.none": {"$exists": false}}': [1, 2, 3, 4],
        '{"v": {"$contains": 2}}': [4],
        '{"v": {"$contains": null}}': [1],
        '{"v": {"$eq": [1.5, null]}}': [1],
        '{"net": {"$eq": {"port": 443}}}': [4],
        '{"sev": {"$in": []}}': [],
        '{"sev": {"$in": "low"}}': [],
        '{"sev": {"$nin": "low"}}': [1, 3, 4],
        '{"$or": []}': [],
        '{"$and": []}': [1, 2, 3, 4],
        '{"$nor": 1}': [],
        '{"sev": {}}': [1, 2, 3, 4],
    }
    for spec, want in cases.items():
        got = [r["id"] for r in df.filter(compile_filter(parse(json.loads(spec)), f)).orderBy("id").collect()]
        assert got == want, spec


def test_clashing_and_awkward_names(spark):
    df = spark.createDataFrame([(1, 2, "x")], "id int, `a.b` int, `v` string").withColumn("m", F.create_map(F.lit("k.q"), F.lit(1), F.lit("k"), F.lit(2)))
    f = Frame(df)
    assert df.filter(compile_filter(parse({"m.k": 2}), f)).count() == 1
    assert df.filter(compile_filter(parse({"a.b": 2}), f)).count() == 0
    assert [c for c in Q.project(f, ["m.k", "none"]).columns] == ["m.k", "none"]


@pytest.mark.parametrize(("pattern", "text", "found"), [("a$", "a\n", False), (r"^\w$", "é", True), ("a.b", "a\rb", True), ("(?m)a$", "a\nb", True), ("[$]", "a$", True), (r"\$", "$", True), ("(?P<n>x)", "x", True), (r"^\d$", "٣", True)])
def test_dialect(spark, pattern, text, found):
    assert spark.createDataFrame([(text,)], "t string").filter(F.col("t").rlike(translate(pattern))).count() == found


@pytest.mark.parametrize("pattern", ["(?=a)", "(?<!a)b", r"(a)\1", "[", "a" * 1025, "*"])
def test_what_the_dialect_lacks(pattern):
    with pytest.raises(E.InvalidQuery):
        parse({"a": {"$regex": pattern}})


def nested(n):
    spec = {"a": 1}
    for _ in range(n):
        spec = {"$not": spec}
    return spec


@pytest.mark.parametrize("bad", [[], "x", {"a": {"$what": 1}}, {"$and": {}}, {"$or": [1]}, {"$and": [{}] * 1001}, nested(21), {".".join("a" * 21): 1}])
def test_invalid_filters(bad):
    with pytest.raises(E.InvalidQuery):
        parse(bad)


def test_limits_that_pass(frame):
    parse(nested(20))
    assert frame.df.filter(compile_filter(parse({".".join("a" * 20): 1}), frame)).count() == 0
    assert Q.parse_query({"limit": 10**6}).limit == 10_000
    assert Q.parse_query({}).limit == 100


def test_order_is_total(spark, frame):
    up = [r["_id"] for r in Q.run(frame, {"sort": [{"a": "asc"}], "limit": 200}, ["_id"]).collect()]
    classes = {d["_id"]: d.get("a", "missing") for d in DOCUMENTS}

    def rank(v):
        return 0 if v == "missing" else 1 if v is None else 2 if isinstance(v, bool) else 3 if isinstance(v, (int, float)) else 4 if isinstance(v, str) else 5

    ranks = [rank(classes[i]) for i in up]
    assert ranks == sorted(ranks)
    numbers = [float(classes[i]) for i in up if rank(classes[i]) == 3]
    assert numbers == sorted(numbers)
    texts = [classes[i].encode() for i in up if rank(classes[i]) == 4]
    assert texts == sorted(texts)
    down = [r["_id"] for r in Q.run(frame, {"sort": [{"a": "desc"}], "limit": 200}, ["_id"]).collect()]
    assert [rank(classes[i]) for i in down] == ranks[::-1]
    assert [r["_id"] for r in Q.run(frame, {"sort": [{"a": -1}], "limit": 200}, ["_id"]).collect()] == up


def test_pages(spark):
    pages = Frame(spark.range(10).select(F.col("id").alias("num"), F.lpad(F.col("id").cast("string"), 3, "0").alias("_id")))
    assert [r["num"] for r in Q.run(pages, {"sort": [{"num": "desc"}], "limit": 3, "offset": 4}).collect()] == [5, 4, 3]
    assert Q.run(pages, {"limit": 0}).count() == 0
    assert Q.run(pages, {"offset": 50}).count() == 0
    assert Q.run(pages, {"count_only": True, "limit": 1, "filter": {"num": {"$gte": 4}}}).first()["count"] == 6


def shown(df):
    return sorted((json.loads(r["j"]) for r in df.select(F.to_json(F.struct("*")).alias("j")).collect()), key=repr)


def test_groups_of_schemaless_values(spark, frame):
    rows = shown(P.run(frame, [{"$group": {"_id": "a", "n": {"$count": {}}}}]))
    assert len(rows) == len({json.dumps(d.get("a"), sort_keys=True) for d in DOCUMENTS})
    assert next(r["n"] for r in rows if r.get("_id") is None) == 3
    assert sum(r.get("_id") == 1 and r["_id"] is not True for r in rows) == 2  # 1 and 1.0 are groups of their own
    assert sum(r.get("_id") == "1" for r in rows) == 1


def test_accumulators_on_mixed_values(frame):
    row = shown(P.run(frame, [{"$group": {"_id": None, "s": {"$sum": "a"}, "lo": {"$min": "a"}, "hi": {"$max": "a"}, "c": {"$collect": "a"}, "none": {"$avg": "nothing"}}}]))[0]
    numbers = [float(v) for v in VALUES if isinstance(v, (int, float)) and not isinstance(v, bool)]
    assert row["s"] == pytest.approx(sum(numbers), rel=1e-12)
    assert row["lo"] is False and "none" not in row
    assert isinstance(row["hi"], (dict, list))
    assert len(row["c"]) == len({json.dumps(d["a"], sort_keys=True) for d in DOCUMENTS if "a" in d})
    assert row["c"][0] is None


def test_group_forms(spark):
    df = spark.createDataFrame([("fw", "block", 8, "u1"), ("fw", "block", 5, None), ("fw", "allow", 3, "u2"), ("dns", "allow", 1, "u1")], "t string, act string, sev int, u string")
    f = Frame(df)
    assert shown(P.run(f, [{"$match": {"t": "fw", "act": "block"}}, {"$group": {"_id": None, "s": {"$sum": "sev"}, "a": {"$avg": "sev"}, "lo": {"$min": "sev"}, "hi": {"$max": "sev"}}}])) == [{"s": 13.0, "a": 6.5, "lo": 5, "hi": 8}]
    assert shown(P.run(f, [{"$group": {"_id": {"t": "t", "x": 7}, "n": {"$count": {}}}}])) == [{"_id": {"t": "dns", "x": 7}, "n": 1}, {"_id": {"t": "fw", "x": 7}, "n": 3}]
    assert shown(P.run(f, [{"$group": {"_id": 5, "n": {"$count": {}}}}])) == [{"_id": 5, "n": 4}]
    assert P.run(Frame(df.limit(0)), [{"$group": {"_id": None, "n": {"$count": {}}}}]).count() == 0
    assert shown(P.run(f, [{"$group": {"_id": "u", "acts": {"$collect": "act"}, "us": {"$collect": "u"}}}])) == sorted(
        [{"_id": "u1", "acts": ["allow", "block"], "us": ["u1"]}, {"_id": "u2", "acts": ["allow"], "us": ["u2"]}, {"acts": ["block"], "us": []}], key=repr
    )
    assert shown(P.run(f, [{"$group": {"_id": {}, "n": {"$count": {}}}}]))[0]["n"] == 4


def test_collect_is_cut_at_the_cap(spark):
    df = spark.range(2001).select((F.col("id") % 2).alias("g"), F.col("id").alias("v"))
    rows = P.run(Frame(df), [{"$group": {"_id": "g", "c": {"$collect": "v"}}}], mark_truncated=True).orderBy("_id").collect()
    assert [(len(r["c"]), r["_truncated_c"]) for r in rows] == [(1000, True), (1000, False)]
    assert rows[1]["c"][:3] == [1, 3, 5]


def test_collect_above_the_cap_is_marked_or_fails(spark):
    df = spark.range(2001).select((F.col("id") % 2).alias("g"), F.col("id").alias("v"))
    stages = [{"$group": {"_id": "g", "c": {"$collect": "v"}}}]
    with pytest.raises(Exception, match="more than 1000 values"):
        P.run(Frame(df), stages).collect()
    assert [len(r["c"]) for r in P.run(Frame(df.filter("g = 1")), stages).collect()] == [1000]


def test_several_collects_are_cut_apart(spark):
    documents = [{"_id": f"{i}", "g": i % 2, "many": i // 2, "few": ["x", None, 1, 1.0, [1]][i % 5], "odd": 7} | ({"own": "z"} if i % 2 else {}) for i in range(2400)]
    f = variants(spark, documents)
    stages = [{"$group": {"_id": "g", "many": {"$collect": "many"}, "few": {"$collect": "few"}, "own": {"$collect": "own"}, "never": {"$collect": "q"}, "n": {"$count": {}}}}]
    rows = {r["_id"]: r for r in shown(P.run(f, stages, mark_truncated=True))}
    for g, r in rows.items():
        assert r["many"] == list(range(1000)) and r["_truncated_many"] and r["n"] == 1200
        assert r["few"][1:] == [1, 1, "x", [1]] and r["few"][0] is None and not r["_truncated_few"]
        assert r["own"] == (["z"] if g else []) and r["never"] == [] and not r["_truncated_own"]
    df = spark.range(4000).select((F.col("id") % 3).alias("g"), F.col("id").cast("string").alias("a"), F.when(F.col("id") % 7 > 0, F.col("id") % 7).alias("b"))
    got = P.run(Frame(df), [{"$group": {"_id": "g", "a": {"$collect": "a"}, "b": {"$collect": "b"}}}], mark_truncated=True)
    for r in got.collect():
        assert r["a"] == sorted(str(i) for i in range(r["_id"], 4000, 3))[:1000] and r["_truncated_a"]
        assert r["b"] == [1, 2, 3, 4, 5, 6] and not r["_truncated_b"]


def test_values_of_a_group_are_limited_in_every_task(spark, frame):
    df = spark.range(5000).select((F.col("id") % 3).alias("g"), F.col("id").cast("string").alias("v"))
    for plan in (P.run(Frame(df), [{"$group": {"_id": "g", "c": {"$collect": "v"}}}]), P.run(variants(spark, [{"_id": f"{i}"} for i in range(1001)]), [{"$group": {"_id": "a", "c": {"$collect": "b"}}}])):
        text = plan._jdf.queryExecution().executedPlan().toString()
        assert "1000, Partial" in text and "SortAggregate" not in text
    for plan in (D.distinct(Frame(df), "v"), D.distinct(frame, "a"), P.run(frame, [{"$group": {"_id": "a", "n": {"$count": {}}}}]), R.build(frame, ["a"]).df):
        text = plan._jdf.queryExecution().executedPlan().toString()
        assert "HashAggregate" in text and "SortAggregate" not in text


def test_literals_as_group_keys(spark):
    f = Frame(spark.range(3).toDF("v"))
    for key in (5, 1.5, True, [1, {"a": None}], {}):
        got = shown(P.run(f, [{"$group": {"_id": key, "n": {"$count": {}}}}]))
        assert got == [{"_id": key, "n": 3}]
    assert shown(P.run(f, [{"$group": {"_id": {"a": 5, "b": "v"}, "n": {"$count": {}}}}]))[0] == {"_id": {"a": 5, "b": 0}, "n": 1}



@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables here")
def test_the_collected_ports_say_where_they_are_cut(spark):
    rows = catalogue.QUERIES["group_collect_marked"](spark, "/root/testdata/sf0.01").collect()
    ports = spark.read.parquet("/root/testdata/sf0.01/siem_events.parquet").groupBy("severity").agg(F.countDistinct("network.dst_port").alias("n"))
    assert {r["_id"]: (len(r["ports"]), r["_truncated_ports"]) for r in rows} == {r["severity"]: (min(r["n"], 1000), r["n"] > 1000) for r in ports.collect()}
    assert any(r["_truncated_ports"] for r in rows)


@pytest.mark.parametrize(
    "bad",
    [[], {}, [1], [{}], [{"$match": {}, "$limit": 1}], [{"$what": 1}], [{"$limit": -1}], [{"$limit": "1"}], [{"$limit": True}], [{"$group": {"n": {"$count": {}}}}], [{"$group": {"_id": None, "n": {"$sum": 1}}}], [{"$group": {"_id": None, "n": {"$median": "a"}}}], [{"$group": {"_id": None, "n": 1}}], [{"$sort": []}], [{"$limit": 1}] * 101],
)
def test_invalid_pipelines(bad):
    with pytest.raises(E.InvalidPipeline):
        P.parse_pipeline(bad)


def test_distinct(frame, spark):
    values = [json.loads(r["j"]).get("value") for r in D.distinct(frame, "a").select(F.to_json(F.struct("value")).alias("j")).collect()]
    assert len(values) == len({json.dumps(d["a"], sort_keys=True) for d in DOCUMENTS if "a" in d})
    assert D.distinct(frame, "a", {"a": {"$gt": 2}}).count() == 3
    assert D.distinct(frame, "a", limit=2).count() == 2
    assert D.distinct(frame, "nothing").count() == 0


def test_rollups_never_differ(frame):
    made, rng = R.build(frame, ["a", "a.b"]), random.Random(30)
    for _ in range(25):
        asked = Q.parse_query({"filter": random_filter(rng), "count_only": True})
        if R.covers_count(made, asked):
            assert R.count(made, asked).first()[0] == Q.count(frame, asked).first()[0], asked
    stages = P.parse_pipeline([{"$match": {"$not": {"a": 1}}}, {"$group": {"_id": "a.b", "n": {"$count": {}}}}])
    assert R.covers_group(made, stages) == 2
    assert shown(R.group_counts(made, stages)) == shown(P.outcome(frame, stages, []).df)
    assert R.covers_group(made, P.parse_pipeline([{"$group": {"_id": "c", "n": {"$count": {}}}}])) == 0
    assert R.covers_group(made, P.parse_pipeline([{"$group": {"_id": "a", "n": {"$sum": "a"}}}])) == 0
    assert R.profile(frame, ["a", "none"])["a"] > 5 and "none" not in R.profile(frame, ["a", "none"])


def test_predicates_reach_the_scan(spark, tmp_path):
    spark.range(100).select(F.col("id"), F.concat(F.lit("t"), F.col("id") % 5).alias("t"), F.col("id").cast("double").alias("v")).write.parquet(str(tmp_path / "t"))
    f = Frame(spark.read.parquet(str(tmp_path / "t")))
    spec = {"t": {"$in": ["t1", "t2"]}, "v": {"$gte": 10}, "$or": [{"id": 3}, {"id": {"$gt": 50}}]}
    plan = Q.project(Q.matching(f, Q.parse_query({"filter": spec})), ["v"])._jdf.queryExecution().executedPlan().toString()
    assert "In(t, [t1,t2])" in plan and "GreaterThanOrEqual(v,10.0)" in plan and "Or(EqualTo(id,3),GreaterThan(id,50))" in plan
    top = Q.run(f, {"sort": [{"v": "desc"}], "limit": 5})._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in top
