"""p1 to p3: skewed aggregation, feature tables and sessions, against plain Python."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.functions.cartesian import build
from siltstone.functions.instants import instant_ms, utc_day
from siltstone.operators import features as X
from siltstone.operators import salted as S
from siltstone.operators import sessions as W
from siltstone.sources.scratch import scratch_root
from siltstone.sources.tables import spread, table

# Spellings and the instants they are, None for none.
SPELLINGS = {
    "2026-01-05T01:00:00Z": 1767574800000,
    "2026-01-05T01:00:00.250Z": 1767574800250,
    "2026-01-05T01:00:00.250999Z": 1767574800250,
    "2026-01-05T06:30:03+05:30": 1767574803000,
    "2026-01-04T20:00:00.001-05:00": 1767574800001,
    "2026-01-05T00:00:00+23:59": 1767484860000,
    "2026-01-05 01:00:00": 1767574800000,
    "2026-01-05 01:00:00.123456": 1767574800123,
    "1767574800000": 1767574800000,
    "0000000000000": 0,
    "1969-12-31T23:59:59.999Z": -1,
    "2024-02-29T00:00:00Z": 1709164800000,
    "2026-02-29T00:00:00Z": None,
    "0000-00-00T00:00:00Z": None,
    "2026-01-05T24:00:00Z": None,
    "2026-01-05T01:60:00Z": None,
    "2026-01-05T01:00:00.5Z": None,
    "2026-01-05T01:00:00.12345Z": None,
    "2026-01-05T01:00:00": None,
    "2026-01-05 01:00:00Z": None,
    "2026-01-05T01:00:00+0100": None,
    "2026-01-05T01:00:00+24:00": None,
    "2026-01-05T01:00:00Z\n": None,
    " 2026-01-05T01:00:00Z": None,
    "176757480000": None,
    "17675748000000": None,
    "-767574800000": None,
    "pending": None,
    "": None,
    None: None,
}


def test_instants(spark):
    df = spark.createDataFrame([(t,) for t in SPELLINGS], "t string").repartition(1)
    got = {r["t"]: (r["ms"], r["d"]) for r in df.select("t", instant_ms(F.col("t")).alias("ms"), utc_day(instant_ms(F.col("t"))).cast("string").alias("d")).collect()}
    assert {t: v[0] for t, v in got.items()} == SPELLINGS
    assert got["1969-12-31T23:59:59.999Z"][1] == "1969-12-31" and got["1767574800000"][1] == "2026-01-05"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(1)
    return [(rng.choice(["hot"] * 20 + ["warm", None, "", "x" * 5000, *map(str, range(30))]), rng.choice(["a", "a", "A", None]), rng.choice([None, *range(5)]), 1) for _ in range(5000)]


@pytest.mark.parametrize("how", [{}, {"salts": 1}, {"salts": 7, "heavy_share": 0.5, "sample_fraction": 1.0}, {"sample_fraction": 0.0}])
def test_salted_results_are_the_plain_ones(spark, rows, how):
    df = spark.createDataFrame(rows, "k string, l string, v int, salt int").repartition(5)
    v = F.col("v")
    measures = {"rows": S.count(), "some": S.count_of(v), "total": S.total(v), "lo": S.smallest(v), "hi": S.largest(v), "mean": S.mean(v), "n": S.approx_distinct(v), "p0_n": S.count()}
    got = {(r["k"], r["l"]): tuple(r)[2:] for r in S.salted_aggregate(df, ["k", "l"], measures, **how).collect()}
    want = defaultdict(list)
    for k, l, x, _ in rows:
        want[k, l].append(x)
    assert got.keys() == want.keys()
    for key, xs in want.items():
        own = [x for x in xs if x is not None]
        mean = sum(own) / len(own) if own else None
        assert got[key] == (len(xs), len(own), sum(own) if own else None, min(own, default=None), max(own, default=None), mean, len(set(own)), len(xs))


def test_heavy_keys_are_found_and_spread(spark, rows):
    df = spark.createDataFrame(rows, "k string, l string, v int, salt int")
    heavy = S.heavy_key_hashes(df, ["k"], 0.2, 0.5)
    assert heavy == [r[0] for r in spark.createDataFrame([("hot",)], "k string").select(F.xxhash64("k")).collect()]
    assert S.heavy_key_hashes(df.limit(0), ["k"]) == []


def test_keys_holding_a_share(spark):
    df = spark.createDataFrame([("a", "x")] * 4 + [("b", "x")] * 3 + [(None, "x")] * 50 + [("c", None)] * 43, "k string, l string")
    assert [tuple(r) for r in S.keys_holding(df, ["k", "l"], 25).collect()] == [("a", "x", 4)]
    assert S.keys_holding(df.limit(0), ["k"], 25).count() == 0
    exact = spark.createDataFrame([("a",)] * 7 + [(f"r{i}",) for i in range(168)], "k string")
    assert [tuple(r) for r in S.keys_holding(exact, ["k"], 25).collect()] == [("a", 7)]
    with pytest.raises(ValueError):
        S.salted_aggregate(df, ["k"], {"k": S.count()})


def test_features(spark):
    rng = random.Random(2)
    events = [(rng.choice(["hot", "hot", None, "", *map(str, range(20))]), rng.choice(["b", "a", "A ", None, "é"]), rng.choice([None, *range(1000)]), 9) for _ in range(2000)]
    df = spark.createDataFrame(events, "ip string, kind string, ms long, n_events int").repartition(4)
    types = ["A ", "a", "b", "é"]
    for given, as_of in ((None, None), (["b", "never", "a"], 500)):
        listed = given or types
        end = as_of if as_of is not None else max(e[2] for e in events if e[2] is not None)
        got = {r["ip"]: r for r in X.feature_table(df, "ip", "kind", F.col("ms"), types=given, as_of_ms=as_of).collect()}
        assert got.keys() == {e[0] for e in events if e[0] is not None}
        for ip, r in got.items():
            own = [e for e in events if e[0] == ip]
            last = {t: max((e[2] for e in own if e[1] == t and e[2] is not None), default=None) for t in listed}
            n = Counter(e[1] for e in own)
            assert r["counts"] == [n[t] for t in listed]
            assert r["since"] == [None if last[t] is None else end - last[t] for t in listed]
            assert (r["n_events"], r["n_types"], r["n_other"]) == (len(own), sum(n[t] > 0 for t in listed), sum(c for t, c in n.items() if t not in listed))
            assert r["since_ms"] == end - max(e[2] for e in own if e[2] is not None)
    never = X.feature_table(df, "ip", "kind", F.col("ms"), types=["a", "never"], as_of_ms=0, unseen=-1)
    assert never.select(F.col("since")[1].alias("s"), F.col("counts")[1].alias("n")).distinct().collect() == [(-1, 0)]
    wide = X.widen(X.feature_table(df, "ip", "kind", F.col("ms")), types)
    assert wide.columns[5:9] == ["n_1", "since_1", "n_2", "since_2"] and wide.agg(F.sum("n_2")).first()[0] == sum(e[1] == "a" and e[0] is not None for e in events)
    assert X.feature_table(df.limit(0), "ip", "kind", F.col("ms")).count() == 0
    assert X.feature_table(df, "ip", "kind", F.col("ms"), types=[], as_of_ms=0).first()["counts"] == []
    with pytest.raises(ValueError):
        X.feature_table(df, "ip", "kind", F.col("ms"), max_types=2)


def plain_sessions(times, gap):
    out = []
    for t in sorted(times):
        if out and t - out[-1][1] <= gap:
            out[-1][1] = t
            out[-1][2] += 1
        else:
            out.append([t, t, 1])
    return [tuple(s) for s in out]


def test_trees_of_chunks_merge_to_the_tree_of_the_whole():
    rng = random.Random(3)
    for _ in range(400):
        n = rng.randint(1, 30)
        ms = sorted(rng.randint(0, rng.choice([5, 30, 200])) for _ in range(n))
        floor = rng.choice([0, 1, 3])
        ceiling = floor + rng.choice([0, 2, 10, 1000])
        ends = sorted(rng.sample(range(1, n), rng.randint(0, min(n - 1, 4)))) if n > 1 else []
        nodes, atoms = [], []
        first = lambda k: np.arange(k) == 0
        for p in np.split(np.array(ms, dtype=np.int64), ends):
            made, kept = build(p, p, np.ones_like(p), np.zeros_like(p), first(len(p)), np.array([True]), floor, ceiling)
            nodes += zip(*(x.tolist() for x in made[1:]), strict=True)
            atoms.append(kept)
        whole = [np.concatenate(c) for c in zip(*atoms, strict=True)]
        made, none = build(*whole[1:], first(len(whole[0])), np.array([False]), floor, ceiling)
        nodes += zip(*(x.tolist() for x in made[1:]), strict=True)
        assert not len(none[0])
        for t in range(floor, min(ceiling, 60) + 1):
            assert sorted((s, e, c) for g, p, s, e, c in nodes if g <= t < p) == plain_sessions(ms, t)


@pytest.mark.parametrize(("slab", "fan"), [(500_000, 6), (40, 0)])
def test_sessions_for_any_setting(spark, monkeypatch, slab, fan):
    monkeypatch.setattr(W, "FAN_BITS", fan)
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(batch)
    spark.conf.set(batch, slab)
    rng = random.Random(4)
    events = [("hot" if rng.random() < 0.5 else rng.choice([None, "", *map(str, range(40))]), rng.choice([None, *(rng.randint(0, 100_000) for _ in range(9))]), 0) for _ in range(1500)]
    events += [("hot", 77, 0)] * 200
    df = spark.createDataFrame(events, "ip string, ms long, gap_ms int").repartition(3)
    tree = W.session_tree(df, "ip", F.col("ms"), floor_ms=10, ceiling_ms=5000, slab=slab).cache()
    want = defaultdict(list)
    for ip, ms, _ in events:
        if ip is not None and ms is not None:
            want[ip].append(ms)
    for gap in (10, 11, 300, 4999, 5000):
        got = sorted((r["ip"], r["start_ms"], r["end_ms"], r["n_events"], r["duration_ms"]) for r in W.cut(tree, gap).collect())
        assert got == sorted((ip, s, e, n, e - s) for ip, ms in want.items() for s, e, n in plain_sessions(ms, gap))
    spark.conf.set(batch, before)


def test_sessions_edges(spark):
    gap = 1_800_000
    df = spark.createDataFrame([("a", 0), ("a", gap), ("a", 2 * gap + 1), ("b", -5), (None, 1), ("c", None)], "ip string, ms long")
    got = sorted(tuple(r) for r in W.cut(W.session_tree(df, "ip", F.col("ms")), gap).select("ip", "start_ms", "end_ms", "n_events").collect())
    assert got == [("a", 0, gap, 2), ("a", 2 * gap + 1, 2 * gap + 1, 1), ("b", -5, -5, 1)]
    assert W.session_tree(df.limit(0), "ip", F.col("ms")).count() == 0
    assert W.session_tree(df.filter("false").repartition(3), "ip", F.col("ms")).count() == 0
    with pytest.raises(ValueError):
        W.session_tree(df, "ip", F.col("ms"), floor_ms=5, ceiling_ms=4)


def test_settings_out_of_the_reach_of_a_tree(spark, tmp_path):
    ms = [0, 40_000, 90_000, 172_800_000 + 90_000, 400_000_000]
    df = spark.createDataFrame([("a", t) for t in ms], "ip string, ms long")
    low, high = 60_000, 86_400_000
    tree = W.session_tree(df, "ip", F.col("ms"), floor_ms=low, ceiling_ms=high)
    tree.write.parquet(str(tmp_path / "tree"))
    for own in (tree, spark.read.parquet(str(tmp_path / "tree"))):
        for gap in (-1, 30_000, low - 1, high + 1, 172_800_000):
            with pytest.raises(ValueError, match="60000 to 86400000"):
                W.cut(own, gap)
        assert [W.cut(own, gap).count() for gap in (low, high)] == [3, 3]
    with pytest.raises(ValueError, match="doesn't say"):
        W.cut(tree.withColumn("gap_ms", F.col("gap_ms") + 0), low)
    whole = W.session_tree(df, "ip", F.col("ms")).cache()
    for gap in (0, 30_000, 40_000, 60_000, 86_400_000, 172_800_000, 300_000_000, W.CUT - 1):
        got = sorted((r["start_ms"], r["end_ms"], r["n_events"]) for r in W.cut(whole, gap).collect())
        assert got == sorted(plain_sessions(ms, gap))


def test_small_scans_are_spread_and_others_left(spark, tmp_path):
    spark.range(100).coalesce(1).write.parquet(str(tmp_path / "one"))
    spark.range(100).repartition(9).write.option("parquet.block.size", 1).parquet(str(tmp_path / "many"))
    before = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", str(128 << 20))
    cores = spark.sparkContext.defaultParallelism
    one, many = (spark.read.parquet(str(tmp_path / n)) for n in ("one", "many"))
    assert "Exchange" in spread(one.select("id"))._jdf.queryExecution().executedPlan().toString() and cores > 1
    assert "Exchange" not in spread(many.select("id"))._jdf.queryExecution().executedPlan().toString()
    assert spread(one).count() == spread(many).count() == 100
    assert spread(spark.range(3)).count() == 3
    spark.conf.set("spark.sql.files.openCostInBytes", before)


def test_a_table_that_is_written_anew_is_read_anew(spark, tmp_path):
    for frame in (spark.range(3), spark.range(4).select(F.col("id").cast("string").alias("text"), "id")):
        frame.write.mode("overwrite").parquet(str(tmp_path / "t.parquet"))
        for _ in range(2):
            got = table(spark, str(tmp_path), "t")
            assert got.schema.names == frame.schema.names and got.count() == frame.count()


def test_a_cluster_must_name_its_shared_folder(monkeypatch):
    class Session:
        applicationId = "app"

        def __init__(self, master, named=None):
            self.master, self.sparkContext, self.conf, self.named = master, self, self, named

        def get(self, name, default=None):
            return self.named

        def getConf(self):
            return self

    for master in ("yarn", "spark://h:7077", "local-cluster[3,2,1024]", "k8s://x"):
        with pytest.raises(RuntimeError):
            scratch_root(Session(master))
        assert scratch_root(Session(master, "hdfs://x/y/")) == "hdfs://x/y"
    for master in ("local", "local[8]", "local[*]"):
        assert scratch_root(Session(master)).startswith("file:///")
