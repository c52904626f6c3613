"""p4 and p5: frequent values and distinct counts."""

from __future__ import annotations

import datetime
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.functions.instants import instant_ms
from siltstone.llm import hash_runs as H
from siltstone.llm import heavy_hitters as K
from siltstone.llm.runs import decode_runs, encode_runs


def test_most_frequent_ties_nulls_and_order(spark):
    values = ["b", "a", "a", "b", "c", None, None, None, "", "x" * 100_000]
    df = spark.createDataFrame([(v, 1, 2) for v in values], "v string, n long, item long")
    assert [(r["item"], r["n"]) for r in K.most_frequent(df, "v", 3).collect()] == [("a", 2), ("b", 2), ("", 1)]
    assert K.most_frequent(df, "v", 50).count() == 5
    assert K.most_frequent(df.limit(0), "v").count() == 0


def test_share_is_of_non_null_rows_and_inclusive(spark):
    df = spark.createDataFrame([("hot",)] * 25 + [("warm",)] * 10 + [(None,)] * 60 + [(f"r{i}",) for i in range(65)], "v string")
    assert {(r["item"], r["n"]) for r in K.holding_share(df, "v", 10).collect()} == {("hot", 25), ("warm", 10)}
    assert K.holding_share(df.limit(0), "v", 10).count() == 0
    assert K.holding_share(df.select(F.lit(None).cast("string").alias("v")), "v", 10).count() == 0


def test_runs_round_trip():
    rng = np.random.default_rng(5)
    ends = np.array([-(2**63), -(2**63) + 1, 0, 127, 128, 2**63 - 1], dtype=np.int64)
    for k in (1, 2, 7):
        runs = [np.unique(rng.integers(-(2**63), 2**63 - 1, rng.integers(1, 1000), dtype=np.int64)) for _ in range(k)]
        runs = [np.array([5]), *runs, ends, np.arange(-3, 400)]
        n = np.array([len(r) for r in runs])
        begin = np.cumsum(n) - n
        values = np.concatenate(runs)
        coded = encode_runs(values, begin)
        assert len(coded[0].as_py()) == 0 and len(coded[len(runs) - 1].as_py()) == 402
        assert (decode_runs(values[begin], n, coded) == values).all()
        assert (decode_runs(values[begin][2:], n[2:], coded.slice(2)) == values[begin[2] :]).all()
    assert len(decode_runs(ends[:0], ends[:0], encode_runs(ends[:0], ends[:0]))) == 0


def test_unite_is_a_set_union():
    rng = np.random.default_rng(6)
    runs = [np.unique(rng.integers(0, 500, 200)) for _ in range(7)]
    assert (H.unite(runs) == np.unique(np.concatenate(runs))).all()
    assert len(H.unite([])) == 0


def test_distinct_counts_against_sets(spark):
    rng = random.Random(7)
    rows = []
    for _ in range(4000):
        at = rng.choice(["2026-01-05T23:59:59.999Z", "2026-01-06T00:30:00+01:00", "1767657600000", "2026-01-07 10:00:00", "1969-12-31T00:00:00Z", "pending", None, ""])
        rows.append((rng.choice([None, "", *map(str, range(300))]) if rng.random() < 0.7 else "hot", rng.choice(["a", "A", "b ", None]), at, 1))
    df = spark.createDataFrame(rows, "ip string, kind string, at string, n_distinct int")
    day_of = {"2026-01-05T23:59:59.999Z": "2026-01-05", "2026-01-06T00:30:00+01:00": "2026-01-05", "1767657600000": "2026-01-06", "2026-01-07 10:00:00": "2026-01-07", "1969-12-31T00:00:00Z": "1969-12-31"}
    want: dict = {}
    for ip, kind, at, _ in rows:
        if ip is not None:
            d = day_of.get(at)
            ends = [(str(datetime.date.fromisoformat(d) + datetime.timedelta(days=i)), n) for i in range(7) for n in range(max(2, i + 1), 8)] if d else []
            windows = [(level, (e, n, k)) for e, n in ends for level, k in (("window", None), ("window_type", kind))]
            for level, key in [("all", (None, None, None)), ("type", (None, None, kind)), ("day", (d, 1, None)), ("day_type", (d, 1, kind)), *windows]:
                if not (level.endswith("type") and kind is None or level.startswith("day") and d is None):
                    want.setdefault((level, *key), set()).add(ip)
    for how in ({}, {"per_slice": 16, "run_hashes": 8}):
        got = H.distinct_counts(df, instant_ms(F.col("at")), "kind", "ip", **how).collect()
        assert {(r["level"], r["day"] and r["day"].isoformat(), r["n_days"], r["event_type"]): r["n_distinct"] for r in got} == {k: len(v) for k, v in want.items()}
        assert all(r["collision_bound"] == r["n_distinct"] * (r["n_distinct"] - 1) / 2**65 for r in got)
    assert H.distinct_counts(df.limit(0), instant_ms(F.col("at")), "kind", "ip").count() == 0


def test_runs_of_two_inputs_unite(spark):
    one = spark.range(0, 1000).select(F.lit("t").alias("kind"), F.col("id").cast("string").alias("ip"))
    two = spark.range(500, 1500).select(F.lit("t").alias("kind"), F.col("id").cast("string").alias("ip"))
    day = F.lit("2026-01-01").cast("date")
    runs = [H.hash_runs(x, day, "kind", "ip", per_slice=64) for x in (one, two)]
    assert [r["n_distinct"] for r in H.union_counts(runs[0].unionByName(runs[1]), ["event_type"]).collect()] == [1500]
    assert Counter(r["event_type"] for r in H.union_counts(runs[0], ["event_type"]).collect()) == {"t": 1}


@pytest.mark.parametrize("sizes", [(3000, 300, 1000, 1000), (3000, 300, 1000, 100_000), (3000, 3000, 10, 1000), (5000, 1, 1 << 20, 1 << 20), (3000, 0, 7, 1000)])
def test_runs_of_inputs_of_unequal_slices_unite(spark, sizes):
    whole, part, *per_slice = sizes
    df = spark.range(0, whole).select(F.when(F.col("id") % 3 > 0, "t").alias("kind"), F.col("id").cast("string").alias("ip"))
    day = F.lit("2026-01-01").cast("date")
    made = [H.hash_runs(x, day, "kind", "ip", per_slice=n, run_hashes=500).cache() for x, n in zip((df, df.filter(F.col("ip").cast("long") < part)), per_slice, strict=True)]
    both = made[0].unionByName(made[1])
    want = {"t": sum(i % 3 > 0 for i in range(whole)), None: sum(i % 3 == 0 for i in range(whole))}
    for bits in (None, 0, 1, 5, 12):
        assert {r["event_type"]: r["n_distinct"] for r in H.union_counts(both, ["event_type"], bits=bits).collect()} == want
        same = H.resliced(both, bits)
        assert same.agg(F.sum("n")).first()[0] == both.agg(F.sum("n")).first()[0] and same.select("bits").distinct().count() == 1
    whole_counts = H.calendar_counts(both, [], 2, bits=3).filter("span = 'all'").collect()
    assert [r["n_distinct"] for r in whole_counts] == [whole]


def test_runs_are_as_long_as_they_may_be(spark):
    df = spark.range(0, 50_000, 1, 3).select(F.lit("t").alias("kind"), F.col("id").cast("string").alias("ip"))
    runs = H.hash_runs(df, F.lit(None).cast("date"), "kind", "ip", run_hashes=40_000).collect()
    assert sorted(r["n"] for r in runs) == [10_000, 40_000] and {r["bits"] for r in runs} == {0}
