"""Queries p4 to p8 over the test tables: this subpackage's operators with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions.instants import duck_instant_ms, instant_ms, utc_day
from siltstone.llm import hash_runs, heavy_hitters, leaks, repetition, tokens
from siltstone.sources.scratch import materialize
from siltstone.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]

ONE_IN = 100
FIELDS = ("src_ip", "query")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Values of src_ip and of query that hold at least 1 % of the rows where the field isn't null."""
    events = table(spark, d, "siem_events")
    found = [heavy_hitters.holding_share(events, f, ONE_IN).select(F.lit(f).alias("field"), "item") for f in FIELDS]
    return found[0].unionByName(found[1])


def p4_top(spark: SparkSession, d: str) -> DataFrame:
    """The 100 most frequent values of src_ip and of query with their counts."""
    events = table(spark, d, "siem_events")
    top = [heavy_hitters.most_frequent(events, f).select(F.lit(f).alias("field"), "item", "n") for f in FIELDS]
    return top[0].unionByName(top[1])


def p5_distinct(spark: SparkSession, d: str) -> DataFrame:
    """Different src_ip for every UTC day, two to seven days, event_type, combinations of these and all, and the error."""
    return hash_runs.distinct_counts(table(spark, d, "siem_events"), instant_ms(F.col("_received_at")), "event_type", "src_ip")


def p5_merged(spark: SparkSession, d: str) -> DataFrame:
    """Different src_ip for every event_type, from runs of two parts of the rows that were made and sliced apart: those with
    a query, a few, and the others."""
    events, day = table(spark, d, "siem_events"), utc_day(instant_ms(F.col("_received_at")))
    parts = [(events.filter(F.col("query").isNotNull()), hash_runs.SLICE_HASHES), (events.filter(F.col("query").isNull()), hash_runs.SLICE_HASHES >> 4)]
    runs = [materialize(hash_runs.hash_runs(part, day, "event_type", "src_ip", per_slice=n), "hash-runs") for part, n in parts]
    counts = hash_runs.union_counts(runs[0].unionByName(runs[1]), ["event_type"])
    return counts.withColumn("collision_bound", hash_runs.collision_bound(F.col("n_distinct")))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    """The ids of every text by byte_bpe_50k."""
    return tokens.encode(table(spark, d, "documents"), "doc_id", "text")


def p6_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Every text again, from its ids by byte_bpe_50k."""
    ids = tokens.encode(table(spark, d, "documents"), "doc_id", "text")
    return tokens.decode(ids, "doc_id", "ids").select("doc_id", F.decode("bytes", "UTF-8").alias("text"))


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    index = materialize(leaks.build_index(table(spark, d, "documents"), "doc_id", "text"), "postings")
    return leaks.search_index(index, table(spark, d, "eval_items"), doc_key="doc_id", item_key="item_id", item_text="text")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents with 12 consecutive words of a test item, or all words of one of 8 to 11, from a stored index of the
    whole corpus."""
    return _leaks(spark, d)


def p7_items(spark: SparkSession, d: str) -> DataFrame:
    """The test items that leaked and the documents that hold each."""
    return _leaks(spark, d).groupBy("item_id").agg(F.count(F.lit(1)).alias("n_documents"))


def p7_near(spark: SparkSession, d: str) -> DataFrame:
    """As p7_found, but two of the words may be others or dropped, and the rest shifted by up to two places by words in
    between or dropped; in one pass over the texts, without storing an index."""
    keys = {"doc_key": "doc_id", "doc_text": "text", "item_key": "item_id", "item_text": "text"}
    return leaks.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"), **keys, missing=2, slop=2)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose runs of five words are repeats to 30 % or more."""
    return repetition.find_repetitive(table(spark, d, "documents"), "doc_id", "text")


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    """The measures of repeated content of every document."""
    return repetition.repetition_shares(table(spark, d, "documents"), "doc_id", "text")


QUERIES: dict[str, Query] = {f.__name__: f for f in (p4_found, p4_top, p5_distinct, p5_merged, p6_ids, p6_round_trip, p7_found, p7_items, p7_near, p8_found, p8_shares)}

_DAY = f"cast(make_timestamp({duck_instant_ms('_received_at')} * 1000) as date)"

ORACLES: dict[str, str] = {
    "p4_found": " union all ".join(
        f"select '{f}' as field, {f} as item from siem_events where {f} is not null group by {f} having count(*) * {ONE_IN} >= (select count({f}) from siem_events)" for f in FIELDS
    ),
    "p4_top": " union all ".join(
        f"(select '{f}' as field, {f} as item, count(*) as n from siem_events where {f} is not null group by {f} order by n desc, item limit {heavy_hitters.TOP})" for f in FIELDS
    ),
    "p5_distinct": f"""
        with e as (select {_DAY} as day, event_type, src_ip from siem_events where src_ip is not null),
             w as (select day + cast(i as integer) as day, cast(k as integer) as n_days, event_type, src_ip
                   from e, generate_series(0, 6) as g(i), generate_series(2, 7) as h(k) where day is not null and i < k),
             c as (select case grouping(day, event_type) when 0 then 'day_type' when 1 then 'day' when 2 then 'type' else 'all' end as level,
                          day, case when grouping(day) = 0 then 1 end as n_days, event_type, count(distinct src_ip) as n_distinct
                   from e group by grouping sets ((day, event_type), (day), (event_type), ())
                   having (grouping(day) = 1 or day is not null) and (grouping(event_type) = 1 or event_type is not null)
                   union all
                   select case when grouping(event_type) = 0 then 'window_type' else 'window' end, day, n_days, event_type, count(distinct src_ip)
                   from w group by grouping sets ((day, n_days, event_type), (day, n_days)) having grouping(event_type) = 1 or event_type is not null)
        select *, cast(n_distinct as double) * (cast(n_distinct as double) - 1) / pow(2, 65) as collision_bound from c where n_distinct > 0""",
    "p6_round_trip": "select doc_id, coalesce(text, '') as text from documents",
    "p5_merged": """select event_type, count(distinct src_ip) as n_distinct, cast(count(distinct src_ip) as double) * (cast(count(distinct src_ip) as double) - 1) / pow(2, 65) as collision_bound
        from siem_events where src_ip is not null group by event_type""",
}
