"""Queries over dates, tags, topics, arms, members and pages, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from marginalia.functions import dates
from marginalia.operators import curation, search
from marginalia.storage import table

TOPIC = ("the thing", "in the")
_TOK = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')"
_K = "CAST(regexp_extract(props, '\"k\": *([0-9]+)', 1) AS BIGINT)"
_WHEN = "CASE WHEN event_id % 10 = 0 THEN strftime(ts, '%Y-01-01') WHEN event_id % 10 = 1 THEN '' ELSE strftime(ts, '%Y-%m-%d') END"


def _dated(spark: SparkSession, d: str) -> DataFrame:
    """Events with a text date: one in ten knows only its year, one in ten nothing."""
    kind = F.col("event_id") % 10
    day = F.when(kind == 0, F.date_format("ts", "yyyy-01-01")).when(kind == 1, "").otherwise(F.date_format("ts", "yyyy-MM-dd"))
    return table(spark, d, "events").select("event_id", "event_type", "user_id", day.alias("when_ts"), F.when(kind == 0, "year").when(kind == 1, "unknown").otherwise("day").alias("precision"))


def filter_window_day(spark: SparkSession, d: str) -> DataFrame:
    rows = _dated(spark, d)
    return rows.where(dates.within(F.col("when_ts"), F.col("precision"), "2024-01-10", "2024-01-20")).select("event_id", "when_ts")


def filter_year_range(spark: SparkSession, d: str) -> DataFrame:
    rows = _dated(spark, d)
    return rows.where(dates.within(F.col("when_ts"), F.col("precision"), "2024-06", "2024")).groupBy("event_type", "precision").agg(F.count("*").alias("n"))


def undated_count(spark: SparkSession, d: str) -> DataFrame:
    day = F.nullif(F.col("when_ts"), F.lit(""))
    return _dated(spark, d).groupBy("event_type").agg(F.count_if(day.isNull()).alias("undated"), F.min(day).alias("oldest"), F.max(day).alias("newest"))


def tags_overlap(spark: SparkSession, d: str) -> DataFrame:
    tags = F.array(F.get_json_object("props", "$.k").cast("long"))
    return table(spark, d, "events").where(F.arrays_overlap(tags, F.array(*(F.lit(x).cast("long") for x in (1, 2, 3, 69))))).groupBy("event_type").agg(F.count("*").alias("n"))


def topic_words(spark: SparkSession, d: str) -> DataFrame:
    """Posts of a topic, any of its phrases, by source."""
    docs = table(spark, d, "documents")
    hits = [search.phrase_matches(docs, p).select("doc_id", "source") for p in TOPIC]
    return hits[0].unionByName(hits[1]).distinct().groupBy("source").agg(F.count("*").alias("n"))


def arms(spark: SparkSession, d: str) -> DataFrame:
    """Authors by purchases, by signups, by clicks: interleaved by rank, each author in the first arm that has them."""
    events = table(spark, d, "events")
    per = lambda kind: (kind, events.where(F.col("event_type") == kind).groupBy("user_id").agg(F.count("*").alias("n")))
    return curation.interleaved([per("purchase"), per("signup"), per("click")], "user_id", [F.col("n")], 60)


def members_of_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Customers that are, or whose head (the smallest of their nation and segment) is, a customer of a large order."""
    c = table(spark, d, "customer")
    head = F.min("c_custkey").over(Window.partitionBy("c_nationkey", "c_mktsegment"))
    big = table(spark, d, "orders").where("o_totalprice > 400000")
    return curation.cluster_members(c.select("c_custkey", head.alias("head")), big, "c_custkey", "head", "o_custkey")


def stranded_sources(spark: SparkSession, d: str) -> DataFrame:
    """Lines whose supplier's nation isn't their customer's, by nation pair: an equal key and a residual condition."""
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey").join(s, "l_suppkey")
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    return lines.join(o.join(c, "o_custkey"), "l_orderkey").where("s_nationkey <> c_nationkey").groupBy("s_nationkey", "c_nationkey").agg(F.count("*").alias("n"))


def reconciled(spark: SparkSession, d: str) -> DataFrame:
    """Customers with an order of theirs but with none that is still open."""
    o = table(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return table(spark, d, "customer").join(o, "c_custkey", "left_semi").join(o.where("o_orderstatus = 'O'"), "c_custkey", "left_anti").select("c_custkey", "c_name")


def usage_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Totals, the last thirty days, distinct readers and the share of zero values, in one pass."""
    e = table(spark, d, "events")
    last = e.agg(F.max("ts").alias("last"))
    rows = e.crossJoin(F.broadcast(last)).withColumn("recent", F.col("ts") >= F.col("last") - F.expr("INTERVAL 30 DAYS"))  # one row
    n = F.count("*")
    return rows.groupBy("event_type").agg(
        n.alias("reads"), F.count_if("recent").alias("recent"), F.countDistinct("user_id").alias("readers"),
        F.countDistinct(F.when(F.col("recent"), F.col("user_id"))).alias("recent_readers"), F.round(F.count_if(F.col("value") < 1) / n, 6).alias("zero_rate"),
    )


def freshness(spark: SparkSession, d: str) -> DataFrame:
    """By author: sources, how many of them are stale (nothing in 10 days of the last arrival), and the last one."""
    pairs = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.max("ts").alias("pulled"))
    last = table(spark, d, "events").agg(F.max("ts").alias("last"))
    stale = F.count_if(F.col("pulled") < F.col("last") - F.expr("INTERVAL 10 DAYS"))
    return pairs.crossJoin(F.broadcast(last)).groupBy("user_id").agg(F.count("*").alias("sources"), stale.alias("stale"), F.max("pulled").alias("last_pull"))  # last: one row


def older_lines(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.min(F.year("o_orderdate")).cast("long").alias("first_year"), F.max(F.year("o_orderdate")).cast("long").alias("last_year"))


def list_members(spark: SparkSession, d: str) -> DataFrame:
    """Per customer the priorities of their orders in first-seen order."""
    seen = table(spark, d, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.min("o_orderkey").alias("at"))
    ordered = F.array_sort(F.collect_list(F.struct("at", "o_orderpriority")))
    return seen.groupBy("o_custkey").agg(F.array_join(F.transform(ordered, lambda x: x["o_orderpriority"]), ", ").alias("lists"))


def search_page(spark: SparkSession, d: str) -> DataFrame:
    """Hits 26 to 50 of a search and whether more follow."""
    hits = search.bm25(table(spark, d, "documents"), "the thing", 51)
    return hits.where("rank > 25").withColumn("more", F.max("rank").over(Window.partitionBy()) > 50).where("rank <= 50").select("doc_id", F.col("rank").cast("long").alias("rank"), "more")


def evidence(spark: SparkSession, d: str) -> DataFrame:
    """The three best distinct values of each author."""
    once = table(spark, d, "events").groupBy("user_id", "value").agg(F.min("event_id").alias("event_id"))
    w = Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id")
    return once.withColumn("place", F.row_number().over(w).cast("long")).where("place <= 3")


def union_matches(spark: SparkSession, d: str) -> DataFrame:
    """Documents of a topic's phrase or of a watched source, once each, among those that have labels."""
    docs = table(spark, d, "documents")
    hits = search.phrase_matches(docs, "of the").select("doc_id").unionByName(docs.where("source = 'web'").select("doc_id")).distinct()
    return hits.join(table(spark, d, "labels"), "doc_id", "left_semi")


def unfiled(spark: SparkSession, d: str) -> DataFrame:
    """Documents that no phrase of the topic files, by language."""
    docs = table(spark, d, "documents")
    filed = search.phrase_matches(docs, "of the").select("doc_id")
    return docs.join(filed, "doc_id", "left_anti").groupBy("lang").agg(F.count("*").alias("n"))


def topic_preview(spark: SparkSession, d: str) -> DataFrame:
    """Distinct authors and finds by watch (a tag) and kind, and finds a day."""
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, d, "events").groupBy(k.alias("watch"), "event_type").agg(
        F.countDistinct("user_id").alias("people"), F.count("*").alias("finds"), F.round(F.count("*") / 30, 4).alias("a_day")
    )


def open_page(spark: SparkSession, d: str) -> DataFrame:
    """Every text in slices of 2,000 characters: where each begins and ends, its hash, and whether more follows."""
    n = F.length("text")
    offset = F.explode(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(2000))).alias("offset")
    pages = table(spark, d, "documents").where("text is not null").select("doc_id", "text", n.alias("n"), offset)
    part = F.substring("text", F.col("offset") + 1, F.lit(2000))
    end = F.least(F.col("n"), F.col("offset") + 2000)
    return pages.select("doc_id", F.col("offset").cast("long").alias("offset"), F.sha2(part, 256).alias("slice_sha256"), end.cast("long").alias("next_offset"), (end < F.col("n")).alias("partial"))


def self_threads(spark: SparkSession, d: str) -> DataFrame:
    return curation.self_thread(table(spark, d, "conversations").dropDuplicates(["conv_id", "turn"]), "conv_id", "turn", "role").groupBy("conv_id").agg(F.count("*").alias("own_turns"))


QUERIES = {
    f.__name__: f
    for f in (
        filter_window_day, filter_year_range, undated_count, tags_overlap, topic_words, arms, members_of_clusters, stranded_sources, reconciled, usage_rollup, freshness, older_lines,
        list_members, search_page, evidence, union_matches, unfiled, topic_preview, open_page, self_threads,
    )
}

_DATED = f"(SELECT event_id, event_type, {_WHEN} AS when_ts, CASE event_id % 10 WHEN 0 THEN 'year' WHEN 1 THEN 'unknown' ELSE 'day' END AS precision FROM events)"
_SPACED = f"' ' || array_to_string({_TOK}, ' ') || ' '"


def sql(bm25: str) -> dict[str, str]:
    """The queries as SQL; ``bm25`` is the 51 best hits (doc_id, rank)."""
    return {
        "filter_window_day": f"SELECT event_id, when_ts FROM {_DATED} WHERE when_ts <> '' AND CASE precision WHEN 'year' THEN substr(when_ts, 1, 4) || '-12-31' ELSE when_ts END >= '2024-01-10' AND when_ts <= '2024-01-20'",
        "filter_year_range": f"SELECT event_type, precision, count(*) AS n FROM {_DATED} WHERE when_ts <> '' AND CASE precision WHEN 'year' THEN substr(when_ts, 1, 4) || '-12-31' ELSE when_ts END >= '2024-06-01' AND when_ts <= '2024-12-31' GROUP BY 1, 2",
        "undated_count": f"SELECT event_type, count(*) FILTER (WHERE when_ts = '') AS undated, min(nullif(when_ts, '')) AS oldest, max(nullif(when_ts, '')) AS newest FROM {_DATED} GROUP BY 1",
        "tags_overlap": f"SELECT event_type, count(*) AS n FROM events WHERE {_K} IN (1, 2, 3, 69) GROUP BY 1",
        "topic_words": f"SELECT source, count(*) AS n FROM documents WHERE contains({_SPACED}, ' {TOPIC[0]} ') OR contains({_SPACED}, ' {TOPIC[1]} ') GROUP BY 1",
        "arms": "WITH c AS (SELECT user_id, CASE event_type WHEN 'purchase' THEN 0 WHEN 'signup' THEN 1 ELSE 2 END AS arm, event_type AS basis, count(*) AS n FROM events WHERE event_type IN ('purchase', 'signup', 'click') GROUP BY ALL), f AS (SELECT * FROM c QUALIFY arm = min(arm) OVER (PARTITION BY user_id)), t AS (SELECT *, row_number() OVER (PARTITION BY arm ORDER BY n DESC, user_id) AS turn FROM f) SELECT user_id, basis, turn FROM t ORDER BY turn, arm LIMIT 60",
        "members_of_clusters": "WITH m AS (SELECT c_custkey, min(c_custkey) OVER (PARTITION BY c_nationkey, c_mktsegment) AS head FROM customer), w AS (SELECT o_custkey FROM orders WHERE o_totalprice > 400000) SELECT DISTINCT c_custkey, head FROM m WHERE c_custkey IN (FROM w) OR head IN (FROM w)",
        "stranded_sources": "SELECT s_nationkey, c_nationkey, count(*) AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE s_nationkey <> c_nationkey GROUP BY 1, 2",
        "reconciled": "SELECT c_custkey, c_name FROM customer c WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c.c_custkey) AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c.c_custkey AND o_orderstatus = 'O')",
        "usage_rollup": "SELECT event_type, count(*) AS reads, count(*) FILTER (WHERE r) AS recent, count(DISTINCT user_id) AS readers, count(DISTINCT CASE WHEN r THEN user_id END) AS recent_readers, round(count(*) FILTER (WHERE value < 1) / count(*), 6) AS zero_rate FROM (SELECT *, ts >= (SELECT max(ts) FROM events) - INTERVAL 30 DAY AS r FROM events) GROUP BY 1",
        "freshness": "SELECT user_id, count(*) AS sources, count(*) FILTER (WHERE pulled < (SELECT max(ts) FROM events) - INTERVAL 10 DAY) AS stale, max(pulled) AS last_pull FROM (SELECT user_id, event_type, max(ts) AS pulled FROM events GROUP BY 1, 2) GROUP BY 1",
        "older_lines": "SELECT o_custkey, count(*) AS n, min(year(o_orderdate)) AS first_year, max(year(o_orderdate)) AS last_year FROM orders GROUP BY 1",
        "list_members": "SELECT o_custkey, string_agg(o_orderpriority, ', ' ORDER BY first_at) AS lists FROM (SELECT o_custkey, o_orderpriority, min(o_orderkey) AS first_at FROM orders GROUP BY 1, 2) GROUP BY 1",
        "search_page": f"WITH h AS ({bm25}) SELECT doc_id, rank, (SELECT max(rank) FROM h) > 50 AS more FROM h WHERE rank BETWEEN 26 AND 50",
        "evidence": "SELECT user_id, value, event_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS place FROM (SELECT user_id, value, min(event_id) AS event_id FROM events GROUP BY 1, 2) QUALIFY place <= 3",
        "union_matches": f"SELECT doc_id FROM documents WHERE (source = 'web' OR contains({_SPACED}, ' of the ')) AND doc_id IN (SELECT doc_id FROM labels)",
        "unfiled": f"SELECT lang, count(*) AS n FROM documents WHERE NOT contains({_SPACED}, ' of the ') GROUP BY 1",
        "topic_preview": f"SELECT {_K} AS watch, event_type, count(DISTINCT user_id) AS people, count(*) AS finds, round(count(*) / 30, 4) AS a_day FROM events GROUP BY 1, 2",
        "open_page": "SELECT doc_id, o AS offset, sha256(substr(text, CAST(o AS INT) + 1, 2000)) AS slice_sha256, least(length(text), o + 2000) AS next_offset, least(length(text), o + 2000) < length(text) AS partial FROM (SELECT doc_id, text, unnest(range(0, greatest(length(text), 1), 2000)) AS o FROM documents WHERE text IS NOT NULL)",
        "self_threads": "WITH t AS (SELECT conv_id, turn, role, first_value(role) OVER (PARTITION BY conv_id ORDER BY turn) AS a FROM conversations), o AS (SELECT *, sum(CAST(role IS DISTINCT FROM a AS INT)) OVER (PARTITION BY conv_id ORDER BY turn) AS others FROM t) SELECT conv_id, count(*) AS own_turns FROM o WHERE others = 0 GROUP BY 1",
    }
