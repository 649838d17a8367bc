"""Rosters, reasons, looks and the smaller expressions as queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from marginalia.functions import dates, maps, texts
from marginalia.operators import curation, roster
from marginalia.storage import table


def roster_listing(spark: SparkSession, d: str) -> DataFrame:
    """Customers' large orders as subscriptions, folded to the heads of their nations' segments."""
    c = table(spark, d, "customer")
    heads = c.select(F.col("c_custkey").alias("entity"), F.concat_ws("/", "c_nationkey", "c_mktsegment").alias("head"))
    subs = table(spark, d, "orders").where("o_totalprice > 400000").select("o_custkey", F.col("o_orderkey").alias("confirmed"), F.col("o_orderpriority").alias("name"))
    return roster.roster(subs, heads, "o_custkey", "confirmed", "name").select("head", "o_custkey", "name", "confirmed", "times")


def active_queries(spark: SparkSession, d: str) -> DataFrame:
    """Parts that suppliers of active nations sell, with their last order if there is one."""
    lines = table(spark, d, "lineitem").select(F.col("l_partkey").alias("p_partkey"), F.col("l_suppkey").alias("s_suppkey"), "l_orderkey")
    suppliers = table(spark, d, "supplier").select("s_suppkey", (F.col("s_nationkey") % 5 == 0).alias("active"))
    context = lines.where("l_orderkey % 2 = 0").groupBy("p_partkey").agg(F.max("l_orderkey").alias("last_order"))
    return roster.active(table(spark, d, "part").select("p_partkey", "p_name"), lines.select("p_partkey", "s_suppkey"), suppliers, context, "p_partkey", "s_suppkey")


def liked_authors(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select((F.col("event_id") % 40).alias("author"), (F.col("user_id") % 40).alias("viewer"), "ts")
    return roster.by_author(e, "author", "viewer", "ts").select("author", "acts", F.unix_micros(F.col("first").cast("timestamp")).alias("first_us"), F.unix_micros(F.col("last").cast("timestamp")).alias("last_us"))


def paper_authors(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers as authors of orders, one line in nine without an id and the ORCID on even lines only."""
    a = F.struct(F.when(F.col("l_suppkey") % 9 > 0, F.col("l_suppkey").cast("string")).alias("id"), F.concat(F.lit("n"), F.col("l_linenumber")).alias("display_name"), F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("o"), "l_orderkey")).alias("orcid"))
    papers = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", a.alias("a")))).alias("x")).select("l_orderkey", F.transform("x", lambda v: v["a"]).alias("authors"))  # an order's lines
    return roster.paper_authors(papers, "l_orderkey", "authors")[0]


def collector_status(spark: SparkSession, d: str) -> DataFrame:
    got = roster.collectors(["click", "view", "signup", "never"], table(spark, d, "events").select("event_type", "ts", (F.col("value") >= 20).alias("ok")), "event_type", "ts", "ok")
    return got.select("event_type", "runs", F.unix_micros(F.col("worked").cast("timestamp")).alias("worked_us"), F.unix_micros(F.col("failed").cast("timestamp")).alias("failed_us"))


def signal_reasons(spark: SparkSession, d: str) -> DataFrame:
    """What one did about each customer, by their orders' priorities."""
    by = table(spark, d, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.count("*").alias("n"), F.bool_or(F.col("o_orderstatus") == "P").alias("paid"))
    kinds = F.create_map(*(F.lit(x) for x in ("1-URGENT", "follow", "2-HIGH", "subscribe", "3-MEDIUM", "list", "4-NOT SPECIFIED", "save", "5-LOW", "coauthor")))
    platform = F.when(F.col("o_custkey") % 3 == 0, "x").when(F.col("o_custkey") % 3 == 1, "papers").otherwise("blog")
    lists = F.when(F.col("o_custkey") % 2 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array().cast("array<string>"))
    return roster.reasons(by.select("o_custkey", kinds[F.col("o_orderpriority")].alias("signal"), platform.alias("platform"), "n", "paid", lists.alias("lists")), "o_custkey")


def arrivals_look(spark: SparkSession, d: str) -> DataFrame:
    """What came in the second half of the events' time, the newest five of every tag (a tenth has none)."""
    e = table(spark, d, "events").select("event_id", "ts", F.get_json_object("props", "$.k").cast("long").alias("tag"))
    half = e.agg((F.min("ts") + (F.max("ts") - F.min("ts")) / 2).alias("t")).first().t
    got = roster.look(e, e.where("event_id % 10 > 0"), "event_id", "tag", "ts", F.lit(half), 5)
    return got.select("tag", "event_id", "place", "finds", "older")


def order_milestones(spark: SparkSession, d: str) -> DataFrame:
    return roster.milestones(table(spark, d, "orders"), "o_custkey", {"ordered": F.lit(True), "urgent": F.col("o_orderpriority") == "1-URGENT", "closed": F.col("o_orderstatus") == "F", "large": F.col("o_totalprice") > 300000})


def mention_passages(spark: SparkSession, d: str) -> DataFrame:
    """Where documents have a name, and what stands around it."""
    docs = table(spark, d, "documents").select("doc_id", texts.passage("of the", F.col("text"), 40).alias("passage"))
    return docs.where("passage is not null")


def record_revisions(spark: SparkSession, d: str) -> DataFrame:
    """Revisions of events' properties without what changes by itself, and the map without a key."""
    m = F.map_concat(maps.decoded(F.col("props")), F.create_map(F.lit("seen"), F.col("event_id").cast("string"), F.lit("a"), F.col("event_type")))
    return table(spark, d, "events").select("event_id", maps.revision(m, ["seen"]).alias("revision"), F.array_join(F.array_sort(F.map_keys(maps.without(m, ["k"]))), ",").alias("others"))


def claimed_walks(spark: SparkSession, d: str) -> DataFrame:
    """What each author's walks may claim as seen."""
    w = table(spark, d, "events").select("event_id", (F.col("user_id") * 10).alias("started"), (F.col("value") >= 20).alias("finished"), (F.col("event_id") % 700).alias("cursor"))
    return curation.without_gap(w, "event_id", "started", "finished", "cursor")


def lenient_instants(spark: SparkSession, d: str) -> DataFrame:
    """Times in five spellings, one of them none."""
    k = F.col("event_id") % 5
    text = F.when(k == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(k == 1, F.date_format("ts", " yyyy-MM-dd ")).when(k == 2, F.concat(F.date_format("ts", "yyyy-MM-dd"), F.lit("T99:00"))).when(k == 3, F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+02:00"))).otherwise("soon")
    return table(spark, d, "events").select("event_id", F.unix_seconds(dates.instant(text)).alias("at_s"))


QUERIES = {
    f.__name__: f
    for f in (
        roster_listing, active_queries, liked_authors, paper_authors, collector_status, signal_reasons, arrivals_look, order_milestones, mention_passages, record_revisions, claimed_walks, lenient_instants,
    )
}

SQL = {
    "roster_listing": "WITH s AS (SELECT c_nationkey || '/' || c_mktsegment AS head, o_custkey, o_orderkey, o_orderpriority FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_totalprice > 400000) SELECT head, arg_min(o_custkey, o_orderkey) AS o_custkey, arg_min(o_orderpriority, o_orderkey) AS name, min(o_orderkey) AS confirmed, count(*) AS times FROM s GROUP BY 1",
    "active_queries": "SELECT p_partkey, p_name, last_order FROM part LEFT JOIN (SELECT l_partkey, max(l_orderkey) AS last_order FROM lineitem WHERE l_orderkey % 2 = 0 GROUP BY 1) ON l_partkey = p_partkey WHERE p_partkey IN (SELECT l_partkey FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE s_nationkey % 5 = 0)",
    "liked_authors": "SELECT event_id % 40 AS author, count(*) AS acts, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us FROM events WHERE event_id % 40 <> user_id % 40 GROUP BY 1",
    "paper_authors": "SELECT l_suppkey::VARCHAR AS id, 'n' || arg_min(l_linenumber, ROW(l_orderkey, l_linenumber)) AS name, 'o' || min(l_orderkey) FILTER (WHERE l_linenumber % 2 = 0) AS orcid, count(DISTINCT l_orderkey) AS papers FROM lineitem WHERE l_suppkey % 9 > 0 GROUP BY l_suppkey",
    "collector_status": "SELECT n AS event_type, coalesce(runs, 0) AS runs, epoch_us(w) AS worked_us, CASE WHEN w IS NULL OR f > w THEN epoch_us(f) END AS failed_us FROM (VALUES ('click'), ('view'), ('signup'), ('never')) v(n) LEFT JOIN (SELECT event_type, count(*) AS runs, max(ts) FILTER (WHERE value >= 20) AS w, max(ts) FILTER (WHERE NOT value >= 20) AS f FROM events GROUP BY 1) ON n = event_type",
    "signal_reasons": "WITH b AS (SELECT o_custkey AS c, o_orderpriority AS p, count(*) AS n, bool_or(o_orderstatus = 'P') AS paid FROM orders GROUP BY 1, 2), t AS (SELECT c, p, CASE p WHEN '1-URGENT' THEN 'you follow' WHEN '2-HIGH' THEN CASE WHEN paid THEN 'paid subscriber' ELSE 'you subscribe' END "
    "WHEN '3-MEDIUM' THEN CASE WHEN c % 2 = 0 THEN 'in your a, b lists' ELSE 'in ' || n || ' of your lists' END WHEN '4-NOT SPECIFIED' THEN CASE c % 3 WHEN 0 THEN 'bookmarked ' || n WHEN 1 THEN 'saved ' || n || CASE WHEN n = 1 THEN ' paper' ELSE ' papers' END ELSE 'saved ' || n || CASE WHEN n = 1 THEN ' post' ELSE ' posts' END END "
    "ELSE 'co-wrote ' || n || CASE WHEN n = 1 THEN ' paper' ELSE ' papers' END || ' with one of your Oracles' END AS x FROM b) SELECT c AS o_custkey, string_agg(x, ', ' ORDER BY p) AS reason FROM t GROUP BY 1",
    "arrivals_look": "WITH e AS (SELECT event_id, ts, CASE WHEN event_id % 10 > 0 THEN CAST(regexp_extract(props, '\"k\": *([0-9]+)', 1) AS BIGINT) END AS tag, ts >= (SELECT min(ts) + (max(ts) - min(ts)) / 2 FROM events) AS new FROM events), n AS (SELECT *, row_number() OVER (PARTITION BY tag ORDER BY ts DESC, event_id) AS place FROM e WHERE new), s AS (SELECT tag, count(*) FILTER (WHERE new) AS finds, count(*) FILTER (WHERE NOT new) AS older FROM e GROUP BY 1) SELECT n.tag, event_id, place, finds, older FROM n JOIN s ON n.tag IS NOT DISTINCT FROM s.tag WHERE place <= 5",
    "order_milestones": "SELECT *, CASE WHEN NOT urgent THEN 'urgent' WHEN NOT closed THEN 'closed' WHEN NOT large THEN 'large' END AS next FROM (SELECT o_custkey, true AS ordered, bool_or(o_orderpriority = '1-URGENT') AS urgent, bool_or(o_orderstatus = 'F') AS closed, bool_or(o_totalprice > 300000) AS large FROM orders GROUP BY 1)",
    "mention_passages": "WITH p AS (SELECT doc_id, regexp_extract(text, '(?is)^(.*?)\\bof[^a-zA-Z0-9]+thes?\\b', 1) AS b, regexp_extract(text, '(?is)\\b(of[^a-zA-Z0-9]+thes?)\\b', 1) AS o, text FROM documents WHERE regexp_matches(text, '(?is)\\bof[^a-zA-Z0-9]+thes?\\b')), a AS (SELECT *, substr(text, length(b) + length(o) + 1) AS a FROM p), "
    "c AS (SELECT *, CASE WHEN length(b) > 40 THEN right(b, 40) ELSE b END AS h, left(a, 40) AS t FROM a), d AS (SELECT *, CASE WHEN length(b) > 40 AND contains(h, ' ') THEN regexp_replace(h, '^[^ ]* ', '') ELSE h END AS l, CASE WHEN length(a) > 40 AND contains(t, ' ') THEN regexp_replace(t, ' [^ ]*$', '') ELSE t END AS r FROM c) "
    "SELECT doc_id, CASE WHEN length(b) > 40 THEN '…' ELSE '' END || trim(regexp_replace(l || o || r, '\\s+', ' ', 'g')) || CASE WHEN length(a) > 40 THEN '…' ELSE '' END AS passage FROM d",
    "record_revisions": "SELECT event_id, sha256('{\"a\":\"' || event_type || '\",\"k\":\"' || regexp_extract(props, '\"k\": *([0-9]+)', 1) || '\"}') AS revision, 'a,seen' AS others FROM events",
    "claimed_walks": "SELECT event_id, CASE WHEN value >= 20 THEN greatest(user_id * 10, event_id % 700) ELSE event_id % 700 END AS claimed FROM events",
    "lenient_instants": "SELECT event_id, CASE event_id % 5 WHEN 0 THEN CAST(floor(epoch(ts)) AS BIGINT) WHEN 3 THEN CAST(floor(epoch(ts)) AS BIGINT) - 7200 WHEN 4 THEN NULL ELSE CAST(epoch(date_trunc('day', ts)) AS BIGINT) END AS at_s FROM events",
}
