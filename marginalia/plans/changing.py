"""Queries over texts, addresses, dates, maps and state that changes, and the same in SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from marginalia.functions import dates, maps, texts, urls
from marginalia.operators import curation, search
from marginalia.storage import shared_folder, table
from marginalia.streaming import events as streams

_K = "CAST(regexp_extract(props, '\"k\": *([0-9]+)', 1) AS BIGINT)"


def query_ids(spark: SparkSession, d: str) -> DataFrame:
    name = F.col("p_name")
    return table(spark, d, "part").select("p_partkey", texts.identity(name).alias("normal"), texts.query_id(name).alias("query_id"), F.array_join(texts.slugs(F.array(name, F.col("p_brand"), name)), " ").alias("slugs"))


def fetch_verdicts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy(texts.verdict(F.col("text")).alias("verdict"), "source").agg(F.count("*").alias("n"))


def snippets(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select("item_id", texts.snippet(F.col("text"), 60).alias("snippet"))


def named_items(spark: SparkSession, d: str) -> DataFrame:
    """Documents that have the name's words side by side, plurals alike."""
    return table(spark, d, "documents").where(texts.names(F.lit("Of Thing"), F.col("text"))).select("doc_id")


def excerpts(spark: SparkSession, d: str) -> DataFrame:
    """Where the window of 1,600 characters with most of the word begins, and its text's hash."""
    docs = table(spark, d, "documents")
    starts = search.densest_windows(docs, "(?i)\\bthe\\b", texts.WIDTH, texts.LEAD)
    part = F.substring("text", F.col("start").cast("int") + 1, F.lit(texts.WIDTH))
    return docs.join(starts, "doc_id").select("doc_id", "start", F.sha2(part, 256).alias("excerpt_sha256"))


def provenance(spark: SparkSession, d: str) -> DataFrame:
    """Who ordered a part's kind, as a clause that spells out three names at most."""
    seg = table(spark, d, "customer").groupBy("c_nationkey").agg(F.array_sort(F.collect_set("c_mktsegment")).alias("s"))
    return seg.select("c_nationkey", texts.listed(F.col("s")).alias("clause"))


def link_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Links of pages by kind and host; kind is null for plain ones."""
    found = F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit('href="(https?://[^"]+)"'), F.lit(1))))
    links = table(spark, d, "pages").select("page_id", found.alias("link")).unionByName(table(spark, d, "pages").select("page_id", F.col("url").alias("link")))
    return links.groupBy(urls.link_kind(F.col("link")).alias("kind"), urls.host(F.col("link")).alias("host"), urls.site_label(urls.host(F.col("link"))).alias("label")).agg(F.count("*").alias("n"))


def post_ids(spark: SparkSession, d: str) -> DataFrame:
    """The least time-ordered post id of each event's instant, and the instant back from it."""
    at = F.col("ts").cast("timestamp")
    return table(spark, d, "events").select("event_id", dates.first_post_id(at).alias("post_id"), F.unix_millis(dates.post_instant(dates.first_post_id(at))).alias("ms"))


def jitters(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", F.round(24 * dates.spread(F.col("c_name"), 4, 1 << 16, 0.1), 6).alias("ttl_hours"))


def newness(spark: SparkSession, d: str) -> DataFrame:
    """Customers by whether their first order lies within a week before their last one."""
    o = table(spark, d, "orders").groupBy("o_custkey").agg(F.min("o_orderdate").alias("published"), F.max("o_orderdate").alias("arrived"))
    return o.select("o_custkey", dates.is_new(F.to_date("published"), F.to_date("arrived")).alias("is_new"))


def json_merge_patch(spark: SparkSession, d: str) -> DataFrame:
    """Each author's oldest properties patched by the newest ones, with a note and an id that the patch deletes."""
    ends = table(spark, d, "events").groupBy("user_id").agg(F.min_by("props", F.struct("ts", "event_id")).alias("a"), F.max_by("props", F.struct("ts", "event_id")).alias("b"))
    old = F.map_concat(F.map_filter(maps.decoded(F.col("a")), lambda k, _: k == "k"), F.create_map(F.lit("gone"), F.lit("1"), F.lit("note"), F.lit("kept")))
    new = F.map_concat(F.map_filter(maps.decoded(F.col("b")), lambda k, _: k == "k"), F.create_map(F.lit("gone"), F.lit(None).cast("string")))
    m = maps.patched(old, new)
    return ends.select("user_id", m["k"].cast("long").alias("k"), m["note"].alias("note"), F.array_join(F.array_sort(F.map_keys(m)), ",").alias("keys"))


def dropped_keys(spark: SparkSession, d: str) -> DataFrame:
    """What an export's allow-list (none of these keys) drops, by key."""
    found = maps.decoded(F.col("props"))
    lost = F.explode(F.array_except(F.map_keys(found), F.map_keys(maps.allowed(found, ["name"]))))
    return table(spark, d, "events").select(lost.alias("key")).groupBy("key").agg(F.count("*").alias("dropped"))


def staging_newness(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    half = e.agg(F.floor((F.min("event_id") + F.max("event_id")) / 2)).first()[0] or 0  # one number: what was known before
    return curation.staged(e.where(F.col("event_id") <= half), e.where(F.col("event_id") > half), "user_id", "ts")


def widen_only(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("who"), F.to_date("o_orderdate").alias("covered"), "o_orderstatus")
    side = lambda s: o.where(F.col("o_orderstatus") == s).groupBy("who").agg(F.min("covered").alias("covered"))
    return curation.widened(side("F"), side("O"), "who", "covered")


def rate_budget(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "lineitem").select("l_suppkey", F.to_date("l_shipdate").alias("reset"), F.col("l_quantity").alias("remaining"))
    return curation.stricter(r, "l_suppkey", "reset", "remaining")


def unearned_references(spark: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    rows = table(spark, d, "events").select((k * 1000 + F.col("user_id") % 50).alias("url"), "event_type")
    return curation.unearned(rows, "url", F.col("event_type").isin("purchase"))


def discovery_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Each customer's supplier by the strongest reason: same nation and a returned line, same nation, a returned line."""
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_returnflag")
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    rows = lines.join(o.join(c, "o_custkey"), "l_orderkey").join(s, "l_suppkey")
    same, back = F.col("s_nationkey") == F.col("c_nationkey"), F.col("l_returnflag") == "R"
    return curation.verdicts(rows, "o_custkey", "l_suppkey", [("both", same & back), ("home", same), ("returned", back)])


def _closed(spark: SparkSession, frame: DataFrame) -> DataFrame:
    """What a stream appends from the files that are there now, through a table in the shared folder."""
    out = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    query = frame.writeStream.format("parquet").option("checkpointLocation", f"{out}-state").outputMode("append").trigger(availableNow=True).start(out)
    query.awaitTermination()
    return spark.read.schema(frame.schema).parquet(out)


def stream_tumbling(spark: SparkSession, d: str) -> DataFrame:
    """Hourly counts by kind of the windows that the watermark closed, by Structured Streaming."""
    return _closed(spark, streams.by_window(streams.read(spark, f"{d.rstrip('/')}/events.parquet"))).select(F.unix_seconds("start").alias("start_s"), "event_type", "n", F.round("total", 3).alias("total"))


def stream_sliding(spark: SparkSession, d: str) -> DataFrame:
    """Counts by kind of hours that begin every half hour, of the windows that the watermark closed."""
    return _closed(spark, streams.by_sliding_window(streams.read(spark, f"{d.rstrip('/')}/events.parquet"))).select(F.unix_seconds("start").alias("start_s"), "event_type", "n")


def stream_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Sessions of each author that the watermark closed."""
    return _closed(spark, streams.sessions(streams.read(spark, f"{d.rstrip('/')}/events.parquet"))).select(F.unix_micros("start").alias("start_us"), "user_id", "n")


QUERIES = {
    f.__name__: f
    for f in (
        query_ids, fetch_verdicts, snippets, named_items, excerpts, provenance, link_kinds, post_ids, jitters, newness, json_merge_patch, dropped_keys, staging_newness, widen_only,
        rate_budget, unearned_references, discovery_verdicts, stream_tumbling, stream_sliding, stream_sessions,
    )
}

_SLUG = "trim(regexp_replace(lower({}), '[^a-z0-9]+', '-', 'g'), '-')"
_NORMAL = "regexp_replace(trim(lower(p_name)), '\\s+', ' ', 'g')"
_HELD = f"regexp_matches(lower(t), '{'|'.join(texts.CHALLENGES)}')"
_NAMES = "' ' || array_to_string(list_transform(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda w: CASE WHEN length(w) > 3 AND w LIKE '%s' THEN w[:-2] ELSE w END), ' ') || ' '"
_HOST = "regexp_replace(regexp_extract(lower(link), '^(?:[a-z][a-z0-9+.-]*://)?(?:[^/?#@]*@)?([^/?#:]+)', 1), '^www\\.', '')"
_PAPER = " OR ".join(f"host = '{h}' OR host LIKE '%.{h}'" for h in urls.PAPER_HOSTS)
_SECOND = ", ".join(f"'{x}'" for x in urls.SECOND_LEVEL)

SQL = {
    "query_ids": f"SELECT p_partkey, {_NORMAL} AS normal, substr(sha256({_NORMAL}), 1, 16) AS query_id, CASE WHEN {_SLUG.format('p_name')} = {_SLUG.format('p_brand')} THEN {_SLUG.format('p_name')} ELSE {_SLUG.format('p_name')} || ' ' || {_SLUG.format('p_brand')} END AS slugs FROM part",
    "fetch_verdicts": f"SELECT CASE WHEN length(t) > 0 AND length(t) < 600 AND {_HELD} THEN 'undetermined' WHEN length(t) < 200 THEN 'absent' ELSE 'ok' END AS verdict, source, count(*) AS n FROM (SELECT source, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS t FROM documents) GROUP BY 1, 2",
    "snippets": "WITH t AS (SELECT item_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM benchmark) SELECT item_id, CASE WHEN length(t) <= 60 THEN t ELSE rtrim(regexp_extract(substr(t, 1, 60), '^(.+) [^ ]*$', 1)) || '…' END AS snippet FROM t",
    "named_items": f"SELECT doc_id FROM documents WHERE contains({_NAMES}, ' of thing ')",
    "excerpts": "WITH p AS (SELECT doc_id, text, length(text) AS n, list_transform(string_split(regexp_replace(text, '(?i)(\\bthe\\b)', chr(1) || '\\1', 'g'), chr(1)), lambda x: length(x)) AS l FROM documents), "
    "a AS (SELECT doc_id, n, l, unnest(range(1, len(l))) AS i FROM p), m AS (SELECT doc_id, n, CAST(list_sum(l[1:i]) AS BIGINT) AS place FROM a), w AS (SELECT doc_id, greatest(0, least(place - 100, n - 1600)) AS low FROM m), "
    "c AS (SELECT w.doc_id, w.low, count(*) AS held FROM (SELECT DISTINCT doc_id, low FROM w) w JOIN m ON m.doc_id = w.doc_id AND m.place >= w.low AND m.place < w.low + 1600 GROUP BY 1, 2), "
    "b AS (SELECT doc_id, low FROM c QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY held DESC, low) = 1) "
    "SELECT p.doc_id, coalesce(low, 0) AS start, sha256(substr(text, CAST(coalesce(low, 0) AS INT) + 1, 1600)) AS excerpt_sha256 FROM p LEFT JOIN b ON p.doc_id = b.doc_id",
    "provenance": "WITH s AS (SELECT c_nationkey, list_sort(list(DISTINCT c_mktsegment)) AS s FROM customer GROUP BY 1), u AS (SELECT c_nationkey, CASE WHEN len(s) > 3 THEN list_append(s[:3], (len(s) - 3) || CASE WHEN len(s) > 4 THEN ' others' ELSE ' other' END) ELSE s END AS u FROM s) SELECT c_nationkey, CASE WHEN len(u) = 1 THEN u[1] ELSE array_to_string(u[:len(u) - 1], ', ') || ' and ' || u[len(u)] END AS clause FROM u",
    "link_kinds": f"WITH l AS (SELECT page_id, unnest(list_distinct(regexp_extract_all(html, 'href=\"(https?://[^\"]+)\"', 1))) AS link FROM pages UNION ALL SELECT page_id, url FROM pages), h AS (SELECT link, {_HOST} AS host FROM l), p AS (SELECT *, list_filter(string_split(host, '.'), lambda x: x <> '') AS p FROM h) SELECT CASE WHEN host = 'github.com' OR host LIKE '%.github.com' THEN 'github' WHEN host = 'substack.com' OR host LIKE '%.substack.com' THEN 'substack' WHEN {_PAPER} OR lower(string_split(link, '?')[1]) LIKE '%.pdf' OR regexp_matches(link, '/10\\.\\d{{4,9}}/\\S') THEN 'paper' END AS kind, host, CASE WHEN len(p) < 2 THEN p[1] WHEN len(p) >= 3 AND p[len(p) - 1] IN ({_SECOND}) THEN p[len(p) - 2] ELSE p[len(p) - 1] END AS label, count(*) AS n FROM p GROUP BY ALL",
    "post_ids": f"SELECT event_id, (epoch_us(ts) // 1000 - {dates.POST_EPOCH_MS}) * 4194304 AS post_id, epoch_us(ts) // 1000 AS ms FROM events",
    "jitters": "SELECT c_custkey, round(24 * (1.0::DOUBLE + 0.1::DOUBLE * (2.0::DOUBLE * (CAST('0x' || substr(sha256(c_name), 1, 4) AS BIGINT) / 65535.0::DOUBLE) - 1.0)), 6) AS ttl_hours FROM customer",
    "newness": "SELECT o_custkey, CAST(min(o_orderdate) AS DATE) >= CAST(max(o_orderdate) AS DATE) - 7 AS is_new FROM orders GROUP BY 1",
    "json_merge_patch": f"SELECT user_id, coalesce(arg_max({_K}, struct_pack(ts, event_id)), arg_min({_K}, struct_pack(ts, event_id))) AS k, 'kept' AS note, 'k,note' AS keys FROM events GROUP BY 1",
    "dropped_keys": "SELECT key, count(*) AS dropped FROM (SELECT unnest(json_keys(props)) AS key FROM events) WHERE key <> 'name' GROUP BY 1",
    "staging_newness": "WITH h AS (SELECT (min(event_id) + max(event_id)) // 2 AS h FROM events) SELECT user_id, min(ts) AS first_seen, max(ts) AS last_seen, count(*) AS times, user_id NOT IN (SELECT user_id FROM events, h WHERE event_id <= h) AS is_new FROM events, h WHERE event_id > h GROUP BY 1",
    "widen_only": "SELECT o_custkey AS who, CAST(min(o_orderdate) AS DATE) AS covered FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY 1",
    "rate_budget": "SELECT l_suppkey, reset, min(l_quantity) AS remaining FROM (SELECT l_suppkey, l_quantity, CAST(l_shipdate AS DATE) AS reset FROM lineitem QUALIFY reset = max(CAST(l_shipdate AS DATE)) OVER (PARTITION BY l_suppkey)) GROUP BY 1, 2",
    "unearned_references": f"SELECT {_K} * 1000 + user_id % 50 AS url, count(*) AS referrers FROM events GROUP BY 1 HAVING count(*) FILTER (WHERE event_type = 'purchase') = 0",
    "discovery_verdicts": "WITH r AS (SELECT o_custkey, l_suppkey, CASE WHEN s_nationkey = c_nationkey AND l_returnflag = 'R' THEN 0 WHEN s_nationkey = c_nationkey THEN 1 WHEN l_returnflag = 'R' THEN 2 END AS rung FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey) SELECT o_custkey, l_suppkey, (['both', 'home', 'returned'])[rung + 1] AS verdict FROM r WHERE rung IS NOT NULL QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY rung, l_suppkey) = 1",
    "stream_tumbling": "SELECT CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS start_s, event_type, count(*) AS n, round(sum(value), 3) AS total FROM events GROUP BY date_trunc('hour', ts), event_type HAVING date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE",
    "stream_sliding": "WITH w AS (SELECT event_type, time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE * k AS start FROM events, (SELECT unnest([0, 1]) AS k)) SELECT CAST(epoch(start) AS BIGINT) AS start_s, event_type, count(*) AS n FROM w GROUP BY start, event_type HAVING start + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE",
    "stream_sessions": "WITH g AS (SELECT user_id, ts, CAST(coalesce(ts - lag(ts) OVER w >= INTERVAL 30 MINUTE, true) AS INT) AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g) SELECT epoch_us(min(ts)) AS start_us, user_id, count(*) AS n FROM s GROUP BY user_id, s HAVING max(ts) + INTERVAL 30 MINUTE <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE",
}
