"""All registered queries of the library, apart from the optional ones, and the same in SQL.

Events stand for items of a corpus (event_type its source, user_id its author, ts its clock), documents for
bodies (source the author, lang the kind), orders for acts of a curator, customers and nations for identities.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from marginalia.functions import urls
from marginalia.operators import curation, filters, sampling, search, snapshots
from marginalia.plans import arriving, changing, keeping, listing, naming, reading, searching, state
from marginalia.storage import parts, table

QUERY = "the thing"
_ONE_K = "CAST(regexp_extract(props, '\"k\": *([0-9]+)', 1) AS BIGINT)"
_TOK = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')"


def state_of_play(spark: SparkSession, d: str) -> DataFrame:
    """Total, by kind and by author in one scan, as grouping sets."""
    rows = table(spark, d, "events").select("ts", F.col("event_type").alias("kind"), F.col("user_id").alias("author"))
    kind, author = F.col("kind"), F.col("author")
    return rows.groupingSets([[], [kind], [author]], kind, author).agg(F.count("*").alias("n"), F.min("ts").alias("oldest"), F.max("ts").alias("newest"))


def top_authors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.countDistinct("event_type").alias("kinds")).orderBy(F.desc("n"), "user_id").limit(15)


def _event_filters() -> dict:
    return {"kind": filters.any_in("event_type", ["click", "view"]), "author": F.col("user_id") % 2 == 0, "value": F.col("value") > 10, "unused": None}


def filter_costs(spark: SparkSession, d: str) -> DataFrame:
    return filters.costs(table(spark, d, "events"), _event_filters())


def date_span(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("event_type").agg(F.min("ts").alias("oldest"), F.max("ts").alias("newest"), F.count_if(F.col("ts").isNull()).alias("undated"))


def census_sample(spark: SparkSession, d: str) -> DataFrame:
    rows = sampling.round_robin(table(spark, d, "events"), "user_id", F.col("ts"), "event_id", 500)
    return rows.select("event_id", "user_id", F.col("turn").cast("long").alias("turn"), "of_group")


def feed_page(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events")
    middle = (F.col("low") + (F.col("high") - F.col("low")) / 2).alias("t")
    mid = events.agg(F.min("ts").alias("low"), F.max("ts").alias("high")).select(middle).first()["t"]
    return sampling.page_after(events, "ts", "event_id", mid, -1, 100).select("event_id", "ts", "event_type")


def fair_share(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("event_type").orderBy(F.desc("value"), "event_id")
    return table(spark, d, "events").withColumn("turn", F.row_number().over(w)).where("turn <= 40").orderBy("turn", "event_type").limit(40).select("event_id", "event_type", F.col("turn").cast("long").alias("turn"))


def bm25_search(spark: SparkSession, d: str) -> DataFrame:
    return search.bm25(table(spark, d, "documents"), QUERY, 50, F.col("lang") == "en")


def phrase_count(spark: SparkSession, d: str) -> DataFrame:
    return search.phrase_matches(table(spark, d, "documents"), "of the").groupBy("source").agg(F.count("*").alias("n"))


def account_search(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    hits = search.bm25(docs, QUERY, 200)
    return search.reciprocal_ranks(docs.join(F.broadcast(hits), "doc_id"), "source")  # 200 hits at most


def rank_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Per identity: distinct kinds of acts, their number, whether one endorses; those who only ever gave urgent acts are left out."""
    acts = table(spark, d, "orders").groupBy("o_custkey").agg(
        F.countDistinct("o_orderpriority").alias("kinds"), F.count("*").alias("acts"), F.max((F.col("o_orderpriority") == "1-URGENT").cast("int")).alias("endorsed"),
        F.bool_and(F.col("o_orderstatus") == "F").alias("retired"),
    )
    who = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name", "c_nationkey")
    return acts.where(~F.col("retired")).join(who, "o_custkey", "left").drop("retired")


def stronger_source(spark: SparkSession, d: str) -> DataFrame:
    by = table(spark, d, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.count("*").alias("n"))
    w = Window.partitionBy("o_custkey").orderBy(F.desc("n"), "o_orderpriority")
    return by.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")


def coauthors(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of suppliers that share at least two orders: a self-join on the order, whose lines are few."""
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey")
    n = parts(lines.count())  # from the files' footers
    lines = lines.repartition(n, "l_orderkey").distinct()
    a, b = lines.withColumnRenamed("l_suppkey", "a"), lines.withColumnRenamed("l_suppkey", "b")
    pairs = a.join(b, "l_orderkey").where("a < b").select("a", "b").repartition(2 * n, "a", "b")  # some two pairs to a line
    return pairs.groupBy("a", "b").agg(F.count("*").alias("shared")).where("shared >= 2")


def mention_credit(spark: SparkSession, d: str) -> DataFrame:
    """Credit of suppliers whom orders name: an order is its customer's post and names as its lines' flags say."""
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey", F.when(F.col("l_returnflag") == "A", "quote").when(F.col("l_returnflag") == "R", "link").otherwise("aside").alias("kind"))
    posts = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    n = parts(lines.count())  # from the files' footers
    mentions = lines.repartition(n, "l_orderkey").join(posts.repartition(n, "l_orderkey"), "l_orderkey")
    return curation.credited(mentions, "l_orderkey", "l_suppkey", "o_custkey", "kind", 1 / (1 + F.pmod("l_orderkey", F.lit(5)).cast("double")), n)


def arrivals(spark: SparkSession, d: str) -> DataFrame:
    """What came in the last seven days of the clock, by kind and day, and how much of it is older."""
    ev = table(spark, d, "events")
    last = ev.agg(F.max("ts").alias("last"))
    fresh = ev.crossJoin(F.broadcast(last)).withColumn("new", F.col("ts") >= F.col("last") - F.expr("INTERVAL 7 DAYS"))  # one row
    return fresh.groupBy("event_type").agg(F.count_if("new").alias("new"), F.count_if(~F.col("new")).alias("older"))


def snapshot_digest(spark: SparkSession, d: str) -> DataFrame:
    return snapshots.digest(table(spark, d, "customer"), ["c_custkey", "c_name", "c_mktsegment"])


def snapshot_changes(spark: SparkSession, d: str) -> DataFrame:
    """Customers as they were (no one in BUILDING) against customers as they are (no one in MACHINERY)."""
    c = table(spark, d, "customer")
    return snapshots.changes(c.where("c_mktsegment <> 'BUILDING'"), c.where("c_mktsegment <> 'MACHINERY'"), "c_custkey", ["c_name", "c_mktsegment"])


def latest_upsert(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_custkey", "o_orderstatus", "o_orderpriority", "o_orderkey")
    first = o.groupBy("o_custkey").agg(F.min_by(F.struct("o_orderstatus", "o_orderpriority"), "o_orderkey").alias("s")).select("o_custkey", "s.*", F.lit(1).alias("version"))
    return snapshots.upsert(first, o, "o_custkey", ["o_orderstatus", "o_orderpriority"], "o_orderkey")


def page_addresses(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("url")
    return table(spark, d, "pages").select("page_id", urls.host(u).alias("host"), urls.post_key(u).alias("post_key"))


def page_heads(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.regexp_count("html", F.lit("<a href=")).cast("long").alias("links"))


def topic_tags(spark: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, d, "events").groupBy(k.alias("tag")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tag").limit(6)


def threads(spark: SparkSession, d: str) -> DataFrame:
    """Each conversation stitched in turn order."""
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    return table(spark, d, "conversations").groupBy("conv_id").agg(turns.alias("t")).select("conv_id", F.size("t").cast("long").alias("turns"), F.array_join(F.transform("t", lambda x: F.concat(x["role"], F.lit(": "), x["text"])), "\n").alias("body"))


def usage_daily(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("readers"))


def nearest_rank(spark: SparkSession, d: str) -> DataFrame:
    """Nearest-rank percentiles of values by kind: the ceil(p * n)-th smallest."""
    return sampling.nearest_ranks(table(spark, d, "events"), "event_type", "value", {"p50": 0.5, "p95": 0.95, "top": 1.0})


def people_terms(spark: SparkSession, d: str) -> DataFrame:
    """Weights (1 + ln tf) * ln(n / df) of words that at least five authors and not over three in ten documents' authors use."""
    words = table(spark, d, "documents").select("doc_id", F.explode(search.tokens(F.col("text"))).alias("word"))
    tf = words.groupBy("doc_id", "word").agg(F.count("*").alias("tf"))
    df = tf.groupBy("word").agg(F.count("*").alias("df"), F.sum(1 + F.log("tf")).alias("mass"))
    n = table(spark, d, "documents").agg(F.count("*").alias("n"))
    return df.crossJoin(F.broadcast(n)).where("df >= 5 and df <= 0.3 * n").select("word", "df", F.round(F.col("mass") * F.log(F.col("n") / F.col("df")), 4).alias("weight"))  # n: one row


def unseen(spark: SparkSession, d: str) -> DataFrame:
    """Customers that the ledger of orders doesn't have yet."""
    return table(spark, d, "customer").join(table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")


def collapse_guard(spark: SparkSession, d: str) -> DataFrame:
    """Days whose count fell under half of the day before."""
    day = table(spark, d, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("found"))
    return day.withColumn("before", F.lag("found").over(Window.orderBy("day"))).withColumn("collapsed", F.coalesce(F.col("found") < 0.5 * F.col("before"), F.lit(False)))


_ALL = (
    state_of_play, top_authors, filter_costs, date_span, census_sample, feed_page, fair_share, bm25_search, phrase_count, account_search, rank_candidates, stronger_source, coauthors,
    mention_credit, arrivals, snapshot_digest, snapshot_changes, latest_upsert, page_addresses, page_heads, topic_tags, threads, usage_daily, nearest_rank, people_terms, unseen, collapse_guard,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _ALL} | reading.QUERIES | changing.QUERIES | state.QUERIES | searching.QUERIES | naming.QUERIES | arriving.QUERIES | keeping.QUERIES | listing.QUERIES


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25_search(spark, sf_dir)


def _bm25_sql(k: int, where: str) -> str:
    words = search.query_words(QUERY)
    tfs = ", ".join(f"len(list_filter(t, lambda x: x = '{w}')) AS tf{i}" for i, w in enumerate(words))
    dfs = ", ".join(f"count(*) FILTER (WHERE tf{i} > 0) AS df{i}" for i in range(len(words)))
    score = " + ".join(f"ln(1 + (n - df{i} + 0.5) / (df{i} + 0.5)) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * dl / av))" for i in range(len(words)))
    return (
        f"WITH t AS (SELECT doc_id, source, lang, {_TOK} AS t FROM documents), c AS (SELECT doc_id, source, lang, len(t) AS dl, {tfs} FROM t), s AS (SELECT count(*) AS n, avg(dl) AS av, {dfs} FROM c), "
        f"h AS (SELECT doc_id, source, round({score}, 6) AS score FROM c, s WHERE {where}), r AS (SELECT doc_id, source, score, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM h WHERE score > 0) SELECT * FROM r WHERE rank <= {k}"
    )


def oracle_sql() -> dict[str, str]:
    sha = "sha256(concat_ws('|', length(c_custkey::VARCHAR) || ':' || c_custkey, length(c_name) || ':' || c_name, length(c_mktsegment) || ':' || c_mktsegment))"
    limbs = ", ".join(f"CAST(sum(CAST('0x' || substr(h, {8 * i + 1}, 8) AS BIGINT)) AS BIGINT) AS limb{i}" for i in range(8))
    host = "regexp_replace(regexp_extract(lower(url), '^(?:[a-z][a-z0-9+.-]*://)?(?:[^/?#@]*@)?([^/?#:]+)', 1), '^www\\.', '')"
    cond = {"kind": "event_type IN ('click','view')", "author": "user_id % 2 = 0", "value": "value > 10"}
    every = " AND ".join(cond.values())
    costs = " UNION ALL ".join(
        f"SELECT '{n}' AS filter, count(*) FILTER (WHERE {every}) AS matched, count(*) FILTER (WHERE {' AND '.join(c for m, c in cond.items() if m != n)}) AS without FROM events" for n in cond
    )
    return {
        "state_of_play": "SELECT event_type AS kind, user_id AS author, count(*) AS n, min(ts) AS oldest, max(ts) AS newest FROM events GROUP BY GROUPING SETS ((), (event_type), (user_id))",
        "top_authors": "SELECT user_id, count(*) AS n, count(DISTINCT event_type) AS kinds FROM events GROUP BY 1 ORDER BY n DESC, user_id LIMIT 15",
        "filter_costs": costs,
        "date_span": "SELECT event_type, min(ts) AS oldest, max(ts) AS newest, count(*) FILTER (WHERE ts IS NULL) AS undated FROM events GROUP BY 1",
        "census_sample": "SELECT event_id, user_id, turn, of_group FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS turn, count(*) OVER (PARTITION BY user_id) AS of_group FROM events) ORDER BY turn, of_group DESC, user_id, event_id LIMIT 500",
        "feed_page": "SELECT event_id, ts, event_type FROM events WHERE ts >= (SELECT min(ts) + (max(ts) - min(ts)) / 2 FROM events) ORDER BY ts, event_id LIMIT 101",
        "fair_share": "SELECT event_id, event_type, turn FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS turn FROM events) ORDER BY turn, event_type LIMIT 40",
        "bm25_search": f"SELECT doc_id, CAST(rank AS INT) AS rank, score FROM ({_bm25_sql(50, chr(39).join(['lang = ', 'en', '']))})",
        "phrase_count": f"SELECT source, count(*) AS n FROM documents WHERE contains(' ' || array_to_string({_TOK}, ' ') || ' ', ' of the ') GROUP BY 1",
        "account_search": f"SELECT source, round_even(sum(1 / (60 + rank)), 5) AS score, count(*) AS hits FROM ({_bm25_sql(200, 'true')}) GROUP BY 1",
        "rank_candidates": "SELECT o_custkey, kinds, acts, endorsed, c_name, c_nationkey FROM (SELECT o_custkey, count(DISTINCT o_orderpriority) AS kinds, count(*) AS acts, max(CAST(o_orderpriority = '1-URGENT' AS INT)) AS endorsed, bool_and(o_orderstatus = 'F') AS retired FROM orders GROUP BY 1) LEFT JOIN customer ON o_custkey = c_custkey WHERE NOT retired",
        "stronger_source": "SELECT o_custkey, o_orderpriority, n FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, o_orderpriority) AS r FROM (SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2)) WHERE r = 1",
        "coauthors": "WITH l AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) SELECT a.l_suppkey AS a, b.l_suppkey AS b, count(*) AS shared FROM l a JOIN l b USING (l_orderkey) WHERE a.l_suppkey < b.l_suppkey GROUP BY 1, 2 HAVING count(*) >= 2",
        "mention_credit": "WITH o AS (SELECT l_orderkey, l_suppkey, o_custkey, max(CASE l_returnflag WHEN 'A' THEN 1.0::DOUBLE WHEN 'R' THEN 0.75::DOUBLE ELSE 0.5::DOUBLE END) AS w FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2, 3), s AS (SELECT *, CAST(1 / (1 + l_orderkey % 5)::DOUBLE * w / count(*) OVER (PARTITION BY l_orderkey) AS DECIMAL(26,12)) AS c FROM o) SELECT l_suppkey, count(DISTINCT l_orderkey) AS posts, count(DISTINCT o_custkey) AS curators, round_even(CAST(sum(c) AS DOUBLE) * (1 + 0.25::DOUBLE * (count(DISTINCT o_custkey) - 1)), 4) AS score FROM s GROUP BY 1",
        "arrivals": "SELECT event_type, count(*) FILTER (WHERE ts >= last - INTERVAL 7 DAY) AS new, count(*) FILTER (WHERE ts < last - INTERVAL 7 DAY) AS older FROM events, (SELECT max(ts) AS last FROM events) GROUP BY 1",
        "snapshot_digest": f"SELECT count(*) AS n, {limbs} FROM (SELECT {sha} AS h FROM customer)",
        "snapshot_changes": "SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 'write' ELSE 'delete' END AS change FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')",
        "latest_upsert": "SELECT a.o_custkey, b.s AS o_orderstatus, b.p AS o_orderpriority, CAST(CASE WHEN a.s = b.s AND a.p = b.p THEN 1 ELSE 2 END AS INT) AS version FROM (SELECT o_custkey, arg_min(o_orderstatus, o_orderkey) AS s, arg_min(o_orderpriority, o_orderkey) AS p FROM orders GROUP BY 1) a JOIN (SELECT o_custkey, arg_max(o_orderstatus, o_orderkey) AS s, arg_max(o_orderpriority, o_orderkey) AS p FROM orders GROUP BY 1) b USING (o_custkey)",
        "page_heads": "SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, len(regexp_extract_all(html, '<a href=')) AS links FROM pages",
        "topic_tags": f"SELECT {_ONE_K} AS tag, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, tag NULLS FIRST LIMIT 6",
        "threads": "SELECT conv_id, count(*) AS turns, string_agg(role || ': ' || text, chr(10) ORDER BY turn, role, text) AS body FROM conversations GROUP BY 1",
        "usage_daily": "SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n, count(DISTINCT user_id) AS readers FROM events GROUP BY 1, 2",
        "nearest_rank": "WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events) SELECT event_type, max(value) FILTER (WHERE r = ceil(n * 0.5)) AS p50, max(value) FILTER (WHERE r = ceil(n * 0.95)) AS p95, max(value) AS top FROM r GROUP BY 1",
        "people_terms": f"WITH w AS (SELECT doc_id, unnest({_TOK}) AS word FROM documents), t AS (SELECT doc_id, word, count(*) AS tf FROM w GROUP BY 1, 2), f AS (SELECT word, count(*) AS df, sum(1 + ln(tf)) AS mass FROM t GROUP BY 1) SELECT word, df, round(mass * ln(n / df), 4) AS weight FROM f, (SELECT count(*) AS n FROM documents) WHERE df >= 5 AND df <= 0.3 * n",
        "unseen": "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)",
        "collapse_guard": "SELECT *, coalesce(found < 0.5 * before, false) AS collapsed FROM (SELECT *, lag(found) OVER (ORDER BY day) AS before FROM (SELECT CAST(ts AS DATE) AS day, count(*) AS found FROM events GROUP BY 1))",
        "page_addresses": f"SELECT page_id, {host} AS host, 'blog:' || {host} || regexp_replace(regexp_extract(url, '^(?:[a-zA-Z][a-zA-Z0-9_+.-]*://)?[^/?#]*([^?#]*)', 1), '/+$', '') || CASE WHEN len(q) > 0 THEN '?' || array_to_string(list_sort(q), '&') ELSE '' END AS post_key FROM (SELECT *, list_filter(string_split(regexp_extract(url, '\\?([^#]*)', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(lower(p), '^(utm_[^=]*|{'|'.join(urls.TRACKING)})(=|$)')) AS q FROM pages)",
    } | reading.sql(f"SELECT doc_id, rank FROM ({_bm25_sql(51, 'true')})") | changing.SQL | state.SQL | searching.sql(_bm25_sql, _TOK) | naming.SQL | arriving.SQL | keeping.SQL | listing.SQL
