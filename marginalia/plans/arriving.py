"""Records as they arrive, walks over pages, copies kept up by deltas and streams, replies and their threads."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from marginalia.operators import graph
from marginalia.sources import exports, records
from marginalia.sources.copies import Copy
from marginalia.storage import materialise, shared_folder, table
from marginalia.streaming import ledger, walks


def _scratch(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


def post_records(spark: SparkSession, d: str) -> DataFrame:
    """Events as posts' JSON, read back as columns."""
    who = F.struct(F.col("user_id").cast("string").alias("rest_id"), F.struct(F.concat(F.lit("u"), "user_id").alias("screen_name")).alias("legacy"))
    legacy = F.struct(F.concat(F.lit("a "), "event_type", F.lit(" é")).alias("full_text"), F.date_format("ts", "EEE MMM dd HH:mm:ss '+0000' yyyy").alias("created_at"), F.when(F.col("event_id") % 3 == 0, F.lit("77")).alias("conversation_id_str"))
    made = F.to_json(F.struct(F.col("event_id").cast("string").alias("rest_id"), F.struct(F.struct(who.alias("result")).alias("user_results")).alias("core"), legacy.alias("legacy")))
    raw = table(spark, d, "events").select(F.when(F.col("event_id") % 10 == 9, F.substring(made, 1, 20)).otherwise(made).alias("json"))
    return records.posts(raw).select("id", "author", "handle", "conversation", F.unix_seconds("at").alias("at_s"), "text")


def account_records(spark: SparkSession, d: str) -> DataFrame:
    """Customers as accounts' JSON, read back as columns."""
    legacy = F.struct(F.col("c_name").alias("name"), F.lower("c_name").alias("screen_name"), F.col("c_mktsegment").alias("description"), F.col("c_nationkey").cast("long").alias("followers_count"))
    made = F.to_json(F.struct(F.when(F.col("c_custkey") % 7 > 0, F.col("c_custkey").cast("string")).alias("rest_id"), legacy.alias("legacy")))
    return records.accounts(table(spark, d, "customer").select(made.alias("json")))


def _works(spark: SparkSession, d: str) -> DataFrame:
    """Parts as works' JSON: of every nine one is cut off, one is empty, one is null."""
    index = F.map_from_arrays(F.array("p_brand", F.lit("of")), F.array(F.array(F.lit(0), F.lit(2)), F.array(F.lit(1))))
    made = F.to_json(F.struct(F.concat(F.lit("W"), "p_partkey").alias("id"), F.concat(F.lit("https://doi.org/10.1/AB"), "p_partkey").alias("doi"), F.col("p_name").alias("title"), (2000 + F.col("p_size")).alias("publication_year"), index.alias("abstract_inverted_index")))
    k = F.col("p_partkey") % 9
    return table(spark, d, "part").select("p_partkey", F.when(k == 0, F.substring(made, 1, 25)).when(k == 1, F.lit("{}")).when(k == 2, F.lit(None)).otherwise(made).alias("json"))


def work_records(spark: SparkSession, d: str) -> DataFrame:
    return records.works(_works(spark, d)).select("id", "doi", "title", "year", "abstract")


def work_years(spark: SparkSession, d: str) -> DataFrame:
    return records.year_counts(records.works(_works(spark, d)))


def work_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """How many answers held a work, none, or were malformed."""
    return _works(spark, d).groupBy(records.outcome(F.col("json"), records.WORK).alias("outcome")).agg(F.count("*").alias("n"))


def feed_links(spark: SparkSession, d: str) -> DataFrame:
    """Feeds of ten pages each, with a second date for every third page, read back as links and dates."""
    day = lambda n: F.date_format(F.to_timestamp(F.lit("2024-01-01 10:00:00")) + F.make_dt_interval(days=(F.col("page_id") % 300 + n).cast("int")), "EEE, dd MMM yyyy HH:mm:ss 'GMT'")
    item = lambda n: F.concat(F.lit("<item><title>t</title><link>https://a.org/"), "page_id", F.lit("</link><pubDate>"), day(n), F.lit("</pubDate></item>"))
    each = table(spark, d, "pages").select("page_id", F.concat(item(5), F.when(F.col("page_id") % 3 == 0, item(2)).otherwise("")).alias("i"))
    feeds = each.groupBy(F.floor(F.col("page_id") / 10)).agg(F.concat(F.lit("<rss><channel>"), F.array_join(F.collect_list("i"), "\n"), F.lit("</channel></rss>")).alias("xml"))  # ten pages
    return records.feed_dates(feeds).select("link", F.unix_seconds("at").alias("at_s"))


def site_entries(spark: SparkSession, d: str) -> DataFrame:
    """Site maps of ten pages each, read back."""
    one = F.concat(F.lit("<url><loc>https://a.org/?p="), "page_id", F.lit("&amp;x=1</loc>"), F.when(F.col("page_id") % 2 == 0, F.lit("<lastmod>2024-02-03</lastmod>")).otherwise(""), F.lit("</url>"))
    maps = table(spark, d, "pages").groupBy(F.floor(F.col("page_id") / 10)).agg(F.concat(F.lit("<urlset>"), F.array_join(F.collect_list(one), ""), F.lit("</urlset>")).alias("xml"))
    return records.site_map(maps)


def exported(spark: SparkSession, d: str) -> DataFrame:
    """Events as they may leave: two columns and the allowed key of their properties."""
    return exports.export(table(spark, d, "events"), ["event_id", "event_type"], {"props": ["k"]})


def _segments(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    c = table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment")
    return c.where("c_mktsegment <> 'BUILDING'"), c.where("c_mktsegment <> 'MACHINERY'").withColumn("c_name", F.when(F.col("c_custkey") % 11 == 0, F.upper(F.reverse("c_name"))).otherwise(F.col("c_name")))


def patched_copy(spark: SparkSession, d: str) -> DataFrame:
    """Customers as they were, kept as a copy and brought up to what they are by a delta that its digest admits."""
    old, new = _segments(spark, d)
    copy = Copy(spark, _scratch(spark), "c_custkey", 8)
    copy.replace(old)
    copy.apply(exports.delta(old, new, "c_custkey"), copy.digest())
    return copy.rows()


def streamed_copy(spark: SparkSession, d: str) -> DataFrame:
    """The latest event of each author, merged from a stream of files in batches; every batch comes twice."""
    events = table(spark, d, "events").select("user_id", "event_id", "event_type", F.col("ts").cast("timestamp").alias("at"))
    folder, copy = _scratch(spark), Copy(spark, _scratch(spark), "user_id", 4)
    events.repartition(3, "event_id").write.parquet(folder)
    stream = lambda: spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    for _ in range(2):
        ledger.merge_stream(stream(), copy, "at", _scratch(spark)).awaitTermination()
    return copy.rows().select("user_id", F.unix_micros("at").alias("at_us"))


def _walked(spark: SparkSession, d: str) -> DataFrame:
    """Events as pages: an author's walk in three generations, of which pages are lost or lead back to themselves, and a branch that some open and fewer fill."""
    at = ["user_id", "generation"]
    e = table(spark, d, "events").withColumn("generation", F.col("event_id") % 3 + 1)
    order = Window.partitionBy(*at).orderBy("ts", "event_id")
    e = e.withColumns({"k": F.row_number().over(order) - 1, "last": F.lead("event_id").over(order).isNull()})
    nxt = F.when(F.col("event_id") % 59 == 0, F.col("k")).when(~F.col("last"), F.col("k") + 1).cast("string")
    opens = F.when((F.col("k") == 0) & (F.col("user_id") % 2 == 0), F.array(F.lit("list"))).otherwise(F.array().cast("array<string>"))
    columns = lambda branch, cursor, to, opened: [F.col("user_id").cast("string").alias("collector"), "generation", F.lit(branch).alias("branch"), cursor.alias("cursor"), to.alias("next"), opened.alias("opens"), F.lit(1).cast("long").alias("shown"), F.col("ts").cast("timestamp").alias("at")]
    root = e.where("event_id % 53 <> 0").select(*columns("root", F.col("k").cast("string"), nxt, opens))
    branch = e.where("k = 0 and user_id % 4 = 0").select(*columns("list", F.lit("0"), F.lit(None).cast("string"), F.array().cast("array<string>")))
    return root.unionByName(branch)


def settled_walks(spark: SparkSession, d: str) -> DataFrame:
    """Each author's latest walk of which all pages are in."""
    return walks.settled_walks(_walked(spark, d))


def stream_walks(spark: SparkSession, d: str) -> DataFrame:
    """The same by keyed state, from a stream of pages in three batches."""
    pages, out, key = materialise(_walked(spark, d)), _scratch(spark), "spark.sql.streaming.stateStore.providerClass"
    pages.repartition(3).write.parquet(f"{out}/in")
    old = spark.conf.get(key, None)
    spark.conf.set(key, walks.ROCKS)
    try:
        source = spark.readStream.schema(pages.schema).option("maxFilesPerTrigger", 1).parquet(f"{out}/in")
        walks.followed(source).writeStream.format("parquet").option("path", f"{out}/out").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(key, old) if old else spark.conf.unset(key)
    told = spark.read.schema(walks.OUT).parquet(f"{out}/out").where("state = 'complete'")
    return told.groupBy("collector").agg(F.max_by(F.struct("generation", "pages", "shown"), "generation").alias("x")).select("collector", "x.*")


def _replies(spark: SparkSession, d: str) -> DataFrame:
    """Events as posts of an author to an earlier one: every 50th begins a thread."""
    parent = F.when(F.col("event_id") % 50 > 0, F.col("event_id") - 1 - F.col("event_id") % 2 * (F.col("event_id") % 3))
    return table(spark, d, "events").select("event_id", parent.alias("to"), (F.floor(F.col("event_id") / 8) % 5).alias("who"), "event_type")


def reply_roots(spark: SparkSession, d: str) -> DataFrame:
    """The top of every reply's thread, how far away it is, and whether one author wrote all on the way."""
    return graph.ancestries(_replies(spark, d), "event_id", "to", F.col("who") == F.col("up_who"))


def own_threads(spark: SparkSession, d: str) -> DataFrame:
    """What authors wrote on to their own posts, put together."""
    return graph.self_threads(_replies(spark, d), "event_id", "to", "who", "event_id", "event_type")


QUERIES = {
    f.__name__: f
    for f in (
        post_records, account_records, work_records, work_years, work_outcomes, feed_links, site_entries, exported, patched_copy, streamed_copy, settled_walks, stream_walks, reply_roots, own_threads,
    )
}

_SETTLED = (
    "WITH g AS (SELECT user_id, event_id % 3 + 1 AS generation, count(*) AS n, bool_or(event_id % 53 = 0 OR event_id % 59 = 0) AS bad FROM events GROUP BY 1, 2), "
    "o AS (SELECT *, n + CAST(user_id % 4 = 0 AS INT) AS pages FROM g WHERE NOT bad AND user_id % 4 <> 2) "
    "SELECT user_id::VARCHAR AS collector, generation, pages, pages AS shown FROM o QUALIFY generation = max(generation) OVER (PARTITION BY user_id)"
)
_THREADS = (
    "WITH RECURSIVE p AS (SELECT event_id, CASE WHEN event_id % 50 > 0 THEN event_id - 1 - event_id % 2 * (event_id % 3) END AS up, event_id // 8 % 5 AS who, event_type FROM events), "
    "l AS (SELECT a.*, b.event_id AS over, b.who AS over_who FROM p a LEFT JOIN p b ON a.up = b.event_id), "
    "r AS (SELECT event_id, event_id AS root, 0 AS depth, true AS unbroken, who FROM l WHERE over IS NULL UNION ALL SELECT l.event_id, r.root, r.depth + 1, r.unbroken AND l.who = r.who, l.who FROM l JOIN r ON l.over = r.event_id) "
)

SQL = {
    "post_records": "SELECT event_id::VARCHAR AS id, user_id::VARCHAR AS author, 'u' || user_id AS handle, CASE WHEN event_id % 3 = 0 THEN '77' ELSE event_id::VARCHAR END AS conversation, CAST(floor(epoch(ts)) AS BIGINT) AS at_s, 'a ' || event_type || ' é' AS text FROM events WHERE event_id % 10 <> 9",
    "account_records": "SELECT c_custkey::VARCHAR AS id, lower(c_name) AS handle, c_name AS name, c_mktsegment AS bio, c_nationkey::BIGINT AS followers FROM customer WHERE c_custkey % 7 > 0",
    "work_records": "SELECT 'W' || p_partkey AS id, '10.1/ab' || p_partkey AS doi, p_name AS title, 2000 + p_size AS year, p_brand || ' of ' || p_brand AS abstract FROM part WHERE p_partkey % 9 > 2",
    "work_years": "SELECT 2000 + p_size AS year, count(*) AS n FROM part WHERE p_partkey % 9 > 2 GROUP BY 1",
    "work_outcomes": "SELECT (['malformed', 'empty', 'empty'])[least(p_partkey % 9, 3) + 1] AS outcome, count(*) AS n FROM part WHERE p_partkey % 9 < 3 GROUP BY 1 UNION ALL SELECT 'found', count(*) FROM part WHERE p_partkey % 9 > 2",
    "feed_links": "SELECT 'https://a.org/' || page_id AS link, CAST(epoch(TIMESTAMP '2024-01-01 10:00:00') AS BIGINT) + 86400 * (page_id % 300 + CASE WHEN page_id % 3 = 0 THEN 2 ELSE 5 END) AS at_s FROM pages",
    "site_entries": "SELECT 'https://a.org/?p=' || page_id || '&x=1' AS url, CASE WHEN page_id % 2 = 0 THEN '2024-02-03' END AS lastmod, false AS is_index FROM pages",
    "exported": "SELECT event_id, event_type, '{\"k\":\"' || regexp_extract(props, '\"k\": *([0-9]+)', 1) || '\"}' AS props FROM events",
    "patched_copy": "SELECT c_custkey, CASE WHEN c_custkey % 11 = 0 THEN upper(reverse(c_name)) ELSE c_name END AS c_name, c_mktsegment FROM customer WHERE c_mktsegment <> 'MACHINERY'",
    "streamed_copy": "SELECT user_id, epoch_us(max(ts)) AS at_us FROM events GROUP BY 1",
    "settled_walks": _SETTLED,
    "stream_walks": _SETTLED,
    "reply_roots": f"{_THREADS} SELECT event_id AS node, root, depth, unbroken FROM r",
    "own_threads": f"{_THREADS} SELECT root, p.who, count(*) AS posts, sha256(string_agg(event_type, chr(10) || chr(10) ORDER BY p.event_id)) AS body_sha256 FROM r JOIN p USING (event_id) WHERE unbroken GROUP BY 1, 2",
}
