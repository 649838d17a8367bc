"""Queries over state that arrivals change, lookups, tallies and identities, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from marginalia.functions import dates, pages, urls
from marginalia.operators import graph, state
from marginalia.storage import table

_K = "CAST(regexp_extract(props, '\"k\": *([0-9]+)', 1) AS BIGINT)"


def pull_marks(spark: SparkSession, d: str) -> DataFrame:
    """Each author's and source's last pull that worked (a value of 20 or more), and how many failed since."""
    return state.watermarks(table(spark, d, "events"), ["user_id", "event_type"], "ts", F.col("value") >= 20)


def pull_windows(spark: SparkSession, d: str) -> DataFrame:
    """Where the next pull of each pair begins, and whether so long a look-back may be asked for."""
    now = table(spark, d, "events").agg(F.max("ts").alias("now"))
    rows = pull_marks(spark, d).crossJoin(F.broadcast(now))  # one row
    since = state.pull_since(F.col("mark"), F.col("now"))
    return rows.select("user_id", "event_type", since.alias("since"), state.valid_lookback(F.datediff("now", since)).alias("allowed"))


def candidate_states(spark: SparkSession, d: str) -> DataFrame:
    """Customers as candidates: urgent orders keep, low ones pass, pending ones materialize, open ones are tries that fail."""
    priority, status = F.col("o_orderpriority"), F.col("o_orderstatus")
    verdict = F.when(priority == "1-URGENT", True).when(priority == "5-LOW", False)
    return state.candidate_states(table(spark, d, "orders"), "o_custkey", ["o_orderdate", "o_orderkey"], verdict, status == "P", status == "O")


def due_candidates(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").withColumn("tries", F.col("o_custkey") % 8)
    return state.due(rows, F.col("o_orderstatus") == "O", "tries", ["o_orderdate", "o_orderkey"], 50).select("o_orderkey", "o_orderdate", "tries")


def promotions(spark: SparkSession, d: str) -> DataFrame:
    mode = F.element_at(F.array(F.lit("frontier"), F.lit("human"), F.lit("probe")), (F.col("user_id") % 3 + 1).cast("int"))
    now = state.promoted(mode, F.col("event_type") == "purchase")
    return table(spark, d, "events").groupBy(mode.alias("mode"), now.alias("now")).agg(F.count("*").alias("n"))


def replaced_signals(spark: SparkSession, d: str) -> DataFrame:
    """Open orders in place of all filled ones of the customers that have any."""
    o = table(spark, d, "orders")
    side = lambda s: o.where(F.col("o_orderstatus") == s).select("o_custkey", "o_orderkey")
    return state.replaced(side("F"), side("O"), ["o_custkey"])


def inserted_signals(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    side = lambda s: o.where(F.col("o_orderstatus") == s).select("o_custkey", "o_orderpriority").distinct()
    return state.inserted(side("F"), side("O"), ["o_custkey", "o_orderpriority"])


def kept_fields(spark: SparkSession, d: str) -> DataFrame:
    """Customers whose new rows have no segment if it is BUILDING keep the one that even nations' old rows have."""
    c = table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    new = c.select("c_custkey", F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment")).alias("c_mktsegment"))
    return state.kept_field(c.where("c_nationkey % 2 = 0"), new, "c_custkey", "c_mktsegment")


def merged_profiles(spark: SparkSession, d: str) -> DataFrame:
    """Each author's fields after all events in their order: k, and one for each kind with a value of 10 or more."""
    of = F.create_map(F.lit("k"), F.get_json_object("props", "$.k"), F.col("event_type"), F.when(F.col("value") >= 10, F.col("value").cast("string")))
    got = state.merged_maps(table(spark, d, "events").withColumn("of", of), "user_id", ["ts", "event_id"], "of")
    return got.select("user_id", F.col("merged")["k"].cast("long").alias("last_k"), F.size("merged").cast("long").alias("fields"))


def newest_of_kind(spark: SparkSession, d: str) -> DataFrame:
    return state.per_group(table(spark, d, "events").select("event_id", "event_type", "ts"), "event_type", [F.desc("ts"), F.col("event_id")], 3)


def last_turns(spark: SparkSession, d: str) -> DataFrame:
    return state.newest_first(table(spark, d, "conversations"), "conv_id", "turn").select("conv_id", "turn", "role")


def known_nations(spark: SparkSession, d: str) -> DataFrame:
    """Nations with the first customer of theirs who has over 9,000 in their account."""
    rich = table(spark, d, "customer").where("c_acctbal > 9000")
    return state.onto_heads(table(spark, d, "nation").select("n_nationkey", "n_name"), rich, "n_nationkey", "c_nationkey", "c_name", "c_custkey")


def evidence_tallies(spark: SparkSession, d: str) -> DataFrame:
    return state.tallies(table(spark, d, "events"), "event_id", ["event_type", "user_id"])


def found_by_id(spark: SparkSession, d: str) -> DataFrame:
    return state.by_id(table(spark, d, "customer"), "c_name", ["CUSTOMER#000000005", "customer#000000009"]).select("c_custkey", "c_name")


def found_by_prefix(spark: SparkSession, d: str) -> DataFrame:
    return state.by_id(table(spark, d, "customer"), "c_name", ["customer#00000001"], prefix=True).select("c_custkey", "c_name")


def resolution_stats(spark: SparkSession, d: str) -> DataFrame:
    return state.cluster_sizes(identity_clusters(spark, d), "head")


def _links(spark: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, d, "events").where("event_type in ('purchase', 'signup')").select("user_id", (k * 100 + F.col("user_id") % 37).alias("url"), "event_type")


def identity_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Authors that share an address which one of them bought from (owns); addresses that are only signed up at join no one."""
    return graph.resolved(_links(spark, d), "user_id", "url", F.col("event_type") == "purchase")


def next_turns(spark: SparkSession, d: str) -> DataFrame:
    """Who answers whom: turns joined with the next of their conversation, on two keys."""
    t = table(spark, d, "conversations").select("conv_id", "turn", "role")
    after = t.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("role").alias("answer"))
    return t.join(after, ["conv_id", "turn"]).groupBy("role", "answer").agg(F.count("*").alias("n"))


def recommendations(spark: SparkSession, d: str) -> DataFrame:
    """How many suppliers offer a part, and which."""
    by = table(spark, d, "lineitem").groupBy("l_partkey").agg(F.array_sort(F.collect_set("l_suppkey")).alias("s"))
    return by.select("l_partkey", F.size("s").cast("long").alias("recommenders"), F.array_join(F.transform("s", lambda x: x.cast("string")), ",").alias("who"))


def iso_seconds(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("at"))


def json_arrays(spark: SparkSession, d: str) -> DataFrame:
    """Lengths of JSON arrays, and whether they hold a number; malformed ones have neither."""
    blob = F.when(F.col("event_id") % 7 > 0, F.concat(F.lit("["), F.get_json_object("props", "$.k"), F.lit(","), F.col("user_id").cast("string"), F.lit("]"))).otherwise("{broken")
    got = F.from_json(blob, "array<long>")
    return table(spark, d, "events").groupBy("event_type").agg(F.sum(F.when(got.isNotNull(), F.size(got))).alias("items"), F.count_if(F.exists(got, lambda x: x == 5)).alias("with_five"))


def input_marks(spark: SparkSession, d: str) -> DataFrame:
    """How many rows each input has and its largest key: two numbers that tell whether anything was added."""
    keys = {"customer": "c_custkey", "orders": "o_orderkey", "events": "event_id", "documents": "doc_id"}
    each = [table(spark, d, t).agg(F.lit(t).alias("input"), F.count("*").alias("n"), F.max(k).alias("last")) for t, k in keys.items()]
    return each[0].union(each[1]).union(each[2]).union(each[3])


def accounts(spark: SparkSession, d: str) -> DataFrame:
    """Whose pages addresses are; five in six are made of a page's number on platforms with accounts."""
    n, kind = F.col("page_id").cast("string"), F.col("page_id") % 6
    made = F.when(kind == 0, F.concat(F.lit("https://mobile.twitter.com/User"), n, F.lit("/status/1"))).when(kind == 1, F.concat(F.lit("http://www.GitHub.com/orgs/Org"), n, F.lit("/people")))
    made = made.when(kind == 2, F.concat(F.lit("me"), n, F.lit(".substack.com/p/a"))).when(kind == 3, F.concat(F.lit("https://m.youtube.com/watch?v="), n))
    made = made.when(kind == 4, F.concat(F.lit("https://scholar.google.com/citations?hl=en&user=u"), n)).otherwise(F.concat(F.lit("https://www.site"), n, F.lit(".org:80/a/b?c#d")))
    return table(spark, d, "pages").select("page_id", urls.account(made).alias("account"))


def _stated(spark: SparkSession, d: str) -> DataFrame:
    """Pages with heads that state days: a meta tag, JSON-LD, both, one that lies in the future, or none."""
    n = F.col("page_id")
    day = F.date_format(F.date_add(F.lit("2020-01-01").cast("date"), (n % 1000).cast("int")), "yyyy-MM-dd")
    meta = F.concat(F.lit("<meta content='"), day, F.lit("T10:00:00Z' property='article:published_time'>"))
    later = F.concat(F.lit('<script type="application/ld+json">{"@graph":[{"@type":"BlogPosting","datePublished": "2023-05-05"}]}</script>'))
    future = F.lit('<meta name="date" content="2999-01-01"><meta property="og:type" content="article">')
    return table(spark, d, "pages").select("page_id", "html", F.concat(F.when(n % 4 == 0, meta).when(n % 4 == 1, later).when(n % 4 == 2, F.concat(meta, later)).otherwise(future), "html").alias("page"))


def page_dates(spark: SparkSession, d: str) -> DataFrame:
    page, today = F.col("page"), F.lit("2026-01-01").cast("date")
    return _stated(spark, d).select("page_id", F.date_format(pages.published(page, today), "yyyy-MM-dd").alias("published"), F.size(pages.stated_dates(page, today)).cast("long").alias("stated"), pages.is_article(page).alias("is_article"))


def page_titles(spark: SparkSession, d: str) -> DataFrame:
    own = F.concat(F.when(F.col("page_id") % 2 == 0, F.concat(F.lit('<meta property="og:title" content=" T  '), F.col("page_id"), F.lit(' "><meta content="about it" name="description">'))).otherwise(""), "html")
    return table(spark, d, "pages").select("page_id", pages.title(own).alias("title"), pages.description(own).alias("description"))


def post_dates(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("event_id") % 5
    day = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    got = dates.post_date(F.when(n == 0, day), F.when(n == 1, day).otherwise(""), F.when(n < 4, F.concat(F.lit("2001-01-01"), F.lit("T00:00"))))
    return table(spark, d, "events").select("event_id", got["day"].alias("day"), got["precision"].alias("precision"))


def next_pulls(spark: SparkSession, d: str) -> DataFrame:
    """When each author's and source's pair is pulled again: pulls work with a value of 20 or more."""
    by = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.max(F.when(F.col("value") >= 20, F.col("ts"))).alias("pulled"), F.max(F.when(F.col("value") < 20, F.col("ts"))).alias("tried"))
    at = dates.due_at(F.col("pulled"), F.col("tried"), F.col("user_id").cast("string"), F.col("event_type"))
    return by.select("user_id", "event_type", F.date_trunc("second", at).cast("timestamp_ntz").alias("due"))


def _people(spark: SparkSession, d: str) -> DataFrame:
    """Customers as accounts: one in two with the key in the id, all with a handle, clustered by nation and segment."""
    c = table(spark, d, "customer")
    key = F.concat(F.when(F.col("c_custkey") % 2 == 0, "github:").otherwise("x:"), F.col("c_custkey").cast("string"))
    return c.select(key.alias("id"), F.concat_ws("/", F.col("c_nationkey").cast("string"), "c_mktsegment").alias("head"), F.col("c_name").alias("handle"))


def who_by_handle(spark: SparkSession, d: str) -> DataFrame:
    got = state.named(_people(spark, d), "id", "head", "handle", "@customer#000000007")
    return got.select("head", F.array_join("ids", ",").alias("ids"), "matched_on")


def who_by_id(spark: SparkSession, d: str) -> DataFrame:
    """The ids of the cluster that an id names, and one more."""
    return state.wanted_ids(state.named(_people(spark, d), "id", "head", "handle", "GitHub:12"), ["x:nobody"])


QUERIES = {
    f.__name__: f
    for f in (
        pull_marks, pull_windows, candidate_states, due_candidates, promotions, replaced_signals, inserted_signals, kept_fields, merged_profiles, newest_of_kind, last_turns, known_nations,
        evidence_tallies, found_by_id, found_by_prefix, resolution_stats, identity_clusters, next_turns, recommendations, iso_seconds, json_arrays, input_marks,
        accounts, page_dates, page_titles, post_dates, next_pulls, who_by_handle, who_by_id,
    )
}

_MARKS = (
    "SELECT user_id, event_type, m AS mark, count(*) FILTER (WHERE NOT coalesce(value >= 20, false) AND (m IS NULL OR ts > m)) AS failures_since "
    "FROM (SELECT *, max(CASE WHEN value >= 20 THEN ts END) OVER (PARTITION BY user_id, event_type) AS m FROM events) GROUP BY 1, 2, 3"
)
_STATES = (
    "WITH v AS (SELECT o_custkey, o_orderdate, o_orderkey, o_orderstatus = 'P' AS made, o_orderstatus = 'O' AS failed, first_value(CASE o_orderpriority WHEN '1-URGENT' THEN true WHEN '5-LOW' THEN false END IGNORE NULLS) "
    "OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS verdict FROM orders), b AS (SELECT *, coalesce(verdict, false) AS live, "
    "coalesce(sum(CAST(coalesce(verdict, false) AND made AS INT)) OVER w, 0) AS mades, coalesce(sum(CAST(coalesce(verdict, false) AND failed AS INT)) OVER w, 0) AS fails FROM v "
    "WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), o AS (SELECT *, live AND mades = 0 AND fails < 5 AS open FROM b), "
    "g AS (SELECT o_custkey, bool_or(verdict) AS v, coalesce(bool_or(open AND made), false) AS m, count(*) FILTER (WHERE open AND failed) AS f, count(*) FILTER (WHERE open AND (made OR failed)) AS tries FROM o GROUP BY 1) "
    "SELECT o_custkey, CASE WHEN v IS NULL THEN 'new' WHEN NOT v THEN 'passed' WHEN m THEN 'materialized' WHEN f >= 5 THEN 'rejected' ELSE 'kept' END AS state, tries FROM g"
)
_CLUSTERS = (
    f"WITH RECURSIVE l AS (SELECT user_id AS e, {_K} * 100 + user_id % 37 AS u, event_type = 'purchase' AS o FROM events WHERE event_type IN ('purchase', 'signup')), "
    "low AS (SELECT u, min(e) AS low FROM l GROUP BY u HAVING bool_or(o)), x AS (SELECT DISTINCT e AS a, low AS b FROM l JOIN low USING (u) WHERE e <> low), s AS (SELECT a, b FROM x UNION SELECT b, a FROM x), "
    "r AS (SELECT DISTINCT e, e AS h FROM l UNION SELECT s.b, r.h FROM r JOIN s ON r.e = s.a WHERE r.h < s.b) SELECT e AS entity, min(h) AS head FROM r GROUP BY 1"
)

SQL = {
    "pull_marks": _MARKS,
    "pull_windows": f"SELECT user_id, event_type, since, date_diff('day', CAST(since AS DATE), CAST(now AS DATE)) BETWEEN 0 AND 60 AS allowed FROM (SELECT *, coalesce(mark - INTERVAL 6 HOUR, now - INTERVAL 14 DAY) AS since FROM ({_MARKS}), (SELECT max(ts) AS now FROM events))",
    "candidate_states": _STATES,
    "due_candidates": "SELECT o_orderkey, o_orderdate, o_custkey % 8 AS tries FROM orders WHERE o_orderstatus = 'O' AND o_custkey % 8 < 5 ORDER BY o_orderdate, o_orderkey LIMIT 50",
    "promotions": "SELECT mode, CASE WHEN mode = 'frontier' AND event_type = 'purchase' THEN 'human' ELSE mode END AS now, count(*) AS n FROM (SELECT *, (['frontier', 'human', 'probe'])[user_id % 3 + 1] AS mode FROM events) GROUP BY 1, 2",
    "replaced_signals": "SELECT o_custkey, o_orderkey FROM orders WHERE o_orderstatus = 'O' OR o_orderstatus = 'F' AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O')",
    "inserted_signals": "SELECT DISTINCT o_custkey, o_orderpriority FROM orders WHERE o_orderstatus IN ('F', 'O')",
    "kept_fields": "SELECT c_custkey, CASE WHEN c_mktsegment <> 'BUILDING' OR c_nationkey % 2 = 0 THEN c_mktsegment END AS c_mktsegment FROM customer",
    "merged_profiles": f"SELECT user_id, arg_max({_K}, struct_pack(ts, event_id)) AS last_k, 1 + count(DISTINCT event_type) FILTER (WHERE value >= 10) AS fields FROM events GROUP BY 1",
    "newest_of_kind": "SELECT event_id, event_type, ts, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id) AS place FROM events QUALIFY place <= 3",
    "last_turns": "SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) = 1",
    "known_nations": "SELECT n_nationkey, n_name, known_as FROM nation LEFT JOIN (SELECT c_nationkey, arg_min(c_name, c_custkey) AS known_as FROM customer WHERE c_acctbal > 9000 GROUP BY 1) ON n_nationkey = c_nationkey",
    "evidence_tallies": "SELECT 'event_type' AS field, event_type AS value, count(*) AS n, min(event_id) AS first_place FROM events GROUP BY 2 UNION ALL SELECT 'user_id', user_id::VARCHAR, count(*), min(event_id) FROM events GROUP BY 2",
    "found_by_id": "SELECT c_custkey, c_name FROM customer WHERE lower(c_name) IN ('customer#000000005', 'customer#000000009')",
    "found_by_prefix": "SELECT c_custkey, c_name FROM customer WHERE lower(c_name) LIKE 'customer#00000001%'",
    "resolution_stats": f"SELECT size, count(*) AS clusters FROM (SELECT head, count(*) AS size FROM ({_CLUSTERS}) GROUP BY 1) GROUP BY 1",
    "identity_clusters": _CLUSTERS,
    "next_turns": "SELECT a.role, b.role AS answer, count(*) AS n FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn + 1 = b.turn GROUP BY 1, 2",
    "recommendations": "SELECT l_partkey, count(DISTINCT l_suppkey) AS recommenders, string_agg(l_suppkey::VARCHAR, ',' ORDER BY l_suppkey) AS who FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) GROUP BY 1",
    "iso_seconds": "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS at FROM events",
    "json_arrays": f"SELECT event_type, CAST(2 * count(*) FILTER (WHERE event_id % 7 > 0) AS BIGINT) AS items, count(*) FILTER (WHERE event_id % 7 > 0 AND ({_K} = 5 OR user_id = 5)) AS with_five FROM events GROUP BY 1",
    "input_marks": " UNION ALL ".join(f"SELECT '{t}' AS input, count(*) AS n, max({k}) AS last FROM {t}" for t, k in (("customer", "c_custkey"), ("orders", "o_orderkey"), ("events", "event_id"), ("documents", "doc_id"))),
    "accounts": "SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'x.com/user' || page_id WHEN 1 THEN 'github.com/org' || page_id WHEN 2 THEN 'me' || page_id || '.substack.com' WHEN 3 THEN '' WHEN 4 THEN 'scholar.google.com/citations?user=u' || page_id ELSE 'site' || page_id || '.org' END AS account FROM pages",
    "page_dates": "SELECT page_id, strftime(CASE page_id % 4 WHEN 1 THEN DATE '2023-05-05' WHEN 3 THEN NULL WHEN 0 THEN m ELSE least(m, DATE '2023-05-05') END, '%Y-%m-%d') AS published, (ARRAY[1, 1, 2, 0])[page_id % 4 + 1] AS stated, page_id % 4 > 0 AS is_article FROM (SELECT page_id, DATE '2020-01-01' + CAST(page_id % 1000 AS INT) AS m FROM pages)",
    "page_titles": "SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'T ' || page_id ELSE trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_extract(html, '<title[^>]*>([^<]*)', 1), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&#x27;', ''''), '&amp;', '&'), '\\s+', ' ', 'g')) END AS title, CASE WHEN page_id % 2 = 0 THEN 'about it' ELSE '' END AS description FROM pages",
    "post_dates": "SELECT event_id, CASE WHEN event_id % 5 < 2 THEN strftime(ts, '%Y-%m-%d') WHEN event_id % 5 < 4 THEN '2001-01-01' ELSE '' END AS day, CASE WHEN event_id % 5 < 4 THEN 'day' ELSE 'unknown' END AS precision FROM events",
    "next_pulls": "SELECT user_id, event_type, date_trunc('second', CASE WHEN tried IS NOT NULL AND (pulled IS NULL OR tried > pulled) THEN tried + INTERVAL 60 MINUTE ELSE pulled + to_microseconds(CAST(round(86400000 * (1 + ((CAST('0x' || substr(sha256(user_id || ':' || event_type), 1, 8) AS BIGINT) % 2001) / 1000 - 1) * 0.1)) * 1000 AS BIGINT)) END) AS due "
    "FROM (SELECT user_id, event_type, max(ts) FILTER (WHERE value >= 20) AS pulled, max(ts) FILTER (WHERE value < 20) AS tried FROM events GROUP BY 1, 2)",
    "who_by_handle": "SELECT c_nationkey || '/' || c_mktsegment AS head, string_agg(id, ',' ORDER BY id) AS ids, 'profile_handle' AS matched_on FROM (SELECT *, CASE WHEN c_custkey % 2 = 0 THEN 'github:' ELSE 'x:' END || c_custkey AS id FROM customer) c WHERE (c_nationkey, c_mktsegment) IN (SELECT (c_nationkey, c_mktsegment) FROM customer WHERE lower(c_name) = 'customer#000000007') GROUP BY 1",
    "who_by_id": "SELECT CASE WHEN c_custkey % 2 = 0 THEN 'github:' ELSE 'x:' END || c_custkey AS id FROM customer WHERE (c_nationkey, c_mktsegment) IN (SELECT (c_nationkey, c_mktsegment) FROM customer WHERE c_custkey = 12) UNION SELECT 'x:nobody'",
}
