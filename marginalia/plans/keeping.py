"""What posts link and owe, shapes of posts, allowances, screens, and forgetting."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from marginalia.operators import forgetting, posts
from marginalia.operators.forgetting import Reference
from marginalia.storage import table


def _n(template: str, key: str = "page_id"):
    return F.regexp_replace(F.lit(template), r"\{n\}", F.col(key).cast("string"))


_FEED = ("https://s{m}.org/p/post-{n}", "https://s{m}.org/p/more-{n}", "https://s{m}.org/2024/0{d}/name-{n}/", "https://www.s{m}.org/apr/name{n}", "https://other.org/x/{n}")
#: Addresses, and whether they fit a site whose feed has all of the above.
_TRIED = (("https://s{m}.org/p/new", "true"), ("https://s{m}.org/p/new/2/", "true"), ("https://s{m}.org/q/new", "false"), ("https://s{m}.org/2019/11/old", "true"), ("https://s{m}.org/2019/old", "false"), ("https://s{m}.org/", "false"), ("https://s{m}.org/may/x", "true"), ("https://s{m}.org/p/12", "false"))


def post_shapes(spark: SparkSession, d: str) -> DataFrame:
    """Shapes learned from ten sites' feeds, and which addresses of each fit; an eleventh site has one post only."""
    pages = table(spark, d, "pages").withColumn("m", F.col("page_id") % 10)
    fill = lambda t: F.regexp_replace(F.regexp_replace(_n(t), r"\{m\}", F.col("m").cast("string")), r"\{d\}", (F.col("page_id") % 9 + 1).cast("string"))
    feed = pages.select(F.concat(F.lit("https://s"), "m", F.lit(".org/")).alias("site"), F.explode(F.array(*map(fill, _FEED))).alias("url"))
    feed = feed.union(pages.where("page_id = 1").select(F.lit("https://lone.org/"), F.lit("https://lone.org/p/a")))
    tried = pages.select(F.concat(F.lit("https://s"), "m", F.lit(".org/")).alias("site"), F.explode(F.array(*(fill(t) for t, _ in _TRIED))).alias("url")).distinct()
    tried = tried.union(pages.where("page_id = 1").select(F.lit("https://lone.org/"), F.lit("https://lone.org/p/b")))
    return posts.fitting(tried, posts.learned(feed, "site", "url"), "site", "url")


_POST = (
    "---\nauthor: \"@Me{n}\"\n---\nsee https://a.org/x{n}, and (https://arxiv.org/abs/2301.0{n}).\n![img](https://pic.org/{n}.png)\n**Quoting** [@you](https://x.com/you)\n> said https://quoted.org/{n}\n"
    "- [card](https://card.org/{n})\n\nmine again https://github.com/o{n}/r!\n**Quoting** [@me{n}](https://x.com/me{n})\n> own https://a.org/self{n}"
)


def posted_links(spark: SparkSession, d: str) -> DataFrame:
    """Every link that rendered posts have in their author's own words, with the source it names."""
    links = table(spark, d, "pages").select("page_id", F.posexplode(posts.own_links(_n(_POST))).alias("i", "url"))
    return links.select("page_id", F.col("i").cast("long").alias("i"), "url", posts.candidate_key(F.col("url")).alias("key"))


def linked_sources(spark: SparkSession, d: str) -> DataFrame:
    """Hosts that pages name, by pages; the page's own address and its links count."""
    made = table(spark, d, "pages").select("page_id", F.array(_n("https://site.dev/{n}"), F.concat(F.lit("https://g"), F.col("page_id") % 7, F.lit(".substack.com/p/1")), F.lit("https://site.dev/about"), F.lit("http://localhost:8080/x"), F.lit("https://x.com/me")).alias("links"))
    return posts.linked_sources(made, "page_id", "links").select("key", "posts")


def people_named(spark: SparkSession, d: str) -> DataFrame:
    """Whom orders (as posts) name by their lines, the strongest way first."""
    lines = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("post"), F.lit("me").alias("author"), F.lit("S1").alias("own"), F.when(F.col("l_returnflag") == "A", "quote").when(F.col("l_returnflag") == "R", "link").otherwise("mention").alias("kind"),
        F.when(F.col("l_returnflag") != "R", F.concat(F.lit("x:"), "l_suppkey")).alias("who"), F.concat(F.when(F.col("l_linenumber") % 2 == 0, "S").otherwise("s"), (F.col("l_suppkey") % 20).cast("string")).alias("handle"), "l_linenumber", "l_suppkey",
    )
    return posts.people_named(lines, "post", "author", "own", "kind", "who", "handle", ["l_linenumber", "l_suppkey"])


def _links(spark: SparkSession, d: str) -> DataFrame:
    """Links of posts: each page's number gives a paper, an own post, another's post, an article on the own blog, one elsewhere, a shop, and a repository in a quote and in own text."""
    rows = [
        ("https://arxiv.org/abs/2301.0{n}", None), ("https://x.com/Me/status/{n}", None), ("https://x.com/you/status/{n}", None), ("https://blog.me/p/{n}", None), ("https://else.org/p/{n}", "you"),
        ("https://acme.com/shop/{n}", None), ("https://github.com/o/r{n}", "you"), ("https://github.com/o/r{n}", None), ("https://discord.gg/{n}", None), ("https://common.org/doc", "you"),
    ]
    each = F.explode(F.array(*(F.struct(_n(u).alias("url"), F.lit(q).cast("string").alias("quoted"), F.lit(i).alias("o")) for i, (u, q) in enumerate(rows))))
    return table(spark, d, "pages").select("page_id", F.lit("me").alias("own"), each.alias("x")).select("page_id", "own", "x.*")


def owed_links(spark: SparkSession, d: str) -> DataFrame:
    hosts = table(spark, d, "pages").select("page_id", F.lit("blog.me").alias("host"))
    return posts.owed(_links(spark, d), "page_id", "url", "own", "quoted", "o", hosts)


def settled_links(spark: SparkSession, d: str) -> DataFrame:
    """How many links posts owe still, when every third page's papers and the common link have their records."""
    done = table(spark, d, "pages").where("page_id % 3 = 0").select(_n("https://arxiv.org/abs/2301.0{n}").alias("url")).union(spark.range(1).select(F.lit("https://common.org/doc")))
    return posts.settled(owed_links(spark, d), done, "page_id", "url").groupBy("page_id").agg(F.count("*").alias("owed"))


def rolling_allowance(spark: SparkSession, d: str) -> DataFrame:
    """When each author may act again, with three acts in any six hours."""
    got = posts.allowance(table(spark, d, "events").select("event_id", "user_id", "ts"), "user_id", "ts", 3, "INTERVAL 6 HOURS")
    return got.select("event_id", "held", F.unix_micros(F.col("frees_at").cast("timestamp")).alias("frees_us"))


def screen_groups(spark: SparkSession, d: str) -> DataFrame:
    """The first customers of each nation by balance, as many as a screen of 60 holds, and how many more there are."""
    rows = table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    return posts.screens(rows, "c_nationkey", [F.desc("c_acctbal"), F.col("c_custkey")], 10, 60).select("c_custkey", "c_nationkey", "place", "more")


RULES = [Reference("documents", "doc_id"), Reference("labels", "doc_id"), Reference("candidates", "doc_id", keep=True), Reference("walks", "doc_id")]


def _store(spark: SparkSession, d: str) -> tuple[dict[str, DataFrame], DataFrame]:
    """Documents by writers (their id modulo 50, clustered by ten), what refers to them, and the items of one writer's cluster that no one saved."""
    docs = table(spark, d, "documents").select("doc_id", (F.col("doc_id") % 50).alias("who"), (F.col("doc_id") % 3 == 0).alias("saved"))
    tables = {"documents": docs, "labels": table(spark, d, "labels"), "candidates": table(spark, d, "embeddings").select("vec_id", (F.col("vec_id") * 2).alias("doc_id")), "walks": table(spark, d, "conversations").select("conv_id", "turn", F.col("conv_id").alias("doc_id"))}
    heads = docs.select(F.col("who").alias("entity"), (F.col("who") % 10).alias("head")).distinct()
    people = forgetting.cluster(heads, docs.where("who = 23").select(F.col("who").alias("id")).limit(1))
    return tables, forgetting.footprint(docs, people, "who", "doc_id", "saved")


def forget_preview(spark: SparkSession, d: str) -> DataFrame:
    tables, gone = _store(spark, d)
    return forgetting.preview(tables, gone, RULES)


def forget_effect(spark: SparkSession, d: str) -> DataFrame:
    """What is left of each table, and how many rows name nothing any more."""
    tables, gone = _store(spark, d)
    after = forgetting.forgotten(tables, gone, RULES)
    rows = [t.agg(F.count("*").alias("rows"), F.count_if(F.col("doc_id").isNull()).alias("nameless")).select(F.lit(name).alias("table"), "*") for name, t in after.items()]
    return rows[0].union(rows[1]).union(rows[2]).union(rows[3])


QUERIES = {f.__name__: f for f in (post_shapes, posted_links, linked_sources, people_named, owed_links, settled_links, rolling_allowance, screen_groups, forget_preview, forget_effect)}

_TRIES = ", ".join(f"('{u}', {f})" for u, f in _TRIED)
_OWED = (
    "SELECT page_id, replace(u, '{n}', page_id::VARCHAR) AS url, kind, via AS via_quote FROM pages, (VALUES ('https://arxiv.org/abs/2301.0{n}', 'paper', NULL), ('https://x.com/you/status/{n}', 'x', NULL), ('https://else.org/p/{n}', 'article', 'you'), "
    "('https://acme.com/shop/{n}', 'card', NULL), ('https://github.com/o/r{n}', 'github', NULL), ('https://common.org/doc', 'article', 'you')) v(u, kind, via)"
)
_GONE = "(SELECT doc_id FROM documents WHERE doc_id % 50 % 10 = 3 AND doc_id % 3 <> 0)"
SQL = {
    "post_shapes": f"SELECT DISTINCT 'https://s' || page_id % 10 || '.org/' AS site, replace(u, '{{m}}', (page_id % 10)::VARCHAR) AS url, f AS fits FROM pages, (VALUES {_TRIES}) v(u, f) UNION ALL SELECT 'https://lone.org/', 'https://lone.org/p/b', NULL",
    "posted_links": "SELECT page_id, i, replace(u, '{n}', page_id::VARCHAR) AS url, replace(k, '{n}', page_id::VARCHAR) AS key FROM pages, (VALUES (0, 'https://a.org/x{n}', 'a.org'), (1, 'https://arxiv.org/abs/2301.0{n}', NULL), (2, 'https://github.com/o{n}/r', 'github.com/o{n}'), (3, 'https://a.org/self{n}', 'a.org')) v(i, u, k)",
    "linked_sources": "SELECT 'site.dev' AS key, count(*) AS posts FROM pages UNION ALL SELECT 'g' || page_id % 7 || '.substack.com', count(*) FROM pages GROUP BY 1",
    "people_named": "WITH n AS (SELECT l_orderkey AS post, 's' || l_suppkey % 20 AS handle, CASE l_returnflag WHEN 'A' THEN 1 WHEN 'R' THEN 2 ELSE 3 END AS k, CASE WHEN l_returnflag <> 'R' THEN 'x:' || l_suppkey END AS who, l_linenumber AS l, l_suppkey AS s FROM lineitem WHERE l_suppkey % 20 <> 1) "
    "SELECT post, handle, (['quote', 'link', 'mention'])[min(k)] AS kind, arg_min(who, ROW(k, l, s)) FILTER (WHERE who IS NOT NULL) AS who, arg_min(l, ROW(k, l, s)) AS first FROM n GROUP BY 1, 2",
    "owed_links": _OWED,
    "settled_links": f"SELECT page_id, count(*) AS owed FROM ({_OWED}) WHERE url <> 'https://common.org/doc' AND NOT (kind = 'paper' AND url IN (SELECT 'https://arxiv.org/abs/2301.0' || page_id FROM pages WHERE page_id % 3 = 0)) GROUP BY 1",
    "rolling_allowance": "SELECT a.event_id, count(*) AS held, CASE WHEN count(DISTINCT b.event_id) >= 3 THEN epoch_us(list_sort(list(b.ts), 'DESC')[3] + INTERVAL 6 HOUR) END AS frees_us FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts <= a.ts AND b.ts > a.ts - INTERVAL 6 HOUR GROUP BY a.event_id",
    "screen_groups": "WITH r AS (SELECT c_custkey, c_nationkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS place, count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer), s AS (SELECT least(10, 60 // count(DISTINCT c_nationkey)) AS shown FROM r) SELECT c_custkey, c_nationkey, place, n - shown AS more FROM r, s WHERE place <= shown",
    "forget_preview": f"SELECT 'documents' AS \"table\", count(*) AS rows FROM documents WHERE doc_id IN {_GONE} UNION ALL SELECT 'labels', count(*) FROM labels WHERE doc_id IN {_GONE} UNION ALL SELECT 'candidates', count(*) FROM embeddings WHERE vec_id * 2 IN {_GONE} UNION ALL SELECT 'walks', count(*) FROM conversations WHERE conv_id IN {_GONE}",
    "forget_effect": f"SELECT 'documents' AS \"table\", count(*) AS rows, 0::BIGINT AS nameless FROM documents WHERE doc_id NOT IN {_GONE} UNION ALL SELECT 'labels', count(*), 0 FROM labels WHERE doc_id NOT IN {_GONE} UNION ALL SELECT 'candidates', count(*), count(*) FILTER (WHERE vec_id * 2 IN {_GONE}) FROM embeddings UNION ALL SELECT 'walks', count(*), 0 FROM conversations WHERE conv_id NOT IN {_GONE}",
}
