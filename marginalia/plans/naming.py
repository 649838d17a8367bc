"""Who and what addresses name, and whom sources belong to."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from marginalia.functions import urls
from marginalia.operators import graph, people
from marginalia.storage import table

#: Addresses with a page's number in them, and what they have to give: account, link kind, what a trusted link becomes, paper, type and handle of the profile.
LADDER = [
    ("https://mobile.twitter.com/User{n}/status/{n}", "x.com/user{n}", None, "x", None, "x", "user{n}"),
    ("http://www.GitHub.com/orgs/Org{n}/people", "github.com/org{n}", "github", "github", None, "github", "org{n}"),
    ("https://github.com/me{n}/repo?tab=readme", "github.com/me{n}", "github", "github", None, "github", "me{n}"),
    ("https://me{n}.substack.com/p/a", "me{n}.substack.com", "substack", "substack", None, "substack", "me{n}"),
    ("me{n}.substack.com/p/a", "me{n}.substack.com", "substack", None, None, None, None),
    ("https://m.youtube.com/watch?v={n}", "", None, None, None, None, None),
    ("https://scholar.google.com/citations?hl=en&user=u%2B{n}", "scholar.google.com/citations?user=u+{n}", None, "article", None, "scholar", "u+{n}"),
    ("https://www.site{n}.co.uk:80/a/b?c#d", "site{n}.co.uk", None, "article", None, "blog", "site{n}"),
    ("https://blog.site{n}.org/", "blog.site{n}.org", None, None, None, "blog", "site{n}"),
    ("https://arxiv.org/abs/2301.0{n}v2", "arxiv.org", "paper", "paper", "arXiv:2301.0{n}", "paper", None),
    ("https://publisher.org/doi/full/10.1000/ABC.{n}/abstract?x=1", "publisher.org", "paper", "paper", "DOI:10.1000/abc.{n}", "blog", "publisher"),
    ("https://papers.ssrn.com/sol3/papers.cfm?abstract_id={n}", "papers.ssrn.com", "paper", "paper", "DOI:10.2139/ssrn.{n}", "paper", None),
    ("https://a.site{n}.org/papers/P{n}.PDF", "a.site{n}.org", "paper", "paper", "url:a.site{n}.org/papers/P{n}.PDF", "paper", None),
    ("https://acme.com/careers/{n}", "acme.com", None, None, None, "blog", "acme"),
    ("https://www.researchgate.net/profile/A_{n}", "researchgate.net/profile/a_{n}", None, "article", None, "scholar", "a_{n}"),
    ("https://uni{n}.academia.edu/", "uni{n}.academia.edu", None, None, None, "scholar", "uni{n}"),
    ("ftp://files.org/{n}", "", None, None, None, None, None),
]


def link_ladder(spark: SparkSession, d: str) -> DataFrame:
    """Every rule table over addresses of every page."""
    made = F.explode(F.array(*(F.regexp_replace(F.lit(x[0]), r"\{n\}", F.col("page_id").cast("string")) for x in LADDER))).alias("u")
    u = F.col("u")
    return table(spark, d, "pages").select("page_id", made).select(
        "page_id", "u", urls.account(u).alias("account"), urls.link_kind(u).alias("kind"), urls.reference_kind(u).alias("becomes"), urls.paper_id(u).alias("paper"),
        urls.profile(u)["type"].alias("type"), urls.profile(u)["handle"].alias("handle"),
    )


def added_sources(spark: SparkSession, d: str) -> DataFrame:
    """Customers in clusters of a nation and segment; the largest orders are claims of their customers on others."""
    c = table(spark, d, "customer")
    heads = c.select(F.col("c_custkey").alias("entity"), F.min("c_custkey").over(Window.partitionBy("c_nationkey", "c_mktsegment")).alias("head"))
    big = table(spark, d, "orders").where("o_totalprice > 499000").select("o_custkey", "o_orderkey", (F.col("o_orderkey") % 997 + 1).alias("source"))
    return graph.added_sources(heads, big, "source", "o_custkey", "o_orderkey")


def people_groups(spark: SparkSession, d: str) -> DataFrame:
    """Writers (a source, a language and a shift) grouped by what they write."""
    writer = F.concat_ws("/", "source", "lang", (F.col("doc_id") % 5).cast("string"))
    groups, _ = people.people_map(table(spark, d, "documents").withColumn("writer", writer), "writer", "text", starts=1)
    return groups


QUERIES = {f.__name__: f for f in (link_ladder, added_sources, people_groups)}


def _ladder_sql() -> str:
    text = lambda x: "NULL::VARCHAR" if x is None else f"'{x}'"
    rows = ", ".join(f"({', '.join(map(text, x))})" for x in LADDER)
    names = ("u", "account", "kind", "becomes", "paper", "type", "handle")
    return f"SELECT page_id, {', '.join(f'replace({c}, {chr(39)}{{n}}{chr(39)}, page_id::VARCHAR) AS {c}' for c in names)} FROM pages, (VALUES {rows}) v({', '.join(names)})"


SQL = {
    "link_ladder": _ladder_sql(),
    "added_sources": "WITH RECURSIVE h AS (SELECT c_custkey AS entity, min(c_custkey) OVER (PARTITION BY c_nationkey, c_mktsegment) AS head FROM customer), "
    "c AS (SELECT a.head AS a, b.head AS b, o_orderkey AS w FROM orders JOIN h a ON a.entity = o_orderkey % 997 + 1 JOIN h b ON b.entity = o_custkey WHERE o_totalprice > 499000), "
    "j AS (SELECT a, arg_min(b, ROW(w, b)) AS b FROM c GROUP BY a HAVING NOT bool_or(a = b)), e AS (SELECT a, b FROM j UNION SELECT b, a FROM j), r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a) "
    "SELECT entity, least(head, coalesce((SELECT min(b) FROM r WHERE r.a = head), head)) AS head FROM h",
}
