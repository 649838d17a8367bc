"""Raw JSON and XML records as columns: posts, accounts, scholarly works, feeds, site maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from marginalia.functions import dates, texts

ACCOUNT = "struct<rest_id:string,legacy:struct<name:string,screen_name:string,description:string,followers_count:bigint>>"
POST = f"struct<rest_id:string,core:struct<user_results:struct<result:{ACCOUNT}>>,legacy:struct<full_text:string,created_at:string,conversation_id_str:string,favorite_count:bigint>>"
WORK = (
    "struct<id:string,doi:string,title:string,publication_year:int,abstract_inverted_index:map<string,array<int>>,"
    "authorships:array<struct<author:struct<id:string,display_name:string,orcid:string>>>>"
)


def accounts(raw: DataFrame, column: str = "json") -> DataFrame:
    """(id, handle, name, bio, followers) of each account's JSON; malformed ones are left out."""
    u = F.from_json(column, ACCOUNT)
    rows = raw.select(u["rest_id"].alias("id"), u["legacy"]["screen_name"].alias("handle"), u["legacy"]["name"].alias("name"), u["legacy"]["description"].alias("bio"), u["legacy"]["followers_count"].alias("followers"))
    return rows.where("id is not null")


def posts(raw: DataFrame, column: str = "json") -> DataFrame:
    """(id, author, handle, conversation, at, text, likes) of each post's JSON; a post without a conversation begins its own."""
    p = F.from_json(column, POST)
    who = p["core"]["user_results"]["result"]
    rows = raw.select(
        p["rest_id"].alias("id"), who["rest_id"].alias("author"), who["legacy"]["screen_name"].alias("handle"), F.coalesce(p["legacy"]["conversation_id_str"], p["rest_id"]).alias("conversation"),
        dates.feed_instant(p["legacy"]["created_at"]).alias("at"), p["legacy"]["full_text"].alias("text"), p["legacy"]["favorite_count"].alias("likes"),
    )
    return rows.where("id is not null")


def works(raw: DataFrame, column: str = "json") -> DataFrame:
    """(id, doi, title, year, abstract, authors) of each work's JSON, the abstract put together from its word positions."""
    w = F.from_json(column, WORK)
    doi = F.regexp_replace(F.lower(w["doi"]), "^https?://(dx\\.)?doi\\.org/", "")
    names: Column = F.transform(w["authorships"], lambda a: a["author"])
    rows = raw.select(w["id"].alias("id"), doi.alias("doi"), w["title"].alias("title"), w["publication_year"].alias("year"), texts.from_positions(w["abstract_inverted_index"]).alias("abstract"), names.alias("authors"))
    return rows.where("id is not null")


def outcome(answer: Column, shape: str, key: str = "id") -> Column:
    """found, empty or malformed: an answer without a record is told from one that can't be read, which must not count as seen."""
    text = F.trim(F.coalesce(answer, F.lit("")))
    read = F.from_json(text, shape, {"mode": "PERMISSIVE"})
    whole = F.from_json(text, "map<string,string>").isNotNull() & text.rlike(r"^\{[\s\S]*\}$")
    return F.when(text.isin("", "{}", "[]", "null"), "empty").when(whole & read[key].isNotNull(), "found").otherwise("malformed")


def year_counts(found: DataFrame) -> DataFrame:
    return found.groupBy("year").agg(F.count("*").alias("n"))


def feed_dates(raw: DataFrame, column: str = "xml") -> DataFrame:
    """(link, at) of the items of RSS feeds, one feed a row; a link that repeats has its earliest date."""
    items = F.explode(F.regexp_extract_all(column, F.lit(r"(?s)<item\b[^>]*>(.*?)</item>"), F.lit(1)))
    one = raw.select(items.alias("i"))
    day = F.regexp_replace(F.regexp_extract("i", r"<pubDate>\s*(?:[A-Za-z]{3},\s*)?([^<]*?)\s*</pubDate>", 1), "GMT$", "+0000")
    rows = one.select(F.trim(F.regexp_extract("i", r"<link>\s*([^<]*)</link>", 1)).alias("link"), F.try_to_timestamp(day, F.lit("d MMM yyyy HH:mm:ss Z")).alias("at"))
    return rows.where("link <> ''").groupBy("link").agg(F.min("at").alias("at"))


def site_map(raw: DataFrame, column: str = "xml") -> DataFrame:
    """(url, lastmod, is_index) of site maps and their indexes, one document a row; lastmod is null where it isn't given."""
    entries = F.explode(F.regexp_extract_all(column, F.lit(r"(?s)<(?:url|sitemap)>(.*?)</(?:url|sitemap)>"), F.lit(1)))
    rows = raw.select(entries.alias("e"), F.col(column).rlike("<sitemapindex").alias("is_index"))
    last = F.nullif(F.regexp_extract("e", r"<lastmod>\s*([^<\s]*)\s*</lastmod>", 1), F.lit(""))
    return rows.select(F.regexp_replace(F.regexp_extract("e", r"<loc>\s*([^<\s]*)\s*</loc>", 1), "&amp;", "&").alias("url"), last.alias("lastmod"), "is_index").where("url <> ''")
