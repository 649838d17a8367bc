"""What posts link and whom they name: address shapes of a site's posts, links of rendered posts, owed links, candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from marginalia.functions import urls
from marginalia.functions.rules import within

#: Months as parts of paths.
MONTHS = "jan feb mar apr may jun jul aug sep sept oct nov dec january february march april june july august september october november december".split()
#: How a rendered post shows a quote, what a quote is made of, what media looks like, what a link ends with that isn't part of it.
QUOTING, AUTHOR = r"^\*\*Quoting\*\* \[@([^\]]+)\]", r'(?m)^author:\s*"?@([^"\s]+)"?\s*$'
MEDIA = (r"^!\[", r"^\[!\[", r"^\[Video\]\(")
QUOTED = ("^>", "^## Links", "^## Media", r"^- \[", r"^\*Image:\*", *MEDIA)
LINK, MARKED, BARE = r"""https?://[^\s)<>\]"'`*]+""", r"(?<!!)\[[^\]\n]*\]\((https?://[^)\s]+)\)", r"""(?<![(\[\w/])https?://[^\s<>()\[\]"']+"""
#: Names that aren't on the public web.
NOT_PUBLIC = ".localhost .local .internal .invalid .test .example .example.com .example.org .example.net"
#: Ways of naming a person, the strongest first.
KINDS = ("quote", "link", "mention")


def parts(url: Column) -> Column:
    """The parts of an address's path, in lower case."""
    return F.filter(F.split(F.regexp_extract(F.lower(F.trim(url)), r"^(?:[a-z][\w+.-]*://)?[^/?#]*([^?#]*)", 1), "/"), lambda p: p != "")


def shape(of: Column, sections: Column) -> Column:
    """A path's shape: YEAR, NUM, MONTH, the names of sections, SLUG for anything else. The last part is a name unless it has one or two digits."""
    last = F.size(of) - 1

    def token(p: Column, i: Column) -> Column:
        short = p.rlike(r"^\d{1,2}$")
        inner = F.when(p.rlike(r"^\d{4}$"), "YEAR").when(short, "NUM").when(p.isin(*MONTHS), "MONTH").when(F.array_contains(sections, F.concat_ws(":", i.cast("string"), p)), p).otherwise("SLUG")
        return F.when(i < last, inner).when(short, "NUM").otherwise("SLUG")

    return F.array_join(F.transform(of, token), "/")


def learned(feed: DataFrame, site: str, url: str) -> DataFrame:
    """(site, sections, shapes) of sites with two posts or more in their feed.

    A part of a path that two posts share, and at least half of those deep enough to have it, is a section; months and
    numbers aren't. Counts by place and part find them, no site's addresses are gathered.
    """
    own = feed.where(urls.host(F.col(url)) == urls.host(F.col(site))).select(F.col(site).alias("site"), parts(F.col(url)).alias("parts")).where(F.size("parts") > 0)
    many = own.groupBy("site").count().where("count >= 2").select("site")
    own = own.join(many, "site")
    each = own.select("site", F.posexplode(F.slice("parts", 1, F.size("parts") - 1)).alias("i", "part"))
    deep = each.groupBy("site", "i").agg(F.count("*").alias("deep"))
    shared = each.groupBy("site", "i", "part").agg(F.count("*").alias("n")).where((F.col("n") >= 2) & ~F.col("part").isin(*MONTHS) & ~F.col("part").rlike(r"^\d+$"))
    named = shared.join(deep, ["site", "i"]).where("2 * n >= deep").groupBy("site").agg(F.array_sort(F.collect_set(F.concat_ws(":", F.col("i").cast("string"), "part"))).alias("sections"))  # two of a depth at most
    known = own.join(named, "site", "left").withColumn("sections", F.coalesce("sections", F.array().cast("array<string>")))
    return known.select("site", "sections", shape(F.col("parts"), F.col("sections")).alias("shape")).distinct().groupBy("site", "sections").agg(F.array_sort(F.collect_set("shape")).alias("shapes"))


def fitting(pages: DataFrame, shapes: DataFrame, site: str, url: str) -> DataFrame:
    """``pages`` with ``fits``: whether an address has the shape of a post of its site, or of a numbered part of one; null for a site of which nothing was learned."""
    own = shapes.select(F.col("site").alias(site), "sections", "shapes")
    of = parts(F.col(url))
    whole = F.array_contains("shapes", shape(of, F.col("sections")))
    numbered = (F.size(of) > 1) & F.element_at(of, -1).rlike(r"^\d{1,2}$") & F.array_contains("shapes", shape(F.slice(of, 1, F.greatest(F.size(of) - 1, F.lit(1))), F.col("sections")))
    return pages.join(own, site, "left").withColumn("fits", F.when(F.col("shapes").isNotNull(), (F.size(of) > 0) & (whole | numbered))).drop("sections", "shapes")


def _any(line: Column, patterns: tuple[str, ...]) -> Column:
    return line.rlike("|".join(patterns))


def own_links(markdown: Column) -> Column:
    """The links of a rendered post that are its author's, in order, once each.

    Lines are folded with a state: a quote begins at its header and lasts while its lines look like a quote's; its links
    count only if the author quotes themself. Media lines and the lines between two rules at the top are no text.
    """
    text = F.coalesce(markdown, F.lit(""))
    front = F.regexp_extract(text, r"(?s)^---\n(.*?)\n---\n", 1)
    body = F.when(front != "", F.regexp_replace(text, r"(?s)^---\n.*?\n---\n", "")).otherwise(text)
    author = F.lower(F.regexp_extract(front, AUTHOR, 1))
    start = F.struct(F.lit(False).alias("quoted"), F.array().cast("array<string>").alias("found"))

    def step(state: Column, line: Column) -> Column:
        name, bare = F.regexp_extract(line, QUOTING, 1), F.trim(line)
        header = line.rlike(QUOTING)
        goes_on = state["quoted"] & ((bare == "") | _any(bare, QUOTED))
        quoted = F.when(header, F.lower(name) != author).otherwise(goes_on)
        here = F.transform(F.regexp_extract_all(line, F.lit(LINK), F.lit(0)), lambda u: F.regexp_replace(u, "[.,;:!?]+$", ""))
        return F.struct(quoted.alias("quoted"), F.when(header | goes_on | _any(bare, MEDIA), state["found"]).otherwise(F.concat(state["found"], here)).alias("found"))

    return F.array_distinct(F.aggregate(F.split(body, "\n"), start, step, lambda s: s["found"]))


def paper_links(markdown: Column, skip: Column) -> Column:
    """Links of a long text to papers, once each: of named links, then bare ones; images and ``skip`` are left out."""
    text = F.coalesce(markdown, F.lit(""))
    every = F.concat(F.regexp_extract_all(text, F.lit(MARKED), F.lit(1)), F.regexp_extract_all(text, F.lit(BARE), F.lit(0)))
    clean = F.array_distinct(F.transform(every, lambda u: F.regexp_replace(u, r"""[.,;:!?*_'"]+$""", "")))
    return F.filter(clean, lambda u: (urls.reference_kind(u) == "paper") & ~u.eqNullSafe(skip))


def candidate_key(url: Column) -> Column:
    """The source that a link points at, or null: not posts, papers and platforms' own pages, and nothing that isn't on the public web."""
    shared = F.lower(F.regexp_extract(url, r"(?i)^https?://open\.substack\.com/pub/([A-Za-z0-9-]+)", 1))
    key, said = urls.account(url), urls.profile(url)
    host = F.regexp_extract(key, "^[^/]*", 0)
    public = host.rlike(r"^(?:[a-z0-9-]+\.)+[a-z][a-z0-9-]*$") & ~within(url, lambda at: at.on(NOT_PUBLIC))
    owned = said.isNotNull() & ~said["type"].isin("x", "paper") & ~(said["type"].isin("github", "substack", "gitlab") & said["handle"].isNull())
    return F.when(shared != "", F.concat(shared, F.lit(".substack.com"))).when((key != "") & (key != "open.substack.com") & public & owned, key)


def linked_sources(posts: DataFrame, post: str, links: str) -> DataFrame:
    """(key, posts, example): the sources that posts link, by how many posts link them (not how often)."""
    each = posts.select(F.col(post).alias("post"), F.posexplode(links).alias("i", "url")).withColumn("key", candidate_key(F.col("url"))).where("key is not null")
    return each.groupBy("key").agg(F.countDistinct("post").alias("posts"), F.min_by("url", F.struct("post", "i")).alias("example"))


def people_named(namings: DataFrame, group: str, author: str, author_handle: str, kind: str, who: str, handle: str, order: list[str]) -> DataFrame:
    """(group, handle, kind, who, first): one row for each person that a group of posts names, its author aside.

    Handles are one whatever their case. The strongest naming counts (quote, link, mention), the first of equals; the id
    is that of it or, where it has none, of the strongest that has one.
    """
    rank = F.array_position(F.array(*(F.lit(k) for k in KINDS)), F.col(kind))
    key = F.lower(handle)
    rows = namings.where(F.col(handle).isNotNull() & (rank > 0) & ~F.coalesce(key == F.lower(author_handle), F.lit(False)) & ~F.coalesce(F.col(who) == F.col(author), F.lit(False)))
    at = F.struct(rank.alias("rank"), *order)
    best = rows.groupBy(group, key.alias("handle")).agg(F.min(at).alias("at"), F.min_by(who, F.when(F.col(who).isNotNull(), at)).alias("who"))
    return best.select(group, "handle", F.element_at(F.array(*(F.lit(k) for k in KINDS)), F.col("at.rank").cast("int")).alias("kind"), "who", F.col(f"at.{order[0]}").alias("first"))


def owed(links: DataFrame, post: str, url: str, own_handle: str, quoted: str, order: str, own_hosts: DataFrame | None = None) -> DataFrame:
    """(post, url, kind, via_quote): the links of a group of posts that are owed a record, once each.

    A link in the author's own text counts before one in a quote (``quoted``: whom, null in own text). Left out are
    links that become nothing, posts of the author (by the address's handle) and articles on hosts in ``own_hosts``
    (post, host); a link that is only worth a card is owed as ``card``.
    """
    first = F.struct(F.col(quoted).isNotNull().alias("q"), F.col(order).alias("o"))
    once = links.where(F.col(url).isNotNull()).groupBy(post, url).agg(F.min_by(F.struct(quoted, own_handle), first).alias("x"))
    kind = F.coalesce(urls.reference_kind(F.col(url)), F.when(urls.card_link(F.col(url)), "card"))
    own = F.lower(F.regexp_extract(url, r"(?i)^https?://[^/]+/+([^/?#]+)", 1)) == F.lower(f"x.{own_handle}")
    rows = once.withColumn("kind", kind).where("kind is not null").where(~F.coalesce((F.col("kind") == "x") & own, F.lit(False)))
    if own_hosts is not None:
        left = own_hosts.select(F.col(post).alias("_p"), F.col("host").alias("_h")).distinct()
        rows = rows.join(left, (F.col(post) == F.col("_p")) & (urls.host(F.col(url)) == F.col("_h")) & (F.col("kind") == "article"), "left_anti")
    return rows.select(post, url, "kind", F.col(f"x.{quoted}").alias("via_quote"))


def settled(owing: DataFrame, done: DataFrame, post: str, url: str) -> DataFrame:
    """(post, url): what is owed still, when ``done`` (url) have their record: a link settled once is settled for all posts that carry it."""
    return owing.select(post, url).join(done.select(url).distinct(), url, "left_anti").select(post, url)


def allowance(uses: DataFrame, who: str, at: str, most: int, window: str = "INTERVAL 1 HOUR") -> DataFrame:
    """``uses`` with ``held`` (how many uses the last ``window`` holds, this one included) and ``frees_at``: null while there is room for another, else when the use that fills the window leaves it.

    The use that fills it is ``most`` - 1 uses back: one lag and one sliding count in one order, no join.
    """
    order = Window.partitionBy(who).orderBy(at)
    filling = F.lag(at, most - 1).over(order) if most > 1 else F.col(at)
    leaves = filling + F.expr(window)
    since = Window.partitionBy(who).orderBy(F.unix_micros(F.col(at).cast("timestamp")))
    micros = F.unix_micros((F.lit("1970-01-01").cast("timestamp") + F.expr(window)))
    span = int(uses.sparkSession.range(1).select(micros).first()[0])
    return uses.withColumn("held", F.count("*").over(since.rangeBetween(-span + 1, 0))).withColumn("frees_at", F.when(leaves > F.col(at), leaves))


def screens(ranked: DataFrame, group: str, order: list[Column], limit: int, most: int) -> DataFrame:
    """(all columns, place, more): the first people of each group, ``limit`` or, with many groups, so few that ``most`` hold all of them; ``more`` is how many a group has besides.

    Ranks beyond the limit are cut before rows are exchanged; the groups' sizes come from a count.
    """
    sizes = ranked.groupBy(group).agg(F.count("*").alias("_size"))
    shown = sizes.withColumn("_shown", F.greatest(F.lit(0), F.least(F.lit(limit), F.floor(F.lit(most) / F.count("*").over(Window.partitionBy(F.lit(1)))))))  # a row for each group
    first = ranked.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(*order)).cast("long")).where(F.col("place") <= limit)
    return first.join(shown, group).where(F.col("place") <= F.col("_shown")).withColumn("more", F.col("_size") - F.col("_shown")).drop("_size", "_shown")
