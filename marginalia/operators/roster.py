"""Curated people and what arrives for them: listings, active queries, folded acts, reasons, looks and milestones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def roster(subscriptions: DataFrame, heads: DataFrame, key: str, confirmed: str, name: str) -> DataFrame:
    """(head, key, name, confirmed, times): one row for each person that is subscribed to, whatever head the subscription named.

    Subscriptions that now are of one person are folded to the one confirmed first; an id that is no entity any more is
    its own head. Rows without a confirmation aren't on the roster.
    """
    now = subscriptions.join(heads.select(F.col("entity").alias(key), "head"), key, "left").withColumn("head", F.coalesce("head", F.col(key).cast(dict(heads.dtypes)["head"]))).where(F.col(confirmed).isNotNull())
    first = F.min(F.struct(confirmed, key, name)).alias("x")
    return now.groupBy("head").agg(first, F.count("*").alias("times")).select("head", f"x.{key}", f"x.{name}", f"x.{confirmed}", "times")


def active(queries: DataFrame, watches: DataFrame, topics: DataFrame, context: DataFrame, key: str, topic: str) -> DataFrame:
    """Queries that some active topic watches, each once, with its context if there is one; ``topics`` says which are active."""
    on = watches.join(topics.where(F.coalesce("active", F.lit(False))), topic, "left_semi")
    return queries.join(on, key, "left_semi").join(context, key, "left")


def by_author(acts: DataFrame, author: str, viewer: str, at: str) -> DataFrame:
    """(author, acts, first, last) of all but one's own: how often someone's items were acted on."""
    others = acts.where(F.col(author).isNotNull() & ~F.coalesce(F.col(author) == F.col(viewer), F.lit(False)))
    return others.groupBy(author).agg(F.count("*").alias("acts"), F.min(at).alias("first"), F.max(at).alias("last"))


def paper_authors(papers: DataFrame, paper: str, authors: str) -> tuple[DataFrame, DataFrame]:
    """((id, name, orcid, papers), (skipped)): authors of all papers by their id: the first name and ORCID in the order of papers, how many papers; and how many entries have no id."""
    each = papers.select(F.col(paper).alias("paper"), F.posexplode(authors).alias("i", "a"))
    at = F.struct("paper", "i")
    known = each.where("a.id is not null").groupBy(F.col("a.id").alias("id"))
    first = lambda c: F.min_by(f"a.{c}", F.when(F.col(f"a.{c}").isNotNull(), at))
    return known.agg(first("display_name").alias("name"), first("orcid").alias("orcid"), F.countDistinct("paper").alias("papers")), each.agg(F.count_if(F.col("a.id").isNull()).alias("skipped"))


def collectors(names: list[str], runs: DataFrame, name: str, at: str, ok: str) -> DataFrame:
    """(name, runs, worked, failed): for every collector there should be, how often it ran, when it last worked, when it failed since; nulls for none."""
    every = runs.sparkSession.createDataFrame([(n,) for n in names], f"{name} string")
    worked = F.max(F.when(F.col(ok), F.col(at)))
    by = runs.groupBy(name).agg(F.count("*").alias("runs"), worked.alias("worked"), F.max(F.when(~F.col(ok), F.col(at))).alias("_failed"))
    return every.join(by, name, "left").select(name, F.coalesce("runs", F.lit(0)).alias("runs"), "worked", F.when(F.col("worked").isNull() | (F.col("_failed") > F.col("worked")), F.col("_failed")).alias("failed"))


def _counted(n: Column, one: str, many: str) -> Column:
    return F.concat(n.cast("string"), F.when(n == 1, f" {one}").otherwise(f" {many}"))


def reasons(signals: DataFrame, who: str) -> DataFrame:
    """(who, reason): one's own acts about a person as a phrase: endorsements, then what was saved and liked, then what others did.

    ``signals`` has who, signal, platform, n, paid and lists. What isn't known is not claimed: without a paid mark a
    subscription is just one.
    """
    n, papers = F.col("n"), F.col("platform").isin("scholar", "openalex", "papers")
    lists = F.concat(F.lit("in your "), F.array_join("lists", ", "), F.when(F.size("lists") > 1, " lists").otherwise(" list"))
    saved = F.when(F.col("platform") == "x", F.concat(F.lit("bookmarked "), n)).when(papers, F.concat(F.lit("saved "), _counted(n, "paper", "papers"))).otherwise(F.concat(F.lit("saved "), _counted(n, "post", "posts")))
    said = [
        ("follow", F.lit("you follow")), ("subscribe", F.when(F.col("paid"), "paid subscriber").otherwise("you subscribe")),
        ("list", F.when(F.size("lists") > 0, lists).otherwise(F.concat(F.lit("in "), n, F.lit(" of your lists")))), ("save", saved), ("like", F.concat(F.lit("liked "), n)),
        ("recommended", F.when(n <= 1, "recommended by one of your Oracles").otherwise(F.concat(F.lit("recommended by "), n, F.lit(" of your Oracles")))),
        ("coauthor", F.concat(F.lit("co-wrote "), _counted(n, "paper", "papers"), F.lit(" with one of your Oracles"))),
    ]
    part = F.lit(None).cast("struct<at:int,text:string>")
    for i, (kind, text) in reversed(list(enumerate(said))):
        part = F.when(F.col("signal") == kind, F.struct(F.lit(i).alias("at"), text.alias("text"))).otherwise(part)
    told = signals.select(who, part.alias("p")).where("p is not null").groupBy(who).agg(F.array_sort(F.collect_list("p")).alias("p"))  # a person's signals, one of each kind and platform
    return told.select(who, F.array_join(F.transform("p", lambda p: p["text"]), ", ").alias("reason"))


def look(arrived: DataFrame, filed: DataFrame, key: str, topic: str, at: str, since: Column, shown: int) -> DataFrame:
    """(topic, key, at, place, finds, older): what came since the last look, the newest ``shown`` of every topic, and of what no topic filed.

    An item of several topics is in each; ``finds`` is how many a topic has in all, ``older`` how many came before.
    """
    rows = arrived.select(key, at).join(filed.select(key, topic).distinct(), key, "left").withColumn("_new", F.coalesce(F.col(at) >= since, F.lit(False)))
    sizes = rows.groupBy(topic).agg(F.count_if("_new").alias("finds"), F.count_if(~F.col("_new")).alias("older")).withColumnRenamed(topic, "_topic")
    first = rows.where("_new").withColumn("place", F.row_number().over(Window.partitionBy(topic).orderBy(F.desc(at), key)).cast("long")).where(F.col("place") <= shown)
    return first.join(sizes, F.col(topic).eqNullSafe(F.col("_topic"))).select(topic, key, at, "place", "finds", "older")


def milestones(items: DataFrame, who: str, steps: dict[str, Column]) -> DataFrame:
    """(who, one flag for each step, next): what someone's items have reached, and the first step that none has; null when all have."""
    by = items.groupBy(who).agg(*(F.coalesce(F.bool_or(cond), F.lit(False)).alias(name) for name, cond in steps.items()))
    following = F.coalesce(*(F.when(~F.col(name), name) for name in steps))
    return by.withColumn("next", following)
