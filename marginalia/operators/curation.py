"""Folds over acts and arrivals: interleaved arms, evidence, references, staged and widened state."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F


def interleaved(arms: list[tuple[str, DataFrame]], who: str, order: list[Column], n: int) -> DataFrame:
    """(who, basis, turn): rank 1 of each arm, then rank 2 and so on, ``n`` in all; a person in several arms stays in the first.

    Arms hold one row a person, so one window ranks all arms together; no arm is joined with another.
    """
    rows = reduce(DataFrame.unionByName, (rows.select(who, F.lit(i).alias("_arm"), F.lit(basis).alias("basis"), *(c.alias(f"_o{j}") for j, c in enumerate(order))) for i, (basis, rows) in enumerate(arms)))
    first = rows.withColumn("_first", F.min("_arm").over(Window.partitionBy(who))).where("_arm = _first")
    keys = [F.col(f"_o{j}").desc() for j in range(len(order))]
    turns = first.withColumn("turn", F.row_number().over(Window.partitionBy("_arm").orderBy(*keys, who)).cast("long")).where(F.col("turn") <= n)
    return turns.orderBy("turn", "_arm").limit(n).select(who, "basis", "turn")


def cluster_members(members: DataFrame, heads: DataFrame, member: str, head: str, wanted: str) -> DataFrame:
    """Rows of ``members`` whose id or whose head is wanted, once each: two joins on equality in place of one on either."""
    want = heads.select(F.col(wanted).alias("_w")).distinct()
    by_id = members.join(want, F.col(member) == F.col("_w"), "left_semi")
    by_head = members.join(want, F.col(head) == F.col("_w"), "left_semi")
    return by_id.unionByName(by_head).distinct()


def unearned(references: DataFrame, url: str, earns: Column) -> DataFrame:
    """Addresses that no referrer earns a record for."""
    return references.groupBy(url).agg(F.bool_or(F.coalesce(earns, F.lit(False))).alias("_any"), F.count("*").alias("referrers")).where("not _any").drop("_any")


def staged(known: DataFrame, arrived: DataFrame, key: str, clock: str) -> DataFrame:
    """Arrivals, one row a key: first and last sight, how often, and whether the key is new to ``known``."""
    once = arrived.groupBy(key).agg(F.min(clock).alias("first_seen"), F.max(clock).alias("last_seen"), F.count("*").alias("times"))
    seen = known.select(F.col(key).alias("_k")).distinct().withColumn("_known", F.lit(True))
    return once.join(seen, F.col(key) == F.col("_k"), "left").select(key, "first_seen", "last_seen", "times", F.col("_known").isNull().alias("is_new"))


def widened(old: DataFrame, new: DataFrame, key: str, low: str) -> DataFrame:
    """Coverage that only widens: the smaller bound of either side, a null one never wins."""
    a, b = old.select(key, F.col(low).alias("_a")), new.select(key, F.col(low).alias("_b"))
    return a.join(b, key, "full_outer").select(key, F.least("_a", "_b").alias(low))


def stricter(readings: DataFrame, key: str, reset: str, remaining: str) -> DataFrame:
    """One rate budget a key: the latest reset, and of its readings the least remaining."""
    strict = F.max(F.struct(F.col(reset), (-F.col(remaining)).alias("_r"))).alias("_s")
    return readings.groupBy(key).agg(strict).select(key, F.col(f"_s.{reset}").alias(reset), (-F.col("_s._r")).alias(remaining))


def without_gap(walks: DataFrame, key: str, started: str, finished: str, cursor: str) -> DataFrame:
    """What a walk may claim as seen: its start if it finished or reached the last cursor, otherwise the cursor it had."""
    return walks.withColumn("claimed", F.when(F.col(finished), F.greatest(started, cursor)).otherwise(F.col(cursor))).select(key, "claimed")


def verdicts(pairs: DataFrame, owner: str, found: str, ladder: list[tuple[str, Column]]) -> DataFrame:
    """One (owner, found, verdict): the candidate on the highest rung of the ladder, the smallest of equals; those on no rung are out."""
    rung = reduce(lambda acc, step: acc.when(step[1][1], step[0]), enumerate(ladder), F)  # F.when, then Column.when
    name = F.element_at(F.array(*(F.lit(n) for n, _ in ladder)), F.col("_rung") + 1)
    ranked = pairs.withColumn("_rung", rung).where("_rung is not null")
    best = ranked.withColumn("_n", F.row_number().over(Window.partitionBy(owner).orderBy("_rung", found))).where("_n = 1")
    return best.select(owner, found, name.alias("verdict"))


def self_thread(turns: DataFrame, thread: str, place: str, author: str) -> DataFrame:
    """The turns of each thread before anyone but its first author speaks."""
    w = Window.partitionBy(thread).orderBy(place)
    first = turns.withColumn("_a", F.first(author).over(w))
    return first.withColumn("_others", F.sum((~F.col(author).eqNullSafe(F.col("_a"))).cast("int")).over(w)).where("_others = 0").drop("_a", "_others")


#: What a post's credit is worth by how it names a person (any other way: as a mention), and what each further curator adds.
NAMING = {"quote": 1.0, "link": 0.75, "mention": 0.5}
FURTHER = 0.25


def credited(mentions: DataFrame, post: str, person: str, curator: str, kind: str, base: Column, parts: int | None = None) -> DataFrame:
    """(person, posts, curators, score): a post's credit ``base`` is split among all it names, by its strongest naming of each.

    Each further curator who named a person raises their sum by a quarter. Sums are exact decimals, so they don't
    depend on an order; scores have four places, halves to even. Mentions that are dealt by their post stay so;
    persons' curators are told apart in ``parts`` partitions.
    """
    worth = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for pair in NAMING.items() for x in pair)), F.col(kind)), F.lit(NAMING["mention"]))
    named = mentions.where(F.col(person).isNotNull() & F.col(post).isNotNull())
    once = named.groupBy(post, person, curator).agg(F.max(worth).alias("_w"), F.max(base).alias("_b"))
    own = Window.partitionBy(post)
    people = F.max("_place").over(own)  # of the last person: how many there are
    share = (F.col("_b") * F.col("_w") / people).cast("decimal(26,12)")
    shares = once.withColumn("_place", F.dense_rank().over(own.orderBy(person))).select(post, person, share.alias("_s"))
    by = shares.groupBy(post, person).agg(F.sum("_s").alias("_s")).groupBy(person).agg(F.count("*").alias("posts"), F.sum("_s").cast("double").alias("_s"))
    pairs = named.where(F.col(curator).isNotNull()).select(person, curator)
    pairs = (pairs.repartition(parts, person, curator) if parts else pairs).distinct()
    both = by.join(pairs.groupBy(person).agg(F.count("*").alias("curators")), person, "left").withColumn("curators", F.coalesce("curators", F.lit(0)))
    return both.select(person, "posts", "curators", F.bround(F.col("_s") * (1 + FURTHER * (F.col("curators") - 1)), 4).alias("score"))
