"""State that arrivals change: watermarks, look-backs, candidates, promotions, replaced and merged sets."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Hours that a pull looks back over its last one, days of a first look-back and of the longest, tries of a candidate.
OVERLAP_HOURS, FIRST_DAYS, MOST_DAYS, TRIES = 6, 14, 60, 5


def watermarks(pulls: DataFrame, keys: list[str], at: str, ok: Column) -> DataFrame:
    """(keys, mark, failures_since): the last time a pull of each pair worked; one that failed never moves it."""
    won = F.max(F.when(F.coalesce(ok, F.lit(False)), F.col(at))).over(Window.partitionBy(*keys))
    late = ~F.coalesce(ok, F.lit(False)) & (F.col("mark").isNull() | (F.col(at) > F.col("mark")))
    return pulls.withColumn("mark", won).groupBy(*keys, "mark").agg(F.count_if(late).alias("failures_since"))


def pull_since(mark: Column, now: Column) -> Column:
    """Where the next pull begins: some hours before the mark, for sources index late; without a mark two weeks back."""
    return F.coalesce(mark - F.make_dt_interval(hours=F.lit(OVERLAP_HOURS)), now - F.make_dt_interval(days=F.lit(FIRST_DAYS)))


def valid_lookback(days: Column) -> Column:
    """Whether a look-back of so many days may be asked for; null is none."""
    return F.coalesce(days.between(0, MOST_DAYS), F.lit(False))


def candidate_states(events: DataFrame, key: str, at: list[str], kept: Column, made: Column, failed: Column) -> DataFrame:
    """(key, state, tries): new, passed, kept, materialized or rejected.

    The first verdict stands. A kept candidate is materialized when a try succeeds, rejected when TRIES tries failed
    before one did; tries after that don't count.
    """
    order = Window.partitionBy(key).orderBy(*at)
    rows = events.select(key, *at, kept.alias("_kept"), F.coalesce(made, F.lit(False)).alias("_made"), F.coalesce(failed, F.lit(False)).alias("_failed"))
    rows = rows.withColumn("_verdict", F.first("_kept", ignorenulls=True).over(order)).withColumn("_live", F.coalesce(F.col("_verdict"), F.lit(False)))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    earlier = lambda c: F.coalesce(F.sum((F.col("_live") & F.col(c)).cast("int")).over(before), F.lit(0))
    rows = rows.withColumn("_open", F.col("_live") & (earlier("_made") == 0) & (earlier("_failed") < TRIES))
    by = rows.groupBy(key).agg(
        F.max(F.col("_verdict").cast("int")).alias("_v"), F.max((F.col("_open") & F.col("_made")).cast("int")).alias("_m"), F.count_if(F.col("_open") & F.col("_failed")).alias("_f"),
        F.count_if(F.col("_open") & (F.col("_made") | F.col("_failed"))).alias("tries"),
    )
    state = F.when(F.col("_v").isNull(), "new").when(F.col("_v") == 0, "passed").when(F.col("_m") == 1, "materialized").when(F.col("_f") >= TRIES, "rejected").otherwise("kept")
    return by.select(key, state.alias("state"), "tries")


def due(rows: DataFrame, ready: Column, tries: str, oldest: list[str], n: int) -> DataFrame:
    """The ``n`` oldest rows that are ready and have tries left."""
    return rows.where(ready & (F.col(tries) < TRIES)).orderBy(*oldest).limit(n)


def promoted(mode: Column, attested: Column, frontier: str = "frontier", human: str = "human") -> Column:
    """What was found by itself becomes a person's once someone saved it; nothing ever goes back."""
    return F.when((mode == frontier) & F.coalesce(attested, F.lit(False)), human).otherwise(mode)


def replaced(old: DataFrame, new: DataFrame, scope: list[str]) -> DataFrame:
    """``new`` in place of all old rows of the scopes it covers; the other scopes' rows stay. Both have the same columns."""
    return old.join(new.select(*scope).distinct(), scope, "left_anti").unionByName(new)


def inserted(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """``old`` and the rows of ``new`` whose key it doesn't have, one of each key."""
    fresh = new.join(old.select(*key), key, "left_anti").dropDuplicates(key)
    return old.unionByName(fresh)


def kept_field(old: DataFrame, new: DataFrame, key: str, field: str) -> DataFrame:
    """``new`` by key, but a field that it leaves null keeps the old value."""
    a = old.select(key, F.col(field).alias("_old"))
    return new.join(a, key, "left").withColumn(field, F.coalesce(field, "_old")).drop("_old")


def merged_maps(rows: DataFrame, key: str, order: list[str], of: str) -> DataFrame:
    """(key, merged): each key's maps in order, later values over earlier ones, nulls changing nothing.

    A value's row is found with an aggregate by key and field, so no map is gathered whole.
    """
    each = rows.select(key, *order, F.explode(of).alias("_f", "_v")).where("_v is not null")
    last = each.groupBy(key, "_f").agg(F.max_by("_v", F.struct(*order)).alias("_v"))
    return last.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("_f", "_v")))).alias("merged"))


def per_group(rows: DataFrame, group: str, order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each group, with ``place``; ranks beyond ``n`` are cut off before rows are exchanged."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(*order)).cast("long")).where(F.col("place") <= n)


def newest_first(rows: DataFrame, key: str, clock: str) -> DataFrame:
    """One row of each key, the newest."""
    columns = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct(clock, *columns)).alias("_r")).select(key, "_r.*")


def onto_heads(rows: DataFrame, members: DataFrame, key: str, head: str, name: str, confirmed: str) -> DataFrame:
    """``rows`` with ``known_as``, the name that the earliest confirmed member of their head has; null where there is none."""
    heads = members.groupBy(head).agg(F.min_by(name, F.struct(confirmed, name)).alias("known_as"))
    return rows.join(heads.withColumnRenamed(head, "_head"), F.col(key) == F.col("_head"), "left").drop("_head")


def tallies(hits: DataFrame, place: str, columns: list[str]) -> DataFrame:
    """(field, value, n, first_place): how often each value of each column occurs among ``hits``, and where first."""
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in columns)))
    return hits.select(place, each.alias("e")).where("e.value is not null").groupBy("e.field", "e.value").agg(F.count("*").alias("n"), F.min(place).alias("first_place"))


def by_id(rows: DataFrame, key: str, wanted: list[str], prefix: bool = False) -> DataFrame:
    """Rows whose text id is one of ``wanted``, or begins with one, whatever the case; none for no ids."""
    ids = [w.lower() for w in wanted]
    own = F.lower(F.col(key))
    cond = F.lit(False)
    for w in ids if prefix else ():
        cond = cond | own.startswith(w)
    return rows.where(cond if prefix else own.isin(ids) if ids else F.lit(False))


def cluster_sizes(members: DataFrame, head: str) -> DataFrame:
    """(size, clusters): how many clusters there are of each size."""
    return members.groupBy(head).agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("clusters"))


def _seeds(wanted: str, home_keys: list[str]) -> list[tuple[str, str, str]]:
    """(column, value, reason) of what a text may stand for."""
    text = wanted.strip().lower()
    out = [("id", key.lower(), "home_url") for key in home_keys]
    if re.fullmatch(r"(?!https?:)[^:]+:.+", text):
        return [*out, ("id", text, "entity_id")]
    handle = text.removeprefix("@")
    if handle and not re.search("[/:]", handle):
        out += [("id", f"{platform}:{handle}", "handle") for platform in ("github", "substack")] + [("handle", handle, "profile_handle")]
    return out


def named(people: DataFrame, key: str, head: str, handle: str, wanted: str, home_keys: list[str] | None = None) -> DataFrame:
    """(head, ids, matched_on): the clusters that a handle, an id or (as ``home_keys``) a home page names, each with all its ids.

    What the text may stand for is a small table, joined with ids and handles, case aside; of several reasons the first
    by name is told. A handle may stand in an id (``github:`` or ``substack:`` before it) or in its own column. A text
    that names no one gives no cluster.
    """
    seeds = people.sparkSession.createDataFrame(_seeds(wanted, home_keys or []), "by string, value string, why string")
    rows = people.select(F.coalesce(head, key).alias("head"), F.col(key).alias("id"), F.lower(key).alias("_id"), F.lower(handle).alias("_handle"))
    by = rows.withColumn("_v", F.explode(F.array(F.struct(F.lit("id").alias("by"), F.col("_id").alias("value")), F.struct(F.lit("handle").alias("by"), F.col("_handle").alias("value")))))
    hits = by.select("head", "_v.*").join(F.broadcast(seeds), ["by", "value"]).groupBy("head").agg(F.min("why").alias("matched_on"))  # a handful of seeds
    return rows.join(hits, "head").groupBy("head", "matched_on").agg(F.array_sort(F.collect_set("id")).alias("ids")).select("head", "ids", "matched_on")


def wanted_ids(clusters: DataFrame, explicit: list[str]) -> DataFrame:
    """(id): the ids of the clusters that a name gave and those given, once each; an empty table means that nothing matches."""
    given = clusters.sparkSession.createDataFrame([(x,) for x in explicit], "id string")
    return clusters.select(F.explode("ids").alias("id")).union(given).distinct()
