"""Mixing sources to target weights: blocks of words, drawn by shard and found through index permutations.

A source's words are a stream of its documents, cut into blocks of BLOCK words (the last one may be shorter).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from marginalia.llm.words import has_words, n_words, numbered, row_key, slice_words, with_pieces
from marginalia.storage import materialise

BLOCK = 64
SHARD = 1 << 16
SEED = 17
#: Positions that are drawn in one row's turn.
SPREAD = 1 << 16
#: Parts of a source whose sizes are summed apart, so that no running sum goes over a whole source.
PARTS = 4096
#: Two primes; a multiplier has no factor in common with a modulus that it doesn't divide.
PRIMES = (67108859, 33554393)
MOST = 3


def source_targets(sizes: DataFrame) -> DataFrame:
    """(source, source_no, weight, source_size, target): shares of all words by weight, none above three times its size.

    ``sizes`` has source and size. Sources in order of code points, null last, weigh 1, 2, 3 in turn. Resharing
    what is above the limits by weight until nothing is ends with target = least(limit, level * weight); over
    sources by rising limit / weight, the level is the largest of (what is left) / (weights left). The windows go
    over one row for each source.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    no = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    by = by.withColumn("source_no", no).withColumn("weight", (F.col("source_no") - 1) % 3 + 1)
    by = by.withColumn("limit", F.lit(MOST) * F.col("source_size"))
    rising = Window.orderBy(F.col("limit") / F.col("weight"), "source_no")
    before = F.coalesce(F.sum("limit").over(rising.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.sum("weight").over(rising.rowsBetween(0, Window.unboundedFollowing))
    everything = Window.partitionBy()
    by = by.withColumn("at", (F.sum("source_size").over(everything) - before) / left)
    return by.select(
        "source", "source_no", "weight", "source_size", F.least(F.col("limit").cast("double"), F.max("at").over(everything) * F.col("weight")).alias("target")
    )


def layout(docs: DataFrame, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> tuple[DataFrame, DataFrame]:
    """Each document's place in its source's stream of words, with the source's figures; and the documents without words.

    Columns: doc_id, _k, _copy and _copies (which row of ``docs`` it is), size, source_no, source_size, target, start
    (words of the source before it), n_blocks. Documents without words have doc_id, size, source_size and target.
    """
    name, text, source = (F.col(f"`{c}`") for c in (id_col, text_col, source_col))
    sizes = materialise(docs.select(name.alias("doc_id"), source.alias("source"), n_words(text).alias("size"), row_key(name, text, source).alias("_k")))
    by = materialise(source_targets(sizes))
    small = by.count() <= 100_000  # a row of under 100 bytes each, so under 10 MB
    named = sizes.join(F.broadcast(by) if small else by, sizes["source"].eqNullSafe(by["source"])).drop("source")
    bare = named.where("size = 0").select("doc_id", "size", "source_size", "target")
    named = numbered(named.where("size > 0")).withColumn("part", F.pmod("_k", F.lit(PARTS)))
    inside = Window.partitionBy("source_no", "part").orderBy("_k", "_copy").rowsBetween(Window.unboundedPreceding, -1)
    parts = named.groupBy("source_no", "part").agg(F.sum("size").alias("words"))
    ahead = Window.partitionBy("source_no").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("source_no", "part", F.coalesce(F.sum("words").over(ahead), F.lit(0)).alias("ahead"))
    placed = named.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(parts, ["source_no", "part"])
    columns = ("doc_id", "_k", "_copy", "_copies", "size", "source_no", "source_size", "target")
    return materialise(placed.select(*columns, (F.col("ahead") + F.col("inside")).alias("start"), F.ceil(F.col("source_size") / block).alias("n_blocks"))), bare


def _turn(x: Column, m: Column, *of: Column) -> Column:
    """x -> (prime * x + shift) mod m, with a shift that depends on ``of``; no step overflows for m up to 2 ** 42."""
    prime = F.when(m % PRIMES[0] == 0, PRIMES[1]).otherwise(PRIMES[0]).cast("long") % m
    high, low = F.shiftright(x, 20), x.bitwiseAND(F.lit((1 << 20) - 1))
    times = (F.shiftleft(prime * high % m, 20) + prime * low) % m
    return (times + F.pmod(F.xxhash64(F.lit(SEED), *of), m)) % m


def permuted(x: Column, m: Column, *of: Column) -> Column:
    """A pseudorandom permutation of 0 .. m-1 that depends on ``of``: turns modulo m, m - 1 (the last stays) and m."""
    once = _turn(x, m, F.lit(1), *of)
    twice = F.when(once < m - 1, _turn(once, F.greatest(m - 1, F.lit(1)), F.lit(2), *of)).otherwise(once)
    return _turn(twice, m, F.lit(3), *of)


def _dealt(rows: DataFrame, *by: str) -> DataFrame:
    """``rows``, few but each to be exploded into many, over all shuffle partitions; a stated number is not put together again."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def shard_counts(sources: DataFrame, shard: int = SHARD) -> DataFrame:
    """(shard, source_no, n_blocks, count): how many slots of each output shard each source gets.

    ``sources`` has source_no, source_size, target, n_blocks. The mix has as many slots as the targets need blocks. A
    source has as many of them as its target needs; all slots are dealt to the shards by one pseudorandom
    permutation. A shard's counts are so a multinomial draw with the targets' probabilities, given the sources'
    totals: of every shard by chance, of all shards together what the targets ask for.
    """
    some = sources.where("source_size > 0").withColumn("share", F.col("target") * F.col("n_blocks") / F.col("source_size"))
    order, everything = Window.orderBy("source_no"), Window.partitionBy()  # a row for each source
    some = some.withColumn("upto", F.round(F.sum("share").over(order.rowsBetween(Window.unboundedPreceding, 0))).cast("long"))
    some = some.withColumn("after", F.coalesce(F.lag("upto").over(order), F.lit(0))).withColumn("slots", F.max("upto").over(everything))
    some = some.withColumn("per", F.greatest(F.lit(shard).cast("long"), 4 * F.count("*").over(everything))).where("upto > after")
    spread = F.explode(F.expr(f"sequence(after div {SPREAD}, (upto - 1) div {SPREAD})"))
    turns = _dealt(some.select("source_no", "n_blocks", "slots", "per", "after", "upto", spread.alias("turn")), "source_no", "turn")
    first, last = F.greatest(F.col("after"), F.col("turn") * SPREAD), F.least(F.col("upto"), (F.col("turn") + 1) * SPREAD) - 1
    slots = turns.select("source_no", "n_blocks", "slots", "per", F.explode(F.sequence(first, last)).alias("position"))
    return slots.groupBy(F.floor(permuted(F.col("position"), F.col("slots"), F.lit("slot")) / F.col("per")).alias("shard"), "source_no", "n_blocks").agg(F.count("*").alias("count"))


def draw(sources: DataFrame, shard: int = SHARD) -> DataFrame:
    """(source_no, block_no, epoch): every block that the mix takes, once for each time it takes it.

    Slots of a source are counted on over the shards; the k-th takes, in epoch k div n_blocks, the block that
    the epoch's permutation puts at k mod n_blocks. No block is taken over three times.
    """
    before = F.sum("count").over(Window.partitionBy("source_no").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    counts = _dealt(shard_counts(sources, shard).withColumn("before", F.coalesce(before, F.lit(0))), "source_no", "shard")
    slots = counts.select("source_no", "n_blocks", "before", F.explode(F.expr("sequence(0L, count - 1)")).alias("j"))
    slots = slots.select("source_no", "n_blocks", (F.col("before") + F.col("j")).alias("k"))
    slots = slots.where(F.col("k") < MOST * F.col("n_blocks")).withColumn("epoch", F.expr("k div n_blocks"))
    return slots.select("source_no", permuted(F.col("k") % F.col("n_blocks"), F.col("n_blocks"), F.col("source_no"), F.col("epoch")).alias("block_no"), "epoch")


def taken_pieces(placed: DataFrame, block: int = BLOCK) -> DataFrame:
    """(_k, _copy, _copies, epoch, from_word, words): the pieces of documents in the blocks that the mix takes."""
    sources = placed.select("source_no", "source_size", "target", "n_blocks").distinct()
    stop = F.col("start") + F.col("size")
    pieces = placed.withColumn("block_no", F.explode(F.expr(f"sequence(start div {block}, (start + size - 1) div {block})")))
    low, high = F.greatest(F.col("start"), F.col("block_no") * block), F.least(stop, (F.col("block_no") + 1) * block)
    pieces = pieces.select("_k", "_copy", "_copies", "source_no", "block_no", (low - F.col("start")).alias("from_word"), (high - low).alias("words"))
    # the planner takes the size of the drawn blocks, which an explode makes, for that of the source table
    return pieces.join(draw(sources).hint("merge"), ["source_no", "block_no"]).drop("source_no", "block_no")


def mix(docs: DataFrame, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per document: doc_id, size, source_size, target (its source's) and taken, the words the mix takes of it.

    A null source is a source of its own, weighed last; null and empty texts have size 0 and give nothing; null
    ids and repeated rows are documents like any other; extra columns of any name are ignored; an empty table
    gives an empty result. Everything is a function of ids, texts and sources, so reruns agree.
    """
    placed, bare = layout(docs, block, id_col, text_col, source_col)
    taken = taken_pieces(placed, block).groupBy("_k", "_copy").agg(F.sum("words").alias("taken"))
    out = placed.join(taken, ["_k", "_copy"], "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
    return out.union(bare.withColumn("taken", F.lit(0).cast("long")))


def mixed_documents(docs: DataFrame, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix as rows with the columns of ``docs``: for each pass over a source, the runs of words taken of each document.

    A document that a pass takes whole keeps its text; other runs keep what stands between their words. n_chars, if
    there is such a column, is that of the new text. Rows as for ``mix``; columns may have any name.
    """
    placed, _ = layout(docs, block, id_col, text_col, source_col)
    spot = Window.partitionBy("_k", "_copy", "epoch").orderBy("from_word")
    runs = taken_pieces(placed, block)
    fresh = F.coalesce((F.lag(F.col("from_word") + F.col("words")).over(spot) != F.col("from_word")).cast("int"), F.lit(1))
    runs = runs.withColumn("fresh", fresh).withColumn("run", F.sum("fresh").over(spot))
    runs = runs.groupBy("_k", "_copy", "_copies", "epoch", "run").agg(F.min("from_word").alias("from_word"), F.sum("words").alias("words")).drop("epoch", "run")
    name, text, source = (F.col(f"`{c}`") for c in (id_col, text_col, source_col))
    rows = docs.where(has_words(text)).select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), row_key(name, text, source).alias("_k"))
    out = with_pieces(numbered(rows), runs).withColumn("new", slice_words(F.col("row")[text_col], F.col("_at.from_word"), F.col("_at.words")))
    fresh = {text_col: F.col("new"), "n_chars": F.length("new").cast("long")}
    return out.select(*(fresh.get(c, F.col("row")[c]).alias(c) for c in docs.columns))
