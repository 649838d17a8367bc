"""Importance resampling towards a target distribution: hashed n-gram buckets, gains, and a draw by perturbed scores."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from marginalia.storage import materialise

#: Bytes of a text in which all but ASCII letters, digits and what isn't ASCII become spaces and A-Z lower case.
WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))
#: A word, or a pair of words, that makes up one in so many of all is sent to all tasks, so there are at most as many.
HEAD = 8192
BUCKETS, LEAST_WORDS, PERCENT, SEED = 10_000, 20, 10, 2024


class _States(dict):
    """CRC states of frequent words; any other word is worked out when asked for, and not kept."""

    def __missing__(self, word: bytes) -> int:
        return crc32(word)


class _PairStates(dict):
    """CRC states of frequent pairs of words; any other pair goes on from the state of its first word."""

    def __init__(self, pairs: dict, words: _States) -> None:
        super().__init__(pairs)
        self.words = words

    def __missing__(self, pair: tuple[bytes, bytes]) -> int:
        return crc32(b" " + pair[1], self.words[pair[0]])


class Vocabulary:
    """The head of the vocabulary with exact CRC states; what isn't in it gets the same states by direct CRC."""

    def __init__(self, words: list[bytes], pairs: list[tuple[bytes, bytes]]) -> None:
        self.words = _States({w: crc32(w) for w in words})
        self.pairs = _PairStates({p: crc32(b" ".join(p)) for p in pairs}, self.words)

    def __reduce__(self):
        return Vocabulary, (list(self.words), list(self.pairs))

    def states(self, words: list[bytes], n: int) -> np.ndarray:
        """CRC-32 of all runs of 1 to ``n`` words of a text, joined by single spaces."""
        found = [np.fromiter(map(self.words.__getitem__, words), np.uint32, len(words))]
        if n > 1 and len(words) > 1:
            found.append(np.fromiter(map(self.pairs.__getitem__, zip(words, words[1:])), np.uint32, len(words) - 1))
        for k in range(3, min(n, len(words)) + 1):  # a run goes on from the state of the run that is a word shorter
            found.append(np.fromiter((crc32(b" " + w, int(s)) for s, w in zip(found[-1], words[k - 1 :])), np.uint32, len(words) - k + 1))
        return np.concatenate(found)


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(WORDS).split()


def _most_used(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """The words and pairs that a task's rows use most. Rare ones are forgotten now and then: the head makes work quicker and changes no result."""
    words, pairs = Counter(), Counter()
    for batch in batches:
        for text in batch.column(0).to_pylist():
            found = words_of(text)
            words.update(found)
            if n > 1:
                pairs.update(zip(found, found[1:]))
            for seen in (words, pairs):
                if len(seen) > 64 * HEAD:
                    kept = seen.most_common(8 * HEAD)
                    seen.clear()
                    seen.update(dict(kept))
    rows = [(w, None, c) for w, c in words.most_common(HEAD)] + [(a, b, c) for (a, b), c in pairs.most_common(HEAD)]
    if rows:
        yield pa.RecordBatch.from_pydict(dict(zip(("a", "b", "n"), map(list, zip(*rows)))), schema=pa.schema([("a", pa.binary()), ("b", pa.binary()), ("n", pa.int64())]))


def vocabulary(texts: DataFrame, n: int) -> Vocabulary:
    """The head: the words, and the pairs, that make up one in ``HEAD`` or more of what tasks counted; at most ``HEAD`` of either reach the driver."""
    counts = materialise(texts.mapInArrow(lambda b: _most_used(b, n), "a binary, b binary, n long").groupBy("a", "b").agg(F.sum("n").alias("n")))
    pair = F.col("b").isNotNull()
    whole = counts.groupBy(pair.alias("pair")).agg((F.sum("n") / HEAD).alias("least"))  # two rows
    head = counts.join(F.broadcast(whole), pair == F.col("pair")).where("n >= least").select("a", "b").collect()
    return Vocabulary([bytes(r.a) for r in head if r.b is None], [(bytes(r.a), bytes(r.b)) for r in head if r.b is not None])


def bucket_totals(texts: DataFrame, head: Vocabulary, n: int, buckets: int) -> np.ndarray:
    """How many features of all texts fall in each bucket: tasks count in an array of that size, and only its sums are exchanged."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                total += np.bincount(head.states(words_of(text), n) % buckets, minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bucket": at, "n": total[at]}, schema=pa.schema([("bucket", pa.int64()), ("n", pa.int64())]))

    out = np.zeros(buckets, np.int64)
    for r in texts.mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # a row for each bucket at most
        out[r.bucket] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of a bucket's smoothed shares of the target and of the source, rounded down."""
    k, s_all, t_all = len(source), int(source.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((float(t) + 1) * (s_all + k) / ((float(s) + 1) * (t_all + k)))) for s, t in zip(source, target)], np.int64)


def weights(docs: DataFrame, id_col: str, text_col: str, head: Vocabulary, gain: np.ndarray, n: int) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of each document: the sum of its features' gains."""
    schema = pa.schema([(c, pa.int64()) for c in ("doc_id", "n_words", "n_features", "weight")])

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                words = words_of(text)
                found = head.states(words, n) % len(gain)
                rows.append((len(words), len(found), int(gain[found].sum())))
            columns = [pa.array(c, pa.int64()) for c in zip(*rows)] if rows else [pa.array([], pa.int64())] * 3
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], schema=schema)

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("binary").alias("text"))
    return rows.mapInArrow(weigh, "doc_id long, n_words long, n_features long, weight long")


def perturbation(doc_id: Column, seed: int) -> Column:
    """Gumbel noise in thousandths, rounded down, from a hash of the seed and the id (a null id: of the seed alone)."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296)))


def ranked(rows: DataFrame, order: list[Column]) -> DataFrame:
    """``rows`` with ``rank`` (1, 2, ...) in ``order`` over all rows.

    Rows are dealt by ranges of the order and sorted there, written with their place in their range, and a range's
    first rank follows from the ranges' sizes: a small row for each partition, no window over all rows.
    """
    tie = F.monotonically_increasing_id()  # rows that tie may be dealt to several ranges
    sorted_ = rows.withColumn("_tie", tie).repartitionByRange(*order, "_tie").sortWithinPartitions(*order, "_tie").drop("_tie")
    placed = materialise(sorted_.withColumn("_at", F.monotonically_increasing_id()))
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = sizes.select("_part", before.alias("_before"))  # a row for each partition
    return placed.join(F.broadcast(first), part == F.col("_part")).withColumn("rank", F.col("_before") + place + 1).drop("_at", "_part", "_before")


def resample(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", n: int = 1, buckets: int = BUCKETS,
    least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED,
) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every document, drawn towards the texts of ``target``.

    Features are all runs of 1 to ``n`` words of a whole text, repeats counted, in ``buckets`` buckets by CRC-32. A
    document's weight sums the gains of its features, its score adds Gumbel noise by its id; of the documents of
    ``least_words`` words or more, ``percent`` in a hundred of the highest score are drawn (ties go to the smaller
    id, null ids last) and have a rank, all others have null.

    Null and empty texts have no features and weight 0. Rows that repeat an id are documents of their own, with
    the noise of that id. Other columns are ignored, whatever their names; an empty target, an empty table or both
    give what the formulas say (an empty table an empty result).
    """
    texts = [d.select(F.col(f"`{c}`").cast("binary").alias("text")) for d, c in ((docs, text_col), (target, target_col))]
    head = vocabulary(texts[0], n)
    gain = gains(*(bucket_totals(t, head, n, buckets) for t in texts))
    weighed = weights(docs, id_col, text_col, head, gain, n).withColumn("score", F.col("weight") + perturbation(F.col("doc_id"), seed))
    scored = materialise(weighed)
    enough = F.col("n_words") >= least_words
    most = scored.where(enough).count() * percent // 100
    placed = ranked(scored.where(enough), [F.desc("score"), F.asc_nulls_last("doc_id")])
    drawn = placed.withColumn("rank", F.when(F.col("rank") <= most, F.col("rank")).cast("long"))
    return drawn.unionByName(scored.where(~enough).withColumn("rank", F.lit(None).cast("long"))).select("doc_id", "n_features", "weight", "score", "rank")
