"""Near-duplicate documents: SimHash fingerprints joined by walking pairs of nodes of one binary trie."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F, types as T

from marginalia.operators.graph import connected_components
from marginalia.storage import materialise

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
SEED = 42
BITS = 64
#: Node pairs that are walked at once; more are walked in turn, so that memory stays bounded.
FRONTIER = 1 << 20


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """SimHash of the lower-cased (A-Z) word shingles, repeats included, as a signed 64-bit integer.

    A bit is 1 if it is set in more than half of the shingles' XXH64 values. Fewer words than a shingle takes
    make one shingle; no words give 0.
    """
    found = (text or "").encode().translate(LOWER).split()
    if not found:
        return 0
    joined, digest = b" ".join(found), xxhash.xxh64_intdigest
    ends = list(accumulate(map(len, found), lambda at, n: at + n + 1))
    starts = [0, *(e + 1 for e in ends)]
    hashes = np.array([digest(joined[s:e], SEED) for s, e in zip(starts, ends[shingle - 1 :] or ends[-1:])], dtype="<u8")
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):  # 64 bytes a shingle are unpacked at a time
        ones += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


@F.pandas_udf(T.LongType())
def simhash64(texts: pd.Series) -> pd.Series:
    return pd.Series([fingerprint(t) for t in texts], dtype="int64")


def walk_pairs(keys: np.ndarray, values: np.ndarray, budget: int, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of rows that have one key and whose values (``bits`` wide, distinct within a key) differ in at most ``budget`` bits.

    Rows are sorted by (key, value): each key's rows are a binary trie and a node is a range of rows. Pairs of
    nodes of one depth go down together, starting from (root, root); a step into unlike children costs one bit,
    and a pair whose cost exceeds the budget is dropped with all that is below it.
    """
    if not len(keys):
        return
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    last = np.r_[first[1:], len(keys)]
    many = last - first > 1
    first, last = first[many], last[many]
    todo = [(bits - 1, first, last, first, last, np.zeros(len(first), np.int8))]
    ones = {}
    while todo:
        bit, lo, hi, lo2, hi2, cost = todo.pop()
        if not len(lo):
            continue
        if len(lo) > FRONTIER:
            cut = len(lo) // 2
            todo += [(bit, *(x[:cut] for x in (lo, hi, lo2, hi2, cost))), (bit, *(x[cut:] for x in (lo, hi, lo2, hi2, cost)))]
            continue
        if bit < 0:
            yield lo, lo2
            continue
        if bit not in ones:
            ones[bit] = np.r_[0, np.cumsum(values >> np.uint64(bit) & np.uint64(1), dtype=np.int64)]
        c = ones[bit]
        mid, mid2 = hi - (c[hi] - c[lo]), hi2 - (c[hi2] - c[lo2])
        other = lo != lo2
        parts = [(lo, mid, lo2, mid2, cost), (mid, hi, mid2, hi2, cost), (lo, mid, mid2, hi2, cost + 1)]
        parts.append(tuple(x[other] for x in (mid, hi, lo2, mid2, cost + 1)))
        nxt = [np.concatenate(x) for x in zip(*parts)]
        a, b, a2, b2, k = nxt
        keep = (b > a) & (b2 > a2) & (k <= budget) & ((a != a2) | (b - a > 1))
        todo.append((bit - 1, *(x[keep] for x in nxt)))


def stars(a: np.ndarray, b: np.ndarray, size: int) -> np.ndarray:
    """The smallest row that each of ``size`` rows reaches over the pairs (a, b)."""
    root = np.arange(size)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _blocks(bits: int, parts: int) -> list[tuple[int, int]]:
    """(shift, width) of ``parts`` blocks that make up ``bits`` bits."""
    edges = [bits * i // parts for i in range(parts + 1)]
    return [(lo, hi - lo) for lo, hi in zip(edges, edges[1:])]


def _links(batches: Iterator[pa.RecordBatch], budget: int) -> Iterator[pa.RecordBatch]:
    """Star edges (a, b) of the components that the rows of each key make; rows come sorted by key and value."""
    held: list[pa.Table] = []

    def out(t: pa.Table) -> pa.RecordBatch:
        key, fp, doc = (t.column(c).to_numpy() for c in ("key", "fp", "doc"))
        fp = fp.view(np.uint64)
        order = np.lexsort((fp, key))
        key, fp, doc = key[order], fp[order], doc[order]
        root = np.arange(len(key))
        for a, b in walk_pairs(key, fp, budget, BITS):
            root = stars(np.r_[a, np.arange(len(key))], np.r_[b, root], len(key))
        low = np.full(len(key), np.iinfo(np.int64).max)
        np.minimum.at(low, root, doc)
        low = low[root]
        linked = low != doc
        return pa.RecordBatch.from_pydict({"a": doc[linked], "b": low[linked]}, schema=pa.schema([("a", pa.int64()), ("b", pa.int64())]))

    for batch in batches:
        held.append(pa.Table.from_batches([batch]))
        key = batch.column("key").to_numpy()
        if len(key) and sum(x.num_rows for x in held) > 1 << 18 and key[0] != key[-1]:
            cut = int(np.searchsorted(key, key[-1]))  # the last key may go on in the next batch
            yield out(pa.concat_tables([*held[:-1], held[-1].slice(0, cut)]))
            held = [held[-1].slice(cut)]
    if held:
        yield out(pa.concat_tables(held))


def hamming_links(prints: DataFrame, budget: int = 3, hot: int = 20_000) -> DataFrame:
    """Star edges (a, b) between documents whose fingerprints differ in at most ``budget`` bits.

    ``prints`` has one row (fp, doc) for each distinct fingerprint. Of ``budget`` + 1 blocks of bits one is
    equal in both of a pair, so each block's value names a subtrie and all links lie inside subtries. A subtrie
    of over ``hot`` rows is dealt out again by blocks of the bits that it leaves, by the same argument.
    Each task gives stars, never all pairs, of the components it finds.
    """
    parts = _blocks(BITS, budget + 1)
    fp = F.col("fp")

    def deal(shift: int, width: int) -> "F.Column":
        return F.shiftrightunsigned(fp, shift).bitwiseAND((1 << width) - 1)

    top = prints.select(
        "fp", "doc", F.explode(F.array(*(F.struct(F.lit(i).alias("block"), deal(s, w).alias("value")) for i, (s, w) in enumerate(parts)))).alias("at")
    ).select("fp", "doc", "at.block", "at.value")
    sizes = top.groupBy("block", "value").count().where(F.col("count") > hot).select("block", "value", F.lit(True).alias("large"))
    top = top.join(sizes, ["block", "value"], "left")
    deeper = []
    for i, (s, w) in enumerate(parts):
        rest = [(at, 1) for at in range(BITS) if not s <= at < s + w]
        runs = [rest[j * len(rest) // (budget + 1) : (j + 1) * len(rest) // (budget + 1)] for j in range(budget + 1)]
        masks = [sum(1 << at for at, _ in run) for run in runs]
        signed = [m - (1 << 64) if m >= 1 << 63 else m for m in masks]
        deeper.append(F.array(*(F.xxhash64(F.lit(i), "value", F.lit(j), fp.bitwiseAND(F.lit(m))) for j, m in enumerate(signed))))
    deep = F.element_at(F.array(*deeper), F.col("block") + 1)
    keyed = top.select("fp", "doc", F.explode(F.when(F.col("large"), deep).otherwise(F.array(F.xxhash64(F.lit(-1), "block", "value")))).alias("key"))
    dealt = keyed.repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(lambda batches: _links(batches, budget), "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every document; fingerprints link at ``budget`` or fewer unlike bits.

    component_id is the smallest id that a document reaches over links, itself included. Null and empty texts
    have fingerprint zero and link like any other. Rows with a null id get a fingerprint and the component of
    the other documents with that fingerprint (null if there are none). Repeated ids keep all their rows. Other
    columns of ``docs`` are ignored, an empty table gives an empty result.
    """
    prints = materialise(docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), simhash64(F.col(f"`{text_col}`")).alias("fp")))
    reps = prints.groupBy("fp").agg(F.min("doc_id").alias("doc"))
    parts = connected_components(hamming_links(reps.where("doc is not null"), budget))
    named = reps.join(parts, F.col("doc") == F.col("node"), "left").select("fp", F.coalesce("component", "doc").alias("component_id"))
    return prints.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: int = 3) -> DataFrame:
    """``docs`` without near-duplicates: of each component the row with the smallest id stays (rows with null ids stay too).

    Of rows that repeat an id one stays, that of the smallest text hash. Null and empty texts are near-duplicates of
    each other. All columns stay, of any name; an empty table gives an empty result.
    """
    kept = near_duplicates(docs, id_col, text_col, budget).where("doc_id = component_id").select("doc_id").distinct()
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    rows = docs.select(row, F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.xxhash64(F.col(f"`{text_col}`")).alias("h"))
    one = F.row_number().over(Window.partitionBy("doc_id").orderBy("h"))
    stays = rows.where("doc_id is not null").join(kept, "doc_id", "left_semi").withColumn("one", one).where("one = 1")
    return stays.select("row").union(rows.where("doc_id is null").select("row")).select("row.*")
