"""Best-fit packing of documents into training sequences of several permitted lengths."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from marginalia.llm.words import has_words, n_words, numbered, row_key, slice_words, with_pieces
from marginalia.storage import materialise

#: Permitted sequence lengths in words.
SIZES = (256, 512, 1024, 2048)
#: Rows that are packed together; the last bins of such a group are all that packing in groups can waste.
GROUP = 20_000


def attention_cost(size: int) -> float:
    """Relative cost of a training sequence: a part for its length, one for attention over it, and one for each sequence."""
    return size + size * size / 8192 + 32


def best_fit(lengths: np.ndarray, sizes: tuple[int, ...] = SIZES, cost: Callable[[int], float] = attention_cost) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset, bin size) of each item; ``lengths`` are positive and at most the largest size.

    Items come longest first. Each goes to the open bin that it leaves the least room in. If there is none,
    the bin opened is the one of the least cost for each word it can still expect to hold: of the words that
    are left, as many as fit. When all items are in, each bin shrinks to the least size that holds its contents.
    """
    sizes = tuple(sorted(sizes))
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    left = int(lengths.sum())
    rooms: list[list[int]] = [[] for _ in range(sizes[-1] + 1)]  # open bins by room
    mask = 0  # bit r: some open bin has room r
    used: list[int] = []
    opened: list[int] = []
    for i in order.tolist():
        n = int(lengths[i])
        fit = mask >> n
        if fit:
            room = n + (fit & -fit).bit_length() - 1
            at = rooms[room].pop()
            if not rooms[room]:
                mask &= ~(1 << room)
        else:
            size = min((c for c in sizes if c >= n), key=lambda c: (cost(c) / min(c, left), c))
            at, room = len(used), size
            used.append(0)
            opened.append(size)
        bins[i], offsets[i] = at, used[at]
        used[at] += n
        left -= n
        if room > n:
            rooms[room - n].append(at)
            mask |= 1 << (room - n)
    final = np.array(sizes)[np.searchsorted(sizes, used)] if used else np.empty(0, np.int64)
    return bins, offsets, final[bins]


def _pack_group(rows: pd.DataFrame, sizes: tuple[int, ...]) -> pd.DataFrame:
    """Placements of one group's pieces, which all have words."""
    rows = rows.sort_values(["n_words", "_k", "_copy", "piece"], ascending=[False, True, True, True], kind="stable", ignore_index=True)
    bins, offsets, final = best_fit(rows["n_words"].to_numpy(), sizes)
    return rows.assign(bin_id=bins + (int(rows["shard"].iloc[0]) << 32), bin_size=final, bin_offset=offsets)


def pack(docs: DataFrame, sizes: tuple[int, ...] = SIZES, id_col: str = "doc_id", text_col: str = "text", group: int = GROUP) -> DataFrame:
    """One row per placed piece: doc_id, piece, start_word, n_words, bin_id, bin_size, bin_offset (and _k, _copy: which row of ``docs``).

    Documents longer than the largest size are cut into pieces of that many words and the rest; no word is
    dropped. Documents without words (null, empty) have one row with null bin columns. Null ids and repeated
    rows are packed like any other; extra columns of any name are ignored; an empty table gives an empty result. Rows are
    dealt by hash to groups of about ``group`` rows, which are packed apart, lengths only.
    """
    most = max(sizes)
    name, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    sized = materialise(docs.select(name.cast("long").alias("doc_id"), n_words(text).alias("n"), row_key(name, text).alias("_k")))
    sized = materialise(numbered(sized.where("n > 0")).union(sized.where("n = 0").select("*", F.lit(1), F.lit(1).cast("long"))))
    shards = max(1, -(-sized.count() // group))
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("n") - 1, F.lit(0)), F.lit(most).cast("long"))
    pieces = sized.select("doc_id", "_k", "_copy", "_copies", "n", F.posexplode(starts).alias("piece", "start_word")).select(
        "doc_id", "_k", "_copy", "_copies", "piece", "start_word", F.least(F.lit(most), F.col("n") - F.col("start_word")).cast("int").alias("n_words")
    )
    schema = "doc_id long, _k long, _copy int, _copies long, piece int, start_word long, n_words int, shard long, bin_id long, bin_size int, bin_offset int"
    dealt = pieces.where("n_words > 0").withColumn("shard", F.pmod(F.xxhash64("_k", "_copy", "piece"), F.lit(shards)))
    packed = dealt.groupBy("shard").applyInPandas(lambda rows: _pack_group(rows, sizes), schema).drop("shard")
    bare = pieces.where("n_words = 0")
    return packed.union(bare.select(*(F.col(c) if c in bare.columns else F.lit(None).cast(packed.schema[c].dataType).alias(c) for c in packed.columns)))


def packed_texts(docs: DataFrame, sizes: tuple[int, ...] = SIZES, id_col: str = "doc_id", text_col: str = "text", group: int = GROUP) -> DataFrame:
    """The placements of ``pack`` with each piece's text: bin_id, bin_size, bin_offset, doc_id, piece, start_word, n_words, text.

    A piece keeps what stands between its words, a document in one piece its whole text; documents without words
    come with their text and without a bin. Rows as for ``pack``.
    """
    name, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    fields = ("bin_id", "bin_size", "bin_offset", "piece", "start_word", "n_words")
    spots = pack(docs, sizes, id_col, text_col, group).where("n_words > 0").select("_k", "_copy", "_copies", *fields)
    rows = docs.select(name.cast("long").alias("doc_id"), text.alias("text"), row_key(name, text).alias("_k"))
    has = has_words(F.col("text"))
    out = with_pieces(numbered(rows.where(has)), spots)
    order = (*fields[:3], "doc_id", *fields[3:])
    out = out.select(*(F.col(f"_at.{c}").alias(c) if c in fields else F.col(c) for c in order), slice_words(F.col("text"), F.col("_at.start_word"), F.col("_at.n_words")).alias("text"))
    bare = {"piece": F.lit(0), "start_word": F.lit(0), "n_words": F.lit(0), "doc_id": F.col("doc_id"), "text": F.col("text")}
    return out.union(rows.where(~has).select(*(bare.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in out.schema)))
