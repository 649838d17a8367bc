"""Substring dedup: passages that documents share, alike paragraphs by MinHash bands and equal ones to their true ends.

Alike paragraphs: lines, and in long lines also parts cut where the words themselves say so (a word pair whose hash is
the least of its neighbourhood). Equal passages: every run of LEAST_WORDS words has an anchor, the part of it whose
whose hash is least, and equal runs have equal anchors. Texts are read twice and never shuffled: first the hashes of all
anchors and bands are dealt out; what meets there is put into filters of bounded size, and then only the anchors and
paragraphs that pass a filter are sent, with the words around them. What passes in error meets nothing. Of anchors that
very many places have, the runs are sent by hashes of their own, and their firsts are found by an aggregation.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F, types as T

from marginalia.llm.filters import KeyFilter
from marginalia.operators.graph import connected_components
from marginalia.storage import settled

#: A cut needs the least pair hash of this many words to either side; no part of a long line is longer than LONGEST words.
REACH = 24
LONGEST = 128
SHINGLE = 5
SIMILARITY = 0.8
#: Bands of ROWS hashes each: paragraphs of Jaccard 0.8 meet in one of them with probability 1 - (1 - 0.8 ** 2) ** 5 = 0.994,
#: those of 0.2, which share no more than a common phrase, with 0.18 (three bands of one hash: 0.992 and 0.49).
BANDS, ROWS = 5, 2
FACTORS = np.random.default_rng(11).integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Words in a row that a document must share with others, counted to the true ends of what is shared.
LEAST_WORDS = 16
#: Bits of a filter for what has met: eight for each key and a power of two, in these bounds (of more keys more pass in error).
FILTER_LEAST, FILTER_MOST = 1 << 20, 1 << 28
#: An anchor that so many places have isn't gone through in one task: its runs are dealt one by one.
HOT = 1 << 15
#: Parts that the rows of a common paragraph or shingle are dealt into for joins.
SALT = 16
#: A band key of more unlike paragraphs isn't verified as one group: they meet by their rarest shingles instead.
GROUP = 256

#: Bytes of texts that are worked on together.
TOGETHER = 1 << 20
#: The primes of XXH64.
XXH = [np.uint64(x) for x in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261)]

#: The number of a text's first part, above those of its lines.
PARTS = 1 << 28

KEYS = "kind int, key long, hash long"
PLACES = "kind int, key long, doc long, tag int, at int, n int, chunk int, room int, around binary, text string"
FOUND = "kind int, key long, doc long, tag int, start int, n int, chunk int, first_doc_id long, first_at int, removed boolean, text string"
SPANS = "doc_id long, tag int, start_word long, n_words long, first_doc_id long, removed boolean"
PIECE = ("key", "doc", "tag", "start", "n", "first_doc_id", "first_at", "removed")

def _mix(a: np.ndarray, b: np.ndarray | np.uint64) -> np.ndarray:
    x = (a ^ (a >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + b
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def _window_least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours, by windows of doubled width."""
    have = 1
    while 2 * have <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (width - have)], x[width - have :])


def cuts(hashes: np.ndarray, lines: np.ndarray, reach: int = REACH) -> np.ndarray:
    """First words of the parts of lines that begin at the words ``lines`` and follow each other, given all words' hashes."""
    n, wide = len(hashes), 2 * reach + 1
    edges = lines
    if n > wide:
        with np.errstate(over="ignore"):
            pair = _mix(hashes[:-1], hashes[1:])
        found = np.flatnonzero(_window_least(pair, wide) == pair[reach : len(pair) - reach])
        line_of = np.repeat(np.arange(len(lines)), np.diff(lines, append=n))
        found = found[line_of[found] == line_of[found + wide]]
        alone = (pair[found[:, None] + np.arange(wide)] == pair[found + reach, None]).sum(axis=1) == 1
        edges = np.union1d(edges, found[alone] + reach + 1)
    lengths = np.diff(edges, append=n)
    pieces = -(-lengths // LONGEST)
    return np.repeat(edges, pieces) + LONGEST * (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces))


def _turned(x: np.ndarray, n: int) -> np.ndarray:
    return (x << np.uint64(n)) | (x >> np.uint64(64 - n))


def word_hashes(data: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """XXH64 of each word of ``data``, which ends with eight bytes more; of words below 32 bytes all at once."""
    one, two, three, four, five = XXH
    length = ends - starts
    eight, raw = np.ndarray((len(data) - 7,), np.dtype("<u8"), data, 0, (1,)), np.frombuffer(data, np.uint8)
    with np.errstate(over="ignore"):
        h = length.astype(np.uint64) + five
        for done in (0, 8, 16):
            rows = np.flatnonzero(length >= done + 8)
            h[rows] = _turned(h[rows] ^ (_turned(eight[starts[rows] + done] * two, 31) * one), 27) * one + four
        rows = np.flatnonzero(length & 4)
        h[rows] = _turned(h[rows] ^ ((eight[starts[rows] + (length[rows] & ~7)] & np.uint64(0xFFFFFFFF)) * one), 23) * two + three
        for k in range(3):
            rows = np.flatnonzero((length & 3) > k)
            h[rows] = _turned(h[rows] ^ (raw[starts[rows] + (length[rows] & ~3) + k] * five), 11) * one
        h = (h ^ (h >> np.uint64(33))) * two
        h = (h ^ (h >> np.uint64(29))) * three
        h ^= h >> np.uint64(32)
    for i in np.flatnonzero(length >= 32).tolist():
        h[i] = xxhash.xxh64_intdigest(data[starts[i] : ends[i]])
    return h


def grams(h: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words."""
    m = max(0, len(h) - size + 1)
    g = h[:m]
    with np.errstate(over="ignore"):
        for k in range(1, size):
            g = _mix(g, h[k : k + m])
    return g


def _described(h: np.ndarray, at: np.ndarray, bands: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(length, content hash, band keys) of the parts of a run of words that begin ``at`` these places and follow each other."""
    with np.errstate(over="ignore"):
        length = np.diff(at, append=len(h))
        place = np.arange(len(h)) - np.repeat(at, length)
        content = np.add.reduceat(_mix(h, place.astype(np.uint64)), at)
        keys = np.zeros((len(at), bands), np.uint64)
        if bands:
            most = np.iinfo(np.uint64).max
            outside = np.flatnonzero(place > np.repeat(length, length) - SHINGLE)  # shingles that reach over the paragraph's end
            own = np.full(len(h), most)
            g = grams(h, SHINGLE)
            own[: len(g)] = g
            least, step = [], max(1, (1 << 19) // len(h))
            for k in range(0, len(FACTORS), step):  # a multiple of a hash by an odd number is another hash
                value = own[:, None] * FACTORS[k : k + step]
                value[outside] = most
                least.append(np.minimum.reduceat(value, at, axis=0))
            least = np.concatenate(least, axis=1).reshape(len(at), bands, ROWS)
            for r in range(ROWS):
                keys = _mix(keys, least[:, :, r])
            keys[length < SHINGLE] = content[length < SHINGLE, None]
            keys = _mix(keys, np.arange(bands, dtype=np.uint64))
    return length, content, keys


class Read(NamedTuple):
    """Some texts as one run of words."""

    data: bytes
    starts: np.ndarray  # first byte of each word
    ends: np.ndarray
    h: np.ndarray  # the words' hashes
    begin: np.ndarray  # first word of each text
    line: np.ndarray  # first word of each line that has words

    def text_of(self, at: np.ndarray) -> np.ndarray:
        """Which text each of these words is in."""
        return np.searchsorted(self.begin, at, side="right") - 1

    def said(self, at: int, n: int) -> str:
        """``n`` words from the word ``at`` on, with one space between."""
        return b" ".join(self.data[self.starts[at] : self.ends[at + n - 1]].split()).decode()


def read(texts: list[bytes | None]) -> Read:
    data = b"\n".join([b"", *(t or b"" for t in texts), b" " * 8])  # a line break before and after each text
    raw = np.frombuffer(data, np.uint8)
    space = (raw == 32) | (raw - np.uint8(9) < 5)
    edges = np.flatnonzero(space[1:] != space[:-1]) + 1
    starts, ends = edges[::2], edges[1::2]
    begin = np.searchsorted(starts, np.cumsum([1, *(len(t or b"") + 1 for t in texts[:-1])]))
    line = np.unique(np.searchsorted(starts, np.flatnonzero(raw == 10)))
    return Read(data, starts, ends, word_hashes(data, starts, ends), begin[: len(texts)], line[line < len(starts)])


def in_groups(texts: list[bytes | None]) -> Iterator[tuple[int, int]]:
    """(start, end) of runs of texts of about TOGETHER bytes."""
    start = size = 0
    for i, text in enumerate(texts):
        size += len(text or b"")
        if size >= TOGETHER:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def paragraphs(r: Read, bands: int = BANDS) -> tuple[np.ndarray, ...]:
    """(start, length, content hash, band keys, number) of the lines of texts and of the parts of their long lines.

    Starts count over all texts; numbers order the lines of a text, and after them, from PARTS on, its parts.
    """
    if not len(r.line):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros((0, bands), np.uint64), np.zeros(0, np.int64)
    found = [(r.line, *_described(r.h, r.line, bands), np.zeros(len(r.line), np.int64))]
    length = np.diff(r.line, append=len(r.h))
    long = np.flatnonzero(length > LONGEST)
    if len(long):
        before = np.cumsum(length[long]) - length[long]
        own = np.repeat(r.line[long] - before, length[long]) + np.arange(length[long].sum())
        at = cuts(r.h[own], before)
        found.append((own[at], *_described(r.h[own], at, bands), np.full(len(at), PARTS)))
    start, n, content, keys, number = (np.concatenate(x) for x in zip(*found))
    return start, n, content, keys, number + start - r.begin[r.text_of(start)]


def anchors(r: Read, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, place, least and most words before it) of each anchor: of every run of ``least`` words of a text the first part of least hash.

    The last two say where the runs begin that it is the anchor of.
    """
    size = (least + 1) // 2
    short = grams(r.h, size)
    m, wide = max(0, len(r.h) - least + 1), least - size + 1
    bits = np.uint64((1 << wide.bit_length()) - 1)
    high = short & ~bits  # the low bits hold the place, so that of equal hashes the first is least
    low = high[:m].copy()
    for k in range(1, wide):
        np.minimum(low, high[k : k + m] | np.uint64(k), out=low)
    length = np.diff(r.begin, append=len(r.h))
    runs = np.flatnonzero(np.arange(m) <= np.repeat(r.begin + length - least, length)[:m])  # none reaches over its text's end
    at = runs + (low[runs] & bits).astype(np.int64)
    new = np.ones(len(at), bool)
    new[1:] = at[1:] != at[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at))[: len(first)] - 1
    at = at[first]
    return short[at], at, at - runs[last], at - runs[first]


def _batch(schema: str, **columns: np.ndarray | pa.Array) -> pa.RecordBatch:
    """A batch of ``schema``; columns that aren't given are null."""
    types = {"int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary(), "string": pa.string()}
    fields = [x.split() for x in schema.split(", ")]
    n = len(next(iter(columns.values())))
    made = []
    for name, kind in fields:
        c = columns.get(name)
        made.append(pa.nulls(n, types[kind]) if c is None else c if isinstance(c, pa.Array) else pa.array(c.view(np.int64) if c.dtype == np.uint64 else c).cast(types[kind]))
    return pa.RecordBatch.from_arrays(made, [name for name, _ in fields])


def _key_rows(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Of texts: each anchor once (kind 0, or 1 if the batch has it again) with the number of its places, each band of each paragraph once (kind 2)."""
    for batch in batches:
        texts = batch.column(0).cast(pa.binary()).to_pylist()
        keys, bands = [np.zeros(0, np.uint64)], [np.zeros((0, 2), np.uint64)]
        for lo, hi in in_groups(texts):
            r = read(texts[lo:hi])
            keys.append(anchors(r, least)[0])
            _, n, content, found, _ = paragraphs(r)
            long = n >= least
            bands += [np.stack([found[long, b], content[long]], axis=1) for b in range(BANDS)]
        key, count = np.unique(np.concatenate(keys), return_counts=True)
        met = np.concatenate(bands)
        met = met[np.lexsort((met[:, 1], met[:, 0]))]
        met = met[np.r_[True, (met[1:] != met[:-1]).any(1)]] if len(met) else met
        yield _batch(KEYS, kind=(count > 1).astype(np.int32), key=key, hash=count)
        yield _batch(KEYS, kind=np.full(len(met), 2, np.int32), key=np.ascontiguousarray(met[:, 0]), hash=np.ascontiguousarray(met[:, 1]))


def _met(t: pa.Table, hot: int) -> pa.RecordBatch:
    """Anchors that occur again (kind 0, once more as kind 2 if ``hot``), and each of the unlike paragraphs that share a band (kind 1)."""
    kind, key, content = (t.column(c).to_numpy() for c in ("kind", "key", "hash"))
    band = kind == 2
    anchor = np.flatnonzero(~band)
    again, begin = np.unique(key[anchor], return_index=True)  # rows come by key
    places = np.add.reduceat(content[anchor], begin) if len(begin) else begin
    again, many_places = again[places > 1], again[places >= hot]
    key, content = key[band], content[band]
    new = np.r_[True, (key[1:] != key[:-1]) | (content[1:] != content[:-1])][: len(key)]
    key, content = key[new], content[new]
    of = np.cumsum(np.r_[True, key[1:] != key[:-1]][: len(key)]) - 1
    many = np.bincount(of)[of] > 1 if len(key) else new
    sizes = (len(again), int(many.sum()), len(many_places))
    return _batch(KEYS, kind=np.repeat(np.arange(3), sizes), key=np.r_[again, key[many], many_places], hash=np.r_[again, content[many], many_places])


def _place_rows(batches: Iterator[pa.RecordBatch], least: int, met: KeyFilter, unlike: KeyFilter, hot: KeyFilter) -> Iterator[pa.RecordBatch]:
    """Of (doc, tag, text): anchors that may be met again (kind 0) and paragraphs that may be unlike others of a band (kind 1).

    An anchor comes with four bytes of the hash of each word around it, as far as runs that it is the anchor of reach,
    and with ``room``: from how many to how many words before it such runs begin. Of a ``hot`` anchor each such run comes
    by its hash (kind 2). A paragraph comes with its words, of equal ones in a batch only the first.
    """
    size = (least + 1) // 2
    side = least - size
    steps = np.concatenate([-np.arange(1, side + 1), size + np.arange(side)])
    for batch in batches:
        docs, tags, texts = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).cast(pa.binary()).to_pylist()
        had: set[int] = set()
        for lo, hi in in_groups(texts):
            r = read(texts[lo:hi])
            key, at, low, high = anchors(r, least)
            take = np.flatnonzero(met.maybe(key))
            key, at, low, high = key[take], at[take], low[take], high[take]
            often = hot.maybe(key)
            if often.any():
                count = (high - low + 1)[often]
                start = np.repeat((at - high)[often] - np.cumsum(count) + count, count) + np.arange(count.sum())
                of = r.text_of(start)
                yield _batch(PLACES, kind=np.full(len(start), 2), key=grams(r.h, least)[start], doc=docs[lo + of], tag=tags[lo + of], at=start - r.begin[of])
                key, at, low, high = key[~often], at[~often], low[~often], high[~often]
            if len(key):
                around = np.pad((r.h >> np.uint64(32)).astype(np.uint32), side)[side + at[:, None] + steps]
                offsets = pa.array(np.arange(len(key) + 1, dtype=np.int32) * (8 * side))
                binary = pa.Array.from_buffers(pa.binary(), len(key), [None, offsets.buffers()[1], pa.py_buffer(np.ascontiguousarray(around).tobytes())])
                of = r.text_of(at)
                yield _batch(PLACES, kind=np.zeros(len(key), np.int32), key=key, doc=docs[lo + of], tag=tags[lo + of], at=at - r.begin[of], room=(low << 16) + high, around=binary)
            start, n, content, _, number = paragraphs(r, 0)
            take = np.flatnonzero((n >= least) & unlike.maybe(content))
            if len(take):
                start, n, content, number = start[take], n[take], content[take], number[take]
                of = r.text_of(start)
                said = []
                for own, i, k in zip(content.tolist(), start.tolist(), n.tolist()):
                    said.append(None if own in had else r.said(i, k))
                    had.add(own)
                yield _batch(PLACES, kind=np.ones(len(n), np.int32), key=content, doc=docs[lo + of], tag=tags[lo + of], at=start - r.begin[of], n=n, chunk=number, text=pa.array(said, pa.string()))


def _found(t: pa.Table, least: int) -> Iterator[pa.RecordBatch]:
    kind = t.column("kind").to_numpy()
    yield _equal_runs(t.filter(pa.array(kind == 0)), least)
    runs, t = t.filter(pa.array(kind == 2)), t.filter(pa.array(kind == 1))
    if runs.num_rows:
        yield _batch(FOUND, start=runs.column("at").combine_chunks(), **{c: runs.column(c).combine_chunks() for c in ("kind", "key", "doc", "tag")})
    if t.num_rows:
        whole = {c: t.column(c).combine_chunks() for c in ("kind", "key", "doc", "tag", "n", "chunk", "text")}
        yield _batch(FOUND, start=t.column("at").combine_chunks(), **whole)


def _equal_runs(t: pa.Table, least: int) -> pa.RecordBatch:
    """Runs that two or more texts have, neighbours put together; all but the first (by document, then place) are removed."""
    size = (least + 1) // 2
    side = least - size
    key, doc, tag, at, room = (t.column(c).to_numpy() for c in ("key", "doc", "tag", "at", "room"))
    around = np.frombuffer(b"".join(t.column("around").to_pylist()), np.uint32).reshape(len(key), 2 * side).astype(np.uint64)
    low, high = room >> 16, room & 0xFFFF
    with np.errstate(over="ignore"):
        left, right = [key.view(np.uint64)], [np.zeros(len(key), np.uint64)]
        for k in range(side):
            left.append(_mix(left[-1], around[:, k]))
            right.append(_mix(right[-1], around[:, side + k]))
        rows = [np.flatnonzero((low <= k) & (k <= high)) for k in range(side + 1)]
        gram = np.concatenate([_mix(left[k][r], right[side - k][r] + np.uint64(k)) for k, r in enumerate(rows)])
    before = np.repeat(np.arange(side + 1), [len(r) for r in rows])
    row = np.concatenate(rows)
    order = np.argsort(gram, kind="stable")  # rows come by key, document and place: so do those of one run
    gram, row, start = gram[order], row[order], at[row[order]] - before[order]
    doc, tag = doc[row], tag[row]
    first = np.flatnonzero(np.r_[True, gram[1:] != gram[:-1]][: len(gram)])
    count = np.diff(np.r_[first, len(gram)])
    last = first + count - 1
    take = np.flatnonzero(np.repeat((doc[first] != doc[last]) | (tag[first] != tag[last]), count))
    first = np.repeat(first, count)[take]
    doc, tag, start, first_doc, first_tag, first_at = doc[take], tag[take], start[take], doc[first], tag[first], start[first]
    removed = (doc != first_doc) | (tag != first_tag) | (start - first_at >= least)  # what a text repeats onto itself stays
    order = np.lexsort((start, tag, doc))
    doc, tag, start, first_doc, first_at, removed = (x[order] for x in (doc, tag, start, first_doc, first_at, removed))
    new = np.ones(len(doc), bool)
    new[1:] = (np.diff(doc) != 0) | (np.diff(tag) != 0) | (np.diff(start) != 1) | (np.diff(first_doc) != 0) | (np.diff(first_at) != 1) | (removed[1:] != removed[:-1])
    begin = np.flatnonzero(new)
    n = np.diff(np.r_[begin, len(doc)]) + least - 1
    doc, tag, start, first_doc, first_at, removed = (x[begin] for x in (doc, tag, start, first_doc, first_at, removed))
    return _batch(FOUND, kind=np.zeros(len(doc), np.int32), key=doc, doc=doc, tag=tag, start=start, n=n, first_doc_id=first_doc, first_at=first_at, removed=removed)


def bridged(runs: list[tuple[int, int, int, int]], similarity: float) -> list[tuple[int, int, int]]:
    """(start, end, first document): runs (first document, start, end, start there) of one document, in their order, joined over
    words that differ as long as the shingles of the runs alone give both sides the wanted Jaccard similarity."""
    out = []
    for first_doc, own in itertools.groupby(sorted(runs), key=lambda r: r[0]):
        held: list[int] = []  # start, end, start there, end there, equal shingles
        for _, start, end, there in own:
            there_end = there + end - start
            if held and start <= held[1] and start - held[1] == there - held[3]:  # the same run further on
                more = max(0, end - max(held[1], start))
                held = [held[0], max(held[1], end), held[2], max(held[3], there_end), held[4] + more]
                continue
            fresh = max(0, end - start - SHINGLE + 1)
            if held and start >= held[1] and there >= held[3]:
                both = held[4] + fresh
                if both >= similarity * (end - held[0] + there_end - held[2] - 2 * (SHINGLE - 1) - both):
                    held = [held[0], end, held[2], there_end, both]
                    continue
            if held:
                out.append((held[0], held[1], first_doc))
            held = [start, end, there, there_end, fresh]
        out.append((held[0], held[1], first_doc))
    return out


def _passages(t: pa.Table, least: int, similarity: float) -> pa.RecordBatch:
    """The shared stretches of each text: words that go in any of them go, the others stay."""
    key, doc, tag, start, n, first_doc, removed = (t.column(c).to_numpy() for c in ("key", "doc", "tag", "start", "n", "first_doc_id", "removed"))
    equal_run, there = t.column("first_at").is_valid().to_numpy(), t.column("first_at").fill_null(0).to_numpy()
    shift = np.where(equal_run, start - there.astype(np.int64), np.int64(1 << 40))  # in 32 bits an alike paragraph would count as a run
    order = np.lexsort((start, shift, first_doc, removed, key))
    key, doc, tag, start, n, first_doc, removed, equal_run, there, shift = (x[order] for x in (key, doc, tag, start, n, first_doc, removed, equal_run, there, shift))
    new = np.ones(len(key), bool)  # pieces of one run come from several anchors
    new[1:] = (np.diff(key) != 0) | (removed[1:] != removed[:-1]) | (np.diff(first_doc) != 0) | (np.diff(shift) != 0) | (start[1:] > (start + n)[:-1])
    at = np.flatnonzero(new)
    n = np.maximum.reduceat(start + n, at) - start[at]
    key, doc, tag, start, first_doc, removed, equal_run, there = (x[at] for x in (key, doc, tag, start, first_doc, removed, equal_run, there))
    out = []
    stops = np.flatnonzero(np.r_[key[1:] != key[:-1], True]) + 1
    for lo, hi in zip([0, *stops[:-1].tolist()], stops.tolist()):
        rows = [(int(start[i]), int(start[i] + n[i]), int(first_doc[i]), bool(removed[i])) for i in range(lo, hi)]
        equal = [(f, s, e, int(there[i])) for i, (s, e, f, gone) in zip(range(lo, hi), rows) if gone and equal_run[i]]
        rows += [(s, e, f, True) for s, e, f in bridged(equal, similarity)]
        state = np.zeros(max(e for _, e, _, _ in rows) + 2, np.int8)  # of a word: 1 stays, 2 goes; begins and ends with 0
        for s, e, _, gone in sorted(rows, key=lambda r: r[3]):
            state[s + 1 : e + 1] = 1 + gone
        firsts = np.full(len(state), np.iinfo(np.int64).max)
        for s, e, f, _ in rows:
            firsts[s + 1 : e + 1] = np.minimum(firsts[s + 1 : e + 1], f)
        edges = np.flatnonzero(np.diff(state)) + 1
        shared = np.flatnonzero(np.diff((state > 0).astype(np.int8))) + 1
        for a, b in zip(shared[::2].tolist(), shared[1::2].tolist()):
            if b - a >= least:
                inner = [a, *(x for x in edges.tolist() if a < x < b), b]
                out += [(int(doc[lo]), int(tag[lo]), x - 1, y - x, int(firsts[x:y].min()), bool(state[x] == 2)) for x, y in zip(inner, inner[1:])]
    cols = list(zip(*out)) or [()] * 6
    return _batch(SPANS, **{name.split()[0]: np.array(c, bool if name.endswith("boolean") else np.int64) for name, c in zip(SPANS.split(", "), cols)})


def by_runs(batches: Iterator[pa.RecordBatch], work: Callable[[pa.Table], Iterator[pa.RecordBatch]], rows: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    """``work`` over rows that come sorted by key, never with a key's rows apart."""
    held: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(pa.Table.from_batches([batch]))
        key = batch.column("key").to_numpy()
        if sum(x.num_rows for x in held) >= rows and key[0] != key[-1]:
            cut = int(np.searchsorted(key, key[-1]))
            yield from work(pa.concat_tables([*held[:-1], held[-1].slice(0, cut)]))
            held = [held[-1].slice(cut)]
    if held:
        yield from work(pa.concat_tables(held))


def shingles(found: list[str], size: int = SHINGLE) -> set[tuple[str, ...]]:
    return set(zip(*(found[i:] for i in range(size)))) or {tuple(found)}


def _alike(t: pa.Table, similarity: float) -> pa.RecordBatch:
    """Edges between the paragraphs of each key whose Jaccard similarity is high enough; those linked already aren't compared again."""
    key, content, text = t.column("key").to_numpy(), t.column("hash").to_numpy(), t.column("text").to_pylist()
    edges: list[tuple[int, int]] = []
    stops = np.flatnonzero(np.r_[key[1:] != key[:-1], True]) + 1
    for lo, hi in zip([0, *stops[:-1].tolist()], stops.tolist()):
        groups: list[list[tuple[int, set]]] = []  # of paragraphs linked so far
        for i in range(lo, hi):
            own = shingles((text[i] or "").split(" "))
            joined = []
            for g in groups:
                for other, theirs in g:
                    small, large = sorted((len(own), len(theirs)))
                    if small >= similarity * large and (both := len(own & theirs)) >= similarity * (len(own) + len(theirs) - both):
                        edges.append((int(content[i]), other))
                        joined.append(g)
                        break
            merged = [(int(content[i]), own)] + [x for g in joined for x in g]
            groups = [g for g in groups if not any(g is j for j in joined)] + [merged]
    return pa.RecordBatch.from_pydict({"a": pa.array([a for a, _ in edges], pa.int64()), "b": pa.array([b for _, b in edges], pa.int64())})


def by_rare_shingles(paragraphs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(key, hash, text): each of the paragraphs (hash, text) once for every shingle of its prefix.

    Paragraphs of Jaccard similarity t or more share one of the first n - ceil(t * n) + 1 of their n shingles
    in any common order, so grouping by ``key`` loses none. The order is by how many paragraphs have a shingle,
    the rarest first: what many unlike paragraphs have in common comes last and groups nothing.
    """
    found = F.split(F.coalesce("text", F.lit("")), " ")
    starts = F.sequence(F.lit(1), F.greatest(F.size(found) - (SHINGLE - 1), F.lit(1)))
    own = F.array_distinct(F.transform(starts, lambda i: F.xxhash64(F.slice(found, i, SHINGLE))))
    grams = paragraphs.select("hash", F.explode(own).alias("g"), F.pmod("hash", F.lit(SALT)).alias("salt"))
    often = grams.groupBy("g").agg(F.count("*").alias("c")).withColumn("salt", F.explode(F.expr(f"sequence(0L, {SALT - 1}L)")))
    ordered = grams.join(often, ["g", "salt"]).groupBy("hash").agg(F.sort_array(F.collect_list(F.struct("c", "g"))).alias("o"))
    n = F.size("o")
    first = F.slice("o", F.lit(1), (n - F.ceil(n * similarity - 1e-9) + 1).cast("int"))
    return ordered.select("hash", F.explode(first).alias("x")).select(F.col("x.g").alias("key"), "hash").join(paragraphs, "hash").select("key", "hash", "text")


def _filter(keys: DataFrame) -> KeyFilter:
    return KeyFilter(keys, min(FILTER_MOST, max(FILTER_LEAST, 1 << (8 * keys.count()).bit_length())))


def _runs_of_hot_anchors(runs: DataFrame, least: int) -> DataFrame:
    """Runs (key, doc, tag, start) that two or more texts have; all but the first of a key are removed, save what a text repeats onto itself."""
    first = runs.groupBy("key").agg(F.min(F.struct("doc", "tag", "start")).alias("first"), F.max(F.struct("doc", "tag")).alias("last"))
    shared = first.where("first.doc <> last.doc or first.tag <> last.tag").select("key", "first", F.explode(F.expr(f"sequence(0L, {SALT - 1}L)")).alias("salt"))
    both = runs.withColumn("salt", F.pmod(F.xxhash64("doc", "tag"), F.lit(SALT))).join(shared, ["key", "salt"])
    other_text = (F.col("doc") != F.col("first.doc")) | (F.col("tag") != F.col("first.tag"))
    removed = other_text | (F.col("start") - F.col("first.start") >= least)
    return both.select("doc", "tag", "start", F.lit(least).alias("n"), F.col("first.doc").alias("first_doc_id"), F.col("first.start").alias("first_at"), removed.alias("removed"))


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, least_words: int = LEAST_WORDS) -> DataFrame:
    """(doc_id, tag, start_word, n_words, first_doc_id, removed): every passage that a document shares with another one.

    Equal: every run of ``least_words`` words that another text has too belongs to a passage, so passages reach to
    their true ends; the first text (by id) keeps its words. Alike: paragraphs of ``least_words`` or more that share
    a MinHash band and have a Jaccard similarity of ``similarity`` over 5-word shingles form clusters (connected
    components), and the first paragraph of a cluster (by id, then place) stays. Equal runs in the same order as in
    their first document are joined over the words that differ if they are as similar with these. What doesn't stay
    is ``removed``.

    Texts are told apart by id and by ``tag``, 31 bits of the text's hash: rows that repeat an id with other texts
    are texts of their own, rows that repeat both are one. Rows with a null id, null and empty texts share nothing.
    Extra columns of any name are ignored, an empty table gives an empty result.
    """
    name, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    own = docs.select(name.cast("long").alias("doc"), text_tag(text).alias("tag"), text.alias("text")).where("doc is not null")
    hot = HOT
    dealt = own.select("text").mapInArrow(lambda batches: _key_rows(batches, least_words), KEYS).repartition("key").sortWithinPartitions("key", "hash")
    found = settled(dealt.mapInArrow(lambda batches: by_runs(batches, lambda t: [_met(t, hot)], 1 << 18), KEYS))
    unlike = found.where("kind = 1").select("key", "hash")
    filters = docs.sparkSession.sparkContext.broadcast([_filter(x) for x in (found.where("kind = 0").select("key"), unlike.select(F.col("hash").alias("key")), found.where("kind = 2").select("key"))])
    one_by_one = F.when(F.col("kind") == 2, F.xxhash64("doc", "tag"))
    places = own.mapInArrow(lambda batches: _place_rows(batches, least_words, *filters.value), PLACES).repartition("key", one_by_one).sortWithinPartitions("key", "doc", "tag", "at")
    placed = settled(places.mapInArrow(lambda batches: by_runs(batches, lambda t: _found(t, least_words)), FOUND))
    spots = placed.where("kind = 1").select(F.col("key").alias("hash"), "doc", "tag", "chunk", "start", "n", "text")
    texts = settled(spots.where("text is not null").groupBy("hash").agg(F.min("text").alias("text")))
    crowded = unlike.groupBy("key").agg(F.count("*").alias("m")).where(F.col("m") > GROUP).select("key")
    few = unlike.join(crowded, "key", "left_anti").join(texts.hint("merge"), "hash").select("key", "hash", "text")
    many = texts.join(unlike.join(crowded, "key", "left_semi").select("hash").distinct(), "hash", "left_semi")
    pairs = few.unionByName(by_rare_shingles(many, similarity)).repartition("key").sortWithinPartitions("key", "hash")
    edges = settled(pairs.mapInArrow(lambda batches: by_runs(batches, lambda t: [_alike(t, similarity)]), "a long, b long"))
    parts = connected_components(edges).withColumnRenamed("node", "hash")
    place = F.struct("doc", "tag", "chunk")
    ends = spots.groupBy("hash").agg(F.min(place).alias("first"), F.max(F.struct("doc", "tag")).alias("last")).join(parts, "hash")
    heads = ends.groupBy("component").agg(F.min("first").alias("first"), F.max("last").alias("last")).where("first.doc <> last.doc or first.tag <> last.tag")
    named = parts.join(heads.select("component", "first"), "component").select("hash", "first", F.explode(F.expr(f"sequence(0L, {SALT - 1}L)")).alias("salt"))
    alike = spots.withColumn("salt", F.pmod(F.xxhash64("doc", "tag"), F.lit(SALT))).join(named, ["hash", "salt"])
    alike = alike.select("doc", "tag", "start", "n", F.col("first.doc").alias("first_doc_id"), F.lit(None).cast("int").alias("first_at"), (place != F.col("first")).alias("removed"))
    common = _runs_of_hot_anchors(placed.where("kind = 2").select("key", "doc", "tag", "start"), least_words)
    pieces = placed.where("kind = 0").select(*PIECE[1:]).unionByName(alike).unionByName(common).withColumn("key", F.xxhash64("doc", "tag"))
    pieces = pieces.repartition("key").sortWithinPartitions("key", "start")
    return pieces.mapInArrow(lambda batches: by_runs(batches, lambda t: [_passages(t, least_words, similarity)]), SPANS)


def text_tag(text: Column) -> Column:
    return F.xxhash64(text).bitwiseAND(F.lit((1 << 31) - 1)).cast("int")


def cut_out(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without these runs (start, n) of its words. All else stays as it is; of the gaps on either side of a run one stays, with the line break if one has it."""
    data = text.encode()
    found = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", data)]
    out, kept = [], 0
    for start, n in merged(spans):
        stop = min(start + n, len(found))
        if start >= stop:
            continue
        before, after = found[start - 1][1] if start else 0, found[stop][0] if stop < len(found) else len(data)
        left, right = (before, found[start][0]), (found[stop - 1][1], after)
        gap = right if not start or b"\n" in data[slice(*right)] and b"\n" not in data[slice(*left)] else left
        if not start:
            gap = (0, found[0][0])
        elif stop == len(found):
            gap = right
        out += [data[kept:before], data[slice(*gap)]]
        kept = after
    return b"".join([*out, data[kept:]]).decode()


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs in order, those that touch put together."""
    out: list[list[int]] = []
    for start, n in sorted(spans):
        if out and start <= out[-1][0] + out[-1][1]:
            out[-1][1] = max(out[-1][1], start + n - out[-1][0])
        else:
            out.append([start, n])
    return [(a, n) for a, n in out]


@F.pandas_udf(T.StringType())
def _without(texts: pd.Series, spans: pd.Series) -> pd.Series:
    return pd.Series([text if own is None or text is None else cut_out(text, [(s["start_word"], s["n_words"]) for s in own]) for text, own in zip(texts, spans)], dtype="object")


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with removed passages cut out of the texts; all else of a text, line breaks too, and texts with nothing to remove stay as they are.

    Documents that lose all their words go. n_chars, if there is such a column, is that of the new text. Rows
    are told apart by id and text; null ids, null and empty texts stay as they are; all columns stay, of any name.
    """
    columns = [F.col(f"`{c}`") for c in docs.columns]
    name, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    rows = docs.select(F.struct(*columns).alias("row"), name.cast("long").alias("doc_id"), text_tag(text).alias("tag"), text.alias("text"))
    spans = repeated_passages(docs, id_col, text_col).where("removed").groupBy("doc_id", "tag").agg(F.collect_list(F.struct("start_word", "n_words")).alias("spans"))
    out = rows.join(spans.hint("merge"), ["doc_id", "tag"], "left")
    out = out.withColumn("new", F.when(F.col("spans").isNotNull(), _without("text", "spans")))
    out = out.where(F.col("spans").isNull() | F.col("new").rlike("[^\\x20\\x09-\\x0D]"))
    fresh = {text_col: F.col("new"), "n_chars": F.length("new").cast("long")}
    kept = [F.when(F.col("spans").isNull(), F.col("row")[c]).otherwise(fresh[c]).alias(c) if c in fresh else F.col("row")[c].alias(c) for c in docs.columns]
    return out.select(*kept)
