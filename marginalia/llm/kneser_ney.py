"""Quality classifier: perplexity under an interpolated modified Kneser-Ney model of trusted text.

All that a trigram u v w asks of the model but ln p of w alone goes by its middle word v: the counts of u v w, of the
context u v, of the bigram v w and of the context v. So texts are gone over in a few passes, each of which deals the
places of some middle words: first those of trusted text, of which a part's entries are made, then those of all texts,
which meet the entries of their part. No pass leaves more than sums by document. Of words alone the most frequent, a
bounded number, are sent to all tasks; others are looked up by a join where the bigram is unseen.
"""

from __future__ import annotations

import collections
import contextlib
import re
import time
from collections.abc import Iterator
from functools import reduce
from itertools import chain, groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from marginalia.llm.filters import KeyFilter
from marginalia.llm.words import words
from marginalia.storage import settled

#: Trusted rows of each language that counts are taken from at most, those with the smallest hashes of their ids.
ROWS_PER_LANGUAGE = 600
#: Words that are sent to all tasks with their ln p at most (12 bytes each, 50 MB): those that follow most different words.
FREQUENT = 1 << 22
#: Bits of the filter for the other words; two are set for each. What it lets through in error is only looked up in vain.
FILTER_BITS = 1 << 26
#: Passes over the texts that are scored, and over trusted text when it is counted: scratch space holds one pass.
PASSES, COUNT_PASSES = 9, 2
#: Bytes of text whose places, of one pass, a partition gets; a partition of trusted places holds them all at once.
TEXT_A_PART, TRUSTED_A_PART = 12 << 20, 7 << 19
#: Partitions of a pass over more than a little text at least.
LEAST_PARTS, LITTLE = 12, 1 << 24
#: Trusted places with the same middle word that stay together; more are dealt by their first word too.
TOGETHER = 1 << 20
#: Bytes of text that a task works on at once, and of rows that it is sent at once.
TEXT_AT_ONCE, BATCH = 1 << 22, 1 << 23
#: Places that a task gathers before it deals them.
GATHERED = 1 << 19
#: Of 5 trusted rows one sets the threshold, so that it stands on text that the counts have not seen.
HELD_SHARE = 5
#: Words of the language's usual perplexity that every text is credited with: a few words alone prove little.
PRIOR_WORDS = 30
QUANTILE = 0.99
#: Room above the quantile, as a factor of perplexity.
ROOM = 1.1
GAP = re.compile(rb"[ \t\n\r\x0b\x0c]")
IS_GAP = np.isin(np.arange(256), list(b" \t\n\r\x0b\x0c"))
#: The first bytes of eight, by their number.
FIRST = np.array([(1 << 8 * i) - 1 for i in range(9)], dtype=np.uint64)
#: Bytes of words that are hashed one by one.
LONG_WORD = 256


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A 64-bit hash of pairs of hashes."""
    x = (a ^ (a >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + b
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def _salt(slot: int) -> int:
    return 0x9E3779B97F4A7C15 * (slot + 1) & 0xFFFFFFFFFFFFFFFF


def _salted(h: np.ndarray, slot: int) -> np.ndarray:
    """Hashes as the keys of one of the table's SLOTS."""
    return h ^ np.uint64(_salt(slot))


#: What the table holds: ln p of a trigram, ln gamma of its context, ln p of the bigram, ln gamma of its context, ln p of the word.
SLOTS = ("uvw", "uv", "vw", "v", "w")


def _hashes(data: bytes, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of ``data``, and where each begins: eight bytes at a time of all of them."""
    raw = np.frombuffer(data + bytes(9), np.uint8)
    gap = np.ones(len(raw) - 7, bool)
    gap[1 : len(data) + 1] = IS_GAP[raw[: len(data)]]
    turns = np.flatnonzero(gap[1:] != gap[:-1])
    begin, size = turns[::2], turns[1::2] - turns[::2]
    eights = np.ndarray(len(raw) - 7, "<u8", raw, strides=(1,))  # from each byte on
    with np.errstate(over="ignore"):
        out = _mix(eights[begin] & FIRST[np.minimum(size, 8)], np.uint64(seed) ^ size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        more = np.flatnonzero((size > 8) & (size <= LONG_WORD))
        for at in range(8, LONG_WORD, 8):
            if not len(more):
                break
            out[more] = _mix(eights[begin[more] + at] & FIRST[np.minimum(size[more] - at, 8)], out[more])
            more = more[size[more] > at + 8]
    for i in np.flatnonzero(size > LONG_WORD):
        out[i] = xxhash.xxh64_intdigest(data[begin[i] : begin[i] + size[i]], seed)
    return out, begin


def word_hashes(text: str | None, lang: str | None) -> np.ndarray:
    """Hashes of the words with two starts before and an end after them."""
    seed = xxhash.xxh32_intdigest(lang or "")
    return np.r_[np.array([seed, seed], np.uint64), _hashes((text or "").encode(), seed)[0], np.uint64(seed + 1)]


def _keys(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.LongType()) for n in names])


@F.arrow_udf(T.ArrayType(_keys("uv", "v", "w")))
def _grams(texts: pa.Array, langs: pa.Array) -> pa.Array:
    """Of each text, for each of its trigrams: the keys of the context and of the last two words, of which all other keys are made."""
    all_of = [word_hashes(t, l) for t, l in zip(texts.to_pylist(), langs.to_pylist())]
    ends = np.cumsum([0, *(len(h) - 2 for h in all_of)], dtype=np.int32)
    with np.errstate(over="ignore"):
        keys = [np.concatenate([np.zeros(0, np.uint64), *x]) for x in (([_mix(h[:-2], h[1:-1]) for h in all_of]), [h[1:-1] for h in all_of], [h[2:] for h in all_of])]
    grams = pa.StructArray.from_arrays([pa.array(_salted(k, i).view(np.int64)) for k, i in zip(keys, (1, 3, 4))], ["uv", "v", "w"])
    return pa.ListArray.from_arrays(ends, grams)


@F.arrow_udf(_keys("uvw", "vw"))
def _above(uv: pa.Array, v: pa.Array, w: pa.Array) -> pa.Array:
    """The keys of trigrams and of their last two words."""
    uv, v, w = (_salted(x.to_numpy().view(np.uint64), i) for x, i in ((uv, 1), (v, 3), (w, 4)))  # salt taken twice is gone
    with np.errstate(over="ignore"):
        found = _salted(_mix(uv, w), 0), _salted(_mix(v, w), 2)
    return pa.StructArray.from_arrays([pa.array(x.view(np.int64)) for x in found], ["uvw", "vw"])


class Deal:
    """Which pass and part the places of a middle word belong to, by hashes of words.

    ``heavy`` has the middle words with very many trusted places, and to how many parts each is dealt.
    """

    def __init__(self, passes: int, parts: int, heavy: dict[int, int]):
        self.passes, self.parts = passes, parts
        self.words = np.array(sorted(heavy), dtype=np.uint64)
        self.shares = np.array([heavy[int(w)] for w in self.words], dtype=np.int64)

    def passes_and_parts(self, mid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        with np.errstate(over="ignore"):
            x = (((mid ^ (mid >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(33)).astype(np.int64)
        return x % self.passes, x // self.passes % self.parts

    def shares_of(self, mid: np.ndarray) -> np.ndarray:
        if not len(self.words):
            return np.ones(len(mid), np.int64)
        at = np.minimum(np.searchsorted(self.words, mid), len(self.words) - 1)
        return np.where(self.words[at] == mid, self.shares[at], 1)

    @staticmethod
    def share(by: np.ndarray, shares: np.ndarray) -> np.ndarray:
        """Which of so many parts a place belongs to, by its first or last word."""
        with np.errstate(over="ignore"):
            return ((by * np.uint64(0xFF51AFD7ED558CCD)) >> np.uint64(34)).astype(np.int64) % shares


def _pieces(text: bytes) -> Iterator[tuple[bytes, bool]]:
    """``text`` cut at white space to pieces of about TEXT_AT_ONCE bytes, and whether each is the last."""
    at = 0
    while len(text) - at > TEXT_AT_ONCE and (m := GAP.search(text, at + TEXT_AT_ONCE)) is not None:
        yield text[at : m.start()], False
        at = m.start()
    yield text[at:], True


def _texts(batches: Iterator[pa.RecordBatch], languages: list[str]) -> Iterator[tuple[int, list[int], list[bytes], list[bool]]]:
    """Number of the language, keys of texts, texts or pieces of one, and whether each is a text's last, for about TEXT_AT_ONCE bytes of one language at a time."""
    no = {lang: i for i, lang in enumerate(languages)}
    for batch in batches:
        of = collections.defaultdict(list)
        for i, lang in enumerate(batch.column("lang").to_pylist()):
            if lang in no:
                of[no[lang]].append(i)
        row, text = batch.column("row"), batch.column("text")
        for lang, rows in of.items():
            keys, found, lasts, held = [], [], [], 0
            for i in rows:
                for piece, last in _pieces(text[i].as_py() or b""):
                    keys.append(row[i].as_py())
                    found.append(piece)
                    lasts.append(last)
                    held += len(piece)
                    if held >= TEXT_AT_ONCE:
                        yield lang, keys, found, lasts
                        keys, found, lasts, held = [], [], [], 0
            if keys:
                yield lang, keys, found, lasts


def _marked(batches: Iterator[pa.RecordBatch], languages: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Number of the language, keys of texts, hashes of their words and marks one behind the other, where in them the predicted words are, and the numbers of their texts.

    Before the words of a text, or of a piece of it, stand two starts or the last two hashes; an end stands behind the last.
    """
    before, seeds = None, [xxhash.xxh32_intdigest(x) for x in languages]
    for lang, keys, found, lasts in _texts(batches, languages):
        seed = seeds[lang]
        hashes, begin = _hashes(b"\n".join(found), seed)
        size = np.array([len(x) + 1 for x in found])
        n = np.diff(np.r_[0, np.searchsorted(begin, np.cumsum(size))])  # words of each
        ends = np.array(lasts)
        total = n + 2 + ends
        stop = np.cumsum(total)
        every = np.empty(stop[-1], np.uint64)
        word = np.ones(len(every), bool)
        first = stop - total
        word[first] = word[first + 1] = False
        predicted = np.flatnonzero(word)
        of = np.repeat(np.arange(len(total)), total - 2)
        word[stop[ends] - 1] = False
        every[word] = hashes
        every[stop[ends] - 1] = seed + 1
        every[first] = every[first + 1] = seed
        if before is not None:
            every[:2] = before
        before = None if lasts[-1] else every[-2:].copy()
        yield lang, np.array(keys, dtype=np.int64), every, predicted, of


@contextlib.contextmanager
def _held(spark: SparkSession, name: str, value: object) -> Iterator[None]:
    before = spark.conf.get(name)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _small_batches(spark: SparkSession) -> contextlib.AbstractContextManager:
    """While passes run: a batch is held by the JVM and by Python, and once more while it is sent."""
    return _held(spark, "spark.sql.execution.arrow.maxBytesPerBatch", BATCH)


def _passed(df: DataFrame) -> DataFrame:
    """``df`` settled, and a pass's shuffle files gone: what still refers to them when it has just ended doesn't a moment later."""
    with _small_batches(df.sparkSession):
        out = settled(df)
    for _ in range(2):
        time.sleep(0.4)
        df.sparkSession.sparkContext._jvm.System.gc()
    return out


def _packed(arrays: list[np.ndarray]) -> bytes:
    """Arrays one behind the other, with their sizes and kinds before them."""
    head = np.array([len(arrays), *(x for a in arrays for x in (len(a), ord(a.dtype.char)))], dtype=np.int64)
    return _squeezed(b"".join([head.tobytes(), *(a.tobytes() for a in arrays)]))


def _squeezed(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def _spread(data: bytes) -> bytes:
    return pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)


def _unpacked(data: bytes) -> list[np.ndarray]:
    data = _spread(data)
    n = int(np.frombuffer(data, np.int64, 1)[0])
    head, at, out = np.frombuffer(data, np.int64, 1 + 2 * n)[1:], 8 + 16 * n, []
    for size, kind in head.reshape(-1, 2).tolist():
        out.append(np.frombuffer(data, chr(kind), size, at))
        at += out[-1].nbytes
    return out


def _small(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint16 if not len(x) or x.max() < 1 << 16 else np.uint32)


BLOBS = "part int, kind int, data binary"
BLOB = pa.schema([("part", pa.int32()), ("kind", pa.int32()), ("data", pa.binary())])


def _blob(part: int, kind: int, arrays: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([kind], pa.int32()), pa.array([_packed(arrays)], pa.binary())], schema=BLOB)


def _runs(parts: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each part with the places that have it, in their order."""
    order = np.argsort(parts, kind="stable")
    found = parts[order]
    cuts = np.flatnonzero(np.r_[True, found[1:] != found[:-1]]) if len(found) else np.zeros(0, int)
    for i, j in zip(cuts, np.r_[cuts[1:], len(found)]):
        yield int(found[i]), order[i:j]


def _dealt(texts: DataFrame, languages: list[str], deal: Deal, k: int, kind: int, by_last: bool = False) -> DataFrame:
    """The places of pass ``k`` as rows of BLOBS: the language, hashes of words, by their number u, v and w, keys of texts and how many places each has.

    Places of heavy middle words are dealt by their first word, or by their last.
    """

    def blobs(lang: int, gathered: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        to, keys, *places = (np.concatenate(x) for x in zip(*gathered))
        words = pa.array(np.concatenate(places)).dictionary_encode()
        number, hashes = words.indices.to_numpy().reshape(3, -1), words.dictionary.to_numpy()
        own = np.zeros(len(hashes), np.uint32)
        for p, x in _runs(to):
            cat = number[:, x].reshape(-1)
            mine = np.unique(cat)
            own[mine] = np.arange(len(mine))
            key = keys[x]
            first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            docs = [key[first], _small(np.diff(np.r_[first, len(x)]))] if kind else []
            yield _blob(p, kind, [np.array([lang], np.uint16), hashes[mine], *np.split(_small(own[cat]), 3), *docs])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered, n = collections.defaultdict(list), 0
        for lang, keys, every, at, of in _marked(batches, languages):
            turn, part = deal.passes_and_parts(every)
            some = np.flatnonzero(turn[at - 1] == k)
            at, of = at[some], of[some]
            to = part[at - 1]
            if len(deal.words):
                to = (to + deal.share(every[at if by_last else at - 2], deal.shares_of(every[at - 1]))) % deal.parts
            if len(at):
                gathered[lang].append([to, keys[of], every[at - 2], every[at - 1], every[at]])
                n += len(at)
            if n >= GATHERED:
                for x in gathered.items():
                    yield from blobs(*x)
                gathered, n = collections.defaultdict(list), 0
        for x in gathered.items():
            yield from blobs(*x)

    return texts.mapInArrow(run, BLOBS)


def _met(blobs: DataFrame, parts: int) -> DataFrame:
    """Blobs of a part together, by their kind."""
    return blobs.repartition(parts, "part").sortWithinPartitions("part", "kind")


def _by_part(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Iterator[tuple[int, list[np.ndarray]]]]]:
    rows = ((p, kind, data) for b in batches for p, kind, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)))
    for part, some in groupby(rows, key=lambda r: r[0]):
        yield part, ((kind, _unpacked(data.as_py())) for _, kind, data in some)


def _distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different values in order, where one of each stands, and how many there are."""
    order = np.argsort(x)
    found = x[order]
    first = np.flatnonzero(np.r_[True, found[1:] != found[:-1]]) if len(x) else np.zeros(0, int)
    return found[first], order[first], np.diff(np.r_[first, len(x)])


class Trigrams:
    """The different trigrams of a part's trusted places: keys, hashes of their words, number of their language, count."""

    def __init__(self, blobs: Iterator[tuple[int, list[np.ndarray]]]):
        self.known: list[list[np.ndarray]] = []  # of bigrams that were counted before: v, w, n, language
        u, v, w, lang = [], [], [], []
        for kind, arrays in blobs:
            if kind < 0:
                self.known.append(arrays)
                continue
            hashes = arrays[1]
            for all_of, x in zip((u, v, w), arrays[2:5]):
                all_of.append(hashes[x])
            lang.append(np.full(len(arrays[2]), arrays[0][0], np.uint16))
        u, v, w = (np.concatenate([np.zeros(0, np.uint64), *x]) for x in (u, v, w))
        lang = np.concatenate([np.zeros(0, np.uint16), *lang])
        with np.errstate(over="ignore"):
            uv = _mix(u, v)
            self.uvw, at, self.n = _distinct(_mix(uv, w))
            self.u, self.uv, self.v, self.w, self.lang = u[at], uv[at], v[at], w[at], lang[at]
            self.vw = _mix(self.v, self.w)


COUNTS = "kind int, lang int, v long, w long, n long"


def _counts(heavy: np.ndarray):
    """Rows of COUNTS of each part. 3: n trigrams have count w; 2: n bigrams follow w different words; 1: n different words stand before w; 0: n stand before the bigram v w, for heavy v."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, blobs in _by_part(batches):
            t = Trigrams(blobs)
            vw, at, n = _distinct(t.vw)
            v, w, lang = t.v[at], t.w[at], t.lang[at]
            rows = []
            for kind, langs, counts in ((3, t.lang, t.n), (2, lang, n)):
                for i in (1, 2, 3, 4):
                    ls, ns = np.unique(langs[counts == i], return_counts=True)
                    rows.append([np.full(len(ls), kind), ls, np.zeros(len(ls)), np.full(len(ls), i), ns])
            words, first, ns = np.unique(w, return_index=True, return_counts=True)
            rows.append([np.full(len(words), 1), lang[first], np.zeros(len(words)), words.view(np.int64), ns])
            some = np.isin(v, heavy)
            rows.append([np.zeros(some.sum()), lang[some], v[some].view(np.int64), w[some].view(np.int64), n[some]])
            for r in rows:
                for i in range(0, len(r[0]), 1 << 16):
                    cols = [pa.array(x[i : i + (1 << 16)].astype(kind)) for x, kind in zip(r, (np.int32, np.int32, np.int64, np.int64, np.int64))]
                    yield pa.RecordBatch.from_arrays(cols, names=["kind", "lang", "v", "w", "n"])

    return run


def _discounts(of: dict[int, int]) -> list[float]:
    """Modified Kneser-Ney's discounts for counts of 1, 2 and more, from how many n-grams have count 1 to 4."""
    n = [max(1, of.get(i, 0)) for i in (1, 2, 3, 4)]
    y = n[0] / (n[0] + 2 * n[1])
    return [max(0.05, min(i - 0.05, i - (i + 1) * y * n[i] / n[i - 1])) for i in (1, 2, 3)]


def _replicated(heavy: DataFrame, deal: Deal, k: int) -> DataFrame:
    """Counts of heavy bigrams (v, w, n, lang) as rows of BLOBS of kind -1, for each part that has places of v in pass ``k``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v, w, n, lang = (b.column(i).to_numpy() for i in range(4))
            v, w = v.view(np.uint64), w.view(np.uint64)
            turn, part = deal.passes_and_parts(v)
            shares = np.where(turn == k, deal.shares_of(v), 0)
            at = np.repeat(np.arange(len(v)), shares)
            nth = np.arange(len(at)) - np.repeat(np.cumsum(shares) - shares, shares)
            for p, some in _runs((part[at] + nth) % deal.parts):
                mine = np.unique(at[some])
                yield _blob(p, -1, [v[mine], w[mine], n[mine], lang[mine]])

    return heavy.mapInArrow(run, BLOBS)


def _made(t: Trigrams, known: Known, discounts: np.ndarray, deal: Deal) -> list[tuple[np.ndarray, ...]]:
    """By slot (uvw, uv, vw, v) of a part's entries: keys in order and without salt, values, a and c, and the last word.

    p is a + c * p of the last word alone: where tasks don't know that, the value is nan. A context has no c (nan).
    ``discounts`` goes by order (3, 2), language and count.
    """
    d3 = discounts[0, t.lang, np.minimum(t.n, 3) - 1]
    uv, of = np.unique(t.uv, return_inverse=True)
    total = np.bincount(of, t.n, len(uv))
    gamma3 = np.bincount(of, d3, len(uv)) / total
    vw, at, n = _distinct(t.vw)
    v, w, lang = t.v[at], t.w[at], t.lang[at]
    if t.known:  # all bigrams of a heavy word, as they were counted, for this part has some of its trigrams only
        light = ~np.isin(v, deal.words)
        kv, kw, kn, kl = (np.concatenate(x) for x in zip(*t.known))
        with np.errstate(over="ignore"):
            vw = np.r_[vw[light], _mix(kv, kw)]
        order = np.argsort(vw)
        vw, v, w, n, lang = (x[order] for x in (vw, np.r_[v[light], kv], np.r_[w[light], kw], np.r_[n[light], kn], np.r_[lang[light], kl]))
    bigram = np.searchsorted(vw, t.vw)
    mids, mid = np.unique(v, return_inverse=True)
    d2 = discounts[1, lang, np.minimum(n, 3) - 1]
    total2 = np.bincount(mid, n, len(mids))
    gamma2 = np.bincount(mid, d2, len(mids)) / total2
    p = np.exp(known.look(_salted(w, 4))[0])
    a2, c2 = (n - d2) / total2[mid], gamma2[mid]
    a3, c3 = (t.n - d3) / total[of] + gamma3[of] * a2[bigram], gamma3[of] * c2[bigram]
    contexts = [(key, np.log(g), g, np.full(len(key), np.nan), np.zeros(len(key), np.uint64)) for key, g in ((uv, gamma3), (mids, gamma2))]
    return [(t.uvw, np.log(a3 + c3 * p[bigram]), a3, c3, t.w), contexts[0], (vw, np.log(a2 + c2 * p), a2, c2, w), contexts[1]]


def _counted_middles(texts: DataFrame, languages: list[str]) -> DataFrame:
    """(lang, word, n): words that stand in the middle very often; those that are rare in all that a task works on at once are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, _, every, at, _ in _marked(batches, languages):
            words, n = pa.array(every[at - 1]).value_counts().flatten()
            words, n = words.to_numpy(), n.to_numpy()
            some = np.flatnonzero(n > len(at) >> 12)
            cols = [pa.array(np.full(len(some), lang, np.int32)), pa.array(words[some].view(np.int64)), pa.array(n[some])]
            yield pa.RecordBatch.from_arrays(cols, names=["lang", "word", "n"])

    return texts.mapInArrow(run, "lang int, word long, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def _text_bytes(texts: DataFrame) -> int:
    return texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0  # one row


class Counts:
    """What trusted text (lang, text) is counted to, but for what goes by middle word: that is made again in each pass."""

    def __init__(self, trusted: DataFrame):
        spark = trusted.sparkSession
        self.languages = sorted(r["lang"] for r in trusted.select("lang").distinct().collect() if r["lang"] is not None)
        self.texts = trusted.select(F.lit(0).cast("long").alias("row"), F.col("text").cast("binary").alias("text"), "lang")
        self.size, often = _text_bytes(self.texts), []
        parts = 1 + self.size // (COUNT_PASSES * TRUSTED_A_PART)
        if self.size > TOGETHER:
            with _small_batches(spark):
                often = _counted_middles(self.texts, self.languages).where(F.col("n") > TOGETHER).collect()  # one for TOGETHER trusted places at most
        self.heavy = {int(np.int64(r["word"]).astype(np.uint64)): 1 + r["n"] // TOGETHER for r in often}
        deal = Deal(COUNT_PASSES, parts, self.heavy)
        rounds = [_met(_dealt(self.texts, self.languages, deal, k, 0, by_last=True), parts).mapInArrow(_counts(deal.words), COUNTS) for k in range(COUNT_PASSES)]
        counts = reduce(DataFrame.union, [_passed(x.groupBy("kind", "lang", "v", "w").agg(F.sum("n").alias("n"))) for x in rounds])
        self.bigrams = counts.where("kind = 0").select("v", "w", "n", "lang")  # of heavy words
        seen = collections.defaultdict(dict)
        for r in counts.where("kind >= 2").groupBy("kind", "lang", "w").agg(F.sum("n").alias("n")).collect():  # eight rows for each language at most
            seen[r["kind"], r["lang"]][r["w"]] = r["n"]
        self.discounts = np.array([[_discounts(seen[kind, i]) for i in range(len(self.languages))] for kind in (3, 2)]).reshape(2, len(self.languages), 3)

        one = settled(counts.where("kind = 1").groupBy("lang", "w").agg(F.sum("n").alias("n")))
        of = one.groupBy("lang").agg(F.sum("n").alias("total"), F.count("*").alias("types"), *(F.count_if(F.col("n") == i).alias(f"n{i}") for i in (1, 2, 3, 4)))
        rest, n, p = {}, F.col("n"), F.lit(None).cast("double")
        for r in of.collect():  # a row for each language
            d = _discounts({i: r[f"n{i}"] for i in (1, 2, 3, 4)})
            freed = d[0] * r["n1"] + d[1] * r["n2"] + d[2] * (r["types"] - r["n1"] - r["n2"])
            rest[r["lang"]] = freed / r["total"] / (r["types"] + 1)
            own = (n - F.when(n == 1, d[0]).when(n == 2, d[1]).otherwise(d[2])) / r["total"] + rest[r["lang"]]
            p = F.when(F.col("lang") == r["lang"], own).otherwise(p)
        key = F.col("w").bitwiseXOR(F.lit(int(np.uint64(_salt(4)).astype(np.int64))))
        self.alone = settled(one.select(key.alias("key"), F.ln(p).alias("value"), n.alias("use")))
        self.unseen = [float(np.log(rest[i])) for i in range(len(self.languages))]

    def deal(self, size: int = 0) -> Deal:
        """For passes over ``size`` bytes of text."""
        parts = 1 + max(self.size // (PASSES * TRUSTED_A_PART), size // (PASSES * TEXT_A_PART))
        return Deal(PASSES, max(parts, LEAST_PARTS if size > LITTLE else 1), self.heavy)

    def blobs(self, deal: Deal, k: int) -> DataFrame:
        """What the entries of pass ``k`` are made of."""
        own = _dealt(self.texts, self.languages, deal, k, 0)
        return own.union(_replicated(self.bigrams, deal, k)) if len(deal.words) else own


ENTRIES = "key long, value double, a double, c double, w long"


def model(trusted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key, value, use): the table of logs; (lang, unseen): ln p of a word that the language doesn't have.

    ``trusted`` has lang and text. The probability of w after u v is that of the longest n-gram the table has,
    times gamma of every longer context that it has. Keys hold the language, so only discounts go by language.
    ``use`` is how many different words a word follows, and 0 for other entries. The table is made pass by pass when it
    is read; ``scored`` doesn't read it, but has each part's entries made where they are asked for (``counts``).
    """
    spark, counts = trusted.sparkSession, Counts(trusted)
    known, deal = Known(counts.alone), counts.deal()
    shared = spark.sparkContext.broadcast(known)
    discounts = counts.discounts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, blobs in _by_part(batches):
            slots = _made(Trigrams(blobs), shared.value, discounts, deal)
            key, value, a, c, w = (np.concatenate(x) for x in zip(*((_salted(x[0], i), *x[1:]) for i, x in enumerate(slots))))
            for i in range(0, len(key), 1 << 16):
                s = slice(i, i + (1 << 16))
                cols = [pa.array(key[s].view(np.int64)), pa.array(value[s], mask=np.isnan(value[s])), pa.array(a[s]), pa.array(c[s]), pa.array(_salted(w[s], 4).view(np.int64))]
                yield pa.RecordBatch.from_arrays(cols, names=["key", "value", "a", "c", "w"])

    tables = [counts.alone]
    for k in range(PASSES):
        found = _met(counts.blobs(deal, k), deal.parts).mapInArrow(run, ENTRIES)
        if not known.whole:
            p = counts.alone.select(F.col("key").alias("w"), F.exp("value").alias("p"))
            late = found.where("value is null").join(p, "w").select("key", F.ln(F.col("a") + F.col("c") * F.col("p")).alias("value"))
            found = found.where("value is not null").select("key", "value").union(late)
        found = found.dropDuplicates(["key"]) if counts.heavy else found  # several parts have a heavy word's bigrams
        tables.append(found.select("key", "value", F.lit(0).cast("long").alias("use")))
    entries = reduce(DataFrame.union, tables)
    entries.counts, entries.words = counts, shared
    return entries, spark.createDataFrame(list(zip(counts.languages, counts.unseen)), "lang string, unseen double")


class Known:
    """What every task has of the words alone: ln p of the most frequent, and a filter that lets all others through."""

    def __init__(self, alone: DataFrame, frequent: int | None = None, bits: int | None = None):
        often = F.least("use", F.lit(4096)).alias("often")
        upto, self.least, self.whole = 0, 1 << 62, True
        for r in sorted(alone.groupBy(often).count().collect(), key=lambda r: -r["often"]):  # 4,096 rows at most
            upto += r["count"]
            if upto > (FREQUENT if frequent is None else frequent):
                self.whole = False
                break
            self.least = r["often"]
        some = alone.where(F.col("use") >= self.least).select("key", F.col("value").cast("float").alias("value")).toArrow()  # ``frequent`` rows at most
        keys, values = some["key"].to_numpy().view(np.uint64), some["value"].to_numpy()
        order = np.argsort(keys)
        self.table = Table(keys[order], values[order])
        self.others = None if self.whole else KeyFilter(alone.where(F.col("use") < self.least).select("key"), FILTER_BITS if bits is None else bits)

    def look(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(values, nan for what isn't at hand; whether the table may have it all the same)."""
        value = self.table.look(keys)
        maybe = np.isnan(value)
        if self.others is None:
            return value, np.zeros(len(keys), bool)
        maybe[maybe] = self.others.maybe(keys[maybe])
        return value, maybe


class Table:
    """Values by key. Keys are hashes, so the first bits of one tell nearly where it stands among the sorted."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        """``keys`` are in order."""
        self.keys, self.values = keys, values
        self._index()

    def _index(self) -> None:
        keys = self.keys
        self.shift = np.uint64(64 - max(1, len(keys).bit_length()))
        self.first = np.searchsorted(self.keys >> self.shift, np.arange(1 << int(64 - self.shift), dtype=np.uint64)).astype(np.uint32)

    def __getstate__(self) -> tuple[bytes, bytes, str]:
        """Steps between keys and values, byte by byte: most first bytes of the former are zero, and of the latter there are few."""
        steps = np.diff(self.keys, prepend=np.uint64(0))
        return *(_squeezed(x.view(np.uint8).reshape(len(x), -1).T.tobytes() if len(x) else b"") for x in (steps, np.ascontiguousarray(self.values))), self.values.dtype.str

    def __setstate__(self, state: tuple[bytes, bytes, str]) -> None:
        steps, values = (np.frombuffer(_spread(x), np.uint8) for x in state[:2])
        kind = np.dtype(state[2])
        n = len(steps) // 8
        self.keys = np.cumsum(np.ascontiguousarray(steps.reshape(8, n).T).view(np.uint64).reshape(-1), dtype=np.uint64)
        self.values = np.ascontiguousarray(values.reshape(kind.itemsize, n).T).view(kind).reshape(-1)
        self._index()

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Where keys stand, -1 for those that don't."""
        out = np.full(len(keys), -1)
        if not len(self.keys):
            return out
        at, left = self.first[keys >> self.shift].astype(np.int64), np.arange(len(keys))
        while len(left):
            inside = at < len(self.keys)
            at, left, keys = (x if inside.all() else x[inside] for x in (at, left, keys))
            here = self.keys[at]
            same = here == keys
            out[left[same]] = at[same]
            on = here < keys
            at, left, keys = at[on] + 1, left[on], keys[on]
        return out

    def look(self, keys: np.ndarray, default: float = np.nan) -> np.ndarray:
        return _taken(self.values, self.find(keys), default)


def _taken(values: np.ndarray, at: np.ndarray, default: float) -> np.ndarray:
    """Values at these places, the default for -1."""
    out, some = np.full(len(at), default), np.flatnonzero(at >= 0)
    out[some] = values[at[some]]
    return out


SUMS = "row long, nll double, n long, ask long, a double, c double"


def surprise(known: Known, missing: float, tables: list[Table], apart: list[tuple[np.ndarray, np.ndarray]], arrays: list[np.ndarray]) -> list[np.ndarray]:
    """Of a part's places: keys of texts, the sum of -ln p that is known, and how many words that is; then the open places.

    Of an open place, the last two columns say p as a + c * p of a word alone, whose key stands before them. ``tables`` has
    the values of a part's entries by slot, ``apart`` their a and c. A trigram is in the table only if its bigram is.
    """
    _, hashes, u, v, w, rows, n = arrays
    of_v, last = v, hashes[w]
    u, v = hashes[u], hashes[v]
    with np.errstate(over="ignore"):
        uv, at2 = _mix(u, v), tables[2].find(_mix(v, last))
        two = np.flatnonzero(at2 >= 0)
        at3 = tables[0].find(_mix(uv[two], last[two]))
    new, whole = np.flatnonzero(at2 < 0), two[at3 >= 0]
    at2, at3 = at2[two], at3[at3 >= 0]
    log, gamma, short = np.zeros(len(v)), np.zeros(len(v)), np.ones(len(v), bool)
    log[two] = tables[2].values[at2]
    log[whole] = tables[0].values[at3]
    short[whole] = False  # the context's gamma counts for the others
    gamma[short] = tables[1].look(uv[short], 0.0)
    asked_of = np.zeros(len(hashes), bool)
    asked_of[of_v[new]] = True
    by_word = np.zeros(len(hashes))
    by_word[asked_of] = tables[3].look(hashes[asked_of], 0.0)
    gamma[new] += by_word[of_v[new]]
    asked_of[:] = False
    asked_of[w[new]] = True
    ln, maybe = known.look(_salted(hashes[asked_of], 4))
    by_word[asked_of] = np.where(maybe, np.nan, np.where(np.isnan(ln), missing, ln))
    log[new] = by_word[w[new]]
    log += gamma
    asked = np.isnan(log)
    of = np.repeat(np.arange(len(rows)), n)
    out = [rows, -np.bincount(of, np.where(asked, 0.0, log), len(rows)), n.astype(np.int64), *(np.zeros(len(rows), x) for x in (np.int64, float, float))]
    if not asked.any():
        return out
    a, c, times = np.zeros(len(v)), np.ones(len(v)), np.exp(gamma)
    for to, at, (x, y) in ((two, at2, apart[1]), (whole, at3, apart[0])):
        a[to], c[to] = x[at], y[at]
    more = [rows[of[asked]], np.zeros(asked.sum()), np.zeros(asked.sum(), np.int64), _salted(last[asked], 4).view(np.int64), (times * a)[asked], (times * c)[asked]]
    return [np.concatenate(x) for x in zip(out, more)]


def scored(docs: DataFrame, entries: DataFrame, unseen: DataFrame, frequent: int | None = None, bits: int | None = None) -> DataFrame:
    """``docs`` (text, lang and more) without the text, with n, the predicted words, and nll, the sum of their -ln p; null for languages without a model.

    ``entries`` and ``unseen`` are those of ``model``. Rows of the same text and language have one key; what is summed
    over all of them is divided by their number.
    """
    spark, counts = docs.sparkSession, entries.counts
    missing, discounts = counts.unseen, counts.discounts
    keyed = docs.withColumn("_row", F.xxhash64("lang", "text"))
    texts = keyed.select(F.col("_row").alias("row"), F.col("text").cast("binary").alias("text"), "lang")
    deal = counts.deal(_text_bytes(texts))
    shared = entries.words if (frequent, bits) == (None, None) else spark.sparkContext.broadcast(Known(counts.alone, frequent, bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for _, blobs in _by_part(batches):
            first, rest = [], None
            blobs = iter(blobs)
            for blob in blobs:  # by kind: what entries are made of comes first
                if blob[0] > 0:
                    rest = blob
                    break
                first.append(blob)
            if rest is None:
                continue
            slots = _made(Trigrams(first), known, discounts, deal)
            tables, apart = [Table(x[0], x[1].astype(np.float32)) for x in slots], [x[2:4] for x in slots[::2]]
            del first, slots
            for _, arrays in chain([rest], blobs):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in surprise(known, missing[arrays[0][0]], tables, apart, arrays)], names=["row", "nll", "n", "ask", "a", "c"])

    found = []
    for k in range(PASSES):
        sums = _met(counts.blobs(deal, k).union(_dealt(texts, counts.languages, deal, k, 1)), deal.parts).mapInArrow(run, SUMS)
        times = F.count("*").alias("times")
        found.append(_passed(sums.groupBy("row", "ask", "a", "c").agg(F.sum("nll").alias("nll"), F.sum("n").alias("n"), times)))
    sums = reduce(DataFrame.union, found)
    if not shared.value.whole:
        others = counts.alone.where(F.col("use") < shared.value.least).select(F.col("key").alias("ask"), F.exp("value").alias("p"))
        by = spark.createDataFrame(list(zip(counts.languages, missing)), "lang string, unseen double")
        asked = sums.where("ask <> 0").join(others, "ask", "left").join(keyed.select(F.col("_row").alias("row"), "lang").distinct(), "row").join(F.broadcast(by), "lang")  # a row for each language
        log = F.ln(F.col("a") + F.col("c") * F.coalesce("p", F.exp("unseen")))
        sums = sums.where("ask = 0").select("row", "nll", "n").union(asked.select("row", (-log * F.col("times")).alias("nll"), F.lit(0).cast("long").alias("n")))
    sums = sums.groupBy(F.col("row").alias("_row")).agg(F.sum("nll").alias("nll"), F.sum("n").alias("n"))
    own = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    each = keyed.select(*own, "_row").withColumn("_copies", F.count("*").over(Window.partitionBy("_row")))
    return each.join(sums, "_row", "left").select(*own, (F.col("n") / F.col("_copies")).cast("long").alias("n"), (F.col("nll") / F.col("_copies")).alias("nll"))


def smallest(ids: DataFrame, by: str, of: str, n: int) -> DataFrame:
    """At most ``n`` rows of each group, those of the smallest hashes; only a few more than these are ever ranked together."""
    share = F.shiftrightunsigned(F.xxhash64(of), 1) / F.lit(float(1 << 63))
    sizes = ids.groupBy(by).agg(F.count("*").alias("_n"))
    few = ids.join(sizes, by).where(share * F.col("_n") < n + 8 * n**0.5)
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.shiftrightunsigned(F.xxhash64(of), 1), of))
    return few.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank", "_n")


def classify(docs: DataFrame, labels: DataFrame, per_language: int | None = ROWS_PER_LANGUAGE, quantile: float = QUANTILE, room: float = ROOM) -> DataFrame:
    """One row per document: doc_id, lang, n_words, perplexity, threshold (its language's) and kept.

    Trusted texts are those that ``labels`` gives quality 1; counts are taken from ``per_language`` of them at most,
    from all for None. Of these, one in five is held out of the counts; a
    language's threshold is ``room`` times the ``quantile`` of perplexity over its held-out trusted texts.
    Perplexity credits every text with PRIOR_WORDS words of the language's usual surprise. A document of a
    language without trusted text (null too) has no threshold and is kept. Null and empty texts are an end mark
    alone. Repeated rows give a row each, labels that repeat an id count once, other columns are ignored; an
    empty table gives an empty result.
    """
    own = docs.select("doc_id", "text", "lang")
    good = labels.where("quality = 1 and doc_id is not null").select("doc_id").distinct()
    held = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(HELD_SHARE)) == 0
    named = own.select("doc_id", "lang").where("doc_id is not null and lang is not null").join(good.where(~held), "doc_id", "left_semi").distinct()
    if per_language is None:
        trusted = own.where("lang is not null").join(good.where(~held), "doc_id", "left_semi").select("lang", "text")
    else:  # at most per_language ids of each language: a broadcast of a known size
        trusted = own.join(F.broadcast(smallest(named, "lang", "doc_id", per_language)), ["doc_id", "lang"]).select("lang", "text")
    with _held(docs.sparkSession, "spark.sql.parquet.compression.codec", "zstd"):
        trusted = settled(trusted)
    entries, unseen = model(trusted)
    languages = [r["lang"] for r in unseen.collect()]  # of these, words are counted when they are scored
    counted = F.when(F.col("lang").isin(languages), F.lit(None)).otherwise(F.size(words(F.col("text")))).cast("long")
    rows = settled(scored(own.withColumn("n_words", counted), entries, unseen)).withColumn("n_words", F.coalesce("n_words", F.col("n") - 1))
    aside = rows.join(good.where(held), "doc_id", "left_semi").groupBy("lang").agg(F.sum("nll").alias("all"), F.sum("n").alias("of"))
    usual = F.col("all") / F.col("of")
    credited = F.exp((F.col("nll") + PRIOR_WORDS * usual) / (F.col("n") + PRIOR_WORDS))
    with_p = rows.join(F.broadcast(aside), "lang", "left").select("doc_id", "lang", "n_words", credited.alias("perplexity"))  # a row for each language
    limits = with_p.join(good.where(held), "doc_id", "left_semi").groupBy("lang").agg((room * F.percentile_approx("perplexity", quantile, 10_000)).alias("threshold"))
    return with_p.join(F.broadcast(limits), "lang", "left").select("doc_id", "lang", "n_words", "perplexity", "threshold", F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True)).alias("kept"))
