"""Jaccard self-join of documents' word n-grams by extended prefixes: single tokens where they are rare, pairs of tokens where they are frequent."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from marginalia.llm.filters import KeyFilter
from marginalia.operators.graph import connected_components
from marginalia.storage import materialise

WIDTH = 5
#: Two sets link when PART[1] * intersection >= PART[0] * union. Has to be over one half.
PART = (80, 100)
#: A token in more prefixes than this is frequent. There are at most so many frequent tokens: beyond that the least frequent of them count as rare.
RARE, FREQUENT = 32, 1 << 20
#: A key that more sets have is joined by stars first, and by blocks of so many sets afterwards.
LIST, BLOCK = 64, 1024
#: Of each set's pairs in a block so many are compared before all others are.
NEAREST = 3
#: A pair that shares several hot keys is given by the least of so many of either set's, if these have one in common.
LEAST = 16
#: Bytes of text that are hashed at once; a longer text is hashed alone.
CHUNK = 1 << 18

_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_RANDOM = np.random.Generator(np.random.PCG64(11)).integers(0, 2**64, 256, dtype=np.uint64)
_BYTE = np.where(_SPACE, _RANDOM[32], _RANDOM[np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)])])
_RATIO = 0x9E3779B97F4A7C15
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits whose every bit depends on all (the finalizer of SplitMix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(n: int) -> list[np.ndarray]:
    """Powers of the ratio and of its inverse modulo 2**64, ``n`` at least."""
    if len(_POWERS[0]) < n:
        for i, base in enumerate((_RATIO, pow(_RATIO, -1, 1 << 64))):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _POWERS[i] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS


def _hashed(texts: list[bytes], width: int) -> list[np.ndarray]:
    """The distinct hashes of each text's shingles, sorted.

    A shingle is a range of the bytes in which every run of white space is one space: its hash is a difference of
    prefix sums of random values by byte, weighted by powers, shifted to the range's start and mixed.
    """
    sizes = np.array([len(t) + 1 for t in texts])
    raw = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    space = _SPACE[raw]
    before = np.r_[True, space[:-1]]
    starts = np.flatnonzero(before & ~space)
    kept = np.flatnonzero(~(before & space))
    if not len(starts):
        return [np.zeros(0, np.uint64)] * len(texts)
    up, down = (p[: len(kept)] for p in _powers(len(kept)))
    sums = np.r_[np.zeros(1, np.uint64), np.cumsum(_BYTE[raw[kept]] * up, dtype=np.uint64)]
    first = np.searchsorted(kept, starts)  # where words begin and end among the kept bytes
    last = np.searchsorted(kept, np.flatnonzero(~before & space))
    of = np.searchsorted(starts, np.r_[0, np.cumsum(sizes)])  # each text's words
    ranged = lambda a, b: _mixed((sums[last[b]] - sums[first[a]]) * down[first[a]])
    all_of = ranged(np.arange(len(starts) - width + 1), np.arange(width - 1, len(starts))) if len(starts) >= width else np.zeros(0, np.uint64)
    out = []
    for a, b in zip(of[:-1].tolist(), of[1:].tolist()):
        if b - a >= width:
            h = np.sort(all_of[a : b - width + 1])
            out.append(h[np.r_[True, h[1:] != h[:-1]]])
        else:
            out.append(ranged(np.array([a]), np.array([b - 1])) if b > a else np.zeros(0, np.uint64))
    return out


def shingle_sets(texts: list[bytes | None], width: int = WIDTH) -> Iterator[np.ndarray]:
    """The sets of 64-bit hashes of the lower-cased (A-Z) ``width``-word shingles of UTF-8 texts; a text of fewer words has one, of none an empty set."""
    held, size = [], 0
    for t in texts:
        t = t or b""
        if held and size + len(t) > CHUNK:
            yield from _hashed(held, width)
            held, size = [], 0
        held.append(t)
        size += len(t)
    if held:
        yield from _hashed(held, width)


def set_key(tokens: np.ndarray) -> int:
    """64-bit key of a set, signed."""
    return int(np.frombuffer(xxhash.xxh3_64_digest(tokens.tobytes()), ">i8")[0])


def parity(tokens: np.ndarray) -> bytes:
    """One bit for each of 2**k places, 2**k the least power of two over the set's size and 64 at least: whether an odd number of tokens falls there.

    As many tokens at least are in only one of two sets as bits differ, so the bitmaps can show that two sets don't link.
    """
    places = max(64, 1 << (len(tokens) - 1).bit_length())
    return np.packbits(np.bincount((tokens & np.uint64(places - 1)).astype(np.int64), minlength=places) & 1, bitorder="little").tobytes()


def apart(a: bytes, b: bytes) -> int:
    """The number of bits in which two bitmaps differ, the larger one folded to the size of the smaller."""
    x, y = sorted((a, b), key=len)
    low, high = int.from_bytes(x, "little"), int.from_bytes(y, "little")
    bits = 8 * len(y)
    while bits > 8 * len(x):
        bits //= 2
        high = (high >> bits) ^ (high & ((1 << bits) - 1))
    return (low ^ high).bit_count()


def lost(n: int, part: tuple[int, int]) -> int:
    """How many tokens of a set of ``n`` a linked set may lack."""
    return n - -(-part[0] * n // part[1])


def _isin(tokens: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """Whether each token is in a sorted array."""
    if not len(frequent):
        return np.zeros(len(tokens), bool)
    return frequent[np.minimum(np.searchsorted(frequent, tokens), len(frequent) - 1)] == tokens


def levels(n: int, part: tuple[int, int]) -> range:
    """Sizes that may link fall on some common level: a set has its own, and those that larger linked sets may have."""
    return range(n.bit_length(), (n * part[1] // part[0]).bit_length() + 1)


def signature(tokens: np.ndarray, frequent: np.ndarray, part: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """(single tokens, hashed pairs of tokens) of which two linked sets share one at least.

    Tokens are ordered: rare ones by hash, then frequent ones by hash. Enough rare tokens, one more than may be
    lost, are a prefix of single tokens. A set with fewer takes all of them, and its prefix is extended into the
    frequent ones. These are dealt to classes by hash, and a class of x tokens in the prefix makes up for x - 1
    lost ones, for two of them are left if fewer are lost; the pairs within classes are the keys. The number of
    classes follows the level, so that classes stay small and pairs grow as the set does.
    """
    need = lost(len(tokens), part) + 1
    common = _isin(tokens, frequent)
    rare, often = tokens[~common], tokens[common]
    if len(rare) >= need or not len(often):
        return rare[:need], np.zeros(0, np.uint64)
    out = []
    for level in levels(len(tokens), part):
        classes = np.uint64(max(1, (1 << level) // 16))
        of = (often >> np.uint64(17)) % classes
        covers = np.ones(len(often), np.int64)
        covers[np.unique(of, return_index=True)[1]] = 0  # a class's first token
        taken = int(np.searchsorted(np.cumsum(covers), need - len(rare))) + 1
        own, of = often[:taken], of[:taken]
        order = np.lexsort((own, of))
        own, of = own[order], of[order]
        for gap in range(1, len(own)):
            same = np.flatnonzero(of[gap:] == of[:-gap])
            if not len(same):
                break
            out.append(_mixed(own[same] * np.uint64(3) + _mixed(own[same + gap] + np.uint64(level))))
    return rare, np.concatenate(out) if out else np.zeros(0, np.uint64)


class _Seen:
    """Keys that a task has met, forgotten now and then: what is forgotten is only sent twice."""

    def __init__(self) -> None:
        self.keys: set[int] = set()

    def again(self, key: int) -> bool:
        if key in self.keys:
            return True
        if len(self.keys) >= 1 << 20:
            self.keys.clear()
        self.keys.add(key)
        return False


def _lists(values: list[np.ndarray]) -> pa.Array:
    ends = np.r_[0, np.cumsum([len(v) for v in values])].astype(np.int32)
    flat = np.concatenate(values).view(np.int64) if values else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch of texts in pieces of some MB."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    cuts = np.flatnonzero(np.diff(ends // (8 * CHUNK))) + 1 if len(ends) else []
    for a, b in zip([0, *cuts], [*cuts, len(ends)]):
        if b > a:
            yield batch.slice(a, b - a)


def sets(docs: DataFrame, id_col: str, text_col: str, width: int, part: tuple[int, int]) -> DataFrame:
    """(doc_id, n, key, bits, prefix) of each row: its set's size, key and bitmap, and the tokens of its prefix by hash, null where a task has sent them already."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = _Seen()
        for whole in batches:
            for batch in _parts(whole):
                n, keys, bits, prefix = [], [], [], []
                for tokens in shingle_sets(batch.column("text").to_pylist(), width):
                    key = set_key(tokens)
                    new = bool(len(tokens)) and not seen.again(key)
                    n.append(len(tokens))
                    keys.append(key)
                    bits.append(parity(tokens) if new else None)
                    prefix.append(tokens[: lost(len(tokens), part) + 1] if new else tokens[:0])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(keys, pa.int64()), pa.array(bits, pa.binary()), _lists(prefix)], ["doc_id", "n", "key", "bits", "prefix"])

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n long, key long, bits binary, prefix array<long>")


def _frequent(counts: DataFrame, rare: int, most: int) -> np.ndarray:
    """Tokens counted more than ``rare`` times, sorted; the ``most`` of highest count or fewer, so what all tasks get is bounded."""
    while counts.where(F.col("count") > rare).count() > most:
        rare *= 2
    return np.sort(counts.where(F.col("count") > rare).select("token").distinct().toArrow()["token"].to_numpy().view(np.uint64))


def counted(tokens: np.ndarray, sets: list[np.ndarray], part: tuple[int, int]) -> int:
    """How many of a set's tokens, by hash, are counted when each of ``sets`` has turned out to be frequent in turn.

    At first as many as a prefix needs; then as many as will hold enough rare ones if the rest is like what was seen,
    and half as many again.
    """
    need = at = lost(len(tokens), part) + 1
    for frequent in sets:
        common = int(_isin(tokens[:at], frequent).sum())
        if common:
            at = max(at, min(len(tokens), -(-3 * need * at // (2 * max(at - common, 1)))))
    return at


def frequent_tokens(docs: DataFrame, found: DataFrame, text_col: str, width: int, part: tuple[int, int], rare: int, most: int, rounds: int) -> np.ndarray:
    """Tokens that are in more than ``rare`` prefixes.

    Prefixes by hash are counted first. Where frequent tokens push a set's prefix on to further tokens, these are
    counted in turn, until nothing is new or after so many rounds; a frequent token that is missed costs time only.
    """

    def further(batches: Iterator[pa.RecordBatch], sets: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        seen = _Seen()
        for whole in batches:
            for batch in _parts(whole):
                new = [np.zeros(0, np.uint64)]
                for tokens in shingle_sets(batch.column("text").to_pylist(), width):
                    if len(tokens):
                        low, high = counted(tokens, sets[:-1], part), counted(tokens, sets, part)
                        if high > low and not seen.again(set_key(tokens)):
                            new.append(tokens[low:high])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(new).view(np.int64))], ["token"])

    count = lambda tokens: materialise(tokens.groupBy("token").count().where(F.col("count") > rare))
    counts = count(found.select(F.explode("prefix").alias("token")))
    sets = [_frequent(counts, rare, most)]
    texts = docs.select(F.col(f"`{text_col}`").cast("binary").alias("text"))
    for _ in range(rounds):
        if len(sets[-1]) in (len(sets[-2]) if len(sets) > 1 else 0, most):
            break
        counts = counts.union(count(texts.mapInArrow(lambda b, x=tuple(sets): further(b, list(x)), "token long")))
        sets.append(_frequent(counts, rare, most))
    return sets[-1]


def entries(docs: DataFrame, text_col: str, width: int, part: tuple[int, int], frequent: np.ndarray) -> DataFrame:
    """(token, pair, key, n): the keys under which each set is looked for."""
    schema = pa.schema([("token", pa.int64()), ("pair", pa.bool_()), ("key", pa.int64()), ("n", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = _Seen()
        for whole in batches:
            for batch in _parts(whole):
                found, sizes, keys, of = [], [], [], []
                for tokens in shingle_sets(batch.column("text").to_pylist(), width):
                    key = set_key(tokens)
                    if len(tokens) and not seen.again(key):
                        for pair, some in enumerate(signature(tokens, frequent, part)):
                            found.append(some)
                            sizes.append(len(some))
                            keys.append((key, pair))
                            of.append(len(tokens))
                if found:
                    spread = lambda x, t: np.repeat(np.array(x, t), sizes)  # noqa: E731, B023
                    flat = np.concatenate(found).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(flat), pa.array(spread([p for _, p in keys], bool)), pa.array(spread([k for k, _ in keys], np.int64)), pa.array(spread(of, np.int32))], schema=schema)

    return docs.select(F.col(f"`{text_col}`").cast("binary").alias("text")).mapInArrow(run, "token long, pair boolean, key long, n int")


PAIR = "a long, b long, na int, nb int"
_PAIR = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("na", pa.int32()), ("nb", pa.int32())])


def _pairs_of_lists(batches: Iterator[pa.RecordBatch], part: tuple[int, int], longest: int) -> Iterator[pa.RecordBatch]:
    """Pairs of sets of sizes that may link, of each token's list; rows come sorted by (token, key).

    A list of ``longest`` sets or fewer gives all pairs. A longer one gives the pairs of its first set with all others,
    as they stream past, and a row (token, null), which says that the rest is to do.
    """
    schema = _PAIR
    rest = [np.zeros(0, np.int64) for _ in range(3)]
    hub = None  # of a long list that goes on

    def fitting(x: np.ndarray) -> np.ndarray:
        return x[part[1] * np.minimum(x[:, 2], x[:, 3]) >= part[0] * np.maximum(x[:, 2], x[:, 3])]

    def star(key: int, n: int, keys: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        return fitting(np.stack([np.full(len(keys), key), keys, np.full(len(keys), n), sizes], 1))

    def paired(token: np.ndarray, key: np.ndarray, n: np.ndarray, last: bool) -> pa.RecordBatch:
        nonlocal rest, hub
        found, hot = [np.zeros((0, 4), np.int64)], []
        starts = np.flatnonzero(np.r_[True, token[1:] != token[:-1]]) if len(token) else np.zeros(0, np.int64)
        sizes = np.diff(np.r_[starts, len(token)])
        if hub and len(token) and token[0] == hub[0]:
            found.append(star(hub[1], hub[2], key[: sizes[0]], n[: sizes[0]]))
            token, key, n = token[sizes[0] :], key[sizes[0] :], n[sizes[0] :]
            starts, sizes = starts[1:] - sizes[0], sizes[1:]
        if len(token):
            hub = None
        for i in np.flatnonzero(sizes > longest):
            at, to = starts[i], starts[i] + sizes[i]
            found.append(star(key[at], n[at], key[at + 1 : to], n[at + 1 : to]))
            hot.append(token[at])
            hub = (token[at], key[at], n[at]) if to == len(token) else None
        short = np.repeat(sizes <= longest, sizes)
        if len(sizes) and not last and sizes[-1] <= longest:  # the last list may go on
            rest = [x[starts[-1] :] for x in (token, key, n)]
            short[starts[-1] :] = False
        else:
            rest = [np.zeros(0, np.int64) for _ in range(3)]
        at, gap = np.flatnonzero(short), 0
        while len(at):
            gap += 1
            at = at[at + gap < len(token)]
            at = at[token[at] == token[at + gap]]
            found.append(fitting(np.stack([key[at], key[at + gap], n[at], n[at + gap]], 1)))
        every = np.unique(np.concatenate(found), axis=0)
        columns = [np.r_[every[:, 0], np.array(hot, np.int64)], *(np.r_[every[:, i], np.zeros(len(hot), np.int64)] for i in (1, 2, 3))]
        none = np.r_[np.zeros(len(every), bool), np.ones(len(hot), bool)]
        return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), *(pa.array(x, f.type, mask=none) for x, f in zip(columns[1:], list(schema)[1:]))], schema=schema)

    def run(held: list[pa.RecordBatch], last: bool) -> pa.RecordBatch:
        token, key, n = (np.concatenate([r, *(b.column(c).to_numpy().astype(np.int64) for b in held)]) for c, r in zip(("token", "key", "n"), rest))
        new = np.r_[True, (token[1:] != token[:-1]) | (key[1:] != key[:-1])] if len(token) else np.zeros(0, bool)
        return paired(token[new], key[new], n[new], last)

    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(x.num_rows for x in held) > 1 << 16:
            yield run(held, False)
            held = []
    yield run(held, True)


def heavy_tokens(every: DataFrame) -> DataFrame:
    """(token): those that make up over a thousandth of some task's rows, and over 64 of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, int] = {}
        rows = 0
        for batch in batches:
            token, times = np.unique(batch.column(0).to_numpy(), return_counts=True)
            rows += batch.num_rows
            for t, c in zip(token[times > 3].tolist(), times[times > 3].tolist()):
                counts[t] = counts.get(t, 0) + c
        found = [t for t, c in counts.items() if c > max(64, rows // 1000)]
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64())], ["token"])

    return materialise(every.select("token").mapInArrow(run, "token long").distinct())


def _may_link(rows: DataFrame, bits: DataFrame, part: tuple[int, int]) -> DataFrame:
    """Those of the pairs whose bitmaps don't show that too many tokens are in only one of the two."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("na").to_numpy().astype(np.int64) + batch.column("nb").to_numpy()
            differ = np.array([apart(x, y) for x, y in zip(batch.column("bits_a").to_pylist(), batch.column("bits_b").to_pylist())], np.int64)
            keep = pa.array((part[0] + part[1]) * differ <= (part[1] - part[0]) * sizes)
            yield batch.select([f.name for f in _PAIR]).filter(keep)

    side = lambda c: bits.select(F.col("key").alias(c), F.col("bits").alias(f"bits_{c}"))
    return rows.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "bits_a", "bits_b").mapInArrow(run, PAIR)


def _tokens_of(docs: DataFrame, text_col: str, width: int, wanted: DataFrame) -> DataFrame:
    """(key, tokens) of the sets that ``wanted`` names: texts are read once more, and a filter sized by their number tells which sets are sent."""
    count = wanted.count()
    named = KeyFilter(wanted, 1 << min(28, max(12, (16 * count).bit_length())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = _Seen()
        for whole in batches:
            for batch in _parts(whole):
                keys, tokens = [], []
                for found in shingle_sets(batch.column("text").to_pylist(), width):
                    keys.append(set_key(found))
                    tokens.append(found)
                wanted = named.maybe(np.array(keys, np.int64).view(np.uint64))
                some = [i for i in np.flatnonzero(wanted).tolist() if len(tokens[i]) and not seen.again(keys[i])]
                yield pa.RecordBatch.from_arrays([pa.array([keys[i] for i in some], pa.int64()), _lists([tokens[i] for i in some])], ["key", "tokens"])

    found = docs.select(F.col(f"`{text_col}`").cast("binary").alias("text")).mapInArrow(run, "key long, tokens array<long>")
    return materialise(found.join(wanted, "key", "left_semi").dropDuplicates(["key"]))


def _linked(pairs: DataFrame, tokens: DataFrame, part: tuple[int, int]) -> DataFrame:
    """Those of the pairs whose sets are alike, by their exact intersection."""
    side = lambda c: tokens.select(F.col("key").alias(c), F.col("tokens").alias(f"tokens_{c}"))
    both = F.size(F.array_intersect("tokens_a", "tokens_b"))
    rows = pairs.join(side("b"), "b").join(side("a"), "a")
    return rows.where(part[1] * both >= part[0] * (F.col("na") + F.col("nb") - both)).select("a", "b")


def _folded(words: np.ndarray, width: int) -> np.ndarray:
    """Bitmaps (rows of 64-bit words) folded to ``width`` words."""
    while words.shape[1] > width:
        half = words.shape[1] // 2
        words = words[:, :half] ^ words[:, half:]
    return words


def _pairs_of_blocks(batches: Iterator[pa.RecordBatch], part: tuple[int, int], nearest: int | None) -> Iterator[pa.RecordBatch]:
    """Pairs of sets, one of either of two blocks, that are in different components and that sizes and bitmaps allow.

    With ``nearest``, of each set's pairs only so many whose bitmaps are most alike.

    Rows come sorted by (token, block, other, side): the sets of the first block are held as matrices by the width of
    their bitmaps, those of the second are compared with all of them as they stream past.
    """
    now, held, by_width = None, [], {}

    def matrices() -> dict[int, tuple]:
        rows = pa.Table.from_batches(held)
        key, n, root = (rows.column(c).to_numpy() for c in ("key", "n", "root"))
        bits = rows.column("bits").to_pylist()
        width = np.array([len(x) // 8 for x in bits])
        least = np.full((len(key), LEAST), np.iinfo(np.int64).min)
        for i, few in enumerate(rows.column("few").to_pylist()):
            least[i, : len(few)] = few
        return {w: (key[at], n[at].astype(np.int64), root[at], np.frombuffer(b"".join(bits[i] for i in at), "<u8").reshape(-1, w), least[at]) for w in np.unique(width).tolist() for at in [np.flatnonzero(width == w)]}

    for batch in batches:
        at = list(zip(*(batch.column(c).to_pylist() for c in ("token", "block", "other", "side"))))
        found = [np.zeros((0, 4), np.int64)]
        for i, (group, side) in enumerate((x[:3], x[3]) for x in at):
            if group != now:
                now, held, by_width = group, [], {}
            if side == 0:
                held.append(batch.slice(i, 1))
                continue
            if not held:
                continue
            by_width = by_width or matrices()
            key, n, root, bits = (batch.column(c)[i].as_py() for c in ("key", "n", "root", "bits"))
            own = np.frombuffer(bits, "<u8").reshape(1, -1)
            few = np.array(batch.column("few")[i].as_py(), np.int64)
            for w, (keys, sizes, roots, words, least) in by_width.items():
                some = (roots != root) & (part[1] * np.minimum(sizes, n) >= part[0] * np.maximum(sizes, n))
                if group[1] == group[2]:
                    some &= keys < key
                some = np.flatnonzero(some)
                if len(some):
                    low = min(w, own.shape[1])
                    differ = np.bitwise_count(_folded(words[some], low) ^ _folded(own, low)).sum(axis=1, dtype=np.int64)
                    may = (part[0] + part[1]) * differ <= (part[1] - part[0]) * (sizes[some] + n)
                    some, differ = some[may], differ[may]
                    both = (least[some][:, :, None] == few).any(axis=2)
                    first = np.where(both, least[some], np.iinfo(np.int64).max).min(axis=1)
                    here = (first == group[0]) | ~both.any(axis=1)
                    some = some[here]
                    if nearest:
                        some = some[np.argsort(differ[here], kind="stable")[:nearest]]
                    swap = keys[some] > key
                    found.append(np.stack([np.where(swap, key, keys[some]), np.where(swap, keys[some], key), np.where(swap, n, sizes[some]), np.where(swap, sizes[some], n)], 1))
        every = np.unique(np.concatenate(found), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(every[:, j], f.type) for j, f in enumerate(_PAIR)], schema=_PAIR)


def _across(hot: DataFrame, sizes: DataFrame, bits: DataFrame, component, part: tuple[int, int], nearest: int | None = None) -> DataFrame:
    """Pairs of sets that share a hot key, aren't joined yet and may link. Each key's sets are dealt to blocks, and blocks meet in pairs."""
    rows = component(hot, "key").select("token", "key", "n", "root")
    open_ = rows.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("token")
    size = sizes.join(open_, "token").select("token", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks"))
    few = hot.groupBy("key").agg(F.slice(F.array_sort(F.collect_set("token")), 1, LEAST).alias("few"))  # a set's own keys
    dealt = rows.join(size, "token").join(bits, "key").join(few, "key").withColumn("block", F.pmod(F.hash("key"), "blocks"))
    first = dealt.withColumn("side", F.lit(0)).withColumn("other", F.explode(F.sequence(F.col("block"), F.col("blocks") - 1)))
    second = dealt.withColumn("side", F.lit(1)).withColumn("other", F.col("block")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("other"))))
    every = first.unionByName(second).select("token", "block", "other", "side", "key", "n", "root", "bits", "few")
    met = every.repartition("token", "block", "other").sortWithinPartitions("token", "block", "other", "side")
    return met.mapInArrow(lambda b: _pairs_of_blocks(b, part, nearest), PAIR).distinct()


def similar_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, part: tuple[int, int] = PART, rare: int = RARE, most: int = FREQUENT, long_list: int = LIST
) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document: sets of ``width``-word shingles link by Jaccard similarity.

    component_id is the smallest id that a document reaches over links, itself included. Documents with one set are one
    node. Candidates share a key of their signatures (see ``signature``): lists of a key give all pairs that sizes
    allow if they are short; those of a hot key are first joined as stars with its smallest set, and only pairs that
    are in different components then are compared, in blocks, the most alike first. Bitmaps rule out most pairs, and the rest are decided by
    their exact intersections, at first for each set's smallest partner, then for what isn't joined yet.

    Null and empty texts and texts without words have no shingles and link with nothing, fewer words than ``width`` are
    one shingle. Rows with a null id get the component of the documents they link with (null without any); rows that
    repeat an id are documents of their own. Other columns are ignored, whatever their names; an empty table gives an
    empty result. Tokens and sets are told apart by 64 bits.
    """
    found = materialise(sets(docs, id_col, text_col, width, part))
    frequent = frequent_tokens(docs, found, text_col, width, part, rare, most, rounds=2)
    every = materialise(entries(docs, text_col, width, part, frequent))
    heavy = heavy_tokens(every)
    lists = every.join(heavy, "token", "left_anti").repartition("token").sortWithinPartitions("token", "key")
    near = lists.select("token", "key", "n").mapInArrow(lambda b: _pairs_of_lists(b, part, long_list), PAIR)
    members = every.join(heavy, "token").select("token", "key", "n")
    hubs = members.groupBy("token").agg(F.min(F.struct("key", "n")).alias("hub"))
    fits = part[1] * F.least("n", F.col("hub.n")) >= part[0] * F.greatest("n", F.col("hub.n"))
    stars = members.join(hubs, "token").where(fits & (F.col("key") > F.col("hub.key"))).select(F.col("hub.key").alias("a"), F.col("key").alias("b"), F.col("hub.n").alias("na"), F.col("n").alias("nb"))
    near = materialise(near.unionByName(stars).distinct())
    hot_tokens = materialise(near.where("b is null").select(F.col("a").alias("token")).union(heavy).distinct())
    hot = materialise(every.join(hot_tokens, "token").select("token", "key", "n").distinct())
    sizes = hot.groupBy("token").count()
    bits = found.where("bits is not null").select("key", "bits").dropDuplicates(["key"])
    pairs = materialise(_may_link(near.where("b is not null"), bits, part))

    ends = lambda p: p.select(F.explode(F.array("a", "b")).alias("key"))
    tokens = _tokens_of(docs, text_col, width, materialise(ends(pairs).union(hot.select("key")).distinct()))
    lowest = Window.partitionBy("b").orderBy("a")
    links = materialise(_linked(pairs.withColumn("_n", F.row_number().over(lowest)).where("_n = 1").drop("_n"), tokens, part))
    joined = materialise(connected_components(links))

    def component(rows: DataFrame, key: str, parts: DataFrame) -> DataFrame:
        return rows.join(parts, F.col(key) == F.col("node"), "left").withColumn("root", F.coalesce("component", key)).drop("node", "component")

    if not hot.isEmpty():  # what is most alike first: few pairs join most of a large group
        alike = _across(hot, sizes, bits, lambda rows, key: component(rows, key, joined), part, NEAREST)
        links = materialise(links.union(_linked(alike, tokens, part)))
        joined = materialise(connected_components(links))
    rest = component(component(pairs, "a", joined).withColumnRenamed("root", "_root"), "b", joined).where("root <> _root").drop("root", "_root")
    rest = rest.unionByName(_across(hot, sizes, bits, lambda rows, key: component(rows, key, joined), part)).distinct()
    links = links.union(_linked(rest, tokens, part))
    parts = connected_components(links)
    classes = found.where("n > 0").groupBy("key").agg(F.min("doc_id").alias("low"))
    rooted = materialise(component(classes, "key", parts))
    least = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    named = rooted.join(least, "root").select(F.col("key").alias("_key"), "component_id")
    some = found.where("n > 0").join(named, F.col("key") == F.col("_key"))
    none = found.where("n = 0").withColumn("component_id", F.col("doc_id"))
    columns = ["doc_id", F.col("n").alias("n_shingles"), "component_id"]
    return some.select(*columns).union(none.select(*columns))
