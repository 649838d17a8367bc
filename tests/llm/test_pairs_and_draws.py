"""Joins, negatives and draws against plain re-computations, with bounds so small that every path is taken, and odd rows."""

import hashlib
import math
import random
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from marginalia.llm import hard_negatives, ngram_join, resampling

ODD = [(None, None), (None, "one"), (1, ""), (1, None), (2, " \t\n"), (3, "a b"), (3, "a b"), (4, "A  b"), (5, "x" * 5000), (6, "w " * 30_000)]


def shingles(text, width=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {" ".join(words[i : i + width]) for i in range(len(words) - width + 1)} if len(words) >= width else {" ".join(words)} if words else set()


def groups(rows, part=(80, 100)):
    """(id, size, component) of all rows by comparing all pairs."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and part[1] * len(sets[i] & sets[j]) >= part[0] * len(sets[i] | sets[j]):
                root[max(top(i), top(j))] = min(top(i), top(j))
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[top(i)] = min(low.get(top(i), d), d)
    return sorted(((d, len(s), low.get(top(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=str)


def planted(seed):
    """Texts about like each other to many degrees, with passages that many share."""
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(4000)]
    passage = rnd.choices(words, k=30)
    texts = []
    for _ in range(12):
        base = rnd.choices(words, k=rnd.choice((5, 6, 9, 40, 63, 64, 65, 150, 260)))
        for _ in range(rnd.choice((1, 2, 9, 25))):
            copy = list(base)
            for _ in range(rnd.choice((0, 0, 1, 1, 2, 3))):
                at = rnd.randrange(len(copy))
                copy[at : at + rnd.choice((0, 1, 1, 2))] = rnd.choices(words, k=rnd.choice((0, 1, 1, 3)))
            texts.append(" ".join(copy + (passage if rnd.random() < 0.3 else [])))
    return list(enumerate(texts, 10))


@pytest.mark.parametrize("rare, long_list", [(32, 64), (1, 64), (1, 2), (4, 3), (0, 1)])
def test_similar_groups(spark, monkeypatch, rare, long_list):
    monkeypatch.setattr(ngram_join, "BLOCK", 4)
    rows = planted(rare + long_list) + ODD
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"n": F.lit(1), "key": F.lit("x"), "component": F.lit(None)})
    got = ngram_join.similar_groups(docs.repartition(5), rare=rare, long_list=long_list)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == groups(rows)


def test_similar_groups_of_nothing(spark):
    assert ngram_join.similar_groups(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_hashes_follow_shingles():
    texts = ["a  b\tc d e f", "A b c d e F", "a b c d e", "ab cde", "", "ab c de", "é è ê a b c", " lead and trail ", "lead and trail"]
    found = list(ngram_join.shingle_sets([t.encode() for t in texts]))
    assert [len(x) for x in found] == [len(shingles(t)) for t in texts]
    for i, a in enumerate(found):
        for j, b in enumerate(found):
            assert len(np.intersect1d(a, b)) == len(shingles(texts[i]) & shingles(texts[j]))
    many = [" ".join(random.Random(i).choices("abcdefgh", k=300)) for i in range(40)]
    assert [len(x) for x in ngram_join.shingle_sets([t.encode() for t in many])] == [len(shingles(t)) for t in many]


def test_signatures_of_linked_sets_meet():
    """Whatever is frequent, two sets at the threshold share a token or a pair."""
    rnd = np.random.Generator(np.random.PCG64(3))
    for _ in range(3000):
        n = int(rnd.integers(4, 400))
        both = int(rnd.integers(-(-4 * n // 5), n + 1))
        base = rnd.integers(0, 2**64, n + n // 4 + 1, dtype=np.uint64)
        extra = int(rnd.integers(0, max(1, min(n // 4 + 1, both * 10 // 8 - n + 1))))
        x, y = np.unique(base[:n]), np.unique(np.r_[base[:both], base[n : n + extra]])
        if 100 * len(np.intersect1d(x, y)) < 80 * len(np.union1d(x, y)):
            continue
        frequent = np.sort(rnd.permutation(base)[: int(len(base) * rnd.random() * 1.01)])
        a, b = (ngram_join.signature(s, frequent, (80, 100)) for s in (x, y))
        assert np.intersect1d(a[0], b[0]).size or np.intersect1d(a[1], b[1]).size
        assert len(a[1]) <= 3 * n + 8


def negatives(rows):
    """The contract, row by row."""
    good = []
    for i, (vec, v, label) in enumerate(rows):
        if vec is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        good.append((i, vec, label, [math.floor(256 * float(np.float32(x))) for x in v]))
    out = []
    for i, a, la, va in good:
        if a % 50:
            continue
        scored = sorted((-sum(x * y for x, y in zip(va, v)), vec, label, j) for j, vec, label, v in good if j != i and len(v) == len(va))
        for s, p, _, _ in [x for x in scored if x[2] == la][:5]:
            ok = [x for x in scored if x[2] != la and 50 * -s <= 100 * -x[0] <= 95 * -s][:3]
            out += [(a, p, k, n, -s, -t) for k, (t, n, _, _) in enumerate(ok, 1)]
    return sorted(out)


@pytest.mark.parametrize("block", [4096, 7])
def test_hard_negatives(spark, monkeypatch, block):
    monkeypatch.setattr(hard_negatives, "BLOCK", block)
    rnd = random.Random(block)
    unit = lambda: [rnd.gauss(0, 0.4) for _ in range(6)]
    rows = [(i, unit(), rnd.choice((0, 0, 0, 1, 2))) for i in range(300)]
    rows += [(i, rows[3][1], i % 3) for i in range(300, 360)]  # one common vector: ties
    rows += [(400, [0.0] * 6, 0), (401, [0.0] * 6, 1), (402, [0.0] * 6, 0), (450, [], 5), (451, [], 5), (452, [], 6), (500, [0.5, 0.5], 0), (501, [0.5, 0.4], 0), (502, [0.4, 0.3], 1)]
    rows += [(50, unit(), 1), (50, rows[50][1], rows[50][2]), (None, unit(), 1), (550, None, 1), (600, unit(), None), (650, [None] * 6, 1), (700, [float("nan")] * 6, 1), (750, [float("inf")] * 6, 1)]
    rows += [(800, [3e6, -2e6, 1.0, 0.0, 0.0, 1e6], 0), (801, [2e6, -2e6, 1.0, 0.0, 0.0, 1e6], 0), (802, [1.4e6, -1.9e6, 1.0, 0.0, 0.0, 1e6], 1)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({"row": F.lit("x"), "size": F.lit(1), "block": F.lit(None)})
    got = hard_negatives.mine(frame.repartition(3), F.col("vec_id") % 50 == 0)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(tuple(r) for r in got.collect()) == negatives(rows)
    assert hard_negatives.mine(frame.limit(0), F.col("vec_id") % 50 == 0).collect() == []


def test_lists_are_read_no_further_than_needed():
    """Along one dimension the threshold ends the search early; rows that lists haven't shown aren't scored."""
    v = np.c_[np.arange(10_000)[::-1], np.zeros(10_000, np.int64)]
    block = hard_negatives.SortedLists(v, np.arange(10_000), np.arange(10_000), np.zeros(10_000, np.int64))
    scored, plain = [], block.scores
    block.scores = lambda at, anchor: (scored.append(len(at)), plain(at, anchor))[1]
    (at, of), = hard_negatives.best_in_windows(block, np.array([2, 0]), np.ones(10_000, bool), [(0, 10**9)], 3)
    assert at.tolist() == [0, 1, 2] and of.tolist() == [19998, 19996, 19994]
    assert sum(scored) < 200


def drawn(rows, target, n=1, buckets=50, least=3, percent=30):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    runs = lambda t: [" ".join(w[i : i + k]) for w in [words(t)] for k in range(1, n + 1) for i in range(len(w) - k + 1)]
    bucket = lambda f: crc32(f.encode()) % buckets
    s, t = Counter(bucket(f) for _, x in rows for f in runs(x)), Counter(bucket(f) for x in target for f in runs(x))
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets)))) for b in range(buckets)]
    out = []
    for d, x in rows:
        h = int(hashlib.sha256(f"2024:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[bucket(f)] for f in runs(x))
        out.append([d, len(runs(x)), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, len(words(x))])
    able = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0]))
    for rank, r in enumerate(able[: len(able) * percent // 100], 1):
        r[4] = rank
    return sorted((tuple(r[:5]) for r in out), key=str)


@pytest.mark.parametrize("n", [1, 2, 4])
def test_resampling(spark, monkeypatch, n):
    monkeypatch.setattr(resampling, "HEAD", 8)  # most words and pairs are of the tail
    rnd = random.Random(n)
    words = ["Ärger", "the", "THE", "x1", "don't", "naïve", "日本", *"abcdefghij"]
    rows = [(i, rnd.choice((" ", "\n", "-", " \x00")).join(rnd.choices(words, k=rnd.randrange(30)))) for i in range(80)] + ODD
    target = [" ".join(rnd.choices(words[:6], k=20)) for _ in range(5)] + [None, ""]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"score": F.lit("x"), "bucket": F.lit(1), "rank": F.lit(None)})
    got = resampling.resample(docs.repartition(4), spark.createDataFrame([(t,) for t in target], "text string"), n=n, buckets=50, least_words=3, percent=30)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == drawn(rows, target, n)
    assert resampling.resample(docs.limit(0), docs).collect() == []
    assert resampling.resample(docs, docs.limit(0)).count() == len(rows)
