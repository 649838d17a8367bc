"""The training-data operators against brute force on small data, and on odd rows."""

import collections
import itertools
import re

import numpy as np
import pytest

from marginalia.llm import html_text, kneser_ney, masked_lm, mixing, order_minhash, packing, passages, quality_rules, simhash, toxicity

D = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(1, "a b c d e f g h i j", "x", "en"), (1, "a b c d e f g h i j", "x", "en"), (None, None, None, None), (None, "q w e r t y", None, "fr"), (2, "", "y", None), (3, " z　z " * 300, "y", "en")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")


def test_trie_walk_finds_all_pairs():
    rng = np.random.default_rng(0)
    v = [int(x) for x in rng.integers(0, 2**63, 60)]
    v += [x ^ sum(1 << int(b) for b in rng.choice(63, k, replace=False)) for x in v[:30] for k in (1, 2, 3, 4)]
    v = np.unique(np.array(v, dtype=np.uint64))
    got = {tuple(sorted(p)) for a, b in simhash.walk_pairs(np.zeros(len(v), np.int64), v, 3, 64) for p in zip(a.tolist(), b.tolist())}
    assert got == {(i, j) for i, j in itertools.combinations(range(len(v)), 2) if bin(int(v[i]) ^ int(v[j])).count("1") <= 3}


def test_components_of_fingerprints(spark):
    got = simhash.near_duplicates(spark.read.parquet(f"{D}/documents.parquet")).toPandas()
    prints = {d: int(f, 16) for d, f in zip(got.doc_id, got.fingerprint)}
    root = {d: d for d in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(prints, 2):
        if bin(prints[a] ^ prints[b]).count("1") <= 3:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    assert {d: find(d) for d in prints} == dict(zip(got.doc_id, got.component_id))


def test_quality_counts(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    got = quality_rules.judge(docs).toPandas().set_index("doc_id")
    for doc_id, text in docs.select("doc_id", "text").collect():
        w = WORD.findall(text or "")
        grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        n, cover = collections.Counter(grams), set()
        for i, g in enumerate(grams):
            if n[g] > 1:
                cover.update(range(i, i + 5))
        lines = [x for x in (text or "").split("\n") if WORD.search(x)]
        r = got.loc[doc_id]
        assert (r.n_words, r.word_chars, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(lines) - len(set(lines)), len(cover))


def test_mix_keeps_to_targets(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    got = mixing.mix(docs).join(docs.select("doc_id", "source"), "doc_id").toPandas()
    by = got.groupby("source").agg(taken=("taken", "sum"), target=("target", "first"))
    assert ((by.taken - by.target).abs() <= 0.03 * by.target + 64).all() and (got.taken <= 3 * got["size"]).all()
    assert abs(by.target.sum() - got["size"].sum()) < 1e-3 * got["size"].sum()


def test_packing_places_every_word_once(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    got = packing.pack(docs).toPandas()
    assert got.n_words.sum() == sum(len(WORD.findall(r.text or "")) for r in docs.collect())
    full = got.dropna().sort_values(["bin_id", "bin_offset"])
    for _, b in full.groupby("bin_id"):
        assert list(b.bin_offset)[1:] == list((b.bin_offset + b.n_words))[:-1] and b.n_words.sum() <= b.bin_size.iloc[0]


def test_rare_shingles_lose_no_alike_pair(spark):
    rng = np.random.default_rng(3)
    common = [f"c{i}" for i in range(8)]
    texts = []
    for _ in range(40):  # all share a run of words; groups of three differ in their last word
        own = common + [f"w{x}" for x in rng.integers(0, 500, int(rng.integers(1, 40)))]
        texts += [" ".join([*own, f"new{j}"]) for j in range(3)]
    texts += ["", "a b", "a b c"]
    rows = spark.createDataFrame(list(enumerate(dict.fromkeys(texts))), "hash long, text string")
    met = {}
    for r in passages.by_rare_shingles(rows).collect():
        met.setdefault(r.key, set()).add(r.hash)
    sets = {r.hash: passages.shingles(r.text.split(" ")) for r in rows.collect()}
    alike = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    assert len(alike) > 20 and all(any({a, b} <= g for g in met.values()) for a, b in alike)
    assert max(map(len, met.values())) < len(sets) / 2


def test_shared_passages_are_found(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    seen = collections.defaultdict(set)
    for r in docs.collect():
        w = (r.text or "").split()
        for i in range(len(w) - 50):
            seen[tuple(w[i : i + 51])].add(r.doc_id)
    want = {d for v in seen.values() if len(v) > 1 for d in v}
    assert want <= {r.doc_id for r in passages.repeated_passages(docs).collect()}


def test_shared_passages_are_covered_to_their_ends(spark):
    rng = np.random.default_rng(5)
    new = lambda n: [f"w{x}" for x in rng.integers(0, 10**9, n)]
    texts, planted = [], {}
    for i in range(120):  # passages of 16 to 80 words inside lines of two documents, and paragraphs with one changed word
        shared = new(int(rng.choice([16, 30, 51, 51, 80])))
        other = list(shared)
        edited = i % 2 and len(shared) >= 51
        if edited:
            other[len(other) // 2] = "edited"
        for words in (shared, other):
            before = new(int(rng.integers(20, 60)))
            planted[len(texts)] = range(len(before), len(before) + len(words))
            texts.append(" ".join(before + words + new(int(rng.integers(20, 60)))))
    texts.append("\n".join([" ".join(new(30)), " ".join(line := new(60)), "x y z"]))
    planted[240] = planted[241] = range(30, 90)
    line[40] = "edited"
    texts.append("\n".join([" ".join(new(30)), " ".join(line), "z y x"]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    gone = collections.defaultdict(set)
    kept = collections.defaultdict(set)
    for r in passages.repeated_passages(docs).collect():
        (gone if r.removed else kept)[r.doc_id].update(range(r.start_word, r.start_word + r.n_words))
    assert all(gone[i] == set(planted[i]) for i in range(1, 242, 2))
    assert not any(gone[i] for i in range(0, 242, 2))
    assert all(len(set(planted[i]) - kept[i]) <= 1 and kept[i] <= set(planted[i]) for i in range(0, 242, 2))


def test_every_equal_run_is_found(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    least, seen = passages.LEAST_WORDS, {}
    words = {r.doc_id: (r.text or "").encode().split() for r in docs.collect()}
    for d in sorted(words):
        for i in range(len(words[d]) - least + 1):
            seen.setdefault(tuple(words[d][i : i + least]), []).append((d, i))
    want, goes = collections.defaultdict(set), collections.defaultdict(set)
    for places in seen.values():
        if places[0][0] != places[-1][0]:
            for d, i in places:
                want[d].update(range(i, i + least))
                if d != places[0][0]:
                    goes[d].update(range(i, i + least))
    got, gone = collections.defaultdict(set), collections.defaultdict(set)
    for r in passages.repeated_passages(docs).collect():
        got[r.doc_id].update(range(r.start_word, r.start_word + r.n_words))
        if r.removed:
            gone[r.doc_id].update(range(r.start_word, r.start_word + r.n_words))
    assert want and all(want[d] <= got[d] and goes[d] <= gone[d] for d in want)


def test_main_text(spark):
    pages = spark.read.parquet(f"{D}/pages.parquet")
    got = {r.page_id: r.text for r in html_text.extract(pages, layouts=400).collect()}
    right = 0
    for r in pages.collect():
        article = r.html[r.html.index("<article>") : r.html.index("</article>")]
        right += got[r.page_id] == "\n".join(b.text for b in html_text.blocks(article))
    assert right >= 0.95 * len(got)


def test_masked_lm_scores_whole_texts(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    got = {r.doc_id: r for r in masked_lm.score(docs).collect()}
    assert all(got[r.doc_id].n_tokens == len(WORD.findall(r.text or "")) for r in docs.collect())
    assert all((r.per_token is None) == (r.n_tokens == 0) and r.pseudo_log_likelihood <= 0 for r in got.values())


def test_kneser_ney_counts_as_many_trusted_rows_as_its_bound(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"one two three {i}", "en") for i in range(900)], "doc_id long, text string, lang string")
    seen, plain = [], kneser_ney.model
    monkeypatch.setattr(kneser_ney, "model", lambda trusted: seen.append(trusted.count()) or plain(trusted))
    kneser_ney.classify(docs, docs.selectExpr("doc_id", "1 quality"))
    assert seen == [600]


def test_the_kneser_ney_query_counts_all_trusted_rows(spark, monkeypatch, tmp_path):
    from marginalia.llm import queries

    docs = spark.createDataFrame([(i, f"one two three {i}", "en") for i in range(900)], "doc_id long, text string, lang string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    docs.selectExpr("doc_id", "1 quality").write.parquet(f"{tmp_path}/labels.parquet")
    held = docs.where("pmod(xxhash64(doc_id, 1), 5) = 0").count()
    seen, plain = [], kneser_ney.model
    monkeypatch.setattr(kneser_ney, "model", lambda trusted: seen.append(trusted.count()) or plain(trusted))
    assert queries.op10_kneser_ney(spark, str(tmp_path)).count() == 900
    assert seen == [900 - held] and 900 - held > kneser_ney.ROWS_PER_LANGUAGE


def test_kneser_ney_probabilities_sum_to_one(spark):
    texts = ["a b a c", "a b b c a", "c a b a b"]
    entries, unseen = kneser_ney.model(spark.createDataFrame([("en", t) for t in texts], "lang string, text string"))
    table, unknown = {r.key: r.value for r in entries.collect()}, unseen.first()["unseen"]

    def p(context, word):  # the end mark for None
        u, v, w = (kneser_ney.word_hashes(" ".join([*context, word] if word else context), "en")[-4:-1] if word else kneser_ney.word_hashes(" ".join(context), "en")[-3:])
        with np.errstate(over="ignore"):
            uv, vw = kneser_ney._mix(u, v), kneser_ney._mix(v, w)
            keys = [int(kneser_ney._salted(x, i).view(np.int64)) for i, x in enumerate((kneser_ney._mix(uv, w), uv, vw, v, w))]
        lower = table.get(keys[2], table.get(keys[3], 0.0) + table.get(keys[4], unknown))
        return float(np.exp(table.get(keys[0], table.get(keys[1], 0.0) + lower)))

    for context in (["a", "b"], ["b", "a"], ["c", "a"], ["a", "zzz"]):
        assert abs(sum(p(context, w) for w in ("a", "b", "c", None, "unseen")) - 1) < 1e-6


def test_odd_rows(spark, odd):
    assert mixing.mix(odd).count() == 6 and mixing.mixed_documents(odd).columns == odd.columns
    assert simhash.near_duplicates(odd).count() == 6
    assert quality_rules.judge(odd).count() == 6 and quality_rules.keep_good(odd).columns == odd.columns
    assert order_minhash.edit_sensitivity(odd).count() == 6
    assert packing.pack(odd).where("n_words = 0").count() == 2
    assert passages.repeated_passages(odd).count() == 0
    scored = masked_lm.score(odd)
    assert scored.count() == 6 and scored.where("n_tokens = 0 and per_token is null and pseudo_log_likelihood = 0").count() == 2
    labels = spark.createDataFrame([(1, 1, 0), (None, None, None), (3, 0, 1)], "doc_id long, quality int, toxic int")
    assert toxicity.toxicity(odd, labels).where("score between 0 and 1").count() == 6
    none = odd.limit(0)
    assert mixing.mix(none).count() == simhash.near_duplicates(none).count() == packing.pack(none).count() == order_minhash.edit_sensitivity(none).count() == 0
    assert masked_lm.score(none).count() == kneser_ney.classify(none, labels).count() == 0
    assert kneser_ney.classify(odd, labels).where("kept is not null").count() == 6
