"""The stored index against scans of the texts, over generations, and what its plans read."""

import random
import uuid

import pytest
from pyspark.sql import functions as F

from marginalia.functions.stemming import folded_words, stem, stems
from marginalia.operators import postings, search
from marginalia.storage import shared_folder

WORDS = "the of thing things Accountable accountability café cafe rollup ledger a b c d e f".split()


def texts(n, seed):
    rnd = random.Random(seed)
    return [(i, " ".join(rnd.choices(WORDS, k=rnd.randrange(60)))) for i in range(n)]


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture
def folder(spark):
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.mark.parametrize("stemmed", [False, True])
def test_generations_equal_scans(spark, folder, stemmed):
    words = stems("text") if stemmed else search.tokens(F.col("text"))
    now = dict(texts(80, 1)) | {80: None, 81: ""}
    index = postings.Index(spark, folder, buckets=5).write(frame(spark, list(now.items())), "doc_id", words)
    changed = dict([(i + 40, t) for i, t in texts(60, 2)])
    index.upsert(frame(spark, list(changed.items())), "doc_id", words, gone=frame(spark, [(3, None), (77, None)]).where("doc_id = 3 or doc_id = 200"))
    now = {k: v for k, v in (now | changed).items() if k != 3}
    index.upsert(frame(spark, [(3, "the thing is back")]), "doc_id", words)
    now[3] = "the thing is back"
    docs = frame(spark, list(now.items()))
    assert rows_of(index.documents()) == sorted((k, len((v or "").split())) for k, v in now.items())
    for query in ("accountable things", "the of", "rollup", "nowhere", ""):
        tokens = search.query_words(query)
        want = rows_of(search.bm25(docs, query, 30, stemmed=stemmed))
        assert rows_of(index.bm25([stem(t) for t in tokens] if stemmed else tokens, 30)) == want
    plain = search.bm25(docs.where("doc_id % 3 = 0"), "rollup", 30, stemmed=stemmed)
    assert {r.doc_id for r in plain.collect()} == {r.id for r in index.bm25(["rollup"], 30, docs.where("doc_id % 3 = 0")).collect()}
    dense = index.compacted(f"{folder}-dense")
    assert dense._generations() == [0] and rows_of(dense.documents()) == rows_of(index.documents())
    assert rows_of(dense.lists(["thing", "the"])) == rows_of(index.lists(["thing", "the"]))


def test_phrases_by_positions(spark, folder):
    docs = frame(spark, texts(60, 4) + [(90, "the the the thing"), (91, "thing the"), (92, None)])
    index = postings.Index(spark, folder, buckets=3).write(docs, "doc_id", search.tokens(F.col("text")))
    for phrase in (["the", "thing"], ["the", "the"], ["a", "b", "a"], ["thing"], ["none", "the"]):
        want = {}
        for d, t in docs.collect():
            words = (t or "").lower().split()
            times = sum(words[i : i + len(phrase)] == phrase for i in range(len(words)))
            if times:
                want[d] = times
        assert dict(rows_of(index.phrase(phrase))) == want
        assert {r.doc_id for r in search.phrase_matches(docs, " ".join(phrase)).collect()} == set(want)
    assert index.phrase([]).count() == 0


def test_a_generation_without_its_list_counts_for_nothing(spark, folder):
    words = search.tokens(F.col("text"))
    index = postings.Index(spark, folder, buckets=3).write(frame(spark, [(1, "the thing")]), "doc_id", words)
    torn = frame(spark, [(1, "another"), (2, "thing thing")]).select(F.col("doc_id").alias("id"), words.alias("words")).mapInArrow(postings._postings, "token string, id long, dl int, tf int, positions array<int>")
    torn.withColumns({"gen": F.lit(1), "bucket": F.pmod(F.xxhash64("token"), F.lit(3)).cast("int")}).write.mode("append").partitionBy("gen", "bucket").parquet(f"{folder}/postings")
    assert [r.id for r in index.bm25(["thing"], 5).collect()] == [1]


def test_plans_read_folders_of_tokens_and_no_text(spark, folder):
    docs = frame(spark, texts(50, 5))
    index = postings.Index(spark, folder).write(docs, "doc_id", search.tokens(F.col("text")))
    plan = index.bm25(["thing", "of"], 5)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "bucket" in plan and "token" in plan.split("PushedFilters")[1] and "positions" not in plan and "text" not in plan
    read = index.lists(["thing"]).inputFiles()
    assert read and index.lists(["thing"]).select(F.input_file_name().alias("f")).distinct().count() < len(read)


def test_hits_as_shown(spark, folder):
    long = "x " * 1500 + "thing and thing " + "y " * 2000 + "thing"
    docs = frame(spark, [(i, f"thing number {i}") for i in range(60)] + [(100, long)]).withColumn("who_id", F.col("doc_id") % 7)
    people = spark.createDataFrame([(i, f"P{i}") for i in range(5)], "who_id long, name string")
    index = postings.Index(spark, folder).write(docs, "doc_id", search.tokens(F.col("text")))
    page = {r.doc_id: r for r in postings.hits(index, docs, "the thing", 8, people=people).collect()}
    assert sorted(page) == list(range(8)) and page[1].who_name == "P1" and page[5].who_name is None
    assert all((r.last_returned, r.next_best, r.saturated) == (0.125, 0.1111, True) for r in page.values()) and page[0].score == 1.0
    own = postings.hits(index, docs, "thing", 8, candidates=docs.where("doc_id = 100").select("doc_id")).first()
    assert (own.start, own.matches, own.last_returned, own.saturated) == (2900, 2, None, False) and own.excerpt.count("thing") == 2 and len(own.excerpt) == 1600
    both = postings.sections(index, docs, "thing", 3, F.col("doc_id") < 2, people=people).collect()
    assert sorted((r.section, r.doc_id) for r in both) == [*(("frontier", i) for i in range(2, 10)), ("trusted", 0), ("trusted", 1)]
    assert postings.hits(index, docs, "nowhere", 3).count() == 0


def test_links(spark):
    rows = [("a [b]", "https://x/y"), ("", "https://x/a b"), (None, " https://x/(1)> "), ("n", ""), ("n", None)]
    got = [r.l for r in spark.createDataFrame(rows, "t string, u string").select(postings.link(F.col("t"), F.col("u")).alias("l")).collect()]
    assert got == ["[a b](https://x/y)", "[source](<https://x/a b>)", "[source](<https://x/(1)>)", None, None]


def shuffled(spark):
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(jvm.java.util.ArrayList(), False, False, gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return {(s.stageId(), s.attemptId()): s.shuffleWriteBytes() for s in (stages.apply(i) for i in range(stages.size()))}


def test_an_index_is_written_without_a_shuffle_or_a_sort(spark, folder):
    before, docs = shuffled(spark), frame(spark, texts(3000, 6))
    index = postings.Index(spark, folder, buckets=5).write(docs, "doc_id", search.tokens(F.col("text")))
    assert not sum(v for k, v in shuffled(spark).items() if k not in before)
    assert index.documents().count() == 3000 and index.lists(["thing"]).count() == docs.where("text rlike '\\\\bthing\\\\b'").count()
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == "0"


def test_words_found_in_the_task_are_those_of_stems(spark, folder):
    docs = frame(spark, texts(40, 7) + [(90, None), (91, ""), (92, "Été CAFÉ accountable_x things")])
    one = postings.Index(spark, folder, buckets=3).write(docs, "doc_id", stems("text"))
    two = postings.Index(spark, f"{folder}-b", buckets=3).write(docs, "doc_id", F.col("text"), find=folded_words, each=stem)
    every = [stem(w.lower()) for w in WORDS] + [stem("ete"), stem("cafe"), "accountable_x"]
    assert rows_of(one.lists(every)) == rows_of(two.lists(every)) and one.lists([stem("ete")]).count() == 1
    assert rows_of(one.documents()) == rows_of(two.documents()) and two.documents().count() == 43
