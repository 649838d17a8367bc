"""The map of people: planted subjects, the same map again, newcomers, odd texts."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from marginalia.operators import people

TOPICS = {
    "money": "ledger wallet token bridge staking custody rollup validator onchain stablecoin",
    "life": "protein enzyme genome cell assay antibody tissue receptor mutation clinical",
    "law": "senate statute treasury tariff agency subsidy export federal regulation lawmakers",
    "machines": "gripper lidar servo torque drone actuator locomotion odometry humanoid manipulator",
    "trade": "equity bond yield futures hedge dividend earnings liquidity volatility arbitrage",
}


def written(per=25, seed=1):
    rnd = random.Random(seed)
    return [(f"{t}{i}", " ".join(rnd.sample(w.split(), 4))) for t, w in TOPICS.items() for i in range(per) for _ in range(3)]


def test_planted_subjects_and_newcomers(spark):
    rows = [*written(), ("quiet", None), ("quiet", ""), (None, "ledger wallet")]
    texts = spark.createDataFrame(rows, "who string, said string").repartition(4)
    new = spark.createDataFrame([("a", "new " + TOPICS["life"]), ("b", "the " + TOPICS["trade"]), ("c", "nothing shared"), ("d", None)], "who string, said string")
    got, placed = people.people_map(texts, "who", "said", new, starts=4)
    found = {r.person: (r.group, r.place) for r in got.collect()}
    by = {}
    for p, (g, _) in found.items():
        by.setdefault(g, set()).add(p.rstrip("0123456789"))
    assert sorted(by) == [0, 1, 2, 3, 4] and all(len(x) == 1 for x in by.values()) and len(found) == 125
    assert all({place for p, (g, place) in found.items() if g == h} == set(range(1, 26)) for h in by)
    homes = {r.person: r.group for r in placed.collect()}
    assert homes["c"] is None and homes["d"] is None and by[homes["a"]] == {"life"} and by[homes["b"]] == {"trade"}
    again, _ = people.people_map(texts.repartition(3, "said"), "who", "said", starts=4)
    assert {r.person: (r.group, r.place) for r in again.collect()} == found
    words = people.group_words(texts, "who", "said", got)
    shown = {}
    for r in words.collect():
        shown.setdefault(r.group, set()).add(r.word)
    assert all(w <= set(TOPICS[next(iter(by[g]))].split()) and len(w) == 8 for g, w in shown.items())


def test_leading_vectors_are_those_of_the_whole_matrix(spark):
    x = np.random.Generator(np.random.PCG64(5)).random((40, 12)) * (np.arange(12) + 1)
    rows = spark.createDataFrame([(i, list(range(12)), [float(v) for v in r]) for i, r in enumerate(x)], "person long, at array<int>, x array<double>").repartition(3)
    v = people.leading(rows, 12, 3)
    want = np.linalg.svd(x)[2][:3].T
    assert np.allclose(np.abs((v * want).sum(0)), 1, atol=1e-4)


@pytest.mark.parametrize("text, want", [("The rollup at https://x.com/a/1 by @vital is [here](https://b)", ["rollup"]), ("Don't re-stake", ["don", "re-stake"]), ("", []), (None, [])])
def test_words(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(people.tokens(F.col("t")).alias("w")).first().w == want


def test_no_one_to_map(spark):
    empty = spark.createDataFrame([], "who string, said string")
    assert people.people_map(empty, "who", "said")[0].count() == 0
