"""Passages around names and the roster's folds on small rows."""

import pytest
from pyspark.sql import functions as F

from marginalia.functions import texts
from marginalia.operators import roster


@pytest.mark.parametrize(
    ("name", "text", "want"),
    [
        ("Open Models", "we like open   model\nwork", "we like open model work"), ("open models", "reopen models", None), ("a b", "", None), ("", "x", None), ("x", None, None),
        ("red fox", "w" * 30 + " one two red foxes ran off " + "z" * 30, None), ("red fox", "aaa bbb ccc ddd red fox eee fff ggg hhh", "…ccc ddd red fox eee fff…"),
        ("red fox", "abcdefghijklm red fox nopqrstuvwxyz", "…red fox…"),
    ],
)
def test_passages(spark, name, text, want):
    got = spark.createDataFrame([(text,)], "t string").select(texts.passage(name, F.col("t"), 10).alias("p")).first().p
    assert got == want


def test_roster_and_active(spark):
    heads = spark.createDataFrame([("a", "a"), ("b", "a")], "entity string, head string")
    subs = spark.createDataFrame([("b", 2, "B"), ("a", 1, None), ("gone", 5, "G"), ("a", None, "no")], "id string, at int, name string")
    assert sorted(map(tuple, roster.roster(subs, heads, "id", "at", "name").collect())) == [("a", "a", None, 1, 2), ("gone", "gone", "G", 5, 1)]
    q, w = spark.createDataFrame([(1,), (2,), (3,)], "q int"), spark.createDataFrame([(1, 7), (1, 8), (2, 9), (3, 7)], "q int, t int")
    t, c = spark.createDataFrame([(7, True), (8, True), (9, None)], "t int, active boolean"), spark.createDataFrame([(1, "ctx")], "q int, c string")
    assert sorted(map(tuple, roster.active(q, w, t, c, "q", "t").collect())) == [(1, "ctx"), (3, None)]


def test_reasons(spark):
    rows = [(1, "like", "x", 3, None, None), (1, "follow", "x", 1, None, None), (1, "list", "x", 2, None, ["a", "b"]), (1, "save", "x", 12, None, None), (2, "subscribe", "substack", 1, None, None), (2, "save", "openalex", 1, None, None), (3, "subscribe", "substack", 1, True, None), (3, "recommended", "substack", 1, None, None), (3, "coauthor", "openalex", 2, None, None), (4, "list", "x", 3, None, []), (5, "odd", "x", 1, None, None)]
    got = roster.reasons(spark.createDataFrame(rows, "who int, signal string, platform string, n long, paid boolean, lists array<string>"), "who")
    assert {r.who: r.reason for r in got.collect()} == {
        1: "you follow, in your a, b lists, bookmarked 12, liked 3", 2: "you subscribe, saved 1 paper", 3: "paid subscriber, recommended by one of your Oracles, co-wrote 2 papers with one of your Oracles", 4: "in 3 of your lists",
    }


def test_paper_authors_and_collectors(spark):
    papers = spark.createDataFrame([("p1", [("a", None, "o1"), (None, "x", None)]), ("p2", [("a", "Ann", "o2"), ("b", "Bo", None)])], "p string, authors array<struct<id:string,display_name:string,orcid:string>>")
    known, skipped = roster.paper_authors(papers, "p", "authors")
    assert sorted(map(tuple, known.collect())) == [("a", "Ann", "o1", 2), ("b", "Bo", None, 1)] and skipped.first()[0] == 1
    runs = spark.createDataFrame([("x", 1, True), ("x", 3, False), ("y", 2, False), ("z", 4, False), ("z", 5, True)], "n string, at int, ok boolean")
    assert {tuple(r) for r in roster.collectors(["x", "y", "z", "w"], runs, "n", "at", "ok").collect()} == {("x", 2, 1, 3), ("y", 1, None, 2), ("z", 2, 5, None), ("w", 0, None, None)}
