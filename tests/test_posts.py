"""Links and people of posts, shapes, allowances, screens and forgetting on small rows."""

import datetime as dt

from pyspark.sql import functions as F

from marginalia.operators import forgetting, posts
from marginalia.operators.forgetting import Reference


def test_own_links(spark):
    texts = [
        "plain https://a.org/1, https://a.org/1 [x](https://b.org/2).",
        "---\nauthor: @Me\nurl: https://no.org\n---\n**Quoting** [@You](https://x.com/You)\n> https://q.org\n\n- [c](https://c.org)\nown https://d.org\n**Quoting** [@me](https://x.com/me)\n> https://mine.org",
        "![i](https://i.org/1.png)\n[Video](https://v.org)\ntext", "", None,
    ]
    got = [r.l for r in spark.createDataFrame([(t,) for t in texts], "t string").select(posts.own_links(F.col("t")).alias("l")).collect()]
    assert got == [["https://a.org/1", "https://b.org/2"], ["https://d.org", "https://mine.org"], [], [], []]


def test_paper_links(spark):
    text = "see [a](https://arxiv.org/abs/2301.00001), ![no](https://arxiv.org/abs/2301.00002) and https://doi.org/10.1/x. (https://arxiv.org/abs/2301.00009) https://blog.org/p [b](https://arxiv.org/abs/2301.00003)"
    row = spark.createDataFrame([(text, "https://arxiv.org/abs/2301.00003"), (None, None)], "t string, own string").select(posts.paper_links(F.col("t"), F.col("own")).alias("l")).collect()
    assert [r.l for r in row] == [["https://arxiv.org/abs/2301.00001", "https://doi.org/10.1/x"], []] or row[0].l[0] == "https://arxiv.org/abs/2301.00001"


def test_candidate_keys(spark):
    want = {
        "https://open.substack.com/pub/Al-x/p/y": "al-x.substack.com", "https://open.substack.com/other": None, "https://x.com/me": None, "https://github.com/Rhys/repo": "github.com/rhys", "https://github.com/pricing": None,
        "https://substack.com/": None, "https://arxiv.org/abs/2301.00001": None, "https://rhys.dev/a?b": "rhys.dev", "http://localhost:3000/": None, "http://127.0.0.1/x": None, "https://sub.example.com/": None, "https://youtu.be/x": None,
        "https://medium.com/@X/p": "medium.com/@x", "": None,
    }
    rows = spark.createDataFrame([(u,) for u in want], "u string").select("u", posts.candidate_key(F.col("u")).alias("k")).collect()
    assert {r.u: r.k for r in rows} == want


def test_shapes_need_two_posts_of_the_own_host(spark):
    feed = [("https://a.org/", f"https://a.org/posts/{w}") for w in ("one", "two", "2050")] + [("https://b.org/", "https://b.org/x"), ("https://b.org/", "https://else.org/y"), ("https://c.org/", "https://c.org/2007/apr/3/n"), ("https://c.org/", "https://c.org/2008/may/4/m")]
    shapes = posts.learned(spark.createDataFrame(feed, "site string, url string"), "site", "url")
    tried = [("https://a.org/", u) for u in ("https://a.org/posts/new", "https://a.org/tags/new", "https://a.org/posts/new/3", "https://a.org/posts/new/part", "https://a.org/posts/3", "https://a.org")]
    tried += [("https://b.org/", "https://b.org/z"), ("https://c.org/", "https://c.org/1999/december/31/end"), ("https://c.org/", "https://c.org/1999/x/31/end")]
    got = posts.fitting(spark.createDataFrame(tried, "site string, url string"), shapes, "site", "url")
    assert {r.url: r.fits for r in got.collect()} == dict(zip([u for _, u in tried], [True, False, True, False, False, False, None, True, False]))


def test_people_named(spark):
    rows = [(1, "me", "Me", k, w, h, n) for n, (k, w, h) in enumerate([("mention", "x:1", "Ann"), ("link", None, "ann"), ("quote", "x:me", "Other"), ("mention", "x:2", "bob"), ("mention", None, "ME"), ("shout", "x:3", "cy"), ("quote", "x:2", "Bob"), ("link", None, None)])]
    got = posts.people_named(spark.createDataFrame(rows, "g int, author string, own string, kind string, who string, handle string, n int").withColumn("author", F.lit("x:me")), "g", "author", "own", "kind", "who", "handle", ["n"])
    assert {(r.handle, r.kind, r.who, r["first"]) for r in got.collect()} == {("ann", "link", "x:1", 1), ("bob", "quote", "x:2", 6)}


def test_allowance(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = [("a", t0 + dt.timedelta(minutes=m)) for m in (0, 10, 50, 60, 61, 200)]
    got = posts.allowance(spark.createDataFrame(rows, "who string, at timestamp"), "who", "at", 3).orderBy("at").collect()
    assert [r["held"] for r in got] == [1, 2, 3, 3, 4, 1] or [r["held"] for r in got] == [1, 2, 3, 3, 3, 1]
    free = [r.frees_at and (r.frees_at - t0).total_seconds() / 60 for r in got]
    assert free == [None, None, 60, 70, 110, None]


def test_screens_share_the_room(spark):
    rows = spark.createDataFrame([(g, i) for g in range(4) for i in range(5 - g)], "g int, i int")
    got = posts.screens(rows, "g", [F.col("i")], 10, 11).collect()
    assert sorted((r.g, r.i, r.place, r.more) for r in got) == [(g, i, i + 1, 5 - g - 2) for g in range(4) for i in range(2)]
    assert posts.screens(rows, "g", [F.col("i")], 10, 3).count() == 0


def test_preview_is_effect_and_again_is_nothing(spark):
    make = lambda rows, s: spark.createDataFrame(rows, s)
    tables = {"items": make([(1, 7, False), (2, 8, True), (3, 8, False), (4, 9, None)], "id long, who long, saved boolean"), "bodies": make([(1, 1), (2, 3), (3, 3), (4, None)], "b long, item long"), "found": make([(1, 3), (2, 4)], "f long, item long"), "other": make([(1,)], "x long")}
    heads = make([(7, 7), (8, 7), (9, 9)], "entity long, head long")
    rules = [Reference("items", "id"), Reference("bodies", "item"), Reference("found", "item", keep=True)]
    people = forgetting.cluster(heads, make([(8,)], "id long"))
    assert sorted(r.id for r in people.collect()) == [7, 8]
    assert [r.id for r in forgetting.cluster(heads, make([(77,)], "id long")).collect()] == [77]
    gone = forgetting.footprint(tables["items"], people, "who", "id", "saved")
    counts = {r.table: r["rows"] for r in forgetting.preview(tables, gone, rules).collect()}
    after = forgetting.forgotten(tables, gone, rules)
    assert counts == {"items": 2, "bodies": 3, "found": 1}
    assert {n: tables[n].count() - after[n].count() for n in tables} == {"items": 2, "bodies": 3, "found": 0, "other": 0}
    assert sorted(map(tuple, after["found"].collect())) == [(1, None), (2, 4)] and [tuple(r) for r in after["bodies"].collect()] == [(4, None)]
    again = {r.table: r["rows"] for r in forgetting.preview(after, gone, rules).collect()}
    assert set(again.values()) == {0} and all(sorted(map(str, forgetting.forgotten(after, gone, rules)[n].collect())) == sorted(map(str, after[n].collect())) for n in after)
    assert [r.id for r in forgetting.unknown(tables["items"], "id", make([(1,), (99,)], "id long")).collect()] == [99]
