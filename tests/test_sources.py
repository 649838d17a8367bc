"""Records and exports on small inputs."""

import json

from marginalia.operators import snapshots
from marginalia.sources import exports, records


def raw(spark, *values, column="json"):
    return spark.createDataFrame([(v,) for v in values], f"{column} string")


def test_posts_and_accounts(spark):
    who = {"rest_id": "7", "legacy": {"name": "A", "screen_name": "a", "description": "b", "followers_count": 3}}
    post = {"rest_id": "1", "core": {"user_results": {"result": who}}, "legacy": {"full_text": "hi", "created_at": "Wed Oct 10 20:19:24 +0000 2018", "favorite_count": 2}}
    got = records.posts(raw(spark, json.dumps(post), "broken", None)).collect()
    assert [(r.id, r.author, r.handle, r.conversation, str(r["at"]), r.text, r.likes) for r in got] == [("1", "7", "a", "1", "2018-10-10 20:19:24", "hi", 2)]
    assert [tuple(r) for r in records.accounts(raw(spark, json.dumps(who), "{}")).collect()] == [("7", "a", "A", "b", 3)]


def test_works(spark):
    work = {"id": "W1", "doi": "https://doi.org/10.1/AB", "title": "t", "publication_year": 2020, "abstract_inverted_index": {"b": [1], "a": [0, 2]}, "authorships": [{"author": {"id": "A1", "display_name": "n"}}]}
    found = records.works(raw(spark, json.dumps(work), "[]", "no"))
    r = found.collect()
    assert [(x.id, x.doi, x.abstract, x.authors[0].id) for x in r] == [("W1", "10.1/ab", "a b a", "A1")] and records.year_counts(found).first()["n"] == 1


def test_feeds_and_site_maps(spark):
    feed = "<rss><item><link>u</link><pubDate>Wed, 02 Oct 2024 13:00:00 GMT</pubDate></item><item><link> v </link></item><item></item></rss>"
    assert {(r.link, str(r["at"])) for r in records.feed_dates(raw(spark, feed, None, column="xml")).collect()} == {("u", "2024-10-02 13:00:00"), ("v", "None")}
    pages = "<urlset><url><loc> https://a/?x=1&amp;y=2 </loc><lastmod>2024-01-02</lastmod></url><url><loc>https://b</loc></url></urlset>"
    assert [tuple(r) for r in records.site_map(raw(spark, pages, column="xml")).collect()] == [("https://a/?x=1&y=2", "2024-01-02", False), ("https://b", None, False)]


def test_delta_makes_the_new_snapshot(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id long, v string")
    new = spark.createDataFrame([(1, "a"), (2, "c"), (4, "d")], "id long, v string")
    change = exports.delta(old, new, "id")
    assert {(r.id, r.change) for r in change.collect()} == {(2, "write"), (4, "write"), (3, "delete")}
    assert sorted(map(tuple, exports.patched(old, change, "id").collect())) == [(1, "a"), (2, "c"), (4, "d")]
    assert sorted(exports.patched(old, exports.delta(old, old, "id"), "id").collect()) == sorted(old.collect())
    made = tuple(snapshots.digest(new, ["id", "v"]).first())
    assert exports.verified(exports.patched(old, change, "id"), ["id", "v"], made) and not exports.verified(old, ["id", "v"], made)


def test_export_keeps_only_allowed_keys(spark):
    rows = spark.createDataFrame([(1, '{"a":"1","b":"2"}', "secret"), (2, None, "s"), (3, "bad", "s")], "id long, p string, hidden string")
    assert [tuple(r) for r in exports.export(rows, ["id"], {"p": ["a"]}).orderBy("id").collect()] == [(1, '{"a":"1"}'), (2, None), (3, "{}")]
    assert [tuple(r) for r in exports.dropped(rows, "p", ["a"]).collect()] == [("b", 1)]
