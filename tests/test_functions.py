"""Functions against plain Python on small inputs."""

import re

import pytest
from pyspark.sql import functions as F

from marginalia.functions import dates, maps, texts, urls
from marginalia.operators import search


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


def plain_start(text, word, width, lead):
    starts = [m.start() for m in re.finditer(word, text)]
    best, most = 0, 0
    for s in starts:
        low = max(0, min(len(text), max(0, s - lead) + width) - width)
        n = sum(low <= x < low + width for x in starts)
        if n > most:
            best, most = low, n
    return best


def test_excerpt_start_is_that_of_the_densest_window(spark):
    cases = ["", "none", "the end", "x " * 40 + "the the " + "y " * 30 + "the", "the " + "z " * 60 + "the the the", "the " * 50]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(cases)], "i int, t string")
    got = {r.i: r.start for r in search.densest_windows(rows, r"\bthe\b", 40, 10, "i", "t").collect()}
    assert got == {i: plain_start(t, r"\bthe\b", 40, 10) for i, t in enumerate(cases)}


def test_bounds():
    assert (dates.bound("2024", False), dates.bound("2024", True), dates.bound("2024-02", True), dates.bound(None, True)) == ("2024-01-01", "2024-12-31", "2024-02-29", None)
    for bad in ("5/11/2026", "2026-13", "2026-02-30", "26"):
        with pytest.raises(ValueError):
            dates.bound(bad, True)
    assert dates.within(F.lit("2024"), F.lit("year"), "", None) is None


def test_instants(spark):
    assert str(one(spark, dates.instant(F.col("t")), t="2024-03-04T05:06:07+02:00")) == "2024-03-04 03:06:07"
    assert str(one(spark, dates.instant(F.col("t")), t="2024-03-04 nonsense")) == "2024-03-04 00:00:00"
    assert one(spark, dates.instant(F.col("t")), t="soon") is None and one(spark, dates.instant(F.col("t")), t="") is None
    assert str(one(spark, dates.feed_instant(F.col("t")), t="Wed Oct 10 20:19:24 +0000 2018")) == "2018-10-10 20:19:24"


def test_lists_and_positions(spark):
    say = lambda *x: one(spark, texts.listed(F.array(*map(F.lit, x))))
    assert [say("a"), say("a", "b"), say("a", "b", "c"), say("a", "b", "c", "d"), say(*"abcde")] == ["a", "a and b", "a, b and c", "a, b, c and 1 other", "a, b, c and 2 others"]
    index = F.from_json(F.col("t"), "map<string,array<int>>")
    assert one(spark, texts.from_positions(index), t='{"b": [1, 3], "a": [0], "c": [2]}') == "a b c b"
    assert one(spark, texts.from_positions(index), t=None) == ""


def test_snippets_and_names(spark):
    assert one(spark, texts.snippet(F.col("t"), 10), t=" one  two\nthree four") == "one two…"
    assert one(spark, texts.snippet(F.col("t"), 5), t="unbroken words") == "unbro…"
    assert one(spark, texts.snippet(F.col("t"), 50), t=" a  b ") == "a b"
    assert one(spark, texts.names(F.lit("Boltz-2"), F.col("t")), t="We ran boltz 2 again") and not one(spark, texts.names(F.lit(""), F.col("t")), t="any")
    assert one(spark, texts.names(F.lit("Virtual Cell Challenge"), F.col("t")), t="two virtual cell challenges") and not one(spark, texts.names(F.lit("cell"), F.col("t")), t=None)


def test_maps(spark):
    merged = maps.patched(maps.decoded(F.col("a")), maps.decoded(F.col("b")))
    assert one(spark, merged, a='{"x":"1","y":"2"}', b='{"y":null,"z":"3"}') == {"x": "1", "z": "3"}
    assert one(spark, maps.decoded(F.col("a")), a="no json") == {}
    assert one(spark, maps.allowed(maps.decoded(F.col("a")), []), a='{"x":"1"}') == {}
    refs = F.from_json(F.col("a"), "array<struct<by:string,post:string>>")
    assert one(spark, F.size(maps.referenced(refs, F.lit("u"), F.lit("p"))), a='[{"by":"u","post":"p"}]') == 1
    assert one(spark, F.size(maps.referenced(refs, F.lit("u"), F.lit("q"))), a='[{"by":"u","post":"p"}]') == 2


_LADDER = [  # address, link kind, what a trusted link becomes, paper, (type, profile, shape, handle)
    ("https://github.com/a/b", "github", "github", None, ("github", False, "personal", "a")), ("https://evilgithub.com/a", None, "article", None, ("blog", False, "unknown", "evilgithub")),
    ("https://github.com/Me/", "github", "github", None, ("github", True, "personal", "me")), ("https://github.com/orgs/OpenX/people", "github", "github", None, ("github", True, "org", "openx")),
    ("https://github.com/Pricing", "github", None, None, ("github", False, "unknown", None)), ("https://www.arxiv.org/abs/2301.01234v2", "paper", "paper", "arXiv:2301.01234", ("paper", False, "unknown", None)),
    ("https://arxiv.org/pdf/hep-th/9901001.pdf?x=1", "paper", "paper", "arXiv:hep-th/9901001", ("paper", False, "unknown", None)), ("https://arxiv.org/a/lee_k_1", "paper", "paper", None, ("scholar", True, "personal", "lee_k_1")),
    ("https://arxiv.org/", "paper", None, None, ("paper", False, "unknown", None)), ("https://huggingface.co/papers/2301.01234", "paper", "paper", "arXiv:2301.01234", ("blog", False, "unknown", "huggingface")),
    ("https://x.org/doi/10.1000/ABC.", "paper", "paper", "DOI:10.1000/abc", ("blog", False, "unknown", "x")), ("https://j.org/article/10.1007/s1-2/full/html", "paper", "paper", "DOI:10.1007/s1-2", ("blog", False, "unknown", "j")),
    ("https://doi.org/10.48550/arXiv.2301.01234v3", "paper", "paper", "arXiv:2301.01234", ("paper", False, "unknown", None)), ("https://www.biorxiv.org/content/10.1101/2020.01.02.1234v2.full.pdf", "paper", "paper", "DOI:10.1101/2020.01.02.1234", ("paper", False, "unknown", None)),
    ("https://papers.ssrn.com/sol3/papers.cfm?abstract_id=3482150", "paper", "paper", "DOI:10.2139/ssrn.3482150", ("paper", False, "unknown", None)),
    ("https://www.semanticscholar.org/paper/A-b/0123456789abcdef0123456789abcdef01234567", "paper", "paper", "0123456789abcdef0123456789abcdef01234567", None),
    ("https://openreview.net/forum?id=Ab-1&x=2", "paper", "paper", "openreview:Ab-1", ("paper", False, "unknown", None)), ("https://eprint.iacr.org/2025/2041.pdf", "paper", "paper", "url:eprint.iacr.org/2025/2041", ("paper", False, "unknown", None)),
    ("https://a.org/B.PDF?x=1", "paper", "paper", "url:a.org/B.PDF", ("paper", False, "unknown", None)), ("https://europepmc.org/article/MED/12", "paper", "paper", None, ("blog", False, "unknown", "europepmc")),
    ("https://a.substack.com/p/x", "substack", "substack", None, ("substack", False, "personal", "a")), ("https://a.substack.com/about", "substack", "substack", None, ("substack", True, "personal", "a")),
    ("https://x.com/Me", None, None, None, ("x", True, "personal", "me")), ("https://mobile.twitter.com/Me/status/12/photo/1", None, "x", None, ("x", False, "personal", "me")), ("https://x.com/i/lists/1", None, None, None, ("x", False, "unknown", None)),
    ("https://medium.com/@You/post-1", None, "article", None, ("blog", False, "personal", "you")), ("https://scholar.google.com/citations?hl=en&user=a%2Db", None, "article", None, ("scholar", True, "personal", "a-b")),
    ("https://orcid.org/0000-0001-2345-678X", None, "article", None, ("orcid", True, "personal", "0000-0001-2345-678X")), ("https://willcb.com", None, None, None, ("blog", True, "unknown", "willcb")),
    ("https://jobs.acme.com/x", None, None, None, ("blog", False, "unknown", "acme")), ("https://acme.com/careers/1", None, None, None, ("blog", False, "unknown", "acme")), ("https://acme.com/p/joining-forces", None, "article", None, ("blog", False, "unknown", "acme")),
    ("https://lu.ma/abc", None, None, None, ("blog", False, "unknown", "lu")), ("https://chatgpt.com/share/1", None, None, None, ("blog", False, "unknown", "chatgpt")), ("https://youtu.be/abc", None, None, None, None), ("notaurl", None, None, None, None), ("ftp://a.b/c", None, None, None, None),
]


def test_ladder_of_links(spark):
    from pyspark.sql import functions as F

    from marginalia.functions import urls

    u = F.col("u")
    rows = spark.createDataFrame([(i, x[0]) for i, x in enumerate(_LADDER)], "i int, u string").select("i", urls.link_kind(u).alias("k"), urls.reference_kind(u).alias("r"), urls.paper_id(u).alias("p"), urls.profile(u).alias("f"))
    for r in rows.collect():
        url, kind, reference, paper, profile = _LADDER[r.i]
        got = r.f and (r.f.type, r.f.is_profile, r.f["shape"], r.f.handle)
        assert (url, r.k, r.r, r.p) == (url, kind, reference, paper)
        assert profile is None and (r.f is None or "semanticscholar" in url) or got == profile, (url, got)


def test_claims_and_cards(spark):
    from pyspark.sql import functions as F

    from marginalia.functions import urls

    rows = [("https://a.org/x", "paper"), ("https://a.org/x", "poem"), ("https://github.com/a", "paper"), ("https://x.com/a/status/1", None), ("a.org/x", "paper"), (None, None)]
    got = spark.createDataFrame(rows, "u string, c string").select(urls.hand_reference(F.col("u"), F.col("c")).alias("h"), urls.card_link(F.col("u")).alias("card")).collect()
    assert [(r.h.kind, r.h.basis) for r in got] == [("paper", "hint"), ("article", "fallback"), ("github", "sniffed"), ("x", "sniffed"), (None, "none"), (None, "none")]
    cards = spark.createDataFrame([(x,) for x in ("https://a.org/", "https://a.org/jobs/1", "https://docs.google.com/forms/d/1", "https://x.com/", "https://claude.ai/", "https://a.org/p", "a.org/")], "u string")
    assert [r.c for r in cards.select(urls.card_link(F.col("u")).alias("c")).collect()] == [True, True, True, False, False, False, False]


def test_sites_and_posts(spark):
    assert [one(spark, urls.site_label(F.col("h")), h=h) for h in ("willcb.com", "blog.willcb.com", "foo.co.uk", "local", "")] == ["willcb", "willcb", "foo", "local", None]
    assert one(spark, urls.post_id(F.col("u")), u="https://x.com/a/status/123/photo/1?s=2") == "123" and one(spark, urls.post_id(F.col("u")), u="https://nitter.net/a/status/1") is None


def test_stems():
    from marginalia.functions.stemming import folded, stem

    pairs = "caresses caress, ponies poni, agreed agre, plastered plaster, motoring motor, sing sing, hopping hop, falling fall, filing file, happy happi, sky sky, relational relat, digitizer digit, triplicate triplic, hopeful hope, goodness good, adjustment adjust, adoption adopt, probate probat, rate rate, controll control, generalizations gener, is is, straße straße"
    assert all(stem(a) == b for a, b in (p.split() for p in pairs.split(", ")))
    assert stem("accountability") == stem("accountable") and folded("Ça và") == "ca va" and folded(None) == ""


def test_stemmed_search_and_content_words(spark):
    from marginalia.operators import search

    docs = spark.createDataFrame([(1, "On accountability in café life"), (2, "nothing of it"), (3, None)], "doc_id long, text string")
    assert [r.doc_id for r in search.bm25(docs, "accountable", stemmed=True).collect()] == [1] and search.bm25(docs, "accountable").count() == 0
    assert [r.doc_id for r in search.bm25(docs, "cafe", stemmed=True).collect()] == [1]
    assert search.content_words("What is the Thing of things") == ["thing", "things"] and search.content_words("the of") == [] and search.query_words("the of") == ["the", "of"]


def test_identities_join_by_owned_addresses_only(spark):
    from marginalia.operators import graph

    links = spark.createDataFrame([(1, "a", True), (2, "a", False), (3, "hub", False), (4, "hub", False), (5, "b", True), (2, "b", False), (6, None, True)], "e long, u string, owns boolean")
    heads = graph.resolved(links, "e", "u", links["owns"])
    assert {r.entity: r["head"] for r in heads.collect()} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 1, 6: 6}


@pytest.mark.parametrize(
    ("claims", "want"),
    [
        ([(3, 1, 20), (3, 4, 10)], {1: 1, 2: 1, 3: 3, 4: 3, 5: 1, 6: 6}),  # the earliest claim wins
        ([(5, 4, 1)], {1: 1, 2: 1, 3: 3, 4: 1, 5: 1, 6: 6}),  # a cluster of many is joined whole
        ([(5, 4, 1), (2, 5, 9)], {1: 1, 2: 1, 3: 3, 4: 4, 5: 1, 6: 6}),  # its own claim keeps it, though a later one
        ([(3, 4, 1), (6, 3, 2), (99, 4, 1), (6, 99, 1)], {1: 1, 2: 1, 3: 3, 4: 3, 5: 1, 6: 3}),  # joins follow one another; the unknown don't count
        ([], {1: 1, 2: 1, 3: 3, 4: 4, 5: 1, 6: 6}),
    ],
)
def test_added_sources(spark, claims, want):
    from marginalia.operators import graph

    heads = spark.createDataFrame([(1, 1), (2, 1), (3, 3), (4, 4), (5, 1), (6, 6)], "entity long, head long")
    rows = spark.createDataFrame(claims, "source long, by long, at int")
    assert {r.entity: r["head"] for r in graph.added_sources(heads, rows, "source", "by", "at").collect()} == want


def test_titles_and_dates_of_pages(spark):
    from pyspark.sql import functions as F

    from marginalia.functions import pages

    page = """<!-- <title>no</title> --><script>var x = '<title>nor this</title>';</script><title>Tom &amp; Jerry&#8217;s
      day</title><meta name="description" content="a &lt;b&gt;&nbsp; c"><meta name="date" content="2020-01-01"><meta name="publish-date" content="2021-02-03">
      <meta property="article:published" content="2021-01-02T10:00:00Z"><meta property="og:published_time" content="2019-01-01">"""
    rows = spark.createDataFrame([(page,), ("",), (None,)], "p string")
    got = rows.select(pages.title(F.col("p")).alias("t"), pages.description(F.col("p")).alias("d"), pages.published(F.col("p"), F.lit("2026-01-01").cast("date")).cast("string").alias("day")).collect()
    assert [tuple(r) for r in got[:2]] == [("Tom & Jerry’s day", "a <b> c", "2021-01-02"), ("", "", None)]


def test_a_reference_that_a_title_was_cut_in_stays(spark):
    from marginalia.functions import pages

    got = {t: one(spark, pages.title(F.col("p")), p=f"<title>{t}</title>") for t in ("a &amp;&amp b", "a&amp", "&notit; &amp;lt;", "&eacute;&#233&#xe9;")}
    assert got == {"a &amp;&amp b": "a &&amp b", "a&amp": "a&amp", "&notit; &amp;lt;": "&notit; &lt;", "&eacute;&#233&#xe9;": "é&#233é"}


def test_gap_rule_and_accounts(spark):
    from pyspark.sql import functions as F

    from marginalia.functions import urls
    from marginalia.operators import curation

    walks = spark.createDataFrame([("a", 9, True, 5), ("b", 9, False, 5), ("c", 3, True, 5)], "k string, started int, finished boolean, cursor int")
    assert {r.k: r.claimed for r in curation.without_gap(walks, "k", "started", "finished", "cursor").collect()} == {"a": 9, "b": 5, "c": 5}
    want = {
        "https://twitter.com/Some_One/status/1": "x.com/some_one", "medium.com/@X": "medium.com/@x", "https://you.medium.com/a": "you.medium.com", "https://www.semanticscholar.org/author/N/12": "semanticscholar.org/author/12",
        "https://orcid.org/0000-0001-2345-678X": "orcid.org/0000-0001-2345-678X", "https://orcid.org/me": "", "https://dblp.org/pid/1/2.html": "dblp.org/pid/1/2", "https://www.researchgate.net/profile/A_B": "researchgate.net/profile/a_b",
        "https://uni.academia.edu/": "uni.academia.edu", "https://academia.edu/123": "", "https://arxiv.org/a/k_1": "arxiv.org/a/k_1", "https://youtu.be/x": "", "localhost": "", "ftp://a.b/c": "", "mailto:a@b.c": "", "a b.c": "", "": "",
    }
    rows = spark.createDataFrame([(k,) for k in [*want, None]], "u string").select("u", urls.account(F.col("u")).alias("a")).collect()
    assert {r.u: r.a for r in rows} == {**want, None: ""}
