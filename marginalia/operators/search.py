"""Keyword search: tokens, BM25, phrases, reciprocal ranks."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window, functions as F

from marginalia.functions.stemming import stem, stems

#: Words that a query drops unless it has no others.
STOP = frozenset(
    "a about an and are as at be been but by can could did do does for from had has have how i if in into is it its me my of on or our so than that the their them then there these they "
    "this to was we were what when where which who why will with would you your".split()
)
K1, B = 1.2, 0.75


def content_words(text: str) -> list[str]:
    """Distinct ASCII words of a query, lower-cased, without stop words; none for a query of common words only."""
    return [w for w in dict.fromkeys(w.lower() for w in re.findall(r"[A-Za-z0-9_]+", text)) if w not in STOP]


def query_words(text: str) -> list[str]:
    """The content words of a query, or all of its words if it has no others."""
    return content_words(text) or list(dict.fromkeys(w.lower() for w in re.findall(r"[A-Za-z0-9_]+", text)))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def bm25(docs: DataFrame, query: str, k: int = 10, where: Column | None = None, id_col: str = "doc_id", text_col: str = "text", stemmed: bool = False) -> DataFrame:
    """(id, rank, score) of the best ``k`` documents under ``where``; document frequencies and lengths are the whole corpus's.

    One pass gives each text's length and the counts of the query's words, so no posting list is shuffled; the
    corpus figures are one row. Okapi BM25 with k1 1.2 and b 0.75; ties go to the smaller id. A query without
    words, or an empty corpus, finds nothing. ``stemmed``: words are compared by their stems, accents aside.
    """
    want = query_words(query)
    if stemmed:
        want = list(dict.fromkeys(stem(w) for w in want))
    t = F.col("_t")
    keep = where if where is not None else F.lit(True)
    counted = docs.select(F.col(id_col), keep.alias("_keep"), (stems(text_col) if stemmed else tokens(F.col(text_col))).alias("_t")).select(
        id_col, "_keep", F.size(t).alias("dl"), *((F.size(t) - F.size(F.array_remove(t, w))).alias(f"tf{i}") for i, w in enumerate(want))
    )
    stats = counted.agg(F.count("*").alias("_n"), F.avg("dl").alias("_avg"), *(F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(want))))
    score: Column = F.lit(0.0)
    for i in range(len(want)):
        tf, df = F.col(f"tf{i}"), F.col(f"df{i}")
        idf = F.log(1 + (F.col("_n") - df + 0.5) / (df + 0.5))
        score = score + idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / F.col("_avg")))
    hits = counted.where(F.col("_keep")).crossJoin(F.broadcast(stats)).withColumn("score", F.round(score, 6)).where("score > 0")  # stats: one row
    top = hits.orderBy(F.desc("score"), id_col).limit(k)
    return top.select(id_col, F.row_number().over(Window.orderBy(F.desc("score"), id_col)).alias("rank"), "score")


def phrase_matches(docs: DataFrame, phrase: str, text_col: str = "text") -> DataFrame:
    """Documents that have the phrase's words in a row."""
    want = [w.lower() for w in re.findall(r"[A-Za-z0-9_]+", phrase)]
    spaced = F.concat(F.lit(" "), F.array_join(tokens(F.col(text_col)), " "), F.lit(" "))
    return docs.where(F.contains(spaced, F.lit(f" {' '.join(want)} "))) if want else docs.where(F.lit(False))


def reciprocal_ranks(hits: DataFrame, owner: str, rank: str = "rank") -> DataFrame:
    """(owner, score, hits): the sum of 1 / (60 + rank) over an owner's hits, best first."""
    return hits.groupBy(owner).agg(F.bround(F.sum(1 / (F.lit(60) + F.col(rank))), 5).alias("score"), F.count("*").alias("hits"))


def densest_windows(docs: DataFrame, pattern: str, width: int, lead: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, start): where in each text the window of ``width`` characters with most matches begins, ``lead`` before its first one.

    Of equal windows the earliest is taken; a text without a match begins at 0. Matches are counted by a sliding
    range of places, so the work is linear in them. Ids tell rows apart.
    """
    parts = F.split(F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), f"({pattern})", "\x00$1"), "\x00")  # each part but the first begins with a match
    rows = docs.select(id_col, F.length(text_col).alias("_n"), F.posexplode(F.transform(parts, F.length)).alias("_i", "_len"))
    by = Window.partitionBy(id_col)
    at = F.coalesce(F.sum("_len").over(by.orderBy("_i").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    found = rows.withColumn("_at", at).where("_i > 0")
    last = F.col("_n") - width  # where the last window begins
    inner = F.count("*").over(by.orderBy("_at").rangeBetween(-lead, width - lead - 1))
    ahead, behind = F.count_if(F.col("_at") < width).over(by), F.count_if(F.col("_at") >= last).over(by)
    low = F.greatest(F.lit(0), F.least(F.col("_at") - lead, last))
    held = F.when(low == 0, ahead).when(low == last, behind).otherwise(inner)
    best = found.select(id_col, held.alias("_held"), low.alias("_low")).groupBy(id_col).agg(F.max(F.struct("_held", (-F.col("_low")).alias("_back"))).alias("_best"))
    return docs.select(id_col).join(best, id_col, "left").select(id_col, F.coalesce(-F.col("_best._back"), F.lit(0)).cast("long").alias("start"))
