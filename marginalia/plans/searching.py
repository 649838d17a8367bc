"""Searches over stored indexes, built once for an application and folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from marginalia.functions.stemming import folded_words, stem
from marginalia.operators import postings, search
from marginalia.storage import shared_folder, table

QUERY = "the thing"
PAGE = 8
_BUILT: dict[tuple, postings.Index] = {}


def index(spark: SparkSession, d: str, stemmed: bool = False) -> postings.Index:
    """The index of ``documents`` below ``d``, by words or by stems; it is written when first asked for."""
    key = (spark.sparkContext.applicationId, d.rstrip("/"), stemmed)
    if key not in _BUILT:
        made = postings.Index(spark, f"{shared_folder(spark)}/postings-{uuid.uuid4().hex}")
        words, how = (F.col("text"), {"find": folded_words, "each": stem}) if stemmed else (search.tokens(F.col("text")), {})
        _BUILT[key] = made.write(table(spark, d, "documents"), "doc_id", words, **how)
    return _BUILT[key]


def indexed_search(spark: SparkSession, d: str) -> DataFrame:
    """The 50 best English documents, from stored postings."""
    english = table(spark, d, "documents").where("lang = 'en'").select("doc_id")
    return index(spark, d).bm25(search.query_words(QUERY), 50, english).withColumnRenamed("id", "doc_id")


def indexed_phrase(spark: SparkSession, d: str) -> DataFrame:
    """How often each document has a phrase, by positions."""
    return index(spark, d).phrase(["of", "the"]).withColumnRenamed("id", "doc_id")


def _shown(rows: DataFrame) -> DataFrame:
    label = F.concat_ws(" · ", F.coalesce("who_name", "source"), F.col("lang"))
    return rows.select(
        "doc_id", "rank", F.round("score", 4).alias("score"), "who_name", "start", F.sha2("excerpt", 256).alias("excerpt_sha256"), "last_returned", "next_best", "saturated",
        postings.link(label, F.concat(F.lit("https://corpus.example/a b/"), F.col("doc_id").cast("string"))).alias("cite"), *(c for c in ("section",) if c in rows.columns),
    )


def _authored(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Documents with an author (a nation by their id; of some there is no name) and the authors."""
    docs = table(spark, d, "documents").withColumn("who_id", (F.col("doc_id") % 30).cast("int"))
    return docs, table(spark, d, "nation").select(F.col("n_nationkey").alias("who_id"), F.col("n_name").alias("name"))


def search_hits(spark: SparkSession, d: str) -> DataFrame:
    """A page of hits as a reader sees it: author, excerpt, link and where the cut fell."""
    docs, people = _authored(spark, d)
    return _shown(postings.hits(index(spark, d), docs, QUERY, PAGE, candidates=docs.where("lang = 'en'").select("doc_id"), people=people))


def search_sections(spark: SparkSession, d: str) -> DataFrame:
    """Hits among what people saved, and beside them those among what was found by itself (every fourth document)."""
    docs, people = _authored(spark, d)
    return _shown(postings.sections(index(spark, d), docs, QUERY, PAGE, F.col("doc_id") % 4 != 0, people=people))


def search_stemmed(spark: SparkSession, d: str) -> DataFrame:
    """The best documents by stems of their words; stems are worked out when the index is written."""
    tokens = list(dict.fromkeys(stem(w) for w in search.query_words("accountable things")))
    return index(spark, d, stemmed=True).bm25(tokens, 50).withColumnRenamed("id", "doc_id")


QUERIES = {f.__name__: f for f in (indexed_search, indexed_phrase, search_hits, search_sections, search_stemmed)}


def sql(bm25, tokens: str) -> dict[str, str]:
    """The queries as SQL; ``bm25(k, where)`` gives the ``k`` best hits (doc_id, rank, score)."""
    word = search.query_words(QUERY)[0]

    def page(where: str, k: int) -> str:
        best = bm25(max(5 * k, 40), where)
        return (
            f"WITH h AS (SELECT doc_id, rank FROM ({best})), t AS (SELECT doc_id, rank, text, lang, source, length(text) AS n FROM h JOIN documents USING (doc_id) WHERE rank <= {k}), "
            f"p AS (SELECT *, list_transform(string_split(regexp_replace(text, '(?i)(\\b{word}\\b)', chr(1) || '\\1', 'g'), chr(1)), lambda x: length(x)) AS l FROM t), a AS (SELECT doc_id, n, l, unnest(range(1, len(l))) AS i FROM p), "
            "m AS (SELECT doc_id, n, CAST(list_sum(l[1:i]) AS BIGINT) AS place FROM a), w AS (SELECT DISTINCT doc_id, greatest(0, least(place - 100, n - 1600)) AS low FROM m), "
            "c AS (SELECT w.doc_id, w.low, count(*) AS held FROM w JOIN m ON m.doc_id = w.doc_id AND m.place >= w.low AND m.place < w.low + 1600 GROUP BY 1, 2), "
            "b AS (SELECT doc_id, low AS start FROM c QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY held DESC, low) = 1) "
            "SELECT t.doc_id, CAST(rank AS INT) AS rank, round(1 / rank, 4) AS score, n_name AS who_name, start, sha256(substr(text, CAST(start AS INT) + 1, 1600)) AS excerpt_sha256, "
            f"CASE WHEN (SELECT count(*) FROM h) > {k} THEN round(1 / {k}, 4) END AS last_returned, CASE WHEN (SELECT count(*) FROM h) > {k} THEN round(1 / {k + 1}, 4) END AS next_best, (SELECT count(*) FROM h) >= {max(5 * k, 40)} AS saturated, "
            "'[' || coalesce(n_name, source) || ' · ' || lang || '](<https://corpus.example/a b/' || t.doc_id || '>)' AS cite FROM t JOIN b ON t.doc_id = b.doc_id LEFT JOIN nation ON n_nationkey = t.doc_id % 30"
        )

    return {
        "indexed_search": f"SELECT doc_id, CAST(rank AS INT) AS rank, score FROM ({bm25(50, "lang = 'en'")})",
        "indexed_phrase": f"SELECT doc_id, CAST(times AS INT) AS times FROM (SELECT doc_id, len(list_filter(range(1, len(t)), lambda i: t[i] = 'of' AND t[i + 1] = 'the')) AS times FROM (SELECT doc_id, {tokens} AS t FROM documents)) WHERE times > 0",
        "search_hits": page("lang = 'en'", PAGE),
        "search_sections": f"SELECT *, 'trusted' AS section FROM ({page("doc_id % 4 <> 0", PAGE)}) UNION ALL SELECT *, 'frontier' AS section FROM ({page("doc_id % 4 = 0", 8)})",
    }
