"""A stored positional index: postings by token, written once, kept up by generations, read only where a query's tokens are."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import partial, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from marginalia.functions.stemming import REMEMBERED, folded, stem
from marginalia.functions.texts import LEAD, WIDTH
from marginalia.operators.search import B, K1, query_words

#: Folders that tokens are dealt to by hash; a query reads those of its tokens.
BUCKETS = 64
#: The folder of the rows without a token, one for each document.
OWN = -1
#: Texts whose postings are held at once, and postings that are handed on together.
TEXTS, ROWS = 1024, 1 << 16
_SCHEMA = pa.schema([("token", pa.string()), ("id", pa.int64()), ("dl", pa.int32()), ("tf", pa.int32()), ("positions", pa.list_(pa.int32()))])


def _postings(batches: Iterator[pa.RecordBatch], find: Callable[[str], list[str]] | None = None, each: Callable[[str], str] | None = None) -> Iterator[pa.RecordBatch]:
    """(token, id, dl, tf, positions) of each row's (id, words): one row for each distinct word, and one without a token for the row itself.

    ``find`` gives the words of a text, if texts come in their place, and ``each`` what a word is indexed as.
    """
    known: dict[str, str] = {}
    for batch in batches:
        for at in range(0, batch.num_rows, TEXTS):
            part = batch.slice(at, TEXTS)
            ids, lists = part.column("id"), part.column("words")
            if find:
                lists = pa.array([find(t) for t in lists.to_pylist()], pa.list_(pa.string()))
            sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            coded = lists.flatten().dictionary_encode()
            names, codes = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
            if each:
                if len(known) > REMEMBERED:
                    known.clear()
                as_words = names.to_pylist()
                for w in as_words:
                    if w not in known:
                        known[w] = each(w)
                same = pa.array([known[w] for w in as_words], pa.string()).dictionary_encode()
                names, codes = same.dictionary, same.indices.to_numpy(zero_copy_only=False)[codes] if len(codes) else codes
            row = np.repeat(np.arange(len(sizes)), sizes)
            place = np.arange(len(codes)) - np.repeat(sizes.cumsum() - sizes, sizes)
            order = np.argsort(codes, kind="stable")  # by token, then by row and place, for so they lie
            code, row = codes[order], row[order]
            first = np.flatnonzero(np.r_[True, (code[1:] != code[:-1]) | (row[1:] != row[:-1])]) if len(code) else np.zeros(0, np.int64)
            ends = np.r_[first, len(code)].astype(np.int32)
            own = row[first]
            for low in range(0, len(first), ROWS):
                cut = slice(low, low + ROWS)
                edge = ends[low : low + ROWS + 1]
                yield pa.RecordBatch.from_arrays([
                    names.take(pa.array(code[first[cut]])), ids.take(pa.array(own[cut])), pa.array(sizes[own[cut]], pa.int32()), pa.array(np.diff(edge), pa.int32()),
                    pa.ListArray.from_arrays(pa.array(edge - edge[0], pa.int32()), pa.array(place[order[edge[0] : edge[-1]]], pa.int32())),
                ], schema=_SCHEMA)
            none = pa.nulls(len(sizes))
            yield pa.RecordBatch.from_arrays([none.cast(pa.string()), ids, pa.array(sizes, pa.int32()), none.cast(pa.int32()), none.cast(pa.list_(pa.int32()))], schema=_SCHEMA)


def _bucket(token: str, buckets: int) -> int:
    """The folder of a token: Spark's xxhash64 of it, modulo."""
    h = xxhash.xxh64_intdigest(token.encode(), 42)
    return (h - (1 << 64) if h >> 63 else h) % buckets


class Index:
    """An index below ``path``: the postings, and of each generation the documents it holds with their lengths.

    A generation is written postings first and its list of documents last, so a write that is cut off counts for
    nothing. A document that a later generation names, with a text or without, is no longer looked for in earlier ones.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS) -> None:
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def _generations(self) -> list[int]:
        return sorted(r.gen for r in self.spark.read.parquet(f"{self.path}/documents").select("gen").distinct().collect())  # a folder each

    def write(self, docs: DataFrame, id_col: str, words: Column, gone: DataFrame | None = None, gen: int = 0, find: Callable[[str], list[str]] | None = None, each: Callable[[str], str] | None = None) -> "Index":
        """Add ``docs`` (id and an expression for its array of words) as a generation; ``gone`` are ids that go. Ids are unique and not null.

        With ``find``, ``words`` is the text, of which it gives the words; ``each`` says what a word is indexed as. Every
        task writes to the folders what it finds, without a shuffle or a sort, and texts are split into words once.
        """
        rows = docs.select(F.col(id_col).cast("long").alias("id"), words.alias("words")).where("id is not null")
        bucket = F.when(F.col("token").isNull(), OWN).otherwise(F.pmod(F.xxhash64("token"), F.lit(self.buckets)).cast("int"))
        found = rows.mapInArrow(partial(_postings, find=find, each=each), "token string, id long, dl int, tf int, positions array<int>").withColumns({"gen": F.lit(gen), "bucket": bucket})
        key, open_files = "spark.sql.maxConcurrentOutputFileWriters", self.spark.conf.get("spark.sql.maxConcurrentOutputFileWriters")
        self.spark.conf.set(key, str(self.buckets + 2))  # with as many open as it may have, Spark sorts the rest
        try:
            found.write.mode("append").option("compression", "zstd").partitionBy("gen", "bucket").parquet(f"{self.path}/postings")
        finally:
            self.spark.conf.set(key, open_files)
        held = self._every().where((F.col("gen") == gen) & (F.col("bucket") == OWN)).select("id", "dl")
        if gone is not None:
            held = held.union(gone.select(F.col(id_col).cast("long"), F.lit(None).cast("int")))
        held.withColumn("gen", F.lit(gen)).write.mode("append").partitionBy("gen").parquet(f"{self.path}/documents")
        return self

    def _every(self) -> DataFrame:
        return self.spark.read.schema("token string, id long, dl int, tf int, positions array<int>, gen int, bucket int").parquet(f"{self.path}/postings")

    def upsert(self, docs: DataFrame, id_col: str, words: Column, gone: DataFrame | None = None) -> "Index":
        """A further generation: new and changed documents, and ids that go."""
        return self.write(docs, id_col, words, gone, self._generations()[-1] + 1)

    def _live(self, rows: DataFrame, gens: list[int]) -> DataFrame:
        """Rows of complete generations whose document no later generation names."""
        rows = rows.where(F.col("gen").isin(gens))
        if len(gens) == 1:
            return rows
        later = self.spark.read.parquet(f"{self.path}/documents").where(F.col("gen") > gens[0]).select(F.col("id").alias("_id"), F.col("gen").alias("_gen"))
        return rows.join(later, (F.col("id") == F.col("_id")) & (F.col("_gen") > F.col("gen")), "left_anti")

    def documents(self) -> DataFrame:
        """(id, dl) of the documents that are there."""
        gens = self._generations()
        return self._live(self.spark.read.parquet(f"{self.path}/documents"), gens).where("dl is not null").select("id", "dl")

    def lists(self, tokens: list[str]) -> DataFrame:
        """Postings of some tokens, from their folders."""
        every = self._every()
        if not tokens:
            return every.limit(0)
        own = every.where(F.col("bucket").isin(sorted({_bucket(t, self.buckets) for t in tokens})) & F.col("token").isin(tokens))
        return self._live(own, self._generations()).select("token", "id", "dl", "tf", "positions")

    def compacted(self, path: str) -> "Index":
        """The same documents as one generation of a new index."""
        gens = self._generations()
        live = self._live(self._every(), gens).withColumn("gen", F.lit(0))
        live.repartition("bucket", F.pmod("id", F.lit(8))).sortWithinPartitions("bucket", "token", "id").write.partitionBy("gen", "bucket").parquet(f"{path}/postings")
        self.documents().withColumn("gen", F.lit(0)).write.partitionBy("gen").parquet(f"{path}/documents")
        return Index(self.spark, path, self.buckets)

    def bm25(self, tokens: list[str], k: int, candidates: DataFrame | None = None) -> DataFrame:
        """(id, rank, score) of the best ``k`` documents, among ``candidates`` (ids) if given; counts are the whole corpus's.

        Okapi BM25 as over the texts (see ``search.bm25``); ties go to the smaller id, no tokens find nothing.
        """
        tokens = list(dict.fromkeys(tokens))
        stats = self.documents().agg(F.count("*").alias("_n"), F.avg("dl").alias("_avg"))
        found = self.lists(tokens).groupBy("id").agg(F.first("dl").alias("dl"), *(F.coalesce(F.max(F.when(F.col("token") == t, F.col("tf"))), F.lit(0)).alias(f"tf{i}") for i, t in enumerate(tokens)))
        if not tokens:
            return found.select("id", F.lit(0).alias("rank"), F.lit(0.0).alias("score")).limit(0)
        df = self.lists(tokens).groupBy().agg(*(F.count_if(F.col("token") == t).alias(f"df{i}") for i, t in enumerate(tokens)))
        score: Column = F.lit(0.0)
        for i in range(len(tokens)):
            tf, n = F.col(f"tf{i}"), F.col(f"df{i}")
            score = score + F.log(1 + (F.col("_n") - n + 0.5) / (n + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / F.col("_avg")))
        if candidates is not None:
            found = found.join(candidates.select(F.col(candidates.columns[0]).alias("id")).distinct(), "id", "left_semi")
        hits = found.crossJoin(F.broadcast(stats)).crossJoin(F.broadcast(df)).withColumn("score", F.round(score, 6)).where("score > 0")  # one row each
        top = hits.orderBy(F.desc("score"), "id").limit(k)
        return top.select("id", F.row_number().over(Window.orderBy(F.desc("score"), "id")).alias("rank"), "score")

    def phrase(self, tokens: list[str]) -> DataFrame:
        """(id, times): documents that have the tokens side by side, and how often: positions less their place in the phrase, met."""
        if not tokens:
            return self.lists([]).select("id", F.lit(0).alias("times"))
        names = {t: f"_p{i}" for i, t in enumerate(dict.fromkeys(tokens))}
        rows = self.lists(list(names)).groupBy("id").agg(*(F.max(F.when(F.col("token") == t, F.col("positions"))).alias(c) for t, c in names.items()))
        shifted = lambda c, by: F.transform(c, lambda x: x - by)
        begins = [shifted(names[t], i) for i, t in enumerate(tokens)]
        times = F.size(reduce(F.array_intersect, begins))
        return rows.where(" and ".join(f"{c} is not null" for c in names.values())).select("id", times.alias("times")).where("times > 0")


def excerpts(tokens: list[str], stemmed: bool, width: int = WIDTH, lead: int = LEAD):
    """A function of a text column: (start, matches) of its window of ``width`` characters with most matches of the tokens, as the index counts them.

    The window begins ``lead`` characters before its first match; of equal windows the earliest is taken, and a
    text without a match begins at 0.
    """
    want = frozenset(tokens)

    @F.pandas_udf(T.StructType([T.StructField("start", T.LongType()), T.StructField("matches", T.LongType())]))
    def densest(texts: pd.Series) -> pd.DataFrame:
        out = []
        for text in texts:
            text = text or ""
            same = (lambda w: stem(folded(w))) if stemmed else str.lower
            at = np.array([m.start() for m in re.finditer(r"\w+", text) if same(m.group()) in want], np.int64)
            low = np.maximum(0, np.minimum(at - lead, len(text) - width))
            held = np.searchsorted(at, low + width) - np.searchsorted(at, low)
            best = int(held.argmax()) if len(at) else 0
            out.append((int(low[best]), int(held[best])) if len(at) else (0, 0))
        return pd.DataFrame(out, columns=["start", "matches"])

    return densest


def link(label: Column, url: Column) -> Column:
    """A Markdown link, null without an address: brackets leave the label, and an address with spaces or brackets stands in angle brackets."""
    name = F.coalesce(F.nullif(F.trim(F.regexp_replace(label, r"[\[\]]", "")), F.lit("")), F.lit("source"))
    target = F.trim(url)
    bracketed = F.concat(F.lit("<"), F.regexp_replace(target, "[<>]", ""), F.lit(">"))
    return F.when(F.nullif(url, F.lit("")).isNotNull(), F.concat(F.lit("["), name, F.lit("]("), F.when(target.rlike("[ ()<>]"), bracketed).otherwise(target), F.lit(")")))


def hits(
    index: Index, docs: DataFrame, query: str, k: int, id_col: str = "doc_id", text_col: str = "text", candidates: DataFrame | None = None, people: DataFrame | None = None,
    who_col: str = "who_id", stemmed: bool = False,
) -> DataFrame:
    """A page of hits as shown: id, rank, score (the reciprocal rank), the author's name, the excerpt with its span, and where the cut fell.

    More hits than asked for are ranked, five times ``k`` and 40 at least: ``last_returned`` and ``next_best`` are the
    scores on either side of the cut (null if nothing was cut off), ``saturated`` says that more may follow even those.
    Texts are read for the hits alone, by their ids. ``people`` has who_col and name; an author that isn't there has none.
    """
    words = query_words(query)
    words = list(dict.fromkeys(stem(w) for w in words)) if stemmed else words
    pool = max(5 * k, 40)
    ranked = index.bm25(words, pool, candidates).collect()  # ``pool`` rows at most
    shown = index.spark.createDataFrame([(r.id, r["rank"], 1.0 / r["rank"]) for r in ranked[:k]], "_id long, rank int, score double")
    cut = (round(1.0 / k, 4), round(1.0 / (k + 1), 4)) if len(ranked) > k > 0 else (None, None)
    rows = docs.where(F.col(id_col).isin([r.id for r in ranked[:k]])).join(F.broadcast(shown), F.col(id_col) == F.col("_id")).drop("_id")  # ``k`` rows
    if people is not None:
        rows = rows.join(people.select(F.col(who_col).alias("_who"), F.col("name").alias("who_name")), F.col(who_col) == F.col("_who"), "left").drop("_who")
    span = excerpts(words, stemmed)(F.col(text_col))
    return rows.withColumn("_span", span).withColumns({
        "excerpt": F.expr(f"substring(`{text_col}`, cast(_span.start as int) + 1, {WIDTH})"), "start": F.col("_span.start"), "matches": F.col("_span.matches"),
        "last_returned": F.lit(cut[0]).cast("double"), "next_best": F.lit(cut[1]).cast("double"), "saturated": F.lit(len(ranked) >= pool),
    }).drop("_span", text_col)


def sections(index: Index, docs: DataFrame, query: str, k: int, trusted: Column, cap: int = 8, **more) -> DataFrame:
    """``hits`` among the trusted documents, and beside them, ranked apart and ``cap`` at most, those among all others."""
    ids = lambda cond: docs.where(cond).select(more.get("id_col", "doc_id"))
    own = F.coalesce(trusted, F.lit(False))
    first = hits(index, docs, query, k, candidates=ids(own), **more).withColumn("section", F.lit("trusted"))
    return first.unionByName(hits(index, docs, query, cap, candidates=ids(~own), **more).withColumn("section", F.lit("frontier")))
