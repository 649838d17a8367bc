"""The registered queries of this subpackage and, where SQL can say the same, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from marginalia.llm import hard_negatives, html_text, kneser_ney, masked_lm, mixing, ngram_join, order_minhash, packing, passages, quality_rules, resampling, simhash, toxicity
from marginalia.storage import table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents")).drop("_k", "_copy", "_copies")


def op3_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.edit_sensitivity(table(spark, sf_dir, "documents"))


def op4_masked_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masked_lm.score(table(spark, sf_dir, "documents"))


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(table(spark, sf_dir, "documents")).drop("tag")


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser_ney.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), per_language=None)


def op11_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_groups(table(spark, sf_dir, "documents"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(rows.withColumn("label", moved), F.col("vec_id") % 50 == 0)


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_toxicity": op1_toxicity,
        "op2_best_fit_packing": op2_best_fit_packing,
        "op3_order_minhash": op3_order_minhash,
        "op4_masked_lm": op4_masked_lm,
        "op5_source_mixing": op5_source_mixing,
        "op6_html_extraction": op6_html_extraction,
        "op7_quality_rules": op7_quality_rules,
        "op8_substring_dedup": op8_substring_dedup,
        "op9_simhash_near_dedup": op9_simhash_near_dedup,
        "op10_kneser_ney": op10_kneser_ney,
        "op11_ngram_jaccard_join": op11_ngram_jaccard_join,
        "op12_hard_negatives": op12_hard_negatives,
        "op13_importance_resampling": op13_importance_resampling,
    }


def _quality_sql() -> str:
    """The counts and the table of rules of op7 for DuckDB; rows are told apart by number, for ids may repeat."""
    gap = "[\\x20\\x09-\\x0D]"
    stop = ", ".join(f"'{w}'" for w in dict.fromkeys(quality_rules.STOP_WORDS))
    breach = [f"(n_words >= {r.at_least} AND ({' OR '.join(f'{r.metric} {op} {x}' for op, x in (('<', r.low), ('>', r.high)) if x is not None)}))" for r in quality_rules.RULES]
    return (
        f"WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents), "
        f"w AS (SELECT *, list_filter(string_split_regex(t, '{gap}'), lambda x: x <> '') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM d), "
        "g AS (SELECT r, i, list_slice(w, i, i + 4) AS g FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM w)), "
        "c AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM g) WHERE n > 1), "
        "p AS (SELECT r, count(DISTINCT i + k) AS covered FROM c, (SELECT unnest(range(0, 5)) AS k) GROUP BY r), "
        "m AS (SELECT w.r, doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, len(l) AS n_lines, "
        "len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(covered, 0) AS n_repeat_words, len(list_filter(l, lambda x: regexp_matches(x, '(\\.\\.\\.|…)\\s*$'))) AS dots, "
        f"len(list_filter(l, lambda x: regexp_matches(x, '^\\s*[-•*●–]\\s'))) AS bullets, len(list_intersect(list_distinct(w), [{stop}])) AS stop_words FROM w LEFT JOIN p ON w.r = p.r), "
        "x AS (SELECT *, word_chars / greatest(n_words, 1) AS mean_word_chars, n_symbols / greatest(n_words, 1) AS symbols_per_word, n_dup_lines / greatest(n_lines, 1) AS dup_line_ratio, "
        "dots / greatest(n_lines, 1) AS ellipsis_line_ratio, bullets / greatest(n_lines, 1) AS bullet_line_ratio, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m) "
        f"SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT (base_failed OR {' OR '.join(breach)}) AS kept FROM x"
    )


def _join_sql() -> str:
    """op11 for DuckDB, by all pairs that share a shingle."""
    upper, lower, w = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", ngram_join.WIDTH
    return (
        f"WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{upper}', '{lower}'), '[\\x20\\x09-\\x0D]'), lambda x: x <> '') AS w FROM documents), "
        f"s AS (SELECT r, doc_id, CASE WHEN len(w) >= {w} THEN list_distinct(list_transform(range(1, len(w) - {w - 2}), lambda i: array_to_string(w[i:i + {w - 1}], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM d), "
        "t AS (SELECT r, len(s) AS n, unnest(s) AS t FROM s), "
        f"p AS (SELECT a.r AS a, b.r AS b FROM t a JOIN t b ON a.t = b.t AND a.r < b.r GROUP BY a.r, b.r, a.n, b.n HAVING {ngram_join.PART[1]} * count(*) >= {ngram_join.PART[0]} * (a.n + b.n - count(*))), "
        "e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p), c AS (SELECT r AS a, r AS b FROM s UNION SELECT c.a, e.b FROM c JOIN e ON c.b = e.a) "
        "SELECT x.doc_id, len(x.s) AS n_shingles, min(y.doc_id) AS component_id FROM s x JOIN c ON x.r = c.a JOIN s y ON c.b = y.r GROUP BY x.r, x.doc_id, len(x.s)"
    )


def _negatives_sql() -> str:
    """op12 for DuckDB, by all pairs of anchors and rows."""
    return (
        "WITH r AS (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * x::DOUBLE) AS BIGINT)) AS v FROM embeddings "
        "WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0), "
        "s AS (SELECT a.r, a.vec_id AS anchor_id, b.r AS other, b.vec_id, a.label = b.label AS same, CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2])) AS BIGINT) AS score "
        "FROM r a JOIN r b ON a.vec_id % 50 = 0 AND a.r <> b.r AND len(a.v) = len(b.v)), "
        f"p AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS place FROM s WHERE same QUALIFY place <= {hard_negatives.POSITIVES}), "
        "n AS (SELECT p.anchor_id, p.vec_id AS positive_id, CAST(row_number() OVER (PARTITION BY p.r, p.place ORDER BY s.score DESC, s.vec_id) AS INT) AS rank, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score "
        f"FROM p JOIN s ON p.r = s.r AND NOT s.same AND 100 * s.score BETWEEN {hard_negatives.LOW} * p.score AND {hard_negatives.HIGH} * p.score) SELECT * FROM n WHERE rank <= {hard_negatives.NEGATIVES}"
    )


def _resampling_sql() -> str:
    """op13 for DuckDB, with CRC-32 by its table of 256 states."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    found = f"regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    k = resampling.BUCKETS
    return (
        "WITH step AS (SELECT list(list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) ORDER BY n) AS tab FROM (SELECT unnest(range(256)) AS n)), "
        f"d AS (SELECT row_number() OVER () AS r, doc_id, {found} AS w FROM documents), b AS (SELECT {found} AS w FROM benchmark), "
        "dw AS (SELECT r, unnest(w) AS w FROM d), bw AS (SELECT unnest(w) AS w FROM b), v AS (SELECT DISTINCT w, hex(encode(w)) AS h FROM (SELECT w FROM dw UNION ALL SELECT w FROM bw)), "
        "y AS (SELECT w, list_prepend(4294967295, list_transform(range(len(h) // 2), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT))) AS y FROM v), "
        f"c AS (SELECT w, xor(list_reduce(y, lambda c, x: xor(tab[(xor(c, x) & 255) + 1], c >> 8)), 4294967295) % {k} AS bucket FROM y, step), "
        "s AS (SELECT bucket, count(*) AS s FROM dw JOIN c USING (w) GROUP BY 1), t AS (SELECT bucket, count(*) AS t FROM bw JOIN c USING (w) GROUP BY 1), "
        "al AS (SELECT (SELECT coalesce(sum(s), 0) FROM s) AS s_all, (SELECT coalesce(sum(t), 0) FROM t) AS t_all), "
        f"g AS (SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0)::DOUBLE + 1) * (s_all + {k}) / ((s::DOUBLE + 1) * (t_all + {k})))) AS BIGINT) AS gain FROM s LEFT JOIN t USING (bucket), al), "
        "w AS (SELECT r, sum(gain) AS weight FROM dw JOIN c USING (w) JOIN g USING (bucket) GROUP BY 1), "
        "x AS (SELECT doc_id, len(w) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight FROM (SELECT d.r, doc_id, d.w, weight FROM d LEFT JOIN w ON d.r = w.r)), "
        f"z AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('{resampling.SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM x), "
        f"k AS (SELECT *, row_number() OVER (PARTITION BY n_features >= {resampling.LEAST_WORDS} ORDER BY score DESC, doc_id NULLS LAST) AS place, count(*) FILTER (WHERE n_features >= {resampling.LEAST_WORDS}) OVER () AS n FROM z) "
        f"SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= {resampling.LEAST_WORDS} AND place <= {resampling.PERCENT} * n // 100 THEN place END AS rank FROM k"
    )


def oracle_sql() -> dict[str, str]:
    """SQL for the queries that SQL can express; seeded hashes of 64 bits, training and permutations have none."""
    return {"op7_quality_rules": _quality_sql(), "op11_ngram_jaccard_join": _join_sql(), "op12_hard_negatives": _negatives_sql(), "op13_importance_resampling": _resampling_sql()}
