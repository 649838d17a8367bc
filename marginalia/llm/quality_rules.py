"""Quality rules: one table of thresholds, compiled into a single projection of built-in expressions."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from marginalia.llm.words import words

#: Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "the be to of and that have with a in is it for as was are on by this from or an at not "
    "le la les de des et un une du que qui en dans est pour pas par au sur avec "
    "der die das und ein eine den dem von zu mit ist im nicht auf sich für als "
    "el los las y que del se una por con no su para es al lo"
).split()


class Rule(NamedTuple):
    """A document breaks a rule if ``metric`` is under ``low`` or over ``high``; texts under ``at_least`` words are exempt."""

    metric: str
    low: float | None
    high: float | None
    at_least: int = 10


#: Lenient on purpose: prose of any language passes, tables, symbol soup and repeated lines do not.
RULES = (
    Rule("mean_word_chars", 2.0, 14.0),
    Rule("symbols_per_word", None, 0.2),
    Rule("dup_line_ratio", None, 0.5),
    Rule("ellipsis_line_ratio", None, 0.5),
    Rule("bullet_line_ratio", None, 0.9),
    Rule("stop_words", 1.0, None, 100),
)


def verdict(rules: tuple[Rule, ...] = RULES, n_words: str = "n_words") -> Column:
    """True if every rule holds."""
    ok = F.lit(True)
    for r in rules:
        breach = F.lit(False)
        if r.low is not None:
            breach = breach | (F.col(r.metric) < r.low)
        if r.high is not None:
            breach = breach | (F.col(r.metric) > r.high)
        ok = ok & ((F.col(n_words) < r.at_least) | ~breach)
    return ok


def metrics(docs: DataFrame, text_col: str = "text", window: int = 5) -> DataFrame:
    """``docs`` with the base counts and the ratios of the rules.

    Null and empty texts count as no words. Each step is a projection over the one before, so that nothing is
    computed twice; windows are told apart by 64-bit hashes of their words, and only texts with a repeated
    window are sorted to find the words that such windows cover.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = docs.columns
    w, n = F.col("_w"), F.col("n_words")
    step = docs.withColumns({"_w": words(F.col(text_col)), "_l": F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))})
    stop = F.array(*(F.lit(x) for x in dict.fromkeys(STOP_WORDS)))
    step = step.select(
        *own,
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.size("_l").cast("long").alias("n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter("_l", lambda x: x.rlike("(\\.\\.\\.|…)\\s*$"))).alias("_ellipsis"),
        F.size(F.filter("_l", lambda x: x.rlike("^\\s*[-•*●–]\\s"))).alias("_bullet"),
        F.size(F.array_intersect("_w", stop)).alias("stop_words"),
        F.transform(w, lambda x: F.xxhash64(x)).alias("_h"),
    )
    h = F.col("_h")
    grams = F.transform(F.sequence(F.lit(0), F.size(h) - window), lambda i: F.xxhash64(*(h[i + k] for k in range(window))))
    step = step.withColumn("_g", F.when(F.size(h) >= window, grams).otherwise(F.array().cast("array<bigint>"))).drop("_h")
    g = F.col("_g")
    ordered = F.sort_array(F.transform(g, lambda x, i: F.struct(x.alias("g"), i.alias("i"))))
    step = step.withColumn("_s", F.when(F.size(F.array_distinct(g)) < F.size(g), ordered)).drop("_g")
    s = F.col("_s")
    twice = F.filter(s, lambda x, i: ((i > 0) & (F.get(s, i - 1)["g"] == x["g"])) | F.coalesce(F.get(s, i + 1)["g"] == x["g"], F.lit(False)))
    step = step.withColumn("_p", F.when(s.isNotNull(), F.sort_array(F.transform(twice, lambda x: x["i"])))).drop("_s")
    first = F.struct(F.lit(-window).alias("at"), F.lit(0).alias("n"))
    covered = F.aggregate("_p", first, lambda a, p: F.struct(p.alias("at"), (a["n"] + F.least(F.lit(window), p - a["at"])).alias("n")), lambda a: a["n"])
    some, lines = F.greatest(n, F.lit(1)), F.greatest(F.col("n_lines"), F.lit(1))
    return step.select(
        *own,
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        (F.col("word_chars") / some).alias("mean_word_chars"),
        (F.col("n_symbols") / some).alias("symbols_per_word"),
        (F.col("n_dup_lines") / lines).alias("dup_line_ratio"),
        (F.col("_ellipsis") / lines).alias("ellipsis_line_ratio"),
        (F.col("_bullet") / lines).alias("bullet_line_ratio"),
        F.col("stop_words").cast("double").alias("stop_words"),
    )


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per document: id, the base counts, base_failed and kept.

    base_failed: fewer than 10 words, or over a fifth of the words in 5-word windows that the text repeats.
    kept: not base_failed, and every rule holds. Null texts have no words and fail; null ids, repeated rows and
    extra columns (ignored) change nothing; an empty table gives an empty result.
    """
    measured = metrics(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))).drop("text")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return measured.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & verdict(rules)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", *(r.metric for r in rules)
    )


def keep_good(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of ``docs`` that the rules keep, all columns as they were, in one pass without a shuffle."""
    inner = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), F.col(f"`{text_col}`").alias("_text"))
    measured = metrics(inner, "_text")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    # a filter on these columns would be pushed below the steps that make them, each spelled out again wherever
    # it is used; a column that is no function of its row keeps it where it is
    good = measured.select("_row", (~failed & verdict(rules)).alias("_good"), F.spark_partition_id().alias("_part"))
    return good.where("_good and _part >= 0").select("_row.*")
