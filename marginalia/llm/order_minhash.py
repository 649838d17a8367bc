"""Order MinHash fingerprints: likeness that falls with edits and with moved text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from marginalia.llm.words import words
from marginalia.storage import materialise

#: Words in a k-mer, and how many order-keeping tuples make a fingerprint.
K = 5
TUPLES = 32
#: Low bits of a packed minimum hold the place in the text, the bits above hold the hash.
PLACE_BITS = 26
PLACE = (1 << PLACE_BITS) - 1
#: Ids that are ordered together to find each one's successor, and the least and most ranges that they are dealt into.
PER_RANGE, RANGES = 1_000_000, (64, 1024)


def occurrence_numbered(texts: DataFrame, key: list[str], text_col: str, k: int = K) -> DataFrame:
    """``key`` and ``_occ``: for each word k-mer in text order a hash of it and of how often it came before.

    A text of fewer words is one k-mer, a text of none has none. Only texts that repeat a k-mer are sorted.
    """
    step = texts.select(*key, F.transform(words(F.col(text_col)), lambda x: F.xxhash64(x)).alias("_h"))
    h = F.col("_h")
    grams = F.transform(F.sequence(F.lit(0), F.size(h) - k), lambda i: F.xxhash64(*(h[i + j] for j in range(k))))
    whole = F.when(F.size(h) > 0, F.array(F.xxhash64(h))).otherwise(F.array().cast("array<bigint>"))
    step = step.select(*key, F.when(F.size(h) >= k, grams).otherwise(whole).alias("_g"))
    g = F.col("_g")
    ordered = F.sort_array(F.transform(g, lambda x, i: F.struct(x.alias("g"), i.alias("i"))))
    step = step.withColumn("_s", F.when(F.size(F.array_distinct(g)) < F.size(g), ordered))
    s = F.col("_s")
    heads = F.filter(F.transform(s, lambda x, i: F.when((i == 0) | (F.get(s, i - 1)["g"] != x["g"]), i)), lambda i: i.isNotNull())
    step = step.withColumn("_f", F.when(s.isNotNull(), heads))
    f = F.col("_f")
    runs = F.transform(f, lambda at, j: F.slice(s, at + 1, F.coalesce(F.get(f, j + 1), F.size(s)) - at))
    placed = F.flatten(F.transform(runs, lambda run: F.transform(run, lambda x, n: F.struct(x["i"].alias("i"), F.xxhash64(x["g"], n).alias("h")))))
    numbered = F.transform(F.sort_array(placed), lambda x: x["h"])
    return step.select(*key, F.when(s.isNotNull(), numbered).otherwise(F.transform(g, lambda x: F.xxhash64(x, F.lit(0)))).alias("_occ"))


def fingerprints(texts: DataFrame, key: list[str], text_col: str = "text", k: int = K, tuples: int = TUPLES) -> DataFrame:
    """``key`` and ``fingerprint`` of every row; the columns of ``key`` tell all rows apart.

    For each of ``tuples`` hash functions one bit of the hash deals the occurrence-numbered k-mers into two
    classes, and the least k-mer of either class is selected. The two keep their order in the text; the hash of
    that ordered pair, 8 hex digits, is one entry of the fingerprint. K-mers are exploded and reduced to minima
    of packed longs, in one task if ``texts`` comes partitioned by some of ``key``.
    """
    rows = occurrence_numbered(texts, key, text_col, k).select(*key, F.posexplode_outer("_occ").alias("_i", "_x"))
    at = F.least("_i", F.lit(PLACE)).cast("long").alias("_at")
    rows = rows.select(*key, at, *(F.xxhash64("_x", F.lit(t)).alias(f"_y{t}") for t in range(tuples)))

    def least(t: int, side: int) -> Column:
        y = F.col(f"_y{t}")
        packed = y.bitwiseAND(F.lit(~PLACE)).bitwiseOR(F.col("_at"))  # null where a text has no k-mer
        return F.min(F.when(y.bitwiseAND(F.lit(1)) == side, packed))

    def entry(t: int) -> Column:
        a, b = F.col(f"_a{t}"), F.col(f"_b{t}")
        up = [F.coalesce(F.shiftright(x, PLACE_BITS), F.lit(0).cast("long")) for x in (a, b)]
        first = F.coalesce(a.bitwiseAND(F.lit(PLACE)) < b.bitwiseAND(F.lit(PLACE)), a.isNotNull())
        pair = F.when(first, F.xxhash64(*up, F.lit(0))).otherwise(F.xxhash64(*reversed(up), F.lit(1)))
        return F.lpad(F.lower(F.hex(pair.bitwiseAND(F.lit(0xFFFFFFFF)))), 8, "0")

    found = rows.groupBy(*key).agg(*(least(t, side).alias(f"_{name}{t}") for t in range(tuples) for side, name in enumerate("ab")))
    return found.select(*key, F.concat(*(entry(t) for t in range(tuples))).alias("fingerprint"))


def likeness(a: Column, b: Column, tuples: int = TUPLES) -> Column:
    """The share of entries that two fingerprints have in common (0 to 1)."""
    same = F.filter(F.sequence(F.lit(0), F.lit(tuples - 1)), lambda t: F.substr(a, 8 * t + 1, F.lit(8)) == F.substr(b, 8 * t + 1, F.lit(8)))
    return F.size(same) / F.lit(float(tuples))


def successors(ids: DataFrame, key: str) -> DataFrame:
    """(key, next): the next larger of the distinct non-null keys; after the last comes the first.

    Keys are dealt into ranges between quantiles and ordered inside their range; the last of a range looks to
    the first of the next range that has any. Only that step goes over one partition, of one row a range.
    """
    keys = ids.select(key).where(F.col(key).isNotNull()).distinct()
    ranges = min(RANGES[1], max(RANGES[0], keys.count() // PER_RANGE))
    cuts = keys.agg(F.percentile_approx(key, [i / ranges for i in range(1, ranges)], 10_000).alias("cuts")).first()["cuts"] or []
    bounds = F.array(*(F.lit(c).cast("long") for c in sorted(set(cuts)))).cast("array<bigint>")
    keys = keys.withColumn("_part", F.size(F.filter(bounds, lambda c: c <= F.col(key))))
    inside = keys.withColumn("_next", F.lead(key).over(Window.partitionBy("_part").orderBy(key)))
    heads = keys.groupBy("_part").agg(F.min(key).alias("_head"))
    after = F.coalesce(F.lead("_head").over(Window.orderBy("_part")), F.min("_head").over(Window.partitionBy()))
    return inside.join(F.broadcast(heads.select("_part", after.alias("_after"))), "_part").select(key, F.coalesce("_next", "_after").alias("next"))


def edit_sensitivity(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, tuples: int = TUPLES) -> DataFrame:
    """Fingerprints of each text, of an edited form of it, and their likeness to each other and to the next document's.

    The edited form has its last floor(n/4) of n code points replaced by the first as many (or all) of the next
    document by id; after the last comes the first. Returns doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next.

    Null texts are empty, and empty texts have equal fingerprints. Rows with a null id have no next document:
    nothing replaces what they lose, near_next is 0. Rows that repeat an id all stay; the next document of an id
    that repeats is its row with the smallest text hash. Extra columns of any name are ignored, an empty table gives
    none. Beyond 2 ** 26 k-mers of one text, places are no longer told apart.
    """
    name, text = F.col(f"`{id_col}`").cast("long"), F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    spot = Window.partitionBy("doc_id", "_null").orderBy(F.xxhash64("text"))
    own = docs.select(F.coalesce(name, F.xxhash64(text)).alias("doc_id"), name.isNull().alias("_null"), text.alias("text"))  # null ids spread over the texts
    base = own.withColumn("_row", F.row_number().over(spot))
    sizes = materialise(docs.select(name.alias("doc_id"), F.length(text).alias("n")).where("doc_id is not null").groupBy("doc_id").agg(F.max("n").alias("n")))
    after = materialise(successors(sizes, "doc_id"))
    # what is never true is written so that no limit is put below the exchange of the texts, which is then one for both uses
    wants = sizes.join(after, "doc_id").select(F.col("next").alias("doc_id"), (F.col("n") < 0).alias("_null"), F.col("doc_id").alias("_for"), F.expr("n div 4").cast("int").alias("_n"))
    lent = base.where("2 * _row = 2").join(wants.hint("merge"), ["doc_id", "_null"]).select(F.col("_for").alias("doc_id"), (F.col("_n") < 0).alias("_null"), F.expr("substring(text, 1, _n)").alias("_lent"))
    n, quarter = F.length("text"), F.expr("length(text) div 4").cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - quarter), F.substring(F.coalesce("_lent", F.lit("")), F.lit(1), quarter))
    both = base.join(lent.hint("merge"), ["doc_id", "_null"], "left").select("doc_id", "_null", "_row", n.cast("long").alias("n_chars"), "text", edited.alias("edited"))
    both = both.withColumn("edited_sha256", F.sha2("edited", 256))
    forms = F.explode(F.array(F.struct(F.lit(0).alias("form"), F.col("text").alias("text")), F.struct(F.lit(1).alias("form"), F.col("edited").alias("text"))))
    forms = both.select("doc_id", "_null", "_row", "n_chars", "edited_sha256", forms.alias("_f")).select("doc_id", "_null", "_row", "n_chars", "edited_sha256", "_f.form", "_f.text")
    own = ["doc_id", "_null", "_row", "n_chars", "edited_sha256"]
    prints = fingerprints(forms, [*own, "form"], "text", k, tuples).groupBy(*own).agg(
        F.max(F.when(F.col("form") == 0, F.col("fingerprint"))).alias("fingerprint"), F.max(F.when(F.col("form") == 1, F.col("fingerprint"))).alias("edited_fingerprint")
    )
    prints = materialise(prints)
    nexts = prints.where("_row = 1 and not _null").select(F.col("doc_id").alias("next"), F.col("fingerprint").alias("_next")).join(after.withColumnRenamed("doc_id", "_for"), "next").select("_for", "_next")
    out = prints.join(nexts, (F.col("doc_id") == F.col("_for")) & ~F.col("_null"), "left")
    return out.select(
        F.when(~F.col("_null"), F.col("doc_id")).alias("doc_id"), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint"), tuples).alias("near_edited"),
        F.coalesce(likeness(F.col("fingerprint"), F.col("_next"), tuples), F.lit(0.0)).alias("near_next"),
    )
