"""A map of people by their words: sparse TF-IDF rows, leading eigenvectors by block iteration, spherical k-means, newcomers placed."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from marginalia.storage import materialise

#: Words that say nothing of a person's subject, and what is no word at all (links, named links, handles).
STOP = (
    "the a an and or of to in on for is it this that with as at by be are was i you we they my our your from not but have has just so if what all can will more about like do no one get "
    "how its it's im i'm don't me he she his her their them out up new now than then there here when who which would been were also into only very much any some these those amp rt"
).split()
NO_WORDS = r"https?://\S+|\[[^\]]*\]\([^)]*\)|@\w+"
#: People that use a word at least, the share of all that use it at most, words and dimensions of the map, groups, people a group, rounds and starts.
USERS, SHARE, MOST_WORDS, DIMS, GROUPS, PER_GROUP, ROUNDS, STARTS = 5, 0.3, 6000, 50, 40, 25, 50, 10
WORDS_SHOWN, CENTRAL_SHOWN = 8, 5
#: Rounds of the block iteration, and columns beyond the dimensions asked for.
POWER, SPARE = 12, 10


def tokens(text: Column) -> Column:
    """A person's words: lower case, three characters or more, without links, handles and stop words."""
    found = F.regexp_extract_all(F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), NO_WORDS, " ")), F.lit(r"[a-z][a-z0-9\-]{2,}"), F.lit(0))
    return F.filter(found, lambda w: ~w.isin(*STOP))


def _counts(texts: DataFrame, person: str, text: str) -> DataFrame:
    return texts.where(F.col(person).isNotNull()).select(F.col(person).alias("person"), F.explode(tokens(F.col(text))).alias("word")).groupBy("person", "word").agg(F.count("*").alias("tf"))


def _unit_rows(rows: DataFrame, person: str = "person") -> DataFrame:
    """(person, at, x) with every person's row of length one; people whose row is empty or zero aren't there."""
    norm = F.sqrt(F.sum(F.col("x") * F.col("x")).over(Window.partitionBy(person)))
    return rows.withColumn("_n", norm).where("_n > 0").withColumn("x", F.col("x") / F.col("_n")).drop("_n")


def _packed(rows: DataFrame) -> DataFrame:
    """(person, at, x): each person's row as two arrays, in the order of ``at``."""
    entries = F.array_sort(F.collect_list(F.struct("at", "x")))  # a person's distinct words of the map, at most MOST_WORDS
    return rows.groupBy("person").agg(entries.alias("e")).select("person", F.col("e.at").alias("at"), F.col("e.x").alias("x"))


def _dense(batch, width: int) -> np.ndarray:
    out = np.zeros((batch.num_rows, width))
    for i, (at, x) in enumerate(zip(batch.column("at").to_pylist(), batch.column("x").to_pylist())):
        out[i, at] = x
    return out


def _summed(rows: DataFrame, of, shape: tuple[int, int]) -> np.ndarray:
    """The sum over all people of ``of(X)``, X some of their rows: tasks add up their own matrix, and one of that shape for each task is added."""

    def run(batches):
        import pyarrow as pa

        total = np.zeros(shape)
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                total += of(_dense(batch.slice(start, 512), shape[0]))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(shape[0])), pa.array(list(total))], ["at", "row"])

    parts = rows.mapInArrow(run, "at long, row array<double>").select("at", F.posexplode("row").alias("j", "v"))
    out = np.zeros(shape)
    sums = parts.groupBy("at", "j").agg(F.sum(F.col("v").cast("decimal(38,18)")).cast("double").alias("v")).toArrow()  # exact, so the order of tasks doesn't matter
    out[sums["at"].to_numpy(), sums["j"].to_numpy()] = sums["v"].to_numpy()
    return out


def leading(rows: DataFrame, words: int, dims: int, seed: int = 0) -> np.ndarray:
    """The ``dims`` leading right singular vectors (words x dims) of the people's rows, by block power iteration.

    Every round multiplies the rows with a block of vectors that all tasks get, words x (dims + SPARE), and adds up
    what comes back; no matrix of people by people or of words by words is made.
    """
    block = min(words, dims + SPARE)
    v, _ = np.linalg.qr(np.random.Generator(np.random.PCG64(seed)).standard_normal((words, block)))
    for _ in range(POWER):
        v, _ = np.linalg.qr(_summed(rows, lambda x, v=v: x.T @ (x @ v), (words, block)))
    small = v.T @ _summed(rows, lambda x, v=v: x.T @ (x @ v), (words, block))
    values, turn = np.linalg.eigh((small + small.T) / 2)
    top = v @ turn[:, ::-1][:, :dims]
    return top * np.where(top[np.abs(top).argmax(0), np.arange(top.shape[1])] < 0, -1.0, 1.0)


def _placed(rows: DataFrame, v: np.ndarray) -> DataFrame:
    """(person, p): each row in the leading dimensions, of length one."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            p = _dense(batch, len(v)) @ v
            p = np.round(p / (np.linalg.norm(p, axis=1, keepdims=True) + 1e-9), 9)
            yield pa.RecordBatch.from_arrays([batch.column("person"), pa.array(list(p), None if len(p) else pa.list_(pa.float64()))], ["person", "p"])

    kind = dict(rows.dtypes)["person"]
    return rows.mapInArrow(run, f"person {kind}, p array<double>")


def _nearest(places: DataFrame, centres: np.ndarray) -> DataFrame:
    """(person, p, group, near): the centre of largest cosine, the first of equals."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            cos = np.round(np.array(batch.column("p").to_pylist(), float).reshape(-1, centres.shape[1]) @ centres.T, 9)
            yield pa.RecordBatch.from_arrays([batch.column("person"), batch.column("p"), pa.array(cos.argmax(1)), pa.array(cos.max(1))], ["person", "p", "group", "near"])

    kind = dict(places.dtypes)["person"]
    return places.mapInArrow(run, f"person {kind}, p array<double>, group long, near double")


def _start(places: DataFrame, k: int, seed: int) -> np.ndarray:
    """k-means++ starts: each next one is drawn by the squared distance from those there are, as the least exponential draw divided by the weight."""
    picked: list[list[float]] = []
    for i in range(k):
        u = (F.pmod(F.xxhash64("person", F.lit(seed), F.lit(i)), F.lit(1 << 52)) + 1) / float(1 << 52)
        if picked:
            far = F.greatest(F.lit(0.0), 1 - F.col("near"))
            weighed = _nearest(places, np.array(picked)).withColumn("w", far * far).where("w > 0")
        else:
            weighed = places.withColumn("w", F.lit(1.0))
        row = weighed.orderBy(-F.log(u) / F.col("w"), "person").select("p").first()
        if row is None:
            break
        picked.append(row.p)
    return np.array(picked)


def clusters(places: DataFrame, k: int, starts: int = STARTS, rounds: int = ROUNDS) -> tuple[np.ndarray, DataFrame]:
    """The centres and (person, p, group, near) of spherical k-means: of some seeded starts the tightest end."""
    best = None
    for seed in range(starts):
        centres, fit = _start(places, k, seed), None
        for _ in range(rounds):
            sums = _nearest(places, centres).select("group", "near", F.posexplode("p").alias("d", "v")).groupBy("group", "d").agg(F.sum(F.col("v").cast("decimal(38,12)")).alias("v"), F.sum(F.when(F.col("d") == 0, F.col("near").cast("decimal(38,12)"))).alias("near")).collect()
            new, now = centres.copy(), sum(float(r.near) for r in sums if r.near is not None)  # groups x dimensions rows
            for g in {r.group for r in sums}:
                new[g] = 0
            for r in sums:
                new[r.group, r.d] = float(r.v)
            new = np.round(new / (np.linalg.norm(new, axis=1, keepdims=True) + 1e-9), 9)
            if fit is not None and now <= fit:
                break
            fit, centres = now, new
        if best is None or fit > best[0]:
            best = fit, centres
    return best[1], _nearest(places, best[1])


def people_map(
    texts: DataFrame, person: str, text: str, newcomers: DataFrame | None = None, users: int = USERS, share: float = SHARE, most: int = MOST_WORDS, dims: int = DIMS, starts: int = STARTS
) -> tuple[DataFrame, DataFrame | None]:
    """((person, group, near, place), and (person, group) of ``newcomers``): people grouped by what they write about.

    Words that ``users`` people use and no more than a ``share`` of them are weighed by (1 + ln tf) * ln(n / df), the
    ``most`` used ones; rows have length one and go to ``dims`` leading dimensions. Groups are numbered by size, the
    largest first, and ``place`` ranks a group's people from its centre outwards. A newcomer, placed by the same words
    and dimensions, gets the nearest group, or null without a word in common with anyone. The same texts give the
    same map. Null texts have no words, rows without a person don't count; people without a word of the map are in no group.
    """
    counts = materialise(_counts(texts, person, text))
    n = texts.select(person).where(F.col(person).isNotNull()).distinct().count()
    used = counts.groupBy("word").agg(F.count("*").alias("df")).where((F.col("df") >= users) & (F.col("df") <= share * n)).orderBy(F.desc("df"), "word").limit(most)
    words = used.select(F.row_number().over(Window.orderBy(F.desc("df"), "word")).alias("at"), "word", F.log(F.lit(float(n)) / F.col("df")).alias("idf"))
    words = materialise(words.withColumn("at", F.col("at") - 1))  # ``most`` rows
    width = words.count()
    weighed = lambda c: _unit_rows(c.join(F.broadcast(words), "word").select("person", "at", ((1 + F.log("tf")) * F.col("idf")).alias("x")))
    rows = materialise(_packed(weighed(counts)))
    held = rows.count()
    if not held:
        empty = rows.select("person", F.lit(None).cast("long").alias("group"), F.lit(None).cast("double").alias("near"), F.lit(None).cast("long").alias("place")).limit(0)
        return empty, newcomers and newcomers.select(F.col(person).alias("person"), F.lit(None).cast("long").alias("group")).distinct()
    v = leading(rows, width, min(dims, held, width))
    places = materialise(_placed(rows, v))
    centres, found = clusters(places, max(2, min(GROUPS, n // PER_GROUP)), starts)
    found = materialise(found)
    sizes = found.groupBy("group").count().orderBy(F.desc("count"), "group").collect()  # GROUPS rows at most
    number = F.create_map(*(F.lit(x) for i, r in enumerate(sizes) for x in (r.group, i)))
    outward = Window.partitionBy("group").orderBy(F.desc("near"), "person")
    ranked = found.select("person", "near", number[F.col("group")].cast("long").alias("group")).withColumn("place", F.row_number().over(outward).cast("long"))
    if newcomers is None:
        return ranked, None
    own = _nearest(_placed(_packed(weighed(_counts(newcomers, person, text))), v), centres)
    homes = own.select(F.col("person").alias("_p"), F.coalesce(number[F.col("group")], F.lit(-1)).cast("long").alias("group"))
    everyone = newcomers.select(F.col(person).alias("person")).distinct()
    return ranked, everyone.join(homes, F.col("person") == F.col("_p"), "left").select("person", F.nullif("group", F.lit(-1)).alias("group"))


def group_words(texts: DataFrame, person: str, text: str, groups: DataFrame, shown: int = WORDS_SHOWN) -> DataFrame:
    """(group, place, word): the words that a group's people use most above what all use, by the mean of their shares of words."""
    counts = _counts(texts, person, text)
    share = F.col("tf") / F.sum("tf").over(Window.partitionBy("person"))
    per = counts.withColumn("s", share.cast("decimal(20,15)")).join(groups.select("person", "group"), "person").groupBy("group", "word").agg(F.sum("s").alias("mass"), F.count("*").alias("users"))
    over = per.withColumn("of", F.col("mass").cast("double") * F.col("mass").cast("double") / F.sum("mass").over(Window.partitionBy("word")).cast("double"))
    place = F.row_number().over(Window.partitionBy("group").orderBy(F.round("of", 9).desc(), "word"))
    return over.withColumn("place", place.cast("long")).where(F.col("place") <= shown).select("group", "place", "word")
