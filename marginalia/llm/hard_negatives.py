"""Hard negatives: exact windowed top-k search of inner products by the threshold algorithm over sorted lists, in blocks of rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from marginalia.storage import materialise

#: Rows of a block on average, whose sorted lists one task holds at a time.
BLOCK = 4096
SCALE, POSITIVES, NEGATIVES = 256, 5, 3
#: A negative's score lies between these hundredths of the positive's.
LOW, HIGH = 50, 95
LINK = pa.schema([("anchor", pa.int64()), ("slot", pa.int32()), ("found_id", pa.int64()), ("score", pa.int64())])


def quantised(vector: Column) -> Column:
    """Components times 256, rounded down."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE).cast("long"))


def usable(label: Column, vector: Column) -> Column:
    finite = lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf")))
    return label.isNotNull() & vector.isNotNull() & F.coalesce(F.forall(vector, finite), F.lit(False))


class SortedLists:
    """A block's rows with, for each dimension, the list of rows by falling value; rows are read in order or by number only."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, rows: np.ndarray, labels: np.ndarray) -> None:
        if not vectors.shape[1]:
            vectors = np.zeros((len(vectors), 1), vectors.dtype)
        self.ids, self.rows, self.labels, self.dims = ids, rows, labels, vectors.shape[1]
        order = np.argsort(vectors, axis=0, kind="stable").T
        self.order = np.concatenate([order[:, ::-1], order])  # dimension d falling at d, rising at dims + d
        largest = int(np.abs(vectors).max(initial=0))
        self.limit = (2**53 - 1) // max(1, largest * self.dims)  # components of an anchor up to which sums in doubles are exact
        self.vectors, self.doubles = vectors, vectors.astype(np.float64)

    def scores(self, at: np.ndarray, anchor: np.ndarray) -> np.ndarray:
        """Exact integer inner products of the rows numbered ``at`` (random access); beyond 64 bits the nearest bound."""
        if int(np.abs(anchor).max(initial=0)) <= self.limit:
            return (self.doubles[at] @ anchor.astype(np.float64)).astype(np.int64)
        whole = self.vectors[at].astype(object) @ anchor.astype(object)
        return np.array([max(-(2**63), min(2**63 - 1, int(x))) for x in whole], np.int64)


def best_in_windows(block: SortedLists, anchor: np.ndarray, allowed: np.ndarray, windows: list[tuple[int, int]], k: int) -> list[np.ndarray]:
    """For each window (lowest, highest score) the numbers and scores of the ``k`` best allowed rows in it, ties by the smaller id.

    Lists are read from the side that the anchor's sign asks for, all to one depth, which grows fourfold. A row is
    scored when a list shows it first. No row that no list has shown can score more than the threshold, the inner
    product of the anchor with the values that the lists stand at; a window is done once that is strictly below its
    k-th best score, or below its lowest. Reading ends when all windows are done, or when every row was seen.
    """
    if len(anchor) != block.dims:
        anchor = np.zeros(block.dims, np.int64)
    sign = anchor < 0
    read = np.flatnonzero(anchor) if anchor.any() else np.zeros(1, np.int64)
    lists = read + block.dims * sign[read]
    n = len(block.ids)
    seen = np.zeros(n, bool)
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in windows]
    live = list(range(len(windows)))
    depth, left = 0, n
    while live and left:
        to = min(n, max(16, n // 64) if not depth else 4 * depth)
        shown = np.zeros(n, bool)
        shown[block.order[lists, depth:to]] = True
        new = np.flatnonzero(shown & ~seen)
        seen |= shown
        left -= len(new)
        depth = to
        new = new[allowed[new]]
        scores = block.scores(new, anchor)
        front = block.vectors[block.order[lists, depth - 1], read]
        threshold = sum(int(a) * int(x) for a, x in zip(anchor[read], front))
        still = []
        for i in live:
            low, high = windows[i]
            inside = (scores >= low) & (scores <= high)
            at, of = np.concatenate([found[i][0], new[inside]]), np.concatenate([found[i][1], scores[inside]])
            if len(at) > k:
                least = np.partition(of, -k)[-k]
                at, of = at[of >= least], of[of >= least]
                best = np.lexsort((block.ids[at], -of))[:k]
                at, of = at[best], of[best]
            found[i] = at, of
            if not (threshold < low or len(at) >= k and threshold < of.min()):
                still.append(i)
        live = still
    return found


def _matrix(column: pa.ListArray) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1) if len(column) else values.reshape(0, 0)


def _search(batches: Iterator[pa.RecordBatch], k: int, same: bool) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (block, kind): a block's rows, then the anchors that search it, which stream past it."""
    now, held, block = None, [], None
    for batch in batches:
        keys, kinds = batch.column("block").to_numpy(), batch.column("kind").to_numpy()
        cuts = np.flatnonzero((keys[1:] != keys[:-1]) | (kinds[1:] != kinds[:-1])) + 1
        for start, end in zip([0, *cuts], [*cuts, len(keys)]):
            if start == end:
                continue
            part = batch.slice(start, end - start)
            if keys[start] != now:
                now, held, block = keys[start], [], None
            if kinds[start] == 0:
                held.append(part)
                continue
            if not held:
                continue
            if block is None:
                rows = pa.Table.from_batches(held).combine_chunks()
                column = lambda c: rows.column(c).to_numpy()  # noqa: E731, B023
                v = rows.column("v").combine_chunks()
                block = SortedLists(_matrix(v), column("vec_id"), column("row"), column("label"))
            out: list[list] = [[], [], [], []]
            vectors = _matrix(part.column("v"))
            for i, (row, label, windows) in enumerate(zip(part.column("row").to_pylist(), part.column("label").to_pylist(), part.column("windows").to_pylist())):
                allowed = (block.labels == label) & (block.rows != row) if same else block.labels != label
                for slot, (at, of) in enumerate(best_in_windows(block, vectors[i], allowed, [(w["low"], w["high"]) for w in windows], k)):
                    for column_, values in zip(out, ([row] * len(at), [slot] * len(at), block.ids[at], of)):
                        column_.extend(values)
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(out, LINK)], schema=LINK)


def _searched(rows: DataFrame, anchors: DataFrame, k: int, same: bool) -> DataFrame:
    """(anchor, slot, found_id, score): for each anchor's windows the ``k`` best rows over all blocks it searches."""
    columns = ["block", "kind", "row", "vec_id", "label", "v", "windows"]
    none = F.array().cast("array<struct<low:bigint,high:bigint>>")
    every = rows.withColumns({"kind": F.lit(0), "windows": none}).select(columns).unionByName(anchors.withColumn("kind", F.lit(1)).select(columns))
    dealt = every.repartition("block").sortWithinPartitions("block", "kind")
    found = dealt.mapInArrow(lambda b: _search(b, k, same), "anchor long, slot int, found_id long, score long")
    best = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "found_id")
    return found.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k)


def _blocks(size: Column) -> Column:
    return F.ceil(size / BLOCK).cast("int")


def mine(
    vectors: DataFrame, anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", positives: int = POSITIVES, negatives: int = NEGATIVES,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of the anchors that ``anchor`` marks.

    A score is the inner product of quantised vectors. Each anchor's positives are its best other rows of its label;
    for each of these, the negatives are the best rows of other labels whose score lies between LOW and HIGH hundredths
    of the positive's. Ties go to the smaller id. ``anchor`` is an expression over the columns vec_id and label.

    Anchors search all rows, in blocks: positives in blocks of one label, negatives in blocks of any. A label with
    many rows has many blocks, so no block grows with the table. A block's rows are in one task with their sorted
    lists, anchors stream past, and each anchor's best few of every block are ranked.

    Rows with a null id, label, vector or component, or one that isn't finite, take no part. Rows that repeat an id
    are rows of their own, each other's positives. Only vectors of one length are compared; empty ones score 0.
    Other columns are ignored, whatever their names; an empty table gives an empty result.
    """
    own = lambda c: F.col(f"`{c}`")
    good = vectors.where(own(id_col).isNotNull() & usable(own(label_col), own(vector_col)))
    rows = good.select(own(id_col).cast("long").alias("vec_id"), own(label_col).cast("long").alias("label"), quantised(own(vector_col)).alias("v"))
    rows = materialise(rows.withColumns({"row": F.monotonically_increasing_id(), "dim": F.size("v")}))
    marked = rows.where(F.coalesce(anchor, F.lit(False)))
    by_label = rows.groupBy("dim", "label").agg(F.count("*").alias("size"))
    by_dim = rows.groupBy("dim").agg(F.count("*").alias("size"))

    def dealt(keys: list[str], sizes: DataFrame) -> tuple[DataFrame, Column]:
        of = F.hash(F.col("row"), F.lit(7))
        key = lambda number: F.xxhash64(F.lit(len(keys)), *keys, number)
        return rows.join(sizes, keys).withColumn("block", key(F.pmod(of, _blocks(F.col("size"))))).drop("size"), key

    def sent(some: DataFrame, keys: list[str], sizes: DataFrame, key) -> DataFrame:
        return some.join(sizes, keys).withColumn("number", F.explode(F.sequence(F.lit(0), _blocks(F.col("size")) - 1))).withColumn("block", key(F.col("number"))).drop("size", "number")

    all_of = F.array(F.struct(F.lit(-(2**63)).alias("low"), F.lit(2**63 - 1).alias("high")))
    blocks, key = dealt(["dim", "label"], by_label)
    near = _searched(blocks, sent(marked.withColumn("windows", all_of), ["dim", "label"], by_label, key), positives, same=True)
    near = materialise(near.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("place", F.col("found_id").alias("id"), "score"))).alias("near")))  # a few of each

    p = lambda x: x["score"].cast("decimal(38,0)")
    window = lambda x: F.struct(F.ceil(p(x) * LOW / 100).cast("long").alias("low"), F.floor(p(x) * HIGH / 100).cast("long").alias("high"))
    asking = marked.join(near, F.col("row") == F.col("anchor")).withColumn("windows", F.transform("near", window))
    blocks, key = dealt(["dim"], by_dim)
    far = _searched(blocks, sent(asking.drop("near", "anchor"), ["dim"], by_dim, key), negatives, same=False)
    named = far.join(marked.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id")), "anchor").join(near, "anchor")
    positive = F.col("near")[F.col("slot")]
    return named.select(
        "anchor_id", positive["id"].alias("positive_id"), F.col("place").cast("int").alias("rank"), F.col("found_id").alias("negative_id"), positive["score"].alias("positive_score"),
        F.col("score").alias("negative_score"),
    )
