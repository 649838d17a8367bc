"""Masked pseudo-likelihood: a bidirectional window network predicts every token from both of its sides."""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from marginalia.storage import materialise

#: Words are hashed to so many tokens; the token after the last one stands beyond either end of a text.
TOKENS = 1 << 14
#: Tokens by falling count make classes of so many; the network predicts the class, and in it the token.
IN_CLASS = 128
SIDE = 2
WIDTH = 12
HIDDEN = 32
#: Passes over the corpus, each of which learns the tokens at other places, one in EVERY; as many passes as EVERY learn all of them.
ROUNDS, EVERY = 4, 4
BATCH = 8192
RATE = 0.05
#: Rows that are worked on while they are in the processor's cache, and texts that are laid out together.
CLOSE, TEXTS = 1 << 10, 256
PLACES, ONES = np.arange(CLOSE), np.ones(max(IN_CLASS, TOKENS // IN_CLASS), np.float32)
#: Words whose tokens a task remembers at most.
REMEMBERED = 1 << 20
#: Parameters are averaged in so many slices, of so many partitions at a time.
SLICES, FAN_IN = 64, 32
#: How a token is kept in a table.
PACKED = np.dtype(np.min_scalar_type(TOKENS))


class Network(NamedTuple):
    """hidden = tanh(embedded window of both sides @ inner + bias); a class by hidden @ outer + bias, a token in it by hidden @ its column + bias."""

    embed: np.ndarray  # TOKENS + 1, WIDTH
    inner: np.ndarray  # 2 * SIDE * WIDTH, HIDDEN
    inner_bias: np.ndarray
    outer: np.ndarray  # HIDDEN, classes
    outer_bias: np.ndarray
    word: np.ndarray  # TOKENS, HIDDEN
    word_bias: np.ndarray


class Vocabulary(dict):
    """The token of every word asked for; forgets all of them when there are too many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = token = xxhash.xxh32_intdigest(word) % TOKENS
        return token


def _tokens(text: bytes | None, of: Vocabulary) -> np.ndarray:
    found = (text or b"").split()
    return np.fromiter(map(of.__getitem__, found), np.int32, len(found))


def tokens(text: str | None) -> np.ndarray:
    return _tokens((text or "").encode(), Vocabulary())


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def _tokenise(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    vocabulary = Vocabulary()
    for texts in batches:
        found = [_tokens(t, vocabulary) for t in texts.cast(pa.binary()).to_pylist()]
        ends = np.cumsum([0, *map(len, found)], dtype=np.int32)
        yield pa.ListArray.from_arrays(ends, np.concatenate([np.zeros(0, np.int32), *found]))


@F.arrow_udf(T.BinaryType())
def _packed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """The same tokens as bytes, which Spark copies whole."""
    vocabulary = Vocabulary()
    for texts in batches:
        yield pa.array([_tokens(t, vocabulary).astype(PACKED).tobytes() for t in texts.cast(pa.binary()).to_pylist()], pa.binary())


def unpacked(ids: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The tokens of all texts of a column, as numbers or as bytes, one after the other; the size of each text."""
    if not pa.types.is_binary(ids.type):
        return ids.flatten().to_numpy(), np.diff(ids.offsets.to_numpy())
    ends = np.frombuffer(ids.buffers()[1], np.int32)[ids.offset : ids.offset + len(ids) + 1]
    data = ids.buffers()[2]
    found = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]].view(PACKED) if data else np.zeros(0, PACKED)
    return found, np.diff(ends) // PACKED.itemsize


def laid(ids: pa.Array, number: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The renumbered tokens of all texts in one array, with SIDE tokens that stand beyond an end before, between and after them; where each text begins in it; its length."""
    found, sizes = unpacked(ids)
    begin = np.cumsum(sizes + SIDE) - sizes
    line = np.full(len(found) + SIDE * (len(sizes) + 1), TOKENS, np.int32)
    line[_runs(begin, sizes)] = number[found]
    return line, begin, sizes


def _runs(begin: np.ndarray, sizes: np.ndarray, step: int = 1) -> np.ndarray:
    """begin, begin + step, ... of each run, ``sizes`` numbers each."""
    return np.arange(int(sizes.sum())) * step + np.repeat(begin - (np.cumsum(sizes) - sizes) * step, sizes)


def _lines(texts: pa.Array, number: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The texts of a column laid out, some at a time."""
    for at in range(0, len(texts), TEXTS):
        yield laid(texts.slice(at, TEXTS), number)


def around(line: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The SIDE tokens before and after each of the places ``at`` of a line; the token there is masked."""
    return line[at[:, None] + np.r_[-SIDE:0, 1 : SIDE + 1]]


def windows(ids: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The same for the places of one text."""
    return around(np.pad(ids, SIDE, constant_values=TOKENS), at + SIDE)


def ranks(counts: np.ndarray) -> np.ndarray:
    """The place of each token by falling count; tokens are numbered by it from here on."""
    out = np.empty(TOKENS, np.int32)
    out[np.argsort(-counts, kind="stable")] = np.arange(TOKENS, dtype=np.int32)
    return out


def start(counts: np.ndarray, seed: int = 3) -> Network:
    """A network that predicts each token's share of the corpus whatever stands around it; a token counts one more than it was seen."""
    rng, classes = np.random.default_rng(seed), TOKENS // IN_CLASS
    n = np.sort(counts)[::-1].reshape(classes, IN_CLASS) + 1.0
    shares = np.log(n / n.sum(axis=1, keepdims=True)).reshape(-1), np.log(n.sum(axis=1) / n.sum())
    normal = lambda scale, *shape: rng.normal(0, scale, shape).astype(np.float32)
    return Network(
        normal(0.1, TOKENS + 1, WIDTH), normal(0.15, 2 * SIDE * WIDTH, HIDDEN), np.zeros(HIDDEN, np.float32), np.zeros((HIDDEN, classes), np.float32), shares[1].astype(np.float32),
        np.zeros((TOKENS, HIDDEN), np.float32), shares[0].astype(np.float32),
    )


def _exp_sums(z: np.ndarray) -> np.ndarray:
    """Sums of each row's exponentials, which take the place of the row; scores stay far below where exp overflows. A product is the faster sum."""
    np.exp(z, out=z)
    return z @ ONES[: z.shape[1]]


def _hidden(net: Network | Learner, context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    x = net.embed.take(context.reshape(-1), axis=0).reshape(len(context), -1)
    h = x @ net.inner
    h += net.inner_bias
    return x, np.tanh(h, out=h)


def _sorted(target: np.ndarray) -> np.ndarray:
    return np.argsort(target.astype(np.min_scalar_type(TOKENS)), kind="stable")  # numbers of 16 bits are sorted by their digits


def _classes(target: np.ndarray) -> Iterator[tuple[slice, slice]]:
    """Of each class that sorted targets have: its rows and its tokens."""
    edges = np.searchsorted(target, np.arange(0, TOKENS + 1, IN_CLASS)).tolist()
    for c, (lo, hi) in enumerate(itertools.pairwise(edges)):
        if lo < hi:
            yield slice(lo, hi), slice(c * IN_CLASS, (c + 1) * IN_CLASS)


def _logs(h: np.ndarray, weights: np.ndarray, bias: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """ln of each row's probability of what was chosen, so many rows at a time that their scores stay close to the processor."""
    out, space = np.empty(len(h)), np.empty((min(len(h), CLOSE), len(bias)), np.float32)
    for at in range(0, len(h), CLOSE):
        some, own = h[at : at + CLOSE], chosen[at : at + CLOSE]
        z = np.matmul(some, weights, out=space[: len(some)])
        z += bias
        score = z.reshape(-1)[PLACES[: len(some)] * len(bias) + own]
        out[at : at + CLOSE] = score - np.log(_exp_sums(z))
    return out


def token_logs(net: Network, context: np.ndarray, target: np.ndarray) -> np.ndarray:
    """ln p(target | context) of each row, over all tokens."""
    order = _sorted(target)
    now = target[order]
    group, place = now // IN_CLASS, now % IN_CLASS
    h, logs = np.empty((len(now), HIDDEN), np.float32), np.empty(len(now))
    for at in range(0, len(now), CLOSE):
        own = slice(at, at + CLOSE)
        h[own] = _hidden(net, context[order[own]])[1]
        logs[own] = _logs(h[own], net.outer, net.outer_bias, group[own])
    for rows, own in _classes(now):
        logs[rows] += _logs(h[rows], net.word[own].T, net.word_bias[own], place[rows])
    out = np.empty_like(logs)
    out[order] = logs
    return out


class Learner:
    """A copy of a network that descends by Adagrad on the log loss of batches. Weights and their bias are one array here, for the bias is the weight of a constant 1."""

    def __init__(self, net: Network):
        self.embed, self.inner, self.inner_bias = net.embed.copy(), net.inner.copy(), net.inner_bias.copy()
        self.outer = np.vstack([net.outer, net.outer_bias])
        self.word = np.ascontiguousarray(np.column_stack([net.word, net.word_bias]).reshape(-1, IN_CLASS, HIDDEN + 1).transpose(0, 2, 1))  # by class
        self.squares, self.grads = ({k: np.full_like(a, x) for k, a in vars(self).items() if isinstance(a, np.ndarray)} for x in (1e-8, 0))
        self.space = np.empty(CLOSE * max(self.outer.shape[1], IN_CLASS), np.float32)  # for all products in turn: fresh room costs more than a product

    def network(self) -> Network:
        word = self.word.transpose(0, 2, 1).reshape(TOKENS, HIDDEN + 1)
        return Network(self.embed, self.inner, self.inner_bias, self.outer[:-1], self.outer[-1], word[:, :-1], word[:, -1])

    def _step(self, name: str) -> None:
        """Descend by the gradient at hand, whose room is used up."""
        every, at_once = [a.reshape(-1) for a in (getattr(self, name), self.grads[name], self.squares[name])], len(self.space) // 4
        for at in range(0, len(every[0]), at_once):
            own, grad, square = (a[at : at + at_once] for a in every)
            spare = self.space[: len(grad)]
            square += np.multiply(grad, grad, out=spare)
            grad *= RATE
            grad /= np.sqrt(square, out=spare)
            own -= grad

    def _pull(self, h: np.ndarray, dh: np.ndarray, weights: np.ndarray, grad: np.ndarray, chosen: np.ndarray) -> None:
        """Add what the choices by ``weights`` give to the gradients at ``h`` and at the weights: each row's probabilities, less one at what was chosen."""
        n = weights.shape[1]
        for at in range(0, len(h), CLOSE):
            some, own = h[at : at + CLOSE], chosen[at : at + CLOSE]
            e = np.matmul(some, weights, out=self.space[: len(some) * n].reshape(len(some), n))
            e *= (1 / _exp_sums(e))[:, None]
            e.reshape(-1)[PLACES[: len(some)] * n + own] -= 1
            dh[at : at + CLOSE] += e @ weights[:-1].T
            grad += some.T @ e

    def learn(self, context: np.ndarray, target: np.ndarray) -> None:
        """One step by the loss of BATCH rows at most."""
        grads, order = self.grads, _sorted(target)
        target, context = target[order], context[order]
        x, tanh = _hidden(self, context)
        h, dh = np.ones((len(target), HIDDEN + 1), np.float32), np.zeros_like(tanh)
        h[:, :-1] = tanh
        group, place = target // IN_CLASS, target % IN_CLASS
        grads["outer"][:] = 0
        grads["word"][:] = 0
        self._pull(h, dh, self.outer, grads["outer"], group)
        for rows, own in _classes(target):
            c = own.start // IN_CLASS
            self._pull(h[rows], dh[rows], self.word[c], grads["word"][c], place[rows])
        tanh *= tanh
        dh *= np.subtract(1, tanh, out=tanh)
        np.matmul(x.T, dh, out=grads["inner"])
        np.matmul(np.ones(len(dh), dh.dtype), dh, out=grads["inner_bias"])
        dx = np.ascontiguousarray((dh @ self.inner.T).reshape(-1, WIDTH).T)
        flat = context.reshape(-1).astype(np.intp)
        for k in range(WIDTH):
            grads["embed"][:, k] = np.bincount(flat, dx[k], TOKENS + 1)
        for name in grads:
            self._step(name)


def token_counts(rows: DataFrame) -> np.ndarray:
    """How often each token is in ``ids`` of all rows. Tasks count their own; the sums have one row for each token."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(TOKENS, np.int64)
        for batch in batches:
            seen += np.bincount(unpacked(batch.column(0))[0], minlength=TOKENS)
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(seen[at])], ["token", "n"])

    found = rows.select("ids").mapInArrow(count, "token int, n long").groupBy("token").agg(F.sum("n").alias("n")).toArrow().to_pandas()
    out = np.zeros(TOKENS, np.int64)
    out[found["token"].to_numpy()] = found["n"].to_numpy()
    return out


def _average(rows: pd.DataFrame) -> pd.DataFrame:
    """One row: the mean of a slice over partitions, weighted by what they learned from."""
    share = (rows["seen"] / rows["seen"].sum()).to_numpy()
    total = np.zeros(len(rows["values"].iloc[0]))
    for w, v in zip(share, rows["values"]):
        total += w * v
    return pd.DataFrame({"slice": rows["slice"].iloc[:1].to_numpy(), "part": rows["part"].iloc[:1].to_numpy() // FAN_IN, "seen": rows["seen"].sum(), "values": [total.astype(np.float32)]})


def train(rows: DataFrame, number: np.ndarray, net: Network, rounds: int = ROUNDS, every: int = EVERY) -> Network:
    """Rounds of local descent on every partition's token ``ids`` and of averaging what the partitions learned.

    In round r a partition starts from the shared network and learns the tokens at places r, r + every, ... of all
    its texts. Its parameters, in slices, are averaged by Spark, FAN_IN partitions at a time, weighted by the
    tokens learned. A round gathers more from a larger corpus, but only the averages, which are as large as the
    network, come to the driver. Nothing is drawn by chance.
    """
    spark, schema = rows.sparkSession, "slice int, part int, seen double, values array<float>"
    numbers = spark.sparkContext.broadcast(number)
    for r in range(rounds):
        shared = spark.sparkContext.broadcast(net)

        def descend(batches: Iterator[pa.RecordBatch], r: int = r, shared=shared) -> Iterator[pa.RecordBatch]:
            learner, seen = Learner(shared.value), 0
            context, target = np.zeros((0, 2 * SIDE), np.int32), np.zeros(0, np.int32)
            for line, begin, sizes in (x for batch in batches for x in _lines(batch.column(0), numbers.value)):
                at = _runs(begin + r % every, np.maximum(0, -((r % every - sizes) // every)), every)
                seen += len(at)
                for k in range(0, len(at), 4 * BATCH):  # a long text is learned in parts
                    now = at[k : k + 4 * BATCH]
                    context, target = np.concatenate([context, around(line, now)]), np.concatenate([target, line[now]])
                    while len(target) >= BATCH:
                        learner.learn(context[:BATCH], target[:BATCH])
                        context, target = context[BATCH:], target[BATCH:]
            if len(target):
                learner.learn(context, target)
            if seen:
                slices = np.array_split(np.concatenate([a.reshape(-1) for a in learner.network()]), SLICES)
                values = pa.ListArray.from_arrays(np.cumsum([0, *map(len, slices)], dtype=np.int32), np.concatenate(slices))
                columns = [np.arange(SLICES, dtype=np.int32), np.zeros(SLICES, np.int32), np.full(SLICES, float(seen))]
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), values], ["slice", "part", "seen", "values"])

        learned = rows.select("ids").mapInArrow(descend, schema).withColumn("part", F.spark_partition_id())
        parts = rows.rdd.getNumPartitions()
        while parts > FAN_IN:
            learned = learned.withColumn("group", F.floor(F.col("part") / FAN_IN)).groupBy("slice", "group").applyInPandas(_average, schema)
            parts = -(-parts // FAN_IN)
        merged = learned.groupBy("slice").applyInPandas(_average, schema).orderBy("slice").toArrow().to_pandas()
        if len(merged):
            flat, parts, at = np.concatenate(merged["values"].tolist()).astype(np.float32), [], 0
            for a in net:
                parts.append(flat[at : at + a.size].reshape(a.shape).copy())
                at += a.size
            net = Network(*parts)
    return net


def likelihood(net: Network, ids: np.ndarray) -> float:
    """The sum of ln p of all tokens of a text, each given those around it."""
    total = 0.0
    for at in range(0, len(ids), BATCH):
        lo, hi = max(0, at - SIDE), min(len(ids), at + BATCH + SIDE)
        place = np.arange(at, min(at + BATCH, len(ids)))
        total += float(token_logs(net, windows(ids[lo:hi], place - lo), ids[place]).sum())
    return total


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS, every: int = EVERY) -> DataFrame:
    """(doc_id, n_tokens, pseudo_log_likelihood, per_token) of every document.

    The log-likelihood sums, over all tokens, the log probability that the network gives the token, of all tokens
    there are, from those on both its sides. Words are tokens by hash. Null and empty texts have no tokens, a sum
    of 0 and a null mean. Null ids and repeated rows are scored like any other, other columns are ignored, an empty
    table gives an empty result. Texts are tokenised once, into a table that all passes read. Runs over the same
    files agree but for rounding.
    """
    own = materialise(docs.select(F.col(id_col).alias("doc_id"), _packed(text_col).alias("ids")))
    counts = token_counts(own)
    number = ranks(counts)
    shared = docs.sparkSession.sparkContext.broadcast((train(own, number, start(counts), rounds, every), number))

    @F.arrow_udf(T.StructType([T.StructField("n", T.LongType()), T.StructField("log", T.DoubleType())]))
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        net, numbers = shared.value
        for texts in batches:
            n, sums = [np.zeros(0, np.int64)], [np.zeros(0)]
            for line, begin, sizes in _lines(texts, numbers):
                at, of, log = _runs(begin, sizes), np.repeat(np.arange(len(sizes)), sizes), np.zeros(len(sizes))
                for k in range(0, len(at), 16 * BATCH):
                    now = at[k : k + 16 * BATCH]
                    log += np.bincount(of[k : k + 16 * BATCH], token_logs(net, around(line, now), line[now]), len(sizes))
                n.append(sizes.astype(np.int64))
                sums.append(log)
            yield pa.StructArray.from_arrays([pa.array(np.concatenate(n)), pa.array(np.concatenate(sums))], ["n", "log"])

    rows = own.select("doc_id", scored("ids").alias("s"))
    rows = rows.select("doc_id", F.col("s.n").alias("n_tokens"), F.col("s.log").alias("pseudo_log_likelihood"))
    return rows.withColumn("per_token", F.when(F.col("n_tokens") > 0, F.col("pseudo_log_likelihood") / F.col("n_tokens")))
