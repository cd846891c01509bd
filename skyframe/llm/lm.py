"""Operator 9, language-model scoring by masked pseudo-likelihood.

Words (runs of letters and digits, A-Z lower-cased) become tokens: the FREQUENT commonest words of the whole
corpus, counted by Spark, have one each; other words share BUCKETS by their hash; one token stands
for the text's ends. A network predicts every token from the two before and the two after it: a hidden layer,
tanh(sum of four position embeddings + bias), gives the token's class, and in the class the token; each of CLASSES
classes has as many words and one bucket, so that a softmax over thousands of tokens costs two small ones.

Below a bucket, p(word) = p(bucket) * p(word | bucket), the latter from Spark's counts. Words that occur LEAST times or more
have their own, as many of the commonest as OWN_WORDS allow; the rest of a bucket's mass is spread evenly over its
other words and one that stands for all unseen ones.

Training is data-parallel: documents become token arrays, dealt over shards of about SHARD_TOKENS tokens by a hash of
the row and sorted by it, so that the result doesn't hang on how the input is cut. Each task runs Adagrad in numpy over
its shard, and Spark averages what the tasks changed by numbers of examples; ROUNDS rounds start from the last average.
A round takes every STRIDE-th position of each document, the next round those after them, so the rounds take every
position of every document once. The sum of log p over all positions scores a document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import with_columns_from_text, written
from .words import words

CLASSES = 64
SLOTS = 64
BUCKETS = CLASSES  # the last slot of each class
FREQUENT = CLASSES * (SLOTS - 1)
TOKENS = CLASSES * SLOTS
END = TOKENS  # in contexts only
LEAST = 2
OWN_WORDS = 1_000_000
WIDTH = 16
ROUNDS = 2
STRIDE = ROUNDS  # all positions
MINIBATCH = 8192
BLOCK = 1 << 20
SHARD_TOKENS = 4_000_000
RATE = 0.15
SEED = 7
SCHEMA = "n_tokens long, logprob double, mean_logprob double"
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


@dataclass
class BucketWords:
    """log p(word | bucket)."""

    known: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))  # sorted word hashes
    log_share: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))
    log_other: np.ndarray = field(default_factory=lambda: np.zeros(BUCKETS, np.float32))  # of a word that isn't known, by bucket

    def log_p(self, h: np.ndarray, t: np.ndarray) -> np.ndarray:
        """By word: 0 for one that has a token of its own."""
        rare = t >= FREQUENT
        h = h[rare]
        p = self.log_other[t[rare] - FREQUENT]
        if len(self.known):
            at = np.minimum(np.searchsorted(self.known, h), len(self.known) - 1)
            p = np.where(self.known[at] == h, self.log_share[at], p)
        out = np.zeros(len(t), np.float32)
        out[rare] = p
        return out


@dataclass
class Vocabulary:
    """The frequent words: sorted hashes, and the token (rank by frequency) of each."""

    h: np.ndarray
    token: np.ndarray

    def tokens(self, h: np.ndarray) -> np.ndarray:
        t = (FREQUENT + (h >> np.uint64(40)) % np.uint64(BUCKETS)).astype(np.int32)
        if len(self.h):
            at = np.minimum(np.searchsorted(self.h, h), len(self.h) - 1)
            t = np.where(self.h[at] == h, self.token[at], t)
        return t


@dataclass
class WindowModel:
    vocabulary: Vocabulary
    position: np.ndarray  # (4, TOKENS + 1, WIDTH)
    bias: np.ndarray
    classes: np.ndarray  # (WIDTH, CLASSES)
    class_bias: np.ndarray
    out: np.ndarray  # (CLASSES, WIDTH, SLOTS)
    out_bias: np.ndarray  # (CLASSES, SLOTS)
    rare: BucketWords = field(default_factory=BucketWords)

    def parts(self) -> list[np.ndarray]:
        return [self.position, self.bias, self.classes, self.class_bias, self.out, self.out_bias]

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in self.parts()]).astype(np.float32)

    def like(self, flat: np.ndarray) -> WindowModel:
        parts, at = [], 0
        for x in self.parts():
            parts.append(flat[at : at + x.size].reshape(x.shape).astype(np.float32))
            at += x.size
        return WindowModel(self.vocabulary, *parts, self.rare)


def word_hashes(text: str | None) -> np.ndarray:
    return words((text or "").encode().translate(_FOLD))[2]


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """h and n of each distinct word of all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush() -> pa.RecordBatch:
            h, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], names=["h", "n"])

        held, size = [], 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                held.append(word_hashes(text))
                size += len(held[-1])
                if size > 2_000_000:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()

    return written(docs.select(text_col).mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")), "word_counts")


def common_words(counts: DataFrame) -> Vocabulary:
    """The FREQUENT commonest words; ties go to the smaller hash. Classes get words of all frequencies alike."""
    h = np.array([r["h"] for r in counts.orderBy(F.desc("n"), "h").limit(FREQUENT).collect()], np.int64).view(np.uint64)
    order = np.argsort(h)
    return Vocabulary(h[order], order.astype(np.int32))


def least_count(counts: DataFrame, own_words: int = OWN_WORDS) -> int:
    """The smallest count, from LEAST on, that at most own_words words reach."""
    many = 1 << 16
    of = {r["n"]: r["words"] for r in counts.filter(F.col("n") >= LEAST).groupBy(F.least("n", F.lit(many)).alias("n")).agg(F.count("*").alias("words")).collect()}  # at most 65,536 rows
    reached, least = 0, many
    for n in sorted(of, reverse=True):
        reached += of[n]
        if reached > own_words:
            break
        least = n
    return least


def bucket_words(counts: DataFrame, vocabulary: Vocabulary) -> BucketWords:
    frequent = counts.sparkSession.createDataFrame(pa.table({"h": vocabulary.h.view(np.int64)}))
    rare = counts.join(F.broadcast(frequent), "h", "left_anti").withColumn("b", (F.shiftrightunsigned("h", 40) % BUCKETS).cast("int"))
    known = F.col("n") >= least_count(rare)
    total, rest, kinds = np.zeros(BUCKETS), np.zeros(BUCKETS), np.zeros(BUCKETS)
    for r in rare.groupBy("b").agg(F.sum("n").alias("n"), F.sum(F.when(~known, F.col("n"))).alias("rest"), F.count(F.when(~known, 1)).alias("kinds")).collect():
        total[r["b"]], rest[r["b"]], kinds[r["b"]] = r["n"], r["rest"] or 0, r["kinds"]
    own = rare.filter(known).select("h", "b", "n").toArrow()  # at most OWN_WORDS rows
    h = own["h"].to_numpy().view(np.uint64)
    order = np.argsort(h)
    log_share = np.log(own["n"].to_numpy() / (total[own["b"].to_numpy()] + 1)).astype(np.float32)
    return BucketWords(h[order], log_share[order], np.log((rest + 1) / (total + 1) / (kinds + 1)).astype(np.float32))


def new_model(vocabulary: Vocabulary) -> WindowModel:
    rng = np.random.default_rng(SEED)
    draw = lambda *shape: (rng.standard_normal(shape) * 0.1).astype(np.float32)
    zero = lambda *shape: np.zeros(shape, np.float32)
    return WindowModel(vocabulary, draw(4, TOKENS + 1, WIDTH), zero(WIDTH), draw(WIDTH, CLASSES), zero(CLASSES), draw(CLASSES, WIDTH, SLOTS), zero(CLASSES, SLOTS))


def contexts(flat: np.ndarray, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Of texts' tokens one after the other, in blocks: (4, n) tokens two and one before, one and two after each (END beyond its text), the token, the number of its text, its place in it."""
    many = np.diff(starts)
    of = np.repeat(np.arange(len(many), dtype=np.int32), many)
    padded = np.full(len(flat) + 2 * (len(many) + 1), END, np.int32)
    at = np.arange(len(flat)) + 2 * (of + np.int64(1))
    padded[at] = flat
    for i in range(0, len(flat), BLOCK):
        p, text = at[i : i + BLOCK], of[i : i + BLOCK]
        yield np.stack([padded[p - 2], padded[p - 1], padded[p + 1], padded[p + 2]]), padded[p], text, np.arange(i, i + len(p)) - starts[text]


def context(t: np.ndarray) -> np.ndarray:
    """contexts() of one text."""
    return np.concatenate([np.zeros((4, 0), np.int32), *(c for c, *_ in contexts(t, np.array([0, len(t)])))], 1)


def _hidden(m: WindowModel, around: np.ndarray) -> np.ndarray:
    z = m.position[0][around[0]]
    for k in range(1, 4):
        z += m.position[k][around[k]]
    z += m.bias
    return np.tanh(z, out=z)


def _by_class(target: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, int]]]:
    """Order of the targets by class, their slots in that order, and (class, first, last) of each class in it."""
    c = (target % CLASSES).astype(np.int16)
    order = np.argsort(c, kind="stable")
    many = np.bincount(c, minlength=CLASSES)
    ends = np.cumsum(many)
    return order, (target // CLASSES)[order], [(k, int(ends[k] - many[k]), int(ends[k])) for k in np.flatnonzero(many)]


def _within(weights: np.ndarray, bias: np.ndarray, axis: int, limit: float) -> bool:
    """Whether no value can exceed the limit, as hidden values are at most 1."""
    return float((np.abs(weights).sum(axis) + np.abs(bias)).max()) < limit


def _shares(z: np.ndarray, clip: float, within: bool) -> np.ndarray:
    """z becomes exp(z), of values between -clip and clip; the sums of its rows."""
    if not within:
        np.clip(z, -clip, clip, out=z)
    np.exp(z, out=z)
    return z.sum(1, keepdims=True)


def _step(m: WindowModel, around: np.ndarray, target: np.ndarray, past: list[np.ndarray]) -> None:
    """One step of Adagrad on the mean negative log-probability."""
    n = len(target)
    order, slot, spans = _by_class(target)
    around, target, rows = around[:, order], target[order], np.arange(n)
    a = _hidden(m, around)
    p = a @ m.classes
    p += m.class_bias
    p *= 1 / (n * _shares(p, 30, _within(m.classes, m.class_bias, 0, 30)))
    p[rows, target % CLASSES] -= np.float32(1 / n)
    q = np.empty((n, SLOTS), np.float32)
    for k, i, j in spans:
        np.matmul(a[i:j], m.out[k], out=q[i:j])
        q[i:j] += m.out_bias[k]
    q *= 1 / (n * _shares(q, 30, _within(m.out, m.out_bias, 1, 30)))
    q[rows, slot] -= np.float32(1 / n)
    d = p @ m.classes.T
    out, out_bias = np.zeros_like(m.out), np.zeros_like(m.out_bias)
    for k, i, j in spans:
        d[i:j] += q[i:j] @ m.out[k].T
        out[k] = a[i:j].T @ q[i:j]
        out_bias[k] = q[i:j].sum(0)
    d *= 1 - a * a
    columns, flat = np.arange(WIDTH), d.ravel().astype(float)
    sums = [np.bincount((around[k][:, None] * WIDTH + columns).ravel(), flat, (TOKENS + 1) * WIDTH) for k in range(4)]
    position = np.concatenate(sums).reshape(m.position.shape).astype(np.float32)
    for x, g, s in zip(m.parts(), (position, d.sum(0), a.T @ p, p.sum(0), out, out_bias), past):
        s += g * g
        x -= RATE * g / np.sqrt(s)


def log_p(m: WindowModel, around: np.ndarray, target: np.ndarray) -> np.ndarray:
    """log p of each target token in its context."""
    order, slot, spans = _by_class(target)
    around, target, rows = around[:, order], target[order], np.arange(len(target))
    a = _hidden(m, around)
    z = a @ m.classes
    z += m.class_bias
    own = np.clip(z[rows, target % CLASSES], -60, 60).astype(float)
    own -= np.log(_shares(z, 60, _within(m.classes, m.class_bias, 0, 60))[:, 0])
    q = np.empty((len(target), SLOTS), np.float32)
    for k, i, j in spans:
        np.matmul(a[i:j], m.out[k], out=q[i:j])
        q[i:j] += m.out_bias[k]
    own += np.clip(q[rows, slot], -60, 60)
    own -= np.log(_shares(q, 60, _within(m.out, m.out_bias, 1, 60))[:, 0])
    back = np.empty(len(target))
    back[order] = own
    return back


def trains(i: np.ndarray, n: np.ndarray, r: int, rounds: int = ROUNDS, stride: int = STRIDE) -> np.ndarray:
    """Whether round r trains on the i-th token of a text of n."""
    return (i - (r * stride // rounds + n)) % stride == 0


def token_table(docs: DataFrame, vocabulary: Vocabulary, rare: BucketWords, text_col: str = "text") -> DataFrame:
    """Per row of docs: row (a struct of its columns but the text), key (a hash of all of them), t (the text's tokens) and below, the sum of log p(word | bucket)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = [word_hashes(x) for x in batch.column("text").to_pylist()]
            flat = np.concatenate([np.zeros(0, np.uint64), *h])
            starts = np.cumsum([0, *map(len, h)])
            t = vocabulary.tokens(flat)
            below = np.cumsum(np.append(0.0, rare.log_p(flat, t).astype(float)))
            below = below[starts[1:]] - below[starts[:-1]]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("key"), pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(t.astype(np.int16))), pa.array(below)], names=["row", "key", "t", "below"])

    held = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns if c.lower() != text_col.lower())).alias("row"), F.xxhash64(*(F.col(f"`{c}`") for c in docs.columns)).alias("key"), F.col(text_col).alias("text"))
    return written(held.mapInArrow(run, T.StructType([held.schema["row"], *T.StructType.fromDDL("key long, t array<short>, below double")])), "tokens")


def _flat(batch: pa.RecordBatch, name: str = "t") -> tuple[np.ndarray, np.ndarray]:
    """The values of a list column, and where each row's start."""
    lists = batch.column(name)
    starts = lists.offsets.to_numpy()
    return lists.values.to_numpy()[starts[0] : starts[-1]], (starts - starts[0]).astype(np.int64)


def train(docs: DataFrame, text_col: str = "text", rounds: int = ROUNDS, stride: int = STRIDE) -> WindowModel:
    """The network trained over all of docs. Null and empty texts hold no example; without any, the network keeps its first weights.

    All columns of docs tell rows apart when they are dealt: columns that xxhash64 can't take must be left out.
    """
    return _trained(docs, text_col, rounds, stride)[0]


def train_and_score(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """score(docs, train(docs)) from one table of tokens; `row` is without the text."""
    model, tokens = _trained(docs, text_col, ROUNDS, STRIDE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, starts = _flat(batch)
            total = batch.column("below").to_numpy() + _scores(model, flat, starts)
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.StructArray.from_arrays(_columns(np.diff(starts), total), ["n_tokens", "logprob", "mean_logprob"])], names=["row", "out"])

    return tokens.select("row", "t", "below").mapInArrow(run, T.StructType([tokens.schema["row"], T.StructField("out", T.StructType.fromDDL(SCHEMA))]))


def _trained(docs: DataFrame, text_col: str, rounds: int, stride: int) -> tuple[WindowModel, DataFrame]:
    counts = word_counts(docs, text_col)
    model = new_model(common_words(counts))
    model.rare = bucket_words(counts, model.vocabulary)
    total = counts.agg(F.sum("n")).first()[0] or 0
    tokens = token_table(docs, model.vocabulary, model.rare, text_col)
    number = -(-total // SHARD_TOKENS) or 1
    # every task sends its parameters, so shards aren't made smaller where the session sets more partitions than asked for
    shards = tokens.select("key", "t").filter("size(t) > 0").repartition(number, "key").coalesce(number).sortWithinPartitions("key", "t")
    for r in range(rounds):

        def run(batches: Iterator[pa.RecordBatch], model=WindowModel(model.vocabulary, *model.parts()), r=r) -> Iterator[pa.RecordBatch]:
            m = model.like(model.flat())
            past = [np.full(x.shape, 1e-6, np.float32) for x in m.parts()]
            around, target, held, examples = [], [], 0, 0

            def steps() -> int:
                c, y = np.concatenate(around, 1), np.concatenate(target)
                for i in range(0, len(y), 2 * MINIBATCH):
                    _step(m, c[:, i : i + 2 * MINIBATCH], y[i : i + 2 * MINIBATCH], past)
                return len(y)

            for batch in batches:
                flat, starts = _flat(batch)
                many = np.diff(starts)
                for c, y, of, i in contexts(flat, starts):
                    now = np.flatnonzero(trains(i, many[of], r, rounds, stride))
                    around.append(c[:, now])
                    target.append(y[now])
                    held += len(now)
                    if held >= MINIBATCH:
                        examples += steps()
                        around, target, held = [], [], 0
            if held:
                examples += steps()
            moved = m.flat() - model.flat()
            i = np.flatnonzero(moved)
            i, moved = np.append(i, -1), np.append(moved[i], 1)  # -1: the number of examples
            yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array((moved * examples).astype(np.float32))], names=["i", "x"])

        parts = shards.mapInArrow(run, "i int, x float").groupBy("i").agg(F.sum("x").alias("x"))
        total = written(parts, "parameters").toArrow()  # as many rows as parameters
        i, x = total["i"].to_numpy(), total["x"].to_numpy()
        if (x[i < 0] > 0).any():
            flat = model.flat().astype(float)
            flat[i[i >= 0]] += x[i >= 0] / x[i < 0]
            model = model.like(flat)
    return model, tokens


def score(docs: DataFrame, model: WindowModel, text_col: str = "text") -> DataFrame:
    """`row` and `out` (SCHEMA) per row of docs: tokens, the sum of their conditional log-probabilities, and its mean.

    Null and empty texts, and texts without words, have 0 tokens, the sum 0 and a null mean. Every row is scored by itself.
    """

    def compute(texts: list[str | None]) -> list[pa.Array]:
        h = [word_hashes(x) for x in texts]
        flat, starts = np.concatenate([np.zeros(0, np.uint64), *h]), np.cumsum([0, *map(len, h)])
        t = model.vocabulary.tokens(flat)
        below = np.cumsum(np.append(0.0, model.rare.log_p(flat, t).astype(float)))
        return _columns(np.diff(starts), below[starts[1:]] - below[starts[:-1]] + _scores(model, t, starts))

    return with_columns_from_text(docs, text_col, SCHEMA, compute)


def _scores(model: WindowModel, flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The sum of the network's log p over each text's tokens."""
    total = np.zeros(len(starts) - 1)
    for c, y, of, _ in contexts(flat, starts):
        for i in range(0, len(y), MINIBATCH):
            total += np.bincount(of[i : i + MINIBATCH], log_p(model, c[:, i : i + MINIBATCH], y[i : i + MINIBATCH]), len(total))
    return total


def _columns(size: np.ndarray, total: np.ndarray) -> list[pa.Array]:
    return [pa.array(size.astype(np.int64)), pa.array(total), pa.array([s / n if n else None for n, s in zip(size.tolist(), total.tolist())], pa.float64())]
