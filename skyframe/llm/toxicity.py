"""Operator 6, toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Texts are folded (A-Z lower-cased; everything but letters and digits is a space). A feature is the
presence of a 4- or 6-gram of UTF-8 bytes, kept exactly as a 64-bit integer. Of at most TRAIN_ROWS
labelled rows (smallest hash of their id), Spark counts each n-gram by class. Features are chosen among those that
LEAST_TEXTS of these rows have: those whose shares differ by Z_LEAST standard errors, of them the MAX_FEATURES that differ
most (ties: the smaller n-gram); they are scaled by their log-count ratios and weighted by logistic regression. Scoring looks n-grams up in a bitmap, then in the sorted feature
list, in Arrow batches with no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .linear import fit_logistic, sigmoid
from .tables import labelled_sample, with_columns_from_text, written

SIZES = (4, 6)
TRAIN_ROWS = 6000
MAX_FEATURES = 4096
Z_LEAST = 4.5
LEAST_TEXTS = 4
SMOOTHING = 1.0
HOLD_OUT = 5
SCHEMA = "score double, predicted int"
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))
_BITS = 20
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class ToxicityModel:
    grams: np.ndarray
    weights: np.ndarray
    intercept: float
    present: np.ndarray


def grams(text: str) -> list[np.ndarray]:
    """All 4- and 6-grams of the folded text as integers: bytes are never zero, so the sizes don't meet."""
    b = np.frombuffer(b" %s " % text.encode().translate(_FOLD), np.uint8).astype(np.uint64)
    out = []
    for n in SIZES:
        m = max(len(b) - n + 1, 0)
        g = b[:m].copy()
        for i in range(1, n):
            g |= b[i : i + m] << np.uint64(8 * i)
        out.append(g)
    return out


def _cell(g: np.ndarray) -> np.ndarray:
    return (g * _SPREAD) >> np.uint64(64 - _BITS)


def held_out(id_col: str):
    """Whether a row is kept from training: the CRC-32 of its id as text leaves no remainder."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % HOLD_OUT == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> ToxicityModel | float:
    """The model from rows that aren't held out (see labelled_sample); the share of label 1 if there is one class only or no telling n-gram (0.0 without rows)."""
    picked = written(labelled_sample(docs, labels.filter(~held_out(id_col)), rows, id_col, text_col, label_col), "toxicity_sample")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush() -> pa.RecordBatch:
            (up, n_up), (down, n_down) = (np.unique(np.concatenate(held[k] or [np.zeros(0, np.uint64)]), return_counts=True) for k in (1, 0))
            g = np.concatenate([up, down, [np.uint64(0)]])
            pos = np.concatenate([n_up, np.zeros(len(down), np.int64), [total[1]]])
            neg = np.concatenate([np.zeros(len(up), np.int64), n_down, [total[0]]])
            return pa.RecordBatch.from_arrays([pa.array(x.astype(np.uint64).view(np.int64) if x is g else x.astype(np.int64)) for x in (g, pos, neg)], names=["g", "pos", "neg"])

        held, total, size = {0: [], 1: []}, {0: 0, 1: 0}, 0
        for batch in batches:
            for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist()):
                held[label].append(own := np.unique(np.concatenate(grams(text))))
                total[label] += 1
                size += len(own)
                if size > 4_000_000:
                    yield flush()
                    held, total, size = {0: [], 1: []}, {0: 0, 1: 0}, 0
        yield flush()

    counted = picked.select("text", "label").repartition(docs.sparkSession.sparkContext.defaultParallelism).mapInArrow(count, "g long, pos long, neg long").groupBy("g").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).filter(F.col("pos") + F.col("neg") >= LEAST_TEXTS)
    counted = written(counted, "toxicity_counts")
    totals = counted.filter("g = 0").first()
    if totals is None:
        up, n = picked.agg(F.sum("label"), F.count("*")).first()
        return (up or 0) / n if n else 0.0
    up, down = totals["pos"], totals["neg"]
    if not up or not down:
        return 1.0 if up else 0.0
    share = (F.col("pos") + F.col("neg")) / float(up + down)
    z = (F.col("pos") / float(up) - F.col("neg") / float(down)) / F.sqrt(share * (1 - share) * (1 / up + 1 / down) + 1e-12)
    best = counted.filter("g != 0").withColumn("z", F.abs(z)).filter(F.col("z") >= Z_LEAST).orderBy(F.desc("z"), "g").limit(MAX_FEATURES).select("g", "pos", "neg").toArrow()
    if not best.num_rows:
        return up / (up + down)
    g = best["g"].to_numpy().view(np.uint64)
    order = np.argsort(g)
    g, pos, neg = g[order], best["pos"].to_numpy()[order], best["neg"].to_numpy()[order]
    ratio = np.log((pos + SMOOTHING) / (up + 2 * SMOOTHING)) - np.log((neg + SMOOTHING) / (down + 2 * SMOOTHING))
    present = np.zeros(1 << _BITS, bool)
    present[_cell(g)] = True

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_features(x, g, present).astype(np.int32) for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id").cast(pa.string()), batch.column("label"), pa.array(found, pa.list_(pa.int32()))], names=["id", "label", "f"])

    table = picked.select("id", "label", "text").mapInArrow(look_up, "id string, label int, f array<int>").toArrow().sort_by("id")
    x = np.zeros((table.num_rows, len(g)), np.float32)
    for i, f in enumerate(table["f"]):
        x[i, f.values.to_numpy()] = ratio[f.values.to_numpy()]
    w, b = fit_logistic(x, np.array(table["label"].to_pylist(), np.float32), 1e-4, 600)
    return ToxicityModel(g, w * ratio, b, present)


def _features(text: str | None, g: np.ndarray, present: np.ndarray) -> np.ndarray:
    """Distinct places in the feature list g of the text's n-grams."""
    found = []
    for own in grams(text or ""):
        some = own[present[_cell(own)]]
        at = np.minimum(np.searchsorted(g, some), len(g) - 1)
        found.append(at[g[at] == some])
    return np.unique(np.concatenate(found))


def score(docs: DataFrame, model: ToxicityModel | float, text_col: str = "text") -> DataFrame:
    """`row` and `out` (SCHEMA) per row of docs. Null and empty texts get the score of a text without features; repeats and ties score alike."""

    def compute(texts: list[str | None]) -> list[pa.Array]:
        if isinstance(model, float):
            scores = [model] * len(texts)
        else:
            z = np.array([float(model.weights[_features(x, model.grams, model.present)].sum()) for x in texts], float)
            scores = sigmoid(z + model.intercept).tolist()
        return [pa.array(scores, pa.float64()), pa.array([int(x >= 0.5) for x in scores], pa.int32())]

    return with_columns_from_text(docs, text_col, SCHEMA, compute)
