"""Operator 1, quality rules: a calibrated logistic regression on hashed n-grams, after counting rules.

Features are word 1- and 2-grams, "the same word again" as a 2-gram of its own, and character
3-grams of the UTF-8 text, hashed to DIMENSIONS cells; a cell holds log(1 + count) and a text's
vector has length 1. The model is fitted on at most TRAIN_ROWS labelled rows (those with the
smallest hash of their id), calibrated by Platt's method on every fifth of these, and scored in
Arrow batches with no shuffle. Texts below the fixed THRESHOLD are rejected.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .linear import fit_logistic, fit_platt, sigmoid
from .tables import labelled_sample, with_columns_from_text
from .words import SPACE, mix, windows, words

DIMENSIONS = 4096
TRAIN_ROWS = 4000
THRESHOLD = 0.5
MIN_WORDS = 20
REPEAT_WINDOW = 8
REPEAT_PERCENT = 30
SYMBOLS = b"#*$%&|<>"
_BITS = np.uint64(64 - 12)
SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, probability double, kept boolean"


@dataclass
class QualityModel:
    weights: np.ndarray
    intercept: float
    slope: float
    shift: float
    rows: int


def features(data: bytes, h: np.ndarray) -> np.ndarray:
    """The hashed n-gram vector of UTF-8 bytes with word hashes h."""
    b = np.frombuffer(data, np.uint8).astype(np.uint64)
    cells = [h >> _BITS, windows(h, 2) >> _BITS]
    if len(h) > 1:
        cells.append(np.full(int((h[1:] == h[:-1]).sum()), 1, np.uint64))
    if len(b) > 2:
        cells.append(mix(b[:-2] | b[1:-1] << np.uint64(8) | b[2:] << np.uint64(16)) >> _BITS)
    x = np.log1p(np.bincount(np.concatenate(cells).astype(np.int64), minlength=DIMENSIONS).astype(np.float32))
    return x / max(np.sqrt((x * x).sum()), 1e-9)


def repeat_words(data: bytes, h: np.ndarray) -> int:
    """Words in windows of REPEAT_WINDOW words that the text has twice or more."""
    w = windows(h, REPEAT_WINDOW)
    if len(w) < 2:
        return 0
    order = np.sort(w)
    same = order[1:][order[1:] == order[:-1]]
    if not len(same):
        return 0
    tokens, places = data.split(), {}
    for i in np.flatnonzero(np.isin(w, same)).tolist():
        places.setdefault(tuple(tokens[i : i + REPEAT_WINDOW]), []).append(i)
    covered = np.zeros(len(h), bool)
    for at in places.values():
        if len(at) > 1:
            for i in at:
                covered[i : i + REPEAT_WINDOW] = True
    return int(covered.sum())


def _counts(data: bytes, h: np.ndarray) -> tuple[int, int, int, int, int]:
    each = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    points = len(data) - int(each[128:192].sum())
    lines = [x for x in data.split(b"\n") if x.strip()]
    return len(h), points - int(each[SPACE].sum()), int(each[list(SYMBOLS)].sum()), len(lines) - len(set(lines)), repeat_words(data, h)


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> QualityModel | None:
    """The model from rows of docs that labels mark 0 or 1 (see labelled_sample); None if one of the two is missing among them."""
    picked = labelled_sample(docs, labels, rows, id_col, text_col, label_col)

    def run(batches):
        for batch in batches:
            xs = [features(d, words(d)[2]) for d in (t.encode() for t in batch.column("text").to_pylist())]
            cells = [np.flatnonzero(x) for x in xs]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").cast(pa.string()), batch.column("label"), pa.array([c.astype(np.int32) for c in cells], pa.list_(pa.int32())), pa.array([x[c] for x, c in zip(xs, cells)], pa.list_(pa.float32()))],
                names=["id", "label", "cells", "values"],
            )

    table = picked.mapInArrow(run, "id string, label int, cells array<int>, values array<float>").toArrow().sort_by("id")
    y = np.array(table["label"].to_pylist(), np.float32)
    if len(set(y.tolist())) < 2:
        return None
    x = np.zeros((len(y), DIMENSIONS), np.float32)
    i = 0
    for batch in table.to_batches():
        for c, v in zip(batch["cells"].to_numpy(zero_copy_only=False), batch["values"].to_numpy(zero_copy_only=False)):
            x[i, c] = v
            i += 1
    del table
    pa.default_memory_pool().release_unused()
    held = np.arange(len(y)) % 5 == 0
    if len(set(y[held].tolist())) < 2 or len(set(y[~held].tolist())) < 2:
        held[:] = False
    w, b = fit_logistic(x, y, 1e-5, 400, balance=True, used=~held)
    check = held if held.any() else ~held
    return QualityModel(w, b, *fit_platt((x @ w + b)[check], y[check]), len(y))


def score(docs: DataFrame, model: QualityModel | None, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """`row` and `out` (SCHEMA) per row of docs.

    A null text is empty: no words, so base_failed and not kept. Without a model the probability is null and
    the base rules alone decide. Every row is scored by itself, so repeats and ties score alike.
    """

    def compute(texts: list[str | None]) -> list[pa.Array]:
        rows = []
        for text in texts:
            data = (text or "").encode()
            h = words(data)[2]
            counts = _counts(data, h)
            failed = counts[0] < MIN_WORDS or 100 * counts[4] > REPEAT_PERCENT * counts[0]
            p = None if model is None else float(sigmoid(np.float64(model.slope * float(features(data, h) @ model.weights + model.intercept) + model.shift)))
            rows.append((*counts, failed, p, not failed and (p is None or p >= threshold)))
        columns = list(zip(*rows)) or [()] * 8
        return [pa.array(c, k) for c, k in zip(columns, [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.bool_()])]

    return with_columns_from_text(docs, text_col, SCHEMA, compute)
