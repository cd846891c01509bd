"""Operator 5, best-fit packing: best-two-fit.

A document is its token ids plus an end id. Only documents longer than a sequence are cut: whole
pieces of the capacity follow a first piece that may be shorter. Whole pieces fill sequences of
their own; the rest is packed by best-two-fit: open a sequence with the longest piece left, fill
the gap greedily with the longest that fits, then replace the smallest piece in it with the two
unpacked pieces that fill its expanded gap most tightly, if they fill it better than it does.

Pieces of one length are alike, so the plan is made on the histogram of lengths (at most
`capacity` numbers, whatever the input) as (pattern, times) pairs. Every step uses up a length, so
there are O(capacity log capacity) patterns. Spark numbers the pieces of each length, hot lengths
split by a hash of the id and of where the row was read, and each piece finds its place by its number.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import written
from .words import slice_hashes

CAPACITY = 2048
END_ID = 0
CACHE_ENTRIES = 500_000
GROUP_CHARS = 500_000
# Fixed value: the pre-tokenizer's pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_encoders: dict[str, PieceEncoder] = {}


class PieceEncoder:
    """Ids of texts as little-endian uint32 bytes, equal to those of the tokenizer file.

    The byte-level pre-tokenizer never joins across a single space that has non-space characters on
    both sides, so such a text is the concatenation of its space-separated chunks, each with its
    leading space. Chunks are found and hashed with numpy, and the ids of up to CACHE_ENTRIES
    distinct ones are kept. A text with other white space beside a space is encoded whole.

    encode() takes the file's added tokens for ordinary text; encode_added() gives each its one id.
    """

    def __init__(self, path: str):
        import tiktoken

        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in set(printable)]
        byte = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(rest)}
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        vocabulary, added = file["model"]["vocab"], file.get("added_tokens") or []
        if any(x.get(flag) for x in added for flag in ("single_word", "lstrip", "rstrip")):
            raise ValueError("added tokens that stand alone or take white space are not supported")
        self.added = {x["content"]: np.array([x["id"]], "<u4").tobytes() for x in added}
        self.cut = re.compile("(" + "|".join(re.escape(x) for x in sorted(self.added, key=len, reverse=True)) + ")")
        ranks = {bytes(map(byte.__getitem__, token)): i for token, i in vocabulary.items() if set(token) <= byte.keys() and token not in self.added}
        self.starts_word = np.zeros(max(ranks.values()) + 2, bool)
        self.starts_word[[i for token, i in ranks.items() if token[:1] == b" "]] = True
        self.ids = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.forget()

    def forget(self) -> None:
        self.keys, self.at, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.uint32)

    def _learn(self, keys: np.ndarray, chunks: list[str]) -> None:
        safe = np.array([bool(x) and not x[0].isspace() and not x[-1].isspace() for x in chunks], bool)
        ids = np.array(self.ids("".join(" " + x for x, ok in zip(chunks, safe) if ok)), np.uint32)
        first = np.flatnonzero(self.starts_word[ids])
        at, size = np.zeros(len(keys), np.int64), np.full(len(keys), -1, np.int64)
        at[safe], size[safe] = len(self.pool) + first, np.diff(first, append=len(ids))
        where = np.searchsorted(self.keys, keys)
        self.keys, self.at, self.size = np.insert(self.keys, where, keys), np.insert(self.at, where, at), np.insert(self.size, where, size)
        self.pool = np.concatenate([self.pool, ids])

    def _group(self, texts: list[str]) -> Iterator[bytes]:
        data = " ".join(texts).encode()
        b = np.frombuffer(data, np.uint8)
        gaps = np.flatnonzero(b == 32)
        starts, ends = np.concatenate([[0], gaps + 1]), np.concatenate([gaps, [len(b)]])
        keys, index, inverse = np.unique(slice_hashes(b, starts, ends), return_index=True, return_inverse=True)
        if len(self.keys) + len(keys) > CACHE_ENTRIES:
            self.forget()
        where = np.searchsorted(self.keys, keys)
        new = np.ones(len(keys), bool) if not len(self.keys) else self.keys[np.minimum(where, len(self.keys) - 1)] != keys
        if new.any():
            self._learn(keys[new], [data[starts[i] : ends[i]].decode() for i in index[new]])
        slot = np.searchsorted(self.keys, keys)[inverse]
        size = self.size[slot]
        last = np.cumsum([1 + x.count(" ") for x in texts])
        head = np.concatenate([[0], last[:-1]])
        size[head] = 0
        odd = np.add.reduceat(size < 0, head) > 0
        size = np.maximum(size, 0)
        to = np.cumsum(size)
        ids = self.pool[np.repeat(self.at[slot] - (to - size), size) + np.arange(to[-1])].astype("<u4", copy=False)
        for k, text in enumerate(texts):
            first = data[starts[head[k]] : ends[head[k]]].decode()
            if odd[k] or first[-1:].isspace():
                yield np.array(self.ids(text), "<u4").tobytes()
            else:
                yield np.array(self.ids(first), "<u4").tobytes() + ids[to[head[k]] : to[last[k] - 1]].tobytes()

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        group, held = [], 0
        for text in texts:
            group.append(text)
            held += len(text)
            if held > GROUP_CHARS:
                yield from self._group(group)
                group, held = [], 0
        if group:
            yield from self._group(group)

    def encode_added(self, texts: list[str]) -> Iterator[bytes]:
        parts = [self.cut.split(x) if any(a in x for a in self.added) else [x] for x in texts]  # text, token, text, ...
        ids = self.encode([x for row in parts for x in row[::2]])
        for row in parts:
            yield b"".join(self.added[x] if k % 2 else next(ids) for k, x in enumerate(row))


def encoder(path: str) -> PieceEncoder:
    if path not in _encoders:
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]


def token_pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: its id, its number of tokens, and the CRC-32 of each of its pieces in order. A null text is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(vocabulary), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            sizes, crcs = [], []
            for ids in enc.encode_added(texts):
                ids += end
                n = len(ids) // 4
                cuts = [0, *range((n - 1) % capacity + 1, n + 1, capacity)]
                sizes.append(n)
                crcs.append([zlib.crc32(ids[4 * a : 4 * b]) for a, b in zip(cuts, cuts[1:])])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(crcs, pa.list_(pa.int64()))], names=["id", "tokens", "crcs"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, tokens long, crcs array<long>")


def plan_patterns(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """Best-two-fit over a histogram of lengths from 1 to capacity: (lengths in one sequence, number of such sequences)."""
    left = [0] * (capacity + 1)
    free = 0  # bit l: pieces of length l are left
    for length, count in histogram.items():
        left[length] = count
        free |= (count > 0) << length

    def take(length: int) -> None:
        nonlocal free
        left[length] -= 1
        if not left[length]:
            free &= ~(1 << length)

    def give(length: int) -> None:
        nonlocal free
        left[length] += 1
        free |= 1 << length

    def longest(most: int) -> int:
        return (free & ((2 << most) - 1)).bit_length() - 1 if most > 0 else -1

    def tightest_two(most: int, least: int) -> tuple[int, int] | None:
        best, pair, a = least, None, longest(most - 1)
        while a > 0 and 2 * a > best:  # a is the longer one
            take(a)
            b = longest(min(a, most - a))
            give(a)
            if b > 0 and a + b > best:
                best, pair = a + b, (a, b)
                if best == most:
                    break
            a = longest(a - 1)
        return pair

    patterns = []
    while free:
        gap, items = capacity, []
        while (x := longest(gap)) > 0:
            take(x)
            items.append(x)
            gap -= x
        if gap and (pair := tightest_two(gap + items[-1], items[-1])):
            give(items.pop())
            for x in pair:
                take(x)
                items.append(x)
        times = 1 + min(left[x] // items.count(x) for x in set(items))
        for x in items:
            left[x] -= times - 1
            if not left[x]:
                free &= ~(1 << x)
        patterns.append((items, times))
    return patterns


def _places(patterns: list[tuple[list[int], int]]) -> tuple[dict[int, tuple[np.ndarray, ...]], int]:
    """By length: arrays of (first number, pieces of this length in the pattern, first sequence, offsets)."""
    found: dict[int, list] = {}
    used: dict[int, int] = {}
    sequence = 0
    for items, times in patterns:
        offsets: dict[int, list[int]] = {}
        at = 0
        for x in items:
            offsets.setdefault(x, []).append(at)
            at += x
        for x, where in offsets.items():
            found.setdefault(x, []).append((used.get(x, 0), len(where), sequence, where))
            used[x] = used.get(x, 0) + times * len(where)
        sequence += times
    out = {}
    for x, rows in found.items():
        first = np.cumsum([0, *(r[1] for r in rows)])[:-1]
        out[x] = tuple(np.array(c, np.int64) for c in ([r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows], first, [o for r in rows for o in r[3]]))
    return out, sequence


def pack(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are the end id alone. Repeated rows are packed as often as they occur. No
    rows give no rows. Columns other than the two named are not read.
    """
    spark = docs.sparkSession
    salts = min(max(64, int(spark.conf.get("spark.sql.shuffle.partitions"))), 256)
    pieces = token_pieces(docs, vocabulary, capacity, end_id, id_col, text_col)
    salt = F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), F.lit(salts)).cast("int")  # equal rows spread too; it is written, so it stays
    rows = written(pieces.withColumn("salt", salt), "token_pieces").withColumn("head", (F.col("tokens") - 1) % capacity + 1)
    counts = written(rows.groupBy("head", "salt").agg(F.count("*").alias("n")), "lengths")
    histogram = {r["head"]: r["n"] for r in counts.groupBy("head").agg(F.sum("n").alias("n")).collect()}  # at most capacity rows
    places, _ = _places(plan_patterns(histogram, capacity))
    before = dict(zip(sorted(histogram), np.cumsum([0, *(histogram[x] for x in sorted(histogram))]).tolist()))
    # at most capacity * salts rows
    offsets = counts.select("head", "salt", (F.sum("n").over(Window.partitionBy("head").orderBy("salt")) - F.col("n")).alias("skip"))
    numbered = (
        rows.withColumn("nth", F.row_number().over(Window.partitionBy("head", "salt").orderBy("id", "tokens", "crcs")))
        .join(F.broadcast(offsets), ["head", "salt"])
        .select("id", "tokens", "crcs", "head", (F.col("skip") + F.col("nth") - 1).alias("nth"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            head, nth, tokens = (batch.column(k).to_numpy() for k in ("head", "nth", "tokens"))
            sequence, offset = np.zeros(len(head), np.int64), np.zeros(len(head), np.int64)
            for x in np.unique(head):
                at = np.flatnonzero(head == x)
                start, many, first, where, offs = places[int(x)]
                k = np.searchsorted(start, nth[at], "right") - 1
                j = nth[at] - start[k]
                sequence[at], offset[at] = first[k] + j // many[k], offs[where[k] + j % many[k]]
            pieces = -(-tokens // capacity)
            row = np.repeat(np.arange(len(head)), pieces)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            whole = piece > 0
            unique = np.array([before[int(x)] for x in head], np.int64) + nth  # of the row
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id").take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(np.where(whole, head[row] + (piece - 1) * capacity, 0)), pa.array(np.where(whole, capacity, head[row])),
                    batch.column("crcs").flatten(), pa.array(np.where(whole, -(unique[row] << 20) - piece, sequence[row])), pa.array(np.where(whole, 0, offset[row])),
                ],
                names=["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return numbered.mapInArrow(run, f"id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long").withColumnRenamed("id", id_col)
