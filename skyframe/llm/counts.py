"""Operator 11, token counts without token ids.

Byte-level BPE never merges across pre-tokens, so a text has the sum of its pre-tokens' numbers of pieces.
A task turns its texts into frequencies of pre-tokens, numbered in a block: as many texts as share up to
BLOCK_WORDS pre-tokens. Each block sends its pre-tokens once, by buckets of their hash; a bucket's task
counts the pieces of each distinct one once and answers every block; blocks join the answers to the
frequencies of their texts. The numbers carry the bucket, so the answers need no names.

A space between two characters that aren't white space is always where a pre-token starts, so a text is
counted by the chunks between its spaces, and each distinct chunk of a block is cut into pre-tokens once.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import written

LIMIT = 1024
BLOCK_WORDS = 1 << 19
BLOCK_CHARS = 1 << 24  # of pre-tokens
BLOCK_DOCS = 1 << 16
KNOWN_WORDS = 1 << 21  # whose counts a task keeps
LEAST_BUCKETS = 64
BLOCK_SHIFT = 32
# Fixed value: the byte-level pre-tokenizer's pattern. Its classes are the library's below UNLIKE; later characters depend on the version of Unicode.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
UNLIKE = re.compile("[^\x00-ɏ]")
_tokenizers: dict[str, PreTokens] = {}


class PreTokens:
    """The pre-tokens of a byte-level BPE tokenizer file, and their numbers of pieces by its library."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        before, added = file.get("pre_tokenizer") or {}, file.get("added_tokens") or []
        if file.get("normalizer") or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True) or file["model"].get("dropout"):
            raise ValueError("only byte-level BPE without normalizer and prefix space is supported")
        if any(x.get(flag) for x in added for flag in ("single_word", "lstrip", "rstrip")):
            raise ValueError("added tokens that stand alone or take white space are not supported")
        self.added = [x["content"] for x in added]
        self.cut = re.compile("|".join(re.escape(x) for x in sorted(self.added, key=len, reverse=True)) or "(?!)")
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.find = regex.compile(PATTERN).findall

    def words(self, text: str) -> list[str]:
        if UNLIKE.search(text):
            return [text[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(text)]
        return self.find(text)

    def pieces(self, words: list[str]) -> list[int]:
        return [len(x.ids) for x in self.library.encode_batch_fast(words, add_special_tokens=False)]


def pre_tokens(path: str) -> PreTokens:
    if path not in _tokenizers:
        _tokenizers[path] = PreTokens(path)
    return _tokenizers[path]


class Numbers(dict):
    """Numbers its keys as they come."""

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        return n


class Block:
    """Frequencies of pre-tokens of texts, and the pre-tokens by bucket: the number of a pre-token is place * buckets + bucket."""

    def __init__(self, own: PreTokens, buckets: int):
        self.own, self.buckets = own, buckets
        self.chunks, self.seen = Numbers(), 0
        self.code: dict[str, int] = {}
        self.places: list[list[str]] = [[] for _ in range(buckets)]
        self.chars = self.docs = 0
        # of chunks: pre-tokens in `flat` from `first`, `many` of them; -1: has white space at an end
        self.first, self.many, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32)

    def number(self, word: str) -> int:
        if (n := self.code.get(word)) is None:
            bucket = zlib.crc32(word.encode()) % self.buckets
            place = self.places[bucket]
            n = self.code[word] = len(place) * self.buckets + bucket
            place.append(word)
            self.chars += len(word)
        return n

    def _learn(self) -> None:
        """Cut the chunks that are new."""
        new = list(self.chunks)[self.seen :] if self.seen < len(self.chunks) else []
        if not new:
            return
        self.seen = len(self.chunks)
        many, flat, number = [], [], self.number
        for c in new:
            if not c or c[0].isspace() or c[-1].isspace():
                many.append(-1)
                continue
            words = self.own.words(" " + c)
            many.append(len(words))
            flat += map(number, words)
        size = np.array(many, np.int32)
        ends = np.cumsum(np.maximum(size, 0)) + len(self.flat)
        self.first = np.concatenate([self.first, ends - np.maximum(size, 0)])
        self.many = np.concatenate([self.many, size])
        self.flat = np.concatenate([self.flat, np.array(flat, np.int32)])

    def frequencies(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray, int]]:
        """Of each text: numbers of its pre-tokens, ascending; how often each occurs; and the number of added tokens in it."""
        counted, number, chunk = [], self.number, self.chunks.__getitem__
        for text in texts:
            parts, n_added = [text], 0
            if any(x in text for x in self.own.added):
                parts = self.own.cut.split(text)
                n_added = len(parts) - 1
            held = []
            for part in parts:
                if not part:
                    continue
                pieces = part.split(" ")
                ends = [pieces[0], *([" " + pieces[-1]] if len(pieces) > 1 else [])]
                if pieces[0] and not pieces[0][-1].isspace() and (len(pieces) == 1 or pieces[-1] and not pieces[-1][0].isspace()):
                    middle = Counter(pieces[1:-1])
                    n = len(middle)
                    held.append((part, np.fromiter(map(chunk, middle), np.int64, n), np.fromiter(middle.values(), np.int64, n), [number(w) for x in ends for w in self.own.words(x)]))
                else:
                    held.append((part, None, None, []))
            counted.append((held, n_added))
        self._learn()
        out = []
        for held, n_added in counted:
            codes, times = [], []
            for part, ids, often, ends in held:
                if ids is None or (self.many[ids] < 0).any():  # white space beside a space: cut the text as a whole
                    whole = Counter(map(number, self.own.words(part)))
                    codes.append(np.fromiter(whole, np.int64, len(whole)))
                    times.append(np.fromiter(whole.values(), np.int64, len(whole)))
                    continue
                many = self.many[ids]
                to = np.cumsum(many)
                codes += [self.flat[np.repeat(self.first[ids] - (to - many), many) + np.arange(to[-1] if len(to) else 0)], np.array(ends, np.int64)]
                times += [np.repeat(often, many), np.ones(len(ends), np.int64)]
            code, time = (np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for x in (codes, times))
            order = np.argsort(code, kind="stable")
            code, time = code[order], time[order]
            start = np.flatnonzero(np.diff(code, prepend=-1))
            out.append((code[start], np.add.reduceat(time, start) if len(start) else time, n_added))
        self.docs += len(texts)
        return out

    def full(self, words: int) -> bool:
        return len(self.code) >= words or self.chars >= BLOCK_CHARS or self.docs >= BLOCK_DOCS


def short_form(values: np.ndarray) -> bytes:
    """Numbers from 0: a byte each, and those from 255 again in full behind them."""
    large = values[values >= 255].astype("<u8")
    return np.minimum(values, 255).astype(np.uint8).tobytes() + large.tobytes()


def long_form(data: bytes, n: int) -> np.ndarray:
    out = np.frombuffer(data, np.uint8, n).astype(np.int64)
    out[out == 255] = np.frombuffer(data, "<u8", offset=n).astype(np.int64)
    return out


def _frequencies(docs: DataFrame, vocabulary: str, buckets: int, block_words: int, kind: str) -> DataFrame:
    """A row a text (bucket null), and a row for the pre-tokens of each bucket of each block (words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part, k = pre_tokens(vocabulary), TaskContext.get().partitionId(), 0
        block, id_type, names = Block(own, buckets), None, ["block", "id", "n_bytes", "n_added", "n_codes", "codes", "times", "bucket", "words", "sizes"]

        def rows(columns: dict, n: int) -> pa.RecordBatch:
            types = (pa.int64(), id_type, pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.string(), pa.binary())
            return pa.RecordBatch.from_arrays([columns[c] if c in columns else pa.nulls(n, t) for c, t in zip(names, types)], names=names)

        def dictionary() -> pa.RecordBatch:
            filled = [b for b, words in enumerate(block.places) if words]
            sizes = [np.fromiter(map(len, block.places[b]), np.int64).astype("<u4").tobytes() for b in filled]
            return rows({"block": pa.array([(part << BLOCK_SHIFT) + k] * len(filled), pa.int64()), "bucket": pa.array(filled, pa.int32()), "words": pa.array(["".join(block.places[b]) for b in filled], pa.string()), "sizes": pa.array(sizes, pa.binary())}, len(filled))

        for batch in batches:
            id_type = batch.column(0).type
            texts = [x or "" for x in batch.column(1).to_pylist()]
            found = block.frequencies(texts)
            n = len(texts)
            yield rows(
                {
                    "block": pa.array([(part << BLOCK_SHIFT) + k] * n, pa.int64()), "id": batch.column(0), "n_bytes": pa.array([len(x.encode()) for x in texts], pa.int64()), "n_added": pa.array([a for *_, a in found], pa.int64()), "n_codes": pa.array([len(c) for c, *_ in found], pa.int64()),
                    "codes": pa.array([short_form(np.diff(c, prepend=0)) for c, *_ in found], pa.binary()), "times": pa.array([short_form(t) for _, t, _ in found], pa.binary()),
                }, n,
            )
            if block.full(block_words):
                yield dictionary()
                block, k = Block(own, buckets), k + 1
        if block.code:
            yield dictionary()

    return docs.mapInArrow(run, f"block long, id {kind}, n_bytes long, n_added long, n_codes long, codes binary, times binary, bucket int, words string, sizes binary")


def _counted(dictionaries: DataFrame, vocabulary: str, buckets: int) -> DataFrame:
    """(block, bucket, counts): the pieces of each pre-token of a block's bucket, in their order. Each distinct pre-token of a bucket is counted once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, known = pre_tokens(vocabulary), {}
        for batch in batches:
            counts = []
            for words, sizes in zip(batch.column("words").to_pylist(), batch.column("sizes").to_pylist()):
                ends = np.cumsum(np.frombuffer(sizes, "<u4").astype(np.int64)).tolist()
                words = [words[a:b] for a, b in zip([0, *ends], ends)]
                new = [w for w in words if w not in known]
                if len(known) + len(new) > KNOWN_WORDS:
                    known, new = {}, words
                known.update(zip(new, own.pieces(new)))
                counts.append(short_form(np.fromiter(map(known.__getitem__, words), np.int64, len(words))))
            n_words = [len(x) // 4 for x in batch.column("sizes").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("block"), batch.column("bucket"), pa.array(n_words, pa.int64()), pa.array(counts, pa.binary())], names=["block", "bucket", "n_words", "counts"])

    by_bucket = dictionaries.repartition(buckets, "bucket").select("block", "bucket", "words", "sizes")
    return by_bucket.mapInArrow(run, "block long, bucket int, n_words long, counts binary")


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = LIMIT, block_words: int = BLOCK_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: the id, n_bytes, n_tokens, over_limit (more tokens than `limit`).

    Tokens are those of the tokenizer file with added tokens wherever a text holds them, and none put around it. Null and empty texts
    have none. Repeated rows and ids are rows of their own. No rows give no rows. Other columns aren't read.
    """
    buckets = max(LEAST_BUCKETS, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    kind = docs.schema[id_col].dataType.simpleString()
    made = written(_frequencies(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), vocabulary, buckets, block_words, kind), "pre_token_frequencies")
    counted = _counted(made.filter("bucket is not null"), vocabulary, buckets)

    def summed(key: tuple, texts: pa.Table, counts: pa.Table) -> pa.Table:
        pieces = np.zeros((int(max(counts.column("n_words").to_pylist(), default=0)), buckets), np.int64)
        for bucket, n, data in zip(*(counts.column(c).to_pylist() for c in ("bucket", "n_words", "counts"))):
            pieces[:n, bucket] = long_form(data, n)
        pieces = pieces.ravel()
        totals = [a + int(pieces[np.cumsum(long_form(c, n))] @ long_form(t, n)) if n else a for a, n, c, t in zip(*(texts.column(x).to_pylist() for x in ("n_added", "n_codes", "codes", "times")))]
        return pa.table([texts.column("id"), texts.column("n_bytes"), pa.array(totals, pa.int64()), pa.array([x > limit for x in totals], pa.bool_())], names=["id", "n_bytes", "n_tokens", "over_limit"])

    texts = made.filter("bucket is null").select("block", "id", "n_bytes", "n_added", "n_codes", "codes", "times")
    out = texts.groupBy("block").cogroup(counted.groupBy("block")).applyInArrow(summed, f"id {kind}, n_bytes long, n_tokens long, over_limit boolean")
    return out.withColumnRenamed("id", id_col)
