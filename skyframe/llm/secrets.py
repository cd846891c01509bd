"""Operator 7, secret scans: a linear-chain conditional random field after fixed patterns.

Tokens are runs of ASCII letters and digits, or single other characters. Each is tagged begin, inside
or outside of a secret from its word, shape, length, prefix, its neighbours' words and shapes, and two
features of the file. Plain words (letters only, shorter than PLAIN) that follow neither a sign nor, within REACH words, a word
that SPEAKS of secrets can only be outside, so the chain falls apart into segments around other words; Viterbi decodes
each segment whole, however long; one of more than LONG_CHAIN tokens in parts, whose memory is a few bytes a token.

There are no labelled secrets. The field is trained by gradient ascent on the segments of at most 2 * TRAIN_ROWS
documents (long ones in pieces of TRAIN_LENGTH tokens), at most TRAIN_SEGMENTS different ones (smallest hashes), tagged by the fixed patterns. So that it learns
more than the patterns themselves, each segment with a secret is also shown with its keyword replaced by another
word, and with its value replaced by one of another form; every other segment without one is also shown with a made-up
secret put in, so that its neighbours tell little; made-up secrets and look-alikes that are none come on top.
"""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
import zlib
from array import array
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import with_columns_from_text, written

# The base patterns, in the order of their kinds, and the least length of what they find.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 6, 20, 24
KEYWORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")

TRAIN_ROWS = 1500
TRAIN_SEGMENTS = 12_000
TRAIN_LENGTH = 128
MADE_UP = 600
PLAIN = 24
REACH = 3
CELLS_AT_ONCE = 20_000
LONG_CHAIN = 4_000  # tokens from which a chain is decoded in parts, with the same result
BLOCK_TOKENS = 10_000
# Words after which a plain word may be a secret.
SPEAKS = ("password", "passwd", "passphrase", "passcode", "pwd", "secret", "token", "api_key", "apikey", "credential", "credentials")
_BITS = 17
DIMENSIONS = 1 << _BITS
FEATURES = 16
SCHEMA = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, redacted string"
O, B, I = 0, 1, 2  # noqa: E741
_KINDS = ("assign", "access", "hex", "crf")
_TOKEN = re.compile(r"[A-Za-z0-9]+|[^\sA-Za-z0-9]")
_WORD = re.compile(r"\S+")
_TELLING = bytes(set(range(256)) - set(b"0123456789=_/+:\\@"))
_IS_TELLING = re.compile(r"[0-9=_/+:\\@]")
_LONG_WORD = re.compile(rb"[!-~]{%d}" % PLAIN)
_SPEAKS = re.compile("|".join(SPEAKS).encode(), re.I)
_HEX_CLASS = bytes(104 if 48 <= c <= 57 or 97 <= c <= 102 else 32 for c in range(256))


def base_spans(text: str, data: bytes) -> list[tuple[str, int, int, int, int]]:
    """(kind, start, end, start and end of the secret itself) by start, then kind."""
    found = []
    low = data.lower()
    if any(k.encode() in low for k in KEYWORDS):
        found += [("assign", *m.span(), *m.span(2)) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_ASSIGN]
    if b"AKIA" in data:
        found += [("access", *m.span(), *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= MIN_ACCESS]
    if b"h" * MIN_HEX in data.translate(_HEX_CLASS):
        found += [("hex", *m.span(), *m.span()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda x: (x[1], _KINDS.index(x[0])))


@lru_cache(100_000)
def _speaks(word: str) -> bool:
    return len(word) < 40 and word.strip("\"'`.,;:()[]{}<>=").lower() in SPEAKS


Chain = tuple[array, array]  # where tokens start and end


def _extend(chain: Chain, m: re.Match) -> None:
    for t in _TOKEN.finditer(m[0]):
        chain[0].append(m.start() + t.start())
        chain[1].append(m.start() + t.end())


def segments(text: str, data: bytes) -> list[Chain]:
    """Runs of tokens that may hold a secret, each with the plain word before and after it."""
    if not data.translate(None, _TELLING) and not _LONG_WORD.search(data) and not _SPEAKS.search(data):
        return []
    out: list[Chain] = []
    last_end, before, open_ = -1, None, 0
    for m in _WORD.finditer(text):
        word = m[0]
        if _IS_TELLING.search(word) or (len(word) >= PLAIN and word.isascii()):
            if not open_:
                out.append((array("i"), array("i")))
                if before and last_end != m.start():
                    _extend(out[-1], before)
            open_ = 1
            _extend(out[-1], m)
            if _speaks(word):
                open_ = REACH
        elif _speaks(word):
            if not open_:
                out.append((array("i"), array("i")))
            open_ = REACH
            _extend(out[-1], m)
        elif open_:
            _extend(out[-1], m)
            open_ = max(open_ - 1, 1 if out[-1][0] and text[out[-1][0][-1]] in "=:" else 0)
        before, last_end = m, m.end()
    return [c for c in out if c[0]]


def tokens_of(text: str, chain: Chain, first: int = 0, end: int | None = None) -> list[str]:
    return [text[a:b] for a, b in zip(chain[0][first:end], chain[1][first:end])]


@lru_cache(200_000)
def _own(token: str) -> tuple[int, int, int, int, int, bool]:
    """Hashes of a token's word, shape, length, prefix and make-up; whether it is a plain word."""
    short = token[:64]
    shape = re.sub(r"(.)\1+", r"\1", re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub("[0-9]", "0", short))))[:12]
    kinds = (any(c.islower() for c in short), any(c.isupper() for c in short), any(c.isdigit() for c in short), all(c in "0123456789abcdef" for c in short), min(4, 5 * len(set(short)) // len(short)))
    texts = (f"w{short.lower() if len(token) <= 12 else ''}", f"s{shape}", f"l{min(len(token), 50) if len(token) < 8 else min(len(token), 64) // 4}", f"p{short[:4] if len(token) > 6 else ''}", f"k{kinds}{min(len(token) // 8, 5)}")
    return *(zlib.crc32(x.encode()) for x in texts), token.isalpha() and len(token) < PLAIN


def _outside(tokens: list[str], plain: np.ndarray, state: tuple[str, int] = ("", 0)) -> tuple[np.ndarray, tuple[str, int]]:
    """Which tokens can only be outside: plain words that follow no sign and no word that speaks of secrets. state is that after the tokens before."""
    after, (last, left) = np.zeros(len(tokens), bool), state
    for k, t in enumerate(tokens):
        after[k] = left > 0 or last in _SIGNS
        left = REACH if t.lower() in SPEAKS else left - t[0].isalnum()
        last = t[0]
    return plain & ~after, (last, left)


_SIGNS = frozenset("=:\"'/+_-.@\\")


def _cells(tokens: list[str], file: tuple[int, int], before: int = 0, behind: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, FEATURES) cells of the weights, and which tokens are plain words; the first and last few tokens are only looked at from their neighbours."""
    number = {t: i for i, t in enumerate(dict.fromkeys(tokens))}
    own = [_own(t) for t in number]
    at = np.fromiter(map(number.__getitem__, tokens), np.int64, len(tokens))
    h = np.array([x[:5] for x in own], np.uint64).reshape(-1, 5)[at]
    n = len(h)
    around = np.zeros((n + 4, 5), np.uint64)
    around[2:-2] = h
    columns = [h, around[1:-3, :2], around[3:-1, :2], around[:-4, :1], around[4:, :1], h[:, 1:2] ^ (around[1:-3, :1] << np.uint64(7)), np.full((n, 1), file[0], np.uint64), h[:, 4:5] ^ np.uint64(zlib.crc32(b"%d" % file[1])), np.ones((n, 1), np.uint64), np.zeros((n, 1), np.uint64)]
    cells = np.concatenate(columns, 1)[before : n - behind, :FEATURES]
    slot = np.arange(cells.shape[1], dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    cells = ((cells ^ slot) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _BITS)
    return cells.astype(np.int32), np.array([x[5] for x in own], bool)[at][before : n - behind]


def _features(tokens: list[str], file: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Cells of a chain's tokens, and which can only be outside."""
    cells, plain = _cells(tokens, file)
    return cells, _outside(tokens, plain)[0]


def file_features(data: bytes) -> tuple[int, int]:
    """Whether the file speaks of secrets and assigns; its share of digits, in steps."""
    digits = sum(data.count(b"%d" % d) for d in range(10))
    return 2 * any(k.encode() in data.lower() for k in KEYWORDS) + (b"=" in data), min(3, 20 * digits // max(len(data), 1))


@dataclass
class Field:
    weights: np.ndarray  # (DIMENSIONS, 3)
    moves: np.ndarray  # (3, 3): from, to
    first: np.ndarray  # (3,)


_NEVER = np.float32(-1e4)


def _padded(chains: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    longest = max(len(c) for c, _ in chains)
    width = chains[0][0].shape[1]
    cells, there, plain = np.zeros((len(chains), longest, width), np.int32), np.zeros((len(chains), longest), bool), np.zeros((len(chains), longest), bool)
    for k, (c, p) in enumerate(chains):
        cells[k, : len(c)], there[k, : len(c)], plain[k, : len(c)] = c, True, p
    return cells, there, plain


def _emissions(field: Field, cells: np.ndarray, plain: np.ndarray) -> np.ndarray:
    e = field.weights[cells].sum(2)
    e[plain, 1:] = _NEVER
    return e


def _moves(field: Field) -> np.ndarray:
    m = field.moves.copy()
    m[O, I] = _NEVER
    return m


def viterbi(field: Field, chains: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """The likeliest tags of each chain."""
    cells, there, plain = _padded(chains)
    e, moves = _emissions(field, cells, plain), _moves(field)
    n, longest = there.shape
    score = e[:, 0] + field.first + np.array([0, 0, _NEVER])
    back = np.zeros((n, longest, 3), np.int8)
    for t in range(1, longest):
        step = score[:, :, None] + moves
        back[:, t] = step.argmax(1)
        score = np.where(there[:, t, None], step.max(1) + e[:, t], score)
        back[~there[:, t], t] = np.arange(3)
    tags = np.zeros((n, longest), np.int8)
    tags[:, -1] = score.argmax(1)
    rows = np.arange(n)
    for t in range(longest - 1, 0, -1):
        tags[:, t - 1] = back[rows, t, tags[:, t]]
    return [tags[k, : len(c)] for k, (c, _) in enumerate(chains)]


def _long_emissions(field: Field, text: str, chain: Chain, file: tuple[int, int]) -> np.ndarray:
    """Scores (tokens, 3) of a long chain, BLOCK_TOKENS at a time: features are never held for all of it."""
    n = len(chain[0])
    out, state = np.zeros((n, 3), np.float32), ("", 0)
    for at in range(0, n, BLOCK_TOKENS):
        before, end = min(2, at), min(at + BLOCK_TOKENS, n)
        behind = min(2, n - end)
        tokens = tokens_of(text, chain, at - before, end + behind)
        cells, plain = _cells(tokens, file, before, behind)
        plain, state = _outside(tokens[before : len(tokens) - behind], plain, state)
        out[at:end] = _emissions(field, cells[None], plain[None])[0]
    return out


def long_viterbi(field: Field, e: np.ndarray) -> np.ndarray:
    """viterbi() of one long chain by its scores.

    The chain is cut into about as many parts as a part has tokens. All parts go forward side by side, once from each tag that the token
    before may have; the parts' best scores are joined one after the other, and all parts are followed back side by side.
    """
    n, moves = len(e), _moves(field).astype(np.float64)
    size = math.isqrt(n - 1) + 1
    parts = -(-n // size)
    held = np.zeros((parts * size, 3))
    held[:n] = e
    held = held.reshape(parts, size, 3)
    there = (np.arange(parts * size) < n).reshape(parts, size)
    score = moves[None] + held[:, 0, None]  # (part, tag before it, tag)
    score[0] = held[0, 0] + field.first + np.array([0, 0, _NEVER])
    back = np.zeros((parts, size, 3, 3), np.int8)
    for t in range(1, size):
        step = score[:, :, :, None] + moves
        back[:, t] = np.where(there[:, t, None, None], step.argmax(2), np.arange(3))
        score = np.where(there[:, t, None, None], step.max(2) + held[:, t, None], score)
    best, from_ = score[0, 0], np.zeros((parts, 3), np.int64)
    for k in range(1, parts):
        joined = best[:, None] + score[k]
        from_[k], best = joined.argmax(0), joined.max(0)
    ends, begins = np.zeros(parts, np.int64), np.zeros(parts, np.int64)
    ends[-1] = best.argmax()
    for k in range(parts - 1, 0, -1):
        begins[k] = ends[k - 1] = from_[k, ends[k]]
    tags, now, rows = np.zeros((parts, size), np.int8), ends, np.arange(parts)
    for t in range(size - 1, -1, -1):
        tags[:, t] = now
        now = back[rows, t, begins, now]
    return tags.ravel()[:n]


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


def train_field(examples: list[tuple[np.ndarray, np.ndarray, np.ndarray]], steps: int = 60, rate: float = 0.3, penalty: float = 1e-4) -> Field:
    """Maximum conditional likelihood of tags, of (cells, plain, tags) chains, by Adagrad with forward-backward."""
    field = Field(np.zeros((DIMENSIONS, 3), np.float32), np.zeros((3, 3), np.float32), np.zeros(3, np.float32))
    if not examples:
        field.weights[:, O] = 1
        return field
    past = [np.full(x.shape, 1e-6, np.float32) for x in (field.weights, field.moves, field.first)]
    order = sorted(range(len(examples)), key=lambda k: len(examples[k][0]))
    packed = []
    for g in _groups([len(examples[k][0]) for k in order]):
        g = order[g.start : g.stop]
        cells, there, plain = _padded([(examples[k][0], examples[k][1]) for k in g])
        gold = np.zeros(there.shape, np.int64)
        for row, k in enumerate(g):
            gold[row, : len(examples[k][2])] = examples[k][2]
        packed.append((cells, there, plain, gold))
    for _ in range(steps):
        for cells, there, plain, gold in packed:
            e, moves = _emissions(field, cells, plain), _moves(field)
            n, longest = there.shape
            a, b = np.zeros((n, longest, 3), np.float32), np.zeros((n, longest, 3), np.float32)
            a[:, 0] = e[:, 0] + field.first + np.array([0, 0, _NEVER], np.float32)
            for t in range(1, longest):
                a[:, t] = np.where(there[:, t, None], _log_sum(a[:, t - 1, :, None] + moves, 1) + e[:, t], a[:, t - 1])
            for t in range(longest - 1, 0, -1):
                b[:, t - 1] = np.where(there[:, t, None], _log_sum(moves + (e[:, t] + b[:, t])[:, None], 2), b[:, t])
            z = _log_sum(a[:, -1], 1)
            p = np.exp(np.minimum(a + b - z[:, None, None], 0)) * there[..., None]
            g_e = -p
            rows, at = np.nonzero(there)
            g_e[rows, at, gold[rows, at]] += 1
            g_e[plain, 1:] = 0
            both = np.exp(np.minimum(a[:, :-1, :, None] + moves + (e + b)[:, 1:, None] - z[:, None, None, None], 0)) * there[:, 1:, None, None]
            g_m = -both.sum((0, 1))
            np.add.at(g_m, (gold[:, :-1][there[:, 1:]], gold[:, 1:][there[:, 1:]]), 1)
            flat = cells[rows, at].ravel()
            g_w = np.stack([np.bincount(flat, np.repeat(g_e[rows, at, k], cells.shape[2]), DIMENSIONS) for k in range(3)], 1)
            g_f = g_e[:, 0].sum(0)
            for x, g, s in zip((field.weights, field.moves, field.first), (g_w / n, g_m / n, g_f / n), past):
                g = (g - penalty * x).astype(np.float32)
                s += g * g
                x += rate * g / np.sqrt(s)
    return field


def _groups(lengths: list[int]) -> Iterator[range]:
    """Runs of chains, given in the order of their lengths, of at most CELLS_AT_ONCE tokens when padded (one chain may be longer)."""
    at = 0
    while at < len(lengths):
        end = at + 1
        while end < len(lengths) and (end + 1 - at) * lengths[end] <= CELLS_AT_ONCE:
            end += 1
        yield range(at, end)
        at = end


def _tags(chain: Chain, found: list[tuple]) -> np.ndarray:
    """Tags of a chain by spans whose last two fields are the start and end of a secret; of secrets one in the other, the outer counts."""
    outer: list[tuple[int, int]] = []
    for s, e in sorted({(x[-2], x[-1]) for x in found}, key=lambda x: (x[0], -x[1])):
        if not outer or e > outer[-1][1]:
            outer.append((s, e))
    out, last, i = np.zeros(len(chain[0]), np.int8), None, 0
    for k, (start, end) in enumerate(zip(*chain)):
        while i < len(outer) and outer[i][1] < end:
            i += 1
        hit = outer[i] if i < len(outer) and outer[i][0] <= start else None
        if hit:
            out[k] = I if hit == last else B
        last = hit
    return out


LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
NAMES = ("key", "auth", "credential", "bearer", "access", "pwd", "passphrase", "login", "private", "signature")


def _value(rng: random.Random) -> str:
    """A made-up value of another form than the patterns': mixed letters and digits, base 64, in groups, or a word."""
    draw = lambda n, of=LETTERS: "".join(rng.choices(of, k=n))
    forms = (
        lambda: draw(rng.randint(16, 48)), lambda: draw(rng.randint(3, 6)).lower() + rng.choice("_-") + draw(rng.randint(16, 44)), lambda: draw(rng.randint(20, 60), LETTERS + "+/") + "=" * rng.randint(0, 2),
        lambda: "-".join(draw(rng.randint(4, 8)) for _ in range(rng.randint(3, 5))), lambda: draw(2).lower() + draw(rng.randint(8, 20)) + "." + draw(rng.randint(16, 40)) + "." + draw(rng.randint(16, 44)), lambda: draw(rng.randint(8, 16), LETTERS + "!$%&*"),
    )
    return rng.choice(forms)()


def _disguised(tokens: list[str], tags: list[int], rng: random.Random) -> Iterator[tuple[list[str], list[int]]]:
    """A tagged chain with its keywords replaced, and with its values replaced."""
    other = [rng.choice(NAMES) if t.lower() in KEYWORDS and not tag else t for t, tag in zip(tokens, tags)]
    yield other, tags
    made: tuple[list[str], list[int]] = ([], [])
    for t, tag in zip(tokens, tags):
        if tag == O:
            made[0].append(t)
            made[1].append(O)
        elif tag == B:
            parts = _TOKEN.findall(_value(rng))
            made[0].extend(parts)
            made[1].extend([B] + [I] * (len(parts) - 1))
    yield made


def _made_up() -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Made-up secrets and, as often, look-alikes that are none, each in a line."""
    rng = random.Random(11)
    draw = lambda n, of=LETTERS: "".join(rng.choices(of, k=n))
    plain = (
        lambda: draw(5, "abcdefghij") + "@" + draw(6, "klmnop") + ".com", lambda: "+" + draw(11, "0123456789"), lambda: ".".join(draw(2, "123456789") for _ in range(4)), lambda: f"{draw(4, '0123456789')} {draw(4, '0123456789')} {draw(4, '0123456789')}",
        lambda: "https://" + draw(8, "abcdefg") + ".org/" + draw(6, "hijklm") + "/" + draw(12, "abcdefgh"), lambda: draw(2, "123456789") + ":" + draw(2, "123450"), lambda: "version 2.0", lambda: f"{draw(7, 'abcdefgh')}/{draw(6, 'ijklmn')}", lambda: draw(rng.randint(24, 40), "abcdefghijklmnopqrst"),
        lambda: f"20{draw(2, '012')}-{draw(2, '01')}-{draw(2, '012')}T{draw(2, '01')}:{draw(2, '0123')}", lambda: draw(rng.randint(4, 9), "aeioulnrst") + "_" + draw(rng.randint(4, 9), "aeioulnrst"), lambda: draw(rng.randint(3, 10), "0123456789"),
    )
    out = []
    for k in range(MADE_UP):
        value = _value(rng) if k % 2 else rng.choice(plain)()
        before = (rng.choice(NAMES) + rng.choice((" = ", ": ", "=", " is "))) if k % 4 == 1 else draw(6, "abcdefghijkl") + " "
        text = before + value + rng.choice((" ", ". ", "\n")) + draw(5, "mnopqrstuv")
        for chain in segments(text, text.encode()):
            cells, only = _features(tokens_of(text, chain), file_features(text.encode()))
            out.append((cells, only, _tags(chain, [(len(before), len(before) + len(value))] if k % 2 else [])))
    return out


def fit(docs: DataFrame, rows: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text") -> Field:
    """The field from up to `rows` documents that hold a keyword and as many others; null ids and texts are left out.

    The documents are those of the smallest hashes of ids, so ties need equal ids; of an id that repeats, all rows count.
    """
    low = F.lower("text")
    keyword = F.lit(False)
    for k in (*KEYWORDS, "akia"):
        keyword = keyword | low.contains(k)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("text is not null and id is not null")
    marked = written(texts.select("id", keyword.alias("keyword"), F.xxhash64("id").alias("h")), "keywords")
    picked = [marked.filter(cond).orderBy("h", "id").limit(rows).select("id") for cond in ("keyword", "not keyword")]
    sample = texts.join(F.broadcast(picked[0].union(picked[1]).distinct()), "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens, tags, files = [], [], []
            for text in batch.column("text").to_pylist():
                data = text.encode()
                found, file = base_spans(text, data), list(file_features(data))
                for chain in segments(text, data):
                    own = _tags(chain, found).tolist()
                    for i in range(0, len(own), TRAIN_LENGTH):
                        tokens.append(tokens_of(text, chain, i, i + TRAIN_LENGTH))
                        tags.append(own[i : i + TRAIN_LENGTH])
                        files.append(file)
            yield pa.RecordBatch.from_arrays([pa.array(tokens, pa.list_(pa.string())), pa.array(tags, pa.list_(pa.int32())), pa.array(files, pa.list_(pa.int32()))], names=["tokens", "tags", "file"])

    different = sample.mapInArrow(run, "tokens array<string>, tags array<int>, file array<int>").distinct().withColumn("h", F.xxhash64("tokens", "tags", "file"))
    chosen = [different.filter(cond).orderBy("h").limit(TRAIN_SEGMENTS // 2) for cond in ("exists(tags, t -> t > 0)", "not exists(tags, t -> t > 0)")]
    rng, examples = random.Random(17), []

    def example(tokens: list[str], tags: list[int], file: list[int]) -> None:
        examples.append((*_features(tokens, tuple(file)), np.array(tags)))

    for r in chosen[0].unionByName(chosen[1]).toArrow().sort_by("h").to_pylist():
        example(r["tokens"], r["tags"], r["file"])
        if not any(r["tags"]):
            if rng.random() < 0.5:
                parts, at = _TOKEN.findall(_value(rng)), rng.randint(0, len(r["tokens"]))
                example(r["tokens"][:at] + parts + r["tokens"][at:], r["tags"][:at] + [B] + [I] * (len(parts) - 1) + r["tags"][at:], r["file"])
        else:
            for tokens, tags in _disguised(r["tokens"], r["tags"], rng):
                example(tokens, tags, r["file"])
    for cells, plain, tags in examples:
        tags[plain] = O  # a plain word that can only be outside is never part of a replaced value
        tags[1:][(tags[1:] == I) & (tags[:-1] == O)] = B
    _own.cache_clear()
    pa.default_memory_pool().release_unused()
    return train_field(examples + _made_up())


def decode(texts: list[str], field: Field) -> list[list[tuple[int, int]]]:
    """The secrets (start, end) that the field finds in each text."""
    out: list[list[tuple[int, int]]] = [[] for _ in texts]

    def add(i: int, chain: Chain, tags: np.ndarray) -> None:
        first = np.flatnonzero(tags == B)
        last = np.flatnonzero((tags != O) & (np.append(tags[1:], O) != I))  # of runs that begin with B, as I never follows O
        out[i] += [(chain[0][a], chain[1][b]) for a, b in zip(first.tolist(), last.tolist())]

    chains = []
    for i, text in enumerate(texts):
        data = text.encode()
        if parts := segments(text, data):
            file = file_features(data)
            for chain in parts:
                if len(chain[0]) > LONG_CHAIN:
                    add(i, chain, long_viterbi(field, _long_emissions(field, text, chain, file)))
                else:
                    chains.append((i, chain, *_features(tokens_of(text, chain), file)))
    chains.sort(key=lambda x: len(x[2]))
    for g in _groups([len(c[2]) for c in chains]):
        own = chains[g.start : g.stop]
        for (i, chain, *_), tags in zip(own, viterbi(field, [(c[2], c[3]) for c in own])):
            add(i, chain, tags)
    return [sorted(x) for x in out]


def scan_secrets(docs: DataFrame, field: Field, text_col: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """`row` and `out` (SCHEMA) per row of docs.

    Base spans are whole matches of the fixed patterns; spans of the field (kind crf) that touch none of
    them are added. `redacted` is the text with every secret replaced by the mask, null where the text
    has none. A null text is empty. Repeats and ties are scanned alike.
    """

    def compute(texts: list[str | None]) -> list[pa.Array]:
        texts = [t or "" for t in texts]
        rows = []
        for text, more in zip(texts, decode(texts, field)):
            base = base_spans(text, text.encode())
            joined = [f"{k}:{s}:{e}" for k, s, e, *_ in base]
            starts, reach = [x[1] for x in base], list(itertools.accumulate((x[2] for x in base), max))
            free = lambda s, e: not (k := bisect_left(starts, e)) or reach[k - 1] <= s  # noqa: B023, E731
            added = [("crf", s, e, s, e) for s, e in more if free(s, e)]
            every = sorted(base + added, key=lambda x: (x[1], _KINDS.index(x[0])))
            redacted = None
            if every:
                parts, at = [], 0
                for *_, s, e in sorted(every, key=lambda x: x[3]):
                    if e > at:
                        parts += [text[at : max(s, at)], mask] if s >= at else []
                        at = e
                redacted = "".join(parts) + text[at:]
            n = [sum(x[0] == k for x in base) for k in _KINDS[:3]]
            rows.append((*n, hashlib.sha256(",".join(joined).encode()).hexdigest(), ",".join(f"{k}:{s}:{e}" for k, s, e, *_ in every), redacted))
        columns = list(zip(*rows)) or [()] * 6
        return [pa.array(c, k) for c, k in zip(columns, [pa.int64()] * 3 + [pa.string()] * 3)]

    return with_columns_from_text(docs, text_col, SCHEMA, compute)
