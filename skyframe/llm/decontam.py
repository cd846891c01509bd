"""Operator 10, benchmark decontamination by template canonicalisation.

Words are runs of letters and digits, A-Z lower-cased. In a template, runs of numbers, of names and of units
become one typed placeholder each; a run ends with its sentence. A name is a capitalised word that isn't common,
wherever it stands: common are the FUNCTION_WORDS and the words that the benchmark itself has in lower case (its
MAX_COMMON commonest). Windows of WINDOW template tokens, half of them or more literal, are hash-joined with those of the
benchmark items (an item with fewer tokens is one window; one with fewer than MIN_ITEM has none, as it would match
any text). Matches of document and item are checked together: a slot value of the item must always stand for
the same value in the document. A document contains an item if consistent windows cover MIN_COVER template
tokens of it, or all of it if it is shorter. The windows are those of one alignment, or of several in order, each at
most WINDOW tokens off the one before (words were inserted or left out between them).

Where such windows can't cover enough of an item, as most of its tokens are placeholders, it also has windows of
MIN_COVER tokens (or of the whole item) of any make-up that hold LEAST_LITERALS literal words: one of them covers enough, and its
length, the types in their order and the slots make up for the few words. An item whose windows have fewer literal words is found verbatim only,
since any list would match it.

Beside its template, an item has its literal form, the words as they are: it finds copies whose template is mostly
placeholders, and copies in another case, by the same rules on words in place of template tokens.

The item windows are broadcast only if a count finds at most INDEX_ROWS of them. Beyond that, a
fixed-size bitmap of their hashes prefilters the document windows, which are then joined by a shuffle. Both ways
judge every text by itself.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import with_columns_from_text, written
from .words import mix, slice_hashes, windows, words

WINDOW = 8
MIN_ITEM = 4
MIN_COVER = 13
LEAST_LITERALS = 3
INDEX_ROWS = 500_000
MAX_COMMON = 1_000_000
BITMAP_BITS = 23
# Words taken for units.
UNITS = (
    "mm cm m km inch inches foot feet yard yards mile miles mg g kg gram grams kilogram kilograms ton tons pound pounds ounce ounces "
    "ml l liter liters litre litres gallon gallons second seconds minute minutes hour hours day days week weeks month months year years "
    "percent degrees dollar dollars euro euros cent cents meter meters metre metres kilometer kilometers kilometre kilometres mph kmh"
).split()
# Words that are no names where they start a sentence.
FUNCTION_WORDS = (
    "a about after again all also always an and another any are as at be because been before both but by can could did do does each either every few find for from "
    "give given had has have he her here his how i if in into is it its just let many may might more most much must my no not now of often on once one only or other our "
    "out over please question read say she should so some such suppose than that the their then there these they this those though through to two under until up use was we "
    "were what when where whether which while who whom whose why will with would yes yet you your "
    "der die das ein eine und oder wenn was wer wie wo warum welche welcher welches el la los las un una y o si que quien como donde por cual le les une et ou quand qui pourquoi quel quelle"
).split()

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_STOP = np.zeros(256, bool)
_STOP[list(b".!?:;")] = True
NUMBER, NAME, UNIT = (np.uint64(x) for x in (1, 2, 3))
TEMPLATE, LITERAL, SPARSE = 0, 1, 2


def _hashes(names: Iterable[str]) -> np.ndarray:
    found = []
    for x in names:
        b = np.frombuffer(x.encode(), np.uint8)
        found.append(slice_hashes(b, np.array([0]), np.array([len(b)]))[0])
    return np.sort(np.array(found, np.uint64))


_UNIT_HASHES = _hashes(UNITS)
_FUNCTION_HASHES = _hashes(FUNCTION_WORDS)


def _among(h: np.ndarray, known: np.ndarray) -> np.ndarray:
    return known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h


def _capital(b: np.ndarray, starts: np.ndarray) -> np.ndarray:
    first, second = b[starts], b[np.minimum(starts + 1, len(b) - 1)]
    return ((first >= 65) & (first <= 90)) | ((first == 0xC3) & (second >= 0x80) & (second <= 0x9E))


def template(data: bytes, common: np.ndarray = _FUNCTION_HASHES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Template tokens of UTF-8 bytes (word hashes, or NUMBER, NAME, UNIT), the hash of what each stands for, and the hashes of the words themselves."""
    starts, ends, h = words(data.translate(_FOLD))
    if not len(h):
        return h, h, h
    b = np.frombuffer(data, np.uint8)
    digits, stops, lines = (np.concatenate([[0], np.cumsum(mask)]) for mask in (_DIGIT[b], _STOP[b], b == 10))
    t = h.copy()
    capital = np.flatnonzero(_capital(b, starts))
    t[capital[~_among(h[capital], common)]] = NAME
    t[_among(h, _UNIT_HASHES)] = UNIT
    t[digits[ends] - digits[starts] == ends - starts] = NUMBER
    stopped = ((stops[starts[1:]] > stops[ends[:-1]]) & (starts[1:] - ends[:-1] > 1)) | (lines[starts[1:]] > lines[ends[:-1]])
    new = np.ones(len(t), bool)
    new[1:] = (t[1:] != t[:-1]) | (t[1:] > UNIT) | stopped
    run = np.flatnonzero(new)
    place = np.arange(len(t)) - np.repeat(run, np.diff(run, append=len(t)))
    return t[run], np.add.reduceat(h * (place.astype(np.uint64) * np.uint64(2) + np.uint64(1)), run), h


def form_windows(t: np.ndarray, n: int, form: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of windows of n tokens: of a template, those with literal words for half of them, or with LEAST_LITERALS in the sparse form; of words, all."""
    w = windows(t, n)
    if not len(w):
        return np.zeros(0, np.int64), w
    w = mix(w ^ np.uint64(n + (form << 8)))
    if form == LITERAL:
        return np.arange(len(w)), w
    literal = np.concatenate([[0], np.cumsum(t > UNIT)])
    enough = np.flatnonzero(literal[n:] - literal[:-n] >= (LEAST_LITERALS if form == SPARSE else (n + 1) // 2))
    return enough, w[enough]


def _slots(t: np.ndarray, raw: np.ndarray, p: int, n: int, form: int) -> list[int]:
    """What the placeholders of a window stand for; words stand for themselves."""
    return raw[p : p + n][t[p : p + n] <= UNIT].view(np.int64).tolist() if form != LITERAL else []


def common_words(benchmark: DataFrame, text_col: str = "text") -> np.ndarray:
    """Sorted hashes of the function words and of the words that items have in lower case."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.zeros(0, np.uint64)]
            for text in batch.column(0).to_pylist():
                data = (text or "").encode()
                starts, _, h = words(data.translate(_FOLD))
                if len(h):
                    found.append(h[~_capital(np.frombuffer(data, np.uint8), starts)])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64))], names=["h"])

    own = benchmark.select(text_col).mapInArrow(run, "h long").groupBy("h").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "h").limit(MAX_COMMON).select("h").toArrow()["h"].to_numpy().view(np.uint64)
    return np.union1d(own, _FUNCTION_HASHES)


def item_windows(benchmark: DataFrame, common: np.ndarray, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item, of (which of the texts of that id), form, tokens of the item in this form, size, pos, w and slots of each window. Null texts have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, cols = [], ([], [], [], [], [], [])
            for i, text in enumerate(batch.column("text").to_pylist()):
                t, raw, h = template((text or "").encode(), common)
                for form, tokens in ((TEMPLATE, t), (LITERAL, h)):
                    n = min(len(tokens), WINDOW)
                    if n < MIN_ITEM:
                        continue
                    found = form_windows(tokens, n, form)
                    if form == TEMPLATE and len(np.unique(found[0][:, None] + np.arange(n))) < min(MIN_COVER, len(tokens)):
                        sparse = min(len(tokens), MIN_COVER)
                        more = [(SPARSE, sparse, *x) for x in zip(*form_windows(tokens, sparse, SPARSE))]
                    else:
                        more = []
                    for form_, n_, p, w in [*((form, n, *x) for x in zip(*found)), *more]:
                        keep.append(i)
                        for c, x in zip(cols, (form_, len(tokens), n_, int(p), int(w.view(np.int64)), _slots(t, raw, p, n_, form_))):
                            c.append(x)
            at = pa.array(keep, pa.int64())
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("item").take(at), batch.column("of").take(at), *(pa.array(c, k) for c, k in zip(cols, kinds))], names=["item", "of", "form", "tokens", "size", "pos", "w", "slots"])

    schema = T.StructType([T.StructField("item", benchmark.schema[id_col].dataType), *T.StructType.fromDDL("of long, form int, tokens int, size int, pos int, w long, slots array<long>")])
    return benchmark.select(F.col(id_col).alias("item"), F.xxhash64(text_col).alias("of"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def _consistent(matches: Iterable[tuple], reach: int | None = None) -> tuple[int, int, bool]:
    """Windows, covered tokens and whether slots are unchanged of the matches that agree with those taken before them; with reach, those that follow the last taken in order."""
    stands: dict[int, int] = {}
    covered: set[int] = set()
    used: set[int] = set()  # tokens of the document: none counts twice
    seen: set[tuple] = set()
    last, exact = None, True
    for at, p, size, theirs, ours in matches:
        if reach is not None and last is not None:
            if at > last[0] + reach:
                break
            if (at, p) != last and (at <= last[0] or p <= last[1]) or abs((at - p) - (last[0] - last[1])) > WINDOW:
                continue
        tried = dict(stands)
        if all(tried.setdefault(a, b) == b for a, b in zip(ours, theirs)):
            stands, last = tried, (at, p)
            covered.update(range(p, p + size))
            used.update(range(at, at + size))
            seen.add((at, p))
            exact &= list(ours) == list(theirs)
    return len(seen), min(len(covered), len(used)), exact


def _aligned(matches: Iterable[tuple]) -> tuple[int, int, bool]:
    """Of matches (doc pos, item pos, size, doc slots, item slots) of a document and an item: windows and covered tokens of the best consistent alignment or chain of alignments, and whether its slots are unchanged."""
    by: dict[int, list[tuple]] = {}
    for m in matches:
        by.setdefault(m[0] - m[1], []).append(m)
    found = [_consistent(sorted(same, key=lambda m: (m[1], m[2]))) for same in by.values()]
    if len(by) > 1:
        ordered = sorted(itertools.chain(*by.values()), key=lambda m: (m[0], m[1], m[2]))
        reach = max(m[1] + m[2] for m in ordered) + WINDOW
        firsts = {m[0] - m[1]: k for k, m in reversed(list(enumerate(ordered)))}
        found += [_consistent(itertools.islice(ordered, k, None), reach) for k in firsts.values()]
    return max(found, key=lambda x: (x[1], x[2], x[0]))


def _judged(matches: dict[int, list[tuple]], tokens: dict[int, int]) -> tuple[float, int, bool] | None:
    """Coverage, windows and exactness of the best form of those that cover enough; None if none does."""
    found = []
    for form, own in matches.items():
        n, covered, exact = _aligned(own)
        if covered >= min(MIN_COVER, tokens[form]):
            found.append((covered / tokens[form], exact, n))
    if not found:
        return None
    coverage, exact, n = max(found)
    return coverage, n, exact


@dataclass
class DocumentWindows:
    """What is looked up of a document: windows of the items' sizes whose hashes the bitmap has."""

    common: np.ndarray
    sizes: list[tuple[int, int]]  # (form, size)
    bitmap: np.ndarray

    def of(self, text: str | None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(form, size, positions, hashes, template, what it stands for)."""
        if not hasattr(self, "_there"):
            self._there = np.unpackbits(self.bitmap).astype(bool)
        t, raw, h = template((text or "").encode(), self.common)
        for form, n in self.sizes:
            pos, w = form_windows(h if form == LITERAL else t, n, form)
            some = np.flatnonzero(self._there[w >> np.uint64(64 - BITMAP_BITS)])
            if len(some):
                yield form, n, pos[some], w[some], t, raw


@dataclass
class TemplateIndex:
    """Item windows sorted by hash, of a benchmark within INDEX_ROWS."""

    look: DocumentWindows
    w: np.ndarray
    item: np.ndarray
    pos: np.ndarray
    first: np.ndarray  # of the window's slots
    slots: np.ndarray
    tokens: np.ndarray  # (items, forms)
    ids: pa.Array  # by item
    same: np.ndarray  # the first item of the same id

    def search(self, text: str | None) -> list[tuple[int, int, float, bool]]:
        """(place in ids, windows, coverage, exact) of each item that the text contains."""
        found: dict[int, dict[int, list[tuple]]] = {}
        for form, n, pos, w, t, raw in self.look.of(text):
            low, high = np.searchsorted(self.w, w, "left"), np.searchsorted(self.w, w, "right")
            for k in np.flatnonzero(high > low):
                p = int(pos[k])
                slots = _slots(t, raw, p, n, form)
                for j in range(low[k], high[k]):
                    own = self.slots[self.first[j] : self.first[j + 1]].tolist()
                    found.setdefault(int(self.item[j]), {}).setdefault(form, []).append((p, int(self.pos[j]), n, slots, own))
        best: dict[int, tuple] = {}
        for i, matches in found.items():
            if judged := _judged(matches, self.tokens[i]):
                k = int(self.same[i])
                best[k] = max(best.get(k, judged), judged)
        return [(k, n, coverage, exact) for k, (coverage, n, exact) in sorted(best.items())]


def _lookup(items: DataFrame, common: np.ndarray) -> DocumentWindows:
    cells = items.select(F.shiftrightunsigned("w", 64 - BITMAP_BITS).cast("int").alias("c")).distinct().toArrow()["c"].to_numpy()  # at most 2 ** BITMAP_BITS
    present = np.zeros(1 << BITMAP_BITS, bool)
    present[cells] = True
    sizes = sorted((r["form"], r["size"]) for r in items.select("form", "size").distinct().collect())  # at most 2 * WINDOW + MIN_COVER
    return DocumentWindows(common, sizes, np.packbits(present))


def build_index(items: DataFrame, common: np.ndarray) -> TemplateIndex:
    table = items.orderBy("item", "of").toArrow()
    keys = list(zip(table["item"].to_pylist(), table["of"].to_pylist()))
    number = {x: k for k, x in enumerate(dict.fromkeys(keys))}
    first_of: dict = {}
    same = np.array([first_of.setdefault(x[0], k) for x, k in number.items()], np.int64)
    item = np.array([number[x] for x in keys], np.int64)
    first_row = np.unique(item, return_index=True)[1]
    w = table["w"].to_numpy().view(np.uint64)
    order = np.argsort(w, kind="stable")
    tokens = np.zeros((len(number), 3), np.int64)
    tokens[item, table["form"].to_numpy()] = table["tokens"].to_numpy()
    slots = [np.array(x, np.int64) for x in table["slots"].take(pa.array(order)).to_pylist()]
    first = np.cumsum([0, *(len(x) for x in slots)])
    ids = table["item"].combine_chunks().take(pa.array(first_row, pa.int64()))
    return TemplateIndex(_lookup(items, common), w[order], item[order], table["pos"].to_numpy()[order], first, np.concatenate([np.zeros(0, np.int64), *slots]), tokens, ids, same)


def _fingerprint(text_col: str) -> list:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return [F.xxhash64(text).alias("f1"), F.xxhash64(F.lit(7), text, F.length(text)).alias("f2")]


def _joined(docs: DataFrame, items: DataFrame, common: np.ndarray, text_col: str) -> DataFrame:
    """f1 and f2 (a text's fingerprint), item, n_windows, coverage and exact of each text and item in it, by a shuffle join of the windows that a bitmap lets through."""
    look = _lookup(items, common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, cols = [], ([], [], [])
            for i, text in enumerate(batch.column("text").to_pylist()):
                for form, n, pos, w, t, raw in look.of(text):
                    for p, x in zip(pos.tolist(), w.view(np.int64).tolist()):
                        keep.append(i)
                        for c, v in zip(cols, (p, x, _slots(t, raw, p, n, form))):
                            c.append(v)
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("f1").take(at), batch.column("f2").take(at), *(pa.array(c, k) for c, k in zip(cols, (pa.int32(), pa.int64(), pa.list_(pa.int64()))))], names=["f1", "f2", "dpos", "w", "dslots"])

    hits = docs.select(*_fingerprint(text_col), F.col(text_col).alias("text")).mapInArrow(run, "f1 long, f2 long, dpos int, w long, dslots array<long>").distinct()  # a repeated text counts once
    pairs = hits.join(items, "w").groupBy("f1", "f2", "item", "of").agg(F.collect_set(F.struct("form", "tokens")).alias("t"), F.collect_set(F.struct("form", "dpos", "pos", "size", "dslots", "slots")).alias("m"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, rows = [], []
            for i, (t, m) in enumerate(zip(batch.column("t").to_pylist(), batch.column("m").to_pylist())):
                by: dict[int, list[tuple]] = {}
                for form, *match in (x.values() for x in m):
                    by.setdefault(form, []).append(tuple(match))
                if judged := _judged(by, {x["form"]: x["tokens"] for x in t}):
                    keep.append(i)
                    rows.append(judged)
            at = pa.array(keep, pa.int64())
            coverage, n, exact = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in ("f1", "f2", "item")), pa.array(n, pa.int64()), pa.array(coverage, pa.float64()), pa.array(exact, pa.bool_())], names=["f1", "f2", "item", "n_windows", "coverage", "exact"])

    found = T.StructType([*T.StructType.fromDDL("f1 long, f2 long"), T.StructField("item", items.schema["item"].dataType), *T.StructType.fromDDL("n_windows long, coverage double, exact boolean")])
    best = F.max(F.struct("coverage", "n_windows", "exact")).alias("b")
    return written(pairs.mapInArrow(check, found).groupBy("f1", "f2", "item").agg(best).select("f1", "f2", "item", "b.n_windows", "b.coverage", "b.exact"), "contaminated_texts")


def _index_or_items(benchmark: DataFrame, item_col: str, text_col: str, limit: int) -> tuple[TemplateIndex | None, DataFrame, np.ndarray]:
    common = common_words(benchmark, text_col)
    items = written(item_windows(benchmark, common, item_col, text_col), "item_windows")
    return (build_index(items, common) if items.count() <= limit else None), items, common


def contaminations(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text", limit: int = INDEX_ROWS) -> DataFrame:
    """One row per row of docs and item that it contains: id, item id, n_windows, coverage of the item, exact (no slot changed).

    Null and empty texts, and an empty benchmark, give no rows. Every row of docs is judged by its own text, also where
    rows share an id or have none. Items that share an id are one item of several texts: the best covered one is
    given. Repeated items count once. Ids are of any type. Other columns are not read.
    """
    index, items, common = _index_or_items(benchmark, item_col, text_col, limit)
    if index is None:
        keyed = docs.select(F.col(id_col).alias("doc"), *_fingerprint(text_col))
        found = keyed.join(_joined(docs, items, common, text_col), ["f1", "f2"]).select("doc", "item", "n_windows", "coverage", "exact")
        return found.withColumnsRenamed({"doc": id_col, "item": item_col})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, *r) for i, text in enumerate(batch.column(1).to_pylist()) for r in index.search(text)]
            at, item, n, coverage, exact = zip(*rows) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), index.ids.take(pa.array(item, pa.int64())), pa.array(n, pa.int64()), pa.array(coverage, pa.float64()), pa.array(exact, pa.bool_())], names=["doc", "item", "n_windows", "coverage", "exact"])

    schema = T.StructType([T.StructField("doc", docs.schema[id_col].dataType), T.StructField("item", benchmark.schema[item_col].dataType), *T.StructType.fromDDL("n_windows long, coverage double, exact boolean")])
    found = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text")).mapInArrow(run, schema)
    return found.withColumnsRenamed({"doc": id_col, "item": item_col})


def without_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text", limit: int = INDEX_ROWS) -> DataFrame:
    """The rows of docs, all columns, whose own text contains no item of the benchmark; null and empty texts stay."""
    index, items, common = _index_or_items(benchmark, item_col, text_col, limit)
    if index is None:
        bad = _joined(docs, items, common, text_col).select("f1", "f2").distinct()
        rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), *_fingerprint(text_col))
        return rows.join(bad, ["f1", "f2"], "left_anti").select("row.*")
    found = with_columns_from_text(docs, text_col, "found boolean", lambda texts: [pa.array([bool(index.search(x)) for x in texts], pa.bool_())])
    return found.filter("not out.found").select("row.*")
