"""Operator 3, near-duplicate documents by bottom-k sketches from one hash function.

A document is its set of distinct n-word shingles, hashed to 64 bits. Documents with equal sets form
a class at once; only one set of each class goes on.

1. Sketch: the SKETCH smallest hashes of the set.
2. Inverted lists: of a sketch's values, ordered from rare to common by counts in 2**CELL_BITS cells,
   those are posted that make two documents with the least overlap share SHARED_LISTS of them. For
   sets of up to whole_size() shingles, whose sketches and whose partners' are whole, this bound is exact; for larger
   ones it is least_shared() of 64 values, which a pair at the very threshold misses with a chance below MISSED.
3. Lists of up to SHORT_LIST entries give the pairs that share SHARED_LISTS of them: a pair in fewer also
   shares a longer list. Longer ones give pairs with one leader a
   round, for ROUNDS rounds: the entry with the commonest values (the likeliest original of a group of
   copies) that isn't in an earlier leader's component. Entries in their leader's component need no pair.
   Of lists that still hold several components, those that are mostly strangers to each other (a phrase that
   many documents share) are cut into the lists of their entries' pairs of values, since two of them must meet in
   two lists; entries with the same lists are cut as one. What has SHORT_LIST entries or fewer then gives pairs. The others, and what stays long, are put together
   by their leader, and entries outside such a group's main component are compared with all of it, block by
   block: by the sketches of their unions first, then by full sets.
4. A pair goes on if the sketch of the union holds at least least_shared() (in proportion) shared values.
5. Exact Jaccard on the full sets verifies it.
6. Components: large stars and small stars in turn, a number of rounds logarithmic in the longest chain of links.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import written
from .words import LOWER, mix, shingles, words

SKETCH = 64
MISSED = 1e-7
SHARED_LISTS = 2
SHORT_LIST = 16
ROUNDS = 2
BLOCK = 200_000
BLOCK_ROWS = 500
STAR_ROUNDS = 200
FEW_EDGES = 1_000_000
CELL_BITS = 22
COMMON = 16


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct shingle hashes of a text, A-Z lower-cased. No words: none."""
    return shingles(words((text or "").encode().translate(LOWER))[2], size)


def sketches(docs: DataFrame, size: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n (set size), f1 and f2 (a 128-bit fingerprint of the set) and sketch of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, f1, f2, low = [], [], [], []
            for text in batch.column(1).to_pylist():
                s = shingle_set(text, size)
                n.append(len(s))
                f1.append(int(mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).view(np.int64)))
                f2.append(int(mix(s ^ np.uint64(0x14057B7EF767814F)).sum(dtype=np.uint64).view(np.int64)))
                low.append(s[:SKETCH].view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), pa.array(low, pa.list_(pa.int64()))], names=["id", "n", "f1", "f2", "sketch"])

    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), *T.StructType.fromDDL("n long, f1 long, f2 long, sketch array<long>")])
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


@lru_cache
def least_shared(percent: int) -> int:
    """Values of the union's sketch that two sets at this similarity share at least, but for a chance below MISSED."""
    p, chance = percent / 100, 0.0
    for k in range(SKETCH + 1):
        chance += comb(SKETCH, k) * p**k * (1 - p) ** (SKETCH - k)
        if chance > MISSED:
            return max(k, SHARED_LISTS)
    return SKETCH


def whole_size(percent: int) -> int:
    """The largest set all of whose partners have a whole sketch, as it has."""
    return SKETCH * percent // 100


def _few_components(edges: DataFrame) -> DataFrame:
    """components() of at most FEW_EDGES edges: every root hooks to the smallest one that it meets, and pointers jump until they rest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [x for x in batches if x.num_rows]
        if not held:
            return
        ends = pa.chunked_array([x.column(c) for c in (0, 1) for x in held]).combine_chunks().dictionary_encode()
        order = pc.sort_indices(ends.dictionary)
        rank = np.empty(len(order), np.int64)
        rank[order.to_numpy()] = np.arange(len(order))
        a, b = np.split(rank[ends.indices.to_numpy()], 2)
        parent = np.arange(len(order))
        while (parent[a] != parent[b]).any():
            np.minimum.at(parent, np.maximum(parent[a], parent[b]), np.minimum(parent[a], parent[b]))
            while (parent[parent] != parent).any():
                parent = parent[parent]
        nodes = ends.dictionary.take(order)
        yield pa.RecordBatch.from_arrays([nodes, nodes.take(pa.array(parent))], names=["node", "label"])

    kind = edges.schema["a"].dataType
    return written(edges.coalesce(1).mapInArrow(run, T.StructType([T.StructField("node", kind), T.StructField("label", kind)])), "labels")


def _lowest(links: DataFrame) -> DataFrame:
    """links (a, b) with low, the smallest b or a of each a."""
    return links.join(links.groupBy("a").agg(F.min("b").alias("low")), "a").withColumn("low", F.least("a", "low"))


def components(edges: DataFrame) -> DataFrame:
    """node and the smallest node it is connected with, for all nodes of edges (a, b).

    In a large star, every node links its larger neighbours to the smallest one; in a small star, it links its
    smaller neighbours and itself to the smallest. Distances shrink by half, so a chain of k links takes about
    log2(k) rounds. Ends when all edges point from a node to its component's smallest. Up to FEW_EDGES edges, which are
    counted first, are one task's work instead, with the same result.
    """
    edges = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct(), "edges")
    if edges.count() <= FEW_EDGES:
        return _few_components(edges)
    for _ in range(STAR_ROUNDS):
        ends = edges.select("a", F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("b").alias("a"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        unfinished = ends.groupBy("a").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 or (up = 1 and down = 1)")
        if unfinished.isEmpty():
            return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = written(_lowest(both).filter("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct(), "large_stars")
        small = _lowest(large).select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("low").alias("b")), F.struct("a", F.col("low").alias("b")))).alias("e")).select("e.*")
        edges = written(small.filter("a != b").distinct(), "small_stars")
    raise RuntimeError(f"links are left after {STAR_ROUNDS} rounds")


def _similar_sizes(a: str, b: str, percent: int):
    return (100 * F.least(a, b) >= percent * F.greatest(a, b))


def _likely(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b), those that may be linked by the sketch of their union."""
    at = lambda x: classes.select(F.col("key").alias(x), F.col("sketch").alias(f"s{x}"), F.col("n").alias(f"n{x}"))
    least = least_shared(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y, nx, ny in zip(*(batch.column(k).to_numpy(zero_copy_only=False) for k in ("sa", "sb", "na", "nb"))):
                x, y = x.view(np.uint64), y.view(np.uint64)
                union = np.union1d(x, y)
                if nx > len(x) or ny > len(y):  # beyond this, a sketch may lack values of its set
                    union = union[:SKETCH]
                shared = len(np.intersect1d(np.intersect1d(x, y, True), union, True))
                whole = nx == len(x) and ny == len(y)
                keep.append(100 * shared >= percent * len(union) if whole else shared * SKETCH >= least * len(union))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    kind = classes.schema["key"].dataType.simpleString()
    return pairs.join(at("b"), "b").join(at("a"), "a").select("a", "b", "sa", "sb", "na", "nb").mapInArrow(run, f"a {kind}, b {kind}")


def _verified(pairs: DataFrame, docs: DataFrame, size: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """Of pairs (a, b), those whose full sets have that Jaccard similarity. A leader stands at a: the sets of b travel."""
    kind = pairs.schema["a"].dataType.simpleString()

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingle_set(x, size).view(np.int64) for x in batch.column(1).to_pylist()], pa.list_(pa.int64()))], names=["key", "s"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("sa").to_numpy(zero_copy_only=False), batch.column("sb").to_numpy(zero_copy_only=False)):
                shared = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * shared >= percent * (len(x) + len(y) - shared))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    needed = pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    texts = docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("text")).join(needed, "key")
    full = written(texts.mapInArrow(sets, f"key {kind}, s array<long>"), "sets")
    at = lambda x: full.select(F.col("key").alias(x), F.col("s").alias(f"s{x}"))
    return pairs.join(at("b"), "b").join(at("a"), "a").select("a", "b", "sa", "sb").mapInArrow(run, f"a {kind}, b {kind}")


def _open(lists: DataFrame, labels: DataFrame) -> DataFrame:
    """The entries of lists with their components' labels, of lists that still hold two components or more."""
    placed = lists.join(labels.withColumnRenamed("node", "key"), "key", "left").withColumn("label", F.coalesce("label", "key"))
    placed = written(placed, "placed")
    several = placed.groupBy("v").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low != high").select("v")
    return written(placed.join(several, "v"), "open")


def _rest(groups: DataFrame, docs: DataFrame, size: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """Links (a, b) across components inside groups (lead, key, n, label).

    Entries outside a group's main component meet all its entries, in pairs of blocks of about BLOCK
    shingles and BLOCK_ROWS entries, so that a group of any size is split over tasks of bounded memory. Inside a block
    pair the sketches of all unions are compared in numpy, then the full sets of those that may be linked, and one link
    for each component that an entry reaches is returned.
    """
    least = least_shared(percent)
    kind = groups.schema["key"].dataType.simpleString()

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingle_set(x, size).view(np.int64) for x in batch.column(1).to_pylist()], pa.list_(pa.int64()))], names=["key", "s"])

    sizes = groups.groupBy("lead", "label").agg(F.count("*").alias("c"), F.sum("n").alias("n"))
    blocks = lambda n, c: F.greatest(F.ceil(n / BLOCK), F.ceil(c / BLOCK_ROWS)).cast("int")
    totals = sizes.groupBy("lead").agg(F.max(F.struct("c", "label", "n")).alias("most"), F.sum("n").alias("n"), F.sum("c").alias("c"))
    totals = totals.select("lead", F.col("most.label").alias("main"), blocks(F.col("n"), F.col("c")).alias("js"), blocks(F.col("n") - F.col("most.n"), F.col("c") - F.col("most.c")).alias("is")).filter("is > 0")
    placed = groups.join(written(totals, "group_sizes"), "lead")
    texts = docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("text")).join(groups.select("key").distinct(), "key")
    full = written(texts.mapInArrow(sets, f"key {kind}, s array<long>"), "group_sets")
    own = lambda n: F.expr(f"int(pmod(xxhash64(key), {n}))")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    minor = placed.filter("label != main").withColumn("i", own("is")).withColumn("j", every("js")).join(full, "key").select("lead", "i", "j", "key", "label", "s")
    member = placed.withColumn("j", own("js")).withColumn("i", every("is")).join(full, "key").select("lead", "i", "j", "key", "label", "s")

    def counts(own: np.ndarray, values: np.ndarray, dense: np.ndarray, first: np.ndarray, there: np.ndarray) -> np.ndarray:
        """How many of own's values each slice of dense, which starts at first, holds."""
        at = np.searchsorted(values, own)
        at = at[at < len(values)]
        at = at[np.isin(values[at], own)]
        there[at] = 1
        shared = np.add.reduceat(there[dense], first)
        there[at] = 0
        return shared

    def compare(x: pa.Table, y: pa.Table) -> pa.Table:
        found = []
        if x.num_rows and y.num_rows:
            xs, ys = ([s.view(np.uint64) for s in t["s"].to_numpy()] for t in (x, y))
            low = [s[:SKETCH] for s in ys]
            size, many = np.array([len(s) for s in ys]), np.array([len(s) for s in low])
            values, dense = np.unique(np.concatenate(low), return_inverse=True)
            first, there = np.cumsum(many) - many, np.zeros(len(values), np.int64)
            labels = np.array(y["label"].to_pylist(), object)
            keys = y["key"].to_pylist()
            for key, label, s in zip(x["key"].to_pylist(), x["label"].to_pylist(), xs):
                own = s[:SKETCH]
                shared = counts(own, values, dense, first, there)
                # of the union's sketch, at most SKETCH values and at least those that both sketches reach; none is missed by this
                worth = shared * SKETCH >= least * np.minimum(SKETCH, np.maximum(len(own), many))
                worth &= (100 * np.minimum(len(s), size) >= percent * np.maximum(len(s), size)) & (labels != label)
                reached = {}
                for k in np.flatnonzero(worth):
                    if labels[k] not in reached:
                        both = len(np.intersect1d(s, ys[k], assume_unique=True))
                        if 100 * both >= percent * (len(s) + len(ys[k]) - both):
                            reached[labels[k]] = (key, keys[k])
                found += reached.values()
        return pa.table({"a": pa.array([f[0] for f in found], x.schema.field("key").type), "b": pa.array([f[1] for f in found], x.schema.field("key").type)})

    by = ("lead", "i", "j")
    member = member.toDF(*member.columns)  # new column ids beside those of minor
    return minor.groupBy(*by).cogroup(member.groupBy(*by)).applyInArrow(compare, f"a {kind}, b {kind}")


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles, component_id (the smallest id reachable over links) and kept (it is its own) per row of docs.

    Null and empty texts, and texts without words, have no shingles and are linked with nothing. Rows
    that share an id are one document, linked by any of its texts. A row with a null id is not linked and has no
    component. No rows give no rows. Other columns are not read.
    """
    if not 50 <= percent <= 100:
        raise ValueError("percent must be from 50 to 100")
    enough, whole = least_shared(percent), whole_size(percent)
    held = written(sketches(docs, size, id_col, text_col), "sketches")
    some = held.filter("n > 0 and id is not null")
    members = written(some.groupBy("n", "f1", "f2").agg(F.min("id").alias("key")), "classes")
    key_kind = members.schema["key"].dataType.simpleString()
    # of sets of fewer than 4 shingles, only equal ones can reach 0.8
    least = next(n for n in range(1, 200) if 100 * n >= percent * (n + 1))
    classes = written(
        some.filter(F.col("n") >= least).join(members.select(F.col("key").alias("id"), "n", "f1", "f2"), ["id", "n", "f1", "f2"], "left_semi").select(F.col("id").alias("key"), "n", "sketch").dropDuplicates(["key", "n"]),
        "class_sketches",
    )
    cell = F.shiftrightunsigned("v", 64 - CELL_BITS)
    hot = classes.select(F.explode("sketch").alias("v")).groupBy(cell.cast("int").alias("c")).agg(F.count("*").alias("n")).filter(F.col("n") > COMMON).toArrow()  # at most 2 ** CELL_BITS rows
    hot_cell, hot_n = hot["c"].to_numpy(), hot["n"].to_numpy()
    order = np.argsort(hot_cell)
    hot_cell, hot_n = hot_cell[order], hot_n[order]

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = np.zeros(1 << CELL_BITS, np.int64)
        common[hot_cell] = hot_n
        for batch in batches:
            keep, values, posted = [], [], []
            for i, (n, s) in enumerate(zip(batch.column("n").to_pylist(), batch.column("sketch").to_numpy(zero_copy_only=False))):
                v = s.view(np.uint64)
                shared = -(-percent * n // 100) if n <= whole else enough * len(v) // SKETCH
                rare = v[np.lexsort((v, common[v >> np.uint64(64 - CELL_BITS)]))[: len(v) - shared + SHARED_LISTS]]
                values.append(rare.view(np.int64))
                keep += [i] * len(rare)
                posted += [len(rare)] * len(rare)
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(values) if values else np.zeros(0, np.int64)), batch.column("key").take(at), batch.column("n").take(at), pa.array(posted, pa.int32())], names=["v", "key", "n", "posted"])

    posted = written(classes.select("key", "n", "sketch").mapInArrow(post, f"v long, key {key_kind}, n long, posted int"), "postings")
    lists = posted.groupBy("v").agg(F.count("*").alias("m")).filter("m > 1")
    listed = written(posted.join(lists, "v"), "lists")
    short = listed.filter(F.col("m") <= SHORT_LIST)
    worth = listed.groupBy("key").agg((F.sum(F.log("m")) / F.max("posted")).alias("worth"))
    long = written(listed.filter(F.col("m") > SHORT_LIST).select("v", "key", "n").join(worth, "key"), "long_lists")
    other = short.select("v", F.col("key").alias("b"), F.col("n").alias("nb"))
    pairs = short.select("v", F.col("key").alias("a"), F.col("n").alias("na")).join(other, "v").filter(F.col("a") < F.col("b")).filter(_similar_sizes("na", "nb", percent))
    pairs = pairs.groupBy("a", "b").agg(F.count("*").alias("lists")).filter(F.col("lists") >= SHARED_LISTS).select("a", "b")

    def links(pairs: DataFrame) -> DataFrame:
        likely = written(_likely(pairs, classes, percent), "likely")
        return written(_verified(likely, docs, size, percent, id_col, text_col), "links")

    several = some.groupBy("id").agg(F.count_distinct("n", "f1", "f2").alias("sets")).filter("sets > 1").select("id")
    own = some.join(several, "id").join(members, ["n", "f1", "f2"]).select("id", "key").distinct()
    same = own.join(own.groupBy("id").agg(F.min("key").alias("a")), "id").select("a", F.col("key").alias("b")).filter("a != b")

    def joined(labels: DataFrame, new: DataFrame) -> DataFrame:
        """Labels once new links are there: what the earlier ones joined is one edge a node."""
        return components(labels.select(F.col("node").alias("a"), F.col("label").alias("b")).unionByName(new))

    labels = components(links(pairs).unionByName(written(same, "links")))
    leaders = first = None
    for _ in range(ROUNDS):
        placed = _open(long, labels)
        free = placed
        if leaders is not None:
            led = leaders.join(placed.select("v", F.col("key").alias("a"), "label"), ["v", "a"]).select("v", "label")
            free = placed.join(led, ["v", "label"], "left_anti")
        lead = free.groupBy("v").agg(F.max_by(F.struct("key", "n", "label"), F.struct("worth", F.xxhash64("key"))).alias("lead"))
        lead = written(lead.select("v", F.col("lead.key").alias("a"), F.col("lead.n").alias("na"), F.col("lead.label").alias("la")), "leaders")
        if lead.isEmpty():
            break
        first = lead.select("v", F.col("a").alias("lead")) if first is None else first
        leaders = lead.select("v", "a") if leaders is None else leaders.unionByName(lead.select("v", "a"))
        pairs = placed.withColumnsRenamed({"key": "b", "n": "nb", "label": "lb"}).join(lead, "v")
        pairs = pairs.filter("la != lb").filter(_similar_sizes("na", "nb", percent)).select("a", "b").distinct()
        labels = joined(labels, links(pairs))
    placed = _open(long, labels)
    if first is not None and not placed.isEmpty():
        # lists with as many components as half their entries
        far = placed.groupBy("v").agg(F.count("*").alias("m"), F.count_distinct("label").alias("c")).filter("2 * c >= m").select("v")
        groups = placed.join(far, "v", "left_anti").join(first, "v").select("lead", "key", "n")
        met = short.select("v", "key", "n").join(placed.select("key", "label").distinct(), "key")
        entries = placed.join(far, "v").groupBy("key", "n", "label", "worth").agg(F.sort_array(F.collect_list("v")).alias("vs"))  # of at most SKETCH values
        entries = written(entries.withColumn("bundle", F.unhex(F.sha2(F.concat_ws(",", F.col("vs").cast("array<string>")).cast("binary"), 256))), "entries")
        best = F.struct("worth", F.xxhash64("key").alias("h"), "key")
        bundles = entries.groupBy("bundle").agg(F.first("vs").alias("vs"), F.count("*").alias("m"), F.min("label").alias("low"), F.max("label").alias("high"), F.max(best).alias("lead"))
        two = F.flatten(F.transform("vs", lambda x, i: F.transform(F.slice("vs", i + 2, SKETCH), lambda y: F.struct(x.alias("v"), y.alias("w")))))
        cut = written(bundles.select("bundle", "m", "low", "high", "lead", F.explode(two).alias("p")).select("p.*", "bundle", "m", "low", "high", "lead"), "pairs_of_values")
        open_ = cut.groupBy("v", "w").agg(F.sum("m").alias("m"), F.min("low").alias("low"), F.max("high").alias("high"), F.max("lead").alias("lead")).filter("low != high")
        cut = written(cut.select("v", "w", "bundle").join(open_.select("v", "w", "m", F.col("lead.key").alias("lead")), ["v", "w"]), "cut_lists")
        small = cut.filter(F.col("m") <= SHORT_LIST).select("v", "w", "bundle").join(entries.select("bundle", "key", "n", "label"), "bundle")

        def strangers(entries: DataFrame, by: list[str]) -> DataFrame:
            """Pairs across components in lists of at most SHORT_LIST entries; lists of the same entries count once."""
            members = entries.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("key", "n", "label"))).alias("m")).select("m").distinct()
            apart = lambda x, y: (x["label"] != y["label"]) & (100 * F.least(x["n"], y["n"]) >= percent * F.greatest(x["n"], y["n"]))
            of = lambda x, i: F.transform(F.filter(F.slice("m", i + 2, SHORT_LIST), lambda y: apart(x, y)), lambda y: F.struct(x["key"].alias("a"), y["key"].alias("b")))
            return members.select(F.explode(F.flatten(F.transform("m", of))).alias("p")).select("p.*").filter("a != b")

        labels = joined(labels, links(strangers(met, ["v"]).unionByName(strangers(small, ["v", "w"])).distinct()))
        large = cut.filter(F.col("m") > SHORT_LIST).select("lead", "bundle").distinct().join(entries.select("bundle", "key", "n"), "bundle")
        groups = groups.unionByName(large.select("lead", "key", "n")).distinct()
        groups = groups.join(labels.withColumnRenamed("node", "key"), "key", "left").withColumn("label", F.coalesce("label", "key"))
        groups = written(groups, "groups")
        labels = joined(labels, written(_rest(groups, docs, size, percent, id_col, text_col), "links"))
    final = members.join(labels.withColumnRenamed("node", "key"), "key", "left").select("f1", "f2", F.col("n").alias("n_shingles"), F.coalesce("label", "key").alias("component_id"))
    final = written(final, "class_components")
    out = held.withColumnRenamed("n", "n_shingles").select("id", "n_shingles", "f1", "f2").join(final, ["n_shingles", "f1", "f2"], "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id"))
    return out.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(False)).alias("kept"))


def deduplicated(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, that stay when one document of each component is kept.

    Of rows that share an id, one stays: that with the smallest hash of all columns. A row with a null id goes if a
    row with an id has an equal set of shingles, or if another row with a null id has, as long as one stays; one without
    shingles stays.
    """
    marked = near_duplicates(docs, size, percent, id_col, text_col)
    gone = marked.filter(~F.col("kept") & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id")).distinct()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    known, nulls = rows.filter("id is not null"), rows.filter("id is null")
    repeated = written(known.groupBy("id").agg(F.count("*").alias("many")).filter("many > 1").select("id"), "repeated_ids")
    single = known.join(gone.unionByName(repeated), "id", "left_anti").select("row.*")
    first = F.min_by("row", F.xxhash64(F.to_json("row"))).alias("row")  # columns of any type, maps too
    again = known.join(repeated, "id").join(gone, "id", "left_anti").groupBy("id").agg(first).select("row.*")
    if nulls.isEmpty():
        return single.unionByName(again)
    sets = written(sketches(nulls.select(F.struct(F.monotonically_increasing_id().alias("k"), "row").alias("id"), "text"), size, "id", "text"), "sets_of_null_ids")
    bare = sets.filter("n = 0").select("id.row.*")
    others = sketches(known, size, "id", "text").select("n", "f1", "f2").distinct()
    lone = sets.filter("n > 0").join(others, ["n", "f1", "f2"], "left_anti").select("n", "f1", "f2", "id.row").groupBy("n", "f1", "f2").agg(first).select("row.*")
    return single.unionByName(again).unionByName(bare).unionByName(lone)
