"""Operator 13, Merkle manifest of a dataset, proved by octopus multiproofs.

Each row is a leaf, the SHA-256 of its fields. The leaves of a group (a source) in the order of their
ids are the lowest level of the group's tree; FAN consecutive nodes of a level make one of the next.
The roots of the groups, ordered by group, make the tree of the whole dataset in the same way.

Leaves are numbered in one global order by ranges, so a group of any share of the rows is spread over
tasks. Spans of FAN ** HEIGHT leaves make HEIGHT levels in one task each, then spans of those nodes the
next levels. For the proofs, a span is a leaf partition: from its coordinates alone it computes the
minimal union of the nodes that its leaves' proofs need and its own leaves don't give, all spans fetch
theirs in one join, and each derives its shared interior nodes once and expands the proof of each leaf.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import numbered
from .tables import written

FAN = 16
HEIGHT = 3  # levels of a span
SPAN = FAN**HEIGHT
TOP = -1  # the tree over the groups' roots
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_digest(fields: Iterable[Column]) -> Column:
    """SHA-256 of each field's UTF-8 byte count, a colon and the field, or of a hyphen where it is null."""
    parts = []
    for c in fields:
        value = c.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def missing(positions: np.ndarray, size: int) -> Iterator[tuple[int, np.ndarray]]:
    """By level, the places of the nodes that leaves at `positions` (ascending) need to reach the root and don't give themselves."""
    level = 0
    while size > 1:
        runs = np.unique(positions // FAN)
        children = (runs[:, None] * FAN + np.arange(FAN)).ravel()
        yield level, np.setdiff1d(children[children < size], positions, assume_unique=True)
        positions, size, level = runs, -(-size // FAN), level + 1


def derive(known: dict[int, str], size: int, fetched: Callable[[int, int], str]) -> tuple[list[dict[int, str]], str]:
    """By level, the joined digests of each run that holds a known node; and the root."""
    levels, level = [], 0
    while size > 1:
        runs = {}
        for r in dict.fromkeys(p // FAN for p in known):
            runs[r] = "".join(known[p] if p in known else fetched(level, p) for p in range(r * FAN, min(r * FAN + FAN, size)))
        levels.append(runs)
        known = {r: digest(x) for r, x in runs.items()}
        size, level = -(-size // FAN), level + 1
    return levels, known[0]


def _siblings(run: str, at: int) -> str:
    return run[: 64 * at] + run[64 * at + 64 :]


class Proofs:
    """Proofs of leaves of one tree, and on through further levels in which that tree is one leaf."""

    def __init__(self, levels: list[dict[int, str]], then: Proofs | None = None, place: int = 0):
        self.levels, self.then, self.place = levels, then, place
        self.above: dict[tuple[int, int], str] = {}

    def siblings(self, p: int, level: int = 0) -> str:
        """Siblings of the node at p and of its ancestors; those of ancestors are joined once for all that share them."""
        if level == len(self.levels):
            return self.then.siblings(self.place) if self.then else ""
        run = p // FAN
        if (above := self.above.get((level, run))) is None:
            above = self.above[level, run] = self.siblings(run, level + 1)
        return _siblings(self.levels[level][run], p % FAN) + above

    def fold(self, leaf: str, p: int) -> str:
        """The root that follows from `leaf` at p and its siblings."""
        for runs in self.levels:
            run, at = runs[p // FAN], p % FAN
            leaf = digest(run[: 64 * at] + leaf + run[64 * at + 64 :])
            p //= FAN
        return self.then.fold(leaf, self.place) if self.then else leaf


def _climb(nodes: DataFrame, name: str) -> DataFrame:
    """All levels above the nodes (tree, level, pos, h, size) of level 0: written (tree, level, pos, h, size), size that of the level."""

    def span(key: tuple, table: pa.Table) -> pa.Table:
        tree, level, size = (table.column(c)[0].as_py() for c in ("tree", "level", "size"))
        known = dict(zip(table.column("pos").to_pylist(), table.column("h").to_pylist()))
        out = []
        for _ in range(HEIGHT):
            if size == 1:
                break
            runs: dict[int, list[str]] = {}
            for p in sorted(known):
                runs.setdefault(p // FAN, []).append(known[p])
            known = {r: digest("".join(x)) for r, x in runs.items()}
            size, level = -(-size // FAN), level + 1
            out += [(level, p, h, size) for p, h in known.items()]
        columns = [list(x) for x in zip(*out)] or [[]] * 4
        kinds = (pa.int32(), pa.int64(), pa.string(), pa.int64())
        return pa.table([pa.array([tree] * len(out), pa.int64()), *map(pa.array, columns, kinds)], names=["tree", "level", "pos", "h", "size"])

    made, base = [], nodes.filter("size > 1")
    largest = nodes.agg(F.max("size")).first()[0] or 0
    while largest > 1:
        step = written(base.groupBy("tree", F.expr(f"pos div {SPAN}")).applyInArrow(span, "tree long, level int, pos long, h string, size long"), f"{name}{len(made)}")
        made.append(step)
        base = step.filter(f"level = {HEIGHT * len(made)} and size > 1")
        largest = -(-largest // SPAN)
    out = nodes.select("tree", "level", "pos", "h", "size").limit(0) if not made else made[0]
    for step in made[1:]:
        out = out.union(step)
    return out


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, id_col: str = "doc_id", group_col: str = "source", other_leaf: Column | None = None) -> DataFrame:
    """One row per row: the id, leaf, subroot, root, proof_sha256, folded_root, verified.

    other_leaf gives the digest of what a row has become, or null where it is as it was: folded_root follows from
    it and the original siblings, verified tells whether that is the root. Nulls are fields of their own; null groups and ids come first;
    rows of one id are ordered by leaf; equal rows are as many leaves, whose proofs differ by place. No rows
    give no rows. Columns other than `fields` aren't read, so their names can't clash.
    """
    leaves = docs.select(
        F.col(group_col).alias("source"), F.col(id_col).alias("id"), leaf_digest(F.col(c) for c in fields).alias("leaf"),
        (F.lit(None).cast("string") if other_leaf is None else other_leaf).alias("other"),
    )
    leaves = numbered(written(leaves, "leaves"), ["source", "id", "leaf", "other"], "leaves_sorted", "g")
    groups = leaves.groupBy("source").agg(F.min("g").alias("start"), F.count("*").alias("size"))
    groups = written(numbered(groups, ["start"], "groups_sorted", "tree").select("source", "start", "size", "tree"), "groups")
    # a row for each group in each range: no key has more leaves than a range
    runs = leaves.select("part", "source").distinct().withColumnRenamed("source", "s").join(groups, F.col("s").eqNullSafe(F.col("source"))).select(F.col("part").alias("of_part"), "s", "start", "size", "tree")
    placed = leaves.join(runs, (F.col("part") == F.col("of_part")) & F.col("source").eqNullSafe(F.col("s")))
    placed = written(placed.select("tree", (F.col("g") - F.col("start")).alias("pos"), "size", "id", "leaf", "other"), "leaves_placed")

    nodes = _climb(placed.select("tree", F.lit(0).alias("level"), "pos", F.col("leaf").alias("h"), "size"), "levels")
    lone = placed.filter("size = 1").select("tree", F.lit(0).alias("level"), "pos", F.col("leaf").alias("h"), "size")
    subroots = nodes.filter("size = 1").unionByName(lone).select(F.col("tree").alias("pos"), "h")
    n_groups = groups.count()
    tops = written(subroots.select(F.lit(TOP).cast("long").alias("tree"), F.lit(0).alias("level"), "pos", "h", F.lit(n_groups).cast("long").alias("size")), "subroots")
    upper = _climb(tops, "top")
    found = (tops if n_groups == 1 else upper.filter("size = 1")).select("h").first()
    root = found[0] if found else None

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The coordinates that a span misses: of its own tree, and of the tree of groups."""
        for batch in batches:
            for tree, span, size in zip(*(batch.column(c).to_pylist() for c in ("tree", "span", "size"))):
                own = [(tree, level, x) for level, x in missing(np.arange(span * SPAN, min((span + 1) * SPAN, size)), size)]
                top = [(TOP, level, x) for level, x in missing(np.array([tree]), n_groups)]
                n = [len(x) for *_, x in own + top]
                column = lambda i: np.repeat([x[i] for x in own + top], n).astype(np.int64)
                if sum(n):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(sum(n), tree)), pa.array(np.full(sum(n), span)), pa.array(column(0)), pa.array(column(1).astype(np.int32)), pa.array(np.concatenate([x for *_, x in own + top]).astype(np.int64))],
                        names=["tree", "span", "of_tree", "level", "pos"],
                    )

    spans = groups.select("tree", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(size - 1) div {SPAN}"))).alias("span"), "size")
    asked = spans.mapInArrow(ask, "tree long, span long, of_tree long, level int, pos long")
    held = nodes.filter(f"level >= {HEIGHT}").unionByName(tops).unionByName(upper).select(F.col("tree").alias("of_tree"), "level", "pos", "h")
    fetched = written(asked.join(held, ["of_tree", "level", "pos"]), "fetched")

    def expand(key: tuple, leaves: pa.Table, fetched: pa.Table) -> pa.Table:
        tree, size = leaves.column("tree")[0].as_py(), leaves.column("size")[0].as_py()
        got = dict(zip(zip(*(fetched.column(c).to_pylist() for c in ("of_tree", "level", "pos"))), fetched.column("h").to_pylist()))
        pos, leaf, other = (leaves.column(c).to_pylist() for c in ("pos", "leaf", "other"))
        levels, subroot = derive(dict(zip(pos, leaf)), size, lambda level, p: got[tree, level, p])
        above, derived = derive({tree: subroot}, n_groups, lambda level, p: got[TOP, level, p])
        if derived != root:
            raise ValueError(f"span {key} doesn't lead to the manifest's root")
        proofs = Proofs(levels, Proofs(above), tree)
        folded = [derived if o is None else proofs.fold(o, p) for p, o in zip(pos, other)]
        n = len(pos)
        return pa.table(
            [leaves.column("id"), leaves.column("leaf"), pa.array([subroot] * n), pa.array([root] * n), pa.array([digest(proofs.siblings(p)) for p in pos]), pa.array(folded, pa.string()), pa.array([x == root for x in folded])],
            names=["id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"],
        )

    kind = docs.schema[id_col].dataType.simpleString()
    by_span = placed.withColumn("span", F.expr(f"pos div {SPAN}")).groupBy("tree", "span")
    out = by_span.cogroup(fetched.groupBy("tree", "span")).applyInArrow(expand, f"id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
    return out.withColumnRenamed("id", id_col)


def lowered_leaf(fields: tuple[str, ...] = FIELDS, id_col: str = "doc_id", text_col: str = "text") -> Column:
    """The leaf of rows whose text has been lower-cased (A-Z), where 5 divides the id's CRC-32; else null."""
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    other = leaf_digest(F.translate(text_col, capitals, capitals.lower()) if c == text_col else F.col(c) for c in fields)
    return F.when(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, other)
