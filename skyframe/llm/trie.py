"""Operator 12, prefix trie of conversations, from padded matrices of turn ids.

Conversations, as sequences of 128-bit turn ids, are range-partitioned in lexicographic order (the
conversation's id last, so that equal ones spread too) and dealt into blocks of bounded size. A block is
a matrix padded to its longest conversation: numpy's lexsort orders it, column changes OR-ed along the row
mark where nodes start, and reduceat sums every depth. Only nodes on the path that a block's first row
shares with the row before it, or its last row with the row after, go on in other blocks. Blocks give
partial sums of these, which are recombined by node; sums over subtrees of such nodes are differences
of running sums over the nodes in preorder.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import range_sorted, running
from .tables import written

CELLS = 1 << 16  # of a block's matrix; a longer conversation is a block of its own
BLOCK_SHIFT = 32  # blocks are numbered by range, then in order
ID_BYTES = 16
BLOCK_ROWS = 16  # blocks in an Arrow batch

NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
PARTIAL = "block long, key binary, parent_key binary, bytes long, ends string"


def turn_id(role: Column, text: Column) -> Column:
    """128 bits that tell (role, text) pairs apart."""
    return F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary")))


def sequences(conversations: DataFrame) -> DataFrame:
    """(conv_id, ids, sizes) of each conversation in order of turn; rows of one turn by id; rows without conv_id are none's."""
    empty = F.lit("")
    role, text = F.coalesce(F.col("role"), empty), F.coalesce(F.col("text"), empty)
    turns = conversations.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.struct("turn", turn_id(role, text).alias("id"), F.octet_length(text).cast("long").alias("size")).alias("t"))
    grouped = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))  # nulls first; texts stay behind
    return grouped.select("conv_id", F.col("t.id").alias("ids"), F.col("t.size").alias("sizes"))


def rebuilt(seqs: DataFrame, step: int = 5, most: int = 9) -> DataFrame:
    """Conversation c as the first h turns of conversation c - c % step, then its own after its first h; h is CRC-32 of c, modulo `most`."""
    own = seqs.withColumn("h", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")).withColumn("donor", F.expr(f"conv_id - conv_id % {step}"))
    donors = seqs.select(F.col("conv_id").alias("donor"), F.col("ids").alias("d_ids"), F.col("sizes").alias("d_sizes"))

    def spliced(c: str) -> Column:
        head = F.when(F.col("h") > 0, F.slice(f"d_{c}", F.lit(1), F.greatest("h", F.lit(1))))
        tail = F.slice(c, F.col("h") + 1, F.size("ids"))
        return F.concat(F.coalesce(head, F.slice(c, F.lit(1), F.lit(0))), tail)

    return own.join(donors, "donor", "left").select("conv_id", spliced("ids").alias("ids"), spliced("sizes").alias("sizes"))


def shared(a: list[bytes], b: list[bytes]) -> int:
    """Length of the common prefix."""
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


BLOCK = "part int, block long, conv_ids binary, lens binary, ids binary, sizes binary, left int, right int, first binary, last binary"


def _blocks(seqs: DataFrame, cells: int) -> DataFrame:
    """Sequences in order, packed into one row a block.

    left and right are the prefix lengths shared with the conversation before and after. At the ends of a range they are -1, and
    first and last hold the ids of the conversation there.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        held, longest, k, left = [], 0, 0, -1

        def block(right: int) -> pa.RecordBatch:
            row = {
                "part": part, "block": (part << BLOCK_SHIFT) + k, "conv_ids": np.array([c for c, *_ in held], np.int64).tobytes(), "lens": np.array([len(ids) for _, ids, _ in held], np.int32).tobytes(),
                "ids": b"".join(b"".join(ids) for _, ids, _ in held), "sizes": np.array([x for *_, sizes in held for x in sizes], np.int64).tobytes(), "left": left, "right": right,
                "first": b"".join(held[0][1]) if left < 0 else None, "last": b"".join(held[-1][1]) if right < 0 else None,
            }
            return pa.RecordBatch.from_pylist([row], schema=kind)

        types = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
        kind = pa.schema([(c, types[t]) for c, t in map(str.split, BLOCK.split(", "))])
        for batch in batches:
            for conv, ids, sizes in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "ids", "sizes"))):
                if held and (len(held) + 1) * max(longest, len(ids), 1) > cells:
                    both = shared(held[-1][1], ids)
                    yield block(both)
                    held, longest, k, left = [], 0, k + 1, both
                held.append((conv, ids, sizes))
                longest = max(longest, len(ids))
        if held:
            yield block(-1)

    n = int(seqs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return seqs.repartitionByRange(n, "ids", "conv_id").sortWithinPartitions("ids", "conv_id").mapInArrow(run, BLOCK)


def _seams(blocks: DataFrame) -> DataFrame:
    """(block, to, both): the last block of each range, the first of the next, and what the rows there share; a row a range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cut = lambda x: [x[i : i + ID_BYTES] for i in range(0, len(x), ID_BYTES)]
            both = [-1 if y is None else shared(cut(x), cut(y)) for x, y in zip(*(batch.column(c).to_pylist() for c in ("last", "next")))]
            yield pa.RecordBatch.from_arrays([batch.column("block"), batch.column("to"), pa.array(both, pa.int32())], names=["block", "to", "both"])

    first = blocks.filter("left = -1").select("part", F.col("block").alias("to"), F.col("first").alias("next"))
    last = blocks.filter("right = -1").select("part", "block", "last")
    after = Window.orderBy("part")
    pairs = last.join(first, "part").select("block", "last", F.lead("to").over(after).alias("to"), F.lead("next").over(after).alias("next"))
    return pairs.mapInArrow(run, "block long, to long, both int")


def nodes_of_block(conv: np.ndarray, lens: np.ndarray, ids: bytes, sizes: np.ndarray, left: int, right: int) -> Iterator[dict[str, list]]:
    """By depth, the nodes of the trie of these conversations, in order.

    left, right: how many turns the first and last in order share with a conversation outside, -1 without one. Nodes
    that go on outside have a key; their sums hold only what lies in nodes that don't, and their ends are ids.
    """
    n, widest = len(conv), int(lens.max(initial=0))
    ids_of = np.frombuffer(ids, f"V{ID_BYTES}")
    halves = np.frombuffer(ids, ">u8").reshape(-1, 2)
    order = np.lexsort((halves[:, 1], halves[:, 0]))
    rank = np.zeros(len(order), np.int32)  # equal ids have equal ranks, in the order of the ids' bytes
    if len(order):
        ascending = halves[order]
        rank[order] = np.concatenate([[0], np.cumsum((ascending[1:] != ascending[:-1]).any(1))])
    matrix, at = np.full((n, widest), -1, np.int32), np.cumsum(lens) - lens
    cell = np.arange(widest) < lens[:, None]
    matrix[cell] = rank
    order = np.lexsort((conv, *matrix.T[::-1]))
    conv, lens, matrix, at = conv[order], lens[order], matrix[order], at[order]
    changed = np.ones((n, widest), bool)
    changed[1:] = np.logical_or.accumulate(matrix[1:] != matrix[:-1], axis=1)

    rows, starts = [np.arange(n)], [np.zeros(1, np.int64)]  # by depth: the rows that reach it; where nodes start among them
    for d in range(widest):
        r = np.flatnonzero(lens > d)
        rows.append(r)
        starts.append(np.flatnonzero(changed[r, d]))
    parents = [np.zeros(0, np.int64)]
    for d in range(1, widest + 1):
        parents.append(np.searchsorted(rows[d - 1][starts[d - 1]], rows[d][starts[d]], "right") - 1)
    outside = []
    for d in range(widest + 1):
        out = np.zeros(len(starts[d]), bool)
        out[:1] |= d <= left
        out[-1:] |= d <= right
        outside.append(out)
    counts = [np.diff(starts[d], append=len(rows[d])) for d in range(widest + 1)]
    last_bytes = [np.zeros(1, np.int64)] + [sizes[at[rows[d][starts[d]]] + d - 1] for d in range(1, widest + 1)]
    smallest = [np.minimum.reduceat(conv[rows[d]], starts[d]) for d in range(widest + 1)]

    def summed(values: np.ndarray, d: int) -> np.ndarray:
        """Sums over the children, which stand together, of the nodes at depth d - 1."""
        total = np.zeros(len(starts[d - 1]), np.int64)
        first = np.flatnonzero(np.diff(parents[d], prepend=-1))
        if len(first):
            total[parents[d][first]] = np.add.reduceat(values, first)
        return total

    children, leaves, saved = ([None] * (widest + 1) for _ in range(3))
    below = None
    for d in range(widest, -1, -1):
        zero = np.zeros(len(starts[d]), np.int64)
        inner = below is not None
        children[d] = summed((~outside[d + 1]).astype(np.int64), d + 1) if inner else zero
        leaves[d] = (summed(leaves[d + 1], d + 1) if inner else zero) + ((children[d] == 0) & ~outside[d])
        saved[d] = (summed(saved[d + 1], d + 1) if inner else zero) + np.where(outside[d], 0, (counts[d] - 1) * last_bytes[d])
        below = d

    keys: list[dict[int, bytes]] = []
    for d in range(widest + 1):
        found = {}
        for k in np.flatnonzero(outside[d]).tolist():
            row = rows[d][starts[d][k]]
            above = keys[d - 1][int(parents[d][k])] if d else b""
            found[k] = hashlib.sha256(above + (ids_of[at[row] + d - 1].tobytes() if d else b"")).digest()
        keys.append(found)
    text = conv.astype(str)
    for d in range(widest + 1):
        first = rows[d][starts[d]]
        ended = np.add.reduceat((lens[rows[d]] == d).astype(np.int64), starts[d]).tolist()  # they come first in their node
        ends = [",".join(text[a : a + e]) if e else "" for a, e in zip(first.tolist(), ended)]
        out = outside[d].tolist()
        up = parents[d].tolist() if d else [None] * len(first)
        yield {
            "conv_id": smallest[d].tolist(), "depth": [d] * len(first), "parent_conv_id": [None if p is None or outside[d - 1][p] else int(smallest[d - 1][p]) for p in up],
            "n_convs": counts[d].tolist(), "n_children": children[d].tolist(), "n_leaves": leaves[d].tolist(), "saved_tokens": saved[d].tolist(),
            "ends_sha256": [None if o else hashlib.sha256(e.encode()).hexdigest() for o, e in zip(out, ends)],
            "key": [keys[d].get(k) for k in range(len(first))], "parent_key": [None if p is None else keys[d - 1].get(p) for p in up],
            "bytes": last_bytes[d].tolist(), "ends": [e if o else None for o, e in zip(out, ends)],
        }


def _joined_hashes(partial: DataFrame) -> DataFrame:
    """(key, ends_sha256): the ids that blocks give for a node, block after block, hashed as one text that is never held whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            done = []
            for key, ends in zip(batch.column("key").to_pylist(), batch.column("ends").to_pylist()):
                if key != now:
                    if now is not None:
                        done.append((now, state.hexdigest()))
                    now, state, joint = key, hashlib.sha256(), ""
                if ends:
                    state.update((joint + ends).encode())
                    joint = ","
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done)], names=["key", "ends_sha256"])
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([state.hexdigest()])], names=["key", "ends_sha256"])

    return partial.select("key", "block", "ends").repartition("key").sortWithinPartitions("key", "block").mapInArrow(run, "key binary, ends_sha256 string")


def _recombined(partial: DataFrame) -> DataFrame:
    """Whole nodes (NODE and key) from the partial sums of blocks."""
    nodes = partial.groupBy("key").agg(
        F.first("parent_key").alias("parent_key"), F.first("depth").alias("depth"), F.first("bytes").alias("bytes"), F.min("conv_id").alias("conv_id"), F.min("block").alias("from"), F.max("block").alias("to"),
        *(F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")),
    )
    nodes = written(nodes, "split_nodes")
    children = nodes.filter("parent_key is not null").groupBy(F.col("parent_key").alias("key")).agg(F.count("*").alias("more"))
    parents = nodes.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))
    nodes = nodes.join(children, "key", "left").join(parents, "parent_key", "left").withColumn("n_children", F.col("n_children") + F.coalesce("more", F.lit(0)))
    nodes = written(nodes, "split_nodes_linked")
    # A node enters at its first block, after the nodes above it, and leaves at its last block, before others enter there.
    own_leaf, own_saved = F.when(F.col("n_children") == 0, 1).otherwise(0), (F.col("n_convs") - 1) * F.col("bytes")
    enter = nodes.select("key", F.col("from").alias("block"), F.lit(1).alias("enters"), "depth", own_leaf.alias("leaf"), own_saved.alias("saved"))
    leave = nodes.select("key", F.col("to").alias("block"), F.lit(0).alias("enters"), "depth", F.lit(0).alias("leaf"), F.lit(0).cast("long").alias("saved"))
    events = running(range_sorted(enter.unionByName(leave), ["block", "enters", "depth", "key"], "events"), {"leaves_before": F.col("leaf"), "saved_before": F.col("saved")})
    sign = F.when(F.col("enters") == 1, -1).otherwise(1)
    inside = events.groupBy("key").agg(F.sum(sign * F.col("leaves_before")).alias("leaves_in"), F.sum(sign * F.col("saved_before")).alias("saved_in"))
    whole = nodes.join(inside, "key").join(_joined_hashes(partial), "key")
    return whole.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", (F.col("n_leaves") + F.col("leaves_in")).alias("n_leaves"), (F.col("saved_tokens") + F.col("saved_in")).alias("saved_tokens"), "ends_sha256", "key")


def prefix_trie(seqs: DataFrame, cells: int = CELLS) -> DataFrame:
    """One row per node of the trie of sequences (conv_id, ids, sizes), the root among them: the columns of NODE.

    Each conv_id comes once. A conversation's ids and sizes, 24 bytes a turn, have to fit in a task; its texts needn't. Conversations
    without turns end at the root. No conversations give no nodes.
    """
    blocks = written(_blocks(written(seqs, "sequences"), cells), "blocks")
    seams = written(_seams(blocks), "seams")
    left = seams.filter("to is not null").select(F.col("to").alias("block"), F.col("both").alias("l"))
    right = seams.select("block", F.col("both").alias("r"))
    blocks = blocks.join(F.broadcast(left), "block", "left").join(F.broadcast(right), "block", "left")  # a row a range
    blocks = blocks.select("block", "conv_ids", "lens", "ids", "sizes", F.coalesce("l", "left").alias("left"), F.coalesce("r", "right").alias("right"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, conv, lens, ids, sizes, left, right in zip(*(c.to_pylist() for c in batch.columns)):
                arrays = np.frombuffer(conv, np.int64), np.frombuffer(lens, np.int32), ids, np.frombuffer(sizes, np.int64)
                for level in nodes_of_block(*arrays, left, right):
                    yield pa.RecordBatch.from_pydict(level | {"block": [block] * len(level["depth"])}, schema=kind)

    strings = {"ends_sha256": pa.string(), "key": pa.binary(), "parent_key": pa.binary(), "ends": pa.string()}
    columns = [x.split()[0] for x in f"{NODE}, {PARTIAL}".split(", ")]
    kind = pa.schema([(c, strings.get(c, pa.int64())) for c in columns])
    found = written(blocks.mapInArrow(run, f"{NODE}, {PARTIAL}"), "nodes", batch_rows=BLOCK_ROWS)
    split = written(_recombined(found.filter("key is not null")), "split_whole")
    result = [c for c in columns if c in NODE.replace(",", " ").split()]
    parents = split.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("of_parent"))
    under = found.filter("key is null and parent_key is not null").join(parents, "parent_key").withColumn("parent_conv_id", F.col("of_parent"))
    return found.filter("key is null and parent_key is null").select(result).unionByName(under.select(result)).unionByName(split.select(result))
