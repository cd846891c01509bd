"""Operators 11 to 13 against plain versions: nulls, empty and long texts, ties, repeats, empty tables, clashing columns, hot keys."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyframe.llm import counts, merkle, trie
from skyframe.llm.queries import vocabulary
from tests.llm import brute, brute_trie

WORDS = ["the", "The", "naïve", "straße", "don't", "we'll", "x1", "2024", "--", "((", "é", "日本語", "🙂", "a,b", "Ünder", "\x1c", "՘", "l'eau", "I'd", "''", "s's", " ", "ﬁ", "1,000.5", "A" * 30]


def odd_texts():
    rng = random.Random(21)
    gaps = [" "] * 12 + ["  ", "\n", "\n\n", " \n", "\t", " \t ", " ", "\r\n", "", "　"]
    made = ["".join(rng.choice(WORDS) + rng.choice(gaps) for _ in range(rng.randint(1, 60))) for _ in range(150)]
    fixed = [None, "", " ", "  ", "\n", "a", " a", "a ", "a  b", "<|endoftext|>", "x <|endoftext|> y", "<|endoftext|><|endoftext|>", " <|endoftext|>", "<|endoftext", "it's", "' s", "a" * 5000, "é" * 3000, " " * 3000, "word " * 4000, "\n".join(["line of words"] * 500), "tail\n", "\nhead"]
    return fixed + made + made[:5]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary())


@pytest.mark.parametrize("block_words", [1, 300, 1 << 19])
def test_token_counts_are_the_librarys(spark, library, block_words):
    texts = odd_texts()
    docs = spark.createDataFrame([(i if i % 9 else None, t, "k", 5) for i, t in enumerate(texts)], "doc_id long, text string, block string, n_tokens int")
    got = counts.count_tokens(docs.repartition(3), vocabulary(), limit=50, block_words=block_words)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    want = [(i if i % 9 else None, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in enumerate(texts)]
    assert sorted(map(str, ((r.doc_id, r.n_bytes, r.n_tokens) for r in got.collect()))) == sorted(map(str, want))
    assert all(r.over_limit == (r.n_tokens > 50) for r in got.collect())
    assert counts.count_tokens(docs.limit(0), vocabulary()).count() == 0


def test_long_texts_and_string_ids(spark, library):
    rng = random.Random(4)
    long_ = " ".join("".join(rng.choices("abcdefghij", k=rng.randint(1, 9))) for _ in range(400_000))
    docs = spark.createDataFrame([("a", long_), ("b", "z" * 300_000), ("c", None)], "id string, text string")
    got = {r.id: r.n_tokens for r in counts.count_tokens(docs, vocabulary(), id_col="id").collect()}
    assert got == {"a": len(library.encode(long_).ids), "b": len(library.encode("z" * 300_000).ids), "c": 0}


def test_short_forms_round_trip():
    for values in ([], [0], [254, 255, 256, 0, 1 << 40], list(range(300))):
        a = np.array(values, np.int64)
        assert counts.long_form(counts.short_form(a), len(a)).tolist() == values


def test_a_bucket_answers_every_block(spark):
    docs = spark.createDataFrame([(i, "alpha beta gamma alpha") for i in range(50)], "doc_id long, text string").repartition(5)
    made = counts._frequencies(docs.withColumnRenamed("doc_id", "id"), vocabulary(), 64, 2, "bigint").cache()
    words = made.filter("bucket is not null")
    assert words.select("block").distinct().count() >= 5 and words.groupBy("words").count().filter("count > 1").count() == 4  # alpha and " alpha"
    got = counts._counted(words, vocabulary(), 64).collect()
    assert {(r.n_words, r.counts) for r in got if r.bucket == zlib.crc32(b" alpha") % 64} == {(1, bytes([1]))}
    made.unpersist()


CONVS = "conv_id long, turn long, role string, text string, depth int, key string"


def conversations(seed, n, width, words):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        for t in range(rng.randint(1, width)):
            rows.append((c * 3 - 20, t, rng.choice(["user", "bot", None]), rng.choice(words), 1, "k"))
    return rows


@pytest.mark.parametrize("cells", [1, 9, 60, 1 << 16])
def test_trie_matches_the_plain_version(spark, cells):
    """Shared beginnings, hot conversations, ties of turns, nulls, conversations without a donor, negative ids."""
    rows = conversations(1, 60, 7, ["hi", "hi", "yes", None, "é"])
    rows += [(1000 + i, t, "user", f"same {t}", 0, None) for i in range(80) for t in range(5)]  # a third of all turns
    rows += [(2000, None, "user", "first", 0, ""), (2000, 1, "a", "x", 0, ""), (2000, 1, "b", "y", 0, ""), (2000, 1, "b", "y", 0, ""), (None, 0, "user", "nobody", 0, ""), (3001, 5, None, None, 0, "")]
    rows += [(4000, t, "user", "long", 0, "") for t in range(300)]
    df = spark.createDataFrame(rows, CONVS).repartition(4)
    got = sorted((tuple(r) for r in trie.prefix_trie(trie.rebuilt(trie.sequences(df)), cells).collect()), key=lambda r: (r[1], r[0]))
    assert got == brute_trie.trie([r[:4] for r in rows])


def test_trie_of_nothing_and_of_turnless_conversations(spark):
    df = spark.createDataFrame([], CONVS)
    assert trie.prefix_trie(trie.rebuilt(trie.sequences(df))).count() == 0
    # h of conversation 6 covers all its turns, and its donor isn't there
    c = next(c for c in range(1, 500) if c % 5 and zlib.crc32(str(c).encode()) % 9 >= 3)
    df = spark.createDataFrame([(c, 0, "user", "gone", 0, "")], CONVS)
    (root,) = trie.prefix_trie(trie.rebuilt(trie.sequences(df))).collect()
    assert tuple(root) == (c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())


def test_block_kernel_orders_its_rows():
    """Rows in any order give the same nodes."""
    rng = np.random.default_rng(2)
    turns = [hashlib.md5(bytes([i])).digest() for i in range(3)]
    seqs = [[turns[i] for i in rng.integers(0, 3, rng.integers(0, 5))] for _ in range(40)]

    def nodes(order):
        lens = np.array([len(seqs[i]) for i in order], np.int32)
        ids = b"".join(b"".join(seqs[i]) for i in order)
        made = trie.nodes_of_block(np.array(order, np.int64), lens, ids, np.arange(1, lens.sum() + 1) * 0 + 4, -1, -1)
        return [{k: v for k, v in level.items()} for level in made]

    assert nodes(list(range(40))) == nodes(rng.permutation(40).tolist())


MERKLE = "doc_id long, source string, lang string, n_chars int, text string, leaf string, root string, pos int"


def merkle_rows():
    rng = random.Random(9)
    rows = [(i, "hot" if i % 3 else rng.choice(["b", "a", "", None, "é", "z"]), rng.choice(["en", None]), i if i % 5 else None, rng.choice(["Text %d", "lower %d", "ÀB %d"]) % i if i % 7 else None) for i in range(700)]
    rows += [(900, "lone", "en", 1, "One")] + [(950 + i, "sixteen", "en", 1, "X") for i in range(16)] + [(980 + i, "more", "en", 1, "X") for i in range(17)]
    return [(*r, "l", "r", 1) for r in rows]


@pytest.mark.parametrize("height", [1, 3])
def test_manifest_matches_the_plain_version(spark, monkeypatch, height):
    """Spans of one level and of three; a hot source, null and empty sources, trees of 1, 16 and 17 leaves, null fields, columns of clashing names."""
    monkeypatch.setattr(merkle, "HEIGHT", height)
    monkeypatch.setattr(merkle, "SPAN", merkle.FAN**height)
    rows = merkle_rows()
    docs = spark.createDataFrame(rows, MERKLE).repartition(5)
    got = {r.doc_id: tuple(r) for r in merkle.manifest(docs, other_leaf=merkle.lowered_leaf()).collect()}
    want = brute.manifest([r[:5] for r in rows])
    assert got == want
    broken = [r for r in want.values() if not r[-1]]
    assert broken and all(zlib.crc32(str(r[0]).encode()) % 5 == 0 for r in broken)


def test_manifest_of_repeats_nulls_and_nothing(spark):
    docs = spark.createDataFrame([], MERKLE)
    assert merkle.manifest(docs).count() == 0
    rows = [(1, "a", "en", 1, "x")] * 3 + [(None, "a", "en", 1, "y"), (None, None, None, None, None)]
    got = merkle.manifest(spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars int, text string"), other_leaf=merkle.lowered_leaf()).collect()
    assert len(got) == 5 and all(r.verified for r in got) and len({r.leaf for r in got}) == 3 and len({r.root for r in got}) == 1
    same = [r.proof_sha256 for r in got if r.doc_id == 1]
    assert len(same) == 3 and len(set(same)) == 1  # their siblings are each other


def test_missing_nodes_are_the_fewest():
    """Coordinates asked for, with what the leaves give, make every proof; without any of them, none can be made whole."""
    rng = np.random.default_rng(3)
    for size in (1, 2, 16, 17, 255, 256, 257, 5000):
        leaves = [merkle.digest(str(i)) for i in range(size)]
        tree = [leaves]
        while len(tree[-1]) > 1:
            tree.append([merkle.digest("".join(tree[-1][i : i + 16])) for i in range(0, len(tree[-1]), 16)])
        for n in {1, min(3, size), min(40, size), size}:
            own = np.sort(rng.choice(size, n, replace=False))
            asked = [(level, int(p)) for level, places in merkle.missing(own, size) for p in places]
            assert len(asked) == len(set(asked))
            used = []
            levels, root = merkle.derive({int(p): leaves[p] for p in own}, size, lambda level, p: used.append((level, p)) or tree[level][p])
            assert sorted(used) == sorted(asked) and root == tree[-1][0]
            proofs = merkle.Proofs(levels)
            for p in own.tolist():
                siblings, q = "", p
                for level in tree[:-1]:
                    a = q // 16 * 16
                    siblings += "".join(x for i, x in enumerate(level[a : a + 16]) if a + i != q)
                    q //= 16
                assert proofs.siblings(p) == siblings and proofs.fold(leaves[p], p) == root
                assert size == 1 or proofs.fold(merkle.digest("other"), p) != root
            # no asked node is above or below another, or above an own leaf
            under = {(level, p // 16**level) for level in range(len(tree)) for p in own.tolist()}
            assert not under & set(asked)


def test_leaf_digest_tells_nulls_and_lengths_apart(spark):
    rows = [("a", "b"), ("ab", ""), (None, "ab"), ("-", "ab"), ("", None), ("é", "b")]
    df = spark.createDataFrame(rows, "x string, y string").select("x", "y", merkle.leaf_digest([F.col("x"), F.col("y")]).alias("h"))
    one = lambda v: "-" if v is None else f"{len(v.encode())}:{v}"
    assert [r.h for r in df.collect()] == [merkle.digest(one(x) + one(y)) for x, y in rows] and df.select("h").distinct().count() == 6
