"""Items by their share of placeholders, and alignments against exhaustive search."""

import itertools
import random

import numpy as np
import pytest

from skyframe.llm import decontam
from tests.llm.test_operators import prose

NAMES = ["Anna", "Bob", "Carl", "Dave", "Eve", "Rita", "Otto", "Paul", "Quinn", "Sara", "Tom", "Uma", "Vera", "Will", "Xena", "Yann"]
UNITS = ["kg", "km", "hours", "euros"]


def item(rng, share):
    """Parts of a question: literal words and slots ("name", i), ("number", i), ("unit", word), about `share` of them slots."""
    parts, length = [], rng.randint(18, 40)
    while len(parts) < length:
        if rng.random() < share:
            parts += [("name", rng.randrange(6)), ("number", rng.randrange(50)), ("unit", rng.choice(UNITS))][: rng.choice([1, 3])]
        else:
            parts += prose(rng, 1).split()
    return parts


def text(parts, names, numbers):
    out = []
    for x in parts:
        if isinstance(x, str):
            out.append(x)
        else:
            out.append({"name": lambda v: names[v], "number": lambda v: str(numbers[v]), "unit": lambda v: v}[x[0]](x[1]) + ("," if x[0] == "unit" else ""))
    return " ".join(out) + "?"


@pytest.mark.parametrize(("share", "limit"), [*((x, decontam.INDEX_ROWS) for x in (0.0, 0.2, 0.4, 0.55, 0.7)), (0.55, 0), (0.7, 0)])
def test_recall_by_share_of_placeholders(spark, share, limit):
    """Nine in ten questions with other names and numbers are found, whatever the share; clean lists of the same types aren't."""
    rng = random.Random(int(share * 100))
    questions = [item(rng, share) for _ in range(60)]
    names, numbers = NAMES[:6], {i: i + 3 for i in range(50)}
    other, changed = NAMES[6:12], {i: 7 * i + 100 for i in range(50)}
    bench = spark.createDataFrame([(i, text(q, names, numbers)) for i, q in enumerate(questions)], "item_id long, text string")
    planted = [(i, f"{prose(rng, 25)}. {text(q, other, changed)} {prose(rng, 25)}") for i, q in enumerate(questions)]
    lists = [(1000 + i, " ".join(f"{rng.choice(NAMES)} {rng.randrange(90)} {rng.choice(UNITS)}," for _ in range(40)) + f" {prose(rng, 30)}") for i in range(40)]
    docs = spark.createDataFrame(planted + lists, "doc_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontam.contaminations(docs, bench, limit=limit).collect()}
    windows = decontam.item_windows(bench, decontam.common_words(bench)).filter(f"form != {decontam.LITERAL}").collect()
    cover = {i: {t for w in windows if w.item == i for t in range(w.pos, w.pos + w["size"])} for i in range(60)}
    possible = [i for i in range(60) if len(cover[i]) >= decontam.MIN_COVER]  # the others have hardly a word of their own
    assert len(possible) >= (54 if share < 0.6 else 40), (share, len(possible))
    assert sum((i, i) in found for i in possible) >= 0.9 * len(possible), (share, len(possible))
    assert all(d == i for d, i in found)


def test_mostly_placeholders(spark):
    bench = spark.createDataFrame([(1, "Anna 3 kg, Bob 4 kg, Carl 5 kg, Dave 6 kg, Eve 7 kg: who carries the most weight?"), (2, "Anna 3 kg, Bob 4 kg, Carl 5 kg, Dave 6 kg, Eve 7 kg, Finn 9 kg")], "item_id long, text string")
    rows = [
        (1, "Anna 3 kg, Bob 4 kg, Carl 5 kg, Dave 6 kg, Eve 7 kg: who carries the most weight?"),
        (2, "Rita 13 kg, Otto 24 kg, Paul 35 kg, Quinn 46 kg, Sara 57 kg: who carries the most weight?"),
        (3, "Rita 13 kg, Otto 24 kg, Paul 35 kg, Quinn 46 kg, Sara 57 kg, Tom 8 kg, Uma 9 kg, Vera 3 kg and some prose of its own."),
        (4, "Rita 13 kg, Otto 24 kg: who carries the most weight?"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for limit in (decontam.INDEX_ROWS, 0):
        found = {(r.doc_id, r.item_id) for r in decontam.contaminations(docs, bench, limit=limit).collect()}
        assert {(1, 1), (2, 1)} <= found and not {d for d, _ in found} & {3, 4}


def exhaustive(matches):
    """The most tokens that a consistent set of matches on one alignment covers."""
    best = 0
    by = {}
    for m in matches:
        by.setdefault(m[0] - m[1], []).append(m)
    for same in by.values():
        for n in range(len(same) + 1):
            for some in itertools.combinations(same, n):
                stands = {}
                if all(stands.setdefault(a, b) == b for m in some for a, b in zip(m[4], m[3])):
                    best = max(best, len({t for m in some for t in range(m[1], m[1] + m[2])}))
    return best


def test_alignments_against_exhaustive_search():
    """Without conflicts the covered tokens are those of the best alignment or more; conflicting slots are never joined."""
    rng = np.random.default_rng(6)
    for trial in range(300):
        clash = trial % 3 == 0
        matches = []
        for _ in range(rng.integers(1, 7)):
            p, shift = int(rng.integers(0, 12)), int(rng.choice([5, 5, 5, 7, 40]))
            a = int(rng.integers(0, 3))
            matches.append((p + shift, p, 8, [a + 100 if not clash else int(rng.integers(0, 3))], [a]))
        windows, covered, exact = decontam._aligned(matches)
        one = exhaustive(matches)
        assert covered >= one if not clash else covered >= 8
        assert windows <= len(set((m[0], m[1]) for m in matches)) and not exact or clash
        if len({m[0] - m[1] for m in matches}) == 1:
            assert covered <= one
