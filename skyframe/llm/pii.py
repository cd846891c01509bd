"""Operator 2, personal data, in DataFrame functions only.

Regular expressions propose spans: the text is split at a pattern and the lengths of the gaps and of
the matches give every start in code points. Validators confirm them: ranges for addresses, Luhn for
cards, digit counts for telephone numbers, mod 97 for bank accounts (iban). Words in the CONTEXT
characters before a span raise its score. The base kinds stay whatever their score; the two further kinds,
iban and ssn, are added if they reach THRESHOLD.

The patterns are written so that they find what the plain ones find but never step back: parts are
possessive, and a run is entered at its start only (or where the last match ended).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import bound

CONTEXT = 40
BLOCK = 64
THRESHOLD = 0.7

_LOCAL = r"[A-Za-z0-9._%+-]"


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    hint: Column  # cheap test that a text without a match fails
    valid: object  # value -> boolean Column
    score: float  # of a valid span without context
    context: str  # raises the score by 0.3
    base: bool = True


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _mod_97(value: Column) -> Column:
    """ISO 7064: the first four characters go last, letters count from 10, the remainder is 1."""
    plain = F.replace(value, F.lit(" "), F.lit(""))
    moved = F.concat(F.substring(plain, 5, 64), F.substring(plain, 1, 4))
    step = lambda acc, c: F.when(c.between("0", "9"), (acc * 10 + F.ascii(c) - 48) % 97).otherwise((acc * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(F.filter(F.split(moved, ""), lambda c: c != ""), F.lit(0), step) == 1


def _kinds(text: Column) -> list[Kind]:
    octet = "^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"
    return [
        Kind("email", rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", text.contains("@"), lambda v: F.lit(True), 0.9, "mail|contact|write"),
        Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", text.rlike(r"[0-9]\.[0-9]"), lambda v: F.forall(F.split(v, r"\."), lambda p: p.rlike(octet)), 0.6, r"\bip\b|address|host|server"),
        Kind("card", r"[0-9](?:[ -]?[0-9])++", text.rlike(r"[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9]"), lambda v: F.length(_digits(v)).between(13, 19) & F.coalesce(F.call_function("luhn_check", _digits(v)), F.lit(False)), 0.7, "card|visa|credit|pay"),
        Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", text.contains("+"), lambda v: F.length(_digits(v)).between(9, 15), 0.6, "phone|call|tel|mobile|fax"),
        Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])", text.rlike("[A-Z]{2}[0-9]{2}"), _mod_97, 0.9, "iban|account|bank|konto|cuenta|compte", False),
        Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", text.rlike("[0-9]-[0-9]"), lambda v: ~v.rlike("^(?:000|666|9)|-00-|-0000$"), 0.5, "ssn|social|security", False),
    ]


def _proposed(text: Column, kind: Kind) -> Column:
    """Array of (s, e, v, near): start and end in code points, value, and the CONTEXT characters before each match, in order.

    A fold copies what it has gathered at every step, so gaps and matches are folded in blocks of BLOCK, and the blocks
    moved on by the lengths of those before: a text with very many matches takes time about in proportion to them.
    """
    pieces = F.arrays_zip(F.split(text, kind.pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(kind.pattern), 0).alias("hit"))
    spans = "array<struct<s: int, e: int, v: string, near: string>>"

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["hit"])
        near = F.right(F.concat(acc["tail"], x["gap"]), F.lit(CONTEXT))
        span = F.struct(start.alias("s"), end.alias("e"), x["hit"].alias("v"), near.alias("near"))
        after = F.struct(end.alias("at"), F.right(F.concat(near, x["hit"]), F.lit(CONTEXT)).alias("tail"), F.concat(acc["spans"], F.array(span)).alias("spans"))
        return F.when(x["hit"].isNull(), acc).otherwise(after)

    def block(p: Column, i: Column) -> Column:
        """Spans of the i-th block, counted from its start. A match has a character or more, so CONTEXT pieces before it are enough."""
        before = F.slice(p, F.greatest(i * BLOCK - CONTEXT, F.lit(0)) + 1, F.least(i * BLOCK, F.lit(CONTEXT)))
        tail = F.right(F.array_join(F.flatten(F.transform(before, lambda x: F.array(x["gap"], x["hit"]))), ""), F.lit(CONTEXT))
        return F.aggregate(F.slice(p, i * BLOCK + 1, F.lit(BLOCK)), F.struct(F.lit(0).alias("at"), tail.alias("tail"), F.expr(f"cast(array() as {spans})").alias("spans")), step)

    def joined(blocks: Column) -> Column:
        starts = F.aggregate(blocks, F.expr("cast(struct(0, array()) as struct<at: int, all: array<int>>)"), lambda acc, b: F.struct((acc["at"] + b["at"]).alias("at"), F.concat(acc["all"], F.array(acc["at"])).alias("all")), lambda acc: acc["all"])
        move = lambda b, at: F.transform(b["spans"], lambda x: F.struct((x["s"] + at).alias("s"), (x["e"] + at).alias("e"), x["v"].alias("v"), x["near"].alias("near")))
        return F.flatten(F.zip_with(blocks, starts, move))

    found = bound(pieces, lambda p: bound(F.transform(F.sequence(F.lit(0), F.floor((F.size(p) - 1) / BLOCK).cast("int")), lambda i: block(p, i)), joined))
    return F.when(kind.hint, found).otherwise(F.expr(f"cast(array() as {spans})"))


def _confirmed(kind: Kind) -> Column:
    return F.filter(kind.name, lambda x: kind.valid(x["v"]))


def _scored(kind: Kind, spans: Column) -> Column:
    def add(x: Column) -> Column:
        near = F.lower(x["near"]).rlike(kind.context)
        score = F.lit(kind.score) + F.when(near, 0.3).otherwise(0.0)
        return F.struct(F.lit(kind.name).alias("kind"), x["s"].alias("s"), x["e"].alias("e"), F.least(score, F.lit(1.0)).alias("score"))

    found = F.transform(spans, add)
    return found if kind.base else F.filter(found, lambda x: x["score"] >= THRESHOLD)


def find_personal_data(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs' columns as struct `row`, and `out`: n_email, n_ip, n_card, n_phone, base_sha256, spans, found.

    `found` is an array of (kind, s, e, score) by kind, then start, in code points with exclusive ends; `spans`
    is the same as text, and base_sha256 the hash of its base kinds. A null text is empty: no spans, and
    the hash of the empty string. Every row is searched by itself, so repeats and ties give the same.
    """
    held = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    text = F.col("text")
    kinds = _kinds(text)
    proposed = held.select("row", *(_proposed(text, k).alias(k.name) for k in kinds))
    valid = proposed.select("row", *(_confirmed(k).alias(k.name) for k in kinds))
    scored = valid.select("row", *(_scored(k, F.col(k.name)).alias(k.name) for k in kinds))
    joined = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"], x["e"])), ",")
    base = F.concat(*(F.col(k.name) for k in kinds if k.base))
    every = F.concat(*(F.col(k.name) for k in kinds))
    out = F.struct(
        *(F.size(k.name).cast("long").alias(f"n_{k.name}") for k in kinds if k.base),
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(every).alias("spans"),
        every.alias("found"),
    )
    return scored.select("row", out.alias("out"))
