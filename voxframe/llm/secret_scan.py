"""Secrets in text: fixed patterns, and candidate strings whose sliding-window entropy is high.

All of it is native. A text that no cheap test hits is not searched any further. Positions count code points.

Base patterns give spans of kind ``assign``, ``access`` and ``hex``: all matches from left to right without overlap;
those that are too short are dropped after the search, so that they still use up their place.

The method adds spans of kind ``entropy``: candidates are unbroken runs of at least ``MIN_RUN`` characters of a class
that mix digits with letters. A window slides over the run; as it moves, one character leaves and one enters, and the
count of each character and the sum of ``c * log2(c)`` over the counts are updated from those two alone. The run is a secret if the entropy of
some window reaches the limit of its class, and no pattern of the allow list covers it.

Defined results: null counts as empty; no span gives 0 counts, empty ``spans`` and the digest of the empty string;
repeated rows stay. Spans of different kinds may overlap; ``masked`` joins overlapping ones.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Base patterns as kind, pattern, least length of the whole match, least length of group 2.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 6, 20, 24
KINDS = ("assign", "access", "hex", "entropy")


@dataclass(frozen=True)
class CharClass:
    """Candidate strings of one class of characters and the entropy that makes a secret of one."""

    name: str
    #: Characters, as the inside of a regular expression's brackets, and one by one.
    inside: str
    alphabet: str
    bits: float


_DIGITS, _LOWER = "0123456789", "abcdefghijklmnopqrstuvwxyz"
CLASSES = (
    CharClass("hex", "0-9A-Fa-f", _DIGITS + "abcdefABCDEF", 3.0),
    CharClass("base64", "A-Za-z0-9+/_-", _DIGITS + _LOWER + _LOWER.upper() + "+/_-", 3.6),
)
MIN_RUN, WINDOW = 24, 20
#: Runs that are no secrets: identifiers in groups of five, digests behind their name, and examples.
ALLOWED = (
    r"^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$",
    r"(?i)example|sample|placeholder|x{8}",
    r"^[A-Za-z]*[0-9]{1,4}$",
    r"^(?:[A-Za-z0-9]{1,12}[/_-])+[A-Za-z0-9]{0,12}$",
)


NONE = "array<struct<start:int,end:int,rank:int>>"


def _spans(text: Column, pattern: str, kind: str, keep: Callable[[Column], Column]) -> Column:
    """Matches from left to right as (start, end, rank of the kind); ``keep`` decides on the matched string."""
    # Each match with the text before it; the text behind the last one has no match. Both arrays are made once.
    pieces = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda gap, hit: F.struct(F.length(gap).alias("gap"), hit.alias("hit")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(NONE).alias("out"))

    def step(s: Column, piece: Column) -> Column:
        begin = s["at"] + piece["gap"]
        end = begin + F.coalesce(F.length(piece["hit"]), F.lit(0))
        one = F.array(F.struct(begin.alias("start"), end.alias("end"), F.lit(KINDS.index(kind)).alias("rank")))
        return F.struct(end.alias("at"), F.when(F.coalesce(keep(piece["hit"]), F.lit(False)), F.concat(s["out"], one)).otherwise(s["out"]).alias("out"))

    return F.when(text.rlike(pattern), F.aggregate(pieces, start, step, lambda s: s["out"])).otherwise(F.array().cast(NONE))


def window_entropy(run: Column, alphabet: str, window: int = WINDOW) -> Column:
    """Largest Shannon entropy in bits of any window of ``run``; of the whole run if that is shorter.

    The state is the count of each character of the alphabet, the sum of c * log2(c), and the least such sum so far.
    """
    size = F.least(F.length(run), F.lit(window))
    terms = F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(window + 1)])
    places = F.transform(F.split(run, ""), lambda c: F.instr(F.lit(alphabet), c))
    # Of each step: the place of the character that enters and of the one that leaves, 0 while the window fills.
    moves = F.zip_with(places, F.concat(F.array_repeat(F.lit(0), size), places), lambda a, b: F.struct(a.alias("enters"), b.alias("leaves")))
    start = F.struct(F.array_repeat(F.lit(0), len(alphabet) + 1).alias("counts"), F.lit(0.0).alias("sum"), F.lit(1e9).alias("least"), F.lit(0).alias("steps"))

    def step(s: Column, move: Column) -> Column:
        enters, leaves = move["enters"], move["leaves"]
        had, lost = F.get(s["counts"], enters), F.get(s["counts"], leaves)
        change = F.get(terms, had + 1) - F.get(terms, had) + F.when(leaves > 0, F.get(terms, lost - 1) - F.get(terms, lost)).otherwise(0.0)
        counts = F.transform(s["counts"], lambda c, k: c + (k == enters).cast("int") - (k == leaves).cast("int"))
        total = s["sum"] + F.when(enters == leaves, 0.0).otherwise(change)
        moved = F.struct(counts.alias("counts"), total.alias("sum"), F.when(s["steps"] >= size - 1, F.least(s["least"], total)).otherwise(s["least"]).alias("least"), (s["steps"] + 1).alias("steps"))
        return F.when(enters.isNull(), s).otherwise(moved)

    return F.log2(size.cast("double")) - F.aggregate(moves, start, step, lambda s: s["least"]) / size


def _is_secret(run: Column, kind: CharClass, window: int, allowed: Sequence[str]) -> Column:
    mixed = run.rlike("[0-9]") & run.rlike("[A-Za-z]")
    for pattern in allowed:
        mixed = mixed & ~run.rlike(pattern)
    return mixed & (F.length(run) >= MIN_RUN) & F.when(mixed, window_entropy(run, kind.alphabet, window) >= kind.bits).otherwise(False)


def spans(text: Column, *, classes: Sequence[CharClass] = CLASSES, window: int = WINDOW, allowed: Sequence[str] = ALLOWED) -> tuple[Column, Column]:
    """Base spans and added spans of a text that is not null, as arrays of (start, end, rank of the kind)."""
    group2 = lambda m: F.regexp_extract(m, ASSIGN, 2)
    # A run of these classes is taken whole, so asking for its least length at once finds the same spans.
    assign = _spans(text, ASSIGN, "assign", lambda m: F.length(group2(m)) >= MIN_ASSIGN)
    access = _spans(text, ACCESS[:-1] + "{%d,}" % (MIN_ACCESS - 4), "access", lambda m: m.isNotNull())
    hexes = _spans(text, f"(?<!{HEX[:-1]}){HEX[:-1]}{{{MIN_HEX},}}", "hex", lambda m: m.isNotNull())
    added = [_spans(text, f"(?<![{c.inside}])[{c.inside}]{{{MIN_RUN},}}", "entropy", lambda m, c=c: _is_secret(m, c, window, allowed)) for c in classes]
    return F.concat(assign, access, hexes), F.array_distinct(F.concat(*added))


def _told(found: Column) -> Column:
    name = F.array(*[F.lit(k) for k in KINDS])
    ordered = F.array_sort(F.transform(found, lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"))))
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", F.get(name, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scanned(docs: DataFrame, *, text_col: str = "text", id_col: str = "doc_id", **rules) -> DataFrame:
    """One row for each document: the id, counts of the base kinds, digest of the base spans, and all ``spans``."""
    held = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    base, added = spans(F.col("text"), **rules)
    found = held.select("id", base.alias("base"), added.alias("added"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["rank"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")
    return found.select(
        F.col("id").alias(id_col),
        count("assign"),
        count("access"),
        count("hex"),
        F.sha2(_told(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        _told(F.concat("base", "added")).alias("spans"),
    )


def masked(docs: DataFrame, *, text_col: str = "text", length_col: str | None = "n_chars", mask: str = "[secret]", **rules) -> DataFrame:
    """The documents with every found span replaced by ``mask`` (overlapping spans by one), other columns as they were.

    ``length_col``, if the table has it, is set anew for texts that changed. Null stays null.
    """
    text = F.col(text_col)
    base, added = spans(F.coalesce(text, F.lit("")), **rules)
    with_spans = docs.select("*", F.array_sort(F.transform(F.concat(base, added), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))).alias("_found"))
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    done = F.aggregate(
        "_found",
        start,
        lambda s, x: F.struct(
            F.when(x["start"] >= s["at"], F.concat(s["out"], text.substr(s["at"] + 1, x["start"] - s["at"]), F.lit(mask))).otherwise(s["out"]).alias("out"),
            F.greatest(s["at"], x["end"]).alias("at"),
        ),
        lambda s: F.concat(s["out"], text.substr(s["at"] + 1, F.length(text))),
    )
    # The new text first, on its own; its length is taken from that.
    made = with_spans.withColumn("_made", F.when(F.size("_found") > 0, done).otherwise(text))
    columns = {text_col: F.col("_made")}
    if length_col in docs.columns:
        columns[length_col] = F.when(F.size("_found") > 0, F.length("_made")).otherwise(F.col(length_col)).cast(docs.schema[length_col].dataType)
    return made.withColumns(columns).select(*docs.columns)
