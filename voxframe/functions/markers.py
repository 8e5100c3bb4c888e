"""Marker matching. A marker is a substring; ``text`` is expected in lower case.

Long marker lists become one SQL expression when the text is a named column, so that building a plan
stays cheap; other text expressions take the equivalent column functions.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def literals(values: Iterable[str]) -> Column:
    """Array of string literals (typed even when empty)."""
    values = list(values)
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def quoted(value: str) -> str:
    """A SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def column_name(c: Column) -> str | None:
    """Quoted name of a plain column, None for any other expression, also for the variable of a lambda (``x_1``)."""
    text = str(c)
    match = re.fullmatch(r"Column<'(?![xyz]_\d+')(\w+)'>", text)
    return f"`{match.group(1)}`" if match else None


def _total(parts: Sequence[Column], empty: Column) -> Column:
    return reduce(lambda a, b: a + b, parts) if parts else empty


def contains_any(text: Column, markers: Iterable[str]) -> Column:
    """True if ``text`` holds at least one marker; null text holds none."""
    markers = [m for m in markers if m]
    if not markers:
        return F.lit(False)
    name = column_name(text)
    if name:
        return F.expr("coalesce(" + " or ".join(f"contains({name}, {quoted(m)})" for m in markers) + ", false)")
    return F.coalesce(reduce(lambda a, b: a | b, [text.contains(m) for m in markers]), F.lit(False))


def may_hold(text: Column, markers: Iterable[str]) -> Column:
    """False only if ``text`` holds no marker: it has no character from the range that every marker draws on.

    One search settles texts of another script. True where a marker has Latin or cased letters only.
    """
    marks = [max((c for c in m if c > "\xff" and c.isalpha() and c.lower() == c.upper()), default="") for m in markers if m]
    if not marks:
        return F.lit(False)
    return text.rlike(f"[{min(marks)}-{max(marks)}]") if all(marks) else F.lit(True)


def hit_count(text: Column, markers: Iterable[str]) -> Column:
    """How many different markers occur in ``text``."""
    markers = [m for m in markers if m]
    if not markers:
        return F.lit(0)
    name = column_name(text)
    if name:
        return F.expr("coalesce(" + " + ".join(f"cast(contains({name}, {quoted(m)}) as int)" for m in markers) + ", 0)")
    return F.coalesce(_total([text.contains(m).cast("int") for m in markers], F.lit(0)), F.lit(0))


def hits(text: Column, markers: Iterable[str]) -> Column:
    """The markers found, in rule order."""
    markers = list(markers)
    name = column_name(text)
    if name and markers:
        return F.expr("array_compact(array(" + ", ".join(f"if(contains({name}, {quoted(m)}), {quoted(m)}, null)" for m in markers) + "))")
    return F.array_compact(F.array(*[F.when(text.contains(m), F.lit(m)) for m in markers]))


def weighted_hits(text: Column, weights: Mapping[str, float]) -> Column:
    """Sum of the weights of the markers found."""
    if not weights:
        return F.lit(0.0)
    name = column_name(text)
    if name:
        return F.expr(" + ".join(f"if(contains({name}, {quoted(m)}), {float(w)}D, 0D)" for m, w in weights.items()))
    return _total([F.when(text.contains(m), F.lit(float(w))).otherwise(F.lit(0.0)) for m, w in weights.items()], F.lit(0.0))


def negated_weight(text: Column, weights: Mapping[str, float], negations: Iterable[str]) -> Column:
    """Summed weight of the markers that follow a negation, with or without a space."""
    negations = list(negations)
    if not weights or not negations:
        return F.lit(0.0)
    lead = "(?:" + "|".join(re.escape(n) for n in negations) + ") ?"
    name = column_name(text)
    if name:
        return F.expr(
            " + ".join(
                f"if(contains({name}, {quoted(m)}) and {name} rlike {quoted(lead + re.escape(m))}, {float(w)}D, 0D)"
                for m, w in weights.items()
            )
        )
    parts = [
        F.when(text.contains(m) & text.rlike(lead + re.escape(m)), F.lit(float(w))).otherwise(F.lit(0.0)) for m, w in weights.items()
    ]
    return _total(parts, F.lit(0.0))


def first_match(text: Column, rules: Mapping[str, Sequence[str]], default: Column) -> Column:
    """Label of the first rule with a marker in ``text``."""
    chain = None
    for label, markers in rules.items():
        test = contains_any(text, markers)
        chain = F.when(test, F.lit(label)) if chain is None else chain.when(test, F.lit(label))
    return default if chain is None else chain.otherwise(default)


def best_scored(scores: Mapping[str, Column]) -> Column:
    """Struct of the top score and its label; the first label wins ties."""
    return F.array_max(
        F.array(
            *[
                F.struct(score.cast("double").alias("score"), F.lit(-i).alias("order"), F.lit(label).alias("label"))
                for i, (label, score) in enumerate(scores.items())
            ]
        )
    )


def best_label(scores: Mapping[str, Column], floor: float, default: Column) -> Column:
    """Label with the top score of at least ``floor``; the first label wins ties."""
    ranked = best_scored(scores)
    return F.coalesce(F.when(ranked["score"] >= F.lit(float(floor)), ranked["label"]), default)


def top_labels(scores: Mapping[str, Column], n: int) -> Column:
    """Labels with a positive score, best first, ties in rule order, at most ``n``."""
    ranked = F.array_sort(
        F.array_compact(
            F.array(
                *[
                    F.when(
                        score > 0,
                        F.struct((-score).cast("int").alias("score"), F.lit(i).alias("order"), F.lit(label).alias("label")),
                    )
                    for i, (label, score) in enumerate(scores.items())
                ]
            )
        )
    )
    return F.slice(F.transform(ranked, lambda s: s["label"]), 1, n)


def _bounded(marker: str) -> str | None:
    """Pattern of a Latin marker as a whole word; None for markers matched as substrings.

    The marker comes first, so that the search skips to it and looks around only there.
    """
    word = re.escape(marker)
    return rf"{word}(?<![a-z0-9]{word})(?![a-z0-9])" if re.fullmatch(r"[a-z0-9\s/.-]+", marker) else None


def _bounded_sql(name: str, marker: str) -> str:
    # The plain substring test is cheap and settles nearly every row before the regex runs.
    pattern = _bounded(marker)
    found = f"contains({name}, {quoted(marker)})"
    return found if pattern is None else f"({found} and {name} rlike {quoted(pattern)})"


def contains_bounded(text: Column, marker: str) -> Column:
    """Latin markers match between non-alphanumerics, all others as substrings."""
    marker = marker.lower().strip()
    if not marker:
        return F.lit(False)
    name = column_name(text)
    if name:
        return F.expr(_bounded_sql(name, marker))
    pattern = _bounded(marker)
    return text.contains(marker) if pattern is None else text.contains(marker) & text.rlike(pattern)


def bounded_count(text: Column, markers: Iterable[str]) -> Column:
    """How many markers occur, Latin ones as whole words."""
    return bounded_weight(text, [(m, 1.0) for m in markers])


def bounded_weight(text: Column, markers: Iterable[tuple[str, float]]) -> Column:
    """Summed weight of the markers that occur, Latin ones as whole words."""
    pairs = [(m.lower().strip(), float(w)) for m, w in markers if m.strip()]
    name = column_name(text)
    if name and pairs:
        return F.expr(" + ".join(f"if({_bounded_sql(name, m)}, {w}D, 0D)" for m, w in pairs))
    return _total([F.when(contains_bounded(text, m), F.lit(w)).otherwise(F.lit(0.0)) for m, w in pairs], F.lit(0.0))


def bounded_hits(text: Column, markers: Iterable[str]) -> Column:
    """The markers found as by ``contains_bounded``, in the given order."""
    markers = [m for m in markers if m.strip()]
    name = column_name(text)
    if name and markers:
        return F.expr("array_compact(array(" + ", ".join(f"if({_bounded_sql(name, m.lower().strip())}, {quoted(m)}, null)" for m in markers) + "))")
    return F.array_compact(F.array(*[F.when(contains_bounded(text, m), F.lit(m)) for m in markers]))


def matches_any(text: Column, patterns: Iterable[str]) -> Column:
    """True if one of the regular expressions is found, without regard to case."""
    patterns = list(patterns)
    if not patterns:
        return F.lit(False)
    return F.coalesce(text.rlike("(?iU)" + "|".join(f"(?:{p})" for p in patterns)), F.lit(False))
