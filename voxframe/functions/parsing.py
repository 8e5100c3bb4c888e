"""Tolerant readers for flags, lists and maps kept as text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from voxframe.functions.text import safe_text, strip

# The words that count as yes, and the separators of loose lists.
TRUE_WORDS = ("true", "1", "yes", "y", "t")
FALSE_WORDS = ("false", "0", "no", "n", "f", "")
SPACE_OR_PUNCT = r"[\s,|;/]+"
PUNCT = r"[,|;/]+"
WRAPPERS = r"""^[\[\({'"]+|[\]\)}'"]+$"""


def coerce_bool(c: Column, default: bool = False) -> Column:
    """Read flags written as booleans, numbers or words."""
    word = F.lower(strip(c.cast("string")))
    number = word.try_cast("double")
    return (
        F.when(word.isNull(), F.lit(default))
        .when(word.isin(*TRUE_WORDS), True)
        .when(word.isin(*FALSE_WORDS), False)
        .when(number.isNotNull() & ~F.isnan(number), number != 0)
        .otherwise(F.lit(default))
    )


def is_truthy(c: Column) -> Column:
    return F.lower(strip(F.coalesce(c.cast("string"), F.lit("")))).isin(*TRUE_WORDS)


def _drop_blank(items: Column) -> Column:
    return F.filter(F.transform(items, lambda x: strip(F.coalesce(x, F.lit("")))), lambda x: x != "")


def parse_list(c: Column, separators: str = SPACE_OR_PUNCT) -> Column:
    """A JSON list if the text is one, else the parts between the separators."""
    raw = strip(F.coalesce(c, F.lit("")))
    listed = F.when(raw.startswith("[") & raw.endswith("]"), F.from_json(raw, "array<string>"))
    return _drop_blank(F.coalesce(listed, F.split(raw, separators)))


def parse_loose_list(c: Column) -> Column:
    """Also reads single quotes, unbalanced brackets and space-separated words."""
    raw = strip(F.coalesce(c, F.lit("")))
    options = {"allowSingleQuotes": "true"}
    listed = F.when(raw.startswith("[") & raw.endswith("]"), F.from_json(raw, "array<string>", options))
    relaxed = F.regexp_replace(raw, r"^[\[\](){}]+|[\[\](){}]+$", "")
    parts = _drop_blank(F.split(relaxed, PUNCT))
    spaced = (F.size(parts) <= 1) & relaxed.contains(" ") & ~relaxed.contains("_")
    loose = F.when(spaced, F.split(relaxed, r"\s+")).otherwise(parts)
    trimmed = F.transform(F.coalesce(listed, loose), lambda x: F.regexp_replace(strip(x), WRAPPERS, ""))
    return _drop_blank(trimmed)


def parse_string_map(c: Column) -> Column:
    return F.coalesce(F.from_json(strip(c), "map<string,string>"), F.create_map().cast("map<string,string>"))


def parse_number_map(c: Column) -> Column:
    """Entries whose value is a number, keys cleaned."""
    entries = F.transform(
        F.map_entries(parse_string_map(c)),
        lambda e: F.struct(safe_text(e["key"]).alias("key"), e["value"].try_cast("double").alias("value")),
    )
    return F.map_from_entries(F.filter(entries, lambda e: (e["key"] != "") & e["value"].isNotNull()))


def normalize_axes(axes: Column, valid: Sequence[str], fallback: str = "usage_pattern_fit") -> Column:
    """Valid axes of a parsed list; else those found inside its text; else the fallback."""
    known = F.array(*[F.lit(a) for a in valid])
    kept = F.array_distinct(F.filter(F.transform(axes, F.lower), lambda a: F.array_contains(known, a)))
    text = F.lower(F.array_join(axes, " "))
    by_length = sorted(valid, key=len, reverse=True)
    found = F.array_compact(F.array(*[F.when(text.contains(a), F.lit(a)) for a in by_length]))
    return (
        F.when(F.size(kept) > 0, kept).when(F.size(found) > 0, found).otherwise(F.array(F.lit(fallback)))
    )


def first_distinct(items: Column, n: int) -> Column:
    return F.slice(F.array_distinct(items), 1, n)


def query_terms(query: str) -> list[str]:
    """Comma-separated search terms, each once without regard to case."""
    terms: dict[str, str] = {}
    for part in (query or "").split(","):
        part = part.strip()
        if part:
            terms.setdefault(part.casefold(), part)
    return list(terms.values())
