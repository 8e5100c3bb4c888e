"""Text cleaning, quality classes, personal data and small string helpers."""

from __future__ import annotations

import html
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxframe.functions.markers import contains_any
from voxframe.rules import cleaning as rules

# The patterns decide which text is dropped, so they must hold for results to be right.
# ``{2,}+`` is possessive: on long runs of one word Java then loops instead of recursing.
URL = r"(?i)https?://\S+|www\.\S+"
LINK = r"(?i)https?://[^\s)\]]+"
REPEATED_TOKEN = r"(?iU)\b(\w{2,}+)\b(?:\s+\1\b){2,}+"
REPEATED_CHAR = r"(?s)(.)\1{3,}+"
PHONE = r"\b(?:\+?\d{1,3}[\s-]?)?(?:\d{2,4}[\s-]?){2,4}\d{3,4}\b"
NINE_DIGITS = r"(?:\d[\s-]?){8}\d"
EMAIL = r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b"
ACCOUNT = r"@[A-Za-z0-9_\.]{3,}"
BLANK_WORDS = ("nan", "none", "null", "<na>")


# Every character that ``(?U)\s`` matches.
WHITE_SPACE = "\t\n\x0b\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often the body mentions it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(c: Column) -> Column:
    """Drop white space of every kind at both ends; only the ends are read."""
    return F.btrim(c, F.lit(WHITE_SPACE))


def collapse_space(c: Column) -> Column:
    """Runs of white space as one space, none at the ends. A single space between words is no match, so nothing is copied for it."""
    return F.trim(F.regexp_replace(c, r"(?U)\s(?:\s+|(?<! ))", " "))


def safe_text(c: Column) -> Column:
    """Null and the words that stand for null become the empty string."""
    # One chain without repeated parts: nested calls would otherwise double at every level.
    return F.regexp_replace(strip(F.coalesce(c.cast("string"), F.lit(""))), "(?i)^(?:" + "|".join(BLANK_WORDS) + ")$", "")


@F.pandas_udf(T.StringType())
def _unescape(values: pd.Series) -> pd.Series:
    return values.map(html.unescape, na_action="ignore")


def html_unescape(c: Column) -> Column:
    """Decode HTML entities; rows without an ampersand never reach Python."""
    return F.coalesce(_unescape(F.when(c.contains("&"), c)), c)


def clean_text(
    c: Column,
    remove_urls: bool = True,
    preserve_emoji: bool = True,
    normalize_repeats: bool = True,
    unescape: bool = True,
) -> Column:
    """Readable one-line text without links, stretched letters and repeated words."""
    value = F.coalesce(c, F.lit(""))
    if unescape:
        value = html_unescape(value)
    value = F.translate(value, "\n\r", "  ")
    if remove_urls:
        value = F.regexp_replace(value, URL, " ")
    if normalize_repeats:
        value = F.regexp_replace(value, REPEATED_CHAR, "$1$1")
        value = F.regexp_replace(value, REPEATED_TOKEN, "$1")
    if not preserve_emoji:
        value = F.regexp_replace(value, r"(?U)[^\w\s]", " ")
    return collapse_space(value)


def quality_class(raw: Column, cleaned: Column) -> Column:
    """Quality class of an unescaped ``raw`` text, given its cleaned form.

    Both come in as columns so that the caller computes each of them once.
    """
    raw = strip(raw)
    normalized = F.lower(cleaned)
    listed = (*rules.GENERIC_WORDS, *rules.GENERIC_KO, *rules.MEANINGLESS_MARKERS)
    # Found near the start of a text; counting letters or tokens would read and copy all of it.
    more_letters = lambda n: normalized.rlike(rf"(?U)(?:\w\W*+){{{n + 1}}}")
    words = F.when(~more_letters(max(len(w) for w in listed)), strip(F.regexp_replace(normalized, r"(?U)[^\w\s]", ""))).otherwise("")
    tokens = F.split(collapse_space(raw), " ")
    return (
        F.when(normalized == "", "meaningless")
        .when(contains_any(normalized, rules.AD_MARKERS), "ad")
        .when(raw.startswith("@") & (F.size(tokens) <= 3) & F.forall(tokens, lambda t: t.startswith("@")), "tagging_only")
        .when(raw.rlike(r"(?U)^[\W_]+$"), "meaningless")
        .when(raw.rlike(REPEATED_TOKEN), "repetitive")
        .when(~more_letters(1), "meaningless")
        .when(words.isin(*rules.GENERIC_WORDS, *rules.GENERIC_KO), "generic_engagement")
        .when(words.isin(*rules.MEANINGLESS_MARKERS), "meaningless")
        .when(~normalized.contains(" ") & ~more_letters(4), "low_context")
        .otherwise("valid")
    )


def language_hint(c: Column) -> Column:
    """``ko`` for any Hangul syllable, ``en`` for any Latin letter, else ``unknown``."""
    value = F.coalesce(c, F.lit(""))
    return F.when(value.rlike("[가-힣]"), "ko").when(value.rlike("[A-Za-z]"), "en").otherwise("unknown")


def infer_language(text: Column, fallback: Column) -> Column:
    """A given language wins; else Hangul means ``ko``."""
    given = F.coalesce(fallback, F.lit(""))
    return F.when(given != "", given).when(text.rlike("[가-힣]"), "ko").otherwise("unknown")


def looks_korean(c: Column) -> Column:
    """More Hangul syllables than Latin letters, and more than three."""
    value = safe_text(c)
    hangul = F.length(F.regexp_replace(value, "[^가-힣]", ""))
    latin = F.length(F.regexp_replace(value, "[^A-Za-z]", ""))
    return hangul > F.greatest(F.lit(3), latin)


def external_links(c: Column) -> Column:
    """Distinct links in order of appearance."""
    return F.array_distinct(F.regexp_extract_all(safe_text(c), F.lit(LINK), F.lit(0)))


def detect_pii(c: Column) -> Column:
    """Struct of flag, distinct kinds and distinct values of personal data."""
    value = safe_text(c)
    none = F.array().cast("array<string>")
    # The searches can go back and forth over long texts, so they run only where a plain test says they may hit.
    phones = F.filter(
        F.when(c.rlike(NINE_DIGITS), F.regexp_extract_all(value, F.lit(PHONE), F.lit(0))).otherwise(none),
        lambda t: F.length(F.regexp_replace(t, r"\D", "")) >= 9,
    )
    named = lambda pattern: F.when(c.contains("@"), F.regexp_extract_all(value, F.lit(pattern), F.lit(0))).otherwise(none)
    found = F.array(
        F.struct(F.lit("phone").alias("kind"), phones.alias("vals")),
        F.struct(F.lit("email").alias("kind"), named(EMAIL).alias("vals")),
        F.struct(F.lit("account_id").alias("kind"), named(ACCOUNT).alias("vals")),
    )

    def told(kept: Column) -> Column:
        return F.struct(
            F.when(F.size(kept) > 0, "Y").otherwise("N").alias("flag"),
            F.array_join(F.transform(kept, lambda f: f["kind"]), ", ").alias("types"),
            F.array_join(F.array_distinct(F.flatten(F.transform(kept, lambda f: f["vals"]))), ", ").alias("values"),
        )

    # Bound, since each field of a plain struct would search the text by itself.
    return bound(F.filter(found, lambda f: F.size(f["vals"]) > 0), told)


def _pii_tokens(pii_values: Column) -> Column:
    return F.filter(F.transform(F.split(safe_text(pii_values), ","), lambda t: F.trim(t)), lambda t: t != "")


def mask_pii(text: Column, pii_values: Column) -> Column:
    """Replace every listed value by a mask that keeps its shape."""

    def mask(token: Column) -> Column:
        digits = F.regexp_replace(token, r"\D", "")
        parts = F.split(token, "-")
        short_digits = F.concat(F.substring(digits, 1, 3), F.lit("****"), F.right(digits, F.lit(4)))
        hidden = F.repeat(F.lit("*"), F.greatest(F.lit(1), F.length(token) - 2))
        return (
            F.when(
                token.contains("@") & token.contains("."),
                F.concat(
                    F.substring(F.substring_index(token, "@", 1), 1, 1),
                    F.lit("***@"),
                    F.regexp_replace(token, r"^[^@]*@", ""),
                ),
            )
            .when(
                F.length(digits) >= 9,
                F.when(
                    token.contains("-") & (F.size(parts) >= 3),
                    F.concat(parts[0], F.lit("-****-"), F.element_at(parts, -1)),
                ).otherwise(short_digits),
            )
            .when(F.length(token) >= 3, F.concat(F.substring(token, 1, 1), hidden, F.right(token, F.lit(1))))
            .otherwise("[PII]")
        )

    return F.aggregate(_pii_tokens(pii_values), safe_text(text), lambda acc, t: F.replace(acc, t, mask(t)))


def redact_pii(text: Column, pii_values: Column) -> Column:
    """Replace every listed value of two or more characters by ``[PII]``."""
    tokens = F.filter(_pii_tokens(pii_values), lambda t: F.length(t) >= 2)
    return F.aggregate(tokens, safe_text(text), lambda acc, t: F.replace(acc, t, F.lit("[PII]")))


def normalize_text(c: Column) -> Column:
    """Drop links and collapse white space."""
    return collapse_space(F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"(?i)https?://\S+|\bwww\.\S+", " "))


def dedupe_key(c: Column, limit: int | None = None) -> Column:
    """Text reduced to lower-case words, all of it or the first ``limit`` characters."""
    words = collapse_space(F.regexp_replace(F.lower(F.coalesce(c.cast("string"), F.lit(""))), r"(?U)[^\w\s]", " "))
    return words if limit is None else F.substring(words, 1, limit)


def text_digest(c: Column) -> Column:
    """Digest of the whole reduced text, as a key of equal texts."""
    return F.md5(dedupe_key(c))


def looks_garbled(c: Column) -> Column:
    value = safe_text(c)
    return F.when(value == "", False).otherwise(value.contains("??"))


def is_long_text(c: Column, threshold: int = 260) -> Column:
    return F.length(safe_text(c)) > threshold


def preview(c: Column, limit: int = 220) -> Column:
    """Text cut to ``limit`` characters with an ellipsis."""

    def shown(value: Column) -> Column:
        cut = F.rtrim(F.substring(collapse_space(value), 1, limit - 3))
        return F.when(F.length(value) <= limit, value).otherwise(F.concat(cut, F.lit("...")))

    return bound(safe_text(c), shown)


def evidence_span(text: Column, phrases: list[str]) -> Column:
    """The first listed phrase as it is written in the text, else an empty string."""
    return bound(safe_text(text), lambda source: bound(F.lower(source), lambda lowered: written_phrase(source, lowered, phrases)))


def written_phrase(source: Column, lowered: Column, phrases: Sequence[str]) -> Column:
    """As ``evidence_span``, of a text and its lower-case form that are worked out already."""
    spans = [
        F.when(lowered.contains(p.lower()), source.substr(F.instr(lowered, p.lower()), F.lit(len(p)))) for p in phrases
    ]
    return F.coalesce(*spans, F.lit(""))


def timestamp_seconds(c: Column) -> Column:
    """Seconds of the first ``h:mm:ss``, else of the first ``m:ss``, else null."""
    value = safe_text(c)
    long = r"\b(\d{1,2}):([0-5]\d):([0-5]\d)\b"
    short = r"\b(\d{1,2}):([0-5]\d)\b"

    def part(pattern: str, group: int) -> Column:
        return F.regexp_extract(value, pattern, group).cast("int")

    return F.when(
        value.rlike(long), part(long, 1) * 3600 + part(long, 2) * 60 + part(long, 3)
    ).when(value.rlike(short), part(short, 1) * 60 + part(short, 2))


def timestamp_label(seconds: Column, missing: str = "시점 미확인") -> Column:
    total = F.greatest(F.lit(0), seconds.cast("int"))
    hour, minute, second = F.floor(total / 3600), F.floor(total % 3600 / 60), total % 60
    text = F.when(hour > 0, F.format_string("%02d:%02d:%02d", hour, minute, second)).otherwise(
        F.format_string("%02d:%02d", minute, second)
    )
    return F.when(seconds.isNull(), F.lit(missing)).otherwise(text)


def link_at_time(url: Column, seconds: Column) -> Column:
    """Link to a point in a video; links that already carry a time stay as they are."""
    link = safe_text(url)
    joined = F.concat(link, F.when(link.contains("?"), "&").otherwise("?"), F.lit("t="), seconds.cast("string"), F.lit("s"))
    return F.when((link == "") | seconds.isNull() | link.contains("t="), link).otherwise(joined)


def chunk_text(c: Column, limit: int = 420) -> Column:
    """Pack whole sentences into chunks of at most ``limit`` characters.

    A sentence that is longer by itself stays whole.
    """
    value = collapse_space(F.coalesce(c, F.lit("")))
    pieces = F.filter(F.split(value, r"(?<=[.!?])\s+"), lambda s: s != "")

    def pack(acc: Column, piece: Column) -> Column:
        last = F.element_at(acc["done"], -1)
        fits = (F.size(acc["done"]) > 0) & (F.length(last) + 1 + F.length(piece) <= limit)
        return F.struct(
            F.when(
                fits,
                F.concat(F.slice(acc["done"], F.lit(1), F.size(acc["done"]) - 1), F.array(F.concat_ws(" ", last, piece))),
            )
            .otherwise(F.concat(acc["done"], F.array(piece)))
            .alias("done")
        )

    start = F.struct(F.array().cast("array<string>").alias("done"))
    return F.aggregate(pieces, start, pack, lambda acc: acc["done"])
