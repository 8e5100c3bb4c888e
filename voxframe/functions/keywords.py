"""Keyword tokens: normalization, particles, stopwords and the business test."""

from __future__ import annotations

from dataclasses import dataclass, field
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from voxframe.functions.markers import literals
from voxframe.rules import keywords as words

# Token shapes and the marks stripped from their ends.
TOKEN = r"[A-Za-z][A-Za-z'-]+|[0-9A-Za-z가-힣+/]+"
EDGE_MARKS = ".,!?()[]{}\"'`“”‘:;/-_"
NON_KEYWORD_CHAR = r"[^a-z0-9가-힣+/]"
WEAK_TAILS = ("하게", "하게요", "처럼", "같이", "커서", "때문", "에서", "으로")


@dataclass(frozen=True)
class KeywordRules:
    """All word lists of keyword normalization; replace any of them for another domain."""

    stopwords: Sequence[str] = (
        words.KOREAN_STOPWORDS
        + words.ENGLISH_STOPWORDS
        + words.GENERIC_EXCLUDE
        + words.UI_NOISE_TERMS
        + words.BRAND_NOISE_TERMS
    )
    translations: Mapping[str, str] = field(default_factory=lambda: dict(words.KEYWORD_TRANSLATIONS))
    aliases: Mapping[str, str] = field(default_factory=lambda: dict(words.KEYWORD_CANONICAL_ALIASES))
    keep: Sequence[str] = words.BUSINESS_KEEPWORDS
    products: Sequence[str] = words.PRODUCT_KEYWORDS
    noise_suffixes: Sequence[str] = words.NOISE_SUFFIXES
    verb_suffixes: Sequence[str] = words.NOISE_VERB_SUFFIXES
    particles: Sequence[str] = words.KR_PARTICLE_SUFFIXES
    drop_latin: bool = True


DEFAULT = KeywordRules()


def _lookup(token: Column, table: Mapping[str, str]) -> Column:
    if not table:
        return token
    pairs = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.coalesce(F.element_at(pairs, token), token)


def _one_of(token: Column, values: Sequence[str]) -> Column:
    return token.isin(*values) if values else F.lit(False)


def _stopped(token: Column, rules: KeywordRules) -> Column:
    return _one_of(token, rules.stopwords)


def _tail(suffixes: Sequence[str]) -> str:
    return "(?:" + "|".join(suffixes) + ")$"


def _strip_particles(token: Column, rules: KeywordRules) -> Column:
    """Strip particles until none is left; two characters always remain.

    The greedy prefix makes every round drop the shortest particle that fits.
    """
    pattern = "^(.{2,})(?:" + "|".join(rules.particles) + ")$"
    rounds = F.sequence(F.lit(1), F.greatest(F.length(token), F.lit(1)))
    stripped = F.aggregate(rounds, token, lambda acc, _: F.regexp_replace(acc, pattern, "$1"))
    return F.when(token.rlike(pattern), stripped).otherwise(token)


def normalize_keywords(tokens: Column, rules: KeywordRules = DEFAULT) -> Column:
    """Normalize an array of raw tokens; dropped tokens become empty strings.

    Each step is its own ``transform`` so that no expression is repeated inside another.
    """

    def trim_marks(t: Column) -> Column:
        return F.replace(F.btrim(F.lower(F.trim(t)), F.lit(EDGE_MARKS)), F.lit("’"), F.lit(""))

    # One alternation instead of one search per rule: the tokens are short, so starting a search is what costs.
    dropped = "|".join([r"^\d+$", *([_tail(rules.noise_suffixes)] if rules.noise_suffixes else [])])
    unusable = NON_KEYWORD_CHAR + ("|^[a-z]+$" if rules.drop_latin else "")

    def screen(t: Column) -> Column:
        noisy = _one_of(t, rules.stopwords) | t.rlike(dropped)
        if rules.verb_suffixes:
            noisy = noisy | (t.rlike(_tail(rules.verb_suffixes)) & ~_one_of(t, rules.keep))
        return F.when(noisy, F.lit("")).otherwise(t)

    def screen_stem(pair: Column) -> Column:
        gone = (pair["stem"] != pair["token"]) & _stopped(pair["stem"], rules)
        return F.when(gone, F.lit("")).otherwise(pair["stem"])

    def final(t: Column) -> Column:
        return F.when((F.length(t) < 2) | t.rlike(unusable), F.lit("")).otherwise(t)

    out = F.transform(tokens, trim_marks)
    out = F.transform(out, lambda t: _lookup(t, rules.translations))
    out = F.transform(out, lambda t: _lookup(t, rules.aliases))
    out = F.transform(out, screen)
    if rules.particles:
        out = F.transform(
            out, lambda t: F.struct(t.alias("token"), _strip_particles(t, rules).alias("raw_stem"))
        )
        out = F.transform(
            out, lambda p: F.struct(p["token"].alias("token"), _lookup(p["raw_stem"], rules.aliases).alias("stem"))
        )
        out = F.transform(out, screen_stem)
    out = F.transform(out, lambda t: _lookup(t, rules.aliases))
    return F.transform(out, final)


def normalize_keyword(token: Column, rules: KeywordRules = DEFAULT) -> Column:
    """One token; an empty string means that it is not a keyword."""
    return F.element_at(normalize_keywords(F.array(F.coalesce(token, F.lit(""))), rules), 1)


def raw_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0))


def tokenize(text: Column, rules: KeywordRules = DEFAULT) -> Column:
    """Normalized keywords of a text, in order, with repeats."""
    return F.filter(normalize_keywords(raw_tokens(text), rules), lambda t: t != "")


def is_business_keyword(token: Column, rules: KeywordRules = DEFAULT) -> Column:
    """Keep words, product words and Korean nouns; other scripts only via the word lists."""
    blocked = _one_of(token, rules.stopwords) | token.rlike(r"(?U)^\d+$") | (F.length(token) < 2)
    listed = _one_of(token, tuple(rules.keep) + tuple(rules.products))
    noun = token.rlike("[가-힣]") & ~token.rlike(_tail(WEAK_TAILS))
    if not rules.drop_latin:
        noun = noun | token.rlike("^[a-z]+$")
    return F.coalesce(~blocked & (listed | noun), F.lit(False))


def point_tokens(tokens: Column, limit: int | None, noise: Sequence[str], aliases: Mapping[str, str],
                 rules: KeywordRules = DEFAULT) -> Column:
    """Card-ready points: normalized, one trailing particle dropped, noise out, distinct, at most ``limit`` if given."""
    out = F.filter(normalize_keywords(tokens, rules), lambda t: t != "")
    out = F.transform(out, lambda t: _lookup(t, aliases))
    out = F.transform(out, lambda t: F.regexp_replace(t, "(?:으로|로|은|는|이|가|을|를|와|과|랑|도|만)$", ""))
    kept = F.filter(out, lambda t: (F.length(t) >= 2) & ~F.array_contains(literals(noise), F.lower(t)))
    return F.array_distinct(kept) if limit is None else F.slice(F.array_distinct(kept), 1, limit)
