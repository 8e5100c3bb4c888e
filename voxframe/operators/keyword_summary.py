"""Weighted keyword summaries of comments, with a block list made from names."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxframe.functions import keywords as kw
from voxframe.operators.relational import share_of_all, unnest
from voxframe.rules import keywords as words

#: How often a term of an enrichment counts beside the words of the text.
TERM_TIMES = 3


@dataclass(frozen=True)
class SummaryRules:
    """Word lists of the summary on top of the keyword rules."""

    keywords: kw.KeywordRules = kw.DEFAULT
    block: Sequence[str] = words.SUMMARY_BLOCK
    low_weight: Sequence[str] = words.SUMMARY_LOW_WEIGHT
    low_factor: float = words.SUMMARY_LOW_FACTOR
    term_noise: Sequence[str] = tuple(words.ENRICHMENT_NOISE) + tuple(words.GENERIC_EXCLUDE)
    names: Sequence[str] = words.NAME_BLOCK


DEFAULT = SummaryRules()


def name_block_list(df: DataFrame, columns: Sequence[str], rules: SummaryRules = DEFAULT) -> DataFrame:
    """Normalized words of all names in ``columns``, and the fixed ones; business words are never blocked."""
    held = [F.regexp_extract_all(F.coalesce(F.col(n).cast("string"), F.lit("")), F.lit("[0-9A-Za-z가-힣]+"), F.lit(0)) for n in columns if n in df.columns]
    fixed = df.sparkSession.createDataFrame([(w,) for w in rules.names], "keyword string")
    if not held:
        return fixed.distinct()
    raw = df.select(F.explode(F.concat(*held)).alias("__token")).distinct()
    named = unnest(raw, F.array(kw.normalize_keyword(F.col("__token"), rules.keywords)), "keyword")
    return named.where((F.col("keyword") != "") & ~F.col("keyword").isin(*rules.keywords.keep)).union(fixed).distinct()


def keyword_counts(df: DataFrame, text: str = "cleaned_text", terms: str | None = None, rules: SummaryRules = DEFAULT) -> DataFrame:
    """Business keywords and their counts; each different term of a row counts ``TERM_TIMES`` times more.

    Raw words are counted first, so each different word is normalized once.
    """
    raw = unnest(df, kw.raw_tokens(F.col(text)), "__token").groupBy("__token").agg(F.count("*").alias("__n"))
    named = unnest(raw, F.array(kw.normalize_keyword(F.col("__token"), rules.keywords)), "keyword", "__n")
    if terms is not None:
        each = df.select(F.monotonically_increasing_id().alias("__row"), F.explode(F.array_distinct(terms)).alias("__token"))
        own = unnest(each, F.array(kw.normalize_keyword(F.col("__token"), rules.keywords)), "keyword", "__row")
        own = own.where(~F.col("keyword").isin(*rules.term_noise)).distinct()
        named = named.union(own.groupBy("keyword").agg((F.count("*") * TERM_TIMES).alias("__n")).select(*named.columns))
    kept = named.where((F.col("keyword") != "") & kw.is_business_keyword(F.col("keyword"), rules.keywords))
    return kept.groupBy("keyword").agg(F.sum("__n").alias("count"))


def weighted_keywords(counts: DataFrame, top_n: int = 6, blocked: DataFrame | None = None, rules: SummaryRules = DEFAULT) -> DataFrame:
    """The keywords that tell most: by count times weight; blocked ones are left out before the choice."""
    kept = counts.where(~F.col("keyword").isin(*rules.block)) if rules.block else counts
    if blocked is not None:
        kept = kept.join(blocked.select("keyword"), "keyword", "left_anti")
    low = F.col("keyword").isin(*rules.low_weight) if rules.low_weight else F.lit(False)
    score = F.col("count") * F.when(low, rules.low_factor).otherwise(1.0)
    return kept.orderBy(score.desc(), F.col("count").desc(), "keyword").limit(top_n)


def keyword_pack(df: DataFrame, sentiment: str, names: Sequence[str] = ("channel_title", "author_display_name"), text: str = "cleaned_text", terms: str | None = None, top_n: int = 6, rules: SummaryRules = DEFAULT) -> DataFrame:
    """Weighted keywords of one polarity; words of any name in the frame are blocked."""
    own = df.where(F.col("sentiment_label") == sentiment)
    return weighted_keywords(keyword_counts(own, text, terms, rules), top_n, name_block_list(df, names, rules), rules)


def keyword_share(summary: DataFrame) -> DataFrame:
    """Share of each keyword in the summary, in percent to one digit."""
    return share_of_all(summary, "count", "share", None).withColumn("share_text", F.format_string("%.1f%%", F.round(F.col("share") * 100, 1))).drop("share")
