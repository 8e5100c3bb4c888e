"""Aggregates over externally supplied topics, keywords and product mentions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxframe.functions.parsing import is_truthy
from voxframe.functions.scores import ratio
from voxframe.functions.text import strip
from voxframe.operators.descriptive import count_if
from voxframe.operators.truth import DEFAULT, TruthRules, is_real_inquiry
from voxframe.schemas import pick


def _dominant(positive: Column, negative: Column, neutral: Column) -> Column:
    """Largest count; ties in the order positive, negative, neutral."""
    return (
        F.when((positive >= negative) & (positive >= neutral), "positive").when(negative >= neutral, "negative").otherwise("neutral")
    )


def _by_label(rows: DataFrame, key: str, label: Column, total: str) -> DataFrame:
    c = F.col
    neutral = label.isin("neutral", "trash", "undecidable")
    out = rows.groupBy(key).agg(
        count_if(label == "positive").alias("positive_count"),
        count_if(label == "negative").alias("negative_count"),
        count_if(neutral).alias("neutral_count"),
    )
    return out.withColumn(total, c("positive_count") + c("negative_count") + c("neutral_count"))


def topic_pivot(df: DataFrame, topics: str = "nlp_topics", sentiments: str = "nlp_topic_sentiments") -> DataFrame:
    """Polarity counts per topic from a topic array and a map of topic to polarity."""
    rows = df.select(F.explode(topics).alias("topic"), sentiments)
    rows = rows.withColumn("__s", F.coalesce(F.try_element_at(sentiments, F.col("topic")), F.lit("neutral")))
    out = _by_label(rows, "topic", F.when(F.col("__s").isin("positive", "negative", "neutral"), F.col("__s")), "total")
    c = F.col
    return out.withColumns(
        {
            "dominant_sentiment": _dominant(c("positive_count"), c("negative_count"), c("neutral_count")),
            "negative_rate": F.round(F.try_divide(c("negative_count").cast("double"), c("total").cast("double")), 4),
        }
    )


def _row_label(df: DataFrame) -> Column:
    label = F.nullif(pick(df, ["nlp_label"], F.lit("")), F.lit(""))
    return F.coalesce(label, F.nullif(pick(df, ["sentiment_label"], F.lit("")), F.lit("")), F.lit("neutral"))


def keyword_frequency(df: DataFrame, keywords: str = "nlp_keywords") -> DataFrame:
    """Keyword counts with their polarity; unusable labels count as neutral."""
    rows = df.select(F.explode(keywords).alias("keyword"), _row_label(df).alias("__l"))
    out = _by_label(rows, "keyword", F.col("__l"), "count")
    c = F.col
    return out.withColumn("dominant_sentiment", _dominant(c("positive_count"), c("negative_count"), c("neutral_count")))


def product_mentions(df: DataFrame, mentions: str = "nlp_product_mentions") -> DataFrame:
    rows = df.select(F.explode(mentions).alias("__product"), _row_label(df).alias("__l"))
    out = _by_label(rows, "__product", F.col("__l"), "mention_count").withColumnRenamed("__product", "product")
    return out.withColumn("negative_rate", ratio(F.col("negative_count"), F.col("mention_count"), 4))


def inquiries(df: DataFrame, rules: TruthRules = DEFAULT) -> DataFrame:
    """Flagged comments whose text is a real question, lists joined to text."""
    text = pick(df, ["cleaned_text", "text_display"], F.lit(""))
    flagged = is_truthy(pick(df, ["nlp_is_inquiry"], F.lit(False))) | is_truthy(pick(df, ["inquiry_flag"], F.lit(False)))

    def joined(name: str) -> Column:
        return F.array_join(F.coalesce(pick(df, [name]).cast("array<string>"), F.array().cast("array<string>")), ", ")

    df = df.where(flagged).withColumn("__value", strip(text))
    df = df.withColumn("__low", F.lower("__value"))
    return df.where(is_real_inquiry(F.col("__value"), F.col("__low"), rules)).select(
        "comment_id",
        text.alias("text"),
        pick(df, ["nlp_summary"], F.lit("")).alias("nlp_summary"),
        joined("nlp_topics").alias("nlp_topics"),
        is_truthy(pick(df, ["nlp_is_rhetorical"], F.lit(False))).alias("is_rhetorical"),
        joined("nlp_product_mentions").alias("product_mentions"),
    )


def negative_summaries(df: DataFrame, n: int = 5) -> DataFrame:
    """Most confident negative summaries."""
    kept = df.where((F.coalesce("nlp_summary", F.lit("")) != "") & (F.col("nlp_label") == "negative"))
    return kept.orderBy(F.col("nlp_confidence").desc_nulls_last(), "comment_id").limit(n)


def enrichment_health(df: DataFrame) -> DataFrame:
    """Share of rows with any usable external field, and a status for it."""
    def size_of(name: str) -> Column:
        return F.length(pick(df, [name], F.lit("")).cast("string"))

    points = F.array_join(F.coalesce(pick(df, ["nlp_core_points"]).cast("array<string>"), F.array().cast("array<string>")), " ")
    usable = (
        pick(df, ["nlp_label"]).isNotNull()
        | (size_of("nlp_summary") >= 8)
        | points.rlike("[가-힣A-Za-z0-9]{2,}")
        | (size_of("nlp_sentiment_reason") >= 10)
    )
    row = df.agg(count_if(usable).alias("__n"), F.count("*").alias("comments"))
    row = row.withColumn("coverage", ratio(F.col("__n"), F.col("comments"), 4)).drop("__n")
    status = (
        F.when(F.col("comments") == 0, "unknown").when(F.col("coverage") >= 0.5, "ok")
        .when(F.col("coverage") >= 0.15, "partial").otherwise("fallback")
    )
    return row.withColumn("status", status)
