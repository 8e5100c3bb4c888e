"""Counts, rankings, shares and density tables of labelled comments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxframe.functions.scores import parse_time, ratio
from voxframe.functions.text import text_digest
from voxframe.operators.relational import attach, share_of_all, share_of_group, top_per_group
from voxframe.operators.truth import primary_axis
from voxframe.rules import display
from voxframe.schemas import pick


def count_if(test: Column) -> Column:
    return F.count_if(F.coalesce(test, F.lit(False)))


def unpivot_row(row: DataFrame, columns: Sequence[str], name: str = "metric", value: str = "value") -> DataFrame:
    """One row per metric of a one-row frame."""
    pairs = F.array(*[F.struct(F.lit(n).alias(name), F.col(n).cast("double").alias(value)) for n in columns])
    return row.select(F.inline(pairs))


def runs_summary(videos: DataFrame, comments: DataFrame) -> DataFrame:
    """Run KPIs as metric rows."""
    validity = pick(comments, ["comment_validity"], F.lit("valid"))
    row = comments.agg(
        F.count("*").alias("total_comments"),
        count_if(validity == "valid").alias("valid_comments"),
        count_if(validity == "excluded").alias("removed_comments"),
        count_if(F.col("is_reply")).alias("total_replies"),
    ).withColumn("total_videos", videos.agg(F.count("*")).scalar())
    row = row.withColumn("avg_comments_per_video", ratio(F.col("total_comments"), F.col("total_videos"), 2))
    names = ["total_videos", "total_comments", "valid_comments", "removed_comments", "total_replies", "avg_comments_per_video"]
    return unpivot_row(row, names)


def video_ranking(videos: DataFrame, comments: DataFrame) -> DataFrame:
    """Videos with comment volume, likes and their sum; unordered, sort at the sink."""
    per_video = comments.groupBy("video_id").agg(
        F.count("*").alias("comment_volume"), F.sum("like_count").alias("comment_like_sum")
    )
    out = videos.join(per_video, "video_id", "left")
    out = out.withColumns({n: F.coalesce(n, F.lit(0)).cast("bigint") for n in ("comment_volume", "comment_like_sum")})
    return out.withColumn("engagement_proxy", F.col("comment_volume") + F.col("comment_like_sum"))


def channel_comparison(videos: DataFrame) -> DataFrame:
    return videos.groupBy("channel_title").agg(
        F.countDistinct("video_id").alias("videos"),
        F.sum("view_count").alias("total_views"),
        F.sum("comment_count").alias("total_video_comments"),
    )


def daily_counts(df: DataFrame, time: str, day: str, count: str) -> DataFrame:
    """Rows per calendar day; rows without a readable time are left out."""
    stamp = F.to_date(parse_time(F.col(time)))
    return df.select(stamp.alias(day)).where(F.col(day).isNotNull()).groupBy(day).agg(F.count("*").alias(count))


def quality_summary(comments: DataFrame) -> DataFrame:
    reason = pick(comments, ["exclusion_reason"]).cast("string")
    return comments.groupBy("comment_validity", reason.alias("exclusion_reason")).agg(F.count("*").alias("count"))


def label_counts(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("count"))


def label_shares(df: DataFrame, column: str) -> DataFrame:
    counts = label_counts(df, column).withColumnRenamed(column, "label")
    return share_of_all(counts, "count", "share")


def brand_ratio(df: DataFrame, brand: str = "brand_label") -> DataFrame:
    """Share of each brand within product and region."""
    counts = (
        df.where(F.coalesce(F.col(brand), F.lit("")) != "").groupBy("product", "region", brand).agg(F.count("*").alias("count"))
    )
    return share_of_group(counts, "count", ["product", "region"], "ratio")


def negative_rate_by_topic(df: DataFrame) -> DataFrame:
    out = df.groupBy("product", "region", "topic_label").agg(
        F.count("comment_id").alias("comments"), count_if(F.col("sentiment_label") == "negative").alias("negative_comments")
    )
    return out.withColumn("negative_rate", ratio(F.col("negative_comments"), F.col("comments"), 4))


def negative_density(videos: DataFrame, comments: DataFrame) -> DataFrame:
    """Negative share per video; videos without comments count as zero."""
    per_video = comments.groupBy("video_id").agg(
        count_if(F.col("sentiment_label") == "negative").alias("__neg"), F.count("*").alias("__all")
    )
    base = videos.select(
        *[pick(videos, [n]).alias(n) for n in ("product", "region", "video_id", "title", "video_url")]
    )
    out = base.join(per_video, "video_id", "left").withColumns(
        {"negative_comments": F.coalesce("__neg", F.lit(0)), "total_comments": F.coalesce("__all", F.lit(0))}
    )
    return out.withColumn("negative_density", ratio(F.col("negative_comments"), F.col("total_comments"), 4)).drop("__neg", "__all")


def monitoring_summary(units: DataFrame) -> DataFrame:
    """Sources, opinions, polarity counts and the share of sources with several opinions."""
    per_source = units.groupBy("source_content_id").agg(
        F.count("opinion_id").alias("__n"),
        F.count("*").alias("__rows"),
        *[count_if(F.col("sentiment_code") == s).alias(f"__{s}") for s in ("positive", "negative", "neutral", "excluded")],
    )
    total = per_source.agg(
        F.count("source_content_id").alias("source_count"),
        F.coalesce(F.sum("__rows"), F.lit(0)).alias("opinion_count"),
        *[
            F.coalesce(F.sum(f"__{s}"), F.lit(0)).alias(f"{n}_count")
            for s, n in (("positive", "positive"), ("negative", "negative"), ("neutral", "neutral"), ("excluded", "exclude"))
        ],
        count_if(F.col("__n") > 1).alias("__split"),
    )
    c = F.col
    return total.withColumns(
        {
            "neutral_rate": ratio(c("neutral_count"), c("opinion_count")),
            "exclude_rate": ratio(c("exclude_count"), c("opinion_count")),
            "split_rate": ratio(c("__split"), c("source_count")),
        }
    ).drop("__split")


def reporting_summary(units: DataFrame) -> DataFrame:
    c = F.col
    counts = units.agg(
        count_if(c("sentiment_code") == "positive").alias("positive_count"),
        count_if(c("sentiment_code") == "negative").alias("negative_count"),
    ).withColumn("kpi_opinion_count", c("positive_count") + c("negative_count"))
    return counts.withColumns(
        {
            "positive_share": ratio(c("positive_count"), c("kpi_opinion_count")),
            "negative_share": ratio(c("negative_count"), c("kpi_opinion_count")),
        }
    )


def direct_kpis(comments: DataFrame) -> DataFrame:
    """All headline ratios of a filtered comment frame in one aggregation."""
    c = F.col
    valid = pick(comments, ["comment_validity"], F.lit("valid")) == "valid"
    label = pick(comments, ["sentiment_label"], F.lit(""))
    relevant = F.coalesce(pick(comments, ["relevant_comment"], F.lit(True)), F.lit(False))
    row = comments.agg(
        F.countDistinct(F.when(F.coalesce("comment_id", F.lit("")) != "", c("comment_id"))).alias("source_count"),
        F.count("*").alias("opinion_count"),
        count_if(label == "neutral").alias("neutral_count"),
        count_if(~valid).alias("exclude_count"),
        count_if(valid).alias("valid_count"),
        count_if(valid & (label == "positive")).alias("positive_count"),
        count_if(valid & (label == "negative")).alias("negative_count"),
        count_if(valid & (label == "neutral")).alias("__neutral"),
        count_if(relevant).alias("relevant_count"),
    )
    kpi = c("positive_count") + c("negative_count")
    split = F.greatest(F.lit(0), c("opinion_count") - c("source_count"))
    return row.withColumns(
        {
            "positive_ratio": F.round(ratio(c("positive_count") * 100, c("valid_count")), 4),
            "negative_ratio": F.round(ratio(c("negative_count") * 100, c("valid_count")), 4),
            "neutral_ratio": F.round(ratio(c("__neutral") * 100, c("valid_count")), 4),
            "neutral_rate": ratio(c("neutral_count"), c("opinion_count"), 4),
            "exclude_rate": ratio(c("exclude_count"), c("opinion_count"), 4),
            "split_rate": ratio(split, c("source_count"), 4),
            "positive_share": ratio(c("positive_count"), kpi, 4),
            "negative_share": ratio(c("negative_count"), kpi, 4),
        }
    ).drop("__neutral")


def trust_index(positive: Column, negative: Column) -> Column:
    return F.round((positive - negative) / F.greatest(positive + negative, F.lit(1)) * 50 + 50, 1)


def _polarity_counts(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.count("*").alias("mentions"),
        count_if(F.col("sentiment_label") == "positive").alias("positive_comments"),
        count_if(F.col("sentiment_label") == "negative").alias("negative_comments"),
    )


def brand_trust(df: DataFrame, brand: str = "brand_label", country: str = "region") -> DataFrame:
    """Mentions, share within product and country, and trust index per brand."""
    counts = _polarity_counts(df, [brand, "product", country])
    shared = share_of_group(counts, "mentions", ["product", country], "mention_share", None)
    return shared.withColumn("trust_index", trust_index(F.col("positive_comments"), F.col("negative_comments")))


def stage_trust(df: DataFrame, stage: str = "topic_label", brand: str = "brand_label", country: str = "region",
                order: Sequence[str] = display.CEJ_ORDER) -> DataFrame:
    """Trust index per stage, product, country and brand, with the ordinal of the stage."""
    out = _polarity_counts(df, [stage, "product", country, brand])
    ranks = F.create_map(*[F.lit(x) for i, s in enumerate(order) for x in (s, i)])
    return out.withColumns(
        {
            "trust_index": trust_index(F.col("positive_comments"), F.col("negative_comments")),
            "stage_order": F.element_at(ranks, F.col(stage)),
        }
    )


def insight_type_counts(df: DataFrame, default: str = "일반_의견") -> DataFrame:
    return label_counts(df.where(F.col("insight_type") != default), "insight_type")


def video_sentiment_distribution(df: DataFrame) -> DataFrame:
    """Counts and shares of positive, negative, neutral and excluded comments per video."""
    validity = pick(df, ["comment_validity"], F.lit("valid"))
    code = F.when(validity == "excluded", "excluded").when(validity == "valid", F.col("sentiment_label"))
    codes = ("positive", "negative", "neutral", "excluded")
    counts = df.groupBy("video_id").agg(*[count_if(code == s).alias(s) for s in codes])
    total = F.greatest(F.lit(1), sum((F.col(s) for s in codes[1:]), F.col(codes[0])))
    rows = F.array(*[F.struct(F.lit(s).alias("sentiment_code"), F.col(s).alias("comments"), (F.col(s) / total).alias("ratio")) for s in codes])
    return counts.select("video_id", F.inline(rows))


def top_signal(df: DataFrame, label: str, order: Sequence[str]) -> DataFrame:
    """The label with the top values, as one row; ties go to the smaller label."""
    return df.orderBy(*[F.col(o).desc() for o in order], label).limit(1)


def outliers(df: DataFrame, n: int = 20) -> DataFrame:
    return df.orderBy(F.col("like_count").desc_nulls_last(), F.col("text_length").desc_nulls_last(), "comment_id").limit(n)


def representative_comments(df: DataFrame, per_label: int = 8) -> DataFrame:
    """Eligible comments: distinct by product, stage, axis and text, the best of every polarity.

    ``rank`` runs over negative, positive, mixed, neutral in that order.
    """
    c = F.col
    yes = F.lit(True)

    def flag(name: str, default: Column = F.lit(False)) -> Column:
        return F.coalesce(c(name), default) if name in df.columns else yes

    hygiene = F.lower(F.coalesce(pick(df, ["hygiene_class"], F.lit("strategic")), F.lit("")))
    kept = df.where(
        flag("analysis_included")
        & (hygiene != "trash")
        & flag("representative_eligibility")
        & c("representative_decision").isin("strong_candidate", "review_needed")
        & (F.lower(F.coalesce("classification_type", F.lit(""))) != "informational")
        & flag("product_related")
    )
    label = F.lower(F.coalesce(pick(df, ["sentiment_final"], c("sentiment_label")), c("sentiment_label")))
    stage = F.coalesce(pick(df, ["journey_stage"]).cast("string"), F.lit(""))
    rows = kept.withColumns(
        {
            "sentiment_label": F.when(label.isin("positive", "negative", "neutral", "mixed"), label).otherwise("neutral"),
            "__decision": F.when(c("representative_decision") == "strong_candidate", 0).otherwise(1),
            "__journey": F.when(F.trim(stage).isin("", "S10 Other", "기타"), 0).otherwise(1),
            "__strength": F.abs(F.coalesce("sentiment_score", F.lit(0.0))),
            "__key": F.concat_ws(
                "|",
                F.coalesce("product", F.lit("")),
                stage,
                primary_axis(c("judgment_axes"), pick(df, ["topic_label"], F.lit(""))),
                text_digest(pick(df, ["cleaned_text", "text_display"])),
            ),
        }
    )
    order = [
        c("__decision"), c("__journey").desc(), c("representative_score").desc_nulls_last(),
        c("like_count").desc_nulls_last(), c("__strength").desc(), c("comment_id"),
    ]
    once = top_per_group(rows, ["sentiment_label", "__key"], order, 1)
    best = top_per_group(once, ["sentiment_label"], order, per_label, "label_rank")
    base = F.element_at(F.create_map(*[F.lit(x) for i, s in enumerate(("negative", "positive", "mixed", "neutral")) for x in (s, i)]), c("sentiment_label"))
    return best.withColumn("rank", base * per_label + c("label_rank")).drop("__decision", "__journey", "__strength", "__key")


def scope_sizes(issues: DataFrame, comments: DataFrame) -> DataFrame:
    """Comments in the scope of each issue and the issue's share of them, at most one."""
    levels = F.array(
        F.struct(F.lit("video").alias("level_type"), F.col("video_id").cast("string").alias("level_id")),
        F.struct(F.lit("product_group").alias("level_type"), F.col("product").cast("string").alias("level_id")),
    )
    sizes = comments.select(F.inline(levels)).groupBy("level_type", "level_id").agg(F.count("*").alias("scope_size"))
    out = attach(issues, sizes, ["level_type", "level_id"], derived=True).withColumn("scope_size", F.coalesce("scope_size", F.lit(0)))
    share = F.least(ratio(F.col("supporting_cluster_count"), F.col("scope_size")), F.lit(1.0))
    return out.withColumn("issue_ratio", share)
