"""The comment run: normalize, label, settle the truth, split opinions, aggregate."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxframe.functions.text import clean_text, detect_pii, external_links, html_unescape, language_hint, mask_pii, quality_class
from voxframe.operators import descriptive as ds
from voxframe.operators import insights as ins
from voxframe.operators import labels as lb
from voxframe.operators import opinions as op
from voxframe.operators import strategy as st
from voxframe.operators import trends as tn
from voxframe.operators import truth as tr
from voxframe.operators.relational import attach, flag_duplicates, keep_last
from voxframe.operators.videos import SelectionPolicy, annotate_relevance
from voxframe.session import materialize


def normalize_comments(df: DataFrame, sequence: str = "published_at") -> DataFrame:
    """Cleaned text, quality, language, personal data and links; the last row of a comment wins."""
    c = F.col
    out = keep_last(df, ["video_id", "comment_id"], sequence)
    out = out.withColumns({"text_original": F.coalesce("text_original", F.lit(""))})
    out = out.withColumns({"text_display": F.coalesce("text_display", "text_original"), "__raw": html_unescape(c("text_original"))})
    out = out.withColumn("cleaned_text", clean_text(c("__raw"), unescape=False))
    out = out.withColumns(
        {
            "text_length": F.length("cleaned_text"), "language_detected": language_hint(c("cleaned_text")),
            "comment_quality": quality_class(c("__raw"), c("cleaned_text")), "__pii": detect_pii(c("text_original")), "external_links": external_links(c("text_original")),
        }
    )
    valid = c("comment_quality") == "valid"
    return out.withColumns(
        {
            "comment_validity": F.when(valid, "valid").otherwise("excluded"), "exclusion_reason": F.when(~valid, c("comment_quality")),
            "hygiene_class": F.when(valid, "strategic").otherwise("trash"), "analysis_included": valid & (c("cleaned_text") != ""),
            "pii_flag": c("__pii.flag"), "pii_types": c("__pii.types"), "pii_raw_text": c("__pii.values"),
            "masked_text": mask_pii(c("text_original"), c("__pii.values")), "context_attachment": F.coalesce(F.try_element_at("external_links", F.lit(1)), F.lit("")),
        }
    ).drop("__raw", "__pii")


def with_parent_text(df: DataFrame) -> DataFrame:
    """Text of the parent comment, looked up among the included comments; empty where there is none."""
    parents = df.where("analysis_included").select(F.col("comment_id").alias("parent_comment_id"), F.col("text_display").alias("__parent"))
    joined = attach(df, parents, ["parent_comment_id"], derived=True)
    return joined.withColumn("parent_comment_text", F.coalesce("__parent", F.lit(""))).drop("__parent")


def run_comments(
    videos: DataFrame,
    comments: DataFrame,
    policy: SelectionPolicy,
    enrichment: DataFrame | None = None,
    risk_keywords: Sequence[str] = (),
    comment_rules: lb.CommentRules = lb.CommentRules(),
    truth_rules: tr.TruthRules = tr.DEFAULT,
    opinion_rules: op.OpinionRules = op.DEFAULT,
    hold: Callable[[DataFrame], DataFrame] = materialize,
) -> dict[str, DataFrame]:
    """All tables of a comment run. Labelled comments, opinion units and representatives are written once."""
    c = F.col
    videos = annotate_relevance(videos, policy)
    context = videos.dropDuplicates(["video_id"]).select("video_id", "product", "region", "title", "channel_title", "video_url", "is_relevant_video", "video_relevance_score")
    normalized = hold(normalize_comments(comments))
    rows = attach(normalized.drop("product", "region", "title", "channel_title", "video_url"), context, ["video_id"])
    rows = hold(with_parent_text(rows))
    if enrichment is not None:
        rows = lb.attach_enrichment(rows, enrichment)
    labelled = hold(lb.classify_comments(rows, rules=comment_rules))
    labelled = labelled.withColumns({"__low": F.lower("cleaned_text"), "__brand": F.lower(F.concat_ws(" ", "cleaned_text", F.coalesce("title", F.lit(""))))})
    labelled = labelled.withColumns({"topic_label": lb.topic_by_markers(c("__low")), "brand_label": lb.brand_by_markers(c("__brand")), "risk_flags": lb.risk_flags(c("__low"), risk_keywords) if risk_keywords else F.lit("")})
    labelled = tr.representative_scorecard(labelled.drop("__low", "__brand"))
    labelled = hold(flag_duplicates(labelled, ["video_id"], "cleaned_text"))
    truth = hold(tr.build_truth(labelled, truth_rules))
    merged = hold(tr.normalize_taxonomy(tr.merge_truth(labelled, truth), truth_rules))
    subsets = tr.hygiene_subsets(merged)
    non_trash, strategic = subsets["analysis_non_trash"], subsets["analysis_strategic"]
    units = hold(op.opinion_units(strategic, opinion_rules))
    representatives = hold(ds.representative_comments(strategic))
    trend = tn.weekly_keywords(non_trash)
    new, persistent = tn.issue_keywords(trend)
    candidates = hold(st.strategy_candidates(non_trash, representatives))
    bundles = op.representative_bundles(units)
    return {
        "videos": videos, "comments": merged, "comment_truth": truth, **subsets, "opinion_units": units, "representative_bundles": bundles,
        "source_records": op.source_records(units), "representative_section": op.representative_section(bundles),
        "runs_summary": ds.runs_summary(videos, merged), "video_ranking": ds.video_ranking(videos, merged), "channel_comparison": ds.channel_comparison(videos),
        "upload_distribution": ds.daily_counts(videos, "published_at", "upload_date", "video_count"),
        "comment_time_trend": ds.daily_counts(merged, "published_at", "comment_date", "comment_count"), "quality_summary": ds.quality_summary(merged),
        "monitoring_summary": ds.monitoring_summary(units), "reporting_summary": ds.reporting_summary(units), "keyword_analysis": tn.top_keywords(strategic),
        "sentiment_summary": ds.label_counts(non_trash, "sentiment_label"), "topic_summary": ds.label_counts(non_trash, "topic_label"),
        "representative_comments": representatives, "outlier_comments": ds.outliers(non_trash), "weekly_sentiment_trend": tn.weekly_sentiment(non_trash),
        "weekly_keyword_trend": trend, "new_issue_keywords": new, "persistent_issue_keywords": persistent, "brand_ratio": ds.brand_ratio(non_trash),
        "cej_negative_rate": ds.negative_rate_by_topic(non_trash), "negative_density": ds.negative_density(videos, non_trash),
        "nlp_topic_insights": ins.topic_pivot(non_trash), "nlp_keyword_insights": ins.keyword_frequency(non_trash), "nlp_inquiry_summary": ins.inquiries(non_trash),
        "nlp_product_mentions": ins.product_mentions(non_trash), "nlp_sentiment_distribution": ds.label_shares(non_trash, "nlp_label"),
        "strategy_insight_candidates": candidates, "strategy_insights": st.strategy_insights(candidates),
    }
