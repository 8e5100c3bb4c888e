"""Faceted filters over the tables of a run, display labels, and the options a filter can offer."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxframe.functions.parsing import query_terms
from voxframe.functions.scores import parse_time
from voxframe.functions.text import collapse_space, safe_text
from voxframe.operators.descriptive import count_if
from voxframe.operators.relational import attach
from voxframe.rules import display
from voxframe.schemas import pick

PRODUCT_ORDER = ("냉장고", "세탁기", "건조기", "식기세척기", "청소기", "오븐", "정수기", "인덕션", "와인셀러", "컵세척기", "실내식물재배기(틔운)")


def lookup(table: Mapping[str, str], key: Column, default: Column) -> Column:
    if not table:
        return default
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key), default)


def canonical_product(value: Column, order: Sequence[str] = PRODUCT_ORDER, aliases: Mapping[str, str] = display.PRODUCT_LABEL_ALIASES) -> Column:
    """Known product of a label: exact name, else the first alias inside it, else empty."""
    raw = F.trim(F.regexp_replace(collapse_space(safe_text(value)), r"(추천|리뷰|후기|비교|영상)\s*$", ""))
    chain = F.when(raw == "", "").when(raw.isin(*order), raw)
    for marker, name in aliases.items():
        chain = chain.when(raw.contains(marker), name)
    return chain.otherwise("")


def canonical_brand(value: Column, brands: Mapping[str, str] = display.BRAND_CANONICAL_MAP, missing: str = "미언급") -> Column:
    raw = safe_text(value)
    return F.when(raw == "", missing).otherwise(lookup(brands, F.lower(raw), raw))


def canonical_stage(value: Column, stages: Mapping[str, str] = display.CEJ_CANONICAL_MAP, order: Sequence[str] = display.CEJ_ORDER, other: str = "기타") -> Column:
    raw = safe_text(value)
    return F.when(raw == "", other).otherwise(lookup(stages, F.lower(raw), F.when(raw.isin(*order), raw).otherwise(other)))


def localize(value: Column, labels: Mapping[str, str]) -> Column:
    """Display label of a code; unknown codes stay."""
    return lookup(labels, value.cast("string"), value.cast("string"))


def localized_columns(df: DataFrame) -> DataFrame:
    """Codes, display labels and week of each comment; invalid comments form the excluded bucket."""
    validity = pick(df, ["comment_validity"], F.lit("valid"))
    code = F.coalesce(F.when(validity == "valid", pick(df, ["sentiment_label"]).cast("string")).otherwise("excluded"), F.lit("neutral"))
    out = df.withColumns(
        {
            "sentiment_code": code,
            "country": localize(pick(df, ["region"], F.lit("")), display.REGION_LABELS),
            "sentiment": localize(code, display.SENTIMENT_LABELS),
            "stage": canonical_stage(pick(df, ["topic_label"], F.lit("기타"))),
            "brand": canonical_brand(pick(df, ["brand_label"], F.lit("미언급"))),
            "written_at": parse_time(pick(df, ["published_at"])),
        }
    )
    out = out.withColumn("week_start", F.date_format(F.date_trunc("week", "written_at"), "yyyy-MM-dd"))
    if "product" in df.columns:
        product = canonical_product(F.col("product"))
        if "product_target" in df.columns:
            target = F.lower(safe_text(F.col("product_target")))
            part = canonical_product(lookup(display.PRODUCT_TARGET_KR_MAP, target, safe_text(F.col("product_target"))))
            product = F.when(part != "", part).otherwise(product)
        out = out.withColumn("product", product)
    return out


@dataclass(frozen=True)
class FilterSpec:
    """Chosen facet values. ``None`` leaves a facet open, an empty tuple selects nothing."""

    products: Sequence[str] | None = None
    regions: Sequence[str] | None = None
    sentiments: Sequence[str] | None = None
    stages: Sequence[str] | None = None
    brands: Sequence[str] | None = None
    keywords: str = ""
    keyword_mode: str = "AND"
    inquiries: str = "all"
    relevant_only: bool = False
    known_regions: Sequence[str] = ("KR", "US")
    other_region: str = display.REGION_OTHER_LABEL


def one_of(column: Column, values: Sequence[str] | None) -> Column:
    if values is None:
        return F.lit(True)
    return F.coalesce(column.isin(*values), F.lit(False)) if values else F.lit(False)


def in_regions(column: Column, spec: FilterSpec) -> Column:
    """Chosen regions; the other bucket stands for all unknown ones."""
    if spec.regions is None or spec.other_region not in spec.regions:
        return one_of(column, spec.regions)
    known = F.coalesce(column.isin(*spec.known_regions), F.lit(False))
    return one_of(column, spec.regions) | ~known


def keyword_mask(df: DataFrame, query: str, mode: str = "AND") -> Column:
    """Comments whose texts hold all (or any) of the comma-separated terms."""
    terms = query_terms(query)
    if not terms:
        return F.lit(True)
    blob = F.lower(F.concat_ws(" ", F.coalesce(pick(df, ["cleaned_text"], F.lit("")), F.lit("")), F.coalesce(pick(df, ["text_display"], F.lit("")), F.lit(""))))
    test = None
    for term in terms:
        found = blob.contains(term.lower())
        test = found if test is None else (test | found if mode.upper() == "OR" else test & found)
    return test


def facets(df: DataFrame, spec: FilterSpec, sentiment: str | None, stage: str, brand: str) -> DataFrame:
    """Apply the facets whose columns the frame has."""
    test = F.lit(True)
    for name, values in (("product", spec.products), (stage, spec.stages), (brand, spec.brands)):
        if name in df.columns:
            test = test & one_of(F.col(name), values)
    if "region" in df.columns:
        test = test & in_regions(F.col("region"), spec)
    if sentiment and sentiment in df.columns:
        test = test & one_of(F.lower(sentiment), spec.sentiments)
    return df.where(test)


def _relevant(df: DataFrame, spec: FilterSpec) -> DataFrame:
    if not spec.relevant_only:
        return df
    for name in ("relevant_comment", "is_relevant_video"):
        if name in df.columns:
            return df.where(F.coalesce(name, F.lit(False)))
    return df.where(F.coalesce("video_relevance_score", F.lit(0.0)) >= 0.45) if "video_relevance_score" in df.columns else df


def _by_inquiry(df: DataFrame, ids: DataFrame, key: str, spec: FilterSpec) -> DataFrame:
    if spec.inquiries == "all":
        return df
    how = "left_semi" if spec.inquiries == "only" else "left_anti"
    return attach(df, ids.withColumnRenamed("comment_id", key), [key], how, derived=True)


def filtered_bundle(
    spec: FilterSpec,
    comments: DataFrame,
    videos: DataFrame,
    opinions: DataFrame,
    bundles: DataFrame | None = None,
    quality: DataFrame | None = None,
    non_trash: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """All tables of a view under one filter, and its counts as a one-row table."""
    opinions = facets(opinions, spec, "sentiment_code", "cej_scene_code", "brand_mentioned")
    ids = opinions.where(F.coalesce("inquiry_flag", F.lit(False))).select(F.col("source_content_id").alias("comment_id")).distinct()
    base = facets(comments, spec, None, "stage", "brand").where(keyword_mask(comments, spec.keywords, spec.keyword_mode))
    base = _by_inquiry(base, ids, "comment_id", spec)
    scoped = _relevant(base, spec)
    shown = scoped.where(one_of(F.lower("sentiment_label"), spec.sentiments))
    out = {
        "comments": shown,
        "all_comments": scoped,
        "videos": _relevant(facets(videos, spec, None, "stage", "brand"), spec),
        "opinion_units": opinions,
        "counts": shown.agg(
            count_if(pick(comments, ["comment_validity"], F.lit("valid")) == "excluded").alias("removed_count"),
            count_if(pick(comments, ["comment_validity"], F.lit("valid")) == "valid").alias("meaningful_count"),
        ).select(
            "*",
            opinions.agg(count_if(F.col("inquiry_flag"))).scalar().alias("inquiry_count"),
            base.agg(F.count("*")).scalar().alias("before_relevance_count"),
            scoped.agg(F.count("*")).scalar().alias("after_relevance_count"),
        ),
    }
    if bundles is not None:
        out["representative_bundles"] = _by_inquiry(facets(bundles, spec, None, "stage", "brand_mentioned"), ids, "top_source_content_id", spec)
    if quality is not None:
        out["quality"] = facets(quality, spec, None, "stage", "brand")
    if non_trash is not None:
        kept = facets(non_trash, spec, "sentiment_final", "stage", "brand").where(keyword_mask(non_trash, spec.keywords, spec.keyword_mode))
        out["analysis_non_trash"] = _relevant(_by_inquiry(kept, ids, "comment_id", spec), spec)
    return out


def filter_options(comments: DataFrame, videos: DataFrame, column: str, allowed: Sequence[str]) -> DataFrame:
    """Values present in either table that a filter offers, in the order of the list."""
    present = comments.select(column).unionByName(videos.select(column)).distinct()
    ranks = F.create_map(*[F.lit(x) for i, v in enumerate(allowed) for x in (v, i)])
    return present.where(F.col(column).isin(*allowed)).select(column, F.element_at(ranks, F.col(column)).alias("position"))
