"""Strategy insights per video and product group, and the issue table made from them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxframe.functions.parsing import first_distinct
from voxframe.functions.scores import clamp, parse_time
from voxframe.functions.text import collapse_space, strip
from voxframe.operators.descriptive import count_if, scope_sizes
from voxframe.operators.labels import fill_template
from voxframe.operators.relational import attach, top_per_group
from voxframe.rules import display, messages
from voxframe.schemas import pick

LEVEL = ("level_type", "level_id")
CLUSTER = (*LEVEL, "journey_stage", "primary_axis", "polarity_direction")
# Weight of each polarity in the priority signal.
POLARITY_WEIGHTS = {"negative": 1.25, "mixed": 1.1, "positive": 0.9, "neutral": 0.6}
CRITICAL_STAGES = ("maintenance", "usage", "delivery", "onboarding")
EARLY_STAGES = ("awareness", "exploration", "purchase", "decision")
SERVICE_AXES = ("service_after_sales",)
PRODUCT_AXES = (
    "maintenance_burden", "durability_lifespan", "installation_space_fit", "design_interior_fit", "automation_convenience",
    "usage_pattern_fit",
)
MARKETING_AXES = ("brand_trust", "comparison_substitute_judgment")
BUSINESS_AXES = ("price_value_fit", "purchase_strategy_contract")


def _lookup(table: Mapping[str, object], key: Column, default: Column) -> Column:
    pairs = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.coalesce(F.element_at(pairs, key), default)


def polarity(c: Column) -> Column:
    low = F.lower(strip(F.coalesce(c.cast("string"), F.lit(""))))
    return F.when(low.isin("positive", "negative", "mixed", "neutral"), low).otherwise("neutral")


def problem_signature(df: DataFrame) -> Column:
    """Digest of all external keys, else of all words of the texts; rows without either share one."""
    def listed(name: str) -> Column:
        value = F.coalesce(pick(df, [name]).cast("array<string>"), F.array().cast("array<string>"))
        return F.array_distinct(F.filter(F.transform(value, lambda t: strip(t)), lambda t: t != ""))

    tags = F.concat(*[listed(n) for n in ("nlp_similarity_keys", "nlp_core_points", "nlp_context_tags")])
    blank = F.lit("")
    raw = F.concat_ws(" ", *[strip(pick(df, [n], blank).cast("string")) for n in ("cleaned_text", "text_display", "classification_type")])
    cleaned = collapse_space(F.regexp_replace(F.lower(raw), r"(?U)[^\w\s]+", " "))
    words = F.filter(F.split(cleaned, r"[\s,|;/]+"), lambda t: F.length(t) >= 2)
    chosen = F.when(F.size(tags) > 0, tags).otherwise(words)
    return F.when(F.size(chosen) > 0, F.md5(F.array_join(chosen, "|"))).otherwise("general_signal")


def strategy_base(df: DataFrame) -> DataFrame:
    """Included comments with stage, first axis, polarity, signature and reach."""
    axes = first_distinct(F.coalesce(pick(df, ["judgment_axes"]).cast("array<string>"), F.array().cast("array<string>")), 3)
    sentiment = pick(df, ["sentiment_final", "sentiment_label"], F.lit("neutral"))
    hygiene = F.lower(F.coalesce(pick(df, ["hygiene_class"], F.lit("strategic")), F.lit("")))
    included = F.coalesce(pick(df, ["analysis_included"], F.lit(True)), F.lit(False))
    likes, replies = (F.coalesce(pick(df, [n]).try_cast("double"), F.lit(0.0)) for n in ("like_count", "reply_count"))
    return df.where(included & (hygiene != "trash")).select(
        strip(F.coalesce(pick(df, ["video_id"]).cast("string"), F.lit(""))).alias("video_id"),
        strip(F.coalesce(pick(df, ["product"]).cast("string"), F.lit(""))).alias("product"),
        strip(F.coalesce(pick(df, ["journey_stage"]).cast("string"), F.lit(""))).alias("journey_stage"),
        F.coalesce(F.try_element_at(axes, F.lit(1)), F.lit("unknown_axis")).alias("primary_axis"),
        polarity(sentiment).alias("polarity_direction"),
        F.coalesce(pick(df, ["mixed_flag"], F.lit(False)), F.lit(False)).alias("mixed_flag"),
        (likes + replies * 1.5).alias("reach"),
        problem_signature(df).alias("problem_signature"),
    )


def _levels(df: DataFrame, *columns: str) -> DataFrame:
    """Each row once per level it belongs to."""
    pairs = F.array(
        F.struct(F.lit("video").alias("level_type"), F.col("video_id").cast("string").alias("level_id")),
        F.struct(F.lit("product_group").alias("level_type"), F.col("product").cast("string").alias("level_id")),
    )
    return df.select(F.inline(pairs), *columns).where(F.coalesce("level_id", F.lit("")) != "")


def cluster_representatives(representatives: DataFrame, n: int = 5) -> DataFrame:
    """Ids of the first representatives per level, stage, axis and polarity."""
    order = "rank" if "rank" in representatives.columns else "comment_id"
    sentiment = pick(representatives, ["sentiment_final", "sentiment_label"], F.lit("neutral"))
    rows = representatives.where(F.coalesce("comment_id", F.lit("")) != "").select(
        "video_id", "product", "comment_id", F.col(order).alias("__order"),
        F.coalesce(F.col("journey_stage"), F.lit("")).alias("journey_stage"),
        F.explode(F.array_distinct("judgment_axes")).alias("primary_axis"),
        polarity(sentiment).alias("polarity_direction"),
    )
    per_level = _levels(rows, "comment_id", "__order", "journey_stage", "primary_axis", "polarity_direction")
    best = top_per_group(per_level, CLUSTER, [F.col("__order"), F.col("comment_id")], n, "__rank")
    ids = F.transform(F.array_sort(F.collect_list(F.struct("__rank", "comment_id"))), lambda s: s["comment_id"])
    return best.groupBy(*CLUSTER).agg(ids.alias("supporting_representatives"))


def priority_signal(size: Column, share: Column, impact: Column, direction: Column, mixed: Column) -> Column:
    """Share, repetition, reach and mix, weighted by polarity; at most 100."""
    raw = (
        share * 0.55
        + F.least(size, F.lit(30)) / 30.0 * 0.30
        + F.least(F.log1p(F.greatest(impact, F.lit(0.0))), F.lit(6.0)) / 6.0 * 0.15
        + clamp(mixed, 0, 1) * 0.2
    ) * _lookup(POLARITY_WEIGHTS, direction, F.lit(0.7))
    return F.round(F.least(raw * 100.0, F.lit(100.0)), 1)


def strategy_candidates(comments: DataFrame, representatives: DataFrame, texts: bool = True) -> DataFrame:
    """One row per level, stage, axis and polarity with evidence and the reasons it may be insufficient.

    The grouping combines before the shuffle; level totals come from the grouped rows, not from the comments.
    """
    c = F.col
    base = strategy_base(comments)
    rows = _levels(base, *[n for n in base.columns if n != "video_id"])
    clusters = rows.groupBy(*CLUSTER).agg(
        F.count("*").alias("supporting_cluster_count"),
        F.avg(c("mixed_flag").cast("double")).alias("__mixed"),
        F.sum("reach").alias("__impact"),
        F.countDistinct("problem_signature").alias("distinct_signatures"),
    )
    # The most frequent product of a video cluster, ties to the smaller name, from pre-counted products.
    by_product = rows.where("level_type = 'video'").groupBy(*CLUSTER, "product").agg(F.count("*").alias("__n"))
    main = by_product.groupBy(*CLUSTER).agg(F.min_by("product", F.struct(-c("__n"), "product")).alias("__product"))
    totals = clusters.groupBy(*LEVEL).agg(F.sum("supporting_cluster_count").alias("__total"))
    out = clusters.join(main, list(CLUSTER), "left").join(totals, list(LEVEL))
    out = attach(out, cluster_representatives(representatives), CLUSTER, derived=True)
    size = c("supporting_cluster_count")
    no_ids = F.array().cast("array<string>")
    out = out.withColumns(
        {
            "__share": size / c("__total"),
            "supporting_representatives": F.coalesce("supporting_representatives", no_ids),
        }
    )
    missing = {
        "cluster_lt_3": size < 3,
        "journey_stage_missing": c("journey_stage") == "",
        "judgment_axis_missing": c("primary_axis").isin("", "unknown_axis"),
        "representative_link_missing": F.size("supporting_representatives") == 0,
    }
    reasons = F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in missing.items()]))
    is_video = c("level_type") == "video"
    out = out.select(
        *LEVEL,
        F.when(is_video, c("level_id")).otherwise("").alias("video_id"),
        F.when(is_video, F.coalesce("__product", F.lit(""))).otherwise(c("level_id")).alias("product_group"),
        "journey_stage",
        F.array("primary_axis").alias("judgment_axes"),
        "polarity_direction",
        priority_signal(size, c("__share"), c("__impact"), c("polarity_direction"), c("__mixed")).alias("priority_signal"),
        "supporting_representatives",
        "supporting_cluster_count",
        reasons.alias("insufficient_reasons"),
        F.round("__mixed", 4).alias("mixed_ratio"),
        size.alias("repetition_signal"),
        F.round("__impact", 2).alias("impact_signal"),
        c("__total").alias("level_total"),
        "distinct_signatures",
    ).withColumn("insufficient_evidence", F.size("insufficient_reasons") > 0)
    return insight_texts(out) if texts else out


def insight_texts(df: DataFrame) -> DataFrame:
    """Title, summary and evidence line of each insight."""
    c = F.col
    axis = c("judgment_axes")[0]
    stage_name = _lookup(display.STAGE_KO, c("journey_stage"), F.when(c("journey_stage") != "", c("journey_stage")).otherwise(messages.UNKNOWN_STAGE))
    axis_name = _lookup(display.AXIS_KO, axis, F.replace(axis, F.lit("_"), F.lit(" ")))
    size = c("supporting_cluster_count")
    parts = {
        "stage": stage_name,
        "axis": axis_name,
        "polarity": _lookup(messages.POLARITY_TITLES, c("polarity_direction"), F.lit("신호")),
        "size": F.format_number(size, 0),
        "share": F.format_string("%.1f", size / F.greatest(c("level_total"), F.lit(1)) * 100.0),
        "signatures": F.format_number("distinct_signatures", 0),
        "impact": F.format_string("%.1f", c("impact_signal")),
    }
    summary = None
    for name, template in messages.INSIGHT_SUMMARIES.items():
        text = fill_template(template, **parts)
        test = c("polarity_direction") == name
        summary = F.when(test, text) if summary is None else summary.when(test, text)
    return df.withColumns(
        {
            "insight_title": fill_template(messages.INSIGHT_TITLE, **parts),
            "insight_summary": summary,
            # The evidence line writes its counts without separators.
            "evidence_summary": fill_template(messages.EVIDENCE_SUMMARY, **{**parts, "size": size.cast("string"), "signatures": c("distinct_signatures").cast("string")}),
        }
    )


def strategy_insights(candidates: DataFrame) -> DataFrame:
    """Candidates with sufficient evidence."""
    return candidates.where(~F.col("insufficient_evidence")).drop("insufficient_reasons")


# Issue table ---------------------------------------------------------------------------------------


def _direction_keys(df: DataFrame, exclusive: bool) -> Column:
    """Polarities a comment counts for. Mixed rows count as mixed, and if not ``exclusive`` also as their label."""
    mixed = F.coalesce(pick(df, ["mixed_flag"], F.lit(False)), F.lit(False))
    label = F.lower(F.coalesce(pick(df, ["sentiment_final"]).cast("string"), F.lit("")))
    own = F.when(label != "mixed", label) if not exclusive else F.when((label != "mixed") & ~mixed, label)
    return F.array_compact(F.array(own, F.when(mixed, F.lit("mixed"))))


def issue_trend(issues: DataFrame, comments: DataFrame, time: str = "published_at", days: int = 14) -> DataFrame:
    """State of each issue from its last two spans of ``days`` before its newest comment.

    Comments match by stage, polarity and first axis; they are grouped once for all issues.
    """
    keys = ["__stage", "polarity_direction", "__axis"]
    keyed = issues.withColumns({"__stage": F.lower("journey_stage"), "__axis": F.coalesce(F.try_element_at("judgment_axes", F.lit(1)), F.lit(""))})
    rows = comments.select(
        F.lower("journey_stage").alias("__stage"),
        F.explode(_direction_keys(comments, exclusive=False)).alias("polarity_direction"),
        "judgment_axes",
        parse_time(F.col(time)).alias("__ts"),
    ).where(F.col("__ts").isNotNull())
    rows = rows.select("__stage", "polarity_direction", F.explode(F.array_distinct("judgment_axes")).alias("__axis"), "__ts")
    rows = attach(rows, keyed.select(*keys).distinct(), keys, "left_semi", derived=True)
    ends = rows.groupBy(*keys).agg(F.max("__ts").alias("__end"))
    dated = attach(rows, ends, keys, derived=True)
    first, second = (F.col("__end") - F.expr(f"INTERVAL {n} DAYS") for n in (days, 2 * days))
    spans = dated.groupBy(*keys).agg(
        count_if(F.col("__ts") > first).alias("recent_count"),
        count_if((F.col("__ts") > second) & (F.col("__ts") <= first)).alias("previous_count"),
    )
    out = attach(keyed, spans, keys, derived=True)
    recent, previous = F.coalesce("recent_count", F.lit(0)), F.coalesce("previous_count", F.lit(0))
    states = messages.ISSUE_STATES
    state = (
        F.when(F.coalesce("insufficient_evidence", F.lit(False)) | (recent + previous < 6), states["none"])
        .when((previous == 0) & (recent >= 3), states["new"])
        .when(previous == 0, states["none"])
        .when((recent >= previous * 1.2) & (recent - previous >= 2), states["up"])
        .when((recent <= previous * 0.8) & (previous - recent >= 2), states["down"])
        .otherwise(states["steady"])
    )
    return out.withColumns({"issue_state": state, "recent_count": recent, "previous_count": previous}).drop("__stage", "__axis")


def impact_level(insufficient: Column, size: Column, share: Column, impact: Column) -> Column:
    return (
        F.when(insufficient, "Low")
        .when((impact >= 15000) | (size >= 500) | (share >= 0.08), "High")
        .when((impact >= 3000) | (size >= 120) | (share >= 0.03), "Medium")
        .otherwise("Low")
    )


def priority_level(insufficient: Column, direction: Column, stage: Column, impact: Column, size: Column) -> Column:
    critical = stage.isin(*CRITICAL_STAGES)
    high, medium = impact == "High", impact == "Medium"
    negative = (
        F.when(high, "High")
        .when(medium, F.when(critical, "High").otherwise("Medium"))
        .otherwise(F.when(critical & (size >= 30), "Medium").otherwise("Low"))
    )
    mixed = F.when(high, "High").when(medium, "Medium").otherwise("Low")
    return (
        F.when(insufficient, "Low").when(direction == "negative", negative).when(direction == "mixed", mixed)
        .when(direction == "positive", F.when(high, "Medium").otherwise("Low")).otherwise("Low")
    )


def action_label(insufficient: Column, direction: Column, stage: Column, axes: Column, size: Column, share: Column, impact: Column) -> Column:
    def touches(*groups: Sequence[str]) -> Column:
        return F.arrays_overlap(axes, F.array(*[F.lit(a) for g in groups for a in g]))

    large = (size >= 120) | (share >= 0.03) | (impact >= 5000)
    early, handover = stage.isin(*EARLY_STAGES), stage.isin("delivery", "onboarding")
    mixed = (
        F.when(early & touches(MARKETING_AXES, BUSINESS_AXES), "marketing_message")
        .when(handover | touches(SERVICE_AXES), "service_operation")
        .when(touches(PRODUCT_AXES), "product_improvement")
        .otherwise("monitor")
    )
    negative = (
        F.when(large & (stage.isin(*CRITICAL_STAGES) | touches(SERVICE_AXES, PRODUCT_AXES)), "immediate_fix")
        .when(handover | touches(SERVICE_AXES), "service_operation")
        .when(touches(PRODUCT_AXES), "product_improvement")
        .when(touches(MARKETING_AXES, BUSINESS_AXES) | early, "marketing_message")
        .otherwise("monitor")
    )
    return (
        F.when(insufficient, "monitor").when(direction == "positive", F.when(large, "maintain_strength").otherwise("monitor"))
        .when(direction == "mixed", mixed).when(direction == "negative", negative).otherwise("monitor")
    )


def action_domains(axes: Column) -> Column:
    default = F.lit("operations / service")
    domains = F.transform(axes, lambda a: _lookup(display.ACTION_DOMAIN_BY_AXIS, a, default))
    joined = F.array_join(first_distinct(domains, 2), ", ")
    return F.when(F.size(axes) > 0, joined).otherwise(default)


def issue_table(strategy: DataFrame, comments: DataFrame) -> DataFrame:
    """Strategy rows with labels, trend state, share, impact, priority, action and ranking score."""
    c = F.col
    sized = scope_sizes(issue_trend(strategy, comments), comments)
    insufficient = F.coalesce("insufficient_evidence", F.lit(False))
    stage, size, share, impact = F.lower("journey_stage"), c("supporting_cluster_count"), c("issue_ratio"), c("impact_signal")
    out = sized.withColumns(
        {
            "scope_label": F.when(c("level_type") == "video", "영상").otherwise("제품군"),
            "journey_stage_label": _lookup(display.STAGE_KO, stage, F.when(stage != "", stage).otherwise(messages.UNKNOWN_STAGE)),
            "judgment_axis_label": F.array_join(F.transform("judgment_axes", lambda a: _lookup(display.AXIS_KO, a, a)), ", "),
            "action_domain": action_domains(c("judgment_axes")),
            "impact_level": impact_level(insufficient, size, share, impact),
            "action_label": action_label(insufficient, c("polarity_direction"), stage, c("judgment_axes"), size, share, impact),
        }
    )
    out = out.withColumn("priority_level", priority_level(insufficient, c("polarity_direction"), stage, c("impact_level"), size))
    rank = lambda table, col: _lookup(table, c(col), F.lit(1))
    boost = F.when(c("polarity_direction") == "negative", 0.25).when(c("polarity_direction") == "mixed", 0.1).otherwise(0.0)
    return out.withColumns(
        {
            "action_label_ko": _lookup(display.ACTION_LABEL_KO, c("action_label"), c("action_label")),
            "issue_key": F.concat_ws("|", "scope_label", "level_id", "journey_stage", F.to_json("judgment_axes"), "polarity_direction"),
            "ranking_score": rank(display.PRIORITY_RANK, "priority_level") * 100.0
            + rank(display.IMPACT_RANK, "impact_level") * 25.0 + size * 0.1 + share * 100.0 + boost,
        }
    )


def issue_order() -> list[Column]:
    """Sort keys of the issue table, with the issue key as the last word."""
    return [
        _lookup(display.PRIORITY_RANK, F.col("priority_level"), F.lit(0)).desc(),
        _lookup(display.IMPACT_RANK, F.col("impact_level"), F.lit(0)).desc(),
        F.col("supporting_cluster_count").desc(),
        F.col("issue_ratio").desc(),
        F.col("priority_signal").desc(),
        F.col("issue_key"),
    ]


def ranked_issues(issues: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` issues with their rank."""
    top = issues.orderBy(*issue_order()).limit(limit)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*issue_order())))


def search_issues(issues: DataFrame, query: str) -> DataFrame:
    """Issues whose texts hold all the words of the query."""
    terms = [t for t in query.lower().replace(",", " ").split() if t]
    parts = [n for n in ("insight_title", "insight_summary", "action_label_ko", "level_id", "journey_stage_label", "judgment_axis_label") if n in issues.columns]
    blob = F.lower(F.concat_ws(" ", *[F.coalesce(n, F.lit("")) for n in parts]))
    for term in terms:
        issues = issues.where(blob.contains(term))
    return issues


def issue_product(df: DataFrame) -> Column:
    return F.when(F.col("level_type") == "product_group", F.col("level_id")).otherwise(F.col("product_group"))


def keep_products(issues: DataFrame, products: Sequence[str]) -> DataFrame:
    return issues.where(issue_product(issues).isin(*products)) if products else issues


def guard_priority(issues: DataFrame) -> DataFrame:
    """An issue without share cannot be of high priority."""
    empty = (F.coalesce("issue_ratio", F.lit(0.0)) <= 0) & (F.col("priority_level") == "High")
    return issues.withColumns(
        {
            "priority_level": F.when(empty, "Medium").otherwise(F.col("priority_level")),
            "insufficient_evidence": F.when(empty, True).otherwise(F.col("insufficient_evidence")),
        }
    )


def scope_strategy(strategy: DataFrame, videos: DataFrame | None = None, products: Sequence[str] = (), polarities: Sequence[str] = ()) -> DataFrame:
    """Strategy rows of the filtered videos, products and polarities."""
    out = strategy
    if videos is not None:
        ids = videos.select(F.col("video_id").cast("string").alias("level_id")).distinct().withColumn("level_type", F.lit("video"))
        in_videos = attach(out.where("level_type = 'video'"), ids, ["level_type", "level_id"], "left_semi")
        out = out.where("level_type <> 'video'").unionByName(in_videos)
    if products:
        out = out.where((F.col("level_type") != "product_group") | F.col("level_id").isin(*products))
    if polarities:
        out = out.where(F.col("polarity_direction").isin(*polarities))
    return out


def selected_video_first(video_id: str) -> list[Column]:
    """Sort keys that bring the issues of one video to the front."""
    match = (F.lower("level_type") == "video") & (F.col("level_id") == video_id)
    return [F.when(match, 0).otherwise(1), *issue_order()]


def issue_comments(issues: DataFrame, comments: DataFrame) -> DataFrame:
    """Supporting comments of all issues at once: same level, stage, polarity and axis."""
    base = issues.select(
        "issue_key", *LEVEL, F.lower("journey_stage").alias("__stage"), "polarity_direction",
        F.coalesce(F.try_element_at("judgment_axes", F.lit(1)), F.lit("")).alias("__axis"),
    )
    rows = comments.select(
        "comment_id", "video_id", "product", F.lower("journey_stage").alias("__stage"),
        F.explode(_direction_keys(comments, exclusive=True)).alias("polarity_direction"), "judgment_axes",
    )
    rows = rows.select("*", F.explode(F.array_distinct("judgment_axes")).alias("__axis"))
    per_level = _levels(rows, "comment_id", "__stage", "polarity_direction", "__axis")
    return attach(per_level, base, [*LEVEL, "__stage", "polarity_direction", "__axis"], "inner", derived=True).select("issue_key", "comment_id")


def primary_issue(issues: DataFrame, comments: DataFrame) -> DataFrame:
    """The best issue with a supporting comment; else the best one, marked as insufficient."""
    support = issue_comments(issues, comments).groupBy("issue_key").agg(F.count("*").alias("supporting_comments"))
    counted = issues.join(support, "issue_key", "left").withColumn("supporting_comments", F.coalesce("supporting_comments", F.lit(0)))
    backed = (F.col("supporting_comments") > 0) & (F.col("supporting_cluster_count") > 0)
    first = counted.orderBy(F.when(backed, 0).otherwise(1), *issue_order()).limit(1)
    downgraded = F.when(~backed & (F.col("priority_level") == "High"), "Medium").otherwise(F.col("priority_level"))
    return first.withColumns({"insufficient_evidence": F.col("insufficient_evidence") | ~backed, "priority_level": downgraded})
