"""Canonical truth per comment: polarity, hygiene, inquiry, journey stage and judgment axes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxframe.functions.markers import contains_any, hit_count, matches_any, top_labels
from voxframe.functions.parsing import coerce_bool, parse_list
from voxframe.functions.text import strip
from voxframe.rules import messages
from voxframe.rules import truth as taxonomy
from voxframe.schemas import COMMENT_TRUTH, ENRICHMENT, pick, with_missing


@dataclass(frozen=True)
class TruthRules:
    stages: Sequence[str] = taxonomy.JOURNEY_STAGES
    axes: Sequence[str] = taxonomy.JUDGMENT_AXES
    stage_aliases: Mapping[str, str] = field(default_factory=lambda: dict(taxonomy.JOURNEY_ALIASES))
    stage_markers: Mapping[str, Sequence[str]] = field(default_factory=lambda: dict(taxonomy.JOURNEY_MARKERS))
    axis_markers: Mapping[str, Sequence[str]] = field(default_factory=lambda: dict(taxonomy.AXIS_MARKERS))
    brand_names: Sequence[str] = taxonomy.BRAND_ENTITY_MARKERS
    trust_cues: Sequence[str] = taxonomy.BRAND_TRUST_CUES
    topic_axes: Mapping[str, str] = field(default_factory=lambda: dict(taxonomy.TOPIC_TO_AXIS))
    class_axes: Mapping[str, str] = field(default_factory=lambda: dict(taxonomy.CLASSIFICATION_TO_AXIS))
    trash_qualities: Sequence[str] = taxonomy.TRASH_QUALITY_SET
    service_words: Sequence[str] = ("a/s", "repair", "서비스", "수리")
    inquiry_noise: Sequence[str] = taxonomy.INQUIRY_NOISE_PATTERNS
    inquiry_markers: Sequence[str] = taxonomy.REAL_INQUIRY_MARKERS
    usage_markers: Sequence[str] = taxonomy.REAL_DECISION_USAGE_MARKERS
    narratives: Sequence[str] = taxonomy.NON_INQUIRY_NARRATIVE_PATTERNS
    non_customer: Sequence[str] = taxonomy.NON_CUSTOMER_VOICE_PATTERNS
    #: Characters up to which a text without usage words, and one without a question mark, may count as an inquiry.
    longest_statement: int = 140
    longest_question: int = 520


DEFAULT = TruthRules()
POLARITIES = ("positive", "negative", "neutral", "mixed", "trash")


def _low(c: Column) -> Column:
    return F.lower(strip(F.coalesce(c.cast("string"), F.lit(""))))


def final_sentiment(base: Column, label: Column, topic_sentiments: Column) -> Column:
    """Struct of the final polarity and the mixed flag.

    The external label wins over the rule label; opposite labels or topics make the row mixed.
    """
    base, label = _low(base), _low(label)
    topics = F.transform(F.coalesce(F.map_values(topic_sentiments), F.array().cast("array<string>")), F.lower)
    split = F.array_contains(topics, "positive") & F.array_contains(topics, "negative")
    poles = ("positive", "negative")
    conflict = base.isin(*poles) & label.isin(*poles) & (base != label)
    resolved = (
        F.when(label.isin(*POLARITIES), label)
        .when(label == "undecidable", "neutral")
        .when(base.isin(*POLARITIES), base)
        .otherwise("neutral")
    )
    mixed = F.coalesce((resolved == "mixed") | split | conflict, F.lit(False))
    return F.struct(
        F.when(mixed & (resolved != "trash"), "mixed").otherwise(resolved).alias("sentiment"), mixed.alias("mixed")
    )


def hygiene_class(validity: Column, quality: Column, label: Column, classification: Column, inquiry: Column,
                  trash_qualities: Sequence[str] = taxonomy.TRASH_QUALITY_SET) -> Column:
    return (
        F.when(_low(validity) != "valid", "trash")
        .when(_low(quality).isin(*trash_qualities), "trash")
        .when(_low(label) == "trash", "trash")
        .when(inquiry, "supporting")
        .when(_low(classification) == "informational", "supporting")
        .otherwise("strategic")
    )


def is_real_inquiry(value: Column, low: Column, rules: TruthRules = DEFAULT) -> Column:
    """A question with intent: no advertising, no story without a question mark, not overly long.

    Takes the stripped text and its lower-case form, best as named columns.
    """
    asked = value.contains("?")
    marked = contains_any(low, rules.inquiry_markers)
    story = matches_any(low, rules.narratives) & ~asked
    rambling = ~contains_any(low, rules.usage_markers) & (F.length(value) > rules.longest_statement)
    endless = (F.length(value) > rules.longest_question) & ~asked
    return (asked | marked) & ~matches_any(low, rules.inquiry_noise) & ~story & ~rambling & ~endless


def is_non_customer_voice(text: Column, rules: TruthRules = DEFAULT) -> Column:
    return matches_any(_low(text), rules.non_customer)


def stage_alias(value: Column, rules: TruthRules = DEFAULT) -> Column:
    """Canonical stage of a given label, or null."""
    table = F.create_map(*[F.lit(x) for pair in rules.stage_aliases.items() for x in pair])
    return F.element_at(table, _low(value))


def _items(c: Column) -> Column:
    return F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.lower(strip(F.coalesce(x, F.lit("")))))


def semantic_text(df: DataFrame, rules: TruthRules = DEFAULT) -> Column:
    """Texts and external tags of a row in one lower-case string; product mentions without bare brand names."""
    def absent_blank(name: str) -> Column:
        value = _low(pick(df, [name], F.lit("")))
        return F.when(value != "", value)

    names = F.array(*[F.lit(b) for b in rules.brand_names])
    tags = [F.array_join(_items(F.col(n)), " ") for n in ("nlp_topics", "nlp_core_points", "nlp_context_tags", "nlp_similarity_keys")]
    mentions = F.array_join(F.filter(_items(F.col("nlp_product_mentions")), lambda x: ~F.array_contains(names, x)), " ")
    parts = [F.when(t != "", t) for t in [*tags, mentions]]
    return F.concat_ws(" ", *[absent_blank(n) for n in ("text_display", "text_original", "cleaned_text")], *parts)


def _points(test: Column, value: int) -> Column:
    return F.when(test, F.lit(value)).otherwise(F.lit(0))


def stage_scores(blob: Column, classification: Column, sentiment: Column, inquiry: Column, rules: TruthRules = DEFAULT) -> dict[str, Column]:
    """Points per journey stage: markers plus what the class and the polarity suggest."""
    scores = {s: hit_count(blob, [m.lower() for m in rules.stage_markers.get(s, ())]) for s in rules.stages}
    extra = {
        "exploration": _points(classification == "comparison", 2) + _points(inquiry, 1),
        "decision": _points(classification == "preference", 2),
        "usage": _points(classification == "complaint", 1) + _points(sentiment == "mixed", 1),
        "maintenance": _points((classification == "complaint") & contains_any(blob, rules.service_words), 2),
    }
    return {s: scores[s] + extra[s] if s in extra else scores[s] for s in rules.stages}


def choose_stage(df: DataFrame, scores: Mapping[str, str], classification: Column, inquiry: Column, product_related: Column) -> Column:
    """Top-scoring stage with the tie rules; without points a product comment falls back by its class."""
    cols = {s: F.col(name) for s, name in scores.items()}
    best = F.greatest(*cols.values())
    top = {s: c == best for s, c in cols.items()}
    first = F.coalesce(*[F.when(hit, F.lit(s)) for s, hit in top.items()])
    picked = (
        F.when(top["maintenance"] & (classification == "complaint"), "maintenance")
        .when(top["usage"] & top["exploration"] & ~inquiry, "usage")
        .when(top["decision"] & top["exploration"] & (classification == "preference"), "decision")
        .otherwise(first)
    )
    fallback = F.when(
        product_related,
        F.when(classification.isin("comparison", "informational") & inquiry, "exploration")
        .when(classification == "preference", "decision")
        .otherwise("usage"),
    )
    return F.when(best > 0, picked).otherwise(fallback)


def axis_scores(blob: Column, stage: Column, classification: Column, sentiment: Column, topic: Column, inquiry: Column,
                rules: TruthRules = DEFAULT) -> dict[str, Column]:
    """Points per judgment axis: markers, topic, class, stage and the brand-trust rule."""
    scores = {a: hit_count(blob, [m.lower() for m in rules.axis_markers.get(a, ())]) for a in rules.axes}

    def add(axis: str, test: Column, value: int) -> None:
        if axis in scores:
            scores[axis] = scores[axis] + _points(test, value)

    for label, axis in rules.topic_axes.items():
        add(axis, topic == label, 1)
    for label, axis in rules.class_axes.items():
        add(axis, classification == label, 2)
    add("automation_convenience", inquiry, 1)
    add("usage_pattern_fit", sentiment == "mixed", 1)
    if "brand_trust" in scores:
        names, cues = hit_count(blob, rules.brand_names), hit_count(blob, rules.trust_cues)
        own = scores["brand_trust"]
        scores["brand_trust"] = F.when(cues == 0, F.lit(0)).otherwise(own + F.least(names, F.lit(2)))
    add("purchase_strategy_contract", stage.isin("purchase", "decision"), 1)
    add("price_value_fit", stage.isin("purchase", "decision"), 1)
    add("installation_space_fit", stage == "delivery", 1)
    add("automation_convenience", stage == "onboarding", 1)
    add("service_after_sales", stage == "maintenance", 2)
    add("maintenance_burden", stage == "maintenance", 1)
    add("durability_lifespan", stage == "replacement", 1)
    add("repurchase_recommendation", stage == "replacement", 1)
    return scores


def build_truth(df: DataFrame, rules: TruthRules = DEFAULT, keep: Sequence[str] = ()) -> DataFrame:
    """The canonical truth table: one row per comment, all by expressions, no shuffle.

    ``keep`` names further input columns to carry along.
    """
    df = with_missing(df, ENRICHMENT)
    c = F.col
    blank = F.lit("")
    cleaned = strip(pick(df, ["cleaned_text"], blank))
    display = strip(pick(df, ["text_display", "text_original"], blank))
    text = F.when(display != "", display).otherwise(cleaned)
    named = [pick(df, [n], F.lit(None)).cast("string") for n in ("journey_stage", "customer_journey_stage", "cej_scene_code")]
    sources = {n: strip(pick(df, [n], blank)) for n in ("text_display", "text_original", "cleaned_text") if n in df.columns}
    df = df.withColumns({f"__v_{n}": v for n, v in sources.items()})
    df = df.withColumns({f"__l_{n}": F.lower(f"__v_{n}") for n in sources})
    asked = coerce_bool(c("nlp_is_inquiry"))
    for n in sources:
        asked = asked | is_real_inquiry(c(f"__v_{n}"), c(f"__l_{n}"), rules)
    base = df.select(
        c("comment_id"),
        pick(df, ["video_id"]).cast("string").alias("video_id"),
        text.alias("text"),
        *[c(k) for k in keep],
        final_sentiment(pick(df, ["sentiment_label"], blank), c("nlp_label"), c("nlp_topic_sentiments")).alias("__s"),
        asked.alias("inquiry_flag"),
        _low(pick(df, ["comment_validity"], blank)).alias("__valid"),
        _low(pick(df, ["comment_quality"], blank)).alias("__quality"),
        _low(c("nlp_label")).alias("__label"),
        _low(pick(df, ["classification_type"], blank)).alias("__class"),
        _low(pick(df, ["topic_label"], blank)).alias("__topic"),
        coerce_bool(pick(df, ["product_related"], F.lit(False))).alias("__related"),
        F.coalesce(*[stage_alias(n, rules) for n in named]).alias("__named"),
        semantic_text(df, rules).alias("__blob"),
    )
    base = base.withColumns(
        {
            "sentiment_final": c("__s.sentiment"),
            "mixed_flag": c("__s.mixed"),
            "hygiene_class": hygiene_class(c("__valid"), c("__quality"), c("__label"), c("__class"), c("inquiry_flag"), rules.trash_qualities),
        }
    )
    base = base.withColumn("analysis_included", (c("__valid") == "valid") & (c("text") != "") & (c("hygiene_class") != "trash"))
    base = base.withColumn("__strategic", c("analysis_included") & (c("hygiene_class") == "strategic"))
    scores = stage_scores(c("__blob"), c("__class"), c("sentiment_final"), c("inquiry_flag"), rules)
    base = base.withColumns({f"__stage_{s}": v for s, v in scores.items()})
    chosen = choose_stage(base, {s: f"__stage_{s}" for s in rules.stages}, c("__class"), c("inquiry_flag"), c("__related"))
    base = base.withColumn("journey_stage", F.when(c("__strategic"), F.coalesce(c("__named"), chosen)))
    stage = F.coalesce(c("journey_stage"), blank)
    ranked = top_labels(axis_scores(c("__blob"), stage, c("__class"), c("sentiment_final"), c("__topic"), c("inquiry_flag"), rules), 3)
    base = base.withColumn("__axes", F.when(c("__strategic"), ranked))
    fallback = (
        F.when(stage == "maintenance", "service_after_sales")
        .when(stage == "delivery", "installation_space_fit")
        .when(stage.isin("purchase", "decision", "exploration"), "price_value_fit")
        .otherwise("automation_convenience")
    )
    axes = (
        F.when(~c("__strategic"), F.array().cast("array<string>"))
        .when((F.size("__axes") == 0) & c("__related"), F.array(fallback))
        .otherwise(c("__axes"))
    )
    out = base.withColumns(
        {
            "judgment_axes": axes,
            "text_display": c("text"),
            "representative_eligibility": c("__strategic") & c("journey_stage").isNotNull() & ~is_non_customer_voice(c("text"), rules),
        }
    )
    return out.select(*[f.name for f in COMMENT_TRUTH.fields], *keep)


def merge_truth(df: DataFrame, truth: DataFrame) -> DataFrame:
    """Replace the truth columns of ``df`` by those of the truth table."""
    names = [f.name for f in COMMENT_TRUTH.fields if f.name not in ("comment_id", "video_id")]
    return df.drop(*names).join(truth.select("comment_id", *names), "comment_id", "left")


def primary_axis(axes: Column, topic: Column, default: str = "general") -> Column:
    first = F.try_element_at(axes, F.lit(1))
    return F.coalesce(first, F.when(strip(topic) != "", strip(topic)), F.lit(default))


def taxonomy_topic(axes: Column, topic: Column) -> Column:
    """Readable topic from the first axis."""
    axis = primary_axis(axes, topic)
    return F.when(axis.contains("_"), F.initcap(F.replace(axis, F.lit("_"), F.lit(" ")))).otherwise(axis)


def normalize_taxonomy(df: DataFrame, rules: TruthRules = DEFAULT) -> DataFrame:
    """Final polarity as label, canonical stage, and topic label from the axes."""
    low = F.lower(strip(F.coalesce(F.col("journey_stage"), F.lit(""))))
    alias = F.coalesce(stage_alias(low, rules), low)
    stage = F.when(alias.isin(*rules.stages), alias).otherwise("")
    return df.withColumns(
        {
            "sentiment_label": F.coalesce(F.col("sentiment_final"), F.col("sentiment_label")),
            "journey_stage": stage,
            "topic_label": taxonomy_topic(F.col("judgment_axes"), pick(df, ["topic_label"], F.lit(""))),
        }
    )


def parse_axes(value: Column) -> Column:
    return parse_list(value, r"[\|,;/]+")


def backfill_taxonomy(frame: DataFrame, source: DataFrame) -> DataFrame:
    """Take stage, axes and topic from ``source``; keep the old topic where it has none."""
    new = source.select("comment_id", "journey_stage", "judgment_axes", F.col("topic_label").alias("__topic")).dropDuplicates(["comment_id"])
    joined = frame.drop("journey_stage", "judgment_axes").join(new, "comment_id", "left")
    old = pick(frame, ["topic_label"]).cast("string")
    return joined.withColumn("topic_label", F.coalesce(F.col("__topic"), old)).drop("__topic")


def hygiene_subsets(df: DataFrame) -> dict[str, DataFrame]:
    """Nested subsets of labelled comments: included, not trash, strategic."""
    low = F.lower(F.coalesce(F.col("hygiene_class"), F.lit("trash")))
    included = df.where(F.coalesce(F.col("analysis_included"), F.lit(False)))
    non_trash = included.where(low != "trash")
    return {
        "analysis_comments": included,
        "analysis_non_trash": non_trash,
        "analysis_strategic": non_trash.where(low == "strategic"),
    }


def representative_scorecard(df: DataFrame) -> DataFrame:
    """Six scores from 1 to 5, their total, the decision and its reason."""
    c = F.col
    blank = F.lit("")
    shown = pick(df, ["text_display"], blank)
    text = F.when(strip(shown) != "", shown).otherwise(pick(df, ["cleaned_text"], blank))
    size = F.length(strip(text))
    related = F.coalesce(c("product_related"), F.lit(False))
    polar = F.coalesce(c("sentiment_label").isin("positive", "negative"), F.lit(False))
    kind = F.coalesce(c("classification_type"), F.lit("informational"))
    confidence = F.coalesce(c("confidence_level"), F.lit("low"))
    context = F.coalesce(c("context_required_for_display"), F.lit(False))
    review = F.coalesce(c("needs_review"), F.lit(False))
    target = F.coalesce(c("product_target"), blank) != ""
    out = df.withColumns(
        {
            "clarity_score": F.when(size.between(25, 220), 5).when(size.between(12, 280), 4).otherwise(2),
            "product_specificity_score": F.when(target, 5).when(related, 4).otherwise(2),
            "insight_value_score": F.when(polar & (kind == "complaint"), 5)
            .when(kind.isin("comparison", "preference") | related, 3)
            .otherwise(1),
            "representativeness_score": F.when((confidence == "high") & ~review, 5).when(confidence == "medium", 4).otherwise(2),
            "explainability_score": F.when(~context & (confidence == "high"), 5).when(~context, 4).otherwise(2),
            "context_independence_score": F.when(~context, 5).otherwise(2),
        }
    )
    parts = ["clarity", "product_specificity", "insight_value", "representativeness", "explainability", "context_independence"]
    out = out.withColumn("representative_score", sum((c(f"{p}_score") for p in parts[1:]), c("clarity_score")))
    total = c("representative_score")
    decision = (
        F.when(polar & (total >= 24) & ~context & (kind != "informational"), "strong_candidate")
        .when((total >= 18) & related, "review_needed")
        .otherwise("not_suitable")
    )
    out = out.withColumn("representative_decision", decision)
    reasons = F.create_map(*[F.lit(x) for pair in messages.REPRESENTATIVE_REASONS.items() for x in pair])
    return out.withColumn("representative_reason", F.element_at(reasons, c("representative_decision")))
