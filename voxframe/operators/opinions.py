"""Opinion units, their scores, and the bundles that stand for a group of opinions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxframe.functions.markers import best_label, contains_any, first_match, hit_count, hits
from voxframe.functions.scores import clamp, log_likes
from voxframe.functions.text import text_digest, redact_pii, safe_text
from voxframe.operators.labels import CommentRules, classify_comments
from voxframe.operators.relational import top_per_group, unnest
from voxframe.rules import opinions as marks
from voxframe.schemas import pick


@dataclass(frozen=True)
class OpinionRules:
    contrast: str = marks.CONTRAST
    scenes: Mapping[str, Sequence[str]] = field(default_factory=lambda: dict(marks.SCENE_RULES))
    aspects: Mapping[str, Sequence[str]] = field(default_factory=lambda: dict(marks.ASPECT_RULES))
    inquiries: Mapping[str, Sequence[str]] = field(default_factory=lambda: dict(marks.INQUIRY_PATTERNS))
    categories: Mapping[str, str] = field(default_factory=lambda: dict(marks.PRODUCT_MAP))
    subtypes: Mapping[str, Mapping[str, Sequence[str]]] = field(default_factory=lambda: dict(marks.SUBTYPE_RULES))
    intense: Sequence[str] = marks.INTENSE_WORDS
    comments: CommentRules = field(default_factory=CommentRules)


DEFAULT = OpinionRules()
GROUP = ("sentiment_code", "product_category", "product_subtype", "brand_mentioned", "cej_scene_code", "aspect_key")


def _trim_marks(c: Column) -> Column:
    return F.regexp_replace(c, r"^[ ,.;:\-\n\t]+|[ ,.;:\-\n\t]+$", "")


def split_opinions(text: Column, contrast: str = marks.CONTRAST, legacy_sentence_split: bool = False) -> Column:
    """Clauses of a text: cut at contrast words, then at sentence ends; distinct, in order.

    ``legacy_sentence_split`` cuts sentences only after an ideographic full stop.
    """
    ends = r"(?<=。)" if legacy_sentence_split else marks.SENTENCE_END

    def clauses_of(source: Column) -> Column:
        parts = F.filter(F.split(source, contrast), lambda p: safe_text(p) != "")
        # A text without a contrast word is one part; it alone keeps its ends.
        segments = F.when(source.rlike(contrast), F.transform(parts, _trim_marks)).otherwise(F.array(source))
        clauses = F.flatten(
            F.transform(
                segments,
                lambda s: F.transform(F.filter(F.split(s, ends), lambda p: safe_text(p) != ""), _trim_marks),
            )
        )
        kept = F.array_distinct(F.filter(F.transform(clauses, lambda p: F.trim(p)), lambda p: p != ""))
        found = F.transform(F.array(kept), lambda k: F.when(F.size(k) > 0, k).otherwise(F.array(source)))
        return F.when(source == "", F.array().cast("array<string>")).otherwise(F.element_at(found, 1))

    # Bound once: the text and its clauses would otherwise be worked out again at every mention.
    return F.element_at(F.transform(F.array(safe_text(text)), clauses_of), 1)


# The functions below take the lower-case text as ``low``; give a named column so that it is computed once.


def scene_of(low: Column, fallback: Column, scenes: Mapping[str, Sequence[str]] = DEFAULT.scenes) -> Column:
    """First scene with a marker; else the given one; else use (or other, for no text)."""
    given = safe_text(fallback)
    rest = F.when(given != "", given).when(low != "", "S7 Use").otherwise("S10 Other")
    return first_match(low, scenes, rest)


def aspect_of(low: Column, aspects: Mapping[str, Sequence[str]] = DEFAULT.aspects) -> Column:
    """The aspect with most markers."""
    return best_label({a: hit_count(low, m) for a, m in aspects.items()}, 1, F.lit("General"))


def aspect_marker(low: Column, aspect: Column, aspects: Mapping[str, Sequence[str]] = DEFAULT.aspects) -> Column:
    """First marker of the given aspect in the text."""
    marker = None
    for name, markers in aspects.items():
        first = F.try_element_at(hits(low, markers), F.lit(1))
        marker = F.when(aspect == name, first) if marker is None else marker.when(aspect == name, first)
    return F.lit("") if marker is None else F.coalesce(marker, F.lit(""))


def inquiry_types(low: Column, patterns: Mapping[str, Sequence[str]] = DEFAULT.inquiries) -> Column:
    """All inquiry types with a marker in the text."""
    return F.array_compact(F.array(*[F.when(contains_any(low, m), F.lit(k)) for k, m in patterns.items()]))


def model_tokens(text: Column) -> Column:
    """Model numbers: five or more characters with a digit."""
    found = F.regexp_extract_all(F.upper(safe_text(text)), F.lit(marks.MODEL_NUMBER), F.lit(0))
    return F.array_distinct(F.filter(found, lambda t: (F.length(t) >= 5) & t.rlike("[0-9]")))


def product_subtype(category: Column, low: Column, subtypes: Mapping = DEFAULT.subtypes) -> Column:
    """Struct of the first matching subtype of the category and the markers found."""
    options = [
        F.struct(F.lit(name).alias("name"), F.when(category == group, hits(low, markers)).alias("hits"))
        for group, rules in subtypes.items()
        for name, markers in rules.items()
    ]
    unknown = F.struct(F.lit("Unknown").alias("name"), F.array().cast("array<string>").alias("hits"))
    if not options:
        return unknown
    return F.coalesce(F.try_element_at(F.filter(F.array(*options), lambda o: F.size(o["hits"]) > 0), F.lit(1)), unknown)


def strength_score(sentiment: Column, strength: Column, low: Column, words: Sequence[str] = marks.INTENSE_WORDS) -> Column:
    polar = sentiment.isin("positive", "negative")
    base = F.when(polar & (strength == "strong"), 8.0).when(polar, 5.0).otherwise(0.0)
    return clamp(base + hit_count(low, words) * 2.0, 0, 10)


def richness_score(low: Column) -> Column:
    """Length band plus points for causes, conditions, periods and comparisons."""
    size = F.length(low)
    band = F.when(size < 20, 0).when(size < 60, 1).when(size < 140, 2).otherwise(3)
    points = (
        hit_count(low, marks.CAUSE_WORDS) * 2
        + hit_count(low, marks.CONDITION_WORDS) * 2
        + hit_count(low, marks.PERIOD_WORDS) * 2
        + hit_count(low, marks.CONTRAST_WORDS)
    )
    return clamp(band + points, 0, 10)


def opinion_score(sentiment: Column, strength: Column, low: Column, likes: Column, spam: Column) -> Column:
    """5·strength + 2·richness + 1.5·likes − 7 for spam; zero for opinions without a pole."""
    total = (
        strength_score(sentiment, strength, low) * 5.0
        + richness_score(low) * 2.0
        + log_likes(likes) * 1.5
        - F.when(F.coalesce(spam, F.lit(False)), 7.0).otherwise(0.0)
    )
    return F.when(sentiment.isin("positive", "negative"), total).otherwise(F.lit(0.0))


def opinion_units(df: DataFrame, rules: OpinionRules = DEFAULT, legacy_sentence_split: bool = False) -> DataFrame:
    """One row per clause. Comments with several clauses get fresh labels per clause; no shuffle."""
    blank = F.lit("")

    def text_of(*names: str) -> Column:
        return safe_text(pick(df, names, blank))

    def or_word(value: Column, word: str) -> Column:
        return F.when(value != "", value).otherwise(word)

    source = df.select(
        text_of("comment_id").alias("source_content_id"),
        split_opinions(pick(df, ["text_display", "cleaned_text"], blank), rules.contrast, legacy_sentence_split).alias("__clauses"),
        or_word(text_of("comment_validity"), "valid").alias("comment_validity"),
        text_of("exclusion_reason").alias("exclusion_reason"),
        text_of("parent_comment_text").alias("parent_comment_text"),
        text_of("title").alias("title"),
        text_of("product").alias("product"),
        text_of("channel_title").alias("channel_title"),
        pick(df, ["is_reply"], F.lit(False)).alias("is_reply"),
        text_of("topic_label").alias("row_scene"),
        or_word(F.lower(text_of("sentiment_label")), "neutral").alias("row_sentiment"),
        or_word(text_of("signal_strength"), "weak").alias("row_strength"),
        or_word(text_of("classification_type"), "informational").alias("row_class"),
        or_word(text_of("confidence_level"), "low").alias("row_conf"),
        text_of("classification_reason").alias("row_reason"),
        pick(df, ["product_related"], F.lit(False)).alias("row_related"),
        pick(df, ["spam_like"], F.lit(False)).alias("duplicate_opinion_flag"),
        text_of("model_mentioned").alias("row_model"),
        text_of("product_subtype").alias("row_subtype"),
        text_of("brand_label").alias("brand_mentioned"),
        pick(df, ["like_count"]).try_cast("double").alias("likes_count"),
        text_of("video_url").alias("source_link"),
        text_of("region").alias("region"),
        F.when(F.upper(text_of("pii_flag")) == "Y", "Y").otherwise("N").alias("pii_flag"),
        text_of("pii_types").alias("pii_types"),
        text_of("pii_raw_text").alias("pii_raw_text"),
        text_of("translated_text").alias("translated_text"),
        text_of("summary", "short_summary_ko").alias("summary_text"),
    )
    units = unnest(source, F.col("__clauses"), "opinion_text", "*", position="position")
    units = units.withColumn("opinion_count", F.size("__clauses")).drop("__clauses")
    # The only clause of a comment keeps the comment's labels, so there is nothing to read in it.
    several = F.col("opinion_count") > 1
    units = units.withColumns({f"__{n}": F.when(several, F.col(n)).otherwise(blank) for n in ("opinion_text", "parent_comment_text")})
    return _finish_units(classify_comments(units, "__opinion_text", "__parent_comment_text", rules.comments), rules)


def _finish_units(labelled: DataFrame, rules: OpinionRules) -> DataFrame:
    c = F.col
    single, valid = c("opinion_count") == 1, c("comment_validity") == "valid"

    def choose(own: str, fresh: str, excluded: str | None) -> Column:
        value = F.when(single, c(own)).otherwise(c(fresh))
        return value if excluded is None else F.when(valid, value).otherwise(excluded)

    out = labelled.withColumns(
        {
            "sentiment_code": choose("row_sentiment", "sentiment_label", "excluded"),
            "signal_strength": choose("row_strength", "signal_strength", "weak"),
            "classification_type": choose("row_class", "classification_type", "informational"),
            "confidence_level": choose("row_conf", "confidence_level", "low"),
            "classification_reason": choose("row_reason", "classification_reason", None),
            "product_related": choose("row_related", "product_related", None),
            "__low": F.lower("opinion_text"),
            "__blob": F.concat_ws(" ", "opinion_text", "product", "title"),
        }
    )
    low = c("__low")
    out = out.withColumns(
        {"aspect_key": aspect_of(low, rules.aspects), "inquiry_types": inquiry_types(low, rules.inquiries), "__low_blob": F.lower("__blob")}
    )
    categories = F.create_map(*[F.lit(x) for pair in rules.categories.items() for x in pair])
    raw = F.when(c("product") != "", c("product")).otherwise("Other")
    out = out.withColumn("product_category", F.coalesce(F.element_at(categories, c("product")), raw))
    out = out.withColumns(
        {
            "__sub": product_subtype(c("product_category"), c("__low_blob"), rules.subtypes),
            "__models": model_tokens(c("__blob")),
            "__marker": aspect_marker(low, c("aspect_key"), rules.aspects),
            "__masked": F.when(c("pii_flag") == "Y", redact_pii(c("opinion_text"), c("pii_raw_text"))),
        }
    )
    low_blob = c("__low_blob")
    evidence = F.concat(F.array("product", "title"), c("__sub.hits"), F.slice("__models", 1, 1))
    marker = c("__marker")
    span = F.when(marker != "", c("opinion_text").substr(F.instr(low, marker), F.length(marker)))
    return out.select(
        F.concat("source_content_id", F.lit("::u"), (c("position") + 1).cast("string")).alias("opinion_id"),
        "source_content_id",
        F.lit("YT_COMMENT").alias("source_type"),
        F.lit(1).alias("source_count"),
        "opinion_count",
        "duplicate_opinion_flag",
        "product_related",
        "opinion_text",
        scene_of(low, c("row_scene"), rules.scenes).alias("cej_scene_code"),
        "sentiment_code",
        F.initcap("sentiment_code").alias("sentiment"),
        "signal_strength",
        "classification_type",
        "confidence_level",
        "aspect_key",
        F.array_distinct(F.array_compact(F.array(c("opinion_text"), span))).alias("evidence_spans"),
        (F.size("inquiry_types") > 0).alias("inquiry_flag"),
        F.when(F.size("inquiry_types") > 0, c("inquiry_types"))
        .when(c("opinion_text").contains("?"), F.array(F.lit("OTHER")))
        .otherwise(F.array().cast("array<string>"))
        .alias("inquiry_types"),
        "product_category",
        F.when(c("row_subtype") != "", c("row_subtype")).otherwise(c("__sub.name")).alias("product_subtype"),
        "brand_mentioned",
        F.when(c("row_model") != "", c("row_model")).otherwise(F.coalesce(F.try_element_at("__models", F.lit(1)), F.lit(""))).alias("model_mentioned"),
        F.array_distinct(F.filter(evidence, lambda t: (t != "") & low_blob.contains(F.lower(t)))).alias("product_evidence_spans"),
        "likes_count",
        "source_link",
        "region",
        "product",
        "title",
        "pii_flag",
        "pii_types",
        "pii_raw_text",
        F.coalesce("__masked", "opinion_text").alias("display_text"),
        c("opinion_text").alias("original_text"),
        F.coalesce("__masked", F.lit("")).alias("masked_text"),
        "translated_text",
        "summary_text",
        "classification_reason",
        opinion_score(c("sentiment_code"), c("signal_strength"), low, c("likes_count"), c("duplicate_opinion_flag")).alias("opinion_score"),
    )


def opinion_counts(df: DataFrame, units: DataFrame) -> DataFrame:
    """Number of opinions per comment; a comment without units counts as one."""
    counts = units.groupBy(F.col("source_content_id").alias("comment_id")).agg(F.count("*").alias("__n"))
    joined = df.drop("opinion_count").join(counts, "comment_id", "left")
    return joined.withColumn("opinion_count", F.coalesce("__n", F.lit(1)).cast("int")).withColumn("source_count", F.lit(1)).drop("__n")


def bundle_candidates(units: DataFrame) -> DataFrame:
    """Positive or negative product opinions that are neither repeats nor plain inquiries."""
    c = F.col
    plain_inquiry = c("inquiry_flag") & (F.lower("classification_type") == "informational")
    return units.where(
        c("sentiment_code").isin("positive", "negative")
        & ~c("duplicate_opinion_flag")
        & ~plain_inquiry
        & F.coalesce(c("product_related"), F.lit(False))
    )


def representative_bundles(units: DataFrame, top_n: int = 5, samples: int = 5) -> DataFrame:
    """Best opinion groups per polarity with their size, score and top samples.

    Groups are counted with partial aggregation; only ``samples`` rows of each group are ever gathered.
    Units are read several times: pass a held table (``session.materialize``), not the plan that makes them.
    """
    c = F.col
    order = [c("opinion_score").desc(), c("likes_count").desc_nulls_last(), c("opinion_id")]
    keyed = bundle_candidates(units).withColumn("__text", text_digest(c("opinion_text")))
    distinct = top_per_group(
        keyed, ["sentiment_code", "product_category", "brand_mentioned", "cej_scene_code", "aspect_key", "__text"], order, 1
    )
    sizes = distinct.groupBy(*GROUP).agg(
        F.count("*").alias("cluster_size"), F.sum(F.coalesce("likes_count", F.lit(0.0))).alias("__likes")
    )
    ranked = top_per_group(distinct, GROUP, order, samples, "__rank")
    sample = F.struct(c("__rank").alias("rank"), "opinion_id", "display_text", "translated_text", "pii_flag",
                      c("likes_count").cast("bigint").alias("likes_count"))
    tops = ranked.groupBy(*GROUP).agg(
        F.array_sort(F.collect_list(sample)).alias("sample_comments"),
        F.min_by(F.struct(*[n for n in units.columns if n not in GROUP]), "__rank").alias("__top"),
    )
    joined = tops.join(sizes, list(GROUP))
    score = c("__top.opinion_score") + clamp(F.log10(c("cluster_size") + 1) * 5, 0, 10) + clamp(F.log10(c("__likes") + 1) * 4, 0, 10) * 0.5
    reason = F.when(c("__top.classification_reason") != "", c("__top.classification_reason")).otherwise(marks.DEFAULT_INSIGHT)
    voc = F.array(
        F.struct(
            c("aspect_key").alias("topic"),
            c("__top.sentiment").alias("sentiment"),
            reason.alias("insight_message"),
            F.coalesce(F.try_element_at("__top.evidence_spans", F.lit(1)), c("__top.opinion_text")).alias("evidence_span"),
        )
    )
    bundles = joined.select(
        *GROUP,
        c("__top.sentiment").alias("sentiment"),
        "cluster_size",
        c("__top.model_mentioned").alias("model_mentioned"),
        score.alias("bundle_score"),
        c("__top.opinion_id").alias("top_opinion_id"),
        c("__top.source_content_id").alias("top_source_content_id"),
        c("__top.source_link").alias("top_source_link"),
        c("__top.likes_count").cast("bigint").alias("top_likes_count"),
        c("__top.pii_flag").alias("top_pii_flag"),
        c("__top.pii_types").alias("top_pii_types"),
        c("__top.display_text").alias("top_display_text"),
        c("__top.original_text").alias("top_original_text"),
        c("__top.masked_text").alias("top_masked_text"),
        c("__top.translated_text").alias("top_translation_text"),
        c("__top.summary_text").alias("top_summary_text"),
        c("__top.pii_raw_text").alias("pii_raw_text"),
        F.concat(
            F.lit("strength="), F.round(strength_score(c("sentiment_code"), c("__top.signal_strength"), F.lower("__top.opinion_text")), 0).cast("int").cast("string"),
            F.lit("/10, richness="), F.round(richness_score(F.lower("__top.opinion_text")), 0).cast("int").cast("string"),
            F.lit("/10, cluster="), c("cluster_size").cast("string"),
        ).alias("selection_reason"),
        "sample_comments",
        voc.alias("voc_items"),
        c("__top.region").alias("region"),
        c("__top.product").alias("product"),
        text_digest(c("__top.display_text")).alias("__text"),
    )
    best = [c("bundle_score").desc(), c("cluster_size").desc(), c("top_opinion_id")]
    once = top_per_group(bundles, ["sentiment_code", "product_category", "brand_mentioned", "aspect_key", "__text"], best, 1)
    return top_per_group(once, ["sentiment_code"], best, top_n, "rank").drop("__text")


def source_records(units: DataFrame) -> DataFrame:
    """One nested record per comment. A comment holds only the clauses of its own text."""
    unit = F.struct(
        F.regexp_extract("opinion_id", r"::u(\d+)$", 1).cast("int").alias("position"),
        "opinion_id",
        "opinion_text",
        "cej_scene_code",
        "sentiment",
        "inquiry_flag",
        "inquiry_types",
        "aspect_key",
        "evidence_spans",
        F.struct("product_category", "product_subtype", "brand_mentioned", "model_mentioned", "product_evidence_spans").alias("product"),
    )
    first = ["source_type", "pii_flag", "pii_types", "pii_raw_text", "duplicate_opinion_flag"]
    grouped = units.groupBy("source_content_id").agg(
        *[F.min_by(n, "opinion_id").alias(n) for n in first],
        F.array_sort(F.collect_list(unit)).alias("opinion_units"),
        F.count("*").alias("opinion_count"),
    )
    return grouped.withColumn("source_count", F.lit(1))


def representative_section(bundles: DataFrame) -> DataFrame:
    """Bundles of each polarity as one ordered nested array (at most the top-n rows of each)."""
    item = F.struct(
        "rank",
        F.upper("sentiment_code").alias("sentiment"),
        "aspect_key",
        "cluster_size",
        "cej_scene_code",
        F.struct("product_category", "product_subtype", "brand_mentioned", "model_mentioned").alias("product"),
        F.struct(
            F.col("top_source_content_id").alias("source_content_id"),
            F.col("top_source_link").alias("source_link"),
            F.col("top_likes_count").alias("likes_count"),
            F.col("top_pii_flag").alias("pii_flag"),
            F.col("top_pii_types").alias("pii_types"),
            F.col("top_display_text").alias("display_text"),
            F.col("top_original_text").alias("original_text"),
            F.col("top_masked_text").alias("masked_text"),
            F.col("top_translation_text").alias("translated_text"),
        ).alias("top_comment"),
        "selection_reason",
        "pii_raw_text",
        "sample_comments",
    )
    section = F.when(F.col("sentiment_code") == "positive", "positive_top5_bundles").otherwise("negative_top5_bundles")
    return bundles.groupBy(section.alias("section")).agg(F.array_sort(F.collect_list(item)).alias("bundles"))
