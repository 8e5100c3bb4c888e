"""From comments to signal units: context, product identity, splits and labels per signal."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxframe.functions.markers import best_scored, bounded_count, bounded_hits, bounded_weight, contains_any, matches_any
from voxframe.functions.parsing import coerce_bool, normalize_axes
from voxframe.functions.scores import parse_time
from voxframe.functions.text import collapse_space, infer_language
from voxframe.operators.relational import attach, unnest
from voxframe.rules import signals as marks
from voxframe.rules import truth as taxonomy
from voxframe.schemas import pick, require_columns

CONTRACT_VERSION = "v5.2.0"
COMPARISON_AXIS = "comparison_substitute_judgment"
FALLBACK_AXIS = "usage_pattern_fit"
SINGLE = "fallback_single"


@dataclass(frozen=True)
class SignalRules:
    connectors: Sequence[tuple[str, Sequence[str]]] = marks.CONNECTORS
    brands: Sequence[str] = marks.BRAND_TOKENS
    products: Sequence[str] = marks.PRODUCT_TOKENS
    positive: Sequence[str] = marks.POSITIVE_TOKENS
    negative: Sequence[str] = marks.NEGATIVE_TOKENS
    stages: Mapping[str, Sequence[str]] = field(default_factory=lambda: dict(marks.SIGNAL_JOURNEY_MARKERS))
    axes: Mapping[str, Sequence[tuple[str, float]]] = field(default_factory=lambda: dict(marks.SIGNAL_AXIS_MARKERS))
    valid_axes: Sequence[str] = taxonomy.JUDGMENT_AXES
    comparison: str = marks.COMPARISON
    generic: Sequence[str] = marks.GENERIC_SIGNALS
    named: Sequence[tuple[str, Sequence[str]]] = marks.NAMED_PRODUCT_ALIASES
    lines: Sequence[tuple[str, Sequence[str]]] = marks.PRODUCT_LINE_ALIASES
    categories: Sequence[tuple[str, Sequence[str]]] = marks.PRODUCT_CATEGORY_ALIASES
    named_category: Mapping[str, str] = field(default_factory=lambda: dict(marks.NAMED_TO_CATEGORY))
    excluded: Mapping[str, Sequence[str]] = field(default_factory=lambda: dict(marks.EXCLUDED_CATEGORY))


DEFAULT = SignalRules()


def comment_context(comments: DataFrame, truth: DataFrame | None = None, videos: DataFrame | None = None, run_id: str = "") -> DataFrame:
    """Included comments with text, language, time and the seeds of the topic plan.

    Truth columns replace the comment's own; video columns fill what the comment lacks.
    """
    require_columns(comments, ["comment_id", "video_id"], "comment_context")
    hygiene = F.lower(F.coalesce(pick(comments, ["hygiene_class"], F.lit("strategic")), F.lit("strategic")))
    base = comments.where(coerce_bool(pick(comments, ["analysis_included"], F.lit(True)), True) & (hygiene != "trash"))
    if truth is not None:
        names = [n for n in ("sentiment_final", "mixed_flag", "journey_stage", "judgment_axes", "analysis_included", "hygiene_class") if n in truth.columns]
        base = base.drop(*names).join(truth.select("comment_id", *names), "comment_id", "left")
    if videos is not None:
        names = [n for n in ("title", "product", "brand", "region", "published_at") if n in videos.columns and n not in base.columns]
        base = attach(base, videos.dropDuplicates(["video_id"]).select("video_id", *names), ["video_id"])
    blank = F.lit("")
    text = F.coalesce(pick(base, ["text_display", "cleaned_text", "text"]).cast("string"), blank)
    axes = F.coalesce(pick(base, ["judgment_axes"]).cast("array<string>"), F.array().cast("array<string>"))
    stamps = [parse_time(F.col(n)) for n in ("published_at", "comment_published_at", "timestamp") if n in base.columns]
    when = F.coalesce(*stamps) if stamps else F.lit(None).cast("timestamp")

    def number(name: str) -> Column:
        return F.coalesce(pick(base, [name]).try_cast("bigint"), F.lit(0))

    return base.select(
        F.lit(CONTRACT_VERSION).alias("contract_version"),
        F.col("comment_id").cast("string").alias("comment_id"),
        F.col("video_id").cast("string").alias("video_id"),
        text.alias("raw_text"),
        infer_language(text, pick(base, ["language", "nlp_language"]).cast("string")).alias("language"),
        F.coalesce(F.date_format(when, "yyyy-MM-dd'T'HH:mm:ss"), blank).alias("timestamp"),
        F.coalesce(pick(base, ["sentiment_final", "sentiment_label"]).cast("string"), blank).alias("sentiment_seed"),
        coerce_bool(pick(base, ["mixed_flag"], F.lit(False))).alias("mixed_flag"),
        F.coalesce(pick(base, ["journey_stage"]).cast("string"), blank).alias("journey_stage_seed"),
        normalize_axes(axes, taxonomy.JUDGMENT_AXES).alias("judgment_axes_seed"),
        F.coalesce(pick(base, ["product"]).cast("string"), blank).alias("product_raw"),
        F.coalesce(pick(base, ["brand", "brand_mentioned"]).cast("string"), blank).alias("brand_raw"),
        F.coalesce(pick(base, ["region"]).cast("string"), blank).alias("region"),
        number("like_count").alias("like_count"),
        number("reply_count").alias("reply_count"),
        F.lower(F.coalesce(pick(base, ["hygiene_class"], F.lit("strategic")), F.lit("strategic"))).alias("hygiene_class"),
        coerce_bool(pick(base, ["analysis_included"], F.lit(True)), True).alias("analysis_included"),
        F.lit(run_id).alias("run_id"),
    )


def _alias_hits(text: Column, specs: Sequence[tuple[str, Sequence[str]]]) -> Column:
    """Struct of the first product with an alias in the text and its aliases found, longest first."""
    found = [
        F.struct(F.lit(name).alias("name"), bounded_hits(text, sorted(aliases, key=len, reverse=True)).alias("hits"))
        for name, aliases in specs
    ]
    if not found:
        return F.lit(None).cast("struct<name:string,hits:array<string>>")
    return F.try_element_at(F.filter(F.array(*found), lambda s: F.size(s["hits"]) > 0), F.lit(1))


def normalize_products(context: DataFrame, rules: SignalRules = DEFAULT) -> DataFrame:
    """Named product, product line and category of each comment, with a confidence tier and its source."""
    require_columns(context, ["comment_id", "video_id", "raw_text"], "normalize_products")
    c = F.col
    blob = F.concat_ws(" ", pick(context, ["product_raw"], F.lit("")), "raw_text", pick(context, ["brand_raw"], F.lit("")))
    base = context.withColumn("__t", F.concat(F.lit(" "), F.lower(collapse_space(blob)), F.lit(" ")))
    kinds = {"__n": rules.named, "__l": rules.lines, "__c": rules.categories}
    base = base.withColumns({k: _alias_hits(c("__t"), specs) for k, specs in kinds.items()})
    none = F.array().cast("array<string>")
    base = base.withColumns({"named_product": c("__n.name"), "product_line": c("__l.name"), "__cat": c("__c.name")})
    base = base.withColumns({f"{k}h": F.coalesce(c(f"{k}.hits"), none) for k in kinds})
    barred = F.lit(False)
    for name, patterns in rules.excluded.items():
        barred = barred | ((c("__cat") == name) & matches_any(c("__t"), [p.replace("(?i)", "") for p in patterns]))
    by_name = F.lit(None).cast("string")
    if rules.named_category:
        by_name = F.element_at(F.create_map(*[F.lit(x) for pair in rules.named_category.items() for x in pair]), c("named_product"))
    found = F.coalesce(by_name, F.when(~F.coalesce(barred, F.lit(False)), c("__cat")))
    base = base.withColumns({"__by_name": by_name, "__found": found})
    from_name = c("__by_name").isNotNull()
    hits = F.concat("__nh", "__lh", F.when(from_name, F.array("named_product")).when(c("__found").isNotNull(), c("__ch")).otherwise(none))
    has_name, has_line, has_cat = c("named_product").isNotNull(), c("product_line").isNotNull(), c("__found").isNotNull()
    out = base.withColumns(
        {
            "product_category": F.coalesce("__found", F.lit("unknown")),
            "normalization_confidence": F.when(has_name, 0.96).when(has_line & has_cat, 0.88).when(has_cat, 0.82).otherwise(0.40),
            "lineage_source": F.when(has_name, "dictionary_named").when(has_line & has_cat, "dictionary_line_category")
            .when(has_cat, "dictionary_category").otherwise("semantic_fallback"),
            "product_alias_hits": F.array_distinct(hits),
            "brand_normalized": F.nullif(F.trim(pick(context, ["brand_raw"], F.lit(""))), F.lit("")),
        }
    )
    identity = F.concat(
        F.lit("cat:"), "product_category", F.lit("|line:"), F.coalesce("product_line", F.lit("na")),
        F.lit("|name:"), F.coalesce("named_product", F.lit("na")),
    )
    return out.withColumn("product_semantic_id", identity).drop("__t", "__cat", "__n", "__l", "__c", "__nh", "__lh", "__ch", "__by_name", "__found")


def _is_meaningful(segment: Column) -> Column:
    # The search ends at the third letter or digit, however long the segment is.
    return (F.length(segment) >= 4) & segment.rlike("[A-Za-z0-9가-힣](?:[^A-Za-z0-9가-힣]*+[A-Za-z0-9가-힣]){2}")


def _trim_ends(c: Column) -> Column:
    return F.btrim(c, F.lit(" ,.;!?"))


def split_once(text: Column, connectors: Sequence[tuple[str, Sequence[str]]]) -> Column:
    """Struct of rule and pieces for the first connector that leaves only meaningful pieces; else null.

    Connectors are tried one after the other: a text is split only by those it holds, up to the first that works.
    """
    options = []
    for rule, patterns in connectors:
        for pattern in patterns:
            pieces = F.filter(F.transform(F.split(text, pattern), _trim_ends), lambda p: p != "")
            whole = F.filter(F.array(F.struct(F.lit(rule).alias("rule"), pieces.alias("pieces"))), lambda o: (F.size(o["pieces"]) > 1) & F.forall(o["pieces"], _is_meaningful))
            options.append(F.when(text.rlike(pattern), F.try_element_at(whole, F.lit(1))))
    return F.coalesce(*options)


def split_pairs(text: Column, connectors: Sequence[tuple[str, Sequence[str]]] = marks.CONNECTORS, limit: int | None = None) -> Column:
    """Pieces of a text with the rule that made each: one split, then one more inside each piece.

    All pieces count; ``limit`` keeps the first ones only.
    """
    pair = "array<struct<text:string,rule:string>>"
    single = F.array(F.struct(text.alias("text"), F.lit(SINGLE).alias("rule"))).cast(pair)
    first = F.transform(F.array(split_once(text, connectors)), lambda s: s)

    def deeper(piece: Column, rule: Column) -> Column:
        inner = F.transform(
            F.array(split_once(piece, connectors)),
            lambda s: F.coalesce(
                F.transform(s["pieces"], lambda p: F.struct(p.alias("text"), s["rule"].alias("rule"))),
                F.array(F.struct(piece.alias("text"), rule.alias("rule"))),
            ),
        )
        return F.element_at(inner, 1)

    def whole(s: Column) -> Column:
        pairs = F.flatten(F.transform(s["pieces"], lambda p: deeper(p, s["rule"])))
        return (pairs if limit is None else F.slice(pairs, 1, limit)).cast(pair)

    nested = F.filter(F.transform(first, whole), lambda pairs: F.size(pairs) > 1)
    return F.coalesce(F.try_element_at(nested, F.lit(1)), single)


def brand_scope(low: Column, rules: SignalRules = DEFAULT) -> Column:
    brand, product = contains_any(low, rules.brands), contains_any(low, rules.products)
    return F.when(brand & product, "both").when(brand, "brand_only").otherwise("product_only")


def signal_polarity(low: Column, seed: Column, rules: SignalRules = DEFAULT) -> Column:
    pos, neg = contains_any(low, rules.positive), contains_any(low, rules.negative)
    given = F.lower(F.trim(seed))
    return (
        F.when(pos & neg, "mixed").when(neg, "negative").when(pos, "positive")
        .when(given.isin("positive", "negative", "mixed", "neutral"), given).otherwise("neutral")
    )


def signal_units(context: DataFrame, rules: SignalRules = DEFAULT) -> DataFrame:
    """One row per signal with stage, axis, polarity and weight. No shuffle: all labels are expressions."""
    require_columns(context, ["comment_id", "video_id", "raw_text", "product_semantic_id"], "signal_units")
    c = F.col
    base = context.select(
        "comment_id", "video_id", collapse_space(c("raw_text")).alias("__text"), c("raw_text").rlike(r"(?U)[^\s]").alias("__has_text"), "product_semantic_id",
        F.coalesce(pick(context, ["sentiment_seed"]).cast("string"), F.lit("")).alias("__polarity"),
        F.lower(F.trim(F.coalesce(pick(context, ["journey_stage_seed"]).cast("string"), F.lit("")))).alias("__stage"),
        normalize_axes(F.coalesce(pick(context, ["judgment_axes_seed"]).cast("array<string>"), F.array().cast("array<string>")), rules.valid_axes).alias("__axes"),
        F.coalesce(pick(context, ["like_count"]).try_cast("bigint"), F.lit(0)).alias("like_count"),
        F.coalesce(pick(context, ["reply_count"]).try_cast("bigint"), F.lit(0)).alias("reply_count"),
    ).where(c("__has_text") & (F.coalesce("comment_id", F.lit("")) != ""))
    base = base.withColumn("__whole_low", F.lower("__text"))
    # What follows from the whole text is settled before the split, so no signal carries that text.
    base = base.withColumn("__whole", brand_scope(c("__whole_low"), rules))
    kept = [n for n in base.columns if n not in ("__text", "__whole_low", "__has_text")]
    rows = unnest(base, split_pairs(c("__text"), rules.connectors), "__pair", *kept, position="__pos")
    # Pieces of a collapsed text are collapsed.
    rows = rows.withColumns({"signal_text": c("__pair.text"), "__rule": c("__pair.rule")})
    rows = rows.withColumn("__low", F.lower("signal_text"))
    low = c("__low")
    rows = rows.withColumns(
        {
            "brand_scope": brand_scope(low, rules),
            "polarity": signal_polarity(low, c("__polarity"), rules),
            "__best_stage": best_scored({s: bounded_count(low, m) for s, m in rules.stages.items()}),
            "__best_axis": best_scored({a: bounded_weight(low, m) for a, m in rules.axes.items()}),
            "__compared": low.rlike(rules.comparison),
            "__asks": F.length("signal_text") - F.length(F.replace(c("signal_text"), F.lit("?"), F.lit(""))),
            "__idle": matches_any(low, rules.generic),
        }
    )
    score, axis = c("__best_axis.score"), c("__best_axis.label")
    proven = F.when(axis == COMPARISON_AXIS, (score >= 2.2) | ((score >= 1.8) & c("__compared"))).otherwise(score >= 1.0)
    seeds = F.when(
        (c("__axes")[0] == COMPARISON_AXIS) & ~c("__compared"), F.filter("__axes", lambda a: a != COMPARISON_AXIS)
    ).otherwise(c("__axes"))
    meaningful = _is_meaningful(c("signal_text"))
    letters = F.length(F.regexp_replace("signal_text", "[^A-Za-z0-9가-힣]", ""))
    generic = (F.length("signal_text") <= 10) | ((c("__asks") >= 4) & (letters < 15)) | (c("__idle") & (score <= 0))
    rule = F.when((c("__rule") == SINGLE) & (c("__whole") == "both") & meaningful, "brand_product").otherwise(c("__rule"))
    primary = c("__pos") == 0
    weight = (
        F.when(~meaningful, 0.6).when(generic, 0.45).when(primary, 1.0)
        .when(rule.isin("contrast", "causal", "conditional", "brand_product"), 0.85).otherwise(0.75)
    )
    return rows.select(
        F.concat("comment_id", F.lit("#s"), (c("__pos") + 1).cast("string")).alias("signal_id"),
        "comment_id", "video_id", "signal_text",
        F.when(primary, "primary").otherwise("secondary").alias("signal_type"),
        rule.alias("split_rule"),
        F.when(c("__best_stage.score") >= 1, c("__best_stage.label")).when(c("__stage") != "", c("__stage")).otherwise("usage").alias("journey_stage"),
        F.when(proven, axis).otherwise(F.coalesce(F.try_element_at(seeds, F.lit(1)), F.lit(FALLBACK_AXIS))).alias("judgment_axis"),
        "polarity", weight.alias("weight"), "product_semantic_id", "brand_scope", "like_count", "reply_count",
    )
