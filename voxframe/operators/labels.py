"""Rule labels of a comment: sentiment score, class, target, inquiry, insight type and relevance."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxframe.functions.markers import (
    best_label,
    contains_any,
    first_match,
    hit_count,
    matches_any,
    negated_weight,
    weighted_hits,
)
from voxframe.functions.scores import clamp
from voxframe.functions.text import collapse_space, strip
from voxframe.operators.relational import attach, unnest
from voxframe.rules import comments as marks
from voxframe.rules import messages
from voxframe.rules import sentiment as lexicon
from voxframe.schemas import ENRICHMENT, pick, with_missing


@dataclass(frozen=True)
class SentimentRules:
    positive: Mapping[str, float] = field(default_factory=lambda: dict(lexicon.POSITIVE_TERMS))
    negative: Mapping[str, float] = field(default_factory=lambda: dict(lexicon.NEGATIVE_TERMS))
    negations: Sequence[str] = lexicon.NEGATION_TERMS
    intensifiers: Sequence[str] = lexicon.INTENSIFIERS
    complaints: Sequence[str] = lexicon.QUESTION_COMPLAINT_PATTERNS
    overrides: Sequence[str] = lexicon.POSITIVE_OVERRIDE_PATTERNS


@dataclass(frozen=True)
class CommentRules:
    agreement: Sequence[str] = marks.AGREEMENT_MARKERS
    short_dependent: Sequence[str] = marks.SHORT_DEPENDENT_MARKERS
    comparison: Sequence[str] = marks.COMPARISON_MARKERS
    preference: Sequence[str] = marks.PREFERENCE_MARKERS
    negative: Sequence[str] = marks.STRONG_NEGATIVE_MARKERS
    positive: Sequence[str] = marks.STRONG_POSITIVE_MARKERS
    informational: Sequence[str] = marks.INFORMATIONAL_MARKERS
    emotional: Sequence[str] = marks.EMOTIONAL_ONLY_MARKERS
    channel: Sequence[str] = marks.CHANNEL_FEEDBACK_MARKERS
    generic_positive: Sequence[str] = marks.GENERIC_POSITIVE_ONLY_MARKERS
    inquiry: Sequence[str] = marks.INQUIRY_MARKERS
    product: Sequence[str] = marks.PRODUCT_MARKERS
    targets: Mapping[str, Sequence[str]] = field(default_factory=lambda: dict(marks.TARGET_PATTERNS))
    target_labels: Mapping[str, str] = field(default_factory=lambda: dict(marks.TARGET_LABELS))
    negation_safe: Sequence[str] = messages.NEGATION_SAFE
    positive_overrides: Sequence[str] = messages.POSITIVE_OVERRIDES
    sentiment: SentimentRules = field(default_factory=SentimentRules)
    #: Characters up to which a comment may be short enough to lean on the one it answers.
    short_text: int = 60


def lexicon_sentiment(
    df: DataFrame,
    text: str,
    english: str | None = None,
    rules: SentimentRules = SentimentRules(),
    label: str = "base_sentiment",
    score: str = "base_score",
) -> DataFrame:
    """Sentiment label and score from weighted terms, intensifiers, complaints and negations.

    ``english`` names a column with the score of English text in [-1, 1] (see ``valence_score``).
    """
    low = F.lower(strip(F.coalesce(F.col(text), F.lit(""))))
    out = df.withColumn("__s_t", low)
    t = F.col("__s_t")
    latin = t.rlike("[A-Za-z]")
    given = F.when(latin, F.coalesce(F.col(english).cast("double"), F.lit(0.0))).otherwise(F.lit(0.0)) if english else F.lit(0.0)
    strong = contains_any(t, rules.intensifiers)
    complaint = matches_any(t, rules.complaints)
    boost = F.when(strong, F.lit(1.15)).otherwise(F.lit(1.0))
    out = out.select(
        "*",
        (weighted_hits(t, rules.positive) * boost + F.when(matches_any(t, rules.overrides), 1.0).otherwise(0.0)).alias("__s_p"),
        (weighted_hits(t, rules.negative) * boost + F.when(complaint, 1.1).otherwise(0.0)).alias("__s_n"),
        negated_weight(t, rules.positive, rules.negations).alias("__s_np"),
        negated_weight(t, rules.negative, rules.negations).alias("__s_nn"),
        (given * F.when(strong, 1.1).otherwise(1.0)).alias("__s_e"),
        (complaint & latin).alias("__s_c"),
        latin.alias("__s_latin"),
        t.rlike("[가-힣]").alias("__s_hangul"),
    )
    out = out.withColumns(
        {
            "__s_pos": F.col("__s_p") - F.col("__s_np") + F.col("__s_nn") * 0.6,
            "__s_neg": F.col("__s_n") - F.col("__s_nn") + F.col("__s_np") * 0.9,
            "__s_eng": F.when(F.col("__s_c"), F.least(F.col("__s_e"), F.lit(-0.25))).otherwise(F.col("__s_e")),
        }
    )
    total = F.col("__s_pos") + F.col("__s_neg")
    balance = F.when(total != 0, (F.col("__s_pos") - F.col("__s_neg")) / total)
    mixed_script = F.coalesce(balance, F.lit(0.0)) * 0.8 + F.col("__s_eng") * 0.2
    value = (
        F.when(t == "", F.lit(0.0))
        .when(F.col("__s_hangul") & F.col("__s_latin"), mixed_script)
        .when(F.col("__s_hangul"), F.coalesce(balance, F.lit(0.0)))
        .otherwise(F.coalesce(balance, F.col("__s_eng")))
    )
    # Rounding twice settles ties of sums of tenths the same way on every engine.
    out = out.withColumn(score, F.round(F.round(value, 9), 3))
    out = out.withColumn(
        label, F.when(F.col(score) >= 0.32, "positive").when(F.col(score) <= -0.22, "negative").otherwise("neutral")
    )
    return out.drop(*[c for c in out.columns if c.startswith("__s_")])


def valence_score(df: DataFrame, key: str, text: str, valences: DataFrame, name: str = "english_score") -> DataFrame:
    """Sum of word valences s, bent into [-1, 1] as ``s / sqrt(s² + 15)``.

    ``valences`` has columns ``token`` and ``valence``. Words without a valence are dropped by the join,
    and the sums combine before the shuffle.
    """
    found = F.regexp_extract_all(F.lower(F.col(text)), F.lit(r"(?U)[\w']+"), F.lit(0))
    words = unnest(df, found, "token", key)
    sums = attach(words, valences, ["token"], "inner").groupBy(key).agg(F.sum("valence").alias("__s"))
    s = F.col("__s")
    scored = sums.select(key, F.round(s / F.sqrt(s * s + 15), 4).alias(name))
    return attach(df, scored, [key])


def topic_by_markers(low: Column, stages: Mapping[str, Sequence[str]] = marks.CEJ_STAGE_KEYWORDS,
                     default: str = messages.OTHER_TOPIC) -> Column:
    """Stage with most markers in the lower-case text; the first stage wins ties."""
    return best_label({k: hit_count(low, v) for k, v in stages.items()}, 1, F.lit(default))


def brand_by_markers(low: Column, brands: Mapping[str, Sequence[str]] = marks.BRAND_PATTERNS,
                     default: str = messages.UNMENTIONED_BRAND) -> Column:
    """First brand with a marker in the lower-case text."""
    return first_match(low, brands, F.lit(default))


def risk_flags(low: Column, keywords: Sequence[str]) -> Column:
    """The risk keywords found in the lower-case text, joined."""
    found = [F.when(low.contains(k.lower()), F.lit(k)) for k in keywords]
    return F.array_join(F.array_compact(F.array(*found)), ", ")


def video_type(title: Column, channel: Column, patterns: Mapping[str, Sequence[str]] = marks.VIDEO_TYPE_PATTERNS) -> Column:
    return video_type_of(F.lower(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(channel, F.lit("")))), patterns)


def video_type_of(low: Column, patterns: Mapping[str, Sequence[str]] = marks.VIDEO_TYPE_PATTERNS) -> Column:
    """Video type from the lower-case title and channel."""
    return first_match(low, patterns, F.lit("general"))


def inquiry_flag(text: Column, parent: Column, markers: Sequence[str] = marks.INQUIRY_MARKERS) -> Column:
    """A question mark, or an inquiry marker in the text or in its parent."""
    source = F.coalesce(text, F.lit(""))
    own, above = collapse_space(F.lower(source)), collapse_space(F.lower(F.coalesce(parent, F.lit(""))))
    return _asks(source, own, above, markers)


def _asks(source: Column, own: Column, above: Column, markers: Sequence[str]) -> Column:
    return source.contains("?") | source.contains("？") | contains_any(own, markers) | contains_any(above, markers)


def is_strong_negative(low: Column, rules: CommentRules) -> Column:
    """A complaint marker that is left over once the harmless phrases are taken out."""
    trimmed = low
    for phrase in rules.negation_safe:
        trimmed = F.replace(trimmed, F.lit(phrase), F.lit(""))
    # Without a harmless phrase ``trimmed`` is the text itself.
    return contains_any(low, rules.negative) & contains_any(trimmed, rules.negative)


def is_strong_positive(low: Column, rules: CommentRules) -> Column:
    return contains_any(low, tuple(rules.positive_overrides) + tuple(rules.positive))


def insight_type(kind: Column, classification: Column, sentiment: Column, inquiry: Column, topics: Column, low: Column) -> Column:
    """Business insight type from inquiry, purchase words, video type and class, then sentiment."""
    names = messages.INSIGHT_TYPES
    topic_text = F.lower(F.array_join(F.coalesce(topics, F.array().cast("array<string>")), " "))
    mapped = F.create_map(*[F.lit(x) for (v, c), label in marks.INSIGHT_TYPE_MAP.items() for x in (f"{v}|{c}", label)])
    promo = kind == "promotional"
    by_sentiment = (
        F.when(
            sentiment == "negative",
            F.when(contains_any(topic_text, messages.PRICE_TOPIC_WORDS), names["price"])
            .when(contains_any(topic_text, messages.SERVICE_TOPIC_WORDS), names["service"])
            .otherwise(names["quality"]),
        )
        .when(sentiment == "positive", F.when(promo, names["conversion"]).otherwise(names["satisfaction"]))
        .otherwise(names["general"])
    )
    return (
        F.when(inquiry, F.when(promo, names["purchase_inquiry"]).otherwise(names["inquiry"]))
        .when(promo & contains_any(low, marks.PURCHASE_KEYWORDS), names["conversion"])
        .otherwise(F.coalesce(F.element_at(mapped, F.concat_ws("|", kind, classification)), by_sentiment))
    )


def relevance_score(video_score: Column, product_related: Column, target: Column, classification: Column, inquiry: Column) -> Column:
    """Share of the video's relevance plus what the comment itself says, within [0, 1]."""
    def points(test: Column, value: float) -> Column:
        return F.when(test, F.lit(value)).otherwise(F.lit(0.0))

    opinion = F.lower(classification).isin("complaint", "comparison", "preference")
    total = (
        clamp(F.coalesce(video_score, F.lit(0.0)) * 0.65, 0, 1)
        + points(product_related, 0.25)
        + points(F.coalesce(F.trim(target), F.lit("")) != "", 0.08)
        + points(opinion, 0.05)
        + points(inquiry, 0.03)
    )
    return clamp(total, 0, 1)


def fill_template(template: str, **parts: Column) -> Column:
    """A text template as a concatenation."""
    pieces = re.split(r"\{(\w+)\}", template)
    return F.concat(*[parts[p] if i % 2 else F.lit(p) for i, p in enumerate(pieces) if p])


def comment_reason(sentiment: Column, classification: Column, strength: Column, context_used: Column, target: Column,
                   labels: Mapping[str, str] = marks.TARGET_LABELS) -> Column:
    names = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])
    words = F.create_map(*[F.lit(x) for pair in messages.STRENGTH_LABELS.items() for x in pair])
    parts = {
        "target": F.coalesce(F.element_at(names, target), F.lit(messages.DEFAULT_TARGET_LABEL)),
        "strength": F.coalesce(F.element_at(words, strength), F.lit(messages.STRENGTH_LABELS["medium"])),
    }
    texts = {k: fill_template(v, **parts) for k, v in messages.COMMENT_REASONS.items()}
    body = (
        F.when(sentiment == "negative", texts["negative"])
        .when(sentiment == "positive", texts["positive"])
        .when(classification == "comparison", texts["comparison"])
        .when(classification == "preference", texts["preference"])
        .otherwise(texts["other"])
    )
    return F.concat(F.when(context_used, F.lit(messages.CONTEXT_PREFIX)).otherwise(F.lit("")), body)


#: Outcome of each case of the decision list: sentiment, strength, class, review needed.
_CASES = {
    "unrelated": ("neutral", "weak", "informational"),
    "comparison_negative": ("negative", "strong", "comparison"),
    "comparison": ("neutral", "weak", "comparison"),
    "preference": ("neutral", "weak", "preference"),
    "agreed_negative": ("negative", "strong", "complaint"),
    "agreed_positive": ("positive", "strong", "preference"),
    "agreed_unclear": ("neutral", "weak", "informational"),
    "negative": ("negative", "strong", "complaint"),
    "positive": ("positive", "strong", "preference"),
    "informational": ("neutral", "weak", "informational"),
    "uncertain": ("neutral", "weak", "informational"),
    "plain": ("neutral", "weak", "informational"),
}


def classify_comments(
    df: DataFrame,
    text: str = "cleaned_text",
    parent: str = "parent_comment_text",
    rules: CommentRules = CommentRules(),
    english: str | None = None,
) -> DataFrame:
    """Label every comment row; the columns of ``schemas.ENRICHMENT`` override the rules where given.

    Reads ``comment_validity``, ``is_reply``, ``title``, ``product``, ``channel_title`` and the video
    relevance columns where the frame has them. One pass, no shuffle.
    """
    df = with_missing(df, ENRICHMENT)
    blank = F.lit("")
    valid = pick(df, ["comment_validity"], F.lit("valid")) == "valid"
    context = F.concat_ws(" ", pick(df, ["title"], blank), pick(df, ["product"], blank))
    base = df.select(
        "*",
        strip(F.coalesce(F.col(text), blank)).alias("__source"),
        strip(pick(df, [parent], blank)).alias("__parent"),
        F.lower(context).alias("__context"),
        valid.alias("__valid"),
    )
    base = base.withColumns({"__low": F.lower("__source"), "__plow": F.lower("__parent")})
    base = base.withColumns({"__norm": collapse_space(F.col("__low")), "__pnorm": collapse_space(F.col("__plow"))})
    base = lexicon_sentiment(base, "__source", english, rules.sentiment, "__own_label", "__own_score")
    base = lexicon_sentiment(base, "__parent", None, rules.sentiment, "__parent_label", "__parent_score")
    low, plow, ctx = F.col("__low"), F.col("__plow"), F.col("__context")
    norm = F.col("__norm")
    compact = collapse_space(F.regexp_replace(norm, r"(?U)[^\w\s]", " "))
    base = base.withColumns(
        {
            "__agree": contains_any(low, rules.agreement),
            "__short": (F.length("__source") <= rules.short_text) & contains_any(low, rules.short_dependent),
            "__own": contains_any(low, rules.product),
            "__par": contains_any(plow, rules.product),
            "__ctx": contains_any(ctx, rules.product),
            "__offtopic": contains_any(norm, rules.channel) | contains_any(low, rules.emotional) | compact.isin(*rules.generic_positive),
            "__cmp": contains_any(low, rules.comparison) | contains_any(plow, rules.comparison),
            "__pref": contains_any(low, rules.preference),
            "__neg": is_strong_negative(low, rules),
            "__pos": is_strong_positive(low, rules),
            "__pneg": is_strong_negative(plow, rules),
            "__ppos": is_strong_positive(plow, rules),
            "__info": contains_any(low, rules.informational),
            "__blob": F.concat_ws(" ", low, plow, ctx),
        }
    )
    base = base.withColumn("__target", first_match(F.col("__blob"), rules.targets, F.lit(None).cast("string")))
    c = F.col
    inherited = ~c("__own") & ~c("__offtopic") & (
        (c("__agree") & (c("__par") | c("__ctx"))) | (c("__par") & (c("__cmp") | c("__pref")))
    )
    base = base.withColumn("__related", c("__own") | inherited)
    has_parent = c("__parent") != ""
    leaning = has_parent & (c("__agree") | c("__short"))
    case = (
        F.when(~c("__related"), "unrelated")
        .when(c("__cmp"), F.when(c("__neg") & ~c("__pref"), "comparison_negative").otherwise("comparison"))
        .when(c("__pref") & ~c("__neg") & ~c("__pos"), "preference")
        .when(
            leaning,
            F.when(c("__par") & c("__pneg"), "agreed_negative")
            .when(c("__par") & c("__ppos"), "agreed_positive")
            .otherwise("agreed_unclear"),
        )
        .when(c("__neg"), "negative")
        .when(c("__pos"), "positive")
        .when(c("__info"), "informational")
        .when(c("__own_label") != "neutral", "uncertain")
        .otherwise("plain")
    )
    base = base.withColumn("__case", case)

    def outcome(i: int) -> Column:
        chain = None
        for name, values in _CASES.items():
            chain = F.when(c("__case") == name, values[i]) if chain is None else chain.when(c("__case") == name, values[i])
        return chain

    def or_else(value: Column, fallback: float) -> Column:
        return F.when(value != 0, value).otherwise(F.lit(fallback))

    leaned = c("__case").startswith("agreed")
    compared = c("__case").startswith("comparison")
    score = (
        F.when(c("__case") == "comparison_negative", or_else(c("__own_score"), -0.3))
        .when(c("__case") == "agreed_negative", or_else(c("__parent_score"), -0.4))
        .when(c("__case") == "agreed_positive", or_else(c("__parent_score"), 0.4))
        .when(c("__case") == "negative", or_else(c("__own_score"), -0.4))
        .when(c("__case") == "positive", or_else(c("__own_score"), 0.4))
        .when(c("__case").isin("uncertain", "plain"), c("__own_score"))
        .otherwise(F.lit(0.0))
    )
    reply = pick(df, ["is_reply"], F.lit(False))
    base = base.withColumns(
        {
            "__sent": outcome(0),
            "__strength": outcome(1),
            "__class": outcome(2),
            "__score": score,
            "__used": leaned | (compared & has_parent),
            "__review": c("__case").isin("agreed_unclear", "uncertain")
            | ((c("__case") == "unrelated") & reply & ~has_parent),
        }
    )
    base = base.withColumn(
        "__conf",
        F.when(c("__sent") == "negative", F.when((c("__strength") == "strong") & (c("__class") == "complaint"), "high").otherwise("medium"))
        .when(c("__sent") == "positive", F.when(c("__strength") == "strong", "high").otherwise("medium"))
        .otherwise(F.when(c("__review") | c("__used"), "low").otherwise("medium")),
    )
    return _apply_enrichment(base, df, rules)


def _apply_enrichment(base: DataFrame, df: DataFrame, rules: CommentRules) -> DataFrame:
    """Final columns: external labels first, then the rules."""
    c = F.col
    label = c("nlp_label")
    polar = label.isin("positive", "negative", "neutral")
    trash = label == "trash"
    polar, trash = F.coalesce(polar, F.lit(False)), F.coalesce(trash, F.lit(False))
    mentions = F.coalesce(c("nlp_product_mentions"), F.array().cast("array<string>"))
    mentioned = F.size(mentions) > 0
    found = F.transform(mentions, lambda m: first_match(F.lower(F.trim(m)), {k: (k,) for k in messages.MENTION_TARGETS}, F.lit(None).cast("string")))
    key = F.try_element_at(F.filter(found, lambda k: k.isNotNull()), F.lit(1))
    targets = F.create_map(*[F.lit(x) for pair in messages.MENTION_TARGETS.items() for x in pair])
    conf = c("nlp_confidence")
    base = base.withColumn("__vblob", F.lower(F.concat_ws(" ", pick(df, ["title"], F.lit("")), pick(df, ["channel_title"], F.lit("")))))
    out = base.withColumns(
        {
            "__sent2": F.when(polar, label).when(trash, "neutral").otherwise(c("__sent")),
            "__class2": F.when(trash, "informational").otherwise(c("__class")),
            "__strength2": F.when(trash, "weak").otherwise(c("__strength")),
            "__score2": F.when(polar, F.coalesce(c("nlp_sentiment_score"), c("__score"))).otherwise(c("__score")),
            "__conf2": F.when(polar, F.when(conf >= 0.8, "high").when(conf >= 0.55, "medium").otherwise("low")).otherwise(c("__conf")),
            "__related2": c("__related") | mentioned,
            "__target2": F.coalesce(c("__target"), F.when(mentioned & ~c("__related"), F.element_at(targets, key))),
            "__inq": F.coalesce(c("nlp_is_inquiry"), _asks(c("__source"), c("__norm"), c("__pnorm"), rules.inquiry)),
            "__vtype": video_type_of(c("__vblob")),
        }
    )
    rule_reason = comment_reason(c("__sent"), c("__class"), c("__strength"), c("__used"), c("__target"), rules.target_labels)
    reason = (
        F.when(polar, F.coalesce(c("nlp_sentiment_reason"), rule_reason))
        .when(trash, F.coalesce(c("nlp_sentiment_reason"), F.lit(messages.TRASH_REASON)))
        .otherwise(rule_reason)
    )
    excluded = fill_template(messages.EXCLUDED_REASON, reason=pick(df, ["exclusion_reason"], F.lit("low quality")))
    video_score = pick(df, ["video_relevance_score"], F.lit(0.0)).cast("double")
    video_relevant = pick(df, ["is_relevant_video"], F.lit(False))
    relevance = relevance_score(video_score, c("__related2"), c("__target2"), c("__class2"), c("__inq"))
    out = out.withColumns({"__reason": reason, "__relevance": relevance,
                           "__insight": insight_type(c("__vtype"), c("__class2"), c("__sent2"), c("__inq"), c("nlp_topics"), c("__low"))})
    valid = c("__valid")

    def when_valid(value: Column, otherwise: object) -> Column:
        return F.when(valid, value).otherwise(F.lit(otherwise))

    final = {
        "product_related": when_valid(c("__related2"), False),
        "product_target": F.when(valid, c("__target2")),
        "sentiment_label": F.when(valid, c("__sent2")),
        "sentiment_score": F.when(valid, c("__score2")),
        "signal_strength": when_valid(c("__strength2"), "weak"),
        "classification_type": when_valid(c("__class2"), "informational"),
        "confidence_level": when_valid(c("__conf2"), "low"),
        "context_used": when_valid(c("__used"), False),
        "context_required_for_display": when_valid(c("__used"), False),
        "classification_reason": F.when(valid, c("__reason")).otherwise(excluded),
        "needs_review": when_valid(c("__review"), False),
        "insight_type": when_valid(c("__insight"), messages.INSIGHT_TYPES["general"]),
        "relevance_score": when_valid(c("__relevance"), 0.0),
        "relevant_comment": when_valid(video_relevant & (c("__relevance") >= 0.5), False),
        "nlp_is_inquiry": when_valid(c("__inq"), False),
        "nlp_is_rhetorical": F.coalesce(c("nlp_is_rhetorical"), F.lit(False)),
    }
    keep = [c(n) for n in base.columns if not n.startswith("__") and n not in final]
    return out.select(*keep, *[v.alias(k) for k, v in final.items()])


def attach_enrichment(df: DataFrame, enrichment: DataFrame) -> DataFrame:
    """Add externally made labels by comment id; columns they do not have become null."""
    known = [f.name for f in ENRICHMENT.fields if f.name != "comment_id"]
    extra = with_missing(enrichment, ENRICHMENT).select("comment_id", *known)
    return df.drop(*known).join(extra, "comment_id", "left")
