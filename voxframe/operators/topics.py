"""From signals to topics: signatures, ranking, representatives, quality gate, actions and export rows."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxframe.functions.markers import contains_any, hit_count
from voxframe.functions.scores import clamp, hash_pick, short_id
from voxframe.operators.descriptive import count_if
from voxframe.operators.labels import fill_template
from voxframe.operators.relational import attach, top_per_group, unnest
from voxframe.operators.signals import COMPARISON_AXIS
from voxframe.rules import messages
from voxframe.rules import signals as marks
from voxframe.schemas import require_columns
from voxframe.session import materialize

GROUP = ("product_semantic_id", "journey_stage", "judgment_axis", "polarity_group")
NON_WORD = "[^A-Za-z0-9가-힣]+"
# Every match of the two patterns holds one of its parts, or a letter that only the patterns take for s, i or k.
_GENERIC_PARTS = ("thank", "video", "lol", "lmao", "first!", "subscribe", "ſ", "ı", "\u212a")
_OFF_TOPIC_PARTS = ("politics", "wife", "husband", "married", "birthday", "funny channel", "ſ", "ı", "\u212a")


def _lookup(table: Mapping[str, str], key: Column, default: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key), default)


def topic_signatures(signals: DataFrame, stopwords: Sequence[str] = marks.GENERIC_STOPWORDS, forms: Mapping[str, str] = marks.TOKEN_NORMALIZATION) -> DataFrame:
    """Signature per product, stage, axis and polarity: the two most frequent repeated tokens.

    Tokens are counted per group with partial aggregation; only two rows per group go on.
    """
    c = F.col
    sizes = signals.groupBy(*GROUP).agg(F.count("*").alias("__n"))
    # What stands between spaces is counted as written; only different ones of a group are cut into words, lower-cased
    # and mapped. A space is no part of a word, so the counts are those of the words of all texts.
    written = unnest(signals, F.split("signal_text", " "), "__word", *GROUP).groupBy(*GROUP, "__word").agg(F.count("*").alias("__c"))
    tokens = unnest(written, F.split("__word", NON_WORD), "__part", *GROUP, "__c").withColumn("__low", F.lower("__part"))
    tokens = tokens.select(*GROUP, "__c", (_lookup(forms, c("__low"), c("__low")) if forms else c("__low")).alias("__token"))
    tokens = tokens.where((F.length("__token") >= 2) & ~c("__token").isin(*stopwords))
    counts = tokens.groupBy(*GROUP, "__token").agg(F.sum("__c").alias("__c"))
    marked = attach(counts, sizes, GROUP, derived=True).withColumn("__rep", c("__c") >= F.when(c("__n") >= 20, 3).otherwise(2))
    best = top_per_group(marked, GROUP, [c("__rep").desc(), c("__c").desc(), c("__token")], 2, "__rank")
    ordered = F.array_sort(F.collect_list(F.struct("__rank", "__rep", "__token")))
    grouped = best.groupBy(*GROUP).agg(ordered.alias("__top"))
    chosen = F.filter("__top", lambda s: s["__rep"] | ~c("__top")[0]["__rep"])
    words = F.array_join(F.transform(chosen, lambda s: s["__token"]), "_")
    out = sizes.join(grouped.select(*GROUP, words.alias("__words")), list(GROUP), "left")
    signature = F.concat_ws("_", "journey_stage", "judgment_axis", F.coalesce("__words", F.lit("general")))
    return out.select(*GROUP, signature.alias("signature"))


def attach_topics(
    signals: DataFrame,
    stopwords: Sequence[str] = marks.GENERIC_STOPWORDS,
    forms: Mapping[str, str] = marks.TOKEN_NORMALIZATION,
    hold: Callable[[DataFrame], DataFrame] = materialize,
) -> DataFrame:
    """Signals with the key and id of their topic.

    The signatures are held, so their true size is known and signals with their texts are not moved to meet them.
    """
    require_columns(signals, ["signal_id", "signal_text", "product_semantic_id", "journey_stage", "judgment_axis", "polarity"], "attach_topics")
    rows = signals.withColumn("polarity_group", F.lower(F.coalesce("polarity", F.lit("neutral"))))
    out = attach(rows, hold(topic_signatures(rows, stopwords, forms)), GROUP)
    key = F.concat_ws("|", "journey_stage", "judgment_axis", "polarity_group", "product_semantic_id", "signature")
    return out.withColumn("topic_key", key).withColumn("topic_id", short_id(F.col("topic_key")))


def build_topics(signals: DataFrame) -> DataFrame:
    """One row per topic with its signal and comment counts."""
    return signals.groupBy("topic_id", "topic_key", *GROUP, "signature").agg(
        F.count("*").alias("signal_count"), F.countDistinct("comment_id").alias("comment_count")
    )


def _joined(reasons: Mapping[str, Column]) -> Column:
    """Sorted distinct reason names of the tests that hold, joined by a bar."""
    return F.array_join(F.array_sort(F.array_compact(F.array(*[F.when(t, F.lit(n)) for n, t in reasons.items()]))), "|")


def rank_topics(topics: DataFrame, signals: DataFrame, comparison: str = marks.COMPARISON) -> DataFrame:
    """Coverage, polarity mix, importance and rank score with penalties and the reasons for them.

    All signals are grouped once by topic; the scope size is one scalar subquery.
    """
    c = F.col
    p = F.lower(F.coalesce("polarity", F.lit("neutral")))
    stats = signals.groupBy("topic_id").agg(
        F.count("*").alias("__n"),
        *[count_if(p == s).alias(f"__{s}") for s in ("positive", "negative", "mixed", "neutral")],
        (F.sum("like_count") + F.sum("reply_count") * 1.5).alias("__impact"),
        count_if(c("signal_text").rlike(comparison)).alias("__markers"),
    )
    scope = signals.agg(F.countDistinct("comment_id")).scalar()
    base = topics.join(stats, "topic_id").withColumns(
        {
            "__scope": F.greatest(scope, F.lit(1)),
            "frequency_count": c("signal_count"),
            "__comments": c("comment_count"),
        }
    )
    total = F.greatest(c("__n"), F.lit(1))
    base = base.withColumns(
        {
            "__cov": c("__comments") / c("__scope") * 100.0,
            **{f"__r_{s}": c(f"__{s}") / total for s in ("positive", "negative", "mixed", "neutral")},
            "__compare": c("judgment_axis") == COMPARISON_AXIS,
            "__cohesion": c("__comments") / F.greatest(c("frequency_count"), F.lit(1)),
            "__density": c("frequency_count") / F.greatest(c("__comments"), F.lit(1)),
        }
    )
    base = base.withColumn("__marker_ratio", F.when(c("__compare"), c("__markers") / total).otherwise(0.0))
    base = base.withColumn("__nm", c("__r_negative") + c("__r_mixed") * 0.7)
    severity = c("__nm") + c("__r_neutral") * 0.2
    importance = (
        F.least(c("__cov") / 100.0, F.lit(1.0)) * 0.40 + F.least(c("frequency_count") / 50.0, F.lit(1.0)) * 0.25 + severity * 0.25
        + F.least(F.log1p(F.greatest(c("__impact"), F.lit(0.0))) / 6.0, F.lit(1.0)) * 0.10
    )
    cov, freq, people = c("__cov"), c("frequency_count"), c("__comments")
    base = base.withColumns({"__imp": importance, "insufficient_evidence": (freq < 3) | (people < 2) | (cov < 1.0)})
    reasons = {
        "insufficient_evidence": c("insufficient_evidence"),
        "weak_cohesion": c("__cohesion") < 0.56,
        "micro_topic": (cov < 2.0) & (freq < 20),
        "over_split": c("__density") > 3.8,
        "comparison_marker_weak": c("__compare") & (c("__marker_ratio") < 0.35),
        "comparison_support_weak": c("__compare") & ((cov < 2.8) | (people < 15)),
        "comparison_signal_weak": c("__compare") & (c("__nm") < 0.35),
    }
    # The factor of each reason and of coverage bands.
    factors = {
        "insufficient_evidence": 0.70, "weak_cohesion": 0.82, "micro_topic": 0.72, "over_split": 0.86,
        "comparison_marker_weak": 0.56, "comparison_support_weak": 0.60, "comparison_signal_weak": 0.72,
    }

    def factor(test: Column, value: float) -> Column:
        return F.when(test, F.lit(value)).otherwise(F.lit(1.0))

    penalty = factor(cov < 3.0, 0.80) * factor(cov < 1.0, 0.65) * factor((cov >= 6.0) & (people >= 25), 1.06)
    for name, test in reasons.items():
        penalty = penalty * factor(test, factors[name])
    base = base.withColumns({"__penalty": penalty, "top_exclusion_reason": _joined(reasons)})
    score = c("__imp") * (c("__nm") * 0.35 + 1.0) * 100.0 * c("__penalty")
    mix = F.to_json(F.struct(*[F.round(f"__r_{s}", 4).alias(s) for s in ("positive", "negative", "mixed", "neutral")]))
    return base.select(
        "topic_id", "frequency_count", F.round("__cov", 4).alias("coverage_pct"), mix.alias("polarity_distribution"),
        F.round("__nm", 6).alias("negative_or_mixed_weight"), F.round(clamp(c("__imp"), 0, 1), 6).alias("importance_signal"),
        F.round(F.greatest(score, F.lit(0.0)), 4).alias("rank_score"), "insufficient_evidence",
        F.lit(None).cast("double").alias("trend_score"), F.round("__cohesion", 6).alias("cohesion_ratio"),
        F.round("__penalty", 6).alias("ranking_penalty"), F.round("__density", 6).alias("signal_density"),
        (c("top_exclusion_reason") == "").alias("top_quality_pass"), "top_exclusion_reason",
        F.round("__marker_ratio", 6).alias("comparison_marker_ratio"),
    )


def _word_set(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(c), NON_WORD), lambda t: F.length(t) >= 2))


def _axis_keyword_ratio(text: Column, axis: Column, keywords: Mapping[str, Sequence[str]]) -> Column:
    chain = None
    for name, words in keywords.items():
        n = hit_count(text, words)
        chain = F.when(axis == name, n) if chain is None else chain.when(axis == name, n)
    if chain is None:
        return F.lit(1.0)
    # The count is bound once; axes without keywords have none.
    return F.element_at(F.transform(F.array(chain), lambda n: F.when(n >= 2, 1.0).when(n == 1, 0.75).when(n == 0, 0.25).otherwise(1.0)), 1)


def select_representatives(
    topics: DataFrame,
    signals: DataFrame,
    n: int = 3,
    axis_keywords: Mapping[str, Sequence[str]] = marks.AXIS_KEYWORDS,
    comparison: str = marks.COMPARISON,
    floor: float = 0.30,
    hold: Callable[[DataFrame], DataFrame] = materialize,
) -> DataFrame:
    """Up to ``n`` comments per topic by alignment; none if the mean alignment stays below the floor.

    Signals are averaged per topic and comment first, so later steps see comments, not signals, and the
    best comments are cut per task before the shuffle. These sums are held: their texts are read once, and the
    tables of one row per topic are then known to be small, so no task gathers all comments of a large topic.
    """
    c = F.col
    # Signals carry the columns their topic was made of, so the topic table is not joined.
    rows = signals.withColumns(
        {"__axis": F.lower("judgment_axis"), "__pol": F.lower("polarity_group"), "__product": c("product_semantic_id"), "__signature": c("signature")}
    ).withColumn("__low", F.lower("signal_text"))
    text = c("signal_text")
    low = c("__low")
    polarity = F.lower("polarity")
    asks = F.length(text) - F.length(F.replace(text, F.lit("?"), F.lit("")))
    letters = F.length(F.regexp_replace(text, "[^A-Za-z0-9가-힣]", ""))
    noise = F.array(*[F.lit(w) for w in marks.SIGNATURE_NOISE])
    words = F.filter(_word_set(c("__signature")), lambda t: ~F.array_contains(noise, t))
    rows = rows.withColumn("__sig", words)
    # A word of the signature that stands alone in the text. The word comes first in the pattern, so the search skips to it.
    alone = lambda t: low.contains(t) & F.rlike(low, F.concat(t, F.lit("(?<![A-Za-z0-9가-힣]"), t, F.lit(")(?![A-Za-z0-9가-힣])")))
    shared = F.size(F.filter("__sig", alone)) / F.size("__sig")
    rows = rows.withColumns(
        {
            "__am": F.lower("judgment_axis") == c("__axis"),
            "__pm": F.when(c("__pol") == "neutral", polarity.isin("neutral", "mixed")).otherwise(polarity == c("__pol")),
            "__dm": c("product_semantic_id") == c("__product"),
            "__generic": F.when(F.length(text) < 14, 0.40).otherwise(
                F.when(contains_any(low, _GENERIC_PARTS) & low.rlike(marks.GENERIC_REPRESENTATIVES), 0.55).otherwise(1.0)
                * F.when(contains_any(low, _OFF_TOPIC_PARTS) & low.rlike(marks.OFF_TOPIC), 0.45).otherwise(1.0)
                * F.when((asks >= 4) & (letters < 20), 0.60).otherwise(1.0)
            ),
            "__kw": _axis_keyword_ratio(low, c("__axis"), axis_keywords),
            "__so": F.when(F.size("__sig") == 0, 0.75).otherwise(clamp(shared, 0.2, 1.0)),
            "__cs": F.when(text == "", 0.0).when(text.rlike(comparison), 1.0).otherwise(0.2),
        }
    )
    tier = F.when(c("__am") & c("__pm") & c("__dm"), 2).when(c("__am") & c("__pm"), 1).otherwise(0)
    rows = rows.withColumn("__tier", tier)
    means = ["weight", "__am", "__pm", "__dm", "__generic", "__kw", "__so", "__cs"]
    partial = rows.groupBy("topic_id", "comment_id", "__tier", "__axis").agg(
        F.count("*").alias("__n"),
        count_if(c("signal_type") == "primary").alias("__primary"),
        *[F.sum(c(m).cast("double")).alias(f"__sum_{m}") for m in means],
    )
    partial = hold(partial)
    reached = hold(partial.groupBy("topic_id").agg(F.max("__tier").alias("__best")))
    aligned = attach(partial, reached, ["topic_id"]).where(c("__tier") >= c("__best"))
    summary = aligned.groupBy("topic_id", "comment_id", "__axis").agg(
        F.sum("__n").alias("__density"), F.sum("__primary").alias("__primary"),
        *[(F.sum(f"__sum_{m}") / F.sum("__n")).alias(f"__avg_{m.strip('_')}") for m in means],
    )
    compare = c("__axis") == COMPARISON_AXIS
    proven = (c("__avg_kw") >= 0.85) & (c("__avg_cs") >= 0.6) & (c("__avg_so") >= 0.45)
    summary = summary.withColumn("__pass", F.when(compare, proven).otherwise(c("__avg_kw") >= 0.6))
    summary = summary.where(~compare | c("__pass"))
    per_topic = hold(summary.groupBy("topic_id").agg(
        F.max("__pass").alias("__any"), F.max(F.when(c("__pass"), c("__density"))).alias("__peak_pass"), F.max("__density").alias("__peak_all")
    ))
    scored = attach(summary, per_topic, ["topic_id"]).where(c("__pass") | ~c("__any"))
    scored = scored.withColumn("__peak", F.when(c("__any"), c("__peak_pass")).otherwise(c("__peak_all")))
    component = (
        c("__density") / c("__peak") * 0.26 + clamp(c("__avg_weight"), 0, 1) * 0.14
        + F.when(c("__primary") > 0, 0.08).otherwise(0.0) + c("__avg_am") * 0.16 + c("__avg_pm") * 0.10 + c("__avg_dm") * 0.08
        + c("__avg_so") * 0.12 + c("__avg_cs") * 0.06
    ) * c("__avg_generic") * c("__avg_kw")
    # Rounding makes the order independent of how the sums were split over tasks.
    scored = scored.withColumn("__comp", F.round(component, 9))
    order = [c("__comp").desc(), c("__density").desc(), F.round("__avg_so", 9).desc(), F.round("__avg_am", 9).desc(), F.round("__avg_pm", 9).desc(), c("comment_id")]
    best = top_per_group(scored, ["topic_id"], order, n, "__rank")
    chosen = best.groupBy("topic_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("__rank", "comment_id"))), lambda s: s["comment_id"]).alias("__ids"),
        F.avg("__comp").alias("__score"),
    )
    none = F.array().cast("array<string>")
    out = topics.select("topic_id").join(chosen, "topic_id", "left")
    return out.select(
        "topic_id",
        F.when(c("__score") >= floor, c("__ids")).otherwise(none).alias("representative_comment_ids"),
        F.round(clamp(F.coalesce("__score", F.lit(0.0)), 0, 1), 6).alias("alignment_score"),
        F.when(c("__score").isNull(), "no viable representative candidates")
        .when(c("__score") < floor, "representative quality below hard floor")
        .otherwise("axis/polarity/product + signature overlap")
        .alias("selection_reason"),
    )


def quality_gate(ranked: DataFrame, topics: DataFrame, representatives: DataFrame) -> DataFrame:
    """Lower the score of topics without strong, aligned evidence and record why."""
    c = F.col
    base = ranked.join(topics.select("topic_id", "judgment_axis"), "topic_id", "left").join(
        representatives.select("topic_id", "alignment_score", "representative_comment_ids"), "topic_id", "left"
    )
    alignment = F.coalesce("alignment_score", F.lit(0.0))
    count = F.coalesce(F.size("representative_comment_ids"), F.lit(0))
    compare = c("judgment_axis") == COMPARISON_AXIS
    # Reason, test and factor in the order they apply.
    rules = (
        ("no_representative", count == 0, 0.30),
        ("low_alignment", alignment < 0.50, 0.50),
        ("comparison_low_alignment", compare & (alignment < 0.60), 0.55),
        ("comparison_marker_insufficient", compare & (c("comparison_marker_ratio") < 0.45), 0.60),
        ("comparison_low_coverage", compare & (c("coverage_pct") < 3.0), 0.65),
        ("insufficient_evidence", c("insufficient_evidence"), 0.70),
    )
    score = c("rank_score") * F.when(c("top_quality_pass"), 1.0).otherwise(0.55)
    passed = c("top_quality_pass")
    for _, test, factor in rules:
        score = score * F.when(test, factor).otherwise(1.0)
        passed = passed & ~test
    new = F.array_compact(F.array(*[F.when(t, F.lit(n)) for n, t, _ in rules]))
    old = F.filter(F.split("top_exclusion_reason", r"\|"), lambda r: r != "")
    return base.withColumns(
        {
            "rank_score": F.round(F.greatest(score, F.lit(0.0)), 4),
            "top_quality_pass": passed,
            "top_exclusion_reason": F.array_join(F.array_sort(F.array_distinct(F.concat(old, new))), "|"),
            "representative_count": count,
        }
    ).drop("judgment_axis", "alignment_score", "representative_comment_ids")


def _pick(key: Column, options: Sequence[Column]) -> Column:
    index = hash_pick(key, len(options))
    chain = F.when(index == 0, options[0])
    for i, option in enumerate(options[1:], start=1):
        chain = chain.when(index == i, option)
    return chain


def insight_actions(ranked: DataFrame, topics: DataFrame, representatives: DataFrame) -> DataFrame:
    """Insight and action texts, priority and evidence strength per topic."""
    c = F.col
    base = ranked.join(topics.select("topic_id", "journey_stage", "judgment_axis", "product_semantic_id"), "topic_id", "left").join(
        representatives.select("topic_id", "representative_comment_ids", "alignment_score"), "topic_id", "left"
    )
    stage, axis = c("journey_stage"), c("judgment_axis")

    def share(name: str) -> Column:
        return F.coalesce(F.get_json_object("polarity_distribution", f"$.{name}").cast("double"), F.lit(0.0))

    phrase = (
        F.when(share("negative") >= 0.5, messages.TOPIC_PHRASES["negative"]).when(share("mixed") >= 0.35, messages.TOPIC_PHRASES["mixed"])
        .when(share("positive") >= 0.6, messages.TOPIC_PHRASES["positive"]).otherwise(messages.TOPIC_PHRASES["other"])
    )
    name = F.regexp_extract("product_semantic_id", r"\|name:([^|]*)", 1)
    category = F.regexp_extract("product_semantic_id", r"cat:([^|]*)", 1)
    target = F.when(~name.isin("", "na"), name).when(category != "", category).otherwise(messages.DEFAULT_PRODUCT_TARGET)
    action = None
    for key, options in marks.ACTION_CATALOG.items():
        value = _pick(c("topic_id"), [F.lit(o) for o in options])
        action = F.when(axis == key, value) if action is None else action.when(axis == key, value)
    base = base.withColumns({"__phrase": phrase, "__target": target, "__action": action.otherwise(messages.DEFAULT_ACTION)})
    parts = {
        "stage": _lookup(marks.STAGE_LABEL, stage, F.when(stage != "", stage).otherwise("unspecified_stage")),
        "axis": _lookup(marks.ISSUE_AXIS_LABEL, axis, F.when(axis != "", axis).otherwise("unspecified_issue")),
        "coverage": F.format_string("%.1f", c("coverage_pct")),
        "count": F.format_number("frequency_count", 0),
        "phrase": c("__phrase"),
        "target": c("__target"),
        "domain": _lookup(marks.DOMAIN_BY_AXIS, axis, F.lit("product")),
        "action": c("__action"),
    }
    insight = _pick(F.concat("topic_id", F.lit("|insight")), [fill_template(t, **parts) for t in messages.TOPIC_INSIGHTS])
    sentence = _pick(F.concat("topic_id", F.lit("|action")), [fill_template(t, **parts) for t in messages.TOPIC_ACTIONS])
    weak = F.coalesce("insufficient_evidence", F.lit(False))
    strength = clamp(c("importance_signal") * 0.7 + F.coalesce("alignment_score", F.lit(0.0)) * 0.3, 0, 1)
    priority = (
        F.when(weak, "monitor").when((c("rank_score") >= 72.0) & (c("negative_or_mixed_weight") >= 0.55), "immediate_fix")
        .when(c("rank_score") >= 42.0, "short_term_improvement").otherwise("monitor")
    )
    return base.select(
        "topic_id", insight.alias("insight_text"), sentence.alias("action_text"), priority.alias("priority_level"),
        F.round(F.when(weak, F.least(strength, F.lit(0.49))).otherwise(strength), 6).alias("evidence_strength"),
        F.coalesce("representative_comment_ids", F.array().cast("array<string>")).alias("supporting_comment_ids"),
    )


def export_rows(ranked: DataFrame, topics: DataFrame, actions: DataFrame, context: DataFrame) -> DataFrame:
    """Sheet-ready rows: topics numbered per polarity, with the texts of their comments."""
    c = F.col
    base = ranked.select("topic_id", "rank_score").join(topics.select("topic_id", "judgment_axis", "polarity_group"), "topic_id", "left")
    base = base.join(actions.select("topic_id", "supporting_comment_ids"), "topic_id", "left")
    group = _lookup(marks.POLARITY_GROUP_MAP, F.lower("polarity_group"), F.lit("NEU"))
    base = base.withColumn("topic_group", group)
    # Numbers run over bands of the score: what higher bands hold, plus the place within the band. There are only
    # four groups, so none of them may be sorted in one task.
    base = base.withColumn("__band", F.floor(F.coalesce("rank_score", F.lit(-1.0))))
    bands = base.groupBy("topic_group", "__band").agg(F.count("*").alias("__size"))
    above = Window.partitionBy("topic_group").orderBy(c("__band").desc()).rowsBetween(Window.unboundedPreceding, -1)
    ahead = bands.select("topic_group", "__band", F.coalesce(F.sum("__size").over(above), F.lit(0)).alias("__ahead"))
    window = Window.partitionBy("topic_group", "__band").orderBy(c("rank_score").desc(), "topic_id")
    base = base.join(ahead, ["topic_group", "__band"]).withColumn("topic_rank", F.concat(F.lit("T"), (c("__ahead") + F.row_number().over(window)).cast("string")))
    base = base.drop("__band", "__ahead")
    ids = base.select("topic_id", F.posexplode("supporting_comment_ids").alias("__pos", "comment_id"))
    texts = context.select("comment_id", F.trim("raw_text").alias("text"))
    found = ids.join(texts, "comment_id").groupBy("topic_id").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("__pos", "comment_id", "text"))),
            lambda s: F.struct(s["comment_id"].alias("comment_id"), s["text"].alias("text")),
        ).alias("__list")
    )
    label = _lookup(marks.SHEET_AXIS_LABEL, c("judgment_axis"), F.when(c("judgment_axis") != "", c("judgment_axis")).otherwise("핵심이슈"))
    sheet = F.regexp_replace(F.concat_ws("_", "topic_group", "topic_rank", "topic_display_label"), r"[\\/*?:\[\]]+", "")
    out = base.join(found, "topic_id", "left").withColumn("topic_display_label", label)
    empty = F.array().cast("array<struct<comment_id:string,text:string>>")
    return out.select(
        "topic_id", "topic_group", "topic_rank", F.coalesce(F.lower("polarity_group"), F.lit("neutral")).alias("polarity_group"),
        "topic_display_label", F.to_json(F.coalesce("__list", empty)).alias("comment_list"), F.substring(sheet, 1, 31).alias("sheet_name"),
    )


def topic_share(ranked: DataFrame, topics: DataFrame, by: str, n: int = 8) -> DataFrame:
    """Signals per axis or stage, the largest ``n``."""
    rows = ranked.select("topic_id", "frequency_count").join(topics.select("topic_id", by), "topic_id")
    return rows.groupBy(by).agg(F.sum("frequency_count").alias("frequency_count")).orderBy(F.col("frequency_count").desc(), by).limit(n)


def sanity_checks(context: DataFrame, signals: DataFrame, topics: DataFrame) -> DataFrame:
    """``check, value, least, ok``: there are topics, and at least one signal for each comment with text."""
    counts = topics.agg(F.count("*").alias("topics")).select(
        "topics", signals.agg(F.count("*")).scalar().alias("signals"), context.where(F.trim("raw_text") != "").agg(F.count("*")).scalar().alias("comments")
    )
    one = lambda name, value, least: F.struct(F.lit(name).alias("check"), F.col(value).alias("value"), least.alias("least"))
    rows = counts.select(F.explode(F.array(one("topics", "topics", F.lit(1).cast("long")), one("signals", "signals", F.col("comments")))).alias("c")).select("c.*")
    return rows.withColumn("ok", F.col("value") >= F.col("least"))


def checked(rows: DataFrame, checks: DataFrame) -> DataFrame:
    """The rows as they are; reading them fails with the first check that does not hold, also if there are no rows.

    The checks are a branch of the plan that yields nothing or raises, so no action runs beside the query.
    """
    failed = checks.agg(F.min(F.when(~F.col("ok"), F.format_string("%s must be >= %d but is %d", "check", "least", "value"))).alias("why"))
    none = failed.where(F.when(F.col("why").isNull(), F.lit(False)).otherwise(F.raise_error(F.col("why")).cast("boolean")))
    return rows.union(none.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema.fields]))
