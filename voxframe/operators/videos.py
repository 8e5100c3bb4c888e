"""Relevance and selection of videos, and the per-video summary of their comments."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxframe.functions.keywords import DEFAULT, KeywordRules, is_business_keyword, point_tokens, tokenize
from voxframe.functions.markers import contains_any
from voxframe.functions.scores import clamp, ratio
from voxframe.functions.text import link_at_time, safe_text, timestamp_label, timestamp_seconds
from voxframe.operators.cards import combined_text, row_summary, salient_clauses, split_clauses
from voxframe.operators.descriptive import count_if
from voxframe.operators.relational import ListRule, attach, top_lists
from voxframe.operators.similar import POINT_ALIASES, POINT_NOISE
from voxframe.rules import messages
from voxframe.schemas import pick
from voxframe.session import materialize


@dataclass(frozen=True)
class SelectionPolicy:
    """Whose videos count: all terms are matched as lower-case substrings."""

    target_brands: Sequence[str] = ()
    competitors: Sequence[str] = ()
    products: Sequence[str] = ()
    preferred_channels: Sequence[str] = ()
    blocked_channels: Sequence[str] = ()
    require_product: bool = True
    require_target: bool = False
    exclude_competitors: bool = True
    enabled: bool = True


def _hits(videos: DataFrame, policy: SelectionPolicy, names: Sequence[str]) -> DataFrame:
    blank = F.lit("")
    parts = [F.coalesce(pick(videos, [n], blank).cast("string"), blank) for n in names]
    tags = F.array_join(pick(videos, ["tags"]).cast("array<string>"), " ") if "tags" in videos.columns else F.lit(None)
    out = videos.withColumns({"__blob": F.lower(F.concat_ws(" ", *parts, tags)), "__channel": F.lower(F.coalesce(pick(videos, ["channel_title"], blank), blank))})

    def any_of(column: str, terms: Sequence[str]) -> Column:
        return contains_any(F.col(column), [t.strip().lower() for t in terms])

    return out.withColumns(
        {
            "target_brand_hit": any_of("__blob", policy.target_brands), "product_hit": any_of("__blob", policy.products),
            "__competitor": any_of("__blob", policy.competitors), "preferred_channel_hit": any_of("__channel", policy.preferred_channels),
            "__blocked": any_of("__channel", policy.blocked_channels),
        }
    )


def annotate_relevance(videos: DataFrame, policy: SelectionPolicy) -> DataFrame:
    """Relevance score in [0, 1] and the flag that the policy derives from it; no video is dropped."""
    c = F.col
    if not policy.enabled:
        no = F.lit(False)
        return videos.withColumns({"video_relevance_score": F.lit(0.0), "is_relevant_video": F.lit(True), "target_brand_hit": no, "product_hit": no, "preferred_channel_hit": no})
    out = _hits(videos, policy, ("title", "description", "channel_title", "keyword", "product"))
    points = lambda test, v: F.when(test, F.lit(v)).otherwise(F.lit(0.0))
    score = points(c("target_brand_hit"), 0.45) + points(c("product_hit"), 0.35) + points(c("preferred_channel_hit"), 0.30)
    if policy.exclude_competitors:
        score = score - points(c("__competitor") & ~c("target_brand_hit"), 0.40)
    # Rounded far below the threshold, so that 0.45 from a sum of tenths is 0.45.
    out = out.withColumn("__score", F.round(clamp(score, 0, 1), 9))
    relevant = (c("__score") >= 0.45) & ~c("__blocked")
    if policy.require_product:
        relevant = relevant & (c("product_hit") | c("preferred_channel_hit"))
    if policy.require_target:
        relevant = relevant & (c("target_brand_hit") | c("preferred_channel_hit"))
    out = out.withColumns({"video_relevance_score": F.round("__score", 3), "is_relevant_video": relevant})
    return out.drop("__blob", "__channel", "__competitor", "__blocked", "__score")


def select_videos(videos: DataFrame, policy: SelectionPolicy) -> DataFrame:
    """Selection score and keep flag of each video; rejected ones stay, marked."""
    c = F.col
    out = _hits(videos, policy, ("title", "description", "channel_title"))
    keep = ~c("__blocked")
    if policy.require_product:
        keep = keep & (c("product_hit") | c("preferred_channel_hit"))
    if policy.require_target:
        keep = keep & (c("target_brand_hit") | c("preferred_channel_hit"))
    if policy.exclude_competitors:
        keep = keep & ~(c("__competitor") & ~c("target_brand_hit"))
    number = lambda n, d: F.coalesce(F.nullif(pick(videos, [n]).cast("double"), F.lit(0.0)), F.lit(float(d)))
    title, keyword = F.lower(F.coalesce("title", F.lit(""))), F.lower(F.coalesce(pick(videos, ["keyword"], F.lit("")), F.lit("")))
    points = lambda test, v: F.when(test, F.lit(v)).otherwise(F.lit(0.0))
    score = (
        points(c("preferred_channel_hit"), 40.0) + points(c("target_brand_hit"), 24.0) + points(c("product_hit"), 12.0)
        + F.least(number("comment_count", 0), F.lit(5000.0)) / 120.0 + F.least(number("view_count", 0), F.lit(2000000.0)) / 200000.0
        + F.greatest(F.lit(0.0), 25.0 - F.least(number("search_rank", 9999), F.lit(25.0)))
        + points((keyword != "") & (title != "") & title.contains(keyword), 5.0)
    )
    out = out.withColumns({"is_relevant_video": keep, "video_selection_excluded": ~keep, "selection_score": score})
    return out.drop("__blob", "__channel", "__competitor", "__blocked")


def selection_order() -> list[Column]:
    return [F.col("selection_score").desc(), F.coalesce("search_rank", F.lit(999999)), F.coalesce("comment_count", F.lit(0)).desc(), F.col("video_id")]


def relevance_reason(df: DataFrame, brand_text: str = "브랜드 직접 언급") -> Column:
    """Why a video counts as relevant."""
    found = F.array_compact(
        F.array(
            F.when(F.col("target_brand_hit"), brand_text), F.when(F.col("product_hit"), "제품 키워드 일치"), F.when(F.col("preferred_channel_hit"), "우선 채널 매칭")
        )
    )
    score = F.coalesce("video_relevance_score", F.lit(0.0))
    rest = F.when(score >= 0.45, F.format_string("관련성 점수 기반(%.2f)", score)).otherwise("관련 근거 부족")
    return F.when(F.size(found) > 0, F.array_join(found, ", ")).otherwise(rest)


def reaction_type(negative: Column, positive: Column, negative_impact: Column, positive_impact: Column, negative_share: Column, positive_share: Column) -> Column:
    names = messages.REACTIONS
    return (
        F.when((negative_impact >= positive_impact + 2.0) & (negative >= F.greatest(F.lit(2), positive)), names["negative"])
        .when((positive_impact >= negative_impact + 2.0) & (positive >= F.greatest(F.lit(2), negative)), names["positive"])
        .when(negative_share >= positive_share + 0.12, names["negative"])
        .when(positive_share >= negative_share + 0.12, names["positive"])
        .otherwise(names["mixed"])
    )


#: Columns from which a video's most liked comments are described.
TOLD = ("nlp_insight_summary", "nlp_summary", "classification_reason", "opinion_text", "cleaned_text", "text_original", "text_display")


def _points(comments: DataFrame, rules: KeywordRules) -> Column:
    return point_tokens(F.coalesce(pick(comments, ["nlp_core_points"]).cast("array<string>"), F.array().cast("array<string>")), None, POINT_NOISE, POINT_ALIASES, rules)


def _tags(comments: DataFrame) -> Column:
    tags = F.coalesce(pick(comments, ["nlp_context_tags"]).cast("array<string>"), F.array().cast("array<string>"))
    return F.filter(F.transform(tags, safe_text), lambda t: t != "")


def _valid(comments: DataFrame) -> Column:
    return F.coalesce(pick(comments, ["comment_validity"], F.lit("valid")), F.lit("valid")) == "valid"


def video_signals(comments: DataFrame, keys: Sequence[str] = ("video_id",), points: int = 4, tags: int = 3, evidence: int = 3, rules: KeywordRules = DEFAULT) -> DataFrame:
    """Context of each video from its valid comments: shares, most frequent points and tags, the telling clauses
    of the most liked comments, and how many comments carry enrichment.

    The texts are read once, and not at all where a column ``salient_clause`` has the first of their salient clauses. Two aggregations over all comments, both combined before their shuffle, so a video may own any
    share of them.
    """
    c = F.col
    label = F.coalesce(pick(comments, ["sentiment_label"], F.lit("")), F.lit(""))
    told = (F.size("__points") > 0) | (safe_text(pick(comments, ["nlp_summary"], F.lit(""))) != "") | (safe_text(pick(comments, ["nlp_sentiment_reason"], F.lit(""))) != "")
    text = combined_text([pick(comments, [n], F.lit("")) for n in ("text_original", "cleaned_text", "text_display") if n in comments.columns])
    rows = comments.where(_valid(comments)).withColumns(
        {"__points": _points(comments, rules), "__tags": _tags(comments), "__likes": F.coalesce(pick(comments, ["like_count"]).cast("double"), F.lit(-1.0)), "__label": label}
    )
    # Held, since both aggregations need what only a reading of the texts and points tells.
    clause = F.array("salient_clause") if "salient_clause" in comments.columns else salient_clauses(split_clauses(text), 1)
    rows = materialize(rows.withColumn("__clause", clause).select(*keys, "comment_id", "__points", "__tags", "__likes", "__label", told.alias("__told"), "__clause"))
    shares = rows.groupBy(*keys).agg(
        F.count("*").alias("count"), F.avg((c("__label") == "negative").cast("double")).alias("negative_share"), F.avg((c("__label") == "positive").cast("double")).alias("positive_share"),
        F.avg(c("__told").cast("double")).alias("nlp_coverage"),
    )
    lists = top_lists(
        rows, keys, "comment_id",
        {"top_points": ListRule(c("__points"), points), "top_tags": ListRule(c("__tags"), tags), "evidence_clauses": ListRule(c("__clause"), evidence, c("__likes"))},
    )
    none = F.array().cast("array<string>")
    out = attach(shares, lists, keys, null_safe=True, derived=True)
    return out.withColumns({n: F.coalesce(n, none) for n in ("top_points", "top_tags", "evidence_clauses")})


def card_signals(cards: DataFrame, comments: DataFrame, rules: KeywordRules = DEFAULT) -> DataFrame:
    """Cards with the context of their video; a card whose video has no valid comment gets that of all comments."""
    own = video_signals(comments, rules=rules)
    names = [n for n in own.columns if n != "video_id"]
    every = video_signals(comments.withColumn("__all", F.lit(1)), ["__all"], rules=rules).select("__all", F.struct(*names).alias("__every"))
    out = attach(cards, own.select("video_id", F.struct(*names).alias("__own")), ["video_id"], derived=True)
    out = attach(out.withColumn("__all", F.lit(1)), every, ["__all"], derived=True)
    return out.select(*cards.columns, *[F.coalesce(F.col("__own")[n], F.col("__every")[n]).alias(n) for n in names])


def video_summary(comments: DataFrame, videos: DataFrame, rules: KeywordRules = DEFAULT) -> DataFrame:
    """Counts, densities, impacts, reaction type, what the comments name, and the moment they point to, per video.

    The most liked comments are maxima, not sorts, and only they are described. Points and tags come from one
    unpivot; words are counted only for videos whose comments carry neither.
    """
    c = F.col
    label = F.coalesce(pick(comments, ["sentiment_label"], F.lit("neutral")), F.lit("neutral"))
    likes = F.coalesce(pick(comments, ["like_count"]).cast("double"), F.lit(0.0))
    strength = F.coalesce(pick(comments, ["nlp_issue_strength_score"]).cast("double"), F.lit(0.0))
    none = F.lit(None).cast("string")
    rows = comments.withColumns({"__l": label, "__likes": likes, "__s": strength, "__ok": _valid(comments), "__points": _points(comments, rules), "__tags": _tags(comments)})
    rows = rows.withColumn("__row", F.struct(*[pick(comments, [n], none).cast("string").alias(n) for n in TOLD], c("__points").alias("points"), c("__tags").alias("tags")))
    neg, pos = c("__l") == "negative", c("__l") == "positive"
    order = F.struct("__likes", "comment_id")
    best = lambda test: F.max_by(F.when(test & c("__ok"), c("__row")), F.when(test & c("__ok"), order))
    validity = pick(comments, ["comment_validity"], F.lit("valid"))
    stats = rows.groupBy("video_id").agg(
        F.count("*").alias("comments"), count_if(pos).alias("positive_comments"), count_if(neg).alias("negative_comments"), count_if(c("__l") == "neutral").alias("neutral_comments"),
        count_if(validity == "excluded").alias("excluded_comments"), count_if(c("__ok")).alias("__valid"),
        *[F.coalesce(F.sum(F.when(t, c("__likes"))), F.lit(0.0)).alias(f"__{n}_likes") for n, t in (("neg", neg), ("pos", pos))],
        *[F.coalesce(F.avg(F.when(t, c("__s"))), F.lit(0.0)).alias(f"__{n}_strength") for n, t in (("neg", neg), ("pos", pos))],
        best(neg).alias("__negative"), best(pos).alias("__positive"), best(F.lit(True)).alias("__any"),
    )
    out = videos.dropDuplicates(["video_id"]).join(stats, "video_id", "left")
    empty = F.array().cast("array<string>")
    if {"nlp_core_points", "nlp_context_tags"} & set(comments.columns):
        lists = top_lists(rows.where("__ok"), ["video_id"], "comment_id", {"top_points": ListRule(c("__points"), 3), "top_tags": ListRule(c("__tags"), 2)})
        out = attach(out, lists, ["video_id"], derived=True).withColumns({n: F.coalesce(n, empty) for n in ("top_points", "top_tags")})
    else:
        out = out.withColumns({"top_points": empty, "top_tags": empty})
    if {"cleaned_text", "opinion_text"} & set(comments.columns):
        # Held, since the videos without points are needed ahead of the rest.
        out = _with_words(materialize(out), rows, rules)
    else:
        out = out.withColumn("__words", empty)
    impact = lambda n, k: F.round(c(k) + F.least(F.lit(20.0), c(f"__{n}_likes") / 20.0) + c(f"__{n}_strength") * 2.0, 3)
    counts = ("comments", "positive_comments", "negative_comments", "neutral_comments", "excluded_comments", "__valid")
    out = out.withColumns({n: F.coalesce(n, F.lit(0)) for n in counts})
    base = F.greatest(F.lit(1), c("positive_comments") + c("negative_comments") + c("neutral_comments"))
    said = lambda n: F.array_join(F.transform(F.array(*[c(n)[t] for t in ("text_original", "cleaned_text", "opinion_text", "text_display")]), safe_text), " ")
    out = out.withColumns({f"{n}_said": said(n) for n in ("__negative", "__positive", "__any")})
    told = lambda n: row_summary(lambda f: c(n)[f], F.slice(F.coalesce(c(n)["points"], empty), 1, 3), F.coalesce(c(n)["tags"], empty))
    out = out.withColumns(
        {
            "negative_density": c("negative_comments") / base, "positive_density": c("positive_comments") / base,
            "negative_impact": F.coalesce(impact("neg", "negative_comments"), F.lit(0.0)), "positive_impact": F.coalesce(impact("pos", "positive_comments"), F.lit(0.0)),
            "timestamp_seconds": F.coalesce(*[timestamp_seconds(c(f"{n}_said")) for n in ("__negative", "__positive", "__any")]),
            "top_negative": F.when(c("__negative").isNotNull(), told("__negative")), "top_positive": F.when(c("__positive").isNotNull(), told("__positive")),
            "__other": F.when(c("__any").isNotNull(), told("__any")),
        }
    )
    out = out.withColumns(
        {
            "reaction_type": reaction_type(c("negative_comments"), c("positive_comments"), c("negative_impact"), c("positive_impact"), c("negative_density"), c("positive_density")),
            "mention_time": timestamp_label(c("timestamp_seconds")),
            "video_link": link_at_time(pick(videos, ["video_url"], F.lit("")), c("timestamp_seconds")),
            "mention_points": _mentions(),
            "basis_labels": _basis(),
        }
    )
    return out.drop("__neg_likes", "__pos_likes", "__neg_strength", "__pos_strength", "__negative", "__positive", "__any", "__other", "__valid", "__words", "__negative_said", "__positive_said", "__any_said")


def _with_words(summary: DataFrame, rows: DataFrame, rules: KeywordRules) -> DataFrame:
    """Adds ``__words``: the most frequent keywords of videos whose comments have neither points nor tags."""
    bare = summary.where((F.size("top_points") == 0) & (F.size("top_tags") == 0) & (F.coalesce("__valid", F.lit(0)) > 0)).select("video_id")
    text = pick(rows, ["cleaned_text", "opinion_text"], F.lit(""))
    usable = lambda t: is_business_keyword(t, rules) & (F.length(t) >= 2) & ~t.rlike(r"\d") & ~t.isin(*messages.BASIS_NOISE)
    counted = attach(rows.where("__ok").select("video_id", "comment_id", text.alias("__text")), bare, ["video_id"], "inner", derived=True)
    words = top_lists(counted, ["video_id"], "comment_id", {"__words": ListRule(F.filter(tokenize(F.col("__text"), rules), usable), 3)})
    return attach(summary, words, ["video_id"], derived=True)


def _mentions() -> Column:
    """What the most liked comments say, and the points that most comments name."""
    c, part, missing = F.col, messages.MENTION_PARTS, messages.MENTION_MISSING
    text = lambda n, k: F.when(F.coalesce(c(n), F.lit("")) != "", F.concat(F.lit(part[k]), c(n)))
    both = F.array_compact(F.array(text("top_negative", "negative"), text("top_positive", "positive")))
    said = F.when(F.size(both) > 0, both).otherwise(F.array_compact(F.array(text("__other", "any"))))
    points = F.when(F.size("top_points") > 0, F.concat(F.lit(part["points"]), F.array_join(F.slice("top_points", 1, 2), ", ")))
    whole = F.array_join(F.concat(said, F.array_compact(F.array(points))), " | ")
    return F.when(c("comments") == 0, missing["none"]).when(c("__valid") == 0, missing["invalid"]).when(whole == "", missing["silent"]).otherwise(whole)


def _basis() -> Column:
    """What the comments of a video have in common: tags, else points, else frequent words."""
    c, missing = F.col, messages.BASIS_MISSING
    pointed = F.transform(F.slice("top_points", 1, 2), lambda p: F.format_string(messages.BASIS_POINT, p))
    words = F.coalesce(F.array_join("__words", ", "), F.lit(""))
    return (
        F.when(c("__valid") == 0, missing["none"]).when(F.size("top_tags") > 0, F.array_join("top_tags", ", ")).when(F.size("top_points") > 0, F.array_join(pointed, ", "))
        .when(words != "", words).otherwise(missing["silent"])
    )


def negative_context(comments: DataFrame, time: str = "published_at") -> DataFrame:
    """Per topic and product: negative share, recurrence and the trend of its last two fortnights."""
    from voxframe.functions.scores import parse_time

    c = F.col
    keys = ["topic_label", "product"]
    rows = comments.where(pick(comments, ["comment_validity"], F.lit("valid")) == "valid").withColumns(
        {"__neg": F.lower(pick(comments, ["sentiment_final", "sentiment_label"], F.lit(""))) == "negative", "__ts": parse_time(F.col(time))}
    )
    totals = rows.groupBy(*keys).agg(F.count("*").alias("comments"), count_if(c("__neg")).alias("negative_comments"), F.max(F.when(c("__neg"), c("__ts"))).alias("__end"))
    totals = totals.where(c("negative_comments") > 0)
    dated = attach(rows.where("__neg").select(*keys, "__ts"), totals.select(*keys, "__end"), keys, "inner", null_safe=True, derived=True)
    first, second = c("__end") - F.expr("INTERVAL 14 DAYS"), c("__end") - F.expr("INTERVAL 28 DAYS")
    spans = dated.groupBy(*keys).agg(count_if(c("__ts") >= first).alias("recent"), count_if((c("__ts") < first) & (c("__ts") >= second)).alias("previous"))
    out = attach(totals.drop("__end"), spans, keys, null_safe=True, derived=True)
    t = messages.NEGATIVE_TRENDS
    trend = (
        F.when(c("recent") + c("previous") == 0, t["none"]).when(c("recent") >= c("previous") + 2, t["up"])
        .when(c("previous") >= c("recent") + 2, t["down"]).otherwise(t["steady"])
    )
    return out.withColumns(
        {
            "negative_share": ratio(c("negative_comments"), c("comments"), 4), "trend": trend,
            "recurrence": F.when(c("negative_comments") >= 4, messages.RECURRENCE[0]).otherwise(messages.RECURRENCE[1]),
        }
    )


def priority_bucket(trend: Column, share_percent: Column, cluster_size: Column, inquiry: Column) -> Column:
    now, watch, monitor = messages.PRIORITY_BUCKETS
    return (
        F.when((trend == messages.NEGATIVE_TRENDS["up"]) | (share_percent >= 3.0) | (cluster_size >= 20), now)
        .when(inquiry | (share_percent >= 1.5) | (cluster_size >= 8), watch)
        .otherwise(monitor)
    )
