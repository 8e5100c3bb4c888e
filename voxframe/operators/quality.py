"""Checks on the tables of a run: leaks, representative quality, clusters, taxonomy, repetition and verdicts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxframe.functions.scores import ratio
from voxframe.functions.text import safe_text
from voxframe.operators.descriptive import count_if
from voxframe.operators.relational import attach, share_of_all, union_all, unnest

# Patterns of the checks.
NOISE = ("affiliate", "sponsored", "promo code", "discount code", "joint purchase", "investment", "stock", "subscribe event")
MEANINGLESS_TOKENS = (r"^\d+$", r"^\d+pcs$", r"^[khyu]+$")
NON_CUSTOMER = ("don't even have", "just good content", "watching for fun", "not using this product")


TEMPLATE_HEADER, TEMPLATE_TITLE, TEMPLATE_BROKEN = r"^Top\d+ \S+ 단계 \S+ 코멘트", "영상제목: ", "???"


def is_noise(text: Column, patterns: Sequence[str] = NOISE) -> Column:
    return F.lower(safe_text(text)).rlike("|".join(patterns))


def noise_leaks(representatives: DataFrame, inquiries: DataFrame, keywords: DataFrame, strategy: DataFrame, truth: DataFrame,
                text: str = "text_display", noise: Sequence[str] = NOISE) -> DataFrame:
    """How much noise reached representatives, inquiries, keywords and strategy rows."""
    refs = unnest(strategy, F.col("supporting_representatives"), "comment_id", "level_id")
    trash = attach(refs, truth.where(F.lower("hygiene_class") == "trash").select("comment_id").distinct(), ["comment_id"], "left_semi", derived=True)
    row = representatives.agg(count_if(is_noise(F.col(text), noise)).alias("representative_noise")).select(
        "representative_noise",
        inquiries.agg(count_if(is_noise(F.col("text"), noise))).scalar().alias("inquiry_noise"),
        keywords.agg(count_if(F.lower(F.trim("keyword")).rlike("|".join(MEANINGLESS_TOKENS)))).scalar().alias("keyword_noise"),
        trash.agg(F.count("*")).scalar().alias("strategy_noise"),
    )
    leaks = F.col("representative_noise") + F.col("inquiry_noise") + F.col("strategy_noise")
    return row.withColumn("status", F.when(leaks == 0, "PASS").otherwise("PARTIAL"))


def representative_quality(df: DataFrame, text: str = "text_display", noise: Sequence[str] = NOISE, voices: Sequence[str] = NON_CUSTOMER, shortest: int = 35) -> DataFrame:
    """Counts of noisy, short, unplaced, foreign and repeated representatives."""
    value = safe_text(F.col(text))
    rows = df.select(
        value.alias("__t"), is_noise(value, noise).alias("__noise"), (F.length(value) < shortest).alias("__short"),
        (F.coalesce("journey_stage", F.lit("")) == "").alias("__stage"), (F.coalesce(F.size("judgment_axes"), F.lit(0)) == 0).alias("__axes"),
        F.lower(value).rlike("|".join(voices)).alias("__voice"),
    )
    bad = F.col("__noise") | F.col("__short") | F.col("__stage") | F.col("__axes") | F.col("__voice")
    total = rows.agg(
        F.count("*").alias("representatives"), count_if(F.col("__noise")).alias("noise"), count_if(F.col("__short")).alias("short"),
        count_if(F.col("__stage")).alias("no_stage"), count_if(F.col("__axes")).alias("no_axes"), count_if(F.col("__voice")).alias("non_customer_voice"),
        count_if(bad).alias("problematic"), (F.count("*") - F.countDistinct("__t")).alias("duplicate_texts"),
    )
    return total.withColumn("status", F.when((F.col("problematic") == 0) & (F.col("duplicate_texts") == 0), "PASS").otherwise("PARTIAL"))


def cluster_integrity(links: DataFrame, classes: DataFrame, representatives: DataFrame, pool_size: Column, share: float = 0.08, floor: int = 800) -> DataFrame:
    """Per cluster of ``similar.similar_links``: same stage and direction, shared tokens, stated size equals rows, and not over-broad."""
    c = F.col
    facts = lambda df, p: df.select(c("class_id").alias(f"{p}_id"), c("journey").alias(f"{p}_stage"), c("direction").alias(f"{p}_dir"), c("tokens").alias(f"{p}_tokens"), c("members").alias(f"{p}_members"))
    rows = attach(links.select(c("class_id").alias("c_id"), c("rep_class").alias("r_id"), "cluster_size"), facts(classes, "c"), ["c_id"], "inner", derived=True)
    rows = attach(rows, facts(representatives, "r").drop("r_members"), ["r_id"], "inner", derived=True)
    out = rows.groupBy("r_id").agg(
        F.sum("c_members").alias("rows"), F.max("cluster_size").alias("cluster_size"),
        F.bool_and(c("c_stage") == c("r_stage")).alias("same_journey"), F.bool_and(c("c_dir") == c("r_dir")).alias("same_direction"),
        F.bool_and(F.arrays_overlap("c_tokens", "r_tokens")).alias("shared_tokens"),
    )
    limit = F.greatest(F.floor(pool_size * share), F.lit(floor))
    return out.withColumns({"counts_match": c("rows") == c("cluster_size"), "over_broad": c("cluster_size") >= limit}).withColumnRenamed("r_id", "rep_class")


def prefix_repetition(df: DataFrame, text: str, size: int, limit: float) -> DataFrame:
    """Share of distinct texts, the largest share of one prefix, and whether it is below the limit."""
    prefixes = df.groupBy(F.substring(text, 1, size).alias("p")).agg(F.count("*").alias("n"))
    row = prefixes.agg(F.max("n").alias("__max"), F.sum("n").alias("texts")).withColumn("distinct_texts", df.agg(F.countDistinct(text)).scalar())
    row = row.withColumns(
        {"distinct_ratio": ratio(F.col("distinct_texts"), F.col("texts"), 4), "max_prefix_ratio": ratio(F.col("__max"), F.col("texts"), 4)}
    )
    return row.withColumn("status", F.when(F.col("max_prefix_ratio") < limit, "PASS").otherwise("PARTIAL")).drop("__max")


def axis_balance(comments: DataFrame, limit: float = 0.75) -> DataFrame:
    """Share of every axis and whether the most frequent one stays below the limit."""
    counts = unnest(comments, F.col("judgment_axes"), "judgment_axis").groupBy("judgment_axis").agg(F.count("*").alias("count"))
    shares = share_of_all(counts, "count", "share")
    return shares.withColumn("dominant", F.col("share") >= limit)


def strategy_checks(strategy: DataFrame, representatives: DataFrame, text: str = "text_display") -> DataFrame:
    """Insights from single comments and summaries that only repeat a representative."""
    c = F.col
    refs = unnest(strategy, c("supporting_representatives"), "comment_id", "level_id", "insight_summary")
    texts = representatives.select("comment_id", safe_text(c(text)).alias("__t"))
    pairs = attach(refs, texts, ["comment_id"], "inner", derived=True).where(c("__t") != "")
    reworded = c("insight_summary").contains(c("__t")) | c("__t").contains(c("insight_summary"))
    return strategy.agg(F.count("*").alias("insights"), count_if(c("supporting_cluster_count") < 2).alias("single_comment")).select(
        "*", pairs.agg(count_if(reworded)).scalar().alias("reworded")
    )


def level_consistency(strategy: DataFrame) -> DataFrame:
    """Per product group: videos with insights and how many different stage sets they show."""
    per_video = strategy.where("level_type = 'video'").groupBy("product_group", "level_id").agg(F.array_sort(F.collect_set("journey_stage")).alias("__stages"))
    return per_video.groupBy("product_group").agg(F.count("*").alias("videos"), F.countDistinct("__stages").alias("stage_sets"))


def traceability(strategy: DataFrame) -> DataFrame:
    """Insights that name at least one representative."""
    row = strategy.agg(count_if(F.size("supporting_representatives") > 0).alias("traced"), F.count("*").alias("insights"))
    return row.withColumn("status", F.when(F.col("traced") >= 2, "PASS").otherwise("FAIL"))


def verdict(sections: DataFrame) -> DataFrame:
    """PASS if all sections pass, FAIL if one fails, else PARTIAL; with the sections at risk."""
    row = sections.agg(
        F.bool_and(F.col("status") == "PASS").alias("__all"), F.bool_or(F.col("status") == "FAIL").alias("__any"),
        F.array_sort(F.collect_set(F.when(F.col("status") != "PASS", F.col("section")))).alias("risks"),
    )
    return row.select(F.when(F.col("__all"), "PASS").when(F.col("__any"), "FAIL").otherwise("PARTIAL").alias("verdict"), "risks")


def metric_rates(df: DataFrame, metrics: Mapping[str, tuple[Column, Column]], by: Sequence[str] = ()) -> DataFrame:
    """Rate of each metric (hits, base) over the frame or per segment, in one aggregation."""
    sums = [x for n, (hit, base) in metrics.items() for x in (count_if(hit & base).alias(f"__h_{n}"), count_if(base).alias(f"__b_{n}"))]
    grouped = df.groupBy(*by).agg(*sums) if by else df.agg(*sums)
    return grouped.select(*by, *[ratio(F.col(f"__h_{n}"), F.col(f"__b_{n}"), 4).alias(n) for n in metrics])


@dataclass(frozen=True)
class Metric:
    """A rate over the rows of one grain: rows that ``hit`` among those that ``base`` counts.

    With ``by`` there is one rate for each value of that column, within its own rows or, if ``of_all``, of all rows
    that ``base`` counts.
    """

    name: str
    grain: str
    hit: Column
    base: Column | None = None
    by: str | None = None
    of_all: bool = False


def documented_metrics(noise_terms: Sequence[str], top: int = 20, longest: int = 600) -> list[Metric]:
    """The documented rates of a run.

    Grains and their columns: ``comments`` (comment_validity, exclusion_reason); ``slots``, one row for each video
    and label (label, count, rep_id, rep_label, rep_text, promo_flag, counts_fingerprint, rep_fingerprint,
    keyword_count); ``keywords`` of slots (label, source_label, keyword, rank); ``events`` of the audit log (event,
    reason_code, field_name, action, displayed, matched_count, unrelated, gibberish).
    """
    c = F.col
    shown = c("rep_id").isNotNull()
    differs = shown & ~c("rep_label").eqNullSafe(c("label"))
    garbled = c("reason_code").eqNullSafe("GARBLED_TEXT_DETECTED")
    rendering, matching = c("event") == "RENDERING_GUARDRAIL", c("event") == "SIMILARITY_MATCHING"
    compliant = c("rep_text").rlike(TEMPLATE_HEADER) & c("rep_text").contains(TEMPLATE_TITLE) & ~c("rep_text").contains(TEMPLATE_BROKEN)
    return [
        Metric("invariant_violation", "slots", shown & ((c("count") == 0) | differs)),
        Metric("label_mismatch", "slots", differs, shown),
        Metric("promo_leakage", "slots", c("promo_flag"), shown),
        Metric("fingerprint_mismatch", "slots", ~c("counts_fingerprint").eqNullSafe(c("rep_fingerprint")), shown),
        Metric("keyword_missing", "slots", c("keyword_count") == 0, c("count") > 0),
        Metric("template_compliance", "slots", compliant, shown),
        Metric("boilerplate", "slots", F.length("rep_text") > longest, shown),
        Metric("keyword_noise", "keywords", c("keyword").isin(*noise_terms), c("rank") <= top),
        Metric("label_purity", "keywords", c("source_label").eqNullSafe(c("label"))),
        Metric("garbled_output", "events", garbled, rendering),
        Metric("garbled_leakage", "events", c("displayed"), garbled),
        Metric("replaced_by_field", "events", c("action").eqNullSafe("REPLACE_NA"), rendering, by="field_name"),
        Metric("similarity_pass", "events", (c("matched_count") > 0) & c("reason_code").isNull(), matching),
        Metric("unrelated_match", "events", c("matched_count") > 0, matching & c("unrelated")),
        Metric("gibberish_eligible", "events", c("gibberish"), matching),
        Metric("cache_stale", "events", c("reason_code").eqNullSafe("CACHE_STALE"), c("event") == "CACHE_READ"),
        Metric("sanitized_by_action", "events", F.lit(True), c("event") == "SANITIZATION", by="action", of_all=True),
        Metric("excluded", "comments", c("comment_validity") == "excluded"),
        Metric("excluded_by_reason", "comments", c("comment_validity") == "excluded", by="exclusion_reason", of_all=True),
    ]


def documented_rates(tables: Mapping[str, DataFrame], metrics: Sequence[Metric], digits: int = 6) -> DataFrame:
    """``metric, segment, hits, base, rate``: all metrics of a grain and segment column in one aggregation.

    Segments without a hit and a null segment have no row; a base of zero gives a null rate.
    """
    c, out = F.col, []
    for grain, by in dict.fromkeys((m.grain, m.by) for m in metrics):
        own = [m for m in metrics if (m.grain, m.by) == (grain, by)]
        sums = [F.struct(count_if(F.coalesce(m.hit, F.lit(False)) & _base(m)).alias("hits"), count_if(_base(m)).alias("base")).alias(m.name) for m in own]
        grouped = tables[grain].groupBy(F.col(by).alias("segment")).agg(*sums) if by else tables[grain].agg(*sums).withColumn("segment", F.lit(""))
        entries = F.array(*[F.struct(F.lit(m.name).alias("metric"), F.lit(m.of_all).alias("of_all"), c(m.name)["hits"].alias("hits"), c(m.name)["base"].alias("base")) for m in own])
        rows = grouped.select("segment", F.explode(entries).alias("m")).select("m.metric", "segment", "m.of_all", "m.hits", "m.base")
        if by:
            totals = rows.groupBy("metric").agg(F.sum("base").alias("__total"))
            rows = attach(rows, totals, ["metric"], derived=True).withColumn("base", F.when(c("of_all"), c("__total")).otherwise(c("base"))).where(c("segment").isNotNull() & (c("hits") > 0))
        out.append(rows.select("metric", "segment", "hits", "base"))
    return union_all(out).withColumn("rate", F.round(c("hits") / F.when(c("base") > 0, c("base")), digits))


def _base(metric: Metric) -> Column:
    return F.lit(True) if metric.base is None else F.coalesce(metric.base, F.lit(False))


def table_audit(found: DataFrame, expected: DataFrame) -> DataFrame:
    """What a catalogue (``readers.catalogue``) holds of ``expected(table, columns, min_rows)``, and the status of each.

    Status: ``missing``; ``columns`` if an expected one is absent; ``rows`` if there are fewer than expected; ``ok``.
    Tables that nobody expects are ``extra``.
    """
    c = F.col
    both = expected.select("table", c("columns").alias("__wanted"), "min_rows").join(found, "table", "full")
    absent = F.array_except("__wanted", F.coalesce("columns", F.array().cast("array<string>")))
    status = (
        F.when(c("__wanted").isNull(), "extra").when(~F.coalesce("present", F.lit(False)), "missing").when(F.size(absent) > 0, "columns")
        .when(c("rows") < c("min_rows"), "rows").otherwise("ok")
    )
    return both.select(
        "table", F.coalesce("rows", F.lit(0)).alias("rows"), F.coalesce("files", F.lit(0)).alias("files"), F.coalesce("bytes", F.lit(0)).alias("bytes"),
        F.when(c("__wanted").isNull(), F.array().cast("array<string>")).otherwise(F.array_sort(absent)).alias("absent"), status.alias("status"),
    )
