"""Weekly sentiment and keyword trends, and keywords that are new or keep coming back."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxframe.functions import keywords as kw
from voxframe.functions.scores import parse_time, week_start
from voxframe.operators.relational import attach, share_of_group, top_per_group, unnest
from voxframe.session import materialize

WEEK_SUFFIX = "주차"


def week_labels(df: DataFrame, week: str = "week_start", label: str = "week_label", suffix: str = WEEK_SUFFIX) -> DataFrame:
    """Number the weeks that occur. Only the distinct weeks pass through the ordered window."""
    weeks = df.select(week).where(F.col(week).isNotNull()).distinct()
    ranked = weeks.withColumn(label, F.concat(F.dense_rank().over(Window.orderBy(week)).cast("string"), F.lit(suffix)))
    return attach(df, ranked, [week], derived=True)


def weekly_sentiment(df: DataFrame, time: str = "published_at", label: str = "sentiment_label") -> DataFrame:
    """Count and share of each label per week, product and region."""
    rows = df.select(week_start(parse_time(F.col(time))).alias("week_start"), "product", "region", F.col(label).alias("sentiment_label"))
    rows = rows.where(F.col("week_start").isNotNull() & F.col("sentiment_label").isNotNull())
    counts = rows.groupBy("week_start", "product", "region", "sentiment_label").agg(F.count("*").alias("count"))
    shares = share_of_group(counts, "count", ["week_start", "product", "region"], "ratio")
    return week_labels(shares)


def weekly_keywords(
    df: DataFrame,
    text: str = "cleaned_text",
    time: str = "published_at",
    top_n: int = 10,
    rules: kw.KeywordRules = kw.DEFAULT,
    tokens: Column | None = None,
) -> DataFrame:
    """Most frequent business keywords per week, product, region and label.

    Raw tokens are counted first, so normalization runs once per distinct token of a group.
    """
    keys = ["week_start", "product", "region", "sentiment_label"]
    raw = kw.raw_tokens(F.col(text)) if tokens is None else tokens
    dated = df.withColumn("week_start", week_start(parse_time(F.col(time))))
    dated = dated.where(F.col("week_start").isNotNull() & F.col("sentiment_label").isNotNull())
    rows = unnest(dated, raw, "__token", *keys)
    counted = rows.groupBy(*keys, "__token").agg(F.count("*").alias("__n"))
    return week_labels(_top_keywords(counted, keys, top_n, rules))


def _top_keywords(counted: DataFrame, keys: Sequence[str], top_n: int, rules: kw.KeywordRules) -> DataFrame:
    # Each different token is normalized once, whatever the number of groups it occurs in. Through a generator, so
    # that the filter below cannot repeat the normalization for each of its tests.
    counted = materialize(counted) if keys else counted
    tokens = counted.select("__token").distinct() if keys else counted
    named = unnest(tokens, F.array(kw.normalize_keyword(F.col("__token"), rules)), "keyword", "__token", *([] if keys else ["__n"]))
    kept = named.where((F.col("keyword") != "") & kw.is_business_keyword(F.col("keyword"), rules))
    kept = counted.join(kept, "__token") if keys else kept
    totals = kept.groupBy(*keys, "keyword").agg(F.sum("__n").alias("count"))
    if not keys:
        return totals.orderBy(F.col("count").desc(), "keyword").limit(top_n)
    return top_per_group(totals, keys, [F.col("count").desc(), F.col("keyword")], top_n)


def top_keywords(df: DataFrame, text: str = "cleaned_text", top_n: int = 30, rules: kw.KeywordRules = kw.DEFAULT) -> DataFrame:
    """Most frequent business keywords of the whole frame."""
    rows = unnest(df, kw.raw_tokens(F.col(text)), "__token")
    return _top_keywords(rows.groupBy("__token").agg(F.count("*").alias("__n")), [], top_n, rules)


def issue_keywords(trend: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Negative keywords of the latest week: those never seen before, and those active in two weeks or more."""
    keys = ["product", "region", "keyword"]
    negative = trend.where(F.col("sentiment_label") == "negative")
    latest = negative.agg(F.max("week_start")).scalar()
    per_key = negative.groupBy(*keys).agg(
        F.sum(F.when(F.col("week_start") == latest, F.col("count"))).alias("count"),
        F.countDistinct("week_start").alias("weeks_active"),
        F.min("week_start").alias("__first"),
    )
    # One pass: a key is new if its first week is the latest one.
    current = per_key.where(F.col("count").isNotNull()).withColumn("latest_week", latest)
    new = current.where(F.col("__first") == F.col("latest_week")).select(*keys, "latest_week", "count")
    persistent = current.where(F.col("weeks_active") >= 2).select(*keys, "latest_week", "count", "weeks_active")
    return new, persistent


def weekly_window(df: DataFrame, weeks_per_view: int, page: int = 1, week: str = "week_start", labels: Sequence[str] = ("positive", "negative")) -> DataFrame:
    """One page of weeks with a row for every week and label, zero where nothing was said.

    Page 1 holds the latest weeks; pages outside the range are clamped.
    """
    counts = df.where(F.col(week).isNotNull()).groupBy(week, "sentiment_label").agg(F.count("*").alias("__n"))
    per_week = counts.groupBy(week).agg(
        F.sum("__n").alias("__total"), F.map_from_entries(F.collect_list(F.struct(F.coalesce("sentiment_label", F.lit("")), "__n"))).alias("__by")
    )
    ranked = per_week.withColumns(
        {"__pos": F.row_number().over(Window.orderBy(F.col(week).desc())), "__weeks": F.count("*").over(Window.partitionBy())}
    )
    pages = F.greatest(F.lit(1), F.ceil(F.col("__weeks") / F.lit(weeks_per_view)))
    shown = F.least(F.greatest(F.lit(page), F.lit(1)), pages)
    on_page = F.ceil(F.col("__pos") / F.lit(weeks_per_view)) == shown
    rows = ranked.where(on_page).select(
        week, "__total", "__by", pages.cast("int").alias("total_pages"), F.explode(F.array(*[F.lit(x) for x in labels])).alias("sentiment_label")
    )
    n = F.coalesce(F.try_element_at("__by", F.col("sentiment_label")), F.lit(0))
    return rows.select(week, "sentiment_label", n.alias("count"), F.round(n / F.col("__total"), 4).alias("ratio"), "total_pages")


def recent_change(df: DataFrame, keys: Sequence[str], time: str = "published_at", days: int = 30) -> DataFrame:
    """Rows of each key in the last ``days`` before its newest row and in the same span before that, and the direction.

    One aggregation finds the newest row of each key, a second counts both spans.
    """
    c = F.col
    dated = df.where(c(time).isNotNull()).select(*keys, c(time).alias("__time"))
    latest = dated.groupBy(*keys).agg(F.max("__time").alias("__latest"))
    span = F.expr(f"INTERVAL '{days}' DAY")
    rows = attach(dated, latest, list(keys), "inner", null_safe=True, derived=True)
    recent = c("__time") >= c("__latest") - span
    counts = rows.groupBy(*keys).agg(F.count_if(recent).alias("recent"), F.count_if(~recent & (c("__time") >= c("__latest") - span - span)).alias("previous"))
    change = F.when(c("recent") > c("previous"), "up").when(c("recent") < c("previous"), "down").otherwise("same")
    return counts.withColumn("direction", change)


def issue_frame(df: DataFrame, products: Sequence[str] = (), regions: Sequence[str] = (), rules: kw.KeywordRules = kw.DEFAULT) -> DataFrame:
    """Issue keywords normalized again, without those that vanish, within the chosen products and regions."""
    words = unnest(df.select(F.col("keyword").alias("__raw")).distinct(), F.array(kw.normalize_keyword(F.col("__raw"), rules)), "__keyword", "__raw").where(F.col("__keyword") != "")
    named = df.join(words, df["keyword"] == words["__raw"]).withColumn("keyword", F.col("__keyword")).drop("__raw", "__keyword")
    named = named.where(F.col("product").isin(*products)) if products else named
    return named.where(F.col("region").isin(*regions)) if regions else named
