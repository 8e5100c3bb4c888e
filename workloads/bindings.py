"""How the driver tables act as videos, comments and labels, in Spark and in SQL."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxframe.session import spread


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


SENTIMENT_OF_EVENT = {"error": "negative", "purchase": "positive", "signup": "positive", "view": "neutral", "click": "mixed"}

EV = """ev AS (
  SELECT CAST(event_id AS VARCHAR) AS comment_id, 'v' || CAST(user_id AS VARCHAR) AS video_id,
         'p' || CAST(user_id % 4 AS VARCHAR) AS product, 'r' || CAST(user_id % 2 AS VARCHAR) AS region,
         'b' || CAST(user_id % 5 AS VARCHAR) AS brand_label, ts AS published_at, event_type,
         CASE event_type WHEN 'error' THEN 'negative' WHEN 'purchase' THEN 'positive' WHEN 'signup' THEN 'positive'
              WHEN 'view' THEN 'neutral' ELSE 'mixed' END AS sentiment_label,
         CAST(floor(value) AS BIGINT) AS like_count, event_id % 3 AS reply_count,
         CASE WHEN event_id % 11 = 0 THEN 'excluded' ELSE 'valid' END AS comment_validity,
         CASE WHEN event_id % 11 <> 0 THEN NULL WHEN event_id % 2 = 0 THEN 'ad' ELSE 'low_context' END AS exclusion_reason,
         'k' || json_extract_string(props, '$.k') AS keyword, event_id, user_id, value
  FROM events)"""


def labelled_events(spark: SparkSession, sf: str) -> DataFrame:
    """Events as labelled comments: one of four products, two regions and five brands each."""
    e = table(spark, sf, "events")
    sentiment = F.create_map(*[F.lit(x) for pair in SENTIMENT_OF_EVENT.items() for x in pair])
    excluded = F.col("event_id") % 11 == 0
    return e.select(
        F.col("event_id").cast("string").alias("comment_id"),
        F.concat(F.lit("v"), F.col("user_id").cast("string")).alias("video_id"),
        F.concat(F.lit("p"), (F.col("user_id") % 4).cast("string")).alias("product"),
        F.concat(F.lit("r"), (F.col("user_id") % 2).cast("string")).alias("region"),
        F.concat(F.lit("b"), (F.col("user_id") % 5).cast("string")).alias("brand_label"),
        F.col("ts").alias("published_at"),
        "event_type",
        sentiment[F.col("event_type")].alias("sentiment_label"),
        F.floor("value").alias("like_count"),
        (F.col("event_id") % 3).alias("reply_count"),
        F.when(excluded, "excluded").otherwise("valid").alias("comment_validity"),
        F.when(excluded, F.when(F.col("event_id") % 2 == 0, "ad").otherwise("low_context")).alias("exclusion_reason"),
        F.concat(F.lit("k"), F.get_json_object("props", "$.k")).alias("keyword"),
        "event_id",
        "user_id",
        "value",
    )


DOCS = """docs AS (
  SELECT CAST(d.doc_id AS VARCHAR) AS comment_id, d.source AS video_id, d.lang AS product,
         'R' || CAST(d.doc_id % 3 AS VARCHAR) AS region, d.text AS text, d.doc_id AS doc_id,
         CAST(floor(e.value) AS BIGINT) AS like_count, d.doc_id % 4 AS reply_count, e.ts AS published_at,
         l.quality AS quality, l.toxic AS toxic,
         CASE WHEN l.toxic = 1 THEN 'negative' WHEN l.quality = 1 THEN 'positive' WHEN l.quality = 0 THEN 'mixed'
              ELSE 'neutral' END AS sentiment_label
  FROM documents d LEFT JOIN events e ON e.event_id = d.doc_id LEFT JOIN labels l ON l.doc_id = d.doc_id)"""


def comments(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as comments, with time and likes from the event and the label of the same id."""
    d, e, l = table(spark, sf, "documents"), table(spark, sf, "events"), table(spark, sf, "labels")
    joined = (
        spread(d.select("doc_id", "source", "lang", "text"))
        .join(e.select(F.col("event_id").alias("doc_id"), "value", "ts"), "doc_id", "left")
        .join(l, "doc_id", "left")
    )
    return joined.select(
        F.col("doc_id").cast("string").alias("comment_id"),
        F.col("source").alias("video_id"),
        F.col("lang").alias("product"),
        F.concat(F.lit("R"), (F.col("doc_id") % 3).cast("string")).alias("region"),
        "text",
        "doc_id",
        F.floor("value").alias("like_count"),
        (F.col("doc_id") % 4).alias("reply_count"),
        F.col("ts").alias("published_at"),
        "quality",
        "toxic",
        F.when(F.col("toxic") == 1, "negative")
        .when(F.col("quality") == 1, "positive")
        .when(F.col("quality") == 0, "mixed")
        .otherwise("neutral")
        .alias("sentiment_label"),
    )


VIDEOS = """videos AS (
  SELECT 'v' || CAST(c_custkey AS VARCHAR) AS video_id, c_name AS title, c_mktsegment AS channel_title,
         n_name AS keyword, r_name AS region, 'p' || CAST(c_custkey % 4 AS VARCHAR) AS product,
         CAST(floor(c_acctbal) AS BIGINT) AS view_count, c_custkey % 700 AS comment_count, c_custkey AS search_rank,
         'https://example.com/watch?v=' || CAST(c_custkey AS VARCHAR) AS video_url
  FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey)"""


def videos(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as videos: segment as channel, nation as keyword."""
    c, n, r = (table(spark, sf, t) for t in ("customer", "nation", "region"))
    joined = c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    key = F.col("c_custkey")
    return joined.select(
        F.concat(F.lit("v"), key.cast("string")).alias("video_id"),
        F.col("c_name").alias("title"),
        F.col("c_mktsegment").alias("channel_title"),
        F.col("n_name").alias("keyword"),
        F.col("r_name").alias("region"),
        F.concat(F.lit("p"), (key % 4).cast("string")).alias("product"),
        F.floor("c_acctbal").alias("view_count"),
        (key % 700).alias("comment_count"),
        key.alias("search_rank"),
        F.concat(F.lit("https://example.com/watch?v="), key.cast("string")).alias("video_url"),
    )


# SQL pieces ------------------------------------------------------------------------------------

def sql_list(values: Iterable[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def sql_any(text: str, markers: Iterable[str]) -> str:
    """SQL test: the text holds one of the markers."""
    return "(" + " OR ".join(f"contains({text}, '{m}')" for m in markers) + ")"


def sql_hits(text: str, markers: Iterable[str]) -> str:
    """SQL count of different markers in the text."""
    return "(" + " + ".join(f"CAST(contains({text}, '{m}') AS INTEGER)" for m in markers) + ")"


def sql_argmax(scores: dict[str, str], default: str, floor: float = 1) -> str:
    """SQL label of the first top score of at least ``floor``."""
    best = "greatest(" + ", ".join(scores.values()) + ")"
    whens = " ".join(f"WHEN {expr} = {best} THEN '{label}'" for label, expr in scores.items())
    return f"CASE WHEN {best} < {floor} THEN {default} {whens} END"


def with_sql(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"
