"""Weekly trends, pages of weeks, and issue keywords."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxframe.functions import keywords as kw
from voxframe.functions.scores import parse_time, week_start
from voxframe.operators import keyword_summary as ks
from voxframe.operators import trends as t
from workloads.bindings import DOCS, EV, comments, labelled_events, with_sql
from workloads.registry import query

#: The fixture is written in Latin script, so single Latin words must be allowed to count as keywords.
LATIN = kw.KeywordRules(
    stopwords=("the", "of", "and", "to", "in", "is", "that", "de", "la"),
    translations={"with": "for", "les": "le"},
    aliases={"this": "that"},
    keep=("are", "from"),
    products=("ing",),
    noise_suffixes=("ouon",),
    verb_suffixes=("ention",),
    particles=("er", "nd"),
    drop_latin=False,
)


@query("weekly_sentiment_trend", with_sql(EV) + """
SELECT week_start, CAST(dense_rank() OVER (ORDER BY week_start) AS VARCHAR) || '주차' AS week_label, product, region, sentiment_label, count,
       round(count / sum(count) OVER (PARTITION BY week_start, product, region), 4) AS ratio
FROM (SELECT strftime(date_trunc('week', published_at), '%Y-%m-%d') AS week_start, product, region, sentiment_label, count(*) AS count
      FROM ev GROUP BY 1, 2, 3, 4)""")
def weekly_sentiment_trend(spark, sf):
    return t.weekly_sentiment(labelled_events(spark, sf))


@query("weekly_sentiment_window", with_sql(EV) + """,
w AS (SELECT strftime(date_trunc('week', published_at), '%Y-%m-%d') AS week_start, sentiment_label FROM ev),
weeks AS (SELECT week_start, count(*) AS total, row_number() OVER (ORDER BY week_start DESC) AS pos, count(*) OVER () AS n FROM w GROUP BY 1)
SELECT week_start, s AS sentiment_label, count(w.sentiment_label) AS count, round(count(w.sentiment_label) / total, 4) AS ratio,
       CAST(ceil(n / 2) AS INTEGER) AS total_pages
FROM weeks CROSS JOIN (SELECT unnest(['positive', 'negative']) AS s) LEFT JOIN w ON w.week_start = weeks.week_start AND w.sentiment_label = s
WHERE pos BETWEEN 3 AND 4 GROUP BY weeks.week_start, s, total, n""".replace("SELECT week_start, s AS", "SELECT weeks.week_start AS week_start, s AS"))
def weekly_sentiment_window(spark, sf):
    e = labelled_events(spark, sf).withColumn("week_start", week_start(parse_time(F.col("published_at"))))
    return t.weekly_window(e, weeks_per_view=2, page=2)


KEY_TREND = """trend AS (
  SELECT strftime(date_trunc('week', published_at), '%Y-%m-%d') AS week_start, product, CASE WHEN user_id % 2 = 0 THEN region END AS region,
         sentiment_label, CASE WHEN event_id % 2 = 0 THEN keyword ELSE 'u' || CAST(user_id AS VARCHAR) END AS keyword, count(*) AS count FROM ev GROUP BY ALL),
neg AS (SELECT * FROM trend WHERE sentiment_label = 'negative'),
latest AS (SELECT max(week_start) AS lw FROM neg),
keys AS (SELECT product, region, keyword, sum(count) FILTER (week_start = lw) AS c, count(DISTINCT week_start) AS weeks_active,
                count(*) FILTER (week_start < lw) AS prior, any_value(lw) AS latest_week FROM neg, latest GROUP BY 1, 2, 3)"""


def _key_trend(spark, sf):
    e = labelled_events(spark, sf).withColumn("region", F.when(F.col("user_id") % 2 == 0, F.col("region")))
    # Half of the events are about their user, so that some keywords turn up in the last week only.
    e = e.withColumn("keyword", F.when(F.col("event_id") % 2 == 0, F.col("keyword")).otherwise(F.concat(F.lit("u"), F.col("user_id").cast("string"))))
    week = week_start(parse_time(F.col("published_at"))).alias("week_start")
    return e.groupBy(week, "product", "region", "sentiment_label", "keyword").agg(F.count("*").alias("count"))


@query("new_issue_keywords", with_sql(EV, KEY_TREND) + """
SELECT product, region, keyword, latest_week, CAST(c AS BIGINT) AS count FROM keys WHERE c IS NOT NULL AND prior = 0""")
def new_issue_keywords(spark, sf):
    return t.issue_keywords(_key_trend(spark, sf))[0]


@query("persistent_issue_keywords", with_sql(EV, KEY_TREND) + """
SELECT product, region, keyword, latest_week, CAST(c AS BIGINT) AS count, weeks_active FROM keys WHERE c IS NOT NULL AND weeks_active >= 2""")
def persistent_issue_keywords(spark, sf):
    return t.issue_keywords(_key_trend(spark, sf))[1]


def _norm_sql(tok: str) -> str:
    """SQL twin of keyword normalization under the fixture rules (two particle rounds suffice to check)."""
    return f"""CASE {tok} WHEN 'with' THEN 'for' WHEN 'les' THEN 'le' WHEN 'this' THEN 'that' ELSE {tok} END"""


STOPS = "('the','of','and','to','in','is','that','de','la')"
TOKENS = f"""toks AS (
  SELECT comment_id, product, region, sentiment_label, published_at, lower(trim(t, '-''')) AS raw
  FROM (SELECT *, unnest(regexp_extract_all(text, '[A-Za-z][A-Za-z''-]+|[0-9A-Za-z가-힣+/]+')) AS t FROM docs)),
s1 AS (SELECT *, {_norm_sql('raw')} AS a FROM toks),
s2 AS (SELECT * FROM s1 WHERE a NOT IN {STOPS} AND NOT regexp_full_match(a, '[0-9]+') AND NOT a LIKE '%ouon'
       AND NOT (a LIKE '%ention' AND a NOT IN ('are', 'from'))),
s3 AS (SELECT *, regexp_replace(a, '^(.{{2,}})(?:er|nd)$', '\\1') AS b1 FROM s2),
s4 AS (SELECT *, regexp_replace(b1, '^(.{{2,}})(?:er|nd)$', '\\1') AS b2 FROM s3),
s5 AS (SELECT *, regexp_replace(b2, '^(.{{2,}})(?:er|nd)$', '\\1') AS b3 FROM s4),
s6 AS (SELECT *, regexp_replace(b3, '^(.{{2,}})(?:er|nd)$', '\\1') AS b4 FROM s5),
s7 AS (SELECT *, regexp_replace(b4, '^(.{{2,}})(?:er|nd)$', '\\1') AS b5 FROM s6),
s8 AS (SELECT *, regexp_replace(b5, '^(.{{2,}})(?:er|nd)$', '\\1') AS b6 FROM s7),
s9 AS (SELECT *, CASE b6 WHEN 'this' THEN 'that' ELSE b6 END AS keyword FROM s8),
kws AS (SELECT * FROM s9 WHERE NOT (keyword <> a AND keyword IN {STOPS}) AND length(keyword) >= 2
        AND NOT regexp_matches(keyword, '[^a-z0-9가-힣+/]')),
biz AS (SELECT * FROM kws WHERE keyword NOT IN {STOPS} AND NOT regexp_full_match(keyword, '[0-9]+')
        AND (keyword IN ('are', 'from', 'ing') OR regexp_full_match(keyword, '[a-z]+')))"""


@query("weekly_keyword_trend", with_sql(DOCS, TOKENS) + """,
c AS (SELECT strftime(date_trunc('week', published_at), '%Y-%m-%d') AS week_start, product, region, sentiment_label, keyword, count(*) AS count
      FROM biz WHERE published_at IS NOT NULL GROUP BY ALL),
top AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY week_start, product, region, sentiment_label ORDER BY count DESC, keyword) <= 10)
SELECT *, CAST(dense_rank() OVER (ORDER BY week_start) AS VARCHAR) || '주차' AS week_label FROM top""")
def weekly_keyword_trend(spark, sf):
    return t.weekly_keywords(comments(spark, sf), "text", rules=LATIN)


@query("top_keywords", with_sql(DOCS, TOKENS) + """
SELECT keyword, count(*) AS count FROM biz GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 30""")
def top_keywords(spark, sf):
    return t.top_keywords(comments(spark, sf), "text", 30, LATIN)


@query("comment_tokens", with_sql(DOCS, TOKENS) + "SELECT comment_id, keyword, count(*) AS count FROM kws GROUP BY 1, 2")
def comment_tokens(spark, sf):
    c = comments(spark, sf)
    return c.select("comment_id", F.explode(kw.tokenize(F.col("text"), LATIN)).alias("keyword")).groupBy("comment_id", "keyword").agg(F.count("*").alias("count"))


#: Words of the fixture as lists of the summary; sources and languages act as names.
SUMMARY = ks.SummaryRules(keywords=LATIN, block=("on", "en"), low_weight=("or", "it", "le"), low_factor=0.12, term_noise=("are",), names=("for", "die"))
BLOCKED = """nameraw AS (SELECT lower(unnest(regexp_extract_all(video_id || ' ' || product, '[0-9A-Za-z가-힣]+'))) AS k FROM docs),
blocked AS (SELECT k FROM nameraw UNION SELECT 'for' UNION SELECT 'die')"""
def _named(spark, sf):
    return comments(spark, sf).withColumns({"cleaned_text": F.col("text"), "channel_title": F.col("video_id"), "author_display_name": F.col("product")})


@query("weighted_keywords", with_sql(DOCS, TOKENS) + """
SELECT keyword, count FROM (SELECT keyword, count(*) AS count FROM biz WHERE keyword NOT IN ('on', 'en') GROUP BY 1)
ORDER BY count * CASE WHEN keyword IN ('or', 'it', 'le') THEN 0.12 ELSE 1.0 END DESC, count DESC, keyword LIMIT 30""")
def weighted_keywords(spark, sf):
    return ks.weighted_keywords(ks.keyword_counts(comments(spark, sf), "text", rules=SUMMARY), 30, rules=SUMMARY)


PACK = """pack AS (SELECT keyword, count(*) AS count FROM biz WHERE sentiment_label = 'positive' AND keyword NOT IN ('on', 'en') AND keyword NOT IN (SELECT k FROM blocked) GROUP BY 1
  ORDER BY count(*) * CASE WHEN keyword IN ('or', 'it', 'le') THEN 0.12 ELSE 1.0 END DESC, count(*) DESC, keyword LIMIT 12)"""


@query("keyword_pack", with_sql(DOCS, TOKENS, BLOCKED, PACK) + "SELECT * FROM pack")
def keyword_pack(spark, sf):
    return ks.keyword_pack(_named(spark, sf), "positive", top_n=12, rules=SUMMARY)


@query("keyword_share", with_sql(DOCS, TOKENS, BLOCKED, PACK) + """
SELECT keyword, count, printf('%.1f', round(count / (SELECT sum(count) FROM pack) * 100, 1)) || '%' AS share_text FROM pack""")
def keyword_share(spark, sf):
    return ks.keyword_share(ks.keyword_pack(_named(spark, sf), "positive", top_n=12, rules=SUMMARY))


@query("recent_change", with_sql(EV) + """, t AS (SELECT video_id, published_at AS p, max(published_at) OVER (PARTITION BY video_id) AS m FROM ev),
n AS (SELECT video_id, count(*) FILTER (p >= m - INTERVAL 5 DAYS) AS recent, count(*) FILTER (p < m - INTERVAL 5 DAYS AND p >= m - INTERVAL 10 DAYS) AS previous FROM t GROUP BY 1)
SELECT video_id, recent, previous, CASE WHEN recent > previous THEN 'up' WHEN recent < previous THEN 'down' ELSE 'same' END AS direction FROM n""")
def recent_change(spark, sf):
    """The events span a month, so the spans are five days here."""
    return t.recent_change(labelled_events(spark, sf), ["video_id"], days=5)


@query("issue_facets", with_sql(EV, KEY_TREND) + """
SELECT product, region, 'z' || keyword AS keyword, CAST(c AS BIGINT) AS count FROM keys WHERE c IS NOT NULL AND weeks_active >= 2 AND product IN ('p0', 'p1') AND region = 'r0' AND keyword LIKE 'k%'""")
def issue_facets(spark, sf):
    """Keywords of users become a stopword of the fixture's rules, so they must vanish."""
    rows = t.issue_keywords(_key_trend(spark, sf))[1]
    marked = rows.withColumn("keyword", F.when(F.col("keyword").startswith("u"), "the").otherwise(F.concat(F.lit("z"), "keyword")))
    return t.issue_frame(marked, ["p0", "p1"], ["r0"], LATIN).select("product", "region", "keyword", "count")
