"""Descriptive tables, shares, densities, rankings and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxframe.operators import descriptive as d
from voxframe.operators import relational as rel
from workloads.bindings import DOCS, EV, VIDEOS, comments, labelled_events, table, videos, with_sql
from workloads.registry import query


def _ev_comments(spark, sf):
    return labelled_events(spark, sf).withColumn("is_reply", F.col("event_id") % 3 == 1)


@query("runs_summary", with_sql(EV) + """
SELECT unnest(['total_videos','total_comments','valid_comments','removed_comments','total_replies','avg_comments_per_video']) AS metric,
       unnest([v, c, ok, gone, replies, round(c / v, 2)]) AS value
FROM (SELECT CAST(count(*) AS DOUBLE) c, CAST(count(*) FILTER (comment_validity = 'valid') AS DOUBLE) ok,
             CAST(count(*) FILTER (comment_validity = 'excluded') AS DOUBLE) gone,
             CAST(count(*) FILTER (event_id % 3 = 1) AS DOUBLE) replies FROM ev),
     (SELECT CAST(count(*) AS DOUBLE) v FROM customer)""")
def runs_summary(spark, sf):
    return d.runs_summary(videos(spark, sf), _ev_comments(spark, sf))


@query("video_ranking", with_sql(EV, VIDEOS) + """
SELECT v.video_id, title, coalesce(n, 0) AS comment_volume, coalesce(likes, 0) AS comment_like_sum,
       coalesce(n, 0) + coalesce(likes, 0) AS engagement_proxy
FROM videos v LEFT JOIN (SELECT video_id, count(*) n, CAST(sum(like_count) AS BIGINT) likes FROM ev GROUP BY 1) USING (video_id)""")
def video_ranking(spark, sf):
    out = d.video_ranking(videos(spark, sf), labelled_events(spark, sf))
    return out.select("video_id", "title", "comment_volume", "comment_like_sum", "engagement_proxy")


@query("channel_comparison", with_sql(VIDEOS) + """
SELECT channel_title, count(DISTINCT video_id) AS videos, CAST(sum(view_count) AS BIGINT) AS total_views,
       CAST(sum(comment_count) AS BIGINT) AS total_video_comments
FROM videos GROUP BY 1""")
def channel_comparison(spark, sf):
    return d.channel_comparison(videos(spark, sf))


@query("daily_comment_counts", "SELECT CAST(ts AS DATE) AS comment_date, count(*) AS comment_count FROM events WHERE ts IS NOT NULL GROUP BY 1")
def daily_comment_counts(spark, sf):
    return d.daily_counts(table(spark, sf, "events"), "ts", "comment_date", "comment_count")


@query("daily_upload_counts", "SELECT CAST(o_orderdate AS DATE) AS upload_date, count(*) AS video_count FROM orders GROUP BY 1")
def daily_upload_counts(spark, sf):
    return d.daily_counts(table(spark, sf, "orders"), "o_orderdate", "upload_date", "video_count")


@query("quality_summary", with_sql(EV) + "SELECT comment_validity, exclusion_reason, count(*) AS count FROM ev GROUP BY 1, 2")
def quality_summary(spark, sf):
    return d.quality_summary(labelled_events(spark, sf))


@query("label_distribution", with_sql(DOCS) + "SELECT quality, count(*) AS count FROM docs WHERE quality IS NOT NULL GROUP BY 1")
def label_distribution(spark, sf):
    return d.label_counts(comments(spark, sf), "quality")


@query("label_share", with_sql(EV) + """
SELECT sentiment_label AS label, count(*) AS count, round(count(*) / sum(count(*)) OVER (), 4) AS share FROM ev GROUP BY 1""")
def label_share(spark, sf):
    return d.label_shares(labelled_events(spark, sf), "sentiment_label")


@query("brand_ratio", """
SELECT product, region, brand_label, count(*) AS count,
       round(count(*) / sum(count(*)) OVER (PARTITION BY product, region), 4) AS ratio
FROM (SELECT p_type AS product, l_returnflag AS region, p_brand AS brand_label FROM lineitem JOIN part ON p_partkey = l_partkey)
GROUP BY 1, 2, 3""")
def brand_ratio(spark, sf):
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_type").alias("product"), F.col("p_brand").alias("brand_label"))
    facts = table(spark, sf, "lineitem").select("l_partkey", F.col("l_returnflag").alias("region"))
    return d.brand_ratio(rel.attach(facts, part, ["l_partkey"], "inner"))


@query("topic_negative_rate", with_sql(EV) + """
SELECT product, region, event_type AS topic_label, count(comment_id) AS comments,
       count(*) FILTER (sentiment_label = 'negative') AS negative_comments,
       round(count(*) FILTER (sentiment_label = 'negative') / count(comment_id), 4) AS negative_rate
FROM ev GROUP BY 1, 2, 3""")
def topic_negative_rate(spark, sf):
    return d.negative_rate_by_topic(labelled_events(spark, sf).withColumnRenamed("event_type", "topic_label"))


@query("negative_density", with_sql(EV, VIDEOS) + """
SELECT v.product, v.region, v.video_id, v.title, v.video_url, coalesce(neg, 0) AS negative_comments, coalesce(n, 0) AS total_comments,
       round(CASE WHEN coalesce(n, 0) = 0 THEN 0 ELSE coalesce(neg, 0) / n END, 4) AS negative_density
FROM videos v LEFT JOIN (SELECT video_id, count(*) n, count(*) FILTER (sentiment_label = 'negative') neg FROM ev GROUP BY 1) USING (video_id)""")
def negative_density(spark, sf):
    return d.negative_density(videos(spark, sf), labelled_events(spark, sf))


def _event_units(spark, sf):
    """Events as opinion units of their user's record."""
    e = labelled_events(spark, sf)
    code = F.when(F.col("comment_validity") == "excluded", "excluded").otherwise(F.col("sentiment_label"))
    return e.select(F.col("video_id").alias("source_content_id"), F.col("comment_id").alias("opinion_id"), code.alias("sentiment_code"))


UNITS = """units AS (
  SELECT video_id AS source_content_id, comment_id AS opinion_id,
         CASE WHEN comment_validity = 'excluded' THEN 'excluded' ELSE sentiment_label END AS sentiment_code FROM ev)"""


@query("monitoring_summary", with_sql(EV, UNITS) + """
SELECT source_count, opinion_count, positive_count, negative_count, neutral_count, exclude_count,
       round(neutral_count / opinion_count, 6) AS neutral_rate, round(exclude_count / opinion_count, 6) AS exclude_rate,
       round(split / source_count, 6) AS split_rate
FROM (SELECT count(DISTINCT source_content_id) source_count, count(*) opinion_count,
             count(*) FILTER (sentiment_code = 'positive') positive_count, count(*) FILTER (sentiment_code = 'negative') negative_count,
             count(*) FILTER (sentiment_code = 'neutral') neutral_count, count(*) FILTER (sentiment_code = 'excluded') exclude_count FROM units),
     (SELECT count(*) split FROM (SELECT 1 FROM units GROUP BY source_content_id HAVING count(*) > 1))""")
def monitoring_summary(spark, sf):
    out = d.monitoring_summary(_event_units(spark, sf))
    return out.withColumns({n: F.round(n, 6) for n in ("neutral_rate", "exclude_rate", "split_rate")})


@query("reporting_summary", with_sql(EV, UNITS) + """
SELECT p AS positive_count, n AS negative_count, p + n AS kpi_opinion_count, round(p / (p + n), 6) AS positive_share,
       round(n / (p + n), 6) AS negative_share
FROM (SELECT count(*) FILTER (sentiment_code = 'positive') p, count(*) FILTER (sentiment_code = 'negative') n FROM units)""")
def reporting_summary(spark, sf):
    out = d.reporting_summary(_event_units(spark, sf))
    return out.withColumns({n: F.round(n, 6) for n in ("positive_share", "negative_share")})


@query("direct_kpis", with_sql(EV) + """
SELECT source_count, opinion_count, neutral_count, exclude_count, valid_count, positive_count, negative_count, relevant_count,
       round(positive_count * 100.0 / valid_count, 4) AS positive_ratio, round(negative_count * 100.0 / valid_count, 4) AS negative_ratio,
       round(vn * 100.0 / valid_count, 4) AS neutral_ratio, round(neutral_count / opinion_count, 4) AS neutral_rate,
       round(exclude_count / opinion_count, 4) AS exclude_rate,
       round(greatest(0, opinion_count - source_count) / source_count, 4) AS split_rate,
       round(positive_count / (positive_count + negative_count), 4) AS positive_share,
       round(negative_count / (positive_count + negative_count), 4) AS negative_share
FROM (SELECT count(DISTINCT video_id) source_count, count(*) opinion_count, count(*) FILTER (sentiment_label = 'neutral') neutral_count,
             count(*) FILTER (comment_validity = 'excluded') exclude_count, count(*) FILTER (comment_validity = 'valid') valid_count,
             count(*) FILTER (comment_validity = 'valid' AND sentiment_label = 'positive') positive_count,
             count(*) FILTER (comment_validity = 'valid' AND sentiment_label = 'negative') negative_count,
             count(*) FILTER (comment_validity = 'valid' AND sentiment_label = 'neutral') vn,
             count(*) FILTER (like_count >= 10) relevant_count FROM ev)""")
def direct_kpis(spark, sf):
    e = labelled_events(spark, sf).drop("comment_id").withColumnRenamed("video_id", "comment_id")
    return d.direct_kpis(e.withColumn("relevant_comment", F.col("like_count") >= 10))


TRUST = """round((count(*) FILTER (sentiment_label = 'positive') - count(*) FILTER (sentiment_label = 'negative'))
  / greatest(count(*) FILTER (sentiment_label IN ('positive', 'negative')), 1) * 50 + 50, 1)"""


@query("brand_trust", with_sql(EV) + f"""
SELECT brand_label, product, region, count(*) AS mentions, count(*) FILTER (sentiment_label = 'positive') AS positive_comments,
       count(*) FILTER (sentiment_label = 'negative') AS negative_comments,
       round(count(*) / sum(count(*)) OVER (PARTITION BY product, region), 6) AS mention_share, {TRUST} AS trust_index
FROM ev GROUP BY 1, 2, 3""")
def brand_trust(spark, sf):
    return d.brand_trust(labelled_events(spark, sf)).withColumn("mention_share", F.round("mention_share", 6))


STAGE_ORDER = ("view", "click", "signup", "purchase", "error")


@query("journey_trust", with_sql(EV) + f"""
SELECT event_type, product, region, brand_label, count(*) AS mentions,
       count(*) FILTER (sentiment_label = 'positive') AS positive_comments,
       count(*) FILTER (sentiment_label = 'negative') AS negative_comments, {TRUST} AS trust_index,
       list_position({list(STAGE_ORDER)}, event_type) - 1 AS stage_order
FROM ev GROUP BY 1, 2, 3, 4""")
def journey_trust(spark, sf):
    return d.stage_trust(labelled_events(spark, sf), stage="event_type", order=STAGE_ORDER)


@query("insight_type_counts", with_sql(EV) + "SELECT event_type AS insight_type, count(*) AS count FROM ev WHERE event_type <> 'view' GROUP BY 1")
def insight_type_counts(spark, sf):
    return d.insight_type_counts(labelled_events(spark, sf).withColumnRenamed("event_type", "insight_type"), "view")


@query("video_sentiment_distribution", with_sql(EV) + """
SELECT video_id, sentiment_code, comments, round(comments / greatest(1, sum(comments) OVER (PARTITION BY video_id)), 6) AS ratio
FROM (SELECT video_id, s AS sentiment_code, count(*) FILTER (code = s) AS comments
      FROM (SELECT video_id, CASE WHEN comment_validity = 'excluded' THEN 'excluded' ELSE sentiment_label END AS code FROM ev),
           (SELECT unnest(['positive','negative','neutral','excluded']) AS s) GROUP BY 1, 2)""")
def video_sentiment_distribution(spark, sf):
    return d.video_sentiment_distribution(labelled_events(spark, sf)).withColumn("ratio", F.round("ratio", 6))


@query("top_negative_topic", with_sql(EV) + """
SELECT keyword, negative_comments, negative_rate FROM (
  SELECT keyword, count(*) FILTER (sentiment_label = 'negative') negative_comments,
         round(count(*) FILTER (sentiment_label = 'negative') / count(*), 4) negative_rate FROM ev GROUP BY 1)
ORDER BY negative_rate DESC, negative_comments DESC, keyword LIMIT 1""")
def top_negative_topic(spark, sf):
    e = labelled_events(spark, sf).withColumns({"topic_label": F.col("keyword"), "product": F.lit("all"), "region": F.lit("all")})
    rates = d.negative_rate_by_topic(e).select(F.col("topic_label").alias("keyword"), "negative_comments", "negative_rate")
    return d.top_signal(rates, "keyword", ["negative_rate", "negative_comments"])


@query("outlier_comments", with_sql(DOCS) + """
SELECT comment_id, like_count, length(text) AS text_length FROM docs
ORDER BY like_count DESC NULLS LAST, text_length DESC, comment_id LIMIT 20""")
def outlier_comments(spark, sf):
    c = comments(spark, sf).select("comment_id", "like_count", F.length("text").alias("text_length"))
    return d.outliers(c)


@query("spam_like", with_sql(DOCS) + """
SELECT comment_id, count(*) OVER (PARTITION BY video_id, text) > 1 AS spam_like FROM docs""")
def spam_like(spark, sf):
    return rel.flag_duplicates(comments(spark, sf), ["video_id"], "text").select("comment_id", "spam_like")


@query("spam_like_any_video", with_sql(DOCS) + "SELECT comment_id, count(*) OVER (PARTITION BY text) > 1 AS spam_like FROM docs")
def spam_like_any_video(spark, sf):
    return rel.flag_duplicates(comments(spark, sf), [], "text").select("comment_id", "spam_like")


@query("keep_last", with_sql(EV) + """
SELECT video_id, keyword, comment_id, sentiment_label FROM ev
QUALIFY row_number() OVER (PARTITION BY video_id, keyword ORDER BY event_id DESC) = 1""")
def keep_last(spark, sf):
    out = rel.keep_last(labelled_events(spark, sf), ["video_id", "keyword"], "event_id")
    return out.select("video_id", "keyword", "comment_id", "sentiment_label")


@query("merge_keep_last", """
SELECT user_id, event_type, event_id, generation FROM (
  SELECT user_id, event_type, event_id, 0 AS generation FROM events WHERE ts < TIMESTAMP '2024-01-16'
  UNION ALL SELECT user_id, event_type, event_id, 1 FROM events WHERE ts >= TIMESTAMP '2024-01-16')
QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY generation DESC, event_id DESC) = 1""")
def merge_keep_last(spark, sf):
    """The collection up to mid-January, refreshed by the one after it."""
    e = table(spark, sf, "events").select("user_id", "event_type", "event_id", (F.col("ts") >= "2024-01-16").cast("int").alias("generation"))
    old, new = e.where("generation = 0"), e.where("generation = 1")
    return rel.merge_keep_last(old, new, ["user_id", "event_type"], ["event_id"])


@query("keep_first", with_sql(DOCS) + """
SELECT video_id, region, comment_id, like_count FROM docs
QUALIFY row_number() OVER (PARTITION BY video_id, region ORDER BY like_count DESC NULLS LAST, comment_id) = 1""")
def keep_first(spark, sf):
    order = [F.col("like_count").desc_nulls_last(), F.col("comment_id")]
    return rel.keep_first(comments(spark, sf), ["video_id", "region"], order).select("video_id", "region", "comment_id", "like_count")


@query("topk_per_group", with_sql(EV) + """
SELECT product, sentiment_label, comment_id, like_count, row_number() OVER (PARTITION BY product, sentiment_label ORDER BY like_count DESC, event_id) AS rank
FROM ev QUALIFY rank <= 5""")
def topk_per_group(spark, sf):
    order = [F.col("like_count").desc(), F.col("event_id")]
    out = rel.top_per_group(labelled_events(spark, sf), ["product", "sentiment_label"], order, 5, "rank")
    return out.select("product", "sentiment_label", "comment_id", "like_count", "rank")


@query("deep_topk_per_group", with_sql(EV) + """
SELECT product, comment_id, row_number() OVER (PARTITION BY product ORDER BY like_count DESC, event_id) AS rank FROM ev QUALIFY rank <= 1500""")
def deep_topk_per_group(spark, sf):
    order = [F.col("like_count").desc(), F.col("event_id")]
    return rel.top_per_group(labelled_events(spark, sf), ["product"], order, 1500, "rank").select("product", "comment_id", "rank")


@query("unrated_comments", "SELECT doc_id FROM documents ANTI JOIN labels USING (doc_id)")
def unrated_comments(spark, sf):
    return rel.attach(table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels").select("doc_id"), ["doc_id"], "left_anti")


@query("rated_comments", "SELECT doc_id, lang FROM documents SEMI JOIN labels USING (doc_id)")
def rated_comments(spark, sf):
    return rel.attach(table(spark, sf, "documents").select("doc_id", "lang"), table(spark, sf, "labels").select("doc_id"), ["doc_id"], "left_semi")


@query("video_context", with_sql(EV, VIDEOS) + """
SELECT e.comment_id, e.video_id, v.title, v.channel_title, v.keyword AS video_keyword FROM ev e LEFT JOIN videos v USING (video_id)""")
def video_context(spark, sf):
    v = videos(spark, sf).dropDuplicates(["video_id"]).select("video_id", "title", "channel_title", F.col("keyword").alias("video_keyword"))
    return rel.attach(labelled_events(spark, sf).select("comment_id", "video_id"), v, ["video_id"])


@query("video_context_salted", with_sql(EV, VIDEOS) + """
SELECT e.comment_id, e.video_id, v.title FROM ev e LEFT JOIN videos v USING (video_id)""")
def video_context_salted(spark, sf):
    """The same join on the path a lookup too large to broadcast takes."""
    v = videos(spark, sf).select("video_id", "title")
    return rel.attach(labelled_events(spark, sf).select("comment_id", "video_id"), v, ["video_id"], limit=-1)


@query("null_safe_lookup", with_sql(EV) + """
SELECT e.comment_id, e.exclusion_reason, q.n FROM ev e LEFT JOIN (SELECT exclusion_reason, count(*) AS n FROM ev GROUP BY 1) q
ON e.exclusion_reason IS NOT DISTINCT FROM q.exclusion_reason""")
def null_safe_lookup(spark, sf):
    e = labelled_events(spark, sf).select("comment_id", "exclusion_reason")
    return rel.attach(e, e.groupBy("exclusion_reason").agg(F.count("*").alias("n")), ["exclusion_reason"], null_safe=True)


@query("strategy_levels_union", with_sql(EV) + """
SELECT 'video' AS level_type, video_id AS level_id, NULL AS product, count(*) AS n FROM ev GROUP BY video_id
UNION ALL SELECT 'product_group', product, product, count(*) FROM ev GROUP BY product""")
def strategy_levels_union(spark, sf):
    e = labelled_events(spark, sf)
    by_video = e.groupBy(F.col("video_id").alias("level_id")).agg(F.count("*").alias("n")).withColumn("level_type", F.lit("video"))
    by_product = e.groupBy("product").agg(F.count("*").alias("n")).withColumns({"level_type": F.lit("product_group"), "level_id": F.col("product")})
    return rel.union_all([by_video, by_product]).select("level_type", "level_id", "product", "n")


@query("issue_scope_size", with_sql(EV) + """
SELECT level_type, level_id, supporting_cluster_count, scope_size, round(least(supporting_cluster_count / scope_size, 1.0), 6) AS issue_ratio
FROM (SELECT 'video' level_type, video_id level_id, count(*) FILTER (sentiment_label = 'negative') supporting_cluster_count, count(*) scope_size FROM ev GROUP BY 2
      UNION ALL SELECT 'product_group', product, count(*) FILTER (sentiment_label = 'negative'), count(*) FROM ev GROUP BY 2)
WHERE supporting_cluster_count > 0""")
def issue_scope_size(spark, sf):
    e = labelled_events(spark, sf)
    levels = F.array(
        F.struct(F.lit("video").alias("level_type"), F.col("video_id").alias("level_id")),
        F.struct(F.lit("product_group").alias("level_type"), F.col("product").alias("level_id")),
    )
    issues = e.where(F.col("sentiment_label") == "negative").select(F.inline(levels)).groupBy("level_type", "level_id")
    out = d.scope_sizes(issues.agg(F.count("*").alias("supporting_cluster_count")), e)
    return out.withColumn("issue_ratio", F.round("issue_ratio", 6))
