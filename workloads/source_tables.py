"""Page flattening, run tables, quota, search terms, checks and streams over the driver tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from voxframe.operators import quality as qa
from voxframe.operators import similar as sm
from voxframe.operators import strategy as st
from voxframe.plans.comment_plan import normalize_comments, with_parent_text
from voxframe.schemas import COMMENTS, conform
from voxframe.session import materialize, shared_folder
from voxframe.sources import collect as cl
from voxframe.sources import readers, writers
from voxframe.streaming import incremental as inc
from workloads.bindings import DOCS, EV, VIDEOS, comments, labelled_events, table, videos, with_sql
from workloads.registry import query
from workloads.strategy_tables import CLASSES, STRATEGY, _similar, representatives, truth_rows

# Pages ----------------------------------------------------------------------------------------------


def _snippet(text, likes):
    names = ("textOriginal", "textDisplay", "authorDisplayName")
    return F.struct(
        text.alias(names[0]), F.lit("").alias(names[1]), F.lit("someone").alias(names[2]), F.struct(F.lit("ch1").alias("value")).alias("authorChannelId"),
        likes.cast("bigint").alias("likeCount"), F.lit("2024-01-01T00:00:00Z").alias("publishedAt"), F.lit("").alias("updatedAt"), F.lit("none").alias("viewerRating"),
    )


def _turns(spark, sf):
    c = table(spark, sf, "conversations")
    key = F.col("conv_id").cast("string")
    return c.select("conv_id", "turn", F.concat_ws("-", key, F.col("turn").cast("string")).alias("id"), "text")


def _thread_pages(spark, sf):
    """One page per conversation: its first turn as thread, its second turn embedded as reply."""
    t = _turns(spark, sf)
    replies = t.where("turn > 0").groupBy("conv_id").agg(F.count("*").alias("n"))
    second = t.where("turn = 1").select("conv_id", F.col("id").alias("rid"), F.col("text").alias("rtext"))
    first = t.where("turn = 0").join(replies, "conv_id", "left").join(second, "conv_id", "left")
    embedded = F.when(F.col("rid").isNotNull(), F.array(F.struct(F.col("rid").alias("id"), _snippet(F.col("rtext"), F.lit(1)).alias("snippet"))))
    item = F.struct(
        F.concat(F.lit("t"), F.col("conv_id").cast("string")).alias("id"),
        F.struct(F.coalesce("n", F.lit(0)).alias("totalReplyCount"), F.struct(F.col("id").alias("id"), _snippet(F.col("text"), F.lit(2)).alias("snippet")).alias("topLevelComment")).alias("snippet"),
        F.struct(embedded.alias("comments")).alias("replies"),
    )
    return first.select(F.lit("commentThreads.list").alias("endpoint"), F.lit("run1").alias("run_id"), F.concat(F.lit("v"), F.col("conv_id").cast("string")).alias("video_id"),
                        F.struct(F.array(item).alias("items")).alias("payload"))


def _reply_pages(spark, sf):
    """One page per later turn, as a reply listing brings them."""
    t = _turns(spark, sf).where("turn > 0")
    item = F.struct(F.col("id").alias("id"), _snippet(F.concat(F.lit("fetched "), "text"), F.lit(3)).alias("snippet"))
    return t.select(F.lit("run1").alias("run_id"), F.concat(F.lit("v"), F.col("conv_id").cast("string")).alias("video_id"), F.concat(F.col("conv_id").cast("string"), F.lit("-0")).alias("parent_comment_id"),
                    F.struct(F.array(item).alias("items")).alias("payload"))


@query("thread_flatten", """
SELECT CAST(c.conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS comment_id, 't' || CAST(c.conv_id AS VARCHAR) AS thread_id,
  CASE WHEN turn > 0 THEN CAST(c.conv_id AS VARCHAR) || '-0' END AS parent_comment_id, turn > 0 AS is_reply, CASE WHEN turn = 0 THEN n ELSE 0 END AS reply_count,
  CASE WHEN turn > 1 THEN 'fetched ' ELSE '' END || text AS text_original, CASE turn WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 3 END AS like_count
FROM conversations c JOIN (SELECT conv_id, count(*) FILTER (turn > 0) AS n FROM conversations GROUP BY 1 HAVING count(*) FILTER (turn = 0) > 0) USING (conv_id)""")
def thread_flatten(spark, sf):
    out = cl.complete_replies(cl.flatten_threads(_thread_pages(spark, sf)), _reply_pages(spark, sf))
    return out.select("comment_id", "thread_id", "parent_comment_id", "is_reply", "reply_count", "text_original", "like_count")


@query("stored_pages", "SELECT count(*) AS threads, count(*) FILTER (turn = 1) AS embedded FROM (SELECT turn FROM conversations WHERE turn IN (0, 1))".replace("count(*) AS threads", "count(*) FILTER (turn = 0) AS threads"))
def stored_pages(spark, sf):
    """Pages written as JSON files and read back with a fixed schema."""
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    _thread_pages(spark, sf).write.json(path)
    pages = readers.read_pages(spark, path, one_per_file=False)
    flat = cl.flatten_threads(pages)
    return flat.agg(F.count_if(~F.col("is_reply")).alias("threads"), F.count_if(F.col("is_reply")).alias("embedded"))


@query("video_flatten", """
SELECT CAST(c_custkey AS VARCHAR) AS video_id, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS search_rank, c_name AS title, CAST(floor(c_acctbal) AS BIGINT) AS view_count,
  'https://www.youtube.com/watch?v=' || CAST(c_custkey AS VARCHAR) AS video_url FROM customer""")
def video_flatten(spark, sf):
    c = table(spark, sf, "customer")
    run, vid = F.col("c_nationkey").cast("string").alias("run_id"), F.col("c_custkey").cast("string")
    search = c.select(run, F.col("c_custkey").alias("page_no"), F.struct(F.array(F.struct(F.struct(vid.alias("videoId")).alias("id"))).alias("items")).alias("payload"))
    none = F.lit(None).cast("string")
    snippet = F.struct(F.col("c_name").alias("title"), none.alias("description"), none.alias("channelId"), F.col("c_mktsegment").alias("channelTitle"), none.alias("publishedAt"),
                       F.array("c_mktsegment").alias("tags"), none.alias("categoryId"))
    stats = F.struct(F.floor("c_acctbal").cast("string").alias("viewCount"), none.alias("likeCount"), F.lit("7").alias("commentCount"))
    item = F.struct(vid.alias("id"), snippet.alias("snippet"), F.struct(none.alias("duration")).alias("contentDetails"), stats.alias("statistics"))
    detail = c.select(run, F.struct(F.array(item).alias("items")).alias("payload"))
    return cl.flatten_videos(search, detail, "word", "KR").select("video_id", "search_rank", "title", "view_count", "video_url")


@query("merged_searches", """
SELECT video_id, search_rank FROM (SELECT o_custkey AS video_id, o_orderkey AS search_rank, CAST(floor(o_totalprice) AS BIGINT) AS comment_count FROM orders
  QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY month(o_orderdate), o_orderkey) = 1) ORDER BY search_rank, comment_count DESC, video_id LIMIT 50""")
def merged_searches(spark, sf):
    o = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("video_id"), F.col("o_orderkey").alias("search_rank"), F.floor("o_totalprice").alias("comment_count"), F.month("o_orderdate").alias("keyword_order")
    )
    return cl.merge_keyword_results(o, 50).select("video_id", "search_rank")


@query("not_collected", with_sql(EV, VIDEOS) + "SELECT video_id FROM videos WHERE video_id NOT IN (SELECT video_id FROM ev)")
def not_collected(spark, sf):
    return cl.not_collected(videos(spark, sf), labelled_events(spark, sf)).select("video_id")


COSTS = {"view": 100, "click": 1, "purchase": 1, "signup": 3}


@query("quota_usage", """
SELECT event_type AS endpoint, count(*) AS calls, count(*) * CASE event_type WHEN 'view' THEN 100 WHEN 'click' THEN 1 WHEN 'purchase' THEN 1 WHEN 'signup' THEN 3 ELSE 0 END AS units, true AS over_limit
FROM events GROUP BY 1""")
def quota_usage(spark, sf):
    return cl.quota_usage(table(spark, sf, "events").select(F.col("event_type").alias("endpoint")), COSTS, 10000)


@query("quota_estimate", """
SELECT p_partkey, CAST(p + p * 100 + t + r AS BIGINT) AS total_units, CAST(r AS BIGINT) AS reply_calls FROM (
  SELECT p_partkey, ceil(p_size / 50) AS p, t, CASE WHEN p_size > 20 THEN ceil(t * CAST(0.3 AS DOUBLE)) ELSE 0 END AS r FROM (
    SELECT *, p_size * ceil((CASE WHEN p_partkey % 3 > 0 THEN p_partkey % 3 * 120 ELSE 1000 END) / 50) AS t FROM part))""")
def quota_estimate(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", F.col("p_size").alias("max_videos"), (F.col("p_partkey") % 3 * 120).alias("comments_per_video"), (F.col("p_size") > 20).alias("include_replies"))
    return cl.estimate_quota(p).select("p_partkey", "total_units", "reply_calls")


@query("search_variants", """
WITH s AS (SELECT n_name AS keyword, ['US', 'CA', 'ZZ', 'KR', 'IN'][n_regionkey + 1] AS region FROM nation),
l AS (SELECT *, CASE region WHEN 'US' THEN ['en', 'ko'] WHEN 'CA' THEN ['en', 'fr', 'ko'] WHEN 'KR' THEN ['ko', 'en'] WHEN 'IN' THEN ['hi', 'en', 'ko'] ELSE ['ko', 'en'] END AS ls FROM s),
r AS (SELECT keyword, region, unnest(ls) AS lang, unnest(range(len(ls))) AS pos FROM l),
t AS (SELECT keyword, region, keyword AS term, -1 AS pos FROM s UNION ALL SELECT keyword, region, CASE WHEN lang = 'en' THEN lower(keyword) ELSE keyword || '-' || lang END, pos FROM r),
d AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY keyword, region, lower(term) ORDER BY pos) = 1)
SELECT keyword, region, row_number() OVER (PARTITION BY keyword, region ORDER BY pos) AS variant, term FROM d QUALIFY variant <= 5""")
def search_variants(spark, sf):
    n = table(spark, sf, "nation")
    codes = F.array(*[F.lit(x) for x in ("US", "CA", "ZZ", "KR", "IN")])
    seeds = n.select(F.col("n_name").alias("keyword"), codes[F.col("n_regionkey")].alias("region"))
    lang = F.explode(F.array(*[F.lit(x) for x in ("en", "fr", "ko", "hi")]))
    terms = n.select(F.col("n_name").alias("keyword"), lang.alias("language"))
    terms = terms.withColumn("term", F.when(F.col("language") == "en", F.lower("keyword")).otherwise(F.concat_ws("-", "keyword", "language")))
    return cl.search_variants(seeds, terms)


@query("run_manifest", """
SELECT 'run1' AS run_id, (SELECT count(*) FROM customer) AS videos_collected, count(*) AS comments_collected, count(*) FILTER (event_type = 'error') AS error_count,
  count(DISTINCT user_id) FILTER (event_type = 'error') AS failed FROM events""")
def run_manifest(spark, sf):
    e = table(spark, sf, "events")
    errors = e.where("event_type = 'error'").select(F.col("user_id").alias("video_id"))
    return writers.run_manifest(videos(spark, sf), e, errors, "run1").withColumnRenamed("failed_count", "failed")


@query("failed_videos", "SELECT DISTINCT CAST(user_id AS VARCHAR) AS video_id FROM events WHERE event_type = 'error'")
def failed_videos(spark, sf):
    return writers.failed_videos(table(spark, sf, "events").where("event_type = 'error'").select(F.col("user_id").alias("video_id")))


@query("report_rows", with_sql(EV) + """
SELECT section, row_number() OVER (PARTITION BY section ORDER BY value DESC, label) AS rank, label, value FROM (
  SELECT 'sentiment' AS section, sentiment_label AS label, CAST(count(*) AS DOUBLE) AS value FROM ev GROUP BY 2 UNION ALL SELECT 'keywords', keyword, CAST(count(*) AS DOUBLE) FROM ev GROUP BY 2)
QUALIFY rank <= CASE section WHEN 'keywords' THEN 5 ELSE 8 END""")
def report_rows(spark, sf):
    from voxframe.operators.descriptive import label_counts

    e = labelled_events(spark, sf)
    return writers.report_rows({"sentiment": (label_counts(e, "sentiment_label"), "sentiment_label", "count", 8), "keywords": (label_counts(e, "keyword"), "keyword", "count", 5)})


@query("run_tables", with_sql(EV) + """
SELECT run_id, comment_id FROM (SELECT region AS run_id, comment_id FROM ev WHERE region = (SELECT max(region) FROM ev)) QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY comment_id) <= 100""")
def run_tables(spark, sf):
    """Two runs written and read back as one table; then the sampled view of the newest one."""
    base = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    e = labelled_events(spark, sf).select("comment_id", "region", "like_count")
    for run in ("r0", "r1"):
        writers.write_run({"comments": e.where(F.col("region") == run)}, base, run)
    return readers.sample_runs(readers.read_runs(spark, base, "comments"), 1, 100, "comment_id").select("run_id", "comment_id")


@query("run_scope", with_sql(EV) + "SELECT comment_id, like_count FROM ev WHERE region = 'r1'")
def run_scope(spark, sf):
    """All rows of one run; only its folder is read."""
    base = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    e = labelled_events(spark, sf).select("comment_id", "region", "like_count")
    for run in ("r0", "r1"):
        writers.write_run({"comments": e.where(F.col("region") == run)}, base, run)
    return readers.of_run(readers.read_runs(spark, base, "comments"), "r1").select("comment_id", "like_count")


@query("scoped_comments", with_sql(EV) + "SELECT comment_id, 'clean' AS scope FROM ev WHERE comment_validity = 'valid' UNION ALL SELECT comment_id, 'filtered' FROM ev WHERE region = 'r0'")
def scoped_comments(spark, sf):
    """The clean comments where there are any; else the filtered ones."""
    from voxframe.operators.mining import scope_source

    e = labelled_events(spark, sf)
    clean, filtered = e.where("comment_validity = 'valid'"), e.where("region = 'r0'")
    first = scope_source(clean, filtered).select("comment_id", F.lit("clean").alias("scope"))
    return first.union(scope_source(clean.where("false"), filtered).select("comment_id", F.lit("filtered").alias("scope")))


@query("enriched_comments", with_sql(DOCS) + """
SELECT comment_id, CASE WHEN toxic = 1 THEN 'negative' WHEN quality = 1 THEN 'positive' WHEN quality = 0 THEN 'trash' END AS nlp_label, CAST(quality AS DOUBLE) AS nlp_confidence, true AS no_topics FROM docs""")
def enriched_comments(spark, sf):
    """Labels made elsewhere, joined by comment; columns they lack are null, comments they lack keep their row."""
    from voxframe.operators.labels import attach_enrichment

    l = table(spark, sf, "labels")
    label = F.when(F.col("toxic") == 1, "negative").when(F.col("quality") == 1, "positive").when(F.col("quality") == 0, "trash")
    outside = l.select(F.col("doc_id").cast("string").alias("comment_id"), label.alias("nlp_label"), F.col("quality").cast("double").alias("nlp_confidence"))
    out = attach_enrichment(comments(spark, sf).withColumn("nlp_label", F.lit("stale")), outside)
    return out.select("comment_id", "nlp_label", "nlp_confidence", F.col("nlp_topics").isNull().alias("no_topics"))


@query("backfilled_taxonomy", with_sql(DOCS) + """
SELECT comment_id, CASE WHEN quality IS NOT NULL THEN 's' || CAST(quality AS VARCHAR) END AS journey_stage, CASE WHEN quality = 1 THEN 'new' ELSE product END AS topic_label FROM docs""")
def backfilled_taxonomy(spark, sf):
    from voxframe.operators.truth import backfill_taxonomy

    frame = comments(spark, sf).select("comment_id", F.lit("old").alias("journey_stage"), F.array(F.lit("x")).alias("judgment_axes"), F.col("product").alias("topic_label"))
    l = table(spark, sf, "labels")
    source = l.select(F.col("doc_id").cast("string").alias("comment_id"), F.concat(F.lit("s"), F.col("quality").cast("string")).alias("journey_stage"), F.array(F.lit("y")).alias("judgment_axes"), F.when(F.col("quality") == 1, "new").alias("topic_label"))
    return backfill_taxonomy(frame, source).select("comment_id", "journey_stage", "topic_label")


@query("csv_export", with_sql(EV) + "SELECT comment_id, product || ', ' || region AS parts, '{\"k\":\"' || keyword || '\"}' AS detail, strftime(published_at, '%Y-%m-%d %H:%M:%S') AS written FROM ev")
def csv_export(spark, sf):
    """Nested columns written as text to CSV and read back through the fallback of the reader."""
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    e = labelled_events(spark, sf).select("comment_id", F.array("product", "region").alias("parts"), F.struct(F.col("keyword").alias("k")).alias("detail"), F.col("published_at").alias("written"))
    writers.write_export({"sheet.csv": e}, path)
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField(n, T.StringType()) for n in ("comment_id", "parts", "detail", "written")])
    return readers.read_table(spark, f"{path}/sheet.parquet", schema)


@query("dataset_signature")
def dataset_signature(spark, sf):
    digest = readers.dataset_signature(spark, [f"{sf}/events.parquet", f"{sf}/documents.parquet"])
    return table(spark, sf, "events").agg(F.count("*").alias("comments")).withColumn("signature", F.lit(digest))


@query("parent_text", """
SELECT CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS comment_id, CASE WHEN turn > 0 THEN coalesce(first, '') ELSE '' END AS parent_comment_text
FROM conversations LEFT JOIN (SELECT conv_id, text AS first FROM conversations WHERE turn = 0 AND role = 'user') USING (conv_id)""")
def parent_text(spark, sf):
    c = table(spark, sf, "conversations")
    key = F.col("conv_id").cast("string")
    rows = c.select(
        F.concat_ws("-", key, F.col("turn").cast("string")).alias("comment_id"), F.when(F.col("turn") > 0, F.concat(key, F.lit("-0"))).alias("parent_comment_id"),
        F.col("text").alias("text_display"), (F.col("role") == "user").alias("analysis_included"),
    )
    return with_parent_text(rows).select("comment_id", "parent_comment_text")


@query("normalized_comments")
def normalized_comments(spark, sf):
    c = comments(spark, sf).select("comment_id", "video_id", F.col("text").alias("text_original"), F.col("published_at").cast("string").alias("published_at"), "like_count")
    out = normalize_comments(conform(c, COMMENTS))
    return out.select("comment_id", "text_length", "language_detected", "comment_quality", "analysis_included", "pii_flag", "pii_types")


# Checks ---------------------------------------------------------------------------------------------

TINY_NOISE = ("theron", "ciónos")


@query("dq_representatives", with_sql(*STRATEGY) + r"""
SELECT count(*) AS representatives, count(*) FILTER (z) AS noise, count(*) FILTER (length(text) < 35) AS short, count(*) FILTER (journey_stage IS NULL) AS no_stage, count(*) FILTER (len(judgment_axes) = 0) AS no_axes,
  count(*) FILTER (v) AS non_customer_voice, count(*) FILTER (z OR length(text) < 35 OR journey_stage IS NULL OR len(judgment_axes) = 0 OR v) AS problematic, count(*) - count(DISTINCT text) AS duplicate_texts,
  CASE WHEN count(*) FILTER (z OR length(text) < 35 OR journey_stage IS NULL OR len(judgment_axes) = 0 OR v) = 0 AND count(*) = count(DISTINCT text) THEN 'PASS' ELSE 'PARTIAL' END AS status
FROM (SELECT *, regexp_matches(lower(text), 'theron|ciónos') AS z, contains(lower(text), 'hathe') AS v FROM reps)""")
def dq_representatives(spark, sf):
    return qa.representative_quality(representatives(truth_rows(spark, sf)), noise=TINY_NOISE, voices=("hathe",))


@query("dq_noise", with_sql(*STRATEGY) + """
SELECT (SELECT count(*) FROM reps WHERE regexp_matches(lower(text), 'theron|ciónos')) AS representative_noise, (SELECT count(*) FROM truth WHERE inquiry_flag AND regexp_matches(lower(text), 'theron|ciónos')) AS inquiry_noise,
  (SELECT count(DISTINCT video_id) FROM truth WHERE regexp_matches(video_id, '^\\d+$')) AS keyword_noise, 0 AS strategy_noise,
  CASE WHEN (SELECT count(*) FROM reps WHERE regexp_matches(lower(text), 'theron|ciónos')) + (SELECT count(*) FROM truth WHERE inquiry_flag AND regexp_matches(lower(text), 'theron|ciónos')) = 0 THEN 'PASS' ELSE 'PARTIAL' END AS status""")
def dq_noise(spark, sf):
    rows = truth_rows(spark, sf)
    reps = representatives(rows)
    words = rows.select(F.col("video_id").alias("keyword")).distinct()
    return qa.noise_leaks(reps, rows.where("inquiry_flag"), words, st.strategy_candidates(rows, reps, texts=False), rows, noise=TINY_NOISE)


@query("dq_taxonomy", with_sql(*STRATEGY) + """
SELECT judgment_axis, count(*) AS count, round(count(*) / sum(count(*)) OVER (), 4) AS share, count(*) / sum(count(*)) OVER () >= 0.75 AS dominant FROM (SELECT unnest(judgment_axes) AS judgment_axis FROM truth) GROUP BY 1""")
def dq_taxonomy(spark, sf):
    return qa.axis_balance(truth_rows(spark, sf))


@query("dq_prefix", with_sql(DOCS) + """
SELECT sum(n) AS texts, (SELECT count(DISTINCT text) FROM docs) AS distinct_texts, round((SELECT count(DISTINCT text) FROM docs) / sum(n), 4) AS distinct_ratio, round(max(n) / sum(n), 4) AS max_prefix_ratio,
  CASE WHEN max(n) / sum(n) < 0.25 THEN 'PASS' ELSE 'PARTIAL' END AS status FROM (SELECT left(text, 36) AS p, CAST(count(*) AS BIGINT) AS n FROM docs GROUP BY 1)""".replace("sum(n) AS texts", "CAST(sum(n) AS BIGINT) AS texts"))
def dq_prefix(spark, sf):
    return qa.prefix_repetition(comments(spark, sf), "text", 36, 0.25)


@query("dq_clusters", CLASSES + """
SELECT r.class_id AS rep_class, CAST(count(DISTINCT b.comment_id) AS BIGINT) AS rows, max(b.cluster_size) AS cluster_size, bool_and(coalesce(x.journey_stage, '') = coalesce(y.journey_stage, '')) AS same_journey,
  bool_and(x.dir = y.dir) AS same_direction, bool_and(list_has_any(x.toks, y.toks)) AS shared_tokens, count(DISTINCT b.comment_id) = max(b.cluster_size) AS counts_match,
  max(b.cluster_size) >= greatest(floor((SELECT count(*) FROM truth) * 0.08), 20) AS over_broad
FROM big b JOIN cl r ON r.comment_id = b.rep_id JOIN tk x ON x.comment_id = b.rep_id JOIN tk y ON y.comment_id = b.comment_id GROUP BY 1""")
def dq_clusters(spark, sf):
    rows, reps = _similar(spark, sf)
    classes, rep_classes = (materialize(sm.similar_classes(df)[0]) for df in (sm.source_pool(rows), reps))
    return qa.cluster_integrity(sm.similar_links(classes, rep_classes), classes, rep_classes, rows.agg(F.count("*")).scalar(), floor=20)


@query("dq_strategy", with_sql(*STRATEGY) + """
SELECT count(*) FILTER (reasons = '') AS insights, 0 AS single_comment, 0 AS reworded, count(*) FILTER (reasons = '' AND ids <> '') AS traced FROM cand""")
def dq_strategy(spark, sf):
    rows = truth_rows(spark, sf)
    reps = representatives(rows)
    insights = materialize(st.strategy_insights(st.strategy_candidates(rows, reps)))
    return qa.strategy_checks(insights, reps).withColumn("traced", qa.traceability(insights).select("traced").scalar())


@query("dq_levels", with_sql(*STRATEGY) + """
SELECT product_group, count(*) AS videos, count(DISTINCT stages) AS stage_sets FROM (SELECT product_group, level_id, string_agg(DISTINCT journey_stage, ',' ORDER BY journey_stage) AS stages FROM cand WHERE level_type = 'video' GROUP BY 1, 2) GROUP BY 1""")
def dq_levels(spark, sf):
    rows = truth_rows(spark, sf)
    return qa.level_consistency(st.strategy_candidates(rows, representatives(rows), texts=False))


@query("dq_verdict", with_sql(EV) + """
SELECT CASE WHEN bool_and(s = 'PASS') THEN 'PASS' WHEN bool_or(s = 'FAIL') THEN 'FAIL' ELSE 'PARTIAL' END AS verdict, coalesce(string_agg(product, ',' ORDER BY product) FILTER (s <> 'PASS'), '') AS risks
FROM (SELECT product, CASE WHEN count(*) FILTER (sentiment_label = 'negative') / count(*) < 0.2 THEN 'PASS' ELSE 'PARTIAL' END AS s FROM ev GROUP BY 1)""")
def dq_verdict(spark, sf):
    share = F.count_if(F.col("sentiment_label") == "negative") / F.count("*")
    sections = labelled_events(spark, sf).groupBy(F.col("product").alias("section")).agg(F.when(share < 0.2, "PASS").otherwise("PARTIAL").alias("status"))
    return qa.verdict(sections).withColumn("risks", F.array_join("risks", ","))


@query("metric_rates", with_sql(EV) + """
SELECT product, round(count(*) FILTER (comment_validity = 'excluded') / count(*), 4) AS exclude_rate,
  round(count(*) FILTER (sentiment_label = 'negative' AND comment_validity = 'valid') / count(*) FILTER (comment_validity = 'valid'), 4) AS negative_rate FROM ev GROUP BY 1""")
def metric_rates(spark, sf):
    valid = F.col("comment_validity") == "valid"
    return qa.metric_rates(labelled_events(spark, sf), {"exclude_rate": (~valid, F.lit(True)), "negative_rate": (F.col("sentiment_label") == "negative", valid)}, ["product"])


# Streams --------------------------------------------------------------------------------------------


def _stream(spark, sf):
    schema = table(spark, sf, "events").schema
    # A file source wants a folder or a pattern; this pattern matches the one table file.
    raw = inc.read_landing(spark, f"{sf}/events.parque[t]", schema)
    label = F.create_map(*[F.lit(x) for p in (("error", "negative"), ("purchase", "positive"), ("signup", "positive"), ("view", "neutral"), ("click", "mixed")) for x in p])
    return raw.select(
        F.col("event_id").cast("string").alias("comment_id"), F.concat(F.lit("v"), F.col("user_id").cast("string")).alias("video_id"),
        F.concat(F.lit("p"), (F.col("user_id") % 4).cast("string")).alias("product"), F.concat(F.lit("r"), (F.col("user_id") % 2).cast("string")).alias("region"),
        F.col("ts").alias("published_at"), label[F.col("event_type")].alias("sentiment_label"), F.get_json_object("props", "$.k").alias("k"), "event_id",
    )


WEEKLY = ("week_start", "product", "region", "sentiment_label")


@query("stream_weekly", with_sql(EV) + "SELECT strftime(date_trunc('week', published_at), '%Y-%m-%d') AS week_start, product, region, sentiment_label, count(*) AS count FROM ev GROUP BY ALL")
def stream_weekly(spark, sf):
    return inc.run_to_table(inc.weekly_counts(_stream(spark, sf)), "update", spark, WEEKLY)


@query("stream_weekly_late", with_sql(EV) + """, l AS (SELECT *, (SELECT max(published_at) FROM ev WHERE event_id % 7 <> 1) - INTERVAL 1 DAY AS mark, date_trunc('week', published_at) AS w FROM ev)
SELECT strftime(w, '%Y-%m-%d') AS week_start, product, region, sentiment_label, count(*) + count(*) FILTER (event_id % 7 = 0 AND w + INTERVAL 7 DAYS > mark) AS count FROM l GROUP BY ALL""")
def stream_weekly_late(spark, sf):
    """The third file repeats every seventh event: what belongs to weeks behind the watermark comes too late to count.

    Late rows are held against the watermark that the batch before the last one left.
    """
    landing = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    rows = labelled_events(spark, sf)
    for part in ("event_id % 7 <> 1", "event_id % 7 = 1", "event_id % 7 = 0"):
        rows.where(part).coalesce(1).write.mode("append").parquet(landing)
    stream = inc.read_landing(spark, landing, rows.schema, files_per_batch=1)
    return inc.run_to_table(inc.weekly_counts(stream), "update", spark, WEEKLY)


@query("incremental_upsert", """
SELECT 'v' || CAST(user_id AS VARCHAR) AS video_id, json_extract_string(props, '$.k') AS k, CAST(event_id AS VARCHAR) AS comment_id FROM events
QUALIFY row_number() OVER (PARTITION BY user_id, json_extract_string(props, '$.k') ORDER BY event_id DESC) = 1""")
def incremental_upsert(spark, sf):
    base = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    inc.append_versions(_stream(spark, sf), f"{base}/versions", f"{base}/checkpoint").awaitTermination()
    inc.compacted(spark, f"{base}/versions", "event_id", ("video_id", "k"))
    return inc.current_rows(spark, f"{base}/versions", "event_id", ("video_id", "k")).select("video_id", "k", "comment_id")


@query("stream_new_comments", "SELECT CAST(event_id AS VARCHAR) AS comment_id FROM events")
def stream_new_comments(spark, sf):
    return inc.run_to_table(inc.new_comments(_stream(spark, sf), keys=("comment_id",)).select("comment_id"), "append", spark)
