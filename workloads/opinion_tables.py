"""Opinion units, their scores, bundles, and aggregates over arrays and maps."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxframe.operators import descriptive as ds
from voxframe.operators import insights as ins
from voxframe.operators import opinions as op
from voxframe.session import materialize, spread
from workloads.bindings import DOCS, comments, sql_any, sql_argmax, sql_hits, table, with_sql
from workloads.label_tables import CLASS_CTES, RULES, TRUTH, _first
from workloads.registry import query

SCENES = {"S1": ("theron",), "S2": ("ention", "elle"), "S3": ("hathe", "sch ")}
ASPECTS = {"Alpha": ("ingth", "eaux"), "Beta": ("erea", "ung"), "Gamma": ("the", "der", "ciónos")}
INQUIRIES = {"HOW": ("what",), "COST": ("ingre", "les"), "RISK": ("onre",)}
OPINIONS = op.OpinionRules(
    contrast=r" (?:that|que|und) ", scenes=SCENES, aspects=ASPECTS, inquiries=INQUIRIES,
    categories={"en": "English", "fr": "French"}, subtypes={}, comments=RULES,
)


def opinion_input(spark, sf):
    """Documents with their own labels; repeated texts are marked as spam."""
    from voxframe.operators.relational import flag_duplicates

    c = comments(spark, sf).select(
        "comment_id", "video_id", "product", "region", F.col("text").alias("text_display"), "like_count", "sentiment_label",
        F.lit("strong").alias("signal_strength"), F.lit("complaint").alias("classification_type"), F.lit("high").alias("confidence_level"),
        F.lit(True).alias("product_related"), F.lit("").alias("topic_label"), F.lit("").alias("title"),
        F.when(F.col("quality") == 0, "excluded").otherwise("valid").alias("comment_validity"), F.col("video_id").alias("brand_label"),
    )
    return flag_duplicates(c, ["video_id"], "text_display")


def _units(spark, sf):
    """Opinion units of all documents, held in the shared folder as a run would."""
    return materialize(op.opinion_units(opinion_input(spark, sf), OPINIONS))


def _trim(x: str) -> str:
    return f"trim({x}, E' ,.;:-\\n\\t')"


UNIT_CTES = [
    DOCS,
    r"""osrc AS (SELECT comment_id, video_id, product, region, like_count, sentiment_label AS row_sentiment, quality,
      trim(text, E' \n\t\r') AS txt, count(*) OVER (PARTITION BY video_id, text) > 1 AS spam FROM docs)""",
    f"""oseg AS (SELECT *, CASE WHEN regexp_matches(txt, ' (?:that|que|und) ') THEN list_transform(list_filter(string_split_regex(txt, ' (?:that|que|und) '),
      lambda p: trim(p, E' \\n\\t\\r') <> ''), lambda p: {_trim('p')}) ELSE [txt] END AS segs FROM osrc)""",
    rf"""ocl AS (SELECT *, list_filter(list_transform(flatten(list_transform(segs, lambda s: list_transform(list_filter(
      string_split(regexp_replace(regexp_replace(s, '([.!?])\s+', '\1' || chr(1), 'g'), '\n+', chr(1), 'g'), chr(1)),
      lambda p: trim(p, E' \n\t\r') <> ''), lambda p: {_trim('p')}))), lambda p: trim(p)), lambda p: p <> '') AS cl0 FROM oseg)""",
    """ocl2 AS (SELECT *, CASE WHEN txt = '' THEN [] WHEN len(cl0) > 0 THEN list_filter(cl0, lambda x, i: list_position(cl0, x) = i) ELSE [txt] END AS cls FROM ocl)""",
    """units0 AS (SELECT * EXCLUDE (segs, cl0), len(cls) AS opinion_count, unnest(cls) AS clause, unnest(range(1, len(cls) + 1)) AS pos FROM ocl2)""",
    """conv1 AS (SELECT comment_id || '::u' || CAST(pos AS VARCHAR) AS comment_id, clause AS source, '' AS parent, lower(clause) AS t, '' AS pt,
      lower(' ' || product) AS ctx, false AS is_reply FROM units0)""",
    *CLASS_CTES,
    f"""units1 AS (SELECT u.*, u.comment_id || '::u' || CAST(pos AS VARCHAR) AS opinion_id, lower(clause) AS lc, coalesce(quality <> 0, true) AS valid,
      CASE WHEN NOT coalesce(quality <> 0, true) THEN 'excluded' WHEN opinion_count = 1 THEN row_sentiment ELSE g.sentiment_label END AS sentiment_code,
      CASE WHEN NOT coalesce(quality <> 0, true) THEN 'weak' WHEN opinion_count = 1 THEN 'strong' ELSE g.signal_strength END AS signal_strength,
      CASE WHEN NOT coalesce(quality <> 0, true) THEN 'informational' WHEN opinion_count = 1 THEN 'complaint' ELSE g.classification_type END AS classification_type,
      CASE WHEN opinion_count = 1 THEN true WHEN NOT coalesce(quality <> 0, true) THEN false ELSE g.product_related END AS product_related
      FROM units0 u JOIN graded g ON g.comment_id = u.comment_id || '::u' || CAST(pos AS VARCHAR))""",
    f"""units AS (SELECT *, {_first('lc', SCENES, "'S7 Use'")} AS cej_scene_code,
      {sql_argmax({k: sql_hits('lc', v) for k, v in ASPECTS.items()}, "'General'")} AS aspect_key,
      concat_ws('|', {', '.join(f"CASE WHEN {sql_any('lc', v)} THEN '{k}' END" for k, v in INQUIRIES.items())}) AS inq,
      CASE product WHEN 'en' THEN 'English' WHEN 'fr' THEN 'French' ELSE product END AS product_category,
      CASE WHEN sentiment_code IN ('positive', 'negative') THEN
        least(10, (CASE WHEN signal_strength = 'strong' THEN 8.0 ELSE 5.0 END) + 2 * {sql_hits('lc', ('always', 'never', 'worst', 'best'))}) * 5
        + least(10, (CASE WHEN length(lc) < 20 THEN 0 WHEN length(lc) < 60 THEN 1 WHEN length(lc) < 140 THEN 2 ELSE 3 END)
            + 2 * {sql_hits('lc', ('because', 'so ', 'when', 'if ', 'month', 'week', 'year'))} + {sql_hits('lc', ('than', 'compared'))}) * 2
        + least(10, log10(1 + greatest(like_count, 0)) * 4) * 1.5 - CASE WHEN spam THEN 7 ELSE 0 END ELSE 0 END AS opinion_score FROM units1)""",
]


@query("opinion_units", with_sql(*UNIT_CTES) + """
SELECT opinion_id, opinion_count, sentiment_code, signal_strength, classification_type, product_related, cej_scene_code, aspect_key,
       inq AS inquiry_types, product_category, spam AS duplicate_opinion_flag, clause AS opinion_text, CAST(round(opinion_score, 6) AS DOUBLE) AS opinion_score FROM units""")
def opinion_units(spark, sf):
    u = op.opinion_units(opinion_input(spark, sf), OPINIONS)
    return u.select(
        "opinion_id", "opinion_count", "sentiment_code", "signal_strength", "classification_type", "product_related", "cej_scene_code", "aspect_key",
        F.array_join("inquiry_types", "|").alias("inquiry_types"), "product_category", "duplicate_opinion_flag", "opinion_text",
        F.round("opinion_score", 6).alias("opinion_score"),
    )


@query("opinion_counts", with_sql(*UNIT_CTES) + """
SELECT d.comment_id, coalesce(n, 1) AS opinion_count FROM docs d LEFT JOIN (SELECT comment_id, count(*) AS n FROM units0 GROUP BY 1) USING (comment_id)""")
def opinion_counts(spark, sf):
    c = opinion_input(spark, sf)
    return op.opinion_counts(c, op.opinion_units(c, OPINIONS)).select("comment_id", "opinion_count")


BUNDLES = [
    *UNIT_CTES,
    r"""cand AS (SELECT *, trim(regexp_replace(regexp_replace(lower(clause), '[^\p{L}\p{M}\p{N}\p{Pc}\s]', ' ', 'g'), '\s+', ' ', 'g')) AS key FROM units
      WHERE sentiment_code IN ('positive', 'negative') AND NOT spam AND NOT (inq <> '' AND classification_type = 'informational') AND product_related)""",
    """bonce AS (SELECT * FROM cand QUALIFY row_number() OVER (PARTITION BY sentiment_code, product_category, video_id, cej_scene_code, aspect_key, key
      ORDER BY round(opinion_score, 9) DESC, like_count DESC NULLS LAST, opinion_id) = 1)""",
    """branked AS (SELECT *, row_number() OVER w AS r, count(*) OVER (PARTITION BY sentiment_code, product_category, video_id, cej_scene_code, aspect_key) AS cluster_size,
      sum(coalesce(like_count, 0)) OVER (PARTITION BY sentiment_code, product_category, video_id, cej_scene_code, aspect_key) AS likes FROM bonce
      WINDOW w AS (PARTITION BY sentiment_code, product_category, video_id, cej_scene_code, aspect_key ORDER BY round(opinion_score, 9) DESC, like_count DESC NULLS LAST, opinion_id))""",
    """btop AS (SELECT *, opinion_score + least(10, log10(1 + cluster_size) * 5) + 0.5 * least(10, log10(1 + likes) * 4) AS bundle_score FROM branked WHERE r = 1)""",
    """bdis AS (SELECT * FROM btop QUALIFY row_number() OVER (PARTITION BY sentiment_code, product_category, video_id, aspect_key, key ORDER BY round(bundle_score, 9) DESC, cluster_size DESC, opinion_id) = 1)""",
    """bfin AS (SELECT *, row_number() OVER (PARTITION BY sentiment_code ORDER BY round(bundle_score, 9) DESC, cluster_size DESC, opinion_id) AS rank FROM bdis QUALIFY rank <= 5)""",
]


@query("bundles", with_sql(*BUNDLES) + """
SELECT b.sentiment_code, b.rank, b.aspect_key, b.cej_scene_code, b.product_category, b.video_id AS brand_mentioned, b.cluster_size, CAST(round(b.bundle_score, 6) AS DOUBLE) AS bundle_score,
       b.opinion_id AS top_opinion_id, s.samples FROM bfin b JOIN (
  SELECT sentiment_code, product_category, video_id, cej_scene_code, aspect_key, string_agg(opinion_id, ',' ORDER BY r) AS samples FROM branked WHERE r <= 5 GROUP BY ALL) s
USING (sentiment_code, product_category, video_id, cej_scene_code, aspect_key)""")
def bundles(spark, sf):
    b = op.representative_bundles(_units(spark, sf))
    return b.select(
        "sentiment_code", "rank", "aspect_key", "cej_scene_code", "product_category", "brand_mentioned", "cluster_size",
        F.round("bundle_score", 6).alias("bundle_score"), "top_opinion_id",
        F.array_join(F.transform("sample_comments", lambda s: s["opinion_id"]), ",").alias("samples"),
    )


@query("representative_section", with_sql(*BUNDLES) + """
SELECT CASE sentiment_code WHEN 'positive' THEN 'positive_top5_bundles' ELSE 'negative_top5_bundles' END AS section, count(*) AS n,
       string_agg(opinion_id, ',' ORDER BY rank) AS tops FROM (SELECT sentiment_code, rank, comment_id AS opinion_id FROM bfin) GROUP BY sentiment_code""")
def representative_section(spark, sf):
    b = op.representative_bundles(_units(spark, sf))
    tops = F.transform("bundles", lambda x: x["top_comment"]["source_content_id"])
    return op.representative_section(b).select("section", F.size("bundles").alias("n"), F.array_join(tops, ",").alias("tops"))


@query("source_records", with_sql(*UNIT_CTES) + """
SELECT comment_id AS source_content_id, count(*) AS opinion_count, bool_or(spam) AS duplicate_opinion_flag, string_agg(opinion_id, ',' ORDER BY pos) AS unit_ids
FROM units GROUP BY 1""")
def source_records(spark, sf):
    r = op.source_records(_units(spark, sf))
    ids = F.array_join(F.transform("opinion_units", lambda u: u["opinion_id"]), ",")
    return r.select("source_content_id", "opinion_count", "duplicate_opinion_flag", ids.alias("unit_ids"))


@query("unit_monitoring", with_sql(*UNIT_CTES) + """
SELECT count(DISTINCT comment_id) AS source_count, count(*) AS opinion_count, count(*) FILTER (sentiment_code = 'positive') AS positive_count,
       count(*) FILTER (sentiment_code = 'negative') AS negative_count FROM units""")
def unit_monitoring(spark, sf):
    m = ds.monitoring_summary(_units(spark, sf))
    return m.select("source_count", "opinion_count", "positive_count", "negative_count")


@query("model_numbers", r"""
SELECT DISTINCT doc_id, t AS model FROM (SELECT doc_id, unnest(regexp_extract_all(upper(text), '\b[A-Z0-9]{4,}(?:[-_][A-Z0-9]+)*\b')) AS t FROM documents)
WHERE length(t) >= 5 AND regexp_matches(t, '[0-9]')""")
def model_numbers(spark, sf):
    return spread(table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", F.explode(op.model_tokens(F.col("text"))).alias("model"))


# Arrays and maps ----------------------------------------------------------------------------------

MAPS = r"""arr AS (SELECT comment_id, sentiment_label, list_distinct(regexp_extract_all(lower(text), '[a-z]{6,}')) AS words, video_id FROM docs),
tok AS (SELECT comment_id, sentiment_label, video_id, unnest(words) AS w FROM arr)"""


def _arrays(spark, sf):
    """Long words as topics and keywords; words that start with t are good, with e bad."""
    c = comments(spark, sf)
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{6,}"), F.lit(0)))
    tone = lambda w: F.when(w.startswith("t"), "positive").when(w.startswith("e"), "negative").otherwise("neutral")
    return c.select(
        "comment_id", "sentiment_label", "video_id", words.alias("nlp_topics"),
        F.map_from_entries(F.transform(words, lambda w: F.struct(w, tone(w)))).alias("nlp_topic_sentiments"),
        words.alias("nlp_keywords"), F.array("video_id").alias("nlp_product_mentions"),
    )


@query("array_topic_pivot", with_sql(DOCS, MAPS) + """
SELECT w AS topic, count(*) FILTER (w LIKE 't%') AS positive_count, count(*) FILTER (w LIKE 'e%') AS negative_count,
       count(*) FILTER (NOT w LIKE 't%' AND NOT w LIKE 'e%') AS neutral_count, count(*) AS total,
       CASE WHEN w LIKE 't%' THEN 'positive' WHEN w LIKE 'e%' THEN 'negative' ELSE 'neutral' END AS dominant_sentiment,
       CASE WHEN w LIKE 'e%' THEN 1.0 ELSE 0.0 END::DOUBLE AS negative_rate FROM tok GROUP BY w""")
def array_topic_pivot(spark, sf):
    return ins.topic_pivot(_arrays(spark, sf))


@query("array_keyword_freq", with_sql(DOCS, MAPS) + """
SELECT keyword, p + n + u AS count, p AS positive_count, n AS negative_count, u AS neutral_count,
       CASE WHEN p >= n AND p >= u THEN 'positive' WHEN n >= u THEN 'negative' ELSE 'neutral' END AS dominant_sentiment
FROM (SELECT w AS keyword, count(*) FILTER (sentiment_label = 'positive') p, count(*) FILTER (sentiment_label = 'negative') n,
             count(*) FILTER (sentiment_label = 'neutral') u FROM tok GROUP BY 1)""")
def array_keyword_freq(spark, sf):
    return ins.keyword_frequency(_arrays(spark, sf))


@query("product_mentions", with_sql(DOCS) + """
SELECT product, p + n + u AS mention_count, p AS positive_count, n AS negative_count, u AS neutral_count,
       round(CASE WHEN p + n + u = 0 THEN 0 ELSE n / (p + n + u) END, 4) AS negative_rate
FROM (SELECT video_id AS product, count(*) FILTER (sentiment_label = 'positive') p, count(*) FILTER (sentiment_label = 'negative') n,
             count(*) FILTER (sentiment_label = 'neutral') u FROM docs GROUP BY 1)""")
def product_mentions(spark, sf):
    return ins.product_mentions(_arrays(spark, sf))


@query("inquiries", with_sql(DOCS) + rf"""
SELECT comment_id, length(trim(text, E' \n\t\r')) AS n, product_mentions FROM (SELECT comment_id, trim(text, E' \n\t\r') AS v, text, video_id AS product_mentions, lower(text) AS b, toxic FROM docs)
WHERE toxic IS NOT NULL AND (contains(v, '?') OR {sql_any('b', TRUTH.inquiry_markers)}) AND NOT contains(b, 'whwhwh') AND NOT (contains(b, 'hahaha') AND NOT contains(v, '?'))
  AND NOT (NOT {sql_any('b', TRUTH.usage_markers)} AND length(v) > 140) AND NOT (length(v) > 520 AND NOT contains(v, '?'))""")
def inquiries(spark, sf):
    c = comments(spark, sf).withColumns({"nlp_is_inquiry": F.col("toxic").isNotNull(), "cleaned_text": F.col("text"), "nlp_product_mentions": F.array("video_id")})
    return ins.inquiries(c, TRUTH).select("comment_id", F.length(F.regexp_replace("text", r"^\s+|\s+$", "")).alias("n"), "product_mentions")


@query("negative_summaries", with_sql(DOCS) + """
SELECT comment_id, like_count FROM docs WHERE sentiment_label = 'negative' AND text <> '' ORDER BY like_count DESC NULLS LAST, comment_id LIMIT 5""")
def negative_summaries(spark, sf):
    c = comments(spark, sf).withColumns({"nlp_summary": F.col("text"), "nlp_label": F.col("sentiment_label"), "nlp_confidence": F.col("like_count")})
    return ins.negative_summaries(c).select("comment_id", "like_count")


@query("enrichment_health", with_sql(DOCS) + """
SELECT count(*) AS comments, round(count(*) FILTER (quality IS NOT NULL) / count(*), 4) AS coverage,
       CASE WHEN count(*) FILTER (quality IS NOT NULL) / count(*) >= 0.5 THEN 'ok' WHEN count(*) FILTER (quality IS NOT NULL) / count(*) >= 0.15 THEN 'partial' ELSE 'fallback' END AS status
FROM docs""")
def enrichment_health(spark, sf):
    c = comments(spark, sf)
    return ins.enrichment_health(c.withColumn("nlp_label", F.when(F.col("quality").isNotNull(), F.col("sentiment_label"))))
