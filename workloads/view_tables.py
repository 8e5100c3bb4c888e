"""Filters, labels, video relevance and summaries, and representative cards."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxframe.operators import cards as cd
from voxframe.operators import filters as fl
from voxframe.operators import videos as vd
from voxframe.operators.relational import union_all
from voxframe.operators.similar import ids_to_texts
from workloads.bindings import DOCS, EV, VIDEOS, comments, labelled_events, sql_any, table, videos, with_sql
from workloads.registry import query

SPEC = fl.FilterSpec(products=("p0", "p2"), regions=("r0", "그 외"), sentiments=("negative", "mixed"), brands=("b1", "b2", "b3"), inquiries="only",
                     relevant_only=True, known_regions=("r0",))


def _facet_input(spark, sf):
    e = labelled_events(spark, sf).withColumns({"brand": F.col("brand_label"), "relevant_comment": F.col("like_count") >= 5})
    units = e.select(F.col("comment_id").alias("source_content_id"), "product", "region", F.col("brand_label").alias("brand_mentioned"),
                     F.col("sentiment_label").alias("sentiment_code"), (F.col("like_count") >= 10).alias("inquiry_flag"))
    return e, units


FACET = """base AS (SELECT * FROM ev WHERE product IN ('p0', 'p2') AND brand_label IN ('b1', 'b2', 'b3') AND comment_id IN (
  SELECT comment_id FROM ev WHERE product IN ('p0', 'p2') AND brand_label IN ('b1', 'b2', 'b3') AND sentiment_label IN ('negative', 'mixed') AND like_count >= 10))"""


@query("facet_filter", with_sql(EV, FACET) + "SELECT comment_id, product, sentiment_label FROM base WHERE like_count >= 5 AND sentiment_label IN ('negative', 'mixed')")
def facet_filter(spark, sf):
    e, units = _facet_input(spark, sf)
    return fl.filtered_bundle(SPEC, e, videos(spark, sf), units)["comments"].select("comment_id", "product", "sentiment_label")


@query("facet_counts", with_sql(EV, FACET) + """
SELECT count(*) FILTER (comment_validity = 'excluded' AND sentiment_label IN ('negative', 'mixed')) AS removed_count,
  count(*) FILTER (comment_validity = 'valid' AND sentiment_label IN ('negative', 'mixed')) AS meaningful_count,
  (SELECT count(*) FROM ev WHERE product IN ('p0', 'p2') AND brand_label IN ('b1', 'b2', 'b3') AND sentiment_label IN ('negative', 'mixed') AND like_count >= 10) AS inquiry_count,
  count(*) AS before_relevance_count, count(*) AS after_relevance_count FROM base""")
def facet_counts(spark, sf):
    e, units = _facet_input(spark, sf)
    return fl.filtered_bundle(SPEC, e, videos(spark, sf), units)["counts"]


@query("cleared_facets", """
SELECT 'open' AS scenario, count(*) AS n FROM events UNION ALL SELECT 'cleared', 0 UNION ALL SELECT 'without_inquiries', count(*) FROM events WHERE floor(value) < 10
UNION ALL SELECT 'other_region', count(*) FROM events WHERE user_id % 2 = 1 UNION ALL SELECT 'one_brand', count(*) FROM events WHERE user_id % 5 = 3
UNION ALL SELECT 'relevant', count(*) FROM events WHERE floor(value) >= 5""")
def cleared_facets(spark, sf):
    """Six filter scenarios: open, cleared, without inquiries, only unknown regions, one brand, relevant ones."""
    e, units = _facet_input(spark, sf)
    v = videos(spark, sf)
    scenarios = {
        "open": fl.FilterSpec(), "cleared": fl.FilterSpec(products=()), "without_inquiries": fl.FilterSpec(inquiries="without"),
        "other_region": fl.FilterSpec(regions=("그 외",), known_regions=("r0",)), "one_brand": fl.FilterSpec(brands=("b3",)), "relevant": fl.FilterSpec(relevant_only=True),
    }
    parts = [fl.filtered_bundle(s, e, v, units)["comments"].agg(F.lit(n).alias("scenario"), F.count("*").alias("n")) for n, s in scenarios.items()]
    return union_all(parts)


@query("keyword_filter", with_sql(DOCS) + """
SELECT comment_id, contains(lower(text), 'theron') AND contains(lower(text), 'shing') AS all_terms, contains(lower(text), 'theron') OR contains(lower(text), 'elle') AS any_term
FROM docs""")
def keyword_filter(spark, sf):
    c = comments(spark, sf).withColumn("cleaned_text", F.col("text"))
    both, either = fl.keyword_mask(c, "Theron, SHING ,theron"), fl.keyword_mask(c, "theron,,elle", "OR")
    return c.select("comment_id", both.alias("all_terms"), either.alias("any_term"))


@query("filter_options", with_sql(EV, VIDEOS) + """
SELECT product, list_position(['p3', 'p1', 'p9', 'p0'], product) - 1 AS position FROM (SELECT product FROM ev UNION SELECT product FROM videos) WHERE product IN ('p3', 'p1', 'p9', 'p0')""")
def filter_options(spark, sf):
    return fl.filter_options(labelled_events(spark, sf), videos(spark, sf), "product", ("p3", "p1", "p9", "p0"))


@query("localized_columns", with_sql(EV) + """
SELECT comment_id, CASE WHEN comment_validity = 'valid' THEN sentiment_label ELSE 'excluded' END AS sentiment_code,
  CASE WHEN comment_validity <> 'valid' THEN '제외' WHEN sentiment_label = 'positive' THEN '긍정' WHEN sentiment_label = 'negative' THEN '부정' WHEN sentiment_label = 'neutral' THEN '중립' ELSE sentiment_label END AS sentiment,
  CASE event_type WHEN 'view' THEN '사용' WHEN 'purchase' THEN '구매' ELSE '기타' END AS stage, CASE brand_label WHEN 'b1' THEN 'Samsung' WHEN 'b2' THEN '미언급' ELSE brand_label END AS brand,
  strftime(date_trunc('week', published_at), '%Y-%m-%d') AS week_start FROM ev""")
def localized_columns(spark, sf):
    e = labelled_events(spark, sf)
    e = e.withColumns(
        {
            "topic_label": F.when(F.col("event_type") == "view", "Usage").when(F.col("event_type") == "purchase", "purchase").otherwise("nowhere"),
            "brand_label": F.when(F.col("brand_label") == "b1", "SAMSUNG").when(F.col("brand_label") == "b2", "none").otherwise(F.col("brand_label")),
        }
    )
    return fl.localized_columns(e).select("comment_id", "sentiment_code", "sentiment", "stage", "brand", "week_start")


@query("product_labels", """
SELECT p_partkey, CASE WHEN p_name = 'red ring' THEN '냉장고' WHEN contains(p_name, 'gear') THEN 'gears' WHEN contains(p_name, 'bolt') THEN 'bolts' ELSE '' END AS product FROM part""")
def product_labels(spark, sf):
    p = table(spark, sf, "part")
    name = F.when(F.col("p_name") == "red ring", "냉장고   리뷰").otherwise(F.col("p_name"))
    return p.select("p_partkey", fl.canonical_product(name, aliases={"gear": "gears", "bolt": "bolts"}).alias("product"))


POLICY = vd.SelectionPolicy(target_brands=("Brand#1",), competitors=("brand#2", "brand#5"), products=("ring", "widget"), preferred_channels=("economy",), blocked_channels=("medium",))
PART = """pv AS (SELECT p_partkey, lower(p_name || '  ' || p_type || '  ' || p_brand || ' ') AS blob, lower(p_type) AS ch, p_name, p_brand, p_size, p_retailprice FROM part),
ph AS (SELECT *, contains(blob, 'brand#1') AS tg, contains(blob, 'ring') OR contains(blob, 'widget') AS pd, contains(blob, 'brand#2') OR contains(blob, 'brand#5') AS cp,
  contains(ch, 'economy') AS pf, contains(ch, 'medium') AS bl FROM pv)"""


def _part_videos(spark, sf):
    p = table(spark, sf, "part")
    return p.select(
        "p_partkey", F.col("p_partkey").cast("string").alias("video_id"), F.col("p_name").alias("title"), F.col("p_type").alias("channel_title"), F.array("p_brand").alias("tags"),
        (F.col("p_size") * 200).cast("bigint").alias("comment_count"), (F.col("p_retailprice") * 1000).cast("bigint").alias("view_count"),
        (F.col("p_partkey") % 40 + 1).alias("search_rank"), F.lit("Ring").alias("keyword"),
    )


@query("video_relevance", with_sql(PART) + """
SELECT p_partkey, CAST(round(s, 3) AS DOUBLE) AS video_relevance_score, s >= 0.45 AND (pd OR pf) AND NOT bl AS is_relevant_video, tg AS target_brand_hit, pd AS product_hit, pf AS preferred_channel_hit
FROM (SELECT *, least(1, greatest(0, CASE WHEN tg THEN 0.45 ELSE 0 END + CASE WHEN pd THEN 0.35 ELSE 0 END + CASE WHEN pf THEN 0.30 ELSE 0 END - CASE WHEN cp AND NOT tg THEN 0.40 ELSE 0 END)) AS s
      FROM (SELECT * EXCLUDE (pd), true AS pd FROM ph))""")
def video_relevance(spark, sf):
    """The search word names a product, so it is part of the text that is matched."""
    out = vd.annotate_relevance(_part_videos(spark, sf), POLICY)
    return out.select("p_partkey", "video_relevance_score", "is_relevant_video", "target_brand_hit", "product_hit", "preferred_channel_hit")


@query("relevance_reasons", with_sql(PART) + """
SELECT p_partkey, concat_ws(', ', CASE WHEN tg THEN '브랜드 직접 언급' END, '제품 키워드 일치', CASE WHEN pf THEN '우선 채널 매칭' END) AS reason FROM ph""")
def relevance_reasons(spark, sf):
    out = vd.annotate_relevance(_part_videos(spark, sf), POLICY)
    return out.select("p_partkey", vd.relevance_reason(out).alias("reason"))


@query("selected_videos", with_sql(PART) + """
SELECT p_partkey FROM (SELECT *, CAST(CASE WHEN pf THEN 40 ELSE 0 END + CASE WHEN tg THEN 24 ELSE 0 END + CASE WHEN pd THEN 12 ELSE 0 END AS DOUBLE) + CAST(least(p_size * 200, 5000) AS DOUBLE) / 120.0
   + CAST(least(CAST(floor(p_retailprice * 1000) AS BIGINT), 2000000) AS DOUBLE) / 200000.0 + greatest(0, 25 - least(p_partkey % 40 + 1, 25)) + CASE WHEN contains(p_name, 'ring') THEN 5 ELSE 0 END AS s FROM ph)
ORDER BY round(s, 6) DESC, p_partkey % 40 + 1, p_size * 200 DESC, CAST(p_partkey AS VARCHAR) LIMIT 50""")
def selected_videos(spark, sf):
    out = vd.select_videos(_part_videos(spark, sf), POLICY).withColumn("selection_score", F.round("selection_score", 6))
    return out.orderBy(*vd.selection_order()).limit(50).select("p_partkey")


@query("aspect_labels", """
SELECT p_partkey, CASE p_brand WHEN 'Brand#1' THEN '성능' WHEN 'Brand#2' THEN '내구성' WHEN 'Brand#3' THEN '제품 경험' ELSE p_brand END AS aspect FROM part""")
def aspect_labels(spark, sf):
    """The shipped names of aspects; unknown ones stay, empty ones are the product experience."""
    p = table(spark, sf, "part")
    raw = F.when(F.col("p_brand") == "Brand#1", "Performance").when(F.col("p_brand") == "Brand#2", " Durability ").when(F.col("p_brand") == "Brand#3", "").otherwise(F.col("p_brand"))
    return p.select("p_partkey", cd.aspect_label(raw).alias("aspect"))


@query("selection_score", with_sql(PART) + """
SELECT p_partkey, NOT bl AND (pd OR pf) AND NOT (cp AND NOT tg) AS is_relevant_video,
  CAST(round(CASE WHEN pf THEN 40 ELSE 0 END + CASE WHEN tg THEN 24 ELSE 0 END + CASE WHEN pd THEN 12 ELSE 0 END + least(p_size * 200, 5000) / 120.0
   + least(CAST(floor(p_retailprice * 1000) AS BIGINT), 2000000) / 200000.0 + greatest(0, 25 - least(p_partkey % 40 + 1, 25)) + CASE WHEN contains(p_name, 'ring') THEN 5 ELSE 0 END, 4) AS DOUBLE) AS selection_score FROM ph""")
def selection_score(spark, sf):
    out = vd.select_videos(_part_videos(spark, sf), POLICY)
    return out.select("p_partkey", "is_relevant_video", F.round("selection_score", 4).alias("selection_score"))


@query("video_summary", with_sql(EV, VIDEOS) + """,
s AS (SELECT video_id, count(*) AS n, count(*) FILTER (sentiment_label = 'positive') AS p, count(*) FILTER (sentiment_label = 'negative') AS g, count(*) FILTER (sentiment_label = 'neutral') AS u,
  count(*) FILTER (comment_validity = 'excluded') AS x, coalesce(sum(like_count) FILTER (sentiment_label = 'positive'), 0) AS pl, coalesce(sum(like_count) FILTER (sentiment_label = 'negative'), 0) AS gl FROM ev GROUP BY 1),
j AS (SELECT v.video_id, coalesce(n, 0) AS n, coalesce(p, 0) AS p, coalesce(g, 0) AS g, coalesce(u, 0) AS u, coalesce(x, 0) AS x,
  CAST(round(coalesce(g + least(20, gl / 20.0), 0), 3) AS DOUBLE) AS gi, CAST(round(coalesce(p + least(20, pl / 20.0), 0), 3) AS DOUBLE) AS pi FROM videos v LEFT JOIN s USING (video_id)),
k AS (SELECT *, g / greatest(1, p + g + u) AS gd, p / greatest(1, p + g + u) AS pd FROM j)
SELECT video_id, n AS comments, p AS positive_comments, g AS negative_comments, u AS neutral_comments, x AS excluded_comments, gi AS negative_impact, pi AS positive_impact,
  CAST(round(gd, 6) AS DOUBLE) AS negative_density, CASE WHEN gi >= pi + 2 AND g >= greatest(2, p) THEN '부정 우세' WHEN pi >= gi + 2 AND p >= greatest(2, g) THEN '긍정 우세' WHEN gd >= pd + 0.12 THEN '부정 우세'
  WHEN pd >= gd + 0.12 THEN '긍정 우세' ELSE '혼합' END AS reaction_type FROM k""")
def video_summary(spark, sf):
    out = vd.video_summary(labelled_events(spark, sf), videos(spark, sf))
    return out.select(
        "video_id", "comments", "positive_comments", "negative_comments", "neutral_comments", "excluded_comments", "negative_impact", "positive_impact",
        F.round("negative_density", 6).alias("negative_density"), "reaction_type",
    )


@query("negative_context", with_sql(EV) + """,
r AS (SELECT * FROM ev WHERE comment_validity = 'valid'),
t AS (SELECT keyword, product, count(*) AS n, count(*) FILTER (sentiment_label = 'negative') AS g, max(published_at) FILTER (sentiment_label = 'negative') AS e FROM r GROUP BY 1, 2),
s AS (SELECT keyword, product, count(*) FILTER (published_at >= e - INTERVAL 14 DAYS) AS recent, count(*) FILTER (published_at < e - INTERVAL 14 DAYS AND published_at >= e - INTERVAL 28 DAYS) AS previous
  FROM r JOIN t USING (keyword, product) WHERE sentiment_label = 'negative' GROUP BY 1, 2)
SELECT keyword AS topic_label, product, n AS comments, g AS negative_comments, recent, previous, round(g / n, 4) AS negative_share,
  CASE WHEN recent + previous = 0 THEN '추세 데이터 부족' WHEN recent >= previous + 2 THEN '최근 증가' WHEN previous >= recent + 2 THEN '최근 감소' ELSE '최근 안정' END AS trend,
  CASE WHEN g >= 4 THEN '지속 이슈' ELSE '일회성 신호' END AS recurrence FROM t JOIN s USING (keyword, product)""")
def negative_context(spark, sf):
    return vd.negative_context(labelled_events(spark, sf).withColumn("topic_label", F.col("keyword")))


@query("priority_buckets", with_sql(EV) + """
SELECT video_id, CASE WHEN share >= 3 OR n >= 20 THEN '즉시 관리' WHEN asked OR share >= 1.5 OR n >= 8 THEN '우선 관찰' ELSE '모니터링' END AS bucket
FROM (SELECT video_id, count(*) AS n, count(*) FILTER (sentiment_label = 'negative') * 10.0 / count(*) AS share, bool_or(like_count > 60) AS asked FROM ev GROUP BY 1)""")
def priority_buckets(spark, sf):
    g = labelled_events(spark, sf).groupBy("video_id").agg(
        F.count("*").alias("n"), (F.count_if(F.col("sentiment_label") == "negative") * 10.0 / F.count("*")).alias("share"), F.bool_or(F.col("like_count") > 60).alias("asked")
    )
    return g.select("video_id", vd.priority_bucket(F.lit(""), F.col("share"), F.col("n"), F.col("asked")).alias("bucket"))


@query("comment_showcase", with_sql(DOCS) + """,
pool AS (SELECT comment_id, like_count, length(text) AS n, quality FROM docs WHERE sentiment_label = 'positive')
SELECT comment_id FROM pool ORDER BY round(CAST(coalesce(like_count, 0) * 1.5 + n * 0.04 AS DOUBLE), 9) DESC, coalesce(like_count, 0) DESC, comment_id LIMIT 10""")
def comment_showcase(spark, sf):
    c = comments(spark, sf).withColumns({"text_length": F.length("text"), "sentiment_score": F.lit(0.0)})
    return cd.comment_showcase(c, "positive", 10).select("comment_id")


@query("bundle_showcase", with_sql(DOCS) + """,
p AS (SELECT comment_id, coalesce(like_count, 0) AS l, length(text) AS n, product, region FROM docs WHERE sentiment_label = 'positive'),
shown AS (SELECT *, round(CAST(l * 1.5 + n * 0.04 AS DOUBLE), 9) AS s FROM p),
one AS (SELECT * FROM shown QUALIFY row_number() OVER (PARTITION BY product, region ORDER BY s DESC, comment_id) = 1),
smp AS (SELECT product, region, max(c) AS cluster_size, string_agg(comment_id, ',' ORDER BY r) AS samples FROM (
  SELECT *, row_number() OVER (PARTITION BY product, region ORDER BY l DESC, n DESC, comment_id) AS r, count(*) OVER (PARTITION BY product, region) AS c FROM p) WHERE r <= 5 GROUP BY 1, 2)
SELECT comment_id, cluster_size, samples FROM one JOIN smp USING (product, region) ORDER BY s DESC, comment_id LIMIT 5""")
def bundle_showcase(spark, sf):
    c = comments(spark, sf).withColumns({"text_length": F.length("text"), "sentiment_score": F.lit(0.0), "like_count": F.coalesce("like_count", F.lit(0))})
    out = cd.bundle_showcase(c, "positive", ["product", "region"])
    return out.select("comment_id", "cluster_size", F.array_join("samples", ",").alias("samples"))


@query("problem_signals", with_sql(DOCS) + f"""
SELECT comment_id, CASE WHEN sentiment_label = 'positive' AND contains(b, 'clean') THEN 'advocacy_signal' WHEN sentiment_label IN ('negative', 'mixed') AND ({sql_any('b', ('manual', 'scrub'))}) THEN 'manual_intervention'
  WHEN (contains(b, 'odor') OR contains(b, 'smell')) AND sentiment_label IN ('negative', 'mixed') THEN 'odor_leakage' WHEN {sql_any('b', ('scrub', 'manual'))} THEN 'manual_intervention'
  WHEN {sql_any('b', ('fail', 'broken'))} THEN 'reliability_failure' WHEN {sql_any('b', ('a/s', 'as'))} THEN 'service_response_gap' WHEN {sql_any('b', ('price', 'cost', 'money', 'expensive'))} THEN 'pricing_contract_gap'
  ELSE 'general_experience' END AS signal_name FROM (SELECT comment_id, sentiment_label, lower(text) AS b FROM docs)""")
def problem_signals(spark, sf):
    c = comments(spark, sf).withColumn("b", F.lower("text"))
    return c.select("comment_id", cd.problem_signal(F.col("b"), F.col("sentiment_label")).alias("signal_name"))


DOMAIN_POINTS = {
    "product": "2 * (stage = '사용')::INT + (stage IN ('관리', '교체'))::INT + 3 * (sig = 'odor_leakage')::INT",
    "operations / service": "3 * (stage = '배송')::INT + 2 * (stage = '관리')::INT + (stage = '기타')::INT + (sentiment_label = 'negative')::INT",
    "business / policy": "2 * (stage IN ('구매', '교체'))::INT + 3 * (sig = 'pricing_contract_gap')::INT",
    "UX / guide": "(stage = '사용')::INT + (sentiment_label = 'mixed')::INT",
    "marketing / message": "(stage = '구매')::INT + 2 * (sig = 'advocacy_signal')::INT + (sentiment_label = 'positive')::INT",
}
DOMAIN_BEST = "greatest(" + ", ".join(DOMAIN_POINTS.values()) + ")"


@query("action_domains", with_sql(EV) + """
SELECT comment_id, CASE """ + " ".join(f"WHEN {e} = {DOMAIN_BEST} THEN '{d}'" for d, e in DOMAIN_POINTS.items()) + """ END AS action_domain
FROM (SELECT *, CASE product WHEN 'p0' THEN '사용' WHEN 'p1' THEN '배송' WHEN 'p2' THEN '구매' ELSE '기타' END AS stage,
  CASE brand_label WHEN 'b0' THEN 'odor_leakage' WHEN 'b1' THEN 'pricing_contract_gap' WHEN 'b2' THEN 'advocacy_signal' ELSE 'general_experience' END AS sig FROM ev)""")
def action_domains(spark, sf):
    e = labelled_events(spark, sf)
    p, b = F.col("product"), F.col("brand_label")
    stage = F.when(p == "p0", "사용").when(p == "p1", "배송").when(p == "p2", "구매").otherwise("기타")
    signal = F.when(b == "b0", "odor_leakage").when(b == "b1", "pricing_contract_gap").when(b == "b2", "advocacy_signal").otherwise("general_experience")
    e = e.withColumns({"stage": stage, "sig": signal})
    return e.select("comment_id", cd.action_domain(F.col("stage"), F.col("sentiment_label"), F.col("sentiment_label") == "mixed", F.col("sig")).alias("action_domain"))


@query("issue_strength", with_sql(EV) + """
SELECT comment_id, CASE WHEN s >= 0.72 THEN '높음' WHEN s >= 0.52 THEN '중간' ELSE '보통' END AS level, s AS score FROM (
  SELECT comment_id, round(CAST(least(0.99, 0.28 + CASE sentiment_label WHEN 'negative' THEN 0.22 WHEN 'positive' THEN 0.16 ELSE 0.1 END + CASE region WHEN 'r0' THEN 0.16 ELSE 0.03 END
    + CASE WHEN comment_validity = 'valid' THEN 0.06 ELSE 0 END + least(0.14, (reply_count + 1) / 180.0) + least(0.08, like_count / 300.0) + 0.05) AS DOUBLE), 6) AS s FROM ev)""")
def issue_strength(spark, sf):
    e = labelled_events(spark, sf).withColumns(
        {"signal_strength": F.when(F.col("region") == "r0", "strong").otherwise("weak"), "inquiry_flag": F.col("comment_validity") == "valid", "cluster_size": F.col("reply_count") + 1, "text_display": F.lit("")}
    )
    return e.select("comment_id", cd.issue_strength(e, F.array("keyword")).alias("s")).select("comment_id", "s.level", "s.score")


@query("claim_directions", with_sql(DOCS) + f"""
SELECT comment_id, CASE WHEN g > p THEN -1 WHEN p > g THEN 1 ELSE 0 END AS direction FROM (
  SELECT comment_id, {' + '.join(f"CAST(contains(b, '{w.replace(chr(39), chr(39) * 2)}') AS INTEGER)" for w in cd.CLAIM_NEGATIVE)} AS g, {' + '.join(f"CAST(contains(b, '{w}') AS INTEGER)" for w in cd.CLAIM_POSITIVE)} AS p
  FROM (SELECT comment_id, lower(text) AS b FROM docs))""")
def claim_directions(spark, sf):
    c = comments(spark, sf).withColumn("b", F.lower("text"))
    return c.select("comment_id", cd.claim_direction(F.col("b")).alias("direction"))


@query("card_enrichment", with_sql(EV) + """,
src AS (SELECT comment_id AS source_content_id, video_id AS video_link, CASE WHEN region = 'r0' THEN keyword ELSE '' END AS note FROM ev)
SELECT c.comment_id, coalesce(nullif(s.note, ''), (SELECT nullif(arg_min(note, source_content_id), '') FROM src x WHERE x.video_link = c.video_id), '') AS note
FROM ev c LEFT JOIN src s ON s.source_content_id = c.comment_id""")
def card_enrichment(spark, sf):
    e = labelled_events(spark, sf)
    source = e.select(F.col("comment_id").alias("source_content_id"), F.col("video_id").alias("video_link"), F.when(F.col("region") == "r0", F.col("keyword")).otherwise("").alias("note"))
    cards = e.select("comment_id", F.col("comment_id").alias("source_content_id"), F.col("video_id").alias("video_link"))
    return cd.enrich_cards(cards, source, ["note"]).select("comment_id", "note")


@query("ids_to_texts", """
SELECT conv_id, array_to_string(list_transform(list_filter([a, b], lambda x: x IS NOT NULL AND x <> ''), lambda x: CAST(length(x) AS VARCHAR)), ',') AS lengths FROM (
  SELECT conv_id, max(text) FILTER (turn = 1) AS a, max(text) FILTER (turn = 0) AS b FROM conversations GROUP BY 1)""")
def texts_of_ids(spark, sf):
    c = table(spark, sf, "conversations").withColumn("comment_id", F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")))
    ids = F.array(F.concat(F.col("conv_id").cast("string"), F.lit("-1")), F.concat(F.col("conv_id").cast("string"), F.lit("-0")), F.lit("none"))
    groups = c.select("conv_id").distinct().withColumn("ids", ids)
    out = ids_to_texts(groups, "ids", c, ["conv_id"], "text")
    return out.select("conv_id", F.array_join(F.transform("representative_comments", lambda t: F.length(t).cast("string")), ",").alias("lengths"))
