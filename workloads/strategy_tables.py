"""Strategy insights, the issue table, supporting comments and similar comments over truth rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxframe.operators import similar as sm
from voxframe.operators import strategy as st
from voxframe.operators import truth as tr
from voxframe.operators.relational import top_per_group
from voxframe.session import materialize
from workloads.bindings import with_sql
from workloads.label_tables import TRUTH, TRUTH_SQL, truth_input
from workloads.registry import query


def truth_rows(spark, sf):
    """Truth table of all documents, held in the shared folder as a run would."""
    keep = ["product", "region", "like_count", "reply_count", "published_at", "classification_type"]
    return materialize(tr.build_truth(truth_input(spark, sf), TRUTH, keep=keep))


def representatives(rows):
    """The eight best-liked eligible comments of each polarity."""
    order = [F.col("like_count").desc_nulls_last(), F.col("comment_id")]
    return top_per_group(rows.where("representative_eligibility"), ["sentiment_final"], order, 8)


STRATEGY = [
    *TRUTH_SQL,
    """reps AS (SELECT * FROM truth WHERE representative_eligibility
      QUALIFY row_number() OVER (PARTITION BY sentiment_final ORDER BY like_count DESC NULLS LAST, comment_id) <= 8)""",
    r"""sbase AS (SELECT *, coalesce(journey_stage, '') AS stage, coalesce(judgment_axes[1], 'unknown_axis') AS axis, coalesce(like_count, 0) + 1.5 * coalesce(reply_count, 0) AS reach,
      CASE WHEN len(wds) > 0 THEN md5(array_to_string(wds, '|')) ELSE 'general_signal' END AS sig FROM (
        SELECT *, list_filter(string_split_regex(trim(regexp_replace(regexp_replace(lower(text || ' ' || cls), '[^\p{L}\p{M}\p{N}\p{Pc}\s]+', ' ', 'g'), '\s+', ' ', 'g')), '[\s,|;/]+'),
          lambda w: length(w) >= 2) AS wds FROM truth WHERE analysis_included AND hygiene_class <> 'trash'))""",
    """lvl AS (SELECT 'video' AS level_type, video_id AS level_id, * FROM sbase UNION ALL SELECT 'product_group', product, * FROM sbase)""",
    """clu AS (SELECT level_type, level_id, stage AS journey_stage, axis, sentiment_final AS polarity_direction, count(*) AS n,
      avg(CASE WHEN mixed_flag THEN 1.0 ELSE 0.0 END) AS mixed, sum(reach) AS impact, count(DISTINCT sig) AS sigs FROM lvl GROUP BY 1, 2, 3, 4, 5)""",
    """mainp AS (SELECT level_id, stage AS journey_stage, axis, sentiment_final AS polarity_direction, product AS main_product FROM lvl WHERE level_type = 'video'
      GROUP BY 1, 2, 3, 4, 5 QUALIFY row_number() OVER (PARTITION BY level_id, stage, axis, sentiment_final ORDER BY count(*) DESC, product) = 1)""",
    """reprow AS (SELECT *, unnest(judgment_axes) AS axis FROM reps),
    replvl AS (SELECT 'video' AS level_type, video_id AS level_id, comment_id, coalesce(journey_stage, '') AS journey_stage, axis, sentiment_final AS polarity_direction FROM reprow
      UNION ALL SELECT 'product_group', product, comment_id, coalesce(journey_stage, ''), axis, sentiment_final FROM reprow),
    repids AS (SELECT level_type, level_id, journey_stage, axis, polarity_direction, string_agg(comment_id, ',' ORDER BY comment_id) AS ids FROM (
      SELECT * FROM replvl QUALIFY row_number() OVER (PARTITION BY level_type, level_id, journey_stage, axis, polarity_direction ORDER BY comment_id) <= 5) GROUP BY 1, 2, 3, 4, 5)""",
    """strat AS (SELECT c.*, sum(n) OVER (PARTITION BY level_type, level_id) AS level_total, coalesce(ids, '') AS ids,
      CASE WHEN level_type = 'video' THEN coalesce(main_product, '') ELSE level_id END AS product_group FROM clu c
      LEFT JOIN repids USING (level_type, level_id, journey_stage, axis, polarity_direction)
      LEFT JOIN mainp m ON c.level_type = 'video' AND m.level_id = c.level_id AND m.journey_stage = c.journey_stage AND m.axis = c.axis AND m.polarity_direction = c.polarity_direction)""",
    """cand AS (SELECT *, round(least(100, ((n / level_total) * 0.55 + least(n, 30) / 30.0 * 0.30 + least(ln(1 + greatest(impact, 0)), 6) / 6.0 * 0.15 + mixed * 0.2)
      * CASE polarity_direction WHEN 'negative' THEN 1.25 WHEN 'mixed' THEN 1.1 WHEN 'positive' THEN 0.9 ELSE 0.6 END * 100), 1) AS priority,
      concat_ws('|', CASE WHEN n < 3 THEN 'cluster_lt_3' END, CASE WHEN journey_stage = '' THEN 'journey_stage_missing' END,
        CASE WHEN axis = 'unknown_axis' THEN 'judgment_axis_missing' END, CASE WHEN ids = '' THEN 'representative_link_missing' END) AS reasons FROM strat)""",
]
COLUMNS = """level_type, level_id, product_group, journey_stage, axis AS judgment_axis, polarity_direction, CAST(priority AS DOUBLE) AS priority_signal, n AS supporting_cluster_count, sigs AS distinct_signatures,
  ids AS supporting_representatives, round(mixed, 4) AS mixed_ratio, CAST(round(impact, 2) AS DOUBLE) AS impact_signal"""


def _flat(df):
    return df.select(
        "level_type", "level_id", "product_group", "journey_stage", F.col("judgment_axes")[0].alias("judgment_axis"), "polarity_direction", "priority_signal",
        "supporting_cluster_count", "distinct_signatures", F.array_join("supporting_representatives", ",").alias("supporting_representatives"), "mixed_ratio", "impact_signal",
    )


@query("strategy_candidates", with_sql(*STRATEGY) + f"SELECT {COLUMNS}, reasons AS insufficient_reasons FROM cand")
def strategy_candidates(spark, sf):
    rows = truth_rows(spark, sf)
    c = st.strategy_candidates(rows, representatives(rows), texts=False)
    reasons = c.select("level_type", "level_id", "journey_stage", "judgment_axes", "polarity_direction", "insufficient_reasons")
    return _flat(c.withColumn("supporting_representatives", F.col("supporting_representatives"))).join(
        reasons.select("level_type", "level_id", "journey_stage", F.col("judgment_axes")[0].alias("judgment_axis"), "polarity_direction",
                       F.array_join("insufficient_reasons", "|").alias("insufficient_reasons")),
        ["level_type", "level_id", "journey_stage", "judgment_axis", "polarity_direction"],
    )


@query("strategy_insights", with_sql(*STRATEGY) + f"SELECT {COLUMNS} FROM cand WHERE reasons = ''")
def strategy_insights(spark, sf):
    rows = truth_rows(spark, sf)
    return _flat(st.strategy_insights(st.strategy_candidates(rows, representatives(rows), texts=False)))


@query("strategy_texts", with_sql(*STRATEGY) + """
SELECT level_type, level_id, journey_stage, axis AS judgment_axis, polarity_direction,
  '동일 신호 ' || CAST(n AS VARCHAR) || '건 / 레벨 내 비중 ' || printf('%.1f', round(CAST(n AS DOUBLE) / level_total * 100, 1)) || '% / 문제 시그니처 ' || CAST(sigs AS VARCHAR) || '개 / 영향지표 ' || printf('%.1f', round(CAST(impact AS DOUBLE), 1)) AS evidence_summary
FROM cand""")
def strategy_texts(spark, sf):
    rows = truth_rows(spark, sf)
    c = st.strategy_candidates(rows, representatives(rows))
    return c.select("level_type", "level_id", "journey_stage", F.col("judgment_axes")[0].alias("judgment_axis"), "polarity_direction", "evidence_summary")


ISSUES = [
    *STRATEGY,
    """keyed AS (SELECT *, journey_stage AS st FROM cand),
    dirs AS (SELECT comment_id, video_id, product, published_at, coalesce(journey_stage, '') AS st, judgment_axes, unnest(list_filter([CASE WHEN sentiment_final <> 'mixed' THEN sentiment_final END,
      CASE WHEN mixed_flag THEN 'mixed' END], lambda x: x IS NOT NULL)) AS polarity_direction FROM truth WHERE journey_stage IS NOT NULL),
    drow AS (SELECT *, unnest(list_distinct(judgment_axes)) AS axis FROM dirs),
    ends AS (SELECT st, polarity_direction, axis, max(published_at) AS e FROM drow WHERE published_at IS NOT NULL GROUP BY 1, 2, 3),
    spans AS (SELECT st, polarity_direction, axis, count(*) FILTER (published_at > e - INTERVAL 14 DAYS) AS recent,
      count(*) FILTER (published_at > e - INTERVAL 28 DAYS AND published_at <= e - INTERVAL 14 DAYS) AS prev FROM drow JOIN ends USING (st, polarity_direction, axis) GROUP BY 1, 2, 3)""",
    """scope AS (SELECT 'video' AS level_type, video_id AS level_id, count(*) AS scope_size FROM truth GROUP BY 2 UNION ALL SELECT 'product_group', product, count(*) FROM truth GROUP BY 2)""",
    """iss AS (SELECT k.*, coalesce(recent, 0) AS recent, coalesce(prev, 0) AS prev, scope_size, least(n / scope_size, 1.0) AS ratio, reasons <> '' AS weak FROM keyed k
      LEFT JOIN spans s ON s.st = k.st AND s.polarity_direction = k.polarity_direction AND s.axis = k.axis JOIN scope USING (level_type, level_id))""",
    """iss2 AS (SELECT *, CASE WHEN weak OR recent + prev < 6 THEN '근거 부족' WHEN prev = 0 AND recent >= 3 THEN '신규' WHEN prev = 0 THEN '근거 부족'
      WHEN recent >= prev * 1.2 AND recent - prev >= 2 THEN '상승' WHEN recent <= prev * 0.8 AND prev - recent >= 2 THEN '완화' ELSE '지속' END AS issue_state,
      CASE WHEN weak THEN 'Low' WHEN impact >= 15000 OR n >= 500 OR ratio >= 0.08 THEN 'High' WHEN impact >= 3000 OR n >= 120 OR ratio >= 0.03 THEN 'Medium' ELSE 'Low' END AS impact_level,
      st IN ('maintenance', 'usage', 'delivery', 'onboarding') AS critical,
      (n >= 120 OR ratio >= 0.03 OR impact >= 5000) AS large, axis = 'service_after_sales' AS svc,
      axis IN ('maintenance_burden', 'durability_lifespan', 'installation_space_fit', 'design_interior_fit', 'automation_convenience', 'usage_pattern_fit') AS prd,
      axis IN ('brand_trust', 'comparison_substitute_judgment', 'price_value_fit', 'purchase_strategy_contract') AS mkt,
      st IN ('awareness', 'exploration', 'purchase', 'decision') AS early, st IN ('delivery', 'onboarding') AS hand FROM iss)""",
    """iss3 AS (SELECT *, CASE WHEN weak THEN 'Low'
        WHEN polarity_direction = 'negative' THEN CASE WHEN impact_level = 'High' THEN 'High' WHEN impact_level = 'Medium' THEN CASE WHEN critical THEN 'High' ELSE 'Medium' END
             WHEN critical AND n >= 30 THEN 'Medium' ELSE 'Low' END
        WHEN polarity_direction = 'mixed' THEN impact_level WHEN polarity_direction = 'positive' THEN CASE WHEN impact_level = 'High' THEN 'Medium' ELSE 'Low' END ELSE 'Low' END AS priority_level,
      CASE WHEN weak THEN 'monitor' WHEN polarity_direction = 'positive' THEN CASE WHEN large THEN 'maintain_strength' ELSE 'monitor' END
        WHEN polarity_direction = 'mixed' THEN CASE WHEN early AND mkt THEN 'marketing_message' WHEN hand OR svc THEN 'service_operation' WHEN prd THEN 'product_improvement' ELSE 'monitor' END
        WHEN polarity_direction = 'negative' THEN CASE WHEN large AND (critical OR svc OR prd) THEN 'immediate_fix' WHEN hand OR svc THEN 'service_operation'
             WHEN prd THEN 'product_improvement' WHEN mkt OR early THEN 'marketing_message' ELSE 'monitor' END ELSE 'monitor' END AS action_label,
      CASE WHEN level_type = 'video' THEN '영상' ELSE '제품군' END || '|' || level_id || '|' || journey_stage || '|["' || axis || '"]|' || polarity_direction AS issue_key FROM iss2)""",
    """issues AS (SELECT *, (CASE priority_level WHEN 'High' THEN 3 WHEN 'Medium' THEN 2 ELSE 1 END) AS pr, (CASE impact_level WHEN 'High' THEN 3 WHEN 'Medium' THEN 2 ELSE 1 END) AS ir FROM iss3)""",
]


def _issues(spark, sf):
    rows = truth_rows(spark, sf)
    candidates = materialize(st.strategy_candidates(rows, representatives(rows)))
    return rows, st.issue_table(candidates, rows)


@query("issue_table", with_sql(*ISSUES) + """
SELECT issue_key, issue_state, recent AS recent_count, prev AS previous_count, scope_size, round(ratio, 6) AS issue_ratio, impact_level, priority_level, action_label,
  CAST(round(pr * 100.0 + ir * 25.0 + n * 0.1 + ratio * 100.0 + CASE polarity_direction WHEN 'negative' THEN 0.25 WHEN 'mixed' THEN 0.1 ELSE 0 END, 6) AS DOUBLE) AS ranking_score FROM issues""")
def issue_table(spark, sf):
    _, t = _issues(spark, sf)
    return t.select(
        "issue_key", "issue_state", "recent_count", "previous_count", "scope_size", F.round("issue_ratio", 6).alias("issue_ratio"), "impact_level", "priority_level",
        "action_label", F.round("ranking_score", 6).alias("ranking_score"),
    )


ORDER = "pr DESC, ir DESC, n DESC, ratio DESC, priority DESC, issue_key"


@query("ranked_issues", with_sql(*ISSUES) + f"SELECT issue_key, row_number() OVER (ORDER BY {ORDER}) AS rank FROM issues QUALIFY rank <= 20")
def ranked_issues(spark, sf):
    return st.ranked_issues(_issues(spark, sf)[1], 20).select("issue_key", "rank")


@query("selected_video_issues", with_sql(*ISSUES) + f"""
SELECT issue_key FROM issues ORDER BY CASE WHEN level_type = 'video' AND level_id = 'src3' THEN 0 ELSE 1 END, {ORDER} LIMIT 10""")
def selected_video_issues(spark, sf):
    return _issues(spark, sf)[1].orderBy(*st.selected_video_first("src3")).limit(10).select("issue_key")


@query("issue_search", with_sql(*ISSUES) + """
SELECT issue_key FROM (SELECT *, CASE WHEN priority_level = 'High' AND ratio <= 0 THEN 'Medium' ELSE priority_level END AS p FROM issues) WHERE contains(level_id, 'src1') AND product_group IN ('en', 'de')""")
def issue_search(spark, sf):
    t = st.guard_priority(_issues(spark, sf)[1])
    return st.keep_products(st.search_issues(t, "SRC1"), ["en", "de"]).select("issue_key")


@query("scoped_strategy", with_sql(*ISSUES) + """
SELECT level_type, level_id, journey_stage, axis AS judgment_axis, polarity_direction FROM cand
WHERE ((level_type = 'video' AND level_id IN (SELECT video_id FROM docs WHERE product = 'es')) OR (level_type = 'product_group' AND level_id IN ('en', 'fr'))) AND polarity_direction IN ('negative', 'mixed')""")
def scoped_strategy(spark, sf):
    rows = truth_rows(spark, sf)
    c = st.strategy_candidates(rows, representatives(rows), texts=False)
    scoped = st.scope_strategy(c, rows.where("product = 'es'").select("video_id"), ["en", "fr"], ["negative", "mixed"])
    return scoped.select("level_type", "level_id", "journey_stage", F.col("judgment_axes")[0].alias("judgment_axis"), "polarity_direction")


SUPPORT = """ex AS (SELECT comment_id, video_id, product, coalesce(journey_stage, '') AS st, CASE WHEN mixed_flag THEN 'mixed' WHEN sentiment_final <> 'mixed' THEN sentiment_final END AS pd,
  unnest(list_distinct(judgment_axes)) AS axis FROM truth WHERE journey_stage IS NOT NULL),
sup AS (SELECT i.issue_key, x.comment_id FROM issues i JOIN ex x ON x.st = i.st AND x.pd = i.polarity_direction AND x.axis = i.axis
  AND ((i.level_type = 'video' AND x.video_id = i.level_id) OR (i.level_type = 'product_group' AND x.product = i.level_id)))"""


@query("issue_comments", with_sql(*ISSUES, SUPPORT) + "SELECT issue_key, comment_id FROM sup")
def issue_comments(spark, sf):
    rows, t = _issues(spark, sf)
    return st.issue_comments(t, rows)


@query("primary_issue", with_sql(*ISSUES, SUPPORT) + f"""
SELECT issue_key, coalesce(c, 0) AS supporting_comments FROM issues LEFT JOIN (SELECT issue_key, count(*) AS c FROM sup GROUP BY 1) USING (issue_key)
ORDER BY CASE WHEN coalesce(c, 0) > 0 AND n > 0 THEN 0 ELSE 1 END, {ORDER} LIMIT 1""")
def primary_issue(spark, sf):
    rows, t = _issues(spark, sf)
    return st.primary_issue(materialize(t), rows).select("issue_key", "supporting_comments")


SIMILAR = with_sql(*STRATEGY) + """,
tk AS (SELECT *, list_distinct(list_append(judgment_axes, cls)) AS toks, CASE WHEN mixed_flag THEN 'mixed' ELSE sentiment_final END AS dir FROM truth),
pairs AS (SELECT r.comment_id AS rep_id, c.comment_id FROM (SELECT * FROM tk WHERE comment_id IN (SELECT comment_id FROM reps)) r JOIN tk c
  ON c.analysis_included AND c.hygiene_class <> 'trash' AND coalesce(c.journey_stage, '') = coalesce(r.journey_stage, '') AND c.dir = r.dir AND list_has_any(c.toks, r.toks)
  AND c.comment_id <> r.comment_id AND c.text <> r.text AND c.text <> '')
"""


def _similar(spark, sf):
    tokens = F.array_distinct(F.concat("judgment_axes", F.array("classification_type")))
    rows = truth_rows(spark, sf).withColumns({"intent_tokens": tokens, "journey_stage": F.coalesce("journey_stage", F.lit(""))})
    rows = rows.withColumn("direction", sm.direction(rows))
    return rows, representatives(rows)


PAIRS = SIMILAR + "SELECT rep_id, comment_id, count(*) OVER (PARTITION BY rep_id) AS cluster_size FROM pairs QUALIFY cluster_size >= 3"
# A class is a stage, a direction, a token set and a text.
CLASSES = SIMILAR + """,
cl AS (SELECT comment_id, text, md5(concat_ws(chr(30), coalesce(journey_stage, ''), dir, array_to_string(list_sort(toks), chr(31)), md5(trim(text)))) AS class_id, analysis_included AND hygiene_class <> 'trash' AS pooled
  FROM tk WHERE text <> ''),
big AS (SELECT rep_id, comment_id, count(*) OVER (PARTITION BY rep_id) AS cluster_size FROM pairs QUALIFY cluster_size >= 3)
"""


def _pairs(spark, sf, **kw):
    rows, reps = _similar(spark, sf)
    # All rows of a representative's id.
    leads = rows.join(F.broadcast(reps.select("comment_id").distinct()), "comment_id", "left_semi")
    (classes, members), (rep_classes, rep_members) = sm.similar_classes(sm.source_pool(rows)), sm.similar_classes(leads, textless=True)
    links = materialize(sm.similar_links(materialize(classes), materialize(rep_classes), min_cluster=1, **kw))
    return sm.similar_pairs(links, rep_members, members).select("rep_id", "comment_id", "cluster_size")


@query("similar_comments", PAIRS)
def similar_comments(spark, sf):
    return _pairs(spark, sf)


@query("similar_comments_by_token", PAIRS)
def similar_comments_by_token(spark, sf):
    """The same pairs on the path for representatives too many to broadcast."""
    return _pairs(spark, sf, limit=0)


@query("similar_members", CLASSES + "SELECT comment_id, class_id FROM cl WHERE pooled")
def similar_members(spark, sf):
    """Which class each comment of the pool is in."""
    rows, _ = _similar(spark, sf)
    return sm.similar_classes(sm.source_pool(rows))[1]


@query("similar_cluster_sizes", SIMILAR + """
SELECT r.comment_id, coalesce(n, 0) AS cluster_size, n IS NULL AS insufficient_evidence FROM reps r
LEFT JOIN (SELECT rep_id, count(*) AS n FROM pairs GROUP BY 1 HAVING count(*) >= 3) p ON p.rep_id = r.comment_id""")
def similar_cluster_sizes(spark, sf):
    rows, reps = _similar(spark, sf)
    classes, _ = sm.similar_classes(sm.source_pool(rows))
    rep_classes, members = sm.similar_classes(reps)
    return sm.cluster_sizes(reps, members, sm.similar_links(classes, rep_classes))
