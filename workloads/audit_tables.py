"""Documented rates of a run, the audit of stored tables, checks within plans, and the upsert with a manifest."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from voxframe.operators import quality as qa
from voxframe.operators import topics as tp
from voxframe.operators.relational import top_per_group
from voxframe.session import shared_folder
from voxframe.sources import readers as rd
from voxframe.streaming import incremental as inc
from workloads.bindings import EV, labelled_events, with_sql
from workloads.registry import query
from workloads.source_tables import _stream
from workloads.topic_tables import TOPICS, _run

NOISE = ("k1", "k7", "k13")
SLOT_OF = ("negative", "positive", "neutral", "mixed")
GRAINS = [
    EV,
    """picked AS (SELECT video_id, (['negative', 'positive', 'neutral'])[reply_count + 1] AS label, arg_max({'id': comment_id, 'l': sentiment_label, 'x': exclusion_reason, 'e': event_id, 'p': product, 'k': keyword}, {'a': like_count, 'b': event_id}) AS r FROM ev GROUP BY 1, 2)""",
    """counted AS (SELECT video_id, sentiment_label AS label, count(*) AS n, count(DISTINCT keyword) FILTER (like_count >= 30) AS kn, any_value(product) AS product FROM ev GROUP BY 1, 2)""",
    """slots AS (SELECT v.video_id, l.label, coalesce(n, 0) AS count, r.id AS rep_id, r.l AS rep_label, coalesce(kn, 0) AS keyword_count, coalesce(r.x = 'ad', false) AS promo_flag, md5(v.product) AS counts_fingerprint,
      CASE WHEN r.e % 9 = 0 THEN '' ELSE md5(r.p) END AS rep_fingerprint,
      CASE WHEN r.id IS NOT NULL THEN 'Top1 사용 단계 ' || l.label || ' 코멘트 ' || CASE WHEN r.e % 5 = 0 THEN '' ELSE '영상제목: ' END || r.k || CASE WHEN r.e % 7 = 0 THEN ' ???' ELSE '' END || CASE WHEN r.e % 13 = 0 THEN repeat('x', 700) ELSE '' END END AS rep_text
      FROM (SELECT DISTINCT video_id, product FROM ev) v, (VALUES ('negative'), ('positive'), ('neutral'), ('mixed')) l(label)
      LEFT JOIN picked p ON p.video_id = v.video_id AND p.label = l.label LEFT JOIN counted c ON c.video_id = v.video_id AND c.label = l.label)""",
    """keywords AS (SELECT sentiment_label AS label, CASE WHEN keyword = 'k7' THEN 'neutral' ELSE sentiment_label END AS source_label, keyword, row_number() OVER (PARTITION BY product, sentiment_label ORDER BY count(*) DESC, keyword) AS rank
      FROM ev WHERE keyword IS NOT NULL GROUP BY product, sentiment_label, keyword)""",
    """audit AS (SELECT CASE event_type WHEN 'view' THEN 'RENDERING_GUARDRAIL' WHEN 'click' THEN 'SIMILARITY_MATCHING' WHEN 'purchase' THEN 'SANITIZATION' WHEN 'signup' THEN 'CACHE_READ' ELSE 'OTHER' END AS event,
      CASE WHEN event_type = 'view' AND starts_with(keyword, 'k1') THEN 'GARBLED_TEXT_DETECTED' WHEN event_type = 'click' AND like_count < 5 THEN 'LOW_OVERLAP' WHEN event_type = 'signup' AND region = 'r0' THEN 'CACHE_STALE' END AS reason_code,
      product AS field_name, CASE WHEN event_type = 'view' AND brand_label = 'b1' THEN 'REPLACE_NA' WHEN event_type <> 'purchase' THEN NULL WHEN brand_label = 'b0' THEN 'REMOVE_CONTROL_CHARS' WHEN brand_label = 'b1' THEN 'REPLACE_GARBLED' ELSE 'TRUNCATE' END AS action,
      like_count >= 30 AS displayed, reply_count AS matched_count, region = 'r1' AS unrelated, comment_validity = 'excluded' AS gibberish FROM ev)""",
]


def _grains(spark, sf):
    c, e = F.col, labelled_events(spark, sf)
    row = F.struct(c("comment_id").alias("id"), c("sentiment_label").alias("l"), c("exclusion_reason").alias("x"), c("event_id").alias("e"), c("product").alias("p"), c("keyword").alias("k"))
    slot = F.element_at(F.array(*[F.lit(s) for s in SLOT_OF]), (c("reply_count") + 1).cast("int"))
    picked = e.groupBy("video_id", slot.alias("label")).agg(F.max_by(row, F.struct("like_count", "event_id")).alias("r"))
    counted = e.groupBy("video_id", c("sentiment_label").alias("label")).agg(F.count("*").alias("n"), F.countDistinct(F.when(c("like_count") >= 30, c("keyword"))).alias("kn"))
    places = e.select("video_id", "product").distinct().select("*", F.explode(F.array(*[F.lit(s) for s in SLOT_OF])).alias("label"))
    text = F.concat(
        F.lit("Top1 사용 단계 "), c("label"), F.lit(" 코멘트 "), F.when(c("r.e") % 5 == 0, "").otherwise("영상제목: "), c("r.k"), F.when(c("r.e") % 7 == 0, " ???").otherwise(""),
        F.when(c("r.e") % 13 == 0, F.repeat(F.lit("x"), F.lit(700))).otherwise(""),
    )
    slots = places.join(picked, ["video_id", "label"], "left").join(counted, ["video_id", "label"], "left").select(
        "video_id", "label", F.coalesce("n", F.lit(0)).alias("count"), c("r.id").alias("rep_id"), c("r.l").alias("rep_label"), F.coalesce("kn", F.lit(0)).alias("keyword_count"),
        F.coalesce(c("r.x") == "ad", F.lit(False)).alias("promo_flag"), F.md5("product").alias("counts_fingerprint"),
        F.when(c("r.e") % 9 == 0, "").otherwise(F.md5("r.p")).alias("rep_fingerprint"), F.when(c("r.id").isNotNull(), text).alias("rep_text"),
    )
    counts = e.where("keyword IS NOT NULL").groupBy("product", c("sentiment_label").alias("label"), "keyword").agg(F.count("*").alias("n"))
    keywords = top_per_group(counts, ["product", "label"], [c("n").desc(), c("keyword")], 1 << 20, "rank").withColumn("source_label", F.when(c("keyword") == "k7", "neutral").otherwise(c("label")))
    kind = c("event_type")
    action = F.when((kind == "view") & (c("brand_label") == "b1"), "REPLACE_NA").when(
        kind == "purchase", F.when(c("brand_label") == "b0", "REMOVE_CONTROL_CHARS").when(c("brand_label") == "b1", "REPLACE_GARBLED").otherwise("TRUNCATE")
    )
    reason = (
        F.when((kind == "view") & c("keyword").startswith("k1"), "GARBLED_TEXT_DETECTED").when((kind == "click") & (c("like_count") < 5), "LOW_OVERLAP")
        .when((kind == "signup") & (c("region") == "r0"), "CACHE_STALE")
    )
    event = F.when(kind == "view", "RENDERING_GUARDRAIL").when(kind == "click", "SIMILARITY_MATCHING").when(kind == "purchase", "SANITIZATION").when(kind == "signup", "CACHE_READ").otherwise("OTHER")
    events = e.select(
        event.alias("event"), reason.alias("reason_code"), c("product").alias("field_name"), action.alias("action"), (c("like_count") >= 30).alias("displayed"),
        c("reply_count").alias("matched_count"), (c("region") == "r1").alias("unrelated"), (c("comment_validity") == "excluded").alias("gibberish"),
    )
    return {"comments": e, "slots": slots, "keywords": keywords, "events": events}


# metric, grain, hit, base, segment column, share of all rows
RATES = [
    ("invariant_violation", "slots", "rep_id IS NOT NULL AND (count = 0 OR rep_label IS DISTINCT FROM label)", "true", "", 0), ("label_mismatch", "slots", "rep_label IS DISTINCT FROM label", "rep_id IS NOT NULL", "", 0),
    ("promo_leakage", "slots", "promo_flag", "rep_id IS NOT NULL", "", 0), ("fingerprint_mismatch", "slots", "counts_fingerprint IS DISTINCT FROM rep_fingerprint", "rep_id IS NOT NULL", "", 0),
    ("keyword_missing", "slots", "keyword_count = 0", "count > 0", "", 0),
    ("template_compliance", "slots", "regexp_matches(rep_text, '^Top\\d+ \\S+ 단계 \\S+ 코멘트') AND contains(rep_text, '영상제목: ') AND NOT contains(rep_text, '???')", "rep_id IS NOT NULL", "", 0),
    ("boilerplate", "slots", "length(rep_text) > 600", "rep_id IS NOT NULL", "", 0), ("keyword_noise", "keywords", "keyword IN ('k1', 'k7', 'k13')", "rank <= 20", "", 0),
    ("label_purity", "keywords", "label = source_label", "true", "", 0), ("garbled_output", "audit", "reason_code = 'GARBLED_TEXT_DETECTED'", "event = 'RENDERING_GUARDRAIL'", "", 0),
    ("garbled_leakage", "audit", "displayed", "reason_code = 'GARBLED_TEXT_DETECTED'", "", 0), ("replaced_by_field", "audit", "action = 'REPLACE_NA'", "event = 'RENDERING_GUARDRAIL'", "field_name", 0),
    ("similarity_pass", "audit", "matched_count > 0 AND reason_code IS NULL", "event = 'SIMILARITY_MATCHING'", "", 0), ("unrelated_match", "audit", "matched_count > 0", "event = 'SIMILARITY_MATCHING' AND unrelated", "", 0),
    ("gibberish_eligible", "audit", "gibberish", "event = 'SIMILARITY_MATCHING'", "", 0), ("cache_stale", "audit", "reason_code = 'CACHE_STALE'", "event = 'CACHE_READ'", "", 0),
    ("sanitized_by_action", "audit", "true", "event = 'SANITIZATION'", "action", 1), ("excluded", "ev", "comment_validity = 'excluded'", "true", "", 0),
    ("excluded_by_reason", "ev", "comment_validity = 'excluded'", "true", "exclusion_reason", 1),
]


def _rate_sql(name: str, grain: str, hit: str, base: str, by: str, of_all: int) -> str:
    hits, rows = f"count(*) FILTER (({hit}) AND ({base}))", f"count(*) FILTER ({base})"
    if not by:
        return f"SELECT '{name}' AS metric, '' AS segment, {hits} AS hits, {rows} AS base FROM {grain}"
    total = f"(SELECT {rows} FROM {grain})" if of_all else rows
    return f"SELECT '{name}', {by}, {hits}, {total} FROM {grain} WHERE {by} IS NOT NULL GROUP BY {by} HAVING {hits} > 0"


@query("documented_rates", with_sql(*GRAINS) + "SELECT metric, segment, hits, base, round(hits / nullif(base, 0), 6) AS rate FROM (" + " UNION ALL ".join(_rate_sql(*r) for r in RATES) + ")")
def documented_rates(spark, sf):
    return qa.documented_rates(_grains(spark, sf), qa.documented_metrics(NOISE))


@query("run_audit", """
SELECT 'events' AS "table", (SELECT count(*) FROM events) AS rows, '' AS absent, 'ok' AS status UNION ALL SELECT 'documents', (SELECT count(*) FROM documents), 'mood,reach', 'columns'
UNION ALL SELECT 'labels', (SELECT count(*) FROM labels), '', 'rows' UNION ALL SELECT 'pages', (SELECT count(*) FROM pages), '', 'ok'
UNION ALL SELECT 'comments_of_yesterday', 0, 'comment_id', 'missing' UNION ALL SELECT 'nation', (SELECT count(*) FROM nation), '', 'extra'""")
def run_audit(spark, sf):
    """Stored tables against what is expected of them: one lacks columns, one rows, one is missing, one is extra."""
    names = ("events", "documents", "labels", "pages", "nation", "comments_of_yesterday")
    found = rd.catalogue(spark, {n: f"{sf}/{n}.parquet" for n in names})
    wanted = [
        ("events", ["event_id", "ts", "props"], 1), ("documents", ["doc_id", "reach", "mood"], 1), ("labels", ["doc_id"], 1 << 60), ("pages", ["url"], 1), ("comments_of_yesterday", ["comment_id"], 0),
    ]
    out = qa.table_audit(found, spark.createDataFrame(wanted, "table string, columns array<string>, min_rows long"))
    return out.select("table", "rows", F.array_join("absent", ",").alias("absent"), "status")


@query("topic_sanity", with_sql(*TOPICS) + """
SELECT run, "check", value, least, value >= least AS ok FROM (
  SELECT 'whole' AS run, 'topics' AS "check", (SELECT count(*) FROM tops) AS value, 1 AS least UNION ALL SELECT 'whole', 'signals', (SELECT count(*) FROM sig), (SELECT count(*) FROM docs WHERE trim(text) <> '')
  UNION ALL SELECT 'broken', 'topics', 0, 1 UNION ALL SELECT 'broken', 'signals', (SELECT count(*) FROM sig WHERE signal_text = ''), (SELECT count(*) FROM docs WHERE trim(text) <> ''))""")
def topic_sanity(spark, sf):
    """The checks of a run, on its tables and on a broken copy of them."""
    out = _run(spark, sf)
    context, signals, topics = out["topic_context"], out["topic_signals"], out["topics"]
    whole = tp.sanity_checks(context, signals, topics).withColumn("run", F.lit("whole"))
    broken = tp.sanity_checks(context, signals.where("signal_text = ''"), topics.where("signal_count < 0")).withColumn("run", F.lit("broken"))
    return whole.unionByName(broken)


@query("manifest_upsert", """
SELECT 'v' || CAST(user_id AS VARCHAR) AS video_id, json_extract_string(props, '$.k') AS k, CAST(event_id AS VARCHAR) AS comment_id, CASE WHEN event_type = 'error' THEN 'revised' ELSE 'first' END AS version FROM events
QUALIFY row_number() OVER (PARTITION BY user_id, json_extract_string(props, '$.k') ORDER BY event_type = 'error' DESC, event_id DESC) = 1""")
def manifest_upsert(spark, sf):
    """All events, a compaction, their errors once more as revised rows, a second compaction, read through the manifest."""
    base = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    target, keys = f"{base}/versions", ("video_id", "k")
    rows = _stream(spark, sf)
    inc.append_versions(rows.withColumn("version", F.lit("first")), target, f"{base}/first").awaitTermination()
    inc.compacted(spark, target, "event_id", keys)
    revised = rows.where("sentiment_label = 'negative'").withColumn("version", F.lit("revised"))
    inc.append_versions(revised, target, f"{base}/second", after=inc.last_batch(spark, target)).awaitTermination()
    inc.compacted(spark, target, "event_id", keys)
    return inc.current_rows(spark, target, "event_id", keys).select("video_id", "k", "comment_id", "version")
