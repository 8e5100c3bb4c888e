"""What cards and video summaries say: context signals, mentions, reasons and evidence, with the SQL of clauses."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxframe.functions.keywords import KeywordRules
from voxframe.functions.text import preview
from voxframe.operators import cards as cd
from voxframe.operators import similar as sm
from voxframe.operators import videos as vd
from voxframe.operators.relational import attach, top_per_group, unnest
from voxframe.rules import messages
from voxframe.session import materialize
from workloads.bindings import DOCS, comments, sql_any, with_sql
from workloads.registry import query

#: Words as they stand: the fixture is Latin, so no list of the default rules applies.
BARE = KeywordRules(stopwords=(), translations={}, aliases={}, keep=(), products=(), noise_suffixes=(), verb_suffixes=(), particles=(), drop_latin=False)

WHITE = r"[\s\x0B]"
SAFE = f"regexp_replace(regexp_replace(coalesce({{0}}, ''), '^{WHITE}+|{WHITE}+$', '', 'g'), '^(nan|none|null|<na>)$', '', 'i')"


def sql_preview(text: str, limit: int) -> str:
    """SQL of a text that is already stripped, cut with an ellipsis."""
    return f"CASE WHEN length({text}) <= {limit} THEN {text} ELSE rtrim(substr(trim(regexp_replace({text}, '{WHITE}+', ' ', 'g')), 1, {limit - 3})) || '...' END"


def clause_sql(source: str, text: str = "text", key: str = "comment_id") -> str:
    """CTE ``clauses(key, i, p)``: the usable clauses of each text of ``source``, by place; the whole text if none is."""
    noise, lists = sql_any("lower(p)", cd.CLAUSE_NOISE), sql_any("lower(p)", ("kg", "l", "링크", "보러가기"))
    return rf"""compact AS (SELECT {key}, trim(regexp_replace(trim(regexp_replace({SAFE.format(text)}, '{WHITE}+', ' ', 'g')), 'https?://\S+', '', 'g')) AS t FROM {source}),
parts AS (SELECT {key}, t, unnest(string_split_regex(t, '[.!?\n]|\s{{2,}}')) AS p, generate_subscripts(string_split_regex(t, '[.!?\n]|\s{{2,}}'), 1) AS i FROM compact WHERE t <> ''),
bare AS (SELECT {key}, t, i, regexp_replace(trim(regexp_replace(p, '{WHITE}+', ' ', 'g')), '^[ \-:;,''"]+|[ \-:;,''"]+$', '', 'g') AS p FROM parts),
usable AS (SELECT {key}, i, p FROM bare WHERE length(p) >= 4 AND regexp_matches(p, '[A-Za-z0-9가-힣]{{2,}}') AND NOT starts_with(p, '▼') AND NOT {noise}
  AND NOT (length(p) - length(replace(p, ':', '')) >= 3 AND {lists})),
clauses AS (SELECT * FROM usable UNION ALL SELECT {key}, 1, t FROM compact WHERE t <> '' AND {key} NOT IN (SELECT {key} FROM usable))"""


SALIENT = f"""(least(length(p), 120) / 120::DOUBLE + CASE WHEN {sql_any("lower(p)", cd.ISSUE_WORDS)} THEN 1.6::DOUBLE ELSE 0 END
  + CASE WHEN regexp_matches(p, '\\d') THEN 0.35::DOUBLE ELSE 0 END + CASE WHEN {sql_any("lower(p)", cd.QUESTION_WORDS)} THEN 0.5::DOUBLE ELSE 0 END)"""
TOLD = """told AS (SELECT comment_id, video_id, product, region, sentiment_label, like_count, text, CASE WHEN reply_count = 3 THEN 'excluded' ELSE 'valid' END AS comment_validity,
  CASE WHEN video_id LIKE '%3' THEN [] ELSE list_filter(regexp_extract_all(lower(text), '[a-z]{9,}'), lambda w, i: list_position(regexp_extract_all(lower(text), '[a-z]{9,}'), w) = i) END AS points,
  CASE WHEN video_id LIKE '%3' OR video_id LIKE '%4' THEN [] ELSE [product, region] END AS tags,
  CASE WHEN reply_count = 1 THEN text || ' 1:' || lpad(CAST(doc_id % 60 AS VARCHAR), 2, '0') ELSE text END AS cleaned FROM docs)"""


def told(spark, sf):
    """Documents as enriched comments of their sources: long words as points; sources with a 3 or 4 at the end lack some."""
    c, none = comments(spark, sf), F.array().cast("array<string>")
    late = F.concat("text", F.lit(" 1:"), F.lpad((F.col("doc_id") % 60).cast("string"), 2, "0"))
    return c.withColumns(
        {
            "comment_validity": F.when(F.col("reply_count") == 3, "excluded").otherwise("valid"),
            "nlp_core_points": F.when(F.col("video_id").endswith("3"), none).otherwise(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{9,}"), F.lit(0)))),
            "nlp_context_tags": F.when(F.col("video_id").endswith("3") | F.col("video_id").endswith("4"), none).otherwise(F.array("product", "region")),
            "cleaned_text": F.when(F.col("reply_count") == 1, late).otherwise(F.col("text")),
        }
    )


def counted_sql(name: str, source: str, limit: int, glue: str) -> str:
    """CTE of the most frequent values of each video, joined in order."""
    return f"""{name} AS (SELECT video_id, string_agg(value, '{glue}' ORDER BY r) AS {name} FROM (
  SELECT video_id, value, row_number() OVER (PARTITION BY video_id ORDER BY count(*) DESC, min(comment_id), value) AS r FROM {source} GROUP BY 1, 2) WHERE r <= {limit} GROUP BY 1)"""


LISTS = """ok AS (SELECT * FROM told WHERE comment_validity = 'valid'),
pv AS (SELECT video_id, comment_id, unnest(points) AS value FROM ok),
tv AS (SELECT video_id, comment_id, unnest(tags) AS value FROM ok)"""
SIGNALS = with_sql(DOCS, TOLD, LISTS, counted_sql("top_points", "pv", 4, " | "), counted_sql("top_tags", "tv", 3, " | "), clause_sql("ok", "cleaned")) + f""",
first AS (SELECT comment_id, p FROM (SELECT comment_id, p, row_number() OVER (PARTITION BY comment_id ORDER BY {SALIENT} DESC, i) AS r FROM clauses) WHERE r = 1),
ev AS (SELECT video_id, string_agg(p, ' | ' ORDER BY r) AS evidence FROM (
  SELECT video_id, p, row_number() OVER (PARTITION BY video_id ORDER BY min({{'l': -coalesce(like_count, -1), 'id': comment_id}}), p) AS r FROM first JOIN ok USING (comment_id) GROUP BY 1, 2) WHERE r <= 3 GROUP BY 1),
sig AS (SELECT video_id, count(*) AS count, avg((sentiment_label = 'negative')::INT) AS negative_share, avg((sentiment_label = 'positive')::INT) AS positive_share,
  avg((len(points) > 0)::INT) AS nlp_coverage FROM ok GROUP BY 1)
"""


@query("video_signals", SIGNALS + """SELECT video_id, count, negative_share, positive_share, nlp_coverage, coalesce(top_points, '') AS top_points, coalesce(top_tags, '') AS top_tags, evidence
FROM sig LEFT JOIN top_points USING (video_id) LEFT JOIN top_tags USING (video_id) LEFT JOIN ev USING (video_id)""")
def video_signals(spark, sf):
    out = vd.video_signals(told(spark, sf), rules=BARE)
    joined = lambda n: F.array_join(n, " | ")
    return out.select("video_id", "count", "negative_share", "positive_share", "nlp_coverage", joined("top_points").alias("top_points"), joined("top_tags").alias("top_tags"), joined("evidence_clauses").alias("evidence"))


VOICE = sql_any("v", messages.GENERIC_PHRASES)
MENTIONS = with_sql(DOCS, TOLD, LISTS, counted_sql("top_points", "pv", 3, ", "), counted_sql("top_two", "pv", 2, ", "), counted_sql("top_tags", "tv", 2, ", "),
    counted_sql("top_pointed", "(SELECT video_id, comment_id, value FROM pv)", 2, " 포인트, "),
    r"""wv AS (SELECT video_id, comment_id, unnest(list_filter(list_transform(regexp_extract_all(cleaned, '[A-Za-z][A-Za-z''-]+|[0-9A-Za-z가-힣+/]+'),
  lambda w: trim(lower(w), '.,!?()[]{}"''`“”‘:;/-_')), lambda w: regexp_full_match(w, '[a-z]{2,}'))) AS value FROM ok
  WHERE video_id NOT IN (SELECT video_id FROM pv) AND video_id NOT IN (SELECT video_id FROM tv))""",
    counted_sql("words", "wv", 3, ", ")) + f""",
line AS (SELECT *, {SAFE.format("cleaned")} AS v FROM ok),
shown AS (SELECT *, CASE WHEN len(points) > 0 THEN coalesce(tags[1], '핵심 맥락') || ': ' || array_to_string(points[1:2], ', ') WHEN v <> '' AND NOT contains(v, '??') AND NOT {VOICE} THEN v ELSE '' END AS s FROM line),
best AS (SELECT video_id, kind, s, v FROM (SELECT video_id, k.kind, {sql_preview("s", 86)} AS s, v, row_number() OVER (PARTITION BY video_id, k.kind ORDER BY coalesce(like_count, 0) DESC, comment_id DESC) AS r
  FROM shown, (VALUES ('negative'), ('positive'), ('any')) k(kind) WHERE k.kind = 'any' OR sentiment_label = k.kind) WHERE r = 1),
sec AS (SELECT *, CASE WHEN regexp_matches(v, '\\b\\d{{1,2}}:[0-5]\\d:[0-5]\\d\\b') THEN
    CAST(regexp_extract(v, '\\b(\\d{{1,2}}):([0-5]\\d):([0-5]\\d)\\b', 1) AS INT) * 3600 + CAST(regexp_extract(v, '\\b(\\d{{1,2}}):([0-5]\\d):([0-5]\\d)\\b', 2) AS INT) * 60 + CAST(regexp_extract(v, '\\b(\\d{{1,2}}):([0-5]\\d):([0-5]\\d)\\b', 3) AS INT)
  WHEN regexp_matches(v, '\\b\\d{{1,2}}:[0-5]\\d\\b') THEN CAST(regexp_extract(v, '\\b(\\d{{1,2}}):([0-5]\\d)\\b', 1) AS INT) * 60 + CAST(regexp_extract(v, '\\b(\\d{{1,2}}):([0-5]\\d)\\b', 2) AS INT) END AS t FROM best),
wide AS (SELECT video_id, coalesce(max(s) FILTER (kind = 'negative'), '') AS neg, coalesce(max(s) FILTER (kind = 'positive'), '') AS pos, coalesce(max(s) FILTER (kind = 'any'), '') AS oth,
  coalesce(max(t) FILTER (kind = 'negative'), max(t) FILTER (kind = 'positive'), max(t) FILTER (kind = 'any')) AS t FROM sec GROUP BY 1),
vids AS (SELECT DISTINCT video_id FROM told),
seen AS (SELECT vids.video_id, t, wide.video_id IS NOT NULL AS valid, top_points, top_two, top_tags, top_pointed, words, CASE WHEN neg <> '' THEN '부정: ' || neg END AS a, CASE WHEN pos <> '' THEN '긍정: ' || pos END AS b,
  CASE WHEN oth <> '' AND neg = '' AND pos = '' THEN '혼합: ' || oth END AS o FROM vids LEFT JOIN wide USING (video_id) LEFT JOIN top_points USING (video_id) LEFT JOIN top_two USING (video_id)
  LEFT JOIN top_tags USING (video_id) LEFT JOIN top_pointed USING (video_id) LEFT JOIN words USING (video_id))
"""


@query("video_mentions", MENTIONS + """SELECT video_id, CASE WHEN NOT valid THEN '유효 댓글이 부족해 언급 포인트를 계산하지 못했습니다.' ELSE coalesce(nullif(concat_ws(' | ', a, b, o, '핵심포인트: ' || top_two), ''), '핵심 언급을 특정하기 어려워 원문 확인이 필요합니다.') END AS mention_points,
  CASE WHEN NOT valid THEN '근거 부족' ELSE coalesce(top_tags, top_pointed || ' 포인트', words, '핵심 포인트 유사') END AS basis_labels, coalesce(top_points, '') AS top_points, coalesce(top_tags, '') AS top_tags,
  CASE WHEN t IS NULL THEN '시점 미확인' WHEN t >= 3600 THEN format('{:02d}:{:02d}:{:02d}', t // 3600, t % 3600 // 60, t % 60) ELSE format('{:02d}:{:02d}', t // 60, t % 60) END AS mention_time,
  'https://v.example/watch?v=' || video_id || coalesce('&t=' || t || 's', '') AS video_link FROM seen""")
def video_mentions(spark, sf):
    """The described part of the video summary, over sources as videos."""
    rows = told(spark, sf)
    videos = rows.select("video_id").distinct().withColumn("video_url", F.concat(F.lit("https://v.example/watch?v="), "video_id"))
    out = vd.video_summary(rows, videos, rules=BARE)
    joined = lambda n: F.array_join(n, ", ").alias(n)
    return out.select("video_id", "mention_points", "basis_labels", joined("top_points"), joined("top_tags"), "mention_time", "video_link")


STAGE = "CASE product WHEN 'en' THEN '구매' WHEN 'de' THEN '' ELSE coalesce(product, '') END"
KNOWN = [([m for m in markers], label) for markers, label in cd.SUBJECTS]


@query("comment_reasons", with_sql(DOCS) + f""",
s AS (SELECT comment_id, sentiment_label, CASE WHEN {sql_any("lower(text)", cd.SMART_WORDS)} THEN '사용' ELSE coalesce(nullif({STAGE}, ''), '기타') END AS topic,
  list_filter([{", ".join(f"CASE WHEN {sql_any('lower(text)', m)} THEN '{label}' END" for m, label in KNOWN)}], lambda x: x IS NOT NULL) AS subjects,
  regexp_extract_all(lower(text), '[a-z]{{9,}}') AS words FROM docs),
n AS (SELECT *, coalesce(nullif(array_to_string(CASE WHEN len(subjects) > 0 THEN subjects[1:2] ELSE list_transform(list_sort(list_transform(list_distinct(words), lambda w: {{'i': list_position(words, w), 'w': w}}))[1:2], lambda x: x.w) END, ', '), ''), '핵심 사용 경험') AS subject FROM s)
SELECT comment_id, CASE sentiment_label WHEN 'negative' THEN '부정 포인트: ' || topic || ' 단계에서 ' || subject || '에 대한 불만이 핵심입니다.' WHEN 'positive' THEN '긍정 포인트: ' || topic || ' 단계에서 ' || subject || '에 대한 만족감이 핵심입니다.'
  ELSE '중립 포인트: ' || topic || ' 단계에서 ' || subject || ' 관련 의견이 함께 언급됩니다.' END AS reason FROM n""")
def comment_reasons(spark, sf):
    c = comments(spark, sf)
    stage = F.when(F.col("product") == "en", "구매").when(F.col("product") == "de", "").otherwise(F.coalesce("product", F.lit("")))
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{9,}"), F.lit(0))
    return c.select("comment_id", cd.comment_reason(F.col("text"), stage, F.col("sentiment_label"), words).alias("reason"))


@query("relevance_notes", with_sql(DOCS) + """
SELECT comment_id, coalesce(nullif(concat_ws(', ', CASE WHEN region = 'R0' THEN 'LG 브랜드 언급' END, CASE WHEN product = 'en' THEN '제품 타깃 매칭' END, CASE WHEN reply_count = 2 THEN '의견 유형 신호' END), ''),
  CASE WHEN coalesce(like_count, 0) / 41.0 >= 0.45 THEN format('관련성 점수 기반({:.2f})', (coalesce(like_count, 0) / 41.0)::DOUBLE) ELSE '관련 근거 부족' END) AS note FROM docs""")
def relevance_notes(spark, sf):
    c = comments(spark, sf)
    target, kind = F.when(F.col("product") == "en", "washer"), F.when(F.col("reply_count") == 2, "Complaint").otherwise("other")
    return c.select("comment_id", cd.relevance_note(F.col("region") == "R0", target, kind, F.coalesce("like_count", F.lit(0)) / 41.0).alias("note"))


# Evidence of cards: the SQL pairs every representative with every similar comment, then merges their clauses.
PAINED = "sentiment IN ('negative', 'mixed')"


def signal_sql(corpus: str) -> str:
    has = lambda words: sql_any(corpus, words)
    rest = " ".join(f"WHEN {has(markers)} THEN '{name}'" for name, markers in cd.SIGNALS)
    return f"""CASE WHEN sentiment = 'positive' AND {has(cd.ADVOCACY_WORDS)} THEN 'advocacy_signal' WHEN {PAINED} AND {has(cd.MANUAL_WORDS)} THEN 'manual_intervention'
  WHEN {has(cd.ODOR_WORDS)} AND NOT {has(cd.ODOR_CLEAR)} AND ({has(cd.ODOR_NEGATIVE)} OR {PAINED}) THEN 'odor_leakage' {rest} ELSE 'general_experience' END"""


def domain_sql() -> str:
    points = {d: ["0"] for d in cd.DOMAINS}
    for stage, weights in cd.STAGE_DOMAINS.items():
        for domain, value in weights:
            points[domain].append(f"{value} * (stage = '{stage}')::INT")
    for name, (domain, value) in cd.SIGNAL_DOMAINS.items():
        points[domain].append(f"{value} * (signal_name = '{name}')::INT")
    known = ", ".join(f"'{stage}'" for stage in cd.STAGE_DOMAINS)
    points["operations / service"] += [f"(stage NOT IN ({known}))::INT", "(sentiment = 'negative')::INT"]
    points["marketing / message"].append("(sentiment = 'positive')::INT")
    points["UX / guide"].append("(sentiment = 'mixed')::INT")
    sums = {d: "(" + " + ".join(p) + ")" for d, p in points.items()}
    best = f"greatest({', '.join(sums.values())})"
    return "CASE " + " ".join(f"WHEN {p} = {best} THEN '{d}'" for d, p in sums.items()) + " END"


LOW = "lower(p)"
FITTING = f"""round(least(length(p), 120) / 120::DOUBLE + CASE sentiment WHEN 'positive' THEN CASE WHEN {sql_any(LOW, cd.PRAISE_WORDS)} THEN 2.2::DOUBLE ELSE 0 END - CASE WHEN {sql_any(LOW, cd.COMPLAINT_WORDS)} THEN 1.6::DOUBLE ELSE 0 END
  + CASE WHEN {sql_any(LOW, cd.NO_COMPLAINT)} THEN 0.8::DOUBLE ELSE 0 END WHEN 'negative' THEN CASE WHEN {sql_any(LOW, cd.COMPLAINT_WORDS)} THEN 2.2::DOUBLE ELSE 0 END ELSE 0 END
  + CASE WHEN regexp_matches(p, '\\d') THEN 0.2::DOUBLE ELSE 0 END, 9)"""
CARD_STAGE = "CASE WHEN region = 'R0' THEN '사용' ELSE '' END"
EVIDENCE = with_sql(
    DOCS,
    TOLD,
    f"""card AS (SELECT *, sentiment_label AS sentiment, {CARD_STAGE} AS direct, CASE WHEN region = 'R1' THEN 'comparison' ELSE 'complaint' END AS kind, CAST(reply_count AS VARCHAR) AS replies, {SAFE.format("text")} AS safe
  FROM told JOIN (SELECT comment_id, reply_count FROM docs) USING (comment_id))""",
    clause_sql("card"),
    f"""salient AS (SELECT comment_id, {sql_preview("p", 78)} AS evidence FROM (SELECT comment_id, p, row_number() OVER (PARTITION BY comment_id ORDER BY {SALIENT} DESC, i) AS r FROM clauses) WHERE r = 1)""",
    """lead AS (SELECT * FROM card WHERE safe <> '' QUALIFY row_number() OVER (PARTITION BY sentiment ORDER BY like_count DESC NULLS LAST, comment_id) <= 6)""",
    """near AS (SELECT l.comment_id AS lead, c.comment_id, c.like_count, md5(concat_ws(chr(30), c.direct, c.sentiment, array_to_string(list_sort([coalesce(c.product, '-'), 'n' || c.replies]), chr(31)), md5(c.safe))) AS class_id
  FROM lead l JOIN card c ON c.direct = l.direct AND c.sentiment = l.sentiment AND (coalesce(c.product, '-') = coalesce(l.product, '-') OR c.replies = l.replies) AND c.safe <> l.safe AND c.safe <> '')""",
    """sized AS (SELECT lead, count(*) AS n FROM near GROUP BY 1 HAVING count(*) >= 3)""",
    """liked AS (SELECT lead, class_id, any_value(evidence) AS evidence, max(coalesce(like_count, 0)) AS likes FROM near JOIN salient USING (comment_id) WHERE lead IN (SELECT lead FROM sized) GROUP BY 1, 2)""",
    """merged AS (SELECT lead, list(evidence ORDER BY r) AS alike FROM (SELECT lead, evidence, row_number() OVER (PARTITION BY lead ORDER BY max(likes) DESC, min({'l': -likes, 'c': class_id}).c, evidence) AS r FROM liked GROUP BY 1, 2) WHERE r <= 3 GROUP BY 1)""",
    f"""vfirst AS (SELECT comment_id, p FROM (SELECT comment_id, p, row_number() OVER (PARTITION BY comment_id ORDER BY {SALIENT} DESC, i) AS r FROM clauses) WHERE r = 1),
vev AS (SELECT video_id, list({sql_preview("p", 82)} ORDER BY r) AS around FROM (
  SELECT video_id, p, row_number() OVER (PARTITION BY video_id ORDER BY min({{'l': -coalesce(like_count, -1), 'id': comment_id}}), p) AS r FROM vfirst JOIN card USING (comment_id) WHERE comment_validity = 'valid' GROUP BY 1, 2) WHERE r <= 3 GROUP BY 1)""",
    f"""picked AS (SELECT comment_id, {sql_preview("p", 82)} AS evidence FROM (SELECT comment_id, p, row_number() OVER (PARTITION BY comment_id ORDER BY {FITTING} DESC, i) AS r FROM clauses JOIN card USING (comment_id)) WHERE r = 1)""",
    """joined AS (SELECT card.*, coalesce(picked.evidence, '') AS evidence, coalesce(merged.alike, []) AS alike, coalesce(sized.n, 0) AS similar_count, coalesce(vev.around, []) AS around,
  concat_ws(' ', lower(safe), lower(array_to_string(tags, ' ')), lower(array_to_string(points, ' ')), CASE WHEN sentiment <> 'positive' THEN lower(array_to_string(coalesce(merged.alike, []), ' ')) END) AS corpus
  FROM card LEFT JOIN picked USING (comment_id) LEFT JOIN merged ON merged.lead = card.comment_id LEFT JOIN sized ON sized.lead = card.comment_id LEFT JOIN vev USING (video_id))""",
    f"signalled AS (SELECT *, {signal_sql('corpus')} AS signal_name FROM joined)",
    f"""staged AS (SELECT *, CASE WHEN direct <> '' THEN direct WHEN {sql_any("lower(safe)", ("배송", "설치", "방문"))} THEN '배송' WHEN signal_name = 'service_response_gap' THEN '관리' WHEN signal_name = 'pricing_contract_gap' THEN '구매'
  WHEN kind IN ('comparison', 'informational') THEN '탐색' WHEN kind = 'preference' THEN '결정'
  WHEN signal_name IN ('manual_intervention', 'odor_leakage', 'reliability_failure', 'consumable_burden', 'onboarding_guide_gap') THEN '사용' ELSE '' END AS stage FROM signalled)""",
)
CONCERN = "CASE WHEN sentiment <> 'positive' THEN '' " + " ".join(f"WHEN {sql_any('lower(safe)', markers)} THEN '{note}'" for markers, note in messages.SECONDARY_CONCERNS) + " ELSE '' END"


@query("resolution_evidence", EVIDENCE + f"""SELECT comment_id, signal_name, stage AS resolved_stage, direct = '' AND stage <> '' AS stage_inferred, {domain_sql()} AS action_domain, evidence AS representative_evidence,
  array_to_string(alike, ' | ') AS similar_evidence, similar_count, coalesce(list_filter(around, lambda a: a <> '' AND a <> evidence)[1], '') AS context_evidence, {CONCERN} AS secondary_concern,
  concat_ws(',', CASE WHEN stage = '' THEN 'journey_stage_missing' END, CASE WHEN direct = '' AND stage <> '' THEN 'journey_stage_inferred_fallback' END,
    CASE WHEN evidence = '' THEN 'representative_evidence_missing' END, CASE WHEN similar_count < 3 THEN 'similar_signal_lt_3' END) AS insufficient_reasons FROM staged""")
def resolution_evidence(spark, sf):
    """All comments as cards; the six best-liked of each polarity bring the clauses of the comments similar to them."""
    stage = F.when(F.col("region") == "R0", "사용").otherwise("")
    rows = told(spark, sf).withColumns(
        {
            "sentiment": F.col("sentiment_label"), "stage": stage, "classification_type": F.when(F.col("region") == "R1", "comparison").otherwise("complaint"),
            "mixed_flag": F.lit(False), "direction": F.col("sentiment_label"), "tokens": F.array(F.coalesce("product", F.lit("-")), F.concat(F.lit("n"), F.col("reply_count").cast("string"))),
        }
    )
    # Split once: each clause that a later step needs is chosen here.
    rows = rows.drop("cleaned_text").withColumn("__clauses", cd.split_clauses(F.col("text")))
    best = F.try_element_at(cd.salient_clauses(F.col("__clauses"), 1), F.lit(1))
    rows = rows.withColumns({"salient_clause": best, "representative_clause": cd.representative_clause(F.col("__clauses"), F.col("sentiment"))}).drop("__clauses")
    rows = rows.withColumn("clause", preview(F.coalesce("salient_clause", F.lit("")), 78))
    # Written with one copy of the text.
    rows = materialize(rows).withColumn("text_display", F.col("text"))
    order = [F.col("like_count").desc_nulls_last(), F.col("comment_id")]
    leads = top_per_group(rows.where(F.trim("text") != ""), ["sentiment"], order, 6)
    classes, _ = sm.similar_classes(rows, "tokens", "stage", "text", "clause")
    lead_classes, lead_members = sm.similar_classes(leads, "tokens", "stage", "text")
    found = sm.cluster_evidence(sm.similar_links(materialize(classes), lead_classes))
    similar = attach(lead_members.withColumnRenamed("class_id", "rep_class"), found, ["rep_class"], "inner", derived=True).drop("rep_class")
    around = vd.video_signals(rows, rules=BARE).select("video_id", F.col("evidence_clauses").alias("video_evidence"))
    # Both have few rows; held, their size is known, and the texts stay where they are.
    cards = attach(attach(rows, materialize(similar), ["comment_id"]), materialize(around), ["video_id"])
    out = cd.resolution_evidence(cards)
    return out.select(
        "comment_id", "signal_name", "resolved_stage", "stage_inferred", "action_domain", "representative_evidence", F.array_join("similar_evidence", " | ").alias("similar_evidence"),
        F.coalesce("similar_count", F.lit(0)).alias("similar_count"), "context_evidence", "secondary_concern", F.array_join("insufficient_reasons", ",").alias("insufficient_reasons"),
    )


VOC = " , ".join(
    "{'topic': '" + topic + "', 'span': coalesce(" + ", ".join(f"CASE WHEN contains(lower(s), '{q}') THEN substr(s, instr(lower(s), '{q}'), {len(p)}) END" for p in phrases for q in [p.replace("'", "''")]) + ", '')}"
    for topic, phrases, _ in messages.VOC_TOPICS
)


@query("voc_items", with_sql(DOCS) + f""",
t AS (SELECT comment_id, sentiment_label, {SAFE.format("text")} AS s FROM docs),
v AS (SELECT comment_id, sentiment_label, s, list_filter([{VOC}], lambda x: x.span <> '')[1:4] AS items FROM t),
e AS (SELECT comment_id, sentiment_label, unnest(CASE WHEN len(items) > 0 THEN items ELSE [{{'topic': '기타 사용 경험', 'span': left(s, 30)}}] END) AS x FROM v)
SELECT comment_id, x.topic AS topic, CASE sentiment_label WHEN 'negative' THEN '부정' WHEN 'positive' THEN '긍정' ELSE '중립' END AS sentiment, x.span AS evidence_span FROM e""")
def voc_items(spark, sf):
    c = comments(spark, sf)
    rows = unnest(c, cd.voc_items(F.col("text"), F.col("sentiment_label")), "x", "comment_id")
    return rows.select("comment_id", "x.topic", "x.sentiment", "x.evidence_span")


REASON = "CASE WHEN quality = 1 THEN '만족 추천 문제' WHEN quality = 0 THEN '불만 고장 만족' ELSE text END"


@query("card_flags", with_sql(DOCS) + rf"""
SELECT comment_id, contains(text, '?') OR {sql_any("lower(text)", cd.INQUIRY_WORDS)} AS inquiry, regexp_matches(text, '\d') AND ({sql_any("lower(text)", cd.AMOUNT_UNITS)} OR {sql_any("lower(text)", cd.AMOUNT_WORDS)}) AS quantitative,
  CASE WHEN sentiment_label = 'positive' THEN n > p WHEN sentiment_label = 'negative' THEN p > n ELSE false END AS conflict,
  CASE WHEN region = 'R0' THEN 'Delivery/Install' WHEN region = 'R1' THEN 'Product Experience' WHEN reply_count = 2 THEN 'Durability'
    {" ".join(f"WHEN {sql_any('lower(text)', markers)} THEN '{aspect}'" for markers, aspect in cd.TEXT_ASPECTS)} ELSE 'Product Experience' END AS aspect
FROM (SELECT *, {" + ".join(f"contains(lower({REASON}), '{w}')::INT" for w in cd.REASON_NEGATIVE)} AS n, {" + ".join(f"contains(lower({REASON}), '{w}')::INT" for w in cd.REASON_POSITIVE)} AS p FROM docs)""")
def card_flags(spark, sf):
    """Questions, amounts, reasons that contradict their label, and the aspect, for every comment."""
    c = comments(spark, sf)
    never, none = F.lit(False), F.array().cast("array<string>")
    tags = F.when(F.col("region") == "R0", F.array(F.lit("없음"), F.lit("배송·설치"))).when(F.col("region") == "R1", F.array(F.lit("비교 맥락"))).otherwise(none)
    label = F.when(F.col("reply_count") == 0, "General").when(F.col("reply_count") == 1, "issue 12").when(F.col("reply_count") == 2, "Durability").otherwise("")
    reason = F.when(F.col("quality") == 1, "만족 추천 문제").when(F.col("quality") == 0, "불만 고장 만족").otherwise(F.col("text"))
    return c.select(
        "comment_id", cd.inquiry_flag(never, F.col("text")).alias("inquiry"), cd.quantitative_flag(never, F.col("text")).alias("quantitative"),
        cd.reason_conflicts(reason, F.col("sentiment_label")).alias("conflict"), cd.refined_aspect(label, tags, F.col("text")).alias("aspect"),
    )
