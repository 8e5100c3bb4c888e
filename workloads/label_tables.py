"""Lexicon labels, classification and truth over whole texts, with rules in the fixture's language."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxframe.functions.markers import hits
from voxframe.operators import labels as lb
from voxframe.operators import truth as tr
from voxframe.rules import comments as default_marks
from workloads.bindings import DOCS, comments, sql_any, sql_argmax, sql_hits, with_sql
from workloads.registry import query

# Fixture rules: fragments that occur in some of the invented texts and not in others.
STAGES = {"early": ("theron", "shing"), "middle": ("ention", "wherti"), "late": ("hathe", "eaucha", "sch ")}
BRANDS = {"north": ("thetion",), "south": ("erea", "ciónos"), "west": ("enonth", "heit")}
RISKS = ("Theer", "whre", "aison", "ungen")
SENTIMENT = lb.SentimentRules(
    positive={"ingth": 1.1, "anon": 0.8, "elle": 0.9, "keit": 1.0},
    negative={"sher": 1.2, "onre": 1.0, "eaux": 0.7, "ung": 0.6},
    negations=("the", "la"),
    intensifiers=("very", "atthe", "der "),
    complaints=("whwh.*ha", "pour la"),
    overrides=("ererer", "und der"),
)
RULES = lb.CommentRules(
    agreement=("as th", "est la"),
    short_dependent=("th",),
    comparison=("thanth", "ienre"),
    preference=("onand", "eché"),
    negative=("shth", "erno", "uxou", "verd"),
    positive=("ngon", "lyre", "ntai", "heitk"),
    informational=("edes", "aich"),
    emotional=("hahaha",),
    channel=("blebl",),
    generic_positive=("that it",),
    inquiry=("what", "is it", "wher"),
    product=("the", "les", "und", "los"),
    targets={"alpha": ("nder",), "beta": ("thes", "euxe"), "gamma": ("erei", "cióne")},
    target_labels={"alpha": "A", "beta": "B"},
    negation_safe=("no shth", "rshth"),
    positive_overrides=("whenlast",),
    sentiment=SENTIMENT,
)


def _argmax(t: str, table: dict, default: str) -> str:
    return sql_argmax({k: sql_hits(t, v) for k, v in table.items()}, f"'{default}'")


def _first(t: str, table: dict, default: str) -> str:
    return "CASE " + " ".join(f"WHEN {sql_any(t, v)} THEN '{k}'" for k, v in table.items()) + f" ELSE {default} END"


LOW = "low AS (SELECT *, lower(text) AS t FROM docs)"


@query("topic_label", with_sql(DOCS, LOW) + f"SELECT comment_id, {_argmax('t', STAGES, 'other')} AS topic_label FROM low")
def topic_label(spark, sf):
    c = comments(spark, sf).withColumn("t", F.lower("text"))
    return c.select("comment_id", lb.topic_by_markers(F.col("t"), STAGES, "other").alias("topic_label"))


NO_BRAND = "'none'"


@query("brand_label", with_sql(DOCS, LOW) + f"SELECT comment_id, {_first('t', BRANDS, NO_BRAND)} AS brand_label FROM low")
def brand_label(spark, sf):
    return comments(spark, sf).withColumn("t", F.lower("text")).select("comment_id", lb.brand_by_markers(F.col("t"), BRANDS, "none").alias("brand_label"))


@query("risk_flags", with_sql(DOCS, LOW) + "SELECT comment_id, concat_ws(', ', " + ", ".join(
    f"CASE WHEN contains(t, '{k.lower()}') THEN '{k}' END" for k in RISKS) + ") AS risk_flags FROM low")
def risk_flags(spark, sf):
    return comments(spark, sf).withColumn("t", F.lower("text")).select("comment_id", lb.risk_flags(F.col("t"), RISKS).alias("risk_flags"))


@query("marker_hits", with_sql(DOCS, LOW) + "SELECT comment_id, concat_ws('|', " + ", ".join(
    f"CASE WHEN contains(t, '{m}') THEN '{m}' END" for v in STAGES.values() for m in v) + ") AS hits FROM low")
def marker_hits(spark, sf):
    c = comments(spark, sf).withColumn("t", F.lower("text"))
    return c.select("comment_id", F.array_join(hits(F.col("t"), [m for v in STAGES.values() for m in v]), "|").alias("hits"))


def _weights(t: str, table: dict) -> str:
    return "(" + " + ".join(f"CASE WHEN contains({t}, '{k}') THEN {w} ELSE 0 END" for k, w in table.items()) + ")"


def _negated(t: str, table: dict) -> str:
    return "(" + " + ".join(
        f"CASE WHEN contains({t}, '{k}') AND ({' OR '.join(f'contains({t}, {chr(39)}{n}{k}{chr(39)}) OR contains({t}, {chr(39)}{n} {k}{chr(39)})' for n in SENTIMENT.negations)}) THEN {w} ELSE 0 END"
        for k, w in table.items()) + ")"


def sentiment_sql(source: str, t: str, label: str, score: str) -> str:
    """CTE body: sentiment label and score of column ``t`` of ``source``."""
    strong = f"(CASE WHEN {sql_any(t, SENTIMENT.intensifiers)} THEN 1.15 ELSE 1 END)"
    over = f"(CASE WHEN contains({t}, 'ererer') OR contains({t}, 'und der') THEN 1.0 ELSE 0 END)"
    complain = f"(CASE WHEN regexp_matches({t}, 'whwh.*ha') OR contains({t}, 'pour la') THEN 1.1 ELSE 0 END)"
    pos = f"({_weights(t, SENTIMENT.positive)} * {strong} + {over} - {_negated(t, SENTIMENT.positive)} + {_negated(t, SENTIMENT.negative)} * 0.6)"
    neg = f"({_weights(t, SENTIMENT.negative)} * {strong} + {complain} - {_negated(t, SENTIMENT.negative)} + {_negated(t, SENTIMENT.positive)} * 0.9)"
    return f"""SELECT *, CASE WHEN {score} >= 0.32 THEN 'positive' WHEN {score} <= -0.22 THEN 'negative' ELSE 'neutral' END AS {label} FROM (
  SELECT *, round(round(CASE WHEN {t} = '' THEN 0 WHEN abs(p_ + n_) < 1e-12 THEN (CASE WHEN n_complaint > 0 AND regexp_matches({t}, '[a-z]') THEN -0.25 ELSE 0 END)
                       ELSE (p_ - n_) / (p_ + n_) END, 9), 3) AS {score}
  FROM (SELECT *, CAST({pos} AS DOUBLE) AS p_, CAST({neg} AS DOUBLE) AS n_, {complain} AS n_complaint FROM {source}))"""


SCORED = f"scored AS ({sentiment_sql('low', 't', 'base_sentiment', 'base_score')})"


@query("lexicon_sentiment", with_sql(DOCS, LOW, SCORED) + "SELECT comment_id, base_sentiment, base_score FROM scored")
def lexicon_sentiment(spark, sf):
    out = lb.lexicon_sentiment(comments(spark, sf), "text", rules=SENTIMENT)
    return out.select("comment_id", "base_sentiment", "base_score")


VALENCES = {"the": 0.4, "of": -0.7, "la": 1.3, "der": -1.1, "with": 2.0, "que": -0.3}


@query("english_valence", with_sql(DOCS, LOW) + """
SELECT comment_id, round(s / sqrt(s * s + 15), 4) AS english_score FROM low LEFT JOIN (
  SELECT comment_id, sum(v) AS s FROM (SELECT comment_id, unnest(regexp_extract_all(t, '[\\p{L}\\p{M}\\p{N}\\p{Pc}'']+')) AS w FROM low)
  JOIN (VALUES """ + ", ".join(f"('{k}', {v})" for k, v in VALENCES.items()) + """) AS x(w, v) USING (w) GROUP BY 1) USING (comment_id)""")
def english_valence(spark, sf):
    rows = [(k, v) for k, v in VALENCES.items()]
    table = spark.createDataFrame(rows, "token string, valence double")
    return lb.valence_score(comments(spark, sf), "comment_id", "text", table).select("comment_id", "english_score")


def _conversation(spark, sf):
    """Turns as comments below the first turn of their conversation, titled by role."""
    from workloads.bindings import table

    c = table(spark, sf, "conversations")
    first = c.where("turn = 0").select("conv_id", F.col("text").alias("parent_text"))
    joined = c.join(first, "conv_id", "left")
    return joined.select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("comment_id"),
        F.col("text").alias("cleaned_text"),
        F.when(F.col("turn") > 0, F.col("parent_text")).otherwise("").alias("parent_comment_text"),
        (F.col("turn") > 0).alias("is_reply"),
        F.lit("valid").alias("comment_validity"),
        F.concat(F.col("role"), F.lit(" review")).alias("title"),
        F.lit("").alias("product"),
    )


CONV = r"""conv0 AS (
  SELECT CAST(c.conv_id AS VARCHAR) || '-' || CAST(c.turn AS VARCHAR) AS comment_id, trim(c.text, E' \n\t\r') AS source,
         CASE WHEN c.turn > 0 THEN trim(f.text, E' \n\t\r') ELSE '' END AS parent, c.turn > 0 AS is_reply, c.role || ' review' AS title
  FROM conversations c LEFT JOIN (SELECT conv_id, text FROM conversations WHERE turn = 0) f USING (conv_id)),
conv1 AS (SELECT *, lower(source) AS t, lower(parent) AS pt, lower(title || ' ') AS ctx FROM conv0)"""
R = RULES


def _strong_negative(t: str) -> str:
    trimmed = t
    for phrase in R.negation_safe:
        trimmed = f"replace({trimmed}, '{phrase}', '')"
    return f"({sql_any(t, R.negative)} AND {sql_any(trimmed, R.negative)})"


NORM = r"trim(regexp_replace({}, '\s+', ' ', 'g'))"
CLASS_CTES = [
    f"conv2 AS ({sentiment_sql('conv1', 't', 'own_label', 'own_score')})",
    f"conv3 AS (SELECT * EXCLUDE (p_, n_, n_complaint) FROM conv2)",
    f"conv4 AS ({sentiment_sql('conv3', 'pt', 'parent_label', 'parent_score')})",
    f"""flags AS (SELECT *, {sql_any('t', R.agreement)} AS agree, (length(source) <= 60 AND {sql_any('t', R.short_dependent)}) AS short_dep,
      {sql_any('t', R.product)} AS own, {sql_any('pt', R.product)} AS par, {sql_any('ctx', R.product)} AS cx,
      ({sql_any('t', R.channel)} OR {sql_any('t', R.emotional)} OR
       trim(regexp_replace(regexp_replace({NORM.format('t')}, '[^\\p{{L}}\\p{{M}}\\p{{N}}\\p{{Pc}}\\s]', ' ', 'g'), '\\s+', ' ', 'g')) = 'that it') AS offtopic,
      ({sql_any('t', R.comparison)} OR {sql_any('pt', R.comparison)}) AS cmp, {sql_any('t', R.preference)} AS pref,
      {_strong_negative('t')} AS neg, {sql_any('t', R.positive_overrides + R.positive)} AS pos,
      {_strong_negative('pt')} AS pneg, {sql_any('pt', R.positive_overrides + R.positive)} AS ppos, {sql_any('t', R.informational)} AS info,
      {_first("(t || ' ' || pt || ' ' || ctx)", R.targets, 'NULL')} AS product_target,
      (contains(source, '?') OR {sql_any(NORM.format('t'), R.inquiry)} OR {sql_any(NORM.format('pt'), R.inquiry)}) AS inq FROM conv4)""",
    """rel AS (SELECT *, own OR (NOT own AND NOT offtopic AND ((agree AND (par OR cx)) OR (par AND (cmp OR pref)))) AS related FROM flags)""",
    """cases AS (SELECT *, CASE WHEN NOT related THEN 'unrelated'
      WHEN cmp THEN CASE WHEN neg AND NOT pref THEN 'cmpneg' ELSE 'cmp' END
      WHEN pref AND NOT neg AND NOT pos THEN 'pref'
      WHEN parent <> '' AND (agree OR short_dep) THEN CASE WHEN par AND pneg THEN 'agneg' WHEN par AND ppos THEN 'agpos' ELSE 'ag' END
      WHEN neg THEN 'neg' WHEN pos THEN 'pos' WHEN info THEN 'info' WHEN own_label <> 'neutral' THEN 'unsure' ELSE 'plain' END AS k FROM rel)""",
    """res AS (SELECT comment_id, related AS product_related, product_target, inq AS nlp_is_inquiry,
      CASE WHEN k IN ('cmpneg', 'agneg', 'neg') THEN 'negative' WHEN k IN ('agpos', 'pos') THEN 'positive' ELSE 'neutral' END AS sentiment_label,
      CASE WHEN k IN ('cmpneg', 'agneg', 'neg', 'agpos', 'pos') THEN 'strong' ELSE 'weak' END AS signal_strength,
      CASE WHEN k IN ('cmpneg', 'cmp') THEN 'comparison' WHEN k IN ('pref', 'agpos', 'pos') THEN 'preference' WHEN k IN ('agneg', 'neg') THEN 'complaint'
           ELSE 'informational' END AS classification_type,
      CASE k WHEN 'cmpneg' THEN coalesce(nullif(own_score, 0), -0.3) WHEN 'agneg' THEN coalesce(nullif(parent_score, 0), -0.4)
             WHEN 'agpos' THEN coalesce(nullif(parent_score, 0), 0.4) WHEN 'neg' THEN coalesce(nullif(own_score, 0), -0.4)
             WHEN 'pos' THEN coalesce(nullif(own_score, 0), 0.4) WHEN 'unsure' THEN own_score WHEN 'plain' THEN own_score ELSE 0 END AS sentiment_score,
      (k IN ('agneg', 'agpos', 'ag') OR (k IN ('cmp', 'cmpneg') AND parent <> '')) AS context_used,
      (k IN ('ag', 'unsure') OR (k = 'unrelated' AND is_reply AND parent = '')) AS needs_review FROM cases)""",
    """graded AS (SELECT *, CASE WHEN sentiment_label = 'negative' THEN CASE WHEN signal_strength = 'strong' AND classification_type = 'complaint' THEN 'high' ELSE 'medium' END
      WHEN sentiment_label = 'positive' THEN CASE WHEN signal_strength = 'strong' THEN 'high' ELSE 'medium' END
      WHEN needs_review OR context_used THEN 'low' ELSE 'medium' END AS confidence_level,
      round(CAST(least(1, CASE WHEN product_related THEN 0.25 ELSE 0 END + CASE WHEN product_target IS NOT NULL THEN 0.08 ELSE 0 END
        + CASE WHEN classification_type <> 'informational' THEN 0.05 ELSE 0 END + CASE WHEN nlp_is_inquiry THEN 0.03 ELSE 0 END) AS DOUBLE), 6) AS relevance_score,
      CASE WHEN nlp_is_inquiry THEN '문의_피드백' WHEN classification_type = 'complaint' THEN '품질_불만' WHEN classification_type = 'preference' THEN '만족_포인트'
           WHEN sentiment_label = 'negative' THEN '품질_불만' WHEN sentiment_label = 'positive' THEN '만족_포인트' ELSE '일반_의견' END AS insight_type FROM res)""",
]


@query("comment_classes", with_sql(CONV, *CLASS_CTES) + "SELECT * FROM graded")
def comment_classes(spark, sf):
    out = lb.classify_comments(_conversation(spark, sf), rules=RULES)
    return out.select(
        "comment_id", "product_related", "product_target", "nlp_is_inquiry", "sentiment_label", "signal_strength", "classification_type",
        "sentiment_score", "context_used", "needs_review", "confidence_level", F.round("relevance_score", 6).alias("relevance_score"), "insight_type",
    )


@query("video_types", """
SELECT c_custkey, CASE WHEN contains(b, 'review') THEN 'review' WHEN contains(b, 'vs') THEN 'comparison' WHEN contains(b, 'guide') THEN 'tutorial' ELSE 'general' END AS video_type
FROM (SELECT c_custkey, lower(CASE c_mktsegment WHEN 'MACHINERY' THEN 'Honest Review' WHEN 'BUILDING' THEN 'A vs B' WHEN 'FURNITURE' THEN 'User guide' ELSE c_name END || ' ' || c_mktsegment) AS b FROM customer)""")
def video_types(spark, sf):
    from workloads.bindings import table

    c = table(spark, sf, "customer")
    seg = F.col("c_mktsegment")
    title = F.when(seg == "MACHINERY", "Honest Review").when(seg == "BUILDING", "A vs B").when(seg == "FURNITURE", "User guide").otherwise(F.col("c_name"))
    return c.select("c_custkey", lb.video_type(title, seg, default_marks.VIDEO_TYPE_PATTERNS).alias("video_type"))


# Truth ------------------------------------------------------------------------------------------

TRUTH = tr.TruthRules(
    stage_markers={"awareness": ("theron",), "exploration": ("ention", "shing"), "decision": ("wherti", "eaucha"), "usage": ("hathe", "sch ", "elle"),
                   "maintenance": ("onre", "ciónos"), "delivery": ("anon", "heit")},
    axis_markers={"price_value_fit": ("ingth", "eaux"), "brand_trust": ("erea", "ung"), "usage_pattern_fit": ("thetion",),
                  "durability_lifespan": ("enonth", "keit"), "design_interior_fit": ("sher",)},
    brand_names=("the", "der"),
    trust_cues=("anth", "ment"),
    topic_axes={"src1": "design_interior_fit", "src2": "brand_trust"},
    service_words=("erer",),
    inquiry_noise=("whwhwh",),
    inquiry_markers=("what", "wher"),
    usage_markers=("reed", "lala"),
    narratives=("hahaha",),
    non_customer=("thanthan", "dede"),
)


def truth_input(spark, sf):
    """Documents with class and product flag derived from their labels; external label and topics for rated ones."""
    c = comments(spark, sf)
    toxic, quality = F.col("toxic"), F.col("quality")
    return c.select(
        "comment_id", "video_id", "product", "region", "like_count", "reply_count", "published_at", F.col("text").alias("text_display"), F.lit("").alias("cleaned_text"),
        F.when(quality == 0, "excluded").otherwise("valid").alias("comment_validity"),
        F.when(quality == 0, "ad").otherwise("valid").alias("comment_quality"),
        F.when(F.col("region") == "R0", "negative").when(F.col("region") == "R1", "positive").otherwise("neutral").alias("sentiment_label"),
        F.when(toxic == 1, "negative").when(quality == 1, "positive").alias("nlp_label"),
        F.when((toxic == 1) & (quality == 1), F.create_map(F.lit("a"), F.lit("positive"), F.lit("b"), F.lit("negative"))).alias("nlp_topic_sentiments"),
        F.element_at(F.array(F.lit("complaint"), F.lit("comparison"), F.lit("preference"), F.lit("complaint"), F.lit("informational")), (F.col("like_count") % 5 + 1).cast("int")).alias("classification_type"),
        (F.col("reply_count") > 0).alias("product_related"),
        F.col("video_id").alias("topic_label"),
    )


def _stage_expr(stage: str) -> str:
    extra = {
        "exploration": " + CASE WHEN cls = 'comparison' THEN 2 ELSE 0 END + CASE WHEN inquiry_flag THEN 1 ELSE 0 END",
        "decision": " + CASE WHEN cls = 'preference' THEN 2 ELSE 0 END",
        "usage": " + CASE WHEN cls = 'complaint' THEN 1 ELSE 0 END + CASE WHEN sentiment_final = 'mixed' THEN 1 ELSE 0 END",
        "maintenance": " + CASE WHEN cls = 'complaint' AND contains(b, 'erer') THEN 2 ELSE 0 END",
    }
    base = sql_hits("b", TRUTH.stage_markers[stage]) if stage in TRUTH.stage_markers else "0"
    return f"({base}{extra.get(stage, '')}) AS s_{stage}"


STAGE_NAMES = [s for s in TRUTH.stages]
BEST = "greatest(" + ", ".join(f"s_{s}" for s in STAGE_NAMES) + ")"
AXIS_EXTRA = {
    "comparison_substitute_judgment": " + CASE WHEN cls = 'comparison' THEN 2 ELSE 0 END",
    "repurchase_recommendation": " + CASE WHEN cls = 'preference' THEN 2 ELSE 0 END + CASE WHEN st = 'replacement' THEN 1 ELSE 0 END",
    "maintenance_burden": " + CASE WHEN cls = 'complaint' THEN 2 ELSE 0 END + CASE WHEN st = 'maintenance' THEN 1 ELSE 0 END",
    "automation_convenience": " + CASE WHEN inquiry_flag THEN 1 ELSE 0 END + CASE WHEN st = 'onboarding' THEN 1 ELSE 0 END",
    "usage_pattern_fit": " + CASE WHEN sentiment_final = 'mixed' THEN 1 ELSE 0 END",
    "purchase_strategy_contract": " + CASE WHEN st IN ('purchase', 'decision') THEN 1 ELSE 0 END",
    "price_value_fit": " + CASE WHEN st IN ('purchase', 'decision') THEN 1 ELSE 0 END",
    "installation_space_fit": " + CASE WHEN st = 'delivery' THEN 1 ELSE 0 END",
    "service_after_sales": " + CASE WHEN st = 'maintenance' THEN 2 ELSE 0 END",
    "durability_lifespan": " + CASE WHEN st = 'replacement' THEN 1 ELSE 0 END",
    "design_interior_fit": " + CASE WHEN topic = 'src1' THEN 1 ELSE 0 END",
    "brand_trust": "",
}


def _axis_expr(axis: str) -> str:
    base = sql_hits("b", TRUTH.axis_markers[axis]) if axis in TRUTH.axis_markers else "0"
    if axis == "brand_trust":
        own = f"({base} + CASE WHEN topic = 'src2' THEN 1 ELSE 0 END)"
        return f"CASE WHEN {sql_hits('b', TRUTH.trust_cues)} = 0 THEN 0 ELSE {own} + least({sql_hits('b', TRUTH.brand_names)}, 2) END"
    return base + AXIS_EXTRA.get(axis, "")


TRUTH_SQL = [
    DOCS,
    r"""tin AS (SELECT comment_id, video_id, trim(text, E' \n\t\r') AS v, product, region, like_count, reply_count, published_at,
      CASE WHEN quality = 0 THEN 'excluded' ELSE 'valid' END AS validity,
      CASE region WHEN 'R0' THEN 'negative' WHEN 'R1' THEN 'positive' ELSE 'neutral' END AS base,
      CASE WHEN toxic = 1 THEN 'negative' WHEN quality = 1 THEN 'positive' END AS label, (toxic = 1 AND quality = 1) AS split,
      list_extract(['complaint', 'comparison', 'preference', 'complaint', 'informational'], CAST(like_count % 5 + 1 AS INTEGER)) AS cls, reply_count > 0 AS related,
      video_id AS topic FROM docs)""",
    """t1 AS (SELECT *, lower(v) AS b, coalesce(split, false) OR (base IN ('positive', 'negative') AND label IN ('positive', 'negative') AND base <> label) AS mx FROM tin)""",
    f"""t2 AS (SELECT *, CASE WHEN coalesce(mx, false) THEN 'mixed' ELSE coalesce(label, base) END AS sentiment_final, coalesce(mx, false) AS mixed_flag,
      (contains(v, '?') OR {sql_any('b', TRUTH.inquiry_markers)}) AND NOT contains(b, 'whwhwh') AND NOT (contains(b, 'hahaha') AND NOT contains(v, '?'))
      AND NOT (NOT {sql_any('b', TRUTH.usage_markers)} AND length(v) > 140) AND NOT (length(v) > 520 AND NOT contains(v, '?')) AS inquiry_flag FROM t1)""",
    """t3 AS (SELECT *, CASE WHEN validity <> 'valid' THEN 'trash' WHEN inquiry_flag OR cls = 'informational' THEN 'supporting' ELSE 'strategic' END AS hygiene_class FROM t2)""",
    "t4 AS (SELECT *, (validity = 'valid' AND v <> '' AND hygiene_class <> 'trash') AS analysis_included, " + ", ".join(_stage_expr(s) for s in STAGE_NAMES) + " FROM t3)",
    f"""t5 AS (SELECT *, {BEST} AS best, analysis_included AND hygiene_class = 'strategic' AS strat FROM t4)""",
    """t6 AS (SELECT *, CASE WHEN strat THEN CASE WHEN best > 0 THEN
      CASE WHEN s_maintenance = best AND cls = 'complaint' THEN 'maintenance' WHEN s_usage = best AND s_exploration = best AND NOT inquiry_flag THEN 'usage'
           WHEN s_decision = best AND s_exploration = best AND cls = 'preference' THEN 'decision' """
    + " ".join(f"WHEN s_{s} = best THEN '{s}'" for s in STAGE_NAMES) + """ END
      WHEN related THEN CASE WHEN cls IN ('comparison', 'informational') AND inquiry_flag THEN 'exploration' WHEN cls = 'preference' THEN 'decision' ELSE 'usage' END END END AS journey_stage FROM t5)""",
    "t7 AS (SELECT *, coalesce(journey_stage, '') AS st FROM t6)",
    "t8 AS (SELECT *, list_filter([" + ", ".join(f"{{'s': -({_axis_expr(a)}), 'i': {i}, 'a': '{a}'}}" for i, a in enumerate(TRUTH.axes)) + "], lambda x: x.s < 0) AS sc FROM t7)",
    """truth AS (SELECT comment_id, video_id, product, region, like_count, reply_count, published_at, cls, v AS text, hygiene_class, analysis_included, sentiment_final,
      mixed_flag, inquiry_flag, journey_stage,
      CASE WHEN NOT strat THEN [] WHEN len(sc) > 0 THEN list_transform(list_sort(sc)[1:3], lambda x: x.a)
           WHEN related THEN [CASE st WHEN 'maintenance' THEN 'service_after_sales' WHEN 'delivery' THEN 'installation_space_fit'
             ELSE CASE WHEN st IN ('purchase', 'decision', 'exploration') THEN 'price_value_fit' ELSE 'automation_convenience' END END] ELSE [] END AS judgment_axes,
      strat AND journey_stage IS NOT NULL AND NOT (contains(b, 'thanthan') OR contains(b, 'dede')) AS representative_eligibility FROM t8)""",
]


@query("truth_table", with_sql(*TRUTH_SQL) + """
SELECT comment_id, video_id, hygiene_class, analysis_included, sentiment_final, mixed_flag, inquiry_flag, journey_stage,
       array_to_string(judgment_axes, '|') AS judgment_axes, representative_eligibility, length(text) AS text_length FROM truth""")
def truth_table(spark, sf):
    out = tr.build_truth(truth_input(spark, sf), TRUTH)
    return out.select(
        "comment_id", "video_id", "hygiene_class", "analysis_included", "sentiment_final", "mixed_flag", "inquiry_flag", "journey_stage",
        F.array_join("judgment_axes", "|").alias("judgment_axes"), "representative_eligibility", F.length("text").alias("text_length"),
    )


@query("hygiene_subsets", with_sql(*TRUTH_SQL) + """
SELECT 'analysis_comments' AS subset, count(*) AS n FROM truth WHERE analysis_included
UNION ALL SELECT 'analysis_non_trash', count(*) FROM truth WHERE analysis_included AND hygiene_class <> 'trash'
UNION ALL SELECT 'analysis_strategic', count(*) FROM truth WHERE analysis_included AND hygiene_class = 'strategic'""")
def hygiene_subsets(spark, sf):
    from voxframe.operators.relational import union_all

    subsets = tr.hygiene_subsets(tr.build_truth(truth_input(spark, sf), TRUTH))
    return union_all([df.agg(F.lit(name).alias("subset"), F.count("*").alias("n")) for name, df in subsets.items()])


@query("final_sentiment", with_sql(*TRUTH_SQL) + "SELECT sentiment_final, mixed_flag, count(*) AS n FROM truth GROUP BY 1, 2")
def final_sentiment(spark, sf):
    c = truth_input(spark, sf)
    s = tr.final_sentiment(F.col("sentiment_label"), F.col("nlp_label"), F.col("nlp_topic_sentiments"))
    return c.select(s.alias("s")).groupBy(F.col("s.sentiment").alias("sentiment_final"), F.col("s.mixed").alias("mixed_flag")).agg(F.count("*").alias("n"))


@query("taxonomy_topics", with_sql(*TRUTH_SQL) + """
SELECT comment_id, coalesce(journey_stage, '') AS journey_stage, sentiment_final AS sentiment_label,
       CASE WHEN len(judgment_axes) = 0 THEN video_id ELSE array_to_string(list_transform(string_split(judgment_axes[1], '_'), lambda w: upper(w[1]) || w[2:]), ' ') END AS topic_label
FROM truth""")
def taxonomy_topics(spark, sf):
    truth = tr.build_truth(truth_input(spark, sf), TRUTH)
    merged = tr.merge_truth(truth_input(spark, sf), truth)
    return tr.normalize_taxonomy(merged).select("comment_id", "journey_stage", "sentiment_label", "topic_label")


SCORECARD = with_sql(DOCS) + r"""
SELECT comment_id, c + p + i + r + e + x AS representative_score,
       CASE WHEN polar AND c + p + i + r + e + x >= 24 AND NOT ctx AND cls <> 'informational' THEN 'strong_candidate'
            WHEN c + p + i + r + e + x >= 18 AND related THEN 'review_needed' ELSE 'not_suitable' END AS representative_decision
FROM (SELECT *, CASE WHEN n BETWEEN 25 AND 220 THEN 5 WHEN n BETWEEN 12 AND 280 THEN 4 ELSE 2 END AS c,
             CASE WHEN target <> '' THEN 5 WHEN related THEN 4 ELSE 2 END AS p,
             CASE WHEN polar AND cls = 'complaint' THEN 5 WHEN cls IN ('comparison', 'preference') OR related THEN 3 ELSE 1 END AS i,
             CASE WHEN conf = 'high' AND NOT review THEN 5 WHEN conf = 'medium' THEN 4 ELSE 2 END AS r,
             CASE WHEN NOT ctx AND conf = 'high' THEN 5 WHEN NOT ctx THEN 4 ELSE 2 END AS e, CASE WHEN NOT ctx THEN 5 ELSE 2 END AS x
      FROM (SELECT comment_id, length(trim(text, E' \n\t\r')) AS n, reply_count > 1 AS related, sentiment_label IN ('positive', 'negative') AS polar,
                   CASE region WHEN 'R0' THEN 'complaint' WHEN 'R1' THEN 'preference' ELSE 'informational' END AS cls,
                   CASE WHEN like_count > 10 THEN 'high' WHEN like_count > 5 THEN 'medium' ELSE 'low' END AS conf, reply_count = 3 AS ctx,
                   reply_count = 0 AS review, CASE WHEN product = 'en' THEN 'dryer' ELSE '' END AS target FROM docs))"""


def scorecard_input(spark, sf):
    c = comments(spark, sf)
    return c.select(
        "comment_id", "video_id", "product", "region", "like_count", "published_at", F.col("text").alias("text_display"), "sentiment_label",
        (F.col("reply_count") > 1).alias("product_related"),
        F.when(F.col("region") == "R0", "complaint").when(F.col("region") == "R1", "preference").otherwise("informational").alias("classification_type"),
        F.when(F.col("like_count") > 10, "high").when(F.col("like_count") > 5, "medium").otherwise("low").alias("confidence_level"),
        (F.col("reply_count") == 3).alias("context_required_for_display"), (F.col("reply_count") == 0).alias("needs_review"),
        F.when(F.col("product") == "en", "dryer").otherwise("").alias("product_target"),
    )


@query("representative_scorecard", SCORECARD)
def representative_scorecard(spark, sf):
    return tr.representative_scorecard(scorecard_input(spark, sf)).select("comment_id", "representative_score", "representative_decision")


@query("representatives", with_sql(
    "card AS (" + SCORECARD + ")", DOCS,
    r"""elig AS (SELECT d.*, representative_score, representative_decision FROM card JOIN docs d USING (comment_id)
        WHERE representative_decision <> 'not_suitable' AND d.region <> 'R2' AND d.reply_count > 1)""",
    r"""keyed AS (SELECT *, product || '|' || '|general|' || trim(regexp_replace(regexp_replace(lower(text), '[^\p{L}\p{M}\p{N}\p{Pc}\s]', ' ', 'g'), '\s+', ' ', 'g')) AS key FROM elig)""",
    """once AS (SELECT * FROM keyed QUALIFY row_number() OVER (PARTITION BY sentiment_label, key ORDER BY
        CASE WHEN representative_decision = 'strong_candidate' THEN 0 ELSE 1 END, representative_score DESC, like_count DESC NULLS LAST, comment_id) = 1)""",
) + """
SELECT comment_id, sentiment_label, row_number() OVER (PARTITION BY sentiment_label ORDER BY
  CASE WHEN representative_decision = 'strong_candidate' THEN 0 ELSE 1 END, representative_score DESC, like_count DESC NULLS LAST, comment_id) AS label_rank
FROM once QUALIFY label_rank <= 8""")
def representatives(spark, sf):
    from voxframe.operators.descriptive import representative_comments

    card = tr.representative_scorecard(scorecard_input(spark, sf)).withColumns(
        {"judgment_axes": F.array().cast("array<string>"), "sentiment_score": F.lit(0.0), "journey_stage": F.lit(""), "cleaned_text": F.col("text_display")}
    )
    return representative_comments(card).select("comment_id", "sentiment_label", "label_rank")
