"""The topic run over documents: products, signals, topics, ranks, representatives, gate, actions, export."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxframe.operators import signals as sg
from voxframe.operators import topics as tp
from voxframe.plans.topic_plan import run_topics
from voxframe.rules import signals as marks
from workloads.bindings import DOCS, comments, sql_any, with_sql
from workloads.registry import query

CONNECTORS = (("contrast", (" (?:that|que) ", " und ")), ("causal", (" (?:with|por) ",)), ("additive", (" (?:and|et) ",)))
STAGES = {"exploration": ("theron", "elle"), "usage": ("shing", "ention"), "maintenance": ("onre", "mente")}
AXES = {
    "price_value_fit": (("the", 1.0), ("der", 0.8)), "service_after_sales": (("of", 0.9), ("la", 1.0), ("thth", 0.5)),
    "comparison_substitute_judgment": (("to", 1.9), ("el", 2.3)), "maintenance_burden": (("in", 0.6), ("is", 0.6)),
}
RULES = sg.SignalRules(
    connectors=CONNECTORS, brands=("erea", "heit"), products=("anon", "keit", "ciónos"), positive=("ingth", "eau", "ung"), negative=("sher", "onre", "ñ"),
    stages=STAGES, axes=AXES, comparison=r"(?:this|est|con)", generic=("^thth",), named=(("nova", ("shnt", "eauan")),), lines=(("prime", ("the", "que")),),
    categories=(("dryer", ("haea", "sch")), ("washer", ("anre", "eaueux", "osbo"))), named_category={"nova": "washer"}, excluded={"dryer": ("haea ed",)},
)


def _bounded(text: str, marker: str) -> str:
    return f"regexp_matches({text}, '(^|[^a-z0-9]){marker}($|[^a-z0-9])')" if marker.isascii() else f"contains({text}, '{marker}')"


def _pieces(text: str, pattern: str) -> str:
    return f"list_filter(list_transform(string_split_regex({text}, '{pattern}'), lambda p: trim(p, ' ,.;!?')), lambda p: p <> '')"


def _meaningful(p: str) -> str:
    return f"(length({p}) >= 4 AND length(regexp_replace({p}, '[^A-Za-z0-9가-힣]', '', 'g')) >= 3)"


def _split(text: str) -> str:
    """SQL struct of rule and pieces of the first connector that works, else null."""
    whens = []
    for rule, patterns in CONNECTORS:
        for p in patterns:
            whens.append(
                f"WHEN len({_pieces(text, p)}) > 1 AND len(list_filter({_pieces(text, p)}, lambda s: NOT {_meaningful('s')})) = 0 THEN {{'rule': '{rule}', 'pieces': {_pieces(text, p)}}}"
            )
    return "CASE " + " ".join(whens) + " END"


def _alias(name: str, specs) -> str:
    cases = " ".join(f"WHEN {' OR '.join(_bounded('tt', a) for a in aliases)} THEN '{label}'" for label, aliases in specs)
    return f"CASE {cases} END AS {name}"


def _stage(text: str) -> str:
    scores = {s: "(" + " + ".join(f"CAST({_bounded(text, m)} AS INTEGER)" for m in ms) + ")" for s, ms in STAGES.items()}
    best = "greatest(" + ", ".join(scores.values()) + ")"
    return f"CASE WHEN {best} >= 1 THEN CASE " + " ".join(f"WHEN {e} = {best} THEN '{s}'" for s, e in scores.items()) + " END END"


AXIS_SCORES = {a: "(" + " + ".join(f"CASE WHEN {_bounded('low', m)} THEN CAST({w} AS DOUBLE) ELSE 0 END" for m, w in ms) + ")" for a, ms in AXES.items()}
CTX = [
    DOCS,
    r"""ctx0 AS (SELECT comment_id, video_id, coalesce(text, '') AS raw_text, product AS product_raw, sentiment_label, like_count, reply_count, region,
      ' ' || lower(trim(regexp_replace(product || ' ' || text || ' ', '\s+', ' ', 'g'))) || ' ' AS tt, trim(regexp_replace(text, '\s+', ' ', 'g')) AS txt FROM docs)""",
    f"ctx1 AS (SELECT *, {_alias('named', RULES.named)}, {_alias('line', RULES.lines)}, {_alias('cat0', RULES.categories)} FROM ctx0)",
    """ctx2 AS (SELECT *, CASE WHEN named = 'nova' THEN 'washer' WHEN cat0 = 'dryer' AND contains(tt, 'haea ed') THEN NULL ELSE cat0 END AS cat FROM ctx1)""",
    """ctx AS (SELECT *, 'cat:' || coalesce(cat, 'unknown') || '|line:' || coalesce(line, 'na') || '|name:' || coalesce(named, 'na') AS product_semantic_id FROM ctx2)""",
]
SIGNALS = [
    *CTX,
    f"sp1 AS (SELECT *, {_split('txt')} AS s1 FROM ctx WHERE txt <> '')",
    "sp2 AS (SELECT *, unnest(s1.pieces) AS piece, unnest(range(1, len(s1.pieces) + 1)) AS i FROM sp1 WHERE s1 IS NOT NULL)",
    f"sp3 AS (SELECT comment_id, i, s1.rule AS rule1, piece, {_split('piece')} AS s2 FROM sp2)",
    """sp4 AS (SELECT comment_id, i, CASE WHEN s2 IS NULL THEN [piece] ELSE s2.pieces END AS ps, CASE WHEN s2 IS NULL THEN rule1 ELSE s2.rule END AS rule FROM sp3)""",
    """sp5 AS (SELECT comment_id, i, unnest(ps) AS seg, unnest(range(1, len(ps) + 1)) AS j, rule FROM sp4)""",
    """sp6 AS (SELECT comment_id, seg, rule, row_number() OVER (PARTITION BY comment_id ORDER BY i, j) AS pos FROM sp5)""",
    """sp7 AS (SELECT comment_id, seg, rule, pos FROM sp6 UNION ALL SELECT comment_id, txt, 'fallback_single', 1 FROM sp1 WHERE s1 IS NULL)""",
    r"sg0 AS (SELECT s.*, trim(regexp_replace(seg, '\s+', ' ', 'g')) AS signal_text, c.* EXCLUDE (comment_id), lower(trim(regexp_replace(seg, '\s+', ' ', 'g'))) AS low FROM sp7 s JOIN ctx c USING (comment_id))",
    "sg1 AS (SELECT *, " + ", ".join(f"{e} AS x{i}" for i, e in enumerate(AXIS_SCORES.values())) + f""", {_meaningful('signal_text')} AS ok,
      {sql_any('low', RULES.brands)} AS br, {sql_any('low', RULES.products)} AS pr, {sql_any('lower(txt)', RULES.brands)} AND {sql_any('lower(txt)', RULES.products)} AS whole_both,
      {sql_any('low', RULES.positive)} AS ps, {sql_any('low', RULES.negative)} AS ng, regexp_matches(low, '(this|est|con)') AS compared FROM sg0)""",
    """sg2 AS (SELECT *, greatest(x0, x1, x2, x3) AS xb, CASE greatest(x0, x1, x2, x3) """ + " ".join(f"WHEN x{i} THEN '{a}'" for i, a in enumerate(AXES)) + """ END AS xa,
      CASE WHEN rule = 'fallback_single' AND whole_both AND ok THEN 'brand_product' ELSE rule END AS split_rule FROM sg1)""",
    f"""sig AS (SELECT comment_id || '#s' || CAST(pos AS VARCHAR) AS signal_id, comment_id, video_id, signal_text, CASE WHEN pos = 1 THEN 'primary' ELSE 'secondary' END AS signal_type, split_rule,
      coalesce({_stage('low')}, 'usage') AS journey_stage,
      CASE WHEN xa = 'comparison_substitute_judgment' THEN CASE WHEN xb >= 2.2 OR (xb >= 1.8 AND compared) THEN xa ELSE 'usage_pattern_fit' END WHEN xb >= 1.0 THEN xa ELSE 'usage_pattern_fit' END AS judgment_axis,
      CASE WHEN ps AND ng THEN 'mixed' WHEN ng THEN 'negative' WHEN ps THEN 'positive' ELSE sentiment_label END AS polarity,
      CASE WHEN NOT ok THEN 0.6 WHEN length(signal_text) <= 10 OR (length(signal_text) - length(replace(signal_text, '?', '')) >= 4 AND length(regexp_replace(signal_text, '[^A-Za-z0-9가-힣]', '', 'g')) < 15)
        OR (regexp_matches(low, '^thth') AND xb <= 0) THEN 0.45 WHEN pos = 1 THEN 1.0 WHEN split_rule IN ('contrast', 'causal', 'conditional', 'brand_product') THEN 0.85 ELSE 0.75 END::DOUBLE AS weight,
      product_semantic_id, CASE WHEN br AND pr THEN 'both' WHEN br THEN 'brand_only' ELSE 'product_only' END AS brand_scope, coalesce(like_count, 0) AS like_count, coalesce(reply_count, 0) AS reply_count FROM sg2)""",
]


def topic_input(spark, sf):
    c = comments(spark, sf)
    return c.select("comment_id", "video_id", F.col("text").alias("text_display"), "product", "sentiment_label", "like_count", "reply_count", "region", "published_at")


def _context(spark, sf):
    return sg.normalize_products(sg.comment_context(topic_input(spark, sf)), RULES)


@query("product_normalizer", with_sql(*CTX) + """
SELECT comment_id, product_semantic_id, coalesce(cat, 'unknown') AS product_category, line AS product_line, named AS named_product,
  CASE WHEN named IS NOT NULL THEN 0.96 WHEN line IS NOT NULL AND cat IS NOT NULL THEN 0.88 WHEN cat IS NOT NULL THEN 0.82 ELSE 0.40 END::DOUBLE AS normalization_confidence FROM ctx""")
def product_normalizer(spark, sf):
    return _context(spark, sf).select("comment_id", "product_semantic_id", "product_category", "product_line", "named_product", "normalization_confidence")


@query("comment_context", with_sql(DOCS) + """
SELECT comment_id, length(text) AS n, CASE WHEN regexp_matches(text, '[가-힣]') THEN 'ko' ELSE 'unknown' END AS language, strftime(published_at, '%Y-%m-%dT%H:%M:%S') AS timestamp,
  sentiment_label AS sentiment_seed, like_count FROM docs""")
def comment_context(spark, sf):
    c = sg.comment_context(topic_input(spark, sf))
    return c.select("comment_id", F.length("raw_text").alias("n"), "language", "timestamp", "sentiment_seed", "like_count")


@query("signals", with_sql(*SIGNALS) + "SELECT * FROM sig")
def signals(spark, sf):
    return sg.signal_units(_context(spark, sf), RULES)


STOP = ", ".join(f"'{w}'" for w in marks.GENERIC_STOPWORDS)
FORMS = "CASE t " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in marks.TOKEN_NORMALIZATION.items()) + " ELSE t END"
GROUP = "product_semantic_id, journey_stage, judgment_axis, polarity_group"
TOPICS = [
    *SIGNALS,
    "sigp AS (SELECT *, lower(polarity) AS polarity_group FROM sig)",
    f"gsz AS (SELECT {GROUP}, count(*) AS n FROM sigp GROUP BY ALL)",
    f"""gtk AS (SELECT {GROUP}, {FORMS} AS token FROM (SELECT {GROUP}, lower(unnest(string_split_regex(signal_text, '[^A-Za-z0-9가-힣]+'))) AS t FROM sigp))""",
    f"gct AS (SELECT {GROUP}, token, count(*) AS c FROM gtk WHERE length(token) >= 2 AND token NOT IN ({STOP}) GROUP BY ALL)",
    f"grk AS (SELECT *, c >= CASE WHEN n >= 20 THEN 3 ELSE 2 END AS rep, row_number() OVER (PARTITION BY {GROUP} ORDER BY c >= CASE WHEN n >= 20 THEN 3 ELSE 2 END DESC, c DESC, token) AS r FROM gct JOIN gsz USING ({GROUP}))",
    f"gsig AS (SELECT {GROUP}, string_agg(token, '_' ORDER BY r) AS w FROM (SELECT *, bool_or(rep) OVER (PARTITION BY {GROUP}) AS anyrep FROM grk WHERE r <= 2) WHERE rep OR NOT anyrep GROUP BY ALL)",
    f"""tsig AS (SELECT s.*, journey_stage || '_' || judgment_axis || '_' || coalesce(w, 'general') AS signature FROM sigp s LEFT JOIN gsig USING ({GROUP}))""",
    """tk AS (SELECT *, journey_stage || '|' || judgment_axis || '|' || polarity_group || '|' || product_semantic_id || '|' || signature AS topic_key FROM tsig)""",
    "tsg AS (SELECT *, 't_' || left(sha1(topic_key), 12) AS topic_id FROM tk)",
    f"tops AS (SELECT topic_id, topic_key, {GROUP}, signature, count(*) AS signal_count, count(DISTINCT comment_id) AS comment_count FROM tsg GROUP BY ALL)",
]


def _run(spark, sf):
    return run_topics(topic_input(spark, sf), rules=RULES)


@query("topics", with_sql(*TOPICS) + "SELECT * FROM tops")
def topics(spark, sf):
    from voxframe.session import materialize

    return tp.build_topics(tp.attach_topics(materialize(sg.signal_units(_context(spark, sf), RULES))))


RANK = [
    *TOPICS,
    """st AS (SELECT topic_id, count(*) AS n, count(*) FILTER (polarity = 'positive') AS p, count(*) FILTER (polarity = 'negative') AS g, count(*) FILTER (polarity = 'mixed') AS m,
      count(*) FILTER (polarity = 'neutral') AS u, sum(like_count) + 1.5 * sum(reply_count) AS impact, count(*) FILTER (regexp_matches(signal_text, '(this|est|con)')) AS mk FROM tsg GROUP BY 1)""",
    """r0 AS (SELECT t.*, s.*  EXCLUDE (topic_id), signal_count AS f, comment_count AS k, comment_count / (SELECT count(DISTINCT comment_id) FROM tsg) * 100.0 AS cov,
      g / n + 0.7 * m / n AS nm, judgment_axis = 'comparison_substitute_judgment' AS cmp FROM tops t JOIN st s USING (topic_id))""",
    """r1 AS (SELECT *, CASE WHEN cmp THEN mk / n ELSE 0 END AS mr, 0.40 * least(cov / 100, 1) + 0.25 * least(f / 50.0, 1) + 0.25 * (nm + 0.2 * u / n) + 0.10 * least(ln(1 + greatest(impact, 0)) / 6, 1) AS imp,
      f < 3 OR k < 2 OR cov < 1 AS weak FROM r0)""",
    """r2 AS (SELECT *, CAST((CASE WHEN cov < 3 THEN 0.8 ELSE 1 END) AS DOUBLE) * (CASE WHEN cov < 1 THEN 0.65 ELSE 1 END) * (CASE WHEN weak THEN 0.7 ELSE 1 END) * (CASE WHEN k / f < 0.56 THEN 0.82 ELSE 1 END)
      * (CASE WHEN cov < 2 AND f < 20 THEN 0.72 ELSE 1 END) * (CASE WHEN f / k > 3.8 THEN 0.86 ELSE 1 END) * (CASE WHEN cov >= 6 AND k >= 25 THEN 1.06 ELSE 1 END)
      * (CASE WHEN cmp AND mr < 0.35 THEN 0.56 ELSE 1 END) * (CASE WHEN cmp AND (cov < 2.8 OR k < 15) THEN 0.6 ELSE 1 END) * (CASE WHEN cmp AND nm < 0.35 THEN 0.72 ELSE 1 END) AS pen,
      concat_ws('|', CASE WHEN cmp AND mr < 0.35 THEN 'comparison_marker_weak' END, CASE WHEN cmp AND nm < 0.35 THEN 'comparison_signal_weak' END, CASE WHEN cmp AND (cov < 2.8 OR k < 15) THEN 'comparison_support_weak' END,
        CASE WHEN weak THEN 'insufficient_evidence' END, CASE WHEN cov < 2 AND f < 20 THEN 'micro_topic' END, CASE WHEN f / k > 3.8 THEN 'over_split' END, CASE WHEN k / f < 0.56 THEN 'weak_cohesion' END) AS why FROM r1)""",
    "rk AS (SELECT *, round(CAST(imp * (1 + 0.35 * nm) * 100 * pen AS DOUBLE), 4) AS score FROM r2)",
]


@query("topic_rank", with_sql(*RANK) + """
SELECT topic_id, f AS frequency_count, round(cov, 4) AS coverage_pct, round(CAST(nm AS DOUBLE), 6) AS negative_or_mixed_weight, round(CAST(imp AS DOUBLE), 6) AS importance_signal, score AS rank_score,
  weak AS insufficient_evidence, round(k / f, 6) AS cohesion_ratio, round(pen, 6) AS ranking_penalty, why AS top_exclusion_reason, round(CAST(mr AS DOUBLE), 6) AS comparison_marker_ratio FROM rk""")
def topic_rank(spark, sf):
    from voxframe.session import materialize

    units = materialize(sg.signal_units(_context(spark, sf), RULES))
    s = materialize(tp.attach_topics(units))
    r = tp.rank_topics(materialize(tp.build_topics(s)), s, RULES.comparison)
    return r.select(
        "topic_id", "frequency_count", "coverage_pct", "negative_or_mixed_weight", "importance_signal", "rank_score", "insufficient_evidence", "cohesion_ratio",
        "ranking_penalty", "top_exclusion_reason", "comparison_marker_ratio",
    )


def _kw(axis_words) -> str:
    n = "(" + " + ".join(f"CAST(contains(low, '{w}') AS INTEGER)" for w in axis_words) + ")"
    return f"CASE WHEN {n} >= 2 THEN 1.0 WHEN {n} = 1 THEN 0.75 ELSE 0.25 END"


NOISE = ", ".join(f"'{w}'" for w in marks.SIGNATURE_NOISE)
REPS = [
    *RANK,
    f"""q0 AS (SELECT *, lower(signal_text) AS low, list_filter(list_distinct(list_filter(string_split_regex(lower(signature), '[^A-Za-z0-9가-힣]+'), lambda t: length(t) >= 2)), lambda t: t NOT IN ({NOISE})) AS sgw,
      list_distinct(list_filter(string_split_regex(lower(signal_text), '[^A-Za-z0-9가-힣]+'), lambda t: length(t) >= 2)) AS tw FROM tsg)""",
    "q1 AS (SELECT *, CASE judgment_axis " + " ".join(f"WHEN '{a}' THEN {_kw(ws)}" for a, ws in marks.AXIS_KEYWORDS.items()) + """ ELSE 1.0 END AS kw,
      CASE WHEN len(sgw) = 0 THEN 0.75 ELSE least(1.0, greatest(0.2, len(list_intersect(sgw, tw)) / len(sgw))) END AS so,
      CASE WHEN regexp_matches(signal_text, '(this|est|con)') THEN 1.0 ELSE 0.2 END AS cs,
      CASE WHEN length(signal_text) < 14 THEN 0.40 WHEN length(signal_text) - length(replace(signal_text, '?', '')) >= 4 AND length(regexp_replace(signal_text, '[^A-Za-z0-9가-힣]', '', 'g')) < 20 THEN 0.6 ELSE 1.0 END AS gp FROM q0)""",
    """q2 AS (SELECT topic_id, comment_id, judgment_axis, count(*) AS d, avg(weight) AS w, count(*) FILTER (signal_type = 'primary') AS pc, avg(gp) AS gp, avg(kw) AS kw, avg(so) AS so, avg(cs) AS cs FROM q1 GROUP BY 1, 2, 3)""",
    """q3 AS (SELECT *, CASE WHEN judgment_axis = 'comparison_substitute_judgment' THEN kw >= 0.85 AND cs >= 0.6 AND so >= 0.45 ELSE kw >= 0.6 END AS pass FROM q2)""",
    """q4 AS (SELECT *, bool_or(pass) OVER (PARTITION BY topic_id) AS anyp FROM q3 WHERE judgment_axis <> 'comparison_substitute_judgment' OR pass)""",
    "q5 AS (SELECT *, max(d) OVER (PARTITION BY topic_id) AS pk FROM q4 WHERE pass OR NOT anyp)",
    """q6 AS (SELECT *, round(CAST((0.26 * d / pk + 0.14 * w + CASE WHEN pc > 0 THEN 0.08 ELSE 0 END + 0.34 + 0.12 * so + 0.06 * cs) * gp * kw AS DOUBLE), 9) AS comp FROM q5)""",
    """q7 AS (SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY comp DESC, d DESC, round(so, 9) DESC, comment_id) AS r FROM q6 QUALIFY r <= 3)""",
    "q8 AS (SELECT topic_id, string_agg(comment_id, ',' ORDER BY r) AS ids, avg(comp) AS sc, count(*) AS nr FROM q7 GROUP BY 1)",
    """rp AS (SELECT t.topic_id, CASE WHEN sc >= 0.3 THEN ids ELSE '' END AS ids, CASE WHEN sc >= 0.3 THEN nr ELSE 0 END AS nr, round(coalesce(sc, 0), 6) AS al,
      CASE WHEN sc IS NULL THEN 'no viable representative candidates' WHEN sc < 0.3 THEN 'representative quality below hard floor' ELSE 'axis/polarity/product + signature overlap' END AS why FROM tops t LEFT JOIN q8 USING (topic_id))""",
]


@query("topic_reps", with_sql(*REPS) + "SELECT topic_id, ids AS representative_comment_ids, al AS alignment_score, why AS selection_reason FROM rp")
def topic_reps(spark, sf):
    r = _run(spark, sf)["topic_representatives"]
    return r.select("topic_id", F.array_join("representative_comment_ids", ",").alias("representative_comment_ids"), "alignment_score", "selection_reason")


GATE = [
    *REPS,
    """gt0 AS (SELECT k.*, al, ids, nr FROM rk k JOIN rp USING (topic_id))""",
    """gt AS (SELECT *, round(score * (CASE WHEN why = '' THEN 1 ELSE 0.55 END) * (CASE WHEN nr = 0 THEN 0.3 ELSE 1 END) * (CASE WHEN al < 0.5 THEN 0.5 ELSE 1 END) * (CASE WHEN cmp AND al < 0.6 THEN 0.55 ELSE 1 END)
      * (CASE WHEN cmp AND round(mr, 6) < 0.45 THEN 0.6 ELSE 1 END) * (CASE WHEN cmp AND round(cov, 4) < 3 THEN 0.65 ELSE 1 END) * (CASE WHEN weak THEN 0.7 ELSE 1 END), 4) AS gscore,
      list_sort(list_distinct(list_filter(string_split(why, '|') || [CASE WHEN nr = 0 THEN 'no_representative' ELSE '' END, CASE WHEN al < 0.5 THEN 'low_alignment' ELSE '' END,
        CASE WHEN cmp AND al < 0.6 THEN 'comparison_low_alignment' ELSE '' END, CASE WHEN cmp AND round(mr, 6) < 0.45 THEN 'comparison_marker_insufficient' ELSE '' END,
        CASE WHEN cmp AND round(cov, 4) < 3 THEN 'comparison_low_coverage' ELSE '' END, CASE WHEN weak THEN 'insufficient_evidence' ELSE '' END], lambda x: x <> ''))) AS reasons FROM gt0)""",
]


@query("topic_gate", with_sql(*GATE) + """
SELECT topic_id, CAST(gscore AS DOUBLE) AS rank_score, len(reasons) = 0 AS top_quality_pass, array_to_string(reasons, '|') AS top_exclusion_reason, nr AS representative_count FROM gt""")
def topic_gate(spark, sf):
    return _run(spark, sf)["topic_ranked"].select("topic_id", "rank_score", "top_quality_pass", "top_exclusion_reason", "representative_count")


ACTION = "CASE judgment_axis " + " ".join(
    f"WHEN '{a}' THEN [" + ", ".join(f"'{o}'" for o in opts) + f"][CAST(('0x' || left(sha1(topic_id), 4)) AS INTEGER) % {len(opts)} + 1]" for a, opts in marks.ACTION_CATALOG.items()) + " END"


@query("topic_actions", with_sql(*GATE) + f"""
SELECT topic_id, CASE WHEN weak THEN 'monitor' WHEN gscore >= 72 AND nm >= 0.55 THEN 'immediate_fix' WHEN gscore >= 42 THEN 'short_term_improvement' ELSE 'monitor' END AS priority_level,
  CAST(round(CASE WHEN weak THEN least(0.49, e) ELSE e END, 6) AS DOUBLE) AS evidence_strength, ids AS supporting_comment_ids, true AS has_action
FROM (SELECT *, least(1.0, greatest(0.0, 0.7 * round(imp, 6) + 0.3 * al)) AS e, {ACTION} AS act FROM gt) WHERE act IS NOT NULL""")
def topic_actions(spark, sf):
    out = _run(spark, sf)["topic_actions"]
    known = None
    for options in marks.ACTION_CATALOG.values():
        for text in options:
            test = F.col("action_text").contains(text)
            known = test if known is None else known | test
    return out.select("topic_id", "priority_level", "evidence_strength", F.array_join("supporting_comment_ids", ",").alias("supporting_comment_ids"), known.alias("has_action"))


@query("topic_export", with_sql(*GATE) + """
SELECT topic_id, CASE polarity_group WHEN 'negative' THEN 'NEG' WHEN 'positive' THEN 'POS' WHEN 'mixed' THEN 'MIX' ELSE 'NEU' END AS topic_group,
  'T' || CAST(row_number() OVER (PARTITION BY polarity_group ORDER BY gscore DESC, topic_id) AS VARCHAR) AS topic_rank, polarity_group, nr AS comments FROM gt""")
def topic_export(spark, sf):
    out = _run(spark, sf)["topic_export_rows"]
    n = F.size(F.from_json("comment_list", "array<struct<comment_id:string,text:string>>"))
    return out.select("topic_id", "topic_group", "topic_rank", "polarity_group", n.alias("comments"))


@query("topic_share", with_sql(*TOPICS) + "SELECT judgment_axis, CAST(sum(signal_count) AS BIGINT) AS frequency_count FROM tops GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 8")
def topic_share(spark, sf):
    out = _run(spark, sf)
    return tp.topic_share(out["topic_ranked"], out["topics"], "judgment_axis")
