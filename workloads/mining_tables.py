"""Text mining over whole documents with a vocabulary of their frequent words."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxframe.operators import mining as mn
from voxframe.operators import patterns as pt
from voxframe.session import materialize
from workloads.bindings import DOCS, comments, with_sql
from workloads.registry import query

P, A, I = ("the", "of", "and", "de", "der", "la"), ("to", "in", "is", "die", "les", "el"), ("that", "it", "for", "und", "que", "des", "with")
RULES = mn.MiningRules(
    token=r"\p{L}+", forms={"was": "is", "den": "der"}, stopwords=("des",), products=P, actions=A, issues=I, causes=("of", "de", "for"),
    symptoms=("that", "que", "it"), descriptors=("of", "in"), compounds=(("of", "the"), ("de", "la")), trailing_issues=("with",), weak_sentiment=("with",),
    generic=("the", "de", "of"), hubs=("the", "de"), abstract=("it", "que"), water="la", water_actions=("is",),
)
VOCAB = tuple(v for v in RULES.vocabulary if v != "des")


def _in(col: str, values) -> str:
    return f"{col} IN (" + ", ".join(f"'{v}'" for v in values) + ")"


SINGULARS = ", ".join(f"'{v}s'" for v in RULES.vocabulary if len(v) >= 3)
TOKS = [
    DOCS,
    r"""mt AS (SELECT comment_id, product, video_id, published_at, list_transform(regexp_extract_all(
      trim(regexp_replace(regexp_replace(text, '(?i)https?://\S+|\bwww\.\S+', ' ', 'g'), '\s+', ' ', 'g')), '\p{L}+'),
      lambda t: CASE lower(t) WHEN 'was' THEN 'is' WHEN 'den' THEN 'der' ELSE lower(t) END) AS raw FROM docs)""",
    f"""mtok AS (SELECT * EXCLUDE (raw), list_filter(list_transform(raw, lambda t: CASE WHEN t IN ({SINGULARS}) THEN left(t, length(t) - 1) ELSE t END),
      lambda t: {_in('t', VOCAB)}) AS toks FROM mt)""",
    "mmap AS (SELECT comment_id, product, video_id, published_at, unnest(list_distinct(toks)) AS keyword FROM mtok)",
]


def base(spark, sf):
    return mn.base_frame(comments(spark, sf))


@query("comment_keyword_map", with_sql(*TOKS) + "SELECT comment_id, keyword FROM mmap")
def comment_keyword_map(spark, sf):
    return mn.keyword_map(base(spark, sf), RULES)


@query("keyword_coverage", with_sql(*TOKS) + """
SELECT keyword, count, round(docs_with * 100.0 / (SELECT count(*) FROM docs), 3) AS coverage_pct FROM (
  SELECT unnest(toks) AS keyword, count(*) AS count FROM mtok GROUP BY 1) JOIN (SELECT keyword, count(*) AS docs_with FROM mmap GROUP BY 1) USING (keyword)""")
def keyword_coverage(spark, sf):
    return mn.keyword_coverage(base(spark, sf), RULES)


@query("phrases", with_sql(*TOKS) + f""", pos AS (SELECT comment_id, toks, unnest(range(1, len(toks))) AS i FROM mtok WHERE len(toks) >= 2),
bi AS (SELECT toks[i] AS a, toks[i + 1] AS b, count(*) AS count FROM pos GROUP BY 1, 2)
SELECT a || ' ' || b AS phrase, count FROM bi WHERE count >= 3 AND a <> b AND ((a = 'of' AND b = 'the') OR (a = 'de' AND b = 'la') OR NOT (
  ({_in('a', RULES.descriptors)} AND {_in('b', RULES.descriptors)}) OR NOT ({_in('a', P)} OR {_in('b', P)}) OR NOT ({_in('a', A + I)} OR {_in('b', A + I)})
  OR ({_in('a', P)} AND {_in('b', P)}) OR (b = 'la' AND a = 'is') OR ({_in('a', P)} AND ({_in('b', A)} OR b = 'with'))))""")
def phrases(spark, sf):
    return mn.phrases(base(spark, sf), 3, RULES)


PAIRS = [
    *TOKS,
    "valid AS (SELECT comment_id, keyword FROM mmap WHERE keyword <> 'with')",
    "tot AS (SELECT count(DISTINCT comment_id) AS n FROM valid), kc AS (SELECT keyword, count(*) AS n FROM valid GROUP BY 1)",
    "pc AS (SELECT a.keyword AS k1, b.keyword AS k2, count(*) AS c FROM valid a JOIN valid b ON a.comment_id = b.comment_id AND a.keyword < b.keyword GROUP BY 1, 2 HAVING count(*) >= 3)",
    "sc0 AS (SELECT k1, k2, c, log2((c / t.n) / ((x.n / t.n) * (y.n / t.n))) AS pmi, c * t.n / greatest(x.n * y.n, 1) AS lift FROM pc JOIN kc x ON x.keyword = k1 JOIN kc y ON y.keyword = k2, tot t)",
    f"""pairs AS (SELECT k1 AS keyword_1, k2 AS keyword_2, c AS pair_count, round(pmi, 6) AS pmi, round(lift, 6) AS lift,
      round((greatest(pmi, 0) + 0.2 * ln(1 + greatest(lift, 1))) * ln(1 + c) * (CASE WHEN {_in('k1', RULES.generic)} THEN 0.62 ELSE 1 END) * (CASE WHEN {_in('k2', RULES.generic)} THEN 0.62 ELSE 1 END)
      * CASE WHEN {_in('k1', RULES.generic)} AND {_in('k2', RULES.generic)} THEN 0.55
             WHEN ({_in('k1', P)} AND {_in('k2', I)}) OR ({_in('k1', I)} AND {_in('k2', P)}) THEN 1.35 WHEN ({_in('k1', A)} AND {_in('k2', I)}) OR ({_in('k1', I)} AND {_in('k2', A)}) THEN 1.28
             WHEN ({_in('k1', RULES.causes)} AND {_in('k2', RULES.symptoms)}) OR ({_in('k1', RULES.symptoms)} AND {_in('k2', RULES.causes)}) THEN 1.22
             WHEN {_in('k1', P)} AND {_in('k2', P)} THEN 0.78 WHEN {_in('k1', A)} AND {_in('k2', A)} THEN 0.82 WHEN {_in('k1', I)} AND {_in('k2', I)} THEN 0.95 ELSE 1 END, 6) AS rank_score FROM sc0)""",
]


def _pairs(spark, sf):
    return mn.cooccurrence(materialize(mn.comment_keywords(base(spark, sf), RULES)), 3, RULES)


@query("cooccurrence", with_sql(*PAIRS) + "SELECT keyword_1, keyword_2, pair_count, pmi, lift, CAST(rank_score AS DOUBLE) AS rank_score FROM pairs")
def cooccurrence(spark, sf):
    return _pairs(spark, sf)


@query("seed_pairs", with_sql(*PAIRS) + """
SELECT keyword_1, keyword_2, pair_count FROM pairs WHERE pair_count >= 5 AND rank_score >= (SELECT quantile_cont(rank_score, 0.6) FROM pairs WHERE pair_count >= 5)
  AND NOT (keyword_1 IN ('the', 'de') AND keyword_2 IN ('the', 'de')) """)
def seed_pairs(spark, sf):
    return mn.seed_pairs(_pairs(spark, sf), 0.6, 5, RULES).select("keyword_1", "keyword_2", "pair_count")


@query("pattern_support", with_sql(*TOKS) + """, arr AS (SELECT comment_id, list_distinct(toks) AS t FROM mtok)
SELECT pattern_id, count(*) AS support, round(count(*) * 100.0 / (SELECT count(*) FROM docs), 3) AS coverage FROM arr,
  (VALUES (0, 'of', 'that', ['of', 'that', 'to']), (1, 'de', 'que', ['de', 'que', 'les']), (2, 'it', 'que', ['it', 'que', 'is'])) AS p(pattern_id, a, b, ks)
WHERE list_contains(t, a) AND list_contains(t, b) AND list_has_any(t, list_filter(ks, lambda k: k NOT IN ('it', 'que'))) GROUP BY 1""")
def pattern_support(spark, sf):
    b = base(spark, sf)
    rows = [(0, "of", "that", ["of", "that", "to"]), (1, "de", "que", ["de", "que", "les"]), (2, "it", "que", ["it", "que", "is"])]
    patterns = spark.createDataFrame(rows, "pattern_id int, seed_a string, seed_b string, keyword_set array<string>")
    counts = pt.pattern_support(pt.pattern_bitmaps(patterns, pt.numbered(mn.comment_keywords(b, RULES)), RULES))
    return counts.withColumn("pattern_id", F.col("pattern_id").cast("int")).withColumn("coverage", F.round(F.col("support") * 100.0 / b.agg(F.count("*")).scalar(), 3))


for _by in ("product", "video_id"):

    def _distribution(spark, sf, by=_by):
        return mn.keyword_distribution(base(spark, sf), by, RULES)

    query(f"keyword_distribution_{_by}", with_sql(*TOKS) + f"SELECT {_by}, keyword, count(*) AS count FROM mmap GROUP BY 1, 2")(_distribution)


@query("keyword_trend", with_sql(*TOKS) + """
SELECT keyword, strftime(date_trunc('week', published_at - INTERVAL 1 DAY) + INTERVAL 1 DAY, '%Y-%m-%d') AS time_bucket, count(*) AS count FROM mmap WHERE published_at IS NOT NULL GROUP BY 1, 2""")
def keyword_trend(spark, sf):
    return mn.keyword_trend(base(spark, sf), RULES).withColumn("time_bucket", F.date_format("time_bucket", "yyyy-MM-dd"))


#: The fixture's frequent words occur in most texts, so the upper limit of coverage is left open.
LIMITS = pt.PatternLimits(coverage=(0.02, 100.0), min_pair_count=3)
HUB, ABSTRACT = _in("{}", RULES.hubs), _in("{}", RULES.abstract)
SEEDS = [
    *PAIRS,
    "arr AS (SELECT comment_id, list_distinct(toks) AS t FROM mtok), freq AS (SELECT keyword AS token, count(*) AS f FROM mmap GROUP BY 1)",
    f"""seeds AS (SELECT keyword_1 AS a, keyword_2 AS b, rank_score AS s FROM pairs WHERE rank_score >= (SELECT quantile_cont(rank_score, 0.6) FROM pairs)
      AND NOT ({HUB.format('keyword_1')} AND {HUB.format('keyword_2')}))""",
    "links AS (SELECT keyword_1 AS w, keyword_2 AS token, rank_score AS r FROM pairs WHERE rank_score > 0 UNION ALL SELECT keyword_2, keyword_1, rank_score FROM pairs WHERE rank_score > 0)",
    f"""near AS (SELECT a, b, s, token, coalesce(max(r) FILTER (w = a), 0) AS ra, coalesce(max(r) FILTER (w = b), 0) AS rb FROM seeds JOIN links ON w IN (a, b) WHERE token NOT IN (a, b) GROUP BY 1, 2, 3, 4),
    worth AS (SELECT *, greatest(ra, rb) AS best, round(CAST(greatest(ra, rb) * CASE WHEN ra > 0 AND rb > 0 THEN 1.12 ELSE 1 END * CASE WHEN {HUB.format('token')} THEN 0.58 ELSE 1 END * (1 + least(coalesce(f, 0) / 3000.0, 0.35)) AS DOUBLE), 9) AS v
      FROM near LEFT JOIN freq USING (token) WHERE NOT {HUB.format('token')} OR {HUB.format('a')} OR {HUB.format('b')}),
    levels AS (SELECT unnest([0, 1, 2, 3]) AS level, unnest(cuts) AS cut FROM (SELECT quantile_cont(rank_score, [0.88, 0.80, 0.72, 0.64]) AS cuts FROM pairs)),
    grown AS (SELECT a, b, level, list(token ORDER BY v DESC, token)[:3] AS g FROM worth, levels WHERE best >= cut AND v >= round(CAST(s * 0.42 AS DOUBLE), 9) GROUP BY 1, 2, 3),
    sets AS (SELECT DISTINCT a, b, s, [a, b] || coalesce(g, []) AS ks FROM seeds CROSS JOIN levels LEFT JOIN grown USING (a, b, level))""",
]
CANDIDATES = [
    *SEEDS,
    f"""hits AS (SELECT a, b, ks, comment_id, len(list_intersect(t, ks)) AS overlap FROM sets JOIN arr ON list_contains(t, a) AND list_contains(t, b)
      AND (len(list_filter(ks, lambda k: NOT {ABSTRACT.format('k')})) = 0 OR list_has_any(t, list_filter(ks, lambda k: NOT {ABSTRACT.format('k')})))),
    sup AS (SELECT a, b, ks, count(*) AS n FROM hits GROUP BY 1, 2, 3),
    cand0 AS (SELECT *, n * 100.0 / (SELECT count(*) FROM docs) AS cover FROM sets JOIN sup USING (a, b, ks)),
    cand1 AS (SELECT a, b, ks, n, CAST(round(cover, 3) AS DOUBLE) AS coverage, round(s, 6) AS strength, row_number() OVER (ORDER BY round(cover, 3) DESC, round(s, 6) DESC, a, b, ks) AS i FROM cand0 WHERE n >= 6 AND cover BETWEEN 0.02 AND 100),
    kw1 AS (SELECT i, unnest(ks) AS token FROM cand1),
    nm AS (SELECT i, list(token ORDER BY {HUB.format('token')}, -coalesce(f, 0), token) AS r FROM kw1 LEFT JOIN freq USING (token) GROUP BY 1),
    cand AS (SELECT c.*, array_to_string(r[:3], ' / ') AS label, r[1] AS anchor, list_sort(list_filter(ks, lambda k: NOT {HUB.format('k')})) AS plain FROM cand1 c JOIN nm USING (i)),
    ch AS (SELECT i, comment_id, overlap FROM hits JOIN cand1 USING (a, b, ks)),
    share AS (SELECT x.i AS i, y.i AS j, count(*) AS n FROM ch x JOIN ch y ON x.comment_id = y.comment_id AND x.i < y.i GROUP BY 1, 2),
    rival AS (SELECT x.i AS i, y.i AS j, (len(list_intersect(x.ks, y.ks)) >= 0.4 * len(list_distinct(x.ks || y.ks))) OR coalesce(h.n, 0) >= 0.45 * (x.n + y.n - coalesce(h.n, 0))
        OR (len(x.plain) > 0 AND x.plain[:2] = y.plain[:2]) OR (len(x.plain) > 0 AND x.plain[:3] = y.plain[:3]) OR x.label = y.label AS clash, x.anchor = y.anchor AS anchored
      FROM cand x JOIN cand y ON x.i < y.i LEFT JOIN share h ON h.i = x.i AND h.j = y.i),
    clash AS (SELECT i, j FROM rival WHERE clash), wide AS (SELECT i, j FROM rival WHERE clash OR anchored)""",
]
CHOICE = [
    *CANDIDATES,
    """before AS (SELECT c.i, list(w.i) FILTER (w.i IS NOT NULL) AS foes FROM cand c LEFT JOIN wide w ON w.j = c.i GROUP BY 1),
    pick AS (SELECT 0 AS i, CAST([] AS BIGINT[]) AS got UNION ALL SELECT b.i, CASE WHEN list_has_any(got, coalesce(foes, [])) THEN got ELSE list_append(got, b.i) END FROM pick p JOIN before b ON b.i = p.i + 1),
    apart AS (SELECT unnest(got) AS i FROM pick WHERE i = (SELECT max(i) FROM pick)),
    others AS (SELECT i FROM cand WHERE i NOT IN (SELECT i FROM apart) AND i NOT IN (SELECT j FROM clash WHERE i IN (SELECT i FROM apart)) AND i NOT IN (SELECT i FROM clash WHERE j IN (SELECT i FROM apart))),
    o2 AS (SELECT i, row_number() OVER (ORDER BY i) AS k FROM others),
    before2 AS (SELECT o.k, o.i, list(c.i) FILTER (c.i IS NOT NULL) AS foes FROM o2 o LEFT JOIN clash c ON c.j = o.i GROUP BY 1, 2),
    pick2 AS (SELECT CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS got UNION ALL SELECT b.k, CASE WHEN list_has_any(got, coalesce(foes, [])) THEN got ELSE list_append(got, b.i) END FROM pick2 p JOIN before2 b ON b.k = p.k + 1),
    fill AS (SELECT unnest(got) AS i FROM pick2 WHERE k = (SELECT max(k) FROM pick2)),
    best AS (SELECT i, turn FROM (SELECT i, 0 AS turn FROM apart UNION ALL SELECT i, 1 FROM fill) ORDER BY turn, i LIMIT 10),
    sample AS (SELECT i, list(comment_id ORDER BY overlap DESC, comment_id)[:3] AS ids FROM ch GROUP BY 1),
    top AS (SELECT i, label, coverage, ks, ids FROM best JOIN cand USING (i) JOIN sample USING (i))""",
]


def with_recursive(*ctes: str) -> str:
    return with_sql(*ctes).replace("WITH ", "WITH RECURSIVE ", 1)


@query("expanded_seeds", with_sql(*SEEDS) + "SELECT a AS seed_a, b AS seed_b, array_to_string(ks, ',') AS keywords FROM sets")
def expanded_seeds(spark, sf):
    arrays = materialize(mn.comment_keywords(base(spark, sf), RULES))
    out = pt.expanded_seeds(materialize(mn.cooccurrence(arrays, 3, RULES)), arrays, LIMITS, RULES)
    return out.select("seed_a", "seed_b", F.array_join("keyword_set", ",").alias("keywords"))


@query("pattern_overlaps", with_sql(*CANDIDATES) + """
SELECT x.label AS first, array_to_string(x.ks, ',') AS first_set, y.label AS second, array_to_string(y.ks, ',') AS second_set FROM clash c JOIN cand x ON x.i = c.i JOIN cand y ON y.i = c.j""")
def pattern_overlaps(spark, sf):
    b = base(spark, sf)
    arrays = pt.numbered(mn.comment_keywords(b, RULES))
    rows, held = pt.candidates(materialize(mn.cooccurrence(arrays, 3, RULES)), arrays, F.lit(b.count()), LIMITS, RULES)
    name = lambda n, label: rows.select(F.col("pattern_id").alias(n), F.col("pattern_label").alias(label), F.array_join("keyword_set", ",").alias(f"{label}_set"))
    return pt.pattern_overlaps(rows, held, LIMITS).join(name("a", "first"), "a").join(name("b", "second"), "b").drop("a", "b")


@query("top_patterns", with_recursive(*CHOICE) + "SELECT label AS pattern_label, coverage, array_to_string(ks, ',') AS keywords, array_to_string(ids, ',') AS samples FROM top")
def top_patterns(spark, sf):
    out = pt.top_patterns(base(spark, sf), 10, LIMITS, RULES)
    return out.select("pattern_label", "coverage", F.array_join("keyword_set", ",").alias("keywords"), F.array_join("representative_comment_ids", ",").alias("samples"))


GATE = [
    *CHOICE,
    f"""sm AS (SELECT i, list(comment_id ORDER BY p) FILTER (len(list_intersect(t, ks)) >= 2) AS ids FROM (SELECT i, ks, unnest(ids) AS comment_id, unnest(range(1, len(ids) + 1)) AS p FROM top) JOIN arr USING (comment_id) GROUP BY 1),
    g0 AS (SELECT t.i, label, coverage, ks, s.ids, list_filter(ks, lambda k: NOT {ABSTRACT.format('k')}) AS concrete, list_filter(ks, lambda k: NOT {ABSTRACT.format('k')} AND NOT {HUB.format('k')}) AS core FROM top t JOIN sm s USING (i)),
    g1 AS (SELECT *, row_number() OVER (ORDER BY coverage DESC, label, ks) AS k FROM g0 WHERE coverage >= 0.5 AND NOT (len(concrete) < len(ks) AND len(concrete) < 2) AND len(ids) > 0),
    lk AS (SELECT x.k AS k, y.k AS j, greatest(len(list_intersect(x.ks, y.ks)) / len(list_distinct(x.ks || y.ks)),
        CASE WHEN len(list_distinct(x.core || y.core)) = 0 THEN 1 ELSE len(list_intersect(x.core, y.core)) / len(list_distinct(x.core || y.core)) END) AS l FROM g1 x JOIN g1 y ON x.k < y.k),
    b3 AS (SELECT g.k, list(l.k) FILTER (l.l >= 0.4) AS foes FROM g1 g LEFT JOIN lk l ON l.j = g.k GROUP BY 1),
    p3 AS (SELECT CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS got UNION ALL SELECT b.k, CASE WHEN list_has_any(got, coalesce(foes, [])) THEN got ELSE list_append(got, b.k) END FROM p3 p JOIN b3 b ON b.k = p.k + 1),
    g2 AS (SELECT g.*, list_filter(list_transform(string_split(label, '/'), lambda x: lower(trim(x))) || ks, lambda x: x <> '' AND NOT {ABSTRACT.format('x')})[1] AS anchor FROM g1 g WHERE list_contains((SELECT got FROM p3 ORDER BY k DESC LIMIT 1), g.k)),
    o4 AS (SELECT *, row_number() OVER (ORDER BY k) AS q FROM g2),
    f4 AS (SELECT y.q, list(x.q) FILTER (x.q IS NOT NULL) AS foes FROM o4 y LEFT JOIN o4 x ON x.q < y.q AND (x.anchor = y.anchor OR (SELECT max(l) FROM lk WHERE lk.k = x.k AND lk.j = y.k) >= 0.35) GROUP BY 1),
    p4 AS (SELECT CAST(0 AS BIGINT) AS q, CAST([] AS BIGINT[]) AS got UNION ALL SELECT f.q, CASE WHEN list_has_any(got, coalesce(foes, [])) THEN got ELSE list_append(got, f.q) END FROM p4 p JOIN f4 f ON f.q = p.q + 1)""",
]


@query("pattern_gate", with_recursive(*GATE) + """
SELECT label AS pattern_label, coverage, array_to_string(ids, ',') AS samples FROM o4 WHERE list_contains((SELECT got FROM p4 ORDER BY q DESC LIMIT 1), q) ORDER BY q LIMIT 5""")
def pattern_gate(spark, sf):
    b = base(spark, sf)
    out = pt.pattern_gate(b, materialize(pt.top_patterns(b, 10, LIMITS, RULES)), 5, LIMITS, RULES)["final_top_patterns"]
    return out.select("pattern_label", "coverage", F.array_join("representative_comment_ids", ",").alias("samples"))


FOCUS = "array_to_string(ks[1:2], ', ')"
CLEAN = "regexp_replace(text, '(?i)https?://\\S+|\\bwww\\.\\S+', ' ', 'g')"
CARDS = [
    *CHOICE,
    f"""lines AS (SELECT i, p, trim(regexp_replace({CLEAN}, '[\\s\\x0B]+', ' ', 'g')) AS t FROM (SELECT i, unnest(ids) AS comment_id, unnest(range(1, len(ids) + 1)) AS p FROM top) JOIN docs USING (comment_id)),
    firsts AS (SELECT *, regexp_extract(t, '^(.*?[.!?。！？])\\s', 1) AS f FROM lines),
    cuts AS (SELECT i, p, CASE WHEN length(f) + 1 >= 80 THEN f ELSE t END AS t FROM firsts),
    snips AS (SELECT i, string_agg(CASE WHEN length(t) <= 170 THEN t ELSE rtrim(left(t, 170)) || '...' END, ' | ' ORDER BY p) AS snippets FROM cuts WHERE t <> '' GROUP BY 1)""",
]


@query("pattern_cards", with_recursive(*CARDS) + f"""
SELECT label AS pattern_label, CASE WHEN list_has_all(ks, ['service', 'repair']) THEN 'A/S·수리 대응 신뢰 이슈' ELSE '반복 이슈: ' || array_to_string(ks[1:3], ' · ') END AS display_label,
  '`' || label || '` 축 반응이 현재 범위에서 반복 관찰됩니다 (커버리지 ' || printf('%.3f', coverage) || '%). 핵심 단서 키워드는 `' || {FOCUS} || '`이며, 운영/제품 판단 시 우선 확인할 신호로 볼 수 있습니다.' AS insight,
  '반복 키워드가 가리키는 원인 구간을 좁혀, 즉시 실행 가능한 개선 항목부터 우선 검토하세요.' AS action, snippets FROM top LEFT JOIN snips USING (i)""")
def pattern_cards(spark, sf):
    b = base(spark, sf)
    out = pt.pattern_cards(materialize(pt.top_patterns(b, 10, LIMITS, RULES)), b)
    return out.select("pattern_label", "display_label", "insight", "action", F.array_join("representative_comment_snippets", " | ").alias("snippets"))


@query("tfidf_kmeans")
def tfidf_kmeans(spark, sf):
    c = comments(spark, sf).select("comment_id", "text")
    return mn.assign_clusters(c, 6, "text").groupBy("cluster_id").agg(F.count("*").alias("comments"))
