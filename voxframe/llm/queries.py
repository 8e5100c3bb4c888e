"""Queries of the language-data operators over the driver tables, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxframe.llm import byte_bpe, context_tree, conversation_repair, embedding_dedup, language_id, line_quality, mixing, secret_scan, simhash_dedup, topk_search, toxicity, url_rules, whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


@query("op6_toxicity")
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op9_language_id")
def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


@query(
    "op1_embedding_dedup",
    """
    WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
    good AS (SELECT * FROM v WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
    links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.98),
    reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
    SELECT v.vec_id, (SELECT count(*) FROM links WHERE a = v.vec_id) AS n_links, (SELECT min(b) FROM reach WHERE a = v.vec_id) AS component_id,
           v.vec_id = (SELECT min(b) FROM reach WHERE a = v.vec_id) AS kept FROM v
    """,
)
def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.grouped(table(spark, sf_dir, "embeddings"))


@query("op4_simhash_dedup")
def op4_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.grouped(table(spark, sf_dir, "documents"))


# The rules of the URL query, in the order given.
URL_RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)


@query(
    "op2_url_rules",
    f"""
    WITH rules(host, path, verdict) AS (VALUES {", ".join(str(r) for r in URL_RULES)}),
    cut AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
    parts AS (SELECT page_id,
        translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
    fits AS (SELECT p.page_id, r.host || r.path AS rule, r.verdict,
        row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.host || r.path) DESC, length(r.host) DESC) AS rank
        FROM parts p JOIN rules r ON (p.host = r.host OR suffix(p.host, '.' || r.host)) AND starts_with(p.path, r.path))
    SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.verdict, 'allow') AS verdict
    FROM parts p LEFT JOIN fits f ON f.page_id = p.page_id AND f.rank = 1
    """,
)
def op2_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(list(URL_RULES), "host string, path string, verdict string")
    return url_rules.judged(table(spark, sf_dir, "pages"), rules)


@query("op5_secret_scan")
def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scanned(table(spark, sf_dir, "documents"))


@query("op7_mixing")
def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents"))


@query(
    "op10_line_quality",
    r"""
    WITH d AS (SELECT row_number() OVER () AS row, doc_id, source AS host, coalesce(text, '') AS text FROM documents),
    w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
    win AS (SELECT row, i, array_to_string(words[i:i + 4], ' ') AS g FROM (SELECT row, words, unnest(range(1, len(words) - 3)) AS i FROM w WHERE len(words) >= 5)),
    again AS (SELECT row, i FROM win QUALIFY count(*) OVER (PARTITION BY row, g) > 1),
    covered AS (SELECT row, count(DISTINCT p) AS n FROM (SELECT row, unnest(range(i, i + 5)) AS p FROM again) GROUP BY 1),
    each AS (SELECT row, host, lower(trim(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g'))) AS norm, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n FROM (SELECT row, host, unnest(lines) AS line FROM w)),
    over AS (SELECT host, norm FROM each GROUP BY 1, 2 HAVING count(DISTINCT row) > 50),
    gone AS (SELECT e.row, sum(e.n) AS n FROM each e JOIN over o ON e.host IS NOT DISTINCT FROM o.host AND e.norm = o.norm GROUP BY 1),
    f AS (SELECT doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
      len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words, CAST(coalesce(g.n, 0) AS BIGINT) AS removed_words FROM w LEFT JOIN covered c USING (row) LEFT JOIN gone g USING (row)),
    b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM f)
    SELECT *, NOT base_failed AND n_words - removed_words >= 10 AND n_words - removed_words >= 0.5 * n_words AS kept FROM b
    """,
)
def op10_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_quality.judged(table(spark, sf_dir, "documents"))


@query("op8_byte_bpe")
def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.encoded(table(spark, sf_dir, "documents"), vocabulary=public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern=public_tokenizers.PATTERN)


@query("op3_context_tree")
def op3_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_tree.scored(table(spark, sf_dir, "documents"))


@query(
    "op11_topk_search",
    """
    WITH v AS (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding::DOUBLE[], lambda c: floor(1024 * c)) AS x FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
    s AS (SELECT q.row, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.x, c.x) AS BIGINT) AS score FROM v q JOIN v c ON q.row <> c.row AND len(q.x) = len(c.x) WHERE q.vec_id % 100 = 0),
    r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
    SELECT * FROM r WHERE rank <= 10
    """,
)
def op11_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


@query("op12_embedding_whitening")
def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


def _repair_sql() -> str:
    """A forward walk that keeps the best (cost, audit, text) of each state; crc32 from its table of 256 entries."""
    edit = lambda x, cost, letter, line: f"{{'c': {x}.c + {cost}, 'a': {x}.a || '{letter}', 't': {x}.t || {line}}}"
    best = lambda *options: f"least({', '.join(options)})"
    insert = lambda x, role: edit(x, 5, "I", f"chr(10) || '{role}:'")
    gone = lambda x: edit(x, 2, "D", "''")
    far = "{'c': 1000000000000, 'a': '', 't': ''}"

    def stay(x: str, role: str) -> str:
        kept, moved = edit(x, "r.x", "K", "chr(10) || r.role || ':' || r.text"), edit(x, "r.x + 1", "R", f"chr(10) || '{role}:' || r.text")
        return f"CASE WHEN r.first = '{role[0]}' THEN {kept} ELSE {moved} END"

    system = edit("w.z", "r.x", "K", "chr(10) || r.role || ':' || r.text")
    return rf"""
    WITH RECURSIVE tab AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)) AS tab),
    d AS (SELECT conv_id AS conv, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
        xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda c: ascii(c)::BIGINT)),
            lambda a, b: xor(tab[1 + (xor(a, b) & 255)], a >> 8)), 4294967295) % 20 AS k FROM conversations, tab),
    m AS (SELECT conv, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
        unnest(range(CASE WHEN k = 3 THEN 2 ELSE 1 END)) AS copy FROM d WHERE k <> 0),
    o AS (SELECT conv, turn, role, text, row_number() OVER p AS i, lag(left(role, 1)) OVER p AS prior, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS cut
        FROM m WINDOW p AS (PARTITION BY conv ORDER BY turn NULLS FIRST, role, sha256(text))),
    r AS (SELECT *, left(role, 1) AS first, cut = '' AS blank, cut <> '' AND row_number() OVER (PARTITION BY conv, role, text ORDER BY i) > 1 AS duplicate,
        CASE WHEN right(cut, 1) IN ('.', '!', '?') THEN 0 ELSE 5 END AS x FROM o),
    s AS (SELECT conv, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) AS n, count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate,
        count(*) FILTER (NOT blank AND NOT duplicate AND x > 0) AS truncated, count(*) FILTER (i > 1 AND prior || first NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY conv),
    walk AS (SELECT conv, 0::BIGINT AS i, {{'c': 0::BIGINT, 'a': '', 't': ''}} AS z, {far} AS s, {far} AS u, {far} AS a FROM s
        UNION ALL SELECT w.conv, r.i, {gone("w.z")},
            CASE WHEN r.blank OR r.duplicate OR r.first <> 's' THEN {gone("w.s")} ELSE {best(gone("w.s"), system)} END,
            CASE WHEN r.blank OR r.duplicate THEN {gone("w.u")} ELSE {best(gone("w.u"), stay("w.z", "user"), stay("w.s", "user"), stay("w.a", "user"))} END,
            CASE WHEN r.blank OR r.duplicate THEN {gone("w.a")} ELSE {best(gone("w.a"), stay("w.u", "assistant"))} END
        FROM (SELECT conv, i, z, s, u, {best("a", insert("u", "assistant"))} AS a FROM (SELECT conv, i, z, s, a, {best("u", insert("z", "user"), insert("s", "user"), insert("a", "user"))} AS u FROM walk)) w
        JOIN r ON r.conv IS NOT DISTINCT FROM w.conv AND r.i = w.i + 1),
    e AS (SELECT w.conv, {best("w.z", "w.a", insert("w.u", "assistant"), "{'c': w.s.c + 10, 'a': w.s.a || 'II', 't': w.s.t || chr(10) || 'user:' || chr(10) || 'assistant:'}")} AS e
        FROM walk w JOIN s ON s.conv IS NOT DISTINCT FROM w.conv AND s.n = w.i)
    SELECT c.conv_id, coalesce(s.gaps, 0) AS gaps, coalesce(s.blank, 0) AS blank, coalesce(s.duplicate, 0) AS duplicate, coalesce(s.truncated, 0) AS truncated, coalesce(s.illegal, 0) AS illegal,
        coalesce(e.e.c, 0) AS cost, coalesce(e.e.a, '') AS audit, sha256(coalesce(substr(e.e.t, 2), '')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN s ON s.conv IS NOT DISTINCT FROM c.conv_id LEFT JOIN e ON e.conv IS NOT DISTINCT FROM c.conv_id
    """


@query("op13_conversation_repair", _repair_sql())
def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    rows = conversation_repair.damaged(conversations)
    return conversation_repair.repaired(rows, conversations.select(F.col("conv_id").alias("conv"))).withColumnRenamed("conv", "conv_id")
