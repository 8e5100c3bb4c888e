"""Text, personal data, parsing, hashing and date expressions over whole texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxframe.functions import parsing, scores
from voxframe.functions import text as tx
from voxframe.session import spread
from workloads.bindings import EV, comments, labelled_events, table, with_sql
from workloads.registry import query

SPACE = r"regexp_replace({}, '\s+', ' ', 'g')"


def _docs(spark, sf):
    return spread(table(spark, sf, "documents").select("doc_id", "text"))


@query("clean_text_simple", r"""
SELECT doc_id, trim(regexp_replace(regexp_replace(translate(text, chr(10) || chr(13), '  '), '(?i)https?://\S+|www\.\S+', ' ', 'g'), '\s+', ' ', 'g')) AS cleaned
FROM documents""")
def clean_text_simple(spark, sf):
    return _docs(spark, sf).select("doc_id", tx.clean_text(F.col("text"), normalize_repeats=False, unescape=False).alias("cleaned"))


@query("clean_text_full")
def clean_text_full(spark, sf):
    cleaned = tx.clean_text(F.col("text"))
    return _docs(spark, sf).select("doc_id", cleaned.alias("cleaned"), F.length(cleaned).alias("text_length"))


@query("quality_class")
def quality_class(spark, sf):
    d = _docs(spark, sf).withColumns({"raw": tx.html_unescape(F.col("text")), "cleaned": tx.clean_text(F.col("text"))})
    return d.select("doc_id", tx.quality_class(F.col("raw"), F.col("cleaned")).alias("comment_quality"))


@query("unescaped_pages", r"""
SELECT page_id, length(replace(replace(replace(replace(replace(html, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&')) AS n
FROM pages WHERE NOT regexp_matches(replace(html, '&amp;', ''), '&(#|[A-Za-z])') """)
def unescaped_pages(spark, sf):
    """Pages whose only entities are ampersands, decoded."""
    p = table(spark, sf, "pages").where(~F.replace("html", F.lit("&amp;"), F.lit("")).rlike("&(#|[A-Za-z])"))
    return p.select("page_id", F.length(tx.html_unescape(F.col("html"))).alias("n"))


@query("language_hint", """
SELECT doc_id, CASE WHEN regexp_matches(text, '[가-힣]') THEN 'ko' WHEN regexp_matches(text, '[A-Za-z]') THEN 'en' ELSE 'unknown' END AS hint,
       CASE WHEN lang <> '' THEN lang WHEN regexp_matches(text, '[가-힣]') THEN 'ko' ELSE 'unknown' END AS language,
       length(regexp_replace(text, '[^가-힣]', '', 'g')) > greatest(3, length(regexp_replace(text, '[^A-Za-z]', '', 'g'))) AS korean
FROM documents""")
def language_hint(spark, sf):
    d = spread(table(spark, sf, "documents"))
    t = F.col("text")
    return d.select("doc_id", tx.language_hint(t).alias("hint"), tx.infer_language(t, F.col("lang")).alias("language"), tx.looks_korean(t).alias("korean"))


@query("link_extract", r"""
SELECT DISTINCT page_id, unnest(regexp_extract_all(url || ' ' || html, '(?i)https?://[^\s)\]]+')) AS link FROM pages""")
def link_extract(spark, sf):
    p = table(spark, sf, "pages")
    return p.select("page_id", F.explode(tx.external_links(F.concat_ws(" ", "url", "html"))).alias("link"))


PII = r"""src AS (SELECT doc_id, trim(text, E' \n\t\r') AS v FROM documents),
found AS (SELECT doc_id, v,
  list_filter(regexp_extract_all(v, '\b(?:\+?\d{1,3}[\s-]?)?(?:\d{2,4}[\s-]?){2,4}\d{3,4}\b'), lambda t: length(regexp_replace(t, '\D', '', 'g')) >= 9) AS phones,
  regexp_extract_all(v, '(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b') AS emails, regexp_extract_all(v, '@[A-Za-z0-9_\.]{3,}') AS accounts FROM src),
joined AS (SELECT *, phones || emails || accounts AS everything FROM found),
uniq AS (SELECT *, list_filter(everything, lambda x, i: list_position(everything, x) = i) AS vals FROM joined),
pii AS (SELECT *, array_to_string(vals, ', ') AS raw,
  list_filter(list_transform(string_split(array_to_string(vals, ', '), ','), lambda t: trim(t)), lambda t: t <> '') AS toks FROM uniq)"""


@query("pii_flags", with_sql(PII) + """
SELECT doc_id, CASE WHEN len(vals) > 0 THEN 'Y' ELSE 'N' END AS flag, raw AS "values",
       concat_ws(', ', CASE WHEN len(phones) > 0 THEN 'phone' END, CASE WHEN len(emails) > 0 THEN 'email' END,
                 CASE WHEN len(accounts) > 0 THEN 'account_id' END) AS types FROM pii""")
def pii_flags(spark, sf):
    return _docs(spark, sf).select("doc_id", tx.detect_pii(F.col("text")).alias("p")).select("doc_id", "p.*")


@query("mask_pii", with_sql(PII) + r"""
SELECT doc_id, list_reduce(list_prepend(v, toks), lambda acc, t: replace(acc, t,
  CASE WHEN contains(t, '@') AND contains(t, '.') THEN left(split_part(t, '@', 1), 1) || '***@' || regexp_replace(t, '^[^@]*@', '')
       WHEN length(regexp_replace(t, '\D', '', 'g')) >= 9 THEN
         CASE WHEN contains(t, '-') AND len(string_split(t, '-')) >= 3 THEN string_split(t, '-')[1] || '-****-' || string_split(t, '-')[-1]
              ELSE left(regexp_replace(t, '\D', '', 'g'), 3) || '****' || right(regexp_replace(t, '\D', '', 'g'), 4) END
       WHEN length(t) >= 3 THEN left(t, 1) || repeat('*', greatest(1, length(t) - 2)) || right(t, 1) ELSE '[PII]' END)) AS masked,
  list_reduce(list_prepend(v, list_filter(toks, lambda t: length(t) >= 2)), lambda acc, t: replace(acc, t, '[PII]')) AS redacted
FROM pii""")
def mask_pii(spark, sf):
    d = _docs(spark, sf).withColumn("p", tx.detect_pii(F.col("text")))
    values = F.col("p.values")
    return d.select("doc_id", tx.mask_pii(F.col("text"), values).alias("masked"), tx.redact_pii(F.col("text"), values).alias("redacted"))


@query("text_shapes", r"""
SELECT doc_id, trim(regexp_replace(regexp_replace(text, '(?i)https?://\S+|\bwww\.\S+', ' ', 'g'), '\s+', ' ', 'g')) AS normalized,
       left(trim(regexp_replace(regexp_replace(lower(text), '[^\p{L}\p{M}\p{N}\p{Pc}\s]', ' ', 'g'), '\s+', ' ', 'g')), 120) AS text_key,
       contains(text, '??') AS garbled, length(trim(text, E' \n\t\r')) > 260 AS long_text,
       CASE WHEN length(trim(text, E' \n\t\r')) <= 220 THEN trim(text, E' \n\t\r')
            ELSE rtrim(left(trim(regexp_replace(text, '\s+', ' ', 'g')), 217)) || '...' END AS preview
FROM documents""")
def text_shapes(spark, sf):
    t = F.col("text")
    return _docs(spark, sf).select(
        "doc_id", tx.normalize_text(t).alias("normalized"), tx.dedupe_key(t, 120).alias("text_key"), tx.looks_garbled(t).alias("garbled"),
        tx.is_long_text(t).alias("long_text"), tx.preview(t).alias("preview"),
    )


@query("evidence_span", """
SELECT doc_id, CASE WHEN contains(lower(text), 'theron') THEN substr(text, instr(lower(text), 'theron'), 6)
                    WHEN contains(lower(text), 'that the') THEN substr(text, instr(lower(text), 'that the'), 8)
                    WHEN contains(lower(text), 'de la') THEN substr(text, instr(lower(text), 'de la'), 5) ELSE '' END AS span
FROM (SELECT doc_id, trim(text, E' \\n\\t\\r') AS text FROM documents)""")
def evidence_span(spark, sf):
    return _docs(spark, sf).select("doc_id", tx.evidence_span(F.col("text"), ["theron", "that the", "de la"]).alias("span"))


@query("time_links", r"""
SELECT event_id, s AS seconds, CASE WHEN s >= 3600 THEN printf('%02d:%02d:%02d', s // 3600, s % 3600 // 60, s % 60)
       ELSE printf('%02d:%02d', s // 60, s % 60) END AS label,
       'https://example.com/watch?v=' || CAST(user_id AS VARCHAR) || '&t=' || CAST(s AS VARCHAR) || 's' AS link
FROM (SELECT event_id, user_id, CASE WHEN event_type = 'view' THEN hour(ts) * 3600 + minute(ts) * 60 + second(ts) ELSE minute(ts) * 60 + second(ts) END AS s FROM events)""")
def time_links(spark, sf):
    shown = F.when(F.col("event_type") == "view", F.date_format("ts", "HH:mm:ss")).otherwise(F.date_format("ts", "mm:ss"))
    e = table(spark, sf, "events").withColumn("seconds", tx.timestamp_seconds(F.concat(F.lit("see "), shown, F.lit(" there"))))
    url = F.concat(F.lit("https://example.com/watch?v="), F.col("user_id").cast("string"))
    return e.select("event_id", "seconds", tx.timestamp_label(F.col("seconds")).alias("label"), tx.link_at_time(url, F.col("seconds")).alias("link"))


@query("text_chunks")
def text_chunks(spark, sf):
    return _docs(spark, sf).select("doc_id", F.posexplode(tx.chunk_text(F.col("text"))).alias("position", "chunk"))


@query("parsed_lists", r"""
SELECT doc_id, part, count(*) AS n FROM (
  SELECT doc_id, unnest(string_split_regex(trim(text, E' \n\t\r'), '[\s,|;/]+')) AS part FROM documents) WHERE part <> '' GROUP BY 1, 2""")
def parsed_lists(spark, sf):
    parts = _docs(spark, sf).select("doc_id", F.explode(parsing.parse_list(F.col("text"))).alias("part"))
    return parts.groupBy("doc_id", "part").agg(F.count("*").alias("n"))


@query("parsed_json_lists", """
SELECT event_id, 'a' || event_type AS first, 'k' || json_extract_string(props, '$.k') AS second, 2 AS n FROM events""")
def parsed_json_lists(spark, sf):
    """Strict JSON for views, Python-style quotes for the rest."""
    e = table(spark, sf, "events")
    mark = F.when(F.col("event_type") == "view", '"').otherwise("'")
    raw = F.concat(F.lit("["), mark, F.lit("a"), "event_type", mark, F.lit(", "), mark, F.lit("k"), F.get_json_object("props", "$.k"), mark, F.lit("]"))
    items = parsing.parse_loose_list(raw)
    return e.select("event_id", items[0].alias("first"), items[1].alias("second"), F.size(items).alias("n"))


@query("parsed_maps", """
SELECT event_id, json_extract_string(props, '$.k') AS text_value, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS number_value FROM events""")
def parsed_maps(spark, sf):
    e = table(spark, sf, "events")
    return e.select("event_id", parsing.parse_string_map(F.col("props"))["k"].alias("text_value"), parsing.parse_number_map(F.col("props"))["k"].alias("number_value"))


@query("coerced_flags", """
SELECT doc_id, coalesce(toxic = 1, true) AS toxic, coalesce(quality = 1, false) AS quality, coalesce(toxic = 1, false) AS truthy
FROM documents LEFT JOIN labels USING (doc_id)""")
def coerced_flags(spark, sf):
    c = comments(spark, sf)
    word = F.when(F.col("quality") == 1, " Yes ").when(F.col("quality") == 0, "n")
    return c.select(
        "doc_id", parsing.coerce_bool(F.col("toxic"), True).alias("toxic"), parsing.coerce_bool(word).alias("quality"),
        parsing.is_truthy(F.col("toxic")).alias("truthy"),
    )


@query("axis_lists", """
SELECT event_id, CASE event_type WHEN 'view' THEN 'brand_trust' WHEN 'click' THEN 'price_value_fit' ELSE 'usage_pattern_fit' END AS axis, 1 AS n FROM events""")
def axis_lists(spark, sf):
    """Valid names, names glued together, and names that are not axes."""
    from voxframe.rules.truth import JUDGMENT_AXES

    e = table(spark, sf, "events")
    raw = F.when(F.col("event_type") == "view", F.array(F.lit("Brand_Trust"), F.lit("nothing"))).when(
        F.col("event_type") == "click", F.array(F.lit("xxprice_value_fitxx"))
    ).otherwise(F.array(F.lit("other")))
    axes = parsing.normalize_axes(raw, JUDGMENT_AXES)
    return e.select("event_id", axes[0].alias("axis"), F.size(axes).alias("n"))


@query("week_buckets", """
SELECT event_id, strftime(date_trunc('week', ts), '%Y-%m-%d') AS monday_week,
       strftime(date_trunc('week', ts - INTERVAL 1 DAY) + INTERVAL 1 DAY, '%Y-%m-%d') AS tuesday_week FROM events""")
def week_buckets(spark, sf):
    ts = scores.parse_time(F.col("ts"))
    return table(spark, sf, "events").select(
        "event_id", scores.week_start(ts).alias("monday_week"), F.date_format(scores.tuesday_week(ts), "yyyy-MM-dd").alias("tuesday_week")
    )


@query("stable_hashes", """
SELECT doc_id, 't_' || left(sha1(text), 12) AS id, CAST(('0x' || left(sha1(text), 4)) AS INTEGER) % 3 AS variant FROM documents""")
def stable_hashes(spark, sf):
    return _docs(spark, sf).select("doc_id", scores.short_id(F.col("text")).alias("id"), scores.hash_pick(F.col("text"), 3).alias("variant"))


@query("bounded_scores", with_sql(EV) + """
SELECT comment_id, round(least(10, greatest(0, log10(1 + greatest(like_count, 0)) * 4)), 6) AS likes, round(greatest(1.0, least(5.0, value)), 6) AS bounded,
       round(coalesce(like_count / nullif(reply_count, 0), 0), 4) AS ratio FROM ev""")
def bounded_scores(spark, sf):
    e = labelled_events(spark, sf)
    return e.select(
        "comment_id", F.round(scores.log_likes(F.col("like_count")), 6).alias("likes"), F.round(scores.clamp(F.col("value"), 1, 5), 6).alias("bounded"),
        scores.ratio(F.col("like_count"), F.col("reply_count"), 4).alias("ratio"),
    )
