"""Comments similar to given representatives, and the clusters they form."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxframe.functions.keywords import DEFAULT, KeywordRules, point_tokens
from voxframe.functions.text import safe_text
from voxframe.operators.relational import BROADCAST_BYTES, ListRule, attach, is_small, top_lists
from voxframe.rules import display
from voxframe.schemas import pick

# Words dropped from points, and their aliases.
POINT_NOISE = (
    "해당", "관련", "제품", "가전", "이슈", "문제", "정도", "부분", "그냥", "진짜", "너무", "있다", "없다", "이게", "그게", "저게",
    "이번", "한번", "저번",
)
POINT_ALIASES = {
    "통돌": "통돌이", "통돌이는": "통돌이", "통돌이로": "통돌이", "통돌이랑": "통돌이", "a/s": "A/S", "as": "A/S", "티비": "TV", "tv": "TV",
}
DEFAULT_TOPIC = "제품 경험"


def source_pool(df: DataFrame) -> DataFrame:
    """Included, valid comments that are not trash."""
    included = F.coalesce(pick(df, ["analysis_included"], F.lit(True)), F.lit(False))
    hygiene = F.lower(F.coalesce(pick(df, ["hygiene_class"], F.lit("strategic")), F.lit("")))
    valid = F.lower(F.coalesce(pick(df, ["comment_validity"], F.lit("valid")), F.lit(""))) == "valid"
    return df.where(included & (hygiene != "trash") & valid)


def direction(df: DataFrame) -> Column:
    """Polarity with mixed rows kept apart."""
    final = safe_text(pick(df, ["sentiment_final"], F.lit("")))
    label = F.lower(F.when(final != "", final).otherwise(safe_text(pick(df, ["sentiment_label"], F.lit("")))))
    mixed = F.coalesce(pick(df, ["mixed_flag"], F.lit(False)), F.lit(False))
    known = F.when(label.isin("positive", "negative", "neutral", "mixed"), label).otherwise("neutral")
    return F.when(mixed | (label == "mixed"), "mixed").otherwise(known)


def topic_for_similarity(topic: Column) -> Column:
    value = safe_text(topic)
    labels = F.create_map(*[F.lit(x) for pair in display.ASPECT_LABEL_KO.items() for x in pair])
    numbered = F.lower(value).rlike(r"^(?:이슈\s*\d+|issue\s*\d+)$")
    return F.when(value == "", "").when(numbered, DEFAULT_TOPIC).otherwise(F.lower(F.coalesce(F.element_at(labels, value), value)))


def intent_tokens(df: DataFrame, rules: KeywordRules = DEFAULT) -> Column:
    """Points, tags, class and topic a comment shares with similar ones."""
    empty = F.array().cast("array<string>")

    def points(name: str) -> Column:
        values = F.coalesce(pick(df, [name]).cast("array<string>"), empty)
        return point_tokens(values, None, POINT_NOISE, POINT_ALIASES, rules)

    kind = F.lower(safe_text(pick(df, ["classification_type"], F.lit(""))))
    topic = topic_for_similarity(pick(df, ["topic_label", "aspect_key"], F.lit("")))
    parts = F.concat(points("nlp_similarity_keys"), points("nlp_core_points"), points("nlp_context_tags"), F.array(kind, topic))
    return F.array_distinct(F.filter(parts, lambda t: t != ""))


def similar_classes(
    comments: DataFrame, tokens: str = "intent_tokens", journey: str = "journey_stage", text: str = "text_display", evidence: str | None = None, textless: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Classes of comments that no rule of similarity can tell apart, and which class each comment is in.

    A class is a journey stage, a direction, a set of tokens and a text (by its digest). Its id is a digest of
    these, so it is the same in every run. ``classes`` has one row for each with ``members`` and the most likes;
    ``evidence`` names a column that follows from the text and is carried along. Comments without a text are in none,
    unless ``textless`` asks for them (a representative without a text has similar comments all the same).
    """
    c = F.col
    rows = comments.where(F.lit(textless) | (safe_text(c(text)) != "")).select(
        "comment_id", F.coalesce(c(journey), F.lit("")).alias("journey"), c("direction").alias("direction"), F.array_sort(F.array_distinct(tokens)).alias("tokens"),
        F.md5(safe_text(c(text))).alias("text_digest"), F.coalesce(c("like_count"), F.lit(0)).alias("like_count"), *([c(evidence).alias("evidence")] if evidence else []),
    )
    parts = [c("journey"), c("direction"), F.array_join("tokens", "\x1f"), c("text_digest")]
    rows = rows.withColumn("class_id", F.md5(F.concat_ws("\x1e", *parts)))
    kept = [F.any_value(n).alias(n) for n in ("journey", "direction", "tokens", "text_digest", *(["evidence"] if evidence else []))]
    classes = rows.groupBy("class_id").agg(*kept, F.count("*").alias("members"), F.max("like_count").alias("most_likes"))
    return classes, rows.select("comment_id", "class_id")


def similar_links(classes: DataFrame, representatives: DataFrame, min_cluster: int = 3, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Links between the classes of representatives and the classes similar to them.

    Both are classes of :func:`similar_classes`. Linked are classes of the same journey and direction that share a
    token and differ in text, so no comment meets itself or its own copies. Each link stands for all pairs of
    members; ``members`` is the number of comments in ``class_id`` and ``cluster_size`` that over all links of
    ``rep_class``. Clusters below ``min_cluster`` are dropped. Representatives up to ``limit`` bytes are broadcast
    and matched per class; beyond it both sides meet by token.
    """
    c = F.col
    reps = representatives.select(
        c("class_id").alias("rep_class"), c("journey").alias("__journey"), c("direction").alias("__direction"), c("tokens").alias("__rep_tokens"), c("text_digest").alias("__rep_text")
    )
    rows = classes.withColumnsRenamed({"journey": "__journey", "direction": "__direction"})
    keys = ["__journey", "__direction"]
    if is_small(reps, limit):
        linked = attach(rows, reps, keys, "inner", limit=limit).where(F.arrays_overlap("tokens", "__rep_tokens") & (c("text_digest") != c("__rep_text")))
    else:
        by_token = rows.select("class_id", *keys, "text_digest", F.explode("tokens").alias("__token"))
        rep_tokens = reps.select("rep_class", *keys, "__rep_text", F.explode("__rep_tokens").alias("__token"))
        met = attach(by_token, rep_tokens, [*keys, "__token"], "inner", derived=True).where(c("text_digest") != c("__rep_text"))
        linked = attach(met.select("rep_class", "class_id").distinct(), classes, ["class_id"], "inner", derived=True)
    sizes = linked.groupBy("rep_class").agg(F.sum("members").alias("cluster_size")).where(c("cluster_size") >= min_cluster)
    carried = [n for n in ("evidence",) if n in classes.columns]
    return attach(linked, sizes, ["rep_class"], "inner", derived=True).select("rep_class", "class_id", "members", "most_likes", "cluster_size", *carried)


def similar_pairs(links: DataFrame, rep_members: DataFrame, members: DataFrame, min_cluster: int = 3) -> DataFrame:
    """Every pair of a representative and a comment similar to it, with the size of the representative's cluster.

    The links, made with ``min_cluster=1``, are written out by the comments of both classes. Pairs of one id are no
    pairs, also if its rows differ, and clusters below ``min_cluster`` pairs are dropped.
    """
    c = F.col
    reps = rep_members.select(c("comment_id").alias("rep_id"), c("class_id").alias("rep_class"))
    met = attach(links.select("rep_class", "class_id"), reps, ["rep_class"], "inner", derived=True)
    pairs = attach(members, met, ["class_id"], "inner", derived=True).where(c("comment_id") != c("rep_id")).select("rep_id", "comment_id")
    sizes = pairs.groupBy("rep_id").agg(F.count("*").alias("cluster_size")).where(c("cluster_size") >= min_cluster)
    return attach(pairs, sizes, ["rep_id"], "inner", derived=True)


def cluster_sizes(representatives: DataFrame, members: DataFrame, links: DataFrame) -> DataFrame:
    """Cluster size and evidence flag of every representative, also of those without a cluster."""
    counts = links.groupBy(F.col("rep_class").alias("class_id")).agg(F.first("cluster_size").alias("cluster_size"))
    placed = attach(representatives.select("comment_id"), members, ["comment_id"], derived=True)
    out = attach(placed, counts, ["class_id"], derived=True)
    return out.select("comment_id", F.coalesce("cluster_size", F.lit(0)).alias("cluster_size"), F.col("cluster_size").isNull().alias("insufficient_evidence"))


def cluster_evidence(links: DataFrame, limit: int = 3) -> DataFrame:
    """Per representative class the ``limit`` best different clauses of its cluster, those of the most liked texts first.

    ``links`` carry ``evidence``, the most telling clause of a text; a clause that several texts share counts once.
    """
    rule = ListRule(F.array("evidence"), limit, F.col("most_likes"))
    sizes = links.groupBy("rep_class").agg(F.first("cluster_size").alias("similar_count"))
    return attach(sizes, top_lists(links, ["rep_class"], "class_id", {"similar_evidence": rule}), ["rep_class"], derived=True)


def ids_to_texts(df: DataFrame, ids: str, comments: DataFrame, key: Sequence[str], text: str = "text_display", limit: int = 3) -> DataFrame:
    """Texts behind an id array, in the order of the ids; ids without a text are skipped."""
    rows = df.select(*key, F.posexplode(F.slice(F.col(ids), 1, limit)).alias("__pos", "comment_id"))
    texts = comments.select("comment_id", F.col(text).alias("__text")).where(F.coalesce("__text", F.lit("")) != "")
    found = rows.join(texts, "comment_id").groupBy(*key).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("__pos", "__text"))), lambda s: s["__text"]).alias("representative_comments")
    )
    out = df.join(found, list(key), "left")
    return out.withColumn("representative_comments", F.coalesce("representative_comments", F.array().cast("array<string>")))
