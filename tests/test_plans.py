"""Whole runs, skew paths, checks of contracts, and streams."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from voxframe.operators import relational as rel
from voxframe.operators import signals as sg
from voxframe.operators import similar as sm
from voxframe.operators import strategy as st
from voxframe.operators import topics as tp
from voxframe.plans.comment_plan import run_comments
from voxframe.plans.topic_plan import run_topics
from voxframe.operators.videos import SelectionPolicy
from voxframe.schemas import COMMENTS, VIDEOS, conform, require_columns
from voxframe.session import materialize
from voxframe.sources.collect import estimate_quota


def test_representatives_link_to_all_their_axes(spark):
    rows = [("v", "p", "c1", "usage", ["a", "b", "a", "c", "d", "e"], "negative")]
    df = spark.createDataFrame(rows, "video_id string, product string, comment_id string, journey_stage string, judgment_axes array<string>, sentiment_final string")
    got = st.cluster_representatives(df).where("level_type = 'video'").collect()
    assert {r["primary_axis"]: r["supporting_representatives"] for r in got} == {x: ["c1"] for x in "abcde"}


def test_hot_key_join_spreads_over_tasks(spark):
    rows = spark.range(6000).select("id", F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 50).cast("string"))).alias("key"))
    lookup = rows.groupBy("key").agg(F.count("*").alias("n"))
    joined = rel.attach(rows, lookup, ["key"], derived=True)
    assert joined.count() == 6000
    assert joined.where("key = 'hot'").select("n").distinct().collect()[0]["n"] == 4000
    assert "rows" not in joined.columns and joined.columns == ["id", "key", "n"]


def test_broadcast_only_below_the_limit(spark):
    rows, lookup = spark.range(100).withColumnRenamed("id", "k"), spark.range(10).withColumnRenamed("id", "k").withColumn("v", F.lit(1))
    hinted = "strategy=broadcast"
    small, large = rel.attach(rows, lookup, ["k"]), rel.attach(rows, lookup, ["k"], limit=-1)
    assert hinted in small._jdf.queryExecution().logical().toString() and hinted not in large._jdf.queryExecution().logical().toString()
    assert "BroadcastHashJoin" in small._jdf.queryExecution().executedPlan().toString()
    assert small.where("v is not null").count() == large.where("v is not null").count() == 10


def test_rows_are_spread_only_where_a_scan_has_few_tasks(spark):
    from voxframe.session import spread

    few, many = spark.range(0, 100, 1, 2), spark.range(0, 100, 1, 64)
    assert spread(few).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert spread(many).rdd.getNumPartitions() == 64


def test_group_limit_runs_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 2).alias("g"), "id")
    plan = rel.top_per_group(df, ["g"], [F.col("id")], 3)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_contracts(spark):
    with pytest.raises(ValueError, match="missing required columns"):
        require_columns(spark.range(1), ["comment_id"], "stage")
    out = conform(spark.range(1).select(F.lit("5").alias("like_count")), COMMENTS)
    assert out.columns == COMMENTS.names and out.first()["like_count"] == 5


def test_quota_estimate(spark):
    plan = spark.createDataFrame([(100, 1000, True), (0, 0, False)], "max_videos int, comments_per_video int, include_replies boolean")
    rows = estimate_quota(plan).orderBy(F.col("max_videos").desc()).collect()
    assert (rows[0]["search_calls"], rows[0]["thread_calls"], rows[0]["reply_calls"], rows[0]["total_units"]) == (2, 2000, 600, 2802)
    assert rows[1]["total_units"] == 0


def strategy_rows(spark, sizes):
    rows = [(f"{stage}{axis}{i}", "v1", "washer", stage, [axis], "negative", False, i) for (stage, axis), n in sizes.items() for i in range(n)]
    return spark.createDataFrame(rows, "comment_id string, video_id string, product string, journey_stage string, judgment_axes array<string>, sentiment_final string, mixed_flag boolean, like_count int").withColumns(
        {"analysis_included": F.lit(True), "hygiene_class": F.lit("strategic"), "reply_count": F.lit(0), "cleaned_text": F.col("comment_id")}
    )


def test_single_comments_are_no_insight(spark):
    df = strategy_rows(spark, {("usage", "brand_trust"): 4, ("purchase", "price_value_fit"): 1})
    candidates = st.strategy_candidates(df, df)
    insights = st.strategy_insights(candidates).collect()
    assert {(r["level_type"], r["journey_stage"]) for r in insights} == {("video", "usage"), ("product_group", "usage")}
    assert all("4건" in r["insight_summary"] for r in insights)
    reasons = {r["journey_stage"]: r["insufficient_reasons"] for r in candidates.where("level_type = 'video'").collect()}
    assert reasons["purchase"] == ["cluster_lt_3"]


def test_no_representative_is_insufficient(spark):
    df = strategy_rows(spark, {("usage", "brand_trust"): 5})
    out = st.strategy_candidates(df, df.where("false")).collect()
    assert all(r["insufficient_reasons"] == ["representative_link_missing"] for r in out)


def test_evidence_line_writes_counts_without_separators(spark):
    df = strategy_rows(spark, {("usage", "brand_trust"): 1200})
    lines = {r["evidence_summary"] for r in st.strategy_candidates(df, df).collect()}
    assert lines == {"동일 신호 1200건 / 레벨 내 비중 100.0% / 문제 시그니처 1200개 / 영향지표 719400.0"}


def _pairs(df, reps, **kw):
    """Links and members joined again."""
    classes, members = sm.similar_classes(df)
    rep_classes, rep_members = sm.similar_classes(reps)
    of = lambda rows: {k: {r["comment_id"] for r in rows if r["class_id"] == k} for k in {r["class_id"] for r in rows}}
    inside, leading = of(members.collect()), of(rep_members.collect())
    out = {}
    for link in sm.similar_links(classes, rep_classes, **kw).collect():
        for rep in leading[link["rep_class"]]:
            out.setdefault(rep, set()).update(inside[link["class_id"]])
    return out


def test_similar_comments_keep_mixed_apart(spark):
    rows = [(f"c{i}", f"text {i}", "usage", "negative", i == 5, ["noise"]) for i in range(6)] + [("d", "other", "usage", "positive", False, ["noise"])]
    df = spark.createDataFrame(rows, "comment_id string, text_display string, journey_stage string, sentiment_final string, mixed_flag boolean, intent_tokens array<string>")
    df = df.withColumns({"direction": sm.direction(df), "like_count": F.lit(1)})
    assert _pairs(df, df.where("comment_id in ('c0', 'c5', 'd')")) == {"c0": {"c1", "c2", "c3", "c4"}}


def test_all_similar_comments_are_found(spark):
    df = spark.range(60).select(
        F.col("id").cast("string").alias("comment_id"), F.concat(F.lit("shared words "), F.col("id").cast("string")).alias("text_display"), F.lit("usage").alias("journey_stage"),
        F.lit("negative").alias("direction"), F.array(F.lit("noise")).alias("intent_tokens"), F.col("id").alias("like_count"),
    )
    rep = df.where("comment_id = '0'")
    assert _pairs(df, rep) == _pairs(df, rep, limit=0) == {"0": {str(i) for i in range(1, 60)}}


def test_copies_of_a_comment_are_one_class(spark):
    rows = [(f"c{i}", f"text {i % 5}", "usage", "negative", ["a", "b"] if i % 2 else ["b", "a"]) for i in range(500)] + [("x", "text 0", "usage", "negative", ["z"])]
    df = spark.createDataFrame(rows, "comment_id string, text_display string, journey_stage string, direction string, intent_tokens array<string>").withColumn("like_count", F.lit(1))
    classes, members = sm.similar_classes(df)
    assert classes.count() == 6 and members.count() == 501
    links = sm.similar_links(classes, classes).collect()
    assert len(links) == 20 and {r["members"] for r in links} == {100} and {r["cluster_size"] for r in links} == {400}


@pytest.mark.parametrize("limit", [1 << 25, 0])
def test_similar_comments_are_listed_one_by_one(spark, limit):
    rows = [("r", "loud", ["noise"]), ("bare", "", ["noise"]), ("few", "cold", ["heat"]), ("h", "hot", ["heat"])] + [(f"c{i}", "too loud" if i < 3 else "hums", ["noise", "hum"]) for i in range(5)] + [("r", "loud too", ["noise"])]
    df = spark.createDataFrame(rows, "comment_id string, text_display string, intent_tokens array<string>").withColumns({"journey_stage": F.lit("usage"), "direction": F.lit("negative"), "like_count": F.lit(1)})
    classes, members = sm.similar_classes(df)
    rep_classes, rep_members = sm.similar_classes(df.where("comment_id in ('bare', 'few') or text_display = 'loud'"), textless=True)
    pairs = sm.similar_pairs(sm.similar_links(classes, rep_classes, min_cluster=1, limit=limit), rep_members, members).collect()
    copies = {f"c{i}" for i in range(5)}
    assert {(p["rep_id"], p["comment_id"], p["cluster_size"]) for p in pairs} == {("r", c, 5) for c in copies} | {("bare", c, 7) for c in copies | {"r"}}
    assert len(pairs) == 12


def test_evidence_of_a_cluster_counts_a_clause_once(spark):
    rows = [("r", "c1", "loud", 5), ("r", "c2", "loud", 9), ("r", "c3", "hot", 7), ("r", "c4", None, 50), ("r", "c5", "slow", 7), ("r", "c6", "late", 1)]
    links = spark.createDataFrame([(*r, 2, 12) for r in rows], "rep_class string, class_id string, evidence string, most_likes long, members long, cluster_size long")
    (row,) = sm.cluster_evidence(links).collect()
    assert row["similar_evidence"] == ["loud", "hot", "slow"] and row["similar_count"] == 12


def test_topic_run(spark):
    rows = [
        ("c1", "It's great but why do my glasses come out cloudy?"), ("c2", "가격은 비싸지만 성능은 좋다"), ("c3", "가격만 낮으면 바로 구매한다"),
        ("c4", "LG dishwasher repair service is slow and the filter is broken"), ("c5", "hair dryer is good"),
    ]
    df = spark.createDataFrame(rows, "comment_id string, text_display string").withColumns({"video_id": F.lit("v1"), "like_count": F.lit(3), "reply_count": F.lit(1)})
    out = run_topics(df)
    rules = {}
    for r in out["topic_signals"].collect():
        rules.setdefault(r["comment_id"], []).append(r["split_rule"])
    assert rules["c1"] == ["contrast"] * 2 and rules["c2"] == ["contrast"] * 2 and set(rules["c3"]) == {"conditional"}
    products = {r["comment_id"]: r["product_category"] for r in out["topic_context"].collect()}
    assert products["c4"] == "dishwasher" and products["c5"] == "unknown"
    assert out["topic_ranked"].count() == out["topics"].count() == out["topic_actions"].count() == out["topic_export_rows"].count()


def test_comment_run(spark):
    texts = [
        "이 세탁기 소음이 너무 심하고 고장이 잦아서 최악입니다", "세탁기 소음 때문에 실망했어요 정말 불편합니다", "건조기 성능이 좋아요 추천합니다 만족해요", "lol", "How do I install this dryer? https://x.org",
        "세탁기 수리 서비스가 느리고 불만이 많아요",
    ]
    rows = [("r", f"v{i % 2}", f"c{i}", None, False, t, t, i, f"2024-01-{10 + i:02d}T00:00:00Z") for i, t in enumerate(texts)]
    comments = conform(spark.createDataFrame(rows, "run_id string, video_id string, comment_id string, parent_comment_id string, is_reply boolean, text_original string, text_display string, like_count int, published_at string"), COMMENTS)
    videos = conform(spark.createDataFrame([("v0", "세탁기 리뷰", "ch"), ("v1", "dryer review", "ch")], "video_id string, title string, channel_title string"), VIDEOS, {"product": "세탁기", "region": "KR"})
    out = run_comments(videos, comments, SelectionPolicy(products=("세탁기", "dryer")), risk_keywords=("소음",))
    merged = {r["comment_id"]: r for r in out["comments"].collect()}
    assert len(merged) == 6 and merged["c0"]["sentiment_label"] == "negative" and merged["c3"]["comment_validity"] == "excluded"
    assert merged["c0"]["risk_flags"] == "소음" and merged["c4"]["external_links"] == ["https://x.org"]
    kpis = {r["metric"]: r["value"] for r in out["runs_summary"].collect()}
    assert kpis["total_comments"] == 6 and kpis["removed_comments"] == 1 and kpis["avg_comments_per_video"] == 3
    assert sum(r["ratio"] for r in out["weekly_sentiment_trend"].collect()) > 0
    assert out["opinion_units"].count() >= 1 and out["strategy_insight_candidates"].count() >= 1


def _long_signals(spark):
    text = " but ".join(f"the filter of machine {i} is broken" for i in range(40))
    df = spark.createDataFrame([(f"c{i}", text) for i in range(3)], "comment_id string, text_display string")
    return sg.signal_units(sg.normalize_products(sg.comment_context(df.withColumns({"video_id": F.lit("v"), "like_count": F.lit(1), "reply_count": F.lit(0)}))))


def test_signals_do_not_carry_the_whole_text(spark):
    units = _long_signals(spark)
    above = units._jdf.queryExecution().optimizedPlan().toString().split("Generate")[0]
    assert "__text" not in above and units.count() == 120


def test_topics_move_no_texts(spark):
    units = materialize(_long_signals(spark))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = tp.attach_topics(units)
        assert "SortMergeJoin" not in rows._jdf.queryExecution().sparkPlan().toString()
        rows = materialize(rows)
        chosen = tp.select_representatives(materialize(tp.build_topics(rows)), rows)
        assert "signal_text" not in chosen._jdf.queryExecution().optimizedPlan().toString()
        assert all(r["signature"].endswith("_broken_filter") for r in rows.collect()) and len(chosen.collect()) == 1
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_a_signature_word_must_stand_alone(spark):
    rows = [(f"c{i}", f"c{i}", t) for i, t in enumerate(["Hums and whirrs loudly", "humming whirrsx only here"])]
    df = spark.createDataFrame(rows, "signal_id string, comment_id string, signal_text string").withColumns(
        {n: F.lit(v) for n, v in {"product_semantic_id": "p", "journey_stage": "usage", "judgment_axis": "other", "polarity": "neutral", "polarity_group": "neutral", "topic_id": "t", "signature": "usage_hums_whirrs",
                                  "signal_type": "primary", "weight": 1.0, "like_count": 0, "reply_count": 0}.items()}
    )
    (row,) = tp.select_representatives(df.select("topic_id").distinct(), df).collect()
    assert row["representative_comment_ids"] == ["c0", "c1"]
