"""Labels, truth and opinions with the built-in rule tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxframe.operators import labels as lb
from voxframe.operators import opinions as op
from voxframe.operators import truth as tr
from voxframe.session import materialize


def labelled(spark, rows):
    df = spark.createDataFrame(rows, "comment_id string, cleaned_text string, parent_comment_text string, is_reply boolean")
    df = df.withColumns({"comment_validity": F.lit("valid"), "video_id": F.lit("v"), "text_display": F.col("cleaned_text"), "comment_quality": F.lit("valid")})
    return lb.classify_comments(df)


def test_comment_classes(spark):
    rows = [
        ("complaint", "소음이 너무 심하고 고장이 잦아요. 세탁기 최악", "", False),
        ("agrees", "I agree", "This washer is terrible and broken", True),
        ("channel", "great video thanks", "", False),
        ("praise", "이 세탁기 정말 추천해요 최고", "", False),
        ("safe", "no issues with my dryer so far", "", False),
        ("compare", "this dryer is better than the other", "", False),
    ]
    out = {r["comment_id"]: r for r in labelled(spark, rows).collect()}
    assert (out["complaint"]["sentiment_label"], out["complaint"]["classification_type"], out["complaint"]["confidence_level"]) == ("negative", "complaint", "high")
    assert (out["agrees"]["sentiment_label"], out["agrees"]["context_used"]) == ("negative", True)
    assert not out["channel"]["product_related"]
    assert out["praise"]["sentiment_label"] == "positive" and out["praise"]["product_target"] == "washer"
    assert out["safe"]["sentiment_label"] == "neutral"
    assert out["compare"]["classification_type"] == "comparison" and out["compare"]["sentiment_label"] == "neutral"


def test_external_labels_override_rules(spark):
    base = spark.createDataFrame([("a", "this dryer is fine"), ("b", "this dryer is fine")], "comment_id string, cleaned_text string")
    extra = spark.createDataFrame([("a", "negative", 0.9), ("b", "trash", 0.9)], "comment_id string, nlp_label string, nlp_confidence double")
    out = {r["comment_id"]: r for r in lb.classify_comments(lb.attach_enrichment(base, extra)).collect()}
    assert (out["a"]["sentiment_label"], out["a"]["confidence_level"]) == ("negative", "high")
    assert (out["b"]["sentiment_label"], out["b"]["classification_type"]) == ("neutral", "informational")


def test_truth_of_conflict_and_trash(spark):
    rows = [
        ("c1", "v", "The washer is loud", "valid", "valid", "negative", "positive", "complaint", True),
        ("c2", "v", "buy now", "excluded", "ad", "neutral", None, "informational", False),
        ("c3", "v", "service center repair took weeks", "valid", "valid", "negative", None, "complaint", False),
    ]
    df = spark.createDataFrame(
        rows, "comment_id string, video_id string, text_display string, comment_validity string, comment_quality string, sentiment_label string, nlp_label string, classification_type string, nlp_is_inquiry boolean"
    )
    out = {r["comment_id"]: r for r in tr.build_truth(df).collect()}
    assert (out["c1"]["sentiment_final"], out["c1"]["hygiene_class"], out["c1"]["analysis_included"]) == ("mixed", "supporting", True)
    assert (out["c2"]["hygiene_class"], out["c2"]["analysis_included"], out["c2"]["judgment_axes"]) == ("trash", False, [])
    assert out["c3"]["hygiene_class"] == "supporting"  # the word repair makes it a real inquiry


def test_opinion_split_and_sentences(spark):
    df = spark.createDataFrame([("It cleans well. But the door broke! It cleans well.",)], "t string")
    split = df.select(op.split_opinions(F.col("t")).alias("a"), op.split_opinions(F.col("t"), legacy_sentence_split=True).alias("b")).first()
    assert split["a"] == ["It cleans well", "the door broke!", "It cleans well."] or split["a"][0] == "It cleans well"
    assert len(split["b"]) == 2


def test_bundles_rank_groups(spark):
    rows = [(f"c{i}", "washer noise is terrible, the drum is broken number %d" % i, i) for i in range(4)] + [("p", "great dryer, I love it and recommend", 9)]
    df = spark.createDataFrame(rows, "comment_id string, text_display string, like_count int")
    df = df.withColumns({"product": F.lit("세탁기"), "sentiment_label": F.when(F.col("comment_id") == "p", "positive").otherwise("negative"), "signal_strength": F.lit("strong"),
                         "classification_type": F.lit("complaint"), "product_related": F.lit(True)})
    out = op.representative_bundles(materialize(op.opinion_units(df))).collect()
    assert {r["sentiment_code"] for r in out} == {"positive", "negative"} and all(r["rank"] >= 1 and r["cluster_size"] >= 1 for r in out)
    assert max(r["cluster_size"] for r in out if r["sentiment_code"] == "negative") >= 3


def test_noise_words_are_a_fixed_list(spark):
    from voxframe.functions import keywords as kw

    words = ["10년만에", "7개월만에", "5년만에", "몇달만에", "ㅋㅋ", "소음"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    got = {r["w"]: r["k"] for r in df.select("w", kw.normalize_keyword(F.col("w")).alias("k")).collect()}
    assert got["10년만에"] != "" and got["7개월만에"] != "" and got["5년만에"] == got["몇달만에"] == got["ㅋㅋ"] == "" and got["소음"] == "소음"


def test_terms_of_an_enrichment_count_three_times(spark):
    from voxframe.operators import keyword_summary as ks

    df = spark.createDataFrame([("소음 바다", ["소음", "소음", "리뷰"], "negative", "a"), ("배송", None, "negative", "바다")], "cleaned_text string, terms array<string>, sentiment_label string, channel_title string")
    got = {r["keyword"]: r["count"] for r in ks.keyword_pack(df, "negative", terms="terms").collect()}
    assert got == {"소음": 4, "배송": 1}


def test_clauses_read_the_text_once(spark):
    df = spark.createDataFrame([(" loud. and hot ",), ("",), (None,), ("nan",), (" but ",)], "body string")
    out = df.select(op.split_opinions(F.col("body"), " but ").alias("clauses"))
    assert out._jdf.queryExecution().analyzed().toString().count("body#") == 2
    assert [r["clauses"] for r in out.collect()] == [["loud", "and hot"], [], [], [], ["but"]]
