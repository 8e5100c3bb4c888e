"""Rates, the audit of stored tables, checks within a plan, and the manifest of the version table."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from voxframe.functions.keywords import KeywordRules
from voxframe.functions.markers import may_hold
from voxframe.functions.text import preview
from voxframe.operators import cards as cd
from voxframe.operators import patterns as pt
from voxframe.operators import quality as qa
from voxframe.operators import topics as tp
from voxframe.operators import videos as vd
from voxframe.operators.relational import ListRule, top_lists
from voxframe.sources import readers as rd
from voxframe.streaming import incremental as inc


def test_rates_of_segments_and_empty_bases(spark):
    df = spark.createDataFrame([("a", True), ("a", False), ("b", True), (None, True), ("c", False)], "part string, bad boolean")
    metrics = [
        qa.Metric("all", "rows", F.col("bad")), qa.Metric("never", "rows", F.col("bad"), F.lit(False)), qa.Metric("each", "rows", F.col("bad"), by="part"),
        qa.Metric("share", "rows", F.col("bad"), F.col("bad"), by="part", of_all=True),
    ]
    got = {(r["metric"], r["segment"]): (r["hits"], r["base"], r["rate"]) for r in qa.documented_rates({"rows": df}, metrics).collect()}
    assert got == {
        ("all", ""): (3, 5, 0.6), ("never", ""): (0, 0, None), ("each", "a"): (1, 2, 0.5), ("each", "b"): (1, 1, 1.0), ("share", "a"): (1, 3, 0.333333), ("share", "b"): (1, 3, 0.333333),
    }


def test_audit_of_stored_tables(spark, tmp_path):
    spark.range(7).write.parquet(f"{tmp_path}/good")
    spark.range(0).write.parquet(f"{tmp_path}/empty")
    (tmp_path / "raw" / "deep").mkdir(parents=True)
    for name in ("raw/a.json", "raw/deep/b.json", "raw/c.txt"):
        (tmp_path / name).write_text("{}")
    found = rd.catalogue(spark, {n: f"file://{tmp_path}/{n}" for n in ("good", "empty", "gone")})
    wanted = spark.createDataFrame([("good", ["id", "name"], 1), ("empty", ["id"], 1), ("gone", ["id"], 0)], "table string, columns array<string>, min_rows long")
    got = {r["table"]: r for r in qa.table_audit(found, wanted).collect()}
    assert {n: (r["status"], r["rows"], r["absent"]) for n, r in got.items()} == {"good": ("columns", 7, ["name"]), "empty": ("rows", 0, []), "gone": ("missing", 0, ["id"])}
    assert got["good"]["files"] >= 1 and got["good"]["bytes"] > 0
    assert rd.stored_files(spark, f"file://{tmp_path}/raw").first()["files"] == 2
    assert rd.stored_files(spark, f"file://{tmp_path}/nowhere").first()["files"] == 0


def test_a_failed_check_stops_the_reader(spark):
    context = spark.createDataFrame([("c1", "text"), ("c2", " ")], "comment_id string, raw_text string")
    topics, signals = spark.range(2), spark.range(1)
    assert tp.checked(topics, tp.sanity_checks(context, signals, topics)).count() == 2
    for broken in ((context, signals, topics.limit(0)), (context, signals.limit(0), topics)):
        with pytest.raises(Exception, match="must be >= 1 but is 0"):
            tp.checked(broken[2], tp.sanity_checks(*broken)).collect()


def test_manifest_names_what_is_live(spark, tmp_path):
    source, target = tmp_path / "in", f"file://{tmp_path}/versions"

    def land(rows, after):
        folder = f"{source}{after}"
        spark.createDataFrame(rows, "video_id string, comment_id string, text string, at long").write.parquet(f"file://{folder}")
        stream = inc.read_landing(spark, f"file://{folder}", "video_id string, comment_id string, text string, at long")
        inc.append_versions(stream, target, f"file://{tmp_path}/check{after}", after=after).awaitTermination()

    def live():
        return {r["comment_id"]: r["text"] for r in inc.current_rows(spark, target, "at").collect()}

    assert inc.last_batch(spark, target) == -1 and inc.replaced(spark, target) == []
    land([("v", "a", "old", 1), ("v", "b", "stay", 1)], -1)
    first = inc.compacted(spark, target, "at")
    assert live() == {"a": "old", "b": "stay"} and inc.replaced(spark, target) == [f"{target}/batch_id=0"]
    land([("v", "a", "new", 2), ("v", "c", "more", 2)], inc.last_batch(spark, target))
    assert live() == {"a": "new", "b": "stay", "c": "more"}
    second = inc.compacted(spark, target, "at")
    assert live() == {"a": "new", "b": "stay", "c": "more"} and first != second
    assert set(inc.replaced(spark, target)) == {first, f"{target}/batch_id=0", f"{target}/batch_id=1"}


def test_lists_count_rank_and_break_ties_by_id(spark):
    rows = [("v", "1", ["x", "y"], 5.0, ["p"]), ("v", "2", ["y", "z", ""], 9.0, ["q"]), ("v", "3", ["z", None], None, ["p"]), ("w", "4", [], 1.0, None)]
    df = spark.createDataFrame(rows, "video_id string, id string, words array<string>, likes double, said array<string>")
    got = {r["video_id"]: r for r in top_lists(df, ["video_id"], "id", {"words": ListRule(F.col("words"), 2), "said": ListRule(F.col("said"), 1, F.col("likes"))}).collect()}
    assert set(got) == {"v"} and got["v"]["words"] == ["y", "z"] and got["v"]["said"] == ["q"]


def _value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_card_texts(spark):
    lit = lambda *v: F.array(*[F.lit(x) for x in v]).cast("array<string>")
    assert _value(spark, cd.combined_text([F.lit("one two"), F.lit("two"), F.lit(None), F.lit("three"), F.lit("one two")])) == "one two three"
    clauses = lit("배송이 빨랐다", "소음 때문에 불편하다 3번", "만족합니다")
    assert _value(spark, cd.representative_clause(clauses, F.lit("positive"))) == "만족합니다"
    assert _value(spark, cd.representative_clause(clauses, F.lit("negative"))) == "소음 때문에 불편하다 3번"
    assert _value(spark, cd.representative_clause(lit(), F.lit("negative"))) is None
    fields = {"nlp_insight_summary": F.lit("??"), "nlp_summary": F.lit("sponsored"), "cleaned_text": F.lit("x" * 100)}
    line = lambda points: cd.row_summary(lambda n: fields.get(n, F.lit(None).cast("string")), points, lit("tag"))
    assert _value(spark, line(lit())) == "x" * 83 + "..." and _value(spark, line(lit("a", "b", "c"))) == "tag: a, b"
    assert _value(spark, cd.secondary_concern(F.lit("WiFi 불편"), F.lit("positive"))).startswith("앱 연결") and _value(spark, cd.secondary_concern(F.lit("wifi"), F.lit("negative"))) == ""
    items = _value(spark, cd.voc_items(F.lit("Lasted FOREVER, easy to clean, the Board broke"), F.lit("negative")))
    assert [(i["topic"], i["evidence_span"], i["sentiment"]) for i in items] == [("청소 편의", "easy to clean", "부정"), ("내구성", "Lasted FOREVER", "부정"), ("수리/서비스", "Board", "부정")]
    assert _value(spark, cd.refined_aspect(F.lit("이슈 3"), lit(), F.lit("필터 소음"))) == "Performance" and _value(spark, cd.refined_aspect(F.lit("Mine"), lit("x"), F.lit(""))) == "Mine"
    assert _value(spark, cd.reason_conflicts(F.lit("불만과 문제"), F.lit("positive"))) and not _value(spark, cd.reason_conflicts(F.lit(""), F.lit("positive")))
    assert _value(spark, cd.quantitative_flag(F.lit(None).cast("boolean"), F.lit("3년 썼다"))) and not _value(spark, cd.quantitative_flag(F.lit(False), F.lit("three")))
    long = "a" * 90 + ". " + "b" * 200
    assert _value(spark, pt.snippet(F.lit(long))) == "a" * 90 + "." and _value(spark, pt.snippet(F.lit("Hi. " + "b" * 200))) == "Hi. " + "b" * 166 + "..."


def _mentions(df, name: str) -> int:
    """How often the unresolved plan reads a column, the scan itself included."""
    return df._jdf.queryExecution().analyzed().toString().count(f"{name}#")


def test_subjects_read_the_text_once(spark):
    df = spark.createDataFrame([(" the Board broke",), ("nan",), (None,)], "body string")
    out = df.select(cd.voc_items(F.col("body"), F.lit("neutral")).alias("items"))
    assert _mentions(out, "body") == 2
    assert [[(i["topic"], i["evidence_span"]) for i in r["items"]] for r in out.collect()] == [[("수리/서비스", "Board")], [("기타 사용 경험", "")], [("기타 사용 경험", "")]]


def test_clauses_of_cards_read_the_text_once(spark):
    texts = ["Loud. 소음이 3번 났다! see https://x.y/z now", " sponsored post. fine then", "a: b: c: 5 kg", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "body string")
    clauses = cd.split_clauses(F.col("body"))
    assert _mentions(df.select(clauses), "body") == 2
    chosen = df.select(preview(F.coalesce(cd.representative_clause(clauses, F.lit("negative")), F.lit("")), 82).alias("best"), cd.salient_clauses(clauses, 1).alias("first"), clauses.alias("all"))
    assert _mentions(chosen, "body") == 4
    rows = chosen.collect()
    assert [r["all"] for r in rows] == [["Loud", "소음이 3번 났다"], ["fine then"], ["a: b: c: 5 kg"], [], []]
    assert [r["first"] for r in rows] == [["소음이 3번 났다"], ["fine then"], ["a: b: c: 5 kg"], [], []]
    assert [r["best"] for r in rows] == ["소음이 3번 났다", "fine then", "a: b: c: 5 kg", "", ""]


def test_chosen_clauses_are_not_split_again(spark):
    cards = spark.createDataFrame([("1", "one clause. another one", "positive", "other clause")], "comment_id string, text_display string, sentiment string, representative_clause string")
    frame = cards.select("*", *[F.lit(None).cast("string").alias(n) for n in ("stage", "classification_type")], F.lit(False).alias("mixed_flag"), F.lit(0).alias("similar_count"))
    out = cd.resolution_evidence(frame)
    assert "split(" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert out.first()["representative_evidence"] == "other clause"


def test_texts_of_another_script_are_settled_by_one_search(spark):
    held = lambda text, *markers: _value(spark, may_hold(F.lit(text), markers))
    assert held("das Gerät", "소음", "고장 as") is False and held("큰 소음", "소음", "고장") and held("x", "소음", "as") and held("x", "É") and held("x") is False


def test_signals_of_videos_read_the_texts_once(spark):
    rows = [("1", "v", "loud noise. it broke", ["pump"], "negative", 3), ("2", "v", "fine", ["pump", "hose"], "positive", 5), ("3", "w", "", None, "neutral", None)]
    df = spark.createDataFrame(rows, "comment_id string, video_id string, text_display string, nlp_core_points array<string>, sentiment_label string, like_count long")
    rules = KeywordRules(stopwords=(), translations={}, aliases={}, keep=(), products=(), noise_suffixes=(), verb_suffixes=(), particles=(), drop_latin=False)
    out = vd.video_signals(df, rules=rules)
    assert "text_display" not in out._jdf.queryExecution().analyzed().toString()
    got = {r["video_id"]: r for r in out.collect()}
    assert got["v"]["evidence_clauses"] == ["fine", "loud noise"] and got["v"]["top_points"] == ["pump", "hose"] and got["v"]["nlp_coverage"] == 1.0
    assert got["w"]["evidence_clauses"] == [] and got["w"]["nlp_coverage"] == 0.0 and got["w"]["count"] == 1
    known = vd.video_signals(df.withColumn("salient_clause", F.upper("text_display")), rules=rules)
    assert {r["video_id"]: r["evidence_clauses"] for r in known.collect()} == {"v": ["FINE", "LOUD NOISE. IT BROKE"], "w": []}
