"""Text and keyword expressions against plain Python on hand-made rows."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from voxframe.functions import keywords as kw
from voxframe.functions import parsing
from voxframe.functions import text as tx


def values(spark, rows, expr):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, t string")
    return [r["v"] for r in df.select("i", expr(F.col("t")).alias("v")).orderBy("i").collect()]


def test_cleaning_drops_links_and_repeats(spark):
    rows = ["배송이 느려요ㅠㅠㅠㅠ https://example.com", "정말 좋아요!!!! https://example.com", "a &amp; b\nc", "Ha ha HA ha end", None]
    assert values(spark, rows, tx.clean_text) == ["배송이 느려요ㅠㅠ", "정말 좋아요!!", "a & b c", "Ha end", ""]


def test_cleaning_matches_brute_force(spark):
    rows = ["x" * n + " wow wow wow go go" + "!" * n for n in range(1, 9)] + ["ha " * 6000 + "end"]

    def slow(value):
        value = re.sub(r"(.)\1{3,}", lambda m: m.group(1) * 2, value)
        value = re.sub(r"\b(\w{2,})\b(?:\s+\1\b){2,}", lambda m: m.group(1), value, flags=re.I)
        return re.sub(r"\s+", " ", value).strip()

    assert values(spark, rows, tx.clean_text) == [slow(r) for r in rows]


def test_quality_classes(spark):
    rows = ["", "dm me for a promo code", "@a @b", "!!!", "good good good stuff", "a", "Thanks!", "lol", "abc", "this washer is fine"]
    expected = ["meaningless", "ad", "tagging_only", "meaningless", "repetitive", "meaningless", "generic_engagement", "generic_engagement", "low_context", "valid"]
    assert values(spark, rows, lambda c: tx.quality_class(tx.html_unescape(c), tx.clean_text(c))) == expected


def test_pii_is_found_and_masked(spark):
    rows = ["call 010-1234-5678 or mail jo@site.org now", "nothing here"]
    masked = values(spark, rows, lambda c: tx.mask_pii(c, tx.detect_pii(c)["values"]))
    assert masked[1] == "nothing here" and "010-****-5678" in masked[0] and "jo@site" not in masked[0]


def test_chunks_hold_whole_sentences(spark):
    text = "Aaa bbb. Ccc ddd! Eee fff ggg hhh? I."
    chunks = values(spark, [text], lambda c: tx.chunk_text(c, 12))[0]
    assert " ".join(chunks) == text and all(len(c) <= 12 or " " in c for c in chunks)
    assert chunks[0] == "Aaa bbb."


def test_keyword_normalization(spark):
    rows = ["noise", "door", "are", "통돌이는", "샀는데", "고객지원", "LG틔운", "3년만에", "ㅋㅋㅋ", "자가를", "12", "배송에서도"]
    expected = ["소음", "도어", "", "통돌이", "", "고객지원", "틔운", "", "", "", "", "배송"]
    assert values(spark, rows, kw.normalize_keyword) == expected


def test_loose_lists(spark):
    rows = ['["a", "b"]', "['maintenance_burden'", "a|b, c", "", "['x', 'y']"]
    assert values(spark, rows, parsing.parse_loose_list) == [["a", "b"], ["maintenance_burden"], ["a", "b", "c"], [], ["x", "y"]]


def test_flags(spark):
    rows = ["Yes", "0", "", "maybe", None, "2"]
    assert values(spark, rows, parsing.coerce_bool) == [True, False, False, False, False, True]


def test_personal_data_is_searched_once_for_all_fields(spark):
    df = spark.createDataFrame([("a@b.de or 010-1234-5678",), ("none",)], "body string")
    out = df.select(tx.detect_pii(F.col("body")).alias("p")).select("p.flag", "p.types")
    assert out._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 3
    assert [tuple(r) for r in out.collect()] == [("Y", "phone, email, account_id"), ("N", "")]


def test_quality_counts_letters_without_copies(spark):
    wanted = {"!!": "meaningless", "_": "meaningless", "!a!": "meaningless", "a-b": "low_context", "abcd!": "low_context", "abcde": "valid", "a b": "valid", "Thank, you!": "generic_engagement",
              "thank you so": "valid", "@ab @cd": "tagging_only", "x @cd": "valid", "@a @b @c @d": "valid", "go  go go": "repetitive"}
    df = spark.createDataFrame([(t,) for t in wanted], "t string")
    out = df.select("t", tx.quality_class(F.col("t"), F.col("t")).alias("q"))
    assert {r["t"]: r["q"] for r in out.collect()} == wanted
    # The one copy left is of texts no longer than a listed word.
    assert out._jdf.queryExecution().analyzed().toString().count("[^\\w]") == 0
