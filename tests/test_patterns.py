"""The inverted index of patterns, their overlaps and the choice among them, against plain versions."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from voxframe.operators import mining as mn
from voxframe.operators import patterns as pt
from voxframe.operators.mining import MiningRules

RULES = MiningRules(hubs=("hub",), abstract=("vague",))


def _patterns(spark, rows):
    return spark.createDataFrame(rows, "pattern_id long, seed_a string, seed_b string, keyword_set array<string>")


def _comments(spark, texts):
    return pt.numbered(spark.createDataFrame([(f"c{i}", t) for i, t in enumerate(texts)], "comment_id string, tokens array<string>").repartition(4))


def test_support_overlap_and_members(spark):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(12)] + ["vague"]
    texts = [sorted(rng.sample(words, rng.randint(1, 9))) for _ in range(400)] + [sorted({*words, *(f"x{i}" for i in range(20_000))})]
    rows = []
    for i in range(30):
        a, b, *more = rng.sample(words, rng.randint(2, 5))
        rows.append((i, a, b, [a, b, *more]))
    held = {}
    for i, a, b, words_of in rows:
        context = [w for w in words_of if w != "vague"]
        held[i] = {f"c{n}": len(set(t) & set(words_of)) for n, t in enumerate(texts) if a in t and b in t and (not context or set(context) & set(t))}
    patterns, comments = _patterns(spark, rows), _comments(spark, texts)
    bitmaps = pt.pattern_bitmaps(patterns, comments, RULES).cache()
    assert {r["pattern_id"]: r["support"] for r in pt.pattern_support(bitmaps).collect()} == {i: len(c) for i, c in held.items() if c}
    got = {}
    for r in pt.pattern_members(patterns, comments, bitmaps).collect():
        got.setdefault(r["pattern_id"], {})[r["comment_id"]] = r["overlap"]
    assert got == {i: c for i, c in held.items() if c}
    shared = {(r["a"], r["b"]): r["n"] for r in pt._shared(bitmaps).collect()}
    assert shared == {(a, b): n for a in held for b in held if a < b and (n := len(set(held[a]) & set(held[b])))}


def test_patterns_without_comments(spark):
    assert pt.pattern_bitmaps(_patterns(spark, [(1, "a", "b", ["a", "b"])]), _comments(spark, [["a"], ["b"]]), RULES).count() == 0
    assert pt.pattern_bitmaps(_patterns(spark, []), _comments(spark, []), RULES).count() == 0


def _greedy(ids, conflicts):
    taken = set()
    for i in sorted(ids):
        if not any((j, i) in conflicts for j in taken):
            taken.add(i)
    return taken


def test_choice_settles_chains_and_rounds_alike(spark):
    rng = random.Random(3)
    chain = [(i, i + 1) for i in range(200)]
    mixed = sorted({tuple(sorted(rng.sample(range(60), 2))) for _ in range(120)})
    for size, pairs, limits in ((201, chain, (pt.SETTLED,)), (64, mixed, (pt.SETTLED, 40)), (3, [], (pt.SETTLED,))):
        ids = spark.range(size).select(F.col("id").alias("pattern_id"))
        edges = spark.createDataFrame(pairs, "a long, b long")
        for limit in limits:
            assert {r["pattern_id"] for r in pt.independent(ids, edges, limit).collect()} == _greedy(range(size), set(pairs))


def test_words_are_looked_up_once(spark):
    df = spark.createDataFrame([("1", "The Waters, -washes- s WASH was wateR's x-y"), ("2", "none"), ("3", None)], "comment_id string, text_clean string")
    rules = mn.MiningRules(token=r"[A-Za-z-]+", forms={"was": "is", "x-y": "gas"}, stopwords=("des",), products=("water", "gas"), actions=("wash", "is"), issues=("des", "ga"))
    same = {w: w for w in ("water", "gas", "wash", "is", "ga")}
    assert mn.written_forms(rules) == same | {"waters": "water", "gass": "gas", "washs": "wash", "was": "is", "x-y": "gas"}
    found = {r["comment_id"]: r["t"] for r in df.select("comment_id", mn.domain_tokens(F.col("text_clean"), rules).alias("t")).collect()}
    assert found == {"1": ["water", "wash", "is", "water", "gas"], "2": [], "3": []}
    out = mn.comment_keywords(df, rules)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1
    assert [tuple(r) for r in out.collect()] == [("1", ["gas", "is", "wash", "water"])]


def test_clusters_start_from_counts_that_are_held(spark):
    texts = ["red apple pie", "red apple tart", "blue steel ship", "blue steel boat", "  ", None]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, cleaned_text string")
    out = mn.assign_clusters(df, 2)
    assert "__words" not in out._jdf.queryExecution().analyzed().toString() and out.columns == ["id", "cleaned_text", "cluster_id"]
    got = {r["id"]: r["cluster_id"] for r in out.collect()}
    assert got[4] == got[5] == -1 and {got[i] for i in range(4)} <= {0, 1} and len(got) == 6
    assert {r["cluster_id"] for r in mn.assign_clusters(df.where("id > 2"), 2).collect()} == {-1}
