"""Top-k search, whitening and conversation repair against plain versions, on small tables with odd rows."""

from __future__ import annotations

import functools
import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxframe.llm import conversation_repair, language_id, topk_search, toxicity, whitening

VECTORS = "vec_id long, embedding array<double>, label int, row int, x int, id int, block int, n long"


def _vectors(rows, dim=6, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((4, dim))
    made = [(i, (centres[i % 4] + 0.3 * rng.standard_normal(dim)).tolist()) for i in range(rows)]
    made += [(100, made[100][1])] * 2 + [(rows + i, made[0][1]) for i in range(90)]
    made += [(200, None), (300, [float("nan")] * dim), (400, [math.inf] + [0.0] * (dim - 1)), (500, [None] + [1.0] * (dim - 1)), (None, made[0][1]), (600, [0.0] * dim)]
    return made


def _frame(spark, rows, parts=3):
    return spark.createDataFrame([(i, v, 1, 2, 3, 4, 5, 6) for i, v in rows], VECTORS).repartition(parts)


def _fine(v):
    return v is not None and all(c is not None and math.isfinite(c) for c in v)


# 11 ------------------------------------------------------------------------------------------------


def _searched(rows, k=10, scale=1024):
    usual = [(i, [math.floor(scale * c) for c in v]) for i, v in rows if _fine(v)]
    out = []
    for at, (i, q) in enumerate(usual):
        if i is None or i % 100:
            continue
        scores = [(-sum(a * b for a, b in zip(q, v)), j is None, j or 0) for to, (j, v) in enumerate(usual) if to != at and len(v) == len(q)]
        out += [(i, rank, None if none else j, -s) for rank, (s, none, j) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=lambda r: (r[0], r[1], r[3], r[2] is None, r[2] or 0))


def _search(df, **kw):
    found = topk_search.search(df, F.col("vec_id") % 100 == 0, **kw)
    assert found.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "bigint")]
    return sorted((tuple(r) for r in found.collect()), key=lambda r: (r[0], r[1], r[3], r[2] is None, r[2] or 0))


def test_search_finds_what_a_full_scan_finds(spark):
    rows = _vectors(900) + [(700, [1.0, 2.0]), (701, [3.0, -1.0]), (800, []), (801, [])]
    assert _search(_frame(spark, rows)) == _searched(rows)


def test_search_of_many_equal_and_of_huge_vectors(spark):
    copies = [(i, [0.5, -0.25, 1.0]) for i in range(700)] + [(i, [0.5, -0.25, 1.0 + i / 999]) for i in range(700, 720)]
    assert _search(_frame(spark, copies)) == _searched(copies)
    huge = [(i, [1e4 * (i + 1), -1e3 * i, 3.0]) for i in range(120)]
    assert _search(_frame(spark, huge), k=3) == _searched(huge, k=3)


def test_search_of_few_rows_and_none(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [-1.0, 0.0])]
    assert _search(_frame(spark, rows)) == [(0, 1, 1, 1024 * 512), (0, 2, 2, -1024 * 1024)]
    assert _search(_frame(spark, [(0, [1.0])])) == []
    assert _search(_frame(spark, [])) == []


def test_blocks_below_the_kth_score_are_left_out():
    rng = np.random.default_rng(2)
    tight = [np.round(1000 * (np.eye(8)[i % 8] + 0.01 * rng.standard_normal((64, 8)))).astype(np.int64) for i in range(40)]
    shard = topk_search._Shard(8, [(np.arange(64) + 64 * b, np.arange(64) + 64 * b, x.ravel()) for b, x in enumerate(tight)])
    seen = []

    class Watched(np.ndarray):
        def __getitem__(self, key):
            seen.append(len(key))
            return np.asarray(super().__getitem__(key))

    shard.x = shard.x.view(Watched)
    row, _, score = shard.best(tight[3][0], 64 * 3, None, 10)
    every = np.concatenate(tight) @ tight[3][0]
    every[64 * 3] = -(10**9)
    assert sorted(score.tolist()) == sorted(np.sort(every)[-10:].tolist()) and sum(seen) <= 8 * 64


# 12 ------------------------------------------------------------------------------------------------


def _whitened(rows, components):
    x = np.array([[math.floor(64 * c) + 1_000_000 for c in v] for _, v in rows], dtype=object)
    n, sums = len(x), x.sum(axis=0)
    deviation = [(sum((n * a - s) ** 2 for a, s in zip(row, sums))) for row in x]
    near = (x - 1_000_000).astype(float)
    near -= near.mean(axis=0)
    values, vectors = np.linalg.eigh(near.T @ near / n)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    return deviation, near @ vectors / np.sqrt(values), values, np.trace(near.T @ near / n)


@pytest.mark.parametrize("dim", [6, 70])
def test_whitening_agrees_with_a_full_decomposition(spark, dim):
    rows = _vectors(400, dim, seed=dim)
    usual = [(i, v) for i, v in rows if _fine(v)]
    wanted = 32 if dim == 70 else 6
    deviation, white, values, trace = _whitened(usual, wanted)
    got = whitening.whitened(_frame(spark, [*rows, (1, [1.0])])).collect()
    assert len(got) == len(usual) * wanted and {r["n"] for r in got} == {len(usual)}
    assert sorted(r["deviation"] for r in got if r["component"] == 1) == sorted(deviation)
    for c in range(1, wanted + 1):
        own = [r for r in got if r["component"] == c]
        assert math.isclose(own[0]["explained"], values[c - 1] / trace, rel_tol=1e-10)
        by_id = {}
        for i, w in zip((i for i, _ in usual), white[:, c - 1]):
            by_id.setdefault(i, w)
        sign = np.sign(sum(r["whitened"] * by_id[r["vec_id"]] for r in own))
        assert max(abs(r["whitened"] * sign - by_id[r["vec_id"]]) for r in own) < 1e-8
    assert all(r["identity_error"] < 1e-10 for r in got)


def test_polynomial_finds_the_leading_pairs():
    rng = np.random.default_rng(5)
    turn = np.linalg.qr(rng.standard_normal((200, 200)))[0]
    for spectrum in (np.logspace(4, -6, 200), np.linspace(1.2, 1.0, 200), np.r_[np.full(32, 3.0), np.ones(168)], np.r_[500.0, np.linspace(1.1, 1.0, 199)], np.r_[5.0, 4.0, np.zeros(198)]):
        matrix = (turn * spectrum) @ turn.T
        passes = []

        def apply(q):
            passes.append(q.shape[1])
            return matrix @ q

        values, vectors = whitening.leading(apply, 200, 32)
        assert np.abs(values - spectrum[:32]).max() < 1e-12 * spectrum[0] * 200 and len(passes) < 400
        assert np.abs(vectors.T @ vectors - np.eye(32)).max() < 1e-12
        assert np.linalg.norm(matrix @ vectors - vectors * values, axis=0).max() < 1e-12 * 200 * spectrum[0]


def test_whitening_of_little_and_of_large_numbers(spark):
    assert whitening.whitened(_frame(spark, [])).collect() == []
    assert whitening.whitened(_frame(spark, [(1, [1.0, 2.0])] * 3)).collect() == []
    flat = whitening.whitened(_frame(spark, [(i, [i / 64, 3.0, 2 * i / 64]) for i in range(5)])).collect()
    assert len(flat) == 5 and all(abs(abs(r["whitened"]) - abs(r["vec_id"] - 2) / math.sqrt(2)) < 1e-12 and r["explained"] == 1.0 for r in flat)
    large = whitening.whitened(_frame(spark, [(i, [1e12 * i, float(i % 2)]) for i in range(4)])).collect()
    assert {r["deviation"] for r in large} == {None}
    assert max(r["identity_error"] for r in large) < 1e-10


# 13 ------------------------------------------------------------------------------------------------

WHITE = " \t\n\x0b\x0c\r"
CONV = "conv_id long, turn long, role string, text string, conv string, part int, code int, at long"


def _damage(rows):
    out = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 0:
            continue
        if kind == 1:
            text = ""
        if kind == 2:
            text = text.translate(str.maketrans("", "", ".!?"))
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def _repair(rows):
    """Cheapest edits by a memo over (row, state), with whole audits compared."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), hashlib.sha256(r[3].encode()).digest()))
    seen, faults = set(), []
    for _, _, role, text in rows:
        left = text.strip(WHITE)
        faults.append("blank" if not left else "duplicate" if (role, text) in seen else "truncated" if left[-1] not in ".!?" else "")
        seen.add((role, text))
    moves = {0: "su", 1: "u", 2: "a", 3: "u"}
    state_of = {"s": 1, "u": 2, "a": 3}
    names = {"u": "user", "a": "assistant"}

    @functools.cache
    def best(i, state, inserts):
        options = []
        if i == len(rows) and state in (0, 3):
            options.append((0, "", ()))
        if inserts < 2:
            for role in moves[state].replace("s", ""):
                cost, audit, text = best(i, state_of[role], inserts + 1)
                options.append((cost + 5, "I" + audit, ((names[role], ""), *text)))
        if i < len(rows):
            _, _, role, text = rows[i]
            cost, audit, rest = best(i + 1, state, 0)
            options.append((cost + 2, "D" + audit, rest))
            if faults[i] in ("", "truncated"):
                extra = 5 if faults[i] else 0
                if role[:1] and role[:1] in moves[state]:
                    cost, audit, rest = best(i + 1, state_of[role[:1]], 0)
                    options.append((cost + extra, "K" + audit, ((role, text), *rest)))
                for to in moves[state].replace("s", ""):
                    cost, audit, rest = best(i + 1, state_of[to], 0)
                    options.append((cost + 1 + extra, "R" + audit, ((names[to], text), *rest)))
        return min(options) if options else (math.inf, "", ())

    # From the end, so that no call goes deep.
    for i in range(len(rows), -1, -1):
        for state in range(4):
            best(i, state, 0)
    cost, audit, kept = best(0, 0, 0)
    turns = [r[1] for r in rows if r[1] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest()
    return (gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, digest)


def _repairs(spark, rows, damage=True, parts=3):
    df = spark.createDataFrame([(*r, "c", 1, 2, 3) for r in rows], CONV).repartition(parts)
    mended = conversation_repair.damaged(df) if damage else df.select(F.col("conv_id").alias("conv"), "turn", "role", "text")
    got = conversation_repair.repaired(mended, df.select(F.col("conv_id").alias("conv"))).collect()
    assert len(got) == len({r[0] for r in rows})
    return {r[0]: tuple(r)[1:] for r in got}


def _expected(rows, damage=True):
    after = _damage(rows) if damage else rows
    return {c: _repair([r for r in after if r[0] == c]) for c in {r[0] for r in rows}}


def _random_rows(count, seed, longest=9):
    rng = random.Random(seed)
    texts = ["Hello.", "What?", "cut off", "", " \n", "Yes!", "no", None, "Ünï \U0001f600.", "a\x0b.\x0c"]
    out = []
    for conv in range(count):
        for _ in range(rng.randint(0, longest)):
            turn = rng.choice([None, *range(12)])
            role = rng.choice(["user", "assistant", "system", "user", "assistant", "tool", "", None, "users"])
            out.append((None if conv == 3 else conv, turn, role, rng.choice(texts)))
    return out


def test_repair_agrees_with_all_edits(spark):
    rows = _random_rows(220, 1)
    rows += rows[:40]
    assert _repairs(spark, rows) == _expected(rows)
    assert _repairs(spark, [r for r in rows if None not in r], damage=False) == _expected([r for r in rows if None not in r], damage=False)


def test_repair_of_long_conversations(spark):
    rng = random.Random(4)
    long = [(7, t, rng.choice(["user", "assistant", "system"]), rng.choice(["Fine.", "cut"]) + ("" if rng.random() < 0.2 else f" {t}.")) for t in range(700)]
    alike = [(8, 5, "user", "Same.")] * 900 + [(8, t, "assistant", f"{t}!") for t in range(9)] + [(9, 1, "tool", "x")]
    rows = long + alike
    assert _repairs(spark, rows, parts=6) == _expected(rows)


def test_repair_of_nothing(spark):
    assert _repairs(spark, []) == {}
    gone = next(c for c in range(100) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    assert _repairs(spark, [(gone, 0, "user", "Hi.")]) == {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_walk_through_blocks_equals_one_walk():
    rng = random.Random(9)
    for _ in range(60):
        codes = bytes(rng.choice([0, 1, 2, 3, 4, 8, 10, 11]) for _ in range(rng.randint(1, 40)))
        runs = tuple(rng.choice([1, 1, 1, 3]) for _ in codes)
        end = tuple(conversation_repair.END.tolist())
        whole_states, whole = conversation_repair.block_walks(codes, runs, end)
        cut = rng.randint(0, len(codes))
        later = tuple((conversation_repair.block_matrix(codes[cut:], runs[cut:]) + np.array(end)).min(axis=1).tolist())
        states, first = conversation_repair.block_walks(codes[:cut], runs[:cut], later)
        last_states, last = conversation_repair.block_walks(codes[cut:], runs[cut:], end)
        for s in range(4):
            assert first[s] + last[states[s]] == whole[s] and last_states[states[s]] == whole_states[s]


# 6 and 9 -------------------------------------------------------------------------------------------


def test_unknown_languages_are_filled_in_and_nothing_learnt_keeps_all(spark):
    english, spanish = "the house of the old town with the door ", "la casa de la ciudad con el perro y la puerta "
    rows = [(i, (english if i % 2 else spanish) * 3 + str(i), ("en" if i % 2 else "es") if i % 7 else None) for i in range(300)]
    df = spark.createDataFrame([*rows, (900, "12 34", "en"), (901, None, None)], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["lang"] for r in language_id.keep_identified(df).collect()}
    assert got == {i: "en" if i % 2 else "es" for i, _, _ in rows}
    bare = df.withColumn("lang", F.lit(None).cast("string"))
    assert {r["doc_id"] for r in language_id.keep_identified(bare).where("lang is null").collect()} == {i for i, _, _ in rows}


def test_many_languages_are_all_learnt(spark):
    rows = [(k * 40 + i, " ".join([f"w{k:03d}x"] * 12), f"l{k:03d}") for k in range(12) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert len(language_id.fit(df)["langs"]) == 12


def test_labels_of_absent_documents_do_not_count(spark):
    docs = spark.createDataFrame([(i, "a vile scum text here" if i % 5 == 0 else f"a clean text number {i} here") for i in range(400)], "doc_id long, text string")
    labels = [(i, int(i % 5 == 0)) for i in range(400) if i % 2 == 0] + [(10_000 + i, 1) for i in range(1_000)]
    got = toxicity.score(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert {r["predicted"] for r in got.where("doc_id % 5 = 0").collect()} == {1} and got.where("doc_id % 5 <> 0 and predicted = 1").count() == 0
