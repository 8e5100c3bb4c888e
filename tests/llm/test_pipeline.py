"""The pipeline, its queries and the helpers that operators share."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest

from tests.conftest import SF
from tests.llm.test_operators import DOCS, _components, _public, _texts
from voxframe.llm import queries, textbytes
from voxframe.llm.components import components
from workloads.compare import compare, duck


def test_components_of_any_links(spark):
    rng = np.random.default_rng(8)
    pairs = [tuple(map(int, rng.integers(0, 200, 2))) for _ in range(150)] + [(i, i + 1) for i in range(300, 340)] + [(0, k) for k in range(400, 460)] + [(5, 5)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(pairs + [(None, 1)], "a long, b long")).collect()}
    label = _components(460, pairs)
    assert got == {i: c for i, c in enumerate(label) if i != c}


def test_words_and_slices_of_batches():
    import pyarrow as pa

    texts = ["a bc", None, "", "  xé\x0b\ty ", "long" * 1000, "z"]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    parts = list(textbytes.slices([batch, batch.slice(2, 3)], "text", 100))
    assert sum(p.num_rows for p in parts) == 9
    for column in (batch.column(0), batch.slice(1, 4).column(0)):
        data, offsets = textbytes.raw(column)
        starts, ends, row = textbytes.word_bounds(data, offsets)
        got = [(int(r), data[s:e].tobytes()) for s, e, r in zip(starts, ends, row)]
        assert got == [(i, w) for i, t in enumerate(column.to_pylist()) for w in (t or "").encode().split()]
        hashes = textbytes.span_hash(textbytes.sums(data), starts, ends)
        assert len(set(hashes.tolist())) == len({w for _, w in got})


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_agrees_with_sql(spark, name):
    assert compare(queries.QUERIES[name](spark, SF), duck(SF), queries.ORACLES[name]) is None


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("empty", [False, True])
def test_pipeline_stages(spark, tmp_path, empty):
    import corpus_pipeline

    rows = [] if empty else _texts() + [(20 + i, f"the number {i} house of the old town has a door {i * 7} and a wall {i * 13}", "en" if i % 2 else "es", "abc"[i % 3], 1, 1, "h", 2, "k", "i") for i in range(60)]
    docs = spark.createDataFrame(rows, DOCS)
    columns = docs.columns
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{number}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{number}")
        if number < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
        if empty:
            assert docs.count() == 0
        elif number == 0:
            left = {r["doc_id"] for r in before.collect()} - {r["doc_id"] for r in docs.collect()}
            assert left == {5, 6, 7, 8}
        elif number == 1:
            ids = [r["doc_id"] for r in docs.where("doc_id is not null").collect()]
            assert len(ids) == len(set(ids)) and 1 in ids and 2 not in ids
        elif number == 2:
            assert "abcdef0123456789" not in " ".join(r["text"] for r in docs.collect())
        elif number == 4:
            encoder = _public()
            truth = sorted((r["doc_id"] or 0, len(encoder.encode_ordinary(r["text"])), hashlib.sha256(r["text"].encode()).hexdigest()) for r in before.collect())
            assert sorted((r["doc_id"] or 0, r["n_tokens"], r["decoded_sha256"]) for r in docs.collect()) == truth
            assert sorted(list(r["ids"]) for r in docs.collect()) == sorted(encoder.encode_ordinary(r["text"]) for r in before.collect())
            assert sorted(r["decoded"] for r in docs.collect()) == sorted(r["text"] for r in before.collect())


def test_pipeline_runs_over_the_tables(spark):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, SF)
    assert set(out.columns) >= {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"} and out.count() > 0
