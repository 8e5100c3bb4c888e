"""Exact search for the largest inner products by block-at-a-time pruning.

A dimension is a term, the floored component of a row is its weight. Rows are ordered by the signs of their products with
fixed directions (so that like rows stand together) and cut into blocks of consecutive rows. A block keeps its forward
index, the vectors of its rows, from which follow the largest and smallest weight of each term. For a query the sum over
terms of the larger product with either bounds every score of the block.

Blocks are dealt out in shards by ranges of the order, so the rows of a shard, and with them its memory, are bounded,
however many rows are alike. Every query visits every shard; there it takes the blocks in falling order of bounds and
scores them through their forward indexes until the bound falls below the kth score. The search does not start blank: the
block a query lies in already gives a score that the kth must reach. The best of each shard meet by query at the end.

Defined results: vectors that are null or hold null or non-finite components take no part, neither as query nor as
candidate. Only rows of one length meet; empty vectors meet each other at score 0. Rows that repeat an id are rows of
their own: each is searched for, and each may be found, also by the other. Ids are longs; a null id comes last among
ties. Integers beyond 2^62 count as 2^62, scores beyond a long as the largest (smallest) long. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxframe.session import materialize

#: Rows of a block, and components of a shard (its vectors are held as numbers of 8 bytes).
BLOCK, SHARD = 64, 1 << 22
#: Directions whose signs order the rows, and blocks that are scored in one step at most.
SIGNS, STEP = 16, 32
#: Components are floored multiples of this.
SCALE = 1024

_LARGEST = 1 << 62
_LONG = (1 << 63) - 1
_BLOCKS = "ask boolean, shard int, dim int, block int, rows array<long>, ids array<long>, x array<long>, least long"
_FOUND = "query_row long, query_id long, vec_row long, vec_id long, score long"


def _products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Exact ``left @ right`` of integers, within the range of a long."""
    size = max(1, left.shape[-1]) * (float(np.abs(left).max(initial=0)) + 1) * (float(np.abs(right).max(initial=0)) + 1)
    if size < 2.0**52:
        return (left.astype(np.float64) @ right.astype(np.float64)).astype(np.int64)
    exact = left.astype(object) @ right.astype(object)
    return np.vectorize(lambda v: max(-_LONG - 1, min(_LONG, int(v))), otypes=[np.int64])(exact)


def _rows(batch: pa.RecordBatch) -> Iterator[tuple[int, slice, np.ndarray]]:
    """Runs of rows of one length: the length, where they are, and their vectors."""
    column = batch.column("x")
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    flat, ends = column.flatten().to_numpy(zero_copy_only=False), np.cumsum(sizes)
    cuts = [0, *(np.flatnonzero(np.diff(sizes)) + 1).tolist(), len(sizes)]
    for start, stop in zip(cuts, cuts[1:]):
        dim = int(sizes[start])
        yield dim, slice(start, stop), flat[ends[start] - dim : ends[stop - 1]].reshape(stop - start, dim)


def _long(column: pa.Array) -> np.ndarray:
    """Ids as longs; null is the largest, which also comes last."""
    return column.fill_null(_LONG).to_numpy(zero_copy_only=False)


def _ids(values: np.ndarray) -> pa.Array:
    return pa.array(values, pa.int64(), mask=values == _LONG)


def indexed(vectors: DataFrame, asked: Column, *, k: int, vector_col: str, id_col: str, scale: int = SCALE) -> tuple[DataFrame, int]:
    """Blocks and queries as one written table, and the number of shards."""
    v = F.col("v")
    fine = v.isNotNull() & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    floored = F.transform(v, lambda c: F.floor(F.greatest(F.least(c * float(scale), F.lit(float(_LARGEST))), F.lit(-float(_LARGEST)))))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.coalesce(asked, F.lit(False)).alias("ask"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = rows.where(fine).select(F.monotonically_increasing_id().alias("row"), "id", "ask", floored.alias("x"))

    def ordered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = np.zeros(batch.num_rows, np.int32)
            for dim, at, x in _rows(batch):
                sides = x.astype(np.float64) @ np.random.default_rng(3).standard_normal((dim, SIGNS)) > 0
                key[at] = sides @ (1 << np.arange(SIGNS))
            yield pa.RecordBatch.from_pydict({c: batch.column(c) for c in ("row", "id", "ask", "x")} | {"key": pa.array(key)})

    keyed = materialize(rows.mapInArrow(ordered, "row long, id long, ask boolean, x array<long>, key int"))
    size = keyed.agg(F.sum(F.size("x")).alias("n")).first()["n"] or 0
    shards = max(keyed.sparkSession.sparkContext.defaultParallelism, -(-size // SHARD))
    order = [F.size("x"), "key", "row"]
    blocks = keyed.repartitionByRange(shards, *order).sortWithinPartitions(*order).mapInArrow(lambda batches: _cut(batches, k), _BLOCKS)
    blocks = materialize(blocks)
    most = blocks.agg(F.max("shard").alias("m")).first()["m"]
    return blocks, 0 if most is None else most + 1


def _cut(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Blocks of consecutive rows of one length, and the queries among them with a score that the kth reaches."""
    shard, block = TaskContext.get().partitionId(), 0
    held: list[tuple] = []
    dim = None

    def closed(last: bool) -> Iterator[pa.RecordBatch]:
        nonlocal held, block
        row, name, ask, x = (np.concatenate(c) for c in zip(*held))
        held = []
        for at in range(0, len(row), BLOCK):
            if len(row) - at < BLOCK and not last:
                held = [(row[at:], name[at:], ask[at:], x[at:])]
                break
            part = slice(at, at + BLOCK)
            yield _record(shard, dim, block, row[part], name[part], x[part])
            wanted = np.flatnonzero(ask[part])
            if len(wanted):
                scores = _products(x[part][wanted], x[part].T)
                for i, own in zip(wanted.tolist(), scores):
                    others = np.delete(own, i)
                    least = int(np.sort(others)[-k]) if len(others) >= k else None
                    yield _record(None, dim, block, row[part][i : i + 1], name[part][i : i + 1], x[part][i : i + 1], ask=True, least=least)
            block += 1

    for batch in batches:
        if not batch.num_rows:
            continue
        row, name = batch.column("row").to_numpy(zero_copy_only=False), _long(batch.column("id"))
        ask = batch.column("ask").to_numpy(zero_copy_only=False)
        for size, at, x in _rows(batch):
            if held and size != dim:
                yield from closed(True)
            dim = size
            held.append((row[at], name[at], ask[at], x))
            yield from closed(False)
    if held:
        yield from closed(True)


def _record(shard: int | None, dim: int, block: int, row: np.ndarray, name: np.ndarray, x: np.ndarray, ask: bool = False, least: int | None = None) -> pa.RecordBatch:
    longs = pa.list_(pa.int64())
    return pa.RecordBatch.from_pydict(
        {
            "ask": pa.array([ask]),
            "shard": pa.array([shard], pa.int32()),
            "dim": pa.array([dim], pa.int32()),
            "block": pa.array([block], pa.int32()),
            "rows": pa.array([row], longs),
            "ids": pa.array([name], longs),
            "x": pa.array([x.ravel()], longs),
            "least": pa.array([least], pa.int64()),
        }
    )


class _Shard:
    """The blocks of one shard and one length: forward index, ids, and the bounds of each term."""

    def __init__(self, dim: int, blocks: list[tuple]) -> None:
        self.starts = np.cumsum([0, *(len(row) for row, _, _ in blocks)])
        self.row, self.name = (np.concatenate([b[i] for b in blocks]) for i in (0, 1))
        self.x = np.concatenate([x.reshape(len(row), dim) for row, _, x in blocks])
        if dim * (float(np.abs(self.x).max(initial=0)) + 1) ** 2 < 2.0**52:
            self.x = self.x.astype(np.float64)
        highs = np.stack([self.x[a:b].max(axis=0) for a, b in zip(self.starts, self.starts[1:])]).astype(np.float64)
        lows = np.stack([self.x[a:b].min(axis=0) for a, b in zip(self.starts, self.starts[1:])]).astype(np.float64)
        self.terms = np.hstack([highs, lows]).T

    def best(self, query: np.ndarray, own: int, least: int | None, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows, ids and scores of the ``k`` best rows but ``own`` that reach ``least``."""
        q = query.astype(np.float64)
        bounds = np.concatenate([np.maximum(q, 0), np.minimum(q, 0)]) @ self.terms
        # Sums of large numbers are rounded; the bound must not be too small for that.
        bounds += np.abs(bounds) * 1e-9 + 1
        order = np.argsort(-bounds, kind="stable")
        floor = -_LONG - 1 if least is None else least
        places, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        at, step = 0, 1
        while at < len(order) and bounds[order[at]] >= floor:
            some = np.concatenate([np.arange(self.starts[b], self.starts[b + 1]) for b in order[at : at + step] if bounds[b] >= floor])
            got = _products(self.x[some], query)
            good = (got >= floor) & (self.row[some] != own)
            places, scores = np.concatenate([places, some[good]]), np.concatenate([scores, got[good]])
            if len(scores) >= k:
                keep = np.lexsort((self.name[places], ~scores))[:k] if len(scores) > k else slice(None)
                places, scores = places[keep], scores[keep]
                floor = max(floor, int(scores.min()))
            at, step = at + step, min(2 * step, STEP)
        return self.row[places], self.name[places], scores


def search(vectors: DataFrame, asked: Column, *, k: int = 10, vector_col: str = "embedding", id_col: str = "vec_id", scale: int = SCALE) -> DataFrame:
    """For each row where ``asked`` holds, ``query_id, rank, vec_id, score`` of the ``k`` best of all other rows."""
    blocks, shards = indexed(vectors, asked, k=k, vector_col=vector_col, id_col=id_col, scale=scale)
    visits = blocks.where("ask").withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(max(0, shards - 1)))))
    columns = blocks.columns
    met = blocks.where("not ask").union(visits.select(*columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, raw, ready = None, {}, {}
        for batch in batches:
            out = []
            rows, ids, x = (batch.column(c) for c in ("rows", "ids", "x"))
            for i, (shard, dim, ask, least) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("shard", "dim", "ask", "least")))):
                if shard != now:
                    now, raw, ready = shard, {}, {}
                own = (rows[i].values.to_numpy(), ids[i].values.to_numpy(), x[i].values.to_numpy() if dim else np.zeros(0, np.int64))
                if not ask:
                    raw.setdefault(dim, []).append(own)
                elif dim in ready or dim in raw:
                    if dim in raw:
                        ready[dim] = _Shard(dim, raw.pop(dim))
                    row, name, score = ready[dim].best(own[2], int(own[0][0]), least, k)
                    out.append((np.full(len(row), own[0][0]), np.full(len(row), own[1][0]), row, name, score))
            if out:
                query, asker, row, name, score = (np.concatenate(c) for c in zip(*out))
                yield pa.RecordBatch.from_pydict({"query_row": pa.array(query), "query_id": pa.array(asker), "vec_row": pa.array(row), "vec_id": _ids(name), "score": pa.array(score)})

    ordered = met.repartition(max(1, shards), "shard").sortWithinPartitions("shard", "ask", "dim", "block")
    found = ordered.mapInArrow(run, _FOUND)
    first = Window.partitionBy("query_row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "vec_row")
    return found.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
