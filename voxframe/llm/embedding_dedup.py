"""Near copies of vectors: spherical k-means cells, and cosine products of blocks within a cell.

Vectors of one label whose cosine reaches ``min_cosine`` are linked, all of them. Unit vectors at that cosine are at
most ``d = sqrt(2 - 2 * min_cosine)`` apart. If two of them lie in different cells, one of both is within ``d / 2`` of
the plane that parts the cells, so every vector also visits the cells whose plane is that near, and each linked pair
meets where one of both is at home (in the smaller cell, if either visits the other's). The centres only decide how
much work there is, never which links are found. They are fitted on a bounded sample. Equal vectors are compared once
and counted; a cell of any size is compared in blocks of vectors.

Vectors are moved twice: to find equal ones, and to the cells they visit. Most visit several, so the visits are made in
rounds, each about one and a half times as large as the vectors, and the files of a round's shuffle go when it ends. Everything
else that moves are ids and digests (128 bits of label and vector).

Defined results: vectors that are null, empty, zero or hold null or non-finite components, and rows with a null label,
link with nothing: 0 links, their own id as component. Vectors of different lengths never link. Rows that repeat an id
count as vectors of their own. A null id takes the smallest id of its component. ``kept`` holds for rows whose id is
the component's (null equals null).
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxframe.llm import blocks
from voxframe.llm.components import components
from voxframe.session import materialize

MIN_COSINE = 0.98
#: Vectors that the centres are fitted on (about), rounds of fitting, and vectors of a label for each cell on average.
SAMPLE, ROUNDS, CELL = 8192, 8, 300
#: Cells at most, so that the centres stay small enough to send to every task.
MAX_CELLS = 4096
#: Products of vectors and centres, or of vectors, that are held at once.
PRODUCTS = 1 << 20
#: Components in a block of vectors at home in a cell, and in a block of guests.
LOCAL, GUESTS = 1 << 18, 1 << 22
#: Bytes of visits that a round makes at least, that a task packs at once, and that a task compares (about).
ROUND, PACKED, TASK = 1 << 25, 1 << 25, 1 << 25
#: Spark's setting that removes the files of a query's shuffles when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
KEYS = ["label", "dim", "cell", "lo", "hi"]
PACKS = "label string, dim int, cell int, lo int, hi int, cid binary, n binary, home binary, side binary, vector binary, more binary, cells binary"


@contextmanager
def _swept(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the queries that end in here are removed at once, not when the driver collects its garbage."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def _parts(vectors: np.ndarray, cells: int) -> Iterator[np.ndarray]:
    """Runs of vectors with at most ``PRODUCTS`` products with the centres (but one vector at least)."""
    rows = max(1, PRODUCTS // cells)
    return (vectors[at : at + rows] for at in range(0, len(vectors), rows))


def _visited(unit: np.ndarray, points: np.ndarray, reach: float) -> Iterator[list[int]]:
    """Cells of each unit vector: its home, then all whose plane to the home's centre is within ``reach``."""
    for part in _parts(unit, len(points)):
        near = part @ points.T
        home = np.argmax(near, axis=1)
        short = near[np.arange(len(home)), home][:, None] - near
        # Distances of unit centres from their products; the last term covers the rounding of small ones.
        width = np.sqrt(np.maximum(0.0, 2 - 2 * (points[home] @ points.T)))
        visits = short <= reach * width + 1e-7
        for h, row in zip(home.tolist(), visits):
            # The home comes first.
            yield [h, *[c for c in np.flatnonzero(row).tolist() if c != h]]


def _centres(sample: np.ndarray, cells: int) -> np.ndarray:
    """Unit centres of spherical k-means, from a fixed start."""
    pick = np.random.default_rng(7).permutation(len(sample))[:cells]
    centres = sample[pick].copy()
    for _ in range(ROUNDS):
        home = np.concatenate([np.argmax(part @ centres.T, axis=1) for part in _parts(sample, len(centres))])
        sums = np.zeros_like(centres)
        np.add.at(sums, home, sample)
        size = np.linalg.norm(sums, axis=1)
        centres[size > 0] = sums[size > 0] / size[size > 0, None]
    return np.unique(centres, axis=0)


def _unit(vectors: np.ndarray) -> np.ndarray:
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def _binary(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Runs of ``values`` (rows of it) that stop at ``ends`` as one binary value each."""
    flat = np.ascontiguousarray(values)
    width = flat.dtype.itemsize * math.prod(flat.shape[1:])
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(np.concatenate([[0], ends * width]).astype(np.int32)), pa.py_buffer(flat)])


def _values(column: pa.ChunkedArray, kind: str) -> np.ndarray:
    """What the binary values of a column hold, end to end."""
    some = []
    for chunk in column.chunks:
        _, ends, flat = chunk.buffers()
        ends = np.frombuffer(ends, np.int32)[chunk.offset : chunk.offset + len(chunk) + 1]
        some.append(np.frombuffer(flat or b"", np.uint8)[ends[0] : ends[-1]])
    return np.concatenate(some).view(kind)


def _placed(batches: Iterator[pa.RecordBatch], points: np.ndarray, reach: float, kind: str) -> Iterator[pa.RecordBatch]:
    """Adds the cells of each vector, its home first, and packs its components into a binary value."""
    dim = points.shape[1]
    for batch in batches:
        vectors = batch.column("vector")
        flat, starts = vectors.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False), vectors.value_lengths().to_numpy().cumsum() - vectors.value_lengths().to_numpy()
        lengths = vectors.value_lengths().to_numpy()
        cells = [[0]] * len(batch)
        usual = np.flatnonzero(lengths == dim)
        for at in range(0, len(usual), 2048):
            some = usual[at : at + 2048]
            unit = _unit(flat[starts[some][:, None] + np.arange(dim)].astype(np.float64))
            for i, own in zip(some.tolist(), _visited(unit, points, reach)):
                cells[i] = own
        out = {n: batch.column(n) for n in ("cid", "k1", "k2", "label")}
        out |= {"dim": pa.array(lengths, pa.int32()), "vector": _binary(flat, lengths.cumsum()), "n": batch.column("n"), "cells": pa.array(cells, pa.list_(pa.int32()))}
        yield pa.RecordBatch.from_pydict(out)


def _mixed(*parts: np.ndarray | int) -> np.ndarray:
    """A number of each row of the parts, the same in every task."""
    h = np.zeros(1, np.uint64)
    for k, part in enumerate(parts):
        h = h + np.asarray(part).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15 + 2 * k * 0x632BE59BD9B4E019 & (1 << 64) - 1)
    h = (h ^ h >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9)
    return h >> np.uint64(24)


def _units(cid: np.ndarray, at_home: np.ndarray, m: int, k: int) -> tuple[np.ndarray, ...]:
    """Which visits (by position) go to which units ``lo, hi`` of a cell with ``m`` blocks at home and ``k`` of guests, and on which side.

    Blocks at home meet each other in ``lo <= hi``; the first block of guests comes to ``lo = hi``, the others to a ``hi`` from ``m`` on.
    """
    out = []
    mix = _mixed(cid)
    local, guest = np.flatnonzero(at_home), np.flatnonzero(~at_home)
    own, row = (mix[local] % np.uint64(m)).astype(np.int64), (mix[guest] % np.uint64(k)).astype(np.int64)
    for j in range(m):
        out.append((local, np.minimum(own, j), np.maximum(own, j), (own > j).astype(np.int8)))
        out.append((guest, np.full(len(guest), j), np.where(row == 0, j, m + row - 1), np.ones(len(guest), np.int8)))
    out += [(local, own, np.full(len(own), m + q - 1), np.zeros(len(own), np.int8)) for q in range(1, k)]
    return tuple(np.concatenate(x) for x in zip(*out))


def _packs(table: pa.Table, large: dict, kind: str, turn: int, turns: int) -> Iterator[pa.RecordBatch]:
    """The visits of one round, a row for each unit that any of these vectors goes to."""
    dims = table.column("dim").to_numpy()
    for dim in np.unique(dims).tolist():
        rows = table if (dims == dim).all() else table.filter(pa.array(dims == dim))
        vectors = _values(rows.column("vector"), kind).reshape(-1, dim)
        names = rows.column("label").combine_chunks().dictionary_encode()
        code, words = names.indices.to_numpy(), names.dictionary.to_pylist()
        crc = np.array([zlib.crc32(w.encode()) for w in words], np.uint64)
        lists = rows.column("cells").combine_chunks()
        count, values = lists.value_lengths().to_numpy(), lists.flatten().to_numpy()
        first = count.cumsum() - count
        cid, n = rows.column("cid").to_numpy(), rows.column("n").to_numpy()
        row = np.repeat(np.arange(len(rows)), count)
        side = np.ones(len(values), np.int8)
        side[first] = 0
        lo = hi = np.zeros(len(values), np.int64)
        cell = values
        codes = {w: i for i, w in enumerate(words)}
        split = {codes[w] << 32 | c: mk for (w, d, c), mk in large.items() if d == dim and w in codes}
        key = code[row].astype(np.int64) << 32 | cell
        parted = np.isin(key, list(split)) if split else np.zeros(len(key), bool)
        if parted.any():
            more = []
            at_parted = np.flatnonzero(parted)
            for k in np.unique(key[at_parted]).tolist():
                some = at_parted[key[at_parted] == k]
                at, low, high, of = _units(cid[row[some]], side[some] == 0, *split[k])
                more.append((row[some][at], cell[some][at], low, high, of))
            row, cell, lo, hi, side = (np.concatenate(x) for x in zip((row[~parted], cell[~parted], lo[~parted], hi[~parted], side[~parted]), *more))
        if turns > 1:
            due = _mixed(crc[code[row]], cell, lo, hi, dim) % np.uint64(turns) == np.uint64(turn)
            row, cell, lo, hi, side = (x[due] for x in (row, cell, lo, hi, side))
        if not len(row):
            continue
        order = np.lexsort((hi, lo, cell, code[row]))
        row, cell, lo, hi, side = (x[order] for x in (row, cell, lo, hi, side))
        change = np.flatnonzero((np.diff(code[row]) != 0) | (np.diff(cell) != 0) | (np.diff(lo) != 0) | (np.diff(hi) != 0)) + 1
        starts, ends = np.concatenate([[0], change]), np.concatenate([change, [len(row)]])
        # Only for vectors of the left side it matters which other cells they visit.
        others = np.where(side == 0, count[row], 0)
        stop = others.cumsum()
        told = values[np.repeat(first[row] - (stop - others), others) + np.arange(others.sum())]
        out = {"label": pa.array([words[c] for c in code[row[starts]].tolist()], pa.string()), "dim": pa.array(np.full(len(starts), dim), pa.int32())}
        out |= {name: pa.array(x[starts], pa.int32()) for name, x in (("cell", cell), ("lo", lo), ("hi", hi))}
        out |= {"cid": _binary(cid[row], ends), "n": _binary(n[row], ends), "home": _binary(values[first][row], ends), "side": _binary(side, ends), "vector": _binary(vectors[row], ends)}
        out |= {"more": _binary(others.astype(np.int32), ends), "cells": _binary(told, stop[ends - 1])}
        yield pa.RecordBatch.from_pydict(out)


def _joined(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smallest row that each row, and each column, of a matrix of links reaches; every row and column has a link."""
    left = np.arange(len(hit))
    while True:
        right = np.where(hit, left[:, None], len(hit)).min(axis=0)
        low = np.minimum(left, np.where(hit, right[None], len(hit)).min(axis=1))
        low = low[low]
        if (low == left).all():
            return left, right
        left = low


def _least(size: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest position that each position reaches by the links ``a, b``."""
    label = np.arange(size)
    while True:
        low = label.copy()
        np.minimum.at(low, a, label[b])
        np.minimum.at(low, b, label[a])
        low = low[low]
        if (low == label).all():
            return label
        label = low


def _hits(near: np.ndarray, unit: np.ndarray, left: np.ndarray, right: np.ndarray, min_cosine: float, slack: float) -> np.ndarray:
    """Which pairs reach the cosine in double precision; only those near it in single precision are worked out again."""
    hit = near >= min_cosine + slack
    at, to = np.nonzero(np.abs(near - min_cosine) <= slack)
    for k in range(0, len(at), 1 << 15):
        i, j = at[k : k + (1 << 15)], to[k : k + (1 << 15)]
        hit[i, j] = np.einsum("ij,ij->i", unit[left[i]], unit[right[j]]) >= min_cosine
    return hit


def _linked(table: pa.Table, kind: str, min_cosine: float) -> pa.Table | None:
    """What the pairs of one unit add: rows ``a, more, b``."""
    dim, cell, lo, hi = (table.column(k)[0].as_py() for k in KEYS[1:])
    side = _values(table.column("side"), "<i1")
    left, guests = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    if not len(left):
        return None
    unit = _unit(_values(table.column("vector"), kind).reshape(-1, dim).astype(np.float64))
    single = unit.astype(np.float32)
    cid, n, home = _values(table.column("cid"), "<i8"), _values(table.column("n"), "<i8"), _values(table.column("home"), "<i4")
    others, told = _values(table.column("more"), "<i4"), _values(table.column("cells"), "<i4")
    teller = np.repeat(np.arange(len(side)), others)
    more = np.zeros(len(side))
    links: list[tuple[np.ndarray, np.ndarray]] = []
    width, slack = max(1, 2 * PRODUCTS // len(left)), (dim + 8) * 2.0**-23
    for own, all_right in ((True, left if lo == hi else left[:0]), (False, guests)):
        for at in range(0, len(all_right), width):
            right = all_right[at : at + width]
            near = single[left] @ single[right].T
            if own:
                near[at + np.arange(len(right)), np.arange(len(right))] = -2
            # Most vectors are near no other: the rest of the work is for those that are.
            rows = np.flatnonzero(near.max(axis=1) >= min_cosine - slack)
            if not len(rows):
                continue
            near = near[rows]
            columns = np.flatnonzero(near.max(axis=0) >= min_cosine - slack)
            l, r = left[rows], right[columns]
            hit = _hits(near[:, columns], unit, l, r, min_cosine, slack)
            # A pair of which either visits the other's home is counted in the smaller cell only.
            for b in np.unique(home[r][home[r] < cell]).tolist():
                visit = np.zeros(len(side), bool)
                visit[teller[told == b]] = True
                hit[np.ix_(visit[l], home[r] == b)] = False
            rows, columns = np.flatnonzero(hit.any(axis=1)), np.flatnonzero(hit.any(axis=0))
            if not len(rows):
                continue
            hit, l, r = hit[np.ix_(rows, columns)], l[rows], r[columns]
            more[l] += hit.astype(np.float64) @ n[r]
            if not own:
                more[r] += n[l] @ hit.astype(np.float64)
            to_l, to_r = _joined(hit)
            links += [(l, l[to_l]), (r, l[to_r])]
    if not links:
        return None
    a, b = (np.concatenate(x) for x in zip(*links))
    root, some = _least(len(side), a, b), np.unique(a)
    return pa.table({"a": cid[some], "more": more[some].astype(np.int64), "b": cid[root[some]]})


def _fitted(classes: DataFrame, firsts: DataFrame) -> np.ndarray | None:
    """Centres for vectors of the most usual length, or None if there are no vectors."""
    by_label = firsts.groupBy("dim", "label").agg(F.count("*").alias("n")).groupBy("dim")
    shape = by_label.agg(F.sum("n").alias("n"), (F.sum(F.col("n").cast("double") * F.col("n")) / F.sum("n")).alias("of_label")).orderBy(F.desc("n"), "dim").first()
    if shape is None:
        return None
    dim, total = shape["dim"], shape["n"]
    drawn = classes.where((F.size("vector") == dim) & (F.pmod("k1", F.lit(1 << 20)) < int(math.ceil((1 << 20) * min(1.0, SAMPLE / total)))))
    found = drawn.select("vector").distinct().limit(2 * SAMPLE).collect()
    sample = _unit(np.array([r["vector"] for r in found], np.float64).reshape(-1, dim)) if found else np.eye(1, dim)
    return _centres(sample, max(1, min(MAX_CELLS, int(shape["of_label"] / CELL), len(sample))))


def _links(placed: DataFrame, kind: str, min_cosine: float) -> DataFrame:
    """Work on the placed classes: rows ``a, more, b``.

    ``more``: vectors linked to ``a`` that this comparison found; ``b``: a class of the same component (or ``a``).
    """
    spark, c = placed.sparkSession, F.col
    homes = F.posexplode("cells").alias("_at", "cell")
    sizes = placed.select("label", "dim", homes).groupBy("label", "dim", "cell").agg(F.count(F.when(c("_at") == 0, 1)).alias("h"), F.count(F.when(c("_at") > 0, 1)).alias("g"))
    of = lambda rows, most: F.greatest(F.lit(1), F.ceil(c(rows) / F.greatest(F.lit(64), F.floor(F.lit(most) / c("dim"))))).cast("int")
    sizes = materialize(sizes.withColumns({"m": of("h", LOCAL), "k": of("g", GUESTS)}))
    row = c("dim") * np.dtype(kind).itemsize + 32
    sums = sizes.agg(F.sum(c("h") * row).alias("once"), F.sum((c("h") * (c("m") + c("k") - 1) + c("g") * c("m")) * row).alias("dealt")).first()
    turns = math.ceil(sums["dealt"] / max(ROUND, 1.5 * sums["once"]))
    held = int(PACKED / max(1.0, sums["dealt"] / turns / sums["once"]))
    # A row for some 16 MB of visits, or 1 MB at home, in one cell.
    split = {(r["label"], r["dim"], r["cell"]): (r["m"], r["k"]) for r in sizes.where("m > 1 or k > 1").collect()}
    large = spark.sparkContext.broadcast(split)

    def pack(turn: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            some: list[pa.RecordBatch] = []
            for batch in batches:
                some.append(batch)
                if sum(x.nbytes for x in some) >= held:
                    yield from _packs(pa.Table.from_batches(some), large.value, kind, turn, turns)
                    some = []
            if some:
                yield from _packs(pa.Table.from_batches(some), large.value, kind, turn, turns)

        return run

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in blocks.groups(batches, KEYS):
            out = _linked(table, kind, min_cosine)
            if out is not None:
                yield from out.to_batches()

    tasks = math.ceil(sums["dealt"] / turns / TASK)
    number = [tasks] if tasks > int(spark.conf.get("spark.sql.shuffle.partitions")) else []
    found = []
    for turn in range(turns):
        packs = placed.select("cid", "label", "dim", "vector", "n", "cells").mapInArrow(pack(turn), PACKS)
        found.append(materialize(packs.repartition(*number, *KEYS).sortWithinPartitions(*KEYS).mapInArrow(compare, "a long, more long, b long")))
    return reduce(DataFrame.union, found)


def grouped(vectors: DataFrame, *, vector_col: str = "embedding", label_col: str = "label", id_col: str = "vec_id", min_cosine: float = MIN_COSINE) -> DataFrame:
    """One row for each vector: the id, ``n_links``, ``component_id`` and ``kept``. ``vectors`` is read three times."""
    spark = vectors.sparkSession
    single = vectors.schema[vector_col].dataType == T.ArrayType(T.FloatType(), vectors.schema[vector_col].dataType.containsNull)
    kind = "<f4" if single else "<f8"
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<float>" if single else "array<double>").alias("vector"))
    least, most, infinite = F.array_min("vector"), F.array_max("vector"), F.lit(float("inf")).cast("float" if single else "double")
    # What array_contains says is null if there is a null; NaN is the greatest number.
    fine = F.col("label").isNotNull() & ~F.array_contains("vector", infinite) & ~F.isnan(most) & (least > -infinite) & ((most != 0) | (least != 0))
    rows = rows.withColumn("fine", F.coalesce(fine, F.lit(False)))
    digest = [F.when(F.col("fine"), F.xxhash64(F.lit(seed), "label", "vector")).alias(f"k{seed}") for seed in (1, 2)]
    keys = ["k1", "k2"]
    with _swept(spark):
        held = materialize(rows.select("id", *digest, F.when(F.col("fine"), F.size("vector")).alias("dim"), F.when(F.col("fine"), F.col("label")).alias("label")))
        firsts = materialize(held.where("k1 is not null").groupBy(*keys, "dim", "label").agg(F.min("id").alias("first")))
        classes = rows.where("fine").select(*digest, "label", "vector")
        centres = _fitted(classes, firsts)
        if centres is None:
            named = spark.createDataFrame([], held.select(*keys, F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id")).schema)
        else:
            reach = math.sqrt(max(0.0, 2 - 2 * min_cosine)) / 2 + 1e-9
            shared = spark.sparkContext.broadcast(centres)
            classes = classes.groupBy(*keys, "label", "vector").agg(F.count("*").alias("n")).withColumn("cid", F.monotonically_increasing_id())
            place = lambda batches: _placed(batches, shared.value, reach, kind)
            placed = materialize(classes.mapInArrow(place, "cid long, k1 long, k2 long, label string, dim int, vector binary, n long, cells array<int>"))
            found = _links(placed, kind, min_cosine)
            more = found.groupBy("a").agg(F.sum("more").alias("more"))
            roots = components(found.select("a", "b"))
            rooted = placed.select("cid", "n", *keys).join(firsts, keys).join(roots, F.col("cid") == roots["node"], "left").select("cid", "n", *keys, "first", F.coalesce("root", "cid").alias("root"))
            least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
            links = (F.col("n") - 1 + F.coalesce("more", F.lit(0))).alias("n_links")
            named = materialize(rooted.join(least, "root").join(more, rooted["cid"] == more["a"], "left").select(*keys, links, "component_id"))
    usual = held.where("k1 is not null").join(named, keys).select("id", "n_links", "component_id")
    odd = held.where("k1 is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return usual.union(odd).select(F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
