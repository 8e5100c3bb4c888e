"""Comparison of the rows of a group block by block, so that no task ever holds a whole group."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a block; a task compares two blocks at a time.
BLOCK = 128


def dealt(rows: DataFrame, keys: list[str], id_col: str, block: int = BLOCK) -> DataFrame:
    """Every row once for each pair of blocks that it takes part in: adds ``_lo``, ``_hi`` and ``_own``.

    A group of n rows is dealt into ``ceil(n / block)`` blocks by a hash of the id. Groups of one row are left out.
    """
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("_n")).where("_n > 1")
    placed = rows.join(sizes, keys).withColumn("_m", F.ceil(F.col("_n") / F.lit(block)).cast("int"))
    placed = placed.withColumn("_own", F.pmod(F.xxhash64(F.lit(5), id_col), F.col("_m")).cast("int"))
    each = placed.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_m") - 1)))
    each = each.withColumn("_lo", F.least("_own", "_other")).withColumn("_hi", F.greatest("_own", "_other"))
    return each.drop("_n", "_m", "_other")


def compared(rows: DataFrame, keys: list[str], id_col: str, fn: Callable[[pa.Table, np.ndarray, np.ndarray], pa.Table | None], schema: str, block: int = BLOCK) -> DataFrame:
    """Call ``fn(table, left, right)`` for each pair of blocks: positions of the rows of either block.

    For a block with itself both are the same. What ``fn`` returns are the rows of the result.
    """
    each = dealt(rows, keys, id_col, block)
    order = [*keys, "_lo", "_hi"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, order):
            own, lo = table.column("_own").to_numpy(), table.column("_lo")[0].as_py()
            left, right = np.flatnonzero(own == lo), np.flatnonzero(own == table.column("_hi")[0].as_py())
            if len(left) and len(right):
                out = fn(table, left, right)
                if out is not None:
                    yield from out.to_batches()

    return each.repartition(*order).sortWithinPartitions(*order).mapInArrow(run, schema)


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of rows with equal keys, from batches that are sorted by them."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        change = np.zeros(batch.num_rows, bool)
        for k in keys:
            codes = batch.column(k).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
            change[1:] |= codes[1:] != codes[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for start, stop in zip(cuts, cuts[1:]):
            key = tuple(batch.column(k)[start].as_py() for k in keys)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(start, stop - start))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def roots(linked: np.ndarray) -> np.ndarray:
    """Smallest position reachable from each position of a symmetric link matrix."""
    n = len(linked)
    label = np.arange(n)
    while True:
        low = np.minimum(label, np.where(linked, label[None, :], n).min(axis=1, initial=n))
        low = low[low]
        if (low == label).all():
            return label
        label = low
