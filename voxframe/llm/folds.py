"""Which rows a model may learn from."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def remainder(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null for a null id."""
    return F.crc32(F.col(id_col).cast("string")) % folds


def held_out(id_col: str, folds: int) -> Column:
    """Rows that no model learns from: remainder 0. A null id is not held out."""
    return F.coalesce(remainder(id_col, folds) == 0, F.lit(False))


def may_learn(id_col: str, folds: int) -> Column:
    """Rows a model may learn from: remainder other than 0. A null id is never learnt from."""
    return F.coalesce(remainder(id_col, folds) != 0, F.lit(False))


def unit(id_col: str, seed: int) -> Column:
    """A number in [0, 1) from the id and a seed, the same in each run; a null id counts as a value."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(id_col).cast("string")), 11) / F.lit(float(1 << 53))
