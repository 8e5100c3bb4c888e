"""Joins, de-duplication and top-k that hold up when one key owns a large share of the rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A side is broadcast only if Spark's own size estimate stays below this.
BROADCAST_BYTES = 32 * 1024 * 1024
SALTS = 16


def plan_bytes(df: DataFrame) -> int | None:
    """Size Spark expects of ``df``, or None where the plan cannot be asked."""
    try:
        return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    except Exception:
        return None


def is_small(df: DataFrame, limit: int = BROADCAST_BYTES) -> bool:
    size = plan_bytes(df)
    return size is not None and size <= limit


def salt_of(df: DataFrame, salts: int) -> Column:
    """A number per row, the same on every retry of a task."""
    plain = [f.name for f in df.schema.fields if not _has_map(f.dataType)]
    return F.pmod(F.xxhash64(*plain), F.lit(salts)).cast("int")


def _has_map(kind: T.DataType) -> bool:
    if isinstance(kind, (T.MapType, T.VariantType)):
        return True
    if isinstance(kind, T.ArrayType):
        return _has_map(kind.elementType)
    if isinstance(kind, T.StructType):
        return any(_has_map(f.dataType) for f in kind.fields)
    return False


def attach(
    rows: DataFrame,
    lookup: DataFrame,
    keys: Sequence[str],
    how: str = "left",
    null_safe: bool = False,
    derived: bool = False,
    limit: int = BROADCAST_BYTES,
) -> DataFrame:
    """Join ``rows`` with a ``lookup`` that has few rows per key.

    A lookup whose size estimate is at most ``limit`` bytes is broadcast. Any other join is left to adaptive
    execution, which knows the real sizes: it broadcasts what proves small and splits the partitions of a hot
    key. ``derived`` skips the estimate for lookups made from the rows themselves, whose plan says little.
    """
    keys = list(keys)
    right = lookup.select(*[F.col(c).alias(f"__{c}" if c in keys else c) for c in lookup.columns])
    if not derived and is_small(right, limit):
        right = F.broadcast(right)
    same = [rows[k].eqNullSafe(right[f"__{k}"]) if null_safe else rows[k] == right[f"__{k}"] for k in keys]
    return rows.join(right, reduce(lambda a, b: a & b, same), how).drop(*[f"__{k}" for k in keys])


def unnest(df: DataFrame, array: Column, name: str, *keep: str | Column, position: str | None = None) -> DataFrame:
    """One row per array element.

    The outer form stops Spark from adding a size filter below, which would compute the array twice.
    """
    if position:
        out = df.select(*keep, F.posexplode_outer(array).alias(position, name))
        return out.where(F.col(position).isNotNull())
    return df.select(*keep, F.explode_outer(array).alias(name)).where(F.col(name).isNotNull())


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, rank: str | None = None) -> DataFrame:
    """The first ``n`` rows of every group.

    Spark drops all but ``n`` rows per group before the shuffle. It does so only up to its group-limit
    threshold, so a larger ``n`` is cut per salt bucket first.
    """
    name = rank or "__rank"
    if n > 1000:
        part = Window.partitionBy(*keys, "__salt").orderBy(*order)
        df = (
            df.withColumn("__salt", salt_of(df, SALTS))
            .withColumn("__part", F.row_number().over(part))
            .where(F.col("__part") <= n)
            .drop("__salt", "__part")
        )
    window = Window.partitionBy(*keys).orderBy(*order)
    out = df.withColumn(name, F.row_number().over(window)).where(F.col(name) <= n)
    return out if rank else out.drop(name)


@dataclass(frozen=True)
class ListRule:
    """A short list kept per group: the ``limit`` best of the values that rows bring in arrays.

    Values count by the rows that hold them, or with ``points`` by the largest points of such a row.
    """

    values: Column
    limit: int
    points: Column | None = None


def top_lists(df: DataFrame, keys: Sequence[str], row_id: str, rules: Mapping[str, ListRule]) -> DataFrame:
    """One row per group with one array per rule, best value first.

    All lists come from one unpivot to (key, kind, value), whose counts combine before the shuffle; the rows
    beyond the limits go before the second one. Ties go to the value met in the smallest row id, then to the
    smaller value. Null and empty values count for nothing.
    """
    def entries(name: str, rule: ListRule) -> Column:
        points = F.lit(1.0) if rule.points is None else F.coalesce(rule.points, F.lit(0.0)).cast("double")
        told = F.filter(F.coalesce(rule.values, F.array().cast("array<string>")), lambda v: v.isNotNull() & (v != ""))
        return F.transform(told, lambda v: F.struct(F.lit(name).alias("kind"), v.alias("value"), F.lit(rule.points is None).alias("counted"), points.alias("points")))

    each = unnest(df, F.concat(*[entries(n, r) for n, r in rules.items()]), "__e", *keys, F.col(row_id).alias("__id")).select(*keys, "__id", "__e.*")
    summed = each.groupBy(*keys, "kind", "value").agg(
        F.any_value("counted").alias("counted"), F.sum("points").alias("total"), F.max("points").alias("best"), F.min(F.struct((-F.col("points")).alias("p"), "__id")).alias("met")
    )
    summed = summed.withColumn("score", F.when(F.col("counted"), F.col("total")).otherwise(F.col("best")))
    ranked = top_per_group(summed, [*keys, "kind"], [F.col("score").desc(), F.col("met.__id"), F.col("value")], max(r.limit for r in rules.values()), "__rank")

    def chosen(name: str, rule: ListRule) -> Column:
        own = (F.col("kind") == name) & (F.col("__rank") <= rule.limit)
        return F.transform(F.array_sort(F.collect_list(F.when(own, F.struct("__rank", "value")))), lambda s: s["value"]).alias(name)

    return ranked.groupBy(*keys).agg(*[chosen(n, r) for n, r in rules.items()])


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key: the first in the given order."""
    return top_per_group(df, keys, order, 1)


def keep_last(df: DataFrame, keys: Sequence[str], sequence: str) -> DataFrame:
    """One row per key: the one that came last."""
    return top_per_group(df, keys, [F.col(sequence).desc_nulls_last()], 1)


def merge_keep_last(existing: DataFrame, new: DataFrame, keys: Sequence[str], tie_break: Sequence[str] = ()) -> DataFrame:
    """Union in which new rows replace old rows with the same key."""
    both = existing.withColumn("__generation", F.lit(0)).unionByName(
        new.withColumn("__generation", F.lit(1)), allowMissingColumns=True
    )
    order = [F.col("__generation").desc(), *[F.col(c).desc_nulls_last() for c in tie_break]]
    return top_per_group(both, keys, order, 1).drop("__generation")


def flag_duplicates(df: DataFrame, keys: Sequence[str], text: str, flag: str = "spam_like") -> DataFrame:
    """Mark every row whose key and text occur more than once.

    Counting combines before the shuffle and only a digest of the text travels.
    """
    marked = df.withColumn("__digest", F.md5(F.coalesce(F.col(text), F.lit("\u0000"))))
    repeated = (
        marked.groupBy(*keys, "__digest").agg(F.count("*").alias("__n")).where(F.col("__n") > 1)
    )
    joined = attach(marked, repeated, [*keys, "__digest"], null_safe=True, derived=True)
    return joined.withColumn(flag, F.col("__n").isNotNull()).drop("__digest", "__n")


def share_of_group(counts: DataFrame, value: str, keys: Sequence[str], name: str, digits: int | None = 4) -> DataFrame:
    """Share of each row in the total of its group; ``counts`` is already aggregated."""
    total = counts.groupBy(*keys).agg(F.sum(value).alias("__total"))
    out = attach(counts, total, keys, null_safe=True, derived=True)
    share = F.col(value) / F.col("__total")
    return out.withColumn(name, share if digits is None else F.round(share, digits)).drop("__total")


def share_of_all(counts: DataFrame, value: str, name: str, digits: int | None = 4) -> DataFrame:
    """Share of each row in the grand total, which is one scalar subquery."""
    share = F.col(value) / counts.agg(F.sum(value)).scalar()
    return counts.withColumn(name, share if digits is None else F.round(share, digits))


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    """Union by name; columns a frame lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def jaccard(a: Column, b: Column) -> Column:
    """Overlap of two arrays of distinct values; two empty ones are the same."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)
