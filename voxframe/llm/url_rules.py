"""URL filters as a sort-merge range join with nested rules.

A host becomes a canonical key: its labels in reverse, each with a dot behind it (``www.example.com`` is
``com.example.www.``). A rule fits its host and all subdomains, so it covers the keys from its own key up to the key
with the last dot replaced by a slash, the next character. Such intervals nest or are apart. URLs are dealt out by
ranges of (key, path, id), rules to every range they reach into; then each range is swept once in order with a stack of
the rules that cover the current key. Each entry of the stack holds the path beginnings of one rule host; the longest
rule (host and path together, then the host) that fits decides.

Ranges are cut by URL, path and id, so a host with very many pages falls into several ranges.

Defined results: a null URL or one without ``://`` has an empty host and path and, as no rule fits, the default verdict;
rules with an empty host fit nothing; of equal rules with different verdicts ``block`` wins; repeated rows stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxframe.session import materialize

ALLOW, BLOCK = "allow", "block"


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty for null and without ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(lower, F.lit("")), F.coalesce(path, F.lit(""))


def host_key(host: Column) -> Column:
    """Labels in reverse, each with a dot behind it; empty for an empty host."""
    return F.when(host == "", "").otherwise(F.concat(F.concat_ws(".", F.reverse(F.split(host, r"\."))), F.lit(".")))


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one range after the other, in order of the key; rules come before the URLs of their key."""
    part: int | None = None
    stack: list[tuple[str, int, dict[str, tuple[str, str]], set[int]]] = []
    for batch in batches:
        out: list[tuple] = []
        for own, key, rank, path, id_value, host, rule, verdict in zip(*(batch.column(c).to_pylist() for c in ("part", "key", "rank", "path", "id", "host", "rule", "verdict"))):
            if own != part:
                part, stack = own, []
            while stack and not key.startswith(stack[-1][0]):
                stack.pop()
            if rank == 0:
                if not stack or stack[-1][0] != key:
                    stack.append((key, len(host), {}, set()))
                if stack[-1][2].get(path, ("", ""))[1] != BLOCK:
                    stack[-1][2][path] = (rule, verdict)
                stack[-1][3].add(len(path))
                continue
            best = None
            for _, size, paths, lengths in stack:
                for n in lengths:
                    if n <= len(path) and (best is None or size + n >= best[0]) and (found := paths.get(path[:n])):
                        best = (size + n, found)
            out.append((id_value, host, path, best[1][0] if best else None, best[1][1] if best else None))
        columns = list(zip(*out)) or [()] * 5
        kinds = [batch.schema.field("id").type, *[pa.string()] * 4]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["id", "host", "path", "rule", "verdict"])


def judged(pages: DataFrame, rules: DataFrame, *, url_col: str = "url", id_col: str = "page_id", default: str = ALLOW, ranges: int | None = None) -> DataFrame:
    """One row for each page: the id, ``host``, ``path``, ``rule`` (null if none fits) and ``verdict``.

    ``rules``: host, path, verdict. ``ranges``: parts to sweep, else the session's shuffle partitions.
    """
    spark = pages.sparkSession
    count = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    host, path = url_parts(F.col(url_col))
    keyed = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    keyed = keyed.select(host_key(F.col("host")).alias("key"), "path", "id", "host")
    urls = materialize(keyed.repartitionByRange(count, "key", "path", F.xxhash64(F.col("id").cast("string"))).withColumn("part", F.spark_partition_id()))
    # First and last key of each range: as many rows as there are ranges.
    bounds = urls.groupBy("part").agg(F.min("key").alias("first"), F.max("key").alias("last")).orderBy("part").collect()
    rule = rules.select(F.lower("host").alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict").where("host is not null and host <> ''")
    rule = rule.select(host_key(F.col("host")).alias("key"), "path", "host", "verdict")
    if not bounds:
        reached = rule.where("false").withColumn("part", F.lit(0))
    else:
        end = F.concat(F.expr("substring(key, 1, length(key) - 1)"), F.lit("/"))
        before = F.size(F.filter(F.array(*[F.lit(b["last"]) for b in bounds]), lambda x: x < F.col("key")))
        within = F.size(F.filter(F.array(*[F.lit(b["first"]) for b in bounds]), lambda x: x < end))
        parts = F.array(*[F.lit(b["part"]) for b in bounds])
        reached = rule.withColumn("part", F.explode(F.when(before < within, F.slice(parts, before + 1, within - before)).otherwise(F.array().cast("array<int>"))))
    kind = urls.schema["id"].dataType.simpleString()
    events = urls.select("part", "key", F.lit(1).alias("rank"), "path", "id", "host", F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"))
    events = events.union(reached.select("part", "key", F.lit(0), "path", F.lit(None).cast(kind), "host", F.concat("host", "path"), "verdict"))
    swept = events.repartition(count, "part").sortWithinPartitions("part", "key", "rank").mapInArrow(_sweep, f"id {kind}, host string, path string, rule string, verdict string")
    return swept.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))
