"""Scans: stored pages, run tables with fallbacks, samples, and signatures of the source files."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxframe.operators.relational import top_per_group, union_all
from voxframe.schemas import THREAD_PAGE


def read_pages(spark: SparkSession, path: str, schema: str = THREAD_PAGE, one_per_file: bool = True) -> DataFrame:
    """Stored JSON pages with a fixed schema and the file each came from; else one page on each line."""
    pages = spark.read.schema(schema).option("multiLine", one_per_file).option("recursiveFileLookup", True).json(path)
    return pages.withColumn("source_file", F.col("_metadata.file_path"))


def read_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Parquet at ``path``; else CSV at the same place with ``.csv``; else an empty table."""
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        pass
    try:
        return spark.read.option("header", True).option("multiLine", True).option("escape", '"').schema(schema).csv(path.removesuffix(".parquet") + ".csv")
    except AnalysisException:
        return spark.createDataFrame([], schema)


def read_runs(spark: SparkSession, base: str, table: str) -> DataFrame:
    """One table of all runs from ``<base>/run_id=<run>/<table>``; filters on ``run_id`` prune folders."""
    return spark.read.option("basePath", base).option("mergeSchema", True).parquet(f"{base.rstrip('/')}/run_id=*/{table}")


def of_run(df: DataFrame, run_id: str) -> DataFrame:
    return df.where(F.col("run_id") == run_id)


def latest_runs(df: DataFrame, n: int) -> DataFrame:
    """Rows of the newest ``n`` runs by id."""
    runs = df.select("run_id").distinct().orderBy(F.col("run_id").desc()).limit(n)
    return df.join(runs, "run_id", "left_semi")


def sample_runs(df: DataFrame, runs: int, rows_per_run: int, key: str) -> DataFrame:
    """At most ``rows_per_run`` rows of each of the newest runs: the sampled view of a table."""
    return top_per_group(latest_runs(df, runs), ["run_id"], [F.col(key)], rows_per_run)


def catalogue(spark: SparkSession, tables: Mapping[str, str]) -> DataFrame:
    """``table, present, rows, files, bytes, columns`` of Parquet tables by name.

    Rows come from the footers of the files (no column is read); a table that cannot be found is not present.
    """
    parts = []
    for name, path in tables.items():
        try:
            df = spark.read.parquet(path)
        except AnalysisException:
            parts.append(spark.range(1).select(F.lit(name).alias("table"), F.lit(False).alias("present"), *[F.lit(0).cast("long").alias(n) for n in ("rows", "files", "bytes")], F.array().cast("array<string>").alias("columns")))
            continue
        per_file = df.groupBy(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size")).agg(F.count("*").alias("n"))
        total = per_file.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count("*").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))
        names = F.array(*[F.lit(c) for c in df.columns]) if df.columns else F.array().cast("array<string>")
        parts.append(total.select(F.lit(name).alias("table"), F.lit(True).alias("present"), "rows", "files", "bytes", names.alias("columns")))
    return union_all(parts)


def stored_files(spark: SparkSession, path: str, pattern: str = "*.json") -> DataFrame:
    """``files, bytes`` below a folder whose names fit; contents are not read."""
    try:
        found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    except AnalysisException:
        return spark.range(1).select(F.lit(0).cast("long").alias("files"), F.lit(0).cast("long").alias("bytes"))
    return found.agg(F.count("*").alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))


def dataset_signature(spark: SparkSession, paths: Mapping[str, str] | list[str]) -> str:
    """SHA-256 over path, size and change time of all files; differs as soon as any of them changes."""
    names = list(paths.values()) if isinstance(paths, Mapping) else list(paths)
    files = None
    for path in names:
        found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
        found = found.select("path", "length", F.unix_micros("modificationTime").alias("changed"))
        files = found if files is None else files.unionByName(found)
    # Digests of the lines fold together in any order, so no task ever holds all of them.
    line = F.concat_ws("|", "path", F.col("length").cast("string"), F.col("changed").cast("string"))
    folded = files.select(F.col("length"), F.xxhash64(line).alias("h"), F.xxhash64(F.lit(1), line).alias("g"))
    parts = (F.count("*"), F.sum("length"), F.bit_xor("h"), F.sum(F.pmod("g", F.lit(1 << 40))))
    return folded.agg(F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256).alias("d")).first()["d"]
