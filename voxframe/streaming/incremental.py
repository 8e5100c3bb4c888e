"""Streams of comments: keep-last upsert, skipping known ids, and weekly counts."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from voxframe.operators.relational import top_per_group, union_all
from voxframe.session import shared_folder

KEYS = ("video_id", "comment_id")


def read_landing(spark: SparkSession, path: str, schema, source: str = "parquet", files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.format(source).schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


MANIFEST = "seq long, folder string, up_to long"


def append_versions(stream: DataFrame, target: str, checkpoint: str, mode: str = "append", after: int = -1) -> StreamingQuery:
    """Append every batch to the version table, stamped with its number.

    Batches land in their own folder and overwrite it on a retry, so a replayed batch adds nothing. A stream with a
    checkpoint of its own goes on behind batch ``after`` (:func:`last_batch`) of those before it.
    """
    def land(batch: DataFrame, batch_id: int) -> None:
        number = after + 1 + batch_id
        batch.withColumn("ingest_seq", F.lit(number)).write.mode("overwrite").parquet(f"{target.rstrip('/')}/batch_id={number}")

    return stream.writeStream.outputMode(mode).foreachBatch(land).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def manifest(spark: SparkSession, target: str) -> tuple[int, str | None, int]:
    """The last entry of a table's manifest: its number, the compacted folder, and the last batch that it holds."""
    try:
        rows = spark.read.schema(MANIFEST).parquet(f"{target.rstrip('/')}-manifest")
    except AnalysisException:
        return 0, None, -1
    last = rows.orderBy(F.col("seq").desc()).first()
    return (last["seq"], last["folder"], last["up_to"]) if last else (0, None, -1)


def _batches(spark: SparkSession, target: str) -> DataFrame | None:
    try:
        return spark.read.option("basePath", target).parquet(f"{target.rstrip('/')}/batch_id=*")
    except AnalysisException:
        return None


def last_batch(spark: SparkSession, target: str) -> int:
    """Number of the last batch of a version table, -1 if there is none."""
    found = _batches(spark, target)
    number = found.agg(F.max("batch_id")).first()[0] if found is not None else None
    return max(manifest(spark, target)[2], -1 if number is None else number)


def current_rows(spark: SparkSession, target: str, tie_break: str, keys: tuple[str, ...] = KEYS, up_to: int | None = None) -> DataFrame:
    """Latest version of every key: from the compacted folder that the manifest names and the batches since then."""
    _, folder, held = manifest(spark, target)
    parts = [spark.read.parquet(folder)] if folder else []
    batches = _batches(spark, target)
    if batches is not None:
        fresh = batches.where(F.col("batch_id") > held)
        parts.append((fresh if up_to is None else fresh.where(F.col("batch_id") <= up_to)).drop("batch_id"))
    order = [F.col("ingest_seq").desc(), F.col(tie_break).desc()]
    return top_per_group(union_all(parts), keys, order, 1)


def compacted(spark: SparkSession, target: str, tie_break: str, keys: tuple[str, ...] = KEYS) -> str:
    """Write the latest versions to a folder of their own and let the manifest name it; returns the folder.

    The entry is one file that appears whole or not at all, so a reader sees either the old state or the new one.
    Batches that land meanwhile have larger numbers than those compacted and are read beside the folder.
    """
    seq, up_to = manifest(spark, target)[0] + 1, last_batch(spark, target)
    folder = f"{target.rstrip('/')}-{uuid.uuid4().hex}"
    current_rows(spark, target, tie_break, keys, up_to).write.parquet(folder)
    entry = spark.createDataFrame([(seq, folder, up_to)], MANIFEST)
    entry.coalesce(1).write.mode("append").parquet(f"{target.rstrip('/')}-manifest")
    return folder


def replaced(spark: SparkSession, target: str) -> list[str]:
    """Folders that no reader of the manifest's last entry needs: batches it holds and folders compacted before."""
    seq, folder, up_to = manifest(spark, target)
    if folder is None:
        return []
    entries = spark.read.schema(MANIFEST).parquet(f"{target.rstrip('/')}-manifest").where((F.col("seq") < seq) & (F.col("folder") != folder))
    batches = _batches(spark, target)
    numbers = batches.where(F.col("batch_id") <= up_to).select("batch_id").distinct().collect() if batches is not None else []
    return sorted([r["folder"] for r in entries.collect()] + [f"{target.rstrip('/')}/batch_id={r['batch_id']}" for r in numbers])


def _timed(stream: DataFrame, time: str) -> DataFrame:
    """Watermarks need a time with a zone; plain times count as UTC."""
    return stream.withColumn(time, F.col(time).cast("timestamp"))


def new_comments(stream: DataFrame, time: str = "published_at", delay: str = "1 day", keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Each key once within the watermark."""
    return _timed(stream, time).withWatermark(time, delay).dropDuplicatesWithinWatermark(list(keys))


def weekly_counts(stream: DataFrame, time: str = "published_at", delay: str = "1 day") -> DataFrame:
    """Comments per week (Monday), product, region and label on a stream; the epoch was a Thursday."""
    week = F.window(time, "7 days", "7 days", "4 days")
    counts = _timed(stream, time).withWatermark(time, delay).groupBy(week, "product", "region", "sentiment_label").agg(F.count("*").alias("count"))
    return counts.select(F.date_format("window.start", "yyyy-MM-dd").alias("week_start"), "product", "region", "sentiment_label", "count")


def run_to_table(stream: DataFrame, mode: str, spark: SparkSession, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Run a stream over all available input into a table of the shared folder and read it back.

    ``update`` lands the rows that a batch changed as versions; state behind the watermark is dropped, and the last
    version of each of the ``keys`` is the result. ``append`` writes rows once they are final.
    """
    base = f"{shared_folder(spark).rstrip('/')}/{uuid.uuid4().hex}"
    if mode == "update":
        append_versions(stream, f"{base}/table", f"{base}/checkpoint", mode).awaitTermination()
        return current_rows(spark, f"{base}/table", keys[0], keys).drop("ingest_seq")
    writer = stream.writeStream.option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).outputMode(mode)
    writer.format("parquet").start(f"{base}/table").awaitTermination()
    return spark.read.parquet(f"{base}/table")
