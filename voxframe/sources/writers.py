"""Sinks: run tables, CSV with nested columns as JSON, named exports, report rows and the run manifest."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NESTED = (T.ArrayType, T.MapType, T.StructType)


def write_table(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).parquet(path)


def write_run(tables: Mapping[str, DataFrame], base: str, run_id: str) -> None:
    """All tables of a run as ``<base>/run_id=<run>/<table>``."""
    for name, df in tables.items():
        write_table(df.drop("run_id"), f"{base.rstrip('/')}/run_id={run_id}/{name}")


def flat_cells(df: DataFrame, separator: str | None = None) -> DataFrame:
    """Nested columns as JSON text, or string arrays joined by ``separator``; times as plain text."""
    out = []
    for field in df.schema.fields:
        c = F.col(field.name)
        if separator is not None and isinstance(field.dataType, T.ArrayType) and isinstance(field.dataType.elementType, T.StringType):
            c = F.array_join(c, separator)
        elif isinstance(field.dataType, NESTED):
            c = F.to_json(c)
        elif isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        out.append(c.alias(field.name))
    return df.select(*out)


def write_export(tables: Mapping[str, DataFrame], base: str, separator: str = ", ") -> None:
    """One folder of CSV files per named sheet."""
    for name, df in tables.items():
        flat_cells(df, separator).write.mode("overwrite").option("header", True).option("escape", '"').csv(f"{base.rstrip('/')}/{name}")


def report_rows(slices: Mapping[str, tuple[DataFrame, str, str, int]]) -> DataFrame:
    """Sections of a report as (section, rank, label, value).

    Each slice is a frame, its label and value columns, and how many of its top rows to show.
    """
    from pyspark.sql import Window

    parts = []
    for section, (df, label, value, n) in slices.items():
        rows = df.select(F.col(label).cast("string").alias("label"), F.col(value).cast("double").alias("value"))
        top = rows.orderBy(F.col("value").desc_nulls_last(), "label").limit(n)
        rank = F.row_number().over(Window.orderBy(F.col("value").desc_nulls_last(), "label"))
        parts.append(top.select(F.lit(section).alias("section"), rank.alias("rank"), "label", "value"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def run_manifest(videos: DataFrame, comments: DataFrame, errors: DataFrame, run_id: str) -> DataFrame:
    """Counts of a run. The videos that failed may be many: ``failed_videos`` lists them as a table."""
    return videos.agg(F.count("*").alias("videos_collected")).select(
        F.lit(run_id).alias("run_id"),
        "videos_collected",
        comments.agg(F.count("*")).scalar().alias("comments_collected"),
        errors.agg(F.count("*")).scalar().alias("error_count"),
        failed_videos(errors).agg(F.count("*")).scalar().alias("failed_count"),
    )


def failed_videos(errors: DataFrame) -> DataFrame:
    """Each video that failed, once."""
    return errors.where(F.col("video_id").isNotNull()).select(F.col("video_id").cast("string").alias("video_id")).distinct()
