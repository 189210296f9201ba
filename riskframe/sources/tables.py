"""Table sources and sinks: parquet / CSV reads with an
explicit schema, overwrite and append writes, per-case outputs and "newest
file" lookup. All writes go through the DataFrame writer, so a lost
executor only re-runs its task and a job either commits or not."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


# A1 ------------------------------------------------------------------------
def read_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None,
               fmt: str = "parquet", header: bool = True) -> DataFrame:
    """Parquet (default) or header CSV. CSV needs a schema in production
    (no inference pass over the data); a blank CSV cell reads as null."""
    r = spark.read
    if schema is not None:
        r = r.schema(schema)
    if fmt == "csv":
        return r.option("header", header).option("mode", "PERMISSIVE").csv(path)
    return r.format(fmt).load(path)


# A3 ------------------------------------------------------------------------
def binarize_label(df: DataFrame, column: str, positive, out: str | None = None) -> DataFrame:
    """1 where ``column`` equals the positive class, else 0 (null stays null)."""
    return df.withColumn(out or column, (F.col(column) == F.lit(positive)).cast("int"))


# A4 ------------------------------------------------------------------------
def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                partition_by: Sequence[str] = ()) -> None:
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.format(fmt).save(path)


# A5 ------------------------------------------------------------------------
def append_log(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Append rows to a log table (each append is new files; readers see
    whole appends only). Header handling is the format's: CSV part files
    carry their own header."""
    write_table(df, path, fmt, mode="append")


# A6 / A8 -------------------------------------------------------------------
def write_case_records(df: DataFrame, path: str, per_case: bool = False) -> None:
    """Prediction records as one appended table; ``per_case`` partitions by
    Case_ID (one folder per case — small files, off by default)."""
    write_table(df, path, "csv" if per_case else "parquet", mode="append",
                partition_by=["Case_ID"] if per_case else ())


def write_reports(df: DataFrame, path: str, text_col: str = "report",
                  per_case: bool = False) -> None:
    if per_case:
        df.select("Case_ID", text_col).write.mode("append").partitionBy("Case_ID").text(path)
    else:
        df.select(text_col).write.mode("append").text(path)


# A7 ------------------------------------------------------------------------
def with_file_times(spark: SparkSession, path: str, fmt: str = "parquet",
                    schema: T.StructType | str | None = None) -> DataFrame:
    """Rows with their source file path and modification time (hidden
    ``_metadata`` column)."""
    df = read_table(spark, path, schema, fmt)
    return df.select("*", F.col("_metadata.file_path").alias("file_path"),
                     F.col("_metadata.file_modification_time").alias("file_mtime"))


def latest_file_rows(spark: SparkSession, path: str, fmt: str = "parquet",
                     schema: T.StructType | str | None = None) -> DataFrame:
    """Rows of the newest file (max mtime, tie → largest path): the
    newest-file hand-over, but as an aggregate + semi-join."""
    d = with_file_times(spark, path, fmt, schema)
    newest = d.groupBy().agg(F.max_by("file_path", F.struct("file_mtime", "file_path"))
                             .alias("file_path"))
    return d.join(newest, "file_path", "left_semi").drop("file_mtime")
