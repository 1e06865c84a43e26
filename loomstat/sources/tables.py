"""Sources and sinks: Parquet tables, JSON documents with defaults, JSON lines with pass-through, CSV exports."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .snapshots import Snapshots

TABLES = ("events", "documents", "benchmark")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt over all cores where its files make fewer parts than there are cores; other inputs stay as they lie.

    Files of one row group are one task, however long their rows take; a large input has parts enough and is never moved.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def read_settings(spark: SparkSession, path: str, defaults: dict[str, str]) -> DataFrame:
    """One row of settings; keys that the JSON document lacks, or holds empty, have their default."""
    schema = ", ".join(f"`{k}` string" for k in defaults)
    row = spark.read.schema(schema).option("multiLine", True).json(path)
    return row.select(*[F.coalesce(F.nullif(F.col(k), F.lit("")), F.lit(v)).alias(k) for k, v in defaults.items()])


def write_settings(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").json(path)


def read_config(spark: SparkSession, path: str, variables: dict[str, str], defaults: dict[str, str]) -> dict[str, str]:
    """Settings by precedence: environment variable (``variables``: key to name), file, default; empty counts as absent."""
    row = read_settings(spark, path, defaults).first().asDict()
    return {k: os.environ.get(variables.get(k, ""), "") or row[k] for k in defaults}


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files with their order (``line_no``, from 0) and the raw line, whatever it holds.

    Files are split, so a line's number is its offset order: numbers are counted by partition, and partitions are added up.
    """
    lines = spark.read.text(path).select(F.col("value").alias("raw"), F.monotonically_increasing_id().alias("at"))
    part = F.shiftright("at", 33)
    sizes = lines.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition
    sizes = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    own = lines.withColumn("part", part).join(F.broadcast(sizes), "part")
    return own.select("raw", (F.col("base") + F.col("at").bitwiseAND((1 << 33) - 1)).alias("line_no"))


def rewrite(df: DataFrame, path: str) -> int:
    """Replaces a versioned table that ``df`` may itself read; the version before stays as its backup."""
    return Snapshots(df.sparkSession, path).commit(df)


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    """Rows ``page``, ``theme`` and ``ratio`` of an audit document: a list of results with their offenders."""
    schema = "results array<struct<path:string,theme:string,offenders:array<struct<ratio:double>>>>"
    doc = spark.read.schema(schema).option("multiLine", True).json(path)
    r = doc.select(F.explode("results").alias("r")).select("r.path", "r.theme", F.explode("r.offenders").alias("o"))
    return r.select(F.col("path").alias("page"), "theme", F.col("o.ratio").alias("ratio"))


def write_texts(df: DataFrame, path: str, column: str = "text") -> None:
    df.select(F.col(column).alias("value")).write.mode("overwrite").text(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; inner quotes are escaped, unlike those of a plain join."""
    df.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(path)
