"""Delimited relation files (key, value), optionally gzipped, with a header and without quoting."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SEPARATORS = {"csv": ",", "tsv": " "}


def read_relation(spark: SparkSession, path: str, key_type: str = "bigint", sep: str = " ") -> DataFrame:
    """A relation file; Spark unpacks .gz itself. The schema is given, never inferred."""
    reader = spark.read.schema(f"key {key_type}, value {key_type}").option("sep", sep).option("header", True).option("quote", "")
    return reader.csv(path)


def read_join(spark: SparkSession, inner: str, outer: str, key_type: str = "bigint", sep: str = " ") -> tuple[DataFrame, DataFrame]:
    """Build and probe relations of a join."""
    return read_relation(spark, inner, key_type, sep), read_relation(spark, outer, key_type, sep)


def write_relation(rows: DataFrame, path: str, kind: str = "tsv", compress: bool = True) -> None:
    """key and value with a header; kind csv parts by commas, tsv by blanks. Nulls are written as the in-band marker."""
    out = rows.select(F.coalesce("key", F.lit(-1)).alias("key"), "value")
    writer = out.write.mode("overwrite").option("sep", SEPARATORS[kind]).option("header", True)
    writer.option("compression", "gzip" if compress else "none").csv(path)


def numbered(rows: DataFrame) -> DataFrame:
    """key (by pos) with value = pos + 1."""
    return rows.select("key", (F.col("pos") + 1).alias("value"))


def write_points(points: DataFrame, path: str) -> None:
    """Measurements as CSV; list columns become comma-joined text."""
    flat = [F.array_join(c, ",").alias(c) if kind.startswith("array") else F.col(c) for c, kind in points.dtypes]
    points.select(*flat).write.mode("overwrite").option("header", True).csv(path)


def read_points(spark: SparkSession, *paths: str, schema: str) -> DataFrame:
    """Measurements of several runs together."""
    return spark.read.schema(schema).option("header", True).csv(list(paths))
