"""Readers and writers for the files around a collection of tracks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def list_files(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """``(path, length, label)`` of all files below ``root``; label = parent folder.

    A folder ``name=value``, as partitioned tables have them, counts as ``value``. File
    contents are not read.
    """
    found = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", pattern)
        .load(root)
        .select("path", "length")
    )
    folder = F.url_decode(F.element_at(F.split("path", "/"), -2))
    return found.withColumn("label", F.regexp_replace(folder, "^[A-Za-z_][A-Za-z0-9_]*=", ""))


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV file with a header, read with the given schema."""
    return spark.read.csv(path, header=True, schema=schema, enforceSchema=False)


def write_csv(df: DataFrame, path: str, columns: Sequence[str] | None = None) -> None:
    """Selected columns as CSV with a header and without row numbers."""
    (df.select(*columns) if columns else df).write.mode("overwrite").csv(path, header=True)


def read_json_documents(spark: SparkSession, root: str, schema: str, pattern: str = "*.json") -> DataFrame:
    """Many JSON files below ``root``, each one document of any layout."""
    return (
        spark.read.schema(schema)
        .option("multiLine", "true")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", pattern)
        .json(root)
    )


def write_json_documents(df: DataFrame, path: str) -> None:
    """One JSON file per row."""
    df.write.mode("overwrite").option("maxRecordsPerFile", 1).json(path)


def read_name_list(spark: SparkSession, path: str) -> DataFrame:
    """``(label)``: the strings of a file that is one JSON array."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", "array<string>")).alias("label"))


def task_documents(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """``(data)``: the fields nested one level down, as annotation tools expect."""
    return df.select(F.struct(*fields).alias("data"))


def prefixed_paths(df: DataFrame, path: Column, prefix: str) -> DataFrame:
    """``(value)``: one ``prefix/path`` line per row."""
    return df.select(F.concat_ws("/", F.lit(prefix), path).alias("value"))


def write_by_label(df: DataFrame, path: str, label: str = "label") -> None:
    """Parquet files in one folder per label."""
    df.write.mode("overwrite").partitionBy(label).parquet(path)


def missing_outputs(wanted: DataFrame, existing: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows whose output is not there yet."""
    return wanted.join(existing.select(*keys).distinct(), list(keys), "left_anti")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether Spark's file system has something at ``path``."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def append_missing(wanted: DataFrame, path: str, keys: Sequence[str]) -> None:
    """Append only the rows whose output is not yet in the table at ``path``.

    The first run makes the table.
    """
    spark = wanted.sparkSession
    if not exists(spark, path):
        wanted.write.mode("append").parquet(path)
        return
    existing = spark.read.schema(wanted.schema).parquet(path)
    missing_outputs(wanted, existing, keys).write.mode("append").parquet(path)


def write_run_record(spark: SparkSession, path: str, **fields) -> None:
    """A one-row JSON record of a run next to its outputs."""
    row = spark.range(1).select(
        *[F.lit(v).alias(k) for k, v in fields.items()],
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("created"),
    )
    row.coalesce(1).write.mode("overwrite").json(path)
