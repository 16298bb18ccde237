"""Tables of the analysed recordings.

``frames`` is the ordered signal of every track; its position is counted from 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from trackweave.operators.numbering import number_rows
from trackweave.session import cut_lineage


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def minute_of(ts: str) -> Column:
    """Minutes since 1970 of a timestamp without time zone."""
    return F.unix_date(F.to_date(ts)) * 1440 + F.hour(ts) * 60 + F.minute(ts)


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(track, pos, value, kind)``: events in time order per user.

    Minutes are the numbering buckets, so one very long track is ordered in parts.
    """
    events = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("track"), "ts", "event_id", F.col("event_type").alias("kind"), "value"
    )
    numbered = number_rows(events, ["track"], ["ts", "event_id"], minute_of("ts"), "pos")
    return numbered.select("track", "pos", "value", "kind")


def stored_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The numbered frames written once, for plans that read them several times."""
    return cut_lineage(frames(spark, sf_dir))


def kind_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(track, pos, value)`` with the event types as few, long tracks, written once."""
    events = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("track"), "ts", "event_id", "value"
    )
    numbered = number_rows(events, ["track"], ["ts", "event_id"], minute_of("ts"), "pos")
    return cut_lineage(numbered.drop("ts", "event_id"))


def vector_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(track, pos, frame)`` with three numbers per frame, written once."""
    frame = F.array(
        "value",
        F.get_json_object("props", "$.k").cast("double"),
        (F.col("event_type") == "purchase").cast("double") * 50,
    )
    events = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("track"), "ts", "event_id", frame.alias("frame")
    )
    numbered = number_rows(events, ["track"], ["ts", "event_id"], minute_of("ts"), "pos")
    return cut_lineage(numbered.drop("ts", "event_id"))


def lengths(samples: DataFrame) -> DataFrame:
    """``(track, n)``: samples per track."""
    return samples.groupBy("track").agg((F.max("pos") + 1).alias("n"))


def chunked(samples: DataFrame, size: int) -> DataFrame:
    """``(track, chunk, values)``: the signal in arrays of at most ``size`` samples.

    The stored form for long signals: windows and fragments touch a few chunks
    and no track is ever held in one row.
    """
    ordered = F.array_sort(F.collect_list(F.struct("pos", "value")))
    return (
        samples.withColumn("chunk", F.expr(f"pos div {size}"))
        .groupBy("track", "chunk")
        .agg(F.transform(ordered, lambda s: s["value"]).alias("values"))
    )


def taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(track, species, family)``: nation and region of every customer."""
    customer = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("track"), F.col("c_nationkey").alias("n_nationkey")
    )
    nation = table(spark, sf_dir, "nation").select(
        "n_nationkey", F.col("n_name").alias("species"), F.col("n_regionkey").alias("r_regionkey")
    )
    region = table(spark, sf_dir, "region").select("r_regionkey", F.col("r_name").alias("family"))
    return (
        customer.join(nation, "n_nationkey", "left")
        .join(region, "r_regionkey", "left")
        .select("track", "species", "family")
    )
