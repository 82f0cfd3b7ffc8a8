"""The driver's tables as stand-ins for the bearing data: waveforms from embeddings, trajectories from events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spindle.schemas import CONDITIONS, DATASET, RECORD_INTERVAL_SEC, SAMPLING_RATE_HZ


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def waves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations: one row for each bearing, measurement and channel."""
    emb = table(spark, sf_dir, "embeddings")
    b = F.expr("(vec_id div 2) % 15")
    cond = F.expr("((vec_id div 2) % 15) div 5 + 1")
    idx = F.expr("vec_id div 30 + 1")
    pick = lambda i: F.element_at(F.array(*[F.lit(c[i]) for c in CONDITIONS]), cond.cast("int"))
    ch = F.when(F.col("vec_id") % 2 == 0, "horizontal").otherwise("vertical")
    return emb.select(
        F.lit(DATASET).alias("dataset_name"), F.concat(F.lit("condition_"), cond).alias("experiment_id"),
        F.concat(F.lit("Bearing"), cond, F.lit("_"), (b % 5 + 1)).alias("bearing_id"), idx.alias("measurement_index"),
        ((idx - 1) * RECORD_INTERVAL_SEC).alias("elapsed_time_sec"), pick(2).alias("rotational_speed_rpm"), pick(3).alias("radial_load_kn"),
        ch.alias("channel_id"), ch.alias("channel_direction"), F.lit(SAMPLING_RATE_HZ).alias("sampling_rate_hz"),
        F.size("embedding").cast("long").alias("signal_length"), F.col("embedding").cast("array<float>").alias("vibration_signal"))


def trajectories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One trajectory for each user, on the regular clock; value is the feature, events at random are gaps."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return (
        table(spark, sf_dir, "events")
        .select("user_id", "event_id", "ts", "event_type", "value", F.row_number().over(w).cast("long").alias("measurement_index"))
        .withColumn("elapsed_time_sec", (F.col("measurement_index") - 1) * RECORD_INTERVAL_SEC)
        .where("event_id % 7 <> 0"))
