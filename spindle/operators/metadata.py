"""Three layers of metadata: dataset, conditions and trajectories, with their reconciliation against what was parsed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spindle.schemas import CONDITIONS, DATASET, FAULT_ELEMENTS, RECORD_INTERVAL_SEC, SAMPLING_RATE_HZ, SIGNAL_LENGTH, TRAJECTORY

CONFIG = ("dataset_name", "experiment_id", "bearing_id", "source_csv_count", "reported_lifetime_raw", "reported_lifetime_min", "fault_element_raw", "fault_elements", "failure_observed", "metadata_source", "metadata_source_locator", "metadata_confidence", "notes")


def dataset_row(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(DATASET, SAMPLING_RATE_HZ, SIGNAL_LENGTH, RECORD_INTERVAL_SEC, 2)], "dataset_name string, sampling_rate_hz double, samples_per_record bigint, record_interval_sec double, channel_count bigint")


def condition_rows(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(DATASET, e, s, r, w) for s, e, r, w in CONDITIONS], "dataset_name string, experiment_id string, condition_source_name string, rotational_speed_rpm double, radial_load_kn double")


def read_config(spark: SparkSession, path: str) -> DataFrame:
    """The editable CSV, all columns as text; columns that are needed and absent raise."""
    rows = spark.read.option("header", "true").option("mode", "FAILFAST").csv(path)
    if gone := sorted(set(CONFIG) - set(rows.columns)):
        raise ValueError(f"metadata lacks columns: {gone}")
    return rows.select(*CONFIG)


def elements(raw: str) -> Column:
    return F.filter(F.transform(F.split(raw, ";"), lambda x: F.trim(x)), lambda x: x != "")


def typed(config: DataFrame) -> DataFrame:
    """Typed rows, each with the names of the rules that it breaks in `broken`."""
    truth = F.lower(F.trim("failure_observed"))
    observed = F.when(truth == "true", True).when(truth == "false", False)
    n, life = F.col("source_csv_count").try_cast("long"), F.col("reported_lifetime_min").try_cast("double")
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    rules = {
        "empty_key": blank("dataset_name") | blank("experiment_id") | blank("bearing_id"), "source_csv_count": n.isNull() | (n < 1), "reported_lifetime_min": ~blank("reported_lifetime_min") & (life.isNull() | (life <= 0)),
        "failure_observed": observed.isNull(), "fault_elements": F.size(F.array_except(elements("fault_elements"), F.array(*[F.lit(x) for x in FAULT_ELEMENTS]))) > 0,
    }
    broken = F.filter(F.array(*[F.when(F.coalesce(bad, F.lit(True)), F.lit(k)) for k, bad in rules.items()]), lambda x: x.isNotNull())
    return config.select(*TRAJECTORY, n.alias("source_csv_count"), "reported_lifetime_raw", life.alias("reported_lifetime_min"), "fault_element_raw", elements("fault_elements").alias("fault_elements"), observed.alias("failure_observed"), "metadata_source", "metadata_source_locator", "metadata_confidence", "notes", broken.alias("broken"))


def bounds(manifest: DataFrame) -> DataFrame:
    """Parsed files of each trajectory: count, first and last index."""
    ok = manifest.where("parse_status = 'ok' and measurement_index is not null")
    return ok.groupBy("experiment_id", "bearing_id").agg(F.count("*").alias("parsed_measurement_count"), F.min("measurement_index").alias("first_measurement_index"), F.max("measurement_index").alias("last_measurement_index"))


def key_differences(config: DataFrame, manifest: DataFrame) -> DataFrame:
    """experiment_id, bearing_id, side: keys of the manifest that the config lacks (missing) and the reverse (extra)."""
    a, b = config.select("experiment_id", "bearing_id").distinct(), manifest.select("experiment_id", "bearing_id").distinct()
    keys = ["experiment_id", "bearing_id"]
    return b.join(a, keys, "left_anti").withColumn("side", F.lit("missing")).unionByName(a.join(b, keys, "left_anti").withColumn("side", F.lit("extra")))


def trajectory_metadata(config: DataFrame, manifest: DataFrame) -> DataFrame:
    """Typed config with parsed bounds (null without any parsed file). Broken rows, repeated keys or unmatched keys raise."""
    rows = typed(config)
    bad = rows.where(F.size("broken") > 0).select("experiment_id", "bearing_id", "broken").take(5)
    bad += rows.groupBy(*TRAJECTORY).count().where("count > 1").take(5) + key_differences(rows, manifest).take(5)
    if bad:
        raise ValueError(f"metadata does not hold: {bad}")
    found = bounds(manifest)
    return rows.drop("broken").join(found, ["experiment_id", "bearing_id"], "left").withColumn("parsed_measurement_count", F.coalesce("parsed_measurement_count", F.lit(0).cast("long")))


def count_mismatches(meta: DataFrame) -> DataFrame:
    return meta.where("source_csv_count <> parsed_measurement_count").select(*TRAJECTORY, "source_csv_count", "parsed_measurement_count")
