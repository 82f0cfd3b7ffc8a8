"""Audit of snapshots and manifests for leakage and reproducibility: every finding is a row (code, sample_id, message)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindle.functions.signal import is_finite
from spindle.operators.contract import violations
from spindle.schemas import DIMENSION, FEATURE_VERSION, LOOKBACK_SEC, MAX_CONTEXT, MEASUREMENT, TRAJECTORY

TOLERANCE = 1e-9
CAUSAL = ("context_future_overlap", "context_lookback", "future_before_anchor", "context_time_mismatch", "future_time_mismatch", "anchor_context_mask")


def _codes(**found: Column) -> Column:
    return F.filter(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(code)) for code, bad in found.items()]), lambda x: x.isNotNull())


def _close(a: Column, b: Column) -> Column:
    return F.abs(a - b) <= TOLERANCE + TOLERANCE * F.greatest(F.abs(a), F.abs(b))


def missing_columns(df: DataFrame, needed: list[str]) -> list[str]:
    return sorted(set(needed) - set(df.columns))


def snapshot_issues(snaps: DataFrame) -> DataFrame:
    """code, sample_id (null), message for repeated keys, wrong versions, vectors that aren't finite, and unknown splits."""
    twice = snaps.groupBy(*MEASUREMENT).count().where("count > 1").select(F.lit("snapshot_duplicate").alias("code"), F.concat_ws("|", *MEASUREMENT).alias("message"))
    rows = snaps.select(F.explode(_codes(
        snapshot_feature_schema=(F.col("feature_schema_version") != FEATURE_VERSION) | (F.col("feature_dimension") != DIMENSION),
        snapshot_feature_vector=F.coalesce((F.size("feature_vector") != DIMENSION) | ~F.forall("feature_vector", is_finite), F.lit(True)),
        snapshot_split=~F.coalesce(F.col("split").isin("train", "validation", "test"), F.lit(False)),
    )).alias("code"), F.concat_ws("|", *MEASUREMENT).alias("message"))
    return twice.unionByName(rows).select("code", F.lit(None).cast("string").alias("sample_id"), "message")


def sample_issues(manifest: DataFrame, snaps: DataFrame) -> DataFrame:
    """The audit of each sample against the snapshots it refers to."""
    own = snaps.select(*TRAJECTORY, F.col("measurement_index").alias("_i"), F.col("elapsed_time_sec").alias("_t"), F.col("split").alias("_split"))
    m = manifest.alias("m")
    at = own.withColumnsRenamed({"_i": "anchor_measurement_index", "_t": "_anchor_t", "_split": "_anchor_split"})
    base = m.join(at, [*TRAJECTORY, "anchor_measurement_index"], "left")
    found = base.where(F.col("_anchor_t").isNotNull())
    position = F.array_position("context_measurement_indices", F.col("anchor_measurement_index"))
    first = base.select("sample_id", F.explode(F.when(F.col("_anchor_t").isNull(), F.array(F.lit("missing_anchor"))).otherwise(_codes(
        anchor_time_mismatch=~_close(F.col("anchor_elapsed_time_sec"), F.col("_anchor_t")),
        anchor_split_mismatch=F.col("_anchor_split") != F.col("split"),
        context_cap=F.size("context_measurement_indices") > MAX_CONTEXT,
        anchor_context_mask=(position == 0) | ~F.coalesce(F.try_element_at("context_observed_mask", position.cast("int")), F.lit(False)),
        context_future_overlap=F.arrays_overlap("context_measurement_indices", "future_query_measurement_indices"),
    ))).alias("code"), F.col("anchor_measurement_index").cast("string").alias("message"))

    def refer(indices: str, times: str) -> DataFrame:
        rows = found.select(*TRAJECTORY, "sample_id", "split", "_anchor_t", F.explode(F.arrays_zip(F.col(indices).alias("i"), F.col(times).alias("t"))).alias("r"))
        return rows.join(own, [*[rows[c] == own[c] for c in TRAJECTORY], F.col("r.i") == own["_i"]], "left").withColumn("rel", F.col("_t") - F.col("_anchor_t"))

    gone = F.col("_i").isNull()
    ctx = refer("context_measurement_indices", "context_relative_time_sec").select("sample_id", F.explode(F.when(gone, F.array(F.lit("missing_context_snapshot"))).otherwise(_codes(
        context_time_mismatch=~_close(F.col("r.t"), F.col("rel")),
        context_lookback=(F.col("rel") > TOLERANCE) | (F.col("rel") < -LOOKBACK_SEC - TOLERANCE),
        context_split_leakage=F.col("_split") != F.col("split"),
    ))).alias("code"), F.col("r.i").cast("string").alias("message"))
    fut = refer("future_query_measurement_indices", "future_relative_time_sec").select("sample_id", F.explode(F.when(gone, F.array(F.lit("missing_future_snapshot"))).otherwise(_codes(
        future_before_anchor=F.col("rel") <= 0,
        future_time_mismatch=~_close(F.col("r.t"), F.col("rel")),
        future_split_leakage=F.col("_split") != F.col("split"),
    ))).alias("code"), F.col("r.i").cast("string").alias("message"))
    return reduce(DataFrame.unionByName, (first, ctx, fut)).select("code", "sample_id", "message")


def manifest_issues(manifest: DataFrame) -> DataFrame:
    """Contract breaks, repeated ids and trajectories that occur in several splits."""
    broken = manifest.select("sample_id", F.explode(violations()).alias("message")).select(F.lit("manifest_contract").alias("code"), "sample_id", "message")
    twice = manifest.groupBy("sample_id").count().where("count > 1").select(F.lit("duplicate_sample_id").alias("code"), "sample_id", F.col("count").cast("string").alias("message"))
    leak = manifest.groupBy(*TRAJECTORY).agg(F.count_distinct("split").alias("n")).where("n > 1").select(F.lit("trajectory_split_leakage").alias("code"), F.lit(None).cast("string").alias("sample_id"), F.concat_ws("|", *TRAJECTORY).alias("message"))
    return reduce(DataFrame.unionByName, (broken, twice, leak))


def compare_manifests(left: DataFrame, right: DataFrame) -> DataFrame:
    """sample_id, status (missing, extra, changed) of samples in which two runs differ."""
    shared = [c for c in left.columns if c != "sample_id"]
    a = left.select("sample_id", F.struct(*shared).alias("a"), F.lit(True).alias("_a"))
    b = right.select("sample_id", F.struct(*shared).alias("b"), F.lit(True).alias("_b"))
    status = F.when(F.col("_b").isNull(), "missing").when(F.col("_a").isNull(), "extra").when(~F.col("a").eqNullSafe(F.col("b")), "changed")
    return a.join(b, "sample_id", "full_outer").select("sample_id", status.alias("status")).where("status is not null")


def checks(issues: DataFrame, compared: bool = False) -> DataFrame:
    """check, passed: the roll-up of issue codes; compared: whether another run's manifest was, for the check `reproducibility`."""
    code = F.col("code")
    reference = code.startswith("missing_") | code.startswith("anchor_") | code.startswith("context_split_") | code.startswith("future_split_")
    flags = {
        "manifest_contract": code.isin("manifest_contract", "manifest_read_error") | code.startswith("snapshot_"), "causal_order": code.isin(*CAUSAL), "source_reference_integrity": reference,
        "split_isolation": code == "trajectory_split_leakage", "all": code.isNotNull(),
    }
    if compared:
        flags["reproducibility"] = code.startswith("repro")
    one = issues.agg(*[F.coalesce(F.bool_or(v), F.lit(False)).alias(k) for k, v in flags.items()])
    return one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("check"), (~F.col(k)).alias("passed")) for k in flags])).alias("r")).select("r.*")


def issue_counts(issues: DataFrame) -> DataFrame:
    return issues.groupBy("code").agg(F.count("*").alias("n"))
