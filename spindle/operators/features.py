"""Observation and snapshot features, the train-only scaler, and the feature quality report."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindle.functions.signal import NAN, is_finite, wave_features
from spindle.operators.selection import quantiles
from spindle.schemas import (
    CHANNEL_FEATURES, CHANNELS, CORRELATION_LIMIT, DIMENSION, FEATURE_VERSION, FEATURES, MEASUREMENT, OUTLIER_LIMIT, VALIDATION_BEARINGS,
)


def split_of(experiment: str = "experiment_id", bearing: str = "bearing_id") -> Column:
    """The test condition first, then the validation bearings, else train."""
    return F.when(F.col(experiment) == "condition_3", "test").when(F.col(bearing).isin(*VALIDATION_BEARINGS), "validation").otherwise("train")


def observation_features(obs: DataFrame) -> DataFrame:
    """Each observation with its 15 features (double) and its split; the waveform goes no further."""
    own = wave_features(F.col("vibration_signal"), F.col("sampling_rate_hz"))
    return obs.select(*[c for c in obs.columns if c != "vibration_signal"], split_of().alias("split"), *[v.alias(k) for k, v in own.items()])


def fit_scaler(features: DataFrame) -> DataFrame:
    """One row: mean_<name> and scale_<name>, from finite values of the train split, both channels together.

    A scale of 0 becomes 1; a feature without any value has mean 0 and scale 1.
    """
    aggs = []
    for n in CHANNEL_FEATURES:
        x = F.when((F.col("split") == "train") & is_finite(F.col(n)), F.col(n))
        sd = F.stddev_pop(x)
        aggs += [F.coalesce(F.avg(x), F.lit(0.0)).alias(f"mean_{n}"), F.when(sd > 0, sd).otherwise(1.0).alias(f"scale_{n}")]
    return features.agg(*aggs)


def snapshots(features: DataFrame, scaler: DataFrame) -> DataFrame:
    """One row for each bearing and measurement: both channels' features as raw (double), scaled and valid vectors.

    A channel that is absent is NaN in the raw vector, 0 in the scaled one and not valid.
    """
    present = {c: F.max(F.col("channel_id") == c).alias(f"{c}_present") for c in CHANNELS}
    own = [F.max(F.when(F.col("channel_id") == c, F.col(n))).alias(f"{c}__{n}") for c in CHANNELS for n in CHANNEL_FEATURES]
    carry = ["elapsed_time_sec", "split", "rotational_speed_rpm", "radial_load_kn"]
    wide = features.groupBy(*MEASUREMENT).agg(*[F.first(c).alias(c) for c in carry], *present.values(), *own)
    raw = F.array(*[F.coalesce(F.col(n), F.lit(NAN)) for n in FEATURES])
    both = wide.crossJoin(F.broadcast(scaler))  # one row of 30 numbers
    z = [F.when(is_finite(F.col(f"{c}__{n}")), (F.col(f"{c}__{n}") - F.col(f"mean_{n}")) / F.col(f"scale_{n}")).otherwise(0.0) for c in CHANNELS for n in CHANNEL_FEATURES]
    return both.select(
        *MEASUREMENT, *carry, "horizontal_present", "vertical_present", F.lit(FEATURE_VERSION).alias("feature_schema_version"), F.lit(DIMENSION).cast("long").alias("feature_dimension"),
        raw.alias("raw_double"), raw.cast("array<float>").alias("raw_feature_vector"), F.array(*z).cast("array<float>").alias("feature_vector"), F.transform(raw, is_finite).alias("feature_valid_mask"))


def long_form(snaps: DataFrame, vector: str = "raw_double") -> DataFrame:
    """(key, split, feature_index, feature, value) of each vector component."""
    names = F.array(*[F.lit(n) for n in FEATURES])
    return snaps.select(*MEASUREMENT, "split", F.posexplode(vector).alias("feature_index", "value")).withColumn("feature", F.element_at(names, F.col("feature_index") + 1))


def feature_quality(long: DataFrame) -> DataFrame:
    """Counts, constancy and outliers of each feature.

    Outliers are judged against median and median absolute deviation of the finite train rows (of all rows if no row is
    train); with a deviation of 0, by 1.5 interquartile ranges of all finite values. Order statistics are exact, by counting (selection.py):
    `long` is read some ten times, so it should come from a table or a checkpoint.
    """
    x = F.when(is_finite(F.col("value")), F.col("value"))
    any_train = bool(long.where(F.col("split") == "train").limit(1).count())
    ref = long.select("feature", (F.when(F.col("split") == "train", x) if any_train else x).alias("ref"))
    names = long.select("feature").distinct()  # 30 rows, as in the tables below
    mid = names.join(quantiles(ref, ["feature"], "ref", [0.5]), "feature", "left").select("feature", F.coalesce(F.col("q")[0], F.lit(0.0)).alias("median"), F.coalesce("n", F.lit(0)).alias("reference_count"))
    mid = long.sparkSession.createDataFrame(mid.collect(), mid.schema)
    off_ref = ref.join(F.broadcast(mid), "feature").select("feature", F.abs(F.col("ref") - F.col("median")).alias("off"))
    dev = mid.select("feature").join(quantiles(off_ref, ["feature"], "off", [0.5]), "feature", "left").select("feature", F.coalesce(F.col("q")[0], F.lit(0.0)).alias("mad"))
    quart = mid.select("feature").join(quantiles(long.select("feature", x.alias("x")), ["feature"], "x", [0.25, 0.75]), "feature", "left").select("feature", "q")
    ready = long.join(F.broadcast(mid), "feature").join(F.broadcast(dev), "feature").join(F.broadcast(quart), "feature")
    iqr = F.col("q")[1] - F.col("q")[0]
    off = F.abs(x - F.col("median"))
    outlier = F.when(F.col("mad") > 0, F.try_divide(0.6745 * off, F.col("mad")) > OUTLIER_LIMIT).otherwise((iqr > 0) & (off > 1.5 * iqr))
    v = F.col("value")
    out = ready.groupBy("feature").agg(
        F.count(x).alias("finite_count"), F.count_if(F.isnan(v)).alias("nan_count"), F.count_if(F.abs(v) == float("inf")).alias("inf_count"),
        F.coalesce(F.max(x) - F.min(x) <= 1e-12, F.lit(False)).alias("constant"), F.count_if(F.coalesce(outlier, F.lit(False))).alias("outlier_count"), F.first("reference_count").alias("reference_count"))
    return out.withColumn("outlier_rate", F.coalesce(F.try_divide(F.col("outlier_count"), F.col("finite_count")), F.lit(0.0)))


_MOMENTS = ("n", "mx", "my", "cxx", "cyy", "cxy", "lx", "hx", "ly", "hy")


def _pair_moments(batches):
    """Of each pair of features, over the batch's rows with both finite: count, means, co-moments and ranges."""
    first, second = np.triu_indices(DIMENSION, 1)
    for batch in batches:
        if not batch.num_rows:
            continue
        v = np.stack([np.asarray(x, np.float64) for x in batch.column(0).to_numpy(zero_copy_only=False)])
        ok = np.isfinite(v)
        mid = np.where(ok, v, 0.0).sum(axis=0) / np.maximum(ok.sum(axis=0), 1)  # sums of differences from here stay exact enough
        d, m = np.where(ok, v - mid, 0.0), ok.astype(np.float64)
        n, sums, squares, cross = m.T @ m, d.T @ m, (d * d).T @ m, d.T @ d
        low = np.stack([np.where(ok & ok[:, [j]], v, np.inf).min(axis=0) for j in range(DIMENSION)], axis=1)  # of row's feature where column's is finite
        high = np.stack([np.where(ok & ok[:, [j]], v, -np.inf).max(axis=0) for j in range(DIMENSION)], axis=1)
        k = np.maximum(n, 1)
        i, j = first[n[first, second] > 0], second[n[first, second] > 0]
        sx, sy, c = sums[i, j], sums[j, i], k[i, j]
        cols = (n[i, j], mid[i] + sx / c, mid[j] + sy / c, squares[i, j] - sx * sx / c, squares[j, i] - sy * sy / c, cross[i, j] - sx * sy / c, low[i, j], high[i, j], low[j, i], high[j, i])
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), *map(pa.array, cols)], names=["i", "j", *_MOMENTS])


def high_correlations(snaps: DataFrame, limit: float = CORRELATION_LIMIT) -> DataFrame:
    """Pairs of features whose correlation over rows with both finite is at least the limit in size.

    One pass: a batch of rows becomes one row of moments for each of the 435 pairs, and only those are shuffled.
    """
    part = snaps.select(F.col("raw_double").cast("array<double>").alias("v")).mapInArrow(_pair_moments, "i int, j int, " + ", ".join(f"{c} double" for c in _MOMENTS))
    pair = Window.partitionBy("i", "j")
    mean = lambda m: F.sum(F.col("n") * F.col(m)).over(pair) / F.sum("n").over(pair)
    part = part.withColumn("dx", F.col("mx") - mean("mx")).withColumn("dy", F.col("my") - mean("my"))
    total = lambda c, a, b: F.sum(F.col(c) + F.col("n") * F.col(a) * F.col(b)).alias(c)
    got = part.groupBy("i", "j").agg(F.sum("n").alias("n"), total("cxx", "dx", "dx"), total("cyy", "dy", "dy"), total("cxy", "dx", "dy"), (F.max("hx") - F.min("lx")).alias("rx"), (F.max("hy") - F.min("ly")).alias("ry"))
    names = F.array(*[F.lit(n) for n in FEATURES])
    r = F.try_divide(F.col("cxy"), F.sqrt(F.col("cxx")) * F.sqrt(F.col("cyy")))
    return got.where("n >= 2 and rx > 1e-12 and ry > 1e-12").select(names[F.col("i")].alias("feature_a"), names[F.col("j")].alias("feature_b"), r.alias("correlation"), F.abs(r).alias("absolute_correlation")).where(F.col("absolute_correlation") >= limit)


def quality_summary(snaps: DataFrame, quality: DataFrame, correlated: DataFrame) -> DataFrame:
    """One row: totals and the status pass, pass_with_warnings or fail."""
    bad = F.coalesce(F.sum(F.size(F.filter("feature_vector", lambda x: ~is_finite(x)))), F.lit(0)).cast("long")
    rows = snaps.agg(F.count("*").alias("snapshot_rows"), bad.alias("normalized_nonfinite_total"))
    q = quality.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(a) for c, a in (("nan_count", "raw_nan_total"), ("inf_count", "raw_inf_total"), ("outlier_count", "outlier_total"))], F.count_if("constant").alias("constant_feature_count"))
    n = correlated.agg(F.count("*").alias("high_correlation_pair_count"))
    warn = (F.col("constant_feature_count") + F.col("high_correlation_pair_count") + F.col("outlier_total")) > 0
    return rows.crossJoin(q).crossJoin(n).withColumn("status", F.when(F.col("normalized_nonfinite_total") > 0, "fail").when(warn, "pass_with_warnings").otherwise("pass"))


def split_counts(snaps: DataFrame) -> DataFrame:
    """Rows of each split, with zero for a split without rows."""
    names = snaps.sparkSession.createDataFrame([("train",), ("validation",), ("test",)], "split string")
    return names.join(snaps.groupBy("split").count(), "split", "left").select("split", F.coalesce("count", F.lit(0)).cast("long").alias("n_rows"))
