"""The row contract of sample manifests as one column of violated rules, and uniqueness of samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindle.functions.signal import is_finite
from spindle.schemas import FEATURE_VERSION, MANIFEST_VERSION, MAX_CONTEXT, MIN_CONTEXT, SHORT_CONTEXT, SPARSE_RETENTION

KINDS = ("train_dynamic", "validation_fixed", "test_fixed", "full_lifecycle_eval")
STRINGS = ("sample_id", "dataset_name", "experiment_id", "bearing_id", "split", "sample_kind", "context_regime", "sparse_regime")


def rising(a: str | Column) -> Column:
    """Strictly increasing, and so without repeats."""
    a = F.col(a) if isinstance(a, str) else a
    return F.forall(F.sequence(F.lit(1), F.greatest(F.size(a) - 1, F.lit(1))), lambda i: (F.size(a) < 2) | (F.try_element_at(a, i) < F.try_element_at(a, i + 1)))


def violations() -> Column:
    """Names of the rules that a row breaks."""
    c = F.col
    k, q = F.size("context_measurement_indices"), F.size("future_query_measurement_indices")
    anchor = F.array_position("context_measurement_indices", c("anchor_measurement_index"))
    retention = F.create_map(*[F.lit(x) for kv in SPARSE_RETENTION.items() for x in kv])
    policy = F.when(c("full_remaining_lifecycle"), "all_observed_future").otherwise("random_observed_future")
    rules = {
        "manifest_version": c("manifest_schema_version") == MANIFEST_VERSION,
        "feature_version": c("feature_schema_version") == FEATURE_VERSION,
        "empty_string": F.forall(F.array(*STRINGS), lambda s: s.isNotNull() & (s != "")),
        "split": c("split").isin("train", "validation", "test"),
        "sample_kind": c("sample_kind").isin(*KINDS),
        "context_regime": c("context_regime").isin("main", "short_robustness"),
        "sparse_regime": c("sparse_regime").isin(*SPARSE_RETENTION),
        "retention": c("sparse_retention_probability") == retention[c("sparse_regime")],
        "seed": c("sampling_seed") >= 0,
        "anchor_time": is_finite(c("anchor_elapsed_time_sec")),
        "anchor_index": c("anchor_measurement_index") >= 1,
        "k_matches": (c("context_count_k") == k) & (F.size("context_relative_time_sec") == k) & (F.size("context_observed_mask") == k),
        "k_positive": k >= 1,
        "k_regime": F.when(c("context_regime") == "main", k.between(MIN_CONTEXT, MAX_CONTEXT)).when(c("context_regime") == "short_robustness", k.between(*SHORT_CONTEXT)).otherwise(True),
        "observed_count": c("context_observed_count") == F.size(F.filter("context_observed_mask", lambda x: x)),
        "context_order": rising("context_measurement_indices"),
        "anchor_observed": (anchor > 0) & F.coalesce(F.try_element_at("context_observed_mask", anchor.cast("int")), F.lit(False)),
        "context_times": F.forall("context_relative_time_sec", lambda x: x <= 0) & (F.try_element_at("context_relative_time_sec", F.lit(-1)) == 0),
        "context_time_order": rising("context_relative_time_sec"),
        "dense_keeps_all": (c("sparse_regime") != "dense") | F.forall("context_observed_mask", lambda x: x),
        "q_matches": (c("future_query_count_q") == q) & (F.size("future_relative_time_sec") == q),
        "q_positive": q >= 1,
        "future_order": rising("future_query_measurement_indices"),
        "overlap": ~F.arrays_overlap("context_measurement_indices", "future_query_measurement_indices"),
        "future_times": F.forall("future_relative_time_sec", lambda x: x > 0),
        "future_time_order": rising("future_relative_time_sec"),
        "policy": c("target_query_policy") == policy,
    }
    return F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]), lambda x: x.isNotNull())


def contract_violations(manifest: DataFrame) -> DataFrame:
    """sample_id, rule: one row for each broken rule, and `duplicate_sample_id` for ids that repeat."""
    broken = manifest.select("sample_id", F.explode(violations()).alias("rule"))
    twice = manifest.groupBy("sample_id").count().where("count > 1").select("sample_id", F.lit("duplicate_sample_id").alias("rule"))
    return broken.unionByName(twice)


def write_manifest(manifest: DataFrame, path: str) -> None:
    """Writes a manifest whose rows keep the contract; else raises and writes nothing."""
    bad = contract_violations(manifest).take(5)
    if bad:
        raise ValueError(f"manifest breaks its contract: {[(r.sample_id, r.rule) for r in bad]}")
    manifest.write.mode("overwrite").option("compression", "zstd").parquet(path)
