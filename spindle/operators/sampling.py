"""Causal samples as index-only manifests, drawn by hash ranks.

Every draw is a function of seed, tag and index (functions/hashing.py): the same in any order, partitioning or engine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindle.functions.hashing import draw, flag, sample_id, stable_seed, uniform
from spindle.functions.signal import is_finite
from spindle.operators.windows import checked_chronology, eligible, future_pairs, pools
from spindle.schemas import DIMENSION, FEATURE_VERSION, LOOKBACK_SEC, MANIFEST_VERSION, MAX_CONTEXT, MAX_FUTURE, MIN_CONTEXT, SHORT_CONTEXT, SPARSE_RETENTION, TRAJECTORY

SPLITS = ("train", "validation", "test")
REGIMES = ("main", "short_robustness")


def checked(split: str, seed: int, anchors: int | None, context: str, sparse: str) -> None:
    """Arguments that can't be sampled raise at once."""
    if split not in SPLITS:
        raise ValueError(f"unsupported split: {split}")
    if seed < 0:
        raise ValueError("seed must not be negative")
    if anchors is not None and anchors < 1:
        raise ValueError("anchors_per_trajectory must be positive")
    if context not in REGIMES:
        raise ValueError(f"unsupported context_regime: {context}")
    if sparse not in SPARSE_RETENTION:
        raise ValueError(f"unsupported sparse_regime: {sparse}")


def choose_anchors(anchors: DataFrame, by: list[str], count: int | None, seed: Column) -> DataFrame:
    """`count` anchors of each trajectory without replacement; all if None."""
    if count is None:
        return anchors
    w = Window.partitionBy(*by).orderBy("_h", "measurement_index")
    return anchors.withColumn("_h", draw(seed, F.lit("anchor"), F.col("measurement_index"))).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= count).drop("_h", "_r")


def choose_context(pool: Column, low: int, high: int, seed: Column, keep: int = 2) -> Column:
    """k of a pool's (t, i) structs, k uniform in low..min(high, size): the last `keep` (anchor and its predecessor) always, the others by rank of their hash; in order."""
    n = F.size(pool)
    k = F.lit(low) + (draw(seed, F.lit("k")) % (F.least(F.lit(high), n) - low + 1)).cast("int")
    return chosen(pool, k, seed, keep)


def chosen(pool: Column, k: Column, seed: Column, keep: int = 2) -> Column:
    n = F.size(pool)
    held = F.least(F.lit(keep), n)
    rest = F.slice(pool, F.lit(1), F.greatest(n - held, F.lit(0)))
    ranked = F.array_sort(F.transform(rest, lambda x: F.struct(draw(seed, F.lit("context"), x["i"]).alias("h"), x["t"].alias("t"), x["i"].alias("i"))))
    some = F.transform(F.slice(ranked, F.lit(1), F.greatest(k - held, F.lit(0))), lambda x: F.struct(x["t"].alias("t"), x["i"].alias("i")))
    return F.array_sort(F.concat(some, F.slice(pool, n - held + 1, held)))


def positions(n: Column, q: Column, seed: Column) -> Column:
    """q different places of 1..n, each set of them equally likely: at each of the last q places, a draw up to it, or the place itself if that was drawn before (Floyd)."""
    def step(have: Column, j: Column) -> Column:
        at = draw(seed, F.lit("future"), j) % j + 1
        return F.concat(have, F.array(F.when(F.array_contains(have, at), j).otherwise(at)))

    return F.aggregate(F.sequence(n - q + 1, n), F.expr("array()").cast("array<long>"), step)


def observed(indices: Column, anchor: Column, probability: float, seed: Column) -> Column:
    """Bernoulli retention of each context row; the anchor is always kept."""
    if probability >= 1.0:
        return F.transform(indices, lambda i: F.lit(True))
    return F.transform(indices, lambda i: (uniform(seed, F.lit("sparse"), i) < probability) | (i == anchor))


def checked_rows(snaps: DataFrame, split: str) -> DataFrame:
    """The split's snapshots that have a channel. Columns that are absent, and rows of the split that break the contract, raise."""
    gone = sorted({*TRAJECTORY, "measurement_index", "elapsed_time_sec", "split", "feature_schema_version", "feature_dimension", "feature_vector", "horizontal_present", "vertical_present"} - set(snaps.columns))
    if gone:
        raise ValueError(f"snapshots lack the columns {gone}")
    own = snaps.where(F.col("split") == split)
    some = F.col("horizontal_present") | F.col("vertical_present")
    rules = {
        "feature version": F.col("feature_schema_version") == FEATURE_VERSION, "feature dimension": F.col("feature_dimension") == DIMENSION,
        "finite vector": (F.size("feature_vector") == DIMENSION) & F.forall("feature_vector", is_finite),
        "chronology": ~some | ((F.col("measurement_index") >= 1) & is_finite(F.col("elapsed_time_sec")))}
    broken = own.agg(*[F.count_if(~F.coalesce(ok, F.lit(False))).alias(name) for name, ok in rules.items()]).first().asDict()
    if any(broken.values()):
        raise ValueError(f"snapshots of {split} break rules (rows): { {k: n for k, n in broken.items() if n} }")
    return checked_chronology(own.where(some), TRAJECTORY)


def sample_manifest(snaps: DataFrame, *, split: str, seed: int, anchors_per_trajectory: int | None, context_regime: str = "main", sparse_regime: str = "dense", epoch: int | None = None, full_remaining_lifecycle: bool = False, lookback: float = LOOKBACK_SEC, draws: str = "positions") -> DataFrame:
    """One row for each sample: context and future as measurement indices and times relative to the anchor.

    With draws = "positions", the future's places follow from the number of later rows, and only those rows are joined: as many as samples times queries.
    "ranks" takes the later rows of least hash, for which every anchor meets all later rows of its trajectory: for few anchors of each. All
    later rows are joined too where the full lifecycle is asked for, as all are returned.
    """
    if draws not in ("positions", "ranks"):
        raise ValueError(f"unsupported draws: {draws}")
    checked(split, seed, anchors_per_trajectory, context_regime, sparse_regime)
    rows = checked_rows(snaps, split)
    key = [F.col(c) for c in TRAJECTORY]
    placed = rows.select(*TRAJECTORY, "measurement_index", "elapsed_time_sec", F.row_number().over(Window.partitionBy(*TRAJECTORY).orderBy("measurement_index")).cast("long").alias("_at"), F.count("*").over(Window.partitionBy(*TRAJECTORY)).alias("_of"))
    own = eligible(pools(placed, TRAJECTORY, lookback, carry=["_at", "_of"])).withColumn("tseed", stable_seed(seed, epoch if epoch is not None else -1, *key))
    own = choose_anchors(own, TRAJECTORY, anchors_per_trajectory, F.col("tseed"))
    own = own.withColumn("sampling_seed", stable_seed(F.col("tseed"), F.col("measurement_index"), context_regime, sparse_regime, full_remaining_lifecycle))
    low, high = (MIN_CONTEXT, MAX_CONTEXT) if context_regime == "main" else SHORT_CONTEXT
    own = own.withColumn("context", choose_context(F.col("pool"), low, high, F.col("sampling_seed")))
    n = F.col("_of") - F.col("_at")  # later rows, as time and index grow together
    q = F.lit(1) + draw(F.col("sampling_seed"), F.lit("q")) % F.least(F.lit(MAX_FUTURE), n)
    anchors = own.select(*TRAJECTORY, "measurement_index", "elapsed_time_sec", "sampling_seed", "_at", n.alias("_n"), q.alias("_q"))
    if full_remaining_lifecycle:
        later = future_pairs(anchors, rows, TRAJECTORY)
    elif draws == "positions":
        asked = anchors.withColumn("_at", F.explode(F.transform(positions(F.col("_n"), F.col("_q"), F.col("sampling_seed")), lambda p: p + F.col("_at"))))
        later = asked.join(placed.select(*TRAJECTORY, "_at", F.col("measurement_index").alias("future_index"), F.col("elapsed_time_sec").alias("future_time")), [*TRAJECTORY, "_at"])
    else:  # hash ranks within an anchor; at most MAX_FUTURE rows go on
        w = Window.partitionBy(*TRAJECTORY, "measurement_index").orderBy("_h", "future_index")
        later = future_pairs(anchors, rows, TRAJECTORY).withColumn("_h", draw(F.col("sampling_seed"), F.lit("future"), F.col("future_index")))
        later = later.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= F.col("_q"))
    future = later.groupBy(*TRAJECTORY, "measurement_index").agg(F.array_sort(F.collect_list(F.struct(F.col("future_time").alias("t"), F.col("future_index").alias("i")))).alias("future"))
    both = own.join(future, [*TRAJECTORY, "measurement_index"])
    indices, anchor = F.col("context.i"), F.col("measurement_index")
    kind = "full_lifecycle_eval" if full_remaining_lifecycle else {"train": "train_dynamic", "validation": "validation_fixed", "test": "test_fixed"}[split]
    relative = lambda a: F.transform(a, lambda x: x["t"] - F.col("elapsed_time_sec"))
    p = SPARSE_RETENTION[sparse_regime]
    out = both.withColumn("mask", observed(indices, anchor, p, F.col("sampling_seed")))
    return out.select(
        F.lit(MANIFEST_VERSION).alias("manifest_schema_version"), F.lit(FEATURE_VERSION).alias("feature_schema_version"),
        sample_id(*key, anchor, F.col("sampling_seed"), epoch if epoch is not None else "None", context_regime, sparse_regime, full_remaining_lifecycle).alias("sample_id"),
        *key, F.lit(split).alias("split"), F.lit(kind).alias("sample_kind"), F.lit(context_regime).alias("context_regime"), F.lit(sparse_regime).alias("sparse_regime"),
        F.lit(p).alias("sparse_retention_probability"), "sampling_seed", F.lit(epoch).cast("long").alias("epoch"), anchor.alias("anchor_measurement_index"), F.col("elapsed_time_sec").alias("anchor_elapsed_time_sec"),
        indices.alias("context_measurement_indices"), relative("context").alias("context_relative_time_sec"), F.col("mask").alias("context_observed_mask"),
        F.size("context").cast("long").alias("context_count_k"), F.size(F.filter("mask", lambda x: x)).cast("long").alias("context_observed_count"),
        F.col("future.i").alias("future_query_measurement_indices"), relative("future").alias("future_relative_time_sec"), F.size("future").cast("long").alias("future_query_count_q"),
        F.lit(full_remaining_lifecycle).alias("full_remaining_lifecycle"), F.lit("all_observed_future" if full_remaining_lifecycle else "random_observed_future").alias("target_query_policy"))


def sampler_summary(manifest: DataFrame) -> DataFrame:
    k, q = "context_count_k", "future_query_count_q"
    return manifest.agg(F.count("*").alias("samples"), F.count_distinct(*TRAJECTORY).alias("trajectories"), *[f(c).alias(f"{n}_{c}") for c in (k, q) for n, f in (("min", F.min), ("max", F.max))])
