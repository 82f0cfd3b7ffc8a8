import numpy as np
import pytest
from pyspark.sql import functions as F

from spindle.operators import baselines, contract, neural, sampling, sensitivity, tensors, validation
from spindle.schemas import DIMENSION, FEATURE_VERSION


@pytest.fixture(scope="module")
def snaps(spark):
    rows = [("d", "condition_1", "Bearing1_1", i, (i - 1) * 60.0, "train", 2100.0, 12.0, True, True, FEATURE_VERSION, DIMENSION, [float(i)] * DIMENSION, [float(i)] * DIMENSION, [not (i == 11 and f == 0) for f in range(DIMENSION)]) for i in range(1, 41)]
    from spindle.schemas import SNAPSHOT

    return spark.createDataFrame(rows, SNAPSHOT).cache()


def manifest(snaps, **kw):
    return sampling.sample_manifest(snaps, **({"split": "train", "seed": 5, "anchors_per_trajectory": None} | kw))


def test_main_samples_are_causal_and_keep_the_contract(snaps):
    m = manifest(snaps).cache()
    assert m.count() == 30 and contract.contract_violations(m).count() == 0
    assert sorted(map(tuple, m.collect())) == sorted(map(tuple, manifest(snaps.repartition(7)).collect()))
    for r in m.collect():
        assert 10 <= r.context_count_k <= 20 and 1 <= r.future_query_count_q <= 8
        assert max(r.context_measurement_indices) == r.anchor_measurement_index < min(r.future_query_measurement_indices) and r.anchor_measurement_index - 1 in r.context_measurement_indices


def test_other_regimes(snaps):
    s = manifest(snaps, context_regime="short_robustness", sparse_regime="sparse_10", anchors_per_trajectory=4).collect()
    assert len(s) == 4 and all(3 <= r.context_count_k <= 9 and r.context_observed_mask[-1] for r in s)
    f = manifest(snaps, full_remaining_lifecycle=True).collect()
    assert all(r.future_query_count_q == 40 - r.anchor_measurement_index and r.sample_kind == "full_lifecycle_eval" for r in f)
    with pytest.raises(ValueError):
        manifest(snaps, seed=-1)
    with pytest.raises(ValueError):
        manifest(snaps, split="none")


@pytest.mark.parametrize("rule, column, value", [
    ("overlap", "future_query_measurement_indices", "context_measurement_indices"), ("context_order", "context_measurement_indices", "reverse(context_measurement_indices)"), ("future_times", "future_relative_time_sec", "array(0.0D)"),
    ("retention", "sparse_retention_probability", "0.5D"), ("observed_count", "context_observed_count", "1"), ("policy", "target_query_policy", "'x'"), ("empty_string", "bearing_id", "''"), ("manifest_version", "manifest_schema_version", "'v0'"),
])
def test_each_broken_rule_is_found(snaps, rule, column, value):
    assert contract.contract_violations(manifest(snaps).withColumn(column, F.expr(value))).where(F.col("rule") == rule).count() == 30


def test_manifest_is_not_written_when_broken(snaps, tmp_path):
    with pytest.raises(ValueError):
        contract.write_manifest(manifest(snaps).withColumn("sampling_seed", F.lit(-1)), str(tmp_path / "m"))
    contract.write_manifest(manifest(snaps), str(tmp_path / "m"))
    assert snaps.sparkSession.read.parquet(str(tmp_path / "m")).count() == 30


@pytest.mark.parametrize("code, change", [
    ("missing_anchor", lambda m: m.withColumn("anchor_measurement_index", F.lit(99))), ("anchor_time_mismatch", lambda m: m.withColumn("anchor_elapsed_time_sec", F.col("anchor_elapsed_time_sec") + 1)),
    ("anchor_split_mismatch", lambda m: m.withColumn("split", F.lit("test"))), ("context_cap", lambda m: m.withColumn("context_measurement_indices", F.sequence(F.lit(1), F.lit(21)).cast("array<long>"))),
    ("anchor_context_mask", lambda m: m.withColumn("context_observed_mask", F.transform("context_observed_mask", lambda x: F.lit(False)))), ("missing_context_snapshot", lambda m: m.withColumn("context_measurement_indices", F.array(F.lit(77).cast("long")))),
    ("context_time_mismatch", lambda m: m.withColumn("context_relative_time_sec", F.transform("context_relative_time_sec", lambda x: x - 1))), ("context_lookback", lambda m: m.withColumn("context_measurement_indices", F.array(F.lit(40).cast("long")))),
    ("context_split_leakage", lambda m: m.withColumn("split", F.lit("test"))), ("context_future_overlap", lambda m: m.withColumn("future_query_measurement_indices", F.col("context_measurement_indices"))),
    ("missing_future_snapshot", lambda m: m.withColumn("future_query_measurement_indices", F.array(F.lit(77).cast("long")))), ("future_before_anchor", lambda m: m.withColumn("future_query_measurement_indices", F.array(F.lit(1).cast("long")))),
    ("future_time_mismatch", lambda m: m.withColumn("future_relative_time_sec", F.transform("future_relative_time_sec", lambda x: x + 1))), ("future_split_leakage", lambda m: m.withColumn("split", F.lit("test"))),
])
def test_each_audit_code(snaps, code, change):
    m = manifest(snaps, anchors_per_trajectory=5)
    assert validation.sample_issues(m, snaps).count() == 0
    assert validation.sample_issues(change(m), snaps).where(F.col("code") == code).count() > 0


def test_snapshot_and_manifest_audit(snaps):
    assert validation.snapshot_issues(snaps).count() == 0
    bad = snaps.union(snaps.limit(1)).withColumn("feature_vector", F.slice("feature_vector", 1, 3)).withColumn("split", F.lit("x")).withColumn("feature_schema_version", F.lit("v0"))
    assert {r.code for r in validation.snapshot_issues(bad).collect()} == {"snapshot_duplicate", "snapshot_feature_schema", "snapshot_feature_vector", "snapshot_split"}
    m = manifest(snaps)
    both = m.union(m.limit(1)).withColumn("split", F.when(F.col("anchor_measurement_index") == 20, "test").otherwise(F.col("split")))
    assert {"duplicate_sample_id", "trajectory_split_leakage"} <= {r.code for r in validation.manifest_issues(both).collect()}


def test_examples_batches_and_forecasts(snaps):
    m = manifest(snaps, anchors_per_trajectory=6).cache()
    ex = tensors.examples(m, tensors.checked_snapshots(snaps)).cache()
    for r in ex.collect():
        assert r.complete and len(r.context_features) == r.context_length and len(r.context_features[0]) == DIMENSION
        for x, k in zip(r.context_features, r.context_feature_mask, strict=True):
            assert all(v == 0.0 for v, ok in zip(x, k, strict=True) if not ok)
    b = tensors.collate(ex, 4).collect()
    assert len(b) == 6 and all(len(r.context_features) >= r.context_length and len(r.future_targets) >= r.future_length for r in b)
    one = tensors.collate(ex, 4, shards=1).orderBy("batch_id", "sample_id").collect()
    assert [r.batch_id for r in one] == ["0-0"] * 4 + ["0-1"] * 2 and [r.sample_id for r in one] == sorted(r.sample_id for r in one)
    for batch in (one[:4], one[4:]):
        assert {len(r.context_features) for r in batch} == {max(r.context_length for r in batch)} and {len(r.future_targets) for r in batch} == {max(r.future_length for r in batch)}
    assert sorted(tensors.collate(ex.repartition(7), 4).collect(), key=lambda r: r.sample_id) == sorted(b, key=lambda r: r.sample_id)
    assert tensors.collate(ex.limit(0), 4).count() == 0
    anchors = {r.sample_id: r.anchor_measurement_index for r in m.collect()}
    assert all(r.prediction == anchors[r.sample_id] or r.feature_index == 0 for r in baselines.persistence(ex).collect())
    t = baselines.target_long(ex).join(baselines.linear_trend(ex), ["sample_id", "query_pos", "feature_index"]).collect()
    assert all(abs(r.prediction - r.target) < 1e-6 for r in t)
    groups = {r.group for r in baselines.baseline_metrics(baselines.persistence(ex).withColumn("model", F.lit("p")), baselines.target_long(ex), m).collect()}
    assert groups == {"overall", "bearing", "condition", "K", "sparse_regime", "future_horizon"}
    with pytest.raises(ValueError):
        tensors.checked_snapshots(snaps.union(snaps))


def test_sensitivity_context_is_shared_by_regimes(snaps):
    m = sensitivity.prepare(snaps, splits=("train",), regimes=("dense", "sparse_5"), anchor_cap=2).collect()
    seen = {}
    for r in m:
        assert seen.setdefault((r.context_window_min, r.anchor_measurement_index), r.context_measurement_indices) == r.context_measurement_indices
        assert r.context_min_records <= r.context_count_k <= r.context_window_min and len(r.future_measurement_indices) == r.future_query_count_q
    assert {r.context_window_min for r in m} == {30, 40} and len({r.sample_id for r in m}) == len(m)


def test_neural_baseline_equals_its_networks(snaps):
    m = manifest(snaps, anchors_per_trajectory=6).cache()
    flat = snaps.withColumn("feature_vector", F.transform("feature_vector", lambda v, i: F.when(i == 4, F.lit(1.0).cast("float")).otherwise((v / (i + 1)).cast("float"))))
    ex = tensors.examples(m, tensors.checked_snapshots(flat)).cache()
    code = {(r.sample_id, r.query_pos): np.array(r.encoding) for r in tensors.encode_context(ex).collect()}
    goal = {(r.sample_id, r.query_pos, r.feature_index): r.target for r in baselines.target_long(ex).where("valid").collect()}
    last = {(r.sample_id, r.query_pos, r.feature_index): r.prediction for r in baselines.persistence(ex).collect()}
    got = {(r.sample_id, r.query_pos, r.feature_index): r.prediction for r in baselines.mlp_forecast(ex, ex, seed=3, passes=12).collect()}
    assert set(got) == set(last) and all(got[k] == last[k] for k in got if k[2] == 4)  # a constant feature falls back
    features, one = neural.fit(ex.repartition(1), 3, passes=12, block_rows=20)
    before, neural.FAN_IN = neural.FAN_IN, 2  # several levels of the tree
    _, many = neural.fit(ex.repartition(8), 3, passes=12, block_rows=20)
    neural.FAN_IN = before
    assert 4 not in features and np.abs(one - many).max() <= 1e-9
    for f in (0, 7):  # the same descent over all rows at once, in this process
        own = [k for k in sorted(code) if (*k, f) in goal]
        x, y = np.stack([code[k] for k in own]), np.array([[goal[(*k, f)]] for k in own])
        start = neural.first_weights(3 + f, x.shape[1])[None]
        descent, seen = neural.Descent(start), []
        for _ in range(12):
            if descent.live:
                at = descent.trial
                loss, grad = neural.penalised(neural.sums(at, x, y, np.ones_like(y, bool)), at, np.array([float(len(own))]), x.shape[1])
                descent.told(loss, grad)
                seen.append(float(descent.loss[0]))
        assert seen == sorted(seen, reverse=True) and seen[-1] < seen[0] / 2
        assert np.abs(one[features.index(f)] - descent.w[0]).max() <= 1e-6
        for k, x in code.items():
            assert got[(*k, f)] == pytest.approx(neural.predict(descent.w, x[None])[0, 0], rel=1e-5, abs=1e-6)


def test_gradient_and_whole_sums():
    r = np.random.default_rng(2)
    x, y, valid = r.normal(size=(50, 6)), r.normal(size=(50, 3)), r.random((50, 3)) < 0.8
    w = np.stack([neural.first_weights(i, 6) for i in range(3)])
    g = neural.sums(w, x, np.where(valid, y, np.nan), valid)
    loss = lambda w: (np.where(valid, neural.predict(w, x) - y, 0) ** 2).sum(0) / 2
    assert g[:, -1] == pytest.approx(loss(w))
    for k in (0, 77, 6 * 32 + 5, 6 * 32 + 40, w.shape[1] - 1):
        d = np.zeros_like(w)
        d[:, k] = 1e-6
        assert g[:, k] == pytest.approx((loss(w + d) - loss(w - d)) / 2e-6, abs=1e-5)
    parts = [r.normal(size=(2, 40)) * 10.0 ** r.integers(-9, 9) for _ in range(30)]
    a, b = (sum(neural.whole(p) for p in own) for own in (parts, parts[::-1]))
    assert (a == b).all() and neural.read(a) == pytest.approx(np.sum(parts, axis=0), rel=1e-12, abs=1e-13)
    for far in (1e13, np.nan, np.inf):
        lost = neural.read(a + neural.whole(np.array([[far] * 40, [1.0] * 40])))
        assert np.isinf(lost[0]).all() and np.isfinite(lost[1]).all()
    with pytest.raises(OverflowError, match="not scaled"):
        neural.Descent(np.zeros((1, 3))).told(np.array([np.inf]), np.zeros((1, 3)))


def test_descent_finds_the_least_point_of_a_quadratic():
    r = np.random.default_rng(4)
    a = r.normal(size=(2, 8, 8))
    a, b = np.einsum("kij,klj->kil", a, a) + np.eye(8), r.normal(size=(2, 8))
    d = neural.Descent(np.zeros((2, 8)), tolerance=1e-9)
    for _ in range(200):
        if d.live:
            w, i = d.trial, d.live
            d.told(np.einsum("ki,kij,kj->k", w, a[i], w) / 2 - (b[i] * w).sum(1), np.einsum("kij,kj->ki", a[i], w) - b[i])
    assert d.w == pytest.approx(np.stack([np.linalg.solve(p, q) for p, q in zip(a, b, strict=True)]), abs=1e-4)


def test_neural_baseline_without_rows_or_networks(snaps):
    ex = tensors.examples(manifest(snaps, anchors_per_trajectory=1), tensors.checked_snapshots(snaps)).cache()
    assert baselines.mlp_forecast(ex, ex.limit(0)).count() == 0
    got, last = ({(r.sample_id, r.query_pos, r.feature_index): r.prediction for r in p.collect()} for p in (baselines.mlp_forecast(ex.limit(0), ex), baselines.persistence(ex)))
    assert got == last


def test_forecast_query_reads_waveforms_once(spark, monkeypatch):
    from spindle.plans import catalog

    monkeypatch.setattr(catalog.baselines, "mlp_forecast", lambda train, test: (train, test))
    for ex in catalog.QUERIES["mlp_forecast"](spark, "/root/testdata/sf0.001"):
        assert "_wave(" not in ex._jdf.queryExecution().optimizedPlan().toString() and ex.count() > 0
