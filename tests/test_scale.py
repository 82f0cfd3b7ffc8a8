"""Band joins, exact order statistics, drawn places and exact sums: against their definitions, and how much they read."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spindle.operators import eda, sampling, selection, sensitivity, tensors, windows
from spindle.schemas import DIMENSION, FEATURE_VERSION, SNAPSHOT


def trajectory(spark, n, ids=1):
    return spark.range(n).select(F.pmod("id", F.lit(ids)).cast("string").alias("b"), F.floor(F.col("id") / ids + 1).alias("measurement_index"), (F.floor(F.col("id") / ids) * 60.0).alias("elapsed_time_sec"))


def test_band_join_of_one_long_trajectory_stays_near_its_result(spark):
    t = trajectory(spark, 200_000)
    later = t.select("b", F.col("measurement_index").alias("future_index"), F.col("elapsed_time_sec").alias("future_time"))
    result = windows.future_pairs(t, t, ["b"], 900.0).count()
    assert result == sum(min(15, 199_999 - i) for i in range(200_000))
    assert windows.banded(t, later, ["b"], 900.0).count() <= 3 * result


def test_band_join_equals_its_definition(spark):
    r = random.Random(1)
    rows = [(b, i + 1, t) for b in "xy" for i, t in enumerate(sorted({r.choice([0.0, 0.1, 0.3, 7.0, 1e6]) + r.randrange(-40, 40) * r.choice([0.1, 1.0, 100.0]) for _ in range(60)}))]
    df = spark.createDataFrame(rows, "b string, measurement_index long, elapsed_time_sec double")
    for horizon in (0.3, 1.0, 100.0, 1e7):
        got = sorted((x.b, x.measurement_index, x.future_index) for x in windows.future_pairs(df, df, ["b"], horizon).collect())
        assert got == sorted((b, i, j) for b, i, t in rows for c, j, u in rows if b == c and t < u <= t + horizon)


@pytest.mark.parametrize("bins, gather", [(512, 2048), (4, 3), (2, 1)])
def test_quantiles_equal_numpy(spark, bins, gather):
    r = random.Random(2)
    data = {"even": [r.gauss(0, 1) for _ in range(200)], "one": [3.5], "same": [2.0] * 90, "ties": [float(r.randrange(4)) for _ in range(301)], "wide": [r.choice([-1, 1]) * 10.0 ** r.randrange(-300, 300) for _ in range(99)], "ends": [-1.7e308, 1.7e308, 0.0, 5e-324]}
    rows = [(k, v) for k, own in data.items() for v in own] + [("none", None), ("even", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    shares = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = {x.k: (x.n, x.q) for x in selection.quantiles(df, ["k"], "v", shares, bins, gather).collect()}
    assert set(got) == set(data)
    for k, own in data.items():
        own = sorted(own)
        want = []
        for s in shares:
            x = s * (len(own) - 1)
            a, b = math.floor(x), math.ceil(x)
            want.append(own[a] if a == b else (b - x) * own[a] + (x - a) * own[b])
        assert got[k] == (len(own), want)
    assert selection.quantiles(df.limit(0), ["k"], "v", [0.5]).count() == 0


def test_no_task_sorts_more_than_a_range(spark, monkeypatch):
    read, collect_list = [], selection.F.collect_list
    monkeypatch.setattr(selection.F, "collect_list", lambda c: read.append(c) or collect_list(c))
    df = spark.range(50_000).select(F.lit("k").alias("k"), F.when(F.col("id") % 2 == 0, F.lit(1.0)).otherwise(F.rand(3)).alias("v"))
    got = selection.quantiles(selection.checkpointed(df), ["k"], "v", [0.25, 0.75], gather=100).first()
    assert got.n == 50_000 and got.q[1] == 1.0 and got.q[0] == pytest.approx(0.5, abs=0.02) and len(read) <= 1


def test_drawn_places_are_sets_of_equal_chance(spark):
    n, q = 6, 3
    df = spark.range(6000).select(sampling.positions(F.lit(n).cast("long"), F.lit(q).cast("long"), F.concat(F.lit("s"), F.col("id"))).alias("p"))
    seen: dict = {}
    for r in df.collect():
        assert len(set(r.p)) == q and all(1 <= x <= n for x in r.p)
        seen[tuple(sorted(r.p))] = seen.get(tuple(sorted(r.p)), 0) + 1
    assert len(seen) == 20 and max(abs(k - 300) for k in seen.values()) < 5 * math.sqrt(300)


def snapshots(spark, rows):
    return spark.createDataFrame([("d", "condition_1", b, i, t, "train", 2100.0, 12.0, True, True, FEATURE_VERSION, DIMENSION, [float(i)] * DIMENSION, [float(i)] * DIMENSION, [True] * DIMENSION) for b, i, t in rows], SNAPSHOT)


def test_both_draws_take_later_rows_alone(spark):
    s = snapshots(spark, [("Bearing1_1", i, (i - 1) * 60.0) for i in range(1, 61)])
    for draws in ("positions", "ranks"):
        got = sampling.sample_manifest(s, split="train", seed=5, anchors_per_trajectory=None, draws=draws).collect()
        assert len(got) == 50 and all(1 <= r.future_query_count_q == len(set(r.future_query_measurement_indices)) <= min(8, 60 - r.anchor_measurement_index) for r in got)
        assert all(r.anchor_measurement_index < min(r.future_query_measurement_indices) and max(r.future_query_measurement_indices) <= 60 and r.future_query_measurement_indices == sorted(r.future_query_measurement_indices) for r in got)
    assert {r.sample_id: r.future_query_count_q for r in got} == {r.sample_id: r.future_query_count_q for r in sampling.sample_manifest(s, split="train", seed=5, anchors_per_trajectory=None).collect()}
    with pytest.raises(ValueError, match="draws"):
        sampling.sample_manifest(s, split="train", seed=5, anchors_per_trajectory=None, draws="none")


@pytest.mark.parametrize("rows", [[5, 5], [6, 5]])
def test_broken_chronology_raises(spark, rows):
    own = [("Bearing1_1", i, (i - 1) * 60.0) for i in range(1, 41)]
    own[10] = ("Bearing1_1", rows[1], 10 * 60.0 + 1.0)
    own[9] = ("Bearing1_1", rows[0], 9 * 60.0)
    s = snapshots(spark, own)
    for run in (lambda: sampling.sample_manifest(s, split="train", seed=5, anchors_per_trajectory=None), lambda: sensitivity.prepare(s, splits=("train",)), lambda: tensors.checked_snapshots(s)):
        with pytest.raises(ValueError, match="chronology|repeat"):
            run()


def test_metrics_are_equal_to_the_last_bit_in_any_partitioning(spark):
    s = snapshots(spark, [("Bearing1_1", i, (i - 1) * 60.0) for i in range(1, 61)]).withColumn("feature_vector", F.transform("feature_vector", lambda v, i: (F.sin(v * (i + 1)) * 3).cast("float")))
    m = sensitivity.prepare(s, splits=("train",), regimes=("dense", "sparse_5"), anchor_cap=3).cache()
    one = F.transform(F.sequence(F.lit(1), F.lit(DIMENSION)), lambda f: F.cos(f * F.length("sample_id") + F.crc32(F.col("sample_id").cast("binary")) % 97))
    flat = F.transform(F.sequence(F.lit(1), F.col("future_query_count_q")), lambda q: F.transform(one, lambda v: v / q))
    drawn = F.transform(F.sequence(F.lit(1), F.lit(7)), lambda k: F.transform(flat, lambda row: F.transform(row, lambda v: v * (k + 2) / 3 + F.sin(v * k))))
    pred = m.select(F.lit("a").alias("model"), "sample_id", flat.alias("predicted_features"), F.lit(None).cast("array<array<array<double>>>").alias("prediction_samples")).union(m.select(F.lit("b"), "sample_id", F.lit(None), drawn)).cache()
    got = []
    for parts in (1, 40):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        rows = sensitivity.evaluate(m.repartition(parts), s.repartition(parts), pred.repartition(parts)).collect()
        got.append(sorted(map(repr, rows)))
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert got[0] == got[1] and len(got[0]) > 20
    # one example by hand
    p = pred.where("model = 'b'").orderBy("sample_id").first()
    r = m.where(F.col("sample_id") == p.sample_id).first()
    v = {x.measurement_index: x.feature_vector for x in s.collect()}
    want, x = np.array([v[i] for i in r.future_measurement_indices]), np.array(p.prediction_samples)
    low, high = np.percentile(x, [5, 95], axis=0)
    e = sensitivity.errors(m, s, pred).where((F.col("model") == "b") & (F.col("sample_id") == p.sample_id)).first()
    assert float(e.a) / 1e9 == pytest.approx(np.abs(x.mean(axis=0) - want).sum(), abs=1e-8) and float(e.s) / 1e9 == pytest.approx(((x.mean(axis=0) - want) ** 2).sum(), abs=1e-8)
    assert e.n == want.size and e.cover / 1e12 == pytest.approx(((want >= low) & (want <= high)).mean()) and float(e.width) / 1e9 == pytest.approx((high - low).mean(), abs=1e-8)


def test_invalid_targets_and_null_intervals(spark):
    s = snapshots(spark, [("Bearing1_1", i, (i - 1) * 60.0) for i in range(1, 61)]).withColumn("feature_valid_mask", F.transform("feature_valid_mask", lambda m, i: (i == 2) & (F.col("measurement_index") != 60)))
    m = sensitivity.prepare(s, splits=("train",), anchor_cap=2)
    pred = m.select(F.lit("a").alias("model"), "sample_id", F.array_repeat(F.array_repeat(F.lit(1.0), DIMENSION), F.col("future_query_count_q")).alias("prediction_features"))
    for r in sensitivity.errors(m, s, pred).collect():
        assert r.cover is None and r.width is None and r.n > 0
    got = sensitivity.evaluate(m, s, pred).where("group_name = 'overall'").collect()
    assert got and all(r.coverage_90 is None and r.mae > 0 for r in got)


def test_geometry_file(tmp_path):
    path = tmp_path / "g.yaml"
    full = "# note\nbearing_model: LDK UER204\nnumber_of_rolling_elements: 8\nrolling_element_diameter_mm: 7.92 # mm\npitch_diameter_mm: 34.55\nsource: null\n"
    path.write_text(full, encoding="utf-8")
    assert eda.geometry(str(path)) == {"model": "LDK UER204", "n": 8.0, "d": 7.92, "D": 34.55, "angle": 0.0, "source": None} and eda.geometry(None) is None
    for text in (full.replace("8\n", "null\n", 1), full.replace("pitch_diameter_mm: 34.55\n", "")):
        path.write_text(text, encoding="utf-8")
        with pytest.raises(ValueError, match="lacks values"):
            eda.geometry(str(path))
    for text in (full.replace("34.55", "3.0"), full + "contact_angle_deg: 90\n", full.replace(": 8\n", ": 0\n")):
        path.write_text(text, encoding="utf-8")
        with pytest.raises(ValueError, match="impossible"):
            eda.geometry(str(path))


def test_grid_builds_no_pool_that_nobody_reads_and_sorts_bare_rows(spark):
    s = snapshots(spark, [("Bearing1_1", i, (i - 1) * 60.0) for i in range(1, 61)])
    text = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    m = sensitivity.prepare(s, splits=("train",), anchor_cap=2)
    assert "collect_list" not in text(m.select("sample_id", "context_count_k", "future_query_count_q"))
    lines = text(m).splitlines()
    wide, ranked = (next(n for n, line in enumerate(lines) if "Window" in line and x in line) for x in ("collect_list", "_r30"))
    assert wide < ranked and not any("Join" in line or "Sort" in line for line in lines[:wide])


def test_missing_predictions_made_in_place_are_those_of_the_join_in_one_pass(spark):
    s = snapshots(spark, [("Bearing1_1", i, (i - 1) * 60.0) for i in range(1, 61)])
    m = sensitivity.prepare(s, splits=("train",), regimes=("dense", "sparse_5"), anchor_cap=3)
    models = F.array_compact(F.array(F.when(F.substring("sample_id", 1, 1) > "5", F.lit("a")), F.lit("b")))
    got = sensitivity.missing_attached(m, models)
    want = sensitivity.missing_predictions(m, m.select("sample_id", F.explode(models).alias("model")))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and len(got.collect()) == 2
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_models_called_in_place_give_the_metrics_of_joined_predictions(spark):
    s = snapshots(spark, [(f"Bearing1_{b}", i, (i - 1) * 60.0) for b in (1, 2) for i in range(1, 51) if i % (b + 4)])
    s = s.withColumns({"feature_vector": F.transform("feature_vector", lambda v, i: (F.sin(v * (i + 1)) * 3).cast("float")), "feature_valid_mask": F.transform("feature_valid_mask", lambda m, i: (i + F.col("measurement_index")) % 3 != 0)})

    def point(ids, size):
        number = np.repeat([int(x[:2], 16) / 64 for x in ids.to_pylist()], size)[:, None]
        return np.array([x[0] not in "01" for x in ids.to_pylist()]), number.repeat(DIMENSION, axis=1), None

    def drawn(ids, size):
        return np.ones(len(ids), bool), None, point(ids, size)[1] + np.arange(5)[:, None, None] / 2 - 1

    n, one = F.conv(F.substring("sample_id", 1, 2), 16, 10).cast("double") / 64, lambda v: F.array_repeat(F.array_repeat(v, DIMENSION), F.col("future_query_count_q"))
    for cap in (None, 2):
        args = {"splits": ("train",), "regimes": ("dense", "sparse_5"), "seed": 3, "anchor_cap": cap}
        m = sensitivity.prepare(s, **args).cache()
        none = F.lit(None).cast("array<array<array<double>>>")
        pred = m.where("substring(sample_id, 1, 1) not in ('0', '1')").select(F.lit("a").alias("model"), "sample_id", one(n).alias("predicted_features"), none.alias("prediction_samples"))
        pred = pred.union(m.select(F.lit("b"), "sample_id", F.lit(None), F.array(*[one(n + i / 2 - 1) for i in range(5)])))
        want = sensitivity.evaluate(m, s, pred)
        got = sensitivity.evaluate_in_place(s, {"a": point, "b": drawn}, **args)
        key = lambda df: sorted((tuple(round(v, 8) if isinstance(v, float) else v for v in r) for r in df.select(sorted(want.columns)).collect()), key=repr)
        assert key(got) == key(want) and got.count() > 100
        assert "sample_id" not in got._jdf.queryExecution().optimizedPlan().toString()
    for wrong in (lambda ids, size: (np.ones(len(ids), bool), np.zeros((1, 2)), None), lambda ids, size: (np.ones(len(ids), bool), np.full((size.sum(), DIMENSION), np.nan), None), lambda ids, size: (np.ones(len(ids), bool), None, None)):
        with pytest.raises(Exception, match="another shape|neither"):
            sensitivity.evaluate_in_place(s, {"a": wrong}, splits=("train",)).collect()


def test_sums_of_errors_are_exact_at_any_size():
    at = np.array([0, 1, 0, 1, 0])
    for v in ([1.0, 2.0**52, 3.0, 5.0, 2.0**33 - 1], [2.0**100, 1.0, 2.0**90, 7.0, 4096.0]):
        assert sensitivity._totals(np.array(v), at, 2) == [int(v[0]) + int(v[2]) + int(v[4]), int(v[1]) + int(v[3])]
