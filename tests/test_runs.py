import json
import shutil

import pytest
from pyspark.sql import functions as F

from spindle.operators import features
from spindle.plans import cli, runs
from spindle.sources.driver_tables import waves

SF = "/root/testdata/sf0.001"


def test_from_observations_to_metrics(spark, tmp_path):
    out = str(tmp_path)
    runs.save(waves(spark, SF), f"{out}/obs")
    summary = runs.build_features(spark, f"{out}/obs", f"{out}/f")["summary"]
    assert summary["status"] in ("pass", "pass_with_warnings") and summary["normalized_nonfinite_total"] == 0
    snaps = f"{out}/f/snapshot_features"
    assert runs.sample(spark, snaps, f"{out}/train", split="train", seed=3, anchors_per_trajectory=1)["samples"] == 8
    runs.sample(spark, snaps, f"{out}/test", split="test", seed=3, anchors_per_trajectory=1)
    good = runs.validate(spark, snaps, [f"{out}/train", f"{out}/test"], f"{out}/v.json", compare=f"{out}/train")
    assert good["status"] == "pass" and all(c["passed"] for c in good["checks"]) and json.load(open(f"{out}/v.json"))["status"] == "pass"
    bad = runs.validate(spark, f"{out}/none", [f"{out}/nothing"], f"{out}/v2.json")
    assert {i["code"] for i in bad["issues"]} == {"snapshot_read_error", "manifest_read_error"}
    m = runs.run_baselines(spark, snaps, f"{out}/train", [f"{out}/test"], f"{out}/b")
    assert {r.model for r in m.where("group = 'overall'").collect()} == {"persistence", "linear_trend", "small_mlp"}
    meta = waves(spark, SF).select("dataset_name", "experiment_id", "bearing_id").distinct().selectExpr("*", "1.0D reported_lifetime_min", "array('ball') fault_elements")
    runs.save(meta, f"{out}/meta")
    assert runs.explore(spark, f"{out}/obs", f"{out}/meta", f"{out}/e") == {"ran": ["time", "fft"]}
    assert runs.explore(spark, f"{out}/obs", f"{out}/meta", f"{out}/e") == {"ran": []}
    made = spark.read.parquet(f"{out}/e/fft_summary")
    assert made.count() == 330 and {"total_spectral_power", "band_power_0_1000_hz", "fault_elements", "geometry_status"} <= set(made.columns)
    whole = made.selectExpr("abs(total_spectral_power - band_power_0_1000_hz - band_power_1000_5000_hz - band_power_5000_10000_hz - band_power_10000_12800_hz) <= 1e-9 * total_spectral_power ok")
    assert whole.where("not ok").count() == 0
    geo = tmp_path / "g.yaml"
    geo.write_text("bearing_model: LDK UER204\nnumber_of_rolling_elements: 8\nrolling_element_diameter_mm: 7.92\npitch_diameter_mm: 34.55\ncontact_angle_deg: 0\n")
    assert runs.explore(spark, f"{out}/obs", f"{out}/meta", f"{out}/e", geometry=str(geo)) == {"ran": ["fft"]}
    told = json.load(open(f"{out}/e/eda_report.json"))
    assert told["reused"] == ["time"] and told["geometry"]["n"] == 8.0 and sum(x["spectra"] for x in told["spectra"]) == 330
    shutil.rmtree(f"{out}/e/time_summary")
    assert runs.explore(spark, f"{out}/obs", f"{out}/meta", f"{out}/e", geometry=str(geo)) == {"ran": ["time"]}
    ok = waves(spark, SF).select("experiment_id", "bearing_id", "measurement_index").distinct().where("measurement_index > 1").withColumn("parse_status", F.lit("ok"))
    runs.save(ok, f"{out}/man")
    assert runs.explore(spark, f"{out}/obs", f"{out}/meta", f"{out}/e", geometry=str(geo), manifest=f"{out}/man") == {"ran": ["fft"]}
    assert spark.read.parquet(f"{out}/e/fft_summary").agg(F.min("measurement_index")).first()[0] == 2
    runs.save(meta.withColumn("failure_observed", F.lit(True)), f"{out}/meta")  # a replaced file is noticed
    assert runs.explore(spark, f"{out}/obs", f"{out}/meta", f"{out}/e", geometry=str(geo), manifest=f"{out}/man") == {"ran": ["time", "fft"]}
    with pytest.raises(FileNotFoundError):
        runs.explore(spark, f"{out}/nothing", f"{out}/meta", f"{out}/e")


def test_runs_refuse_broken_inputs(spark, tmp_path):
    out = str(tmp_path)
    feats = features.observation_features(waves(spark, SF))
    snaps = runs.save(features.snapshots(feats, features.fit_scaler(feats)), f"{out}/snaps")
    runs.sample(spark, f"{out}/snaps", f"{out}/train", split="train", seed=3, anchors_per_trajectory=1)
    train = spark.read.parquet(f"{out}/train")
    for name, broken in (("v", snaps.withColumn("feature_schema_version", F.lit("v0"))), ("d", snaps.union(snaps)), ("n", snaps.withColumn("feature_vector", F.transform("feature_vector", lambda x: F.lit(float("nan")).cast("float")))), ("c", snaps.drop("split")), ("t", snaps.withColumn("elapsed_time_sec", F.lit(float("inf"))))):
        runs.save(broken, f"{out}/{name}")
        if name != "d":
            with pytest.raises(ValueError):
                runs.sample(spark, f"{out}/{name}", f"{out}/none", split="train", seed=3, anchors_per_trajectory=1)
            assert not runs.exists(f"{out}/none")
        with pytest.raises(ValueError):
            runs.run_baselines(spark, f"{out}/{name}", f"{out}/train", [f"{out}/train"], f"{out}/b")
    with pytest.raises(ValueError, match="no eligible"):
        runs.save(snaps.where("measurement_index < 4"), f"{out}/few")
        runs.sample(spark, f"{out}/few", f"{out}/none", split="train", seed=3, anchors_per_trajectory=1)
    assert not runs.exists(f"{out}/none")
    for name, change in (("missing", snaps.where("measurement_index <> 5")), ("split", snaps.withColumn("split", F.when(F.col("measurement_index") == 5, "test").otherwise(F.col("split"))))):
        runs.save(change, f"{out}/{name}")
        with pytest.raises(ValueError, match="refers to"):
            runs.run_baselines(spark, f"{out}/{name}", f"{out}/train", [f"{out}/train"], f"{out}/b")
    assert train.count() == 8


def test_sensitivity_run_and_shapes(spark, tmp_path):
    from spindle.schemas import DIMENSION, FEATURE_VERSION, SNAPSHOT

    out = str(tmp_path)
    rows = [("d", "condition_3", "Bearing3_1", i, (i - 1) * 60.0, "test", 2400.0, 10.0, True, True, FEATURE_VERSION, DIMENSION, [float(i)] * DIMENSION, [float(i)] * DIMENSION, [True] * DIMENSION) for i in range(1, 61)]
    runs.save(spark.createDataFrame(rows, SNAPSHOT), f"{out}/s")
    m = runs.prepare_sensitivity(spark, f"{out}/s", f"{out}/m", regimes=("dense", "sparse_1"), anchor_cap=1)
    point = F.transform("future_measurement_indices", lambda i: F.array_repeat(i.cast("double") + 1, DIMENSION))
    good = m.select("sample_id", point.alias("predicted_features"))
    runs.save(good, f"{out}/good")
    got = runs.evaluate_sensitivity(spark, f"{out}/s", f"{out}/m", {"a": f"{out}/good"}, f"{out}/r")
    assert got["missing_predictions"] == [{"model": "a", "n_missing": 0}] and {r.mae for r in spark.read.parquet(f"{out}/r/metrics").collect()} == {1.0}
    assert "</html>" not in open(f"{out}/r/dashboard.html").read() and json.load(open(f"{out}/r/report.json"))["manifest_rows"] == m.count()
    p = F.col("predicted_features")
    for k, bad in enumerate((F.slice(p, 2, 100), F.transform(p, lambda x: F.slice(x, 1, 29)), F.transform(p, lambda x: F.transform(x, lambda v: F.lit(float("nan")))), F.lit(None).cast("array<array<double>>"))):
        runs.save(good.withColumn("predicted_features", bad), f"{out}/bad{k}")
        with pytest.raises(ValueError, match="another shape"):
            runs.evaluate_sensitivity(spark, f"{out}/s", f"{out}/m", {"a": f"{out}/bad{k}"}, f"{out}/r2")
    runs.save(good.union(good), f"{out}/twice")
    with pytest.raises(ValueError, match="twice"):
        runs.evaluate_sensitivity(spark, f"{out}/s", f"{out}/m", {"a": f"{out}/twice"}, f"{out}/r2")


def test_parse_run_and_command_line(spark, tmp_path, capsys):
    raw, out = tmp_path / "raw", str(tmp_path / "out")
    head = "Horizontal_vibration_signals,Vertical_vibration_signals\n"
    for name, text in (("35Hz12kN/Bearing1_1/1.csv", head + "1,2\n"), ("35Hz12kN/Bearing1_1/3.csv", "bad\n"), ("35Hz12kN/Bearing1_1/deep/2.csv", head + "1,2\n"), ("35Hz12kN/4.csv", head + "1,2\n"), ("other/Bearing9_1/1.csv", head + "1,2\n"), ("x/35Hz12kN/Bearing1_1/9.csv", head + "1,2\n")):
        (raw / name).parent.mkdir(parents=True, exist_ok=True)
        (raw / name).write_text(text)
    assert cli.main(["parse", str(raw), out, "--allow-errors"]) == 0 and cli.main(["parse", str(raw), out]) == 1
    told = json.load(open(f"{out}/parse_report.json"))
    assert told["summary"]["files"] == 2 and told["ignored_conditions"] == ["other", "x"] and told["missing_conditions"] == ["37.5Hz11kN", "40Hz10kN"]
    assert told["errors"]["rows"] == 1 and told["gaps"]["first"] == [{"experiment_id": "condition_1", "bearing_id": "Bearing1_1", "missing": 1}]
    with pytest.raises(FileNotFoundError):
        runs.parse(spark, f"{raw}/nothing", out)
    config = tmp_path / "m.csv"
    from spindle.operators import metadata

    config.write_text(",".join(metadata.CONFIG) + "\nXJTU-SY,condition_1,Bearing1_1,2,2 h 3 min,123,Outer race,outer_race,TRUE,paper,table 1,high,\n")
    assert cli.main(["metadata", str(config), f"{out}/source_manifest", f"{out}/meta"]) == 0
    assert spark.read.parquet(f"{out}/meta/trajectory_metadata").first().parsed_measurement_count == 1
    runs.save(waves(spark, SF), f"{out}/obs")
    assert cli.main(["features", f"{out}/obs", f"{out}/f"]) == 0
    snaps = f"{out}/f/snapshot_features"
    assert cli.main(["sample", snaps, f"{out}/tr", "--split", "train", "--seed", "1", "--anchors-per-trajectory", "1"]) == 0
    assert cli.main(["validate", snaps, f"{out}/v.json", "--manifests", f"{out}/tr"]) == 0
    with pytest.raises(ValueError, match="grid is empty"):  # so few records have no context
        cli.main(["prepare", snaps, f"{out}/grid", "--anchor-cap", "1"])
    capsys.readouterr()


def test_ingest_command_line(spark, tmp_path, capsys):
    (tmp_path / "35Hz12kN/Bearing1_1").mkdir(parents=True)
    (tmp_path / "35Hz12kN/Bearing1_1/1.csv").write_text("Horizontal_vibration_signals,Vertical_vibration_signals\n1,2\n")
    for n in (1, 0):
        assert cli.main(["ingest", str(tmp_path), str(tmp_path / "out")]) == 0 and json.loads(capsys.readouterr().out)["parsed"] == n


def test_baselines_need_evaluations(spark, tmp_path):
    with pytest.raises(ValueError, match="no evaluation"):
        runs.run_baselines(spark, "s", "t", [], str(tmp_path))


def test_prediction_specs():
    assert runs.prediction_specs(["a=/x/p", "/y/b.parquet"]) == {"a": "/x/p", "b": "/y/b.parquet"}
    with pytest.raises(ValueError):
        runs.prediction_specs(["a=/x", "a=/y"])


def test_dashboard_escapes_its_data(tmp_path):
    runs.dashboard(str(tmp_path / "d.html"), [{"model": "</script>", "split": "test", "sparse_regime": "dense"}])
    assert "</script>\"" not in (tmp_path / "d.html").read_text()


def test_command_line_knows_its_commands():
    a = cli.parser().parse_args(["sample", "s", "o", "--split", "train", "--seed", "1", "--anchors-per-trajectory", "2"])
    assert a.split == "train" and a.anchors_per_trajectory == 2 and not a.full_remaining_lifecycle
