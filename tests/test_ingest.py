import pytest

from spindle.operators import metadata
from spindle.schemas import SIGNAL_COLUMNS
from spindle.sources import raw_files

HEAD = ",".join(SIGNAL_COLUMNS)


def tree(tmp_path, files):
    for name, text in files.items():
        p = tmp_path / "35Hz12kN" / "Bearing1_1" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(text if isinstance(text, bytes) else text.encode())
    return str(tmp_path)


def run(spark, root, expected=2):
    p = raw_files.parsed(raw_files.discover(spark, root)).cache()
    return raw_files.observations(p).orderBy("measurement_index", "channel_id").collect(), {r.source_relative_path.split("/")[-1]: r for r in raw_files.source_manifest(p, expected).collect()}, p


def test_good_gap_and_order(spark, tmp_path):
    root = tree(tmp_path, {"1.csv": f"{HEAD}\n1,2\n3,4\n", "10.csv": f"{HEAD}\n1,2\n3,4\n", "3.CSV": f"{HEAD}\n5,6\n7,8\n"})
    obs, man, p = run(spark, root)
    assert [r.measurement_index for r in obs] == [1, 1, 3, 3, 10, 10] and obs[2].elapsed_time_sec == 120.0
    assert obs[0].vibration_signal == [1.0, 3.0] and obs[1].channel_id == "vertical" and obs[1].vibration_signal == [2.0, 4.0]
    assert obs[0].rotational_speed_rpm == 2100.0 and all(r.parse_status == "ok" and r.warnings == [] for r in man.values())
    assert raw_files.summary(raw_files.source_manifest(p, 2)).first().observations == 6


def test_faulty_files_are_rows(spark, tmp_path):
    root = tree(tmp_path, {
        "1.csv": f"{HEAD}\n1,2\n", "2.csv": "wrong,header\n1,2\n", "3.csv": f"{HEAD}\n1\n", "4.csv": f"{HEAD}\n1,abc\n", "5.csv": f"{HEAD}\n1,nan\n", "6.csv": f"{HEAD}\n1,1e39\n", "7.csv": f"{HEAD}\n1.0d,2\n",
        "8.csv": f"{HEAD}\n", "9.csv": "", "x.csv": f"{HEAD}\n1,2\n", "11.csv": f"{HEAD}\n1,2\n", "011.csv": f"{HEAD}\n1,2\n", "12.csv": f"{SIGNAL_COLUMNS[1]},{SIGNAL_COLUMNS[0]}\n\n2,1_0\n",
        "13.csv": b"\xef\xbb\xbf" + f"{HEAD}\n1,2\n".encode(), "14.csv": f"{SIGNAL_COLUMNS[0]},{SIGNAL_COLUMNS[0]}\n1,2\n"})
    obs, man, _ = run(spark, root)
    ok = {k for k, r in man.items() if r.parse_status == "ok"}
    assert ok == {"1.csv", "12.csv", "13.csv"} and len(obs) == 6 and len(man["1.csv"].warnings) == 1
    swapped = [r for r in obs if r.measurement_index == 12]
    assert swapped[0].vibration_signal == [10.0] and swapped[1].vibration_signal == [2.0]
    assert man["4.csv"].error.startswith("line 2") and man["11.csv"].error == man["011.csv"].error and man["2.csv"].source_row_count is None


CONFIG = ",".join(metadata.CONFIG) + "\nXJTU-SY,condition_1,Bearing1_1,2,2 h 3 min,123,Outer race,outer_race; inner_race,TRUE,paper,table 1,high,\n"


def test_metadata(spark, tmp_path):
    path = tmp_path / "m.csv"
    path.write_text(CONFIG)
    man = spark.createDataFrame([("condition_1", "Bearing1_1", 1, "ok"), ("condition_1", "Bearing1_1", 4, "ok"), ("condition_1", "Bearing1_1", 5, "error")], "experiment_id string, bearing_id string, measurement_index long, parse_status string")
    r = metadata.trajectory_metadata(metadata.read_config(spark, str(path)), man).first()
    assert r.fault_elements == ["outer_race", "inner_race"] and r.failure_observed is True and (r.parsed_measurement_count, r.first_measurement_index, r.last_measurement_index) == (2, 1, 4)
    with pytest.raises(ValueError):
        metadata.trajectory_metadata(metadata.read_config(spark, str(path)), man.union(spark.createDataFrame([("condition_2", "B", 1, "ok")], man.schema)))
    bad = tmp_path / "bad.csv"
    bad.write_text(CONFIG.replace("TRUE", "yes").replace("inner_race,", "gear,"))
    assert set(metadata.typed(metadata.read_config(spark, str(bad))).first().broken) == {"failure_observed", "fault_elements"}
