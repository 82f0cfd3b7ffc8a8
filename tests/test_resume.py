"""Ingestion that goes on where it stopped."""

import os

import pytest

from spindle.plans import ingest
from spindle.schemas import SIGNAL_COLUMNS

HEAD = ",".join(SIGNAL_COLUMNS)


def put(root, name, text, at=None):
    p = root / "35Hz12kN" / "Bearing1_1" / name
    p.parent.mkdir(parents=True, exist_ok=True)
    p.write_text(text)
    if at:
        os.utime(p, (at, at))


def state(spark, out):
    obs = sorted((r.measurement_index, r.channel_id, tuple(r.vibration_signal)) for r in ingest.observations(spark, out).collect())
    return obs, {r.source_relative_path.split("/")[-1]: r.parse_status for r in ingest.manifest(spark, out).collect()}


def test_only_new_files_are_parsed_and_a_killed_run_leaves_nothing_twice(spark, tmp_path, monkeypatch):
    raw, out = tmp_path / "raw", str(tmp_path / "out")
    for i in range(1, 41):
        put(raw, f"{i}.csv", f"{HEAD}\n{i},1\n2,3\n", 1_700_000_000)
    assert ingest.observations(spark, out) is None
    commit = ingest.commit
    monkeypatch.setattr(ingest, "commit", lambda *_: (_ for _ in ()).throw(RuntimeError("killed")))
    with pytest.raises(RuntimeError, match="killed"):
        ingest.ingest(spark, str(raw), out, expected=2)
    assert ingest.manifest(spark, out) is None  # nothing counts before its commit
    monkeypatch.setattr(ingest, "commit", commit)
    assert ingest.ingest(spark, str(raw), out, expected=2)["parsed"] == 40
    assert ingest.ingest(spark, str(raw), out, expected=2) == {"parsed": 0, "batch": None}
    obs, man = state(spark, out)
    assert len(obs) == 80 and len(man) == 40 and not os.path.exists(f"{out}/parsing")
    put(raw, "41.csv", f"{HEAD}\n9,9\n", 1_600_000_000)  # older than what is there
    assert ingest.ingest(spark, str(raw), out, expected=2)["parsed"] == 1
    put(raw, "7.csv", f"{HEAD}\n70,71\n", 1_700_000_001)  # changed
    put(raw, "08.csv", f"{HEAD}\n1,1\n")  # makes 8.csv a copy too
    put(raw, "x.csv", f"{HEAD}\n1,1\n")
    assert ingest.ingest(spark, str(raw), out, expected=2)["parsed"] == 4
    obs, man = state(spark, out)
    assert (7, "horizontal", (70.0,)) in obs and not any(r[0] == 8 for r in obs) and len(obs) == 80 and len(man) == 43
    assert {k for k, v in man.items() if v == "error"} == {"8.csv", "08.csv", "x.csv"}
    assert [c["files"] for c in ingest.commits(spark, out)] == [40, 1, 4] and ingest.ingest(spark, str(raw), out)["parsed"] == 0
