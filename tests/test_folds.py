"""Folds without one group, and near-duplicates across splits, against direct computation."""

import random

import numpy as np
import pytest

from spindle.operators import folds, leakage


def test_each_fold_equals_a_direct_fit(spark):
    r = random.Random(3)
    rows = [(c, b, 1e6 + r.gauss(0, 1), r.choice([5.0, float("nan"), None]), float(c == "x")) for c in "xy" for b in "123" for _ in range(r.randint(1, 30))] + [("z", "1", None, None, 7.0)]
    df = spark.createDataFrame(rows, "c string, b string, p double, q double, s double")
    for by in (["c"], ["c", "b"]):
        own = {r[: len(by)] for r in rows}
        got = {(tuple(x[k] for k in by), x.name): (x.n, x["mean"], x["scale"]) for x in folds.fold_scalers(df, by, ("p", "q", "s")).collect()}
        assert set(got) == {(g, n) for g in own for n in "pqs"}
        for (g, name), (n, mean, scale) in got.items():
            v = np.array([x["pqs".index(name) + 2] for x in rows if x[: len(by)] != g and x["pqs".index(name) + 2] is not None], float)
            v = v[np.isfinite(v)]
            assert n == len(v) and mean == pytest.approx(v.mean() if n else 0.0, abs=1e-9) and scale == pytest.approx(v.std() if n and v.std() > 0 else 1.0, rel=1e-7)


def test_fold_metrics_leave_one_group_out(spark):
    r = random.Random(4)
    rows = [(m, b, round(r.gauss(0, 2), 6)) for m in "uv" for b in "123" for _ in range(r.randint(1, 20))] + [("w", "1", 1.0)]
    got = {(x.m, x.b): (x.n, x.mae, x.rmse) for x in folds.fold_metrics(spark.createDataFrame(rows, "m string, b string, e double"), ["m"], ["b"]).collect()}
    assert set(got) == {(m, b) for m in "uv" for b in "123"}
    for (m, b), (n, mae, rmse) in got.items():
        e = np.array([x[2] for x in rows if x[0] == m and x[1] != b])
        assert n == len(e) and mae == pytest.approx(np.abs(e).mean(), abs=1e-8) and rmse == pytest.approx(np.sqrt((e * e).mean()), abs=1e-8)


def test_near_duplicates_across_splits_equal_brute_force(spark):
    r = np.random.default_rng(5)
    base = r.normal(size=(300, 30))
    v = np.concatenate([base, base[:150] + r.normal(size=(150, 30)) * r.choice([0.01, 0.03, 0.06], (150, 1)), np.repeat(base[:1], 400, axis=0), base[1:3], np.zeros((1, 30)), np.full((1, 30), np.nan)])
    rows = [(i, ("test", "train", "validation")[int(k)], [float(a) for a in x]) for i, (x, k) in enumerate(zip(v, r.integers(0, 3, len(v)), strict=True))]
    df = spark.createDataFrame([*rows, (9999, None, rows[0][2]), (9998, "train", None)], "id long, split string, vector array<double>")
    got = {(x.first_split, x.second_split, x.first_id, x.second_id, x.first_count, x.second_count): x.similarity for x in leakage.split_near_duplicates(df, "id").collect()}
    held = {}
    for i, s, x in rows:
        if 0 < np.linalg.norm(x) < np.inf:
            held.setdefault((s, tuple(x)), []).append(i)
    want = {}
    keys = sorted(held)
    for (s, x) in keys:
        for (t, y) in keys:
            if s < t:
                c = 1.0 if x == y else np.dot(x, y) / np.linalg.norm(x) / np.linalg.norm(y)
                if c >= 0.999:
                    want[s, t, min(held[s, x]), min(held[t, y]), len(held[s, x]), len(held[t, y])] = c
    assert set(got) <= set(want) and len(got) >= 0.999 * len(want) > 30 and all(got[k] == pytest.approx(want[k], abs=1e-12) for k in got)
    assert leakage.recall(0.999) > 0.9999 and leakage.split_near_duplicates(df.limit(0), "id").count() == 0
    with pytest.raises(ValueError, match="similarity"):
        leakage.split_near_duplicates(df, "id", 1.5)
