"""Distances of distributions against the kernel's quadratic form over all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from spindle.operators import distances


def quadratic(a, b, bandwidth):
    k = lambda x, y: np.exp(-((x[:, None] - y[None]) ** 2).sum(2) / (2 * bandwidth**2)).mean()
    return k(a, a) + k(b, b) - 2 * k(a, b)


def table(spark, groups):
    rows = [(g, flag, [float(v) for v in x]) for g, sides in groups.items() for flag, side in zip((False, True), sides, strict=True) for x in side]
    return spark.createDataFrame(rows, "g string, generated boolean, window array<double>")


def test_distance_equals_the_quadratic_form(spark):
    r = np.random.default_rng(1)
    groups = {"same": (r.normal(size=(400, 6)), r.normal(size=(300, 6))), "moved": (r.normal(size=(400, 6)), r.normal(size=(300, 6)) + 1), "wide": (r.normal(size=(50, 6)), 3 * r.normal(size=(500, 6))), "equal": (np.ones((3, 6)), np.ones((9, 6)))}
    df = table(spark, groups)
    got = {x.g: x for x in distances.mmd(df, ["g"], frequencies=2048).collect()}
    for g, (a, b) in groups.items():
        assert (got[g].n_real, got[g].n_generated) == (len(a), len(b))
        assert got[g].mmd2 == pytest.approx(quadratic(a, b, 6**0.5), abs=0.02)
    assert got["equal"].mmd2 == 0 and got["moved"].mmd2 > 10 * got["same"].mmd2


def test_sums_do_not_depend_on_partitions_and_repeat_the_projections(spark):
    r = np.random.default_rng(2)
    a, b = r.normal(size=(120, 5)), r.normal(size=(80, 5)) * 2
    df = table(spark, {"x": (a, b)})
    one, many = (distances.mmd(df.repartition(n), ["g"], 1.5, 64, seed=9).first() for n in (1, 13))
    assert one[:3] == many[:3] and one.mmd2 == pytest.approx(many.mmd2, abs=1e-11)
    w = distances.projections(5, 64, 1.5, 9)
    z = lambda x: np.concatenate([np.cos(x @ w), np.sin(x @ w)], 1).mean(0)
    assert one.mmd2 == pytest.approx(((z(a) - z(b)) ** 2).sum() / 64, abs=1e-10)
    assert abs(w.std() * 1.5 - 1) < 0.15 and (w != distances.projections(5, 64, 1.5, 8)).any()


def test_odd_rows_and_sides(spark):
    df = spark.createDataFrame([("a", False, [1.0, 2.0]), ("a", True, [1.0, 2.0]), ("a", True, [float("nan"), 1.0]), ("a", False, None), ("a", None, [5.0, 5.0]), ("a", True, [None, 1.0]), ("a", True, []),
                                ("b", False, [1.0, 2.0]), (None, True, [1.0, 2.0, 3.0]), (None, False, [1.0, 2.0, 3.0]), ("c", False, None)], "g string, generated boolean, window array<double>")
    got = {x.g: (x.n_real, x.n_generated, x.mmd2) for x in distances.mmd(df, ["g"]).collect()}
    assert got == {"a": (1, 1, 0.0), "b": (1, 0, None), None: (1, 1, 0.0)}
    assert distances.mmd(df.limit(0), ["g"]).count() == 0
    assert distances.mmd(df.where("size(window) = 2"), []).first().n_real == 2
    with pytest.raises(ValueError, match="positive"):
        distances.mmd(df, ["g"], bandwidth=0.0)
    with pytest.raises(Exception, match="several lengths"):
        distances.mmd(df.withColumn("g", F.lit("z")), ["g"]).collect()


def test_forecasts_that_hit_have_no_distance(spark):
    cells = [(s, q, f, float(s * 7 % 5 + q + f), f != 2) for s in range(30) for q in range(2) for f in range(3)]
    target = spark.createDataFrame([(str(s), q, 60.0, f, x if ok else None, ok) for s, q, f, x, ok in cells], "sample_id string, query_pos int, query_time double, feature_index int, target double, valid boolean")
    made = spark.createDataFrame([(m, str(s), q, f, x + off) for m, off in (("hit", 0.0), ("miss", 4.0)) for s, q, f, x, _ in cells], "model string, sample_id string, query_pos int, feature_index int, prediction double")
    keys = target.select("sample_id").distinct().withColumn("split", F.lit("test"))
    got = {x.model: x for x in distances.forecast_distances(target, made, keys, ["split"]).collect()}
    assert got["hit"].mmd2 == 0 and got["miss"].mmd2 > 0.1 and got["miss"].n_real == got["miss"].n_generated == 60
