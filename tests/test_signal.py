import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from spindle.functions.hashing import sample_id, stable_int, stable_seed
from spindle.functions.signal import spectral_statistics, time_features, wave_features
from spindle.schemas import CHANNEL_FEATURES


def stats(spark, x):
    df = spark.createDataFrame([(x,)], "x array<float>").select(*[v.alias(k) for k, v in time_features(F.col("x")).items()])
    return df.first().asDict()


def test_definition_vector(spark):
    r = stats(spark, [-1.0, 0.0, 1.0, 0.0])
    assert r["std"] == pytest.approx(math.sqrt(0.5)) and r["kurtosis"] == pytest.approx(2.0) and r["crest_factor"] == pytest.approx(math.sqrt(2.0))
    assert r["peak_to_peak"] == 2.0 and r["mean"] == 0.0


@pytest.mark.parametrize("x", [[], [float("nan"), 1.0], [float("inf")]])
def test_undefined_is_nan(spark, x):
    assert all(math.isnan(v) for v in stats(spark, x).values())


def test_constant_signal_has_no_kurtosis(spark):
    r = stats(spark, [2.0] * 8)
    assert math.isnan(r["kurtosis"]) and r["std"] == 0.0 and r["crest_factor"] == pytest.approx(1.0)


def test_time_features_equal_numpy(spark):
    x = np.random.default_rng(1).normal(size=200).astype(np.float32).astype(np.float64)
    r = stats(spark, [float(v) for v in x])
    assert r["rms"] == pytest.approx(np.sqrt((x * x).mean())) and r["kurtosis"] == pytest.approx(((x - x.mean()) ** 4).mean() / x.var() ** 2)


def test_spectrum_finds_its_tone_and_first_of_ties():
    n = np.arange(64)
    one = lambda x, rate: tuple(spectral_statistics(np.array([x], dtype=np.float64), rate)[0])
    row = one(np.sin(2 * np.pi * 8 * n / 64), 25_600.0)
    assert row[0] == 3200.0 and row[1] == pytest.approx(1.0, rel=0.05) and row[5] == pytest.approx(row[2], rel=1e-3)
    assert one(np.zeros(8), 100.0)[:3] == (12.5, 0.0, 0.0) and math.isnan(one(np.zeros(8), 100.0)[3])
    assert all(math.isnan(v) for v in one(np.ones(1), 100.0)) and all(math.isnan(v) for v in one(np.ones(4), 0.0))


def test_stacked_signals_equal_single_ones(spark):
    """Signals of many lengths and rates, whole 32,768-sample ones among them, against sums over a plain Fourier transform."""
    r = np.random.default_rng(5)
    rows = [(i, [float(v) for v in np.float32(r.normal(size=n))], rate) for i, (n, rate) in enumerate([(64, 25_600.0), (65, 25_600.0), (32_768, 25_600.0), (64, 8_000.0), (2, 100.0), (0, 100.0), (7, -1.0), (64, 25_600.0), (32_768, 25_600.0)])]
    df = spark.createDataFrame([*rows, (9, None, 1.0), (10, [1.0, float("nan")], 10.0)], "i int, x array<float>, rate double").repartition(2)
    got = {x.i: x for x in df.select("i", *[v.alias(k) for k, v in wave_features(F.col("x"), F.col("rate")).items()]).collect()}
    assert all(math.isnan(got[i][n]) for i in (5, 9, 10) for n in CHANNEL_FEATURES)
    for i, x, rate in rows:
        x, n = np.array(x), len(x)
        if n:
            assert got[i]["std"] == pytest.approx(x.std()) and got[i]["peak_to_peak"] == pytest.approx(x.max() - x.min())
        if n < 2 or rate <= 0:
            assert math.isnan(got[i]["spectral_entropy"])
            continue
        w = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / (n - 1)) if n > 2 else np.ones(n)
        f = np.abs(np.fft.fft((x - x.mean()) * w))[: n // 2 + 1] / w.sum()
        f[1 : (n + 1) // 2] *= 2
        hz = np.arange(len(f)) * rate / n
        p = f * f / (f * f).sum()
        assert got[i]["total_spectral_power"] == pytest.approx((f * f).sum()) and got[i]["spectral_entropy"] == pytest.approx(-(p[p > 0] * np.log(p[p > 0])).sum() / np.log(len(f)))
        assert got[i]["dominant_frequency_hz"] == pytest.approx(hz[1:][f[1:].argmax()]) and got[i]["band_power_1000_5000_hz"] == pytest.approx((f * f)[(hz >= 1000) & ((hz < 5000) | (rate <= 10_000))].sum())


def test_identifiers_equal_hashlib(spark):
    import hashlib

    parts = [("a", i) for i in range(50)]
    df = spark.createDataFrame(parts, "a string, i long")
    got = df.select("i", stable_seed(F.col("a"), F.col("i")).alias("s"), sample_id(F.col("a"), F.col("i")).alias("d"), stable_int(F.concat(F.lit('["'), "a", F.lit('",'), "i", F.lit("]"))).alias("n")).collect()
    for r in got:
        h = hashlib.sha256(f"a|{r.i}".encode())
        assert r.s == int.from_bytes(h.digest()[:8], "little") & (2**63 - 1) and r.d == h.hexdigest()[:24]
        assert r.n == int.from_bytes(hashlib.sha256(f'["a",{r.i}]'.encode()).digest()[:8], "big") % (2**63 - 1)


def test_median_spectra_take_one_python_step(spark):
    from spindle.operators import eda
    from spindle.sources.driver_tables import waves

    w = waves(spark, "/root/testdata/sf0.001")
    got, want = eda.median_spectrum_of(w), eda.median_spectrum_db(eda.fft_rows(w))
    steps = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython")
    assert steps(got) < steps(want)
    key = lambda df: {tuple(r[:3]): r[3] for r in df.select("channel_id", "fraction", "point", "median_db").collect()}
    assert key(got) == key(want)
