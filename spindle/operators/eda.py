"""Exploration tables: time summaries, spectra at lifecycle anchors, bearing frequencies, plot data and stage keys."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindle.functions.signal import fft_summary, interpolate_on, spectrum_on, time_features
from spindle.operators.windows import lifecycle_anchors
from spindle.schemas import BANDS_HZ, MEASUREMENT, SPECTRAL_FEATURES, TRAJECTORY


def geometry(path: str | None) -> dict | None:
    """Bearing geometry from a flat YAML file of `name: value` lines; None without a file. A file with values missing, or impossible ones, raises."""
    if path is None:
        return None
    with open(path, encoding="utf-8") as f:  # a small file of the driver
        pairs = [line.split("#")[0].split(":", 1) for line in f if ":" in line.split("#")[0]]
    got = {k.strip(): v.strip().strip("'\"") for k, v in pairs}
    given = {k: v for k, v in got.items() if v not in ("", "null", "Null", "NULL", "~")}
    needed = ("bearing_model", "number_of_rolling_elements", "rolling_element_diameter_mm", "pitch_diameter_mm")
    if gone := [k for k in needed if k not in given]:
        raise ValueError(f"bearing geometry lacks values: {', '.join(gone)}")
    n, d, big = (float(given[k]) for k in needed[1:])
    angle = float(given.get("contact_angle_deg", 0.0))
    if not (n >= 1 and n == int(n) and d > 0 and big > d and 0 <= angle < 90):
        raise ValueError(f"impossible bearing geometry: {given}")
    return {"model": given["bearing_model"], "n": n, "d": d, "D": big, "angle": angle, "source": given.get("source")}


def bearing_frequencies(conditions: DataFrame, geo: dict | None) -> DataFrame:
    """Shaft, outer race, inner race, ball spin and cage frequencies (Hz) of each condition; null without geometry."""
    shaft = F.col("rotational_speed_rpm") / 60.0
    out = conditions.withColumn("shaft_hz", shaft)
    if geo is None:
        none = F.lit(None).cast("double")
        return out.withColumns({"bpfo_hz": none, "bpfi_hz": none, "bsf_hz": none, "ftf_hz": none, "geometry_status": F.lit("geometry_not_configured")})
    r = F.lit(geo["d"] / geo["D"]) * F.cos(F.radians(F.lit(geo["angle"])))
    return out.withColumns({
        "bpfo_hz": geo["n"] / 2 * shaft * (1 - r), "bpfi_hz": geo["n"] / 2 * shaft * (1 + r), "bsf_hz": geo["D"] / (2 * geo["d"]) * shaft * (1 - r * r), "ftf_hz": shaft / 2 * (1 - r), "geometry_status": F.lit("configured")})


#: What trajectory metadata says of faults.
FAULTS = ("fault_element_raw", "fault_elements", "failure_observed")


def time_summary(obs: DataFrame, meta: DataFrame) -> DataFrame:
    """Time statistics of each observation with its trajectory's lifetime and faults; an observation without metadata raises."""
    keys = meta.select(*TRAJECTORY, "reported_lifetime_min", *[c for c in FAULTS if c in meta.columns])
    if obs.join(keys, TRAJECTORY, "left_anti").limit(1).count():
        raise ValueError("observations without trajectory metadata")
    return obs.join(keys, TRAJECTORY).withColumns(time_features(F.col("vibration_signal"))).withColumn("duration_sec", F.col("signal_length") / F.col("sampling_rate_hz")).drop("vibration_signal")


def fft_rows(obs: DataFrame, manifest: DataFrame | None = None) -> DataFrame:
    """A spectrum for each trajectory, channel and anchor. Waveforms that no anchor asks for are dropped before the UDF.

    Anchors are places among the manifest's indices that were parsed; without a manifest, among those observed.
    """
    made = _at_anchors(obs, manifest).withColumn("s", fft_summary("vibration_signal", "sampling_rate_hz")).drop("vibration_signal")
    return made.withColumn("fraction", F.explode("fractions")).select(*MEASUREMENT, "channel_id", "fraction", "elapsed_time_sec", "rotational_speed_rpm", "sampling_rate_hz", "s.*")


def _at_anchors(obs: DataFrame, manifest: DataFrame | None = None) -> DataFrame:
    """The observations that an anchor asks for, with its fractions."""
    seen = obs if manifest is None else manifest.where("parse_status = 'ok' and measurement_index is not null").crossJoin(obs.select("dataset_name").limit(1))
    anchors = lifecycle_anchors(seen.select(*MEASUREMENT), TRAJECTORY)
    return obs.join(anchors.groupBy(*MEASUREMENT).agg(F.collect_list("fraction").alias("fractions")), MEASUREMENT)


def fft_report(fft: DataFrame, meta: DataFrame, geo: dict | None) -> DataFrame:
    """Spectra with the scalar powers of their channel, characteristic frequencies of their speed, and their trajectory's faults."""
    hz, amp = F.col("frequencies_hz"), F.col("magnitudes")
    power = lambda low, high, last: F.aggregate(F.zip_with(hz, amp, lambda f, m: F.when((f >= low) & ((f <= high) if last else (f < high)), m.cast("double") * m.cast("double")).otherwise(0.0)), F.lit(0.0), lambda s, v: s + v)
    powers = {"total_spectral_power": F.aggregate(amp, F.lit(0.0), lambda s, m: s + m.cast("double") * m.cast("double"))}
    for name, (low, high) in zip(SPECTRAL_FEATURES[4:], BANDS_HZ, strict=True):
        powers[name] = F.when(high >= F.col("sampling_rate_hz") / 2, power(low, high, True)).otherwise(power(low, high, False))
    keys = meta.select(*TRAJECTORY, *[c for c in FAULTS if c in meta.columns])
    return bearing_frequencies(fft.withColumns(powers), geo).join(keys, TRAJECTORY, "left")


def median_spectrum_db(fft: DataFrame, points: int = 512, top_hz: float = 12_800.0) -> DataFrame:
    """Median over bearings of the interpolated spectra, in dB, by channel, fraction and grid point."""
    return _medians(fft.select("channel_id", "fraction", interpolate_on(points, top_hz)("frequencies_hz", "magnitudes").alias("g")))


def median_spectrum_of(obs: DataFrame, points: int = 512, top_hz: float = 12_800.0) -> DataFrame:
    """`median_spectrum_db` of `fft_rows`, where nothing else is made of the spectra: one worker of Python for each task, to which waveforms go once."""
    made = _at_anchors(obs).select("channel_id", "fractions", spectrum_on(points, top_hz)("vibration_signal", "sampling_rate_hz").alias("g"))
    return _medians(made.select("channel_id", F.explode("fractions").alias("fraction"), "g"))


def _medians(spectra: DataFrame) -> DataFrame:
    rows = spectra.select("channel_id", "fraction", F.posexplode("g").alias("point", "m"))
    return rows.groupBy("channel_id", "fraction", "point").agg((20 * F.log10(F.median("m") + 1e-12)).alias("median_db"))


def lifecycle_series(summary: DataFrame) -> DataFrame:
    """The five plotted statistics of each bearing and channel by minutes."""
    return summary.select("bearing_id", "channel_id", (F.col("elapsed_time_sec") / 60.0).alias("minutes"), "rms", "std", "peak_abs", "kurtosis", "crest_factor").orderBy("bearing_id", "channel_id", "minutes")


def signature(spark: SparkSession, path: str) -> str:
    """A digest of the names, sizes and times of a table's files (their contents aren't read)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path)
    one = F.concat_ws("|", "path", F.col("length").cast("string"), F.col("modificationTime").cast("string"))
    return files.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.sha2(one, 256))), ""), 256)).first()[0]  # 64 bytes a file


def stage_key(version: str, **inputs) -> str:
    """A stage's cache key: of its version and the signatures of what it reads."""
    return hashlib.sha256(json.dumps([version, inputs], sort_keys=True).encode()).hexdigest()
