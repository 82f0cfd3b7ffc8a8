"""Schemas, key columns and fixed values of the data model."""

from __future__ import annotations

# Fixed values of the data model.
DATASET = "XJTU-SY"
CONDITIONS = (
    # source folder, experiment, speed in rpm, radial load in kN
    ("35Hz12kN", "condition_1", 2100.0, 12.0),
    ("37.5Hz11kN", "condition_2", 2250.0, 11.0),
    ("40Hz10kN", "condition_3", 2400.0, 10.0),
)
SIGNAL_COLUMNS = ("Horizontal_vibration_signals", "Vertical_vibration_signals")
SAMPLING_RATE_HZ = 25_600.0
SIGNAL_LENGTH = 32_768
RECORD_INTERVAL_SEC = 60.0
FEATURE_VERSION = "xjtu_feature_v1"
MANIFEST_VERSION = "xjtu_sample_manifest_v1"
EVAL_VERSION = "xjtu_context_horizon_eval_v1"
METRICS_VERSION = "xjtu_context_horizon_metrics_v1"
CHANNELS = ("horizontal", "vertical")
TIME_FEATURES = ("mean", "std", "rms", "peak_abs", "peak_to_peak", "kurtosis", "crest_factor")
SPECTRAL_FEATURES = (
    "dominant_frequency_hz", "dominant_amplitude", "total_spectral_power", "spectral_entropy",
    "band_power_0_1000_hz", "band_power_1000_5000_hz", "band_power_5000_10000_hz", "band_power_10000_12800_hz",
)
BANDS_HZ = ((0.0, 1_000.0), (1_000.0, 5_000.0), (5_000.0, 10_000.0), (10_000.0, 12_800.0))
VALIDATION_BEARINGS = ("Bearing1_5", "Bearing2_5")
FAULT_ELEMENTS = ("inner_race", "outer_race", "cage", "ball")
SPARSE_RETENTION = {"dense": 1.0, "sparse_10": 0.10, "sparse_5": 0.05, "sparse_1": 0.01}
LOOKBACK_SEC = 1800.0
MAX_CONTEXT, MIN_CONTEXT, MAX_FUTURE = 20, 10, 8
SHORT_CONTEXT = (3, 9)
HORIZON_EDGES_SEC = (300.0, 600.0, 1200.0, 1800.0, 3600.0)
HORIZON_LABELS = ("0-5m", "5-10m", "10-20m", "20-30m", "30-60m", "60m+")
CONTEXT_MINUTES = (30, 40, 50, 60)
HORIZON_RATIOS = (0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0)
CORRELATION_LIMIT, OUTLIER_LIMIT = 0.99, 7.0

CHANNEL_FEATURES = TIME_FEATURES + SPECTRAL_FEATURES
FEATURES = tuple(f"{c}__{n}" for c in CHANNELS for n in CHANNEL_FEATURES)
DIMENSION = len(FEATURES)
TRAJECTORY = ["dataset_name", "experiment_id", "bearing_id"]
MEASUREMENT = [*TRAJECTORY, "measurement_index"]

OBSERVATION = (
    "dataset_name string, experiment_id string, bearing_id string, measurement_index bigint, elapsed_time_sec double, "
    "rotational_speed_rpm double, radial_load_kn double, channel_id string, channel_direction string, "
    "sampling_rate_hz double, signal_length bigint, vibration_signal array<float>"
)
SOURCE_MANIFEST = (
    "source_relative_path string, file_sha256 string, file_size_bytes bigint, condition_source_name string, "
    "experiment_id string, bearing_id string, measurement_index bigint, source_columns array<string>, "
    "source_row_count bigint, horizontal_signal_length bigint, vertical_signal_length bigint, parse_status string, "
    "error string, warnings array<string>"
)
SNAPSHOT = (
    "dataset_name string, experiment_id string, bearing_id string, measurement_index bigint, elapsed_time_sec double, "
    "split string, rotational_speed_rpm double, radial_load_kn double, horizontal_present boolean, vertical_present boolean, "
    "feature_schema_version string, feature_dimension bigint, raw_feature_vector array<float>, feature_vector array<float>, "
    "feature_valid_mask array<boolean>"
)
TRAJECTORY_METADATA = (
    "dataset_name string, experiment_id string, bearing_id string, source_csv_count bigint, reported_lifetime_raw string, "
    "reported_lifetime_min double, fault_element_raw string, fault_elements array<string>, failure_observed boolean, "
    "metadata_source string, metadata_source_locator string, metadata_confidence string, notes string, "
    "parsed_measurement_count bigint, first_measurement_index bigint, last_measurement_index bigint"
)
