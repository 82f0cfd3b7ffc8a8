"""Distance of the distributions of real and generated windows (maximum mean discrepancy, Gaussian kernel), in one pass by random Fourier features.

A window's features are the cosines and sines of fixed projections; a group is their sums, which are kept as whole numbers: they merge in any order, and
groups of any size are one small row. The squared distance of two groups' mean features is the kernel's quadratic form over all pairs, up to an error of
order 1 / sqrt(FREQUENCIES) of the kernel's range (tested against the quadratic form). Projections are hash draws, so SQL can repeat them.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindle.functions.signal import is_finite

FREQUENCIES = 256
#: Cosines and sines are added up as whole numbers of this part of one.
PART = 2**40
#: Values of projections that a task holds at once.
SLICE = 1 << 20


def projections(dimension: int, frequencies: int, bandwidth: float, seed: int = 0) -> np.ndarray:
    """(dimension, frequencies) normal draws over the bandwidth: by Box and Muller from two hash draws for each place."""
    def u(tag: str, j: int, i: int) -> float:
        return (int(hashlib.sha256(f"{seed}|{tag}|{j}|{i}".encode()).hexdigest()[:13], 16) + 0.5) / 2.0**52

    return np.array([[np.sqrt(-2 * np.log(u("radius", j, i))) * np.cos(2 * np.pi * u("angle", j, i)) for j in range(frequencies)] for i in range(dimension)]) / bandwidth


def mmd(windows: DataFrame, by: list[str], bandwidth: float | None = None, frequencies: int = FREQUENCIES, seed: int = 0) -> DataFrame:
    """by, n_real, n_generated, mmd2: squared distance of the mean features of a group's real and generated windows.

    windows: by, generated (boolean), window (numbers, of one length within a group). Rows with a null, or a value that isn't finite, don't count. mmd2 is null for a
    group without rows on one side. The bandwidth is sqrt(length) where it isn't given, the scale of standardised values. Windows of several lengths in a group raise.
    """
    if frequencies < 1 or (bandwidth is not None and not bandwidth > 0):
        raise ValueError("frequencies and bandwidth must be positive")
    own = windows.select(*by, F.col("generated").alias("_side"), F.transform("window", lambda x: x.cast("double")).alias("_w")).where("_side is not null and _w is not null and size(_w) > 0")
    own = own.where(F.forall("_w", lambda x: x.isNotNull() & is_finite(x)))
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in own.drop("_w").schema]

    def summed(batches):
        known: dict[int, np.ndarray] = {}
        for batch in batches:
            table = pa.Table.from_batches([batch])
            offsets, flat = batch.column("_w").offsets.to_numpy(), batch.column("_w").values.to_numpy(zero_copy_only=False)
            if not len(batch):
                continue
            keys = table.drop_columns(["_w"]).append_column("_length", pa.array(np.diff(offsets), pa.int32()))
            number = keys.append_column("_row", pa.array(np.arange(len(batch)))).group_by(keys.column_names, use_threads=False).aggregate([("_row", "list")])
            rows, counts, totals = number.column("_row_list").to_pylist(), [], []
            for at, length in zip(rows, number.column("_length").to_pylist(), strict=True):
                if length not in known:
                    known[length] = projections(length, frequencies, bandwidth or length**0.5, seed)
                w, total = known[length], np.zeros(2 * frequencies, np.int64)
                step = max(1, SLICE // (2 * frequencies + length))
                for a in range(0, len(at), step):
                    z = flat[offsets[at[a : a + step]][:, None] + np.arange(length)] @ w
                    total += np.rint(np.concatenate([np.cos(z), np.sin(z)], 1) * PART).astype(np.int64).sum(0)
                counts.append(len(at))
                totals.append(total)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * 2 * frequencies, pa.int32()), pa.array(np.concatenate(totals)))
            yield pa.RecordBatch.from_arrays([*(number.column(c).combine_chunks() for c in keys.column_names), pa.array(counts, pa.int64()), lists], names=[*keys.column_names, "_n", "_s"])

    made = own.mapInArrow(summed, ", ".join([*kinds, "_length int", "_n long", "_s array<long>"]))
    cells = made.select(*by, "_side", "_length", "_n", F.posexplode("_s").alias("_place", "_v"))
    of = lambda side, c: F.sum(F.when(F.col("_side") == side, F.col(c).cast("decimal(38,0)")))
    place = cells.groupBy(*by, "_place").agg(of(False, "_v").alias("_a"), of(True, "_v").alias("_b"), of(False, "_n").alias("_na"), of(True, "_n").alias("_nb"), F.min("_length").alias("_lo"), F.max("_length").alias("_hi"))
    gap = F.col("_a").cast("double") / F.col("_na").cast("double") - F.col("_b").cast("double") / F.col("_nb").cast("double")
    count = lambda c: F.coalesce(F.max(c), F.lit(0)).cast("long")
    # two numbers for each frequency, in order, as sums of doubles depend on it
    group = place.groupBy(*by).agg(count("_na").alias("n_real"), count("_nb").alias("n_generated"), F.array_sort(F.collect_list(F.struct("_place", (gap * gap / float(PART) ** 2).alias("v")))).alias("_d"), F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"))
    checked = F.when(F.col("_lo") == F.col("_hi"), F.aggregate("_d", F.lit(0.0), lambda t, x: t + x["v"]) / frequencies).otherwise(F.raise_error(F.lit("windows of a group have several lengths")).cast("double"))
    return group.where("n_real + n_generated > 0").select(*by, "n_real", "n_generated", checked.alias("mmd2"))


def forecast_distances(targets: DataFrame, predictions: DataFrame, keys: DataFrame, by: list[str], bandwidth: float | None = None, frequencies: int = FREQUENCIES, seed: int = 0) -> DataFrame:
    """model, by, n_real, n_generated, mmd2: of the target vectors of all queries and those that each model predicts for them.

    targets and predictions are the long rows of `baselines` (predictions with their model), keys: sample_id and by. A cell without a valid target is 0 on both sides;
    a query that a model has no full prediction for counts as real only.
    """
    both = targets.join(predictions, ["sample_id", "query_pos", "feature_index"])
    cell = lambda c: F.struct("feature_index", F.when(F.col("valid"), F.col(c)).otherwise(0.0).alias("v"))
    made = both.groupBy("model", "sample_id", "query_pos").agg(*[F.transform(F.array_sort(F.collect_list(cell(c))), lambda r: r["v"]).alias(c) for c in ("target", "prediction")])  # a query's features
    sides = F.explode(F.array(*[F.struct(F.lit(flag).alias("generated"), F.col(c).alias("window")) for flag, c in ((False, "target"), (True, "prediction"))]))
    rows = made.join(keys.select("sample_id", *by), "sample_id").select("model", *by, sides.alias("s")).select("model", *by, "s.*")
    return mmd(rows, ["model", *by], bandwidth, frequencies, seed)
