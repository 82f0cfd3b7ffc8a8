"""Leave-one-group-out folds: scalers and errors of every fold from one pass over the rows.

A fold holds all groups but one, so its moments are those of all rows less those of the group left out. Groups are as many as bearings or conditions; their moments
are small rows, of which a sum over all is one more row for each feature.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spindle.functions.signal import is_finite
from spindle.operators.sensitivity import UNITS, units
from spindle.schemas import CHANNEL_FEATURES


def fold_scalers(features: DataFrame, by: list[str], names: tuple[str, ...] = CHANNEL_FEATURES) -> DataFrame:
    """by (the group left out), name, n, mean, scale: of the finite values of all other groups. A scale of 0 becomes 1; a fold without values has mean 0 and scale 1.

    Sums are taken around the mean over all rows (a first, small pass), so that the difference of two of them loses no digits.
    """
    finite = lambda c: F.when(is_finite(F.col(c)), F.col(c))
    middle = features.agg(*[F.coalesce(F.avg(finite(c)), F.lit(0.0)).alias(c) for c in names]).first()  # one row
    moved = lambda c: finite(c) - F.lit(middle[c])
    sums = [F.struct(F.lit(c).alias("name"), F.lit(middle[c]).alias("middle"), F.count(moved(c)).alias("n"), F.coalesce(F.sum(moved(c)), F.lit(0.0)).alias("s"), F.coalesce(F.sum(moved(c) * moved(c)), F.lit(0.0)).alias("q")) for c in names]
    own = features.groupBy(*by).agg(F.array(*sums).alias("r")).select(*by, F.explode("r").alias("r")).select(*by, "r.*")
    total = own.groupBy("name").agg(*[F.sum(c).alias(f"{c}_all") for c in ("n", "s", "q")])  # a row for each feature
    rest = own.join(F.broadcast(total), "name").select(*by, "name", "middle", (F.col("n_all") - F.col("n")).alias("n"), (F.col("s_all") - F.col("s")).alias("s"), (F.col("q_all") - F.col("q")).alias("q"))
    offset = F.try_divide("s", "n")
    scale = F.sqrt(F.greatest(F.try_divide("q", "n") - offset * offset, F.lit(0.0)))
    return rest.select(*by, "name", "n", F.coalesce(F.col("middle") + offset, F.lit(0.0)).alias("mean"), F.when(scale > 1e-12 * F.greatest(F.abs(F.col("middle")), F.lit(1e-300)), scale).otherwise(1.0).alias("scale"))


def fold_metrics(errors: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """keys, by (the group left out), n, mae, rmse over all other groups of a key. errors: keys, by, e. Sums are whole numbers (see sensitivity.UNITS), so a difference is exact."""
    own = errors.groupBy(*keys, *by).agg(F.count("e").alias("n"), F.sum(units(F.abs("e"))).alias("a"), F.sum(units(F.col("e") * F.col("e"))).alias("s"))
    w = Window.partitionBy(*keys)  # over groups, not rows
    rest = own.select(*keys, *by, *[(F.sum(c).over(w) - F.col(c)).alias(c) for c in ("n", "a", "s")]).where("n > 0")
    mean = lambda c: F.col(c).cast("double") / (F.col("n") * float(UNITS))
    return rest.select(*keys, *by, "n", mean("a").alias("mae"), F.sqrt(mean("s")).alias("rmse"))
