"""Order checks, anchors, and causal context and future pools of trajectories."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spindle.schemas import LOOKBACK_SEC, MAX_CONTEXT, MIN_CONTEXT


def chronology_violations(rows: DataFrame, by: list[str]) -> DataFrame:
    """Rows whose index or time does not increase over the row before."""
    w = Window.partitionBy(*by).orderBy("elapsed_time_sec", "measurement_index")
    i, t = F.lag("measurement_index").over(w), F.lag("elapsed_time_sec").over(w)
    return rows.withColumns({"before_index": i, "before_time": t}).where((F.col("before_index") >= F.col("measurement_index")) | (F.col("before_time") >= F.col("elapsed_time_sec")))


def checked_chronology(rows: DataFrame, by: list[str]) -> DataFrame:
    """The rows; a trajectory whose index or time does not strictly increase raises."""
    bad = chronology_violations(rows, by).select(*by, "measurement_index").take(5)
    if bad:
        raise ValueError(f"trajectories without strictly increasing chronology, at: {[tuple(r) for r in bad]}")
    return rows


def pools(rows: DataFrame, by: list[str], lookback: float = LOOKBACK_SEC, cap: int = MAX_CONTEXT, carry: list[str] | None = None) -> DataFrame:
    """Each row as an anchor with its pool: the last `cap` rows of the past `lookback` seconds (both ends count), and whether a later row exists.

    The pool is bounded by the frame and the cap, so nothing grows with a trajectory's length.
    """
    w = Window.partitionBy(*by).orderBy(F.round(F.col("elapsed_time_sec") * 1e6).cast("long"))  # microseconds
    item = F.struct(F.col("elapsed_time_sec").alias("t"), F.col("measurement_index").alias("i"))
    pool = F.array_sort(F.collect_list(item).over(w.rangeBetween(-round(lookback * 1e6), 0)))
    last = F.max("elapsed_time_sec").over(Window.partitionBy(*by))
    out = rows.select(*by, "measurement_index", "elapsed_time_sec", *(carry or []), pool.alias("pool"), (F.col("elapsed_time_sec") < last).alias("has_future"))
    return out.withColumn("pool", F.when(F.size("pool") > cap, F.slice("pool", -cap, cap)).otherwise(F.col("pool")))


def eligible(anchors: DataFrame, least: int = MIN_CONTEXT, future: bool = True) -> DataFrame:
    out = anchors.where(F.size("pool") >= least)
    return out.where("has_future") if future else out


def banded(anchors: DataFrame, rows: DataFrame, by: list[str], horizon: float) -> DataFrame:
    """anchors (elapsed_time_sec) with the rows (future_time) of the same trajectory that may lie up to `horizon` seconds ahead.

    Time is cut to slots a little wider than the horizon. A row is sent to its own slot and to the one before, an anchor to its own alone, so that a pair meets once
    and the key is (trajectory, slot): a long trajectory is many keys. For rows at even distances, pairs are twice those within the horizon.
    """
    width = round(horizon * 1e6) + 2  # microseconds; 2 more than the horizon, as both ends are rounded
    slot = lambda c: F.floor(F.round(F.col(c) * 1e6) / width)
    own = anchors.withColumn("_slot", slot("elapsed_time_sec"))
    sent = rows.withColumn("_slot", F.explode(F.array(slot("future_time"), slot("future_time") - 1)))
    return own.join(sent, [*by, "_slot"]).drop("_slot")


def future_pairs(anchors: DataFrame, rows: DataFrame, by: list[str], horizon: float | None = None) -> DataFrame:
    """anchor × later rows, up to `horizon` seconds after it; if None all, whose number grows with the square of a trajectory's length."""
    later = rows.select(*by, F.col("measurement_index").alias("future_index"), F.col("elapsed_time_sec").alias("future_time"))
    ahead = F.col("future_time") > F.col("elapsed_time_sec")
    if horizon is None:
        return anchors.join(later, by).where(ahead)
    return banded(anchors, later, by, horizon).where(ahead & (F.col("future_time") <= F.col("elapsed_time_sec") + horizon))


def lifecycle_anchors(rows: DataFrame, by: list[str], steps: int = 10) -> DataFrame:
    """steps + 1 normalised positions of each trajectory: row floor(f * (n - 1) + 0.5) of its distinct indices."""
    own = rows.select(*by, "measurement_index").distinct()
    w = Window.partitionBy(*by).orderBy("measurement_index")
    placed = own.select(*by, "measurement_index", (F.row_number().over(w) - 1).alias("pos"), F.count("*").over(Window.partitionBy(*by)).alias("n"))
    want = placed.select(*by, "n").distinct().withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(steps))))
    want = want.withColumn("pos", F.floor(F.col("step") / F.lit(float(steps)) * (F.col("n") - 1) + 0.5).cast("int"))
    return want.join(placed.drop("n"), [*by, "pos"]).select(*by, "step", (F.col("step") / F.lit(float(steps))).alias("fraction"), "measurement_index")


def duplicate_anchors(anchors: DataFrame, by: list[str]) -> DataFrame:
    """How many anchors share a measurement with another, by trajectory."""
    one = anchors.groupBy(*by, "measurement_index").count()
    return one.groupBy(*by).agg(F.sum(F.col("count") - 1).cast("long").alias("duplicate_anchors"))


def missing_indices(rows: DataFrame, by: list[str]) -> DataFrame:
    """Indices absent from 1..max of each trajectory, without those that have none.

    Gaps come from neighbours in order, so no list of a trajectory's whole length is built but that of what is missing.
    """
    own = rows.select(*by, "measurement_index").where("measurement_index >= 1").distinct()
    w = Window.partitionBy(*by).orderBy("measurement_index")
    gap = own.withColumn("low", F.coalesce(F.lag("measurement_index").over(w), F.lit(0)) + 1).where(F.col("low") < F.col("measurement_index"))
    return gap.select(*by, F.explode(F.sequence("low", F.col("measurement_index") - 1)).alias("missing_index"))
