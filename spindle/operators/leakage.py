"""Near-duplicate vectors across splits: random hyperplanes propose pairs, their exact cosine decides.

Vectors on the same side of `BITS` random planes share a bucket; `TABLES` sets of planes are tried. Of pairs at cosine 0.999, 99.99 % share a bucket at least
(`recall` works it out for any cosine). Equal vectors are one class with a row for each split it is in, so that copies make no pairs; buckets are parted by
2^24 sides and grow with what is alike, not with the table. The planes follow from a seed.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS, TABLES = 24, 8


def recall(similarity: float, bits: int = BITS, tables: int = TABLES) -> float:
    """The share of pairs of this cosine that share a bucket."""
    return 1 - (1 - (1 - math.acos(similarity) / math.pi) ** bits) ** tables


def split_near_duplicates(rows: DataFrame, key: str, similarity: float = 0.999, bits: int = BITS, tables: int = TABLES, seed: int = 7) -> DataFrame:
    """first_split, second_split, first_id, second_id, first_count, second_count, similarity: pairs of different vectors, or of one vector, in two splits (in order of
    their names) with at least this cosine; ids are the least, and counts those, of the rows of the split that have the vector.

    rows: key, split, vector (doubles of one length). Rows with a null, vectors of length 0 and such with a value that isn't finite are near nothing.
    """
    if not 0 < similarity <= 1 or not 0 < bits < 48:
        raise ValueError("similarity must be in (0, 1] and bits in 1..47")
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda t, x: t + x * x))
    own = rows.select(F.col(key).alias("id"), "split", F.transform("vector", lambda x: x + 0.0).alias("vector")).where("id is not null and split is not null and vector is not null")
    own = own.withColumn("norm", norm).where((F.col("norm") > 0) & (F.col("norm") < float("inf")))
    held = own.groupBy("vector", "norm", "split").agg(F.min("id").alias("id"), F.count("*").alias("n"))
    classes = held.groupBy("vector", "norm").agg(F.array_sort(F.collect_list(F.struct("split", "id", "n"))).alias("in"))  # a struct for each split

    def buckets(batches):
        planes = None
        for batch in batches:
            vector = batch.column(0)
            if not len(vector):
                continue
            x = vector.flatten().to_numpy(zero_copy_only=False).reshape(len(vector), -1)
            if planes is None:
                planes = np.random.default_rng(seed).normal(size=(x.shape[1], bits * tables))
            side = (x @ planes > 0).reshape(len(x), tables, bits)
            number = side @ (1 << np.arange(bits, dtype=np.int64)) + (np.arange(tables, dtype=np.int64) << bits)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, number.size + 1, tables), pa.int32()), pa.array(number.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=[*batch.schema.names, "buckets"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in classes.schema)
    placed = classes.mapInArrow(buckets, f"{kinds}, buckets array<long>")
    place = F.col("in")[0]
    ray = placed.select(F.struct(place["split"].alias("split"), place["id"].alias("id")).alias("c"), "vector", "norm", "in", F.explode("buckets").alias("bucket"))
    a, b = (ray.select("bucket", *[F.col(x).alias(f"{x}{k}") for x in ("c", "vector", "norm", "in")]) for k in "ab")
    apart = ~((F.size("ina") == 1) & (F.size("inb") == 1) & (F.col("ina")[0]["split"] == F.col("inb")[0]["split"]))
    dot = F.aggregate(F.zip_with("vectora", "vectorb", lambda x, y: x * y), F.lit(0.0), lambda t, x: t + x)
    cosine = F.least(dot / F.col("norma") / F.col("normb"), F.lit(1.0))
    met = a.join(b, "bucket").where((F.col("ca") < F.col("cb")) & apart).select("ca", "cb", "ina", "inb", cosine.alias("similarity")).where(F.col("similarity") >= similarity).dropDuplicates(["ca", "cb"])
    one = classes.where(F.size("in") > 1).select(F.col("in").alias("ina"), F.col("in").alias("inb"), F.lit(1.0).alias("similarity"))
    both = met.select("ina", "inb", "similarity").unionByName(one)
    pair = F.explode(F.flatten(F.transform("ina", lambda x: F.transform("inb", lambda y: F.struct(F.least(x, y).alias("x"), F.greatest(x, y).alias("y"))))))
    return both.select(pair.alias("p"), "similarity").where("p.x.split < p.y.split").distinct().select(
        F.col("p.x.split").alias("first_split"), F.col("p.y.split").alias("second_split"), F.col("p.x.id").alias("first_id"), F.col("p.y.id").alias("second_id"), F.col("p.x.n").alias("first_count"), F.col("p.y.n").alias("second_count"), "similarity")
