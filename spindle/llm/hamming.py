"""Exact top-k search over binary codes by incremental multi-index hashing.

A code's 64 bits are cut into m segments. If two codes differ in at most m * (r + 1) - 1 bits, some segment differs in at
most r. So a query looks into every segment's buckets at segment distance r = 0, 1, 2, ..., verifies what it
finds on the whole code, and stops once its k-th verified distance is at most m * (r + 1) - 1: all nearer codes have been seen.

Rows are dealt by a hash of id to blocks of some `INDEX_BLOCK` rows, and queries to blocks of some `QUERY_BLOCK`. Any two blocks meet in one
task, which indexes the distinct codes of its rows once and searches them for its queries; nothing passes through the driver. A code that many rows share is one entry with its least
ids: k, and as many more as an id has rows in the block, since those may be the query's own; no more of them can be among the first k. Then the k best of each query are merged from k of each block.

Results are exact, ordered by distance and then by id; a row is not its own neighbour.

Defined results: rows whose id or vector is null, or whose vector is empty, are left out. A component that is null or NaN
counts as not positive. Components beyond 64 are ignored by `sign_codes`; missing ones are zero bits. With fewer than k other rows, all
of them are returned. Rows that repeat an id are separate rows of it, except that none is a neighbour of that id.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spindle.llm.common import table

BITS = 64
K = 10
#: Queries of a block (16 bytes each).
QUERY_BLOCK = 200_000
#: Rows of a block, which a task indexes.
INDEX_BLOCK = 500_000


def sign_codes(df: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, code): bit i of the code is set if component i is positive."""
    bits = F.transform(F.slice(vector, 1, BITS), lambda x, i: F.when(F.coalesce((x > 0) & ~F.isnan(x.cast("double")), F.lit(False)), F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
    return df.where(F.col(key).isNotNull() & (F.size(F.coalesce(vector, F.array())) > 0)).select(F.col(key).cast("long").alias("id"), F.aggregate(bits, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b)).alias("code"))


class MultiIndex:
    """Distinct codes with buckets for each segment."""

    def __init__(self, ids: np.ndarray, codes: np.ndarray, k: int):
        order = np.lexsort((ids, codes))
        ids, codes = ids[order], codes[order]
        new = np.concatenate(([True], codes[1:] != codes[:-1]))
        first = np.flatnonzero(new)
        rank = np.arange(len(codes)) - np.repeat(first, np.diff(np.append(first, len(codes))))
        self.known, self.times = np.unique(ids, return_counts=True)
        keep = rank < k + self.times.max(initial=0)  # more than k, as some may be the query's own
        self.ids, self.k = ids[keep], k
        self.codes = codes[first]
        self.first = np.searchsorted(np.cumsum(new)[keep], np.arange(1, len(first) + 2))
        self.width = 16 if len(self.codes) >= 2048 else 8
        self.m = BITS // self.width
        self.tables = []
        for s in range(self.m):
            v = self.segment(self.codes, s)
            order = np.argsort(v, kind="stable")
            self.tables.append((order, np.searchsorted(v[order], np.arange((1 << self.width) + 1))))
        self.masks: dict[int, np.ndarray] = {}
        self.stamp, self.turn = np.zeros(len(self.codes), dtype=np.int64), 0

    def segment(self, codes: np.ndarray, s: int) -> np.ndarray:
        return ((codes >> np.uint64(s * self.width)) & np.uint64((1 << self.width) - 1)).astype(np.int64)

    def _masks(self, r: int) -> np.ndarray:
        if r not in self.masks:
            self.masks[r] = np.array([sum(1 << b for b in c) for c in combinations(range(self.width), r)], dtype=np.int64)
        return self.masks[r]

    def search(self, own: int, code: np.uint64) -> tuple[np.ndarray, np.ndarray]:
        """The k nearest ids and their distances."""
        self.turn += 1  # a code is seen if it bears this query's number
        found, dist = np.zeros(0, np.int64), np.zeros(0, np.int64)
        ids = near = np.zeros(0, np.int64)
        parts = [int(self.segment(np.array([code]), s)[0]) for s in range(self.m)]
        for r in range(self.width + 1):
            masks = self._masks(r)
            for s, (order, start) in enumerate(self.tables):
                b = parts[s] ^ masks
                n = start[b + 1] - start[b]
                b, n = b[n > 0], n[n > 0]
                if not len(b):
                    continue
                got = order[np.repeat(start[b], n) + (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))]
                got = got[self.stamp[got] != self.turn]
                self.stamp[got] = self.turn
                found = np.concatenate((found, got))
                dist = np.concatenate((dist, np.bitwise_count(self.codes[got] ^ code).astype(np.int64)))
            ids, near = self._rows(found, dist, own)
            if (len(ids) == self.k and near[-1] <= self.m * (r + 1) - 1) or len(found) == len(self.codes):
                break
        return ids, near

    def _rows(self, found: np.ndarray, dist: np.ndarray, own: int) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.known, own)
        most = self.k + (int(self.times[at]) if at < len(self.known) and self.known[at] == own else 0)
        if len(found) > most:  # codes farther than the k-th beside the query's own rows can't matter: each holds a row at least
            limit = np.partition(dist, most - 1)[most - 1]
            found, dist = found[dist <= limit], dist[dist <= limit]
        n = np.minimum(self.first[found + 1] - self.first[found], most)
        ids = self.ids[np.repeat(self.first[found], n) + (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))]
        dist = np.repeat(dist, n)[ids != own]
        ids = ids[ids != own]
        order = np.lexsort((ids, dist))[: self.k]
        return ids[order], dist[order]


def top_k(codes: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """query_id, id, distance, rank of the k nearest rows of codes (id, code) for each of queries (id, code)."""
    codes, queries = codes.select("id", "code"), queries.select("id", "code").distinct()
    blocks, sets = (max(1, -(-df.count() // size)) for df, size in ((codes, INDEX_BLOCK), (queries, QUERY_BLOCK)))
    least = int(codes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = max(blocks, min(least, codes.limit(least * 2000).count() // 2000))  # small tables too are worked on in several tasks
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    rows = codes.withColumn("block", F.pmod(F.xxhash64("id", "code"), F.lit(blocks))).withColumn("part", every(sets))
    asked = queries.withColumn("part", F.pmod(F.xxhash64("id", "code"), F.lit(sets))).withColumn("block", every(blocks))

    def run(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        got = []
        if mine.num_rows and theirs.num_rows:
            index = MultiIndex(mine.column("id").to_numpy(), mine.column("code").to_numpy().view(np.uint64), k)
            for i, c in zip(theirs.column("id").to_numpy(), theirs.column("code").to_numpy().view(np.uint64), strict=True):
                ids, near = index.search(int(i), c)
                got.append((np.full(len(ids), i), ids, near))
        return pa.table(dict(zip(("query_id", "id", "distance"), (np.concatenate([*(x[j] for x in got), np.zeros(0, np.int64)]) for j in range(3)), strict=True)))

    found = rows.groupBy("block", "part").cogroup(asked.groupBy("block", "part")).applyInArrow(run, "query_id long, id long, distance long")
    w = Window.partitionBy("query_id").orderBy("distance", "id")
    return found.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = sign_codes(table(spark, sf_dir, "embeddings"))
    return top_k(codes, codes.where("id % 100 = 0")).withColumnRenamed("id", "vec_id")


OP10_SQL = """
with c as (select vec_id id, list_transform(embedding, lambda x: coalesce(x > 0, false)) b from embeddings where vec_id is not null and len(embedding) > 0),
p as (select q.id query_id, x.id vec_id, list_sum(list_transform(list_zip(q.b, x.b), lambda z: (z[1] <> z[2])::int))::bigint distance from c q join c x on q.id % 100 = 0 and q.id <> x.id),
r as (select *, row_number() over (partition by query_id order by distance, vec_id)::bigint "rank" from p)
select * from r where "rank" <= 10
"""
