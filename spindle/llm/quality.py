"""Quality classifier: Naive Bayes support vectors.

Each text becomes the set of its n-gram indicators; an indicator's value is the log ratio of its class frequencies
(Naive Bayes), counted over *all* labelled training rows on Spark; a linear hinge-loss machine is then fitted by dual
coordinate descent on a bounded sample of them (`SAMPLE_ROWS` rows, drawn by a hash of doc_id, `CLASS_ROWS` of either class at least) and its margins are turned
into probabilities by a sigmoid fitted on rows of the sample that the machine didn't see.

The n-grams are over words as they look (lower, title or upper case; digits; the sign before and after; a length class;
whether the word is that before it or the one before that) - orders 1 to 3 - and over the words themselves (order 1).
A whole text is always used. All features are hashed to `DIMS` numbers, so models and counts are of a fixed size.

Defined results: a null or empty text has no n-grams and gets the bias's score. Labels that are null don't count; a
document with several labels has the least. If training rows hold one class only, every score is that class's share
smoothed; without training rows it is 0.5.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindle.llm.common import SHARES, documents, held_out, lean, mix, raw, share_of, slices, small, table, without, words
from spindle.llm.linear import fit_hinge, fit_sigmoid, sigmoid

DIMS = 1 << 16
#: Bound of the sample that the hinge-loss machine sees.
SAMPLE_ROWS = 4000
#: Rows of a rarer class that the sample has at least (or all of them), on average.
CLASS_ROWS = 400
#: Bound under which labels are broadcast (16 bytes each); more are joined by shuffle.
BROADCAST_LABELS = 1_000_000
THRESHOLD = 0.3
SMOOTHING = 1.0

MEMBER = np.ones(256, dtype=bool)
MEMBER[[9, 10, 11, 12, 13, 32]] = False
_CLASS = np.full(256, 4, dtype=np.uint8)  # 0 lower, 1 upper, 2 digit, 3 sign, 4 other letters (from 0x80 on)
_CLASS[:128] = 3
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = 0, 1, 2


def _looks(data: np.ndarray, s: np.ndarray, e: np.ndarray, doc: np.ndarray, h: np.ndarray) -> np.ndarray:
    """A number for how each word looks."""
    kind = _CLASS[data]
    total = np.zeros((4, len(data) + 1), dtype=np.int32)
    for i in range(4):
        np.cumsum(kind == i, out=total[i, 1:])
    low, up, digit, sign = (t[e] - t[s] for t in total)
    n = e - s
    case = np.where((up > 1) & (low <= up // 4), 3, np.where(up == 0, 0, np.where(kind[s] == 1, 1, 2)))
    same = np.zeros(len(s), dtype=np.int64)
    if len(s) > 2:
        same[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
        same[2:] |= ((h[2:] == h[:-2]) & (doc[2:] == doc[:-2])).astype(np.int64) << 1
    mark = lambda at: np.where(kind[at] == 3, data[at].astype(np.int64) + 1, 0)
    length = np.searchsorted(np.array([1, 2, 4, 8, 16, 32]), n)
    out = (((case * 2 + (digit > 0)) * 3 + np.minimum(sign, 2)) * 8 + length) * 4 + same
    return (out * 130 + mark(s)) * 130 + mark(e - 1)


def features(data: np.ndarray, off: np.ndarray, dims: int = DIMS) -> tuple[np.ndarray, np.ndarray]:
    """(text index, feature) of each distinct n-gram indicator, sorted."""
    s, e, doc, h = words(data, off, MEMBER)
    if not len(s):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        look = mix(_looks(data, s, e, doc, h).astype(np.uint64) + np.uint64(11))
        grams, of = [h, look], [doc, doc]
        for n in (2, 3):
            if len(look) >= n:
                g = look[: len(look) - n + 1].copy()
                for j in range(1, n):
                    g = mix(g * np.uint64(31) + look[j : len(look) - n + 1 + j])
                same = doc[: len(g)] == doc[n - 1 :]
                grams.append(g[same])
                of.append(doc[: len(g)][same])
        f = (np.concatenate(grams) >> np.uint64(20)).astype(np.int64) % dims
    key = np.sort(np.concatenate(of) * dims + f)
    key = key[np.concatenate(([True], key[1:] != key[:-1]))]
    return key // dims, key % dims


def _labelled(docs: DataFrame, labels: DataFrame, label: str, key: str) -> DataFrame:
    marks = labels.select(F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("_y")).where("_id is not null and _y is not null").groupBy("_id").agg(F.min("_y").alias("_y"))
    return docs.where(~held_out(key)).select(key, "text").join(small(marks, BROADCAST_LABELS), F.col(key) == F.col("_id")).select(key, "text", (F.col("_y") > 0).cast("int").alias("y"))


def _class_counts(batches):
    """Documents of each class with each feature, summed over the task."""
    seen = np.zeros((2, DIMS), dtype=np.int64)
    for batch in batches:
        data, off = raw(batch.column(0))
        y = batch.column(1).to_numpy(zero_copy_only=False)
        for lo, hi in slices(off):
            doc, f = features(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
            of = y[lo:hi][doc]
            for k in (0, 1):
                seen[k] += np.bincount(f[of == k], minlength=DIMS)
    at = np.flatnonzero(seen.any(axis=0))
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(seen[0, at]), pa.array(seen[1, at])], names=["f", "neg", "pos"])


def _as_rows(batches):
    for batch in batches:
        data, off = raw(batch.column(0))
        for lo, hi in slices(off):
            doc, f = features(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
            cut = np.searchsorted(doc, np.arange(hi - lo + 1))
            blobs = [f[a:b].astype(np.int32).tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(1).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo), pa.array(blobs, pa.binary())], names=["y", "h", "f"])


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", sample_rows: int = SAMPLE_ROWS) -> dict:
    """The model: weights of a fixed size, with the sigmoid's a and b."""
    rows = _labelled(docs, labels, label, "doc_id")
    totals = {r.y: r["count"] for r in rows.groupBy("y").count().collect()}
    n = sum(totals.values())
    model = {"w": np.zeros(DIMS), "bias": 0.0, "a": 1.0, "b": 0.0}
    if len(totals) < 2:
        if n:
            pos = totals.get(1, 0)
            model["b"] = float(np.log((pos + 1) / (n - pos + 1)))
        return model
    text = F.col("text").cast("binary").alias("text")
    sums = rows.select(text, "y").mapInArrow(lean(_class_counts), "f int, neg long, pos long").groupBy("f").agg(F.sum("neg").alias("neg"), F.sum("pos").alias("pos")).toPandas()  # DIMS rows at most
    p, q = np.full(DIMS, SMOOTHING), np.full(DIMS, SMOOTHING)
    p[sums.f], q[sums.f] = p[sums.f] + sums.pos, q[sums.f] + sums.neg
    r = np.log(p / (totals[1] + 2 * SMOOTHING)) - np.log(q / (totals[0] + 2 * SMOOTHING))
    h = F.xxhash64(F.lit(41), F.col("doc_id"))
    share = [share_of(max(0.9 * sample_rows * totals[k] / n, min(CLASS_ROWS, 0.1 * sample_rows)), totals[k]) for k in (0, 1)]
    drawn = rows.where(F.pmod(h, F.lit(SHARES)) < F.when(F.col("y") == 1, share[1]).otherwise(share[0])).select(text, "y", h.alias("h"))
    got = drawn.mapInArrow(lean(_as_rows), "y int, h long, f binary").orderBy("h").limit(sample_rows).toPandas()
    feats = [np.frombuffer(x, np.int32) for x in got.f]
    y = np.where(got.y.to_numpy() > 0, 1.0, -1.0)
    if len(set(y)) < 2:
        return model | {"b": float(np.log((totals[1] + 1) / (totals[0] + 1)))}
    scaled = [(f, r[f] / np.sqrt(max(1, len(f)))) for f in feats]
    test = np.arange(len(y)) % 4 == 0
    if len(set(y[test])) == 2 and len(set(y[~test])) == 2:
        w = fit_hinge([scaled[i] for i in np.flatnonzero(~test)], y[~test], DIMS)
        a, b = fit_sigmoid(np.array([w[f] @ v + w[DIMS] for f, v in (scaled[i] for i in np.flatnonzero(test))]), y[test])
    else:
        a, b = 1.0, 0.0
    w = fit_hinge(scaled, y, DIMS)
    return {"w": w[:DIMS] * r, "bias": float(w[DIMS]), "a": a, "b": b + float(np.log(share[0] / share[1]))}  # the odds of the rows, not of the sample


def scores(docs: DataFrame, model: dict, key: str = "doc_id") -> DataFrame:
    """(key, score) of each row: the probability of label 1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 8 * DIMS bytes

    def run(batches):
        m = shared.value
        for batch in batches:
            data, off = raw(batch.column(1))
            out = np.empty(len(off) - 1)
            for lo, hi in slices(off):
                doc, f = features(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                n = np.bincount(doc, minlength=hi - lo)
                out[lo:hi] = np.bincount(doc, weights=m["w"][f], minlength=hi - lo) / np.sqrt(np.maximum(n, 1)) + m["bias"]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sigmoid(m["a"] * out + m["b"]))], names=[key, "score"])

    return docs.select(key, F.col("text").cast("binary").alias("text")).mapInArrow(lean(run), f"{key} {docs.schema[key].dataType.simpleString()}, score double")


def kept(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that the classifier keeps, all columns as they were."""
    docs = documents(docs)
    bad = scores(docs, train(docs, labels)).where(F.col("score") < threshold).select("doc_id")
    return without(docs, lambda: bad)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(table(spark, sf_dir, "documents"), "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    return scores(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
