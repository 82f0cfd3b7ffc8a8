"""Language identification by hierarchical discrimination.

A first machine finds the language family; within the family, one-versus-one linear support vector machines separate the
closely related languages, each pair having one vote and the summed margins breaking ties. All machines are fitted by
dual coordinate descent on a bounded sample (`PER_LANGUAGE` training rows of each language, drawn by a hash of doc_id)
and see counts of byte trigrams of the *whole* text, hashed to `DIMS` numbers, damped by a logarithm and of unit length.

Families are a parameter; a language that no family names is a family of its own.

Defined results: a null text, or one without any letter, is `und` with score 0; so is every text if there are no training
rows. With a single language learned, that is predicted with score 1. Ties go to the language that sorts first.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindle.llm.common import LOWER, SHARES, documents, held_out, lean, mix, raw, share_of, slices, table
from spindle.llm.linear import fit_hinge, fit_sigmoid, sigmoid

DIMS = 2048
PER_LANGUAGE = 1000
FAMILIES = {"germanic": ("en", "de", "nl", "sv", "da"), "romance": ("fr", "es", "it", "pt", "ro"), "slavic": ("ru", "pl", "cs", "uk", "bg")}
_LETTER = regex.compile(r"\p{L}")
_BUCKET = None


def _bucket() -> np.ndarray:
    """The feature of each byte trigram, over an alphabet of 128 classes (A-Z lower-cased; signs, digits and space together)."""
    global _BUCKET
    if _BUCKET is None:
        _BUCKET = (mix(np.arange(128**3, dtype=np.uint64) + np.uint64(5)) >> np.uint64(33)).astype(np.int32) % DIMS
    return _BUCKET


_ALPHABET = LOWER.copy()
_ALPHABET[:97] = 0
_ALPHABET[65:91] = np.arange(1, 27)
_ALPHABET[97:123] = np.arange(1, 27)
_ALPHABET[123:128] = 0
_ALPHABET[128:] = 32 + (np.arange(128) % 96)


def vectors(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A unit vector for each text (zero if it has no trigram)."""
    n = len(off) - 1
    if len(data) < 3:
        return np.zeros((n, DIMS), np.float32)
    c = _ALPHABET[data].astype(np.int32)
    code = (c[:-2] << 14) | (c[1:-1] << 7) | c[2:]
    doc = np.repeat(np.arange(n), np.diff(off))
    inside = (doc[:-2] == doc[2:]) & (code != 0)
    out = np.bincount(doc[:-2][inside] * DIMS + _bucket()[code[inside]], minlength=n * DIMS).reshape(n, DIMS)
    out = np.log1p(out).astype(np.float32)
    norm = np.sqrt((out * out).sum(axis=1, keepdims=True))
    return out / np.maximum(norm, 1e-9)


def _parts(off: np.ndarray):
    """Slices with few rows too, as a vector takes 8 * DIMS bytes."""
    for lo, hi in slices(off):
        for a in range(lo, hi, 512):
            yield a, min(a + 512, hi)


def _pair(x: np.ndarray, y: np.ndarray) -> dict:
    rows = lambda at: [(np.flatnonzero(v), v[v != 0]) for v in x[at]]
    test = np.arange(len(y)) % 4 == 0
    a, b = 4.0, 0.0
    if len(set(y[test])) == 2 and len(set(y[~test])) == 2:
        w = fit_hinge(rows(~test), y[~test], DIMS, c=4.0)
        a, b = fit_sigmoid(x[test] @ w[:DIMS] + w[DIMS], y[test])
    w = fit_hinge(rows(np.ones(len(y), bool)), y, DIMS, c=4.0)
    return {"w": w[:DIMS].astype(np.float32), "bias": float(w[DIMS]), "a": a, "b": b}


def _machines(x: np.ndarray, names: np.ndarray) -> dict:
    """One machine for each pair of names."""
    own = sorted(set(names))
    out = {}
    for p, q in combinations(own, 2):
        at = (names == p) | (names == q)
        out[p, q] = _pair(x[at], np.where(names[at] == p, 1.0, -1.0))
    return {"names": own, "pairs": out}


def _vote(x: np.ndarray, m: dict) -> tuple[np.ndarray, np.ndarray]:
    """(index of the name, probability) for each vector: most won pairs, then the greatest sum of probabilities."""
    n = len(m["names"])
    if n == 1:
        return np.zeros(len(x), np.int64), np.ones(len(x))
    wins, sums, least = np.zeros((len(x), n)), np.zeros((len(x), n)), np.ones((len(x), n))
    for (p, q), k in m["pairs"].items():
        i, j = m["names"].index(p), m["names"].index(q)
        z = sigmoid(k["a"] * (x @ k["w"] + k["bias"]) + k["b"])
        wins[:, i] += z >= 0.5
        wins[:, j] += z < 0.5
        sums[:, i] += z
        sums[:, j] += 1 - z
        least[:, i] = np.minimum(least[:, i], z)
        least[:, j] = np.minimum(least[:, j], 1 - z)
    best = np.argmax(wins + sums / (n + 1), axis=1)
    return best, least[np.arange(len(x)), best]


def train(docs: DataFrame, families: dict[str, tuple[str, ...]] = FAMILIES, per_language: int = PER_LANGUAGE) -> dict | None:
    """docs: doc_id, text, lang. The model, or None without training rows."""
    rows = docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    have = {r.lang: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not have:
        return None
    h = F.pmod(F.xxhash64(F.lit(43), F.col("doc_id")), F.lit(SHARES))
    share = F.create_map(*[x for k, n in have.items() for x in (F.lit(k), F.lit(share_of(per_language, n)))])

    def run(batches):
        for batch in batches:
            data, off = raw(batch.column(0))
            for lo, hi in _parts(off):
                v = vectors(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo), pa.array([x.astype(np.float16).tobytes() for x in v], pa.binary())], names=["lang", "h", "v"])

    got = rows.where(h < share[F.col("lang")]).select(F.col("text").cast("binary").alias("text"), "lang", F.xxhash64("doc_id").alias("h")).mapInArrow(lean(run), "lang string, h long, v binary").toPandas().sort_values("h")
    if not len(got):
        return None
    x = np.stack([np.frombuffer(v, np.float16) for v in got.v]).astype(np.float32)
    lang = got.lang.to_numpy()
    family = {k: f for f, own in families.items() for k in own}
    of = np.array([family.get(k, k) for k in lang])
    return {"families": _machines(x, of), "languages": {f: _machines(x[of == f], lang[of == f]) for f in sorted(set(of))}}


def predict(docs: DataFrame, model: dict | None) -> DataFrame:
    """doc_id, lang_pred, score."""
    key = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 4 * DIMS bytes for each pair of languages

    def run(batches):
        m = shared.value
        for batch in batches:
            text = batch.column(1)
            data, off = raw(text)
            names, score = np.full(len(text), "und", dtype=object), np.zeros(len(text))
            letters = np.array([bool(x.is_valid and _LETTER.search(x.as_py())) for x in text], dtype=bool)
            for lo, hi in _parts(off) if m else ():
                x = vectors(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                fam, p = _vote(x, m["families"])
                for i, f in enumerate(m["families"]["names"]):
                    at = np.flatnonzero(fam == i)
                    if len(at):
                        own = m["languages"][f]
                        k, z = _vote(x[at], own)
                        names[lo + at] = np.array(own["names"], dtype=object)[k]
                        score[lo + at] = p[at] * z
            names[~letters], score[~letters] = "und", 0.0
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(lean(run), f"doc_id {key}, lang_pred string, score double")


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(table(spark, sf_dir, "documents"), "text", "lang")
    return predict(docs, train(docs)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
