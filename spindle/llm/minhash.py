"""MinHash near-duplicates by an inverted join over signature coordinates.

A document's set holds its distinct shingles of `width` words. Its signature has `MINIMA` values, each the least of
the set under its own hash; two sets agree in a value with their Jaccard similarity as probability. Documents with
equal sets are one class, of which the least doc_id goes on.

A *coordinate* joins `JOINED` of these values into one, so that sets of similarity 0.8 agree in a coordinate with
probability 0.26, and sets of similarity 0.5, of which a group of loosely edited copies has as many pairs as the square of its size,
with 0.016. Every class is posted under each of its `COORDINATES` (coordinate, value) pairs. A pair of classes is a
candidate if it collides in at least `COLLISIONS` coordinates and in `MATCHES` values of the signature: at similarity
0.8 that misses about 2 pairs in a million (`recall` works it out), and more similar pairs more rarely. Values that a single class has can't
collide, so a class with c values left and c < `COLLISIONS` is done (that skips nearly all of a corpus). Else, any
candidate shares one of its c - COLLISIONS + 1 rarest values (its *prefix*); only these are posted again and merged;
longer lists are skipped, as agreement is counted from the signatures of the pairs that the prefixes give. Candidates
are then confirmed on full sets.

A row for every pair within a list would grow with its square. Instead

1. each list links its members to its most popular one, whose values most others share: the original of a group of edited
   copies. These pairs are confirmed, and components formed;
2. lists that still hold several components are dealt to tasks with their members' signatures, a long list in pairs of
   parts of `LIST` members. A task counts how many values every pair across components agrees in; of the pairs over the
   threshold it returns a forest, at most a row for each member;
3. the trees of these forests are dealt in blocks of `BLOCK` classes with their texts, any two of which meet in one task. There the candidates
   are confirmed on full sets, and again a forest is returned.

So rows follow postings, and members times blocks; no pair is a row. The work within a task is still that of all pairs
of a list or of a tree: a group of N classes that are alike but not linked costs N * N / `BLOCK` rows of texts. Pairs
within a component can't change it, so none of them is needed and no link between components is lost.

Defined results: null, empty or blank text: an empty set, linked with nothing. Fewer words than `width`: the whole
sequence is the one shingle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spindle.llm.common import arrow_type, documents, dropped, lean, lean_group, mix, raw, slices, small, table, without, words, written
from spindle.llm.graph import components

MINIMA = 192
JOINED = 6
COORDINATES = 80
COLLISIONS = 2
MATCHES = 120
#: Members of a part of a list (some 400 bytes each).
LIST = 4096
#: Classes of a block, which come with their texts.
BLOCK = 512
#: Links of a class with its most popular partner that one task confirms.
STAR = 256
#: Bytes of text of a block or star, on average: classes with long texts make smaller ones.
BLOCK_BYTES = 4_000_000
#: Bound of the classes' ids (8 bytes each) that are broadcast to fetch their texts; more are joined by shuffle.
BROADCAST_REPS = 500_000
#: Similarity as parts of 100: 100 * intersection >= SIMILARITY * union.
SIMILARITY = 80

MEMBER = np.ones(256, dtype=bool)
MEMBER[[9, 10, 11, 12, 13, 32]] = False
_ROWS = 511  # documents in a slice; leaves 55 bits of a shingle hash beside the number of the document
_BITS = np.uint64(55)
_U = np.uint64
_rng = np.random.default_rng(20)
_A = _rng.integers(0, 2**64, MINIMA, dtype=np.uint64) | _U(1)
_B = _rng.integers(0, 2**64, MINIMA, dtype=np.uint64)
#: The values that each coordinate joins.
_PICK = np.stack([_rng.permutation(MINIMA)[:JOINED] for _ in range(COORDINATES)])


def shingle_sets(data: np.ndarray, off: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys (document number << 55 | shingle hash) of the distinct shingles, and each document's first key."""
    _, _, doc, h = words(data, off, MEMBER)
    n = len(off) - 1
    have = np.bincount(doc, minlength=n)
    first = np.concatenate(([0], np.cumsum(have)[:-1]))
    g = h[: max(0, len(h) - width + 1)].copy()
    for j in range(1, width):
        g = mix(g * _U(0x9E3779B97F4A7C15) + h[j : j + len(g)])
    inside = doc[: len(g)] == doc[width - 1 :] if len(g) else np.zeros(0, bool)
    keys = [(doc[: len(g)][inside].astype(np.uint64) << _BITS) | (mix(g[inside]) >> _U(9))]
    few = np.flatnonzero((have > 0) & (have < width))
    if len(few):  # the whole sequence, marked by its length
        whole = [int(first[d]) for d in few]
        val = []
        for d, a in zip(few, whole, strict=True):
            x = _U(have[d])
            for v in h[a : a + have[d]]:
                x = mix(np.array([x * _U(0x9E3779B97F4A7C15) + v], dtype=np.uint64))[0]
            val.append(x)
        keys.append((few.astype(np.uint64) << _BITS) | (mix(np.array(val, dtype=np.uint64) + _U(77)) >> _U(9)))
    key = np.sort(np.concatenate(keys))
    if len(key):
        key = key[np.concatenate(([True], key[1:] != key[:-1]))]
    return key, np.searchsorted(key, np.arange(n + 1, dtype=np.uint64) << _BITS)


def _parts(off: np.ndarray, limit: int = 400_000):
    for lo, hi in slices(off, limit):
        for a in range(lo, hi, _ROWS):
            yield a, min(a + _ROWS, hi)


SIGNED_DDL = "doc_id {key}, n_shingles long, f1 long, f2 long, size long, sig binary"


def _signed(batches, width: int):
    mask = (_U(1) << _BITS) - _U(1)
    for batch in batches:
        data, off = raw(batch.column(1))
        for lo, hi in _parts(off):
            with np.errstate(over="ignore"):
                key, first = shingle_sets(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], width)
                n = np.diff(first)
                some = np.flatnonzero(n)
                sig = np.zeros((hi - lo, MINIMA), dtype=np.uint16)
                f1, f2 = np.zeros(hi - lo, np.uint64), np.zeros(hi - lo, np.uint64)
                if len(some):
                    at, x = first[some], key & mask
                    f1[some], f2[some] = np.add.reduceat(mix(x + _U(1)), at), np.add.reduceat(mix(x ^ _U(0x5555555555555555)), at)
                    for k in range(MINIMA):  # the low 16 bits of each least value
                        sig[some, k] = (np.minimum.reduceat(x * _A[k] + _B[k], at) >> _U(32)).astype(np.uint16)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(lo, hi - lo), pa.array(n, pa.int64()), pa.array(f1.view(np.int64)), pa.array(f2.view(np.int64)), pa.array(np.diff(off[lo : hi + 1])), pa.array([s.tobytes() for s in sig], pa.binary())],
                names=["doc_id", "n_shingles", "f1", "f2", "size", "sig"])


def _postings(batches):
    """(key, rep) of each coordinate of each signature."""
    for batch in batches:
        sig = _signatures(batch.column(1))
        key = np.repeat(np.arange(1, COORDINATES + 1, dtype=np.uint64)[None, :], len(sig), axis=0)
        with np.errstate(over="ignore"):
            for j in range(JOINED):
                key = mix(key * _U(0x9E3779B97F4A7C15) + sig[:, _PICK[:, j]].astype(np.uint64))
        rep = batch.column(0).take(pa.array(np.repeat(np.arange(len(sig)), COORDINATES)))
        yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), rep], names=["key", "rep"])


def recall(similarity: float, tries: int = 100_000, seed: int = 1) -> float:
    """The share of pairs of a similarity that become candidates, by drawing which values agree."""
    rng = np.random.default_rng(seed)
    found = 0
    for at in range(0, tries, 10_000):
        same = rng.random((min(10_000, tries - at), MINIMA)) < similarity
        hits = sum(same[:, p].all(axis=1).astype(np.int64) for p in _PICK)
        found += int(((hits >= COLLISIONS) & (same.sum(axis=1) >= MATCHES)).sum())
    return found / tries


def _signatures(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, MINIMA)


def _agree(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """In how many values each signature of x agrees with each of y."""
    out = np.zeros((len(x), len(y)), np.uint8)
    for a, b in zip(np.ascontiguousarray(x.T), np.ascontiguousarray(y.T), strict=True):
        out += a[:, None] == b[None, :]
    return out


def _united(label: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Labels (each the least member of its tree) after x and y are linked pair by pair."""
    while True:
        a, b = label[x], label[y]
        lo, hi = np.minimum(a, b), np.maximum(a, b)
        if (lo == hi).all():
            return label
        np.minimum.at(label, hi, lo)
        while (label != label[label]).any():
            label = label[label]


def _cuts(*keys: np.ndarray):
    """(from, to) of each run of equal keys."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    at = np.flatnonzero(new)
    return zip(at.tolist(), np.append(at[1:], len(new)).tolist(), strict=True)


def _ranks(column) -> np.ndarray:
    """A number for each distinct value."""
    return pa.chunked_array(column).combine_chunks().dictionary_encode().indices.to_numpy().astype(np.int64)


_PAIRS = 50_000  # pairs of signatures compared at once, in short lists


def _short(lo: np.ndarray, hi: np.ndarray):
    """All pairs of rows within runs lo .. hi, some at a time."""
    n = hi - lo
    row = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
    rest = np.repeat(hi, n) - row - 1
    upto = np.concatenate(([0], np.cumsum(rest)))
    for a, b in slices(upto, _PAIRS):
        k = rest[a:b]
        p = np.repeat(row[a:b], k)
        yield p, p + 1 + np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)


def _forest(group: pa.Table, schema: pa.Schema) -> pa.Table:
    """Of lists (key, i, j, part, rep, c, sig), trees of the pairs across components whose signatures agree in MATCHES values."""
    group = group.sort_by([("key", "ascending"), ("i", "ascending"), ("j", "ascending"), ("part", "ascending"), ("rep", "ascending")])
    key, i, j, part = (group.column(x).to_numpy() for x in ("key", "i", "j", "part"))
    rep, c, sig = _ranks(group.column("rep")), _ranks(group.column("c")), _signatures(group.column("sig"))
    label = np.arange(rep.max() + 1)
    runs = np.array(list(_cuts(key, i, j)), np.int64).reshape(-1, 2)
    tiny = (runs[:, 1] - runs[:, 0] <= 48) & (i[runs[:, 0]] == j[runs[:, 0]])
    for p, q in _short(*runs[tiny].T):
        some = (c[p] != c[q]) & (label[rep[p]] != label[rep[q]])
        p, q = p[some], q[some]
        good = (sig[p] == sig[q]).sum(axis=1) >= MATCHES
        label = _united(label, rep[p[good]], rep[q[good]])
    for lo, hi in runs[~tiny]:
        mid = lo + int(np.searchsorted(part[lo:hi], j[lo])) if i[lo] != j[lo] else hi
        for a in range(lo, mid, 1024):
            x = slice(a, min(a + 1024, mid))
            for b in range(mid if i[lo] != j[lo] else a, hi, 1024):
                y = slice(b, min(b + 1024, hi))
                some = (c[x][:, None] != c[y][None, :]) & (label[rep[x]][:, None] != label[rep[y]][None, :])
                if some.any():
                    p, q = np.nonzero((_agree(sig[x], sig[y]) >= MATCHES) & some)
                    label = _united(label, rep[x][p], rep[y][q])
    return _links_of(group.column("rep"), rep, label, schema)


def _links_of(names, rank: np.ndarray, label: np.ndarray, schema: pa.Schema) -> pa.Table:
    """(a, b) of each rank that isn't its own label."""
    first = np.full(len(label), -1)
    first[rank[::-1]] = np.arange(len(rank))[::-1]
    moved = np.flatnonzero((label != np.arange(len(label))) & (first >= 0))
    take = lambda x: pa.chunked_array(names).combine_chunks().take(pa.array(first[x]))
    return pa.Table.from_arrays([take(label[moved]).cast(schema.field(0).type), take(moved).cast(schema.field(1).type)], schema=schema)


def _shared(ka: np.ndarray, da: np.ndarray, na: int, kb: np.ndarray, db: np.ndarray, nb: int) -> np.ndarray:
    """How many shingles each pair of documents shares. k: shingles, d: their documents."""
    both = np.intersect1d(np.unique(ka), np.unique(kb))
    out = np.zeros((na, nb), dtype=np.float32)
    ia, ib = np.searchsorted(both, ka), np.searchsorted(both, kb)
    fa = np.append(both, _U(0))[ia] == ka if len(both) else np.zeros(len(ka), bool)
    fb = np.append(both, _U(0))[ib] == kb if len(both) else np.zeros(len(kb), bool)
    fa &= ia < len(both)
    fb &= ib < len(both)
    ia, da, ib, db = ia[fa], da[fa], ib[fb], db[fb]
    for lo in range(0, len(both), 4096):
        x, y = np.zeros((na, 4096), np.float32), np.zeros((nb, 4096), np.float32)
        at, bt = (ia >= lo) & (ia < lo + 4096), (ib >= lo) & (ib < lo + 4096)
        x[da[at], ia[at] - lo] = 1
        y[db[bt], ib[bt] - lo] = 1
        out += x @ y.T
    return out


def _sets_of(texts: pa.ChunkedArray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shingles, their documents, set sizes)."""
    mask = (_U(1) << _BITS) - _U(1)
    data, off = raw(texts)
    keys, docs, sizes = [np.zeros(0, _U)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for lo, hi in _parts(off):
        key, first = shingle_sets(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], width)
        keys.append(key & mask)
        docs.append((key >> _BITS).astype(np.int64) + lo)
        sizes.append(np.diff(first))
    return np.concatenate(keys), np.concatenate(docs), np.concatenate(sizes)


def _confirmed(group: pa.Table, width: int, similarity: int, schema: pa.Schema) -> pa.Table:
    """Trees of the links in bins (bin, side, rep, c, sig, text): of sides 1 and 2 with one another, of side 0 with itself."""
    group = group.sort_by([("bin", "ascending"), ("side", "ascending"), ("rep", "ascending")])
    bins, side = group.column("bin").to_numpy(), group.column("side").to_numpy()
    rep, c, sig = _ranks(group.column("rep")), _ranks(group.column("c")), _signatures(group.column("sig"))
    label = np.arange(rep.max() + 1)
    for lo, hi in _cuts(bins):
        alone = side[lo] == 0
        mid = hi if alone else lo + int(np.searchsorted(side[lo:hi], 2))
        at = lo if alone else mid
        near = (_agree(sig[lo:mid], sig[at:hi]) >= MATCHES) & (c[lo:mid][:, None] != c[at:hi][None, :])
        if alone:
            near = np.triu(near, 1)
        x, y = np.flatnonzero(near.any(axis=1)), np.flatnonzero(near.any(axis=0))
        if not len(x):
            continue
        (kx, dx, nx), (ky, dy, ny) = (_sets_of(group.column("text").take(pa.array(k)), width) for k in (lo + x, at + y))
        inter = _shared(kx, dx, len(x), ky, dy, len(y))
        p, q = np.nonzero(near[np.ix_(x, y)] & (inter > 0) & (100 * inter >= similarity * (nx[:, None] + ny[None, :] - inter)))
        label = _united(label, rep[lo + x[p]], rep[at + y[q]])
    return _links_of(group.column("rep"), rep, label, schema)


def _dealt(rows: DataFrame, size: int, each: int, key: str, run) -> DataFrame:
    """Links (a, b) from run over the rows, whose column `bin` is dealt by hash to tasks of about `each` of `size` rows."""
    spark = rows.sparkSession
    arrow = arrow_type(key)
    schema = pa.schema([("a", arrow), ("b", arrow)])
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // each))
    dealt = rows.withColumn("task", F.pmod(F.xxhash64("bin"), F.lit(tasks)))
    return written(dealt.groupBy("task").applyInArrow(lean_group(lambda t: run(t, schema)), f"a {key}, b {key}"), "links")


def _confirm(bins: DataFrame, classes: DataFrame, docs: DataFrame, key: str, width: int, similarity: int) -> DataFrame:
    """bins: bin, side, rep, c. The links (a, b) that full sets confirm."""
    bins = written(bins, "bins")
    asked = small(bins.select(F.col("rep").alias("doc_id")).distinct(), BROADCAST_REPS)
    texts = docs.join(asked, "doc_id", "left_semi").select(F.col("doc_id").alias("rep"), F.col("text").cast("binary").alias("text"))
    size = bins.join(classes.select("rep", "bytes"), "rep").agg(F.count("*").alias("n"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")).first()
    rows = bins.join(classes.select("rep", "sig"), "rep").join(texts, "rep").select("bin", "side", "rep", "c", "sig", "text")
    return _dealt(rows, max(size.n, -(-int(size.bytes) * 2 * BLOCK // (2 * BLOCK_BYTES))), 2 * BLOCK, key, lambda t, schema: _confirmed(t, width, similarity, schema))


def _paired(rows: DataFrame, by: str, n: str, part: int) -> DataFrame:
    """Rows in as many copies as parts of `part` rows meet: columns part, i, j with i <= j."""
    parts = F.ceil(F.col(n) / part).cast("int")
    own = rows.withColumn("part", F.pmod(F.xxhash64(by, "rep"), parts).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), parts - 1)))
    return own.withColumn("i", F.least("part", "o")).withColumn("j", F.greatest("part", "o")).drop("o")


def near_duplicates(docs: DataFrame, width: int = 5, similarity: int = SIMILARITY) -> DataFrame:
    """doc_id, n_shingles, component_id (the least doc_id that links reach) of every document. docs: doc_id, text."""
    docs = documents(docs, "text")
    key = docs.schema["doc_id"].dataType.simpleString()
    signed = written(docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(lean(lambda b: _signed(b, width)), SIGNED_DDL.format(key=key)), "signed")
    classes = written(signed.where("n_shingles > 0").groupBy("f1", "f2", "n_shingles").agg(F.min("doc_id").alias("rep"), F.max("size").alias("bytes"), F.first("sig").alias("sig")), "classes")
    # values that several classes have, and each class's prefix of its rarest
    posts = classes.select("rep", "sig").mapInArrow(lean(_postings), f"key long, rep {key}")
    shared = posts.groupBy("key").agg(F.count("*").alias("df")).where("df > 1")
    held = posts.join(shared, "key").groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("df", "key"))).alias("held")).where(F.size("held") >= COLLISIONS)  # COORDINATES at most
    popular = F.struct(F.size("held").alias("c"), F.aggregate("held", F.lit(0.0), lambda x, v: x + F.log(v["df"].cast("double"))).alias("s"))  # an original shares all its values
    prefix = held.select("rep", popular.alias("popular"), F.explode(F.slice("held", 1, F.size("held") - COLLISIONS + 1)).alias("v")).select(F.col("v.key").alias("key"), "rep", "popular")
    prefix = written(prefix.join(classes.select("rep", "n_shingles"), "rep"), "prefix")
    # 1. each list's most popular class with the others
    like = 100 * F.least("n_shingles", "lead_n") >= similarity * F.greatest("n_shingles", "lead_n")  # sizes that allow the similarity
    lead = prefix.groupBy("key").agg(F.max(F.struct("popular", "rep", "n_shingles")).alias("top"), F.count("*").alias("n")).where("n > 1").select("key", F.col("top.rep").alias("lead"), F.col("top.n_shingles").alias("lead_n"))
    star = written(prefix.join(lead, "key").where((F.col("rep") != F.col("lead")) & like).select("lead", "rep").distinct(), "star")
    weight = classes.select("rep", "bytes")
    size = star.join(weight, "rep").groupBy("lead").agg(F.ceil(F.greatest(F.count("*") / STAR, F.sum("bytes") / BLOCK_BYTES, F.lit(1.0))).alias("bins"))
    rays = star.join(size, "lead").select("lead", "rep", F.pmod(F.xxhash64("lead", "rep"), "bins").alias("k"))
    bins = rays.select(F.xxhash64("lead", "k").alias("bin"), F.lit(2).alias("side"), "rep", F.col("rep").alias("c")).union(rays.select("lead", "k").distinct().select(F.xxhash64("lead", "k"), F.lit(1), "lead", "lead"))
    links = _confirm(bins, classes, docs, key, width, similarity)
    # 2. trees of the pairs across the components so far, in lists that hold several
    comp = written(components(links), "components")
    placed = written(prefix.join(comp, prefix["rep"] == comp["id"], "left").select("key", "rep", F.coalesce("component", "rep").alias("c")), "placed")
    dropped(prefix)
    mixed = placed.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("n")).where("lo < hi").select("key", "n")
    left = written(placed.join(mixed, "key"), "left")
    lists = _paired(left.join(classes.select("rep", "sig"), "rep"), "key", "n", LIST).withColumn("bin", F.xxhash64("key", "i", "j"))
    trees = components(_dealt(lists, left.count(), 2 * LIST, key, _forest))
    # 3. their pairs on full sets
    many = trees.join(weight, trees["id"] == weight["rep"]).groupBy("component").agg(F.ceil(F.greatest(F.count("*").cast("double"), F.sum("bytes") / BLOCK_BYTES * BLOCK)).alias("size"))
    of = left.select(F.col("rep").alias("id"), "c").distinct()
    members = trees.join(of, "id").join(many, "component").select(F.col("component").alias("tree"), F.col("id").alias("rep"), "c", "size")
    blocks = _paired(members, "tree", "size", BLOCK)
    side = F.when(F.col("i") == F.col("j"), 0).when(F.col("part") == F.col("i"), 1).otherwise(2)
    more = _confirm(blocks.select(F.xxhash64("tree", "i", "j").alias("bin"), side.alias("side"), "rep", "c"), classes, docs, key, width, similarity)
    for t in (placed, left, star):
        dropped(t)
    if more.limit(1).count():
        dropped(comp)
        comp = written(components(links.union(more)), "components")
    reps = classes.join(comp, classes["rep"] == comp["id"], "left").select("f1", "f2", F.col("n_shingles").alias("n"), F.coalesce("component", "rep").alias("component_id"))
    same = (signed["f1"] == reps["f1"]) & (signed["f2"] == reps["f2"]) & (signed["n_shingles"] == reps["n"])
    return signed.join(reps, same, "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def first_of_each(docs: DataFrame, width: int = 5, similarity: int = SIMILARITY) -> DataFrame:
    """One document of each group of near-duplicates: that with the least doc_id; all columns stay."""
    docs = documents(docs)
    return without(docs, lambda: near_duplicates(docs, width, similarity).where("doc_id <> component_id").select("doc_id"))


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"), width=2)
    return found.withColumn("kept", F.col("doc_id") == F.col("component_id"))


OP7_SQL = r"""
with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') w from documents),
s as (select distinct doc_id, case when len(w) = 1 then w[1] else w[i] || ' ' || w[i + 1] end g from (select doc_id, w, unnest(range(1, greatest(len(w), 2))) i from d where len(w) > 0)),
n as (select doc_id, count(*) n from s group by 1),
p as (select x.doc_id a, y.doc_id b, count(*) k from s x join s y on x.g = y.g and x.doc_id < y.doc_id group by 1, 2),
l as (select a, b from p join n na on a = na.doc_id join n nb on b = nb.doc_id where 100 * k >= 80 * (na.n + nb.n - k)),
e as (select a, b from l union all select b, a from l),
r as (select doc_id id, doc_id c from documents union select e.b, r.c from r join e on e.a = r.id),
m as (select id, min(c) c from r group by 1)
select doc_id, coalesce(n, 0)::bigint n_shingles, c component_id, doc_id = c kept from documents join m on m.id = doc_id left join n using (doc_id)
"""
