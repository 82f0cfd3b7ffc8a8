"""Benchmark decontamination with a generalised suffix automaton over the words of the test items.

Words are maximal runs of digits, letters (A-Z lower-cased) and bytes from 0x80 on. A *window* is `width` consecutive
words of an item; an item of fewer words (but not none) is one window. An automaton keeps the longest suffix read so far that
is a substring of some item: a window of a long item ends where that length reaches `width`, and a short item ends where
its own state is on the suffix-link path.

1. Items are cut into pieces of `PIECE` words, which overlap so that no window is lost, and dealt to blocks of about `block_words` words.
2. The documents are read once. Word n-grams of the windows, as bits of a map of fixed size, say which stretches of a text
   may hold a window; the map only lets more through when it fills. Nearly all of a corpus ends here.
3. Stretches meet the blocks whose n-grams they hold. A task builds its block's automaton and streams its stretches through it;
   a block with many stretches is dealt to several tasks.
4. Spans are gathered by document.

What is broadcast is the map (at most `MAP_BITS` bits); neither items nor automata pass through the driver.

`decontaminated` drops documents whose hit share reaches a limit; `without_spans` cuts spans out of the texts, beyond limits
on a span's length and on the document's coverage.

Defined results: null or empty text and text without words: no words, not contaminated. Items that are null, have no
words or a null id: no window. Items that repeat an id are one item with the windows of all its rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindle.llm.common import arrow_type, documents, fresh, lean, mix, raw, slices, small, table, without, words, written

WIDTH = 13
#: Item words in one automaton, on average over blocks (some 500 bytes each, in a task).
BLOCK_WORDS = 100_000
#: Words of a piece of an item: no block gets more of an item at once.
PIECE = 10_000
#: Bits of the map of n-grams that documents are held against (32 MB), in parts of `PART_BITS`.
MAP_BITS = 1 << 28
PART_BITS = 1 << 16
#: Stretches that one task streams through its automaton.
STRETCHES = 20_000
#: Share of a document's words that makes it contaminated: hit words * PARTS >= words.
PARTS = 20

#: Bound of the hit documents (some 200 bytes each) that are broadcast; more are joined by shuffle.
BROADCAST_HITS = 100_000

MEMBER = np.zeros(256, dtype=bool)
MEMBER[48:58] = MEMBER[65:91] = MEMBER[97:123] = MEMBER[128:] = True

SPANS = "doc_id {key}, n_words long, starts array<long>, ends array<long>, byte_starts array<long>, byte_ends array<long>, items array<string>"


class SuffixAutomaton:
    """Of several word sequences; states know the items in which their words occur."""

    def __init__(self, width: int = WIDTH):
        self.width = width
        self.step: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.owners: list[set[str]] = [set()]
        self.short: dict[int, list[tuple[int, str]]] = {}
        self._seqs: list[tuple[str, list[int]]] = []

    def _new(self, length: int, link: int, step: dict[int, int]) -> int:
        self.step.append(step)
        self.length.append(length)
        self.link.append(link)
        self.owners.append(set())
        return len(self.step) - 1

    def _extend(self, last: int, c: int) -> int:
        step, link, length = self.step, self.link, self.length
        q = step[last].get(c)
        if q is not None:
            if length[q] == length[last] + 1:
                return q
            return self._split(last, c, q)
        cur = self._new(length[last] + 1, 0, {})
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = cur
            p = link[p]
        if p >= 0:
            q = step[p][c]
            link[cur] = q if length[q] == length[p] + 1 else self._split(p, c, q)
        return cur

    def _split(self, p: int, c: int, q: int) -> int:
        clone = self._new(self.length[p] + 1, self.link[q], dict(self.step[q]))
        self.link[q] = clone
        while p >= 0 and self.step[p].get(c) == q:
            self.step[p][c] = clone
            p = self.link[p]
        return clone

    def add(self, item: str, seq: list[int]) -> None:
        if not seq:
            return
        last = 0
        for c in seq:
            last = self._extend(last, c)
        self._seqs.append((item, seq))

    def close(self) -> "SuffixAutomaton":
        """Marks, for each state, the items whose windows end there. Call once, after the last add."""
        for item, seq in self._seqs:
            v = 0
            if len(seq) < self.width:
                for c in seq:
                    v = self.step[v][c]
                self.short.setdefault(v, []).append((len(seq), item))
                continue
            for c in seq:  # the state of a prefix; the state of its last `width` words is on the link path
                v = self.step[v][c]
                if self.length[v] >= self.width:
                    u = v
                    while self.length[self.link[u]] >= self.width:
                        u = self.link[u]
                    self.owners[u].add(item)
        self._seqs = []
        #: Short items that end wherever a state is reached: those on its link path.
        order = sorted(range(len(self.step)), key=self.length.__getitem__)
        self.below: list[tuple] = [()] * len(self.step)
        for v in order[1:]:
            up = self.link[v]
            self.below[v] = self.below[up] + tuple(self.short.get(up, ()))
        return self

    def scan(self, seq) -> Iterator[tuple[int, int, set[str] | tuple]]:
        """(first word, after last word, items) of each window that occurs in seq."""
        step, link, length, width = self.step, self.link, self.length, self.width
        v = matched = 0
        for i, c in enumerate(seq):
            while v and c not in step[v]:
                v = link[v]
                matched = length[v]
            if c in step[v]:
                v = step[v][c]
                matched += 1
            else:
                matched = 0
                continue
            if matched >= width:
                u = v
                while length[link[u]] >= width:
                    u = link[u]
                if self.owners[u]:
                    yield i + 1 - width, i + 1, self.owners[u]
            for n, item in self.below[v]:
                yield i + 1 - n, i + 1, (item,)
            for n, item in self.short.get(v, ()):
                if matched >= n:
                    yield i + 1 - n, i + 1, (item,)


def _grams(ids: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k consecutive ids."""
    n = len(ids) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + ids[j : j + n].astype(np.uint64) + np.uint64(1))
    return h


def _order(n: int, width: int) -> int:
    """The length of the n-grams that stand for the windows of an item of n words."""
    return min(3, width, n)


def _pieces(batches, width: int):
    """(item, words, n): the word hashes of each item, in pieces; n is the item's whole number of words."""
    for batch in batches:
        data, off = raw(batch.column(1))
        names = batch.column(0)
        for lo, hi in slices(off):
            _, _, doc, h = words(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], MEMBER)
            first = np.searchsorted(doc, np.arange(hi - lo + 1))
            at = [(d, p, min(p + PIECE, int(first[d + 1]))) for d in range(hi - lo) for p in range(int(first[d]), max(int(first[d]) + 1, int(first[d + 1]) - width + 1), PIECE - width + 1) if first[d + 1] > first[d]]
            yield pa.RecordBatch.from_arrays(
                [names.take(pa.array([lo + d for d, _, _ in at], pa.int64())), pa.array([h[a:b].tobytes() for _, a, b in at], pa.binary()), pa.array([int(first[d + 1] - first[d]) for d, _, _ in at], pa.int64())], names=["item", "words", "n"])


def _seeds(batches, width: int):
    """(seed, block): the n-grams of each piece, as hashes that hold their length too."""
    for batch in batches:
        block = batch.column(0).to_numpy()
        out, of = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for i, (x, n) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
            g = np.unique(_grams(np.frombuffer(x, np.uint64), _order(n, width)))
            out.append(g)
            of.append(np.full(len(g), block[i]))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out).view(np.int64)), pa.array(np.concatenate(of))], names=["seed", "block"])


def _map_bits(batches, size: int):
    for batch in batches:
        x = np.unique(batch.column(0).to_numpy().view(np.uint64) % np.uint64(size)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(x // PART_BITS), pa.array(x % PART_BITS)], names=["part", "bit"])


def _map_part(group: pa.Table) -> pa.Table:
    bits = np.zeros(PART_BITS, bool)
    bits[group.column("bit").to_numpy()] = True
    return pa.table({"part": pa.array([group.column("part")[0].as_py()], pa.int64()), "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})


def _has(bits: np.ndarray, g: np.ndarray) -> np.ndarray:
    x = (g % np.uint64(8 * len(bits))).astype(np.int64)
    return (bits[x >> 3] >> (x & 7).astype(np.uint8)) & 1 != 0


SCANNED = "doc_id {key}, n_words long, firsts array<int>, words array<binary>, begins array<binary>, ends array<binary>"


def _stretches(batches, bits: np.ndarray, least: dict[int, int], schema: pa.Schema):
    """One row for each document: its words' number, and its stretches with word hashes and byte places.

    least: for each length of n-grams, the words of the shortest window that they stand for.
    """
    for batch in batches:
        data, off = raw(batch.column(1))
        for lo, hi in slices(off):
            base = off[lo]
            s, e, doc, h = words(data[base : off[hi]], off[lo : hi + 1] - base, MEMBER)
            n = hi - lo
            first = np.searchsorted(doc, np.arange(n + 1))
            edge = np.zeros(len(h) + 1, np.int32)  # the number of stretches that are open at each word
            for k, shortest in least.items():
                if len(h) < k:
                    continue
                at = np.flatnonzero(_has(bits, _grams(h, k)) & (doc[: len(h) - k + 1] == doc[k - 1 :]))
                if not len(at):
                    continue
                cut = np.concatenate(([True], (np.diff(at) != 1) | (doc[at[1:]] != doc[at[:-1]])))
                a, b = at[cut], np.append(at[np.flatnonzero(cut)[1:] - 1], at[-1]) + k
                long = b - a >= shortest
                np.add.at(edge, a[long], 1)
                np.add.at(edge, b[long], -1)
            open_ = np.cumsum(edge[:-1]) > 0
            start = open_.copy()
            start[1:] &= ~open_[:-1] | (doc[1:] != doc[:-1])
            stop = open_.copy()
            stop[:-1] &= ~open_[1:] | (doc[1:] != doc[:-1])
            a, b = np.flatnonzero(start), np.flatnonzero(stop) + 1
            own = np.searchsorted(doc[a], np.arange(n + 1)) if len(a) else np.zeros(n + 1, np.int64)
            begin = off[lo + doc[a]] - base if len(a) else a
            lists = pa.array(own, pa.int32())
            blob = lambda f: pa.ListArray.from_arrays(lists, pa.array([f(x, y, z).tobytes() for x, y, z in zip(a, b, begin, strict=True)], pa.binary()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(lo, n), pa.array(np.diff(first), pa.int64()), pa.ListArray.from_arrays(lists, pa.array((a - first[doc[a]]).astype(np.int32) if len(a) else np.zeros(0, np.int32))),
                 blob(lambda x, y, z: h[x:y]), blob(lambda x, y, z: (s[x:y] - z).astype(np.int64)), blob(lambda x, y, z: (e[x:y] - z).astype(np.int64))], schema=schema)


def _grams_of(batches, orders: list[int]):
    """(seed, sid): the distinct n-grams of each stretch."""
    for batch in batches:
        out, of = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for i, x in enumerate(batch.column(1).to_pylist()):
            h = np.frombuffer(x, np.uint64)
            g = np.unique(np.concatenate([_grams(h, k) for k in orders]))
            out.append(g)
            of.append(np.full(len(g), i))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out).view(np.int64)), batch.column(0).take(pa.array(np.concatenate(of)))], names=["seed", "sid"])


def _matched(rows: pa.Table, items: pa.Table, width: int, schema: pa.Schema) -> pa.Table:
    """(doc_id, starts, ends, byte_starts, byte_ends, items) of each stretch that holds a window. rows: stretches of a task; items: the pieces of its block."""
    if not rows.num_rows or not items.num_rows:
        return schema.empty_table()
    hashes = [np.frombuffer(x, np.uint64) for x in items.column("words").to_pylist()]
    vocab = np.unique(np.concatenate(hashes))
    auto = SuffixAutomaton(width)
    for name, h in zip(items.column("item").to_pylist(), hashes, strict=True):
        auto.add(name, np.searchsorted(vocab, h).tolist())
    auto.close()
    out: list[list] = [[] for _ in schema]
    for r in rows.select(["doc_id", "first", "words", "begins", "ends"]).to_pylist():
        h = np.frombuffer(r["words"], np.uint64)
        at = np.minimum(np.searchsorted(vocab, h), len(vocab) - 1)
        hits = list(auto.scan(np.where(vocab[at] == h, at, -1).tolist()))
        if hits:
            runs = _merged([(a, b) for a, b, _ in hits])
            begins, ends = np.frombuffer(r["begins"], np.int64), np.frombuffer(r["ends"], np.int64)
            row = (r["doc_id"], [r["first"] + a for a, _ in runs], [r["first"] + b for _, b in runs], [int(begins[a]) for a, _ in runs], [int(ends[b - 1]) for _, b in runs], sorted({x for _, _, own in hits for x in own}))
            for col, v in zip(out, row, strict=True):
                col.append(v)
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema)


def _merged(spans: list[tuple[int, int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def contaminated_spans(docs: DataFrame, items: DataFrame, width: int = WIDTH, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Each document's number of words, merged hit spans (in words, and in UTF-8 bytes) and the items that occur.

    docs: doc_id, text. items: item_id, text. Returns doc_id, n_words, starts, ends, byte_starts, byte_ends, items.
    """
    docs = documents(docs, "text")
    spark = docs.sparkSession
    key = docs.schema["doc_id"].dataType.simpleString()
    arrow = arrow_type(key)
    # 1. pieces, blocks and the map of n-grams
    items = items.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("binary").alias("text")).where("item is not null and text is not null")
    pieces = written(items.mapInArrow(lambda b: _pieces(b, width), "item string, words binary, n long"), "pieces")
    size = pieces.agg(F.sum(F.length("words") / 8)).first()[0] or 0
    shortest = pieces.groupBy(F.least("n", F.lit(3)).alias("k")).agg(F.min("n").alias("n")).collect()
    least = {_order(r.n, width): min(r.n, width) for r in sorted(shortest, key=lambda r: -r.k)}
    orders = sorted(least)
    blocks = -(-int(size) // block_words) or 1
    dealt = written(pieces.select(F.pmod(F.xxhash64("item", "words"), F.lit(blocks)).alias("block"), "words", "n", "item"), "dealt")
    seeds = written(dealt.select("block", "words", "n").mapInArrow(lambda b: _seeds(b, width), "seed long, block long").distinct(), "seeds")
    large = min(MAP_BITS, max(PART_BITS, 1 << (64 * seeds.count()).bit_length()))
    parts = seeds.select("seed").mapInArrow(lambda b: _map_bits(b, large), "part long, bit long").distinct().groupBy("part").applyInArrow(_map_part, "part long, bits binary").collect()  # MAP_BITS at most
    bits = np.zeros(large // 8, np.uint8)
    for r in parts:
        bits[r.part * PART_BITS // 8 : (r.part + 1) * PART_BITS // 8] = np.frombuffer(r.bits, np.uint8)
    packed = spark.sparkContext.broadcast(zlib.compress(bits.tobytes(), 1))
    # 2. one pass over the documents
    kinds = [pa.int64(), pa.list_(pa.int32()), *[pa.list_(pa.binary())] * 3]
    schema = pa.schema([("doc_id", arrow), *zip(("n_words", "firsts", "words", "begins", "ends"), kinds, strict=True)])

    def scan(batches):
        yield from _stretches(batches, np.frombuffer(zlib.decompress(packed.value), np.uint8), least, schema)

    scanned = written(docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(lean(scan), SCANNED.format(key=key)), "scanned")
    # 3. stretches with the blocks whose n-grams they hold
    one = F.explode(F.arrays_zip(F.col("firsts").alias("first"), F.col("words").alias("words"), F.col("begins").alias("begins"), F.col("ends").alias("ends")))
    some = scanned.where(F.size("firsts") > 0).select("doc_id", one.alias("s")).select("doc_id", "s.*").withColumn("sid", F.concat_ws("/", F.col("doc_id").cast("string"), "first"))
    pairs = written(some.select("sid", "words").mapInArrow(lambda b: _grams_of(b, orders), "seed long, sid string").join(seeds, "seed").select("sid", "block").distinct(), "pairs")
    tasks = pairs.groupBy("block").agg(F.ceil(F.count("*") / STRETCHES).alias("tasks"))
    rows = pairs.join(small(tasks, 100_000), "block").withColumn("task", F.pmod(F.xxhash64("sid"), "tasks")).join(some, "sid")
    need = dealt.join(tasks, "block").withColumn("task", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tasks") - 1))).select("block", "task", "item", "words")
    spans = pa.schema([("doc_id", arrow), *[(x, pa.list_(pa.int64())) for x in ("starts", "ends", "byte_starts", "byte_ends")], ("items", pa.list_(pa.string()))])
    hits = rows.select("block", "task", "doc_id", "first", "words", "begins", "ends").groupBy("block", "task").cogroup(need.groupBy("block", "task")).applyInArrow(lambda x, y: _matched(x, y, width, spans), SPANS.format(key=key).replace("n_words long, ", ""))
    # 4. by document
    joined = hits.groupBy("doc_id").agg(*[F.flatten(F.collect_list(c)).alias(c) for c in ("starts", "ends", "byte_starts", "byte_ends")], F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    joined = written(joined.mapInPandas(_joined, SPANS.format(key=key).replace("n_words long, ", "")), "hits").withColumnRenamed("doc_id", "_id")
    none = F.array().cast("array<long>")
    lists = [F.coalesce(c, none).alias(c) for c in ("starts", "ends", "byte_starts", "byte_ends")]
    return scanned.select("doc_id", "n_words").join(small(joined, BROADCAST_HITS), F.col("doc_id") == F.col("_id"), "left").select("doc_id", "n_words", *lists, F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def _joined(frames):
    for f in frames:
        for a, b in (("starts", "ends"), ("byte_starts", "byte_ends")):
            runs = [_merged(list(zip(x, y, strict=True))) for x, y in zip(f[a], f[b], strict=True)]
            f[a], f[b] = [[x for x, _ in r] for r in runs], [[y for _, y in r] for r in runs]
        yield f


def decontaminated(docs: DataFrame, items: DataFrame, width: int = WIDTH) -> DataFrame:
    """The documents without those that are contaminated; all columns stay."""
    docs = documents(docs)
    return without(docs, lambda: contaminated_spans(docs, items, width).where(_hit() & (PARTS * _n_hit() >= F.col("n_words"))).select("doc_id"))


def without_spans(docs: DataFrame, items: DataFrame, width: int = WIDTH, max_words: int = 0, max_share: float = 0.0) -> DataFrame:
    """The documents with contaminated spans cut out of their text; all columns stay.

    A span goes if it has more than `max_words` words, and all spans of a document go if its hit words are more than the
    share `max_share` of its words (with 0 for either, any span goes). Cuts are at words' edges, so no character is broken.
    """
    docs = documents(docs)
    found = contaminated_spans(docs, items, width)
    long = F.transform(F.filter(F.arrays_zip("starts", "ends", "byte_starts", "byte_ends"), lambda x: (x["ends"] - x["starts"] > max_words) | (_n_hit() > F.col("n_words") * max_share)), lambda x: F.struct(x["byte_starts"].alias("a"), x["byte_ends"].alias("b")))
    name, cuts = fresh(docs, "_span_id"), fresh(docs, "_cuts")
    some = found.where(_hit()).select(F.col("doc_id").alias(name), long.alias(cuts)).where(F.size(cuts) > 0)
    raw_text = F.col("text").cast("binary")
    edges = F.concat(F.array(F.struct(F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"))), F.col(cuts))
    kept = F.transform(edges, lambda x, i: F.substring(raw_text, (x["b"] + 1).cast("int"), (F.coalesce(F.get(F.transform(edges, lambda y: y["a"]), i + 1), F.length(raw_text).cast("long")) - x["b"]).cast("int")))
    text = F.when(F.col(cuts).isNull(), F.col("text")).otherwise(F.decode(F.aggregate(kept, F.lit(b""), lambda s, x: F.concat(s, x)), "UTF-8"))
    both = docs.join(small(some, BROADCAST_HITS), docs["doc_id"] == F.col(name), "left")
    return both.select(*[text.alias(c) if c.lower() == "text" else docs[c] for c in docs.columns])


def _n_hit():
    return F.aggregate(F.zip_with("ends", "starts", lambda b, a: b - a), F.lit(0).cast("long"), lambda x, y: x + y)


def _hit():
    return F.size("starts") > 0


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = contaminated_spans(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = _n_hit()
    return spans.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("items")).cast("binary"), 256).alias("items_sha256"),
        ((n_hit > 0) & (PARTS * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


OP8_SQL = r"""
with dw as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from documents),
iw as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from benchmark),
win as (select distinct item_id, least(13, len(w)) n, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') s
        from (select item_id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) i from iw where len(w) > 0)),
sizes as (select distinct n from win),
occ as (select doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') s from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) i from dw, sizes where len(w) >= n)),
hits as (select o.doc_id, o.i, o.n, win.item_id from occ o join win using (n, s)),
hw as (select doc_id, count(distinct p) n_hit from (select doc_id, unnest(range(i, i + n)) p from (select distinct doc_id, i, n from hits)) group by 1),
hi as (select doc_id, count(*) n_items, string_agg(x, ',' order by x) ids from (select distinct doc_id, item_id::varchar x from hits) group by 1)
select doc_id, len(w)::bigint n_words, coalesce(n_hit, 0)::bigint n_hit, coalesce(n_items, 0)::bigint n_items,
       sha256(coalesce(ids, '')) items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) contaminated
from dw left join hw using (doc_id) left join hi using (doc_id)
"""
