"""Removal of repeated passages across documents: distributed suffix order and longest previous factors.

A byte goes if a string of `LENGTH` bytes that covers it also starts in a document with a smaller doc_id. That is: the
longest previous factor at the string's first position, over smaller documents, is at least `LENGTH`.

One suffix array of all texts would need every suffix of the corpus in one order. Instead:

1. Every `LENGTH`-byte window has a *minimiser*, the least hash of its `GRAM`-byte substrings, which depends on the
   window's bytes alone. A maximal run of windows with one minimiser is kept whole, so a text has about one run for
   each 17 bytes. Equal windows have equal minimisers and thus meet in one partition.
2. Partitions of 32-bit fingerprints of minimisers say which of them more than one document holds. A block of documents
   sends each minimiser once, whatever the number of its documents, so that a hot one counts once for each block.
   Only runs of such minimisers go on (a fingerprint that collides costs work and changes nothing).
3. Runs, sent as their bytes alone (compressed, as texts are where they meet what is asked of them), meet by minimiser. Runs with equal bytes are a class, whose least document is its first copy: in other documents they go whole.
   Where a minimiser has several classes (passages that end, or differ nearby), their suffixes are sorted by
   prefix doubling up to `LENGTH` bytes. In suffix order, the previous and the next position of a smaller document give a
   suffix's longest previous factor: the greater of its common prefixes with the two (counted up to `LENGTH`).
   A hash only proposes that runs are equal: their bytes are compared before either goes for sure.
4. Spans are gathered by document, merged and cut out.

A minimiser that many blocks hold may have as many classes; its windows are dealt one by one by their own hash, so that
no partition gathers them. All its documents do so: what its part says of it goes to the block, whose bucket also has the block's
other documents of it. Parts and fingerprints together decide that, so that a collision takes all documents of both minimisers along.

Defined results: null text is empty; texts shorter than `LENGTH` bytes stay whole; matches within a document don't count.
doc_id must be of an integer type.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindle.llm.common import SALT, documents, dropped, fresh, lean, lean_group, mix, powers, raw, slices, table, written

LENGTH = 50
GRAM = 18
#: Blocks that hold a minimiser, from which on its windows are dealt one by one.
HOT_BLOCKS = 96
#: Text bytes of a block.
BLOCK_BYTES = 12_000_000
#: Text bytes for each partition of minimisers.
PART_BYTES = 8_000_000
#: Bound of the spans (bytes) that are broadcast to the texts; more are joined by shuffle.
BROADCAST_BYTES = 32_000_000

_BASE, _INV = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 2**64)
_U = np.uint64


def _prefix(data: np.ndarray) -> np.ndarray:
    """Sums from which the hash of any substring follows."""
    total = np.empty(len(data) + 1, dtype=np.uint64)
    total[0] = 0
    np.cumsum(SALT[data] * powers(_BASE, len(data)), out=total[1:])
    return total


def _hash(total: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix((total[b] - total[a]) * powers(_INV, len(total))[a] + (b - a).astype(np.uint64))


def minimisers(data: np.ndarray, off: np.ndarray, total: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """Runs of windows: (text index, first byte of the first window, number of windows, minimiser)."""
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none, np.zeros(0, np.uint64)
    n = len(data) - gram + 1
    at = np.arange(n)
    m = _hash(total, at, at + gram)
    span, c = length - gram + 1, 1
    while c * 2 <= span:
        m = np.minimum(m[:-c], m[c:])
        c *= 2
    if c < span:
        k = len(data) - length + 1
        m = np.minimum(m[:k], m[span - c : span - c + k])
    texts = np.flatnonzero(np.diff(off) >= length)
    first = np.zeros(len(m) + 1, dtype=np.int32)  # which window starts are inside a text
    np.add.at(first, off[texts], 1)
    np.add.at(first, off[texts + 1] - length + 1, -1)
    inside = np.cumsum(first[:-1]) > 0
    new = inside.copy()
    new[1:] &= ~inside[:-1] | (m[1:] != m[:-1])
    new[off[texts]] = True
    starts = np.flatnonzero(new)
    doc = np.searchsorted(off, starts, side="right") - 1
    last = off[doc + 1] - length + 1  # after the last window of the text
    ends = np.minimum(np.append(starts[1:], len(m)), last)
    return doc, starts, ends - starts, m[starts]


def _fingerprint(m: np.ndarray, parts: int) -> np.ndarray:
    return ((m // _U(parts)) & _U(0xFFFFFFFF)).astype(np.uint32)


def _bins(part: np.ndarray) -> list[tuple[int, int, int]]:
    """(part, from, to) of a sorted array."""
    if not len(part):
        return []
    cut = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
    return [(int(part[a]), int(a), int(b)) for a, b in zip(cut, np.append(cut[1:], len(part)), strict=True)]


_SEED = pa.schema([("part", pa.int32()), ("block", pa.int64()), ("docs", pa.binary()), ("n", pa.binary()), ("fp", pa.binary()), ("of", pa.binary())])
SEED_DDL = "part int, block long, docs binary, n binary, fp binary, of binary"


def _seeds(batches, parts: int):
    """Each block's minimisers, once each with the least document, by part; and at once those that several of its documents hold, with their parts.

    A block is named by its least document.
    """
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        data, off = raw(batch.column(1))
        for first, last in slices(off, BLOCK_BYTES):
            docs, mins = [], []
            for lo, hi in slices(off[first : last + 1]):
                at = off[first + lo : first + hi + 1]
                part = data[at[0] : at[-1]]
                doc, _, _, m = minimisers(part, at - at[0], _prefix(part))
                docs.append(ids[first + lo + doc])
                mins.append(m)
            yield _seed_rows(np.concatenate(docs), np.concatenate(mins), parts)


def _seed_rows(doc: np.ndarray, m: np.ndarray, parts: int) -> pa.RecordBatch:
    block = doc.min()
    out: list[list] = [[] for _ in _SEED]
    order = np.lexsort((doc, m))
    doc, m = doc[order], m[order]
    new = np.ones(len(m), bool)
    new[1:] = m[1:] != m[:-1]
    pair = new.copy()
    pair[1:] |= doc[1:] != doc[:-1]
    doc, m, new = doc[pair], m[pair], new[pair]
    several = ~new
    several[:-1] |= ~new[1:]
    for known, pick in ((False, new), (True, several)):
        d, x = doc[pick], m[pick]
        of = (x % _U(parts)).astype(np.int32)
        part = np.repeat(_bucket(np.array([block]), parts), len(d)) if known else of
        order = np.lexsort((of, d, part))
        d, x, part, of = d[order], x[order], part[order], of[order]
        fp = _fingerprint(x, parts)
        for p, a, b in _bins(part):
            for col, v in zip(out, (p, int(block), *_packed(d[a:b]), fp[a:b].tobytes(), of[a:b].tobytes() if known else None), strict=True):
                col.append(v)
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(out, _SEED, strict=True)], schema=_SEED)


def _bucket(doc: np.ndarray, parts: int) -> np.ndarray:
    return (mix(doc.astype(np.uint64)) % _U(parts)).astype(np.int32)


def _squeezed(body) -> bytes:
    """Bytes as they are shuffled: prose takes two thirds of what Spark's own compression leaves."""
    return pa.compress(body, "zstd", asbytes=True) if len(body) else b""


def _whole(body: pa.Buffer, size: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(body, int(size), "zstd") if size else b"", np.uint8)


SQUEEZED_DDL = "doc_id long, text binary, size int"


def _squeezed_texts(batches):
    """doc_id, the compressed text and its size."""
    for batch in batches:
        text = [x.as_buffer() for x in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([_squeezed(x) for x in text], pa.binary()), pa.array([len(x) for x in text], pa.int32())], names=["doc_id", "text", "size"])


def _whole_texts(batches):
    """The batches (doc_id, text, size, and more) with whole texts and without size, a slice of texts each."""
    for batch in batches:
        size = batch.column(2).to_numpy()
        for lo, hi in slices(np.concatenate(([0], np.cumsum(size, dtype=np.int64)))):
            part = batch.slice(lo, hi - lo)
            text = [_whole(x.as_buffer(), n).tobytes() for x, n in zip(part.column(1), size[lo:hi], strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(text, pa.binary()), *part.columns[3:]], names=["doc_id", "text", *part.schema.names[3:]])


def _packed(doc: np.ndarray) -> tuple[bytes, bytes]:
    """Sorted documents as distinct ones with their counts."""
    first = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
    return doc[first].tobytes(), np.diff(np.append(first, len(doc))).astype(np.int32).tobytes()


def _column(table: pa.Table, name: str, kind) -> np.ndarray:
    """All values of a column of blobs."""
    return np.concatenate([*(np.frombuffer(x.as_buffer(), kind) for x in table.column(name)), np.zeros(0, kind)])


def _docs(table: pa.Table) -> np.ndarray:
    return np.repeat(_column(table, "docs", np.int64), _column(table, "n", np.int32))


_ASK = pa.schema([("bucket", pa.int32()), ("hot", pa.bool_()), ("part", pa.int32()), ("blocks", pa.binary()), ("k", pa.binary()), ("docs", pa.binary()), ("n", pa.binary()), ("fp", pa.binary()), ("of", pa.binary())])
ASK_DDL = "bucket int, hot boolean, part int, blocks binary, k binary, docs binary, n binary, fp binary, of binary"
ASKED_DDL = "doc_id long, fp binary, hot binary"


def _repeated(group: pa.Table, parts: int) -> pa.Table:
    """Of a part's minimisers, those of several blocks, told to each block; and those that blocks knew of (rows with `of`). Packed by bucket of blocks."""
    sent = pa.compute.is_null(group.column("of"))
    new, old = group.filter(sent), group.filter(pa.compute.invert(sent))
    doc, fp = _docs(new), _column(new, "fp", np.uint32)
    block = np.repeat(new.column("block").to_numpy(), _lengths(new, "fp"))
    order = np.argsort(fp, kind="stable")
    doc, fp, block = doc[order], fp[order], block[order]
    cut = np.flatnonzero(np.concatenate(([True], fp[1:] != fp[:-1]))) if len(fp) else np.zeros(0, np.int64)
    n = np.diff(np.append(cut, len(fp)))
    n = np.repeat(n, n)
    doc, fp, block, hot = doc[n > 1], fp[n > 1], block[n > 1], n[n > 1] >= HOT_BLOCKS
    bucket = _bucket(block, parts).astype(np.int64) * 2 + hot
    order = np.lexsort((doc, block, bucket))
    doc, fp, block, bucket = doc[order], fp[order], block[order], bucket[order]
    own = int(group.column("part")[0].as_py())
    rows = [(p // 2, bool(p % 2), own, *_packed(block[a:b]), *_packed(doc[a:b]), fp[a:b].tobytes(), None) for p, a, b in _bins(bucket)]
    for x in old.to_pylist():
        count = np.array([len(x["fp"]) // 4], np.int32).tobytes()
        rows.append((x["part"], False, None, np.array([x["block"]], np.int64).tobytes(), count, x["docs"], x["n"], x["fp"], x["of"]))
    return pa.Table.from_arrays([pa.array([r[i] for r in rows], t.type) for i, t in enumerate(_ASK)], schema=_ASK)


def _lengths(table: pa.Table, name: str) -> np.ndarray:
    """Numbers of 4-byte values of a column of blobs."""
    return np.array([len(x.as_buffer()) // 4 for x in table.column(name)], np.int64)


def _place(fp: np.ndarray, part: np.ndarray) -> np.ndarray:
    """Part and fingerprint of minimisers as one number."""
    return (part.astype(np.uint64) << _U(32)) | fp.astype(np.uint64)


def _asked(group: pa.Table) -> pa.Table:
    """One row for each document of a bucket's blocks: fingerprints, and places of hot minimisers."""
    told = pa.compute.is_null(group.column("of"))
    new, old = group.filter(told), group.filter(pa.compute.invert(told))
    n = _lengths(new, "fp")
    hot = np.repeat(new.column("hot").to_numpy(zero_copy_only=False).astype(bool), n)
    key = _place(_column(new, "fp", np.uint32), np.repeat(new.column("part").to_numpy().astype(np.int64), n))
    block, doc = np.repeat(_column(new, "blocks", np.int64), _column(new, "k", np.int32)), _docs(new)
    order = np.argsort(block, kind="stable")
    hot, key, block, doc = hot[order], key[order], block[order], doc[order]
    spans = {p: (a, b) for p, a, b in _bins(block)}
    known = {int(np.frombuffer(x.as_buffer(), np.int64)[0]): i for i, x in enumerate(old.column("blocks"))}
    rows = []
    for one in sorted(spans.keys() | known.keys()):
        a, b = spans.get(one, (0, 0))
        d, x, h = doc[a:b], key[a:b], hot[a:b]
        if one in known:
            row = old.slice(known[one], 1)
            kx = _place(_column(row, "fp", np.uint32), _column(row, "of", np.int32))
            d, x, h = np.concatenate((d, _docs(row))), np.concatenate((x, kx)), np.concatenate((h, np.isin(kx, x[h])))
        order = np.lexsort((h, d))
        d, x, h = d[order], x[order], h[order]
        for p, a, b in _bins(d):
            c = a + int(np.searchsorted(h[a:b], True))
            rows.append((p, (x[a:c] & _U(0xFFFFFFFF)).astype(np.uint32).tobytes(), x[c:b].tobytes()))
    return pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "fp": pa.array([r[1] for r in rows], pa.binary()), "hot": pa.array([r[2] for r in rows], pa.binary())})


_RUN = pa.schema([("part", pa.int32()), ("kind", pa.int32()), ("docs", pa.binary()), ("n", pa.binary()), ("start", pa.binary()), ("size", pa.binary()), ("bytes", pa.binary())])
RUN_DDL = "part int, kind int, docs binary, n binary, start binary, size binary, bytes binary"
#: Kinds of rows: runs of windows, single windows of hot minimisers, spans that go for sure. Hashes aren't sent, as the bytes give them.
RUNS, WINDOWS, SURE = 0, 1, 2
SPAN_DDL = "doc_id long, starts array<long>, ends array<long>"


def _member(doc: np.ndarray, fp: np.ndarray, lists: list[bytes]) -> np.ndarray:
    """Whether a document's list holds the fingerprint."""
    asked = [np.frombuffer(x, np.uint32) for x in lists]
    have = np.concatenate([*asked, np.zeros(0, np.uint32)]).astype(np.uint64) | (np.repeat(np.arange(len(asked), dtype=np.uint64), [len(x) for x in asked]) << _U(32))
    have.sort()
    key = fp.astype(np.uint64) | (doc.astype(np.uint64) << _U(32))
    if not len(have):
        return np.zeros(len(key), bool)
    at = np.searchsorted(have, key)
    at[at == len(have)] = 0
    return have[at] == key


def _hot(doc: np.ndarray, key: np.ndarray, lists: list[bytes]) -> np.ndarray:
    """Whether a document's list holds the place of a minimiser."""
    asked = [np.frombuffer(x, np.uint64) for x in lists]
    have = np.unique(np.concatenate([*asked, np.zeros(0, np.uint64)]))
    if not len(have):
        return np.zeros(len(key), bool)
    at = np.minimum(np.searchsorted(have, key), len(have) - 1)
    return (have[at] == key) & _member(doc, at.astype(np.uint32), [np.searchsorted(have, x).astype(np.uint32).tobytes() for x in asked])


def _runs(batches, parts: int, length: int = LENGTH):
    """The runs that go on, by part: m, h (of the run's bytes), document, first byte, bytes; later copies in the block are sure to go.

    A block ends at BLOCK_BYTES of texts or of runs: the more parts, the more runs a row needs to be worth its columns.
    """
    block, size, moved = [], 0, 0
    for one in _asked_runs(batches, parts, length):
        block.append(one)
        size, moved = size + len(one[0]), moved + int((one[2] - one[1]).sum())
        if max(size, moved) >= BLOCK_BYTES:
            yield _run_rows(block, parts)
            block, size, moved = [], 0, 0
    if block:
        yield _run_rows(block, parts)


def _asked_runs(batches, parts: int, length: int):
    """Of each slice of texts: its bytes, and the start, end, place in the document, document, h, key and kind of the runs that go on."""
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        data, off = raw(batch.column(1))
        asked, hot = batch.column(2).to_pylist(), batch.column(3).to_pylist()
        for lo, hi in slices(off):
            text, at = data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
            total = _prefix(text)
            doc, start, n, m = minimisers(text, at, total)
            fp = _fingerprint(m, parts)
            cold, warm = _member(doc, fp, asked[lo:hi]), _hot(doc, _place(fp, m % _U(parts)), hot[lo:hi])
            cold &= ~warm
            k = n[warm]
            each = _spread(start[warm], k)  # the windows of hot runs
            d = np.concatenate((doc[cold], np.repeat(doc[warm], k)))
            s = np.concatenate((start[cold], each))
            e = np.concatenate((start[cold] + n[cold] + length - 1, each + length))
            if not len(d):
                continue
            h = _hash(total, s, e)
            kind = np.repeat(np.array([RUNS, WINDOWS]), [cold.sum(), k.sum()])
            key = np.where(kind == RUNS, np.concatenate((m[cold], h[cold.sum() :])), h)
            yield text, s, e, s - at[d], ids[lo + d], h, key, kind


def _run_rows(block: list, parts: int) -> pa.RecordBatch:
    text = np.concatenate([x[0] for x in block])
    base = np.repeat(np.cumsum([0, *(len(x[0]) for x in block[:-1])]), [len(x[1]) for x in block])
    s, e, place, own, h, key, kind = (np.concatenate(x) for x in list(zip(*block, strict=True))[1:])
    order = np.lexsort((own, h, key, kind))
    s, e, place, own, h, key, kind = (x[order] for x in (s + base, e + base, place, own, h, key, kind))
    new = np.concatenate(([True], (key[1:] != key[:-1]) | (h[1:] != h[:-1]) | (kind[1:] != kind[:-1])))
    kind[own > own[_heads(new, text, s, e - s)]] = SURE
    part = np.where(kind == SURE, _bucket(own, parts), key % _U(parts)).astype(np.int64)
    order = np.lexsort((place, own, kind, part))
    s, e, place, own, kind, part = (x[order] for x in (s, e, place, own, kind, part))
    out: list[list] = [[] for _ in _RUN]
    for p, a, b in _bins(part * 4 + kind):
        size = (e[a:b] - s[a:b]).astype(np.int32)
        body = b"" if p % 4 == SURE else _squeezed(text[_spread(s[a:b], size)])
        for col, v in zip(out, (p // 4, p % 4, *_packed(own[a:b]), place[a:b].astype(np.int32).tobytes(), size.tobytes(), body), strict=True):
            col.append(v)
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(out, _RUN, strict=True)], schema=_RUN)


def _spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each size."""
    return np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())


def _rank(*keys: np.ndarray) -> np.ndarray:
    """Dense ranks of the rows of keys, in their order."""
    key = keys[0] if len(keys) == 1 else (keys[0].astype(np.uint64) << _U(32)) | keys[1].astype(np.uint64)
    return np.unique(key, return_inverse=True)[1].astype(np.uint32)


def earlier(body: np.ndarray, begin: np.ndarray, size: np.ndarray, doc: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(string index, offset) of each suffix with a previous factor of `length` bytes in a string of a smaller document.

    body holds strings (begin, size) of at least `length` bytes. Suffixes are ordered by prefix doubling: ranks of 8
    bytes, then of 16 and 32, then of `length` by two overlapping halves.
    """
    order, pos, of = suffix_order(body, begin, size, length)
    factor = previous_factors(body, pos[order], doc[of[order]], length)
    hit = np.sort(order[factor >= length])
    return of[hit], pos[hit] - begin[of[hit]]


def suffix_order(body: np.ndarray, begin: np.ndarray, size: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, place, string) of the suffixes of `length` bytes at least; the order is that of their first `length` bytes, then of place."""
    pad = np.concatenate((body, np.zeros(length + 8, np.uint8)))
    n = len(body)
    word = np.zeros(n + length, np.uint64)
    for j in range(8):
        word |= np.concatenate((pad[j : j + n], np.zeros(length, np.uint8))).astype(np.uint64) << _U(56 - 8 * j)
    rank, have = _rank(word), 8
    while have * 2 <= length:
        rank = _rank(rank[: len(rank) - have], rank[have:])
        have *= 2
    if have < length:
        rank = _rank(rank[: len(rank) - (length - have)], rank[length - have :])
    k = size - length + 1
    pos = _spread(begin, k)
    return np.argsort(rank[pos], kind="stable"), pos, np.repeat(np.arange(len(begin)), k)


def common_prefixes(body: np.ndarray, pos: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """How many bytes, up to `length`, each suffix of an order shares with the one before it (the first: 0)."""
    out = np.zeros(len(pos), np.int16)
    for at in range(1, len(pos), 20_000):
        x, y = pos[at - 1 : at + 19_999], pos[at : at + 20_000]
        x = x[: len(y)]
        live = np.arange(len(y))
        for j in range(length):  # those that still agree
            live = live[body[x[live] + j] == body[y[live] + j]]
            if not len(live):
                break
            out[at + live] += 1
    return out


def previous_factors(body: np.ndarray, pos: np.ndarray, doc: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """The longest previous factor, up to `length` bytes, of each suffix (in suffix order) in a smaller document.

    It is the greater of the common prefixes with the previous and the next suffix of a smaller document. Pointers to these
    start at the neighbour and jump along the pointers of what they point at, as nothing between is smaller.
    """
    lcp = common_prefixes(body, pos, length)
    best = np.zeros(len(pos), np.int16)
    for side in (1, -1):
        d = doc[::side]
        share = lcp.copy() if side == 1 else np.append(lcp[1:], 0)[::-1].astype(np.int16)
        to = np.arange(-1, len(d) - 1)
        live = np.flatnonzero((to >= 0) & (share > 0))
        live = live[d[to[live]] >= d[live]]
        while len(live):
            via = to[live]
            low = np.minimum(share[live], share[via])
            to[live], share[live] = to[via], low
            live = live[(to[live] >= 0) & (low > 0)]
            live = live[d[to[live]] >= d[live]]
        found = np.where((to >= 0) & (d[np.maximum(to, 0)] < d), share, 0)
        best = np.maximum(best, found[::side])
    return best


def _equal(body: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the strings of these sizes at a and at b are equal, byte by byte."""
    out = np.ones(len(a), bool)
    edge = np.concatenate(([0], np.cumsum(size)))
    for lo, hi in slices(edge):
        if hi > lo and edge[hi] > edge[lo]:
            other = np.flatnonzero(body[_spread(a[lo:hi], size[lo:hi])] != body[_spread(b[lo:hi], size[lo:hi])])
            out[lo + np.searchsorted(edge[lo : hi + 1] - edge[lo], other, side="right") - 1] = False
    return out


def _heads(new: np.ndarray, body: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The first row of each row's class. Classes (new: where one begins) are equal by hash; what differs in bytes becomes a class of its own."""
    head = np.flatnonzero(new)[np.cumsum(new) - 1]
    rows = np.flatnonzero(head != np.arange(len(head)))
    same = size[rows] == size[head[rows]]
    same[same] = _equal(body, start[rows[same]], start[head[rows[same]]], size[rows[same]])
    head[rows[~same]] = rows[~same]
    return head


def _least_gram(body: np.ndarray, begin: np.ndarray, size: np.ndarray, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """The minimiser and the hash of each string."""
    m, h = np.zeros(len(begin), np.uint64), np.zeros(len(begin), np.uint64)
    edge = np.append(begin, len(body))
    for lo, hi in slices(edge):
        part, at = body[edge[lo] : edge[hi]], begin[lo:hi] - edge[lo]
        total = _prefix(part)
        h[lo:hi] = _hash(total, at, at + size[lo:hi])
        place = np.arange(len(part) - gram + 1)
        g = _hash(total, place, place + gram)
        cut = np.empty(2 * len(at), np.int64)  # from each string's first gram to after its last
        cut[::2], cut[1::2] = at, at + size[lo:hi] - gram + 1
        m[lo:hi] = np.minimum.reduceat(np.append(g, _U(2**64 - 1)), cut)[::2]
    return m, h


#: Bytes of strings whose suffixes are sorted at once (strings of one minimiser stay together).
SORT_BYTES = 1_000_000


def _factors(group: pa.Table, parts: int, length: int = LENGTH) -> pa.Table:
    """Spans that go, of a part's runs, packed by bucket of documents."""
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    kinds = group.column("kind").to_numpy()
    for kind in (RUNS, WINDOWS, SURE):
        rows = group.filter(pa.array(kinds == kind))
        doc, start, size = _docs(rows), _column(rows, "start", np.int32).astype(np.int64), _column(rows, "size", np.int32).astype(np.int64)
        if kind == SURE:
            found.append((doc, start, start + size))
        elif len(doc):
            body = np.concatenate([_whole(x.as_buffer(), np.frombuffer(k.as_buffer(), np.int32).sum()) for x, k in zip(rows.column("bytes"), rows.column("size"), strict=True)])
            del rows
            begin = np.cumsum(size) - size
            m, h = _least_gram(body, begin, size)
            found += _earlier_spans(m if kind == RUNS else h, h, doc, start, size, begin, body, length)
    doc, start, end = merged(*(np.concatenate(x) for x in zip(*found, strict=True)))
    bucket = _bucket(doc, parts)
    order = np.lexsort((start, doc, bucket))
    doc, start, end, bucket = doc[order], start[order], end[order], bucket[order]
    rows = [(p, *_packed(doc[a:b]), start[a:b].astype(np.int32).tobytes(), end[a:b].astype(np.int32).tobytes()) for p, a, b in _bins(bucket)]
    return pa.Table.from_arrays([pa.array([r[i] for r in rows], t.type) for i, t in enumerate(_CUT)], schema=_CUT)


_CUT = pa.schema([("bucket", pa.int32()), ("docs", pa.binary()), ("n", pa.binary()), ("starts", pa.binary()), ("ends", pa.binary())])
CUT_DDL = "bucket int, docs binary, n binary, starts binary, ends binary"


def _spans(group: pa.Table) -> pa.Table:
    """One row of merged spans for each document of a bucket."""
    doc, start, end = merged(_docs(group), _column(group, "starts", np.int32).astype(np.int64), _column(group, "ends", np.int32).astype(np.int64))
    cut = _bins(doc)
    offsets = pa.array([a for _, a, _ in cut] + [len(doc)], pa.int32())
    return pa.table({"doc_id": pa.array([p for p, _, _ in cut], pa.int64()), "starts": pa.ListArray.from_arrays(offsets, pa.array(start, pa.int64())), "ends": pa.ListArray.from_arrays(offsets, pa.array(end, pa.int64()))})


def _earlier_spans(m, h, doc, start, size, begin, body, length):
    """Spans of runs that smaller documents hold: whole copies of a class, and long enough previous factors among the classes of a minimiser."""
    order = np.lexsort((start, doc, h, m))
    m, h, doc, start, size, begin = (x[order] for x in (m, h, doc, start, size, begin))
    new = np.concatenate(([True], (m[1:] != m[:-1]) | (h[1:] != h[:-1])))
    heads = _heads(new, body, begin, size)
    head, of = np.unique(heads, return_inverse=True)
    later = doc > doc[heads]
    yield doc[later], start[later], start[later] + size[later]
    same = m[head]
    first = np.flatnonzero(np.concatenate(([True], same[1:] != same[:-1])))
    n = np.diff(np.append(first, len(same)))
    pick = head[np.repeat(n, n) > 1]  # classes of minimisers with several of them
    edges = np.concatenate(([0], np.cumsum(n[n > 1])))
    weight = np.concatenate(([0], np.cumsum(size[pick])))[edges]
    places = np.flatnonzero(~later)  # where the least document holds its class
    places = places[np.argsort(of[places], kind="stable")]
    by = of[places]
    for lo, hi in slices(weight, SORT_BYTES):
        own = pick[edges[lo] : edges[hi]]
        k = size[own]
        which, offset = earlier(body[_spread(begin[own], k)], np.cumsum(k) - k, k, doc[own], length)
        if not len(which):
            continue
        cut = np.concatenate(([True], (which[1:] != which[:-1]) | (offset[1:] != offset[:-1] + 1)))
        a = np.flatnonzero(cut)  # neighbouring offsets make one span
        b = np.append(a[1:], len(which)) - 1
        left_of, right_of = offset[a], offset[b] + length
        cls = of[own][which[a]]
        left, right = np.searchsorted(by, cls), np.searchsorted(by, cls, side="right")
        rep = right - left
        at = places[_spread(left, rep)]
        yield doc[at], start[at] + np.repeat(left_of, rep), start[at] + np.repeat(right_of, rep)


def merged(doc: np.ndarray, start: np.ndarray, end: np.ndarray):
    """Spans that overlap or touch become one, by document and place."""
    if not len(doc):
        return doc, start, end
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    shift = np.cumsum(np.concatenate(([0], doc[1:] != doc[:-1]))) * (int(end.max()) + 1)  # one line for all documents
    reach = np.maximum.accumulate(end + shift)
    cut = np.concatenate(([True], (start + shift)[1:] > reach[:-1]))
    a = np.flatnonzero(cut)
    last = np.append(a[1:], len(doc)) - 1
    return doc[a], start[a], reach[last] - shift[a]


def repeated_spans(docs: DataFrame) -> DataFrame:
    """doc_id, starts, ends: the bytes that go, as merged spans, of each document that loses some. docs: doc_id, text. A written table.

    What blocks ask for is written too, so that the files of all minimisers are gone before texts and runs are shuffled.
    """
    spark = docs.sparkSession
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).where("length(text) >= %d" % LENGTH)
    size = text.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES))
    asked = text.mapInArrow(lean(lambda b: _seeds(b, parts)), SEED_DDL).repartition(parts, "part").groupBy("part").applyInArrow(lean_group(lambda t: _repeated(t, parts)), ASK_DDL)
    asked = written(asked.repartition(parts, "bucket").groupBy("bucket").applyInArrow(lean_group(_asked), ASKED_DDL), "asked")
    runs = text.mapInArrow(lean(_squeezed_texts), SQUEEZED_DDL).join(asked, "doc_id").select("doc_id", "text", "size", "fp", "hot").mapInArrow(lean(lambda b: _runs(_whole_texts(b), parts)), RUN_DDL)
    cuts = runs.repartition(parts, "part").groupBy("part").applyInArrow(lean_group(lambda t: _factors(t, parts)), CUT_DDL)
    spans = written(cuts.repartition(parts, "bucket").groupBy("bucket").applyInArrow(lean_group(_spans), SPAN_DDL), "spans")
    dropped(asked)
    return spans


def _kept_bytes(text: bytes, starts, ends) -> bytes:
    if starts is None or not len(starts):
        return text
    edges = [0, *(x for pair in zip(starts, ends, strict=True) for x in pair), len(text)]
    return b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))


def _with_spans(docs: DataFrame, spans: DataFrame) -> tuple[DataFrame, str, str]:
    """docs with two more columns, starts and ends (null where nothing goes), and their names; the written spans are broadcast if their counted size is small."""
    size = spans.agg(F.sum(16 * F.size("starts") + 40)).first()[0] or 0
    key, starts, ends = (fresh(docs, x) for x in ("_span_id", "_starts", "_ends"))
    spans = spans.toDF(key, starts, ends)
    return docs.join(F.broadcast(spans) if size <= BROADCAST_BYTES else spans, docs["doc_id"] == spans[key], "left"), starts, ends


def removal(docs: DataFrame) -> DataFrame:
    """doc_id, kept (the bytes that stay), n_bytes, n_removed, n_spans of every document."""
    docs = documents(docs, "text")
    key = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            text = [x or b"" for x in batch.column(1).to_pylist()]
            starts, ends = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            kept = [_kept_bytes(*x) for x in zip(text, starts, ends, strict=True)]
            n = [len(x) for x in text]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(kept, pa.binary()), pa.array(n, pa.int64()), pa.array([a - len(b) for a, b in zip(n, kept, strict=True)], pa.int64()), pa.array([len(x or ()) for x in starts], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in kept])],
                names=["doc_id", "kept", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    both, starts, ends = _with_spans(docs, repeated_spans(docs))
    return both.select("doc_id", F.col("text").cast("binary").alias("text"), starts, ends).mapInArrow(run, f"doc_id {key}, kept binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame) -> DataFrame:
    """The documents with repeated passages cut out of their text; all columns stay.

    A span's edge may lie inside a character: the bytes of such a broken character become U+FFFD in the text.
    """
    docs = documents(docs)

    def run(texts, starts, ends):
        import pandas as pd

        return pd.Series([None if t is None else _kept_bytes(t.encode(), a, b).decode("utf-8", "replace") for t, a, b in zip(texts, starts, ends, strict=True)])

    cut = F.pandas_udf(run, "string")
    both, starts, ends = _with_spans(docs, repeated_spans(docs.select("doc_id", "text")))
    return both.select(*[F.when(F.col(starts).isNull(), F.col("text")).otherwise(cut("text", starts, ends)).alias(c) if c.lower() == "text" else docs[c] for c in docs.columns])


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removal(table(spark, sf_dir, "documents")).drop("kept")


OP2_SQL = """
with d as (select doc_id, hex(encode(coalesce(text, ''))) x from documents),
w as (select doc_id, i, substr(x, 2 * i + 1, 100) s from (select doc_id, x, unnest(range(0, (len(x) // 2) - 49)) i from d where len(x) >= 100)),
f as (select s, min(doc_id) lo from w group by s having min(doc_id) < max(doc_id)),
h as (select w.doc_id, w.i from w join f using (s) where w.doc_id > f.lo),
g as (select doc_id, i, coalesce(i - lag(i) over (partition by doc_id order by i) > 50, true)::int new from h),
r as (select doc_id, min(i) a, max(i) + 50 b from (select doc_id, i, sum(new) over (partition by doc_id order by i) k from g) group by doc_id, k),
k as (select doc_id, a, b, coalesce(lag(b) over (partition by doc_id order by a), 0) before, lead(a) over (partition by doc_id order by a) is null final from r),
p as (select k.doc_id, string_agg(substr(x, 2 * before + 1, 2 * (a - before)) || case when final then substr(x, 2 * b + 1) else '' end, '' order by a) kept, sum(b - a) n_removed, count(*) n_spans from k join d using (doc_id) group by k.doc_id)
select doc_id, (len(x) // 2)::bigint n_bytes, coalesce(n_removed, 0)::bigint n_removed, coalesce(n_spans, 0)::bigint n_spans, sha256(unhex(coalesce(kept, x))) kept_sha256
from d left join p using (doc_id)
"""
