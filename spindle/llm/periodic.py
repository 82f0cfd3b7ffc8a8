"""Periodic runs of words by Lyndon arrays on two ordered alphabets, without suffix structures or hashes.

A run is a maximal stretch of words with smallest period q. One of its roots is, under one of two opposite orders of the
words, the longest Lyndon word from its place on: that which ends before the next smaller suffix. So the Lyndon arrays of both orders
propose all runs, and the common extensions of both ends of a Lyndon word give each run's borders (Bannai et al.; Ellert and Fischer).

`lyndon` walks over the words once, with the previous smaller suffixes as its stack, and knows the common extension of a suffix and each of its
neighbours in that stack. The extension of the next pair follows from the two extensions before unless these are equal; only then words are
compared, from there on. The furthest stretch that is known to repeat another is kept: pairs inside take the extension of their
copies, and comparing goes on where that stretch ends, so no stretch is matched twice. Words become numbers in order of their first
occurrence in the text; any order would do.

Before that, a text is cut to stretches that can hold a run: in a run of at least 4 periods and 6 words every three words
in a row stand at least three times in the text, so that stretches without are left out and all runs stay, whole and with their own borders.

All work is within a row; nothing is shuffled.

Defined results: a null, empty or blank text has no words and no runs; its collapsed text is empty. Rows keep their doc_id's type.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindle.llm.common import documents, lean, table

#: Least words and least periods of a run that counts.
LEAST, PERIODS = 6, 4


def _same(x: list, i: int, j: int) -> int:
    """How many elements from i < j on are equal."""
    k, n, step = 0, len(x) - j, 1
    while k < n:
        step = min(step, n - k)
        if x[i + k : i + k + step] == x[j + k : j + k + step]:
            k += step
            step *= 2
        elif step == 1:
            break
        else:
            step = max(1, step // 4)
    return k


def lyndon(x: list) -> tuple[list[int], list[int]]:
    """The next smaller suffix of each suffix, and how many elements it shares with it. (The end is smaller than any element.)"""
    n = len(x)
    after, shared = [n] * n, [0] * n  # next smaller suffixes
    before, with_before = [-1] * n, [0] * n  # previous smaller suffixes
    equal = [0] * (n + 1)  # of each suffix with the one before it
    for r in range(n - 1, 0, -1):
        if x[r] == x[r - 1]:
            equal[r] = equal[r + 1] + 1
    begin = end = shift = 0  # x[begin:end] repeats what stands `shift` before it
    for r in range(1, n):
        i, k = r - 1, equal[r]
        while True:
            to = r + k
            if to > end:
                begin, end, shift = r, to, r - i
            if to < n and x[i + k] < x[to]:
                break
            after[i], shared[i] = r, k
            m = with_before[i]
            i = before[i]
            if i < 0:
                k = 0
                break
            if m != k:
                k = min(m, k)
                continue
            if r < end:  # r lies in the stretch known to repeat
                q, known = r - shift, -1
                p = i - shift if i >= begin else i
                if 0 <= p < q:
                    if after[p] == q:
                        known = shared[p]
                    elif before[q] == p:
                        known = with_before[q]
                if known >= 0:
                    if r + known < end:
                        k = known
                        continue
                    k = max(k, end - r)
            k += _same(x, i + k, r + k)
        before[r], with_before[r] = i, k
    return after, shared


def runs(x: list[int], least: int = LEAST, periods: int = PERIODS) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of at least `least` elements and `periods` (2 or more) periods, in that order."""
    found = set()
    for y in (x, [-v for v in x]):
        for i, (j, right) in enumerate(zip(*lyndon(y), strict=True)):
            p = j - i
            if right <= (periods - 2) * p:
                continue
            left = 0
            while left < p and left < i and y[i - 1 - left] == y[j - 1 - left]:
                left += 1
            if left < p and left + p + right >= max(least, periods * p):  # else an earlier root of the run tells it
                found.add((i - left, left + p + right, p))
    return sorted(found, key=lambda r: (r[0], r[2]))


def stretches(a: np.ndarray, kinds: int) -> list[tuple[int, int]]:
    """(from, to) of the stretches of words in which every three in a row stand at least three times."""
    if len(a) < LEAST:
        return []
    pair = a[:-1] * kinds + a[1:]
    if kinds > 1 << 20:
        pair = np.unique(pair, return_inverse=True)[1]
    key = pair[:-1] * kinds + a[2:]
    order = np.argsort(key)
    key = key[order]
    twice = key[2:] == key[:-2]
    many = np.zeros(len(key), bool)
    many[2:] |= twice
    many[1:-1] |= twice
    many[:-2] |= twice
    if not many.any():
        return []
    live = np.zeros(len(key) + 2, np.int8)
    live[order + 1] = many
    edge = np.flatnonzero(np.diff(live))
    lo, hi = edge[::2], edge[1::2] + 2
    some = hi - lo >= LEAST
    return list(zip(lo[some].tolist(), hi[some].tolist(), strict=True))


def word_runs(words: list) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a text's words, by start, then period."""
    if len(words) < LEAST:
        return []
    number: dict = {}
    x = [number.setdefault(w, len(number)) for w in words]
    if len(number) > len(x) - LEAST + 1:
        return []
    return [(lo + s, n, p) for lo, hi in stretches(np.array(x, np.int64), len(number)) for s, n, p in runs(x[lo:hi])]


def without_periods(words: list, found: list[tuple[int, int, int]]) -> list:
    """The words but those that a run repeats: all of it after its first period."""
    if not found:
        return words
    kept, at = [], 0
    for lo, hi in sorted((s + p, s + n) for s, n, p in found):
        if lo > at:
            kept += words[at:lo]
        at = max(at, hi)
    return kept + words[at:]


def _mapped(docs: DataFrame, row: Callable, ddl: str, schema: list[pa.DataType], change: Callable | None) -> DataFrame:
    """doc_id and what row(words, runs) gives, of every document."""
    key = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            rows = []
            for i in range(len(batch)):
                words = (batch.column(1)[i].as_py() or b"").split()  # at blanks and tab to carriage return
                if change:
                    words = change(batch.column(0)[i].as_py(), words)
                rows.append(row(words, word_runs(words)))
            cols = list(zip(*rows, strict=True)) or [()] * len(schema)
            names = [x.split()[0] for x in ddl.split(", ")]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(cols, schema, strict=True)]], names=["doc_id", *names])

    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(lean(run), f"doc_id {key}, {ddl}")


def periodic_runs(docs: DataFrame, change: Callable | None = None) -> DataFrame:
    """doc_id, starts, lengths, periods (arrays, by start, then period) of every document's runs. change(doc_id, words) may give other words."""
    long = pa.list_(pa.int64())
    return _mapped(documents(docs, "text"), lambda _, r: tuple([x[k] for x in r] for k in range(3)), "starts array<long>, lengths array<long>, periods array<long>", [long] * 3, change)


def collapsed(docs: DataFrame, change: Callable | None = None) -> DataFrame:
    """doc_id and the text without the repeats of its runs, its words joined by one blank."""
    return _mapped(documents(docs, "text"), lambda w, r: (b" ".join(without_periods(w, r)).decode("utf-8", "replace"),), "text string", [pa.string()], change)


def _digest(words: list, found: list[tuple[int, int, int]]) -> tuple:
    best = max(found, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    sha = lambda x: hashlib.sha256(x).hexdigest()
    return len(found), *top, sha("".join(f"{s},{n},{p}\n" for s, n, p in found).encode()), sha(b" ".join(without_periods(words, found)))


def digests(docs: DataFrame, change: Callable | None = None) -> DataFrame:
    """doc_id, n_runs, the longest run (of equal ones the first, then that of the least period), and digests of all runs and of the collapsed text."""
    ddl = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
    return _mapped(documents(docs, "text"), _digest, ddl, [pa.int64()] * 5 + [pa.string()] * 2, change)


def with_copies(doc_id, words: list) -> list:
    """The query's own change: in a tenth of the documents, the words from some place on become copies of the first few of them."""
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * (-(-(n - a) // p)))[: n - a]


def op12_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), with_copies)


#: The CRC-32 of a string's bytes, whose table follows from its polynomial.
CRC32 = """crc as (select list(v order by i) t from (select i, list_reduce(list_prepend(i, range(8)), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) v from range(256) b(i)))"""


def crc_of(text: str) -> str:
    """SQL of the CRC-32 of an expression of ASCII or UTF-8 text; the query must have `crc`."""
    codes = f"list_transform(range(length(hex(encode({text}))) // 2), lambda i: ('0x' || substr(hex(encode({text})), 2 * i + 1, 2))::bigint)"
    return f"xor(4294967295::bigint, list_reduce(list_prepend(4294967295::bigint, {codes}), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])))"


OP12_SQL = rf"""
with {CRC32},
d0 as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w, {crc_of('doc_id::varchar')} h from documents, crc),
d1 as (select doc_id, w, len(w)::bigint n, h, h // 10 g, (h // 10) % greatest(len(w), 1) a from d0),
d2 as (select *, 1 + (n - a) // (3 + g % 8) p from d1),
x0 as (select *, unnest(range(n)) i from d2),
x as (select doc_id, i, w[1 + case when h % 10 = 0 and i >= a then a + (i - a) % p else i end] v from x0),
e as (select b.doc_id, b.i - a.i q, a.i from x a join x b on a.doc_id = b.doc_id and a.v = b.v and a.i < b.i),
s as (select doc_id, q, i, i - row_number() over (partition by doc_id, q order by i) isle from e),
r0 as (select doc_id, q, min(i) start, count(*) + q length from s group by doc_id, q, isle having count(*) + q >= greatest(6, 4 * q)),
r as (select doc_id, start, length, min(q) period from r0 group by doc_id, start, length),
gone as (select distinct doc_id, unnest(range(start + period, start + length)) i from r),
kept as (select x.doc_id, string_agg(v, ' ' order by x.i) body from x anti join gone on gone.doc_id = x.doc_id and gone.i = x.i group by x.doc_id),
t as (select doc_id, count(*) n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' order by start, period) body, first({{'s': start, 'l': length, 'p': period}} order by length desc, start, period) top from r group by doc_id)
select doc_id, coalesce(n_runs, 0)::bigint n_runs, top.s::bigint start, top.l::bigint length, top.p::bigint period, (1000 * top.l // top.p)::bigint exponent_milli, sha256(coalesce(t.body, '')) runs_sha256, sha256(coalesce(kept.body, '')) collapsed_sha256
from documents left join t using (doc_id) left join kept using (doc_id)
"""
