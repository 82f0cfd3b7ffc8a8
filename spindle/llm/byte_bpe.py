"""Byte-level BPE by recursive SQL in each partition, and decoding by ordered aggregation.

A task splits its texts by the tokenizer's pattern and keeps an embedded DuckDB, which holds the vocabulary as tables:
`pieces` (id, bytes) and `merges` (the ids of two tokens side by side and that of the token they make, which is its rank).
New words become rows of token positions. A recursive query joins neighbours with `merges`, contracts the pair of least rank in
each word (of equal ranks the leftmost), and goes on with the words that had one, until none has: the fixpoint.

Words of over `SHORT` bytes go through a second recursive query, which contracts in one level all pairs that the one-by-one
order would contract in a row: those of the least rank from the left on, up to the first one after which a still lower
rank stands beside the new token. The result is the same in fewer levels. It runs `LEVELS` levels at a time, so that what a recursion gathers
stays bounded. Such words are parted first between bytes that are side by side in no token. Levels grow with the different pairs of a part, so
one unbroken random word of 60,000 letters takes some 100 seconds.

Decoding numbers ids by their place, joins them with `pieces` and aggregates the bytes in that order. In `digests`, a word's ids are
decoded once, when they are made, as a text decodes to its words' bytes in a row. Words, and units between blanks, are
remembered in a worker (`WORD_MEMORY` of each in each of two generations). Nothing is shuffled; a slice of texts is in memory at a time, and a longer text alone.

Defined results: a null or empty text has no tokens and decodes to nothing. Special tokens don't exist here: their texts
are encoded as any other. Ids that the vocabulary lacks can't be decoded: that raises.
"""

from __future__ import annotations

import base64
import hashlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindle.llm.bpe import Memory, tokenizer_path
from spindle.llm.common import documents, held, lean, slices, table

#: Words remembered by a worker, in each of two generations.
WORD_MEMORY = 400_000
#: Bytes of text that a task handles at once (a longer text is handled alone).
TEXT_BYTES = 1_000_000
#: Bytes of new words that one query encodes (a longer word is encoded alone).
NEW_BYTES = 400_000
#: Bytes of a word up to which one pair is contracted in a level.
SHORT = 64
#: Levels of one recursive query over longer words.
LEVELS = 48
#: Ids that one query decodes, at least one text's.
DECODE_IDS = 400_000

#: Contracts one pair of each word in a level. Positions are dense: those behind a contracted pair move up by one.
CONTRACT = """
with recursive step(depth, word, pos, tok) as (
  select 0, word, pos, tok from start
  union all
  select s.depth + 1, s.word, s.pos - (s.pos > l.pos)::int, case when s.pos = l.pos then l.made else s.tok end
  from step s join (
    select word, (first >> 16)::int made, (first & 65535)::int pos from (
      select word, min(made::bigint << 16 | pos) first
      from (select word, pos, tok, lead(tok) over (partition by word order by pos) next from step) n
      join merges m on m.a = n.tok and m.b = n.next group by word)) l on l.word = s.word
  where s.pos <> l.pos + 1)
select word, pos, tok from step join (select word, max(depth) depth from step group by word) using (word, depth) order by word, pos
"""

#: Contracts in a level what the same order would contract in a row; rows of the greatest depth may have more to contract.
CONTRACT_LONG = """
with recursive step(depth, word, pos, tok) as (
  select 0, word, pos, tok from start
  union all
  select depth + 1, word, (row_number() over (partition by word order by pos) - 1)::int, case when hit then low else tok end from (
    select *, lag(hit, 1, false) over (partition by word order by pos) gone from (
      select depth, word, pos, tok, low, hit and not coalesce(bool_or(hit and lower) over (partition by word order by pos rows between unbounded preceding and 1 preceding), false) hit from (
        select h.*, coalesce(x.made < low, false) or coalesce(y.made < low, false) lower from (
          select *, case when hit then case when lag(hit, 2, false) over w then low else lag(tok) over w end end before, case when hit then lead(tok, 2) over w end after from (
            select *, made is not distinct from low and (pos - coalesce(max(case when made is distinct from low then pos end) over (partition by word order by pos), -1)) % 2 = 1 hit from (
              select n.*, m.made, min(m.made) over (partition by word) low
              from (select *, lead(tok) over (partition by word order by pos) next from step where depth < {levels}) n left join merges m on m.a = n.tok and m.b = n.next
            ) where low is not null
          ) window w as (partition by word order by pos)
        ) h left join merges x on x.a = h.before and x.b = h.low left join merges y on y.a = h.low and y.b = h.after
      ))
  ) where not gone)
select word, pos, tok, depth from step join (select word, max(depth) depth from step group by word) using (word, depth) order by word, pos
"""

DECODE = "select doc, unhex(string_agg(hex, '' order by pos)) body from (select i.doc, i.pos, coalesce(p.hex, error('unknown token id ' || i.id)) hex from ids i left join pieces p using (id)) group by doc order by doc"


def _bytes_of(path: str) -> list[tuple[bytes, int]]:
    with open(path, "rb") as f:
        return [(base64.b64decode(a), int(b)) for a, b in map(bytes.split, f)]


class Coder:
    """Encodes and decodes; one in each worker. path: a rank file (base64 of the token's bytes, rank), pattern: how texts split into words."""

    def __init__(self, path: str, pattern: str):
        import duckdb
        import regex

        own = _bytes_of(path)
        rank = dict(own)
        made = [(rank[t[:i]], rank[t[i:]], r) for t, r in own for i in range(1, len(t)) if t[:i] in rank and t[i:] in rank]
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "700MB", "temp_directory": ""})
        columns = [pa.array(c, pa.int32()) for c in zip(*made, strict=True)] or [pa.array([], pa.int32())] * 3
        self._table("merges", pa.table(columns, names=["a", "b", "made"]))
        self._table("pieces", pa.table({"id": pa.array([r for _, r in own], pa.int64()), "hex": pa.array([t.hex() for t, _ in own])}))
        self.one = np.array([rank[bytes([i])] for i in range(256)], np.int32)
        beside = np.zeros((256, 256), bool)  # bytes side by side in some token: between others nothing is ever contracted
        body = np.frombuffer(b"".join(t + t[-1:] for t, _ in own), np.uint8)
        ends = np.cumsum([len(t) + 1 for t, _ in own]) - 1
        inner = np.setdiff1d(np.arange(len(body) - 1), np.concatenate((ends, ends - 1)))
        beside[body[inner], body[inner + 1]] = True
        self.beside = beside
        self.split = regex.compile(pattern).findall
        self.words, self.units = Memory(WORD_MEMORY), Memory(WORD_MEMORY)

    def _table(self, name: str, rows: pa.Table) -> None:
        self.db.register("given", rows)
        self.db.execute(f"create table {name} as select * from given")
        self.db.unregister("given")

    def _rows(self, sql: str, name: str, rows: pa.Table) -> dict[str, np.ndarray]:
        self.db.register(name, rows)
        out = self.db.execute(sql).fetchnumpy()
        self.db.unregister(name)
        return {k: np.ma.getdata(v) for k, v in out.items()}

    def contracted(self, words: list[bytes]) -> list[bytes]:
        """Each word's ids as unsigned 32-bit integers, least byte first."""
        size = np.array([len(w) for w in words], np.int64)
        first = np.cumsum(size) - size
        tok = self.one[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words), dtype=np.int32), size)
        pos = (np.arange(len(tok)) - np.repeat(first, size)).astype(np.int32)
        out: list[bytes] = [b""] * len(words)

        def put(into: list[bytes], of: np.ndarray, ids: np.ndarray) -> None:
            cut = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1]))) if len(of) else np.zeros(0, np.int64)
            body, edge = ids.astype("<u4").tobytes(), np.append(cut, len(of)) * 4
            for k, a, b in zip(of[cut].tolist(), edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                into[k] = body[a:b]

        short = size[word] <= SHORT
        if short.any():
            got = self._rows(CONTRACT, "start", pa.table({"word": word[short], "pos": pos[short], "tok": tok[short]}))
            put(out, got["word"], got["tok"])
        word, pos, tok = word[~short], pos[~short], tok[~short]
        of = word  # parts of long words between which no token reaches are contracted as words of their own
        if len(word):
            body = np.frombuffer(b"".join(words), np.uint8)[~short]
            new = np.concatenate(([True], (word[1:] != word[:-1]) | ~self.beside[body[:-1], body[1:]]))
            at = np.flatnonzero(new)
            of, word = word[at], (np.cumsum(new) - 1).astype(np.int32)
            pos = (np.arange(len(word)) - at[word]).astype(np.int32)
            parts: list[bytes] = [b""] * len(at)
        while len(word):
            got = self._rows(CONTRACT_LONG.format(levels=LEVELS), "start", pa.table({"word": word, "pos": pos, "tok": tok}))
            more = got["depth"] == LEVELS
            put(parts, got["word"][~more], got["tok"][~more])
            word, pos, tok = (got[c][more].astype(np.int32) for c in ("word", "pos", "tok"))
        for k, part in zip(of.tolist(), parts if len(of) else [], strict=True):
            out[k] += part
        return out

    def _encoded(self, words: set[str]) -> dict[str, tuple[bytes, bytes]]:
        """(ids, bytes that these decode to) of words: remembered, or contracted and decoded."""
        made, new = {}, []
        for w in words:
            got = self.words.get(w)
            if got is None:
                new.append(w)
            else:
                made[w] = got
        raw = [w.encode() for w in new]
        for lo, hi in slices(np.concatenate(([0], np.cumsum([len(w) for w in raw]))).astype(np.int64), NEW_BYTES):
            ids = self.contracted(raw[lo:hi])
            for w, got in zip(new[lo:hi], zip(ids, self.decode(ids), strict=True), strict=True):
                made[w] = got
                self.words.put(w, got)
        return made

    def encode(self, texts: list[str]) -> list[tuple[bytes, bytes]]:
        """Each text's ids, as `contracted` gives them, and the bytes that these decode to."""
        own = [_units(t) or self.split(t) for t in texts]
        young = self.units.young
        fresh = set(chain.from_iterable(own)).difference(young)
        if not all(map(_whole, fresh)):
            own = [u if all(x in young or _whole(x) for x in u) else self.split(t) for t, u in zip(texts, own, strict=True)]
            fresh = set(chain.from_iterable(own)).difference(young)
        parts = {}
        made = {}
        for u in fresh:
            got = self.units.old.get(u)
            if got is None:
                parts[u] = self.split(u)
            else:
                made[u] = got
        words = self._encoded(set(chain.from_iterable(parts.values())))
        for u, w in parts.items():
            made[u] = words[w[0]] if len(w) == 1 else (b"".join([words[x][0] for x in w]), b"".join([words[x][1] for x in w]))
        for u, got in made.items():
            if _whole(u):  # words that are white space are no units
                self.units.put(u, got)  # a generation that begins here leaves `young` as it is
        out = []
        for u in own:
            got = [young.get(x) or made[x] for x in u]
            out.append((b"".join([x for x, _ in got]), b"".join([y for _, y in got])))
        return out

    def decode(self, ids: list[bytes]) -> list[bytes]:
        """The bytes of each list of ids."""
        out: list[bytes] = []
        size = np.array([len(x) // 4 for x in ids], np.int64)
        for lo, hi in slices(np.concatenate(([0], np.cumsum(size))), DECODE_IDS):
            n = size[lo:hi]
            doc = np.repeat(np.arange(hi - lo, dtype=np.int32), n)
            pos = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
            got = self._rows(DECODE, "ids", pa.table({"doc": doc, "pos": pos, "id": np.frombuffer(b"".join(ids[lo:hi]), "<u4").astype(np.int64)}))
            own = dict(zip(got["doc"].tolist(), map(bytes, got["body"]), strict=True))
            out += [own.get(i, b"") for i in range(hi - lo)]
        return out


def _units(text: str) -> list[str]:
    """A text cut before its blanks: where single blanks part words, each unit is a whole number of the pattern's matches. Empty if it can't be cut."""
    return [] if "\0" in text else text.replace(" ", "\0 ").split("\0")


def _whole(unit: str) -> bool:
    """Whether nothing but its first blank is white space at the unit's ends, so that no match reaches beyond them."""
    inner = unit.removeprefix(" ")
    return unit == "" or inner != "" and not inner[0].isspace() and not inner[-1].isspace()


def _coder(path: str, pattern: str) -> Coder:
    return held(f"byte-bpe {path} {pattern}", lambda: Coder(path, pattern))


def _texts(column: pa.Array):
    """(from, to, texts) of slices."""
    size = np.array([len(x.as_buffer()) if x.is_valid else 0 for x in column.cast(pa.binary())], np.int64)
    for lo, hi in slices(np.concatenate(([0], np.cumsum(size))), TEXT_BYTES):
        yield lo, hi, [x or "" for x in column.slice(lo, hi - lo).to_pylist()]


def encoded(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids (array of long), n_tokens of every row. docs: doc_id, text."""
    key = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        coder = _coder(path, pattern)
        for batch in batches:
            for lo, hi, texts in _texts(batch.column(1)):
                ids = [x for x, _ in coder.encode(texts)]
                n = np.array([len(x) // 4 for x in ids], np.int64)
                flat = pa.array(np.frombuffer(b"".join(ids), "<u4").astype(np.int64))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))), pa.int32()), flat)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), lists, pa.array(n)], names=["doc_id", "ids", "n_tokens"])

    return docs.select("doc_id", "text").mapInArrow(lean(run, f"byte-bpe {path} {pattern}"), f"doc_id {key}, ids array<long>, n_tokens long")


def decoded(tokens: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, decoded (binary) of every row. tokens: doc_id, ids (null: none)."""
    key = tokens.schema["doc_id"].dataType.simpleString()

    def run(batches):
        coder = _coder(path, pattern)
        for batch in batches:
            ids = [np.array(x or [], "<u4").tobytes() for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(coder.decode(ids), pa.binary())], names=["doc_id", "decoded"])

    return tokens.select("doc_id", F.col("ids").cast("array<long>").alias("ids")).mapInArrow(lean(run, f"byte-bpe {path} {pattern}"), f"doc_id {key}, decoded binary")


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens and the SHA-256 of the ids and of what they decode to; the lists themselves don't leave the worker."""
    key = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        coder = _coder(path, pattern)
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for batch in batches:
            for lo, hi, texts in _texts(batch.column(1)):
                both = coder.encode(texts)
                own = [batch.column(0).slice(lo, hi - lo), pa.array([len(x) // 4 for x, _ in both], pa.int64()), pa.array([sha(x) for x, _ in both], pa.string()), pa.array([sha(y) for _, y in both], pa.string())]
                yield pa.RecordBatch.from_arrays(own, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(lean(run, f"byte-bpe {path} {pattern}"), f"doc_id {key}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from public_tokenizers import PATTERN

    return digests(documents(table(spark, sf_dir, "documents"), "text"), tokenizer_path("byte_bpe_50k.tiktoken"), PATTERN)
