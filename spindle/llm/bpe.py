"""BPE encoding and decoding with reuse of content-defined chunks.

A rolling hash over the last `ROLL` bytes cuts every text into chunks of some `MEAN` bytes whose borders depend on nearby
content alone, so that documents which share a passage share its chunks, wherever it stands. A chunk is encoded the first
time that a worker meets it and taken from a bounded memory from then on. Chunks end before white space (or, in
a long stretch without any, at a character's first byte). Each join is then repaired: the chunks' ends are encoded as one
piece, in windows that grow until the pieces on both sides agree exactly with what was known; then the middle is exact.

Tokenizers that drop white space and never let it into a token (`isolates_words`) are also exact word by word, so there
the words of a chunk come from a memory of words, and only new words go to the tokenizer.

Encoding needs no shuffle: a task streams its documents, memory is bounded (`CHUNK_MEMORY`, `WORD_MEMORY`), and a lost
executor costs its unfinished tasks only.

Defined results: a null or empty text has no tokens; its decoded text is empty. Texts of special tokens are encoded as the tokenizer does.
"""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindle.llm.common import SALT, documents, held, lean, mix, powers, raw, slices, table

MEAN = 1024
LEAST = 64
ROLL = 32
#: Bytes of whitespace-free text after which a chunk may end inside a word: shorter stretches go to the tokenizer whole.
STRETCH = 1 << 20
#: Bytes of chunk texts remembered by a worker.
CHUNK_MEMORY = 24_000_000
#: Words remembered by a worker, in each of two generations.
WORD_MEMORY = 450_000

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


class Memory:
    """A bounded memo of two generations: what wasn't asked for during a whole generation is forgotten."""

    def __init__(self, limit: int):
        self.limit, self.used = limit, 0
        self.young: dict = {}
        self.old: dict = {}

    def get(self, key):
        got = self.young.get(key)
        if got is None:
            got = self.old.get(key)
            if got is not None:
                self.put(key, got)
        return got

    def put(self, key, value, cost: int = 1) -> None:
        if self.used + cost > self.limit:
            self.old, self.young, self.used = self.young, {}, 0
        self.young[key] = value
        self.used += cost


def cuts(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sorted places (inside texts) where a chunk ends and the next begins."""
    n = len(data)
    if n <= ROLL:
        return np.zeros(0, np.int64)
    base = 0x9E3779B97F4A7C15
    total = np.empty(n + 1, dtype=np.uint64)
    total[0] = 0
    np.cumsum(SALT[data] * powers(base, n), out=total[1:])
    roll = mix((total[ROLL:] - total[:-ROLL]) * powers(pow(base, -1, 2**64), n)[: n - ROLL + 1])
    marks = np.flatnonzero(roll % np.uint64(MEAN) == 0) + ROLL  # the window ends before this byte
    space = np.flatnonzero(_SPACE[data])
    if not len(space):
        space = np.array([n])
    at = np.searchsorted(space, marks)
    to = np.where(at < len(space), space[np.minimum(at, len(space) - 1)], n)
    lead = (data & 0xC0) != 0x80
    far = to - marks > STRETCH
    near = marks.copy()
    for _ in range(3):
        move = (near < n) & ~lead[np.minimum(near, n - 1)]
        near[move] += 1
    to = np.unique(np.where(far, near, to))
    doc = np.searchsorted(off, to, side="right") - 1
    to = to[(to < n) & (off[doc] < to)]
    keep, last = [], -LEAST
    for x in to.tolist():
        if x - last >= LEAST:
            keep.append(x)
            last = x
    return np.array(keep, dtype=np.int64)


class Encoder:
    """Encodes whole texts through chunks; one in each worker."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.isolated = isolates_words(spec)
        self.folds = folds_letters(spec)
        self.plain = spec.get("decoder") is None
        size = self.tok.get_vocab_size(with_added_tokens=True)
        self.names = {str(i): self.tok.id_to_token(i) for i in range(size)}
        end = spec["model"].get("end_of_word_suffix")
        #: Ids of tokens that end a word, where the vocabulary marks them.
        self.last = {i for i in range(size) if (self.tok.id_to_token(i) or "").endswith(end)} if end and self.isolated else set()
        self.chunks, self.words = Memory(CHUNK_MEMORY), Memory(WORD_MEMORY)

    def _ids(self, text: str) -> list[int]:
        return self.tok.encode(text, add_special_tokens=False).ids

    def _new(self, texts: list[str]) -> list[str]:
        return [" ".join(map(str, e.ids)) for e in self.tok.encode_batch(texts, add_special_tokens=False)]

    def _stems(self, words: list[str]) -> list[str]:
        """Ids of words that are one run of letters each: encoded as one text and parted where a token ends a word."""
        out, own = [], []
        for i in self._ids(" ".join(words)):
            own.append(str(i))
            if i in self.last:
                out.append(" ".join(own))
                own = []
        return out if len(out) == len(words) and not own else self._new(words)

    def _chunk(self, chunk: bytes) -> str:
        """The chunk's ids as decimals joined by one space."""
        got = self.chunks.get(chunk)
        if got is None:
            text = chunk.decode("utf-8", "replace")
            if self.isolated and not _odd_space(text):
                own = text.split()
                find = self.words.young.get
                ids = [find(w) for w in own]
                if None in ids:
                    made = self._words({w for w, x in zip(own, ids, strict=True) if x is None})
                    ids = [made[w] if x is None else x for w, x in zip(own, ids, strict=True)]
                got = " ".join([x for x in ids if x])
            else:
                got = self._new([text])[0]
            self.chunks.put(chunk, got, len(chunk) + 64)
        return got

    def _words(self, asked: set[str]) -> dict[str, str]:
        """Ids of words that the younger generation lacks: remembered, or of a stem and a sign, or new."""
        made, parts, fresh = {}, {}, set()
        get = self.words.get
        for w in asked:
            x = get(w)
            if x is not None:
                made[w] = x
                continue
            parts[w] = own = _stem(w) if self.folds else (w,)
            for y in own:
                if y not in made:
                    x = get(y)
                    if x is None:
                        fresh.add(y)
                    else:
                        made[y] = x
        if fresh:
            plain = [w for w in fresh if w.isalpha() and max(w) < "\u0100"] if self.last else []
            rest = [w for w in fresh if not (w.isalpha() and max(w) < "\u0100")] if self.last else list(fresh)
            got = (self._stems(plain) if plain else []) + (self._new(rest) if rest else [])
            for w, x in zip(plain + rest, got, strict=True):
                made[w] = x
                self.words.put(w, x)
        for w, own in parts.items():
            if len(own) > 1 or own[0] != w:
                made[w] = " ".join([made[y] for y in own])
                self.words.put(w, made[w])
        return made

    def _joined(self, left: bytes | bytearray, known, right: bytes) -> tuple[int, list[str], int] | None:
        """What a join changes: (tokens dropped at left's end, tokens put there, tokens dropped at right's start); None if nothing.

        known() gives left's ids. Windows double until the joined encoding begins as the left piece and ends as the right one do,
        each with tokens to spare, or until they are all of both.
        """
        size = 1
        while True:
            a, b = _tail(left, size), _head(right, size)
            ia, ib = self._piece(a), self._piece(b)
            both = [str(i) for i in self._ids((a + b).decode("utf-8", "replace"))]
            if both == ia + ib:
                return None
            whole = len(a) == len(left) and len(b) == len(right)
            same_a, same_b = _common(ia, both), _common(ib[::-1], both[::-1])
            if whole:
                return len(known()), both, len(self._chunk(right).split())
            if same_a >= 2 and same_b >= 2 and same_a + same_b <= len(both) and known()[-len(ia) :] == ia and self._chunk(right).split()[: len(ib)] == ib:
                return len(ia), both, len(ib)
            size = max(48, size * 2)

    def _piece(self, chunk: bytes) -> list[str]:
        """Ids of a chunk's end, from the memory of words where it is one word."""
        text = chunk.decode("utf-8", "replace")
        got = self.words.get(text.strip(" \n")) if self.isolated else None
        return got.split() if got is not None else [str(i) for i in self._ids(text)]

    def encode(self, pieces: list[bytes]) -> str:
        """The ids of a text, given as its chunks, as decimals joined by one space."""
        done: list[str] = []
        left: bytes | bytearray = b""  # the chunk before, or those that repaired joins have made one
        own: list[str] = []  # the latter's ids

        def known() -> list[str]:
            return own or self._chunk(bytes(left)).split()

        for piece in pieces:
            if left:
                fix = self._joined(left, known, piece)
                if fix is not None:  # the join reaches into both: from here on they count as one
                    drop_a, put, drop_b = fix
                    if not own:
                        own, left = known(), bytearray(left)
                    del own[len(own) - drop_a :]
                    own += put + self._chunk(piece).split()[drop_b:]
                    left += piece
                    continue
                done.append(" ".join(own) if own else self._chunk(left))
            left, own = piece, []
        if left:
            done.append(" ".join(own) if own else self._chunk(left))
        return " ".join([x for x in done if x])

    def decode(self, ids: str) -> str:
        if not ids:
            return ""
        own = ids.split(" ")
        if self.plain:  # without a decoder, the tokenizer joins its tokens by one space
            return " ".join(map(self.names.__getitem__, own))
        return self.tok.decode([int(x) for x in own], skip_special_tokens=False)


def _stem(word: str) -> tuple[str, ...]:
    """A word of Latin-1 letters in lower case, and the sign after it if there is one; any other word as it is.

    There, lower case and composition work letter by letter, and the pattern parts letters from signs.
    """
    if word >= "\u0100" or max(word) >= "\u0100":
        return (word,)
    if word.isalpha():
        return (word.lower(),)
    if word[-1] in ",.;:!?" and word[:-1].isalpha():
        return word[:-1].lower(), word[-1]
    return (word,)


def _odd_space(text: str) -> bool:
    """Characters that str.split() takes for white space and \\s does not."""
    return any(x in text for x in "\x1c\x1d\x1e\x1f")


def _tail(chunk: bytes | bytearray, size: int) -> bytes:
    """The end of a chunk from a word's start on: at least `size` bytes, or the whole chunk."""
    at = len(chunk) - size
    while at > 0 and not _SPACE[chunk[at]]:
        at -= 1
    return bytes(chunk[max(at, 0) :])


def _head(chunk: bytes, size: int) -> bytes:
    at = size
    while at < len(chunk) and not _SPACE[chunk[at]]:
        at += 1
    return chunk[:at]


def _common(x: list, y: list) -> int:
    n = 0
    for a, b in zip(x, y):  # noqa: B905
        if a != b:
            break
        n += 1
    return n


def isolates_words(spec: dict) -> bool:
    """Whether white space only separates: runs of it are made one blank, and the pattern that splits words has no place for it."""
    norm = json.dumps(spec.get("normalizer") or {})
    pre = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or []
    return bool(
        pre and pre[0].get("type") == "Split" and pre[0].get("invert") and pre[0].get("behavior") == "Removed"
        and " ?" not in pre[0]["pattern"].get("Regex", " ?") and "[^\\s\\p{L}\\p{N}]" in pre[0]["pattern"]["Regex"]
        and '"\\\\s+"' in norm and not any(t.get("lstrip") or t.get("rstrip") or " " in t["content"] for t in spec.get("added_tokens", []))
    )


def folds_letters(spec: dict) -> bool:
    """Whether `_stem` holds: nothing but composition, blanks for white space and lower case comes before the split."""
    norm = spec.get("normalizer") or {}
    steps = norm.get("normalizers", [norm])
    kinds = [x.get("type") for x in steps]
    return "Lowercase" in kinds and all(k in ("NFC", "Lowercase") or k == "Replace" and x.get("pattern") == {"Regex": "\\s+"} for k, x in zip(kinds, steps, strict=True))


def _encoder(path: str) -> Encoder:
    return held(f"bpe {path}", lambda: Encoder(path))


def chunks_of(data: np.ndarray, off: np.ndarray) -> list[list[bytes]]:
    """Each text's chunks."""
    at = cuts(data, off)
    at = at[np.isin(at, off, invert=True)]
    edge = np.searchsorted(at, off)
    body = data.tobytes()
    out = []
    for i in range(len(off) - 1):
        places = [int(off[i]), *at[edge[i] : edge[i + 1]].tolist(), int(off[i + 1])]
        out.append([body[a:b] for a, b in zip(places[:-1], places[1:]) if a < b])  # noqa: B905
    return out


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (decimals joined by one space), n_tokens, decoded of every row. docs: doc_id, text. path: a tokenizers file on every machine."""
    key = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        enc = _encoder(path)
        for batch in batches:
            data, off = raw(batch.column(1))
            for lo, hi in slices(off):
                ids = [enc.encode(p) for p in chunks_of(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])]
                n = [x.count(" ") + 1 if x else 0 for x in ids]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(ids, pa.string()), pa.array(n, pa.int64()), pa.array([enc.decode(x) for x in ids], pa.string())], names=["doc_id", "ids", "n_tokens", "decoded"])

    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(lean(run, f"bpe {path}"), f"doc_id {key}, ids string, n_tokens long, decoded string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens and the SHA-256 of ids and decoded text; the texts themselves don't leave the worker."""
    key = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        enc = _encoder(path)
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        for batch in batches:
            data, off = raw(batch.column(1))
            for lo, hi in slices(off):
                rows = []
                for p in chunks_of(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]):
                    ids = enc.encode(p)
                    rows.append((ids.count(" ") + 1 if ids else 0, sha(ids), sha(enc.decode(ids))))
                cols = list(zip(*rows, strict=True)) or [(), (), ()]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(lean(run, f"bpe {path}"), f"doc_id {key}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(documents(table(spark, sf_dir, "documents"), "text"), tokenizer_path())
