"""Byte-level BPE, periodic runs and spelling variants against libraries and brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spindle.llm import bpe, byte_bpe, periodic, spelling

SCHEMA = "doc_id long, text string, word string, n long, path string, ids string, words long"


@pytest.fixture(scope="module")
def texts():
    r = random.Random(8)
    words = ["".join(r.choice("abcdeghij") for _ in range(r.randint(1, 11))) for _ in range(120)]
    prose = lambda n: " ".join(r.choice(words) for _ in range(n))
    own = [None, "", "  \n\t ", "one", "a b " * 400, prose(3000), "x" * 3000, "and" * 400, "It's 5 o'clock　<|endoftext|> é", "中" * 900 + "文字" * 90, "😀" * 50, "tab\there\n\n  and  two blanks ", " lead\x00nul \x00", prose(40) + "\n" + prose(40), "ab ab ab ab x x x x x x y y y y y"]
    for _ in range(60):
        base = prose(r.randint(1, 60)).split()
        own.append(" ".join(base + base[: r.randint(0, 9)] * r.randint(0, 7) + base).upper() if r.random() < 0.2 else " ".join(base + base[: r.randint(0, 9)] * r.randint(0, 7)))
    return dict(enumerate(own))


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(d, t, "w", 1, "p", "i", 2) for d, t in texts.items()]
    return spark.createDataFrame([*rows, rows[5], (3, None, None, None, None, None, None), (None, "lost", None, None, None, None, None)], SCHEMA).repartition(3).cache()


# -- byte-level BPE

@pytest.fixture(scope="module")
def library():
    import tiktoken
    from public_tokenizers import PATTERN

    path = bpe.tokenizer_path("byte_bpe_50k.tiktoken")
    return path, PATTERN, tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=dict(byte_bpe._bytes_of(path)), special_tokens={})


def test_byte_bpe_equals_the_library(docs, texts, library):
    path, pattern, own = library
    tokens = byte_bpe.encoded(docs.where("doc_id is not null").dropDuplicates(["doc_id", "text"]).where("not (doc_id = 3 and text is null)"), path, pattern)
    got = {r.doc_id: r for r in tokens.collect()}
    want = {d: own.encode_ordinary(t or "") for d, t in texts.items()}
    assert {d: list(r.ids) for d, r in got.items()} == want and all(r.n_tokens == len(want[d]) for d, r in got.items())
    assert {r.doc_id: bytes(r.decoded).decode() for r in byte_bpe.decoded(tokens, path, pattern).collect()} == {d: t or "" for d, t in texts.items()}
    assert byte_bpe.digests(docs.limit(0), path, pattern).count() == 0 and byte_bpe.decoded(tokens.limit(0), path, pattern).count() == 0


def test_byte_bpe_query_columns(spark, docs, texts, library, tmp_path):
    _, _, own = library
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = byte_bpe.op11_byte_bpe(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    want = {}
    for d, t in texts.items():
        ids = own.encode_ordinary(t or "")
        want[d] = (len(ids), hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest(), hashlib.sha256(own.decode_bytes(ids)).hexdigest())
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got.collect()} == want


@pytest.mark.parametrize("alphabet", ["ab", "etaoin", "abcdefghijklmnopqrstuvwxyz", "=-*", "éèàü", "中文字"])
def test_long_words_contract_in_the_librarys_order(library, alphabet, monkeypatch):
    path, pattern, own = library
    monkeypatch.setattr(byte_bpe, "LEVELS", 5)
    r, coder = random.Random(3), byte_bpe.Coder(path, pattern)
    texts = ["".join(r.choice(alphabet) for _ in range(n)) for n in (1, 40, 65, 150, 400)] + ["".join(r.choice(alphabet) for _ in range(k)) * (200 // k) for k in (1, 2, 3, 7)]
    for t, (ids, body) in zip(texts, coder.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == own.encode_ordinary(t) and body == t.encode()


def test_white_space_is_split_as_the_library_does(library, monkeypatch):
    path, pattern, own = library
    monkeypatch.setattr(byte_bpe, "WORD_MEMORY", 50)  # generations change all the time
    r, coder = random.Random(4), byte_bpe.Coder(path, pattern)
    texts = ["".join(r.choice(" \n\t　\x1c\x00ab1.'") for _ in range(r.randint(0, 20))) for _ in range(600)]
    for at in range(0, 600, 60):
        for t, (ids, _) in zip(texts[at : at + 60], coder.encode(texts[at : at + 60]), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == own.encode_ordinary(t), t
    with pytest.raises(Exception, match="unknown token id"):
        coder.decode([(60_000).to_bytes(4, "little")])


# -- periodic runs

def brute_runs(x, least=6, periods=4):
    n, out = len(x), {}
    for q in range(1, n // periods + 1):
        i = 0
        while i + q < n:
            s = i
            while i + q < n and x[i] == x[i + q]:
                i += 1
            if i - s + q >= max(least, periods * q):
                out.setdefault((s, i - s + q), q)
            i += 1
    return sorted(((s, n, q) for (s, n), q in out.items()), key=lambda r: (r[0], r[2]))


def test_runs_equal_brute_force():
    r = random.Random(2)
    for _ in range(1500):
        k = r.choice([1, 2, 2, 3, 4])
        x = [r.randrange(k) for _ in range(r.randint(0, 50))]
        if r.random() < 0.6:
            b = [r.randrange(k) for _ in range(r.randint(1, 7))]
            x = x[: r.randint(0, 20)] + b * r.randint(1, 8) + x[: r.randint(0, 9)] + b * r.randint(0, 5) + x
        assert periodic.runs(x, 2, 2) == brute_runs(x, 2, 2) and periodic.runs(x) == brute_runs(x) == periodic.word_runs(x)


def test_lyndon_arrays_equal_their_definition_in_linear_time(monkeypatch):
    r = random.Random(5)
    for _ in range(200):
        x = [r.randrange(3) for _ in range(r.randint(1, 40))]
        after, shared = periodic.lyndon(x)
        for i in range(len(x)):
            j = next((j for j in range(i + 1, len(x)) if x[j:] < x[i:]), len(x))
            k = 0
            while j + k < len(x) and x[i + k] == x[j + k]:
                k += 1
            assert (after[i], shared[i]) == (j, k)
    compared, same = [0], periodic._same

    def counted(x, i, j):
        k = same(x, i, j)
        compared[0] += k + 1
        return k

    monkeypatch.setattr(periodic, "_same", counted)
    fib = [[0], [0, 1]]
    while len(fib[-1]) < 20_000:
        fib.append(fib[-1] + fib[-2])
    for x in ([0] * 20_000, [0, 1] * 10_000, fib[-1], [bin(i).count("1") % 2 for i in range(20_000)], (([0, 1] * 20 + [2]) * 20 + [3]) * 25, [(i & -i).bit_length() for i in range(1, 20_000)], [r.randrange(2) for _ in range(999)] * 20):
        compared[0] = 0
        periodic.runs(x)
        assert compared[0] <= 4 * len(x)


def test_stretches_with_many_kinds_of_words():
    r = random.Random(6)
    x = np.array([r.randrange(40) for _ in range(400)] + [1, 2, 3] * 5 + [7] * 6)
    assert periodic.stretches(x, 41) == periodic.stretches(x, 1 << 21) and periodic.stretches(x[:5], 41) == []


def test_periodic_query_equals_brute_force(spark, docs, texts, tmp_path):
    want = {}
    for d, t in texts.items():
        w = re.findall(rb"[^\x20\x09-\x0d]+", (t or "").encode())
        h, n = zlib.crc32(str(d).encode()), len(w)
        if h % 10 == 0 and n:
            g = h // 10
            a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        runs = brute_runs(w)
        gone = {i for s, m, q in runs for i in range(s + q, s + m)}
        top = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
        sha = lambda x: hashlib.sha256(x).hexdigest()
        want[d] = (len(runs), *(top or (None,) * 3), top and 1000 * top[1] // top[2], sha("".join("%d,%d,%d\n" % r for r in runs).encode()), sha(b" ".join(x for i, x in enumerate(w) if i not in gone)))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = periodic.op12_periodic(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert {r[0]: tuple(r)[1:] for r in got.collect()} == want and sum(x[0] > 0 for x in want.values()) > 5
    plain = {r.doc_id: list(zip(r.starts, r.lengths, r.periods, strict=True)) for r in periodic.periodic_runs(docs).collect()}
    assert plain == {d: brute_runs((t or "").encode().split()) for d, t in texts.items()}
    assert {r.doc_id: r.text for r in periodic.collapsed(docs).where("doc_id in (0, 1, 4, 14)").collect()} == {0: "", 1: "", 4: "a b", 14: "ab ab ab ab x y y y y y"}
    assert periodic.digests(docs.limit(0)).count() == 0


# -- spelling variants

def brute_variants(count, times=10):
    near = {w: set() for w in count}
    for w in count:
        for i in range(len(w) + 1):
            for c in {x for y in count for x in y}:
                near[w] |= {w[:i] + c + w[i:], w[:i] + c + w[i + 1 :]} & count.keys() - {w}
            near[w] |= {w[:i] + w[i + 1 :]} & count.keys() - {w}
    form = {}
    for w, own in near.items():
        best = min(own, key=lambda x: (-count[x], x), default=None)
        form[w] = best if best is not None and count[best] >= times * count[w] else None
    out = {}
    for w in count:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, count[w], len(near[w]), count[form[w]] if form[w] else None)
    return out


@pytest.mark.parametrize("crowd", [200, 1])
def test_variants_equal_brute_force(spark, crowd, monkeypatch):
    monkeypatch.setattr(spelling, "CROWD", crowd)
    r = random.Random(7)
    words = {"".join(r.choice("abc") for _ in range(r.randint(3, 9))) for _ in range(500)} | {"prefixed" + "".join(r.choice("xyzé") for _ in range(r.randint(0, 5))) for _ in range(300)} | {"aaaaaaa", "aaaaaaaa", "aaaaaaaaa", "q" * 3000, "q" * 3001, "q" * 2999 + "z"}
    count = {w: r.choice([2, 3, 20, 40, 300, 5000, 5000]) for w in words}
    df = spark.createDataFrame(list(count.items()), "word string, n long")
    got = {x.word: (x.form, x.root, x.n, x.n_near, x.form_n) for x in spelling.variants(df).collect()}
    short = {w: n for w, n in count.items() if len(w) < 100}
    want = brute_variants(short)
    assert {w: x for w, x in got.items() if w in short} == want and any(x[0] and x[1] != x[0] for x in want.values())
    q = {w: got[w][3] for w in words if len(w) > 100}
    assert q == {"q" * 3000: 2, "q" * 3001: 1, "q" * 2999 + "z": 1}
    assert spelling.variants(df.limit(0)).count() == 0


def test_spelling_query_equals_brute_force(spark, tmp_path):
    r = random.Random(9)
    words = ["".join(r.choice("abcdÀéÿ") for _ in range(r.randint(5, 9))) for _ in range(60)]
    pick = lambda: r.choice(words[: 1 + r.randrange(60)])
    rows = [(d, " ".join(pick().upper() if r.random() < 0.1 else pick() for _ in range(80)) + "-1") for d in range(120)]
    rows += [(500, None), (501, ""), (502, "÷×÷×÷×÷ " * 2), (0, None), (None, "nothing nothing")]
    count: dict = {}
    for d, t in {d: t for d, t in rows if d is not None and t is not None}.items():
        for w in re.findall("[A-Za-zÀ-ÿ]+", t):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in w)
            h = zlib.crc32(f"{d}:{w}".encode())
            w = w[: h % len(w)] + w[h % len(w) + 1 :] if h % 31 == 0 else w
            if len(w) >= 7:
                count[w] = count.get(w, 0) + 1
    spark.createDataFrame(rows, "doc_id long, text string").withColumns({"word": F.lit(1), "n": F.lit("x")}).repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    got = spelling.op13_spelling(spark, str(tmp_path))
    assert {x.word: (x.form, x.root, x.n, x.n_near, x.form_n) for x in got.collect()} == brute_variants({w: n for w, n in count.items() if n >= 2})


def test_one_edit_apart():
    for u, w, near in (("abcd", "abcd", False), ("abcd", "abxd", True), ("abcd", "bacd", False), ("abc", "abxc", True), ("abc", "xabc", True), ("abc", "abcx", True), ("abc", "axbx", False), ("", "a", True), ("a", "b", True)):
        assert spelling._near(u, w) is near


def test_pairs_are_told_once():
    rows = [("", "", kind, m, scan, w, 5, 0, len(w)) for w in ("aaaaaaa", "aaaaaaaa") for scan, lengths in ((0, [len(w)]), (1, [len(w), len(w) + 1])) for m in lengths for kind in (0, 1)]
    group = pa.Table.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["path", "kinds", "kind", "m", "scan", "word", "n", "lo", "hi"])
    assert {x["word"]: x["n_near"] for x in spelling._linked(group).to_pylist()} == {"aaaaaaa": 1, "aaaaaaaa": 1}
