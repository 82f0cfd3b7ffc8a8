"""Corpus operators against brute force on small tables with nulls, empty and long texts, ties, repeats and odd columns."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spindle.llm import bpe, decontaminate, fixity, graph, hamming, language, linear, minhash, quality, repeats, unigram, urls
from spindle.llm.common import _CLEANUP_CONF, SLICE_BYTES, mix, raw, written

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, n_words long"
RND = random.Random(4)
WORDS = ["".join(RND.choice("abcdeghij") for _ in range(RND.randint(1, 8))) for _ in range(300)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


def corpus():
    base = prose(300, 1)
    cut = base.split()
    texts = [
        base, base, None, "", "   \n\t", "one", "One", "É né à la", base.replace("a", "b", 3), prose(120, 2) + " " + base[200:420], prose(5, 3), base[100:149], base[100:150], "x" * 5000, "x" * 49, "xy " * 3000,
        " ".join(cut[:290] + ["zz"] * 10), " ".join(cut[:260]), "ÄÖÜ straße " * 40, "ÄÖÜ straße " * 41, prose(20000, 7), "it's 5 o'clock　<|endoftext|> é", "😀" * 200, "one",
    ]
    return [(i, t, "en", "s", len(t or ""), 0.5, 1) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = corpus()
    return spark.createDataFrame(rows + [rows[0], (None, "lost", None, None, None, None, None)], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def texts():
    return {r[0]: r[1] or "" for r in corpus()}


# -- repeated passages

def brute_repeats(texts, length=50):
    raw = {d: t.encode() for d, t in texts.items()}
    least = {}
    for d in sorted(raw):
        for i in range(len(raw[d]) - length + 1):
            least.setdefault(raw[d][i : i + length], d)
    out = {}
    for d, b in raw.items():
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if least[b[i : i + length]] < d:
                gone[i : i + length] = True
        edge = np.diff(np.concatenate(([0], gone.astype(int))))
        out[d] = (len(b), int(gone.sum()), int((edge == 1).sum()), hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest())
    return out


@pytest.mark.parametrize("hot", [96, 1])
def test_repeats_equal_brute_force(docs, none, hot, monkeypatch):
    monkeypatch.setattr(repeats, "HOT_BLOCKS", hot)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.removal(docs).collect()}
    assert got == brute_repeats(texts())
    assert repeats.removal(none).count() == 0


def local_spans(texts, parts=3):
    """The stages of repeated_spans without Spark (whose workers don't see changed module values)."""
    def grouped(rows, f):
        t = pa.Table.from_batches(rows) if isinstance(rows, list) else rows
        key = t.column(0).to_pylist()
        return pa.concat_tables([f(t.filter(pa.array([x == k for x in key]))) for k in sorted(set(key))])

    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(list(texts), pa.int64()), "text": pa.array([t.encode() for t in texts.values()])})
    asked = grouped(grouped(list(repeats._seeds([batch], parts)), lambda t: repeats._repeated(t, parts)), repeats._asked).to_pylist()
    rows = [(x["doc_id"], texts[x["doc_id"]].encode(), x["fp"], x["hot"]) for x in asked]
    batches = [pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows[k::2]], t) for i, t in enumerate((pa.int64(), pa.binary(), pa.binary(), pa.binary()))], names=["doc_id", "text", "fp", "hot"]) for k in range(2)]
    runs = [x for b in batches for x in repeats._runs([b], parts)]
    spans = grouped(grouped(runs, lambda t: repeats._factors(t, parts)), repeats._spans)
    return {r["doc_id"]: (r["starts"], r["ends"]) for r in spans.to_pylist()}


@pytest.mark.parametrize("hot", [96, 3, 2])
def test_repeats_hot_blocks_reach_every_document(hot, monkeypatch):
    monkeypatch.setattr(repeats, "HOT_BLOCKS", hot)
    monkeypatch.setattr(repeats, "BLOCK_BYTES", 4000)
    shared, other = prose(40, 90), prose(30, 91)
    texts = {i: prose(60, 100 + i) + (" " + shared[i % 5 :] if i % 6 < 4 else " " + other if i % 2 else "") + prose(60, 200 + i) for i in range(40)}
    want = brute_repeats(texts)
    spans = local_spans(texts)
    got = {}
    for d, t in texts.items():
        starts, ends = spans.get(d, ([], []))
        kept = repeats._kept_bytes(t.encode(), starts, ends)
        got[d] = (len(t.encode()), len(t.encode()) - len(kept), len(starts), hashlib.sha256(kept).hexdigest())
    assert got == want


def test_repeats_rows_hold_runs_of_whole_blocks():
    """What runs take on disk: a row for each part and kind of a block, not of each slice, and its bytes compressed."""
    shared, parts = [prose(3000, 300 + i) for i in range(20)], 60
    texts = {i: shared[i % 20] + " " + prose(3000, 400 + i) for i in range(60)}
    assert 2 * SLICE_BYTES < sum(len(t) for t in texts.values()) < repeats.BLOCK_BYTES
    text = pa.array([t.encode() for t in texts.values()])
    data, off = raw(text)
    doc, _, _, m = repeats.minimisers(data, off, repeats._prefix(data))
    fp = pa.array([np.unique(repeats._fingerprint(m[doc == i], parts)).tobytes() for i in range(60)], pa.binary())
    batch = pa.RecordBatch.from_arrays([pa.array(list(texts), pa.int64()), text, fp, pa.array([b""] * 60, pa.binary())], names=["doc_id", "text", "fp", "hot"])
    rows = [x for b in repeats._runs([batch], parts) for x in b.to_pylist()]
    assert len({(x["part"], x["kind"]) for x in rows}) == len(rows)
    whole = sum(int(np.frombuffer(x["size"], np.int32).sum()) for x in rows if x["kind"] != repeats.SURE)
    assert whole and sum(len(x["bytes"]) for x in rows) < 0.6 * whole
    assert {x["kind"] for x in rows} == {repeats.RUNS, repeats.SURE}


def test_repeats_texts_travel_compressed():
    rows = [(1, prose(400, 1)), (2, "é" * 60), (3, "x" * 49), (4, ""), (5, prose(200_000, 2)), (6, "\0" * 70)]
    batch = pa.RecordBatch.from_arrays([pa.array([d for d, _ in rows], pa.int64()), pa.array([t.encode() for _, t in rows])], names=["doc_id", "text"])
    (sent,) = repeats._squeezed_texts([batch])
    assert sum(len(x) for x in sent.column(1).to_pylist()) < 0.6 * sum(len(t.encode()) for _, t in rows)
    more = pa.RecordBatch.from_arrays([*sent.columns, pa.array([bytes([d]) for d, _ in rows])], names=["doc_id", "text", "size", "fp"])
    got = [x for b in repeats._whole_texts([more.slice(1), more.slice(0, 1)]) for x in b.to_pylist()]
    assert got == [{"doc_id": d, "text": t.encode(), "fp": bytes([d])} for d, t in [*rows[1:], rows[0]]]


def test_written_tables_leave_no_shuffle_files(spark):
    import time

    jvm = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffled():
        files = jvm.getAllFiles()
        return {n for i in range(files.size()) if (n := files.apply(i).getName()).startswith("shuffle_")}

    before, conf = shuffled(), spark.conf.get(_CLEANUP_CONF, None)
    rows = spark.range(1000).repartition(4, "id")
    got = written(rows.groupBy((F.col("id") % 10).alias("k")).applyInArrow(lambda t: t.slice(0, 1), "id long"), "test")
    until = time.time() + 20
    while (left := shuffled() - before) and time.time() < until:
        time.sleep(0.5)
    assert not left and got.count() == 10 and spark.conf.get(_CLEANUP_CONF, None) == conf
    assert rows.groupBy().count().first()[0] == 1000  # what is read again is worked out again


def test_repeats_keep_spans_alone(docs):
    from spindle.llm import common

    before = set(common._tables)
    out = repeats.removal(docs)
    assert [x.rpartition("/")[2].partition("-")[0] for x in common._tables - before] == ["spans"]
    assert out.count() == len(texts())


def test_repeats_cut_keeps_columns(docs):
    odd = docs.where("doc_id in (0, 1, 2, 12)").dropDuplicates().withColumns({c: F.lit(c) for c in ("starts", "ends", "_starts", "_ends", "_span_id", "bucket")})
    out = repeats.without_repeats(odd)
    assert out.columns == odd.columns
    got = {r.doc_id: r.text for r in out.collect()}
    assert got == {0: texts()[0], 1: "", 2: None, 12: ""} and {r.starts for r in out.collect()} == {"starts"}


def test_repeats_of_an_id_with_two_texts(spark, docs):
    base, other = prose(40, 70), "~ " + prose(60, 71)
    rows = [(1, base), (2, "a " + base), (2, other), (2, other), (3, other), (None, base)]
    out = {r.doc_id: r.text for r in repeats.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == {1: base, 2: other, 3: ""}  # the greatest text of document 2 is its text, and the row without an id is no document


def test_previous_factors_equal_their_definition():
    r, length = random.Random(12), 12
    for trial in range(30):
        parts = [bytes(r.choice(b"ab") for _ in range(r.randint(length, 40))) for _ in range(r.randint(1, 8))]
        doc = np.array([r.randint(1, 4) for _ in parts])
        body = np.frombuffer(b"".join(parts), np.uint8)
        size = np.array([len(p) for p in parts])
        begin = np.cumsum(size) - size
        order, pos, of = repeats.suffix_order(body, begin, size, length)
        got = np.zeros(len(pos), int)
        got[order] = repeats.previous_factors(body, pos[order], doc[of[order]], length)
        heads = [bytes(body[p : p + length]) for p in pos]
        assert [heads[i] for i in order] == sorted(heads)

        def shared(x, y):
            n = 0
            while n < length and x[n] == y[n]:
                n += 1
            return n

        want = [max([shared(heads[i], heads[j]) for j in range(len(pos)) if doc[of[j]] < doc[of[i]]], default=0) for i in range(len(pos))]
        assert got.tolist() == want


def test_runs_of_equal_hash_and_other_bytes_are_not_equal():
    body = np.frombuffer(b"aaaabbbbaaaacccc", np.uint8)
    new = np.array([True, False, False, False])
    assert repeats._heads(new, body, np.array([0, 4, 8, 12]), np.array([4, 4, 4, 4])).tolist() == [0, 1, 0, 3]


# -- near-duplicates

def brute_classes(texts, width=2):
    sets = {}
    for d, t in texts.items():
        w = re.findall(rb"[^\x20\x09-\x0d]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), t.encode()))
        sets[d] = {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} or ({tuple(w)} if w else set())
    up = {d: d for d in sets}

    def top(d):
        while up[d] != d:
            d = up[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = top(a), top(b)
                up[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), top(d)) for d in ids}


@pytest.mark.parametrize("part", [None, 2])
def test_near_duplicates_equal_brute_force(spark, docs, none, part, monkeypatch):
    if part:  # lists, blocks and stars in many parts
        for name in ("LIST", "BLOCK", "STAR"):
            monkeypatch.setattr(minhash, name, part)
    odd = docs.withColumns({c: F.lit("x") for c in ("a", "b", "rep", "text_", "_gone", "bin", "key", "sig", "id", "component_id", "n_shingles")})
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(odd, 2).collect()}
    assert got == brute_classes(texts())
    if not part:
        kept = minhash.first_of_each(odd, 2)
        assert kept.columns == odd.columns and sorted(r.doc_id for r in kept.collect()) == sorted(d for d, (_, c) in got.items() if d == c)
        assert minhash.near_duplicates(none, 2).count() == 0
        return
    r, t = random.Random(9), {}
    for g in range(6):  # groups of edited copies, some closer than the limit and some not
        cut = prose(120, 50 + g).split()
        for k in range(9):
            own = list(cut)
            for _ in range(r.randint(0, 3 + g)):
                own[r.randrange(len(own))] = f"e{g}{k}{r.random()}"
            t[len(t)] = " ".join(own)
    df = spark.createDataFrame([(d, x) for d, x in t.items()], "doc_id long, text string")
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in minhash.near_duplicates(df, 2).collect()} == brute_classes(t)


def test_signatures_find_pairs_at_the_limit():
    assert minhash.recall(0.8, 200_000) >= 0.99999 and minhash.recall(0.85, 50_000) == 1.0


def test_agreement_of_pairs_in_lists():
    r = np.random.default_rng(8)
    sig = r.integers(0, 65536, (70, minhash.MINIMA)).astype(np.uint16)
    for x, y, n in ((0, 1, 120), (1, 2, 119), (3, 4, 192), (60, 61, 150), (5, 69, 130)):
        sig[y] = sig[x].copy()
        sig[y, n:] ^= 1
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    for rows, c in ((np.arange(70), np.arange(70)), (np.arange(10), np.arange(10)), (np.arange(70), np.where(np.arange(70) < 2, 0, np.arange(70)))):
        t = pa.table({"key": np.ones(len(rows), np.int64), "i": np.zeros(len(rows), np.int32), "j": np.zeros(len(rows), np.int32), "part": np.zeros(len(rows), np.int32), "rep": rows, "c": c[: len(rows)], "sig": [x.tobytes() for x in sig[rows]]})
        got = {(x["a"], x["b"]) for x in minhash._forest(t, schema).to_pylist()}
        whole = (sig[rows][:, None] == sig[rows][None]).sum(axis=2) >= minhash.MATCHES
        want = {(int(a), int(b)) for a, b in zip(*np.nonzero(np.triu(whole, 1)), strict=True) if c[a] != c[b]}
        assert got == want  # no tree has three members here


def test_components(spark):
    pairs = [(i, i + 1) for i in range(1, 30)] + [(50, 40), (40, 60), (60, 50), (50, 40), (70, 70)] + [(i, 1000 - i) for i in range(100, 140)] + [(100, 900 - i) for i in range(40)] + [(2000 - 7 * i % 41, 2000 - 7 * (i + 1) % 41) for i in range(40)]
    got = {r.id: r.component for r in graph.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    up = {x: x for p in pairs for x in p}
    for _ in up:
        for a, b in pairs:
            up[a] = up[b] = min(up[a], up[b])
    assert got == {x: c for x, c in up.items() if x != 70} and graph.components(spark.createDataFrame([], "a string, b string")).count() == 0


# -- decontamination

def brute_hits(texts, items, width=13):
    find = lambda t: re.findall(rb"[0-9a-z\x80-\xff]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))
    out = {}
    for d, t in texts.items():
        w, hit, who = find(t), set(), set()
        for item, x in items:
            v = find(x)
            n = min(width, len(v))
            for i in range(len(v) - n + 1) if n else ():
                for j in range(len(w) - n + 1):
                    if w[j : j + n] == v[i : i + n]:
                        hit |= set(range(j, j + n))
                        who.add(str(item))
        out[d] = (len(w), len(hit), sorted(who))
    return out


@pytest.mark.parametrize("block_words, piece", [(100_000, 10_000), (40, 16)])
def test_decontamination_equals_brute_force(spark, docs, none, block_words, piece, monkeypatch):
    base = texts()[0].split()
    items = [(1, " ".join(base[10:40])), (10, "One, two!"), (2, None), (3, ""), (4, prose(30, 77)), (5, " ".join(base[100:113])), (5, "ONE"), (6, " ".join(base[200:212])), (7, "x" * 5000)]
    bench = spark.createDataFrame(items + [(None, "one")], "item_id long, text string")
    small = docs.where("doc_id <> 20")
    odd = small.withColumns({c: F.lit(c) for c in ("starts", "ends", "words", "first", "sid", "seed", "block", "items", "_id", "_gone", "_cuts", "_span_id")})
    got = {r.doc_id: (r.n_words, sum(r.ends) - sum(r.starts), list(r["items"])) for r in decontaminate.contaminated_spans(odd, bench, block_words=block_words).collect()}
    assert got == brute_hits({d: t for d, t in texts().items() if d != 20}, items)
    if piece == 16:
        return
    left = {r.doc_id for r in decontaminate.decontaminated(docs, bench).collect()}
    assert {0, 5, 6, 23}.isdisjoint(left) and {2, 3, 4, 10, 20} <= left and None not in left
    assert decontaminate.contaminated_spans(none, bench).count() == 0 and decontaminate.contaminated_spans(small, bench.limit(0)).where("size(items) > 0").count() == 0
    want = {0: base[:10] + base[40:100] + base[113:200] + base[212:], 5: [], 7: "É né à la".split(), 10: texts()[10].split()}
    for frame in (odd, small):
        cut = decontaminate.without_spans(frame, bench)
        assert cut.columns == frame.columns and {r.doc_id: (r.text or "").split() for r in cut.where("doc_id in (0, 5, 7, 10)").collect()} == want
    words = {k: {r.doc_id: len((r.text or "").split()) for r in decontaminate.without_spans(small, bench, max_words=a, max_share=b).where("doc_id in (0, 5)").collect()} for k, (a, b) in {"long": (13, 1.0), "much": (999, 0.2), "never": (999, 1.0)}.items()}
    assert words == {"long": {0: 270, 5: 1}, "much": {0: 300, 5: 0}, "never": {0: 300, 5: 1}}


def test_pieces_of_items_keep_every_window(monkeypatch):
    monkeypatch.setattr(decontaminate, "PIECE", 16)
    text = prose(200, 31)
    batch = pa.RecordBatch.from_pydict({"item": ["a", "b", "c", "d"], "text": pa.array([text.encode(), b"one two", b"", prose(16, 32).encode()])})
    got = pa.Table.from_batches(list(decontaminate._pieces([batch], 13))).to_pylist()
    count = lambda name, n: [len(np.frombuffer(x["words"], np.uint64)) for x in got if x["item"] == name and x["n"] == n]
    assert count("b", 2) == [2] and count("d", 16) == [16] and all(13 <= n <= 16 for n in count("a", 200))
    seen = {tuple(np.frombuffer(x["words"], np.uint64)[i : i + 13]) for x in got if x["item"] == "a" for i in range(len(x["words"]) // 8 - 12)}
    _, _, _, h = decontaminate.words(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)]), decontaminate.MEMBER)
    assert seen == {tuple(h[i : i + 13]) for i in range(188)}


# -- tokens

@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_bpe_equals_tokenizers(docs, none, name):
    from tokenizers import Tokenizer

    path = bpe.tokenizer_path(name)
    tok = Tokenizer.from_file(path)
    got = {r.doc_id: r for r in bpe.encoded(docs.where("doc_id is not null"), path).collect()}
    for d, t in texts().items():
        ids = tok.encode(t, add_special_tokens=False).ids
        assert got[d].ids == " ".join(map(str, ids)) and got[d].n_tokens == len(ids) and got[d].decoded == tok.decode(ids, skip_special_tokens=False), d
    assert bpe.digests(none, path).count() == 0


def test_joins_inside_words_are_repaired(monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(bpe, "STRETCH", 0)
    monkeypatch.setattr(bpe, "MEAN", 40)
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        path = bpe.tokenizer_path(name)
        tok, enc = Tokenizer.from_file(path), bpe.Encoder(path)
        for t in (prose(400, 5), "x" * 3000, "né à " * 500):
            b = t.encode()
            chunks = bpe.chunks_of(np.frombuffer(b, np.uint8), np.array([0, len(b)]))[0]
            assert b"".join(chunks) == b and enc.encode(chunks) == " ".join(map(str, tok.encode(t, add_special_tokens=False).ids))


def test_cased_tokenizers_and_long_blobs(tmp_path, monkeypatch):
    import json
    import time

    from tokenizers import Tokenizer

    with open(bpe.tokenizer_path("word_bpe_49k.json"), encoding="utf-8") as f:
        spec = json.load(f)
    spec["normalizer"]["normalizers"] = spec["normalizer"]["normalizers"][:2]
    path = str(tmp_path / "cased.json")
    with open(path, "w", encoding="utf-8") as f:
        json.dump(spec, f)
    tok, enc = Tokenizer.from_file(path), bpe.Encoder(path)
    for t in ("Hello World", "HELLO, World! hello", "ÄÖ Straße. É"):
        assert enc.encode([t.encode()]) == " ".join(map(str, tok.encode(t, add_special_tokens=False).ids))
    r = random.Random(3)
    blob = "".join(r.choice("abcdefgh") for _ in range(300_000))
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        path = bpe.tokenizer_path(name)
        tok, took = Tokenizer.from_file(path), []
        want = " ".join(map(str, tok.encode(blob, add_special_tokens=False).ids))
        for size in (len(blob), 100_000):
            enc, start = bpe.Encoder(path), time.perf_counter()
            b = blob[:size].encode()
            got = enc.encode(bpe.chunks_of(np.frombuffer(b, np.uint8), np.array([0, size]))[0])
            took.append(time.perf_counter() - start)
            assert size < len(blob) or got == want
        assert took[0] < 30 * max(took[1], 0.05)  # in proportion, with room


def test_unigram_counts_equal_tokenizers(docs, none):
    import unicodedata

    from tokenizers import Tokenizer, models, pre_tokenizers

    path = bpe.tokenizer_path("piece_bpe_32k.model")
    v = unigram.vocabulary(path)
    tok = Tokenizer(models.Unigram([("<unk>", min(s for _, s in v))] + v, unk_id=0, byte_fallback=False))
    tok.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    got = {r.doc_id: r.n_tokens for r in unigram.token_counts(docs.where("doc_id is not null"), path).collect()}
    for d, t in texts().items():
        assert got[d] == len(tok.encode(" ".join(unicodedata.normalize("NFKC", t).split())).ids), d
    toy = unigram.Counter([("▁", -1.0), ("a", -1.0), ("aa", -2.0), ("▁a", -2.0)])
    assert toy.word("▁aa") == (2, -3.0) and toy.word("▁xx") == (2, -1.0 - 12.0 * 2)
    assert unigram.token_counts(none, path).count() == 0


# -- classifiers

def test_classifiers_on_held_out_rows(spark):
    rows, marks = [], []
    for i in range(400):
        good = i % 4 != 0
        lang = ("en", "de", "fr", "es")[i % 4 - 1]
        own = {"en": "the of that wh", "de": "der und ich ß", "fr": "le être ç eau", "es": "la ción ñ que"}[lang].split()
        r = random.Random(i)
        w = [r.choice(WORDS) + r.choice(own) for _ in range(40)]
        rows.append((i, " ".join(w) if good else " ".join(x.upper() + "!!" for x in w), lang))
        marks.append((i, int(good), 0))
    rows += [(1000, None, "en"), (1001, "", "en"), (1002, "123 !", None), (1003, "a", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame(marks + [(1, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    out = {i: zlib.crc32(str(i).encode()) % 5 == 0 for i in range(400)}
    s = {r.doc_id: r.score for r in quality.scores(docs, quality.train(docs, labels)).collect()}
    assert all((s[i] >= 0.3) == (i % 4 != 0) for i in range(400) if out[i]) and all(0 <= x <= 1 for x in s.values()) and len(s) == 404
    assert {r.doc_id for r in quality.kept(docs, labels).collect()} >= {i for i in range(400) if i % 4}
    p = {r.doc_id: (r.lang_pred, r.score) for r in language.predict(docs, language.train(docs)).collect()}
    assert np.mean([p[i][0] == rows[i][2] for i in range(400) if out[i] and i % 4]) > 0.95
    assert p[1000] == p[1001] == p[1002] == ("und", 0.0) and p[1003][0] != "und"
    assert language.train(docs.limit(0)) is None and {r.lang_pred for r in language.predict(docs, None).collect()} == {"und"}
    one = quality.scores(docs, quality.train(docs, labels.where("quality = 1"))).first().score
    assert 0.9 < one < 1 and quality.scores(docs, quality.train(docs, labels.limit(0))).first().score == 0.5


def test_quality_equals_a_refit(spark):
    """Counts, ratios, hinge machine and sigmoid worked out anew, document by document."""
    r = random.Random(2)
    rows = [(i, " ".join(r.choice(WORDS).upper() if i % 3 == 0 and r.random() < 0.6 else r.choice(WORDS) for _ in range(30))) for i in range(150)] + [(500, None), (501, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(120)], "doc_id long, quality int")
    found = {d: set(quality.features(np.frombuffer((t or "").encode(), np.uint8), np.array([0, len((t or "").encode())]))[1].tolist()) for d, t in rows}
    order = [x.doc_id for x in docs.orderBy(F.xxhash64(F.lit(41), F.col("doc_id"))).collect()]
    known = [d for d in order if d < 120 and zlib.crc32(str(d).encode()) % 5]
    y = np.array([1.0 if d % 3 else -1.0 for d in known])
    pos, neg = np.ones(quality.DIMS), np.ones(quality.DIMS)
    for d, k in zip(known, y, strict=True):
        for f in found[d]:
            (pos if k > 0 else neg)[f] += 1
    ratio = np.log(pos / ((y > 0).sum() + 2)) - np.log(neg / ((y < 0).sum() + 2))
    as_row = lambda d: (np.array(sorted(found[d])), ratio[sorted(found[d])] / np.sqrt(len(found[d])))
    side = np.arange(len(y)) % 4 == 0
    part = linear.fit_hinge([as_row(d) for d, t in zip(known, side, strict=True) if not t], y[~side], quality.DIMS)
    margin = lambda w, d: sum(w[f] * ratio[f] for f in found[d]) / np.sqrt(max(1, len(found[d]))) + w[-1]
    a, b = linear.fit_sigmoid(np.array([margin(part, d) for d, t in zip(known, side, strict=True) if t]), y[side])
    w = linear.fit_hinge([as_row(d) for d in known], y, quality.DIMS)
    got = {x.doc_id: x.score for x in quality.scores(docs, quality.train(docs, labels)).collect()}
    assert len(got) == len(rows) and all(got[d] == pytest.approx(linear.sigmoid(a * margin(w, d) + b), abs=1e-9) for d in got)


def test_hinge_machine_finds_the_optimum():
    r = np.random.default_rng(4)
    x, c = r.normal(size=(60, 6)), 1.0
    y = np.where(x[:, 0] + 0.7 * r.normal(size=60) > 0.2, 1.0, -1.0)
    w = linear.fit_hinge([(np.arange(6), v) for v in x], y, 6, c=c, epochs=3000)
    z = np.hstack([x, np.ones((60, 1))]) * y[:, None]
    q, alpha = z @ z.T, np.zeros(60)
    for _ in range(60_000):  # projected gradient on the dual problem
        alpha = np.clip(alpha + (1 - q @ alpha) / np.linalg.norm(q, 2), 0, c)
    value = lambda v: 0.5 * v @ v + c * np.maximum(0, 1 - z @ v).sum()
    assert value(w) == pytest.approx(alpha.sum() - 0.5 * alpha @ q @ alpha, rel=1e-2)


def test_votes_of_languages_equal_their_definition():
    r = np.random.default_rng(9)
    names = ["a", "b", "c", "d"]
    m = {"names": names, "pairs": {(p, q): {"w": r.normal(size=5), "bias": 0.1, "a": 2.0, "b": -0.1} for i, p in enumerate(names) for q in names[i + 1 :]}}
    x = r.normal(size=(200, 5))
    best, score = language._vote(x, m)
    for i, v in enumerate(x):
        prob = {}
        for (p, q), k in m["pairs"].items():
            prob[p, q] = 1 / (1 + np.exp(-(2.0 * (v @ k["w"] + 0.1) - 0.1)))
            prob[q, p] = 1 - prob[p, q]
        rank = {n: (sum(prob[n, o] >= 0.5 for o in names if o != n), sum(prob[n, o] for o in names if o != n)) for n in names}
        assert names[best[i]] == max(names, key=rank.get) and score[i] == pytest.approx(min(prob[names[best[i]], o] for o in names if o != names[best[i]]))


def plain_trigrams(text):
    """Damped counts of the byte trigrams of a text in unit length, worked out byte by byte and kept in half precision."""
    kind = lambda b: b - 64 if 65 <= b <= 90 else b - 96 if 97 <= b <= 122 else 32 + (b - 128) % 96 if b >= 128 else 0
    c, v = [kind(b) for b in text.encode()], np.zeros(language.DIMS)
    for x, y, z in zip(c, c[1:], c[2:], strict=False):
        code = x << 14 | y << 7 | z
        if code:
            v[int(mix(np.array([code + 5], np.uint64))[0] >> np.uint64(33)) % language.DIMS] += 1
    v = np.log1p(v)
    return v / max(np.sqrt(v @ v), 1e-9)


def plain_machines(x, names):
    """(p, q): function of a vector giving p's probability against q, each fitted on the rows of both alone."""
    out = {}
    for p in sorted(set(names)):
        for q in sorted(n for n in set(names) if n > p):
            at = [i for i, n in enumerate(names) if n in (p, q)]
            y = np.array([1.0 if names[i] == p else -1.0 for i in at])
            sparse = [(np.flatnonzero(x[i]), x[i][x[i] != 0]) for i in at]
            test = np.arange(len(at)) % 4 == 0
            part = linear.fit_hinge([r for r, t in zip(sparse, test, strict=True) if not t], y[~test], language.DIMS, c=4.0)
            a, b = linear.fit_sigmoid(np.array([x[i] @ part[:-1] + part[-1] for i, t in zip(at, test, strict=True) if t]), y[test])
            w = linear.fit_hinge(sparse, y, language.DIMS, c=4.0)
            out[p, q] = lambda v, w=w, a=a, b=b: float(linear.sigmoid(a * (v @ w[:-1] + w[-1]) + b))
    return out


def plain_vote(v, names, machines):
    prob = {}
    for (p, q), f in machines.items():
        prob[p, q] = f(v)
        prob[q, p] = 1 - prob[p, q]
    rank = {n: (sum(prob[n, o] >= 0.5 for o in names if o != n), sum(prob[n, o] for o in names if o != n)) for n in names}
    best = max(names, key=rank.get)
    return best, min((prob[best, o] for o in names if o != best), default=1.0)


def test_languages_equal_a_refit(spark):
    """Trigrams, sample, family step, machines and votes worked out anew, document by document."""
    r = random.Random(6)
    own = {"en": "the of that wh", "de": "der und ich ß", "fr": "le être ç eau", "es": "la ción ñ que", "zz": "qoph xx zyzzy ŋa"}
    rows = [(i, " ".join(r.choice(WORDS) if r.random() < 0.6 else r.choice(own[k].split()) for _ in range(r.randint(5, 30))), k) for i in range(200) for k in [list(own)[i % 5]]]
    rows += [(500, None, "en"), (501, "", "en"), (502, "12 !", None), (503, "É", None), (504, "the eau", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    text = {d: t or "" for d, t, _ in rows}
    known = [(x.doc_id, x.lang) for x in docs.where("lang is not null and text is not null").orderBy(F.xxhash64("doc_id")).collect() if zlib.crc32(str(x.doc_id).encode()) % 5]
    family = {k: f for f, ks in language.FAMILIES.items() for k in ks}
    x = np.array([plain_trigrams(text[d]).astype(np.float32) for d, _ in known]).astype(np.float16).astype(np.float32)
    lang = [k for _, k in known]
    of = [family.get(k, k) for k in lang]
    top = plain_machines(x, of)
    below = {f: plain_machines(x[[g == f for g in of]], [k for k, g in zip(lang, of, strict=True) if g == f]) for f in set(of)}
    got = {p.doc_id: (p.lang_pred, p.score) for p in language.predict(docs, language.train(docs)).collect()}
    assert len(got) == len(rows)
    for d, t in text.items():
        if not any(c.isalpha() for c in t):
            assert got[d] == ("und", 0.0)
            continue
        v = plain_trigrams(t).astype(np.float32)
        f, p = plain_vote(v, sorted(set(of)), top)
        best, q = plain_vote(v, sorted({k for k, g in zip(lang, of, strict=True) if g == f}), below[f])
        assert got[d][0] == best and got[d][1] == pytest.approx(p * q, abs=1e-4), d


# -- search, filters, fixity

def test_top_k_equals_brute_force(spark):
    r = np.random.default_rng(3)
    v = r.normal(size=(3000, 64)).astype(np.float32)
    v[5:400] = v[5]
    df = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(v)] + [(9000, None), (9001, []), (9002, [float("nan")] * 64)], "vec_id long, embedding array<float>")
    codes = hamming.sign_codes(df)
    got = {}
    for x in hamming.top_k(codes, codes.where("id % 100 = 0"), 10).orderBy("query_id", "rank").collect():
        got.setdefault(x.query_id, []).append((x.distance, x.id))
    bits = np.vstack([v > 0, np.zeros((1, 64), bool)])
    ids = [*range(3000), 9002]
    for q in [i for i in ids if i % 100 == 0]:
        d = (bits != bits[ids.index(q)]).sum(axis=1)
        assert got[q] == sorted((int(x), i) for x, i in zip(d, ids, strict=True) if i != q)[:10]


def test_extra_records_have_the_replicas_offsets(spark):
    rows = [(0, i, bytes([65 + i]) * (10 + i)) for i in range(5)]
    ddl = "archive long, idx long, record binary"
    primary = spark.createDataFrame([r for r in rows if r[1] != 3], ddl)
    replica = spark.createDataFrame([r for r in rows if r[1] != 1], ddl)
    got = sorted(tuple(r) for r in fixity.findings(primary, replica).collect())
    assert got == [(0, 1, "missing", 10, 21), (0, 3, "extra", 22, 35)]


def test_top_k_of_an_id_in_many_rows():
    # id 100 holds 12 rows of the code that 50 greater ids share, and 12 codes one bit away
    near = np.uint64(1) << np.arange(12, dtype=np.uint64)
    ids = np.concatenate((np.full(24, 100), np.arange(200, 250), [300, 301]))
    codes = np.concatenate((np.zeros(12, np.uint64), near, np.zeros(50, np.uint64), near[:1], np.array([7 << 20], np.uint64)))
    for keep in (np.ones(len(ids), bool), ids != 300, (ids < 200) | (ids > 299)):
        x, c = ids[keep], codes[keep]
        for own, code in ((100, np.uint64(0)), (300, near[0]), (999, np.uint64(3))):
            d = np.bitwise_count(c ^ code)
            want = sorted((int(n), int(i)) for n, i in zip(d, x, strict=True) if i != own)[:10]
            got, dist = hamming.MultiIndex(x, c, 10).search(own, code)
            assert list(zip(dist.tolist(), got.tolist(), strict=True)) == want


def test_url_filter(spark):
    ev = [("l", "bad.com", "2024-01-10", "add"), ("l", "bad.com", "2024-01-20", "remove"), ("l", "bad.com", "2024-01-20", "add"), ("m", "x.bad.com", "2024-01-15", "add"), ("l", None, "2024-01-01", "add"), ("l", "q.org", "2024-01-01", "oops")]
    cap = [(1, "http://a.bad.com/p", "2024-01-09"), (2, "http://A.BAD.com./p", "2024-01-10"), (3, "https://u@x.bad.com:8/", "2024-01-19"), (4, "http://bad.com", "2024-01-20"), (5, "http://notbad.com", "2024-01-12"), (6, None, "2024-01-12"), (7, "nonsense", "2024-01-12"), (8, "http://bad.com", None), (3, "https://u@x.bad.com:8/", "2024-01-19"), (9, "http://q.org", "2024-01-12")]
    e = spark.createDataFrame(ev, "list string, pattern string, at string, action string").withColumn("at", F.col("at").cast("date"))
    c = spark.createDataFrame(cap, "page_id long, url string, fetched string").withColumn("fetched", F.col("fetched").cast("date"))
    got = urls.active_entries(c, e).collect()
    assert sorted((r.page_id, r.n_active, ",".join(r.lists)) for r in got) == [(1, 0, ""), (2, 1, "l"), (3, 2, "l,m"), (3, 2, "l,m"), (4, 0, ""), (5, 0, ""), (6, 0, ""), (7, 0, ""), (8, 0, ""), (9, 0, "")]
    assert urls.active_entries(c.limit(0), e).count() == 0 and urls.active_entries(c, e.limit(0)).where("blocked").count() == 0


def test_fixity(spark):
    rows = [(a, i, f"r{a}-{i}".encode()) for a in (1, 2, 3) for i in range(300)]
    df = spark.createDataFrame(rows + [(None, 1, b"x"), (4, 0, None)], "archive long, idx long, record binary")
    assert fixity.audit(df, df.repartition(5)).count() == 0
    other = df.where("not (archive = 2 and idx = 17)").withColumn("record", F.when((F.col("archive") == 3) & (F.col("idx") == 299), F.lit(b"z")).otherwise(F.col("record")))
    other = other.union(spark.createDataFrame([(5, 1000, b"new")], df.schema))
    assert sorted((r.archive, r.idx, r.status) for r in fixity.audit(df, other).collect()) == [(2, 17, "missing"), (3, 299, "changed"), (5, 1000, "extra")]


def test_fixity_ranges_and_odd_tables(spark):
    r = random.Random(6)
    rows = [(a, i, bytes(r.randrange(256) for _ in range(r.randint(0, 30)))) for a in (1, 2) for i in range(90) if i % 7] + [(1, 5, b"again"), (1, 5, b"again"), (2, 80, b"z" * 300_000)]
    mine, theirs = [x for x in rows if x[:2] != (2, 11)], [(a, i, b + b"!") if (a, i) in ((1, 8), (2, 80), (2, 15)) else (a, i, b) for a, i, b in rows if (a, i) != (1, 29)]
    ddl = "archive long, idx long, record binary, hash string, size long, node int, begins int, other string"
    frame = lambda x: spark.createDataFrame([(*t, "h", 1, 2, 3, "o") for t in x], ddl)

    def places(x):
        out, at = {}, {}
        for a, i, b in sorted(x):
            old = out.get((a, i))
            out[a, i] = (old[0] if old else at.get(a, 0), at.get(a, 0) + len(b))
            at[a] = at.get(a, 0) + len(b)
        return out

    p, q = places(mine), places(theirs)
    want = {(1, 8, "changed", *p[1, 8]), (2, 80, "changed", *p[2, 80]), (2, 15, "changed", *p[2, 15]), (1, 29, "missing", *p[1, 29]), (2, 11, "extra", *q[2, 11])}
    assert {tuple(x) for x in fixity.findings(frame(mine), frame(theirs), fanout=4).collect()} == want
    assert fixity.findings(frame([]), frame([])).count() == 0 and fixity.findings(frame(mine), frame([])).where("status <> 'missing'").count() == 0
    levels = fixity.tree(frame(mine), 4, 4)
    assert [x.where("archive = 2").agg(F.sum("size")).first()[0] for x in levels] == [sum(len(b) for a, _, b in mine if a == 2)] * 5
    moved = fixity.tree(frame([(a, i, b[1:] if (a, i) == (2, 12) else b) for a, i, b in mine]), 1, 4)[1].where("archive = 2")
    old = {x.node: x.hash for x in levels[1].where("archive = 2").collect()}
    assert [x.node for x in moved.collect() if x.hash != old[x.node]] == [3]  # ranges are relative: later nodes keep their hashes


def test_pipeline_keeps_no_tables_of_former_stages(spark):
    import corpus_pipeline as p
    from spindle.llm import common

    sf = "/root/testdata/sf0.001"
    names = lambda before: sorted(x.rpartition("/")[2].partition("-")[0] for x in common._tables - before)
    docs, before = spark.read.parquet(f"{sf}/documents.parquet"), set(common._tables)
    p.near_dedup(spark, docs, sf)
    assert names(before) == ["gone"]  # what is gone has been worked out, its links and signatures aren't read again
    before = set(common._tables)
    out = p.run(spark, sf)
    assert names(before) == ["stage3"]
    assert out.count() > 0


def test_pipeline_stages(spark):
    from tokenizers import Tokenizer

    import corpus_pipeline as p

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    cols, rows = docs.columns, [[(r.doc_id, r.text or "") for r in docs.collect()]]
    for _, stage in p.STAGES[:4]:
        docs = stage(spark, docs, sf).cache()
        assert docs.columns == cols
        rows.append([(r.doc_id, r.text or "") for r in docs.collect()])
    near = brute_classes(dict(rows[1]), 5)
    assert {d for d, _ in rows[2]} == {d for d, (_, c) in near.items() if d == c}
    cut = brute_repeats(dict(rows[2]))
    assert all(cut[d][3] == hashlib.sha256(t.encode()).hexdigest() or "�" in t for d, t in rows[3]) and {d for d, _ in rows[3]} == {d for d, _ in rows[2]}
    hit = brute_hits(dict(rows[3]), bench)
    assert {d for d, _ in rows[4]} == {d for d, (w, n, _) in hit.items() if not (n and 20 * n >= w)}
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    score = {r.doc_id: r.score for r in quality.scores(spark.read.parquet(f"{sf}/documents.parquet"), quality.train(spark.read.parquet(f"{sf}/documents.parquet"), labels)).collect()}  # test_quality_equals_a_refit holds these scores
    assert rows[1] and sorted(rows[1]) == sorted((d, t) for d, t in rows[0] if score[d] >= 0.3)
    tok = Tokenizer.from_file(bpe.tokenizer_path())
    tok.no_truncation()
    tok.no_padding()
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = set()
    for d, t in rows[4]:
        ids = tok.encode(t, add_special_tokens=False).ids
        want.add((d, len(ids), sha(" ".join(map(str, ids))), sha(tok.decode(ids, skip_special_tokens=False))))
    for last in (p.STAGES[4][1](spark, docs, sf), p.run(spark, sf)):
        got = last.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
        assert len(got) == len(want) and {tuple(r) for r in got} == want
