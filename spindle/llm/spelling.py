"""Spelling variants: words one edit apart, found by Aho-Corasick automata over halves of words.

Of two words that differ by one inserted, deleted or replaced code point, one half of the longer word (of either, if they
are equally long) stands unchanged at the same end of the other. So every word is *indexed* under its two halves, and *scanned* for those halves of
words as long as it and of words one code point longer. Indexed and scanned rows meet in shards, by hash of length and segment; a shard
builds an automaton of its segments, runs all its scanned words through it, keeps matches whose offset and length fit, and
verifies that the distance is one. A pair counts at its first half if that matches, so no pair is found twice.

A segment that many words share (a frequent prefix of short words, say) would bring all pairs of them. Where a segment
has over `CROWD` rows, the rest of its words is halved again, by the same rule, and dealt under both segments; so on until no
segment is crowded, or no more than two code points are left. What remains in a task is then bounded by the alphabet, not by the
number of words, and nothing is left out.

Counting words is one pass: a task adds up what its documents hold and Spark sums the rest. Each word's near words are counted and its
best one is kept in the tasks; roots follow by jumping along forms, of which each is ten times as frequent as the one before.

Defined results: null texts have no words; an empty table gives no rows. Rows that repeat a doc_id are one document, as everywhere here.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindle.llm.common import documents, lean, lean_group, small, table, written
from spindle.llm.periodic import CRC32, crc_of

#: Least code points and occurrences of a word, and how many times as frequent its form must be.
LEAST, OCCURRENCES, TIMES = 7, 2, 10
#: Rows of a segment from which on its words are halved again.
CROWD = 200
#: Rows of a shard, on average.
SHARD = 120_000
#: Different words that a task adds up before it passes them on.
COUNTED = 150_000
#: Bound of the crowded segments that are broadcast; more are joined by shuffle.
BROADCAST_SEGMENTS = 100_000
#: One in so many runs of a document loses a code point, by the query's rule.
ONE_IN = 31


def _as_is(doc_id, run: str) -> str:
    return run


def with_slips(doc_id, run: str) -> str:
    """The query's own change: by a checksum, some runs lose a code point."""
    h = zlib.crc32(f"{doc_id}:{run}".encode())
    if h % ONE_IN:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def counted_words(docs: DataFrame, change=_as_is, least: int = LEAST, occurrences: int = OCCURRENCES) -> DataFrame:
    """word, n: lower-cased (A-Z alone) runs of letters up to U+00FF, of at least so many code points and occurrences over all documents."""

    def run(batches):
        find = re.compile(r"[a-zÀ-ÿ]{%d,}" % least).findall
        total: Counter = Counter()

        def rows():
            out = pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], names=["word", "n"])
            total.clear()
            return out

        for batch in batches:
            for i in range(len(batch)):
                text = batch.column(1)[i].as_py()
                if text:
                    doc_id = batch.column(0)[i].as_py()
                    for own, k in Counter(find(text.lower().decode("utf-8", "replace"))).items():  # bytes: A-Z alone
                        word = change(doc_id, own)
                        if len(word) >= least:
                            total[word] += k
                if len(total) > COUNTED:
                    yield rows()
        yield rows()

    words = documents(docs, "text").select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(lean(run), "word string, n long")
    return words.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= occurrences)


#: Rows of words: path (the segments before, by which they came here), kinds (theirs, as digits), kind (0: first half, 1: second half), m (length of the indexed rest), scan, word, n, and the bounds lo and hi of the rest.
_ROW = "path, kinds, kind, m, scan, word, n, lo, hi, at"


def _halved(words: DataFrame) -> DataFrame:
    """All rows of rests: columns path, kinds, word, n, lo, hi, role (null: indexed and scanned for lengths of its own; else its scan) and long (the indexed rest's length)."""
    size = F.col("hi") - F.col("lo")
    roles = F.when(F.col("role").isNull(), F.array(
        F.struct(F.lit(0).alias("scan"), size.alias("m")), F.struct(F.lit(1).alias("scan"), size.alias("m")), F.struct(F.lit(1).alias("scan"), (size + 1).alias("m"))
    )).otherwise(F.array(F.struct(F.col("role").alias("scan"), F.col("long").alias("m"))))
    rows = words.select("path", "kinds", "word", "n", "lo", "hi", F.explode(roles).alias("r")).select("path", "kinds", "word", "n", "lo", "hi", "r.scan", "r.m")
    rows = rows.withColumn("kind", F.explode(F.array(F.lit(0), F.lit(1))))
    rows = rows.withColumn("half", F.expr("case when kind = 0 then m div 2 else m - m div 2 end").cast("int"))
    segment = F.expr("case when kind = 0 then substring(word, lo + 1, half) else substring(word, hi - half + 1, half) end")
    return rows.where(F.col("half") <= size).withColumn("at", F.concat_ws("|", "path", F.concat("kind", F.lit(":"), "m", F.lit(":"), segment))).select(*_ROW.split(", "))


def _near(u: str, w: str) -> bool:
    """Whether w, of the same length or one more, is one edit from u."""
    k = 0
    for a, b in zip(u, w):  # noqa: B905
        if a != b:
            break
        k += 1
    if len(u) == len(w):
        return k < len(u) and u[k + 1 :] == w[k + 1 :]
    return u[k:] == w[k + 1 :]


def _first_way(u: str, w: str, kinds: str) -> bool:
    """Whether the pair came by first halves wherever these match: other ways tell it again."""
    for kind in kinds:
        m = len(w)
        half = m // 2
        if kind == "0":
            u, w = u[half:], w[half:]
        elif u[:half] == w[:half]:
            return False
        else:
            u, w = u[: len(u) - m + half], w[:half]
    return True


_LINK = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("best_n", pa.int64()), ("best", pa.string())])


def _linked(group: pa.Table) -> pa.Table:
    """word, n_near, best_n, best: what the shard's automaton finds near each of its words."""
    import ahocorasick

    machine, names = ahocorasick.Automaton(), {}
    scans = {}
    for path, kinds, kind, m, scan, word, n, lo, hi in zip(*[group.column(c).to_pylist() for c in ("path", "kinds", "kind", "m", "scan", "word", "n", "lo", "hi")], strict=True):
        rest = word[lo:hi]
        if scan:
            scans[path, kinds, word, lo, hi] = n
        else:
            segment = rest[: m // 2] if kind == 0 else rest[m // 2 :]
            held = names.get(segment)
            if held is None:
                held = names[segment] = {}
                machine.add_word(segment, (len(segment), held))
            held.setdefault((path, kind, m), []).append((word, n, rest))
    found: dict[str, list] = {}

    def link(word: str, near: str, n: int) -> None:
        own = found.get(word)
        if own is None:
            found[word] = [1, n, near]
            return
        own[0] += 1
        if n > own[1] or n == own[1] and near < own[2]:
            own[1], own[2] = n, near

    if names:
        machine.make_automaton()
        for (path, kinds, word, lo, hi), n in scans.items():
            rest = word[lo:hi]
            size = len(rest)
            for end, (k, held) in machine.iter(rest):
                for kind in (0, 1):
                    if end + 1 != (k if kind == 0 else size):  # a first half stands at the start, a second half at the end
                        continue
                    for m in (size, size + 1):
                        half = m // 2
                        if k != (half if kind == 0 else m - half):
                            continue
                        for other, its, its_rest in held.get((path, kind, m), ()):
                            if m == size and rest >= its_rest or kind == 1 and rest[:half] == its_rest[:half]:
                                continue  # the other direction, or the first half, tells this pair
                            if _near(rest, its_rest) and _first_way(word, other, kinds):
                                link(word, other, its)
                                link(other, word, n)
    cols = list(zip(*[(w, *x) for w, x in found.items()], strict=True)) or [()] * 4
    return pa.Table.from_arrays([pa.array(c, t.type) for c, t in zip(cols, _LINK, strict=True)], schema=_LINK)


def near_words(words: DataFrame) -> DataFrame:
    """word, n_near, best_n, best: how many words are one edit from it, and the most frequent (of equal ones the least) of them. words: word (distinct, of at least 3 code points), n."""
    spark = words.sparkSession
    none = F.lit(None).cast("int")
    rows = _halved(words.select(F.lit("").alias("path"), F.lit("").alias("kinds"), "word", "n", F.lit(0).alias("lo"), F.char_length("word").alias("hi"), none.alias("role"), none.alias("long")))
    links = None
    while rows is not None:
        rows = written(rows, "halves")
        count = rows.count()
        rest = F.expr("case when kind = 0 then m - m div 2 else m div 2 end")
        crowded = rows.where(rest > 2).groupBy("at").agg(F.count("*").alias("k")).where(F.col("k") > CROWD).select(F.col("at").alias("crowd"))
        crowded = small(written(crowded, "crowded"), BROADCAST_SEGMENTS)
        shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-count // SHARD))
        dealt = rows.join(crowded, rows["at"] == crowded["crowd"], "left_anti").withColumn("shard", F.pmod(F.xxhash64("at"), F.lit(shards)).cast("int")).drop("at")
        here = dealt.groupBy("shard").applyInArrow(lean_group(_linked), "word string, n_near long, best_n long, best string")
        links = here if links is None else links.unionByName(here)
        if crowded.limit(1).count():
            more = rows.join(crowded, rows["at"] == crowded["crowd"], "left_semi")
            half = F.expr("case when kind = 0 then m div 2 else m - m div 2 end").cast("int")
            rows = _halved(more.select(F.col("at").alias("path"), F.concat("kinds", F.col("kind").cast("string")).alias("kinds"), "word", "n", F.expr("case when kind = 0 then lo + m div 2 else lo end").cast("int").alias("lo"), F.when(F.col("kind") == 0, F.col("hi")).otherwise(F.col("hi") - half).cast("int").alias("hi"), F.col("scan").alias("role"), rest.cast("int").alias("long")))
        else:
            rows = None
    best = F.min(F.struct((-F.col("best_n")).alias("m"), F.col("best").alias("word")))
    return links.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", (-F.col("b.m")).alias("best_n"), F.col("b.word").alias("best"))


def roots(links: DataFrame) -> DataFrame:
    """word, root: where following the links (word, form; one of each word, no circles) ends."""
    now = written(links.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = now.select(F.col("word").alias("via"), F.col("root").alias("to"))
        joined = now.join(on, now["root"] == on["via"], "left")
        if not joined.where("via is not null").limit(1).count():
            return now
        now = written(joined.select("word", F.coalesce("to", "root").alias("root")), "roots")


def variants(words: DataFrame, times: int = TIMES) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word. words: word (distinct), n."""
    words = written(words, "words")
    near = near_words(words)
    own = words.join(near, "word", "left")
    has = F.col("best_n") >= times * F.col("n")
    forms = written(own.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(has, F.col("best")).alias("form"), F.when(has, F.col("best_n")).alias("form_n")), "forms")
    ends = roots(forms.where("form is not null").select("word", "form"))
    return forms.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(counted_words(table(spark, sf_dir, "documents"), with_slips))


OP13_SQL = rf"""
with recursive {CRC32},
r as (select doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{{C0}}-\x{{FF}}]+')) w from documents),
c as (select doc_id, w, count(*) k from r where length(w) >= 7 group by 1, 2),
h as (select c.*, {crc_of("doc_id || ':' || w")} h from c, crc),
s as (select case when h % 31 = 0 then substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) else w end word, k from h),
v as (select word, sum(k)::bigint n from s where length(word) >= 7 group by 1 having sum(k) >= 2),
d as (select word, n, i, substr(word, 1, i) || substr(word, i + 2) x from (select *, unnest(range(length(word))) i from v)),
e as (select a.word, b.word near, b.n near_n from d a join d b on a.x = b.x and a.i = b.i and a.word <> b.word
 union select d.word, v.word, v.n from d join v on v.word = d.x union select v.word, d.word, d.n from d join v on v.word = d.x),
b as (select word, count(*) n_near, first(near order by near_n desc, near) best, max(near_n) best_n from e group by word),
f as (select word, n, coalesce(n_near, 0)::bigint n_near, case when best_n >= 10 * n then best end form, case when best_n >= 10 * n then best_n end form_n from v left join b using (word)),
t as (select word, coalesce(form, word) up from f union select t.word, f.form from t join f on f.word = t.up where f.form is not null)
select f.word, f.form, t.up root, f.n, f.n_near, f.form_n::bigint form_n from f join t using (word) join f g on g.word = t.up where g.form is null
"""
