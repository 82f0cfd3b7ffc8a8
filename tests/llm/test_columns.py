"""Every stage and operator over ids of every type, clashing column names, nulls and long texts."""

import random

import pytest
from pyspark.sql import functions as F

from spindle.llm import bpe, byte_bpe, decontaminate, language, minhash, periodic, quality, repeats, spelling, unigram

CLASHES = ("_id", "_y", "_gone", "_starts", "_ends", "_span_id", "_cuts", "y", "h", "f", "score", "rep", "key", "bin", "sig", "size", "bytes", "k", "n", "word", "path", "ids", "words", "word_", "count", "begins", "seed", "block")


def rows():
    r = random.Random(11)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 9))) for _ in range(200)]
    prose = lambda n: " ".join(r.choice(words) for _ in range(n))
    base = prose(60)
    texts = [None, "", base, base, base + " end", prose(40), "X" * 4000, prose(9000), "éÀ ñ ß " * 30, "one"]
    return [(i, t, "en") for i, t in enumerate(texts)], base


@pytest.mark.parametrize("kind", ["smallint", "int", "bigint", "decimal(12,0)", "string"])
def test_stages_keep_columns_and_id_types(spark, kind):
    data, base = rows()
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string").withColumn("doc_id", F.col("doc_id").cast(kind)).withColumns({c: F.lit("x") for c in CLASHES}).repartition(2)
    labels = spark.createDataFrame([(i, int(i % 2), 0) for i in range(10)], "doc_id long, quality int, toxic int").withColumn("doc_id", F.col("doc_id").cast(kind))
    items = spark.createDataFrame([(1, " ".join(base.split()[5:30])), (2, "one")], "item_id long, text string")
    ids = lambda df: sorted(int(r.doc_id) for r in df.collect())
    out = quality.kept(docs, labels, threshold=0.0)
    assert out.columns == docs.columns and out.schema["doc_id"].dataType == docs.schema["doc_id"].dataType and ids(out) == list(range(10))
    near = minhash.first_of_each(docs)
    assert near.columns == docs.columns and ids(near) == [0, 1, 2, 5, 6, 7, 8, 9]
    left = decontaminate.decontaminated(docs, items)
    assert left.columns == docs.columns and ids(left) == [0, 1, 5, 6, 7, 8]
    if kind != "string":
        cut = repeats.without_repeats(docs)
        assert cut.columns == docs.columns and {int(r.doc_id): r.text for r in cut.collect()}[3] == ""
    assert language.predict(docs, language.train(docs)).count() == 10
    for got in (bpe.digests(docs, bpe.tokenizer_path()), unigram.token_counts(docs, bpe.tokenizer_path("piece_bpe_32k.model")), periodic.digests(docs), byte_bpe.digests(docs, bpe.tokenizer_path("byte_bpe_50k.tiktoken"), __import__("public_tokenizers").PATTERN)):
        assert ids(got) == list(range(10)) and got.schema["doc_id"].dataType == docs.schema["doc_id"].dataType
    assert spelling.counted_words(docs).where("n < 2").count() == 0
