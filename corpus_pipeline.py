"""The corpus pipeline: each stage takes (spark, docs, sf_dir) and returns the documents that go on.

All stages but the last return the columns of documents; the last returns each document's tokens as counts and digests.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spindle.llm import bpe, decontaminate, minhash, quality, repeats
from spindle.llm.common import documents, dropped, table, written_alone


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return quality.kept(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five words, similarity 0.8) stays."""
    return minhash.first_of_each(docs)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document holds are cut out of the later ones."""
    return repeats.without_repeats(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's tokens: their number and the digests of ids and decoded text."""
    return bpe.digests(documents(docs, "text"), bpe.tokenizer_path())


STAGES = [
    ("quality classifier", quality_classifier),
    ("MinHash near-dedup", near_dedup),
    ("suffix-array dedup", suffix_array_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("BPE encoding and decoding", bpe_encoding),
]
#: The first stage is a learned classifier, which SQL can't express; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents; each but the last is written and read again. Tables go once the next stage is written."""
    docs = table(spark, sf_dir, "documents")
    for n, (_, stage) in enumerate(STAGES):
        before = docs
        if n < len(STAGES) - 1:
            docs = written_alone(lambda: stage(spark, before, sf_dir), f"stage{n}")  # noqa: B023
            dropped(before)
        else:
            docs = stage(spark, before, sf_dir)
    return docs
