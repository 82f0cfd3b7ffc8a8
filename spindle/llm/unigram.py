"""Token counts of a unigram tokenizer, by count-only Viterbi.

An Aho-Corasick automaton over the vocabulary enumerates every piece that ends at each character; dynamic programming
carries the best score and its number of pieces, and no lattice or back pointers. The rules are those of the tokenizers
library's unigram model: a greater score wins; of equal scores the piece that starts first (the longest) does; a
character without a piece of its own is unknown, at the least score of the vocabulary less 10; neighbouring unknowns are one.

White space only separates: each word, with the mark U+2581 before it, is a text of its own, as with a Metaspace
splitter. Words are remembered by each worker (bounded), so that a frequent word is worked out once.

The vocabulary is a parameter: pieces with their scores, taken from a sentencepiece file by `vocabulary`.

Defined results: a null, empty or blank text has no tokens and score 0.
"""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindle.llm.bpe import Memory, tokenizer_path
from spindle.llm.common import documents, held, lean, table

MARK = "▁"
PENALTY = 10.0
#: Words remembered by a worker, in each of two generations.
WORD_MEMORY = 400_000


def vocabulary(path: str) -> list[tuple[str, float]]:
    """The ordinary pieces of a sentencepiece file, with their scores."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(sp.id_to_piece(i), sp.get_score(i)) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]


class Counter:
    """Counts the pieces of words."""

    def __init__(self, pieces: list[tuple[str, float]]):
        import ahocorasick

        self.auto = ahocorasick.Automaton()
        for piece, score in dict(pieces).items():
            if piece:
                self.auto.add_word(piece, (len(piece), score))
        self.unknown = min((s for _, s in pieces), default=0.0) - PENALTY
        self.empty = not len(self.auto)
        if not self.empty:
            self.auto.make_automaton()
        self.words = Memory(WORD_MEMORY)

    def word(self, text: str) -> tuple[int, float]:
        """(pieces, score) of the best segmentation."""
        n = len(text)
        ends: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
        single = [False] * n
        if not self.empty:
            for end, (size, score) in self.auto.iter(text):
                ends[end + 1].append((end + 1 - size, score))
                if size == 1:
                    single[end] = True
        best, count, tail = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        for e in range(1, n + 1):
            top, start, unk = None, 0, False
            for s, score in sorted(ends[e]):  # from the longest piece on; only a greater score replaces it
                score += best[s]
                if top is None or score > top:
                    top, start = score, s
            if not single[e - 1] and (top is None or self.unknown + best[e - 1] > top):
                top, start, unk = self.unknown + best[e - 1], e - 1, True
            best[e], tail[e] = top, unk
            count[e] = count[start] + (0 if unk and tail[start] else 1)
        return count[n], best[n]

    def text(self, text: str) -> tuple[int, float]:
        n, score, get = 0, 0.0, self.words.get
        for w in unicodedata.normalize("NFKC", text).split():
            got = get(w)
            if got is None:
                got = self.word(MARK + w)
                self.words.put(w, got)
            n += got[0]
            score += got[1]
        return n, score


def _counter(path: str) -> Counter:
    return held(f"unigram {path}", lambda: Counter(vocabulary(path)))


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, score of every row. docs: doc_id, text. path: a sentencepiece file on every machine."""
    key = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        counter = _counter(path)
        for batch in batches:
            rows = [counter.text(x.as_py() or "") for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for n, _ in rows], pa.int64()), pa.array([s for _, s in rows], pa.float64())], names=["doc_id", "n_tokens", "score"])

    return docs.select("doc_id", "text").mapInArrow(lean(run, f"unigram {path}"), f"doc_id {key}, n_tokens long, score double")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(documents(table(spark, sf_dir, "documents"), "text"), tokenizer_path("piece_bpe_32k.model")).withColumn("score", F.round("score", 4))
