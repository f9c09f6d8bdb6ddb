"""Operator 2: token counts by count-only Viterbi over a unigram vocabulary.

Aho-Corasick lists the vocabulary's matches, dynamic programming carries the best score and the piece count
along, and nothing else is kept (see lattice). Of equal scores the tokenizer's rule holds: an edge replaces
another only if it is better, and edges come longest first.

Defined cases: a null or empty text has 0 pieces and score 0; very long texts are whole, a text of one long
word costs time and memory in proportion; repeated rows are counted alike; an empty table gives none. Other
columns are not read.
"""

from __future__ import annotations

import itertools
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, small_batches
from .lattice import PATH, Edges, Vocab, split

#: Distinct words whose counts a worker keeps for later batches.
KEPT_WORDS = 400_000


class Counter:
    def __init__(self, vocab: Vocab):
        self.vocab, self.number, self.score, self.count = vocab, defaultdict(itertools.count().__next__), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def of(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Pieces and best score (in thousandths of a nat) of each text."""
        if len(self.number) > KEPT_WORDS:
            self.__init__(self.vocab)
        chunks = [split(t) if t else [] for t in texts]
        known = len(self.number)
        flat = np.fromiter(map(self.number.__getitem__, itertools.chain.from_iterable(chunks)), np.int64)
        if len(self.number) > known:
            score, count = Edges(self.vocab, list(itertools.islice(self.number, known, None))).viterbi()
            self.score, self.count = np.concatenate([self.score, score]), np.concatenate([self.count, count])
        ends = np.concatenate([[0], np.cumsum([len(c) for c in chunks])]).astype(np.int64)
        return tuple(np.diff(np.concatenate([[0], np.cumsum(x[flat])])[ends]) if len(flat) else np.zeros(len(texts), np.int64) for x in (self.count, self.score))


def count_tokens(spark: SparkSession, docs: DataFrame, path: str = PATH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, best_score (nats): a row for each row of docs."""
    small_batches(spark)
    sent = spark.sparkContext.broadcast(Vocab.read(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(sent.value)
        for batch in batches:
            count, score = counter.of(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(count), pa.array(score / 1000.0)], names=["doc_id", "n_tokens", "best_score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, n_tokens long, best_score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(spark, read(spark, sf_dir, "documents"))
