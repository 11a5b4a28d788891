"""Operator 7: token counts by trie-shared dynamic programming.

A text's pre-tokens (chunks before blanks and at line feeds) are counted, not encoded.
The distinct ones of a slice form a trie, walked depth first in sorted order: the
forward state of a prefix (best last piece and number of ids so far) is computed once for
all that share it, and the count at a pre-token's end is stored. A text's count is the
sum over its pre-tokens. The forward step is pieces.PieceTransducer.forward: unigram
scores for a unigram model, and for a BPE model the same recurrence under the pair relation,
so counts equal those of full encoding.

Work is by row, without a shuffle; memory is bounded.

Defined cases: null text counts 0 tokens and characters; rows that repeat are counted
each for itself; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .packing import slices
from .pieces import Remembered, model_path, transducer


@functools.cache
def _counts(path: str) -> Remembered:
    return Remembered(transducer(path), lambda c, _, counts: counts[len(c)])


def count_texts(texts: list[str], path: str) -> list[tuple[int, int]]:
    """(tokens, pre-tokens) of each text."""
    known = _counts(path)
    parts = [known.machine.chunks(t) for t in texts]
    found = known.of(set().union(*parts))
    return [(sum(map(found.__getitem__, p)), len(p)) for p in parts]


def token_counts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, n_pretokens, n_chars_counted of each document."""
    path = path or model_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, texts in slices(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                tokens, pre = zip(*count_texts(texts, path))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (ids, tokens, pre, [len(t) for t in texts])], ["doc_id", "n_tokens", "n_pretokens", "n_chars_counted"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_tokens long, n_pretokens long, n_chars_counted long")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(common.table(spark, sf_dir, "documents"))
