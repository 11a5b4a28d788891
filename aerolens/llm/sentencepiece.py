"""Operator 4: SentencePiece encoding and decoding by a weighted finite-state transducer.

The transducer is pieces.PieceTransducer: normaliser, pieces and byte fallback composed
with each text, and the tropical semiring's shortest path. Texts are encoded whole; the
chunks that they fall apart into are composed once while they are remembered.

Work is by row, without a shuffle; memory is bounded by slices of texts and the bound of
what is remembered.

Defined cases: null text gives null ids; empty text gives none; rows that repeat are
encoded each for itself; an empty table gives an empty result; null ids decode to null,
ids outside the vocabulary are refused; other columns are ignored.
"""

from __future__ import annotations

import functools
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .packing import slices
from .pieces import Remembered, model_path, transducer


@functools.cache
def _paths(path: str) -> Remembered:
    machine = transducer(path)
    return Remembered(machine, lambda c, last, _: array("I", machine.path(c, last)).tobytes())


def encode_texts(texts: list[str], path: str) -> list[bytes]:
    """Each text's ids, 32-bit in the machine's order."""
    known = _paths(path)
    parts = [known.machine.chunks(t) for t in texts]
    found = known.of(set().union(*parts))
    return [b"".join(map(found.__getitem__, p)) for p in parts]


def _rows(docs: DataFrame, schema: str, types: list, row, path: str) -> DataFrame:
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, texts in slices(batch.column(0).to_pylist(), batch.column(1).to_pylist(), keep_null=True):
                encoded = encode_texts([t or "" for t in texts], path)
                rows = [row(i, t, e) for i, t, e in zip(ids, texts, encoded)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids array<int>."""
    row = lambda i, t, e: (i, None if t is None else np.frombuffer(e, "u4").astype(np.int32))
    return _rows(docs, "doc_id long, ids array<int>", [pa.int64(), pa.list_(pa.int32())], row, path or model_path())


def decode(rows: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, text of rows (doc_id, ids)."""
    path = path or model_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(path)
        for batch in batches:
            texts = [None if x is None else machine.decode(x) for x in (v.as_py() for v in batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return rows.select(F.col("doc_id").cast("long"), F.col("ids").cast("array<int>")).mapInArrow(run, "doc_id long, text string")


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_ids, ids_crc32 (as in packing), n_bytes (ids of byte pieces), round_trip (decoding gives the text)."""
    path = path or model_path()

    def row(i: int, text: str | None, raw: bytes) -> tuple:
        if text is None:
            return (i, None, None, None, None)
        machine = transducer(path)
        ids = np.frombuffer(raw, "u4")
        low, high = min(machine.bytes.values(), default=0), max(machine.bytes.values(), default=-1)
        return (i, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), int(((ids >= low) & (ids <= high)).sum()), _decoded(machine, ids) == text)

    return _rows(docs, "doc_id long, n_ids long, ids_crc32 long, n_bytes long, round_trip boolean", [pa.int64()] * 4 + [pa.bool_()], row, path)


def _decoded(machine, ids: np.ndarray) -> str:
    """decode() of many ids: the pieces' bytes are looked up and joined."""
    if not hasattr(machine, "raw"):
        kinds = machine.model.pieces
        machine.raw = [bytes([int(t[1:-1], 16)]) if k == 6 else b"" if k == 3 else t.replace("▁", " ").encode("utf-8", "surrogatepass") if k != 2 else " ⁇ ".encode() for t, _, k in kinds]
    out = b"".join(map(machine.raw.__getitem__, ids.tolist())).decode("utf-8", "replace")
    return out[1:] if machine.model.dummy_prefix and out[:1] == " " else out


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(common.table(spark, sf_dir, "documents"))
