"""Operator 8: language identification by a byte convolutional network, in numpy.

Bytes are embedded; filters of several widths run over them; each filter's largest
answer in a window (max pooling) feeds a softmax over the languages. Training (Adam on
cross-entropy) uses windows of a bounded sample of labelled texts, at most SAMPLE_DOCS rows
in expectation, as many of each language, picked by a hash over all of the table's rows. Every label
of the sample is learned. Prediction covers whole
texts: they are cut into windows of WINDOW bytes, run in batches, and the windows' class
probabilities are averaged by their bytes.

A filter's answer is a sum of one vector per byte and place, so the embedding and the
filters fold into one table per place (256 x filters), and prediction only adds rows.

The model (a few hundred KB) travels with the tasks; its size doesn't depend on the data.

Defined cases: text that is null or holds no letter gives 'und' with score 0; without
any labelled row all texts give 'und'; null doc_id counts as not held out, and is not
learned from; rows that repeat get the same prediction; an empty table gives an empty
result; columns other than doc_id, text and lang are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

WINDOW = 256
WIDTHS = (2, 3, 4)
EMBEDDING = 12
FILTERS = 16
#: Bound of the training sample: documents over all languages, windows of each.
SAMPLE_DOCS = 4_000
SAMPLE_WINDOWS = 6
STEPS = 700
BATCH = 128
RATE = 4e-3
#: Windows that prediction handles at a time.
CHUNK = 512
FOLDS, HELD_OUT = 4, 2


def windows_of(text: str) -> np.ndarray:
    """(windows, WINDOW) bytes of the whole text, blank-padded; white space runs and letters' case stay."""
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    n = max(1, -(-len(raw) // WINDOW))
    out = np.full(n * WINDOW, 32, np.uint8)
    out[: len(raw)] = raw
    return out.reshape(n, WINDOW)


class ByteNet:
    """Embedding, filters of each width, max pooling, softmax."""

    def __init__(self, classes: int, seed: int = 8):
        rng = np.random.default_rng(seed)
        normal = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        self.p = {"embedding": normal(256, EMBEDDING, scale=0.5)}
        for w in WIDTHS:
            self.p[f"filter{w}"] = normal(w, EMBEDDING, FILTERS, scale=(w * EMBEDDING) ** -0.5)
            self.p[f"bias{w}"] = np.zeros(FILTERS, np.float32)
        self.p["out"] = normal(len(WIDTHS) * FILTERS, classes, scale=0.1)
        self.p["out_bias"] = np.zeros(classes, np.float32)

    def tables(self) -> list[list[np.ndarray]]:
        return [[np.ascontiguousarray(self.p["embedding"] @ self.p[f"filter{w}"][j]) for j in range(w)] for w in WIDTHS]

    def pooled(self, x: np.ndarray, tables: list[list[np.ndarray]]) -> tuple[np.ndarray, list[np.ndarray]]:
        """Each filter's largest answer in each window, before the rectifier, and where it is."""
        best, where = [], []
        for w, places in zip(WIDTHS, tables):
            answers = places[0][x[:, : WINDOW - w + 1]]
            for j in range(1, w):
                answers += places[j][x[:, j : WINDOW - w + 1 + j]]
            at = answers.argmax(1)
            where.append(at)
            best.append(np.take_along_axis(answers, at[:, None, :], 1)[:, 0] + self.p[f"bias{w}"])
        return np.concatenate(best, 1), where

    def probabilities(self, x: np.ndarray, tables=None) -> np.ndarray:
        tables = tables or self.tables()
        best = []
        for w, places in zip(WIDTHS, tables):
            answers = places[0].take(x[:, : WINDOW - w + 1], 0)
            for j in range(1, w):
                answers += places[j].take(x[:, j : WINDOW - w + 1 + j], 0)
            best.append(answers.max(1) + self.p[f"bias{w}"])
        return softmax(np.maximum(np.concatenate(best, 1), 0) @ self.p["out"] + self.p["out_bias"])

    def gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        before, where = self.pooled(x, self.tables())
        hidden = np.maximum(before, 0)
        d = softmax(hidden @ self.p["out"] + self.p["out_bias"])
        d[np.arange(len(y)), y] -= 1
        d /= len(y)
        g = {"out": hidden.T @ d, "out_bias": d.sum(0), "embedding": np.zeros_like(self.p["embedding"])}
        dh = (d @ self.p["out"].T) * (before > 0)
        rows = np.arange(len(x))[:, None]
        for k, w in enumerate(WIDTHS):
            dk = dh[:, k * FILTERS : (k + 1) * FILTERS]
            g[f"bias{w}"] = dk.sum(0)
            g[f"filter{w}"] = np.empty_like(self.p[f"filter{w}"])
            for j in range(w):
                byte = x[rows, where[k] + j]  # the byte under place j of each filter's best answer
                g[f"filter{w}"][j] = np.einsum("bfe,bf->ef", self.p["embedding"][byte], dk)
                np.add.at(g["embedding"], byte, dk[:, :, None] * self.p[f"filter{w}"][j].T[None])
        return g

    def fit(self, x: np.ndarray, y: np.ndarray, steps: int = STEPS, seed: int = 8) -> ByteNet:
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(a) for k, a in self.p.items()}
        for step in range(1, steps + 1):
            pick = rng.integers(0, len(x), BATCH)
            for k, g in self.gradients(x[pick], y[pick]).items():
                m[k] += 0.1 * (g - m[k])
                v[k] += 0.001 * (g * g - v[k])
                self.p[k] -= RATE * (1 - step / (steps + 1)) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        return self


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS)) == HELD_OUT, F.lit(False))


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> tuple[ByteNet | None, list[str]]:
    """The network and its languages, from the rows that aren't held out."""
    able = docs.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    counts = common.materialise(able.groupBy("lang").agg(F.count("*").alias("n")), "labels")
    found = counts.count()
    if not found:
        return None, []
    shares = counts.select("lang", F.least(F.lit(1.0), F.lit(max(1, sample_docs // found)) / F.col("n")).alias("share"))
    # a document's place in [0, 1) is its hash: the same sample each time
    place = F.pmod(F.xxhash64(F.lit(8), "doc_id"), F.lit(1 << 40)) / float(1 << 40)
    drawn = common.lookup_join(able.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text"), shares, ["lang"], F.col("doc_id"), "inner")
    sample = drawn.where(place < F.col("share")).select("doc_id", "lang", "text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs_, langs, found = batch.column(0).to_pylist(), batch.column(1).to_pylist(), ([], [], [], [])
            for i, text in enumerate(batch.column(2)):
                w = windows_of(text.as_py())
                pick = np.random.default_rng(docs_[i] & 0xFFFFFFFF).permutation(len(w))[:SAMPLE_WINDOWS]
                for column, values in zip(found, ([langs[i]] * len(pick), (w[k].tobytes() for k in pick), [docs_[i]] * len(pick), pick.tolist())):
                    column.extend(values)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(found, (pa.string(), pa.binary(), pa.int64(), pa.int64()))], ["lang", "window", "doc_id", "k"])

    # repeated rows of one doc_id, or more labels than documents, could exceed the expectation: a hard bound, by hash
    cut_ = sample.mapInArrow(cut, "lang string, window binary, doc_id long, k long")
    rows = cut_.orderBy(F.xxhash64(F.lit(9), "doc_id", "k"), "doc_id", "k", "lang").limit(2 * sample_docs * SAMPLE_WINDOWS).select("lang", "window").toArrow()
    if not rows.num_rows:
        return None, []
    order = np.random.default_rng(8).permutation(rows.num_rows)
    x = np.frombuffer(b"".join(rows.column("window").to_pylist()), np.uint8).reshape(-1, WINDOW)[order]
    languages = sorted(set(rows.column("lang").to_pylist()))
    at = {lang: i for i, lang in enumerate(languages)}
    y = np.array([at[lang] for lang in rows.column("lang").to_pylist()])[order]
    return ByteNet(len(languages)).fit(x, y), languages


def predict(docs: DataFrame, net: ByteNet | None, languages: list[str]) -> DataFrame:
    """doc_id, lang_pred, score of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = net.tables() if net else None
        for batch in batches:
            ids, letters = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            sums, sizes = np.zeros((len(ids), max(1, len(languages)))), np.zeros(len(ids))
            held, owners, waiting = [], [], 0

            def flush() -> None:
                x, own = np.concatenate(held), np.concatenate(owners)
                for a in range(0, len(x), CHUNK):
                    np.add.at(sums, own[a : a + CHUNK], net.probabilities(x[a : a + CHUNK], tables) * weight(own[a : a + CHUNK], x[a : a + CHUNK])[:, None])
                held.clear(), owners.clear()

            def weight(own: np.ndarray, x: np.ndarray) -> np.ndarray:
                w = (x != 32).sum(1) + 1e-3  # padding and blanks say nothing
                np.add.at(sizes, own, w)
                return w

            for i, text in enumerate(batch.column(1)):
                if net is None or not letters[i]:
                    continue
                x = windows_of(text.as_py())
                held.append(x), owners.append(np.full(len(x), i))
                waiting += len(x)
                if waiting >= 8 * CHUNK:
                    flush()
                    waiting = 0
            if held:
                flush()
            mean = sums / np.maximum(sizes, 1e-9)[:, None]
            best = mean.argmax(1)
            known = sizes > 0
            yield pa.RecordBatch.from_arrays([
                pa.array(ids, pa.int64()),
                pa.array([languages[b] if k else "und" for b, k in zip(best, known)], pa.string()),
                pa.array(np.clip(mean.max(1) * known, 0, 1), pa.float64()),
            ], ["doc_id", "lang_pred", "score"])

    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long"), text.alias("text"), F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias("letters")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def identify(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    net, languages = train(docs, sample_docs)
    return predict(docs, net, languages).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(common.table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
