"""Operator 6: packing token sequences by first-fit decreasing.

Every document becomes its token ids (byte-level BPE, no special tokens added) and one
closing id. It is cut into pieces of exactly ``capacity`` ids and one shorter rest. Full
pieces are sequences of their own. Rests are dealt at random into groups of bounded
size; each group is packed alone by first-fit decreasing, where a tournament
tree over the bins' free room finds the leftmost bin that fits in log(bins) steps.

Only (document, start, length, checksum) is shuffled, never ids (but for with_ids). Group
sizes do not depend on any column's values, so no key is hot.

Defined cases: null text is empty text, giving the closing id alone; an empty table
gives an empty result; rows that repeat (also whole duplicates) are packed each for
itself; a null doc_id is carried through; a control string of the tokenizer's in a text gives
its id, as the library's plain call does; other columns are ignored.
"""

from __future__ import annotations

import functools
import math
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

CAPACITY = 2048
END_ID = 1
#: Rests in a group of the packing, on average.
GROUP_ROWS = 16_384
VOCABULARY = "byte_bpe_50k.json"
#: Bounds on what an encoder remembers (units, in each of two generations), on the characters
#: handled at a time, units whose ids are taken at a time, and units encoded as one string.
CACHE_UNITS = 400_000
SLICE_CHARS = 4_000_000
TAKEN = 400_000
JOINED = 100
#: White space but blanks and line feeds, and those where pre-tokens may reach over a cut.
_SPACE = r"\t\x0b\f\r\x1c-\x1f\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_UNCUT = rf"[{_SPACE}]|^ | $| [ \n]|\n |\n\n\n|\n\n$"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Known:
    """Units and their ids: a number for each unit, and all ids in one growing array."""

    def __init__(self):
        self.rows: dict[str, int] = {}
        self.flat = np.empty(1 << 16, "<u4")
        self.used = 0
        self.start = np.empty(1 << 14, np.int64)
        self.size = np.empty(1 << 14, np.int32)

    def add(self, units: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        n = len(self.rows)
        while len(self.flat) < self.used + len(ids):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        while len(self.start) < n + len(units):
            self.start, self.size = np.concatenate([self.start, np.empty_like(self.start)]), np.concatenate([self.size, np.empty_like(self.size)])
        self.flat[self.used : self.used + len(ids)] = ids
        self.start[n : n + len(units)] = self.used + np.cumsum(sizes) - sizes
        self.size[n : n + len(units)] = sizes
        self.used += len(ids)
        self.rows.update(zip(units, range(n, n + len(units))))

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the units with these numbers, one after another, and how many each has."""
        sizes = self.size[rows]
        ends = np.cumsum(sizes, dtype=np.int64)
        places = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.start[rows] - ends + sizes, sizes)
        return self.flat[places], sizes


class WordEncoder:
    """Ids of whole texts, little-endian 32-bit, with units (words) encoded once.

    Pre-tokens never reach over a blank between two words, or over one or two line feeds before a
    word. So a text falls apart into units: the first word, then each word with its blank or
    line feed. Units are numbered by Arrow, the distinct ones looked up, new ones encoded many to a
    string whose ids are told apart by their bytes, and a text's ids are taken by its units'
    numbers. Texts with other white space or control strings are encoded whole.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known, self.older = Known(), Known()
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.n_bytes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():
            self.n_bytes[i] = len(token)  # a byte-level token has a character for each byte
        control = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.uncut = "|".join([_UNCUT, *control])

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _units(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of units that may follow one another, and how many each has."""
        ids, sizes = [], []
        for a in range(0, len(units), JOINED):
            part = units[a : a + JOINED]
            found = self._whole(["".join(part)])[0]
            ends = np.cumsum([len(u.encode()) for u in part])
            reached = np.cumsum(self.n_bytes[found])
            last = np.searchsorted(reached, ends)
            if len(found) and last[-1] < len(found) and (reached[last] == ends).all():
                sizes.append(np.diff(last + 1, prepend=0))
            else:  # a pre-token reaches over a cut: not with the vocabularies at hand
                each = self._whole(part)
                found = np.concatenate(each)
                sizes.append(np.array([len(x) for x in each]))
            ids.append(found)
        return np.concatenate(ids), np.concatenate(sizes)

    def _numbers(self, units: list[str], joined: bool) -> np.ndarray:
        """Numbers of distinct units. joined: all but a text's first, which is kept under another key."""
        keys = units if joined else ["\0" + u for u in units]
        rows = self.known.rows
        out = np.fromiter((rows.get(k, -1) for k in keys), np.int64, len(keys))
        new = np.flatnonzero(out < 0)
        if len(new):
            older = self.older.rows
            back = [i for i in new.tolist() if keys[i] in older]
            if back:
                self.known.add([keys[i] for i in back], *self.older.take(np.array([older[keys[i]] for i in back])))
            fresh = [i for i in new.tolist() if keys[i] not in older] if back else new.tolist()
            if fresh and joined:
                self.known.add([keys[i] for i in fresh], *self._units([u if u[:1] == "\n" else " " + u for u in (units[i] for i in fresh)]))
            elif fresh:
                each = self._whole([units[i] for i in fresh])
                self.known.add([keys[i] for i in fresh], np.concatenate(each), np.array([len(x) for x in each]))
            out[new] = [rows[keys[i]] for i in new.tolist()]
        return out

    def encode(self, texts: pa.Array) -> list[bytes]:
        """Each text's ids; texts holds no nulls."""
        if len(self.known.rows) > CACHE_UNITS:
            self.older, self.known = self.known, Known()
        uncut = pc.match_substring_regex(texts, self.uncut).to_numpy(zero_copy_only=False)
        out: list[bytes] = [b""] * len(texts)
        if uncut.any():
            for i, ids in zip(np.flatnonzero(uncut).tolist(), self._whole(texts.filter(pa.array(uncut)).to_pylist())):
                out[i] = ids.tobytes()
        if uncut.all():
            return out
        split = pc.split_pattern(pc.replace_substring(texts.filter(pa.array(~uncut)), "\n", " \n"), " ")
        starts = split.offsets.to_numpy()[:-1] - split.offsets[0].as_py()
        units = split.flatten().dictionary_encode()
        numbers = units.indices.to_numpy()
        firsts = pc.take(units, pa.array(starts)).dictionary_decode().dictionary_encode()
        # units that are only ever first are not encoded as others are
        later = np.ones(len(numbers), bool)
        later[starts] = False
        used = np.zeros(len(units.dictionary), bool)
        used[numbers[later]] = True
        rows = np.zeros(len(used), np.int64)
        rows[used] = self._numbers(units.dictionary.filter(pa.array(used)).to_pylist(), True)
        first = self._numbers(firsts.dictionary.to_pylist(), False)
        rows = rows[numbers]
        rows[starts] = first[firsts.indices.to_numpy()]
        cut, a = np.flatnonzero(~uncut), 0
        while a < len(cut):
            b = max(a + 1, int(np.searchsorted(starts, starts[a] + TAKEN)))
            flat, sizes = self.known.take(rows[starts[a] : starts[b] if b < len(starts) else None])
            raw, ends = flat.tobytes(), 4 * np.append(np.cumsum(np.add.reduceat(sizes, starts[a:b] - starts[a])), 0)
            for k, i in enumerate(cut[a:b].tolist()):
                out[i] = raw[ends[k - 1] : ends[k]]
            a = b
        return out


@functools.cache
def encoder(path: str) -> WordEncoder:
    """One for each Python worker, which serves many tasks."""
    return WordEncoder(path)


def slices(ids: list, texts: list, keep_null: bool = False) -> Iterator[tuple[list, list[str]]]:
    """Runs of rows of about SLICE_CHARS characters; null texts are empty, or stay."""
    if not keep_null:
        texts = [t or "" for t in texts]
    a, chars = 0, 0
    for i, t in enumerate(texts):
        chars += len(t or "")
        if chars >= SLICE_CHARS:
            yield ids[a : i + 1], texts[a : i + 1]
            a, chars = i + 1, 0
    if a < len(texts):
        yield ids[a:], texts[a:]


def text_slices(texts: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """(first row, rows) of about SLICE_CHARS bytes; null texts are empty."""
    texts = pc.fill_null(texts, "")
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    a = 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + SLICE_CHARS, "right")))
        yield a, texts.slice(a, b - a)
        a = b


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """A row per piece; with_ids adds the ids themselves as array<long>."""
    path = path or vocabulary_path()
    schema = PIECES + (", ids array<long>" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, end = encoder(path), np.asarray([end_id], "<u4").tobytes()
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for at, texts in text_slices(batch.column(1)):
                rows: list[tuple] = []
                for doc, raw in zip(ids[at : at + len(texts)], words.encode(texts)):
                    raw += end
                    n = len(raw) // 4
                    for start in range(0, n, capacity):
                        part = raw[4 * start : 4 * (start + capacity)]
                        row = (doc, start, len(part) // 4, zlib.crc32(part), n)
                        rows.append((*row, np.frombuffer(part, "<u4").tolist()) if with_ids else row)
                columns = list(zip(*rows))
                types = [pa.int64()] * 5 + [pa.list_(pa.int64())] * with_ids
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * with_ids
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


class TournamentTree:
    """Free room of bins 0, 1, ...; each inner node holds the larger of its two children."""

    def __init__(self, bins: int, capacity: int):
        self.size = 1 << max(0, bins - 1).bit_length()
        self.room = [capacity] * (2 * self.size)

    def place(self, length: int) -> tuple[int, int]:
        """Put length into the leftmost bin with room; its number and the room it had."""
        room, node = self.room, 1
        while node < self.size:
            node *= 2
            if room[node] < length:
                node += 1
        before = room[node]
        room[node] = before - length
        where = node - self.size
        while node > 1:
            node //= 2
            best = max(room[2 * node], room[2 * node + 1])
            if room[node] == best:
                break
            room[node] = best
        return where, before


def first_fit_decreasing(lengths, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(bin, offset) of each length, all at most capacity; longer ones first, ties in order."""
    out: list[tuple[int, int]] = [(0, 0)] * len(lengths)
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    # a bin more than half full for each but the last: this many bins always do
    tree = TournamentTree(min(len(lengths), 2 * math.ceil(sum(lengths) / capacity) + 1), capacity)
    for i in order:
        where, before = tree.place(lengths[i])
        out[i] = (where, capacity - before)
    return out


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, group_rows: int = GROUP_ROWS, with_ids: bool = False) -> DataFrame:
    """The pieces of docs with sequence_id and offset.

    sequence_id: of rests the group's number times 2^32, then the bin's; of full pieces negative.
    """
    cut = common.materialise(pieces(docs, path, capacity, end_id, with_ids), "pieces").withColumn("__row", F.monotonically_increasing_id())
    full, rests = cut.where(F.col("length") == capacity), cut.where(F.col("length") < capacity)
    groups = max(1, math.ceil(rests.count() / group_rows))
    # the number of a row in the written table spreads also equal rows
    group = F.pmod(F.xxhash64(F.lit(6), "__row"), F.lit(groups))
    names = cut.columns[:-1]

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "start"], ascending=[False, True, True], ignore_index=True)
        places = first_fit_decreasing(rows["length"].tolist(), capacity)
        rows["sequence_id"] = [(int(key[0]) << 32) + b for b, _ in places]
        rows["offset"] = [o for _, o in places]
        return rows[[*names, "sequence_id", "offset"]]

    schema = PIECES + (", ids array<long>" if with_ids else "") + ", sequence_id long, offset long"
    packed = rests.withColumn("__group", group).drop("__row").groupBy("__group").applyInPandas(run, schema)
    return packed.unionByName(full.select(*names, (-1 - F.col("__row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset")))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(common.table(spark, sf_dir, "documents"))
