"""Operator 5: chat formatting with offset-aligned loss masks.

A turn is rendered as <|im_start|>role<|im_sep|>text<|im_end|>. The three control strings are
added to the tokenizer, so each is one token, and no token reaches from the template into
a role or a text. Control strings inside roles and texts (the vocabulary's own too) get a backslash
after their '<', and those that look escaped one more, so they never look like a turn and come
back exactly.

A conversation is rendered whole and encoded once, with offsets. Turn spans and token
spans are both sorted, so each assistant span finds its tokens by two binary searches;
those tokens are under the loss mask. They cover the span and nothing else: what is learned is
what they decode to.

Rows are dealt by conversation and sorted in the partition, then streamed: one
conversation is held at a time (it is one text), never a partition. As its hash runs over
its turns in order, a conversation is one task's work, as a document is.

Defined cases: null text is empty, null role too; turns go by turn (null first), then role,
then text, and rows that repeat are turns of their own; rows without conv_id belong
to no conversation and are left out; an empty table gives only what is added to it; other
columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .packing import vocabulary_path

# The template's control strings and the vocabulary's.
START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
_NAMES = "im_start|im_sep|im_end|endoftext"
LEARNED = "assistant"
_CONTROL = re.compile(rf"<(\\*)\|({_NAMES})\|>")
_ESCAPED = re.compile(rf"<\\(\\*)\|({_NAMES})\|>")
_TURN = re.compile(r"<\|im_start\|>(.*?)<\|im_sep\|>(.*?)<\|im_end\|>", re.S)


def escape(text: str) -> str:
    return _CONTROL.sub(r"<\\\1|\2|>", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|\2|>", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int, str]]]:
    """The conversation's text and, for each turn, where its text lies and its role."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{START}{escape(role)}{SEP}", escape(text)
        spans.append((at + len(head), at + len(head) + len(body), role))
        parts += [head, body, END]
        at = spans[-1][1] + len(END)
    return "".join(parts), spans


def read_back(formatted: str) -> list[tuple[str, str]]:
    return [(unescape(role), unescape(text)) for role, text in _TURN.findall(formatted)]


@functools.cache
def tokenizer(path: str):
    """The vocabulary with the control strings as tokens of their own; one for each Python worker."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import AddedToken, Tokenizer, processors

    t = Tokenizer.from_file(path)
    t.add_special_tokens([AddedToken(c, special=True, normalized=False) for c in (START, SEP, END)])
    t.post_processor = processors.ByteLevel(trim_offsets=False)  # blanks belong to their tokens
    return t


@functools.cache
def token_bytes(path: str) -> list[bytes]:
    """Each id's bytes. A byte-level vocabulary writes printable bytes as themselves, the others from U+0100 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}
    t = tokenizer(path)
    control = set(t.get_added_tokens_decoder())
    out = [b""] * t.get_vocab_size(with_added_tokens=True)
    for token, i in t.get_vocab(with_added_tokens=True).items():
        out[i] = token.encode() if i in control else bytes(map(byte.__getitem__, token))
    return out


def loss_mask(offsets: np.ndarray, spans: list[tuple[int, int, str]], learned: str = LEARNED) -> np.ndarray:
    """Whether each token is under the mask: it lies within a learned span."""
    mask = np.zeros(len(offsets), bool)
    starts, ends = offsets[:, 0], offsets[:, 1]
    for start, end, role in spans:
        if role == learned and start < end:
            mask[np.searchsorted(starts, start, "left") : np.searchsorted(ends, end, "right")] = True
    return mask


FORMATTED = "conv_id long, formatted string, ids array<int>, loss array<boolean>"
#: Characters of conversations that are encoded and sent on together.
WAITING = 1_000_000


def format_conversations(rows: DataFrame, path: str | None = None, learned: str = LEARNED) -> DataFrame:
    """FORMATTED: each conversation's text, ids and loss mask by token."""
    path = path or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, waiting, size = tokenizer(path), [], 0

        def finished() -> pa.RecordBatch:
            texts = [text for _, text, _ in waiting]
            ids, masks = [], []
            for encoded, (_, _, spans) in zip(t.encode_batch(texts, add_special_tokens=False), waiting):
                ids.append(np.array(encoded.ids, np.int32))
                masks.append(loss_mask(np.array(encoded.offsets, np.int64).reshape(-1, 2), spans, learned))
            ends = pa.array(np.cumsum([0, *map(len, ids)]), pa.int32())
            lists = lambda values: pa.ListArray.from_arrays(ends, pa.array(np.concatenate(values)))
            out = pa.RecordBatch.from_arrays([pa.array([c for c, _, _ in waiting], pa.int64()), pa.array(texts, pa.string()), lists(ids), lists(masks)], [x.split()[0] for x in FORMATTED.split(", ")])
            waiting.clear()
            return out

        conv, turns = None, []
        for batch in batches:
            for c, role, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if c != conv and turns:
                    waiting.append((conv, *render(turns)))
                    size += len(waiting[-1][1])
                    turns = []
                    if size > WAITING:
                        yield finished()
                        size = 0
                conv = c
                turns.append((role or "", text or ""))
        if turns:
            waiting.append((conv, *render(turns)))
        if waiting:
            yield finished()

    own = rows.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"), F.col("turn").cast("long").alias("turn"))
    dealt = own.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.select("conv_id", "role", "text").mapInArrow(run, FORMATTED)


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def digests(formatted: DataFrame, path: str | None = None) -> DataFrame:
    """DIGESTS, read back from format_conversations' output alone: turns from the text, what is learned from the masked ids."""
    path = path or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = token_bytes(path)
        for batch in batches:
            rows = []
            convs, texts, ids, masks = (batch.column(i) for i in range(4))
            for conv, text, own, mask in zip(convs.to_pylist(), texts.to_pylist(), ids, masks):
                turns, hashed, loss, chars = read_back(text), hashlib.sha256(), hashlib.sha256(), 0
                for role, said in turns:
                    hashed.update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
                # a run of masked tokens is one text: control tokens lie between any two
                own, mask = own.values.to_numpy(), mask.values.to_numpy(zero_copy_only=False)
                edges = np.flatnonzero(np.diff(mask.astype(np.int8), prepend=0, append=0))
                for a, b in edges.reshape(-1, 2).tolist():
                    part = unescape(b"".join(map(pieces.__getitem__, own[a:b].tolist())).decode())
                    loss.update(part.encode())
                    chars += len(part)
                rows.append((conv, len(turns), hashed.hexdigest(), chars, loss.hexdigest(), len(text)))
            types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            columns = list(zip(*rows)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], [x.split()[0] for x in DIGESTS.split(", ")])

    return formatted.select("conv_id", "formatted", "ids", "loss").mapInArrow(run, DIGESTS)


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = common.table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    said = f"{END}{START}assistant ok"
    added = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return digests(format_conversations(rows.unionByName(added)))


OP5_SQL = r"""
with c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null
  union all select -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' union all select -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')
select conv_id, count(*)::bigint as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
  sum(length(regexp_replace(role, '<(\\*)\|(im_start|im_sep|im_end|endoftext)\|>', '<\1\\|\2|>', 'g')) + length(regexp_replace(text, '<(\\*)\|(im_start|im_sep|im_end|endoftext)\|>', '<\1\\|\2|>', 'g')) + 32)::bigint as formatted_chars
from c group by conv_id
"""
