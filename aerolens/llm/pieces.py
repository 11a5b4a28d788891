"""A SentencePiece model as a weighted transducer, shared by operators 4 and 7.

Three machines are compiled from the model file and composed lazily with the input:

* the normaliser: a blank before the text, blanks written as U+2581 (only models whose
  normaliser is the identity otherwise are taken; others are refused);
* the pieces: an arc per piece, whose weight in the tropical semiring is -score for a
  unigram model;
* byte fallback: for a character that no piece begins to cover, an arc of its bytes' pieces.

Best path: the shortest one, found by relaxing positions from left to right.

For a BPE model path scores don't say what its merges do: merging is greedy. But a piece
sequence is what merging yields if and only if each neighbouring pair (u, t) is what
merging u+t yields. So the piece arcs are composed with that relation: states remember the last
piece, and an arc that doesn't go with it has infinite weight, any other none. One path of
finite weight is left, and it is the shortest. (tests/llm compare with the library.)

Pieces hold U+2581 only at their start and no line feed, so texts fall apart into chunks
before them; forward() takes sorted distinct chunks and keeps the states of the prefix that
a chunk shares with the one before: the depth-first walk of their trie, in the
memory of one path.
"""

from __future__ import annotations

import functools
import re
import struct
from collections.abc import Iterable, Iterator

BLANK = "▁"
MODEL = "piece_bpe_32k.model"
UNIGRAM, BPE = 1, 2
#: Kinds of pieces in a model file (fixed values of the format).
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
_CHUNKS = re.compile(f"\n|{BLANK}*[^{BLANK}\n]+|{BLANK}+")


def _fields(raw: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of a protocol buffer message, by its published wire format."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(raw):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        elif kind == 2:
            size = varint()
            yield tag >> 3, raw[at : at + size]
            at += size
        else:
            size = {1: 8, 5: 4}[kind]
            yield tag >> 3, struct.unpack("<d" if size == 8 else "<f", raw[at : at + size])[0]
            at += size


class Model:
    """Pieces (text, score, kind) and settings of a model file."""

    def __init__(self, pieces: list[tuple[str, float, int]], kind: int = BPE, dummy_prefix: bool = True):
        self.pieces, self.kind, self.dummy_prefix = pieces, kind, dummy_prefix

    @classmethod
    def read(cls, path: str) -> Model:
        with open(path, "rb") as f:
            top = list(_fields(f.read()))
        pieces = []
        for raw in (v for k, v in top if k == 1):
            p = dict(_fields(raw))
            pieces.append((p[1].decode(), p.get(2, 0.0), p.get(3, NORMAL)))
        trainer = dict(_fields(next((v for k, v in top if k == 2), b"")))
        norm = dict(_fields(next((v for k, v in top if k == 3), b"")))
        if norm.get(2) or norm.get(4, 1) or any(kind == USER for *_, kind in pieces):
            raise ValueError("only identity normalisers that keep white space, without user-defined pieces, are taken")
        return cls(pieces, trainer.get(3, UNIGRAM), bool(norm.get(3, 1)))


class PieceTransducer:
    def __init__(self, model: Model):
        self.model = model
        self.ids = {text: i for i, (text, _, kind) in enumerate(model.pieces) if kind == NORMAL}
        self.score = [s for _, s, _ in model.pieces]
        self.text = [t for t, _, _ in model.pieces]
        self.longest = max(map(len, self.ids), default=1)
        self.bytes = {int(t[1:-1], 16): i for i, (t, _, kind) in enumerate(model.pieces) if kind == BYTE}
        self.unknown = next((i for i, (_, _, kind) in enumerate(model.pieces) if kind == UNKNOWN), 0)
        self.unknown_weight = 10 - min((self.score[i] for i in self.ids.values()), default=0)
        self.goes: dict[int, bool] = {}
        inner = [t for t in self.ids if BLANK in t.lstrip(BLANK) or "\n" in t]
        #: whether texts fall apart before blanks and at line feeds
        self.splits = not inner and model.kind == BPE

    def merged(self, text: str) -> list[str]:
        """What greedy merging makes of a short text: best score first, leftmost where equal."""
        symbols = list(text)
        while len(symbols) > 1:
            best, where = None, -1
            for i in range(len(symbols) - 1):
                piece = self.ids.get(symbols[i] + symbols[i + 1])
                if piece is not None and (best is None or self.score[piece] > best):
                    best, where = self.score[piece], i
            if best is None:
                break
            symbols[where : where + 2] = [symbols[where] + symbols[where + 1]]
        return symbols

    def compatible(self, u: int, t: int) -> bool:
        key = u << 20 | t
        known = self.goes.get(key)
        if known is None:
            if len(self.goes) > 1_000_000:
                self.goes.clear()
            known = self.goes[key] = self.merged(self.text[u] + self.text[t]) == [self.text[u], self.text[t]]
        return known

    def fallback(self, char: str) -> list[int]:
        found = [self.bytes.get(b) for b in char.encode("utf-8", "surrogatepass")]
        return [self.unknown] if None in found else found

    def forward(self, chunks: Iterable[str]) -> Iterator[tuple[str, list[int], list[int]]]:
        """(chunk, last, counts) of sorted distinct chunks.

        last[i] is the best path's last piece at position i (-1: byte fallback of one
        character), counts[i] its number of ids. Both lists are reused: the entries of a
        shared prefix are computed once.
        """
        ids, longest, bpe, goes = self.ids, self.longest, self.model.kind == BPE, self.goes
        last, counts, dist, before = [-2], [0], [0.0], ""
        for chunk in chunks:
            shared = 0
            for a, b in zip(before, chunk):
                if a != b:
                    break
                shared += 1
            del last[shared + 1 :], counts[shared + 1 :], dist[shared + 1 :]
            for i in range(shared + 1, len(chunk) + 1):
                best, weight, n = None, 0.0, 0
                for j in range(i - longest if i > longest else 0, i):
                    piece = ids.get(chunk[j:i])
                    if piece is None:
                        continue
                    if bpe:
                        u = last[j]
                        if u < 0 or goes.get(u << 20 | piece) or self.compatible(u, piece):
                            best, n = piece, counts[j] + 1
                            break
                    elif best is None or dist[j] - self.score[piece] < weight:
                        best, weight, n = piece, dist[j] - self.score[piece], counts[j] + 1
                if best is None or not bpe and chunk[i - 1] not in ids and dist[i - 1] + self.unknown_weight < weight:
                    best, weight, n = -1, dist[i - 1] + self.unknown_weight, counts[i - 1] + len(self.fallback(chunk[i - 1]))
                last.append(best)
                dist.append(weight)
                counts.append(n)
            before = chunk
            yield chunk, last, counts

    def path(self, chunk: str, last: list[int]) -> list[int]:
        """The ids along the best path."""
        out: list[int] = []
        i = len(chunk)
        while i:
            if last[i] < 0:
                out.extend(reversed(self.fallback(chunk[i - 1])))
                i -= 1
            else:
                out.append(last[i])
                i -= len(self.text[last[i]])
        out.reverse()
        return out

    def chunks(self, text: str) -> list[str]:
        """Independent parts of the normalised text, in order; '' gives none."""
        if not text:
            return []
        whole = (BLANK if self.model.dummy_prefix else "") + text.replace(" ", BLANK)
        return _CHUNKS.findall(whole) if self.splits else [whole]

    def encode(self, text: str) -> list[int]:
        parts = self.chunks(text)
        known = {c: self.path(c, last) for c, last, _ in self.forward(sorted(set(parts)))}
        return [i for c in parts for i in known[c]]

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids: byte pieces joined as UTF-8 (replacing what isn't), one blank before the text taken off."""
        raw = bytearray()
        for i in ids:
            text, _, kind = self.model.pieces[i]
            if kind == BYTE:
                raw.append(int(text[1:-1], 16))
            elif kind == UNKNOWN:
                raw += " ⁇ ".encode()
            elif kind == NORMAL:
                raw += text.replace(BLANK, " ").encode("utf-8", "surrogatepass")
        out = raw.decode("utf-8", "replace")
        return out[1:] if self.model.dummy_prefix and out[:1] == " " else out


@functools.cache
def transducer(path: str) -> PieceTransducer:
    """One for each Python worker, which serves many tasks."""
    return PieceTransducer(Model.read(path))


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Remembered:
    """Values of chunks, the lately used ones kept, in at most two generations of `bound`."""

    def __init__(self, machine: PieceTransducer, value, bound: int = 400_000):
        self.machine, self.value, self.bound = machine, value, bound
        self.now: dict = {}
        self.older: dict = {}

    def of(self, wanted: set[str]) -> dict:
        if len(self.now) > self.bound:
            self.older, self.now = self.now, {}
        fresh = []
        for c in wanted:
            if c not in self.now:
                if c in self.older:
                    self.now[c] = self.older[c]
                else:
                    fresh.append(c)
        fresh.sort()
        for c, last, counts in self.machine.forward(fresh):
            self.now[c] = self.value(c, last, counts)
        return self.now
