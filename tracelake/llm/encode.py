"""Byte-pair encoding by a lazily determinised transducer, and streaming decoding.

The encoding of a piece is the one sequence of tokens in which every pair of neighbours is what the merges make of the
two together. So the last token of each prefix follows from the last tokens of shorter prefixes. A state of the
transducer is the longest suffix read so far that begins a token, with the last tokens of the prefixes that end inside
it: all that later input can depend on. States and transitions are made when first needed and kept.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tracelake.core import spread

TOKENIZER_DIR = "/opt/tokenizers"
#: Fixed value: the published pre-tokenisation pattern of the 50k byte-level vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces whose ids a worker keeps, and states of its transducer, before it starts anew.
MEMO = 200_000
STATES = 100_000


def read_ranks(body: bytes) -> dict[bytes, int]:
    return {base64.b64decode(t): int(r) for t, r in (line.split() for line in body.splitlines() if line)}


class _State:
    __slots__ = ("edges", "last", "suffix", "window")

    def __init__(self, suffix: bytes, window: tuple):
        self.suffix, self.window, self.last = suffix, window, window[-1]
        self.edges: dict[int, _State] = {}


class Transducer:
    """``encode_piece`` gives the token ids of the bytes of one pre-token."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.length = {r: len(t) for t, r in ranks.items()}
        self.bytes_of = {r: t for t, r in ranks.items()}
        self.prefixes = {t[:n] for t in ranks for n in range(1, len(t) + 1)}
        self._restart()

    def _restart(self) -> None:
        self.fits: dict[tuple[int, int], bool] = {}
        self.start = _State(b"", (None,))
        self.states = {(b"", (None,)): self.start}

    def merge(self, piece: bytes) -> list[int]:
        """The merges applied one by one, lowest rank first; used on two tokens at a time only."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = self.ranks.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def _fit(self, left: int | None, right: int) -> bool:
        if left is None:
            key, whole = (-1, right), self.bytes_of[right]
        else:
            key, whole = (left, right), self.bytes_of[left] + self.bytes_of[right]
        known = self.fits.get(key)
        if known is None:
            known = self.fits[key] = self.merge(whole) == ([right] if left is None else [left, right])
        return known

    def _step(self, state: _State, byte: int) -> _State:
        suffix = state.suffix + bytes((byte,))
        cut = 0
        while suffix[cut:] not in self.prefixes:
            cut += 1
        suffix = suffix[cut:]
        window = state.window[len(state.window) - len(suffix) :]  # last tokens where a token that ends here may start
        last = None
        for n in range(len(suffix), 0, -1):
            t = self.ranks.get(suffix[-n:])
            if t is not None and self._fit(window[-n], t):
                last = t
                break
        key = (suffix, (*window, last))
        new = self.states.get(key)
        if new is None:
            new = self.states[key] = _State(*key)
        state.edges[byte] = new
        return new

    def encode_piece(self, piece: bytes) -> list[int]:
        if len(self.states) > STATES:
            self._restart()
        out: list[int] = []
        lasts: list[int] = []
        state, done, length = self.start, 0, self.length
        for i, byte in enumerate(piece, 1):
            state = state.edges.get(byte) or self._step(state, byte)
            lasts.append(state.last)
            if i - done >= 1024:  # emit what no later byte can change
                done = self._emit(out, lasts, done, len(state.window), i)
        tail = []
        i = len(piece)
        while i > done:
            t = lasts[i - 1]
            tail.append(t)
            i -= length[t]
        return out + tail[::-1]

    def _emit(self, out: list[int], lasts: list[int], done: int, reach: int, i: int) -> int:
        """Appends the tokens up to the last boundary that the chains back from all live positions share."""
        chains = []
        for p in range(i - reach + 1, i + 1):
            chain = []
            while p > done:
                chain.append(p)
                p -= self.length[lasts[p - 1]]
            chains.append(set(chain))
        shared = set.intersection(*chains)
        if not shared:
            return done
        p = end = max(shared)
        tokens = []
        while p > done:
            tokens.append(lasts[p - 1])
            p -= self.length[lasts[p - 1]]
        out.extend(tokens[::-1])
        return end


class Encoder:
    def __init__(self, body: bytes, pattern: str = PATTERN):
        self.transducer = Transducer(read_ranks(body))
        self.pieces = regex.compile(pattern).findall
        self.memo: dict[str, tuple[int, ...]] = {}

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        if not text:
            return out
        memo = self.memo
        if len(memo) > MEMO:
            memo.clear()
        for piece in self.pieces(text):
            ids = memo.get(piece)
            if ids is None:
                ids = self.transducer.encode_piece(piece.encode("utf-8"))
                if len(piece) <= 64:
                    memo[piece] = ids
            out += ids
        return out


@lru_cache(maxsize=2)
def encoder(body: bytes, pattern: str = PATTERN) -> Encoder:
    return Encoder(body, pattern)


class Utf8Stream:
    """Bytes to characters, a chunk at a time; an incomplete character waits for the next chunk.

    Ill-formed bytes become U+FFFD, one for each maximal part, as in the Unicode standard.
    """

    def __init__(self) -> None:
        self.point = self.need = 0
        self.low, self.high = 0x80, 0xBF

    def feed(self, chunk: bytes) -> str:
        if not self.need and chunk.isascii():
            return chunk.decode("ascii")
        out = []
        for b in chunk:
            if self.need:
                if self.low <= b <= self.high:
                    self.point = self.point << 6 | b & 0x3F
                    self.need -= 1
                    self.low, self.high = 0x80, 0xBF
                    if not self.need:
                        out.append(chr(self.point))
                    continue
                out.append("\ufffd")
                self.need, self.low, self.high = 0, 0x80, 0xBF
            if b < 0x80:
                out.append(chr(b))
            elif 0xC2 <= b <= 0xDF:
                self.need, self.point = 1, b & 0x1F
            elif 0xE0 <= b <= 0xEF:
                self.need, self.point = 2, b & 0x0F
                self.low, self.high = (0xA0 if b == 0xE0 else 0x80), (0x9F if b == 0xED else 0xBF)
            elif 0xF0 <= b <= 0xF4:
                self.need, self.point = 3, b & 0x07
                self.low, self.high = (0x90 if b == 0xF0 else 0x80), (0x8F if b == 0xF4 else 0xBF)
            else:
                out.append("\ufffd")
        return "".join(out)

    def close(self) -> str:
        left, self.need = self.need, 0
        return "\ufffd" if left else ""


def decode(ids, bytes_of: dict[int, bytes]) -> str:
    stream = Utf8Stream()
    return "".join(stream.feed(bytes_of[i]) for i in ids) + stream.close()


def tokenizer_body(name: str = "byte_bpe_50k", directory: str = TOKENIZER_DIR) -> bytes:
    with open(f"{directory}/{name}.tiktoken", "rb") as f:
        return f.read()


def encode_documents(docs: DataFrame, body: bytes, key: str = "doc_id", text: str = "text", pattern: str = PATTERN) -> DataFrame:
    """``(key, ids array<int>)``, a row for each row of ``docs``, in any order; no special tokens.

    A null or empty text has the empty list; text that spells a special token is ordinary text; repeated rows stay
    repeated. ``body`` is the vocabulary file (under 1 MB for the public tokenizers), sent to the executors once.
    """
    shared = docs.sparkSession.sparkContext.broadcast(body)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(shared.value, pattern)
        for b in batches:
            lists = [np.array(enc.encode(t), dtype=np.int32) for t in b.column(1).to_pylist()]
            offsets = np.zeros(len(lists) + 1, dtype=np.int32)
            np.cumsum([len(x) for x in lists], out=offsets[1:])
            flat = np.concatenate(lists) if lists else np.zeros(0, dtype=np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], [key, "ids"])

    kind = docs.schema[key].dataType.simpleString()
    return spread(docs.select(key, text), key).mapInArrow(run, f"{key} {kind}, ids array<int>")


def round_trips(docs: DataFrame, body: bytes, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, n_tokens, exact)``: tokens of each text, and whether streaming decoding gives the text back."""
    shared = docs.sparkSession.sparkContext.broadcast(body)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(shared.value)
        for b in batches:
            texts = b.column(1).to_pylist()
            ids = [enc.encode(t) for t in texts]
            exact = [decode(i, enc.transducer.bytes_of) == (t or "") for i, t in zip(ids, texts, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(i) for i in ids], pa.int32()), pa.array(exact, pa.bool_())], [key, "n_tokens", "exact"])

    kind = docs.schema[key].dataType.simpleString()
    return spread(docs.select(key, text), key).mapInArrow(run, f"{key} {kind}, n_tokens int, exact boolean")
