"""Corpus encoding with a public byte-level BPE as a streaming transducer of constant memory.

Every text, of whatever length, goes through one machine (:class:`Transducer`): characters are read in blocks, the
pre-tokenizer gives off a piece once :data:`AHEAD` further characters show that it can't change, and the piece goes
byte by byte through :class:`PieceTransducer`, which gives off a token once no later byte can change it. Pieces met
before come from a table of bounded size. Decoding is an incremental byte-to-text state machine.
"""

from __future__ import annotations

import base64
import codecs
import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
import tiktoken
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOKENIZER_DIR = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
BLOCK = 8192
# Fixed value: the pre-tokenizing pattern of the public byte-level vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same pattern, white space by its Unicode property (this library's \s also has four control characters).
PIECES = regex.compile(PATTERN.replace("[^\\s", "[^\\p{White_Space}").replace("\\s", "\\p{White_Space}").replace("\\S", "\\P{White_Space}"))
#: Characters behind a piece that can still change it: the two letters of a contraction (a run's end needs but one).
AHEAD = 2
#: Pieces kept with their ids.
PIECES_KEPT = 200_000
RUNS = {name: regex.compile(p) for name, p in {"letters": r"\p{L}+", "numbers": r"\p{N}+", "signs": r"[^\p{White_Space}\p{L}\p{N}]+", "blanks": r"\p{White_Space}+"}.items()}


@functools.lru_cache(maxsize=4)
def load(path: str) -> tuple[tiktoken.Encoding, dict[bytes, int]]:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), ranks


_LOOKAHEAD: dict[int, int] = {}


def lookahead(ranks: dict[bytes, int]) -> int:
    """Bytes after which a token of the merge list is certain: its longest token."""
    if id(ranks) not in _LOOKAHEAD:
        _LOOKAHEAD[id(ranks)] = max(map(len, ranks))
    return _LOOKAHEAD[id(ranks)]


class PieceTransducer:
    """Exact BPE of one piece, fed byte by byte.

    A token sequence is the encoding of its bytes iff all neighbours are compatible, that is if the pair encodes to
    itself. So the last token of every prefix follows from the last tokens of shorter prefixes, and the encoding of any
    continuation runs through one of the last ``lookahead`` positions (the longest token of the vocabulary). A token is
    stable, and emitted, once the back-pointers of all those positions agree on it.
    """

    def __init__(self, encoding: tiktoken.Encoding, ranks: dict[bytes, int], fits: dict[tuple[int, int], bool] | None = None):
        self.single = encoding._core_bpe.encode_single_piece
        self.ranks = ranks
        self.lookahead = lookahead(ranks)
        self.fits = {} if fits is None else fits
        self.window = b""
        self.n = 0
        #: position: (last token of the prefix that ends there, its length)
        self.last: dict[int, tuple[int, int]] = {}
        self.base = 0

    def compatible(self, a: int | None, b: int, ab: bytes, b_bytes: bytes) -> bool:
        if a is None:
            return self.single(b_bytes) == [b]
        if (a, b) not in self.fits:
            if len(self.fits) > 200_000:
                self.fits.clear()
            self.fits[a, b] = self.single(ab) == [a, b]
        return self.fits[a, b]

    def push(self, byte: int) -> list[int]:
        self.window = (self.window + bytes([byte]))[-2 * self.lookahead :]
        self.n += 1
        for size in range(1, min(self.lookahead, self.n - self.base) + 1):
            token = self.window[-size:]
            b = self.ranks.get(token)
            if b is None:
                continue
            before = self.n - size
            if before == 0:
                ok = self.compatible(None, b, b"", token)
            else:
                prior = self.last.get(before)
                if prior is None:
                    continue
                ok = self.compatible(prior[0], b, self.window[-size - prior[1] :], token)
            if ok:
                self.last[self.n] = (b, size)
                break
        return self.emit() if self.n % self.lookahead == 0 else []

    def path(self, end: int) -> list[int]:
        """Positions where the tokens of the prefix ``end`` end, down to what is already emitted."""
        ends = []
        while end > self.base:
            ends.append(end)
            end -= self.last[end][1]
        return ends[::-1]

    def emit(self, final: bool = False) -> list[int]:
        live = [p for p in range(max(self.base, self.n - self.lookahead), self.n + 1) if p in self.last or p == self.base]
        if final:
            stable = self.path(self.n)
        else:
            paths = [self.path(p) for p in live]
            shared = set(paths[0]).intersection(*paths[1:])
            stable = sorted(shared)
        out = [self.last[p][0] for p in stable]
        if stable:
            self.base = stable[-1]
            self.last = {p: v for p, v in self.last.items() if p >= self.base}
        return out

    def finish(self) -> list[int]:
        return self.emit(final=True) if self.n > self.base else []


class Transducer:
    """Characters in, ids out, in constant memory: a buffer of a few blocks, the open piece's window, a bounded table."""

    def __init__(self, path: str, block: int = BLOCK):
        self.encoding, self.ranks = load(path)
        self.block = block
        self.known: dict[str, list[int]] = {}
        self.fits: dict[tuple[int, int], bool] = {}
        self.pieces = 0  # pieces that went through byte by byte
        self.reset()

    def reset(self) -> None:
        self.buffer = ""
        self.open: PieceTransducer | None = None
        self.run: regex.Pattern | None = None

    def _machine(self) -> PieceTransducer:
        self.pieces += 1
        return PieceTransducer(self.encoding, self.ranks, self.fits)

    def _piece(self, piece: str) -> list[int]:
        machine, out = self._machine(), []
        for byte in piece.encode():
            out += machine.push(byte)
        out += machine.finish()
        if len(self.known) >= PIECES_KEPT:
            self.known.clear()
        if len(piece) <= 64:
            self.known[piece] = out
        return out

    def _push(self, text: str) -> list[int]:
        out: list[int] = []
        for byte in text.encode():
            out += self.open.push(byte)
        return out

    def _go_on(self, last: bool) -> list[int]:
        """Feed the open piece; a run of blanks keeps its last one back, which belongs to what follows."""
        m = self.run.match(self.buffer)
        end = m.end() if m else 0
        closed = end < len(self.buffer) or last
        held = 1 if self.run is RUNS["blanks"] and end and (end < len(self.buffer) or not last) else 0
        out = self._push(self.buffer[: end - held])
        self.buffer = self.buffer[end - held :]
        if closed:
            out += self.open.finish()
            self.open = self.run = None
        return out

    def feed(self, text: str, last: bool = False) -> list[int]:
        """Ids that became certain with ``text``; with ``last`` all that are left."""
        self.buffer += text
        out: list[int] = []
        if self.open is not None:
            out += self._go_on(last)
            if self.open is not None:
                return out
        pieces = PIECES.findall(self.buffer)
        end = len(self.buffer)
        while pieces and not last and end > len(self.buffer) - AHEAD:
            end -= len(pieces.pop())
        found = list(map(self.known.get, pieces))
        if None in found:
            found = [ids if ids is not None else self._piece(piece) for ids, piece in zip(found, pieces, strict=True)]
        out += itertools.chain.from_iterable(found)
        self.buffer = self.buffer[end:] if not last else ""
        if len(self.buffer) > self.block:
            # one piece, longer than a block and still open: what is read of it is certain
            first = self.buffer[1] if self.buffer[0] == " " and not RUNS["blanks"].match(self.buffer, 1) else self.buffer[0]
            self.run = next(r for r in RUNS.values() if r.match(first))
            self.open = self._machine()
            if first is not self.buffer[0] and self.buffer[0] == " " and self.run is not RUNS["blanks"]:
                out += self._push(" ")
                self.buffer = self.buffer[1:]
            out += self._go_on(False)
        return out

    def encode(self, text: str) -> list[int]:
        self.reset()
        out: list[int] = []
        for at in range(0, len(text), self.block):
            out += self.feed(text[at : at + self.block])
        return out + self.feed("", last=True)


@functools.lru_cache(maxsize=4)
def transducer(path: str, block: int = BLOCK) -> Transducer:
    return Transducer(path, block)


def encode(text: str | None, path: str, block: int = BLOCK) -> list[int]:
    """Ids of ``text``; null and empty texts have none."""
    return transducer(path, block).encode(text) if text else []


def decode(ids: list[int], path: str) -> Iterator[str]:
    """Text of a token stream, as far as each token completes characters (an incremental UTF-8 state machine)."""
    encoding, _ = load(path)
    machine = codecs.getincrementaldecoder("utf-8")("replace")
    for i in ids:
        yield machine.decode(encoding.decode_single_token_bytes(int(i)))
    yield machine.decode(b"", final=True)


def token_ids(text: Column, folder: str = TOKENIZER_DIR, vocabulary: str = VOCABULARY) -> Column:
    """ARRAY<INT>; the empty array for empty and null texts, all other texts whole."""
    path = f"{folder}/{vocabulary}"

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def ids(s: pd.Series) -> pd.Series:
        return pd.Series([np.asarray(encode(t, path), dtype=np.int32) for t in s], dtype=object)

    return ids(text)


def decoded(ids: Column, folder: str = TOKENIZER_DIR, vocabulary: str = VOCABULARY) -> Column:
    """STRING: the text of an array of ids; null for a null array, the empty text for an empty one."""
    path = f"{folder}/{vocabulary}"

    @F.pandas_udf(T.StringType())
    def text(s: pd.Series) -> pd.Series:
        return s.map(lambda x: "".join(decode(x, path)) if x is not None else None).astype(object)

    return text(ids)


def token_count(text: Column, folder: str = TOKENIZER_DIR, vocabulary: str = VOCABULARY) -> Column:
    path = f"{folder}/{vocabulary}"

    @F.pandas_udf(T.LongType())
    def count(s: pd.Series) -> pd.Series:
        return pd.Series([len(encode(t, path)) for t in s], dtype="int64")

    return count(text)
