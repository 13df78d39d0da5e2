"""Byte-level BPE encoding and decoding as a monoid tree reduction.

A piece (one match of the public pattern) is encoded by halves.  Two encoded
neighbours are joined by re-encoding a window of tokens around the boundary.
The window grows until its first and last tokens come out unchanged.

Why that is final: greedy merging (lowest rank first, leftmost on ties) yields
exactly the sequences in which every adjacent token pair, encoded
alone, stays that pair.  If some merge crossed a boundary of such a
sequence, the first one to do so would also happen when that pair is encoded
alone, because the order of merges inside a part does not depend on what lies
outside it until a boundary is crossed.  A window whose end tokens are
unchanged leaves every pair at its rim as it was, so all pairs hold.

Across pre-token boundaries the join is plain concatenation.  Decoding
concatenates token bytes up the same kind of tree.

Nulls are empty texts; empty texts give no ids.  Repeated rows are encoded each on
its own.  Columns other than the two named are not read.
"""

from __future__ import annotations

import base64
import heapq
from array import array

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .chunks import ChunkEncoder
from .common import kept, map_rows

_INF = 1 << 60


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(t): int(r) for t, r in (line.split() for line in f if line.strip())}


def greedy(piece: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """Merge the adjacent pair of lowest rank, leftmost first, until none is left."""
    n = len(piece)
    if n < 2:
        return [piece] if n else []
    if n <= 40:
        at, get = list(range(n + 1)), ranks.get  # where the parts begin
        rank = [get(piece[i:i + 2], _INF) for i in range(n - 1)]
        while rank:
            low = min(rank)
            if low == _INF:
                break
            i = rank.index(low)
            del at[i + 1], rank[i]
            if i:
                rank[i - 1] = get(piece[at[i - 1]:at[i + 1]], _INF)
            if i < len(rank):
                rank[i] = get(piece[at[i]:at[i + 2]], _INF)
        return [piece[a:b] for a, b in zip(at, at[1:])]
    nxt, prev, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    heap = [(r, i) for i in range(n - 1) if (r := ranks.get(piece[i:i + 2])) is not None]
    heapq.heapify(heap)
    alive = [True] * n
    while heap:
        r, i = heapq.heappop(heap)
        j = nxt[i] if alive[i] else n
        if j >= n or ranks.get(piece[i:end[j]]) != r:
            continue
        alive[j], end[i], nxt[i] = False, end[j], nxt[j]
        if nxt[i] < n:
            prev[nxt[i]] = i
        for a in (prev[i], i):
            if a >= 0 and nxt[a] < n and (q := ranks.get(piece[a:end[nxt[a]]])) is not None:
                heapq.heappush(heap, (q, a))
    return [piece[i:end[i]] for i in range(n) if alive[i]]


def join(left: list[bytes], right: list[bytes], ranks: dict[bytes, int]) -> list[bytes]:
    """The encoding of the concatenation of two encoded neighbours."""
    if not left or not right:
        return left or right
    kl = kr = 2
    while True:
        kl, kr = min(kl, len(left)), min(kr, len(right))
        mid = greedy(b"".join(left[-kl:]) + b"".join(right[:kr]), ranks)
        left_ok = kl == len(left) or mid[0] == left[-kl]
        right_ok = kr == len(right) or mid[-1] == right[kr - 1]
        if left_ok and right_ok:
            return left[:len(left) - kl] + mid + right[kr:]
        kl, kr = (kl if left_ok else 2 * kl), (kr if right_ok else 2 * kr)


def tree_encode(piece: bytes, ranks: dict[bytes, int], leaf: int = 16) -> list[bytes]:
    if len(piece) <= leaf:
        return greedy(piece, ranks)
    half = len(piece) // 2
    return join(tree_encode(piece[:half], ranks, leaf), tree_encode(piece[half:], ranks, leaf), ranks)


def tree_decode(ids: np.ndarray, vocab: list[bytes], leaf: int = 4096) -> bytes:
    if len(ids) <= leaf:
        return b"".join(map(vocab.__getitem__, ids.tolist()))
    half = len(ids) // 2
    return tree_decode(ids[:half], vocab, leaf) + tree_decode(ids[half:], vocab, leaf)


def _newer_letters() -> regex.Pattern | None:
    """Letters and numbers that only the regex module's newer Unicode tables hold."""
    import tiktoken
    kind = r"[\p{L}\p{N}]"
    every = "".join(map(chr, [*range(0x80, 0xD800), *range(0xE000, 0x110000)]))
    mine = "".join(regex.findall(kind + "+", every))
    alone = {bytes([i]): i for i in range(256)}
    theirs = bytes(tiktoken.Encoding("letters", pat_str=kind, mergeable_ranks=alone, special_tokens={})
                   .encode_ordinary(mine)).decode()
    runs: list[list[int]] = []
    for c in sorted(map(ord, set(mine).difference(theirs))):
        if runs and runs[-1][1] == c - 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return regex.compile("[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in runs) + "]") if runs else None


class Codec:
    """Encoder and decoder of one vocabulary, kept once per Python worker."""

    def __init__(self, path: str, pattern: str):
        self.ranks = load_ranks(path)
        self.pattern = regex.compile(pattern)
        self.newer = _newer_letters()
        self.vocab = [b""] * (max(self.ranks.values(), default=-1) + 1)
        for t, r in self.ranks.items():
            self.vocab[r] = t
        self.pieces: dict[str, bytes] = {}
        self.chunks = ChunkEncoder(self.encode_units)
        self.encode = self.chunks.encode

    @classmethod
    def of(cls, path: str, pattern: str) -> Codec:
        return kept((cls, path, pattern), lambda: cls(path, pattern))

    def piece(self, piece: str) -> bytes:
        """ids of one match, packed; a piece that is itself a token is that token."""
        b = piece.encode()
        whole = self.ranks.get(b)
        if whole is not None:
            return array("I", (whole,)).tobytes()
        return array("I", [self.ranks[t] for t in tree_encode(b, self.ranks)]).tobytes()

    def split(self, unit: str) -> list[str]:
        """The matches of the pattern, with the letters and numbers the tiktoken library knows."""
        if self.newer is None or unit.isascii() or not self.newer.search(unit):
            return self.pattern.findall(unit)
        known = self.newer.sub("\ue000", unit)  # a private-use character is no letter for either
        return [unit[m.start():m.end()] for m in self.pattern.finditer(known)]

    def encode_units(self, units: list[str]) -> list[bytes]:
        out, pieces = [], self.pieces
        for u in units:
            got, parts = [], self.split(u)
            if len(parts) == len(units) == 1:  # the caller keeps it
                return [self.piece(parts[0])]
            for p in parts:
                ids = pieces.get(p)
                if ids is None:
                    ids = self.piece(p)
                    if len(p) <= 64:
                        if len(pieces) >= 150_000:
                            pieces.clear()
                        pieces[p] = ids
                got.append(ids)
            out.append(b"".join(got))
        return out

    def decode(self, ids: bytes) -> bytes:
        return tree_decode(np.frombuffer(ids, "<u4"), self.vocab)


def encode(df: DataFrame, id_col: str, text_col: str, path: str, pattern: str) -> DataFrame:
    """(id, n_tokens, ids): ids as little-endian unsigned 32-bit integers."""
    schema = pa.schema([(id_col, pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])

    def run(rows):
        codec = Codec.of(path, pattern)
        for i, text in rows:
            ids = codec.encode(text)
            yield i, len(ids) // 4, ids

    return map_rows(df.select(id_col, text_col), run, schema)


def decode(df: DataFrame, id_col: str, path: str, pattern: str) -> DataFrame:
    """(id, n_tokens, ids, decoded) from the rows of ``encode``."""
    schema = pa.schema([(id_col, pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("decoded", pa.binary())])

    def run(rows):
        codec = Codec.of(path, pattern)
        for i, n, ids in rows:
            yield i, n, ids, codec.decode(ids)

    return map_rows(df.select(id_col, "n_tokens", "ids"), run, schema)


def round_trip(df: DataFrame, id_col: str, text_col: str, path: str, pattern: str) -> DataFrame:
    """``decode`` of ``encode``, in one pass with one codec in memory."""
    schema = pa.schema([(id_col, pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("decoded", pa.binary())])

    def run(rows):
        codec = Codec.of(path, pattern)
        for i, text in rows:
            ids = codec.encode(text)
            yield i, len(ids) // 4, ids, codec.decode(ids)

    return map_rows(df.select(id_col, text_col), run, schema)
