"""Byte-level BPE by backtracking over longest matches, in time linear in the text.

Bytes are read as Latin-1 characters, so that an Aho-Corasick automaton over the vocabulary finds, at each place,
every token that begins there. A token sequence is what the merges give if and only if each pair of neighbours is
compatible: the merges would not join anything across their border before both are complete. So the encoder takes the
longest match that is compatible with the token before it, shorter ones if need be, and steps back from dead ends,
marking them. Compatibility of a pair is worked out once and kept.
"""

from __future__ import annotations

import base64
import re
import struct
import sys
import unicodedata
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.llm.buffers import pieces, small_batches

# The code points that Unicode calls White_Space.
WHITE_SPACE = "\t-\r \x85\xa0  -     　"
#: Pre-tokens whose ids a Python worker keeps, in each of two halves, and pairs whose compatibility it keeps.
KEPT_PRETOKENS = 125_000
KEPT_PAIRS = 250_000
#: Bytes of text encoded at once.
PIECE = 1_000_000


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: base64 of the token and its rank on each line. The vocabulary is its proven size bound."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def _ranges(kind: str, top: int) -> str:
    """The code points of a general category up to `top`, as the inside of a character class."""
    out, begin = [], None
    for c in range(top + 2):
        inside = c <= top and unicodedata.category(chr(c))[0] == kind
        if inside and begin is None:
            begin = c
        elif not inside and begin is not None:
            out.append(f"\\U{begin:08x}-\\U{c - 1:08x}")
            begin = None
    return "".join(out)


def compile_pattern(pattern: str, top: int = sys.maxunicode) -> re.Pattern:
    """The splitting pattern for the standard library, with letters, numbers and white space spelled out. For texts
    without code points above 0xFFFF, a table up to there makes its matcher six times as fast."""
    names = {r"\p{L}": _ranges("L", top), r"\p{N}": _ranges("N", top), r"\s": WHITE_SPACE}

    def spelled(m: re.Match) -> str:
        body = m[0]
        for name, points in names.items():
            body = body.replace(name, points)
        return body

    pattern = re.sub(r"\[(?:\\p\{\w\}|[^\]])*\]", spelled, pattern)
    for name, points in names.items():
        pattern = pattern.replace(name, f"[{points}]")
    return re.compile(pattern.replace(r"\S", f"[^{WHITE_SPACE}]"))


class Encoder:
    """Encodes and decodes with one rank table."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks = ranks
        self.bytes_of = {i: t for t, i in ranks.items()}
        self.find = compile_pattern(pattern).findall
        self.find_short = compile_pattern(pattern, 0xFFFF).findall
        self.longest = max(map(len, ranks), default=1)
        # Latin-1 has one character a byte, so lengths of matches are lengths in bytes. Every beginning of a token leads
        # to the longest token that it begins with.
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        #: The longest token that begins a token and is shorter, and none (-1) if there is no such token.
        self.shorter: dict[int, int] = {}
        for token, i in ranks.items():
            begun = -1
            for n in range(1, len(token)):
                begun = ranks.get(token[:n], begun)
                self.automaton.add_word(token[:n].decode("latin-1"), begun)
            self.automaton.add_word(token.decode("latin-1"), i)
            self.shorter[i] = begun
        self.size_of = {i: len(t) for t, i in ranks.items()}
        #: By the left id, shifted, and the right one.
        self.compatible: dict[int, bool] = {}
        self.known: dict[str, bytes] = {}
        self.known_before: dict[str, bytes] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        for token in sorted(ranks, key=len):
            self.halves[ranks[token]] = self._last_merge(token)

    def _last_merge(self, token: bytes) -> tuple[int, int]:
        """The two parts that the merges join last to make this token; the token itself twice if it is not made so."""
        own = self.ranks[token]
        best = None
        for cut in range(1, len(token)):
            left, right = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
            # Both parts exist earlier, and the merges leave the border between them open until the end.
            if left is not None and right is not None and left < own and right < own and self._open(left, right, own):
                best = (left, right)
                break
        return best or (own, own)

    def _open(self, left: int, right: int, limit: int) -> bool:
        """Whether no merge of a rank below `limit` crosses the border between two finished tokens.

        Undo the merges of both sides from the latest on. Whatever stands at the border when a merge of some rank is
        due must not be a pair of lower rank than the merges that already built its sides."""
        ranks, bytes_of, halves = self.ranks, self.bytes_of, self.halves
        while True:
            joined = ranks.get(bytes_of[left] + bytes_of[right])
            if joined is not None and joined < limit:
                return False
            a, b = halves.get(left, (left, left)), halves.get(right, (right, right))
            whole_left, whole_right = a[0] == left, b[0] == right
            if whole_left and whole_right:
                return True
            # The later of the two merges is undone first. Of equal ranks the left one was merged first.
            if whole_right or not whole_left and left > right:
                limit, left = left, a[1]
            else:
                limit, right = right + 1, b[0]

    def _pair(self, left: int, right: int) -> bool:
        """Work out whether two neighbours are compatible, and keep it."""
        if len(self.compatible) >= KEPT_PAIRS:
            self.compatible.clear()
        found = self.compatible[left << 32 | right] = self._open(left, right, 1 << 32)
        return found

    def pretoken(self, piece: bytes) -> list[int]:
        """Ids of one match of the pattern."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        text, size, window = piece.decode("latin-1"), len(piece), self.longest
        path, value, size_of, shorter, compatible = self.automaton.longest_prefix, self.automaton.get, self.size_of, self.shorter, self.compatible
        tokens: list[int] = []
        dead: set[int] = set()
        pos, before = 0, -1
        ahead = text[:window]
        token = value(ahead[:path(ahead)], -1)
        while True:
            while token >= 0:
                end = pos + size_of[token]
                if end not in dead:
                    fits = before < 0 or compatible.get(before << 32 | token)
                    if fits or fits is None and self._pair(before, token):
                        break
                token = shorter[token]
            if token >= 0:
                tokens.append(token)
                if end == size:
                    return tokens
                pos, before = end, token
                ahead = text[pos:pos + window]
                token = value(ahead[:path(ahead)], -1)
            else:
                if not tokens:
                    raise ValueError("the vocabulary lacks a byte")
                dead.add(pos)
                token = tokens.pop()
                pos -= size_of[token]
                before = tokens[-1] if tokens else -1
                token = shorter[token]

    def _ids(self, match: str) -> bytes:
        """Ids of a match that is not among those kept last."""
        ids = self.known_before.get(match)
        if ids is None:
            found = self.pretoken(match.encode())
            ids = struct.pack(f"<{len(found)}I", *found)
        if len(match) <= 40:
            if len(self.known) >= KEPT_PRETOKENS:
                # Frequent matches come back from the older half when they occur again.
                self.known_before, self.known = self.known, {}
            self.known[match] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        short = text.isascii() or len(text.encode("utf-16-le")) == 2 * len(text)
        ids_of = self._ids
        return b"".join([self.known.get(match) or ids_of(match) for match in (self.find_short if short else self.find)(text)])

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_encoders: dict[tuple[int, str], Encoder] = {}


def _encoder(ranks, pattern: str) -> Encoder:
    """One encoder for each table in a Python worker, so that what it has worked out serves later tasks."""
    table = ranks.value
    key = (hash(frozenset(table.items())), pattern)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(table, pattern)
    return _encoders[key]


def encode_texts(df: DataFrame, ranks: dict[bytes, int], pattern: str, text: str = "text", ids: str = "ids",
                 decoded: str | None = None) -> DataFrame:
    """Add the ids of each whole text (null: empty) as binary, 4 bytes an id, in place of the text column. With `decoded`,
    also the bytes that these ids stand for, in the same pass.

    An empty table stays empty; other columns pass through, repeated rows stay. The new names must be free."""
    new = [n for n in (ids, decoded) if n]
    clash = set(new) & set(df.columns)
    if clash:
        raise ValueError(f"columns exist: {sorted(clash)}")
    small_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(ranks)
    kept = [f for f in df.schema if f.name != text]
    schema = T.StructType([*kept, *[T.StructField(n, T.BinaryType(), False) for n in new]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for batch, texts in pieces(batches, text, PIECE):
            encoder = encoder or _encoder(shared, pattern)
            found = [encoder.encode(t) for t in texts.to_pylist()]
            columns = [pa.array(found, pa.binary())]
            if decoded:
                columns.append(pa.array(map(encoder.decode, found), pa.binary()))
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(f.name)) for f in kept], *columns], schema.names)

    return df.mapInArrow(run, schema)


def decode_ids(df: DataFrame, ranks: dict[bytes, int], ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Add the bytes that the ids stand for. Null ids decode to nothing."""
    if decoded in df.columns:
        raise ValueError(f"column {decoded} exists")
    size = max(ranks.values()) + 1
    table = [b""] * size
    for token, i in ranks.items():
        table[i] = token
    small_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(table)
    schema = T.StructType([*df.schema, T.StructField(decoded, T.BinaryType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = shared.value.__getitem__
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(ids))
            found = [b"".join(map(token, np.frombuffer(x, "<u4").tolist())) if x else b"" for x in column.to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.binary())], schema.names)

    return df.mapInArrow(run, schema)


def token_digests(df: DataFrame, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Number of ids and the digests of ids and decoded bytes."""
    return df.select(*[c for c in df.columns if c not in (ids, decoded)],
                     F.floor(F.octet_length(ids) / 4).cast("long").alias("n_tokens"),
                     F.sha2(ids, 256).alias("ids_sha256"), F.sha2(decoded, 256).alias("decoded_sha256"))
