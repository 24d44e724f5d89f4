"""Benchmark windows in documents, by Wu-Manber search over words.

Patterns are the windows of the benchmark items: 13 consecutive words, or the whole item if it is shorter. Patterns of
one length form one search: a block is two neighbouring words, the shift table says how far the pattern end may move
on when a block is read at its place, blocks that end a pattern lead to a bucket, and the bucket's patterns are compared
word by word. Words outside the benchmark let the search skip a whole pattern length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.llm.buffers import pieces, small_batches

# Fixed value: the bytes that words are made of, after A-Z are lower-cased.
WORD = rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 13
#: Items of one search table. More items mean more passes over the documents, never a larger table in a task.
ITEMS_PER_PASS = 20_000
MAX_ITEM_BYTES = 64 << 20
#: Bytes of text searched at once.
PIECE = 1_000_000

_words = re.compile(WORD).findall


def words_of(text: str | None) -> list[bytes]:
    return _words((text or "").encode().lower())


class Search:
    """Shift tables and buckets of all windows of the given (item number, text) pairs."""

    def __init__(self, items: list[tuple[int, str | None]], window: int = WINDOW) -> None:
        self.ids: dict[bytes, int] = {}
        patterns: dict[int, dict[tuple[int, ...], set[int]]] = {}
        for item, text in items:
            words = [self.ids.setdefault(w, len(self.ids) + 1) for w in words_of(text)]
            size = min(window, len(words))
            for i in range(len(words) - size + 1 if words else 0):
                patterns.setdefault(size, {}).setdefault(tuple(words[i:i + size]), set()).add(item)
        self.tables = [self._table(size, found) for size, found in sorted(patterns.items())]

    @staticmethod
    def _table(size: int, found: dict[tuple[int, ...], set[int]]):
        if size == 1:
            return size, {}, {p[0]: [(p, items)] for p, items in found.items()}
        shift: dict[tuple[int, int], int] = {}
        buckets: dict[tuple[int, int], list] = {}
        for pattern, items in found.items():
            for i in range(1, size):
                block = pattern[i - 1], pattern[i]
                shift[block] = min(shift.get(block, size - 1), size - 1 - i)
            buckets.setdefault(pattern[-2:], []).append((pattern, items))
        return size, shift, buckets

    def marks(self, words: list[bytes]) -> tuple[bytearray, set[int]]:
        """One byte a word, 1 inside an occurrence, and the items whose windows occur."""
        get = self.ids.get
        text = [get(w, 0) for w in words]
        n, items = len(text), set()
        hit = bytearray(n)
        for size, shift, buckets in self.tables:
            if size == 1:
                for i, w in enumerate(text):
                    if w in buckets:
                        hit[i] = 1
                        items |= buckets[w][0][1]
                continue
            end, longest = size - 1, size - 1
            while end < n:
                last = text[end]
                if not last:
                    end += size
                    continue
                block = text[end - 1], last
                step = shift.get(block, longest)
                if step:
                    end += step
                    continue
                start = end - size + 1
                for pattern, owners in buckets[block]:
                    if text[start] == pattern[0] and tuple(text[start:end + 1]) == pattern:
                        hit[start:end + 1] = b"\1" * size
                        items |= owners
                end += 1
        return hit, items


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id",
                   item_text: str = "text", window: int = WINDOW, items_per_pass: int = ITEMS_PER_PASS) -> DataFrame:
    """Add to each document `n_words`, `n_hit` (words inside an occurrence of a window) and `items` (the sorted, distinct
    ids, as strings, of the items with occurring windows).

    Null or wordless texts have no words and no hits; items without words have no windows; an item without an id marks
    words but is not named. Repeated rows and other columns stay; these three names must be new. The benchmark goes to
    the tasks in parts of `items_per_pass` items; a part above MAX_ITEM_BYTES is an error."""
    clash = {"n_words", "n_hit", "items"} & set(docs.columns)
    if clash:
        raise ValueError(f"columns exist: {sorted(clash)}")
    # The caller's columns go by other names meanwhile, so that none can meet a helper's.
    names = docs.columns
    docs = docs.select(*[F.col(f"`{c}`").alias(f"in_{i}") for i, c in enumerate(names)])
    text = f"in_{names.index(text)}"
    marked = benchmark.select(F.col(item).cast("string").alias("id"), F.col(item_text).alias("text"))
    small_batches(docs.sparkSession)
    parts = max(1, -(-marked.count() // items_per_pass))
    marked = marked.withColumn("part", F.pmod(F.xxhash64("id", "text"), F.lit(parts)))
    schema = T.StructType([*docs.schema, T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()),
                           T.StructField("items", T.ArrayType(T.StringType())), T.StructField("_hits", T.BinaryType())])
    out = docs
    for part in range(parts):
        rows = _collected(marked.filter(F.col("part") == part).drop("part"))
        search = Search([(i, t) for i, (_, t) in enumerate(rows)], window)
        shared = docs.sparkSession.sparkContext.broadcast((search, [r[0] for r in rows]))
        out = out.mapInArrow(_marker(shared, text, part == 0, schema.names), schema)
    return out.select(*[F.col(f"in_{i}").alias(c) for i, c in enumerate(names)], "n_words", "n_hit", "items")


def _collected(items: DataFrame) -> list[tuple[str | None, str | None]]:
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if size > MAX_ITEM_BYTES:
        raise ValueError(f"a part of the benchmark holds {size} bytes; lower items_per_pass")
    return sorted(((r.id, r.text) for r in items.collect()), key=lambda r: (r[0] is None, r[0] or "", r[1] or ""))


def _marker(search, text: str, first: bool, names: list[str]):
    """One pass over the documents. A later pass adds to the marks of the earlier ones, one byte a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, ids = search.value
        for batch, texts in pieces(batches, text, PIECE):
            kept = batch.columns if first else batch.columns[:-4]
            before = [None] * batch.num_rows if first else list(zip(batch.columns[-2].to_pylist(), batch.columns[-1].to_pylist()))
            n_words, n_hit, found, hits = [], [], [], []
            for raw, old in zip(texts.cast(pa.large_binary()).to_pylist(), before):
                words = _words(raw.lower())
                marks, items = table.marks(words)
                names_now = {ids[i] for i in items if ids[i] is not None}
                if old:
                    names_now |= set(old[0])
                    marks = (np.frombuffer(marks, np.uint8) | np.frombuffer(old[1], np.uint8)).tobytes()
                n_words.append(len(words))
                n_hit.append(sum(marks))
                found.append(sorted(names_now))
                hits.append(bytes(marks))
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(found, pa.list_(pa.string())),
                 pa.array(hits, pa.binary())], names)

    return run
