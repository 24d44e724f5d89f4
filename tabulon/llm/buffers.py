"""Texts of an Arrow batch as one byte buffer with offsets, cut into pieces of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

PIECE_BYTES = 4_000_000
#: Bytes of an Arrow batch that Spark hands to Python; by rows alone a batch of long texts is held whole on both sides.
BATCH_BYTES = 4_000_000
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Bound the session's Arrow batches by bytes, unless the session sets its own bound."""
    if spark.conf.get(_BATCH_SETTING, None) is None:
        spark.conf.set(_BATCH_SETTING, str(BATCH_BYTES))


def text_array(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """Texts with null as the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.large_string()), "")


def byte_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts, and where each begins (one more entry than texts)."""
    _, offsets, data = texts.buffers()
    starts = np.frombuffer(offsets, np.int64, len(texts) + 1, texts.offset * 8)
    if data is None or starts[-1] == starts[0]:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[starts[0]:starts[-1]], starts - starts[0]


def cuts(texts: pa.Array, limit: int) -> Iterator[tuple[int, int]]:
    """First text, and text after the last, of stretches of at most `limit` bytes, or one text."""
    starts = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(starts, starts[at] + limit, "right")) - 1)
        yield at, end
        at = end


def binary_values(column: pa.ChunkedArray, kind: str) -> np.ndarray:
    """The numbers that stand in a binary column, one row after the other, without a copy of each row."""
    parts = []
    for chunk in column.chunks:
        _, offsets, data = chunk.buffers()
        ends = np.frombuffer(offsets, np.int32 if pa.types.is_binary(chunk.type) else np.int64)[chunk.offset:chunk.offset + len(chunk) + 1]
        if data is not None and len(chunk):
            parts.append(np.frombuffer(data, np.uint8)[ends[0]:ends[-1]])
    flat = parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.zeros(0, np.uint8)
    return flat.view(kind) if flat.flags.aligned and flat.ctypes.data % 8 == 0 else flat.copy().view(kind)


def pieces(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = PIECE_BYTES) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Slices of the batches that hold at most `limit` bytes of text, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        texts = batch.column(batch.schema.get_field_index(text)).cast(pa.large_string())
        for at, end in cuts(texts, limit):
            # Nulls are filled piece by piece, as that copies the bytes.
            yield batch.slice(at, end - at), text_array(texts.slice(at, end - at))
        # A worker serves task after task: what this batch held goes back to the system.
        del batch, texts
        pa.default_memory_pool().release_unused()


def with_columns(batch: pa.RecordBatch, drop: str | None = None, **columns: pa.Array) -> pa.RecordBatch:
    kept = [n for n in batch.schema.names if n != drop]
    return pa.RecordBatch.from_arrays([*[batch.column(n) for n in kept], *columns.values()], [*kept, *columns])


def mixed(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def byte_words(data: np.ndarray, starts: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of bytes in `member` (a table of 256 truth values) that do not cross texts:
    first byte, byte after the last, and number of the text."""
    inside = member[data]
    begin, end = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    heads = starts[:-1][starts[:-1] < starts[1:]]
    begin[heads] = inside[heads]
    end[heads[1:] - 1] = inside[heads[1:] - 1]
    first, after = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return first, after, np.searchsorted(starts, first, "right") - 1
