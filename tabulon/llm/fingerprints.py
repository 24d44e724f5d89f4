"""Similarity digests from improbable features.

Every window of WINDOW bytes gets its entropy, in whole steps of a fixed scale. A histogram of the entropies of all
windows of the corpus ranks them: the rarer the entropy, the better the rank. In every run of WINDOW neighbouring windows
the best rank wins, and windows that win often enough are the features of the text; where none does (short, or with the
same entropy throughout), all winners are. Distinct features go, in order, into a chain of Bloom filters, a fixed number to each. Two digests are compared filter by filter: the bits they share, less
what chance would give, as a share of the most they could have.
"""

from __future__ import annotations

import base64
import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.llm.buffers import byte_buffer, mixed, pieces

WINDOW = 64
#: Entropy steps: from 0 (one byte value only) to STEPS (all bytes differ).
STEPS = 1000
#: A feature must win this many of the runs that it stands in.
WINS = 16
FILTER_BYTES, FILTER_FEATURES, HASHES = 256, 160, 5
#: Overlap below this share of the way from chance to identity counts as none.
CHANCE_MARGIN = 0.1
PIECE = 1_000_000

# What a byte adds to the sum of count * log2(count) when it becomes the count-th of its value, in units of 2**-20.
_GAIN = np.array([0] + [round((c * np.log2(c) - ((c - 1) * np.log2(c - 1) if c > 1 else 0)) * (1 << 20)) for c in range(1, WINDOW + 1)], np.int64)
_FULL = WINDOW * int(np.log2(WINDOW)) << 20


def _joined(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts with a zero byte after each, so that no run of windows reaches into the next text."""
    n = len(starts) - 1
    out = np.zeros(len(data) + n, np.uint8)
    out[np.arange(len(data)) + np.repeat(np.arange(n), np.diff(starts))] = data
    return out, starts + np.arange(n + 1)


def window_entropies(data: np.ndarray) -> np.ndarray:
    """Entropy step of the window that begins at each byte. Sliding by one byte changes the sum of count * log2(count)
    by what the leaving byte took away and the entering byte adds, both known from counts inside the window."""
    n = len(data)
    if n < WINDOW:
        return np.zeros(0, np.int16)
    before, after = np.ones(n, np.uint8), np.ones(n, np.uint8)
    for d in range(1, WINDOW):
        same = (data[d:] == data[:-d]).view(np.uint8)
        before[d:] += same
        after[:-d] += same
    added, taken = np.cumsum(_GAIN[before]), np.cumsum(_GAIN[after])
    total = added[WINDOW - 1:].copy()
    total[1:] -= taken[:n - WINDOW]
    return ((_FULL - total) * STEPS // _FULL).astype(np.int16)


def entropy_histogram(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Number of windows of all texts for each entropy step: STEPS + 1 sums come to the driver, whatever the input."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(STEPS + 1, np.int64)
        for _, texts in pieces(batches, text, PIECE):
            data, starts = _joined(*byte_buffer(texts))
            entropy = window_entropies(data)
            counts += np.bincount(entropy[_inside(starts, len(entropy))], minlength=STEPS + 1)
        step = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(step, pa.int32()), pa.array(counts[step], pa.int64())], ["step", "n"])

    out = np.zeros(STEPS + 1, np.int64)
    for r in docs.select(text).mapInArrow(run, "step int, n long").groupBy("step").agg(F.sum("n").alias("n")).collect():
        out[r.step] = r.n
    return out


def _inside(starts: np.ndarray, n: int) -> np.ndarray:
    """Which windows lie in one text. The byte after each text is the separator."""
    edge = np.zeros(n + 1, np.int32)
    begin, last = starts[:-1], starts[1:] - 1 - WINDOW
    some = last >= begin
    np.add.at(edge, begin[some], 1)
    np.add.at(edge, last[some] + 1, -1)
    return np.cumsum(edge)[:n] > 0


def rarity_ranks(histogram: np.ndarray) -> np.ndarray:
    """Rank of each entropy step, 1 for the rarest that occurs; windows of one byte value (step 0) come last."""
    order = np.lexsort((np.arange(len(histogram)), histogram))
    ranks = np.empty(len(histogram), np.int64)
    ranks[order] = np.arange(1, len(histogram) + 1)
    ranks[0] = len(histogram) + 1
    return ranks


def _winners(keys: np.ndarray) -> np.ndarray:
    """For each position, the position of the least key (the leftmost of equals) among the next WINDOW."""
    n = len(keys)
    best = np.concatenate((keys, np.full(WINDOW, np.iinfo(np.int64).max >> 24)))
    best = (best << 24) + np.arange(len(best))
    d = 1
    while d < WINDOW:
        best = np.minimum(best[:-d], best[d:])
        d *= 2
    return best[:n] & ((1 << 24) - 1)


def _hash_windows(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    bytes_ = data[at[:, None] + np.arange(WINDOW)]
    h = np.full(len(at), 0x9E3779B97F4A7C15, np.uint64)
    for word in np.ascontiguousarray(bytes_).view("<u8").T:
        h = mixed(h ^ word) + np.uint64(0x632BE59BD9B4E019)
    return mixed(h)


def _features(data: np.ndarray, starts: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text number, feature hash) in order of place, each feature of a text once."""
    entropy = window_entropies(data)
    valid = _inside(starts, len(entropy))
    keys = np.where(valid, ranks[entropy], np.iinfo(np.int32).max)
    wins = np.bincount(_winners(keys)[valid], minlength=len(entropy)) if valid.any() else np.zeros(len(entropy), np.int64)
    at = np.flatnonzero((wins > 0) & valid)
    text = np.searchsorted(starts, at, "right") - 1
    often = wins[at] >= WINS
    served = np.zeros(len(starts) - 1, bool)
    served[text[often]] = True
    # A text in which no window wins often enough keeps all winners.
    kept = often | ~served[text]
    at, text = at[kept], text[kept]
    hashes = _hash_windows(data, at) if len(at) else np.zeros(0, np.uint64)
    # Texts too short for a window are one feature as a whole.
    sizes = np.diff(starts) - 1
    short = np.flatnonzero((sizes > 0) & (sizes < WINDOW))
    if len(short):
        padded = np.concatenate((data, np.zeros(WINDOW, np.uint8)))
        own = np.where(np.arange(WINDOW) < sizes[short][:, None], padded[starts[short][:, None] + np.arange(WINDOW)], 0).astype(np.uint8)
        h = sizes[short].astype(np.uint64)
        for word in np.ascontiguousarray(own).view("<u8").T:
            h = mixed(h ^ word) + np.uint64(0x632BE59BD9B4E019)
        text, hashes, at = np.concatenate((text, short)), np.concatenate((hashes, mixed(h))), np.concatenate((at, starts[short]))
    order = np.lexsort((at, hashes, text))
    t, h = text[order], hashes[order]
    fresh = np.ones(len(t), bool)
    fresh[1:] = (t[1:] != t[:-1]) | (h[1:] != h[:-1])
    t, h, p = t[fresh], h[fresh], at[order][fresh]
    order = np.lexsort((p, t))
    return t[order], h[order]


def _digests(data: np.ndarray, starts: np.ndarray, ranks: np.ndarray) -> list[bytes]:
    n = len(starts) - 1
    text, hashes = _features(data, starts, ranks)
    count = np.bincount(text, minlength=n)
    filters = -(-count // FILTER_FEATURES)
    base = np.cumsum(filters) - filters
    index = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    row = base[text] + index // FILTER_FEATURES
    total = int(filters.sum())
    bits = np.zeros((total, FILTER_BYTES * 8), bool)
    for i in range(HASHES):
        bits[row, ((hashes >> np.uint64(11 * i)) & np.uint64(FILTER_BYTES * 8 - 1)).astype(np.int64)] = True
    packed = np.packbits(bits, axis=1)
    return [packed[b:b + f].tobytes() for b, f in zip(base, filters)]


def digests(texts: pa.Array, ranks: np.ndarray) -> list[bytes]:
    """The chained filters of each text. A text longer than a piece is read in overlapping parts, with the same result."""
    data, starts = byte_buffer(texts)
    if len(texts) == 1 and len(data) > 4 * PIECE:
        return [_long_digest(data, ranks)]
    return _digests(*_joined(data, starts), ranks)


def _long_digest(data: np.ndarray, ranks: np.ndarray) -> bytes:
    hashes = _long_features(data, ranks, WINS)
    if not len(hashes):
        hashes = _long_features(data, ranks, 1)
    rows = np.arange(len(hashes)) // FILTER_FEATURES
    bits = np.zeros((-(-len(hashes) // FILTER_FEATURES), FILTER_BYTES * 8), bool)
    for i in range(HASHES):
        bits[rows, ((hashes >> np.uint64(11 * i)) & np.uint64(FILTER_BYTES * 8 - 1)).astype(np.int64)] = True
    return np.packbits(bits, axis=1).tobytes()


def _long_features(data: np.ndarray, ranks: np.ndarray, least: int) -> np.ndarray:
    """Distinct hashes, in order, of the windows that win at least so many runs."""
    seen: dict[int, None] = {}
    for at in range(0, len(data), PIECE):
        # A window's wins depend on the WINDOW - 1 runs before it and the windows of the run that begins at it.
        low, high = max(0, at - WINDOW), min(len(data), at + PIECE + 3 * WINDOW)
        part = data[low:high]
        entropy = window_entropies(part)
        keys = ranks[entropy]
        wins = np.bincount(_winners(keys), minlength=len(keys))
        own = np.flatnonzero(wins >= least)
        own = own[(own + low >= at) & (own + low < at + PIECE)]
        for h in _hash_windows(part, own).tolist() if len(own) else ():
            seen.setdefault(h)
    return np.array(list(seen), np.uint64)


def likeness(a: bytes, b: bytes) -> float:
    """0 to 1. Each filter of the shorter digest takes its best match in the longer one; the mean counts. Two empty
    digests are alike, an empty and another are not."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    x, y = (np.unpackbits(np.frombuffer(d, np.uint8).reshape(-1, FILTER_BYTES), axis=1).astype(np.float32) for d in (a, b))
    if len(x) > len(y) or len(x) == len(y) and a > b:
        x, y = y, x
    total = 0.0
    nx, ny = x.sum(axis=1), y.sum(axis=1)
    for i in range(0, len(x), 64):
        shared = x[i:i + 64] @ y.T
        least = np.minimum(nx[i:i + 64, None], ny[None, :])
        chance = nx[i:i + 64, None] * ny[None, :] / (FILTER_BYTES * 8)
        floor = chance + CHANCE_MARGIN * (least - chance)
        total += np.clip((shared - floor) / np.maximum(least - floor, 1e-9), 0, 1).max(axis=1).sum()
    return float(total / len(x))


def fingerprint_text(digest: bytes) -> str:
    return base64.b64encode(digest).decode()


def fingerprint_texts(docs: DataFrame, ranks: np.ndarray, text: str = "text", fingerprint: str = "fingerprint") -> DataFrame:
    """Add the digest of each whole text (null: empty, with an empty digest), as base64. Equal texts have equal digests.
    Other columns and repeated rows stay; the new name must be free."""
    if fingerprint in docs.columns:
        raise ValueError(f"column {fingerprint} exists")
    schema = T.StructType([*docs.schema, T.StructField(fingerprint, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in pieces(batches, text, PIECE):
            found = [fingerprint_text(d) for d in digests(texts, ranks)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())], schema.names)

    return docs.mapInArrow(run, schema)


@F.pandas_udf(T.DoubleType())
def digest_likeness(a: pd.Series, b: pd.Series) -> pd.Series:
    """Likeness of two base64 digests."""
    return pd.Series([likeness(base64.b64decode(x or ""), base64.b64decode(y or "")) for x, y in zip(a, b)], dtype="float64")


def edited_fingerprints(docs: DataFrame, ranks: np.ndarray, key: str = "doc_id", text: str = "text") -> DataFrame:
    """For every text, in descending order of the key (nulls last, equal keys by text hash): its digest, that of the text
    whose last third of code points is replaced by as many from the beginning of the next text (the last text takes the
    first), and how alike its digest is to the edited and to the next one.

    Returns key, n_chars, edited (the edited text's SHA-256), fingerprint, edited_fingerprint, near_edited, near_next.
    Rows are range-partitioned by the order, so texts move once; the row that follows a range is sent to it as well."""
    ordered = docs.select(F.col(key).alias("_key"), F.xxhash64(text).alias("_hash"), F.coalesce(text, F.lit("")).alias("_text"))
    order = [F.col("_key").desc_nulls_last(), F.col("_hash")]
    spark = docs.sparkSession
    slim = ordered.select("_key", "_hash")
    n_ranges = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # Sampled cuts, at most 64 for each range; which rows are drawn only balances the ranges.
    sample = slim.orderBy(F.xxhash64("_key", "_hash", F.lit(3)), "_key", "_hash").limit(n_ranges * 64).orderBy(*order).collect()
    step = len(sample) / n_ranges
    cuts = list(dict.fromkeys((r._key, r._hash) for r in (sample[int(i * step)] for i in range(1, n_ranges)))) if sample else []
    key_type = slim.schema["_key"].dataType
    if cuts:
        kinds = T.ArrayType(T.StructType([T.StructField("k", key_type), T.StructField("h", T.LongType())]))
        table = F.from_json(F.lit(json.dumps([{"k": k, "h": h} for k, h in cuts], default=str)), kinds)

        def reached(cut: Column) -> Column:
            """The cut is at this row or before it: a larger key, or the same one (nulls come last) and a hash that is not larger."""
            larger = F.coalesce(cut["k"] > F.col("_key"), cut["k"].isNotNull() & F.col("_key").isNull())
            return larger | (cut["k"].eqNullSafe(F.col("_key")) & (cut["h"] <= F.col("_hash")))

        ranged = F.aggregate(F.lit([1 << i for i in reversed(range(len(cuts).bit_length()))]), F.lit(0),
                             lambda pos, w: F.when(F.coalesce(reached(F.get(table, pos + w - 1)), F.lit(False)), pos + w).otherwise(pos))
    else:
        ranged = F.lit(0)
    placed = ordered.withColumn("_range", ranged)
    # The head of each range: one row a range. An empty range passes the head of the next one on.
    # The largest key, and the least hash that it has: the complement of a hash falls as the hash grows.
    first = F.max(F.struct("_key", F.bitwise_not("_hash").alias("h")))
    heads = sorted(((r._range, r["head"]["_key"], ~r["head"]["h"]) for r in slim.withColumn("_range", ranged).groupBy("_range").agg(first.alias("head")).collect()),
                   key=lambda r: r[0])
    after = [(heads[i][0], *heads[(i + 1) % len(heads)][1:]) for i in range(len(heads))]
    kind = T.StructType([T.StructField("_to", T.IntegerType()), T.StructField("_k", key_type), T.StructField("_h", T.LongType())])
    follow = F.broadcast(spark.createDataFrame(after, kind))
    copies = placed.join(follow, F.col("_key").eqNullSafe(F.col("_k")) & (F.col("_hash") == F.col("_h"))) \
        .groupBy(F.col("_to").alias("_range"), "_key", "_hash").agg(F.first("_text").alias("_text")).withColumn("_copy", F.lit(1))
    every = placed.withColumn("_copy", F.lit(0)).unionByName(copies)
    parts = every.repartition(n_ranges, "_range").sortWithinPartitions("_range", "_copy", *order, "_text")
    schema = T.StructType([T.StructField(key, docs.schema[key].dataType), T.StructField("n_chars", T.LongType()),
                           T.StructField("edited", T.StringType()), T.StructField("fingerprint", T.StringType()),
                           T.StructField("edited_fingerprint", T.StringType()), T.StructField("near_edited", T.DoubleType()),
                           T.StructField("near_next", T.DoubleType())])
    columns = ("_range", "_copy", "_key", "_text")
    return parts.select(*columns).mapInArrow(lambda batches: _edited_rows(batches, ranks, schema), schema)


def _edited_rows(batches: Iterator[pa.RecordBatch], ranks: np.ndarray, schema: T.StructType) -> Iterator[pa.RecordBatch]:
    held = None  # the row before, with its digest: (range, key, text, digest)
    for batch, texts in pieces(batches, "_text", PIECE):
        found = digests(texts, ranks)
        rows = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), texts.to_pylist(), found))
        pairs = [(a, b) for a, b in zip([held, *rows[:-1]], rows) if a is not None and not a[1] and a[0] == b[0]]
        held = rows[-1]
        edited = []
        for a, b in pairs:
            cut = len(a[3]) // 3
            edited.append(a[3][:len(a[3]) - cut] + b[3][:cut])
        changed = []
        for _, part in pieces(iter([pa.RecordBatch.from_arrays([pa.array(edited, pa.large_string())], ["t"])]), "t", PIECE):
            changed += digests(part, ranks)
        yield pa.RecordBatch.from_arrays([
            pa.array([a[2] for a, _ in pairs], batch.schema.field(2).type),
            pa.array([len(a[3]) for a, _ in pairs], pa.int64()),
            pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited], pa.string()),
            pa.array([fingerprint_text(a[4]) for a, _ in pairs], pa.string()),
            pa.array([fingerprint_text(c) for c in changed], pa.string()),
            pa.array([likeness(a[4], c) for (a, _), c in zip(pairs, changed)], pa.float64()),
            pa.array([likeness(a[4], b[4]) for a, b in pairs], pa.float64())], schema.names)
