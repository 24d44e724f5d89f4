"""SimHash fingerprints of whole texts, and the groups of fingerprints that differ by a few bits.

Fingerprints are looked up by their Hamming distances to fixed reference fingerprints, never by comparing all of them:

1. Fingerprints within RADIUS bits agree in one of RADIUS + 1 blocks of bits, and so have, inside that block, the same
   distance to every reference. The table of these block distances is the key under which fingerprints meet. Keys that too
   many share are split in the same way by the bits that are left, until every group is small.
2. In a group, the table of distances to the references over all bits is worked out once. By the triangle inequality two
   fingerprints within RADIUS bits have distances to each reference that differ by RADIUS at most. The group stands in the
   order of the first distance, which ends each search; the other columns discard pairs by their largest difference.
3. Survivors are compared bit by bit. A task sends one link for each fingerprint that it connects with a smaller one, so
   no group emits its pairs, and components of the links are the result. Equal fingerprints are one from the beginning.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.llm.buffers import mixed, pieces
from tabulon.llm.components import components
from tabulon.session import cut_lineage

WORDS = 3
SEED = 42
RADIUS = 3
#: Reference fingerprints. Sixteen distances inside a block tell nearly all of its values apart.
REFERENCES = 16
#: Fingerprints under one key, above which it is split; and bits below which no block is left to split by.
GROUP = 4096
LEAST_BITS = 12
#: Rows of one task's part, whatever their keys.
ROWS_PER_TASK = 200_000
#: Shingles hashed, and pairs kept, at a time.
HASHED = 1 << 16
#: Bytes of text fingerprinted at once.
PIECE = 1_000_000
HELD_PAIRS = 1 << 20

_references = mixed(np.arange(1, REFERENCES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def fingerprint(text: bytes, words: int = WORDS) -> int:
    """Bit i is 1 if it is set in over half of the XXH64 hashes of the text's word shingles, repeats included.

    Words are parted by blanks and control characters 9 to 13; A-Z count as a-z. A text of fewer words than a shingle
    is one shingle, a text without words has the fingerprint 0."""
    found = text.lower().split()
    if not found:
        return 0
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    begins = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(found) - words + 1)
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, n, HASHED):
        some = min(HASHED, n - at)
        stops = ends[at + min(words, len(found)) - 1:][:some].tolist()
        hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(begins[at:at + some].tolist(), stops)), np.uint64, some)
        ones += np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(some, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, bits): the fingerprint of each text as a signed long. A null text is an empty one."""
    schema = T.StructType([T.StructField("key", docs.schema[key].dataType), T.StructField("bits", T.LongType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in pieces(batches, limit=PIECE):
            bits = np.array([fingerprint(t) for t in texts.cast(pa.large_binary()).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bits.view(np.int64))], schema.names)

    return docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("string").alias("text")).mapInArrow(run, schema)


def _blocks(fixed: int) -> list[int]:
    """RADIUS + 1 masks that share out the bits outside `fixed`."""
    free = [1 << i for i in range(64) if not fixed >> i & 1]
    return [sum(free[i * len(free) // (RADIUS + 1):(i + 1) * len(free) // (RADIUS + 1)]) for i in range(RADIUS + 1)]


def distance_table(bits: np.ndarray, mask: int = (1 << 64) - 1) -> np.ndarray:
    """Distances of each fingerprint to each reference, over the bits of the mask."""
    return np.bitwise_count((bits[:, None] ^ _references[None, :]) & np.uint64(mask))


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row (bits, fixed, key) once for each block of its free bits, with a key that holds the block's distances."""
    weight = np.cumprod(np.full(REFERENCES, 0x9E3779B97F4A7C15, np.uint64))
    for batch in batches:
        bits, fixed, key = (batch.column(i).to_numpy().view(np.uint64) for i in range(3))
        for done in np.unique(fixed):
            own = fixed == done
            for block in _blocks(int(done)):
                table = mixed(distance_table(bits[own], block).astype(np.uint64) + np.uint64(1)) * weight
                now = mixed(key[own] ^ mixed(table.sum(axis=1, dtype=np.uint64) + np.uint64(block)))
                with_block = np.full(len(now), int(done) | block, np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (bits[own], with_block, now)], ["bits", "fixed", "key"])


def pivot_links(bits: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (x, least fingerprint that x reaches in this task) over fingerprints of the same key."""
    table = distance_table(bits)
    order = np.lexsort((bits, table[:, 0], key))
    bits, key, table = bits[order], key[order], table[order].astype(np.int8)
    names, node = np.unique(bits, return_inverse=True)
    label = np.arange(len(names))
    at, held, pairs = np.arange(len(bits)), [], 0
    step = 0
    while True:
        step += 1
        at = at[at < len(bits) - step]
        # Rows whose window has ended meet nothing further on either.
        at = at[(key[at] == key[at + step]) & (table[at + step, 0] - table[at, 0] <= RADIUS)]
        if not len(at):
            break
        left = at
        for column in range(1, REFERENCES):
            left = left[np.abs(table[left + step, column] - table[left, column]) <= RADIUS]
        left = left[np.bitwise_count(bits[left] ^ bits[left + step]) <= RADIUS]
        a, b = node[left], node[left + step]
        apart = label[a] != label[b]
        held.append((a[apart], b[apart]))
        pairs += int(apart.sum())
        if pairs > HELD_PAIRS:
            label, held, pairs = _joined(label, held), [], 0
    label = _joined(label, held)
    linked = np.flatnonzero(label != np.arange(len(label)))
    return names[linked], names[label[linked]]


def _joined(label: np.ndarray, pairs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Labels after the pairs are connected: the least node that each one reaches."""
    if not pairs:
        return label
    a, b = (np.concatenate(x) for x in zip(*pairs))
    while True:
        low, high = np.minimum(label[a], label[b]), np.maximum(label[a], label[b])
        apart = low != high
        if not apart.any():
            return label
        a, b = a[apart], b[apart]
        np.minimum.at(label, high[apart], low[apart])
        while (deeper := label[label]).tobytes() != label.tobytes():
            label = deeper


def _part_links(table: pa.Table) -> pa.Table:
    a, b = pivot_links(table.column("bits").to_numpy().view(np.uint64), table.column("key").to_numpy())
    return pa.table({"a": pa.array(a.view(np.int64)), "b": pa.array(b.view(np.int64))})


def hamming_links(prints: DataFrame) -> DataFrame:
    """Links (a, b) that connect the distinct fingerprints `bits` as all pairs within RADIUS bits do."""
    free, found = 64, None
    rows = prints.select("bits", F.lit(0).cast("long").alias("fixed"), F.lit(0).cast("long").alias("key"))
    while True:
        keyed = cut_lineage(rows.mapInArrow(_keyed, "bits long, fixed long, key long"))
        free -= free // (RADIUS + 1)
        large = None
        if free >= LEAST_BITS:
            large = cut_lineage(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > GROUP).select("key"))
            large = None if large.isEmpty() else large
        small = keyed if large is None else keyed.join(large, "key", "left_anti")
        parts = 1 + keyed.count() // ROWS_PER_TASK
        links = small.select("bits", "key", F.expr(f"pmod(xxhash64(key), {parts})").alias("part")) \
            .groupBy("part").applyInArrow(_part_links, "a long, b long")
        links = cut_lineage(links)
        found = links if found is None else found.union(links)
        if large is None:
            return found
        rows = keyed.join(large, "key", "left_semi").select("bits", "fixed", "key")


def simhash_groups(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fingerprint as 16 hexadecimal digits, component_id): the least key that a document reaches by links.

    Fingerprints that differ by RADIUS bits or fewer link. Texts without words, null ones among them, have the fingerprint
    0, which links like any other. Repeated keys each give a row; a null key is never a component's name unless it has no
    other. Other columns are left out; an empty table gives an empty table."""
    rows = cut_lineage(fingerprints(docs, key, text))
    # A text with a third of all rows is one fingerprint from each task.
    prints = cut_lineage(rows.groupBy("bits").agg(F.min("key").alias("least")))
    roots = components(hamming_links(prints.select("bits")))
    named = prints.join(roots.withColumnRenamed("node", "bits"), "bits", "left").withColumn("root", F.coalesce("root", "bits"))
    named = cut_lineage(named)
    least = cut_lineage(named.groupBy("root").agg(F.min("least").alias("component_id")))
    names = cut_lineage(named.select("bits", "root").join(least, "root").select("bits", "component_id"))
    return rows.join(names, "bits").select(F.col("key").alias(key), F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id")
