"""Exact Jaccard join of documents on their word shingles, as a join in a metric space.

Jaccard distance is a metric, and links are pairs within distance R. Space is cut in two ways:

1. Unrelated sets are all at distance 1, where pivots tell nothing apart. A set of which more shingles stand in no other
   set than a link allows is alone. Of the others, two linked sets share several of their first shingles in any fixed
   order (the prefix whose length follows from R; common shingles come last in ours); sets tied by such shingles, directly or through others, are a region.
2. In a region, pivots take the sets nearest to them. A set x that is at distance d(x, p) from its own pivot p can
   only be linked with sets of pivot q if d(x, q) <= d(x, p) + 2 R; it is replicated to those cells, and each cell is
   joined again in the same way until it fits one task. There, one set after the other is the pivot: a set whose
   distance to the pivot differs by more than R from another's is not linked with it, and sets already connected are not
   compared. Only links that connect something new come out, so no group emits its pairs.

Equal sets are one set from the beginning.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.llm.buffers import binary_values, byte_buffer, byte_words, cuts, mixed, pieces, small_batches
from tabulon.llm.components import components
from tabulon.session import cut_lineage

SHINGLE = 5
#: Links need PERCENT * |union| <= 100 * |intersection|.
PERCENT = 75
#: Prefixes are longer by one shingle for so many of the set, which lets weak ties between sets be dropped.
EXTRA = 8
#: Shingle hashes in one task's region, 8 bytes each; larger regions are cut by pivots.
REGION_SHINGLES = 4_000_000
#: Shingles of one bucket when lone ones are looked for, 4 bytes each.
BUCKET_SHINGLES = 3_000_000
#: Sets of one share when the counts of all buckets are added up.
PART_SETS = 20_000
#: Bytes of text whose shingles are worked out at once, and whose distinct shingles are sent together.
TEXT_BYTES = 500_000
SENT_BYTES = 4_000_000
PIVOTS = 16
FILTER_WORDS = 1 << 18
#: Slots in which common shingles are counted, before prefixes are taken.
MAX_SLOTS = 1 << 20

# Fixed value: words are parted by blanks and the control characters 9 to 13.
_member = np.ones(256, bool)
_member[[32, 9, 10, 11, 12, 13]] = False
_byte_values = mixed(np.where((np.arange(256) >= 65) & (np.arange(256) <= 90), np.arange(256) + 32, np.arange(256)).astype(np.uint64) + np.uint64(77))
_ODD = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(texts: pa.Array, words: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    return [s for at, end in cuts(texts, TEXT_BYTES) for s in _shingle_sets(texts.slice(at, end - at), words)]


def _shingle_sets(texts: pa.Array, words: int) -> list[np.ndarray]:
    data, starts = byte_buffer(texts)
    first, after, text = byte_words(data, starts, _member)
    if not len(first):
        return [np.zeros(0, np.uint64)] * len(texts)
    lens = after - first
    head = np.cumsum(lens) - lens
    total = int(lens.sum())
    inner = np.arange(total) - np.repeat(head, lens)
    powers = np.cumprod(np.full(int(lens.max()), _ODD, np.uint64))
    word = mixed(np.add.reduceat(_byte_values[data[inner + np.repeat(first, lens)]] * powers[inner], head))
    bounds = np.searchsorted(text, np.arange(len(texts) + 1))
    n = len(word)
    hashes = np.zeros(n, np.uint64)
    for i in range(min(words, n)):
        hashes[:n - i] = hashes[:n - i] * _ODD + mixed(word[i:] + np.uint64(i + 1))
    hashes = mixed(hashes)
    out = []
    for a, b in zip(bounds[:-1], bounds[1:]):
        if b - a >= words:
            out.append(np.unique(hashes[a:b - words + 1]))
        elif b > a:
            h = np.array([b - a], np.uint64)
            for i in range(a, b):
                h = mixed(h * _ODD + word[i:i + 1])
            out.append(h)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _node(hashes: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(hashes.tobytes(), digest_size=8).digest(), "little", signed=True)


def _sizes(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, n_shingles and node (a hash of the set; null for empty sets)."""
    schema = T.StructType([docs.schema[key], T.StructField("n_shingles", T.LongType()), T.StructField("node", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in pieces(batches, text):
            sets = shingle_sets(texts)
            yield pa.RecordBatch.from_arrays([
                batch.column(batch.schema.get_field_index(key)), pa.array([len(s) for s in sets], pa.int64()),
                pa.array([_node(s) if len(s) else None for s in sets], pa.int64())], schema.names)

    return docs.select(key, text).mapInArrow(run, schema)


def _lone_shingles(docs: DataFrame, text: str, buckets: int, parts: int) -> DataFrame:
    """(node, lone): how many shingles of each set are in no other set. Buckets send their counts packed, a row for each of
    `parts` shares of the sets, and a task adds up a share.

    Equal sets are one set, wherever their texts lie.

    A task sends, for each bucket of hashes and piece of texts, the piece's distinct shingles once: 32 bits of the hash and
    the set, or no set if several sets of the piece have it. So a shingle of all documents is one entry a piece, not one
    a document. Two shingles with the same 32 bits in a bucket only make a set seem less alone than it is."""
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in pieces(batches, text, SENT_BYTES):
            sets = {_node(s): s for s in shingle_sets(texts) if len(s)}
            if not sets:
                continue
            nodes = np.array(list(sets), np.int64)
            flat = np.concatenate(list(sets.values()))
            owner = np.repeat(np.arange(1, len(nodes) + 1, dtype=np.int32), [len(s) for s in sets.values()])
            order = np.argsort(flat, kind="stable")
            flat, owner = flat[order], owner[order]
            head = np.flatnonzero(np.concatenate(([True], flat[1:] != flat[:-1])))
            many = np.diff(np.concatenate((head, [len(flat)]))) > 1
            flat, owner = flat[head], np.where(many, 0, owner[head])
            bucket = ((flat >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
            order = np.lexsort((owner, bucket))
            bucket, flat, owner = bucket[order], flat[order], owner[order]
            out = [[], [], [], []]
            ends = np.concatenate((np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))), [len(bucket)]))
            for a, b in zip(ends[:-1], ends[1:]):
                own, count = np.unique(owner[a:b], return_counts=True)
                out[0].append(int(bucket[a]))
                out[1].append(np.where(own > 0, nodes[own - 1], 0).tobytes())
                out[2].append((count * np.where(own > 0, 1, -1)).astype("<i4").tobytes())
                out[3].append((flat[a:b] & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), *[pa.array(o, pa.binary()) for o in out[1:]]], ["bucket", "nodes", "counts", "hashes"])

    def count(table: pa.Table) -> pa.Table:
        # The part without a set comes first in a piece, with a negative count: its hashes are shared already.
        nodes, counts, hashes = (binary_values(table.column(c), kind) for c, kind in (("nodes", "<i8"), ("counts", "<i4"), ("hashes", "<u4")))
        order = np.argsort(hashes, kind="stable")
        ranked, whose = hashes[order], np.repeat(nodes, np.abs(counts))[order]
        head = np.ones(len(ranked), bool)
        head[1:] = ranked[1:] != ranked[:-1]
        # Copies of one set in several pieces are no other set: a hash counts once for the only set that has it.
        other = np.concatenate(([False], ~head[1:] & (whose[1:] != whose[:-1]))) | np.repeat(counts < 0, np.abs(counts))[order]
        starts = np.flatnonzero(head)
        lone = np.zeros(len(ranked), bool)
        lone[order[starts]] = ~np.logical_or.reduceat(other, starts) if len(starts) else False
        sums = np.add.reduceat(lone, np.cumsum(np.abs(counts)) - np.abs(counts))
        keep = (counts > 0) & (sums > 0)
        nodes, sums = nodes[keep], sums[keep].astype("<i4")
        part = (nodes.view(np.uint64) % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        part, nodes, sums = part[order], nodes[order], sums[order]
        ends = np.concatenate((np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1]))), [len(part)])) if len(part) else np.zeros(1, np.int64)
        cut = [slice(a, b) for a, b in zip(ends[:-1], ends[1:])]
        return pa.table({"part": pa.array(part[ends[:-1]], pa.int64()), "nodes": pa.array([nodes[c].tobytes() for c in cut], pa.binary()),
                         "lones": pa.array([sums[c].tobytes() for c in cut], pa.binary())})

    def add(table: pa.Table) -> pa.Table:
        node, place = np.unique(binary_values(table.column("nodes"), "<i8"), return_inverse=True)
        lone = np.bincount(place, weights=binary_values(table.column("lones"), "<i4"))
        return pa.table({"node": pa.array(node), "lone": pa.array(lone.astype(np.int64))})

    sent = docs.select(text).mapInArrow(send, "bucket int, nodes binary, counts binary, hashes binary")
    found = sent.groupBy("bucket").applyInArrow(count, "part long, nodes binary, lones binary")
    return found.groupBy("part").applyInArrow(add, "node long, lone long")


def _sets_of(docs: DataFrame, key: str, text: str, wanted: DataFrame) -> DataFrame:
    """(node, set) of the wanted (key, node). A bitmap of the wanted keys' hashes, of fixed size, keeps most
    other texts out of the shuffle."""
    place = F.pmod(F.xxhash64(F.col(key), F.lit(5)), F.lit(FILTER_WORDS * 64))
    words = wanted.select(place.alias("p")).groupBy(F.floor(F.col("p") / 64).cast("int").alias("w")) \
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(pmod(p, 64) as int))")).alias("bits")).collect()
    bitmap = np.zeros(FILTER_WORDS, np.int64)
    for r in words:
        bitmap[r.w] = r.bits
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = batch.column(2).to_numpy(zero_copy_only=False)
            hit = (shared.value[p // 64].view(np.uint64) >> (p % 64).astype(np.uint64)) & np.uint64(1)
            yield batch.filter(pa.array(hit.astype(bool)))

    found = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"), place.alias("_p"))
    found = found.mapInArrow(keep, found.schema).drop("_p")
    joined = found.join(wanted.withColumnRenamed(key, "_want"), F.col("_key").eqNullSafe(F.col("_want")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in pieces(batches, "_text"):
            sets = shingle_sets(texts)
            node = batch.column(batch.schema.get_field_index("node"))
            # Rows that share a key with a wanted one but not its set are not asked for.
            mine = np.array([len(s) > 0 and _node(s) == n for s, n in zip(sets, node.to_pylist())], bool)
            own = [s for s, m in zip(sets, mine) if m]
            ends = np.concatenate(([0], np.cumsum([len(s) for s in own]))).astype(np.int32)
            flat = np.concatenate(own).view(np.int64) if own else np.zeros(0, np.int64)
            keep = pa.array(mine)
            yield pa.RecordBatch.from_arrays([node.filter(keep), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], ["node", "set"])

    return joined.mapInArrow(run, "node long, set array<long>")


class _Joined:
    """Union-find over the sets of one task."""

    def __init__(self, n: int) -> None:
        self.up = np.arange(n)

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i


def join_sets(nodes: np.ndarray, ends: np.ndarray, flat: np.ndarray, percent: int = PERCENT) -> list[tuple[int, int]]:
    """Links that connect the sets as all links do: at most one fewer than there are sets.

    Each set in turn is the pivot. It is compared with the sets that have one of its rarest shingles, are not yet connected
    with it, whose sizes allow a link, and whose distances to earlier pivots, kept for the last few, differ from its own by no more than R."""
    n = len(nodes)
    sizes = np.diff(ends)
    order = np.argsort(-sizes, kind="stable")
    values, codes, held = np.unique(flat, return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(n), sizes)
    by_value = np.argsort(codes, kind="stable")
    value_ends = np.concatenate(([0], np.cumsum(held)))
    posting = owner[by_value]
    # The rarest shingles of each set, one more than a link allows to be missing: a set that has none of them is not linked.
    first = np.lexsort((codes, held[codes], owner))
    place = np.arange(len(flat)) - np.repeat(ends[:-1], sizes)
    probe = first[(place < np.repeat(sizes - -(-percent * sizes // 100) + 1, sizes)) & (held[codes[first]] > 1)]
    probes, probe_ends = codes[probe], np.searchsorted(owner[probe], np.arange(n + 1))
    joined = _Joined(n)
    label = np.arange(n)
    radius = 1 - percent / 100 + 1e-9
    kept: list[np.ndarray] = []
    links = []
    for p in order:
        if probe_ends[p] == probe_ends[p + 1]:
            continue
        near = np.unique(np.concatenate([posting[value_ends[c]:value_ends[c + 1]] for c in probes[probe_ends[p]:probe_ends[p + 1]]]))
        near = near[(label[near] != label[p]) & (100 * np.minimum(sizes[near], sizes[p]) >= percent * np.maximum(sizes[near], sizes[p]))]
        for far in kept:
            near = near[np.abs(far[near] - far[p]) <= radius]
        if not len(near):
            continue
        own = codes[ends[p]:ends[p + 1]]
        shared = np.bincount(np.concatenate([posting[value_ends[c]:value_ends[c + 1]] for c in own]), minlength=n)
        union = sizes + sizes[p] - shared
        kept = [*kept[-7:], 1 - shared / union]
        before = len(links)
        for i in near[100 * shared[near] >= percent * union[near]]:
            a, b = joined.root(p), joined.root(i)
            if a != b:
                joined.up[max(a, b)] = min(a, b)
                links.append((int(nodes[p]), int(nodes[i])))
        if len(links) > before:
            label = joined.up.copy()
            while True:
                deeper = label[label]
                if (deeper == label).all():
                    break
                label = deeper
            joined.up = label.copy()
    return links


def _cell_links(table: pa.Table) -> pa.Table:
    sets = table.column("set").combine_chunks()
    if isinstance(sets, pa.ChunkedArray):
        sets = pa.concat_arrays(sets.chunks)
    ends = np.asarray(sets.offsets, np.int64)
    flat = np.asarray(sets.values)[ends[0]:ends[-1]]
    nodes = table.column("node").to_numpy()
    # The order of arrival must not matter.
    links = join_sets(nodes, ends - ends[0], flat)
    return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})


class _Pivots:
    """The pivots of a region; distances of many sets to all of them at once."""

    def __init__(self, nodes: list[int], sets: list[np.ndarray]) -> None:
        self.nodes, self.sizes = np.array(nodes, np.int64), np.array([len(s) for s in sets])
        self.values, codes = np.unique(np.concatenate(sets), return_inverse=True)
        self.has = np.zeros((len(self.values), len(sets)), np.int32)
        self.has[codes, np.repeat(np.arange(len(sets)), self.sizes)] = 1

    def distances(self, flat: np.ndarray, ends: np.ndarray, rows: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.values, flat), len(self.values) - 1)
        hit = np.flatnonzero(self.values[at] == flat)
        shared = np.zeros((len(ends) - 1, len(self.nodes)), np.int64)
        np.add.at(shared, np.searchsorted(ends, hit, side="right") - 1, self.has[at[hit]])
        return 1 - shared[rows] / (np.diff(ends)[rows, None] + self.sizes - shared[rows])


def region_links(sets: DataFrame, limit: int = REGION_SHINGLES) -> DataFrame:
    """Links (a, b) between the sets (region, node, set) of each region. Regions of more than `limit` shingles are cut
    into the cells of up to PIVOTS pivots, again and again; a cell that pivots no longer shrink is joined in pairs of
    blocks."""
    spark = sets.sparkSession
    sets = cut_lineage(sets)
    done = []
    for round_ in range(64):
        sizes = sets.groupBy("region").agg(F.sum(F.size("set")).alias("shingles"), F.count(F.lit(1)).alias("n"))
        large = cut_lineage(sizes.filter((F.col("shingles") > limit) & (F.col("n") > 2)))
        if large.isEmpty():
            done.append(sets.groupBy("region").applyInArrow(_cell_links, "a long, b long"))
            break
        small = sets.join(large, "region", "left_anti")
        done.append(cut_lineage(small.groupBy("region").applyInArrow(_cell_links, "a long, b long")))
        big = sets.join(large, "region")
        cells, found, stuck = _voronoi(big, round_)
        done += [found]
        done.append(_block_links(big.join(stuck, "region", "left_semi"), limit))
        sets = cells
    out = done[0]
    for d in done[1:]:
        out = out.union(d)
    return cut_lineage(out)


def _voronoi(big: DataFrame, round_: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The cells of each large region, links with pivots, and regions that a cut does not shrink to two thirds."""
    drawn = big.select("region", "node", "set", F.xxhash64("node", F.lit(round_)).alias("h"))
    # The PIVOTS smallest hashes of each region: each map task keeps as many, so no region is gathered.
    parts = drawn.select("region", F.pmod("h", F.lit(PIVOTS)).alias("slot"), "h", "node", "set") \
        .groupBy("region", "slot").agg(F.min_by(F.struct("node", "set"), F.struct("h", "node")).alias("pivot"))
    pivots = parts.groupBy("region").agg(F.array_sort(F.collect_list("pivot")).alias("pivots"))
    # A large region has REGION_SHINGLES or more, so its PIVOTS sets are a small part of them; every task holds them.
    shared = big.sparkSession.sparkContext.broadcast({r.region: _Pivots([p.node for p in r.pivots], [np.array(p.set, np.int64) for p in r.pivots])
                                                      for r in pivots.collect()})
    radius = 1 - PERCENT / 100

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            regions, nodes, sets = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2)
            ends = np.asarray(sets.offsets, np.int64)
            flat, ends = np.asarray(sets.values)[ends[0]:ends[-1]], ends - ends[0]
            rows, cells, links = [], [], []
            for region in np.unique(regions):
                own, pivots = np.flatnonzero(regions == region), shared.value[region]
                far = pivots.distances(flat, ends, own)
                row, cell = np.nonzero(far <= far.min(axis=1)[:, None] + 2 * radius + 1e-9)
                rows.append(own[row])
                cells.append(cell)
                links.append(np.where(far[row, cell] <= radius + 1e-9, pivots.nodes[cell], nodes[own[row]]))
            if not rows:
                continue
            rows, cells, links = (np.concatenate(x) for x in (rows, cells, links))
            for a in range(0, len(rows), 4096):
                at = pa.array(rows[a:a + 4096])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), sets.take(at), pa.array(cells[a:a + 4096].astype(np.int32)),
                                                  pa.array(links[a:a + 4096])], ["region", "node", "set", "cell", "pivot"])

    dealt = cut_lineage(big.select("region", "node", "set").mapInArrow(
        run, "region long, node long, set array<long>, cell int, pivot long"))
    size = dealt.groupBy("region", "cell").agg(F.count(F.lit(1)).alias("m")).groupBy("region").agg(F.max("m").alias("m"))
    whole = dealt.groupBy("region").agg(F.countDistinct("node").alias("n"))
    stuck = cut_lineage(size.join(whole, "region").filter(3 * F.col("m") > 2 * F.col("n")).select("region"))
    links = dealt.filter("pivot <> node").select(F.col("node").alias("a"), F.col("pivot").alias("b"))
    cells = dealt.join(stuck, "region", "left_anti").select(F.xxhash64("region", "cell", F.lit(round_)).alias("region"), "node", "set")
    return cut_lineage(cells), cut_lineage(links), stuck


def _block_links(sets: DataFrame, limit: int) -> DataFrame:
    """Links of regions in which all sets are near each other: blocks of sets, each pair of blocks in one task."""
    sizes = sets.groupBy("region").agg(F.sum(F.size("set")).alias("s")).withColumn("blocks", F.ceil(2 * F.col("s") / limit).cast("int") + 1)
    placed = sets.join(sizes, "region").withColumn("block", F.pmod(F.xxhash64("node", F.lit(9)), F.col("blocks")).cast("int"))
    every = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pair = F.struct(F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"))
    return cut_lineage(every.select("region", pair.alias("pair"), "node", "set").groupBy("region", "pair").applyInArrow(_cell_links, "a long, b long"))


def _allowed_column(n: str) -> Column:
    return F.col(n) - F.floor((PERCENT * F.col(n) + 99) / 100)


def _required(n: str) -> Column:
    """Shared shingles that a link's two prefixes have at least, for the smaller of the two numbers."""
    return 1 + F.floor(F.col(n) / EXTRA)


def _levels(sets: DataFrame, shingles: int) -> np.ndarray:
    """For each slot of shingle hashes 0, or a level that grows with how many more shingles of the sets fall into it than into
    the others: where common shingles are. At most MAX_SLOTS numbers, whatever the table."""
    slots = min(MAX_SLOTS, max(1 << 10, 1 << int(shingles // 64).bit_length()))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(slots, np.int64)
        for batch in batches:
            column = batch.column(0)
            total += np.bincount(_slot(np.asarray(column.values)[column.offsets[0].as_py():column.offsets[-1].as_py()], slots), minlength=slots)
        cut = [c.astype("<i8") for c in total.reshape(-1, 1 << 10)]
        held = [i for i, c in enumerate(cut) if c.any()]
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array([cut[i].tobytes() for i in held], pa.binary())], ["part", "counts"])

    def add(table: pa.Table) -> pa.Table:
        total = binary_values(table.column("counts"), "<i8").reshape(-1, 1 << 10).sum(axis=0)
        usual = shingles / slots
        over = (total - usual) / (8 + 6 * usual ** 0.5)
        at = np.flatnonzero(over > 1)
        return pa.table({"slot": pa.array(at + (table.column("part")[0].as_py() << 10), pa.int64()), "level": pa.array(1 + (2 * np.log2(over[at])).astype(np.int64))})

    out = np.zeros(slots, np.int16)
    found = sets.select("set").mapInArrow(send, "part int, counts binary").groupBy("part").applyInArrow(add, "slot long, level long").toArrow()
    out[found.column("slot").to_numpy()] = found.column("level").to_numpy()
    return out


def _slot(hashes: np.ndarray, slots: int) -> np.ndarray:
    return ((hashes.view(np.uint64) >> np.uint64(20)) & np.uint64(slots - 1)).astype(np.int64)


def _first_shingles(sets: DataFrame, levels: np.ndarray) -> DataFrame:
    """(shingle, node, n) of the prefixes, for shingles in more than one of them. Linked sets share, in their first
    allowed + required shingles in any one order, at least the smaller required number. Here common shingles come last, the
    others by hash: prefixes of shingles that many unrelated sets have would tie those into one region."""
    shared = sets.sparkSession.sparkContext.broadcast(levels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = shared.value
        for batch in batches:
            column = batch.column(1)
            ends = np.asarray(column.offsets, np.int64)
            flat = np.asarray(column.values)[ends[0]:ends[-1]]
            n = np.diff(ends)
            owner = np.repeat(np.arange(len(n)), n)
            # Sets are sorted by hash, and few shingles are common: the keys are nearly in order.
            order = np.argsort(owner * (int(levels.max()) + 1) + levels[_slot(flat, len(levels))], kind="stable")
            first = np.arange(len(flat)) - np.repeat(ends[:-1] - ends[0], n) < np.repeat(n - (PERCENT * n + 99) // 100 + 1 + n // EXTRA, n)
            flat, owner = flat[order][first], owner[order][first]
            nodes = batch.column(0).to_numpy()
            for a in range(0, len(flat), 100_000):
                o = owner[a:a + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(nodes[o]), pa.array(n[o]), pa.array(flat[a:a + 100_000])], ["node", "n", "shingle"])

    entries = sets.select("node", "set").mapInArrow(run, "node long, n long, shingle long")
    common = entries.groupBy("shingle").agg(F.count(F.lit(1)).alias("m")).filter("m > 1").select("shingle")
    return cut_lineage(entries.join(common, "shingle"))


def _star_links(members: DataFrame) -> DataFrame:
    """Links (a, b) from each set to the least set that shares a first shingle, but for weak ones.

    Each set drops its weakest links as long as they stand for less than 0.4 * required - 0.5 shingles together. Two
    linked sets drop fewer than the required number between them, so of the shingles that they share one keeps both its
    links, and they stay in one region."""
    heads = members.groupBy("shingle").agg(F.min("node").alias("head"))
    stars = members.join(heads, "shingle").groupBy("node", "n", "head").agg(F.count(F.lit(1)).alias("weight")).filter("node <> head")
    lightest = Window.partitionBy("node").orderBy("weight", "head").rowsBetween(Window.unboundedPreceding, 0)
    return stars.withColumn("dropped", F.sum("weight").over(lightest)) \
        .filter(F.col("dropped") >= 0.4 * _required("n") - 0.5).select(F.col("node").alias("a"), F.col("head").alias("b"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_shingles, component_id): the size of each document's shingle set and the least key that it reaches by links.

    Words are parted by blanks and control characters 9 to 13, A-Z in lower case; texts with fewer words than a shingle
    are one shingle; null, empty and wordless texts have none, link with nothing and are their own component. Equal
    texts link. Repeated keys each give a row; a null key is never a component's name unless it has no other. Other
    columns are left out. An empty table gives an empty table."""
    small_batches(docs.sparkSession)
    slim = cut_lineage(_sizes(docs, key, text))
    total, rows = slim.agg(F.coalesce(F.sum("n_shingles"), F.lit(0)), F.count("node")).first()
    lone = _lone_shingles(docs, text, 1 + total // BUCKET_SHINGLES, 1 + rows // PART_SETS)
    sets = slim.filter("node is not null").groupBy("node").agg(F.min(key).alias(key), F.max("n_shingles").alias("n"))
    wanted = cut_lineage(sets.join(lone, "node", "left").filter(F.coalesce("lone", F.lit(0)) <= _allowed_column("n")).select("node", key, "n"))
    found = cut_lineage(_sets_of(docs, key, text, wanted.select("node", key)))
    members = _first_shingles(found, _levels(found, found.agg(F.coalesce(F.sum(F.size("set")), F.lit(0))).first()[0]))
    regions = cut_lineage(components(_star_links(members)))
    links = region_links(found.join(regions.select("node", F.col("root").alias("region")), "node"))
    roots = components(links)
    named = cut_lineage(slim.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
    names = named.groupBy("root").agg(F.min(key).alias("least"))
    return named.join(names.filter("root is not null"), "root", "left").select(
        key, "n_shingles", F.when(F.col("root").isNull(), F.col(key)).otherwise(F.col("least")).alias("component_id"))
