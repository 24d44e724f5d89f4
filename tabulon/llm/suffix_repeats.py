"""Repeated byte strings across texts, by refining suffix buckets.

Suffixes are sorted only as far as needed, and first only at anchors: the anchor of a string of LENGTH bytes is its least
Q-gram by a hash, so equal strings have equal anchors, whatever stands around them, and many neighbouring strings share one.

- Initial buckets: anchors with the same Q-gram. The strings of an anchor that is alone in its bucket are not repeated.
- Refinement: the identifier of a suffix for twice the depth is made of its own identifier and that of the suffix one
  depth later, recursively up to LENGTH, so deeper buckets reuse the shallower ones. Neighbouring strings with the same
  anchor are one run; the run as a whole (its first to its last byte) gets the identifier of that depth. Runs that share
  one are repeated throughout.
- Only runs alone in their bucket, but beside others at the same anchor Q-gram, are refined string by string, together
  with one run of each larger bucket there.

Spark groups identifiers and drops buckets of one. Identifiers have 64 bits and are only compared inside one Q-gram's
bucket, whose identifier is another 64.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.llm.buffers import byte_buffer, mixed, pieces
from tabulon.session import cut_lineage, shared_path, shuffle_width

LENGTH = 200
Q = 48
FILTER_WORDS = 1 << 18
#: Runs of one Q-gram that meet in one task, some 300 bytes each. Beyond that the strings are counted one by one.
GROUP_RUNS = 10_000
#: Runs that the Q-grams of one task bring together on average.
TASK_RUNS = 5_000
PIECE = 2_000_000
_SEED = np.uint64(0x9E3779B97F4A7C15)


def _pair(a: np.ndarray, b: np.ndarray, salt: int) -> np.ndarray:
    """The identifier of a longer suffix from those of two shorter ones."""
    return mixed(a * _SEED + (b ^ np.uint64(0xD1B54A32D192ED03 + salt)))


class Identifiers:
    """Identifiers of all suffixes of one buffer at depths 16, 32, 48, 64, 128, each worked out once from lower ones."""

    def __init__(self, data: np.ndarray, salt: int = 0) -> None:
        self.n, self.salt = len(data), salt
        padded = np.concatenate((data, np.zeros(512, np.uint8))).astype(np.uint64)
        for shift in (1, 2, 4):
            padded = padded[:-shift] | (padded[shift:] << np.uint64(8 * shift))
        self.levels = {8: padded}

    def at(self, depth: int) -> np.ndarray:
        if depth not in self.levels:
            half = {48: 32}.get(depth, depth // 2)
            low, high = self.at(half), self.at(depth - half)
            m = min(len(low), len(high) - half)
            self.levels[depth] = _pair(low[:m], high[half:half + m], self.salt)
        return self.levels[depth]

    def strings(self, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Identifiers of strings of 128 to 512 bytes: two suffixes of 128 or 256 that cover the string, and its length."""
        deep, wide = self.at(128), self.at(256)
        long = length > 256
        out = _pair(deep[begin], deep[np.maximum(begin + length - 128, 0)], self.salt)
        if long.any():
            out[long] = _pair(wide[begin[long]], wide[begin[long] + length[long] - 256], self.salt)
        return _pair(out, length.astype(np.uint64), self.salt)


def _sliding(values: np.ndarray, window: int, pick) -> np.ndarray:
    """pick over every `window` neighbours, by doubling."""
    out, d = values, 1
    while 2 * d <= window:
        out = pick(out[:-d], out[d:])
        d *= 2
    rest = window - d
    return pick(out[:len(out) - rest], out[rest:]) if rest else out


def _runs(data: np.ndarray, starts: np.ndarray, length: int, q: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The strings of `length` bytes inside the texts, in runs that have the same anchor: first and last begin of each
    run, and the Q-gram identifier of its anchor. The anchor of a string is its least Q-gram, the leftmost of equals, so
    equal strings have equal anchors at equal places."""
    n = len(data)
    none = (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),)
    room = starts[1:] - starts[:-1] >= length
    if not room.any():
        return none
    grams = Identifiers(data).at(q)[:n - q + 1]
    # 32 bits of the identifier, then the place.
    placed = ((grams >> np.uint64(32)) << np.uint64(32)) | np.arange(len(grams), dtype=np.uint64)
    anchor = (_sliding(placed, length - q + 1, np.minimum) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, starts[:-1][room], 1)
    np.add.at(edge, starts[1:][room] - length + 1, -1)
    begin = np.flatnonzero(np.cumsum(edge)[:n - length + 1] > 0)
    own = anchor[begin]
    head = np.concatenate(([True], (own[1:] != own[:-1]) | (begin[1:] != begin[:-1] + 1)))
    heads = np.flatnonzero(head)
    return begin[heads], begin[np.concatenate((heads[1:] - 1, [len(begin) - 1]))], grams[own[heads]]


def _scan(docs: DataFrame, length: int, q: int) -> DataFrame:
    """(uid, gram) once for each text and distinct anchor Q-gram, `many` if the text has it more than once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in pieces(batches, "_text", PIECE):
            data, starts = byte_buffer(texts)
            at, _, grams = _runs(data, starts, length, q)
            text = np.searchsorted(starts, at, "right") - 1
            order = np.lexsort((grams, text))
            text, grams = text[order], grams[order]
            fresh = np.ones(len(text), bool)
            fresh[1:] = (text[1:] != text[:-1]) | (grams[1:] != grams[:-1])
            heads = np.flatnonzero(fresh)
            uid = batch.column(0).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array(uid[text[heads]]), pa.array(grams[heads].view(np.int64)),
                                              pa.array(np.diff(np.concatenate((heads, [len(text)]))) > 1)], ["uid", "gram", "many"])

    return docs.select("_uid", "_text").mapInArrow(run, "uid long, gram long, many boolean")


def _bucketed(df: DataFrame, key: str) -> DataFrame:
    """The frame as a table in the shared folder, bucketed by the key, so that later joins on it leave its rows in place.
    The catalog forgets the table at once; the frame that is returned goes on reading its files."""
    spark = df.sparkSession
    name = f"tabulon_{uuid.uuid4().hex}"
    df.write.bucketBy(shuffle_width(spark), key).option("path", shared_path(spark, "bucketed")).format("parquet").saveAsTable(name)
    found = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return found


def _near_texts(docs: DataFrame, flagged: DataFrame) -> DataFrame:
    """The texts of the flagged uids, with their bucketed Q-grams. A bitmap of fixed size keeps most other texts out of
    the shuffle; the join makes it exact."""
    place = F.pmod(F.xxhash64(F.col("uid"), F.lit(5)), F.lit(FILTER_WORDS * 64))
    words = flagged.select(place.alias("p")).groupBy(F.floor(F.col("p") / 64).cast("int").alias("w")) \
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

    found = docs.select(F.col("_uid").alias("uid"), F.col("_text").alias("text")).withColumn("p", place)
    return found.mapInArrow(keep, found.schema).drop("p").dropDuplicates(["uid"]).join(flagged, "uid")


def _shared_runs(data: np.ndarray, grams: list[int], length: int, q: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The runs of one text whose anchors are in buckets of more than one."""
    first, last, own = _runs(data, np.array([0, len(data)]), length, q)
    shared = np.isin(own, np.array(grams, np.int64).view(np.uint64))
    return first[shared], last[shared], own[shared]


def _run_rows(near: DataFrame, length: int, q: int) -> DataFrame:
    """(uid, first, gram, whole): the identifier of each run as a whole."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in pieces(batches, "text", PIECE):
            cols = [[], [], [], []]
            uids, grams = batch.column(batch.schema.get_field_index("uid")), batch.column(batch.schema.get_field_index("grams"))
            for i in range(batch.num_rows):
                data = byte_buffer(texts.slice(i, 1))[0]
                first, last, gram = _shared_runs(data, grams[i].as_py(), length, q)
                if len(first):
                    size = last - first + length
                    cols[0].append(np.full(len(first), uids[i].as_py(), np.int64))
                    cols[1].append(first)
                    cols[2].append(gram.view(np.int64))
                    cols[3].append(Identifiers(data, 1).strings(first, size).view(np.int64))
            yield _columns(cols, ["uid", "first", "gram", "whole"])

    return near.select("uid", "text", "grams").mapInArrow(run, "uid long, first long, gram long, whole long")


def _asked_runs(batch: pa.RecordBatch, texts: pa.Array, way: int, length: int, q: int):
    """For each text of the batch: uid, bytes, and the first and last begins, Q-grams and `single` marks of the runs
    that are asked for in the given way."""
    uids, grams, asked = (batch.column(batch.schema.get_field_index(c)) for c in ("uid", "grams", "asked"))
    for i in range(batch.num_rows):
        want = {g["first"]: g["single"] for g in asked[i].as_py() if g["way"] == way}
        if want:
            data = byte_buffer(texts.slice(i, 1))[0]
            first, last, gram = _shared_runs(data, grams[i].as_py(), length, q)
            pick = np.flatnonzero(np.isin(first, np.array(list(want), np.int64)))
            yield uids[i].as_py(), data, first[pick], last[pick], gram[pick].view(np.int64), np.array([want[f] for f in first[pick].tolist()], bool)


def _contexts(work: DataFrame, length: int, q: int) -> DataFrame:
    """(gram, uid, first, single, bytes): the runs of Q-grams with few runs, with the bytes of their strings."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in pieces(batches, "text", PIECE):
            rows = [(int(g), uid, int(f), bool(s), data[f:x + length].tobytes())
                    for uid, data, first, last, gram, single in _asked_runs(batch, texts, 1, length, q)
                    for f, x, g, s in zip(first, last, gram, single)]
            columns = list(zip(*rows)) if rows else [[]] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["gram", "uid", "first", "single", "bytes"])

    return work.mapInArrow(run, "gram long, uid long, first long, single boolean, bytes binary")


def _repeated_in_group(length: int):
    """Begins of the strings that stand more than once among the runs of some Q-grams."""
    def run(table: pa.Table) -> pa.Table:
        blobs = pa.array(table.column("bytes").to_pylist(), pa.large_binary())
        starts = np.frombuffer(blobs.buffers()[1], np.int64, len(blobs) + 1)
        data = np.frombuffer(blobs.buffers()[2], np.uint8)[:starts[-1]]
        counts = np.diff(starts) - length + 1
        row = np.repeat(np.arange(len(blobs)), counts)
        inner = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
        begin = starts[:-1][row] + inner
        size = np.full(len(begin), length, np.int64)
        a, b = (Identifiers(data, salt).strings(begin, size) for salt in (3, 4))
        order = np.lexsort((b, a))
        same = (a[order][1:] == a[order][:-1]) & (b[order][1:] == b[order][:-1])
        twice = np.zeros(len(begin), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        hit = np.flatnonzero(twice & table.column("single").to_numpy()[row])
        return pa.table({"uid": pa.array(table.column("uid").to_numpy()[row[hit]]),
                         "begin": pa.array(table.column("first").to_numpy()[row[hit]] + inner[hit])})

    return run


def _string_rows(work: DataFrame, length: int, q: int) -> DataFrame:
    """(gram, string, uid, begin, single): the identifier of each string of the runs of crowded Q-grams, which no task
    could hold."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in pieces(batches, "text", PIECE):
            cols = [[], [], [], [], []]
            for uid, data, first, last, gram, single in _asked_runs(batch, texts, 2, length, q):
                size = last - first + 1
                begin = np.repeat(first - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
                for c, v in enumerate((np.repeat(gram, size), Identifiers(data, 3).strings(begin, np.full(len(begin), length, np.int64)).view(np.int64),
                                       np.full(len(begin), uid, np.int64), begin, np.repeat(single, size))):
                    cols[c].append(v)
            yield _columns(cols, ["gram", "string", "uid", "begin", "single"], {4: np.bool_})

    return work.mapInArrow(run, "gram long, string long, uid long, begin long, single boolean")


def _columns(cols: list[list[np.ndarray]], names: list[str], kinds: dict | None = None) -> pa.RecordBatch:
    kinds = kinds or {}
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c) if c else np.zeros(0, kinds.get(i, np.int64))) for i, c in enumerate(cols)], names)


def removed_spans(begins: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs covered by strings of `length` bytes that begin at the sorted positions."""
    if not len(begins):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    head = np.concatenate(([True], begins[1:] > begins[:-1] + length))
    starts = np.flatnonzero(head)
    return begins[starts], begins[np.concatenate((starts[1:] - 1, [len(begins) - 1]))] + length


def _kept(near: DataFrame, length: int, q: int) -> DataFrame:
    """(uid, spans, kept_sha256) of the texts with bucketed Q-grams."""
    schema = T.StructType([T.StructField("uid", T.LongType()), T.StructField("spans", T.ArrayType(T.StructType(
        [T.StructField("begin", T.LongType()), T.StructField("end", T.LongType())]))), T.StructField("kept_sha256", T.StringType())])
    spans_type = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in pieces(batches, "text", PIECE):
            uids, grams, asked, hits = (batch.column(batch.schema.get_field_index(c)) for c in ("uid", "grams", "asked", "hits"))
            spans, digests = [], []
            for i in range(batch.num_rows):
                data = byte_buffer(texts.slice(i, 1))[0]
                first, last, _ = _shared_runs(data, grams[i].as_py(), length, q)
                single = [g["first"] for g in asked[i].as_py() or () if g["single"]]
                whole = np.flatnonzero(~np.isin(first, np.array(single, np.int64)))
                size = last[whole] - first[whole] + 1
                begins = np.repeat(first[whole] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
                begins = np.union1d(begins, np.array(hits[i].as_py() or [], np.int64))
                a, b = removed_spans(begins, length)
                keep = np.ones(len(data), bool)
                for x, y in zip(a, b):
                    keep[x:y] = False
                spans.append([{"begin": int(x), "end": int(y)} for x, y in zip(a, b)])
                digests.append(hashlib.sha256(data[keep].tobytes()).hexdigest())
            yield pa.RecordBatch.from_arrays([uids, pa.array(spans, spans_type), pa.array(digests, pa.string())], schema.names)

    return near.select("uid", "text", "grams", "asked", "hits").mapInArrow(run, schema)


def repeated_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, q: int = Q,
                   group_runs: int = GROUP_RUNS) -> DataFrame:
    """(key, n_bytes, spans, kept_sha256): the maximal byte runs of each text covered by strings of `length` bytes that
    also begin anywhere else, in any text, and the digest of the bytes outside them.

    Strings are judged on the input and never cross texts. Null texts are empty. Texts shorter than `length` lose
    nothing. Repeated rows repeat each other and lose all strings. Null keys are keys like others; other columns are
    left out. Needs 2 q < length <= 256 and length >= 128."""
    if not (128 <= length <= 256 and 2 * q < length and q in (16, 32, 48, 64)):
        raise ValueError("unsupported length or q")
    own = docs.select(F.col(key).alias("_key"), F.coalesce(text, F.lit("")).alias("_text"), F.xxhash64(F.col(key), F.col(text)).alias("_uid"))
    slim = cut_lineage(own.select("_key", "_uid", F.octet_length("_text").cast("long").alias("n_bytes"), F.sha2("_text", 256).alias("sha")))
    grams = _scan(own, length, q)
    shared = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n"), F.max("many").alias("many")).filter("n > 1 or many").select("gram")
    flagged = cut_lineage(grams.select("uid", "gram").join(shared, "gram").groupBy("uid").agg(F.collect_set("gram").alias("grams")))
    # Rows that are the same in key and text share a uid: one text stands for them, and all its strings are repeated.
    twins = slim.groupBy("_uid").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("_uid").alias("uid"))
    near = _bucketed(_near_texts(own, flagged), "uid")
    runs = cut_lineage(_run_rows(near, length, q))
    units = runs.groupBy("gram", "whole").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("uid", "first")).alias("at"))
    units = cut_lineage(units.select("at.uid", "at.first", "gram", (F.col("n") == 1).alias("single")))
    # 1: the runs of the Q-gram meet in one task; 2: too many for that, their strings are counted; else all is known.
    ways = units.groupBy("gram").agg(F.count(F.lit(1)).alias("n"), F.max("single").alias("some")).filter("n > 1 and some") \
        .select("gram", F.when(F.col("n") <= group_runs, 1).otherwise(2).alias("way"))
    asked = cut_lineage(units.join(ways, "gram", "left").filter("single or way is not null").groupBy("uid").agg(
        F.collect_list(F.struct("first", "single", F.coalesce("way", F.lit(0)).alias("way"))).alias("asked")))
    work = near.select("uid", "text", "grams").join(asked, "uid")
    groups = 1 + asked.agg(F.sum(F.size(F.filter("asked", lambda g: g.way == 1)))).first()[0] // TASK_RUNS if not asked.isEmpty() else 1
    meeting = _contexts(work, length, q).groupBy(F.pmod(F.xxhash64("gram"), F.lit(groups)).alias("group")).applyInArrow(_repeated_in_group(length), "uid long, begin long")
    strings = _string_rows(work, length, q)
    twice = strings.groupBy("gram", "string").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("gram", "string")
    counted = strings.filter("single").join(twice, ["gram", "string"], "left_semi").select("uid", "begin")
    hits = cut_lineage(meeting.union(counted).groupBy("uid").agg(F.collect_list("begin").alias("hits")))
    kept = _kept(near.join(asked.join(hits, "uid", "left"), "uid", "left"), length, q)
    out = slim.join(kept, slim["_uid"] == kept["uid"], "left").join(twins.withColumnRenamed("uid", "_twin"), slim["_uid"] == F.col("_twin"), "left")
    none = F.array().cast("array<struct<begin:bigint,end:bigint>>")
    twin = F.col("_twin").isNotNull() & (F.col("n_bytes") >= length)
    return out.select(
        F.col("_key").alias(key), "n_bytes",
        F.when(twin, F.array(F.struct(F.lit(0).cast("long").alias("begin"), F.col("n_bytes").alias("end")))).otherwise(F.coalesce("spans", none)).alias("spans"),
        F.when(twin, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"))
