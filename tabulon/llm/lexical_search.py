"""Ranked search over a block index, by Block-Max MaxScore.

`build_index` cuts the documents into shards, each of what one task reads in a row, and numbers a shard's documents by their
length. A term's postings are blocks of up to 128, compressed, each with its last document, its highest count and its
shortest document: as the documents of a block are about equally long, these bound a block's scores closely, for any
totals of the collection that are known only later.

`search_index` walks the lists of a query in each shard from the highest bound down. Lists are essential as long as
documents that stand in no earlier list could still reach the k-th best score; they are read whole. After them only
documents that can still reach it are candidates: in the other lists, the maximum of the candidate's block decides before
the block is decompressed. Heaps of the shards are merged. Shards are searched in phases: the k-th best score of a phase
is a bound for the later ones, which then send fewer rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.llm.buffers import pieces
from tabulon.session import cut_lineage

# Fixed value: the bytes that terms are made of, after A-Z are lower-cased.
TERM = rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
TOP = 50
BLOCK = 128
#: Bytes of text tokenised at once.
PIECE = 1_000_000
#: A shard is closed with so many postings.
SHARD_POSTINGS = 1_500_000
#: Shards of the first phase, and how many times more the next one has.
FIRST_SHARDS, GROWTH = 8, 16
#: Bytes of query texts that go to the tasks at once; more queries mean more passes over the index.
QUERY_BYTES = 16 << 20
#: Impacts are SCALE * tf / (1000 tf + 20 m), as whole numbers.
SCALE = 1_000_000_000

_terms = re.compile(TERM).findall


def _varints(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whole numbers as bytes of 7 bits, the last one of each without the high bit, and how many bytes each takes."""
    width = np.ones(len(values), np.int64)
    for bits in (7, 14, 21, 28):
        width += values >= 1 << bits
    ends = np.cumsum(width)
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    for i in range(int(width.max(initial=0))):
        own = width > i
        out[(ends - width + i)[own]] = (values[own] >> (7 * i) & 127) | np.where(width[own] > i + 1, 128, 0)
    return out, width


def _numbers(data: np.ndarray) -> np.ndarray:
    last = np.flatnonzero(data < 128)
    begin = np.concatenate(([0], last[:-1] + 1))
    place = np.arange(len(data)) - np.repeat(begin, last - begin + 1)
    return np.add.reduceat((data & 127).astype(np.int64) << (7 * place), begin) if len(last) else np.zeros(0, np.int64)


class _Shard:
    """Documents on their way into a shard."""

    def __init__(self) -> None:
        self.terms: dict[bytes, int] = {}
        self.keys, self.lengths, self.ids, self.counts = [], [], [], []
        self.postings = 0

    def add(self, key, words: list[bytes]) -> None:
        found = Counter(words)
        number = self.terms
        self.keys.append(key)
        self.lengths.append(len(words))
        self.ids.append(np.array([number.setdefault(t, len(number)) for t in found], np.int32))
        self.counts.append(np.array(list(found.values()), np.int32))
        self.postings += len(found)

    def rows(self, name: int, schema: T.StructType, key_type: pa.DataType) -> pa.RecordBatch:
        length = np.array(self.lengths, np.int64)
        by_length = np.argsort(length, kind="stable")
        number = np.empty(len(length), np.int64)
        number[by_length] = np.arange(len(length))
        term = np.concatenate(self.ids)
        doc = np.repeat(number, [len(x) for x in self.ids])
        tf = np.concatenate(self.counts).astype(np.int64)
        order = np.lexsort((doc, term))
        term, doc, tf = term[order], doc[order], tf[order]
        length = length[by_length]
        heads = np.searchsorted(term, np.arange(len(self.terms) + 1))
        # Blocks begin at the head of a list and every BLOCK postings from there.
        inside = np.arange(len(term)) - heads[term]
        begins = np.flatnonzero(inside % BLOCK == 0)
        ends = np.concatenate((begins[1:], [len(term)]))
        gap = np.diff(doc, prepend=0)
        gap[heads[:-1]] = doc[heads[:-1]] + 1
        data, width = _varints(np.stack((gap, tf), axis=1).ravel())
        stop = np.cumsum(width)[1::2]
        before = np.concatenate(([0], stop))
        block = {"last": doc[ends - 1], "most": np.maximum.reduceat(tf, begins), "least": np.minimum.reduceat(length[doc], begins)}
        block["stop"] = stop[ends - 1] - before[heads[term[begins]]]
        of_list = np.searchsorted(term[begins], np.arange(len(self.terms) + 1))
        keys = pa.array(self.keys, key_type).take(pa.array(by_length))
        empty = [None] * len(self.terms)
        cut = lambda values, at: [None, *(values[a:b].tobytes() for a, b in zip(at[:-1], at[1:]))]
        raw = data.tobytes()
        at = before[heads].tolist()
        return pa.RecordBatch.from_arrays([
            pa.array([name] * (len(empty) + 1), pa.int64()),
            pa.array([None, *self.terms], pa.binary()).cast(pa.string()),
            pa.array([len(length), *np.diff(heads).tolist()], pa.int64()),
            pa.array([int(length.sum()), *empty], pa.int64()),
            pa.ListArray.from_arrays(pa.array([0, len(keys), *([len(keys)] * len(empty))], pa.int32()), keys),
            pa.array([length.astype("<i8").tobytes(), *empty], pa.binary()),
            *[pa.array(cut(block[c].astype("<i4"), of_list), pa.binary()) for c in ("last", "most", "least", "stop")],
            pa.array([None, *(raw[a:b] for a, b in zip(at[:-1], at[1:]))], pa.binary()),
        ], schema.names)


def build_index(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The index of all terms of all documents, written to the shared folder: for each shard one row without a term (`n`
    documents, `total` of their terms, `keys` and `lengths` by number) and one for each term (`n` postings, the blocks' `last`
    document, `most` occurrences, `least` length and `stop` in `data`). Documents without terms, null ones too, are left out."""
    kind = docs.schema[key].dataType
    schema = T.StructType([
        T.StructField("shard", T.LongType()), T.StructField("term", T.StringType()), T.StructField("n", T.LongType()),
        T.StructField("total", T.LongType()), T.StructField("keys", T.ArrayType(kind)),
        *[T.StructField(c, T.BinaryType()) for c in ("lengths", "last", "most", "least", "stop", "data")]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, name, key_type = _Shard(), 0, None
        for batch, texts in pieces(batches, limit=PIECE):
            key_type = batch.schema.field(0).type
            for k, name_, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts.cast(pa.large_binary()).to_pylist()):
                words = _terms(raw.lower())
                if not words:
                    continue
                if not shard.keys:
                    name = name_
                shard.add(k, words)
                if shard.postings >= SHARD_POSTINGS:
                    yield shard.rows(name, schema, key_type)
                    shard = _Shard()
        if shard.keys:
            yield shard.rows(name, schema, key_type)

    # A shard is named by the number of its first row, which no other shard has.
    numbered = docs.select(F.col(f"`{key}`").alias("key"), F.monotonically_increasing_id().alias("row"), F.col(f"`{text}`").cast("string").alias("text"))
    return cut_lineage(numbered.mapInArrow(run, schema))


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return SCALE * tf // (1000 * tf + 20 * m)


def length_weight(length: np.ndarray, docs: int, total: int) -> np.ndarray:
    """100 - 50 + (50 * length * documents) div total, exact when the product leaves 64 bits."""
    if len(length) and 50 * int(length.max()) * docs >= 1 << 63:
        return np.array([50 + 50 * int(n) * docs // total for n in length], np.int64)
    return 50 + 50 * length * docs // total


class _List:
    """A term's postings in one shard. Blocks are decompressed when they are asked for, and kept."""

    def __init__(self, table: dict, row: int, m_of: np.ndarray, m_of_length) -> None:
        self.last, self.most, self.least, self.stop = (np.frombuffer(table[c][row], "<i4") for c in ("last", "most", "least", "stop"))
        self.data = np.frombuffer(table["data"][row], np.uint8)
        self.m = m_of
        self.block_impact = impact(self.most.astype(np.int64), m_of_length(self.least.astype(np.int64)))
        self.bound = int(self.block_impact.max())
        self.blocks: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.all: tuple[np.ndarray, np.ndarray] | None = None

    def _read(self, begin: int, stop: int, before: int) -> tuple[np.ndarray, np.ndarray]:
        pairs = _numbers(self.data[begin:stop]).reshape(-1, 2)
        doc = np.cumsum(pairs[:, 0]) + before
        return doc, impact(pairs[:, 1], self.m[doc])

    def whole(self) -> tuple[np.ndarray, np.ndarray]:
        if self.all is None:
            self.all = self._read(0, len(self.data), -1)
        return self.all

    def impacts(self, docs: np.ndarray, block: np.ndarray) -> np.ndarray:
        """Impacts of sorted documents whose blocks are given; 0 where the term is missing."""
        out = np.zeros(len(docs), np.int64)
        heads = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1])))
        if self.all is not None:
            parts = [(slice(None), self.all)]
        else:
            parts = []
            for a, z in zip(heads.tolist(), [*heads[1:].tolist(), len(block)]):
                b = int(block[a])
                if b not in self.blocks:
                    self.blocks[b] = self._read(int(self.stop[b - 1]) if b else 0, int(self.stop[b]), int(self.last[b - 1]) if b else -1)
                parts.append((slice(a, z), self.blocks[b]))
        for own, (doc, value) in parts:
            at = np.minimum(np.searchsorted(doc, docs[own]), len(doc) - 1)
            out[own] = np.where(doc[at] == docs[own], value[at], 0)
        return out


def best_documents(lists: list[tuple[_List, int]], n_docs: int, k: int, least: int, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The k best documents of a shard for one query, with their scores, of those that score `least` or more (1 at least).

    `lists` holds the query's lists with the weights of their terms, `order` each document's rank by key."""
    lists = sorted(((w * x.bound, w, x) for x, w in lists if w > 0), key=lambda e: -e[0])
    rest = np.concatenate((np.cumsum([e[0] for e in lists][::-1])[::-1], [0])).astype(np.int64) if lists else np.zeros(1, np.int64)
    score, least = np.zeros(n_docs, np.int64), max(least, 1)
    i = 0
    while i < len(lists) and rest[i] >= least:
        _, w, own = lists[i]
        doc, value = own.whole()
        score[doc] += w * value
        i += 1
        # Whoever has more than all the other lists can give may end the essential part.
        if i < len(lists) and k < n_docs and score.max() > rest[i]:
            least = max(least, int(np.partition(score, n_docs - k)[n_docs - k]))
    found = np.flatnonzero(score + rest[i] >= least)
    for j in range(i, len(lists)):
        if not len(found):
            break
        _, w, own = lists[j]
        block = np.searchsorted(own.last, found)
        inside = block < len(own.last)
        top = np.where(inside, w * own.block_impact[np.minimum(block, len(own.last) - 1)], 0)
        able = score[found] + top + rest[j + 1] >= least
        found, block, inside = found[able], block[able], inside[able]
        if inside.any():
            score[found[inside]] += w * own.impacts(found[inside], block[inside])
    found = found[score[found] >= least]
    best = np.lexsort((order[found], -score[found]))[:k]
    return found[best], score[found[best]]


def _key_order(keys: pa.Array) -> np.ndarray:
    place = pc.sort_indices(keys, null_placement="at_end").to_numpy()
    out = np.empty(len(place), np.int64)
    out[place] = np.arange(len(place))
    return out


def search_index(index: DataFrame, items: DataFrame, item: str = "item_id", item_text: str = "text", key: str = "doc_id",
                 k: int = TOP) -> DataFrame:
    """(item, rank, key, score): each item's k best documents with a score above 0, equal scores by key (nulls last).

    A repeated item row has results of its own. Items without terms, null ones too, have none. Item rows travel to the
    tasks in parts of at most QUERY_BYTES of text, or one row."""
    queries = cut_lineage(items.select(F.col(f"`{item}`").alias("item"), F.coalesce(F.col(f"`{item_text}`").cast("string"), F.lit("")).alias("text"),
                                       F.monotonically_increasing_id().alias("query")))
    size = queries.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = 1 + 2 * size // QUERY_BYTES
    shards = index.filter("term is null")
    n_docs, total, n_shards = shards.agg(F.sum("n"), F.sum("total"), F.count(F.lit(1))).first()
    out = None
    for part in range(parts):
        own = queries.filter(F.pmod(F.xxhash64("query"), F.lit(parts)) == part)
        found = _search(index, own, n_docs or 0, total or 0, n_shards, k)
        out = found if out is None else out.union(found)
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("key"))
    ranked = out.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.join(queries.select("query", "item"), "query").select(F.col("item").alias(item), "rank", F.col("key").alias(key), "score")


def _search(index: DataFrame, queries: DataFrame, n_docs: int, total: int, n_shards: int, k: int) -> DataFrame:
    spark = index.sparkSession
    asked = {r.query: sorted(set(_terms(r.text.encode().lower()))) for r in queries.select("query", "text").collect()}
    words = sorted({t for terms in asked.values() for t in terms})
    vocabulary = spark.createDataFrame([(t.decode(),) for t in words], "term string")
    wanted = cut_lineage(index.filter("term is not null").join(vocabulary, "term", "left_semi").select(*index.columns)
                         .union(index.filter("term is null"))
                         .withColumn("draw", F.shiftrightunsigned(F.xxhash64("shard"), 11).cast("double") / float(1 << 53)))
    df = {r.term.encode(): r.df for r in wanted.filter("term is not null").groupBy("term").agg(F.sum("n").alias("df")).collect()}
    weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) for t, n in df.items()}
    plan = [(q, [(t.decode(), weight[t]) for t in terms if t in weight]) for q, terms in asked.items()]
    key_type = index.schema["keys"].dataType.elementType
    schema = T.StructType([T.StructField("query", T.LongType()), T.StructField("key", key_type), T.StructField("score", T.LongType())])
    sent = spark.sparkContext.broadcast(plan)
    out, bounds, low = None, {}, 0.0
    high = FIRST_SHARDS / max(1, n_shards)
    while True:
        phase = wanted.filter((F.col("draw") >= low) & (F.col("draw") < high))
        found = cut_lineage(phase.drop("draw").groupBy("shard").applyInArrow(_searcher(sent, spark.sparkContext.broadcast(bounds), n_docs, total, k), schema))
        out = found if out is None else out.union(found)
        if high >= 1:
            return out
        # The k-th best score so far is reached or passed by every row of the result.
        place = Window.partitionBy("query").orderBy(F.desc("score"))
        kth = out.select("query", "score").withColumn("place", F.row_number().over(place)).filter(F.col("place") <= k)
        bounds = {r.query: r.score for r in kth.filter(F.col("place") == k).collect()}
        low, high = high, high * GROWTH


def _searcher(plan, bounds, n_docs: int, total: int, k: int):
    def run(table: pa.Table) -> pa.Table:
        columns = {c: table.column(c).to_pylist() for c in ("term", "lengths", "last", "most", "least", "stop", "data")}
        head = columns["term"].index(None)
        keys = table.column("keys").combine_chunks()
        keys = pa.concat_arrays(keys.chunks) if isinstance(keys, pa.ChunkedArray) else keys
        own_keys = keys.slice(head, 1).flatten()
        m = length_weight(np.frombuffer(columns["lengths"][head], "<i8"), n_docs, total)
        lists = {t: _List(columns, i, m, lambda n: length_weight(n, n_docs, total)) for i, t in enumerate(columns["term"]) if t is not None}
        order = _key_order(own_keys)
        query, doc, score = [], [], []
        for q, terms in plan.value:
            found, values = best_documents([(lists[t], w) for t, w in terms if t in lists], len(m), k, bounds.value.get(q, 0), order)
            query.append(np.full(len(found), q, np.int64))
            doc.append(found)
            score.append(values)
        doc = np.concatenate(doc) if doc else np.zeros(0, np.int64)
        return pa.table({"query": np.concatenate(query) if query else doc, "key": own_keys.take(pa.array(doc)),
                         "score": np.concatenate(score) if score else doc})

    return run


def ranked_search(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id",
                  item_text: str = "text", k: int = TOP) -> DataFrame:
    """Index the documents and search all items in them. Null texts hold no terms; repeated documents each have a place
    of their own; extra columns are left out; an empty table gives an empty result."""
    return search_index(build_index(docs, key, text), items, item, item_text, key, k)
