"""How far the sources of a language stray from it, and from each other, by the terms that they use.

Counts of a term are smoothed to integer shares, and two shares p and q differ by floor((p - q)^2 / (p + q)). All that is
evaluated stands in count cells: terms of equal counts have equal shares, so they are counted and not looked at one by one.

1. A group's leading terms: its terms fall into cells (count in the group, count in the language). The measure is taken once
   for each cell, cells of equal value are merged, and the values of which fewer terms stand above than are asked for are
   kept. Only their cells are expanded to terms, ties in the order of their UTF-8 bytes.
2. A pair of sources: with f0(x) for the measure between a term's share here and the share of a term without occurrences
   there, the sum over all terms is that over the two sources' own cells (count, 0), which are few, with corrections for
   terms that both use. Blocks of sources meet in tasks, each for a part of the terms; no pair of rows is sent anywhere.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabulon.llm.buffers import pieces
from tabulon.session import cut_lineage

# Fixed value: the bytes that terms are made of, after A-Z are lower-cased.
TERM = rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
MIN_DOCS = 10
TOP_TERMS = 10
#: Bytes of text tokenised at once.
PIECE = 1_000_000
#: (language, source, term) counts that a task holds before it sends them on.
HELD_COUNTS = 200_000
#: Sources of one block, and counts of one task, when sources are compared.
SOURCES_PER_BLOCK = 64
COUNTS_PER_TASK = 500_000

_terms = re.compile(TERM).findall
_GROUP = ("lang", "source")


def _texts_of(docs: DataFrame, text: str, lang: str, source: str) -> DataFrame:
    """The three columns as strings, null as the empty string."""
    return docs.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(n)
                         for c, n in ((lang, "lang"), (source, "source"), (text, "text"))])


def term_counts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, term, n, docs): occurrences of each term in each group, and the documents that hold it.

    Tasks count their own rows first, so a group or a term with a third of all rows is a few counts from each task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        for batch, texts in pieces(batches, limit=PIECE):
            groups = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
            for group, raw in zip(groups, texts.cast(pa.large_binary()).to_pylist()):
                words = _terms(raw.lower())
                if words:
                    n, own = held.setdefault(group, (Counter(), Counter()))
                    n.update(words)
                    own.update(set(words))
            if sum(len(n) for n, _ in held.values()) > HELD_COUNTS:
                yield from _sent(held)
                held = {}
        yield from _sent(held)

    sent = _texts_of(docs, text, lang, source).mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return sent.groupBy(*_GROUP, "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _sent(held: dict[tuple[str, str], tuple[Counter, Counter]]) -> Iterator[pa.RecordBatch]:
    for (lang, source), (n, docs) in held.items():
        terms = list(n)
        yield pa.RecordBatch.from_arrays([
            pa.array([lang] * len(terms), pa.string()), pa.array([source] * len(terms), pa.string()),
            pa.array(terms, pa.binary()).cast(pa.string()), pa.array(list(n.values()), pa.int64()),
            pa.array([docs[t] for t in terms], pa.int64())], ["lang", "source", "term", "n", "docs"])


def _share(count: str, total: str, terms: str):
    """1 + floor(10^9 (count + 2) / (total + 2 terms)), exact for all 64-bit counts."""
    return F.expr(f"1 + (cast(1000000000 as decimal(38, 0)) * ({count} + 2) div ({total} + 2 * {terms}))")


def _measure(p: str, q: str):
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})")


def source_divergence(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source",
                      min_docs: int = MIN_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank) for every (lang, source) that occurs.

    Part `pair` ranks all other sources of the language by their distance, part `term` the `top` terms that the group uses
    more than its language does. Only terms in at least `min_docs` documents of their language count. Ranks begin at 1,
    largest value first, ties in UTF-8 order. Null texts, languages and sources are read as empty ones; a group without
    terms has pairs and no terms, and a language without kept terms gives pairs of value 0. Repeated rows count as often as
    they stand; other columns are left out; an empty table gives an empty result."""
    groups = _texts_of(docs, text, lang, source).select(*_GROUP).distinct()
    counts = cut_lineage(term_counts(docs, text, lang, source))
    kept = cut_lineage(counts.groupBy("lang", "term").agg(F.sum("n").alias("in_lang"), F.sum("docs").alias("docs"))
                       .filter(F.col("docs") >= min_docs).drop("docs"))
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("in_lang").alias("lang_total"))
    own = counts.drop("docs").join(kept, ["lang", "term"])
    totals = own.groupBy(*_GROUP).agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("used"))
    sized = cut_lineage(groups.join(totals, [*_GROUP], "left").join(langs, "lang", "left")
                        .na.fill(0, ["total", "used", "terms", "lang_total"]))
    own = cut_lineage(own)
    return _leading_terms(own, sized, top).unionByName(_pairs(own, sized)).select(*_GROUP, "part", "item", "value", "rank")


def _leading_terms(own: DataFrame, sized: DataFrame, top: int) -> DataFrame:
    cells = own.groupBy(*_GROUP, "n", "in_lang").agg(F.count(F.lit(1)).alias("times")).join(sized, [*_GROUP]) \
        .withColumns({"p": _share("n", "total", "terms"), "q": _share("in_lang", "lang_total", "terms")}) \
        .filter("p > q").select(*_GROUP, "n", "in_lang", "times", _measure("p", "q").alias("value"))
    cells = cut_lineage(cells)
    # Every value stands for one term at least, so the first `top` values are enough; each task sends as many at most.
    falling = Window.partitionBy(*_GROUP).orderBy(F.desc("value"))
    values = cells.groupBy(*_GROUP, "value").agg(F.sum("times").alias("times")) \
        .withColumn("place", F.row_number().over(falling)).filter(F.col("place") <= top)
    above = F.coalesce(F.sum("times").over(falling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    reached = values.withColumn("above", above).filter(F.col("above") < top).select(*_GROUP, "value")
    chosen = cells.join(reached, [*_GROUP, "value"]).select(*_GROUP, "n", "in_lang", "value")
    order = Window.partitionBy(*_GROUP).orderBy(F.desc("value"), "term")
    return own.join(chosen, [*_GROUP, "n", "in_lang"]).select(*_GROUP, "value", "term") \
        .withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top) \
        .select(*_GROUP, F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank")


def _pairs(own: DataFrame, sized: DataFrame) -> DataFrame:
    blocks = sized.groupBy("lang").agg(
        F.ceil(F.count(F.lit(1)) / SOURCES_PER_BLOCK).cast("int").alias("blocks"),
        F.ceil(F.sum("used") / COUNTS_PER_TASK).cast("int").alias("parts"))
    placed = sized.join(blocks, "lang").select(
        *_GROUP, "total", "used", "terms", "parts", _share("0", "total", "greatest(terms, 1)").alias("zero"), "blocks",
        F.expr("cast(pmod(xxhash64(source), blocks) as int)").alias("block"))
    placed = cut_lineage(placed)
    both = F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1),
                                 lambda b: F.struct(F.least("block", b).alias("low"), F.greatest("block", b).alias("high"))))
    # A source's own cells, and one row without count that says which sources there are.
    cells = own.groupBy(*_GROUP, "n").agg(F.count(F.lit(1)).alias("times")).join(placed, [*_GROUP]) \
        .select(*_GROUP, "zero", "used", "terms", "block", "blocks", _share("n", "total", "terms").alias("p"), "times")
    here = placed.select(*_GROUP, "zero", "used", "terms", "block", "blocks", F.lit(None).cast("long").alias("p"), F.lit(0).cast("long").alias("times"))
    fields = "lang string, a string, b string, value long"
    alone = cells.union(here).withColumn("pair", both).drop("blocks").groupBy("lang", "pair").applyInArrow(_own_cells, fields)
    shared = own.join(placed, [*_GROUP]).select(
        *_GROUP, "term", "zero", "block", "blocks", _share("n", "total", "terms").alias("p"),
        F.expr("cast(pmod(xxhash64(term, 3), parts) as int)").alias("part")) \
        .withColumn("pair", both).drop("blocks").groupBy("lang", "pair", "part").applyInArrow(_shared_terms, fields)
    summed = cut_lineage(alone.union(shared).groupBy("lang", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("value").alias("value")))
    order = Window.partitionBy(*_GROUP).orderBy(F.desc("value"), "item")
    return summed.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value") \
        .union(summed.select("lang", "b", "a", "value")).withColumn("rank", F.row_number().over(order)) \
        .withColumn("part", F.lit("pair"))


def _f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


class _Sources:
    """The sources of one task, numbered in order, with the rows of each."""

    def __init__(self, table: pa.Table) -> None:
        coded = table.column("source").combine_chunks().dictionary_encode()
        coded = pa.concat_arrays(coded.chunks) if isinstance(coded, pa.ChunkedArray) else coded
        self.lang = table.column("lang")[0].as_py()
        self.names = coded.dictionary.to_pylist()
        code = coded.indices.to_numpy()
        # Rows in the order of their source.
        self.order = np.argsort(code, kind="stable")
        self.code = code[self.order]
        self.ends = np.searchsorted(self.code, np.arange(len(self.names) + 1))
        self.zero = self.first(table, "zero")
        self.block = self.first(table, "block")
        pair = table.column("pair")[0].as_py()
        self.halves = pair["low"] != pair["high"]

    def rows(self, table: pa.Table, name: str) -> np.ndarray:
        return table.column(name).to_numpy()[self.order]

    def first(self, table: pa.Table, name: str) -> np.ndarray:
        return self.rows(table, name)[self.ends[:-1]]

    def partners(self, a: int) -> np.ndarray:
        """Sources that meet source a in this task: all later ones in one block, those of the other block in two."""
        meets = np.arange(len(self.names)) > a
        return meets & (self.block != self.block[a]) if self.halves else meets

    def result(self, found: list[tuple[int, int, int]]) -> pa.Table:
        a, b, value = zip(*found) if found else ((), (), ())
        return pa.table({"lang": pa.array([self.lang] * len(a), pa.string()), "a": pa.array([self.names[i] for i in a], pa.string()),
                         "b": pa.array([self.names[i] for i in b], pa.string()), "value": pa.array(value, pa.int64())})


def _own_cells(table: pa.Table) -> pa.Table:
    """For each two sources: all terms as if none were used by both."""
    s = _Sources(table)
    p = s.rows(table.set_column(table.schema.get_field_index("p"), "p", table.column("p").fill_null(0)), "p")
    times, used, terms = s.rows(table, "times"), s.first(table, "used"), int(table.column("terms")[0].as_py())
    found = []
    for a in range(len(s.names)):
        own = slice(s.ends[a], s.ends[a + 1])
        for b in np.flatnonzero(s.partners(a)):
            if not terms:
                found.append((a, int(b), 0))
                continue
            other = slice(s.ends[b], s.ends[b + 1])
            value = int((times[own] * _f(p[own], s.zero[b])).sum()) + int((times[other] * _f(p[other], s.zero[a])).sum())
            found.append((a, int(b), value + (terms - int(used[a]) - int(used[b])) * int(_f(s.zero[a], s.zero[b]))))
    return s.result(found)


def _shared_terms(table: pa.Table) -> pa.Table:
    """For each two sources: what terms that both use add to the sum over their own cells."""
    s = _Sources(table)
    p = s.rows(table, "p")
    coded = table.column("term").combine_chunks().dictionary_encode()
    coded = pa.concat_arrays(coded.chunks) if isinstance(coded, pa.ChunkedArray) else coded
    term = coded.indices.to_numpy()[s.order]
    dense = np.zeros(len(coded.dictionary), np.int64)
    found = []
    for a in range(len(s.names)):
        own = slice(s.ends[a], s.ends[a + 1])
        dense[term[own]] = p[own]
        meets = s.partners(a)
        rows = np.flatnonzero(meets[s.code] & (dense[term] > 0))
        if len(rows):
            here, there, b = dense[term[rows]], p[rows], s.code[rows]
            more = _f(here, there) - _f(here, s.zero[b]) - _f(there, s.zero[a]) + _f(s.zero[a], s.zero[b])
            heads = np.flatnonzero(np.concatenate(([True], b[1:] != b[:-1])))
            found += zip([a] * len(heads), b[heads].tolist(), np.add.reduceat(more, heads).tolist())
        dense[term[own]] = 0
    return s.result(found)
