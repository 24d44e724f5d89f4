"""Source audit, SimHash groups and ranked search against brute force, on tables with nulls, ties, repeated and odd rows."""

import math
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import types as T

from tabulon.llm import lexical_search, simhash_pivots, source_audit
from tabulon.llm.lexical_search import best_documents, build_index, ranked_search, search_index
from tabulon.llm.queries import queries
from tabulon.llm.simhash_pivots import fingerprint, hamming_links, pivot_links, simhash_groups
from tabulon.llm.source_audit import source_divergence

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, term string, bits long, score int, n int"


@pytest.fixture(scope="module")
def rows():
    found = duckdb.sql(f"SELECT doc_id, text, lang, source FROM '{SF}/documents.parquet' ORDER BY doc_id").fetchall()
    longest = " ".join(f"w{i % 5000}" for i in range(70_000))
    odd = [(9001, None, None, None), (9002, "", "en", "src1"), (9003, longest, "en", None), (9004, longest + " tail", None, "src2"),
           (9005, found[0][1], "en", "src3"), (9005, found[0][1], "en", "src3"), (9006, "one two", "en", "src1"),
           (9007, "ONE two", "en", "src1"), (9008, " \n\t ", "en", "src1"), (None, "lost id words here", "en", "src1"),
           (9009, "→ 12 ½ !", "xx", "src1"), (9010, "a" * 300_000, "xx", ""), (9011, "", "xx", "src4"), (9012, "straße ÉCOLE école", "fr", "src9")]
    odd += [(9100 + i, "zeta alpha mid zeta" if i % 2 else "alpha zeta mid alpha", "tie", f"t{i % 5}") for i in range(30)]
    return [(*r, "x", i, 1, 2) for i, r in enumerate(found + odd)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def brute_divergence(rows):
    term = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    own, in_docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source, *_ in rows:
        lang, source = lang or "", source or ""
        words = term.findall(lower(text))
        groups.add((lang, source))
        own[lang, source].update(words)
        in_docs[lang].update(set(words))
    out = []
    for lang, source in groups:
        kept = [t for t, n in in_docs[lang].items() if n >= 10]
        sources = sorted(s for x, s in groups if x == lang)

        def shares(count):
            total = sum(count[t] for t in kept)
            return {t: 1 + 10 ** 9 * (count[t] + 2) // (total + 2 * len(kept)) for t in kept}

        def ranked(part, values, limit):
            first = sorted(values, key=lambda v: (-v[1], v[0].encode()))[:limit]
            return [(lang, source, part, item, value, i) for i, (item, value) in enumerate(first, 1)]

        f = lambda p, q: (p - q) ** 2 // (p + q)
        p = shares(own[lang, source])
        others = {s: shares(own[lang, s]) for s in sources}
        out += ranked("pair", [(s, sum(f(p[t], q[t]) for t in kept)) for s, q in others.items() if s != source], None)
        q = shares(sum((own[lang, s] for s in sources), Counter()))
        out += ranked("term", [(t, f(p[t], q[t])) for t in kept if own[lang, source][t] and p[t] > q[t]], 10)
    return Counter(out)


@pytest.mark.parametrize("small", [False, True])
def test_divergence_of_sources(docs, rows, small, monkeypatch):
    if small:
        monkeypatch.setattr(source_audit, "SOURCES_PER_BLOCK", 3)
        monkeypatch.setattr(source_audit, "COUNTS_PER_TASK", 400)
        monkeypatch.setattr(source_audit, "HELD_COUNTS", 50)
    got = Counter(tuple(r) for r in source_divergence(docs).collect())
    want = brute_divergence(rows)
    assert got == want
    # Ties in value are there, and stand in UTF-8 order.
    values = [(r[0], r[1], r[2], r[4]) for r in want]
    assert len(values) > len(set(values))


def test_divergence_of_odd_tables(spark, empty):
    assert source_divergence(empty).count() == 0
    few = spark.createDataFrame([("rare words", "en", "a"), ("other words", "en", "b"), (None, None, None)], "text string, lang string, source string")
    got = sorted(tuple(r) for r in source_divergence(few).collect())
    assert got == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]
    one = spark.createDataFrame([("word " * 7, 3, 1)] * 12, "body string, tongue int, term int")
    got = source_divergence(one, "body", "tongue", "term").collect()
    assert got == []  # a lone group has the shares of its language


def brute_fingerprint(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", lower(text)) if w]
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    bits = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for i in range(64):
            bits[i] += h >> i & 1
    return sum(1 << i for i in range(64) if 2 * bits[i] > len(shingles))


def brute_components(prints):
    """prints: distinct whole numbers; the least one that each reaches, by breadth-first search."""
    values = np.array(sorted(prints), np.uint64)
    left, of = set(range(len(values))), {}
    for i in range(len(values)):
        if i in left:
            left.discard(i)
            todo = [i]
            while todo:
                x = todo.pop()
                of[int(values[x])] = int(values[i])
                near = [int(j) for j in np.flatnonzero(np.bitwise_count(values ^ values[x]) <= 3) if j in left]
                left.difference_update(near)
                todo += near
    return of


def check_groups(got, rows):
    prints = [(r[0], brute_fingerprint(r[1])) for r in rows]
    root = brute_components({p for _, p in prints})
    least = {}
    for key, p in prints:
        if key is not None:
            least[root[p]] = min(key, least.get(root[p], key))
    assert Counter(tuple(r) for r in got) == Counter((k, f"{p:016x}", least.get(root[p])) for k, p in prints)


def test_simhash_groups(docs, rows, empty):
    check_groups(simhash_groups(docs).collect(), rows)
    assert simhash_groups(empty).count() == 0


def test_simhash_query(spark):
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()
    check_groups(queries.queries["op12_pivot_tables"](spark, SF).collect(), rows)


def test_fingerprint_is_linear_in_its_pieces(monkeypatch):
    text = " ".join(f"w{i % 700}" for i in range(5000))
    want = brute_fingerprint(text)
    monkeypatch.setattr(simhash_pivots, "HASHED", 97)
    assert fingerprint(text.encode()) == want
    assert fingerprint(b"") == fingerprint(b" \t\n") == 0


def near_prints(seed, centres, around):
    """Clusters whose members are some bits from a centre or from another member."""
    draw = np.random.default_rng(seed)
    out = [int(x) for x in draw.integers(0, 1 << 63, centres, dtype=np.uint64)]
    for _ in range(around):
        x = out[int(draw.integers(len(out)))]
        for _ in range(int(draw.integers(1, 7))):
            x ^= 1 << int(draw.integers(64))
        out.append(x)
    return sorted(set(out))


def closed(links, nodes):
    up = {n: n for n in nodes}

    def root(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


@pytest.mark.parametrize("held", [1 << 20, 5])
def test_links_of_one_group(held, monkeypatch):
    monkeypatch.setattr(simhash_pivots, "HELD_PAIRS", held)
    prints = near_prints(1, 40, 600)
    a, b = pivot_links(np.array(prints, np.uint64), np.zeros(len(prints), np.int64))
    assert len(a) < len(prints)
    assert closed(zip(a.tolist(), b.tolist()), prints) == brute_components(prints)


def test_links_when_groups_are_split(spark, monkeypatch):
    monkeypatch.setattr(simhash_pivots, "GROUP", 4)
    monkeypatch.setattr(simhash_pivots, "ROWS_PER_TASK", 500)
    # Half of the fingerprints share 40 bits, so that several rounds of blocks are needed.
    prints = sorted(set(near_prints(2, 60, 500)) | {p & 0xFFFFFF for p in near_prints(3, 300, 300)})
    frame = spark.createDataFrame([(p if p < 1 << 63 else p - (1 << 64),) for p in prints], "bits long")
    links = [(r.a % (1 << 64), r.b % (1 << 64)) for r in hamming_links(frame).collect()]
    assert closed(links, prints) == brute_components(prints)


def brute_search(rows, items, k=50):
    term = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    held = [(r[0], Counter(term.findall(lower(r[1])))) for r in rows]
    held = [(key, tf, sum(tf.values())) for key, tf in held if tf]
    count, total = len(held), sum(n for _, _, n in held)
    df = Counter(t for _, tf, _ in held for t in tf)
    weight = {t: math.floor(1000 * math.log((2 * count + 2) / (2 * n + 1))) for t, n in df.items()}
    out = []
    for item, text in items:
        own = set(term.findall(lower(text))) & set(df)
        scored = []
        for key, tf, n in held:
            m = 100 - 50 + (50 * n * count) // total
            scored.append((sum(weight[t] * ((10 ** 9 * tf[t]) // (1000 * tf[t] + 20 * m)) for t in own if tf[t]), key))
        scored = sorted((s for s in scored if s[0] > 0), key=lambda s: (-s[0], s[1] is None, s[1] or 0))
        out += [(item, i, key, score) for i, (score, key) in enumerate(scored[:k], 1)]
    return Counter(out)


@pytest.fixture(scope="module")
def items(rows):
    found = duckdb.sql(f"SELECT item_id, text FROM '{SF}/benchmark.parquet' ORDER BY item_id").fetchall()
    # Every row of the tied texts has the same score, and there are more documents than places for a word of all.
    return [*found, found[0], (700, None), (701, "?!"), (702, "nowhere2be"), (None, found[1][1]), (703, "zeta mid"), (704, rows[0][1]), (705, "w1 w2 one two")]


@pytest.mark.parametrize("small", [False, True])
def test_ranked_search(spark, docs, rows, items, small, monkeypatch):
    if small:
        monkeypatch.setattr(lexical_search, "SHARD_POSTINGS", 300)
        monkeypatch.setattr(lexical_search, "FIRST_SHARDS", 2)
        monkeypatch.setattr(lexical_search, "GROWTH", 4)
        monkeypatch.setattr(lexical_search, "QUERY_BYTES", 20_000)
    asked = spark.createDataFrame([(i, t, 1, "x") for i, t in items], "item_id int, text string, doc_id int, rank string")
    got = Counter((r.item_id, r["rank"], r.doc_id, r.score) for r in ranked_search(docs, asked).collect())
    assert got == brute_search(rows, items)


def test_search_of_odd_tables(spark, docs, empty, rows):
    none = spark.createDataFrame([], "item_id int, text string")
    assert ranked_search(docs, none).count() == 0
    some = spark.createDataFrame([(1, "one two")], "item_id int, text string")
    assert ranked_search(empty, some).count() == 0
    # Keys that are texts; ties in their UTF-8 order.
    named = spark.createDataFrame([("é", "one", 0), ("z", "one", 0), (None, "one", 0), ("a", "two", 0)], "name string, body string, text int")
    got = search_index(build_index(named, "name", "body"), some.withColumnRenamed("text", "q"), "item_id", "q", "name", 3).collect()
    assert sorted((r["rank"], r["name"]) for r in got) == [(1, "a"), (2, "z"), (3, "é")]


def test_index_round_trip(docs, rows):
    """All postings of all documents are in the index."""
    term = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    want = Counter((r[0], t, n) for r in rows for t, n in Counter(term.findall(lower(r[1]))).items())
    got = Counter()
    found = build_index(docs).collect()
    heads = {r.shard: r for r in found if r.term is None}
    for r in found:
        if r.term is not None:
            pairs = lexical_search._numbers(np.frombuffer(r.data, np.uint8)).reshape(-1, 2)
            numbers = np.cumsum(pairs[:, 0]) - 1
            assert len(pairs) == r.n and len(r.last) == 4 * -(-r.n // lexical_search.BLOCK)
            got.update((heads[r.shard]["keys"][d], r.term, int(n)) for d, n in zip(numbers, pairs[:, 1]))
    assert got == want


class _Counted(lexical_search._List):
    read = 0

    def _read(self, begin, stop, before):
        _Counted.read += stop - begin
        return super()._read(begin, stop, before)


def test_blocks_are_rejected_unread():
    """A rare, strong term leaves few candidates; most blocks of a frequent one are never decompressed."""
    shard = lexical_search._Shard()
    for i in range(20_000):
        shard.add(i, [b"common"] + [b"rare"] * (i % 4000 == 7) + [b"w"] * 20)
    names = ["shard", "term", "n", "total", "keys", "lengths", "last", "most", "least", "stop", "data"]
    batch = shard.rows(0, T.StructType([T.StructField(n, T.LongType()) for n in names]), pa.int64())
    table = batch.to_pydict()
    m = lexical_search.length_weight(np.frombuffer(table["lengths"][0], "<i8"), 20_000, 420_000)
    lists = {t: _Counted(table, i, m, lambda n: lexical_search.length_weight(n, 20_000, 420_000)) for i, t in enumerate(table["term"]) if t}
    order = np.arange(20_000)
    doc, score = best_documents([(lists["rare"], 5000), (lists["common"], 3)], 20_000, 5, 0, order)
    assert len(doc) == 5 and sorted(table["keys"][0][d] for d in doc) == [7, 4007, 8007, 12007, 16007]
    assert _Counted.read < 0.2 * (len(lists["common"].data) + len(lists["rare"].data))
    both = 5000 * lists["rare"].whole()[1] + 3 * lists["common"].impacts(doc, np.searchsorted(lists["common"].last, doc))
    assert score.tolist() == both.tolist()


def test_long_products_are_exact():
    n = np.array([1, 10 ** 9], np.int64)
    assert lexical_search.length_weight(n, 10 ** 9, 10 ** 12).tolist() == [50 + 50 * int(x) * 10 ** 9 // 10 ** 12 for x in n]
