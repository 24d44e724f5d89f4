"""Clashing names, odd keys and what an operator leaves behind."""

import itertools
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from tabulon.llm import bpe, chat_repair
from tabulon.llm.buffers import BATCH_BYTES, small_batches
from tabulon.llm.decontaminate import benchmark_hits
from tabulon.llm.fingerprints import edited_fingerprints, entropy_histogram, rarity_ranks
from tabulon.llm.line_spread import remove_spread_lines
from tabulon.llm.sharding import shard_by_bytes, text_size
from tabulon.llm.suffix_repeats import repeated_spans

HELPERS = ["_key", "_row", "_row2", "_out", "_hits", "_hash", "_bytes_in", "_place", "_first", "_total", "_range", "_group", "number", "line",
           "length", "raw", "first", "word", "in_0", "in_1", "_text", "key", "row", "term", "value", "item", "bits", "node", "root", "set"]
LONG = " ".join(f"word{i * i % 977}" for i in range(400))


@pytest.fixture(scope="module")
def crowded(spark):
    """Documents with a column for every name that an operator might use inside."""
    rows = [(i, None if i == 3 else "" if i == 4 else f"{LONG[:300 + 40 * (i % 5)]}\nshared line\nown {i}", f"s{i % 12}") for i in range(24)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    return df.select("*", *[F.concat(F.lit(f"{h}:"), "doc_id").alias(h) for h in HELPERS])


def kept(found, names=HELPERS):
    return all(r[h] == f"{h}:{r['doc_id']}" for r in found for h in names)


def test_columns_of_the_caller_stay(spark, crowded):
    lines = remove_spread_lines(crowded).collect()
    assert len(lines) == 24 and kept(lines) and sum(r.n_removed for r in lines) == 21
    bench = spark.createDataFrame([(1, LONG[:200], "x")], "item_id int, text string, _hits string")
    hits = benchmark_hits(crowded, bench).collect()
    assert len(hits) == 24 and kept(hits) and sum(r.n_hit > 0 for r in hits) == 22
    # Several parts of a benchmark give what one gives.
    more = spark.createDataFrame([(i, LONG[20 * i:20 * i + 160], "x") for i in range(9)], "item_id int, text string, _hits string")
    one, many = (sorted((r.doc_id, r.n_hit, tuple(r["items"])) for r in benchmark_hits(crowded, more, items_per_pass=n).collect()) for n in (100, 3))
    assert one == many
    sized = crowded.withColumn("size", text_size("text"))
    shards = shard_by_bytes(sized, 3, "size", F.col("text"), "doc_id").collect()
    assert len(shards) == 24 and kept(shards)
    for made, run in ((("n_lines",), lambda d: remove_spread_lines(d)), (("items",), lambda d: benchmark_hits(d, bench)),
                      (("slot",), lambda d: shard_by_bytes(d.withColumn("size", F.lit(1)), 3, "size", F.lit(1), "doc_id"))):
        with pytest.raises(ValueError):
            run(crowded.withColumn(made[0], F.lit(1)))


def test_shards_by_the_middle_byte(spark):
    two = spark.createDataFrame([(1, 10), (2, 20)], "doc_id long, size long")
    assert {r.shard for r in shard_by_bytes(two, 2, "size", F.lit(1), "doc_id").collect()} == {0, 1}
    draw = random.Random(3)
    rows = [(i, draw.choice([1, 5, 40, 300])) for i in range(600)]
    got = shard_by_bytes(spark.createDataFrame(rows, "doc_id long, size long"), 7, "size", F.col("doc_id"), "doc_id").collect()
    mean = sum(s for _, s in rows) / 7
    for shard in range(7):
        own = [r for r in got if r.shard == shard]
        assert abs(sum(r["size"] for r in own) - mean) < 300 and sorted(r.slot for r in own) == list(range(len(own)))


@pytest.mark.parametrize("keys,kind", [([5, -(1 << 63), (1 << 63) - 1, None, 0, 5], "long"), (["b", "a", "é", None, "z", "b"], "string"),
                                       ([1.5, -2.0, 3.25, None, 0.0, 1.5], "double")])
def test_edited_texts_follow_keys_of_any_type(spark, keys, kind):
    texts = [f"text number {i} " + LONG[i * 7:i * 7 + 200] for i in range(6)]
    docs = spark.createDataFrame(list(zip(keys, texts)), f"k {kind}, body string")
    got = edited_fingerprints(docs, rarity_ranks(entropy_histogram(docs, "body")), "k", "body").collect()
    hashed = {r.body: r.h for r in docs.select("body", F.xxhash64("body").alias("h")).collect()}
    present = sorted([(k, t) for k, t in zip(keys, texts) if k is not None], key=lambda x: hashed[x[1]])
    order = sorted(present, key=lambda x: x[0].encode() if kind == "string" else x[0], reverse=True)
    # Of equal keys the smaller hash comes first.
    order = [x for _, own in itertools.groupby(order, key=lambda x: x[0]) for x in sorted(own, key=lambda x: hashed[x[1]])]
    order += [(k, t) for k, t in zip(keys, texts) if k is None]
    want = []
    for (k, t), (_, after) in zip(order, [*order[1:], order[0]]):
        cut = len(t) // 3
        want.append((k, spark.createDataFrame([(t[:len(t) - cut] + after[:cut],)], "x string").select(F.sha2("x", 256)).head()[0]))
    assert sorted((str(r.k), r.edited) for r in got) == sorted((str(k), e) for k, e in want)


def test_no_table_is_left_in_the_catalog(spark):
    before = {t.name for t in spark.catalog.listTables()}
    docs = spark.createDataFrame([(i, f"{i} " + LONG) for i in range(4)], "doc_id long, text string")
    assert all(r.spans for r in repeated_spans(docs).collect())
    assert {t.name for t in spark.catalog.listTables()} == before


def cheapest(roles):
    """The least cost over all sequences of new roles and inserted turns, by its own search over legal conversations."""
    best = {(-1,): 0}  # the last role that was written (-1: none) -> cost
    system, user, assistant = 0, 1, 2
    legal = {-1: {system, user}, system: {user}, user: {assistant}, assistant: {user}}
    best = {-1: 0}
    for old in roles:
        now = {}
        for last, cost in best.items():
            for inserted in ((), (user,), (assistant,), (user, assistant), (assistant, user)):
                at, fine = last, True
                for x in inserted:
                    fine &= x in legal[at]
                    at = x
                if not fine:
                    continue
                for new in (system, user, assistant):
                    change = 0 if new == old else 0 if old == -1 else chat_repair.RELABEL
                    ways = []
                    if new in legal[at]:
                        ways.append(change)
                    if not inserted and new == at and last != -1:
                        ways.append(change + chat_repair.MERGE)
                    for way in ways:
                        total = cost + len(inserted) * chat_repair.INSERT + way
                        now[new] = min(now.get(new, 1 << 30), total)
        best = now
    return min(cost + {0: 2, 1: 1, 2: 0}[last] * chat_repair.INSERT for last, cost in best.items())


def test_conversations_are_repaired_at_least_cost(spark):
    draw = random.Random(11)
    names = {0: "system", 1: "User", 2: " assistant", -1: "tool"}
    rows = [(c, t, names[draw.choice([0, 1, 1, 2, 2, -1])], f"c{c}t{t}") for c in range(50) for t in range(draw.randrange(1, 9))]
    roles = {}
    for c, _, r, _ in rows:
        roles.setdefault(c, []).append({v: k for k, v in names.items()}[r])
    for block in (2, 1024):
        got = chat_repair.repair_roles(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), block=block).collect()
        assert {(r.conv_id, r.cost) for r in got} == {(c, cheapest(x)) for c, x in roles.items()}
        for c in roles:
            text = "".join(r.rendered for r in sorted((r for r in got if r.conv_id == c), key=lambda r: r.position))
            # Every text is there once, in order.
            assert [x for x in __import__("re").findall(r"c\d+t\d+", text)] == [x[3] for x in rows if x[0] == c]
            assert text.count("<|end|>") == text.count("<|user|>") + text.count("<|assistant|>") + text.count("<|system|>")


def test_long_matches_dead_ends_and_small_caches(monkeypatch):
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    monkeypatch.setattr(bpe, "KEPT_PRETOKENS", 7)
    monkeypatch.setattr(bpe, "KEPT_PAIRS", 11)
    encoder = bpe.Encoder(ranks, public_tokenizers.PATTERN)
    rng = random.Random(4)
    texts = ["x" * 30_000, "ab" * 9_999 + "c", "-" * 20_001, "é" * 5_000, "7" * 4_001, "the " * 500]
    texts += ["".join(rng.choices("etaoinshrdlu", k=rng.randint(1, 3_000))) for _ in range(20)]
    texts += [" ".join("".join(rng.choices("abcdeisñé日", k=rng.randint(1, 12))) for _ in range(40)) for _ in range(50)]
    for text in texts:
        ids = encoder.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text)
        assert encoder.decode(ids) == text.encode()


def test_arrow_batches_are_bounded_by_bytes(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    try:
        spark.conf.unset(name)
        small_batches(spark)
        df = spark.range(3000).select(F.repeat(F.lit("x"), 10_000).alias("t")).coalesce(1)

        def sizes(batches):
            for b in batches:
                yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"])

        got = [r.n for r in df.mapInArrow(sizes, "n long").collect()]
        assert sum(got) >= 30_000_000 and max(got) <= BATCH_BYTES + 20_000
        spark.conf.set(name, "1234567")
        small_batches(spark)
        assert spark.conf.get(name) == "1234567"
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)
