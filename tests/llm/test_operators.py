"""Each operator against brute force, on small tables with nulls, empty, long, tied and repeated rows."""

import hashlib
import random
import re
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from tabulon.llm import chat_repair, fingerprints, language_crf, secret_scan
from tabulon.llm.bpe import Encoder, decode_ids, encode_texts, read_ranks
from tabulon.llm.decontaminate import benchmark_hits
from tabulon.llm.jaccard_regions import join_sets, near_duplicates
from tabulon.llm.language_crf import fit_languages, label_languages
from tabulon.llm.line_spread import remove_spread_lines
from tabulon.llm.sharding import shard_by_bytes, text_size
from tabulon.llm.suffix_repeats import repeated_spans

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, extra string"


def rows_of_table():
    found = duckdb.sql(f"SELECT doc_id, text, lang, source FROM '{SF}/documents.parquet' ORDER BY doc_id").fetchall()
    return [(*r, "x") for r in found]


@pytest.fixture(scope="module")
def rows():
    """The smallest documents table with odd rows: null id, text, language and source, empty, long and repeated texts."""
    base = rows_of_table()
    longest = " ".join(f"w{i}" for i in range(30_000))
    odd = [(9001, None, None, None, None), (9002, "", "en", "src1", "x"), (9003, longest, "en", None, "x"), (9004, longest + " tail", None, "src2", "x"),
           (9005, base[0][1], "en", "src3", "x"), (9005, base[0][1], "en", "src3", "x"), (9006, "one two", "en", "src1", "x"),
           (9007, "ONE two", "en", "src1", "x"), (9008, " \n\t ", "en", "src1", "x"), (None, "lost id words here", "en", "src1", "x"),
           (9009, "→ 12 ½ !", "en", "src1", "x"), (9010, "a" * 3000, "en", "src1", "x")]
    return base + odd


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_shards_are_even_gapless_and_whole(spark, docs, empty, rows):
    sized = docs.select("doc_id", text_size("text").alias("size"), F.xxhash64("text").alias("same"))
    got = shard_by_bytes(sized, 5, "size", F.col("same"), "doc_id").collect()
    assert Counter((r.doc_id, r["size"]) for r in got) == Counter((r[0], len((r[1] or "").encode()) + 8) for r in rows)
    total, largest = sum(r["size"] for r in got), max(r["size"] for r in got)
    for shard in range(5):
        own = [r for r in got if r.shard == shard]
        assert sorted(r.slot for r in own) == list(range(len(own)))
        assert abs(sum(r["size"] for r in own) - total / 5) <= 2 * largest
    none = empty.select("doc_id", text_size("text").alias("size"), F.lit(1).alias("same"))
    assert shard_by_bytes(none, 5, "size", F.col("same"), "doc_id").count() == 0
    with pytest.raises(ValueError):
        shard_by_bytes(sized.withColumn("slot", F.lit(1)), 5, "size", F.col("same"), "doc_id")


def test_shards_of_one_repeated_row(spark):
    same = spark.createDataFrame([(1, 10)] * 400, "doc_id long, size long")
    got = shard_by_bytes(same, 4, "size", F.lit(1), "doc_id").groupBy("shard").count().collect()
    assert sorted(r["count"] for r in got) == [100] * 4


def brute_secrets(text):
    out = []
    assign = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    out += [(m.start(), 0, m.end()) for m in re.finditer(assign, text, re.I | re.A) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


def test_base_secrets_match_brute_force():
    rng = random.Random(4)
    parts = ["password", "PassWd", "api_key", "APIKEY", "token", "ſecret", " ", "=", ":", '"', "AKIA", "ABCDEFGHIJ012345", "deadbeef" * 3, "é", "abc123", "secret"]
    for _ in range(2000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert secret_scan.base_spans(text) == brute_secrets(text)


def test_random_strings_are_added_and_prose_is_not(spark, docs, empty):
    rng = random.Random(5)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    keys = ["A7" + "".join(rng.choice(alphabet) for _ in range(38)) + "z9" for _ in range(60)]
    planted = spark.createDataFrame([(20_000 + i, f"see {k} here", "en", "s", None) for i, k in enumerate(keys)], SCHEMA)
    found = {r.doc_id: r for r in secret_scan.find_secrets(docs.union(planted)).collect() if r.doc_id is not None}
    hits = sum(any(s.kind == 3 for s in found[20_000 + i].spans) for i in range(60))
    assert hits >= 40
    assert sum(any(s.kind == 3 for s in r.spans) for i, r in found.items() if i < 9000) <= 4
    assert all(set(r.base_spans) <= set(r.spans) for r in found.values())
    assert found[9001].spans == []
    assert secret_scan.find_secrets(empty).count() == 0


@pytest.mark.parametrize("length", [16, 20, 24, 32, 48, 96])
def test_random_strings_are_found_by_band_and_encoding(length):
    rng, least = random.Random(length), secret_scan.least_bits(0.01)
    for name, alphabet in secret_scan.ENCODINGS.items():
        keys = []
        while len(keys) < 300:
            key = "".join(rng.choice(alphabet) for _ in range(length))
            if re.search("[0-9]", key) and re.search("[A-Za-z]", key) and key.strip("-_/") == key:
                keys.append(key)
        assert sum(secret_scan.is_random(k, least) for k in keys) >= 0.96 * len(keys), name
    decoys = [secret_scan.decoy(rng, secret_scan.WORDS[1::2], length) for _ in range(1000)]
    assert sum(secret_scan.is_random(s, least) for s in decoys) <= 20
    assert not any(secret_scan.is_random(s, least) for s in ("abcdefghijklmnop0123456789", "a1" * 20, "src/main/java/App2/index_2024", "order-2024-01-31-report"))


def test_a_key_is_found_in_a_table_of_any_size(spark, docs):
    key = "kX9vQ2mZr7LpW4tBn8Yd"
    one = spark.createDataFrame([(30_000, f"see {key} here", "en", "s", None)], SCHEMA)
    for table in (one, docs.union(one)):
        found = secret_scan.find_secrets(table).where("doc_id = 30000").head()
        assert [(s.start, s.kind, s.end) for s in found.spans] == [(4, 3, 24)]


def test_fingerprints_of_edited_texts(spark, docs, rows, empty):
    ranks = fingerprints.rarity_ranks(fingerprints.entropy_histogram(docs))
    got = fingerprints.edited_fingerprints(docs, ranks).collect()
    texts = {r[0]: r[1] or "" for r in rows}
    order = sorted((i for i in texts if i is not None and i != 9005), reverse=True)
    by_id = {r.doc_id: r for r in got}
    assert len(got) == len(rows)
    for i, after in zip(order, order[1:]):
        if 9005 in (i - 1, after - 1) or i == 9006:
            continue
        text, cut = texts[i], len(texts[i]) // 3
        edited = text[:len(text) - cut] + texts[after][:cut]
        assert by_id[i].edited == hashlib.sha256(edited.encode()).hexdigest()
        assert by_id[i].n_chars == len(text)
    plain = {r.doc_id: r.fingerprint for r in fingerprints.fingerprint_texts(docs, ranks).collect()}
    assert all(by_id[i].fingerprint == plain[i] for i in by_id)
    long = [r for r in got if 600 < r.n_chars < 20_000]
    assert np.median([r.near_edited for r in long]) > 0.4 and np.median([r.near_next for r in long]) < 0.05
    assert fingerprints.edited_fingerprints(empty, ranks).count() == 0


def test_every_text_has_a_feature(spark, docs, monkeypatch):
    ranks = fingerprints.rarity_ranks(fingerprints.entropy_histogram(docs))
    rng = random.Random(4)
    texts = ["".join(rng.choice("abcdefghij klmnop") for _ in range(n)) for n in range(64, 131) for _ in range(3)] + ["a" * 3000, "ab" * 40]
    found = fingerprints.digests(pa.array(texts, pa.large_string()), ranks)
    assert all(found) and len(set(found)) == len(texts)
    table = spark.createDataFrame(list(enumerate(["", *texts, None])), "doc_id long, text string")
    got = fingerprints.edited_fingerprints(table, ranks).collect()
    # The null text comes first and is followed by a text, the empty one is followed by the null one.
    assert [r.doc_id for r in got if r.near_next == 1] == [0]
    monkeypatch.setattr(fingerprints, "PIECE", 200)
    assert fingerprints.digests(pa.array(["a" * 3000], pa.large_string()), ranks) == [found[-2]]


def test_window_entropy_and_long_texts(monkeypatch):
    rng = np.random.default_rng(2)
    data = rng.integers(97, 105, 700_00).astype(np.uint8)
    entropy = fingerprints.window_entropies(data)
    for i in range(0, 69_000, 997):
        counts = np.array(list(Counter(data[i:i + 64].tolist()).values())) / 64
        assert abs(-(counts * np.log2(counts)).sum() / 6 * 1000 - entropy[i]) <= 1
    ranks = fingerprints.rarity_ranks(np.bincount(entropy, minlength=1001))
    text = pa.array([data.tobytes().decode()], pa.large_string())
    whole = fingerprints.digests(text, ranks)
    monkeypatch.setattr(fingerprints, "PIECE", 9_000)
    assert fingerprints.digests(text, ranks) == whole


@pytest.mark.parametrize("group_runs", [10_000, 2])
def test_repeated_spans_match_brute_force(spark, docs, rows, empty, group_runs):
    seen = Counter()
    blobs = [(r[0], (r[1] or "").encode()) for r in rows]
    for _, b in blobs:
        seen.update(b[j:j + 200] for j in range(len(b) - 199))
    want = Counter()
    for i, b in blobs:
        mask = np.zeros(len(b), bool)
        for j in range(len(b) - 199):
            if seen[b[j:j + 200]] > 1:
                mask[j:j + 200] = True
        edge = np.diff(np.concatenate(([0], mask.astype(int), [0])))
        want[i, len(b), tuple(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist())),
             hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~mask])).hexdigest()] += 1
    got = Counter((r.doc_id, r.n_bytes, tuple((s.begin, s.end) for s in r.spans), r.kept_sha256)
                  for r in repeated_spans(docs, group_runs=group_runs).collect())
    assert got == want
    assert repeated_spans(empty).count() == 0


@pytest.mark.parametrize("per_pass", [20_000, 7])
def test_benchmark_hits_match_brute_force(spark, docs, rows, empty, per_pass):
    items = duckdb.sql(f"SELECT item_id, text FROM '{SF}/benchmark.parquet'").fetchall() + [(500, "w5 W6, w7"), (501, None), (None, "w1 w2"), (502, "...")]
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = {}
    for i, t in items:
        w = words(t)
        size = min(13, len(w))
        for j in range(len(w) - size + 1 if w else 0):
            windows.setdefault(tuple(w[j:j + size]), set()).add(i)
    sizes = {len(w) for w in windows}
    want = Counter()
    for i, t, *_ in rows:
        w = words(t)
        hit, found = set(), set()
        for size in sizes:
            for j in range(len(w) - size + 1):
                owners = windows.get(tuple(w[j:j + size]))
                if owners:
                    hit.update(range(j, j + size))
                    found |= owners
        want[i, len(w), len(hit), tuple(sorted(str(x) for x in found if x is not None))] += 1
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = Counter((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in benchmark_hits(docs, bench, items_per_pass=per_pass).collect())
    assert got == want
    assert benchmark_hits(empty, bench).count() == 0


def test_languages_held_out(spark, docs, empty):
    train = docs.filter("doc_id % 4 <> 2")
    got = {r.doc_id: r for r in label_languages(docs, fit_languages(train), segments=True).collect()}
    held = [r for r in rows_of_table() if r[0] % 4 == 2]
    assert sum(got[r[0]].lang_pred == r[2] for r in held) >= 0.95 * len(held)
    for i in (9001, 9002, 9008, 9009):
        assert (got[i].lang_pred, got[i].score, got[i].segments) == ("und", 0.0, [])
    assert label_languages(empty, fit_languages(empty)).count() == 0


def test_marginals_match_brute_force():
    rng = np.random.default_rng(1)
    emissions, moves = rng.normal(size=(1500, 3)).astype(np.float32), rng.normal(size=(3, 3))
    chains = np.array([0, 0, 1, 130, 700, 1500])
    got = language_crf._marginals(emissions, chains, moves)
    step = np.exp(moves)
    for a, b in zip(chains[:-1], chains[1:]):
        e, states, v = np.exp(emissions[a:b].astype(float)), [], np.ones(3) / 3
        for x in e:
            v = (v @ step) * x
            v /= v.sum()
            states.append(v)
        w = np.ones(3)
        for i in range(len(e) - 1, -1, -1):
            both = states[i] * w
            assert np.allclose(both / both.sum(), got[a + i], atol=1e-4)
            w = step @ (w * e[i])
            w /= w.sum()


def brute_components(rows):
    sets = []
    for i, t, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append((i, {tuple(w[j:j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()))
    up = list(range(len(sets)))

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    for x in range(len(sets)):
        for y in range(x):
            a, b = sets[x][1], sets[y][1]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                up[root(x)] = root(y)
    least = {}
    for k, (i, _) in enumerate(sets):
        if i is not None:
            least[root(k)] = min(i, least.get(root(k), i))
    return Counter((i, len(s), least.get(root(k))) for k, (i, s) in enumerate(sets))


@pytest.mark.parametrize("limit", [4_000_000, 500])
def test_near_duplicates_match_brute_force(monkeypatch, spark, docs, rows, empty, limit):
    from tabulon.llm import jaccard_regions

    monkeypatch.setattr(jaccard_regions.region_links, "__defaults__", (limit,))
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in near_duplicates(docs).collect()) == brute_components(rows)
    if limit > 500:
        assert near_duplicates(empty).count() == 0


def test_join_in_a_task_keeps_every_connection():
    rng = random.Random(3)
    for _ in range(30):
        base = [rng.sample(range(400), 40) for _ in range(4)]
        sets = [np.array(sorted(set(rng.sample(b, rng.randint(28, 40))) | set(rng.sample(range(400), rng.randint(0, 6))))) for b in base for _ in range(12)]
        ends = np.concatenate(([0], np.cumsum([len(s) for s in sets])))
        got = join_sets(np.arange(len(sets)), ends, np.concatenate(sets))
        up, want = list(range(len(sets))), list(range(len(sets)))

        def root(u, k):
            while u[k] != k:
                k = u[k]
            return k

        for a, b in got:
            shared = len(np.intersect1d(sets[a], sets[b]))
            assert 100 * shared >= 75 * (len(sets[a]) + len(sets[b]) - shared)
            up[max(root(up, a), root(up, b))] = min(root(up, a), root(up, b))
        for a in range(len(sets)):
            for b in range(a):
                shared = len(np.intersect1d(sets[a], sets[b]))
                if 100 * shared >= 75 * (len(sets[a]) + len(sets[b]) - shared):
                    x, y = root(want, a), root(want, b)
                    want[max(x, y)] = min(x, y)
        assert [root(up, k) for k in range(len(sets))] == [root(want, k) for k in range(len(sets))]


def legal(roles):
    return re.fullmatch(r"(system )?(user assistant )+", "".join(r + " " for r in roles)) is not None


@pytest.mark.parametrize("block", [1024, 2])
def test_roles_are_repaired_at_least_cost(spark, block):
    rng = random.Random(8)
    names = ["system", "user", "assistant", "USER ", "tool", None]
    turns = [(c, t, rng.choice(names), rng.choice(["hi", None, "", "a\nb"]), 1) for c in range(25) for t in range(rng.randint(1, 6))]
    turns += [(None, None, "user", "x", 1), (None, 0, "user", "x", 1), (7, 0, "user", "again", 1)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string, extra int")
    got = chat_repair.repair_roles(df, block=block).collect()
    assert len(got) == len(turns)
    for conv in {t[0] for t in turns}:
        own = sorted((r for r in got if r.conv_id == conv), key=lambda r: r.position)
        assert legal(re.findall(r"<\|(system|user|assistant)\|>", "".join(r.rendered for r in own)))
        roles = [{"system": 0, "user": 1, "assistant": 2}.get((r.role or "").strip().lower(), -1) for r in own]
        best = {3: 0}
        for old in roles:
            now = {}
            for state, cost in best.items():
                for c, role, _, _ in chat_repair._steps(state, old):
                    now[role] = min(now.get(role, 1 << 30), cost + c)
            best = now
        assert own[0].cost == min(c + {0: 8, 1: 4, 2: 0}[s] for s, c in best.items())
    assert chat_repair.repair_roles(df.limit(0)).count() == 0


def test_tokens_match_the_library(spark, docs, rows, empty):
    ranks = read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = decode_ids(encode_texts(docs, ranks, public_tokenizers.PATTERN), ranks).collect()
    want = Counter((r[0], tuple(library.encode_ordinary(r[1] or "")), (r[1] or "").encode()) for r in rows)
    assert Counter((r.doc_id, tuple(np.frombuffer(r.ids, "<u4").tolist()), bytes(r.decoded)) for r in got) == want
    assert encode_texts(empty, ranks, public_tokenizers.PATTERN).count() == 0
    rng = random.Random(1)
    encoder = Encoder(ranks, public_tokenizers.PATTERN)
    parts = ["a", "b", " ", "\n", "é", "½", "  ", "'s", "\x1c", " ", "Ⅷ", "日本", "😀", "\t", "9", "__", "aaaa", "\x85", "the"]
    for _ in range(1500):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 50)))
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == library.encode_ordinary(text)


def test_spread_lines_go_but_for_their_first_place(spark, docs, rows, empty):
    line = "the same notice"
    extra = [(100_000 + i, f"own {i}\n {line} \nend {i}", "en", f"s{i % 12}", "x") for i in range(30)]
    got = remove_spread_lines(docs.union(spark.createDataFrame(extra, SCHEMA))).collect()
    by_id = {r.doc_id: r for r in got}
    assert len(got) == len(rows) + 30
    assert line in by_id[100_000].text and by_id[100_000].n_removed == 0
    assert all(by_id[100_000 + i].text == f"own {i}\nend {i}" and by_id[100_000 + i].n_removed == 1 for i in range(1, 30))
    assert (by_id[9001].text, by_id[9001].n_lines) == (None, 0) and (by_id[9002].text, by_id[9002].n_lines) == ("", 1)
    assert remove_spread_lines(empty).count() == 0


def test_pipeline_by_stage(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        kept.append((name, out))
        docs = out
        if name != "encode":
            assert out.columns == list(corpus_pipeline.COLUMNS)
    # One document of each group, and clean documents in the first stage.
    assert kept[0][1].count() >= 195
    before = [(r.doc_id, r.text) for r in kept[1][1].collect()]
    groups = brute_components(before)
    assert sorted(r.doc_id for r in kept[2][1].collect()) == sorted({g[2] for g in groups})
    assert all(r.round_trip for r in kept[4][1].collect())
