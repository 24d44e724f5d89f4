"""What leaves the Jaccard join early, and what ties sets into regions."""

import numpy as np
import pytest

from tabulon.llm import jaccard_regions as J


def test_copies_are_one_set(spark):
    """Shingles of equal texts, in whatever pieces, are no other set's."""
    texts = [" ".join(f"w{i}x{j}" for j in range(40)) for i in range(6)] + [" ".join(f"w0x{j}" if j < 20 else f"v{j}" for j in range(40))]
    docs = spark.createDataFrame([(k * 10 + i, t) for k in range(5) for i, t in enumerate(texts)], "doc_id long, text string").repartition(10)
    nodes = [J._node(s) for s in J.shingle_sets(J.pa.array(texts, J.pa.large_string()))]
    lone = {r.node: r.lone for r in J._lone_shingles(docs, "text", 3, 2).collect()}
    # The last text shares the 16 shingles of its first 20 words with the first one.
    assert lone == dict(zip(nodes, [20, 36, 36, 36, 36, 36, 20]))


def sets_with_a_passage(count=300, own=40, common=20):
    draw = np.random.default_rng(5)
    passage = draw.integers(0, 2 ** 64, common, dtype=np.uint64)
    return [np.unique(np.concatenate((passage, draw.integers(0, 2 ** 64, own, dtype=np.uint64)))).view(np.int64) for _ in range(count)]


def test_a_common_passage_makes_no_region(spark):
    """Unrelated sets that share a passage are not tied; a near copy still is."""
    sets = sets_with_a_passage()
    sets.append(np.sort(sets[7].view(np.uint64))[2:].view(np.int64))
    found = spark.createDataFrame([(i, s.tolist()) for i, s in enumerate(sets)], "node long, set array<long>").repartition(4)
    members = J._first_shingles(found, J._levels(found, sum(map(len, sets))))
    assert {r.node for r in members.select("node").distinct().collect()} == {7, 300}
    assert [(r.a, r.b) for r in J._star_links(members).collect()] == [(300, 7)]


@pytest.mark.parametrize("drop", [2, 8])
def test_join_sets_against_all_pairs(drop):
    """Components by one pivot after the other are those of all pairs, also where one passage is everywhere."""
    draw = np.random.default_rng(drop)
    sets = sets_with_a_passage(60)
    sets += [np.delete(s, draw.choice(len(s), drop, replace=False)) for s in sets[:30]]
    flat, ends = np.concatenate(sets), np.concatenate(([0], np.cumsum([len(s) for s in sets])))
    links = J.join_sets(np.arange(len(sets)), ends, flat)
    up = {}
    near = lambda a, b: 100 * len(np.intersect1d(a, b)) >= J.PERCENT * len(np.union1d(a, b))
    want = {(i, j) for i in range(len(sets)) for j in range(i) if near(sets[i], sets[j])}
    assert {(max(l), min(l)) for l in links} <= want

    def roots(pairs):
        up.clear()
        root = lambda i: i if up.get(i, i) == i else root(up[i])
        for a, b in pairs:
            a, b = sorted((root(a), root(b)))
            up[b] = a
        return [root(i) for i in range(len(sets))]

    assert roots(links) == roots(want)


def test_pivot_distances():
    draw = np.random.default_rng(1)
    sets = [np.unique(draw.integers(0, 40, n)) for n in (5, 20, 40, 1)]
    pivots = J._Pivots([11, 12], [sets[1], np.array([100, 200])])
    flat, ends = np.concatenate(sets), np.concatenate(([0], np.cumsum([len(s) for s in sets])))
    far = pivots.distances(flat, ends, np.array([0, 2, 3]))
    for row, i in enumerate((0, 2, 3)):
        assert far[row].tolist() == pytest.approx([1 - len(np.intersect1d(sets[i], p)) / len(np.union1d(sets[i], p)) for p in (sets[1], [100, 200])])
