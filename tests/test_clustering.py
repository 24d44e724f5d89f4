import numpy as np
import pytest
from pyspark.sql import functions as F

from tabulon.operators import clustering as C
from tabulon.plans.cluster_table import cluster_table


@pytest.fixture(scope="module")
def blobs():
    rng = np.random.default_rng(1)
    return np.concatenate([rng.normal(c, 0.5, (20, 2)) for c in ((0, 0), (6, 5), (0, 7))])


def _frame(spark, points):
    return spark.createDataFrame([(i, float(x), float(y), i // 20) for i, (x, y) in enumerate(points)],
                                 "id long, x double, y double, truth int")


def _partition(pairs):
    groups = {}
    for i, label in pairs:
        groups.setdefault(label, set()).add(i)
    return {frozenset(g) for g in groups.values()}


def greedy_ward(points, k):
    groups = [([i], 1.0, np.array(p)) for i, p in enumerate(points)]
    while len(groups) > k:
        _, i, j = min(
            (a[1] * b[1] / (a[1] + b[1]) * ((a[2] - b[2]) ** 2).sum(), i, j)
            for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j)
        a, b = groups[i], groups.pop(j)
        groups[i] = (a[0] + b[0], a[1] + b[1], (a[2] * a[1] + b[2] * b[1]) / (a[1] + b[1]))
    return {frozenset(g[0]) for g in groups}


@pytest.mark.parametrize("finish_rows", [8, 512])
def test_ward_equals_greedy_merging(spark, finish_rows):
    points = np.random.default_rng(7).normal(size=(45, 3))
    start = spark.createDataFrame([(i, 1.0, [float(v) for v in p]) for i, p in enumerate(points)],
                                  "id long, n double, mean array<double>")
    merges = C.ward_merges(start, finish_rows)
    assert merges.count() == 44
    for k in (2, 5):
        found = C.cut_tree(start, merges, k).collect()
        assert _partition((r["id"], r["cluster"]) for r in found) == greedy_ward(points, k)


def test_ward_from_micro_clusters_finds_the_groups(spark, blobs):
    found = C.ward_labels(_frame(spark, blobs), ["x", "y"], 3, micro=12).collect()
    assert len(found) == 60
    assert _partition((r["id"], r[C.WARD_COLUMN]) for r in found) == _partition((i, i // 20) for i in range(60))


def test_ward_keeps_rows_of_repeated_and_null_keys(spark, blobs):
    df = _frame(spark, blobs).withColumn("id", F.when(F.col("id") % 3 > 0, F.col("id") % 10))
    found = C.ward_labels(df, ["x", "y"], 3).collect()
    assert len(found) == 60
    assert len({(r["truth"], r[C.WARD_COLUMN]) for r in found}) == 3


def test_ward_is_the_same_at_every_size(spark, blobs):
    one = _frame(spark, blobs)
    many = one.unionByName(one).unionByName(one)
    rows = C.ward_labels(many, ["x", "y"], 3, micro=30).collect()
    assert _partition((r["id"], r[C.WARD_COLUMN]) for r in rows) == _partition((i, i // 20) for i in range(60))


def test_sweep_and_choice(spark, blobs):
    df = _frame(spark, blobs).persist()
    found = C.sweep(df, ["x", "y"], 6)
    rows = {r["k"]: r for r in found.curve.collect()}
    assert abs(rows[1]["wcss"] - ((blobs - blobs.mean(axis=0)) ** 2).sum()) < 1e-6
    assert all(rows[k]["wcss"] <= rows[k - 1]["wcss"] * 1.05 for k in range(2, 7))
    assert C.elbow_point(found.curve).head()[0] == 3
    assert C.best_silhouette(found.curve).head()[0] == 3
    assert sum(r["is_elbow"] for r in C.elbow_curve(found.curve).collect()) == 1


def test_exact_silhouette(spark, blobs):
    df = _frame(spark, blobs).withColumn("v", F.array("x", "y"))
    labels = np.repeat([0, 1, 2], 20)
    d = np.sqrt(((blobs[:, None] - blobs[None]) ** 2).sum(-1))
    scores = []
    for i in range(60):
        means = {c: d[i, labels == c].sum() / ((labels == c).sum() - (c == labels[i])) for c in range(3)}
        a, b = means[labels[i]], min(v for c, v in means.items() if c != labels[i])
        scores.append((b - a) / max(a, b))
    assert abs(C.exact_silhouette(df, "id", "v", "truth").head()[0] - np.mean(scores)) < 1e-9


def test_choice_and_bands(spark):
    rows = [(3, 3), (3, 4), (4, 3), (2, 7)]
    df = spark.createDataFrame(rows, "e int, s int")
    assert [r[0] for r in df.select(C.chosen_k(F.col("e"), F.col("s"))).collect()] == [3, 3, 3, 7]
    bands = spark.createDataFrame([(x,) for x in (0.5, 0.25, 0.0, -0.25, -0.4, -0.5, -0.9)], "x double")
    words = [r[0] for r in bands.select(F.regexp_extract(C.silhouette_band(F.col("x")), "STRONG|MODERATE|WEAK|May|Strong", 0)).collect()]
    assert words == ["STRONG", "MODERATE", "WEAK", "May", "May", "Strong", "Strong"]


def test_cluster_table(spark, blobs):
    df = _frame(spark, blobs).drop("truth").withColumn("gender", F.when(F.col("id") % 2 == 0, "Male").otherwise("girl"))
    df = df.unionByName(spark.createDataFrame([(None, None, None, None)], "id long, x double, y double, gender string"))
    run = cluster_table(df, "both", plane=True, k_max=5, ignore=("id",))
    assert run.k == 3
    assert run.labelled.columns == ["id", "x", "y", "gender", C.KMEANS_COLUMN, C.WARD_COLUMN, "pc1", "pc2"]
    rows = run.labelled.collect()
    truth = _partition((i, i // 20) for i in range(60))
    assert _partition((r["id"], r[C.KMEANS_COLUMN]) for r in rows) == truth
    assert _partition((r["id"], r[C.WARD_COLUMN]) for r in rows) == truth
    report = {(r["section"], r["key"]): r["value"] for r in run.report.collect()}
    assert report["clusters", "k"] == "3" and "STRONG" in report[C.KMEANS_COLUMN, "band"]
    assert report["encoding", "female"] == "0"


def test_unknown_algorithm(spark, blobs):
    with pytest.raises(ValueError):
        C.cluster_labels(_frame(spark, blobs), ["x"], 2, "other")


def test_exact_ward_and_agreement(spark):
    import numpy as np
    from tabulon.operators import metrics as M
    draw = np.random.default_rng(4)
    middle = draw.normal(size=(6, 3)) * 4
    x = np.round(middle[np.arange(500) % 6] + draw.normal(size=(500, 3)), 4)
    x[400:450] = x[0]
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "id int, a double, b double, c double")
    both = C.ward_labels(C.ward_labels(df, ["a", "b", "c"], 6, micro=None, out="exact"), ["a", "b", "c"], 6, micro=60, out="summed").collect()
    assert len(both) == 500
    # The exact tree by the textbook: the cheapest merge of all, again and again.
    points, n = np.unique(x, axis=0, return_counts=True)
    own = np.unique(x, axis=0, return_inverse=True)[1].ravel()
    means, size, group = points.copy(), n.astype(float), [[i] for i in range(len(points))]
    while len(group) > 6:
        cost = size[:, None] * size / (size[:, None] + size) * ((means[:, None] - means[None]) ** 2).sum(axis=2)
        cost[np.tril_indices(len(group))] = np.inf
        i, j = np.unravel_index(cost.argmin(), cost.shape)
        means[i] = (means[i] * size[i] + means[j] * size[j]) / (size[i] + size[j])
        size[i] += size[j]
        group[i] += group[j]
        means, size = np.delete(means, j, axis=0), np.delete(size, j)
        del group[j]
    want = {p: g for g, members in enumerate(group) for p in members}
    pairs = {(want[int(own[r.id])], r.exact) for r in both}
    assert len(pairs) == 6
    frame = spark.createDataFrame([(want[int(own[r.id])], r.exact, r.summed) for r in both], "want int, exact int, summed int")
    assert M.adjusted_rand(frame, "want", "exact").head()[0] == 1.0
    assert M.adjusted_rand(frame, "exact", "summed").head()[0] >= 0.9
    mixed = frame.withColumn("none", (F.monotonically_increasing_id() * 7919 % 6).cast("int"))
    assert abs(M.adjusted_rand(mixed, "exact", "none").head()[0]) < 0.1
    assert M.adjusted_rand(frame.limit(1), "exact", "summed").head()[0] == 1.0
