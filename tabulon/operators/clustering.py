"""k-Means sweep, elbow and silhouette curves, choice of k, exact silhouette, Ward clustering."""

from __future__ import annotations

import math
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.operators.ordered import with_position
from tabulon.operators.pairwise import block_pairs, matrix, rough_distances, rows_of_block, squared_distances
from tabulon.operators.report import combine
from tabulon.session import cut_lineage

SEED = 42
TOLERANCE = 1e-4
K_MAX = 10
KMEANS_COLUMN = "kmeans_cluster"
WARD_COLUMN = "agglomerative_cluster"
MICRO_CLUSTERS = 500
FINISH_ROWS = 2048
#: Pairs of points that are measured by differences at once.
PAIRS_AT_ONCE = 16_384

# Lower bounds of the silhouette bands and their report lines.
BANDS = [
    (0.5, True, "Since Silhouette Score is greater than or equal to 0.5, it is STRONG evidence of well-defined clusters."),
    (0.25, True, "Since Silhouette Score is in between 0.25 and 0.5, it is MODERATE evidence of well-defined clusters."),
    (-0.25, False, "Since Silhouette Score is in between -0.25 and 0.25, it is WEAK or No structure."),
    (-0.5, False, "Since Silhouette Score is in between -0.5 and -0.25, it May indicate that data points have been assigned to the wrong clusters."),
]
LOWEST_BAND = "Since Silhouette Score is smaller than or eqaul to -0.5, it is Strong evidence of misclassification or poor clustering structure."


# The report lines about the choice of k.
REASONS = {
    "elbow": "Elbow method suggests ",
    "silhouette": "Silhouette method suggests ",
    "clusters": " clusters.\n",
    "same": "Both methods suggest the same number of clusters: ",
    "far": "The difference between the two methods is significant.\n"
           " Choosing the number of clusters based on silhouette method.\n",
    "near": "The difference between the two methods is not significant."
            " Choosing the number of clusters based on their average.",
}


def assemble(df: DataFrame, columns: Sequence[str], out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=list(columns), outputCol=out).transform(df)


def kmeans_model(df: DataFrame, k: int, seed: int = SEED, max_iter: int = 300, spread: float | None = None) -> KMeansModel:
    """`spread` is the mean variance of the columns. With it the centres stop once they move by a small
    part of the data's own scale, instead of by a fixed distance that large units would never reach."""
    tol = 1e-4 if spread is None else max(math.sqrt(TOLERANCE * spread / k), 1e-12)
    return KMeans(k=k, seed=seed, maxIter=max_iter, tol=tol, featuresCol="features", predictionCol="_cluster").fit(df)


def total_spread(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row (wcss, n): the cost of a single cluster, from plain variances."""
    cost = sum((F.var_pop(c) * F.count(c) for c in columns), F.lit(0.0))
    return df.agg(cost.alias("wcss"), F.count(F.lit(1)).alias("n"))


@dataclass
class Sweep:
    """Both curves and the fitted models of one run over k."""

    curve: DataFrame
    models: dict[int, KMeansModel]


def sweep(df: DataFrame, columns: Sequence[str], k_max: int = K_MAX, parallelism: int = 5) -> Sweep:
    """Fit k = 2..k_max once; cost and silhouette of the same fits feed both curves.

    The silhouette is the squared-Euclidean one, which costs one pass per k. `df` should be persisted.
    """
    featured = assemble(df, columns)
    evaluator = ClusteringEvaluator(predictionCol="_cluster", featuresCol="features")
    total = total_spread(df, columns).head()
    spread = total["wcss"] / max(total["n"], 1) / len(columns)

    def run(k: int):
        model = kmeans_model(featured, k, spread=spread)
        clusters = len(model.clusterCenters())
        score = evaluator.evaluate(model.transform(featured)) if clusters > 1 else None
        return k, float(model.summary.trainingCost), score, model

    with ThreadPoolExecutor(parallelism) as pool:
        fits = list(pool.map(run, range(2, k_max + 1)))
    rows = [(1, float(total["wcss"]), None)] + [(k, cost, score) for k, cost, score, _ in fits]
    curve = df.sparkSession.createDataFrame(rows, "k int, wcss double, silhouette double")
    return Sweep(curve, {k: model for k, _, _, model in fits})


def elbow_distances(curve: DataFrame) -> DataFrame:
    """(k, wcss, distance) of the inner points to the line through the first and the last point."""
    ends = curve.agg(
        F.min_by("wcss", "k").alias("y1"), F.max_by("wcss", "k").alias("y2"),
        F.min("k").alias("x1"), F.max("k").alias("x2"),
    ).select(F.struct("*")).scalar()
    x1, y1, x2, y2 = (ends[c] for c in ("x1", "y1", "x2", "y2"))
    rise, run = y2 - y1, x2 - x1
    distance = F.abs(rise * F.col("k") - run * F.col("wcss") + x2 * y1 - y2 * x1) / F.sqrt(rise * rise + run * run)
    return curve.where((F.col("k") > x1) & (F.col("k") < x2)).select("k", "wcss", distance.alias("distance"))


def elbow_point(curve: DataFrame) -> DataFrame:
    """One row (elbow_k): the inner point with the largest distance, the lowest k on ties."""
    return elbow_distances(curve).agg(F.max_by("k", F.struct("distance", -F.col("k"))).alias("elbow_k"))


def best_silhouette(curve: DataFrame) -> DataFrame:
    """One row (silhouette_k): the k with the best score, the lowest k on ties."""
    scored = curve.where(F.col("silhouette").isNotNull())
    return scored.agg(F.max_by("k", F.struct("silhouette", -F.col("k"))).alias("silhouette_k"))


def chosen_k(elbow: Column, silhouette: Column) -> Column:
    """Equal: that one; one apart: the whole part of the mean; else the silhouette's."""
    return F.when(F.abs(elbow - silhouette) > 1, silhouette).otherwise(F.floor((elbow + silhouette) / 2).cast("int"))


def choice_reason(elbow: Column, silhouette: Column) -> Column:
    e, s = elbow.cast("string"), silhouette.cast("string")
    both = F.concat(F.lit(REASONS["elbow"]), e, F.lit(REASONS["clusters"]), F.lit(REASONS["silhouette"]), s, F.lit(REASONS["clusters"]))
    return (F.when(elbow == silhouette, F.concat(F.lit(REASONS["same"]), e, F.lit(".\n")))
            .when(F.abs(elbow - silhouette) > 1, F.concat(both, F.lit(REASONS["far"])))
            .otherwise(F.concat(both, F.lit(REASONS["near"]))))


def silhouette_band(score: Column) -> Column:
    out = F.lit(LOWEST_BAND)
    for bound, inclusive, text in reversed(BANDS):
        out = F.when(score >= bound if inclusive else score > bound, text).otherwise(out)
    return F.when(score.isNotNull(), out)


def elbow_curve(curve: DataFrame) -> DataFrame:
    """(k, wcss, is_elbow) for the elbow plot."""
    best = elbow_point(curve).scalar()
    return curve.select("k", "wcss", (F.col("k") == best).alias("is_elbow"))


def silhouette_curve(curve: DataFrame) -> DataFrame:
    """(k, silhouette, is_best) for the silhouette plot."""
    best = best_silhouette(curve).scalar()
    return curve.where("k > 1").select("k", "silhouette", (F.col("k") == best).alias("is_best"))


def exact_silhouettes(df: DataFrame, key: str, vector: str, cluster: str) -> DataFrame:
    """(key, silhouette) with Euclidean distances between all points: exact, and quadratic in the rows.

    Blocks return, per point and cluster, one sum of distances; no pair leaves a task.
    """
    points = df.select(F.col(key).alias("id"), F.col(cluster).alias("own"), F.col(vector).cast("array<double>").alias("v"))
    types = dict(points.dtypes)
    rows, width = points.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("v")), F.lit(1))).head()

    def members(side: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        codes, names = pd.factorize(side["own"], sort=True)
        member = np.zeros((len(side), len(names)))
        member[np.arange(len(side)), codes] = 1.0
        return np.asarray(names), member

    def sums_of(side: pd.DataFrame, names: np.ndarray, total: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({
            "id": np.repeat(side["id"].to_numpy(), len(names)), "own": np.repeat(side["own"].to_numpy(), len(names)),
            "other": np.tile(names, len(side)), "total": total.ravel(),
        })

    def kernel(a: pd.DataFrame, b: pd.DataFrame, both: bool) -> pd.DataFrame:
        left, right = matrix(a["v"]), matrix(b["v"])
        (left_names, left_member), (right_names, right_member) = members(a), members(b)
        total, back = np.zeros((len(a), len(right_names))), np.zeros((len(b), len(left_names)))
        for i, j, squared, error in rough_distances(left, right, right.mean(axis=0)):
            # Near points are measured again: a point is no neighbour of itself, its distance to itself is an exact zero.
            near = np.flatnonzero(squared.min(axis=1) <= 1e4 * error)
            row, col = np.nonzero(squared[near] <= 1e4 * error[near, None])
            row = near[row]
            for s in range(0, len(row), PAIRS_AT_ONCE):
                r, c = row[s:s + PAIRS_AT_ONCE], col[s:s + PAIRS_AT_ONCE]
                squared[r, c] = ((left[i][r] - right[j][c]) ** 2).sum(axis=1)
            away = np.sqrt(squared, out=squared)
            total[i] += away @ right_member[j]
            if both:
                back[j] += away.T @ left_member[i]
        found = sums_of(a, right_names, total)
        return pd.concat([found, sums_of(b, left_names, back)]) if both else found

    block = rows_of_block(rows, width, df.sparkSession.sparkContext.defaultParallelism)
    sums = block_pairs(points, points, "id", "id", kernel,
                       f"id {types['id']}, own {types['own']}, other {types['own']}, total double", rows, rows, block, once=True)
    sizes = points.groupBy(F.col("own").alias("other")).agg(F.count(F.lit(1)).alias("size"))
    means = sums.groupBy("id", "own", "other").agg(F.sum("total").alias("total")).join(sizes, "other")
    same = F.col("other") == F.col("own")
    scored = means.groupBy("id").agg(
        F.max(F.when(same, F.col("size"))).alias("size"),
        F.max(F.when(same, F.try_divide("total", F.col("size") - 1))).alias("a"),
        F.min(F.when(~same, F.col("total") / F.col("size"))).alias("b"),
    )
    widest = F.greatest("a", "b")
    value = F.when(F.col("size") == 1, F.lit(0.0)).otherwise(
        F.coalesce(F.try_divide(F.col("b") - F.col("a"), widest), F.lit(0.0)))
    return scored.select(F.col("id").alias(key), value.alias("silhouette"))


def exact_silhouette(df: DataFrame, key: str, vector: str, cluster: str) -> DataFrame:
    return exact_silhouettes(df, key, vector, cluster).agg(F.avg("silhouette").alias("silhouette"))


# --- Ward ---------------------------------------------------------------------------------------


def ward_merges(clusters: DataFrame, finish_rows: int = FINISH_ROWS) -> DataFrame:
    """All merges (keep, gone, cost) of Ward's tree over clusters (id, n, mean).

    Ward's criterion is reducible, so merging all pairs of mutual nearest neighbours in every round
    gives the greedy tree. Once at most `finish_rows` clusters are left, whatever the table held, one
    bounded block joins them up. The cost of merging a and b is na*nb/(na+nb) * |ma - mb|^2.
    """
    state = cut_lineage(clusters.select(F.col("id").cast("long"), F.col("n").cast("double"), F.col("mean").cast("array<double>")))
    merges: list[DataFrame] = []
    rows = state.count()
    while rows > finish_rows:
        pairs = cut_lineage(_mutual_neighbours(state, rows))
        merges.append(pairs.select("keep", "gone", "cost"))
        done = pairs.select(F.explode(F.array("keep", "gone")).alias("id"))
        joined = pairs.select(
            F.col("keep").alias("id"), (F.col("n_keep") + F.col("n_gone")).alias("n"),
            F.zip_with("mean_keep", "mean_gone", lambda x, y:
                       (x * F.col("n_keep") + y * F.col("n_gone")) / (F.col("n_keep") + F.col("n_gone"))).alias("mean"),
        )
        state = cut_lineage(state.join(done, "id", "left_anti").unionByName(joined))
        rows = state.count()
    merges.append(state.groupBy().applyInPandas(_finish, "keep long, gone long, cost double"))
    return cut_lineage(combine(*merges))


def _finish(left: pd.DataFrame) -> pd.DataFrame:
    """Greedy merges of a bounded number of clusters: the cheapest pair first, lowest ids on ties."""
    left = left.sort_values("id")
    ids, n, means = left["id"].to_numpy(), left["n"].to_numpy(dtype=float), matrix(left["mean"])
    cost = n[:, None] * n / (n[:, None] + n) * squared_distances(means, means)
    cost[np.tril_indices(len(ids))] = np.inf
    # The cheapest partner with a higher place of each cluster; a merge changes few of them.
    partner = cost.argmin(axis=1)
    least = cost[np.arange(len(ids)), partner]
    alive = np.ones(len(ids), bool)
    out = []
    for _ in range(len(ids) - 1):
        a = least.argmin()
        b = partner[a]
        out.append((ids[a], ids[b], least[a]))
        means[a] = (means[a] * n[a] + means[b] * n[b]) / (n[a] + n[b])
        n[a] += n[b]
        alive[b] = False
        cost[b, :], cost[:, b], least[b] = np.inf, np.inf, np.inf
        gap = np.where(alive, n * n[a] / (n + n[a]) * ((means - means[a]) ** 2).sum(axis=1), np.inf)
        cost[a, a + 1:], cost[:a, a] = gap[a + 1:], gap[:a]
        anew = np.flatnonzero(alive & ((partner == a) | (partner == b)))
        anew = np.union1d(anew, [a])
        partner[anew] = cost[anew].argmin(axis=1)
        least[anew] = cost[anew, partner[anew]]
        nearer = np.flatnonzero(alive[:a] & ((gap[:a] < least[:a]) | ((gap[:a] == least[:a]) & (a < partner[:a]))))
        partner[nearer], least[nearer] = a, gap[nearer]
    return pd.DataFrame(out, columns=["keep", "gone", "cost"])


def _keep_best(best: np.ndarray, other: np.ndarray, ids: np.ndarray, rows: np.ndarray, found: np.ndarray, cost: np.ndarray) -> None:
    """Take over what is cheaper than the best so far. Equal costs are ordered by (lower id, higher id): a total order on
    pairs, so a mutual pair exists."""
    own = ids[rows]
    order = np.lexsort((np.maximum(own, found), np.minimum(own, found), cost, rows))
    first = order[np.r_[True, rows[order][1:] != rows[order][:-1]]] if len(order) else order
    at, own, found, cost = rows[first], own[first], found[first], cost[first]
    low, high, was = np.minimum(own, found), np.maximum(own, found), other[at]
    tied = (cost == best[at]) & (was >= 0)
    lower = (low < np.minimum(own, was)) | ((low == np.minimum(own, was)) & (high < np.maximum(own, was)))
    take = (cost < best[at]) | (tied & lower)
    best[at[take]], other[at[take]] = cost[take], found[take]


def _mutual_neighbours(state: DataFrame, rows: int) -> DataFrame:
    def kernel(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        na, nb, ia, ib = (x[c].to_numpy() for c in ("n", "id") for x in (a, b))
        left, right = matrix(a["mean"]), matrix(b["mean"])
        best, other = np.full(len(a), np.inf), np.full(len(a), -1, np.int64)
        place = pd.Series(np.arange(len(b)), ib)
        for i, j, cost, error in rough_distances(left, right, right.mean(axis=0)):
            weight = na[i][:, None] * nb[j] / (na[i][:, None] + nb[j])
            np.multiply(np.maximum(cost, 0, out=cost), weight, out=cost)
            # A cluster is no neighbour of itself.
            self_at = place.reindex(ia[i], fill_value=-1).to_numpy() - j.start
            own = np.flatnonzero((self_at >= 0) & (self_at < cost.shape[1]))
            cost[own, self_at[own]] = np.inf
            slack = error * weight.max(axis=1)
            limit = np.minimum(cost.min(axis=1) + 2 * slack, best[i] + slack)
            row, col = np.nonzero(cost <= np.where(np.isfinite(limit), limit, -1)[:, None])
            for s in range(0, len(row), PAIRS_AT_ONCE):
                r, c = row[s:s + PAIRS_AT_ONCE], col[s:s + PAIRS_AT_ONCE]
                exact = weight[r, c] * ((left[i][r] - right[j][c]) ** 2).sum(axis=1)
                _keep_best(best, other, ia, i.start + r, ib[j][c], exact)
        found = np.isfinite(best)
        return pd.DataFrame({"id": ia[found], "other": other[found], "cost": best[found]})

    width = (state.select(F.size("mean")).head() or [1])[0]
    block = rows_of_block(rows, width, state.sparkSession.sparkContext.defaultParallelism)
    found = block_pairs(state, state, "id", "id", kernel, "id long, other long, cost double", rows, rows, block)
    pair = F.struct("cost", F.least("id", "other").alias("low"), F.greatest("id", "other").alias("high"))
    nearest = found.groupBy("id").agg(F.min_by(F.struct("other", "cost"), pair).alias("best")).select("id", "best.*")
    back = nearest.select(F.col("id").alias("other"), F.col("other").alias("id"))
    mutual = nearest.join(back, ["id", "other"]).where(F.col("id") < F.col("other"))
    keep = state.select(F.col("id"), F.col("n").alias("n_keep"), F.col("mean").alias("mean_keep"))
    gone = state.select(F.col("id").alias("other"), F.col("n").alias("n_gone"), F.col("mean").alias("mean_gone"))
    return mutual.join(keep, "id").join(gone, "other").select(
        F.col("id").alias("keep"), F.col("other").alias("gone"), "cost", "n_keep", "n_gone", "mean_keep", "mean_gone")


def cut_tree(ids: DataFrame, merges: DataFrame, k: int) -> DataFrame:
    """(id, cluster): undo the k - 1 most costly merges and number the remaining trees by their lowest id."""
    if k > 1:
        undone = merges.orderBy(F.col("cost").desc(), F.col("keep").desc(), F.col("gone").desc()).limit(k - 1)
        merges = merges.join(undone.select("gone"), "gone", "left_anti")
    links = ids.select("id").join(merges.select(F.col("gone").alias("id"), F.col("keep").alias("up")), "id", "left")
    links = cut_lineage(links.select("id", F.coalesce("up", "id").alias("up")))
    while True:
        above = links.select(F.col("id").alias("up"), F.col("up").alias("top"))
        jumped = cut_lineage(links.join(above, "up").select("id", "up", "top"))
        moved = not jumped.where(F.col("up") != F.col("top")).isEmpty()
        links = jumped.select("id", F.col("top").alias("up"))
        if not moved:
            break
    roots = with_position(links.select("up").distinct(), [], ["up"], "cluster")
    return links.join(roots, "up").select("id", F.col("cluster").cast("int").alias("cluster"))


def micro_clusters(df: DataFrame, columns: Sequence[str], count: int = MICRO_CLUSTERS) -> tuple[DataFrame, DataFrame]:
    """The rows with their micro-cluster `_micro`, and the at most `count` micro-clusters (id, n, mean)."""
    featured = assemble(df, columns)
    placed = kmeans_model(featured, count, max_iter=20).transform(featured).withColumnRenamed("_cluster", "_micro").drop("features")
    micro = placed.groupBy(F.col("_micro").cast("long").alias("id")).agg(
        F.count(F.lit(1)).alias("n"), F.array(*[F.avg(c) for c in columns]).alias("mean"))
    return placed, cut_lineage(micro)


def distinct_points(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(id, n, mean) of the distinct points, and their columns: what the exact tree starts from."""
    points = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))
    # Numbers differ from run to run until they are written.
    return cut_lineage(points.select(F.monotonically_increasing_id().alias("id"), "n", F.array(*[F.col(c).cast("double") for c in columns]).alias("mean"), *columns))


def ward_labels(df: DataFrame, columns: Sequence[str], k: int, micro: int | None = MICRO_CLUSTERS, out: str = WARD_COLUMN) -> DataFrame:
    """Attach Ward labels. At every size k-Means first sums all rows up in at most `micro` clusters and the tree
    starts from those; a row gets the label of its micro-cluster, so keys may repeat or be null.

    `micro=None` is the exact tree over all rows (equal rows are one point from the start): every round compares all
    clusters that are left with each other, so its cost grows with the square of the distinct rows."""
    if micro is None:
        points = distinct_points(df, columns)
        tree = cut_tree(points, ward_merges(points.select("id", "n", "mean")), k)
        own = [F.col(c).alias(f"_own_{i}") for i, c in enumerate(columns)]
        named = points.select("id", *own).join(tree, "id").drop("id").withColumnRenamed("cluster", "_ward")
        same = [df[c].eqNullSafe(F.col(f"_own_{i}")) for i, c in enumerate(columns)]
        return df.join(named, same, "left").select(*df.columns, F.col("_ward").alias(out))
    placed, start = micro_clusters(df, columns, max(micro, k))
    tree = cut_tree(start, ward_merges(start), k).select(F.col("id").cast("int").alias("_micro"), F.col("cluster").alias(out))
    # `micro` bounds the lookup, whatever the number of rows.
    return placed.join(F.broadcast(tree), "_micro", "left").drop("_micro")


def kmeans_labels(df: DataFrame, columns: Sequence[str], model: KMeansModel, out: str = KMEANS_COLUMN) -> DataFrame:
    placed = model.transform(assemble(df, columns))
    return placed.withColumnRenamed("_cluster", out).drop("features")


def cluster_labels(df: DataFrame, columns: Sequence[str], k: int, algorithm: str, model: KMeansModel | None = None,
                   micro: int | None = MICRO_CLUSTERS) -> DataFrame:
    """One label column for `k-Means` or `Agglomerative`, both for `both`; `micro` as in `ward_labels`."""
    if algorithm not in ("k-Means", "Agglomerative", "both"):
        raise ValueError(f"unknown clustering algorithm {algorithm!r}")
    if algorithm != "Agglomerative":
        if model is None:
            total = total_spread(df, columns).head()
            model = kmeans_model(assemble(df, columns), k, spread=total["wcss"] / max(total["n"], 1) / len(columns))
        df = kmeans_labels(df, columns, model)
    if algorithm != "k-Means":
        df = ward_labels(df, columns, k, micro)
    return df
