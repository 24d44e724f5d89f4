"""Blocks of pairs: how large they are, and that two blocks meet once."""

import numpy as np
import pandas as pd

from tabulon.operators import clustering as C
from tabulon.operators import pairwise as P


def test_blocks_grow_with_the_rows():
    sent = [n * -(-n // P.rows_of_block(n, 64, 12)) for n in (10_000, 100_000, 600_000)]
    assert sent[1] <= 10 * sent[0] and sent[2] <= 10 * sent[1]
    assert P.rows_of_block(600_000, 64, 12) * 64 * 8 <= P.BLOCK_BYTES


def test_blocks_meet_once(spark):
    rows = spark.range(200)
    met = P.block_pairs(rows, rows, "id", "id", lambda a, b, both: pd.DataFrame({"n": [len(a) * len(b) * (2 if both else 1)]}),
                        "n long", 200, 200, 50, once=True).collect()
    assert len(met) <= 10 and sum(r.n for r in met) == 200 * 200


def test_silhouettes_of_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(P, "ROWS_PER_BLOCK", 40)
    monkeypatch.setattr(P, "SLICE", (7, 16))
    draw = np.random.default_rng(5)
    x, own = np.round(draw.normal(size=(150, 3)) + 1e3, 3), draw.integers(0, 4, 150)
    x[20:40] = x[0]
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    size = np.bincount(own)
    a = np.array([d[i, own == own[i]].sum() / (size[own[i]] - 1) for i in range(150)])
    b = np.array([min(d[i, own == c].mean() for c in range(4) if c != own[i]) for i in range(150)])
    df = spark.createDataFrame([(i, v.tolist(), int(c)) for i, (v, c) in enumerate(zip(x, own))], "id long, v array<double>, c int")
    got = {r.id: r.silhouette for r in C.exact_silhouettes(df, "id", "v", "c").collect()}
    assert np.allclose([got[i] for i in range(150)], (b - a) / np.maximum(a, b), atol=1e-9)


def test_draws_by_bounds(spark):
    from tabulon.operators import splits as S
    from pyspark.sql import functions as F
    values = [0.0, 0.2, S.DRAW_BOUNDS[0], 0.5, S.DRAW_BOUNDS[1], 0.8, S.DRAW_BOUNDS[5], S.DRAW_BOUNDS[-1], 1.0 - 2 ** -53]
    got = spark.createDataFrame([(v,) for v in values], "u double").select("u", S.draw_counts(F.col("u")).alias("n")).collect()
    assert all(r.n == sum(b <= r.u for b in S.DRAW_BOUNDS) for r in got)


def test_tasks_have_bounded_rows(spark):
    from tabulon.sources.tables import bounded_tasks
    one = spark.range(1000).coalesce(1)
    assert max(bounded_tasks(one, 100).rdd.glom().map(len).collect()) <= 120
    assert bounded_tasks(one, 1000).rdd.getNumPartitions() == 1
