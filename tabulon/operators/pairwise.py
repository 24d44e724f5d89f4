"""All-pairs work in blocks of rows: nothing per pair is ever emitted, and nothing is held whole.

Rows are spread over blocks by the hash of their key. Every (left block, right block) is one task
group of bounded size, whose kernel returns an already reduced result.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a block at the least, and bytes of a block's vectors at the most. Each side is sent once a block of the other one, so
#: blocks are as large as a task can hold, unless there would be too few pairs of them for all cores.
ROWS_PER_BLOCK = 1024
BLOCK_BYTES = 32 << 20
PAIRS_PER_CORE = 4
#: Rows whose distances are held at once, of the left and the right side: 2 MB, which stay near the core.
SLICE = 256, 1024
#: Rounding error of one product, as a part of the squared lengths.
ROUNDING = 4e-16


def rows_of_block(rows: int, width: int, cores: int, block_bytes: int = BLOCK_BYTES) -> int:
    """Rows of a block for all pairs of `rows` vectors."""
    spread = -(-rows // max(1, math.isqrt(PAIRS_PER_CORE * cores)))
    return max(ROWS_PER_BLOCK, min(spread, block_bytes // (8 * max(1, width))))


def block_pairs(left: DataFrame, right: DataFrame, left_key: str, right_key: str,
                kernel: Callable[..., pd.DataFrame], schema: str,
                left_rows: int, right_rows: int, rows_per_block: int = ROWS_PER_BLOCK, once: bool = False) -> DataFrame:
    """Run the kernel on each pair of blocks. Each side is sent once per block of the other side.

    With `once`, for a table with itself, two different blocks meet once only, and the kernel's third argument
    tells whether the right side's results are wanted as well."""
    left_blocks = max(1, -(-left_rows // rows_per_block))
    right_blocks = max(1, -(-right_rows // rows_per_block))

    def spread(df: DataFrame, key: str, own: str, own_blocks: int, other: str, other_blocks: int) -> DataFrame:
        own_block = F.pmod(F.xxhash64(key), F.lit(own_blocks)).cast("int")
        first, last = F.lit(0), F.lit(other_blocks - 1)
        if once:
            first, last = (F.col(own), last) if own == "_l" else (first, F.col(own))
        return df.withColumn(own, own_block).withColumn(other, F.explode(F.sequence(first, last)))

    l = spread(left, left_key, "_l", left_blocks, "_r", right_blocks)
    r = spread(right, right_key, "_r", right_blocks, "_l", left_blocks)

    def run(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame({f.split()[0]: [] for f in schema.split(", ")})
        return kernel(a, b, key[0] != key[1]) if once else kernel(a, b)

    return l.groupBy("_l", "_r").cogroup(r.groupBy("_l", "_r")).applyInPandas(run, schema)


def matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.to_numpy()).astype(np.float64)


def augmented(vectors: np.ndarray, left: bool) -> np.ndarray:
    """Rows whose products with the other side's are squared distances."""
    square, one = np.einsum("ij,ij->i", vectors, vectors)[:, None], np.ones((len(vectors), 1))
    return np.hstack((-2.0 * vectors, square, one)) if left else np.hstack((vectors, one, square))


def rough_distances(a: np.ndarray, b: np.ndarray, middle: np.ndarray) -> Iterator[tuple[slice, slice, np.ndarray, np.ndarray]]:
    """Slices of both sides with their squared distances by a matrix product, and what each row's may be off by; lengths are
    taken from `middle`."""
    ends = [(slice(j, j + SLICE[1]), augmented(b[j:j + SLICE[1]] - middle, False)) for j in range(0, len(b), SLICE[1])]
    for i in range(0, len(a), SLICE[0]):
        own = slice(i, i + SLICE[0])
        start = augmented(a[own] - middle, True)
        for other, end in ends:
            yield own, other, start @ end.T, 4 * ROUNDING * (8 + a.shape[1]) * (start[:, -2] + end[:, -1].max())


def squared_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """|a - b|^2 by differences, in slices that keep the temporary array small."""
    out = np.empty((len(a), len(b)))
    step = max(1, 4_000_000 // max(1, b.size))
    for i in range(0, len(a), step):
        diff = a[i:i + step, None, :] - b[None, :, :]
        out[i:i + step] = np.einsum("ijk,ijk->ij", diff, diff)
    return out
