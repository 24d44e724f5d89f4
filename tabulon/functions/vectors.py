"""Expressions on arrays of numbers: sigmoid, softmax, argmax, distances, one-hot."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column | str, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once, also where the optimiser moves or merges projections."""
    return F.get(F.transform(F.array(_column(value)), body), F.lit(0))


def array_sum(values: Column | str) -> Column:
    return F.aggregate(_column(values), F.lit(0.0), lambda acc, x: acc + x)


def sigmoid(z: Column | str) -> Column:
    return 1 / (1 + F.exp(-_column(z)))


def softmax(z: Column | str) -> Column:
    """Shifted by the largest score, so that no exponential overflows."""
    powers = let(z, lambda v: let(F.array_max(v), lambda m: F.transform(v, lambda x: F.exp(x - m))))
    return let(powers, lambda e: let(array_sum(e), lambda t: F.transform(e, lambda x: x / t)))


def argmax(values: Column | str) -> Column:
    """Zero-based place of the largest value, the first one on ties."""
    return let(values, lambda v: (F.array_position(v, F.array_max(v)) - 1).cast("int"))


def one_hot(index: Column | str, classes: int) -> Column:
    index = _column(index)
    return F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda i: (i == index).cast("int"))


def squared_distance(a: Column | str, b: Column | str) -> Column:
    diff = F.zip_with(_column(a), _column(b), lambda x, y: (x.cast("double") - y) * (x.cast("double") - y))
    return array_sum(diff)
