"""Vector rules on ``array<double>`` columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_vector(text: Column | str) -> Column:
    """``"[1, 2.5e3]"`` to doubles; a bare number is a vector of one."""
    text = F.trim(_col(text).cast("string"))
    listed = F.from_json(text, "array<double>")
    single = F.array(text.try_cast("double"))
    return F.when(text.startswith("["), listed).when(text.try_cast("double").isNotNull(), single)


def zeros(n: Column | int) -> Column:
    return F.array_repeat(F.lit(0.0), F.lit(n) if isinstance(n, int) else n)


def fit_vector(vec: Column | str, n: Column | int) -> Column:
    """Cut a longer vector, pad a shorter one with zeros on the right."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.slice(F.concat(_col(vec), zeros(n)), F.lit(1), n)


def mask_range(vec: Column | str, first: int, stop: int) -> Column:
    """Zero the features ``first <= i < stop``."""
    return F.transform(
        _col(vec), lambda x, i: F.when((i >= first) & (i < stop), F.lit(0.0)).otherwise(x)
    )


def _squares(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: (x - y) * (x - y))


def vector_sum(vec: Column) -> Column:
    return F.aggregate(vec, F.lit(0.0), lambda acc, x: acc + x)


def mse(a: Column | str, b: Column | str) -> Column:
    a, b = _col(a), _col(b)
    return F.try_divide(vector_sum(_squares(a, b)), F.size(a))


def span_mse(a: Column | str, b: Column | str, spans: list[tuple[int, int]]) -> Column:
    """Sum over feature spans (both ends inclusive) of the mean squared error."""
    a, b = _col(a), _col(b)
    total = F.lit(0.0)
    for first, last in spans:
        n = last - first + 1
        total = total + mse(F.slice(a, first + 1, n), F.slice(b, first + 1, n))
    return total


def weighted_sum(series: Column | str, weights: Column | list[float]) -> Column:
    if isinstance(weights, list):
        weights = F.array(*[F.lit(float(w)) for w in weights])
    return vector_sum(F.zip_with(_col(series), weights, lambda x, w: x * w))
