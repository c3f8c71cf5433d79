"""Cross-product matrices: the one thing the linear models need from the data.

A matrix is a single aggregate whose sums combine on the map side; only the matrix,
whose size depends on the number of variables and groups, reaches the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridpanel.operators.order_stats import null_safe_join
from gridpanel.session import written


def _sums(columns: Sequence[Column], weight: Column | None, name: str) -> list[Column]:
    k = len(columns)
    out = []
    for i in range(k):
        for j in range(i, k):
            term = columns[i] * columns[j]
            out.append(F.sum(term if weight is None else weight * term).alias(f"{name}_{i}_{j}"))
    return out


def _matrix(row, k: int, name: str) -> np.ndarray:
    m = np.zeros((k, k))
    for i in range(k):
        for j in range(i, k):
            m[i, j] = m[j, i] = row[f"{name}_{i}_{j}"] or 0.0
    return m


def cross_products(
    df: DataFrame, columns: Sequence[Column], by: Sequence[str] = ()
) -> dict[tuple, np.ndarray]:
    """Per group the symmetric matrix of sum(a * b)."""
    k = len(columns)
    named = df.select(*by, *[c.alias(f"_c{i}") for i, c in enumerate(columns)])
    found = named.groupBy(*by).agg(*_sums([F.col(f"_c{i}") for i in range(k)], None, "s"))
    return {tuple(row[b] for b in by): _matrix(row, k, "s") for row in found.collect()}


class PanelProducts:
    """Products of rows and of customer means for all groups of a panel, in one small table.

    The table has a row per group for the rows' own products (`_t` NULL), and one per group and T for the
    products of the means of customers with T rows. It is written to the checkpoint folder once. Every matrix
    of every group, whatever its weights, comes out of one aggregate over it.
    """

    def __init__(self, rows: DataFrame, columns: Sequence[Column], id_col: str, by: Sequence[str] = ()):
        self.k, self.by = len(columns), list(by)
        names = [f"_c{i}" for i in range(self.k)]
        named = rows.select(*by, F.col(id_col).alias("_id"), *[c.alias(n) for c, n in zip(columns, names)])
        sums = _sums([F.col(n) for n in names], None, "s")
        whole = named.groupBy(*by).agg(F.lit(None).cast("double").alias("_t"), *sums)
        ids = named.groupBy(*by, "_id").agg(
            F.count(F.lit(1)).cast("double").alias("_t"), *[F.avg(n).alias(n) for n in names]
        )
        self.table = written(whole.unionByName(ids.groupBy(*by, "_t").agg(*sums)))

    def _weighted(self, table: DataFrame, keys: Sequence[str], weights: Mapping[str, Column]) -> dict[tuple, dict[str, np.ndarray]]:
        """{key: {name: sum of weight times products}}, the weights being columns of `table`."""
        named = F.array(*[F.struct(F.lit(name).alias("_name"), w.alias("_w")) for name, w in weights.items()])
        copies = table.select(*keys, *self._names(), F.inline(named)).filter(F.col("_w").isNotNull())
        sums = [F.sum(F.col("_w") * F.col(c)).alias(c) for c in self._names()]
        out: dict[tuple, dict[str, np.ndarray]] = {}
        for row in copies.groupBy(*keys, "_name").agg(*sums).collect():
            out.setdefault(tuple(row[k] for k in keys), {})[row["_name"]] = _matrix(row, self.k, "s")
        return out

    def _names(self) -> list[str]:
        return [f"s_{i}_{j}" for i in range(self.k) for j in range(i, self.k)]

    def totals(self) -> dict[tuple, dict[str, np.ndarray]]:
        """Per group: products of rows `a`, and of means times T `b1`, 1 `b2` and T squared `s2`."""
        t = F.col("_t")
        own = F.when(t.isNull(), 1.0)
        return self._weighted(self.table, self.by, {"a": own, "b1": t, "b2": F.when(t.isNotNull(), 1.0), "s2": t * t})

    def weighted(
        self, parameters: Sequence[tuple], names: Sequence[str], weights: Callable[..., Mapping[str, Column]]
    ) -> dict[tuple, dict[str, np.ndarray]]:
        """Matrices of weights that depend on T and on parameters of each (group..., label).

        `parameters` has a tuple (group..., label, numbers...) for each result, with a number for each of `names`.
        """
        kinds = [self.table.schema[b].dataType.simpleString() for b in self.by]
        kinds = [f"`{b}` {k}" for b, k in zip(self.by, kinds)] + ["_label string"] + [f"{n} double" for n in names]
        small = self.table.sparkSession.createDataFrame(list(parameters), ", ".join(kinds))
        joined = null_safe_join(self.table.filter("_t is not null"), small, self.by, "inner")
        return self._weighted(joined, [*self.by, "_label"], weights(F.col("_t"), *[F.col(n) for n in names]))


def independent(gram: np.ndarray, tolerance: float = 1e-9) -> list[int]:
    """Columns, in order, that are not linear combinations of earlier ones."""
    rest, scale, kept = gram.astype(float).copy(), np.diag(gram).copy(), []
    for j in range(len(gram)):
        if rest[j, j] > tolerance * max(scale[j], 1e-300) and rest[j, j] > 1e-12:
            kept.append(j)
            rest = rest - np.outer(rest[:, j], rest[j, :]) / rest[j, j]
    return kept


def least_squares(gram: np.ndarray, target: np.ndarray, total: float):
    """Coefficients (NaN where dropped), residual sum of squares, inverse, kept columns."""
    kept = independent(gram)
    inverse = np.linalg.inv(gram[np.ix_(kept, kept)]) if kept else np.zeros((0, 0))
    found = inverse @ target[kept]
    coefficients = np.full(len(gram), np.nan)
    coefficients[kept] = found
    return coefficients, max(0.0, float(total - target[kept] @ found)), inverse, kept


def trace_product(left: np.ndarray, right: np.ndarray, kept: Sequence[int]) -> float:
    """trace(inv(left) @ right) over the kept columns."""
    at = np.ix_(kept, kept)
    return float(np.trace(np.linalg.solve(left[at], right[at])))
