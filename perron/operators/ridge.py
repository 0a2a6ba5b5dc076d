"""RDG-01..03: closed-form ridge from summed normal equations; penalties chosen in one pass over validation rows."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import ALPHAS


def degree_two(columns: list[str]) -> list[Column]:
    """MTH-07: products of every two columns, each with itself included."""
    return [(F.col(a) * F.col(b)).alias(f"{a}*{b}") for i, a in enumerate(columns) for b in columns[i:]]


def gram(df: DataFrame, columns: list[str], target: str, adders: int = 8) -> np.ndarray:
    """AGG-16: [1 X y]'[1 X y], summed by partition, then by a bounded number of tasks."""
    k = len(columns) + 2
    rows = df.select(*[F.col(c).cast("double").alias(c) for c in [*columns, target]]).where(F.col(target).isNotNull() & ~F.isnan(target))

    def partial(batches):
        total = np.zeros((k, k))
        for b in batches:
            x = np.column_stack([np.ones(b.num_rows), *[np.nan_to_num(c.to_numpy(zero_copy_only=False)) for c in b.columns]])
            total += x.T @ x
        yield pa.RecordBatch.from_pydict({"g": [total.tobytes()]})

    def add(batches):
        total = np.zeros((k, k))
        for b in batches:
            for g in b.column(0).to_pylist():
                total += np.frombuffer(g).reshape(k, k)
        yield pa.RecordBatch.from_pydict({"g": [total.tobytes()]})

    parts = rows.mapInArrow(partial, "g binary").repartition(adders).mapInArrow(add, "g binary").collect()
    return sum((np.frombuffer(p.g).reshape(k, k) for p in parts), np.zeros((k, k)))


@dataclass
class Ridge:
    columns: list[str]
    weights: np.ndarray
    intercept: float

    def predict(self) -> Column:
        out = F.lit(float(self.intercept))
        for c, w in zip(self.columns, self.weights):
            out = out + F.coalesce(F.col(c).cast("double"), F.lit(0.0)) * float(w)
        return out


def naive_scale(target_mean: float, naive_mean: float | None) -> float:
    """NAI-01: 60 where the target's mean tells seconds against a naive column in minutes (more than 20 times as large)."""
    return 60.0 if naive_mean is not None and target_mean is not None and target_mean > 20 * naive_mean else 1.0


def naive(column: str, by: dict[str, tuple[float, float]], scale: float = 1.0) -> Column:
    """RDG-03: the scaled column as the naive prediction, back in its own unit times ``scale``."""
    mean, std = by.get(column, (0.0, 1.0))
    return (F.col(column) * std + mean) * scale


def solve(g: np.ndarray, columns: list[str], alpha: float) -> Ridge:
    """(X'X + alpha I)^-1 X'(y - mean y) with the mean as intercept; columns are expected standardised."""
    n = max(g[0, 0], 1.0)
    mean = g[0, -1] / n
    xy = g[1:-1, -1] - g[0, 1:-1] * mean
    return Ridge(columns, np.linalg.solve(g[1:-1, 1:-1] + alpha * np.eye(len(columns)), xy), mean)


def fit(train: DataFrame, columns: list[str], target: str, val: DataFrame | None = None, alphas: list[float] = ALPHAS) -> Ridge:
    """With validation rows, the first penalty of the least MAE on them."""
    g = gram(train, columns, target)
    models = [solve(g, columns, a) for a in alphas]
    if val is None or len(models) == 1:
        return models[0]
    maes = val.agg(*[F.avg(F.abs(F.col(target) - m.predict())).alias(str(i)) for i, m in enumerate(models)]).first()
    return models[min(range(len(models)), key=lambda i: (maes[i] is None, maes[i], i))]
