"""Many small models over the same rows at once: sums of all of them in one pass, rows where they are.

A model is a weighting of the rows (a bootstrap replicate, all rows but one subject's). Each task adds up its rows' sums for every model as
matrix products, so a pass shuffles one row a task and model, and the driver gets as many numbers as the models have sums.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows whose sums a task takes at once.
BLOCK = 500

Weights = Callable[[pd.DataFrame], np.ndarray]


def stacked_sums(rows: DataFrame, sums: Callable[[pd.DataFrame], np.ndarray], models: int, width: int) -> np.ndarray:
    """The ``models`` x ``width`` matrix that ``sums`` gives for each batch of ``rows``, added up over all of them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((models, width))
        for pdf in batches:
            # Blocks of few rows, so that a block's numbers of all models stay in the processor's cache.
            for at in range(0, len(pdf), BLOCK):
                total += sums(pdf.iloc[at : at + BLOCK])
        yield pd.DataFrame({"model": np.arange(models), "s": list(total)})

    parts = rows.mapInPandas(run, "model int, s array<double>")
    out = np.zeros((models, width))
    for r in parts.groupBy("model").agg(F.array(*[F.sum(F.get("s", F.lit(i))) for i in range(width)]).alias("s")).collect():
        out[r["model"]] = r["s"]
    return out


def design(pdf: pd.DataFrame, features: Sequence[str]) -> np.ndarray:
    return np.column_stack([np.ones(len(pdf)), *[pdf[f].to_numpy(float) for f in features]])


def products(x: np.ndarray) -> np.ndarray:
    """For each row all products of two of its values, as one row."""
    return (x[:, :, None] * x[:, None, :]).reshape(len(x), -1)


def least_squares_fits(sums: np.ndarray) -> np.ndarray:
    """Intercept and coefficients of each model from its row of sums of ``products``, the last column being the target's; of least norm where columns are collinear."""
    k = int(np.sqrt(sums.shape[1])) - 1
    return np.array([np.linalg.lstsq(m[:k, :k], m[:k, k], rcond=None)[0] for m in sums.reshape(-1, k + 1, k + 1)])


def stacked_logistic(rows: DataFrame, features: Sequence[str], label: str, weights: Weights, models: int, penalty: float = 1.0, scales: np.ndarray | None = None, steps: int = 100, tolerance: float = 1e-8, start: np.ndarray | None = None, beside: tuple[Callable[[pd.DataFrame], np.ndarray], int, list] | None = None) -> np.ndarray:
    """Intercept and coefficients of an L2-penalised logistic model for each weighting, by Newton steps that all take together.

    ``scales`` (models x 2 x features: means and deviations) scales the features for each model, and the penalty holds for the scaled ones; the
    coefficients that come back are those of the features as they are. A model that has not converged after ``steps`` steps is an error. ``start`` has the coefficients,
    in the models' scale, from which all begin: near to their own they need few steps. ``beside`` has other sums of the same rows, their width and a list to
    which the first pass appends them.
    """
    k = len(features) + 1
    # In a model's scale a row is ``t @ x``, so sums over rows as they are give its gradient and Hessian.
    t = np.tile(np.eye(k), (models, 1, 1))
    if scales is not None:
        t[:, range(1, k), range(1, k)] = 1 / scales[:, 1]
        t[:, 1:, 0] = -scales[:, 0] / scales[:, 1]
    beta, ridge = np.zeros((models, k)) if start is None else np.tile(start, (models, 1)), np.diag([0.0, *[penalty] * (k - 1)])
    for i in range(steps):
        raw = np.einsum("mji,mj->mi", t, beta)
        more, wide, found = beside if beside and i == 0 else (None, 0, [])

        def sums(pdf: pd.DataFrame) -> np.ndarray:
            x, w = design(pdf, features), weights(pdf)
            p = 1 / (1 + np.exp(-np.clip(x @ raw.T, -500, 500)))
            return np.hstack([(w * (pdf[label].to_numpy(float)[:, None] - p)).T @ x, (w * p * (1 - p)).T @ products(x), *([more(pdf)] if more else [])])

        s = stacked_sums(rows, sums, models, k + k * k + wide)
        found.append(s[:, k + k * k :])
        s = s[:, : k + k * k]
        grad = np.einsum("mij,mj->mi", t, s[:, :k]) - beta @ ridge
        hess = t @ s[:, k:].reshape(models, k, k) @ t.transpose(0, 2, 1) + ridge
        step = np.array([np.linalg.lstsq(h, g, rcond=None)[0] for h, g in zip(hess, grad)])
        beta = beta + step
        if np.abs(step).max() <= tolerance:
            return np.einsum("mji,mj->mi", t, beta)
    raise RuntimeError(f"{int((np.abs(step).max(axis=1) > tolerance).sum())} models have not converged after {steps} steps")


@cache
def _poisson_table() -> tuple[np.ndarray, np.ndarray]:
    """Where the counts of Poisson(1) end, in steps of 2^-53, and the count for each 16 leading bits; NaN where it ends within them."""
    ends = np.cumsum([np.exp(-1.0) / np.prod(np.arange(1, k + 1, dtype=float)) for k in range(16)])
    low = np.arange(1 << 16) / 2.0**16
    first, last = (np.searchsorted(ends, u, "right").astype(float) for u in (low, low + (2.0**37 - 1) / 2.0**53))
    return ends, np.where(first == last, first, np.nan)


def poisson_counts(row: np.ndarray, replicates: int, seed: int) -> np.ndarray:
    """rows x (replicates + 1): how often each replicate draws a row, Poisson(1), from a hash of its number; replicate 0 is the rows as they are."""
    ends, table = _poisson_table()
    x = row.astype(np.int64).view(np.uint64)[:, None] + (np.arange(1, replicates + 1, dtype=np.uint64) + np.uint64(seed << 32)) * np.uint64(0x9E3779B97F4A7C15)
    for shift, times in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(times)
    x ^= x >> np.uint64(31)
    out = np.ones((len(row), replicates + 1))
    drawn = table.take((x >> np.uint64(48)).astype(np.int64))
    # Few hashes lie in a step in which a count ends; they are compared with all ends.
    edge = np.isnan(drawn)
    drawn[edge] = np.searchsorted(ends, (x[edge] >> np.uint64(11)).astype(float) / 2.0**53, "right")
    out[:, 1:] = drawn
    return out
