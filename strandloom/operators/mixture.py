"""Gaussian mixtures by expectation-maximisation; parameters live on the driver, data on executors."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass
class Mixture:
    probs: list[float]
    means: list
    variances: list
    rounds: int
    converged: bool = True


def _density(x: Column, mean: float, variance: float) -> Column:
    scale = 1.0 / math.sqrt(2.0 * math.pi * variance)
    return F.lit(scale) * F.exp(-F.pow(x - F.lit(mean), F.lit(2)) / (2.0 * variance))


def univariate_mixture(
    df: DataFrame, column: str, means, variances, probs, tol: float = 1e-5, max_rounds: int = 100
) -> Mixture:
    """Fit by EM until no parameter moves by more than ``tol``.

    Every round is one aggregation: per component the sums of r, r*x and r*x*x.
    """
    x = F.col(column).cast("double")
    data = df.select(x.alias("x")).filter(F.col("x").isNotNull()).persist()
    n = data.count()
    means, variances, probs = list(map(float, means)), list(map(float, variances)), list(map(float, probs))
    k = len(means)
    rounds, converged = 0, False
    while rounds < max_rounds and not converged:
        rounds += 1
        parts = [F.lit(probs[i]) * _density(F.col("x"), means[i], variances[i]) for i in range(k)]
        total = sum(parts[1:], parts[0])
        sums = data.agg(
            *[F.sum(parts[i] / total).alias(f"r{i}") for i in range(k)],
            *[F.sum(parts[i] / total * F.col("x")).alias(f"m{i}") for i in range(k)],
            *[F.sum(parts[i] / total * F.col("x") * F.col("x")).alias(f"s{i}") for i in range(k)],
        ).first()
        new_p = [sums[f"r{i}"] / n for i in range(k)]
        new_m = [sums[f"m{i}"] / sums[f"r{i}"] for i in range(k)]
        new_v = [sums[f"s{i}"] / sums[f"r{i}"] - new_m[i] ** 2 for i in range(k)]
        moved = max(
            abs(a - b) for old, new in ((probs, new_p), (means, new_m), (variances, new_v)) for a, b in zip(old, new)
        )
        probs, means, variances = new_p, new_m, new_v
        converged = moved <= tol
    data.unpersist()
    return Mixture(probs, means, variances, rounds, converged)


def univariate_labels(df: DataFrame, column: str, fit: Mixture) -> DataFrame:
    """Add ``component`` (from 1), the one holding more than half of the responsibility."""
    x = F.col(column).cast("double")
    parts = [F.lit(p) * _density(x, m, v) for p, m, v in zip(fit.probs, fit.means, fit.variances)]
    total = sum(parts[1:], parts[0])
    label = F.lit(None).cast("int")
    for i, p in enumerate(parts):
        label = F.when(p / total > 0.5, F.lit(i + 1)).otherwise(label)
    return df.withColumn("component", label)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A batch of rows as the bytes of one matrix."""
    for batch in batches:
        x = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], axis=1)
        yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary())], names=["block"])


def _moments(probs: np.ndarray, means: np.ndarray, covs: np.ndarray):
    """Sums over a partition: log likelihood, then weight, first and second moments of every component.

    The parameters travel with the function, so all rounds run one and the same compiled plan.
    """
    inverse = np.linalg.inv(covs)
    norm = -0.5 * (means.shape[1] * math.log(2 * math.pi) + np.log(np.linalg.det(covs)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, dim = means.shape
        total = np.zeros(1 + k * (1 + dim + dim * dim))
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                x = np.frombuffer(raw).reshape(-1, dim)
                # One component at a time, so that all products are of two matrices.
                parts = np.empty((k, len(x)))
                for c in range(k):
                    away = x - means[c]
                    parts[c] = np.einsum("ni,ni->n", away @ inverse[c], away)
                parts = probs[:, None] * np.exp(norm[:, None] - 0.5 * parts)
                whole = parts.sum(0)
                r = parts / whole
                total[0] += np.log(whole).sum()
                second = [(x.T * r[c]) @ x for c in range(k)]
                total[1:] += np.concatenate([r.sum(1), (r @ x).reshape(-1), np.reshape(second, -1)])
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["total"])

    return run


@dataclass
class _Round:
    """Parameters after a round, the halved likelihood term of the stopping rule, and the log likelihood before it."""

    probs: np.ndarray
    means: np.ndarray
    covs: np.ndarray
    like: float = 0.0
    before: float = -math.inf

    def flat(self) -> np.ndarray:
        return np.concatenate([self.probs, self.means.reshape(-1), self.covs.reshape(-1)])

    def like_shape(self, flat: np.ndarray) -> _Round:
        k, dim = self.means.shape
        return _Round(flat[:k], flat[k: k + k * dim].reshape(k, dim), flat[k + k * dim:].reshape(k, dim, dim))

    def valid(self) -> bool:
        return bool((self.probs > 0).all() and np.isfinite(self.flat()).all() and (np.linalg.eigvalsh(self.covs) > 0).all())


def _em_round(blocks: DataFrame, n: int, at: _Round) -> _Round:
    k, dim = at.means.shape
    rows = blocks.mapInArrow(_moments(at.probs, at.means, at.covs), "total binary").collect()
    sums = sum(np.frombuffer(r.total) for r in rows)
    w, first, second = sums[1: 1 + k], sums[1 + k: 1 + k + k * dim].reshape(k, dim), sums[1 + k + k * dim:].reshape(k, dim, dim)
    means = first / w[:, None]
    covs = second / w[:, None, None] - means[:, :, None] * means[:, None, :]
    # The sum of r * log density follows from the moments just computed.
    norm = -0.5 * (dim * math.log(2 * math.pi) + np.log(np.linalg.det(covs)))
    like = float((-0.5 * w * (norm - 0.5 * (np.linalg.inv(covs) * covs).sum((1, 2)))).sum())
    return _Round(w / n, means, covs, like, float(sums[0]))


def multivariate_mixture(
    df: DataFrame, columns: list[str], means, covariances, probs, tol: float = 1e-12, max_rounds: int = 1500, accelerate: bool = False
) -> Mixture:
    """Fit by EM; stops when the smallest change among log likelihood and probabilities of two rounds is within ``tol``.

    The likelihood term is halved. A round sends one row of moments per partition to the driver. Rows with a NULL are left out.
    ``accelerate`` takes a squared extrapolation step after every two rounds where it does not lower the likelihood. It ends at the same
    stopping rule and fixed point as plain rounds, in far fewer of them.
    """
    data = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).dropna()
    blocks = data.mapInArrow(_blocks, "block binary").persist()
    n = sum(r.n for r in blocks.select((F.length("block") / (8 * len(columns))).cast("long").alias("n")).groupBy().agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).collect())
    now = _Round(np.asarray(probs, float), np.asarray(means, float), np.asarray(covariances, float))
    rounds, converged = 0, n == 0

    def advance(at: _Round) -> _Round:
        nonlocal rounds, converged
        new = _em_round(blocks, n, at)
        rounds += 1
        converged = min(abs(new.like - at.like), *np.abs(new.probs - at.probs)) <= tol
        return new

    while rounds < max_rounds and not converged:
        one = advance(now)
        if not accelerate or converged or rounds == max_rounds:
            now = one
            continue
        two = advance(one)
        step, bend = one.flat() - now.flat(), two.flat() - 2 * one.flat() + now.flat()
        far = now.like_shape(now.flat() + 2 * (a := max(1.0, np.linalg.norm(step) / max(np.linalg.norm(bend), 1e-300))) * step + a * a * bend)
        now = two
        if not converged and rounds < max_rounds and far.valid():
            jump = _em_round(blocks, n, far)
            rounds += 1
            if jump.before >= two.before and jump.valid():
                now = jump
    blocks.unpersist()
    return Mixture(now.probs.tolist(), now.means.tolist(), now.covs.tolist(), rounds, converged)
