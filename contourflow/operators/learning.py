"""Supervised datasets and Gaussian-process surrogates."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def point_dataset(df: DataFrame, target: str, features: Sequence[str] | None = None) -> tuple[DataFrame, list[str]]:
    """Features and target without rows that miss any; features default to ``pca0, pca1, ...`` in numeric order."""
    if features is None:
        features = sorted((c for c in df.columns if c.startswith("pca") and c[3:].isdigit()), key=lambda c: int(c[3:]))
    return df.select(*features, target).dropna(), list(features)


def relax_steps(df: DataFrame, energies: str = "E_bfgs_steps_Ry", coordinates: str = "z_H_bfgs_steps_A", name: str = "distance", keep: Sequence[str] = ("point_index",)) -> DataFrame:
    """One row per relaxation step: ``bfgs_step``, the energy and the coordinate. Empty histories are skipped; unequal ones are an error."""
    same = F.when(F.size(energies) == F.size(coordinates), F.arrays_zip(F.col(energies).alias("e"), F.col(coordinates).alias("c")))
    checked = F.coalesce(same, F.when(F.lit(True), F.raise_error(F.lit("histories differ in length")).cast("array<struct<e:double,c:double>>")))
    rows = df.where((F.size(F.coalesce(energies, F.array())) > 0) | (F.size(F.coalesce(coordinates, F.array())) > 0))
    rows = rows.select(*keep, F.posexplode(checked).alias("bfgs_step", "s"))
    return rows.select(*keep, "bfgs_step", F.col("s.e").alias(energies.replace("_steps", "_step")), F.col("s.c").alias(name))


def warm_starts(features: Sequence[str], coordinates: Sequence[str] = ("distance",), coordinate_scale: float = 0.5, pc_scale: float = 5.0, random: int = 12, seed: int = 0) -> list[np.ndarray]:
    """Deterministic initial length scales: the base, its half, its double, its inverse weighting, ones, and log-normal draws around it."""
    base = np.array([coordinate_scale if f in coordinates else pc_scale for f in features], float)
    rng = np.random.default_rng(seed)
    fixed = [base, base / 2, base * 2, base[::-1].copy(), np.ones(len(base))]
    return fixed + [base * np.exp(rng.normal(0, 0.7, len(base))) for _ in range(random)]


@dataclass
class GaussianProcess:
    """Constant times anisotropic RBF plus white noise on standardised features and target.

    Hyperparameters, in logarithms, climb the log marginal likelihood from several starts, each a bounded
    gradient ascent with backtracking; the start with the best cross-validated error (mean, then spread)
    wins. Training sets are the few labelled points; predictions run over Arrow batches.
    """

    features: Sequence[str]
    target: str
    starts: list[np.ndarray] = field(default_factory=list)
    folds: int = 5
    seed: int = 0
    records: list[dict] = field(default_factory=list)

    def _kernel(self, a: np.ndarray, b: np.ndarray, theta: np.ndarray) -> np.ndarray:
        scale = np.exp(theta[1:-1])
        d = ((a[:, None] / scale - b[None] / scale) ** 2).sum(axis=2)
        return np.exp(theta[0]) * np.exp(-0.5 * d)

    def _likelihood(self, x: np.ndarray, y: np.ndarray, theta: np.ndarray) -> tuple[float, np.ndarray]:
        n = len(x)
        k0 = self._kernel(x, x, theta)
        k = k0 + np.exp(theta[-1]) * np.eye(n) + 1e-10 * np.eye(n)
        low = np.linalg.cholesky(k)
        inverse = np.linalg.inv(k)
        alpha = inverse @ y
        value = -0.5 * y @ alpha - np.log(np.diag(low)).sum() - 0.5 * n * np.log(2 * np.pi)
        w = np.outer(alpha, alpha) - inverse
        grad = np.empty(len(theta))
        grad[0] = 0.5 * (w * k0).sum()
        for j in range(x.shape[1]):
            d = ((x[:, None, j] - x[None, :, j]) / np.exp(theta[1 + j])) ** 2
            grad[1 + j] = 0.5 * (w * k0 * d).sum()
        grad[-1] = 0.5 * np.exp(theta[-1]) * np.trace(w)
        return float(value), grad

    def _climb(self, x: np.ndarray, y: np.ndarray, theta: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, float]:
        low = np.log(np.r_[1e-3, np.full(x.shape[1], 1e-2), 1e-3])
        high = np.log(np.r_[1e3, np.full(x.shape[1], 1e2), 1.0])
        theta = np.clip(theta, low, high)
        value, grad = self._likelihood(x, y, theta)
        step = 0.1
        for _ in range(rounds):
            new = np.clip(theta + step * grad / max(1.0, np.abs(grad).max()), low, high)
            got, g = self._likelihood(x, y, new)
            if got > value:
                if got - value < 1e-7:
                    theta, value = new, got
                    break
                theta, value, grad, step = new, got, g, step * 1.5
            else:
                step /= 2
                if step < 1e-6:
                    break
        return theta, value

    def fit_arrays(self, x: np.ndarray, y: np.ndarray) -> GaussianProcess:
        self.mean, self.std = x.mean(axis=0), np.where(x.std(axis=0) > 0, x.std(axis=0), 1.0)
        self.y_mean, self.y_std = float(y.mean()), float(y.std()) or 1.0
        xs, ys = (x - self.mean) / self.std, (y - self.y_mean) / self.y_std
        starts = self.starts or warm_starts(self.features, seed=self.seed)
        order = np.random.default_rng(self.seed).permutation(len(x))
        parts = np.array_split(order, min(self.folds, len(x)))
        best = None
        for s in starts:
            theta, value = self._climb(xs, ys, np.log(np.r_[1.0, s, 1e-3]))
            errors = []
            for part in parts:
                rest = np.setdiff1d(order, part)
                if len(rest):
                    p = self._posterior(xs[rest], ys[rest], xs[part], theta)[0]
                    errors.append(float(np.sqrt(np.mean((p - ys[part]) ** 2))) * self.y_std)
            record = {"start": s.tolist(), "cv_rmse_mean": float(np.mean(errors or [0.0])), "cv_rmse_std": float(np.std(errors or [0.0])), "log_marginal_likelihood": value, "theta": theta}
            self.records.append(record)
            key = (record["cv_rmse_mean"], record["cv_rmse_std"])
            if best is None or key < best[0]:
                best = key, theta
        self.theta, self.x, self.y = best[1], xs, ys
        return self

    def fit(self, df: DataFrame, most_rows: int = 5000) -> GaussianProcess:
        pdf = df.select(*self.features, self.target).dropna().limit(most_rows + 1).toPandas()
        if len(pdf) > most_rows:
            raise ValueError(f"at most {most_rows} labelled points")
        return self.fit_arrays(pdf[list(self.features)].to_numpy(float), pdf[self.target].to_numpy(float))

    def _posterior(self, x: np.ndarray, y: np.ndarray, at: np.ndarray, theta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        k = self._kernel(x, x, theta) + (np.exp(theta[-1]) + 1e-10) * np.eye(len(x))
        cross = self._kernel(at, x, theta)
        mean = cross @ np.linalg.solve(k, y)
        var = np.exp(theta[0]) + np.exp(theta[-1]) - np.einsum("ij,ji->i", cross, np.linalg.solve(k, cross.T))
        return mean, np.sqrt(np.maximum(var, 0))

    def predict_arrays(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        m, s = self._posterior(self.x, self.y, (x - self.mean) / self.std, self.theta)
        return m * self.y_std + self.y_mean, s * self.y_std

    def predict(self, df: DataFrame, mean: str = "predicted", std: str = "predicted_std") -> DataFrame:
        """All rows with the predicted mean and standard deviation."""
        model = self

        @F.pandas_udf("struct<m double, s double>")
        def run(*columns):
            import pandas as pd

            m, s = model.predict_arrays(np.column_stack([c.to_numpy(float) for c in columns])) if len(columns[0]) else (np.empty(0), np.empty(0))
            return pd.DataFrame({"m": m, "s": s})

        out = df.withColumn("_gp", run(*[F.col(c).cast("double") for c in self.features]))
        return out.withColumns({mean: F.col("_gp.m"), std: F.col("_gp.s")}).drop("_gp")

    def leave_one_out(self) -> np.ndarray:
        """Predictions of each training row by the others, hyperparameters fixed, from the inverse of the kernel."""
        k = self._kernel(self.x, self.x, self.theta) + (np.exp(self.theta[-1]) + 1e-10) * np.eye(len(self.x))
        inverse = np.linalg.inv(k)
        return (self.y - inverse @ self.y / np.diag(inverse)) * self.y_std + self.y_mean


class ModelSuite:
    """Models by name and by role."""

    def __init__(self):
        self.models: dict[str, GaussianProcess] = {}
        self.roles: dict[str, str] = {}

    def add(self, name: str, model: GaussianProcess, role: str | None = None) -> None:
        self.models[name] = model
        if role:
            self.roles[role] = name

    def by_role(self, role: str) -> GaussianProcess:
        return self.models[self.roles[role]]


def minimum_over_coordinate(candidates: DataFrame, model: GaussianProcess, values: Sequence[float], coordinate: str = "distance", key: Sequence[str] = ("point_index",)) -> DataFrame:
    """Each candidate with its least predicted energy over the coordinate's values, where it lies, and ``score`` = std - energy."""
    grid = candidates.withColumn(coordinate, F.explode(F.array(*[F.lit(float(v)) for v in values])))
    predicted = model.predict(grid, "energy_hat", "energy_std")
    best = predicted.groupBy(*key).agg(F.min(F.struct("energy_hat", coordinate, "energy_std")).alias("m"))
    best = best.select(*key, F.col("m.energy_hat").alias("energy_hat"), F.col("m.energy_std").alias("energy_std"), F.col(f"m.{coordinate}").alias(coordinate))
    return candidates.join(best, list(key)).withColumn("score", F.col("energy_std") - F.col("energy_hat"))
