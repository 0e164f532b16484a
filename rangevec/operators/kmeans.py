"""k-means with explicit or seeded starts, weights, attribute terms, and two levels.

A Lloyd round broadcasts the centroids, sums rows by nearest centroid inside
Arrow batches, and adds the partial sums: what is shuffled is one row for each
centroid and batch. Centroids alone reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rangevec.functions import vectors as V
from rangevec.operators.assign import nearest_of


def rounds_for(n: int, k: int) -> int:
    """How many rounds training takes: more for many rows and many centroids."""
    if n < 10_000:
        return 20
    if n < 100_000:
        return 30
    return 40 if k >= 1000 else 35


def training_size(n: int, capped: bool = False) -> int:
    """Leading rows to train on: 30 %, 40 % from 500,000 rows, 100,000 from a million if the base is capped; at least 100,000 and at most a million."""
    want = 100_000 if capped and n >= 1_000_000 else int(n * (0.4 if n >= 500_000 else 0.3))
    return min(n, max(100_000, min(1_000_000, want)))


def sample_start(rows: DataFrame, k: int, seed: int = 42, key: str = "vec_id", vec: str = "embedding") -> np.ndarray:
    """k distinct rows, those with the smallest seeded hash of their id."""
    found = rows.select(key, V.vector(vec).alias("v")).orderBy(F.xxhash64(F.lit(seed), F.col(key)), key).limit(k).collect()
    return np.array([r["v"] for r in found], float)


def plus_plus_start(sample: np.ndarray, k: int, seed: int = 42, weights: np.ndarray | None = None) -> np.ndarray:
    """k-means++ over a bounded sample: each next start is drawn by its squared distance to the nearest one."""
    rng = np.random.default_rng(seed)
    w = np.ones(len(sample)) if weights is None else np.asarray(weights, float)
    chosen = [int(rng.choice(len(sample), p=w / w.sum()))]
    near = ((sample - sample[chosen[0]]) ** 2).sum(axis=1)
    while len(chosen) < min(k, len(sample)):
        mass = near * w
        at = int(rng.choice(len(sample), p=mass / mass.sum())) if mass.sum() > 0 else int(np.setdiff1d(np.arange(len(sample)), chosen)[0])
        chosen.append(at)
        near = np.minimum(near, ((sample - sample[at]) ** 2).sum(axis=1))
    return sample[chosen]


def lloyd_step(rows: DataFrame, centroids: np.ndarray, vec: str = "embedding", weight: str | None = None) -> np.ndarray:
    """Centroids after one round; one without rows stays."""
    shared = rows.sparkSession.sparkContext.broadcast(centroids)
    columns = [V.vector(vec).alias("v"), (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = shared.value
        sums, mass = np.zeros_like(c), np.zeros(len(c))
        for b in batches:
            if len(b):
                x, w = np.stack(b["v"].to_numpy()), b["w"].to_numpy()
                at, _ = nearest_of(x, c)
                np.add.at(sums, at, x * w[:, None])
                mass += np.bincount(at, w, len(c))
        some = np.flatnonzero(mass)
        if len(some):  # Arrow can't turn a list column without a row into arrays
            yield pd.DataFrame({"id": some, "mass": mass[some], "total": list(sums[some])})

    parts = rows.select(*columns).mapInPandas(run, "id long, mass double, total array<double>")
    dims = [F.sum(F.col("total")[i]).alias(f"d{i}") for i in range(centroids.shape[1])]
    out = centroids.copy()
    for r in parts.groupBy("id").agg(F.sum("mass").alias("mass"), F.array(*dims).alias("total")).collect():
        out[r["id"]] = np.array(r["total"]) / r["mass"]
    return out


def mean_vectors(rows: DataFrame, ident: str = "fine_id", vec: str = "embedding") -> DataFrame:
    """(ident, new, n): the mean vector of each list, from one row of sums for each list and input partition."""
    dims = rows.select(F.size(vec)).first()
    sums = [F.avg(V.vector(vec)[i]).alias(f"_d{i}") for i in range(dims[0] if dims else 0)]
    means = rows.groupBy(ident).agg(*sums, F.count(F.lit(1)).alias("n"))
    return means.select(ident, F.array(*[f"_d{i}" for i in range(len(sums))]).cast("array<double>").alias("new"), "n")


def scalar_step(rows: DataFrame, centroids: DataFrame, weight: float, span_weight: float, scale: float, ident: str = "fine_id") -> DataFrame:
    """One round that heeds scalars: (ident, centroid, centre, low, high, n), from the same columns of ``centroids`` but n.

    A row's cost is its squared distance, the attribute term to the list's mean
    scalar and the penalty for widening the list's span (null span: none). Lists
    without rows stay as they are.
    """
    from rangevec.operators.assign import assign

    def cost(c):
        span = F.when(c["low"].isNull(), 0.0).otherwise(V.span_term("scalar", c["low"], c["high"], F.lit(scale), span_weight))
        return V.l2_sq("_x", c["centroid"]) + V.attribute_term("scalar", c["centre"], F.lit(scale), weight) + span

    near = assign(rows, centroids.select(ident, V.vector("centroid").alias("centroid"), "centre", "low", "high"), ident, cost=cost, keep=("embedding", "scalar"))
    scalars = near.groupBy(ident).agg(F.avg("scalar").alias("_centre"), F.min("scalar").alias("_low"), F.max("scalar").alias("_high"))
    new = centroids.join(mean_vectors(near, ident), ident, "left").join(scalars, ident, "left")
    return new.select(ident, F.coalesce("new", V.vector("centroid")).alias("centroid"), *[F.coalesce(f"_{c}", c).alias(c) for c in ("centre", "low", "high")], F.coalesce("n", F.lit(0)).alias("n"))


def fit_scalar(rows: DataFrame, centroids: DataFrame, weight: float = 0.0, span_weight: float = 0.0, scale: float | None = None, rounds: int = 20, ident: str = "fine_id") -> DataFrame:
    """Rounds of ``scalar_step`` from (ident, centroid, centre); the scale is the scalars' deviation. Centroids, bounded by training, are carried by the driver."""
    if scale is None:
        scale = rows.agg(V.scale_of(F.stddev_pop("scalar")).alias("s")).first()["s"] or 1.0
    kind = f"{ident} int, centroid array<double>, centre double, low double, high double"
    none = F.lit(None).cast("double")
    now = centroids.select(ident, V.vector("centroid").alias("centroid"), "centre", none.alias("low"), none.alias("high"))
    held = sorted(now.collect())
    for _ in range(rounds):
        table = rows.sparkSession.createDataFrame(held, kind)
        new = sorted(scalar_step(rows, table, weight, span_weight, scale, ident).drop("n").collect())
        if np.allclose([r["centroid"] for r in new], [r["centroid"] for r in held], atol=1e-9):
            break
        held = new
    return rows.sparkSession.createDataFrame(held, kind)


def lloyd_step_sql(rows: DataFrame, centroids: DataFrame, ident: str = "fine_id") -> DataFrame:
    """One round as a plan of DataFrame functions: (ident, centroid, n)."""
    from rangevec.operators.assign import assign

    near = assign(rows, centroids, ident, keep=("embedding",))
    new = mean_vectors(near, ident)
    return centroids.join(new, ident, "left").select(ident, F.coalesce("new", V.vector("centroid")).alias("centroid"), F.coalesce("n", F.lit(0)).alias("n"))


def fit(rows: DataFrame, start: np.ndarray, rounds: int | None = None, weight: str | None = None, vec: str = "embedding", tolerance: float = 1e-8) -> np.ndarray:
    """Lloyd rounds from ``start`` until no centroid moves (squared move by dimension) more than the tolerance."""
    centroids = np.array(start, float)
    for _ in range(rounds_for(rows.count(), len(centroids)) if rounds is None else rounds):
        new = lloyd_step(rows, centroids, vec, weight)
        moved = ((new - centroids) ** 2).sum(axis=1) / centroids.shape[1]
        centroids = new
        if moved.max() <= tolerance:
            break
    return centroids


def fit_local(points: np.ndarray, start: np.ndarray, rounds: int = 20, weights: np.ndarray | None = None) -> np.ndarray:
    """The same on the driver, for tables that are bounded: centroids of centroids."""
    c, w = np.array(start, float), np.ones(len(points)) if weights is None else np.asarray(weights, float)
    for _ in range(rounds):
        at, _ = nearest_of(points, c)
        mass = np.bincount(at, w, len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, at, points * w[:, None])
        new = np.where(mass[:, None] > 0, sums / np.maximum(mass, 1e-300)[:, None], c)
        if (((new - c) ** 2).sum(axis=1) / c.shape[1]).max() <= 1e-8:
            return new
        c = new
    return c


@dataclass
class TwoLevel:
    """Fine and coarse centroids, and the coarse one nearest to each fine one."""

    fine: np.ndarray
    coarse: np.ndarray
    parent: np.ndarray


def fit_two_level(rows: DataFrame, n_fine: int, n_coarse: int, seed: int = 42, rounds: int | None = None, plus_plus: bool = False, sample: int = 20_000) -> TwoLevel:
    """Train fine centroids on the rows, coarse ones on those, and map each fine one to its nearest coarse one."""
    start = sample_start(rows, max(n_fine, sample) if plus_plus else n_fine, seed)
    if plus_plus:
        start = plus_plus_start(start, n_fine, seed)
    fine = fit(rows, start[:n_fine], rounds)
    coarse = fit_local(fine, fine[np.random.default_rng(seed).choice(len(fine), min(n_coarse, len(fine)), replace=False)])
    return TwoLevel(fine, coarse, nearest_of(fine, coarse)[0])
