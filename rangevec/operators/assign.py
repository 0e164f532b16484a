"""Nearest centroid: plain, attribute-aware and span-aware.

Centroids are a table of bounded size (their number is a parameter of training)
and are broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rangevec.functions import vectors as V

#: From so many centroids on, assignment by matrix products pays for its Python workers.
KERNEL_FROM = 64


def _nearest(cost: Column, ident: str) -> Column:
    return F.min(F.struct(cost.alias("cost"), F.col(ident).alias("id")))


def assign(rows: DataFrame, centroids: DataFrame, ident: str = "fine_id", key: str = "vec_id", vec: str = "embedding", cost: Column | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, ident, dist_sq) of each row's nearest centroid, the lowest id on ties, and the row's columns in ``keep``.

    The minimum is taken over an array of the broadcast centroids, so rows are
    neither multiplied nor shuffled.
    """
    table = centroids.agg(F.sort_array(F.collect_list(F.struct(F.col(ident).alias("id"), *[F.col(c) for c in centroids.columns if c != ident]))).alias("_all"))
    x = rows.withColumn("_x", V.vector(vec)).crossJoin(F.broadcast(table))  # one row: a constant for every row
    cost_of = cost or (lambda c: V.l2_sq("_x", c["centroid"]))
    costs = F.transform("_all", lambda c: F.struct(cost_of(c).alias("cost"), c["id"].alias("id")))
    return x.withColumn("_best", F.array_min(costs)).select(key, *keep, F.col("_best.id").alias(ident), F.col("_best.cost").alias("dist_sq"))


def assign_attribute(rows: DataFrame, centroids: DataFrame, weight: float, scale: float, **options) -> DataFrame:
    """As ``assign``, with the attribute term; centroids also have ``centre``, a scalar."""
    return assign(rows, centroids, cost=lambda c: V.l2_sq("_x", c["centroid"]) + V.attribute_term("scalar", c["centre"], F.lit(scale), weight), **options)


def assign_span(rows: DataFrame, centroids: DataFrame, weight: float, scale: float, **options) -> DataFrame:
    """As ``assign``, with the span penalty; centroids also have ``low`` and ``high``."""
    return assign(rows, centroids, cost=lambda c: V.l2_sq("_x", c["centroid"]) + V.span_term("scalar", c["low"], c["high"], F.lit(scale), weight), **options)


def nearest_of(x: np.ndarray, centroids: np.ndarray, extra: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Index and squared distance of each row's nearest centroid, the lowest index on ties, a block of rows at a time.

    The matrix form only finds what can be nearest; distances are summed from differences.
    """
    out, dist = np.empty(len(x), np.int64), np.empty(len(x))
    half = (centroids**2).sum(axis=1)
    step = max(1, (4 << 20) // max(1, len(centroids)))
    for at in range(0, len(x), step):
        part = x[at : at + step]
        d = (part**2).sum(axis=1)[:, None] + half[None, :] - 2 * part @ centroids.T
        if extra is not None:
            d = d + extra[at : at + step]
        slack = 2e-9 * ((part**2).sum(axis=1) + half.max()) + 1e-300
        i, j = np.nonzero(d <= (d.min(axis=1) + slack)[:, None])
        exact = ((part[i] - centroids[j]) ** 2).sum(axis=1) + (0 if extra is None else extra[at : at + step][i, j])
        order = np.lexsort((j, exact, i))
        first = order[np.unique(i[order], return_index=True)[1]]
        out[at : at + step], dist[at : at + step] = j[first], exact[first]
    return out, dist


def assign_arrow(rows: DataFrame, centroids: np.ndarray, ids: np.ndarray, key: str = "vec_id", vec: str = "embedding", ident: str = "fine_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """As ``assign`` by matrix products in Arrow batches, for many centroids or rows."""
    kept = {f.name: f.dataType.simpleString() for f in rows.select(*keep).schema} if keep else {}
    shared = rows.sparkSession.sparkContext.broadcast((centroids, ids))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c, names = shared.value
        for b in batches:
            if len(b):
                at, dist = nearest_of(np.stack(b["v"].to_numpy()), c)
                yield b[[key, *kept]].assign(**{ident: names[at], "dist_sq": dist})

    schema = ", ".join([f"{key} long", *(f"{c} {t}" for c, t in kept.items()), f"{ident} int", "dist_sq double"])
    return rows.select(F.col(key).cast("long"), *keep, V.vector(vec).alias("v")).mapInPandas(run, schema)


def assign_rows(rows: DataFrame, centroids: DataFrame, key: str = "vec_id", vec: str = "embedding", ident: str = "fine_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """As ``assign``, in the JVM for a few centroids and by matrix products for many; their table is bounded by training."""
    table = centroids.select(ident, V.vector("centroid").alias("c")).orderBy(ident).collect()
    if len(table) < KERNEL_FROM:
        return assign(rows, centroids, ident, key, vec, keep=keep)
    return assign_arrow(rows, np.array([r["c"] for r in table]), np.array([r[ident] for r in table]), key, vec, ident, keep)
