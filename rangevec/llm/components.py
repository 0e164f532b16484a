"""Connected components of a graph held as a table of links.

A graph of at most ``FEW_LINKS`` links, some megabytes, is settled on the driver
at once. Any other takes alternating large-star and small-star rounds (Kiveris
et al., 2014): each round points links at the smallest neighbour, so paths
shorten geometrically. A round is two aggregates and two joins; links of a node
that has more than ``HOT_LINKS`` of them are salted by their far end and spread
over ``salts`` tasks, and only such nodes are sent to more than one. Each round
is written to the shared folder, and only a count and a checksum reach the driver.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rangevec.sources.scratch import materialize

#: As many links may be settled on the driver, 16 bytes each.
FEW_LINKS = 1 << 18
#: A node of more links is dealt to several tasks. It is raised with the table, so that hot nodes, which are broadcast, are 20,000 at most.
HOT_LINKS = 10_000


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links from each node of the graph to the smallest node of its component."""
    nodes, flat = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = flat[: len(u)], flat[len(u) :]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], least)
        np.minimum.at(new, label[b], least)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    child = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[child], nodes[label[child]]


def _dealt(least: DataFrame, salts: int, hot: int) -> DataFrame:
    """(u, m, salt) of nodes with their least partner and n links: one row each, and one for each salt only where n is over ``hot``."""
    salt = F.explode(F.sequence(F.lit(0), F.when(F.col("n") > hot, salts - 1).otherwise(0))).alias("salt")
    return least.select("u", F.least("u", "least").alias("m"), salt)


def _with_least(links: DataFrame, salts: int, hot: int) -> DataFrame:
    """Each link (u, v) with the least of u and all its partners, as column m."""
    least = links.groupBy("u").agg(F.min("v").alias("least"), F.count(F.lit(1)).alias("n"))
    many = F.broadcast(least.where(F.col("n") > hot).select("u", F.lit(salts).alias("salts")))
    salted = links.join(many, "u", "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("v"), F.col("salts")), F.lit(0)).cast("int")).drop("salts")
    return salted.join(_dealt(least, salts, hot), ["u", "salt"]).drop("salt")


def _signature(links: DataFrame) -> tuple:
    row = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def connected_components(links: DataFrame, salts: int = 16, max_rounds: int = 50, few: int = FEW_LINKS, hot: int = HOT_LINKS) -> DataFrame:
    """(node, component) for every node of ``links`` (u, v: long) that has a smaller one in its component.

    component is the smallest node of the component. Self-links and repeated or
    reversed links change nothing; links with a null end are ignored. No links
    give an empty result.
    """
    links = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"), (F.col("u").isNotNull() & F.col("v").isNotNull()).alias("whole"))
    links = materialize(links.where("whole AND u <> v").select("u", "v").distinct(), "links")
    before = _signature(links)
    if before[0] <= few:
        ends = links.toArrow()
        pairs = dict(zip(("node", "component"), forest(*(ends.column(c).to_numpy() for c in ("u", "v")))))
        return materialize(links.sparkSession.createDataFrame(pa.table(pairs, pa.schema([("node", pa.int64()), ("component", pa.int64())]))), "components")
    hot = max(hot, before[0] // 10_000)
    for _ in range(max_rounds):
        if not before[0]:
            break
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both, salts, hot).where("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        near = _with_least(materialize(large, "large-star"), salts, hot)
        small = near.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(near.select("u", F.col("m").alias("v")))
        links = materialize(small.distinct(), "links")
        after = _signature(links)
        if after == before:
            return links.select(F.col("u").alias("node"), F.col("v").alias("component"))
        before = after
    if before[0]:
        raise RuntimeError(f"links still change after {max_rounds} rounds")
    return links.select(F.col("u").alias("node"), F.col("v").alias("component"))
