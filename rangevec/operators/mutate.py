"""Changing an index: insertion, deletion, compaction and upkeep of lists.

Tables are immutable: each operator returns what the table is afterwards, and
``sources.store`` writes it as a new version.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rangevec.functions import vectors as V
from rangevec.operators import kmeans, stats
from rangevec.operators.assign import assign, assign_arrow, assign_rows, nearest_of
from rangevec.sources.scratch import materialize


def insert(rows: DataFrame, batch: DataFrame, centroids: DataFrame, batch_id: int = 0, segment: str = "delta") -> DataFrame:
    """``rows`` with the batch assigned to lists, without a shuffle. Callers refuse the ids that ``duplicate_ids`` finds before."""
    near = assign_rows(batch, centroids, keep=("embedding", "scalar"))
    new = near.select("vec_id", "embedding", "scalar", "fine_id", F.lit(segment).alias("segment"), F.lit(batch_id).cast("long").alias("batch_id"))
    return rows.unionByName(new.select(rows.columns)) if rows is not None else new


def duplicate_ids(rows: DataFrame, batch: DataFrame) -> DataFrame:
    """Ids of the batch that an insertion must refuse."""
    twice = batch.groupBy("vec_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("vec_id")
    return twice.union(batch.select("vec_id").join(rows.select("vec_id"), "vec_id", "left_semi")).distinct()


def number(batch: DataFrame, first: int, order: str) -> DataFrame:
    """The batch with ids from ``first`` on, in the given order; the order's values are dealt by range, so no task holds all.

    The places in the order are written once: made twice, for the sizes and for
    the rows, they need not agree, and rows would be lost.
    """
    spread = batch.repartitionByRange(order).sortWithinPartitions(order).withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id())
    spread = materialize(spread, "numbered")
    sizes = spread.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"), F.min("_i").alias("_first"))
    offsets = sizes.withColumn("_off", F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)))  # one row a partition
    return spread.join(F.broadcast(offsets.select("_p", "_first", F.coalesce("_off", F.lit(0)).alias("_off"))), "_p").withColumn("vec_id", F.lit(first) + F.col("_off") + F.col("_i") - F.col("_first")).drop("_p", "_i", "_first", "_off")


def merge_segments(rows: DataFrame) -> DataFrame:
    """The delta segment taken into the main one, in order of list, scalar and id; a large list is dealt to several partitions by scalar."""
    return rows.withColumn("segment", F.lit("main")).repartitionByRange("fine_id", "scalar", "vec_id").sortWithinPartitions("fine_id", "scalar", "vec_id")


def merge_due(rows: DataFrame, cap: int = 256, first: int = 32) -> DataFrame:
    """Lists whose delta segment has reached its threshold: by mean list size, main segment size and cap."""
    n = lambda s: F.count(F.when(F.col("segment") == s, 1))
    sizes = rows.groupBy("fine_id").agg(n("main").alias("main"), n("delta").alias("delta"))
    mean = F.avg(F.col("main") + F.col("delta")).over(Window.partitionBy(F.lit(1)))  # one row a list
    by_main = F.when(F.col("main") > 0, F.greatest(F.lit(32), F.least(F.lit(4096), F.floor(F.col("main") / 20)))).otherwise(first)
    due = F.greatest(F.lit(1), F.least(F.lit(cap), F.greatest(F.greatest(F.lit(32), F.floor(mean / 4)), by_main)))
    return sizes.withColumn("due_at", due).where("delta >= due_at").select("fine_id", "main", "delta", "due_at")


def remove(tombstones: DataFrame, ids: DataFrame, rows: DataFrame) -> DataFrame:
    """Tombstones with the ids added that are live rows; others are ignored."""
    live = ids.select("vec_id").join(rows.select("vec_id"), "vec_id", "left_semi")
    return tombstones.select("vec_id").union(live).distinct()


def live(rows: DataFrame, tombstones: DataFrame) -> DataFrame:
    return rows.join(tombstones.select("vec_id"), "vec_id", "left_anti")


def compact(rows: DataFrame, tombstones: DataFrame, max_lists: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows without the deleted ones of at most ``max_lists`` lists (those with most first), and the tombstones that are left."""
    dead = rows.join(tombstones.select("vec_id"), "vec_id", "left_semi").select("vec_id", "fine_id")
    if max_lists is not None:
        lists = dead.groupBy("fine_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "fine_id").limit(max_lists)
        dead = dead.join(lists.select("fine_id"), "fine_id", "left_semi")
    gone = dead.select("vec_id")
    return rows.join(gone, "vec_id", "left_anti"), tombstones.join(gone, "vec_id", "left_anti")


def counts(rows: DataFrame, tombstones: DataFrame) -> DataFrame:
    all_ = rows.agg(F.count(F.lit(1)).alias("n_vectors"))
    dead = rows.join(tombstones.select("vec_id").distinct(), "vec_id", "left_semi").agg(F.count(F.lit(1)).alias("n_deleted"))
    return all_.crossJoin(dead).withColumn("n_live", F.col("n_vectors") - F.col("n_deleted"))  # one row each


def overloaded(sizes: DataFrame, factor: float = 1.5, most: int = 4) -> DataFrame:
    """At most ``most`` lists of over ``factor`` times the mean size, largest first."""
    mean = F.avg("n").over(Window.partitionBy(F.lit(1)))  # one row a list
    return sizes.withColumn("mean_n", mean).where(F.col("n") > factor * F.col("mean_n")).orderBy(F.desc("n"), "fine_id").limit(most)


def farthest(members: DataFrame, n: int) -> DataFrame:
    """The n rows of each list that are farthest from its centroid. ``members`` has dist_sq."""
    w = Window.partitionBy("fine_id").orderBy(F.desc("dist_sq"), "vec_id")
    return members.withColumn("rnk", F.row_number().over(w)).where(F.col("rnk") <= n)


def evenly_spaced(rows: DataFrame, sizes: DataFrame, m: int) -> DataFrame:
    """m rows of each list at equal steps of their order by id."""
    w = Window.partitionBy("fine_id").orderBy("vec_id")
    pos = rows.withColumn("pos", F.row_number().over(w) - 1).join(F.broadcast(sizes.select("fine_id", "n")), "fine_id")
    step = F.floor((F.floor((F.col("pos") * m + m - 1) / F.col("n"))) * F.col("n") / m)
    return pos.where((F.col("n") <= m) | (step == F.col("pos"))).drop("n")


def migrate(members: DataFrame, centroids: DataFrame, lists: DataFrame, n: int, gain: float = 0.0) -> DataFrame:
    """Moves (vec_id, fine_id, to_id) of the farthest rows of the given lists to a nearer centroid, if it is nearer by the share ``gain``."""
    far = farthest(members.join(F.broadcast(lists.select("fine_id")), "fine_id", "left_semi"), n)
    own = far.select("vec_id", "embedding", F.col("fine_id").alias("own_id"), F.col("dist_sq").alias("own_sq"))
    best = assign(own, centroids, keep=("own_id", "own_sq"))
    moved = best.select("vec_id", F.col("own_id").alias("fine_id"), F.col("own_sq").alias("dist_sq"), F.col("fine_id").alias("to_id"), F.col("dist_sq").alias("to_sq"))
    return moved.where((F.col("to_id") != F.col("fine_id")) & (F.sqrt("to_sq") < (1 - gain) * F.sqrt("dist_sq"))).select("vec_id", "fine_id", "to_id")


def apply_moves(rows: DataFrame, moves: DataFrame) -> DataFrame:
    return rows.join(moves.select("vec_id", "to_id"), "vec_id", "left").withColumn("fine_id", F.coalesce("to_id", "fine_id")).drop("to_id").select(rows.columns)


def recluster_pressure(sizes: DataFrame, inserts: DataFrame, drifts: DataFrame, trigger: int, drift_at: float = 0.1, max_size: int = 10_000, most: int = 2) -> DataFrame:
    """Lists that most need new centroids: by insertions since the last time, size over the mean and drift; at most ``most``."""
    mean = F.avg("n").over(Window.partitionBy(F.lit(1)))  # one row a list
    x = sizes.withColumn("mean_n", mean).join(inserts, "fine_id", "left").join(drifts, "fine_id", "left")
    ins = F.coalesce("inserted", F.lit(0)) / F.lit(float(max(1, trigger)))
    size = F.greatest(F.lit(0.0), F.col("n") / F.greatest(F.lit(1e-9), F.col("mean_n")) - 1)
    moved = F.when(F.col("n") > 100, F.coalesce("rel_shift", F.lit(0.0)) / drift_at).otherwise(0.0)
    p = F.col("n") / (F.col("n") + 64.0) * (0.45 * ins + 0.30 * F.least(size, F.lit(2.0)) + 0.25 * moved)
    x = x.withColumn("p", p).withColumn("ins", ins).withColumn("moved", moved)
    due = ((F.col("ins") >= 1) & (F.col("p") >= 0.55)) | ((F.col("moved") >= 1) & (F.col("p") >= 0.45))
    return x.where((F.col("n") <= max_size) & due).orderBy(F.desc("p"), "fine_id").limit(most).select("fine_id", "n", "p")


def poor_lists(quality: DataFrame, inserts: DataFrame, threshold: float = 0.3, max_size: int = 10_000) -> DataFrame:
    """Lists of low quality, too large, or with many insertions."""
    x = quality.join(inserts, "fine_id", "left")
    bad = (F.col("quality") < threshold) | (F.col("n") > max_size) | (F.coalesce("inserted", F.lit(0)) > max_size / 2)
    return x.where(bad).select("fine_id", "n", "quality")


def recluster(rows: DataFrame, members: DataFrame, centroids: DataFrame, list_id: int, neighbours: int, gain: float = 0.3) -> DataFrame:
    """Rows of one list re-assigned among its nearest centroids where that is nearer by the share ``gain``."""
    own = centroids.where(F.col("fine_id") == list_id).select(V.vector("centroid").alias("_own"))
    near = centroids.crossJoin(F.broadcast(own)).withColumn("d", V.l2_sq(V.vector("centroid"), "_own")).orderBy("d", "fine_id").limit(neighbours)
    lists = centroids.where(F.col("fine_id") == list_id).select("fine_id")
    return apply_moves(rows, migrate(members, near.select("fine_id", "centroid"), lists, 1 << 31, gain))


def soft_reconcile(fines: DataFrame, coarse: DataFrame, tau: float = 0.06, alpha: float = 0.35, rel: float = 0.12, margin: float = 0.04) -> tuple[DataFrame, DataFrame]:
    """Coarse centroids eased towards the weighted mean of their fine ones, and fine ones re-mapped where clearly nearer.

    ``fines``: fine_id, coarse_id, centroid, n. Coarse centroids move by
    ``alpha`` only if the weighted mean move, relative to the radius, reaches ``tau``.
    """
    radius = stats.coarse_radius(fines, coarse).first()["radius"] or 0.0
    target = stats.weighted_mean(fines.select("coarse_id", "n", "centroid"), "coarse_id", "n").select("coarse_id", F.col("centroid").alias("_to"))
    weight = fines.groupBy("coarse_id").agg(F.sum(F.greatest(F.lit(1), F.col("n"))).alias("w"))
    moved = coarse.select("coarse_id", V.vector("centroid").alias("_c")).join(target, "coarse_id", "left").join(weight, "coarse_id", "left").withColumn("_to", F.coalesce("_to", "_c"))
    shift = moved.agg((F.sum(F.coalesce("w", F.lit(1)) * V.l2("_c", "_to")) / F.sum(F.coalesce("w", F.lit(1)))).alias("s")).first()["s"] or 0.0
    eased = F.zip_with("_c", "_to", lambda a, b: a + alpha * (b - a)) if shift / max(radius, 1e-6) >= tau else F.col("_c")
    new = moved.select("coarse_id", eased.alias("centroid"))
    best = assign(fines.select("fine_id", F.col("centroid").alias("embedding")), new, "coarse_id", key="fine_id").select("fine_id", F.col("coarse_id").alias("best"), F.col("dist_sq").alias("best_sq"))
    own = fines.select("fine_id", "coarse_id", V.vector("centroid").alias("_f")).join(F.broadcast(new.withColumnRenamed("centroid", "_n")), "coarse_id").select("fine_id", "coarse_id", V.l2_sq("_f", "_n").alias("own_sq"))
    gain = F.col("own_sq") - F.col("best_sq")
    go = (gain > (margin * radius) ** 2) & (gain / F.greatest(F.lit(1e-12), F.col("own_sq")) >= rel)
    return new, own.join(best, "fine_id").select("fine_id", F.when(go, F.col("best")).otherwise(F.col("coarse_id")).alias("coarse_id"))


def local_recluster(rows: DataFrame, centroids: DataFrame, list_id: int, parts: int, rounds: int = 20, start: np.ndarray | None = None) -> DataFrame:
    """Moves (vec_id, fine_id, to_id): one list cut into ``parts`` by k-means of its own, each part sent to the list whose centroid is nearest to the part's.

    Without ``start`` the parts start from the rows of smallest hash.
    """
    own = rows.where(F.col("fine_id") == list_id)
    start = kmeans.sample_start(own, parts) if start is None else start
    none = rows.sparkSession.createDataFrame([], "vec_id long, fine_id int, to_id int")
    if len(start) < 2:
        return none
    subs = kmeans.fit(own, start, rounds, tolerance=1e-12)
    table = centroids.select("fine_id", V.vector("centroid").alias("c")).orderBy("fine_id").collect()  # bounded by training
    target = np.array([r["fine_id"] for r in table])[nearest_of(subs, np.array([r["c"] for r in table]))[0]]
    to = F.element_at(F.array(*[F.lit(int(t)) for t in target]), F.col("part") + 1)
    moved = assign_arrow(own.select("vec_id", "embedding"), subs, np.arange(len(subs)), ident="part").select("vec_id", F.lit(list_id).alias("fine_id"), to.cast("int").alias("to_id"))
    return moved.where("to_id <> fine_id")


def coarse_from_fine(fines: DataFrame, before: DataFrame, coarse: DataFrame, threshold: float = 0.1) -> tuple[DataFrame, DataFrame]:
    """Coarse centroids and the mapping after fine ones moved: plain means where any moved by more than the threshold, or all by half of it on average.

    ``fines`` and ``before`` have fine_id and centroid. The mapping (fine_id,
    coarse_id) is made anew in any case, by the former coarse centroids.
    """
    moved = stats.drift(fines, before).agg(F.max("shift").alias("top"), F.avg("shift").alias("mean")).first()
    mapped = assign(fines, coarse, "coarse_id", key="fine_id", vec="centroid").select("fine_id", "coarse_id")
    if moved["top"] is None or not (moved["top"] > threshold or moved["mean"] > 0.5 * threshold):
        return coarse.select("coarse_id", V.vector("centroid").alias("centroid")), mapped
    mean = stats.weighted_mean(fines.join(mapped, "fine_id").withColumn("one", F.lit(1)), "coarse_id", "one").withColumnRenamed("centroid", "_new")
    new = coarse.select("coarse_id", V.vector("centroid").alias("_was")).join(mean, "coarse_id", "left")
    return new.select("coarse_id", F.coalesce("_new", "_was").alias("centroid")), mapped
