"""Statistics of lists and centroids.

``rows`` has vec_id, embedding, scalar and the list a row is in (fine_id);
``centroids`` has every list, so lists without rows count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rangevec.functions import vectors as V

BINS = 32


def list_sizes(rows: DataFrame, centroids: DataFrame, ident: str = "fine_id") -> DataFrame:
    counts = rows.groupBy(ident).agg(F.count(F.lit(1)).alias("n"))
    return centroids.select(ident).join(counts, ident, "left").select(ident, F.coalesce("n", F.lit(0)).alias("n"))


def size_stats(sizes: DataFrame) -> DataFrame:
    return sizes.agg(F.min("n").alias("min_n"), F.max("n").alias("max_n"), F.avg("n").alias("avg_n"), F.count(F.lit(1)).alias("lists"))


def coarse_sizes(sizes: DataFrame, parents: DataFrame) -> DataFrame:
    return sizes.join(parents.select("fine_id", "coarse_id"), "fine_id").groupBy("coarse_id").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("fines"))


def count_in_range(rows: DataFrame, low, high, ident: str = "fine_id") -> DataFrame:
    return rows.where(V.in_range("scalar", F.lit(low).cast("double"), F.lit(high).cast("double"))).groupBy(ident).agg(F.count(F.lit(1)).alias("n"))


def selection_rate(rows: DataFrame, low, high) -> DataFrame:
    return rows.agg(F.avg(V.in_range("scalar", F.lit(low).cast("double"), F.lit(high).cast("double")).cast("int")).alias("rate"))


def domain(rows: DataFrame) -> tuple[float, float]:
    r = rows.agg(F.min("scalar"), F.max("scalar")).first()
    return (r[0], r[1]) if r[0] is not None else (0.0, 0.0)


def histogram(rows: DataFrame, low: float, high: float, bins: int = BINS, ident: str = "fine_id") -> DataFrame:
    """Rows of each list in each equal-width bin, ends clamped."""
    bin_ = V.bin_of("scalar", F.lit(low), F.lit(high), bins)
    return rows.where("scalar IS NOT NULL").groupBy(ident, bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def histogram_open(rows: DataFrame, low: float, high: float, bins: int = BINS, ident: str = "fine_id") -> DataFrame:
    """The same with slot 0 below the domain and slot bins + 1 above it; the right edge is in the last bin."""
    s = F.col("scalar")
    slot = F.when(s < low, 0).when(s > high, bins + 1).otherwise(V.bin_of(s, F.lit(low), F.lit(high), bins) + 1)
    return rows.where("scalar IS NOT NULL").groupBy(ident, slot.alias("slot")).agg(F.count(F.lit(1)).alias("n"))


def synopsis(rows: DataFrame, low: float, high: float, ident: str = "fine_id") -> DataFrame:
    """count, min, max, mean, population variance and histogram of each list's scalars."""
    bin_ = V.bin_of("scalar", F.lit(low), F.lit(high), BINS)
    bins = [F.count(F.when(bin_ == i, 1)) for i in range(BINS)]
    return rows.where("scalar IS NOT NULL").groupBy(ident).agg(
        F.count(F.lit(1)).alias("cnt"), F.min("scalar").alias("min_s"), F.max("scalar").alias("max_s"), F.avg("scalar").alias("mean_s"), F.var_pop("scalar").alias("var_s"), F.array(*bins).alias("hist")
    )


def merge_synopses(a: DataFrame, b: DataFrame, ident: str = "fine_id") -> DataFrame:
    """The synopsis of both tables' rows, from their synopses alone: an incremental update."""
    both = a.unionByName(b)
    mean = F.sum(F.col("cnt") * F.col("mean_s")) / F.sum("cnt")
    square = F.sum(F.col("cnt") * (F.col("var_s") + F.col("mean_s") * F.col("mean_s"))) / F.sum("cnt")
    hist = F.array(*[F.sum(F.col("hist")[i]) for i in range(BINS)])
    return both.groupBy(ident).agg(F.sum("cnt").alias("cnt"), F.min("min_s").alias("min_s"), F.max("max_s").alias("max_s"), mean.alias("mean_s"), F.greatest(F.lit(0.0), square - mean * mean).alias("var_s"), hist.alias("hist"))


def overlaps(low: Column, high: Column) -> Column:
    """Whether a list's scalars can lie in the range; open bounds let all pass."""
    return ~(F.coalesce(high < F.col("min_s"), F.lit(False)) | F.coalesce(low > F.col("max_s"), F.lit(False)))


def hit_estimate(low: Column, high: Column, lo: float, hi: float) -> Column:
    """Rows of a synopsis expected in the range: whole bins count, cut ones by their share."""
    width = (hi - lo) / BINS
    left = F.greatest(low, F.lit(lo))
    right = F.least(high, F.lit(hi))
    shares = F.aggregate(
        F.transform("hist", lambda n, i: n * F.greatest(F.lit(0.0), F.least(right, F.lit(lo) + (i + 1) * width) - F.greatest(left, F.lit(lo) + i * width)) / width if width > 0 else n * 1.0),
        F.lit(0.0),
        lambda s, x: s + x,
    )
    total = F.aggregate("hist", F.lit(0).cast("long"), lambda s, x: s + x)
    part = F.least(F.col("cnt"), F.ceil(F.round(shares * F.col("cnt") / total, 9)))
    whole = (low <= F.col("min_s")) & (high >= F.col("max_s"))
    none = (high < low) | (high < F.col("min_s")) | (low > F.col("max_s")) | (F.col("cnt") == 0)
    return F.when(none, F.lit(0).cast("long")).when(whole | (total == 0) | F.lit(not hi > lo), F.col("cnt")).otherwise(part.cast("long"))


def selectivity(low: Column, high: Column, lo: float, hi: float) -> Column:
    return F.when(F.col("cnt") > 0, F.least(F.lit(1.0), hit_estimate(low, high, lo, hi) / F.col("cnt"))).otherwise(0.0)


def selectivity_open(hist: str, low: Column, high: Column, lo: float, hi: float, bins: int = BINS) -> Column:
    """Share of a list's rows in the range by its ``histogram_open`` as an array of bins + 2 counts: whole outer slots, inner ones by share; 1 without a domain or rows."""
    total = F.aggregate(hist, F.lit(0).cast("long"), lambda s, x: s + x)
    scale = bins / (hi - lo) if hi > lo else 0.0
    left, right = F.greatest(F.lit(0.0), (low - lo) * scale), F.least(F.lit(float(bins)), (high - lo) * scale)
    inner = F.transform(F.slice(hist, 2, bins), lambda n, i: n * F.greatest(F.lit(0.0), F.least(right, i + 1.0) - F.greatest(left, i * 1.0)))
    outer = F.when(low < lo, F.get(F.col(hist), F.lit(0))).otherwise(0) + F.when(high > hi, F.get(F.col(hist), F.lit(bins + 1))).otherwise(0)
    whole = F.when((high < lo) | (low > hi), outer.cast("double")).otherwise(outer + F.aggregate(inner, F.lit(0.0), lambda s, x: s + x))
    return F.when(F.lit(not hi > lo) | (total == 0), 1.0).when(low > high, 0.0).otherwise(whole / total)


def centroid_update_threshold(drifts: DataFrame, base: float = 0.1) -> DataFrame:
    """Mean and half a deviation of the shifts, between half and twice the base (the base without shifts): threshold."""
    mean = F.avg("shift") + 0.5 * F.stddev_pop("shift")
    return drifts.agg(F.coalesce(F.greatest(F.lit(0.5 * base), F.least(F.lit(2.0 * base), mean)), F.lit(base)).alias("threshold"))


def utility(low: Column, high: Column, lo: float, hi: float) -> Column:
    """How promising a list is for a range, 0 to 1: expected mass, density, nearness of the mean and overlap, damped for small lists."""
    n = F.greatest(F.lit(1), F.col("cnt")).cast("double")
    hit = hit_estimate(low, high, lo, hi).cast("double")
    mass = F.log1p(hit) / F.log1p(n)
    density = F.sqrt(F.least(F.lit(1.0), hit / n))
    over = F.greatest(F.lit(0.0), F.least(high, F.col("max_s")) - F.greatest(low, F.col("min_s")))
    span, wide = F.greatest(F.lit(1e-6), F.col("max_s") - F.col("min_s")), F.greatest(F.lit(1e-6), high - low)
    boundary = F.sqrt(F.least(F.lit(1.0), over / span) * F.least(F.lit(1.0), over / wide))
    whole = max(hi - lo, 1e-6)
    gap = F.greatest(F.lit(0.0), low - F.col("mean_s"), F.col("mean_s") - high)
    sigma = F.sqrt(F.col("var_s")) + F.lit(max(1e-6, 1e-4 * whole))
    mean = 1 / (1 + (gap / sigma) * (gap / sigma)) / (1 + sigma / whole)
    mixed = n / (n + 32) * (0.45 * mass + 0.25 * density + 0.20 * mean + 0.10 * boundary)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), mixed))


def quality(members: DataFrame, max_size: int, ident: str = "fine_id") -> DataFrame:
    """Of each list: size, mean and largest distance to its centroid, and quality by both measures. ``members`` has dist_sq."""
    d = F.sqrt("dist_sq")
    found = members.groupBy(ident).agg(F.count(F.lit(1)).alias("n"), F.avg(d).alias("mean_dist"), F.max(d).alias("max_dist"), F.avg("dist_sq").alias("mean_sq"))
    sized = F.least(F.lit(1.0), F.lit(float(max_size)) / F.col("n")) / (1 + F.col("mean_dist"))
    return found.select(ident, "n", "mean_dist", "max_dist", sized.alias("quality"), (1 / (1 + F.col("mean_sq"))).alias("compactness"))


def bounds(rows: DataFrame, ident: str = "fine_id") -> DataFrame:
    """Smallest and largest value of each dimension of each list."""
    spread = rows.select(ident, F.posexplode(V.vector("embedding")).alias("dim", "x"))
    return spread.groupBy(ident, "dim").agg(F.min("x").alias("low"), F.max("x").alias("high"))


def sums(rows: DataFrame, ident: str = "fine_id") -> DataFrame:
    """Count, scalar sum and vector sum of each list and dimension: what increments add up."""
    spread = rows.select(ident, F.posexplode(V.vector("embedding")).alias("dim", "x"))
    return spread.groupBy(ident, "dim").agg(F.sum("x").alias("total"), F.count(F.lit(1)).alias("n"))


def change_sums(held: DataFrame, changes: DataFrame, sign: int = 1, ident: str = "fine_id") -> DataFrame:
    """``sums`` after rows (given by their own ``sums``) were added (sign 1) or taken out (-1); what has no rows left goes."""
    more = changes.select(ident, "dim", (F.col("total") * sign).alias("total"), (F.col("n") * sign).alias("n"))
    both = held.unionByName(more).groupBy(ident, "dim").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    return both.where("n > 0")


def refresh_from_sums(centroids: DataFrame, sums: DataFrame, dirty: DataFrame | None = None, ident: str = "fine_id") -> DataFrame:
    """Centroids with those of the ``dirty`` lists (all without) moved to their sums' means; lists without rows stay."""
    if dirty is not None:
        sums = sums.join(F.broadcast(dirty.select(ident)), ident, "left_semi")
    mean = sums.groupBy(ident).agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", (F.col("total") / F.col("n")).alias("x")))), lambda p: p["x"]).alias("_new"))
    return centroids.join(mean, ident, "left").withColumn("centroid", F.coalesce("_new", V.vector("centroid"))).drop("_new")


def weighted_mean(vectors: DataFrame, group: str, weight: str, vec: str = "centroid") -> DataFrame:
    """Weighted mean vector of each group; a weight of zero counts as one."""
    w = F.greatest(F.lit(1), F.col(weight)).cast("double")
    spread = vectors.select(group, w.alias("w"), F.posexplode(V.vector(vec)).alias("dim", "x"))
    means = spread.groupBy(group, "dim").agg((F.sum(F.col("w") * F.col("x")) / F.sum("w")).alias("x"))
    return means.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda p: p["x"]).alias(vec))


def drift(now: DataFrame, before: DataFrame, ident: str = "fine_id") -> DataFrame:
    """How far each centroid has moved, and the share of its former length."""
    a, b = now.select(ident, V.vector("centroid").alias("_now")), before.select(ident, V.vector("centroid").alias("_was"))
    moved = a.join(b, ident).withColumn("shift", V.l2("_now", "_was"))
    return moved.select(ident, "shift", (F.col("shift") / F.greatest(F.lit(1e-12), F.sqrt(V.norm_sq("_was")))).alias("rel_shift"))


def imbalance(sizes: DataFrame, drifts: DataFrame, initial: DataFrame, ident: str = "fine_id") -> DataFrame:
    """Spread of list sizes, centroid drift, and their indicator g (g_fast: sizes alone)."""
    s = sizes.agg(F.avg("n").alias("mean_n"), F.stddev_pop("n").alias("sd_n"))
    d = drifts.agg(F.avg("shift").alias("drift"), F.stddev_pop("shift").alias("drift_sd"))
    length = initial.agg(F.avg(F.sqrt(V.norm_sq(V.vector("centroid")))).alias("length"))
    one = s.crossJoin(d).crossJoin(length)  # one row each
    cv = F.when(F.col("mean_n") > 0, F.col("sd_n") / F.col("mean_n")).otherwise(0.0)
    rel = F.when(F.col("length") > 0, F.col("drift") / F.col("length")).otherwise(0.0)
    uneven = F.when(F.col("drift") > 0, F.col("drift_sd") / F.col("drift")).otherwise(0.0)
    cap = lambda c: F.least(c, F.lit(1.0))
    return one.select("mean_n", "sd_n", "drift", "drift_sd", cap(cv).alias("g_fast"), (0.4 * cap(cv) + 0.4 * cap(rel) + 0.2 * cap(uneven)).alias("g"))


def coarse_imbalance(coarse: DataFrame) -> DataFrame:
    """Capped variation of coarse sizes, over coarse lists that have rows."""
    return coarse.where("n > 0").agg((F.stddev_pop("n") / F.avg("n")).alias("cv")).select("cv", F.least("cv", F.lit(1.0)).alias("g_coarse"))


def coarse_radius(fines: DataFrame, coarse: DataFrame) -> DataFrame:
    """Root of the size-weighted mean squared distance of fine centroids (fine_id, coarse_id, centroid, n) to their coarse one."""
    c = coarse.select("coarse_id", V.vector("centroid").alias("_c"))
    d = fines.join(F.broadcast(c), "coarse_id").withColumn("d", V.l2_sq(V.vector("centroid"), "_c")).withColumn("w", F.greatest(F.lit(1), F.col("n")))
    return d.agg(F.sqrt(F.sum(F.col("w") * F.col("d")) / F.sum("w")).alias("radius"))


def adaptive_threshold(history: DataFrame, sensitivity: float, base: float, low: float, high: float, order: str = "step", value: str = "g") -> DataFrame:
    """Mean plus deviations of the last ten values, clamped; ``base`` before there are five."""
    w = Window.orderBy(order).rowsBetween(-9, 0)
    n, mean, sd = F.count(value).over(w), F.avg(value).over(w), F.stddev_pop(value).over(w)
    return history.select(order, value, F.when(n < 5, F.lit(base)).otherwise(F.greatest(F.lit(low), F.least(F.lit(high), mean + sensitivity * sd))).alias("threshold"))


def search_totals(stats: DataFrame) -> DataFrame:
    """Sums of per-query counters, and their means."""
    names = [c for c in stats.columns if c != "qid"]
    return stats.agg(F.count(F.lit(1)).alias("queries"), *[F.sum(c).alias(f"{c}_total") for c in names], *[F.avg(c).alias(f"{c}_avg") for c in names])
