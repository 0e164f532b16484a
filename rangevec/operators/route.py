"""Which lists a query visits: two-level routing, range pruning and re-ranking.

Centroid tables are bounded by training parameters and broadcast; routing is a
join and ranked windows per query.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rangevec.functions import vectors as V
from rangevec.operators import stats
from rangevec.operators.search import _ranges, top_k


def nearest_lists(queries: DataFrame, centroids: DataFrame, n: int, ident: str = "fine_id") -> DataFrame:
    """(qid, ident, d, rank) of the n nearest centroids of each query."""
    c = centroids.select(ident, V.vector("centroid").alias("_c"))
    d = queries.select("qid", V.vector("qvec").alias("_q")).crossJoin(F.broadcast(c)).select("qid", ident, V.l2_sq("_q", "_c").alias("d"))
    return top_k(d, n, order="d", ident=ident, rank="rank")


def two_level(queries: DataFrame, fine: DataFrame, coarse: DataFrame, n_coarse: int, n_fine: int) -> DataFrame:
    """The nearest lists among those of each query's nearest coarse lists: at most n_coarse times n_fine of them. ``fine`` has coarse_id."""
    near = nearest_lists(queries, coarse, n_coarse, "coarse_id").select("qid", "coarse_id")
    c = fine.select("fine_id", "coarse_id", V.vector("centroid").alias("_c"))
    q = queries.select("qid", V.vector("qvec").alias("_q"))
    d = near.join(F.broadcast(c), "coarse_id").join(q, "qid").select("qid", "fine_id", V.l2_sq("_q", "_c").alias("d"))
    return top_k(d, n_coarse * n_fine, order="d", ident="fine_id", rank="rank")


def union_route(queries: DataFrame, fine: DataFrame, coarse: DataFrame, n_coarse: int, n_near: int) -> DataFrame:
    """All lists of each query's nearest coarse lists, together with its nearest lists of any."""
    near = nearest_lists(queries, coarse, n_coarse, "coarse_id").select("qid", "coarse_id")
    ids = near.join(F.broadcast(fine.select("fine_id", "coarse_id")), "coarse_id").select("qid", "fine_id")
    ids = ids.union(nearest_lists(queries, fine, n_near).select("qid", "fine_id")).distinct()
    c = fine.select("fine_id", V.vector("centroid").alias("_c"))
    q = queries.select("qid", V.vector("qvec").alias("_q"))
    d = ids.join(F.broadcast(c), "fine_id").join(q, "qid").select("qid", "fine_id", V.l2_sq("_q", "_c").alias("d"))
    return d.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("d", "fine_id")))


def with_synopsis(routed: DataFrame, queries: DataFrame, synopsis: DataFrame) -> DataFrame:
    """Routed lists with the query's range and the list's synopsis (lists without rows have none)."""
    ranges = _ranges(queries).select("qid", "range_min", "range_max")
    return routed.join(F.broadcast(synopsis), "fine_id", "left").join(ranges, "qid")


def _bound(c: str, lo: float, hi: float) -> Column:
    return F.coalesce(F.col(c), F.lit(lo if c == "range_min" else hi))


def prune(routed: DataFrame, queries: DataFrame, synopsis: DataFrame) -> DataFrame:
    """Lists whose scalars can lie in the query's range; all of a query's lists if none can."""
    seen = with_synopsis(routed, queries, synopsis)
    ok = F.col("cnt").isNotNull() & stats.overlaps(F.col("range_min"), F.col("range_max"))
    any_ = F.max(ok.cast("int")).over(Window.partitionBy("qid"))
    return seen.withColumn("_ok", ok).withColumn("_any", any_).where("_ok OR _any = 0").select("qid", "fine_id", "d", "rank")


def scored(routed: DataFrame, queries: DataFrame, synopsis: DataFrame, lo: float, hi: float, epsilon: float = 0.25) -> DataFrame:
    """Routed lists with utility and the filter-aware score d / (1 + epsilon/4 utility); a list that overlaps has some utility."""
    seen = with_synopsis(routed, queries, synopsis)
    low, high = _bound("range_min", lo, hi), _bound("range_max", lo, hi)
    u = F.coalesce(stats.utility(low, high, lo, hi), F.lit(0.0))
    some = F.coalesce(stats.overlaps(low, high) & F.col("cnt").isNotNull(), F.lit(False))
    u = F.when((u == 0) & some, 0.005).otherwise(u)
    return seen.withColumn("utility", u).select("qid", "fine_id", "d", "rank", "utility", (F.col("d") / (1 + 0.25 * epsilon * F.col("utility"))).alias("score"))


def rerank_tail(lists: DataFrame, protected: float = 0.7) -> DataFrame:
    """The first lists of a query keep their ranks, the last 30 % are put in order of utility."""
    n = F.count(F.lit(1)).over(Window.partitionBy("qid"))
    head = F.ceil(F.round(n * protected, 9))
    split = lists.withColumn("_tail", F.col("rank") > head)
    order = Window.partitionBy("qid").orderBy("_tail", F.when(F.col("_tail"), -F.col("utility")), "rank")
    return split.withColumn("new_rank", F.row_number().over(order)).drop("_tail")


def smallest_first(routed: DataFrame, sizes: DataFrame) -> DataFrame:
    """Routed lists in order of size, then of their former rank."""
    x = routed.join(F.broadcast(sizes.select("fine_id", F.col("n").alias("_n"))), "fine_id", "left")
    w = Window.partitionBy("qid").orderBy(F.coalesce("_n", F.lit(0)), "rank")
    return x.withColumn("rank", F.row_number().over(w)).select(routed.columns)


def of_chosen(queries: DataFrame, fine: DataFrame, chosen: DataFrame, n: int, synopsis: DataFrame | None = None, least: float = 0.05) -> DataFrame:
    """The n nearest lists of each query's chosen coarse ones (qid, coarse_id): (qid, fine_id, d, rank).

    With a synopsis, of those *that can match the query's range*, so a pruned
    list is replaced by the next nearest. All stay where none can match, or where
    pruning would take less than the share ``least`` of them.
    """
    c = fine.select("fine_id", "coarse_id", V.vector("centroid").alias("_c"))
    q = queries.select("qid", V.vector("qvec").alias("_q"))
    d = chosen.join(F.broadcast(c), "coarse_id").join(q, "qid").select("qid", "fine_id", V.l2_sq("_q", "_c").alias("d"))
    if synopsis is not None:
        seen = with_synopsis(d, queries, synopsis)
        seen = seen.withColumn("_ok", F.col("cnt").isNotNull() & stats.overlaps(F.col("range_min"), F.col("range_max")))
        w = Window.partitionBy("qid")
        seen = seen.withColumn("_in", F.sum(F.col("_ok").cast("int")).over(w)).withColumn("_all", F.count(F.lit(1)).over(w))
        d = seen.where(F.col("_ok") | (F.col("_in") == 0) | (F.col("_all") - F.col("_in") < least * F.col("_all")))
    return top_k(d, n, order="d", ident="fine_id", rank="rank").select("qid", "fine_id", "d", "rank")


def pruned_first(queries: DataFrame, fine: DataFrame, coarse: DataFrame, synopsis: DataFrame, n_coarse: int, n: int) -> DataFrame:
    """``of_chosen`` for each query's ``n_coarse`` nearest coarse lists."""
    return of_chosen(queries, fine, nearest_lists(queries, coarse, n_coarse, "coarse_id").select("qid", "coarse_id"), n, synopsis)


# Fixed values of the fan-out: near tie of squared distances, (rows from which, extra lists), soft syncs, share of the drift limit.
FAN_TIE, FAN_OUT, FAN_SYNCS, FAN_DRIFT = 0.005, ((7_000_000, 1), (8_500_000, 2), (9_000_000, 3)), 24, 0.75
# Fixed values of the filter gate: sample, shares beyond which it is off, contrast, least utility that counts, share up to which lists are pruned, flat routing.
GATE_SAMPLE, GATE_OVERLAP, GATE_POSITIVE, GATE_MIXED, GATE_CONTRAST, GATE_LEAST, GATE_PRUNE, GATE_FLAT = 64, 0.85, 0.65, 0.70, 1.30, 0.0051, 0.80, 0.90


def fan_out(coarse_ranked: DataFrame, n: int, rows: int, soft_syncs: int = 0, rel_shift: float = 0.0, tau: float = 0.06, ratio: float = FAN_TIE) -> DataFrame:
    """How many more coarse lists a query visits (qid, extra): some where the index is late and the next list nearly ties with the n-th.

    ``coarse_ranked`` has qid, d (squared distance) and rank of all coarse lists.
    Late means many rows, many soft syncs or drift.
    """
    late = rows >= FAN_OUT[0][0] or soft_syncs >= FAN_SYNCS or rel_shift >= FAN_DRIFT * tau
    extra = max([FAN_OUT[0][1], *(x for at, x in FAN_OUT if rows >= at)]) if late else 0
    at = lambda r: F.max(F.when(F.col("rank") == r, F.col("d")))
    tie = coarse_ranked.groupBy("qid").agg(at(n).alias("nth"), at(n + 1).alias("next"), F.count(F.lit(1)).alias("lists"))
    near = F.coalesce(F.col("next") - F.col("nth") <= ratio * F.greatest(F.lit(1.0), F.col("nth")), F.lit(False))
    return tie.select("qid", F.when(near, F.least(F.lit(extra), F.col("lists") - n)).otherwise(0).cast("long").alias("extra"))


def _spaced(lists: DataFrame, sample: int) -> DataFrame:
    """Up to ``sample`` lists of each query, evenly spaced by rank."""
    n = F.count(F.lit(1)).over(Window.partitionBy("qid"))
    stride = F.greatest(F.lit(1), F.floor(F.col("_n") / F.least(F.lit(sample), F.col("_n"))))
    at = F.col("rank") - 1
    return lists.withColumn("_n", n).where((at % stride == 0) & (F.floor(at / stride) < sample)).drop("_n")


def filter_gate(lists: DataFrame, queries: DataFrame, synopsis: DataFrame, lo: float, hi: float, sample: int = GATE_SAMPLE) -> DataFrame:
    """Whether routing by range pays for a query (aware), and whether lists are pruned: from overlap and utility of evenly spaced lists."""
    u = scored(_spaced(lists, sample), queries, synopsis, lo, hi).groupBy("qid").agg(
        F.avg((F.col("utility") > 0).cast("int")).alias("overlap"), F.avg((F.col("utility") > GATE_LEAST).cast("int")).alias("positive"), F.max("utility").alias("best"), F.avg("utility").alias("mean")
    )
    contrast = F.col("best") / F.greatest(F.lit(1e-6), F.col("mean"))
    off = (F.col("overlap") > GATE_OVERLAP) | (F.col("positive") > GATE_POSITIVE) | ((F.col("overlap") > GATE_MIXED) & (contrast < GATE_CONTRAST))
    return u.select("qid", "overlap", "positive", contrast.alias("contrast"), (~off).alias("aware"), (~off & (F.col("overlap") <= GATE_PRUNE)).alias("prune"))


def choose_flat(lists: DataFrame, queries: DataFrame, synopsis: DataFrame, sample: int = 16) -> DataFrame:
    """(qid, flat): queries whose range nearly all of their first lists overlap take flat rather than graph routing."""
    seen = with_synopsis(lists.where(F.col("rank") <= sample), queries, synopsis)
    over = F.coalesce(stats.overlaps(F.col("range_min"), F.col("range_max")) & F.col("cnt").isNotNull(), F.lit(False))
    return seen.groupBy("qid").agg((F.avg(over.cast("int")) > GATE_FLAT).alias("flat"))
