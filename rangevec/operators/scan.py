"""Scans of routed lists: range filter, budgets, distance, best rows.

A budget stops a query's scan at a place in a total order: lists by rank, in a
list the main segment by scalar, then the delta segment by arrival, then id.
The running counts are windows over each query's rows; range and tombstones are
applied below them.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rangevec.functions import vectors as V
from rangevec.operators.search import _ranges, _union, blocks, top_k

#: Query bytes of a block whose pairs with lists (24 bytes for each list probed) are broadcast too.
LIST_BLOCK_BYTES = 8 << 20


def list_rows(routed: DataFrame, queries: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows in range of each query's routed lists, with their distance.

    Pairs (query, list) and queries are broadcast in bounded blocks, so the rows
    are scanned where they are and never shuffled.
    """
    segment = F.col("segment") if "segment" in rows.columns else F.lit("main")
    x = rows.select("vec_id", "fine_id", F.col("scalar").cast("double").alias("scalar"), segment.alias("segment"), V.vector("embedding").alias("_x"))
    ok = V.in_range("scalar", "range_min", "range_max") | (F.col("range_min").isNull() & F.col("range_max").isNull())
    parts = blocks(_ranges(queries), LIST_BLOCK_BYTES)
    found = []
    for q in parts:
        pairs = routed.select("qid", "fine_id", "rank")
        if len(parts) > 1:
            pairs = pairs.join(F.broadcast(q.select("qid")), "qid", "left_semi")
        met = x.join(F.broadcast(pairs), "fine_id").join(F.broadcast(q), "qid").where(ok)
        found.append(met.select("qid", "fine_id", "rank", "vec_id", "scalar", "segment", V.l2("qvec", "_x").alias("dist")))
    return _union(found)


def search_lists(routed: DataFrame, queries: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    return top_k(list_rows(routed, queries, rows), k).select("qid", "rnk", "vec_id", "dist")


def _place():
    main = F.when(F.col("segment") == "main", 0).otherwise(1)
    return [F.col("rank"), main, F.when(F.col("segment") == "main", F.col("scalar")), F.col("vec_id")]


def budgeted(found: DataFrame, budget: int) -> DataFrame:
    """The first ``budget`` rows of each query's scan."""
    w = Window.partitionBy("qid").orderBy(*_place())
    return found.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= budget)


def prefix_budgeted(found: DataFrame, budgets: DataFrame, total: int | None = None) -> DataFrame:
    """Each list may use what earlier lists left of theirs. ``budgets``: qid, fine_id, budget.

    With S(i) rows and B(i) budget up to list i, what is scanned up to list i is
    S(i) + min(0, min over j <= i of B(j) - S(j)): no loop over lists.
    """
    sizes = found.groupBy("qid", "fine_id", "rank").agg(F.count(F.lit(1)).alias("size"))
    upto = Window.partitionBy("qid").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    lists = sizes.join(budgets.select("qid", "fine_id", "budget"), ["qid", "fine_id"])
    lists = lists.withColumn("s", F.sum("size").over(upto)).withColumn("b", F.sum("budget").over(upto))
    if total is not None:
        lists = lists.withColumn("b", F.least("b", F.lit(total)))
    lists = lists.withColumn("done", F.col("s") + F.least(F.lit(0), F.min(F.col("b") - F.col("s")).over(upto)))
    before = F.coalesce(F.lag("done").over(Window.partitionBy("qid").orderBy("rank")), F.lit(0))
    lists = lists.withColumn("take", F.col("done") - before).select("qid", "fine_id", "take")
    nth = F.row_number().over(Window.partitionBy("qid", "fine_id").orderBy(*_place()))
    return found.withColumn("nth", nth).join(lists, ["qid", "fine_id"]).where(F.col("nth") <= F.col("take")).drop("nth", "take")


def stop_after(found: DataFrame, threshold: int, least_share: float = 0.0) -> DataFrame:
    """Lists are visited until earlier ones gave ``threshold`` rows and (by rank) the least share of lists was visited."""
    sizes = found.groupBy("qid", "fine_id", "rank").agg(F.count(F.lit(1)).alias("size"))
    w = Window.partitionBy("qid").orderBy("rank")
    given = F.coalesce(F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    lists = F.max("rank").over(Window.partitionBy("qid"))
    go = (given < threshold) | (F.col("rank") - 1 < F.lit(least_share) * lists)
    return found.join(sizes.withColumn("_go", go).where("_go").select("qid", "fine_id"), ["qid", "fine_id"])


# Fixed values of the targeted budgets: decay of ranks, reliability, floors and caps, and the shares of sampled lists beyond which they aren't used.
RANK_DECAY, RELIABILITY, LEAST = 48.0, 32.0, 8.0
HIT_FLOOR, HIT_FLOOR_PLUS, HIT_CAP, HIT_CAP_PLUS, MEAN_CAP = 3.0, 4.0, 2.0, 16.0, 3.0
GATE_SAMPLE, GATE_OVERLAP, GATE_HIT = 64, 0.85, 0.65


def targeting_pays(lists: list[tuple[bool, int]]) -> bool:
    """Whether a query's lists (overlap, expected hits; in order) differ enough: up to 64 of them, evenly spaced, are looked at."""
    sample = lists[:: max(1, len(lists) // max(1, min(GATE_SAMPLE, len(lists))))][:GATE_SAMPLE]
    over, hit = (sum(1 for x in sample if x[i]) / max(1, len(sample)) for i in (0, 1))
    return len(lists) > 1 and over <= GATE_OVERLAP and hit <= GATE_HIT


def targeted_budgets(lists: list[tuple[int, int, int]], budget: int) -> list[int]:
    """Budgets of one query's lists from (rank from 0, rows, expected hits): by rank, hits, purity and size.

    Each list gets a base; too large bases shrink to the budget. What is left is
    dealt once by gain, up to a cap, and the remainder one by one, the largest
    fractions first, as long as a list has room.
    """
    if not lists:
        return []
    mean = budget / len(lists)
    base, cap, gain = [], [], []
    for rank, rows, hit in lists:
        rows = max(1, rows)
        decay = math.exp(-rank / RANK_DECAY)
        wanted = max(LEAST, mean * decay, HIT_FLOOR * math.sqrt(hit) + HIT_FLOOR_PLUS)
        base.append(math.ceil(round(min(rows, wanted), 9)))
        cap.append(math.ceil(round(min(rows, max(wanted, HIT_CAP * hit + HIT_CAP_PLUS, MEAN_CAP * mean)), 9)))
        gain.append(decay * math.log1p(hit) * math.sqrt(min(1.0, hit / rows)) * rows / (rows + RELIABILITY))
    spent, mass = sum(base), sum(gain)
    if spent > budget:
        out = [max(1, math.floor(round(b * budget / spent, 9))) for b in base]
        over = sum(out) - budget
        for i in range(len(out)):
            if over > 0 and out[i] > 1:
                out[i] -= 1
                over -= 1
        return out
    if mass <= 0:
        return base
    out, left, part = list(base), budget - spent, []
    for i in (i for i in range(len(out)) if cap[i] > base[i] and gain[i] > 0):
        share = round((budget - spent) * gain[i] / mass, 9)
        more = min(cap[i] - base[i], math.floor(share))
        out[i] += more
        left -= more
        part.append((-(share - more), i))
    turn = [i for _, i in sorted(part)]
    while left > 0 and any(out[i] < cap[i] for i in turn):
        for i in turn:
            if left > 0 and out[i] < cap[i]:
                out[i] += 1
                left -= 1
    return out


def targeted(routed: DataFrame, budget: int) -> DataFrame:
    """Budgets (qid, fine_id, budget) of each query's lists; ``routed`` has qid, fine_id, rank, cnt, hit and whether the list overlaps (over).

    Where targeting doesn't pay, each list may use the whole budget. A query's
    lists are as few as are routed, so a group is small.
    """
    import pandas as pd

    def run(group: pd.DataFrame) -> pd.DataFrame:
        g = group.sort_values("rank")
        over, hit = g["over"].tolist(), [int(h) for h in g["hit"]]
        if targeting_pays(list(zip(over, hit))):
            got = targeted_budgets([(i, int(c), h) for i, (c, h) in enumerate(zip(g["cnt"], hit))], budget)
        else:
            got = [budget] * len(g)
        return pd.DataFrame({"qid": g["qid"], "fine_id": g["fine_id"], "budget": got})

    return routed.select("qid", "fine_id", "rank", F.coalesce("cnt", F.lit(0)).alias("cnt"), F.coalesce("hit", F.lit(0)).alias("hit"), F.coalesce("over", F.lit(False)).alias("over")).groupBy("qid").applyInPandas(run, "qid long, fine_id int, budget long")


def trim(found: DataFrame, n: int) -> DataFrame:
    """Each query's n nearest rows: what later steps look at."""
    return top_k(found, n, rank="_near").drop("_near")


def single_level(queries: DataFrame, centroids: DataFrame, rows: DataFrame, sizes: DataFrame, k: int, n_probe: int, threshold: int) -> DataFrame:
    """One-level search: the nearest lists, the smallest first, until earlier ones gave ``threshold`` rows in range."""
    from rangevec.operators.route import nearest_lists, smallest_first

    lists = smallest_first(nearest_lists(queries, centroids, n_probe), sizes)
    return top_k(stop_after(list_rows(lists, queries, rows), threshold), k).select("qid", "rnk", "vec_id", "dist")


def counters(routed: DataFrame, found: DataFrame) -> DataFrame:
    """Per query: lists visited, rows in range, distances computed."""
    lists = routed.groupBy("qid").agg(F.count(F.lit(1)).alias("lists"))
    rows = found.groupBy("qid").agg(F.count(F.lit(1)).alias("distances"), F.countDistinct("fine_id").alias("lists_hit"))
    return lists.join(rows, "qid", "left").select("qid", "lists", F.coalesce("lists_hit", F.lit(0)).alias("lists_hit"), F.coalesce("distances", F.lit(0)).alias("distances"))
