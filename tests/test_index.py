import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rangevec.functions import vectors as V
from rangevec.operators import assign, graph, kmeans, mutate, pq, scan, search, stats
from rangevec.plans import tuning
from rangevec.plans.index import RangeIndex
from rangevec.sources import store
from rangevec.streaming.insert import insert_stream

SCHEMA = "vec_id long, embedding array<double>, scalar double"


def blobs(n=240, groups=8, dims=4, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, dims)) * 10
    return [(i, [float(x) for x in centres[i % groups] + rng.normal(size=dims) * 0.3], float(i)) for i in range(n)]


def brute(rows, q, k, lo=None, hi=None):
    d = [(math.dist(v, q), i) for i, v, s in rows if (lo is None and hi is None) or (s is not None and (lo is None or s >= lo) and (hi is None or s <= hi))]
    return [i for _, i in sorted(d)[:k]]


def ids(df):
    out = {}
    for r in df.orderBy("qid", "rnk").collect():
        out.setdefault(r["qid"], []).append(r["vec_id"])
    return out


@pytest.fixture(scope="module")
def rows():
    return blobs()


@pytest.fixture(scope="module")
def asked(spark, rows):
    q = [(0, rows[5][1], 50.0, 120.0), (1, rows[9][1], None, None), (2, rows[9][1], 100.0, None), (3, rows[9][1], 90.0, 10.0), (4, rows[7][1], 7.0, 7.0)]
    return spark.createDataFrame(q, "qid long, qvec array<double>, range_min double, range_max double")


@pytest.fixture(scope="module")
def index(spark, rows):
    base = spark.createDataFrame(rows, SCHEMA)
    made = RangeIndex(spark, n_fine=12, n_coarse=4, n_probe=12, n_probe_coarse=4).train(base, rounds=4)
    return made.add(base.where("vec_id < 160")).add(base.where("vec_id >= 160"))


def test_all_lists_probed_is_exact(index, rows, asked):
    want = {0: brute(rows, rows[5][1], 7, 50, 120), 1: brute(rows, rows[9][1], 7), 2: brute(rows, rows[9][1], 7, 100), 4: brute(rows, rows[7][1], 7, 7, 7)}
    assert ids(index.search(asked, 7, exact=True)) == want
    assert ids(index.search(asked, 7)) == want
    for kernel in (False, True):
        assert ids(search.knn(index.live(), asked, 7, kernel=kernel)) == want


def test_clustered_recall_with_few_probes(index, rows, asked):
    got = ids(index.search(asked.where("qid = 1"), 5, n_probe=3))
    assert len(set(got[1]) & set(brute(rows, rows[9][1], 5))) >= 4


def test_graph_routing_finds_as_much(spark, index, asked):
    index.params.graph_routing = True
    try:
        assert ids(index.search(asked, 7))[1] == ids(index.search(asked, 7, exact=True))[1]
    finally:
        index.params.graph_routing = False


def test_filter_aware_keeps_results(index, asked):
    want = ids(index.search(asked, 7))
    index.params.filter_aware = True
    try:
        assert ids(index.search(asked, 7)) == want
    finally:
        index.params.filter_aware = False


def test_more_k_than_rows_and_single_row(spark):
    base = spark.createDataFrame([(1, [0.0, 1.0], 5.0)], SCHEMA)
    q = spark.createDataFrame([(0, [0.0, 0.0], None, None)], "qid long, qvec array<double>, range_min double, range_max double")
    assert ids(search.knn(base, q, 9)) == {0: [1]}


def test_ties_go_to_smaller_ids(spark):
    base = spark.createDataFrame([(i, [1.0, 1.0], 1.0) for i in (9, 3, 7, 5)], SCHEMA)
    q = spark.createDataFrame([(0, [0.0, 0.0])], "qid long, qvec array<double>")
    for kernel in (False, True):
        assert ids(search.knn(base, q, 3, kernel=kernel)) == {0: [3, 5, 7]}


def test_null_scalars_match_no_range(spark):
    base = spark.createDataFrame([(1, [0.0], None), (2, [1.0], 1.7e9), (3, [2.0], -1.0)], SCHEMA)
    q = spark.createDataFrame([(0, [0.0], None, None), (1, [0.0], -2.0, None), (2, [0.0], 1.7e9, 1.8e9)], "qid long, qvec array<double>, range_min double, range_max double")
    for kernel in (False, True):
        assert ids(search.knn(base, q, 9, kernel=kernel)) == {0: [1, 2, 3], 1: [2, 3], 2: [2]}


def test_wrong_width_and_untrained_fail(spark, index):
    with pytest.raises(Exception, match="values"):
        index.add(spark.createDataFrame([(9999, [1.0], 1.0)], SCHEMA))
    with pytest.raises(RuntimeError):
        RangeIndex(spark).search(None, 1)
    with pytest.raises(ValueError):
        RangeIndex(spark, n_probe=0)


def test_duplicates_are_refused_or_replaced(spark, rows):
    base = spark.createDataFrame(rows[:20], SCHEMA)
    made = RangeIndex(spark, n_fine=4, n_coarse=2).train(base, rounds=1).add(base)
    with pytest.raises(ValueError):
        made.add(base.where("vec_id = 3"))
    made.add(base.where("vec_id = 3").withColumn("scalar", F.lit(-5.0)), replace=True)
    assert made.rows.where("vec_id = 3").select("scalar").collect() == [(-5.0,)]
    assert made.rows.count() == 20


def test_numbers_follow_the_largest_id(spark, rows):
    base = spark.createDataFrame(rows[:20], SCHEMA)
    made = RangeIndex(spark, n_fine=4, n_coarse=2).train(base, rounds=1).add(base)
    made.add(base.select("embedding", F.col("scalar").alias("scalar")))
    new = made.rows.where("vec_id >= 20").orderBy("vec_id").collect()
    assert [r["vec_id"] for r in new] == list(range(20, 40)) and [r["scalar"] for r in new] == sorted(r["scalar"] for r in new)


def test_remove_compact_merge_reload(spark, tmp_path, rows, asked):
    base = spark.createDataFrame(rows, SCHEMA)
    made = RangeIndex(spark, n_fine=6, n_coarse=3, n_probe=6).train(base, rounds=2).add(base)
    made.remove(spark.createDataFrame([(9,), (17,), (10**6,)], "vec_id long"))
    made.remove(spark.createDataFrame([(9,)], "vec_id long"))
    left = [r for r in rows if r[0] not in (9, 17)]
    want = brute(left, rows[9][1], 6)
    assert ids(made.search(asked, 6))[1] == want
    assert made.totals().first().asDict() == {"n_vectors": 240, "n_deleted": 2, "n_live": 238}
    path = str(tmp_path / "index")
    made.save(path)
    made.compact(None).merge()
    assert made.totals().first().asDict() == {"n_vectors": 238, "n_deleted": 0, "n_live": 238}
    assert ids(made.search(asked, 6))[1] == want
    assert made.rows.where("segment <> 'main'").count() == 0
    made.save(path)
    again = RangeIndex.load(spark, path)
    assert ids(again.search(asked, 6))[1] == want
    again.add(spark.createDataFrame([(9, rows[9][1], 9.0)], SCHEMA))
    assert ids(again.search(asked, 6))[1][0] == 9
    made.remove(spark.createDataFrame([(9,)], "vec_id long"))
    assert made.totals().first()["n_live"] == 238  # compacted away: nothing to remove


def test_upkeep_keeps_results(spark, rows, asked):
    base = spark.createDataFrame(rows, SCHEMA)
    made = RangeIndex(spark, n_fine=6, n_coarse=3, n_probe=6, upkeep=True, merge_cap=8, max_list=60).train(base, rounds=1)
    made.add(base.where("vec_id % 2 = 0")).add(base.where("vec_id % 2 = 1"))
    made.rebuild_coarse().refresh_centroids()
    assert ids(made.search(asked, 7))[1] == brute(rows, rows[9][1], 7)
    assert made.imbalance().first()["g"] >= 0 and made.list_of(5) is not None
    assert made.size_stats().first()["lists"] == 6


def test_incremental_synopsis_equals_rebuilt(index):
    shown = lambda df: sorted((r["fine_id"], r["cnt"], r["min_s"], r["max_s"], round(r["mean_s"], 6), round(r["var_s"], 5), tuple(r["hist"])) for r in df.collect())
    assert shown(index.synopsis) == shown(stats.synopsis(index.rows, *index.domain))


def test_quantised_search(spark, index, asked):
    index.train_pq(index.rows, 2, 16)
    assert len(set(ids(index.search_pq(asked, 5))[1]) & set(ids(index.search(asked.where("qid = 1"), 5, exact=True))[1])) >= 3
    with pytest.raises(ValueError):
        pq.train(np.zeros((4, 5)), 2)


def test_stats_and_lists(index, asked):
    found, counted = index.search_with_stats(asked, 3)
    assert {r["lists"] for r in counted.collect()} and found.count()
    assert index.hybrid_search(asked, 3, 0.4).count() >= 9
    assert all(r["dist"] <= 0.5 for r in index.range_search(asked, 0.5).collect())


def test_stream_adds_each_batch_once(spark, tmp_path, rows):
    base = spark.createDataFrame(rows[:40], SCHEMA)
    for i in range(2):
        base.where(f"vec_id % 2 = {i}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    made = RangeIndex(spark, n_fine=4, n_coarse=2).train(base, rounds=1)
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    insert_stream(made, source, str(tmp_path / "check"), str(tmp_path / "out"), once=True).awaitTermination(120)
    assert made.rows.count() == 40 and RangeIndex.load(spark, str(tmp_path / "out")).rows.count() == 40


def test_prefix_budget_closed_form():
    rng = random.Random(4)
    for _ in range(500):
        sizes = [rng.randrange(0, 9) for _ in range(rng.randrange(1, 9))]
        budgets = [rng.randrange(0, 6) for _ in sizes]
        done, want = 0, []
        for i, n in enumerate(sizes):
            cap = max(done, sum(budgets[: i + 1]))
            done += min(n, cap - done)
            want.append(done)
        s = np.cumsum(sizes)
        assert list(s + np.minimum(0, np.minimum.accumulate(np.cumsum(budgets) - s))) == want


def test_targeted_budgets():
    assert scan.targeted_budgets([], 5) == []
    rng = random.Random(2)
    for _ in range(200):
        lists = [(i, n := rng.randrange(0, 400), rng.randrange(0, n + 1)) for i in range(rng.randrange(1, 12))]
        budget = rng.randrange(len(lists), 2000)
        got = scan.targeted_budgets(lists, budget)
        assert sum(got) <= budget and all(0 <= g <= max(1, n) for g, (_, n, _) in zip(got, lists))  # a list without rows counts as one row


def test_kmeans_pieces(spark, rows):
    base = spark.createDataFrame(rows, SCHEMA)
    start = np.array([r[1] for r in rows[:8]])
    one = kmeans.lloyd_step(base, start)
    x = np.array([r[1] for r in rows])
    at = ((x[:, None] - start[None]) ** 2).sum(2).argmin(1)
    assert np.allclose(one, [x[at == i].mean(0) if (at == i).any() else start[i] for i in range(8)])
    assert np.allclose(kmeans.fit(base, start, 10), kmeans.fit_local(x, start, 10))
    far = np.vstack([start, np.full((1, 4), 1e6)])
    assert np.allclose(kmeans.lloyd_step(base, far)[-1], 1e6)  # an empty list keeps its centroid
    assert len({tuple(c) for c in kmeans.plus_plus_start(x, 8)}) == 8
    assert [kmeans.rounds_for(*a) for a in ((10, 1), (20_000, 10), (200_000, 10), (200_000, 2000))] == [20, 30, 35, 40]
    assert [kmeans.training_size(n) for n in (50, 400_000, 600_000, 5_000_000)] == [50, 120_000, 240_000, 1_000_000]
    assert kmeans.training_size(5_000_000, capped=True) == 100_000


def test_kmeans_with_tasks_that_hold_no_row(spark, rows):
    base = spark.createDataFrame(rows[:3], SCHEMA)
    start = np.array([r[1] for r in rows[:2]])
    x = np.array([r[1] for r in rows[:3]])
    spread = base.repartition(9)
    assert np.allclose(kmeans.fit(spread, start, 3), kmeans.fit_local(x, start, 3))
    assert np.allclose(kmeans.lloyd_step(spread.where("vec_id < 0"), start), start)
    assert len(kmeans.fit_two_level(spread, 2, 1, rounds=2).fine) == 2
    listed = spread.withColumn("fine_id", F.lit(3)).withColumn("dist_sq", F.lit(0.0))
    centroids = spark.createDataFrame([(i, r[1]) for i, r in enumerate(rows[:8])], "fine_id int, centroid array<double>")
    assert mutate.local_recluster(listed, centroids, 3, 2, 1).count() <= 3


def test_numbers_of_rows_too_wide_for_one_task(spark):
    """Ids are dealt to all rows, however many tasks the exchange of the rows and that of their order alone are put together to."""
    wide = spark.range(3000).select(F.transform(F.sequence(F.lit(0), F.lit(255)), lambda i: F.xxhash64("id", i).cast("double")).alias("embedding"), ((F.col("id") * 7919) % 3000).cast("double").alias("scalar"))
    got = mutate.number(wide, 5, "scalar").collect()
    assert sorted((r["vec_id"], r["scalar"], len(r["embedding"])) for r in got) == [(5 + i, float(i), 256) for i in range(3000)]


def test_assignment_by_kernel_equals_plain(spark, rows):
    base = spark.createDataFrame(rows, SCHEMA)
    many = spark.createDataFrame([(i, r[1]) for i, r in enumerate(rows[:80])], "fine_id int, centroid array<double>")
    shown = lambda df: sorted((r["vec_id"], r["fine_id"]) for r in df.collect())
    assert shown(assign.assign_rows(base, many)) == shown(assign.assign(base, many))


def test_small_functions(spark):
    df = spark.createDataFrame([([0.0, 0.0], [3.0, 4.0])], "a array<double>, b array<double>")
    r = df.select(V.l2("a", "b"), V.norm_sq("b"), F.size(V.normalize("a")), V.bin_of(F.lit(10.0), F.lit(0.0), F.lit(10.0)), V.bin_of(F.lit(-1.0), F.lit(0.0), F.lit(10.0)), V.bin_of(F.lit(1.0), F.lit(1.0), F.lit(1.0))).first()
    assert tuple(r) == (5.0, 25.0, 2, 31, 0, 0)


def test_local_graph_is_part_of_full(spark, rows):
    fine = spark.createDataFrame([(i, i % 3, r[1]) for i, r in enumerate(rows[:12])], "fine_id int, coarse_id int, centroid array<double>")
    coarse = spark.createDataFrame([(i, rows[i][1]) for i in range(3)], "coarse_id int, centroid array<double>")
    seeds = graph.coarse_seeds(fine, coarse, 2, 4)
    local = graph.local_neighbours(fine, seeds, graph.neighbours(coarse, 2, "coarse_id"), 4)
    assert local.where("rnk = 1").count() == 12 and local.where("src = dst").count() == 0


def test_groundtruth_choice(spark):
    gt = spark.createDataFrame([(s, k, 0, 1, v) for s, k, v in ((100, "vector", 50), (200, "vector", 150), (200, "hybrid", 160))], "size long, kind string, qid long, rnk int, vec_id long")
    assert store.nearest_size(gt, 150) == 100
    assert store.groundtruth(gt, 120).first()["vec_id"] == 50
    assert store.choose_truth(gt, 155).first()["vec_id"] == -1
    default = spark.createDataFrame([(0,)], "qid long")
    assert store.choose_queries(default, None, 5) is default
    assert mutate.remove(gt.select("vec_id").limit(0), gt.select("vec_id"), gt.limit(0)).count() == 0


def test_controller():
    c = tuning.Controller()
    assert c.next(10**6, 3000, 9000) == (10, 5000)
    wide = tuning.Controller.preset("recall", max_probe=100, max_budget=50_000)  # by themselves presets keep the bounds of ten probes and 5,000 rows
    assert wide.probe(10**6, 500, 600) > 10
    wide.observe(0.1, 50.0)
    assert wide.budget(20, 500, 0.1) > wide.budget(20, 500, 0.95)
    assert wide.summary()["recalls"]["count"] == 1
    wide.reset()
    wide.set_weights(2.0)
    assert wide.summary()["recalls"]["count"] == 0 and wide.speed_weight == 1.0
    assert tuning.two_level_probe(10, 0, 0, 10) == 10 and tuning.two_level_probe(10, 200_000, 900, 100) >= 11
    assert tuning.single_level_probe(10, 0, 0, 100) == 10 and tuning.single_level_probe(1, 10, 1, 100) == 5 and tuning.single_level_probe(90, 10, 1, 100) == 30
    assert tuning.single_level_probe(10, 200_000, 2500, 100) == 23 and tuning.single_level_probe(10, 200_000, 6500, 100, mid=True) == 20
    assert tuning.scan_budget(10, 100) == 25 and tuning.scan_budget(5000, 10**7, True) == 3000


def test_presets_follow_the_rules():
    said = {n: (tuning.Controller.preset(n).target_recall, tuning.Controller.preset(n).speed_weight) for n in tuning.PRESETS}
    assert said == {"balanced": (0.5, 0.5), "recall": (0.7, 0.3), "speed": (0.4, 0.7)}
    c = tuning.Controller(max_probe=1000, max_budget=10**6)
    assert c.probe(10**6, 3333, 9999) == int(int(int(10 * (1 + math.log(100) / math.log(20))) * (1 + 2333 / 2000)) * (1 + 0.1 * (9999 / 3333 - 2)))
    assert c.feedback(None) == (1.0, 1.0) and c.feedback(0.55) == (1.0, 1.0) and c.feedback(0.1)[0] == pytest.approx(1.4)


def test_half_norm_kernel_equals_all_pairs(spark, rows, monkeypatch):
    monkeypatch.setattr(search, "BLOCK_SCORES", 300)  # some queries at a time
    copies = [(1000 + i, rows[i % 3][1], 0.0) for i in range(60)]  # more equal rows than k
    near = [(2000 + i, [rows[5][1][0] + 1e-13 * i, *rows[5][1][1:]], 0.0) for i in range(40)]  # equal to nine places only
    base = spark.createDataFrame([*rows, *copies, *near], SCHEMA).repartition(7)
    queries = base.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec"))
    pairs = base.crossJoin(queries).select("qid", "vec_id", V.half_norm_score("qvec", "embedding").alias("score")).withColumn("o", -F.round("score", 9))
    shown = lambda df: sorted((r["qid"], r["rnk"], r["vec_id"], round(r["score"], 9)) for r in df.collect())
    assert shown(search.half_norm_top(base, queries, 10)) == shown(search.top_k(pairs, 10, order="o"))


def test_kernel_keeps_all_ties(spark):
    base = spark.createDataFrame([(i, [1.0, 2.0, 0.1], 0.0) for i in range(500)], SCHEMA).repartition(3)
    q = spark.createDataFrame([(0, [1.0, 2.0, 0.3])], "qid long, qvec array<double>")
    for kernel in (True, False):
        assert ids(search.knn(base, q, 2, kernel=kernel)) == {0: [0, 1]}
    c = np.array([[1.0, 2.0, 0.1]] * 70)
    at, dist = assign.nearest_of(np.array([[1.0, 2.0, 0.3], [9.0, 9.0, 9.0]]), c)
    assert at.tolist() == [0, 0] and dist[0] == pytest.approx(0.04, abs=1e-12)


def test_ids_go_on_after_zero(spark):
    base = spark.createDataFrame([([0.0, 1.0], 1.0), ([1.0, 0.0], 2.0)], "embedding array<double>, scalar double")
    index = RangeIndex(spark, n_fine=2, n_coarse=1, n_probe=2).train_with(np.eye(2))
    index.add(base.limit(1)).add(base).add(base)
    assert sorted(r.vec_id for r in index.rows.collect()) == [0, 1, 2, 3, 4]


def test_replacing_corrects_synopsis_and_codes(spark, rows):
    base = spark.createDataFrame(rows, SCHEMA)
    index = RangeIndex(spark, n_fine=6, n_coarse=2, n_probe=6).train(base, rounds=2).add(base)
    index.train_pq(base, 2, 16)
    new = base.where("vec_id < 20").withColumn("scalar", F.col("scalar") + 0.5)
    index.add(new, replace=True).add(new, replace=True)
    want = stats.synopsis(index.rows, *index.domain).orderBy("fine_id").collect()
    assert [(r.fine_id, r.cnt, r.min_s, r.max_s, list(r.hist)) for r in index.synopsis.orderBy("fine_id").collect()] == [(r.fine_id, r.cnt, r.min_s, r.max_s, list(r.hist)) for r in want]
    assert sum(r.cnt for r in want) == len(rows)
    q = spark.createDataFrame([(0, rows[7][1])], "qid long, qvec array<double>")
    got = [r.vec_id for r in index.search_pq(q, 4).orderBy("rnk").collect()]
    assert got == brute(rows, rows[7][1], 4) and index.codes.count() == len(rows)


def test_an_insertion_writes_only_its_own_files(spark, rows):
    import os

    base = spark.createDataFrame(rows, SCHEMA)
    index = RangeIndex(spark, n_fine=4, n_coarse=2, n_probe=4).train(base, rounds=2).add(base.where("vec_id < 100"))
    folder = index._folder.removeprefix("file://").removeprefix("file:")
    before = {f: os.stat(f"{folder}/{f}").st_mtime_ns for f in os.listdir(folder) if f.endswith(".parquet")}
    index.add(base.where("vec_id >= 100"))
    after = {f: os.stat(f"{folder}/{f}").st_mtime_ns for f in os.listdir(folder) if f.endswith(".parquet")}
    assert index._folder.endswith(folder.rsplit("/", 1)[1]) and before.items() <= after.items() and len(after) > len(before)
    assert index.rows.where("vec_id >= 100").count() == len(rows) - 100 and sum(r["n"] for r in index.sizes().collect()) == len(rows)


def test_named_graphs(spark, rows, tmp_path):
    base = spark.createDataFrame(rows, SCHEMA)
    index = RangeIndex(spark, n_fine=12, n_coarse=4, n_probe=6, graph_routing=True).train(base, rounds=3).add(base)
    assert index.graph_drift("a") == math.inf
    w = index.walker("a")
    assert index.graph_drift("a") == 0 and index.graph_names() == ["a"]
    index.save_graph(str(tmp_path / "g"), "a")
    index.clear_graphs()
    assert index.graph_names() == []
    index.load_graph(str(tmp_path / "g"), "b")
    again = index.walker("b")
    assert again.edges == w.edges and again.seeds == w.seeds and again.coarse == w.coarse and np.allclose(again.points, w.points)


def test_walk_equals_plain_walk(spark, rows):
    """Beam repair never leaves a list out that is nearer than one it keeps, as far as it walked; with budget for all lists it is exact."""
    base = spark.createDataFrame(rows, SCHEMA)
    index = RangeIndex(spark, n_fine=16, n_coarse=4).train(base, rounds=3).add(base)
    w = index.walker()
    q = np.asarray(rows[11][1])
    exact = sorted((float(((p - q) ** 2).sum()), i) for i, p in zip(w.ids, w.points))[:6]
    far = sorted(w.ids, key=lambda i: -float(((w.points[w.at[i]] - q) ** 2).sum()))[:6]
    got = w.repair(q, far, set(), 6, 16, 16, 16, 64)
    assert [i for _, i in got] == [i for _, i in exact] and [d for d, _ in got] == pytest.approx([d for d, _ in exact])


def test_search_options_agree(spark, rows, asked):
    """Budgets, early stop, targeting, fan-out and the one-level search find the same rows where they leave room for all."""
    base = spark.createDataFrame(rows, SCHEMA)
    plain = RangeIndex(spark, n_fine=12, n_coarse=4, n_probe=12, n_probe_coarse=4).train(base, rounds=4).add(base)
    want = ids(plain.search(asked, 5))
    assert ids(plain.search(asked, 5, budget=1000)) == want
    assert ids(plain.search(asked, 5, stop=1000, least_share=0.5)) == want
    assert ids(plain.search_single_level(asked, 5, threshold=1000)) == want
    plain.params.targeted = plain.params.fan_out = plain.params.filter_aware = True
    assert ids(plain.search(asked, 5, budget=1000)) == want
    assert plain.metrics().count() == 1 and plain.ids_of(0).count() == plain.sizes().where("fine_id = 0").first()["n"]


def test_refresh_backs_off_and_rebuild_is_due(spark, rows):
    base = spark.createDataFrame(rows, SCHEMA)
    index = RangeIndex(spark, n_fine=12, n_coarse=4).train(base, rounds=1).add(base)
    assert not index.refresh_if_due() and not index.rebuild_if_due()
    index.since = {k: 10**9 for k in index.since}
    index.imbalances = [1e-3]
    assert index.rebuild_if_due() and index.counts["rebuilds"] == 1 and index.since["rebuilds"] == 0
    g = index.imbalance().first()["g"]
    due = index.refresh_if_due(least_gain=9.0)
    assert due == (g > 0.5) and index.backoff == (2 if due else 1)


def test_scratch_needs_a_shared_folder():
    from types import SimpleNamespace

    from rangevec.sources import scratch

    stub = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(RuntimeError):
        scratch.shared_dir(stub)


def test_a_set_is_loaded_as_one(spark, rows, tmp_path):
    base = spark.createDataFrame(rows, SCHEMA)
    base.write.parquet(str(tmp_path / "base"))
    spark.createDataFrame([(0, rows[0][1], 1.0, 9.0)], "qid long, qvec array<double>, range_min double, range_max double").write.parquet(str(tmp_path / "queries"))
    spark.createDataFrame([(100, "hybrid", 0, 1, 90), (240, "hybrid", 0, 1, 200)], "size long, kind string, qid long, rnk int, vec_id long").write.parquet(str(tmp_path / "truth"))
    found = store.load_set(spark, str(tmp_path))
    assert found.base.count() == found.train.count() == len(rows) and found.queries.count() == 1 and found.truth.first()["vec_id"] == 200
    assert store.load_set(spark, str(tmp_path), 80).truth.first()["vec_id"] == -1
