"""Registered queries over the index operators, each with the SQL it must agree with.

The base relation joins ``embeddings`` with ``events``: an event's value is the
row's scalar. Every row whose id is divisible by 20 is a query, with a range of 20 about its own
scalar. Rows 0 to 31 serve as fine centroids and 0 to 7 as coarse ones, so that
whole searches can be written in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rangevec.functions import vectors as V
from rangevec.operators import assign as A
from rangevec.operators import graph, kmeans, mutate, pq, route, scan, search, stats
from rangevec.plans import tuning
from rangevec.sources import store

K = 10
SHARED = (10.0, 60.0)
QUERIES: dict = {}
ORACLES: dict = {}

# --- relations -------------------------------------------------------------


def base(spark: SparkSession, d: str) -> DataFrame:
    e, v = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("embeddings", "events"))
    return e.join(v.select(F.col("event_id").alias("vec_id"), F.col("value").alias("scalar"), "ts"), "vec_id").select(
        "vec_id", V.vector("embedding").alias("embedding"), "label", "scalar", "ts"
    )


def asked(b: DataFrame, shared: tuple | None = None, ranged: bool = True, width: float = 20) -> DataFrame:
    low, high = (F.lit(shared[0]), F.lit(shared[1])) if shared else (F.col("scalar") - width, F.col("scalar") + width)
    none = F.lit(None).cast("double")
    return b.where("vec_id % 20 = 0").select(
        F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec"), (low if ranged else none).alias("range_min"), (high if ranged else none).alias("range_max")
    )


def centroids(b: DataFrame, n: int, ident: str) -> DataFrame:
    return b.where(F.col("vec_id") < n).select(F.col("vec_id").cast("int").alias(ident), F.col("embedding").alias("centroid"))


def listed(b: DataFrame) -> DataFrame:
    """The base with each row's list and distance to it."""
    return A.assign(b, centroids(b, 32, "fine_id"), keep=("embedding", "label", "scalar", "ts"))


def parents(b: DataFrame) -> DataFrame:
    """fine_id, coarse_id, centroid, dist_sq."""
    fine = centroids(b, 32, "fine_id")
    near = A.assign(fine, centroids(b, 8, "coarse_id"), "coarse_id", key="fine_id", vec="centroid")
    return fine.join(near, "fine_id")


def _with_queries(b: DataFrame, q: DataFrame) -> DataFrame:
    """Every row with every query, in blocks of queries that are small enough to broadcast."""
    parts = [b.crossJoin(F.broadcast(part)) for part in search.blocks(q)]
    return search._union(parts)


def plain(df: DataFrame) -> DataFrame:
    """Doubles to six places, integers as longs: what both engines can show alike."""
    shown = {"double": lambda c: F.round(c, 6) + 0.0, "float": lambda c: F.round(c.cast("double"), 6) + 0.0, "int": lambda c: c.cast("long"), "decimal": lambda c: c.cast("long")}
    return df.select(*[shown.get(t.split("(")[0], lambda c: c)(F.col(c)).alias(c) for c, t in df.dtypes])


WITH = """WITH base AS (SELECT e.vec_id, e.embedding::DOUBLE[] AS emb, e.label, v.value AS scalar FROM embeddings e JOIN events v ON e.vec_id = v.event_id),
q AS (SELECT vec_id AS qid, emb AS qv, scalar - 20 AS lo, scalar + 20 AS hi FROM base WHERE vec_id % 20 = 0),
fine AS (SELECT vec_id AS fine_id, emb AS c FROM base WHERE vec_id < 32),
coarse AS (SELECT vec_id AS coarse_id, emb AS c FROM base WHERE vec_id < 8),
pairs AS (SELECT q.qid, q.lo, q.hi, b.vec_id, b.scalar, list_distance(q.qv, b.emb) AS dist FROM q, base b),
asg AS (SELECT vec_id, emb, scalar, fine_id, d2 FROM (SELECT b.vec_id, b.emb, b.scalar, f.fine_id, pow(list_distance(b.emb, f.c), 2) AS d2,
  row_number() OVER (PARTITION BY b.vec_id ORDER BY list_distance(b.emb, f.c), f.fine_id) AS rn FROM base b, fine f) WHERE rn = 1),
par AS (SELECT fine_id, coarse_id, c, d2 FROM (SELECT f.fine_id, f.c, k.coarse_id, pow(list_distance(f.c, k.c), 2) AS d2,
  row_number() OVER (PARTITION BY f.fine_id ORDER BY list_distance(f.c, k.c), k.coarse_id) AS rn FROM fine f, coarse k) WHERE rn = 1),
sizes AS (SELECT f.fine_id, count(a.vec_id) AS n FROM fine f LEFT JOIN asg a USING (fine_id) GROUP BY f.fine_id),
dom AS (SELECT min(scalar) AS dlo, max(scalar) AS dhi FROM base),
binned AS (SELECT fine_id, scalar, least(31, greatest(0, floor((scalar - dlo) * 32 / (dhi - dlo))))::BIGINT AS bin FROM asg, dom),
syn AS (SELECT fine_id, count(*) AS cnt, min(scalar) AS min_s, max(scalar) AS max_s, avg(scalar) AS mean_s, var_pop(scalar) AS var_s FROM asg GROUP BY fine_id)
"""

TOP = "SELECT qid, rnk, vec_id, round(dist, 6) AS dist FROM (SELECT qid, vec_id, dist, row_number() OVER (PARTITION BY qid ORDER BY dist, vec_id) AS rnk FROM {src}) WHERE rnk <= {k}"


def query(sql: str | None, width: int = 20):
    """Register a query with its SQL; the queries' own ranges are of ``width`` to both sides."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, d: plain(f(spark, d))
        if sql:
            ORACLES[f.__name__] = WITH.replace("scalar - 20 AS lo, scalar + 20 AS hi", f"scalar - {width} AS lo, scalar + {width} AS hi") + sql
        return f

    return add


# --- exact search ----------------------------------------------------------


@query(TOP.format(src="pairs", k=K))
def exact_knn(spark, d):
    b = base(spark, d)
    return search.knn(b, asked(b, ranged=False), K)


@query(TOP.format(src="(SELECT * FROM pairs WHERE scalar BETWEEN lo AND hi)", k=K))
def exact_knn_jvm(spark, d):
    b = base(spark, d)
    return search.knn(b, asked(b), K, kernel=False)


@query(""", b2 AS (SELECT vec_id + i * 1000000 AS vec_id, emb, scalar FROM base, range(4) t(i)), p2 AS (SELECT q.qid, b2.vec_id, list_distance(q.qv, b2.emb) AS dist FROM q, b2) """ + TOP.format(src="p2", k=6))
def exact_knn_ties(spark, d):
    b = base(spark, d)
    four = b.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(3)))).withColumn("vec_id", F.col("vec_id") + F.col("i") * 1_000_000).drop("i")
    return search.knn(four, asked(b, ranged=False), 6)


@query(TOP.format(src="(SELECT * FROM pairs WHERE scalar BETWEEN 10 AND 60)", k=K))
def exact_knn_range_shared(spark, d):
    b = base(spark, d)
    return search.knn(b, asked(b, SHARED), K)


@query(TOP.format(src="(SELECT * FROM pairs WHERE scalar BETWEEN lo AND hi)", k=K))
def exact_knn_range_per_query(spark, d):
    b = base(spark, d)
    return search.knn(b, asked(b), K)


@query(TOP.format(src="(SELECT * FROM pairs WHERE scalar BETWEEN lo AND hi)", k=K))
def exact_knn_kernel(spark, d):
    b = base(spark, d)
    return search.knn(b, asked(b), K, kernel=True)


@query(", near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, vec_id) AS r FROM pairs) WHERE r <= 40) " + TOP.format(src="(SELECT * FROM near WHERE scalar BETWEEN lo AND hi)", k=K))
def post_filter_search(spark, d):
    b = base(spark, d)
    return search.post_filter(b, asked(b), K, 40)


@query(""", o AS (SELECT p.*, row_number() OVER (PARTITION BY qid ORDER BY dist, vec_id) AS pos, count(*) OVER (PARTITION BY qid) AS n, (hi - lo) / 10000 AS share FROM pairs p),
o2 AS (SELECT *, CASE WHEN share < 0.01 THEN 80 WHEN share < 0.05 THEN 60 WHEN share < 0.1 THEN 50 ELSE 30 END AS wide, 10 * greatest(8, floor(1 / greatest(share, 0.001))) AS wider FROM o),
o3 AS (SELECT *, pos <= CASE WHEN n > wide THEN wide WHEN n > 30 THEN 30 ELSE n END AS early FROM o2 WHERE scalar BETWEEN lo AND hi),
o4 AS (SELECT *, sum(early::INT) OVER (PARTITION BY qid) AS hits FROM o3) """ + TOP.format(src="(SELECT * FROM o4 WHERE early OR (hits < 10 AND pos <= wider))", k=K))
def over_fetch_search(spark, d):
    b = base(spark, d)
    q = asked(b)
    return search.over_fetch(search.candidates(b, q, filtered=False), q, K)


@query(TOP.format(src="(SELECT * FROM pairs WHERE scalar BETWEEN lo AND hi AND dist <= 1.3)", k=1000))
def radius_search(spark, d):
    b = base(spark, d)
    return search.range_search(b, asked(b), 1.3)


@query(""", a AS (SELECT qid, vec_id, dist * 0.3 AS s FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, vec_id) AS r FROM pairs WHERE scalar BETWEEN lo AND hi) WHERE r <= 20),
b2 AS (SELECT qid, vec_id, dist * 0.7 AS s FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, vec_id) AS r FROM pairs) WHERE r <= 20),
m AS (SELECT qid, vec_id, min(s) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b2) GROUP BY qid, vec_id)
SELECT qid, rnk, vec_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score, vec_id) AS rnk FROM m) WHERE rnk <= 10""")
def hybrid_weighted(spark, d):
    b = base(spark, d)
    return search.hybrid_search(b, asked(b), K, 0.3)


@query("SELECT vec_id, fine_id, round(list_distance(emb, c), 6) AS dist FROM base, fine")
def pairwise_distance(spark, d):
    b = base(spark, d)
    return b.crossJoin(F.broadcast(centroids(b, 32, "fine_id"))).select("vec_id", "fine_id", V.l2("embedding", "centroid").alias("dist"))


@query("""SELECT qid, rnk, vec_id, round(ip, 6) AS ip FROM (SELECT qid, vec_id, ip, row_number() OVER (PARTITION BY qid ORDER BY -round(ip, 9), vec_id) AS rnk
FROM (SELECT q.qid, b.vec_id, list_inner_product(q.qv, b.emb) AS ip FROM q, base b)) WHERE rnk <= 10""")
def inner_product_topk(spark, d):
    b = base(spark, d)
    x = _with_queries(b, asked(b)).select("qid", "vec_id", V.inner_product("qvec", "embedding").alias("ip"))
    return search.top_k(x.withColumn("o", -F.round("ip", 9)), K, order="o").select("qid", "rnk", "vec_id", "ip")


@query("""SELECT qid, rnk, vec_id, round(score, 6) AS score FROM (SELECT qid, vec_id, score, row_number() OVER (PARTITION BY qid ORDER BY -round(score, 9), vec_id) AS rnk
FROM (SELECT q.qid, b.vec_id, list_inner_product(q.qv, b.emb) - list_inner_product(b.emb, b.emb) / 2 AS score FROM q, base b)) WHERE rnk <= 10""")
def half_norm_rank(spark, d):
    b = base(spark, d)
    return search.half_norm_top(b, asked(b), K)


@query("""SELECT vec_id, unnest(range(64)) AS dim, round(unnest(list_transform(emb, lambda x: x / (sqrt(list_inner_product(emb, emb)) + 1e-12))), 6) AS x FROM base""")
def normalize_vectors(spark, d):
    b = base(spark, d)
    return b.select("vec_id", F.posexplode(V.normalize("embedding")).alias("dim", "x"))


@query("""SELECT q.qid, f.fine_id, round(list_inner_product(list_transform(list_zip(f.c, k.c), lambda p: p[1] - p[2]), list_transform(list_zip(q.qv, k.c), lambda p: p[1] - p[2])), 6) AS dot
FROM q, fine f, coarse k WHERE k.coarse_id = 0 AND f.fine_id > 0""")
def alignment(spark, d):
    b = base(spark, d)
    here = centroids(b, 8, "coarse_id").where("coarse_id = 0").select(F.col("centroid").alias("here"))
    x = asked(b).crossJoin(F.broadcast(centroids(b, 32, "fine_id").where("fine_id > 0"))).crossJoin(F.broadcast(here))
    return x.select("qid", "fine_id", V.alignment("here", "centroid", "qvec").alias("dot"))


# --- assignment and training ----------------------------------------------


@query("SELECT vec_id, fine_id, round(d2, 6) AS dist_sq FROM asg")
def assign_fine(spark, d):
    b = base(spark, d)
    return A.assign(b, centroids(b, 32, "fine_id"))


@query("SELECT vec_id, fine_id, round(d2, 6) AS dist_sq FROM asg")
def assign_fine_arrow(spark, d):
    import numpy as np

    b = base(spark, d)
    c = centroids(b, 32, "fine_id").orderBy("fine_id").collect()
    return A.assign_arrow(b, np.array([r["centroid"] for r in c]), np.array([r["fine_id"] for r in c]))


_SCALE = ", sc AS (SELECT CASE WHEN stddev_pop(scalar) < 1e-6 THEN 1 ELSE stddev_pop(scalar) END AS s FROM base)"


def _scale(b: DataFrame) -> float:
    return b.agg(V.scale_of(F.stddev_pop("scalar")).alias("s")).first()["s"]


@query(_SCALE + """, c2 AS (SELECT f.fine_id, f.c, b.scalar AS centre FROM fine f JOIN base b ON b.vec_id = f.fine_id)
SELECT vec_id, fine_id, round(cost, 6) AS dist_sq FROM (SELECT b.vec_id, f.fine_id, pow(list_distance(b.emb, f.c), 2) + 0.5 * pow((b.scalar - f.centre) / s, 2) AS cost,
row_number() OVER (PARTITION BY b.vec_id ORDER BY pow(list_distance(b.emb, f.c), 2) + 0.5 * pow((b.scalar - f.centre) / s, 2), f.fine_id) AS rn FROM base b, c2 f, sc) WHERE rn = 1""")
def assign_attr_aware(spark, d):
    b = base(spark, d)
    c = centroids(b, 32, "fine_id").join(b.select(F.col("vec_id").cast("int").alias("fine_id"), F.col("scalar").alias("centre")), "fine_id")
    return A.assign_attribute(b, c, 0.5, _scale(b))


@query(_SCALE + """, c2 AS (SELECT f.fine_id, f.c, min(a.scalar) AS lo, max(a.scalar) AS hi FROM fine f JOIN asg a USING (fine_id) GROUP BY ALL),
x AS (SELECT b.vec_id, f.fine_id, pow(list_distance(b.emb, f.c), 2) + 0.2 * pow((greatest(f.hi, b.scalar) - least(f.lo, b.scalar)) / s, 2) AS cost FROM base b, c2 f, sc)
SELECT vec_id, fine_id, round(cost, 6) AS dist_sq FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY cost, fine_id) AS rn FROM x) WHERE rn = 1""")
def assign_span_penalty(spark, d):
    b = base(spark, d)
    spans = listed(b).groupBy("fine_id").agg(F.min("scalar").alias("low"), F.max("scalar").alias("high"))
    return A.assign_span(b, centroids(b, 32, "fine_id").join(spans, "fine_id"), 0.2, _scale(b))


_STEP = """, cen1 AS (SELECT fine_id, list(x ORDER BY i) AS c, max(n) AS n FROM (SELECT fine_id, i, avg(x) AS x, count(*) AS n FROM (SELECT fine_id, unnest(range(64)) AS i, unnest(emb) AS x FROM asg) GROUP BY fine_id, i) GROUP BY fine_id),
new1 AS (SELECT f.fine_id, coalesce(c1.c, f.c) AS c, coalesce(c1.n, 0) AS n FROM fine f LEFT JOIN cen1 c1 USING (fine_id))"""


@query(_STEP + " SELECT fine_id, n, unnest(range(64)) AS dim, round(unnest(c), 6) AS x FROM new1")
def lloyd_step_1(spark, d):
    b = base(spark, d)
    c = kmeans.lloyd_step_sql(b, centroids(b, 32, "fine_id"))
    return c.select("fine_id", "n", F.posexplode("centroid").alias("dim", "x"))


@query(_STEP + """, asg2 AS (SELECT vec_id, emb, fine_id FROM (SELECT b.vec_id, b.emb, f.fine_id, row_number() OVER (PARTITION BY b.vec_id ORDER BY round(list_distance(b.emb, f.c), 12), f.fine_id) AS rn FROM base b, new1 f) WHERE rn = 1),
cen2 AS (SELECT fine_id, i, avg(x) AS x FROM (SELECT fine_id, unnest(range(64)) AS i, unnest(emb) AS x FROM asg2) GROUP BY fine_id, i)
SELECT fine_id, i AS dim, round(x, 6) AS x FROM cen2""")
def lloyd_step_2(spark, d):
    import numpy as np

    b = base(spark, d)
    start = np.array([r["centroid"] for r in centroids(b, 32, "fine_id").orderBy("fine_id").collect()])
    c = kmeans.lloyd_step(b, kmeans.lloyd_step(b, start))
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(c)]
    table = spark.createDataFrame(rows, "fine_id int, c array<double>")
    return table.select("fine_id", F.posexplode("c").alias("dim", "x"))


@query(""", w AS (SELECT p.coarse_id, greatest(1, s.n)::DOUBLE AS w, p.c FROM par p JOIN sizes s USING (fine_id)),
u AS (SELECT coarse_id, w, unnest(range(64)) AS dim, unnest(c) AS x FROM w)
SELECT coarse_id, dim, round(sum(w * x) / sum(w), 6) AS x FROM u GROUP BY coarse_id, dim""")
def weighted_centroids(spark, d):
    b = base(spark, d)
    sizes = stats.list_sizes(listed(b), centroids(b, 32, "fine_id"))
    c = stats.weighted_mean(parents(b).join(sizes, "fine_id"), "coarse_id", "n")
    return c.select("coarse_id", F.posexplode("centroid").alias("dim", "x"))


_SCALAR = _SCALE + """, c2 AS (SELECT f.fine_id, f.c, b.scalar AS centre, b.scalar - 5 AS low, b.scalar + 5 AS high FROM fine f JOIN base b ON b.vec_id = f.fine_id),
x AS (SELECT b.vec_id, b.emb, b.scalar, f.fine_id, pow(list_distance(b.emb, f.c), 2) + 0.3 * pow((b.scalar - f.centre) / s, 2) + 0.2 * pow((greatest(f.high, b.scalar) - least(f.low, b.scalar)) / s, 2) AS cost FROM base b, c2 f, sc),
a2 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY cost, fine_id) AS rn FROM x) WHERE rn = 1),
m2 AS (SELECT fine_id, i, avg(v) AS v FROM (SELECT fine_id, unnest(range(64)) AS i, unnest(emb) AS v FROM a2) GROUP BY ALL), s2 AS (SELECT fine_id, avg(scalar) AS centre, min(scalar) AS low, max(scalar) AS high, count(*) AS n FROM a2 GROUP BY fine_id),
old AS (SELECT fine_id, unnest(range(64)) AS dim, unnest(c) AS v, centre, low, high FROM c2)"""


@query(_SCALAR + """ SELECT o.fine_id, o.dim, round(coalesce(m2.v, o.v), 6) AS x, round(coalesce(s2.centre, o.centre), 6) AS centre, round(coalesce(s2.low, o.low), 6) AS low, round(coalesce(s2.high, o.high), 6) AS high, coalesce(s2.n, 0) AS n
FROM old o LEFT JOIN m2 ON m2.fine_id = o.fine_id AND m2.i = o.dim LEFT JOIN s2 ON s2.fine_id = o.fine_id""")
def kmeans_scalar_step(spark, d):
    b = base(spark, d)
    own = b.select(F.col("vec_id").cast("int").alias("fine_id"), F.col("scalar").alias("centre"), (F.col("scalar") - 5).alias("low"), (F.col("scalar") + 5).alias("high"))
    c = kmeans.scalar_step(b, centroids(b, 32, "fine_id").join(own, "fine_id"), 0.3, 0.2, _scale(b))
    return c.select("fine_id", F.posexplode("centroid").alias("dim", "x"), "centre", "low", "high", "n")


def _rounds(n: int) -> str:
    """SQL of n Lloyd rounds over the first 16 rows as starts: relations k0 to kn."""
    sql = ", k0 AS (SELECT vec_id AS fine_id, emb AS c FROM base WHERE vec_id < 16)"
    for i in range(n):
        sql += f""", a{i} AS (SELECT vec_id, emb, fine_id FROM (SELECT b.vec_id, b.emb, f.fine_id, row_number() OVER (PARTITION BY b.vec_id ORDER BY round(list_distance(b.emb, f.c), 12), f.fine_id) AS rn FROM base b, k{i} f) WHERE rn = 1),
m{i} AS (SELECT fine_id, list(x ORDER BY i) AS c FROM (SELECT fine_id, i, avg(x) AS x FROM (SELECT fine_id, unnest(range(64)) AS i, unnest(emb) AS x FROM a{i}) GROUP BY ALL) GROUP BY fine_id),
k{i + 1} AS (SELECT k.fine_id, coalesce(m.c, k.c) AS c FROM k{i} k LEFT JOIN m{i} m USING (fine_id))"""
    return sql


@query(_rounds(3) + " SELECT fine_id, unnest(range(64)) AS dim, round(unnest(c), 6) AS x FROM k3")
def kmeans_fit(spark, d):
    import numpy as np

    b = base(spark, d)
    start = np.array([r["centroid"] for r in centroids(b, 16, "fine_id").orderBy("fine_id").collect()])
    fine = kmeans.fit(b, start, 3)
    return spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(fine)], "fine_id int, c array<double>").select("fine_id", F.posexplode("c").alias("dim", "x"))


@query(None)
def kmeans_two_level(spark, d):
    b = base(spark, d)
    two = kmeans.fit_two_level(b, 16, 4, rounds=5, plus_plus=True)
    return spark.createDataFrame([(i, int(p), [float(x) for x in c]) for i, (p, c) in enumerate(zip(two.parent, two.fine))], "fine_id int, coarse_id int, centroid array<double>")


# --- centroid tables -------------------------------------------------------


@query("SELECT fine_id, coarse_id, round(d2, 6) AS dist_sq FROM par")
def fine_to_coarse(spark, d):
    return parents(base(spark, d)).select("fine_id", "coarse_id", "dist_sq")


@query("""SELECT coarse_id, fine_id, rnk FROM (SELECT k.coarse_id, f.fine_id, row_number() OVER (PARTITION BY k.coarse_id ORDER BY list_distance(f.c, k.c), f.fine_id) AS rnk FROM fine f, coarse k) WHERE rnk <= 8""")
def coarse_seeds(spark, d):
    b = base(spark, d)
    return graph.coarse_seeds(centroids(b, 32, "fine_id"), centroids(b, 8, "coarse_id")).select("coarse_id", "fine_id", "rnk")


@query("""SELECT src, dst, rnk, round(d2, 6) AS dist_sq FROM (SELECT a.coarse_id AS src, b.coarse_id AS dst, pow(list_distance(a.c, b.c), 2) AS d2, row_number() OVER (PARTITION BY a.coarse_id ORDER BY list_distance(a.c, b.c), b.coarse_id) AS rnk
FROM coarse a JOIN coarse b ON a.coarse_id <> b.coarse_id) WHERE rnk <= 4""")
def coarse_neighbors(spark, d):
    return graph.neighbours(centroids(base(spark, d), 8, "coarse_id"), 4, "coarse_id").select("src", "dst", "rnk", "dist_sq")


_EDGES = """, e AS (SELECT src, dst, rnk, d2 FROM (SELECT a.fine_id AS src, b.fine_id AS dst, pow(list_distance(a.c, b.c), 2) AS d2, row_number() OVER (PARTITION BY a.fine_id ORDER BY list_distance(a.c, b.c), b.fine_id) AS rnk
FROM fine a JOIN fine b ON a.fine_id <> b.fine_id) WHERE rnk <= 8)"""


@query(_EDGES + " SELECT src, dst, rnk, round(d2, 6) AS dist_sq FROM e")
def centroid_knn_graph(spark, d):
    return graph.neighbours(centroids(base(spark, d), 32, "fine_id"), 8).select("src", "dst", "rnk", "dist_sq")


@query(_EDGES + " SELECT src, string_agg(dst, ',' ORDER BY rnk) AS dsts FROM e GROUP BY src")
def graph_adjacency(spark, d):
    a = graph.adjacency(graph.neighbours(centroids(base(spark, d), 32, "fine_id"), 8))
    return a.select("src", F.array_join(F.transform("dsts", lambda x: x.cast("string")), ",").alias("dsts"))


# --- statistics ------------------------------------------------------------


@query("SELECT fine_id, n FROM sizes")
def list_sizes(spark, d):
    b = base(spark, d)
    return stats.list_sizes(listed(b), centroids(b, 32, "fine_id"))


@query("SELECT min(n) AS min_n, max(n) AS max_n, round(avg(n), 6) AS avg_n, count(*) AS lists FROM sizes")
def list_size_stats(spark, d):
    b = base(spark, d)
    return stats.size_stats(stats.list_sizes(listed(b), centroids(b, 32, "fine_id")))


@query("SELECT coarse_id, sum(n)::BIGINT AS n, count(*) AS fines FROM sizes JOIN par USING (fine_id) GROUP BY coarse_id")
def coarse_sizes(spark, d):
    b = base(spark, d)
    return stats.coarse_sizes(stats.list_sizes(listed(b), centroids(b, 32, "fine_id")), parents(b))


@query("SELECT fine_id, count(*) AS n FROM asg WHERE scalar BETWEEN 10 AND 60 GROUP BY fine_id")
def count_in_range(spark, d):
    return stats.count_in_range(listed(base(spark, d)), *SHARED)


@query("SELECT round(avg((scalar BETWEEN 10 AND 60)::INT), 6) AS rate FROM base")
def selection_rate(spark, d):
    return stats.selection_rate(base(spark, d), *SHARED)


@query("SELECT fine_id, bin, count(*) AS n FROM binned GROUP BY fine_id, bin")
def scalar_histogram32(spark, d):
    b = base(spark, d)
    return stats.histogram(listed(b), *stats.domain(b))


@query("""SELECT fine_id, CASE WHEN scalar < 10 THEN 0 WHEN scalar > 60 THEN 33 ELSE least(31, greatest(0, floor((scalar - 10) * 32 / 50)))::BIGINT + 1 END AS slot, count(*) AS n FROM asg GROUP BY ALL""")
def list_histogram34(spark, d):
    return stats.histogram_open(listed(base(spark, d)), *SHARED)


@query("SELECT fine_id, cnt, min_s, max_s, round(mean_s, 6) AS mean_s, round(var_s, 6) AS var_s FROM syn")
def scalar_synopsis(spark, d):
    b = base(spark, d)
    return stats.synopsis(listed(b), *stats.domain(b)).drop("hist")


@query("SELECT fine_id, cnt, min_s, max_s, round(mean_s, 6) AS mean_s, round(var_s, 6) AS var_s FROM syn")
def synopsis_incremental(spark, d):
    b = base(spark, d)
    rows, dom = listed(b), stats.domain(b)
    halves = [stats.synopsis(rows.where(f"vec_id % 2 = {i}"), *dom) for i in (0, 1)]
    return stats.merge_synopses(*halves).drop("hist")


_HITS = """, hits AS (SELECT s.fine_id, q.qid, q.lo, q.hi, s.cnt, s.min_s, s.max_s, s.mean_s, s.var_s,
CASE WHEN q.hi < s.min_s OR q.lo > s.max_s THEN 0 WHEN q.lo <= s.min_s AND q.hi >= s.max_s THEN s.cnt
ELSE least(s.cnt, ceil(round((SELECT sum(h.n * greatest(0, least(least(q.hi, dhi), dlo + (h.bin + 1) * (dhi - dlo) / 32) - greatest(greatest(q.lo, dlo), dlo + h.bin * (dhi - dlo) / 32)) / ((dhi - dlo) / 32))
  FROM (SELECT fine_id, bin, count(*) AS n FROM binned GROUP BY ALL) h WHERE h.fine_id = s.fine_id), 9))) END::BIGINT AS hit FROM syn s, q, dom)"""


def _hits(b: DataFrame):
    dom = stats.domain(b)
    s = stats.synopsis(listed(b), *dom)
    return asked(b).drop("qvec").crossJoin(F.broadcast(s)), dom  # a row for each list


@query(_HITS + " SELECT qid, fine_id, hit, round(least(1, hit / cnt), 6) AS selectivity FROM hits")
def selectivity_estimate(spark, d):
    x, dom = _hits(base(spark, d))
    lo, hi = F.col("range_min"), F.col("range_max")
    return x.select("qid", "fine_id", stats.hit_estimate(lo, hi, *dom).alias("hit"), stats.selectivity(lo, hi, *dom).alias("selectivity"))


_UTIL = _HITS + """, util AS (SELECT qid, fine_id, greatest(0, least(1, cnt / (cnt + 32.0) * (0.45 * ln(1 + hit) / ln(1 + cnt) + 0.25 * sqrt(least(1, hit / cnt))
+ 0.20 / (1 + pow(greatest(0, lo - mean_s, mean_s - hi) / (sqrt(var_s) + greatest(1e-6, 1e-4 * (dhi - dlo))), 2)) / (1 + (sqrt(var_s) + greatest(1e-6, 1e-4 * (dhi - dlo))) / greatest(dhi - dlo, 1e-6))
+ 0.10 * sqrt(least(1, greatest(0, least(hi, max_s) - greatest(lo, min_s)) / greatest(1e-6, max_s - min_s)) * least(1, greatest(0, least(hi, max_s) - greatest(lo, min_s)) / greatest(1e-6, hi - lo)))))) AS u FROM hits, dom)"""


@query(_UTIL + " SELECT qid, fine_id, round(u, 6) AS utility FROM util")
def scalar_utility(spark, d):
    x, dom = _hits(base(spark, d))
    return x.select("qid", "fine_id", stats.utility(F.col("range_min"), F.col("range_max"), *dom).alias("utility"))


@query("""SELECT fine_id, count(*) AS n, round(avg(sqrt(d2)), 6) AS mean_dist, round(max(sqrt(d2)), 6) AS max_dist, round(least(1, 20.0 / count(*)) / (1 + avg(sqrt(d2))), 6) AS quality, round(1 / (1 + avg(d2)), 6) AS compactness FROM asg GROUP BY fine_id""")
def cluster_quality(spark, d):
    return stats.quality(listed(base(spark, d)), 20)


@query("SELECT fine_id, dim, round(min(x), 6) AS low, round(max(x), 6) AS high FROM (SELECT fine_id, unnest(range(64)) AS dim, unnest(emb) AS x FROM asg) GROUP BY ALL")
def cluster_bounds(spark, d):
    return stats.bounds(listed(base(spark, d)))


@query("SELECT fine_id, dim, round(sum(x), 6) AS total, count(*) AS n FROM (SELECT fine_id, unnest(range(64)) AS dim, unnest(emb) AS x FROM asg) GROUP BY ALL")
def cluster_sums(spark, d):
    return stats.sums(listed(base(spark, d)))


_DRIFT = _STEP + ", dr AS (SELECT f.fine_id, list_distance(n1.c, f.c) AS shift, list_distance(n1.c, f.c) / greatest(1e-12, sqrt(list_inner_product(f.c, f.c))) AS rel_shift, sqrt(list_inner_product(f.c, f.c)) AS len FROM fine f JOIN new1 n1 USING (fine_id))"


def _drift(b: DataFrame):
    fine = centroids(b, 32, "fine_id")
    return stats.drift(kmeans.lloyd_step_sql(b, fine), fine)


@query(_DRIFT + " SELECT fine_id, round(shift, 6) AS shift, round(rel_shift, 6) AS rel_shift FROM dr")
def centroid_drift(spark, d):
    return _drift(base(spark, d))


@query(_DRIFT + """, s AS (SELECT avg(n) AS mean_n, stddev_pop(n) AS sd_n FROM sizes), t AS (SELECT avg(shift) AS drift, stddev_pop(shift) AS drift_sd, avg(len) AS len FROM dr)
SELECT round(mean_n, 6) AS mean_n, round(sd_n, 6) AS sd_n, round(drift, 6) AS drift, round(drift_sd, 6) AS drift_sd, round(least(sd_n / mean_n, 1), 6) AS g_fast,
round(0.4 * least(sd_n / mean_n, 1) + 0.4 * least(drift / len, 1) + 0.2 * least(drift_sd / drift, 1), 6) AS g FROM s, t""")
def imbalance_metrics(spark, d):
    b = base(spark, d)
    fine = centroids(b, 32, "fine_id")
    return stats.imbalance(stats.list_sizes(listed(b), fine), _drift(b), fine)


@query("SELECT round(stddev_pop(n) / avg(n), 6) AS cv, round(least(stddev_pop(n) / avg(n), 1), 6) AS g_coarse FROM (SELECT coarse_id, sum(n) AS n FROM sizes JOIN par USING (fine_id) GROUP BY coarse_id) WHERE n > 0")
def coarse_imbalance(spark, d):
    b = base(spark, d)
    return stats.coarse_imbalance(stats.coarse_sizes(stats.list_sizes(listed(b), centroids(b, 32, "fine_id")), parents(b)))


@query("SELECT round(sqrt(sum(greatest(1, n) * d2) / sum(greatest(1, n))), 6) AS radius FROM par JOIN sizes USING (fine_id)")
def coarse_radius(spark, d):
    b = base(spark, d)
    return stats.coarse_radius(parents(b).join(stats.list_sizes(listed(b), centroids(b, 32, "fine_id")), "fine_id"), centroids(b, 8, "coarse_id"))


@query("""SELECT fine_id AS step, round(n::DOUBLE, 6) AS g, round(CASE WHEN count(n) OVER w < 5 THEN 10.0 ELSE greatest(5.0, least(30.0, avg(n) OVER w + 2 * stddev_pop(n) OVER w)) END, 6) AS threshold FROM sizes WINDOW w AS (ORDER BY fine_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)""")
def adaptive_threshold(spark, d):
    b = base(spark, d)
    s = stats.list_sizes(listed(b), centroids(b, 32, "fine_id")).select(F.col("fine_id").alias("step"), F.col("n").cast("double").alias("g"))
    return stats.adaptive_threshold(s, 2.0, 10.0, 5.0, 30.0)


@query("""SELECT fine_id, qid, round(CASE WHEN sum(n) = 0 THEN 1 WHEN lo > hi THEN 0 ELSE (sum(CASE WHEN slot = 0 THEN (lo < 10)::INT * n WHEN slot = 33 THEN (hi > 60)::INT * n
WHEN hi < 10 OR lo > 60 THEN 0 ELSE n * greatest(0, least(least(32, (hi - 10) * 0.64), slot) - greatest(greatest(0, (lo - 10) * 0.64), slot - 1)) END)) / sum(n) END, 6) AS selectivity
FROM (SELECT fine_id, CASE WHEN scalar < 10 THEN 0 WHEN scalar > 60 THEN 33 ELSE least(31, greatest(0, floor((scalar - 10) * 32 / 50)))::BIGINT + 1 END AS slot, count(*) AS n FROM asg GROUP BY ALL), q GROUP BY fine_id, qid, lo, hi""".replace("sum(n) END", "sum(n) END"))
def list_selectivity34(spark, d):
    b = base(spark, d)
    slots = stats.histogram_open(listed(b), *SHARED).groupBy("fine_id").agg(F.array(*[F.coalesce(F.sum(F.when(F.col("slot") == i, F.col("n"))), F.lit(0)) for i in range(34)]).alias("hist"))
    x = asked(b).crossJoin(F.broadcast(slots))
    return x.select("fine_id", "qid", stats.selectivity_open("hist", F.col("range_min"), F.col("range_max"), *SHARED).alias("selectivity"))


@query(_DRIFT + " SELECT round(greatest(0.05, least(0.2, avg(shift) + 0.5 * stddev_pop(shift))), 6) AS threshold FROM dr")
def centroid_update_threshold(spark, d):
    return stats.centroid_update_threshold(_drift(base(spark, d)))


@query("SELECT fine_id, dim, round(sum(x), 6) AS total, count(*) AS n FROM (SELECT fine_id, unnest(range(64)) AS dim, unnest(emb) AS x FROM asg WHERE vec_id % 3 <> 0) GROUP BY ALL")
def sums_subtract(spark, d):
    rows = listed(base(spark, d))
    whole = stats.change_sums(stats.sums(rows.where("vec_id % 2 = 0")), stats.sums(rows.where("vec_id % 2 = 1")))
    return stats.change_sums(whole, stats.sums(rows.where("vec_id % 3 = 0")), -1)


@query(_STEP + " SELECT f.fine_id, unnest(range(64)) AS dim, round(unnest(CASE WHEN f.fine_id % 2 = 0 THEN n1.c ELSE f.c END), 6) AS x FROM fine f JOIN new1 n1 USING (fine_id)")
def refresh_dirty(spark, d):
    b = base(spark, d)
    fine = centroids(b, 32, "fine_id")
    return stats.refresh_from_sums(fine, stats.sums(listed(b)), fine.where("fine_id % 2 = 0")).select("fine_id", F.posexplode("centroid").alias("dim", "x"))


@query(_DRIFT + " SELECT round(avg(shift), 6) AS drift FROM dr")
def graph_drift(spark, d):
    b = base(spark, d)
    fine = centroids(b, 32, "fine_id")
    return spark.createDataFrame([(graph.drift_since(kmeans.lloyd_step_sql(b, fine), fine),)], "drift double")


@query("SELECT x.vec_id, coalesce(v.value, -1.0) AS scalar FROM (SELECT vec_id + 7 AS vec_id FROM embeddings) x LEFT JOIN (SELECT * FROM events WHERE event_id % 2 = 0) v ON v.event_id = x.vec_id")
def scalar_lookup(spark, d):
    e, v = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("embeddings", "events"))
    known = v.where("event_id % 2 = 0").select(F.col("event_id").alias("vec_id"), F.col("value").alias("scalar"))
    return e.select((F.col("vec_id") + 7).alias("vec_id")).join(known, "vec_id", "left").select("vec_id", F.coalesce("scalar", F.lit(-1.0)).alias("scalar"))


# --- routed search ---------------------------------------------------------

_NEAR = ", nl AS (SELECT qid, fine_id, d, rank FROM (SELECT q.qid, f.fine_id, pow(list_distance(q.qv, f.c), 2) AS d, row_number() OVER (PARTITION BY q.qid ORDER BY list_distance(q.qv, f.c), f.fine_id) AS rank FROM q, fine f) WHERE rank <= {n})"
_TWO = """, nc AS (SELECT qid, coarse_id FROM (SELECT q.qid, k.coarse_id, row_number() OVER (PARTITION BY q.qid ORDER BY list_distance(q.qv, k.c), k.coarse_id) AS r FROM q, coarse k) WHERE r <= 4),
tl AS (SELECT qid, fine_id, d, rank FROM (SELECT q.qid, p.fine_id, pow(list_distance(q.qv, p.c), 2) AS d, row_number() OVER (PARTITION BY q.qid ORDER BY list_distance(q.qv, p.c), p.fine_id) AS rank FROM nc JOIN par p USING (coarse_id) JOIN q USING (qid)) WHERE rank <= 12)"""
_FOUND = ", found AS (SELECT l.qid, l.fine_id, l.rank, a.vec_id, a.scalar, list_distance(q.qv, a.emb) AS dist FROM {lists} l JOIN asg a USING (fine_id) JOIN q USING (qid) WHERE a.scalar BETWEEN q.lo AND q.hi)"


@query(_NEAR.format(n=8) + _FOUND.format(lists="nl") + " " + TOP.format(src="found", k=K))
def ivf_search(spark, d):
    b = base(spark, d)
    q = asked(b)
    return scan.search_lists(route.nearest_lists(q, centroids(b, 32, "fine_id"), 8), q, listed(b), K)


def _two(b: DataFrame, q: DataFrame) -> DataFrame:
    return route.two_level(q, parents(b), centroids(b, 8, "coarse_id"), 4, 3)


@query(_TWO + _FOUND.format(lists="tl") + " " + TOP.format(src="found", k=K))
def two_level_search(spark, d):
    b = base(spark, d)
    q = asked(b)
    return scan.search_lists(_two(b, q), q, listed(b), K)


_PRUNE = """, okl AS (SELECT q.qid, p.fine_id, pow(list_distance(q.qv, p.c), 2) AS d, s.cnt IS NOT NULL AND NOT (q.hi < s.min_s OR q.lo > s.max_s) AS ok FROM nc JOIN par p USING (coarse_id) JOIN q USING (qid) LEFT JOIN syn s USING (fine_id)),
sh AS (SELECT *, sum(ok::INT) OVER (PARTITION BY qid) AS n_in, count(*) OVER (PARTITION BY qid) AS n_all FROM okl),
pr AS (SELECT qid, fine_id, d, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(d, 12), fine_id) AS rank FROM sh WHERE ok OR n_in = 0 OR n_all - n_in < 0.05 * n_all) WHERE rank <= 12)"""


@query(_TWO + _PRUNE + _FOUND.format(lists="pr") + " " + TOP.format(src="found", k=K))
def two_level_range_pruned(spark, d):
    b = base(spark, d)
    q, rows = asked(b), listed(b)
    lists = route.pruned_first(q, parents(b), centroids(b, 8, "coarse_id"), stats.synopsis(rows, *stats.domain(b)), 4, 12)
    return scan.search_lists(lists, q, rows, K)


@query(_TWO + """, okl AS (SELECT tl.*, s.cnt IS NOT NULL AND NOT (q.hi < s.min_s OR q.lo > s.max_s) AS ok FROM tl JOIN q USING (qid) LEFT JOIN syn s USING (fine_id)),
pr AS (SELECT qid, fine_id, d, rank FROM (SELECT *, max(ok::INT) OVER (PARTITION BY qid) AS any_ok FROM okl) WHERE ok OR any_ok = 0) SELECT qid, fine_id, rank FROM pr""")
def pruned_lists(spark, d):
    b = base(spark, d)
    q = asked(b)
    return route.prune(_two(b, q), q, stats.synopsis(listed(b), *stats.domain(b))).select("qid", "fine_id", "rank")


_SMALL = _NEAR.format(n=8) + ", sm AS (SELECT nl.qid, nl.fine_id, nl.d, row_number() OVER (PARTITION BY nl.qid ORDER BY s.n, nl.rank) AS rank FROM nl JOIN sizes s USING (fine_id))"


@query(_SMALL + " SELECT qid, fine_id, rank FROM sm")
def smallest_first_lists(spark, d):
    b = base(spark, d)
    fine = centroids(b, 32, "fine_id")
    return route.smallest_first(route.nearest_lists(asked(b), fine, 8), stats.list_sizes(listed(b), fine)).select("qid", "fine_id", "rank")


_STOPPED = """, sz AS (SELECT qid, fine_id, rank, count(*) AS size FROM found GROUP BY ALL),
go AS (SELECT qid, fine_id FROM (SELECT *, coalesce(sum(size) OVER (PARTITION BY qid ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS given, max(rank) OVER (PARTITION BY qid) AS lists FROM sz) WHERE given < {n} OR rank - 1 < {share} * lists),
kept AS (SELECT f.* FROM found f JOIN go USING (qid, fine_id))"""


@query(_SMALL + _FOUND.format(lists="sm") + _STOPPED.format(n=30, share=0) + " " + TOP.format(src="kept", k=K))
def single_level_search(spark, d):
    b = base(spark, d)
    rows, fine = listed(b), centroids(b, 32, "fine_id")
    return scan.single_level(asked(b), fine, rows, stats.list_sizes(rows, fine), K, 8, 30)


@query(_NEAR.format(n=8) + _FOUND.format(lists="nl") + _STOPPED.format(n=5, share=0.5) + " SELECT qid, fine_id, vec_id, round(dist, 6) AS dist FROM kept")
def mid_filter_scan(spark, d):
    b = base(spark, d)
    q = asked(b)
    found = scan.list_rows(route.nearest_lists(q, centroids(b, 32, "fine_id"), 8), q, listed(b))
    return scan.stop_after(found, 5, 0.5).select("qid", "fine_id", "vec_id", "dist")


@query(_NEAR.format(n=8) + _FOUND.format(lists="nl") + " SELECT qid, vec_id, round(dist, 6) AS dist FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, vec_id) AS r FROM found) WHERE r <= 20")
def trimmed_scan(spark, d):
    b = base(spark, d)
    q = asked(b)
    found = scan.list_rows(route.nearest_lists(q, centroids(b, 32, "fine_id"), 8), q, listed(b))
    return scan.trim(found, 20).select("qid", "vec_id", "dist")


@query(_TWO + _NEAR.format(n=5) + """, ids AS (SELECT nc.qid, p.fine_id FROM nc JOIN par p USING (coarse_id) UNION SELECT qid, fine_id FROM nl),
un AS (SELECT i.qid, i.fine_id, 1 AS rank FROM ids i)""" + _FOUND.format(lists="un") + " " + TOP.format(src="found", k=K))
def candidate_union_search(spark, d):
    b = base(spark, d)
    q = asked(b)
    return scan.search_lists(route.union_route(q, parents(b), centroids(b, 8, "coarse_id"), 4, 5), q, listed(b), K)


_BUDGET = ", bud AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rank, scalar, vec_id) AS nth FROM found) WHERE nth <= 40)"


@query(_NEAR.format(n=8) + _FOUND.format(lists="nl") + _BUDGET + " " + TOP.format(src="bud", k=K))
def budgeted_scan(spark, d):
    b = base(spark, d)
    q = asked(b)
    found = scan.list_rows(route.nearest_lists(q, centroids(b, 32, "fine_id"), 8), q, listed(b))
    return search.top_k(scan.budgeted(found, 40), K).select("qid", "rnk", "vec_id", "dist")


@query(_NEAR.format(n=8) + _FOUND.format(lists="nl") + """, sz AS (SELECT qid, fine_id, rank, count(*) AS size FROM found GROUP BY ALL),
acc AS (SELECT *, sum(size) OVER w AS s, sum(5) OVER w AS b FROM sz WINDOW w AS (PARTITION BY qid ORDER BY rank)),
dn AS (SELECT *, s + least(0, min(b - s) OVER (PARTITION BY qid ORDER BY rank)) AS done FROM acc),
tk AS (SELECT qid, fine_id, done - coalesce(lag(done) OVER (PARTITION BY qid ORDER BY rank), 0) AS take FROM dn),
kept AS (SELECT f.* FROM (SELECT *, row_number() OVER (PARTITION BY qid, fine_id ORDER BY scalar, vec_id) AS nth FROM found) f JOIN tk USING (qid, fine_id) WHERE nth <= take)
SELECT qid, fine_id, vec_id, round(dist, 6) AS dist FROM kept""")
def prefix_budget_scan(spark, d):
    b = base(spark, d)
    q = asked(b)
    lists = route.nearest_lists(q, centroids(b, 32, "fine_id"), 8)
    found = scan.list_rows(lists, q, listed(b))
    return scan.prefix_budgeted(found, lists.select("qid", "fine_id", F.lit(5).alias("budget"))).select("qid", "fine_id", "vec_id", "dist")


@query(_NEAR.format(n=8) + _FOUND.format(lists="nl") + """, sz AS (SELECT qid, fine_id, rank, count(*) AS size FROM found GROUP BY ALL),
go AS (SELECT qid, fine_id FROM (SELECT *, coalesce(sum(size) OVER (PARTITION BY qid ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS given FROM sz) WHERE given < 15)
SELECT f.qid, f.fine_id, f.vec_id, round(f.dist, 6) AS dist FROM found f JOIN go USING (qid, fine_id)""")
def early_stop_lists(spark, d):
    b = base(spark, d)
    q = asked(b)
    found = scan.list_rows(route.nearest_lists(q, centroids(b, 32, "fine_id"), 8), q, listed(b))
    return scan.stop_after(found, 15).select("qid", "fine_id", "vec_id", "dist")


_SCO = """, sco AS (SELECT l.qid, l.fine_id, l.d, l.rank, CASE WHEN coalesce(u.u, 0) = 0 AND s.cnt IS NOT NULL AND NOT (q.hi < s.min_s OR q.lo > s.max_s) THEN 0.005 ELSE coalesce(u.u, 0) END AS utility
FROM nl l JOIN q USING (qid) LEFT JOIN syn s USING (fine_id) LEFT JOIN util u ON u.qid = l.qid AND u.fine_id = l.fine_id)"""
_SCORED = _UTIL + _NEAR.format(n=8) + _SCO


def _scored(b: DataFrame, q: DataFrame) -> DataFrame:
    dom = stats.domain(b)
    return route.scored(route.nearest_lists(q, centroids(b, 32, "fine_id"), 8), q, stats.synopsis(listed(b), *dom), *dom)


@query(_SCORED + " SELECT qid, fine_id, round(utility, 6) AS utility, round(d / (1 + 0.0625 * utility), 6) AS score FROM sco")
def filter_aware_route(spark, d):
    b = base(spark, d)
    return _scored(b, asked(b)).select("qid", "fine_id", "utility", "score")


@query(_SCORED + """ SELECT qid, fine_id, rank, row_number() OVER (PARTITION BY qid ORDER BY rank > 6, CASE WHEN rank > 6 THEN -round(utility, 9) ELSE 0 END, rank) AS new_rank FROM sco""")
def utility_rerank(spark, d):
    b = base(spark, d)
    return route.rerank_tail(_scored(b, asked(b)).withColumn("utility", F.round("utility", 9))).select("qid", "fine_id", "rank", "new_rank")


@query(""", r AS (SELECT q.qid, k.coarse_id, pow(list_distance(q.qv, k.c), 2) AS d, row_number() OVER (PARTITION BY q.qid ORDER BY list_distance(q.qv, k.c), k.coarse_id) AS rank FROM q, coarse k)
SELECT l.qid, CASE WHEN n.d - l.d <= 0.05 * greatest(1, l.d) THEN 2 ELSE 0 END::BIGINT AS extra FROM r l JOIN r n ON n.qid = l.qid AND n.rank = 4 WHERE l.rank = 3""")
def adaptive_fanout(spark, d):
    b = base(spark, d)
    return route.fan_out(route.nearest_lists(asked(b), centroids(b, 8, "coarse_id"), 8, "coarse_id"), 3, rows=8_600_000, ratio=0.05)


@query(_UTIL + _NEAR.format(n=16) + _SCO + """, g AS (SELECT qid, avg((utility > 0)::INT) AS overlap, avg((utility > 0.0051)::INT) AS positive, max(utility) / greatest(1e-6, avg(utility)) AS contrast FROM sco WHERE (rank - 1) % 3 = 0 AND (rank - 1) // 3 < 5 GROUP BY qid),
g2 AS (SELECT *, NOT (overlap > 0.85 OR positive > 0.65 OR (overlap > 0.70 AND contrast < 1.30)) AS aware FROM g),
fl AS (SELECT l.qid, avg((s.cnt IS NOT NULL AND NOT (q.hi < s.min_s OR q.lo > s.max_s))::INT) > 0.90 AS flat FROM nl l JOIN q USING (qid) LEFT JOIN syn s USING (fine_id) WHERE l.rank <= 8 GROUP BY l.qid)
SELECT qid, round(overlap, 6) AS overlap, round(positive, 6) AS positive, round(contrast, 6) AS contrast, aware, aware AND overlap <= 0.80 AS prune, flat FROM g2 JOIN fl USING (qid)""", width=3)
def filter_gate(spark, d):
    b = base(spark, d)
    q, dom = asked(b, width=3), stats.domain(b)
    lists, syn = route.nearest_lists(q, centroids(b, 32, "fine_id"), 16), stats.synopsis(listed(b), *dom)
    return route.filter_gate(lists, q, syn, *dom, sample=5).join(route.choose_flat(lists, q, syn, 8), "qid")


_TARGETED = _HITS + _NEAR.format(n=8) + _FOUND.format(lists="nl") + """, sn AS (SELECT nl.qid, nl.fine_id, nl.rank, greatest(1, coalesce(h.cnt, 0)) AS cnt, coalesce(h.hit, 0) AS hit, h.cnt IS NOT NULL AND NOT (h.hi < h.min_s OR h.lo > h.max_s) AS over FROM nl LEFT JOIN hits h ON h.qid = nl.qid AND h.fine_id = nl.fine_id),
ga AS (SELECT qid, avg(over::INT) <= 0.85 AND avg((hit > 0)::INT) <= 0.65 AS pays, 60.0::DOUBLE / count(*) AS mean FROM sn GROUP BY qid),
t1 AS (SELECT sn.*, mean, exp(-(rank - 1) / 48.0::DOUBLE) AS decay FROM sn JOIN ga USING (qid) WHERE pays), t2 AS (SELECT *, greatest(8, mean * decay, 3 * sqrt(hit) + 4) AS wanted FROM t1),
t3 AS (SELECT *, ceil(round(least(cnt, wanted), 9))::BIGINT AS base, ceil(round(least(cnt, greatest(wanted, 2 * hit + 16, 3 * mean)), 9))::BIGINT AS cap, decay * ln(1 + hit) * sqrt(least(1, hit / cnt)) * cnt / (cnt + 32) AS gain FROM t2),
t4 AS (SELECT *, sum(base) OVER w AS spent, sum(gain) OVER w AS mass FROM t3 WINDOW w AS (PARTITION BY qid)),
dn AS (SELECT *, greatest(1, floor(round(base * 60 / spent, 9)))::BIGINT AS b1 FROM t4 WHERE spent > 60),
dn2 AS (SELECT *, sum(b1) OVER (PARTITION BY qid) - 60 AS much, CASE WHEN b1 > 1 THEN sum((b1 > 1)::INT) OVER (PARTITION BY qid ORDER BY rank) END AS turn FROM dn),
up AS (SELECT *, CASE WHEN cap > base AND gain > 0 THEN round((60 - spent) * gain / mass, 9) END AS share FROM t4 WHERE spent <= 60),
up2 AS (SELECT *, CASE WHEN share IS NULL THEN 0 ELSE least(cap - base, floor(share))::BIGINT END AS more FROM up),
up3 AS (SELECT *, 60 - spent - sum(more) OVER (PARTITION BY qid) AS rest, row_number() OVER (PARTITION BY qid ORDER BY share IS NULL, -(share - more), rank) AS turn FROM up2),
one AS (SELECT qid, fine_id, rest, row_number() OVER (PARTITION BY qid ORDER BY t, turn) AS nth FROM (SELECT qid, fine_id, rest, turn, unnest(range(cap - base - more)) AS t FROM up3 WHERE share IS NOT NULL)),
ex AS (SELECT qid, fine_id, count(*) AS extra FROM one WHERE nth <= rest GROUP BY ALL),
bud AS (SELECT qid, fine_id, 60 AS budget FROM sn JOIN ga USING (qid) WHERE NOT pays UNION ALL SELECT qid, fine_id, b1 - coalesce(turn <= much, false)::INT FROM dn2
UNION ALL SELECT u.qid, u.fine_id, u.base + u.more + coalesce(ex.extra, 0) FROM up3 u LEFT JOIN ex ON ex.qid = u.qid AND ex.fine_id = u.fine_id)"""


@query(_TARGETED + " SELECT qid, fine_id, budget::BIGINT AS budget FROM bud", width=3)
def targeted_budgets(spark, d):
    return _budgets(base(spark, d))[2]


def _budgets(b: DataFrame):
    q, dom = asked(b, width=3), stats.domain(b)
    lists, rows = route.nearest_lists(q, centroids(b, 32, "fine_id"), 8), listed(b)
    seen = route.with_synopsis(lists, q, stats.synopsis(rows, *dom))
    low, high = F.col("range_min"), F.col("range_max")
    seen = seen.withColumn("hit", stats.hit_estimate(low, high, *dom)).withColumn("over", F.col("cnt").isNotNull() & stats.overlaps(low, high))
    return lists, scan.list_rows(lists, q, rows), scan.targeted(seen, 60)


@query(_TARGETED + """, sz AS (SELECT qid, fine_id, rank, count(*) AS size FROM found GROUP BY ALL),
acc AS (SELECT sz.*, sum(size) OVER w AS s, least(60, sum(budget) OVER w) AS b FROM sz JOIN bud USING (qid, fine_id) WINDOW w AS (PARTITION BY qid ORDER BY rank)),
dn3 AS (SELECT *, s + least(0, min(b - s) OVER (PARTITION BY qid ORDER BY rank)) AS done FROM acc),
tk AS (SELECT qid, fine_id, done - coalesce(lag(done) OVER (PARTITION BY qid ORDER BY rank), 0) AS take FROM dn3),
kept AS (SELECT f.* FROM (SELECT *, row_number() OVER (PARTITION BY qid, fine_id ORDER BY scalar, vec_id) AS nth FROM found) f JOIN tk USING (qid, fine_id) WHERE nth <= take)
SELECT qid, fine_id, vec_id, round(dist, 6) AS dist FROM kept""", width=3)
def targeted_budget_scan(spark, d):
    _, found, budgets = _budgets(base(spark, d))
    return scan.prefix_budgeted(found, budgets, 60).select("qid", "fine_id", "vec_id", "dist")


_STATS = _NEAR.format(n=8) + _FOUND.format(lists="nl") + """, st AS (SELECT nl.qid, count(DISTINCT nl.fine_id) AS lists, count(DISTINCT f.fine_id) AS lists_hit, count(f.vec_id) AS distances FROM nl LEFT JOIN found f USING (qid, fine_id) GROUP BY nl.qid)"""


@query(_STATS + " SELECT qid, lists, lists_hit, distances FROM st")
def search_counters(spark, d):
    b = base(spark, d)
    q = asked(b)
    lists = route.nearest_lists(q, centroids(b, 32, "fine_id"), 8)
    return scan.counters(lists, scan.list_rows(lists, q, listed(b)))


@query(_STATS + " SELECT count(*) AS queries, sum(lists)::BIGINT AS lists_total, sum(lists_hit)::BIGINT AS lists_hit_total, sum(distances)::BIGINT AS distances_total, round(avg(lists), 6) AS lists_avg, round(avg(lists_hit), 6) AS lists_hit_avg, round(avg(distances), 6) AS distances_avg FROM st")
def search_stats(spark, d):
    b = base(spark, d)
    q = asked(b)
    lists = route.nearest_lists(q, centroids(b, 32, "fine_id"), 8)
    return stats.search_totals(scan.counters(lists, scan.list_rows(lists, q, listed(b))))


@query(None)
def beam_repair_search(spark, d):
    b = base(spark, d)
    q, fine, coarse = asked(b), parents(b), centroids(b, 8, "coarse_id")
    walker = graph.Walker.of(fine, graph.neighbours(fine, 8), graph.coarse_seeds(fine, coarse))
    chosen = route.nearest_lists(q, coarse, 3, "coarse_id").select("qid", "coarse_id")
    lists = graph.beam_route(q, route.two_level(q, fine, coarse, 3, 3), chosen, walker, 9)
    return scan.search_lists(lists, q, listed(b), K)


# --- changes ---------------------------------------------------------------


@query("SELECT vec_id, fine_id, CASE WHEN vec_id % 3 = 0 THEN 'main' ELSE 'delta' END AS segment, CASE WHEN vec_id % 3 = 0 THEN 0 ELSE vec_id % 3 END::BIGINT AS batch_id FROM asg")
def insert_batches(spark, d):
    b = base(spark, d).select("vec_id", "embedding", "scalar")
    fine = centroids(base(spark, d), 32, "fine_id")
    rows = mutate.insert(None, b.where("vec_id % 3 = 0"), fine, 0, "main")
    for i in (1, 2):
        rows = mutate.insert(rows, b.where(f"vec_id % 3 = {i}"), fine, i)
    return rows.select("vec_id", "fine_id", "segment", "batch_id")


@query("SELECT fine_id, vec_id, row_number() OVER (PARTITION BY fine_id ORDER BY scalar, vec_id) AS pos FROM asg")
def merge_delta(spark, d):
    from pyspark.sql import Window

    b = base(spark, d).select("vec_id", "embedding", "scalar")
    fine = centroids(base(spark, d), 32, "fine_id")
    rows = mutate.insert(mutate.insert(None, b.where("vec_id % 2 = 0"), fine, 0, "main"), b.where("vec_id % 2 = 1"), fine, 1)
    merged = mutate.merge_segments(rows).where("segment = 'main'")
    return merged.select("fine_id", "vec_id", F.row_number().over(Window.partitionBy("fine_id").orderBy("scalar", "vec_id")).alias("pos"))


@query(""", s2 AS (SELECT fine_id, count(*) FILTER (vec_id % 4 <> 0) AS main, count(*) FILTER (vec_id % 4 = 0) AS delta FROM asg GROUP BY fine_id)
SELECT fine_id, main, delta FROM s2 WHERE delta >= 3""")
def merge_due(spark, d):
    rows = listed(base(spark, d)).withColumn("segment", F.when(F.col("vec_id") % 4 == 0, "delta").otherwise("main"))
    return mutate.merge_due(rows, cap=3).select("fine_id", "main", "delta")


@query(TOP.format(src="(SELECT * FROM pairs WHERE scalar BETWEEN lo AND hi AND vec_id % 7 <> 0)", k=K))
def delete_then_search(spark, d):
    b = base(spark, d)
    none = b.select("vec_id").limit(0)
    gone = mutate.remove(none, b.where("vec_id % 7 = 0").select("vec_id").union(spark.range(10**9, 10**9 + 3).toDF("vec_id")), b)
    return search.knn(mutate.live(b, gone), asked(b), K)


@query("SELECT fine_id, count(*) AS n FROM asg WHERE vec_id % 7 <> 0 GROUP BY fine_id")
def compact_lists(spark, d):
    rows = listed(base(spark, d))
    left, _ = mutate.compact(rows, rows.where("vec_id % 7 = 0").select("vec_id"))
    return left.groupBy("fine_id").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT count(*) AS n_vectors, count(*) FILTER (vec_id % 7 = 0) AS n_deleted, count(*) FILTER (vec_id % 7 <> 0) AS n_live FROM base")
def live_counts(spark, d):
    b = base(spark, d)
    return mutate.counts(b, b.where("vec_id % 7 = 0"))


@query("SELECT vec_id, fine_id FROM asg WHERE vec_id IN (3, 77, 310)")
def find_list(spark, d):
    return listed(base(spark, d)).where("vec_id IN (3, 77, 310)").select("vec_id", "fine_id")


@query("SELECT fine_id, n, round(mean_n, 6) AS mean_n FROM (SELECT *, avg(n) OVER () AS mean_n FROM sizes) WHERE n > 1.5 * mean_n ORDER BY n DESC, fine_id LIMIT 4")
def overloaded_lists(spark, d):
    b = base(spark, d)
    return mutate.overloaded(stats.list_sizes(listed(b), centroids(b, 32, "fine_id")))


@query("SELECT fine_id, vec_id, rnk FROM (SELECT *, row_number() OVER (PARTITION BY fine_id ORDER BY round(d2, 12) DESC, vec_id) AS rnk FROM asg) WHERE rnk <= 3")
def farthest_rows(spark, d):
    rows = listed(base(spark, d)).withColumn("dist_sq", F.round("dist_sq", 12))
    return mutate.farthest(rows, 3).select("fine_id", "vec_id", "rnk")


@query(_DRIFT + """, x AS (SELECT s.fine_id, s.n, s.n / 5.0 AS ins, greatest(0, s.n / greatest(1e-9, avg(s.n) OVER ()) - 1) AS sz, CASE WHEN s.n > 100 THEN rel_shift / 0.1 ELSE 0 END AS mv FROM sizes s JOIN dr USING (fine_id)),
y AS (SELECT *, n / (n + 64.0) * (0.45 * ins + 0.30 * least(sz, 2) + 0.25 * mv) AS p FROM x)
SELECT fine_id, n, round(p, 6) AS p FROM y WHERE (ins >= 1 AND p >= 0.55) OR (mv >= 1 AND p >= 0.45) ORDER BY p DESC, fine_id LIMIT 2""")
def recluster_candidates(spark, d):
    b = base(spark, d)
    sizes = stats.list_sizes(listed(b), centroids(b, 32, "fine_id"))
    return mutate.recluster_pressure(sizes, sizes.select("fine_id", F.col("n").alias("inserted")), _drift(b), 5)


@query("""SELECT fine_id, n, round(quality, 6) AS quality FROM (SELECT fine_id, count(*) AS n, least(1, 20.0 / count(*)) / (1 + avg(sqrt(d2))) AS quality FROM asg GROUP BY fine_id) WHERE quality < 0.3 OR n > 20 OR n > 10""")
def poor_lists(spark, d):
    rows = listed(base(spark, d))
    q = stats.quality(rows, 20)
    return mutate.poor_lists(q, q.select("fine_id", F.col("n").alias("inserted")), 0.3, 20)


@query(""", b2 AS (SELECT vec_id, emb, vec_id % 32 AS own, row_number() OVER (PARTITION BY vec_id % 32 ORDER BY round(pow(list_distance(emb, c), 2), 12) DESC, vec_id) AS r, pow(list_distance(emb, c), 2) AS own_sq FROM base JOIN fine ON fine_id = vec_id % 32),
far AS (SELECT * FROM b2 WHERE r <= 4)
SELECT f.vec_id, f.own AS fine_id, a.fine_id AS to_id FROM far f JOIN asg a USING (vec_id) WHERE a.fine_id <> f.own AND sqrt(a.d2) < 0.95 * sqrt(f.own_sq)""")
def hot_migration(spark, d):
    b = base(spark, d)
    fine = centroids(b, 32, "fine_id")
    misplaced = b.withColumn("fine_id", (F.col("vec_id") % 32).cast("int")).join(F.broadcast(fine), "fine_id").withColumn("dist_sq", F.round(V.l2_sq("embedding", "centroid"), 12)).drop("centroid")
    return mutate.migrate(misplaced, fine, fine, 4, 0.05)


@query(""", x AS (SELECT vec_id, fine_id, row_number() OVER (PARTITION BY fine_id ORDER BY vec_id) - 1 AS pos FROM asg), s2 AS (SELECT fine_id, count(*) AS n FROM asg GROUP BY fine_id),
want AS (SELECT fine_id, n, floor(i * n / 4)::BIGINT AS pos FROM s2, range(4) t(i) WHERE n > 4 UNION SELECT fine_id, n, pos FROM s2 JOIN x USING (fine_id) WHERE n <= 4)
SELECT x.fine_id, x.vec_id, x.pos FROM x JOIN want USING (fine_id, pos)""")
def spaced_sample(spark, d):
    rows = listed(base(spark, d))
    return mutate.evenly_spaced(rows, rows.groupBy("fine_id").agg(F.count(F.lit(1)).alias("n")), 4).select("fine_id", "vec_id", "pos")


@query(_STEP + """, st AS (SELECT b.vec_id AS part, emb AS c FROM asg b WHERE fine_id = 3 AND vec_id IN (SELECT vec_id FROM asg WHERE fine_id = 3 ORDER BY vec_id LIMIT 2)),
p1 AS (SELECT * FROM (SELECT a.vec_id, a.emb, st.part, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_distance(a.emb, st.c), 12), st.part) AS rn FROM asg a, st WHERE a.fine_id = 3) WHERE rn = 1),
sc2 AS (SELECT part, list(x ORDER BY i) AS c FROM (SELECT part, i, avg(x) AS x FROM (SELECT part, unnest(range(64)) AS i, unnest(emb) AS x FROM p1) GROUP BY ALL) GROUP BY part),
tg AS (SELECT part, fine_id AS to_id FROM (SELECT sc2.part, f.fine_id, row_number() OVER (PARTITION BY sc2.part ORDER BY round(list_distance(sc2.c, f.c), 12), f.fine_id) AS rn FROM sc2, fine f) WHERE rn = 1),
p2 AS (SELECT * FROM (SELECT a.vec_id, s.part, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_distance(a.emb, s.c), 12), s.part) AS rn FROM asg a, sc2 s WHERE a.fine_id = 3) WHERE rn = 1)
SELECT vec_id, 3::BIGINT AS fine_id, to_id FROM p2 JOIN tg USING (part) WHERE to_id <> 3""")
def local_recluster(spark, d):
    import numpy as np

    b = base(spark, d)
    rows = listed(b)
    start = np.array([r["embedding"] for r in rows.where("fine_id = 3").orderBy("vec_id").limit(2).collect()])
    return mutate.local_recluster(rows, centroids(b, 32, "fine_id"), 3, 2, 1, start)


_COARSE = _STEP + """, mp AS (SELECT fine_id, c, coarse_id FROM (SELECT n1.fine_id, n1.c, k.coarse_id, row_number() OVER (PARTITION BY n1.fine_id ORDER BY round(list_distance(n1.c, k.c), 12), k.coarse_id) AS rn FROM new1 n1, coarse k) WHERE rn = 1),
mv AS (SELECT max(list_distance(n1.c, f.c)) > 0.1 OR avg(list_distance(n1.c, f.c)) > 0.05 AS go FROM fine f JOIN new1 n1 USING (fine_id)),
mm AS (SELECT coarse_id, i, avg(x) AS x FROM (SELECT coarse_id, unnest(range(64)) AS i, unnest(c) AS x FROM mp) GROUP BY ALL)"""


@query(_COARSE + " SELECT o.coarse_id, o.dim, round(CASE WHEN go THEN coalesce(mm.x, o.x) ELSE o.x END, 6) AS x FROM (SELECT coarse_id, unnest(range(64)) AS dim, unnest(c) AS x FROM coarse) o CROSS JOIN mv LEFT JOIN mm ON mm.coarse_id = o.coarse_id AND mm.i = o.dim")
def coarse_update(spark, d):
    b = base(spark, d)
    fine = centroids(b, 32, "fine_id")
    new, _ = mutate.coarse_from_fine(kmeans.lloyd_step_sql(b, fine).select("fine_id", "centroid"), fine, centroids(b, 8, "coarse_id"))
    return new.select("coarse_id", F.posexplode("centroid").alias("dim", "x"))


def _index(spark, b: DataFrame):
    import numpy as np

    from rangevec.plans.index import RangeIndex

    fine = np.array([r["centroid"] for r in centroids(b, 32, "fine_id").orderBy("fine_id").collect()])
    return RangeIndex(spark, n_fine=32, n_coarse=8, n_probe=32, n_probe_coarse=8).train_with(fine)


_REPLACED = """, nw AS (SELECT vec_id, fine_id, CASE WHEN vec_id % 5 = 0 THEN scalar / 2 ELSE scalar END AS scalar FROM asg)"""


@query(_REPLACED + " SELECT fine_id, count(*) AS cnt, round(min(scalar), 6) AS min_s, round(max(scalar), 6) AS max_s, round(sum(scalar), 4) AS total FROM nw GROUP BY fine_id")
def replaced_synopsis(spark, d):
    b = base(spark, d).select("vec_id", "embedding", "scalar")
    index = _index(spark, b).add(b)
    index.add(b.where("vec_id % 5 = 0").withColumn("scalar", F.col("scalar") / 2), replace=True)
    return index.synopsis.select("fine_id", "cnt", "min_s", "max_s", F.round(F.col("cnt") * F.col("mean_s"), 4).alias("total"))


@query(_REPLACED + ", pn AS (SELECT q.qid, b.vec_id, list_distance(q.qv, b.emb) AS dist FROM q, base b JOIN nw USING (vec_id) WHERE nw.scalar BETWEEN q.lo AND q.hi AND b.vec_id % 9 <> 0) " + TOP.format(src="pn", k=K))
def insert_replace(spark, d):
    b = base(spark, d).select("vec_id", "embedding", "scalar")
    index = _index(spark, b).add(b.where("vec_id % 2 = 0")).add(b.where("vec_id % 2 = 1"))
    index.add(b.where("vec_id % 5 = 0").withColumn("scalar", F.col("scalar") / 2), replace=True)
    return index.remove(b.where("vec_id % 9 = 0").select("vec_id")).search(asked(base(spark, d)), K)


@query("SELECT 0::BIGINT AS vec_id, round(scalar, 6) AS scalar FROM base WHERE vec_id = 0 UNION ALL SELECT row_number() OVER (ORDER BY scalar), round(scalar, 6) FROM base WHERE vec_id > 0")
def auto_ids(spark, d):
    b = base(spark, d).select("vec_id", "embedding", "scalar")
    index = _index(spark, b).add(b.where("vec_id = 0").drop("vec_id")).add(b.where("vec_id > 0").drop("vec_id"))
    return index.rows.select("vec_id", "scalar")


@query("SELECT vec_id FROM asg WHERE fine_id = 3 AND scalar BETWEEN 10 AND 60")
def list_ids_in_range(spark, d):
    b = base(spark, d).select("vec_id", "embedding", "scalar")
    return _index(spark, b).add(b).ids_of(3, *SHARED)


_SOFT = """, wt AS (SELECT p.*, greatest(1, s.n)::DOUBLE AS w FROM par p JOIN sizes s USING (fine_id)), rad AS (SELECT sqrt(sum(w * d2) / sum(w)) AS radius FROM wt),
tgt AS (SELECT coarse_id, list(x ORDER BY i) AS t FROM (SELECT coarse_id, i, sum(w * x) / sum(w) AS x FROM (SELECT coarse_id, w, unnest(range(64)) AS i, unnest(c) AS x FROM wt) GROUP BY ALL) GROUP BY coarse_id),
cw AS (SELECT k.coarse_id, k.c, coalesce(t.t, k.c) AS t, coalesce(x.w, 1) AS w FROM coarse k LEFT JOIN tgt t USING (coarse_id) LEFT JOIN (SELECT coarse_id, sum(w) AS w FROM wt GROUP BY coarse_id) x USING (coarse_id)),
sf AS (SELECT sum(w * list_distance(c, t)) / sum(w) AS shift FROM cw),
nk AS (SELECT coarse_id, CASE WHEN shift / greatest(radius, 1e-6) >= 0.06 THEN list_transform(list_zip(c, t), lambda p: p[1] + 0.35 * (p[2] - p[1])) ELSE c END AS c FROM cw, sf, rad),
bst AS (SELECT fine_id, coarse_id AS best, b2 FROM (SELECT f.fine_id, k.coarse_id, pow(list_distance(f.c, k.c), 2) AS b2, row_number() OVER (PARTITION BY f.fine_id ORDER BY round(list_distance(f.c, k.c), 12), k.coarse_id) AS rn FROM fine f, nk k) WHERE rn = 1),
own AS (SELECT p.fine_id, p.coarse_id, pow(list_distance(p.c, k.c), 2) AS o2 FROM par p JOIN nk k USING (coarse_id))"""


@query(_SOFT + " SELECT fine_id, CASE WHEN o2 - b2 > pow(0.04 * radius, 2) AND (o2 - b2) / greatest(1e-12, o2) >= 0.12 THEN best ELSE coarse_id END AS coarse_id FROM own JOIN bst USING (fine_id) CROSS JOIN rad")
def soft_reconcile(spark, d):
    b = base(spark, d)
    fines = parents(b).join(stats.list_sizes(listed(b), centroids(b, 32, "fine_id")), "fine_id")
    return mutate.soft_reconcile(fines.select("fine_id", "coarse_id", "centroid", "n"), centroids(b, 8, "coarse_id"))[1]


# --- quantisation ----------------------------------------------------------

_BOOK = """, book AS (SELECT s.seg, b.vec_id AS code, emb[s.seg * 8 + 1 : s.seg * 8 + 8] AS sub FROM base b, range(8) s(seg) WHERE b.vec_id < 16),
enc AS (SELECT vec_id, seg, code FROM (SELECT b.vec_id, k.seg, k.code, row_number() OVER (PARTITION BY b.vec_id, k.seg ORDER BY pow(list_distance(b.emb[k.seg * 8 + 1 : k.seg * 8 + 8], k.sub), 2), k.code) AS rn FROM base b, book k) WHERE rn = 1)"""


def _book(b: DataFrame) -> DataFrame:
    cut = F.explode(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda s: F.struct(s.alias("seg"), F.slice(F.col("embedding"), s * 8 + 1, 8).alias("sub"))))
    return b.where("vec_id < 16").select(F.col("vec_id").cast("int").alias("code"), cut.alias("x")).select("x.seg", "code", "x.sub")


@query(_BOOK + " SELECT vec_id, seg, code FROM enc")
def pq_encode(spark, d):
    b = base(spark, d)
    return pq.encode(b, _book(b), 8).select("vec_id", F.posexplode("codes").alias("seg", "code"))


@query(_BOOK + """ SELECT vec_id, round(sum(pow(list_distance(b.emb[e.seg * 8 + 1 : e.seg * 8 + 8], k.sub), 2)), 6) AS error FROM enc e JOIN book k USING (seg, code) JOIN base b USING (vec_id) GROUP BY vec_id""")
def pq_decode_error(spark, d):
    b = base(spark, d)
    book = _book(b)
    return pq.decode(pq.encode(b, book, 8), book).join(b, "vec_id").select("vec_id", V.l2_sq("embedding", "decoded").alias("error"))


@query(_BOOK + """, t AS (SELECT q.qid, k.seg, k.code, pow(list_distance(q.qv[k.seg * 8 + 1 : k.seg * 8 + 8], k.sub), 2) AS d FROM q, book k),
a AS (SELECT t.qid, e.vec_id, sqrt(round(sum(t.d), 9)) AS dist FROM enc e JOIN t USING (seg, code) GROUP BY t.qid, e.vec_id) """ + TOP.format(src="a", k=K))
def pq_adc_topk(spark, d):
    b = base(spark, d)
    book = _book(b)
    found = pq.adc_search(asked(b), pq.encode(b, book, 8), book, 8, 10**6).withColumn("dist", F.sqrt(F.round(F.col("dist") * F.col("dist"), 9)))
    return search.top_k(found.drop("rnk"), K).select("qid", "rnk", "vec_id", "dist")


@query(_BOOK + """, dc AS (SELECT e.vec_id, list(x ORDER BY e.seg, i) AS v FROM (SELECT e.vec_id, e.seg, unnest(range(8)) AS i, unnest(k.sub) AS x FROM enc e JOIN book k USING (seg, code)) e GROUP BY e.vec_id)
SELECT vec_id, unnest(range(64)) AS dim, round(unnest(CASE WHEN vec_id % 2 = 0 THEN emb ELSE v END), 6) AS x FROM base JOIN dc USING (vec_id)""")
def row_vectors(spark, d):
    b = base(spark, d)
    book = _book(b)
    some = b.withColumn("embedding", F.when(F.col("vec_id") % 2 == 0, F.col("embedding")))
    return pq.row_vectors(some, pq.encode(b, book, 8), book).select("vec_id", F.posexplode("embedding").alias("dim", "x"))


# --- evaluation ------------------------------------------------------------


@query(_NEAR.format(n=8) + _FOUND.format(lists="nl") + f""", got AS (SELECT qid, vec_id FROM ({TOP.format(src="found", k=K)})),
truth AS (SELECT qid, vec_id FROM ({TOP.format(src="(SELECT * FROM pairs WHERE scalar BETWEEN lo AND hi)", k=K)}))
SELECT t.qid, round(avg((g.vec_id IS NOT NULL)::INT), 6) AS recall FROM truth t LEFT JOIN got g USING (qid, vec_id) GROUP BY t.qid""")
def recall_at_k(spark, d):
    b = base(spark, d)
    q = asked(b)
    got = scan.search_lists(route.nearest_lists(q, centroids(b, 32, "fine_id"), 8), q, listed(b), K)
    return search.recall(got, search.knn(b, q, K), K)


@query(f""", gt AS (SELECT s.size, t.qid, t.rnk, t.vec_id FROM (VALUES (200), (400)) s(size), ({TOP.format(src="pairs", k=K)}) t)
SELECT qid, rnk, CASE WHEN vec_id >= 390 THEN -1 ELSE vec_id END AS vec_id FROM gt WHERE size = 400""")
def groundtruth_by_size(spark, d):
    b = base(spark, d)
    gt = search.knn(b, asked(b, ranged=False), K)
    sized = gt.withColumn("size", F.explode(F.array(F.lit(200), F.lit(400)))).withColumn("kind", F.lit("vector"))
    return store.groundtruth(sized, 390).select("qid", "rnk", "vec_id")


_TUNED = """, z AS (SELECT (SELECT count(*) FROM base) AS n, avg(n)::DOUBLE * 100 AS mean, max(n)::DOUBLE * 100 AS most FROM sizes),
pp AS (SELECT * FROM (VALUES ('balanced', 0.5::DOUBLE, 0.5::DOUBLE), ('recall', 0.7::DOUBLE, 0.3::DOUBLE), ('speed', 0.4::DOUBLE, 0.7::DOUBLE)) t(preset, target, w), (VALUES (NULL::DOUBLE), (0.2::DOUBLE), (0.45::DOUBLE), (0.65::DOUBLE), (0.95::DOUBLE)) r(recall), z),
q1 AS (SELECT *, CASE WHEN n > 100 THEN trunc(10 * (1 + ln(n / 100.0::DOUBLE) / ln(20))) ELSE 10 END AS p1 FROM pp), q2 AS (SELECT *, CASE WHEN mean > 1000 THEN trunc(p1 * (1 + (mean - 1000) / 2000)) ELSE p1 END AS p2 FROM q1),
q3 AS (SELECT *, greatest(10, least(CASE WHEN most / mean > 2 THEN trunc(p2 * (1 + 0.1::DOUBLE * (most / mean - 2))) ELSE p2 END, 100)) AS p FROM q2),
q4 AS (SELECT *, CASE WHEN recall > target + 0.1::DOUBLE THEN CASE WHEN recall > 0.9 THEN 0.2::DOUBLE ELSE 0.5::DOUBLE END ELSE 1 END AS share, CASE WHEN recall IS NULL THEN 1 WHEN recall < 0.3 THEN 1 + 2 * (0.3::DOUBLE - recall) WHEN recall < target THEN 1 + 0.5::DOUBLE * (target - recall)
  WHEN recall <= target + 0.1::DOUBLE OR w < 0.5 THEN 1 WHEN recall > 0.9 THEN greatest(0.5::DOUBLE, 1 - (recall - target - 0.1::DOUBLE) * CASE WHEN w > 0.5 THEN 0.5::DOUBLE ELSE 0.3::DOUBLE END)
  ELSE greatest(0.8::DOUBLE, 1 - (recall - target - 0.1::DOUBLE) * CASE WHEN w > 0.5 THEN 0.3::DOUBLE ELSE 0.15::DOUBLE END) END AS f FROM q3)
SELECT preset, recall, p::BIGINT AS n_probe, greatest(2000, least(50000, trunc(trunc(trunc(5000 * (1 + (p / 10 - 1) * share)) * f) * (1 + greatest(0, mean - 1000) / 3000))))::BIGINT AS budget FROM q4"""


@query(_TUNED)
def tuned_params(spark, d):
    b = base(spark, d)
    s = stats.size_stats(stats.list_sizes(listed(b), centroids(b, 32, "fine_id"))).first()
    return tuning.table(spark, b.count(), s["avg_n"] * 100, s["max_n"] * 100, (None, 0.2, 0.45, 0.65, 0.95), max_probe=100, max_budget=50_000, first_size=100)


@query(""", g AS (SELECT n, m, (CASE WHEN n > 100000 THEN 1 + (n - 100000) / 100000 * 0.15 WHEN n > 50000 THEN 1 + (n - 50000) / 100000 * 0.10 WHEN n > 20000 THEN 1 + (n - 20000) / 100000 * 0.05 ELSE 1 END)::DOUBLE AS gp,
(CASE WHEN n > 100000 THEN 1 + (n - 100000) / 100000 * 0.05 WHEN n > 50000 THEN 1 + (n - 50000) / 100000 * 0.03 ELSE 1 END)::DOUBLE AS gm, (CASE WHEN n > 100000 THEN 1 + (n - 100000) / 100000 * 0.15 WHEN n > 50000 THEN 1 + (n - 50000) / 100000 * 0.12 WHEN n > 20000 THEN 1 + (n - 20000) / 100000 * 0.08 ELSE 1 END)::DOUBLE AS gb
FROM (VALUES (0::DOUBLE), (15000::DOUBLE), (37000::DOUBLE), (83000::DOUBLE), (254000::DOUBLE)) a(n), (VALUES (300::DOUBLE), (910::DOUBLE), (2570::DOUBLE)) b(m))
SELECT n::BIGINT AS n, m AS mean_list, CASE WHEN n = 0 THEN 8 ELSE least(32, CASE WHEN m > 500 THEN trunc(trunc(8 * gp) * (1 + (m - 500) / 2000 * 0.05::DOUBLE)) ELSE trunc(8 * gp) END) END::BIGINT AS two_level,
CASE WHEN n = 0 THEN 8 ELSE least(60, trunc(trunc(10 * (1 + greatest(0, m - 500) / 2000)) * gp)) END::BIGINT AS single_level, CASE WHEN n = 0 THEN 8 ELSE least(40, trunc(trunc(10 * gm) * (1 + greatest(0, m - 1500) / 5000))) END::BIGINT AS single_mid,
least(6000, trunc(250 * gb))::BIGINT AS budget, least(3000, trunc(150 * gb))::BIGINT AS budget_mid FROM g""")
def probe_rules(spark, d):
    return tuning.rules(spark, (0, 15_000, 37_000, 83_000, 254_000), (300.0, 910.0, 2570.0))
