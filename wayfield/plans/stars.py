"""Generic relational coverage on the star schema: joins, set operations, grouping sets, pairs of arms, vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import similarity as Y
from ..operators import stats as X
from .adapters import table
from .register import query

#: Pairs of a full join that one task makes.
PAIRS = 4_000_000
#: Vectors of a block, and cells of a slab of the product of two blocks.
BLOCK, CELLS = 32_768, 4_000_000


@query("SELECT r_name, c_mktsegment, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL")
def joi_star(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equi-joins; the planner broadcasts dimensions by their size."""
    t = lambda n: table(spark, sf_dir, n)
    j = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    j = j.join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return j.groupBy("r_name", "c_mktsegment").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count(F.lit(1)).alias("n"))


@query("SELECT c_custkey, coalesce(n, 0) AS n_orders FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY ALL) ON c_custkey = o_custkey")
def joi_left_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    return table(spark, sf_dir, "customer").join(n, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n_orders"))


@query("SELECT s_suppkey, c_custkey, coalesce(s_nationkey, c_nationkey) AS nation FROM supplier FULL JOIN customer ON s_nationkey = c_nationkey")
def joi_full_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All suppliers and all customers, paired by nation; the result grows with the product of a nation's suppliers and customers.

    Its input is small enough for one task, its result isn't: a nation's customers are dealt out over as many parts as the number of pairs asks for, and its
    suppliers are in each of them. Those without a partner are added."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("nation"))
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("nation"))
    sizes = s.groupBy("nation").agg(F.count(F.lit(1)).alias("n")).join(c.groupBy("nation").agg(F.count(F.lit(1)).alias("m")), "nation")
    pairs, nations = sizes.agg(F.coalesce(F.sum(F.col("n") * F.col("m")), F.lit(0)), F.count(F.lit(1))).first()
    tasks = max(1, min(-(-pairs // PAIRS), 5_000))
    parts = max(1, -(-tasks // max(nations, 1)))
    left = s.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).repartition(tasks, "nation", "part")
    right = c.withColumn("part", F.pmod(F.xxhash64("c_custkey"), F.lit(parts)).cast("int")).repartition(tasks, "nation", "part")
    both = left.hint("merge").join(right, ["nation", "part"]).select("s_suppkey", "c_custkey", "nation")
    alone = s.join(c.select("nation"), "nation", "left_anti").select("s_suppkey", F.lit(None).cast("bigint").alias("c_custkey"), "nation")
    return both.union(alone).union(c.join(s.select("nation"), "nation", "left_anti").select(F.lit(None).cast("bigint"), "c_custkey", "nation"))


@query("SELECT p_partkey FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45) AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_returnflag = 'R' AND l_discount > 0.08)")
def joi_semi_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem")
    many, back = (line.where(w).select(F.col("l_partkey").alias("p_partkey")) for w in ("l_quantity > 45", "l_returnflag = 'R' and l_discount > 0.08"))
    return table(spark, sf_dir, "part").select("p_partkey").join(many, "p_partkey", "left_semi").join(back, "p_partkey", "left_anti")


@query("SELECT o_orderkey, l_linenumber, date_diff('day', o_orderdate::DATE, l_shipdate::DATE) AS days FROM orders JOIN lineitem ON o_orderkey = l_orderkey AND l_shipdate >= o_orderdate AND l_shipdate <= o_orderdate + INTERVAL 30 DAY")
def joi_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Range predicate on an equi-join: lines shipped within 30 days of the order."""
    o, line = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    near = (F.col("l_shipdate") >= F.col("o_orderdate")) & (F.col("l_shipdate") <= F.col("o_orderdate") + F.expr("interval 30 days"))
    return o.join(line, (F.col("o_orderkey") == F.col("l_orderkey")) & near).select("o_orderkey", "l_linenumber", F.datediff("l_shipdate", "o_orderdate").cast("long").alias("days"))


@query("SELECT event_id, last_error FROM (SELECT event_id, event_type, max(CASE WHEN event_type = 'error' THEN event_id END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_error FROM events) WHERE event_type = 'purchase'")
def joi_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As-of: each purchase with the user's last error before it, by one sort of the events and no join (event ids rise with time)."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    e = table(spark, sf_dir, "events").withColumn("last_error", F.max(F.when(F.col("event_type") == "error", F.col("event_id"))).over(w))
    return e.where("event_type = 'purchase'").select("event_id", "last_error")


@query("(SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier) EXCEPT (SELECT n_nationkey FROM nation WHERE n_regionkey = 0) UNION ALL SELECT r_regionkey + 100 FROM region")
def set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n, c: table(spark, sf_dir, n).select(F.col(c).alias("k"))
    zero = table(spark, sf_dir, "nation").where("n_regionkey = 0").select(F.col("n_nationkey").alias("k"))
    return t("customer", "c_nationkey").intersect(t("supplier", "s_nationkey")).subtract(zero).unionByName(table(spark, sf_dir, "region").select((F.col("r_regionkey") + 100).alias("k")))


@query("SELECT l_returnflag, l_linestatus, sum(l_quantity)::BIGINT AS qty, count(*) AS n, grouping(l_returnflag)::INT * 2 + grouping(l_linestatus)::INT AS level FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def agg_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "lineitem").rollup("l_returnflag", "l_linestatus")
    return r.agg(F.sum("l_quantity").cast("long").alias("qty"), F.count(F.lit(1)).alias("n"), F.grouping_id().cast("int").alias("level"))


@query("SELECT o_custkey, o_orderkey, o_totalprice, k FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders) WHERE k <= 3")
def top_k_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three dearest orders of each customer (the operator's own limit)."""
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, sf_dir, "orders").withColumn("k", F.row_number().over(w)).where("k <= 3").select("o_custkey", "o_orderkey", "o_totalprice", "k")


ARMS = ["base", "hot", "note", "shuffled"]
FACTORIAL = """WITH x AS (SELECT o_custkey AS instance, ['base', 'hot', 'note', 'shuffled'][o_orderkey % 4 + 1] AS arm, l_returnflag = 'R' AS r FROM orders JOIN lineitem ON o_orderkey = l_orderkey),
y AS (SELECT instance, arm, max(r::INT) AS resolved FROM x GROUP BY ALL),
w AS (SELECT instance, max(resolved) FILTER (arm = 'base') AS base, max(resolved) FILTER (arm = 'hot') AS hot, max(resolved) FILTER (arm = 'note') AS note, max(resolved) FILTER (arm = 'shuffled') AS shuffled FROM y GROUP BY ALL HAVING count(*) = 4)"""


def paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as instances with an outcome in each of four arms."""
    arm = F.element_at(F.array(*[F.lit(a) for a in ARMS]), (F.col("o_orderkey") % 4 + 1).cast("int"))
    x = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    y = x.select(F.col("o_custkey").alias("instance"), arm.alias("arm"), (F.col("l_returnflag") == "R").cast("int").alias("r"))
    return y.groupBy("instance").pivot("arm", ARMS).agg(F.max("r")).dropna(subset=ARMS)


@query(FACTORIAL + " SELECT * FROM w")
def src9_factorial(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paired(spark, sf_dir)


@query(FACTORIAL + " SELECT round(avg(base), 6) AS base, round(avg(hot), 6) AS hot, round(avg(note), 6) AS note, round(avg(shuffled), 6) AS shuffled, round(avg(hot - base) - avg(note - shuffled), 6) AS did, count(*) AS n FROM w")
def agg34_difference_in_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    did = F.avg(F.col("hot") - F.col("base")) - F.avg(F.col("note") - F.col("shuffled"))
    return paired(spark, sf_dir).agg(*[F.round(F.avg(a), 6).alias(a) for a in ARMS], F.round(did, 6).alias("did"), F.count(F.lit(1)).alias("n"))


@query(FACTORIAL + " SELECT instance, base, hot, note, shuffled FROM w WHERE note = 0 AND hot = 1 AND shuffled = 0")
def agg36_case_studies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paired(spark, sf_dir).where("note = 0 and hot = 1 and shuffled = 0")


@query(
    FACTORIAL
    + """, g AS (SELECT count(*) FILTER (hot > base) AS wins, count(*) FILTER (hot < base) AS losses, count(*) FILTER (hot = base) AS ties FROM w),
lf AS (SELECT n, sum(l) OVER (ORDER BY n) AS f FROM (SELECT n, CASE WHEN n = 0 THEN 0 ELSE ln(n) END AS l FROM (SELECT unnest(range((SELECT wins + losses + 1 FROM g))) AS n)))
SELECT wins, losses, ties, round(CASE WHEN wins + losses = 0 THEN 1 ELSE least(1, 2 * (SELECT sum(exp(a.f - b.f - c.f - (wins + losses) * ln(2))) FROM lf a, lf b, lf c WHERE a.n = wins + losses AND b.n <= least(wins, losses) AND c.n = wins + losses - b.n)) END, 6) AS p FROM g"""
)
def sta14_sign_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.sign_test(paired(spark, sf_dir), [], "hot", "base")


HASH = "('0x' || substr(md5({}), 1, 8))::BIGINT"


@query(
    FACTORIAL
    + f""", k AS (SELECT hot - base AS d, row_number() OVER (ORDER BY instance) - 1 AS i, count(*) OVER () AS n FROM w),
draws AS (SELECT rep, {HASH.format("'7|' || rep || '|' || slot")} % (SELECT max(n) FROM k) AS i FROM (SELECT unnest(range(10000)) AS rep), (SELECT unnest(range((SELECT max(n) FROM k))) AS slot)),
m AS (SELECT rep, avg(d) AS m FROM draws JOIN k USING (i) GROUP BY rep), l AS (SELECT list_sort(list(m)) AS xs FROM m)
SELECT round(xs[251], 6) AS lo, round(xs[5001], 6) AS mid, round(xs[9751], 6) AS hi, len(xs)::BIGINT AS n_replicates FROM l"""
)
def sta15_paired_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten thousand resamples of all instances."""
    d = paired(spark, sf_dir).select("instance", (F.col("hot") - F.col("base")).cast("tinyint").alias("d"))
    sums = X.resampled_sums(d, [], ["instance"], ["d"], 10_000, lambda own: {"total": own["d"]}, ["total"])
    means = sums.select("rep", (F.col("total") / F.col("n")).alias("m"))
    out = X.interval(means.withColumn("all", F.lit(0)), ["all"], "m", 10_000)
    return out.select(F.round("lo", 6).alias("lo"), F.round("mid", 6).alias("mid"), F.round("hi", 6).alias("hi"), "n_replicates")


@query(
    FACTORIAL
    + f""", k AS (SELECT c_nationkey AS cluster, avg(hot) - avg(base) AS d FROM w JOIN customer ON instance = c_custkey GROUP BY ALL), o AS (SELECT avg(d) AS observed FROM k),
f AS (SELECT rep, avg(CASE WHEN {HASH.format("'7|' || rep || '|' || cluster")} % 2 = 0 THEN d ELSE -d END) AS m FROM k, (SELECT unnest(range(10000)) AS rep) GROUP BY rep)
SELECT round(observed, 6) AS observed, count(*) FILTER (m >= observed - 1e-12) AS n_ge, round((count(*) FILTER (m >= observed - 1e-12) + 1) / (count(*) + 1), 6) AS p FROM f, o GROUP BY observed"""
)
def sta17_sign_flip_by_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as clusters under STA17's sign flips."""
    w = paired(spark, sf_dir).join(table(spark, sf_dir, "customer"), F.col("instance") == F.col("c_custkey"))
    k = w.groupBy(F.col("c_nationkey").alias("cluster")).agg((F.avg("hot") - F.avg("base")).alias("d"))
    return X.sign_flip(k, "cluster", "d", 10_000)


@query(
    FACTORIAL
    + f""", k AS (SELECT d, row_number() OVER (ORDER BY cluster) - 1 AS i, count(*) OVER () AS n FROM (SELECT c_nationkey AS cluster, (avg(hot) - avg(base)) - (avg(note) - avg(shuffled)) AS d FROM w JOIN customer ON instance = c_custkey GROUP BY ALL)),
draws AS (SELECT rep, {HASH.format("'7|' || rep || '|' || slot || '|0'")} % (SELECT max(n) FROM k) AS i FROM (SELECT unnest(range(10000)) AS rep), (SELECT unnest(range((SELECT max(n) FROM k))) AS slot)),
m AS (SELECT rep, avg(d) AS m FROM draws JOIN k USING (i) GROUP BY rep), l AS (SELECT list_sort(list(m)) AS xs FROM m)
SELECT round(xs[251], 6) AS lo, round(xs[5001], 6) AS mid, round(xs[9751], 6) AS hi, len(xs)::BIGINT AS n_replicates FROM l"""
)
def sta16_cluster_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten thousand resamples of whole nations: the difference in differences of their means of the four arms."""
    w = paired(spark, sf_dir).join(table(spark, sf_dir, "customer"), F.col("instance") == F.col("c_custkey"))
    did = (F.avg("hot") - F.avg("base")) - (F.avg("note") - F.avg("shuffled"))
    k = w.groupBy(F.col("c_nationkey").alias("cluster")).agg(did.alias("d")).withColumn("all", F.lit(0))
    means = X.resampled(k, ["all"], ["cluster"], 10_000).groupBy("all", "rep").agg(F.avg("d").alias("m"))
    out = X.interval(means, ["all"], "m", 10_000)
    return out.select(F.round("lo", 6).alias("lo"), F.round("mid", 6).alias("mid"), F.round("hi", 6).alias("hi"), "n_replicates")


COSINE = """WITH v AS (SELECT vec_id, label, embedding AS e, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings),
knn AS (SELECT i, rank, j, d, li, lj FROM (SELECT a.vec_id AS i, b.vec_id AS j, a.label AS li, b.label AS lj, round(1 - list_dot_product(a.e::DOUBLE[], b.e::DOUBLE[]) / (a.n * b.n), 6) AS d,
  row_number() OVER (PARTITION BY a.vec_id ORDER BY round(1 - list_dot_product(a.e::DOUBLE[], b.e::DOUBLE[]) / (a.n * b.n), 6), b.vec_id) AS rank FROM v a JOIN v b ON a.vec_id <> b.vec_id) WHERE rank <= 6)"""


def vector_neighbours(spark: SparkSession, sf_dir: str, k: int = 6) -> DataFrame:
    """Exact cosine neighbours of dense vectors: blocks of about BLOCK vectors, or fewer, meet blocks, and each pair of blocks is multiplied in slabs of rows.

    The number of blocks follows that of the vectors, so a pair of blocks has a fixed size; only the k best of each row and pair leave it."""
    import numpy as np
    import pyarrow as pa

    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    many = e.count()
    side = max(1, -(-many // BLOCK), min(12, -(-4 * many // BLOCK)))  # smaller blocks while these are few
    e = e.withColumn("block", F.pmod("vec_id", F.lit(side)).cast("int"))
    left = e.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(side - 1)))).select("block", "other", "vec_id", "embedding")
    right = e.select(F.col("block").alias("other"), F.explode(F.sequence(F.lit(0), F.lit(side - 1))).alias("block"), "vec_id", "embedding")

    def matrix(t: pa.Table) -> np.ndarray:
        x = np.asarray(t["embedding"].combine_chunks().flatten(), np.float64).reshape(t.num_rows, -1)
        return x / np.linalg.norm(x, axis=1, keepdims=True)

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return pa.table({"i": pa.array([], pa.int64()), "j": pa.array([], pa.int64()), "d": pa.array([], pa.float64())})
        b = b.sort_by("vec_id")
        x, y, i, j = matrix(a), matrix(b).T.copy(), np.asarray(a["vec_id"]), np.asarray(b["vec_id"])
        lost = np.isnan(y).any() or np.isnan(x).any()
        most = min(k + 1, len(j))  # with the vector itself
        out = []
        for at in range(0, len(i), slab := max(1, CELLS // len(j))):
            near = x[at : at + slab] @ y
            near[i[at : at + slab, None] == j[None, :]] = -np.inf
            if lost:
                near[np.isnan(near)] = -np.inf
            # all that may be as near as the k-th when rounded; then by distance and number
            least = np.partition(near, len(j) - most, axis=1)[:, len(j) - most] - 2e-6
            row, col = np.nonzero(near >= least[:, None])
            d = np.round(1 - near[row, col], 6)
            order = np.lexsort((col, d, row))
            row, col, d = row[order], col[order], d[order]
            keep = (np.arange(len(row)) - np.searchsorted(row, row) < k) & np.isfinite(d)
            out.append((i[at + row[keep]], j[col[keep]], d[keep]))
        return pa.table(dict(zip("ijd", (np.concatenate(c) for c in zip(*out)))))

    found = left.groupBy("block", "other").cogroup(right.groupBy("block", "other")).applyInArrow(run, "i long, j long, d double")
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("i").orderBy("d", "j"))).where(F.col("rank") <= k)


@query(COSINE + " SELECT i, rank, j, d FROM knn")
def sim4_vector_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_neighbours(spark, sf_dir).select("i", "rank", "j", "d")


@query(COSINE + " SELECT a.i AS source, a.j AS target, round(exp(-least(a.d, b.d) / 0.35), 6) AS weight FROM knn a JOIN knn b ON a.i = b.j AND a.j = b.i WHERE a.i < a.j")
def joi1_vector_mutual_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    knn = vector_neighbours(spark, sf_dir).select(F.lit(0).alias("task_id"), "i", "rank", "j", F.col("d").alias("distance"))
    return Y.mutual_edges(knn).select("source", "target", "weight")


@query(
    """WITH x AS (SELECT c_mktsegment AS g, c_acctbal AS v FROM customer), s AS (SELECT g, count(*) AS n, avg(v) AS m, var_pop(v) AS p FROM x GROUP BY g HAVING count(*) >= 2),
t AS (SELECT count(*) AS k, sum(n) AS n, sum(n * m) / sum(n) AS mean, sum(n * p) AS w FROM s)
SELECT round((SELECT sum(s.n * (m - mean) * (m - mean)) FROM s, t) / (k - 1) / (w / (n - k)), 6) AS f, k AS n_groups, n::BIGINT AS n FROM t"""
)
def sta1_anova_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The F statistic; its tail probability has tests of its own."""
    x = table(spark, sf_dir, "customer").withColumn("all", F.lit(0))
    return X.anova(x, ["all"], "c_mktsegment", "c_acctbal").select("f", "n_groups", "n")
