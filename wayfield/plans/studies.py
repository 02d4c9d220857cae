"""Profiles, separability, rank consistency, capability axes, regressions and resampled supply over the task-and-model table."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import events as E
from ..operators import graph as G
from ..operators import stats as X
from .adapters import PRELUDE, Landscape
from .chains import Dynamics
from .register import query

METRICS = ["resolve_rate", "core_visit_rate", "basin_entry_rate", "basin_escape_rate", "committor_dp", "mfpt_to_core", "escape_hazard", "return_prob"]
AXES = ["reach", "gate", "avoid", "recovery"]


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a task and model with all measures."""
    return G.kept(Dynamics(spark, sf_dir).table(), "dynamics")


def with_z(obs: DataFrame) -> DataFrame:
    """obs with z_<metric>; means and deviations are one broadcast row."""
    parameters = obs.agg(*[f(m).alias(f"{k}_{m}") for m in METRICS for k, f in (("mean", F.avg), ("sd", F.stddev_pop))])
    out = obs.crossJoin(F.broadcast(parameters))
    for m in METRICS:
        out = out.withColumn(f"z_{m}", F.coalesce(F.when(F.col(f"sd_{m}") > 1e-8, (F.col(m) - F.col(f"mean_{m}")) / F.col(f"sd_{m}")), F.lit(0.0)))
    return out.drop(*[f"{k}_{m}" for m in METRICS for k in ("mean", "sd")])


def axes(obs: DataFrame) -> DataFrame:
    """obs with reach, gate, avoid and recovery, raw and (``c_``) less the task's mean."""
    out = with_z(obs)
    out = out.withColumn("reach", F.col("z_core_visit_rate") - F.col("z_mfpt_to_core")).withColumn("gate", F.col("z_committor_dp"))
    out = out.withColumn("avoid", -(F.col("z_basin_entry_rate") + F.col("z_escape_hazard"))).withColumn("recovery", F.col("z_basin_escape_rate") + F.col("z_return_prob"))
    for a in AXES:
        out = out.withColumn(f"c_{a}", F.col(a) - F.avg(a).over(Window.partitionBy("benchmark", "task_id")))
    return out


def long(obs: DataFrame, metrics: list[str] = METRICS) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("x")) for m in metrics])
    return obs.select("benchmark", "task_id", "model_id", "resolve_rate", F.inline(pairs)).where("x is not null")


@query()
def agg22_profile_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of each measure for each model and benchmark; nulls are left out."""
    return long(observations(spark, sf_dir)).groupBy("model_id", "benchmark", "metric").agg(F.round(F.avg("x"), 6).alias("mean"), F.count(F.lit(1)).alias("n"))


@query()
def agg25_capability_axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG23-AGG26: centred axes by model, and for each benchmark too (benchmark null: over all)."""
    a = axes(observations(spark, sf_dir))
    means = [F.round(F.avg(f"c_{x}"), 6).alias(x) for x in AXES]
    return a.groupBy("model_id").agg(*means).select("model_id", F.lit(None).cast("string").alias("benchmark"), *AXES).unionByName(a.groupBy("model_id", "benchmark").agg(*means))


def axis_demand(a: DataFrame) -> DataFrame:
    """(benchmark, axis, demand): contrast weighted by resolve rate; of benchmarks with five records or more."""
    y = F.col("resolve_rate")
    good, bad = F.sum(y), F.sum(1 - y)
    value = lambda x: F.when((good > 1e-12) & (bad > 1e-12), F.sum(y * F.col(x)) / good - F.sum((1 - y) * F.col(x)) / bad).otherwise(0.0)
    wide = a.groupBy("benchmark").agg(*[value(x).alias(x) for x in AXES], F.count(F.lit(1)).alias("n")).where("n >= 5")
    return wide.select("benchmark", F.inline(F.array(*[F.struct(F.lit(x).alias("axis"), F.col(x).alias("demand")) for x in AXES])))


@query()
def agg27_axis_demand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return axis_demand(axes(observations(spark, sf_dir))).withColumn("demand", F.round("demand", 6))


SAFE = """, core AS (SELECT task_id, block_id FROM masked WHERE is_core), nc AS (SELECT task_id, count(*) AS n FROM core GROUP BY ALL),
s AS (SELECT o.task_id, o.model_id, count(DISTINCT o.block_id) AS seen FROM ordered o JOIN core USING (task_id, block_id) GROUP BY ALL),
cv AS (SELECT g.task_id, g.model_id, coalesce(seen / n, 0) AS cvr FROM (SELECT DISTINCT task_id, model_id FROM runs) g LEFT JOIN nc USING (task_id) LEFT JOIN s USING (task_id, model_id)),
f AS (SELECT o.task_id, o.model_id, o.run_id, bool_or(coalesce(is_trap, false)) AS i FROM ordered o LEFT JOIN masked USING (task_id, block_id) GROUP BY ALL),
e AS (SELECT task_id, model_id, avg(i::INT) AS entry FROM f GROUP BY ALL)
SELECT model_id, round(avg(cvr - 1.5 * entry), 6) AS safe, round(avg((cvr > 0 AND entry = 0)::INT), 6) AS productive FROM cv JOIN e USING (task_id, model_id) GROUP BY ALL"""


@query(PRELUDE + SAFE)
def agg28_composites(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = Dynamics(spark, sf_dir)
    both = d.core_visits().join(d.basin_rates(), ["task_id", "model_id"])
    safe, productive = F.col("core_visit_rate") - 1.5 * F.col("basin_entry_rate"), ((F.col("core_visit_rate") > 0) & (F.col("basin_entry_rate") == 0)).cast("int")
    return both.groupBy("model_id").agg(F.round(F.avg(safe), 6).alias("safe"), F.round(F.avg(productive), 6).alias("productive"))


@query(PRELUDE + "SELECT task_id, model_id, round(avg(n), 6) AS mean_steps, round(avg(tools), 6) AS mean_tools, round(avg(resolved), 6) AS resolve_rate FROM (SELECT task_id, model_id, run_id, resolved, count(*) AS n, count(DISTINCT tool) AS tools FROM steps GROUP BY ALL) GROUP BY ALL")
def agg29_baselines(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = Landscape(spark, sf_dir).steps.groupBy("task_id", "model_id", "run_id", "resolved").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("tool").alias("tools"))
    return runs.groupBy("task_id", "model_id").agg(F.round(F.avg("n"), 6).alias("mean_steps"), F.round(F.avg("tools"), 6).alias("mean_tools"), F.round(F.avg("resolved"), 6).alias("resolve_rate"))


def bilinear(a: DataFrame) -> DataFrame:
    """(model, benchmark): mean rate, additive prediction, alignment a.d, residual (STA8)."""
    cells = a.groupBy("model_id", "benchmark").agg(F.avg("resolve_rate").alias("actual"))
    mean = lambda *by: F.avg("actual").over(Window.partitionBy(*by))
    cells = cells.withColumn("all", F.lit(0))
    cells = cells.withColumn("predicted", mean("all", "model_id") + mean("all", "benchmark") - mean("all")).drop("all")
    supply = a.groupBy("model_id").agg(*[F.avg(f"c_{x}").alias(f"c_{x}") for x in AXES])
    supply = supply.select("model_id", F.inline(F.array(*[F.struct(F.lit(x).alias("axis"), F.col(f"c_{x}").alias("supply")) for x in AXES])))
    aligned = supply.join(axis_demand(a), "axis").groupBy("model_id", "benchmark").agg(F.sum(F.col("supply") * F.col("demand")).alias("alignment"), F.max_by("axis", F.abs(F.col("supply") * F.col("demand"))).alias("main_axis"))
    return cells.join(aligned, ["model_id", "benchmark"], "left").withColumn("residual", F.col("actual") - F.col("predicted"))


@query()
def agg30_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG30 and STA8's cells: what the additive fit leaves, with the alignment of supply and demand; the greatest residual first."""
    out = bilinear(axes(observations(spark, sf_dir)))
    return out.select("model_id", "benchmark", *[F.round(c, 6).alias(c) for c in ("actual", "predicted", "residual", "alignment")], "main_axis", F.when(F.col("residual") > 0, "above").otherwise("below").alias("direction")).orderBy(F.desc(F.abs("residual")), "model_id", "benchmark")


@query()
def sta8_bilinear_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R2 of the additive fit, and with the alignment as one more regressor of its residual."""
    c = bilinear(axes(observations(spark, sf_dir)))
    by = c.agg(F.var_pop("actual").alias("v"), F.avg(F.col("residual") * F.col("residual")).alias("left"), (F.covar_pop("alignment", "residual") / F.nullif(F.stddev_pop("alignment") * F.stddev_pop("residual"), F.lit(0.0))).alias("r"))
    additive = 1 - F.col("left") / F.nullif(F.col("v"), F.lit(0.0))
    return by.select(F.round(additive, 6).alias("r2_additive"), F.round(additive + F.col("left") / F.nullif(F.col("v"), F.lit(0.0)) * F.coalesce(F.col("r") * F.col("r"), F.lit(0.0)), 6).alias("r2_both"))


@query()
def sta1_separability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ANOVA of each measure between models, by benchmark."""
    return X.anova(long(observations(spark, sf_dir)), ["benchmark", "metric"], "model_id", "x")


@query()
def sta2_rank_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kendall's tau of the models' means between each pair of benchmarks, for each measure."""
    m = long(observations(spark, sf_dir)).groupBy("metric", "benchmark", "model_id").agg(F.avg("x").alias("x"))
    a, b = m.withColumnRenamed("benchmark", "first"), m.select("metric", F.col("benchmark").alias("second"), "model_id", F.col("x").alias("y"))
    pairs = a.join(b, ["metric", "model_id"]).where("first < second")
    return X.kendall_tau(pairs, ["metric", "first", "second"], "model_id", "x", "y").where("n_pairs >= 3")


@query()
def sta4_reward_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.spearman(long(observations(spark, sf_dir), METRICS[1:]), ["metric"], "x", "resolve_rate")


@query()
def sta5_leave_one_benchmark_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tau of each benchmark's model means with the means over the other benchmarks."""
    m = long(observations(spark, sf_dir)).groupBy("metric", "benchmark", "model_id").agg(F.avg("x").alias("x"))
    w = Window.partitionBy("metric", "model_id")
    others = m.withColumn("n", F.count(F.lit(1)).over(w)).withColumn("rest", (F.sum("x").over(w) - F.col("x")) / (F.col("n") - 1)).where("n >= 2")
    return X.kendall_tau(others, ["metric", "benchmark"], "model_id", "x", "rest").where("n_pairs >= 3")


@query()
def sta6_nested_logistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The task-and-model table is one group: it has as many rows as there are tasks times models, not steps."""
    o = with_z(observations(spark, sf_dir)).withColumn("y", (F.col("resolve_rate") > 0).cast("double"))
    return X.nested_logistic(o, "y", "benchmark", "model_id", [f"z_{m}" for m in METRICS[1:]])


@query()
def sta7_ols_demand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.ols(axes(observations(spark, sf_dir)), ["benchmark"], "resolve_rate", [f"c_{a}" for a in AXES])


def transfer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(held, model_id, score, rate): for each held-out benchmark supply elsewhere times mean demand elsewhere, and the models' rates there."""
    a = axes(observations(spark, sf_dir)).withColumn("all", F.lit(0))
    folds = a.select(F.col("benchmark").alias("held")).distinct()
    elsewhere = a.crossJoin(F.broadcast(folds)).where("benchmark <> held")
    supply = elsewhere.groupBy("held", "model_id").agg(*[F.avg(f"c_{x}").alias(x) for x in AXES])
    d = folds.crossJoin(axis_demand(a)).where("benchmark <> held").groupBy("held").pivot("axis", AXES).agg(F.avg("demand"))
    d = d.select("held", *[F.col(x).alias(f"d_{x}") for x in AXES])
    score = reduce(lambda s, x: s + F.col(x) * F.col(f"d_{x}"), AXES[1:], F.col(AXES[0]) * F.col(f"d_{AXES[0]}"))
    rates = a.groupBy(F.col("benchmark").alias("held"), "model_id").agg(F.avg("resolve_rate").alias("rate"))
    return supply.join(d, "held").withColumn("score", score).join(rates, ["held", "model_id"]).select("held", "model_id", "score", "rate")


@query()
def sta9_transfer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each held-out benchmark: tau of the models' rates there with supply elsewhere times mean demand elsewhere."""
    return X.kendall_tau(transfer(spark, sf_dir), ["held"], "model_id", "score", "rate")


def resampled_taus(rows: DataFrame, draws: int = 1000, permutations: int = 500) -> DataFrame:
    """(held, tau, lo, hi, n_bootstrap, permutation_p): percentiles over resampled models, and the share of shuffled scores that do as well."""
    tau = X.kendall_tau(rows, ["held"], "model_id", "score", "rate").where("tau is not null").select("held", "tau")
    boot = X.kendall_tau(X.resampled(rows, ["held"], ["model_id"], draws), ["held", "rep"], "slot", "score", "rate").where("tau is not null")
    ends = boot.groupBy("held").agg(F.percentile("tau", F.lit(0.025)).alias("lo"), F.percentile("tau", F.lit(0.975)).alias("hi"), F.count(F.lit(1)).alias("n_bootstrap"))
    again = rows.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(permutations - 1))))
    w = Window.partitionBy("held", "rep")
    own = again.select("held", "rep", "model_id", "rate", F.row_number().over(w.orderBy("model_id")).alias("place"))
    other = again.select("held", "rep", "score", F.row_number().over(w.orderBy(X.draw(F.lit(7), "rep", "model_id"), "model_id")).alias("place"))
    shuffled = X.kendall_tau(own.join(other, ["held", "rep", "place"]), ["held", "rep"], "model_id", "score", "rate").where("tau is not null").withColumnRenamed("tau", "t")
    p = shuffled.join(F.broadcast(tau), "held").groupBy("held").agg(((1 + F.count_if(F.col("t") >= F.col("tau"))) / (1 + F.count(F.lit(1)))).alias("p"))
    out = tau.join(ends, "held", "left").join(p, "held", "left")
    return out.select("held", "tau", F.round("lo", 4).alias("lo"), F.round("hi", 4).alias("hi"), "n_bootstrap", F.round(F.coalesce("p", F.lit(1.0)), 4).alias("permutation_p"))


@query()
def sta9_transfer_resampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STA9's taus with intervals from 1,000 resamples of the models and p-values from 500 permutations."""
    return resampled_taus(G.kept(transfer(spark, sf_dir), "transfer"))


@query()
def sta10_metric_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentile intervals of each model's mean of each measure from 1,000 resamples of its tasks."""
    rows = long(observations(spark, sf_dir)).groupBy("model_id", "metric", "task_id").agg(F.avg("x").alias("x"))
    many = rows.groupBy("model_id", "metric").agg(F.count(F.lit(1)).alias("n")).where("n >= 5").drop("n")
    drawn = X.resampled(rows.join(many, ["model_id", "metric"], "left_semi"), ["model_id", "metric"], ["task_id"], 1000)
    means = drawn.groupBy("model_id", "metric", "rep").agg(F.avg("x").alias("m"))
    return means.groupBy("model_id", "metric").agg(F.round(F.percentile("m", F.lit(0.025)), 6).alias("lo"), F.round(F.percentile("m", F.lit(0.975)), 6).alias("hi"), F.round(F.stddev_samp("m"), 6).alias("se"))


@query(
    PRELUDE
    + """, cell AS (SELECT task_id, model_id, event, avg(x) AS m FROM long WHERE x IS NOT NULL GROUP BY ALL), above AS (SELECT *, m - avg(m) OVER (PARTITION BY task_id, event) AS d FROM cell),
units AS (SELECT task_id, row_number() OVER (ORDER BY task_id) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT task_id FROM runs)),
draws AS (SELECT rep, slot, ('0x' || substr(md5('7|' || rep || '|' || slot || '|0'), 1, 8))::BIGINT % (SELECT max(n) FROM units) AS i FROM (SELECT unnest(range(2000)) AS rep), (SELECT unnest(range((SELECT max(n) FROM units))) AS slot)),
m AS (SELECT model_id, event, rep, avg(d) AS s FROM draws JOIN units USING (i) JOIN above USING (task_id) GROUP BY ALL), l AS (SELECT model_id, event, list_sort(list(s)) AS xs FROM m GROUP BY ALL)
SELECT model_id, event, round(xs[(floor(len(xs) * 0.025))::INT + 1], 6) AS lo, round(xs[least((floor(len(xs) * 0.975))::INT + 1, len(xs))], 6) AS hi, len(xs)::BIGINT AS n_replicates FROM l"""
)
def sta11_supply_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two thousand resamples of the tasks; a task drawn twice counts twice."""
    land = Landscape(spark, sf_dir)
    cell = E.long_events(land.events).groupBy("task_id", "model_id", "event").agg(F.avg("x").alias("m"))
    above = G.kept(cell.select("task_id", "model_id", "event", (F.col("m") - F.avg("m").over(Window.partitionBy("task_id", "event"))).alias("d")), "supply-cells")
    units = land.runs.select("task_id").distinct().withColumn("all", F.lit(0))
    means = X.resampled(units, ["all"], ["task_id"], 2000).join(above.hint("merge"), "task_id").groupBy("model_id", "event", "rep").agg(F.avg("d").alias("s"))
    out = X.interval(means, ["model_id", "event"], "s", 2000)
    return out.select("model_id", "event", F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"), "n_replicates")


DEMAND = "CASE WHEN sum(resolved) FILTER ({e} IS NOT NULL) > 0 AND sum(1 - resolved) FILTER ({e} IS NOT NULL) > 0 THEN sum(resolved * {e}) / sum(resolved) FILTER ({e} IS NOT NULL) - sum((1 - resolved) * {e}) / sum(1 - resolved) FILTER ({e} IS NOT NULL) END"


@query(
    PRELUDE
    + """, units AS (SELECT *, row_number() OVER (PARTITION BY benchmark ORDER BY run_id) - 1 AS i, count(*) OVER (PARTITION BY benchmark) AS n FROM rollout),
draws AS (SELECT benchmark, rep, slot, ('0x' || substr(md5('7|' || rep || '|' || slot || '|' || benchmark), 1, 8))::BIGINT % n AS i FROM (SELECT benchmark, n, unnest(range(n)) AS slot FROM (SELECT DISTINCT benchmark, n FROM units)), (SELECT unnest(range(2000)) AS rep)),
drawn AS (SELECT benchmark, rep, """
    + ", ".join(f"{DEMAND.format(e=e)} AS {e}" for e in E.EVENTS)
    + """ FROM draws JOIN units USING (benchmark, i) GROUP BY ALL),
d AS ("""
    + " UNION ALL ".join(f"SELECT benchmark, '{e}' AS event, {e} AS v FROM drawn" for e in E.EVENTS)
    + """), l AS (SELECT benchmark, event, list_sort(list(v)) AS xs FROM d WHERE v IS NOT NULL GROUP BY ALL)
SELECT benchmark, event, round(xs[len(xs) // 2 + 1], 6) AS median, round(xs[floor(len(xs) * 0.025)::INT + 1], 6) AS lo, round(xs[floor(len(xs) * 0.975)::INT + 1], 6) AS hi, len(xs)::BIGINT AS n_replicates FROM l"""
)
def sta12_demand_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two thousand resamples of each benchmark's rollouts: what it demands of each event; a rollout without the event is left out of it."""
    rows = G.kept(Landscape(spark, sf_dir).events.select("benchmark", "run_id", "resolved", *E.EVENTS), "rollouts")
    names = [f"{what}_{e}" for e in E.EVENTS for what in ("good", "bad", "hit", "miss")]

    def terms(own: dict) -> dict:
        y, out = own["resolved"].astype(float), {}
        for e in E.EVENTS:
            x = own[e].astype(float)
            has = ~np.isnan(x)
            x = np.where(has, x, 0.0)
            out |= {f"good_{e}": has * y, f"bad_{e}": has * (1 - y), f"hit_{e}": y * x, f"miss_{e}": (1 - y) * x}
        return out

    def demand(e: str):
        good, bad, hit, miss = (F.col(f"{what}_{e}") for what in ("good", "bad", "hit", "miss"))
        return F.when((good > 0) & (bad > 0), hit / good - miss / bad)

    drawn = X.resampled_sums(rows, ["benchmark"], ["run_id"], ["resolved", *E.EVENTS], 2000, terms, names).select("benchmark", "rep", *[demand(e).alias(e) for e in E.EVENTS])
    d = drawn.select("benchmark", F.inline(F.array(*[F.struct(F.lit(e).alias("event"), F.col(e).alias("v")) for e in E.EVENTS]))).where("v is not null")
    return X.interval(d, ["benchmark", "event"], "v", 2000).select("benchmark", "event", F.round("mid", 6).alias("median"), F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"), "n_replicates")


@query()
def agg37_shared_and_own_graphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By task: variation of the decision committor on the shared graph, and of density on the models' own graphs, between models."""
    from .landscapes import gra12_model_graphs

    o = observations(spark, sf_dir).groupBy("task_id").agg((F.stddev_pop("committor_dp") / F.nullif(F.avg("committor_dp"), F.lit(0.0))).alias("cv_shared"))
    own = gra12_model_graphs(spark, sf_dir).groupBy("task_id").agg((F.stddev_pop("density") / F.nullif(F.avg("density"), F.lit(0.0))).alias("cv_own"))
    return o.join(own, "task_id").select("task_id", F.round("cv_shared", 6).alias("cv_shared"), F.round("cv_own", 6).alias("cv_own"), (F.col("cv_shared") > F.col("cv_own")).alias("shared_better"))


@query()
def sta19_t_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-sample t of the models' centred axes."""
    a = axes(observations(spark, sf_dir))
    pairs = F.inline(F.array(*[F.struct(F.lit(x).alias("axis"), F.col(f"c_{x}").alias("c")) for x in AXES]))
    return X.one_sample_t(a.select("model_id", pairs), ["model_id", "axis"], "c")


D = "(m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2))"


@query(f"SELECT event_type, round(CASE WHEN n1 >= 2 AND n2 >= 2 THEN {D} END, 6) AS d FROM (SELECT event_type, count(value) FILTER (user_id % 2 = 0) AS n1, count(value) FILTER (user_id % 2 <> 0) AS n2, avg(value) FILTER (user_id % 2 = 0) AS m1, avg(value) FILTER (user_id % 2 <> 0) AS m2, var_samp(value) FILTER (user_id % 2 = 0) AS v1, var_samp(value) FILTER (user_id % 2 <> 0) AS v2 FROM events GROUP BY ALL)")
def sta20_cohens_d(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("even", F.col("user_id") % 2 == 0)
    return X.cohens_d(e, ["event_type"], "even", "value")


@query(
    PRELUDE
    + """, c AS (SELECT task_id, block_id, event_id, row_number() OVER (PARTITION BY task_id, block_id ORDER BY md5('7|' || event_id || '|' || block_id), event_id) AS k, count(*) OVER (PARTITION BY task_id, block_id) AS n FROM member)
SELECT task_id, block_id, event_id, k FROM c WHERE k <= 2 * least(3, n // 2)"""
)
def sta21_stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to three pairs of steps of each block, by a hash (the sampler's own limit)."""
    w = Window.partitionBy("task_id", "block_id")
    h = F.md5(F.concat_ws("|", F.lit("7"), "event_id", "block_id"))
    m = Landscape(spark, sf_dir).members.withColumn("k", F.row_number().over(w.orderBy(h, "event_id"))).withColumn("n", F.count(F.lit(1)).over(w))
    return m.where(F.col("k") <= 2 * F.least(F.lit(3), F.floor(F.col("n") / 2))).select("task_id", "block_id", "event_id", "k")
