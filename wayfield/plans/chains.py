"""Queries over typed-state Markov chains."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators import markov as M
from .adapters import PRELUDE, Landscape
from .register import query

BY = ["task_id"]
GATE, BASIN_FROM, BASIN_TO = "contains(si, 'decision_point')", "contains(si, 'weak_basin')", "contains(sj, 'weak_basin')"


def kernel(spark: SparkSession, sf_dir: str, by: list[str] = BY) -> DataFrame:
    return M.kernel(Landscape(spark, sf_dir).typed, by)


@query(PRELUDE + "SELECT task_id, si, sj, n, visits, round(p, 6) AS p FROM kernel")
def mdp1_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kernel(spark, sf_dir).withColumn("p", F.round("p", 6))


@query()
def mdp2_committor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MDP2 and MDP3: committor and passage time of every state; tests hold them against simulation and by hand."""
    return M.solutions(kernel(spark, sf_dir), BY)


P3 = """, r1 AS (SELECT task_id, si, sum(p) AS r FROM kernel WHERE ends_with(sj, '{to}') GROUP BY ALL),
r2 AS (SELECT k.task_id, k.si, sum(p * r) AS r FROM kernel k JOIN r1 ON r1.task_id = k.task_id AND r1.si = k.sj GROUP BY ALL),
r3 AS (SELECT k.task_id, k.si, sum(p * r) AS r FROM kernel k JOIN r2 ON r2.task_id = k.task_id AND r2.si = k.sj GROUP BY ALL)"""


@query(PRELUDE + P3.format(to="|outer") + " SELECT task_id, round(sum(visits * r) / nullif(sum(visits), 0), 6) AS escape_hazard FROM (SELECT DISTINCT task_id, si, visits FROM kernel WHERE ends_with(si, '|core')) JOIN r3 USING (task_id, si) GROUP BY ALL")
def mdp4_escape_hazard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.escape_hazard(kernel(spark, sf_dir), BY).withColumn("escape_hazard", F.round("escape_hazard", 6))


@query(PRELUDE + P3.format(to="|core") + " SELECT k.task_id, round(sum(k.n * r) / sum(k.n), 6) AS return_prob FROM kernel k JOIN r3 ON r3.task_id = k.task_id AND r3.si = k.sj WHERE ends_with(k.si, '|core') AND NOT ends_with(k.sj, '|core') AND k.n > 0 GROUP BY ALL")
def mdp5_return_probability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.return_probability(kernel(spark, sf_dir), BY).withColumn("return_prob", F.round("return_prob", 6))


@query()
def mdp6_successor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.successor(kernel(spark, sf_dir), BY)


@query(
    PRELUDE
    + """, gm AS (SELECT r.task_id, r.resolved, t.si, t.sj, count(*) AS n FROM tmoves t JOIN runs r USING (task_id, run_id) GROUP BY ALL),
g AS (SELECT DISTINCT task_id, resolved FROM typed),
grid AS (SELECT g.task_id, g.resolved, a.state AS si, b.state AS sj FROM g JOIN tstates a ON g.task_id = a.task_id JOIN tstates b ON g.task_id = b.task_id),
cnt AS (SELECT grid.*, coalesce(gm.n, 0) AS n FROM grid LEFT JOIN gm USING (task_id, resolved, si, sj)),
ker AS (SELECT *, CASE WHEN starts_with(si, 'EOS_') THEN (si = sj)::INT::DOUBLE ELSE (n + 0.5) / (sum(n) OVER w + 0.5 * count(*) OVER w) END AS p FROM cnt WINDOW w AS (PARTITION BY task_id, resolved, si)),
rowsum AS (SELECT a.task_id, a.si, sum(abs(a.p - b.p)) / 2 AS tv FROM ker a JOIN ker b ON a.task_id = b.task_id AND a.si = b.si AND a.sj = b.sj AND a.resolved = 1 AND b.resolved = 0 GROUP BY ALL)
SELECT task_id, round(avg(tv), 6) AS tv FROM rowsum GROUP BY ALL"""
)
def mdp7_total_variation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Between the kernels of resolved and of failed runs."""
    both = kernel(spark, sf_dir, ["task_id", "resolved"])
    return M.total_variation(both.where("resolved = 1"), both.where("resolved = 0"), BY).withColumn("tv", F.round("tv", 6))


@query()
def mdp8_decision_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean committor of the decision states of each task and model."""
    by = ["task_id", "model_id"]
    return M.solutions(kernel(spark, sf_dir, by), by).where("contains(state, 'decision_point')").groupBy(*by).agg(F.round(F.avg("committor"), 6).alias("committor_dp"), F.count("committor").alias("n_states"))


EDITED = "CASE WHEN sum(q) OVER w > 1e-12 THEN q / sum(q) OVER w ELSE {empty} END"


@query(PRELUDE + ", e AS (SELECT *, CASE WHEN contains(si, 'decision_point') AND contains(sj, 'weak_basin') THEN 0 ELSE p END AS q FROM kernel) SELECT task_id, si, sj, round(" + EDITED.format(empty="(si = sj)::INT::DOUBLE") + ", 9) AS p FROM e WINDOW w AS (PARTITION BY task_id, si)")
def mdp10_deleted_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MDP9 and MDP10: moves from decision points into weak basins deleted."""
    return M.without_edges(kernel(spark, sf_dir), BY, GATE, BASIN_TO).select("task_id", "si", "sj", F.round("p", 9).alias("p"))


@query(PRELUDE + ", e AS (SELECT *, CASE WHEN contains(si, 'weak_basin') AND ends_with(sj, '|core') THEN p * 2 ELSE p END AS q FROM kernel) SELECT task_id, si, sj, round(" + EDITED.format(empty="q") + ", 9) AS p FROM e WINDOW w AS (PARTITION BY task_id, si)")
def mdp12_boosted_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.boosted(kernel(spark, sf_dir), BY, BASIN_FROM, M.TO_CORE).select("task_id", "si", "sj", F.round("p", 9).alias("p"))


@query()
def mdp11_patched_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model m0's decision rows replaced by model m1's, and the committor that follows."""
    both = kernel(spark, sf_dir, ["task_id", "model_id"])
    weak, strong = (both.where(f"model_id = '{m}'") for m in ("m0", "m1"))
    return M.solutions(M.patched(weak, strong, BY, GATE).drop("model_id"), BY)


@query()
def mdp13_matched_controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.matched_controls(kernel(spark, sf_dir), BY, "decision_point", "weak_basin")


class Dynamics:
    """Per task and model: rates, hazards and passage times (AGG38)."""

    BY = ["task_id", "model_id"]

    def __init__(self, spark: SparkSession, sf_dir: str, land: Landscape | None = None):
        self.land = land or Landscape(spark, sf_dir)

    def core_visits(self) -> DataFrame:
        """AGG20: share of the task's core blocks that the model's runs visit."""
        total = self.land.core.groupBy("task_id").agg(F.count(F.lit(1)).alias("n_core"))
        seen = self.land.ordered.join(self.land.core, ["task_id", "block_id"], "left_semi").groupBy(*self.BY).agg(F.countDistinct("block_id").alias("seen"))
        groups = self.land.runs.select("task_id", "model_id").distinct()
        return groups.join(total, "task_id", "left").join(seen, self.BY, "left").select(*self.BY, F.coalesce(F.col("seen") / F.col("n_core"), F.lit(0.0)).alias("core_visit_rate"))

    def basin_rates(self) -> DataFrame:
        """AGG21: share of runs in a trap block, and of those the share with another block too."""
        flagged = self.land.ordered.join(self.land.masked.select("task_id", "block_id", "is_trap"), ["task_id", "block_id"], "left").fillna(False, ["is_trap"])
        runs = flagged.groupBy(*self.BY, "run_id").agg(F.bool_or("is_trap").alias("inside"), F.bool_or(~F.col("is_trap")).alias("outside"))
        entry, both = F.col("inside").cast("int"), (F.col("inside") & F.col("outside")).cast("int")
        return runs.groupBy(*self.BY).agg(F.avg(entry).alias("basin_entry_rate"), (F.sum(both) / F.nullif(F.sum(entry), F.lit(0))).alias("basin_escape_rate"))

    def table(self) -> DataFrame:
        rates = self.land.runs.groupBy("benchmark", *self.BY).agg(F.count(F.lit(1)).alias("n_runs"), F.sum("resolved").alias("n_resolved"), F.avg("resolved").alias("resolve_rate"))
        k = G.kept(M.kernel(self.land.typed, self.BY), "kernel")  # read nine times below
        dp = F.col("state").contains("decision_point")
        means = M.solutions(k, self.BY).groupBy(*self.BY).agg(F.avg(F.when(dp, F.col("committor"))).alias("committor_dp"), F.avg(F.when(dp, F.col("mfpt"))).alias("mfpt_to_core"))
        out = rates
        for part in (self.core_visits(), self.basin_rates(), means, M.escape_hazard(k, self.BY), M.return_probability(k, self.BY)):
            out = out.join(part, self.BY, "left")
        return out


@query(
    PRELUDE
    + """, core AS (SELECT task_id, block_id FROM masked WHERE is_core), nc AS (SELECT task_id, count(*) AS n FROM core GROUP BY ALL),
s AS (SELECT o.task_id, o.model_id, count(DISTINCT o.block_id) AS seen FROM ordered o JOIN core USING (task_id, block_id) GROUP BY ALL)
SELECT g.task_id, g.model_id, round(coalesce(seen / n, 0), 6) AS core_visit_rate FROM (SELECT DISTINCT task_id, model_id FROM runs) g LEFT JOIN nc USING (task_id) LEFT JOIN s USING (task_id, model_id)"""
)
def agg20_core_visit_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Dynamics(spark, sf_dir).core_visits().withColumn("core_visit_rate", F.round("core_visit_rate", 6))


@query(
    PRELUDE
    + """, f AS (SELECT o.task_id, o.model_id, o.run_id, bool_or(coalesce(is_trap, false)) AS i, bool_or(NOT coalesce(is_trap, false)) AS e FROM ordered o LEFT JOIN masked USING (task_id, block_id) GROUP BY ALL)
SELECT task_id, model_id, round(avg(i::INT), 6) AS basin_entry_rate, round(sum((i AND e)::INT) / nullif(sum(i::INT), 0), 6) AS basin_escape_rate FROM f GROUP BY ALL"""
)
def agg21_basin_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Dynamics(spark, sf_dir).basin_rates().select("task_id", "model_id", F.round("basin_entry_rate", 6).alias("basin_entry_rate"), F.round("basin_escape_rate", 6).alias("basin_escape_rate"))


@query()
def agg38_dynamics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Dynamics(spark, sf_dir).table()
