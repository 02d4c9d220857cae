"""Queries over trap libraries, trigger replay and sweeps, live detection and event-time windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import detector as D
from ..operators import graph as G
from ..operators import similarity as Y
from ..streaming import trigger as R
from .adapters import PRELUDE, Landscape, key_sets, table
from .register import query


class Libraries:
    """Key sets of steps in trap, core and other blocks; the similarity of every step to the first two."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        land = Landscape(spark, sf_dir)
        keys = key_sets(spark, sf_dir)
        marks = land.ordered.select("event_id", "task_id", "block_id").join(land.masked.select("task_id", "block_id", "is_core", "is_trap"), ["task_id", "block_id"], "left").fillna(False, ["is_core", "is_trap"])
        self.steps = G.kept(keys.join(marks.select("event_id", "is_core", "is_trap"), "event_id"), "marked-steps")
        trap, core, other = D.libraries(self.steps.where("is_trap"), self.steps.where("is_core"), self.steps.where("not is_core and not is_trap"))
        self.trap, self.core, self.other = (G.kept(D.numbered(x), "library") for x in (trap, core, other))


LOG = """, lg AS (SELECT run_id, step_idx AS step, CASE WHEN k = 99 THEN 'submit' WHEN action = 'submit' THEN 'edit' WHEN action = 'other' AND k % 2 = 0 THEN 'test' ELSE action END AS intent,
  tool = 'error' AS hard, (k % 50) / 100.0::DOUBLE AS sim_detect, (k % 50) / 100.0::DOUBLE AS sim_trap, (k % 37) / 100.0::DOUBLE AS sim_core, k % 50 >= 35 AND k % 50 - k % 37 >= 3 AS is_trap, CASE WHEN run_id % 2 = 0 THEN 'own' ELSE 'shuffled' END AS source FROM steps)"""


def log_of(steps: DataFrame) -> DataFrame:
    k, action = F.col("k"), F.col("action")
    intent = F.when(k == 99, "submit").when(action == "submit", "edit").when((action == "other") & (k % 2 == 0), "test").otherwise(action)
    return steps.select(
        "run_id", F.col("step_idx").alias("step"), intent.alias("intent"), (F.col("tool") == "error").alias("hard"), ((k % 50) / 100.0).alias("sim_detect"), ((k % 50) / 100.0).alias("sim_trap"), ((k % 37) / 100.0).alias("sim_core"),
        ((k % 50 >= 35) & (k % 50 - k % 37 >= 3)).alias("is_trap"), F.when(F.col("run_id") % 2 == 0, "own").otherwise("shuffled").alias("source"),
    )


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_of(Landscape(spark, sf_dir).steps)


MARKED = """, mk AS (SELECT k.*, coalesce(m.is_core, false) AS is_core, coalesce(m.is_trap, false) AS is_trap FROM keyed k JOIN ordered o USING (event_id) LEFT JOIN masked m ON m.task_id = o.task_id AND m.block_id = o.block_id),
ex AS (SELECT *, array_to_string(list_sort(list_filter(keys, lambda x: NOT starts_with(x, 'PHASE:') AND x <> 'ACTION:other')), chr(1)) AS sig FROM mk),
tr AS (SELECT sig, count(*) AS n_raw, string_agg(DISTINCT task_id, ',' ORDER BY task_id) AS task_ids, string_agg(DISTINCT tool, ',' ORDER BY tool) AS tool_names FROM ex WHERE is_trap AND sig <> '' GROUP BY sig),
co AS (SELECT DISTINCT sig FROM ex WHERE is_core AND sig <> '')"""


@query(PRELUDE + MARKED + " SELECT replace(sig, chr(1), ' ') AS sig, n_raw, task_ids, tool_names, row_number() OVER (ORDER BY sig) - 1 AS lib_idx FROM tr WHERE sig NOT IN (SELECT sig FROM co)")
def agg31_trap_library(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG31, KEY16 and JOI11."""
    t = Libraries(spark, sf_dir).trap
    return t.select(F.translate("sig", "\u0001", " ").alias("sig"), "n_raw", F.concat_ws(",", F.col("task_ids").cast("array<string>")).alias("task_ids"), F.concat_ws(",", "tool_names").alias("tool_names"), "lib_idx")


@query()
def joi3_library_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOI3 and SIM6: every step against the trap library; distinct key sets are compared once. Tests hold it against all pairs."""
    lib = Libraries(spark, sf_dir)
    sets = G.kept(lib.steps.select(F.array_sort("keys").alias("keys")).distinct().withColumn("id", F.xxhash64(F.concat_ws("\u0001", "keys"))), "key-sets")
    weights = Y.idf(lib.steps.select(F.lit(0).alias("all"), "keys"), ("all",)).select("key", "idf")
    found = Y.library_similarity(sets, lib.trap.select("lib_idx", F.col("detection_keys").alias("keys")), weights, "sim_trap")
    return lib.steps.select("event_id", F.xxhash64(F.concat_ws("\u0001", F.array_sort("keys"))).alias("id")).join(found, "id").select("event_id", F.round("sim_trap", 6).alias("sim_trap"), "sim_trap_idx")


@query()
def sta22_shuffled_library(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many other entries as there are traps, the first by a hash (the operator's own limit)."""
    lib = Libraries(spark, sf_dir)
    return D.shuffled_match(lib.other, lib.trap.count()).select("sig", "n_raw")


BEFORE = LOG + """, sub AS (SELECT *, row_number() OVER w - 1 AS idx, max((intent = 'submit')::INT) OVER w AS over, max(hard::INT) OVER (w ROWS BETWEEN 0 PRECEDING AND CURRENT ROW) > 0 AS r1, max(hard::INT) OVER (w ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) > 0 AS r2,
  max(hard::INT) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) > 0 AS r3 FROM lg WINDOW w AS (PARTITION BY run_id ORDER BY step)),
live AS (SELECT * FROM sub WHERE over = 0)"""
GRID = """, th(threshold, a) AS (VALUES (0.25::DOUBLE, 0), (0.3::DOUBLE, 1), (0.35::DOUBLE, 2), (0.4::DOUBLE, 3), (0.45::DOUBLE, 4)), it(intents, d) AS (VALUES (NULL, 0), (['edit', 'submit'], 1), (['edit', 'submit', 'test'], 2)),
cells AS (SELECT a * 24 + b * 6 + c * 3 + d AS cell, threshold, b AS lookback, c = 1 AS at_step, intents FROM th, (SELECT unnest(range(4)) AS b), (SELECT unnest(range(2)) AS c), it),
fires AS (
  SELECT cell, run_id, arg_min({'source': source, 'step': step, 'hard': hard, 'r': CASE WHEN lookback <= 1 THEN r1 WHEN lookback = 2 THEN r2 ELSE r3 END, 'is_trap': is_trap, 'intent': intent}, idx) AS f FROM live, cells
  WHERE idx >= 2 AND sim_detect >= threshold AND (lookback = 0 OR CASE lookback WHEN 1 THEN r1 WHEN 2 THEN r2 ELSE r3 END) AND (NOT at_step OR hard) AND (intents IS NULL OR list_contains(intents, intent)) GROUP BY ALL),
src AS (SELECT source, count(DISTINCT run_id) AS n_rollouts, count(*) AS n_obs_steps FROM lg GROUP BY ALL),
kp AS (SELECT cell, f.source AS source, count(*) AS n, round(avg(f.hard::INT), 4) AS hard_prec, round(avg(f.r::INT), 4) AS lookback_prec, round(avg(f.is_trap::INT), 4) AS trap_prec, round(avg(f.step), 2) AS mean_step FROM fires GROUP BY ALL),
kpis AS (SELECT c.cell, s.source, n_rollouts, n_obs_steps, coalesce(n, 0) AS n_with_fire, hard_prec, lookback_prec, trap_prec, mean_step, round(coalesce(n, 0) / n_rollouts, 4) AS fire_rate, round(coalesce(n, 0) / n_obs_steps, 4) AS fire_rate_step
  FROM cells c CROSS JOIN src s LEFT JOIN kp ON kp.cell = c.cell AND kp.source = s.source)"""


@query(PRELUDE + BEFORE + GRID + " SELECT * FROM kpis")
def agg33_detector_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG33, AGG35, WIN10 and STR3 with one trigger: 120 settings by source."""
    return D.kpis(log(spark, sf_dir), D.grid(spark))


@query(
    PRELUDE
    + BEFORE
    + GRID
    + """, ab AS (SELECT a.cell, a.fire_rate, a.hard_prec, CASE WHEN b.fire_rate > 0 THEN round(a.fire_rate / b.fire_rate, 3) END AS parity FROM kpis a JOIN kpis b ON a.cell = b.cell AND a.source = 'own' AND b.source = 'shuffled')
SELECT *, coalesce(fire_rate BETWEEN 0.2 AND 0.5 AND hard_prec >= 0.5 AND parity BETWEEN 0.5 AND 2, false) AS passes FROM ab"""
)
def fil7_selection_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.passing(D.kpis(log(spark, sf_dir), D.grid(spark)))


@query(PRELUDE + BEFORE + GRID + " SELECT cell, f.intent AS intent, count(*) AS n FROM fires GROUP BY ALL")
def agg33_intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.intent_distribution(log(spark, sf_dir), D.grid(spark)).select("cell", F.explode("intents").alias("intent", "n"))


@query(
    PRELUDE
    + BEFORE
    + """, el AS MATERIALIZED (SELECT run_id, idx FROM live WHERE idx >= 2 AND sim_detect >= 0.35),
fire(run_id, n, idx) AS (SELECT run_id, 1, min(idx) FROM el GROUP BY run_id UNION ALL SELECT e.run_id, f.n + 1, min(e.idx) FROM fire f JOIN el e ON e.run_id = f.run_id AND e.idx > f.idx + 4 WHERE f.n < 3 GROUP BY e.run_id, f.n)
SELECT run_id, n, idx FROM fire"""
)
def str3_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.replay(log(spark, sf_dir))


@query(
    PRELUDE
    + LOG
    + """, fo AS (SELECT *, sim_detect >= 0.35 AS fired, list(intent) OVER (PARTITION BY run_id ORDER BY step ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING) AS nxt FROM lg)
SELECT run_id, count(*) AS n_triggers, round(avg(coalesce(list_contains(nxt, 'test'), false)::INT), 4) AS frac_test, round(avg(coalesce(list_contains(nxt, 'read'), false)::INT), 4) AS frac_read, round(avg(coalesce(list_contains(nxt, 'edit'), false)::INT), 4) AS frac_edit,
  round(avg(coalesce(list_contains(nxt, 'submit'), false)::INT), 4) AS frac_submit FROM fo WHERE fired GROUP BY run_id"""
)
def win9_follow_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.follow_up(log(spark, sf_dir).withColumn("fired", F.col("sim_detect") >= 0.35))


@query(
    PRELUDE
    + BEFORE
    + """, el AS MATERIALIZED (SELECT run_id, idx FROM live WHERE idx >= 2 AND sim_detect >= 0.35),
fire(run_id, n, idx) AS (SELECT run_id, 1, min(idx) FROM el GROUP BY run_id UNION ALL SELECT e.run_id, f.n + 1, min(e.idx) FROM fire f JOIN el e ON e.run_id = f.run_id AND e.idx > f.idx + 4 WHERE f.n < 3 GROUP BY e.run_id, f.n)
SELECT run_id, idx AS step, n AS n_triggers FROM fire"""
)
def str1_live_trigger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR1 and STR2 on the bounded log; the streaming form has the same judge, and tests hold one against the other."""
    return R.detect_batch(log(spark, sf_dir), R.Settings(most=3)).where("fired").select("run_id", "step", "n_triggers")


@query("SELECT time_bucket(INTERVAL '1 day', ts) AS start, time_bucket(INTERVAL '1 day', ts) + INTERVAL '1 day' AS end, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL")
def ext_tumbling_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Not in the reference: event-time windows with a watermark, as a stream or in batch."""
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    w = R.windowed(e, "ts", "1 day", by=("event_type",))
    return w.select(F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "event_type", "n", F.round("total", 2).alias("total"))


@query(
    """WITH g AS (SELECT *, (lag(ts) OVER w IS NULL OR ts >= lag(ts) OVER w + INTERVAL '6 hours')::INT AS new FROM events WHERE user_id IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM g)
SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, session"""
)
def ext_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Not in the reference: sessions that a pause of six hours ends."""
    e = table(spark, sf_dir, "events").where("user_id is not null").withColumn("ts", F.col("ts").cast("timestamp"))
    return R.sessions(e, "ts", "6 hours", ("user_id",)).select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")
