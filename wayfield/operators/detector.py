"""Trap detector in batch: libraries of key sets, trigger replay over step logs, sweep of trigger settings, follow-up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import keys as K



def in_log():
    return Window.partitionBy("run_id").orderBy("step")


def signature(keys: str) -> Column:
    return F.concat_ws("\u0001", keys)


def examples(steps: DataFrame) -> DataFrame:
    """Library entries from steps (keys, task_id): one for each distinct detection signature, by signature."""
    own = steps.withColumn("detection_keys", F.array_sort(K.strip_generic("keys"))).where(F.size("detection_keys") > 0).withColumn("sig", signature("detection_keys"))
    tools = F.transform(F.filter("keys", lambda k: k.startswith("TOOL:")), lambda k: F.substring(k, 6, 1000))
    by = own.groupBy("sig").agg(
        F.min("keys").alias("keys"),
        F.first("detection_keys").alias("detection_keys"),
        F.array_sort(F.collect_set("task_id")).alias("task_ids"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(tools)))).alias("tool_names"),
        F.count(F.lit(1)).alias("n_raw"),
    )
    return by


def libraries(trap: DataFrame, core: DataFrame, other: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Without what is in two: trap and core lose their common signatures, other loses all of theirs."""
    t, c = examples(trap), examples(core)
    return t.join(c.select("sig"), "sig", "left_anti"), c.join(t.select("sig"), "sig", "left_anti"), examples(other).join(t.select("sig"), "sig", "left_anti").join(c.select("sig"), "sig", "left_anti")


def numbered(library: DataFrame) -> DataFrame:
    """The library with lib_idx in the order of signatures; it is as small as there are distinct key sets."""
    return library.withColumn("lib_idx", (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("sig")) - 1).cast("long"))


def shuffled_match(other: DataFrame, size: int, seed: int = 7) -> DataFrame:
    """As many entries as the trap library has, the first by a hash."""
    return other.orderBy(F.md5(F.concat(F.lit(f"{seed}|"), "sig")), "sig").limit(size)


def grid(spark: SparkSession) -> DataFrame:
    """120 settings: threshold, look-back, hard error at the step, allowed intents (null: all)."""
    sets = [None, ["edit", "submit"], ["edit", "submit", "test"]]
    rows = [(k, t, b, h, s) for k, (t, b, h, s) in enumerate((t, b, h, s) for t in (0.25, 0.3, 0.35, 0.4, 0.45) for b in (0, 1, 2, 3) for h in (False, True) for s in sets)]
    return spark.createDataFrame(rows, "cell int, threshold double, lookback int, at_step boolean, intents array<string>")


def before_submit(log: DataFrame) -> DataFrame:
    """The steps of each run before its first submission, with ``recent_k``: a hard error in the last k steps (k = 1, 2, 3)."""
    submitted = F.max((F.col("intent") == "submit").cast("int")).over(in_log().rowsBetween(Window.unboundedPreceding, 0))
    hard = F.col("hard").cast("int")
    out = log.withColumn("__over", submitted)
    for k in (1, 2, 3):
        out = out.withColumn(f"recent_{k}", F.max(hard).over(in_log().rowsBetween(1 - k, 0)) > 0)
    return out.withColumn("idx", F.row_number().over(in_log()) - 1).where(F.col("__over") == 0).drop("__over")


def eligible(log: DataFrame, cells: DataFrame, warmup: int = 2) -> DataFrame:
    """(log, cell): the steps after warm-up at which a setting's predicate holds."""
    recent = F.when(F.col("lookback") == 0, F.lit(True)).when(F.col("lookback") == 1, F.col("recent_1")).when(F.col("lookback") == 2, F.col("recent_2")).otherwise(F.col("recent_3"))
    holds = (F.col("sim_detect") >= F.col("threshold")) & recent & (~F.col("at_step") | F.col("hard")) & (F.col("intents").isNull() | F.array_contains("intents", F.col("intent")))
    return before_submit(log).where(F.col("idx") >= warmup).join(F.broadcast(cells), F.coalesce(holds, F.lit(False)))


def first_fires(log: DataFrame, cells: DataFrame, warmup: int = 2) -> DataFrame:
    """The one trigger of each run and setting, where there is one."""
    e = eligible(log, cells, warmup)
    columns = ["source", "idx", "step", "hard", "recent_1", "recent_2", "recent_3", "lookback", "is_trap", "intent"]
    return e.groupBy("cell", "run_id").agg(F.min_by(F.struct(*columns), "idx").alias("at")).select("cell", "run_id", "at.*")


def replay(log: DataFrame, threshold: float = 0.35, warmup: int = 2, cooldown: int = 4, most: int = 3) -> DataFrame:
    """(run_id, n, idx): triggers with a cool-down and a greatest number.

    One join for each allowed trigger: the next is the first eligible step more than ``cooldown`` steps after the last."""
    steps = before_submit(log).where((F.col("idx") >= warmup) & (F.col("sim_detect") >= threshold)).select("run_id", "idx")
    last = steps.groupBy("run_id").agg(F.min("idx").alias("idx")).withColumn("n", F.lit(1))
    out = last
    for n in range(2, most + 1):
        last = steps.join(last.select("run_id", F.col("idx").alias("before")), "run_id").where(F.col("idx") > F.col("before") + cooldown).groupBy("run_id").agg(F.min("idx").alias("idx")).withColumn("n", F.lit(n))
        out = out.unionByName(last)
    return out.select("run_id", "n", F.col("idx").cast("long").alias("idx"))


def kpis(log: DataFrame, cells: DataFrame, warmup: int = 2) -> DataFrame:
    """(cell, source, ...): how often a setting fires and how precisely."""
    sources = log.groupBy("source").agg(F.countDistinct("run_id").alias("n_rollouts"), F.count(F.lit(1)).alias("n_obs_steps"))
    recent = F.when(F.col("lookback") <= 1, F.col("recent_1")).when(F.col("lookback") == 2, F.col("recent_2")).otherwise(F.col("recent_3"))
    part = lambda c: F.round(F.avg(c.cast("int")), 4)
    by = first_fires(log, cells, warmup).groupBy("cell", "source").agg(
        F.count(F.lit(1)).alias("n_with_fire"),
        part(F.col("hard")).alias("hard_prec"),
        part(recent).alias("lookback_prec"),
        part(F.col("is_trap")).alias("trap_prec"),
        F.round(F.avg("step"), 2).alias("mean_step"),
    )
    rows = F.broadcast(cells.select("cell")).crossJoin(sources).join(by, ["cell", "source"], "left").fillna(0, ["n_with_fire"])
    return rows.withColumn("fire_rate", F.round(F.col("n_with_fire") / F.col("n_rollouts"), 4)).withColumn("fire_rate_step", F.round(F.col("n_with_fire") / F.col("n_obs_steps"), 4))


def intent_distribution(log: DataFrame, cells: DataFrame, warmup: int = 2) -> DataFrame:
    """(cell, intents): map of intent to fires, sorted by intent."""
    n = first_fires(log, cells, warmup).groupBy("cell", "intent").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("cell").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("intent", "n")))).alias("intents"))


def passing(kpi: DataFrame, own: str = "own", control: str = "shuffled") -> DataFrame:
    """(cell, fire_rate, hard_prec, parity, passes): settings by the selection rule, the best first."""
    a = kpi.where(F.col("source") == own).select("cell", "fire_rate", "hard_prec")
    b = kpi.where(F.col("source") == control).select("cell", F.col("fire_rate").alias("control_rate"))
    parity = F.when(F.col("control_rate") > 0, F.round(F.col("fire_rate") / F.col("control_rate"), 3))
    ok = F.col("fire_rate").between(0.2, 0.5) & (F.col("hard_prec") >= 0.5) & parity.between(0.5, 2.0)
    return a.join(b, "cell", "left").select("cell", "fire_rate", "hard_prec", parity.alias("parity"), F.coalesce(ok, F.lit(False)).alias("passes"))


def follow_up(log: DataFrame, fired: str = "fired", window: int = 2) -> DataFrame:
    """(run_id, n_triggers, share of triggers followed within ``window`` steps by a test, a read, an edit, a submission)."""
    after = in_log().rowsBetween(1, window)
    out = log
    for x in ("test", "read", "edit", "submit"):
        out = out.withColumn(f"then_{x}", F.coalesce(F.max((F.col("intent") == x).cast("int")).over(after), F.lit(0)))
    return out.where(fired).groupBy("run_id").agg(F.count(F.lit(1)).alias("n_triggers"), *[F.round(F.avg(f"then_{x}"), 4).alias(f"frac_{x}") for x in ("test", "read", "edit", "submit")])
