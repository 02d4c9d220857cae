"""Rollout events (access, trap, repair, gate value) and what models supply and tasks demand of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import CONFIG
from .sequences import RUN, repaired

EVENTS = ("access", "trap", "repair", "gate_value")


def rollout_events(compact: DataFrame, runs: DataFrame, masked: DataFrame, gates: DataFrame, laplace: float | Column = CONFIG.laplace) -> DataFrame:
    """One row a run: whether it is in a core, in a trap, in a core after a trap; and the mean smoothed outcome of the gates it visits.

    Blocks are those of the run's compacted primary sequence. ``gates`` is (task_id, block_id)."""
    flagged = compact.join(masked.select("task_id", "block_id", "is_core", "is_trap"), ["task_id", "block_id"], "left").fillna(False, ["is_core", "is_trap"])
    flags = flagged.groupBy(*RUN).agg(F.max(F.col("is_core").cast("int")).alias("access"), F.max(F.col("is_trap").cast("int")).alias("trap"))
    seen = compact.select(*RUN, "resolved", "block_id").distinct().join(gates, ["task_id", "block_id"], "left_semi")
    smooth = (F.sum("resolved") + laplace) / (F.count(F.lit(1)) + 2 * laplace)
    quality = seen.groupBy("task_id", "block_id").agg(smooth.alias("q"))
    value = seen.join(quality, ["task_id", "block_id"]).groupBy(*RUN).agg(F.avg("q").alias("gate_value"))
    out = runs.join(flags, RUN).join(repaired(flagged), RUN).join(value, RUN, "left")
    return out.select("benchmark", "task_id", "model_id", "run_id", "resolved", "access", "trap", F.col("repaired").alias("repair"), "gate_value", F.col("gate_value").isNotNull().alias("visited_gate"))


def long_events(events: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """One row for each run and event; nulls are left out."""
    pairs = F.array(*[F.struct(F.lit(e).alias("event"), F.col(e).cast("double").alias("x")) for e in EVENTS])
    return events.select(*by, "benchmark", "task_id", "model_id", "run_id", "resolved", F.inline(pairs)).where("x is not null")


def supply(long: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Mean over tasks of what a model's mean of an event is above the mean of the task's models."""
    cell = long.groupBy(*by, "benchmark", "task_id", "model_id", "event").agg(F.avg("x").alias("m"))
    above = cell.withColumn("d", F.col("m") - F.avg("m").over(Window.partitionBy(*by, "benchmark", "task_id", "event")))
    return above.groupBy(*by, "model_id", "event").agg(F.round(F.avg("d"), 6).alias("supply"), F.count(F.lit(1)).alias("n_tasks"))


def demand(long: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Outcome-weighted mean of an event less its mean weighted by failure; null where either weighs nothing."""
    y, x = F.col("resolved"), F.col("x")
    good, bad = F.sum(y), F.sum(1 - y)
    value = F.when((good > 0) & (bad > 0), F.sum(y * x) / good - F.sum((1 - y) * x) / bad)
    return long.groupBy(*by, "benchmark", "event").agg(F.round(value, 6).alias("demand"))


def swept(compact: DataFrame, runs: DataFrame, field: DataFrame, gates: DataFrame, parameters: DataFrame) -> DataFrame:
    """Events of each row (core_q, trap_q, laplace) of ``parameters``, in one plan.

    The quantiles of all settings come from one pass over the field as arrays; only (block, setting) rows are made."""
    up, down = F.when(F.col("field") > 0, F.col("field")), F.when(F.col("field") < 0, F.col("field"))
    by = field.groupBy("task_id").agg(F.count(up).alias("n_up"), F.count(down).alias("n_down"), F.array_sort(F.collect_list(up)).alias("ups"), F.array_sort(F.collect_list(down)).alias("downs"))

    def quantile(values: str, q: str) -> Column:
        at = F.col(q) * (F.size(values) - 1)
        low = F.floor(at).cast("int")
        a, b = F.get(values, low), F.get(values, F.least(low + 1, F.size(values) - 1))
        return F.round(a + (b - a) * (at - low), 9)

    cuts = by.crossJoin(F.broadcast(parameters)).select("task_id", *parameters.columns, "n_up", "n_down", quantile("ups", "core_q").alias("core_at"), quantile("downs", "trap_q").alias("trap_at"))
    f = F.col("field")
    masked = field.join(cuts, "task_id").withColumn("is_core", (f > 0) & ((F.col("n_up") <= 3) | (f >= F.col("core_at")))).withColumn("is_trap", (f < 0) & ((F.col("n_down") <= 3) | (f <= F.col("trap_at"))))
    names = parameters.columns
    flagged = compact.select(*RUN, "cidx", "block_id").join(masked.select("task_id", "block_id", *names, "is_core", "is_trap"), ["task_id", "block_id"])
    first, last = F.min(F.when(F.col("is_trap"), F.col("cidx"))), F.max(F.when(F.col("is_core") & ~F.col("is_trap"), F.col("cidx")))
    flags = flagged.groupBy(*RUN, *names).agg(F.max(F.col("is_core").cast("int")).alias("access"), F.max(F.col("is_trap").cast("int")).alias("trap"), F.coalesce(first < last, F.lit(False)).cast("int").alias("repair"))
    seen = compact.select(*RUN, "resolved", "block_id").distinct().join(gates, ["task_id", "block_id"], "left_semi")
    counts = seen.withColumn("good", F.sum("resolved").over(Window.partitionBy("task_id", "block_id"))).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("task_id", "block_id")))
    value = counts.crossJoin(F.broadcast(parameters.select("laplace").distinct())).groupBy(*RUN, "laplace").agg(F.avg((F.col("good") + F.col("laplace")) / (F.col("n") + 2 * F.col("laplace"))).alias("gate_value"))
    return runs.join(flags, RUN).join(value, [*RUN, "laplace"], "left")
