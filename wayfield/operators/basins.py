"""Failure basins, recovery gates and their uplift."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import CONFIG
from .graph import components, kept
from .sequences import RUN


def fail_rates(visits: DataFrame) -> DataFrame:
    """(task_id, block_id, visitors, failed, fail_rate) by runs."""
    return visits.groupBy("task_id", "block_id").agg(F.count(F.lit(1)).alias("visitors"), F.sum(1 - F.col("resolved")).alias("failed"), F.avg(1 - F.col("resolved")).alias("fail_rate"))


def escape(out: Column, total: Column, steps: int = 3) -> Column:
    """Chance to leave within some steps; one half without a transition."""
    return F.when(total > 0, 1 - F.pow(1 - out / total, F.lit(steps))).otherwise(0.5)


def basin_blocks(rates: DataFrame, edges: DataFrame, seed: float = CONFIG.basin_fail_rate, expand: float = CONFIG.basin_expand_rate) -> DataFrame:
    """(task_id, block_id, basin_id): components of the blocks that fail often, of those that hold a block that fails more often still.

    Basins are numbered in the order of their least seed block."""
    open_blocks = rates.where(F.round("fail_rate", 9) >= expand).select("task_id", F.col("block_id").alias("node"), (F.round("fail_rate", 9) >= seed).alias("is_seed"))
    a, b = (open_blocks.select("task_id", F.col("node").alias(x)) for x in "ab")
    roots = components(open_blocks.select("task_id", "node"), edges.join(a, ["task_id", "a"]).join(b, ["task_id", "b"]).select("task_id", "a", "b"))
    by = roots.join(open_blocks, ["task_id", "node"])
    first = by.groupBy("task_id", "root").agg(F.min(F.when(F.col("is_seed"), F.col("node"))).alias("first")).where("first is not null")
    numbered = first.withColumn("basin_id", F.row_number().over(Window.partitionBy("task_id").orderBy("first")) - 1)
    return by.join(numbered, ["task_id", "root"]).select("task_id", F.col("node").alias("block_id"), "basin_id")


def basins(blocks: DataFrame, visits: DataFrame, moves: DataFrame, most_escape: float = CONFIG.most_escape) -> DataFrame:
    """One row a basin; a basin of up to two blocks that runs escape from easily is none."""
    seen = visits.join(blocks, ["task_id", "block_id"])
    rates = seen.groupBy("task_id", "basin_id").agg(
        F.array_sort(F.collect_set("block_id")).alias("block_ids"),
        F.avg(1 - F.col("resolved")).alias("fail_rate"),
        F.countDistinct("run_id").alias("n_trajectories"),
        F.countDistinct(F.when(F.col("resolved") == 0, F.col("run_id"))).alias("n_failed"),
    )
    inside = blocks.select("task_id", F.col("block_id").alias("dst"), F.col("basin_id").alias("into"))
    leaving = moves.join(blocks.select("task_id", F.col("block_id").alias("src"), "basin_id"), ["task_id", "src"]).join(inside, ["task_id", "dst"], "left")
    out = leaving.groupBy("task_id", "basin_id").agg(F.sum("n").alias("total"), F.sum(F.when(F.col("into").isNull() | (F.col("into") != F.col("basin_id")), F.col("n")).otherwise(0)).alias("out"))
    joined = rates.join(out, ["task_id", "basin_id"], "left").withColumn("n_blocks", F.size("block_ids")).withColumn("escape_prob", escape(F.coalesce("out", F.lit(0)), F.coalesce("total", F.lit(0))))
    kept_rows = joined.where(~((F.round("escape_prob", 9) > most_escape) & (F.col("n_blocks") <= 2)))
    return kept_rows.select("task_id", "basin_id", "block_ids", "n_blocks", "fail_rate", "escape_prob", "n_trajectories", "n_failed", (F.round("escape_prob", 9) < 0.15).alias("is_sticky"))


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("task_id", "a", "b").union(edges.select("task_id", F.col("b"), F.col("a")))


def candidate_gates(edges: DataFrame, basin: DataFrame, core: DataFrame, cut: DataFrame | None = None) -> DataFrame:
    """(task_id, block_id) outside the basins, next to one, and in or next to a core; or a cut block next to one."""
    both = both_ways(edges)
    next_to = lambda blocks: both.join(blocks.select("task_id", F.col("block_id").alias("b")).distinct(), ["task_id", "b"], "left_semi").select("task_id", F.col("a").alias("block_id"))
    beside = kept(next_to(basin).join(basin.select("task_id", "block_id"), ["task_id", "block_id"], "left_anti").distinct(), "beside-basins")
    near_core = next_to(core).union(core.select("task_id", "block_id")).distinct()
    out = beside.join(near_core, ["task_id", "block_id"], "left_semi")
    return out.union(beside.join(cut, ["task_id", "block_id"], "left_semi")).distinct() if cut is not None else out


def after_entry(members: DataFrame, primary: DataFrame, basin: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(runs that enter a basin, (run, block) that such a run's primary sequence holds at its entry or later)."""
    entry = members.join(basin.select("task_id", "block_id").distinct(), ["task_id", "block_id"], "left_semi").groupBy(*RUN, "resolved").agg(F.min("step_idx").alias("entry"))
    later = primary.join(entry.select(*RUN, "entry"), RUN).where(F.col("step_idx") >= F.col("entry")).select(*RUN, "resolved", "block_id").distinct()
    return entry, later


def gates(candidates: DataFrame, edges: DataFrame, basin: DataFrame, core: DataFrame, members: DataFrame, primary: DataFrame, cut: DataFrame | None = None) -> DataFrame:
    """One row a gate: what it connects, and how much more often runs resolve that come to it after a basin."""
    entry, later = after_entry(members, primary, basin)
    total = entry.groupBy("task_id").agg(F.count(F.lit(1)).alias("n_in"), F.sum("resolved").alias("good_in"))
    seen = later.join(candidates, ["task_id", "block_id"]).groupBy("task_id", "block_id").agg(F.count(F.lit(1)).alias("n_with"), F.sum("resolved").alias("good_with"))
    both = both_ways(edges).withColumnRenamed("a", "block_id")
    to_basin = both.join(basin.select("task_id", F.col("block_id").alias("b"), "basin_id"), ["task_id", "b"]).groupBy("task_id", "block_id").agg(F.array_sort(F.collect_set("basin_id")).alias("connected_basins"))
    with_self = both.select("task_id", "block_id", "b").union(candidates.select("task_id", "block_id", F.col("block_id").alias("b")))
    to_core = with_self.join(core.select("task_id", F.col("block_id").alias("b")), ["task_id", "b"]).groupBy("task_id", "block_id").agg(F.array_sort(F.collect_set("b")).alias("connected_cores"))
    rows = candidates.join(total, "task_id").join(seen, ["task_id", "block_id"], "left").join(to_basin, ["task_id", "block_id"], "left").join(to_core, ["task_id", "block_id"], "left").fillna(0, ["n_with", "good_with"])
    without = F.col("n_in") - F.col("n_with")
    p_without = F.when(without > 0, (F.col("good_in") - F.col("good_with")) / without).otherwise(0.0)
    uplift = F.when(F.col("n_with") > 0, F.col("good_with") / F.col("n_with") - p_without).otherwise(0.0)
    rows = rows.withColumn("success_uplift", F.round(uplift, 4)).withColumn("gate_id", F.row_number().over(Window.partitionBy("task_id").orderBy("block_id")) - 1)
    rows = rows.join(cut.select("task_id", "block_id", F.lit(True).alias("is_articulation")), ["task_id", "block_id"], "left").fillna(False, ["is_articulation"]) if cut is not None else rows.withColumn("is_articulation", F.lit(False))
    empty = F.array().cast("array<bigint>")
    return rows.select(
        "task_id", "gate_id", "block_id", "is_articulation", F.coalesce(F.col("connected_basins").cast("array<bigint>"), empty).alias("connected_basins"),
        F.coalesce(F.col("connected_cores").cast("array<bigint>"), empty).alias("connected_cores"), "success_uplift", F.col("n_with").alias("n_visits_after_basin"), F.col("good_with").alias("n_resolved_after_basin"),
    )


def unordered_uplift(candidates: DataFrame, visits: DataFrame, basin: DataFrame) -> DataFrame:
    """(task_id, block_id, uplift) by visits in any order: resolved share of basin runs with the gate less that of those without."""
    into = visits.join(basin.select("task_id", "block_id").distinct(), ["task_id", "block_id"], "left_semi").select(*RUN, "resolved").distinct()
    total = into.groupBy("task_id").agg(F.count(F.lit(1)).alias("n"), F.sum("resolved").alias("good"))
    seen = visits.join(into.select(*RUN), RUN, "left_semi").join(candidates, ["task_id", "block_id"]).groupBy("task_id", "block_id").agg(F.count(F.lit(1)).alias("k"), F.sum("resolved").alias("g"))
    rows = candidates.join(total, "task_id").join(seen, ["task_id", "block_id"], "left").fillna(0, ["k", "g"])
    rest = F.when(F.col("n") > F.col("k"), (F.col("good") - F.col("g")) / (F.col("n") - F.col("k"))).otherwise(0.0)
    return rows.select("task_id", "block_id", F.round(F.when(F.col("k") > 0, F.col("g") / F.col("k") - rest).otherwise(0.0), 6).alias("uplift"))


def basin_summary(basin: DataFrame, gate: DataFrame, runs: DataFrame) -> DataFrame:
    """One row a task; means over no basin or no gate are null."""
    total = runs.groupBy("task_id").agg(F.sum(1 - F.col("resolved")).alias("failed"))
    e, up = F.round("escape_prob", 9), F.col("success_uplift")
    by = basin.groupBy("task_id").agg(
        F.count(F.lit(1)).alias("n_basins"),
        F.count_if(e <= 0.3).alias("n_sticky_basins"),
        F.count_if(e <= 0.15).alias("n_very_sticky_basins"),
        F.round(F.avg("fail_rate"), 4).alias("visit_weighted_fail_rate"),
        F.round(F.avg(F.col("n_failed") / F.col("n_trajectories")), 4).alias("trajectory_level_fail_rate"),
        F.round(F.avg("escape_prob"), 4).alias("mean_escape_prob"),
        F.sum("n_failed").alias("in_basins"),
    )
    g = gate.groupBy("task_id").agg(
        F.count(F.lit(1)).alias("n_gates"), F.round(F.avg(up), 4).alias("mean_uplift"), F.count_if(up > 0).alias("n_positive"), F.count_if((up >= 0.1) & (F.col("n_visits_after_basin") >= 3)).alias("n_significant")
    )
    counts = ["n_basins", "n_sticky_basins", "n_very_sticky_basins", "n_gates", "n_positive", "n_significant"]
    share = F.when(F.col("n_basins") > 0, F.round(F.col("in_basins") / F.greatest("failed", F.lit(1)), 4))
    return total.join(by, "task_id", "left").join(g, "task_id", "left").fillna(0, counts).withColumn("pct_failed_in_basins", share).drop("failed", "in_basins")
