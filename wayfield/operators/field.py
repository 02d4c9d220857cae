"""Reward field: seed from outcomes, diffusion over the block graph, core and trap masks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import CONFIG
from .sequences import RUN, transitions


def shrinkage(n: Column, total: Column, exponent: float = CONFIG.shrink) -> Column:
    return F.when(total > 0, F.pow(F.least(F.greatest(n / total, F.lit(0.0)), F.lit(1.0)), F.lit(exponent))).otherwise(0.0)


def runs_of(steps: DataFrame) -> DataFrame:
    return steps.select("benchmark", "task_id", "model_id", "run_id", "resolved").distinct()


def seeds(visits: DataFrame, runs: DataFrame, least: int = CONFIG.least_runs) -> DataFrame:
    """(task_id, block_id, n_visit, seed): the visitors' resolved rate above the task's, shrunk; 0 where too few or too many runs visit."""
    base = runs.groupBy("task_id").agg(F.count(F.lit(1)).alias("n_total"), F.avg("resolved").alias("base"))
    by = visits.groupBy("task_id", "block_id").agg(F.count(F.lit(1)).alias("n_visit"), F.sum("resolved").alias("n_good"))
    n, total = F.col("n_visit"), F.col("n_total")
    seed = F.when((n < least) | (n > total - least), 0.0).otherwise((F.col("n_good") / n - F.col("base")) * shrinkage(n, total))
    return by.join(base, "task_id").select("task_id", "block_id", "n_visit", "n_total", F.round(seed, 9).alias("seed"))


def seeds_without_one(visits: DataFrame, runs: DataFrame, least: int = CONFIG.least_runs) -> DataFrame:
    """The seed of each block as seen without run ``run_id``'s label; the shrinkage still counts all visitors."""
    every = runs.select("task_id", "run_id", F.col("resolved").alias("own"))
    base = runs.groupBy("task_id").agg(F.count(F.lit(1)).alias("n_total"), F.sum("resolved").alias("good_total"))
    by = visits.groupBy("task_id", "block_id").agg(F.count(F.lit(1)).alias("n_visit"), F.sum("resolved").alias("n_good"))
    seen = visits.select("task_id", "run_id", "block_id", F.lit(1).alias("seen"))
    rows = by.join(base, "task_id").join(every, "task_id").join(seen, ["task_id", "run_id", "block_id"], "left").fillna(0, ["seen"])
    n, total = F.col("n_visit"), F.col("n_total")
    left = n - F.col("seen")
    rate = F.when(left > 0, (F.col("n_good") - F.col("seen") * F.col("own")) / left).otherwise(0.0)
    rest = F.when(total > 1, (F.col("good_total") - F.col("own")) / (total - 1)).otherwise(0.0)
    seed = F.when((n < least) | (n > total - least), 0.0).otherwise((rate - rest) * shrinkage(n, total))
    return rows.select("task_id", "block_id", "run_id", F.round(seed, 9).alias("seed"))


def shared_step_edges(members: DataFrame) -> DataFrame:
    """Pairs of blocks that have a step in common: each step's blocks are gathered once, with no join of ``members`` with itself."""
    own = members.groupBy(*RUN, "step_idx").agg(F.collect_set("block_id").alias("blocks")).where(F.size("blocks") > 1)
    first = own.select("task_id", "blocks", F.explode("blocks").alias("a"))
    return first.select("task_id", "a", F.explode("blocks").alias("b")).where("a < b").distinct()


def block_graph(members: DataFrame, compact: DataFrame) -> DataFrame:
    """Undirected edges a < b between blocks that share a step or follow each other in a run."""
    follow = transitions(compact).where("src <> dst").select("task_id", F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"))
    return shared_step_edges(members).union(follow).distinct()


def transition_weights(blocks: DataFrame, edges: DataFrame) -> DataFrame:
    """Row-normalised (task_id, a, b, p): each block itself and its neighbours, all alike."""
    loops = blocks.select("task_id", F.col("block_id").alias("a"), F.col("block_id").alias("b"))
    both = loops.union(edges.select("task_id", "a", "b")).union(edges.select("task_id", F.col("b"), F.col("a")))
    return both.withColumn("p", 1 / F.count(F.lit(1)).over(Window.partitionBy("task_id", "a")))


def spread(seed: np.ndarray, a: np.ndarray, b: np.ndarray, alpha: float, rounds: int) -> np.ndarray:
    """``rounds`` times f <- alpha seed + (1 - alpha) mean of f over a block and its neighbours; then scaled to a greatest size of 1."""
    n = len(seed)
    src, dst = np.concatenate([np.arange(n), a, b]), np.concatenate([np.arange(n), b, a])
    degree = np.bincount(src, minlength=n)
    f = seed.copy()
    for _ in range(rounds):
        f = alpha * seed + (1 - alpha) * np.bincount(src, f[dst], n) / degree
    most = np.abs(f).max(initial=0.0)
    return f / most if most > 1e-12 else f


def diffused(seeded: DataFrame, edges: DataFrame, alpha: float = CONFIG.propagation, rounds: int = CONFIG.rounds) -> DataFrame:
    """(task_id, block_id, field): a task's blocks and edges are one group."""

    def run(nodes: pa.Table, links: pa.Table) -> pa.Table:
        if not nodes.num_rows:
            return pa.table({"task_id": pa.array([], pa.int64()), "block_id": pa.array([], pa.int64()), "field": pa.array([], pa.float64())})
        ids = np.asarray(nodes["block_id"])
        order = np.argsort(ids)
        ids, seed = ids[order], np.asarray(nodes["seed"])[order]
        a, b = (np.searchsorted(ids, np.asarray(links[c])) for c in ("a", "b"))
        f = spread(seed, a, b, alpha, rounds)
        return pa.table({"task_id": pa.array(np.full(len(ids), nodes["task_id"][0].as_py())), "block_id": pa.array(ids), "field": pa.array(np.round(f, 9) + 0.0)})

    left = seeded.select(F.col("task_id").cast("long"), F.col("block_id").cast("long"), "seed").groupBy("task_id")
    right = edges.select(F.col("task_id").cast("long").alias("task_id"), F.col("a").cast("long"), F.col("b").cast("long")).groupBy("task_id")
    return left.cogroup(right).applyInArrow(run, "task_id long, block_id long, field double")


def masks(field: DataFrame, core: float | Column = CONFIG.core_quantile, trap: float | Column = CONFIG.trap_quantile, by: tuple[str, ...] = ("task_id",)) -> DataFrame:
    """field with is_core and is_trap: the outer quantiles of the positive and of the negative values; all of them where there are three at most."""
    w = Window.partitionBy(*by)
    up, down = F.when(F.col("field") > 0, F.col("field")), F.when(F.col("field") < 0, F.col("field"))
    q = lambda x, p: F.round(F.percentile(x, p).over(w), 9)
    is_core = (F.col("field") > 0) & ((F.count(up).over(w) <= 3) | (F.col("field") >= q(up, core)))
    is_trap = (F.col("field") < 0) & ((F.count(down).over(w) <= 3) | (F.col("field") <= q(down, trap)))
    return field.withColumn("is_core", F.coalesce(is_core, F.lit(False))).withColumn("is_trap", F.coalesce(is_trap, F.lit(False)))
