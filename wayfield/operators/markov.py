"""Typed-state Markov chains: smoothed kernels, committor, passage times, hazards, edits of kernels.

Kernels are long tables (group, si, sj, p); only the linear solves are dense, in one Arrow kernel for each group, whose
size is the number of typed states (roles x phases x tags), not of data.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import CONFIG
from ..functions import keys as K
from .sequences import RUN, compacted, in_run

GOOD, BAD = "EOS_resolved", "EOS_failed"
ENDS = [GOOD, BAD]


def typed_sequences(ordered: DataFrame, roles: DataFrame, masked: DataFrame) -> DataFrame:
    """Compacted states role|phase|tag of each run; ``roles`` has every block, and by left joins ``ordered`` is never broadcast."""
    rows = ordered.join(roles.select("task_id", "block_id", "role"), ["task_id", "block_id"], "left").join(masked.select("task_id", "block_id", "is_core"), ["task_id", "block_id"], "left")
    rows = rows.withColumn("along", F.col("idx") / F.greatest(F.col("len") - 1, F.lit(1))).withColumn("phase", K.phase_of_state("along")).withColumn("tag", F.when(F.coalesce("is_core", F.lit(False)), "core").otherwise("outer"))
    return compacted(rows.withColumn("state", K.typed_code("role", "phase", "tag")), "state").select("benchmark", "task_id", "model_id", "run_id", "resolved", "cidx", "state")


def steps_of(typed: DataFrame, by: list[str]) -> DataFrame:
    """(by, run, si, sj): each move, the last one to the run's end."""
    end = F.when(F.col("resolved") == 1, GOOD).otherwise(BAD)
    return typed.select(*dict.fromkeys([*by, *RUN]), F.col("state").alias("si"), F.coalesce(F.lead("state").over(in_run("cidx")), end).alias("sj"))


def kernel(typed: DataFrame, by: list[str], laplace: float = CONFIG.laplace) -> DataFrame:
    """(by, si, sj, n, visits, p) over all states of the task and both ends; ends stay where they are."""
    moves = steps_of(typed, by)
    ends = typed.sparkSession.createDataFrame([(e,) for e in ENDS], "state string")
    states = typed.select("task_id", "state").distinct()
    states = states.union(states.select("task_id").distinct().crossJoin(F.broadcast(ends)))
    groups = typed.select(*by).distinct()
    rows = groups.join(states.withColumnRenamed("state", "si"), "task_id").join(states.withColumnRenamed("state", "sj"), "task_id")
    counts = moves.groupBy(*by, "si", "sj").agg(F.count(F.lit(1)).alias("n"))
    row = Window.partitionBy(*by, "si")
    full = rows.join(counts, [*by, "si", "sj"], "left").fillna(0, ["n"]).withColumn("visits", F.sum("n").over(row)).withColumn("size", F.count(F.lit(1)).over(row))
    p = F.when(F.col("si").isin(ENDS), (F.col("si") == F.col("sj")).cast("double")).otherwise((F.col("n") + laplace) / (F.col("visits") + laplace * F.col("size")))
    return full.select(*by, "si", "sj", "n", "visits", p.alias("p"))


def solve(p: np.ndarray, states: list[str], passages: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(committor, mean first passage time to a core) by state; NaN where there is none, and for passages that aren't asked for."""
    n = len(states)
    index = {s: k for k, s in enumerate(states)}
    good, bad = index.get(GOOD), index.get(BAD)

    def solved(free: np.ndarray, right: np.ndarray) -> np.ndarray:
        try:
            return np.linalg.solve(np.eye(len(free)) - p[np.ix_(free, free)], right)
        except np.linalg.LinAlgError:
            return np.full(len(free), np.nan)

    reach, passage = np.full(n, np.nan), np.full(n, np.nan)
    free = np.array([k for k in range(n) if k not in (good, bad)], np.int64)
    if good is not None:
        reach[good] = 1
        if len(free):
            reach[free] = solved(free, p[free, good])
    if bad is not None:
        reach[bad] = 0
    core = [k for k, s in enumerate(states) if s.endswith("|core")]
    if core and passages:
        free = np.array([k for k in free if k not in core], np.int64)
        passage[core] = 0
        if len(free):
            passage[free] = solved(free, np.ones(len(free)))
    return reach, passage


def dense(group: pa.Table) -> tuple[np.ndarray, list[str]]:
    si, sj = group["si"].to_pylist(), group["sj"].to_pylist()
    states = sorted(set(si))
    index = {s: k for k, s in enumerate(states)}
    p = np.zeros((len(states), len(states)))
    p[[index[s] for s in si], [index[s] for s in sj]] = np.asarray(group["p"])
    return p, states


def solutions(kernels: DataFrame, by: list[str]) -> DataFrame:
    """(by, state, committor, mfpt): by one dense solve for each group."""

    def run(group: pa.Table) -> pa.Table:
        p, states = dense(group)
        reach, passage = solve(p, states)
        out = {c: pa.array([group[c][0].as_py()] * len(states), group.schema.field(c).type) for c in by}
        null = lambda x: pa.array(np.round(x, 9) + 0.0, mask=~np.isfinite(x))
        return pa.table({**out, "state": pa.array(states), "committor": null(reach), "mfpt": null(passage)})

    types = dict(kernels.dtypes)
    return kernels.select(*by, "si", "sj", "p").groupBy(*by).applyInArrow(run, ", ".join(f"{c} {types[c]}" for c in by) + ", state string, committor double, mfpt double")


def power3(kernels: DataFrame, by: list[str], from_states, to_states) -> DataFrame:
    """(by, si, p3): chance to be in ``to_states`` three steps on, by state of ``from_states`` (SQL conditions on si and sj)."""
    rows = kernels.select(*by, "si", "sj", "p")
    reach = rows.where(to_states).groupBy(*by, "si").agg(F.sum("p").alias("r"))
    for _ in range(2):
        # a left join never broadcasts the kernel
        reach = rows.join(reach.select(*by, F.col("si").alias("sj"), "r"), [*by, "sj"], "left").groupBy(*by, "si").agg(F.sum(F.col("p") * F.col("r")).alias("r")).where("r is not null")
    return reach.where(from_states).withColumnRenamed("r", "p3")


IS_CORE, TO_CORE, TO_OUTER = "endswith(si, '|core')", "endswith(sj, '|core')", "endswith(sj, '|outer')"


def escape_hazard(kernels: DataFrame, by: list[str]) -> DataFrame:
    """(by, escape_hazard): chance to be outside three steps after a core state, by visits of the core states; null without visits."""
    visits = kernels.where(IS_CORE).select(*by, "si", "visits").distinct()
    p3 = power3(kernels, by, IS_CORE, TO_OUTER)
    return visits.join(p3, [*by, "si"]).groupBy(*by).agg((F.sum(F.col("visits") * F.col("p3")) / F.nullif(F.sum("visits"), F.lit(0))).alias("escape_hazard"))


def return_probability(kernels: DataFrame, by: list[str]) -> DataFrame:
    """(by, return_prob): mean chance, after each observed move out of a core, to be in a core three steps on."""
    p3 = power3(kernels, by, "true", TO_CORE)
    left = kernels.where(f"{IS_CORE} and not {TO_CORE} and n > 0").groupBy(*by, F.col("sj").alias("si")).agg(F.sum("n").alias("n"))
    return left.join(p3, [*by, "si"]).groupBy(*by).agg((F.sum(F.col("n") * F.col("p3")) / F.sum("n")).alias("return_prob"))


def total_variation(a: DataFrame, b: DataFrame, by: list[str]) -> DataFrame:
    """(by, tv): mean over states of half the sum of differences of two kernels over the same states."""
    joined = a.select(*by, "si", "sj", F.col("p").alias("pa")).join(b.select(*by, "si", "sj", F.col("p").alias("pb")), [*by, "si", "sj"])
    rows = joined.groupBy(*by, "si").agg((F.sum(F.abs(F.col("pa") - F.col("pb"))) / 2).alias("tv"))
    return rows.groupBy(*by).agg(F.avg("tv").alias("tv"))


def renormalised(rows: DataFrame, by: list[str], keep_empty: bool = True) -> DataFrame:
    """Rows (by, si, sj, p) whose p sum to 1 by state; a state that leads nowhere leads to itself."""
    total = F.sum("p").over(Window.partitionBy(*by, "si"))
    p = F.when(total > 1e-12, F.col("p") / total).otherwise((F.col("si") == F.col("sj")).cast("double"))
    return rows.withColumn("p", p if keep_empty else F.when(total > 1e-12, F.col("p") / total).otherwise(F.col("p")))


def without_edges(kernels: DataFrame, by: list[str], source, target) -> DataFrame:
    """Moves from ``source`` to ``target`` states are deleted."""
    return renormalised(kernels.withColumn("p", F.when(F.expr(f"{source} and {target}"), 0.0).otherwise(F.col("p"))), by)


def boosted(kernels: DataFrame, by: list[str], source, target, factor: float = 2.0) -> DataFrame:
    """Moves from ``source`` to ``target`` states become ``factor`` times as likely."""
    return renormalised(kernels.withColumn("p", F.when(F.expr(f"{source} and {target}"), F.col("p") * factor).otherwise(F.col("p"))), by, False)


def patched(weak: DataFrame, strong: DataFrame, by: list[str], source) -> DataFrame:
    """The rows of ``source`` states are the strong kernel's."""
    other = strong.select(*by, "si", "sj", F.col("p").alias("__strong"))
    return weak.join(other, [*by, "si", "sj"], "left").withColumn("p", F.when(F.expr(source), F.coalesce("__strong", "p")).otherwise(F.col("p"))).drop("__strong")


def successor(kernels: DataFrame, by: list[str], gamma: float = 0.9) -> DataFrame:
    """(by, si, sj, value): the inverse of I - gamma P."""

    def run(group: pa.Table) -> pa.Table:
        p, states = dense(group)
        inverse = np.linalg.inv(np.eye(len(states)) - gamma * p)
        n = len(states)
        out = {c: pa.array([group[c][0].as_py()] * (n * n), group.schema.field(c).type) for c in by}
        return pa.table({**out, "si": pa.array(np.repeat(states, n)), "sj": pa.array(states * n), "value": pa.array(inverse.ravel())})

    types = dict(kernels.dtypes)
    return kernels.select(*by, "si", "sj", "p").groupBy(*by).applyInArrow(run, ", ".join(f"{c} {types[c]}" for c in by) + ", si string, sj string, value double")


def matched_controls(kernels: DataFrame, by: list[str], targets: str, blocked: str, controls: int = 100, seed: int = 42) -> DataFrame:
    """(by, base, edited, delta, mean_control, p_value): what deleting the moves of ``targets`` states to ``blocked`` ones does to the
    mean committor of the decision states (of all states where there are none), against as many other states at random.

    ``targets`` and ``blocked`` are what the states' codes contain. Control r takes the states least by their numbers of a seeded stream."""

    def run(group: pa.Table) -> pa.Table:
        p, states = dense(group)
        inner = [k for k, s in enumerate(states) if s not in ENDS]
        own = [k for k in inner if targets in states[k]]
        to = [k for k in inner if blocked in states[k]]
        watched = [k for k in inner if "decision_point" in states[k]] or inner

        def value(rows) -> float:
            q = p.copy()
            for r in rows:
                q[r, to] = 0
                total = q[r].sum()
                q[r] = q[r] / total if total > 1e-12 else np.eye(len(states))[r]
            return float(np.nanmean(solve(q, states, False)[0][watched]))

        base, edited = value([]), value(own)
        rng = np.random.default_rng(seed)
        others = [k for k in inner if k not in own]
        deltas = [value(rng.permutation(others)[: len(own)]) - base for _ in range(controls)] if own and others else []
        p_value = (1 + sum(d >= edited - base for d in deltas)) / (1 + len(deltas)) if deltas else None
        out = {c: pa.array([group[c][0].as_py()], group.schema.field(c).type) for c in by}
        mean = float(np.mean(deltas)) if deltas else None
        return pa.table({**out, "base": [base], "edited": [edited], "delta": [edited - base], "mean_control": pa.array([mean], pa.float64()), "p_value": pa.array([p_value], pa.float64())})

    types = dict(kernels.dtypes)
    # a fixed number of parts: adaptive execution would merge them by their few bytes, not by the hundred solves of each group
    dealt = kernels.select(*by, "si", "sj", "p").repartition(8 * kernels.sparkSession.sparkContext.defaultParallelism, *by)
    return dealt.groupBy(*by).applyInArrow(run, ", ".join(f"{c} {types[c]}" for c in by) + ", base double, edited double, delta double, mean_control double, p_value double")
