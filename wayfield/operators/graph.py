"""Graphs of steps: articulation points, biconnected blocks, block-cut tree, block statistics and roles, components."""

from __future__ import annotations

import os
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .sequences import block_stats


def folder(spark: SparkSession, name: str) -> str:
    """A new folder under the cluster's shared checkpoint folder; without one, a local folder, but only where Spark itself runs on one machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "wayfield-checkpoints")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """Written to the cluster's shared folder and read again, so that plans stay short and survive a lost executor."""
    spark = df.sparkSession
    df.write.parquet(path := folder(spark, name))
    return spark.read.schema(df.schema).parquet(path)


def biconnected(nodes: int, edges: list[tuple[int, int]]) -> tuple[list[list[int]], set[int]]:
    """(blocks of two nodes or more, articulation points); blocks by size, the largest first, then by their nodes."""
    around: list[list[int]] = [[] for _ in range(nodes)]
    for k, (a, b) in enumerate(edges):
        around[a].append(k)
        around[b].append(k)
    seen, low = [0] * nodes, [0] * nodes
    clock, blocks, cut = 0, [], set()
    for root in range(nodes):
        if seen[root]:
            continue
        clock += 1
        seen[root] = low[root] = clock
        path, open_edges, branches = [(root, -1, iter(around[root]))], [], 0
        while path:
            v, by, rest = path[-1]
            for k in rest:
                if k == by:
                    continue
                w = sum(edges[k]) - v
                if not seen[w]:
                    clock += 1
                    seen[w] = low[w] = clock
                    open_edges.append(k)
                    path.append((w, k, iter(around[w])))
                    break
                if seen[w] < seen[v]:
                    open_edges.append(k)
                    low[v] = min(low[v], seen[w])
            else:
                path.pop()
                if not path:
                    continue
                u = path[-1][0]
                low[u] = min(low[u], low[v])
                if low[v] >= seen[u]:  # nothing below v reaches above u
                    if u == root:
                        branches += 1
                    if u != root or branches > 1:
                        cut.add(u)
                    block = set()
                    while True:
                        k = open_edges.pop()
                        block.update(edges[k])
                        if k == by:
                            break
                    blocks.append(sorted(block))
    return sorted(blocks, key=lambda b: (-len(b), b)), cut


def blocks_of(edges: DataFrame, a: str = "source", b: str = "target") -> DataFrame:
    """(task_id, block_id, node, is_cut, n_nodes): the blocks of each task's graph, one group a task."""

    def run(task: pa.Table) -> pa.Table:
        x, y = np.asarray(task[a]), np.asarray(task[b])
        ids, both = np.unique(np.concatenate([x, y]), return_inverse=True)
        pairs = sorted(set(map(tuple, np.sort(both.reshape(2, -1), axis=0).T.tolist())))
        blocks, cut = biconnected(len(ids), pairs)
        many = [len(k) for k in blocks]
        flat = np.array([v for k in blocks for v in k], np.int64)
        return pa.table(
            {
                "task_id": pa.array(np.full(len(flat), task["task_id"][0].as_py(), np.int64)),
                "block_id": pa.array(np.repeat(np.arange(len(blocks)), many)),
                "node": pa.array(ids[flat].astype(np.int64)),
                "is_cut": pa.array(np.isin(flat, list(cut))),
                "n_nodes": pa.array(np.repeat(np.array(many, np.int64), many)),
            }
        )

    own = edges.select(F.col("task_id").cast("long"), F.col(a).cast("long"), F.col(b).cast("long")).where(f"{a} <> {b}")
    return own.groupBy("task_id").applyInArrow(run, "task_id long, block_id long, node long, is_cut boolean, n_nodes long")


def block_cut_tree(block_nodes: DataFrame) -> DataFrame:
    """(task_id, block, cut): edges between blocks and articulation points."""
    cut = block_nodes.where("is_cut")
    return cut.select("task_id", F.concat(F.lit("block-"), "block_id").alias("block"), F.concat(F.lit("cut-"), "node").alias("cut"))


def adjacency(edges: DataFrame, a: str = "source", b: str = "target") -> DataFrame:
    """(task_id, node, neighbours), sorted."""
    both = edges.select("task_id", F.col(a).alias("node"), F.col(b).alias("other")).union(edges.select("task_id", F.col(b), F.col(a)))
    return both.groupBy("task_id", "node").agg(F.array_sort(F.collect_set("other")).alias("neighbours"))


def block_table(members: DataFrame, runs: DataFrame) -> DataFrame:
    """All statistics of each block of (task_id, block_id, run_id, step_idx, resolved, articulation)."""
    total = runs.groupBy("task_id").agg(F.count(F.lit(1)).alias("n_runs"))
    by = block_stats(members).withColumnRenamed("temporal_span", "median")
    return by.join(total, "task_id").select(
        "task_id", "block_id", "n_nodes",
        (F.col("n_nodes") == 2).alias("is_trivial"),
        F.round(F.col("n_unique_runs") / F.col("n_runs"), 4).alias("response_coverage"),
        "n_unique_runs",
        F.round("purity", 4).alias("resolved_purity"),
        F.when(F.col("good") > F.col("n_unique_runs") / 2, "resolved").otherwise("failed").alias("dominant_outcome"),
        F.round("median", 2).alias("temporal_span"),
        "min_pos", "max_pos", "has_articulation",
    )


def with_roles(blocks: DataFrame, steps: DataFrame) -> DataFrame:
    """blocks with ``role``; of each outcome only the largest success block keeps that role."""
    middle = steps.groupBy("task_id").agg(F.expr("percentile(step_idx, 0.5)").alias("q50"))
    early, large = F.col("temporal_span") <= F.col("q50"), F.col("n_nodes") >= 6
    role = (
        F.when((F.col("response_coverage") > 0.4) & large & early, "common_setup")
        .when(large & ~early & (F.col("resolved_purity") >= 0.6) & (F.col("n_unique_runs") >= 3), "success_outcome")
        .when(large & ~early, "weak_basin")
        .when((F.col("n_nodes") <= 5) & F.col("has_articulation"), "decision_point")
        .otherwise("intermediate")
    )
    first = F.row_number().over(Window.partitionBy("task_id", "dominant_outcome", "role").orderBy(F.desc("n_nodes"), "block_id"))
    out = blocks.join(middle, "task_id").withColumn("role", role).withColumn("place", first)
    return out.withColumn("role", F.when((F.col("role") == "success_outcome") & (F.col("place") > 1), "weak_basin").otherwise(F.col("role"))).drop("q50", "place")


def roots_of(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least node of each node's component, of nodes from 0 to n: labels hook to lesser ones and jump to their label's label."""
    root = np.arange(n)
    while True:
        x, y = root[a], root[b]
        if (x == y).all():
            return root
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]


def components(nodes: DataFrame, edges: DataFrame, by: str = "task_id") -> DataFrame:
    """(by, node, root): the least node of each node's component, of all ``nodes``; edges (by, a, b) within them.

    A group's graph is one group of an Arrow kernel, as in :func:`blocks_of`: some tens of bytes a node and an edge."""

    def run(own: pa.Table, links: pa.Table) -> pa.Table:
        ids = np.unique(own["node"].to_numpy())
        a, b = (np.searchsorted(ids, links[c].to_numpy()) for c in ("a", "b"))
        if not len(ids):
            return pa.table({by: pa.array([], pa.int64()), "node": ids, "root": ids})
        return pa.table({by: pa.array(np.full(len(ids), own[by][0].as_py(), np.int64)), "node": ids, "root": ids[roots_of(len(ids), a, b)]})

    left = nodes.select(F.col(by).cast("long"), F.col("node").cast("long"))
    right = edges.select(F.col(by).cast("long"), F.col("a").cast("long"), F.col("b").cast("long"))
    return left.groupBy(by).cogroup(right.groupBy(by)).applyInArrow(run, f"{by} long, node long, root long")


def clipped(value: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))
