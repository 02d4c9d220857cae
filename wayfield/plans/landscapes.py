"""Queries over the landscape: sequences, blocks, field, basins, gates, events, supply and demand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import basins as B
from ..operators import events as E
from ..operators import field as A
from ..operators import graph as G
from ..operators import sequences as S
from ..operators import similarity as Y
from .adapters import PRELUDE, Landscape, slices
from .register import query


def rounded(c: str, digits: int = 6):
    return F.round(c, digits).alias(c)


# sequences


@query(PRELUDE + "SELECT task_id, run_id, step_idx, idx, len, round(idx / greatest(len - 1, 1), 9) AS along FROM (SELECT *, row_number() OVER (PARTITION BY task_id, run_id ORDER BY step_idx) - 1 AS idx, count(*) OVER (PARTITION BY task_id, run_id) AS len FROM numbered)")
def win1_run_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.run_sequence(Landscape(spark, sf_dir).members).select("task_id", "run_id", "step_idx", "idx", "len", rounded("along", 9))


@query(PRELUDE + "SELECT event_id, block_id FROM prim")
def win2_primary_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN2 and JOI4."""
    return Landscape(spark, sf_dir).primary.select("event_id", "block_id")


@query(PRELUDE + "SELECT task_id, run_id, cidx, block_id FROM compact")
def win3_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Landscape(spark, sf_dir).compact.select("task_id", "run_id", "cidx", "block_id")


@query(PRELUDE + "SELECT * FROM moves")
def win4_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Landscape(spark, sf_dir).moves


@query(PRELUDE + "SELECT * FROM visits")
def win5_visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Landscape(spark, sf_dir).visits


@query(PRELUDE + "SELECT task_id, run_id, cidx, state FROM typed")
def win6_typed_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Landscape(spark, sf_dir).typed.select("task_id", "run_id", "cidx", "state")


@query(PRELUDE + "SELECT task_id, run_id, repair AS repaired FROM flags")
def win7_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    land = Landscape(spark, sf_dir)
    flagged = land.compact.join(land.masked.select("task_id", "block_id", "is_core", "is_trap"), ["task_id", "block_id"], "left").fillna(False, ["is_core", "is_trap"])
    return S.repaired(flagged)


@query(
    PRELUDE
    + """, lists AS (SELECT task_id, run_id, resolved, list(tool ORDER BY step_idx) AS s FROM steps GROUP BY ALL),
starts AS (SELECT task_id, resolved, s, n, unnest(range(1, len(s) - 3 * n + 2)) AS i FROM lists, (SELECT unnest([1, 2, 3]) AS n)),
hits AS (SELECT task_id, resolved, n, s[i:i + n - 1] AS p FROM starts WHERE s[i:i + n - 1] = s[i + n:i + 2 * n - 1] AND s[i:i + n - 1] = s[i + 2 * n:i + 3 * n - 1])
SELECT task_id, array_to_string(p, ',') AS pattern, n::INT AS pattern_length, count(*) AS occurrences, sum(resolved)::BIGINT AS n_resolved, sum(1 - resolved)::BIGINT AS n_failed, round(avg(1 - resolved), 6) AS fail_rate FROM hits GROUP BY ALL"""
)
def win8_loop_motifs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over event types, which repeat more than blocks do."""
    rows = Landscape(spark, sf_dir).steps.withColumn("block_id", F.col("tool")).withColumn("idx", F.col("step_idx"))
    return S.loop_motifs(rows).select("task_id", F.array_join("pattern", ",").alias("pattern"), "pattern_length", "occurrences", "n_resolved", "n_failed", rounded("fail_rate"))


@query(PRELUDE + ", pairs AS (SELECT task_id, run_id, tool AS a, lead(tool) OVER (PARTITION BY run_id ORDER BY step_idx) AS b FROM steps), n AS (SELECT task_id, run_id, a, b, count(*) AS n FROM pairs WHERE b IS NOT NULL GROUP BY ALL), p AS (SELECT *, n / sum(n) OVER (PARTITION BY run_id) AS p FROM n) SELECT task_id, run_id, round(-sum(p * log2(p)), 6) AS entropy, count(*) AS n_bigrams FROM p GROUP BY ALL")
def win12_bigram_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.bigram_entropy(Landscape(spark, sf_dir).steps, "tool").withColumn("entropy", F.round("entropy", 6))


@query(PRELUDE + "SELECT task_id, run_id, step_idx, block_id, after FROM (SELECT o.*, (quarter = 0) AS ap, lead(o.block_id) OVER (PARTITION BY o.run_id ORDER BY o.step_idx) AS after FROM ordered o JOIN steps s USING (event_id)) WHERE ap AND after <> block_id")
def win13_articulation_crossings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = Landscape(spark, sf_dir).ordered.withColumn("after", F.lead("block_id").over(S.in_run("idx")))
    return rows.where("articulation and after <> block_id").select("task_id", "run_id", "step_idx", "block_id", "after")


@query(PRELUDE + "SELECT task_id, model_id, run_id, rank() OVER (PARTITION BY task_id ORDER BY n_steps) + (count(*) OVER (PARTITION BY task_id, n_steps) - 1) / 2 AS rank FROM (SELECT DISTINCT task_id, model_id, run_id, n_steps FROM steps)")
def win11_average_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = Landscape(spark, sf_dir).steps.select("task_id", "model_id", "run_id", "n_steps").distinct()
    return runs.select("task_id", "model_id", "run_id", S.average_ranks(runs, "n_steps", ["task_id"]).alias("rank"))


# graphs


@query()
def gra2_articulation_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The articulation points of the real step graph; tests hold it against removal of each node."""
    blocks = G.blocks_of(Y.step_graph(slices(spark, sf_dir)))
    return blocks.where("is_cut").select("task_id", "node").distinct()


@query()
def gra3_biconnected_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GRA3 and FIL4: blocks of the real step graph, with those of two nodes marked as trivial."""
    return G.blocks_of(Y.step_graph(slices(spark, sf_dir))).withColumn("is_trivial", F.col("n_nodes") == 2)


@query()
def gra4_block_cut_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.block_cut_tree(G.blocks_of(Y.step_graph(slices(spark, sf_dir))))


@query(PRELUDE + "SELECT task_id, a AS node, string_agg(b, ',' ORDER BY b) AS neighbours FROM both_ways GROUP BY ALL")
def gra1_adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.adjacency(Landscape(spark, sf_dir).edges, "a", "b").select("task_id", "node", F.concat_ws(",", F.col("neighbours").cast("array<string>")).alias("neighbours"))


@query(PRELUDE + "SELECT * FROM blocks0")
def gra5_block_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    land = Landscape(spark, sf_dir)
    return G.block_table(land.members, land.runs)


@query(PRELUDE + "SELECT task_id, block_id, role FROM blocks")
def gra6_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GRA6 and GRA7."""
    return Landscape(spark, sf_dir).blocks.select("task_id", "block_id", "role")


@query()
def gra8_task_graphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Real task graphs: block statistics and roles over the blocks of the step graph."""
    s = slices(spark, sf_dir)
    blocks = G.kept(G.blocks_of(Y.step_graph(s)).where("n_nodes > 2"), "task-blocks")
    members = blocks.select("task_id", "block_id", F.col("node").alias("slice"), F.col("is_cut").alias("articulation")).hint("merge").join(s, ["task_id", "slice"])
    return G.with_roles(G.block_table(members, A.runs_of(s)), s)


@query(PRELUDE + "SELECT * FROM edges")
def gra9_block_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GRA9 and JOI7."""
    return Landscape(spark, sf_dir).edges


OPEN = """, opened AS MATERIALIZED (SELECT task_id, block_id, round(fail_rate, 9) >= 0.7 AS is_seed FROM bfail WHERE round(fail_rate, 9) >= 0.56),
within AS MATERIALIZED (SELECT e.task_id, e.a, e.b FROM both_ways e JOIN opened x ON x.task_id = e.task_id AND x.block_id = e.a JOIN opened y ON y.task_id = e.task_id AND y.block_id = e.b),
walk(task_id, node, root) AS (SELECT task_id, block_id, block_id FROM opened UNION SELECT w.task_id, e.b, w.root FROM walk w JOIN within e ON e.task_id = w.task_id AND e.a = w.node),
comp AS (SELECT task_id, node, min(root) AS root FROM walk GROUP BY ALL),
firsts AS (SELECT c.task_id, root, min(block_id) FILTER (is_seed) AS first FROM comp c JOIN opened o ON o.task_id = c.task_id AND o.block_id = c.node GROUP BY ALL HAVING min(block_id) FILTER (is_seed) IS NOT NULL),
basin AS (SELECT c.task_id, c.node AS block_id, basin_id FROM comp c JOIN (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY first) - 1 AS basin_id FROM firsts) f USING (task_id, root)),
brates AS (
  SELECT v.task_id, basin_id, string_agg(DISTINCT v.block_id, ',' ORDER BY v.block_id) AS block_ids, count(DISTINCT v.block_id) AS n_blocks, avg(1 - resolved) AS fail_rate, count(DISTINCT run_id) AS n_trajectories, count(DISTINCT run_id) FILTER (resolved = 0) AS n_failed
  FROM visits v JOIN basin USING (task_id, block_id) GROUP BY ALL),
bmoves AS (
  SELECT m.task_id, s.basin_id, sum(n) AS tot, coalesce(sum(n) FILTER (d.basin_id IS NULL OR d.basin_id <> s.basin_id), 0) AS out
  FROM moves m JOIN basin s ON s.task_id = m.task_id AND s.block_id = m.src LEFT JOIN basin d ON d.task_id = m.task_id AND d.block_id = m.dst GROUP BY ALL),
besc AS (SELECT r.*, CASE WHEN coalesce(tot, 0) > 0 THEN 1 - power(1 - out / tot, 3) ELSE 0.5 END AS escape_prob FROM brates r LEFT JOIN bmoves USING (task_id, basin_id)),
basins AS (SELECT *, round(escape_prob, 9) < 0.15 AS is_sticky FROM besc WHERE NOT (round(escape_prob, 9) > 0.3 AND n_blocks <= 2)),
inb AS (SELECT task_id, block_id FROM basin),
core AS (SELECT task_id, block_id FROM masked WHERE is_core),
beside AS (SELECT DISTINCT e.task_id, e.a AS block_id FROM both_ways e JOIN inb ON inb.task_id = e.task_id AND inb.block_id = e.b EXCEPT SELECT * FROM inb),
nearcore AS (SELECT e.task_id, e.a AS block_id FROM both_ways e JOIN core ON core.task_id = e.task_id AND core.block_id = e.b UNION SELECT * FROM core),
cand AS (SELECT * FROM beside INTERSECT SELECT * FROM nearcore),
entry AS (SELECT m.task_id, run_id, resolved, min(step_idx) AS entry FROM member m JOIN inb USING (task_id, block_id) GROUP BY ALL),
later AS (SELECT DISTINCT o.task_id, o.run_id, o.resolved, o.block_id FROM ordered o JOIN entry e ON e.task_id = o.task_id AND e.run_id = o.run_id AND o.step_idx >= e.entry),
gseen2 AS (SELECT task_id, block_id, count(*) AS n_with, sum(resolved) AS good_with FROM later JOIN cand USING (task_id, block_id) GROUP BY ALL),
intotal AS (SELECT task_id, count(*) AS n_in, sum(resolved) AS good_in FROM entry GROUP BY ALL),
gtable AS (
  SELECT c.task_id, c.block_id, coalesce(n_with, 0) AS n_visits_after_basin, coalesce(good_with, 0)::BIGINT AS n_resolved_after_basin,
    round(CASE WHEN coalesce(n_with, 0) > 0 THEN good_with / n_with - CASE WHEN n_in > n_with THEN (good_in - good_with) / (n_in - n_with) ELSE 0 END ELSE 0 END, 4) AS success_uplift
  FROM cand c JOIN intotal USING (task_id) LEFT JOIN gseen2 USING (task_id, block_id))"""


@query(PRELUDE + OPEN + " SELECT task_id, block_id, basin_id FROM basin")
def gra10_basin_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    land = Landscape(spark, sf_dir)
    return B.basin_blocks(B.fail_rates(land.visits), land.edges)


@query()
def gra11_cut_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articulation points of the graph of blocks."""
    return G.blocks_of(Landscape(spark, sf_dir).edges, "a", "b").where("is_cut").select("task_id", F.col("node").alias("block_id")).distinct()


@query()
def gra12_model_graphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(task, model): nodes, edges, components, density and mean degree of each model's own graph."""
    s = slices(spark, sf_dir).where(F.size("keys") > 0)
    own = Window.partitionBy("task_id", "model_id")
    s = s.withColumn("n", F.count(F.lit(1)).over(own)).where("n >= 6")
    # one group for each (task, model): its number stands for the task's
    s = s.withColumn("number", F.col("task_id") * 1000 + F.substring("model_id", 2, 9).cast("long"))
    groups = s.select("number", "task_id", "model_id", "n").distinct()
    edges = G.kept(Y.step_graph(s.select(F.col("number").alias("task_id"), "slice", "keys")), "model-edges")
    ends = edges.select("task_id", F.explode(F.array("source", "target")).alias("node"))
    roots = G.components(ends, edges.select("task_id", F.col("source").alias("a"), F.col("target").alias("b")))
    parts = roots.where("node = root").groupBy(F.col("task_id").alias("number")).agg(F.count(F.lit(1)).alias("components"))
    m = edges.groupBy(F.col("task_id").alias("number")).agg(F.count(F.lit(1)).alias("m")).where("m >= 2")
    density, degree = 2 * F.col("m") / (F.col("n") * (F.col("n") - 1)), 2 * F.col("m") / F.col("n")
    return groups.join(m, "number").join(parts, "number").select("task_id", "model_id", "n", "m", "components", F.round(density, 6).alias("density"), F.round(degree, 4).alias("mean_degree"))


# field


@query(PRELUDE + "SELECT task_id, block_id, n_visit, round(power(least(greatest(n_visit / n_total, 0), 1), 0.5), 6) AS shrinkage FROM seeds")
def agg1_shrinkage(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Landscape(spark, sf_dir).seeds
    return s.select("task_id", "block_id", "n_visit", F.round(A.shrinkage(F.col("n_visit"), F.col("n_total")), 6).alias("shrinkage"))


@query(PRELUDE + "SELECT task_id, block_id, round(seed, 6) AS seed FROM seeds")
def agg2_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Landscape(spark, sf_dir).seeds.select("task_id", "block_id", rounded("seed"))


@query(
    PRELUDE
    + """, b AS (SELECT task_id, block_id, count(*) AS n, sum(resolved) AS g FROM visits GROUP BY ALL), t AS (SELECT task_id, count(*) AS n_total, sum(resolved) AS gt FROM runs GROUP BY ALL),
x AS (SELECT b.*, n_total, gt, r.run_id, r.resolved AS own, (v.run_id IS NOT NULL)::INT AS seen FROM b JOIN t USING (task_id) JOIN runs r USING (task_id) LEFT JOIN visits v ON v.task_id = b.task_id AND v.block_id = b.block_id AND v.run_id = r.run_id)
SELECT task_id, block_id, run_id, round(CASE WHEN n < 3 OR n > n_total - 3 THEN 0 ELSE (CASE WHEN n > seen THEN (g - seen * own) / (n - seen) ELSE 0 END - (gt - own) / (n_total - 1)) * sqrt(n / n_total) END, 6) AS seed FROM x"""
)
def agg3_leave_one_out_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    land = Landscape(spark, sf_dir)
    return A.seeds_without_one(land.visits, land.runs).withColumn("seed", F.round("seed", 6))


@query(PRELUDE + "SELECT task_id, a, b, round(1 / count(*) OVER (PARTITION BY task_id, a), 9) AS p FROM adj")
def agg4_transition_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    land = Landscape(spark, sf_dir)
    return A.transition_weights(land.seeds, land.edges).withColumn("p", F.round("p", 9))


@query(PRELUDE + "SELECT task_id, block_id, round(field, 6) AS field FROM field")
def agg5_diffusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Landscape(spark, sf_dir).field.select("task_id", "block_id", rounded("field"))


@query(PRELUDE + "SELECT task_id, block_id, is_core, is_trap FROM masked")
def agg6_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG6 and AGG7."""
    return Landscape(spark, sf_dir).masked.select("task_id", "block_id", "is_core", "is_trap")


@query(PRELUDE + "SELECT task_id, block_id, visitors, failed::BIGINT AS failed, round(fail_rate, 6) AS fail_rate FROM bfail")
def agg8_fail_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.fail_rates(Landscape(spark, sf_dir).visits).withColumn("fail_rate", F.round("fail_rate", 6))


# basins and gates


class Basins:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.land = land = Landscape(spark, sf_dir)
        self.edges = G.kept(land.edges, "edges")
        self.basin = G.kept(B.basin_blocks(B.fail_rates(land.visits), self.edges), "basin-blocks")
        self.candidates = G.kept(B.candidate_gates(self.edges, self.basin, land.core), "candidate-gates")

    @property
    def basins(self) -> DataFrame:
        return B.basins(self.basin, self.land.visits, self.land.moves)

    @property
    def gates(self) -> DataFrame:
        return B.gates(self.candidates, self.edges, self.basin, self.land.core, self.land.members, self.land.primary)


@query(PRELUDE + OPEN + " SELECT task_id, basin_id, block_ids, n_blocks, round(fail_rate, 6) AS fail_rate, round(escape_prob, 6) AS escape_prob, n_trajectories, n_failed, is_sticky FROM basins")
def agg9_failure_basins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG9 and AGG10."""
    b = Basins(spark, sf_dir).basins
    return b.select("task_id", "basin_id", F.concat_ws(",", F.col("block_ids").cast("array<string>")).alias("block_ids"), F.col("n_blocks").cast("long"), rounded("fail_rate"), rounded("escape_prob"), "n_trajectories", "n_failed", "is_sticky")


@query(PRELUDE + OPEN + " SELECT * FROM cand")
def joi8_candidate_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Basins(spark, sf_dir).candidates


@query(PRELUDE + OPEN + " SELECT task_id, run_id, block_id FROM later")
def joi9_after_basin(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = Basins(spark, sf_dir)
    return B.after_entry(b.land.members, b.land.primary, b.basin)[1].select("task_id", "run_id", "block_id")


@query(PRELUDE + OPEN + " SELECT DISTINCT task_id, run_id FROM visits JOIN inb USING (task_id, block_id)")
def joi6_runs_in_basins(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = Basins(spark, sf_dir)
    return b.land.visits.join(b.basin.select("task_id", "block_id"), ["task_id", "block_id"], "left_semi").select("task_id", "run_id").distinct()


@query(PRELUDE + OPEN + " SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY block_id) - 1 AS gate_id FROM gtable")
def agg11_recovery_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG11, AGG12, AGG13."""
    return Basins(spark, sf_dir).gates.select("task_id", "gate_id", "block_id", "success_uplift", "n_visits_after_basin", "n_resolved_after_basin")


@query(
    PRELUDE
    + OPEN
    + """, into_b AS (SELECT DISTINCT task_id, run_id, resolved FROM visits JOIN inb USING (task_id, block_id)), nt AS (SELECT task_id, count(*) AS n, sum(resolved) AS g FROM into_b GROUP BY ALL),
w AS (SELECT v.task_id, v.block_id, count(*) AS k, sum(v.resolved) AS gk FROM visits v JOIN into_b USING (task_id, run_id) JOIN cand ON cand.task_id = v.task_id AND cand.block_id = v.block_id GROUP BY ALL)
SELECT c.task_id, c.block_id, round(CASE WHEN coalesce(k, 0) > 0 THEN gk / k - CASE WHEN n > k THEN (g - gk) / (n - k) ELSE 0 END ELSE 0 END, 6) AS uplift FROM cand c JOIN nt USING (task_id) LEFT JOIN w USING (task_id, block_id)"""
)
def agg14_unordered_uplift(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = Basins(spark, sf_dir)
    return B.unordered_uplift(b.candidates, b.land.visits, b.basin)


@query(
    PRELUDE
    + OPEN
    + """, t AS (SELECT task_id, sum(1 - resolved) AS failed FROM runs GROUP BY ALL),
bb AS (SELECT task_id, count(*) AS n_basins, count(*) FILTER (round(escape_prob, 9) <= 0.3) AS n_sticky_basins, count(*) FILTER (round(escape_prob, 9) <= 0.15) AS n_very_sticky_basins, round(avg(fail_rate), 4) AS visit_weighted_fail_rate,
  round(avg(n_failed / n_trajectories), 4) AS trajectory_level_fail_rate, round(avg(escape_prob), 4) AS mean_escape_prob, sum(n_failed) AS nf FROM basins GROUP BY ALL),
gg AS (SELECT task_id, count(*) AS n_gates, round(avg(success_uplift), 4) AS mean_uplift, count(*) FILTER (success_uplift > 0) AS n_positive, count(*) FILTER (success_uplift >= 0.1 AND n_visits_after_basin >= 3) AS n_significant FROM gtable GROUP BY ALL)
SELECT t.task_id, coalesce(n_basins, 0) AS n_basins, coalesce(n_sticky_basins, 0) AS n_sticky_basins, coalesce(n_very_sticky_basins, 0) AS n_very_sticky_basins, visit_weighted_fail_rate, trajectory_level_fail_rate, mean_escape_prob,
  coalesce(n_gates, 0) AS n_gates, mean_uplift, coalesce(n_positive, 0) AS n_positive, coalesce(n_significant, 0) AS n_significant, CASE WHEN n_basins > 0 THEN round(nf / greatest(failed, 1), 4) END AS pct_failed_in_basins
FROM t LEFT JOIN bb USING (task_id) LEFT JOIN gg USING (task_id)"""
)
def agg15_basin_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = Basins(spark, sf_dir)
    return B.basin_summary(b.basins, b.gates, b.land.runs)


# events


@query(PRELUDE + "SELECT benchmark, task_id, model_id, run_id, resolved, access, trap, repair, round(gate_value, 6) AS gate_value, visited_gate FROM rollout")
def agg16_rollout_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG16 and JOI5."""
    return Landscape(spark, sf_dir).events.withColumn("gate_value", F.round("gate_value", 6))


SUPPLY = """, cell AS (SELECT benchmark, task_id, model_id, event, avg(x) AS m FROM long WHERE x IS NOT NULL GROUP BY ALL),
above AS (SELECT *, m - avg(m) OVER (PARTITION BY benchmark, task_id, event) AS d FROM cell)"""


@query(PRELUDE + SUPPLY + " SELECT model_id, event, round(avg(d), 6) AS supply, count(*) AS n_tasks FROM above GROUP BY ALL")
def agg17_supply(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.supply(E.long_events(Landscape(spark, sf_dir).events))


@query(PRELUDE + " SELECT benchmark, event, round(CASE WHEN sum(resolved) > 0 AND sum(1 - resolved) > 0 THEN sum(resolved * x) / sum(resolved) - sum((1 - resolved) * x) / sum(1 - resolved) END, 6) AS demand FROM long WHERE x IS NOT NULL GROUP BY ALL")
def agg18_demand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.demand(E.long_events(Landscape(spark, sf_dir).events))


@query(PRELUDE + "SELECT model_id, count(DISTINCT run_id) AS n_runs, string_agg(DISTINCT run_id, ',' ORDER BY run_id) AS run_ids FROM steps GROUP BY ALL")
def agg19_model_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = F.array_sort(F.collect_set("run_id"))
    return Landscape(spark, sf_dir).steps.groupBy("model_id").agg(F.countDistinct("run_id").alias("n_runs"), F.concat_ws(",", runs.cast("array<string>")).alias("run_ids"))


CUBE = "SELECT model_id, benchmark, event, round(avg(x), 6) AS mean, count(x) AS n FROM long GROUP BY CUBE (model_id, benchmark, event)"


@query(PRELUDE + CUBE)
def agg22_profile_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.long_events(Landscape(spark, sf_dir).events).cube("model_id", "benchmark", "event").agg(F.round(F.avg("x"), 6).alias("mean"), F.count("x").alias("n"))


SWEEP = [(c, t, lam) for c, t, lam in [*((c, 0.25, 0.5) for c in (0.5, 0.65, 0.75, 0.85, 0.9)), *((0.75, t, 0.5) for t in (0.1, 0.2, 0.3, 0.5)), *((0.75, 0.25, lam) for lam in (0.0, 0.25, 1.0, 2.0))]]


@query(
    PRELUDE
    + ", par(core_q, trap_q, laplace) AS (VALUES "
    + ", ".join(f"({c}::DOUBLE, {t}::DOUBLE, {lam}::DOUBLE)" for c, t, lam in SWEEP)
    + """),
lists AS (SELECT task_id, list_sort(list(field) FILTER (field > 0)) AS ups, list_sort(list(field) FILTER (field < 0)) AS downs FROM field GROUP BY task_id),
pcuts AS (
  SELECT task_id, core_q, trap_q, laplace, coalesce(len(ups), 0) AS n_up, coalesce(len(downs), 0) AS n_down,
    round(ups[floor(core_q * (len(ups) - 1))::INT + 1] + (ups[least(floor(core_q * (len(ups) - 1))::INT + 2, len(ups))] - ups[floor(core_q * (len(ups) - 1))::INT + 1]) * (core_q * (len(ups) - 1) - floor(core_q * (len(ups) - 1))), 9) AS core_at,
    round(downs[floor(trap_q * (len(downs) - 1))::INT + 1] + (downs[least(floor(trap_q * (len(downs) - 1))::INT + 2, len(downs))] - downs[floor(trap_q * (len(downs) - 1))::INT + 1]) * (trap_q * (len(downs) - 1) - floor(trap_q * (len(downs) - 1))), 9) AS trap_at
  FROM lists, par),
pm AS (SELECT f.task_id, block_id, core_q, trap_q, laplace, field > 0 AND (n_up <= 3 OR field >= core_at) AS c, field < 0 AND (n_down <= 3 OR field <= trap_at) AS t FROM field f JOIN pcuts USING (task_id)),
pf AS (SELECT task_id, run_id, core_q, trap_q, laplace, max(c::INT) AS access, max(t::INT) AS trap, coalesce(min(cidx) FILTER (t) < max(cidx) FILTER (c AND NOT t), false)::INT AS repair FROM compact JOIN pm USING (task_id, block_id) GROUP BY ALL),
gn AS (SELECT *, sum(resolved) OVER (PARTITION BY task_id, block_id) AS good, count(*) OVER (PARTITION BY task_id, block_id) AS n FROM gseen),
pv AS (SELECT task_id, run_id, laplace, avg((good + laplace) / (n + 2 * laplace)) AS gate_value FROM gn, (SELECT DISTINCT laplace FROM par) GROUP BY ALL)
SELECT core_q, trap_q, laplace, count(*) AS n_runs, round(avg(access), 6) AS access, round(avg(trap), 6) AS trap, round(avg(repair), 6) AS repair, round(avg(gate_value), 6) AS gate_value
FROM runs JOIN pf USING (task_id, run_id) LEFT JOIN pv USING (task_id, run_id, laplace) GROUP BY ALL"""
)
def sta13_parameter_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events at thirteen settings of the quantiles and the smoothing, in one plan."""
    land = Landscape(spark, sf_dir)
    settings = spark.createDataFrame(SWEEP, "core_q double, trap_q double, laplace double")
    out = E.swept(land.compact, land.runs, land.field, land.gates, settings)
    return out.groupBy("core_q", "trap_q", "laplace").agg(F.count(F.lit(1)).alias("n_runs"), *[F.round(F.avg(e), 6).alias(e) for e in E.EVENTS])
