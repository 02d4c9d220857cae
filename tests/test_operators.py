"""Small cases with known answers, properties, and two forms of one operator held against each other."""

from __future__ import annotations

import json
import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayfield.functions import keys as K
from wayfield.functions import special
from wayfield.operators import basins as B
from wayfield.operators import detector as D
from wayfield.operators import field as A
from wayfield.operators import graph as G
from wayfield.operators import markov as M
from wayfield.operators import sequences as S
from wayfield.operators import similarity as Y
from wayfield.operators import stats as X
from wayfield.sources import tables as T
from wayfield.streaming import trigger as R


def parts(nodes: set[int], edges: list[tuple[int, int]]) -> int:
    left, n = set(nodes), 0
    while left:
        n += 1
        todo = [left.pop()]
        while todo:
            v = todo.pop()
            for a, b in edges:
                for x, y in ((a, b), (b, a)):
                    if x == v and y in left:
                        left.remove(y)
                        todo.append(y)
    return n


def test_two_triangles_a_bridge_and_a_lone_node():
    blocks, cut = G.biconnected(8, [(0, 1), (1, 2), (0, 2), (2, 3), (3, 4), (2, 4), (4, 5)])
    assert blocks == [[0, 1, 2], [2, 3, 4], [4, 5]] and cut == {2, 4}


def test_blocks_of_random_graphs():
    r = np.random.default_rng(1)
    for _ in range(60):
        n = int(r.integers(2, 14))
        edges = sorted({tuple(sorted(map(int, r.choice(n, 2, replace=False)))) for _ in range(int(r.integers(1, 20)))})
        blocks, cut = G.biconnected(n, edges)
        whole = parts(set(range(n)), edges)
        for v in range(n):
            rest = parts(set(range(n)) - {v}, [e for e in edges if v not in e])
            alone = all(v not in e for e in edges)
            assert (v in cut) == (not alone and rest > whole)
            assert (v in cut) == (sum(v in b for b in blocks) >= 2)
        assert all(sum(a in b and c in b for b in blocks) == 1 for a, c in edges)


def test_components_over_a_long_path(spark):
    edges = [(7, k, k + 1) for k in range(40)] + [(7, 100, 101), (8, 5, 6)]
    nodes = {(t, x) for t, *ab in edges for x in ab} | {(9, 1)}
    out = G.components(spark.createDataFrame(list(nodes), "task_id long, node long"), spark.createDataFrame(edges, "task_id long, a long, b long"))
    assert {(r.task_id, r.node): r.root for r in out.collect()} == {(t, n): (0 if n <= 40 else 100) if t == 7 else 5 if t == 8 else 1 for t, n in nodes}


def test_neighbours_with_ties_and_few_slices(spark):
    same = [["a", "b"]] * 5
    i, rank, j, d = Y.neighbours_of(same, 3)
    assert j.reshape(5, 3).tolist() == [[1, 2, 3], [0, 2, 3], [0, 1, 3], [0, 1, 2], [0, 1, 2]]
    assert (d == 1).all()  # keys of every slice weigh nothing
    assert len(Y.neighbours_of([["a"]], 6)[0]) == 0
    assert Y.neighbours_of([["a"], ["b"]], 6)[2].tolist() == [1, 0]
    assert Y.neighbours_of([["a", "x"], ["a", "x"], ["b"]], 2)[3].round(6).tolist() == [0, 1, 0, 1, 1, 1]


def test_relational_neighbours_equal_the_kernel_s(spark):
    r = np.random.default_rng(2)
    rows = [(t, k, sorted(set(r.choice(list("abcdefghij"), r.integers(1, 5)).tolist()) | {"all"})) for t in range(3) for k in range(int(r.integers(1, 40)))]
    s = spark.createDataFrame(rows, "task_id long, slice long, keys array<string>")
    a, b = (sorted(map(tuple, df.select("task_id", "i", "rank", "j", F.round("distance", 6)).collect())) for df in (Y.nearest(s, 4), Y.nearest_relational(s, 4)))
    assert a == b


def test_weighted_jaccard_edge_cases(spark):
    rows = [([], []), (["a"], ["a"]), (["a"], ["b"]), (["a", "q"], ["q"]), (["z"], ["z"])]
    w = F.create_map(F.lit("a"), F.lit(2.0), F.lit("b"), F.lit(1.0), F.lit("z"), F.lit(0.0))
    got = [x[0] for x in spark.createDataFrame(rows, "a array<string>, b array<string>").select(Y.weighted_jaccard(F.col("a"), F.col("b"), w)).collect()]
    assert got == [0, 1, 0, pytest.approx(1 / 3), 0]


def test_library_similarity_is_the_best_of_all_pairs(spark):
    r = np.random.default_rng(3)
    draw = lambda n: [(k, sorted(set(r.choice(list("abcdefg"), 3).tolist()))) for k in range(n)]
    q, lib = draw(30), draw(6)
    weight = {x: k / 2 + 0.5 for k, x in enumerate("abcde")}
    out = Y.library_similarity(spark.createDataFrame(q + [(99, ["nothing"])], "id long, keys array<string>"), spark.createDataFrame(lib, "lib_idx long, keys array<string>"), spark.createDataFrame(list(weight.items()), "key string, idf double"), "sim")
    total = lambda s: sum(weight.get(x, 1.0) for x in s)
    for x in out.collect():
        own = dict(q).get(x.id, ["nothing"])
        sims = [round(total(set(own) & set(e)) / total(set(own) | set(e)), 9) for _, e in lib]
        assert x.sim == pytest.approx(max(sims)) and x.sim_idx == (sims.index(max(sims)) if max(sims) > 0 else -1)


def test_masks_keep_all_of_three_and_a_quantile_of_more(spark):
    rows = [(1, k, v) for k, v in enumerate([0.1, 0.5, 1.0, -0.2, 0.0])] + [(2, k, v) for k, v in enumerate([0.1, 0.2, 0.3, 0.4, 1.0, -0.1, -0.2, -0.3, -0.4])] + [(3, 0, 0.0)]
    out = {(r.task_id, r.block_id): (r.is_core, r.is_trap) for r in A.masks(spark.createDataFrame(rows, "task_id long, block_id long, field double")).collect()}
    assert [k for k, v in out.items() if v[0]] and {k for k, v in out.items() if v[0]} == {(1, 0), (1, 1), (1, 2), (2, 3), (2, 4)}
    assert {k for k, v in out.items() if v[1]} == {(1, 3), (2, 8)}


def test_field_is_scaled_and_of_zero_stays_zero():
    f = A.spread(np.array([1.0, 0, 0]), np.array([0, 1]), np.array([1, 2]), 0.65, 24)
    assert f.max() == 1 and f[0] > f[1] > f[2] > 0
    assert (A.spread(np.zeros(2), np.array([0]), np.array([1]), 0.65, 24) == 0).all()


def test_seed_needs_support(spark):
    runs = [("b", 1, "m", r, int(r < 4)) for r in range(8)]
    visits = [(1, r, int(r < 4), b) for b, who in enumerate([range(2), range(3), range(5), range(6)]) for r in who]
    out = A.seeds(spark.createDataFrame(visits, "task_id long, run_id long, resolved int, block_id long"), spark.createDataFrame(runs, "benchmark string, task_id long, model_id string, run_id long, resolved int"))
    seeds = {r.block_id: r.seed for r in out.collect()}
    assert seeds[0] == seeds[3] == 0 and seeds[1] == pytest.approx(0.5 * math.sqrt(3 / 8)) and seeds[2] == pytest.approx(0.3 * math.sqrt(5 / 8))


def test_repair_and_compaction(spark):
    flags = [(1, 1, 0, True, False), (1, 1, 1, False, True), (1, 2, 0, False, True), (1, 2, 1, True, False), (1, 3, 0, True, False), (1, 4, 0, True, False), (1, 4, 1, True, True)]
    out = S.repaired(spark.createDataFrame(flags, "task_id long, run_id long, cidx long, is_trap boolean, is_core boolean"))
    assert {r.run_id: r.repaired for r in out.collect()} == {1: 1, 2: 0, 3: 0, 4: 0}
    path = [(1, 1, k, b) for k, b in enumerate("aabab")] + [(1, 2, k, b) for k, b in enumerate("aaaa")]
    rows = spark.createDataFrame(path, "task_id long, run_id long, idx long, block_id string")
    assert [r.block_id for r in S.compacted(rows).where("run_id = 1").orderBy("cidx").collect()] == list("abab")
    motifs = {("".join(r.pattern), r.occurrences) for r in S.loop_motifs(rows.withColumn("resolved", F.lit(0))).collect()}
    assert motifs == {("a", 2)}


def test_escape_without_a_move_is_one_half(spark):
    df = spark.createDataFrame([(0, 0), (1, 4), (4, 4)], "o long, t long")
    assert [r[0] for r in df.select(B.escape(F.col("o"), F.col("t"))).collect()] == [0.5, pytest.approx(1 - 0.75**3), 1.0]


def test_committor_and_passage_by_hand():
    states = ["EOS_failed", "EOS_resolved", "x|core", "y|outer"]
    p = np.array([[1, 0, 0, 0], [0, 1, 0, 0], [0.1, 0.5, 0, 0.4], [0.5, 0, 0.5, 0]])
    reach, passage = M.solve(p, states)
    assert reach[2] == pytest.approx(0.5 / 0.8) and reach[3] == pytest.approx(0.25 / 0.8)
    assert passage[2] == 0 and passage[3] == 1 and math.isnan(passage[0])
    assert np.isnan(M.solve(np.eye(3), ["EOS_failed", "EOS_resolved", "z|outer"])[0][2])


def test_kernel_rows_sum_to_one_and_edits_keep_that(spark):
    typed = [("b", 1, "m", r, r % 2, k, s) for r in range(4) for k, s in enumerate(["decision_point|early|outer", "weak_basin|mid|outer", "success_outcome|late|core"][: r + 1])]
    k = M.kernel(spark.createDataFrame(typed, "benchmark string, task_id long, model_id string, run_id long, resolved int, cidx long, state string"), ["task_id"])
    edits = [k, M.without_edges(k, ["task_id"], "contains(si, 'decision_point')", "contains(sj, 'weak_basin')"), M.boosted(k, ["task_id"], "contains(si, 'weak_basin')", M.TO_CORE)]
    for e in edits:
        assert all(r.s == pytest.approx(1) for r in e.groupBy("task_id", "si").agg(F.sum("p").alias("s")).collect())
    q = M.solutions(k, ["task_id"]).collect()
    assert len(q) == 5 and all(0 <= r.committor <= 1 for r in q)
    import pyarrow as pa

    p, states = M.dense(pa.Table.from_pandas(k.toPandas()))
    core = [i for i, s in enumerate(states) if s.endswith("|core")]
    outer = [i for i, s in enumerate(states) if s.endswith("|outer")]
    assert M.escape_hazard(k, ["task_id"]).first().escape_hazard == pytest.approx(np.linalg.matrix_power(p, 3)[np.ix_(core, outer)].sum())


def test_tail_probabilities():
    assert special.f_tail(4.0, 2, 10) == pytest.approx(0.05291, abs=1e-4)
    assert special.t_tail(2.228139, 10) == pytest.approx(0.05, abs=1e-6)
    assert special.chi2_tail(3.841459, 1) == pytest.approx(0.05, abs=1e-6)
    assert special.chi2_tail(20.0, 4) == pytest.approx(math.exp(-10) * 11, rel=1e-9)


def test_sign_test_and_flips(spark):
    pairs = spark.createDataFrame([(1, 0)] * 7 + [(0, 1)] * 2 + [(1, 1)], "a int, b int")
    r = X.sign_test(pairs, [], "a", "b").first()
    assert (r.wins, r.losses, r.ties) == (7, 2, 1) and r.p == pytest.approx(2 * sum(math.comb(9, k) for k in range(3)) / 512, abs=1e-6)
    assert X.sign_test(spark.createDataFrame([(1, 1)], "a int, b int"), [], "a", "b").first().p == 1
    deltas = spark.createDataFrame([(k, 1.0) for k in range(6)], "u long, d double")
    assert 0 < X.sign_flip(deltas, "u", "d", 200).first().p < 0.1


def test_kendall_and_spearman(spark):
    df = spark.createDataFrame([(0, k, float(x), float(y)) for k, (x, y) in enumerate([(1, 1), (2, 3), (3, 2), (4, 4), (4, 5)])], "g int, i int, x double, y double")
    assert X.kendall_tau(df, ["g"], "i", "x", "y").first().tau == pytest.approx(7 / math.sqrt(9 * 10), abs=1e-6)
    assert X.spearman(df, ["g"], "x", "y", 5).first().rho == pytest.approx(np.corrcoef([1, 2, 3, 4.5, 4.5], [1, 3, 2, 4, 5])[0, 1], abs=1e-6)
    assert X.spearman(df.withColumn("x", F.lit(1.0)), ["g"], "x", "y", 5).first().rho is None


def test_ols_and_logistic():
    r = np.random.default_rng(4)
    x = np.hstack([np.ones((400, 1)), r.normal(size=(400, 2))])
    y = (r.random(400) < 1 / (1 + np.exp(-(x @ [0.3, 1.0, -2.0])))).astype(float)
    beta, ll = X.irls(x, y)
    p = 1 / (1 + np.exp(-x @ beta))
    assert np.abs(x.T @ (y - p)).max() < 1e-6 and ll == pytest.approx((y * np.log(p) + (1 - y) * np.log(1 - p)).sum())


def test_ols_finds_a_plane(spark):
    rows = [(0, a, b, 1.0 + 2 * a - 3 * b) for a in (0.0, 1.0, 2.0, 3.0) for b in (0.0, 1.0, 5.0)]
    got = {r.term: (r.coefficient, r.r2) for r in X.ols(spark.createDataFrame(rows, "g int, a double, b double, y double"), ["g"], "y", ["a", "b"]).collect()}
    assert got == {"intercept": (1.0, 1.0), "a": (2.0, 1.0), "b": (-3.0, 1.0)}


def log_rows(n: int = 12):
    r = np.random.default_rng(5)
    return [(run, step, ["edit", "read", "test"][int(r.integers(3))] if step < 25 else "submit", bool(r.random() < 0.2), *map(float, r.random(3).round(2))) for run in range(n) for step in range(28)]


LOG = "run_id long, step long, intent string, hard boolean, sim_trap double, sim_core double, sim_detect double"


@pytest.mark.parametrize("settings", [R.Settings(), R.Settings(most=3, cooldown=2, lookback=2), R.Settings(most=9, by_margin=True, intents=("edit",), at_step=True)])
def test_live_detector_equals_batch(spark, tmp_path, settings):
    rows = log_rows()
    for k in range(3):
        spark.createDataFrame([r for r in rows if r[1] // 10 == k], LOG).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
        import time

        time.sleep(1.1)  # files are taken in the order of their times
    stream = spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "log"))
    R.resumable_sink(R.detect(stream, settings), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    live = sorted(map(tuple, spark.read.option("recursiveFileLookup", "true").parquet(str(tmp_path / "out")).collect()))
    batch = sorted(map(tuple, R.detect_batch(spark.createDataFrame(rows, LOG), settings).collect()))
    assert live == batch and any(r[3] for r in batch)


def test_replay_equals_the_live_judge(spark):
    df = spark.createDataFrame(log_rows(), LOG)
    fired = sorted((r.run_id, r.step) for r in R.detect_batch(df, R.Settings(most=3)).where("fired").collect())
    assert fired == sorted((r.run_id, r.idx) for r in D.replay(df, 0.35, most=3).collect())


def test_windows_in_a_stream_drop_late_rows(spark, tmp_path):
    import datetime as dt

    at = lambda h: dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)
    schema = "ts timestamp, value double"
    # rows are late by the watermark of the batch before the last one
    for rows in ([(at(0.5), 1.0)], [(at(9), 1.0)], [(at(9.2), 1.0)], [(at(0.6), 5.0), (at(9.5), 1.0)], [(at(20), 1.0)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "e"))
        import time

        time.sleep(1.1)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "e"))
    R.resumable_sink(R.windowed(stream, "ts", "1 hour"), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = {r.start.hour: (r.n, r.total) for r in spark.read.option("recursiveFileLookup", "true").parquet(str(tmp_path / "out")).collect()}
    assert got == {0: (1, 1.0), 9: (3, 3.0)}


def test_sources_round_trip(spark, tmp_path):
    (tmp_path / "in" / "bench").mkdir(parents=True)
    runs = [{"run_id": "r1", "model_id": "m", "resolved": True, "steps": [{"step_idx": 0, "raw_action": "ls", "raw_observation": "x" * 600}]}, {"model_id": "m", "resolved": False, "metadata": {"pass": "2", "resolved_score": 0.4}}]
    (tmp_path / "in" / "bench" / "t1.jsonl").write_text(json.dumps(runs[0]) + "\n\n" + json.dumps(runs[1]) + "\n")
    (tmp_path / "in" / "bench" / "t2.jsonl").write_text("")
    parsed = T.trajectories(spark, str(tmp_path / "in"))
    assert {(r.benchmark, r.task_id) for r in parsed.collect()} == {("bench", "t1")}
    assert {(r.run_str, r.score) for r in T.outcomes(parsed).collect()} == {("r1", 1.0), ("m__pass2", 0.4)}
    assert [len(r.text) for r in T.steps(parsed).collect()] == [500]
    T.write_stage(parsed.drop("steps"), str(tmp_path / "stage"))
    assert spark.read.parquet(str(tmp_path / "stage")).where("benchmark = 'bench'").count() == 2


def test_reports_of_three_shapes(spark, tmp_path):
    shapes = [{"resolved_ids": ["a", "b"], "unresolved_ids": ["c"], "error_ids": ["b"]}, {"d": {"resolved": True}}, {"model": {"e": {"resolved": False}, "f": {"resolved": True}}}]
    for k, s in enumerate(shapes):
        (tmp_path / f"{k}.json").write_text(json.dumps(s))
    got = {r.instance_id: (r.resolved, r.status) for r in T.reports(spark, *(str(tmp_path / f"{k}.json") for k in range(3))).collect()}
    assert got == {"a": (True, "resolved"), "b": (False, "error"), "c": (False, "unresolved"), "d": (True, "resolved"), "e": (False, "unresolved"), "f": (True, "resolved")}


def test_libraries_rollouts_and_pairs(spark, tmp_path):
    e = spark.createDataFrame([(["TOOL:x", "PHASE:mid"], "t1"), (["TOOL:x", "PHASE:late"], "t2"), (["PHASE:mid"], "t3")], "keys array<string>, task_id string")
    lib = D.examples(e)
    T.write_library(lib, str(tmp_path / "lib"), "d", "trap", 3, 3)
    back = T.library(spark, str(tmp_path / "none"), str(tmp_path / "lib")).collect()
    assert [(r.lib_idx, r.detection_keys, r.task_ids, r.tool_names, r.n_raw) for r in back] == [(0, ["TOOL:x"], ["t1", "t2"], ["x"], 2)]
    assert T.library(spark, str(tmp_path / "none")).count() == 0
    rows = [{"instance_id": i, "arm": a, "seed": 1, "resolved": a == "tg_note", "model_patch": None, "per_step": [{"step": 0}]} for i in "xy" for a in ("tg_note", "shuf_note")][:-1]
    (tmp_path / "r.jsonl").write_text("\n".join([*map(json.dumps, rows), "{broken", json.dumps({"instance_id": "z"})]))
    r = T.rollouts(spark, str(tmp_path / "r.jsonl"))
    assert sorted(x.source for x in r.collect()) == ["own", "own", "shuffled"]
    assert [tuple(x) for x in T.factorial(r, ["tg_note", "shuf_note"]).collect()] == [("x", 1, 0)]
    assert {x.model_patch for x in T.predictions(r, "tg_note", "v1").collect()} == {""}
    assert T.pending(r, r.limit(1)).count() == 2
    T.write_tsv(spark.createDataFrame([("i", 1, 0)], "instance_id string, base int, hot int"), str(tmp_path / "tsv"))
    assert tuple(T.paired_tsv(spark, str(tmp_path / "tsv")).first()) == ("i", 1, 0)


def test_text_helpers(spark):
    df = spark.createDataFrame([("a\nb Error: x\nc",), ("",), (None,), ("one\ntwo\n\n",)], "t string")
    assert [r[0] for r in df.select(K.error_summary("t")).collect()] == ["b Error: x", "(no observation captured)", "(no observation captured)", "two"]
    assert spark.createDataFrame([("x" * 9,)], "t string").select(K.truncated("t", 5)).first()[0] == "xxxx…"


def test_real_chain_has_every_run_and_the_blocks_of_the_graph(spark):
    """Events from neighbours on: blocks are those of the step graph, supply sums to nothing over the models of a task."""
    from wayfield.plans import real, registry

    sf = "/root/testdata/sf0.001"
    land = real.RealLandscape(spark, sf)
    blocks = {(r.task_id, r.block_id) for r in registry.QUERIES["gra3_biconnected_blocks"](spark, sf).where("n_nodes > 2").select("task_id", "block_id").distinct().collect()}
    assert blocks and {(r.task_id, r.block_id) for r in land.members.select("task_id", "block_id").distinct().collect()} == blocks
    several = land.members.groupBy("event_id").count().agg({"count": "max"}).first()[0]
    assert several > 1  # an articulation point is in more than one block
    events = real.real_rollout_events(spark, sf).collect()
    assert len({r.run_id for r in events}) == len(events) == 15
    for e in ("access", "trap", "repair"):
        assert {getattr(r, e) for r in events} <= {0, 1}


def test_key_conditions_apart_give_what_each_gives_alone(spark):
    """All conditions in one pass of the chain: the full keys' tasks have the measures of the landscape without conditions."""
    from wayfield.plans import real
    from wayfield.plans.chains import Dynamics

    sf = "/root/testdata/sf0.001"
    land, names = real.conditioned(spark, sf)
    kept = lambda df: {(r.task_id, r.model_id): (r.committor_dp and round(r.committor_dp, 9), r.core_visit_rate) for r in df.select("task_id", "model_id", "committor_dp", "core_visit_rate").collect()}
    own = kept(Dynamics(spark, sf, real.RealLandscape(spark, sf)).table())
    many = kept(Dynamics(spark, sf, land).table())
    assert names[0] == "full" and own == {(t // len(names), m): v for (t, m), v in many.items() if t % len(names) == 0}


def test_transfer_is_resampled_and_permuted(spark):
    from wayfield.plans import studies

    rows = spark.createDataFrame([("b", f"m{k}", float(k), float(k)) for k in range(6)] + [("c", f"m{k}", float(-k), float(k)) for k in range(6)], "held string, model_id string, score double, rate double")
    got = {r.held: r for r in studies.resampled_taus(rows, 100, 60).collect()}
    assert (got["b"].tau, got["b"].lo, got["b"].hi) == (1.0, 1.0, 1.0) and got["b"].permutation_p < 0.1
    assert (got["c"].tau, got["c"].hi) == (-1.0, -1.0) and got["c"].permutation_p == 1.0


def test_slices_hold_every_step_of_a_large_task(spark, tmp_path):
    """3,200 steps of one task, more than the node cap of FIL3: all are numbered, and all have neighbours."""
    from wayfield.plans import registry
    from wayfield.plans.adapters import slices

    rows = spark.range(3200).selectExpr("id as event_id", "timestamp_seconds(id) as ts", "id % 15 as user_id", "element_at(array('click', 'error', 'view'), cast(id % 3 + 1 as int)) as event_type", "cast(id % 7 as double) as value", "concat('{\"k\": ', id % 100, '}') as props")
    rows.write.parquet(f"{tmp_path}/events.parquet")
    assert slices(spark, str(tmp_path)).count() == 3200
    for name in ("sim4_knn", "sim4_knn_relational"):
        assert registry.QUERIES[name](spark, str(tmp_path)).select("i").distinct().count() == 3200
    assert registry.QUERIES["gra12_model_graphs"](spark, str(tmp_path)).agg(F.sum("n")).first()[0] == 3200


def test_key_sets_dealt_out_find_the_same_neighbours(spark):
    r = np.random.default_rng(5)
    rows = [(t, k, sorted(set(r.choice(list("abcdefghij"), r.integers(0, 5)).tolist()))) for t in range(3) for k in range(12 * t + 1)]
    s = spark.createDataFrame(rows, "task_id long, slice long, keys array<string>")
    a, b = (sorted(map(tuple, df.collect())) for df in (Y.nearest(s, 4), Y.nearest_in_parts(s, 4, 5)))
    assert a == b and len({(x[0], x[1]) for x in a}) == 13 + 25


def test_many_equal_key_sets_take_no_square_of_work():
    began = time.process_time()
    i, _, j, d = Y.neighbours_of([["a"]] * 60_000 + [["b"]], 3)
    assert time.process_time() - began < 10 and len(i) == 3 * 60_001 and j[:9].tolist() == [1, 2, 3, 0, 2, 3, 0, 1, 3] and d[0] == 0


def test_graph_of_steps_is_that_of_mutual_neighbours(spark):
    r = np.random.default_rng(6)
    rows = [(t, k, int(k % 3), sorted(set(r.choice(list("abcdefghij"), r.integers(1, 5)).tolist()))) for t in range(3) for k in range(20 * t + 1)]
    s = spark.createDataFrame(rows, "task_id long, slice long, run_id long, keys array<string>")
    got = lambda df: {(x.task_id, x.source, x.target): (x.distance, x.weight) for x in df.collect()}
    knn = {(x.task_id, x.i, x.j): x.distance for x in Y.nearest(s, 4).collect()}
    want = {(t, i, j): round(min(d, knn[t, j, i]), 6) for (t, i, j), d in knn.items() if i < j and (t, j, i) in knn}
    assert {e: v[0] for e, v in got(Y.mutual_edges(Y.nearest(s, 4))).items()} == want and got(Y.step_graph(s, 4)) == got(Y.mutual_edges(Y.nearest(s, 4)))
    assert got(Y.step_graph(s, 4, across="run_id")) == {e: v for e, v in got(Y.step_graph(s, 4)).items() if e[1] % 3 != e[2] % 3}


def test_mutual_edges_and_components_send_nothing_to_the_driver(spark, monkeypatch):
    """Neither joins a kernel's output, which planners take for small, nor writes rounds of labels."""
    monkeypatch.setattr(G, "kept", None)
    s = spark.createDataFrame([(1, k, ["a", f"b{k % 3}"]) for k in range(9)], "task_id long, slice long, keys array<string>")
    edges = Y.mutual_edges(Y.nearest(s, 2))
    for df in (edges, G.components(edges.select("task_id", F.col("source").alias("node")).union(edges.select("task_id", "target")), edges.select("task_id", F.col("source").alias("a"), F.col("target").alias("b")))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Broadcast" not in plan and "Join" not in plan and df.count()


def test_primary_blocks_and_shared_steps_join_no_members(spark):
    """``members`` compresses well, so planners took it for small and broadcast it: neither function gives them a join that could."""
    rows = [(1, r, s, r % 2, b, b == 3) for r in range(4) for s in range(3) for b in {s, 3, (r + s) % 2}]
    m = spark.createDataFrame(rows, "task_id long, run_id long, step_idx int, resolved int, block_id long, articulation boolean")
    stats = S.block_stats(m)
    shared = A.shared_step_edges(m)
    assert "Join" not in shared._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in stats._jdf.queryExecution().optimizedPlan().toString()
    by = {}
    for _, r, s, y, b, _ in rows:
        by.setdefault(b, []).append((r, s, y))
    for x in stats.collect():
        own = by[x.block_id]
        assert (x.n_nodes, x.n_unique_runs, x.good) == (len(own), len({r for r, _, _ in own}), len({r for r, _, y in own if y})) and x.purity == sum(y for *_, y in own) / len(own)
        assert (x.min_pos, x.max_pos, x.temporal_span) == (min(s for _, s, _ in own), max(s for _, s, _ in own), float(np.median([s for _, s, _ in own])))
    place = {b: (-len(v), -len({r for r, _, _ in v}), min(s for _, s, _ in v), b) for b, v in by.items()}
    steps = {}
    for _, r, s, _, b, _ in rows:
        steps.setdefault((r, s), set()).add(b)
    assert {(x.run_id, x.step_idx): x.block_id for x in S.primary_blocks(m.drop("articulation"), stats).collect()} == {k: min(v, key=place.get) for k, v in steps.items()}
    assert {(x.a, x.b) for x in shared.collect()} == {(a, b) for v in steps.values() for a in v for b in v if a < b}
    left = S.primary_blocks(m.drop("articulation"), stats)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join LeftOuter" in left


def test_controls_are_dealt_out_and_solve_for_the_committor_alone(spark):
    states = ["decision_point|early|core", "weak_basin|mid|outer", M.GOOD, M.BAD]
    rows = [(t, a, b, 0.25 if not a.startswith("EOS") else float(a == b)) for t in range(3) for a in states for b in states]
    out = M.matched_controls(spark.createDataFrame(rows, "task_id long, si string, sj string, p double"), ["task_id"], "decision_point", "weak_basin", 5)
    assert out.rdd.getNumPartitions() == 8 * spark.sparkContext.defaultParallelism and out.count() == 3
    p = np.full((4, 4), 0.25)
    p[2:] = np.eye(4)[2:]
    both, alone = M.solve(p, states), M.solve(p, states, False)
    assert (both[0] == alone[0]).all() and np.isnan(alone[1]).all() and not np.isnan(both[1][:2]).any()
