"""Queries over chat messages, live steps, model responses, arms, families and stored measures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arms as A
from ..functions import keys as K
from ..functions import messages as M
from ..operators import graph as G
from ..operators import stats as X
from ..sources import tables as T
from .adapters import PRELUDE, Landscape, steps, table
from .columns import CLASS_SQL, COMMAND, INTENT_SQL, LINE, LIVE, _all, _cases
from .register import query

TOOLS = ["execute_bash", "str_replace_editor", "create_file", "read_page", "web_search", "noop"]
NAME = "CASE conv_id % 6 " + " ".join(f"WHEN {k} THEN '{t}'" for k, t in enumerate(TOOLS)) + " END"
ARGUMENTS = f"concat({COMMAND}, CASE turn % 3 WHEN 0 THEN ' /src/app/main.py' WHEN 1 THEN ' \"/a/b.TXT\"' ELSE '' END, chr(10), CASE turn % 2 WHEN 0 THEN '+import os' ELSE '-def f(x):' END)"


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as messages in JSON: even ones with a list of calls, odd ones with the older single call."""
    c = table(spark, sf_dir, "conversations").withColumn("call", F.struct(F.expr(NAME).alias("name"), F.expr(ARGUMENTS).alias("arguments")))
    listed = F.when(F.col("turn") % 2 == 0, F.array(F.struct(F.col("call").alias("function"))))
    body = F.to_json(F.struct(F.col("text").alias("content"), listed.alias("tool_calls"), F.when(F.col("turn") % 2 == 1, F.col("call")).alias("function_call")))
    return c.select("conv_id", "turn", "text", F.from_json(body, M.MESSAGE).alias("message"))


_ACTIONS = f"""list_filter(['TOOL:' || name, CASE WHEN name = 'execute_bash' THEN 'CMD:' || {_cases(K.COMMANDS, 'arguments')} END,
  CASE name WHEN 'str_replace_editor' THEN 'ACTION:edit' WHEN 'create_file' THEN 'ACTION:create' WHEN 'read_page' THEN 'ACTION:view' WHEN 'web_search' THEN 'ACTION:search' END], lambda x: x IS NOT NULL)"""


@query(f"SELECT conv_id, turn, array_to_string(list_sort({_ACTIONS}), ',') AS keys FROM (SELECT *, {NAME} AS name, {ARGUMENTS} AS arguments FROM conversations)")
def key2_action_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages(spark, sf_dir).select("conv_id", "turn", F.array_join(M.action_keys(F.col("message")), ",").alias("keys"))


@query(
    rf"""WITH m AS (SELECT *, {NAME} AS name, {ARGUMENTS} AS arguments, {LINE} AS line FROM conversations),
p AS (SELECT *, regexp_extract_all(arguments, '(?m)(?:["''(\s]|^)(/[^"'')\s]+\.\w+)', 1) AS paths FROM m)
SELECT conv_id, turn, array_to_string(list_sort(list_distinct(list_filter({_ACTIONS} || string_split({_all(K.OBSERVATIONS, 'line', 'OBS:')}, ',') || string_split({_all(K.DIFFS, 'arguments', 'DIFF:')}, ',')
  || list_transform(paths, lambda p: 'FILE_PATH:' || array_to_string(string_split(p, '/')[-2:], '/'))
  || list_transform(list_filter(paths, lambda p: regexp_matches(p, '\.[A-Za-z0-9]{{1,6}}$')), lambda p: 'FILE_EXT:' || lower(regexp_extract(p, '\.([A-Za-z0-9]{{1,6}})$', 1)))
  || [CASE WHEN turn % 4 / 4.0 < 1 / 3.0 THEN 'PHASE:early' WHEN turn % 4 / 4.0 < 2 / 3.0 THEN 'PHASE:mid' ELSE 'PHASE:late' END], lambda x: x <> ''))), ',') AS keys FROM p"""
)
def key7_combined_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A message's action, file and diff keys, the observation's keys, and the phase."""
    m = messages(spark, sf_dir).withColumn("line", F.expr(LINE)).withColumn("arguments", M.arguments_text(F.col("message"))).withColumn("p", F.col("turn") % 4 / 4.0)
    parts = [M.action_keys(F.col("message")), K.observation_keys("line"), K.file_keys("arguments"), K.diff_keys("arguments"), F.array(F.concat(F.lit("PHASE:"), K.phase_of_state("p")))]
    return m.select("conv_id", "turn", F.array_join(F.array_sort(F.array_distinct(F.concat(*parts))), ",").alias("keys"))


_FILES = r"[\w./-]+\.(?:py|rst|md|c|h|cpp|txt|cfg|toml|yaml|yml|json)"
SEEN = f"concat({LINE}, ' in lib/x.cfg')"


@query(
    rf"""WITH s AS (SELECT *, {LIVE} || ' src/app.py' AS cmd, {SEEN} AS seen FROM conversations),
t AS (SELECT *, lower(cmd) AS c, lower(regexp_extract(cmd, '^\s*([a-zA-Z_][\w-]*)', 1)) AS tok, substr(seen, 1, 4000) AS h, regexp_extract_all(cmd || chr(10) || substr(seen, 1, 1000), '{_FILES}') AS files FROM s),
k AS (SELECT *, {CLASS_SQL} AS cls, {INTENT_SQL} AS intent FROM t)
SELECT conv_id, turn, array_to_string(list_sort(list_distinct(list_filter(['TOOL:execute_bash', CASE WHEN intent <> 'other' THEN 'ACTION:' || intent END, CASE WHEN cls <> 'other' THEN 'CMD:' || cls END,
  CASE WHEN regexp_matches(h, '(?i){K.HARD}') OR (cls IN ('pytest', 'python') AND regexp_matches(h, '(?i)\b(error|exception|failed|failure)\b')) THEN 'OBS:hard_error' END, CASE WHEN regexp_matches(h, '{K.GENERIC}') THEN 'OBS:error' END]
  || string_split({_all(K.OBSERVATIONS, 'h', 'OBS:')}, ',') || list_transform(files, lambda f: 'FILE_PATH:' || f) || list_transform(files, lambda f: 'FILE_EXT:' || regexp_extract(f, '\.(\w+)$', 1)), lambda x: x <> ''))), ',') AS keys FROM k"""
)
def key12_live_step_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").withColumn("cmd", F.concat(F.expr(LIVE), F.lit(" src/app.py"))).withColumn("seen", F.expr(SEEN))
    return c.select("conv_id", "turn", F.array_join(M.live_keys("cmd", "seen"), ",").alias("keys"))


@query()
def key17_parsed_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as responses of five shapes: sections, a thinking block, a loose fence, a fence in the reasoning, a command in JSON. Tests hold the parser case by case."""
    fence = F.concat(F.lit("```bash\n"), F.col("cmd"), F.lit("\n```"))
    shape = F.pmod(F.col("conv_id") + F.col("turn"), F.lit(5))
    c = table(spark, sf_dir, "conversations").withColumn("cmd", F.concat(F.lit("grep -n x "), F.col("conv_id").cast("string")))
    content = K.cases([(shape == 0, F.concat(F.lit("THOUGHT: "), F.coalesce("text", F.lit("")), F.lit("\nACTION: "), fence)), (shape == 1, F.concat(F.lit("<think>why</think> THOUGHT: look\nACTION: bash -lc "), F.col("cmd"))), (shape == 2, F.concat(F.lit("First\n"), fence))], F.lit("nothing here"))
    raw = F.when(shape == 4, F.concat(F.lit("call "), F.to_json(F.struct(F.array(F.lit("bash"), F.lit("-lc"), F.col("cmd")).alias("cmd")))))
    c = c.select("conv_id", "turn", content.alias("content"), F.when(shape == 3, F.concat(F.lit("So\n"), fence)).alias("reasoning"), raw.alias("raw"))
    return c.withColumn("r", M.parsed("content", "reasoning", "raw")).select("conv_id", "turn", "r.thinking", "r.thought", "r.action")


_ARMS = "(VALUES " + ", ".join(f"('{a}', '{t}', '{n}', {str(b).lower()}, {k if k < A.RANKED else 999})" for k, (a, t, n, b) in enumerate(A.ARMS)) + ") a(arm, trigger_source, note_type, bump_temp, rank)"
ARM = "CASE event_id % 11 " + " ".join(f"WHEN {k} THEN '{a[0]}'" for k, a in enumerate(A.ARMS)) + " END"


@query(f"SELECT *, row_number() OVER (ORDER BY rank, arm) AS place FROM (SELECT arm, trigger_source, note_type, bump_temp, rank, count(*) AS n FROM (SELECT {ARM} AS arm FROM events) JOIN {_ARMS} USING (arm) GROUP BY ALL)")
def fil8_arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by arm with what is known of the arm, in the order of reports; an arm that isn't known is an error."""
    from pyspark.sql import Window

    rows = A.with_arm(table(spark, sf_dir, "events").groupBy(F.expr(ARM).alias("arm")).agg(F.count(F.lit(1)).alias("n")))
    # as many rows as there are arms
    return rows.select("arm", "trigger_source", "note_type", "bump_temp", "rank", "n", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("rank", "arm")).alias("place"))


FAMILY = "CASE WHEN action = 'submit' THEN 'premature_submit' WHEN action = 'edit' AND k % 2 = 0 THEN CASE WHEN k % 3 = 0 THEN 'blind_edit_error' ELSE 'blind_edit_silent' END WHEN action = 'read' AND k % 2 = 1 THEN CASE WHEN k % 3 = 0 THEN 'stuck_reading_error' WHEN k % 5 = 0 THEN 'misread_partial_success' ELSE 'aimless_reading' END ELSE 'unknown' END"
_FAMILIES = ", ".join(f"('{f}')" for f in A.FAMILIES)


@query(PRELUDE + f"SELECT f.family, count(s.family) AS n FROM (VALUES {_FAMILIES}) f(family) LEFT JOIN (SELECT {FAMILY} AS family FROM steps) s ON s.family = f.family GROUP BY ALL")
def agg32_family_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .columns import key15_trap_family

    return A.family_counts(key15_trap_family(spark, sf_dir))


_TOLD = "CASE p_partkey % 7 " + " ".join(f"WHEN {k} THEN '{f}'" for k, f in enumerate(A.FAMILIES)) + " END"


@query("SELECT p_partkey AS lib_idx, " + "CASE p_partkey % 7 " + " ".join("WHEN {} THEN '{}'".format(k, t.replace("'", "''")) for k, t in enumerate(A.FAMILIES.values())) + " END AS diagnosis FROM part")
def src7_diagnosis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Diagnosis documents, one for each part here, read for each trap's advice."""
    body = F.to_json(F.struct(F.expr(_TOLD).alias("family")))
    told = F.get_json_object(body, "$.family")
    known = F.to_json(F.map_from_entries(F.array(*[F.struct(F.lit(f), F.struct(F.lit(t).alias("diagnosis"))) for f, t in A.FAMILIES.items()])))
    doc = F.concat(F.lit('{"families": '), known, F.lit(', "by_trap_index": {"x": "unknown", "'), F.col("p_partkey").cast("string"), F.lit('": "'), told, F.lit('"}}'))
    return A.diagnoses(table(spark, sf_dir, "part").select(doc.alias("value")))


@query(PRELUDE + "SELECT benchmark, task_id, model_id, count(*) AS n_runs, sum(resolved)::BIGINT AS n_resolved, round(avg(resolved), 6) AS resolve_rate FROM runs GROUP BY ALL")
def prj6_observation_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC4 and PRJ6: measures stored by task as lines of JSON with a map by model, read again and exploded to tasks and models."""
    runs = Landscape(spark, sf_dir).runs.groupBy("benchmark", "task_id", "model_id").agg(F.count(F.lit(1)).alias("n_runs"), F.sum("resolved").cast("long").alias("n_resolved"), F.round(F.avg("resolved"), 6).alias("resolve_rate"))
    entry = F.struct("model_id", F.struct("n_runs", "n_resolved", "resolve_rate"))
    by_task = runs.groupBy("benchmark", "task_id").agg(F.map_from_entries(F.collect_list(entry)).alias("per_model"))
    T.write_jsonl(by_task, path := G.folder(spark, "dynamics-json"))
    return T.observations(T.dynamics(spark, path))


@query(
    PRELUDE
    + """SELECT run_id, '{"design":"pool","threshold":0.35,"cooldown":4}' AS config, count(*)::INT AS n_steps, count(*) FILTER (k % 7 = 0)::INT AS n_triggers, min(place) FILTER (k % 7 = 0)::INT AS first_trigger
FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY event_id) - 1 AS place FROM steps) GROUP BY run_id"""
)
def prj5_rollout_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rollout rows: configuration, counts and the steps of each run (as long as a run, not as a task)."""
    from pyspark.sql import Window

    s = steps(spark, sf_dir).withColumn("step", (F.row_number().over(Window.partitionBy("run_id").orderBy("event_id")) - 1).cast("int"))
    runs = s.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("step", (F.col("k") % 7 == 0).alias("triggered"), "action"))).alias("per_step")).withColumn("none", F.lit(None).cast("int"))
    config = {"design": F.lit("pool"), "threshold": F.lit(0.35), "cooldown": F.lit(4)}
    return runs.select("run_id", *A.rollout_row(config, "per_step", "none")).drop("per_step")


BASELINE = "(SELECT task_id, model_id, avg(n) AS mean_steps, avg(tools) AS mean_tools, avg(resolved) AS rate FROM (SELECT task_id, model_id, run_id, resolved, count(*) AS n, count(DISTINCT tool) AS tools FROM steps GROUP BY ALL) GROUP BY ALL)"
_RANK = "rank() OVER (ORDER BY {0}) + (count(*) OVER (PARTITION BY {0}) - 1) / 2.0"


@query(
    PRELUDE
    + " UNION ALL ".join(f"SELECT '{m}' AS measure, round(corr(a, b), 6) AS rho, count(*) AS n FROM (SELECT {_RANK.format(m)} AS a, {_RANK.format('rate')} AS b FROM (SELECT round({m}, 6) AS {m}, round(rate, 6) AS rate FROM {BASELINE})) HAVING count(*) >= 10" for m in ("mean_steps", "mean_tools"))
)
def agg29_baseline_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank correlation of the plain measures of runs with the rate of success, over tasks and models."""
    from .studies import agg29_baselines

    rows = agg29_baselines(spark, sf_dir).select("resolve_rate", F.inline(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).alias("x")) for m in ("mean_steps", "mean_tools")])))
    return X.spearman(rows, ["measure"], "x", "resolve_rate").select("measure", "rho", "n")


@query()
def agg25_axis_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank correlation of each centred axis with the rate of success, for ten observations or more."""
    from .studies import AXES, axes, observations

    a = axes(observations(spark, sf_dir)).select("resolve_rate", F.inline(F.array(*[F.struct(F.lit(x).alias("axis"), F.col(f"c_{x}").alias("x")) for x in AXES])))
    return X.spearman(a, ["axis"], "x", "resolve_rate")


@query()
def agg37_rank_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kendall's tau, by task, of the models' committor on the shared graph and of their own graphs' density with their rate of success."""
    from .landscapes import gra12_model_graphs
    from .studies import observations

    o = observations(spark, sf_dir).select("task_id", "model_id", "committor_dp", "resolve_rate")
    own = gra12_model_graphs(spark, sf_dir).select("task_id", "model_id", "density")
    both = o.join(own, ["task_id", "model_id"]).where("committor_dp is not null and density is not null and resolve_rate is not null")
    shared = X.kendall_tau(both, ["task_id"], "model_id", "committor_dp", "resolve_rate").select("task_id", F.col("tau").alias("tau_shared"), "n_pairs")
    return shared.join(X.kendall_tau(both, ["task_id"], "model_id", "density", "resolve_rate").select("task_id", F.col("tau").alias("tau_own")), "task_id", "left")
