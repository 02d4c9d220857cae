"""Projections, filters, keys of steps and texts, and similarity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import keys as K
from ..operators import sequences as S
from ..operators import similarity as Y
from ..sources import tables as T
from .adapters import PRELUDE, key_sets, slices, steps, table
from .register import query


@query(PRELUDE + "SELECT event_id, round(progress, 9) AS progress, CASE WHEN progress <= 0.33 THEN 'early' WHEN progress <= 0.67 THEN 'mid' ELSE 'late' END AS step_phase, CASE WHEN progress < 1/3 THEN 'early' WHEN progress < 2/3 THEN 'mid' ELSE 'late' END AS state_phase FROM steps")
def prj1_progress_phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ1, PRJ2, PRJ3."""
    return steps(spark, sf_dir).select("event_id", F.round("progress", 9).alias("progress"), K.phase_of_step("progress").alias("step_phase"), K.phase_of_state("progress").alias("state_phase"))


@query(PRELUDE + "SELECT action || '|' || CASE WHEN progress < 1/3 THEN 'early' WHEN progress < 2/3 THEN 'mid' ELSE 'late' END || '|' || tool AS code, count(*) AS n FROM steps GROUP BY ALL")
def prj4_typed_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = steps(spark, sf_dir).withColumn("phase", K.phase_of_state("progress"))
    return s.groupBy(K.typed_code("action", "phase", "tool").alias("code")).agg(F.count(F.lit(1)).alias("n"))


@query(PRELUDE + "SELECT benchmark, task_id FROM (SELECT benchmark, task_id, row_number() OVER (PARTITION BY benchmark ORDER BY task_id::VARCHAR) AS k FROM (SELECT DISTINCT benchmark, task_id FROM steps)) WHERE k <= 10 AND benchmark <> 'b4'")
def fil1_first_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first ten tasks by name of each benchmark (the operator's own limit)."""
    tasks = steps(spark, sf_dir).where("benchmark <> 'b4'").select("benchmark", "task_id").distinct()
    k = F.row_number().over(Window.partitionBy("benchmark").orderBy(F.col("task_id").cast("string")))
    return tasks.withColumn("k", k).where("k <= 10").drop("k")


@query(PRELUDE + "SELECT task_id, model_id, count(DISTINCT run_id) AS n_runs, count(*) AS n_slices FROM steps GROUP BY ALL HAVING count(*) >= 3 AND count(DISTINCT run_id) >= 2")
def fil2_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return steps(spark, sf_dir).groupBy("task_id", "model_id").agg(F.countDistinct("run_id").alias("n_runs"), F.count(F.lit(1)).alias("n_slices")).where("n_slices >= 3 and n_runs >= 2")


@query(PRELUDE + "SELECT task_id, event_id, row_number() OVER (PARTITION BY task_id ORDER BY event_id) AS place FROM (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY md5(task_id || '|' || run_id || '|' || step_idx), event_id) AS k FROM steps) WHERE k <= 3000")
def fil3_node_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most 3000 steps of a task, by a hash (the operator's own limit); their order stays."""
    by = F.md5(F.concat_ws("|", "task_id", "run_id", "step_idx"))
    some = steps(spark, sf_dir).withColumn("k", F.row_number().over(Window.partitionBy("task_id").orderBy(by, "event_id"))).where("k <= 3000")
    return some.select("task_id", "event_id", F.row_number().over(Window.partitionBy("task_id").orderBy("event_id")).alias("place"))


CONDITIONS = {"full": "", "tool": "TOOL:", "action": "ACTION:", "obs": "OBS:", "band": "BAND:"}


@query(
    PRELUDE
    + ", c(condition, prefix) AS (VALUES "
    + ", ".join(f"('{c}', '{p}')" for c, p in CONDITIONS.items())
    + """)
SELECT event_id, condition, array_to_string(list_filter(keys, lambda x: starts_with(x, prefix)), ',') AS keys FROM keyed, c
UNION ALL SELECT event_id, 'no_phase', array_to_string(list_filter(keys, lambda x: NOT starts_with(x, 'PHASE:')), ',') FROM keyed"""
)
def fil5_key_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every condition's keys of every step, in one pass."""
    begins = lambda p: lambda k: k.startswith(p)
    own = [F.struct(F.lit(c).alias("condition"), F.filter("keys", begins(p)).alias("ks")) for c, p in CONDITIONS.items()]
    own.append(F.struct(F.lit("no_phase").alias("condition"), F.filter("keys", lambda k: ~k.startswith("PHASE:")).alias("ks")))
    return key_sets(spark, sf_dir).select("event_id", F.inline(F.array(*own))).select("event_id", "condition", F.array_join("ks", ",").alias("keys"))


@query(
    PRELUDE
    + """, vocab AS (SELECT DISTINCT task_id, unnest(keys) AS key FROM keyed),
    ranked AS (SELECT event_id, key, row_number() OVER (PARTITION BY event_id ORDER BY md5(event_id || '|' || key), key) AS r, len(keys) AS n FROM keyed JOIN vocab USING (task_id))
SELECT event_id, string_agg(key, ',' ORDER BY key) AS keys FROM ranked WHERE r <= n GROUP BY event_id"""
)
def fil5_random_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many keys as each step has, by a hash, from its task's vocabulary; the vocabulary travels with its task as one array."""
    k = key_sets(spark, sf_dir).select("task_id", "event_id", "keys")
    vocabulary = k.select("task_id", F.explode("keys").alias("key")).groupBy("task_id").agg(F.collect_set("key").alias("words"))
    ranked = F.array_sort(F.transform("words", lambda w: F.struct(F.md5(F.concat(F.col("event_id").cast("string"), F.lit("|"), w)).alias("h"), w.alias("w"))))
    chosen = F.array_sort(F.transform(F.slice(ranked, F.lit(1), F.size("keys")), lambda x: x["w"]))
    return k.join(vocabulary, "task_id").select("event_id", F.array_join(chosen, ",").alias("keys"))


@query(PRELUDE + "SELECT event_id, array_to_string(list_filter(keys, lambda x: NOT starts_with(x, 'PHASE:') AND x <> 'ACTION:other'), ',') AS keys FROM keyed")
def fil6_strip_generic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return key_sets(spark, sf_dir).select("event_id", F.array_join(K.strip_generic("keys"), ",").alias("keys"))


@query(PRELUDE + "SELECT event_id, slice, array_to_string(keys, ',') AS keys FROM slices")
def key1_slice_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slices(spark, sf_dir).select("event_id", "slice", F.array_join("keys", ",").alias("keys"))


def _cases(pairs, column: str) -> str:
    quoted = lambda p: p.replace("'", "''")
    return "CASE " + " ".join(f"WHEN regexp_matches({column}, '{quoted(p)}') THEN '{name}'" for name, p in pairs) + " ELSE 'other' END"


#: Commands and observations made of the tables' own words.
COMMAND = "concat_ws(' ', CASE WHEN conv_id % 3 = 0 THEN 'cd src; python' WHEN conv_id % 3 = 1 THEN 'grep -n' ELSE role END, text)"
LINE = "concat_ws(' ', CASE turn % 4 WHEN 0 THEN 'ValueError: test failed' WHEN 1 THEN 'all tests passed, test ok: success' WHEN 2 THEN 'Permission denied' ELSE 'no' END, text)"


@query(f"SELECT conv_id, turn, {_cases(K.COMMANDS, 'cmd')} AS command_class FROM (SELECT *, {COMMAND} AS cmd FROM conversations)")
def key3_command_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").withColumn("cmd", F.expr(COMMAND)).select("conv_id", "turn", K.command_class("cmd").alias("command_class"))


def _all(pairs, column: str, prefix: str) -> str:
    parts = ", ".join(f"CASE WHEN regexp_matches({column}, '{p}') THEN '{prefix}{name}' END" for name, p in pairs)
    return f"array_to_string(list_sort(list_filter([{parts}], lambda x: x IS NOT NULL)), ',')"


@query(f"SELECT conv_id, turn, {_all(K.OBSERVATIONS, 'line', 'OBS:')} AS keys FROM (SELECT *, {LINE} AS line FROM conversations)")
def key4_observation_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").withColumn("line", F.expr(LINE)).select("conv_id", "turn", F.array_join(K.observation_keys("line"), ",").alias("keys"))


@query(
    r"""SELECT page_id, array_to_string(list_sort(list_distinct(list_concat(
    list_transform(paths, lambda p: 'FILE_PATH:' || array_to_string(string_split(p, '/')[-2:], '/')),
    list_transform(list_filter(paths, lambda p: regexp_matches(p, '\.[A-Za-z0-9]{1,6}$')), lambda p: 'FILE_EXT:' || lower(regexp_extract(p, '\.([A-Za-z0-9]{1,6})$', 1)))))), ',') AS keys
FROM (SELECT page_id, regexp_extract_all('open ' || regexp_replace(url, '^https?://[^/]+', '') || '.html and "' || '/a/b/' || page_id || '/x.PY"', '(?m)(?:["''(\s]|^)(/[^"'')\s]+\.\w+)', 1) AS paths FROM pages)"""
)
def key5_file_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.regexp_replace("url", "^https?://[^/]+", "")
    text = F.concat(F.lit("open "), path, F.lit('.html and "/a/b/'), F.col("page_id").cast("string"), F.lit('/x.PY"'))
    return table(spark, sf_dir, "pages").withColumn("t", text).select("page_id", F.array_join(K.file_keys("t"), ",").alias("keys"))


@query(f"SELECT doc_id, {_all(K.DIFFS, 'd', 'DIFF:')} AS keys FROM (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '+def f(x):' WHEN 1 THEN '+import os' WHEN 2 THEN '-def g(y):' ELSE '+ return 1' END || chr(10) || '+' || text AS d FROM documents WHERE text IS NOT NULL)")
def key6_diff_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = F.expr("CASE doc_id % 4 WHEN 0 THEN '+def f(x):' WHEN 1 THEN '+import os' WHEN 2 THEN '-def g(y):' ELSE '+ return 1' END")
    docs = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.concat(head, F.lit("\n+"), "text").alias("d"))
    return docs.select("doc_id", F.array_join(K.diff_keys("d"), ",").alias("keys"))


@query(
    r"""SELECT page_id, array_to_string(list_sort(list_distinct(list_transform(list_filter(list_transform(
    regexp_extract_all(substr(url || ' ' || html, 1, 5000), '(?i)https?://([^/\s"''<>)]+)', 1),
    lambda h: string_split(regexp_replace(regexp_replace(lower(h), '[.,;:]+$', ''), ':[0-9]+$', ''), '.')), lambda x: len(x) >= 2), lambda x: x[-2] || '.' || x[-1]))), ',') AS domains FROM pages"""
)
def key8_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").withColumn("t", F.concat_ws(" ", "url", "html")).select("page_id", F.array_join(K.domains("t"), ",").alias("domains"))


@query("SELECT conv_id, turn, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda x: length(x) > 2))), ',') AS tokens FROM conversations WHERE role = 'user'")
def key9_query_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's turn stands as a search tool's JSON argument."""
    q = table(spark, sf_dir, "conversations").where("role = 'user'").withColumn("arguments", F.to_json(F.struct(F.lit("").alias("q"), F.col("text").alias("query")))).withColumn("t", K.query_text("arguments"))
    return q.select("conv_id", "turn", F.array_join(K.query_tokens("t"), ",").alias("tokens"))


@query(
    """WITH q AS (SELECT conv_id, turn, list_sort(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda x: length(x) > 2))) AS t FROM conversations WHERE role = 'user'),
best AS (SELECT a.conv_id, a.turn, max(len(list_intersect(a.t, b.t)) / greatest(len(a.t) + len(b.t) - len(list_intersect(a.t, b.t)), 1)) AS sim FROM q a JOIN q b ON a.conv_id = b.conv_id AND b.turn < a.turn GROUP BY ALL)
SELECT q.conv_id, q.turn, CASE WHEN round(sim, 9) >= 0.6 THEN 'repeat' WHEN round(sim, 9) >= 0.2 THEN 'refine' ELSE 'new' END AS novelty FROM q LEFT JOIN best USING (conv_id, turn)"""
)
def key10_query_novelty(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", K.query_tokens("text").alias("t"))
    found = S.novelty_before(q, "conv_id", "turn", "t", lambda n, a, b: F.round(n / (a + b - n), 9))
    return found.select("conv_id", "turn", K.novelty("most_alike").alias("novelty"))


@query(
    PRELUDE
    + """, firsts AS (SELECT run_id, min(step_idx) AS at FROM steps GROUP BY run_id, k),
    counted AS (SELECT s.event_id, count(f.at) AS n FROM steps s LEFT JOIN firsts f ON f.run_id = s.run_id AND f.at <= s.step_idx GROUP BY s.event_id)
SELECT event_id, n AS n_distinct, CASE WHEN n < 3 THEN 'low' WHEN n < 8 THEN 'mid' ELSE 'high' END AS evidence FROM counted"""
)
def key11_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct values of k so far in the run: a running sum of first occurrences."""
    first = F.row_number().over(Window.partitionBy("run_id", "k").orderBy("step_idx")) == 1
    n = F.sum(F.col("first").cast("long")).over(Window.partitionBy("run_id").orderBy("step_idx").rowsBetween(Window.unboundedPreceding, 0))
    return steps(spark, sf_dir).withColumn("first", first).select("event_id", n.alias("n_distinct")).withColumn("evidence", K.evidence_bucket("n_distinct"))


INTENT_SQL = """CASE WHEN contains(c, '<<eof') OR contains(c, 'heredoc') OR contains(c, 'tee ') OR contains(c, ' > ') OR contains(c, ' >> ') OR starts_with(c, 'awk ') OR starts_with(c, 'sed ') THEN 'edit'
  WHEN regexp_matches(c, '(cat|find|head|less|ls|tail|tree|view) ') THEN 'read' WHEN regexp_matches(c, '(grep|rg) ') THEN 'search' WHEN regexp_matches(c, 'py\\.test|pytest|unittest|python3? -m ') THEN 'test' ELSE 'other' END"""
LIVE = "concat(CASE WHEN conv_id % 5 = 0 THEN 'sed -i ' WHEN conv_id % 5 = 1 THEN 'cat ' WHEN conv_id % 5 = 2 THEN 'grep ' WHEN conv_id % 5 = 3 THEN 'python -m pytest ' ELSE 'make ' END, coalesce(text, ''))"
CLASS_SQL = "CASE " + " ".join(f"WHEN tok IN ({', '.join(repr(w) for w in words.split())}) THEN '{c}'" for c, words in K.TOKENS.items()) + " ELSE 'other' END"


@query(rf"SELECT conv_id, turn, {CLASS_SQL} AS cmd_class, {INTENT_SQL} AS intent FROM (SELECT *, lower(cmd) AS c, lower(regexp_extract(cmd, '^\s*([a-zA-Z_][\w-]*)', 1)) AS tok FROM (SELECT *, {LIVE} AS cmd FROM conversations))")
def key13_intent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").withColumn("cmd", F.expr(LIVE)).select("conv_id", "turn", K.first_token_class("cmd").alias("cmd_class"), K.intent("cmd").alias("intent"))


@query(
    rf"""SELECT conv_id, turn, regexp_matches(h, '(?i){K.HARD}') OR (cmd_class IN ('pytest', 'python') AND regexp_matches(h, '(?i)\b(error|exception|failed|failure)\b')) AS hard, regexp_matches(h, '{K.GENERIC}') AS generic
FROM (SELECT *, substr({LINE}, 1, 4000) AS h, {CLASS_SQL} AS cmd_class FROM (SELECT *, lower(regexp_extract({LIVE}, '^\s*([a-zA-Z_][\w-]*)', 1)) AS tok FROM conversations))"""
)
def key14_error_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").withColumn("line", F.expr(LINE)).withColumn("cmd", F.expr(LIVE)).withColumn("cls", K.first_token_class("cmd"))
    return c.select("conv_id", "turn", K.hard_error("cls", "line").alias("hard"), K.generic_error("line").alias("generic"))


@query(PRELUDE + "SELECT event_id, CASE WHEN action = 'submit' THEN 'premature_submit' WHEN action = 'edit' AND k % 2 = 0 THEN CASE WHEN k % 3 = 0 THEN 'blind_edit_error' ELSE 'blind_edit_silent' END WHEN action = 'read' AND k % 2 = 1 THEN CASE WHEN k % 3 = 0 THEN 'stuck_reading_error' WHEN k % 5 = 0 THEN 'misread_partial_success' ELSE 'aimless_reading' END ELSE 'unknown' END AS family FROM steps")
def key15_trap_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The step's keys with a command and an outcome that its k stands for."""
    k = F.col("k")
    keys = K.key_set(F.concat(F.lit("ACTION:"), "action"), F.when(k % 2 == 0, "CMD:sed").otherwise("CMD:cat"), F.when(k % 3 == 0, "OBS:error"), F.when(k % 5 == 0, "OBS:test_passed"))
    return steps(spark, sf_dir).withColumn("ks", keys).select("event_id", K.trap_family("ks").alias("family"))


@query(r"SELECT conv_id, turn, CASE WHEN x = '' THEN '(empty)' WHEN length(x) > 80 THEN rtrim(substr(x, 1, 79), ' ') || '…' ELSE x END AS short FROM (SELECT *, replace(trim(coalesce(text, ''), ' '), chr(10), ' ') AS x FROM conversations)")
def key18_truncated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", K.truncated("text", 80).alias("short"))


@query("SELECT conv_id, turn, format('step {} of {}: {}', turn, conv_id, role) AS note, regexp_replace(lower(role || '__' || conv_id), '[^a-z0-9]+', '-', 'g') AS slug FROM conversations")
def key19_notes_and_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """KEY19 and KEY20: templates and names."""
    slug = F.regexp_replace(F.lower(F.concat("role", F.lit("__"), F.col("conv_id").cast("string"))), "[^a-z0-9]+", "-")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.format_string("step %s of %s: %s", "turn", "conv_id", "role").alias("note"), slug.alias("slug"))


IDF = ", nt AS (SELECT task_id, count(*) AS n FROM slices GROUP BY task_id), idf AS (SELECT task_id, key, df, ln((1 + n) / (1 + df)) AS w FROM (SELECT task_id, key, count(*) AS df FROM (SELECT task_id, unnest(keys) AS key FROM slices) GROUP BY ALL) JOIN nt USING (task_id))"
SIMILAR = (
    IDF
    + """, sets AS (SELECT task_id, keys, min(slice) AS rep FROM slices GROUP BY ALL),
post AS (SELECT s.task_id, rep, key, w FROM (SELECT task_id, rep, unnest(keys) AS key FROM sets) s JOIN idf USING (task_id, key) WHERE w > 0),
tot AS (SELECT task_id, rep, sum(w) AS t FROM post GROUP BY ALL),
com AS (SELECT a.task_id, a.rep AS x, b.rep AS y, sum(a.w) AS c FROM post a JOIN post b ON a.task_id = b.task_id AND a.key = b.key GROUP BY ALL),
allpairs AS (SELECT a.task_id, a.rep AS x, b.rep AS y FROM sets a JOIN sets b ON a.task_id = b.task_id),
dist AS (SELECT p.task_id, p.x, p.y, round(1 - coalesce(c / (tx.t + ty.t - c), 0), 9) AS d FROM allpairs p LEFT JOIN com USING (task_id, x, y) LEFT JOIN tot tx ON tx.task_id = p.task_id AND tx.rep = p.x LEFT JOIN tot ty ON ty.task_id = p.task_id AND ty.rep = p.y),
own AS (SELECT s.task_id, slice, rep FROM slices s JOIN sets USING (task_id, keys)),
knn AS (
  SELECT task_id, i, rank, j, d AS distance FROM (
    SELECT i.task_id, i.slice AS i, j.slice AS j, d, row_number() OVER (PARTITION BY i.task_id, i.slice ORDER BY d, j.slice) AS rank
    FROM own i JOIN dist ON dist.task_id = i.task_id AND dist.x = i.rep JOIN own j ON j.task_id = i.task_id AND j.rep = dist.y AND j.slice <> i.slice) WHERE rank <= 6)"""
)


@query(PRELUDE + IDF + " SELECT task_id, key, df, round(w, 9) AS idf FROM idf")
def sim1_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Y.idf(slices(spark, sf_dir)).select("task_id", "key", "df", F.round("idf", 9).alias("idf"))


@query(PRELUDE + SIMILAR + " SELECT task_id, i, rank, j, round(distance, 6) AS distance FROM knn")
def sim4_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SIM2-SIM4 by the kernel for tasks."""
    knn = Y.nearest(slices(spark, sf_dir))
    return knn.withColumn("distance", F.round("distance", 6))


@query(PRELUDE + SIMILAR + " SELECT task_id, i, rank, j, round(distance, 6) AS distance FROM knn")
def sim4_knn_relational(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SIM4 and JOI2 with the key sets of a large task dealt out to several groups."""
    return Y.nearest_relational(slices(spark, sf_dir)).withColumn("distance", F.round("distance", 6))


@query(PRELUDE + SIMILAR + " SELECT a.task_id, a.i AS source, a.j AS target, round(least(a.distance, b.distance), 6) AS distance, round(exp(-least(a.distance, b.distance) / 0.35), 6) AS weight FROM knn a JOIN knn b ON a.task_id = b.task_id AND a.i = b.j AND a.j = b.i WHERE a.i < a.j")
def joi1_mutual_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Y.step_graph(slices(spark, sf_dir))


@query(PRELUDE + SIMILAR + " SELECT a.task_id, a.i AS source, a.j AS target, round(least(a.distance, b.distance), 6) AS distance, round(exp(-least(a.distance, b.distance) / 0.35), 6) AS weight FROM knn a JOIN knn b ON a.task_id = b.task_id AND a.i = b.j AND a.j = b.i JOIN slices p ON p.task_id = a.task_id AND p.slice = a.i JOIN slices q ON q.task_id = a.task_id AND q.slice = a.j WHERE a.i < a.j AND p.run_id <> q.run_id")
def joi1_mutual_knn_across_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Y.step_graph(slices(spark, sf_dir), across="run_id")


@query(
    PRELUDE
    + """
SELECT s.run_id, s.step_idx, substr(s.tool || ' ' || s.value, 1, 500) AS text FROM steps s"""
)
def src5_step_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC5 and JOI12: a step's text, by run and step."""
    s = steps(spark, sf_dir)
    nested = s.groupBy("benchmark", "task_id", F.col("run_id").cast("string").alias("run_id"), "model_id").agg(
        F.array_sort(F.collect_list(F.struct("step_idx", F.concat_ws(" ", "tool", "value").alias("raw_action"), F.lit(None).cast("string").alias("raw_observation")))).alias("steps")
    )
    return T.steps(nested).select(F.col("run_id").cast("long").alias("run_id"), "step_idx", "text")
