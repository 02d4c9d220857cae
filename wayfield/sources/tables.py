"""Readers and writers: trajectories, outcomes, libraries, paired tables, rollouts, reports, stage tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

STEP = "step_idx INT, tool_name STRING, command_class STRING, action_type STRING, observation_signature ARRAY<STRING>, files_touched ARRAY<STRING>, files_read ARRAY<STRING>, raw_action STRING, raw_observation STRING"
TRAJECTORY = f"run_id STRING, model_id STRING, scaffold_id STRING, resolved BOOLEAN, n_steps INT, metadata STRUCT<resolved_score: DOUBLE, raw_reward: DOUBLE, task_max_reward: DOUBLE, pass: STRING>, steps ARRAY<STRUCT<{STEP.replace(' INT', ': INT').replace(' STRING', ': STRING').replace(' ARRAY', ': ARRAY')}>>"
EXAMPLE = "keys: ARRAY<STRING>, detection_keys: ARRAY<STRING>, task_ids: ARRAY<STRING>, tool_names: ARRAY<STRING>, n_raw: INT"
ROLLOUT_STEP = "step: INT, action: STRING, cmd_class: STRING, intent: STRING, sim_trap: DOUBLE, sim_core: DOUBLE, sim_detect: DOUBLE, obs_has_error: BOOLEAN, obs_has_hard_error: BOOLEAN, is_trap: BOOLEAN, is_core: BOOLEAN, triggered: BOOLEAN"
ROLLOUT = f"instance_id STRING, arm STRING, seed INT, resolved BOOLEAN, n_triggers INT, model_patch STRING, per_step ARRAY<STRUCT<{ROLLOUT_STEP}>>"


def trajectories(spark: SparkSession, root: str) -> DataFrame:
    """All trajectories of root/<benchmark>/<task_id>.jsonl with their place in the file; blank lines are skipped, empty files give no rows."""
    path = F.input_file_name()
    return spark.read.schema(TRAJECTORY).json(f"{root}/*/*.jsonl").select(F.regexp_extract(path, r"([^/]+)/[^/]+\.jsonl$", 1).alias("benchmark"), F.regexp_extract(path, r"([^/]+)\.jsonl$", 1).alias("task_id"), "*", F.monotonically_increasing_id().alias("place"))


def outcomes(parsed: DataFrame) -> DataFrame:
    """(benchmark, task_id, run_str, model_id, score, raw_reward, task_max): of rows with one run name the last in the file counts; rows with neither a run nor a pass are dropped.

    parsed as :func:`trajectories` has it; without its ``place``, the last in (model, run, score) order counts."""
    tag = F.col("metadata.pass")
    name = F.coalesce("run_id", F.concat("model_id", F.lit("__"), F.when(F.startswith(tag, F.lit("pass")), tag).otherwise(F.concat(F.lit("pass"), tag))))
    score = F.coalesce("metadata.resolved_score", F.col("resolved").cast("double"), F.lit(0.0))
    place = F.col("place") if "place" in parsed.columns else F.struct("model_id", "run_id", score.alias("score"))
    rows = parsed.select("benchmark", "task_id", name.alias("run_str"), "model_id", score.alias("score"), F.col("metadata.raw_reward").alias("raw_reward"), F.col("metadata.task_max_reward").alias("task_max"), place.alias("place"))
    last = F.max_by(F.struct("model_id", "score", "raw_reward", "task_max"), "place").alias("r")
    return rows.where("run_str is not null").groupBy("benchmark", "task_id", "run_str").agg(last).select("benchmark", "task_id", "run_str", "r.*")


def steps(parsed: DataFrame, text: int = 500) -> DataFrame:
    """One row a step, with its text cut to ``text`` characters."""
    out = parsed.select("benchmark", "task_id", "run_id", "model_id", F.posexplode("steps").alias("place", "s")).select("benchmark", "task_id", "run_id", "model_id", "place", "s.*")
    return out.withColumn("text", F.substring(F.concat_ws("\n", "raw_action", "raw_observation"), 1, text))


def library(spark: SparkSession, *paths: str) -> DataFrame:
    """(lib_idx, keys, ...) of the first path that exists; none of them: no entries."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    schema = f"domain STRING, kind STRING, n_tasks INT, n_steps INT, examples ARRAY<STRUCT<{EXAMPLE}>>"
    found = [p for p in paths if (q := jvm.org.apache.hadoop.fs.Path(p)).getFileSystem(conf).exists(q)]
    rows = spark.read.schema(schema).option("multiLine", True).json(found[0]) if found else spark.createDataFrame([], schema)
    return rows.select("kind", F.posexplode("examples").alias("lib_idx", "e")).select("kind", F.col("lib_idx").cast("long"), "e.*")


def write_library(examples: DataFrame, path: str, domain: str, kind: str, n_tasks: int, n_steps: int) -> None:
    """One JSON document with the examples in the order of their detection keys; a library is small by its nature."""
    packed = examples.agg(F.array_sort(F.collect_list(F.struct("detection_keys", "keys", "task_ids", "tool_names", "n_raw"))).alias("examples"))
    packed.select(F.lit(domain).alias("domain"), F.lit(kind).alias("kind"), F.lit(n_tasks).alias("n_tasks"), F.lit(n_steps).alias("n_steps"), "examples").coalesce(1).write.mode("overwrite").json(path)


def paired_tsv(spark: SparkSession, path: str) -> DataFrame:
    """instance_id and one whole-number column for each arm."""
    rows = spark.read.csv(path, sep="\t", header=True)
    return rows.select("instance_id", *[F.col(f"`{c}`").cast("int").alias(c) for c in rows.columns if c != "instance_id"])


def factorial(rollouts: DataFrame, arms: list[str], order: str | None = None, flags_of: str | None = None) -> DataFrame:
    """instance_id with one column for each arm; only instances that have all arms.

    Of repeats the last by the column ``order`` counts (without one, the greatest outcome). With ``flags_of`` the columns called prefix_* of that arm's rows go along."""
    y = F.col("resolved").cast("int")
    rows = rollouts.where(F.col("arm").isin(arms))
    own = rows.groupBy("instance_id").pivot("arm", arms).agg(F.max_by(y, F.col(order)) if order else F.max(y)).dropna(subset=arms)
    flags = [c for c in rollouts.columns if c.startswith("prefix_")]
    if not flags_of or not flags:
        return own
    last = F.max_by(F.struct(*flags), F.col(order)) if order else F.max(F.struct(*flags))
    return own.join(rows.where(F.col("arm") == flags_of).groupBy("instance_id").agg(last.alias("f")), "instance_id", "left").select(*own.columns, "f.*")


def rollouts(spark: SparkSession, *paths: str) -> DataFrame:
    """Rows with step logs; malformed lines and rows without a log are dropped; the arm tells the source."""
    rows = spark.read.schema(ROLLOUT).option("mode", "DROPMALFORMED").json(list(paths)).where(F.size("per_step") > 0)
    arm = F.lower("arm")
    source = F.when(arm.startswith("tg"), "own").when(arm.startswith("shuf"), "shuffled").when(arm.startswith("rand"), "random").otherwise("none")
    return rows.withColumn("source", source)


def reports(spark: SparkSession, *paths: str) -> DataFrame:
    """(instance_id, resolved, status) from harness reports of three shapes: lists of ids, one object for each instance, or such objects by model.

    Of several statuses of an instance the later list counts: resolved, unresolved, empty patch, error."""
    text = spark.read.text(list(paths), wholetext=True)
    lists = None
    for k, name in enumerate(("resolved_ids", "unresolved_ids", "empty_patch_ids", "error_ids")):
        ids = F.from_json(F.get_json_object("value", f"$.{name}"), "array<string>")
        part = text.select(F.explode(ids).alias("instance_id"), F.lit(k == 0).alias("resolved"), F.lit(name[:-4]).alias("status"), F.lit(k).alias("place"))
        lists = part if lists is None else lists.union(part)
    flat = text.where(F.get_json_object("value", "$.resolved_ids").isNull())
    one = flat.select(F.explode(F.from_json("value", "map<string,string>")).alias("name", "body"))
    deep = one.where(F.get_json_object("body", "$.resolved").isNull()).select(F.explode(F.from_json("body", "map<string,string>")).alias("name", "body"))
    whole = one.union(deep).select(F.col("name").alias("instance_id"), F.get_json_object("body", "$.resolved").cast("boolean").alias("resolved")).where("resolved is not null")
    whole = whole.select("instance_id", "resolved", F.when(F.col("resolved"), "resolved").otherwise("unresolved").alias("status"), F.lit(9).alias("place"))
    return lists.union(whole).groupBy("instance_id").agg(F.max_by(F.struct("resolved", "status"), "place").alias("r")).select("instance_id", "r.*")


def merged(rows: DataFrame, found: DataFrame) -> DataFrame:
    """rollouts with the harness's verdict on (arm, instance), as far as ``found`` has arms; without one they count as failed."""
    keys = [c for c in ("arm", "instance_id") if c in found.columns]
    return rows.drop("resolved").join(found.select(*keys, F.col("resolved")), keys, "left").withColumn("resolved", F.coalesce("resolved", F.lit(False)))


def arm_reports(spark: SparkSession, paths: dict[str, list[str]]) -> DataFrame:
    """(arm, instance_id, resolved, status): the harness reports of each arm."""
    parts = [reports(spark, *own).select(F.lit(arm).alias("arm"), "*") for arm, own in paths.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


def predictions(rows: DataFrame, arm: str, tag: str) -> DataFrame:
    """(instance_id, model_name_or_path, model_patch) of one arm; empty patches stay, missing ids don't."""
    return rows.where((F.col("arm") == arm) & F.col("instance_id").isNotNull() & (F.col("instance_id") != "")).select("instance_id", F.lit(f"{tag}-{arm}").alias("model_name_or_path"), F.coalesce("model_patch", F.lit("")).alias("model_patch"))


def pending(todo: DataFrame, done: DataFrame) -> DataFrame:
    """What has no finished (instance_id, arm, seed) yet."""
    return todo.join(done.select("instance_id", "arm", "seed").distinct(), ["instance_id", "arm", "seed"], "left_anti")


def first_tasks(tasks: DataFrame, most: int) -> DataFrame:
    """The first tasks by name of each benchmark."""
    return tasks.withColumn("__k", F.row_number().over(Window.partitionBy("benchmark").orderBy("task_id"))).where(F.col("__k") <= most).drop("__k")


def write_stage(df: DataFrame, path: str) -> None:
    """A stage's table, by benchmark; a later run replaces only the benchmarks that it has."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("benchmark").parquet(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, sep="\t", header=True)


def dynamics(spark: SparkSession, *paths: str) -> DataFrame:
    """Stored measures, one line of JSON a task with a map ``per_model``; the schema is found in the files."""
    rows = spark.read.json(list(paths))
    kinds = [f for f in rows.schema["per_model"].dataType.fields]
    body = kinds[0].dataType.simpleString() if kinds else "struct<n_runs:bigint>"
    return rows.withColumn("per_model", F.from_json(F.to_json("per_model"), f"map<string,{body}>"))


def observations(rows: DataFrame) -> DataFrame:
    """One row a task and model: the maps' entries beside the task's own columns."""
    own = [c for c in rows.columns if c != "per_model"]
    return rows.select(*own, F.explode("per_model").alias("model_id", "m")).select(*own, "model_id", "m.*")
