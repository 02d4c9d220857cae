"""Intervention arms as a dimension, trap families with their advice, and where a run's data and results are."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: name, whose library triggers, note, whether the temperature rises; in the order of reports.
ARMS = [
    ("placebo", "own", "generic", True),
    ("guided", "own", "repair", True),
    ("shuffled", "shuffled", "repair", True),
    ("tg_baseline", "own", "none", False),
    ("tg_hot", "own", "none", True),
    ("tg_generic", "own", "generic", True),
    ("tg_repair", "own", "repair", True),
    ("shuf_baseline", "shuffled", "none", False),
    ("shuf_generic", "shuffled", "generic", True),
    ("shuf_repair", "shuffled", "repair", True),
    ("tg_repair_cool", "own", "repair", False),
]
#: So many of them have a place in reports; others come after these, by name.
RANKED = 10

FAMILIES = {
    "blind_edit_error": "An edit was followed by an error; read the error and the edited lines before the next edit.",
    "blind_edit_silent": "Edits without a check in between; run a test that shows their effect.",
    "stuck_reading_error": "Reading on after an error; go to the place that the error names.",
    "misread_partial_success": "Some tests pass; look at those that don't.",
    "aimless_reading": "Reading without a question; say what is looked for first.",
    "premature_submit": "Submitted without a check; run the failing case once more.",
    "unknown": "No known pattern; change the approach.",
}


def arms(spark: SparkSession, names: list[tuple] | None = None) -> DataFrame:
    """(arm, trigger_source, note_type, bump_temp, rank): a dimension of fixed size."""
    rows = [(*a, k if k < RANKED else 999) for k, a in enumerate(names or ARMS)]
    return spark.createDataFrame(rows, "arm string, trigger_source string, note_type string, bump_temp boolean, rank int")


def with_arm(rows: DataFrame, names: list[tuple] | None = None) -> DataFrame:
    """rows (with a column arm) and what is known of their arm; an unknown arm is an error."""
    found = rows.join(F.broadcast(arms(rows.sparkSession, names)), "arm", "left")
    known = F.when(F.col("rank").isNotNull(), F.col("rank")).otherwise(F.raise_error(F.concat(F.lit("unsupported arm: "), F.coalesce("arm", F.lit("null")))).cast("int"))
    return found.withColumn("rank", known)


def families(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(FAMILIES.items()), "family string, diagnosis string")


def family_counts(trap_families: DataFrame) -> DataFrame:
    """(family, n) of all families, 0 for those without a trap."""
    n = trap_families.groupBy("family").agg(F.count(F.lit(1)).alias("n"))
    return families(trap_families.sparkSession).select("family").join(F.broadcast(n), "family", "full").select("family", F.coalesce("n", F.lit(0)).alias("n"))


def diagnoses(documents: DataFrame, text: str = "value") -> DataFrame:
    """(lib_idx, diagnosis) out of diagnosis documents: families with their texts, and the family of each trap; whatever isn't a number or has no text is left out."""
    own = documents.select(F.from_json(F.get_json_object(text, "$.families"), "map<string, struct<diagnosis: string>>").alias("f"), F.from_json(F.get_json_object(text, "$.by_trap_index"), "map<string, string>").alias("by"))
    rows = own.select("f", F.explode("by").alias("k", "family"))
    told = F.trim(F.try_element_at("f", F.col("family"))["diagnosis"])
    return rows.select(F.col("k").try_cast("long").alias("lib_idx"), told.alias("diagnosis")).where("lib_idx is not null and diagnosis <> ''")


def rollout_row(config: dict[str, Column], steps: str, n_triggers: str) -> list[Column]:
    """Columns config (JSON), n_steps, n_triggers, first_trigger and steps of one rollout from an array of step structs with ``step`` and ``triggered``."""
    fired = F.filter(steps, lambda s: s["triggered"])
    first = F.when(F.size(fired) > 0, F.array_min(F.transform(fired, lambda s: s["step"])))
    return [F.to_json(F.struct(*[c.alias(k) for k, c in config.items()])).alias("config"), F.size(steps).alias("n_steps"), F.coalesce(n_triggers, F.size(fired)).alias("n_triggers"), first.alias("first_trigger"), F.col(steps)]


@dataclass(frozen=True)
class Paths:
    """Where inputs and results are; another root moves all of them."""

    data: str
    results: str

    def parsed(self) -> str:
        return f"{self.data}/parsed"

    def stage(self, name: str) -> str:
        return f"{self.results}/{name}"

    def moved(self, data: str | None = None, results: str | None = None) -> Paths:
        return Paths(data or self.data, results or self.results)
