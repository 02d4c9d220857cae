"""Runs as ordered sequences of blocks: primary blocks, compaction, transitions, visits, typed states, repairs, motifs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TASK, RUN = ["task_id"], ["task_id", "run_id"]


def in_run(*order: str) -> Window:
    return Window.partitionBy(*RUN).orderBy(*order)


def run_sequence(members: DataFrame) -> DataFrame:
    """One row for each retained step: its place among them (from 0), how many there are, and its progress."""
    steps = members.dropDuplicates([*RUN, "step_idx"]).drop("block_id")
    steps = steps.withColumn("idx", F.row_number().over(in_run("step_idx")) - 1).withColumn("len", F.count(F.lit(1)).over(Window.partitionBy(*RUN)))
    return steps.withColumn("along", F.col("idx") / F.greatest(F.col("len") - 1, F.lit(1)))


def block_stats(members: DataFrame) -> DataFrame:
    """Nodes, runs (all, and those resolved), resolved share of nodes, median, least and greatest position of each block.

    Runs are counted by a first aggregation of each block and run, and the median by one of its own: counts of distinct runs beside it
    would expand the rows and move its state by block and run."""
    step, resolved = F.col("step_idx"), F.col("resolved")
    by_run = members.groupBy("task_id", "block_id", "run_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum(resolved).alias("s"), F.count(resolved).alias("told"), F.max((resolved == 1).cast("int")).alias("good"), F.min(step).alias("low"), F.max(step).alias("high"), F.bool_or("articulation").alias("cut")
    )
    by = by_run.groupBy("task_id", "block_id").agg(
        F.sum("n").alias("n_nodes"),
        F.count("run_id").alias("n_unique_runs"),
        F.count_if((F.col("good") == 1) & F.col("run_id").isNotNull()).alias("good"),
        (F.sum("s") / F.sum("told")).alias("purity"),
        F.min("low").alias("min_pos"),
        F.max("high").alias("max_pos"),
        F.bool_or("cut").alias("has_articulation"),
    )
    median = members.groupBy("task_id", "block_id").agg(F.expr("percentile(step_idx, 0.5)").alias("temporal_span"))
    return by.join(median, ["task_id", "block_id"])


def primary_blocks(members: DataFrame, stats: DataFrame) -> DataFrame:
    """members with one block for each step: the largest, then of most runs, then earliest, then of least number.

    Blocks are ranked once a task, so that a step's is the one of least place; a left join never broadcasts ``members``."""
    rank = F.row_number().over(Window.partitionBy("task_id").orderBy(F.desc("n_nodes"), F.desc("n_unique_runs"), "min_pos", "block_id"))
    places = stats.select("task_id", "block_id", rank.alias("__place"))
    keys = [c for c in members.columns if c != "block_id"]
    ranked = members.join(places, ["task_id", "block_id"], "left")
    return ranked.groupBy(*RUN, "step_idx", *[c for c in keys if c not in (*RUN, "step_idx")]).agg(F.min_by("block_id", "__place").alias("block_id"))


def ordered(primary: DataFrame) -> DataFrame:
    return primary.withColumn("idx", F.row_number().over(in_run("step_idx")) - 1).withColumn("len", F.count(F.lit(1)).over(Window.partitionBy(*RUN)))


def compacted(rows: DataFrame, value: str = "block_id", order: str = "idx") -> DataFrame:
    """Without rows that repeat the one before; ``cidx`` numbers what stays."""
    before = F.lag(value).over(in_run(order))
    kept = rows.where(F.col(value).isNotNull()).withColumn("__before", before).where(F.col("__before").isNull() | (F.col("__before") != F.col(value))).drop("__before")
    return kept.withColumn("cidx", F.row_number().over(in_run(order)) - 1)


def transitions(compact: DataFrame, value: str = "block_id") -> DataFrame:
    """How often one value follows another in the runs of a task."""
    pairs = compact.select(*RUN, F.col(value).alias("src"), F.lead(value).over(in_run("cidx")).alias("dst")).where("dst is not null")
    return pairs.groupBy("task_id", "src", "dst").agg(F.count(F.lit(1)).alias("n"))


def visits(members: DataFrame) -> DataFrame:
    """Which blocks each run is in, by all its steps' blocks."""
    return members.select(*RUN, "resolved", "block_id").distinct()


def repaired(flags: DataFrame, trap: str = "is_trap", core: str = "is_core", order: str = "cidx") -> DataFrame:
    """(run, repaired): whether a core comes after a trap; a step that is both is a trap only."""
    first = F.min(F.when(F.col(trap), F.col(order)))
    last = F.max(F.when(F.col(core) & ~F.col(trap), F.col(order)))
    return flags.groupBy(*RUN).agg(F.coalesce(first < last, F.lit(False)).cast("int").alias("repaired"))


def loop_motifs(primary_ordered: DataFrame, longest: int = 3, least: int = 3) -> DataFrame:
    """Patterns of one to ``longest`` blocks that stand ``least`` times in a row, with occurrences (every start counts) by outcome.

    Every pattern's blocks are read with leads over the run, so that no run is gathered into one row."""
    w = in_run("idx")
    parts = []
    for n in range(1, longest + 1):
        again: Column = F.lit(True)
        for k in range(n * (least - 1)):
            again = again & (F.lead("block_id", k).over(w) == F.lead("block_id", k + n).over(w))
        pattern = F.array(*[F.lead("block_id", k).over(w) for k in range(n)])
        parts.append(primary_ordered.select("task_id", "resolved", F.when(again, pattern).alias("pattern")).where("pattern is not null"))
    found = parts[0]
    for p in parts[1:]:
        found = found.union(p)
    by = found.groupBy("task_id", "pattern").agg(F.count(F.lit(1)).alias("occurrences"), F.sum("resolved").alias("n_resolved"), F.sum(1 - F.col("resolved")).alias("n_failed"))
    return by.withColumn("pattern_length", F.size("pattern")).withColumn("fail_rate", F.col("n_failed") / F.col("occurrences"))


def bigram_entropy(steps: DataFrame, value: str) -> DataFrame:
    """Shannon entropy (bits) of each run's adjacent pairs of values."""
    pairs = steps.select(*RUN, F.col(value).alias("a"), F.lead(value).over(in_run("step_idx")).alias("b")).where("b is not null")
    n = pairs.groupBy(*RUN, "a", "b").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy(*RUN))).groupBy(*RUN).agg((-F.sum(F.col("p") * F.log2("p"))).alias("entropy"), F.count(F.lit(1)).alias("n_bigrams"))


def novelty_before(queries: DataFrame, run: str, order: str, tokens: str, similarity) -> DataFrame:
    """queries with ``most_alike``: the greatest similarity with an earlier query of its run; null without one.

    A self-join by shared token: only pairs that share one are compared, and the run's history is never gathered."""
    q = queries.withColumn("__t", F.explode(tokens))
    a, b = q.select(run, F.col(order).alias("__at"), F.col("__t")), q.select(F.col(run).alias("__run"), F.col(order).alias("__before"), F.col("__t").alias("__u"))
    common = a.join(b, (F.col(run) == F.col("__run")) & (F.col("__t") == F.col("__u")) & (F.col("__before") < F.col("__at"))).groupBy(run, "__at", "__before").agg(F.count(F.lit(1)).alias("__n"))
    sizes = queries.select(F.col(run).alias("__r"), F.col(order).alias("__o"), F.size(tokens).alias("__size"))
    joined = common.join(sizes, (F.col(run) == F.col("__r")) & (F.col("__before") == F.col("__o"))).select(run, "__at", "__n", F.col("__size").alias("__other"))
    joined = joined.join(sizes, (F.col(run) == F.col("__r")) & (F.col("__at") == F.col("__o")))
    best = joined.groupBy(F.col(run).alias("__k"), F.col("__at").alias("__ko")).agg(F.max(similarity(F.col("__n"), F.col("__size"), F.col("__other"))).alias("most_alike"))
    return queries.join(best, (F.col(run) == F.col("__k")) & (F.col(order) == F.col("__ko")), "left").drop("__k", "__ko")


def average_ranks(df: DataFrame, value: str, by: list[str]) -> Column:
    """Ranks from 1 with ties sharing the mean of theirs."""
    w = Window.partitionBy(*by)
    return F.rank().over(w.orderBy(value)) + (F.count(F.lit(1)).over(Window.partitionBy(*by, value)) - 1) / 2
