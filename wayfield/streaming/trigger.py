"""Live detector: a keyed stateful stream over step logs, and event-time windows with watermarks.

State of a run: steps seen, cool-down left, triggers so far, countdown of the last hard error, whether it is over, and
whether a trap came before. Rows of a micro-batch are taken in step order; a step that comes after a later one of an
earlier micro-batch is still judged, with the state as it is then.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "run_id long, step long, sim_detect double, fired boolean, n_triggers int, is_trap boolean, is_core boolean, repaired boolean"
STATE = "seen int, cooldown int, fires int, hard int, ended boolean, trapped boolean, repaired boolean"


@dataclass(frozen=True)
class Settings:
    threshold: float = 0.35
    margin: float = 0.03
    warmup: int = 2
    cooldown: int = 4
    most: int = 1
    #: Steps for which a hard error opens the gate; 0: no gate.
    lookback: int = 0
    at_step: bool = False
    intents: tuple[str, ...] = ()
    #: Whether a trigger also needs the margin between trap and core.
    by_margin: bool = False


def judge(rows: list[dict], state: list, s: Settings) -> tuple[list[dict], list]:
    """Rows of one run in order, with what the detector makes of them; and the state after them."""
    seen, cooldown, fires, hard, ended, trapped, repaired = state
    out = []
    for r in rows:
        if r["intent"] == "submit":
            ended = True
        if r["hard"]:
            hard = max(s.lookback, 1)
        trap = r["sim_trap"] >= s.threshold and r["sim_trap"] - r["sim_core"] >= s.margin
        core = r["sim_core"] >= s.threshold and r["sim_core"] - r["sim_trap"] >= s.margin
        trapped = trapped or trap
        repaired = repaired or (trapped and core)
        fit = not ended and seen >= s.warmup and cooldown == 0 and fires < s.most and r["sim_detect"] >= s.threshold
        fit = fit and (s.lookback == 0 or hard > 0) and (not s.at_step or r["hard"]) and (not s.intents or r["intent"] in s.intents)
        fit = bool(fit and (not s.by_margin or trap))
        cooldown = s.cooldown if fit else max(0, cooldown - 1)
        fires += fit
        hard = max(0, hard - 1)
        seen += 1
        out.append({"run_id": r["run_id"], "step": r["step"], "sim_detect": r["sim_detect"], "fired": fit, "n_triggers": fires, "is_trap": bool(trap), "is_core": bool(core), "repaired": bool(repaired)})
    return out, [seen, cooldown, fires, hard, ended, trapped, repaired]


def detect(log: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The stream (or batch) of judged steps of (run_id, step, intent, hard, sim_trap, sim_core, sim_detect)."""

    def update(key, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        own = list(state.get) if state.exists else [0, 0, 0, 0, False, False, False]
        rows = pd.concat(list(parts)).sort_values("step")
        out, own = judge(rows.to_dict("records"), own, settings)
        state.update(tuple(own))
        yield pd.DataFrame(out)

    cols = log.select(F.col("run_id").cast("long"), F.col("step").cast("long"), "intent", "hard", "sim_trap", "sim_core", "sim_detect")
    return cols.groupBy("run_id").applyInPandasWithState(update, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


def detect_batch(log: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """As :func:`detect` on a bounded table: each run is one group."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(judge(pdf.sort_values("step").to_dict("records"), [0, 0, 0, 0, False, False, False], settings)[0])

    cols = log.select(F.col("run_id").cast("long"), F.col("step").cast("long"), "intent", "hard", "sim_trap", "sim_core", "sim_detect")
    return cols.groupBy("run_id").applyInPandas(run, OUT)


def windowed(events: DataFrame, time: str, width: str, slide: str | None = None, late: str = "1 hour", by: tuple[str, ...] = ()) -> DataFrame:
    """Counts and sums in tumbling or sliding windows of event time; rows later than ``late`` are dropped in a stream. Not in the reference."""
    w: Column = F.window(time, width, slide) if slide else F.window(time, width)
    return events.withWatermark(time, late).groupBy(w.alias("w"), *by).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n", "total")


def sessions(events: DataFrame, time: str, gap: str, by: tuple[str, ...], late: str = "1 hour") -> DataFrame:
    """Counts in sessions that a pause of ``gap`` ends. Not in the reference."""
    w = F.session_window(time, gap)
    return events.withWatermark(time, late).groupBy(w.alias("w"), *by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n")


def resumable_sink(stream: DataFrame, path: str, checkpoint: str):
    """A started append of a stream; after a restart with the same checkpoint no micro-batch is written twice."""
    return stream.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(lambda df, k: df.write.mode("overwrite").parquet(f"{path}/batch={k}")).trigger(availableNow=True).start()
