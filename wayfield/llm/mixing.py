"""Operator 7: mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

The documents of each source stand in shuffled order (by MD5 of seed and doc_id) as one ring of tokens,
cut into blocks of BLOCK tokens; the last block is filled up from the ring's start. Slot t of the schedule
is the golden-ratio point (t + 1) * PHI mod 2^32 (which goes through all of them before it starts again), mapped through the cumulative target weights to a
source; the k-th slot of a source holds its block k modulo its number of blocks, so that a small source
comes round again. The schedule ends where every block of every source has had a slot: no document
is dropped. By default the target weight of a source is proportional to tokens^ALPHA.

Tokens are counted as white-space characters plus one (0 for an empty or null text). Defined results: a
null source counts as ''; sources without positive weight have no slot, nor have those without a token, whose rows :func:`mix`
keeps once, with a null slot; a weight below a 2^32nd of their sum is a ValueError; null doc_ids
come last in the shuffled order; ties and repeated rows are ordered by doc_id and then arbitrarily, which
equal rows don't show; an empty table has no schedule; further columns, whatever their names, are ignored by :func:`schedule` and
kept by :func:`mix`.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .exact import located
from .shared import written

BLOCK, ALPHA, SEED = 4096, 0.8, 7
PHI, RANGE = 2654435769, 2**32
#: Slots of one stretch of the schedule, which is ranked by itself.
STRETCH = 65536


def tokens(text="text"):
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, 0).otherwise(F.length(text) - F.length(F.translate(text, " \n\t\r", "")) + 1).cast("long")


def running(df: DataFrame, group: str, part: str, order: list, value, name: str) -> DataFrame:
    """df with the sum of ``value`` over the rows before it in its group, in the order of (part, order).

    Only parts are sorted; what lies before a part comes from the parts' totals, so that a hot group is spread over its parts."""
    totals = df.groupBy(group, part).agg(F.sum(value).alias("__total"))
    before = Window.partitionBy(group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(F.col(group).alias("__g"), F.col(part).alias("__p"), F.coalesce(F.sum("__total").over(before), F.lit(0)).alias("__before"))
    inside = Window.partitionBy(group, part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = df.withColumn("__local", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return local.join(totals, (local[group] == totals["__g"]) & (local[part] == totals["__p"])).withColumn(name, F.col("__before") + F.col("__local")).drop("__g", "__p", "__before", "__local", "__total")


def placed(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """docs with struct __at: source, tokens n, and first token's place in the source's ring."""
    shuffled = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col("doc_id").cast("string"), F.lit("~"))).cast("binary"))
    df = docs.withColumn("__source", F.coalesce(F.col("source"), F.lit(""))).withColumn("__n", tokens()).withColumn("__hash", shuffled).withColumn("__part", F.substring("__hash", 1, 3))
    return running(df, "__source", "__part", ["__hash", "doc_id"], "__n", "__start").drop("__hash", "__part")


def plan(totals: dict[str, int], weights: dict[str, float] | None, block: int, alpha: float) -> list[tuple[str, int, int, int, int]]:
    """(source, from, to, blocks, tokens) of each source: its share of the range of points, and its blocks."""
    chosen = {s: float(n) ** alpha if weights is None else weights.get(s, 0.0) for s, n in totals.items()}
    used = sorted(s for s in totals if totals[s] > 0 and chosen[s] > 0)
    whole, out, low, up_to = math.fsum(chosen[s] for s in used), [], 0, 0.0
    for k, s in enumerate(used):
        up_to += chosen[s]
        high = RANGE if k == len(used) - 1 else math.floor(up_to / whole * RANGE)
        if high <= low:
            raise ValueError(f"the share of {s!r} is below a 2^32nd")
        out.append((s, low, high, -(-totals[s] // block), totals[s]))
        low = high
    return out


def point_of(slot):
    """(slot + 1) * PHI mod RANGE in parts that stay below 2^63."""
    n, high, low = F.pmod(slot + 1, F.lit(RANGE)), PHI >> 16, PHI & 0xFFFF
    return F.pmod(F.pmod(n * F.lit(high), F.lit(1 << 16)) * F.lit(1 << 16) + n * F.lit(low), F.lit(RANGE))


def drawn(spark: SparkSession, sources: list[tuple[str, int, int, int, int]], many: int) -> DataFrame:
    """(slot, source, k, blocks): the first ``many`` slots, each the k-th of its source."""
    cuts = F.broadcast(spark.createDataFrame([s[:4] for s in sources], "source string, low long, high long, blocks long"))
    points = spark.range(many).select(F.col("id").alias("slot"), point_of(F.col("id")).alias("point"), F.floor(F.col("id") / STRETCH).alias("stretch"))
    at = points.join(cuts, (F.col("point") >= F.col("low")) & (F.col("point") < F.col("high"))).withColumn("one", F.lit(1).cast("long"))
    return written(running(at, "source", "stretch", ["slot"], "one", "k").select("slot", "source", "k", "blocks"), "mixing-slots")


def slots(spark: SparkSession, sources: list[tuple[str, int, int, int, int]]) -> DataFrame:
    """(slot, source, k, block, epoch) for as long as it takes that every block has a slot."""
    if not sources:
        return spark.createDataFrame([], "slot long, source string, k long, block long, epoch long")
    most = max(blocks * RANGE / max(high - low, 1) for _, low, high, blocks, _ in sources)
    many = int(most * 1.02) + 64 * len(sources) + 64
    while True:
        ranked = drawn(spark, sources, many)
        end, reached = ranked.where("k = blocks - 1").agg(F.max("slot"), F.count(F.lit(1))).first()
        if reached == len(sources):
            break
        many *= 2  # the points left a source waiting for its last block
    return ranked.where(F.col("slot") <= end).select("slot", "source", "k", (F.col("k") % F.col("blocks")).alias("block"), F.floor(F.col("k") / F.col("blocks")).alias("epoch"))


def sources_of(at: DataFrame, weights: dict[str, float] | None, block: int, alpha: float) -> list[tuple[str, int, int, int, int]]:
    totals = {r[0]: int(r[1] or 0) for r in at.groupBy("__source").agg(F.sum("__n")).collect()}
    return plan(totals, weights, block, alpha)


def schedule(docs: DataFrame, weights: dict[str, float] | None = None, block: int = BLOCK, alpha: float = ALPHA, seed: int = SEED) -> DataFrame:
    """(slot, source, block, epoch, doc_id, from_token, to_token): the pieces of documents in each slot's block."""
    spark = docs.sparkSession
    at = written(placed(docs.select("doc_id", "source", "text"), seed).select("doc_id", "__source", "__n", "__start"), "mixing-places")
    sources = sources_of(at, weights, block, alpha)
    ring = F.broadcast(spark.createDataFrame([(s, n, b * block) for s, _, _, b, n in sources], "__ring string, __tokens long, __length long"))
    inside = at.where("__n > 0").join(ring, F.col("__source") == F.col("__ring"))
    # the ring is gone round until its blocks are full; only a source of less than a block goes round more than twice
    laps = F.sequence(F.lit(0).cast("long"), F.floor((F.col("__length") - 1) / F.col("__tokens")))
    lapped = inside.withColumn("__lap", F.explode(laps)).withColumn("__first", F.col("__start") + F.col("__lap") * F.col("__tokens")).where("__first < __length")
    last = F.least(F.col("__first") + F.col("__n"), F.col("__length")) - 1
    pieces = lapped.withColumn("__block", F.explode(F.sequence(F.floor(F.col("__first") / block), F.floor(last / block))))
    start, end = F.greatest(F.col("__block") * block, F.col("__first")), F.least((F.col("__block") + 1) * block, F.col("__first") + F.col("__n"))
    pieces = pieces.select("__source", "__block", "doc_id", (start - F.col("__first")).alias("from_token"), (end - F.col("__first")).alias("to_token"))
    order = slots(spark, sources)
    return order.join(pieces, (order["source"] == pieces["__source"]) & (order["block"] == pieces["__block"])).select("slot", "source", "block", "epoch", "doc_id", "from_token", "to_token")


def mix(docs: DataFrame, weights: dict[str, float] | None = None, block: int = BLOCK, alpha: float = ALPHA, seed: int = SEED, slot: str | None = None) -> DataFrame:
    """The rows of docs, each as often as the block in which it starts is scheduled; a text of no token stands where the next one starts.

    With ``slot`` the copies carry their slot under that name, by which the rows can be put in the schedule's order. Texts are moved once, when
    the rows are known by their places."""
    spark = docs.sparkSession
    rows, file, row = located(docs)
    at = placed(rows.select("doc_id", "source", "text", F.col(file).alias("__file"), F.col(row).alias("__row")), seed)
    at = written(at.select("__file", "__row", "__source", "__n", "__start"), "mixing-rows")
    totals = {r[0]: int(r[1] or 0) for r in at.groupBy("__source").agg(F.sum("__n")).collect()}
    sources = plan(totals, weights, block, alpha)
    blocks = F.broadcast(spark.createDataFrame([(s, b) for s, _, _, b, _ in sources], "__ring string, __blocks long"))
    inside = at.join(blocks, F.col("__source") == F.col("__ring")).withColumn("__block", F.least(F.floor(F.col("__start") / block), F.col("__blocks") - 1))
    order = slots(spark, sources).select(F.col("source").alias("__s"), F.col("block").alias("__b"), F.col("slot").alias("__slot"))
    copies = inside.join(order, (F.col("__source") == F.col("__s")) & (F.col("__block") == F.col("__b"))).select("__file", "__row", "__slot")
    wordless = F.broadcast(spark.createDataFrame([(s,) for s, n in totals.items() if not n], "__ring string"))
    copies = copies.union(at.join(wordless, F.col("__source") == F.col("__ring")).select("__file", "__row", F.lit(None).cast("long")))
    again = copies.toDF("__f", "__r", "__slot")
    keys = (rows[file] == again["__f"]) & (rows[row] == again["__r"])
    return rows.join(again, keys).select(*[rows[f"`{c}`"] for c in docs.columns], *([again["__slot"].alias(slot)] if slot else []))
