"""What the operators share: the work folder, session settings and size-checked broadcasts."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes that may be broadcast, at most; beyond them the join shuffles.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 64 << 20


def tune(spark: SparkSession) -> None:
    """Smaller Arrow batches: one row may be a whole long document."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))


def free(columns: list[str], *names: str) -> list[str]:
    """Each name, with underscores after it until no column has it in any case."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def whole_ids(docs: DataFrame) -> None:
    """Raises TypeError unless doc_id is of a whole-number type (or has no value at all)."""
    kind = dict(docs.dtypes)["doc_id"]
    if kind not in ("tinyint", "smallint", "int", "bigint", "void"):
        raise TypeError(f"doc_id is {kind}; whole numbers are needed")


def folder(spark: SparkSession, name: str) -> str:
    """A new folder under the cluster's shared checkpoint folder; without one, a local folder, but only where Spark itself runs on one machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "wayfield-checkpoints")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, options: dict[str, str] | None = None) -> DataFrame:
    """Cuts lineage through a table in the shared folder, so that it survives a lost executor."""
    spark = df.sparkSession
    df.write.options(**options or {}).parquet(path := folder(spark, name))
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def swept(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is made and run inside go as soon as it has run, not when the driver next collects its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def small(df: DataFrame, most: int = BROADCAST_ROWS, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The (already written) table with a broadcast hint if it has no more than so many rows and bytes; otherwise the planner joins it by shuffling."""
    wide = sum((F.coalesce(F.length(F.col(f"`{c}`")), F.lit(0)) if t in ("string", "binary") else F.lit(8) for c, t in df.dtypes), F.lit(0))
    rows, size = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(wide), F.lit(0))).first()
    return F.broadcast(df) if rows <= most and size <= most_bytes else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
