"""Operator 6: exact deduplication by a streaming query with disk-backed keyed state that never expires.

The state (RocksDB, keyed by SHA-256 digest, no watermark) retains for each digest the stable identifier
(the least doc_id; a null one comes last) and the content locator (file and row) of its keeper, and how many
rows have it. Digests that more than one row has are hits: their full bytes are fetched by locator and
compared with the keeper's; rows whose bytes differ are told apart by their bytes. So two rows are
duplicates exactly if their texts are equal byte by byte.

Defined results: null texts are never duplicates; empty texts are equal to each other; of equal rows with
one doc_id one stays; ties go to the earlier file and row; an empty table stays empty; further columns,
whatever their names (_metadata among them), stay as they are; doc_ids may be of any type that has an order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import folder, free, small, written

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_ORDER = ("__null", "__id", "__file", "__row")


def located(docs: DataFrame) -> tuple[DataFrame, str, str]:
    """docs with two further columns and their names, file and row, which tell rows apart; a table that isn't a plain scan is written first."""
    file, row = free(docs.columns, "__file", "__row")
    names = docs.columns
    if "_metadata" in (c.lower() for c in names):
        docs = written(docs.toDF(*(f"c{k}" for k in range(len(names)))), "dedup-input")
    elif docs._jdf.queryExecution().analyzed().getClass().getSimpleName() != "LogicalRelation":
        docs = written(docs, "dedup-input")
    own = [F.col(f"`{c}`").alias(name) for c, name in zip(docs.columns, names)]
    return docs.select(*own, F.col("_metadata.file_path").alias(file), F.col("_metadata.row_index").alias(row)), file, row


def plain(rows: DataFrame, file: str, row: str) -> DataFrame:
    """What deduplication needs of located rows."""
    return rows.select("doc_id", "text", F.col(file).alias("__file"), F.col(row).alias("__row"))


def digest(bits: int = 256):
    """SHA-256 of the text, of which ``bits`` (a multiple of 4) are used; null for a null text."""
    return F.substring(F.sha2(F.encode("text", "UTF-8"), 256), 1, bits // 4)


def keyed(docs: DataFrame, bits: int = 256) -> DataFrame:
    """What the stream carries of each text: digest, identifier, locator."""
    return docs.where("text is not null").select(digest(bits).alias("__digest"), F.col("doc_id").isNull().alias("__null"), F.col("doc_id").alias("__id"), "__file", "__row")


def stateful(stream: DataFrame) -> DataFrame:
    """The keyed state of a stream of :func:`keyed` rows: keeper and number of rows of each digest."""
    return stream.groupBy("__digest").agg(F.min(F.struct(*_ORDER)).alias("__keeper"), F.count(F.lit(1)).alias("__n"))


def run_stream(spark: SparkSession, path: str, schema, checkpoint: str, out: str, files_per_trigger: int | None = None) -> DataFrame:
    """Runs the stream over all files that are new in ``path``; returns the state of all digests seen so far.

    With the same checkpoint and out, a later call takes up the state where this one left it."""
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    try:
        source = spark.readStream.schema(schema)
        if files_per_trigger:
            source = source.option("maxFilesPerTrigger", files_per_trigger)
        query = (
            stateful(source.parquet(path))
            .writeStream.outputMode("update")
            .option("checkpointLocation", checkpoint)
            .foreachBatch(lambda df, k: df.write.mode("overwrite").parquet(f"{out}/batch={k}"))
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    shape = stateful(spark.createDataFrame([], schema)).schema
    seen = spark.read.schema(shape).option("recursiveFileLookup", "true").parquet(out)
    return seen.groupBy("__digest").agg(F.min("__keeper").alias("__keeper"), F.max("__n").alias("__n"))


def duplicates(docs: DataFrame, bits: int = 256, files_per_trigger: int | None = None) -> DataFrame:
    """(__file, __row, keeper_file, keeper_row) of the rows of a located table that equal an earlier one."""
    spark = docs.sparkSession
    keys = keyed(docs, bits)
    keys.write.parquet(path := folder(spark, "dedup-keys"))
    state = run_stream(spark, path, keys.schema, folder(spark, "dedup-state"), folder(spark, "dedup-seen"), files_per_trigger)
    hits = written(state.where("__n > 1").select("__digest", F.col("__keeper.__file").alias("k_file"), F.col("__keeper.__row").alias("k_row")), "dedup-hits")
    content = docs.select("text", "doc_id", "__file", "__row").where("text is not null").withColumn("__digest", digest(bits)).join(small(hits), "__digest")
    content = written(content.select("__digest", F.col("doc_id").isNull().alias("__null"), F.col("doc_id").alias("__id"), "__file", "__row", "text", "k_file", "k_row"), "dedup-content")
    is_keeper = (F.col("__file") == F.col("k_file")) & (F.col("__row") == F.col("k_row"))
    kept = content.where(is_keeper).select(F.col("__digest").alias("k_digest"), F.col("text").alias("k_text"))
    compared = content.where(~is_keeper).join(kept, F.col("__digest") == F.col("k_digest"))
    equal = compared.where("text = k_text").select("__file", "__row", "k_file", "k_row")
    # one digest, other bytes: told apart by the bytes themselves
    among = Window.partitionBy("__digest", "text").orderBy(*_ORDER)
    other = compared.where("text <> k_text").select("__file", "__row", F.first("__file").over(among).alias("k_file"), F.first("__row").over(among).alias("k_row"), F.row_number().over(among).alias("rn"))
    return written(equal.union(other.where("rn > 1").drop("rn")), "dedup-duplicates")


def drop_duplicates(docs: DataFrame, bits: int = 256, files_per_trigger: int | None = None) -> DataFrame:
    """The rows of docs that equal no earlier one."""
    rows, file, row = located(docs)
    gone = duplicates(plain(rows, file, row), bits, files_per_trigger).select(F.col("__file").alias(file), F.col("__row").alias(row))
    return rows.join(small(gone), [file, row], "left_anti").drop(file, row)


def kept_with_copies(docs: DataFrame) -> DataFrame:
    """(doc_id, copies) of each row that stays; copies counts the rows with its text."""
    rows = plain(*located(docs))
    gone = duplicates(rows)
    more = written(gone.groupBy(F.col("k_file").alias("__file"), F.col("k_row").alias("__row")).agg(F.count(F.lit(1)).alias("more")), "dedup-copies")
    rows = rows.select("doc_id", "__file", "__row").join(small(gone.select("__file", "__row")), ["__file", "__row"], "left_anti")
    return rows.join(small(more), ["__file", "__row"], "left").select("doc_id", (F.coalesce("more", F.lit(0)) + 1).alias("copies"))
