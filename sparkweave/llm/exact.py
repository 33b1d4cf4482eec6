"""Exact deduplication as a stateful stream.

Each row becomes a record of its digest, its stable identifier, its length and a locator of its content (the file it
lies in). A Structured Streaming query folds the records into keyed state that never expires and lies on disk (RocksDB):
for each digest the row that stays, its locator and the number of rows. Whole texts of rows that share a digest are then
compared; should different texts share one, those are grouped by their bytes instead.

Texts are equal when identical after every character of [\\x20\\x09-\\x0D] is deleted. Null counts as empty, and empty
texts are equal. Of equal texts the longest original stays, then the smallest identifier (null last), then the first
read of wholly repeated rows. Other columns are left aside. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkweave.llm._common import dropped, new_path, no_white, table, written

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Records for which one partition of the state is meant, and the fewest partitions. A state partition holds at least
#: 4 MB of disk, whatever lies in it, so their number follows the records and not the shuffles of other operators.
STATE_RECORDS, STATE_PARTITIONS = 2_000_000, 24
#: Memory of an executor for its state stores.
STATE_MB = 128
#: Most digests that are met by broadcast.
HOT = 4096
#: Record files folded into the state in one micro-batch.
FILES_PER_TRIGGER = 1000


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def place(id_col: str, text_col: str) -> Column:
    """What orders the rows of a group, the one that stays first: longer texts, then identifiers; and the locator."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return F.struct((-F.length(text)).alias("shorter"), F.col(id_col).isNull().alias("no_id"), F.col(id_col).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.input_file_name().alias("locator"))


def records(docs: DataFrame, digest: Callable[[Column], Column] = sha256, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One record per row, without its text."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(digest(no_white(text)).alias("digest"), place(id_col, text_col).alias("at"))


def fold(spark: SparkSession, source: str, schema, at: str, files: int = FILES_PER_TRIGGER) -> DataFrame:
    """(digest, keep, group_size) after the stream over the record files in source has caught up; its state lies in at."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source)
    state = stream.groupBy("digest").agg(F.min("at").alias("keep"), F.count("*").alias("group_size"))

    def emit(changed: DataFrame, number: int) -> None:
        changed.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{at}/state/part={number}")

    parts = max(STATE_PARTITIONS, spark.read.schema(schema).parquet(source).count() // STATE_RECORDS)
    own = {"spark.sql.streaming.stateStore.providerClass": ROCKSDB, "spark.sql.streaming.internal.stateStore.partitions": str(parts), "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true", "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": str(STATE_MB)}
    before = {k: spark.conf.get(k, None) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    try:
        query = state.writeStream.outputMode("update").foreachBatch(emit).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    kinds = {f.name: f.dataType for f in state.schema}
    done = query.recentProgress
    if not any(p["numInputRows"] for p in done):
        return spark.createDataFrame([], state.schema)
    told = spark.read.parquet(f"{at}/state")
    last = told.groupBy("digest").agg(F.max_by(F.struct("keep", "group_size"), "batch").alias("s"))
    return last.select("digest", F.col("s.keep").cast(kinds["keep"]).alias("keep"), "s.group_size")


def duplicates(docs: DataFrame, digest: Callable[[Column], Column] = sha256, id_col: str = "doc_id", text_col: str = "text", files: int = FILES_PER_TRIGGER) -> DataFrame:
    """One row per row of docs: doc_id, digest, keep_id, keep_locator, group_size, kept."""
    spark = docs.sparkSession
    log = records(docs, digest, id_col, text_col)
    source = new_path(spark, "records")
    log.write.parquet(source)
    at, log = new_path(spark, "dedup"), spark.read.schema(log.schema).parquet(source)
    groups = written(fold(spark, source, log.schema, at, files), "groups")
    dropped(spark, at)

    # No more than HOT digests make up one in HOT of all rows each: those meet their rows by broadcast, the others in a join
    # in which no digest has more rows than that.
    least = log.count() // HOT + 1
    hot, cool = F.broadcast(groups.where(F.col("group_size") >= least)), groups.where(F.col("group_size") < least)
    result = written(log.join(hot, "digest").unionByName(log.join(hot, "digest", "left_anti").join(cool, "digest")), "placed")

    # Rows of a digest are dealt by identifier too, and each task hands on the least and the greatest text it has seen.
    hits = result.where("group_size > 1").select("digest", "at.doc_id").distinct()
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    full = docs.select(digest(no_white(text)).alias("digest"), F.col(id_col).cast("long").alias("doc_id"), no_white(text).alias("norm"))
    same = (full["digest"] == hits["digest"]) & full["doc_id"].eqNullSafe(hits["doc_id"])
    bounds = full.join(hits, same, "left_semi").groupBy("digest").agg(F.min("norm").alias("low"), F.max("norm").alias("high"))
    unequal = written(bounds.where("low <> high").select("digest"), "unequal")
    if not unequal.isEmpty():
        rows = docs.select(digest(no_white(text)).alias("digest"), no_white(text).alias("norm"), place(id_col, text_col).alias("at"))
        rows = written(rows.join(unequal, "digest", "left_semi"), "unequal-rows")
        own = rows.groupBy("digest", "norm").agg(F.min("at").alias("keep"), F.count("*").alias("group_size"))
        result = result.join(unequal, "digest", "left_anti").unionByName(rows.join(own, ["digest", "norm"]).drop("norm"))
    return result.select(F.col("at.doc_id").alias("doc_id"), "digest", F.col("keep.doc_id").alias("keep_id"), F.col("keep.locator").alias("keep_locator"), "group_size", (F.col("at.row") == F.col("keep.row")).alias("kept"))


def keep(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns."""
    found = written(duplicates(docs, id_col=id_col, text_col=text_col).select("doc_id", "digest", "kept"), "kept")
    again = written(found.groupBy(F.col("doc_id").alias("__kept")).count().where("count > 1 or __kept is null").select("__kept"), "again")
    stay = found.where("kept").select(F.col("doc_id").alias("__kept"), F.col("digest").alias("__own"))
    out = docs.join(stay, F.col(id_col) == F.col("__kept"), "left_semi")
    if again.isEmpty():
        return out
    # Rows without an identifier or with one that others have too are told apart by digest, then by length.
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    marked = docs.join(again, F.col(id_col).eqNullSafe(F.col("__kept")), "left_semi").withColumn("__digest", sha256(no_white(text)))
    same = F.col(id_col).eqNullSafe(F.col("__kept")) & (F.col("__digest") == F.col("__own"))
    order = Window.partitionBy(id_col, "__digest").orderBy(F.desc(F.length(text)))
    once = marked.join(stay, same, "left_semi").withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n", "__digest")
    return out.join(again, F.col(id_col) == F.col("__kept"), "left_anti").unionByName(once)


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact duplicates among all documents."""
    found = duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP8_SQL = r"""
WITH n AS (SELECT doc_id, coalesce(text, '') AS text, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents)
SELECT doc_id, first_value(doc_id) OVER (PARTITION BY norm ORDER BY length(text) DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       row_number() OVER (PARTITION BY norm ORDER BY length(text) DESC, doc_id) = 1 AS kept, sha256(norm) AS text_sha256
FROM n
"""
