"""What the operators share: the shared folder, tables written to cut lineage, Arrow batches, connected components."""

from __future__ import annotations

import contextlib
import ctypes
import re
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most bytes of variable-length values in one Arrow batch that Python gives back.
BATCH_BYTES = 8_000_000
#: Most bytes of an Arrow batch that Python gets.
ARROW_BYTES = 4_000_000
#: Bytes of an Arrow batch that are worked on at once.
PIECE_BYTES = 4_000_000
#: The ASCII white space [\x20\x09-\x0D] (fixed values).
WHITE = " \t\n\x0b\x0c\r"
LONG_WHITE = re.compile(rb"[\x20\x09-\x0D]+")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only where spark.checkpoint.dir is unset and Spark runs in
    this one process, as in tests."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read again: computed once, and safe when executors are lost. Shuffle files of the work
    are given up at once; else they stay until the driver happens to collect its garbage."""
    spark, at = df.sparkSession, new_path(df.sparkSession, name)
    df.write.parquet(at)
    spark._jvm.System.gc()
    out = spark.read.schema(df.schema).parquet(at)
    out.written_at = at
    return out


def dropped(spark: SparkSession, *tables: DataFrame | str) -> None:
    """Deletes tables of written(), or folders, that nothing reads any more."""
    for t in tables:
        path = spark._jvm.org.apache.hadoop.fs.Path(t if isinstance(t, str) else t.written_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession) -> None:
    """Arrow batches between JVM and Python of ARROW_BYTES at most, from now on in this session."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def release() -> None:
    """Gives memory that a task no longer uses back to the system; a worker outlives its tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], encodes: bool = False) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, with release() at its end. A worker that encoded before lets go of its known words, unless it is to encode."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not encodes and (bpe := sys.modules.get("sparkweave.llm.bpe")) and bpe.load.cache_info().currsize:
            bpe.load.cache_clear()
            release()
        yield from run(batches)
        release()

    return work


def clean_id(docs: DataFrame, id_col: str, *cols: str) -> DataFrame:
    """Only the columns an operator uses, so that others can't clash with the names it makes."""
    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), *(F.col(c) for c in cols))


def in_batches(work: Callable[[pa.RecordBatch], Iterable[dict[str, list | pa.Array]]], schema: pa.Schema, encodes: bool = False) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow; work gives columns by name for each batch of at most about PIECE_BYTES."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                for cols in work(piece):
                    yield from cut(cols, schema)

    return released(run, encodes)


def pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """batch in runs of rows of about PIECE_BYTES; a larger row stands alone."""
    ends = np.cumsum(sum(sizes(c) for c in batch.columns))
    start = 0
    while start < batch.num_rows:
        end = int(np.searchsorted(ends, (ends[start - 1] if start else 0) + PIECE_BYTES, "right"))
        end = max(end, start + 1)
        yield batch.slice(start, end - start)
        start = end


def sizes(column: pa.Array) -> np.ndarray:
    """Bytes of each value, near enough."""
    if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
        return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    if pa.types.is_list(column.type):
        return 8 * pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.full(len(column), 8)


def cut(cols: dict[str, list | pa.Array], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Record batches of at most about BATCH_BYTES each."""
    arrays = [c if isinstance(c, pa.Array) else pa.array(c, f.type) for f, c in ((f, cols[f.name]) for f in schema)]
    whole = pa.RecordBatch.from_arrays(arrays, schema=schema)
    rows = whole.num_rows
    step = max(1, min(rows, int(rows * BATCH_BYTES / max(1, whole.nbytes))))
    for at in range(0, rows, step):
        yield whole.slice(at, step)


def planes(a: np.ndarray) -> bytes:
    """Bytes of an array, most alike ones together."""
    return np.ascontiguousarray(a.view(np.uint8).reshape(-1, a.itemsize).T).tobytes()


def unplaned(columns: pa.ChunkedArray, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    parts = [np.ascontiguousarray(np.frombuffer(x, np.uint8).reshape(width, -1).T).view(kind)[:, 0] for x in columns.to_pylist() if x]
    return np.concatenate(parts) if parts else np.zeros(0, kind)


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of a text column, null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def one_blank(text: bytes) -> bytes:
    """The words of a text joined by one blank; those of a long one aren't made one by one."""
    return LONG_WHITE.sub(b" ", text).strip(b" ") if len(text) > PIECE_BYTES else b" ".join(text.split())


def word_bounds(joined: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in words joined by one blank."""
    if not joined:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    blanks = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    return np.concatenate([[0], blanks + 1]), np.append(blanks, len(joined))


def no_white(text: Column) -> Column:
    """text without the characters [\\x20\\x09-\\x0D]."""
    for c in WHITE:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """(node, root) for every node of edges (u, v); root is the smallest node of the component.

    Alternating large-star and small-star steps; each step is one aggregation and one join, writes its edges to the
    shared folder, and keeps at most as many edges as there were. Nothing but two numbers per step reaches the driver.
    """
    def step(edges: DataFrame, large: bool) -> DataFrame:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        out = both.join(low, "u")
        if large:
            out = out.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            out = out.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        return out.where("u <> v").distinct()

    def mark(edges: DataFrame) -> tuple:
        return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    edges = written(edges.where("u <> v").distinct(), "edges")
    seen = mark(edges)
    if seen[0]:
        for _ in range(most):
            before, edges = edges, written(step(step(edges, True), False), "edges")
            now = mark(edges)
            dropped(edges.sparkSession, before)
            if now == seen:
                break
            seen = now
        else:
            raise RuntimeError(f"components need more than {most} steps")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
