"""Best-fit packing of token sequences with certified bounds.

Documents are tokenized and closed with an end token; only those longer than a sequence are cut, so that the first piece
takes what is left over and every other one fills a sequence by itself. The other pieces are dealt to partitions of a
bounded number of pieces. Each partition packs its own by best-fit decreasing and computes lower bounds on its number of
sequences from dual-feasible functions (the plain volume, Fekete and Schepers' thresholds and their rounding functions).
A partition that meets its bound is certified; one without gaps is done. Pieces of the others are exchanged, for what is
best for each may not be best for all: they are dealt anew into half as many partitions (up to LARGEST pieces each, which is
what a task holds) and packed again, and the outcome is taken if it needs fewer sequences. This goes on until the bound for
all pieces together (global_bound(), from the counts of their lengths) is met or a round gains nothing.

Null text counts as empty: such a document is its end token. Rows that repeat are packed each for itself. Extra columns
are left aside. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkweave.llm import bpe
from sparkweave.llm._common import clean_id, in_batches, table, written
from sparkweave.llm.tokens import vocabulary

SIZE = 1024
END = 2
#: Pieces of a partition at first, and at most.
PARTITION, LARGEST = 20_000, 500_000

PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
PIECES_SQL = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = pa.schema([*PIECES, ("item", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("bins", pa.int64()), ("bound", pa.int64()), ("volume", pa.int64())])
PACKED_SQL = PIECES_SQL + ", item long, sequence_id long, offset long, bins long, bound long, volume long"
#: Marks the sequences that one piece fills.
FULL = 1 << 61


def piece_starts(length: int, size: int) -> list[int]:
    """Where the pieces of a document of that many ids begin."""
    return [0, *range(length % size or size, length, size)]


def pieces(docs: DataFrame, vocab: str, size: int = SIZE, end: int = END, ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece; ids adds its ids as a binary of little-endian unsigned 32-bit integers."""
    schema = pa.schema([*PIECES, *[("ids", pa.binary())] * ids])
    shared = docs.sparkSession.sparkContext.broadcast(vocab)
    last = end.to_bytes(4, "little")

    def work(batch):
        out: dict[str, list] = {f.name: [] for f in schema}
        for doc_id, coded in zip(batch.column(0).to_pylist(), bpe.load(shared.value).encode(batch.column(1).to_pylist())):
            blob = coded + last
            starts = piece_starts(len(blob) // 4, size)
            for piece, (a, b) in enumerate(zip(starts, [*starts[1:], len(blob) // 4])):
                own = blob[4 * a : 4 * b]
                row = (doc_id, piece, a, b - a, zlib.crc32(own), own)
                for name, value in zip(out, row):
                    out[name].append(value)
        yield out

    return clean_id(docs, id_col, text_col).mapInArrow(in_batches(work, schema, True), PIECES_SQL + ", ids binary" * ids)


def lower_bound(sizes: np.ndarray, size: int) -> int:
    return bound_of(np.bincount(sizes, minlength=size + 1).astype(np.int64), size)


def global_bound(cut: DataFrame, size: int = SIZE) -> int:
    """The fewest sequences that pieces() can be packed into, as far as it is proven; at most size counts reach the driver."""
    count = np.zeros(size + 1, np.int64)
    for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect():
        count[r["length"]] = r["n"]
    return bound_of(count, size)


def bound_of(count: np.ndarray, size: int) -> int:
    """The most sequences that a dual-feasible function proves to be needed, given how many pieces each length has."""
    value = np.arange(size + 1, dtype=np.int64)
    best = -(-int((count * value).sum()) // size)
    volume, number = np.cumsum(count * value), np.cumsum(count)
    for least in range(1, size // 2 + 1):  # lengths over size - least count as whole, those under least as nothing
        total = int(number[size] - number[size - least]) * size + int(volume[size - least] - volume[least - 1])
        best = max(best, -(-total // size))
    for k in range(1, 33):
        scaled = (k + 1) * value
        rounded = np.where(scaled % size == 0, k * value, scaled // size * size)
        best = max(best, -(-int((count * rounded).sum()) // (k * size)))
    return best


def best_fit_decreasing(sizes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Sequence and offset of each piece, and the number of sequences."""
    order = np.argsort(-sizes, kind="stable")
    where, offset = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    open_by_room: list[list[int]] = [[] for _ in range(size + 1)]
    rooms = 0  # bit r: some sequence has room r
    bins = 0
    for at, need in zip(order.tolist(), sizes[order].tolist()):
        fit = rooms >> need
        if fit:
            room = need + (fit & -fit).bit_length() - 1
            own = open_by_room[room]
            b = own.pop()
            if not own:
                rooms ^= 1 << room
        else:
            b, room, bins = bins, size, bins + 1
        where[at], offset[at] = b, size - room
        room -= need
        if room:
            if not open_by_room[room]:
                rooms |= 1 << room
            open_by_room[room].append(b)
    return where, offset, bins


def packer(number: int, size: int):
    """For applyInArrow over the pieces of one partition, in round number."""

    def run(own: pa.Table) -> pa.Table:
        own = own.sort_by([("item", "ascending")])
        sizes = own["length"].to_numpy()
        where, offset, bins = best_fit_decreasing(sizes, size)
        group = own["part"][0].as_py()
        ids = (number << 48) + (group << 20) + where  # LARGEST pieces at most are below 2^20 sequences
        cols = {"sequence_id": ids, "offset": offset, "bins": np.full(len(sizes), bins), "bound": np.full(len(sizes), lower_bound(sizes, size)), "volume": np.full(len(sizes), int(sizes.sum()) // size)}
        return pa.table([pa.array(cols[f.name]) if f.name in cols else own[f.name] for f in PACKED], schema=PACKED)

    return run


def pack(cut: DataFrame, size: int = SIZE, partition: int = PARTITION, largest: int = LARGEST) -> DataFrame:
    """The rows of pieces() with sequence_id, offset, and certified: whether the partition's number of sequences is least."""
    cut = written(cut.withColumn("item", F.monotonically_increasing_id()), "pieces")
    names = [f.name for f in PIECES]
    full = cut.where(F.col("length") == size).select(*names, (F.col("item") + F.lit(FULL)).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), F.lit(True).alias("certified"))
    done = [full]
    left, target, before, closed, number = cut.where(F.col("length") < size), partition, None, 0, 0
    least, count = global_bound(left, size), left.count()
    while count:
        part = F.pmod(F.xxhash64("item", F.lit(number)), F.lit(-(-count // target)))
        tried = written(left.select(*names, "item", part.alias("part")).groupBy("part").applyInArrow(packer(number, size), PACKED_SQL), "packed")
        bins, now, count = tried.agg(F.count_if(F.expr("offset = 0")), F.count_if(F.expr("offset = 0 and bins > volume")), F.count_if(F.expr("bins > volume"))).first()
        if before is not None and bins >= before[1]:
            break  # the last round's outcome stays
        if before is not None:
            done[-1] = before[0].where("bins <= volume")
        done.append(tried)
        if closed + bins <= least:
            break  # no packing needs fewer
        before, closed = (tried, now), closed + bins - now
        left, target, number = tried.where("bins > volume"), min(largest, 2 * target), number + 1
    out = [done[0], *(d.select(*names, "sequence_id", "offset", (F.col("bins") <= F.col("bound")).alias("certified")) for d in done[1:])]
    return reduce(DataFrame.unionByName, out)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences."""
    found = pack(pieces(table(spark, sf_dir, "documents"), vocabulary()))
    return found.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "certified")
