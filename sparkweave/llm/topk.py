"""Exact top-k search by inner product with an impact-ordered, score-at-a-time index.

Components are quantised to integers, floor(64 * x). Vectors are dealt to blocks of a bounded size by a written row number;
a task builds the index of one block at a time, once, and the queries stream past it in chunks. The index has posting
segments: for each dimension the vectors whose component lies in one of RANGES ranges of values, as a list or, if many do, as
a column with zeros for the others. For a query the impact of a posting is the component times the value, less the least
impact of the dimension; that of a segment is the greatest in it.

Each query takes the segments of all dimensions by its own descending impact, quantised to LEVELS steps of the greatest one,
and adds the exact impacts to the accumulators of their vectors. After each step it tries a proof: a vector can still gain no
more than the sum over dimensions of the next impact there. Processing stops only when that leaves few possible members of
the k highest (or no segment); those are scored exactly from their vectors. The k best of each block meet in one ranking, so
k rows for each query and block are shuffled.

Vectors that are null or hold a null or non-finite component take no part; shorter vectors count as filled up with zeros.
A query's own row (any with its vec_id) is no candidate. Ties go to the smaller vec_id; rows that repeat a vec_id rank
each for itself. Other columns are left aside; an empty table or one without queries gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkweave.llm._common import cut, released, small_batches, table, written

SCALE = 64
K = 20
#: Vectors of a block and queries of a chunk, about.
BLOCK, CHUNK = 16_384, 256
#: Ranges of values of a dimension, and steps of quantised impact.
RANGES, LEVELS = 4, 32
#: Share of a block from which on a segment is a column.
MANY = 1 / 8
#: Share of a block's vectors that may be left to exact scoring when processing stops.
LEFT = 1 / 64

PACK = pa.schema([("part", pa.int64()), ("ids", pa.binary()), ("vectors", pa.binary())])
FOUND = pa.schema([("query_id", pa.int64()), ("query_row", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64()), ("processed", pa.float64())])
FOUND_SQL = "query_id long, query_row long, vec_id long, score long, processed double"


class Index:
    """Posting segments of a block of integer vectors, in order of the dimension and the range of values."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, ranges: int = RANGES):
        self.ids, self.vectors = ids, vectors
        n, width = vectors.shape
        high = int(np.abs(vectors.astype(np.int64)).max(initial=0))
        kind = np.float32 if 4 * width * high * high < 1 << 24 else np.float64 if 4 * width * high * high < 1 << 53 else np.int64
        self.counts = np.zeros((width, ranges), np.int64)
        # For queries with a positive and those with a negative component: the segments, and the greatest gain in each.
        self.segments: tuple[list, list] = ([], [])
        self.gains = np.zeros((2, width, ranges), np.int64)
        for d in range(width):
            own = vectors[:, d].astype(np.int64)
            low, top = int(own.min()), int(own.max())
            of = (own - low) * ranges // (top - low + 1)
            for r in range(ranges):
                places = np.flatnonzero(of == r)
                self.counts[d, r] = len(places)
                for sign, gain in enumerate((own[places] - low, top - own[places])):
                    self.gains[sign, d, r] = gain.max(initial=0)
                    if len(places) < MANY * n:
                        self.segments[sign].append((places, gain.astype(kind)))
                    else:
                        column = np.zeros(n, kind)
                        column[places] = gain
                        self.segments[sign].append((None, column))
        self.kind = kind

    def search(self, query: np.ndarray, query_id: int, k: int = K, left: float = LEFT, levels: int = LEVELS) -> tuple[np.ndarray, np.ndarray, float]:
        """Ids and scores of the k best of one query, in order, and the share of the postings that were processed."""
        n, query = len(self.ids), query.astype(np.int64)
        need = k + int((self.ids == query_id).sum())
        members, share = np.arange(n), 0.0
        if n > need:
            weight, sign = np.abs(query), (query < 0).astype(np.int64)
            impact = weight[:, None] * self.gains[sign, np.arange(len(query))]
            step = -(-impact * levels // max(1, int(impact.max())))
            order = np.argsort(-step, axis=None, kind="stable")
            ends = np.searchsorted(-step.ravel()[order], np.arange(-levels, 0), "right").tolist()
            acc, gain, at, width = np.zeros(n, self.kind), np.empty(n, self.kind), 0, self.counts.shape[1]
            for level, end in zip(range(levels, 0, -1), ends):
                if at == end:
                    continue
                for s in order[at:end].tolist():
                    d = s // width
                    places, gains = self.segments[sign[d]][s]
                    if places is None:
                        acc += np.multiply(gains, self.kind(weight[d]), out=gain)
                    else:
                        acc[places] += gains * self.kind(weight[d])
                at = end
                bound = int(np.where(step < level, impact, 0).max(1).sum())
                if bound and acc.mean() + bound >= acc.max():
                    continue  # then the average vector is a possible member yet
                members = np.flatnonzero(acc + self.kind(bound) >= np.partition(acc, n - need)[n - need])
                if len(members) <= max(left * n, need):
                    break
            share = float(self.counts.ravel()[order[:at]].sum()) / (n * len(query))
        members = members[self.ids[members] != query_id]
        scores = self.exact(members, query)
        best = np.lexsort((self.ids[members], -scores))[:k]
        return self.ids[members][best], scores[best], share

    def exact(self, members: np.ndarray, query: np.ndarray) -> np.ndarray:
        """Inner products as integers; floating point holds them exactly where all are small."""
        own = self.vectors[members]
        if own.dtype.itemsize == 2 and np.abs(query).max(initial=0) < 1 << 15:
            return np.rint(own.astype(float) @ query.astype(float)).astype(np.int64)
        return own.astype(np.int64) @ query


def packed(rows: DataFrame, part: Column, kind: str, width: int) -> DataFrame:
    """(part, ids, vectors): the rows of each part as two arrays; of ids, pairs of vec_id and row number."""

    def run(own: pa.Table) -> pa.Table:
        ids = np.stack([own["vec_id"].to_numpy(), own["row"].to_numpy()], 1)
        matrix = np.zeros((len(ids), width), kind)
        for row, vector in zip(matrix, own["v"].to_pylist()):
            row[: len(vector)] = vector
        return pa.table([[own["part"][0].as_py()], [ids.astype("<i8").tobytes()], [matrix.tobytes()]], schema=PACK)

    return rows.select(part.alias("part"), "vec_id", "row", "v").groupBy("part").applyInArrow(run, "part long, ids binary, vectors binary")


def answers(kind: str, width: int, k: int):
    """For mapInArrow over (block, asked, ids, vectors) sorted by block, each with its vectors first, then the chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, index = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                block, asked, ids, vectors = (batch.column(c)[i].as_py() for c in range(4))
                ids, vectors = np.frombuffer(ids, "<i8").reshape(-1, 2), np.frombuffer(vectors, kind).reshape(-1, width)
                if not asked:
                    at, index = block, Index(ids[:, 0].copy(), vectors)
                elif block == at:
                    out: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in FOUND]
                    for (query_id, row), query in zip(ids.tolist(), vectors):
                        found, scores, share = index.search(query, query_id, k)
                        for name, x in zip(out, (np.full(len(found), query_id), np.full(len(found), row), found, scores, np.full(len(found), share))):
                            name.append(x)
                    yield from cut({f.name: pa.array(np.concatenate(x), f.type) for f, x in zip(FOUND, out)}, FOUND)

    return released(run)


def search(vectors: DataFrame, is_query: Column, k: int = K, scale: int = SCALE, block: int = BLOCK, chunk: int = CHUNK, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score, processed) of the k best of each query; is_query is a condition on vec_id. processed:
    the share of the postings of that block which the query went through before its proof held."""
    spark = vectors.sparkSession
    small_batches(spark)
    v = F.transform(F.col(vector_col), lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    sound = F.forall(F.col(vector_col), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    rows = vectors.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & F.coalesce(sound, F.lit(False))).select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"), F.monotonically_increasing_id().alias("row"))
    rows = written(rows, "vectors")
    n, queries, width, high = rows.agg(F.count("*"), F.count_if(is_query), F.max(F.size("v")), F.max(F.greatest(F.array_max("v"), -F.array_min("v")))).first()
    if not queries:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long, processed double")
    kind = "<i2" if int(high or 0) < 1 << 15 else "<i8"
    blocks, chunks = -(-n // block), -(-queries // chunk)
    index = packed(rows, F.pmod(F.xxhash64("row"), F.lit(blocks)), kind, width)
    asked = written(packed(rows.where(is_query), F.pmod(F.xxhash64("row", F.lit(1)), F.lit(chunks)), kind, width), "chunks")
    work = index.select(F.col("part").alias("block"), F.lit(False).alias("asked"), "ids", "vectors").unionByName(
        asked.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"), F.lit(True).alias("asked"), "ids", "vectors")
    )
    found = work.repartition("block").sortWithinPartitions("block", "asked").mapInArrow(answers(kind, width, k), FOUND_SQL)
    order = Window.partitionBy("query_id", "query_row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", "processed")


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best of all vectors for those whose vec_id is divisible by 20."""
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0).select("query_id", "rank", "vec_id", "score")


OP7_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
