"""From raw documents to packed training sequences: each stage applies one operator to all that the one before kept."""

from __future__ import annotations

from collections.abc import Callable
from itertools import count

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkweave.llm import exact, langid, packing, simhash, substring, tokens
from sparkweave.llm._common import table, written

#: Words of a shingle and independent fingerprints of the near-duplicate stage.
SHINGLE, VIEWS = 5, 8


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that can be told; those without text or letters go."""
    return langid.keep(docs)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The longest document of each group of equal texts."""
    return exact.keep(docs)


def numbered(docs: DataFrame) -> DataFrame:
    """docs with __row, a hash of doc_id and text that no other row has; of rows that repeat both, one stays. Nothing of the texts
    is written: where different rows share a hash, as a second one shows, all get others."""
    for seed in count():
        own, more = (F.xxhash64(F.lit(2 * seed + i), "doc_id", "text") for i in range(2))
        rows = docs.withColumn("__row", own)
        shared = rows.select("__row", more.alias("more")).groupBy("__row").agg(F.count("*").alias("n"), F.min("more").alias("low"), F.max("more").alias("high")).where("n > 1")
        shared = written(shared, "shared")
        if shared.where("low <> high").isEmpty():
            break
    if shared.isEmpty():
        return rows
    again = rows.join(shared, "__row", "left_semi").dropDuplicates(["__row"])
    return rows.join(shared, "__row", "left_anti").unionByName(again)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id (null last) of each group linked by five-word similarities of 0.8 or more."""
    rows = numbered(docs)
    found = written(simhash.similar(rows, k=SHINGLE, views=VIEWS, id_col="__row").select(F.col("node").alias("__row"), "root"), "groups")
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "__row")
    own = rows.select("doc_id", "__row").join(found, "__row")
    stay = own.groupBy("root").agg(F.min(first).alias("first")).select(F.col("first.__row").alias("__row"))
    gone = found.join(stay, "__row", "left_anti")
    return rows.join(gone, "__row", "left_anti").select(docs.columns)


def remove_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages that came earlier."""
    others = tuple(c for c in docs.columns if c not in ("doc_id", "text", "n_chars"))
    found = substring.remove_repeats(docs, carry=others, whole=True)
    return found.withColumnRenamed("kept", "text").withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, placed in sequences."""
    return packing.pack(packing.pieces(docs, tokens.vocabulary()))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language ID", identify_language),
    ("exact dedup", drop_exact_copies),
    ("SimHash near-dedup", drop_near_copies),
    ("substring dedup", remove_repeated_passages),
    ("best-fit packing", pack_sequences),
]

#: Language machines and tokenizers are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = written(stage(spark, docs, sf_dir), f"stage-{number}")
    return docs
