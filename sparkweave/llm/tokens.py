"""Tokenizing of document tables; the encoder itself is in bpe.py.

A null text counts as empty and has no tokens; an empty table gives an empty result; other columns are left aside, so
their names can't clash; rows that repeat are encoded each for itself.
"""

from __future__ import annotations

from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkweave.llm import bpe
from sparkweave.llm._common import clean_id, in_batches, table


def vocabulary(path: str | None = None) -> str:
    """Text of a byte-level tokenizer file, by default that of public_tokenizers; read on the driver, about 1.5 MB."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    return Path(path).read_text(encoding="utf-8")


def encode(docs: DataFrame, vocab: str, decoded: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids) with ids as a binary of little-endian unsigned 32-bit integers; decoded adds the text they stand for."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), *[("decoded", pa.string())] * decoded])
    shared = docs.sparkSession.sparkContext.broadcast(vocab)

    def work(batch):
        own = bpe.load(shared.value)
        ids = own.encode(batch.column(1).to_pylist())
        yield {"doc_id": batch.column(0), "ids": ids} | ({"decoded": [own.decode(x) for x in ids]} if decoded else {})

    return clean_id(docs, id_col, text_col).mapInArrow(in_batches(work, schema, True), "doc_id long, ids binary" + ", decoded string" * decoded)


def decode(coded: DataFrame, vocab: str) -> DataFrame:
    """coded (doc_id, ids) with the column decoded."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("decoded", pa.string())])
    shared = coded.sparkSession.sparkContext.broadcast(vocab)

    def work(batch):
        own = bpe.load(shared.value)
        yield {"doc_id": batch.column(0), "ids": batch.column(1), "decoded": [own.decode(x or b"") for x in batch.column(1).to_pylist()]}

    return coded.select("doc_id", "ids").mapInArrow(in_batches(work, schema, True), "doc_id long, ids binary, decoded string")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded and decoded again."""
    coded = encode(table(spark, sf_dir, "documents"), vocabulary(), decoded=True)
    return coded.select("doc_id", F.expr("cast(octet_length(ids) div 4 as long)").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
