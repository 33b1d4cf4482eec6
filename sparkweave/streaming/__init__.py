"""Records as a stream: entities are made row by row, so the same function serves batch and stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from sparkweave.operators.entity import entities
from sparkweave.sources.records import RECORD


def entity_stream(spark: SparkSession, folder: str, schema: T.StructType = RECORD) -> DataFrame:
    """Entities of the tab-separated files that arrive in a folder."""
    return entities(spark.readStream.csv(folder, sep="\t", header=True, quote="", schema=schema, emptyValue=""))
