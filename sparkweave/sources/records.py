"""Reading records and truth, and the adapter that makes records of documents."""

from __future__ import annotations

from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkweave.functions.text import country_key

RECORD = T.StructType([T.StructField(c, T.StringType()) for c in ("entity_id", "business_name", "business_address", "country")])
TRUTH = T.StructType([T.StructField(c, T.StringType()) for c in ("source1_entity_id", "matched_entity_ids")])

RESULT = T.StructType([T.StructField(c, T.StringType()) for c in ("source1_entity_id", "matched_entity_ids")])


def data_paths(root: str, sample: bool = False) -> dict[str, str]:
    """Places of the seven inputs: flat for a sample, else under train and test."""
    at = lambda split, name: str(PurePosixPath(root) / name) if sample else f"{root.rstrip('/')}/{split}/{name}"
    out = {f"{split}_s{n}": at(split, f"{split}_source{n}.tsv") for split in ("train", "test") for n in (1, 2, 3)}
    return out | {"train_gt": at("train", "train_ground_truth.tsv")}


def read_tsv(spark: SparkSession, path: str, schema: T.StructType = RECORD, rows: int | None = None, rename: dict[str, str] | None = None) -> DataFrame:
    """All-text table with a header; blanks stay "", quotes are plain characters. rows: a limit of any rows."""
    df = spark.read.csv(path, sep="\t", header=True, quote="", escape="", schema=schema, mode="PERMISSIVE", nullValue="\0", emptyValue="")
    df = df.select(*(F.coalesce(F.col(f.name), F.lit("")).alias((rename or {}).get(f.name, f.name)) for f in schema))
    return df if rows is None else df.limit(rows)


def read_lines(spark: SparkSession, path: str, schema: T.StructType = RECORD) -> DataFrame:
    """read_tsv() with `line`, ascending in the order of the file's lines (files of a folder by their place in the plan)."""
    df = read_tsv(spark, path, schema).withColumn("__id", F.monotonically_increasing_id())
    first = df.groupBy(F.shiftright("__id", 33).alias("__part")).agg(F.count("*").alias("n"))
    before = first.select("__part", (F.sum("n").over(Window.orderBy("__part")) - F.col("n")).alias("__before"))  # a row for each split of the file
    line = F.col("__before") + F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))
    return df.withColumn("__part", F.shiftright("__id", 33)).join(F.broadcast(before), "__part").withColumn("line", line).drop("__part", "__id", "__before")


def of_country(records: DataFrame, country: str) -> DataFrame:
    return records.where(country_key(F.col("country")) == country.strip().upper())


def id_list(text: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != ""))


def truth_pairs(truth: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Source-1 identifiers, and true pairs (s1, cand); of rows that repeat an identifier the last by line counts.

    Lines have no order in Spark: give a column `line` where that matters, else the greatest list counts.
    """
    last = F.max_by("matched_entity_ids", "line") if "line" in truth.columns else F.max("matched_entity_ids")
    own = truth.where("trim(source1_entity_id) <> ''").groupBy(F.trim("source1_entity_id").alias("s1")).agg(last.alias("m"))
    return own.select("s1"), own.select("s1", F.explode(id_list(F.col("m"))).alias("cand"))


def first_truth(truth: DataFrame, s1: DataFrame, n: int, line: str = "line") -> tuple[DataFrame, DataFrame, DataFrame]:
    """The first n rows of truth by their line number, their records of source 1, and their true pairs."""
    own = truth.where(F.col(line) < n)
    ids, pairs = truth_pairs(own)
    return own, s1.join(ids.select(F.col("s1").alias("entity_id")), "entity_id", "left_semi"), pairs


def lookup(records: DataFrame, ids: DataFrame) -> DataFrame:
    """The records of some identifiers (entity_id), one row each: the rest of a file is filtered out as it is read."""
    return records.join(F.broadcast(ids.distinct()) if ids.isLocal() else ids.distinct(), "entity_id", "left_semi").dropDuplicates(["entity_id"])


def training_pool(pool: DataFrame, pairs: DataFrame, first: int, line: str = "line") -> DataFrame:
    """Records that are true targets or among the first by their line number."""
    targets = pairs.select(F.col("cand").alias("entity_id")).distinct().withColumn("wanted", F.lit(True))
    return pool.join(targets, "entity_id", "left").where(F.col("wanted") | (F.col(line) < first)).drop("wanted")


def documents_as_records(docs: DataFrame) -> DataFrame:
    """Records of three sources: every two lines of a text are a name and an address, the language is the country.

    Lines without any character but blanks don't count; a text without lines is one blank record. Nothing is cut off.
    """
    lines = F.filter(F.split(F.coalesce(F.col("text"), F.lit("")), "\n"), lambda x: F.trim(x) != "")
    each = F.sequence(F.lit(0), F.greatest((F.size(lines) + 1).cast("double") / 2 - 1, F.lit(0.0)).cast("int"))
    rows = docs.select("doc_id", "lang", lines.alias("lines"), F.explode(each).alias("at"))
    line = lambda more: F.coalesce(F.get("lines", 2 * F.col("at") + more), F.lit(""))
    return rows.select(
        F.concat(F.lit("S"), (F.col("doc_id") % 3 + 1).cast("string"), F.lit("-"), F.col("doc_id").cast("string"), F.lit("-"), F.col("at").cast("string")).alias("entity_id"),
        line(0).alias("business_name"),
        line(1).alias("business_address"),
        F.upper(F.coalesce(F.col("lang"), F.lit(""))).alias("country"),
    )


def results(entities: DataFrame, pairs: DataFrame, name: str = "matched_entity_ids") -> DataFrame:
    """Every source-1 identifier with its sorted, comma-joined partners, "" for none."""
    own = pairs.groupBy("s1").agg(F.array_join(F.array_sort(F.collect_set("cand")), ",").alias("ids"))
    return entities.join(own, "s1", "left").select(F.col("s1").alias("source1_entity_id"), F.coalesce("ids", F.lit("")).alias(name))


def in_input_order(df: DataFrame, source1: DataFrame, line: str = "line") -> DataFrame:
    """Result rows in the order in which source 1 has its records; what it doesn't have goes last."""
    order = source1.groupBy(F.col("entity_id").alias("source1_entity_id")).agg(F.min(line).alias("__line"))
    return df.join(order, "source1_entity_id", "left").orderBy(F.col("__line").asc_nulls_last(), "source1_entity_id").drop("__line")


def write_results(df: DataFrame, path: str) -> None:
    """Tab-separated files in the order of the rows."""
    df.write.mode("overwrite").csv(path, sep="\t", header=True, quote="", emptyValue="")


def finished(spark: SparkSession, path: str) -> set[str]:
    """Countries whose partitions are there already; for resuming."""
    try:
        return {r[0] for r in spark.read.parquet(path).select("country").distinct().collect()}
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER" in str(e):
            return set()
        raise


def read_back(spark: SparkSession, path: str, source1: DataFrame, line: str = "line") -> DataFrame:
    """The results of all countries that write_country() left, in the order of source 1."""
    return in_input_order(spark.read.parquet(path).drop("country"), source1, line)


def write_country(df: DataFrame, path: str, country: str) -> None:
    """Only this country's partition is replaced."""
    df.withColumn("country", F.lit(country)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("country").parquet(path)
