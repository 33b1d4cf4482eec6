"""Checks of result tables: one DataFrame of violations (file, rule, severity, id)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEVELS = {"strict": "error", "lenient": "warning"}


def _ids(text: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")


def violations(rows: DataFrame, column: str, entities: DataFrame, known: DataFrame | None = None, name: str = "matching") -> DataFrame:
    """Of rows (source1_entity_id, column): repeated records, repeated or own or wrongly named or unknown partners, missing
    and extra records. known (entity_id) is only checked where given.

    What a row shows by itself is found in one pass; records are counted and met with entities once.
    """
    own = rows.select(F.trim("source1_entity_id").alias("s1"), _ids(F.col(column)).alias("ids"))
    broken = lambda rule, id_: F.struct(F.lit(rule).alias("rule"), id_.alias("id"))
    named = lambda p: F.exists(F.array(*map(F.lit, ("S1-", "S2-", "S3-"))), lambda x: p.startswith(x))
    each = F.concat(
        F.when(F.size("ids") > F.size(F.array_distinct("ids")), F.array(broken("duplicate_id", F.col("s1")))).otherwise(F.array()),
        F.transform(F.filter("ids", lambda x: x.startswith("S1-")), lambda x: broken("self_match", x)),
        F.transform(F.filter("ids", lambda x: ~named(x)), lambda x: broken("wrong_prefix", x)),
    )
    counts = own.groupBy("s1").agg(F.count("*").alias("n")).join(entities.select("s1", F.lit(True).alias("there")), "s1", "full")
    of_record = F.filter(F.array(F.when(F.col("n") > 1, "duplicate_row"), F.when(F.col("n").isNull(), "missing_row"), F.when(F.col("there").isNull(), "extra_row")), lambda x: x.isNotNull())
    out = own.select(F.explode(each).alias("x")).select("x.rule", "x.id").unionByName(counts.select(F.explode(of_record).alias("rule"), F.col("s1").alias("id")))
    if known is not None:
        flat = own.select(F.explode("ids").alias("id")).join(known.select(F.col("entity_id").alias("id")), "id", "left_anti")
        out = out.unionByName(flat.select(F.lit("unknown_id").alias("rule"), "id"))
    return out.select(F.lit(name).alias("file"), "rule", F.lit("error").alias("severity"), "id")


def containment(matches: DataFrame, candidates: DataFrame, level: str = "lenient") -> DataFrame:
    """Matched pairs that aren't candidates; an error or a warning."""
    flat = lambda df, c: df.select(F.trim("source1_entity_id").alias("s1"), F.explode(_ids(F.col(c))).alias("cand"))
    bad = flat(matches, "matched_entity_ids").join(flat(candidates, "candidate_entity_ids"), ["s1", "cand"], "left_anti")
    return bad.select(F.lit("matching").alias("file"), F.lit("not_a_candidate").alias("rule"), F.lit(LEVELS[level]).alias("severity"), F.concat_ws(">", "s1", "cand").alias("id"))


def header(columns: list[str], expected: list[str]) -> list[str]:
    """What is wrong with a header, case aside."""
    return [] if [c.strip().lower() for c in columns] == expected else [f"expected {expected}, found {columns}"]


def audit(matches: DataFrame, candidates: DataFrame, entities: DataFrame, known: DataFrame | None = None, level: str = "strict") -> DataFrame:
    """Everything that the validators check of both tables."""
    return violations(matches, "matched_entity_ids", entities, known).unionByName(violations(candidates, "candidate_entity_ids", entities, known, "candidates")).unionByName(containment(matches, candidates, level))


def distribution(matches: DataFrame, entities: DataFrame) -> DataFrame:
    """By country: records with none, one and several partners, and all partners."""
    n = matches.select(F.col("source1_entity_id").alias("s1"), F.size(_ids(F.col("matched_entity_ids"))).alias("n"))
    return entities.join(n, "s1", "left").fillna(0, ["n"]).groupBy("country").agg(F.count_if(F.col("n") == 0).alias("zero"), F.count_if(F.col("n") == 1).alias("one"), F.count_if(F.col("n") > 1).alias("multi"), F.sum("n").alias("partners"))
