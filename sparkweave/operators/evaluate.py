"""Metrics of links against truth, as DataFrames. Truth and links are distinct pairs (s1, cand)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkweave.sources.store import materialized


def f_beta(tp: Column, fp: Column, fn: Column, beta: float = 0.5) -> Column:
    """1 where nothing is true and nothing linked, 0 where only one of them is empty or nothing is right."""
    p, r, b = tp / (tp + fp), tp / (tp + fn), beta * beta
    return F.when(tp + fp + fn == 0, 1.0).when(tp == 0, 0.0).otherwise((1 + b) * p * r / (b * p + r))


def per_entity(truth: DataFrame, links: DataFrame, entities: DataFrame, by: list[str] | None = None, beta: float = 0.5) -> DataFrame:
    """For every record of entities: tp, fp, fn, n_true, n_pred, f, p, r."""
    by = ["s1", *(by or [])]
    both = truth.select(*by, "cand", F.lit(1).alias("t"), F.lit(0).alias("l")).unionByName(links.select(*by, "cand", F.lit(0).alias("t"), F.lit(1).alias("l")))
    pairs = both.groupBy(*by, "cand").agg(F.max("t").alias("t"), F.max("l").alias("l"))
    sums = pairs.groupBy(*by).agg(F.sum(F.col("t") * F.col("l")).alias("tp"), F.sum((1 - F.col("t")) * F.col("l")).alias("fp"), F.sum(F.col("t") * (1 - F.col("l"))).alias("fn"))
    tp, fp, fn = (F.coalesce(F.col(c), F.lit(0)) for c in ("tp", "fp", "fn"))
    rate = lambda part, of: F.when(of > 0, part / of).otherwise(F.when(tp + fp + fn == 0, 1.0).otherwise(0.0))
    return entities.join(sums, by, "left").select(*entities.columns, tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), (tp + fn).alias("n_true"), (tp + fp).alias("n_pred"), f_beta(tp, fp, fn, beta).alias("f"), rate(tp, tp + fp).alias("p"), rate(tp, tp + fn).alias("r"))


def summary(counts: DataFrame, *by: str) -> DataFrame:
    """Macro means and micro rates over records, for all or by columns."""
    tp, fp, fn = F.sum("tp"), F.sum("fp"), F.sum("fn")
    return counts.groupBy(*by).agg(F.count("*").alias("entities"), F.avg("f").alias("macro_f"), F.avg("p").alias("macro_p"), F.avg("r").alias("macro_r"), tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), F.coalesce(F.try_divide(tp, tp + fp), F.lit(0.0)).alias("micro_p"), F.coalesce(F.try_divide(tp, tp + fn), F.lit(0.0)).alias("micro_r"))


def cardinality() -> Column:
    return F.when(F.col("n_true") == 0, "zero").when(F.col("n_true") == 1, "one").otherwise("multi")


def slices(counts: DataFrame) -> DataFrame:
    """The summary for all, by cardinality and by country at once."""
    rows = counts.select("*", F.explode(F.array(F.struct(F.lit("all").alias("slice"), F.lit("all").alias("value")), F.struct(F.lit("cardinality").alias("slice"), cardinality().alias("value")), F.struct(F.lit("country").alias("slice"), F.col("country").alias("value")))).alias("x"))
    return summary(rows.select("*", "x.slice", "x.value"), "slice", "value")


def by_target(truth: DataFrame, links: DataFrame, entities: DataFrame, prefix: str, beta: float = 0.5) -> DataFrame:
    """Per-record metrics with truth and links of one source only."""
    own = F.col("cand").startswith(prefix)
    return per_entity(truth.where(own), links.where(own), entities, beta=beta)


def folds(pairs: DataFrame, n: int = 5) -> DataFrame:
    """(s1, fold): records to folds of like size in pairs, by descending count in snake order.

    Equal counts are ordered by last character and then identifier, so that places come from counts of groups and from
    windows within groups, and no window takes all records.
    """
    return dealt(pairs.groupBy("s1").agg(F.count("*").alias("n")), n)


def dealt(counts: DataFrame, n: int = 5) -> DataFrame:
    """folds() of records with as many pairs as counts (s1, n) tells."""
    counts = counts.withColumn("last", F.right("s1", F.lit(1)))
    groups = counts.groupBy("n", "last").agg(F.count("*").alias("size"))
    before = groups.withColumn("before", F.sum("size").over(Window.orderBy(F.desc("n"), "last")) - F.col("size")).drop("size")
    own = F.row_number().over(Window.partitionBy("n", "last").orderBy("s1")) - 1
    placed = counts.withColumn("own", own).join(before, ["n", "last"]).withColumn("turn", F.pmod(F.col("own") + F.col("before"), F.lit(2 * n)))
    return placed.select("s1", F.when(F.col("turn") < n, F.col("turn")).otherwise(2 * n - 1 - F.col("turn")).cast("int").alias("fold"))


def fold_spread(counts: DataFrame) -> DataFrame:
    """Mean and population deviation over folds of the macro score."""
    return counts.groupBy("fold").agg(F.avg("f").alias("f")).agg(F.avg("f").alias("mean"), F.stddev_pop("f").alias("deviation"))


def blocking_recall(truth: DataFrame, candidates: DataFrame) -> DataFrame:
    """Found and all true pairs; recall 1 where nothing is true."""
    hit = truth.join(candidates.select("s1", "cand", F.lit(1).alias("hit")).distinct(), ["s1", "cand"], "left")
    return hit.agg(F.count("*").alias("n_true"), F.count("hit").alias("n_found")).withColumn("recall", F.when(F.col("n_true") == 0, 1.0).otherwise(F.col("n_found") / F.col("n_true")))


def missed(truth: DataFrame, candidates: DataFrame) -> DataFrame:
    return truth.join(candidates, ["s1", "cand"], "left_anti")


def candidate_counts(candidates: DataFrame, entities: DataFrame, pool: int | None = None) -> DataFrame:
    """Mean and quantiles (interpolated) of candidates a record, and how much of the whole space they save."""
    n = entities.join(candidates.groupBy("s1").agg(F.count("*").alias("n")), "s1", "left").select(F.coalesce("n", F.lit(0)).alias("n"))
    out = n.agg(F.avg("n").alias("mean"), *(F.percentile("n", F.lit(q)).alias(name) for q, name in ((0.5, "median"), (0.95, "p95"), (0.99, "p99"))), F.max("n").alias("most"))
    return out if pool is None else out.withColumn("saved", 1 - F.col("mean") / pool)


def in_ranges(df: DataFrame, order: str) -> DataFrame:
    """df in ranges of order, with the number of its range in __range; written, so that the ranges stay as they are."""
    return materialized(df.repartitionByRange(order).withColumn("__range", F.spark_partition_id()), "ranges")


def floor_quantile(df: DataFrame, column: str, q: float) -> DataFrame:
    """The element at place floor(n * q) of the sorted values, by counts of ranges and then of values within them."""
    counts = in_ranges(df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n")), column)
    before = counts.groupBy("__range").agg(F.sum("n").alias("n")).select("__range", (F.sum("n").over(Window.orderBy("__range")) - F.col("n")).alias("before"), F.sum("n").over(Window.partitionBy()).alias("all"))
    within = F.sum("n").over(Window.partitionBy("__range").orderBy(column))
    placed = counts.withColumn("within", within).join(F.broadcast(before), "__range")  # as many rows as ranges
    return placed.where(F.col("before") + F.col("within") > F.least(F.floor(F.col("all") * q), F.col("all") - 1)).agg(F.min(column).alias("value"))


def histogram(df: DataFrame, column: str, edges: list[float], right: bool = True) -> DataFrame:
    """Counts between edges, closed on the right or the left."""
    band = F.lit(None).cast("int")
    for i in range(len(edges) - 2, -1, -1):
        c = F.col(column)
        inside = ((c > edges[i]) & (c <= edges[i + 1])) if right else ((c >= edges[i]) & (c < edges[i + 1]))
        band = F.when(inside, F.lit(i)).otherwise(band)
    return df.select(band.alias("band"), column).where("band is not null").groupBy("band").agg(F.count("*").alias("n"), F.avg(column).alias("mean"))


def frequencies(df: DataFrame, column: str, top: int | None = None) -> DataFrame:
    out = df.groupBy(column).agg(F.count("*").alias("n"))
    return out if top is None else out.orderBy(F.desc("n"), column).limit(top)


def quality(records: DataFrame) -> DataFrame:
    """Blanks, duplicate identifiers, mean and greatest lengths."""
    cols = ("business_name", "business_address", "country")
    return records.agg(F.count("*").alias("rows"), (F.count("*") - F.countDistinct("entity_id")).alias("duplicate_ids"), *(F.count_if(F.trim(c) == "").alias(f"{c}_blank") for c in cols), *(F.avg(F.length(c)).alias(f"{c}_mean") for c in cols), *(F.max(F.length(c)).alias(f"{c}_max") for c in cols))


def provenance_table(union: DataFrame, truth: DataFrame) -> DataFrame:
    """Pairs by where they come from and whether they are true."""
    return union.join(truth.withColumn("true", F.lit(True)), ["s1", "cand"], "left").groupBy("provenance", F.coalesce("true", F.lit(False)).alias("is_true")).agg(F.count("*").alias("n"))


def secondary_loss(truth: DataFrame, candidates: DataFrame, links: DataFrame) -> DataFrame:
    """Of records with several true partners: pairs lost in blocking, lost at the threshold, and found."""
    many = truth.groupBy("s1").count().where("count > 1").select("s1")
    rows = truth.join(many, "s1").join(candidates.select("s1", "cand", F.lit(1).alias("c")).distinct(), ["s1", "cand"], "left").join(links.select("s1", "cand", F.lit(1).alias("l")).distinct(), ["s1", "cand"], "left")
    return rows.agg(F.count_if(F.col("c").isNull()).alias("lost_in_blocking"), F.count_if(F.col("c").isNotNull() & F.col("l").isNull()).alias("lost_at_threshold"), F.count_if(F.col("l").isNotNull()).alias("found"))


def contamination(truth: DataFrame, candidates: DataFrame, entities: DataFrame) -> DataFrame:
    """Records without true partners that have candidates all the same."""
    none = entities.join(truth.select("s1").distinct(), "s1", "left_anti")
    n = none.join(candidates.groupBy("s1").agg(F.count("*").alias("n")), "s1", "left")
    return n.agg(F.count("*").alias("entities"), F.count("n").alias("contaminated"), F.coalesce(F.sum("n"), F.lit(0)).alias("added"))


def runs(df: DataFrame, column: str, line: str) -> DataFrame:
    """Runs of equal values in the order of lines: value, first line, length. Runs are found within ranges of lines, then put
    together where a range begins with the value that the one before ended with."""
    rows = in_ranges(df.select(column, line), line)
    w = Window.partitionBy("__range").orderBy(line)
    new = rows.withColumn("new", F.when(F.col(column) == F.lag(column).over(w), 0).otherwise(1))
    own = new.withColumn("run", F.sum("new").over(w)).groupBy("__range", "run", column).agg(F.min(line).alias("first"), F.count("*").alias("n"))
    last = Window.partitionBy("__range").orderBy(F.desc("run"))
    ends = own.withColumn("r", F.row_number().over(last)).where("r = 1").select("__range", F.col("run").alias("runs"), F.col(column).alias("ended"))
    start = own.where("run = 1").select("__range", F.col(column).alias("began"))
    over = Window.orderBy("__range")  # as many rows as ranges
    edges = ends.join(start, "__range").withColumn("same", F.coalesce(F.col("began") == F.lag("ended").over(over), F.lit(False)).cast("int"))
    edges = edges.select("__range", (F.sum(F.col("runs") - F.col("same")).over(over) - F.col("runs")).alias("before"))
    placed = own.join(F.broadcast(edges), "__range").withColumn("run", F.col("run") + F.col("before"))
    return placed.groupBy("run", column).agg(F.min("first").alias("first"), F.sum("n").alias("n")).drop("run")


def differences(points: DataFrame, order: str, *columns: str) -> DataFrame:
    """Gain of each column over the point before."""
    w = Window.orderBy(order)
    return points.select("*", *((F.col(c) - F.lag(c).over(w)).alias(f"{c}_gain") for c in columns))
