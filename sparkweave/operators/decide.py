"""From pair scores to links: gates, thresholds, sweeps, rescue and veto. Scored pairs are (s1, cand, p, ...)."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkweave.operators.evaluate import per_entity


def country_gate(a: Column, b: Column) -> Column:
    """False only for two countries that are both given and differ."""
    return (a == "") | (b == "") | (a == b)


def instant(a: Column, b: Column) -> Column:
    """Equal names of over three characters with equal or missing addresses: a match without any model."""
    return (F.length(a["name"]) > 3) & (a["name"] == b["name"]) & ((a["address"] == b["address"]) | (a["address"] == "") | (b["address"] == ""))


def scored_by_rule(rows: DataFrame, score: Column) -> DataFrame:
    """p and rule: 1 by rule for instant matches, else the score; the branches are apart so that the score isn't computed twice."""
    quick = instant(F.col("a"), F.col("b"))
    return rows.where(quick).withColumn("p", F.lit(1.0)).withColumn("rule", F.lit("exact")).unionByName(rows.where(~quick).withColumn("p", score.cast("double")).withColumn("rule", F.lit("model")))


def hybrid(rows: DataFrame, name: str = "p") -> DataFrame:
    """rows (a, b, p) with p set to 1 where name and address are equal and given and the countries agree."""
    a, b = F.col("a"), F.col("b")
    same = lambda f: (a[f] == b[f]) & (a[f] != "")
    return rows.withColumn(name, F.when(same("name") & same("address") & same("country"), 1.0).otherwise(F.col(name)))


def evidence(a: Column, b: Column, address_score: Column, stem: Column) -> Column:
    """A shared number, postal code or long address word, a fair address score, or a long stem where an address is missing."""
    long_ = lambda w: F.filter(w, lambda t: F.length(t) >= 5)
    there = F.arrays_overlap(a["numbers"], b["numbers"]) | ((a["pincode"] != "") & (a["pincode"] == b["pincode"])) | F.arrays_overlap(long_(a["address_tokens"]), long_(b["address_tokens"])) | (address_score >= 40)
    return F.coalesce(there, F.lit(False)) | (((a["address"] == "") | (b["address"] == "")) & (F.length(stem) >= 10))


def name_veto(score: Column, sorted_score: Column, least: float) -> Column:
    """True for pairs to keep: either name score reaches the least."""
    return (score >= least) | (sorted_score >= least)


def accept(scored: DataFrame, tau: float | Column) -> DataFrame:
    return scored.where(F.col("p") >= tau)


def conditional_tau(tau: float) -> Column:
    """Stricter where an address is blank, laxer for the best retrieved with a good name."""
    sure = (F.col("rank") == 1) & (F.col("cosine") >= 0.70) & (F.col("name_sort") >= 0.70)
    return F.lit(tau) + F.when(F.col("addr_blank") == 1, 0.04).otherwise(0.0) - F.when(sure, 0.03).otherwise(0.0)


def conditional(scored: DataFrame, truth: DataFrame, entities: DataFrame, tau: float, spread: float = 0.002) -> tuple[DataFrame, bool]:
    """Links by the conditional threshold if their macro score is better than by the plain one and spreads over folds by no
    more than spread, else by the plain one; and which it was. scored has fold; two rows reach the driver."""
    plain, other = accept(scored, tau), accept(scored, conditional_tau(tau))
    of = entities.join(scored.select("s1", "fold").distinct(), "s1", "left")

    def judged(links: DataFrame) -> tuple[float, float]:
        each = per_entity(truth, links, of)
        means = each.groupBy("fold").agg(F.avg("f").alias("m"), F.sum("f").alias("all"), F.count("*").alias("n"))
        row = means.agg(F.sum("all") / F.sum("n"), F.coalesce(F.stddev_pop(F.when(F.col("fold").isNotNull(), F.col("m"))), F.lit(0.0))).first()
        return float(row[0] or 0.0), float(row[1])

    (f0, _), (f1, deviation) = judged(plain), judged(other)
    better = f1 > f0 and deviation <= spread
    return (other if better else plain), better


def grid(spark: SparkSession, taus: Iterable[float]) -> DataFrame:
    return spark.createDataFrame([(float(t),) for t in taus], "tau double")


def steps(low: float, high: float, step: float) -> list[float]:
    return [round(low + step * i, 6) for i in range(round((high - low) / step) + 1)]


def at_each(scored: DataFrame, truth: DataFrame, entities: DataFrame, taus: Iterable[float], beta: float = 0.5) -> DataFrame:
    """per_entity() at each threshold (tau), with the columns of entities; pairs meet only the thresholds they reach."""
    taus = sorted(float(t) for t in taus)
    own = scored.select("s1", "cand", F.explode(F.filter(F.lit(taus), lambda t: t <= F.col("p"))).alias("tau"))
    each = entities.select("*", F.explode(F.lit(taus)).alias("tau"))
    known = truth.select("s1", "cand", F.explode(F.lit(taus)).alias("tau"))
    return per_entity(known, own, each, ["tau"], beta)


def sweep(scored: DataFrame, truth: DataFrame, entities: DataFrame, taus: Iterable[float], beta: float = 0.5) -> DataFrame:
    """(tau, macro_f, macro_p, macro_r) for each threshold, in one plan."""
    counts = at_each(scored, truth, entities.select("s1"), taus, beta)
    return counts.groupBy("tau").agg(F.avg("f").alias("macro_f"), F.avg("p").alias("macro_p"), F.avg("r").alias("macro_r"))


def two_thresholds(scored: DataFrame, truth: DataFrame, entities: DataFrame, first: str, taus: Iterable[float]) -> DataFrame:
    """(tau_first, tau_other, macro_f) for every pair of thresholds, one for records of country `first`, one for the others.

    The macro score is a mean over records, so the pairs follow from the sums of both sides in one sweep and no pair is
    evaluated. The sides are told apart in the sums alone: a sweep for each of them, over semi-joined halves of the same
    tables, lost counts in Spark 4.1, whose unions take the partitioning of their inputs for granted where exchanges are reused.
    """
    taus = sorted(float(t) for t in taus)
    side = entities.select("s1", F.coalesce(F.col("country") == first, F.lit(False)).alias("first"))
    sums = at_each(scored, truth, side, taus).groupBy("tau").agg(*(agg.alias(name) for k, own in (("a", F.col("first")), ("b", ~F.col("first"))) for agg, name in ((F.coalesce(F.sum(F.when(own, F.col("f"))), F.lit(0.0)), k), (F.count_if(own), f"{k}_n"))))
    a, b = sums.select(F.col("tau").alias("tau_first"), "a", "a_n"), sums.select(F.col("tau").alias("tau_other"), "b", "b_n")
    return a.crossJoin(F.broadcast(b)).select("tau_first", "tau_other", ((F.col("a") + F.col("b")) / (F.col("a_n") + F.col("b_n"))).alias("macro_f"))


def rescue_grid(scored: DataFrame, truth: DataFrame, entities: DataFrame, tau: float, taus: list[float], leads: list[float]) -> DataFrame:
    """(tau_rescue, margin, macro_f) of rescued links for a grid, in one plan: each clear best pair names the settings it meets."""
    base = accept(scored, tau).select("s1", "cand")
    settings = [F.struct(F.lit(float(t)).alias("tau_rescue"), F.lit(float(g)).alias("margin")) for t in taus for g in leads]
    lone = margins(scored).join(base.select("s1").distinct(), "s1", "left_anti")
    more = lone.select("s1", "cand", F.explode(F.filter(F.array(*settings), lambda x: (F.col("p") >= x["tau_rescue"]) & (F.col("margin") >= x["margin"]))).alias("x")).select("s1", "cand", "x.*")
    every = lambda df, *c: df.select(*c, F.explode(F.array(*settings)).alias("x")).select(*c, "x.*")
    links = every(base, "s1", "cand").unionByName(more)
    return per_entity(every(truth, "s1", "cand"), links, every(entities, "s1"), ["tau_rescue", "margin"]).groupBy("tau_rescue", "margin").agg(F.avg("f").alias("macro_f"))


def searched(points: Callable[[int, float], float], ks: list[int], floors: list[float], start: tuple[int, float], lead: int = 3) -> list[tuple[int, float, float]]:
    """Adaptive search over (K, floor): all K at the starting floor, all floors at the starting K, then the best K with the best
    floors that were not tried yet. points gives a setting's score; (K, floor, score) in the order of trial, each setting once."""
    tried: dict[tuple[int, float], float] = {}

    def best_of(axis: int) -> list:
        own = [(-f, at[axis]) for at, f in tried.items() if at[1 - axis] == start[1 - axis]]
        return [x for _, x in sorted(own)[:lead]]

    def try_(k: int, floor: float) -> None:
        if (k, floor) not in tried:
            tried[k, floor] = points(k, floor)

    for k in ks:
        try_(k, start[1])
    for floor in floors:
        try_(start[0], floor)
    for k, floor in product(best_of(0), best_of(1)):
        try_(k, floor)
    return [(k, floor, f) for (k, floor), f in tried.items()]


def best(swept: DataFrame) -> DataFrame:
    """The best threshold; of equal ones the lowest."""
    return swept.orderBy(F.desc("macro_f"), "tau").limit(1)


def by_country(scored: DataFrame, country: Column, taus: dict[str, float], other: float) -> DataFrame:
    tau = F.lit(other)
    for code, t in taus.items():
        tau = F.when(country == code, F.lit(t)).otherwise(tau)
    return accept(scored, tau)


def entity_gate(scored: DataFrame, tau: float, gate: float) -> DataFrame:
    """Links only of records whose best score reaches the gate."""
    top = F.max("p").over(Window.partitionBy("s1"))
    return scored.withColumn("top", top).where((F.col("top") >= gate) & (F.col("p") >= tau)).drop("top")


def margins(scored: DataFrame) -> DataFrame:
    """The best pair of each record with the lead over the second (0 for none); ties by cand."""
    w = Window.partitionBy("s1").orderBy(F.desc("p"), "cand")
    return scored.withColumn("n", F.row_number().over(w)).withColumn("margin", F.col("p") - F.lead("p", 1, 0.0).over(w)).where("n = 1").drop("n")


def ranked(scored: DataFrame, k: int) -> DataFrame:
    """The k best pairs of each record with their rank; ties by cand."""
    order = Window.partitionBy("s1").orderBy(F.desc("p"), "cand")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def rescue(scored: DataFrame, tau: float, tau_rescue: float, margin: float, conflict: Column | None = None) -> DataFrame:
    """Accepted pairs, and for records without any the best pair if it is high and clear enough and no code conflicts."""
    base = accept(scored, tau)
    lone = margins(scored).where((F.col("p") >= tau_rescue) & (F.col("margin") >= margin)).drop("margin").join(base.select("s1").distinct(), "s1", "left_anti")
    return base.unionByName(lone if conflict is None else lone.where(~conflict))


def blend(*parts: tuple[str, float]) -> Column:
    """Weighted sum of score columns."""
    out = F.lit(0.0)
    for name, weight in parts:
        out = out + F.col(name) * weight
    return out
