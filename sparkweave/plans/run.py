"""The whole way from files to checked results: read, block, make features, learn, choose a threshold, link, write, validate.

    python -m sparkweave.plans.run --data-dir DIR --output-dir DIR [--sample] [--train-sample-size N] [--test-sample-size N]
                                   [--model-type boosted] [--preset f31] [--team-name NAME]
"""

from __future__ import annotations

import argparse
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkweave.operators import blocking, decide, evaluate, features, learn, validate
from sparkweave.operators.entity import entities
from sparkweave.sources import package
from sparkweave.sources.records import TRUTH, data_paths, first_truth, in_input_order, read_lines, results, training_pool, write_results
from sparkweave.sources.store import materialized


@dataclass
class Settings:
    data_dir: str
    output_dir: str
    sample: bool = False
    train_sample_size: int | None = 10_000
    test_sample_size: int | None = None
    model_type: str = "boosted"
    preset: str = "f31"
    rounds: int | None = None
    team_name: str = "team"
    folds: int = 5
    tau_low: float = 0.3
    tau_high: float = 0.95
    tau_step: float = 0.02


@dataclass
class Outcome:
    tau: float
    macro_f: float
    recall: float
    violations: int
    results: str
    candidates: str
    archive: str


def candidate_rows(left: DataFrame, right: DataFrame, preset: str) -> tuple[DataFrame, DataFrame]:
    """Blocked pairs, and the same with their features; pairs of two countries that differ are gated."""
    pairs = materialized(blocking.candidates(left, right, blocking.keys_passes(), {5: 150}, 120), "pairs")
    rows = features.paired(pairs, left, right).where(decide.country_gate(F.col("a.country"), F.col("b.country")))
    rows = features.with_alias(features.basic(rows.select("*", F.lit(0.0).alias("cosine"), F.lit(0).alias("rank"), F.lit("block").alias("provenance"))))
    if preset not in ("f4", "f17", "f20", "f26", "f31"):
        rows = features.weighted(features.variants(features.retrieved(rows)), right)
    return pairs, rows.select("s1", "cand", *features.PRESETS[preset])


def run(spark: SparkSession, how: Settings) -> Outcome:
    """Everything is a plan over written tables; the driver gets a threshold, a few scores and the number of violations."""
    paths, names = data_paths(how.data_dir, how.sample), features.PRESETS[how.preset]
    first = how.train_sample_size if how.train_sample_size is not None else 1 << 62
    _, source1, known = first_truth(read_lines(spark, paths["train_gt"], TRUTH), read_lines(spark, paths["train_s1"]), first)
    known = materialized(known, "truth")
    pools = [read_lines(spark, paths[f"train_s{n}"]) for n in (2, 3)]
    if how.train_sample_size is not None:
        pools = [training_pool(p, known, 10 * how.train_sample_size) for p in pools]
    left = materialized(entities(source1), "left")
    right = materialized(entities(pools[0].unionByName(pools[1])), "right")
    pairs, rows = candidate_rows(left, right, how.preset)
    labelled = materialized(rows.join(known.withColumn("label", F.lit(1.0)), ["s1", "cand"], "left").fillna(0.0, ["label"]), "labelled")
    own = left.select(F.col("entity_id").alias("s1"), "country")
    recall = evaluate.blocking_recall(known, pairs).first()["recall"]

    scored = materialized(learn.out_of_fold(labelled, names, how.model_type, how.folds, how.rounds).select("s1", "cand", "p"), "scored")
    best = decide.best(decide.sweep(scored, known, own, decide.steps(how.tau_low, how.tau_high, how.tau_step))).first()
    model = learn.fit(labelled, names, how.model_type, how.rounds)
    learn.save(model, f"{how.output_dir}/model")

    split = "train" if how.sample else "test"
    asked = read_lines(spark, paths[f"{split}_s1"])
    if how.test_sample_size is not None:
        asked = asked.where(F.col("line") < how.test_sample_size)
    there = read_lines(spark, paths[f"{split}_s2"]).unionByName(read_lines(spark, paths[f"{split}_s3"]))
    left, right = (materialized(entities(df), "entities") for df in (asked, there))
    pairs, rows = candidate_rows(left, right, how.preset)
    links = decide.accept(learn.score(learn.load(f"{how.output_dir}/model"), rows), best["tau"])
    own = asked.select(F.col("entity_id").alias("s1")).distinct()
    written = {}
    for name, found in (("matched_entity_ids", links), ("candidate_entity_ids", pairs)):
        written[name] = materialized(results(own, found.select("s1", "cand"), name), name)
        write_results(in_input_order(written[name], asked), f"{how.output_dir}/{name}")
    wrong = validate.audit(written["matched_entity_ids"], written["candidate_entity_ids"], own, there.select("entity_id")).count()
    archive = package.archive(spark, f"{how.output_dir}/{how.team_name}.zip", {"matching_results.tsv": f"{how.output_dir}/matched_entity_ids", "candidate_pairs.tsv": f"{how.output_dir}/candidate_entity_ids"})
    return Outcome(best["tau"], best["macro_f"], recall, wrong, f"{how.output_dir}/matched_entity_ids", f"{how.output_dir}/candidate_entity_ids", archive)


def parsed(arguments: list[str] | None = None) -> Settings:
    parser = argparse.ArgumentParser(description="Link records of three sources.")
    parser.add_argument("--data-dir", required=True)
    parser.add_argument("--output-dir", required=True)
    parser.add_argument("--sample", action="store_true")
    parser.add_argument("--train-sample-size", type=int, default=10_000)
    parser.add_argument("--test-sample-size", type=int)
    parser.add_argument("--model-type", default="boosted", choices=["forest", "logistic", *learn.BOOSTED])
    parser.add_argument("--preset", default="f31", choices=sorted(features.PRESETS))
    parser.add_argument("--rounds", type=int)
    parser.add_argument("--team-name", default="team")
    return Settings(**vars(parser.parse_args(arguments)))


if __name__ == "__main__":
    print(run(SparkSession.builder.getOrCreate(), parsed()))
