"""Golden values, properties and edge cases of the record-linkage operators."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from sparkweave.functions import similarity as S
from sparkweave.functions import text as X
from sparkweave.operators import blocking, decide, evaluate, retrieval, validate
from sparkweave.operators.entity import entities
from sparkweave.sources.records import RECORD, id_list, read_tsv, results, truth_pairs

SORTED = [
    ("LHB Interiors Pvt Ltd", "LHB Integrir Pvt Ltd", 92.68293),
    ("CQJ Consultancy Private Limited", "CQJ Consultatoscy Private Limited", 91.66667),
    ("Sai Construction", "Sai  Services", 35.71429),
    ("Saffron Financers LLP", "saffronfinancers.com", 43.90244),
    ("Spicer Star Environmental Services LLC", "Spicer-Star Environmental Seraices LLC", 94.73684),
    ("Great Impex Private Limited", "Smt *** Great Impex Private-Limited", 68.0),
    ("Great Impex Private Limited", "గ్రేట్ ఇంపెక్స్ ప్రైవేట్ లిమిటెడ్", 13.33333),
    ("Shakti Agro Limited", "ଶକ୍ତି ଆଗ୍ରୋ ଲିମିଟେଡ୍", 13.33333),
    ("United Consulting Private Limited", "Sri united consulting private limited", 92.59259),
]


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_sorted_word_scores(spark):
    df = spark.createDataFrame(SORTED, "a string, b string, want double")
    rows = df.select("want", S.token_sort_ratio(X.normalize_name(F.col("a")), X.normalize_name(F.col("b"))).alias("got")).collect()
    assert all(abs(r["want"] - r["got"]) < 1e-4 for r in rows)


def test_normalization(spark):
    got = one(spark, X.normalize_name(F.lit("saffronfinancers.com")), X.normalize_address(F.lit("2696 2200, West Haven, UT")), X.normalize_name(F.lit("Smt *** Great Impex Private-Limited")), X.normalize_name(F.lit("NULL")), X.normalize_name(F.lit(None).cast("string")))
    assert list(got) == ["saffronfinancers com", "2696 2200 w haven ut", "smt great impex private-limited", "", ""]


def test_numbers_and_codes(spark):
    got = one(spark, X.numbers(F.lit("6-2-101/5/c 007 12c 123456789 000")), X.pincode(F.lit("near 500081, x 1234567")), X.aliases(F.lit("Old Co dba New  f/k/a Third")))
    assert list(got) == [["6", "2", "101", "5", "7", "12", "0"], "500081", ["Old Co", "New", "Third"]]


def test_scripts(spark):
    rows = spark.createDataFrame([("नमक",), ("plain",)], "s string").select(X.has_indic(F.col("s")), X.transliterate(F.col("s")), X.script(F.col("s"))).collect()
    assert [list(r) for r in rows] == [[True, "nmk", "DEVANAGARI"], [False, "", "LATIN"]]


def test_common_subsequence_against_the_plain_recurrence():
    random.seed(3)
    for _ in range(200):
        a, b = ("".join(random.choices("abc", k=random.randint(0, 12))) for _ in range(2))
        rows = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a, 1):
            for j, y in enumerate(b, 1):
                rows[i][j] = rows[i - 1][j - 1] + 1 if x == y else max(rows[i - 1][j], rows[i][j - 1])
        assert S.common_subsequence(a, b) == rows[-1][-1] == S.common_subsequence(b, a)
        assert 0 <= S.indel(a, b) <= 100 and 0 <= S.best_part(a, b) <= 100 and (not a or S.best_part(a, a + b) == 100)


def test_set_score(spark):
    got = one(spark, *(S.token_set_ratio(F.lit(a), F.lit(b)) for a, b in (("a b", "b a c"), ("", "x"), ("new york mets", "new york mets vs atlanta braves"))))
    assert list(got) == [100.0, 0.0, 100.0]


def budget_loop(asked, postings, caps, other, limit):
    """The budget as a loop over keys in order."""
    found = set()
    for step, k in asked:
        for source in ("S2", "S3"):
            own = [e for s, e, kk in postings if s == source and kk == k]
            if len(own) <= caps.get(step, other):
                found |= set(own)
        if len(found) >= limit:
            break
    return found


def test_budgeted_candidates(spark):
    random.seed(5)
    keys = [f"k{i}" for i in range(12)]
    make = lambda s, n: [(f"{s}-{i}", s, [(random.randint(1, 6), random.choice(keys)) for _ in range(random.randint(0, 6))]) for i in range(n)]
    left, right = make("S1", 30), make("S2", 40) + make("S3", 40)
    schema = "entity_id string, source string, keys array<struct<step:int,kval:string>>"
    frame = lambda rows: spark.createDataFrame(rows, schema).withColumn("country", F.lit(""))
    column = F.transform("keys", lambda k: F.struct(k["step"].alias("step"), F.lit("t").alias("ktype"), k["kval"].alias("kval")))
    got = {}
    for r in blocking.candidates(frame(left), frame(right), column, {4: 5}, 15, other_cap=12).collect():
        got.setdefault(r["s1"], set()).add(r["cand"])
    postings = [(s, e, k) for e, s, ks in right for _, k in ks]
    for e, _, ks in left:
        assert got.get(e, set()) == budget_loop(ks, postings, {4: 5}, 12, 15)


def test_metric(spark):
    truth = spark.createDataFrame([("S1-1", "a"), ("S1-1", "c"), ("S1-3", "x")], "s1 string, cand string")
    links = spark.createDataFrame([("S1-1", "a"), ("S1-1", "b"), ("S1-1", "c"), ("S1-4", "z")], "s1 string, cand string")
    ids = spark.createDataFrame([(f"S1-{i}",) for i in range(1, 5)], "s1 string")
    got = {r["s1"]: (round(r["f"], 3), round(r["p"], 3), round(r["r"], 3)) for r in evaluate.per_entity(truth, links, ids).collect()}
    assert got == {"S1-1": (0.714, 0.667, 1.0), "S1-2": (1.0, 1.0, 1.0), "S1-3": (0.0, 0.0, 0.0), "S1-4": (0.0, 0.0, 0.0)}


def test_rescue_and_gate(spark):
    rows = spark.createDataFrame([("a", "1", 0.9), ("a", "2", 0.2), ("b", "1", 0.6), ("b", "2", 0.3), ("c", "1", 0.6), ("c", "2", 0.58)], "s1 string, cand string, p double")
    assert {tuple(r) for r in decide.rescue(rows, 0.8, 0.5, 0.1).select("s1", "cand").collect()} == {("a", "1"), ("b", "1")}
    assert {tuple(r) for r in decide.entity_gate(rows, 0.1, 0.8).select("s1", "cand").collect()} == {("a", "1"), ("a", "2")}


def test_retrieval_ranks_the_same_text_first(spark):
    pool = spark.createDataFrame([("p1", "", "blue garden tools"), ("p2", "", "red garden chairs"), ("p3", "", "steel pipes")], "id string, country string, text string")
    asked = spark.createDataFrame([("q", "", "blue garden tools")], "id string, country string, text string")
    got = retrieval.nearest(asked, pool, k=2, floor=0.1, least=1).orderBy("rank").collect()
    assert (got[0]["cand"], got[0]["cosine"], got[1]["cand"]) == ("p1", 1.0, "p2")


def test_violations(spark):
    ids = spark.createDataFrame([("S1-1",), ("S1-2",), ("S1-3",)], "s1 string")
    rows = spark.createDataFrame([("S1-1", "S2-1, S2-1"), ("S1-2", "S1-9"), ("S1-2", "X-1"), ("S1-8", "")], "source1_entity_id string, matched_entity_ids string")
    known = spark.createDataFrame([("S2-1",)], "entity_id string")
    rules = {r["rule"] for r in validate.violations(rows, "matched_entity_ids", ids, known).collect()}
    assert rules == {"duplicate_row", "duplicate_id", "self_match", "wrong_prefix", "missing_row", "extra_row", "unknown_id"}


def test_reading_and_results(spark, tmp_path):
    (tmp_path / "s.tsv").write_text('entity_id\tbusiness_name\tbusiness_address\tcountry\nS1-1\tA "b\t\tUS\n', encoding="utf-8")
    assert [tuple(r) for r in read_tsv(spark, str(tmp_path / "s.tsv"), RECORD).collect()] == [("S1-1", 'A "b', "", "US")]
    truth = spark.createDataFrame([("S1-1", "S2-2, S2-1,,S2-2"), ("S1-2", "")], "source1_entity_id string, matched_entity_ids string")
    ids, pairs = truth_pairs(truth)
    assert {tuple(r) for r in results(ids, pairs).collect()} == {("S1-1", "S2-1,S2-2"), ("S1-2", "")}
    assert one(spark, id_list(F.lit("S2-52 , 1")))[0] == ["S2-52", "1"]


def test_blank_records_have_no_keys(spark):
    rows = spark.createDataFrame([("S1-1", "", "", ""), ("S1-2", "of the", None, None), ("S1-3", "nan", "null", "US")], RECORD)
    ents = entities(rows)
    for keys in blocking.PRESETS.values():
        assert all(r["ktype"] in ("exact_name", "prefix3", "prefix4", "gram") for r in blocking.exploded(ents, keys()).collect())


@pytest.mark.parametrize("n", [1, 7])
def test_folds_keep_records_together(spark, n):
    pairs = spark.range(50).select(F.concat(F.lit("S1-"), F.col("id") % 11).alias("s1"), F.col("id").cast("string").alias("cand"))
    rows = evaluate.folds(pairs, n).collect()
    assert len(rows) == 11 and {r["fold"] for r in rows} == set(range(n))


def test_entry_imports_without_a_session():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
