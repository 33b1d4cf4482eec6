"""Operators of record linkage against plain definitions, and the whole way over small files."""

from __future__ import annotations

import math
import random
import zipfile
from collections import Counter

import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from sparkweave.functions import similarity as S
from sparkweave.functions import text as X
from sparkweave.operators import blocking, decide, evaluate, features, learn, retrieval
from sparkweave.operators.entity import entities
from sparkweave.plans import queries
from sparkweave.plans.run import parsed, run
from sparkweave.sources import package
from sparkweave.sources.records import RECORD, RESULT, documents_as_records, in_input_order, lookup, read_lines, read_tsv, write_results


def plain_common(a: str, b: str) -> int:
    rows = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            rows[i][j] = rows[i - 1][j - 1] + 1 if x == y else max(rows[i - 1][j], rows[i][j - 1])
    return rows[-1][-1]


def plain_part(a: str, b: str) -> float:
    """Every window of the shorter string's length, and every shorter one at either edge."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 100.0 if not b else 0.0
    if len(a) == len(b):
        return max(windows_of(a, b), windows_of(b, a))
    return windows_of(a, b)


def windows_of(a: str, b: str) -> float:
    m = len(a)
    windows = [b[i : i + m] for i in range(len(b) - m + 1)] + [b[:j] for j in range(1, m)] + [b[-j:] for j in range(1, m)]
    return max(200 * plain_common(a, w) / (m + len(w)) for w in windows)


def test_best_part_against_every_window():
    random.seed(41)
    for _ in range(400):
        letters = random.choice(["ab", "abc", "abcdefgh "])
        a, b = ("".join(random.choices(letters, k=random.randint(0, n))) for n in random.choice([(8, 30), (12, 14), (20, 20), (3, 40)]))
        assert math.isclose(S.best_part(a, b), plain_part(a, b)) and S.best_part(a, b) == S.best_part(b, a), (a, b)
        assert S.common_subsequence(a, b) == plain_common(a, b)


def test_word_sets_against_the_definition():
    random.seed(42)
    for _ in range(300):
        a, b = (" ".join(random.choices(["ab", "b", "cd", "e", "abc"], k=random.randint(0, 5))) for _ in range(2))
        x, y = set(a.split()), set(b.split())
        join = lambda w: " ".join(sorted(w))
        both, left, right = join(x & y), *((join(x & y) + " " + join(z - (x & y))).strip() for z in (x, y))
        want = 0.0 if not x or not y else 100.0 if x & y and (x <= y or y <= x) else max(S.indel(left, right), *((S.indel(both, left), S.indel(both, right)) if both else (0.0,)))
        assert math.isclose(S.word_sets(a, b), want), (a, b)


@pytest.mark.parametrize("n", [3, 4])
def test_grams_of_any_length(spark, n):
    random.seed(47)
    texts = ["".join(random.choices("abé漢𐍈 ", k=k)) for k in (0, 1, 3, 4, 5, 63, 64, 66, 67, 68, 130, 700)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", X.char_grams(F.col("t"), n).alias("g")).collect()
    for r in rows:
        own = r["t"].replace(" ", "")
        assert r["g"] == list(dict.fromkeys(own[i : i + n] for i in range(len(own) - n + 1)))


def test_records_hold_every_line(spark):
    docs = spark.createDataFrame([(3, "a\n\nb\n c \nd\ne", "en"), (4, None, None), (5, "", "de"), (6, "x" * 5000 + "\n" + "y" * 5000, "fr")], "doc_id long, text string, lang string")
    got = {r["entity_id"]: (r["business_name"], r["business_address"], r["country"]) for r in documents_as_records(docs).collect()}
    assert got == {"S1-3-0": ("a", "b", "EN"), "S1-3-1": (" c ", "d", "EN"), "S1-3-2": ("e", "", "EN"), "S2-4-0": ("", "", ""), "S3-5-0": ("", "", "DE"), "S1-6-0": ("x" * 5000, "y" * 5000, "FR")}


@pytest.mark.parametrize("n, words, numbers", [(150, True, True), (151, False, True), (400, False, True), (401, False, False)])
def test_the_stricter_cap_is_that_of_single_name_words(spark, n, words, numbers):
    """A name word (fifth pass) counts up to 150 records, a number with a word (fourth pass) up to 400."""
    pool = [(f"S2-{i}", f"zebra q{i}x", f"12 walnut p{i}y", "") for i in range(n)]
    asked = [("S1-1", "zebra other", "none", ""), ("S1-2", "unlike thing", "12 walnut", "")]
    ents = entities(spark.createDataFrame(asked + pool, RECORD))
    got = blocking.candidates(ents.where("source = 'S1'"), ents.where("source <> 'S1'"), blocking.keys_passes(), {5: 150}, None).groupBy("s1").count().collect()
    assert {r["s1"]: r["count"] for r in got} == {k: n for k, there in (("S1-1", words), ("S1-2", numbers)) if there}


def test_words_that_no_candidate_has_weigh_most(spark):
    rows = [("S1-1", "apple rareword", "", ""), ("S2-1", "apple pie", "", ""), ("S2-2", "apple tart", "", "")]
    ents = entities(spark.createDataFrame(rows, RECORD))
    left, right = ents.where("source = 'S1'"), ents.where("source <> 'S1'")
    pairs = spark.createDataFrame([("S1-1", "S2-1")], "s1 string, cand string")
    scored = features.paired(pairs, left, right).withColumns({"addr_blank": F.lit(0), "name_ratio": F.lit(0.0)})
    got = features.weighted(scored, right).select("idf_shared", "idf_jaccard", "idf_max_shared", "idf_max_unshared").first()
    apple, pie, rare = math.log(3 / 3) + 1, math.log(3 / 2) + 1, math.log(3) + 1
    assert all(math.isclose(x, y, rel_tol=1e-6) for x, y in zip(got, (apple, apple / (apple + pie + rare + 1e-5), apple, rare)))


def test_runs_and_quantiles_over_many_ranges(spark):
    random.seed(43)
    values = [random.choice(["a", "a", "a", "b", None]) for _ in range(500)]
    df = spark.createDataFrame([(7 * i, v) for i, v in enumerate(values)], "line long, v string").repartition(9)
    want, before = [], object()
    for i, v in enumerate(values):
        if v is None or v != before:
            want.append([v, 7 * i, 0])
        want[-1][2] += 1
        before = v
    got = [(r["v"], r["first"], r["n"]) for r in evaluate.runs(df, "v", "line").collect()]
    assert Counter(got) == Counter(map(tuple, want))
    for q in (0.0, 0.1, 0.5, 0.9, 0.999, 1.0):
        numbers = sorted((7 * i) % 83 for i in range(500))
        found = evaluate.floor_quantile(df.select((F.col("line") % 83).alias("x")), "x", q).first()["value"]
        assert found == numbers[min(math.floor(500 * q), 499)]


def test_nearest_against_all_cosines(spark):
    random.seed(44)
    words = ["garden", "tools", "steel", "pipes", "chairs", "blue", "red", "light", "oak", "lamp"]
    text = lambda: " ".join(random.choices(words, k=random.randint(1, 6)))
    schema = "id string, country string, text string"
    asked, pool = ([(f"{k}{i}", random.choice("XY"), text()) for i in range(n)] for k, n in (("q", 25), ("p", 60)))
    q, p = (spark.createDataFrame(rows, schema) for rows in (asked, pool))
    weights: dict = {}
    for r in retrieval.tfidf(q.union(p)).collect():
        weights.setdefault(r["id"], {})[r["gram"]] = r["weight"]
    country = {i: c for i, c, _ in asked + pool}
    for floor in (0.2, 0.5):
        want = {}
        for i, c, _ in asked:
            own = [(-round(sum(w * weights.get(j, {}).get(g, 0.0) for g, w in weights.get(i, {}).items()), 6), j) for j, d, _ in pool if d == c]
            want |= {(i, r): (j, -s) for r, (s, j) in enumerate(sorted(x for x in own if -x[0] >= floor)[:4], 1)}
        got = {(r["s1"], r["rank"]): (r["cand"], r["cosine"]) for r in retrieval.nearest(q, p, k=4, floor=floor).collect()}
        assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()} and country
        assert all(math.isclose(got[k][1], want[k][1], abs_tol=2e-6) for k in want)


def test_presets_of_the_inspected_pair(spark):
    rows = [("S1-1", "Blue Network Corporation", "177 1st Avenue, Nashville, TN", "US"), ("S2-1", "The Blue Netw0rk Corporation", "177 1TH AVENUE, NASHVILLE, TN", "US")]
    ents = entities(spark.createDataFrame(rows, RECORD))
    keys = {}
    for r in blocking.exploded(ents, blocking.PRESETS["toy"]()).collect():
        keys.setdefault(r["entity_id"], set()).add((r["ktype"], r["kval"]))
    assert keys["S1-1"] & keys["S2-1"] == {("name_tok", "blue"), ("num_word", "177\u0001nashville"), ("name_num", "blue\u0001177")}
    smart = {r["kval"] for r in blocking.exploded(ents.where("entity_id = 'S1-1'"), blocking.PRESETS["smart"]()).collect()}
    assert {"blue network corp", "blue\u0001network", "blue\u0001177"} <= smart


def test_conditional_threshold_only_where_it_helps(spark):
    ids = spark.createDataFrame([(f"S1-{i}", "") for i in range(4)], "s1 string, country string")
    truth = spark.createDataFrame([(f"S1-{i}", "S2-1") for i in range(4)], "s1 string, cand string")
    rows = [(f"S1-{i}", "S2-1", 0.58, 1, 0.9, 0.9, 0, i % 2) for i in range(4)]
    schema = "s1 string, cand string, p double, rank int, cosine double, name_sort double, addr_blank int, fold int"
    links, better = decide.conditional(spark.createDataFrame(rows, schema), truth, ids, 0.6)
    assert better and links.count() == 4
    wrong = spark.createDataFrame([(s, "S2-9", *rest) for s, _, *rest in rows], schema)
    links, better = decide.conditional(wrong, truth, ids, 0.6)
    assert not better and links.count() == 0


def test_adaptive_search_tries_each_setting_once():
    tried = []

    def points(k: int, floor: float) -> float:
        tried.append((k, floor))
        return -abs(k - 8) - abs(floor - 0.4)

    found = decide.searched(points, [3, 5, 8, 10], [0.2, 0.3, 0.4], (5, 0.3), 2)
    assert len(tried) == len(set(tried)) == len(found) and tried[:4] == [(3, 0.3), (5, 0.3), (8, 0.3), (10, 0.3)]
    assert max(found, key=lambda x: x[2])[:2] == (8, 0.4)


def test_two_thresholds_against_sweeps(spark):
    random.seed(45)
    ids = spark.createDataFrame([(f"S1-{i}", random.choice(["US", "FR", ""])) for i in range(30)], "s1 string, country string")
    truth = spark.createDataFrame([(f"S1-{i}", f"S2-{i}") for i in range(0, 30, 2)], "s1 string, cand string")
    pairs = spark.createDataFrame([(f"S1-{random.randrange(30)}", f"S2-{random.randrange(30)}", random.random()) for _ in range(90)], "s1 string, cand string, p double").dropDuplicates(["s1", "cand"])
    scored = pairs.join(ids, "s1")
    for r in decide.two_thresholds(pairs, truth, ids, "US", [0.2, 0.6]).collect():
        links = decide.by_country(scored, F.col("country"), {"US": r["tau_first"]}, r["tau_other"])
        assert math.isclose(r["macro_f"], evaluate.per_entity(truth, links, ids).agg(F.avg("f")).first()[0])


def test_lines_lookup_and_input_order(spark, tmp_path):
    order = [f"S1-{i}" for i in (9, 2, 7, 4, 1)]
    (tmp_path / "s1.tsv").write_text("entity_id\tbusiness_name\tbusiness_address\tcountry\n" + "".join(f"{i}\tn\ta\tUS\n" for i in order), encoding="utf-8")
    source1 = read_lines(spark, str(tmp_path / "s1.tsv"))
    assert [r["entity_id"] for r in source1.orderBy("line").collect()] == order
    rows = spark.createDataFrame([(i, f"S2-{i}") for i in sorted(order)] + [("S1-99", "")], "source1_entity_id string, matched_entity_ids string")
    assert [r[0] for r in in_input_order(rows, source1).collect()] == [*order, "S1-99"]
    write_results(in_input_order(rows, source1), str(tmp_path / "out"))
    text = b"".join(package.contents(spark, str(tmp_path / "out"))).decode().splitlines()
    assert text[0] == "source1_entity_id\tmatched_entity_ids" and [x.split("\t")[0] for x in text[1:]] == [*order, "S1-99"]
    wanted = spark.createDataFrame([("S1-7",), ("S1-7",), ("S1-0",)], "entity_id string")
    assert [r["entity_id"] for r in lookup(source1, wanted).collect()] == ["S1-7"]


@pytest.fixture(scope="module")
def data(tmp_path_factory):
    """Records of three sources with small differences, true pairs, and test files, as a user would have them."""
    random.seed(46)
    root = tmp_path_factory.mktemp("data")
    words = ["".join(random.choices("bcdfglmnprst", k=2)) + random.choice("aeiou") + "".join(random.choices("bcdfglmnprst", k=2)) for _ in range(300)]
    for split in ("train", "test"):
        (root / split).mkdir()
        sources: dict[int, list[str]] = {1: [], 2: [], 3: []}
        truth = []
        for i in range(60):
            name, address = " ".join(random.sample(words, 3)).title(), f"{random.randint(1, 999)} {random.choice(words)} Street, {random.choice(words)}"
            sources[1].append(f"S1-{split}{i}\t{name} Limited\t{address}\tUS")
            matched = []
            for s in (2, 3):
                sources[s].append(f"S{s}-x{split}{i}\t{' '.join(random.sample(words, 2)).title()}\t{random.randint(1, 999)} {random.choice(words)} Road\tUS")
                if (i + s) % 3:
                    sources[s].append(f"S{s}-{split}{i}\t{name.upper() if s == 2 else name[:-1]} Ltd\t{address.replace('Street', 'St')}\tUS")
                    matched.append(f"S{s}-{split}{i}")
            truth.append(f"S1-{split}{i}\t{','.join(matched)}")
        for s, rows in sources.items():
            (root / split / f"{split}_source{s}.tsv").write_text("entity_id\tbusiness_name\tbusiness_address\tcountry\n" + "\n".join(rows) + "\n", encoding="utf-8")
        if split == "train":
            (root / split / "train_ground_truth.tsv").write_text("source1_entity_id\tmatched_entity_ids\n" + "\n".join(truth) + "\n", encoding="utf-8")
    return root


def test_the_whole_way(spark, data, tmp_path):
    how = parsed(["--data-dir", str(data), "--output-dir", str(tmp_path / "out"), "--model-type", "logistic", "--rounds", "20", "--preset", "f26", "--team-name", "us"])
    done = run(spark, how)
    assert done.recall > 0.95 and done.macro_f > 0.9 and done.violations == 0
    found = {r[0]: set(filter(None, r[1].split(","))) for r in read_tsv(spark, done.results, RESULT).collect()}
    assert len(found) == 60 and sum(found[f"S1-test{i}"] == {f"S{s}-test{i}" for s in (2, 3) if (i + s) % 3} for i in range(60)) >= 54
    with zipfile.ZipFile(done.archive) as z:
        lines = z.read("matching_results.tsv").decode().splitlines()
    assert [x.split("\t")[0] for x in lines] == ["source1_entity_id", *(f"S1-test{i}" for i in range(60))]
    assert [n for n, _ in package.listing(done.archive)] == ["matching_results.tsv", "candidate_pairs.tsv"] and len(package.sha256(done.archive)) == 64


def test_entities_of_a_stream(spark, tmp_path):
    from sparkweave.streaming import entity_stream

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.tsv").write_text("entity_id\tbusiness_name\tbusiness_address\tcountry\nS1-1\tBlue Garden Limited\t12 Oak Road\tus\n", encoding="utf-8")
    query = entity_stream(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("streamed").trigger(availableNow=True).start()
    query.awaitTermination()
    assert [(r["name"], r["address"], r["numbers"]) for r in spark.table("streamed").collect()] == [("blue garden ltd", "12 oak rd", ["12"])]


def test_two_thresholds_where_tables_are_shuffled(spark, tmp_path):
    """each side's own sweep lost counts once its joins were shuffled and shared their exchanges."""
    ids = spark.range(400).select(F.concat(F.lit("S1-"), "id").alias("s1"), F.when(F.col("id") % 3 == 0, "EN").when(F.col("id") % 3 == 1, "DE").otherwise("").alias("country"))
    links = ids.select("s1", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("k")).select("s1", F.concat(F.lit("S2-"), "k").alias("cand"), (F.pmod(F.xxhash64("s1", "k"), F.lit(10)) / 10).alias("p"))
    tables = {"ids": ids, "scored": links, "truth": links.where("cand in ('S2-0', 'S2-3')").select("s1", "cand")}
    for name, df in tables.items():
        df.write.parquet(f"{tmp_path}/{name}")
    own, scored, truth = (spark.read.parquet(f"{tmp_path}/{name}") for name in tables)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = {(r[0], r[1]): r[2] for r in decide.two_thresholds(scored, truth, own, "EN", [0.3, 0.7]).collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    country, true, rows = dict(map(tuple, own.collect())), {tuple(r) for r in truth.collect()}, scored.collect()
    assert len(got) == 4
    for (first, other), f in got.items():
        have = {(r["s1"], r["cand"]) for r in rows if r["p"] >= (first if country[r["s1"]] == "EN" else other)}
        n = {s: (sum(x[0] == s for x in have & true), sum(x[0] == s for x in have - true), sum(x[0] == s for x in true - have)) for s in country}
        each = [0.0 if not tp else 1.25 * tp / (1.25 * tp + 0.25 * fn + fp) for tp, fp, fn in n.values()]
        assert math.isclose(f, sum(each) / len(each))
    one_side = decide.two_thresholds(scored, truth, own.where("country <> 'EN'"), "EN", [0.3, 0.7])
    assert one_side.count() == 4 and one_side.where("macro_f is null or isnan(macro_f)").count() == 0


def test_scores_write_less_than_the_texts(spark, tmp_path, monkeypatch):
    """F1 to F15, F17 to F23: whole entities, over four times the input, were written for scores; rounds give the same pairs."""
    from sparkweave.plans import queries

    random.seed(6)
    words = ["".join(random.choices("abcdefghij", k=7)) for _ in range(60)]
    rows = [(i, "\n".join(" ".join(random.choices(words, k=40)) for _ in range(2)), "en") for i in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    w = queries.Linked(spark, str(tmp_path))
    one = {tuple(r) for r in w.scored.collect()}
    monkeypatch.setattr(queries, "ROUND", 10)
    many = {tuple(r) for r in queries.Linked(spark, str(tmp_path)).scored.collect()}
    assert one and one == many and "ents" not in w.__dict__
    words_of = {r["entity_id"]: set(r["name_tokens"]) for r in w.ents.select("entity_id", "name_tokens").collect()}
    for r in w.scored.collect():
        x, y = words_of[r["s1"]], words_of[r["cand"]]
        assert r["p"] == round(len(x & y) / len(x | y), 6)


def test_words_beyond_the_known_ones_keep_apart(spark):
    rows = spark.createDataFrame([(["a", "b", "c"],), ([],), (["c", "d"],)], "w array<string>")
    known, seed = X.vocabulary(rows.select(F.explode("w").alias("word")), 1)
    got = [r[0] for r in rows.coalesce(1).select(X.numbered(F.col("w"), known, seed)).collect()]
    assert known == ["c"] and got[1] == [] and got[0][2] == got[2][0] == 0 and len({*got[0], *got[2]}) == 4


@pytest.mark.parametrize("limit", [3, 12, 1000])
def test_posting_lists_give_the_same_candidates(spark, limit):
    """lists of pruned keys, and no keys after one that fills a record's budget alone; repeated keys of a record count twice."""
    random.seed(limit)
    words = [f"word{i}" for i in range(12)]
    rows = [(f"S{i % 3 + 1}-{i}", " ".join(random.choices(words, k=4)), f"{random.randrange(9)} {' '.join(random.choices(words, k=3))}", "") for i in range(150)]
    ents = entities(spark.createDataFrame([*rows, ("S2-x", "word1 | word1 word2 | word1 word2", "", ""), ("S1-y", "", "", "")], RECORD))
    left, right = ents.where("source = 'S1'"), ents.where("source <> 'S1'")
    keys, cap = blocking.keys_passes(), {5: 9}
    want = {tuple(r) for r in blocking.candidates(left, right, keys, cap, limit, 30).select("s1", "cand", "ord").collect()}
    asked, lists = blocking.listed(left, right, keys, cap, limit, 30)
    assert want and {tuple(r) for r in blocking.found_in(asked, lists, limit).select("s1", "cand", "ord").collect()} == want
    every, _ = blocking.listed(left, right, keys, cap, 10**6, 30)
    assert asked.count() < every.count() or limit == 1000


def test_queries_write_only_what_they_read(spark, tmp_path, monkeypatch):
    """F2 to F13, F18 to F22: every scored pair was written for queries that read few of them."""
    from sparkweave.plans import queries

    random.seed(8)
    words = ["".join(random.choices("abcdefghij", k=7)) for _ in range(30)]
    rows = [(i, "\n".join(" ".join(random.choices(words, k=6)) for _ in range(4)), random.choice(["en", "de", None])) for i in range(60)]
    rows += [(61 + i, rows[i][1], "en") for i in range(9)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(queries, "ROUND", 20)
    w = queries.Linked(spark, str(tmp_path))
    every = sorted((r["s1"], -r["p"], r["cand"], r["ord"]) for r in w.scored.collect())
    places, many = {}, {}
    for s1, _, cand, _ in every:
        many[s1] = places[s1, cand] = many.get(s1, 0) + 1
    got = w.scores("p >= 0.9 or rank <= 2", True).collect()
    assert {(r["s1"], r["cand"]): (r["rank"], r["many"]) for r in got} == {(s1, cand): (places[s1, cand], many[s1]) for s1, p, cand, _ in every if -p >= 0.9 or places[s1, cand] <= 2}
    assert 0 < len(got) < len(every) / 2
    kept = {(r["s1"], r["cand"]) for r in w.scores("same").collect()}
    assert 0 < len(kept) and kept >= {(r["s1"], r["cand"]) for r in w.truth.collect()} & places.keys()
    read = []
    monkeypatch.setattr(queries.Linked, "scored", property(lambda self: read.append(1)))
    assert queries.pr_country_gate(spark, str(tmp_path)).first()["n_pairs"] == len(every) and queries.dc_country_tau(spark, str(tmp_path)).count() and not read


def test_copies_of_a_text_are_compared_once(spark):
    """Rows of a few texts: what is found is that of all rows compared, and no plan makes pairs of all copies."""
    texts = ["blue ring", "blue rings", "red bolt", "", None]
    rows = [(f"{i:04}", "XY"[i % 2], texts[i % 5]) for i in range(600)]
    df = spark.createDataFrame(rows, "id string, country string, text string")
    asked, pool = (df.withColumn("id", F.concat(F.lit(k), "id")) for k in ("q", "p"))
    got = retrieval.nearest(asked, pool, k=3, floor=0.2)
    vectors: dict = {}
    for r in retrieval.tfidf(asked.unionByName(pool)).collect():
        vectors.setdefault(r["id"], {})[r["gram"]] = r["weight"]
    want = set()
    for i, (n, country, _) in enumerate(rows):
        if own := vectors.get(f"q{n}"):
            near = [(-round(sum(x * vectors.get(f"p{m}", {}).get(g, 0.0) for g, x in own.items()), 6), f"p{m}") for m, there, _ in rows if there == country]
            want |= {(f"q{n}", c, -x, r) for r, (x, c) in enumerate(sorted(y for y in near if y[0] <= -0.2)[:3], 1)}
    assert {(r["s1"], r["cand"], r["cosine"], r["rank"]) for r in got.collect()} == want and want
    assert retrieval.texts_of(asked, pool).count() == 8


def test_out_of_fold_logistic_is_at_its_optimum_in_few_passes(spark):
    """Against Spark's own fit carried to its end; the number of jobs doesn't follow a fit's many iterations over all rows."""
    random.seed(48)
    rows = [(f"S1-{random.randrange(60)}", f"S2-{i}", float(x), float(y), float(random.random() < 1 / (1 + math.exp(3 - x - 0.5 * y)))) for i in range(3000) for x, y in [(random.randrange(5), 100 * random.randrange(7) - 300)] for y in [y / 100]]
    df = spark.createDataFrame(rows, "s1 string, cand string, x double, y double, label double").withColumn("same", F.lit(7.0))
    spark.sparkContext.setJobGroup("logistic", "logistic")
    got = learn.out_of_fold(df, ["x", "y", "same"], "logistic").cache()
    assert got.count() == 3000
    spark.sparkContext._jsc.clearJobGroup()
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("logistic")) <= 40
    vectors = VectorAssembler(inputCols=["x", "y", "same"], outputCol="features").transform(got)
    for k in range(5):
        model = LogisticRegression(maxIter=1000, tol=1e-13).fit(vectors.where(F.col("fold") != k))
        z = model.intercept + model.coefficients[0] * F.col("x") + model.coefficients[1] * F.col("y")
        assert got.where(F.col("fold") == k).agg(F.max(F.abs(F.col("p") - 1 / (1 + F.exp(-z))))).first()[0] < 1e-5
    got.unpersist()


def test_out_of_fold_logistic_of_classes_apart(spark):
    """Where no weight is the best, scores go to their limits: rows with x = 0 are never true, half of the others are."""
    rows = spark.createDataFrame([(f"S1-{i % 20}", f"S2-{i}", float(i % 3 > 0), float(i % 3 == 1)) for i in range(600)], "s1 string, cand string, x double, label double")
    got = learn.out_of_fold(rows, ["x"], "logistic")
    assert got.where(F.abs(F.col("p") - F.when(F.col("x") == 0, 0.0).otherwise(0.5)) > 0.02).count() == 0
    assert got.where("x = 0").agg(F.max("p")).first()[0] < 1e-6


def test_out_of_fold_logistic_sees_what_varies_little(spark):
    """Rows with y = 1 differ by a millionth in x, and that tells how often they are true."""
    random.seed(49)
    rows = [(f"S1-{i % 40}", f"S2-{i}", float(y), y * (1 - 1e-6 * j), float(y and random.random() < (0.8 if j else 0.2))) for i in range(4000) for y, j in [(int(i % 4 == 0), random.randrange(2))]]
    got = learn.out_of_fold(spark.createDataFrame(rows, "s1 string, cand string, y double, x double, label double"), ["y", "x"], "logistic")
    want = F.when(F.col("y") == 0, 0.0).when(F.col("x") == 1, 0.2).otherwise(0.8)
    assert got.where(F.abs(F.col("p") - want) > 0.08).count() == 0


def test_all_features_in_any_number_of_turns(spark, tmp_path, monkeypatch):
    """Whole records are joined to a bounded number of pairs at a time; the features are those of all pairs at once."""
    random.seed(50)
    words = ["garden", "tools", "steel", "pipes", "aka", "blue", "12", "light", "oak", "lamp"]
    text = lambda: "\n".join(" ".join(random.choices(words, k=random.randint(1, 6))) for _ in range(4))
    spark.createDataFrame([(i, text(), random.choice(["en", "de"])) for i in range(12)], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    names = ("name_ratio", "alias", "rank_inverse", "idf_shared", "idf_max_unshared", "provenance_code")
    runs = []
    for most in (1_000_000, 5):
        monkeypatch.setattr(queries, "WHOLE", most)
        out = queries.all_features(queries.Linked(spark, str(tmp_path), True), *names)
        runs.append((len(out.written_at), sorted((r["s1"], r["cand"], *(round(r[c], 9) for c in names)) for r in out.collect())))
    assert runs[0][0] == 1 < runs[1][0] and runs[0][1] == runs[1][1] and len(runs[0][1]) > 5
