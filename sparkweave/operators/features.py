"""Features of candidate pairs, by name; presets list those of each generation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkweave.functions import similarity as S
from sparkweave.operators.retrieval import token_idf

NAME = "name_exact name_ratio name_sort name_set name_partial name_jaccard name_shared name_gap name_gap_share alias".split()
ADDRESS = "addr_exact addr_ratio addr_sort addr_set addr_partial addr_jaccard number_jaccard number_shared addr_gap addr_blank".split()
CROSS = "country_same is_s3 both_product both_min both_max both_mean".split()
F26 = NAME + ADDRESS + CROSS
F31 = F26 + "latin_sort gram_jaccard number_any name_alone pin".split()
F33 = F31 + "cosine rank_inverse".split()
F38 = F33 + "name_addr cos_addr cos_name rank_addr rank_name".split()
F44 = F38 + "first_number number_conflict number_name name_not_addr same_name_other_addr name_number_conflict".split()
F40 = F38 + "both_blank one_blank".split()
F51 = F38 + "both_blank one_blank".split() + F44[38:] + "name_addr_agree cos_name_agree cos_addr_agree long_name_jaccard long_addr_jaccard".split()
F35A = F31 + "gram3_jaccard name_overlap number_count shared_addr_chars".split()
F35B = F33 + "provenance_code gram_jaccard_again".split()
F63 = F44 + "pin_equal pin_prefix pin_conflict pin_both addr_in addr_of addr_in_max name_in name_of idf_shared idf_jaccard idf_max_shared idf_max_unshared rare_shared rare_conflict url_equal url_in_name blank_moderate blank_strong".split()
PRESETS = {"f26": F26, "f31": F31, "f33": F33, "f35a": F35A, "f35b": F35B, "f38": F38, "f40": F40, "f44": F44, "f51": F51, "f63": F63, "f4": F26[:4], "f17": F26[:17], "f20": F26[:20]}


def paired(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """pairs (s1, cand, ...) with both entities as structs a and b."""
    struct = lambda df, name: df.select(F.col("entity_id"), F.struct(*df.columns).alias(name))
    return pairs.join(struct(left, "a").withColumnRenamed("entity_id", "s1"), "s1").join(struct(right, "b").withColumnRenamed("entity_id", "cand"), "cand")


def flag(c: Column) -> Column:
    return F.coalesce(c, F.lit(False)).cast("double")


def words_from(text: Column, least: int) -> Column:
    return F.array_distinct(F.filter(F.split(text, " "), lambda t: F.length(t) >= least))


def basic(rows: DataFrame) -> DataFrame:
    """Adds the features of F31 to rows with a and b; string scores as shares of one."""
    a, b = F.col("a"), F.col("b")
    blank = (a["address"] == "") | (b["address"] == "")
    unless = lambda c: F.when(blank, 0.0).otherwise(c)
    gap = lambda f: F.abs(F.length(a[f]) - F.length(b[f])).cast("double")
    # A side whose transliteration is blank compares blank strings, which costs nothing.
    other = F.when(b["latin_name"] != "", F.struct(a["name"].alias("x"), b["latin_name"].alias("y"))).when(a["latin_name"] != "", F.struct(a["latin_name"].alias("x"), b["name"].alias("y")))
    rows = rows.withColumns({"__name": S.string_scores(a["name"], b["name"]), "__addr": S.string_scores(F.when(~blank, a["address"]).otherwise(""), F.when(~blank, b["address"]).otherwise("")), "__latin": S.token_sort_ratio(F.coalesce(other["x"], F.lit("")), F.coalesce(other["y"], F.lit("")))})
    latin = F.when((a["latin_name"] == "") & (b["latin_name"] == ""), 0.0).otherwise(F.col("__latin"))
    name, address = F.col("__name"), F.col("__addr")
    out = rows.select(
        "*",
        flag((a["name"] == b["name"]) & (a["name"] != "")).alias("name_exact"),
        (name["ratio"] / 100).alias("name_ratio"),
        (name["sort"] / 100).alias("name_sort"),
        (name["set"] / 100).alias("name_set"),
        (name["partial"] / 100).alias("name_partial"),
        S.jaccard(a["name_tokens"], b["name_tokens"]).alias("name_jaccard"),
        S.shared(a["name_tokens"], b["name_tokens"]).cast("double").alias("name_shared"),
        gap("name").alias("name_gap"),
        (1 - gap("name") / F.greatest(F.length(a["name"]), F.length(b["name"]), F.lit(1))).alias("name_gap_share"),
        F.lit(0.0).alias("alias"),
        flag((a["address"] == b["address"]) & ~blank).alias("addr_exact"),
        unless(address["ratio"] / 100).alias("addr_ratio"),
        unless(address["sort"] / 100).alias("addr_sort"),
        unless(address["set"] / 100).alias("addr_set"),
        unless(address["partial"] / 100).alias("addr_partial"),
        S.jaccard(a["address_tokens"], b["address_tokens"]).alias("addr_jaccard"),
        S.jaccard(a["numbers"], b["numbers"]).alias("number_jaccard"),
        S.shared(a["numbers"], b["numbers"]).cast("double").alias("number_shared"),
        gap("address").alias("addr_gap"),
        flag(blank).alias("addr_blank"),
        flag((a["country"] == b["country"]) & (a["country"] != "")).alias("country_same"),
        flag(b["source"] == "S3").alias("is_s3"),
        (F.greatest(name["sort"], latin) / 100).alias("latin_sort"),
        S.jaccard(a["grams"], b["grams"]).alias("gram_jaccard"),
        flag(F.arrays_overlap(a["numbers"], b["numbers"])).alias("number_any"),
        F.when((a["pincode"] == "") | (b["pincode"] == ""), 0.0).when(a["pincode"] == b["pincode"], 1.0).otherwise(-1.0).alias("pin"),
    )
    n, d, e = F.col("name_sort"), F.col("addr_sort"), F.col("addr_blank") == 1
    return out.drop("__name", "__addr", "__latin").select(
        "*",
        F.when(e, n * n).otherwise(n * d).alias("both_product"),
        F.when(e, n).otherwise(F.least(n, d)).alias("both_min"),
        F.greatest(n, d).alias("both_max"),
        F.when(e, n).otherwise((n + d) / 2).alias("both_mean"),
        F.when(e, F.col("latin_sort") * F.col("name_jaccard")).otherwise(0.0).alias("name_alone"),
    )


def alias_hits(rows: DataFrame, least: float = 85.0) -> DataFrame:
    """(s1, cand, hit) of rows with a name and aliases of b that are alike."""
    from sparkweave.functions import text as X

    each = rows.where(F.size("b.aliases") >= 2).select("s1", "cand", F.col("a.name").alias("n"), F.explode("b.aliases").alias("x"))
    return each.where(S.token_sort_ratio(F.col("n"), X.normalize_name(F.col("x"))) >= least).select("s1", "cand").distinct().withColumn("hit", F.lit(1.0))


def with_alias(rows: DataFrame, least: float = 85.0) -> DataFrame:
    """The alias feature of training in the first generation: any alias of the candidate is like the name. Rows may have it in
    hit already (from alias_hits())."""
    rows = rows if "hit" in rows.columns else rows.join(alias_hits(rows, least), ["s1", "cand"], "left")
    return rows.withColumn("alias", F.coalesce("hit", F.lit(0.0))).drop("hit")


def retrieved(rows: DataFrame) -> DataFrame:
    """Adds what comes of cosine and rank (0 where not retrieved), and the further features of F38 to F51."""
    n, d, c, r, e = F.col("name_sort"), F.col("addr_sort"), F.col("cosine"), F.col("rank_inverse"), F.col("addr_blank") == 1
    a, b = F.col("a"), F.col("b")
    rows = rows.withColumn("rank_inverse", F.when(F.col("rank") > 0, 1 / F.col("rank")).otherwise(0.0))
    unless = lambda x: F.when(e, 0.0).otherwise(x)
    conflict = (F.size(a["numbers"]) > 0) & (F.size(b["numbers"]) > 0) & (F.col("number_any") == 0)
    return rows.select(
        "*",
        unless(n * d).alias("name_addr"), unless(c * d).alias("cos_addr"), (c * n).alias("cos_name"), unless(r * d).alias("rank_addr"), (r * n).alias("rank_name"),
        flag(F.get(a["numbers"], F.lit(0)) == F.get(b["numbers"], F.lit(0))).alias("first_number"),
        flag(conflict).alias("number_conflict"), (F.col("number_any") * (1 - n)).alias("number_name"), unless(n * (1 - d)).alias("name_not_addr"),
        flag((n >= 0.85) & (d < 0.40) & ~e).alias("same_name_other_addr"), flag((n >= 0.80) & conflict).alias("name_number_conflict"),
        flag((a["address"] == "") & (b["address"] == "")).alias("both_blank"), flag((a["address"] == "") != (b["address"] == "")).alias("one_blank"),
        F.when(e, 0.5).otherwise(1 - F.abs(n - d)).alias("name_addr_agree"), (1 - F.abs(c - n)).alias("cos_name_agree"), unless(1 - F.abs(c - d)).alias("cos_addr_agree"),
        S.jaccard(words_from(a["name"], 4), words_from(b["name"], 4)).alias("long_name_jaccard"), unless(S.jaccard(words_from(a["address"], 4), words_from(b["address"], 4))).alias("long_addr_jaccard"),
    )


def variants(rows: DataFrame) -> DataFrame:
    """The further features of F35A and F35B; needs provenance for the latter."""
    from sparkweave.functions import text as X

    a, b = F.col("a"), F.col("b")
    chars = lambda x: F.aggregate(x, F.lit(0), lambda s, w: s + F.length(w))
    total = chars(F.array_union(a["address_tokens"], b["address_tokens"]))
    return rows.select(
        "*",
        S.jaccard(X.char_grams(a["name"], 3), X.char_grams(b["name"], 3)).alias("gram3_jaccard"),
        S.overlap(a["name_tokens"], b["name_tokens"]).alias("name_overlap"),
        F.col("number_shared").alias("number_count"),
        F.when(total == 0, 0.0).otherwise(chars(F.array_intersect(a["address_tokens"], b["address_tokens"])) / total).alias("shared_addr_chars"),
        F.when(F.col("provenance") == "block", 0.0).when(F.col("provenance") == "semantic", 1.0).otherwise(2.0).alias("provenance_code"),
        F.col("gram_jaccard").alias("gram_jaccard_again"),
    )


def word_sums(rows: DataFrame, entities: DataFrame) -> DataFrame:
    """(s1, cand, sum_shared, sum_all, idf_max_shared, idf_max_unshared) of rows with name_tokens of a and b; entities (with
    name_tokens) give words their weights, a word that none of them has that of a word never seen."""
    seen, unseen = token_idf(entities)
    a, b = F.col("a"), F.col("b")
    shared, apart = F.array_intersect(a["name_tokens"], b["name_tokens"]), F.array_union(F.array_except(a["name_tokens"], b["name_tokens"]), F.array_except(b["name_tokens"], a["name_tokens"]))
    words = rows.select("s1", "cand", F.explode(F.concat(F.transform(shared, lambda t: F.struct(t.alias("token"), F.lit(True).alias("both"))), F.transform(apart, lambda t: F.struct(t.alias("token"), F.lit(False).alias("both"))))).alias("w")).select("s1", "cand", "w.*")
    both = lambda agg: agg(F.when(F.col("both"), F.col("idf")))
    found = words.join(seen, "token", "left").crossJoin(F.broadcast(unseen)).withColumn("idf", F.coalesce("idf", "unseen"))
    return found.groupBy("s1", "cand").agg(both(F.sum).alias("sum_shared"), F.sum("idf").alias("sum_all"), both(F.max).alias("idf_max_shared"), F.max(F.when(~F.col("both"), F.col("idf"))).alias("idf_max_unshared"))


def weighted(rows: DataFrame, entities: DataFrame | None = None, fix_scale: bool = False) -> DataFrame:
    """Adds the features of F63 after F44. Without entities rows have what comes of word_sums() already. fix_scale compares the
    name score in percent."""
    a, b = F.col("a"), F.col("b")
    rows = rows if entities is None else rows.join(word_sums(rows, entities), ["s1", "cand"], "left")
    rows = rows.fillna(0.0, ["sum_shared", "sum_all", "idf_max_shared", "idf_max_unshared"])
    pins = (a["pincode"] != "") & (b["pincode"] != "")
    score = F.col("name_ratio") * (100 if fix_scale else 1)
    inside = lambda u, n: (F.length(u) >= 4) & n.contains(u)
    blank, high = F.col("addr_blank") == 1, F.col("idf_max_shared")
    contains = {"addr_in": S.containment(a["address_tokens"], b["address_tokens"]), "addr_of": S.containment(b["address_tokens"], a["address_tokens"]), "name_in": S.containment(a["name_tokens"], b["name_tokens"]), "name_of": S.containment(b["name_tokens"], a["name_tokens"])}
    return rows.select(
        "*",
        flag(pins & (a["pincode"] == b["pincode"])).alias("pin_equal"), flag(pins & (F.left(a["pincode"], F.lit(3)) == F.left(b["pincode"], F.lit(3)))).alias("pin_prefix"), flag(pins & (a["pincode"] != b["pincode"])).alias("pin_conflict"), flag(pins).alias("pin_both"),
        *(c.alias(k) for k, c in contains.items()), F.greatest(contains["addr_in"], contains["addr_of"]).alias("addr_in_max"),
        F.col("sum_shared").alias("idf_shared"), F.when(F.col("sum_all") > 0, F.col("sum_shared") / (F.col("sum_all") + 1e-5)).otherwise(0.0).alias("idf_jaccard"),
        flag(high >= 7).alias("rare_shared"), flag((F.col("idf_max_unshared") >= 7) & (high < 7)).alias("rare_conflict"),
        flag((a["url"] != "") & (a["url"] == b["url"])).alias("url_equal"), flag(inside(a["url"], b["name"]) | inside(b["url"], a["name"])).alias("url_in_name"),
        flag(blank & (score >= 65) & (score < 92)).alias("blank_moderate"), flag(blank & (score >= 94) & (high >= 5.5)).alias("blank_strong"),
    )
