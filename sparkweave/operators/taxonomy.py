"""Ordered classifications of pairs (a, b: entities). The order of the conditions is their meaning.

Scores in percent are given as columns name_sort, addr_sort (sorted words) and name_ratio, addr_ratio, so that none is
computed twice; with_scores adds them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkweave.functions import similarity as S
from sparkweave.functions import text as X
from sparkweave.functions import words as W


class Named:
    """A column by name, made when it is used: modules are imported before there is a session."""

    def __init__(self, name: str):
        self.name = name

    def __getitem__(self, field: str) -> Column:
        return F.col(self.name)[field]

    def __ge__(self, other: float) -> Column:
        return F.col(self.name) >= other

    def __gt__(self, other: float) -> Column:
        return F.col(self.name) > other

    def __lt__(self, other: float) -> Column:
        return F.col(self.name) < other


a, b, NAME, ADDR = map(Named, ("a", "b", "name_sort", "addr_sort"))


def with_scores(rows: DataFrame) -> DataFrame:
    both = rows.withColumns({"__name": S.two_scores(a["name"], b["name"]), "__addr": S.two_scores(a["address"], b["address"])})
    return both.select(*rows.columns, F.col("__name.sort").alias("name_sort"), F.col("__addr.sort").alias("addr_sort"), F.col("__name.ratio").alias("name_ratio"), F.col("__addr.ratio").alias("addr_ratio"))


def cases(*pairs: tuple[Column, str], other: str) -> Column:
    out = F.when(F.coalesce(pairs[0][0], F.lit(False)), pairs[0][1])
    for condition, name in pairs[1:]:
        out = out.when(F.coalesce(condition, F.lit(False)), name)
    return out.otherwise(other)


def blank() -> Column:
    return (a["address"] == "") | (b["address"] == "")


def shared_number() -> Column:
    return F.arrays_overlap(a["numbers"], b["numbers"])


def both(pattern: str) -> Column:
    return F.concat_ws(" ", a["raw_name"], b["raw_name"]).rlike(pattern)


def indic() -> Column:
    return X.has_indic(a["raw_name"]) | X.has_indic(b["raw_name"])


def has_any(words: Column, some: list[str]) -> Column:
    return F.arrays_overlap(words, F.array(*map(F.lit, some)))


def word_count(text: Column) -> Column:
    return F.size(X.tokens(text))


def miss_reason() -> Column:
    """Why blocking missed a pair."""
    return cases(
        (b["address"] == "", "empty_candidate_address_and_no_name_key"),
        ((a["country"] != b["country"]) & (a["country"] != "") & (b["country"] != ""), "country_mismatch"),
        (b["raw_name"].rlike(r"[^\x00-\x7f]"), "non_ascii_script_in_name"),
        (NAME >= 80, "high_name_similarity_but_missed_key"),
        (shared_number(), "shared_address_number_but_missed_composite_key"),
        other="low_name_and_low_address_similarity",
    )


def miss_category() -> Column:
    alias = both(r"(?i)\b(dba|aka|formerly|fka|group|division)\b") | (F.lower(a["raw_name"]).contains("llp") & ~F.lower(b["raw_name"]).contains("ltd") & (NAME < 50))
    return cases(
        (blank(), "H_missing_address"),
        (both(r"(?i)(\.com|\.in|\.org|\.co|\.net|www\.|http)") & (NAME < 60), "D_url_domain_mismatch"),
        (indic() & (NAME < 50), "B_transliteration_mismatch"),
        (alias, "C_dba_alias_mismatch"),
        ((F.size(a["numbers"]) > 0) & (F.size(b["numbers"]) > 0) & ~shared_number() & (ADDR > 50), "F_numeric_address_mismatch"),
        ((word_count(a["address"]) >= 6) & (word_count(b["address"]) <= 3) & (NAME < 70), "G_geographic_granularity_mismatch"),
        ((NAME >= 75) & (ADDR < 40), "A_name_representation_mismatch"),
        ((ADDR >= 75) & (NAME < 40), "E_address_representation_mismatch"),
        (a["name"].isin(*W.GENERIC_NAMES), "I_generic_name"),
        (ADDR >= 50, "E_address_representation_mismatch"),
        (NAME >= 50, "A_name_representation_mismatch"),
        other="J_other",
    )


def miss_class() -> Column:
    """Finer classes, with acronyms, suffixes and typing errors."""
    left, right = (X.content(x["name"], 1) for x in (a, b))
    acronym = ((F.size(left) >= 2) & (F.size(right) == 1) & (X.acronym(left) == F.get(right, F.lit(0)))) | ((F.size(right) >= 2) & (F.size(left) == 1) & (X.acronym(right) == F.get(left, F.lit(0))))
    shared = F.size(F.array_intersect(a["name_tokens"], b["name_tokens"]))
    core = lambda x: F.array_sort(x["name_tokens"])
    short = lambda c, n: F.length(c) < n
    url = ((a["url"] != "") & b["name"].contains(a["url"])) | ((b["url"] != "") & a["name"].contains(b["url"]))
    return cases(
        (indic() & ((a["latin_name"] != "") | (b["latin_name"] != "")), "A_cross_script_transliteration"),
        (url, "D_domain_website_variation"),
        ((F.size(a["aliases"]) > 1) | (F.size(b["aliases"]) > 1), "B_dba_brand_vs_legal"),
        (acronym, "K_acronym"),
        ((short(a["name"], 4) | short(b["name"], 4)) & (a["name"] != b["name"]), "L_very_short_names"),
        ((core(a) == core(b)) & (F.size(a["name_tokens"]) > 0), "E_legal_suffix_divergence"),
        (short(a["address"], 5) | short(b["address"], 5), "G_weak_or_missing_address"),
        ((shared == 0) & (NAME < 30) & (ADDR > 70), "B_dba_brand_vs_legal"),
        ((shared == 0) & (NAME < 30) & (ADDR < 40), "C_parent_vs_brand_or_unrelated"),
        (shared == 0, "F_missing_business_name_tokens"),
        ((NAME > 70) & (ADDR < 40), "H_address_granularity_or_branch"),
        ((F.col("name_ratio") > 60) & (NAME > 65), "J_typographical_corruption"),
        ((F.size(a["numbers"]) > 0) & (F.size(b["numbers"]) > 0) & ~shared_number(), "H_address_granularity_or_branch"),
        other="N_other",
    )


def dba_subtype() -> Column:
    domain = both(r"(?i)(\.com|\.in|\.org|\.co|\.net|www\.|http|@)")
    single = (word_count(a["name"]) == 1) | (word_count(b["name"]) == 1)
    longer = F.when(F.length(a["name"]) > F.length(b["name"]), a["name"]).otherwise(b["name"])
    shorter = F.replace(F.when(F.length(a["name"]) > F.length(b["name"]), b["name"]).otherwise(a["name"]), F.lit(" "), F.lit(""))
    initials = X.acronym(X.content(longer, 1))
    return cases(
        (domain & ((ADDR >= 50) | shared_number()), "C_website_domain_variation"),
        (domain, "D_website_redirect_weak_address"),
        (both(r"(?i)\b(dba|aka|formerly|fka|trade|trading as|operating as)\b"), "A_dba_vs_legal_entity"),
        (indic(), "J_cross_script_dba"),
        ((F.length(a["address"]) < 10) | (F.length(b["address"]) < 10), "G_empty_or_weak_address"),
        (single & (initials != "") & (initials == shorter), "E_abbreviated_brand_acronym"),
        (single, "B_brand_vs_parent_company"),
        ((ADDR >= 60) & (NAME < 50), "F_missing_business_name_tokens"),
        other="I_legal_suffix_dominating",
    )


def recovered_class() -> Column:
    legal = F.array(*map(F.lit, W.LEGAL))
    x, y = (F.array_sort(F.array_distinct(X.tokens(e["name"]))) for e in (a, b))
    suffix = (F.array_except(x, legal) == F.array_except(y, legal)) & (F.array_intersect(x, legal) != F.array_intersect(y, legal))
    domains = [F.concat_ws("\n", a["raw_name"], b["raw_name"]).contains(d) for d in (".com", ".in", ".org")]
    return cases(
        (blank(), "missing_address"),
        (indic(), "transliteration"),
        (domains[0] | domains[1] | domains[2], "website_domain_variation"),
        (suffix, "legal_suffix_variation"),
        ((F.size(a["aliases"]) > 1) | (F.size(b["aliases"]) > 1), "dba_brand_variation"),
        ((F.col("name_ratio") >= 80) & (a["name"] != b["name"]), "spelling_variation"),
        ((F.length(a["name"]) <= 5) | (F.length(b["name"]) <= 5), "abbreviation"),
        ((ADDR >= 80) & (F.col("addr_ratio") < 70), "reordered_address"),
        (ADDR >= 60, "address_variation"),
        (has_any(F.array_intersect(x, y), W.GENERIC), "generic_business_name"),
        (b["name"].contains(a["name"]) | a["name"].contains(b["name"]), "parent_child_business"),
        other="other",
    )


def false_positive_class() -> Column:
    """Four classes; the second holds for any pair whose second address is missing."""
    return cases(
        ((a["name"] == b["name"]) & (a["address"] != b["address"]), "homonymous_same_name_diff_address"),
        (((NAME >= 85) & (a["address"] == "")) | (b["address"] == ""), "similar_name_missing_address"),
        ((NAME >= 80) & (ADDR >= 60), "generic_chain_branch_collision"),
        other="fuzzy_noise_collision",
    )


def false_positive_class_six() -> Column:
    same = (F.size(a["numbers"]) > 0) & (F.array_sort(a["numbers"]) == F.array_sort(b["numbers"]))
    return cases(
        ((a["name"] == b["name"]) & (a["address"] != b["address"]), "same_name_diff_address"),
        (same & (NAME < 50), "same_address_num_diff_business"),
        (blank(), "empty_address_ambiguity"),
        ((NAME >= 85) & (a["address"] != b["address"]), "high_name_sim_branch_or_locality"),
        (has_any(X.tokens(a["name"]), W.GENERIC_FP), "generic_company_name_collision"),
        other="other_hard_negative",
    )


def false_negative_class() -> Column:
    return cases((blank(), "missing_address_low_name_sim"), (NAME < 50, "heavy_transliteration_or_dba"), (ADDR < 50, "address_format_or_landmark_mismatch"), other="marginal_probability_below_threshold")


def recoverability(name_score: Column, address_score: Column) -> tuple[Column, Column]:
    """Whether raw scores are hopeless, and whether they promise recovery."""
    return (name_score < 30) & (address_score < 30), (name_score >= 50) | (address_score >= 50) | ((name_score >= 35) & (address_score >= 35))


def ledger(truth: DataFrame, candidates: DataFrame, links: DataFrame) -> DataFrame:
    """Wrong pairs (s1, cand, error_type): missed as candidates, rejected by the matcher, or linked wrongly."""
    on = ["s1", "cand"]
    missed = truth.join(candidates, on, "left_anti").select(*on, F.lit("FN_CANDIDATE_MISS").alias("error_type"))
    rejected = truth.join(candidates, on, "left_semi").join(links, on, "left_anti").select(*on, F.lit("FN_MATCHER_REJECTED").alias("error_type"))
    return missed.unionByName(rejected).unionByName(links.join(truth, on, "left_anti").select(*on, F.lit("FP").alias("error_type")))
