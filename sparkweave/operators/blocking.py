"""Blocking: keys of records, frequency pruning, and the joins that make candidate pairs.

Keys are an array of (step, ktype, kval) in a fixed order; a step is the pass that uses the key, kval the parts of the key
joined by U+0001. Keys are exploded, counted, pruned and joined; posting lists are built of pruned keys only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkweave.functions import text as X
from sparkweave.sources.store import dropped, materialized

KEYS = "array<struct<step:int,ktype:string,kval:string>>"


def key(step: int, kind: str, *parts: Column) -> Column:
    return F.struct(F.lit(step).alias("step"), F.lit(kind).alias("ktype"), F.concat_ws("\u0001", *parts).alias("kval"))


def at(words: Column, i: int) -> Column:
    return F.get(words, F.lit(i))


def one(step: int, kind: str, value: Column, least: int = 1) -> Column:
    """The value as a key, if it is that long."""
    return F.when(F.length(value) >= least, F.array(key(step, kind, value))).otherwise(F.array().cast(KEYS))


def pair(step: int, kind: str, words: Column, i: int, j: int) -> Column:
    """Two words of the list, in order of the alphabet."""
    two = F.array_sort(F.array(at(words, i), at(words, j)))
    return F.when(F.size(words) > max(i, j), F.array(key(step, kind, at(two, 0), at(two, 1)))).otherwise(F.array().cast(KEYS))


def each(step: int, kind: str, words: Column, first: int, least: int = 1) -> Column:
    """Keys of the first words that are long enough."""
    return F.transform(F.filter(F.slice(words, 1, first), lambda w: F.length(w) >= least), lambda w: key(step, kind, w))


def product(step: int, kind: str, left: Column, right: Column, n: int, m: int) -> Column:
    return F.flatten(F.transform(F.slice(left, 1, n), lambda a: F.transform(F.slice(right, 1, m), lambda b: key(step, kind, a, b))))


def alias_keys(pair_step: int, word_step: int, split: bool) -> Column:
    """Of each alias but the first part: the pair of its first two words, and each of them."""
    words = F.transform(F.slice("aliases", 2, 1_000_000), lambda a: X.tokens(F.lower(X.presplit(a) if split else a)))
    words = F.transform(words, lambda w: F.filter(w, lambda t: (F.length(t) >= 3) & ~t.isin(*X.W.NAME_STOP)))
    pairs = F.flatten(F.transform(words, lambda w: pair(pair_step, "name_pair", w, 0, 1)))
    singles = F.flatten(F.transform(words, lambda w: each(word_step, "name_tok", w, 2)))
    return F.concat(pairs, singles)


def keys_base(split: bool = False, alias: bool = True, words: Column | None = None) -> Column:
    """Eight kinds of keys in one pass, those of aliases among them."""
    c, n, w = F.col("content"), F.col("numbers"), F.col("address_words") if words is None else words
    return F.concat(
        one(1, "exact_name", F.col("name"), 4), one(1, "url_core", F.col("url"), 4), pair(1, "name_pair", c, 0, 1), pair(1, "name_pair", c, 0, 2), each(1, "name_tok", c, 2, 3),
        product(1, "num_word", n, w, 2, 2), product(1, "name_num", c, n, 2, 2), pair(1, "addr_pair", w, 0, 1), pair(1, "addr_pair", w, 0, 2), *([alias_keys(1, 1, split)] if alias else []),
    )


def keys_smart(alias: bool = True) -> Column:
    """The precursor of the base keys: address words may hold digits, if not only these."""
    return keys_base(alias=alias, words=X.address_words(F.col("address"), False))


def keys_toy() -> Column:
    """A small set for inspection: words of the name, its first pair, and numbers with words of either field."""
    own = lambda text, stop, least: F.filter(X.tokens(text), lambda t: ~t.isin(*stop) & (F.length(t) >= least))
    name, address = own(F.col("name"), X.W.TOY_NAME_STOP, 1), own(F.col("address"), X.W.TOY_ADDRESS_STOP, 1)
    digits = lambda t: t.rlike(r"^\p{Nd}+$")
    long_, first = (F.filter(w, lambda t: F.length(t) >= 3) for w in (name, F.slice(name, 1, 2)))
    numbers, words = F.filter(address, digits), F.filter(address, lambda t: ~digits(t) & (F.length(t) >= 3))
    return F.concat(F.transform(long_, lambda t: key(1, "name_tok", t)), pair(1, "name_pair", name, 0, 1), product(1, "num_word", numbers, words, 2, 3), product(1, "name_num", first, numbers, 2, 2))


def keys_passes(recover: frozenset[str] = frozenset()) -> Column:
    """Six ordered passes. recover adds A (joined stem as a domain), B and C (words by length in passes 4 and 6),
    D (the longest word where there is no number) and F (folded sounds)."""
    c, n, w, latin = F.col("content"), F.col("numbers"), F.col("address_words"), F.col("latin_content")
    long_ = X.by_length(w)
    parts = [one(1, "exact_name", F.col("name"), 4), one(1, "url_core", F.col("url"), 4), pair(1, "name_pair", c, 0, 1), pair(1, "name_pair", c, 0, 2), pair(1, "name_pair", c, 1, 2)]
    if "A" in recover:
        parts.append(one(1, "url_core", X.stem(c), 6))
    aliases = alias_keys(1, 5, True)
    parts.append(F.filter(aliases, lambda k: k["step"] == 1))
    parts += [pair(2, "name_pair", latin, 0, 1), each(2, "name_tok", latin, 2)]
    if "F" in recover:
        parts.append(each(2, "name_tok", F.transform(c, lambda w: X.sound_fold(w)), 2, 3))
    parts += [product(3, "name_num", c, n, 2, 2), product(4, "num_word", n, long_ if "B" in recover else w, 3, 3), each(5, "name_tok", c, 2, 4), F.filter(aliases, lambda k: k["step"] == 5)]
    if "D" in recover:
        parts.append(F.when(F.size(n) == 0, each(5, "name_tok", X.by_length(c), 1, 6)).otherwise(F.array().cast(KEYS)))
    own = long_ if "C" in recover else w
    return F.concat(*parts, pair(6, "addr_pair", own, 0, 1), pair(6, "addr_pair", own, 0, 2))


def keys_naive() -> Column:
    """First word in the alphabet, first two, and the first three characters."""
    words = F.array_sort(F.col("name_tokens"))
    return F.concat(each(1, "tok", words, 1), pair(1, "pair", words, 0, 1), one(1, "prefix3", F.left("name", F.lit(3)), 3))


def keys_stages() -> Column:
    """Exact, domain, words, word pair, prefix, postal code, and words with postal code or numbers."""
    c, pin = F.col("content"), F.filter(F.array("pincode"), lambda p: p != "")
    return F.concat(one(1, "exact_name", F.col("name"), 4), one(2, "url_core", F.col("url"), 4), each(3, "name_tok", c, 2), pair(4, "name_pair", c, 0, 1), one(5, "prefix4", F.left("name", F.lit(4)), 4), each(6, "postal", pin, 1), product(7, "name_postal", c, pin, 1, 1), product(8, "name_num", c, F.col("numbers"), 1, 2))


def keys_composite() -> Column:
    """Only keys of two parts, over the first three longer words."""
    long_ = F.filter(F.col("content"), lambda t: F.length(t) >= 3)
    return F.concat(one(1, "exact_name", F.col("name"), 4), pair(1, "name_pair", long_, 0, 1), pair(1, "name_pair", long_, 0, 2), product(2, "name_num", long_, F.col("numbers"), 3, 3), product(3, "num_word", F.col("numbers"), F.col("address_words"), 3, 3))


def keys_india() -> Column:
    """Recovery for one country: postal code with number, number pairs, transliterated words alone and with numbers."""
    n, latin = F.col("numbers"), F.col("latin_content")
    return F.concat(product(7, "pin_num", F.filter(F.array("pincode"), lambda p: p != ""), n, 1, 3), pair(7, "num_pair", n, 0, 1), each(7, "latin_tok", latin, 2, 3), product(7, "latin_num", latin, n, 2, 2))


def keys_grams() -> Column:
    """Four-grams of the name, for pre-filtering similarity."""
    return F.transform("grams", lambda g: key(1, "gram", g))


#: Key sets by name; base is the first generation, passes the second and third, the others are variants.
PRESETS: dict[str, Callable[[], Column]] = {
    "base": keys_base,
    "smart": keys_smart,
    "smart_no_alias": lambda: keys_smart(False),
    "toy": keys_toy,
    "priority": keys_passes,  # the same keys and passes, found without a precomputed table
    "passes": keys_passes,
    "passes_recovery": lambda: keys_passes(frozenset("ABCDF")),
    "passes_long_words": lambda: keys_passes(frozenset("B")),
    "naive": keys_naive,
    "stages": keys_stages,
    "composite": keys_composite,
    "india": keys_india,
    "grams": keys_grams,
}


def exploded(entities: DataFrame, keys: Column) -> DataFrame:
    """(entity_id, source, country, ord, step, ktype, kval)"""
    return entities.select("entity_id", "source", "country", F.posexplode(keys).alias("ord", "k")).select("entity_id", "source", "country", "ord", "k.*")


def frequencies(postings: DataFrame) -> DataFrame:
    """Posting-list sizes per key and source; a record that repeats a key counts twice."""
    return postings.groupBy("ktype", "kval", "source").agg(F.count("*").alias("n"))


def candidates(left: DataFrame, right: DataFrame, keys: Column, cap: int | dict[int, int] | None = None, limit: int | None = None, other_cap: int = 400) -> DataFrame:
    """(s1, cand, ord): pairs that share a key, with the first key that makes them.

    A key counts for a source only if its posting list there is no longer than the cap (one number, or by step of the
    asking key with other_cap for the rest). limit: once a record has as many candidates after a key, later keys of it
    count no more. The pruned frequencies are joined before the pairs are made, so a key's fan-out is bounded by its cap.
    """
    asked = exploded(left, keys).select(F.col("entity_id").alias("s1"), "ord", "step", "ktype", "kval")
    postings = exploded(right, keys)
    many = frequencies(postings)
    if cap is not None:
        most = F.lit(cap) if isinstance(cap, int) else F.lit(other_cap)
        many = many.where(F.col("n") <= (cap if isinstance(cap, int) else max([*cap.values(), other_cap])))
        if not isinstance(cap, int):
            for step, n in cap.items():
                most = F.when(F.col("step") == step, F.lit(n)).otherwise(most)
        asked = asked.join(many, ["ktype", "kval"]).where(F.col("n") <= most).drop("n")
        lists = postings.select("ktype", "kval", "source", F.col("entity_id").alias("cand")).distinct()
        found = asked.join(lists, ["ktype", "kval", "source"])
    else:
        found = asked.join(postings.select("ktype", "kval", F.col("entity_id").alias("cand")).distinct(), ["ktype", "kval"])
    # What follows groups by s1, so that found is dealt out once, whatever else the groups are made by.
    first = found.select("s1", "cand", "ord").repartition("s1").groupBy("s1", "cand").agg(F.min("ord").alias("ord"))
    return first if limit is None else within_budget(first, limit)


def within_budget(first: DataFrame, limit: int) -> DataFrame:
    """Candidates up to the key after which a record has limit of them; what that key brings in beyond stays.

    A pair stays if fewer than limit pairs of its record came by earlier keys: counted over the record's rows in order, so no
    counts are joined back."""
    before = F.count("*").over(Window.partitionBy("s1").orderBy("ord").rangeBetween(Window.unboundedPreceding, -1))
    return first.withColumn("__before", before).where(F.col("__before") < limit).drop("__before")


def listed(left: DataFrame, right: DataFrame, keys: Column, cap: dict[int, int], limit: int, other_cap: int = 400) -> tuple[DataFrame, DataFrame]:
    """(s1, ord, id) and (id, cands): the keys of left that count in candidates(), and the posting lists they name, each made
    once. A list is that of a key in one source and no longer than the greatest cap. Keys of a record after one whose lists
    alone bring in limit candidates are left out: what they bring in would be over the budget."""
    asked = exploded(left, keys).select(F.col("entity_id").alias("s1"), "ord", "step", "ktype", "kval")
    postings = exploded(right, keys).select("ktype", "kval", "source", F.col("entity_id").alias("cand"))
    many = frequencies(postings).where(F.col("n") <= max([*cap.values(), other_cap]))
    many = materialized(many.join(asked.select("ktype", "kval").distinct(), ["ktype", "kval"], "left_semi").withColumn("id", F.monotonically_increasing_id()), "keys")
    lists = materialized(postings.join(many, ["ktype", "kval", "source"]).groupBy("id").agg(F.sort_array(F.collect_set("cand")).alias("cands")), "lists")
    most = F.lit(other_cap)
    for step, n in cap.items():
        most = F.when(F.col("step") == step, F.lit(n)).otherwise(most)
    asked = asked.join(many.drop("source"), ["ktype", "kval"]).where(F.col("n") <= most).select("s1", "ord", "id")
    sized = asked.join(lists.select("id", F.size("cands").alias("n")), "id").repartition("s1")
    of_key = sized.withColumn("n", F.sum("n").over(Window.partitionBy("s1", "ord")))
    before = F.max("n").over(Window.partitionBy("s1").orderBy("ord").rangeBetween(Window.unboundedPreceding, -1))
    asked = materialized(of_key.withColumn("before", before).where(F.coalesce("before", F.lit(0)) < limit).select("s1", "ord", "id"), "asked")
    dropped(many)
    return asked, lists


def found_in(asked: DataFrame, lists: DataFrame, limit: int) -> DataFrame:
    """(s1, cand, ord) of candidates() for some records of listed(). Whole lists go to a record, their rows are made there."""
    found = asked.join(lists, "id").select("s1", "ord", "cands").repartition("s1").select("s1", "ord", F.explode("cands").alias("cand"))
    return within_budget(found.groupBy("s1", "cand").agg(F.min("ord").alias("ord")), limit)


def two_tier(left: DataFrame, right: DataFrame, first: int = 300, second: int = 80, few: int = 4, most: int = 25) -> DataFrame:
    """Composite keys; single words only for records with fewer than few candidates; then the first `most` of each."""
    lead = candidates(left, right, keys_composite(), first)
    enough = lead.groupBy("s1").agg(F.count("*").alias("n")).where(F.col("n") >= few).select(F.col("s1").alias("entity_id"))
    more = candidates(left.join(enough, "entity_id", "left_anti"), right, each(9, "name_tok", F.col("content"), 2, 3), second).withColumn("ord", F.col("ord") + 1000)
    both = lead.unionByName(more).groupBy("s1", "cand").agg(F.min("ord").alias("ord"))
    return both.withColumn("r", F.row_number().over(Window.partitionBy("s1").orderBy("ord", "cand"))).where(F.col("r") <= most).drop("r")


def stem_probe(left: DataFrame, right: DataFrame, cap: int = 5) -> DataFrame:
    """(s1, cand, stem): pairs whose domain or joined first words agree, by stems that few records have."""
    stems = lambda df: df.select("entity_id", F.explode(F.array_distinct(F.filter(F.array(F.when(F.length("raw_url") >= 6, F.col("raw_url")).otherwise(""), X.stem(F.col("content"), 8)), lambda s: s != ""))).alias("stem"))
    there = stems(right)
    rare = there.groupBy("stem").agg(F.count("*").alias("n")).where(F.col("n") <= cap).select("stem")
    return stems(left).select(F.col("entity_id").alias("s1"), "stem").join(there.join(rare, "stem").select("stem", F.col("entity_id").alias("cand")), "stem").groupBy("s1", "cand").agg(F.max("stem").alias("stem"))
