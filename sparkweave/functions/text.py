"""Text functions on columns: normalization, tokens, numbers, aliases, scripts. Null counts as empty throughout."""

from __future__ import annotations

import unicodedata
from itertools import groupby

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkweave.functions import words as W

#: All but letters, digits, underscore, white space, hyphen and slash; marks don't count as letters.
PUNCT = r"[^\p{L}\p{N}_\s\p{Z}\x1c-\x1f\x85\-/]"
BLANKS = r"[\s\p{Z}\x1c-\x1f\x85]+"
ALIAS = r"(?i)(?<![\p{L}\p{N}_])(?:aka|dba|d/b/a|formerly|f/k/a|fka)(?![\p{L}\p{N}_])"
URL = r"(?i)([a-zA-Z0-9\-]+)\.(?:com|in|org|net|co|io|biz|info|gov|edu|fr)"
PIN = r"(?<![\p{L}\p{N}_])(\p{Nd}{5,6})(?![\p{L}\p{N}_])"

#: Grams that are taken from one part of a text.
PART = 64


@F.pandas_udf(T.StringType())
def strip_accents(text: pd.Series) -> pd.Series:
    """Compatibility decomposition without combining characters; ASCII passes through."""
    return text.map(lambda s: s if s is None or s.isascii() else "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c)))


def text_of(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def clean_base(raw: Column, older: bool = False) -> Column:
    """Lower-case words without accents and punctuation. older: hyphens and slashes go too, only "nan" counts as blank."""
    none = F.lower(text_of(raw)).isin(*(["nan"] if older else ["nan", "null", "none"]))
    text = F.replace(text_of(raw), F.lit("&"), F.lit(" and "))
    text = text if older else F.translate(text, "#@", "  ")
    text = F.lower(strip_accents(text))
    text = F.regexp_replace(text, PUNCT.replace(r"\-/", "") if older else PUNCT, " ")
    return F.when(none, "").otherwise(F.trim(F.regexp_replace(text, BLANKS, " ")))


def tokens(text: Column) -> Column:
    return F.filter(F.split(text, " "), lambda t: t != "")


def shorten(text: Column, table: dict[str, str]) -> Column:
    """Each word by its short form."""
    out = lambda t: F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), t), t)
    return F.array_join(F.transform(tokens(text), out), " ")


def presplit(raw: Column) -> Column:
    """Hyphens and slashes as blanks, before normalization."""
    return F.translate(text_of(raw), "-/", "  ")


def normalize_name(raw: Column) -> Column:
    return shorten(clean_base(raw), W.NAME_SHORT)


def normalize_address(raw: Column, older: bool = False) -> Column:
    return shorten(clean_base(raw, older), {k: v for k, v in W.ADDRESS_SHORT.items() if not older or k != "court"})


def aliases(raw: Column) -> Column:
    return F.filter(F.transform(F.split(text_of(raw), ALIAS), lambda p: F.trim(F.regexp_replace(p, rf"^{BLANKS}|{BLANKS}$", ""))), lambda p: p != "")


def url_core(text: Column) -> Column:
    """Label before a common top-level domain, "" if there is none. Normalized names hold no dots: give it raw ones."""
    return F.when(text_of(text).contains("."), F.lower(F.regexp_extract(text_of(text), URL, 1))).otherwise("")


def numbers(address: Column) -> Column:
    """House and door numbers of a normalized address in order, each once, without leading zeros."""
    bare = lambda d: F.when(F.ltrim(d, F.lit("0")) == "", "0").otherwise(F.ltrim(d, F.lit("0")))
    own = lambda t: F.filter(F.array(bare(F.regexp_extract(t, "^([0-9]+)", 1))), lambda d: F.length(d) <= 7)
    parts = lambda t: F.transform(F.filter(F.split(F.translate(t, "/-", "  "), " "), lambda d: d.rlike(r"^\p{Nd}{1,7}$")), bare)
    none = F.array().cast("array<string>")
    each = F.transform(tokens(address), lambda t: F.when(t.rlike("^[0-9]+[a-zA-Z]?$"), own(t)).when(t.rlike("[/-]"), parts(t)).otherwise(none))
    return F.array_distinct(F.flatten(each))


def has_indic(text: Column) -> Column:
    return text_of(text).rlike(f"[{chr(W.INDIC_FIRST)}-{chr(W.INDIC_LAST)}]")


_LATIN = {c: W.INDIC_LATIN[at] for c in range(W.INDIC_FIRST, W.INDIC_LAST + 1) if (at := (c - W.INDIC_FIRST) % W.INDIC_BLOCK) in W.INDIC_LATIN}


def _latin(s: str | None) -> str:
    return s.translate(_LATIN) if s and any(W.INDIC_FIRST <= ord(c) <= W.INDIC_LAST for c in s) else ""


@F.pandas_udf(T.StringType())
def transliterate(text: pd.Series) -> pd.Series:
    """Latin sounds of Brahmic letters; "" for a text without any."""
    return text.map(lambda s: "" if s is None or s.isascii() else _latin(s))


@F.pandas_udf(T.StringType())
def clean_indic(text: pd.Series) -> pd.Series:
    """Transliteration after single Brahmic letters that stand alone are joined to words."""

    def alone(w: str) -> bool:
        return sum(not unicodedata.combining(c) and unicodedata.category(c)[0] != "M" for c in w) == 1 and any(W.INDIC_FIRST <= ord(c) <= W.INDIC_LAST for c in w)

    def one(s: str | None) -> str:
        runs = [(k, list(g)) for k, g in groupby((s or "").split(), alone)]
        return _latin(" ".join(x for k, g in runs for x in (["".join(g)] if k else g)))

    return text.map(one)


@F.pandas_udf(T.StringType())
def script(text: pd.Series) -> pd.Series:
    """The commonest script of the letters, as the first word of their Unicode names; ties to the first seen."""

    def one(s: str | None) -> str:
        names = [unicodedata.name(c, "UNKNOWN").split()[0] for c in s or "" if c.isalpha()]
        return max(dict.fromkeys(names), key=names.count) if names else "NONE"

    return text.map(one)


def numbered(words: Column, known: list[str], seed: str) -> Column:
    """Words as numbers: the place in known, or for others a negative hash, which vocabulary() makes sure that no two share."""
    places = pa.array(known, pa.string())

    @F.arrow_udf("array<bigint>")
    def run(words: pa.Array, hashes: pa.Array) -> pa.Array:
        at = pc.index_in(words.flatten(), value_set=places)
        return pa.ListArray.from_arrays(pa.concat_arrays([pa.array([0], pa.int32()), pc.cumulative_sum(pc.fill_null(pc.list_value_length(words), 0)).cast(pa.int32())]), pc.coalesce(at.cast(pa.int64()), hashes.flatten()))

    return run(words, F.transform(words, lambda w: word_hash(w, seed)))


def word_hash(word: Column, seed: str) -> Column:
    return F.bitwise_not(F.xxhash64(word, F.lit(seed)).bitwiseAND(F.lit((1 << 63) - 1)))


def vocabulary(words: DataFrame, most: int = 65_536) -> tuple[list[str], str]:
    """The commonest words (rows of `word`), and a seed by which the hashes of all words differ."""
    seen = words.groupBy("word").agg(F.count("*").alias("n"))
    known = [r[0] for r in seen.orderBy(F.desc("n"), "word").select("word").limit(most).collect()]
    for seed in map(str, range(100)):
        n, apart = words.select("word").distinct().select(word_hash(F.col("word"), seed).alias("h")).agg(F.count("*"), F.countDistinct("h")).first()
        if n == apart:
            return known, seed
    raise RuntimeError("no seed tells the words apart")


def skeleton(text: Column) -> Column:
    return F.regexp_replace(F.lower(text_of(text)), r"[^\p{L}]|[aeiou]", "")


def name_tokens(name: Column, more: bool = True) -> Column:
    """Distinct words of a normalized name without stop words."""
    return F.array_distinct(content(name, 1, more))


def content(name: Column, least: int = 2, more: bool = True) -> Column:
    """Words of a normalized name in order, without stop words and shorter ones."""
    stop = W.NAME_STOP + (W.NAME_STOP_MORE if more else [])
    return F.filter(tokens(name), lambda t: (F.length(t) >= least) & ~t.isin(*stop))


def address_tokens(address: Column, more: bool = True) -> Column:
    stop = W.ADDRESS_STOP + (W.ADDRESS_STOP_MORE if more else [])
    return F.array_distinct(F.filter(tokens(address), lambda t: ~t.isin(*stop)))


def address_words(address: Column, more: bool = True) -> Column:
    """Words of four characters and more, no stop words or numbers; with more, none that hold a digit."""
    stop = W.ADDRESS_STOP + (W.ADDRESS_STOP_MORE if more else [])
    return F.filter(tokens(address), lambda t: (F.length(t) >= 4) & ~t.isin(*stop) & ~t.rlike(r"\p{Nd}" if more else r"^\p{Nd}+$"))


def pincode(raw: Column) -> Column:
    return F.regexp_extract(text_of(raw), PIN, 1)


def postal(raw: Column, country: Column) -> Column:
    """Six digits not led by 0 for India, five with an optional four for the US."""
    india = F.regexp_extract(text_of(raw), r"(?<!\w)([1-9][0-9]{5})(?!\w)", 1)
    return F.when(country == "INDIA", india).when(country == "US", F.regexp_extract(text_of(raw), r"(?<!\w)([0-9]{5})(?:-[0-9]{4})?(?!\w)", 1)).otherwise("")


def char_grams(name: Column, n: int = 4, short: bool = False) -> Column:
    """Distinct n-grams of the characters without blanks; short: a shorter text is its own gram."""
    text = F.replace(name, F.lit(" "), F.lit(""))
    # A place in a string is found from its start, so grams are taken from short parts.
    parts = F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1)), F.lit(PART)), lambda i: F.substr(text, i, F.lit(PART + n - 1)))
    some = F.flatten(F.transform(parts, lambda p: F.transform(F.sequence(F.lit(1), F.greatest(F.length(p) - n + 1, F.lit(1))), lambda i: F.substr(p, i, F.lit(n)))))
    none = F.when(F.lit(short) & (text != ""), F.array(text)).otherwise(F.array().cast("array<string>"))
    return F.when(F.length(text) >= n, F.array_distinct(some)).otherwise(none)


def sound_fold(text: Column) -> Column:
    for a, b in (("x", "ks"), ("ph", "f"), ("ee", "i"), ("oo", "u")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def stem(words: Column, least: int = 6) -> Column:
    """The first two words joined, "" if that is shorter than least."""
    joined = F.array_join(F.slice(words, 1, 2), "")
    return F.when(F.length(joined) >= least, joined).otherwise("")


def acronym(words: Column) -> Column:
    return F.array_join(F.transform(words, lambda w: F.left(w, F.lit(1))), "")


def by_length(words: Column) -> Column:
    """Distinct words, longest first, then by name."""
    return F.transform(F.array_sort(F.transform(F.array_distinct(words), lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w")))), lambda s: s["w"])


def represent(kind: str, name: Column, address: Column, latin: Column) -> Column:
    """Text for retrieval: name, name_addr or name_latin_addr."""
    parts = {"name": [name], "name_addr": [name, address], "name_latin_addr": [name, latin, address]}[kind]
    return F.concat_ws(" ", *(F.when(p != "", p) for p in parts))


def short(text: Column) -> Column:
    """The text itself up to 32 characters, else its SHA-256: equal where texts are."""
    return F.when(F.length(text) <= 32, text).otherwise(F.sha2(text, 256))


def country_key(country: Column) -> Column:
    return F.upper(F.trim(text_of(country)))
