"""DuckDB SQL for the same plans, made of the same word lists."""

from __future__ import annotations

from sparkweave.functions import words as W


def _in(words: list[str]) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


def _short(column: str, table: dict[str, str]) -> str:
    return f"array_to_string(list_transform(list_filter(string_split({column}, ' '), lambda t: t <> ''), lambda t: CASE t " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + " ELSE t END), ' ')"


def _clean(column: str) -> str:
    return rf"CASE WHEN lower({column}) IN ('nan', 'null', 'none') THEN '' ELSE trim(regexp_replace(regexp_replace(lower(strip_accents(translate(replace({column}, '&', ' and '), '#@', '  '))), '[^\p{{L}}\p{{N}}_\s\-/]', ' ', 'g'), '\s+', ' ', 'g')) END"


RECORDS = """
rec0 AS (SELECT doc_id, lang, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x) <> '') AS l FROM documents),
rec1 AS (SELECT *, unnest(range(0, greatest(1, CAST((len(l) + 1) // 2 AS BIGINT)))) AS i FROM rec0),
rec AS (
  SELECT 'S' || (doc_id % 3 + 1) || '-' || doc_id || '-' || i AS entity_id, coalesce(l[2 * i + 1], '') AS business_name,
    coalesce(l[2 * i + 2], '') AS business_address, upper(coalesce(lang, '')) AS country
  FROM rec1
)"""

_STOP_N, _STOP_A = _in(W.NAME_STOP + W.NAME_STOP_MORE), _in(W.ADDRESS_STOP + W.ADDRESS_STOP_MORE)
_NUM = "coalesce(nullif(ltrim(regexp_extract(t, '^([0-9]+)', 1), '0'), ''), '0')"

ENTITIES = (
    RECORDS
    + f""", ent0 AS (
  SELECT entity_id, left(entity_id, 2) AS source, upper(trim(country)) AS country, business_name AS raw_name, business_address AS raw_address,
    {_clean("translate(business_name, '-/', '  ')")} AS n0, {_clean("translate(business_address, '-/', '  ')")} AS a0, {_clean("business_name")} AS n1
  FROM rec
), ent1 AS (SELECT *, {_short("n0", W.NAME_SHORT)} AS name, {_short("a0", W.ADDRESS_SHORT)} AS address, {_short("n1", W.NAME_SHORT)} AS plain_name FROM ent0),
ent2 AS (SELECT *, list_filter(string_split(name, ' '), lambda t: t <> '') AS nt, list_filter(string_split(address, ' '), lambda t: t <> '') AS adt FROM ent1),
ent AS (
  SELECT *, list_filter(nt, lambda t: length(t) >= 2 AND t NOT IN {_STOP_N}) AS content, list_distinct(list_filter(nt, lambda t: t NOT IN {_STOP_N})) AS name_tokens,
    list_distinct(list_filter(adt, lambda t: t NOT IN {_STOP_A})) AS address_tokens,
    list_filter(adt, lambda t: length(t) >= 4 AND t NOT IN {_STOP_A} AND NOT regexp_matches(t, '[0-9]')) AS address_words,
    list_filter(list_transform(list_filter(adt, lambda t: regexp_full_match(t, '[0-9]+[a-zA-Z]?')), lambda t: {_NUM}), lambda d: length(d) <= 7) AS num0,
    regexp_extract(raw_address, '(^|[^\\p{{L}}\\p{{N}}_])([0-9]{{5,6}})($|[^\\p{{L}}\\p{{N}}_])', 2) AS pincode
  FROM ent2
), ents AS (
  SELECT * EXCLUDE num0, list_filter(num0, lambda d, i: list_position(num0, d) = i) AS numbers FROM ent
)"""
)



def older(column: str, short: dict[str, str]) -> str:
    """The older normalization of a column."""
    text = rf"trim(regexp_replace(regexp_replace(lower(strip_accents(replace({column}, '&', ' and '))), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '\s+', ' ', 'g'))"
    return _short(f"(CASE WHEN lower({column}) = 'nan' THEN '' ELSE {text} END)", short)


def _products(preset: str, step: int, kind: str, left: str, right: str, n: int, m: int) -> str:
    return f"SELECT entity_id, source, '{preset}' AS preset, {step} AS step, '{kind}' AS ktype, {left}[x] || chr(1) || {right}[y] AS kval FROM vents, (SELECT x, y FROM range(1, {n + 1}) a(x), range(1, {m + 1}) b(y)) v WHERE len({left}) >= x AND len({right}) >= y"


def _pairs(preset: str, step: int, kind: str, words: str, *places: tuple[int, int]) -> str:
    return f"SELECT entity_id, source, '{preset}', {step}, '{kind}', least({words}[x], {words}[y]) || chr(1) || greatest({words}[x], {words}[y]) FROM vents, (VALUES {', '.join(map(str, places))}) v(x, y) WHERE len({words}) >= y"


def _each(preset: str, step: int, kind: str, words: str, first: int = 1_000_000_000, least: int = 1) -> str:
    return f"SELECT entity_id, source, '{preset}', {step}, '{kind}', unnest(list_filter({words}[1:{first}], lambda w: length(w) >= {least})) FROM vents"


def _one(preset: str, step: int, kind: str, value: str, least: int) -> str:
    return f"SELECT entity_id, source, '{preset}', {step}, '{kind}', {value} FROM vents WHERE length({value}) >= {least}"


_TOY_N, _TOY_A = _in(W.TOY_NAME_STOP), _in(W.TOY_ADDRESS_STOP)
VARIANTS = (
    ENTITIES
    + f""", vents AS (
  SELECT *, list_sort(name_tokens) AS sorted, list_filter(content, lambda t: length(t) >= 3) AS long_, CASE WHEN pincode = '' THEN [] ELSE [pincode] END AS pins, list_filter(nt, lambda t: t NOT IN {_TOY_N}) AS tn,
    list_filter(list_filter(nt, lambda t: t NOT IN {_TOY_N})[1:2], lambda t: length(t) >= 3) AS tfirst, list_filter(adt, lambda t: t NOT IN {_TOY_A} AND regexp_full_match(t, '\\p{{Nd}}+')) AS tnum,
    list_filter(adt, lambda t: t NOT IN {_TOY_A} AND NOT regexp_full_match(t, '\\p{{Nd}}+') AND length(t) >= 3) AS tw,
    list_filter(adt, lambda t: length(t) >= 4 AND t NOT IN {_in(W.ADDRESS_STOP)} AND NOT regexp_full_match(t, '\\p{{Nd}}+')) AS sw,
    CASE WHEN length(replace(name, ' ', '')) >= 4 THEN list_distinct(list_transform(range(1, CAST(length(replace(name, ' ', '')) AS BIGINT) - 2), lambda i: substr(replace(name, ' ', ''), i, 4))) ELSE [] END AS grams
  FROM ents
), variants AS (
  """
    + " UNION ALL ".join([
        _products("composite", 2, "name_num", "long_", "numbers", 3, 3), _one("composite", 1, "exact_name", "name", 4), _pairs("composite", 1, "name_pair", "long_", (1, 2), (1, 3)), _products("composite", 3, "num_word", "numbers", "address_words", 3, 3),
        _each("naive", 1, "tok", "sorted", 1), _pairs("naive", 1, "pair", "sorted", (1, 2)), _one("naive", 1, "prefix3", "left(name, 3)", 3),
        _one("stages", 1, "exact_name", "name", 4), _each("stages", 3, "name_tok", "content", 2), _pairs("stages", 4, "name_pair", "content", (1, 2)), _one("stages", 5, "prefix4", "left(name, 4)", 4), _each("stages", 6, "postal", "pins"), _products("stages", 7, "name_postal", "content", "pins", 1, 1), _products("stages", 8, "name_num", "content", "numbers", 1, 2),
        _one("smart_no_alias", 1, "exact_name", "name", 4), _pairs("smart_no_alias", 1, "name_pair", "content", (1, 2), (1, 3)), _each("smart_no_alias", 1, "name_tok", "content", 2, 3), _products("smart_no_alias", 1, "num_word", "numbers", "sw", 2, 2), _products("smart_no_alias", 1, "name_num", "content", "numbers", 2, 2), _pairs("smart_no_alias", 1, "addr_pair", "sw", (1, 2), (1, 3)),
        _each("toy", 1, "name_tok", "tn", least=3), _pairs("toy", 1, "name_pair", "tn", (1, 2)), _products("toy", 1, "num_word", "tnum", "tw", 2, 3), _products("toy", 1, "name_num", "tfirst", "tnum", 2, 2),
        _each("grams", 1, "gram", "grams"),
    ])
    + ")"
)



def _met(name: str, keys: str, cap: int, left: str = "true") -> str:
    """Pairs of S1 (those for which left holds) and the other sources that share a key of a short enough list."""
    return f"""{name}_f AS (SELECT ktype, kval, source, count(*) AS n FROM {keys} WHERE source <> 'S1' GROUP BY ALL),
{name} AS (SELECT k.entity_id AS s1, p.entity_id AS cand, min(k.ord) AS ord FROM {keys} k JOIN {name}_f f ON f.ktype = k.ktype AND f.kval = k.kval AND f.n <= {cap}
  JOIN (SELECT DISTINCT ktype, kval, source, entity_id FROM {keys}) p ON p.ktype = f.ktype AND p.kval = f.kval AND p.source = f.source WHERE k.source = 'S1' AND {left} GROUP BY ALL)"""


TWO_TIER = (
    VARIANTS
    + """, tk0 AS (
  SELECT entity_id, source, 1 AS part, 0 AS x, 0 AS y, 'exact_name' AS ktype, name AS kval FROM vents WHERE length(name) >= 4
  UNION ALL SELECT entity_id, source, 2, x, y, 'name_pair', least(long_[x], long_[y]) || chr(1) || greatest(long_[x], long_[y]) FROM vents, (VALUES (1, 2), (1, 3)) v(x, y) WHERE len(long_) >= y
  UNION ALL SELECT entity_id, source, 3, x, y, 'name_num', long_[x] || chr(1) || numbers[y] FROM vents, (SELECT x, y FROM range(1, 4) a(x), range(1, 4) b(y)) v WHERE len(long_) >= x AND len(numbers) >= y
  UNION ALL SELECT entity_id, source, 4, x, y, 'num_word', numbers[x] || chr(1) || address_words[y] FROM vents, (SELECT x, y FROM range(1, 4) a(x), range(1, 4) b(y)) v WHERE len(numbers) >= x AND len(address_words) >= y
), tk AS (SELECT entity_id, source, ktype, kval, row_number() OVER (PARTITION BY entity_id ORDER BY part, x, y) - 1 AS ord FROM tk0),
"""
    + _met("lead", "tk", 300)
    + """, enough AS (SELECT s1 FROM lead GROUP BY s1 HAVING count(*) >= 4),
sk AS (SELECT entity_id, source, 'name_tok' AS ktype, z.w AS kval, z.i + 999 AS ord FROM (SELECT entity_id, source, unnest(list_transform(list_filter(content[1:2], lambda w: length(w) >= 3), lambda w, i: {'w': w, 'i': i})) AS z FROM vents)),
"""
    + _met("more", "sk", 80, "k.entity_id NOT IN (SELECT s1 FROM enough)")
    + """, both_ AS (SELECT s1, cand, min(ord) AS ord FROM (SELECT * FROM lead UNION ALL SELECT * FROM more) GROUP BY ALL)
SELECT s1, cand, CAST(ord AS INTEGER) AS ord FROM (SELECT *, row_number() OVER (PARTITION BY s1 ORDER BY ord, cand) AS r FROM both_) WHERE r <= 25"""
)

#: Keys of the ordered passes. The tables hold no aliases, domains or Brahmic letters, so those keys have no rows here.
KEYS = (
    ENTITIES
    + """, k0 AS (
  SELECT entity_id, source, 1 AS part, 0 AS i, 0 AS j, 1 AS step, 'exact_name' AS ktype, name AS kval FROM ents WHERE length(name) >= 4
  UNION ALL SELECT entity_id, source, 2, x, y, 1, 'name_pair', least(content[x], content[y]) || chr(1) || greatest(content[x], content[y])
    FROM ents, (VALUES (1, 2), (1, 3), (2, 3)) v(x, y) WHERE len(content) >= y
  UNION ALL SELECT entity_id, source, 3, x, y, 3, 'name_num', content[x] || chr(1) || numbers[y]
    FROM ents, (VALUES (1, 1), (1, 2), (2, 1), (2, 2)) v(x, y) WHERE len(content) >= x AND len(numbers) >= y
  UNION ALL SELECT entity_id, source, 4, x, y, 4, 'num_word', numbers[x] || chr(1) || address_words[y]
    FROM ents, (SELECT x, y FROM range(1, 4) a(x), range(1, 4) b(y)) v WHERE len(numbers) >= x AND len(address_words) >= y
  UNION ALL SELECT entity_id, source, 5, x, 0, 5, 'name_tok', content[x] FROM ents, (VALUES (1), (2)) v(x) WHERE len(content) >= x AND length(content[x]) >= 4
  UNION ALL SELECT entity_id, source, 6, x, y, 6, 'addr_pair', least(address_words[x], address_words[y]) || chr(1) || greatest(address_words[x], address_words[y])
    FROM ents, (VALUES (1, 2), (1, 3)) v(x, y) WHERE len(address_words) >= y
), keys AS (SELECT entity_id, source, step, ktype, kval, row_number() OVER (PARTITION BY entity_id ORDER BY part, i, j) - 1 AS ord FROM k0)"""
)

PAIRS = (
    KEYS
    + """, freq AS (SELECT ktype, kval, source, count(*) AS n FROM keys WHERE source <> 'S1' GROUP BY ALL),
post AS (SELECT DISTINCT ktype, kval, source, entity_id AS cand FROM keys WHERE source <> 'S1'),
first AS (
  SELECT k.entity_id AS s1, p.cand, min(k.ord) AS ord FROM keys k JOIN freq f ON k.ktype = f.ktype AND k.kval = f.kval AND f.n <= CASE k.step WHEN 5 THEN 150 ELSE 400 END
    JOIN post p ON p.ktype = f.ktype AND p.kval = f.kval AND p.source = f.source
  WHERE k.source = 'S1' GROUP BY ALL
), per_key AS (SELECT s1, ord, count(*) AS n FROM first GROUP BY ALL),
cum AS (SELECT s1, ord, sum(n) OVER (PARTITION BY s1 ORDER BY ord) AS cum FROM per_key),
stop AS (SELECT s1, min(ord) AS stop FROM cum WHERE cum >= 120 GROUP BY s1),
pairs AS (SELECT f.s1, f.cand, f.ord FROM first f LEFT JOIN stop s USING (s1) WHERE s.stop IS NULL OR f.ord <= s.stop),
ids AS (SELECT entity_id AS s1, country FROM ents WHERE source = 'S1'),
txt AS (SELECT entity_id, left(entity_id, 2) AS src, md5(business_name || chr(1) || business_address) AS h FROM rec WHERE business_name <> ''),
low AS (SELECT h, src, min(entity_id) AS cand FROM txt WHERE src <> 'S1' GROUP BY ALL),
truth AS (SELECT a.entity_id AS s1, b.cand FROM txt a JOIN low b ON a.h = b.h WHERE a.src = 'S1'),
scored AS (
  SELECT p.s1, p.cand, a.country AS ca, b.country AS cb, a.pincode AS pa, b.pincode AS pb,
    round(CASE WHEN len(list_distinct(a.name_tokens || b.name_tokens)) = 0 THEN 0 ELSE len(list_intersect(a.name_tokens, b.name_tokens)) / len(list_distinct(a.name_tokens || b.name_tokens)) END, 6) AS p
  FROM pairs p JOIN ents a ON p.s1 = a.entity_id JOIN ents b ON p.cand = b.entity_id
)"""
)


def counted(links: str, by: str = "") -> str:
    """Per-record counts and scores of the links in a table expression."""
    return f"""SELECT i.s1, i.country{by}, tp, fp, fn, tp + fn AS n_true,
  CASE WHEN tp + fp + fn = 0 THEN 1.0 WHEN tp = 0 THEN 0.0 ELSE 1.25 * (tp / (tp + fp)) * (tp / (tp + fn)) / (0.25 * (tp / (tp + fp)) + tp / (tp + fn)) END AS f,
  CASE WHEN tp + fp > 0 THEN tp / (tp + fp) WHEN tp + fp + fn = 0 THEN 1.0 ELSE 0.0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) WHEN tp + fp + fn = 0 THEN 1.0 ELSE 0.0 END AS r
FROM {links}"""


def _cases(*pairs: tuple[str, str], other: str) -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN '{name}'" for c, name in pairs) + f" ELSE '{other}' END"


def _share(field: str, of: str) -> str:
    both, of = f"len(list_intersect(a.{field}, b.{field}))", of.format(f"a.{field}", f"b.{field}")
    return f"round(CASE WHEN {of} = 0 THEN 0 ELSE 100 * ({both} / {of}) END, 4)"


_UNION, _LEAST = "len(list_distinct({0} || {1}))", "least(len({0}), len({1}))"
PERCENTS = f"{_share('name_tokens', _UNION)} AS ns, {_share('address_tokens', _UNION)} AS ads, {_share('name_tokens', _LEAST)} AS nr, {_share('address_tokens', _LEAST)} AS adr"
_BLANK, _NUMBER = "(a.address = '' OR b.address = '')", "list_has_any(a.numbers, b.numbers)"
_APART = f"(len(a.numbers) > 0 AND len(b.numbers) > 0 AND NOT {_NUMBER})"
_INDIC = "regexp_matches(a.raw_name || b.raw_name, '[\\x{0900}-\\x{0D7F}]')"
_WORDS, _OWN = "list_filter(string_split({}, ' '), lambda t: t <> '')", f"list_filter(string_split({{}}, ' '), lambda t: t <> '' AND t NOT IN {_STOP_N})"
_ALIASES = "list_filter(string_split_regex({}.raw_name, '(?i)\\b(?:aka|dba|d/b/a|formerly|f/k/a|fka)\\b'), lambda t: trim(t) <> '')"
_ACRONYM = "array_to_string(list_transform({}, lambda t: left(t, 1)), '')"
_SINGLE = f"(len({_WORDS.format('a.name')}) = 1 OR len({_WORDS.format('b.name')}) = 1)"
_LONGER = "CASE WHEN length(a.name) > length(b.name) THEN a.name ELSE b.name END"
_SHORTER = "replace(CASE WHEN length(a.name) > length(b.name) THEN b.name ELSE a.name END, ' ', '')"
_MANY = f"(len({_ALIASES.format('a')}) > 1 OR len({_ALIASES.format('b')}) > 1)"


def _both(pattern: str) -> str:
    return f"regexp_matches(a.raw_name || ' ' || b.raw_name, '{pattern}')"


def _initials(x: str, y: str) -> str:
    own, other = _OWN.format(f"{x}.name"), _OWN.format(f"{y}.name")
    return f"(len({own}) >= 2 AND len({other}) = 1 AND {_ACRONYM.format(own)} = {other}[1])"


def _legal(x: str, keep: bool) -> str:
    return f"list_sort(list_distinct(list_filter(string_split({x}.name, ' '), lambda t: t <> '' AND t {'' if keep else 'NOT'} IN {_in(W.LEGAL)})))"


#: Every classification of a pair (a, b) with its scores ns, ads (words), nr, adr, as an expression.
CLASSES = {
    "miss_reason": _cases(("b.address = ''", "empty_candidate_address_and_no_name_key"), ("a.country <> b.country AND a.country <> '' AND b.country <> ''", "country_mismatch"), ("regexp_matches(b.raw_name, '[^\\x00-\\x7f]')", "non_ascii_script_in_name"), ("ns >= 80", "high_name_similarity_but_missed_key"), (_NUMBER, "shared_address_number_but_missed_composite_key"), other="low_name_and_low_address_similarity"),
    "miss_category": _cases(
        (_BLANK, "H_missing_address"), (_both("(?i)(\\.com|\\.in|\\.org|\\.co|\\.net|www\\.|http)") + " AND ns < 60", "D_url_domain_mismatch"), (f"{_INDIC} AND ns < 50", "B_transliteration_mismatch"),
        (_both("(?i)\\b(dba|aka|formerly|fka|group|division)\\b") + " OR (contains(lower(a.raw_name), 'llp') AND NOT contains(lower(b.raw_name), 'ltd') AND ns < 50)", "C_dba_alias_mismatch"),
        (f"{_APART} AND ads > 50", "F_numeric_address_mismatch"), (f"len({_WORDS.format('a.address')}) >= 6 AND len({_WORDS.format('b.address')}) <= 3 AND ns < 70", "G_geographic_granularity_mismatch"),
        ("ns >= 75 AND ads < 40", "A_name_representation_mismatch"), ("ads >= 75 AND ns < 40", "E_address_representation_mismatch"), (f"a.name IN {_in(W.GENERIC_NAMES)}", "I_generic_name"),
        ("ads >= 50", "E_address_representation_mismatch"), ("ns >= 50", "A_name_representation_mismatch"), other="J_other",
    ),
    "miss_class": _cases(
        (f"{_INDIC} AND false", "A_cross_script_transliteration"), (_MANY, "B_dba_brand_vs_legal"), (f"{_initials('a', 'b')} OR {_initials('b', 'a')}", "K_acronym"),
        ("(length(a.name) < 4 OR length(b.name) < 4) AND a.name <> b.name", "L_very_short_names"), ("list_sort(a.name_tokens) = list_sort(b.name_tokens) AND len(a.name_tokens) > 0", "E_legal_suffix_divergence"),
        ("length(a.address) < 5 OR length(b.address) < 5", "G_weak_or_missing_address"), ("len(list_intersect(a.name_tokens, b.name_tokens)) = 0 AND ns < 30 AND ads > 70", "B_dba_brand_vs_legal"),
        ("len(list_intersect(a.name_tokens, b.name_tokens)) = 0 AND ns < 30 AND ads < 40", "C_parent_vs_brand_or_unrelated"), ("len(list_intersect(a.name_tokens, b.name_tokens)) = 0", "F_missing_business_name_tokens"),
        ("ns > 70 AND ads < 40", "H_address_granularity_or_branch"), ("nr > 60 AND ns > 65", "J_typographical_corruption"), (_APART, "H_address_granularity_or_branch"), other="N_other",
    ),
    "dba_subtype": _cases(
        (_both("(?i)(\\.com|\\.in|\\.org|\\.co|\\.net|www\\.|http|@)") + f" AND (ads >= 50 OR {_NUMBER})", "C_website_domain_variation"), (_both("(?i)(\\.com|\\.in|\\.org|\\.co|\\.net|www\\.|http|@)"), "D_website_redirect_weak_address"),
        (_both("(?i)\\b(dba|aka|formerly|fka|trade|trading as|operating as)\\b"), "A_dba_vs_legal_entity"), (_INDIC, "J_cross_script_dba"), ("length(a.address) < 10 OR length(b.address) < 10", "G_empty_or_weak_address"),
        (f"{_SINGLE} AND {_ACRONYM.format(_OWN.format('(' + _LONGER + ')'))} <> '' AND {_ACRONYM.format(_OWN.format('(' + _LONGER + ')'))} = {_SHORTER}", "E_abbreviated_brand_acronym"),
        (_SINGLE, "B_brand_vs_parent_company"), ("ads >= 60 AND ns < 50", "F_missing_business_name_tokens"), other="I_legal_suffix_dominating",
    ),
    "recovered": _cases(
        (_BLANK, "missing_address"), (_INDIC, "transliteration"), (" OR ".join(f"contains(a.raw_name || chr(10) || b.raw_name, '{d}')" for d in (".com", ".in", ".org")), "website_domain_variation"),
        (f"{_legal('a', False)} = {_legal('b', False)} AND {_legal('a', True)} <> {_legal('b', True)}", "legal_suffix_variation"), (_MANY, "dba_brand_variation"), ("nr >= 80 AND a.name <> b.name", "spelling_variation"),
        ("length(a.name) <= 5 OR length(b.name) <= 5", "abbreviation"), ("ads >= 80 AND adr < 70", "reordered_address"), ("ads >= 60", "address_variation"),
        (f"len(list_filter(list_intersect({_WORDS.format('a.name')}, {_WORDS.format('b.name')}), lambda t: t IN {_in(W.GENERIC)})) > 0", "generic_business_name"), ("contains(b.name, a.name) OR contains(a.name, b.name)", "parent_child_business"), other="other",
    ),
    "fp": _cases(("a.name = b.name AND a.address <> b.address", "homonymous_same_name_diff_address"), ("(ns >= 85 AND a.address = '') OR b.address = ''", "similar_name_missing_address"), ("ns >= 80 AND ads >= 60", "generic_chain_branch_collision"), other="fuzzy_noise_collision"),
    "fp_six": _cases(
        ("a.name = b.name AND a.address <> b.address", "same_name_diff_address"), ("len(a.numbers) > 0 AND list_sort(a.numbers) = list_sort(b.numbers) AND ns < 50", "same_address_num_diff_business"), (_BLANK, "empty_address_ambiguity"),
        ("ns >= 85 AND a.address <> b.address", "high_name_sim_branch_or_locality"), (f"len(list_filter({_WORDS.format('a.name')}, lambda t: t IN {_in(W.GENERIC_FP)})) > 0", "generic_company_name_collision"), other="other_hard_negative",
    ),
    "fn": _cases((_BLANK, "missing_address_low_name_sim"), ("ns < 50", "heavy_transliteration_or_dba"), ("ads < 50", "address_format_or_landmark_mismatch"), other="marginal_probability_below_threshold"),
    "recoverable": _cases(("ns < 30 AND ads < 30", "hopeless"), ("ns >= 50 OR ads >= 50 OR (ns >= 35 AND ads >= 35)", "hopeful"), other="neither"),
}


def nearest(floor: float) -> str:
    """The table `ranked` of the nearest texts within a country, from txts (id, country, text, q: asks, p: is asked for)."""
    return rf"""wrds AS (SELECT id, country, q, p, ' ' || unnest(list_filter(string_split_regex(lower(text), '\s+'), lambda x: x <> '')) || ' ' AS wrd FROM txts),
grms AS (SELECT id, country, q, p, unnest(list_transform(range(1, length(wrd) - n + 2), lambda i: substr(wrd, CAST(i AS BIGINT), n))) AS gram FROM (SELECT *, unnest([3, 4, 5]) AS n FROM wrds) WHERE length(wrd) >= n),
tf AS (SELECT id, country, q, p, gram, 1 + ln(count(*)) AS tf, count(*) AS n FROM grms GROUP BY ALL), total AS (SELECT country, count(*) AS docs FROM txts GROUP BY country),
terms AS (SELECT country, gram, count(*) AS df, sum(n) AS uses FROM tf GROUP BY ALL),
vocab AS (SELECT country, gram, ln((docs + 1) / (df + 1)) + 1 AS idf, row_number() OVER (PARTITION BY country ORDER BY uses DESC, gram) AS r FROM terms JOIN total USING (country) WHERE df >= 2),
raw AS (SELECT id, country, q, p, gram, tf * idf AS w FROM tf JOIN vocab USING (country, gram) WHERE r <= 30000), norms AS (SELECT id, sqrt(sum(w * w)) AS norm FROM raw GROUP BY id),
unit AS (SELECT raw.id, country, q, p, gram, w / norm AS w FROM raw JOIN norms ON raw.id = norms.id),
cosines AS (SELECT a.id AS s1, b.id AS cand, round(sum(a.w * b.w), 6) AS cosine FROM unit a JOIN unit b ON a.gram = b.gram AND a.country = b.country WHERE a.q AND b.p GROUP BY a.id, b.id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY s1 ORDER BY cosine DESC, cand) AS rank FROM cosines WHERE cosine >= {floor})"""
