"""Each operator against a brute-force version on small tables, with nulls, ties, repeats and clashing columns."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from sparkweave.llm import bpe, chat, exact, langid, licenses, lm, packing, simhash, substring, tokens, topk
from sparkweave.llm._common import components

WORDS = "alpha beta gamma delta eps zeta eta theta iota kappa".split()


def text(n: int) -> str:
    return " ".join(random.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    """Documents with copies, near copies, shared passages, nulls, blanks and columns whose names operators use."""
    random.seed(11)
    shared, base = text(40), text(120)
    rows = [(i, text(random.randint(0, 60)), "en") for i in range(40)]
    rows += [(100 + i, base, "en") for i in range(6)] + [(110 + i, base.replace(" ", "\n", i + 1), "en") for i in range(3)]
    rows += [(120 + i, f"{text(5)} {shared} {text(i)}", "fr") for i in range(8)]
    rows += [(200, None, None), (201, "", "en"), (202, " \t\n", "fr"), (203, "x", "en"), (204, shared + " " + shared, "fr"), (205, "Ünï çödé 漢字 <|endoftext|> it's", "de"), (206, base.upper(), "en"), (207, "12 34 .", "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    return df.select("doc_id", "text", "lang", *(F.lit(1).alias(c) for c in ("fp", "view", "digest", "kept", "ids", "n_words", "item", "bucket", "held_out", "score"))).repartition(3)


def plain(docs) -> dict[int, str]:
    return {r["doc_id"]: r["text"] or "" for r in docs.collect()}


def test_bpe_against_the_library(spark, docs):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    random.seed(2)
    odd = ["".join(random.choice("ab '\n\tst<|é1.漢́ AaA") for _ in range(random.randint(0, 40))) for _ in range(400)]
    mine = bpe.load(tokens.vocabulary())
    for got, want, t in zip(mine.encode(odd), own.encode_batch(odd, add_special_tokens=False), odd):
        assert np.frombuffer(got, "<u4").tolist() == want.ids and mine.decode(got) == own.decode(want.ids, skip_special_tokens=False), t
    texts = plain(docs)
    for r in tokens.encode(docs, tokens.vocabulary(), decoded=True).collect():
        want = own.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert np.frombuffer(r["ids"], "<u4").tolist() == want and r["decoded"] == own.decode(want, skip_special_tokens=False)
    again = tokens.decode(tokens.encode(docs, tokens.vocabulary()), tokens.vocabulary())
    assert {r["doc_id"]: r["decoded"] for r in again.collect()} == texts
    assert tokens.encode(docs.limit(0), tokens.vocabulary()).count() == 0


def thue_morse(n: int, a: str = "a", b: str = "b") -> str:
    """Word whose polynomial hash modulo a power of two equals that of its complement, whatever the base."""
    s = a
    while len(s) < n:
        s += s.translate(str.maketrans({a: b, b: a}))
    return s


@pytest.mark.parametrize("n", [1024, 4096])
def test_bpe_tells_words_of_one_hash_apart(n):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    own, mine = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), bpe.load(tokens.vocabulary())
    texts = [f"x {thue_morse(n)} {thue_morse(n, 'b', 'a')}", thue_morse(n, "b", "a"), thue_morse(n), f"{thue_morse(n)}a"]
    for _ in range(2):
        for got, want in zip(mine.encode(texts), own.encode_batch(texts, add_special_tokens=False)):
            assert np.frombuffer(got, "<u4").tolist() == want.ids and mine.decode(got) == own.decode(want.ids, skip_special_tokens=False)


def test_bpe_cuts_long_texts_only_between_tokens(monkeypatch):
    mine = bpe.load(tokens.vocabulary())
    random.seed(13)
    texts = ["".join(random.choice("ab '\n\t s1.\u00a0é") for _ in range(3000)) for _ in range(20)] + ["x" * 3000, " " * 3000]
    whole = mine.encode(texts)
    monkeypatch.setattr(bpe, "CHUNK_CHARS", 40)
    assert mine.encode(texts) == whole and any(len(bpe.cut_text(t)) > 20 for t in texts)


def brute_exact(rows):
    groups: dict[str, list] = {}
    for i, t in rows:
        groups.setdefault("".join((t or "").split()), []).append((-len(t or ""), i))
    return {i: (min(g)[1], len(g), min(g)[1] == i) for g in groups.values() for _, i in g}


@pytest.mark.parametrize("digest", ["sha256", "one", "first"])
def test_exact(spark, docs, digest):
    how = {"sha256": exact.sha256, "one": lambda t: F.encode(F.lit("x"), "utf-8"), "first": lambda t: F.encode(F.left(t, F.lit(1)), "utf-8")}[digest]
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in exact.duplicates(docs, how, files=1).collect()}
    assert got == brute_exact([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_exact_edges(spark):
    rows = spark.createDataFrame([(5, "a b"), (5, "a b"), (None, "ab"), (7, "q"), (None, "z")], "doc_id long, text string")
    got = [(r["keep_id"], r["group_size"]) for r in exact.duplicates(rows).where("kept").orderBy("group_size").collect()]
    assert sorted(got, key=str) == sorted([(5, 3), (7, 1), (None, 1)], key=str)
    assert exact.duplicates(rows.limit(0)).count() == 0
    assert sorted(r["text"] for r in exact.keep(rows).collect()) == ["a b", "q", "z"]


def brute_fingerprint(t: str, k: int) -> int:
    words = t.encode().lower().split()
    parts = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps: dict[int, int], radius: int) -> dict[int, int]:
    root = {i: i for i in fps}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in fps:
        for j in fps:
            if bin(fps[i] ^ fps[j]).count("1") <= radius:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in fps}


def test_simhash(spark, docs):
    fps = {i: brute_fingerprint(t, 3) for i, t in plain(docs).items()}
    rows = simhash.classes(docs).collect()
    assert {r["doc_id"]: r["fp"] % (1 << 64) for r in rows} == fps
    assert {r["doc_id"]: r["component_id"] for r in rows} == brute_components(fps, 2)
    assert simhash.classes(docs.limit(0)).count() == 0


def test_simhash_links_any_pair_within_two_bits(spark):
    random.seed(4)
    seeds = [random.getrandbits(64) for _ in range(40)]
    fps = [s ^ sum(1 << b for b in random.sample(range(64), n)) for s in seeds for n in (0, 1, 2, 3, 4)]
    chain = [seeds[0] ^ ((1 << 2 * i) - 1) for i in range(20)]
    fps = list(dict.fromkeys(fps + chain))
    nodes = spark.createDataFrame([(i, 0, simhash.signed(f)) for i, f in enumerate(fps)], "low long, view int, fp long")
    found = {r["node"]: r["root"] for r in components(simhash.links(nodes)).collect()}
    assert {i: found.get(i, i) for i in range(len(fps))} == brute_components(dict(enumerate(fps)), 2)


def test_simhash_views_link_more(spark, docs):
    one, many = ({r["doc_id"]: r["component_id"] for r in simhash.classes(docs, k=5, views=v).collect()} for v in (1, 3))
    assert all(many[i] <= one[i] for i in one)


def brute_repeats(rows: dict[int, str], window: int) -> dict[int, tuple[int, int, str]]:
    seen, out = set(), {}
    for i in sorted(rows):
        words = rows[i].encode().split()
        gone = [False] * len(words)
        for s in range(len(words) - window + 1):
            key = tuple(words[s : s + window])
            if key in seen:
                gone[s : s + window] = [True] * window
            seen.add(key)
        out[i] = (len(words), sum(gone), b" ".join(w for w, g in zip(words, gone) if not g).decode())
    return out


def test_substring(spark, docs):
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in substring.remove_repeats(docs).collect()}
    assert got == brute_repeats(plain(docs), 20)


def test_substring_repeats_anywhere(spark, monkeypatch):
    random.seed(9)
    parts = [" ".join(f"{random.choice(WORDS)}{random.randint(0, 3)}" for _ in range(n)) for n in (19, 20, 21, 33, 45)]
    rows = {i: " ".join(random.choice([*parts, *WORDS]) for _ in range(random.randint(0, 25))) for i in range(60)}
    monkeypatch.setattr(substring, "HELD", 50)
    df = spark.createDataFrame(list(rows.items()), "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in substring.remove_repeats(df).collect()}
    assert got == brute_repeats(rows, 20)
    assert substring.remove_repeats(df.limit(0)).count() == 0


def test_substring_tells_windows_of_one_hash_apart(spark):
    rest = " ".join(f"w{i}" for i in range(19))
    rows = {1: f"{thue_morse(4096)} {rest}", 2: f"{thue_morse(4096, 'b', 'a')} {rest}", 3: f"{thue_morse(4096)} {rest}"}
    got = {r["doc_id"]: r["n_removed"] for r in substring.remove_repeats(spark.createDataFrame(list(rows.items()), "doc_id long, text string")).collect()}
    assert got == {1: 0, 2: 0, 3: 20}


def test_substring_with_repeated_and_null_identifiers(spark):
    random.seed(10)
    a, z, n = text(30), text(30), text(30)
    rows = [(1, a), (5, z), (5, a), (9, z), (9, z), (None, n), (None, n), (None, f"x {z}"), (7, n), (3, None), (3, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").select("*", F.lit(1).alias("found"), F.lit(2).alias("first"), F.lit(3).alias("row"), F.lit(4).alias("others"))
    got = sorted(substring.remove_repeats(df, carry=("found", "first", "row", "others")).collect(), key=str)
    assert {tuple(r)[4:] for r in got} == {(1, 2, 3, 4)}
    removed = sorted(((r["doc_id"] or 0, r["n_words"], r["n_removed"]) for r in got))
    assert removed == sorted([(1, 30, 0), (5, 30, 30), (5, 30, 30), (9, 30, 30), (9, 30, 30), (0, 30, 0), (0, 30, 0), (0, 31, 0), (7, 30, 30), (3, 0, 0), (3, 0, 0)])


def test_long_words_arrays_are_hashed_in_blocks(monkeypatch):
    random.seed(3)
    words = substring.Words([text(400).encode(), text(3).encode(), text(900).encode()])
    at = np.flatnonzero(words.left(np.arange(len(words.starts))) >= 8)
    spans = substring.SpanHashes(256)
    whole = words.hashes(spans, at, 8)
    monkeypatch.setattr(substring, "CHUNK", 100)
    assert (words.hashes(spans, at, 8) == whole).all()
    again = substring.Words([b" a  b\tc " * 50, b"", b" \n"])
    assert again.text == b" ".join([b"a b c"] * 50) and again.counts.tolist() == [150, 0, 0]


def test_difference_cover():
    assert {(a - b) % substring.PERIOD for a in substring.COVER for b in substring.COVER} == set(range(substring.PERIOD))


def test_packing(spark, docs):
    rows = packing.pack(packing.pieces(docs, tokens.vocabulary(), size=64, ids=True).drop("ids"), size=64, partition=20).collect()
    coded = {r["doc_id"]: np.frombuffer(r["ids"], "<u4").tolist() + [packing.END] for r in tokens.encode(docs, tokens.vocabulary()).collect()}
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    for i, ids in coded.items():
        own = sorted(by_doc[i], key=lambda r: r["piece"])
        assert [r["start"] for r in own] == packing.piece_starts(len(ids), 64) and sum(r["length"] for r in own) == len(ids)
        for r in own:
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes())
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 64
    need = -(-sum(map(len, coded.values())) // 64)
    assert need <= len(by_sequence) <= need * 1.1 + 1
    assert packing.pack(packing.pieces(docs.limit(0), tokens.vocabulary())).count() == 0


def fewest(sizes: list[int], size: int) -> int:
    """The least number of sequences by trying every place for every piece, long ones first."""
    sizes, best = sorted(sizes, reverse=True), [len(sizes)]

    def place(i: int, rooms: list[int]) -> None:
        if len(rooms) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(rooms)
            return
        for at in {r: j for j, r in enumerate(rooms) if r >= sizes[i]}.values():
            place(i + 1, [r - sizes[i] if j == at else r for j, r in enumerate(rooms)])
        place(i + 1, [*rooms, size - sizes[i]])

    place(0, [])
    return best[0]


def test_bounds_against_the_best_packing():
    random.seed(1)
    met = 0
    for n in range(150):
        low, high = random.choice([(1, 64), (10, 40), (15, 33), (20, 45)])
        sizes = np.array([random.randint(low, high) for _ in range(random.randint(1, 11))])
        where, offset, bins = packing.best_fit_decreasing(sizes, 64)
        least = fewest(sizes.tolist(), 64)
        assert packing.lower_bound(sizes, 64) <= least <= bins and np.bincount(where, weights=sizes).max() <= 64
        met += packing.lower_bound(sizes, 64) == least
    assert met > 100
    assert packing.lower_bound(np.array([33] * 5), 64) == 5 and packing.lower_bound(np.array([22] * 3 + [43] * 2), 64) == 4


def test_exchange_goes_on_while_it_gains(spark):
    """Partitions of a few pieces each leave gaps that only pieces of others fill; the outcome is near the global bound."""
    random.seed(14)
    rows = [(i, 0, 0, n, 0) for i, n in enumerate([700, 324] * 200 + [random.randint(1, 1023) for _ in range(300)])]
    cut_ = spark.createDataFrame(rows, packing.PIECES_SQL)
    bound = packing.global_bound(cut_)
    once, many = (packing.pack(cut_, partition=p, largest=m).select("sequence_id").distinct().count() for p, m in ((4, 4), (4, 2000)))
    assert bound <= many <= bound * 1.02 + 1 and many < once


def brute_tree(texts: list[str], depth: int):
    """log10 probability of a text by a direct recursion over contexts and bits, with exact sums."""
    strings: Counter = Counter()
    for t in texts:
        s = b"\xff" * depth + b" ".join(t.encode().lower().split()) + b"\xff"
        for i in range(depth, len(s)):
            for d in range(depth + 1):
                for level in range(8):
                    strings[s[i - d : i], level, s[i] >> (8 - level), s[i] >> (7 - level) & 1] += 1
    kids: dict = {}
    for c, level, prefix, _ in strings:
        if c:
            kids.setdefault((c[1:], level, prefix), set()).add(c)
    kt = lambda z, o: math.lgamma(z + 0.5) + math.lgamma(o + 0.5) - math.lgamma(z + o + 1) - math.log(math.pi)
    counts = lambda c, *p: (strings[(c, *p, 0)], strings[(c, *p, 1)])
    known: dict = {}

    def weighted(c, *p):
        if (c, *p) not in known:
            alone = kt(*counts(c, *p))
            below = sum(weighted(k, *p) for k in kids.get((c, *p), ()))
            known[c, *p] = alone if len(c) == depth else float(np.logaddexp(alone, below)) - math.log(2)
        return known[c, *p]

    def chance(c, d, *p):
        z, o = counts(c[len(c) - d :], *p)
        own = (o + 0.5) / (z + o + 1)
        if d == depth:
            return own
        alone, below = kt(z, o), sum(weighted(k, *p) for k in kids.get((c[len(c) - d :], *p), ()))
        share = 1 / (1 + math.exp(min(700, below - alone)))
        return share * own + (1 - share) * chance(c, d + 1, *p)

    def score(t):
        s, out = b"\xff" * depth + b" ".join(t.encode().lower().split()) + b"\xff", 0.0
        for i in range(depth, len(s)):
            for level in range(8):
                p = chance(s[i - depth : i], 0, level, s[i] >> (8 - level))
                out += math.log10(p if s[i] >> (7 - level) & 1 else 1 - p)
        return out

    return score


@pytest.mark.parametrize("depth", [1, 2, 3, 4])
def test_scores(spark, docs, depth):
    texts = plain(docs)
    counts: Counter = Counter()
    for i, t in texts.items():
        if zlib.crc32(str(i).encode()) % 7 != 2:
            counts.update(t.encode().lower().split())
            counts[b""] += 1
    n, v = sum(counts.values()), len(counts)
    model = brute_tree([t for i, t in texts.items() if zlib.crc32(str(i).encode()) % 7 != 2], depth)
    rows = lm.score(docs, depth=depth).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    for r in rows:
        words = [*texts[r["doc_id"]].encode().lower().split(), b""]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(words), sum(counts[w] > 0 for w in words), n)
        assert math.isclose(r["base_score"], sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words), rel_tol=1e-9)
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2)
        if depth > 2 or r["doc_id"] % 5 == 0:
            assert math.isclose(r["score"], model(texts[r["doc_id"]]), rel_tol=1e-5), r
    assert lm.score(docs.limit(0), depth=depth).count() == 0


def test_scores_do_not_depend_on_blocks(spark, docs, monkeypatch):
    """Blocks, slices and buckets of other sizes, rows without and with the same identifier, and nothing to learn from."""
    own = docs.select("doc_id", "text").union(spark.createDataFrame([(None, "x y"), (None, "x y"), (7, "seven"), (7, "again")], "doc_id long, text string"))
    key = lambda r: (r["doc_id"] or -1, r["n_tokens"], r["score"])
    rounded = lambda rows: sorted((r["doc_id"] or -1, r["n_tokens"], r["n_known"], round(r["base_score"], 6), round(r["score"], 2)) for r in rows)
    want = rounded(lm.score(own).collect())
    for name, value in (("BLOCK", 300), ("SLICE", 64), ("SHARD", 200), ("ROW", 50)):
        monkeypatch.setattr(lm, name, value)
    assert rounded(lm.score(own.coalesce(1), stable=False).collect()) == want
    none = sorted(lm.score(own, held=F.lit(True)).collect(), key=key)
    assert all(r["train_tokens"] == 0 and r["n_known"] == 0 and math.isclose(r["bits_per_byte"], 8, rel_tol=1e-6) for r in none)


def test_contexts_of_six_bytes_count(spark):
    rows = [(i, "xabcdeP yabcdeQ") for i in range(300)]
    assert lm.DEPTH == 6 and lm.score(spark.createDataFrame(rows, "doc_id long, text string")).first()["score"] > -0.5


def test_language(spark):
    random.seed(8)
    stems = {"en": "the and of ing tion th", "de": "der und ung ich sch ei", "fr": "le et que eau oi ez", "es": "el y cion que ado os"}
    rows = [(i, " ".join(random.choice(stems[k].split()) * random.randint(1, 2) for _ in range(random.randint(3, 30))), k) for i, k in enumerate(random.choices(list(stems), k=400))]
    rows += [(1000, None, "en"), (1001, "", None), (1002, "123 ... !", "fr")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").select("*", F.lit(0).alias("score"), F.lit("x").alias("lang_pred"))
    got = {r["doc_id"]: r for r in langid.identify(df).collect()}
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got.values())
    assert all(got[i]["lang_pred"] == "und" for i in (1000, 1001, 1002))
    held = [(i, k) for i, _, k in rows if i < 1000 and got[i]["held_out"]]
    assert sum(got[i]["lang_pred"] == k for i, k in held) >= 0.95 * len(held)
    assert {r["doc_id"] for r in langid.keep(df).collect()} == {i for i, _, _ in rows if i < 1000}
    assert langid.identify(df.limit(0)).count() == 0


def test_top_k(spark):
    random.seed(3)
    rows = [(i, [random.gauss(0, 0.15) for _ in range(8)]) for i in range(300)]
    rows += [(300, None), (301, [None] * 8), (302, [float("nan")] * 8), (303, [float("inf")] + [0.0] * 7), (304, rows[20][1]), (305, rows[20][1]), (320, [0.0] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(1))
    ints = {i: [math.floor(64 * float(np.float32(x))) for x in v] for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v)}
    want = {}
    for q in (i for i in ints if i % 20 == 0):
        best = sorted(((-sum(a * b for a, b in zip(ints[q], v)), i) for i, v in ints.items() if i != q))[:7]
        want |= {(q, r): (i, -s) for r, (s, i) in enumerate(best, 1)}
    for block, chunk in ((16384, 256), (50, 4)):
        found = topk.search(df, F.col("vec_id") % 20 == 0, k=7, block=block, chunk=chunk).collect()
        assert {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in found} == want
    assert topk.search(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_top_k_with_repeated_and_short_vectors(spark):
    """A repeated vec_id is no candidate of its own query and ranks each time for others."""
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (7, [1.0, 1.0]), (7, [0.5]), (9, [-1.0, 0.25]), (None, [9.0, 9.0])]
    got = topk.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0, k=3).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == sorted([(0, 1, 7, 4096), (0, 2, 7, 2048), (0, 3, 9, -4096), (0, 1, 7, 4096), (0, 2, 9, 1024), (0, 3, 7, 0)])


def test_top_k_stops_on_proof_only():
    """Skewed vectors end early, whatever the levels; the members are those of the plain products."""
    random_ = np.random.default_rng(5)
    vectors = np.floor(64 * random_.normal(size=(3000, 12)) * np.array([8.0, *[0.1] * 11])).astype("<i2")
    index = topk.Index(np.arange(3000) * 3, vectors)
    for levels in (1, 7, 32):
        for q in range(0, 3000, 150):
            ids, scores, share = index.search(vectors[q], 3 * q, 10, levels=levels)
            exact = vectors.astype(np.int64) @ vectors[q].astype(np.int64)
            best = sorted((-s, 3 * i) for i, s in enumerate(exact.tolist()) if i != q)[:10]
            assert [(-s, i) for i, s in zip(ids.tolist(), scores.tolist())] == best and 0 < share <= 1
            assert levels < 32 or share < 0.9


def test_chat(spark):
    texts = ["</s>[INST] ok [/INST]", "<\\/s> \\ <s>", "", None, "[ROLE]x[/ROLE]<<SYS>>", "<", "a<\\\\s>"]
    rows = [(1, i, r, t) for i, (r, t) in enumerate(zip(["system", "user", "assistant", "user", "assistant", "tool<s>", None], texts))]
    rows += [(2, 0, "user", "hi"), (2, 1, "assistant", "yo"), (3, 0, "assistant", "x"), (4, 0, "user", "q"), (4, 0, "user", "q"), (None, 0, "user", "n")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(0))
    got = {r["conv_id"]: r for r in chat.format_chats(df).withColumn("back", chat.read_back(F.col("formatted"))).collect()}
    for c in (1, 2, 3, 4, None):
        own = sorted(((t, r or "", x or "") for k, t, r, x in rows if k == c))
        assert [(t["role"], t["text"]) for t in got[c]["back"]] == [(r, x) for _, r, x in own]
        assert got[c]["formatted"] == "".join(s["text"] for s in got[c]["segments"])
    assert (got[2]["valid"], got[3]["broken_at"], got[4]["broken_at"], got[1]["broken_at"]) == (True, 0, 1, 5)
    assert chat.format_chats(df.limit(0)).count() == 0


def test_licenses(spark):
    model = licenses.trained()
    rows = ["Released under the MIT License.", "x\nLicensed under the Apache License, Version 2.0.\ny", "This work is licensed under the GNU General Public License, version 3.", "Licensed under CC BY-NC 4.0.", "A driving license is needed.", "mit und von", None, "", "All rights reserved, copyright by us. The license fee is high."]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").withColumn("found", F.lit(0))
    got = {r["doc_id"]: r["found"] for r in licenses.scan(df).collect()}
    assert [sorted(x["family"] for x in got[i] if x["confirmed"]) for i in range(9)] == [["mit"], ["apache-2.0"], ["gpl-3.0"], ["cc-by-nc-4.0"], [], [], [], [], []]
    place = {g: i for i, g in enumerate(model.grams)}
    for i in range(4):
        for x in got[i]:
            on = [place[g] for g in licenses.grams_of(licenses.words_of(x["paragraph"])) if g in place]
            p = model.soft((model.weights[:, on].sum(1) + model.biases)[None])[0]
            assert model.names[int(p.argmax())] == x["family"] and math.isclose(p.max(), x["probability"], rel_tol=1e-6)
    assert licenses.scan(df.limit(0)).count() == 0


def test_licenses_on_unseen_templates():
    """Families of notices that the machine has not seen in any variant: what it names is mostly right, much stays unknown."""
    precision, recall = licenses.cross_validated()
    assert precision >= 0.7 and recall >= 0.3
    model = licenses.trained()
    for name, texts in licenses.TEMPLATES.items():
        for t in texts:
            p = model.chances(t)
            assert model.names[int(p.argmax())] == name and p.max() >= licenses.SURE and any(map(licenses.cue, licenses.words_of(t))), t
    assert all(model.names[int(model.chances(t).argmax())] == licenses.UNKNOWN for t in licenses.OTHERS)


def test_licenses_of_documents(spark):
    """Planted notices of the supplied table against a plain search for them."""
    at = "/root/testdata/sf0.01/documents.parquet"
    if not Path(at).exists():
        pytest.skip("no supplied tables")
    found = licenses.op6_licenses(spark, "/root/testdata/sf0.01").select("doc_id", "families")
    said = {"gpl-3.0": "GNU General Public License, version 3.", "mit": "Released under the MIT License.", "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.", "apache-2.0": "Licensed under the Apache License, Version 2.0."}
    want = {r["doc_id"]: ",".join(sorted(f for f, x in said.items() if x in (r["text"] or ""))) for r in spark.read.parquet(at).select("doc_id", "text").collect()}
    got = {r["doc_id"]: r["families"] for r in found.collect()}
    assert got == want and any(want.values())


def test_wrapped_licenses(spark):
    bsd = " * Redistribution and use in source and binary forms, with or without\n * modification, are permitted.\n"
    gpl = "# This work is licensed under the GNU General Public\n# License, version 3.\n"
    mpl = "This file is subject to the\nterms of the Mozilla Public\nLicense, version 2.0."
    rows = [bsd, gpl, mpl, "x\n" + bsd + "\n" + gpl + mpl, "\n".join(licenses.words_of(bsd)), "Released under the MIT License.\nmore of it", "Permission is hereby granted, free\n\nof charge, to any person"]
    got = {r["doc_id"]: r["found"] for r in licenses.scan(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()}
    assert [sorted(x["family"] for x in got[i] if x["confirmed"]) for i in range(7)] == [["bsd"], ["gpl-3.0"], ["mpl-2.0"], ["bsd", "gpl-3.0", "mpl-2.0"], ["bsd"], ["mit"], []]


def test_components(spark):
    random.seed(12)
    edges = [(i, i + 1) for i in range(50)] + [(200, 200 + i) for i in range(1, 60)] + [(random.randrange(300, 400), random.randrange(300, 400)) for _ in range(70)]
    want = brute_links(edges)
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: r for i, r in want.items() if i in got} and all(want[i] == i for i in want if i not in got)


def brute_links(edges):
    root = {i: i for e in edges for i in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            low = min(root[a], root[b])
            changed |= root[a] != low or root[b] != low
            root[a] = root[b] = low
    return root


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    random.seed(21)
    shared = text(60)
    rows = [(i, f"{text(40)} {shared if i % 4 == 0 else ''} {text(20)}", "en", "s", 0) for i in range(30)] + [(50 + i, text(30), "fr", "s", 0) for i in range(3)] + [(60, None, None, "s", 0), (61, "1 2 3", "en", "s", 0)]
    rows += [(70, rows[5][1] + " ", "en", "s", 0), (71, rows[6][1].upper(), "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    frames, docs = [], spark.read.parquet(str(tmp_path / "documents.parquet"))
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(str(tmp_path / f"s{i}"))
        docs = spark.read.parquet(str(tmp_path / f"s{i}"))
        frames.append(docs)
        if i < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    ids = [{r["doc_id"] for r in f.collect()} for f in frames]
    every = {r[0] for r in rows}
    assert ids[0] == every - {60, 61} and ids[1] == ids[0] - {5} and ids[2] == ids[1] - {71} and ids[3] == ids[2] == ids[4]
    kept = {r["doc_id"]: r["text"] for r in frames[2].collect()}
    want = brute_repeats(kept, 20)
    assert {r["doc_id"]: r["text"] for r in frames[3].collect()} == {i: kept[i] if not w[1] else w[2] for i, w in want.items()}
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == frames[4].count()


def test_near_copies_without_identifiers(spark):
    import corpus_pipeline

    random.seed(22)
    base, other, third = text(60), text(60), text(60)
    rows = [(None, other), (None, third), (3, base), (2, base.upper()), (None, base + " "), (5, text(60)), (5, text(60))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["text"]) for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect())
    assert got == sorted([(0, other), (0, third), (2, base.upper()), *rows[5:]])


def overlap(a: str, b: str) -> float:
    x, y = ({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (a.lower().split(), b.lower().split()))
    return len(x & y) / len(x | y)


def test_near_copies_with_changed_words(spark):
    import corpus_pipeline

    random.seed(23)
    rows, want = [], {}
    for i in range(60):
        words = [f"w{random.randrange(5000)}" for _ in range(random.choice([30, 100, 400]))]
        rows.append((10 * i, " ".join(words)))
        for j in range(1, 4):
            other = list(words)
            for at in random.sample(range(len(words)), max(1, len(words) * j // 100)):
                other[at] = f"n{random.randrange(5000)}"
            rows.append((10 * i + j, " ".join(other)))
    edges = [(a, b) for a, x in rows for b, y in rows if a < b and a // 10 == b // 10 and overlap(x, y) >= 0.8]
    assert 60 < len(edges) < 300
    want = brute_links(edges)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()}
    assert got == {i for i, _ in rows if want.get(i, i) == i}


def test_no_local_paths():
    for p in (Path(simhash.__file__).parent).glob("*.py"):
        assert "localCheckpoint" not in p.read_text(encoding="utf-8")
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442")


def test_large_buckets_are_compared_whole(spark):
    """rows of buckets of more than GROUP met by chance only."""
    from sparkweave.llm import simhash

    rows = [(key, row, n, row // 2) for key, n in ((1, 3 * simhash.GROUP + 4), (-5, 7)) for row in range(n)]
    got = [tuple(r) for r in simhash.across(spark.createDataFrame(rows, "key long, row long, n long, root long")).collect()]
    n = 3 * simhash.GROUP + 4
    assert sorted(got) == [(u, v) for u in range(n) for v in range(u + 1, n) if u // 2 != v // 2]


def test_a_large_group_of_near_copies_makes_few_rows(spark):
    """pipeline: each row of a bucket was repeated for every part of it, linked or not, which grew with the square of a group."""
    from sparkweave.llm import simhash

    rows = [(1, row, 0 if row < 1000 else row) for row in range(1003)]
    placed = spark.createDataFrame(rows, "key long, row long, root long")
    got = sorted(tuple(r) for r in simhash.across(placed).collect())
    assert got == [(u, v) for u in range(1003) for v in range(max(u + 1, 1000), 1003)]
    parts = simhash.split(placed).select((F.ceil(F.col("strays") / simhash.GROUP)).alias("parts"), "n", "main").first()
    assert tuple(parts) == (1, 1003, 0)
    some = simhash.sampled(placed, 0).collect()
    assert 0 < len(some) <= 1003 * simhash.PIVOTS and {tuple(r) for r in some} <= set(got)
    again = placed.unionByName(placed.withColumn("key", F.lit(2)))
    assert sorted(simhash.sampled(again, 0).collect()) == sorted(some)


@pytest.mark.parametrize("turns", [0, 2])
def test_near_copies_of_one_base(spark, monkeypatch, turns):
    """A group in which the least row is like some of the others only; what turns leave is compared whole."""
    from sparkweave.llm import simhash

    random.seed(31)
    base = [f"w{random.randrange(5000)}" for _ in range(120)]
    rows = []
    for i in range(150):
        words = list(base)
        for at in random.sample(range(120), random.choice([1, 2, 3])):
            words[at] = f"n{random.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    monkeypatch.setattr(simhash, "TURNS", turns)
    found = {r["node"]: r["root"] for r in simhash.similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = brute_links([(a, b) for a, x in rows for b, y in rows if a < b and overlap(x, y) >= 0.8])
    assert {i: found.get(i, i) for i, _ in rows} == {i: want.get(i, i) for i, _ in rows}


def test_near_stage_writes_no_texts(spark):
    """pipeline: the stage copied all texts to the shared folder, where they stayed."""
    import corpus_pipeline
    from sparkweave.llm import _common

    secret = "zyxwvut unlikely words that only this text has " * 3
    rows = [(1, secret, "a"), (1, secret, "b"), (2, text(40), "c"), (None, secret + "end", "d"), (3, None, "e"), (3, None, "e")]
    before = set(Path(_common.shared_dir(spark).removeprefix("file:")).glob("*"))
    out = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string, source string"), "")
    assert sorted((r["doc_id"], r["text"]) for r in out.collect()) == [(1, secret), (2, rows[2][1]), (3, None)]
    left = set(Path(_common.shared_dir(spark).removeprefix("file:")).glob("*")) - before
    assert left and not any("text" in spark.read.parquet(str(p)).columns for p in left)


def test_pairs_that_cannot_be_alike_are_not_made(spark):
    """pipeline: strays met all rows in each bucket they share, and all those pairs' shingles were dealt out."""
    from sparkweave.llm import simhash

    random.seed(5)
    base = [f"w{i}" for i in range(300)]
    texts = [" ".join(w if random.random() > share else f"n{random.random()}" for w in base) for share in [0.005] * 20 + [0.03] * 20]
    own = [simhash.shingles(t.encode(), 5) for t in texts]
    marks = spark.createDataFrame([(i, [1, 2, 3], len(x), simhash.parities(x).tolist()) for i, x in enumerate(own)], "row long, keys array<long>, n long, bits array<long>")
    placed = spark.createDataFrame([(key, i, i) for key in (1, 2, 3) for i in range(40)], "key long, row long, root long")
    alike = {(i, j) for i in range(40) for j in range(i + 1, 40) if overlap(texts[i], texts[j]) >= 0.8}
    got = [tuple(r) for r in simhash.across(placed, marks).collect()]
    assert alike <= set(got) and len(set(got)) == len(got) < 0.6 * 780 < 780 == simhash.across(placed).count()
    assert {tuple(r) for r in simhash.sampled(placed, 0, marks).collect()} <= set(got)
    for x in own[:5]:
        for y in own[20:]:
            assert sum(int(b).bit_count() for b in (simhash.parities(x) ^ simhash.parities(y)).view("<u8")) <= len(np.setxor1d(x, y))


def test_windows_are_settled_before_texts_are_dealt_out_again(spark, docs):
    """pipeline, op10: the texts dealt out for windows lay on disk beside those dealt out for the result."""
    plan = substring.remove_repeats(docs)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInArrow" not in plan and plan.count("MapInArrow") == 1
