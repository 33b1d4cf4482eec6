"""Rows that no operator may trip over: null and repeated identifiers, very long texts, empty tables, clashing columns."""

from __future__ import annotations

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from sparkweave.llm import bpe, chat, exact, langid, licenses, lm, packing, simhash, substring, tokens, topk

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
NAMES = ("__row", "__kept", "__n", "__own", "found", "first", "others", "row", "root", "node", "keys", "block", "about", "part", "at", "item", "held_out", "lang_pred", "score", "fp", "view", "ids", "decoded", "digest", "kept")


@pytest.fixture(scope="module")
def docs(spark):
    """Identifiers that are null or given twice, once with the same text and once with another."""
    random.seed(31)
    words = [f"w{random.randrange(400)}" for _ in range(400)]
    text = lambda n: " ".join(random.choice(words) for _ in range(n))
    base = text(80)
    rows = [(i, text(40), "en") for i in range(12)] + [(None, text(50), "en"), (None, text(50), None), (None, base, "fr"), (3, text(45), "en"), (3, base, "en"), (20, base, "fr"), (20, base, "fr"), (21, None, None), (None, None, None), (22, "", "en"), (22, " \n", "en")]
    return spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in rows], SCHEMA).select("*", *(F.lit(7).alias(n) for n in NAMES)).repartition(4)


def rows_of(docs) -> list[tuple]:
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]


def test_every_row_has_its_result(spark, docs):
    """One result a row, with the identifiers as they are."""
    want = Counter(i for i, _ in rows_of(docs))
    vocab = tokens.vocabulary()
    for name, out in {"op2": packing.pieces(docs, vocab), "op3": lm.score(docs, stable=False), "op4": langid.identify(docs), "op5": simhash.classes(docs), "op6": licenses.scan(docs), "op8": exact.duplicates(docs), "op9": tokens.encode(docs, vocab), "op10": substring.remove_repeats(docs)}.items():
        assert Counter(r["doc_id"] for r in out.select("doc_id").collect()) == want, name
    packed = packing.pack(packing.pieces(docs, vocab)).collect()
    assert Counter(r["doc_id"] for r in packed) == want and sorted((r["sequence_id"], r["offset"]) for r in packed)[0][1] == 0


def test_equal_rows_have_equal_results(spark, docs):
    """Results go by the text, not by the identifier that it shares with others."""
    texts = sorted({t or "" for _, t in rows_of(docs)})
    got = {(r["doc_id"], r["ids"]) for r in tokens.encode(docs, tokens.vocabulary()).collect()}
    coded = dict(zip(texts, bpe.load(tokens.vocabulary()).encode(texts)))
    assert got == {(i, coded[t or ""]) for i, t in rows_of(docs)}
    by_text: dict = {}
    for i, t in rows_of(docs):
        by_text.setdefault("".join((t or "").split()), []).append(i)
    groups = Counter((r["keep_id"], r["group_size"]) for r in exact.duplicates(docs).where("kept").collect())
    longest = {"": {22: " \n"}}  # of the empty ones the longest original stays
    assert groups == Counter((min(longest.get(t, [i for i in ids if i is not None]), default=None), len(ids)) for t, ids in by_text.items())
    classes = {r["fp"]: r["component_id"] for r in simhash.classes(docs).collect()}
    for t, ids in by_text.items():
        fp = simhash.fingerprint(next(x or "" for i, x in rows_of(docs) if "".join((x or "").split()) == t).encode())[0]
        known = [i for i in ids if i is not None]
        assert classes[fp] == min(known, default=None) if known else classes[fp] is None


def test_stages_keep_what_is_theirs(spark, docs):
    """No stage loses or doubles rows without identifiers or with those of others; each keeps the columns."""
    plain = docs.select(*(c.split()[0] for c in SCHEMA.split(", ")))
    told = corpus_pipeline.identify_language(spark, plain, "").collect()
    assert Counter(r["text"] for r in told) == Counter(t for _, t in rows_of(docs) if t and t.strip())
    once = corpus_pipeline.drop_exact_copies(spark, plain, "").collect()
    assert sorted("".join((r["text"] or "").split()) for r in once) == sorted({"".join((t or "").split()) for _, t in rows_of(docs)})
    near = corpus_pipeline.drop_near_copies(spark, plain, "").collect()
    assert sorted({" ".join((r["text"] or "").split()) for r in near}) == sorted({" ".join((t or "").split()) for _, t in rows_of(docs)}) and len(near) == len({" ".join((t or "").split()) for _, t in rows_of(docs)})
    left = corpus_pipeline.remove_repeated_passages(spark, plain, "")
    assert left.columns == plain.columns and left.count() == plain.count()
    packed = corpus_pipeline.pack_sequences(spark, plain, "")
    assert packed.select("doc_id").distinct().count() == plain.select("doc_id").distinct().count()
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, plain.limit(0), "").count() == 0
        assert stage(spark, plain.where("text is null"), "").count() in (0, 1, plain.where("text is null").count())


@pytest.fixture(scope="module")
def long_text() -> str:
    """Six million characters on one line, with a passage that returns."""
    random.seed(32)
    words = ["".join(random.choices("abcdefghiklmnoprstuvw", k=random.randint(2, 9))) for _ in range(3000)]
    passage = " ".join(random.choice(words) for _ in range(30))
    parts = [" ".join(random.choices(words, k=200_000)) for _ in range(5)]
    return f" {passage} ".join(parts)


def test_very_long_texts(spark, long_text):
    df = spark.createDataFrame([(1, long_text, "en"), (2, "a short one", "en"), (3, long_text[:4000], "fr")], "doc_id long, text string, lang string")
    words = long_text.encode().split()
    assert len(long_text) > 5_000_000

    vocab = tokens.vocabulary()
    coded = {r["doc_id"]: r for r in tokens.encode(df, vocab, decoded=True).collect()}
    assert coded[1]["decoded"] == long_text and coded[3]["ids"] == bpe.load(vocab).encode([long_text[:4000]])[0]
    cut = packing.pack(packing.pieces(df, vocab)).where("doc_id = 1").agg(F.sum("length"), F.max("piece")).first()
    assert cut[0] == len(coded[1]["ids"]) // 4 + 1 and cut[1] == -(-cut[0] // 1024) - 1

    kept = {r["doc_id"]: r for r in substring.remove_repeats(df).collect()}
    seen, gone = set(), np.zeros(len(words) + 20, np.int64)
    for s in range(len(words) - 19):
        key = hash(tuple(words[s : s + 20]))
        if key in seen:
            gone[s] += 1
            gone[s + 20] -= 1
        seen.add(key)
    assert kept[1]["n_removed"] == int((np.cumsum(gone)[: len(words)] > 0).sum()) == 3 * 30 and kept[3]["n_removed"] > 0

    fp = sum(((np.unpackbits(np.array([xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(a, min(a + 100_000, len(words) - 2))], "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)) for a in range(0, len(words) - 2, 100_000)), np.zeros(64, np.int64))
    want = int(sum(1 << b for b in range(64) if 2 * fp[b] > len(words) - 2))
    assert {r["doc_id"]: r["fp"] % (1 << 64) for r in simhash.classes(df).collect()}[1] == want

    scored = {r["doc_id"]: r for r in lm.score(df, held=F.lit(False), stable=False).collect()}
    assert scored[1]["n_tokens"] == len(words) + 1 == scored[1]["n_known"] and 0 < scored[1]["bits_per_byte"] < 8
    assert {r["doc_id"] for r in langid.identify(df).collect()} == {1, 2, 3}
    same = exact.duplicates(df.union(df.where("doc_id = 1").withColumn("doc_id", F.lit(9)))).where("doc_id = 9").first()
    assert (same["keep_id"], same["group_size"], same["kept"]) == (1, 2, False)
    assert licenses.scan(df.withColumn("text", F.concat("text", F.lit("\nReleased under the MIT License.")))).where("size(found) > 0").count() == 3


def test_long_conversation(spark):
    text = "<s>[INST] \\ " * 300_000
    rows = [(1, 0, "user", text), (1, 1, "assistant", text)]
    got = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).withColumn("back", chat.read_back(F.col("formatted"))).first()
    assert [t["text"] for t in got["back"]] == [text, text]


def test_long_vectors(spark):
    wide = [[(i * j % 7 - 3) / 8 for j in range(3000)] for i in range(30)]
    got = topk.search(spark.createDataFrame(list(enumerate(wide)), "vec_id long, embedding array<double>"), F.col("vec_id") == 0, k=5).collect()
    ints = [[math.floor(64 * x) for x in v] for v in wide]
    best = sorted((-sum(a * b for a, b in zip(ints[0], v)), i) for i, v in enumerate(ints) if i)[:5]
    assert [(-r["score"], r["vec_id"]) for r in sorted(got, key=lambda r: r["rank"])] == best
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442")
