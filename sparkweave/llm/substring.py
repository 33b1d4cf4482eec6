"""Removal of repeated passages with difference-cover anchors.

A window is WINDOW consecutive words of one document. Anchors are WINDOW - PERIOD + 1 words long and start only at word
positions whose remainder modulo PERIOD is in COVER. Every residue is a difference of two members of COVER, so two equal
windows share an anchor at the same place inside both, whatever their positions. Steps:

1. anchors are hashed, dealt to buckets by hash, and those that occur more than once are found;
2. windows around such anchors are the only ones that can repeat; their bytes are digested (BLAKE2b, 128 bits), and the
   earliest occurrence (smallest document, then start) of each word sequence is found;
3. words covered by a window around an anchor that isn't the earliest of its sequence are removed.

Tasks send a bucket at most one anchor or window of a sequence (what a task holds twice is settled there), so a passage
that half of all documents share puts no more on a bucket than there are tasks. Buckets hold packed arrays; their number
follows the bytes of text, so that what one holds is bounded. No pairs are made.

Null text has no words, texts with fewer than WINDOW words stay whole; long texts are hashed in blocks. A null doc_id comes
before all others. Where identifiers repeat, a document is a (doc_id, text): those of one doc_id are ordered by a hash of
their texts, and rows that repeat both are the same document, so their windows at the same start are not earlier than
each other. Other columns are left aside; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkweave.llm._common import as_bytes, cut, planes, released, small_batches, table, unplaned, written
from sparkweave.llm._spans import SpanHashes

WINDOW = 20
PERIOD = 13
#: A perfect difference set: each residue but 0 is the difference of one pair (fixed values).
COVER = (0, 1, 3, 9)
ANCHOR = WINDOW - PERIOD + 1
#: Entries that a task holds before it sends them to the buckets, and bytes of text it hashes at once.
HELD = 1_000_000
CHUNK = 2_000_000
#: Bytes of text a bucket is meant for, and the fewest buckets.
BUCKET, BUCKETS = 4_000_000, 64
NO_ID = -(1 << 63)

SINGLE, KNOWN, PASSED = 0, 1, 2
WHITE = re.compile(rb"[\x20\x09-\x0D]+")
PACKED = pa.schema([("bucket", pa.int32()), ("keys", pa.binary()), ("more", pa.binary()), ("docs", pa.binary()), ("rows", pa.binary()), ("places", pa.binary()), ("flags", pa.binary())])
PACKED_SQL = "bucket int, keys binary, more binary, docs binary, rows binary, places binary, flags binary"
PLACE = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("place", pa.int32())])
PLACE_SQL = "doc_id long, row long, place int"


class Words:
    """The words of some texts end to end; doc: number of each word's text, first: the first word of each text."""

    def __init__(self, texts: list[bytes]):
        joined = [WHITE.sub(b" ", t).strip(b" ") if len(t) > CHUNK else b" ".join(t.split()) for t in texts]
        self.text = b" ".join(t for t in joined if t)
        self.codes = np.frombuffer(self.text, np.uint8)
        blanks = np.flatnonzero(self.codes == 32)
        some = int(len(self.text) > 0)
        self.starts = np.concatenate([np.zeros(some, np.int64), blanks + 1])
        self.ends = np.concatenate([blanks, np.full(some, len(self.text))])
        self.counts = np.array([t.count(b" ") + 1 if t else 0 for t in joined], np.int64)
        self.first = np.cumsum(self.counts) - self.counts
        self.doc = np.repeat(np.arange(len(texts), dtype=np.int32), self.counts)
        self.place = (np.arange(len(self.starts)) - np.repeat(self.first, self.counts)).astype(np.int32)

    def left(self, at: np.ndarray) -> np.ndarray:
        """Words from each of those on to the end of its text."""
        return self.counts[self.doc[at]] - self.place[at]

    def hashes(self, spans: SpanHashes, at: np.ndarray, length: int) -> np.ndarray:
        """Of the spans of that many words at each of ascending words; only a block of the text is hashed at once."""
        out, a = np.empty(len(at), np.uint64), 0
        while a < len(at):
            b = max(a + 1, int(np.searchsorted(self.starts[at], self.starts[at[a]] + CHUNK)))
            x, y = self.starts[at[a]], self.ends[at[b - 1] + length - 1]
            out[a:b] = spans.spans(spans.sums(self.codes[x:y]), self.starts[at[a:b]] - x, self.ends[at[a:b] + length - 1] - x)
            a = b
        return out

    def digests(self, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """128 bits of the bytes of each span, as two numbers."""
        text = self.text
        found = b"".join([blake2b(text[a:b], digest_size=16).digest() for a, b in zip(self.starts[at].tolist(), self.ends[at + length - 1].tolist())])
        both = np.frombuffer(found, "<u8").reshape(-1, 2)
        return both[:, 0], both[:, 1]


def chunks(batch: pa.RecordBatch) -> Iterator[tuple[int, int, list[bytes]]]:
    """Rows of (doc_id, text, ...) in groups of about CHUNK bytes: first row, end, texts."""
    texts = as_bytes(batch.column(1))
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= CHUNK or i == len(texts) - 1:
            yield start, i + 1, texts[start : i + 1]
            start, size = i + 1, 0


def dealt(buckets: int, h: np.ndarray, more: np.ndarray | None, docs: np.ndarray, numbers: np.ndarray, places: np.ndarray, flags: np.ndarray, bucket: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Packed rows, one for each bucket that gets anything."""
    order = np.argsort(bucket, kind="stable")
    edges = np.searchsorted(bucket[order], np.arange(buckets + 1)).tolist()
    rows: dict[str, list] = {f.name: [] for f in PACKED}
    for b, (x, y) in enumerate(pairwise(edges)):
        if x < y:
            at = order[x:y]
            for name, value in (("bucket", b), ("keys", planes(h[at])), ("more", b"" if more is None else planes(more[at])), ("docs", planes(docs[at])), ("rows", planes(numbers[at])), ("places", planes(places[at])), ("flags", flags[at].tobytes())):
                rows[name].append(value)
    yield from cut(rows, PACKED)


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def anchor_rows(buckets: int):
    """For mapInArrow over (doc_id, text, row): anchors packed by bucket."""

    def sent(h: np.ndarray, docs: np.ndarray, numbers: np.ndarray, places: np.ndarray) -> Iterator[pa.RecordBatch]:
        order = np.argsort(h, kind="stable")
        h, docs, numbers, places = h[order], docs[order], numbers[order], places[order]
        new = np.ones(len(h), bool)
        new[1:] = h[1:] != h[:-1]
        alone = new & np.append(new[1:], True)
        flags = np.where(alone, SINGLE, np.where(new, KNOWN, PASSED)).astype(np.uint8)
        bucket = bucket_of(h, buckets)
        passed = flags == PASSED  # nothing more is to be found out about them: their bucket goes by document
        bucket[passed] = (docs[passed].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % buckets
        yield from dealt(buckets, h, None, docs, numbers, places, flags, bucket)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans, held, size = SpanHashes(256), [], 0
        for batch in batches:
            ids, own = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 2))
            for a, b, texts in chunks(batch):
                words = Words(texts)
                at = np.flatnonzero(np.isin(words.place % PERIOD, COVER))
                at = at[(words.left(at) >= ANCHOR) & (words.counts[words.doc[at]] >= WINDOW)]
                if len(at):
                    held.append((words.hashes(spans, at, ANCHOR), ids[a:b][words.doc[at]], own[a:b][words.doc[at]], words.place[at]))
                    size += len(at)
                if size >= HELD:
                    yield from sent(*map(np.concatenate, zip(*held)))
                    held, size = [], 0
        if held:
            yield from sent(*map(np.concatenate, zip(*held)))

    return released(run)


def repeated(table: pa.Table) -> pa.Table:
    """Of one bucket's anchors, those that occur more than once."""
    h, docs, numbers, places, flags = (unplaned(table[c], k) for c, k in (("keys", "<u8"), ("docs", "<i8"), ("rows", "<i8"), ("places", "<i4"), ("flags", "u1")))
    passed = flags == PASSED
    out = [(docs[passed], numbers[passed], places[passed])]
    h, docs, numbers, places, flags = (x[~passed] for x in (h, docs, numbers, places, flags))
    order = np.argsort(h, kind="stable")
    h = h[order]
    if len(h):
        new = np.ones(len(h), bool)
        new[1:] = h[1:] != h[:-1]
        group = np.cumsum(new) - 1
        known = np.bincount(group, weights=1 + (flags[order] == KNOWN)) > 1
        out.append(tuple(x[order][known[group]] for x in (docs, numbers, places)))
    return pa.table([np.concatenate(x) for x in zip(*out)], schema=PLACE)


def candidate_starts(words: Words, found: list[np.ndarray]) -> np.ndarray:
    """Word numbers at which windows around the found anchors of each text start."""
    n = len(words.starts)
    marks = np.zeros(n + 1, np.int64)
    docs = np.repeat(np.arange(len(found)), [len(x) for x in found])
    places = np.concatenate([*found, np.zeros(0, np.int64)]).astype(np.int64)
    last = words.counts[docs] - WINDOW
    fits = (last >= 0) & (places - PERIOD < last)
    docs, places, last = docs[fits], places[fits], last[fits]
    np.add.at(marks, words.first[docs] + np.maximum(places - PERIOD + 1, 0), 1)
    np.add.at(marks, words.first[docs] + np.minimum(places, last) + 1, -1)
    return np.flatnonzero(np.cumsum(marks)[:n] > 0)


def lists(column: pa.Array) -> list[np.ndarray]:
    return [np.array(x if x is not None else (), np.int64) for x in column.to_pylist()]


def window_rows(buckets: int):
    """For mapInArrow over (doc_id, text, row, found): windows packed by bucket, the earliest of each sequence in the task."""

    def sent(*own: np.ndarray) -> Iterator[pa.RecordBatch]:
        h, more, docs, numbers, places = earliest(*own)
        yield from dealt(buckets, h, more, docs, numbers, places, np.zeros(len(h), np.uint8), bucket_of(h, buckets))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            ids, own = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 2))
            found = lists(batch.column(3))
            for a, b, texts in chunks(batch):
                words = Words(texts)
                at = candidate_starts(words, found[a:b])
                if len(at):
                    held.append((*words.digests(at, WINDOW), ids[a:b][words.doc[at]], own[a:b][words.doc[at]], words.place[at]))
                    size += len(at)
                if size >= HELD:
                    yield from sent(*map(np.concatenate, zip(*held)))
                    held, size = [], 0
        if held:
            yield from sent(*map(np.concatenate, zip(*held)))

    return released(run)


def earliest(h: np.ndarray, more: np.ndarray, docs: np.ndarray, numbers: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, ...]:
    """The smallest (doc, row, place) of each (h, more)."""
    order = np.lexsort((places, numbers, docs, more, h))
    h, more = h[order], more[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (more[1:] != more[:-1])
    return h[new], more[new], docs[order][new], numbers[order][new], places[order][new]


def firsts(table: pa.Table) -> pa.Table:
    """Of one bucket's windows, the earliest of each sequence."""
    found = earliest(*(unplaned(table[c], k) for c, k in (("keys", "<u8"), ("more", "<u8"), ("docs", "<i8"), ("rows", "<i8"), ("places", "<i4"))))
    return pa.table(list(found[2:]), schema=PLACE)


OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])


def cut_out(whole: bool):
    """For mapInArrow over (doc_id, text, found, first, others...): the words that stay, and the others as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, first = lists(batch.column(2)), lists(batch.column(3))
            for a, b, texts in chunks(batch):
                words = Words(texts)
                n = len(words.starts)
                again = np.zeros(n + 1, bool)
                again[candidate_starts(words, found[a:b])] = True
                for base, count, own in zip(words.first.tolist(), words.counts.tolist(), first[a:b]):
                    again[base + own[own < count]] = False
                marks = np.zeros(n + WINDOW + 1, np.int64)
                at = np.flatnonzero(again[:n])
                marks[at] += 1
                marks[at + WINDOW] -= 1
                gone = np.cumsum(marks)[:n] > 0
                kept, removed = [], []
                for base, count in zip(words.first.tolist(), words.counts.tolist()):
                    own = gone[base : base + count]
                    r = int(own.sum())
                    removed.append(r)
                    if not count or r == count:
                        kept.append(b"")
                    elif not r and whole:
                        kept.append(texts[len(kept)])
                    elif not r:
                        kept.append(words.text[words.starts[base] : words.ends[base + count - 1]])
                    else:
                        turns = np.flatnonzero(np.diff(np.concatenate([[True], own, [True]]).astype(np.int8)))
                        kept.append(b" ".join(words.text[words.starts[base + x] : words.ends[base + y - 1]] for x, y in turns.reshape(-1, 2).tolist()))
                others = {batch.schema.field(i).name: batch.column(i).slice(a, b - a) for i in range(4, batch.num_columns)}
                yield from cut({"doc_id": batch.column(0).slice(a, b - a), "n_words": pa.array(words.counts), "n_removed": removed, "kept": pa.array(kept, pa.binary()).cast(pa.string())} | others, pa.schema([*OUT, *(batch.schema.field(i) for i in range(4, batch.num_columns))]))

    return released(run)


def remove_repeats(docs: DataFrame, carry: tuple[str, ...] = (), whole: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept) for every row; kept: the words that stay, joined by one blank.

    carry names further columns to keep; with whole, a text that loses nothing stays as it is.
    """
    text = F.col(text_col)
    own = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc_id"), text.alias("text"), F.struct(*carry).alias("others") if carry else F.lit(None).cast("struct<none:int>").alias("others"))
    small_batches(docs.sparkSession)
    sizes = own.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes"))
    again, size = sizes.agg(F.count_if(F.col("n") > 1), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    own = own.withColumn("row", F.xxhash64(F.coalesce("text", F.lit(""))) if again else F.lit(0).cast("long"))
    places = F.collect_set("place") if again else F.collect_list("place")  # rows of one document find the same places
    buckets, by = max(BUCKETS, -(-size // BUCKET)), ["doc_id", "row"]
    anchors = own.select("doc_id", "text", "row").mapInArrow(anchor_rows(buckets), PACKED_SQL)
    found = anchors.groupBy("bucket").applyInArrow(repeated, PLACE_SQL)
    found = written(found.groupBy(*by).agg(places.alias("found")), "anchors")
    windows = own.join(found, by).select("doc_id", "text", "row", "found").mapInArrow(window_rows(buckets), PACKED_SQL)
    first = windows.groupBy("bucket").applyInArrow(firsts, PLACE_SQL).groupBy(*by).agg(places.alias("first"))
    first = written(first, "firsts")  # so that the texts dealt out for windows are given up before they are dealt out again
    marked = own.join(found.join(first, by, "left"), by, "left").select("doc_id", "text", "found", "first", "others")
    schema = T.StructType([*T.StructType.fromDDL("doc_id long, n_words long, n_removed long, kept string"), marked.schema["others"]])
    out = marked.mapInArrow(cut_out(whole), schema).withColumn("doc_id", F.nullif("doc_id", F.lit(NO_ID)))
    return out.select("doc_id", "n_words", "n_removed", "kept", *(F.col("others")[c].alias(c) for c in carry))


def op10_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without passages that came earlier."""
    found = remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
