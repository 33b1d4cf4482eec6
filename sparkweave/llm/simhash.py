"""Near-duplicates by SimHash and covering locality-sensitive hashing.

Fingerprints of equal texts are one node. For a radius r every bit gets a non-zero vector of r + 1 bits; a table belongs
to each non-zero vector v and keeps the bits whose vector has an odd product with v. At most r differing bits leave some v
orthogonal to all of theirs, so such a pair agrees on every bit that v's table keeps: no pair within the radius is missed.

Inside a bucket no pairs are made. Two fingerprints within two bits have a common neighbour within one bit of each, and
fingerprints that share such a neighbour are within two bits; so each member names itself and its one-bit neighbours on
the bits its table left out, and members of a neighbour are linked to the smallest of them (65 at most). Components come
from stars over these links.

Several views (independent fingerprints of the same shingles) raise the share of similar pairs that link.

similar() finds pairs by the overlap of their shingles instead: candidates are pairs within the radius in any view, and
texts that agree on ROWS minimum hashes in one of BANDS bands (a pair with overlap 0.8 fails to in 1 of 1500 cases, one
with 0.85 in 1 of 300,000). Each is confirmed by its true overlap. In a band's bucket a text is compared with the least
row, then, where that leaves more than one component, with a few others, which joins most of a large group; then with every
text of another component, however large the bucket. These pairs are made in one of their buckets only, and where the parities
of both texts' shingles don't prove that too many differ; it is these comparisons that aren't linear in a bucket's rows.

Null text counts as empty. A text without words has fingerprint zero and links like any other. Fewer words than a
shingle: the whole sequence is one shingle. Repeated rows share a class, whatever their identifiers; a class without any
identifier has none. Long texts are hashed in steps. Other columns are left aside; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkweave.llm._common import as_bytes, clean_id, components, dropped, in_batches, one_blank, table, word_bounds, written

BITS = 64
SEED = 42
#: Odd multiplier that mixes a hash into that of the next view.
MIX = np.uint64(0x9E3779B97F4A7C15)
#: Differing bits up to which fingerprints link. Common neighbours stand for pairs at this radius only.
RADIUS = 2
#: Bands and minimum hashes a band, the least overlap of shingles that links, and strays that a bucket's rows meet at once.
BANDS, ROWS, ALIKE, GROUP = 40, 8, 0.8, 32
#: Rows of each bucket that all its others are compared with at a turn, and most such turns before what is left is compared
#: whole; none where that is no more work.
PIVOTS, TURNS = 8, 2
#: Rows to be confirmed that find their texts by broadcast (16 MB of numbers), so that whole texts aren't dealt out; more find them in a join.
TOLD = 2_000_000
#: Bits of a text's parities. Each shingle of only one of two texts turns one bit, so no fewer shingles differ than bits do.
PARITY = 2048
ODD, FLIP = np.random.default_rng(SEED).integers(0, 1 << 32, (2, BANDS * ROWS, 1), np.uint32)
ODD |= np.uint32(1)


#: Shingles hashed at once.
STEP = 1 << 17


def shingle_hashes(text: bytes, k: int) -> Iterator[np.ndarray]:
    """XXH64 of the shingles of k words in order, STEP at a time; none for a text without words."""
    joined = one_blank(text.lower())
    starts, ends = word_bounds(joined)
    k = min(k, len(starts))
    starts, ends = starts[: len(starts) - k + 1], ends[max(k - 1, 0) :]
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(starts), STEP):
        yield np.array([digest(joined[a:b], SEED) for a, b in zip(starts[at : at + STEP].tolist(), ends[at : at + STEP].tolist())], "<u8")


def fingerprint(text: bytes, k: int = 3, views: int = 1) -> list[int]:
    """SimHashes of one text as signed integers: a bit is 1 if it is set in over half of the shingles' hashes.

    The first view takes XXH64 itself, each further one a mixed form of it.
    """
    counts, total = np.zeros((views, BITS), np.int64), 0
    for h in shingle_hashes(text, k):
        total += len(h)
        for view in range(views):
            counts[view] += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
            h = (h ^ (h >> np.uint64(31))) * MIX
    return np.packbits(2 * counts > total, axis=1, bitorder="little").view("<i8")[:, 0].tolist()


def fingerprints(docs: DataFrame, k: int = 3, views: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, view, fp) with the 64 bits as a signed long."""
    schema = pa.schema([("doc_id", pa.int64()), ("view", pa.int32()), ("fp", pa.int64())])

    def work(batch):
        ids = [x for x in batch.column(0).to_pylist() for _ in range(views)]
        yield {"doc_id": ids, "view": [*range(views)] * batch.num_rows, "fp": [f for x in as_bytes(batch.column(1)) for f in fingerprint(x, k, views)]}

    return clean_id(docs, id_col, text_col).mapInArrow(in_batches(work, schema), "doc_id long, view int, fp long")


def masks(radius: int) -> list[int]:
    """The bits that each covering table keeps."""
    every = range(1, 1 << (radius + 1))
    return [sum(1 << i for i in range(BITS) if bin(v & (1 + i % len(every))).count("1") % 2) for v in every]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(nodes: DataFrame) -> DataFrame:
    """Edges (u, v) of low, whose components are those of all pairs of fp of a view within RADIUS bits of each other."""
    kept = masks(RADIUS)
    tables = F.explode(F.array(*(F.struct(F.lit(t).alias("table"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("key")) for t, m in enumerate(kept))))
    keyed = nodes.select("low", "view", "fp", tables.alias("b")).select("low", "view", "fp", "b.table", "b.key")
    members = keyed.withColumn("n", F.count("*").over(Window.partitionBy("view", "table", "key"))).where("n > 1")  # dealt out once
    flips = F.array(*(F.array(*(F.lit(signed(f)) for f in (0, *(1 << b for b in range(BITS) if not m >> b & 1)))) for m in kept))
    around = members.select("low", "view", "fp", F.explode(F.element_at(flips, F.col("table") + 1)).alias("flip"))
    near = around.select("low", "view", F.col("fp").bitwiseXOR(F.col("flip")).alias("hub")).groupBy("view", "hub").agg(F.collect_set("low").alias("lows")).where(F.size("lows") > 1)
    return near.select(F.array_min("lows").alias("u"), F.explode("lows").alias("v")).where("u <> v").distinct()


def classes(docs: DataFrame, k: int = 3, views: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id): the smallest doc_id reachable over links in any view, its own included."""
    marked = written(fingerprints(docs, k, views, id_col, text_col), "fingerprints")
    nodes = written(marked.groupBy("view", "fp").agg(F.min("doc_id").alias("low")), "nodes")
    edges = links(nodes.where("low is not null"))
    if views > 1:
        edges = edges.union(marked.join(nodes, ["view", "fp"]).where("doc_id <> low").select("doc_id", "low"))
    roots = components(edges).select(F.col("node").alias("low"), "root")
    placed = nodes.where("view = 0").join(roots, "low", "left").select("fp", F.coalesce("root", "low").alias("component_id"))
    return marked.where("view = 0").join(placed, "fp").select("doc_id", "fp", "component_id")


def shingles(text: bytes, k: int) -> np.ndarray:
    """XXH64 of the distinct shingles, ascending; none for a text without words."""
    return np.unique(np.concatenate([np.zeros(0, "<u8"), *shingle_hashes(text, k)]))


def band_keys(own: np.ndarray) -> list[int]:
    """One hash for each band, of the least values of ROWS orders of the shingles."""
    x, low = (own >> np.uint64(32)).astype(np.uint32), np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 512):
        low = np.minimum(low, ((x[at : at + 512] ^ FLIP) * ODD).min(1))
    return [signed(xxhash.xxh64_intdigest(b.tobytes(), band)) for band, b in enumerate(low.reshape(BANDS, ROWS))]


def parities(own: np.ndarray) -> np.ndarray:
    """PARITY bits, as longs: whether the number of shingles that fall to each is odd."""
    odd = np.bincount((own & np.uint64(PARITY - 1)).astype(np.int64), minlength=PARITY) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def confirmed(pairs: DataFrame, docs: DataFrame, k: int, alike: float, id_col: str, text_col: str) -> DataFrame:
    """The pairs (u, v) of docs whose shingles overlap by alike or more."""
    sets = pa.schema([("row", pa.int64()), ("own", pa.binary())])
    ends = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def gather(batch):
        yield {"row": batch.column(0), "own": [shingles(x, k).tobytes() for x in as_bytes(batch.column(1))]}

    def compare(batch):
        a, b = (batch.column(i).to_pylist() for i in (2, 3))
        sizes = [(len(np.intersect1d(np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8"), True)), (len(x) + len(y)) // 8) for x, y in zip(a, b)]
        stay = pa.array([both == every or both / (every - both) >= alike for both, every in sizes], pa.bool_())
        yield {"u": batch.column(0).filter(stay), "v": batch.column(1).filter(stay)}

    some = written(pairs.select(F.explode(F.array("u", "v")).alias("row")).distinct(), "some")
    near = F.broadcast(some) if some.count() <= TOLD else some
    own = clean_id(docs, id_col, text_col).withColumnRenamed("doc_id", "row").join(near, "row", "left_semi")
    own = written(own.mapInArrow(in_batches(gather, sets), "row long, own binary"), "sets")
    at = lambda name, content: own.select(F.col("row").alias(name), F.col("own").alias(content))
    found = written(pairs.join(at("u", "a"), "u").join(at("v", "b"), "v").select("u", "v", "a", "b").mapInArrow(in_batches(compare, ends), "u long, v long"), "confirmed")
    dropped(docs.sparkSession, own, some)
    return found


def split(placed: DataFrame) -> DataFrame:
    """(key, main, n, strays) of buckets (key, row, root) with more than one root: the commonest, rows, and those of other roots."""
    sizes = placed.groupBy("key", "root").agg(F.count("*").alias("m"))
    all_ = sizes.groupBy("key").agg(F.max_by("root", F.struct("m", "root")).alias("main"), F.sum("m").alias("n"), (F.sum("m") - F.max("m")).alias("strays"))
    return all_.where("strays > 0")


def once(key: str, *keys: str) -> Column:
    """Whether key is the least that all of some arrays have: a pair that meets in many buckets is made in one of them."""
    return F.col(key) == F.array_min(F.array_intersect(*keys))


def known(placed: DataFrame, marks: DataFrame | None) -> DataFrame:
    return placed.groupBy("row").agg(F.collect_set("key").alias("keys")) if marks is None else marks


def may_be(marks: DataFrame | None, alike: float) -> Column:
    """False where parities prove that the texts of x and y differ in more shingles than texts that overlap by alike can."""
    if marks is None or "bits" not in marks.columns:
        return F.lit(True)
    apart = reduce(Column.__add__, (F.bit_count(F.get("x.bits", F.lit(i)).bitwiseXOR(F.get("y.bits", F.lit(i)))) for i in range(PARITY // 64)))
    return apart * (1 + alike) <= (F.col("x.n") + F.col("y.n")) * (1 - alike) + 1e-6


def across(placed: DataFrame, marks: DataFrame | None = None, alike: float = ALIKE) -> DataFrame:
    """The pairs (u, v) of all rows of a bucket that have other roots, from (key, row, root), each pair once and without those that
    can't be alike by their marks (row, keys, n, bits), if given. Rows of the commonest root meet the strays alone, so that rows of one root
    make no pairs; parts of GROUP strays or so meet the bucket's rows apart, so a large bucket is no one task's."""
    told = placed.select("key", "row", "root").join(split(placed).select("key", "main", F.ceil(F.col("strays") / GROUP).alias("parts")), "key").join(known(placed, marks), "row")
    rows = told.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    strays = told.where("root <> main").withColumn("part", F.pmod(F.xxhash64("row", "key"), F.col("parts")))
    both = F.expr("x.key = y.key and x.part = y.part and x.root <> y.root and (x.row < y.row or x.root = x.main)")
    return ends(rows.alias("x").join(strays.alias("y"), both & once("x.key", "x.keys", "y.keys") & may_be(marks, alike)))


def sampled(placed: DataFrame, turn: int, marks: DataFrame | None = None, alike: float = ALIKE) -> DataFrame:
    """Of the pairs of across() those with one of PIVOTS rows of each bucket, others at each turn. Buckets choose by one order of
    all rows, so that those of a group choose mostly the same rows."""
    each = [F.min(F.struct(F.xxhash64("row", F.lit(PIVOTS * turn + i)).alias("h"), "row", "root")) for i in range(PIVOTS)]
    chosen = placed.groupBy("key").agg(F.array_distinct(F.array(*each)).alias("x")).select("key", F.explode("x").alias("x")).select("key", "x.row", "x.root")
    marks = known(placed, marks)
    own = marks.drop("keys").join(chosen.groupBy("row").agg(F.collect_set("key").alias("keys")), "row")
    rows, chosen = placed.select("key", "row", "root").join(marks, "row"), chosen.join(own, "row")
    both = F.expr("x.key = y.key and x.root <> y.root")
    return ends(rows.alias("x").join(chosen.alias("y"), both & once("x.key", "x.keys", "y.keys") & may_be(marks, alike)))


def ends(both: DataFrame) -> DataFrame:
    return both.select(F.least("x.row", "y.row").alias("u"), F.greatest("x.row", "y.row").alias("v")).distinct()


def similar(docs: DataFrame, k: int = 5, views: int = 1, alike: float = ALIKE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(node, root) of texts that are linked, by overlaps of alike or more, to others; identifiers are long and unique."""
    schema = pa.schema([("row", pa.int64()), ("keys", pa.list_(pa.int64())), ("n", pa.int64()), ("bits", pa.list_(pa.int64()))])

    def work(batch):
        own = [shingles(x, k) for x in as_bytes(batch.column(1))]
        yield {"row": batch.column(0), "keys": [band_keys(x) for x in own], "n": [len(x) for x in own], "bits": [parities(x) for x in own]}

    marked = written(fingerprints(docs, k, views, id_col, text_col), "fingerprints")
    nodes = written(marked.groupBy("view", "fp").agg(F.min("doc_id").alias("low")), "nodes")
    near = links(nodes).union(marked.join(nodes, ["view", "fp"]).where("doc_id <> low").select("low", "doc_id"))
    bands = written(clean_id(docs, id_col, text_col).mapInArrow(in_batches(work, schema), "row long, keys array<long>, n long, bits array<long>"), "bands")
    bucket, keyed = Window.partitionBy("key"), bands.select("row", F.explode("keys").alias("key"))
    members = written(keyed.withColumns({"low": F.min("row").over(bucket), "n": F.count("*").over(bucket)}).where("n > 1"), "members")
    marks = written(bands.join(members.select("row").distinct(), "row", "left_semi"), "marks")
    first = members.where("row <> low").select(F.col("low").alias("u"), F.col("row").alias("v")).union(near)
    first = written(first.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "candidates")
    edges = confirmed(first, docs, k, alike, id_col, text_col)

    spark = docs.sparkSession
    dropped(spark, marked, nodes, bands)
    roots, turn = components(edges), 0
    while True:
        placed = members.join(roots.withColumnRenamed("node", "row"), "row", "left").select("key", "row", F.coalesce("root", "row").alias("root"))
        rest = written(placed.join(split(placed).select("key"), "key", "left_semi"), "placed")
        whole, few = split(rest).agg(F.sum(F.col("n") * F.col("strays")), F.sum("n") * PIVOTS).first()
        last = turn == TURNS or not whole or whole <= few
        second = across(rest, marks, alike) if last else sampled(rest, turn, marks, alike)
        second = written(second.join(first, ["u", "v"], "left_anti"), "candidates")
        more = confirmed(second, docs, k, alike, id_col, text_col)
        joined = written(edges.union(more), "joined")
        dropped(spark, rest, edges, more)
        edges, tried = joined, first
        if last:
            dropped(spark, members, marks, second, tried)
            found = components(edges)
            dropped(spark, edges)
            return found
        first, roots, turn = written(tried.union(second), "candidates"), components(edges), turn + 1
        dropped(spark, tried, second)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents."""
    found = classes(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
