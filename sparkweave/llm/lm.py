"""Language-model scoring by context-tree weighting over bytes.

The model predicts lower-cased texts with words joined by one blank and closed by an end byte, a byte as eight binary
decisions (its bits, high ones first). A context is the string of up to DEPTH bytes before; every context that occurs and
every bit prefix has a Krichevsky-Trofimov estimator over the training texts, and context-tree weighting mixes those of all
depths with the weights that the training texts give them. No context is left out: the model grows with the input.

So the tree is a table dealt to shards by the last TOP bytes of the context, and texts ask it instead of holding it:

1. the texts of a task are a block; it lists the distinct strings of DEPTH + 1 bytes (a context and the byte after it) and
   the distinct words in it, with their training counts (0 for what only held-out texts have). So a string comes once from
   each block, however common it is;
2. each shard adds up the counts, builds its branch of the tree and sums it up for the few nodes above (contexts of fewer than
   TOP bytes, 65,536 at most), whose weights are made on the driver and sent back;
3. each shard gives the strings of each block their log probabilities, and buckets by hash give the words their counts;
4. each block, read again, adds up the values of its strings and words text by text.

Strings that no training text has are in the table with count 0, which changes no estimate of others: their chance is what
the longest known contexts leave them.

Null text counts as empty: one end token. A null doc_id is a training text. Rows that repeat count as often as they
occur. Other columns are left aside. Without training texts every count is 0 and the model is uniform. Long texts are
worked on in slices; only their bytes are held whole. An empty table gives an empty result.

docs is read twice and must fall into the same partitions both times, as files do; give stable=False for a plan that may
not, and it is written first. A block that isn't the same the second time is an error, never a wrong score.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkweave.llm._common import as_bytes, clean_id, cut, pieces, planes, released, table, unplaned, written

DEPTH = 6
#: Bytes of a context by which shards are dealt; above them the tree has at most 256 ** (TOP - 1) contexts a depth.
TOP = 3
#: Bytes of text of a block at most, bytes worked on at once, bytes of text a shard is meant for, and the fewest shards.
BLOCK, SLICE, SHARD, SHARDS = 32_000_000, 2_000_000, 2_000_000, 16
#: Bytes of texts in one row, about: the JVM keeps large arrays apart and badly.
ROW = 500_000
#: The byte that ends a text; it is in no UTF-8 text.
END = 0xFF
WHITE = re.compile(rb"[\x20\x09-\x0D]")
#: What a row of a block holds: strings and words that it asks for or what it is told of them, or its texts.
TEXTS, STRINGS, WORDS = range(3)
ASKED = pa.schema([("block", pa.int64()), ("kind", pa.int32()), ("part", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])
ASKED_SQL = "block long, kind int, part int, keys binary, counts binary"


def held_out(doc_id: Column, parts: int = 7, part: int = 2) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % parts == part, F.lit(False))


def word_lists(text: bytes, most: int = SLICE // 4) -> Iterator[list[bytes]]:
    """The words of a text, those of a long one in several lists."""
    at = 0
    while len(text) - at > 2 * most and (found := WHITE.search(text, at + most)):
        yield text[at : found.start()].split()
        at = found.end()
    yield text[at:].split()


def small(blob: bytes) -> bytes:
    """blob, compressed, with its length before it."""
    return len(blob).to_bytes(8, "little") + pa.compress(blob, codec="zstd", asbytes=True)


def large(blob: bytes) -> bytes:
    return pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True)


def from_small(blob: bytes, kind: str) -> np.ndarray:
    return unplaned(pa.chunked_array([[large(blob)]]), kind)


def strings_of(own: np.ndarray, depth: int, top: int) -> np.ndarray:
    """The string of depth + 1 bytes that ends at each byte of own from depth on, as one number: the last top bytes of the
    context first, then those before them, then the byte, so that ascending order is that of shards' contexts."""

    def grams(n: int) -> np.ndarray:
        out = own.astype(np.uint32)
        for _ in range(n - 1):
            out = out[:-1] << np.uint32(8) | own[len(own) - len(out) + 1 :]
        return out

    n, rest = len(own) - depth, depth - top
    code = grams(top)[rest : rest + n].astype(np.int64)
    code <<= 8 * (rest + 1)
    if rest:
        code |= grams(rest)[:n].astype(np.int64) << 8
    code |= own[depth:]
    return code


def context(strings: np.ndarray, depth: int, top: int) -> np.ndarray:
    """The contexts as numbers with the oldest byte highest."""
    rest = depth - top
    return (strings >> 8 & ((1 << 8 * rest) - 1)) << 8 * top | strings >> 8 * (rest + 1)


def codes(data: np.ndarray, lengths: np.ndarray, depth: int, most: int | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, end, strings, first strings): the strings that end at each byte of some texts, and where each text's
    begin. data has depth end bytes before each text; a long text comes in several turns."""
    most, top = most or SLICE, min(TOP, depth)
    begins = np.cumsum(lengths + depth) - lengths - depth
    upto = np.cumsum(lengths)
    a = 0
    while a < len(lengths):
        b = max(a + 1, int(np.searchsorted(upto, upto[a] - lengths[a] + most, "right")))
        whole = lengths[a:b]
        parts = [(0, int(begins[b - 1] - begins[a] + whole[-1]))] if b > a + 1 or whole[0] <= most else pairwise([*range(0, int(whole[0]), most), int(whole[0])])
        for x, y in parts:
            code = strings_of(data[begins[a] + x : begins[a] + y + depth], depth, top)
            if b > a + 1:  # without those that end in what stands before a text
                code = code[np.arange(int(whole.sum())) + np.repeat(depth * np.arange(b - a), whole)]
            yield a, b, code, np.cumsum(whole) - whole
        a = b


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([np.ones(min(len(keys), 1), bool), keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts[order], first) if len(keys) else counts


def dealt(by: np.ndarray, parts: int) -> list[tuple[int, np.ndarray]]:
    """(part, places) by a hash of some numbers."""
    part = ((by.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    edges = np.searchsorted(part[order], np.arange(parts + 1)).tolist()
    return [(b, order[x:y]) for b, (x, y) in enumerate(pairwise(edges)) if x < y]


def shards_of(strings: np.ndarray, depth: int, shards: int) -> list[tuple[int, np.ndarray]]:
    return dealt(strings >> 8 * (depth - min(TOP, depth) + 1), shards)


class Strings:
    """The distinct strings of a block, ascending, and their training counts."""

    def __init__(self) -> None:
        self.held: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, data: np.ndarray, lengths: np.ndarray, depth: int, count: bool) -> None:
        for _, _, code, _ in codes(data, lengths, depth):
            code.sort()
            first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
            n = np.diff(np.append(first, len(code)))
            self.held.append((code[first], n if count else 0 * n))
        if sum(len(k) for k, _ in self.held[1:]) > SLICE:
            self.held = [self.all()]

    def all(self) -> tuple[np.ndarray, np.ndarray]:
        return summed(*map(np.concatenate, zip(*self.held))) if self.held else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def padded(texts: list[bytes], depth: int) -> tuple[bytes, np.ndarray]:
    """Texts, each after depth end bytes, and their own lengths."""
    pad = bytes([END]) * depth
    return b"".join(x for t in texts for x in (pad, t)), np.fromiter(map(len, texts), np.int64, len(texts))


def in_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Array, np.ndarray, list[bytes]]]:
    """Pieces of (doc_id, text, held_out) with the number of their block: ids, flags and clean texts, closed by an end."""
    block, size = TaskContext.get().partitionId() << 32, 0
    for batch in batches:
        for piece in pieces(batch):
            texts = [b" ".join(x for some in word_lists(t.lower()) if (x := b" ".join(some))) + b"\xff" for t in as_bytes(piece.column(1))]
            own = sum(map(len, texts))
            if size and size + own > BLOCK:
                block, size = block + 1, 0
            size += own
            yield block, piece.column(0), piece.column(2).to_numpy(zero_copy_only=False).astype(bool), texts


def asking(depth: int, shards: int):
    """For mapInArrow over (doc_id, text, held_out): what the blocks ask for, by shard and bucket."""

    def sent(block: int, strings: Strings, words: Counter) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        keys, counts = strings.all()
        for part, at in shards_of(keys, depth, shards):
            rows.append((block, STRINGS, part, small(planes(np.diff(keys[at], prepend=0))), small(planes(counts[at]))))
        known, n = list(words), np.fromiter(words.values(), np.int64, len(words))
        for part, at in dealt(np.fromiter(map(hash_of, known), np.int64, len(known)), shards):
            rows.append((block, WORDS, part, small(b" ".join([known[i] for i in at.tolist()])), small(planes(n[at]))))
        yield from cut(dict(zip(ASKED.names, map(list, zip(*rows)))), ASKED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, strings, words = None, Strings(), Counter()
        for block, _, held, texts in in_blocks(batches):
            if block != at and at is not None:
                yield from sent(at, strings, words)
                strings, words = Strings(), Counter()
            at = block
            for apart in (False, True):
                mine = [t for t, h in zip(texts, held.tolist()) if h == apart]
                data, lengths = padded(mine, depth)
                strings.add(np.frombuffer(data, np.uint8), lengths, depth, not apart)
                for t in mine:
                    for some in word_lists(t[:-1]):
                        if apart:
                            for w in some:
                                words.setdefault(w, 0)
                        else:
                            words.update(some)
        if at is not None:
            yield from sent(at, strings, words)

    return released(run)


#: What is kept of a text beside its bytes.
ABOUT = np.dtype([("doc_id", "<i8"), ("there", "?"), ("held_out", "?"), ("length", "<i8")])


def hash_of(word: bytes) -> int:
    """A number from the bytes of a word, the same in every process."""
    return int.from_bytes(word[:4] + word[-3:] + bytes([len(word) & 255]), "little", signed=True)


def add_words(own: pa.Table) -> pa.Table:
    """Of one bucket: for each block the counts of its words over all; and once how many tokens and words these are."""
    total: Counter = Counter()
    parts = [large(x).split(b" ") for x in own["keys"].to_pylist()]
    for words, n in zip(parts, own["counts"].to_pylist()):
        for w, k in zip(words, from_small(n, "<i8").tolist()):
            total[w] += k
    back = [small(planes(np.fromiter(map(total.__getitem__, words), np.int64, len(words)))) for words in parts]
    n = np.zeros((2, own.num_rows), np.int64)
    n[:, 0] = sum(total.values()), sum(k > 0 for k in total.values())
    return pa.table({"block": own["block"], "keys": own["keys"], "told": pa.array(back, pa.binary()), "tokens": n[0], "distinct": n[1]})


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Logarithm of the gamma function for x > 0, by Stirling's series past 8."""
    shift = np.ones_like(x)
    for i in range(8):
        shift *= x + i
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) - np.log(shift)


SMALL = np.arange(4096.0)
OF_SMALL = {0.5: log_gamma(SMALL + 0.5), 1.0: log_gamma(SMALL + 1)}


def log_factorial(n: np.ndarray, more: float) -> np.ndarray:
    """log_gamma(n + more) for whole n, mostly small."""
    out = OF_SMALL[more][np.minimum(n, len(SMALL) - 1).astype(np.int64)]
    large = np.flatnonzero(n >= len(SMALL))
    out[large] = log_gamma(n[large] + more)
    return out


def log_kt(zero: np.ndarray, one: np.ndarray) -> np.ndarray:
    """Logarithm of the KT probability of that many zeros and ones."""
    return log_factorial(zero, 0.5) + log_factorial(one, 0.5) - log_factorial(zero + one, 1.0) - np.log(np.pi)


class Level:
    """The nodes of one depth: a key is a context and, in its lowest byte, a bit prefix (with a one before it).

    kids: the logarithm of the children's weighted probabilities, multiplied; None for the deepest nodes."""

    def __init__(self, keys: np.ndarray, zero: np.ndarray, one: np.ndarray, kids: np.ndarray | None = None):
        self.keys, self.zero, self.one = keys, zero, one
        alone = log_kt(zero, one)
        self.own = (one + 0.5) / (zero + one + 1)
        self.weighted = alone if kids is None else np.logaddexp(alone, kids) - np.log(2)
        self.share = np.ones_like(alone) if kids is None else 1 / (1 + np.exp(np.clip(kids - alone, -60, 60)))

    def above(self, depth: int) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Keys of the nodes of that depth above these, the number of each one's, and the counts and kids to make them of."""
        keys, up = np.unique(self.keys & ((1 << 8 * (depth + 1)) - 1), return_inverse=True)
        return keys, up, tuple(np.bincount(up, x, len(keys)) for x in (self.zero, self.one, self.weighted))

    def below(self, part: np.ndarray, so_far: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What of a chance of one the children decide, and what is decided above them; the same for these nodes is given."""
        return part * (1 - self.share), so_far + part * self.share * self.own


class Branch:
    """The tree of some strings from the deepest contexts up to those of top bytes."""

    def __init__(self, strings: np.ndarray, counts: np.ndarray, depth: int, top: int):
        byte = strings & 255
        steps = np.arange(8)
        self.bits = (byte[:, None] >> (7 - steps) & 1).astype(bool)
        keys = (context(strings, depth, top) << 8)[:, None] | 1 << steps | byte[:, None] >> (8 - steps)
        keys, self.at = np.unique(keys.ravel(), return_inverse=True)
        n = np.repeat(counts, 8).astype(float)
        one = np.bincount(self.at, n * self.bits.ravel(), len(keys))
        self.levels, self.up = [Level(keys, np.bincount(self.at, n, len(keys)) - one, one)], []
        for d in range(depth - 1, top - 1, -1):
            keys, up, own = self.levels[-1].above(d)
            self.up.append(up)
            self.levels.append(Level(keys, *own))

    def logs(self, part: np.ndarray, so_far: np.ndarray) -> np.ndarray:
        """log10 probability of each string's last byte; given what the highest nodes here decide and what is decided above."""
        for level, up in zip(self.levels[:0:-1], self.up[::-1]):
            part, so_far = (x[up] for x in level.below(part, so_far))
        chance = (so_far + part * self.levels[0].own)[self.at].reshape(-1, 8)
        return np.log10(np.where(self.bits, chance, 1 - chance)).sum(1)


def crown(keys: np.ndarray, zero: np.ndarray, one: np.ndarray, kids: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the nodes of top - 1 bytes: keys, what their children decide of a chance, and what is decided above those."""
    levels, ups = [Level(keys, zero, one, kids)], []
    for d in range(top - 2, -1, -1):
        keys, up, own = levels[-1].above(d)
        ups.append(up)
        levels.append(Level(keys, *own))
    part, so_far = np.ones(len(levels[-1].keys)), np.zeros(len(levels[-1].keys))
    for level, up in zip(levels[:0:-1], ups[::-1]):
        part, so_far = (x[up] for x in level.below(part, so_far))
    return levels[0].keys, *levels[0].below(part, so_far)


SUMS = pa.schema([("part", pa.int32()), *((c, pa.binary()) for c in ("keys", "zero", "one", "kids"))])
SUMS_SQL = "part int, keys binary, zero binary, one binary, kids binary"


def asked_strings(own: pa.Table) -> list[np.ndarray]:
    return [np.cumsum(from_small(x, "<i8")) for x in own["keys"].to_pylist()]


def branch_of(own: pa.Table, asked: list[np.ndarray], depth: int, top: int) -> tuple[np.ndarray, Branch]:
    """The strings of a shard, ascending, and their branch of the tree."""
    strings, counts = summed(np.concatenate(asked), np.concatenate([from_small(x, "<i8") for x in own["counts"].to_pylist()]))
    return strings, Branch(strings, counts, depth, top)


def sums_above(depth: int, top: int):
    """For applyInArrow over a shard: the sums of its branch for the nodes above, dealt by the last byte of the context."""

    def run(own: pa.Table) -> pa.Table:
        keys, _, sums = branch_of(own, asked_strings(own), depth, top)[1].levels[-1].above(top - 1)
        last = keys >> 8 & 255
        out: dict[str, list] = {f.name: [] for f in SUMS}
        for part in np.unique(last).tolist():
            at = np.flatnonzero(last == part)
            for name, x in zip(out, (part, *(planes(x[at]) for x in (keys, *sums)))):
                out[name].append(x)
        return pa.table(out, schema=SUMS)

    return run


def add_sums(own: pa.Table) -> pa.Table:
    """The sums of all shards for the nodes of one last byte."""
    keys, up = np.unique(unplaned(own["keys"], "<i8"), return_inverse=True)
    sums = [np.bincount(up, unplaned(own[c], "<f8"), len(keys)) for c in ("zero", "one", "kids")]
    return pa.table([[own["part"][0].as_py()], *([planes(x)] for x in (keys, *sums))], schema=SUMS)


def tell_strings(depth: int, top: int, shared):
    """For applyInArrow over a shard: for each block the values of its strings, in their order."""

    def run(own: pa.Table) -> pa.Table:
        asked = asked_strings(own)
        strings, branch = branch_of(own, asked, depth, top)
        keys, part, so_far = shared.value
        at = np.searchsorted(keys, branch.levels[-1].keys & ((1 << 8 * top) - 1))
        logs = branch.logs(part[at], so_far[at]).astype("<f4")
        told = [small(planes(logs[np.searchsorted(strings, x)])) for x in asked]
        return pa.table({"block": own["block"], "part": own["part"], "told": pa.array(told, pa.binary())})

    return run


class Lookup:
    """Values of distinct strings in an open-addressing table of arrays; every string that is asked for is there."""

    def __init__(self, strings: np.ndarray, values: np.ndarray):
        bits = max(4, int(2 * len(strings)).bit_length())
        self.shift, self.last = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.float32)
        slot, left = self.slots(strings), np.arange(len(strings))
        while len(left):
            at = slot[left]
            free = self.keys[at] < 0
            self.keys[at[free]] = strings[left[free]]
            mine = self.keys[at] == strings[left]
            self.values[at[mine]] = values[left[mine]]
            left = left[~mine]
            slot[left] = slot[left] + 1 & self.last

    def slots(self, strings: np.ndarray) -> np.ndarray:
        return (strings.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).view(np.int64)

    def find(self, strings: np.ndarray) -> np.ndarray:
        slot = self.slots(strings)
        left = np.flatnonzero(self.keys.take(slot) != strings)
        while len(left):
            slot[left] = slot[left] + 1 & self.last
            left = left[self.keys.take(slot[left]) != strings[left]]
        return self.values.take(slot)


SCORED = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("logs", pa.float64()), ("score", pa.float64()), ("n_bytes", pa.int64())])
SCORED_SQL = "doc_id long, held_out boolean, n_tokens long, n_known long, logs double, score double, n_bytes long"


TEXT = pa.schema([("block", pa.int64()), ("about", pa.binary()), ("texts", pa.binary())])


def packed_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow over (doc_id, text, held_out): the clean texts of the blocks, compressed."""
    for block, ids, held, texts in in_blocks(batches):
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        about = np.rec.fromarrays([ids.fill_null(0).to_numpy(), ids.is_valid().to_numpy(zero_copy_only=False), held, lengths], dtype=ABOUT)
        rows = pairwise([*np.flatnonzero(np.diff(np.cumsum(lengths) // ROW, prepend=-1)).tolist(), len(texts)])
        some = [(block, about[x:y].tobytes(), small(b"".join(texts[x:y]))) for x, y in rows]
        yield from cut(dict(zip(TEXT.names, map(list, zip(*some)))), TEXT)


class Block:
    """What a task gets of one block, first its texts."""

    def __init__(self, depth: int, shards: int):
        self.depth, self.shards = depth, shards
        self.texts: list[tuple[np.ndarray, list[bytes]]] = []
        self.logs: dict[int, bytes] = {}
        self.counts: dict[bytes, int] = {}

    def add(self, kind: int, part: int, a: bytes, b: bytes) -> None:
        if kind == TEXTS:
            about = np.frombuffer(a, ABOUT)
            ends = np.cumsum(about["length"]).tolist()
            blob = large(b)
            self.texts.append((about, [blob[x:y] for x, y in pairwise([0, *ends])]))
        elif kind == STRINGS:
            self.logs[part] = b
        else:
            self.counts.update(zip(large(a).split(b" "), from_small(b, "<i8").tolist()))

    def lookup(self) -> Lookup:
        strings = Strings()
        for _, texts in self.texts:
            data, lengths = padded(texts, self.depth)
            strings.add(np.frombuffer(data, np.uint8), lengths, self.depth, False)
        keys, _ = strings.all()
        values = np.empty(len(keys), np.float32)
        for part, at in shards_of(keys, self.depth, self.shards):
            told = from_small(self.logs.pop(part, small(b"")), "<f4")
            if len(told) != len(at):
                raise RuntimeError("a block of texts is not the one that asked: give stable=False")
            values[at] = told
        return Lookup(keys, values)

    def scored(self) -> Iterator[pa.RecordBatch]:
        lookup = self.lookup()
        for about, texts in self.texts:
            data, lengths = padded(texts, self.depth)
            score = np.zeros(len(about))
            for x, y, code, firsts in codes(np.frombuffer(data, np.uint8), lengths, self.depth):
                score[x:y] += np.add.reduceat(lookup.find(code).astype(float), firsts)
            n, known, logs = np.zeros(len(about), np.int64), np.zeros(len(about), np.int64), np.zeros(len(about))
            for i, text in enumerate(texts):
                for words in word_lists(text[:-1]):
                    found = np.fromiter(map(self.counts.__getitem__, words), np.int64, len(words))
                    n[i] += len(words)
                    known[i] += np.count_nonzero(found)
                    logs[i] += np.log10(found + 1).sum()
            ids = pa.array(about["doc_id"], mask=~about["there"])
            yield from cut({"doc_id": ids, "held_out": pa.array(about["held_out"]), "n_tokens": pa.array(n), "n_known": pa.array(known), "logs": pa.array(logs), "score": pa.array(score), "n_bytes": pa.array(lengths)}, SCORED)


def score_blocks(depth: int, shards: int):
    """For mapInArrow over (block, kind, part, a, b), sorted by block and kind: one row for each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own = None, Block(depth, shards)
        for batch in batches:
            for i in range(batch.num_rows):
                block, *row = (batch.column(c)[i].as_py() for c in range(5))
                if block != at:
                    if at is not None:
                        yield from own.scored()
                    at, own = block, Block(depth, shards)
                own.add(*row)
        if at is not None:
            yield from own.scored()

    return released(run)


def score(docs: DataFrame, held: Column | None = None, depth: int = DEPTH, stable: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte."""
    spark, top = docs.sparkSession, min(TOP, depth)
    held = held_out(F.col("doc_id")) if held is None else held
    own = clean_id(docs, id_col, text_col).select("doc_id", F.col(text_col).alias("text"), held.alias("held_out"))
    own = own if stable else written(own, "texts")
    size, ends = own.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count_if(~F.col("held_out"))).first()
    shards = max(SHARDS, -(-size // SHARD))
    asked = written(own.mapInArrow(asking(depth, shards), ASKED_SQL), "asked")

    words = asked.where(F.col("kind") == WORDS).groupBy("part").applyInArrow(add_words, "block long, keys binary, told binary, tokens long, distinct long")
    words = written(words, "words")
    tokens, distinct = words.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("distinct"), F.lit(0))).first()
    tokens, distinct = tokens + ends, distinct + (ends > 0)

    strings = asked.where(F.col("kind") == STRINGS).select("block", "part", "keys", "counts").groupBy("part")
    sums = strings.applyInArrow(sums_above(depth, top), SUMS_SQL).groupBy("part").applyInArrow(add_sums, SUMS_SQL)
    sums = sums.toArrow()  # the nodes above the shards: 256 ** (TOP - 1) contexts at most
    found = [unplaned(sums[c], kind) for c, kind in (("keys", "<i8"), ("zero", "<f8"), ("one", "<f8"), ("kids", "<f8"))]
    order = np.argsort(found[0])
    shared = spark.sparkContext.broadcast(crown(*(x[order] for x in found), top) if len(order) else ())
    told = strings.applyInArrow(tell_strings(depth, top, shared), "block long, part int, told binary")

    row = lambda df, kind, part, a, b: df.select("block", F.lit(kind).alias("kind"), part.cast("int").alias("part"), a.cast("binary").alias("a"), F.col(b).alias("b"))
    none = F.lit(None)
    rows = row(own.mapInArrow(released(packed_texts), "block long, about binary, texts binary"), TEXTS, none, F.col("about"), "texts")
    rows = rows.unionByName(row(told, STRINGS, F.col("part"), none, "told")).unionByName(row(words, WORDS, none, F.col("keys"), "told"))
    scored = rows.repartition("block").sortWithinPartitions("block", "kind").mapInArrow(score_blocks(depth, shards), SCORED_SQL)
    per_token, end = F.log10(F.lit(float(tokens + distinct + 1))), F.log10(F.lit(float(ends + 1)))
    return scored.select(
        "doc_id", "held_out", (F.col("n_tokens") + 1).alias("n_tokens"), (F.col("n_known") + int(ends > 0)).alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("logs") + end - (F.col("n_tokens") + 1) * per_token).alias("base_score"), "score", (-F.col("score") / F.col("n_bytes") * float(np.log2(10))).alias("bits_per_byte"),
    )


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents scored by a model of those that are not held out."""
    return score(table(spark, sf_dir, "documents"))
