"""Byte-level BPE encoding and decoding with a pair occurrence index.

Texts of an Arrow batch are cut into pre-tokens with array operations over code points. Pre-tokens not seen before are
laid end to end in one array of symbols; an index maps every pair to all its positions in that array. Active ranks are
applied in ascending order, each to all its positions at once, and only the lists of the neighbouring pairs change.
A merge can only make pairs of a higher rank, because the token it makes exists from that rank on, so one ascending
sweep equals the usual word-by-word procedure.

Null text counts as empty, an empty text has no tokens, extra columns are ignored unless asked for. A text of any length is
worked on in parts of about CHUNK_CHARS, cut before white space; only a longer run without any is one part.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from functools import lru_cache
from itertools import pairwise

import numpy as np

from sparkweave.llm._spans import SpanHashes

#: Most pre-tokens that a worker remembers between batches; beyond that it starts anew, so memory is bounded.
KNOWN_WORDS = 1_400_000
#: Slots of the table of known pre-tokens, as a power of two.
SLOT_BITS = 22
#: Code points that are cut and encoded at once.
CHUNK_CHARS = 1_500_000

LETTER, NUMBER, OTHER, SPACE, EDGE = range(5)
#: White space as Unicode has it (fixed values).
WHITE = (*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
#: A character that is no white space before a blank or line end: there a token ends and another begins.
SAFE = re.compile("[^" + "".join(map(chr, WHITE)) + "][ \n]")


@lru_cache(1)
def char_classes() -> np.ndarray:
    """Class of every code point: letter, number, white space or other."""
    kind = {"L": LETTER, "N": NUMBER}
    out = np.fromiter((kind.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    out[list(WHITE)] = SPACE
    return out


def token_starts(codes: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Flags the first code point of each pre-token; edges: the places of separators between texts.

    A run of letters, numbers or other characters takes one blank before it; white space before anything else is a
    token without its last character; 's 't 'm 'd 're 've 'll are cut off at an apostrophe that stands alone.
    """
    kind = char_classes()[codes]
    kind[edges] = EDGE
    start = np.empty(len(kind), bool)
    start[:1] = True
    np.not_equal(kind[1:], kind[:-1], out=start[1:])
    start[edges] = True
    last = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] < SPACE))
    start[last] = True
    start[last[codes[last] == 32] + 1] = False
    quote = np.flatnonzero((codes[:-1] == 39) & start[:-1] & (kind[1:] == LETTER))
    if len(quote):
        padded = np.concatenate([codes, np.zeros(2, codes.dtype)])
        one, two = padded[quote + 1], padded[quote + 2]
        single = np.isin(one, [ord(c) for c in "stmd"])
        double = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        start[quote[single | double] + 1] = False
        after = np.concatenate([quote[single] + 2, quote[double] + 3])
        start[after[after < len(start)]] = True
    return start


def cut_text(text: str) -> list[str]:
    """text in parts of about CHUNK_CHARS; each but the first begins with a blank or line end after another character."""
    parts, at = [], 0
    while len(text) - at > 2 * CHUNK_CHARS and (found := SAFE.search(text, at + CHUNK_CHARS)):
        parts.append(text[at : found.start() + 1])
        at = found.start() + 1
    return [*parts, text[at:] if at else text]


def byte_letters() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = (b for b in range(256) if b not in set(plain))
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class WordTable:
    """Open-addressing table from 64-bit hashes to words and their ids, all in arrays.

    A hash only proposes a word: its code points are kept too and compared with those of the text (differing()). Words that
    share the hash of another are stored without one, each time anew until the table is cleared.
    """

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(1 << SLOT_BITS, np.uint64)
        self.word = np.zeros(1 << SLOT_BITS, np.int32)
        self.count = self.used = 0
        self.first, self.length = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int32)
        self.ids = np.zeros(1 << 14, np.uint32)
        self.spelled, self.letters = np.zeros(1 << 12, np.int64), np.zeros(1 << 14, np.uint32)
        self.size, self.written = np.zeros(1 << 12, np.int32), 0

    @staticmethod
    def _slots(h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(64 - SLOT_BITS)).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Word numbers, -1 where a hash isn't known."""
        slot = self._slots(h)
        held = self.keys[slot]
        out = np.where(held == h, self.word[slot], np.int32(-1))
        left = np.flatnonzero((held != h) & (held != 0))
        while len(left):
            slot[left] = (slot[left] + 1) & ((1 << SLOT_BITS) - 1)
            held = self.keys[slot[left]]
            hit = held == h[left]
            out[left[hit]] = self.word[slot[left[hit]]]
            left = left[~hit & (held != 0)]
        return out

    def store(self, coded: list[bytes], words: list[str]) -> np.ndarray:
        """Numbers of new words, which no hash leads to yet."""
        numbers = np.arange(self.count, self.count + len(words), dtype=np.int32)
        for name, at, used, parts in (("ids", "first", "used", coded), ("letters", "spelled", "written", [w.encode("utf-32-le", "surrogatepass") for w in words])):
            new = np.frombuffer(b"".join(parts), "<u4")
            lengths = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
            before = getattr(self, used)
            setattr(self, name, _room(getattr(self, name), before + len(new)))
            getattr(self, name)[before : before + len(new)] = new
            setattr(self, at, _room(getattr(self, at), self.count + len(words)))
            getattr(self, at)[numbers] = before + np.cumsum(lengths) - lengths
            setattr(self, used, before + len(new))
            count = "length" if name == "ids" else "size"
            setattr(self, count, _room(getattr(self, count), self.count + len(words)))
            getattr(self, count)[numbers] = lengths
        self.count += len(words)
        return numbers

    def add(self, h: np.ndarray, coded: list[bytes], words: list[str]) -> None:
        """New words with distinct hashes."""
        numbers = self.store(coded, words)
        slot, left = self._slots(h), np.arange(len(h))
        while len(left):
            at = slot[left]
            free = self.keys[at] == 0
            self.keys[at[free]] = h[left[free]]
            mine = self.keys[at] == h[left]
            self.word[at[mine]] = numbers[left[mine]]
            left = left[~mine]
            slot[left] = (slot[left] + 1) & ((1 << SLOT_BITS) - 1)

    def differing(self, words: np.ndarray, codes: np.ndarray, first: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Places in words where the span of codes isn't spelled like the word."""
        lengths = ends - first
        wrong = self.size[words] != lengths
        same = np.flatnonzero(~wrong)
        lengths = lengths[same]
        begins = np.cumsum(lengths) - lengths
        at = np.arange(int(lengths.sum()))
        there = codes[at + np.repeat(first[same] - begins, lengths)]
        off = np.flatnonzero(self.letters[at + np.repeat(self.spelled[words[same]] - begins, lengths)] != there)
        wrong[same[np.searchsorted(begins, off, "right") - 1]] = True
        return np.flatnonzero(wrong)

    def gather(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words, one after another, and where each word's begin (with the end of all)."""
        lengths = self.length[words].astype(np.int64)
        bounds = np.concatenate([[0], np.cumsum(lengths)])
        at = np.arange(bounds[-1]) + np.repeat(self.first[words] - bounds[:-1], lengths)
        return self.ids[at], bounds


def _room(a: np.ndarray, n: int) -> np.ndarray:
    return a if n <= len(a) else np.concatenate([a, np.zeros(max(n - len(a), len(a)), a.dtype)])


class Bpe:
    """Encoder and decoder for a byte-level BPE vocabulary given as tokenizer JSON text."""

    def __init__(self, text: str):
        spec = json.loads(text)
        letters = byte_letters()
        vocab = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        pieces = {i: bytes(letters[c] for c in w) for w, i in vocab.items() if w not in self.special}
        pieces |= {i: w.encode() for w, i in self.special.items()}
        self.pieces = [pieces.get(i, b"") for i in range(max(pieces) + 1)]
        self.size = size = len(self.pieces) + 1
        self.first = np.zeros(256, np.int64)
        for c, b in letters.items():
            self.first[b] = vocab[c]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.left = np.array([vocab[a] for a, _ in pairs], np.int64)
        self.right = np.array([vocab[b] for _, b in pairs], np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        keys = self.left * size + self.right
        self.rank_at = np.argsort(keys, kind="stable")
        self.keys = keys[self.rank_at]
        self.known = WordTable()
        self.hashes = SpanHashes(0x110000)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 where there is none."""
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank_at[at], -1)

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of each word, as little-endian unsigned 32-bit integers."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        wall = self.size - 1
        lengths = np.fromiter(map(len, raw), np.int64, len(raw))
        ends = np.cumsum(lengths + 1)
        data = np.frombuffer(b"\0" + b"\0".join(raw) + b"\0", np.uint8)
        sym = self.first[data]
        sym[0] = wall
        sym[ends] = wall
        after, before = np.arange(1, len(sym) + 1), np.arange(-1, len(sym) - 1)
        index: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def enter(places: np.ndarray, ranks: np.ndarray) -> None:
            known = ranks >= 0
            places, ranks = places[known], ranks[known]
            if not len(ranks):
                return
            order = np.argsort(ranks, kind="stable")
            places, ranks = places[order], ranks[order]
            cuts = [0, *(np.flatnonzero(ranks[1:] != ranks[:-1]) + 1).tolist(), len(ranks)]
            for a, b in pairwise(cuts):
                r = int(ranks[a])
                if r in index:
                    index[r].append(places[a:b])
                else:
                    index[r] = [places[a:b]]
                    heapq.heappush(active, r)

        enter(np.arange(len(sym) - 1), self.ranks(sym[:-1], sym[1:]))
        while active:
            r = heapq.heappop(active)
            lists = index.pop(r)
            at = lists[0] if len(lists) == 1 else np.concatenate(lists)
            a, b, new = self.left[r], self.right[r], self.made[r]
            at = at[(sym[at] == a) & (sym[after[at]] == b)]
            if not len(at):
                continue
            if a == b:  # of overlapping occurrences, every other one from the left
                at = np.sort(at)
                joined = np.concatenate([[False], after[at[:-1]] == at[1:]])
                n = np.arange(len(at))
                at = at[(n - np.maximum.accumulate(np.where(joined, 0, n))) % 2 == 0]
            gone = after[at]
            sym[at], sym[gone] = new, -1
            then = after[gone]
            after[at], before[then] = then, at
            left = before[at]
            left = left[sym[left] != new]  # that pair is entered as the right one of its left part
            places = np.concatenate([left, at])
            enter(places, self.ranks(sym[places], sym[after[places]]))
        keep = (sym >= 0) & (sym != wall)
        blob = sym[keep].astype("<u4").tobytes()
        bounds = (4 * np.concatenate([[0], np.cumsum(keep)[ends - 1]])).tolist()
        return [blob[x:y] for x, y in pairwise(bounds)]

    def encode_plain(self, texts: list[str]) -> list[bytes]:
        """Ids of texts without special tokens; long ones are cut where a token ends whatever surrounds it."""
        out: list[bytes] = []
        group: list[str] = []
        counts: list[int] = []
        size = 0
        for text in [*texts, None]:
            if text is not None:
                parts = cut_text(text)
                if len(parts) > 1:
                    out += self._encode_group(group) if group else []
                    out += [x for p in parts for x in self._encode_group([p])]
                    group, size = [], 0
                else:
                    group.append(text)
                    size += len(text)
                counts.append(len(parts))
            if group and (text is None or size >= CHUNK_CHARS):
                out += self._encode_group(group)
                group, size = [], 0
        ends = np.cumsum(counts).tolist() if counts else []
        return [out[b - 1] if n == 1 else b"".join(out[b - n : b]) for n, b in zip(counts, ends)]

    def _encode_group(self, texts: list[str]) -> list[bytes]:
        joined = "\0".join(texts) + "\0"
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        edges = np.cumsum(lengths + 1) - 1
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        first = np.flatnonzero(token_starts(codes, edges))
        ends = np.append(first[1:], len(codes))
        edge = np.searchsorted(first, edges)
        real = np.ones(len(first), bool)
        real[edge] = False
        first, ends = first[real], ends[real]
        h = self.hashes.spans(self.hashes.sums(codes), first, ends)
        h[h == 0] = 1
        known = self.known
        words = known.find(h)
        new = np.flatnonzero(words < 0)
        if len(new):
            if known.count + len(new) > KNOWN_WORDS:
                known.clear()
                new = np.arange(len(h))
            fresh, at = np.unique(h[new], return_index=True)
            at = new[at]
            spelled = [joined[a:b] for a, b in zip(first[at].tolist(), ends[at].tolist())]
            known.add(fresh, self.encode_words(spelled), spelled)
            words[new] = known.find(h[new])
        wrong = known.differing(words, codes, first, ends)
        if len(wrong):
            spelled = [joined[a:b] for a, b in zip(first[wrong].tolist(), ends[wrong].tolist())]
            place = {w: i for i, w in enumerate(dict.fromkeys(spelled))}
            words[wrong] = known.store(self.encode_words(list(place)), list(place))[[place[w] for w in spelled]]
        ids, bounds = known.gather(words)
        stops = [0, *bounds[edge - np.arange(len(edge))].tolist()]
        blob = memoryview(ids.astype("<u4").tobytes())
        return [bytes(blob[4 * a : 4 * b]) for a, b in pairwise(stops)]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers; special tokens in a text become their ids."""
        parts, plan = [], []
        for text in texts:
            own: list[str | int] = [text or ""]
            for word, number in self.special.items():
                if text and word in text:
                    own = [x for p in own for x in (_between(p.split(word), number) if isinstance(p, str) else [p])]
            plan.append(own if len(own) > 1 else None)
            parts += [p for p in own if isinstance(p, str)]
        coded = iter(self.encode_plain(parts))
        return [next(coded) if own is None else b"".join(next(coded) if isinstance(p, str) else p.to_bytes(4, "little") for p in own) for own in plan]

    def decode(self, ids: bytes) -> str:
        """Text of ids, special tokens included; bytes that aren't UTF-8 become U+FFFD."""
        own, step = np.frombuffer(ids, "<u4"), 1 << 20
        return b"".join(b"".join(map(self.pieces.__getitem__, own[a : a + step].tolist())) for a in range(0, len(own), step)).decode("utf-8", "replace")


def _between(parts: list[str], number: int) -> list[str | int]:
    """The parts with number between each two of them."""
    return [x for p in parts for x in (number, p)][1:]


@lru_cache(1)
def load(text: str) -> Bpe:
    """The encoder of a vocabulary, once in each worker."""
    return Bpe(text)
