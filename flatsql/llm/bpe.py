"""Byte-level BPE: encoding by merge ranks and decoding.

A piece's bytes are the leaves of a segment tree; the leaf of a live position holds the rank of the pair that
it forms with its next live neighbour, and every node the leftmost least rank below it. A merge reads the
root, joins the pair and updates three leaves (the joined, the consumed and the previous one) on their paths
to the root. The pieces of a chunk of text that a worker has not met are merged together, one lane of a numpy
array of trees each; pieces over LANE bytes get a tree of their own.

A worker holds no text as Python strings: a chunk's pieces are ranges of one byte array, and the pieces it has
met are rows of a table of fixed size, compared by all their bytes. So its memory follows CHUNK and REMEMBERED
and, for a text that can be cut nowhere, that text.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterable, Iterator
from functools import cache, cached_property

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flatsql.llm.common import slices

LANE = 128
#: Pieces that a worker remembers, of SHORT bytes or fewer; beyond, it starts afresh.
REMEMBERED = 400_000
SHORT = 16
#: Characters of text that are split before their new pieces are merged.
CHUNK = 1_000_000
NONE = np.iinfo(np.int32).max
#: The pattern that is split by numpy, over classes of characters; others go through the regular expression.
PLAIN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def load_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a .tiktoken file: a base64 token and its rank a line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, lines))}


class PairTable:
    """Rank of two adjacent tokens, by open addressing over numpy arrays; NONE where they do not merge."""

    def __init__(self, ranks: dict[bytes, int]):
        if len(ranks) >= 1 << 23:
            raise ValueError("a vocabulary has under 8,388,608 tokens")
        pairs = [(ranks[t[:i]], ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        bits = max(4, (4 * len(pairs)).bit_length())
        self.mask, self.shift = (1 << bits) - 1, np.uint64(64 - bits)
        self.keys, self.ranks = np.full(1 << bits, -1, np.int64), np.full(1 << bits, NONE, np.int32)
        if pairs:
            a, b, r = np.array(pairs, np.int64).T
            key = a << 32 | b
            slot, left = self._slot(key), np.arange(len(key))
            while len(left):  # every free slot takes one of those that want it; the rest look one further
                at = slot[left]
                free = self.keys[at] == -1
                self.keys[at[free]] = key[left[free]]
                done = self.keys[at] == key[left]
                self.ranks[at[done]] = r[left[done]]
                left = left[~done]
                slot[left] = slot[left] + 1 & self.mask

    @cached_property
    def by_pair(self) -> dict[tuple[int, int], int]:
        """The same as a dictionary, made when the first piece asks for it that has a tree of its own."""
        used = np.flatnonzero(self.keys != -1)
        return {(k >> 32, k & 0xFFFFFFFF): r for k, r in zip(self.keys[used].tolist(), self.ranks[used].tolist(), strict=True)}

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) << 32 | b
        slot = self._slot(key)
        held = self.keys[slot]
        out = np.where(held == key, self.ranks[slot], np.int32(NONE))
        left = np.flatnonzero((held != key) & (held != -1))
        while len(left):
            slot[left] = slot[left] + 1 & self.mask
            held = self.keys[slot[left]]
            hit = held == key[left]
            out[left[hit]] = self.ranks[slot[left[hit]]]
            left = left[~hit & (held != -1)]
        return out


def merge_one(ids: list[int], pairs: dict[tuple[int, int], int]) -> list[int]:
    """Merges one piece's byte ids over its own segment tree."""
    n = len(ids)
    width = 1 << max(1, (n - 1).bit_length())
    none = (len(pairs) + 1 << 40) + width
    tree = [none] * (2 * width)  # rank and position in one number, so that the least is the leftmost of the least ranks
    for i in range(n - 1):
        r = pairs.get((ids[i], ids[i + 1]))
        if r is not None:
            tree[width + i] = r << 32 | i
    for node in range(width - 1, 0, -1):
        tree[node] = min(tree[2 * node], tree[2 * node + 1])
    ids, after, before = list(ids), list(range(1, n + 1)), list(range(-1, n - 1))

    def put(leaf: int, value: int) -> None:
        node = width + leaf
        tree[node] = value
        while node > 1:
            node >>= 1
            least = min(tree[2 * node], tree[2 * node + 1])
            if tree[node] == least:
                return
            tree[node] = least

    def pair(i: int) -> int:
        r = pairs.get((ids[i], ids[after[i]])) if after[i] < n else None
        return none if r is None else r << 32 | i

    while (top := tree[1]) < none:
        at, gone = top & 0xFFFFFFFF, after[top & 0xFFFFFFFF]
        ids[at], after[at] = top >> 32, after[gone]
        if after[gone] < n:
            before[after[gone]] = at
        put(gone, none)
        put(at, pair(at))
        if before[at] >= 0:
            put(before[at], pair(before[at]))
    out, at = [], 0
    while at < n:
        out.append(ids[at])
        at = after[at]
    return out


def merge_lanes(ids: np.ndarray, lengths: np.ndarray, pairs: PairTable) -> tuple[np.ndarray, np.ndarray]:
    """Merges many pieces, one a row of ids (lanes x width, a power of two); each has a segment tree of its own.

    Returned are the pieces' ids one after another, as little-endian 32-bit integers, and their numbers.
    """
    lanes, width = ids.shape
    levels, stride = width.bit_length() - 1, width + 1
    # One column more than the width: what lies behind a piece's end is never live.
    token = np.zeros((lanes, stride), np.int32)
    token[:, :width] = ids
    after = np.tile(np.arange(1, stride + 1, dtype=np.int16), (lanes, 1))
    before = np.tile(np.arange(-1, width, dtype=np.int16), (lanes, 1))
    tree = np.full((lanes, 2 * width), NONE, np.int32)
    place = np.arange(width - 1, dtype=np.int32)
    inside = place < lengths[:, None] - 1
    rank = pairs(token[:, : width - 1][inside], token[:, 1:width][inside])
    tree[:, width : 2 * width - 1][inside] = np.where(rank == NONE, NONE, rank << 8 | np.broadcast_to(place, inside.shape)[inside])
    for level in range(levels - 1, -1, -1):
        lo = 1 << level
        tree[:, lo : 2 * lo] = np.minimum(tree[:, 2 * lo : 4 * lo : 2], tree[:, 2 * lo + 1 : 4 * lo : 2])
    flat, tokens, nexts, befores = tree.reshape(-1), token.reshape(-1), after.reshape(-1), before.reshape(-1)
    active = np.arange(lanes)
    while True:
        top = flat[active * (2 * width) + 1]
        going = top != NONE
        active, top = active[going], top[going]
        if not len(active):
            break
        end, cell, root = lengths[active], active * stride, active * (2 * width)
        at = top & 255
        gone = nexts[cell + at]
        behind = nexts[cell + gone]
        tokens[cell + at] = top >> 8
        nexts[cell + at] = behind
        befores[cell + np.minimum(behind, width)] = at
        prior = befores[cell + at]
        flat[root + width + gone] = NONE
        has = behind < end
        here, next_ = (cell + at)[has], (cell + behind)[has]
        rank = np.full(len(at), NONE, np.int32)
        rank[has] = pairs(tokens[here], tokens[next_])
        flat[root + width + at] = np.where(rank == NONE, NONE, rank << 8 | at)
        has = prior >= 0
        left, here = (cell + prior)[has], (cell + at)[has]
        rank = pairs(tokens[left], tokens[here])
        flat[(root + width + prior)[has]] = np.where(rank == NONE, NONE, rank << 8 | prior[has])
        leaves = np.concatenate((gone, at, np.where(has, prior, at))).astype(np.int64) + width
        roots = np.concatenate((root, root, root))
        for _ in range(levels):  # every path goes up one level at a time, so that both children are settled
            leaves >>= 1
            child = roots + 2 * leaves
            flat[roots + leaves] = np.minimum(flat[child], flat[child + 1])
    # A position is live if the chain from 0 reaches it: what a merge consumed is skipped.
    live = np.zeros((lanes, stride), bool)
    here = np.zeros(lanes, np.int64)
    row = np.arange(lanes)
    while len(row):
        live[row, here] = True
        here = after[row, here].astype(np.int64)
        more = here < lengths[row]
        row, here = row[more], here[more]
    return token[live].astype("<u4"), live.sum(axis=1)


def ranges(at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """at[0] .. at[0] + size[0] - 1, at[1] .. at[1] + size[1] - 1, and so on."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(at - (ends - size), size)


LETTER, NUMBER, SPACE = 1, 2, 3


@cache
def _kinds() -> np.ndarray:
    """Every character's class; 0: none of the three."""
    every = "".join(map(chr, range(0x110000)))
    out = np.zeros(0x110000, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for found in regex.finditer(pattern, every):
            out[found.start() : found.end()] = kind
    return out


def plain_starts(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where the matches of PLAIN start among the code points; first marks those that begin a text.

    Matches are runs of a class. The last character of white space before something else stands alone, or goes
    with what follows if it is a space. An apostrophe that nothing joins takes the ending of a contraction.
    """
    kind = _kinds()[points]
    start = first.copy()
    start[1:] |= kind[1:] != kind[:-1]
    last = np.zeros(len(points) + 1, bool)  # shifted by one: behind the last character of white space, other text follows
    last[1:-1] = (kind[:-1] == SPACE) & start[1:] & ~first[1:]
    joined = last[:-1].copy()
    joined[1:] &= points[:-1] == 32
    start |= last[1:]
    start &= ~joined
    at = np.flatnonzero((points == 39) & start)
    at = at[at + 1 < len(points)]
    at = at[~first[at + 1]]
    if len(at):
        one = points[at + 1]
        beyond = np.minimum(at + 2, len(points) - 1)
        two = np.where((at + 2 < len(points)) & ~first[beyond], points[beyond], 0)
        size = np.where(np.isin(one, list(map(ord, "stmd"))), 1, 0)
        size = np.where(((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l")), 2, size)
        at, size = at[size > 0], size[size > 0]
        start[at + 1] = False
        end = at + 1 + size
        start[end[end < len(points)]] = True
    return start


def cut_long(text: str, limit: int) -> Iterator[str]:
    """Parts of about limit characters, cut where white space follows something else; PLAIN matches nothing across such a place."""
    at = 0
    while len(text) - at > limit:
        found = _CUT.search(text, at + limit)
        if not found:
            break
        yield text[at : found.end()]
        at = found.end()
    yield text[at:] if at else text


_CUT = re.compile(r"\S(?=[ \n])")
_MASK = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def _distinct(low: np.ndarray, high: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((size, high, low))
    low, high, size = low[order], high[order], size[order]
    new = np.append(True, (low[1:] != low[:-1]) | (high[1:] != high[:-1]) | (size[1:] != size[:-1]))
    return low[new], high[new], size[new]


class Pieces:
    """Pieces of SHORT bytes or fewer and their ids, by open addressing; two words hold all of a piece's bytes."""

    def __init__(self, limit: int):
        self.limit = limit
        bits = max(4, (2 * limit).bit_length())
        self.mask, self.shift = (1 << bits) - 1, np.uint64(64 - bits)
        self.words = np.zeros((2, 1 << bits), np.uint64)
        self.value = np.zeros(1 << bits, np.int64)  # place in ids << 16 | number of ids << 8 | size; 0: free
        self.count, self.ids, self.used = 0, np.zeros(1 << 12, "<u4"), 0

    def clear(self) -> None:
        self.value[:] = 0
        self.count = self.used = 0

    def _slot(self, low: np.ndarray, high: np.ndarray, size: np.ndarray) -> np.ndarray:
        mixed = (low ^ high * np.uint64(0xC2B2AE3D27D4EB4F)) + size.astype(np.uint64)
        return ((mixed ^ mixed >> np.uint64(29)) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def find(self, low: np.ndarray, high: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Their values, 0 where a piece is not held."""
        slot = self._slot(low, high, size)
        value = self.value[slot]
        same = (self.words[0][slot] == low) & (self.words[1][slot] == high) & (value & 255 == size)
        left = np.flatnonzero(~same & (value != 0))
        out = np.where(same, value, 0)
        while len(left):
            slot[left] = slot[left] + 1 & self.mask
            at = slot[left]
            value = self.value[at]
            same = (self.words[0][at] == low[left]) & (self.words[1][at] == high[left]) & (value & 255 == size[left])
            out[left[same]] = value[same]
            left = left[~same & (value != 0)]
        return out

    def put(self, low: np.ndarray, high: np.ndarray, size: np.ndarray, ids: np.ndarray, numbers: np.ndarray) -> np.ndarray:
        """Holds distinct pieces, not held so far; their values."""
        at = self.append(ids) + np.cumsum(numbers) - numbers
        value = at << 16 | numbers << 8 | size
        slot, left = self._slot(low, high, size), np.arange(len(size))
        while len(left):
            want = slot[left]
            free = left[self.value[want] == 0]
            self.value[slot[free]] = value[free]  # of those that want a slot one gets it
            got = free[self.value[slot[free]] == value[free]]
            self.words[0][slot[got]], self.words[1][slot[got]] = low[got], high[got]
            lost = np.ones(len(size), bool)
            lost[got] = False
            left = left[lost[left]]
            slot[left] = slot[left] + 1 & self.mask
        self.count += len(size)
        return value

    def append(self, ids: np.ndarray) -> int:
        if self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate((self.ids[: self.used], np.zeros(max(len(ids), self.used), "<u4")))
        at = self.used
        self.ids[at : at + len(ids)] = ids
        self.used += len(ids)
        return at


class Encoder:
    """Encodes as merge ranks say, each match of the pattern by itself, and decodes. No special tokens."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, remembered: int = REMEMBERED):
        self.ranks, self.pairs = ranks, PairTable(ranks)
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.decoded_size = np.fromiter(map(len, self.bytes_of), np.int64, len(self.bytes_of))
        self.decoded_at = np.cumsum(self.decoded_size) - self.decoded_size
        self.decoded = np.frombuffer(b"".join(self.bytes_of), np.uint8)
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.regex = None if pattern == PLAIN else regex.compile(pattern)
        self.remembered, self.known = remembered, Pieces(remembered + len(ranks))
        self._start_afresh()

    def _start_afresh(self, more: int = 0) -> None:
        """A piece that is a token is that token, whatever the merges would make of it: tokens are held from the start."""
        limit = max(self.remembered, more) + len(self.ranks)
        if self.known.limit == limit:
            self.known.clear()
        else:
            self.known = Pieces(limit)
        tokens = [t for t in self.ranks if 0 < len(t) <= SHORT]
        raw = np.frombuffer(b"".join(t.ljust(SHORT, b"\0") for t in tokens), "<u8").reshape(-1, 2)
        size = np.fromiter(map(len, tokens), np.int64, len(tokens))
        self.known.put(raw[:, 0].copy(), raw[:, 1].copy(), size, np.array([self.ranks[t] for t in tokens], "<u4"), np.ones(len(tokens), np.int64))

    def starts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The texts' UTF-8 bytes one after another, the bounds of their pieces in it and each text's number of pieces."""
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        whole = "".join(texts)
        raw = np.frombuffer(whole.encode("utf-8", "surrogatepass"), np.uint8)
        points = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), "<u4")
        ends = np.cumsum(size)
        first = np.zeros(len(points) + 1, bool)
        first[ends - size] = True
        if self.regex is None:
            start = plain_starts(points, first[:-1])
        else:  # what the pattern does not match is no piece of its own and must not be lost: it is an error
            start = np.zeros(len(points), bool)
            for text, at in zip(texts, (ends - size).tolist(), strict=True):
                reach = 0
                for found in self.regex.finditer(text):
                    if found.start() != reach:
                        raise ValueError("the pattern must match all of a text")
                    start[at + reach] = True
                    reach = found.end()
                if reach != len(text):
                    raise ValueError("the pattern must match all of a text")
        at = np.flatnonzero(start)
        before = np.concatenate(([0], np.cumsum(start)))
        pieces = before[ends] - before[ends - size]
        if len(raw) > len(points):
            width = np.uint8(1) + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)
            at = (np.cumsum(width, dtype=np.int64) - width)[at]
        return raw, np.append(at, len(raw)), pieces

    def merge(self, raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Long pieces' ids one after another, and their numbers."""
        out: list[np.ndarray] = [np.zeros(0, "<u4")] * len(raws)
        by_width: dict[int, list[int]] = {}
        for i, raw in enumerate(raws):
            if raw in self.ranks:
                out[i] = np.array([self.ranks[raw]], "<u4")
            elif len(raw) > LANE:
                out[i] = np.array(merge_one(self.single[np.frombuffer(raw, np.uint8)].tolist(), self.pairs.by_pair), "<u4")
            else:
                by_width.setdefault(1 << (len(raw) - 1).bit_length(), []).append(i)
        for width, members in by_width.items():
            step = max(1, 1_000_000 // width)
            for at in range(0, len(members), step):
                part = members[at : at + step]
                padded = np.frombuffer(b"".join([raws[i].ljust(width, b"\0") for i in part]), np.uint8).reshape(-1, width)
                ids, numbers = merge_lanes(self.single[padded], np.array([len(raws[i]) for i in part]), self.pairs)
                for i, own in zip(part, np.split(ids, np.cumsum(numbers)[:-1]), strict=True):
                    out[i] = own
        return np.concatenate(out) if out else np.zeros(0, "<u4"), np.fromiter(map(len, out), np.int64, len(out))

    def _learn(self, low: np.ndarray, high: np.ndarray, size: np.ndarray) -> None:
        """Merges distinct short pieces and holds them."""
        width = 2
        while width <= SHORT:
            held = np.flatnonzero((size <= width) & (size > (width // 2 if width > 2 else 0)))
            for at in range(0, len(held), 50_000):
                part = held[at : at + 50_000]
                raw = np.column_stack((low[part], high[part])).astype("<u8").view(np.uint8)[:, :width]
                ids, numbers = merge_lanes(self.single[raw], size[part], self.pairs)
                self.known.put(low[part], high[part], size[part], ids, numbers)
            width *= 2

    def _encode(self, texts: list[str]) -> list[bytes]:
        raw, bounds, pieces = self.starts(texts)
        at, size = bounds[:-1], np.diff(bounds)
        padded = np.concatenate((raw, np.zeros(2 * SHORT, np.uint8)))
        words = np.ndarray((len(raw) + SHORT + 8,), "<u8", padded, strides=(1,))  # the eight bytes from each place on
        low, high = words[at] & _MASK[np.minimum(size, 8)], np.zeros(len(at), np.uint64)
        wide = np.flatnonzero(size > 8)
        high[wide] = words[at[wide] + 8] & _MASK[np.minimum(size[wide] - 8, 8)]
        short = size <= SHORT
        sought = np.where(short, size, 0)
        value = self.known.find(low, high, sought)
        new = np.flatnonzero(short & (value == 0))
        if len(new):
            fresh = _distinct(low[new], high[new], size[new])
            if self.known.count + len(fresh[2]) > self.known.limit:
                self._start_afresh()
                value = self.known.find(low, high, sought)
                new = np.flatnonzero(short & (value == 0))
                fresh = _distinct(low[new], high[new], size[new])
                if self.known.count + len(fresh[2]) > self.known.limit:  # one text that could not be cut
                    self._start_afresh(len(fresh[2]))
                    value = self.known.find(low, high, sought)
            self._learn(*fresh)
            value[new] = self.known.find(low[new], high[new], size[new])
        place, numbers = value >> 16, value >> 8 & 255
        mark = self.known.used
        long = np.flatnonzero(~short)
        if len(long):
            names = [raw[s:e].tobytes() for s, e in zip(at[long].tolist(), bounds[long + 1].tolist(), strict=True)]
            every = list(dict.fromkeys(names))
            ids, counts = self.merge(every)
            start = self.known.append(ids) + np.cumsum(counts) - counts
            number = {name: i for i, name in enumerate(every)}
            which = np.fromiter(map(number.__getitem__, names), np.int64, len(names))
            place[long], numbers[long] = start[which], counts[which]
        ids = self.known.ids[ranges(place, numbers)]
        self.known.used = mark
        reach = np.append(0, np.cumsum(numbers))[np.append(0, np.cumsum(pieces))].tolist()
        return [ids[a:b].tobytes() for a, b in zip(reach, reach[1:], strict=False)]

    def encode_many(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """Each text's ids as little-endian 32-bit integers; null reads as empty."""
        held: list[tuple[str, bool]] = []
        parts: list[bytes] = []
        total = 0

        def done() -> Iterator[bytes]:
            for (_, ends), ids in zip(held, self._encode([part for part, _ in held]), strict=True):
                parts.append(ids)
                if ends:
                    yield b"".join(parts)
                    parts.clear()
            held.clear()

        for text in texts:
            reach = 0
            for part in cut_long(text or "", CHUNK) if self.regex is None else [text or ""]:
                reach += len(part)
                total += len(part)
                held.append((part, reach == len(text or "")))
                if total >= CHUNK:
                    yield from done()
                    total = 0
        yield from done()

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(next(iter(self.encode_many([text]))), "<u4").tolist()

    def decode(self, ids: bytes | Iterable[int]) -> bytes:
        every = np.frombuffer(ids, "<u4") if isinstance(ids, bytes) else np.fromiter(ids, np.int64)
        parts = (every[at : at + CHUNK] for at in range(0, len(every), CHUNK))
        return b"".join(self.decoded[ranges(self.decoded_at[x], self.decoded_size[x])].tobytes() for x in parts)


@cache
def encoder(path: str, pattern: str) -> Encoder:
    """A worker's encoder for a vocabulary file, which every executor has at the same place."""
    return Encoder(load_ranks(path), pattern)


def default_vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: tuple[str, str] | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids): one row per row of docs; ids are little-endian unsigned 32-bit integers. Null and empty texts have none."""
    path, pattern = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = encoder(path, pattern)
        for batch in slices(batches):
            ids = list(known.encode_many(batch.column(1).to_pylist()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "n_tokens", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, n_tokens long, ids binary")


def decode(encoded: DataFrame, vocabulary: tuple[str, str] | None = None) -> DataFrame:
    """(doc_id, decoded binary) of encode()'s rows. Null ids decode to nothing."""
    path, pattern = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = encoder(path, pattern)
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([known.decode(x or b"") for x in batch.column(1).to_pylist()], pa.binary())], names=["doc_id", "decoded"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, decoded binary")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: tuple[str, str] | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): one row per row of docs; each text is encoded, and its ids decoded again.

    Null and empty texts have no ids; repeated rows each get a row, null ids stay; no row gives no row. Other columns are not read.
    """
    path, pattern = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = encoder(path, pattern)
        for batch in slices(batches):
            counts, of_ids, of_text = [], [], []
            for ids in known.encode_many(batch.column(1).to_pylist()):
                counts.append(len(ids) // 4)
                of_ids.append(hashlib.sha256(ids).hexdigest())
                of_text.append(hashlib.sha256(known.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
