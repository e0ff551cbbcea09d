"""Suffix-array deduplication over bytes.

Suffix arrays are built by induced sorting: suffixes are classed as smaller (S) or larger (L) than their right
neighbour, leftmost S substrings are sorted by a first induction and named, their order comes from the same
procedure on the names, and a second induction places all suffixes. Common prefixes are computed in text
order: where the preceding bytes of a suffix and its neighbour agree, a prefix is one shorter than the one
before, and only the others are compared.

A shard is a lane: many shards' texts lie one after another and are sorted in the same numpy operations, a
symbol at a time for all lanes together. The number of operations follows the largest lane's alphabet; the
work follows the bytes.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from flatsql.llm.repeats import RepeatFinder, runs

LENGTH = 400


def _ranges(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """lo[0] .. hi[0]-1, lo[1] .. hi[1]-1, and so on."""
    size = hi - lo
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(lo - (ends - size), size)


class _Text:
    """Lanes of symbols. Each lane's symbols are 0 .. k-1, all of them in use, and its last symbol is its only 0."""

    def __init__(self, symbols: np.ndarray, lane: np.ndarray):
        n = len(symbols)
        self.symbols, self.lane = symbols, lane
        last = np.append(lane[1:] != lane[:-1], True)
        self.first = np.append(True, last[:-1])
        self.kinds = np.maximum.reduceat(symbols, np.flatnonzero(self.first)) + 1
        self.base = np.cumsum(self.kinds) - self.kinds
        self.bucket = self.base[lane] + symbols
        count = np.bincount(self.bucket, minlength=int(self.kinds.sum()))
        self.end = np.cumsum(count)
        self.start = self.end - count
        # S if the next different symbol is larger; the last symbol of a lane is S.
        change = np.append(symbols[1:] != symbols[:-1], True) | last
        at = np.minimum.accumulate(np.where(change, np.arange(n), n)[::-1])[::-1]
        follows = np.append(symbols[1:], 0)
        self.smaller = last[at] | (follows[at] > symbols[at])
        self.leftmost = self.smaller & ~np.append(False, self.smaller[:-1]) & ~self.first
        self.last = last

    def induce(self, leftmost: np.ndarray) -> np.ndarray:
        """The suffixes' order that follows from that of the leftmost smaller ones, given lane by lane."""
        order = np.full(len(self.symbols), -1, np.int64)
        given = np.bincount(self.bucket[leftmost], minlength=len(self.end))
        by = np.argsort(self.bucket[leftmost], kind="stable")
        lead = self.end - given
        order[_ranges(lead[given > 0], self.end[given > 0])] = leftmost[by]
        heads = self.start.copy()

        def put(found: np.ndarray, larger: bool, edge: np.ndarray) -> None:
            """Places the left neighbours of the suffixes found, in their order, at their buckets' edges."""
            before = found[~self.first[found]] - 1
            before = before[self.smaller[before] != larger]
            if not len(before):
                return
            bucket = self.bucket[before]
            by = np.argsort(bucket, kind="stable")
            bucket, before = bucket[by], before[by]
            starts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
            size = np.diff(np.append(starts, len(bucket)))
            rank = np.arange(len(bucket)) - np.repeat(starts, size)
            if larger:
                order[edge[bucket] + rank] = before
                edge[bucket[starts]] += size
            else:
                order[edge[bucket] - 1 - rank] = before
                edge[bucket[starts]] -= size

        # Lanes by falling size of alphabet: those that have symbol r come first.
        lanes = np.argsort(-self.kinds, kind="stable")
        bases, kinds = self.base[lanes], -self.kinds[lanes]
        rounds = -int(kinds[0])
        for r in range(rounds):
            bucket = bases[: np.searchsorted(kinds, -r)] + r
            done = self.start[bucket]
            while True:
                upto = heads[bucket]
                grown = upto > done
                if not grown.any():
                    break
                found = order[_ranges(done[grown], upto[grown])]
                done = upto
                put(found, True, heads)
            some = given[bucket] > 0
            if some.any():
                put(order[_ranges(lead[bucket[some]], self.end[bucket[some]])], True, heads)
        tails = self.end.copy()
        for r in range(rounds - 1, -1, -1):
            bucket = bases[: np.searchsorted(kinds, -r)] + r
            done = self.end[bucket]
            if r == 0:  # the lanes' last symbols, which nothing induces
                order[self.start[bucket]] = np.flatnonzero(self.last)[lanes[: len(bucket)]]
                tails[bucket] -= 1
            while True:
                downto = tails[bucket]
                grown = downto < done
                if not grown.any():
                    break
                found = order[_ranges(downto[grown], done[grown])][::-1]
                done = downto
                put(found, False, tails)
            some = heads[bucket] > self.start[bucket]
            if some.any():
                put(order[_ranges(self.start[bucket[some]], heads[bucket[some]])][::-1], False, tails)
        return order


def suffix_arrays(symbols: np.ndarray, lane: np.ndarray) -> np.ndarray:
    """The positions of all lanes' suffixes, lane by lane in ascending order.

    Each lane's symbols are 0 .. k-1, all in use; its last symbol is its only 0.
    """
    text = _Text(symbols, lane)
    leftmost = np.flatnonzero(text.leftmost | (text.last & text.first))
    ordered = text.induce(leftmost)
    ordered = ordered[(text.leftmost | (text.last & text.first))[ordered]]
    # Substrings from one leftmost suffix to the next; equal ones get equal names.
    reach = np.full(len(symbols), 0)
    reach[leftmost] = np.where(text.last[leftmost], 0, np.append(leftmost[1:], 0) - leftmost)
    a, b = ordered[:-1], ordered[1:]
    same = (lane[a] == lane[b]) & (reach[a] == reach[b]) & ~text.last[a]
    check = np.flatnonzero(same)
    offset = 0
    while len(check):
        equal = symbols[a[check] + offset] == symbols[b[check] + offset]
        same[check[~equal]] = False
        check = check[equal]
        check = check[reach[a[check]] > offset]
        offset += 1
    name = np.cumsum(np.append(0, ~same))
    starts = np.flatnonzero(np.append(True, lane[b] != lane[a]))
    lane_of = lane[ordered]
    name -= np.repeat(name[starts], np.diff(np.append(starts, len(name))))
    if same.any():
        names = np.zeros(len(symbols), np.int64)
        names[ordered] = name
        ordered = leftmost[suffix_arrays(names[leftmost], lane[leftmost])]
    del lane_of
    return text.induce(ordered)


def common_prefixes(symbols: np.ndarray, lane: np.ndarray, order: np.ndarray) -> np.ndarray:
    """By text position: how many symbols a suffix shares with its predecessor in the order of its lane."""
    n = len(symbols)
    before = np.full(n, -1, np.int64)
    same_lane = lane[order[1:]] == lane[order[:-1]]
    before[order[1:][same_lane]] = order[:-1][same_lane]
    first = np.append(True, lane[1:] != lane[:-1])
    place = np.arange(n)
    left = np.where((place > 0) & (before > 0), symbols[place - 1] == symbols[np.maximum(before, 1) - 1], False)
    reducible = left & ~first & (before >= 0) & ~first[np.maximum(before, 0)]
    wide = np.append(symbols, np.zeros(4, symbols.dtype)).astype(np.uint64)
    word = wide[:n] | wide[1 : n + 1] << np.uint64(16) | wide[2 : n + 2] << np.uint64(32) | wide[3 : n + 3] << np.uint64(48)
    shared = np.zeros(n, np.int64)
    check = np.flatnonzero(~reducible & (before >= 0))
    at, to = check, before[check]
    while len(check):
        differ = word[at] ^ word[to]
        low = differ & (~differ + np.uint64(1))
        step = np.where(differ == 0, 4, np.where(low < np.uint64(1 << 16), 0, np.where(low < np.uint64(1 << 32), 1, np.where(low < np.uint64(1 << 48), 2, 3))))
        shared[check] += step
        more = differ == 0
        check, at, to = check[more], at[more] + 4, to[more] + 4
    # A reducible prefix is one shorter than its left neighbour's.
    source = np.maximum.accumulate(np.where(reducible, 0, place))
    return np.where(reducible, shared[source] - (place - source), shared)


def repeated_starts(shards: list[list[bytes]], length: int) -> list[list[np.ndarray]]:
    """For each text of each shard the starts of those strings of `length` bytes that start elsewhere in the shard, too."""
    raw, lanes, places = [], [], []
    at = 0
    for number, texts in enumerate(shards):
        where = []
        for text in texts:
            where.append((at, len(text)))
            raw.append(np.frombuffer(text, np.uint8).astype(np.int64) + 2)
            raw.append(np.ones(1, np.int64))
            at += len(text) + 1
        raw.append(np.zeros(1, np.int64))
        at += 1
        places.append(where)
        lanes.append(np.full(at - sum(map(len, lanes)), number))
    if not at:
        return [[] for _ in shards]
    coded, lane = np.concatenate(raw), np.concatenate(lanes)
    # Each lane's symbols as ranks among those in use there.
    keys, rank = np.unique(lane * 258 + coded, return_inverse=True)
    base = np.searchsorted(keys, np.arange(len(shards)) * 258)
    order = suffix_arrays(rank - base[lane], lane)
    shared = common_prefixes(coded, lane, order)
    long = shared >= length
    by_order = long[order]
    repeated = np.zeros(at, bool)
    repeated[order] = by_order | np.append(by_order[1:], False)
    return [[np.flatnonzero(repeated[s : s + max(0, n - length + 1)]) for s, n in where] for where in places]


class ByteRepeats(RepeatFinder):
    """Texts as UTF-8 bytes."""

    name, k, most, ranges = "suffixarray", 128, 48, (70, 18, 5, 1)
    batch_bytes = 1 << 19  # sorting takes some 150 bytes of memory for each

    def __init__(self, length: int = LENGTH, k: int = 128, most: int = 48):
        if length < k:
            raise ValueError("a window must hold an anchor")
        self.length, self.k, self.most = length, k, most
        self.codes = np.random.default_rng(9).integers(0, 1 << 64, 256, dtype=np.uint64)

    def split(self, text: str | None) -> bytes:
        return (text or "").encode("utf-8", "surrogatepass")

    def hashes(self, units: bytes) -> np.ndarray:
        return self.codes[np.frombuffer(units, np.uint8)]

    def join(self, units: bytes) -> bytes:
        return units

    parts = join

    def concat(self, parts: list[bytes]) -> bytes:
        return b"".join(parts)

    def digest(self, units: bytes, hashes: np.ndarray, a: int, b: int) -> int:
        import xxhash

        return xxhash.xxh3_64_intdigest(units[a:b])

    def search(self, shards: list[list[tuple[int, bytes]]]) -> list[list[list[tuple[int, int]]]]:
        # A passage of several places goes in twice, which is enough to repeat all of it.
        texts = [[content for _, content in passages] + [content for places, content in passages if places > 1] for passages in shards]
        return [[runs(starts, self.length) for starts in found[: len(passages)]] for passages, found in zip(shards, repeated_starts(texts, self.length), strict=True)]


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, digest: bool = False) -> DataFrame:
    """(doc_id, n, spans, kept): see RepeatFinder.find; units are the UTF-8 bytes of the text."""
    return ByteRepeats(length).find(docs, id_col, text_col, digest)
