"""SimHash near-duplicates: 64-bit fingerprints of word shingles, linked at a few differing bits.

Pigeonhole blocks: a fingerprint is cut into 6 blocks. Two fingerprints that differ in 3 bits or fewer agree
on at least 3 blocks, so they meet under one of the C(6, 3) = 20 choices of 3 blocks; a key is 32 or so bits.
Distinct fingerprints only are keyed (copies collapse first). A key that two share is settled by the
aggregate itself; larger buckets go, as arrays of bounded length, to a search that returns a spanning
forest and not all pairs. A bucket over BUCKET is keyed again on 4-bit blocks of its free bits: then at
most 12 bits are free and a bucket holds 4096 fingerprints at most, so no bucket is ever cut short.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache
from itertools import combinations, pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flatsql.llm.common import Scratch, batched, rows_of, slices
from flatsql.llm.components import connected_components

BITS = 64
BLOCKS = 6
BUCKET = 8192
SEED = 42
#: Bits of wide fingerprints, at how many differing bits they link, and the chance of missing a pair whose bits differ with a chance of DIFFER.
WIDE, WIDE_DISTANCE, MISS, DIFFER = 512, 135, 3e-5, 0.1875
#: Bits of a key at least, fingerprints of a bucket about (where keys have more bits), and those of a larger bucket that is dealt out.
WIDE_BITS, PER_BUCKET, WIDE_BUCKET = 6, 1 << 18, 1 << 20
#: Within a bucket: fingerprints under an inner key about, those that are compared without such keys, bits of an inner key
#: at most, and how many pairs that differ in DIFFER of the bits share an inner key at least.
INNER, WHOLE, INNER_BITS, INNER_FOUND = 32, 512, 15, 0.96
#: Keys in the shuffle at a time; the first are few, for what they join is not linked again.
FIRST, ROUND = 4, 16


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Unsigned 64-bit SimHash of the text's word shingles, A-Z lower-cased; 0 for a text without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    whole = b" ".join(words)
    if len(words) <= shingle:
        hashes = [digest(whole, SEED)]
    else:
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lengths + 1) - 1
        starts = ends - lengths
        hashes = [digest(whole[s:e], SEED) for s, e in zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)]
    counts = np.zeros(BITS, np.int64)
    raw = np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8)
    for at in range(0, len(raw), 255):  # 255 ones still fit a byte
        counts += np.unpackbits(raw[at : at + 255], axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    return int(np.packbits(2 * counts > len(raw), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(doc_id, fp long): one row per row of docs; the long holds the unsigned fingerprint's bits. A null text has no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            prints = np.array([fingerprint(x, shingle) for x in batch.column(1).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints)], names=["doc_id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, fp long")


def block_masks(blocks: int = BLOCKS, distance: int = 3, bits: tuple[int, ...] = tuple(range(BITS))) -> list[int]:
    """Signed 64-bit masks: each keeps all but `distance` of the blocks that the given bits are cut into."""
    parts = [sum(1 << int(b) for b in part) for part in np.array_split(np.array(bits), blocks)]
    masks = [sum(x) for x in combinations(parts, blocks - distance)]
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in masks]


def _near(distance: int) -> Column:
    return F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance


def forest(prints: np.ndarray, distance: int) -> Iterator[tuple[int, int]]:
    """Links of a spanning forest of the graph that joins fingerprints (int64) at `distance` bits or fewer."""
    left = np.unique(prints).view(np.uint64)  # the bits of a negative number are not those of its absolute value
    while len(left):
        root, left = left[0], left[1:]
        queue = [root]
        while queue and len(left):
            at = queue.pop()
            near = np.bitwise_count(left ^ at) <= distance
            if near.any():
                found, left = left[near], left[~near]
                queue.extend(found)
                yield from ((int(at.view(np.int64)), int(x)) for x in found.view(np.int64))


def links(prints: DataFrame, scratch: Scratch, distance: int = 3, bucket: int = BUCKET) -> DataFrame:
    """prints(fp long, distinct) -> (a, b): links at 1 to `distance` bits that connect just what all such links connect."""
    if not 0 < distance < BLOCKS:
        raise ValueError(f"distance must be from 1 to {BLOCKS - 1}")
    masks = block_masks(BLOCKS, distance)
    keyed = prints.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks])).alias("choice", "key"))
    buckets = scratch.write(keyed.groupBy("choice", "key").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).where("n > 1"), "buckets")
    pairs = buckets.where("n = 2").where(_near(distance)).select("a", "b")
    large = keyed.join(buckets.where("n > 2").select("choice", "key", "n"), ["choice", "key"])
    large = scratch.write(large, "large")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = (pair for (held,) in rows_of(batches, "held") for pair in forest(np.array(held, dtype=np.int64), distance))
        yield from batched(found, pa.schema([("a", pa.int64()), ("b", pa.int64())]))

    some = large.where(F.col("n") <= bucket).groupBy("choice", "key").agg(F.collect_list("fp").alias("held"))
    finer = [(choice, part, m) for choice, mask in enumerate(masks) for part, m in enumerate(_finer(mask, distance))]
    finer = F.broadcast(prints.sparkSession.createDataFrame(finer, "choice int, part int, mask long"))  # 1,120 rows for 3 bits
    many = large.where(F.col("n") > bucket).join(finer, "choice").withColumn("sub", F.col("fp").bitwiseAND(F.col("mask")))
    many = many.groupBy("choice", "key", "part", "sub").agg(F.collect_list("fp").alias("held")).where(F.size("held") > 1)
    return pairs.union(some.select("held").union(many.select("held")).mapInArrow(search, "a long, b long"))


def _finer(mask: int, distance: int) -> list[int]:
    """Masks over the bits that `mask` leaves free, each freeing `distance` blocks of 4 bits or fewer."""
    free = tuple(b for b in range(BITS) if not mask >> b & 1)
    return block_masks(max(distance + 1, -(-len(free) // 4)), distance, free)


def wide_fingerprint(hashes: np.ndarray) -> np.ndarray:
    """WIDE bits, a byte each: 1 if set in over half the words that each of the hashes (uint64) is drawn out to; no hashes: 0."""
    counts = np.zeros(WIDE, np.int64)
    drawn = np.arange(1, WIDE // 64 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for at in range(0, len(hashes), 255):  # 255 ones still fit a byte
        h = hashes[at : at + 255, None] + drawn
        h = (h ^ h >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ h >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(31)
        counts += np.unpackbits(h.astype("<u8").view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    return (2 * counts > len(hashes)).astype(np.uint8)


def _choose(n: int, k: int) -> float:
    return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)


def _shared(apart: int, bits: int, wide: int = WIDE) -> float:
    """The chance that a choice of so many bits holds none of those in which two fingerprints differ."""
    return math.exp(_choose(wide - apart, bits) - _choose(wide, bits))


@cache
def _inner_keys(bits: int) -> int:
    """How many inner keys of so many bits INNER_FOUND asks for."""
    keys = 1
    while 1 - (1 - _shared(round(DIFFER * WIDE), bits)) ** keys < INNER_FOUND:
        keys += 1
    return keys


def inner_plan(members: int) -> tuple[int, int]:
    """Bits and number of a bucket's inner keys."""
    bits = 0 if members <= WHOLE else min(INNER_BITS, round(math.log2(members / INNER)))
    return bits, _inner_keys(bits)


@cache
def _inner_found(apart: int) -> float:
    """The chance to be compared within a bucket, of whatever size it is."""
    return min(1 - (1 - _shared(apart, bits)) ** _inner_keys(bits) for bits in range(INNER_BITS + 1))


@cache
def missed(bits: int, keys: int, differ: float = DIFFER, wide: int = WIDE, distance: int = WIDE_DISTANCE) -> float:
    """The chance that two fingerprints lie over `distance` or are compared under none of so many keys, each a choice of so many bits."""
    total = 0.0
    for d in range(wide + 1):
        chance = math.exp(_choose(wide, d) + d * math.log(differ) + (wide - d) * math.log(1 - differ))
        total += chance * ((1 - _shared(d, bits, wide) * _inner_found(d)) ** keys if d <= distance else 1)
    return total


def plan(rows: int) -> tuple[int, int]:
    """Bits of a key and number of keys for a table of so many rows: the same for all up to some 20 million."""
    bits = max(WIDE_BITS, min(22, round(math.log2(max(rows, 1) / PER_BUCKET))))
    keys = 1
    while missed(bits, keys) > MISS:
        keys += 1
    return bits, keys


@cache
def _choices(bits: int, keys: int) -> np.ndarray:
    return np.stack([np.random.default_rng((SEED, n)).permutation(WIDE)[:bits] for n in range(keys)])


def wide_keys(prints: np.ndarray, bits: int, keys: int) -> np.ndarray:
    """For each row of prints (a byte a bit) its int64 keys: the chosen bits, below the number of the choice."""
    values = np.arange(keys, dtype=np.int64) << bits
    for n, chosen in enumerate(_choices(bits, keys).T):
        values = values + (prints[:, chosen].astype(np.int64) << n)
    return values


def near_matrix(prints: np.ndarray, distance: int) -> np.ndarray:
    """Which rows of prints (uint64 words) lie within `distance` of which."""
    apart = np.zeros((len(prints),) * 2, np.uint16)
    for word in prints.T:
        apart += np.bitwise_count(word[:, None] ^ word)
    return apart <= distance


def _spanning(prints: np.ndarray, label: np.ndarray, distance: int) -> Iterator[tuple[int, int]]:
    """Pairs of rows, one fewer than the labels that they join, which join the labels that all pairs within `distance` join."""
    left = np.arange(len(prints))
    while len(left):
        own = label[left] == label[left[0]]
        queue, left = left[own].tolist(), left[~own]
        while queue and len(left):
            at = queue.pop()
            near = np.bitwise_count(prints[left] ^ prints[at]).sum(axis=1, dtype=np.uint16) <= distance
            if near.any():
                met, where = np.unique(label[left[near]], return_index=True)
                yield from ((at, to) for to in left[near][where].tolist())
                joined = np.isin(label[left], met)
                queue.extend(left[joined].tolist())
                left = left[~joined]


def _within(words: np.ndarray, k: int, distance: int) -> np.ndarray:
    """Which columns lie within `distance` of the column k further on, by the first 5 of 8 words; few others do by these."""
    parts = [np.bitwise_count(row[:-k] ^ row[k:]) for row in words[:5]]  # three counts fit a byte
    return np.flatnonzero(np.add(parts[0] + parts[1] + parts[2], sum(parts[3:]), dtype=np.uint16) <= distance)


def wide_forest(prints: np.ndarray, distance: int, groups: np.ndarray | None = None, seed: int = 0) -> Iterator[tuple[int, int]]:
    """Pairs of rows, one fewer than the groups that they join at most; without groups each row is its own.

    The pairs join what all pairs of rows within `distance` join; of over WHOLE rows, all such pairs that share an inner key.
    """
    group = np.arange(len(prints)) if groups is None else np.unique(groups, return_inverse=True)[1]
    parent = np.arange(group.max(initial=-1) + 1)
    left = len(parent)

    def named(rows: np.ndarray) -> np.ndarray:
        at = group[rows]
        while ((up := parent[at]) != at).any():
            at = up
        return at

    def top(at: int) -> int:
        while parent[at] != at:
            parent[at] = at = parent[parent[at]]
        return at

    def joined(pairs: Iterator[tuple[int, int]]) -> Iterator[tuple[int, int]]:
        nonlocal left
        for a, b in pairs:
            x, y = top(group[a]), top(group[b])
            if x != y:
                parent[max(x, y)] = min(x, y)
                left -= 1
                yield a, b

    def together(rows: np.ndarray) -> Iterator[tuple[int, int]]:
        label = named(rows)
        if len(rows) <= WHOLE:
            near = near_matrix(prints[rows], distance) & (label[:, None] < label)
            found = np.count_nonzero(near)
            if found <= len(rows):
                yield from joined(zip(*(rows[x].tolist() for x in np.nonzero(near)), strict=True)) if found else ()
                return
        if (label != label[0]).any():
            yield from joined((int(rows[a]), int(rows[b])) for a, b in _spanning(prints[rows], label, distance))

    bits, keys = inner_plan(len(prints))
    if not bits:
        if left > 1:
            yield from together(np.arange(len(prints)))
        return
    random = np.random.default_rng((SEED, seed))
    for _ in range(keys):
        if left < 2:
            return
        value = np.zeros(len(prints), np.int32)
        for n, bit in enumerate(random.permutation(WIDE)[:bits].tolist()):
            value |= (prints[:, bit >> 6] >> np.uint64(bit & 63) & np.uint64(1)).astype(np.int32) << n
        order = np.argsort(value, kind="stable")
        value = value[order]
        bounds = np.append(0, np.flatnonzero(np.diff(value)) + 1)
        sizes = np.diff(np.append(bounds, len(value)))
        for lo, size in zip(bounds[sizes > WHOLE].tolist(), sizes[sizes > WHOLE].tolist(), strict=True):
            yield from together(order[lo : lo + size])
        sizes = np.repeat(np.where(sizes > WHOLE, 0, sizes), sizes)
        by_size = np.argsort(-sizes, kind="stable")  # so that those under keys of more than k come first
        order, value, sizes = order[by_size], value[by_size], sizes[by_size]
        words, label = np.ascontiguousarray(prints[order].T), named(order)
        ends = np.searchsorted(-sizes, -np.arange(sizes.max()), "left")
        for k in range(1, len(ends)):  # each row and the one k further on under its key
            near = _within(words[:, : ends[k]], k, distance)
            near = near[(value[near] == value[near + k]) & (label[near] != label[near + k])]
            near = near[np.bitwise_count(words[:, near] ^ words[:, near + k]).sum(axis=0, dtype=np.uint16) <= distance]
            if len(near):
                yield from joined(zip(order[near].tolist(), order[near + k].tolist(), strict=True))
                label = named(order)


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Bucket, nodes, roots and fingerprints of each bucket of (bucket, node, root, print) in order of buckets."""
    held: list[tuple] = []
    last = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        bucket, node, root = (batch.column(n).to_numpy() for n in range(3))
        words = np.frombuffer(b"".join(batch.column(3).to_pylist()), "<u8").reshape(len(node), -1)
        for lo, hi in pairwise([0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(bucket)]):
            if held and bucket[lo] != last:
                yield last, *(np.concatenate(x) for x in zip(*held, strict=True))
                held = []
            last = int(bucket[lo])
            held.append((node[lo:hi], root[lo:hi], words[lo:hi]))
    if held:
        yield last, *(np.concatenate(x) for x in zip(*held, strict=True))


def wide_links(prints: DataFrame, scratch: Scratch, distance: int = WIDE_DISTANCE, bucket: int = WIDE_BUCKET) -> tuple[list[DataFrame], DataFrame]:
    """prints(node long, keys array<long>, print binary, distinct) -> links (a, b), and the members of buckets of over `bucket`.

    The links connect just what all links within `distance` do that share a key in other buckets (in those of over WHOLE
    fingerprints also an inner key). A bucket gives one link fewer than it joins groups, and what the first keys join is
    one group to the others, so that links are few however many members of a group meet under however many keys. The
    members (node, bucket, print) are left to a search that deals a bucket out.
    """
    large = prints.select(F.explode("keys").alias("bucket")).groupBy("bucket").count().where(F.col("count") > bucket).select("bucket")
    large = scratch.write(large, "oversize")
    none = large.isEmpty()

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = ((int(nodes[a]), int(nodes[b])) for seed, nodes, roots, words in _buckets(batches) if len(nodes) > 1 for a, b in wide_forest(words, distance, roots, seed))
        yield from batched(found, pa.schema([("a", pa.int64()), ("b", pa.int64())]))

    most = prints.agg(F.max(F.size("keys"))).first()[0] or 0
    named, links, at = prints.withColumn("root", F.col("node")), [], 0
    while at < most:
        size = ROUND if at else FIRST
        keyed = named.select(F.explode(F.slice("keys", at + 1, size)).alias("bucket"), "node", "root", "print")
        keyed = keyed if none else keyed.join(large.hint("merge"), "bucket", "left_anti")
        links.append(scratch.write(keyed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(search, "a long, b long"), f"links{at}"))
        if not at:
            roots = connected_components(links[0], scratch, "first-cc")
            named = scratch.write(prints.join(roots.hint("merge"), "node", "left").select("node", F.coalesce("root", "node").alias("root"), "keys", "print"), "first-named")
        at += size
    rest = prints.select("node", "print", F.explode("keys").alias("bucket")).join(large.hint("merge"), "bucket")
    return links, rest if not none else rest.limit(0)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, distance: int = 3, bucket: int = BUCKET) -> DataFrame:
    """(doc_id, fingerprint, component_id, fp): one row per row of docs.

    fingerprint is 16 hex digits; component_id the smallest doc_id that links at `distance` bits or fewer reach,
    the row's own included. Null and empty texts have fingerprint zero and link like any other. Rows that repeat
    a doc_id each get a row. A null doc_id never is a component_id unless its component has no other id.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    prints = scratch.write(fingerprints(docs, id_col, text_col, shingle), "prints")
    least = scratch.write(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "least")
    found = scratch.write(links(least.select("fp"), scratch, distance, bucket), "links")
    roots = connected_components(found, scratch)
    within = least.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    classes = within.groupBy("root").agg(F.min("least").alias("component_id"))
    # Written, so that both sides of the last join are plain exchanges, which AQE can split where a fingerprint is frequent.
    named = scratch.write(within.join(classes, "root").select("fp", "component_id"), "named")
    return prints.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "fp")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, distance: int = 3) -> DataFrame:
    """docs without the rows whose group has a smaller doc_id. Rows without an id stay; rows that share an id share their fate."""
    marks = near_duplicates(docs, id_col, text_col, shingle, distance)
    scratch = Scratch(docs.sparkSession, "simhash-drop")
    gone = scratch.write(marks.where("doc_id > component_id").select(F.col("doc_id").alias(id_col)).distinct(), "gone")
    return docs.join(gone, id_col, "left_anti").select(docs.columns)
