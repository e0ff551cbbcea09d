"""Near copies by SimHash: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Candidates are the components of wide SimHash fingerprints (simhash.py): fingerprints that share a key and lie within
135 of 512 bits, which sets at 0.5 or more do, link. A pair at 0.8 is missed with a chance of 3 in 100,000 at most, a closer
one more rarely. Then, within each component, every link is verified on the whole sets, of 32-bit hashes: two texts of n
shingles seem more alike than they are by a share of n / 2^32. In a component of over HUGE chunks, first all members are
held against one of them, a few times over, each time another one; that joins large groups at linear cost. What differs
after that is compared in blocks of bounded size, in which products of incidence matrices count what two sets share; of a
block only links come out that join groups. The members of a component's largest group are not compared with one another,
so that the cost is that of all members times those outside of it. Buckets of too many fingerprints are searched in the
same way, by differing bits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flatsql.llm import simhash
from flatsql.llm.common import Scratch, batched, rows_of, slices
from flatsql.llm.components import connected_components

SHINGLE, LEAST = 5, 0.8
#: Rounds in which the members of buckets of over so many chunks are held against one of them.
STARS, HUGE = 4, 8
#: Members of a block's half, and bytes of their sets, about.
CHUNK, CHUNK_BYTES = 512, 8 << 20
SLAB = 4096


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word shingles, A-Z lower-cased; of fewer words, that of all of them."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    own = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = max(1, len(words) - size + 1)
    h = np.full(n, min(len(words), size), np.uint64)
    for i in range(min(size, len(words))):
        h = (h ^ h >> np.uint64(31)) * np.uint64(0x9E3779B97F4A7C15) + own[i : i + n]
    h = (h ^ h >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return np.unique(h ^ h >> np.uint64(32))


def packed(held: np.ndarray) -> bytes:
    """The sorted distinct upper halves of the hashes."""
    return np.unique((held >> np.uint64(32)).astype("<u4")).tobytes()


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def _signed(docs: DataFrame, id_col: str, text_col: str, shingle: int, rows: int = 0) -> DataFrame:
    """(doc_id, keys, print, held): SimHash keys for a table of so many rows, the fingerprint and the set."""
    bits, keys = simhash.plan(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            sets = [shingles(x, shingle) for x in part.column(1).to_pylist()]
            if not sets:
                continue
            prints = np.stack([simhash.wide_fingerprint(s) for s in sets])
            values = simhash.wide_keys(prints, bits, keys)
            columns = [pa.array(list(values), pa.list_(pa.int64())), pa.array([x.tobytes() for x in np.packbits(prints, axis=1, bitorder="little")], pa.binary()), pa.array(map(packed, sets), pa.binary())]
            yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=["doc_id", "keys", "print", "held"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, keys array<long>, print binary, held binary")


PAIR = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _verified(pairs: DataFrame, sets: DataFrame, least: float, measure: Measure) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = ((a, b) for a, b, x, y in rows_of(batches, "a", "b", "x", "y") if measure.pair(np.frombuffer(x, "<u4"), np.frombuffer(y, "<u4"), least))
        yield from batched(found, PAIR)

    side = {c: sets.select(F.col("node").alias(c), F.col("held").alias(to)).hint("merge") for c, to in (("a", "x"), ("b", "y"))}
    return pairs.join(side["a"], "a").join(side["b"], "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """How many elements every two sets share: the product of their incidence matrix, a slab of columns at a time."""
    n = len(sets)
    flat, row = np.concatenate(sets), np.repeat(np.arange(n), [len(s) for s in sets])
    order = np.argsort(flat, kind="stable")
    flat, row = flat[order], row[order]
    same = flat[1:] == flat[:-1]
    column = np.cumsum(np.append(True, ~same)) - 1
    several = np.append(same, False) | np.append(False, same)  # what one set alone has is shared with none
    column, row = column[several], row[several]
    column = np.unique(column, return_inverse=True)[1]
    kind = np.float32 if max(map(len, sets)) < 1 << 24 else np.float64
    out = np.zeros((n, n), kind)
    bounds = np.searchsorted(column, np.arange(0, (column[-1] if len(column) else -1) + SLAB + 1, SLAB))
    for lo, hi in zip(bounds, bounds[1:], strict=False):
        if hi > lo:
            slab = np.zeros((n, SLAB), kind)
            slab[row[lo:hi], column[lo:hi] % SLAB] = 1
            out += slab @ slab.T
    return out


def similar_sets(sets: list[np.ndarray], least: float) -> np.ndarray:
    """Which sets have a similarity of `least` or more to which."""
    sizes = np.array([len(s) for s in sets], np.float64)
    both = shared_counts(sets)
    return both / (sizes[:, None] + sizes - both) >= least


class Measure(NamedTuple):
    """When two of what `held` holds are linked: as a pair, and of all pairs of a list, given a bound."""

    pair: Callable[[np.ndarray, np.ndarray, float], bool]
    matrix: Callable[[list[np.ndarray], float], np.ndarray]


JACCARD = Measure(lambda a, b, least: similarity(a, b) >= least, similar_sets)
HAMMING = Measure(lambda a, b, most: int(np.bitwise_count(a ^ b).sum()) <= most, lambda prints, most: simhash.near_matrix(np.stack(prints), most))


def cross_links(nodes: list[int], groups: list, sets: list[np.ndarray], least: float, measure: Measure = JACCARD) -> Iterator[tuple[int, int]]:
    """Links at `least` or more that join the groups which all such links between members of different groups join."""
    near = measure.matrix(sets, least)
    members: dict = {}
    for at, g in enumerate(groups):
        members.setdefault(g, []).append(at)
    number = {g: n for n, g in enumerate(members)}
    group, lists = np.array([number[g] for g in groups]), list(members.values())
    reached = np.zeros(len(lists), bool)
    for first, own in enumerate(lists):
        if reached[first]:
            continue
        reached[first] = True
        queue = list(own)
        while queue:
            at = queue.pop()
            for to in np.flatnonzero(near[at] & ~reached[group]).tolist():
                if not reached[group[to]]:
                    reached[group[to]] = True
                    queue.extend(lists[group[to]])
                    yield nodes[at], nodes[to]


def similar_groups(rows: DataFrame, scratch: Scratch, least: float = LEAST, chunk: int = CHUNK, stars: int = STARS, huge: int = HUGE, measure: Measure = JACCARD) -> DataFrame:
    """rows(node long, keys, held) -> (node, root) for every node that links to another at `least` or more, directly or not."""
    keyed = rows.select("node", F.length("held").alias("size"), F.explode("keys").alias("bucket"))
    shared = keyed.groupBy("bucket").agg(F.count("*").alias("n"), F.sum("size").alias("size")).where("n > 1")
    shared = scratch.write(shared.select("bucket", _chunks(F.col("n"), F.col("size"), chunk).alias("chunks")), "shared")
    members = scratch.write(keyed.join(shared.hint("merge"), "bucket"), "members")
    sets = scratch.write(rows.select("node", "held").join(members.select("node").distinct().hint("merge"), "node", "left_semi"), "sets")
    links = roots = None

    def named(of: DataFrame) -> DataFrame:
        return of.withColumn("root", F.col("node")) if roots is None else of.join(roots.hint("merge"), "node", "left").withColumn("root", F.coalesce("root", "node"))

    for turn in range(stars):
        large = scratch.write(named(members.where(F.col("chunks") > huge)), f"large{turn}")
        one = F.min(F.struct(F.xxhash64("node", F.lit(turn)).alias("rank"), F.col("node").alias("node"), F.col("root").alias("root"))).alias("one")
        left = large.groupBy("bucket").agg(one, F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi")
        left = scratch.write(left.select("bucket", F.col("one.node").alias("one"), F.col("one.root").alias("one_root")), f"open{turn}")
        if left.isEmpty():
            break
        pairs = large.join(left.hint("merge"), "bucket").where("root <> one_root").select(F.least("one", "node").alias("a"), F.greatest("one", "node").alias("b")).distinct()
        found = scratch.write(_verified(scratch.write(pairs, f"pairs{turn}"), sets, least, measure), f"star{turn}")
        links = found if links is None else links.union(found)
        roots = connected_components(links, scratch, f"cc{turn}")
    found = scratch.write(_all_pairs(scratch.write(named(members), "named"), sets, scratch, least, chunk, measure), "links")
    roots = connected_components(found if links is None else links.union(found), scratch, "cc")
    return roots


def _chunks(n: Column, size: Column, chunk: int) -> Column:
    return F.ceil(F.greatest(n / chunk, size / CHUNK_BYTES)).cast("int")


def _all_pairs(named: DataFrame, sets: DataFrame, scratch: Scratch, least: float, chunk: int, measure: Measure) -> DataFrame:
    """named(bucket, node, root, size, chunks) -> links within buckets whose members have several roots.

    Small buckets are compared in one call. Of the others, the members of the most frequent root and the rest are
    cut into chunks by node, and every two chunks of the rest, and each of them and of the others, in one call.
    """
    lists = named.where("chunks = 1").groupBy("bucket").agg(F.sort_array(F.collect_list(F.struct("root", "node"))).alias("members"))
    lists = scratch.write(lists.where(F.col("members")[0]["root"] < F.element_at("members", -1)["root"]).select("members").distinct().withColumn("bucket", F.monotonically_increasing_id()), "lists")
    whole = F.struct(F.lit(-1).alias("kind"), F.lit(0).alias("i"), F.lit(0).alias("j"))
    some = lists.select("bucket", F.explode("members").alias("x")).select("bucket", "x.node", "x.root", whole.alias("block"))

    large = named.where("chunks > 1")
    by_root = large.groupBy("bucket", "root").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    main = by_root.groupBy("bucket").agg(F.max(F.struct("n", "size", "root")).alias("main"), F.sum("n").alias("n"), F.sum("size").alias("size"))
    main = main.where("n > main.n").select("bucket", F.col("main.root").alias("main"), _chunks(F.col("main.n"), F.col("main.size"), chunk).alias("of_main"), _chunks(F.col("n") - F.col("main.n"), F.col("size") - F.col("main.size"), chunk).alias("of_rest"))
    cut = large.join(scratch.write(main, "main").hint("merge"), "bucket").withColumn("in_main", F.col("root") == F.col("main"))
    cut = cut.withColumn("own", F.pmod(F.xxhash64("node", F.lit("chunk")), F.when(F.col("in_main"), F.col("of_main")).otherwise(F.col("of_rest"))).cast("int"))
    block = lambda kind, i, j: F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"))
    own, rest, mains = F.col("own"), F.sequence(F.lit(0), F.col("of_rest") - 1), F.sequence(F.lit(0), F.col("of_main") - 1)
    blocks = F.when(F.col("in_main"), F.transform(rest, lambda j: block(1, own, j))).otherwise(F.concat(F.transform(rest, lambda j: block(0, F.least(own, j), F.greatest(own, j))), F.transform(mains, lambda i: block(1, i, own))))
    many = cut.select("bucket", "node", "root", F.explode(blocks).alias("block"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = (pair for (held,) in rows_of(batches, "members") for pair in cross_links([x["node"] for x in held], [x["root"] for x in held], [np.frombuffer(x["held"], "<u4") for x in held], least, measure))
        yield from batched(found, PAIR)

    dealt = some.union(many).join(sets.hint("merge"), "node")
    grouped = dealt.groupBy("bucket", "block").agg(F.collect_list(F.struct("node", "root", "held")).alias("members"))
    return grouped.select("members").mapInArrow(run, "a long, b long").distinct()


def components(rows: DataFrame, scratch: Scratch, distance: int = simhash.WIDE_DISTANCE, bucket: int = simhash.WIDE_BUCKET) -> DataFrame:
    """rows(node long, keys, print) -> (node, root) for every node whose fingerprint links to another's, directly or not."""
    prints = rows.groupBy("print").agg(F.min(F.struct("node", "keys")).alias("first"))
    prints = scratch.write(prints.select("print", "first.node", "first.keys"), "prints")
    copies = rows.select(F.col("node").alias("b"), "print").join(prints.select(F.col("node").alias("a"), "print").hint("merge"), "print").where("a <> b")
    links = [scratch.write(copies.select("a", "b"), "copies")]
    found, rest = simhash.wide_links(prints, scratch, distance, bucket)
    links += found
    rest = scratch.write(rest.groupBy("node").agg(F.collect_list("bucket").alias("keys"), F.first("print").alias("held")), "rest")
    if not rest.isEmpty():
        roots = similar_groups(rest, Scratch(rest.sparkSession, "jaccard-rest"), distance, measure=HAMMING)
        links.append(roots.select(F.col("node").alias("a"), F.col("root").alias("b")))
    every = links[0]
    for more in links[1:]:
        every = every.union(more)
    return connected_components(every, scratch, "prints-cc")


def drop_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, least: float = LEAST) -> DataFrame:
    """docs without the rows whose group of near copies has a smaller doc_id.

    Groups are what links at `least` or more connect, which must be 0.8 or more: SimHash's keys are for that. Texts
    without words are alike. Rows without an id stay; rows that share an id share their fate.
    """
    if least < LEAST:
        raise ValueError(f"least must be {LEAST} or more")
    scratch = Scratch(docs.sparkSession, "jaccard")
    rows = scratch.write(_signed(docs, id_col, text_col, shingle, docs.count()).withColumn("node", F.monotonically_increasing_id()), "rows")
    close = rows.select("node", "held").join(components(rows, scratch).withColumnRenamed("root", "bucket").hint("merge"), "node")
    close = scratch.write(close.select("node", "held", F.array("bucket").alias("keys")), "close")
    named = scratch.write(rows.select("node", "doc_id").join(similar_groups(close, scratch, least).hint("merge"), "node"), "groups")
    first = named.groupBy("root").agg(F.min("doc_id").alias("first"))
    gone = scratch.write(named.join(first.hint("merge"), "root").where("doc_id > first").select(F.col("doc_id").alias(id_col)).distinct(), "gone")
    for name in ("rows", "prints", "close", "sets", "members"):
        scratch.remove(name)
    return docs.join(gone, id_col, "left_anti").select(docs.columns)
