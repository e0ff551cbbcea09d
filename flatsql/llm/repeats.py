"""Repeated windows of a corpus: what the suffix-array and the suffix-automaton operators share.

A window is `length` consecutive units (bytes or words) of one document; it is repeated if it also starts
anywhere else. Every window chooses an anchor among its k-grams by content alone (the one with the least
hash, leftmost of equals), so equal windows have equal anchors. Consecutive windows of a document that
choose the same anchor form a segment. Only segments whose anchors occur more than once can hold repeated
windows; of those, equal ones collapse to one passage and a count, and the passages under one anchor make a
shard, which the operator's own method searches. Nothing is compared between shards.

A shard of more than `most` different passages (a passage in very many documents, at its ends) is dealt out
anew: its windows are cut into ranges by their distance to the anchor, keyed by what all windows of a range
have in common, in ever smaller ranges; a range of one window has one passage. So shards are bounded and no
window is left out.
"""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from flatsql.llm.common import Scratch, batched, slices

SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x94D049BB133111EB)]


def gram_hashes(units: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of every k consecutive units (k a power of two), from their own hashes."""
    h, size, level = units, 1, 0
    while size < k:
        h = h[:-size] * _MIX[level] + (h[size:] ^ h[size:] >> np.uint64(29))
        size, level = 2 * size, level + 1
    h = (h ^ h >> np.uint64(32)) * _MIX[-1]
    return h ^ h >> np.uint64(29)


def anchors(grams: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each maximal run of windows (of `width` grams) with the same anchor: the anchor, the first and the last window."""
    least = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
    size = 1
    while 2 * size <= width:
        least, size = np.minimum(least[:-size], least[size:]), 2 * size
    if size < width:
        least = np.minimum(least[: len(least) - (width - size)], least[width - size :])
    at = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    return at[first], first, np.append(first[1:], len(at)) - 1


def merged(spans: Sequence[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def runs(starts: np.ndarray, length: int) -> list[tuple[int, int]]:
    """The ranges that windows starting at the sorted starts cover."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > length)
    return list(zip(starts[np.concatenate(([0], cut + 1))].tolist(), (starts[np.append(cut, len(starts) - 1)] + length).tolist(), strict=True))


_SPAN_TYPE = "array<struct<start:long,end:long>>"


def merge_spans(spans: Column) -> Column:
    """merged() of an array column: disjoint maximal spans in order, however many overlap."""
    last = lambda out: F.element_at(out, -1)
    grown = lambda out, s: F.concat(F.slice(out, 1, F.size(out) - 1), F.array(F.struct(last(out)["start"].alias("start"), F.greatest(last(out)["end"], s["end"]).alias("end"))))
    apart = lambda out, s: (F.size(out) == 0) | (F.try_element_at(out, F.lit(-1))["end"] < s["start"])
    return F.aggregate(F.array_sort(spans), F.array().cast(_SPAN_TYPE), lambda out, s: F.when(apart(out, s), F.concat(out, F.array(s))).otherwise(grown(out, s)))


def shifted(spans: Column, by: Column) -> Column:
    return F.transform(spans, lambda s: F.struct((s["start"] + by).cast("long").alias("start"), (s["end"] + by).cast("long").alias("end")))


class RepeatFinder(ABC):
    """length: units in a window; k: units in an anchor, a power of two; most: different passages in a shard."""

    length: int
    k: int
    most: int
    #: Sizes of ranges that large shards are cut into, one after the other.
    ranges: tuple[int, ...]
    name: str

    @abstractmethod
    def split(self, text: str | None) -> Sequence: ...

    @abstractmethod
    def hashes(self, units: Sequence) -> np.ndarray:
        """A 64-bit hash of each unit."""

    @abstractmethod
    def join(self, units: Sequence) -> bytes: ...

    @abstractmethod
    def parts(self, content: bytes) -> Sequence:
        """join()'s units."""

    @abstractmethod
    def search(self, shards: list[list[tuple[int, bytes]]]) -> list[list[list[tuple[int, int]]]]:
        """For each passage of each shard, with the number of places that have it, the unit ranges covered by windows
        that start elsewhere in the shard, too."""

    #: Bytes of passages that are searched at once.
    batch_bytes = 4 << 20
    #: Bytes of passages in a partition, and partitions at most; beyond, they are larger.
    part_bytes, most_parts = 2 << 20, 20_000

    def digest(self, units: Sequence, hashes: np.ndarray, a: int, b: int) -> int:
        return xxhash.xxh3_64_intdigest(hashes[a:b].tobytes())

    # The stages.

    def scan(self, docs: DataFrame, kind: str, arrow_kind: pa.DataType) -> DataFrame:
        """Every segment: its anchor's hash h, its own c, the place of the anchor and its first and last window."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches):
                held: list[list] = []
                for at, text in enumerate(batch.column(1).to_pylist()):
                    units = self.split(text)
                    if len(units) < self.length:
                        continue
                    hashes = self.hashes(units)
                    grams = gram_hashes(hashes, self.k)
                    where, first, last = anchors(grams, self.length - self.k + 1)
                    own = [self.digest(units, hashes, a, b) for a, b in zip(first.tolist(), (last + self.length).tolist(), strict=True)]
                    held.append([grams[where], np.array(own, np.uint64), np.full(len(where), at), where, first, last])
                if held:
                    h, c, at, where, first, last = (np.concatenate(x) for x in zip(*held, strict=True))
                    at = pa.array(at)
                    columns = [pa.array(h.view(np.int64)), pa.array(c.view(np.int64)), batch.column(0).take(at), batch.column(2).take(at), pa.array(where.astype(np.int32)), pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32))]
                    yield pa.RecordBatch.from_arrays(columns, names=["h", "c", "doc_id", "row", "anchor", "first", "last"])

        return docs.mapInArrow(run, f"h long, c long, doc_id {kind}, row long, anchor int, first int, last int")

    def cut(self, found: DataFrame, kind: str, arrow_kind: pa.DataType, digest: bool) -> DataFrame:
        """Documents with their segments under repeated anchors: kind 0, done; 1, waiting for shards; 2, a passage to search."""
        schema = pa.schema([("kind", pa.int32()), ("doc_id", arrow_kind), ("row", pa.int64()), ("h", pa.int64()), ("c", pa.int64()), ("anchor", pa.int32()), ("first", pa.int32()), ("content", pa.binary()), ("n", pa.int64()), ("spans", SPANS), ("kept", pa.binary())])

        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
            for batch in slices(batches, 100):
                for doc_id, text, row, segments in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    units = self.split(text)
                    spans = merged([(s["first"], s["last"] + self.length) for s in segments or () if not s["mixed"]])
                    open_ = [s for s in segments or () if s["mixed"]]
                    if open_:
                        yield 1, doc_id, row, None, None, None, None, (text or "").encode("utf-8", "surrogatepass"), None, spans, None
                        for s in open_:
                            yield 2, doc_id, row, s["h"], s["c"], s["anchor"], s["first"], self.join(units[s["first"] : s["last"] + self.length]), None, None, None
                    else:
                        yield 0, doc_id, row, None, None, None, None, None, len(units), spans, self.rest(units, spans, digest)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield from batched(rows(batches), schema, lambda r: 100 + len(r[7] or b""), 4 << 20)

        return found.mapInArrow(run, f"kind int, doc_id {kind}, row long, h long, c long, anchor int, first int, content binary, n long, spans array<struct<start:long,end:long>>, kept binary")

    def rest(self, units: Sequence, spans: Sequence, digest: bool) -> bytes:
        """What is left of the units, or its SHA-256."""
        import hashlib

        left, at = [], 0
        for s, e in spans:
            left.append(units[at:s])
            at = e
        left.append(units[at:])
        whole = self.join(self.concat(left))
        return hashlib.sha256(whole).digest() if digest else whole

    @abstractmethod
    def concat(self, parts: list) -> Sequence: ...

    def finer(self, pieces: DataFrame, size: int) -> DataFrame:
        """pieces(h, c, m, at, content) -> each one's windows in ranges of `size` by their distance to the anchor, a piece
        for each range: (h, c, m, at, content, parent_h, parent_c, shift), shift being its place in its parent."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches):

                def rows(batch=batch) -> Iterator[tuple]:
                    for h, c, m, at, content in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                        units = self.parts(content)
                        last = len(units) - self.length
                        for part in range((at - last) // size, at // size + 1):
                            near, far = part * size, part * size + size - 1  # distances of the range's windows
                            a, b = max(0, at - far), min(last, at - near)
                            own = self.join(units[a : b + self.length])
                            start = at - near
                            common = self.join(units[start : max(start, at - far + self.length)])
                            key = xxhash.xxh3_64_intdigest(common, seed=(h ^ part * 0x9E3779B9) & 0xFFFFFFFFFFFFFFFF)
                            yield key - (1 << 63), xxhash.xxh3_64_intdigest(own) - (1 << 63), m, at - a, own, h, c, a

                yield from batched(rows(), schema, lambda r: 100 + len(r[4]), 4 << 20)

        schema = pa.schema([("h", pa.int64()), ("c", pa.int64()), ("m", pa.int64()), ("at", pa.int32()), ("content", pa.binary()), ("parent_h", pa.int64()), ("parent_c", pa.int64()), ("shift", pa.int32())])
        return pieces.select("h", "c", "m", "at", "content").mapInArrow(run, "h long, c long, m long, at int, content binary, parent_h long, parent_c long, shift int")

    def shards(self, pieces: DataFrame, size: int) -> DataFrame:
        """pieces(h, c, m, content) of so many bytes -> (h, c, spans): a shard lies together in one partition; whole
        shards are searched in batches."""
        parts = min(self.most_parts, -(-size // self.part_bytes) + 1)
        schema = pa.schema([("h", pa.int64()), ("c", pa.int64()), ("spans", SPANS)])

        def searched(held: list[tuple[int, list[tuple]]]) -> Iterator[tuple]:
            found = self.search([[(m, content) for _, m, content in passages] for _, passages in held])
            for (h, passages), each in zip(held, found, strict=True):
                for (c, _, _), spans in zip(passages, each, strict=True):
                    if spans:
                        yield h, c, [{"start": s, "end": e} for s, e in spans]

        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
            held: list[tuple[int, list[tuple]]] = []
            size = 0
            for batch in slices(batches):
                for h, c, m, content in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                    if not held or held[-1][0] != h:
                        if size >= self.batch_bytes:
                            yield from searched(held)
                            held, size = [], 0
                        held.append((h, []))
                    held[-1][1].append((c, m, content))
                    size += len(content)
            if held:
                yield from searched(held)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield from batched(rows(batches), schema, lambda r: 10 + len(r[2]), 20_000)

        return pieces.select("h", "c", "m", "content").repartition(parts, "h").sortWithinPartitions("h", "c").mapInArrow(run, "h long, c long, spans array<struct<start:long,end:long>>")

    def find(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
        """(doc_id, n, spans, kept): one row per row of docs.

        n is the number of units, spans the maximal runs of units that repeated windows cover, kept what is left
        of the text (digest: its SHA-256). Null and empty texts, and those shorter than a window, keep all. Rows
        that repeat id and text repeat each other and are removed but for nothing: each window of theirs starts
        elsewhere. Null ids are a value like any other.
        """
        scratch = Scratch(docs.sparkSession, self.name)
        kind = docs.schema[id_col].dataType.simpleString()
        arrow_kind = to_arrow_type(docs.schema[id_col].dataType)
        rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("row"))
        every = scratch.write(self.scan(rows, kind, arrow_kind), "anchors")
        groups = scratch.write(every.groupBy("h").agg(F.count("*").alias("times"), (F.min("c") != F.max("c")).alias("mixed")).where("times > 1").select("h", "mixed"), "groups")
        repeated = scratch.write(every.join(groups, "h"), "repeated")
        scratch.remove("anchors")
        listed = repeated.groupBy(F.col("doc_id").alias("_id"), F.col("row").alias("_row")).agg(F.collect_list(F.struct("h", "c", "anchor", "first", "last", "mixed")).alias("segments"))  # of one document
        both = rows.join(listed, rows["doc_id"].eqNullSafe(listed["_id"]) & (rows["row"] == listed["_row"]), "left")
        stored = scratch.write(self.cut(both.select("doc_id", "text", "row", "segments"), kind, arrow_kind, digest), "cut", partition_by=("kind",))
        scratch.remove("repeated")
        done = stored.where("kind = 0").select("doc_id", "n", "spans", "kept")
        waiting = stored.where("kind = 1").select("doc_id", "row", "content", "spans")

        segments = stored.where("kind = 2").select("h", "c", "doc_id", "row", (F.col("anchor") - F.col("first")).alias("at"), "first", "content")
        pieces = segments.groupBy("h", "c").agg(F.count("*").alias("m"), F.first("at").alias("at"), F.first("content").alias("content"))
        found: list[DataFrame] = []
        links: list[DataFrame] = []
        if not self.ranges or self.ranges[-1] != 1:
            raise ValueError("the last ranges hold one window, so that no shard is left that is too large")
        for step, size in enumerate([*self.ranges, None]):
            pieces = scratch.write(pieces, f"pieces{step}")
            sizes = pieces.groupBy("h").agg(F.count("*").alias("k"))
            large = scratch.write(sizes.where(F.col("k") > self.most).select("h"), f"large{step}")
            bytes_ = pieces.agg(F.coalesce(F.sum(F.length("content")), F.lit(0))).first()[0]
            found.append(scratch.write(self.shards(pieces.join(large, "h", "left_anti"), bytes_), f"found{step}"))
            if size is None or large.isEmpty():
                break
            finer = scratch.write(self.finer(pieces.join(large, "h", "left_semi"), size), f"finer{step}")
            shared = scratch.write(finer.groupBy("h").agg(F.sum("m").alias("times")).where("times > 1").select("h"), f"shared{step}")
            finer = finer.join(shared, "h", "left_semi")
            links.append(finer.select("h", "c", "parent_h", "parent_c", "shift"))
            pieces = finer.groupBy("h", "c").agg(F.sum("m").alias("m"), F.first("at").alias("at"), F.first("content").alias("content"))

        # Each piece has one row with its disjoint spans at every level, so that rows follow the pieces and not the windows.
        spans = found[-1]
        for step in range(len(found) - 2, -1, -1):  # what was found in the parts of a piece is found in the piece
            lifted = links[step].join(spans, ["h", "c"]).select(F.col("parent_h").alias("h"), F.col("parent_c").alias("c"), shifted(F.col("spans"), F.col("shift")).alias("spans"))
            lifted = found[step].union(lifted).groupBy("h", "c").agg(merge_spans(F.flatten(F.collect_list("spans"))).alias("spans"))  # of one passage
            spans = scratch.write(lifted, f"spans{step}")
        places = segments.drop("content", "at").join(spans, ["h", "c"]).select(F.col("doc_id").alias("_id"), F.col("row").alias("_row"), shifted(F.col("spans"), F.col("first")).alias("spans"))
        spans = places.groupBy("_id", "_row").agg(F.flatten(F.collect_list("spans")).alias("more"))  # of one document

        def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            schema = pa.schema([("doc_id", arrow_kind), ("n", pa.int64()), ("spans", SPANS), ("kept", pa.binary())])

            def rows() -> Iterator[tuple]:
                for batch in slices(batches, 100):
                    for doc_id, content, spans, more in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                        units = self.split(content.decode("utf-8", "surrogatepass"))
                        all_ = merged([(s["start"], s["end"]) for s in (*spans, *(more or ()))])
                        yield doc_id, len(units), all_, self.rest(units, all_, digest)

            yield from batched(rows(), schema, lambda r: 100 + len(r[3]), 4 << 20)

        left = waiting.join(spans, waiting["doc_id"].eqNullSafe(spans["_id"]) & (waiting["row"] == spans["_row"]), "left").select("doc_id", "content", waiting["spans"].alias("spans"), "more")
        return done.union(left.mapInArrow(finish, f"doc_id {kind}, n long, spans array<struct<start:long,end:long>>, kept binary"))
