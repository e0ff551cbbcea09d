"""Benchmark decontamination over a positional inverted index of the training texts.

The index is cut into segments, each of a bounded number of text bytes and one row of a table in shared
storage: a segment lists its documents and, for every term, the sorted positions at which it stands. Positions
run through the segment's documents with a gap between them, so that no match crosses from one to the next. A
phrase is found by taking the positions of its globally rarest term, shifting them to where the phrase would
start and keeping those at which every other term, rarest first, stands at its offset.

The index is built once and serves any number of test items. These are gone through in blocks of BLOCK_BYTES of
text: what is sent to the workers is so bounded whatever the number of items, and every item is held against all
documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from flatsql.llm.common import Scratch, slices

WINDOW = 13
SEGMENT_BYTES = 4 << 20
BLOCK_BYTES = 1 << 20
#: A-Z to a-z; ASCII but letters and digits parts words, any other character belongs to one.
WORDS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def spaced(text: str | None) -> bytes:
    """The text's words, apart by spaces."""
    return (text or "").encode("utf-8", "surrogatepass").translate(WORDS)


def words(text: str | None) -> list[bytes]:
    return spaced(text).split()


@dataclass
class Block:
    """Test items' windows as term numbers; items without words have none."""

    window: int
    terms: dict[bytes, int] = field(default_factory=dict)
    windows: dict[tuple[int, ...], set[str | None]] = field(default_factory=dict)

    def add(self, item_id: str | None, text: str | None) -> None:
        ids = [self.terms.setdefault(w, len(self.terms)) for w in words(text)]
        for at in range(max(1, len(ids) - self.window + 1) if ids else 0):
            self.windows.setdefault(tuple(ids[at : at + self.window]), set()).add(item_id)


def blocks(items: DataFrame, id_col: str, text_col: str, window: int, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    held, size = Block(window), 0
    for item_id, text in items.select(F.col(id_col).cast("string"), F.col(text_col)).toLocalIterator():
        held.add(item_id, text)
        size += len(text or "")
        if size >= limit:
            yield held
            held, size = Block(window), 0
    yield held


INDEX = "doc_ids array<{0}>, rows array<long>, n_words array<int>, bases array<int>, terms array<binary>, counts array<int>, positions binary"


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", gap: int = WINDOW) -> DataFrame:
    """A row for each segment; positions holds the terms' postings one after another, counts their lengths.

    Null texts have no words; repeated rows are separate documents. Windows of more than `gap` words may not be sought.
    """
    kind = docs.schema[id_col].dataType
    ints = pa.list_(pa.int32())
    schema = pa.schema([("doc_ids", pa.list_(to_arrow_type(kind))), ("rows", pa.list_(pa.int64())), ("n_words", ints), ("bases", ints), ("terms", pa.list_(pa.binary())), ("counts", ints), ("positions", pa.binary())])

    def segment(held: list[tuple]) -> pa.RecordBatch:
        texts = pa.array([spaced(text) for _, text, _ in held], pa.large_binary()).view(pa.large_string())
        split = pc.ascii_split_whitespace(texts)
        flat = split.flatten()
        filled = pc.not_equal(flat, "")
        doc = np.repeat(np.arange(len(held)), pc.list_value_length(split).to_numpy())
        n_words = np.bincount(doc[filled.to_numpy(zero_copy_only=False)], minlength=len(held))
        coded = flat.filter(filled).dictionary_encode()
        ids, terms = coded.indices.to_numpy(), coded.dictionary.cast(pa.large_binary()).cast(pa.binary())
        bases = np.cumsum(n_words + gap) - (n_words + gap)
        at = np.arange(len(ids)) + np.repeat(bases - (np.cumsum(n_words) - n_words), n_words)
        order = np.argsort(ids, kind="stable")
        rows = [[x[0] for x in held], [x[2] for x in held], n_words.astype(np.int32), bases.astype(np.int32)]
        columns = [pa.array([x], type=t) for x, t in zip(rows, schema.types[:4], strict=True)]
        lists = [pa.ListArray.from_arrays(pa.array([0, len(terms)], pa.int32()), x) for x in (terms, pa.array(np.bincount(ids, minlength=len(terms)).astype(np.int32)))]
        return pa.RecordBatch.from_arrays([*columns, *lists, pa.array([at[order].astype("<i4").tobytes()], pa.binary())], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in slices(batches):
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.append(row)
                size += len(row[1] or "")
                if size >= SEGMENT_BYTES:
                    yield segment(held)
                    held, size = [], 0
        if held:
            yield segment(held)

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("row"))
    return rows.mapInArrow(run, INDEX.format(kind.simpleString()))


def among(terms: pa.Array, sought: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Which of the terms are sought, and their numbers there."""
    found = pc.index_in(terms, value_set=sought)
    here = np.flatnonzero(pc.is_valid(found).to_numpy(zero_copy_only=False))
    return here, found.drop_null().to_numpy()


class Postings:
    """A segment's lists, and searches of them."""

    def __init__(self, terms: pa.Array, counts: np.ndarray, positions: pa.Buffer, sought: pa.Array):
        """Of the terms sought only, by their numbers there."""
        ends, every = np.cumsum(counts, dtype=np.int64), np.frombuffer(positions, "<i4")
        here, number = among(terms, sought)
        bounds = zip(number.tolist(), (ends[here] - counts[here]).tolist(), ends[here].tolist(), strict=True)
        self.of = {n: every[a:b] for n, a, b in bounds}

    def holds(self, term: int, at: np.ndarray) -> np.ndarray:
        listed = self.of.get(term)
        if listed is None:
            return np.zeros(len(at), bool)
        slot = np.searchsorted(listed, at)
        return (slot < len(listed)) & (listed[np.minimum(slot, len(listed) - 1)] == at)

    def phrase(self, window: tuple[int, ...], order: list[int]) -> np.ndarray:
        """Where the window starts; order lists its offsets, rarest term first."""
        starts = self.of[window[order[0]]] - order[0]
        for offset in order[1:]:
            if not len(starts):
                break
            starts = starts[self.holds(window[offset], starts + offset)]
        return starts

    def near(self, window: tuple[int, ...], order: list[int], span: int) -> list[tuple[int, int]]:
        """The least ranges [start, end) of span positions or fewer that hold all of the window's terms, with repeats, in any order."""
        need: dict[int, int] = {}
        for t in window:
            need[t] = need.get(t, 0) + 1
        if any(len(self.of.get(t, ())) < n for t, n in need.items()):
            return []
        out: set[tuple[int, int]] = set()
        for centre in self.of[window[order[0]]].tolist():
            lo, hi = centre - span + 1, centre + span
            around = sorted((int(p), t) for t in need for p in self.of[t][slice(*np.searchsorted(self.of[t], [lo, hi]))])
            have = dict.fromkeys(need, 0)
            first = 0
            for last, (p, t) in enumerate(around):
                have[t] += 1
                while have[around[first][1]] > need[around[first][1]]:
                    have[around[first][1]] -= 1
                    first += 1
                if all(have[x] == n for x, n in need.items()) and p - around[first][0] < span:
                    out.add((around[first][0], p + 1))
        return sorted(x for x in out if not any(x != y and x[0] <= y[0] and y[1] <= x[1] for y in out))


HITS = "doc_id {0}, row long, n_words long, starts array<long>, ends array<long>, item_ids array<string>"


def search(index: DataFrame, block: Block, slop: int | None = None) -> DataFrame:
    """(doc_id, row, n_words, starts, ends, item_ids): for each document of the index its matches as word ranges, and their items.

    slop None asks for exact phrases. Else a window also matches where all of its words stand, in any order, within
    `slop` words more than it has.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            terms, counts = (batch.column(i).flatten() for i in range(2))
            here, number = among(terms, terms_sent.value)
            yield pa.RecordBatch.from_arrays([pa.array(number, pa.int32()), counts.take(pa.array(here)).cast(pa.int64())], names=["term", "n"])

    terms_sent = index.sparkSession.sparkContext.broadcast(pa.array(list(block.terms), pa.binary()))  # of a block of bounded size, as the plan below
    totals = index.select("terms", "counts").mapInArrow(counted, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()  # a row for each term of the block
    frequency = {r["term"]: r["n"] for r in totals}
    plan: dict[int, list[tuple[tuple[int, ...], list[int], list[str | None]]]] = {}
    for window, ids in block.windows.items():
        if all(t in frequency for t in window):
            order = sorted(range(len(window)), key=lambda i, w=window: (frequency[w[i]], i))
            plan.setdefault(window[order[0]], []).append((window, order, list(ids)))
    sent = index.sparkSession.sparkContext.broadcast(plan)
    kind = index.schema["doc_ids"].dataType.elementType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            doc_ids, rows, n_words, bases = (batch.column(i).flatten().to_pylist() for i in range(4))
            postings = Postings(batch.column(4).flatten(), batch.column(5).flatten().to_numpy(), batch.column(6)[0].as_buffer(), terms_sent.value)
            bounds = np.array(bases)
            starts, ends, items = ([[] for _ in doc_ids] for _ in range(3))
            for rare in postings.of:
                for window, order, ids in sent.value.get(rare, ()):
                    if slop is None:
                        found = [(s, s + len(window)) for s in postings.phrase(window, order).tolist()]
                    else:
                        found = postings.near(window, order, len(window) + slop)
                    for s, e in found:
                        doc = int(np.searchsorted(bounds, s, side="right")) - 1
                        if e - bases[doc] <= n_words[doc]:
                            starts[doc].append(s - bases[doc])
                            ends[doc].append(e - bases[doc])
                            items[doc].extend(ids)
            items = [sorted(set(x), key=lambda i: (i is None, i or "")) for x in items]
            yield pa.RecordBatch.from_arrays([pa.array(doc_ids, batch.schema.field(0).type.value_type), *(pa.array(x, t) for x, t in ((rows, pa.int64()), (n_words, pa.int64()), (starts, pa.list_(pa.int64())), (ends, pa.list_(pa.int64())), (items, pa.list_(pa.string()))))], names=["doc_id", "row", "n_words", "starts", "ends", "item_ids"])

    return index.mapInArrow(run, HITS.format(kind.simpleString()))


def matches(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, slop: int | None = None, block_bytes: int = BLOCK_BYTES, index: DataFrame | None = None) -> DataFrame:
    """(doc_id, row, n_words, starts, ends, item_ids): one row per row of docs, whatever the number of blocks.

    index: what build_index(docs) made, with a gap of window + slop at least, kept in a table; without it one is made.

    A window is `window` consecutive words of an item; an item of fewer, but not none, is one window. Null texts
    have no words. Ids are compared as strings; items without id are one item, whose id is null and comes last.
    """
    scratch = Scratch(docs.sparkSession, "decontam")
    gap = window + (slop or 0)
    if index is None:
        index = scratch.write(build_index(docs, id_col, text_col, gap), "index")
    found = [search(index, block, slop) for block in blocks(items, item_id_col, item_text_col, window, block_bytes)]
    if len(found) == 1:
        return found[0]
    hits = [scratch.write(x, f"hits{n}") for n, x in enumerate(found)]
    union = hits[0]
    for x in hits[1:]:
        union = union.union(x)
    # Rows that repeat id and text have the same matches: they are merged as one and dealt out again.
    union = union.where(F.size("item_ids") > 0).groupBy("doc_id", "row").agg(*(F.array_distinct(F.flatten(F.collect_set(c))).alias(c) for c in ("item_ids",)), F.flatten(F.collect_set(F.arrays_zip("starts", "ends"))).alias("spans"))
    union = scratch.write(union, "union").withColumnsRenamed({"doc_id": "_id", "row": "_row"})
    base = hits[0].select("doc_id", "row", "n_words")
    both = base.join(union, base["doc_id"].eqNullSafe(union["_id"]) & (base["row"] == union["_row"]), "left")
    empty = F.array().cast("array<struct<starts:long,ends:long>>")
    spans = F.coalesce("spans", empty)
    return both.select("doc_id", "row", "n_words", spans["starts"].alias("starts"), spans["ends"].alias("ends"), F.array_sort(F.coalesce("item_ids", F.array().cast("array<string>"))).alias("item_ids"))


def covered(starts: list[int], ends: list[int]) -> int:
    total, reach = 0, 0
    for s, e in sorted(zip(starts, ends, strict=True)):
        total += max(0, e - max(s, reach))
        reach = max(reach, e)
    return total


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, share: float = 0.05) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated, row): one row per row of docs.

    n_hit counts words inside any match. n_items counts all items without id as one, items_sha256 leaves it out. contaminated: some word is hit, and at least `share` of all words.
    """
    found = matches(docs, items, id_col, text_col, window=window)
    # In the JVM, so that a task keeps one Python process.
    spans = F.array_sort(F.arrays_zip("starts", "ends"))
    start = F.struct(F.lit(0).cast("long").alias("hit"), F.lit(0).cast("long").alias("reach"))
    step = lambda so_far, s: F.struct((so_far["hit"] + F.greatest(F.lit(0), s["ends"] - F.greatest(s["starts"], so_far["reach"]))).alias("hit"), F.greatest(so_far["reach"], s["ends"]).alias("reach"))
    sha = F.sha2(F.array_join(F.filter("item_ids", lambda i: i.isNotNull()), ","), 256)
    out = found.select("doc_id", "row", "n_words", F.aggregate(spans, start, step)["hit"].alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"), sha.alias("items_sha256"))
    part = Fraction(share).limit_denominator(1_000_000)
    bad = (F.col("n_hit") > 0) & (part.denominator * F.col("n_hit") >= part.numerator * F.col("n_words"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", bad.alias("contaminated"), "row")


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the contaminated rows; a row is known by id and text, so repeated rows share their fate."""
    scratch = Scratch(docs.sparkSession, "decontam-drop")
    gone = scratch.write(contamination(docs, items, id_col, text_col).where("contaminated").select(F.col("doc_id").alias("_id"), F.col("row").alias("_row")).distinct(), "gone")
    return docs.join(gone, docs[id_col].eqNullSafe(gone["_id"]) & (F.xxhash64(docs[text_col]) == gone["_row"]), "left_anti").select(docs.columns)
