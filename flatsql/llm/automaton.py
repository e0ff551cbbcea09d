"""Substring deduplication by suffix automata over words.

A reference shard's passages go into one suffix automaton, with the number of places of every state's
strings; then each passage is streamed through it for matching statistics: at every word the longest suffix
that stands in two places at least. Maximal spans of `length` words or more are removed.

Repeats within a corpus: the reference is the corpus itself, so its shards are routed to the tasks that stream
what can match them (see repeats.py). A separate reference of stated size: its shards' automata are broadcast,
in blocks of BLOCK_WORDS words, and all documents are streamed past each.
"""

from __future__ import annotations

from collections.abc import Hashable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flatsql.llm.common import Scratch
from flatsql.llm.repeats import RepeatFinder, merged

LENGTH = 35
BLOCK_WORDS = 1_000_000


class SuffixAutomaton:
    """Of several sequences: every state's transitions, suffix link, longest length and number of places."""

    def __init__(self) -> None:
        self.step: list[dict[Hashable, int]] = [{}]
        self.link, self.size, self.places = [-1], [0], [0]

    def _state(self, size: int, step: dict, link: int, places: int) -> int:
        self.step.append(step)
        self.link.append(link)
        self.size.append(size)
        self.places.append(places)
        return len(self.size) - 1

    def add(self, sequence: Sequence[Hashable], places: int = 1) -> None:
        """A sequence that stands in so many places."""
        last = 0
        for symbol in sequence:
            last = self._extend(last, symbol)
            self.places[last] += places

    def _clone(self, p: int, q: int, symbol: Hashable) -> int:
        r = self._state(self.size[p] + 1, dict(self.step[q]), self.link[q], 0)
        self.link[q] = r
        while p >= 0 and self.step[p].get(symbol) == q:
            self.step[p][symbol] = r
            p = self.link[p]
        return r

    def _extend(self, p: int, symbol: Hashable) -> int:
        q = self.step[p].get(symbol)
        if q is not None:
            return q if self.size[q] == self.size[p] + 1 else self._clone(p, q, symbol)
        new = self._state(self.size[p] + 1, {}, 0, 0)
        while p >= 0 and symbol not in self.step[p]:
            self.step[p][symbol] = new
            p = self.link[p]
        if p >= 0:
            q = self.step[p][symbol]
            self.link[new] = q if self.size[q] == self.size[p] + 1 else self._clone(p, q, symbol)
        return new

    def finish(self) -> SuffixAutomaton:
        """Adds each state's places to its suffixes'; once, after the last add()."""
        for state in sorted(range(1, len(self.size)), key=self.size.__getitem__, reverse=True):
            if self.link[state] > 0:
                self.places[self.link[state]] += self.places[state]
        return self

    def spans(self, sequence: Sequence[Hashable], length: int, places: int = 1) -> list[tuple[int, int]]:
        """The ranges of sequence covered by strings of `length` symbols or more with so many places."""
        step, link, size, count = self.step, self.link, self.size, self.places
        out: list[tuple[int, int]] = []
        state = match = 0
        for at, symbol in enumerate(sequence, 1):
            to = step[state].get(symbol)
            while state and (to is None or count[to] < places):
                state = link[state]
                match = size[state]
                to = step[state].get(symbol)
            if to is None or count[to] < places:
                match = 0
                continue
            state, match = to, match + 1
            if match >= length:
                start = at - match
                while out and out[-1][1] >= start:
                    start = min(start, out.pop()[0])
                out.append((start, at))
        return out


class WordRepeats(RepeatFinder):
    """Words are runs of bytes other than ASCII white space, unchanged."""

    # Anchors of nearly half a window: lines that many documents share are mostly shorter and then no candidates.
    name, k, most, ranges = "substring", 16, 64, (10, 3, 1)

    def __init__(self, length: int = LENGTH, k: int = 16, most: int = 64):
        if length < k:
            raise ValueError("a window must hold an anchor")
        self.length, self.k, self.most = length, k, most

    def split(self, text: str | None) -> list[bytes]:
        return (text or "").encode("utf-8", "surrogatepass").split()

    def hashes(self, units: list[bytes]) -> np.ndarray:
        return np.array(list(map(xxhash.xxh3_64_intdigest, units)), np.uint64)

    def join(self, units: list[bytes]) -> bytes:
        return b" ".join(units)

    def parts(self, content: bytes) -> list[bytes]:
        return content.split()

    def concat(self, parts: list[list[bytes]]) -> list[bytes]:
        return [word for part in parts for word in part]

    def search(self, shards: list[list[tuple[int, bytes]]]) -> list[list[list[tuple[int, int]]]]:
        out = []
        for passages in shards:
            automaton = SuffixAutomaton()
            split = [self.parts(content) for _, content in passages]
            for (places, _), words in zip(passages, split, strict=True):
                automaton.add(words, places)
            automaton.finish()
            out.append([automaton.spans(words, self.length, 2) for words in split])
        return out


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, digest: bool = False) -> DataFrame:
    """(doc_id, n, spans, kept): see RepeatFinder.find; units are words, kept joins those left by one space."""
    return WordRepeats(length).find(docs, id_col, text_col, digest)


def remove_reference(docs: DataFrame, reference: DataFrame, id_col: str = "doc_id", text_col: str = "text", reference_col: str = "text", length: int = LENGTH, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, n, spans, kept): docs without the words that windows of `length` words of the reference cover.

    The reference's texts are gone through in shards of about block_words words; each shard's automaton is
    broadcast and every document streamed through it. Nulls have no words; a text's window crosses no other.
    """
    words = WordRepeats()
    kind = docs.schema[id_col].dataType.simpleString()
    context = docs.sparkSession.sparkContext

    def shards() -> Iterator[SuffixAutomaton]:
        automaton, size = SuffixAutomaton(), 0
        for (text,) in reference.select(reference_col).toLocalIterator():
            split = words.split(text)
            automaton.add(split)
            size += len(split)
            if size >= block_words:
                yield automaton.finish()
                automaton, size = SuffixAutomaton(), 0
        if size:
            yield automaton.finish()

    schema = "doc_id " + kind + ", text string, spans array<struct<start:long,end:long>>"
    found = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.array().cast("array<struct<start:long,end:long>>").alias("spans"))
    scratch = Scratch(docs.sparkSession, "reference")
    for number, automaton in enumerate(shards()):
        sent = context.broadcast((automaton.step, automaton.link, automaton.size, automaton.places))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            own = SuffixAutomaton()
            own.step, own.link, own.size, own.places = sent.value
            for batch in batches:
                spans = [merged([*((s["start"], s["end"]) for s in before), *own.spans(words.split(text), length)]) for text, before in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([[{"start": s, "end": e} for s, e in x] for x in spans], batch.schema.field(2).type)], names=["doc_id", "text", "spans"])

        found = scratch.write(found.mapInArrow(run, schema), f"shard{number}")

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            split = [words.split(text) for text in batch.column(1).to_pylist()]
            spans = [[(s["start"], s["end"]) for s in x] for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, split), pa.int64()), batch.column(2), pa.array([words.rest(u, s, False) for u, s in zip(split, spans, strict=True)], pa.binary())], names=["doc_id", "n", "spans", "kept"])

    return found.mapInArrow(rest, f"doc_id {kind}, n long, spans array<struct<start:long,end:long>>, kept binary")
