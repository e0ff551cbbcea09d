"""URL filters: rules by host and path, and for the other urls naive Bayes over segmented words.

Concatenated names are split by a unigram model: Viterbi finds the words whose probabilities have the largest
product. The model's counts are those of the words of all pages, exact and in a table that may be of any size:
urls are cut into blocks of bounded text, the substrings of a block's names are joined with the table, and so a
worker holds the counts that its block can ask for and no others. A bitmap of fixed size, in which every word
of the table has a bit, spares the join most substrings that are no words; one that passes by chance is not
found in the table, so the bitmap's size bears on speed only. The classifier is multinomial naive Bayes over
hashed words; its table has a fixed size. It is trained on all urls, of which those with one of a few seed words
among their split names are its examples of what to block, the others of what to allow: so it learns the company
that the seeds keep. What the rules say of a url is no label: they go by domains and folders, not by what hosts are.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flatsql.llm.common import Scratch, ascii_lower, batched

#: The contract's rules.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: Words by which a url is an example of what to block, a parameter of judge(): gambling, drugs, pornography, advertising.
SEEDS = ("ads", "adult", "bet", "bets", "betting", "casino", "escort", "gambling", "jackpot", "lottery", "pills", "poker", "porn", "sex", "slots", "spam", "viagra", "xxx")
CLASSES = 1 << 16
#: Added to every count of a word that some url has.
SMOOTHING = 0.1
LONGEST = 24
#: What parts words, for Java.
NO_WORD = r"[^\p{L}\p{M}\p{N}]+"
#: Bits of the words' bitmap, and how many of them a row of it holds.
BITMAP, BITMAP_ROW = 1 << 24, 1 << 15
#: A block's distinct names have so many characters or, by one url, more; and so many rows.
BLOCK_CHARS, BLOCK_ROWS = 1 << 15, 4096


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Both empty for null or without '://'."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return ascii_lower(F.regexp_extract(rest, "^[^/?#]*", 0)), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> Column:
    """struct(verdict, rule) of the longest rule that fits, else null."""
    found = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, rule in sorted(rules, key=lambda r: len(r[1])):
        name, _, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)
        found = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))).otherwise(found)
    return found


class _Model:
    """A unigram model over count(word) and total."""

    def log_probability(self, word: str) -> float:
        n = self.count(word) if len(word) <= LONGEST else 0
        return math.log(n / self.total) if n else -math.log(max(self.total, 1)) - len(word) * math.log(10)

    def segment(self, name: str) -> list[str]:
        """The likeliest words whose concatenation is the name; of equally likely ones, that with the longer last words."""
        best: list[tuple[float, int]] = [(0.0, 0)]
        for end in range(1, len(name) + 1):
            best.append(max((best[start][0] + self.log_probability(name[start:end]), -start) for start in range(max(0, end - LONGEST), end)))
        out, end = [], len(name)
        while end:
            start = -best[end][1]
            out.append(name[start:end])
            end = start
        return out[::-1]


@dataclass(frozen=True)
class Known(_Model):
    """The counts of the words that some names can be split into, out of a total of all words."""

    counts: dict[str, int]
    total: int

    def count(self, word: str) -> int:
        return self.counts.get(word, 0)


@dataclass(frozen=True)
class Unigrams(_Model):
    """A caller's own count-min sketch, counts[row][bucket]; no count is under the true one. judge() does not use it."""

    counts: np.ndarray
    total: int

    def count(self, word: str) -> int:
        raw = word.encode()
        return min(int(self.counts[row][zlib.crc32(b"%d:%b" % (row, raw)) % self.counts.shape[1]]) for row in range(len(self.counts)))


@dataclass(frozen=True)
class Vocabulary:
    """table(word, n), its words distinct, and the sum of n."""

    table: DataFrame
    total: int

    def known(self, names: list[str]) -> Known:
        """What a few names need, looked up at once."""
        asked = sorted({x for name in names for x in substrings(name)})
        return Known({r["word"]: r["n"] for r in self.table.where(F.col("word").isin(asked)).collect()} if asked else {}, self.total)

    def count(self, word: str) -> int:
        return self.known([word]).count(word)

    def segment(self, name: str) -> list[str]:
        return self.known([name]).segment(name)

    def bitmap(self) -> np.ndarray:
        """Bytes in which bit (xxhash64 of the word) mod BITMAP is set for every word."""
        bit = F.xxhash64("word").bitwiseAND(F.lit(BITMAP - 1))
        rows = self.table.select(F.floor(bit / BITMAP_ROW).alias("row"), (bit % BITMAP_ROW).alias("bit")).groupBy("row").agg(F.bitmap_construct_agg("bit").alias("bits"))
        out = np.zeros((BITMAP // BITMAP_ROW, BITMAP_ROW // 8), np.uint8)
        for row, bits in rows.collect():  # BITMAP / BITMAP_ROW rows at most
            out[row] = np.frombuffer(bits, np.uint8)
        return out.reshape(-1)


def substrings(name: str) -> Iterator[str]:
    """All of LONGEST letters or fewer, with repeats."""
    return (name[s:e] for s in range(len(name)) for e in range(s + 1, min(s + LONGEST, len(name)) + 1))


def count_words(pages: DataFrame, url_col: str = "url", html_col: str = "html", more: tuple[str, ...] = ()) -> Vocabulary:
    """Exact counts of the words of LONGEST characters or fewer in all pages: their visible text, their urls' paths, and
    those parts of hosts that hyphens show to be words; each of `more` counts once besides.

    Words are runs of letters, marks and digits of any script, lower-cased.
    """
    host, path = host_and_path(F.col(url_col))
    parted = F.concat_ws(" ", F.filter(F.split(host, r"\."), lambda x: x.contains("-")))
    text = F.concat_ws(" ", F.regexp_replace(F.coalesce(html_col, F.lit("")), "(?s)<[^>]*>", " "), path, parted)
    words = pages.select(F.explode(F.split(F.lower(text), NO_WORD)).alias("word")).where(F.length("word").between(1, LONGEST))
    if more:
        words = words.union(pages.sparkSession.createDataFrame([(w,) for w in more], "word string"))
    counts = Scratch(pages.sparkSession, "urls").write(words.groupBy("word").agg(F.count("*").alias("n")), "vocabulary")
    return Vocabulary(counts, counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])


def names_of(host: Column, path: Column) -> Column:
    """The names of a url, in order, as runs that may be words of count_words(): all of its host but the top-level domain, and its path.

    The last of several labels is the top-level domain if it starts with no digit; so numeric addresses keep all.
    """
    below = F.regexp_replace(host, r"\.[^.0-9][^.]*$", "")
    return F.filter(F.split(F.lower(F.concat_ws(" ", below, path)), NO_WORD), lambda x: x != "")


@dataclass(frozen=True)
class NaiveBayes:
    """Log odds of block against allow: a prior and a weight for each bucket of hashed words, 0 where no url has one.

    Numbers say nothing of a url and are left out.
    """

    prior: float
    weights: np.ndarray

    def log_odds(self, words: list[str]) -> float:
        return self.prior + float(sum(self.weights[zlib.crc32(w.encode()) % len(self.weights)] for w in words if any(map(str.isalpha, w))))


def segmented(rows: DataFrame, vocabulary: Vocabulary, scratch: Scratch) -> DataFrame:
    """rows(page_id, host, path, rule, verdict) with words: the names of the url, each split into words."""
    spark = rows.sparkSession
    named = rows.withColumn("names", names_of(F.col("host"), F.col("path")))
    kept = named.schema.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, names, size = [], set(), 0

        def block() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([held], pa.list_(kind)), pa.array([sorted(names)], pa.list_(pa.string()))], names=["urls", "names"])

        for batch in batches:
            kind = pa.struct(list(batch.schema))
            for row in batch.to_pylist():
                held.append(row)
                fresh = set(row["names"]) - names
                names |= fresh
                size += sum(map(len, fresh))
                if size >= BLOCK_CHARS or len(held) >= BLOCK_ROWS:
                    yield block()
                    held, names, size = [], set(), 0
        if held:
            yield block()

    blocks = named.mapInArrow(cut, f"urls array<{kept}>, names array<string>").withColumn("block", F.monotonically_increasing_id())
    blocks = scratch.write(blocks, "blocks")
    bitmap = spark.sparkContext.broadcast(vocabulary.bitmap())  # of fixed size

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = bitmap.value.tobytes()

        def passed(word: str) -> bool:
            bit = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"), 42) & (BITMAP - 1)
            return bits[bit >> 3] >> (bit & 7) & 1 == 1

        found = ((block, word) for batch in batches for block, names in zip(*(c.to_pylist() for c in batch.columns), strict=True) for word in {x for name in names for x in substrings(name)} if passed(word))
        yield from batched(found, pa.schema([("block", pa.int64()), ("word", pa.string())]))

    asked = blocks.select("block", "names").mapInArrow(candidates, "block long, word string")
    # A merge join at every size: no table of words is sent to all workers.
    found = asked.join(vocabulary.table.hint("merge"), "word").groupBy("block").agg(F.collect_list(F.struct("word", "n")).alias("known"))
    both = blocks.select("block", "urls").join(found.hint("merge"), "block", "left").select("urls", F.col("known.word").alias("known"), F.col("known.n").alias("counts"))
    total, columns = vocabulary.total, rows.columns

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                urls, known, counts = (batch.column(c).slice(i, 1) for c in range(3))
                model = Known(dict(zip(known.to_pylist()[0] or (), counts.to_pylist()[0] or (), strict=True)), total)
                parts = lru_cache(None)(model.segment)
                urls = urls.flatten()
                *plain, names = urls.flatten()
                words = [[w for name in x for w in parts(name)] for x in names.to_pylist()]
                yield pa.RecordBatch.from_arrays([*plain, pa.array(words, pa.list_(pa.string()))], names=[*columns, "words"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return scratch.write(both.mapInArrow(split, f"{schema}, words array<string>"), "segmented")


def train(rows: DataFrame, seeds: tuple[str, ...] = SEEDS) -> NaiveBayes:
    """rows(words) -> the classifier; rows without words teach nothing."""
    block = F.arrays_overlap("words", F.array(*map(F.lit, seeds))) if seeds else F.lit(False)
    cells = F.transform(F.filter("words", lambda w: w.rlike(r"\p{L}")), lambda w: (F.crc32(w) % CLASSES).cast("int"))
    known = rows.where(F.size("words") > 0).select(block.cast("long").alias("block"), F.explode(F.concat(F.array(F.lit(-1)), cells)).alias("cell"))
    table = np.zeros((2, CLASSES + 1))
    for cell, bad, every in known.groupBy("cell").agg(F.sum("block"), F.count("*")).collect():  # CLASSES + 1 rows at most
        table[:, cell] = bad, every - bad
    urls, counts = table[:, -1] + 1, table[:, :-1]
    seen = counts.sum(axis=0) > 0
    chance = (counts + SMOOTHING) / (counts.sum(axis=1, keepdims=True) + SMOOTHING * max(1, seen.sum()))
    return NaiveBayes(float(np.log(urls[0] / urls[1])), np.where(seen, np.log(chance[0] / chance[1]), 0.0))


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", rules: tuple[tuple[str, str], ...] = RULES, seeds: tuple[str, ...] = SEEDS) -> DataFrame:
    """(page_id, host, path, rule, verdict, log_odds): one row per row of pages.

    A url that no rule fits is blocked where the classifier's log odds are above zero. Null urls and those
    without '://' have neither host nor path, hence the prior's verdict. Repeated rows each get a row and count
    each; urls of any length are judged whole. No row gives no row. Other columns are not read.
    """
    host, path = host_and_path(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path")).withColumn("found", rule_of(F.col("host"), F.col("path"), rules))
    rows = rows.select("page_id", "host", "path", "found.rule", "found.verdict")
    rows = segmented(rows, count_words(pages, url_col, html_col, seeds), Scratch(pages.sparkSession, "urls"))
    model = train(rows, seeds)
    sent = pages.sparkSession.sparkContext.broadcast(model)  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, host, path, rule, verdict, words = batch.columns
            odds = [sent.value.log_odds(x) for x in words.to_pylist()]
            said = [v or ("block" if x > 0 else "allow") for v, x in zip(verdict.to_pylist(), odds, strict=True)]
            yield pa.RecordBatch.from_arrays([ids, host, path, rule, pa.array(said, pa.string()), pa.array(odds, pa.float64())], names=["page_id", "host", "path", "rule", "verdict", "log_odds"])

    kind = pages.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(run, f"page_id {kind}, host string, path string, rule string, verdict string, log_odds double")
