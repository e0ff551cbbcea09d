"""Toxicity by non-negative positive-unlabelled learning.

A linear model over hashed words is fitted with numpy from confirmed toxic texts and texts without any label. The
risk is prior * E_p[l(z)] + max(0, E_u[l(-z)] - prior * E_p[l(-z)]), l the sigmoid loss: the second term is the
negative class's risk as the unlabelled texts show it, corrected by the class prior and kept from going below zero.
The prior, the share of toxic texts among the unlabelled ones, is estimated from both: no score can be more frequent
among the unlabelled texts' toxic part than it is among all of them, so the least ratio of the two tails bounds it.
Rows that are labelled as not toxic are not used, and rows that the fold holds out are never read by the fit.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flatsql.llm.common import Scratch, slices

BUCKETS = 1 << 18
#: The fit takes at most so many confirmed toxic and so many unlabelled texts, those with the least hashes of their ids.
MAX_POSITIVE, MAX_UNLABELLED = 4000, 16000
#: Of a text's bytes: A-Z to a-z; other ASCII but letters and digits to a space.
WORDS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words(text: str | None) -> set[bytes]:
    return set((text or "").encode("utf-8", "surrogatepass").translate(WORDS).split())


def bucket(word: bytes) -> int:
    return zlib.crc32(word) & (BUCKETS - 1)


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


@dataclass(frozen=True)
class Model:
    """weights[bucket] and bias; a bounded size whatever the corpus: BUCKETS floats."""

    weights: np.ndarray
    bias: float

    def score(self, text: str | None) -> float:
        z = self.bias + sum(float(self.weights[bucket(w)]) for w in words(text))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


#: Words that are kept however few texts there are to tell by.
LEAST_WORDS = 32


def telling(in_p: np.ndarray, n_p: int, in_u: np.ndarray, n_u: int) -> np.ndarray:
    """Words whose shares of the positive and the unlabelled texts differ by more than chance would have it among so many
    words (a likelihood ratio test), and at least the LEAST_WORDS of the largest such ratios that are more frequent in
    positive texts, and in two of them."""
    both = (in_p + in_u).astype(float)
    fair = both * n_p / (n_p + n_u)
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = 2 * (np.where(in_p > 0, in_p * np.log(in_p / fair), 0) + np.where(in_u > 0, in_u * np.log(in_u / (both - fair)), 0))
    least = 2 * math.log(max(2, np.count_nonzero(both)))
    likely = np.where((in_p > 1) & (in_p > fair), ratio, 0)
    return (ratio > least) | (likely > 0) & (likely >= np.sort(likely)[-LEAST_WORDS])


def prior_of(positive: list[np.ndarray], unlabelled: list[np.ndarray]) -> float:
    """The share of positive texts among the unlabelled ones, as two models say that are each fitted on one half and
    asked about the other: the least ratio of the tails of their scores, each a standard error to the safe side."""
    scores: list[list[np.ndarray]] = [[], []]
    for half in range(2):
        model = fit(positive[half::2], unlabelled[half::2], 0.1)
        for kind, texts in enumerate((positive, unlabelled)):
            scores[kind].append(np.array([model.weights[np.unique(x)].sum() for x in texts[1 - half :: 2]]))
    p, u = (np.sort(np.concatenate(x)) for x in scores)
    at = np.unique(p)
    tail = lambda x: 1 - np.searchsorted(x, at) / max(1, len(x))
    a, b = tail(p), tail(u)
    use = a >= 0.2
    upper = b + np.sqrt(b * (1 - b) / max(1, len(u)))
    lower = a - np.sqrt(a * (1 - a) / max(1, len(p)))
    return float(np.clip((upper[use] / lower[use]).min(initial=0.5, where=lower[use] > 0), 0.001, 0.5))


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, steps: int = 600, rate: float = 0.05, l2: float = 1e-5) -> Model:
    """Fits on the texts' bucket arrays. No positive text, or a prior of zero: every score is the prior.

    A word's column is scaled by the log ratio of its share of the positive to that of the unlabelled texts.
    """
    prior = min(max(prior, 0.0), 1.0)
    if not positive or not unlabelled or prior in (0.0, 1.0):
        odds = min(max(prior, 1e-6), 1 - 1e-6)
        return Model(np.zeros(BUCKETS, np.float32), math.log(odds / (1 - odds)))
    texts = [np.unique(x) for x in (*positive, *unlabelled)]
    n_p, n_u = len(positive), len(unlabelled)
    flat = np.concatenate(texts).astype(np.int64)
    row = np.repeat(np.arange(len(texts)), [len(x) for x in texts])
    in_p = np.bincount(flat[row < n_p], minlength=BUCKETS)
    in_u = np.bincount(flat[row >= n_p], minlength=BUCKETS)
    ratio = np.log((in_p + 0.5) / (n_p + 1)) - np.log((in_u + 0.5) / (n_u + 1))
    scale = np.where(telling(in_p, n_p, in_u, n_u), ratio, 0.0)
    use = scale[flat] != 0
    flat, row = flat[use], row[use]
    columns, flat = np.unique(flat, return_inverse=True)
    value = scale[columns][flat]
    w, b = np.ones(len(columns)), math.log(prior / (1 - prior))
    moment = [np.zeros(len(w) + 1), np.zeros(len(w) + 1)]
    for step in range(1, steps + 1):
        z = b + np.bincount(row, value * w[flat], minlength=len(texts))
        s = 1 / (1 + np.exp(-np.clip(z, -30, 30)))  # the loss of a text as a negative one; as a positive one, 1 - s
        slope = s * (1 - s)
        g = np.zeros(len(texts))
        if s[n_p:].mean() - prior * s[:n_p].mean() >= 0:
            g[:n_p] = -2 * prior * slope[:n_p] / n_p
            g[n_p:] = slope[n_p:] / n_u
        else:  # the negative risk has gone below zero: step back from it
            g[:n_p] = prior * slope[:n_p] / n_p
            g[n_p:] = -slope[n_p:] / n_u
        grad = np.append(np.bincount(flat, value * g[row], minlength=len(w)) + l2 * w, g.sum())
        moment = [0.9 * moment[0] + 0.1 * grad, 0.99 * moment[1] + 0.01 * grad**2]
        move = rate * (moment[0] / (1 - 0.9**step)) / (np.sqrt(moment[1] / (1 - 0.99**step)) + 1e-8)
        w, b = w - move[:-1], b - float(move[-1])
    weights = np.zeros(BUCKETS, np.float32)
    weights[columns] = scale[columns] * w
    return Model(weights, b)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED) -> Model:
    """The model of the rows that are not held out: those labelled as toxic, by one label at least, against those without a label.

    Rows without an id are not used; rows that share an id share its label and each count. Null texts have no words.
    Of either kind at most so many ids are used, those with the least hashes. The driver holds the counts of BUCKETS
    words and, of the chosen texts, the telling words.
    """
    spark = docs.sparkSession
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).alias("toxic"))
    ids = docs.where(F.col(id_col).isNotNull() & ~held_out(id_col)).select(F.col(id_col).alias("id")).distinct()
    rank = F.xxhash64("id")
    positive = known.where("toxic = 1").join(ids, "id", "left_semi").orderBy(rank, "id").limit(max_positive)
    unlabelled = ids.join(known, "id", "left_anti").orderBy(rank, "id").limit(max_unlabelled)
    chosen = positive.select("id", F.lit(1).alias("part")).union(unlabelled.select("id", F.lit(0).alias("part")))  # at most max_positive + max_unlabelled rows

    def buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [sorted({bucket(w) for w in words(x)}) for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.int32())), batch.column(1)], names=["found", "part"])

    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id").select("text", "part")
    sample = Scratch(spark, "toxicity").write(texts.mapInArrow(buckets, "found array<int>, part int"), "sample")
    size = dict(map(tuple, sample.groupBy("part").count().collect()))
    n_p, n_u = size.get(1, 0), size.get(0, 0)
    counts = np.zeros((2, BUCKETS), np.int64)
    per_word = sample.select("part", F.explode("found").alias("word")).groupBy("word").agg(F.sum("part").cast("long"), F.count("*"))
    for word, of_p, every in per_word.collect():  # BUCKETS rows at most
        counts[:, word] = every - of_p, of_p
    told = set(np.flatnonzero(telling(counts[1], max(n_p, 1), counts[0], max(n_u, 1))).tolist())

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [[w for w in x if w in told] for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.int32())), batch.column(1)], names=["found", "part"])

    rows = sorted((r["part"], r["found"]) for r in sample.mapInArrow(kept, "found array<int>, part int").collect())  # sums do not depend on the order of tasks
    p, u = ([np.array(found, np.int32) for part, found in rows if part == kind] for kind in (1, 0))
    if not p or not u:
        return fit(p, u, 0.0)
    mixed = np.random.default_rng(1).permutation  # so that halves are alike
    p, u = [p[i] for i in mixed(len(p))], [u[i] for i in mixed(len(u))]
    return fit(p, u, prior_of(p, u))


def toxicity(model: Model, text_col: str = "text") -> Column:
    """The score of a text column, 0 to 1; null is scored like an empty text."""
    weights, bias = model.weights, model.bias

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        known: dict[bytes, float] = {}
        out = []
        for text in (x for at in range(0, len(texts), 500) for x in texts.slice(at, 500).to_pylist()):
            z = bias
            for w in words(text):
                x = known.get(w)
                if x is None:
                    if len(known) > 200_000:
                        known.clear()
                    x = known[w] = float(weights[zlib.crc32(w) & (BUCKETS - 1)])
                z += x
            out.append(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))
        return pa.array(out, pa.float64())

    return score(F.col(text_col))


def drop_toxic(docs: DataFrame, labels: DataFrame, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """docs without the rows that score threshold or more; see train() and toxicity(). Null texts are scored like empty
    ones, repeated rows share their fate, no row gives no row; all columns stay, whatever they are called."""
    return docs.where(toxicity(train(docs, labels), text_col) < threshold)
