import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from flatsql.llm import automaton, suffixarray
from flatsql.llm.repeats import merged


@given(st.lists(st.lists(st.binary(max_size=25).map(lambda b: bytes(x % 3 for x in b)), min_size=1, max_size=4), min_size=1, max_size=4), st.integers(1, 6))
@settings(max_examples=150, deadline=None)
def test_repeated_strings(shards, length):
    for texts, found in zip(shards, suffixarray.repeated_starts(shards, length), strict=True):
        count = {}
        for t in texts:
            for i in range(len(t) - length + 1):
                count[t[i : i + length]] = count.get(t[i : i + length], 0) + 1
        assert [x.tolist() for x in found] == [[i for i in range(len(t) - length + 1) if count[t[i : i + length]] > 1] for t in texts]


@given(st.lists(st.lists(st.integers(1, 4), max_size=30), min_size=1, max_size=4))
@settings(max_examples=150, deadline=None)
def test_suffix_arrays_and_prefixes(lanes):
    symbols, lane, want = [], [], []
    for n, values in enumerate(lanes):
        used = sorted(set(values))
        coded = [used.index(v) + 1 for v in values] + [0]
        want += [len(symbols) + i for i in sorted(range(len(coded)), key=lambda i, c=coded: c[i:])]
        symbols += coded
        lane += [n] * len(coded)
    symbols, lane = np.array(symbols), np.array(lane)
    order = suffixarray.suffix_arrays(symbols, lane)
    assert order.tolist() == want
    shared = suffixarray.common_prefixes(symbols, lane, order)
    for a, b in zip(order, order[1:], strict=False):
        n = 0
        while lane[a] == lane[b] and max(a, b) + n < len(symbols) and symbols[a + n] == symbols[b + n]:
            n += 1
        if lane[a] == lane[b]:
            assert shared[b] == n


def rows_with_repeats(sep, vocabulary, seed):
    r = random.Random(seed)
    draw = lambda n: sep.join(r.choice(vocabulary) for _ in range(n))
    hot, rows = draw(60), []
    for i in range(90):
        text = draw(r.randint(0, 60))
        if i % 3 == 0:
            text = sep.join([text, hot, draw(r.randint(0, 20))])
        if i % 10 == 1:
            text = rows[r.randrange(len(rows))][1]
        rows.append((i if i % 17 else None, text, "x"))
    return rows + [(500, None, "x"), (500, "", "x"), (501, "é" * 90, "x"), (502, sep.join(["a"] * 200), "x"), (7, rows[7][1], "x")]


def brute(rows, split, join, length):
    units, count = [split(t) for _, t, _ in rows], {}
    for u in units:
        for i in range(len(u) - length + 1):
            count[tuple(u[i : i + length])] = count.get(tuple(u[i : i + length]), 0) + 1
    out = []
    for (doc, _, _), u in zip(rows, units, strict=True):
        gone = {j for i in range(len(u) - length + 1) if count[tuple(u[i : i + length])] > 1 for j in range(i, i + length)}
        out.append((str(doc), len(u), len(gone), join([x for j, x in enumerate(u) if j not in gone])))
    return sorted(out)


@pytest.mark.parametrize("kind", ["bytes", "words"])
def test_against_brute_force(spark, kind):
    if kind == "bytes":
        rows = rows_with_repeats("", [chr(97 + i) for i in range(20)] + ["é", "日"], 1)
        finder, want = suffixarray.ByteRepeats(24, 8, 4), brute(rows, lambda t: list((t or "").encode()), bytes, 24)
    else:
        rows = rows_with_repeats(" ", [f"w{i}" for i in range(30)], 2)
        finder, want = automaton.WordRepeats(12, 4, 4), brute(rows, lambda t: (t or "").encode().split(), b" ".join, 12)
    docs = spark.createDataFrame(rows, "doc_id long, text string, h string")
    got = sorted((str(r.doc_id), r.n, sum(s["end"] - s["start"] for s in r.spans), bytes(r.kept)) for r in finder.find(docs).collect())
    assert got == want and sum(x[2] for x in want) > 1000
    assert finder.find(docs.limit(0)).count() == 0


def test_reference(spark):
    docs = spark.createDataFrame([(1, "a b c d e f x", 1), (2, "f e d c", 2), (3, None, 3)], "doc_id long, text string, n int")
    reference = spark.createDataFrame([("b c d e",), ("e d c",), (None,)], "text string")
    for block in (1, 1000):
        got = {r.doc_id: bytes(r.kept) for r in automaton.remove_reference(docs, reference, length=3, block_words=block).collect()}
        assert got == {1: b"a f x", 2: b"f", 3: b""}


def test_spans_merge():
    assert merged([(5, 9), (0, 3), (3, 4), (8, 12)]) == [(0, 4), (5, 12)]
