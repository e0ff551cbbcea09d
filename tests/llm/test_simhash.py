import random

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from flatsql.llm import simhash
from flatsql.llm.common import Scratch
from flatsql.llm.components import connected_components


def slow_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@given(st.text(alphabet="abcAB É\t\n\x0b\x1f\u00a0", max_size=60))
@settings(max_examples=200, deadline=None)
def test_fingerprint(text):
    assert simhash.fingerprint(text) == slow_fingerprint(text)


@pytest.mark.parametrize("size", [1, 2, 5])
def test_other_shingle_sizes(size):
    for text in ("", "a", "a b", "a b c d e f a b"):
        words = text.encode().split()
        grams = [b" ".join(words[n : n + size]) for n in range(max(1, len(words) - size + 1))] if words else []
        hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        assert simhash.fingerprint(text, size) == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_long_text_and_spark_hash(spark):
    text = "x " * 2000 + "end"
    assert simhash.fingerprint(text) == slow_fingerprint(text)
    assert spark.range(1).select(F.xxhash64(F.lit("a b c"))).first()[0] % (1 << 64) == xxhash.xxh64_intdigest(b"a b c", 42)


def components(nodes, near):
    label = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a in nodes:
            for b in nodes:
                if near(a, b) and label[b] < label[a]:
                    label[a], changed = label[b], True
    return label


@pytest.mark.parametrize("bucket", [8192, 3])
def test_links_lose_none(spark, bucket):
    r = random.Random(bucket)
    prints = [r.getrandbits(64) for _ in range(30)]
    for base in prints[:6]:  # clusters and chains of up to 3 flipped bits a step
        for _ in range(12):
            base ^= sum(1 << b for b in r.sample(range(64), r.randint(1, 3)))
            prints.append(base)
    prints = sorted({p - (1 << 63) for p in prints})
    found = simhash.links(spark.createDataFrame([(p,) for p in prints], "fp long"), Scratch(spark, "test"), bucket=bucket).distinct().collect()
    near = lambda a, b: (a ^ b).bit_count() <= 3 if (a ^ b) >= 0 else ((a ^ b) % (1 << 64)).bit_count() <= 3
    assert all(near(a, b) for a, b in found)
    pairs = {(a, b) for a, b in found} | {(b, a) for a, b in found}
    assert components(prints, near) == components(prints, lambda a, b: (a, b) in pairs)


def test_components_of_a_long_chain(spark):
    chain = [(i, i + 1) for i in range(300)] + [(1000, 1001), (5, 5)]
    got = connected_components(spark.createDataFrame(chain, "a long, b long"), Scratch(spark, "test")).collect()
    assert len(got) == 303
    roots = {}
    for node, root in got:
        roots.setdefault(root, set()).add(node)
    assert sorted(map(len, roots.values())) == [2, 301]


def test_groups(spark):
    long = " ".join(f"w{i}" for i in range(400))
    rows = [(7, long, "x"), (3, long.upper(), "y"), (9, long + " more", None), (1, None, ""), (2, "", ""), (4, "two words", ""), (4, "two words", ""), (None, "alone here now", "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = [(r.doc_id, r.component_id) for r in simhash.near_duplicates(docs).collect()]
    assert sorted(got, key=str) == sorted([(7, 3), (3, 3), (9, 3), (1, 1), (2, 1), (4, 4), (4, 4), (None, None)], key=str)
    left = simhash.drop_near_duplicates(docs)
    assert left.columns == docs.columns and sorted(r.doc_id or 0 for r in left.collect()) == [0, 1, 3, 4, 4]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_forest():
    a = np.array([0, 1, 3, 7, 1 << 20, (1 << 20) + 1, 1 << 40], np.int64)
    assert len(list(simhash.forest(a, 1))) == 6
    top = np.array([5, 4 - (1 << 63), -(1 << 53) + 5], np.int64)  # bit 63 and one more; the 11 highest bits
    assert list(simhash.forest(top, 3)) == [(4 - (1 << 63), 5)]
