import random

import numpy as np
import pytest

import corpus_pipeline
from flatsql.llm import jaccard, simhash
from flatsql.llm.common import Scratch


def slow_groups(texts):
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    label = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            if len(a & sets[j]) >= 0.8 * len(a | sets[j]):
                x, y = label[i], label[j]
                label = [min(x, y) if z in (x, y) else z for z in label]
    return label


def made(seed):
    """Copies with a few words changed, chains of them, a line that many texts share, short and empty texts."""
    r = random.Random(seed)
    word = lambda: f"w{r.randrange(5000)}"
    line = [word() for _ in range(60)]
    texts = [None, "", " ", "one two", "one Two", "three"]
    for _ in range(12):
        base = [word() for _ in range(r.randint(60, 200))]
        for _ in range(r.randint(1, 12)):
            texts.append(" ".join(base))
            base[r.randrange(len(base))] = word()
    texts += [" ".join(line + [word() for _ in range(r.randint(10, 40))]) for _ in range(40)]
    return texts


def test_near_dedup_reaches_a_similarity_of_four_fifths(spark):
    texts = made(1)
    docs = spark.createDataFrame([(n, t, "x") for n, t in enumerate(texts)] + [(None, "alone", "y")], "doc_id long, text string, own string").repartition(3)
    left = corpus_pipeline.near_dedup(spark, docs, "")
    label = slow_groups(texts)
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.collect() if r.doc_id is not None) == [n for n in range(len(texts)) if label[n] == n]
    assert left.where("doc_id is null").count() == 1
    assert corpus_pipeline.near_dedup(spark, docs.limit(0), "").count() == 0


@pytest.mark.parametrize(("chunk", "stars"), [(512, 0), (5, 0), (5, 3)])
def test_pairs_of_open_buckets_lose_none(spark, chunk, stars):
    texts = made(2)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = jaccard._signed(docs, "doc_id", "text", 5).withColumnRenamed("doc_id", "node")
    got = dict(jaccard.similar_groups(rows, Scratch(spark, "test"), chunk=chunk, stars=stars, huge=1).collect())
    label = slow_groups(texts)
    groups = lambda of: {frozenset(n for n in range(len(texts)) if of(n) == root) for root in map(of, range(len(texts)))}
    assert groups(lambda n: got.get(n, n)) == groups(lambda n: label[n])


def test_similarity():
    a, b = (np.arange(lo, hi, dtype=np.uint64) for lo, hi in ((0, 9), (1, 10)))
    assert jaccard.similarity(a, b) == 0.8 and list(jaccard.cross_links([7, 8], [7, 8], [a, b], 0.8)) == [(7, 8)]


def test_candidates_are_those_of_simhash(spark, monkeypatch):
    """What the stage drops lies in a component of wide SimHash fingerprints; where these link nothing, nothing is dropped."""
    docs = spark.createDataFrame(list(enumerate(made(3))), "doc_id long, text string")
    left = {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()}
    assert len(left) < docs.count()
    joined = []

    def nothing(rows, *args):
        roots = components(rows, *args)
        joined.extend(r.doc_id for r in rows.join(roots, "node").collect())
        return roots.limit(0)

    components = jaccard.components
    monkeypatch.setattr(jaccard, "components", nothing)
    assert corpus_pipeline.near_dedup(spark, docs, "").count() == docs.count()
    assert {n for n in range(docs.count())} - left <= set(joined)


@pytest.mark.parametrize("bucket", [8192, 4])
def test_components_of_wide_fingerprints(spark, bucket):
    """Also where buckets are over their bound and dealt out: just what links within the distance join, but for keys not shared."""
    texts = made(4)
    prints = np.stack([simhash.wide_fingerprint(jaccard.shingles(t)) for t in texts])
    near = [[int((a != b).sum()) for b in prints] for a in prints]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = jaccard._signed(docs, "doc_id", "text", 5).withColumnRenamed("doc_id", "node")
    got = dict(jaccard.components(rows, Scratch(spark, "test"), bucket=bucket).collect())
    root = lambda n: got.get(n, n)
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if near[i][j] <= simhash.WIDE_DISTANCE:
                x, y = label[i], label[j]
                label = [min(x, y) if z in (x, y) else z for z in label]
                if near[i][j] <= 0.1875 * simhash.WIDE:
                    assert root(i) == root(j)
    for i in range(len(texts)):
        assert label[i] == label[root(i)]
    assert len(got) > 50


def test_wide_keys_miss_few():
    """Sets of 4 and 5 shingles and larger ones at a similarity of 0.8, drawn at random: within the distance, and under a common key."""
    r = np.random.default_rng(5)
    assert all(simhash.missed(*simhash.plan(n)) <= simhash.MISS for n in (0, 1000, 250_000, 15_000_000))
    for common, a, b in ((4, 0, 1), (8, 1, 1), (160, 20, 20)):
        for _ in range(200):
            h = r.integers(0, 1 << 63, common + a + b, dtype=np.uint64)
            prints = np.stack([simhash.wide_fingerprint(h[: common + a]), simhash.wide_fingerprint(np.append(h[:common], h[common + a :]))])
            x, y = simhash.wide_keys(prints, *simhash.plan(250_000))
            assert (prints[0] != prints[1]).sum() <= simhash.WIDE_DISTANCE and (x == y).any()


def near_prints(seed, members, others, flips):
    """Fingerprints at random, the first `members` of them one with a few bits changed in each."""
    r = np.random.default_rng(seed)
    bits = r.integers(0, 2, (members + others, simhash.WIDE), dtype=np.uint8)
    bits[:members] = bits[0]
    for row in bits[:members]:
        row[r.permutation(simhash.WIDE)[:flips]] ^= 1
    return bits


def test_keys_do_not_grow_with_the_table():
    """What goes through the shuffle for a document is the same from the smallest table to 30 GB of text."""
    assert len({simhash.plan(n) for n in (0, 50_000, 250_000, 15_000_000)}) == 1


def test_links_are_no_more_than_join(spark):
    """A group whose members meet under every key gives a spanning forest, not links that grow with its pairs and the keys."""
    members = 300
    prints = near_prints(6, members, 100, 6)
    keys = simhash.wide_keys(prints, *simhash.plan(0))
    rows = [(n, [int(k) for k in own], np.packbits(x, bitorder="little").tobytes()) for n, (x, own) in enumerate(zip(prints, keys, strict=True))]
    found, rest = simhash.wide_links(spark.createDataFrame(rows, "node long, keys array<long>, print binary"), Scratch(spark, "test"))
    links = [tuple(r) for part in found for r in part.collect()]
    assert {n for pair in links for n in pair} == set(range(members)) and rest.count() == 0
    assert members - 1 <= len(links) <= simhash.FIRST * (members - 1)


@pytest.mark.parametrize("known", [0, 400])
def test_search_in_a_large_bucket(known):
    """Of over WHOLE fingerprints, inner keys are shared by those that lie close; what is joined already is not joined again."""
    members = 700
    bits = near_prints(7, members, 1300, 20)
    r = np.random.default_rng(8)
    for at in range(members, members + 400, 2):  # pairs at the distance that keys are made for, and beyond the bound
        bits[at + 1] = bits[at]
        bits[at + 1, r.permutation(simhash.WIDE)[: 96 if at < members + 200 else 140]] ^= 1
    words = np.packbits(bits, axis=1, bitorder="little").view("<u8")
    groups = np.where(np.arange(len(words)) < known, 0, np.arange(len(words)))
    found = list(simhash.wide_forest(words, simhash.WIDE_DISTANCE, groups, seed=3))
    assert all((bits[a] != bits[b]).sum() <= simhash.WIDE_DISTANCE for a, b in found)
    inside = [pair for pair in found if max(pair) < members]
    assert len(inside) == members - max(known, 1) and {n for pair in inside for n in pair} >= set(range(known, members))
    pairs = {(min(x), max(x)) for x in found if max(x) >= members}
    assert pairs <= {(at, at + 1) for at in range(members, members + 200, 2)} and len(pairs) >= 85
