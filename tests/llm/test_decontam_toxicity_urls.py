import random

import numpy as np

from flatsql.llm import decontam, toxicity, urlfilter


def slow(docs, items, window):
    out = {}
    for n, text in enumerate(docs):
        words, hit, found = decontam.words(text), set(), set()
        for item, body in items:
            w = decontam.words(body)
            size = min(window, len(w))
            for s in range(len(w) - size + 1) if w else []:
                for d in range(len(words) - size + 1):
                    if words[d : d + size] == w[s : s + size]:
                        hit.update(range(d, d + size))
                        found.add(item)
        out[n] = (len(words), len(hit), len(found))
    return out


def test_phrases_in_one_and_in_many_blocks(spark):
    r = random.Random(4)
    word = lambda: r.choice("alpha Beta gamma délta e f g h".split())
    items = [(f"i{n}", " ".join(word() for _ in range(r.randint(0, 9)))) for n in range(12)] + [("empty", None)]
    docs = [" ".join(word() for _ in range(r.randint(0, 40))) for _ in range(40)] + ["", None, "!!!", items[0][1].upper() + "-" + (items[3][1] or "")]
    frame = spark.createDataFrame([(n, t, "x") for n, t in enumerate(docs)] + [(0, docs[0], "x")], "doc_id long, text string, row string")
    bench = spark.createDataFrame(items, "item_id string, text string")
    want = slow(docs, items, 4)
    for block_bytes in (1 << 20, 60):
        found = decontam.matches(frame, bench, window=4, block_bytes=block_bytes).collect()
        assert len(found) == len(docs) + 1
        for r_ in found:
            assert (r_.n_words, decontam.covered(r_.starts, r_.ends), len(r_.item_ids)) == want[r_.doc_id]
    assert decontam.contamination(frame.limit(0), bench, window=4).count() == 0
    assert {r_.n_hit for r_ in decontam.contamination(frame, bench.limit(0), window=4).collect()} == {0}
    assert decontam.drop_contaminated(frame, bench).columns == frame.columns


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "x red a green b blue y"), (2, "blue red green"), (3, "red green"), (4, "red z z z z green blue")], "doc_id long, text string")
    items = spark.createDataFrame([("q", "red green blue")], "item_id string, text string")
    found = {r.doc_id: list(zip(r.starts, r.ends)) for r in decontam.matches(docs, items, slop=2).collect()}
    assert found == {1: [(1, 6)], 2: [(0, 3)], 3: [], 4: []}


def test_toxicity_learns_from_positive_and_unlabelled(spark):
    r = random.Random(2)
    plain = [f"w{i}" for i in range(300)]
    make = lambda bad: " ".join(r.choice(plain) for _ in range(60)) + (" vile awful " if bad else "")
    rows = [(i, make(i % 8 == 0), "x") for i in range(1200)]
    docs = spark.createDataFrame([*rows, (None, None, "x"), (5000, "", "x")], "doc_id long, text string, toxic string")
    labels = spark.createDataFrame([(i, int(i % 8 == 0)) for i in range(0, 1200)] + [(None, 1), (7, None)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    got = docs.select("doc_id", toxicity.toxicity(model).alias("score"), toxicity.held_out().alias("held_out")).collect()
    test = [x for x in got if x.held_out and x.doc_id is not None and x.doc_id < 1200]
    assert len(test) > 150 and sum((x.score >= 0.5) == (x.doc_id % 8 == 0) for x in test) >= 0.97 * len(test)
    assert all(0 <= x.score <= 1 for x in got) and next(x.score for x in got if x.doc_id == 5000) < 0.5
    left = toxicity.drop_toxic(docs, labels)
    assert left.columns == docs.columns and 1000 < left.count() < 1100
    assert toxicity.train(docs, labels.limit(0)).score("anything") < 0.01


def test_risk_stays_non_negative():
    positive = [np.array([1, 2])] * 5
    model = toxicity.fit(positive, [np.array([1, 2]), *[np.array([3 + i]) for i in range(9)]] * 3, 0.3)
    assert np.isfinite(model.bias) and np.isfinite(model.weights).all()


def test_urls(spark):
    urls = ["https://www.Foo.NET/a?b", "http://x.example.net/en/1#t", "http://example.net", "http://example.com/de/x", "http://a.org/fr/", "http://a.org/frx/", None, "nothing", "ftp://h?q://z", "http://notnet/"]
    pages = spark.createDataFrame([(i, u, "<p>spam farm casino win spam</p>", "r") for i, u in enumerate(urls)], "page_id long, url string, html string, rule string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlfilter.judge(pages).collect()}
    assert got[0] == ("www.foo.net", "/a", "net/", "block")
    assert got[1] == ("x.example.net", "/en/1", "example.net/en/", "allow")
    assert got[2][:3] == ("example.net", "", None)
    assert got[3][2:] == ("example.com/de/", "block") and got[4][2:] == ("org/fr/", "allow")
    assert got[5][2] is None and got[6][:3] == ("", "", None) and got[7][:3] == ("", "", None)
    assert got[8][:2] == ("h", "") and got[9][2] is None
    assert urlfilter.judge(pages.limit(0)).count() == 0
    unigrams = urlfilter.count_words(pages)
    assert unigrams.segment("spamfarm") == ["spam", "farm"] and unigrams.segment("") == []


def test_segmentation_against_brute_force():
    counts = np.zeros((2, 1 << 12), np.int64)
    import zlib

    words = {"a": 5, "ab": 3, "b": 2, "abc": 4, "c": 1, "bc": 6}
    for w, n in words.items():
        for row in range(2):
            counts[row][zlib.crc32(f"{row}:{w}".encode()) % (1 << 12)] += n
    unigrams = urlfilter.Unigrams(counts, sum(words.values()))

    def best(s):
        if not s:
            return 0.0
        return max(unigrams.log_probability(s[:i]) + best(s[i:]) for i in range(1, len(s) + 1))

    for s in ("abc", "aabbc", "cab", "bcabca", "xyz"):
        assert abs(sum(map(unigrams.log_probability, unigrams.segment(s))) - best(s)) < 1e-9


def test_words_are_counted_exactly(spark):
    import zlib
    from itertools import product

    from flatsql.llm.common import Scratch

    cells = {}  # two words that share both cells of a sketch of 2 x 2^17 crc32 values
    for letters in product("abcdefghij", repeat=7):
        word = "".join(letters)
        other = cells.setdefault(tuple(zlib.crc32(f"{row}:{word}".encode()) % (1 << 17) for row in (0, 1)), word)
        if other != word:
            break
    rows = [(n, f"http://{word}{other}.blog.example.com/{'spamfarm' * n}", f"<p>spam farm {word}</p>") for n in range(9)]
    pages = spark.createDataFrame([*rows, (None, None, None)], "page_id long, url string, html string").repartition(3)
    found = urlfilter.count_words(pages)
    assert found.count(word) == 9 and found.count(other) == 0
    assert found.segment(word) == [word]
    host, path = urlfilter.host_and_path(pages.url)
    nothing = urlfilter.F.lit(None).cast("string")
    got = urlfilter.segmented(pages.select("page_id", host.alias("host"), path.alias("path"), nothing.alias("rule"), nothing.alias("verdict")), found, Scratch(spark, "test")).collect()
    assert len(got) == 10
    for r in got:
        names = (r.host.removesuffix(".example.com") + " " + r.path.strip("/")).replace(".", " ").split()
        assert "".join(r.words).startswith("".join(names[:1])) and all("".join(found.segment(n)) == n for n in names)
        assert [w for n in names for w in found.segment(n)] == [w for w in r.words if w != "example"]


def test_all_labels_below_the_top_level_are_judged(spark):
    from flatsql.llm.common import Scratch

    urls = ["http://www.cheapcasino.com/", "http://cheapcasino.com/", "http://m.cheapcasino.com:80/Bücher7", "http://größe.de", "http://10.0.2.7/x", "localhost", "http://localhost"]
    pages = spark.createDataFrame([(n, u, "cheap casino bücher größe") for n, u in enumerate(urls)], "page_id long, url string, html string")
    host, path = urlfilter.host_and_path(pages.url)
    nothing = urlfilter.F.lit(None).cast("string")
    rows = pages.select("page_id", host.alias("host"), path.alias("path"), nothing.alias("rule"), nothing.alias("verdict"))
    got = {r.page_id: list(r.words) for r in urlfilter.segmented(rows, urlfilter.count_words(pages), Scratch(spark, "test")).collect()}
    assert got[0] == ["www", "cheap", "casino"] and got[1] == ["cheap", "casino"]
    assert got[2] in (["m", "cheap", "casino", "bücher7"], ["m", "cheap", "casino", "bücher", "7"])
    assert got[3] == ["größe"] and got[4] == ["10", "0", "2", "7", "x"] and got[5] == [] and got[6] == ["localhost"]


def test_items_without_id_are_searched(spark):
    import hashlib

    docs = spark.createDataFrame([(1, "a b c d x"), (2, "e f g h"), (3, "y z")], "doc_id long, text string")
    items = spark.createDataFrame([(None, "a b c d"), (None, "e f g h"), ("i", "a b c d"), ("j", "q q q q")], "item_id string, text string")
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    got = {r.doc_id: (r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontam.contamination(docs, items, window=4).collect()}
    assert got == {1: (4, 2, sha("i"), True), 2: (4, 1, sha(""), True), 3: (0, 0, sha(""), False)}
    for block_bytes in (1 << 20, 5):
        found = {r.doc_id: (r.item_ids, decontam.covered(r.starts, r.ends)) for r in decontam.matches(docs, items, window=4, block_bytes=block_bytes).collect()}
        assert found == {1: (["i", None], 4), 2: ([None], 4), 3: ([], 0)}
    assert [r.doc_id for r in decontam.drop_contaminated(docs, items).collect()] == [3]


def test_a_kept_index_serves_other_items(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b c d x " * 3), (2, "e, F-g h"), (None, None), (4, "!!!")], "doc_id long, text string")
    decontam.build_index(docs, gap=6).write.parquet(f"{tmp_path}/index")
    index = spark.read.parquet(f"{tmp_path}/index")
    for text, want in (("a b c d", {1: 12, 2: 0, None: 0, 4: 0}), ("f g h", {1: 0, 2: 3, None: 0, 4: 0}), ("", {1: 0, 2: 0, None: 0, 4: 0})):
        items = spark.createDataFrame([("i", text)], "item_id string, text string")
        found = decontam.matches(docs, items, window=4, index=index).collect()
        assert {r.doc_id: decontam.covered(r.starts, r.ends) for r in found} == want


def test_shares_are_exact(spark):
    docs = spark.createDataFrame([(1, "a b c " + "x " * 97), (2, "a b c " + "x " * 98)], "doc_id long, text string")
    items = spark.createDataFrame([("i", "a b c")], "item_id string, text string")
    assert {r.doc_id: r.contaminated for r in decontam.contamination(docs, items, share=0.03).collect()} == {1: True, 2: False}


def test_scratch_tables_can_be_dropped(spark, tmp_path):
    import os

    from flatsql.llm import common

    job = common.Scratch(spark, "dropped")
    job.write(spark.range(3), "t")
    folder = job.dir.removeprefix("file:")
    assert os.path.isdir(folder)
    common.drop_scratch()
    assert not os.path.isdir(folder)
