"""The pipeline and the registered queries against plain Python, on the smallest tables."""

import hashlib
import os

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from flatsql.llm import bpe, decontam, queries, toxicity
from flatsql.llm.common import table

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables here")


def groups(texts):
    """Labels of near copies: sets of five-word shingles with a Jaccard similarity of 0.8 or more, as the stage promises."""
    sets = []
    for text in texts:
        w = text.encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    return label


def test_pipeline(spark):
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, DIR).collect()}
    docs = {r.doc_id: r.text for r in table(spark, DIR, "documents").collect()}
    model = toxicity.train(table(spark, DIR, "documents"), table(spark, DIR, "labels"))
    left = {i: t for i, t in docs.items() if model.score(t) < 0.5}
    assert 0.8 * len(docs) < len(left) < len(docs)
    best = {}
    for i, t in left.items():
        key = t.encode().lower()
        best[key] = max(best.get(key, -1), i)
    left = {i: docs[i] for i in best.values()}
    ids = sorted(left)
    label = groups([left[i] for i in ids])
    left = {i: left[i] for n, i in enumerate(ids) if label.index(label[n]) == n}
    windows = set()
    for r in table(spark, DIR, "benchmark").collect():
        w = decontam.words(r.text)
        windows |= {tuple(w[s : s + 13]) for s in range(max(1, len(w) - 12))} if w else set()
    sizes = {len(w) for w in windows}

    def contaminated(text):
        w = decontam.words(text)
        hit = {j for n in sizes for s in range(len(w) - n + 1) if tuple(w[s : s + n]) in windows for j in range(s, s + n)}
        return bool(hit) and 20 * len(hit) >= len(w)

    left = {i: t for i, t in left.items() if not contaminated(t)}
    assert sorted(got) == sorted(left)
    known = bpe.encoder(*bpe.default_vocabulary())
    for i, t in left.items():
        assert got[i].ids_sha256 == hashlib.sha256(np.array(known.encode(t), "<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_queries_with_sql(spark, name):
    con = duckdb.connect()
    for file in os.listdir(DIR):
        con.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{DIR}/{file}'")
    df = queries.QUERIES[name](spark, DIR)
    got = sorted(str(tuple(r)) for r in df.collect())
    assert got == sorted(str(r) for r in con.execute(f"SELECT {', '.join(df.columns)} FROM ({queries.ORACLE_SQL[name]})").fetchall())


def test_url_verdicts_cover_every_page(spark):
    pages = table(spark, DIR, "pages").count()
    found = queries.QUERIES["op3_url_filter"](spark, DIR).collect()
    assert len(found) == pages and {r.verdict for r in found} <= {"allow", "block"}
