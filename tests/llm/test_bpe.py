import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from flatsql.llm import bpe, materialise

RANKS = bpe.load_ranks(bpe.default_vocabulary()[0])
OURS = bpe.encoder(*bpe.default_vocabulary())
THEIRS = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


@given(st.text(max_size=80))
@settings(max_examples=300, deadline=None)
def test_any_text(text):
    assert OURS.encode(text) == THEIRS.encode_ordinary(text)
    assert OURS.decode(OURS.encode(text)) == text.encode()


@pytest.mark.parametrize("text", ["", "a" * 3000, "ab" * 400, "x" * 127, "x" * 128, "x" * 129, "日" * 300, "the" * 50, " " * 200 + "a", "<|endoftext|>", "\x1c\x85\xa0 ²½", "don't we'll I'M"])
def test_long_and_odd_pieces(text):
    assert OURS.encode(text) == THEIRS.encode_ordinary(text)


def test_one_tree_and_lanes_agree():
    raw = b"unbelievablereputation"
    ids = OURS.single[np.frombuffer(raw, np.uint8)]
    one = bpe.merge_one(ids.tolist(), OURS.pairs.by_pair)
    lane = bpe.merge_lanes(np.pad(ids, (0, 32 - len(raw)))[None, :], np.array([len(raw)]), OURS.pairs)
    assert np.frombuffer(lane[0], "<u4").tolist() == one


def test_documents(spark):
    rows = [(1, "Hello world", 1), (1, "Hello world", 2), (2, None, 3), (None, "", 4), (3, "é" * 500, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    encoded = bpe.encode(docs)
    assert {(r.doc_id, bytes(r.decoded)) for r in bpe.decode(encoded).collect()} == {(i, (t or "").encode()) for i, t, _ in rows}
    found = bpe.digests(docs).collect()
    assert len(found) == 5 and {r.n_tokens for r in found if r.doc_id == 2} == {0}
    assert bpe.digests(docs.limit(0)).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 1000, 4097])
def test_permutation(n):
    assert sorted(materialise.Permutation(n, 5)(np.arange(n)).tolist()) == list(range(n))


def test_shards(spark, tmp_path):
    rows = [(i, " ".join(f"word{i * j}" for j in range(i * 7)) if i % 5 else None, "x") for i in range(60)] + [(1, "again", "x"), (1, "again", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, slot string").repartition(3)
    docs.write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    index = materialise.materialise(docs, f"{tmp_path}/shards", length=32, per_shard=50).collect()
    read = dict(materialise.read(f"{tmp_path}/shards"))
    assert sorted(read) == list(range(len(index))) and all(len(x) == 32 for x in read.values())
    assert [s for s, _ in materialise.read(f"{tmp_path}/shards", 70)] == list(range(70, len(index)))
    for doc, text, _ in rows[:60]:
        if doc == 1:
            continue
        parts = sorted((r.part, r.slot, r.n_tokens) for r in index if r.doc_id == doc)
        ids = np.concatenate([read[s][:n] for _, s, n in parts])
        assert OURS.decode(ids.tolist()) == (text or "").encode()
    assert [r.slot for r in sorted(index, key=lambda r: (r.shard, r.offset))] == list(range(len(index)))
    assert materialise.materialise(docs.limit(0), f"{tmp_path}/none").count() == 0


@given(st.lists(st.text(alphabet="ab's\n té²日!x1 ", max_size=60), min_size=1, max_size=12))
@settings(max_examples=60, deadline=None)
def test_few_remembered_pieces(texts):
    small = bpe.Encoder(RANKS, public_tokenizers.PATTERN, remembered=3)
    assert [np.frombuffer(x, "<u4").tolist() for x in small.encode_many(texts)] == [THEIRS.encode_ordinary(t) for t in texts]


def test_long_texts_are_cut_where_nothing_matches_across(monkeypatch):
    monkeypatch.setattr(bpe, "CHUNK", 50)
    texts = ["word two's  \n three " * 40, "x" * 400, None, "", " " * 300 + "a b", "a" * 49 + " \n" * 60]
    assert [np.frombuffer(x, "<u4").tolist() for x in OURS.encode_many(texts)] == [THEIRS.encode_ordinary(t or "") for t in texts]
    assert all("".join(bpe.cut_long(t or "", 50)) == (t or "") for t in texts)


def test_other_patterns():
    pattern = r"\p{N}{1,3}|[^\p{N}]+"
    ours, theirs = bpe.Encoder(RANKS, pattern), tiktoken.Encoding("other", pat_str=pattern, mergeable_ranks=RANKS, special_tokens={})
    for text in ("12345 abc", "", "日本 1 22 x"):
        assert ours.encode(text) == theirs.encode_ordinary(text)
    with pytest.raises(ValueError):
        bpe.Encoder(RANKS, r"\p{L}+").encode("a b")


def test_shards_lie_where_spark_resolves_the_path(spark, tmp_path):
    docs = spark.createDataFrame([(1, "one two three")], "doc_id long, text string")
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    before = conf.get("fs.defaultFS")
    conf.set("fs.defaultFS", f"file://{tmp_path}")
    try:
        assert materialise._qualified(spark, "/some/where") == "file:///some/where"
    finally:
        conf.set("fs.defaultFS", before or "file:///")
    index = materialise.materialise(docs, f"file://{tmp_path}/shards", length=4, per_shard=2).collect()
    assert len(index) == 1 and [s for s, _ in materialise.read(f"file://{tmp_path}/shards")] == [0]
    (tmp_path / "shards" / ".attempt-7").write_bytes(b"x")  # left by a lost task
    materialise.materialise(docs, f"file://{tmp_path}/shards", length=4, per_shard=2)
    assert sorted(x.name for x in (tmp_path / "shards").iterdir() if not x.name.startswith(".shard") and not x.name.endswith(".crc")) == ["manifest.json", "shard-00000000.bin"]
