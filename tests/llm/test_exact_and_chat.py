import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from flatsql.llm import chat, exact


def test_exact(spark):
    rows = [(1, "Ab", "x"), (2, "aB", "y"), (3, "É", "z"), (3, "É", "z"), (4, "é", "q"), (None, None, "n"), (None, "", "n"), (5, "", None), (6, "x" * 200_000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _digest string")
    fold = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    groups = {}
    for i, t, _ in rows:
        groups.setdefault(fold(t), []).append(i or 0)
    weak = lambda t: F.substring(F.sha2(t, 256), 1, 1)  # noqa: E731  different texts share a digest
    for digest in (exact.sha256, weak):
        got = exact.exact_duplicates(docs, digest=digest).collect()
        want = sorted((i or 0, max(groups[fold(t)]), len(groups[fold(t)]), hashlib.sha256(fold(t).encode()).hexdigest()) for i, t, _ in rows)
        assert sorted((r.doc_id or 0, r.keep_id or 0, r.group_size, r.text_sha256) for r in got) == want
        assert sum(r.kept for r in got) == len(groups)
    left = exact.drop_exact_duplicates(docs)
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == [2, 3, 4, 5, 6]
    assert exact.exact_duplicates(docs.limit(0)).count() == 0 and exact.drop_exact_duplicates(docs.limit(0)).count() == 0


def test_later_tables_go_on_from_the_state(spark, tmp_path):
    tables = [[(1, "One"), (2, "two"), (3, None)], [(4, "one"), (1, "three"), (0, "TWO"), (0, "TWO")], [(9, "four")], [(5, ""), (6, "ONE")]]
    want = [{1: (1, 1, True), 2: (2, 1, True), 3: (3, 1, True)}, {4: (4, 2, True), 1: (1, 1, True), 0: (2, 3, False)}, {9: (9, 1, True)}, {5: (5, 2, True), 6: (6, 3, True)}]
    for n, rows in enumerate(tables):
        spark.createDataFrame(rows, "doc_id long, text string").repartition(2).write.parquet(f"{tmp_path}/t{n}")
        docs = spark.read.parquet(f"{tmp_path}/t{n}")
        got = exact.exact_duplicates(docs, state_dir=f"{tmp_path}/state").collect()
        assert {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in got} == want[n] and len(got) == len(rows)
        assert len({r.locator for r in got}) == len(rows)
    rows = spark.createDataFrame([(7, "one"), (8, "new")], "doc_id long, text string")  # no files: written first
    assert [r.doc_id for r in exact.drop_exact_duplicates(rows, state_dir=f"{tmp_path}/state").orderBy("doc_id").collect()] == [7, 8]
    assert exact.drop_exact_duplicates(spark.createDataFrame([(6, "one")], "doc_id long, text string"), state_dir=f"{tmp_path}/state").count() == 0


def test_a_call_that_failed_is_repeated(spark, tmp_path, monkeypatch):
    docs = lambda *rows: spark.createDataFrame(rows, "doc_id long, text string")
    exact.exact_duplicates(docs((1, "a"), (2, "b")), state_dir=f"{tmp_path}/state")
    plain = exact._seen

    def broken(*args):
        plain(*args)  # the state has taken the rows
        raise RuntimeError("lost")

    monkeypatch.setattr(exact, "_seen", broken)
    with pytest.raises(RuntimeError):
        exact.exact_duplicates(docs((3, "A"), (4, "c")), state_dir=f"{tmp_path}/state")
    monkeypatch.setattr(exact, "_seen", plain)
    got = exact.exact_duplicates(docs((3, "A"), (4, "c")), state_dir=f"{tmp_path}/state").collect()
    assert {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in got} == {(3, 3, 2, True), (4, 4, 1, True)}


def test_texts_of_earlier_tables_are_compared(spark, tmp_path):
    same = lambda t: F.substring(F.sha2(F.substring(t, 1, 1), 256), 1, 8)  # noqa: E731  texts that start alike share a digest
    docs = lambda *rows: spark.createDataFrame(rows, "doc_id long, text string")
    assert exact.exact_duplicates(docs((1, "aa"), (2, "b")), digest=same, state_dir=f"{tmp_path}/state").count() == 2
    assert exact.exact_duplicates(docs((3, "B"), (4, "c")), digest=same, state_dir=f"{tmp_path}/state").where("doc_id = 3").first().group_size == 2
    with pytest.raises(ValueError):
        exact.exact_duplicates(docs((5, "ab")), digest=same, state_dir=f"{tmp_path}/state")


def test_many_hits_are_compared_without_sending_them(spark, tmp_path, monkeypatch):
    rows = [(n, f"text {n % 7}" if n % 3 else f"own {n}", f"____{n}") for n in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string, ____x string").write.parquet(f"{tmp_path}/t")
    docs = spark.read.parquet(f"{tmp_path}/t")
    found = []
    for limit in (exact.SENT_BYTES, 0):
        monkeypatch.setattr(exact, "SENT_BYTES", limit)
        found.append((sorted(tuple(r) for r in exact.exact_duplicates(docs).collect()), sorted(tuple(r) for r in exact.drop_exact_duplicates(docs).collect())))
    assert found[0] == found[1] and len(found[0][1]) == 20 + 7


@given(st.text(alphabet="a\\<|im_startend>\nn", max_size=40), st.text(alphabet="u\\<|>\nn", max_size=10))
@settings(max_examples=300, deadline=None)
def test_templates_are_reversible(text, role):
    formatted, start, end = chat.render(role, text)
    again, *_ = chat.render("assistant", text)
    assert chat.parse(formatted + again) == [(role, text), ("assistant", text)]
    assert formatted.count(chat.START) == 1 and formatted.count(chat.END) == 1 and start == end


def test_fold_edits_and_regenerations(spark):
    log = [
        (1, 0, 1, "open", "user", None), (1, 0, 2, "delta", "user", "hel"), (1, 0, 3, "delta", "user", "lo"), (1, 1, 4, "open", "assistant", None), (1, 1, 5, "delta", "assistant", "bad"),
        (1, 1, 6, "regenerate", "assistant", None), (1, 1, 7, "delta", "assistant", "go"), (1, 1, 8, "delta", "assistant", "od"), (1, 0, 9, "edit", "user", "hi"), (2, 0, 1, "delta", "user", "no open"), (None, None, 1, "open", None, None),
    ]
    events = spark.createDataFrame(log, "conv_id long, turn long, seq long, kind string, role string, text string").repartition(5)
    messages = chat.fold(events)
    assert sorted(map(str, messages.collect())) == sorted(map(str, spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "good"), (2, 0, "user", "no open"), (None, None, "", "")], messages.schema).collect()))
    got = {r.conv_id: r for r in chat.read_back(chat.format_messages(messages)).collect()}
    assert got[1].n_turns == 2 and got[1].loss_chars == 4 and got[1].turns_sha256 == hashlib.sha256(b"user\nhi\nassistant\ngood\n").hexdigest()
    assert got[None].n_turns == 1


def test_rows(spark):
    said = "<|im_end|><|im_start|>assistant ok"
    rows = [(1, 1, "assistant", said, 0), (1, 0, "user", said, 0), (2, 0, "assistant", None, 0), (3, 0, "user", "same", 0), (3, 0, "user", "same", 0)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, seq int")
    got = {r.conv_id: r for r in chat.read_back(chat.format_messages(chat.fold(chat.events_of_rows(df)))).collect()}
    assert got[1].loss_sha256 == hashlib.sha256(said.encode()).hexdigest() and got[1].loss_chars == len(said)
    assert got[1].turns_sha256 == hashlib.sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest()
    assert (got[2].loss_chars, got[3].n_turns) == (0, 2)
    assert chat.read_back(chat.format_messages(chat.fold(chat.events_of_rows(df.limit(0))))).count() == 0
