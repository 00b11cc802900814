"""The line index as a thing that lasts: other sessions, refused deletions, failures half-way, and what a change rewrites."""

from collections import Counter

import pytest
from cases import frame
from pyspark.sql import functions as F

from panelspark.llm import lines


def stripped(index, docs):
    return Counter(map(tuple, index.strip(docs).select("doc_id", "text", "n_dropped").collect()))


@pytest.fixture
def where(tmp_path):
    return f"file://{tmp_path}/index"


def test_another_session_goes_on(spark, docs, where):
    first = lines.LineIndex(spark, 3, folder=where)
    first.insert(docs.filter("doc_id % 2 = 0"))
    second = lines.LineIndex(spark, 3, folder=where)
    assert stripped(second, docs) == stripped(first, docs) and any(n for (_, _, n) in stripped(second, docs))
    second.insert(docs.filter("doc_id % 2 = 1 or doc_id is null"))
    whole = lines.LineIndex(spark, 3)
    whole.insert(docs)
    want = stripped(whole, docs)
    assert stripped(second, docs) == want and stripped(first, docs) == want  # the first one sees it too
    first.delete(docs.filter("doc_id % 2 = 1 or doc_id is null"))
    half = lines.LineIndex(spark, 3)
    half.insert(docs.filter("doc_id % 2 = 0"))
    assert stripped(second, docs) == stripped(half, docs)


def test_other_settings_are_refused(spark, docs, where):
    lines.LineIndex(spark, 3, folder=where).insert(docs)
    with pytest.raises(ValueError, match="min_docs 3"):
        lines.LineIndex(spark, 4, folder=where)


def test_a_stray_deletion_is_refused_and_changes_nothing(spark, docs, where):
    index = lines.LineIndex(spark, 2, folder=where)
    some = frame(spark, [(1, "kept line\nother"), (2, "kept line")])
    index.insert(some)
    before = sorted(map(tuple, index.counts().collect()))
    with pytest.raises(ValueError, match="doesn't hold"):
        index.delete(frame(spark, [(3, "kept line\nnever inserted")]))
    assert sorted(map(tuple, lines.LineIndex(spark, 2, folder=where).counts().collect())) == before
    index.insert(frame(spark, [(4, "never inserted"), (5, "never inserted")]))
    assert stripped(index, frame(spark, [(9, "never inserted\nx")])) == Counter({(9, "x", 1): 1})


def test_a_change_that_fails_leaves_the_last_state(spark, docs, where, monkeypatch):
    index = lines.LineIndex(spark, 3, folder=where)
    index.insert(docs)
    want = stripped(index, docs)

    def fails(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(lines, "change_shards", fails)
        with pytest.raises(RuntimeError, match="lost"):
            index.delete(docs)
    again = lines.LineIndex(spark, 3, folder=where)
    assert stripped(again, docs) == want
    again.delete(docs)
    assert again.counts().count() == 0 and not any(n for (_, _, n) in stripped(again, docs))


def test_a_change_rewrites_what_it_touches(spark, where):
    index = lines.LineIndex(spark, 1, folder=where, parts=16)
    index.insert(frame(spark, [(i, f"line {i}") for i in range(400)]))
    before = dict(index.state["counts"])
    assert len(before) == 16
    index.insert(frame(spark, [(1000, "one more")]))
    moved = [k for k, v in index.state["counts"].items() if before[k] != v]
    assert len(moved) == 1
    index.insert(frame(spark, [(1001, "one more")]))  # no key crosses the threshold, so no shard is written
    assert index._names(f"{where}/shards/v3") == []
    # what the first change wrote and the second replaced is gone now; all else is there
    assert f"part={moved[0]}" not in index._names(f"{where}/counts/v1") and len(index._names(f"{where}/counts/v1")) >= 15
    assert index.counts().agg(F.sum("refs")).first()[0] == 402
    assert len(index._names(f"{where}/state")) == 2


def test_an_index_that_was_never_filled(spark, docs, nothing, where):
    index = lines.LineIndex(spark, 3, folder=where)
    assert not any(n for (_, _, n) in stripped(index, docs))
    index.insert(nothing)
    assert index.counts().count() == 0 and not any(n for (_, _, n) in stripped(lines.LineIndex(spark, 3, folder=where), docs))
