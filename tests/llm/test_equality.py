"""Texts that fool weak hashes, and keys that a large part of all documents share."""

import pyarrow as pa
from cases import frame
from pyspark.sql import functions as F

from panelspark.llm import bytetext as B
from panelspark.llm import lines, maxent, setjoin, substrings, suffixes


def thue_morse(k, a, b):
    return "".join((a, b)[bin(i).count("1") & 1] for i in range(k))


ONE, TWO = thue_morse(1024, "a", "b"), thue_morse(1024, "b", "a")


def test_word_hashes():
    w = B.words(next(B.texts(pa.array([ONE, TWO, ONE]))))
    assert w.hash[0] == w.hash[2] != w.hash[1]
    n, p = 1 << 10, B.prefix_hash(B.mix(B.np.frombuffer(thue_morse(1 << 11, "a", "b").encode(), B.np.uint8).astype(B.np.uint64)))
    h = B.span_hash(p, B.np.arange(n), B.np.arange(n) + n)
    assert (h == B.span_hash(p, slice(0, n), slice(n, 2 * n))).all()


def test_lines_that_differ_are_told_apart(spark):
    got = lines.dedup_lines(frame(spark, [(i, ONE if i < 5 else TWO) for i in range(10)]), 10)
    assert {r["n_dropped"] for r in got.collect()} == {0}


def test_windows_that_differ_are_told_apart(spark):
    common = " ".join(f"c{i}" for i in range(19))
    got = substrings.dedup_windows(frame(spark, [(1, f"{common} {ONE}"), (2, f"{common} {TWO}")]))
    assert {r["n_removed"] for r in got.collect()} == {0}
    words = lambda a, b: " ".join(thue_morse(1024, a, b))
    got = substrings.dedup_windows(frame(spark, [(1, words("a", "b")), (2, words("c", "d"))]), 1024)
    assert {r["n_removed"] for r in got.collect()} == {0}


def test_bytes_that_differ_are_told_apart(spark):
    got = suffixes.dedup_bytes(frame(spark, [(1, ONE), (2, TWO)]), 1024)
    assert {r["n_removed"] for r in got.collect()} == {0}


def test_sets_that_differ_are_told_apart(spark):
    got = setjoin.near_duplicates(frame(spark, [(1, ONE), (2, TWO), (3, ONE)]))
    assert {r["doc_id"]: r["component_id"] for r in got.collect()} == {1: 1, 2: 2, 3: 1}


def test_words_that_differ_are_counted_apart(spark):
    got = maxent.score_documents(frame(spark, [(1, ONE), (2, ONE), (3, TWO)]), F.col("doc_id") < 3).collect()
    assert {r["doc_id"]: r["n_known"] for r in got} == {1: 2, 2: 2, 3: 1}
