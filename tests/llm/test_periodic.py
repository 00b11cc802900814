"""Periodic runs against plain search over all periods, the trees by themselves, and odd inputs."""

import random

import numpy as np
import pyarrow as pa
import pytest
from cases import frame, words
from helpers import row_set

from panelspark.llm import bytetext as B
from panelspark.llm import periodic as P


def plain_runs(w, least=6, times=4):
    """(start, length, period) of every run: all periods are tried, and the smallest is kept of each stretch."""
    n, found = len(w), {}
    for q in range(1, n // times + 1):
        i = 0
        while i < n - q:
            a = i
            while i < n - q and w[i] == w[i + q]:
                i += 1
            if i > a and i - a + q >= max(least, times * q):
                found.setdefault((a, i - a + q), q)
            i += 1
    return sorted(((a, n, q) for (a, n), q in found.items()), key=lambda r: (r[0], r[2]))


def plain_row(text, least=6, times=4):
    w = words(text)
    runs = plain_runs(w, least, times)
    gone = {i for a, n, q in runs for i in range(a + q, a + n)}
    return len(w), tuple(runs), " ".join(x for i, x in enumerate(w) if i not in gone)


def repetitive(rnd, alphabet, n):
    w = [rnd.randrange(alphabet) for _ in range(n)]
    for _ in range(rnd.randrange(3)):
        at, size = rnd.randrange(n + 1), 1 + rnd.randrange(8)
        w[at:at] = (w[at : at + size] * rnd.randrange(2, 12))[: 3 * n]
    return w


@pytest.mark.parametrize(("least", "times"), [(6, 4), (3, 2), (4, 3), (12, 2)])
def test_runs_equal_plain_search(least, times):
    rnd = random.Random(least * 10 + times)
    for _ in range(1500):
        w = repetitive(rnd, rnd.choice([1, 2, 3, 6]), rnd.randrange(40))
        assert [tuple(r) for r in P.runs_of(w, least, times).tolist()] == plain_runs(w, least, times)


@pytest.mark.parametrize(("least", "times"), [(6, 4), (3, 2), (4, 3)])
def test_what_is_cut_out_touches_no_run(least, times):
    rnd = random.Random(7)
    for _ in range(400):
        texts = [repetitive(rnd, rnd.choice([2, 4, 30]), rnd.randrange(60)) for _ in range(4)]
        owner = np.repeat(np.arange(4), [len(w) for w in texts])
        h = B.mix(np.array([x for w in texts for x in w], np.uint64))
        kept = set(P.fit_for_runs(h, owner, least, times).tolist())
        first = 0
        for w in texts:
            assert all(first + i in kept for a, n, _ in plain_runs(w, least, times) for i in range(a, a + n))
            first += len(w)


def test_tree_gives_common_extensions_and_order():
    rnd = random.Random(3)
    for _ in range(60):
        s = [*repetitive(rnd, 3, 50), -1]
        tree, n = P.SuffixTree(s), len(s)
        assert tree.order == sorted(range(n), key=lambda i: s[i:])
        a, b = (np.array(x) for x in zip(*((i, j) for i in range(n) for j in range(n) if i != j), strict=True))
        plain = [next(k for k in range(n) if i + k >= n or j + k >= n or s[i + k] != s[j + k]) for i, j in zip(a.tolist(), b.tolist(), strict=True)]
        assert tree.common(a, b).tolist() == plain


def test_tree_grows_with_the_length_of_any_text():
    """A tree of n symbols has at most 2 n nodes, whether all symbols are equal, periodic or of Fibonacci's word."""
    fib = [0], [0, 1]
    while len(fib[1]) < 20_000:
        fib = fib[1], fib[1] + fib[0]
    for w in ([0] * 20_000, list(range(100)) * 200, fib[1][:20_000]):
        tree = P.SuffixTree([*w, -1])
        assert len(tree.order) == len(w) + 1
        assert max(len(level) for level in tree.minima.levels) <= 4 * (len(w) + 1) // P._BLOCK + 2


ODD = ["a " * 5, "a " * 6, "A a " * 4, "a b " * 3, "a b " * 4, "x y z " * 4 + "x", "é日 🙂 " * 9, "q " + "a b c d " * 20 + "r " + "a b c d " * 20, "k " * 30_000, "a a a a a a b " * 40, ("m n " * 4 + "o ") * 5]


@pytest.fixture(scope="module")
def odd(spark, rows):
    more = rows + [(1000 + i, t) for i, t in enumerate(ODD)]
    return more, frame(spark, more)


@pytest.mark.parametrize(("least", "times"), [(6, 4), (3, 2)])
def test_operator_equals_plain_search(odd, least, times):
    rows, docs = odd
    # plain search takes too long for these two texts, which have tests of their own
    rows = [(i, t) for i, t in rows if len(words(t)) < 20_000]
    got = P.periodic_runs(docs, least, times).collect()
    got = [(r["doc_id"], r["n_words"], tuple((x["start"], x["length"], x["period"]) for x in r["runs"]), r["collapsed"]) for r in got if r["n_words"] < 20_000]
    assert sorted(got, key=repr) == sorted(((i, *plain_row(t, least, times)) for i, t in rows), key=repr)


def test_very_long_texts(odd):
    _, docs = odd
    by_id = {r["doc_id"]: r for r in P.periodic_runs(docs.filter("doc_id in (66, 1008)")).collect()}
    assert [tuple(x) for x in by_id[1008]["runs"]] == [(0, 30_000, 1)] and by_id[1008]["collapsed"] == "k"
    assert by_id[66]["runs"] == [] and len(by_id[66]["collapsed"].split(" ")) == 30_000


def test_empty_table_and_other_names(spark, nothing):
    assert P.periodic_runs(nothing).count() == 0
    docs = spark.createDataFrame([("k", "a " * 8, 1)], "name string, body string, runs int")
    (row,) = P.periodic_runs(docs, id_column="name", text_column="body").collect()
    assert (row["doc_id"], row["collapsed"], [tuple(x) for x in row["runs"]]) == ("k", "a", [(0, 8, 1)])


def test_too_weak_a_run_is_refused(docs):
    with pytest.raises(ValueError, match="twice"):
        P.periodic_runs(docs, 6, 1)


def test_periodic_ends(spark, docs, rows):
    import zlib

    def ended(i, text):
        w, h = words(text), 1 if i is None else zlib.crc32(str(i).encode())
        if h % 10 or not w:
            return w
        a, g = (h // 10) % len(w), h // 10
        p = 1 + (len(w) - a) // (3 + g % 8)
        return [x if k < a else w[a + (k - a) % p] for k, x in enumerate(w)]

    got = sorted(((r["doc_id"], r["text"]) for r in P.with_periodic_ends(docs).collect()), key=repr)
    assert got == sorted(((i, " ".join(ended(i, t))) for i, t in rows), key=repr)
    assert sum(words(t) != ended(i, t) for i, t in rows) > 2


def test_words_beyond_one_batch(spark):
    """A text keeps its runs whatever stands beside it in a batch."""
    (t,) = B.texts(pa.array(["z a b a b a b a b", "a b a b", "", None, "c " * 6]))
    assert [(i, r.tolist()) for i, r in P.runs_by_text(B.words(t))] == [(0, [[1, 8, 2]]), (4, [[0, 6, 1]])]


def test_query_equals_its_sql(spark, sf, duck):
    assert row_set(P.op12_periodic_runs(spark, sf).toPandas()) == row_set(duck.execute(P.ORACLE).df())
