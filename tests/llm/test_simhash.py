"""SimHash against plain Python: fingerprints, the index at all its kinds of lists, components, and odd inputs."""

import random
from itertools import combinations

import numpy as np
import pytest
import xxhash
from cases import frame, words

from panelspark.llm import simhash as S
from panelspark.llm.common import table


def plain_print(text, size=3):
    w = words(text, lower=True)
    shingles = [" ".join(w[i : i + size]) for i in range(len(w) - size + 1)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(prints, max_bits=2):
    """The smallest id reachable for each (id, fingerprint)."""
    distinct = sorted({f for _, f in prints})
    root = {f: f for f in distinct}

    def top(f):
        while root[f] != f:
            f = root[f]
        return f

    for x, y in combinations(distinct, 2):
        if (x ^ y).bit_count() <= max_bits:
            root[top(x)] = top(y)
    least = {}
    for i, f in prints:
        ids = [j for j in (least.get(top(f)), i) if j is not None]
        least[top(f)] = min(ids, default=None)
    return sorted(((i, f"{f:016x}", least[top(f)]) for i, f in prints), key=repr)


def spread(rnd, centres, each, bits):
    """Fingerprints around some centres, each one by random flips from one before it."""
    out = []
    for _ in range(centres):
        near = [rnd.getrandbits(64)]
        for _ in range(each):
            f = rnd.choice(near)
            for _ in range(rnd.randrange(bits + 1)):
                f ^= 1 << rnd.randrange(64)
            near.append(f)
        out += near
    return list(enumerate(out))


def as_prints(spark, prints):
    return spark.createDataFrame([(i, f - (1 << 64) if f >> 63 else f) for i, f in prints], "doc_id long, fingerprint long")


def found(df):
    return sorted(((r["doc_id"], f"{r['fingerprint'] % (1 << 64):016x}", r["component_id"]) for r in df.collect()), key=repr)


@pytest.mark.parametrize(("max_bits", "long"), [(2, 512), (2, 4), (2, 1), (1, 3), (3, 5), (0, 512)])
def test_components_equal_all_pairs(spark, max_bits, long):
    """With lists called long from a few members on, the lists of six positions and the look-up of neighbours take part."""
    prints = spread(random.Random(max_bits * 100 + long), 12, 40, 4)
    assert found(S.near_fingerprints(as_prints(spark, prints), max_bits, long)) == plain_components(prints, max_bits)


def test_every_pattern_of_two_bits_is_found(spark):
    rnd = random.Random(4)
    for pair in [(a, b) for a in range(8) for b in range(a, 8)]:
        centre = rnd.getrandbits(64)
        flips = [(1 << 8 * pair[0] + rnd.randrange(8)) | (1 << 8 * pair[1] + rnd.randrange(8)) for _ in range(1)]
        prints = [(0, centre), *((i + 1, centre ^ f) for i, f in enumerate(flips))]
        x = np.sort(np.array([f for _, f in prints], np.uint64))
        assert len(S.tallied_pairs(x, np.zeros(len(x), np.int64), 2)[0]) >= 1
    prints = []
    for pair in combinations(range(64), 2):
        centre = rnd.getrandbits(64)
        prints += [(len(prints), centre), (len(prints) + 1, centre ^ (1 << pair[0]) ^ (1 << pair[1]))]
    got = {r["doc_id"]: r["component_id"] for r in S.near_fingerprints(as_prints(spark, prints)).collect()}
    assert all(got[i] == i - i % 2 for i in got)


def test_long_lists_stay_bounded(spark):
    """A third of all fingerprints in one ball: lists of six positions hold at most 2**16, and links grow with members, not pairs."""
    rnd = random.Random(9)
    centre = rnd.getrandbits(64)
    ball = {centre}
    while len(ball) < 3_000:
        ball.add(centre ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(64)))
    others = {rnd.getrandbits(64) for _ in range(3_000)}
    prints = list(enumerate([*ball, *others]))
    rows = as_prints(spark, prints).select("fingerprint")
    index = S.inverted_index(rows, 2, 256)
    sizes = {(r["kind"], r["bytes"]): r["count"] for r in index.groupBy("kind", "bytes").count().collect()}
    assert max(n for (kind, _), n in sizes.items() if kind < 10) <= 256 and any(kind >= 10 for kind, _ in sizes)
    assert S.links(index, 2, 256).count() <= index.count()
    assert found(S.near_fingerprints(as_prints(spark, prints), 2, 256)) == plain_components(prints)


def test_lists_that_go_over_batches(spark):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    prints = spread(random.Random(5), 3, 60, 3)
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
        assert found(S.near_fingerprints(as_prints(spark, prints), 2, 16)) == plain_components(prints)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_pairs_of_a_list():
    rnd = random.Random(6)
    x = np.array(sorted({rnd.getrandbits(16) << 8 for _ in range(700)}), np.uint64)
    plain = {(int(a), int(b)) for a, b in combinations(x, 2) if (int(a) ^ int(b)).bit_count() <= 2}
    for left, right in (S.looked_up_pairs(x, 2), S.tallied_pairs(x, np.zeros(len(x), np.int64), 2)):
        assert {(int(x[a]), int(x[b])) for a, b in zip(left, right, strict=True)} == plain


def test_stars():
    path = np.arange(499)
    assert S.stars(path, path + 1, 501).tolist() == [0] * 500 + [500]
    assert S.stars(np.zeros(0, np.int64), np.zeros(0, np.int64), 3).tolist() == [0, 1, 2]


MORE = ["two words", "Two  WORDS", "one", "a b c", "A\tB\nC", "é ß 日本 🙂", "a b c " * 600, "x " * 70_000, "one two three four", "one two three four five"]


def test_operator_equals_plain_python(spark, rows):
    rows = rows + [(1000 + i, t) for i, t in enumerate(MORE)]
    got = sorted(map(tuple, S.near_duplicates(frame(spark, rows)).collect()), key=repr)
    assert got == plain_components([(i, plain_print(t)) for i, t in rows])
    assert sum(f == "0" * 16 for _, f, _ in got) > 3  # texts without words are linked like any other


def test_shingles_of_other_sizes(spark, rows):
    rows = [(i, t) for i, t in rows if len(words(t)) < 5_000]
    for size in (1, 5):
        got = S.fingerprints(frame(spark, rows), size).collect()
        assert sorted(((r[0], r[1] % (1 << 64)) for r in got), key=repr) == sorted(((i, plain_print(t, size)) for i, t in rows), key=repr)


def test_empty_table_null_ids_and_other_names(spark, nothing):
    assert S.near_duplicates(nothing).count() == 0
    docs = spark.createDataFrame([(None, "only nulls"), (None, "only nulls"), ("k", "other")], "name string, body string")
    got = S.near_duplicates(docs, id_column="name", text_column="body").collect()
    assert sorted((r["doc_id"] or "", r["component_id"] or "") for r in got) == [("", ""), ("", ""), ("k", "k")]


def test_too_many_bits_are_refused(spark, docs):
    with pytest.raises(ValueError, match="max_bits"):
        S.near_duplicates(docs, max_bits=4)


def test_query_equals_all_pairs(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in table(spark, sf, "documents").select("doc_id", "text").collect()]
    got = sorted(map(tuple, S.op11_simhash_near_dedup(spark, sf).collect()), key=repr)
    assert got == plain_components([(i, plain_print(t)) for i, t in rows])
