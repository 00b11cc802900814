"""Line, window, byte and set dedup against brute force, on a corpus with every odd case."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from cases import LOWER, corpus, frame, words
from pyspark.sql import functions as F

from panelspark.llm import lines, setjoin, substrings, suffixes

ORDER = lambda i: (i is None, i)


def brute_lines(rows, least):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    count = Counter(k for _, t in rows for k in {key(x) for x in (t or "").split("\n")})
    out = []
    for i, t in rows:
        ls = (t or "").split("\n")
        kept = [x for x in ls if not (key(x) and count[key(x)] >= least)]
        out.append((i, len(ls), len(ls) - len(kept), "\n".join(kept)))
    return Counter(out)


@pytest.mark.parametrize("least", [2, 5, 1000])
def test_lines(docs, rows, least):
    got = lines.dedup_lines(docs, least).select("doc_id", "n_lines", "n_dropped", F.coalesce("text", F.lit("")))
    assert Counter(map(tuple, got.collect())) == brute_lines(rows, least)


def test_lines_are_reversible(spark, docs, rows):
    index = lines.LineIndex(spark, min_docs=3)
    index.insert(docs.filter("doc_id < 20"))
    before = Counter(map(tuple, index.strip(docs).select("doc_id", "text", "n_dropped").collect()))
    index.insert(docs.filter("doc_id >= 20"))
    assert Counter(map(tuple, index.strip(docs).select("doc_id", "text").collect())) != Counter((i, t) for i, t, _ in before)
    index.delete(docs.filter("doc_id >= 20"))
    assert Counter(map(tuple, index.strip(docs).select("doc_id", "text", "n_dropped").collect())) == before


def test_cuckoo_filter():
    keys = np.random.default_rng(0).integers(0, 2**63, 20_000).astype(np.uint64)
    f = lines.build_filter(keys[:10_000])
    assert f.contains(keys[:10_000]).all() and f.contains(keys[10_000:]).mean() < 0.01
    f = lines.CuckooFilter.load(f.dump())
    f.delete(keys[:5_000])
    assert f.contains(keys[5_000:10_000]).all() and f.contains(keys[:5_000]).mean() < 0.05


def brute_windows(rows, size):
    first = {}
    for i, t in rows:
        w = words(t)
        for s in range(len(w) - size + 1):
            k, here = tuple(w[s : s + size]), (ORDER(i), s)
            first[k] = min(first.get(k, here), here)
    out = []
    for i, t in rows:
        w = words(t)
        gone = [False] * len(w)
        for s in range(len(w) - size + 1):
            if first[tuple(w[s : s + size])] < (ORDER(i), s):
                gone[s : s + size] = [True] * size
        out.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return Counter(out)


@pytest.mark.parametrize("size", [20, 5, 1])
def test_windows(docs, rows, size):
    got = substrings.dedup_windows(docs, size)
    assert Counter(map(tuple, got.select("doc_id", "n_words", "n_removed", "text").collect())) == brute_windows(rows, size)
    spans = got.select("n_removed", F.aggregate("removed", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"]).alias("s")).collect()
    assert all(r["n_removed"] == r["s"] for r in spans)


def brute_bytes(rows, depth):
    data = [(i, (t or "").encode()) for i, t in rows]
    count = Counter(b[s : s + depth] for _, b in data for s in range(len(b) - depth + 1))
    out = []
    for i, b in data:
        gone = np.zeros(len(b) + 1, bool)
        for s in range(len(b) - depth + 1):
            if count[b[s : s + depth]] > 1:
                gone[s : s + depth] = True
        gone = gone[:-1]
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("depth", [30, 100])
def test_bytes(docs, rows, depth):
    got = suffixes.dedup_bytes(docs, depth).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256))
    assert Counter(map(tuple, got.collect())) == brute_bytes(rows, depth)


@pytest.mark.parametrize("flush", [50, 1 << 20])
def test_bytes_at_the_registered_depth(spark, flush):
    """Passages of 399, 400 and 401 bytes and more, overlapping, inside one text and across partitions and flushes."""
    rnd = np.random.default_rng(12)
    text = lambda k: "".join(map(chr, rnd.integers(97, 123, k)))
    passages, rows = [text(k) for k in (380, 399, 400, 401, 466, 467, 900)], []
    for i in range(90):
        p, q = passages[i % 7], passages[(i // 7) % 7]
        rows.append((i, text(i % 50) + p + text(int(rnd.integers(0, 300))) + "é" * (i % 3) + q[i % 5 :] + text(i % 90)))
    rows += [(100, passages[6] + passages[6]), (101, text(300_000) + passages[2] + text(500)), (102, "a" * 1200), (103, "ab" * 399), (104, None), (None, ""), rows[5], rows[5]]
    rows += [(200 + i, text(100) + passages[0] + text(100)) for i in range(60)]
    got = suffixes.dedup_bytes(frame(spark, rows), flush_entries=flush).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256))
    assert Counter(map(tuple, got.collect())) == brute_bytes(rows, 400)


def test_radix_groups():
    rnd = np.random.default_rng(13)
    data = rnd.integers(97, 99, 3000).astype(np.uint8)
    for depth in (1, 7, 8, 9, 20):
        start = rnd.permutation(len(data) - depth)[:1500]
        label = suffixes.radix_groups(data, start, depth)
        keys = [data[s : s + depth].tobytes() for s in start.tolist()]
        count = Counter(keys)
        assert [x >= 0 for x in label.tolist()] == [count[k] > 1 for k in keys]
        assert len({(x, k) for x, k in zip(label.tolist(), keys, strict=True) if x >= 0}) == len(set(label[label >= 0].tolist()))


def test_a_shared_block_costs_its_bucket_little(spark):
    """20,000 texts with one block of 380 bytes, each in surroundings of its own."""
    block = "".join(chr(97 + (i * i + i // 7) % 26) for i in range(380))
    around = lambda salt: F.concat(*(F.sha2(F.concat(F.lit(f"{salt}{j}"), F.col("id").cast("string")), 256) for j in range(2)))
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.concat(around("a"), F.lit(block), around("b")).alias("text")).repartition(4)
    sent = docs.select(F.col("doc_id").alias("key"), "text").mapInArrow(suffixes.send_runs(64, 400), suffixes.block_schema(suffixes._RUN))
    sizes = sent.groupBy("bucket").agg((F.sum(F.octet_length("run")) / 8).alias("n")).collect()
    n = sum(r["n"] for r in sizes)
    assert max(r["n"] for r in sizes) < 2 * n / 64
    got = suffixes.dedup_bytes(docs, 400)
    assert got.agg(F.sum("n_removed")).first()[0] == 0


def test_a_line_of_all_documents_costs_an_entry_per_home(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("one line\n"), F.col("id")).alias("text"))
    shards = lines.build_shards(lines.line_counts(docs).filter("refs >= 10"), 1)
    texts = lines.dealt(docs, 8, "doc_id", "text", ())
    assert lines.probe(texts, shards, 1, 4).agg(F.sum(F.octet_length("hi")) / 8).first()[0] == 8
    assert lines.strip_lines(docs, shards, 1).agg(F.sum("n_dropped")).first()[0] == 20_000


def test_line_index_deals_look_ups_and_changes_its_filters(spark, docs, monkeypatch):
    used, probe = [], lines.probe
    monkeypatch.setattr(lines, "probe", lambda *a: used.append(a[3]) or probe(*a))
    built, build = [], lines.build_shards
    monkeypatch.setattr(lines, "build_shards", lambda *a: built.append(a) or build(*a))
    index, some = lines.LineIndex(spark, 3), docs.filter("doc_id % 2 = 0")

    def keys():
        out = set()
        for r in index.shards().collect():
            hi, lo = (np.frombuffer(r[c], np.uint64) for c in ("hi", "lo"))
            assert lines.CuckooFilter.load(r["filter"]).contains(hi).all() and (np.diff(hi.astype(object)) >= 0).all()
            out |= set(zip(hi.view(np.int64).tolist(), lo.view(np.int64).tolist(), strict=True))
        return out

    counted = lambda df: {(r["key_hi"], r["key_lo"]) for r in lines.line_counts(df).filter("refs >= 3").collect()}
    for change, holds in ((lambda: index.insert(some), some), (lambda: index.insert(docs.exceptAll(some)), docs), (lambda: index.delete(docs.exceptAll(some)), some), (lambda: index.delete(some), docs.limit(0))):
        change()
        assert keys() == counted(holds)
    assert len(built) == 1  # later changes insert into and delete from the filters
    index.insert(docs)
    want = Counter(map(tuple, lines.dedup_lines(docs, 3).select("doc_id", "text").collect()))
    used.clear()
    assert Counter(map(tuple, index.strip(docs).select("doc_id", "text").collect())) == want
    assert used == [4]  # as many groups as shuffle partitions, not one


def test_line_index_over_several_shards(spark, docs, rows, monkeypatch):
    """Keys exactly at min_docs, in several shards, as documents come and go."""
    monkeypatch.setattr(lines, "SHARD_KEYS", 4)
    index = lines.LineIndex(spark, 2)
    index.insert(docs)
    assert index.n_shards > 1
    strip = lambda: Counter((r["doc_id"], r["n_dropped"]) for r in index.strip(docs).collect())
    assert strip() == Counter((i, n) for i, _, n, _ in brute_lines(rows, 2).elements())
    index.delete(docs.filter("doc_id % 3 = 0"))
    left = [(i, t) for i, t in rows if i is None or i % 3]
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    count = Counter(k for _, t in left for k in {key(x) for x in (t or "").split("\n")})
    assert strip() == Counter((i, sum(1 for x in (t or "").split("\n") if key(x) and count[key(x)] >= 2)) for i, t in rows)


def brute_components(rows, size, percent):
    sets = []
    for _, t in rows:
        w = words(t, lower=True)
        sets.append({tuple(w[s : s + size]) for s in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                parent[find(a)] = find(b)
    least = defaultdict(list)
    for x in range(len(rows)):
        least[find(x)].append(rows[x][0])
    smallest = {k: min(v, key=ORDER) for k, v in least.items()}
    return Counter((rows[x][0], len(sets[x]), smallest[find(x)]) for x in range(len(rows)))


@pytest.mark.parametrize("size,percent", [(4, 85), (5, 80), (1, 60)])
def test_sets(docs, rows, size, percent):
    got = setjoin.near_duplicates(docs, size, percent).select("doc_id", "n_shingles", "component_id")
    assert Counter(map(tuple, got.collect())) == brute_components(rows, size, percent)


@pytest.mark.parametrize("seed", [2, 3])
def test_sets_of_other_corpora(spark, seed, monkeypatch):
    monkeypatch.setattr(setjoin, "LIST_MEMBERS", 4)  # lists are dealt over several tasks
    rows = corpus(seed, 120)
    got = setjoin.near_duplicates(frame(spark, rows), 3, 70).select("doc_id", "n_shingles", "component_id")
    assert Counter(map(tuple, got.collect())) == brute_components(rows, 3, 70)


def test_a_token_of_all_sets_costs_an_entry_per_home(spark):
    """20,000 sets of one common token and two of their own: the common one reaches its bucket once from each home."""
    token = lambda x: F.substring(F.sha2(x, 256), 1, 12)
    mine = F.unhex(F.concat(F.lit("0123456789ab"), token(F.concat(F.lit("a"), "id")), token(F.concat(F.lit("b"), "id"))))
    sets = spark.range(20_000).select(mine.alias("set"), F.pmod(F.xxhash64("id"), F.lit(8)).cast("int").alias("_ps_home"))
    asked = sets.groupBy("_ps_home").applyInArrow(setjoin.ask_frequency(16), "bucket int, token binary, n binary, home int")
    sizes = [r[0] for r in asked.groupBy("bucket").agg((F.sum(F.octet_length("token")) / 8).alias("n")).select("n").collect()]
    assert sum(sizes) == 40_000 + 8 and max(sizes) < 1.2 * 40_000 / 16
    got = asked.groupBy("bucket").applyInArrow(setjoin.answer_frequency, "bucket int, token binary, df binary").collect()
    assert {tuple(np.frombuffer(r["df"], np.int32)) for r in got} == {(20_000,)} and len(got) == 8


def test_pieces_of_a_long_list(spark, monkeypatch):
    """Only members outside the largest component visit other pieces, and no pair of sizes that may link is kept apart."""
    monkeypatch.setattr(setjoin, "LIST_MEMBERS", 10)
    rows = [(1, k, 100 + k % 40, k % 200, 1 if k % 50 else k, 500) for k in range(500)]
    placed = setjoin.pieces(spark.createDataFrame(rows, "token long, key long, n int, at int, component long, df int"), 85).collect()
    pieces = {}
    for r in placed:
        pieces.setdefault(r["piece"], []).append(r)
    members = {r["key"]: r["piece"] for r in placed if r["member"]}
    assert len(members) == 500 and max(sum(r["member"] for r in p) for p in pieces.values()) <= 40
    visits = {(r["key"], r["piece"]) for r in placed if r["probe"]}
    assert {k for k, _ in visits} == {k for k in range(500) if k % 50 == 0}
    n = {r[1]: r[2] for r in rows}
    for a in range(0, 500, 50):
        assert all((a, members[b]) in visits for b in range(500) if 100 * min(n[a], n[b]) >= 85 * max(n[a], n[b]))


def test_empty_tables(nothing):
    for out in (lines.dedup_lines(nothing), substrings.dedup_windows(nothing), suffixes.dedup_bytes(nothing), setjoin.near_duplicates(nothing)):
        assert out.count() == 0
