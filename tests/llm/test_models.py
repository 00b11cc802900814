"""Classifiers, the language model, neighbours, decontamination, packing and the pipeline."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from cases import frame, words
from pyspark.sql import functions as F

from panelspark.llm import bytetext as B
from panelspark.llm import decontaminate, knn, maxent, packing, quality, toxicity
from panelspark.llm.common import fold_of


def brute_nearest(vectors, queries, k):
    good = {i: v for i, v in vectors if v and any(v) and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for q in queries:
        if q in good:
            near = sorted((math.dist(good[q], v), i) for i, v in good.items() if i != q and len(v) == len(good[q]))[:k]
            out += [(q, r + 1, i, round(d, 6)) for r, (d, i) in enumerate(near)]
    return sorted(out)


@pytest.mark.parametrize("blocks", [(4096, 32768), (3, 5)])
def test_nearest(spark, blocks):
    rnd = np.random.default_rng(4)
    base = rnd.normal(size=(150, 8)).astype(np.float32)
    base[10:40] = base[3]  # many ties
    vectors = [(i, [float(x) for x in v]) for i, v in enumerate(base)]
    vectors += [(200, None), (201, []), (202, [0.0] * 8), (203, [float("nan")] * 8), (204, [None] * 8), (205, [float("inf")] + [1.0] * 7), (206, [1.0] * 4), (210, [1e3] * 8)]
    df = spark.createDataFrame([(*v, 1.0, "x") for v in vectors], "vec_id long, embedding array<float>, score double, ids string")
    got = knn.nearest(df, F.col("vec_id") % 10 == 0, 10, query_rows=blocks[0], candidate_rows=blocks[1])
    have = sorted((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 6)) for r in got.collect())
    assert have == brute_nearest(vectors, [i for i, _ in vectors if i % 10 == 0], 10)
    assert knn.nearest(df.limit(0), F.col("vec_id") % 10 == 0).count() == 0


def test_nearest_of_extreme_and_repeated_rows(spark):
    """Components near the ends of the range, null and repeated ids, a null query flag, and 1,100 dimensions."""
    rows = [(i, [1e200 * (i + 1), -1e200 * i, 3.0]) for i in range(5)] + [(10 + i, [1e-200 * (i + 1), 0.0, 2e-200]) for i in range(5)] + [(20, [1e308, 1e308, 0.0]), (21, [-1e308, 0.0, 1e308])]
    rows += [(None, [1e200, 0.0, 3.0]), (30, [7.0, 7.0, 7.0]), (30, [8.0, 8.0, 8.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = knn.nearest(df, F.col("vec_id").isin(0, 12, 30), 4).collect()
    near = {q: [(r["vec_id"], r["score"]) for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q] for q in (0, 12, 30)}
    assert [i for i, _ in near[0]] == [10, 11, 12, 13] or near[0][0][1] <= 1e200
    assert [i for i, _ in near[12]][:4] == [11, 13, 10, 14] and all(0.9e-200 < s < 2.1e-200 for _, s in near[12])
    assert len(near[0]) == 4 and len(near[30]) == 8 and 30 not in [i for i, _ in near[30]]
    exact = sorted((math.hypot(*(a - b for a, b in zip(v, rows[0][1], strict=True))), i) for i, v in rows[1:] if i is not None)[:4]
    assert all(math.isclose(a, b, rel_tol=1e-12) for (a, _), (_, b) in zip(exact, near[0], strict=True))
    rnd = np.random.default_rng(15)
    wide = [(i, v.tolist()) for i, v in enumerate(rnd.normal(size=(30, 1100)))]
    got = knn.nearest(spark.createDataFrame(wide, "vec_id long, embedding array<double>"), F.col("vec_id") < 3, 5)
    assert sorted((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 6)) for r in got.collect()) == brute_nearest(wide, [0, 1, 2], 5)


def test_bounds_hold():
    rnd = np.random.default_rng(5)
    q, c = rnd.normal(size=(20, 64)), rnd.normal(size=(300, 64)) * rnd.uniform(0.01, 100, (300, 1))
    low, high = knn.bounds(q, c)
    exact = np.sqrt(((q[:, None, :] - c[None, :, :]) ** 2).sum(axis=2))
    assert (low <= exact).all() and (exact <= high).all()


def edited(rnd, item, edits, vocabulary):
    out = list(item)
    for _ in range(edits):
        j, how = rnd.randrange(len(out)), rnd.random()
        if how < 0.5:
            out[j] = rnd.choice(vocabulary)
        elif how < 0.75:
            del out[j]
        else:
            out.insert(j, rnd.choice(vocabulary))
    return out


def test_decontamination_recall_and_precision(spark, nothing):
    rnd = random.Random(6)
    vocabulary = [f"v{i}" for i in range(3000)]
    text = lambda k: [rnd.choice(vocabulary) for _ in range(k)]
    items = [(i, text(rnd.randrange(14, 60))) for i in range(40)] + [(100, ["only", "three", "words"])]
    rows, want = [], set()
    for d in range(300):
        body = text(rnd.randrange(0, 120))
        if d % 2:
            i, w = items[d % len(items)]
            rate = 0.0 if len(w) < 12 else (0, 0.05, 0.1, 0.15)[d % 4]
            body = body + edited(rnd, w, int(rate * len(w)), vocabulary) + text(rnd.randrange(0, 120))
            want.add((d, i))
        rows.append((d, " ".join(body).title() + "."))
    rows += [(400, None), (401, ""), (None, " ".join(items[0][1]))]
    bench = spark.createDataFrame([(i, "  ".join(w)) for i, w in items] + [(101, None), (102, ""), (None, "null id")], "item_id long, text string")
    got = decontaminate.contaminated(frame(spark, rows), bench).collect()
    found = {(r["doc_id"], r["item_id"]) for r in got}
    assert (None, 0) in found
    found.discard((None, 0))
    assert not found - want and len(found) >= 0.97 * len(want)
    assert all(r["edits"] <= 0.2 * r["item_words"] + 1e-9 and r["end_word"] > r["start_word"] for r in got)
    several = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(frame(spark, rows), bench, block_items=11).collect()}
    assert several == found | {(None, 0)}
    assert decontaminate.contaminated(nothing, bench).count() == 0 and decontaminate.contaminated(frame(spark, rows), bench.limit(0)).count() == 0


@pytest.mark.parametrize("n", [12, 13, 14, 15, 16, 18, 19, 20, 25, 40])
def test_decontamination_recall_at_most_edits(n):
    rnd = random.Random(n)
    vocabulary = [f"v{i}" for i in range(3000)]
    text = lambda k: [rnd.choice(vocabulary) for _ in range(k)]
    items, docs = [text(n) for _ in range(400)], []
    for w in items:
        body = [[x] for x in w]
        for j in rnd.sample(range(n), n // 5):  # edits of different words
            body[j] = rnd.choice([[rnd.choice(vocabulary)], [rnd.choice(vocabulary)], [], [rnd.choice(vocabulary), w[j]]])
        docs.append(" ".join(text(rnd.randrange(10, 40)) + sum(body, []) + text(rnd.randrange(10, 40))))
    index = decontaminate.build_indexes([(i, " ".join(w)) for i, w in enumerate(items)])
    found = {(t.first + x, i) for t in B.texts(pa.array(docs, pa.large_string())) for x, i, *_ in decontaminate.find_in(t, index, 0.8)}
    assert sum((d, d) in found for d in range(len(docs))) >= 0.99 * len(docs)


def brute_contaminated(docs, items, similarity=0.8):
    """(doc, item) where a stretch of the document lies within the edits allowed, by plain dynamic programming."""
    out = set()
    for d, text in docs:
        for i, item in items:
            row = [0] * (len(text) + 1)  # edits of the item's words so far against a stretch that ends here
            for n, x in enumerate(item, 1):
                last, row[0] = row[0], n
                for j, y in enumerate(text):
                    last, row[j + 1] = row[j + 1], min(row[j + 1] + 1, row[j] + 1, last + (x != y))
            if item and min(row) <= int((1 - similarity) * len(item) + 1e-9):
                out.add((d, i))
    return out


@pytest.mark.parametrize("n", range(1, 12))
def test_short_items_are_all_found(n):
    rnd = random.Random(100 + n)
    vocabulary = [f"v{i}" for i in range(40)]  # so few words that much nearly matches
    text = lambda k: [rnd.choice(vocabulary) for _ in range(k)]
    items = [(i, text(n)) for i in range(25)]
    docs = [(d, text(rnd.randrange(0, 15)) + edited(rnd, items[d % 25][1], rnd.randrange(0, n // 5 + 1), vocabulary) + text(rnd.randrange(0, 15))) for d in range(100)]
    index = decontaminate.build_indexes([(i, " ".join(w)) for i, w in items])
    found = {(t.first + x, i) for t in B.texts(pa.array([" ".join(w) for _, w in docs], pa.large_string())) for x, i, *_ in decontaminate.find_in(t, index, 0.8)}
    assert found == brute_contaminated(docs, items)


@pytest.mark.parametrize("n", [511, 512, 513, 1025])
def test_long_items_are_compared_whole(spark, n):
    rnd = random.Random(n)
    item = [f"i{rnd.randrange(10**6)}" for _ in range(n)]
    clean = lambda k: [f"c{rnd.randrange(5000)}" for _ in range(k)]
    allowed = n // 5
    docs = [(0, clean(30) + item[-1:] + clean(30)), (1, clean(30) + item[: n // 2] + clean(30)), (2, clean(30) + item[n // 2 :])]
    for d, edits in ((3, 0), (4, n // 20), (5, allowed - 1)):
        docs.append((d, clean(20) + edited(rnd, item, edits, ["zz"]) + clean(20)))
    body = list(item)
    for j in rnd.sample(range(n), allowed + 1):
        body[j] = "zz"
    docs.append((6, clean(20) + body + clean(20)))
    want = brute_contaminated(docs, [(7, item)])
    assert {d for d, _ in want} == {3, 4, 5}
    got = decontaminate.contaminated(frame(spark, [(d, " ".join(w)) for d, w in docs]), spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == want and {r["item_words"] for r in got} == {n}


def test_banded_distance():
    rnd = random.Random(14)
    for _ in range(40):
        item = [rnd.randrange(1, 9) for _ in range(rnd.randrange(1, 40))]
        body = edited(rnd, item, rnd.randrange(0, max(1, len(item) // 3)), list(range(1, 9)))
        before, after = ([rnd.randrange(1, 9) for _ in range(rnd.randrange(0, 9))] for _ in range(2))
        window = np.array(before + body + after, np.uint64)
        exact = decontaminate.edit_distance(np.array(item, np.uint64), window)[0]
        edits, s, e = decontaminate.banded_distance(np.array(item, np.uint64), window, len(before), len(item))
        assert edits == exact == _levenshtein(item, window[s:e].tolist())


def test_very_long_and_repeated_items(spark):
    many = " ".join(f"many{j}" for j in range(60_000))
    bench = spark.createDataFrame([(1, many), (2, many), (3, "one two three four"), (4, "ONE two, three four")], "item_id long, text string")
    docs = frame(spark, [(1, f"x {many} y"), (2, "many59999 many3"), (3, "zero one two three four five"), (3, "zero one two three four five"), (4, "one two four")])
    got = Counter((r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs, bench).collect())
    assert got == Counter({(1, 1): 1, (1, 2): 1, (3, 3): 2, (3, 4): 2})


def test_decontamination_query_against_brute_force(spark, sf):
    """Every document of the smallest table against every item, by plain dynamic programming."""
    from panelspark.llm.queries import QUERIES

    def words_of(table, key):
        rows = spark.read.parquet(f"{sf}/{table}.parquet").collect()
        return [(r[key], "".join(c.lower() if c.isascii() and c.isalnum() else c if not c.isascii() else " " for c in r["text"] or "").split()) for r in rows]

    docs, items = words_of("documents", "doc_id"), words_of("benchmark", "item_id")
    vocabulary = {x for _, w in items for x in w}
    near = [(d, w) for d, w in docs if sum(x in vocabulary for x in w)]
    want = set()
    for d, w in near:
        counts = Counter(w)
        some = [(i, x) for i, x in items if x and sum((Counter(x) & counts).values()) >= 0.8 * len(x) - 1e-9]  # else too many words lack
        want |= brute_contaminated([(d, w)], some)
    got = {(r["doc_id"], r["item_id"]) for r in QUERIES["op2_decontamination"](spark, sf).collect()}
    assert want and got <= want and len(got) >= 0.99 * len(want)


def test_edit_distance():
    rnd = np.random.default_rng(7)
    for _ in range(60):
        item, window = rnd.integers(0, 4, rnd.integers(1, 8)).astype(np.uint64), rnd.integers(0, 4, rnd.integers(1, 14)).astype(np.uint64)
        n = len(window)
        plain = lambda a, b: _levenshtein(a.tolist(), b.tolist())
        best = min(plain(item, window[s:e]) for s in range(n + 1) for e in range(s, n + 1))
        edits, s, e = decontaminate.edit_distance(item, window)
        assert edits == best == plain(item, window[s:e])


def _levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        last, row[0] = row[0], i + 1
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], min(row[j + 1] + 1, row[j] + 1, last + (x != y))
    return row[-1]


def test_packing_round_trip(docs, rows, nothing):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(path("byte_bpe_50k.json"))
    want = Counter()
    for i, t in rows:
        ids = np.array([*plain.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want.update((i, k, s, n, zlib.crc32(ids[s : s + n].tobytes())) for k, (s, n) in enumerate(packing.cut(len(ids), 64)))
    got = packing.pack_documents(docs, 64, 16, group_bytes=40_000).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    bins = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in bins.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 64
    assert len(bins) <= 1.1 * sum(r["length"] for r in got) / 64 + 16
    assert packing.pack_documents(nothing).count() == 0


@pytest.mark.parametrize("text", ["It's a test, we'll see", "naïve Ünïcode  \n\n tabs\t\t", "<|endoftext|> inside", "日本語 and ½ 12345", " ", "a b c", "x" * 5000])
def test_ids_are_those_of_tokenizers(text):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    assert packing.encoder().ids(text).tolist() == Tokenizer.from_file(path("byte_bpe_50k.json")).encode(text, add_special_tokens=False).ids


def test_fullest_bin_closes_first():
    p = packing.BestFit(10, 2)
    assert [p.add(n) for n in (7, 4, 8, 6, 2)] == [(0, 0), (1, 0), (2, 0), (1, 4), (2, 8)]


def labelled(spark, seed=8, n=400):
    rnd = random.Random(seed)
    good = lambda: " ".join(rnd.choice(["tree", "house", "and", "the", "river", "walks"]) for _ in range(40)) + "."
    bad = lambda: " ".join(rnd.choice(["BUY!!", "NOW$$", "CHEAP!!"]) for _ in range(30))
    rows = [(i, good() if i % 3 else bad()) for i in range(n)] + [(None, "x"), (n, None), (n + 1, "")]
    labels = spark.createDataFrame([(i, int(i % 3 != 0), i % 4) for i in range(n)] + [(None, 1, 0), (n, None, None)], "doc_id long, quality int, toxic int")
    return frame(spark, rows), labels


def test_quality_on_held_out_rows(spark, nothing):
    docs, labels = labelled(spark)
    model = quality.learn(docs, labels)
    assert 0 < len(model.rules) and all("_stats." in r.sql() for r in model.rules)
    got = quality.score(docs, model).collect()
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got if r["doc_id"] is not None)
    assert np.mean([r["predicted"] == int(r["doc_id"] % 3 != 0) for r in held if r["doc_id"] < 400]) > 0.98
    assert len(got) == 403 and all(0 <= r["score"] <= 1 for r in got)
    assert quality.score(nothing, model).count() == 0
    none = quality.learn(docs, labels.limit(0))
    assert {r["score"] for r in quality.score(docs, none).collect()} == {0.5}


def test_quality_of_repeated_and_very_long_rows(spark):
    docs, labels = labelled(spark)
    model = quality.learn(docs, labels)
    rows = [(1, "the river walks. " * 60_000), (1, "the river walks. " * 60_000), (2, "BUY!! NOW$$ " * 40), (2, "BUY!! NOW$$ " * 40), (3, None), (4, ""), (None, "BUY!! NOW$$ " * 40)]
    got = quality.score(frame(spark, rows), model).collect()
    scores = {}
    for r in got:
        scores.setdefault(r["doc_id"], set()).add(round(r["score"], 12))
    assert len(got) == 7 and all(len(x) == 1 for x in scores.values())
    assert scores[2] == scores[None] and scores[3] == scores[4] and all(r["held_out"] is None for r in got if r["doc_id"] is None)


def test_statistics_by_hand():
    s = quality.statistics(next(iter(B.texts(pa.array(["Ab c!\nAb c!", None, "1 2"])))))
    assert s["n_words"].tolist() == [4, 0, 2] and s["n_lines"].tolist() == [2, 1, 1]
    assert s["distinct_word"].tolist() == [0.5, 0, 1] and s["repeated_line"].tolist() == [0.5, 0, 0]
    assert s["upper"].tolist() == [2 / 6, 0, 0] and s["symbol_word"].tolist() == [0.5, 0, 0]


def test_toxicity_grades(spark, nothing):
    rnd = random.Random(9)
    mild, harsh, calm = ["silly", "dull"], ["awful", "vile"], [f"calm{i}" for i in range(50)]
    rows, labels = [], []
    for i in range(600):
        g = i % 3
        w = [rnd.choice(calm) for _ in range(30)] + [rnd.choice(mild) for _ in range(2 * (g == 1))] + [rnd.choice(harsh) for _ in range(2 * (g == 2))]
        rnd.shuffle(w)
        rows.append((i, " ".join(w)))
        if i < 400:
            labels.append((i, g))
    rows += [(1000, None), (1001, ""), (None, "vile vile awful")]
    docs = frame(spark, rows)
    model = toxicity.learn(docs, spark.createDataFrame([*labels, (None, 1), (5, None)], "doc_id long, toxic int"))
    assert len(model.theta) == 2 and model.theta[0] < model.theta[1]
    got = {r["doc_id"]: r for r in toxicity.severity(docs, model).collect()}
    assert np.mean([got[i]["grade"] == i % 3 for i in range(400, 600)]) > 0.95
    assert got[None]["expected_severity"] > 0.7 and 0 <= got[1000]["expected_severity"] == got[1001]["expected_severity"] <= 1
    assert toxicity.severity(nothing, model).count() == 0
    flat = toxicity.learn(docs, spark.createDataFrame([(1, 0)], "doc_id long, toxic int"))
    assert max(r["expected_severity"] for r in toxicity.severity(docs, flat).collect()) < 0.01


def test_toxicity_sample_is_bounded_after_the_join(spark, monkeypatch):
    """Two labelled ids that repeat in 3,000 rows: as many rows are learnt from as asked; ties at the threshold count as toxic."""
    docs = frame(spark, [(i % 2, "vile words" if i % 2 else "calm words") for i in range(3000)] + [(2, "long " * 100_000)])
    sizes, fit = [], toxicity.fit_ordinal
    monkeypatch.setattr(toxicity, "fit_ordinal", lambda *a: sizes.append(len(a[3])) or fit(*a))
    model = toxicity.learn(docs, spark.createDataFrame([(0, 0), (1, 1), (1, 1)], "doc_id long, toxic int"), max_rows=50)
    assert all(n <= 50 for n in sizes)
    flat = toxicity.CumulativeLink(np.zeros(0, np.uint32), np.zeros(0), np.array([np.log(1 / toxicity.THRESHOLD - 1)]))
    got = toxicity.severity(docs, flat).select("expected_severity").distinct().collect()
    assert len(got) == 1 and abs(got[0][0] - toxicity.THRESHOLD) < 1e-12
    scores = toxicity.severity(docs, model).groupBy("doc_id").agg(F.count_distinct("expected_severity").alias("n")).collect()
    assert all(r["n"] == 1 for r in scores) and len(scores) == 3


def test_toxicity_scores_by_hand(spark):
    """Scores of the operator against a plain sum over each text's distinct words and beginnings."""
    rows = [(1, "Vile, vile things"), (2, "calm"), (3, None), (3, None), (4, "")]
    number = lambda w: toxicity.features(next(B.texts(pa.array([w]))))[0].tolist()
    weight = {x: 0.5 + i for i, x in enumerate(dict.fromkeys(number("vile things")))}
    keys = np.array(sorted(weight), np.uint32)
    model = toxicity.CumulativeLink(keys, np.array([weight[k] for k in keys.tolist()]), np.array([0.25, 1.5]))
    for r in toxicity.severity(frame(spark, rows), model).collect():
        eta = sum(weight.get(x, 0.0) for x in set(number(r["text"] or "")))
        above = [1 / (1 + math.exp(t - eta)) for t in (0.25, 1.5)]
        assert math.isclose(r["expected_severity"], sum(above) / 2, rel_tol=1e-9)
        p = [1 - above[0], above[0] - above[1], above[1]]
        assert r["grade"] == p.index(max(p))


def test_language_model(spark, docs, rows, nothing):
    got = maxent.score_documents(docs, fold_of("doc_id", 7) != 2).collect()
    train = [t for i, t in rows if i is not None and zlib.crc32(str(i).encode()) % 7 != 2]
    count = Counter(w for t in train for w in [*words(t, lower=True), None])
    n, v = sum(count.values()), len(count)
    want = Counter()
    for i, t in rows:
        w = [*words(t, lower=True), None]
        want[i, len(w), sum(count[x] > 0 for x in w), n, round(sum(math.log10((count[x] + 1) / (n + v + 1)) for x in w), 5)] += 1
    assert Counter((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 5)) for r in got) == want
    assert all(r["score"] < 0 for r in got) and maxent.score_documents(nothing).count() == 0
    empty = maxent.score_documents(docs, F.lit(False)).collect()
    assert all(r["train_tokens"] == 0 and r["n_known"] == 0 for r in empty)


def test_scores_are_log_probabilities(spark, docs, rows):
    """The query's scores against a plain walk through the tree, and the sum over all words and places of unseen ones."""
    training = docs.filter(fold_of("doc_id", 7) != 2).select("text")
    counts = maxent.count_words(training, 4)
    model = maxent.train(training, maxent.start_model(counts, 2, 1 << 12), 2)
    assert np.abs(model.weights).max() > 0.1
    seen = {c: n for r in counts.collect() for c, n in zip(np.frombuffer(r["code"], np.uint64).tolist(), np.frombuffer(r["n"], np.int64).tolist(), strict=True)}

    def leaf_log(code, level, context):
        z = model.logits([np.array([c], np.uint64) for c in context], np.array([code], np.uint64), level)[0].astype(float)
        return z[(code >> (60 - 4 * level)) & 15] - math.log(sum(map(math.exp, z)))

    def log10(code, context):
        leaf = code >> 56
        return sum(leaf_log(code, level, context) for level in range(2)) / math.log(10) + math.log10((seen.get(code, 0) + 1) / model.mass[leaf])

    code, offsets = maxent.tokens(next(B.texts(pa.array([rows[4][1], "never seen words", ""]))))
    contexts = np.stack(model.contexts(code, offsets), axis=1).tolist()
    mine = [sum(log10(c, x) for c, x in list(zip(code.tolist(), contexts, strict=True))[a:b]) for a, b in zip(offsets, offsets[1:])]
    kept = np.array([seen.get(c, 0) for c in code.tolist()])
    fast = np.add.reduceat(model.score(code, offsets) + np.log10(kept + 1) - model.logs[model.leaf(code)], offsets[:-1])
    assert np.allclose(mine, fast, atol=1e-4)
    for x in contexts[:3]:
        total = sum(10 ** log10(c, x) for c in seen) + sum(10 ** log10(leaf << 56 | 0xABCDEF, x) for leaf in range(256))
        assert abs(total - 1) < 1e-4


def test_language_model_learns_from_contexts(spark, nothing):
    rnd = random.Random(11)
    follows = {f"w{i}": [f"w{(7 * i + j) % 60}" for j in (1, 2)] for i in range(60)}
    rows = []
    for d in range(700):
        w = ["w0"]
        while len(w) < 60:
            w.append(rnd.choice(follows[w[-1]]))
        rows.append((d, " ".join(w)))
    got = maxent.score_documents(frame(spark, rows), F.col("doc_id") < 600).filter("doc_id >= 600").collect()
    gain = np.mean([(r["score"] - r["base_score"]) / r["n_tokens"] for r in got])
    assert gain > 0.5, gain  # of 1.47, from 60 words to 2
    deep = maxent.score_documents(frame(spark, rows), F.col("doc_id") < 600, depth=3, rounds=1).filter("doc_id >= 600").collect()
    assert np.mean([(r["score"] - r["base_score"]) / r["n_tokens"] for r in deep]) > 0.4


def test_common_words_cost_an_entry_per_home(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("common words of all texts x"), F.col("id")).alias("text"))
    texts = maxent.dealt(docs, 8, "doc_id", "text", ())
    asks = texts.groupBy("_ps_home").applyInArrow(maxent.ask_counts(8), "bucket int, code binary, home int")
    most = asks.groupBy("bucket").agg((F.sum(F.octet_length("code")) / 8).alias("n")).agg(F.max("n")).first()[0]
    assert most < 1.2 * (20_000 + 8 * 6) / 8
    sent = docs.select("text").mapInArrow(maxent.send_counts(8), "bucket int, code binary, n binary")
    assert sent.agg(F.sum(F.octet_length("code")) / 8).first()[0] < 20_000 + 6 * 16


def test_pipeline_stages(spark, sf, duck):
    import corpus_pipeline as C

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in C.STAGES[:-1]:
        out = stage(spark, docs, sf).cache()
        assert out.columns == docs.columns and out.count() <= docs.count(), name
        docs = out
    packed = C.STAGES[-1][1](spark, docs, sf)
    assert packed.select("doc_id").distinct().count() == docs.count()
    assert C.run(spark, sf).count() == packed.count()


@pytest.mark.parametrize("name", ["op1_nearest_neighbours", "op3_substring_dedup", "op4_line_dedup", "op5_suffix_array_dedup", "op8_ngram_jaccard_join"])
def test_registered_queries_match_sql(name, spark, sf, duck):
    from helpers import row_set

    from panelspark.llm.queries import ORACLES, QUERIES

    assert row_set(QUERIES[name](spark, sf).toPandas()) == row_set(duck.execute(ORACLES[name]).df())
