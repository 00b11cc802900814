"""Each stage of the pipeline against plain Python, on rows with every odd case."""

import math
import random
from collections import Counter

import pyarrow as pa
import pytest
from test_dedup import ORDER, brute_components, brute_lines
from test_models import brute_contaminated

from panelspark.llm import bytetext as B
from panelspark.llm import toxicity

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, n_lines string, grade int, _text string, passages int, expected_severity double, component_id long, row string, rest string, document long, kept string"
#: Values of the columns that operators use names of; they must come out as they went in.
OTHERS = ("en", "src", "lines", 5, "other text", 6, 0.25, 7, "row", "rest", 8, "kept")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    rnd = random.Random(16)
    word = lambda: f"v{rnd.randrange(2000)}"
    text = lambda k: " ".join(word() for _ in range(k))
    items = [(i, text(rnd.randrange(12, 40))) for i in range(8)] + [(8, "just three words"), (9, None), (None, "null id item")]
    rows, labels = [], []
    for i in range(240):
        body = text(rnd.randrange(5, 60))
        if i % 4 == 0:
            body += " awful vile rubbish"
        if i % 5 == 1:
            body = f"\tShared LINE \n{body}\nshared line"
        if i % 7 == 2 and rows:
            body = rows[rnd.randrange(len(rows))][1]
        if i % 9 == 3:
            body += " " + items[i % 9][1]
        rows.append((i, body))
        labels.append((i, 1, int("vile" in body)))
    rows += [(500, None), (501, ""), (502, " \n "), (503, "one"), (None, "unseen clean words of a null id"), (None, f"held {items[0][1]} here"), (None, None), (504, text(60_000))]
    rows += [rows[1], rows[1], rows[6], (7, text(30)), (-1, rows[11][1])]
    full = [(i, t, *OTHERS[:2], None if t is None else len(t), *OTHERS[2:]) for i, t in rows]
    spark.createDataFrame(full, COLUMNS).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([*labels, (None, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").coalesce(1).write.parquet(f"{path}/benchmark.parquet")
    return path


def normal(text):
    return "".join(c.lower() if c.isascii() and c.isalnum() else c if not c.isascii() else " " for c in text or "").split()


def not_toxic(rows, model):
    weight = dict(zip(model.feature.tolist(), model.weight.tolist(), strict=True))
    out = []
    for r in rows:
        number = toxicity.features(next(B.texts(pa.array([r["text"] or ""]))))[0]
        eta = sum(weight.get(x, 0.0) for x in number.tolist())
        if sum(1 / (1 + math.exp(t - eta)) for t in model.theta) / len(model.theta) < toxicity.THRESHOLD:
            out.append((r["doc_id"], r["text"]))
    return Counter(out)


def pairs(df):
    return Counter((r["doc_id"], r["text"]) for r in df.collect())


def test_stages(spark, folder):
    import corpus_pipeline as C

    docs = spark.read.parquet(f"{folder}/documents.parquet").cache()
    stage = dict(C.STAGES)

    def checked(name, before):
        after = stage[name](spark, before, folder).cache()
        assert after.schema == before.schema
        for r in after.collect():
            assert (r["lang"], r["source"], *(r[c] for c in after.columns[5:])) == OTHERS
            assert r["n_chars"] == (None if r["text"] is None else len(r["text"]))
        return after

    model = toxicity.learn(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    clean = checked("toxicity", docs)
    assert pairs(clean) == not_toxic(docs.collect(), model)
    left = {t for _, t in pairs(clean)}
    assert not any("vile" in (t or "") for t in left) and {None, "", " \n "} <= left

    rows = [(r["doc_id"], r["text"]) for r in clean.collect()]
    short = checked("line_dedup", clean)
    assert Counter((i, t or "") for i, t in pairs(short).elements()) == Counter((i, t) for i, _, _, t in brute_lines(rows, 10).elements())

    rows = [(r["doc_id"], r["text"]) for r in short.collect()]
    single = checked("ngram_jaccard_join", short)
    grouped = brute_components([(k, t) for k, (_, t) in enumerate(rows)], 5, 80)  # by place
    members = {}
    for place, _, least in grouped:
        members.setdefault(least, []).append(rows[place])
    assert len(members) < len(rows)
    assert pairs(single) == Counter(min(m, key=lambda x: ORDER(x[0])) for m in members.values())

    rows = [(r["doc_id"], r["text"]) for r in single.collect()]
    items = [(r["item_id"], normal(r["text"])) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect() if r["item_id"] is not None]
    final = checked("decontamination", single)
    hit = {k for k, _ in brute_contaminated([(k, normal(t)) for k, (_, t) in enumerate(rows) if len(normal(t)) < 1000], items)}
    assert hit and pairs(final) == Counter(x for k, x in enumerate(rows) if k not in hit)
    assert any(i is None for i, _ in pairs(final).elements())  # the clean row of a null id stays

    packed = stage["best_fit_packing"](spark, final, folder).collect()
    assert Counter(r["doc_id"] for r in packed if r["piece"] == 0) == Counter(i for i, _ in pairs(final).elements())
    assert sum(r["length"] for r in packed) > 60_000 and max(r["length"] for r in packed) <= 2048
    assert Counter((r["doc_id"], r["piece"], r["length"]) for r in C.run(spark, folder).collect()) == Counter((r["doc_id"], r["piece"], r["length"]) for r in packed)


def test_stages_of_an_empty_table(spark, folder):
    import corpus_pipeline as C

    nothing = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for name, stage in C.STAGES:
        assert stage(spark, nothing, folder).count() == 0, name
    plain = spark.createDataFrame([(1, "only two columns")], "doc_id long, text string")
    for _, stage in C.STAGES[:-1]:
        assert [tuple(r) for r in stage(spark, plain, folder).collect()] == [(1, "only two columns")]
