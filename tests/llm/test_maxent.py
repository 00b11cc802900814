"""The language model's parts against plain Python: codes of words, features, steps, and the tree of means."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from cases import frame, words

from panelspark.llm import bytetext as B
from panelspark.llm import maxent as M

ODD = ["", " ", "a", "ab A AB", "\t\n\x0b\x0c\r x", "exactly8 exactly8s ninechars1 sixteen_letters_ seventeen_letters", "é 日本語 🙂🙂 ÀÉ ÀÉ", "x" * 5_000 + " " + "x" * 5_001, "same same", "same"]


def test_codes_tell_words_apart_and_nothing_else(rows):
    texts = [t for _, t in rows] + ODD + ["".join(random.Random(k).choice("abAB é\n") for _ in range(400)) for k in range(50)]
    code_of, text_at = {}, 0
    for t in B.texts(pa.array(texts)):
        code, offsets = M.tokens(t)
        for i in range(len(t)):
            own, w = code[offsets[i] : offsets[i + 1]].tolist(), [*words(texts[text_at], lower=True), None]
            assert len(own) == len(w)
            assert all(code_of.setdefault(x, c) == c for x, c in zip(w, own, strict=True))
            text_at += 1
    assert text_at == len(texts) and len(set(code_of.values())) == len(code_of)


def test_shape_of_a_code_is_that_of_its_ends():
    """Words that begin or end alike share those bits, whatever stands before or after them."""
    code, _ = M.tokens(next(B.texts(pa.array(["walking talking walker", "xwalking a", "ing walking"]))))
    walking, talking, walker, _, xwalking, _, _, ing, again, _ = code.tolist()
    assert again == walking
    assert walking >> 60 == talking >> 60 == xwalking >> 60 == ing >> 60
    assert walking >> 56 & 15 == walker >> 56 & 15


def small_model(rows=64):
    mass = np.arange(1.0, 257.0)
    weights = np.random.default_rng(1).normal(0, 0.3, (rows, M.BRANCHES)).astype(np.float32)
    return M.Model(1000, 100, mass, weights)


def test_every_gradient_of_a_batch_is_applied():
    """One mini-batch against a plain walk: the last token of each row steps by itself, the sum of the others after it."""
    model = small_model()
    code, offsets = M.tokens(next(B.texts(pa.array([" ".join(random.Random(5).choice(["ab", "cd", "abc", "zz", "q"]) for _ in range(300))]))))
    trainer = M.Trainer(model, 0.5)
    trainer.learn(code, offsets)
    weights, seen = model.weights.astype(float).copy(), np.zeros(len(model.weights))
    contexts = model.contexts(code, offsets)

    def step(row, gradient, held):
        seen[row] += (gradient**2).sum()
        rate = 0.5 / math.sqrt(seen[row] + 1)
        weights[row] = held * (1 - M.PENALTY * rate) - gradient * rate

    for level in range(2):
        rows = [model.rows(c, code, level) for c in contexts]
        z = model.offset[level][(code >> np.uint64(64 - 4 * level)).astype(int) if level else np.zeros(len(code), int)].astype(float)
        z = z + sum(weights[r] for r in rows)
        p = np.exp(z) / np.exp(z).sum(axis=1, keepdims=True)
        p[np.arange(len(code)), model.branch(code, level)] -= 1
        start = weights.copy()
        for r in rows:
            before = start if r is rows[0] else None
            last = {int(x): i for i, x in enumerate(r)}
            held = {x: (start[x] if before is not None else first_read[x]).copy() for x in last}
            if r is rows[0]:
                first_read = start
            for x, i in last.items():
                step(x, p[i], held[x])
            for x, i in last.items():
                others = [j for j in np.flatnonzero(r == x) if j != i]
                if others:
                    step(x, p[others].sum(axis=0), weights[x].copy())
    assert len(code) > len({int(x) for x in rows[0]}) * 2  # most rows are met several times
    assert np.allclose(trainer.weights, weights, atol=1e-3) and np.allclose(trainer.seen, seen, rtol=1e-3)


def test_features_are_those_named(rows):
    """A token's three features: the last word, the one before it, and the shapes of both; blanks before a text."""
    model = small_model()
    code, offsets = M.tokens(next(B.texts(pa.array(["a b c d", "b c"]))))
    mix = lambda x, salt: int(B.mix(np.array([x], np.uint64), salt)[0])
    got = np.stack(model.contexts(code, offsets), axis=1).tolist()
    for a, b in zip(offsets.tolist(), offsets[1:].tolist(), strict=False):
        for i in range(a, b):
            one, two = (int(code[i - k]) if i - k >= a else 0 for k in (1, 2))
            assert got[i] == [mix(one, 91), mix(two, 92), mix((one >> 56) << 8 | two >> 56, 93)]


@pytest.mark.parametrize("tasks", [1, 3, 7])
def test_means_form_a_tree(spark, monkeypatch, tasks):
    """With two members to a group, the mean of all tasks is still in proportion to what each saw."""
    monkeypatch.setattr(M, "FAN_IN", 2)
    docs = frame(spark, [(i, f"w{i % 5} w{i % 3} end{i % 2}") for i in range(200)]).select("text").repartition(tasks)
    start = M.start_model(M.count_words(docs, 2), 1, 1 << 12)
    parts = [r["text"] for r in docs.collect()]
    by_task = [[r["text"] for r in docs.filter(M.F.spark_partition_id() == k).collect()] for k in range(tasks)]
    assert sorted(parts) == sorted(t for texts in by_task for t in texts)
    total = weight = 0
    for texts in by_task:
        trainer = M.Trainer(start)
        for t in B.texts(pa.array(texts)):
            trainer.learn(*M.tokens(t))
        s = trainer.seen.astype(float)[:, None] + 1e-9
        total, weight = total + trainer.weights.astype(np.float16) * s, weight + s
    model = M.train(docs, start, 1, tasks=tasks)
    assert np.allclose(model.weights, total / weight, atol=2e-3)
    assert np.abs(model.weights).max() > 0.05


def test_held_out_gain(spark):
    """On sf0.1 the model's score beats the base by over 0.3 per token on texts it has not learned from."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    got = M.op9_lm_scoring(spark, "/root/testdata/sf0.1").filter("held_out").agg(M.F.sum("score"), M.F.sum("base_score"), M.F.sum("n_tokens")).first()
    assert docs.count() == 10_000 and (got[0] - got[1]) / got[2] > 0.3, (got[0] - got[1]) / got[2]
