"""Language-model scoring by a hashed maximum-entropy model.

The base is an exact unigram count of all training tokens: a task sends each
distinct word of its flush once, a bucket adds the sums up.

The model factors a token along a tree of classes: a word's ending, its beginning
and its hash name a branch of sixteen at each of up to three levels, and the
leaf; few words make a shallower tree.  At each node stands a softmax over the sixteen branches, of the branches' exact counts
times weights of hashed features of the context: the last word, the one before
it alone (a skip), and the shapes of the last two.  Inside a leaf a word has its exact share,
with one place for every word never seen, so all probabilities add up to one.

Every task runs over its part of the training texts in mini-batches of gradient
updates from the same start; the mean of the tasks' weights, row by row in
proportion to what each task saw of the row, is the next round's start.

For scoring, texts are dealt into homes; a home asks for each of its distinct
words once, so a word that all texts hold costs its bucket one entry per home.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm import bytetext as B
from panelspark.llm.common import buckets, cut, fold_of, table, text_bytes
from panelspark.llm.exchange import deal, opened, runs, total_by
from panelspark.llm.substrings import dealt, meet

BUCKET_BYTES = 16 << 20
#: Branches of a node, as bits; and the deepest tree (its leaves' masses go to every task).
BITS, DEEPEST = 4, 3
BRANCHES = 1 << BITS
#: Rows of feature weights: one for so many training tokens, between these bounds (of 64 bytes each, sent to every task).
TOKENS_PER_ROW, LEAST_ROWS, MOST_ROWS = 16, 1 << 12, 1 << 18
BATCH_TOKENS = 1 << 12
SCORE_TOKENS = 1 << 12
#: Step of the updates, and how strongly each draws the rows it touches towards zero.
RATE, PENALTY = 0.5, 0.02
ROUNDS = 2
#: Text that one task learns from, at least: its weights are smaller than that.
TRAINER_BYTES = 32 << 20
#: Tasks whose weights are averaged in one group, and parts that the rows are averaged in.
FAN_IN, PARTS = 64, 16
FLUSH_TOKENS = 1 << 20

END = np.uint64(0x5EED0FE2D0C0FFEE)
#: Four bits for each pair of bytes.
_PAIR = B.mix(np.arange(1 << 16, dtype=np.uint64), 80) >> np.uint64(60)
#: A row of weights as one item, and what adds its branches up.
_ROW, _ONES = np.dtype((np.void, 4 * BRANCHES)), np.ones(BRANCHES, np.float32)
#: Masks of the first bytes of eight.
_FIRST_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def tokens(t: B.Texts) -> tuple[np.ndarray, np.ndarray]:
    """Codes of each text's words and its end, and where each text begins.

    A code's first four bits stand for the word's ending, the next four for its
    beginning (two bytes each), the others for the word: its leading bits are
    its way through the tree, whose upper classes thus hold words of like shape.
    Words are read eight bytes at a time, most of them at once.
    """
    n = len(t.data)
    data = np.zeros(n + 8, np.uint8)
    np.add(t.data, ((t.data - np.uint8(0x41)) < 26).view(np.uint8) << np.uint8(5), out=data[:n])  # A-Z lower-cased
    inside = np.zeros(n + 2, bool)
    np.logical_not((data[:n] == 0x20) | ((data[:n] - np.uint8(9)) < 5), out=inside[1:-1])
    cut = np.zeros(n + 1, bool)
    cut[t.offsets] = True
    start = np.flatnonzero(inside[1:] & (cut | ~inside[:-1]))
    end = np.flatnonzero(inside[:-1] & (cut | ~inside[1:]))
    length = end - start
    eight, two = (np.ndarray((n + 1,), d, data, strides=(1,)) for d in ("<u8", "<u2"))  # from any byte on
    first = eight[start] & _FIRST_BYTES[np.minimum(length, 8)]
    h = B.mix(first ^ length.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    done, longer = 8, np.flatnonzero(length > 8)
    while len(longer):
        h[longer] = B.mix(h[longer] ^ (eight[start[longer] + done] & _FIRST_BYTES[np.minimum(length[longer] - done, 8)]), 79)
        done += 8
        longer = longer[length[longer] > done]
    single = (first & np.uint64(0xFF)) * np.uint64(0x101)
    beginning = np.where(length == 1, single, first & np.uint64(0xFFFF)).astype(np.int64)
    ending = np.where(length == 1, single, two[np.maximum(end - 2, 0)]).astype(np.int64)
    shape = _PAIR[ending] << np.uint64(4) | _PAIR[beginning]
    of_text = np.searchsorted(start, t.offsets)
    offsets = of_text + np.arange(len(of_text))
    out = np.full(int(offsets[-1]), END)
    out[np.arange(len(start)) + np.repeat(np.arange(len(t)), np.diff(of_text))] = shape << np.uint64(56) | B.mix(h, 81) >> np.uint64(8)
    return out, offsets


def bucket_of(code: np.ndarray, n: int) -> np.ndarray:
    return (B.mix(code, 82) % np.uint64(n)).astype(np.int32)


def send_counts(n_buckets: int):
    """Each flush's distinct words and how often they occur."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                code, n = total_by(*map(np.concatenate, zip(*held, strict=True)))
                held.clear()
                yield from deal(bucket_of(code, n_buckets), "bucket", code=code, n=n.astype(np.int64)).to_batches()

        for batch in batches:
            for t in B.texts(batch["text"]):
                h, _ = tokens(t)
                held.append(np.unique(h, return_counts=True))
                size += len(held[-1][0])
                if size >= FLUSH_TOKENS:
                    yield from flush()
                    size = 0
        yield from flush()

    return run


def add_up(key: tuple, blocks: pa.Table) -> pa.Table:
    """A bucket's words (codes rising) and counts."""
    e = opened(blocks, "bucket", code="u8", n="i8")
    code, n = total_by(e["code"], e["n"])
    out = {"bucket": [key[0].as_py()], "code": [code.tobytes()], "n": [n.tobytes()], "total": [int(n.sum())], "distinct": [len(code)]}
    return pa.table(out, schema=pa.schema([("bucket", pa.int32()), ("code", pa.binary()), ("n", pa.binary()), ("total", pa.int64()), ("distinct", pa.int64())]))


def leaf_masses(depth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            e = opened(pa.Table.from_batches([batch]), "bucket", code="u8", n="i8")
            leaf, mass = total_by(e["code"] >> np.uint64(64 - BITS * depth), e["n"] + 1)
            yield pa.RecordBatch.from_arrays([pa.array(leaf.astype(np.int64)), pa.array(mass)], names=["leaf", "mass"])

    return run


def depth_for(distinct: int) -> int:
    """Levels of the tree: as many as leave about a dozen words to a leaf."""
    return int(np.clip(np.rint(np.log2(max(distinct, 1)) / BITS) - 1, 1, DEEPEST))


@dataclass
class Model:
    """Totals, the masses of the leaves, and the weights (a row of branches for each hashed feature)."""

    total: int
    distinct: int
    mass: np.ndarray
    weights: np.ndarray

    def __post_init__(self) -> None:
        self.depth = int(np.log2(len(self.mass))) // BITS
        self.logs = np.log10(self.mass)
        sums = self.mass
        self.offset: list[np.ndarray] = []
        for _ in range(self.depth):
            branches = sums.reshape(-1, BRANCHES)
            sums = branches.sum(axis=1)
            self.offset.insert(0, np.log(branches / sums[:, None]).astype(np.float32))  # shares, so that exp stays small
        self.shift = np.uint64(64 - int(np.log2(len(self.weights))))

    def leaf(self, code: np.ndarray) -> np.ndarray:
        return (code >> np.uint64(64 - BITS * self.depth)).astype(np.int64)

    def contexts(self, code: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        """Hashes of each token's context features; before a text lie blanks."""
        place = np.arange(len(code)) - np.repeat(offsets[:-1], np.diff(offsets))
        back = []
        for k in (1, 2):
            word = np.zeros_like(code)
            word[k:] = code[:-k]
            word[place < k] = 0
            back.append(word)
        one, two = back
        return [B.mix(one, 91), B.mix(two, 92), B.mix((one >> np.uint64(56)) << np.uint64(8) | two >> np.uint64(56), 93)]

    def rows(self, context: np.ndarray, code: np.ndarray, level: int) -> np.ndarray:
        """The row of weights of a context feature at the node that a code passes at a level."""
        node = code >> np.uint64(64 - BITS * level) if level else np.zeros_like(code)
        salt = (node + np.uint64((level << 40) + 1)) * np.uint64(0x9E3779B97F4A7C15)
        return (((context ^ salt) * np.uint64(0xBF58476D1CE4E5B9)) >> self.shift).astype(np.int64)

    def logits(self, context: list[np.ndarray], code: np.ndarray, level: int) -> np.ndarray:
        z = self.offset[level].take((code >> np.uint64(64 - BITS * level)).astype(np.int64) if level else np.zeros(len(code), np.int64), axis=0)
        for c in context:
            z += self.weights.take(self.rows(c, code, level), axis=0)
        return z

    def branch(self, code: np.ndarray, level: int) -> np.ndarray:
        return ((code >> np.uint64(64 - BITS * (level + 1))) & np.uint64(BRANCHES - 1)).astype(np.int64)

    def score(self, code: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """log10 probability of each token's leaf."""
        out = np.zeros(len(code))
        context = self.contexts(code, offsets)
        for a in range(0, len(code), SCORE_TOKENS):
            part = slice(a, a + SCORE_TOKENS)
            for level in range(self.depth):
                out[part] += _log_softmax_at(self.logits([c[part] for c in context], code[part], level), self.branch(code[part], level))
        return out / np.log(10)


def _log_softmax_at(z: np.ndarray, y: np.ndarray) -> np.ndarray:
    at = z.reshape(-1)[np.arange(len(y)) * BRANCHES + y].astype(np.float64)
    return at - np.log((np.exp(z, out=z) @ _ONES).astype(np.float64))


class Trainer:
    """Mini-batch updates of one task, from a shared start; seen holds each row's summed squared gradients."""

    def __init__(self, model: Model, rate: float = RATE):
        self.rate, self.tokens = np.float32(rate), 0
        self.weights = model.weights.copy()
        self.model = Model(model.total, model.distinct, model.mass, self.weights)
        self.seen = np.zeros(len(self.weights), np.float32)
        self.last = np.zeros(len(self.weights), np.int16)  # places in a mini-batch
        self.whole = self.weights.view(_ROW).reshape(-1)  # rows as one item each, which are copied faster
        self.room = np.empty((BATCH_TOKENS, BRANCHES), np.float32)

    def step(self, rows: np.ndarray, w: np.ndarray, gradient: np.ndarray, square: np.ndarray) -> None:
        """One step of each row (w: what they hold); of equal rows the last one counts."""
        seen = self.seen.take(rows) + square
        self.seen[rows] = seen
        move = self.room[: len(rows)]
        np.multiply(w, np.float32(PENALTY), out=move)
        move += gradient
        move *= (self.rate / np.sqrt(seen + 1))[:, None]
        w -= move
        self.whole[rows] = w.view(_ROW).reshape(-1)

    def learn(self, code: np.ndarray, offsets: np.ndarray) -> None:
        """Every token is predicted, and its gradient applied: where several of a mini-batch fall on one row, one takes a step and the others' sum another."""
        m, every = self.model, self.model.contexts(code, offsets)
        for a in range(0, len(code), BATCH_TOKENS):
            mine, context = code[a : a + BATCH_TOKENS], [c[a : a + BATCH_TOKENS] for c in every]
            at, first_of = np.arange(len(mine), dtype=np.int16), np.arange(0, len(mine) * BRANCHES, BRANCHES)
            for level in range(m.depth):
                z = m.offset[level].take((mine >> np.uint64(64 - BITS * level)).astype(np.int64) if level else np.zeros(len(mine), np.int64), axis=0)
                rows = [m.rows(c, mine, level) for c in context]
                held = [self.weights.take(r, axis=0) for r in rows]
                for w in held:
                    z += w
                np.exp(z, out=z)
                z *= (1 / (z @ _ONES))[:, None]
                z.reshape(-1)[first_of + m.branch(mine, level)] -= 1
                square = np.einsum("ij,ij->i", z, z)
                for r, w in zip(rows, held, strict=True):
                    self.last[r] = at
                    self.step(r, w, z, square)
                    others = np.flatnonzero(self.last.take(r) != at)
                    if len(others):
                        others = others[np.argsort(r[others])]
                        first = runs(r[others])
                        several = r[others[first]]
                        total = np.add.reduceat(z.take(others, axis=0), first, axis=0)
                        self.step(several, self.weights.take(several, axis=0), total, np.einsum("ij,ij->i", total, total))
        self.tokens += len(code)


def _mean(key: tuple, parts: pa.Table) -> pa.Table:
    """The tasks' weights, row by row in proportion to what each saw of the row; rows nobody saw stay."""
    total = weight = None
    for w, s in zip(parts["weights"].to_pylist(), parts["seen"].to_pylist(), strict=True):
        s = np.frombuffer(s, np.float32).astype(np.float64) + 1e-9
        w = np.frombuffer(w, np.float16).reshape(len(s), BRANCHES) * s[:, None]
        total, weight = (w, s) if total is None else (total + w, weight + s)
    mean = (total / weight[:, None]).astype(np.float16)
    return pa.table([parts["part"].slice(0, 1), pa.array([key[1].as_py() // FAN_IN], pa.int32()), pa.array([mean.tobytes()], pa.binary()), pa.array([weight.astype(np.float32).tobytes()], pa.binary())], names=["part", "branch", "weights", "seen"])


def train(docs: DataFrame, model: Model, rounds: int = ROUNDS, rate: float = RATE, tasks: int = FAN_IN) -> Model:
    """docs: column text, in as many partitions as tasks.  Each round every task updates from the same weights; their mean comes back.

    The mean is a tree: a group averages FAN_IN tasks or groups at most.
    """
    schema = "part int, branch int, weights binary, seen binary"
    for turn in range(rounds):
        sent = docs.sparkSession.sparkContext.broadcast(model)  # of bounded size

        def run(batches: Iterator[pa.RecordBatch], sent=sent, turn=turn) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            trainer = Trainer(sent.value, rate / (turn + 1))
            for batch in batches:
                for t in B.texts(batch["text"]):
                    trainer.learn(*tokens(t))
            if trainer.tokens:
                n, branch = PARTS, TaskContext.get().partitionId() // FAN_IN
                packed = [pa.array([x.tobytes() for x in np.split(v, n)], pa.binary()) for v in (trainer.weights.astype(np.float16), trainer.seen)]
                yield pa.RecordBatch.from_arrays([pa.array(range(n), pa.int32()), pa.array([branch] * n, pa.int32()), *packed], names=["part", "branch", "weights", "seen"])

        means, groups = docs.mapInArrow(run, schema), -(-tasks // FAN_IN)
        while True:
            means = means.groupBy("part", "branch").applyInArrow(_mean, schema)
            if groups <= 1:
                break
            groups = -(-groups // FAN_IN)
        got = {r["part"]: r["weights"] for r in means.collect()}  # the model's bounded size
        sent.unpersist()
        if got:
            weights = np.concatenate([np.frombuffer(got[i], np.float16).reshape(-1, BRANCHES) for i in range(PARTS)]).astype(np.float32)
            model = Model(model.total, model.distinct, model.mass, weights)
    return model


def count_words(training: DataFrame, n_buckets: int) -> DataFrame:
    """The exact table: for each bucket its words' codes and counts, and their totals.  training: column text."""
    sent = training.mapInArrow(send_counts(n_buckets), "bucket int, code binary, n binary")
    return cut(sent.groupBy("bucket").applyInArrow(add_up, "bucket int, code binary, n binary, total long, distinct long"))


def start_model(counts: DataFrame, depth: int | None = None, rows: int | None = None) -> Model:
    """The untrained model: each leaf weighs as much as its words, and one for those never seen."""
    got = counts.agg(F.sum("total").alias("total"), F.sum("distinct").alias("distinct")).first()
    total, distinct = int(got["total"] or 0), int(got["distinct"] or 0)
    depth = depth or depth_for(distinct)
    leaves = counts.select("bucket", "code", "n").mapInArrow(leaf_masses(depth), "leaf long, mass long").groupBy("leaf").agg(F.sum("mass").alias("mass")).toArrow()  # 16**DEEPEST rows at most
    mass = np.ones(1 << BITS * depth)
    mass[leaves["leaf"].to_numpy()] += leaves["mass"].to_numpy()
    rows = rows or int(2 ** np.ceil(np.log2(np.clip(total / TOKENS_PER_ROW, LEAST_ROWS, MOST_ROWS))))
    return Model(total, distinct, mass, np.zeros((rows, BRANCHES), np.float32))


def ask_counts(n_buckets: int):
    """A home's distinct words, one entry each."""

    def run(key: tuple, docs: pa.Table) -> pa.Table:
        held = [B.distinct(tokens(t)[0]) for t in B.texts(docs["text"])]
        code = B.distinct(np.concatenate([np.zeros(0, np.uint64), *held]))
        out = deal(bucket_of(code, n_buckets), "bucket", code=code)
        return out.append_column("home", pa.array([key[0].as_py()] * out.num_rows, pa.int32()))

    return run


def answer_counts(_: tuple, asks: pa.Table, counts: pa.Table) -> pa.Table:
    """To each home the counts of the words it asked for, but for those that training texts lack."""
    e, c = opened(asks, "home", code="u8"), opened(counts.select(["bucket", "code", "n"]), "bucket", code="u8", n="i8")
    at = np.searchsorted(c["code"], e["code"])
    at[at == len(c["code"])] = 0
    known = c["code"][at] == e["code"] if len(c["code"]) else np.zeros(len(at), bool)
    return deal(e["home"][known], "bucket", code=e["code"][known], n=c["n"][at[known]])


def score_documents(docs: DataFrame, training=None, rounds: int = ROUNDS, depth: int | None = None, rows: int | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score for every row.

    ``training`` is a Column that says which rows to learn from (all if None; a
    null counts as no).  A null or empty text is the end token alone; repeated
    rows count as often as they occur and score alike; null ids pass through;
    extra columns are ignored; an empty table gives no rows, and without
    training rows every count is zero.
    """
    spark = docs.sparkSession
    n = buckets(spark, text_bytes(docs, text_column), BUCKET_BYTES)
    plain = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"), F.coalesce(F.lit(True) if training is None else training, F.lit(False)).alias("train"))
    learned = plain.filter("train").select("text")
    counts = count_words(learned, n)
    trainers = -(-text_bytes(learned) // TRAINER_BYTES) or 1
    model = train(learned.coalesce(trainers), start_model(counts, depth, rows), rounds, tasks=trainers)
    shared = spark.sparkContext.broadcast(model)
    kind = docs.schema[id_column].dataType.simpleString()
    texts = dealt(plain.select("doc_id", "text"), n, "doc_id", "text", ())
    asked = texts.groupBy("_ps_home").applyInArrow(ask_counts(n), "bucket int, code binary, home int")
    answers = asked.groupBy("bucket").cogroup(counts.groupBy("bucket")).applyInArrow(answer_counts, "bucket int, code binary, n binary")

    def finish(_: tuple, rows: pa.Table, replies: pa.Table) -> pa.Table:
        m = shared.value
        base = float(np.log10(m.total + m.distinct + 1))
        e = opened(replies, "bucket", code="u8", n="i8")
        order = np.argsort(e["code"])
        code, count = e["code"][order], e["n"][order]
        size, known, plain_sum, score = ([np.zeros(0, d)] for d in (np.int64, np.int64, np.float64, np.float64))
        for t in B.texts(rows["text"]):
            mine, offsets = tokens(t)
            c = np.zeros(len(mine), np.int64)
            if len(code):
                at = np.searchsorted(code, mine)
                at[at == len(code)] = 0
                c = np.where(code[at] == mine, count[at], 0)
            logs = np.log10(c + 1.0)
            size.append(np.diff(offsets))
            known.append(np.add.reduceat((c > 0).astype(np.int64), offsets[:-1]))
            plain_sum.append(np.add.reduceat(logs - base, offsets[:-1]))
            score.append(np.add.reduceat(m.score(mine, offsets) + logs - m.logs[m.leaf(mine)], offsets[:-1]))
        n_tokens = np.concatenate(size)
        columns = [rows["doc_id"], pa.array(n_tokens), pa.array(np.concatenate(known)), pa.array(np.full(len(n_tokens), m.total, np.int64)), pa.array(np.concatenate(plain_sum)), pa.array(np.concatenate(score))]
        return pa.table(columns, names=["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return meet(texts, answers, finish, f"doc_id {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op9_lm_scoring(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = score_documents(docs, fold_of("doc_id", 7) != 2)
    return out.select("doc_id", (fold_of("doc_id", 7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
