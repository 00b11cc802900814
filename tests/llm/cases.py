"""A corpus with every odd case, and words as the contracts define them."""

import random
import re


SCHEMA = "doc_id long, text string, lang string, source string, n_words int, kept string, key long, bucket int, removed string, n_lines int, grade int, _hits string, component_id long"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def words(text, lower=False):
    return WORDS.findall((text or "").translate(LOWER) if lower else text or "")


def corpus(seed=1, n=60):
    """Random texts with copies, shared passages and lines, nulls, empty and long texts, repeated rows, ties."""
    rnd = random.Random(seed)
    vocabulary = [f"w{i}é" if i % 9 == 0 else f"W{i}" for i in range(400)]
    line = lambda k: " ".join(rnd.choice(vocabulary) for _ in range(k))
    passages, lines = [line(40) for _ in range(4)], ["Common line", "\tcommon LINE  ", line(6), line(3)]
    out = []
    for i in range(n):
        kind = rnd.random()
        if kind < 0.15 and out:
            text = rnd.choice(out)[1]
        elif kind < 0.35 and out:
            w = (rnd.choice(out)[1] or "").split(" ")
            for _ in range(max(1, len(w) // 60)):
                w[rnd.randrange(len(w))] = rnd.choice(vocabulary)
            text = " ".join(w)
        else:
            text = "\n".join(rnd.choice([line(rnd.randrange(1, 80)), rnd.choice(passages), rnd.choice(lines)]) for _ in range(rnd.randrange(1, 6)))
        out.append((i, text))
    out += [(n, None), (n + 1, ""), (n + 2, " \t\n \x0b\x0c\r "), (n + 3, "one"), (n + 4, "日本語 " * 30), (n + 5, "aaaa" * 300), (n + 6, line(30_000)), (n + 7, "x\n\n\nx\n"), (n + 8, "A b"), (n + 9, "a B")]
    out += [out[3], out[5], (None, out[5][1]), (None, None), (None, "lonely text of a few words")]
    return out


def frame(spark, rows):
    full = [(i, t, "en", "s", 7, "x", 8, 9, "y", 1, 2, "z", 3) for i, t in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(3)
