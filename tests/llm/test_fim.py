"""Fill-in-middle against plain Python, the exception index, and odd inputs."""

import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest
from helpers import row_set

from panelspark.llm import bytetext as B
from panelspark.llm import fim


def plain(i, text, unit="line", rate=100, spm=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text) if unit == "line" else list(text)
    h = hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return i, len(units), "plain", None, None, text
    if h4 % 100 < spm:
        return i, len(units), "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return i, len(units), "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


ODD = ["é\n\nß日本\n語🙂 x", "\n", "\n\n\n", "a<P>b\nc", "<S>", "x<M", "<\nP>\n<", "a\r\nb c\n", "<P\n>S>\n<S\n>", "日\n" * 500, "🙂", "no feed at the end\nas here", "x" * 400_000, "é\n" * 200_000]


@pytest.fixture(scope="module")
def odd(spark, rows):
    from cases import frame

    more = [(1000 + 7 * k + i, t) for k, t in enumerate(ODD) for i in range(7)]
    return rows + more, frame(spark, rows + more)


@pytest.mark.parametrize(("unit", "rate", "spm"), [("line", 100, 50), ("char", 100, 50), ("char", 40, 0), ("line", 0, 50), ("line", 70, 100)])
def test_fill_in_middle_equals_plain_python(odd, unit, rate, spm):
    rows, docs = odd
    made = fim.restore(fim.fill_in_middle(docs, unit=unit, rate=rate, spm_rate=spm)).collect()
    got = sorted((tuple(r)[:6] for r in made), key=repr)
    assert got == sorted((plain(i, t, unit, rate, spm) for i, t in rows), key=repr)
    by_id = {}
    for i, t in rows:
        by_id.setdefault(i, set()).add(t or "")
    assert all(r["restored"] in by_id[r["doc_id"]] for r in made)


def test_every_form_occurs(odd):
    _, docs = odd
    assert {r["form"] for r in fim.fill_in_middle(docs).select("form").distinct().collect()} == {"plain", "psm", "spm"}


def test_empty_table(nothing):
    assert fim.restore(fim.fill_in_middle(nothing)).count() == 0


def test_other_names_of_columns(spark):
    docs = spark.createDataFrame([("k", "a\nb", "ours", 3)], "name string, body string, form string, n int")
    (row,) = fim.fill_in_middle(docs, id_column="name", text_column="body").collect()
    assert tuple(row) == plain("k", "a\nb")


def test_an_unknown_unit_is_refused(docs):
    with pytest.raises(ValueError, match="unit must be"):
        fim.fill_in_middle(docs, unit="page")


def test_exception_index_both_ways():
    text = "aé日🙂b" * 50 + "ascii only " * 20 + "ß"
    (t,) = B.texts(pa.array([text]))
    index = fim.ExceptionIndex(t.data)
    at = np.array([len(text[:k].encode()) for k in range(len(text) + 1)])
    assert (index.chars(at) == np.arange(len(text) + 1)).all()
    assert (index.bytes(np.arange(len(text) + 1)) == at).all()
    assert len(index.byte) == 151  # one record per multibyte character, none for ASCII


def test_query_equals_its_sql(spark, sf, duck):
    assert row_set(fim.op13_fill_in_middle(spark, sf).toPandas()) == row_set(duck.execute(fim.ORACLE).df())
