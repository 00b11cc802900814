"""Fill-in-middle transformation with a sparse exception index.

Cuts are chosen in units (lines, or code points) and made in bytes.  The only
places where code points and bytes part ways are multibyte characters, so these
alone are recorded: where each stands and how many bytes it has beyond one.  A
binary search over them converts cuts either way, and between two of them, as in
plain ASCII, conversion is one addition.

Texts pass through Arrow maps in pieces of bounded size, nothing is shuffled, and
each row depends on its own id and text alone.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelspark.llm import bytetext as B
from panelspark.llm.common import table

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
MARKS = (PREFIX, SUFFIX, MIDDLE)
SEED, RATE, SPM_RATE = 7, 100, 50


class ExceptionIndex:
    """Places and excess bytes of the multibyte characters of a buffer of UTF-8."""

    def __init__(self, data: np.ndarray):
        self.byte = np.flatnonzero(data >= 0xC0)  # their first bytes
        lead = data[self.byte]
        excess = 1 + (lead >= 0xE0).astype(np.int64) + (lead >= 0xF0)
        self.total = np.concatenate([[0], np.cumsum(excess)])
        self.char = self.byte - self.total[:-1]

    def chars(self, byte: np.ndarray) -> np.ndarray:
        """Code points before each of these byte places, which begin a character."""
        return byte - self.total[np.searchsorted(self.byte, byte)]

    def bytes(self, char: np.ndarray) -> np.ndarray:
        """Bytes before each of these code points."""
        return char + self.total[np.searchsorted(self.char, char)]


def draws(ids: list, seed: int) -> np.ndarray:
    """Four 32-bit draws per id, from the sha256 of seed and id; a null id counts as an empty one."""
    said = (hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).digest()[:16] for i in ids)
    return np.array([struct.unpack(">4I", x) for x in said], np.int64).reshape(-1, 4)


def line_ends(t: B.Texts) -> tuple[np.ndarray, np.ndarray]:
    """Where the lines of all texts end (a feed belongs to its line), and how many lines each text has."""
    feeds = np.flatnonzero(t.data == 0x0A) + 1
    ends = np.unique(np.concatenate([feeds, t.offsets[1:][np.diff(t.offsets) > 0]]))
    return ends, np.diff(np.searchsorted(ends, t.offsets, "right"))


def cuts(t: B.Texts, index: ExceptionIndex, h: np.ndarray, unit: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Units of each text, and the bytes at which its prefix and its middle end."""
    begin = t.offsets[:-1]
    if unit == "line":
        ends, n = line_ends(t)
        first = np.searchsorted(ends, begin, "right")
        at = lambda k: np.where(k > 0, np.append(ends, 0)[first + k - 1], begin)
    else:
        start = index.chars(t.offsets)
        n = np.diff(start)
        at = lambda k: index.bytes(start[:-1] + k)
    one, two = h[:, 0] % (n + 1), h[:, 1] % (n + 1)
    return n, at(np.minimum(one, two)), at(np.maximum(one, two))


def fill_in_middle(docs: DataFrame, seed: int = SEED, unit: str = "line", rate: int = RATE, spm_rate: int = SPM_RATE, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n (units), form, prefix_chars, middle_chars, output, in any order of rows.

    Of all texts ``rate`` in a hundred are transformed, ``spm_rate`` in a hundred
    of these with the suffix first.  A null text is an empty one; an empty text
    and one that holds a mark stay as they are (form plain, null lengths).  Rows
    that repeat each other get the same output, a null id counts as an empty one,
    other columns are not looked at, and an empty table gives no rows.  A very
    long text is handled alone.
    """
    if unit not in ("line", "char"):
        raise ValueError(f"unit must be line or char, not {unit!r}")
    kind = docs.select(F.col(id_column).alias("doc_id")).schema["doc_id"]
    schema = T.StructType([kind, *(T.StructField(c, d) for c, d in (("n", T.LongType()), ("form", T.StringType()), ("prefix_chars", T.LongType()), ("middle_chars", T.LongType()), ("output", T.StringType())))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch["doc_id"]
            for t in B.texts(batch["text"]):
                own = ids.slice(t.first, len(t))
                h, index = draws(own.to_pylist(), seed), ExceptionIndex(t.data)
                n, one, two = cuts(t, index, h, unit)
                data, form, output = t.data.tobytes(), [], []
                for a, p, m, b, drawn, order in zip(t.offsets[:-1].tolist(), one.tolist(), two.tolist(), t.offsets[1:].tolist(), (h[:, 2] % 100).tolist(), (h[:, 3] % 100).tolist(), strict=True):
                    text = data[a:b]
                    if not text or drawn >= rate or any(x in text for x in MARKS):
                        form.append("plain")
                        output.append(text)
                    elif order < spm_rate:
                        form.append("spm")
                        output.append(b"".join((SUFFIX, data[m:b], PREFIX, data[a:p], MIDDLE, data[p:m])))
                    else:
                        form.append("psm")
                        output.append(b"".join((PREFIX, data[a:p], SUFFIX, data[m:b], MIDDLE, data[p:m])))
                plain = np.array([f == "plain" for f in form], bool)
                begin, one, two = index.chars(t.offsets[:-1]), index.chars(one), index.chars(two)
                columns = [own, pa.array(n), pa.array(form, pa.string()), pa.array(one - begin, mask=plain), pa.array(two - one, mask=plain), pa.array(output, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("string").alias("text")).mapInArrow(run, schema)


def rebuild(output: bytes, form: str) -> bytes:
    """The text before its transformation.  Texts that hold a mark are plain, so the first of each mark is the one put in."""
    if form == "plain":
        return output
    head, middle = output.split(MIDDLE, 1)
    if form == "spm":
        suffix, prefix = head[len(SUFFIX) :].split(PREFIX, 1)
    else:
        prefix, suffix = head[len(PREFIX) :].split(SUFFIX, 1)
    return prefix + middle + suffix


def restore(made: DataFrame) -> DataFrame:
    """The rows of fill_in_middle with the text rebuilt from output and form alone, as the column restored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [rebuild(o.encode(), f) for o, f in zip(batch["output"].to_pylist(), batch["form"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.binary()).cast(pa.string())], names=[*batch.schema.names, "restored"])

    return made.mapInArrow(run, T.StructType([*made.schema.fields, T.StructField("restored", T.StringType())]))


def op13_fill_in_middle(spark, sf_dir: str) -> DataFrame:
    made = restore(fill_in_middle(table(spark, sf_dir, "documents")))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


ORACLE = r"""
with d as (select doc_id, coalesce(text, '') as t, sha256('7:' || cast(doc_id as varchar)) as h from documents),
u as (select *, regexp_extract_all(t, '[^\n]*\n|[^\n]+') as l,
        cast('0x' || substr(h, 1, 8) as bigint) as h1, cast('0x' || substr(h, 9, 8) as bigint) as h2,
        cast('0x' || substr(h, 17, 8) as bigint) as h3, cast('0x' || substr(h, 25, 8) as bigint) as h4 from d),
c as (select *, len(l) as n, least(h1 % (len(l) + 1), h2 % (len(l) + 1)) as a, greatest(h1 % (len(l) + 1), h2 % (len(l) + 1)) as b from u),
p as (select doc_id, t, n,
        case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 100 then 'plain'
             when h4 % 100 < 50 then 'spm' else 'psm' end as form,
        array_to_string(l[1:a], '') as pre, array_to_string(l[a + 1:b], '') as mid, array_to_string(l[b + 1:], '') as suf from c)
select doc_id, n, form,
       case when form <> 'plain' then length(pre) end as prefix_chars, case when form <> 'plain' then length(mid) end as middle_chars,
       sha256(case form when 'plain' then t when 'spm' then '<S>' || suf || '<P>' || pre || '<M>' || mid
                        else '<P>' || pre || '<S>' || suf || '<M>' || mid end) as output_sha256,
       sha256(t) as restored_sha256
from p
"""
