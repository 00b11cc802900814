"""Reading raw answers: codes, texts, reasons, refusals; and the two number spaces of codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: phrases that count as a refusal
REFUSALS = (
    r"回答でき(ない|ません)", r"お答え(できません|しかねます|いたしかねます)", r"わかりません", r"答えられません",
    r"AI(として|なので)", r"差し控え", r"特定の個人", r"判断できません",
)
WIDE_DIGITS = "０１２３４５６７８９"
QUALITY_FLAGS = ("parse_error", "out_of_range", "refusal", "straightline", "output_limit")
ALL_FLAGS = ("parse_error", "out_of_range", "retried", "refusal", "straightline", "output_limit")

_JSON = "answer string, answers array<string>, reasoning string"
#: Stands for whole numbers beyond any list of options.
BEYOND = 2_000_000_000


def narrow_digits(text: Column) -> Column:
    return F.translate(text, WIDE_DIGITS, "0123456789")


def as_json(text: Column) -> Column:
    """answer, answers and reasoning of the object that starts at the first brace; null if there is none."""
    return F.when(F.contains(text, F.lit("{")), F.from_json(F.regexp_extract(text, r"(?s)\{.*", 0), _JSON, {"allowSingleQuotes": "false"}))


def once(value: Column, f) -> Column:
    """f(value) with value computed a single time, however often f names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def whole(text: Column) -> Column:
    """A number as a whole one (2.9 is 2, true is 1), null if it is none; capped, so that it stays out of range."""
    capped = lambda n: F.when(F.abs(n) > BEYOND, F.lit(BEYOND)).otherwise(n.cast("long")).cast("int")
    number = lambda x: F.when(x == "true", F.lit("1")).when(x == "false", F.lit("0")).otherwise(F.trim(x)).try_cast("decimal(38,4)")
    return once(once(text, number), capped)


def capped_run(digits: Column) -> Column:
    return F.when(F.length(digits) > 9, F.lit(BEYOND)).otherwise(digits.try_cast("int"))


def digit_runs(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"(\d+)"), F.lit(1))


def integers_of(strings: Column) -> Column:
    """Digit runs as longs; runs beyond range count as the largest."""
    return F.transform(strings, lambda x: F.coalesce(x.try_cast("long"), F.lit(2**63 - 1)))


def single_code(raw: Column, scan: bool | Column = True) -> Column:
    """The JSON answer as a whole number, else the first run of digits of the whole text."""
    text = narrow_digits(raw)
    scanned = once(F.regexp_extract(text, r"\d+", 0), capped_run)
    return F.coalesce(whole(as_json(text)["answer"]), scanned if scan is True else F.when(scan, scanned))


def multi_codes(raw: Column, scan: bool | Column = True) -> Column:
    """The JSON answers as sorted distinct whole numbers, else all runs of digits."""
    text = narrow_digits(raw)
    listed = F.filter(F.transform(F.coalesce(as_json(text)["answers"], F.array().cast("array<string>")), whole), lambda x: x.isNotNull())
    runs = F.transform(digit_runs(text), capped_run)
    none = F.array().cast("array<int>")
    return F.array_sort(F.array_distinct(F.when(F.size(listed) > 0, listed).when(F.lit(scan) if isinstance(scan, bool) else scan, runs).otherwise(none)))


def numeric_text(raw: Column) -> Column:
    return F.nullif(F.regexp_extract(narrow_digits(raw), r"-?\d[\d,]*(\.\d+)?", 0), F.lit(""))


def reasoning(raw: Column) -> Column:
    return F.nullif(F.trim(as_json(raw)["reasoning"]), F.lit(""))


def is_refusal(raw: Column, reason: Column | None = None, patterns: tuple[str, ...] = REFUSALS) -> Column:
    """Whether a refusal phrase occurs outside the reason, which is cut out in its plain and JSON-escaped form."""
    if reason is not None:
        quoted = F.to_json(F.struct(reason.alias("r")))
        escaped = F.substring(quoted, F.lit(7), F.length(quoted) - 8)  # between {"r":" and "}
        raw = F.when(reason.isNull(), raw).otherwise(F.replace(F.replace(raw, reason, F.lit("")), escaped, F.lit("")))
    return raw.rlike("|".join(patterns))


def defined_codes(codes: Column, order: Column) -> Column:
    """Presented codes as definition codes; a code outside the order stays, null arrays are empty."""
    none = F.array().cast("array<int>")
    order = F.coalesce(order, none)
    return F.transform(F.coalesce(codes, none), lambda c: F.when((c >= 1) & (c <= F.size(order)), F.get(order, c - 1)).otherwise(c))


def presented_order(seed: int, uuid: Column, question: Column, n_options: Column, shuffled: Column) -> Column:
    """Definition numbers in presented order: as defined, or shuffled by a hash of (seed, person, question, option)."""
    plain = F.sequence(F.lit(1), n_options.cast("int"))
    keyed = F.transform(plain, lambda i: F.struct(F.sha2(F.concat_ws("|", F.lit(str(seed)), uuid, question, i.cast("string")), 256).alias("h"), i.alias("i")))
    none = F.array().cast("array<int>")
    return F.when(n_options <= 0, none).when(shuffled, F.transform(F.array_sort(keyed), lambda x: x["i"])).otherwise(plain)


def has_quality_flag(flags: Column) -> Column:
    return F.arrays_overlap(F.coalesce(flags, F.array().cast("array<string>")), F.array(*map(F.lit, QUALITY_FLAGS)))
