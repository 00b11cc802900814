"""The deterministic stratified draw, and panels built from it.

Ranks come from a hash of (person, seed, cell), so a draw doesn't depend on how
the persons are partitioned, and a larger draw extends a smaller one.  A histogram
of rank keys comes first: it tells which keys the quotas can reach, so that no
more persons than these are shuffled, whatever the population.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.operators.quotas import IN_LISTS, cell_condition
from panelspark.sources.tables import cut

#: Hex digits of the rank key that make a bucket of a cell's histogram.
BUCKET_DIGITS = 3


def rank_key(uuid: Column, seed: int, cell_id: Column) -> Column:
    return F.sha2(F.concat_ws("|", uuid, F.lit(str(seed)), cell_id), 256)


def dense_number(df: DataFrame, keys: list[str], bucket: Column, order: list, out: str, limit: Column | None = None) -> DataFrame:
    """Numbers rows from 1 within keys, where bucket rises with the order: each window is one bucket, not one key.

    With a limit, buckets that start beyond it are dropped before anything is sorted.
    """
    df = df.withColumn("_bucket", bucket)
    counts = df.groupBy(*keys, "_bucket").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select(*keys, "_bucket", F.coalesce(before, F.lit(0)).alias("_before"))
    near = df.join(offsets, [*keys, "_bucket"])
    if limit is not None:
        near = near.filter(F.col("_before") < limit)
    number = F.col("_before") + F.row_number().over(Window.partitionBy(*keys, "_bucket").orderBy(*order))
    near = near.withColumn(out, number.cast("long"))
    return (near.filter(F.col(out) <= limit) if limit is not None else near).drop("_bucket", "_before")


def matches(persons: DataFrame, cells: list[dict], seed: int, everyone: dict | None = None) -> DataFrame:
    """uuid and choices: the cells that a person matches, in their order, each with its rank key."""
    spec = lambda i, c: F.when(F.coalesce(cell_condition(c), F.lit(False)), F.struct(F.lit(i).alias("cell_ord"), rank_key(F.col("uuid"), seed, F.lit(c["cell_id"])).alias("key")))
    hit = F.filter(F.array(*(spec(i, c) for i, c in enumerate(cells))), lambda x: x.isNotNull())
    some = reduce(Column.__or__, (cell_condition(c) for c in cells), F.lit(False))
    return persons.filter(cell_condition(everyone or {}) & some).select("uuid", hit.alias("choices"))


def histogram(found: DataFrame, cells: list[dict], reach: list[int]) -> list[list[tuple[str, int]]]:
    """For each cell the buckets of rank keys that its reach touches, rising, and the persons before each.

    The persons are counted by bucket in one pass; what comes to the driver is a
    number per bucket, of which a cell has at most 16 ** BUCKET_DIGITS.
    """
    bucket = F.substring("choice.key", 1, BUCKET_DIGITS)
    counts = found.select(F.explode("choices").alias("choice")).groupBy(F.col("choice.cell_ord").alias("cell_ord"), bucket.alias("bucket")).agg(F.count("*").alias("n"))
    out: list[list[tuple[str, int]]] = [[] for _ in cells]
    before = [0] * len(cells)
    for r in sorted(counts.collect()):
        i = r["cell_ord"]
        if before[i] < reach[i]:
            out[i].append((r["bucket"], before[i]))
        before[i] += r["n"]
    return out


def within(found: DataFrame, touched: list[list[tuple[str, int]]]) -> DataFrame:
    """The choices of the buckets touched alone, which follow each other, before anything is shuffled."""
    first, last = (F.array(*(F.lit(b[end][0] if b else "") for b in touched)) for end in (0, -1))
    bucket = lambda x: F.substring(x["key"], 1, BUCKET_DIGITS)
    near = F.filter("choices", lambda x: (bucket(x) >= F.get(first, x["cell_ord"])) & (bucket(x) <= F.get(last, x["cell_ord"])))
    return found.select("uuid", near.alias("choices")).filter(F.size("choices") > 0)


def ranked_candidates(persons: DataFrame, cells: list[dict], seed: int, everyone: dict | None = None, beyond: list[int] | None = None) -> DataFrame:
    """uuid, cell_id, cell_ord, rank_key, rank: of each cell its first n persons, as if no other cell took any, but for the first ``beyond``.

    A histogram of rank keys says which of them can be among the first n; only
    these, and one bucket a cell, are shuffled, once.
    """
    found = matches(persons, cells, seed, everyone)
    touched = histogram(found, cells, [int(c["n"]) for c in cells])
    beyond = beyond or [0] * len(cells)
    for i, b in enumerate(beyond):  # a bucket is used up if the next one starts at or before the first rank wanted
        touched[i] = [x for x, after in zip(touched[i], [*touched[i][1:], None], strict=True) if after is None or after[1] > b]
    rows = [(i, c["cell_id"], beyond[i], int(c["n"]), bucket, before) for i, c in enumerate(cells) for bucket, before in touched[i]]
    offsets = persons.sparkSession.createDataFrame(rows, "cell_ord int, cell_id string, beyond long, n long, bucket string, before long")
    near = within(found, touched).select("uuid", F.explode("choices").alias("choice")).select("uuid", "choice.cell_ord", F.col("choice.key").alias("rank_key"), F.substring("choice.key", 1, BUCKET_DIGITS).alias("bucket"))
    placed = near.join(F.broadcast(offsets), ["cell_ord", "bucket"])  # at most 16 ** BUCKET_DIGITS rows a cell
    inside = F.row_number().over(Window.partitionBy("cell_ord", "bucket").orderBy("rank_key", "uuid"))
    return placed.withColumn("rank", (F.col("before") + inside).cast("long")).filter("rank > beyond and rank <= n").select("uuid", "cell_id", "cell_ord", "rank_key", "rank")


def apart(one: dict, two: dict) -> bool:
    """Whether no person can match both cells, by their definitions."""
    if one.get("sex") is not None and two.get("sex") is not None and one["sex"] != two["sex"]:
        return True
    low = max(c["age_min"] if c.get("age_min") is not None else -1 for c in (one, two))
    high = min(c["age_max"] if c.get("age_max") is not None else 1 << 30 for c in (one, two))
    return low > high or any(one.get(c) and two.get(c) and not set(one[c]) & set(two[c]) for c in IN_LISTS)


def all_apart(cells: list[dict]) -> bool:
    return all(apart(a, b) for a, b in combinations(cells, 2))


def still_free(choices: DataFrame, cutoffs: list[tuple[str, str] | None]) -> DataFrame:
    """uuid, cell_ord, key of the choices whose person no earlier cell takes, where a cell takes all it can up to its cutoff (None: all)."""
    line = F.array(*(F.struct(F.lit(c[0] if c else "~").alias("key"), F.lit(c[1] if c else "").alias("uuid")) for c in cutoffs))  # ~ comes after any hexadecimal digit
    takes = lambda y: F.struct(y["key"].alias("key"), F.col("uuid").alias("uuid")) <= F.get(line, y["cell_ord"])
    free = F.filter("choices", lambda x: ~F.exists("choices", lambda y: (y["cell_ord"] < x["cell_ord"]) & takes(y)))
    return choices.select("uuid", F.explode(free).alias("x")).select("uuid", "x.cell_ord", "x.key")


def settled_cutoffs(choices: DataFrame, cells: list[dict], guess: list[tuple[str, str] | None]) -> list[tuple[str, str] | None]:
    """The last (rank key, uuid) that each cell takes when cells take persons in turn (None: it takes all that are left).

    All cells move at once: each cutoff is that of the n-th person whom the last
    round's cutoffs of earlier cells leave.  From any guess, the first round
    settles the first cell and each round one more at least; cells seldom draw
    the same person, so the rounds follow the chains of such meetings, not the
    cells.
    """
    wanted = F.array(*(F.lit(int(c["n"])) for c in cells))
    place = F.row_number().over(Window.partitionBy("cell_ord").orderBy("key", "uuid"))

    def after(cutoffs: list) -> list:
        nth = still_free(choices, cutoffs).withColumn("at", place).filter(F.col("at") == F.get(wanted, F.col("cell_ord"))).select("cell_ord", "key", "uuid")
        found = {r["cell_ord"]: (r["key"], r["uuid"]) for r in nth.collect()}  # one row a cell at most
        return [found.get(i) if int(c["n"]) > 0 else ("", "") for i, c in enumerate(cells)]

    cutoffs = after(guess)
    while (moved := after(cutoffs)) != cutoffs:
        cutoffs = moved
    return cutoffs


def draw(persons: DataFrame, cells: list[dict], seed: int, everyone: dict | None = None) -> DataFrame:
    """uuid, cell_id, cell_rank (from 0): cells in order, each its first n by rank, persons taken earlier excluded.

    Cells that no person can share, by their definitions, need one window.
    Otherwise earlier cells can take at most the sum of their n from a later one,
    so its picks are among its first n + that sum: a table of that size, one row
    a person, is written without a shuffle, and rounds over it settle all cells.
    """
    if all_apart(cells):
        pool = ranked_candidates(persons, cells, seed, everyone)
        return pool.select("uuid", "cell_id", (F.col("rank") - 1).cast("int").alias("cell_rank"))
    found = matches(persons, cells, seed, everyone)
    reach = [sum(int(c["n"]) for c in cells[: i + 1]) for i in range(len(cells))]
    touched = histogram(found, cells, reach)
    choices = cut(within(found, touched))
    # the middle of the bucket of each cell's own n-th person
    guess = [(max((bucket for bucket, before in touched[i] if before < int(c["n"])), default="") + "8", "") for i, c in enumerate(cells)]
    free = still_free(choices, settled_cutoffs(choices, cells, guess))
    ids, wanted = F.array(*(F.lit(c["cell_id"]) for c in cells)), F.array(*(F.lit(int(c["n"])) for c in cells))
    place = F.row_number().over(Window.partitionBy("cell_ord").orderBy("key", "uuid")) - 1
    picked = free.withColumn("cell_rank", place.cast("int")).filter(F.col("cell_rank") < F.get(wanted, F.col("cell_ord")))
    return picked.select("uuid", F.get(ids, F.col("cell_ord")).alias("cell_id"), "cell_rank")


def draw_beyond(persons: DataFrame, cells: list[dict], seed: int, old: int, new: int, everyone: dict | None = None) -> DataFrame:
    """What the draw of ``new`` times each cell's n has beyond that of ``old`` times: uuid, cell_id, cell_rank.

    Of cells that no person can share these are the ranks between the two
    quotas, and the histogram of rank keys keeps all others from being sorted or
    shuffled: those beyond the new quota, and those of buckets that the old one
    used up.  Where cells can share persons a larger first cell may take persons
    whom a later one had, so such a draw can't be extended (an error, unless
    ``old`` is 0) and has to be drawn anew.
    """
    times = lambda k: [c | {"n": int(c["n"]) * k} for c in cells]
    if not all_apart(cells) and old:
        raise ValueError("these cells can share persons, so a larger draw doesn't extend a smaller one")
    if all_apart(cells):
        pool = ranked_candidates(persons, times(new), seed, everyone, [int(c["n"]) * old for c in cells])
        return pool.select("uuid", "cell_id", (F.col("rank") - 1).cast("int").alias("cell_rank"))
    return draw(persons, times(new), seed, everyone)


def require_full(report: DataFrame) -> DataFrame:
    """The report of a draw, but an error that names its short cells if there are any."""
    short = report.filter("shortfall > 0").orderBy("cell_id").limit(20).collect()
    if short:
        raise ValueError("too few candidates: " + ", ".join(f"{r['cell_id']} {r['achieved']} of {r['requested']} (short by {r['shortfall']})" for r in short))
    return report


def draw_report(drawn: DataFrame, counts: DataFrame, cells: list[dict]) -> DataFrame:
    """cell_id, requested, achieved, candidates, shortfall of every cell, in definition order."""
    got = drawn.groupBy("cell_id").agg(F.count("*").alias("achieved"))
    wanted = F.create_map(*(F.lit(x) for c in cells for x in (c["cell_id"], int(c["n"]))))
    df = counts.select("cell_id", "candidates").join(got, "cell_id", "left").withColumn("achieved", F.coalesce("achieved", F.lit(0))).withColumn("requested", wanted[F.col("cell_id")].cast("long"))
    return df.select("cell_id", "requested", "achieved", "candidates", F.greatest(F.col("requested") - F.col("achieved"), F.lit(0)).cast("long").alias("shortfall"))


def composition_report(report: DataFrame) -> DataFrame:
    """Before a run: requested, achieved, candidates and weight of each cell, and a last row with the totals of the first two.

    report: as draw_report.  A weight is the share asked for over the share
    achieved, 0 for an empty cell.  The total row's cell_id is null.
    """
    both = report.rollup("cell_id").agg(F.sum("requested").alias("requested"), F.sum("achieved").alias("achieved"), F.max("candidates").alias("candidates"), F.grouping("cell_id").alias("_total"))
    whole = Window.partitionBy(F.lit(0))  # a definition's cells
    total = lambda c: F.max(F.when(F.col("_total") == 1, F.col(c))).over(whole)
    share = (F.col("requested") / total("requested")) / (F.nullif("achieved", F.lit(0)) / total("achieved"))
    cell = F.col("_total") == 0
    return both.select("cell_id", "requested", "achieved", F.when(cell, F.col("candidates")).alias("candidates"), F.when(cell, F.coalesce(share, F.lit(0.0))).alias("weight"))


def build_panel(drawn: DataFrame, cells: DataFrame, survey_id: str, stimuli: list[str], screening: bool) -> DataFrame:
    """Panel rows: role, concepts in definition order (none for candidates), weight by cell.

    cells: survey_id, cell_id, n, size, proportion of this survey.
    """
    from panelspark.operators.quotas import cell_weights

    achieved = drawn.groupBy("cell_id").agg(F.count("*").alias("achieved")).withColumn("survey_id", F.lit(survey_id))
    weights = cell_weights(cells, achieved).select("cell_id", "weight")
    concepts = F.array(*(F.lit(s) for s in stimuli)) if stimuli and not screening else F.array().cast("array<string>")
    return drawn.join(weights, "cell_id", "left").select(F.lit(survey_id).alias("survey_id"), F.col("uuid").alias("persona_uuid"), "cell_id", F.lit("candidate" if screening else "main").alias("role"), "cell_rank", concepts.alias("assigned_stimuli"), F.coalesce("weight", F.lit(1.0)).alias("weight"))


def lookup(persons: DataFrame, wanted: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """Attributes of the wanted uuids, and the uuids that no person has."""
    keys = wanted.select("uuid").distinct()
    return persons.select("uuid", *columns).join(keys, "uuid", "left_semi"), keys.join(persons.select("uuid"), "uuid", "left_anti")
