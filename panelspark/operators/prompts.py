"""Prompt datasets: cards, question blocks, and message lists with replayed answers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions.answers import once
from panelspark.sources.tables import cut

# fixed values: the text of an empty card, and the headings
EMPTY_CARD = "（情報なし）"
HEADINGS = {"profile": "■あなたのプロフィール", "stimulus": "■コンセプト", "question": "■質問"}


def filled(name: str) -> Column:
    return F.nullif(F.col(name).cast("string"), F.lit(""))


def attribute_row(attributes: Sequence[tuple[str, str]]) -> Column:
    """{value}{suffix} joined by a middle dot; null and empty values are left out."""
    return F.concat_ws("・", *(F.concat(filled(c), F.lit(suffix)) for c, suffix in attributes))


def person_card(attributes: Sequence[tuple[str, str]], summary: str | None, fields: Sequence[tuple[str, str]], premise: Column | None = None) -> Column:
    """The attribute row, a blank line, the summary, a blank line, labelled lines, the premise; empty parts take no line."""
    row = F.nullif(attribute_row(attributes), F.lit(""))
    parts = [F.concat(row, F.lit("\n"))]
    if summary:
        parts.append(F.concat(filled(summary), F.lit("\n")))
    parts += [F.concat(F.lit(f"【{label}】"), filled(c)) for c, label in fields]
    if premise is not None:
        parts.append(F.concat(F.lit("\n"), premise))
    return F.concat_ws("\n", *parts)


def judge_card(attributes: Sequence[tuple[str, str]], summary: str | None, fields: Sequence[tuple[str, str]]) -> Column:
    """One line: the parts joined by ' / '."""
    parts = [F.nullif(attribute_row(attributes), F.lit(""))] + ([filled(summary)] if summary else []) + [F.concat(F.lit(f"【{label}】"), filled(c)) for c, label in fields]
    return F.coalesce(F.nullif(F.concat_ws(" / ", *parts), F.lit("")), F.lit(EMPTY_CARD))


def judge_prompts(batches: DataFrame) -> DataFrame:
    """One numbered list of cards per batch (its size is the setting batch_size)."""
    rows = F.array_sort(F.collect_list(F.struct("position", "card")))
    text = F.array_join(F.transform(rows, lambda x: F.concat(x["position"].cast("string"), F.lit(". "), x["card"])), "\n")
    return batches.groupBy("survey_id", "batch").agg(text.alias("cards"), F.count("*").alias("members"))


def question_block(text: Column, kind: Column, options: Column, rules: dict[str, str], reason_rules: dict[str, str], with_reason: Column, max_length: Column, reason_length: Column, heading: str = HEADINGS["question"]) -> Column:
    """Heading, text, numbered options in presented order, and the rule of the type (with a reason, that rule instead).

    An open question without max_length has no rule; {max_length} in a rule is filled in.
    """
    pick = lambda table: F.create_map(*(F.lit(x) for kv in table.items() for x in kv))[kind]
    choice = kind.isin("single", "multi", "scale")
    fill = lambda rule, n: F.replace(rule, F.lit("{max_length}"), n.cast("string"))
    rule = F.when(choice & with_reason, fill(pick(reason_rules), reason_length)).when(kind == "open", F.when(max_length.isNotNull(), fill(pick(rules), max_length))).otherwise(pick(rules))
    numbered = F.nullif(F.array_join(F.transform(options, lambda o, i: F.concat((i + 1).cast("string"), F.lit(". "), o)), "\n"), F.lit(""))
    return F.concat_ws("\n", F.lit(heading), text, F.when(choice, numbered), F.concat(F.lit("\n"), rule))


def content_of(text: Column, uris: Column) -> Column:
    """A message's content as a variant: a string, or a list of the text and one part per image where there are images."""
    return content_with(text, image_parts(uris))


def content_text(content: Column) -> Column:
    """What a content says: the string itself, or the text of its first part."""
    return F.coalesce(F.try_variant_get(content, "$[0].text", "string"), F.try_variant_get(content, "$", "string"))


def with_images(text: Column, uris: Column) -> Column:
    """A message's content as JSON: the text alone, or its part followed by one part per image (a null or empty uri is none)."""
    parts = image_parts(uris)
    return F.when(parts.isNull(), json_string(text)).otherwise(listed(text, parts))


def json_string(text: Column) -> Column:
    return once(F.to_json(F.array(text)), lambda j: F.substring(j, F.lit(2), F.length(j) - 2))


def image_parts(uris: Column) -> Column:
    """The image parts of a content as JSON, joined by commas; null where there are none."""
    held = F.filter(F.coalesce(uris, F.array().cast("array<string>")), lambda u: u.isNotNull() & (u != ""))
    image = lambda u: F.concat(F.lit('{"type":"image_url","image_url":{"url":'), json_string(u), F.lit("}}"))
    return F.nullif(F.array_join(F.transform(held, image), ","), F.lit(""))


def listed(text: Column, parts: Column) -> Column:
    return F.concat(F.lit('[{"type":"text","text":'), json_string(text), F.lit("},"), parts, F.lit("]"))


def content_with(text: Column, parts: Column) -> Column:
    """As :func:`content_of`, with image parts that are made already."""
    return F.when(parts.isNull(), text.cast("variant")).otherwise(F.parse_json(listed(text, parts)))


def prompt_sample(units: DataFrame) -> DataFrame:
    """Of each survey the units of its first person, in key order."""
    first = units.groupBy("survey_id").agg(F.min("persona_uuid").alias("persona_uuid"))
    keys = ["survey_id", "persona_uuid", "ask_pos"]
    return units.join(first, ["survey_id", "persona_uuid"], "left_semi").repartitionByRange(*keys).sortWithinPartitions(*keys)


def replies_by_person(answers: DataFrame) -> DataFrame:
    """survey_id, persona_uuid, given: a person's known answers to a survey, an array of (turn, answer) of a question each.

    answers: survey_id, persona_uuid, question_id, answer.
    """
    known = answers.filter("answer is not null")
    return known.groupBy("survey_id", "persona_uuid").agg(F.collect_list(F.struct(F.col("question_id").alias("turn"), "answer")).alias("given"))


def recipes(edges: DataFrame, blocks: DataFrame) -> DataFrame:
    """survey_id, question_id, t: the turns of a question's messages in asking order, as far as they are the same for all persons.

    A turn is (pos, first, concept, block, images, system, turn, back); back turns
    are replayed, and the concept and its images stand where it first appears.
    """
    key = ["survey_id", "question_id"]
    none = F.array().cast("array<string>")
    shown = F.coalesce("images", none) if "images" in blocks.columns else none
    now = blocks.select(*key, F.col("question_id").alias("turn"), F.lit(2**30).alias("pos"), F.lit(False).alias("back"))
    back = edges.select(*key, F.col("remembered").alias("turn"), F.col("remembered_pos").alias("pos"), F.lit(True).alias("back"))
    turns = now.unionByName(back).join(blocks.select("survey_id", F.col("question_id").alias("turn"), "block", "stimulus_block", "system", "slot", shown.alias("images")), ["survey_id", "turn"])
    first = F.min("pos").over(Window.partitionBy(*key)) == F.col("pos")
    seen = F.min("pos").over(Window.partitionBy(*key, "slot")) == F.col("pos")
    turns = turns.withColumns({"first": first, "concept": F.when(seen, F.col("stimulus_block")), "images": F.when(seen, F.col("images")).otherwise(none)})
    return turns.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("pos", "first", "concept", "block", "images", "system", "turn", "back"))).alias("t"))  # as many turns as a survey has questions, at most


def message_rows(units: DataFrame, edges: DataFrame, blocks: DataFrame, answers: DataFrame | None, missing: str | None = None) -> DataFrame:
    """messages: array of (role, content variant) for each unit: system, replayed turns in asking order, then the question.

    units: survey_id, persona_uuid, question_id, stimulus_id, ask_pos, profile, and
    given (as replies_by_person) if answers is None.
    edges: as memory_edges.  blocks: survey_id, question_id, block, stimulus_block
    (of the question's slot), system, slot, and maybe images (uris that are sent
    with the concept, array of string).  answers: survey_id, persona_uuid,
    question_id, answer.  The profile stands in the first user turn only, a
    concept only where it first appears, with its images as parts after the turn's
    text, and the system text is the last question's.  A content without images
    is a plain string.
    Without ``missing``, units whose replayed answer isn't there yet are left
    out; with it, that text stands for the answer and the question is listed.

    The turns of a survey's questions are put together once, for all persons; a
    unit meets them and its person's answers, and becomes messages where it lies.
    """
    key = ["survey_id", "persona_uuid", "question_id"]
    text = lambda x, *before: F.concat_ws("\n\n", *before, x["concept"], x["block"])
    # written before the contents are made: a small table whose size Spark knows when it plans the join
    asked = cut(recipes(edges, blocks)).withColumn("t", F.transform("t", lambda x: x.withField("parts", image_parts(x["images"])).withField("content", content_of(text(x), x["images"]))))
    if answers is not None:
        units = units.join(replies_by_person(answers), ["survey_id", "persona_uuid"], "left")
    given = F.coalesce("given", F.array().cast("array<struct<turn:string,answer:string>>"))
    df = units.select(*key, "profile", given.alias("given")).join(asked, ["survey_id", "question_id"])
    gap = lambda x: x["back"] & ~F.exists("given", lambda g: g["turn"] == x["turn"])
    df = df.withColumn("missing", F.transform(F.filter("t", gap), lambda x: x["turn"]))
    if missing is None:
        df = df.filter(F.size("missing") == 0)
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    profile = F.concat(F.lit(HEADINGS["profile"] + "\n"), F.col("profile"))
    user = lambda x: message("user", F.when(x["first"], content_with(text(x, profile), x["parts"])).otherwise(x["content"]))
    pair = lambda x, answer: F.array(user(x), message("assistant", answer.cast("variant")))
    replayed = lambda x: F.flatten(F.transform(F.filter("given", lambda g: g["turn"] == x["turn"]), lambda g: pair(x, g["answer"])))
    if missing is not None:
        known = replayed
        replayed = lambda x: F.when(gap(x), pair(x, F.lit(missing))).otherwise(known(x))
    pairs = F.flatten(F.transform("t", lambda x: F.when(x["back"], replayed(x)).otherwise(F.array(user(x)))))
    system = message("system", F.element_at("t", -1)["system"].cast("variant"))
    return df.select(*key, F.concat(F.array(system), pairs).alias("messages"), "missing")
