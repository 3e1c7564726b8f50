"""Prompt rendering, evidence layout and response checking as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpuslens import fixed_values as fv
from corpuslens.functions.text import strip, truthy


def check_prompt(key: str) -> str:
    if key not in fv.PROMPT_PREFIXES:
        raise ValueError(f"unknown prompt {key!r}; choose one of: {', '.join(fv.PROMPTS)}")
    return key


def render_prompt(prompt: Column, question: Column) -> Column:
    """Prompt text for a prompt key; NULL for a blank question."""
    prefix = F.lit(None).cast("string")
    for key in fv.PROMPTS:
        prefix = F.when(prompt == key, fv.PROMPT_PREFIXES[key]).otherwise(prefix)
    asked = strip(question)
    return F.when(asked != "", F.concat(prefix, asked))


def passage(rank: Column, title: Column, entity: Column, topic: Column, path: Column, text: Column) -> Column:
    return F.concat_ws(
        "\n",
        F.concat(F.lit("[Evidence "), rank.cast("string"), F.lit("]")),
        F.concat(F.lit("Title: "), title),
        F.concat(
            F.lit("Cancer/topic: "), F.coalesce(truthy(entity), F.lit(fv.DEFAULT_ENTITY)), F.lit(" / "), topic
        ),
        F.concat(F.lit("Section: "), F.array_join(path, " > ")),
        F.concat(F.lit("Passage: "), F.substring(text, 1, fv.EVIDENCE_CHARS)),
    )


def user_message(prompt_text: Column, evidence: Column) -> Column:
    """Message sent to the model; the evidence block only where there is one."""
    bare = F.concat(F.lit(fv.TASK_TEXT + "\n\n"), prompt_text)
    full = F.concat(
        F.lit(fv.TASK_TEXT + fv.EVIDENCE_RULE + "\n\n"),
        prompt_text,
        F.lit(f"\n\n{fv.EVIDENCE_HEADING}\n"),
        evidence,
    )
    return F.when(evidence.isNull(), bare).otherwise(full)


def parse_boolean(text: Column) -> Column:
    """'true'/'false' in any case with blanks around; anything else is NULL."""
    word = F.lower(strip(text))
    return F.when(word == "true", True).when(word == "false", False)


def parse_response(text: Column) -> Column:
    """Boolean of a strict ``{"value": <bool>}`` object, else NULL."""
    parsed = F.try_parse_json(text)
    shape = F.schema_of_variant(parsed)
    return F.when(shape == "OBJECT<value: BOOLEAN>", F.try_variant_get(parsed, "$.value", "boolean"))
