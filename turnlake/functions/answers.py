"""Tolerant readers of a model's JSON answers, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


# The patterns below are formats of answers.


def _object(text: Column) -> Column:
    return F.try_parse_json(F.trim(text))


def _is(value: Column, kind: str) -> Column:
    return F.coalesce(F.schema_of_variant(value) == kind, F.lit(False))


def boundary(text: Column) -> Column:
    """{isBoundary, prevTopicLabel, nextTopicLabel}, alone or inside other text, as (is_boundary, prev_label, next_label); else null."""
    inner = F.regexp_extract(text, r'(?s)(\{[^{}]*"isBoundary"[^{}]*\})', 1)
    read = lambda j: F.when(_is(F.try_variant_get(j, "$.isBoundary", "variant"), "BOOLEAN"), F.struct(F.try_variant_get(j, "$.isBoundary", "boolean").alias("is_boundary"), F.coalesce(F.try_variant_get(j, "$.prevTopicLabel", "string"), F.lit("Previous topic")).alias("prev_label"), F.coalesce(F.try_variant_get(j, "$.nextTopicLabel", "string"), F.lit("New topic")).alias("next_label")))
    return F.coalesce(read(_object(text)), read(_object(inner)))


def turn_class(text: Column) -> Column:
    """{subtopic, isNewSubtopic} as (subtopic, is_new); inside other text only if the whole is no JSON; else null."""
    inner = F.regexp_extract(text, r'(\{[^}]*"subtopic"[^}]*\})', 1)
    j = F.coalesce(_object(text), _object(inner))
    fits = _is(F.try_variant_get(j, "$.isNewSubtopic", "variant"), "BOOLEAN") & (F.coalesce(F.try_variant_get(j, "$.subtopic", "string"), F.lit("")) != "")
    return F.when(fits, F.struct(F.try_variant_get(j, "$.subtopic", "string").alias("subtopic"), F.try_variant_get(j, "$.isNewSubtopic", "boolean").alias("is_new")))


def groups(text: Column, n_turns: Column) -> Column:
    """[{label, turns}] in a code block or inside other text, if it covers 80 % of n_turns turns; else null."""
    block = F.regexp_extract(text, r"(?s)```(?:json)?\s*\n?(.*?)```", 1)
    array = F.regexp_extract(F.when(block != "", block).otherwise(text), r"(?s)(\[.*\])", 1)
    found = F.try_variant_get(F.try_parse_json(array), "$", "array<struct<label:string,turns:array<int>>>")
    sound = ~F.exists(found, lambda g: g["label"].isNull() | (g["label"] == "") | g["turns"].isNull())
    covered = F.size(F.array_distinct(F.flatten(F.transform(found, lambda g: g["turns"]))))
    sorted_ = F.transform(found, lambda g: F.struct(g["label"].alias("label"), F.sort_array(g["turns"]).alias("turns")))
    return F.when((F.size(found) > 0) & sound & (covered / n_turns >= 0.8), sorted_)
