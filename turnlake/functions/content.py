"""Message contents as lists of parts: plain texts, lists of parts and anything else, in one form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnlake.functions import text as T

#: A part: its type, its text if it has one, and the part as JSON if it is an object.
PARTS = "array<struct<type:string,text:string,json:string>>"
#: Tokens of a part without text.
OTHER_TOKENS = 10
#: Characters of a call's arguments that are shown.
ARGUMENTS = 100


def _kind(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value), F.lit("VOID"))


def _is_object(value: Column) -> Column:
    return _kind(value).startswith("OBJECT")


def _elements(content: Column) -> Column:
    return F.when(_kind(content).startswith("ARRAY"), F.try_variant_get(content, "$", "array<variant>"))


def _text(part: Column) -> Column:
    return F.when(_kind(F.try_variant_get(part, "$.text", "variant")) == "STRING", F.try_variant_get(part, "$.text", "string"))


def _plain(text: Column) -> Column:
    return F.struct(F.lit("text").alias("type"), F.coalesce(text, F.lit("")).alias("text"), F.lit(None).cast("string").alias("json"))


def of_text(text: Column) -> Column:
    """A plain text as a list of one part."""
    return F.array(_plain(text)).cast(PARTS)


def parts(content: Column) -> Column:
    """A variant as parts: a text is one part, of a list objects stay as they are and other elements become texts, anything else is a text."""
    shown = lambda v: F.when(F.is_variant_null(v), "").otherwise(F.try_variant_get(v, "$", "string"))
    one = lambda p: F.when(_is_object(p), F.struct(F.try_variant_get(p, "$.type", "string").alias("type"), _text(p).alias("text"), F.to_json(p).alias("json"))).otherwise(_plain(shown(p)))
    return F.coalesce(F.transform(_elements(content), one).cast(PARTS), of_text(shown(content)))


def message_tokens(content: Column) -> Column:
    """Tokens of a message: of its text, or of its parts' texts and OTHER_TOKENS for each part without; 0 for anything else."""
    each = F.transform(_elements(content), lambda p: F.when(_text(p).isNotNull(), T.tokens(_text(p))).otherwise(F.lit(OTHER_TOKENS).cast("long")))
    total = F.aggregate(each, F.lit(0).cast("long"), lambda a, b: a + b)
    return F.when(_kind(content) == "STRING", T.tokens(F.try_variant_get(content, "$", "string"))).otherwise(F.coalesce(total, F.lit(0).cast("long")))


def call_texts(content: Column) -> Column:
    """Tool calls of a message as name(arguments), the arguments as JSON cut to ARGUMENTS characters."""
    calls = F.filter(_elements(content), lambda p: F.try_variant_get(p, "$.type", "string") == "toolCall")
    name = lambda p: F.coalesce(F.nullif(F.try_variant_get(p, "$.name", "string"), F.lit("")), F.lit("?"))
    given = lambda p: F.try_variant_get(p, "$.arguments", "variant")
    shown = lambda p: F.when(F.is_variant_null(given(p)), "{}").otherwise(F.coalesce(F.to_json(given(p)), F.lit("{}")))
    return F.coalesce(F.transform(calls, lambda p: F.concat(name(p), F.lit("("), F.substring(shown(p), 1, ARGUMENTS), F.lit(")"))), F.array().cast("array<string>"))


def with_parts(lines: DataFrame) -> DataFrame:
    """Typed lines with parts, message_tokens and call_texts; where a source has none, those of plain texts."""
    named = F.coalesce(F.transform("tool_calls", lambda x: F.concat(x, F.lit("({})"))), F.array().cast("array<string>")) if "tool_calls" in lines.columns else F.array().cast("array<string>")
    made = {"parts": of_text(F.col("text")), "message_tokens": T.tokens(F.col("text")), "call_texts": named}
    return lines.withColumns({k: v for k, v in made.items() if k not in lines.columns})
