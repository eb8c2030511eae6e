"""JSON-lines session logs as typed lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnlake.functions import content as C
from turnlake.functions import text as T

COLUMNS = ["session_id", "line", "entry_id", "type", "ts_raw", "ts", "role", "tokens", "user_text", "assistant_text", "tool_calls", "tool_name", "is_error", "text", "raw_role", "meta_session_id", "session_version", "cwd", "provider", "model_id", "parts", "message_tokens", "call_texts", "raw"]


def session_of(path: Column) -> Column:
    """The session of a file: its name without folders and ending."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.jsonl$", "")


def raw_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(session_id, line, raw): lines of every file, cut at "\n" only and numbered from 1; the session is the file's name.

    Large files are read in splits: rows of a split are counted, and a line's number is the rows of the file's splits before it and its
    place in its own. No file and no line of another split is held in memory.
    """
    rows = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("raw"))
    splits = rows.groupBy("file", "split").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = rows.join(splits.withColumn("before", before).drop("n"), ["file", "split"])
    return numbered.select(session_of(F.col("file")).alias("session_id"), (F.col("before") + F.col("at") - F.col("first") + 1).cast("int").alias("line"), "raw")


def _get(path: str, kind: str) -> Column:
    return F.try_variant_get("j", path, kind)


def _kind(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value), F.lit("VOID"))


def parse_lines(lines: DataFrame, start_line: int = 1) -> DataFrame:
    """Typed lines of (session_id, line, raw) from start_line on; blank and malformed lines and null values go."""
    lines = lines.filter(F.col("line") >= start_line).withColumn("j", F.try_parse_json(T.trim(F.col("raw")))).filter("j is not null").filter(~F.is_variant_null("j"))
    known = ["session", "model_change", "thinking_level_change", "custom", "message"]
    kind = _get("$.type", "string")
    out = lines.select(
        "session_id", "line", "raw", F.coalesce(_get("$.id", "string"), F.concat(F.lit("line-"), F.col("line").cast("string"))).alias("entry_id"),
        F.when(kind.isin(known), kind).otherwise("custom").alias("type"), F.coalesce(_get("$.timestamp", "string"), F.lit("")).alias("ts_raw"), "j",
        _get("$.message", "variant").alias("m"),
    )
    message = (F.col("type") == "message") & _kind(F.col("m")).startswith("OBJECT")
    content = _get("$.message.content", "variant")
    is_array, is_string = _kind(content).startswith("ARRAY"), _kind(content) == "STRING"
    parts = F.when(is_array, F.try_variant_get(content, "$", "array<variant>"))
    name = F.when(message, F.coalesce(_get("$.message.role", "string"), F.lit("")))
    role = F.when(name.isin("assistant", "toolResult"), name).when(name.isNotNull(), "user")
    text_of = lambda p: F.when(_kind(F.try_variant_get(p, "$.text", "variant")) == "STRING", F.try_variant_get(p, "$.text", "string"))
    type_of = lambda p: F.try_variant_get(p, "$.type", "string")
    out = out.withColumns({"raw_role": name, "role": role, "found": F.when(message, F.coalesce(parts, F.array().cast("array<variant>"))), "plain": F.when(message & is_string, F.try_variant_get(content, "$", "string"))})
    joined = F.coalesce("plain", F.array_join(F.transform("found", lambda p: F.coalesce(text_of(p), F.lit(""))), "\n"))
    texts = F.transform(F.filter("found", lambda p: (type_of(p) == "text") & text_of(p).isNotNull()), text_of)
    calls = F.filter("found", lambda p: type_of(p) == "toolCall")
    arguments = lambda p: F.coalesce(F.try_variant_get(p, "$.arguments", "variant"), F.try_variant_get(p, "$.input", "variant"))
    spent = F.aggregate(F.transform(texts, T.tokens), F.lit(0).cast("long"), lambda a, b: a + b) + F.aggregate(
        F.transform(calls, lambda p: T.tokens(F.coalesce(F.to_json(arguments(p)), F.lit("{}")))), F.lit(0).cast("long"), lambda a, b: a + b
    )
    used = F.when(_kind(_get("$.message.usage.output", "variant")).rlike("^(BIGINT|DOUBLE|DECIMAL|FLOAT)"), _get("$.message.usage.output", "double"))
    stripped = F.array_join(F.transform(F.filter("found", lambda p: type_of(p) == "text"), lambda p: F.coalesce(text_of(p), F.lit(""))), "")
    assistant = F.col("role") == "assistant"
    out = out.withColumns({
        "tokens": F.when(assistant, F.when(used != 0, used.cast("long")).otherwise(spent)).when(F.col("role").isNotNull(), T.tokens(joined)),
        "user_text": F.when(F.col("role") == "user", T.preview(T.strip_sender(joined))),
        "assistant_text": F.when(assistant, T.preview(F.coalesce(F.try_element_at(texts, F.lit(-1)), F.lit("")))),
        "tool_calls": F.when(assistant, F.filter(F.transform(calls, lambda p: F.try_variant_get(p, "$.name", "string")), lambda x: x.isNotNull())),
        "tool_name": F.when(F.col("role") == "toolResult", _get("$.message.toolName", "string")),
        "is_error": F.when(F.col("role") == "toolResult", F.coalesce(_get("$.message.isError", "boolean"), F.lit(False))),
        "text": F.when(message, F.coalesce("plain", stripped)),
        "parts": F.when(message, C.parts(content)), "message_tokens": F.when(message, C.message_tokens(content)), "call_texts": F.when(message, C.call_texts(content)),
        "ts": F.try_to_timestamp("ts_raw"),
        "meta_session_id": F.when(F.col("type") == "session", _get("$.id", "string")), "session_version": F.when(F.col("type") == "session", _get("$.version", "double")),
        "cwd": F.when(F.col("type") == "session", _get("$.cwd", "string")), "provider": F.when(F.col("type") == "model_change", _get("$.provider", "string")),
        "model_id": F.when(F.col("type") == "model_change", _get("$.modelId", "string")),
    })
    return out.select(*COLUMNS)


def read_sessions(spark: SparkSession, path: str | list[str], start_line: int = 1) -> DataFrame:
    """Typed lines of all session files at a path or at paths."""
    return parse_lines(raw_lines(spark, path), start_line)
