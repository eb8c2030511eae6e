"""Message tables as typed lines, and the bindings of the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnlake.functions import text as T

LINE_COLUMNS = ["session_id", "line", "entry_id", "role", "tokens", "user_text", "assistant_text", "tool_calls", "tool_name", "is_error", "ts", "text", "raw_role"]


def from_messages(rows: DataFrame) -> DataFrame:
    """Typed lines of rows (session_id, line, entry_id, role, text) and, if there, tool_calls, tool_name, is_error, ts.

    Roles other than assistant and toolResult open turns, as users' do.
    """
    for name, kind in (("tool_calls", "array<string>"), ("tool_name", "string"), ("is_error", "boolean"), ("ts", "timestamp")):
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(None).cast(kind))
    role = F.when(F.col("role").isin("assistant", "toolResult"), F.col("role")).otherwise("user")
    rows = rows.withColumns({"raw_role": F.col("role"), "role": role, "text": F.coalesce("text", F.lit(""))})
    rows = rows.withColumns({"tokens": T.tokens(F.col("text")), "user_text": F.when(F.col("role") == "user", T.preview(T.strip_sender(F.col("text")))), "assistant_text": F.when(F.col("role") == "assistant", T.preview(F.col("text")))})
    return rows.select(*LINE_COLUMNS)


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def conv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A session per conversation."""
    c = _read(spark, sf_dir, "conversations")
    return from_messages(c.select(F.col("conv_id").cast("string").alias("session_id"), (F.col("turn") + 1).cast("int").alias("line"), F.concat(F.lit("c"), "conv_id", F.lit("-t"), "turn").alias("entry_id"), "role", "text"))


def conv10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A session per ten conversations."""
    c = _read(spark, sf_dir, "conversations").withColumn("session_id", F.floor(F.col("conv_id") / 10).cast("string"))
    line = F.row_number().over(Window.partitionBy("session_id").orderBy("conv_id", "turn"))
    return from_messages(c.select("session_id", line.alias("line"), F.concat(F.lit("c"), "conv_id", F.lit("-t"), "turn").alias("entry_id"), "role", "text"))


def tooltalk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A session per twenty documents; a document is a question, a tool's result and an answer."""
    d = _read(spark, sf_dir, "documents")
    size = F.char_length("text")
    rows = F.array(
        F.struct(F.lit(1).alias("k"), F.lit("user").alias("role"), F.substring("text", 1, 80).alias("text")),
        F.struct(F.lit(2).alias("k"), F.lit("toolResult").alias("role"), F.col("text")),
        F.struct(F.lit(3).alias("k"), F.lit("assistant").alias("role"), F.substring("text", F.greatest(size - 79, F.lit(1)), F.lit(80)).alias("text")),
    )
    e = d.select("doc_id", "source", F.explode(rows).alias("r")).select("doc_id", "source", "r.*")
    is_tool = F.col("role") == "toolResult"
    return from_messages(e.select(F.floor(F.col("doc_id") / 20).cast("string").alias("session_id"), ((F.col("doc_id") % 20) * 3 + F.col("k")).cast("int").alias("line"), F.concat(F.lit("d"), "doc_id", F.lit("-"), "k").alias("entry_id"), "role", "text", F.when(is_tool, F.col("source")).alias("tool_name"), F.when(is_tool, False).alias("is_error")))


def events30(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A session per thirty users; views and sign-ups ask, clicks read, purchases write, errors are a tool's."""
    e = _read(spark, sf_dir, "events").withColumn("session_id", F.floor(F.col("user_id") / 30).cast("string"))
    line = F.row_number().over(Window.partitionBy("session_id").orderBy("ts", "event_id"))
    kind = F.col("event_type")
    role = F.when(kind.isin("view", "signup"), "user").when(kind.isin("click", "purchase"), "assistant").otherwise("toolResult")
    calls = F.when(kind == "click", F.array(F.lit("read"))).when(kind == "purchase", F.array(F.lit("write")))
    return from_messages(e.select("session_id", line.alias("line"), F.concat(F.lit("e"), "event_id").alias("entry_id"), role.alias("role"), F.coalesce("props", F.lit("")).alias("text"), calls.alias("tool_calls"), F.when(kind == "error", "exec").alias("tool_name"), (kind == "error").alias("is_error"), F.col("ts").cast("timestamp").alias("ts")))


def context_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat messages (session_id, idx, role, content, token_count, pinned); in every tenth conversation the second is pinned."""
    c = _read(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").cast("string").alias("session_id"), F.col("turn").cast("int").alias("idx"), "role", F.col("text").alias("content"), T.tokens(F.col("text")).alias("token_count"), ((F.col("turn") == 1) & (F.col("conv_id") % 10 == 0)).alias("pinned"))
