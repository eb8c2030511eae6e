"""Turns of sessions, their statistics, and queries over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnlake.functions.importance import importance


def with_turn(lines: DataFrame) -> DataFrame:
    """Message lines with seq, the number of their turn: a user line opens one, lines before the first have none and go."""
    order = Window.partitionBy("session_id").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    opened = F.sum((F.col("role") == "user").cast("int")).over(order)
    return lines.filter("role is not null").withColumn("seq", opened - 1).filter("seq >= 0").withColumn("seq", F.col("seq").cast("int"))


def turns(lines: DataFrame) -> DataFrame:
    """One row per turn. The window and the aggregation share one shuffle by session."""
    spent = lambda role: F.sum(F.when(F.col("role") == role, F.col("tokens")).otherwise(0))
    called = F.concat(F.coalesce("tool_calls", F.array().cast("array<string>")), F.when(F.coalesce("tool_name", F.lit("")) != "", F.array("tool_name")).otherwise(F.array().cast("array<string>")))
    ordered = F.sort_array(F.collect_list(F.when(F.size("used") > 0, F.struct("line", "used"))))
    out = with_turn(lines).withColumn("used", called).groupBy("session_id", "seq").agg(
        F.min_by("entry_id", "line").alias("turn_id"), F.min("line").alias("line_start"), F.max("line").alias("line_end"), F.count("*").alias("message_count"),
        F.array_distinct(F.flatten(F.transform(ordered, lambda x: x["used"]))).alias("tools_used"), F.sum(F.coalesce(F.size("tool_calls"), F.lit(0)).cast("long")).alias("calls"),
        F.sum("tokens").alias("total_tokens"), spent("user").alias("user_tokens"), spent("assistant").alias("assistant_tokens"), spent("toolResult").alias("tool_result_tokens"),
        F.coalesce(F.min_by("user_text", "line"), F.lit("")).alias("user_preview"),
        F.coalesce(F.max_by("assistant_text", F.when(F.col("assistant_text") != "", F.col("line"))), F.lit("")).alias("assistant_preview"),
        F.min_by("ts", "line").alias("start_time"), F.max_by("ts", "line").alias("end_time"), F.coalesce(F.bool_or("is_error"), F.lit(False)).alias("has_error"),
    )
    out = out.withColumn("tool_call_count", F.greatest(F.col("calls"), F.lit(0))).drop("calls")
    score = importance(F.col("user_tokens"), F.col("assistant_preview") != "", F.col("has_error"), F.col("tool_call_count"), F.col("message_count"), F.col("tools_used"))
    return out.withColumn("importance", score)


def session_meta(lines: DataFrame) -> DataFrame:
    """Last session line and last change of model of each session (of JSON lines)."""
    last = lambda kind, *names: [F.max_by(n, F.when(F.col("type") == kind, F.col("line"))).alias(n) for n in names]
    return lines.groupBy("session_id").agg(*last("session", "meta_session_id", "session_version", "cwd"), *last("model_change", "provider", "model_id"))


def session_stats(turn_rows: DataFrame, lines: DataFrame | None = None) -> DataFrame:
    """Per session: turns, tokens, messages and uses of tools (a tool counts once in a turn); lines, if given, their last number."""
    out = turn_rows.groupBy("session_id").agg(F.count("*").alias("total_turns"), F.sum("total_tokens").alias("total_tokens"), F.sum("message_count").alias("total_messages"), F.sum(F.size("tools_used").cast("long")).alias("total_tool_calls"))
    if lines is None:
        return out
    return lines.groupBy("session_id").agg(F.max("line").cast("long").alias("total_lines")).join(out, "session_id", "left").fillna(0)


def tool_usage(turn_rows: DataFrame) -> DataFrame:
    """Per session and tool, the turns that use it."""
    return turn_rows.select("session_id", F.explode("tools_used").alias("tool")).groupBy("session_id", "tool").agg(F.count("*").alias("turns"))


def recent(turn_rows: DataFrame, n: int) -> DataFrame:
    """The last n turns of each session; all for 0."""
    if not n:
        return turn_rows
    return _first(turn_rows, n, F.desc("seq"))


def largest(turn_rows: DataFrame, n: int) -> DataFrame:
    return _first(turn_rows, n, F.desc("total_tokens"), "seq")


def by_tool(turn_rows: DataFrame, tool: str) -> DataFrame:
    return turn_rows.filter(F.array_contains("tools_used", tool))


def lookup(turn_rows: DataFrame, turn_id: str | None = None, seq: int | None = None) -> DataFrame:
    """Turns of an id, or of a number in every session; of a repeated id in a session, the last."""
    if turn_id is None:
        return turn_rows.filter(F.col("seq") == seq)
    return _first(turn_rows.filter(F.col("turn_id") == turn_id), 1, F.desc("seq"))


def _first(rows: DataFrame, n: int, *order) -> DataFrame:
    return rows.withColumn("_rank", F.row_number().over(Window.partitionBy("session_id").orderBy(*order))).filter(F.col("_rank") <= n).drop("_rank")


def with_cutoff(turn_rows: DataFrame, preserve: int) -> DataFrame:
    """turn_rows with `recent`: whether a turn is one of its session's last preserve ones."""
    count = F.count("*").over(Window.partitionBy("session_id"))
    return turn_rows.withColumn("recent", F.col("seq") >= count - preserve)


def compressible(turn_rows: DataFrame, preserve: int = 5) -> DataFrame:
    """Turns before the preserved ones, with `order`: least important first, earlier first among equals."""
    rows = with_cutoff(turn_rows, preserve).filter("not recent").drop("recent")
    return rows.withColumn("order", F.row_number().over(Window.partitionBy("session_id").orderBy("importance", "seq")))


def recommend(turn_rows: DataFrame, target: Column | int, preserve: int = 5) -> DataFrame:
    """Turns to compress, in order, until savings of 85 % each bring the session's tokens to target."""
    whole = turn_rows.withColumn("_total", F.sum("total_tokens").over(Window.partitionBy("session_id")))
    rows = compressible(whole, preserve).withColumn("savings", F.floor(F.col("total_tokens") * F.lit(0.85)))
    before = F.sum("savings").over(Window.partitionBy("session_id").orderBy("order").rowsBetween(Window.unboundedPreceding, -1))
    need = F.col("_total") - (F.lit(target) if isinstance(target, int) else target)
    return rows.filter(need > 0).withColumn("_before", F.coalesce(before, F.lit(0))).filter(F.col("_before") < need).drop("_total", "_before")


def recover(lines: DataFrame, turn_rows: DataFrame) -> DataFrame:
    """All lines from each turn's first to its last, by carrying the turn's number down the lines: no range join."""
    starts = turn_rows.select("session_id", F.col("line_start").alias("line"), "turn_id", "seq", "line_end")
    order = Window.partitionBy("session_id").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    joined = lines.join(starts, ["session_id", "line"], "left").withColumn("_at", F.when(F.col("seq").isNotNull(), F.struct("turn_id", "seq", "line_end"))).drop("turn_id", "seq", "line_end")
    carried = joined.withColumn("_t", F.last("_at", ignorenulls=True).over(order))
    return carried.filter(F.col("line") <= F.col("_t.line_end")).select(*lines.columns, F.col("_t.turn_id").alias("turn_id"), F.col("_t.seq").alias("seq"))
