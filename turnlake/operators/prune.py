"""Flat context windows: statistics, pinning, pruning strategies, local summaries. Rows: session_id, idx, role, content, token_count, pinned."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnlake.config import ContextConfig
from turnlake.functions import text as T


def _session():
    return Window.partitionBy("session_id")


def add(messages: DataFrame, more: DataFrame) -> DataFrame:
    """messages with more appended in the order of their idx; missing token counts are estimated."""
    ends = messages.groupBy("session_id").agg((F.max("idx") + 1).alias("_n"))
    at = F.row_number().over(_session().orderBy("idx")) - 1
    rows = more.join(ends, "session_id", "left").withColumn("idx", (at + F.coalesce("_n", F.lit(0))).cast("int")).drop("_n")
    return filled(messages).unionByName(filled(rows), allowMissingColumns=True)


def filled(messages: DataFrame) -> DataFrame:
    return messages.withColumn("token_count", F.coalesce(F.nullif(F.col("token_count"), F.lit(0)), T.tokens(F.col("content"))))


def pin(messages: DataFrame, marks: DataFrame) -> DataFrame:
    """messages with pinned set by marks (session_id, idx, pin); marks beyond the messages change nothing."""
    return messages.join(marks.select("session_id", "idx", "pin"), ["session_id", "idx"], "left").withColumn("pinned", F.coalesce("pin", "pinned")).drop("pin")


def window(messages: DataFrame, config: ContextConfig = ContextConfig()) -> DataFrame:
    """Per session: messages, tokens, usage, near_limit and over_limit."""
    out = messages.groupBy("session_id").agg(F.count("*").alias("messages"), F.sum("token_count").alias("tokens"))
    usage = F.col("tokens") / config.max_tokens
    return out.withColumns({"usage": usage, "near_limit": usage >= config.summarize_threshold, "over_limit": F.col("tokens") > config.max_tokens})


def stats(messages: DataFrame) -> DataFrame:
    """Per session and role: messages, tokens and pinned messages."""
    return messages.groupBy("session_id", "role").agg(F.count("*").alias("messages"), F.sum("token_count").alias("tokens"), F.count_if("pinned").alias("pinned"))


def _marked(messages: DataFrame, target: Column, config: ContextConfig, recent: bool = True) -> DataFrame:
    n = F.count("*").over(_session())
    safe = F.coalesce("pinned", F.lit(False))
    if config.preserve_system:
        safe = safe | (F.col("role") == "system")
    if recent:
        safe = safe | (F.col("idx") >= n - config.preserve_recent_messages)
    return messages.withColumns({"_safe": safe, "_total": F.sum("token_count").over(_session()), "_target": target, "_n": n})


def fifo(messages: DataFrame, target: Column, config: ContextConfig = ContextConfig()) -> DataFrame:
    """messages with pruned: the oldest unprotected go until the rest fits target."""
    rows = _marked(messages, target, config)
    before = F.sum(F.when(~F.col("_safe"), F.col("token_count")).otherwise(0)).over(_session().orderBy("idx").rowsBetween(Window.unboundedPreceding, -1))
    gone = ~F.col("_safe") & (F.col("_total") - F.coalesce(before, F.lit(0)) > F.col("_target"))
    return rows.withColumn("pruned", gone).drop("_safe", "_total", "_target", "_n")


def score() -> Column:
    """Worth of a message by role, age and pin; needs _n, the messages of its session."""
    role = F.when(F.col("role") == "system", 100.0).when(F.col("role") == "user", 30.0).when(F.col("role") == "assistant", 20.0).when(F.col("role") == "tool", 10.0).otherwise(15.0)
    return role + F.col("idx") / F.greatest(F.lit(1), F.col("_n") - 1) * 50 + F.when(F.coalesce("pinned", F.lit(False)), 1000.0).otherwise(0.0)


def by_importance(messages: DataFrame, target: Column, config: ContextConfig = ContextConfig()) -> DataFrame:
    """messages with pruned: the least worthy unprotected go until target is met."""
    rows = _marked(messages, target, config).withColumn("score", score())
    before = F.sum(F.when(~F.col("_safe"), F.col("token_count")).otherwise(0)).over(_session().orderBy("score", "idx").rowsBetween(Window.unboundedPreceding, -1))
    gone = ~F.col("_safe") & (F.coalesce(before, F.lit(0)) < F.col("_total") - F.col("_target"))
    return rows.withColumn("pruned", gone).drop("_safe", "_total", "_target", "_n", "score")


def sliding_window(messages: DataFrame, target: Column, config: ContextConfig = ContextConfig()) -> DataFrame:
    """messages with pruned: from the newest on, each that still fits is kept, beside pinned and system messages.

    What fits depends on all choices before, so a session is one fold over its messages.
    """
    rows = _marked(messages, target, config, recent=False)
    kept = F.sum(F.when(F.col("_safe"), F.col("token_count")).otherwise(0))
    candidates = F.sort_array(F.collect_list(F.when(~F.col("_safe"), F.struct(F.col("idx"), F.col("token_count").alias("t")))), asc=False)
    folded = rows.groupBy("session_id").agg(candidates.alias("c"), (F.first("_target") - kept).cast("double").alias("budget"))
    start = F.struct(F.col("budget").alias("left"), F.array().cast("array<int>").alias("kept"))
    step = lambda s, m: F.when(s["left"] >= m["t"], F.struct((s["left"] - m["t"]).alias("left"), F.concat(s["kept"], F.array(m["idx"])).alias("kept"))).otherwise(s)
    chosen = folded.select("session_id", F.explode(F.aggregate("c", start, step)["kept"]).alias("idx")).withColumn("_chosen", F.lit(True))
    joined = rows.join(chosen, ["session_id", "idx"], "left")
    return joined.withColumn("pruned", (F.col("_total") > F.col("_target")) & ~F.col("_safe") & F.col("_chosen").isNull()).drop("_safe", "_total", "_target", "_n", "_chosen")


STRATEGIES = {"fifo": fifo, "sliding-window": sliding_window, "importance": by_importance}


def prune(messages: DataFrame, target: Column | int, strategy: str = "fifo", config: ContextConfig = ContextConfig()) -> DataFrame:
    """By the named strategy; fifo for unknown names. A strategy of one's own may be registered in STRATEGIES."""
    return STRATEGIES.get(strategy, fifo)(messages, F.lit(target) if isinstance(target, int) else target, config)


def report(pruned: DataFrame) -> DataFrame:
    """Per session: messages kept and pruned, and the tokens that pruning saves."""
    return pruned.groupBy("session_id").agg(F.count_if(~F.col("pruned")).alias("kept"), F.count_if("pruned").alias("pruned"), F.coalesce(F.sum(F.when(F.col("pruned"), F.col("token_count"))), F.lit(0)).cast("long").alias("tokens_saved"))


def local_summary(messages: DataFrame, most: int = 20) -> DataFrame:
    """Per session, (original_messages, original_tokens, content, tokens): first sentences of over 10 characters of users and assistants."""
    sentence = T.first_sentence(F.col("content"))
    rows = messages.withColumn("_p", F.when(F.col("role").isin("user", "assistant") & (F.char_length(sentence) > 10), F.concat(F.lit("["), "role", F.lit("] "), sentence)))
    rows = rows.withColumn("_k", F.count("_p").over(_session().orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)))
    first = F.when(F.col("_p").isNotNull() & (F.col("_k") <= most), F.struct("idx", "_p"))
    out = rows.groupBy("session_id").agg(F.count("*").alias("original_messages"), F.sum("token_count").alias("original_tokens"), F.sort_array(F.collect_list(first)).alias("p"))
    points = F.array_join(F.transform("p", lambda x: x["_p"]), "\n")
    n = F.col("original_messages").cast("string")
    content = F.when(F.size("p") > 0, F.concat(F.lit("Context summary ("), n, F.lit(" messages):\n"), points)).otherwise(F.concat(F.lit("Context summary: "), n, F.lit(" messages exchanged.")))
    return out.withColumn("content", content).drop("p").withColumn("tokens", T.tokens(F.col("content")))
