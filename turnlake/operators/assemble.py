"""Assembling a context that fits a budget, and making it smaller: truncation of tool results, summaries of turns and topics.

Side tables: summaries (session_id, turn_id, summary, tokens, original_tokens, method), tool_results (session_id, turn_id, msg_idx,
truncated_content, truncated_tokens, original_tokens, original_chars), topic_compactions (session_id, kind, topic_id, subtopic_id,
label, summary, summary_tokens, turn_count, turn_ids, original_tokens, method). Any may be None.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnlake.config import EngineConfig
from turnlake.functions import content as C
from turnlake.functions import text as T
from turnlake.operators import turns as Q
from turnlake.stores import materialise

SUMMARIES = "session_id string, turn_id string, summary string, tokens bigint, original_tokens bigint, method string"
TOOL_RESULTS = "session_id string, turn_id string, msg_idx int, truncated_content string, truncated_tokens bigint, original_tokens bigint, original_chars int"
TOPIC_COMPACTIONS = "session_id string, kind string, topic_id string, subtopic_id string, label string, summary string, summary_tokens bigint, turn_count bigint, turn_ids array<string>, original_tokens bigint, method string"


def _or_empty(table: DataFrame | None, like: DataFrame, schema: str) -> DataFrame:
    return like.sparkSession.createDataFrame([], schema) if table is None else table


def relevant(topic_turns: DataFrame, config: EngineConfig = EngineConfig(), compacted: DataFrame | None = None) -> DataFrame:
    """topic_turns with recent, covered (by a compaction in use) and relevant (same topic, and sub-topic if known, as the last turn)."""
    order = Window.partitionBy("session_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = Q.with_cutoff(topic_turns, config.preserve_recent_turns).withColumns({"_now": F.last("topic_id").over(order), "_topics": F.max("topic_ord").over(order) + 1})
    same = F.col("topic_id") == F.col("_now")
    if "subtopic_id" in topic_turns.columns:
        current = F.last("current_subtopic" if "current_subtopic" in topic_turns.columns else "subtopic_id").over(order)
        same = same & (F.col("subtopic_id").isNull() | current.isNull() | (F.col("subtopic_id") == current))
    rows = rows.withColumn("relevant", same | (F.col("_topics") <= 1) if config.topic_aware else F.lit(True))
    done = _or_empty(compacted, topic_turns, TOPIC_COMPACTIONS)
    topics = done.filter("kind = 'topic'").select("session_id", "topic_id", F.lit(True).alias("_t")).distinct()
    turns = done.filter("kind = 'subtopic'").select("session_id", F.explode("turn_ids").alias("turn_id"), F.lit(True).alias("_s")).distinct()
    rows = rows.join(topics, ["session_id", "topic_id"], "left").join(turns, ["session_id", "turn_id"], "left")
    covered = (F.coalesce("_t", F.lit(False)) & ~same_topic()) | F.coalesce("_s", F.lit(False))
    return rows.withColumn("covered", covered).drop("_topics", "_t", "_s")


def same_topic():
    return F.col("topic_id") == F.col("_now")


def _old_messages(lines: DataFrame, rows: DataFrame) -> DataFrame:
    """Message lines of turns in rows with msg_idx, their place in the turn."""
    placed = Q.with_turn(C.with_parts(lines)).withColumn("msg_idx", F.row_number().over(Window.partitionBy("session_id", "seq").orderBy("line")) - 1)
    return placed.select("session_id", "seq", "line", "msg_idx", "raw_role", "text", "tool_name", "parts", "message_tokens").join(rows, ["session_id", "seq"])


def assemble(lines: DataFrame, topic_turns: DataFrame, config: EngineConfig = EngineConfig(), summaries: DataFrame | None = None, tool_results: DataFrame | None = None, compacted: DataFrame | None = None) -> DataFrame:
    """(session_id, phase, ord, sub_ord, role, content, tool_name, tokens, parts): the context's messages in order of phase, ord, sub_ord.

    parts is the content as a list of parts, whatever form it came in; content is its text.

    Phase 0: summaries of topics but the current one, and of sub-topics. Phase 1: older relevant turns, as a summary or message by
    message, tool results in their truncated form if there is one. Phase 2: messages of the last turns as they are.
    """
    marked = relevant(topic_turns, config, compacted)
    summaries = _or_empty(summaries, lines, SUMMARIES)
    tool_results = _or_empty(tool_results, lines, TOOL_RESULTS)
    compacted = _or_empty(compacted, lines, TOPIC_COMPACTIONS)
    columns = ["session_id", "phase", "ord", "sub_ord", "role", "content", "tool_name", "tokens", "parts"]
    none = F.lit(None).cast("string")

    now = marked.filter("recent").groupBy("session_id").agg(F.first("_now").alias("_now")) if config.preserve_recent_turns else marked.groupBy("session_id").agg(F.first("_now").alias("_now"))
    used = compacted.join(now, "session_id").filter((F.col("kind") == "subtopic") | ~same_topic())
    title = F.when(F.col("kind") == "subtopic", "[Sub-topic Summary: ").otherwise("[Topic Summary: ")
    place = F.row_number().over(Window.partitionBy("session_id").orderBy("topic_id", F.coalesce("subtopic_id", F.lit(""))))
    zero = used.select("session_id", F.lit(0).alias("phase"), place.alias("ord"), F.lit(0).alias("sub_ord"), F.lit("user").alias("role"), F.concat(title, "label", F.lit(" ("), F.col("turn_count").cast("string"), F.lit(" turns)]: "), "summary").alias("content"), none.alias("tool_name"), F.col("summary_tokens").alias("tokens"))

    old = marked.filter("not recent and not covered and relevant").select("session_id", "seq", "turn_id").join(summaries.select("session_id", "turn_id", "summary", F.col("tokens").alias("summary_tokens")), ["session_id", "turn_id"], "left")
    short = old.filter("summary is not null").select("session_id", F.lit(1).alias("phase"), F.col("seq").alias("ord"), F.lit(0).alias("sub_ord"), F.lit("user").alias("role"), F.concat(F.lit("[Summary of turn #"), F.col("seq").cast("string"), F.lit("]: "), "summary").alias("content"), none.alias("tool_name"), F.col("summary_tokens").alias("tokens"))
    messages = _old_messages(lines, old.filter("summary is null").select("session_id", "seq", "turn_id")).filter(F.col("raw_role").isin("user", "toolResult") | ((F.col("raw_role") == "assistant") & (F.col("text") != "")))
    messages = messages.join(tool_results.select("session_id", "turn_id", "msg_idx", "truncated_content", "truncated_tokens"), ["session_id", "turn_id", "msg_idx"], "left")
    is_tool = F.col("raw_role") == "toolResult"
    whole = messages.select("session_id", F.lit(1).alias("phase"), F.col("seq").alias("ord"), F.col("msg_idx").alias("sub_ord"), F.when(is_tool, "tool").otherwise(F.col("raw_role")).alias("role"), F.when(is_tool, F.coalesce("truncated_content", "text")).otherwise(F.col("text")).alias("content"), F.when(is_tool, F.col("tool_name")).alias("tool_name"), F.when(is_tool & F.col("truncated_tokens").isNotNull(), F.col("truncated_tokens")).otherwise(T.tokens(F.col("text"))).alias("tokens"))

    last = _old_messages(lines, marked.filter("recent").select("session_id", "seq"))
    two = last.select("session_id", F.lit(2).alias("phase"), F.col("seq").alias("ord"), F.col("msg_idx").alias("sub_ord"), F.col("raw_role").alias("role"), F.col("text").alias("content"), "tool_name", F.col("message_tokens").alias("tokens"), "parts")
    plain = lambda rows: rows.withColumn("parts", C.of_text(F.col("content"))).select(columns)
    return plain(zero).union(plain(short)).union(plain(whole)).union(two.select(columns))


def pass_through(messages: DataFrame) -> DataFrame:
    """Messages (session_id, idx, role, content) of sessions without a log, as a context of no tokens: content in parts, nothing left out."""
    text = F.coalesce(F.col("content").cast("string"), F.lit(""))
    return messages.select("session_id", F.lit(2).alias("phase"), F.col("idx").cast("int").alias("ord"), F.lit(0).alias("sub_ord"), "role", text.alias("content"), F.lit(None).cast("string").alias("tool_name"), F.lit(0).cast("long").alias("tokens"), C.of_text(text).alias("parts"))


def used_tokens(context: DataFrame, config: EngineConfig = EngineConfig()) -> DataFrame:
    """Per session: messages, tokens, and over, whether they exceed the threshold."""
    return context.groupBy("session_id").agg(F.count("*").alias("messages"), F.sum("tokens").alias("tokens")).withColumn("over", F.col("tokens") > config.threshold)


def needs_compaction(turn_rows: DataFrame, config: EngineConfig = EngineConfig()) -> DataFrame:
    """Per session: turns, tokens, and whether they exceed the threshold."""
    return turn_rows.groupBy("session_id").agg(F.count("*").alias("turns"), F.sum("total_tokens").alias("tokens")).withColumn("needs_compaction", F.col("tokens") > config.threshold)


def truncations(lines: DataFrame, turn_rows: DataFrame, used: DataFrame, config: EngineConfig = EngineConfig(), summaries: DataFrame | None = None, tool_results: DataFrame | None = None) -> DataFrame:
    """New rows of tool_results for sessions over the threshold: oldest turns first, until what is saved suffices."""
    over = used.filter("over").select("session_id", F.col("tokens").alias("_used"))
    old = Q.with_cutoff(turn_rows, config.preserve_recent_turns).filter("not recent").select("session_id", "seq", "turn_id").join(over, "session_id")
    old = old.join(_or_empty(summaries, lines, SUMMARIES), ["session_id", "turn_id"], "left_anti")
    most = config.tool_result_truncate_chars
    big = _old_messages(lines, old).filter((F.col("raw_role") == "toolResult") & (F.char_length("text") > most))
    big = big.join(_or_empty(tool_results, lines, TOOL_RESULTS), ["session_id", "turn_id", "msg_idx"], "left_anti")
    # Written once: what is saved by each turn and what goes out are both read from it.
    cut = materialise(big.withColumn("truncated_content", T.truncate(F.col("text"), most)), "cut").withColumns({"truncated_tokens": T.tokens(F.col("truncated_content")), "original_tokens": T.tokens(F.col("text")), "original_chars": F.char_length("text")})
    saved = cut.groupBy("session_id", "seq").agg(F.sum(F.col("original_tokens") - F.col("truncated_tokens")).alias("saved"))
    steps = old.select("session_id", "seq", "_used").join(saved, ["session_id", "seq"], "left").fillna(0, ["saved"])
    order = Window.partitionBy("session_id").orderBy("seq")
    left = F.col("_used") - F.coalesce(F.sum("saved").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # The walk ends after the turn that suffices; savings may be negative, so the least so far decides.
    go = steps.withColumn("_left", left).withColumn("_least", F.min("_left").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    go = go.filter(F.col("_least") > config.threshold).select("session_id", "seq")
    return cut.join(go, ["session_id", "seq"], "left_semi").select("session_id", "turn_id", F.col("msg_idx").cast("int").alias("msg_idx"), "truncated_content", "truncated_tokens", "original_tokens", "original_chars")


def turn_summary():
    """Local summary of a turn from its row, a line for each thing there is."""
    tools = F.when(F.size("tools_used") > 0, F.concat(F.lit("Tools: "), F.array_join("tools_used", ", ")))
    reply = F.when(F.col("assistant_preview") != "", F.concat(F.lit("Assistant: "), "assistant_preview"))
    error = F.when(F.col("has_error"), F.lit("⚠️ This turn had tool errors"))
    size = F.concat(F.lit("("), F.col("message_count").cast("string"), F.lit(" messages, lines "), F.col("line_start").cast("string"), F.lit("-"), F.col("line_end").cast("string"), F.lit(")"))
    return F.concat_ws("\n", F.concat(F.lit("User: "), "user_preview"), tools, reply, error, size)


def compact(turn_rows: DataFrame, config: EngineConfig = EngineConfig(), summaries: DataFrame | None = None, summarizer=None, lines: DataFrame | None = None, tool_results: DataFrame | None = None) -> DataFrame:
    """New rows of summaries: of each session's largest older turns without one, as many as a cycle allows.

    A summarizer is given a turn's messages, with tool results as they are stored, if there are lines; else the local summary.
    """
    rows = Q.with_cutoff(turn_rows, config.preserve_recent_turns).filter("not recent").join(_or_empty(summaries, turn_rows, SUMMARIES), ["session_id", "turn_id"], "left_anti")
    rows = Q.largest(rows, config.max_compactions_per_cycle).withColumn("summary", turn_summary())
    if summarizer is None:
        rows = rows.withColumn("method", F.lit("local"))
    else:
        from turnlake.operators.summarize import compact_inputs, summarize

        rows = rows.withColumns({"_hint": F.concat(F.lit("Turn #"), F.col("seq").cast("string")), "_input": F.lit(None).cast("string")})
        if lines is not None:
            given = compact_inputs(lines, rows, tool_results).select("session_id", "seq", F.col("text").alias("_given"))
            rows = rows.join(given, ["session_id", "seq"], "left").withColumn("_input", F.col("_given")).drop("_given")
        rows = summarize(rows, summarizer, "summary", "_hint", input_col="_input")
    return rows.select("session_id", "turn_id", "summary", T.tokens(F.col("summary")).alias("tokens"), F.col("total_tokens").alias("original_tokens"), "method")


def compaction_report(turn_rows: DataFrame, before: DataFrame | None, new: DataFrame, config: EngineConfig = EngineConfig()) -> DataFrame:
    """Per session: compacted turns, tokens saved, cache hits; before: summaries there were."""
    old = Q.with_cutoff(turn_rows, config.preserve_recent_turns).filter("not recent").select("session_id", "turn_id")
    hits = old.join(_or_empty(before, turn_rows, SUMMARIES), ["session_id", "turn_id"]).withColumn("hit", F.lit(1)).select("session_id", "tokens", "original_tokens", "hit")
    rows = hits.union(new.select("session_id", "tokens", "original_tokens", F.lit(0)))
    return rows.groupBy("session_id").agg(F.count("*").alias("compacted"), F.sum(F.col("original_tokens") - F.col("tokens")).alias("tokens_saved"), F.sum("hit").alias("cache_hits"))


def compaction_result(report: DataFrame, summaries: DataFrame, tool_results: DataFrame | None, sessions: DataFrame) -> DataFrame:
    """Per session: compacted, reason or summary, tokens_before and tokens_after, and the details of a compaction.

    tokens_before is what all stored summaries have saved and what this compaction saves, tokens_after what this one saves.
    """
    saved = summaries.groupBy("session_id").agg(F.sum(F.col("original_tokens") - F.col("tokens")).alias("_all"))
    cut = _or_empty(tool_results, summaries, TOOL_RESULTS).groupBy("session_id").agg(F.count("*").alias("tool_result_truncations"), F.sum(F.col("original_tokens") - F.col("truncated_tokens")).alias("tool_result_tokens_saved"))
    rows = sessions.select("session_id").distinct().join(report, "session_id", "left").join(saved, "session_id", "left").join(cut, "session_id", "left")
    rows = rows.fillna(0, ["compacted", "tokens_saved", "cache_hits", "_all", "tool_result_truncations", "tool_result_tokens_saved"])
    done = F.col("compacted") > 0
    text = F.concat(F.lit("Compacted "), F.col("compacted").cast("string"), F.lit(" turns ("), (F.col("compacted") - F.col("cache_hits")).cast("string"), F.lit(" new, "), F.col("cache_hits").cast("string"), F.lit(" cached)"))
    return rows.select("session_id", done.alias("compacted"), F.when(~done, "All turns already compacted or recent").alias("reason"), F.when(done, text).alias("summary"), F.when(done, F.col("_all") + F.col("tokens_saved")).alias("tokens_before"), F.when(done, F.col("tokens_saved")).alias("tokens_after"), F.col("compacted").alias("compacted_count"), "cache_hits", "tool_result_truncations", "tool_result_tokens_saved")


def _summed(rows: DataFrame, keys: list[str], title, summaries: DataFrame) -> DataFrame:
    """Local summaries of groups of turns: title, tools in order of use, the first eight turns."""
    rows = rows.join(summaries.select("session_id", "turn_id", "summary", F.col("tokens").alias("_st")), ["session_id", "turn_id"], "left")
    lines = F.filter(F.split("summary", "\n"), lambda x: F.trim(x) != "")
    point = F.when(F.col("summary").isNotNull(), F.array_join(F.slice(lines, 1, 2), "; ")).otherwise(F.concat(F.lit("User: "), F.substring("user_preview", 1, 80), F.lit(" → "), F.substring("assistant_preview", 1, 60)))
    place = F.row_number().over(Window.partitionBy("session_id", *keys).orderBy("seq"))
    out = rows.withColumns({"_p": point, "_k": place}).groupBy("session_id", *keys).agg(
        F.count("*").alias("turn_count"), F.min("seq").alias("first_seq"), F.sum(F.coalesce("_st", "total_tokens")).alias("original_tokens"),
        F.sort_array(F.collect_list(F.struct("seq", "turn_id", "tools_used"))).alias("g"), F.sort_array(F.collect_list(F.when(F.col("_k") <= 8, F.struct("seq", "_p")))).alias("h"),
    )
    tools = F.array_distinct(F.flatten(F.transform("g", lambda x: x["tools_used"])))
    points = F.transform("h", lambda x: F.concat(F.lit("  - "), x["_p"]))
    summary = F.concat(
        F.lit("## Topic: "), title, F.lit(" ("), F.col("turn_count").cast("string"), F.lit(" turns)\n"),
        F.when(F.size(tools) > 0, F.concat(F.lit("\nTools used: "), F.array_join(tools, ", "))).otherwise(""), F.lit("\n\nKey turns:\n"), F.array_join(points, "\n"),
        F.when(F.col("turn_count") > 8, F.concat(F.lit("\n  - ... and "), (F.col("turn_count") - 8).cast("string"), F.lit(" more turns"))).otherwise(""),
    )
    out = out.withColumns({"summary": summary, "turn_ids": F.transform("g", lambda x: x["turn_id"])}).drop("g", "h")
    return out.withColumn("summary_tokens", T.tokens(F.col("summary")))


def _until(groups: DataFrame, keys: list[str], target: float) -> DataFrame:
    """Groups, in order of first_seq, until what eligible ones save brings _all to target; savings may be negative."""
    order = Window.partitionBy(*keys).orderBy("first_seq")
    saved = F.when(F.col("eligible"), F.col("original_tokens") - F.col("summary_tokens")).otherwise(0)
    left = F.col("_all") - F.coalesce(F.sum(saved).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = groups.withColumn("_left", left).withColumn("_least", F.min("_left").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.filter(F.col("eligible") & (F.col("_least") > target))


def compact_topics(topic_turns: DataFrame, config: EngineConfig = EngineConfig(), summaries: DataFrame | None = None, compacted: DataFrame | None = None) -> DataFrame:
    """New rows of topic_compactions: older turns' topics, earliest first, until the target is met.

    Topics of one turn and those with a compaction stay; so does the current topic, unless it is the only one with older turns: then
    its sub-topics are compacted, see compact_subtopics().
    """
    summaries = _or_empty(summaries, topic_turns, SUMMARIES)
    compacted = _or_empty(compacted, topic_turns, TOPIC_COMPACTIONS)
    old = relevant(topic_turns, config).filter("not recent")
    groups = _summed(old, ["topic_id", "label", "_now"], F.col("label"), summaries)
    done = compacted.filter("kind = 'topic'").select("session_id", "topic_id", F.lit(True).alias("_done"))
    groups = groups.join(done, ["session_id", "topic_id"], "left").filter(F.col("_done").isNull() | same_topic())
    groups = groups.withColumns({"_all": F.sum("original_tokens").over(Window.partitionBy("session_id")), "eligible": F.col("_done").isNull() & ~same_topic() & (F.col("turn_count") >= 2)})
    out = _until(groups, ["session_id"], config.topic_target)
    return out.select("session_id", F.lit("topic").alias("kind"), "topic_id", F.lit(None).cast("string").alias("subtopic_id"), "label", "summary", "summary_tokens", "turn_count", "turn_ids", "original_tokens", F.lit("local").alias("method"))


def compact_subtopics(topic_turns: DataFrame, parts: DataFrame, chunks: DataFrame, config: EngineConfig = EngineConfig(), summaries: DataFrame | None = None, compacted: DataFrame | None = None) -> DataFrame:
    """New rows of topic_compactions for sessions whose older turns are all of the current topic.

    parts are the older turns' sub-topics, chunks their time chunks, which serve where a topic has one sub-topic only. The current
    one and those of one turn stay; earliest first, until the target is met.
    """
    summaries = _or_empty(summaries, topic_turns, SUMMARIES)
    compacted = _or_empty(compacted, topic_turns, TOPIC_COMPACTIONS)
    old = relevant(topic_turns, config).filter("not recent")
    alone = old.groupBy("session_id").agg(F.count_distinct("topic_id").alias("k"), F.bool_and(same_topic()).alias("same")).filter("k = 1 and same").select("session_id")
    old = old.join(alone, "session_id", "left_semi")
    many = parts.groupBy("session_id", "topic_id").count().filter("count > 1").select("session_id", "topic_id")
    use = parts.join(many, ["session_id", "topic_id"], "left_semi").unionByName(chunks.join(many, ["session_id", "topic_id"], "left_anti"))
    member = use.select("session_id", "topic_id", "subtopic_id", F.col("label").alias("part_label"), "is_current", F.explode("turn_sequences").alias("seq"))
    rows = old.drop("is_current").join(member, ["session_id", "topic_id", "seq"])
    groups = _summed(rows, ["topic_id", "label", "subtopic_id", "part_label", "is_current"], F.col("part_label"), summaries)
    done = compacted.filter("kind = 'subtopic'").select("session_id", "topic_id", "subtopic_id", F.lit(True).alias("_done"))
    groups = groups.join(done, ["session_id", "topic_id", "subtopic_id"], "left")
    groups = groups.withColumns({"_all": F.sum("original_tokens").over(Window.partitionBy("session_id")), "eligible": F.col("_done").isNull() & ~F.col("is_current") & (F.col("turn_count") >= 2)})
    out = _until(groups, ["session_id"], config.topic_target)
    return out.select("session_id", F.lit("subtopic").alias("kind"), "topic_id", "subtopic_id", F.concat("label", F.lit(" > "), "part_label").alias("label"), "summary", "summary_tokens", "turn_count", "turn_ids", "original_tokens", F.lit("local").alias("method"))
