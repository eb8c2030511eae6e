"""Hooks for a model: a callable that summarises, over partitions in batches, with a local text where it fails."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from turnlake.functions import content as C
from turnlake.operators import turns as Q

Summarizer = Callable[[str, str], str]
#: Seconds that a model's answer may take.
TIMEOUT = 30.0


def timed(model: Callable[..., str], *given: str, timeout: float = TIMEOUT) -> str:
    """model(*given), or TimeoutError after so many seconds; a call that takes longer goes on in a thread of its own, unheeded."""
    pool = ThreadPoolExecutor(1)
    try:
        return pool.submit(model, *given).result(timeout)
    finally:
        pool.shutdown(wait=False, cancel_futures=True)


def summarize(rows: DataFrame, summarizer: Summarizer, text_col: str, hint_col: str, retries: int = 1, timeout: float = TIMEOUT, input_col: str | None = None) -> DataFrame:
    """rows with text_col replaced by summarizer(text, hint) and method "llm"; where all tries fail, the text stays and method is "local".

    input_col, if named, is what the summarizer is given in place of the text; null stands for the text.

    Calls run once per row on the executors; write the result before using it twice, for a model may answer otherwise again.
    """
    source = rows.drop("method")
    schema = StructType([*source.schema.fields, StructField("method", StringType())])

    def one(text: str, given: str | None, hint: str) -> tuple[str, str]:
        for _ in range(retries + 1):
            try:
                return timed(summarizer, text if given is None else given, hint, timeout=timeout), "llm"
            except Exception:
                logging.getLogger(__name__).warning("summary failed for %s", hint, exc_info=True)
        return text, "local"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            got = [one(t, g, h) for t, g, h in zip(batch[text_col], batch[input_col or text_col], batch[hint_col])]
            yield batch.assign(**{text_col: [g[0] for g in got], "method": [g[1] for g in got]})

    return source.mapInPandas(run, schema)


def ask(rows: DataFrame, model: Callable[[str], str], prompt_col: str = "prompt", out_col: str = "response", timeout: float = TIMEOUT) -> DataFrame:
    """rows with out_col, the model's answer to prompt_col; null where it fails."""
    source = rows.drop(out_col)
    schema = StructType([*source.schema.fields, StructField(out_col, StringType())])

    def one(prompt: str) -> str | None:
        try:
            return timed(model, prompt, timeout=timeout)
        except Exception:
            logging.getLogger(__name__).warning("no answer", exc_info=True)
            return None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(**{out_col: pd.Series([one(p) for p in batch[prompt_col]], dtype=object)})

    return source.mapInPandas(run, schema)


def _turn_line(size: int) -> Column:
    tools = F.when(F.size("tools_used") > 0, F.concat(F.lit(" ["), F.array_join("tools_used", ", "), F.lit("]"))).otherwise("")
    return F.concat(F.lit("Turn "), F.col("seq").cast("string"), F.lit(" | user: "), F.substring("user_preview", 1, size), F.lit(" | assistant: "), F.substring("assistant_preview", 1, size), tools)


def boundary_prompts(turn_rows: DataFrame, found: DataFrame) -> DataFrame:
    """(session_id, seq, prompt): asks whether the topic changes at a boundary, with two turns of either side."""
    near = found.select("session_id", F.col("seq").alias("at"), F.explode(F.sequence(F.col("seq") - 2, F.col("seq") + 1)).alias("seq"))
    rows = near.join(turn_rows, ["session_id", "seq"]).withColumn("_l", _turn_line(150))
    side = lambda c: F.array_join(F.transform(F.sort_array(F.collect_list(F.when(c, F.struct("seq", "_l")))), lambda x: x["_l"]), "\n")
    out = rows.groupBy("session_id", "at").agg(side(F.col("seq") < F.col("at")).alias("a"), side(F.col("seq") >= F.col("at")).alias("b"))
    ask_ = 'Is this a change of topic? Answer in JSON: {"isBoundary": bool, "prevTopicLabel": text, "nextTopicLabel": text}, labels of three to eight words.'
    return out.select("session_id", F.col("at").alias("seq"), F.concat_ws("\n", F.lit("Earlier:"), "a", F.lit("Later:"), "b", F.lit(ask_)).alias("prompt"))


def subtopic_prompts(topic_turns: DataFrame) -> DataFrame:
    """(session_id, topic_id, n_turns, prompt): asks for groups of neighbouring turns of topics of more than two turns."""
    rows = topic_turns.withColumn("_l", _turn_line(100)).groupBy("session_id", "topic_id").agg(F.sort_array(F.collect_list(F.struct("seq", "_l"))).alias("g")).filter(F.size("g") > 2)
    ask_ = 'Divide these turns of one topic into sub-topics of neighbouring turns, two or more each. Answer in JSON: [{"label": text, "turns": [numbers]}, ...]'
    return rows.select("session_id", "topic_id", F.size("g").alias("n_turns"), F.concat_ws("\n", F.array_join(F.transform("g", lambda x: x["_l"]), "\n"), F.lit(ask_)).alias("prompt"))


def class_prompts(topic_turns: DataFrame) -> DataFrame:
    """(session_id, seq, prompt): asks for a turn's sub-topic, given its topic's label."""
    ask_ = 'Which sub-topic is it? Answer in JSON: {"subtopic": text, "isNewSubtopic": bool}'
    return topic_turns.select("session_id", "seq", F.concat_ws("\n", F.concat(F.lit("Topic: "), "label"), _turn_line(150), F.lit(ask_)).alias("prompt"))


def compact_inputs(lines: DataFrame, turn_rows: DataFrame, tool_results: DataFrame | None = None) -> DataFrame:
    """(session_id, seq, turn_id, text): what a model is given of a turn to summarise: its messages in order, a block each, tool results
    in their truncated form where there is one, assistants' tool calls with their arguments.
    """
    from turnlake.operators import assemble as A

    rows = turn_rows.select("session_id", "seq", "turn_id", "message_count", F.size("tools_used").alias("n_tools"))
    placed = Q.with_turn(C.with_parts(lines)).withColumn("msg_idx", F.row_number().over(Window.partitionBy("session_id", "seq").orderBy("line")) - 1)
    told = placed.join(rows, ["session_id", "seq"])
    cut = A._or_empty(tool_results, lines, A.TOOL_RESULTS).select("session_id", "turn_id", "msg_idx", "truncated_content")
    told = told.join(cut, ["session_id", "turn_id", "msg_idx"], "left")
    text, name = F.coalesce("text", F.lit("")), F.coalesce(F.nullif(F.col("tool_name"), F.lit("")), F.lit("?"))
    said = F.when(text != "", F.concat(F.lit("[Assistant]: "), text))
    called = F.when(F.size("call_texts") > 0, F.concat(F.lit("[ToolCalls]: "), F.array_join("call_texts", ", ")))
    result = F.concat(F.lit("[Tool "), name, F.when(F.col("is_error"), " ❌ ERROR").otherwise(""), F.lit("]: "), F.coalesce("truncated_content", text))
    block = F.when(F.col("raw_role") == "user", F.concat(F.lit("[User]: "), text)).when(F.col("raw_role") == "assistant", F.nullif(F.concat_ws("\n", said, called), F.lit(""))).when(F.col("raw_role") == "toolResult", result)
    grouped = told.withColumn("_b", block).groupBy("session_id", "seq", "turn_id").agg(F.first("message_count").alias("m"), F.first("n_tools").alias("k"), F.sort_array(F.collect_list(F.when(F.col("_b").isNotNull(), F.struct("line", "_b")))).alias("g"))
    head = F.concat(F.lit("[Turn #"), F.col("seq").cast("string"), F.lit(" | "), F.col("m").cast("string"), F.lit(" messages | "), F.col("k").cast("string"), F.lit(" tools]\n"))
    return grouped.select("session_id", "seq", "turn_id", F.concat(head, F.when(F.size("g") > 0, F.concat(F.lit("\n"), F.array_join(F.transform("g", lambda x: x["_b"]), "\n"))).otherwise("")).alias("text"))


def subtopics_by_model(topic_turns: DataFrame, responses: DataFrame, fallback: DataFrame) -> DataFrame:
    """Sub-topics by a model's answers (session_id, topic_id, n_turns, response); fallback's where an answer is missing or unsound."""
    from turnlake.functions import answers

    read = responses.select("session_id", "topic_id", answers.groups(F.col("response"), F.col("n_turns")).alias("g")).filter("g is not null")
    each = read.select("session_id", "topic_id", F.size("g").alias("_n"), F.posexplode("g").alias("k", "x"))
    good = each.select("session_id", "topic_id", F.concat(F.lit("subtopic-"), F.col("k").cast("string")).alias("subtopic_id"), F.col("x.label").alias("label"), F.col("x.turns").alias("turn_sequences"), (F.col("k") == F.col("_n") - 1).alias("is_current"), F.lit("llm").alias("method"))
    rest = fallback.join(read.select("session_id", "topic_id"), ["session_id", "topic_id"], "left_anti").withColumn("method", F.lit("heuristic"))
    return good.unionByName(rest)
