"""Registered queries and their SQL: name to callable (spark, sf_dir), name to DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnlake import stores
from turnlake.config import ContextConfig, EngineConfig
from turnlake.functions import text as T
from turnlake.operators import assemble as A
from turnlake.operators import prune as P
from turnlake.operators import topics as G
from turnlake.operators import turns as Q
from turnlake.operators.summarize import compact_inputs as inputs
from turnlake.operators.summarize import subtopics_by_model
from turnlake.plans import sql as S
from turnlake.plans.engine import Engine
from turnlake.sources import jsonl
from turnlake.sources import messages as M
from turnlake.stores import materialise
from turnlake.streaming import ingest

QUERIES: dict = {}
SQL: dict[str, str] = {}

#: Budgets under which the bindings' sessions lie on both sides of the threshold.
CONV10 = EngineConfig(max_context_tokens=1300, system_prompt_reserve=500)
TOOLTALK = EngineConfig(max_context_tokens=5000, system_prompt_reserve=1000, tool_result_truncate_chars=1000)
CTX = ContextConfig(preserve_recent_messages=1)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/conversations.parquet")


# Scalar functions ----------------------------------------------------------------------------------------------------------


@query(f"SELECT doc_id, {S.tokens('text')} AS tokens FROM documents")
def token_estimate_docs(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", T.tokens(F.col("text")).alias("tokens"))


_SENT = "Sender (untrusted metadata):\n```json\n{\"label\": \"x\"}\n```\n\n[Tue 2026-04-28 10:06 GMT+8] "


@query(f"SELECT conv_id, turn, {S.strip('t')} AS stripped, {S.strip('t', True)} AS stripped_internal FROM (SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN {S.q(_SENT)} || text WHEN 1 THEN '[Tue 2026-04-28 10:06 GMT+8]  ' || text ELSE text END AS t FROM conversations)")
def strip_metadata(spark, sf_dir):
    t = F.when(F.col("turn") % 3 == 0, F.concat(F.lit(_SENT), "text")).when(F.col("turn") % 3 == 1, F.concat(F.lit("[Tue 2026-04-28 10:06 GMT+8]  "), "text")).otherwise(F.col("text"))
    return conversations(spark, sf_dir).select("conv_id", "turn", t.alias("t")).select("conv_id", "turn", T.strip_sender(F.col("t")).alias("stripped"), T.strip_metadata(F.col("t")).alias("stripped_internal"))


@query(f"SELECT term, count(*) AS uses, count(DISTINCT doc_id) AS docs FROM (SELECT doc_id, unnest({S.terms('text')}) AS term FROM documents) GROUP BY term")
def tokenize_terms(spark, sf_dir):
    rows = docs(spark, sf_dir).select("doc_id", F.explode(T.terms(F.col("text"))).alias("term")).groupBy("term", "doc_id").count()
    return rows.groupBy("term").agg(F.sum("count").alias("uses"), F.count("*").alias("docs"))


_MARKED = "CASE WHEN doc_id % 3 = 0 THEN text || '}' ELSE text END"


@query(f"WITH src AS (SELECT doc_id, {_MARKED} AS t FROM documents) SELECT doc_id, truncated, {S.tokens('truncated')} AS tokens FROM ({S.truncate('t', 1000)})")
def truncate_head_tail(spark, sf_dir):
    t = F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit("}"))).otherwise(F.col("text"))
    return docs(spark, sf_dir).select("doc_id", T.truncate(t, 1000).alias("truncated")).withColumn("tokens", T.tokens(F.col("truncated")))


@query("SELECT doc_id, CASE WHEN length(text) <= 800 THEN text ELSE left(text, 480) || chr(10) || chr(10) || '... [' || (length(text) - 720) || ' chars omitted, ~' || floor((length(text) - 720) / 4.0 + 0.5)::BIGINT || ' tokens] ...' || chr(10) || chr(10) || right(text, 240) END AS truncated FROM documents")
def truncate_by_tokens(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", T.truncate_by_tokens(F.col("text"), 200).alias("truncated"))


_SENTENCE = S.trim("regexp_split_to_array(text, '[.!?。！？' || chr(10) || ']')[1]")


@query(f"SELECT conv_id, turn, {_SENTENCE} AS sentence FROM conversations")
def first_sentence(spark, sf_dir):
    return conversations(spark, sf_dir).select("conv_id", "turn", T.first_sentence(F.col("text")).alias("sentence"))


# Turns ---------------------------------------------------------------------------------------------------------------------

_TURN = ["session_id", "seq", "turn_id", "line_start", "line_end", "message_count", "tool_call_count", "total_tokens", "user_tokens", "assistant_tokens", "tool_result_tokens", "user_preview", "assistant_preview", "has_error", "importance"]


def _turns(binding: str, name: str, columns: str = ", ".join(_TURN)):
    @query(S.select(S.turns(binding), f"SELECT {columns}, array_to_string(tools_used, ',') AS tools FROM turns"))
    def run(spark, sf_dir):
        return Q.turns(getattr(M, binding)(spark, sf_dir)).select(*_TURN, F.array_join("tools_used", ",").alias("tools"))

    QUERIES[name], SQL[name] = QUERIES.pop("run"), SQL.pop("run")


_turns("conv", "turn_index")
_turns("conv10", "turn_index_long")
_turns("tooltalk", "turn_index_tools")
_turns("events30", "turn_index_events")


@query(S.select(S.turns("events30"), "SELECT session_id, seq, importance FROM turns"))
def turn_importance(spark, sf_dir):
    return Q.turns(M.events30(spark, sf_dir)).select("session_id", "seq", "importance")


@query(S.select(S.turns("events30"), "SELECT session_id, seq, unnest(tools_used) AS tool, generate_subscripts(tools_used, 1)::INTEGER AS place FROM turns"))
def tools_used(spark, sf_dir):
    return Q.turns(M.events30(spark, sf_dir)).select("session_id", "seq", F.posexplode("tools_used").alias("p", "tool")).select("session_id", "seq", "tool", (F.col("p") + 1).alias("place"))


_STATS = "SELECT session_id, count(*) AS total_turns, sum(total_tokens)::BIGINT AS total_tokens, sum(message_count)::BIGINT AS total_messages, sum(len(tools_used))::BIGINT AS total_tool_calls FROM turns GROUP BY session_id"


@query(S.select(S.turns("conv"), f"SELECT l.session_id, l.n AS total_lines, coalesce(total_turns, 0) AS total_turns, coalesce(total_tokens, 0) AS total_tokens, coalesce(total_messages, 0) AS total_messages, coalesce(total_tool_calls, 0) AS total_tool_calls FROM (SELECT session_id, max(line)::BIGINT AS n FROM lines GROUP BY session_id) l LEFT JOIN ({_STATS}) s USING (session_id)"))
def session_stats(spark, sf_dir):
    lines = M.conv(spark, sf_dir)
    return Q.session_stats(Q.turns(lines), lines)


@query(S.select(S.turns("events30"), "SELECT session_id, tool, count(*) AS turns FROM (SELECT session_id, unnest(tools_used) AS tool FROM turns) GROUP BY ALL"))
def tool_usage(spark, sf_dir):
    return Q.tool_usage(Q.turns(M.events30(spark, sf_dir)))


@query(S.select(S.turns("conv10"), "SELECT session_id, seq, turn_id FROM turns WHERE seq >= n_turns - 5"))
def recent_turns(spark, sf_dir):
    return Q.recent(Q.turns(M.conv10(spark, sf_dir)), 5).select("session_id", "seq", "turn_id")


@query(S.select(S.turns("conv10"), "SELECT session_id, seq, turn_id, total_tokens FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY total_tokens DESC, seq) AS r FROM turns) WHERE r <= 10"))
def largest_turns(spark, sf_dir):
    return Q.largest(Q.turns(M.conv10(spark, sf_dir)), 10).select("session_id", "seq", "turn_id", "total_tokens")


@query(S.select(S.turns("events30"), "SELECT session_id, seq, turn_id FROM turns WHERE list_contains(tools_used, 'exec')"))
def turns_by_tool(spark, sf_dir):
    return Q.by_tool(Q.turns(M.events30(spark, sf_dir)), "exec").select("session_id", "seq", "turn_id")


@query(S.select(S.turns("conv10"), "SELECT session_id, seq, turn_id, line_start, line_end FROM turns WHERE turn_id = 'c3-t1' OR seq = 2"))
def turn_lookup(spark, sf_dir):
    t = Q.turns(M.conv10(spark, sf_dir))
    columns = ["session_id", "seq", "turn_id", "line_start", "line_end"]
    return Q.lookup(t, turn_id="c3-t1").select(columns).union(Q.lookup(t, seq=2).select(columns)).distinct()


@query(S.select(S.turns("tooltalk"), "SELECT l.session_id, l.line, l.text AS raw, t.turn_id, t.seq FROM lines l JOIN turns t ON l.session_id = t.session_id AND l.line BETWEEN t.line_start AND t.line_end"))
def recover_turn_lines(spark, sf_dir):
    lines = M.tooltalk(spark, sf_dir)
    return Q.recover(lines.select("session_id", "line", "text"), Q.turns(lines)).select("session_id", "line", F.col("text").alias("raw"), "turn_id", "seq")


@query(S.select(S.turns("conv10"), "SELECT session_id, seq, importance, row_number() OVER (PARTITION BY session_id ORDER BY importance, seq)::INTEGER AS \"order\" FROM turns WHERE seq < n_turns - 5"))
def compressible_turns(spark, sf_dir):
    return Q.compressible(Q.turns(M.conv10(spark, sf_dir))).select("session_id", "seq", "importance", "order")


@query(S.select([*S.turns("conv10"), "c AS (SELECT *, floor(total_tokens * 0.85::DOUBLE)::BIGINT AS savings FROM (SELECT *, sum(total_tokens) OVER (PARTITION BY session_id) AS total FROM turns) WHERE seq < n_turns - 5)", "r AS (SELECT *, coalesce(sum(savings) OVER (PARTITION BY session_id ORDER BY importance, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM c)"], "SELECT session_id, seq, savings FROM r WHERE total > 3000 AND before < total - 3000"))
def recommend_compression(spark, sf_dir):
    return Q.recommend(Q.turns(M.conv10(spark, sf_dir)), 3000).select("session_id", "seq", "savings")


@query(S.select(S.turns("conv10"), f"SELECT session_id, count(*) AS turns, sum(total_tokens)::BIGINT AS tokens, sum(total_tokens) > {CONV10.threshold} AS needs_compaction FROM turns GROUP BY session_id"))
def needs_compaction(spark, sf_dir):
    return A.needs_compaction(Q.turns(M.conv10(spark, sf_dir)), CONV10)


# Topics --------------------------------------------------------------------------------------------------------------------


@query(S.select(S.similarities("conv10"), "SELECT session_id, seq, term, df, round(tf, 9) AS tf, round(weight, 9) AS weight FROM tfidf"))
def tfidf_weights(spark, sf_dir):
    return G.tfidf(Q.turns(M.conv10(spark, sf_dir))).select("session_id", "seq", "term", "df", F.round("tf", 9).alias("tf"), F.round("weight", 9).alias("weight"))


@query(S.select(S.similarities("conv10"), "SELECT session_id, seq, round(similarity, 9) AS similarity FROM sims"))
def window_similarity(spark, sf_dir):
    return G.similarities(Q.turns(M.conv10(spark, sf_dir))).select("session_id", "seq", F.round("similarity", 9).alias("similarity"))


@query(S.select(S.similarities("conv10"), "SELECT session_id, seq, 'embedding' AS method, round(least(1.0, 1 - similarity / 0.05), 7) AS confidence FROM sims WHERE round(similarity, 12) < 0.05"))
def topic_boundaries(spark, sf_dir):
    return G.boundaries(Q.turns(M.conv10(spark, sf_dir))).select("session_id", "seq", "method", F.round("confidence", 7).alias("confidence"))


def _topic_turns(spark, sf_dir, binding):
    """Turns with topics, written once, as the steps after them read them several times."""
    t = materialise(Q.turns(getattr(M, binding)(spark, sf_dir)), "turns")
    return materialise(G.with_topics(t, G.segments(t)), "topics")


@query(S.select(S.topics("conv10"), "SELECT session_id, seq, topic_ord::INTEGER AS topic_ord, topic_id, label, is_current FROM tturns"))
def topic_segments(spark, sf_dir):
    return _topic_turns(spark, sf_dir, "conv10").select("session_id", "seq", "topic_ord", "topic_id", "label", "is_current")


@query(S.select(S.topics("tooltalk"), "SELECT session_id, topic_id, any_value(label) AS label FROM tturns GROUP BY session_id, topic_id"))
def topic_labels(spark, sf_dir):
    return G.topics(_topic_turns(spark, sf_dir, "tooltalk")).select("session_id", "topic_id", "label")


@query(S.select(S.topics("conv10"), "SELECT session_id, topic_id, any_value(label) AS label, sum(total_tokens)::BIGINT AS total_tokens, count(*) AS turn_count, string_agg(turn_id, ',' ORDER BY seq) AS turn_ids, 'active' AS status FROM tturns GROUP BY session_id, topic_id"))
def topic_totals(spark, sf_dir):
    return G.topics(_topic_turns(spark, sf_dir, "conv10")).select("session_id", "topic_id", "label", "total_tokens", "turn_count", F.array_join("turn_ids", ",").alias("turn_ids"), "status")


_ANSWERS = """CASE seq % 4 WHEN 0 THEN '{"isBoundary": true, "prevTopicLabel": "a", "nextTopicLabel": "b"}' WHEN 1 THEN 'Sure: {"isBoundary": false, "prevTopicLabel": "a", "nextTopicLabel": "a"} .' WHEN 2 THEN 'no idea' END"""


@query(S.select(S.similarities("conv10"), "SELECT session_id, seq, CASE seq % 4 WHEN 0 THEN 'llm' ELSE 'embedding' END AS method, round(CASE seq % 4 WHEN 0 THEN greatest(0.9, 1 - similarity / 0.05) ELSE 1 - similarity / 0.05 END, 7) AS confidence, CASE seq % 4 WHEN 0 THEN 'b' END AS next_label FROM sims WHERE round(similarity, 12) < 0.05 AND seq % 4 <> 1"))
def boundary_confirm(spark, sf_dir):
    found = G.boundaries(Q.turns(M.conv10(spark, sf_dir)))
    return G.confirm(found, found.select("session_id", "seq", F.expr(_ANSWERS).alias("response"))).select("session_id", "seq", "method", F.round("confidence", 7).alias("confidence"), "next_label")


def _all_one(spark, sf_dir, binding="events30"):
    return Q.turns(getattr(M, binding)(spark, sf_dir)).withColumn("topic_id", F.lit("all"))


@query(S.select(S.subtopics("events30"), "SELECT session_id, topic_id, seq, score FROM scored WHERE seq > 0"))
def subtopic_signals(spark, sf_dir):
    return G.signals(_all_one(spark, sf_dir))


@query(S.select(S.subtopics("events30"), "SELECT g.session_id, g.topic_id, 'subtopic-' || g.ord AS subtopic_id, CASE WHEN left(t.user_preview, 40) <> '' THEN left(t.user_preview, 40) WHEN t.n_turns <= 2 THEN 'conversation' ELSE 'Sub-topic ' || (g.ord + 1) END AS label, g.start AS first_seq, g.size::INTEGER AS turns, g.part = g.parts AS is_current FROM sub g JOIN turns t ON g.session_id = t.session_id AND g.start = t.seq"))
def subtopics_heuristic(spark, sf_dir):
    return G.subtopics(_all_one(spark, sf_dir)).select("session_id", "topic_id", "subtopic_id", "label", F.element_at("turn_sequences", 1).alias("first_seq"), F.size("turn_sequences").alias("turns"), "is_current")


@query(S.select(S.turns("events30"), "SELECT session_id, 'chunk-' || (seq // 5) AS subtopic_id, 'Turns ' || min(seq) || '-' || max(seq) AS label, count(*)::INTEGER AS turns, (seq // 5 + 1) * 5 >= any_value(n_turns) AS is_current FROM turns GROUP BY session_id, seq // 5"))
def time_chunks(spark, sf_dir):
    return G.time_chunks(_all_one(spark, sf_dir)).select("session_id", "subtopic_id", "label", F.size("turn_sequences").alias("turns"), "is_current")


_CLASS = """CASE seq % 5 WHEN 0 THEN concat('{"subtopic": "s', seq, '", "isNewSubtopic": true}') WHEN 3 THEN 'what?' ELSE concat('Answer {"subtopic": "t', seq, '", "isNewSubtopic": false}') END"""


@query(S.select([*S.turns("conv10"), "c AS (SELECT *, seq % 5 = 0 AS opens FROM turns WHERE seq % 5 <> 3)"], "SELECT session_id, seq, 'all-sub-' || (sum(opens::INTEGER) OVER (PARTITION BY session_id ORDER BY seq) - 1)::BIGINT AS subtopic_id, 's' || (seq - seq % 5) AS subtopic_label FROM c"))
def turn_classify_state(spark, sf_dir):
    rows = _all_one(spark, sf_dir, "conv10")
    return G.classified(rows, rows.select("session_id", "seq", F.expr(_CLASS).alias("response"))).select("session_id", "seq", "subtopic_id", "subtopic_label")


# Flat contexts -------------------------------------------------------------------------------------------------------------

_CTX = [f"m AS (SELECT conv_id::VARCHAR AS session_id, turn::INTEGER AS idx, role, text AS content, {S.tokens('text')} AS tokens, turn = 1 AND conv_id % 10 = 0 AS pinned FROM conversations)", "x AS (SELECT *, count(*) OVER s AS n, sum(tokens) OVER s AS total, floor(sum(tokens) OVER s / 2) AS target FROM m WINDOW s AS (PARTITION BY session_id))", "y AS (SELECT *, pinned OR role = 'system' OR idx >= n - 1 AS safe FROM x)"]


def _half(m: DataFrame):
    return F.floor(F.sum("token_count").over(Window.partitionBy("session_id")) / 2)


def _pruned(spark, sf_dir, strategy):
    m = M.context_messages(spark, sf_dir)
    return P.prune(m, _half(m), strategy, CTX).select("session_id", "idx", "pruned")


@query(S.select(_CTX, "SELECT session_id, idx, NOT safe AND total - coalesce(sum(CASE WHEN safe THEN 0 ELSE tokens END) OVER (PARTITION BY session_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) > target AS pruned FROM y"))
def prune_fifo(spark, sf_dir):
    return _pruned(spark, sf_dir, "fifo")


@query(S.select([*_CTX, "z AS (SELECT *, CASE role WHEN 'system' THEN 100 WHEN 'user' THEN 30 WHEN 'assistant' THEN 20 WHEN 'tool' THEN 10 ELSE 15 END + idx / greatest(1, n - 1)::DOUBLE * 50 + CASE WHEN pinned THEN 1000 ELSE 0 END AS score FROM y)"], "SELECT session_id, idx, NOT safe AND coalesce(sum(CASE WHEN safe THEN 0 ELSE tokens END) OVER (PARTITION BY session_id ORDER BY score, idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < total - target AS pruned FROM z"))
def prune_importance(spark, sf_dir):
    return _pruned(spark, sf_dir, "importance")


@query(S.select([*_CTX, "k AS (SELECT *, pinned OR role = 'system' AS held FROM x)", "b AS (SELECT session_id, idx, tokens, row_number() OVER (PARTITION BY session_id ORDER BY idx DESC) AS r FROM k WHERE NOT held)", "s AS (SELECT session_id, 0::BIGINT AS r, -1 AS idx, false AS kept, (any_value(target) - coalesce(sum(tokens) FILTER (held), 0))::DOUBLE AS room FROM k GROUP BY session_id UNION ALL SELECT s.session_id, b.r, b.idx, s.room >= b.tokens, CASE WHEN s.room >= b.tokens THEN s.room - b.tokens ELSE s.room END FROM s JOIN b ON s.session_id = b.session_id AND b.r = s.r + 1)"], "SELECT k.session_id, k.idx, total > target AND NOT held AND NOT coalesce(kept, false) AS pruned FROM k LEFT JOIN s ON k.session_id = s.session_id AND k.idx = s.idx"))
def prune_sliding_window(spark, sf_dir):
    return _pruned(spark, sf_dir, "sliding-window")


@query(S.select(_CTX, "SELECT session_id, role, count(*) AS messages, sum(tokens)::BIGINT AS tokens, count(*) FILTER (pinned) AS pinned FROM m GROUP BY session_id, role"))
def context_stats(spark, sf_dir):
    return P.stats(M.context_messages(spark, sf_dir))


@query(S.select(_CTX, "SELECT session_id, count(*) AS messages, sum(tokens)::BIGINT AS tokens, round(sum(tokens) / 500.0::DOUBLE, 9) AS usage, sum(tokens) / 500.0::DOUBLE >= 0.8::DOUBLE AS near_limit, sum(tokens) > 500 AS over_limit FROM m GROUP BY session_id"))
def context_window(spark, sf_dir):
    return P.window(M.context_messages(spark, sf_dir), ContextConfig(max_tokens=500)).withColumn("usage", F.round("usage", 9))


@query(S.select(_CTX, "SELECT session_id, idx, CASE WHEN idx = 2 THEN true WHEN idx = 1 THEN false ELSE pinned END AS pinned FROM m"))
def context_pin(spark, sf_dir):
    m = M.context_messages(spark, sf_dir)
    marks = m.filter("idx in (1, 2)").select("session_id", "idx", (F.col("idx") == 2).alias("pin"))
    return P.pin(m, marks).select("session_id", "idx", "pinned")


_FIRST = S.trim("regexp_split_to_array(content, '[.!?。！？' || chr(10) || ']')[1]")


@query(S.select([*_CTX, f"p AS (SELECT session_id, idx, tokens, CASE WHEN role IN ('user', 'assistant') AND length({_FIRST}) > 10 THEN '[' || role || '] ' || {_FIRST} END AS p FROM m)", "g AS (SELECT session_id, count(*) AS original_messages, sum(tokens)::BIGINT AS original_tokens, list(p ORDER BY idx) FILTER (p IS NOT NULL) AS l FROM p GROUP BY session_id)", "o AS (SELECT session_id, original_messages, original_tokens, CASE WHEN len(l) > 0 THEN 'Context summary (' || original_messages || ' messages):' || chr(10) || array_to_string(l[:20], chr(10)) ELSE 'Context summary: ' || original_messages || ' messages exchanged.' END AS content FROM g)"], f"SELECT *, {S.tokens('content')} AS tokens FROM o"))
def local_summary(spark, sf_dir):
    return P.local_summary(M.context_messages(spark, sf_dir))


# Compaction and assembly ---------------------------------------------------------------------------------------------------

_SUMMARY = "concat_ws(chr(10), 'User: ' || user_preview, CASE WHEN len(tools_used) > 0 THEN 'Tools: ' || array_to_string(tools_used, ', ') END, CASE WHEN assistant_preview <> '' THEN 'Assistant: ' || assistant_preview END, CASE WHEN has_error THEN '⚠️ This turn had tool errors' END, '(' || message_count || ' messages, lines ' || line_start || '-' || line_end || ')')"
_BIG = f"big AS (SELECT session_id, turn_id, summary, {S.tokens('summary')} AS tokens, total_tokens AS original_tokens FROM (SELECT *, {_SUMMARY} AS summary, row_number() OVER (PARTITION BY session_id ORDER BY total_tokens DESC, seq) AS r FROM turns WHERE seq < n_turns - 5) WHERE r <= 3)"


@query(S.select(S.turns("events30"), f"SELECT session_id, seq, {_SUMMARY} AS summary FROM turns"))
def local_turn_summary(spark, sf_dir):
    return Q.turns(M.events30(spark, sf_dir)).select("session_id", "seq", A.turn_summary().alias("summary"))


@query(S.select([*S.turns("conv10"), _BIG], "SELECT session_id, turn_id, summary, tokens, original_tokens FROM big"))
def compact_top_n(spark, sf_dir):
    return A.compact(Q.turns(M.conv10(spark, sf_dir)), CONV10).drop("method")


_MARKED_TURNS = "mt AS (SELECT *, seq >= n_turns - 5 AS recent, last_value(topic_id) OVER w AS cur, max(topic_ord) OVER w + 1 AS n_topics FROM tturns WINDOW w AS (PARTITION BY session_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))"
_PLACED = "pm AS (SELECT *, row_number() OVER (PARTITION BY session_id, seq ORDER BY line) - 1 AS msg_idx FROM placed)"
_CONTEXT = f"""ctx AS (
SELECT m.session_id, 1 AS phase, m.seq AS ord, 0 AS sub_ord, 'user' AS role, '[Summary of turn #' || m.seq || ']: ' || b.summary AS content, b.tokens FROM mt m JOIN big b USING (session_id, turn_id) WHERE NOT recent AND (topic_id = cur OR n_topics <= 1)
UNION ALL SELECT p.session_id, 1, p.seq, p.msg_idx::INTEGER, CASE p.raw_role WHEN 'toolResult' THEN 'tool' ELSE p.raw_role END, p.text, {S.tokens('p.text')} FROM pm p JOIN mt m USING (session_id, seq) LEFT JOIN big b ON b.session_id = m.session_id AND b.turn_id = m.turn_id WHERE NOT recent AND (topic_id = cur OR n_topics <= 1) AND b.turn_id IS NULL AND (p.raw_role IN ('user', 'toolResult') OR (p.raw_role = 'assistant' AND p.text <> ''))
UNION ALL SELECT p.session_id, 2, p.seq, p.msg_idx::INTEGER, p.raw_role, p.text, {S.tokens('p.text')} FROM pm p JOIN mt m USING (session_id, seq) WHERE recent)"""
_NO_SUMMARIES = "big AS (SELECT ''::VARCHAR AS session_id, ''::VARCHAR AS turn_id, ''::VARCHAR AS summary, 0::BIGINT AS tokens WHERE false)"


@query(S.select([*S.topics("conv10"), _BIG, _MARKED_TURNS, _PLACED, _CONTEXT], "SELECT session_id, phase, ord, sub_ord, role, content, tokens FROM ctx"))
def assemble_messages(spark, sf_dir):
    t = _topic_turns(spark, sf_dir, "conv10")
    return A.assemble(M.conv10(spark, sf_dir), t, CONV10, summaries=A.compact(t, CONV10)).drop("tool_name", "parts")


@query(S.select([*S.topics("conv10"), _NO_SUMMARIES, _MARKED_TURNS, _PLACED, _CONTEXT], f"SELECT session_id, count(*) AS messages, sum(tokens)::BIGINT AS tokens, sum(tokens) > {CONV10.threshold} AS over FROM ctx GROUP BY session_id"))
def assemble_token_count(spark, sf_dir):
    return A.used_tokens(A.assemble(M.conv10(spark, sf_dir), _topic_turns(spark, sf_dir, "conv10"), CONV10), CONV10)


_TRUNCATED = [
    f"spent AS (SELECT session_id, sum(tokens) AS used FROM ctx GROUP BY session_id HAVING sum(tokens) > {TOOLTALK.threshold})",
    "src AS (SELECT p.session_id, m.turn_id, m.seq, p.msg_idx, p.text FROM pm p JOIN mt m USING (session_id, seq) JOIN spent u USING (session_id) WHERE NOT recent AND p.raw_role = 'toolResult' AND length(p.text) > 1000)",
    f"cut AS (SELECT *, {S.tokens('text')} - {S.tokens('truncated')} AS saved FROM ({S.truncate('text', 1000)}))",
    "walk AS (SELECT m.session_id, m.seq, u.used - coalesce(sum(coalesce(s, 0)) OVER (PARTITION BY m.session_id ORDER BY m.seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest FROM mt m JOIN spent u USING (session_id) LEFT JOIN (SELECT session_id, seq, sum(saved) AS s FROM cut GROUP BY ALL) c ON c.session_id = m.session_id AND c.seq = m.seq WHERE NOT recent)",
    "goes AS (SELECT *, min(rest) OVER (PARTITION BY session_id ORDER BY seq) AS least FROM walk)",
]


@query(S.select([*S.topics("tooltalk"), _NO_SUMMARIES, _MARKED_TURNS, _PLACED, _CONTEXT, *_TRUNCATED], f"SELECT c.session_id, c.turn_id, c.msg_idx::INTEGER AS msg_idx, c.truncated AS truncated_content, {S.tokens('c.truncated')} AS truncated_tokens, {S.tokens('c.text')} AS original_tokens, length(c.text)::INTEGER AS original_chars FROM cut c JOIN goes g USING (session_id, seq) WHERE g.least > {TOOLTALK.threshold}"))
def precompaction_truncations(spark, sf_dir):
    return _cuts(M.tooltalk(spark, sf_dir), _topic_turns(spark, sf_dir, "tooltalk"))


def _cuts(lines: DataFrame, t: DataFrame) -> DataFrame:
    return A.truncations(lines, t, A.used_tokens(A.assemble(lines, t, TOOLTALK), TOOLTALK), TOOLTALK)


_GROUPS = [
    "grp AS (SELECT session_id, topic_id, any_value(label) AS label, any_value(cur) AS cur, count(*) AS turn_count, min(seq) AS first_seq, sum(total_tokens)::BIGINT AS original_tokens, list('  - User: ' || left(user_preview, 80) || ' → ' || left(assistant_preview, 60) ORDER BY seq) AS pts, list(turn_id ORDER BY seq) AS ids, list(tools_used ORDER BY seq) AS tl FROM mt WHERE NOT recent GROUP BY session_id, topic_id)",
    "tls AS (SELECT session_id, topic_id, list(tool ORDER BY spot) AS tl FROM (SELECT session_id, topic_id, tool, min(spot) AS spot FROM (SELECT session_id, topic_id, unnest(flatten(tl)) AS tool, generate_subscripts(flatten(tl), 1) AS spot FROM grp) GROUP BY ALL) GROUP BY ALL)",
    "sm AS (SELECT g.* EXCLUDE (tl), '## Topic: ' || label || ' (' || turn_count || ' turns)' || chr(10) || CASE WHEN len(t.tl) > 0 THEN chr(10) || 'Tools used: ' || array_to_string(t.tl, ', ') ELSE '' END || chr(10) || chr(10) || 'Key turns:' || chr(10) || array_to_string(pts[:8], chr(10)) || CASE WHEN turn_count > 8 THEN chr(10) || '  - ... and ' || (turn_count - 8) || ' more turns' ELSE '' END AS summary FROM grp g LEFT JOIN tls t USING (session_id, topic_id))",
    f"el AS (SELECT *, {S.tokens('summary')} AS summary_tokens, topic_id <> cur AND turn_count >= 2 AS eligible, sum(original_tokens) OVER (PARTITION BY session_id) AS total FROM sm)",
    "rest AS (SELECT *, total - coalesce(sum(CASE WHEN eligible THEN original_tokens - summary_tokens ELSE 0 END) OVER (PARTITION BY session_id ORDER BY first_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest FROM el)",
    "least AS (SELECT *, min(rest) OVER (PARTITION BY session_id ORDER BY first_seq) AS least FROM rest)",
]


def _topic_compaction(name: str, binding: str, config: EngineConfig):
    @query(S.select([*S.topics(binding), _MARKED_TURNS, *_GROUPS], f"SELECT session_id, topic_id, label, summary, summary_tokens, turn_count, array_to_string(ids, ',') AS turn_ids, original_tokens FROM least WHERE eligible AND least > {config.topic_target}"))
    def run(spark, sf_dir):
        return A.compact_topics(_topic_turns(spark, sf_dir, binding), config).select("session_id", "topic_id", "label", "summary", "summary_tokens", "turn_count", F.array_join("turn_ids", ",").alias("turn_ids"), "original_tokens")

    QUERIES[name], SQL[name] = QUERIES.pop("run"), SQL.pop("run")


_topic_compaction("topic_compaction", "conv10", CONV10)
_topic_compaction("topic_compaction_tools", "tooltalk", TOOLTALK)


# Messages as JSON lines ------------------------------------------------------------------------------------------------------

def json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(session_id, line, raw): conversations written as session files, with a blank and a malformed line in each."""
    c = conversations(spark, sf_dir)
    part = F.to_json(F.struct(F.lit("text").alias("type"), "text"))
    call = F.lit(', {"type": "toolCall", "name": "read", "arguments": {"path": "abcd"}}')
    content = F.when(F.col("role") == "assistant", F.concat(F.lit("["), part, call, F.lit("]"))).otherwise(F.concat(F.lit("["), part, F.lit("]")))
    usage = F.when((F.col("role") == "assistant") & (F.col("turn") % 2 == 0), F.lit(', "usage": {"output": 7}')).otherwise(F.lit(""))
    message = F.concat(F.lit('{"type": "message", "id": "c'), "conv_id", F.lit("-t"), "turn", F.lit('", "timestamp": "2026-01-01T00:00:00Z", "message": {"role": "'), "role", F.lit('", "content": '), content, usage, F.lit("}}"))
    head = F.concat(F.lit('{"type": "session", "id": "s'), "conv_id", F.lit('", "version": 3, "cwd": "/home", "timestamp": "2026-01-01T00:00:00Z"}'))
    model = F.concat(F.lit('{"type": "model_change", "provider": "p", "modelId": "m'), F.col("conv_id") % 3, F.lit('"}'))
    heads = c.filter("turn = 0").select(F.col("conv_id").cast("string").alias("session_id"), F.posexplode(F.array(head, model, F.lit("  "), F.lit("{bad"), F.lit("null"))).alias("k", "raw")).select("session_id", (F.col("k") + 1).alias("line"), "raw")
    return heads.union(c.select(F.col("conv_id").cast("string").alias("session_id"), (F.col("turn") + 6).cast("int").alias("line"), message.alias("raw")))


@query(f"SELECT conv_id::VARCHAR AS session_id, (turn + 6)::INTEGER AS line, 'c' || conv_id || '-t' || turn AS entry_id, role AS raw_role, CASE WHEN role = 'assistant' THEN role ELSE 'user' END AS role, text, CASE WHEN role = 'assistant' THEN CASE WHEN turn % 2 = 0 THEN 7 ELSE {S.tokens('text')} + 4 END ELSE {S.tokens('text')} END::BIGINT AS tokens, CASE WHEN role <> 'assistant' THEN left({S.strip('text')}, 200) END AS user_text, CASE WHEN role = 'assistant' THEN left(text, 200) END AS assistant_text, CASE WHEN role = 'assistant' THEN 'read' END AS tools FROM conversations")
def parse_json_lines(spark, sf_dir):
    rows = jsonl.parse_lines(json_lines(spark, sf_dir)).filter("type = 'message'")
    return rows.select("session_id", "line", "entry_id", "raw_role", "role", "text", "tokens", "user_text", "assistant_text", F.when(F.col("tool_calls").isNotNull(), F.array_join("tool_calls", ",")).alias("tools"))


@query("SELECT conv_id::VARCHAR AS session_id, 's' || conv_id AS meta_session_id, 3.0::DOUBLE AS session_version, '/home' AS cwd, 'p' AS provider, 'm' || (conv_id % 3) AS model_id FROM conversations WHERE turn = 0")
def session_meta(spark, sf_dir):
    return Q.session_meta(jsonl.parse_lines(json_lines(spark, sf_dir)))


@query("""SELECT conv_id::VARCHAR AS session_id, k::INTEGER AS line, CASE k WHEN 2 THEN '{"type": "model_change", "provider": "p", "modelId": "m' || (conv_id % 3) || '"}' WHEN 3 THEN '  ' WHEN 4 THEN '{bad' ELSE 'null' END AS raw FROM conversations, range(2, 6) r(k) WHERE turn = 0
UNION ALL SELECT conv_id::VARCHAR, (turn + 6)::INTEGER, NULL FROM conversations WHERE turn + 6 BETWEEN 6 AND 9""")
def raw_line_range(spark, sf_dir):
    """Lines 2 to 9 of every session; the texts of those that aren't messages."""
    return json_lines(spark, sf_dir).filter(F.col("line").between(2, 9)).select("session_id", "line", F.when(F.col("line") < 6, F.col("raw")).alias("raw"))


@query("SELECT doc_id, CASE WHEN n_chars * 500 >= 1000000 THEN (floor(n_chars * 500 * 10.0::DOUBLE / 1000000 + 0.5) / 10)::DECIMAL(20, 1)::VARCHAR || 'M' WHEN n_chars * 500 >= 1000 THEN (floor(n_chars * 500 * 10.0::DOUBLE / 1000 + 0.5) / 10)::DECIMAL(20, 1)::VARCHAR || 'K' ELSE (n_chars * 500)::VARCHAR END AS shown FROM documents")
def token_count_text(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", T.token_count_text(F.col("n_chars") * 500).alias("shown"))


_CUT = "CASE WHEN length(text) <= 800 THEN text ELSE left(text, 480) || chr(10) || chr(10) || '... [' || (length(text) - 720) || ' chars omitted, ~' || floor((length(text) - 720) / 4.0 + 0.5)::BIGINT || ' tokens] ...' || chr(10) || chr(10) || right(text, 240) END"


@query(f"SELECT conv_id, turn, CASE WHEN role = 'user' THEN {S.strip('text', True)} WHEN role = 'assistant' OR {S.tokens('text')} <= 200 THEN text ELSE {_CUT} END AS content FROM conversations")
def trim_messages(spark, sf_dir):
    return conversations(spark, sf_dir).select("conv_id", "turn", T.trim_message(F.col("role"), F.col("text"), 200).alias("content"))


# More questions to the index -------------------------------------------------------------------------------------------------


@query(S.select(S.turns("conv10"), "SELECT sum(message_count)::BIGINT AS messages FROM turns"))
def bootstrap_messages(spark, sf_dir):
    return spark.createDataFrame([(engine(spark, M.conv10(spark, sf_dir)).bootstrap(),)], "messages bigint")


@query(S.select(S.topics("conv10"), "SELECT session_id, topic_id, seq, turn_id FROM tturns WHERE is_current"))
def current_topic_turns(spark, sf_dir):
    return _topic_turns(spark, sf_dir, "conv10").filter("is_current").select("session_id", "topic_id", "seq", "turn_id")


@query(S.select(S.topics("conv10"), "SELECT session_id, topic_id, label, turn_count, string_agg(turn_id, ',' ORDER BY seq) AS first_turns FROM (SELECT *, count(*) OVER (PARTITION BY session_id, topic_id) AS turn_count, row_number() OVER (PARTITION BY session_id, topic_id ORDER BY seq) AS r FROM tturns) WHERE r <= 5 GROUP BY ALL"))
def topic_report(spark, sf_dir):
    rows = G.topics(_topic_turns(spark, sf_dir, "conv10"))
    return rows.select("session_id", "topic_id", "label", "turn_count", F.array_join(F.slice("turn_ids", 1, 5), ",").alias("first_turns"))


@query(S.select(S.turns("tooltalk"), "SELECT session_id, turn_id, line, raw_role, left(text, 300) AS text FROM placed JOIN (SELECT session_id, seq, turn_id FROM turns WHERE seq = 3) USING (session_id, seq)"))
def recover_turn_messages(spark, sf_dir):
    lines = M.tooltalk(spark, sf_dir)
    rows = Q.recover(lines, Q.lookup(Q.turns(lines), seq=3).select("session_id", "seq", "turn_id", "line_start", "line_end"))
    return rows.filter("role is not null").select("session_id", "turn_id", "line", "raw_role", F.substring("text", 1, 300).alias("text"))


@query(S.select([*S.topics("conv10"), _MARKED_TURNS], "SELECT session_id, seq, topic_id, total_tokens, CASE WHEN recent THEN 'kept' WHEN topic_id = cur OR n_topics <= 1 THEN 'older' ELSE 'dropped' END AS zone FROM mt"))
def assemble_preview(spark, sf_dir):
    rows = A.relevant(_topic_turns(spark, sf_dir, "conv10"), CONV10)
    return rows.select("session_id", "seq", "topic_id", "total_tokens", F.when(F.col("recent"), "kept").when(F.col("relevant"), "older").otherwise("dropped").alias("zone"))


@query(S.select([*S.turns("conv10"), _BIG], "SELECT session_id, count(*) AS compacted, sum(original_tokens - tokens)::BIGINT AS tokens_saved, 0::BIGINT AS cache_hits FROM big GROUP BY session_id"))
def compaction_report(spark, sf_dir):
    rows = Q.turns(M.conv10(spark, sf_dir))
    return A.compaction_report(rows, None, A.compact(rows, CONV10), CONV10).withColumn("cache_hits", F.col("cache_hits").cast("long"))


@query(S.select([*S.topics("tooltalk"), _NO_SUMMARIES, _MARKED_TURNS, _PLACED, _CONTEXT, *_TRUNCATED], f"SELECT c.session_id, count(*) AS entries, count(DISTINCT c.turn_id) AS turns, sum(saved)::BIGINT AS tokens_saved FROM cut c JOIN goes g USING (session_id, seq) WHERE g.least > {TOOLTALK.threshold} GROUP BY c.session_id"))
def tool_result_stats(spark, sf_dir):
    return stores.tool_result_stats(precompaction_truncations(spark, sf_dir))


@query(S.select([*S.topics("conv10"), _MARKED_TURNS, *_GROUPS], f"SELECT session_id, count(*) AS entries, sum(turn_count)::BIGINT AS turns, sum(original_tokens - summary_tokens)::BIGINT AS tokens_saved FROM least WHERE eligible AND least > {CONV10.topic_target} GROUP BY session_id"))
def topic_compaction_stats(spark, sf_dir):
    return stores.topic_compaction_stats(A.compact_topics(_topic_turns(spark, sf_dir, "conv10"), CONV10))


@query(S.select(S.subtopics("events30"), "SELECT g.session_id, g.topic_id, 'subtopic-' || g.ord AS subtopic_id, g.start AS first_seq, g.size::INTEGER AS turns FROM sub g WHERE g.part = g.parts AND g.parts > 1"))
def current_subtopic(spark, sf_dir):
    return G.current_subtopic(G.subtopics(_all_one(spark, sf_dir))).select("session_id", "topic_id", "subtopic_id", F.element_at("turn_sequences", 1).alias("first_seq"), F.size("turn_sequences").alias("turns"))


_PARTS = """CASE WHEN n_turns % 3 = 0 THEN 'none' ELSE concat('```json\\n[{"label": "all", "turns": [', list_, ']}]\\n```') END"""


@query(S.select(S.subtopics("conv10"), """SELECT session_id, 'subtopic-0' AS subtopic_id, 'all' AS label, count(*)::INTEGER AS turns, 'llm' AS method FROM turns WHERE n_turns % 3 <> 0 AND n_turns > 2 GROUP BY session_id
UNION ALL SELECT g.session_id, 'subtopic-' || g.ord, CASE WHEN left(t.user_preview, 40) <> '' THEN left(t.user_preview, 40) WHEN t.n_turns <= 2 THEN 'conversation' ELSE 'Sub-topic ' || (g.ord + 1) END, g.size::INTEGER, 'heuristic' FROM sub g JOIN turns t ON g.session_id = t.session_id AND g.start = t.seq WHERE t.n_turns % 3 = 0 OR t.n_turns <= 2"""))
def subtopics_by_answers(spark, sf_dir):
    rows = _all_one(spark, sf_dir, "conv10")
    asked = rows.groupBy("session_id", "topic_id").agg(F.count("*").alias("n_turns"), F.array_join(F.sort_array(F.collect_list("seq")), ", ").alias("list_")).filter("n_turns > 2")
    return subtopics_by_model(rows, asked.withColumn("response", F.expr(_PARTS)), G.subtopics(rows)).select("session_id", "subtopic_id", "label", F.size("turn_sequences").alias("turns"), "method")


# More of flat contexts -------------------------------------------------------------------------------------------------------


@query(S.select([*_CTX, "e AS (SELECT session_id, max(idx) + 1 AS n FROM m GROUP BY session_id)"], "SELECT session_id, idx, content, tokens AS token_count FROM m UNION ALL SELECT m.session_id, (e.n + row_number() OVER (PARTITION BY m.session_id ORDER BY idx) - 1)::INTEGER, content, tokens FROM m JOIN e USING (session_id) WHERE idx < 2"))
def context_add(spark, sf_dir):
    m = M.context_messages(spark, sf_dir)
    return P.add(m, m.filter("idx < 2").withColumn("token_count", F.lit(0).cast("long"))).select("session_id", "idx", "content", "token_count")


@query(S.select([*_CTX, "f AS (SELECT *, NOT safe AND total - coalesce(sum(CASE WHEN safe THEN 0 ELSE tokens END) OVER (PARTITION BY session_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) > target AS pruned FROM y)"], "SELECT session_id, count(*) FILTER (NOT pruned) AS kept, count(*) FILTER (pruned) AS pruned, coalesce(sum(tokens) FILTER (pruned), 0)::BIGINT AS tokens_saved FROM f GROUP BY session_id"))
def prune_report(spark, sf_dir):
    m = M.context_messages(spark, sf_dir)
    return P.report(P.prune(m, _half(m), "fifo", CTX))


@query(S.select([*_CTX, f"p AS (SELECT session_id, idx, tokens, CASE WHEN role IN ('user', 'assistant') AND length({_FIRST}) > 10 THEN '[' || role || '] ' || {_FIRST} END AS p FROM m WHERE idx < 2)", "g AS (SELECT session_id, count(*) AS original_messages, sum(tokens)::BIGINT AS original_tokens, list(p ORDER BY idx) FILTER (p IS NOT NULL) AS l FROM p GROUP BY session_id)"], "SELECT session_id, original_messages, original_tokens, CASE WHEN len(l) > 0 THEN 'Context summary (' || original_messages || ' messages):' || chr(10) || array_to_string(l[:20], chr(10)) ELSE 'Context summary: ' || original_messages || ' messages exchanged.' END AS content FROM g"))
def summarize_oldest(spark, sf_dir):
    return P.local_summary(M.context_messages(spark, sf_dir).filter("idx < 2")).drop("tokens")


# Contents in parts -----------------------------------------------------------------------------------------------------------


def mixed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed lines of messages whose contents are texts, lists of parts with images and tool calls, or nothing; some texts are Chinese."""
    d = docs(spark, sf_dir).withColumn("t", F.concat(F.substring("text", 1, 80), F.when(F.col("doc_id") % 5 == 0, "中文字。").otherwise("")))
    part = lambda name, *columns: F.to_json(F.struct(F.lit(name).alias("type"), *columns))
    text = part("text", F.col("t").alias("text"))
    call = part("toolCall", F.col("source").alias("name"), F.struct("lang", (F.col("n_chars") % 100).alias("n"), F.repeat(F.lit("x"), (F.col("n_chars") % 150).cast("int")).alias("pad")).alias("arguments"))
    listed = lambda *x: F.concat(F.lit("["), F.concat_ws(", ", *x), F.lit("]"))
    kind = F.col("doc_id") % 4
    content = F.when(kind == 0, F.get_json_object(text, "$.text")).when(kind == 1, listed(text, F.lit('{"type": "image", "data": "00"}'))).when(kind == 2, listed(text, call, F.lit('"plain"'))).otherwise("null")
    content = F.when(kind == 0, F.regexp_extract(text, r'(?s)"text":(".*")', 1)).otherwise(content)
    raw = F.concat(F.lit('{"type": "message", "id": "d'), "doc_id", F.lit('", "message": {"role": "assistant", "content": '), content, F.lit("}}"))
    return jsonl.parse_lines(d.select(F.floor(F.col("doc_id") / 20).cast("string").alias("session_id"), (F.col("doc_id") % 20 + 1).cast("int").alias("line"), raw.alias("raw")))


_MIXED = "m AS (SELECT *, left(text, 80) || CASE WHEN doc_id % 5 = 0 THEN '中文字。' ELSE '' END AS t, doc_id % 4 AS kind, (doc_id // 20)::VARCHAR AS session_id, (doc_id % 20 + 1)::INTEGER AS line FROM documents)"


@query(S.select([_MIXED], f"SELECT session_id, line, CASE kind WHEN 0 THEN {S.tokens('t')} WHEN 1 THEN {S.tokens('t')} + 10 WHEN 2 THEN {S.tokens('t')} + 20 ELSE 0 END::BIGINT AS tokens FROM m"))
def message_tokens(spark, sf_dir):
    return mixed_lines(spark, sf_dir).select("session_id", "line", F.col("message_tokens").alias("tokens"))


@query(S.select([_MIXED], """SELECT session_id, line, 0 AS part, 'text' AS type, CASE WHEN kind = 3 THEN '' ELSE t END AS text, kind IN (1, 2) AS has_json FROM m
UNION ALL SELECT session_id, line, 1, CASE kind WHEN 1 THEN 'image' ELSE 'toolCall' END, NULL, true FROM m WHERE kind IN (1, 2) UNION ALL SELECT session_id, line, 2, 'text', 'plain', false FROM m WHERE kind = 2"""))
def normalised_messages(spark, sf_dir):
    """Contents as lists of parts, a row for each part."""
    rows = mixed_lines(spark, sf_dir).select("session_id", "line", F.posexplode("parts").alias("part", "p"))
    return rows.select("session_id", "line", "part", "p.type", "p.text", F.col("p.json").isNotNull().alias("has_json"))


@query(S.select([_MIXED], """SELECT session_id, line, source || '(' || left('{"lang":"' || lang || '","n":' || (n_chars % 100) || ',"pad":"' || repeat('x', (n_chars % 150)::INTEGER) || '"}', 100) || ')' AS calls FROM m WHERE kind = 2"""))
def tool_call_texts(spark, sf_dir):
    return mixed_lines(spark, sf_dir).filter(F.size("call_texts") > 0).select("session_id", "line", F.array_join("call_texts", "; ").alias("calls"))


_BLOCK = "CASE raw_role WHEN 'user' THEN '[User]: ' || text WHEN 'assistant' THEN concat_ws(chr(10), CASE WHEN text <> '' THEN '[Assistant]: ' || text END, CASE WHEN len(tool_calls) > 0 THEN '[ToolCalls]: ' || array_to_string(list_transform(tool_calls, lambda x: x || '({})'), ', ') END) WHEN 'toolResult' THEN '[Tool ' || coalesce(nullif(tool_name, ''), '?') || CASE WHEN is_error THEN ' ❌ ERROR' ELSE '' END || ']: ' || text END"


@query(S.select([*S.turns("events30"), f"bl AS (SELECT session_id, seq, string_agg(nullif({_BLOCK}, ''), chr(10) ORDER BY line) AS said FROM placed GROUP BY ALL)"], "SELECT session_id, seq, turn_id, '[Turn #' || seq || ' | ' || message_count || ' messages | ' || len(tools_used) || ' tools]' || chr(10) || coalesce(chr(10) || said, '') AS text FROM turns JOIN bl USING (session_id, seq)"))
def compact_inputs(spark, sf_dir):
    lines = M.events30(spark, sf_dir)
    return inputs(lines, Q.turns(lines))


# Compactions in use ----------------------------------------------------------------------------------------------------------

_TOPICS_DONE = f"tc AS (SELECT session_id, topic_id, label, cur, turn_count, summary, summary_tokens, row_number() OVER (PARTITION BY session_id ORDER BY topic_id)::INTEGER AS ord FROM least WHERE eligible AND least > {CONV10.topic_target})"


@query(S.select([*S.topics("conv10"), _NO_SUMMARIES, _MARKED_TURNS, _PLACED, _CONTEXT, *_GROUPS, _TOPICS_DONE], "SELECT session_id, phase, ord, sub_ord, role, content, tokens FROM ctx UNION ALL SELECT session_id, 0, ord, 0, 'user', '[Topic Summary: ' || label || ' (' || turn_count || ' turns)]: ' || summary, summary_tokens FROM tc WHERE topic_id <> cur"))
def assemble_with_compactions(spark, sf_dir):
    t = _topic_turns(spark, sf_dir, "conv10")
    return A.assemble(M.conv10(spark, sf_dir), t, CONV10, compacted=A.compact_topics(t, CONV10)).drop("tool_name", "parts")


@query(S.select([*S.topics("tooltalk"), _NO_SUMMARIES, _MARKED_TURNS, _PLACED, _CONTEXT, *_TRUNCATED, f"done AS (SELECT c.session_id, c.turn_id, c.msg_idx, c.truncated FROM cut c JOIN goes g USING (session_id, seq) WHERE g.least > {TOOLTALK.threshold})", f"again AS (SELECT x.session_id, phase, x.ord, sub_ord, CASE WHEN d.truncated IS NULL THEN x.tokens ELSE {S.tokens('d.truncated')} END AS tokens, d.truncated IS NOT NULL AS cut FROM ctx x JOIN (SELECT session_id, seq, turn_id FROM turns) t ON x.session_id = t.session_id AND x.ord = t.seq LEFT JOIN done d ON d.session_id = t.session_id AND d.turn_id = t.turn_id AND d.msg_idx = x.sub_ord AND x.phase = 1 AND x.role = 'tool')"], "SELECT session_id, count(*) AS messages, sum(tokens)::BIGINT AS tokens, count(*) FILTER (cut) AS cut FROM again GROUP BY session_id"))
def assemble_truncated(spark, sf_dir):
    """Contexts that are assembled once more, after tool results have been truncated."""
    lines, t = M.tooltalk(spark, sf_dir), _topic_turns(spark, sf_dir, "tooltalk")
    cut = materialise(_cuts(lines, t), "cuts")
    again = A.assemble(lines, t, TOOLTALK, tool_results=cut)
    return again.groupBy("session_id").agg(F.count("*").alias("messages"), F.sum("tokens").alias("tokens"), F.count_if(F.col("content").endswith(T.CUT_NOTE)).alias("cut"))


@query(S.select([*S.topics("conv10"), _MARKED_TURNS, "sub AS (SELECT *, CASE seq % 3 WHEN 1 THEN topic_id || '-a' WHEN 2 THEN topic_id || '-b' END AS part FROM mt)", "now AS (SELECT *, last_value(part) OVER (PARTITION BY session_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS part_now FROM sub)"], "SELECT session_id, seq, n_topics <= 1 OR (topic_id = cur AND (part IS NULL OR part_now IS NULL OR part = part_now)) AS relevant FROM now"))
def engine_subtopic_filter(spark, sf_dir):
    """Turns that are relevant to the last one, where turns have sub-topics, or none yet."""
    part = F.when(F.col("seq") % 3 == 1, F.concat("topic_id", F.lit("-a"))).when(F.col("seq") % 3 == 2, F.concat("topic_id", F.lit("-b")))
    return A.relevant(_topic_turns(spark, sf_dir, "conv10").withColumn("subtopic_id", part), CONV10).select("session_id", "seq", "relevant")


#: Every sub-topic that may be compacted is.
ALL = EngineConfig(max_context_tokens=0, system_prompt_reserve=10**9)


@query(S.select([*S.subtopics("events30"), "mem AS (SELECT t.session_id, g.ord, g.part, g.parts, t.seq, t.turn_id, t.total_tokens, t.user_preview, t.assistant_preview, t.tools_used, CASE WHEN left(f.user_preview, 40) <> '' THEN left(f.user_preview, 40) ELSE 'Sub-topic ' || (g.ord + 1) END AS label FROM turns t JOIN sub g ON g.session_id = t.session_id AND t.seq >= g.start AND t.seq < g.start + g.size JOIN turns f ON f.session_id = g.session_id AND f.seq = g.start WHERE g.parts > 1 AND t.seq < t.n_turns - 5)", "tg AS (SELECT session_id, ord, string_agg(tool, ', ' ORDER BY spot) AS tools FROM (SELECT session_id, ord, tool, min(seq * 1000 + k) AS spot FROM (SELECT session_id, ord, seq, unnest(tools_used) AS tool, generate_subscripts(tools_used, 1) AS k FROM mem) GROUP BY ALL) GROUP BY ALL)", "gs AS (SELECT session_id, ord, part, parts, label, count(*) AS turn_count, sum(total_tokens)::BIGINT AS original_tokens, list('  - User: ' || left(user_preview, 80) || ' → ' || left(assistant_preview, 60) ORDER BY seq) AS pts FROM mem GROUP BY ALL)"], "SELECT session_id, 'subtopic-' || ord AS subtopic_id, 'everything > ' || label AS label, turn_count, original_tokens, '## Topic: ' || label || ' (' || turn_count || ' turns)' || chr(10) || CASE WHEN tools IS NOT NULL THEN chr(10) || 'Tools used: ' || tools ELSE '' END || chr(10) || chr(10) || 'Key turns:' || chr(10) || array_to_string(pts[:8], chr(10)) || CASE WHEN turn_count > 8 THEN chr(10) || '  - ... and ' || (turn_count - 8) || ' more turns' ELSE '' END AS summary FROM gs LEFT JOIN tg USING (session_id, ord) WHERE part < parts AND turn_count >= 2"))
def subtopic_compaction(spark, sf_dir):
    """Summaries of all sub-topics but the current one, of sessions of one topic."""
    rows = materialise(_all_one(spark, sf_dir).withColumns({"topic_ord": F.lit(0), "label": F.lit("everything"), "is_current": F.lit(True)}), "turns")
    old = Q.with_cutoff(rows, 5).filter("not recent").select("session_id", "topic_id", "seq")
    parts = G.subtopics(rows).withColumn("seq", F.explode("turn_sequences")).join(old, ["session_id", "topic_id", "seq"]).groupBy("session_id", "topic_id", "subtopic_id", "label", "is_current").agg(F.sort_array(F.collect_list("seq")).alias("turn_sequences"))
    several = G.subtopics(rows).groupBy("session_id").count().filter("count > 1").select("session_id")
    done = A.compact_subtopics(rows, parts, G.time_chunks(rows), ALL)
    return done.join(several, "session_id", "left_semi").select("session_id", "subtopic_id", "label", "turn_count", "original_tokens", "summary")


# The engine and its stores -----------------------------------------------------------------------------------------------------


def engine(spark: SparkSession, lines: DataFrame, config: EngineConfig = EngineConfig()) -> Engine:
    return Engine(spark, lines, stores.shared_path(spark, "engine"), config)


def _short(n: str) -> str:
    return f"CASE WHEN {n} >= 1000000 THEN (floor({n} * 10.0::DOUBLE / 1000000 + 0.5) / 10)::DECIMAL(20, 1)::VARCHAR || 'M' WHEN {n} >= 1000 THEN (floor({n} * 10.0::DOUBLE / 1000 + 0.5) / 10)::DECIMAL(20, 1)::VARCHAR || 'K' ELSE {n}::VARCHAR END"


@query(S.select([*S.turns("tooltalk"), "st AS (SELECT session_id, count(*) AS n, sum(message_count)::BIGINT AS m, sum(total_tokens)::BIGINT AS k, sum(len(tools_used))::BIGINT AS u FROM turns GROUP BY session_id)", "us AS (SELECT session_id, string_agg(tool || '(' || c || ')', ', ' ORDER BY c DESC, tool) AS tools FROM (SELECT session_id, tool, count(*) AS c FROM (SELECT session_id, unnest(tools_used) AS tool FROM turns) GROUP BY ALL) GROUP BY session_id)"], f"SELECT session_id, concat_ws(chr(10), 'Session: ' || session_id, 'Turns: ' || n, 'Messages: ' || m, 'Tokens: ' || {_short('k')}, 'Tool uses: ' || u, 'Tools: ' || tools) AS text FROM st LEFT JOIN us USING (session_id)"))
def overview_text(spark, sf_dir):
    return engine(spark, M.tooltalk(spark, sf_dir)).overview()


@query(S.select(S.turns("tooltalk"), f"SELECT session_id, seq, '#' || seq || ' ' || turn_id || ', lines ' || line_start || ' to ' || line_end || ', ' || message_count || ' messages, ' || {_short('total_tokens')} || ' tokens, importance ' || importance || ', tools [' || array_to_string(tools_used, ',') || ']' || CASE WHEN has_error THEN ' (error)' ELSE '' END || chr(10) || '  user: ' || left(user_preview, 80) || chr(10) || '  assistant: ' || left(assistant_preview, 80) AS text FROM turns"))
def turn_list_text(spark, sf_dir):
    return engine(spark, M.tooltalk(spark, sf_dir)).turn_list()


@query(S.select(S.turns("tooltalk"), "SELECT session_id, line, '[line ' || line || '] ' || text AS text FROM placed JOIN (SELECT session_id, seq FROM turns WHERE turn_id LIKE 'd%4-1') USING (session_id, seq) WHERE session_id = '3'"))
def read_raw(spark, sf_dir):
    """Lines of some turns as they are, numbered."""
    e = engine(spark, M.tooltalk(spark, sf_dir))
    found = [e.read_raw(f"d{n}-1", "3") for n in (64, 74)]
    return found[0].union(found[1])


@query(S.select(S.turns("conv10"), "SELECT session_id, seq, importance FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY seq DESC) AS r FROM turns) WHERE r <= 4"))
def query_actions(spark, sf_dir):
    return engine(spark, M.conv10(spark, sf_dir)).query("recent_turns", count=4).select("session_id", "seq", "importance")


@query(S.select([*S.turns("conv10"), _BIG], "SELECT session_id, count(*) AS entries, sum(tokens)::BIGINT AS tokens, sum(original_tokens)::BIGINT AS original_tokens, 0::BIGINT AS by_model FROM big GROUP BY session_id"))
def summary_stats(spark, sf_dir):
    return stores.summary_stats(A.compact(Q.turns(M.conv10(spark, sf_dir)), CONV10))


@query(S.select([*S.turns("conv10"), _BIG], "SELECT session_id, turn_id, CASE WHEN tokens % 2 = 0 THEN tokens + 1000 ELSE tokens END AS tokens FROM big"))
def store_roundtrip(spark, sf_dir):
    """Summaries that are stored, in part stored again, rewritten and read."""
    store = stores.Store(spark, stores.shared_path(spark, "store"))
    rows = materialise(A.compact(Q.turns(M.conv10(spark, sf_dir)), CONV10), "summaries")
    store.save("summaries", rows)
    store.save("summaries", rows.filter("tokens % 2 = 0").withColumn("tokens", F.col("tokens") + 1000))
    store.compact("summaries")
    return store.load("summaries").select("session_id", "turn_id", "tokens")


@query(S.select(S.topics("tooltalk"), "SELECT session_id, seq, turn_id, line_start, line_end, message_count, total_tokens, topic_id FROM tturns"))
def index_in_batches(spark, sf_dir):
    """The index of lines that come in three batches, which cut turns in two, and of a batch that comes twice."""
    store = stores.Store(spark, stores.shared_path(spark, "batches"))
    lines, step = materialise(M.tooltalk(spark, sf_dir), "lines"), ingest.index_batch(store)
    for k, part in enumerate(("line <= 20", "line > 20 and line <= 41", "line > 41", "line > 41")):
        step(lines.filter(part), k)
    store.vacuum("turns")
    return store.sessions("turns").select("session_id", "seq", "turn_id", "line_start", "line_end", "message_count", "total_tokens", "topic_id")


@query(S.select([*S.turns("conv10"), _BIG, "s AS (SELECT session_id, count(*) AS c, sum(original_tokens - tokens)::BIGINT AS saved FROM big GROUP BY session_id)"], "SELECT session_id, coalesce(c, 0) > 0 AS compacted, CASE WHEN c IS NULL THEN 'All turns already compacted or recent' END AS reason, CASE WHEN c > 0 THEN 'Compacted ' || c || ' turns (' || c || ' new, 0 cached)' END AS summary, 2 * saved AS tokens_before, saved AS tokens_after FROM (SELECT DISTINCT session_id FROM turns) LEFT JOIN s USING (session_id)"))
def compaction_result(spark, sf_dir):
    done = engine(spark, M.conv10(spark, sf_dir), CONV10).compact_result()
    return done.select("session_id", "compacted", "reason", "summary", "tokens_before", "tokens_after")


# Streams ---------------------------------------------------------------------------------------------------------------------


@query(S.select(S.turns("tooltalk"), "SELECT session_id, seq, turn_id, line_start, line_end, message_count, total_tokens FROM turns"))
def stream_turns(spark, sf_dir):
    """Turns of a stream, as they stand at its end."""
    lines = M.tooltalk(spark, sf_dir).select("session_id", "line", "entry_id", "role", "tokens", "tool_calls")
    return ingest.run_available(lines, lambda s: ingest.live_turns(s), ["session_id", "seq"], "line_end").select("session_id", "seq", "turn_id", "line_start", "line_end", "message_count", "total_tokens")


_LAST_THREE = [
    "wd AS (SELECT t.session_id, t.seq AS i, f.seq AS k, f.term, f.tf FROM turns t JOIN tf f ON f.session_id = t.session_id AND f.seq BETWEEN t.seq - 3 AND t.seq WHERE t.seq > 0)",
    "wf AS (SELECT *, tf * (ln((least(i, 3) + 1) / (count(*) OVER (PARTITION BY session_id, i, term) + 1)::DOUBLE) + 1) AS w FROM wd)",
    "wn AS (SELECT session_id, i, k, sqrt(sum(w * w)) AS n FROM wf GROUP BY ALL)",
    "wx AS (SELECT a.session_id, a.i, b.k, sum(a.w * b.w) AS xy FROM wf a JOIN wf b ON a.session_id = b.session_id AND a.i = b.i AND a.term = b.term WHERE a.k = a.i AND b.k < b.i GROUP BY ALL)",
    "ws AS (SELECT x.session_id, x.i, sum(CASE WHEN p.n * q.n > 0 THEN least(1.0, xy / (p.n * q.n)) ELSE 0 END) / least(x.i, 3) AS sim FROM wx x JOIN wn p ON p.session_id = x.session_id AND p.i = x.i AND p.k = x.i JOIN wn q ON q.session_id = x.session_id AND q.i = x.i AND q.k = x.k GROUP BY x.session_id, x.i)",
]


@query(S.select([*S.similarities("conv10"), *_LAST_THREE], "SELECT t.session_id, t.seq, (sum(CASE WHEN t.seq > 0 AND coalesce(sim, 0) < 0.05::DOUBLE THEN 1 ELSE 0 END) OVER (PARTITION BY t.session_id ORDER BY t.seq))::INTEGER AS topic_ord FROM turns t LEFT JOIN ws ON ws.session_id = t.session_id AND ws.i = t.seq"))
def stream_topics(spark, sf_dir):
    """Topics of turns as they complete."""
    rows = Q.turns(M.conv10(spark, sf_dir)).select("session_id", "seq", T.terms(T.turn_text(F.col("user_preview"), F.col("assistant_preview"), F.col("tools_used"))).alias("terms"))
    return ingest.run_available(rows, lambda s: ingest.live_topics(s), ["session_id", "seq"], "seq")
