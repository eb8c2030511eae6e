"""The tool surface: one engine over all sessions of a path, with its side tables; every tool is a function of it.

Tools take session_id to look at one session; without, they answer for all of them. Figures come as DataFrames; formatted texts are
built in the JVM, a line per session.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnlake.config import ContextConfig, EngineConfig, TopicConfig, resolved
from turnlake.functions import text as T
from turnlake.operators import assemble as A
from turnlake.operators import prune as P
from turnlake.operators import topics as G
from turnlake.operators import turns as Q
from turnlake.sources import jsonl
from turnlake.stores import Store, materialise, stale, topic_compaction_stats


class Engine:
    def __init__(self, spark: SparkSession, lines: DataFrame | str, store: str, config: EngineConfig = EngineConfig(), topic_config: TopicConfig = TopicConfig(), context: ContextConfig = ContextConfig(), summarizer=None):
        self.spark, self.store = spark, Store(spark, store)
        self.config, self.topic_config, self.context, self.summarizer = config, topic_config, context, summarizer
        self.path = lines if isinstance(lines, str) else None
        self.lines = jsonl.read_sessions(spark, lines) if isinstance(lines, str) else lines
        self._turns: DataFrame | None = None

    def configure(self, **options) -> EngineConfig:
        """Options of the engine replaced; the index stays."""
        self.config = resolved(self.config, **options)
        return self.config

    def configure_context(self, **options) -> ContextConfig:
        """Options of flat contexts, replaced where given."""
        self.context = resolved(self.context, **options)
        return self.context

    def state(self) -> DataFrame:
        """(session_id, turn_id, compacted, summary, tokens): what is stored of turns."""
        return self.store.load("summaries", A.SUMMARIES).select("session_id", "turn_id", F.lit(True).alias("compacted"), "summary", "tokens")

    def restore(self, state: DataFrame) -> None:
        """Store a state() again, in this engine's store or another's; turns that aren't compacted are left out."""
        rows = state.filter("compacted and summary is not null").join(self.turns().select("session_id", "turn_id", "total_tokens"), ["session_id", "turn_id"])
        self.store.save("summaries", rows.select("session_id", "turn_id", "summary", "tokens", F.col("total_tokens").alias("original_tokens"), F.lit("local").alias("method")))

    # Index

    def files(self) -> DataFrame:
        """(session_id, modified, path) of the session files."""
        found = self.spark.read.format("binaryFile").load(self.path).select("path", F.col("modificationTime").alias("modified"))
        return found.select(jsonl.session_of(F.col("path")).alias("session_id"), "modified", "path")

    def build(self, only_stale: bool = True) -> DataFrame:
        """Build and store the index, of sessions whose file changed since; per session, its statistics."""
        lines = self.lines
        if self.path is not None:
            files = self.files()
            fresh = stale(files, self.store.load("session_index")) if only_stale else files.select("session_id", "modified")
            fresh = materialise(fresh, "stale")
            if fresh.isEmpty():
                self._turns = self.store.sessions("turns")
                return self.stats()
            # Only files that changed are read; the driver lists the files anyway.
            lines = jsonl.read_sessions(self.spark, [r.path for r in files.join(fresh.select("session_id"), "session_id", "left_semi").select("path").collect()])
        rows = materialise(Q.turns(lines), "turns")
        built = G.with_topics(rows, materialise(G.segments(rows, self.topic_config), "segments"))
        self.store.replace_sessions("turns", built)
        if self.path is not None:
            self.store.save("session_index", fresh)
        self._turns = self.store.sessions("turns")
        return self.stats()

    def bootstrap(self) -> int:
        """Bring the index up to date; the number of messages."""
        return self.build().agg(F.coalesce(F.sum("total_messages"), F.lit(0))).first()[0]

    def turns(self, session_id: str | None = None) -> DataFrame:
        if self._turns is None:
            self.build()
        rows = self._turns if session_id is None else self._turns.filter(F.col("session_id") == session_id)
        return self._with_subtopics(rows)

    def _with_subtopics(self, rows: DataFrame) -> DataFrame:
        """rows with subtopic_id, and the current_subtopic of their topic, of stored sub-topics; topics of one sub-topic have none."""
        kept = self.store.load("subtopics")
        if kept is None or "topic_id" not in rows.columns:
            return rows
        kept = kept.withColumn("_k", F.count("*").over(Q.Window.partitionBy("session_id", "topic_id"))).filter("_k > 1")
        member = kept.select("session_id", "topic_id", "subtopic_id", F.explode("turn_sequences").alias("seq")).groupBy("session_id", "topic_id", "seq").agg(F.max("subtopic_id").alias("subtopic_id"))
        now = kept.groupBy("session_id", "topic_id").agg(F.max(F.when(F.col("is_current"), F.col("subtopic_id"))).alias("current_subtopic"))
        return rows.join(member, ["session_id", "topic_id", "seq"], "left").join(now, ["session_id", "topic_id"], "left").select(*rows.columns, "subtopic_id", "current_subtopic")

    # Index tools

    def stats(self, session_id: str | None = None) -> DataFrame:
        return Q.session_stats(self.turns(session_id))

    def meta(self, session_id: str | None = None) -> DataFrame:
        return Q.session_meta(self.lines if session_id is None else self.lines.filter(F.col("session_id") == session_id))

    def overview(self, session_id: str | None = None) -> DataFrame:
        """(session_id, text): statistics and tools, most used first."""
        usage = Q.tool_usage(self.turns(session_id)).groupBy("session_id").agg(F.sort_array(F.collect_list(F.struct((-F.col("turns")).alias("n"), "tool"))).alias("u"))
        tools = F.array_join(F.transform("u", lambda x: F.concat(x["tool"], F.lit("("), (-x["n"]).cast("string"), F.lit(")"))), ", ")
        line = lambda name, c: F.concat(F.lit(f"{name}: "), c.cast("string"))
        text = F.concat_ws("\n", line("Session", F.col("session_id")), line("Turns", F.col("total_turns")), line("Messages", F.col("total_messages")), line("Tokens", T.token_count_text(F.col("total_tokens"))), line("Tool uses", F.col("total_tool_calls")), F.when(F.col("u").isNotNull(), F.concat(F.lit("Tools: "), tools)))
        return self.stats(session_id).join(usage, "session_id", "left").select("session_id", text.alias("text"))

    def turn_list(self, session_id: str | None = None) -> DataFrame:
        """(session_id, seq, text): a turn's place, size and previews."""
        flag = F.when(F.col("has_error"), F.lit(" (error)")).otherwise("")
        head = F.format_string("#%d %s, lines %d to %d, %d messages, %s tokens, importance %d, tools [%s]", "seq", "turn_id", "line_start", "line_end", "message_count", T.token_count_text(F.col("total_tokens")), "importance", F.array_join("tools_used", ","))
        return self.turns(session_id).select("session_id", "seq", F.concat(head, flag, F.lit("\n  user: "), F.substring("user_preview", 1, 80), F.lit("\n  assistant: "), F.substring("assistant_preview", 1, 80)).alias("text"))

    def query(self, action: str, session_id: str | None = None, count: int = 10, turn_id: str | None = None, target_tokens: int = 100_000) -> DataFrame:
        """By action: stats, turns, recent_turns, largest_turns, tool_usage, compression_candidates, turn_detail."""
        rows = self.turns(session_id)
        actions = {
            "stats": lambda: self.stats(session_id), "turns": lambda: rows, "recent_turns": lambda: Q.recent(rows, count), "largest_turns": lambda: Q.largest(rows, count),
            "tool_usage": lambda: Q.tool_usage(rows), "compression_candidates": lambda: Q.recommend(rows, target_tokens, self.config.preserve_recent_turns), "turn_detail": lambda: Q.lookup(rows, turn_id=turn_id),
        }
        if action not in actions:
            raise ValueError(f"unknown action {action!r}; there are {', '.join(actions)}")
        return actions[action]()

    def read_raw(self, turn_id: str, session_id: str | None = None) -> DataFrame:
        """(session_id, line, text): a turn's lines as they are, numbered."""
        source = jsonl.raw_lines(self.spark, self.path) if self.path else self.lines.select("session_id", "line", F.col("text").alias("raw"))
        rows = self._recovered(source, turn_id, session_id)
        return rows.select("session_id", "line", F.concat(F.lit("[line "), F.col("line").cast("string"), F.lit("] "), "raw").alias("text"))

    def _recovered(self, source: DataFrame, turn_id: str, session_id: str | None) -> DataFrame:
        """Lines of source in turns of an id. Only sessions that have one are shuffled and sorted: no other has lines to give."""
        found = Q.lookup(self.turns(session_id), turn_id=turn_id).select("session_id", "seq", "turn_id", "line_start", "line_end")
        if session_id is not None:
            source = source.filter(F.col("session_id") == session_id)
        else:
            source = source.join(found.select("session_id"), "session_id", "left_semi")
        return Q.recover(source, found)

    # Topic tools

    def topics(self, session_id: str | None = None) -> DataFrame:
        """Topics with their number of sub-topics and first five turns."""
        rows = self.turns(session_id)
        parts = G.subtopics(rows).groupBy("session_id", "topic_id").agg(F.count("*").alias("subtopics"))
        return G.topics(rows).join(parts, ["session_id", "topic_id"], "left").withColumn("first_turns", F.slice("turn_ids", 1, 5))

    def detect_subtopics(self, session_id: str | None = None, responses: DataFrame | None = None) -> DataFrame:
        """Sub-topics of topics of three turns or more, stored; by a model's answers where there are any."""
        from turnlake.operators.summarize import subtopics_by_model

        rows = self.turns(session_id)
        large = rows.groupBy("session_id", "topic_id").count().filter("count >= 3").select("session_id", "topic_id")
        found = G.subtopics(rows.join(large, ["session_id", "topic_id"], "left_semi"))
        found = found.withColumn("method", F.lit("heuristic")) if responses is None else subtopics_by_model(rows, responses, found)
        found = materialise(found, "subtopics")
        self.store.save("subtopics", found)
        return found

    # Compaction tools

    def compact(self, session_id: str | None = None, only: DataFrame | None = None) -> DataFrame:
        """Summarise the largest older turns and store it; per session: compacted turns, tokens saved, cache hits. only: of these sessions."""
        rows, before = self._only(self.turns(session_id), only), self.store.load("summaries", A.SUMMARIES)
        new = materialise(A.compact(rows, self.config, before, self.summarizer, self.lines, self.store.load("tool_results", A.TOOL_RESULTS)), "summaries")
        report = materialise(A.compaction_report(rows, before, new, self.config), "report")
        self.store.save("summaries", new)
        return report

    def compact_result(self, session_id: str | None = None) -> DataFrame:
        """compact(), and per session what it did: compacted, reason or summary, tokens before and after, stored truncations."""
        rows = materialise(self.turns(session_id).select("session_id").distinct(), "sessions")
        report = self.compact(session_id)
        return A.compaction_result(report, self.store.load("summaries", A.SUMMARIES), self.store.load("tool_results", A.TOOL_RESULTS), rows)

    @staticmethod
    def _only(rows: DataFrame, only: DataFrame | None) -> DataFrame:
        return rows if only is None else rows.join(only.select("session_id").distinct(), "session_id", "left_semi")

    def _parts(self, old: DataFrame) -> DataFrame:
        """Sub-topics of older turns: the stored ones of topics that have several, else those found by signals."""
        found, kept = G.subtopics(old), self.store.load("subtopics")
        if kept is None:
            return found
        many = kept.groupBy("session_id", "topic_id").count().filter("count > 1").select("session_id", "topic_id")
        kept = kept.join(many, ["session_id", "topic_id"], "left_semi").select(*[c for c in found.columns if c in kept.columns])
        return found.join(many, ["session_id", "topic_id"], "left_anti").unionByName(kept, allowMissingColumns=True)

    def compact_topics(self, session_id: str | None = None, only: DataFrame | None = None) -> DataFrame:
        """Compact topics, and the sub-topics of sessions of one topic, and store it; the new rows. only: of these sessions."""
        rows, summaries, done = self._only(self.turns(session_id), only), self.store.load("summaries", A.SUMMARIES), self.store.load("topic_compactions", A.TOPIC_COMPACTIONS)
        old = Q.with_cutoff(rows, self.config.preserve_recent_turns).filter("not recent").drop("recent")
        new = A.compact_topics(rows, self.config, summaries, done).unionByName(A.compact_subtopics(rows, self._parts(old), G.time_chunks(old), self.config, summaries, done))
        new = materialise(new, "topics")
        self.store.save("topic_compactions", new)
        return new

    def recover(self, turn_id: str, session_id: str | None = None, size: int = 300) -> DataFrame:
        """A turn's messages, the first size characters of each, with their lines."""
        rows = self._recovered(self.lines, turn_id, session_id)
        return rows.filter("role is not null").select("session_id", "turn_id", "line", "raw_role", F.substring("text", 1, size).alias("text"))

    def assemble(self, session_id: str | None = None, token_budget: int | None = None, messages: DataFrame | None = None) -> DataFrame:
        """The context. Where it is over the threshold, tool results that are too large are truncated in the store, for the next time;
        where that doesn't suffice, the largest turns and then topics are compacted there. A budget stays set. Of messages (session_id,
        idx, role, content), if given, those of sessions without a log pass as they are.
        """
        config = self.configure(max_context_tokens=token_budget)
        rows = self.turns(session_id)
        lines = self.lines if session_id is None else self.lines.filter(F.col("session_id") == session_id)
        summaries, results, done = self.store.load("summaries", A.SUMMARIES), self.store.load("tool_results", A.TOOL_RESULTS), self.store.load("topic_compactions", A.TOPIC_COMPACTIONS)
        context = materialise(A.assemble(lines, rows, config, summaries, results, done), "context")
        used = materialise(A.used_tokens(context, config), "used")
        cut = materialise(A.truncations(lines, rows, used, config, summaries, results), "cuts")
        if not cut.isEmpty():
            self.store.save("tool_results", cut)
        saved = cut.groupBy("session_id").agg(F.sum(F.col("original_tokens") - F.col("truncated_tokens")).alias("saved"))
        left = F.col("tokens") - F.coalesce("saved", F.lit(0))
        still = materialise(used.filter("over").join(saved, "session_id", "left").filter(left > config.threshold).select("session_id"), "still")
        if not still.isEmpty():
            self.compact(session_id, still)
            self.compact_topics(session_id, still)
        if messages is None:
            return context
        known = self.turns().select("session_id").distinct()
        other = A.pass_through(messages.join(known, "session_id", "left_anti"))
        return context.unionByName(other if session_id is None else other.filter(F.col("session_id") == session_id))

    def preview(self, session_id: str | None = None) -> DataFrame:
        """What assembling does with each turn: kept as it is, or up for summary, truncation or dropping."""
        rows = A.relevant(self.turns(session_id), self.config)
        return rows.select("session_id", "seq", "topic_id", "total_tokens", F.when(F.col("recent"), "kept").when(F.col("relevant"), "older").otherwise("dropped").alias("zone"))

    def status(self, session_id: str | None = None) -> DataFrame:
        """Per session: turns, tokens, need of compaction, topic compactions."""
        need = A.needs_compaction(self.turns(session_id), self.config)
        done = topic_compaction_stats(self.store.load("topic_compactions", A.TOPIC_COMPACTIONS)).select("session_id", F.col("entries").alias("topic_compactions"))
        return need.join(done, "session_id", "left").fillna(0, ["topic_compactions"])

    # Flat contexts

    def flat(self, session_id: str | None = None) -> DataFrame:
        """Messages as a flat context; none is pinned."""
        order = F.row_number().over(Q.Window.partitionBy("session_id").orderBy("line"))
        rows = self.lines.filter("role is not null") if session_id is None else self.lines.filter("role is not null").filter(F.col("session_id") == session_id)
        return rows.select("session_id", (order - 1).alias("idx"), F.when(F.col("raw_role") == "toolResult", "tool").otherwise(F.col("raw_role")).alias("role"), F.coalesce("text", F.lit("")).alias("content"), T.tokens(F.col("text")).alias("token_count"), F.lit(False).alias("pinned"))

    def prune(self, target_tokens: int | None = None, strategy: str | None = None, session_id: str | None = None) -> DataFrame:
        return P.prune(self.flat(session_id), target_tokens or self.context.max_tokens, strategy or self.context.strategy, self.context)

    def summarize(self, count: int | None = None, session_id: str | None = None) -> DataFrame:
        """Local summary of the oldest messages, by default all but the last ten."""
        rows = self.flat(session_id)
        n = F.count("*").over(Q.Window.partitionBy("session_id"))
        return P.local_summary(rows.withColumn("_n", n).filter(F.col("idx") < (F.lit(count) if count is not None else F.greatest(F.lit(0), F.col("_n") - 10))).drop("_n"))


#: Tool names and what serves them.
TOOLS = {
    "context_engine_topics": Engine.topics, "context_stats": lambda e, session_id=None: P.stats(e.flat(session_id)), "context_prune": Engine.prune, "context_summarize": Engine.summarize,
    "context_pin": lambda e, marks, session_id=None: P.pin(e.flat(session_id), marks), "context_config": Engine.configure_context,
    "context_set_strategy": lambda e, strategy: setattr(e, "context", resolved(e.context, strategy=strategy if strategy in P.STRATEGIES else "fifo")),
    "session_index_build": Engine.build, "session_index_query": Engine.query, "session_index_read_raw": Engine.read_raw, "context_engine_status": Engine.status, "context_engine_compact": Engine.compact,
    "context_engine_recover": Engine.recover, "context_engine_assemble": Engine.preview, "context_engine_detect_subtopics": Engine.detect_subtopics,
}
