"""Operators on small sessions: JSON lines, merging, pruning, compaction, stores, streams."""

import json

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from turnlake.config import ContextConfig, EngineConfig
from turnlake.operators import prune as P
from turnlake.operators import topics as G
from turnlake.operators import turns as Q
from turnlake.plans.engine import TOOLS, Engine
from turnlake.sources import jsonl
from turnlake.sources.messages import from_messages
from turnlake.stores import Store, index_path


def message(role, content, **more):
    return json.dumps({"type": "message", "id": more.pop("id", None), "timestamp": "2026-04-28T10:00:00Z", "message": {"role": role, "content": content, **more}})


def session(tmp_path, lines, name="s1"):
    (tmp_path / "in").mkdir(exist_ok=True)
    (tmp_path / "in" / f"{name}.jsonl").write_text("\n".join(lines))
    return str(tmp_path / "in")


LINES = [
    json.dumps({"type": "session", "id": "abc", "version": 2, "cwd": "/x"}),
    json.dumps({"type": "model_change", "provider": "p", "modelId": "m1"}),
    message("assistant", [{"type": "text", "text": "early"}], id="x0"),
    message("user", "hello there", id="u1"),
    "",
    "{bad",
    message("assistant", [{"type": "text", "text": "I look"}, {"type": "toolCall", "name": "read", "arguments": {"a": 1}}, {"type": "toolCall", "name": "ls"}], id="a1"),
    message("toolResult", [{"type": "text", "text": "data"}, {"type": "image"}], toolName="read", isError=True),
    "5",
    "null",
    message("assistant", "plain string", id="a2"),
    json.dumps({"type": "model_change", "provider": "p", "modelId": "m2"}),
    message("system", "be good"),
    message("assistant", [{"type": "text", "text": "x"}], usage={"output": 7}),
]


def test_jsonl(spark, tmp_path):
    rows = {r.line: r for r in jsonl.read_sessions(spark, session(tmp_path, LINES)).collect()}
    assert sorted(rows) == [1, 2, 3, 4, 7, 8, 9, 11, 12, 13, 14]
    assert rows[8].entry_id == "line-8" and rows[8].tool_name == "read" and rows[8].is_error and rows[8].tokens == 2
    assert rows[7].tokens == 2 + 2 + 1 and rows[7].tool_calls == ["read", "ls"] and rows[7].assistant_text == "I look"
    assert rows[11].tokens == 0 and rows[11].assistant_text == "" and rows[9].type == "custom" and rows[9].role is None
    assert rows[13].role == "user" and rows[13].raw_role == "system" and rows[14].tokens == 7
    lines = jsonl.read_sessions(spark, str(tmp_path / "in"))
    turns = Q.turns(lines).orderBy("seq").collect()
    assert [(t.turn_id, t.line_start, t.line_end, t.message_count, t.tools_used, t.has_error) for t in turns] == [("u1", 4, 11, 4, ["read", "ls"], True), ("line-13", 13, 14, 2, [], False)]
    meta = Q.session_meta(lines).first()
    assert (meta.meta_session_id, meta.model_id, meta.cwd) == ("abc", "m2", "/x")
    assert Q.session_stats(Q.turns(lines), lines).first().total_lines == 14


def rescan(sizes, least):
    out = list(sizes)
    while len(out) > 1:
        short = next((i for i, x in enumerate(out) if x < least), None)
        if short is None:
            break
        i = 1 if short == 0 else short - 1 if short == len(out) - 1 or out[short - 1] >= out[short + 1] else short + 1
        a, b = sorted((short, i))
        out[a : b + 1] = [out[a] + out[b]]
    return out


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.integers(1, 6), min_size=1, max_size=14), min_size=20, max_size=60), st.integers(2, 4))
def test_merge_short(spark, cases, least):
    cases = [*cases, [1, 3, 1, 5, 1, 1, 2, 1]]
    rows = spark.createDataFrame([(i, [(sum(c[:k]), x, k) for k, x in enumerate(c)]) for i, c in enumerate(cases)], "i int, l array<struct<start:int,size:int,ord:int>>")
    got = {r.i: [(x.start, x.size) for x in r.m] for r in rows.select("i", G.merge_short(F.col("l"), least).alias("m")).collect()}
    for i, c in enumerate(cases):
        want = rescan(c, least)
        assert got[i] == [(sum(want[:k]), x) for k, x in enumerate(want)]


def flat(spark, tokens, roles=None):
    return spark.createDataFrame([("s", i, (roles or ["user"] * len(tokens))[i], "x", t, False) for i, t in enumerate(tokens)], "session_id string, idx int, role string, content string, token_count long, pinned boolean")


def pruned(rows):
    return [r.idx for r in rows.filter("pruned").orderBy("idx").collect()]


def test_prune(spark):
    rows = flat(spark, [5, 4, 3, 9, 2])
    assert pruned(P.prune(rows, 12, "fifo", ContextConfig(preserve_recent_messages=1))) == [0, 1, 2]
    assert pruned(P.prune(rows, 10, "sliding-window")) == [0, 3]
    assert pruned(P.prune(rows, 100, "importance")) == []
    assert pruned(P.prune(rows, 12, "no such", ContextConfig(preserve_recent_messages=1))) == [0, 1, 2]
    rows = flat(spark, [5, 5, 5, 5], ["system", "tool", "assistant", "user"])
    assert pruned(P.prune(rows, 10, "importance", ContextConfig(preserve_recent_messages=1))) == [1, 2]
    more = P.add(rows, spark.createDataFrame([("s", 0, "user", "hello", 0, False)], rows.schema))
    assert more.filter("idx = 4").first().token_count == 2


def talk(spark, n=14, session_id="s"):
    words = ["apple pear plum", "iron steel zinc"]
    rows = []
    for i in range(n):
        text = words[(i // 4) % 2]
        rows += [(session_id, 3 * i + 1, f"u{i}", "user", f"{text} {i % 2}", None), (session_id, 3 * i + 2, f"r{i}", "toolResult", f"{text}\n" * 200, f"run{(i // 4) % 2}"), (session_id, 3 * i + 3, f"a{i}", "assistant", text, None)]
    return from_messages(spark.createDataFrame(rows, "session_id string, line int, entry_id string, role string, text string, tool_name string"))


def test_strategies(spark, monkeypatch):
    """Unknown names stand for fifo; a strategy of one's own is called by its name."""
    m = spark.createDataFrame([("s", i, "user", "x", 10, False) for i in range(6)], "session_id string, idx int, role string, content string, token_count bigint, pinned boolean")
    c = ContextConfig(preserve_recent_messages=1)
    gone = lambda name: sorted(r.idx for r in P.prune(m, 30, name, c).filter("pruned").collect())
    assert gone("fifo") == gone("no such strategy") == [0, 1, 2]
    monkeypatch.setitem(P.STRATEGIES, "odd", lambda rows, target, config: rows.withColumn("pruned", F.col("idx") % 2 == 1))
    assert gone("odd") == [1, 3, 5]


def test_engine(spark, tmp_path):
    config = EngineConfig(max_context_tokens=6000, system_prompt_reserve=1000, tool_result_truncate_chars=1000)
    e = Engine(spark, talk(spark), str(tmp_path / "store"), config)
    assert e.bootstrap() == 42
    assert e.topics().count() >= 3
    first = e.assemble().agg(F.sum("tokens")).first()[0]
    second = e.assemble().agg(F.sum("tokens")).first()[0]
    assert second <= first
    report = e.compact().first()
    assert (report.compacted, report.cache_hits) == (3, 0)
    assert e.compact().first().cache_hits == 3
    e.configure(max_context_tokens=2000)
    assert e.compact_topics().count() >= 1
    assert e.assemble().filter("phase = 0").count() >= 1
    assert e.recover("u3").count() == 3
    assert e.query("largest_turns", count=2).count() == 2 and e.query("turn_detail", turn_id="u2").first().seq == 2
    for tool in ("context_stats", "context_prune", "context_summarize", "context_engine_status", "context_engine_assemble", "context_engine_detect_subtopics", "session_index_build"):
        assert TOOLS[tool](e).count() >= 1
    assert "Turns: 14" in e.overview().first().text and e.turn_list().count() == 14
    assert e.read_raw("u0").count() == 3
    assert len(TOOLS) == 15


def test_engine_compacts_where_truncation_does_not_suffice(spark, tmp_path):
    """A context over the threshold: truncations where they suffice, else summaries and topic compactions as well."""
    cut = EngineConfig(max_context_tokens=1200, system_prompt_reserve=1000, tool_result_truncate_chars=1000)
    e = Engine(spark, talk(spark), str(tmp_path / "c"), cut)
    e.assemble()
    assert e.store.load("tool_results").count() >= 1 and e.store.load("summaries") is None
    tight = EngineConfig(max_context_tokens=1200, system_prompt_reserve=1000, tool_result_truncate_chars=10**6)
    e = Engine(spark, talk(spark), str(tmp_path / "a"), tight)
    assert e.assemble().filter("phase = 0").isEmpty()
    assert e.store.load("summaries").count() == 3 and e.store.load("topic_compactions").count() >= 1
    assert not e.assemble().filter("phase = 0").isEmpty()
    wide = Engine(spark, talk(spark), str(tmp_path / "b"), EngineConfig(system_prompt_reserve=1000, tool_result_truncate_chars=10**6))
    wide.assemble()
    assert wide.store.load("tool_results") is None and wide.store.load("summaries") is None
    assert wide.assemble(token_budget=1200).count() and wide.config.max_context_tokens == 1200 and wide.store.load("summaries").count() == 3


def test_stored_subtopics_are_used(spark, tmp_path):
    e = Engine(spark, talk(spark), str(tmp_path / "a"))
    e.config = EngineConfig(preserve_recent_turns=1)
    rows = e.turns().select("session_id", "topic_id", "seq").collect()
    last = max(rows, key=lambda r: r.seq)
    own = sorted(r.seq for r in rows if r.topic_id == last.topic_id)
    assert len(own) >= 2
    before = {r.seq: r.zone for r in e.preview().collect()}
    parts = [("s", last.topic_id, "subtopic-0", "a", own[:1], False, "heuristic"), ("s", last.topic_id, "subtopic-1", "b", own[1:], True, "heuristic")]
    e.store.save("subtopics", spark.createDataFrame([(last[0], *p[1:]) for p in parts], "session_id string, topic_id string, subtopic_id string, label string, turn_sequences array<int>, is_current boolean, method string"))
    after = {r.seq: r.zone for r in e.preview().collect()}
    assert before[own[0]] == "older" and after[own[0]] == "dropped"
    assert all(after[k] == z for k, z in before.items() if k != own[0])
    old = Q.with_cutoff(e.turns(), 1).filter("not recent").drop("recent")
    assert [sorted(r.turn_sequences) for r in e._parts(old).filter(F.col("topic_id") == last.topic_id).orderBy("subtopic_id").collect()] == [own[:1], own[1:]]


def test_results_and_messages_without_a_log(spark, tmp_path):
    e = Engine(spark, talk(spark), str(tmp_path / "a"))
    done = e.compact_result().first()
    assert (done.compacted, done.compacted_count, done.cache_hits) == (True, 3, 0) and done.tokens_before == 2 * done.tokens_after and done.summary.startswith("Compacted 3 turns")
    copy = Engine(spark, talk(spark), str(tmp_path / "b"))
    copy.restore(e.state())
    assert {(r.turn_id, r.summary, r.tokens, r.original_tokens) for r in copy.store.load("summaries").collect()} == {(r.turn_id, r.summary, r.tokens, r.original_tokens) for r in e.store.load("summaries").collect()}
    other = spark.createDataFrame([("new", 0, "user", "hello"), ("new", 1, "assistant", None)], "session_id string, idx int, role string, content string")
    got = e.assemble(messages=other).filter("session_id = 'new'").orderBy("ord").collect()
    assert [(r.role, r.tokens, [(p.type, p.text) for p in r.parts]) for r in got] == [("user", 0, [("text", "hello")]), ("assistant", 0, [("text", "")])]
    assert TOOLS["context_config"](e, strategy="importance", max_tokens=5).max_tokens == 5 and e.context.strategy == "importance" and e.config.max_context_tokens == 128_000


def test_parts(spark, tmp_path):
    """Contents of every form: texts, lists with images, calls and odd elements, objects, nothing."""
    contents = ["plain 中文", [{"type": "text", "text": "abcd"}, {"type": "image"}, "raw", None, 5], {"a": 1}, None, [], [{"type": "toolCall", "name": "read", "arguments": {"path": "x" * 200}}, {"type": "toolCall", "input": {"a": 1}}], [{"type": "text", "text": 7}]]
    lines = [message("assistant", c, id=f"m{i}") for i, c in enumerate(contents)]
    rows = {int(r.entry_id[1:]): r for r in jsonl.read_sessions(spark, session(tmp_path, lines)).collect()}
    assert [rows[i].message_tokens for i in range(7)] == [3, 1 + 10 + 10 + 10 + 10, 0, 0, 0, 20, 10]
    assert [[(p.type, p.text) for p in rows[i].parts] for i in (0, 1, 3, 4)] == [[("text", "plain 中文")], [("text", "abcd"), ("image", None), ("text", "raw"), ("text", ""), ("text", "5")], [("text", "")], []]
    assert rows[5].call_texts == ['read({"path":"' + "x" * 91 + ")", "?({})"] and all(len(x) <= 106 for x in rows[5].call_texts)


def test_lines_of_split_files(spark, tmp_path):
    """Line numbers of a file that is read in many splits, beside small ones."""
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "big.jsonl").write_text("\n".join(f"line {i} " + "x" * (i % 70) for i in range(1, 3001)))
    (tmp_path / "in" / "small.jsonl").write_text("a\n\nb\r\n")
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    spark.conf.set("spark.sql.files.openCostInBytes", "100")
    try:
        rows = jsonl.raw_lines(spark, str(tmp_path / "in")).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sorted(r.line for r in rows if r.session_id == "big") == list(range(1, 3001))
    assert all(r.raw.startswith(f"line {r.line} ") for r in rows if r.session_id == "big")
    assert sorted((r.line, r.raw) for r in rows if r.session_id == "small") == [(1, "a"), (2, ""), (3, "b\r")]


def test_files_of_changed_sessions(spark, tmp_path):
    path = session(tmp_path, LINES)
    session(tmp_path, LINES[:5], "s2")
    e = Engine(spark, path, str(tmp_path / "out" / "store"))
    assert e.bootstrap() == 7
    import os

    (tmp_path / "in" / "s2.jsonl").write_text("\n".join(LINES[:7]))
    os.utime(tmp_path / "in" / "s2.jsonl", (2_000_000_000, 2_000_000_000))
    assert e.bootstrap() == 8 and {r.session_id: r.total_turns for r in e.stats().collect()} == {"s1": 2, "s2": 1}


def test_engine_files(spark, tmp_path):
    e = Engine(spark, session(tmp_path, LINES), str(tmp_path / "out" / "store"))
    assert e.bootstrap() == 6 and e.bootstrap() == 6
    assert [r.text for r in e.read_raw("u1").orderBy("line").collect()][2] == "[line 6] {bad"


def test_summarizer(spark):
    from turnlake.operators.assemble import compact

    def model(text, hint):
        if hint == "Turn #3":
            raise RuntimeError("no")
        return f"short {hint}"

    rows = compact(Q.turns(talk(spark)), EngineConfig(), None, model).collect()
    assert len(rows) == 3 and {r.method for r in rows} <= {"llm", "local"}
    assert all(r.summary.startswith("short") == (r.method == "llm") for r in rows)


def test_summarizer_is_given_the_turn_and_has_a_time(spark):
    import time

    from turnlake.operators.assemble import compact
    from turnlake.operators.summarize import summarize

    lines = talk(spark)
    cut = spark.createDataFrame([("s", f"u{i}", 1, "CUT", 1, 2, 3) for i in range(14)], "session_id string, turn_id string, msg_idx int, truncated_content string, truncated_tokens bigint, original_tokens bigint, original_chars int")
    rows = compact(Q.turns(lines), EngineConfig(), None, lambda text, hint: text, lines, cut.withColumn("session_id", F.lit(lines.first().session_id))).collect()
    assert all(r.summary.startswith("[Turn #") and "[User]: " in r.summary and "]: CUT\n[Assistant]: " in r.summary for r in rows)
    slow = spark.createDataFrame([("text", "hint")], "t string, h string")
    assert summarize(slow, lambda t, h: time.sleep(5) or "late", "t", "h", retries=0, timeout=0.2).first()["method"] == "local"


def test_rewriting_survives_a_failure(spark, tmp_path):
    s = Store(spark, str(tmp_path / "st"))
    turns = spark.createDataFrame([("s", 0), ("t", 0)], "session_id string, seq int")
    s.replace_sessions("turns", turns)
    s._move("index/turns", "index/turns.old")  # as a rewriting leaves it that ends between its renames
    assert s.sessions("turns").count() == 2
    s.vacuum("turns")
    assert s.sessions("turns").count() == 2 and not s._exists("index/turns.old") and not s._exists("index/turns.new")


def test_live_index(spark, tmp_path):
    """Sessions are rebuilt when an assistant has answered; the classifier is asked about their last turns; nothing runs after dispose()."""
    from turnlake.streaming.ingest import LiveIndex, classifier

    lines = talk(spark, 3).drop("ts")
    path = str(tmp_path / "in")
    for low, high in ((0, 2), (2, 6), (6, 8)):
        lines.filter((F.col("line") > low) & (F.col("line") <= high)).coalesce(1).write.mode("append").parquet(path)
    store = Store(spark, str(tmp_path / "store"))
    assert classifier(store, None) is None and classifier(store, len, EngineConfig(topic_aware=False)) is None
    seen = []

    def on_turns(rows):
        seen.append([(r.seq, r.message_count) for r in rows.collect()])
        classifier(store, lambda prompt: '{"subtopic": "x", "isNewSubtopic": true}')(rows)

    stream = spark.readStream.schema(lines.schema).option("maxFilesPerTrigger", 1).parquet(path).withColumn("ts", F.lit(None).cast("timestamp"))
    live = LiveIndex(stream, store, str(tmp_path / "c"), on_turns, availableNow=True)
    live.wait()
    live.dispose()
    assert not live.query.isActive
    assert seen == [[(1, 3)]] and store.sessions("turns").count() == 2 and store.sessions("lines").count() == 8
    assert [(r.seq, r.subtopic, r.is_new) for r in store.load("turn_classes").collect()] == [(1, "x", True)]


def test_store(spark, tmp_path):
    s = Store(spark, str(tmp_path / "st"))
    assert s.load("summaries") is None
    schema = "session_id string, turn_id string, summary string, tokens bigint, original_tokens bigint, method string"
    s.save("summaries", spark.createDataFrame([("s", "t", "one", 1, 2, "local"), ("s", "u", "x", 1, 2, "local")], schema))
    s.save("summaries", spark.createDataFrame([("s", "t", "two", 1, 2, "local")], schema))
    assert {(r.turn_id, r.summary) for r in s.load("summaries").collect()} == {("t", "two"), ("u", "x")}
    turns = spark.createDataFrame([("s", 0), ("s", 1), ("t", 0)], "session_id string, seq int")
    s.replace_sessions("turns", turns)
    s.replace_sessions("turns", turns.filter("session_id = 's'").filter("seq = 0"))
    for _ in range(2):
        assert sorted(map(tuple, s.sessions("turns").collect())) == [("s", 0), ("t", 0)]
        s.vacuum("turns")
    assert [tuple(r) for r in s.sessions("turns", turns.filter("session_id = 't'")).collect()] == [("t", 0)]
    assert index_path("a/b.jsonl") == "a/b.index" and index_path("a/b") == "a/b.index"


def test_stream(spark, tmp_path):
    from turnlake.streaming.ingest import index_batch, live_turns

    lines = talk(spark, 6).union(talk(spark, 3, "z")).drop("ts")
    path = str(tmp_path / "in")
    for low, high in ((0, 5), (5, 11), (11, 99)):
        lines.filter((F.col("line") > low) & (F.col("line") <= high)).coalesce(1).write.mode("append").parquet(path)
    want = {(r.session_id, r.seq): (r.turn_id, r.line_end, r.message_count, r.total_tokens) for r in Q.turns(lines.withColumn("ts", F.lit(None).cast("timestamp"))).collect()}
    got = {}

    def take(batch, _):
        for r in batch.collect():
            got[r.session_id, r.seq] = (r.turn_id, r.line_end, r.message_count, r.total_tokens)

    stream = spark.readStream.schema(lines.schema).option("maxFilesPerTrigger", 1).parquet(path)
    live_turns(stream).writeStream.foreachBatch(take).outputMode("update").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start().awaitTermination()
    assert got == want
    store = Store(spark, str(tmp_path / "store"))
    stream = spark.readStream.schema(lines.schema).option("maxFilesPerTrigger", 1).parquet(path).withColumn("ts", F.lit(None).cast("timestamp"))
    stream.writeStream.foreachBatch(index_batch(store)).option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start().awaitTermination()
    assert {(r.session_id, r.seq): (r.turn_id, r.line_end, r.message_count, r.total_tokens) for r in store.sessions("turns").collect()} == want


def test_live_topics(spark, tmp_path):
    from turnlake.streaming.ingest import assign, live_topics

    rows = spark.createDataFrame([("s", i, ["apple", "pear"] if i < 3 else ["iron", "zinc"]) for i in range(6)], "session_id string, seq int, terms array<string>")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    got = {}
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    live_topics(stream).writeStream.foreachBatch(lambda b, _: got.update({r.seq: r.topic_ord for r in b.collect()})).outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert [got[i] for i in range(6)] == [0, 0, 0, 1, 1, 1]
    assert assign([], 4, {"a": 1.0}, 0.05) == 4 and assign([{"a": 1.0}], 0, {}, 0.05) == 1
