"""Cases of findings: what failed before."""

import datetime

import duckdb
import pytest

from pyspark.sql import functions as F

from turnlake import catalog
from turnlake.operators import topics as G
from turnlake.operators import turns as Q
from turnlake.plans.engine import Engine
from turnlake.sources.messages import from_messages
from turnlake.stores import Store
from turnlake.streaming.ingest import index_batch


def talk(spark, sessions, turns):
    rows = [(f"s{s}", 2 * t + k + 1, f"s{s}-{2 * t + k}", ("user", "assistant")[k], f"words{t % 7} of{k} session{s} number{t}") for s in range(sessions) for t in range(turns) for k in range(2)]
    return from_messages(spark.createDataFrame(rows, "session_id string, line int, entry_id string, role string, text string"))


def test_gaps_are_of_rounded_milliseconds(spark, tmp_path):
    """Gaps at 10 and 30 minutes and fractions of a millisecond around them, against SQL; also before 1970."""
    second, rows = datetime.timedelta(seconds=1), []
    for user, (year, minutes, end, start) in enumerate((y, m, a, b) for y in (1969, 2024) for m in (10, 30) for a in (0, 400, 500, 600) for b in (0, 400, 499, 500, 600)):
        at = datetime.datetime(year, 3, 1)
        rows += [(user * 10, at + second * end / 1e6, user * 30, "view", None), (user * 10 + 1, at + second * (minutes * 60 + start / 1e6), user * 30, "view", None)]
    spark.createDataFrame(rows, "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, props string").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    c = duckdb.connect()
    c.sql(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    want = c.sql(f"SELECT session_id, seq, score FROM ({catalog.SQL['subtopic_signals']})").fetchall()
    got = [tuple(r) for r in catalog.QUERIES["subtopic_signals"](spark, str(tmp_path)).select("session_id", "seq", "score").collect()]
    assert len(want) == 80 and sorted(got) == sorted(want)


def test_terms_are_dealt_over_tasks_by_their_number(spark, monkeypatch):
    """No task holds many more turns than it should, however few bytes they have; figures don't depend on it."""
    turns = Q.turns(talk(spark, 60, 10)).cache()
    whole = sorted(map(tuple, G.similarities(turns).select("session_id", "seq", F.round("similarity", 9)).collect()))
    monkeypatch.setattr(G, "TURNS_A_TASK", 20, raising=False)
    held = [r.n for r in G.tfidf(turns).groupBy(F.spark_partition_id()).agg(F.count_distinct("session_id", "seq").alias("n")).collect()]
    assert sum(held) == 600 and len(held) > 15 and max(held) <= 100
    assert sorted(map(tuple, G.similarities(turns).select("session_id", "seq", F.round("similarity", 9)).collect())) == whole


def test_reading_a_turn_takes_its_session_only(spark, tmp_path, monkeypatch):
    seen, recover = [], Q.recover
    monkeypatch.setattr(Q, "recover", lambda lines, found: seen.append({r.session_id for r in lines.collect()}) or recover(lines, found))
    e = Engine(spark, talk(spark, 4, 3), str(tmp_path / "store"))
    for session in ("s2", None):
        assert [(r.line, r.text) for r in e.read_raw("s2-2", session).sort("line").collect()] == [(3, "[line 3] words1 of0 session2 number1"), (4, "[line 4] words1 of1 session2 number1")]
        assert [r.line for r in e.recover("s2-2", session).sort("line").collect()] == [3, 4]
    assert seen == [{"s2"}] * 4


def test_truncated_contexts_find_topics_once(spark, monkeypatch):
    calls, found = [], catalog._topic_turns
    monkeypatch.setattr(catalog, "_topic_turns", lambda *a: calls.append(a) or found(*a))
    catalog.assemble_truncated(spark, "/root/testdata/sf0.001")
    assert len(calls) == 1


def test_batches_store_each_line_once(spark, tmp_path, monkeypatch):
    """Also where a batch comes again, after a failure between its lines and its turns too."""
    lines, store = talk(spark, 3, 4).cache(), Store(spark, str(tmp_path))
    step, replace = index_batch(store), store.replace_sessions
    step(lines.filter("line <= 3"), 0)

    def fails(*_):
        raise OSError

    monkeypatch.setattr(store, "replace_sessions", fails)
    with pytest.raises(OSError):
        step(lines.filter("line > 3").union(lines.filter("line = 4")), 1)
    monkeypatch.setattr(store, "replace_sessions", replace)
    columns = ["session_id", "seq", "turn_id", "line_start", "line_end", "message_count", "total_tokens", "user_preview"]
    want = sorted(map(tuple, Q.turns(lines).select(columns).collect()))
    for k in (1, 2):
        step(lines.filter("line > 3"), k)
        assert sorted(map(tuple, store.sessions("turns").select(columns).collect())) == want
        assert spark.read.parquet(f"{tmp_path}/index/lines").count() == 24
    store.vacuum("lines")
    assert sorted(map(str, store.sessions("lines").select(lines.columns).collect())) == sorted(map(str, lines.collect()))


def test_subtopics_take_one_join(spark):
    """Turns meet their sub-topics; signals, previews and numbers of turns are carried along."""
    found = G.subtopics(Q.turns(talk(spark, 3, 4)).withColumn("topic_id", F.lit("all")))
    assert [len(r.turn_sequences) for r in found.collect()] == [4, 4, 4]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1
