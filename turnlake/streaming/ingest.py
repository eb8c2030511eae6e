"""Streams of message lines: the index of touched sessions, turn by turn, and topics of new turns as they complete."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import IntegerType, StructField, StructType

from turnlake.config import EngineConfig, TopicConfig
from turnlake.functions import answers
from turnlake.operators import summarize as S
from turnlake.operators import topics as G
from turnlake.operators import turns as Q
from turnlake.stores import Store, materialise, shared_path

_TURN = "session_id string, seq int, turn_id string, line_start int, line_end int, message_count bigint, total_tokens bigint, tool_call_count bigint"
_STATE = "seq int, turn_id string, line_start int, line_end int, message_count bigint, total_tokens bigint, tool_call_count bigint"


def live_turns(lines: DataFrame) -> DataFrame:
    """Turns of a stream of typed lines (update mode): whenever a turn changes, its row as it is now.

    A session's open turn is the state, so the memory of a session doesn't grow; lines of a session must come in order over batches,
    within one in any order. A line that was seen counts no more, so a replayed batch changes nothing.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = list(state.get) if state.exists else None
        rows = pd.concat(frames).sort_values("line")
        changed: dict[int, list] = {}
        for line, entry, role, tokens, calls in zip(rows["line"], rows["entry_id"], rows["role"], rows["tokens"], rows["calls"]):
            if now is not None and line <= now[3]:
                continue
            if role == "user":
                now = [now[0] + 1 if now else 0, entry, int(line), int(line), 1, int(tokens), 0]
            elif now is None:
                continue
            else:
                now[3], now[4], now[5], now[6] = int(line), now[4] + 1, now[5] + int(tokens), now[6] + int(calls)
            changed[now[0]] = list(now)
        if now is not None:
            state.update(tuple(now))
        if changed:
            yield pd.DataFrame([[key[0], *row] for row in changed.values()], columns=[c.split()[0] for c in _TURN.split(", ")])

    source = lines.filter("role is not null").select("session_id", "line", "entry_id", "role", "tokens", F.greatest(F.coalesce(F.size("tool_calls"), F.lit(0)), F.lit(0)).alias("calls"))
    return source.groupBy("session_id").applyInPandasWithState(step, _TURN, _STATE, "update", GroupStateTimeout.NoTimeout)


def assign(vectors: list[dict[str, float]], topic: int, new: dict[str, float], threshold: float) -> int:
    """The topic of a new turn by its mean similarity to the last ones: theirs, or the next."""
    if not vectors:
        return topic
    import math

    docs = [*vectors, new]
    df: dict[str, int] = {}
    for d in docs:
        for t in d:
            df[t] = df.get(t, 0) + 1
    idf = {t: math.log(len(docs) / (n + 1)) + 1 for t, n in df.items()}
    weigh = lambda d: {t: v * idf[t] for t, v in d.items()}
    norm = lambda d: math.sqrt(sum(v * v for v in d.values()))
    x, sims = weigh(new), []
    for d in vectors:
        y = weigh(d)
        size = norm(x) * norm(y)
        sims.append(min(1.0, sum(v * y.get(t, 0.0) for t, v in x.items()) / size) if size else 0.0)
    return topic if sum(sims) / len(sims) >= threshold else topic + 1


def live_topics(turn_terms: DataFrame, config: TopicConfig = TopicConfig()) -> DataFrame:
    """(session_id, seq, topic_ord) of a stream of complete turns (session_id, seq, terms), each once and in order.

    A new turn stays in the last topic if its mean similarity to the last turns reaches the threshold, else it opens one; topics
    aren't merged. The state is the last turns' term frequencies.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        import json

        last, topic, kept = state.get if state.exists else (-1, 0, "[]")
        vectors, out = json.loads(kept), []
        for seq, terms in pd.concat(frames).sort_values("seq")[["seq", "terms"]].itertuples(index=False):
            if seq <= last:
                continue
            size = max(len(terms), 1)
            new: dict[str, float] = {}
            for t in terms:
                new[t] = new.get(t, 0.0) + 1 / size
            topic = assign(vectors, topic, new, config.similarity_threshold)
            vectors = [*vectors, new][-config.reference_turns :]
            last = int(seq)
            out.append([key[0], last, topic])
        state.update((last, topic, json.dumps(vectors)))
        if out:
            yield pd.DataFrame(out, columns=["session_id", "seq", "topic_ord"])

    return turn_terms.select("session_id", "seq", "terms").groupBy("session_id").applyInPandasWithState(step, "session_id string, seq int, topic_ord int", "seq int, topic int, vectors string", "update", GroupStateTimeout.NoTimeout)


def run_available(rows: DataFrame, transform, keys: list[str], latest: str) -> DataFrame:
    """transform(stream of rows) run over all that is there; of every key, the row that is last by latest.

    rows are written to the shared folder as the stream's source, and what each batch emits is appended there.
    """
    spark = rows.sparkSession
    source = materialise(rows, "stream-in")
    stream = spark.readStream.schema(source.schema).parquet(source.inputFiles()[0].rsplit("/", 1)[0])
    root = shared_path(spark, "stream-out")
    out = transform(stream)

    def append(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/rows/batch={number}")

    out.writeStream.foreachBatch(append).outputMode("update").option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    order = Window.partitionBy(*keys).orderBy(F.desc(latest), F.desc("batch"))
    found = spark.read.schema(StructType([*out.schema.fields, StructField("batch", IntegerType())])).parquet(f"{root}/rows")
    return found.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n", "batch")


def index_batch(store: Store, on_turns=None):
    """A foreachBatch sink that adds new lines to the store and rebuilds the index of the sessions they belong to.

    The same as a full build of those sessions, whatever way a file was split; a batch that comes again changes nothing. A session is
    rebuilt when a batch brings an assistant's message of it, which ends a turn; its other lines are kept until then. A line is stored
    once, whatever the number of batches, and a session is rebuilt from what turns need of its lines, without their texts. on_turns, if
    given, gets the last turn of every session that was rebuilt, for a second sink such as classification.
    """

    def run(batch: DataFrame, _: int) -> None:
        if batch.isEmpty():
            return
        store.add_new("lines", batch)
        ended = materialise(batch.filter("role = 'assistant'").select("session_id").distinct(), "ended")
        if ended.isEmpty():
            return
        turn_rows = materialise(Q.turns(store.sessions("lines", ended)), "turns")
        store.replace_sessions("turns", G.with_topics(turn_rows, G.segments(turn_rows)))
        if on_turns:
            on_turns(Q.recent(store.sessions("turns", ended), 1))

    return run


def classifier(store: Store, model, config: EngineConfig = EngineConfig()):
    """An on_turns for index_batch(): asks the model for the sub-topic of each last turn and saves its answers as "turn_classes".

    None, and so nothing to call, where sessions aren't looked at by topic or there is no model. Answers that can't be read are left out.
    """
    if not config.topic_aware or model is None:
        return None

    def run(last: DataFrame) -> None:
        asked = S.ask(S.class_prompts(last), model)
        read = asked.select("session_id", "seq", answers.turn_class(F.col("response")).alias("c")).filter("c is not null")
        store.save("turn_classes", materialise(read.select("session_id", "seq", "c.subtopic", "c.is_new"), "classes"))

    return run


class LiveIndex:
    """A stream of typed lines that keeps a store's index up to date, until it is disposed of."""

    def __init__(self, lines: DataFrame, store: Store, checkpoint: str, on_turns=None, **trigger):
        writer = lines.writeStream.foreachBatch(index_batch(store, on_turns)).option("checkpointLocation", checkpoint)
        self.query = (writer.trigger(**trigger) if trigger else writer).start()

    def wait(self) -> None:
        self.query.awaitTermination()

    def dispose(self) -> None:
        """Stop the stream; what it has read is indexed, and another one goes on from its checkpoint."""
        self.query.stop()
