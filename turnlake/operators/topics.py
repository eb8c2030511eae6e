"""Topics: boundaries by similarity of term windows, islands, merging of short ones; sub-topics by signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnlake.config import TopicConfig
from turnlake.functions import text as T
from turnlake.functions import answers
from turnlake.stores import dealt, materialise

#: Turns of a task that weighs terms: each becomes some twenty terms, and each term six rows.
TURNS_A_TASK = 5_000


def turn_terms(turn_rows: DataFrame) -> DataFrame:
    """(session_id, seq, terms), written once."""
    return materialise(turn_rows.select("session_id", "seq", T.terms(T.turn_text(F.col("user_preview"), F.col("assistant_preview"), F.col("tools_used"))).alias("terms")), "terms")


def tfidf(turn_rows: DataFrame) -> DataFrame:
    """(session_id, seq, term, tf, df, n_turns, weight) of turns' terms."""
    return _weights(turn_terms(turn_rows))


def _weights(terms: DataFrame) -> DataFrame:
    each = dealt(terms, terms.count(), TURNS_A_TASK, "session_id")
    n = F.count("*").over(Window.partitionBy("session_id"))
    rows = each.withColumn("n_turns", n).select("session_id", "seq", "n_turns", F.size("terms").alias("size"), F.explode("terms").alias("term"))
    counts = rows.groupBy("session_id", "term", "seq").agg((F.count("*") / F.first("size")).alias("tf"), F.first("n_turns").alias("n_turns"))
    df = F.count("*").over(Window.partitionBy("session_id", "term"))
    return counts.withColumn("df", df).withColumn("weight", F.col("tf") * (F.log(F.col("n_turns") / (F.col("df") + 1)) + 1))


def similarities(turn_rows: DataFrame, config: TopicConfig = TopicConfig()) -> DataFrame:
    """(session_id, seq, similarity) for every turn but the first: of the windows before it and from it on.

    A turn's terms go to the boundaries whose windows hold it, so windows are sums over an explosion of at most 2 * window rows.
    """
    last = F.col("n_turns") - 1
    w = F.greatest(F.lit(1), F.least(F.lit(config.window), F.floor(F.col("n_turns") / 2)))
    t = F.col("seq").cast("long")
    span = lambda a, b: F.when(a <= b, F.sequence(a, b)).otherwise(F.array().cast("array<bigint>"))
    sides = F.concat(
        F.transform(span(t + 1, F.least(t + w, last)), lambda i: F.struct(i.alias("i"), F.lit(1).alias("a"), F.lit(0).alias("b"))),
        F.transform(span(F.greatest(F.lit(1).cast("long"), t - w + 1), F.least(t, last)), lambda i: F.struct(i.alias("i"), F.lit(0).alias("a"), F.lit(1).alias("b"))),
    )
    terms = turn_terms(turn_rows)
    rows = _weights(terms).select("session_id", "term", "weight", F.explode(sides).alias("s"))
    sums = rows.groupBy("session_id", F.col("s.i").alias("i"), "term").agg(F.sum(F.col("weight") * F.col("s.a")).alias("x"), F.sum(F.col("weight") * F.col("s.b")).alias("y"))
    dots = sums.groupBy("session_id", "i").agg(F.sum(F.col("x") * F.col("y")).alias("xy"), F.sum(F.col("x") * F.col("x")).alias("xx"), F.sum(F.col("y") * F.col("y")).alias("yy"))
    sim = F.when((F.col("xx") > 0) & (F.col("yy") > 0), F.least(F.lit(1.0), F.col("xy") / (F.sqrt("xx") * F.sqrt("yy"))))
    found = dots.select("session_id", F.col("i").cast("int").alias("seq"), sim.alias("similarity"))
    return terms.filter("seq > 0").select("session_id", "seq").join(found, ["session_id", "seq"], "left").withColumn("similarity", F.coalesce("similarity", F.lit(0.0)))


def boundaries(turn_rows: DataFrame, config: TopicConfig = TopicConfig()) -> DataFrame:
    """(session_id, seq, method, similarity, confidence) where a turn opens a topic."""
    low = similarities(turn_rows, config).filter(F.round("similarity", 12) < config.similarity_threshold)
    return low.select("session_id", "seq", F.lit("embedding").alias("method"), "similarity", F.least(F.lit(1.0), 1 - F.col("similarity") / config.similarity_threshold).alias("confidence"))


def confirm(found: DataFrame, responses: DataFrame) -> DataFrame:
    """boundaries with a model's answers (session_id, seq, response): a no drops one, a yes lends it labels and confidence 0.9 at least.

    Answers that say neither, and missing ones, change nothing.
    """
    parsed = responses.select("session_id", "seq", answers.boundary(F.col("response")).alias("r"))
    out = found.join(parsed, ["session_id", "seq"], "left").filter(F.coalesce(F.col("r.is_boundary"), F.lit(True)))
    yes = F.col("r").isNotNull()
    return out.select(
        "session_id", "seq", F.when(yes, "llm").otherwise(F.col("method")).alias("method"), "similarity", F.when(yes, F.greatest("confidence", F.lit(0.9))).otherwise(F.col("confidence")).alias("confidence"),
        F.col("r.prev_label").alias("prev_label"), F.col("r.next_label").alias("next_label"),
    )


_ISLAND = "array<struct<start:int,size:int,ord:int>>"


def merge_short(islands: Column, least: int) -> Column:
    """Islands (start, size, ord) in order, each of fewer than least turns merged into its larger neighbour, the earlier among equals.

    One fold: a short island waits for its next; it joins the one before if that is no smaller than the next, which then stands for
    itself. The merged keep the start and number of the first.
    """
    make = lambda start, size, ord_: F.struct(start.cast("int").alias("start"), size.cast("int").alias("size"), ord_.cast("int").alias("ord"))
    none = make(F.lit(0), F.lit(0), F.lit(0))
    grown = lambda done, by: F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(make(F.element_at(done, -1)["start"], F.element_at(done, -1)["size"] + by, F.element_at(done, -1)["ord"])))

    def step(state: Column, e: Column) -> Column:
        done, p = state["done"], state["wait"]
        joins_next = (p["size"] > 0) & ((F.size(done) == 0) | (F.coalesce(F.try_element_at(done, F.lit(-1))["size"], F.lit(0)) < e["size"]))
        joins_last = (p["size"] > 0) & ~joins_next
        item = F.when(joins_next, make(p["start"], p["size"] + e["size"], p["ord"])).otherwise(e)
        kept = F.when(joins_last, grown(done, p["size"])).otherwise(done)
        return F.struct(F.when(item["size"] < least, kept).otherwise(F.concat(kept, F.array(item))).alias("done"), F.when(item["size"] < least, item).otherwise(none).alias("wait"))

    def finish(state: Column) -> Column:
        done, p = state["done"], state["wait"]
        return F.when(p["size"] == 0, done).when(F.size(done) == 0, F.array(p)).otherwise(grown(done, p["size"]))

    return F.aggregate(islands, F.struct(F.array().cast(_ISLAND).alias("done"), none.alias("wait")), step, finish)


def _islands(rows: DataFrame, keys: list[str], least: int, *more: str) -> DataFrame:
    """(keys, seq, ord, part, parts) for rows (keys, seq, opens): ord is an island's own number, part its place after merging; more: other columns of rows."""
    order = Window.partitionBy(*keys).orderBy("seq")
    marked = rows.withColumn("pos", F.row_number().over(order) - 1).withColumn("ord", F.sum(F.col("opens").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    sizes = marked.groupBy(*keys, "ord").agg(F.min("pos").alias("start"), F.count("*").alias("size"))
    folded = sizes.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.col("start").cast("int"), F.col("size").cast("int"), F.col("ord").cast("int")))).alias("islands"))
    merged = folded.withColumn("m", merge_short(F.col("islands").cast(_ISLAND), least)).select(*keys, F.size("m").alias("parts"), F.posexplode("m").alias("part", "island"))
    spread = merged.select(*keys, "part", "parts", F.col("island.ord").alias("ord"), F.explode(F.sequence(F.col("island.start"), F.col("island.start") + F.col("island.size") - 1)).alias("pos"))
    return marked.select(*keys, "seq", "pos", *more).join(spread, [*keys, "pos"]).drop("pos")


def segments(turn_rows: DataFrame, config: TopicConfig = TopicConfig(), found: DataFrame | None = None) -> DataFrame:
    """(session_id, seq, topic_ord, ord, is_current): the topic of every turn; found: other boundaries than by similarity."""
    found = boundaries(turn_rows, config) if found is None else found
    rows = turn_rows.select("session_id", "seq").join(found.select("session_id", "seq", F.lit(True).alias("opens")), ["session_id", "seq"], "left").fillna(False, ["opens"])
    out = _islands(rows, ["session_id"], config.min_turns_per_topic)
    n = F.count("*").over(Window.partitionBy("session_id"))
    return out.select("session_id", "seq", F.col("part").alias("topic_ord"), "ord", ((F.col("part") == F.col("parts") - 1) & (n > 1)).alias("is_current"))


def with_topics(turn_rows: DataFrame, segment_rows: DataFrame) -> DataFrame:
    """turn_rows with topic_ord, topic_id, label and is_current."""
    joined = turn_rows.join(segment_rows, ["session_id", "seq"])
    first = Window.partitionBy("session_id", "topic_ord").orderBy("seq")
    joined = joined.withColumns({"topic_id": F.concat(F.lit("topic-"), F.first("turn_id").over(first)), "_first": F.first("user_preview").over(first)})
    return joined.withColumn("label", T.topic_label(F.col("_first"), F.col("ord"))).drop("_first", "ord")


def topics(topic_turns: DataFrame) -> DataFrame:
    """One row per topic of turns with topics."""
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("seq", "turn_id"))), lambda x: x["turn_id"])
    return topic_turns.groupBy("session_id", "topic_ord", "topic_id", "label", "is_current").agg(
        ordered.alias("turn_ids"), F.lit("active").alias("status"), F.sum("total_tokens").alias("total_tokens"), F.count("*").alias("turn_count"), F.min_by("start_time", "seq").alias("start_time"), F.max_by("end_time", "seq").alias("end_time")
    )


def signals(topic_turns: DataFrame) -> DataFrame:
    """(session_id, topic_id, seq, score) of turns but a topic's first: time gap, change of tools, a long question after a short one."""
    order = Window.partitionBy("session_id", "topic_id").orderBy("seq")
    return topic_turns.select("session_id", "topic_id", "seq", _score().alias("score"), F.row_number().over(order).alias("_n")).filter("_n > 1").drop("_n")


def _score() -> Column:
    order = Window.partitionBy("session_id", "topic_id").orderBy("seq")
    # Milliseconds are rounded, as SQL's epoch_ms does; unix_millis would cut them off.
    micros = lambda t: F.round(F.unix_micros(t), -3)
    gap = (micros(F.col("start_time")) - micros(F.lag("end_time").over(order))) / 60_000_000
    before, now = F.lag("tools_used").over(order), F.col("tools_used")
    shared = F.size(F.array_intersect(before, now)) / F.size(F.array_union(before, now))
    both = (F.size(before) > 0) & (F.size(now) > 0)
    return (
        F.when(gap > 30, 3).when(gap > 10, 2).otherwise(0)
        + F.when(both & (shared == 0), 2).when(both & (shared < 0.3), 1).otherwise(0)
        + F.when((F.char_length(F.lag("user_preview").over(order)) < 30) & (F.char_length("user_preview") > 80), 1).otherwise(0)
    )


def subtopics(topic_turns: DataFrame, least: int = 2, boundary: int = 3) -> DataFrame:
    """(session_id, topic_id, subtopic_id, label, turn_sequences, is_current) by signals; topics of two turns at most have one."""
    n = F.count("*").over(Window.partitionBy("session_id", "topic_id"))
    place = F.row_number().over(Window.partitionBy("session_id", "topic_id").orderBy("seq"))
    rows = topic_turns.select("session_id", "topic_id", "seq", "user_preview", n.alias("_n"), ((_score() >= boundary) & (place > 1)).alias("opens"))
    rows = rows.withColumn("opens", F.coalesce("opens", F.lit(False)) & (F.col("_n") > 2))
    parts = _islands(rows, ["session_id", "topic_id"], least, "user_preview", "_n")
    out = parts.groupBy("session_id", "topic_id", "part", "parts", "ord", "_n").agg(F.sort_array(F.collect_list("seq")).alias("turn_sequences"), F.min_by("user_preview", "seq").alias("_first"))
    head = F.substring("_first", 1, 40)
    label = F.when(head != "", head).when(F.col("_n") <= 2, "conversation").otherwise(F.concat(F.lit("Sub-topic "), (F.col("ord") + 1).cast("string")))
    return out.select("session_id", "topic_id", F.concat(F.lit("subtopic-"), F.col("ord").cast("string")).alias("subtopic_id"), label.alias("label"), "turn_sequences", (F.col("part") == F.col("parts") - 1).alias("is_current"))


def current_subtopic(parts: DataFrame) -> DataFrame:
    """The current sub-topic of each topic that has several."""
    n = F.count("*").over(Window.partitionBy("session_id", "topic_id"))
    return parts.withColumn("_n", n).filter("is_current and _n > 1").drop("_n")


def time_chunks(topic_turns: DataFrame, size: int = 5) -> DataFrame:
    """Sub-topics of so many turns each, where nothing else divides a topic."""
    order = Window.partitionBy("session_id", "topic_id").orderBy("seq")
    rows = topic_turns.select("session_id", "topic_id", "seq", F.floor((F.row_number().over(order) - 1) / size).alias("chunk"), F.count("*").over(Window.partitionBy("session_id", "topic_id")).alias("_n"))
    out = rows.groupBy("session_id", "topic_id", "chunk", "_n").agg(F.sort_array(F.collect_list("seq")).alias("turn_sequences"))
    label = F.concat(F.lit("Turns "), F.element_at("turn_sequences", 1).cast("string"), F.lit("-"), F.element_at("turn_sequences", -1).cast("string"))
    return out.select("session_id", "topic_id", F.concat(F.lit("chunk-"), F.col("chunk").cast("string")).alias("subtopic_id"), label.alias("label"), "turn_sequences", ((F.col("chunk") + 1) * size >= F.col("_n")).alias("is_current"))


def classified(topic_turns: DataFrame, responses: DataFrame) -> DataFrame:
    """topic_turns with subtopic_id and subtopic_label by a model's answers (session_id, seq, response), turn after turn.

    An answer that opens a sub-topic, or a topic's first, opens one; others stay in the one before; unreadable ones change nothing.
    """
    parsed = responses.select("session_id", "seq", answers.turn_class(F.col("response")).alias("c"))
    rows = topic_turns.join(parsed, ["session_id", "seq"], "left").filter("c is not null")
    order = Window.partitionBy("session_id", "topic_id").orderBy("seq")
    running = order.rowsBetween(Window.unboundedPreceding, 0)
    opens = F.col("c.is_new") | (F.row_number().over(order) == 1)
    rows = rows.withColumn("_opens", opens).withColumn("_k", F.sum(F.col("_opens").cast("int")).over(running) - 1)
    label = F.last(F.when(F.col("_opens"), F.col("c.subtopic")), ignorenulls=True).over(running)
    return rows.withColumn("subtopic_label", label).withColumn("subtopic_id", F.concat("topic_id", F.lit("-sub-"), F.col("_k").cast("string"))).drop("c", "_opens", "_k")
