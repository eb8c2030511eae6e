"""Substring dedup: paragraphs, found by MinHash banding and exact identity, verified by exact Jaccard, clustered by components.

Two kinds of paragraphs are cut from each text. Lines of MIN_WORDS words or more meet if they are equal or if one of 16 bands of
5 minhashes over their five-word shingles is equal; at a similarity of 0.8 a pair meets with probability 0.998. Pieces are
content-defined paragraphs: a cut stands before the word whose pair with the next has the least hash among REACH words to either
side, so a passage has the same cuts inside wherever it stands, and meets its copies by identity. Of each cluster the first
paragraph (least id, then position) stays, the others go; what goes counts only in runs of MIN_WORDS words or more.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnlake.llm import minhash
from turnlake.llm.common import BROADCAST_BYTES, Words, discard, free_name, join_small, mix, prepare, scratch, slices, tidy

REACH, MIN_WORDS, SHINGLE = 4, 16, 5
BANDS = minhash.Bands(16, 5, 11)
_U = np.uint64
_STEP = _U(0xD6E8FEB86659FD93)


def _spans(h: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64- and a 32-bit identity of each span of words."""
    up = np.full(len(h) + 1, _STEP, np.uint64)
    up[0] = 1
    up = np.multiply.accumulate(up)
    down = np.full(len(h) + 1, _U(pow(int(_STEP), -1, 1 << 64)), np.uint64)
    down[0] = 1
    down = np.multiply.accumulate(down)
    out = []
    for salt in (_U(0), _U(0xA5A5A5A5A5A5A5A5)):
        total = np.zeros(len(h) + 1, np.uint64)
        np.cumsum((h if not salt else mix(h ^ salt)) * up[:-1], out=total[1:])
        out.append(mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64)))
    return out[0].view(np.int64), (out[1] >> _U(33)).astype(np.int32)


def _lines(words: Words) -> np.ndarray:
    """Indices of the first words of lines and texts, and the number of words."""
    n = len(words.starts)
    breaks = np.flatnonzero(words.data == 10)
    at = np.concatenate([np.searchsorted(words.starts, breaks), words.first])
    at = np.unique(at)
    return np.append(at[at < n], n)


def _periodic(h: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """The first and the last of neighbouring words that have REACH words to either side, all in one run of a period of at most REACH.

    Inside such a run no pair's hash is the least, so it cuts by this rule, which looks at the run alone.
    """
    n = len(h)
    inside = np.zeros(n + 2, bool)
    for p in range(1, REACH + 1):
        if n > 2 * REACH:
            same = np.zeros(n + 1, np.int64)
            same[1 : n - p + 1] = (h[:-p] == h[p:]) & (doc[:-p] == doc[p:])
            np.cumsum(same, out=same)
            same[n - p + 1 :] = same[n - p]
            at = np.arange(REACH, n - REACH)
            inside[at + 1] |= same[at + REACH - p + 1] - same[at - REACH] == 2 * REACH - p + 1
    return inside[1:-1] & ~(inside[:-2] & inside[2:])


def _pieces(words: Words, h: np.ndarray) -> np.ndarray:
    n = len(h)
    pair = np.full(n, _U(0xFFFFFFFFFFFFFFFF))
    if n > 1:
        pair[:-1] = mix(h[:-1] * _STEP + h[1:])
    ends = words.first[1:]
    ends = ends[ends > words.first[:-1]]
    pair[ends - 1] = mix(h[ends - 1])
    doc = np.searchsorted(words.first, np.arange(n), "right") - 1
    at = np.arange(n) + REACH * (doc + 1)
    high = np.full(n + REACH * (len(words.first) + 1), _U(0xFFFFFFFFFFFFFFFF))
    high[at] = pair
    cut = np.ones(n, bool)
    for k in range(1, REACH + 1):
        cut &= pair < high[at - k]
        cut &= pair <= high[at + k]
    cut |= _periodic(h, doc)
    cut[words.first[:-1][words.first[:-1] < n]] = True
    return np.append(np.flatnonzero(cut), n)


def _shingles(h: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of each span, end to end, and where each span's begin; shorter spans have one of all their words."""
    rolled = np.zeros(len(h), np.uint64)
    for k in range(SHINGLE):
        rolled[: len(h) - k] = rolled[: len(h) - k] * _STEP + h[k:]
    rolled = mix(rolled)
    n = np.maximum(ends - starts - SHINGLE + 1, 1)
    begin = np.concatenate([[0], np.cumsum(n)])
    return rolled[np.repeat(starts - begin[:-1], n) + np.arange(begin[-1])], begin


def paragraphs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Paragraphs of whole texts: (line, doc, start, n, id, chk, again, bands).

    start and n count words; again marks a piece that its text has before; bands are for lines only.
    """
    prepare(docs.sparkSession)
    source = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text")).filter("doc is not null and text is not null")

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                words = Words(part.column("text"))
                if not len(words.starts):
                    continue
                h = words.hashes()
                doc_ids = part.column("doc").to_numpy()
                for line in (True, False):
                    edges = _lines(words) if line else _pieces(words, h)
                    starts, ends = edges[:-1], edges[1:]
                    if line:
                        long = ends - starts >= MIN_WORDS
                        starts, ends = starts[long], ends[long]
                        if not len(starts):
                            continue
                    doc = np.searchsorted(words.first, starts, "right") - 1
                    ids, chk = _spans(h, starts, ends)
                    if line:
                        bands = pa.ListArray.from_arrays(pa.array(np.arange(len(starts) + 1, dtype=np.int32) * BANDS.n), pa.array(BANDS.keys(*_shingles(h, starts, ends)).ravel()))
                    else:
                        bands = pa.nulls(len(starts), pa.list_(pa.int64()))
                    again = np.zeros(len(starts), bool)
                    if not line:
                        again[:] = True
                        again[np.unique(mix(ids.view(np.uint64) ^ mix(doc.astype(np.uint64) + _U(1))), return_index=True)[1]] = False
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(starts), line)), pa.array(doc_ids[doc]), pa.array((starts - words.first[doc]).astype(np.int32)), pa.array((ends - starts).astype(np.int32)), pa.array(ids), pa.array(chk), pa.array(again), bands], names=["line", "doc", "start", "n", "id", "chk", "again", "bands"])

    return source.mapInArrow(tidy(run), "line boolean, doc bigint, start int, n int, id bigint, chk int, again boolean, bands array<bigint>")


def line_shingles(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, s): the distinct shingle hashes of the lines wanted (id, doc, start); ids of docs are unique."""
    of_doc = scratch(wanted.groupBy("doc").agg(F.collect_list("start").alias("starts"), F.collect_list("id").alias("ids"), F.count("*").alias("n")), "wanted")
    size = of_doc.agg(F.sum(F.col("n") * 12 + 48)).first()[0] or 0
    of_doc = of_doc.drop("n")
    source = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))
    joined = source.join(F.broadcast(of_doc) if size <= BROADCAST_BYTES else of_doc, "doc").select("text", "starts", "ids")

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                words = Words(part.column("text"))
                edges = _lines(words)
                lists = part.column("starts").combine_chunks() if isinstance(part.column("starts"), pa.ChunkedArray) else part.column("starts")
                counts = lists.value_lengths().to_numpy()
                starts = lists.flatten().to_numpy() + np.repeat(words.first[:-1], counts)
                ends = edges[np.searchsorted(edges, starts, "right")]
                values, begin = _shingles(words.hashes(), starts, ends)
                sets = pa.ListArray.from_arrays(pa.array(begin.astype(np.int32)), pa.array(values.view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column("ids").flatten(), sets], names=["id", "s"])

    return joined.mapInArrow(tidy(run), "id bigint, s array<bigint>").select("id", F.array_distinct("s").alias("s"))


def line_classes(docs: DataFrame, units: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, component) of lines that have similar ones: components of all similar pairs of lines that share a band."""
    distinct = scratch(units.filter("line").groupBy("id").agg(F.first("bands").alias("bands"), F.min(F.struct("doc", "start")).alias("at")), "lines")

    def sets_of(wanted: DataFrame) -> DataFrame:
        at = wanted.join(distinct.select(F.col("id").alias("key"), "at"), "key").select(F.col("key").alias("id"), "at.doc", "at.start")
        return line_shingles(docs, at, id_col, text_col).withColumnRenamed("id", "key")

    found = scratch(minhash.links(distinct.select(F.col("id").alias("key"), "bands"), sets_of).toDF("id", "component"), "line-classes")
    discard(distinct)
    return found


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Runs of words that go: (id, start, end, n_words, component_id, kept_id), start and end in words of the whole text.

    component_id is the cluster of the run's first paragraph, kept_id the least document that keeps a copy (maybe the same one).
    Null ids, null and empty texts take no part; rows that repeat an id and text are one text. text_key is null, but for ids with several
    texts, where it is xxhash64 of the text that the positions are in; such texts stand under a number of their own, drawn by a hash, in
    the order that says what stays. An empty table gives no rows.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text")).filter("doc is not null and text is not null")
    text_hash = F.xxhash64("text")
    several = scratch(docs.groupBy("doc").agg(F.min(text_hash).alias("a"), F.max(text_hash).alias("b"), F.count("*").alias("n")).filter("n > 1").select("doc", (F.col("a") == F.col("b")).alias("same")), "several")
    own = None
    if not several.isEmpty():
        shared = join_small(docs, several, "doc", "inner", 9)
        once = shared.filter("same").dropDuplicates(["doc"]).select("doc", "text")
        own = shared.filter("not same").select("doc", text_hash.alias("text_key"), "text").dropDuplicates(["doc", "text_key"])
        own = scratch(own.withColumn("number", F.xxhash64("doc", "text_key", F.lit(1))), "several-texts")
        docs = join_small(docs, several.select("doc"), "doc", "left_anti", 8).union(once).union(own.select("number", "text"))
    units = scratch(paragraphs(docs, "doc", "text"), "units")
    near = line_classes(docs, units, "doc", "text")
    lines = units.filter("line").join(near, "id", "left").select("doc", "start", "n", F.coalesce("component", "id").alias("id"), F.when(F.col("component").isNull(), F.col("chk")).otherwise(0).alias("chk"))
    firsts = lines.groupBy("id", "chk").agg(F.min(F.struct("doc", "start")).alias("first"), F.max(F.struct("doc", "start")).alias("last")).filter("first <> last").drop("last")
    gone = lines.join(firsts, ["id", "chk"]).filter("doc <> first.doc or start <> first.start").select("doc", "start", "n", "id", F.col("first.doc").alias("kept"))
    pieces = units.filter("not line").select("doc", "start", "n", "id", "chk", "again")
    owners = pieces.filter("not again").groupBy("id", "chk").agg(F.min("doc").alias("kept"), F.max("doc").alias("last")).filter("kept <> last").drop("last")
    gone = gone.union(pieces.join(owners, ["id", "chk"], "left").filter("again or doc <> kept").select("doc", "start", "n", "id", F.coalesce("kept", "doc").alias("kept")))
    order = Window.partitionBy("doc").orderBy("start", "n", "id")
    top = F.max(F.col("start") + F.col("n")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    runs = gone.withColumn("new", F.when(F.col("start") <= top, 0).otherwise(1)).withColumn("run", F.sum("new").over(order))
    merged = runs.groupBy("doc", "run").agg(F.min("start").alias("start"), F.max(F.col("start") + F.col("n")).alias("end"), F.min(F.struct("start", "id")).alias("lead"), F.min("kept").alias("kept_id"))
    merged = merged.withColumn("n_words", F.col("end") - F.col("start")).filter(F.col("n_words") >= MIN_WORDS)
    out = merged.select("doc", "start", "end", "n_words", F.col("lead.id").alias("component_id"), "kept_id", F.lit(None).cast("long").alias("text_key"))
    if own is not None:
        known = own.select(F.col("number").alias("doc"), F.col("doc").alias("of"), F.col("text_key").alias("key"))
        out = join_small(out, known, "doc", "left", 24).select(F.coalesce("of", "doc").alias("doc"), "start", "end", "n_words", "component_id", "kept_id", F.col("key").alias("text_key"))
        out = join_small(out, known.select(F.col("doc").alias("kept_id"), F.col("of").alias("kept")), "kept_id", "left", 16).withColumn("kept_id", F.coalesce("kept", "kept_id"))
    return out.select(F.col("doc").alias(id_col), "start", "end", "n_words", "component_id", "kept_id", "text_key")


def remove(docs: DataFrame, runs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the words of the runs; a document that loses all its words goes, all others stay as they are."""
    key, cuts, size = (free_name(docs, x) for x in ("cut_id", "cuts", "n_cuts"))
    spans = runs.groupBy(F.col(id_col).alias(key), "text_key").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"), F.count("*").alias(size))
    spans = scratch(spans.groupBy(key).agg(F.collect_list(F.struct("text_key", "spans")).alias(cuts), F.sum(size).alias(size)), "cuts")
    total = spans.agg(F.sum(F.col(size) * 8 + 48)).first()[0] or 0
    spans = spans.drop(size)
    joined = docs.join(F.broadcast(spans) if total <= BROADCAST_BYTES else spans, docs[id_col] == F.col(key), "left").drop(key)
    text = F.col(text_col).cast("string")
    mine = F.filter(cuts, lambda x: x.text_key.isNull() | (x.text_key == F.xxhash64(text)))
    joined = joined.withColumn(cuts, F.get(F.transform(mine, lambda x: x.spans), F.lit(0)))
    at, names = docs.columns.index(text_col), docs.columns

    def run(batches):
        for batch in batches:
            texts, spans = batch.column(at).to_pylist(), batch.column(len(names)).to_pylist()
            stay = []
            for i, c in enumerate(spans):
                if c:
                    words = Words(pa.array([texts[i]], pa.string()))
                    raw, n = words.data.tobytes(), len(words.starts)
                    keep, last = [], 0
                    for x in c:
                        keep.append(raw[last : words.starts[x["start"]]])
                        last = words.starts[x["end"]] if x["end"] < n else len(raw)
                    texts[i] = b"".join([*keep, raw[last:]]).decode("utf-8", "replace")
                    if texts[i].isspace() or not texts[i]:
                        continue
                stay.append(i)
            columns = [pa.array(texts, pa.string()) if k == at else batch.column(k) for k in range(len(names))]
            yield pa.RecordBatch.from_arrays(columns, names=names).take(pa.array(stay, pa.int64()))

    return joined.mapInArrow(tidy(run), ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema))
