"""Near-duplicates by SimHash, and from a Jaccard similarity of 0.8 on by MinHash banding and exact Jaccard; components of both.

Texts are sets of five-word shingles. Two texts of similarity s meet in a band with probability 1 - (1 - s ** 6) ** 25, which is 0.9995
at 0.8; SimHash balls of radius 2 meet such a pair hardly ever. What meets is compared by the exact similarity of the whole sets. Equal
sets are one from the start, so a bucket holds distinct sets only. SimHash counts how often a text has a shingle, which sets don't tell: where
a radius is given, texts with fingerprints at most so many bits apart are linked too, whatever their sets, so neither method's links are lost.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnlake.llm import minhash, simhash
from turnlake.llm.common import Words, components, discard, join_small, mix, prepare, scratch, slices, tidy
from turnlake.llm.simhash import _FOLD, keep_least
from turnlake.llm.substring import SHINGLE, _shingles, _spans

BANDS = minhash.Bands(25, 6, 13)
_STEP = np.uint64(0xD6E8FEB86659FD93)


def shingle_sets(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted, end to end, and where each text's begin (and the end). Texts without words have none.

    Words are those of texts folded to lower case. Fewer words than SHINGLE: one shingle of all of them.
    """
    h, size = words.hashes(), np.diff(words.first)
    some = np.flatnonzero(size)
    if not len(some):
        return np.zeros(0, np.uint64), np.zeros(len(size) + 1, np.int64)
    starts, ends = words.first[:-1][some], words.first[1:][some]
    values, begin = _shingles(np.append(h, np.zeros(SHINGLE, np.uint64)), starts, ends)
    short = size[some] < SHINGLE
    values[begin[:-1][short]] = _spans(h, starts, ends)[0].view(np.uint64)[short]
    sets = [np.unique(values[a:b]) for a, b in zip(begin[:-1], begin[1:])]
    n = np.zeros(len(size), np.int64)
    n[some] = [len(x) for x in sets]
    return np.concatenate(sets), np.concatenate([[0], np.cumsum(n)])


def _keys(values: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """An identity of each set."""
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(mix(values ^ _STEP), out=total[1:])
    return mix(total[begin[1:]] - total[begin[:-1]]).view(np.int64)


def _lists(values: np.ndarray, begin: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(begin.astype(np.int32)), pa.array(values.view(np.int64)))


def sketches(docs: DataFrame, prints: bool = False) -> DataFrame:
    """Per row of docs (id, text): id, key and bands; no bands for texts without words. With prints: fp, as simhash.fingerprints gives it."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                words = Words(part.column("text"), fold=_FOLD)
                values, begin = shingle_sets(words)
                n = np.diff(begin)
                some = np.flatnonzero(n)
                bands = BANDS.keys(values, np.append(begin[:-1][some], len(values))) if len(some) else np.zeros((0, BANDS.n), np.int64)
                edges = np.concatenate([[0], np.cumsum((n > 0) * BANDS.n)])
                columns = [part.column("id"), pa.array(_keys(values, begin)), _lists(bands.ravel(), edges)]
                if prints:
                    columns.append(pa.array(np.array(simhash._of_batch(words, simhash.WIDTH), np.uint64).view(np.int64)))
                yield pa.RecordBatch.from_arrays(columns, names=["id", "key", "bands", "fp"][: len(columns)])

    return docs.mapInArrow(tidy(run), f"id {docs.schema['id'].dataType.simpleString()}, key bigint, bands array<bigint>{', fp bigint' if prints else ''}")


def sets_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(key, s): the sets of the keys wanted."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                values, begin = shingle_sets(Words(part.column("text"), fold=_FOLD))
                yield pa.RecordBatch.from_arrays([pa.array(_keys(values, begin)), _lists(values, begin)], names=["key", "s"])

    found = join_small(docs.select("text").mapInArrow(tidy(run), "key bigint, s array<bigint>"), wanted, "key", "left_semi", 8)
    return found.groupBy("key").agg(F.first("s").alias("s"))


def linked_by_prints(of: DataFrame, prints: DataFrame, radius: int) -> DataFrame:
    """of (key, component), written, with those components in one whose texts have fingerprints within the radius, or that such texts
    connect; prints: all different pairs (key, fp), written.

    Most links of fingerprints lie within a component; only those between two are searched for components.
    """
    groups = scratch(prints.join(of.select("key", "component").hint("merge"), "key").select("fp", "component").distinct(), "print-groups")
    least = scratch(groups.groupBy("fp").agg(F.min("component").alias("u"), F.max("component").alias("w")), "print-least")
    equal = join_small(groups, scratch(least.filter("u <> w").select("fp", "u"), "print-equal"), "fp", "inner", 16).select("u", F.col("component").alias("v"))
    pairs = scratch(simhash.links(least.select("fp"), radius).toDF("fp", "other"), "print-links")
    side = scratch(join_small(least.select("fp", "u"), pairs, "fp", "inner", 16).select(F.col("other").alias("fp"), F.col("u").alias("v")), "print-sides")
    near = join_small(least.select("fp", "u"), side, "fp", "inner", 16).select("u", "v")
    edges = scratch(equal.union(near).filter("u <> v").distinct(), "print-edges")
    for table in (groups, least, pairs, side):
        discard(table)
    parts = scratch(components(edges).toDF("component", "into"), "print-parts")
    return join_small(of, parts, "component", "left", 16).withColumn("component", F.coalesce("into", "component")).drop("into")


def similar_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int | None = None) -> DataFrame:
    """Per row of docs: id, component_id: the least id reachable over pairs of a Jaccard similarity of 0.8 or more, or, where a radius
    (0 to 2) is given, with SimHash fingerprints at most so many bits apart.

    Texts without words and null texts are alike. Null ids are no candidates for component_id. Repeated rows count as often; an empty
    table gives none.
    """
    prepare(docs.sparkSession)
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    found = scratch(sketches(source, radius is not None), "sketches")
    distinct = scratch(found.groupBy("key").agg(F.min("id").alias("least"), F.first("bands").alias("bands")), "sketches-distinct")
    parts = scratch(minhash.links(distinct.select("key", "bands"), lambda wanted: sets_of(source, wanted)), "similar-links")
    joined = distinct.select("key", "least").join(parts.select(F.col("node").alias("key"), "component"), "key", "left")
    joined = scratch(joined.withColumn("component", F.coalesce("component", "key")), "similar-component")
    discard(distinct)
    discard(parts)
    if radius is not None:
        prints = scratch(found.select("key", "fp").distinct(), "prints")
        told = scratch(linked_by_prints(joined, prints, radius), "similar-component")
        discard(prints)
        discard(joined)
        joined = told
    ids = joined.groupBy("component").agg(F.min("least").alias("component_id"))
    of = scratch(joined.join(ids, "component").select("key", "component_id"), "similar-of")
    discard(joined)
    return join_small(found.select("id", "key"), of, "key", "inner", 16).select(F.col("id").alias(id_col), "component_id")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int | None = None) -> DataFrame:
    """docs with one row of each component of similar texts, that of the least id; rows without an id stay. Of rows that repeat an id, one stays."""
    return keep_least(docs, similar_components(docs, id_col, text_col, radius), id_col)
