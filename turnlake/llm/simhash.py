"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints at most 2 bits apart have a variant in common among those that differ from each in at most 1 bit. Every distinct
fingerprint emits its 65 variants; rows meet on a variant by shuffle; neighbours in a variant's sorted rows are verified. Members
of a variant's bucket are all within 2 bits of each other and a bucket holds at most 65 distinct fingerprints, so linking
neighbours keeps every component and no bucket is hot.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnlake.llm.common import Words, components, join_small, prepare, scratch, slices, tidy

SEED = 42
#: Words of a shingle, where nothing else is asked for.
WIDTH = 5
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
#: For each byte, eight counters of one byte, one for each bit.
_LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view(np.uint64)[:, 0].copy()


def _fingerprint(hashes: np.ndarray) -> int:
    n = len(hashes)
    if not n:
        return 0
    lanes = _LANES[hashes.view(np.uint8).reshape(n, 8)]
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 255):
        counts += np.ascontiguousarray(lanes[at : at + 255].sum(axis=0, dtype=np.uint64)).view(np.uint8)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def _of_batch(words: Words, width: int) -> list[int]:
    out = []
    digest = xxhash.xxh64_intdigest
    text, first = words.data.tobytes(), words.first
    for k in range(len(first) - 1):
        a, b = first[k], first[k + 1]
        n = b - a
        if not n:
            out.append(0)
            continue
        starts, ends = words.starts[a:b], words.ends[a:b]
        whole = text[starts[0] : ends[-1]]
        if (starts[1:] - ends[:-1] == 1).all() and not (b"\n" in whole or b"\t" in whole or b"\r" in whole or b"\v" in whole or b"\f" in whole):
            low, high = (starts - starts[0]).tolist(), (ends - starts[0]).tolist()
        else:
            parts = whole.split()
            whole = b" ".join(parts)
            size = np.fromiter(map(len, parts), np.int64, n)
            high = np.cumsum(size + 1) - 1
            low, high = (high - size).tolist(), high.tolist()
        spans = zip(low, high[width - 1 :]) if n >= width else ((0, len(whole)),)
        hashes = np.fromiter((digest(whole[x:y], SEED) for x, y in spans), np.uint64)
        out.append(_fingerprint(hashes))
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """Per row of docs: (id, fp), fp the 64-bit SimHash of the text's width-word shingles as a signed long.

    A-Z are lower-cased; words are runs of other characters than space and U+0009 to U+000D. Fewer words than width: one shingle
    of all of them; none, or a null text: 0. Whole texts, one pass.
    """
    prepare(docs.sparkSession)
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                found = np.array(_of_batch(Words(part.column("text"), fold=_FOLD), width), np.uint64)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(found.view(np.int64))], names=["id", "fp"])

    return source.mapInArrow(tidy(run), f"id {source.schema['id'].dataType.simpleString()}, fp bigint")


def links(distinct: DataFrame, radius: int = 2) -> DataFrame:
    """Pairs (u, v) of distinct fingerprints (column fp) that span all components of fingerprints within radius 2 (or 1, 0)."""
    if radius not in (0, 1, 2):
        raise ValueError("balls of half the radius are served for radius 0, 1 and 2")
    if not radius:
        return distinct.select(F.col("fp").alias("u"), F.col("fp").alias("v")).limit(0)
    flips = F.array(F.lit(0).cast("long"), *[F.lit(1 << i if i < 63 else -(1 << 63)).cast("long") for i in range(64)])
    balls = distinct.select("fp", F.explode(flips).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("variant"))
    before = F.lag("fp").over(Window.partitionBy("variant").orderBy("fp"))
    met = balls.select("fp", before.alias("other")).filter("other is not null")
    return met.filter(F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= radius).select(F.col("fp").alias("u"), F.col("other").alias("v")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, radius: int = 2) -> DataFrame:
    """Per row of docs: id, fingerprint (16 hex digits), component_id: the least id reachable over links of at most radius bits.

    Copies share a fingerprint and meet as one; rows without any word have fingerprint zero and link like others. Null ids are no
    candidates for component_id (null if a component has no other). Repeated rows give repeated rows; an empty table gives none.
    """
    found = scratch(fingerprints(docs, id_col, text_col, width), "simhash")
    distinct = scratch(found.groupBy("fp").agg(F.min("id").alias("least")), "simhash-distinct")
    parts = components(links(distinct.select("fp"), radius))
    joined = distinct.join(parts.select(F.col("node").alias("fp"), "component"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    joined = scratch(joined, "simhash-component")
    ids = joined.groupBy("component").agg(F.min("least").alias("component_id"))
    of = scratch(joined.join(ids, "component").select("fp", "component_id"), "simhash-of")
    out = join_small(found, of, "fp", "inner", 16)
    return out.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, radius: int = 2) -> DataFrame:
    """docs with one row of each component of near-duplicates, that of the least id; rows without an id stay.

    Of rows that repeat an id, one stays.
    """
    return keep_least(docs, near_duplicates(docs, id_col, text_col, width, radius), id_col)


def keep_least(docs: DataFrame, found: DataFrame, id_col: str) -> DataFrame:
    """docs without the rows whose component_id in found is another id; of rows that repeat an id, one stays."""
    found = scratch(found.select(id_col, "component_id"), "simhash-rows").filter(F.col(id_col).isNotNull())
    own = found.groupBy(id_col).agg(F.bool_or(F.col(id_col) == F.col("component_id")).alias("own"))
    gone = scratch(own.filter("not own").select(id_col), "simhash-gone")
    repeated = scratch(found.groupBy(id_col).count().filter("count > 1").select(id_col), "simhash-repeated")
    stay = join_small(docs, gone, id_col, "left_anti", 8)
    if repeated.isEmpty():
        return stay
    once = join_small(stay, repeated, id_col, "left_anti", 8)
    return once.unionByName(join_small(stay, repeated, id_col, "left_semi", 8).dropDuplicates([id_col])).select(*docs.columns)
