"""Links between sets whose Jaccard similarity is 4/5 or more: MinHash bands, exact verification, components.

Sets that share a band meet in a bucket. In every bucket all sets are compared with the one of least key, an order that all buckets
share, so near copies meet the same one everywhere. Members that this leaves in another component are compared with DRAWS others drawn
from the bucket, which is enough for nearly all of a large group of near copies. Where members of one bucket are then still in different
components, its sets are searched once more, exactly and without pairing the bucket's members: two sets of that similarity share one of their rarest tokens, so
sets meet on these alone (prefix filtering, rarest tokens first). Members of a large group that resemble each other without being
similar have rare tokens of their own and don't meet. Nothing is collected in one task and no bucket is capped.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnlake.llm.common import components, discard, join_small, mix, scratch, tidy

#: Tokens are counted in so many buckets, to sort a set's tokens by rarity; any order that all sets share gives the same links.
RARITY_BITS = 20
#: Members of a bucket that are drawn for those whom the first one leaves in other components.
DRAWS = 8
_U = np.uint64
_STEP = _U(0xD6E8FEB86659FD93)


class Bands:
    """Keys of bands of minhashes: n bands of rows minhashes each."""

    def __init__(self, n: int, rows: int, seed: int):
        self.n, self.rows = n, rows
        self.factors = np.random.default_rng(seed).integers(1, 2**63, n * rows, dtype=np.uint64) << _U(1) | _U(1)

    def keys(self, values: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """A row of keys for each set; sets lie end to end in values from begin[i] on, and none is empty."""
        out = np.empty((len(begin) - 1, self.n), np.uint64)
        for b in range(self.n):
            key = np.full(len(begin) - 1, _U(b + 1))
            for factor in self.factors[b * self.rows : (b + 1) * self.rows]:
                key = mix(key * _STEP + np.minimum.reduceat(values * factor, begin[:-1]))
            out[:, b] = key
        return out.view(np.int64)


def is_similar(s: str = "s", t: str = "t") -> Column:
    """Whether two arrays of distinct tokens have a Jaccard similarity of 4/5 or more."""
    common = F.size(F.array_intersect(s, t))
    return 5 * common >= 4 * (F.size(s) + F.size(t) - common)


def _rarity(sets: DataFrame) -> np.ndarray:
    """How often tokens of each hash bucket occur in sets (key, of, s): 2 ** RARITY_BITS numbers at any input size."""

    def run(batches):
        total = np.zeros(1 << RARITY_BITS, np.int64)
        for batch in batches:
            values = batch.column("s").flatten().to_numpy().view(np.uint64)
            total += np.bincount((mix(values) >> _U(64 - RARITY_BITS)).astype(np.int64), minlength=len(total))
        on = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(on), pa.array(total[on])], names=["bucket", "n"])

    table = sets.select("s").mapInArrow(tidy(run), "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(1 << RARITY_BITS, np.int64)
    out[table.column("bucket").to_numpy()] = table.column("n").to_numpy()
    return out.astype(np.uint32)


def prefix_pairs(sets: DataFrame) -> DataFrame:
    """Distinct pairs (u, v) of sets (key, of, s) in different components `of` that may be similar; every similar one is there.

    Of n tokens, rarest first, a set looks up the first n - ceil(4n/5) + 1, and offers the first n - ceil(8n/9) + 1 to sets that are
    no smaller; places of the token met bound the overlap.
    """
    shared = sets.sparkSession.sparkContext.broadcast(_rarity(sets))

    def run(batches):
        for batch in batches:
            lists = batch.column("s")
            n = lists.value_lengths().to_numpy()
            values = lists.flatten().to_numpy().view(np.uint64)
            row = np.repeat(np.arange(len(n)), n)
            order = np.lexsort((values, shared.value[(mix(values) >> _U(64 - RARITY_BITS)).astype(np.int64)], row))
            at = np.arange(len(values)) - np.repeat(np.cumsum(n) - n, n)
            on = at < np.repeat(n - -(-4 * n // 5) + 1, n)
            row, at, token = row[on], at[on], values[order][on]
            offered = at < (n - -(-8 * n // 9) + 1)[row]
            key, of = batch.column("key").to_numpy(), batch.column("of").to_numpy()
            columns = [token.view(np.int64), key[row], of[row], n[row].astype(np.int32), at.astype(np.int32), offered]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["token", "key", "of", "n", "at", "offered"])

    rows = scratch(sets.mapInArrow(tidy(run), "token bigint, key bigint, of bigint, n int, at int, offered boolean"), "prefixes")
    several = rows.groupBy("token").agg(F.min("of").alias("a"), F.max("of").alias("b"), F.max("offered").alias("offered")).filter("a <> b and offered").select("token")
    rows = rows.join(several, "token", "left_semi")
    names = ["token", "key", "of", "n", "at"]
    a, b = rows.filter("offered").select(*[F.col(x).alias(f"{x}_u") for x in names]), rows.select(*[F.col(x).alias(f"{x}_v") for x in names])
    most = F.least(F.col("n_u") - F.col("at_u"), F.col("n_v") - F.col("at_v"))
    fits = (F.col("of_u") != F.col("of_v")) & (F.col("n_u") <= F.col("n_v")) & (5 * F.col("n_u") >= 4 * F.col("n_v")) & (9 * most >= 4 * (F.col("n_u") + F.col("n_v")))
    met = a.join(b, (F.col("token_u") == F.col("token_v")) & fits)
    return met.select(F.least("key_u", "key_v").alias("u"), F.greatest("key_u", "key_v").alias("v")).distinct()


def links(units: DataFrame, sets_of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(node, component) of the keys that have similar ones, for units (key, bands), keys distinct and no number of bands limited.

    sets_of gives (key, s), the distinct tokens of the keys of a table (key); s must not be empty. Components are those of all similar
    pairs that share a band.
    """
    met = units.select("key", F.explode("bands").alias("band"))
    least = scratch(met.groupBy("band").agg(F.min("key").alias("v"), F.max("key").alias("w")).filter("v <> w").select("band", "v"), "buckets")
    pairs = scratch(join_small(met, least, "band", "inner", 16).filter("key <> v").select(F.col("key").alias("u"), "v").distinct(), "pairs")
    discard(least)
    wanted = scratch(pairs.select(F.explode(F.array("u", "v")).alias("key")).distinct(), "wanted")
    sets = scratch(sets_of(wanted), "sets")
    discard(wanted)

    def verified(some: DataFrame) -> DataFrame:
        return scratch(some.join(sets.toDF("u", "s"), "u").join(sets.toDF("v", "t"), "v").filter(is_similar()).select("u", "v"), "near")

    def labelled(rows: DataFrame, parts: DataFrame) -> DataFrame:
        """rows (u, v) with the components of both."""
        side = lambda x: parts.select(F.col("node").alias(x), F.col("component").alias(f"of_{x}"))
        told = rows.join(side("u"), "u", "left").join(side("v"), "v", "left")
        return told.select("u", "v", F.coalesce("of_u", "u").alias("of_u"), F.coalesce("of_v", "v").alias("of_v"))

    def merged(parts: DataFrame, near: DataFrame, members: DataFrame) -> DataFrame:
        """parts (node, component) with links (of_u, of_v) between components; members (key, of) may be components of their own."""
        joins = components(near.select(F.col("of_u").alias("u"), F.col("of_v").alias("v"))).toDF("of", "into")
        known = parts.toDF("node", "of").union(members.select("key", "of")).distinct()
        return scratch(known.join(joins, "of", "left").select("node", F.coalesce("into", "of").alias("component")), "parts")

    def members(told: DataFrame) -> DataFrame:
        return told.select(F.col("u").alias("key"), F.col("of_u").alias("of")).union(told.select("v", "of_v")).distinct()

    near = verified(pairs)
    parts = components(near)
    discard(near)
    told = scratch(labelled(pairs, parts), "told")
    stray = told.filter("of_u <> of_v")
    if stray.isEmpty():
        return parts
    # Draws of a bucket by the least of u ^ hash: an order of its own for each bucket and draw.
    salts = [F.xxhash64("v", F.lit(k)) for k in range(DRAWS)]
    drawn = told.groupBy("v").agg(*[F.min(F.col("u").bitwiseXOR(h)).alias(f"d{k}") for k, h in enumerate(salts)])
    drawn = scratch(drawn.select("v", F.array(*[F.col(f"d{k}").bitwiseXOR(h) for k, h in enumerate(salts)]).alias("draws")), "drawn")
    more = join_small(stray.select("u", "v"), drawn, "v", "inner", 12 * DRAWS).select("u", F.explode("draws").alias("v")).filter("u <> v")
    more = scratch(labelled(more.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), parts).filter("of_u <> of_v"), "more")
    near = verified(more.select("u", "v"))
    if not near.isEmpty():
        parts = merged(parts, near.join(more, ["u", "v"]), members(more))
        discard(told)
        told = scratch(labelled(pairs, parts), "told")
    for table in (near, more, pairs, drawn):
        discard(table)
    rows = told.join(told.filter("of_u <> of_v").select("v").distinct(), "v", "left_semi")
    open_ = scratch(members(rows), "open")
    discard(told)
    if open_.isEmpty():
        return parts
    found = scratch(prefix_pairs(open_.join(sets, "key").select("key", "of", "s")), "found")
    near = verified(found)
    discard(found)
    discard(sets)
    side = lambda x: open_.select(F.col("key").alias(x), F.col("of").alias(f"of_{x}"))
    return merged(parts, near.join(side("u"), "u").join(side("v"), "v"), open_)
