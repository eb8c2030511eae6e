"""Quality rules with n-gram perplexity: a modified Kneser-Ney bigram model of words, counted by Spark over all documents.

Words are hashed to SYMBOLS symbols, and a text begins with a symbol of its own. Texts are gathered in chunks of about COUNTED words,
which are written as packed symbols, about two bytes a word. A chunk sends its different bigrams as sorted packed arrays, dealt out by
a hash of the bigram, so what is gathered grows with the corpus and no word's bigrams meet in one task. Where they are counted, each
chunk is answered with a list of the counts of its bigrams, in the order in which it has sent them, and all its words are scored with
these: whatever the number of bigrams, none is left out. Every bigram that occurs twice or more has its own part of the probability. One
that occurs once has been seen in the very text that is judged and nowhere else, so its mass goes to the back-off weight of its context,
and probabilities sum to one. Only discounts and three numbers by symbol are sent to all tasks (16 * SYMBOLS bytes at any corpus size).
Documents are rejected outside their language's band of log-perplexity: below LOW times the median of the language's documents, or above
their upper quartile by HIGH times its distance from the median. Copies make each other likely, so texts that are equal count once, and
neither bound looks at the lower half, where groups of near copies lie: the lower bound is for texts that repeat themselves.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnlake.llm.common import SPACE, Words, discard, join_small, mix, prepare, release, scratch, slices, tidy

#: Bits of a symbol; bigrams that a model of fit() keeps at most, judge() has no such bound.
BITS, KEPT, LOW, HIGH = 20, 1 << 21, 0.2, 5.0
SYMBOLS = 1 << BITS
#: A text's mean varies the more, the fewer words it has: bands widen by a factor, the root of 1 + SHORT / words.
SHORT = 40
WINDOW, LEAST_WORDS, MOST_REPEATED = 8, 20, 30
#: Bigrams that a task counts before it passes them on, a chunk; bytes of text for each of the parts that bigrams are dealt out to;
#: segments of a table by symbol; the largest count that the histogram tells apart; tables that are summed at a time.
COUNTED, PART_BYTES, PART_BITS, SEGMENTS, TOP, FOLD = 2_500_000, 48 << 20, (3, 16), 64, 1 << 12, 256
#: Bits of each of the three numbers of a table "kinds".
KIND_BITS = BITS + 1
_U = np.uint64
_FACTOR = 0x9E3779B97F4A7C15 & ((1 << 2 * BITS) - 1) | 1
_INVERSE = pow(_FACTOR, -1, 1 << 2 * BITS)
_ALL = _U((1 << 2 * BITS) - 1)


def symbols(words: Words, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(before, own): the symbols of each word and of the word before it, 0 before a text's first."""
    own = (mix(h) % _U(SYMBOLS - 1) + _U(1)).astype(np.uint64)
    return _before(own, words.first), own


def _before(own: np.ndarray, first: np.ndarray) -> np.ndarray:
    before = np.zeros(len(own), own.dtype)
    before[1:] = own[:-1]
    before[first[:-1][first[:-1] < first[1:]]] = 0
    return before


def _dealt(gram: np.ndarray) -> np.ndarray:
    """A bigram's place in the order by hash, another number of as many bits."""
    gram = gram ^ (gram >> _U(BITS))
    return (gram * _U(_FACTOR)) & _ALL


def _gram(place: np.ndarray) -> np.ndarray:
    gram = (place * _U(_INVERSE)) & _ALL
    return gram ^ (gram >> _U(BITS))


def _pack(values: np.ndarray, width: int) -> bytes:
    """The low bytes of numbers, first bytes first, so that compression finds the zeros."""
    return np.ascontiguousarray(values.astype(np.uint64).view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _unpack(data: bytes, width: int) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :width] = planes.T
    return out.view(np.uint64)[:, 0]


def _pack_sorted(values: np.ndarray) -> bytes:
    return _pack(np.diff(values, prepend=_U(0)), 5)


def _unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(_unpack(data, 5), dtype=np.uint64)


def _squeezed(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + pa.Codec("zstd", compression_level=3).compress(data, asbytes=True)


def _loose(data: bytes) -> bytes:
    return pa.Codec("zstd").decompress(data[8:], int.from_bytes(data[:8], "little"), asbytes=True)


def _pack_words(own: np.ndarray) -> tuple[bytes, bytes]:
    """Symbols of a chunk by frequency, and each word's place among these."""
    n = np.bincount(own, minlength=SYMBOLS)
    order = np.argsort(-n, kind="stable")[: np.count_nonzero(n)]
    rank = np.zeros(SYMBOLS, np.uint32)
    rank[order] = np.arange(len(order), dtype=np.uint32)
    return _squeezed(_pack(order, 3)), _squeezed(_pack(rank[own], 3))


def _unpack_words(table: bytes, words: bytes) -> np.ndarray:
    return _unpack(_loose(table), 3).astype(np.uint32)[_unpack(_loose(words), 3).view(np.int64)]


def _ranked(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different values, sorted, and where each value is among them; np.unique takes twice the memory."""
    order = np.argsort(values)
    values = values[order]
    edge = np.append(True, values[1:] != values[:-1]) if len(values) else np.zeros(0, bool)
    at = np.empty(len(values), np.int32)
    at[order] = np.cumsum(edge, dtype=np.int32) - 1
    return values[edge], at


def _summed(places: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    place, n = np.concatenate(places), np.concatenate(counts)
    order = np.argsort(place, kind="stable")
    place, n = place[order], n[order]
    edge = np.flatnonzero(np.append(True, place[1:] != place[:-1])) if len(place) else np.zeros(0, np.int64)
    return place[edge], np.add.reduceat(n, edge) if len(edge) else n


def once_of_each(source: DataFrame) -> DataFrame:
    """source (id, text ...) with counted: false where another row has the same text, but for that of the least id."""
    hashed = source.withColumn("text_hash", F.xxhash64("text"))
    several = hashed.groupBy("text_hash").agg(F.min("id").alias("text_keep"), F.count("*").alias("n")).filter("n > 1").select("text_hash", "text_keep")
    joined = join_small(hashed, scratch(several, "copies"), "text_hash", "left", 24)
    return joined.select(*source.columns, (F.col("text_keep").isNull() | F.col("text_keep").eqNullSafe(F.col("id"))).alias("counted"))


def _parts(size: int) -> int:
    """Bits of the number of parts that the bigrams of so many bytes of text are dealt out to."""
    return min(max(int(size // PART_BYTES).bit_length(), PART_BITS[0]), PART_BITS[1])


def _cut(place: np.ndarray, bits: int) -> list[tuple[int, int, int]]:
    """(part, from, to) of the parts that sorted places are in."""
    edges = np.searchsorted(place, np.arange((1 << bits) + 1, dtype=np.uint64) << _U(2 * BITS - bits))
    return [(i, a, b) for i, (a, b) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist())) if b > a]


def _tables(part: int, place: np.ndarray, n: np.ndarray) -> list[tuple]:
    """Rows (kind, part, of, keys, counts) of the tables "times" and "first", "last" and "kinds" by symbol, of a part's bigrams."""
    gram = _gram(place)
    before, symbol = (gram >> _U(BITS)).astype(np.int64), (gram & _U(SYMBOLS - 1)).astype(np.int64)
    found = [("times", 0, part, b"", _squeezed(_pack(np.bincount(np.minimum(n, _U(TOP)).astype(np.int64), minlength=TOP + 1), 8)))]
    kinds = np.zeros(SYMBOLS, np.uint64)
    for k in range(3):
        of = n == k + 1 if k < 2 else n > 2
        kinds |= np.bincount(before[of], minlength=SYMBOLS).astype(np.uint64) << _U(KIND_BITS * k)
    for kind, one in (("first", np.bincount(before, n.astype(np.float64), SYMBOLS)), ("last", np.bincount(symbol, minlength=SYMBOLS)), ("kinds", kinds)):
        found += [(kind, i, part, b"", _squeezed(_pack(x, 8))) for i, x in enumerate(np.split(one.astype(np.uint64), SEGMENTS))]
    return found


_COUNTS = "kind string, part int, of bigint, keys binary, counts binary"


def _rows(found: list[tuple]) -> pa.Table:
    return pa.table([pa.array(x, t) for x, t in zip(zip(*found), (pa.string(), pa.int32(), pa.int64(), pa.binary(), pa.binary()))], ["kind", "part", "of", "keys", "counts"])


def count_bigrams(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """What the model is made of, packed: rows (kind, part, of, keys, counts) of all bigrams of whole texts.

    kind "gram": bigrams of two occurrences or more; "first" and "last": for a segment of symbols, occurrences as a bigram's first
    word, and the number of different words before it; "kinds": how many different bigrams it begins that occur once, twice, and more
    often, KIND_BITS bits each (they are SYMBOLS at most); "times": how many bigrams occur 0, 1, 2 ... TOP times or more; of is the
    part of the bigrams that they come from.
    """
    prepare(docs.sparkSession)
    source = docs.select(F.col(text_col).cast("string").alias("text")).filter("text is not null")
    bits = _parts(source.agg(F.sum(F.octet_length("text"))).first()[0] or 0)

    def tally(batches):
        held, n = [], 0

        def rows():
            place, count = np.unique(np.concatenate(held), return_counts=True)
            parts = _cut(place, bits)
            columns = [pa.array([i for i, _, _ in parts], pa.int32()), pa.array([_pack_sorted(place[a:b]) for _, a, b in parts], pa.binary()), pa.array([_pack(count[a:b], 4) for _, a, b in parts], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=["part", "keys", "counts"])

        for batch in batches:
            for part in slices(batch, "text"):
                words = Words(part.column("text"))
                before, own = symbols(words, words.hashes())
                held.append(_dealt(before << _U(BITS) | own))
                n += len(own)
                if n > COUNTED:
                    yield rows()
                    held, n = [], 0
        if n:
            yield rows()

    def merge(table: pa.Table) -> pa.Table:
        place, n = _summed([_unpack_sorted(x) for x in table.column("keys").to_pylist()], [_unpack(x, 4) for x in table.column("counts").to_pylist()])
        part, often = table.column("part")[0].as_py(), n > 1
        return _rows([("gram", part, part, _pack_sorted(place[often]), _pack(n[often], 4)), *_tables(part, place, n)])

    packed = source.mapInArrow(tidy(tally), "part int, keys binary, counts binary")
    return packed.groupBy("part").applyInArrow(merge, _COUNTS)


def chunks(source: DataFrame) -> DataFrame:
    """source (id, code, text, counted) in rows of about COUNTED words: chunk, a number of its own, size (bytes of text), ids, codes,
    counted and counts (those of base_counts, kind by kind) of its texts, and its words packed."""

    def run(batches):
        held, own, n, size = [], [], 0, 0

        def row():
            ids, codes, counted = (pa.concat_arrays([part.column(x) for part, _ in held]) for x in ("id", "code", "counted"))
            counts = pa.array(np.concatenate([c for _, c in held], axis=1).ravel())
            lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (ids, codes, counted, counts)]
            table, words = _pack_words(np.concatenate(own))
            number = int.from_bytes(os.urandom(8), "little") >> 1
            columns = [pa.array([number]), pa.array([size]), *lists, pa.array([table], pa.binary()), pa.array([words], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=["chunk", "size", "ids", "codes", "counted", "counts", "symbols", "words"])

        for batch in batches:
            for part in slices(batch, "text"):
                column = part.column("text").fill_null("")
                words = Words(column)
                h = words.hashes()
                held.append((part.select(["id", "code", "counted"]), np.array(base_counts(column, words, h), np.int64)))
                own.append(symbols(words, h)[1].astype(np.uint32))
                n, size = n + len(h), size + len(words.data)
                if n > COUNTED:
                    yield row()
                    held, own, n, size = [], [], 0, 0
        if held:
            yield row()

    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(tidy(run), f"chunk bigint, size bigint, ids array<{kind}>, codes array<string>, counted array<boolean>, counts array<bigint>, symbols binary, words binary")


def _bigrams(symbols: bytes, words: bytes, n_words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A chunk's different bigrams, in the order by hash, and where each word's is among them."""
    own = _unpack_words(symbols, words)
    before = _before(own, np.concatenate([[0], np.cumsum(n_words)]))
    gram = before.astype(np.uint64)
    gram <<= _U(BITS)
    gram |= own
    del before, own
    return _ranked(_dealt(gram))


def answers(stored: DataFrame) -> DataFrame:
    """Rows (kind, part, of, keys, counts) as of count_bigrams, but for "answer" instead of "gram": for the chunk `of` the numbers of
    occurrences of all its bigrams of a part, in their order. Texts that don't count are answered too."""
    bits = _parts(stored.agg(F.sum("size")).first()[0] or 0)

    def ask(batches):
        for batch in batches:
            for i in range(len(batch)):
                chunk, texts, table, words = (batch.column(x)[i].as_py() for x in ("chunk", "counted", "symbols", "words"))
                n_words = batch.column("counts")[i].values.to_numpy()[: len(texts)]
                place, at = _bigrams(table, words, n_words)
                n = np.bincount(at[np.repeat(np.array(texts, bool), n_words)], minlength=len(place))
                parts = _cut(place, bits)
                columns = [pa.array([p for p, _, _ in parts], pa.int32()), pa.array([chunk] * len(parts), pa.int64())]
                columns += [pa.array([_squeezed(_pack_sorted(place[a:b])) for _, a, b in parts], pa.binary()), pa.array([_squeezed(_pack(n[a:b], 4)) for _, a, b in parts], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["part", "chunk", "keys", "counts"])

    def merge(table: pa.Table) -> pa.Table:
        release()
        part, asked = table.column("part")[0].as_py(), table.column("chunk").to_pylist()
        keys = [_unpack_sorted(_loose(x.as_py())) for x in table.column("keys")]
        place, n = _summed(keys, [_unpack(_loose(x.as_py()), 4) for x in table.column("counts")])
        found = [("answer", part, chunk, b"", _squeezed(_pack(n[np.searchsorted(place, k)], 5))) for chunk, k in zip(asked, keys)]
        del keys
        return _rows(found + _tables(part, place[n > 0], n[n > 0]))

    asked = stored.select("chunk", "counted", "counts", "symbols", "words").mapInArrow(tidy(ask), "part int, chunk bigint, keys binary, counts binary")
    return asked.groupBy("part").applyInArrow(merge, _COUNTS)


class Model:
    """Sorted bigram hashes with their own part of the probability; by symbol, the back-off weight and the lower order's probability."""

    def __init__(self, keys: np.ndarray, own: np.ndarray, back: np.ndarray, lower: np.ndarray):
        self.keys, self.own, self.back, self.lower = keys, own, back, lower

    def log_probability(self, before: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """Of each symbol after the one before it."""
        out = self.back[before] * self.lower[symbol].astype(np.float64)
        if len(self.keys) and len(out):
            key = _dealt(before.astype(np.uint64) << _U(BITS) | symbol.astype(np.uint64))
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            out += np.where(self.keys[at] == key, self.own[at], 0.0)
        return np.log(out)


def discounts(times) -> np.ndarray:
    """Of counts 0, 1, 2 and 3 or more, given how many counts are 1, 2, 3 and 4."""
    one, two, three, four = (max(int(x), 1) for x in times)
    y = one / (one + 2 * two)
    return np.clip([0, 1 - 2 * y * two / one, 2 - 3 * y * three / two, 3 - 4 * y * four / three], [0, 0.01, 0.01, 0.01], [0, 0.99, 1.98, 2.97])


def train(places: np.ndarray, n: np.ndarray, first: np.ndarray, last: np.ndarray, times: np.ndarray) -> Model:
    """Modified Kneser-Ney from the kept bigrams (sorted places and counts), the two tables by symbol and how many bigrams occur how often."""
    cut = discounts(times[1:5])
    before = (_gram(places) >> _U(BITS)).astype(np.int64)
    own = (n - cut[np.minimum(n, 3).astype(np.int64)]) / np.maximum(first[before], 1)
    back = np.clip(1 - np.bincount(before, own, SYMBOLS), 1e-12, 1)
    return Model(places, own.astype(np.float32), back.astype(np.float32), _lower(last).astype(np.float32))


def _lower(last: np.ndarray) -> np.ndarray:
    """The lower order's probability by symbol, from the number of different words before it."""
    cut = discounts([(last == k).sum() for k in range(1, 5)])
    lower = (last - cut[np.minimum(last, 3).astype(np.int64)]) / max(int(last.sum()), 1)
    return lower + (1 - lower.sum()) / SYMBOLS


class Smoothing:
    """What a bigram's probability needs besides its number of occurrences: the discounts and, by symbol, occurrences as a bigram's
    first word, the back-off weight and the lower order's probability."""

    def __init__(self, found: dict[str, np.ndarray]):
        self.cut = discounts(found["times"][1:5])
        one, two, more = ((found["kinds"].astype(np.uint64) >> _U(KIND_BITS * k) & _U((1 << KIND_BITS) - 1)).astype(np.float64) for k in range(3))
        self.first = np.maximum(found["first"].astype(np.float64), 1)
        back = np.where(one + two + more > 0, (one + self.cut[2] * two + self.cut[3] * more) / self.first, 1)
        self.back = np.clip(back, 1e-12, 1).astype(np.float32)
        self.lower = _lower(found["last"].astype(np.float64)).astype(np.float32)

    def log_probability(self, gram: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Of the second word of each bigram after its first one, which the corpus has n times."""
        out = np.empty(len(gram))
        for i in range(0, len(gram), 1 << 18):
            part, times = gram[i : i + (1 << 18)], n[i : i + (1 << 18)]
            before, symbol = (part >> _U(BITS)).astype(np.int64), (part & _U(SYMBOLS - 1)).astype(np.int64)
            own = np.where(times > 1, (times - self.cut[np.minimum(times, 3).astype(np.int64)]) / self.first[before], 0.0)
            out[i : i + len(part)] = np.log(own + self.back[before] * self.lower[symbol].astype(np.float64))
        return out


def gather(counts: DataFrame) -> dict[str, np.ndarray]:
    """The tables "times", "first", "last" and "kinds" of rows (kind, part, of, keys, counts), summed over parts; of one size."""

    def total(key: tuple, table: pa.Table) -> pa.Table:
        sums = 0
        for x in table.column("counts"):
            sums = sums + _unpack(_loose(x.as_py()), 8)
        return pa.table([*[pa.array([k.as_py()], t) for k, t in zip(key, (pa.string(), pa.int32(), pa.int64()))], pa.array([_squeezed(_pack(sums, 8))], pa.binary())], ["kind", "part", "of", "counts"])

    # Tables of parts are summed by at most FOLD at a time.
    tables = counts.filter(F.col("kind").isin("times", "first", "last", "kinds")).select("kind", "part", F.floor(F.col("of") / FOLD).alias("of"), "counts")
    for _ in range(2):
        tables = tables.groupBy("kind", "part", "of").applyInArrow(total, "kind string, part int, of bigint, counts binary").withColumn("of", F.lit(0).cast("long"))
    summed = scratch(tables, "tables", once=True)
    tables = summed.collect()  # 3 * SEGMENTS + 1 rows
    discard(summed)
    if not tables:
        return {"times": np.zeros(TOP + 1)} | {x: np.zeros(SYMBOLS) for x in ("first", "last", "kinds")}
    return {k: np.concatenate([_unpack(_loose(r.counts), 8) for r in sorted(tables, key=lambda r: r.part) if r.kind == k]) for k in ("times", "first", "last", "kinds")}


def fit(docs: DataFrame, text_col: str = "text", kept: int = KEPT) -> Model:
    """A model of all texts that fits into memory, for texts from elsewhere: the kept most frequent bigrams have their own part of the
    probability, the others' goes to the back-off weights. judge() leaves none out. Null texts count for nothing."""
    counts = scratch(count_bigrams(docs, text_col), "bigrams")
    found = gather(counts)
    over = np.cumsum(found["times"][::-1].astype(np.int64))[::-1]
    least = max(2, int(np.argmax(over <= kept))) if (over <= kept).any() else TOP

    def often(batches):
        for batch in batches:
            keys, values = [], []
            for k, c in zip(batch.column("keys").to_pylist(), batch.column("counts").to_pylist()):
                place, n = _unpack_sorted(k), _unpack(c, 4)
                keys.append(_pack_sorted(place[n >= least]))
                values.append(_pack(n[n >= least], 4))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(values, pa.binary())], names=["keys", "counts"])

    rows = counts.filter("kind = 'gram'").select("keys", "counts").mapInArrow(tidy(often), "keys binary, counts binary").toArrow()  # at most KEPT bigrams
    places, n = _summed([np.zeros(0, np.uint64), *map(_unpack_sorted, rows.column("keys").to_pylist())], [np.zeros(0, np.uint64), *(_unpack(x, 4) for x in rows.column("counts").to_pylist())])
    if len(places) > kept:  # more bigrams than that occur TOP times or more
        on = np.sort(np.lexsort((places, -n.astype(np.int64)))[:kept])
        places, n = places[on], n[on]
    discard(counts)
    return train(places, n.astype(np.float64), found["first"].astype(np.float64), found["last"].astype(np.float64), found["times"])


def language(lang: Column) -> Column:
    """A code of two or three letters, else "other": at most 26**2 + 26**3 + 1 bands."""
    code = F.lower(F.regexp_extract(F.coalesce(lang.cast("string"), F.lit("")), r"^([A-Za-z]{2,3})(?:[-_].*)?$", 1))
    return F.when(code != "", code).otherwise("other")


def _sums(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, values.dtype if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=total[1:])
    return total[edges[1:]] - total[edges[:-1]]


_SIGN = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
_LINE_BLANKS = " \t\n\x0b\x0c\r"


def base_counts(column: pa.Array, words: Words, h: np.ndarray) -> tuple[np.ndarray, ...]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text, given its words and their hashes."""
    data, first = words.data, words.first
    n_words = np.diff(first)
    chars = _sums(~SPACE[data] & (data & 0xC0 != 0x80), words.offsets)
    signs = _sums(_SIGN[data], words.offsets)
    dup = np.zeros(len(column), np.int64)
    for i, text in enumerate(column.to_pylist()):
        if text and "\n" in text:
            lines = [x for x in text.split("\n") if x.strip(_LINE_BLANKS)]
            dup[i] = len(lines) - len(set(lines))
    repeated = np.zeros(len(column), np.int64)
    if len(words.starts) >= WINDOW:
        doc = np.repeat(np.arange(len(column)), n_words)
        rolled = np.zeros(len(h) - WINDOW + 1, np.uint64)
        for k in range(WINDOW):
            rolled = rolled * np.uint64(0xD6E8FEB86659FD93) + h[k : k + len(rolled)]
        whole = doc[: len(rolled)] == doc[WINDOW - 1 :]
        at = np.flatnonzero(whole)
        key = mix(rolled[at] ^ mix(doc[at].astype(np.uint64) + np.uint64(1)))
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(at), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        edge = np.zeros(len(h) + 1, np.int64)
        edge[at[twice]] += 1
        np.subtract.at(edge, at[twice] + WINDOW, 1)
        repeated = _sums(np.cumsum(edge[:-1]) > 0, first)
    return n_words, chars, signs, dup, repeated


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", low: float = LOW, high: float = HIGH) -> DataFrame:
    """Per row of docs: id, the base counts, base_failed, kept, and log_perplexity (nats a word; null without words).

    kept is false if base_failed or if log_perplexity lies outside the language's band. A null text has no words; a null or odd
    language counts as "other"; a null id stays; repeated rows are judged alike and counted as often; an empty table gives none.
    """
    prepare(docs.sparkSession)
    source = docs.select(F.col(id_col).alias("id"), language(F.col(lang_col)).alias("code"), F.col(text_col).cast("string").alias("text"))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    stored = scratch(chunks(once_of_each(source)), "chunks")
    counted = scratch(answers(stored), "bigrams", once=True)
    shared = docs.sparkSession.sparkContext.broadcast(Smoothing(gather(counted)))

    def score(chunk: pa.Table, told: pa.Table) -> pa.Table:
        release()
        ids, codes, counts = (chunk.column(x)[0].values for x in ("ids", "codes", "counts"))
        counts = counts.to_numpy().reshape(len(names), -1)
        place, at = _bigrams(chunk.column("symbols")[0].as_py(), chunk.column("words")[0].as_py(), counts[0])
        order = np.argsort(told.column("part").to_numpy(), kind="stable").tolist()
        n = np.concatenate([np.zeros(0, np.uint64), *(_unpack(_loose(told.column("counts")[i].as_py()), 5) for i in order)])
        edges = np.concatenate([[0], np.cumsum(counts[0])])
        total = _sums(shared.value.log_probability(_gram(place), n)[at], edges)
        value = pa.array(-total / np.maximum(counts[0], 1), mask=counts[0] == 0)
        return pa.table([ids, codes, *[pa.array(c) for c in counts], value], ["id", "code", *names, "log_perplexity"])

    kind = source.schema["id"].dataType.simpleString()
    told = counted.filter("kind = 'answer'").select(F.col("of").alias("chunk"), "part", "counts")
    asking = stored.select("chunk", "ids", "codes", "counts", "symbols", "words")
    scored = asking.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(score, f"id {kind}, code string, {', '.join(f'{x} bigint' for x in names)}, log_perplexity double")
    scored = scratch(scored, "perplexity", once=True)
    for table in (stored, counted):
        discard(table)
    bad = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    quartiles = scored.filter(~bad).groupBy("code").agg(F.percentile_approx("log_perplexity", [0.5, 0.75], 10_000).alias("q"))
    bands = quartiles.select("code", F.col("q")[0].alias("median"), F.col("q")[1].alias("upper"))
    out = scored.join(F.broadcast(bands), "code", "left").withColumn("base_failed", bad)
    wide = F.sqrt(1 + SHORT / F.greatest("n_words", F.lit(1)))
    inside = F.coalesce(F.col("log_perplexity").between(F.col("median") * low / wide, F.col("upper") + (F.col("upper") - F.col("median")) * high * wide), F.lit(True))
    return out.select(F.col("id").alias(id_col), *names, "base_failed", (~F.col("base_failed") & inside).alias("kept"), "log_perplexity")
