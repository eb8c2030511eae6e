"""Token counts by byte-pair merging: a heap of adjacent pairs over a linked list of symbols; no identifiers are made."""

from __future__ import annotations

import re
import struct
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnlake.llm.common import live, prepare

#: Segments whose counts a worker keeps before it starts afresh; longer segments are counted each time.
CACHED, CACHED_CHARS = 300_000, 48
BLANK = "▁"


def _fields(data: bytes):
    """(number, value) of the fields of a protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            if b < 128:
                return value
            shift += 7

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            value = varint()
        else:
            size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
            value, at = data[at : at + size], at + size
        yield key >> 3, value


class PieceCounter:
    """Counts the tokens that a BPE piece model with byte fallback gives a text.

    Serves models with the identity normaliser that keep all white space; others raise ValueError.
    """

    def __init__(self, model: bytes):
        scores, normal = {}, (1, 4, 5)
        self.prefix = True
        for number, value in _fields(model):
            if number == 1:
                piece = dict(_fields(value))
                if piece.get(3, 1) in normal:
                    scores[piece[1].decode()] = struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0
                if piece.get(3, 1) in (4, 5):
                    raise ValueError("user-defined and unused pieces are not served")
            elif number == 2 and dict(_fields(value)).get(3, 1) != 2:
                raise ValueError("not a BPE model")
            elif number == 3:
                spec = dict(_fields(value))
                if spec.get(2) or spec.get(4, 1):
                    raise ValueError("only the identity normaliser is served")
                self.prefix = bool(spec.get(3, 1))
        order = {s: i for i, s in enumerate(sorted(set(scores.values()), reverse=True))}
        self.rank = {p: order[s] for p, s in scores.items()}
        if any(BLANK in p.lstrip(BLANK) for p in scores):
            raise ValueError("pieces that go on after a word's end are not served")
        self.alone = "" if any("\n" in p for p in scores) else "\n"
        self.find = re.compile(rf"{BLANK}+[^{BLANK}{self.alone}]*|[^{BLANK}{self.alone}]+" + (r"|\n+" if self.alone else "")).findall
        self.cache: dict[str, int] = {}

    def merged(self, text: str) -> int:
        """Tokens of one segment: initial symbols less merges; a character without a piece is as many symbols as it has bytes."""
        rank = self.rank
        n = len(text)
        spare = {c: len(c.encode("utf-8", "surrogatepass")) - 1 for c in set(text) if c not in rank}
        count = n + sum(spare[c] for c in text if c in spare) if spare else n
        get = rank.get
        # A heap entry holds rank, start and end of the joined text; it is out of date if that is no longer two symbols.
        bits = n.bit_length()
        mask = (1 << bits) - 1
        heap = [(r << bits | i) << bits | i + 2 for i in range(n - 1) if (r := get(text[i : i + 2])) is not None]
        if not heap:
            return count
        heapify(heap)
        after, before = list(range(1, n + 2)), list(range(-1, n))  # of a symbol's start; after is its end too
        while heap:
            entry = heappop(heap)
            stop, left = entry & mask, entry >> bits & mask
            right = after[left]
            if right >= n or after[right] != stop:
                continue
            count -= 1
            if spare:
                count -= sum(spare.get(text[a:b], 0) for a, b in ((left, right), (right, stop)) if b - a == 1)
            after[left], after[right], before[stop] = stop, n + 1, left
            if stop < n and (r := get(text[left : (ends := after[stop])])) is not None:
                heappush(heap, (r << bits | left) << bits | ends)
            if left and (r := get(text[(prior := before[left]) : stop])) is not None:
                heappush(heap, (r << bits | prior) << bits | stop)
        return count

    def __call__(self, text: str | None) -> int:
        if not text:
            return 0
        cache, total, missed = self.cache, 0, 0
        if len(cache) > CACHED:
            cache.clear()
        parts = self.find((BLANK * self.prefix) + text.replace(" ", BLANK))
        counts = list(map(cache.get, parts))
        if None in counts:
            for part, known in zip(parts, counts):
                if known is None:
                    n = cache.get(part)
                    if n is None:
                        n = self.merged(part)
                        if len(part) <= CACHED_CHARS:
                            cache[part] = n
                    missed += n
            counts = filter(None, counts)
        total += missed + sum(counts)
        return total


def count_tokens(docs: DataFrame, model: bytes, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    A null text is empty and has no token; a null id stays null; repeated rows give repeated rows; an empty table gives none;
    other columns of docs play no part. One pass, no shuffle; memory is a batch and a bounded cache.
    """
    prepare(docs.sparkSession)
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    key = hash(model)

    def run(batches):
        counter = live(("pieces", key), lambda: PieceCounter(model))
        for batch in batches:
            texts = batch.column("text").to_pylist()
            n = [counter(t) for t in texts]
            size = [len(t.encode("utf-8", "surrogatepass")) if t else 0 for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], names=[id_col, "n_bytes", "n_tokens", "over_limit"])

    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(run, f"`{id_col}` {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")
