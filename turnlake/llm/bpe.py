"""Byte-level BPE: a lazily determinised transducer encodes, an incremental UTF-8 state machine decodes.

A token sequence is the BPE encoding of its bytes exactly if every two neighbours stay apart when merged alone. So a
nondeterministic transducer walks the trie of tokens byte by byte, and may end a token wherever it agrees with the one before.
Determinising it (subset construction with delayed output) gives a state per set of open hypotheses; states and transitions are
made when a text first needs them. A token goes out as soon as all open hypotheses share it, which is at most the longest token
later.
"""

from __future__ import annotations

import base64
import hashlib
import re
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnlake.llm.common import live, prepare, slices

#: Longest piece that is kept.
PIECE_CHARS = 24
#: Bounds of what a worker keeps: pieces with their tokens (twice so many), transitions, pairs of tokens. What is full starts afresh.
KEPT = (200_000, 400_000, 400_000)
#: Bytes of text that are encoded at a time, but for longer texts.
PART = 1 << 19
_NEVER = 1 << 62


def read_ranks(data: bytes) -> dict[bytes, int]:
    """A tiktoken rank file: a line has a token in base64 and its rank."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}


class Transducer:
    """Encodes byte strings to ranks as repeated merging of the lowest-ranked neighbours does."""

    def __init__(self, ranks: dict[bytes, int], kept: tuple[int, int, int] = KEPT):
        self.most = kept[1:]
        if any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("every byte must be a token")
        self.ranks = ranks
        self.bytes_of = {r: t for t, r in ranks.items()}
        self.child: list[dict[int, int]] = [{}]
        self.token: list[int] = [-1]
        for text, rank in ranks.items():
            node = 0
            for b in text:
                follow = self.child[node].get(b)
                if follow is None:
                    follow = self.child[node][b] = len(self.child)
                    self.child.append({})
                    self.token.append(-1)
                node = follow
            self.token[node] = rank
        self.parts: dict[int, tuple[int, int] | None] = {}
        self.spines: dict[tuple[int, int], list[tuple[bytes, int, int]]] = {}
        self.forget()

    def forget(self) -> None:
        """Drop all states; the next byte makes them anew."""
        self.pairs: dict[int, bool] = {}
        start = ((-1, 0, ()),)
        self.states, self.number = [start], {start: 0}
        self.moves: dict[int, tuple[int, tuple[int, ...]]] = {}

    def merged(self, text: bytes, until: int = 1) -> list[bytes]:
        """Plain repeated merging, down to so many parts at least; for single tokens and as the definition in tests."""
        parts = [text[i : i + 1] for i in range(len(text))]
        while len(parts) > until:
            best = min(((self.ranks.get(parts[i] + parts[i + 1], _NEVER), i) for i in range(len(parts) - 1)))
            if best[0] == _NEVER:
                break
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
        return parts

    def spine(self, token: int, side: int) -> list[tuple[bytes, int, int]]:
        """Symbols that stand at the left (0) or right (1) edge while token is merged: (bytes, rank, rank of what takes it up)."""
        known = self.spines.get((token, side))
        if known is None:
            known, at, taken = [], token, _NEVER
            while True:
                known.append((self.bytes_of[at], at, taken))
                if at not in self.parts:
                    two = self.merged(self.bytes_of[at], 2) if len(self.bytes_of[at]) > 1 else []
                    self.parts[at] = (self.ranks[two[0]], self.ranks[two[1]]) if len(two) == 2 else None
                    if len(two) > 2 or two and max(self.parts[at]) > at:
                        raise ValueError(f"token {self.bytes_of[at]!r} isn't made by merging earlier tokens")
                if self.parts[at] is None:
                    break
                at, taken = self.parts[at][side], at
            self.spines[token, side] = known
        return known

    def apart(self, first: int, second: int) -> bool:
        """Whether two tokens side by side stay two tokens."""
        key = first << 20 | second
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) > self.most[1]:
                self.pairs.clear()
            a, b, known, ranks = self.spine(first, 1), self.spine(second, 0), True, self.ranks
            i = j = 0
            while True:
                (x, x_rank, x_taken), (y, y_rank, y_taken) = a[i], b[j]
                rank = ranks.get(x + y, _NEVER)
                if rank < x_taken and rank <= y_taken and rank != _NEVER:
                    known = False
                    break
                # backwards in time: the later of the two symbols goes back to what it was made of
                if (x_rank > y_rank or j + 1 == len(b)) and i + 1 < len(a):
                    i += 1
                elif j + 1 < len(b):
                    j += 1
                else:
                    break
            self.pairs[key] = known
        return known

    def move(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        """The state after a byte and the tokens that are now certain; made once."""
        made = []
        child, token, known = self.child, self.token, self.pairs
        shared = _NEVER
        for last, node, out in self.states[state]:
            follow = child[node].get(byte)
            if follow is not None:
                if child[follow]:
                    made.append((last, follow, out))
                    if not out:
                        shared = 0
                t = token[follow]
                if t >= 0:
                    if last >= 0:
                        fits = known.get(last << 20 | t)
                        if fits is None:
                            fits = self.apart(last, t)
                        if not fits:
                            continue
                    made.append((t, 0, (*out, t)))
        if not made:
            raise ValueError("no encoding")
        sure = ()
        if shared:
            low, high = min(m[2] for m in made), max(m[2] for m in made)
            shared = 0
            while shared < len(low) and low[shared] == high[shared]:
                shared += 1
            if shared:
                sure = low[:shared]
                made = [(last, node, out[shared:]) for last, node, out in made]
        made.sort()
        made = tuple(made)
        to = self.number.get(made)
        if to is None:
            to = self.number[made] = len(self.states)
            self.states.append(made)
        step = self.moves[state << 8 | byte] = (to, sure)
        return step

    def encode(self, text: bytes) -> list[int]:
        """Ranks of one piece; a piece that is a token is that token."""
        whole = self.ranks.get(text)
        if whole is not None:
            return [whole]
        out: list[int] = []
        if not text:
            return out
        state, moves = 0, self.moves
        for byte in text:
            step = moves.get(state << 8 | byte)
            if step is None:
                if len(moves) > self.most[0]:
                    kept = self.states[state]
                    self.forget()
                    moves = self.moves
                    state = self.number.setdefault(kept, len(self.states))
                    if state == len(self.states):
                        self.states.append(kept)
                step = self.move(state, byte)
            state, sure = step
            if sure:
                out += sure
        out += next(rest for _, node, rest in self.states[state] if node == 0)
        return out


#: States of the UTF-8 machine: 0 between characters, else how the next bytes are bounded. Maps (state, byte) to a state or -1.
_UTF8: list[list[int]] = [[-1] * 256 for _ in range(8)]
for _b in range(256):
    _UTF8[0][_b] = 0 if _b < 0x80 else 1 if 0xC2 <= _b <= 0xDF else {0xE0: 4, 0xED: 5, 0xF0: 6, 0xF4: 7}.get(_b, 2 if 0xE0 <= _b <= 0xEF else 3 if 0xF0 <= _b <= 0xF4 else -1)
    if 0x80 <= _b <= 0xBF:
        _UTF8[1][_b], _UTF8[2][_b], _UTF8[3][_b] = 0, 1, 2
        if _b >= 0xA0:
            _UTF8[4][_b] = 1
        else:
            _UTF8[5][_b] = 1
        if _b >= 0x90:
            _UTF8[6][_b] = 2
        else:
            _UTF8[7][_b] = 2


class Decoder:
    """Decodes a stream of ids; a character whose bytes lie in several tokens comes out with its last byte.

    Bytes that are no UTF-8 become U+FFFD, one for each longest start of a character, as in Python's decoder.
    """

    def __init__(self, bytes_of: dict[int, bytes]):
        self.bytes_of, self.open, self.state = bytes_of, b"", 0

    def feed(self, ids) -> str:
        data = self.open + b"".join(map(self.bytes_of.__getitem__, ids))
        # Only the last character can be open: run the machine from its lead byte, at most 3 bytes back.
        cut = len(data)
        for back in range(1, min(3, len(data)) + 1):
            b = data[-back]
            if b < 0x80:
                break
            if b >= 0xC0:
                state = 0
                for x in data[-back:]:
                    state = _UTF8[state][x] if state >= 0 else -1
                if state > 0:
                    cut -= back
                self.state = max(state, 0)
                break
        self.open = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def close(self) -> str:
        rest, self.open, self.state = self.open, b"", 0
        return rest.decode("utf-8", "replace")


def splitter(pattern: str):
    """findall of the pattern: with the standard library's engine where a text has no character beyond U+FFFF, which is faster.

    Classes are spelt out as the ranges that the regex module gives them, so both engines agree.
    """
    slow = regex.compile(pattern)
    plain = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x10000)]))
    spelt = pattern
    for name in (r"\p{L}", r"\p{N}", r"\s"):
        inner = "".join(f"\\u{ord(x[0]):04x}-\\u{ord(x[-1]):04x}" for run in regex.findall(f"[{name}]+", plain) for x in _runs(run))
        spelt = re.sub(r"(\[[^\]]*)" + re.escape(name), lambda m: m[1] + inner, spelt)  # noqa: B023
        spelt = re.sub(r"(\[[^\]]*)" + re.escape(name), lambda m: m[1] + inner, spelt).replace(name, f"[{inner}]")  # noqa: B023
        if name == r"\s":
            spelt = spelt.replace(r"\S", f"[^{inner}]")
    try:
        fast = re.compile(spelt)
    except re.error:
        return slow.findall
    return lambda text: (fast if text.isascii() or max(text) < "\U00010000" else slow).findall(text)


def _runs(text: str):
    """Parts of text whose code points follow each other."""
    start = 0
    for i in range(1, len(text) + 1):
        if i == len(text) or ord(text[i]) != ord(text[i - 1]) + 1:
            yield text[start:i]
            start = i


class Codec:
    """Encodes and decodes whole texts; each match of the pattern is a piece of its own."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, kept: tuple[int, int, int] = KEPT):
        self.machine, self.most = Transducer(ranks, kept), kept[0]
        self.find = splitter(pattern)
        self.cache: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}  # the cache before it was full last: what is still in use moves over
        self.said: dict[int, str] = {r: str(r) for r in ranks.values()}

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        if len(self.cache) > self.most:
            self.older, self.cache = self.cache, {}
        cache, older = self.cache, self.older
        pieces = self.find(text)
        found = list(map(cache.get, pieces))
        if None in found:
            for i, ids in enumerate(found):
                if ids is None:
                    piece = pieces[i]
                    found[i] = ids = cache.get(piece)
                    if ids is None:
                        ids = older.get(piece)
                        if ids is None:
                            ids = tuple(self.machine.encode(piece.encode("utf-8", "replace")))
                        found[i] = ids
                        if len(piece) <= PIECE_CHARS:
                            cache[piece] = ids
        return list(chain.from_iterable(found))

    def decode(self, ids, chunk: int = 1 << 16) -> str:
        decoder = Decoder(self.machine.bytes_of)
        return "".join([decoder.feed(ids[i : i + chunk]) for i in range(0, len(ids), chunk)]) + decoder.close()


def _live(ranks: bytes, pattern: str, kept: tuple[int, int, int] = KEPT) -> Codec:
    return live(("bpe", hash((ranks, pattern, kept))), lambda: Codec(read_ranks(ranks), pattern, kept))


def encode(docs: DataFrame, ranks: bytes, pattern: str, text_col: str = "text", out_col: str = "ids", decoded_col: str | None = None, kept: tuple[int, int, int] = KEPT) -> DataFrame:
    """docs with out_col (array<int>: the ids of the whole text) and, if named, decoded_col (the ids decoded again).

    A null text is empty and has no ids; an existing column of these names is replaced; other columns pass; repeated rows stay.
    One pass without shuffle; a worker keeps bounded caches only, kept of each, about 200 MB in all by default. Smaller ones cost time and
    change nothing else.
    """
    prepare(docs.sparkSession)
    source = docs.drop(out_col, *([decoded_col] if decoded_col else []))
    text_at = source.columns.index(text_col)

    def run(batches):
        codec = _live(ranks, pattern, kept)
        for batch in batches:
            for part in slices(batch, text_col, PART):
                ids = [codec.encode(t) for t in part.column(text_at).cast(pa.string()).to_pylist()]
                made = [*part.columns, pa.array(ids, pa.list_(pa.int32()))]
                if decoded_col:
                    made.append(pa.array([codec.decode(x) for x in ids], pa.string()))
                yield pa.RecordBatch.from_arrays(made, names=[*part.schema.names, out_col, *([decoded_col] if decoded_col else [])])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema) + f", `{out_col}` array<int>" + (f", `{decoded_col}` string" if decoded_col else "")
    return source.mapInArrow(run, schema)


def decode(rows: DataFrame, ranks: bytes, ids_col: str = "ids", out_col: str = "text") -> DataFrame:
    """rows with out_col, the text that ids_col stands for; null ids are an empty text, an unknown id raises KeyError."""
    prepare(rows.sparkSession)
    source = rows.drop(out_col)
    at = source.columns.index(ids_col)

    def run(batches):
        codec = _live(ranks, "")
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([codec.decode(x or ()) for x in batch.column(at).to_pylist()], pa.string())], names=[*batch.schema.names, out_col])

    return source.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema) + f", `{out_col}` string")


def digests(docs: DataFrame, ranks: bytes, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: id, n_tokens, ids_sha256 (of the decimal ids joined by a space), decoded_sha256 (of the decoded bytes).

    The same encoding and decoding as encode() without sending ids back to the JVM. Null and empty texts have no tokens.
    """
    prepare(docs.sparkSession)
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        codec = _live(ranks, pattern)
        say = codec.said.__getitem__
        for batch in batches:
            n, a, b = [], [], []
            for text in batch.column("text").to_pylist():
                ids = codec.encode(text)
                n.append(len(ids))
                a.append(hashlib.sha256(" ".join(map(say, ids)).encode()).hexdigest())
                b.append(hashlib.sha256(codec.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(run, f"`{id_col}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
