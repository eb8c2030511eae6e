"""Toxicity by weak supervision: a generative model of many lexicon and pattern voters labels rows for a linear classifier.

Voters fire or don't. Their moments are counted over all documents. Given the class, voters are taken as independent but for pairs
that the moments show to depend on each other: C_ij = d_i d_j p (1 - p), with d_i the difference of a voter's rates in the two
classes, is solved from triplets of voters; what a pair's covariance has beyond that is its correlation, and correlated voters share
their weight beyond the strongest vote. Labels of training rows give the prior, the learnt part of the lexicon and bounds of what a vote
may count, and are a voter of their own on those rows.
The posterior labels of a bounded sample of training rows train a logistic regression on the voters and on all hashed words and beginnings
of words, by how often a text has them, that toxic labels have significantly more often. Beginnings find words that are made from one
stem in any language, whatever the list of words knows. The labels of training rows so do much of the work.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnlake.llm.common import Words, mix, prepare, slices, tidy

#: Most labelled rows that the lexicon and the classifier are fitted on; all other statistics cover all documents.
SAMPLE = 20_000
#: Words and their beginnings of so many bytes are hashed to so many bits; a text has a feature if it has the word so often.
BITS, BEGINNINGS, TIMES = 20, (4, 6), (1, 2, 4)
#: A feature is told from chance by so many standard errors of its log odds, so many toxic labels that have it, such a share of them, and
#: log odds; so is a voter. The ridge of a feature's and of a voter's weight.
FEATURE, VOTER, RIDGE = (4.5, 12, 0.02, 2.0), (4.0, 12, 0.03, 3.0), (15.0, 1.0)
#: Seed words: English, German, French, Spanish. Those that no text has cast no votes.
LEXICON = """idiot moron stupid dumb fool loser pathetic worthless disgusting scum trash garbage clown jerk imbecile creep freak liar
coward ugly vermin filth bastard crap damn hate kill shut bloody lunatic psycho brainless spineless vile wretch
dumm blöd dumme trottel depp arschloch abschaum versager lügner feigling widerlich ekelhaft dreckskerl
imbécile crétin connard ordure minable menteur lâche dégoûtant abruti débile
idiota imbécil estúpido estúpida basura mentiroso cobarde asqueroso patético inútil""".split()

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_SPACE = np.array([not (b >= 128 or chr(b).isalnum()) for b in range(256)])
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = _UPPER | np.roll(_UPPER, 32)
PATTERNS = ("shouting", "exclaims", "symbols", "addresses", "sworn")


_STEM_SALT = [np.uint64(0), *(np.uint64(0x9E3779B97F4A7C15 * k & (1 << 64) - 1) for k in BEGINNINGS)]


def _buckets(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - BITS)).astype(np.int64)


def _of(names: list[str]) -> np.ndarray:
    return _buckets(Words(pa.array(names, pa.string()), space=_SPACE, fold=_FOLD).hashes())


def _share(data: np.ndarray, offsets: np.ndarray, hit: np.ndarray) -> np.ndarray:
    total = np.zeros(len(data) + 1, np.int64)
    np.cumsum(hit, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


class Reader:
    """Words, beginnings of words and votes of a batch of texts. A feature is bucket + k << BITS: the bucket TIMES[k] times or more."""

    def __init__(self, column: pa.Array, lexicon: np.ndarray | None = None, seeds: int = 0):
        self.words = Words(column, space=_SPACE, fold=_FOLD)
        self.n = len(column)
        doc = np.repeat(np.arange(self.n), np.diff(self.words.first))
        spans, starts, ends = self.words.spans(), self.words.starts, self.words.ends
        h = spans(starts, ends)
        docs, found = [doc], [_buckets(h)]
        for size, salt in zip(BEGINNINGS, _STEM_SALT[1:]):
            long = np.flatnonzero(ends - starts > size)
            docs.append(doc[long])
            found.append(_buckets(mix(spans(starts[long], starts[long] + size) ^ salt)))
        self.bucket, self.doc = np.concatenate(found), np.concatenate(docs)
        self.n_words = len(h)
        if lexicon is not None:
            self.fires = self._votes(column, lexicon, seeds)

    def counted(self, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(doc, feature) of every feature of each text, of those with a known bucket."""
        on = slice(None) if known is None else known[self.bucket]
        pairs, n = np.unique(self.doc[on] << BITS | self.bucket[on], return_counts=True)
        doc, bucket = pairs >> BITS, pairs & ((1 << BITS) - 1)
        parts = [(doc[n >= t], bucket[n >= t] + (k << BITS)) for k, t in enumerate(TIMES)]
        return np.concatenate([d for d, _ in parts]), np.concatenate([f for _, f in parts])

    def features(self, features: np.ndarray) -> np.ndarray:
        """Which of the features each text has."""
        out = np.zeros((self.n, len(features)), bool)
        if len(features):
            known = np.zeros(1 << BITS, bool)
            known[features & ((1 << BITS) - 1)] = True
            doc, found = self.counted(known)
            order = np.argsort(features, kind="stable")
            at = np.minimum(np.searchsorted(features[order], found), len(features) - 1)
            hit = features[order][at] == found
            out[doc[hit], order[at[hit]]] = True
        return out

    def _votes(self, column: pa.Array, lexicon: np.ndarray, seeds: int) -> np.ndarray:
        """Votes of the lexicon, of which the first are seeds, and of the patterns, the last of which is two seed words or more."""
        words = self.features(lexicon)
        own = np.zeros(1 << BITS, bool)
        own[lexicon[:seeds]] = True
        sworn = np.bincount(self.doc[: self.n_words][own[self.bucket[: self.n_words]]], minlength=self.n)
        raw = Words(column).data
        at = self.words.offsets
        letters, upper = _share(raw, at, _LETTER[raw]), _share(raw, at, _UPPER[raw])
        marks, size = _share(raw, at, raw == 33), np.maximum(np.diff(at), 1)
        signs = _share(raw, at, np.isin(raw, np.frombuffer(b"#*$%&", np.uint8)))
        you = np.zeros(self.n, bool)
        you[self.doc[: self.n_words][np.isin(self.bucket[: self.n_words], _of(["you", "your", "you're"]))]] = True
        patterns = [upper * 2 > letters, marks * 50 > size, signs * 20 > size, you, sworn >= 2]
        return np.column_stack([words, *patterns])


@dataclass
class Labels:
    """The label model: prior, rates of firing given each class, and weights of the voters."""

    prior: float
    toxic: np.ndarray
    clean: np.ndarray
    weight: np.ndarray
    correlation: np.ndarray

    def ratios(self) -> tuple[np.ndarray, np.ndarray]:
        """What a vote and its absence add to the log odds of an uncorrelated voter; nothing for voters without weight."""
        used = self.weight > 0
        return np.where(used, np.log(self.toxic / self.clean), 0.0), np.where(used, np.log((1 - self.toxic) / (1 - self.clean)), 0.0)

    def calibrated(self, fires: np.ndarray, y: np.ndarray) -> "Labels":
        """The model with rates that labelled rows bear out: a vote counts no more than its share among the labels, and a voter that
        the moments say nothing of, but three toxic labels do, counts by these."""
        n1, n0 = y.sum(), (~y).sum()
        if not n1 or not n0:
            return self
        a, b = fires[y].sum(axis=0), fires[~y].sum(axis=0)
        seen = np.log((a + 1) / (n1 + 2)) - np.log((b + 0.5) / (n0 + 1))
        on, _ = self.ratios()
        toxic, clean, weight = self.toxic.copy(), self.clean.copy(), self.weight.copy()
        low = np.clip(seen, 0, None)
        clean = np.where((weight > 0) & (on > low), toxic / np.exp(low), clean)
        new = (weight == 0) & (a >= 3) & (seen > 1.5)
        toxic[new] = ((a + 1) / (n1 + 2))[new]
        clean[new] = (toxic / np.exp(seen - 0.5))[new]
        weight[new] = weight[weight > 0].mean() if (weight > 0).any() else 1.0
        return Labels(self.prior, np.clip(toxic, 1e-9, 1 - 1e-4), np.clip(clean, 1e-9, 1 - 1e-4), weight, self.correlation)

    def log_odds(self, fires: np.ndarray) -> np.ndarray:
        """The strongest vote counts in full, all others by their weight, as far as they are not said by it already."""
        on, off = self.ratios()
        votes = np.where(fires, on, 0.0)
        lead = votes.argmax(axis=1)
        first = votes[np.arange(len(votes)), lead] * (1 - self.weight[lead])
        return np.log(self.prior / (1 - self.prior)) + first + (np.where(fires, on, off) * self.weight).sum(axis=1)


def label_model(rows: int, both: np.ndarray, prior: float) -> Labels:
    """Fit to counts: both[i, j] of rows in which voters i and j fire, both[i, i] of voter i."""
    rows = max(rows, 1)
    prior = min(max(prior, 1e-3), 0.5)
    mean = np.diag(both) / rows
    cov = both / rows - np.outer(mean, mean)
    m = len(mean)
    spread = prior * (1 - prior)
    live = np.flatnonzero((np.diag(both) >= 5) & (mean < 0.9))
    diff = np.zeros(m)
    noise = 3 * np.sqrt(np.outer(mean * (1 - mean), mean * (1 - mean)) / rows)
    c, sure = cov[np.ix_(live, live)], (cov > noise)[np.ix_(live, live)]
    np.fill_diagonal(sure, False)
    for at, i in enumerate(live):
        # Triplets of i with all pairs of voters that are seen to agree with it and with each other.
        with_i = np.flatnonzero(sure[at])
        j, k = np.triu_indices(len(with_i), 1)
        j, k = with_i[j], with_i[k]
        told = sure[j, k]
        if told.any():
            diff[i] = np.sqrt(np.median(c[at, j[told]] * c[at, k[told]] / c[j[told], k[told]] / spread))
    diff = np.minimum(diff, mean / prior * 0.98)
    left = cov - np.outer(diff, diff) * spread
    scale = np.sqrt(np.outer(mean * (1 - mean), mean * (1 - mean))) + 1e-9
    correlation = np.where(np.abs(left) > noise, left / scale, 0.0)
    np.fill_diagonal(correlation, 1.0)
    weight = np.where(diff > 0, 1 / np.maximum(np.clip(correlation, 0, 1)[:, diff > 0].sum(axis=1), 1), 0.0)
    low = 0.5 / rows
    return Labels(prior, np.clip(mean + (1 - prior) * diff, low, 1 - 1e-4), np.clip(mean - prior * diff, low, 1 - 1e-4), weight, correlation)


def logistic(x: np.ndarray, y: np.ndarray, ridge: np.ndarray | float = 3.0, steps: int = 30, rows: int = 4096) -> np.ndarray:
    """Weights of a logistic regression on soft labels, the last for the constant; Newton's method with a ridge (one, or one each)."""
    w = np.zeros(x.shape[1] + 1)
    keep = np.append(np.broadcast_to(np.asarray(ridge, float), x.shape[1]), 1e-3)
    for _ in range(steps):
        grad, curve = -keep * w, np.diag(keep)
        for at in range(0, len(x), rows):
            part = np.column_stack([x[at : at + rows], np.ones(len(x[at : at + rows]))]).astype(np.float64)
            p = 1 / (1 + np.exp(-np.clip(part @ w, -30, 30)))
            grad = grad + part.T @ (y[at : at + rows] - p)
            curve = curve + (part * (p * (1 - p) + 1e-6)[:, None]).T @ part
        step = np.linalg.solve(curve, grad)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


@dataclass
class Model:
    """What scores texts: features of the voters, the first of which are seed words, features of the classifier, weights."""

    lexicon: np.ndarray
    features: np.ndarray
    weights: np.ndarray
    labels: Labels
    seeds: int

    def score(self, column: pa.Array) -> np.ndarray:
        reader = Reader(column, self.lexicon, self.seeds)
        x = np.column_stack([reader.features(self.features), reader.fires])
        return 1 / (1 + np.exp(-np.clip(x @ self.weights[:-1] + self.weights[-1], -30, 30)))


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> Model:
    """Learn from rows of labels whose id isn't held out: at most about sample of them, drawn by a hash of the id.

    Ids with several labels count as toxic if any is; null labels and ids count for nothing. Without any label the prior is 0.05
    and the classifier learns from the voters alone, on documents drawn likewise.
    """
    prepare(docs.sparkSession)
    text = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))
    marks = labels.select(F.col(id_col).cast("long").alias("doc"), F.col(label_col).cast("int").alias("y")).filter("doc is not null and y is not null").filter(~held_out(F.col("doc")))
    marks = marks.groupBy("doc").agg(F.max("y").alias("y"))
    n, share = marks.agg(F.count("*"), F.avg("y")).first()
    drawn = lambda rows: F.pmod(F.xxhash64("doc"), F.lit(1 << 20)) < F.lit(int((1 << 20) * min(1.0, sample / max(rows, 1))))
    if n:
        rows = text.join(F.broadcast(marks.filter(drawn(n)).limit(2 * sample)), "doc")
    else:
        rows = text.filter("doc is not null").filter(drawn(text.count())).withColumn("y", F.lit(0)).limit(2 * sample)

    seeds = _of(LEXICON)

    def count(batches):
        total = np.zeros((2, len(TIMES) << BITS), np.int32)
        for batch in batches:
            for part in slices(batch, "text"):
                doc, feature = Reader(part.column("text")).counted()
                y = part.column("y").to_numpy()[doc] > 0
                for k in (0, 1):
                    total[k] += np.bincount(feature[y == k], minlength=total.shape[1]).astype(np.int32)
        on = np.flatnonzero(total[1])
        clean = np.flatnonzero((total[1] == 0) & (total[0] > 0))
        for k in (on, clean):
            for at in range(0, len(k), 1 << 16):
                part = k[at : at + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(total[0][part].astype(np.int64)), pa.array(total[1][part].astype(np.int64))], names=["feature", "clean", "toxic"])

    counts = rows.mapInArrow(tidy(count), "feature bigint, clean bigint, toxic bigint").groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    table = counts.filter((F.col("toxic") >= FEATURE[1]) | F.col("feature").isin(seeds.tolist())).toArrow()  # at most len(TIMES) << BITS rows
    feature, clean, toxic = (table.column(c).to_numpy() for c in ("feature", "clean", "toxic"))
    sizes = {r["y"]: r["count"] for r in marks.filter(drawn(n)).groupBy("y").count().collect()} if n else {}
    n1, n0 = max(sum(v for k, v in sizes.items() if k > 0), 1), max(sizes.get(0, 0), 1)
    odds = np.log((toxic + 0.5) / (n1 + 1)) - np.log((clean + 0.5) / (n0 + 1))
    z = odds / np.sqrt(1 / (toxic + 0.5) + 1 / (clean + 0.5))
    told = lambda bar: feature[(z > bar[0]) & (toxic >= max(bar[1], bar[2] * n1)) & (odds > bar[3])]
    features = np.sort(told(FEATURE))
    # Seed words that clean labels have about as often are no voters.
    place = {b: i for i, b in enumerate(feature.tolist())}
    had = [(toxic[place[b]], clean[place[b]]) if b in place else (0, 0) for b in seeds.tolist()]
    seeds = seeds[[not b or np.log((a + 1) / (n1 + 2)) - np.log((b + 0.5) / (n0 + 1)) >= 1 for a, b in had]]
    n_seeds = len(seeds)
    lexicon = np.concatenate([seeds, np.setdiff1d(told(VOTER), seeds)]).astype(np.int64)
    m = len(lexicon) + len(PATTERNS)

    def moments(batches):
        both, seen = np.zeros((m, m), np.int64), 0
        for batch in batches:
            for part in slices(batch, "text"):
                fires = Reader(part.column("text"), lexicon, n_seeds).fires.astype(np.float32)
                both += (fires.T @ fires).astype(np.int64)
                seen += len(fires)
        i, j = np.triu_indices(m)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *i]), pa.array([-1, *j]), pa.array([seen, *both[i, j]])], names=["i", "j", "n"])

    sums = text.select("text").mapInArrow(tidy(moments), "i bigint, j bigint, n bigint").groupBy("i", "j").agg(F.sum("n").alias("n")).toArrow()  # m * (m + 1) / 2 + 1 rows
    i, j, v = (sums.column(c).to_numpy() for c in ("i", "j", "n"))
    both, total = np.zeros((m, m)), int(v[i < 0].sum())
    both[i[i >= 0], j[i >= 0]] = v[i >= 0]
    both = np.maximum(both, both.T)
    model = label_model(total, both, float(share) if n else 0.05)

    def matrix(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                reader = Reader(part.column("text"), lexicon, n_seeds)
                x = np.packbits(np.column_stack([reader.features(features), reader.fires]), axis=1)
                yield pa.RecordBatch.from_arrays([part.column("doc"), part.column("y"), pa.array([r.tobytes() for r in x], pa.binary())], names=["doc", "y", "x"])

    got = rows.select("doc", "y", "text").mapInArrow(tidy(matrix), "doc bigint, y int, x binary").toArrow().sort_by("doc")
    width = len(features) + m
    x = np.unpackbits(np.frombuffer(b"".join(got.column("x").to_pylist()), np.uint8).reshape(len(got), -1), axis=1)[:, :width].astype(bool) if len(got) else np.zeros((1, width), bool)
    y = got.column("y").to_numpy() > 0 if len(got) else np.zeros(1, bool)
    if n:
        model = model.calibrated(x[:, len(features) :], y)
    odds = model.log_odds(x[:, len(features) :])
    if n:
        # The label is one more voter: its rates given the class, by the posterior of the others.
        post = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        hit, false = (post @ y + 1) / (post.sum() + 2), ((1 - post) @ y + 1) / ((1 - post).sum() + 2)
        odds = odds + np.where(y, np.log(hit / false), np.log((1 - hit) / (1 - false)))
    soft = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    return Model(lexicon, features, logistic(x, soft, np.r_[np.full(len(features), RIDGE[0]), np.full(m, RIDGE[1])]), model, n_seeds)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: id, held_out, score, predicted. Null and empty texts have a score too; a null id isn't held out."""
    prepare(docs.sparkSession)
    source = docs.select(F.col(id_col).alias("id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                s = model.score(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("held_out"), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=[id_col, "held_out", "score", "predicted"])

    return source.mapInArrow(tidy(run), f"`{id_col}` {source.schema['id'].dataType.simpleString()}, held_out boolean, score double, predicted int")


def reject(docs: DataFrame, model: Model, text_col: str = "text", at: float = 0.5) -> DataFrame:
    """docs without the rows whose score reaches at."""
    prepare(docs.sparkSession)

    def run(batches):
        for batch in batches:
            for part in slices(batch, text_col):
                yield part.filter(pa.array(model.score(part.column(text_col)) < at))

    return docs.mapInArrow(tidy(run), docs.schema)
