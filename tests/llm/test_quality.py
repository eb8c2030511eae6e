"""Perplexity, toxicity and mixing."""

import math
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from turnlake.llm import mixing, perplexity, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    w = WORD.findall(text)
    seen, covered = {}, set()
    for i in range(len(w) - 7):
        seen.setdefault(tuple(w[i : i + 8]), []).append(i)
    for places in seen.values():
        if len(places) > 1:
            for i in places:
                covered.update(range(i, i + 8))
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


ODD = [None, "", " \n\t\n", "a", "a b\na b\na b \n", "x y z " * 40, "é日本 \x1c a#*$%&|<>", "one two three four five six seven eight " * 2, "w " * 60_000]


def corpus():
    r = random.Random(8)
    words = ["".join(r.choices(["th", "er", "in", "on", "at", "en", "es", "re"], k=r.randrange(1, 4))) for _ in range(500)]
    good = [" ".join(r.choices(words, k=r.randrange(60, 300))) for _ in range(150)]
    junk = ["".join(r.choices("qxzjkvw0123456789@#", k=400)).replace("0", " ") for _ in range(5)]
    return good, junk


def test_base_counts():
    column = pa.array(ODD, pa.string())
    words = perplexity.Words(column)
    got = list(zip(*[x.tolist() for x in perplexity.base_counts(column, words, words.hashes())]))
    assert got == [base(t) for t in ODD]


def bigrams(texts):
    words = perplexity.Words(pa.array(texts))
    return perplexity.symbols(words, words.hashes())


def test_packing():
    r = np.random.default_rng(3)
    g = np.append(r.integers(0, 1 << 40, 1000, dtype=np.uint64), [np.uint64(0), np.uint64((1 << 40) - 1)])
    assert (perplexity._gram(perplexity._dealt(g)) == g).all() and perplexity._dealt(g).max() < 1 << 40
    assert (perplexity._unpack_sorted(perplexity._pack_sorted(np.sort(g))) == np.sort(g)).all()
    assert len(perplexity._unpack_sorted(b"")) == 0 and (perplexity._unpack(perplexity._pack(g, 5), 5) == g).all()


@pytest.mark.parametrize("kept", [1 << 21, 30])
def test_kneser_ney_by_hand(spark, monkeypatch, kept):
    """Probabilities against the definition, with dictionaries; all symbols after a context sum to one, with pruning and without."""
    monkeypatch.setattr(perplexity, "COUNTED", 50)
    r = random.Random(1)
    words = ["".join(r.choices("abcdefgh", k=4)) for _ in range(30)]
    texts = [" ".join(r.choices(words, weights=range(1, 31), k=r.randrange(0, 40))) for _ in range(60)]
    before, own = bigrams(texts)
    c, firsts, lasts = {}, {}, {}
    for u, v in zip(before.tolist(), own.tolist()):
        c[u, v] = c.get((u, v), 0) + 1
        firsts[u] = firsts.get(u, 0) + 1
    for u, v in c:
        lasts[v] = lasts.get(v, 0) + 1

    def cuts(values):
        n = [max(sum(x == k for x in values), 1) for k in range(1, 5)]
        y = n[0] / (n[0] + 2 * n[1])
        return [min(max(1 + k - (2 + k) * y * n[k + 1] / n[k], 0.01), 0.99 * (k + 1)) for k in range(3)]

    bar = max(2, next(k for k in range(1, 100) if sum(x >= k for x in c.values()) <= kept))
    d2, d1 = cuts(c.values()), cuts(lasts.values())
    mass = sum(d1[min(x, 3) - 1] for x in lasts.values()) / len(c)

    def p(u, v):
        lower = ((lasts[v] - d1[min(lasts[v], 3) - 1]) / len(c) if v in lasts else 0) + mass / perplexity.SYMBOLS
        part = lambda x: (x - d2[min(x, 3) - 1]) / firsts[u] if x >= bar else 0
        return part(c.get((u, v), 0)) + (1 - sum(part(x) for (w, _), x in c.items() if w == u)) * lower

    model = perplexity.fit(spark.createDataFrame([(t,) for t in [*texts, None]], "text string").repartition(5), kept=kept)
    assert len(model.keys) <= kept and (kept > 30 or len(model.keys) > 5)
    pairs = [*list(c)[:200], (before[0], 77), (999, own[0]), (999, 998)]
    got = np.exp(model.log_probability(*np.array(pairs, np.int64).T))
    assert np.allclose(got, [p(u, v) for u, v in pairs], rtol=1e-4)
    for context in [*list(firsts)[:10], 999]:
        assert np.exp(model.log_probability(np.full(perplexity.SYMBOLS, context), np.arange(perplexity.SYMBOLS))).sum() == pytest.approx(1, abs=1e-4)


def test_judge_leaves_no_bigram_out(spark, monkeypatch):
    """Every text's log-perplexity against the definition with dictionaries, over many chunks, where a model of 30 bigrams would differ."""
    monkeypatch.setattr(perplexity.fit, "__defaults__", ("text", 30))
    monkeypatch.setattr(perplexity, "COUNTED", 200)
    r = random.Random(2)
    words = ["".join(r.choices("abcdefgh", k=4)) for _ in range(60)]
    texts = [" ".join(r.choices(words, weights=range(1, 61), k=r.randrange(0, 60))) for _ in range(150)]
    rows = [*texts, *texts[:5], None, "", "once and never more", " ".join(words * 9)]
    c, firsts, lasts = {}, {}, {}
    for text in {x for x in rows if x}:
        for u, v in zip(*(x.tolist() for x in bigrams([text]))):
            c[u, v] = c.get((u, v), 0) + 1
            firsts[u] = firsts.get(u, 0) + 1
    for u, v in c:
        lasts[v] = lasts.get(v, 0) + 1
    assert sum(x > 1 for x in c.values()) > 500

    def cuts(values):
        n = [max(sum(x == k for x in values), 1) for k in range(1, 5)]
        y = n[0] / (n[0] + 2 * n[1])
        return [min(max(1 + k - (2 + k) * y * n[k + 1] / n[k], 0.01), 0.99 * (k + 1)) for k in range(3)]

    d2, d1 = cuts(c.values()), cuts(lasts.values())
    mass = sum(d1[min(x, 3) - 1] for x in lasts.values()) / len(c)
    part = {(u, v): (x - d2[min(x, 3) - 1]) / firsts[u] if x > 1 else 0 for (u, v), x in c.items()}
    rest = dict.fromkeys(firsts, 1.0)
    for (u, _), x in part.items():
        rest[u] -= x

    def log_perplexity(text):
        pairs = list(zip(*(x.tolist() for x in bigrams([text]))))
        p = [part[u, v] + rest[u] * ((lasts[v] - d1[min(lasts[v], 3) - 1]) / len(c) + mass / perplexity.SYMBOLS) for u, v in pairs]
        return -sum(map(math.log, p)) / len(p)

    df = spark.createDataFrame([(i, t, "en") for i, t in enumerate(rows)], "doc_id long, text string, lang string").repartition(3)
    got = {x.doc_id: x.log_perplexity for x in perplexity.judge(df).collect()}
    assert len(got) == len(rows)
    for i, t in enumerate(rows):
        assert got[i] == pytest.approx(log_perplexity(t), rel=1e-5) if t else got[i] is None


def test_judge(spark):
    good, junk = corpus()
    texts = [*good, *junk, *ODD]
    df = spark.createDataFrame([(i, t, None if i % 40 == 3 else "en", "x", 1.0) for i, t in enumerate(texts)], "doc_id long, text string, lang string, code string, log_perplexity double")
    rows = {r.doc_id: r for r in perplexity.judge(df).collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        r = rows[i]
        b = base(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == b
        assert r.base_failed == (b[0] < 20 or 100 * b[4] > 30 * b[0])
        assert not (r.kept and r.base_failed)
    assert all(rows[i].kept for i in range(len(good)))
    assert not any(rows[len(good) + i].kept for i in range(len(junk)))
    assert perplexity.judge(df.limit(0)).count() == 0
    assert perplexity.judge(df.filter("text is null")).first().kept is False


def labelled(n=1500):
    r = random.Random(6)
    words = ["".join(r.choices("abcdefgh", k=5)) for _ in range(400)]
    rows = []
    for i in range(n):
        w = r.choices(words, k=60)
        toxic = r.random() < 0.15
        if toxic:
            for bad in r.sample(["idiot", "moron", "scum", "clown", "grobble", "flimp"], 3):
                w[r.randrange(60)] = bad
        rows.append((i, " ".join(w), int(toxic)))
    return rows


def test_toxicity(spark):
    rows = labelled()
    docs = spark.createDataFrame([(i, t, 0.5, "x") for i, t, _ in rows], "doc_id long, text string, score double, predicted string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i % 3], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= got[i].score <= 1 and got[i].predicted == int(got[i].score >= 0.5) for i, _, _ in rows)
    held = [(got[i].predicted, y) for i, _, y in rows if got[i].held_out]
    assert sum(a == b for a, b in held) >= 0.97 * len(held)
    fires = dict(zip(toxicity.LEXICON, model.labels.toxic))
    assert fires["idiot"] > 0.3 and fires["ugly"] < 0.05
    kept = toxicity.reject(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(1 - g.predicted for g in got.values())


def test_labels_of_held_out_rows_are_not_read(spark):
    rows = labelled(400)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    a = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    b = spark.createDataFrame([(i, 1 - y if held(i) else y) for i, _, y in rows], "doc_id long, toxic int")
    assert np.array_equal(toxicity.fit(docs, a).weights, toxicity.fit(docs, b).weights)


def test_toxicity_odd_rows(spark):
    docs = spark.createDataFrame([(None, "x"), (1, None), (2, ""), (3, "you idiot moron clown"), (3, "you idiot moron clown"), (4, "word " * 50_000)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    odd = spark.createDataFrame([(None, 1), (1, None), (3, 1), (3, 0)], "doc_id long, toxic int")
    for labels in (none, odd):
        rows = toxicity.score(docs, toxicity.fit(docs, labels)).collect()
        assert len(rows) == 6 and all(math.isfinite(r.score) for r in rows) and not next(r for r in rows if r.doc_id is None).held_out
        empty = docs.limit(0)
        assert toxicity.score(empty, toxicity.fit(empty, labels)).count() == 0


def test_label_model_finds_rates_and_pairs():
    r = np.random.default_rng(2)
    y = r.random(200_000) < 0.2
    rates = [(0.4, 0.02), (0.5, 0.05), (0.3, 0.01), (0.35, 0.03), (0.45, 0.02)]
    fires = np.column_stack([r.random(len(y)) < np.where(y, a, b) for a, b in rates])
    fires = np.column_stack([fires, fires[:, 0]]).astype(float)
    m = toxicity.label_model(len(y), fires.T @ fires, 0.2)
    assert np.allclose(m.toxic[1:5], [a for a, _ in rates[1:]], atol=0.05)
    assert np.allclose(m.clean[1:5], [b for _, b in rates[1:]], atol=0.02)
    assert m.correlation[0, 5] > 0.3 and m.weight[0] < 0.9 and m.weight[1] > m.weight[0]


def test_label_model_is_bayes_without_correlations():
    """Log odds of all patterns of votes of independent voters, against the product of their rates."""
    toxic, clean = np.array([0.5, 0.3, 0.6, 0.05]), np.array([0.02, 0.1, 0.3, 0.2])
    model = toxicity.Labels(0.1, toxic, clean, np.ones(4), np.eye(4))
    for bits in range(16):
        fires = np.array([bits >> i & 1 for i in range(4)], bool)
        like = [prior * np.prod(np.where(fires, r, 1 - r)) for prior, r in ((0.1, toxic), (0.9, clean))]
        assert model.log_odds(fires[None])[0] == pytest.approx(math.log(like[0] / like[1]))


def test_label_model_against_all_triplets():
    """Differences of rates against the median over all triplets, by loops."""
    r = np.random.default_rng(5)
    y = r.random(20_000) < 0.3
    fires = np.column_stack([r.random(len(y)) < np.where(y, a, b) for a, b in r.random((7, 2)) * 0.8]).astype(float)
    both, n = fires.T @ fires, len(y)
    mean = np.diag(both) / n
    cov = both / n - np.outer(mean, mean)
    sure = lambda i, j: cov[i, j] > 3 * math.sqrt(mean[i] * (1 - mean[i]) * mean[j] * (1 - mean[j]) / n)
    m = toxicity.label_model(n, both, 0.3)
    for i in range(7):
        found = [cov[i, j] * cov[i, k] / cov[j, k] / 0.21 for j in range(7) for k in range(j) if i not in (j, k) and sure(i, j) and sure(i, k) and sure(j, k)]
        want = min(math.sqrt(np.median(found)), mean[i] / 0.3 * 0.98) if found else 0
        assert m.toxic[i] == pytest.approx(min(max(mean[i] + 0.7 * want, 0.5 / n), 1 - 1e-4)) and m.clean[i] == pytest.approx(max(mean[i] - 0.3 * want, 0.5 / n))


def test_words_of_one_stem(spark):
    """Toxic words that are all different, but begin alike, in texts that hold several of them; clean texts hold one at most."""
    r = random.Random(9)
    words = ["".join(r.choices("abcdefgh", k=5)) for _ in range(400)]
    rows = []
    for i in range(1500):
        w = r.choices(words, k=60)
        toxic = i % 9 == 0
        for _ in range(3 if toxic else r.random() < 0.1):
            w[r.randrange(60)] = "zoqurt" + "".join(r.choices("klmnop", k=4))
        rows.append((i, " ".join(w), int(toxic)))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    got = {x.doc_id: x for x in toxicity.score(docs, toxicity.fit(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"))).collect()}
    held = [(got[i].predicted, y) for i, _, y in rows if got[i].held_out]
    assert sum(p for p, y in held if y) >= 0.9 * sum(y for _, y in held) and sum(p for p, y in held if not y) <= 3


def test_mixing(spark):
    r = random.Random(3)
    rows = [(i, "w" * r.randrange(40, 400), r.choices(["a", "b", None], [6, 3, 1])[0], r.choice(["en", "de"]), "old", True) for i in range(4000)]
    rows += [(5000, None, "a", "en", "old", True), (None, "x", "b", None, "old", True), (5001, "", "only", "xx", "old", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, topic string, kept boolean")
    goal = spark.createDataFrame([("a", 0.4), ("b", 0.4), (mixing.NONE, 0.2), ("only", 0.0)], "source string, target double")
    out = mixing.mix(df, {"source": goal, "lang": 1.0, "topic": 1.0})
    assert out.count() == len(rows) and len(out.columns) == len(set(out.columns))
    got = {x["source"]: x["t"] for x in out.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("probability")).alias("t")).collect()}
    total = sum(v or 0 for v in got.values())
    assert got["a"] / total == pytest.approx(0.4, abs=0.01) and got[None] / total == pytest.approx(0.2, abs=0.01) and got["only"] == 0
    assert out.agg(F.max("probability")).first()[0] == 1
    kept = out.filter("kept").groupBy("source").agg(F.sum("n_tokens").alias("t"))
    kept = {x["source"]: x["t"] for x in kept.collect()}
    assert kept["a"] / sum(kept.values()) == pytest.approx(0.4, abs=0.05)
    assert mixing.mix(df.limit(0)).count() == 0


def test_raking_meets_all_marginals(spark):
    """Sweeps end when every marginal is met; probabilities are those of raking by hand; values that a table lacks keep their share."""
    r = random.Random(4)
    rows = [(s, g, t, r.randrange(1, 1000)) for s in "abcdef" for g in ("en", "de", "xx") for t in ("u", "v", "w")] + [("z", "en", "u", 0)]
    cells = spark.createDataFrame(rows, "source string, lang string, topic string, observed long")
    targets = {"source": 0.5, "lang": {"en": 0.5, "de": 0.1}, "topic": {"u": 0.2, "v": 0.3, "w": 0.5}}
    got = {(x.source, x.lang, x.topic): x.weight for x in mixing.fit(cells, ["source", "lang", "topic"], targets, error=1e-12, boost=100.0).collect()}
    whole = sum(x[3] for x in rows)
    share = lambda k, v: sum(x[3] for x in rows if x[k] == v) / whole
    want = [{s: share(0, s) ** 0.5 for s in "abcdefz"}, {"en": 0.5, "de": 0.1, "xx": share(1, "xx")}, targets["topic"]]
    want = [{k: v / sum(w.values()) for k, v in w.items()} for w in want]
    for k in range(3):
        for v, goal in want[k].items():
            assert sum(w for x, w in got.items() if x[k] == v) == pytest.approx(goal, rel=1e-9, abs=1e-15)
    hand = {x[:3]: float(x[3]) for x in rows}
    for _ in range(60):
        for k in range(3):
            sums = {v: sum(w for x, w in hand.items() if x[k] == v) for v in want[k]}
            hand = {x: w * want[k][x[k]] / sums[x[k]] if sums[x[k]] else 0.0 for x, w in hand.items()}
    assert all(got[x] == pytest.approx(w, rel=1e-9, abs=1e-15) for x, w in hand.items())


def test_mixing_sql(spark):
    from turnlake.llm.queries import op9_mixing

    sf = "/root/testdata/sf0.001"
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = sorted(c.sql(f"SELECT doc_id, topic, n_tokens, probability, kept FROM ({mixing.mix_sql()})").fetchall())
    assert sorted((r.doc_id, r.topic, r.n_tokens, r.probability, r.kept) for r in op9_mixing(spark, sf).collect()) == want
