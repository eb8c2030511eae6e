"""The pipeline's near-duplicates against brute force over exact similarities."""

import random
import re
from collections import Counter

import numpy as np
import xxhash

import corpus_pipeline
from turnlake.llm import similar

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {" ".join(words[i : i + 5]) for i in range(len(words) - 4)} or ({" ".join(words)} if words else set())


def brute(texts):
    """The least index of each text's component, and the pairs of a similarity of 0.8 or more."""
    sets, where, pairs = [shingles(t) for t in texts], {}, []
    for i, s in enumerate(sets):
        seen = Counter(j for g in s for j in where.get(g, ()))
        pairs += [(j, i) for j, n in seen.items() if 5 * n >= 4 * (len(s) + len(sets[j]) - n)]
        for g in s or {None}:
            where.setdefault(g, []).append(i)
    pairs += [(i, where[None][0]) for i in where.get(None, [])]
    of = list(range(len(texts)))

    def find(x):
        while of[x] != x:
            x = of[x]
        return x

    for i, j in pairs:
        a, b = find(i), find(j)
        of[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))], pairs


def texts():
    """Texts with some words in a thousand changed: similarities from 1 down to about 0.6, most of them beyond two bits of a SimHash."""
    r = random.Random(8)
    vocabulary = ["".join(r.choices("abcdefgh", k=6)) for _ in range(3000)]
    out = []
    for _ in range(40):
        base = r.choices(vocabulary, k=r.randrange(60, 500))
        for share in (0, 0.003, 0.006, 0.01, 0.015, 0.02, 0.03, 0.05):
            out.append(" ".join(r.choice(vocabulary) if r.random() < share else w for w in base))
    r.shuffle(out)
    return [*out, None, "", " \n", "One", "one", "A  b", "a b c d", "a b", out[0].upper(), "x " * 30_000, "x " * 30_001]


def test_similar(spark):
    rows = texts()
    want, pairs = brute(rows)
    assert sum(i != w for i, w in enumerate(want)) > 150
    df = spark.createDataFrame([(i + 10, t, 1) for i, t in enumerate(rows)], "doc_id long, text string, key int").repartition(4)
    got = {r.doc_id - 10: r.component_id - 10 for r in similar.similar_components(df).collect()}
    assert sum(got[i] == got[j] for i, j in pairs) >= 0.999 * len(pairs)
    assert [got[i] for i in range(len(rows))] == want
    kept = corpus_pipeline.drop_near_duplicates(spark, df, "")
    assert kept.columns == df.columns and sorted(r.doc_id - 10 for r in kept.collect()) == sorted(set(want))


def fingerprint(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[i : i + 5]) for i in range(len(words) - 4)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_near_duplicates_by_simhash(spark):
    """Links of SimHash that no sets of shingles show, and such that connect groups of similar texts; those of 0.8 stay."""
    r = random.Random(3)
    vocabulary = ["".join(r.choices("abcdefgh", k=6)) for _ in range(500)]
    rows = []
    for _ in range(4):
        words, other = r.sample(vocabulary, 11), r.choices(vocabulary, k=60)
        long = " ".join(words * 20)
        rows += [long, f"{long} {' '.join(other[:9])}", f"{' '.join(other[9:18])} {long}", f"{long} {' '.join(other[:9])} {other[20]}"]
        rows += [" ".join(other), " ".join([*other, other[0]]), " ".join(r.choices(vocabulary, k=60))]
    rows += [None, "", "a b c", "A  b c"]
    similar_to, pairs = brute(rows)
    fps = np.array([fingerprint(t) for t in rows], np.uint64)
    near = [(i, int(j)) for i in range(len(rows)) for j in np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= 2) if j > i]
    assert sum(similar_to[i] != similar_to[j] for i, j in near) >= 4 and any((i, j) not in near for i, j in pairs)
    want = list(range(len(rows)))
    for _ in rows:
        for i, j in pairs + near:
            want[i] = want[j] = min(want[i], want[j])
    df = spark.createDataFrame([(i + 10, t, 1) for i, t in enumerate(rows)], "doc_id long, text string, fp int").repartition(3)
    got = {x.doc_id - 10: x.component_id - 10 for x in similar.similar_components(df, radius=2).collect()}
    assert [got[i] for i in range(len(rows))] == want
    kept = corpus_pipeline.drop_near_duplicates(spark, df, "")
    assert kept.columns == df.columns and sorted(x.doc_id - 10 for x in kept.collect()) == sorted(set(want))


def test_similar_large_group(spark):
    """A bucket whose texts are alike in part: what the drawn ones leave apart is compared pair by pair."""
    r = random.Random(4)
    vocabulary = ["".join(r.choices("abcdefgh", k=6)) for _ in range(3000)]
    common = r.choices(vocabulary, k=300)
    rows = []
    for _ in range(12):
        own = r.choices(vocabulary, k=120)
        rows += [" ".join([*common, *own, *r.choices(vocabulary, k=k)]) for k in (0, 1, 2)]
    want, _ = brute(rows)
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {x.doc_id: x.component_id for x in similar.similar_components(df).collect()}
    assert [got[i] for i in range(len(rows))] == want and len(set(want)) == 12


def test_similar_odd_rows(spark):
    df = spark.createDataFrame([(None, "a b c"), (1, "a b c"), (1, "a b c"), (2, "a b c"), (3, None), (4, "q r s t")], "doc_id long, text string")
    assert sorted((x.doc_id or 0) for x in similar.deduplicate(df).collect()) == [0, 1, 3, 4]
    assert similar.deduplicate(df.limit(0)).count() == 0
