"""Near-duplicates, components and repeated passages against brute force."""

import random
import re

import numpy as np
import xxhash

from turnlake.llm import common, simhash, substring

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fingerprint(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(n, links):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def texts():
    r = random.Random(5)
    vocabulary = ["".join(r.choices("abcdefgh", k=5)) for _ in range(300)]
    base = [" ".join(r.choices(vocabulary, k=400)) for _ in range(12)]
    near = []
    for b in base:
        for k in range(4):
            w = b.split()
            for _ in range(k):
                w[r.randrange(len(w))] = r.choice(vocabulary)
            near.append(" ".join(w))
    return [*near, *near[:5], None, "", " \n\t", "One", "one", "A  b", "a b", "a b c", "É a b", "x " * 50_000]


def test_simhash(spark):
    all_texts = texts()
    df = spark.createDataFrame([(i + 10, t, "x", i) for i, t in enumerate(all_texts)], "doc_id long, text string, fp string, component_id int")
    fps = np.array([fingerprint(t) for t in all_texts], np.uint64)
    links = [(i, j) for i in range(len(fps)) for j in np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= 2)]
    want = classes(len(fps), links)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(df, width=3).collect()}
    assert got == {i + 10: (f"{int(fps[i]):016x}", want[i] + 10) for i in range(len(fps))}
    kept = simhash.deduplicate(df, width=3)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({w + 10 for w in want})


def test_simhash_balls(spark):
    r = random.Random(1)
    values = {0, (1 << 64) - 1, 1 << 63}
    while len(values) < 400:
        v = r.choice(sorted(values))
        for _ in range(r.randrange(1, 5)):
            v ^= 1 << r.randrange(64)
        values.add(v)
    fps = np.array(sorted(values), np.uint64)
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    index = {int(x): i for i, x in enumerate(fps.view(np.int64))}
    for radius in (1, 2):
        got = classes(len(fps), [(index[e.u], index[e.v]) for e in simhash.links(df, radius).collect()])
        assert got == classes(len(fps), [(i, j) for i in range(len(fps)) for j in np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= radius)])


def test_simhash_odd_rows(spark):
    df = spark.createDataFrame([(None, "a b c"), (1, "a b c"), (1, "a b c"), (2, "a b c"), (3, None), (4, "q r s t")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id) for r in simhash.near_duplicates(df).collect()), key=str)
    assert got == sorted([(None, 1), (1, 1), (1, 1), (2, 1), (3, 3), (4, 4)], key=str)
    assert sorted((r.doc_id or 0) for r in simhash.deduplicate(df).collect()) == [0, 1, 3, 4]
    none = df.limit(0)
    assert simhash.near_duplicates(none).count() == 0 and simhash.deduplicate(none).count() == 0


def test_components(spark):
    r = random.Random(2)
    chain = [(i, i + 1) for i in range(100, 180)]
    star = [(500, i) for i in range(501, 560)]
    pairs = [*chain, *star, (7, 7), (8, 9), (9, 8)] + [(r.randrange(1000, 1100), r.randrange(1000, 1100)) for _ in range(60)]
    nodes = sorted({x for p in pairs if p[0] != p[1] for x in p})
    at = {x: i for i, x in enumerate(nodes)}
    want = classes(len(nodes), [(at[a], at[b]) for a, b in pairs if a != b])
    got = common.components(spark.createDataFrame(pairs, "u long, v long")).collect()
    assert sorted((r.node, r.component) for r in got) == sorted((x, nodes[want[i]]) for i, x in enumerate(nodes))
    assert common.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_words(spark):
    import pyarrow as pa

    values = ["a b", None, "", "b", " a\x1cb  ", "ab", "b\n"]
    for column in (pa.array(values), pa.array(["x", *values]).slice(1), pa.chunked_array([values]).combine_chunks()):
        w = common.Words(column)
        data = w.data.tobytes()
        found = [[data[w.starts[i] : w.ends[i]].decode() for i in range(w.first[k], w.first[k + 1])] for k in range(len(values))]
        assert found == [WORD.findall(v or "") for v in values]
        h = w.hashes()
        assert h[1] == h[2] == h[-1] and h[0] != h[1]


def passages():
    r = random.Random(9)
    vocabulary = ["".join(r.choices("abcdefghijk", k=r.randrange(2, 8))) for _ in range(5000)]
    draw = lambda n: " ".join(r.choices(vocabulary, k=n))
    shared = [draw(55), draw(80), draw(120)]
    docs, planted = [], {}
    for i in range(60):
        parts = [draw(r.randrange(20, 200)) for _ in range(3)]
        if i % 3 == 0:
            k = (i // 3) % 3
            parts[1] = f"{parts[1]} {shared[k]} {draw(30)}"
            planted[i] = k
        docs.append("\n".join(parts))
    line = draw(100).split()
    for k in range(3):
        changed = list(line)
        if k:
            changed[40 + k] = "other"
        docs.append(draw(40) + "\n" + " ".join(changed) + "\n" + draw(40))
    return docs, planted, shared


def test_repeats(spark):
    docs, planted, shared = passages()
    df = spark.createDataFrame([(i, t, 1, "y") for i, t in enumerate(docs)], "doc_id long, text string, start int, component_id string")
    got = substring.repeats(df).collect()
    first = {k: min(i for i in planted if planted[i] == k) for k in range(3)}
    want = {i for i in planted if i != first[planted[i]]}
    assert {r.doc_id for r in got if r.doc_id < 60} == want
    assert all(r.kept_id == first[planted[r.doc_id]] for r in got if r.doc_id < 60)
    # lines that differ in a word of a hundred: found by banding, verified by Jaccard
    assert {r.doc_id for r in got if r.doc_id >= 60} == {61, 62}
    assert all(r.n_words >= 100 for r in got if r.doc_id >= 60)
    cut = {r.doc_id: r.text for r in substring.remove(df, substring.repeats(df)).collect()}
    assert len(cut) == len(docs)
    for i, t in enumerate(docs):
        if i in want or i >= 61:
            assert len(WORD.findall(t)) - len(WORD.findall(cut[i])) >= 16
            assert shared[planted[i]] not in cut[i] if i in planted else True
        else:
            assert cut[i] == t


def test_line_pairs(spark):
    """All pairs of lines at the bar or above are in one class; those that share nothing are not."""
    r = random.Random(4)
    vocabulary = ["".join(r.choices("abcdefghijk", k=6)) for _ in range(3000)]
    lines = []
    for _ in range(15):
        base = r.choices(vocabulary, k=90)
        for _ in range(6):
            w = list(base)
            for _ in range(r.randrange(0, 4)):
                w[r.randrange(len(w))] = r.choice(vocabulary)
            lines.append(w)
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in lines]
    links = [(i, j) for i in range(len(lines)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    want = classes(len(lines), links)
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(lines)], "doc_id long, text string")
    units = common.scratch(substring.paragraphs(df), "t")
    ids = {r.doc: r.id for r in units.filter("line").collect()}
    at = {v: k for k, v in sorted(ids.items(), reverse=True)}
    found = substring.line_classes(df, units, "doc_id", "text").collect()
    same = [(i, at[ids[i]]) for i in range(len(lines))]
    got = classes(len(lines), [*same, *((at[e.id], at[e.component]) for e in found)])
    whole = classes(len(lines), [*links, *same])
    assert whole == want
    missed = sum(got[i] != got[j] for i, j in links)
    assert missed <= 0.02 * len(links)
    assert all(want[i] == want[got[i]] for i in range(len(lines)))


def test_lines_that_drawn_lines_do_not_link(spark):
    """Variants of one line that are under the bar to most others, but reach it in pairs and chains: no link is lost."""
    r = random.Random(5)
    vocabulary = ["".join(r.choices("abcdefghijk", k=6)) for _ in range(3000)]
    base = r.choices(vocabulary, k=40)
    lines = []
    for i in range(60):
        w = list(base)
        w[r.randrange(3, 37)] = f"x{i}"
        lines.append(w)
        if i % 3 == 0:  # a neighbour: the last word changed as well
            lines.append([*w[:-1], f"y{i}"])
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in lines]
    links = [(i, j) for i in range(len(lines)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    want = classes(len(lines), links)
    assert 20 <= len(links) and len(set(want)) > 20
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(lines)], "doc_id long, text string")
    units = common.scratch(substring.paragraphs(df), "t")
    at = {r.id: r.doc for r in units.filter("line").collect()}
    found = [(at[e.id], at[e.component]) for e in substring.line_classes(df, units, "doc_id", "text").collect()]
    assert classes(len(lines), found) == want


def test_repeats_with_short_periods(spark):
    """A repeated passage of words that recur every few words, inside longer lines that share nothing else."""
    r = random.Random(12)
    draw = lambda n: " ".join("".join(r.choices("abcdefghijk", k=6)) for _ in range(n))
    for period in (1, 2, 3, 4):
        passage = " ".join(draw(period).split() * (64 // period))
        df = spark.createDataFrame([(i, f"{draw(40)} {passage} {draw(40)}") for i in range(3)], "doc_id long, text string")
        got = substring.repeats(df).collect()
        assert {x.doc_id for x in got} == {1, 2} and all(x.n_words >= 50 for x in got)


def test_repeats_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(None, long), (1, long), (1, long), (2, long), (3, None), (4, ""), (5, "a"), (6, long + " x"), (6, "short other text"), (7, "tail " * 20_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = substring.repeats(df)
    assert {(r.doc_id, r.kept_id, r.n_words) for r in got.collect() if r.doc_id not in (6, 7)} == {(2, 1, 60)}
    assert {(r.kept_id, r.text_key is None) for r in got.collect() if r.doc_id == 6} == {(1, False)}
    kept = substring.remove(df, got)
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 1, 3, 4, 5, 6, 7]
    assert [r.text for r in kept.collect() if r.doc_id == 6] == ["short other text"]
    clash = df.selectExpr("*", "1 AS cut_id", "2 AS _cut_id", "'z' AS cuts", "3 AS n_cuts", "4 AS line")
    assert substring.remove(clash, substring.repeats(clash)).columns == clash.columns and substring.remove(clash, got).count() == 8
    none = df.limit(0)
    assert substring.repeats(none).count() == 0 and substring.remove(none, got).count() == 0
