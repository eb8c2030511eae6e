"""Main text, urls and exact search."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from turnlake.llm import html_text, topk, urls

ARTICLE = """<html><body class="has-sidebar"><header><h1>Site</h1></header><div id="cookie-notice">We use cookies</div><main><article><header><h1>Title &amp; more</h1></header>
<p>One <b>bold</b>
 text.<p>Two<script>var x="</p>";</script></p><div class="ad-slot">Buy</div><form><p>Mail</p></form><ul><li>a<li>b</ul><section class="comments"><p>first!</p></section></article></main><aside>x</aside><div class=footer>f</div>"""


def test_article():
    assert html_text.main_text(ARTICLE) == "Title & more\nOne bold text.\nTwo\na\nb"
    assert html_text.main_text("<p>a<!-- <p>x --> b</p>text &lt;p&gt;&#x41;<br>c &am") == "a b\ntext <p>A c &am"
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<div>") == ""
    assert html_text.main_text("<p hidden>x</p><div style='display: none'>y</div><p>z</p><script>never closed <p>") == "z"
    assert html_text.main_text("a < b <p>c</p>") == "a < b\nc"


def test_deep_and_long():
    assert html_text.main_text("<p>" + "word " * 50_000 + "</p>").count("word") == 50_000
    assert html_text.main_text("<div>" * 300 + "in" + "</div>" * 300 + "<p>out") == "in\nout"


def unlike(depth, turn):
    """A tree in which every level has its children in another order than the one of the other turn."""
    out = "x"
    for k in range(depth):
        out = "".join(f"<{t} class='{c}'>{out if c == 'k' else ''}</{t}>" for t, c in sorted((("div", "k"), ("p", "y"), ("ul", "z")), key=lambda x: x[1], reverse=bool((k + turn) % 2)))
    return out


def test_deep_and_unlike_trees(spark):
    """Trees of any depth, and trees whose levels are all in another order, in bounded time."""
    rows = [(i, f"http://d.org/{i}", "<div>" * 5000 + f"in {i}" + "</div>" * 5000 + "<p>out") for i in range(6)]
    rows += [(10 + i, f"http://e.org/{i}", unlike(40, i % 2)) for i in range(6)]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert len(got) == 12 and all(got[i] == f"in {i}" for i in range(6))


def test_menus_without_names(spark):
    """A menu of 60 entries that all pages have, and one whose entries vary but are links: the wrapper tells both."""
    entries = "".join(f"<p>Section {k}</p>" for k in range(60))
    r = random.Random(2)
    link = lambda: f"<li><a href='/'>{''.join(r.choices('abcdef', k=5))} {r.randrange(99)}</a>"
    bodies = [f"<div class='xa'>{entries}</div><div class='xb'><ul>{''.join(link() for _ in range(5))}</ul></div><div class='xc'><h2>Title {i}</h2><p>{'word ' * 30}{i}</p><ul><li>point {i}</ul></div><div class='xd'>Short line {i}</div>" for i in range(40)]
    for i, lines in extracted(spark, bodies).items():
        assert lines == [f"Title {i}", f"{'word ' * 30}{i}", f"point {i}"]


def verdicts(bodies):
    """Texts by the definition, for pages of one host, with dictionaries over the aligned trees."""
    trees = [html_text.of_page(html_text.parse(b)[0]) for b in bodies]
    wrapper = html_text.bare(trees[0])
    for t in trees[1:]:
        wrapper = html_text.merge(wrapper, html_text.bare(t))
    pages, texts, paths = {}, {}, {}
    for t in trees:
        seen = {}
        for place, node in html_text.align(wrapper, t):
            seen.setdefault((place, node["p"]), []).extend(node["t"])
            paths.setdefault((place, node["p"]), [0, 0, False])[2] |= node["i"]
        for at, own in seen.items():
            pages[at] = pages.get(at, 0) + 1
            paths[at][0] += sum(w for _, w, _ in own)
            paths[at][1] += sum(x for _, _, x in own)
            for text in {x for x, _, _ in own}:
                texts.setdefault((at, text), []).append(sum(w for x, w, _ in own if x == text))
    share, total = {}, {}
    for (at, text), words in texts.items():
        if pages[at] >= 4 and len(words) >= 0.5 * pages[at]:
            x = len(words) / pages[at]
            share[at[1], text] = max(share.get((at[1], text), 0), x if pages[at] >= 20 else min(x, 0.89))
            total[at[1]] = total.get(at[1], 0) + sum(words)
    flat = {}
    for at, (words, links, inside) in paths.items():
        if pages[at] >= 4:
            f = flat.setdefault(at[1], [0, 0, False, 0])
            f[0], f[1], f[2], f[3] = f[0] + words, f[1] + links, f[2] or inside, f[3] + pages[at]
    menus = {p for p, (words, links, inside, n) in flat.items() if links >= 0.8 * words and links >= n and not inside}
    own = {p: max(words - links - total.get(p, 0), 0) for p, (words, links, _, _) in flat.items()}
    mass = {p: sum(v for q, v in own.items() if f"{q}/".startswith(f"{p}/")) for p in {"/".join(p.split("/")[:k]) for p in own for k in range(1, p.count("/") + 2)}}
    region = max((p for p in mass if mass[""] and mass[p] >= 0.85 * mass[""] and 2 * own.get(p, 0) < mass[p]), key=len, default="")
    out = []
    for b in bodies:
        blocks = [(t, n) for t, n in html_text.parse(b)[1] if not n.out]
        blocks = [x for x in blocks if x[1].inside] if any(n.inside for _, n in blocks) else blocks
        keep = []
        for text, n in blocks:
            x = share.get((n.path, text), 0)
            if n.inside:
                stays = x < 0.9 or len(text.split()) >= 12
            else:
                stays = not x and n.path not in menus and (f"{n.path}/".startswith(f"{region}/") or n.tag in ("h1", "h2", "h3"))
            keep += [text] if stays else []
        out.append(keep or [""])
    return dict(enumerate(out))


def test_extract_by_definition(spark):
    r = random.Random(11)
    word = lambda: "".join(r.choices("abcdefgh", k=4))
    part = lambda: r.choice(["<p>{}</p>", "<div class='a'><p>{}</p></div>", "<ul><li><a href=x>{}</a></li><li>{}</li></ul>", "<h2>{}</h2>", "<article><p>{}</p><p>Read on</p></article>", "<div class='b'>Same<p>{}</p></div>", "<section><a>{}</a></section>"])
    bodies = ["".join(part().replace("{}", " ".join(word() for _ in range(r.randrange(1, 9)))) for _ in range(r.randrange(1, 7))) for _ in range(60)]
    bodies = [f"<html><body>{b}</body></html>" for b in bodies]
    rows = [(i, f"http://h.org/{i}", b) for i, b in enumerate(bodies)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    for limit in (32 << 20, 0):
        got = {x.page_id: x.text.split("\n") for x in html_text.extract(df, broadcast_bytes=limit).collect()}
        assert got == verdicts(bodies)


def pages(n=40):
    r = random.Random(3)
    words = ["".join(r.choices("abcdefgh", k=5)) for _ in range(300)]
    draw = lambda k: " ".join(r.choices(words, k=k))
    out, want = [], []
    for i in range(n):
        title, body = draw(5), [draw(40) for _ in range(r.randrange(1, 5))]
        side = "<div class='box'><p>Welcome to our site</p></div>" if i % 7 else "<div class='box'><p>Welcome to our site</p><p>Sale today</p></div>"
        out.append((i, f"http://Shop.example.com/p/{i}", f"<html><body><div class='top'><p>Our great shop</p></div>{side}<div class='text'><h2>{title}</h2>{''.join(f'<p>{p}</p>' for p in body)}</div><div class='end'><p>Call us now</p></div>"))
        want.append("\n".join([title, *body]))
    return out, want


def test_wrapper(spark):
    rows, want = pages()
    rows += [(100, None, None), (101, "http://other.org/x", "<p>single page</p>"), (101, "http://other.org/x", "<p>single page</p>"), (None, "no host", "<article><p>x</p></article>"), (103, "http://e.org", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("clash")).withColumn("text", F.lit(1)).repartition(5)
    for limit in (64 << 20, 0):
        got = {r.page_id: r for r in html_text.extract(df, broadcast_bytes=limit).collect()}
        fixed = {"Our great shop", "Welcome to our site", "Call us now", "Sale today"}
        for i, w in enumerate(want):
            assert "\n".join(x for x in got[i].text.split("\n") if x != "Sale today") == w
            assert not ({*got[i].text.split("\n")} & fixed - {"Sale today"})
            assert got[i].n_chars == len(got[i].text)
        assert got[101].text == "single page" and got[100].text == "" and got[None].text == "x" and got[103].n_chars == 0
    assert html_text.extract(df).count() == len(rows)
    assert html_text.extract(df.limit(0)).count() == 0


def extracted(spark, bodies):
    """Texts of one host's pages, which lie in order in one task."""
    rows = [(i, f"http://h.org/{i}", f"<html><body>{b}</body></html>") for i, b in enumerate(bodies)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    return {r.page_id: r.text.split("\n") for r in html_text.extract(df).collect()}


def test_template_among_many_texts(spark):
    """A line of every page is template however many other texts its node has, one of 17 pages in 20 is not inside an article."""
    line = lambda x: f"<p>{x}</p>"
    bodies = ["<article>" + "".join(line(f"text {k} of {i}") for k in range(30)) + line("Subscribe now") + (line("Not a template") if i % 20 < 17 else "") + "</article>" for i in range(100)]
    got = extracted(spark, bodies)
    for i in range(100):
        assert got[i] == [f"text {k} of {i}" for k in range(30)] + ["Not a template"] * (i % 20 < 17)


def test_late_and_rare_nodes(spark):
    """Templates of nodes that pages have only after many others, or only few pages have; one page's own texts stay."""
    late, rare = "<div class='late'><p>New design</p></div>", "<div class='rare'><p>Week of sales</p></div>"
    bodies = [f"<div class='text'><p>page {i}</p></div>{late if i > 250 else ''}{rare if i % 125 == 3 else ''}" for i in range(600)]
    assert extracted(spark, bodies) == {i: [f"page {i}"] for i in range(600)}


def test_wrapper_of_many_nodes(spark, monkeypatch):
    """What a full wrapper drops is counted by its path."""
    monkeypatch.setattr(html_text, "NODES", 40)
    many = html_text.trim({"l": "", "n": 90, "c": [{"l": f"p.x{i}", "n": i + 1, "c": []} for i in range(60)]})
    assert len(many["c"]) < 40 and many["c"][-1]["n"] == 60
    page = html_text.of_page(html_text.parse("<div><p class='y'>a</p><p class='z'>b</p></div>")[0])
    places = {(x, n["p"]) for x, n in html_text.align(html_text.of_page(html_text.parse("<div><p class='y'>c</p></div>")[0]), page)}
    assert places == {("", ""), (".0", "/div"), (".0.0", "/div/p.y"), ("~/div/p.z", "/div/p.z")}


def test_tree_matching():
    tree = lambda s: html_text.of_page(html_text.parse(s)[0])
    a, b = tree("<div><h1>x</h1><ul><li>1</ul><p>y</p></div>"), tree("<div><h1>x</h1><p>z</p></div>")
    assert html_text.match(a["c"][0]["c"], b["c"][0]["c"]) == [(0, 0), (2, 1)]
    merged = html_text.merge(a, b)["c"][0]
    assert [(c["l"], c["n"]) for c in merged["c"]] == [("h1", 2), ("ul", 1), ("p", 2)]
    assert html_text._weight(a, b, {}) == 4


def rule_of(host, path):
    best = None
    for text, says in urls.RULES:
        name, _, rest = text.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith("/" + rest) and (best is None or len(text) > len(best[0])):
            best = (text, says)
    return best or (None, None)


def split(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    return (re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")


URLS = [None, "", "foo", "HTTP://Example.COM/en/1", "http://a.net", "http://www.example.com/en/x?y#z", "http://wwwexample.com/en/", "://net/es/", "http://q.net?a=/es/", "http://x.net/es", "http://y.fr/fr/://z.net/fr/", "a://b.com/", "a://b.com", "http://É.com/É\n?x"]


def test_urls(spark):
    rows = [(i, u) for i, u in enumerate(URLS)] + [(None, URLS[3]), (3, URLS[3])]
    df = spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit(1)).withColumn("rule", F.lit(2))
    got = urls.judge(df).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.page_id is None:
            continue
        host, path = split(URLS[r.page_id])
        rule, says = rule_of(host, path)
        assert (r.host, r.path, r.rule) == (host, path, rule) and (says is None or r.verdict == says) and r.verdict in ("allow", "block")
    assert urls.judge(df.limit(0)).count() == 0
    assert urls.judge(spark.createDataFrame([(1, None)], "page_id long, url string")).first().verdict == "allow"


def tree(rows, rules):
    """Purity and evidence of every url by the definition, host by host, with dictionaries; rows are (host, path, verdict of a rule)."""
    sums = lambda some: (sum(v == "block" for _, _, v in some), sum(v is not None for _, _, v in some))
    smooth = lambda b, l, prior: (b + urls.ALPHA * prior) / (l + urls.ALPHA)
    domain = lambda h: ".".join(h.split(".")[-2:])
    b, l = sums(rows)
    prior, out = (b + 1) / (l + 2), {}

    def grow(some, at, purity, template):
        own = [(f, x) for f, x in some if len(f) > at]
        for f, _ in some:
            out[host, "/".join(f)] = (purity, template + ("/**" if len(f) > at and len(own) < urls.SPLIT else ""))
        if len(own) < urls.SPLIT:
            return
        n = {}
        for f, _ in own:
            n[f[at]] = n.get(f[at], 0) + 1
        kept = lambda seg: seg if n[seg] >= urls.SUPPORT * len(own) else "*"
        shape = lambda f: re.sub(r"[^\W\d_]+", "a", f[at + 1] if len(f) > at + 1 else "")
        branches = {}
        for f, x in own:
            branches.setdefault(kept(f[at]), []).append((f, x))
        share = lambda rows, s: sum(shape(f) == s for f, _ in rows) / len(rows)
        shapes = {shape(f) for f, _ in own}
        like = {k: 1 - sum(min(share(r, s), share(own, s)) for s in shapes) <= urls.UNLIKE + len(r) ** -0.5 for k, r in branches.items()}
        count = {k: sums([x for _, x in r]) for k, r in branches.items()}
        told = sorted((smooth(*count[k], purity), k) for k in branches if like[k] and count[k][1])
        groups = []
        for i, (rate, k) in enumerate(told):
            if i:
                before, (b0, l0), (b1, l1) = told[i - 1][0], count[told[i - 1][1]], count[k]
                both = (b0 + b1 + urls.ALPHA * purity) / (l0 + l1 + urls.ALPHA)
                if abs(rate - before) <= urls.Z * (both * (1 - both) * (1 / (l1 + 1) + 1 / (l0 + 1))) ** 0.5:
                    groups[-1].append(k)
                    continue
            groups.append([k])
        rest = [k for k in branches if like[k] and not count[k][1]]
        if len(groups) == 1:
            groups[0] += rest
        elif rest:
            groups.append(rest)
        groups += [[k] for k in branches if not like[k]]
        for g in groups:
            name = "|".join(sorted(g))
            grow([x for k in g for x in branches[k]], at + 1, smooth(sum(count[k][0] for k in g), sum(count[k][1] for k in g), purity), f"{template}/{name}")

    for host in {h for h, _, _ in rows}:
        own, near = [r for r in rows if r[0] == host], [r for r in rows if domain(r[0]) == domain(host)]
        grow([(re.sub("[0-9]+", "0", re.sub("^/", "", r[1])).split("/"), r) for r in own], 0, smooth(*sums(own), smooth(*sums(near), prior)), "")
    evidence = {h: sums([r for r in rows if domain(r[0]) == domain(h)])[1] >= urls.EVIDENCE for h, _, _ in rows}
    return out, evidence


def test_templates(spark):
    """Every url against the tree by its definition."""
    rules = [("s.org/spam/a", "block"), ("s.org/spam/b", "block"), ("s.org/news/", "allow"), ("s.org/junk/a", "block"), ("u.com/", "block"), ("www.u.com/ok/", "allow")]
    rows = [f"http://s.org/spam/{c}{i}" for c in "abc" for i in range(40)] + [f"http://s.org/news/{i}" for i in range(60)] + [f"http://s.org/other/{i}" for i in range(30)] + [f"http://t.org/spam/c{i}" for i in range(30)]
    rows += [f"http://s.org/junk/{c}{'xyz'[i % 3]}" for i in range(30) for c in "abcdefghijklmnopqrstuvwxyz"] + [f"http://s.org/deep/{'/'.join('abcdefghijk')}/{i}" for i in range(9)]
    rows += [f"http://{h}.u.com/{p}/{i}.html" for h in ("www", "m", "x") for p in ("ok", "de", "en") for i in range(6)] + ["http://m.u.com/", "http://www.u.com", "http://q.net/" + "a/" * 3000, ""]
    df = spark.createDataFrame(list(enumerate(rows)), "page_id long, url string")
    got = {r.page_id: r for r in urls.judge(df, rules).collect()}
    split_ = [(*split(u), None) for u in rows]

    def says(h, p):
        fits = [(t, v) for t, v in rules if (h == t.split("/")[0] or h.endswith("." + t.split("/")[0])) and p.startswith("/" + t.partition("/")[2])]
        return max(fits, key=lambda x: len(x[0]))[1] if fits else None

    told = [(h, p, says(h, p)) for h, p, _ in split_]
    want, evidence = tree(told, rules)
    for i, (h, p, v) in enumerate(told):
        purity, template = want[h, re.sub("[0-9]+", "0", re.sub("^/", "", p))]
        assert got[i].template == template and got[i].purity == pytest.approx(purity, abs=1e-9), rows[i][:80]
        assert got[i].verdict == (v or ("block" if evidence[h] and purity >= urls.PURITY else "allow"))
    verdict = {u: got[i].verdict for i, u in enumerate(rows)}
    assert {verdict[f"http://s.org/spam/c{i}"] for i in range(40)} == {"block"} and {verdict[f"http://t.org/spam/c{i}"] for i in range(30)} == {"allow"}
    assert len({r.template for r in got.values()}) < 60


def brute(x, ids, k):
    out = []
    for q in range(len(ids)):
        if ids[q] % 100:
            continue
        s = sorted(((-int(sum(int(a) * int(b) for a, b in zip(x[q], x[j]))), int(ids[j])) for j in range(len(ids)) if ids[j] != ids[q]))
        out += [(int(ids[q]), r + 1, v, -n) for r, (n, v) in enumerate(s[:k])]
    return sorted(out)


def test_lists_stop_early():
    """On clustered vectors queries stop with a part of the lists read; on vectors without structure they can't. Scores are exact."""
    r = np.random.default_rng(7)
    centres = r.normal(size=(40, 24)) * np.where(r.random((40, 24)) < 0.15, 1000, 20)
    clustered = np.floor(centres[r.integers(0, 40, 3000)] + r.normal(size=(3000, 24)) * 15).astype(np.int64)
    ids = np.arange(3000)
    for x, most in ((clustered, 0.3), (np.floor(r.normal(size=(3000, 24)) * 300).astype(np.int64), 1.0)):
        lists = topk.Lists(x)
        got = topk.best(x, ids, x[::100], ids[::100], 10, lists)
        assert lists.asked == 30 and lists.read <= most * x.size * 30
        assert (lists.stopped >= 20) == (most < 1)
        want = [(q, -int(s), int(j)) for q in ids[::100] for s, j in sorted((-int(x[q] @ x[j]), int(j)) for j in ids if j != q)[:10]]
        assert [(a, int(c), int(b)) for a, b, c in zip(*got)] == want


@pytest.mark.parametrize(("block", "sent"), [(50, 0), (4096, 0), (50, 1 << 25), (4096, 1 << 25)])
def test_top_k(spark, block, sent):
    r = np.random.default_rng(4)
    x = r.normal(size=(700, 16)).astype(np.float32)
    x[300:420] = x[300]
    rows = [(i, [float(v) for v in x[i]], 1) for i in range(700)]
    bad = [(700, None, 1), (800, [1.0, None] * 8, 1), (900, [float("nan")] + [1.0] * 15, 1), (1000, [float("inf")] * 16, 1), (None, [1.0] * 16, 1)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>, rank int")
    got = sorted((g.query_id, g.rank, g.vec_id, g.score) for g in topk.top_k(df, F.col("vec_id") % 100 == 0, block=block, sent_bytes=sent).collect())
    ints = np.floor(x.astype(np.float64) * 1024).astype(np.int64)
    assert got == brute(ints, np.arange(700), 10)


def test_top_k_small_and_odd(spark):
    schema = "vec_id long, embedding array<float>"
    query = F.col("vec_id") % 100 == 0
    assert topk.top_k(spark.createDataFrame([], schema), query).count() == 0
    assert topk.top_k(spark.createDataFrame([(100, [1.0])], schema), query).count() == 0
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0]), (1, [1.0]), (2, []), (3, [-1.0, 1.0, 5.0]), (0, [1.0, 2.0])], schema)
    got = sorted((g.query_id, g.rank, g.vec_id, g.score) for g in topk.top_k(df, query).collect())
    assert got == [(0, 1, 1, 1 << 20), (0, 2, 1, 1 << 20), (0, 3, 3, 1 << 20), (0, 4, 2, 0)]
    long = spark.createDataFrame([(0, [1.0] * 20_000), (1, [0.5] * 20_000), (2, [2.0])], schema)
    assert [(g.vec_id, g.score) for g in topk.top_k(long, query).orderBy("rank").collect()] == [(1, 20_000 * 512 * 1024), (2, 2 << 20)]
    huge = spark.createDataFrame([(0, [3e38]), (1, [3e38]), (2, [-3e38])], schema)
    assert [g.score for g in topk.top_k(huge, query).orderBy("rank").collect()] == [(1 << 63) - 1, -(1 << 63)]
