"""Main text of web pages by wrapper induction.

The DOM trees of a host's pages are merged into one wrapper: simple tree matching aligns the children of matched nodes (the largest
order-preserving match, by dynamic programming). Then every page is aligned with its host's wrapper, and what pages have at a node is
counted exactly by a shuffle: pages, pages for every text, words, words in links. The wrapper's verdict on a node: texts that most
pages share there are template; a node whose words are links is a menu, though its entries vary; the deepest node that holds REGION of
the host's words outside links and templates, in other blocks than its own, is the region of the content, and of what stands outside it
only headings are content. What varies inside is content. That needs several pages of a host. Elements that say by tag, role, class or id that they are menus, headers,
footers, sidebars, notices, adverts, forms or comments are hints: they are left out whatever the wrapper says, as is what stands outside
an article or main element where there is one, and they are all that a host of a single page has.

Tasks merge their own pages first, and wrappers of tasks are folded by at most FOLD at a time. A wrapper has no texts. Only one of more
than NODES nodes drops its rarest; what pages have there is counted all the same, by its path of labels. Trees are aligned down to DEPTH
levels; what lies below counts as part of the node there.
"""

from __future__ import annotations

import hashlib
import html
import json
import re

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnlake.llm.common import discard, prepare, scratch, tidy

NODES, CHECKED, HOSTS, FOLD, DEPTH = 2000, 64, 500, 64, 48
#: Counts that a task keeps before it passes them on.
COUNTS = 100_000
#: A text is template if at least so many pages have the node, and such a share of them the text: outside an article, inside one.
OUTSIDE, INSIDE, SHORT_WORDS = (4, 0.5), (20, 0.9), 12
#: A node outside articles is a menu if at least so much of its words is in links; the content's region holds so much of a host's words.
LINKS, REGION = 0.8, 0.85

_TOKEN = re.compile(r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)|([^<]+|<)", re.S)
_ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript iframe xmp noframes noembed template svg math object".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_DROPPED = frozenset("nav footer aside form button select option input menu dialog head datalist canvas audio video map fieldset optgroup".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar tablist".split())
_NAMES = frozenset("""ad ads adv advert adverts advertisement adsense advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice
newsletter subscribe subscription signup sidebar sidebars rail menu menus nav navbar navigation navi breadcrumb breadcrumbs footer footers colophon masthead topbar
comment comments commentlist reply replies respond disqus discussion share sharing social related recommended recommendations popup modal overlay widget widgets
toolbar pagination pager login signin search skip alert dialog copyright outbrain taboola dfp form feedback""".split())
_HEADERS = frozenset("header headers head pageheader siteheader".split())
_NEUTRAL = frozenset("has with no is js not without".split())
_CLOSES = {"p": frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()), "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "tbody"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "option": frozenset(["option"])}
_BLANK = re.compile(r"\s+")
_HEADING = re.compile(r"h[1-6]$")
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


class Node:
    """An element: label for matching, child elements, blocks of its own (text, words, words in links), whether hints leave it out or
    an article has it, and the path of labels down to it."""

    __slots__ = ("blocks", "children", "inside", "label", "level", "out", "path", "tag")

    def __init__(self, tag: str, label: str, out: bool, inside: bool, above: Node | None = None):
        self.tag, self.label, self.out, self.inside = tag, label, out, inside
        self.level = above.level + 1 if above else 0
        self.path = above.path if above and above.level >= DEPTH else f"{above.path}/{label}" if above else ""
        self.children: list[Node] = []
        self.blocks: list[tuple[str, int, int]] = []


def _dropped(tag: str, attributes: dict[str, str], inside: bool) -> bool:
    if tag in _DROPPED or tag == "header" and not inside:
        return True
    if not attributes or tag in ("html", "body", "main", "article"):
        names = attributes.get("class", "") if tag == "article" else ""
        return bool(names) and not {x.lower() for x in _PARTS.findall(names)}.isdisjoint(("comment", "comments", "reply", "related", "ad", "sponsored", "teaser"))
    if "hidden" in attributes or attributes.get("aria-hidden") == "true" or attributes.get("role", "").lower() in _ROLES:
        return True
    style = attributes.get("style", "").replace(" ", "").lower()
    if "display:none" in style or "visibility:hidden" in style:
        return True
    for name in f"{attributes.get('class', '')} {attributes.get('id', '')}".split():
        parts = [x.lower() for x in _PARTS.findall(name)]
        if parts and parts[0] not in _NEUTRAL and any(x in _NAMES or x in _HEADERS and not inside for x in (*parts, name.lower())):
            return True
    return False


def parse(text: str | None) -> tuple[Node, list[tuple[str, Node]]]:
    """The tree of block elements, and its blocks of text in page order; entities are decoded and white space is folded."""
    root = Node("", "", False, False)
    blocks: list[tuple[str, Node]] = []
    stack, parts = [root], []
    lower, link, linked = None, False, 0

    def flush() -> None:
        nonlocal linked
        if parts:
            block = _BLANK.sub(" ", html.unescape("".join(parts))).strip()
            parts.clear()
            if block:
                words = block.count(" ") + 1
                stack[-1].blocks.append((block, words, min(linked, words)))
                blocks.append((block, stack[-1]))
        linked = 0

    at, text = 0, text or ""
    while at < len(text):
        m = _TOKEN.match(text, at)
        at = m.end()
        if m[6] is not None:
            parts.append(m[6])
            if link:
                linked += len(m[6].split())
            continue
        tag = m[2] or m[5]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1] or m[4]:
            if tag == "a":
                link = False
            if tag in _INLINE:
                continue
            flush()
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
            continue
        if tag in _RAW:
            if not (m[3] or "").rstrip().endswith("/"):
                lower = lower or text.lower()
                end = lower.find(f"</{tag}", at)
                at = len(text) if end < 0 else (lower.find(">", end) + 1 or len(text))
            if tag not in ("svg", "math"):
                flush()
            continue
        if tag == "br" or tag == "wbr":
            if tag == "br":
                parts.append(" ")
            continue
        if tag == "a":
            link = True
        if tag in _INLINE and not (m[3] and re.search(r"(?i)hidden|display\s*:\s*none", m[3])):
            continue
        if tag in _VOID:
            if tag not in _INLINE:
                flush()
            continue
        flush()
        while len(stack) > 1 and tag in _CLOSES.get(stack[-1].tag, ()):
            stack.pop()
        attributes = {}
        for k, a, b, c in _ATTRIBUTE.findall(m[3] or ""):
            attributes.setdefault(k.lower(), a or b or c)
        top = stack[-1]
        inside = top.inside or tag in ("article", "main") or attributes.get("role", "") in ("article", "main") or attributes.get("itemprop", "") == "articleBody"
        tag = tag[:40]
        first = re.sub(r"\d+", "0", (attributes.get("class", "").split() or [""])[0])
        node = Node(tag, f"{tag}.{first[:40]}" if first else tag, top.out or _dropped(tag, attributes, top.inside), inside, top)
        top.children.append(node)
        stack.append(node)
        if m[3] and m[3].rstrip().endswith("/") and tag in _INLINE:
            stack.pop()
    flush()
    return root, blocks


def _key(text: str) -> str:
    return hashlib.md5(text.encode("utf-8", "replace")).hexdigest()[:16]


def key_of(column: str) -> Column:
    """_key() of a column."""
    return F.substring(F.md5(F.col(column)), 1, 16)


def _signed(text: str) -> int:
    value = xxhash.xxh64_intdigest(text.encode("utf-8", "replace"))
    return value - (1 << 64) if value >> 63 else value


def of_page(node: Node) -> dict:
    """A page's tree as a wrapper of one page; neighbours of one label become one node that holds the blocks of all."""
    if node.level >= DEPTH:
        blocks, stack = [], [node]
        while stack:
            top = stack.pop()
            blocks += top.blocks
            stack += reversed(top.children)
        return {"l": node.label, "n": 1, "t": blocks, "c": [], "i": node.inside, "p": node.path}
    children: list[dict] = []
    for child in node.children:
        made = of_page(child)
        if children and children[-1]["l"] == made["l"]:
            children[-1] = merge(children[-1], made, 0)
        else:
            children.append(made)
    return {"l": node.label, "n": 1, "t": node.blocks, "c": children, "i": node.inside, "p": node.path}


def match(a: list[dict], b: list[dict], known: dict | None = None) -> list[tuple[int, int]]:
    """Simple tree matching of two rows of children: pairs of the order-preserving match with most nodes.

    known keeps the weights of pairs of nodes, so that no pair is matched twice.
    """
    if [x["l"] for x in a] == [x["l"] for x in b]:
        return [(i, i) for i in range(len(a))]
    known = {} if known is None else known
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = max(table[i][j + 1], table[i + 1][j], table[i][j] + _weight(x, y, known))
    pairs, i, j = [], len(a), len(b)
    while i and j:
        if table[i][j] == table[i - 1][j]:
            i -= 1
        elif table[i][j] == table[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            pairs.append((i, j))
    return pairs[::-1]


def _weight(a: dict, b: dict, known: dict) -> int:
    """Nodes in the largest match of two trees; 0 if the roots differ."""
    if a["l"] != b["l"]:
        return 0
    key = (id(a), id(b))
    if key not in known:
        known[key] = 1 + sum(_weight(a["c"][i], b["c"][j], known) for i, j in match(a["c"], b["c"], known))
    return known[key]


def merge(a: dict, b: dict, pages: int = 1, known: dict | None = None) -> dict:
    """One wrapper of two whose roots match, without blocks; pages: 0 if both are parts of one page, so nodes count once and blocks stay."""
    known = {} if known is None else known
    children, i, j = [], 0, 0
    for x, y in [*match(a["c"], b["c"], known), (len(a["c"]), len(b["c"]))]:
        children += a["c"][i:x] + b["c"][j:y]
        if x < len(a["c"]):
            children.append(merge(a["c"][x], b["c"][y], pages, known))
        i, j = x + 1, y + 1
    if pages:
        return {"l": a["l"], "n": a["n"] + b["n"], "c": children}
    return {"l": a["l"], "n": 1, "t": a["t"] + b["t"], "c": children, "i": a["i"], "p": a["p"]}


def bare(node: dict) -> dict:
    """A page's tree without its blocks."""
    return {"l": node["l"], "n": node["n"], "c": [bare(c) for c in node["c"]]}


def trim(wrapper: dict) -> dict:
    """A wrapper of more than NODES nodes with the most frequent half of so many, any other as it is."""
    sizes: list[int] = []

    def walk(node: dict) -> None:
        sizes.append(node["n"])
        for c in node["c"]:
            walk(c)

    def cut(node: dict, least: int) -> dict:
        return {**node, "c": [cut(c, least) for c in node["c"] if c["n"] > least]}

    walk(wrapper)
    return wrapper if len(sizes) <= NODES else cut(wrapper, sorted(sizes, reverse=True)[NODES // 2])


def align(wrapper: dict, page: dict):
    """(place, node) of every node of a page: nodes of the wrapper by their place, others by their path of labels."""
    stack, weights = [(wrapper, page, "")], {}
    while stack:
        known, node, place = stack.pop()
        yield place if known else f"~{node['p']}", node
        at = {y: x for x, y in match(known["c"], node["c"], weights)} if known else {}
        for j, c in enumerate(node["c"]):
            stack.append((known["c"][at[j]] if j in at else None, c, f"{place}.{at.get(j)}"))


def main_text(page: str | None, known: dict | None = None, hints: bool = True) -> str:
    """Blocks of the page's content, a line each, by the wrapper's verdict (texts, menus, region) and the page's hints."""
    blocks = parse(page)[1]
    if hints:
        blocks = [b for b in blocks if not b[1].out]
        if any(node.inside for _, node in blocks):
            blocks = [b for b in blocks if b[1].inside]
    if not known:
        return "\n".join(t for t, _ in blocks)
    texts, menus, region = known["texts"], set(known["menus"]), known["region"]
    out = []
    for text, node in blocks:
        share = texts.get(f"{_key(node.path)} {_key(text)}", 0) if texts else 0
        inside = node.inside and hints
        if share and not (inside and (share < INSIDE[1] or len(text.split()) >= SHORT_WORDS)):
            continue
        if not inside and (_key(node.path) in menus or region and not f"{node.path}/".startswith(f"{region}/") and not _HEADING.match(node.tag)):
            continue
        out.append(text)
    return "\n".join(out)


def host(url: Column) -> Column:
    """After "://" up to "/", "?" or "#", lower case; empty without."""
    return F.lower(F.coalesce(F.regexp_extract(url.cast("string"), r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def wrappers(source: DataFrame) -> DataFrame:
    """(host, wrapper): the wrapper of every host as JSON, from all pages (host, html)."""

    def first(batches):
        found: dict[str, dict] = {}

        def rows():
            return pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array([json.dumps(w) for w in found.values()], pa.string())], names=["host", "wrapper"])

        for batch in batches:
            for h, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist()):
                one = bare(of_page(parse(page)[0]))
                found[h] = merge(found[h], one) if h in found else one
                if found[h]["n"] % CHECKED == 0:
                    found[h] = trim(found[h])
                if len(found) > HOSTS:
                    yield rows()
                    found.clear()
        if found:
            yield rows()

    def fold(table: pa.Table) -> pa.Table:
        whole = None
        for row in table.column("wrapper"):
            one = json.loads(row.as_py())
            whole = trim(merge(whole, one)) if whole else one
        return pa.table({"host": table.column("host")[:1], "wrapper": [json.dumps(whole)]})

    kind = "host string, wrapper string"
    parts = source.select("host", "html").mapInArrow(tidy(first), kind).withColumn("task", F.spark_partition_id())
    for _ in range(2):
        parts = parts.withColumn("task", F.floor(F.col("task") / FOLD)).groupBy("host", "task").applyInArrow(lambda key, t: fold(t).append_column("task", pa.array([key[1].as_py()], pa.int64())), f"{kind}, task bigint")
    return parts.select("host", "wrapper").groupBy("host").applyInArrow(fold, kind)


class ByHost:
    """A value of every host: in the worker, from a broadcast, where all take no more than so many bytes, else in a column of the rows."""

    def __init__(self, source: DataFrame, side: DataFrame, column: str, most: int):
        size = side.agg(F.sum(F.length(column) + F.length("host"))).first()[0] or 0
        self.column, self.shared = column, None
        if size <= most:
            self.shared = source.sparkSession.sparkContext.broadcast(dict(side.select("host", column).collect()))
            self.rows = source
        else:
            self.rows = source.join(side, "host", "left")

    def reader(self):
        """What gives the values of a batch, parsed; a worker keeps HOSTS of them."""
        seen: dict[str, dict] = {}

        def one(h, text):
            if text is None:
                return None
            if h not in seen:
                if len(seen) > HOSTS:
                    seen.clear()
                seen[h] = json.loads(text)
            return seen[h]

        def run(batch):
            hosts = batch.column("host").to_pylist()
            texts = map(self.shared.value.get, hosts) if self.shared else batch.column(self.column).to_pylist()
            return [one(h, t) for h, t in zip(hosts, texts)]

        return run

    def __getstate__(self):
        return {"column": self.column, "shared": self.shared}


def templates(source: DataFrame, broadcast_bytes: int) -> DataFrame:
    """(host, known): the wrapper's verdict of every host that has one, as JSON: shares of texts by "path text" from the lower of the two
    bars on, paths of menus, the path of the region. Pages (host, html) are counted exactly."""
    made = scratch(wrappers(source), "wrappers")
    by_host = ByHost(source, made, "wrapper", broadcast_bytes)

    def count(batches):
        values = by_host.reader()
        nodes: dict[tuple[str, str, str], list[int]] = {}
        texts: dict[tuple[int, str], list[int]] = {}
        names = ["node", "host", "path", "text", "n", "words", "links", "inside"]

        def rows():
            ids = [_signed(f"{h} {place}") for h, place, _ in nodes]
            columns = [pa.array(ids, pa.int64()), pa.array([h for h, _, _ in nodes], pa.string()), pa.array([p for _, _, p in nodes], pa.string()), pa.nulls(len(ids), pa.string()), *[pa.array([v[k] for v in nodes.values()], pa.int64()) for k in range(4)]]
            yield pa.RecordBatch.from_arrays(columns, names=names)
            ids = [node for node, _ in texts]
            columns = [pa.array(ids, pa.int64()), pa.nulls(len(ids), pa.string()), pa.nulls(len(ids), pa.string()), pa.array([t for _, t in texts], pa.string()), *[pa.array([v[k] for v in texts.values()], pa.int64()) for k in range(2)], *[pa.nulls(len(ids), pa.int64())] * 2]
            yield pa.RecordBatch.from_arrays(columns, names=names)
            nodes.clear()
            texts.clear()

        for batch in batches:
            for h, page, w in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), values(batch)):
                found: dict[tuple[str, str], list] = {}
                for place, node in align(w, of_page(parse(page)[0])):
                    own = found.setdefault((place, node["p"]), [{}, 0, 0, 0])
                    for text, words, links in node["t"]:
                        key = _key(text)
                        own[0][key] = own[0].get(key, 0) + words
                        own[1] += words
                        own[2] += links
                    own[3] = int(node["i"])
                for (place, path), (own, words, links, inside) in found.items():
                    total = nodes.setdefault((h, place, path), [0, 0, 0, 0])
                    for k, v in enumerate((1, words, links, inside)):
                        total[k] += v
                    if own:
                        node = _signed(f"{h} {place}")
                        for t, words in own.items():
                            total = texts.setdefault((node, t), [0, 0])
                            total[0] += 1
                            total[1] += words
                if len(nodes) + len(texts) > COUNTS:
                    yield from rows()
        if nodes:
            yield from rows()

    kind = "node bigint, host string, path string, text string, n bigint, words bigint, links bigint, inside bigint"
    counts = by_host.rows.select("host", "html", *(["wrapper"] if by_host.shared is None else [])).mapInArrow(tidy(count), kind)
    counts = counts.groupBy("node", "host", "path", "text").agg(*[F.sum(c).alias(c) for c in ("n", "words", "links", "inside")])
    counts = scratch(counts.filter(F.col("n") >= OUTSIDE[0] * OUTSIDE[1]), "template-counts")
    discard(made)
    nodes = counts.filter("text is null").filter(F.col("n") >= OUTSIDE[0]).select("node", "host", "path", F.col("n").alias("pages"), "words", "links", "inside")
    found = counts.filter("text is not null").select("node", "text", "n", F.col("words").alias("fixed")).join(nodes.select("node", "host", "path", "pages"), "node").filter(F.col("n") >= OUTSIDE[1] * F.col("pages"))
    share = F.col("n") / F.col("pages")
    found = found.withColumn("share", F.when(F.col("pages") >= INSIDE[0], share).otherwise(F.least(share, F.lit(INSIDE[1] - 0.01))))
    named = F.concat(key_of("path"), F.lit(" "), F.col("text"))
    found = scratch(found.select("host", "path", named.alias("name"), "share", "fixed"), "template-texts")
    paths = nodes.groupBy("host", "path").agg(*[F.sum(c).alias(c) for c in ("pages", "words", "links", "inside")])
    menus = paths.filter((F.col("links") >= LINKS * F.col("words")) & (F.col("links") >= F.col("pages")) & (F.col("inside") == 0))
    # Words neither in links nor in templates, summed up the paths. The region is the deepest node that holds REGION of them, most of
    # these not in blocks of its own.
    fixed = found.groupBy("host", "path").agg(F.sum("fixed").alias("fixed"))
    own = paths.join(fixed, ["host", "path"], "left").select("host", "path", F.greatest(F.col("words") - F.col("links") - F.coalesce("fixed", F.lit(0)), F.lit(0)).alias("own"))
    steps = F.split("path", "/")
    up = own.select("host", "own", F.size(steps).alias("size"), F.posexplode(F.transform(F.sequence(F.lit(1), F.size(steps)), lambda k: F.array_join(F.slice(steps, 1, k), "/"))).alias("at", "path"))
    mass = up.groupBy("host", "path").agg(F.sum("own").alias("mass"), F.sum(F.when(F.col("at") == F.col("size") - 1, F.col("own")).otherwise(0)).alias("own"))
    whole = mass.filter("path = ''").select("host", F.col("mass").alias("whole"))
    region = mass.join(whole, "host").filter((F.col("whole") > 0) & (F.col("mass") >= REGION * F.col("whole")) & (2 * F.col("own") < F.col("mass")))
    region = region.groupBy("host").agg(F.max_by("path", F.length("path")).alias("region"))
    texts = found.groupBy("host", "name").agg(F.max("share").alias("share")).groupBy("host").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("name", "share")))).alias("texts"))
    menus = menus.groupBy("host").agg(F.sort_array(F.collect_set(key_of("path"))).alias("menus"))
    all_ = texts.join(menus, "host", "full").join(region, "host", "full")
    empty = F.create_map().cast("map<string,double>")
    return all_.select("host", F.to_json(F.struct(F.coalesce("texts", empty).alias("texts"), F.coalesce("menus", F.array().cast("array<string>")).alias("menus"), F.coalesce("region", F.lit("")).alias("region"))).alias("known"))


def extract(pages: DataFrame, url_col: str = "url", html_col: str = "html", id_col: str = "page_id", broadcast_bytes: int = 32 << 20, hints: bool = True) -> DataFrame:
    """Per row of pages: id, url, text, n_chars. Null pages and urls are empty; an empty host is a host; repeated rows stay.

    Wrappers and verdicts are broadcast if those of all hosts take no more than broadcast_bytes, else joined by a shuffle on the host.
    Without hints, hosts of several pages go by the wrapper alone. Trees may have any depth and width.
    """
    prepare(pages.sparkSession)
    source = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html"), host(F.col(url_col)).alias("host"))
    known = scratch(templates(source.select("host", "html"), broadcast_bytes), "templates")
    by_host = ByHost(source, known, "known", broadcast_bytes)
    rows = by_host.rows.select("id", "url", "host", "html", *(["known"] if by_host.shared is None else []))

    def run(batches):
        values = by_host.reader()
        for batch in batches:
            texts = [main_text(page, k, hints or k is None) for page, k in zip(batch.column("html").to_pylist(), values(batch))]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[id_col, "url", "text", "n_chars"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.mapInArrow(tidy(run), f"`{id_col}` {kinds['id']}, url {kinds['url']}, text string, n_chars bigint")
