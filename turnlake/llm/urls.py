"""URL filters: explicit rules, and for urls that no rule fits, a tree of path templates for each host.

Digits in segments are one token. From the root down, a node with SPLIT urls or more keeps those child segments literally that hold
SUPPORT of its urls, so it has 1 / SUPPORT literal children at most; all others become one wildcard. Siblings are merged if they are
statistically similar: the shapes of what comes next differ little from the node's as a whole, and their shares of blocked labels don't
differ by a two-proportion test; a similar sibling without labels joins the others where these are one group. Urls that a rule fits are
the labels. A template's purity is its share of blocked labels, smoothed towards its parent's, the root's towards its registrable
domain's (the host's last two names), that towards the corpus's. A template is rejected if its purity reaches PURITY and host or domain
have at least EVIDENCE labels. Trees are made level by level with aggregations over distinct (host, path form) pairs, all hosts at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnlake.llm.common import discard, join_small, scratch

#: (host and path, verdict); a rule fits its host and subdomains if the path starts with the rule's; the longest wins.
RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]
SPLIT, SUPPORT, ALPHA, PURITY, Z, EVIDENCE = 8, 0.02, 2.0, 0.8, 2.0, 3
#: Siblings are similar in what comes next up to this total variation distance, and 1 / sqrt(urls) for chance.
UNLIKE = 0.3


def host(url: Column) -> Column:
    """After the first "://" up to "/", "?", "#" or the end, A-Z in lower case; empty without."""
    found = F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    """From the end of the host up to "?", "#" or the end; empty without a host's mark."""
    return F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def by_rule(rules, host: Column, path: Column) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, nulls without."""
    rule = verdict = None
    for text, says in sorted(rules, key=lambda r: -len(r[0])):
        name, _, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)
        rule = F.when(fits, text) if rule is None else rule.when(fits, text)
        verdict = F.when(fits, says) if verdict is None else verdict.when(fits, says)
    return (F.lit(None).cast("string"),) * 2 if rule is None else (rule, verdict)


def form(path: Column) -> Column:
    """A path without its first slash, digits as "0"."""
    return F.regexp_replace(F.regexp_replace(path, "^/", ""), r"[0-9]+", "0")


def smoothed(blocked, labelled, prior) -> Column:
    return (F.col(blocked) + ALPHA * prior) / (F.col(labelled) + ALPHA)


def roots(counts: DataFrame) -> DataFrame:
    """counts (host, form, n, blocked, labelled) with template (the root's), its purity, and whether host and domain have the evidence."""
    hosts = counts.groupBy("host").agg(F.sum("blocked").alias("b"), F.sum("labelled").alias("l")).withColumn("domain", F.regexp_extract("host", r"([^.]*\.)?[^.]*$", 0))
    domains = hosts.groupBy("domain").agg(F.sum("b").alias("b_domain"), F.sum("l").alias("l_domain"))
    blocked, labelled = counts.agg(F.sum("blocked"), F.sum("labelled")).first()
    prior = ((blocked or 0) + 1) / ((labelled or 0) + 2)
    hosts = hosts.join(domains.withColumn("prior", smoothed("b_domain", "l_domain", F.lit(prior))), "domain")
    hosts = hosts.select("host", smoothed("b", "l", F.col("prior")).alias("purity"), (F.col("l_domain") >= EVIDENCE).alias("evidence"))
    return counts.join(hosts, "host").withColumn("template", F.lit(""))


def split(now: DataFrame, depth: int) -> DataFrame:
    """(host, template, seg, name, grown): the child of each node of now that a segment leads to, and the child's purity.

    now has host, template, purity, seg, next (the shape of the segment after), n, blocked, labelled.
    """
    node = ["host", "template"]
    child = now.groupBy(*node, "seg").agg(*[F.sum(c).alias(c) for c in ("n", "blocked", "labelled")], F.max("purity").alias("purity"))
    whole = now.groupBy(*node).agg(F.sum("n").alias("all"))
    child = scratch(child.join(whole, node).withColumn("kept", F.when(F.col("n") >= SUPPORT * F.col("all"), F.col("seg")).otherwise("*")), f"urls-{depth}")
    kept = child.groupBy(*node, "kept").agg(F.sum("n").alias("n"), F.sum("blocked").alias("b"), F.sum("labelled").alias("l"), F.max("all").alias("all"), F.max("purity").alias("purity"))
    shapes = now.join(child.select(*node, "seg", "kept"), [*node, "seg"]).groupBy(*node, "kept", "next").agg(F.sum("n").alias("m"))
    pool = shapes.groupBy(*node, "next").agg(F.sum("m").alias("m_all"))
    shared = shapes.join(pool, [*node, "next"]).join(kept.select(*node, "kept", "n", "all"), [*node, "kept"])
    shared = shared.groupBy(*node, "kept").agg(F.sum(F.least(F.col("m") / F.col("n"), F.col("m_all") / F.col("all"))).alias("shared"))
    kept = kept.join(shared, [*node, "kept"]).withColumn("like", 1 - F.col("shared") <= UNLIKE + 1 / F.sqrt("n"))
    # Similar siblings by their share of blocked labels: a group ends where the next differs.
    kept = kept.withColumns({"told": F.col("like") & (F.col("l") > 0), "rate": smoothed("b", "l", F.col("purity"))})
    row = Window.partitionBy(*node, "told").orderBy("rate", "kept")
    b, l = F.lag("b").over(row), F.lag("l").over(row)  # noqa: E741
    both = (F.col("b") + b + ALPHA * F.col("purity")) / (F.col("l") + l + ALPHA)
    error = F.sqrt(both * (1 - both) * (1 / (F.col("l") + 1) + 1 / (l + 1)))
    apart = F.coalesce(F.abs(F.col("rate") - F.lag("rate").over(row)) > Z * error, F.lit(True)) | ~F.col("told")
    kept = kept.withColumn("group", F.sum(apart.cast("int")).over(row))
    groups = F.max(F.when(F.col("told"), F.col("group"))).over(Window.partitionBy(*node))
    # Similar ones without labels: with the labelled where these are one group, else with each other; all others alone.
    group = F.when(F.col("told"), F.col("group")).when(F.col("like"), F.when(groups == 1, F.lit(1)).otherwise(F.lit(0))).otherwise(-F.col("group"))
    kept = kept.withColumn("of", group)
    names = Window.partitionBy(*node, "of")
    grown = (F.sum("b").over(names) + ALPHA * F.col("purity")) / (F.sum("l").over(names) + ALPHA)
    kept = kept.withColumns({"name": F.array_join(F.sort_array(F.collect_set("kept").over(names)), "|"), "grown": grown})
    return child.select(*node, "seg", "kept").join(kept.select(*node, "kept", "name", "grown"), [*node, "kept"]).drop("kept")


def templates(counts: DataFrame) -> DataFrame:
    """(host, form, template, purity, evidence) for counts (host, form, n, blocked, labelled); as deep as nodes have SPLIT urls."""
    state, d = scratch(roots(counts).withColumn("done", F.lit(False)), "urls"), 0
    columns = ["host", "form", "n", "blocked", "labelled", "purity", "evidence", "template", "done"]
    while True:
        size = state.filter("not done").groupBy("host", "template").agg(F.sum("n").alias("size"))
        now = state.join(size, ["host", "template"], "left").withColumns({"seg": F.get("form", F.lit(d)), "next": F.regexp_replace(F.coalesce(F.get("form", F.lit(d + 1)), F.lit("")), r"\p{L}+", "a")})
        now = scratch(now.withColumn("done", F.col("done") | F.col("seg").isNull() | (F.col("size") < SPLIT)), "urls-now")
        discard(state)
        deeper = now.filter("not done")
        if deeper.isEmpty():
            state = now.select(*columns)
            break
        step = scratch(split(deeper, d), "urls-step")
        deeper = deeper.join(step, ["host", "template", "seg"]).withColumns({"template": F.concat("template", F.lit("/"), "name"), "purity": F.col("grown")})
        state = scratch(deeper.select(*columns).union(now.filter("done").select(*columns)), "urls")
        discard(now)
        discard(step)
        d += 1
    ends = F.when(F.size("form") > F.size(F.split("template", "/")) - 1, F.concat("template", F.lit("/**"))).otherwise(F.col("template"))
    return state.select("host", "form", ends.alias("template"), "purity", "evidence")


def judge(pages: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url", purity: float = PURITY) -> DataFrame:
    """Per row of pages: id, host, path, rule, verdict, template and purity (of the host's tree).

    Null urls and urls without "://" have an empty host and path and are judged like others. Of rules of one length the first that fits
    wins. Urls may have any length. Repeated rows count as often; an empty table gives none.
    """
    found = pages.select(F.col(id_col).alias("id"), host(F.col(url_col)).alias("host"), path(F.col(url_col)).alias("path"))
    rule, says = by_rule(rules, F.col("host"), F.col("path"))
    found = found.withColumns({"rule": rule, "says": says, "key": form(F.col("path"))})
    counts = found.groupBy("host", "key").agg(F.count("*").alias("n"), F.count_if(F.col("says") == "block").alias("blocked"), F.count("says").alias("labelled"))
    counts = scratch(counts.withColumn("form", F.split("key", "/")).drop("key"), "urls-counts")
    made = scratch(templates(counts).withColumn("key", F.array_join("form", "/")).drop("form"), "urls-made")
    discard(counts)
    out = join_small(found, made, ["host", "key"], "inner", 300)
    verdict = F.coalesce("says", F.when(F.col("evidence") & (F.col("purity") >= purity), "block").otherwise("allow"))
    return out.select(F.col("id").alias(id_col), "host", "path", "rule", verdict.alias("verdict"), "template", F.round("purity", 9).alias("purity"))
