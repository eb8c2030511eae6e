"""Mixing sources to target weights by iterative proportional fitting (raking), with DataFrame functions only.

Documents are summed into cells of (source, lang, topic). The cells' token weights are scaled to the targets of one dimension
after the other, sweep by sweep, until all marginals are met; a cell's probability is its fitted weight by its observed weight, scaled
so that the largest is 1. Documents are drawn by a hash of their id, so reruns and retries draw the same ones.
"""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnlake.llm.common import discard, join_small, scratch

#: Target shares of tokens: a table of shares, where values that it lacks keep their observed share, or a power of the observed share
#: (below 1 evens out). Documents are only left out, never repeated, so a share far above the observed one would leave few of all others:
#: shares of a table are taken as BOOST times the observed share at most. All are scaled to sum 1.
TARGETS = {
    "source": 0.9,
    "lang": {"en": 0.58, "de": 0.16, "fr": 0.16, "es": 0.10},
    "topic": {"prose": 0.60, "long": 0.29, "table": 0.03, "legal": 0.03, "contact": 0.02, "shouting": 0.02, "note": 0.007},
}
BOOST = 1.15
#: Sweeps at most, and the largest relative error of a marginal at which they end; places of a probability.
SWEEPS, ERROR, PLACES = 30, 1e-6, 6
NONE = "(none)"
_log = logging.getLogger(__name__)


def token_weight(text: Column) -> Column:
    """Tokens of a text by its bytes: a quarter, rounded up; a count of real tokens may be given instead."""
    return F.coalesce(F.floor((F.octet_length(text) + 3) / 4), F.lit(0)).cast("long")


#: The topic where no column has one: the first form of text that fits, as a condition of DuckDB and Spark alike.
FORMS = [("table", "contains(text, ' | ')"), ("contact", "contains(text, '@')"), ("legal", "contains(lower(text), 'license') OR contains(lower(text), 'copyright')"), ("shouting", "contains(text, '!!')"), ("note", "length(text) < 500"), ("long", "length(text) >= 8000")]


def form(text: Column) -> Column:
    """The name of the first of FORMS that fits a text, else "prose"; null texts are prose."""
    low = F.lower(text)
    fits = [F.contains(text, F.lit(" | ")), F.contains(text, F.lit("@")), F.contains(low, F.lit("license")) | F.contains(low, F.lit("copyright")), F.contains(text, F.lit("!!")), F.length(text) < 500, F.length(text) >= 8000]
    out = F.when(fits[0], FORMS[0][0])
    for (name, _), fit_ in zip(FORMS[1:], fits[1:]):
        out = out.when(fit_, name)
    return out.otherwise("prose")


def target(cells: DataFrame, dim: str, goal, boost: float = BOOST) -> DataFrame:
    """(dim, to): shares that sum to 1 over the values with observed weight; goal is a power, a dict or a DataFrame (dim, target)."""
    seen = cells.groupBy(dim).agg(F.sum("observed").cast("double").alias("seen"))
    if isinstance(goal, DataFrame):
        to = seen.join(goal.select(dim, F.col("target").cast("double").alias("to")), dim, "left")
    elif isinstance(goal, dict):
        table = F.create_map(*[F.lit(x) for pair in goal.items() for x in (pair[0], float(pair[1]))])
        whole = float(seen.agg(F.sum("seen")).first()[0] or 1)
        share = F.col("seen") / F.lit(whole)
        to = seen.withColumn("to", F.when(table[F.col(dim)].isNotNull(), F.least(table[F.col(dim)], share * F.lit(boost))).otherwise(share))
    else:
        to = seen.withColumn("to", F.pow("seen", F.lit(float(goal))))
    to = scratch(to.select(dim, F.when(F.col("seen") > 0, F.coalesce("to", F.lit(0.0))).otherwise(0.0).alias("to")), "mix-target")
    total = to.agg(F.sum("to")).first()[0] or 1.0
    return to.select(dim, (F.col("to") / F.lit(total)).alias(f"to_{dim}"))


def fit(cells: DataFrame, dims: list[str], targets: dict, sweeps: int = SWEEPS, error: float = ERROR, boost: float = BOOST) -> DataFrame:
    """cells (dims, observed) with `weight`, raked to the targets until no marginal is off by more than a share of error, or for sweeps.

    A value that a target DataFrame lacks has target 0; a value without observed weight stays without. Targets need no common sum:
    only proportions count. Values of dims are unique and not null. Sums of a dimension are aggregated and joined back, so a value
    with most of the cells spreads over tasks; every sweep is a written table, so the plan doesn't grow. Where cells are too sparse for
    all targets at once, the error left is logged.
    """
    out = cells.withColumn("weight", F.col("observed").cast("double"))
    for d in dims:
        out = out.join(target(cells, d, targets.get(d, 1.0), boost), d)
    out = scratch(out, "mix-sweep")
    columns, off = out.columns, 0.0
    for _ in range(sweeps):
        last = out
        for d in dims:
            total = out.groupBy(d).agg(F.sum("weight").alias("_total"))
            out = out.join(total, d).withColumn("weight", F.when(F.col("_total") > 0, F.col("weight") * F.col(f"to_{d}") / F.col("_total")).otherwise(0.0)).select(*columns)
        out = scratch(out, "mix-sweep")
        discard(last)
        sums = [out.groupBy(d).agg(F.sum("weight").alias("has"), F.max(f"to_{d}").alias("to")).filter("to > 0").agg(F.max(F.abs(F.col("has") / F.col("to") - 1)).alias("off")) for d in dims]
        whole = sums[0]
        for x in sums[1:]:
            whole = whole.union(x)
        off = whole.agg(F.max("off")).first()[0] or 0.0
        if off <= error:
            break
    else:
        _log.warning("raking left a marginal off by %.3g after %d sweeps", off, sweeps)
    return out.drop(*[f"to_{d}" for d in dims])


def mix(docs: DataFrame, targets: dict | None = None, tokens: Column | None = None, topic: Column | None = None, sweeps: int = SWEEPS, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with topic, n_tokens, probability (rounded to 6 places) and kept; columns of these names are replaced.

    topic is the column given, else the form of the text: a column of that name is no topic unless it is given. Null sources, languages
    and topics are a value of their own, "(none)"; a null text has no tokens. A cell without tokens keeps its documents. Repeated ids are
    drawn alike; a null id is drawn as an empty one. An empty table gives none.
    """
    targets = TARGETS if targets is None else targets
    dims = ["source", "lang", "topic"]
    text = F.col(text_col).cast("string")
    docs = docs.withColumns({"n_tokens": token_weight(text) if tokens is None else tokens, "topic": F.coalesce(form(text) if topic is None else topic, F.lit(NONE))})
    keyed = docs.withColumns({f"_mix_{d}": F.coalesce(F.col(d).cast("string"), F.lit(NONE)) for d in dims})
    cells = scratch(keyed.groupBy(*[F.col(f"_mix_{d}").alias(d) for d in dims]).agg(F.sum("n_tokens").alias("observed")), "mix-cells")
    fitted = scratch(fit(cells, dims, targets, sweeps).withColumn("ratio", F.when(F.col("observed") > 0, F.col("weight") / F.col("observed"))), "mix-fitted")
    top = fitted.agg(F.max("ratio")).first()[0] or 1.0
    chance = fitted.select(*[F.col(d).alias(f"_mix_{d}") for d in dims], F.round(F.coalesce(F.col("ratio") / F.lit(top), F.lit(1.0)), PLACES).alias("probability"))
    drawn = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))
    joined = join_small(keyed.drop("probability", "kept"), chance, [f"_mix_{d}" for d in dims], "inner", 120)
    return joined.withColumn("kept", drawn < F.col("probability")).drop(*[f"_mix_{d}" for d in dims])


def mix_sql(targets: dict | None = None, sweeps: int = SWEEPS, seed: int = 42) -> str:
    """DuckDB SQL for mix() over documents."""
    targets = TARGETS if targets is None else targets
    dims = ["source", "lang", "topic"]
    forms = " ".join(f"WHEN {fits} THEN '{name}'" for name, fits in FORMS)
    ctes = [
        f"d AS (SELECT doc_id, coalesce(source, '{NONE}') AS source, coalesce(lang, '{NONE}') AS lang, CASE {forms} ELSE 'prose' END AS topic, coalesce((strlen(text) + 3) // 4, 0) AS n_tokens FROM documents)",
        "c AS (SELECT source, lang, topic, sum(n_tokens)::BIGINT AS observed FROM d GROUP BY ALL)",
    ]
    for x in dims:
        goal = targets.get(x, 1.0)
        share = f"coalesce(least(CASE {x} " + " ".join(f"WHEN '{k}' THEN {float(v)}::DOUBLE" for k, v in goal.items()) + f" ELSE 1e9::DOUBLE END, seen / sum(seen) OVER () * CASE WHEN {x} IN ({', '.join(repr(k) for k in goal)}) THEN {BOOST}::DOUBLE ELSE 1 END), 0)" if isinstance(goal, dict) else f"pow(seen, {float(goal)}::DOUBLE)"
        ctes.append(f"g_{x} AS (SELECT {x}, CASE WHEN seen > 0 THEN {share} ELSE 0 END AS goal FROM (SELECT {x}, sum(observed)::DOUBLE AS seen FROM c GROUP BY {x}))")
        ctes.append(f"t_{x} AS (SELECT {x}, goal / sum(goal) OVER () AS to_{x} FROM g_{x})")
    ctes.append("s0 AS (SELECT *, observed::DOUBLE AS weight FROM c JOIN t_source USING (source) JOIN t_lang USING (lang) JOIN t_topic USING (topic))")
    n, ends = 0, []
    for k in range(1, sweeps + 1):
        for x in dims:
            n += 1
            ctes.append(f"s{n} AS MATERIALIZED (SELECT * EXCLUDE (weight), CASE WHEN sum(weight) OVER (PARTITION BY {x}) > 0 THEN weight * to_{x} / sum(weight) OVER (PARTITION BY {x}) ELSE 0 END AS weight FROM s{n - 1})")
        off = " UNION ALL ".join(f"SELECT max(abs(has / goal - 1)) AS off FROM (SELECT sum(weight) AS has, max(to_{x}) AS goal FROM s{n} GROUP BY {x}) WHERE goal > 0" for x in dims)
        ends.append(f"SELECT {k} AS k, coalesce(max(off), 0) AS off FROM ({off})")
    # Of all sweeps the first that meets the marginals counts, else the last.
    ctes.append(f"e AS ({' UNION ALL '.join(ends)})")
    ctes.append(f"last AS (SELECT coalesce(min(k) FILTER (off <= {ERROR}), {sweeps}) AS k FROM e)")
    every = " UNION ALL ".join(f"SELECT {k} AS k, source, lang, topic, observed, weight FROM s{k * len(dims)}" for k in range(1, sweeps + 1))
    ctes.append(f"r AS (SELECT source, lang, topic, CASE WHEN observed > 0 THEN weight / observed END AS ratio FROM ({every}) JOIN last USING (k))")
    ctes.append(f"p AS (SELECT source, lang, topic, round(coalesce(ratio / (SELECT max(ratio) FROM r), 1.0), {PLACES}) AS probability FROM r)")
    return f"WITH {', '.join(ctes)} SELECT doc_id, source, lang, topic, n_tokens::BIGINT AS n_tokens, probability, ('0x' || substr(md5('{seed}:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 < probability AS kept FROM d JOIN p USING (source, lang, topic)"
