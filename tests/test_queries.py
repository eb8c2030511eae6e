"""Registered queries of the library against their SQL on the smallest tables."""

import sys
from pathlib import Path

import duckdb
import pytest

from turnlake import catalog

SF = "/root/testdata/sf0.001"
TABLES = "documents events conversations".split()
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no tables")


def plain(x):
    return round(float(x), 6) if isinstance(x, float) else list(x) if isinstance(x, (list, tuple)) else x


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query(spark, name):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = catalog.QUERIES[name](spark, SF)
    want = c.sql(catalog.SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    a = sorted(str([plain(r[x]) for x in columns]) for r in got.collect())
    b = sorted(str([plain(x) for x in r]) for r in c.sql(f"SELECT {', '.join(f'\"{x}\"' for x in columns)} FROM ({catalog.SQL[name]})").fetchall())
    assert a == b


def test_stream_topics(spark):
    """Turn by turn, in plain Python."""
    from turnlake.streaming.ingest import assign
    from turnlake.functions import text as T
    from turnlake.operators import turns as Q
    from turnlake.sources import messages as M
    from pyspark.sql import functions as F

    assert set(catalog.QUERIES) == set(catalog.SQL)
    rows = Q.turns(M.conv10(spark, SF)).select("session_id", "seq", T.terms(T.turn_text(F.col("user_preview"), F.col("assistant_preview"), F.col("tools_used"))).alias("terms"))
    want, state = {}, {}
    for r in sorted(rows.collect(), key=lambda r: (r.session_id, r.seq)):
        vectors, topic = state.get(r.session_id, ([], 0))
        new = {t: r.terms.count(t) / len(r.terms) for t in r.terms}
        topic = assign(vectors, topic, new, 0.05)
        state[r.session_id] = ([*vectors, new][-3:], topic)
        want[r.session_id, r.seq] = topic
    assert {(r.session_id, r.seq): r.topic_ord for r in catalog.QUERIES["stream_topics"](spark, SF).collect()} == want


def test_imports_without_optional_parts(monkeypatch):
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    for name in [m for m in sys.modules if m.startswith(("turnlake.llm", "corpus_pipeline"))]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "turnlake.llm", None)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    import __spark_entry__ as e

    assert set(e.queries()) == set(catalog.QUERIES)
    assert set(e.oracle_sql()) <= set(catalog.SQL)
