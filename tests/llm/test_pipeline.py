"""The pipeline's stages on the smallest tables, each against the operator's brute-force properties."""

import hashlib
import re
from pathlib import Path

import public_tokenizers as P
import pytest
import tiktoken

import corpus_pipeline
from turnlake.llm import bpe
from turnlake.llm.common import scratch

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no tables")
TOXIC = re.compile(r"(?i)\b(idiot|moron|stupid|loser|pathetic|worthless|disgusting|scum|trash|clown)\b")


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash near-dedup", "substring dedup", "mixing", "byte-level bpe"]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = scratch(stage(spark, docs, SF), "test")
        rows = docs.collect()
        ids = [r.doc_id for r in rows]
        assert len(set(ids)) == len(ids) and set(ids) <= set(before) and rows
        if k < 4:
            assert docs.columns == columns
            after = {r.doc_id: r.text for r in rows}
        if k == 0:
            gone = [before[i] for i in before if i not in after]
            assert gone and all(len(TOXIC.findall(t)) >= 1 for t in gone)
            assert all(len(TOXIC.findall(t)) < 3 for t in after.values())
        if k == 1:
            texts = {hashlib.md5(" ".join(t.lower().split()).encode()).digest() for t in before.values()}
            assert len({hashlib.md5(" ".join(t.lower().split()).encode()).digest() for t in after.values()}) == len(after) <= len(texts)
        if k == 2:
            seen = {}
            for i, t in after.items():
                w = t.split()
                for j in range(len(w) - 49):
                    seen.setdefault(tuple(w[j : j + 50]), set()).add(i)
            assert all(len(x) == 1 for x in seen.values())
            assert all(r.n_chars == len(r.text) for r in rows)
        if k < 4:
            before = after
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(Path(P.path("byte_bpe_50k.tiktoken")).read_bytes()), special_tokens={})
    for r in rows:
        assert list(r.ids) == library.encode_ordinary(before[r.doc_id]) and r.n_tokens == len(r.ids)


def test_stages_odd_rows(spark):
    """Nulls anywhere, empty and repeated rows, a very long text, an extra column, and no rows at all."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, topic string, probability double, fp long, start int"
    rows = [(None, "some words of a text", "en", "a", None, None, None, 1, 2), (1, None, None, None, None, "t", 0.5, 1, 2), (2, "", "en", "a", 0, "t", 0.5, None, None), (3, "w " * 60_000, "en", "a", 1, "t", 0.5, 1, 2)]
    rows += [(4, "one text that stands here twice", "de", "b", 1, "t", 0.5, 1, 2)] * 2
    for docs in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        n = docs.count()
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = scratch(stage(spark, docs, SF), "odd")
            if k < 4:
                assert out.columns == docs.columns
                own = {(r.doc_id, r.topic, r.probability, r.fp, r.start) for r in docs.collect()}
                assert {(r.doc_id, r.topic, r.probability, r.fp, r.start) for r in out.collect()} <= own
            assert out.count() <= n and (out.count() > 0) == (n > 0)
            docs = out if k < 4 else docs


def test_tokens_are_decoded(spark):
    texts = ["Some words, and more.", " \n\ttabs ", "É日本語🙂\u0301", "", None, "a" * 5000]
    docs = spark.createDataFrame([(i, t, "en", "a") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r.decoded_md5 for r in corpus_pipeline.encode_tokens(spark, docs, SF).collect()}
    assert got == {i: hashlib.md5((t or "").encode()).hexdigest() for i, t in enumerate(texts)}


def test_registered():
    import __spark_entry__ as e
    from turnlake.llm import queries

    assert set(queries.QUERIES) <= set(e.queries()) and "pipeline" in e.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))
