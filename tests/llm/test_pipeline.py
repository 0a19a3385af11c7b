"""The stages, each on all that the one before it kept."""

import collections

import corpus_pipeline
from tests.llm import data

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars", "token", "chunk"]


def test_stages(spark, tmp_path):
    docs = data.frame(spark)
    kept = []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if i == len(corpus_pipeline.STAGES) - 1:
            assert out.count() > 0
            break
        assert out.columns == COLUMNS, name
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept.append(docs.collect())
    first = {r.doc_id for r in kept[0]}
    source = {r[0]: r[1] for r in data.rows()}
    assert all(d in first for d, t in source.items() if t and len(t.split()) > 20 and t != "word " * 400)
    assert not any(t is None or not t.strip() for d, t in source.items() if d in first)
    texts = collections.Counter(r.text for r in kept[1] if r.doc_id is not None and r.doc_id != 7)
    assert max(texts.values()) == 1
    assert {r.doc_id for r in kept[2]} == {r.doc_id for r in kept[1]}
    assert not any("abcdefghijklmnop1234" in (r.text or "") for r in kept[2])
    assert {r.doc_id for r in kept[3]} <= {r.doc_id for r in kept[2]}


def test_empty(spark, tmp_path):
    data.frame(spark, []).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
