import importlib.util

import pytest

if importlib.util.find_spec("corpus_pipeline") is None:
    pytest.skip("the pipeline module is optional", allow_module_level=True)

import corpus_pipeline
import public_tokenizers as P

from quillspark.llm import bpe, queries


def test_stages(spark, clean_docs):
    docs = clean_docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, "")
        assert after.columns == docs.columns, name
        ids, before = [r.doc_id for r in after.collect()], {r.doc_id for r in docs.collect()}
        if name == "language ID":
            assert set(ids) == before - {3, 4, 5, 11}
        elif name == "SimHash near-dedup":
            assert sorted(ids) == sorted(before - {2})
        elif name == "PII surrogates":
            assert sorted(ids) == sorted(before)
            text = next(r.text for r in after.collect() if r.doc_id == 7)
            assert "mail1" not in text and "555-7713" not in text
        else:
            assert set(ids) == before
        docs = after
    tool = bpe.encoder(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in corpus_pipeline.STAGES[-1][1](spark, docs, "").collect():
        assert r.lossless and tool.decode(r.ids).decode() == texts[r.doc_id] and r.n_tokens == len(r.ids)


def test_every_operator_has_one_query():
    names = list(queries.queries())
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert set(queries.oracle_sql()) <= set(names)


def test_run_on_odd_tables(spark, docs, empty, tmp_path):
    """Null and repeated ids, nulls in any column, clashing column names; and a table without rows."""
    for name, table in (("odd", docs), ("empty", empty)):
        table.write.parquet(f"file://{tmp_path}/{name}/documents.parquet")
        rows = corpus_pipeline.run(spark, f"file://{tmp_path}/{name}").collect()
        assert all(r.lossless for r in rows) and bool(rows) == (name == "odd")
        # Documents 3, 4, 5 and 11 have no letter, 2 is a copy, 9 is there twice; the one without an id stays.
        assert {r.doc_id for r in rows} == (set() if name == "empty" else {None, 1, 6, 7, 8, 9, 10})
