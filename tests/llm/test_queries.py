import os

import brute
import pytest

import corpus_pipeline
from rubric.llm import queries, quality, toxicity
from rubric.plans import compare

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_matches_its_sql(spark, name):
    got = queries.QUERIES[name](spark, SMALL)
    rel = compare.duck(SMALL).sql(queries.ORACLE[name])
    order = sorted(got.columns)
    assert order == sorted(rel.columns)
    want = sorted((tuple(r[rel.columns.index(c)] for c in order) for r in rel.fetchall()), key=str)
    assert sorted((tuple(r[c] for c in order) for r in got.collect()), key=str) == want


def test_all_operators_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
    import __spark_entry__

    assert {*queries.QUERIES, "pipeline"} <= set(__spark_entry__.queries())


def test_op4_and_op3_on_whole_tables(spark):
    docs = [(r.doc_id, r.text) for r in queries.table(spark, SMALL, "documents").collect()]
    got = sorted(tuple(r) for r in queries.op4_jaccard_join(spark, SMALL).collect())
    assert got == sorted(w[:3] for w in brute.jaccard(docs, 4, 85))
    assert all(r.round_trip for r in queries.op3_sentencepiece(spark, SMALL).collect())


def test_pipeline_stage_by_stage(spark, tmp_path):
    docs = queries.table(spark, SMALL, "documents")
    labels = queries.table(spark, SMALL, "labels")
    columns, rows = docs.columns, docs.collect()
    for name, stage in corpus_pipeline.STAGES:
        before = {(r.doc_id, r.text) for r in rows}
        if name == "quality":
            model = quality.train(docs, labels, quality.graded(labels))
            want = {r.doc_id for r in quality.rate(docs, model).collect() if r.kept}
        elif name == "toxicity":
            model = toxicity.train(docs, labels)
            want = {r.doc_id for r in toxicity.score(docs, model).collect() if not r.predicted}
        elif name == "exact_dedup":
            want = {e[0] for e in brute.exact(sorted(before)) if e[3]}
        elif name == "jaccard_join":
            want = {w[0] for w in brute.jaccard(sorted(before), 5, 80) if w[0] == w[2]}
        out = stage(spark, docs, SMALL)
        if name == "packing":
            assert {r.doc_id for r in out.collect()} == {d for d, _ in before}
            break
        assert out.columns == columns
        out.write.parquet(os.path.join(tmp_path, name))
        docs = spark.read.parquet(os.path.join(tmp_path, name))
        rows = docs.collect()
        assert {(r.doc_id, r.text) for r in rows} == {b for b in before if b[0] in want} and len(rows) == len(want), name
    assert len(rows) > 100
    assert corpus_pipeline.run(spark, SMALL).select("doc_id").distinct().count() == len(rows)


def test_pipeline_stages_take_edge_rows_and_empty_tables(spark, edge, empty):
    for docs in (edge, empty):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SMALL)
            assert name == "packing" or out.columns == docs.columns
            out.collect()
