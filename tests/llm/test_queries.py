"""The registered queries over whole small tables, their SQL, and the pipeline by a brute-force version."""

import pytest
from compare import assert_same, database
from pyspark.sql import functions as F

import corpus_pipeline
from vectide import llm
from vectide.llm import bpe, decontaminate, ngram_join, quality_classifier, quality_rules
from vectide.llm._storage import table


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_oracle(spark, small, name):
    assert_same(llm.queries()[name](spark, small), database(small), llm.oracle_sql()[name])


def test_all_are_registered(spark, small):
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert {f"op{n}" for n in range(1, 11)} == {x.split("_")[0] for x in llm.queries()} and set(llm.queries()) | {"pipeline"} <= names


@pytest.mark.parametrize("name", sorted(llm.queries().keys() - llm.oracle_sql().keys()))
def test_runs_over_the_whole_table(spark, small, name):
    out = llm.queries()[name](spark, small)
    n = out.count()
    assert n > 0
    if "doc_id" in out.columns and "item_id" not in out.columns:
        assert n == table(spark, small, "documents").count()


def test_pipeline_stage_by_stage(spark, small):
    """What each stage keeps follows from its operator's own results on the stage's input."""
    docs, labels = table(spark, small, "documents"), table(spark, small, "labels")
    rules = quality_rules.judge(docs, quality_rules.fit(docs, labels))
    docs = docs.join(rules.where("keep").select("doc_id"), "doc_id", "left_semi")
    good = quality_classifier.classify(docs, quality_classifier.fit(table(spark, small, "documents"), labels))
    docs = docs.join(good.where("keep").select("doc_id"), "doc_id", "left_semi")
    pairs = [(r.doc_id_a, r.doc_id_b) for r in ngram_join.jaccard_join(docs).collect()]
    root = {}

    def find(x):
        while root.get(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    dropped = {x for p in pairs for x in p if find(x) != x}
    ids = {r.doc_id for r in docs.select("doc_id").collect()} - dropped
    leaks = {r.doc_id for r in decontaminate.find(docs, table(spark, small, "benchmark")).collect()}
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, small).collect()}
    assert set(got) == ids - leaks
    texts = {r.doc_id: r.text for r in docs.where(F.col("doc_id").isin(*list(got)[:20])).collect()}
    m = bpe.merges(bpe.VOCABULARY)
    for i, t in texts.items():
        assert [x.tolist() for _, x, _ in bpe.encode_slice(m, [t])][0] == got[i].tokens


def test_stages_keep_odd_columns(spark, small):
    """Null ids, extra columns with names the operators use, and empty input pass through every stage."""
    docs = table(spark, small, "documents").withColumns({"keep": F.lit("k"), "score": F.lit(1), "tokens_": F.lit(2), "id": F.lit(3)})
    docs = docs.withColumn("doc_id", F.when(F.col("doc_id") % 7 != 3, F.col("doc_id"))).unionByName(docs.limit(3))
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, small)
        assert stage(spark, docs.where("false"), small).count() == 0
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns and 0 < out.count() <= docs.count()
        else:
            assert out.count() == docs.count()
