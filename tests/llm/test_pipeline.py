"""The pipeline against brute force, stage by stage."""
import corpus_pipeline
import pytest

import __spark_entry__ as entry
from tests.llm import brute

SF = "/root/testdata/sf0.001"


def test_registered():
    names = entry.queries()
    assert "pipeline" in names
    assert [next((q for q in names if q.startswith(f"op{n}_")), None) for n in range(1, 11)].count(None) == 0


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, items = docs.columns, [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = [(r.doc_id, r.text) for r in docs.collect()]
        out = stage(spark, docs, SF)
        out.write.parquet(f"{tmp_path}/{k}")
        out = spark.read.parquet(f"{tmp_path}/{k}")
        after = {r.doc_id for r in out.collect()}
        if name == "bpe":
            assert after == {i for i, _ in before}
            break
        assert out.columns == columns
        if name == "exact_dedup":
            assert after == {k for _, k, _, _ in brute.exact(before)}
        if name == "near_dedup":
            assert after == {i if not n else c for (i, _), (n, c) in zip(before, brute.near(before))}
        if name == "decontamination":
            leaked = {i for i, t in before if any(x in t for _, x in items)}
            assert not after & leaked
            gone = [r for r in before if r[0] not in after]
            assert {i for i, _ in gone} == {i for i, _ in brute.leaks(gone, items)} | leaked
        docs = out


@pytest.mark.parametrize("stage", range(5))
def test_odd_tables(spark, tmp_path, stage):
    _, f = corpus_pipeline.STAGES[stage]
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    odd = brute.frame(spark, brute.odd_rows())
    assert f(spark, odd, str(tmp_path)).count() > 0
    assert f(spark, odd.limit(0), str(tmp_path)).count() == 0
