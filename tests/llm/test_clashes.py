"""Columns that have the names of an operator's own: kept, with their values, by every stage and operator."""
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from docatlas.llm import bpe, conversations, decontaminate, exact_dedup, language_id, ngram_join, periodic_runs, pii, repeats, suffix_lm, toxicity, training_order, vector_dedup
from tests.llm import brute

SF = "/root/testdata/sf0.001"
RESERVED = ("_file _row _place _digest _near _word _bit _bits _metadata _user chunk chunk_ row row_ lang_pred score lang_pred_ score_ text_to_judge held_out bucket "
            "root set_id class block payload lo hi keep n h g key item item_id q shift i tokens vertex a b").split()


@pytest.fixture(scope="module")
def clashing(spark, tmp_path_factory):
    """Documents with every reserved name as a further column, one file scan and one plain table."""
    docs = spark.createDataFrame([(i, t, lang, "s", 1) for i, t, lang, *_ in brute.odd_rows()], "doc_id long, text string, lang string, source string, n_chars long")
    for k, name in enumerate(RESERVED):
        docs = docs.withColumn(name, F.concat(F.lit(f"{k}-"), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))))
    path = str(tmp_path_factory.mktemp("clash") / "documents.parquet")
    docs.repartition(2).write.parquet(path)
    return path


@pytest.mark.parametrize("stage", range(4))
@pytest.mark.parametrize("scan", [True, False])
def test_stages_keep_columns(spark, clashing, tmp_path, stage, scan):
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(clashing)
    docs = docs if scan else spark.createDataFrame(docs.collect(), docs.schema)
    name, f = corpus_pipeline.STAGES[stage]
    out = f(spark, docs, str(tmp_path))
    assert out.columns == docs.columns
    plain = f(spark, docs.select("doc_id", "text", "lang", "source", "n_chars"), str(tmp_path))
    got = sorted(map(tuple, out.collect()), key=str)
    every = list(map(tuple, docs.collect()))
    assert got and all(r in every for r in got)
    assert sorted([r[:2] for r in got], key=str) == sorted([tuple(r)[:2] for r in plain.collect()], key=str)


def test_operators_ignore_columns(spark, clashing):
    docs = spark.read.parquet(clashing)
    plain = docs.select("doc_id", "text", "lang")
    marks = spark.createDataFrame([(1, 1), (3, 0)], "doc_id long, toxic int")
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    for f in (language_id.identify, bpe.report, pii.scan, ngram_join.report, suffix_lm.score, repeats.remove_repeats, periodic_runs.report, periodic_runs.runs,
              lambda d: toxicity.detect(d, marks), lambda d: decontaminate.contaminated(d, items)):
        a, b = (sorted(map(str, f(d).collect())) for d in (docs, plain))
        assert a == b
    assert training_order.write_shards(docs).count() == training_order.write_shards(plain).count()
    a, b = (sorted(map(str, exact_dedup.dedup_report(spark, path).collect())) for path in (clashing, clashing + "/"))
    assert a == b


def test_other_tables_ignore_columns(spark):
    talks = spark.read.parquet(f"{SF}/conversations.parquet").limit(30)
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet").limit(60)
    for f, d in ((conversations.report, talks), (conversations.repaired, talks), (vector_dedup.near_duplicates, vectors)):
        rows = spark.createDataFrame(d.collect(), d.schema)
        odd = rows.withColumns({c: F.lit("x") for c in [*RESERVED, "gone", "nth", "mark", "audit", "cost", "cid", "part", "place", "weight", "vec"]})
        assert sorted(map(str, f(rows).collect())) == sorted(map(str, f(odd).collect()))
