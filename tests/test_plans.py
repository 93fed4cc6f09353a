"""Shape of the physical plans that matter at scale."""
from pyspark.sql import functions as F

from docatlas.operators import candidates as C
from docatlas.operators import evidence as E
from docatlas.operators import lookups as L
from docatlas.operators import pages as P
from docatlas.operators import resolve as X
from docatlas.operators import symbols as S
from docatlas.plans.views import spark_view

SF = "/root/testdata/sf0.001"
PYTHON_STATE = {"t4_health_transitions"}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def count(text, word):
    return sum(1 for line in text.split("\n") if line.lstrip(" :+-*()0123456789").startswith(word))


def test_page_facts_use_one_exchange(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    p = plan(P.page_facts(pages, "name", "remarks", "parameters", "description"))
    assert count(p, "Exchange") == 1 and "Join" not in p


def test_page_scan_reads_two_columns(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    p = plan(P.page_facts(pages, "remarks"))
    assert "ReadSchema: struct<page_id:bigint,html:string>" in p


def test_candidates_need_no_shuffle(spark):
    symbols = S.detect_dll(spark.read.parquet(f"{SF}/part.parquet").select(F.col("p_name").alias("symbol")))
    p = plan(C.url_candidates(symbols))
    assert "Exchange" not in p and "Join" not in p


def test_search_hit_is_one_aggregate(spark):
    results = spark.createDataFrame([("a", 1, "u", "t")], "symbol string, rank long, url string, title string")
    p = plan(L.pick_search_hit(results))
    assert count(p, "Exchange") == 1 and "Join" not in p and "Window" not in p


def check_shape(name, df):
    """No Python functions and no nested loops outside the health fold and streams.
    Called for every registered query by test_oracles."""
    if name in PYTHON_STATE or "_stream_" in name:
        return
    p = plan(df)
    assert "Python" not in p and "InPandas" not in p, name
    if name != "g3_map_statistics":  # two one-row aggregates side by side
        assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p, name


def test_first_valid_is_one_aggregate(spark):
    log = spark_view(spark, SF, "search_results_v").withColumn("valid", F.lit(True))
    p = plan(C.first_valid(log))
    assert "min_by" in p and count(p, "Window") == 0


def test_resolution_is_one_attempt_table(spark, tmp_path):
    """Six tables are read once each; one join of lookups, one with the crawl."""
    views = {"names": spark_view(spark, SF, "names_v").select("symbol"), "results": spark_view(spark, SF, "search_results_v"),
             "map": E.expand_map(spark_view(spark, SF, "header_map_v")), "functions": spark_view(spark, SF, "function_map_v"),
             "catalog": spark_view(spark, SF, "catalog_v"), "crawl": spark_view(spark, SF, "crawl_v")}
    for name, df in views.items():
        df.write.parquet(str(tmp_path / name))
    names, results, key_map, functions, catalog, crawl = (spark.read.parquet(str(tmp_path / name)) for name in views)
    p = plan(X.resolve(names, results, key_map, functions, catalog, crawl))
    assert count(p, "FileScan") <= 8 and sum("Exchange hashpartitioning" in line for line in p.split("\n")) <= 10
    assert sum("Join" in line for line in p.split("\n")) <= 2
    p = plan(X.coverage(names, X.resolve(names, results, key_map, functions, catalog, crawl)))
    assert count(p, "FileScan") <= 8
