"""Maps and catalogs written from a table in the readers' formats and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from docatlas.plans.registry import query
from docatlas.plans.views import spark_view as view
from docatlas.plans.views import with_views
from docatlas.sources import tables as S
from docatlas.streaming.jobs import shared_folder


@query("s2_header_map", with_views("function_map_v") + "select header, function from function_map_v")
def s2(spark, sf):
    path = shared_folder(spark, "s2")
    d = view(spark, sf, "function_map_v").groupBy("header").agg(F.sort_array(F.collect_list("function")).alias("functions"))
    d.withColumn("ord", F.xxhash64("header")).write.json(f"{path}/headers.jsonl")
    return S.read_header_map(spark, f"{path}/headers.jsonl").select("header", "function")


@query("s3_function_map", with_views("function_map_v") + "select function, header from function_map_v")
def s3(spark, sf):
    path = shared_folder(spark, "s3")
    view(spark, sf, "function_map_v").write.json(f"{path}/functions.jsonl")
    return S.read_function_map(spark, f"{path}/functions.jsonl")


@query("s4_catalog", with_views("catalog_v") + "select name, type, header, url, language, coalesce(description, '') as description from catalog_v")
def s4(spark, sf):
    path = shared_folder(spark, "s4")
    d = view(spark, sf, "catalog_v").select(*[F.col(n).alias(c) for c, n in S.CATALOG_CSV.items()])
    d.write.option("header", True).option("escape", '"').csv(f"{path}/catalog.csv")
    return S.read_catalog(spark, f"{path}/catalog").drop("ord")
