"""Registered queries of the operators and their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_language_id")
def language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docatlas.llm import language_id

    return language_id.identify(table(spark, sf_dir, "documents"))


@query("op2_toxicity")
def toxic(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docatlas.llm import toxicity

    return toxicity.detect(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op7_exact_dedup", """
select d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id as kept, sha256(coalesce(d.text, '')) as text_sha256
from documents d join (select coalesce(text, '') as t, max(doc_id) as keep_id, count(*) as group_size from documents group by 1) g
  on coalesce(d.text, '') = g.t""")
def exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docatlas.llm import exact_dedup

    return exact_dedup.dedup_report(spark, f"{sf_dir}/documents.parquet")


@query("op4_pii")
def private(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docatlas.llm import pii

    return pii.scan(table(spark, sf_dir, "documents"))


@query("op3_bpe")
def bpe_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docatlas.llm import bpe

    return bpe.report(table(spark, sf_dir, "documents"))


@query("op6_decontamination")
def leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docatlas.llm import decontaminate

    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op9_suffix_tree_lm")
def language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docatlas.llm import suffix_lm

    return suffix_lm.score(table(spark, sf_dir, "documents"))


@query("op8_ngram_join")
def near(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docatlas.llm import ngram_join

    return ngram_join.report(table(spark, sf_dir, "documents"))


@query("op5_training_order")
def shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docatlas.llm import training_order

    return training_order.write_shards(table(spark, sf_dir, "documents"))


@query("op10_repeats")
def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docatlas.llm import repeats

    return repeats.remove_repeats(table(spark, sf_dir, "documents"))


@query("op11_periodic_runs")
def periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docatlas.llm import periodic_runs

    return periodic_runs.report(table(spark, sf_dir, "documents"))


@query("op13_conversation_repair")
def repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docatlas.llm import conversations

    return conversations.report(table(spark, sf_dir, "conversations"))


@query("op12_vector_dedup", """
with recursive pairs as (
  select a.vec_id as x, b.vec_id as y from embeddings a join embeddings b on a.label = b.label and a.vec_id <> b.vec_id
  where list_cosine_similarity(a.embedding::double[], b.embedding::double[]) >= 0.93),
reach(x, y) as (select vec_id, vec_id from embeddings union select r.x, p.y from reach r join pairs p on r.y = p.x),
low as (select x as vec_id, min(y) as component_id from reach group by 1),
n as (select x as vec_id, count(*) as n_links from pairs group by 1)
select l.vec_id, coalesce(n.n_links, 0) as n_links, l.component_id, l.vec_id = l.component_id as kept from low l left join n using (vec_id)""")
def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docatlas.llm import vector_dedup

    return vector_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))
