"""Candidate headers and page urls of a symbol.

A symbol's candidates are computed inside its own row (constant rule arrays,
``array_distinct`` keeps first occurrences), so tiers, dedupe, caps and ranks
need no shuffle; only the distinct-name step before it does."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docatlas import dims
from docatlas.functions import names as N
from docatlas.operators.rule_joins import pattern_headers

BASE_US = dims.SITE + "/en-us"
BASE_BR = dims.SITE + "/pt-br"


def base_url(lang: str) -> str:
    return BASE_BR if lang == "br" else BASE_US


def match_url_rules(symbols: DataFrame, url_rules: DataFrame | None = None) -> DataFrame:
    """(symbol, ord, header_ord, header) in rule order.  The built-in patterns are tested inside the row; a
    table ``url_rules`` (ord, pattern, headers) of any length is joined by literal parts of its patterns."""
    if url_rules is not None:
        return pattern_headers(symbols, url_rules)
    return (symbols.withColumn("r", F.explode(N.rule_headers("symbol")))
            .select("symbol", F.col("r.ord").alias("ord"),
                    F.posexplode("r.headers").alias("header_ord", "header")))


def module_candidates(symbols: DataFrame) -> DataFrame:
    """Primary header (ord -1), then the ordered list of the module."""
    primary = N.primary_header("dll")
    rows = F.concat(
        F.when(primary.isNotNull(), F.array(F.struct(F.lit(-1).alias("o"), primary.alias("h"))))
        .otherwise(F.expr("array()")),
        F.transform(N.module_header_list("dll"), lambda h, i: F.struct(i.alias("o"), h.alias("h"))))
    return symbols.withColumn("r", F.explode(rows)).select(
        "symbol", "dll", F.col("r.o").alias("ord"), F.col("r.h").alias("header"))


def header_candidates(symbols: DataFrame, most: int | None = None) -> DataFrame:
    """(symbol, dll, rank, header); ``most``: so many headers a symbol (the original's limit was 8)."""
    return symbols.select("symbol", "dll", F.posexplode(N.header_candidates("symbol", "dll", most)).alias(
        "rank", "header")).withColumn("rank", F.col("rank") + 1)


def url_candidates(symbols: DataFrame, base: str = BASE_US, most: int | None = None) -> DataFrame:
    """(symbol, dll, rank, url), ranks from 1 without gaps; ``most`` headers a symbol."""
    with_headers = symbols.withColumn("headers", N.header_candidates("symbol", "dll", most))
    return with_headers.select(
        "symbol", "dll",
        F.posexplode(N.candidate_urls("symbol", F.col("headers"), F.lit(base))).alias("rank", "url"),
    ).withColumn("rank", F.col("rank") + 1)


def dedupe_ranked(df: DataFrame, keys: list[str], value: str, rank: str = "rank") -> DataFrame:
    """F8 for ranked tables from any source: keep the first position, re-rank.
    The min combines map-side, so copies never travel."""
    first = df.groupBy(*keys, value).agg(F.min(rank).alias(rank))
    w = W.partitionBy(*keys).orderBy(rank, value)
    return first.withColumn(rank, F.row_number().over(w))


def ranked(df: DataFrame, keys: list[str], order: list[str], k: int | None = None, dense_by: list[str] | None = None) -> DataFrame:
    """Rn, the row number within ``keys`` by ``order``, and dr, the dense rank by ``dense_by`` (its first column unless
    given); the first ``k`` rows of each group, if given (Spark then cuts before the shuffle too)."""
    w = W.partitionBy(*keys)
    d = df.withColumn("rn", F.row_number().over(w.orderBy(*order))).withColumn("dr", F.dense_rank().over(w.orderBy(*(dense_by or order[:1]))))
    return d if k is None else d.filter(F.col("rn") <= k)


def probe_budget(cands: DataFrame, first: int = dims.PROBE_FIRST, total: int | None = None) -> DataFrame:
    """cands(symbol, dll, rank, url, valid) -> probed rows with their tier: ranks up to ``first`` always, the
    others (up to ``total``, if given; the original's was 25) when no earlier one is valid and the symbol's module is
    known or its name is important.  A symbol has a few hundred candidates at most by construction."""
    w = W.partitionBy("symbol", "dll")
    hit = F.max((F.col("rank") <= first) & F.col("valid")).over(w)
    more = F.col("dll").isNotNull() | N.is_important("symbol")
    tier = F.when(F.col("rank") <= first, 1).when(~F.col("tier1_hit") & more, 2)
    asked = cands if total is None else cands.filter(F.col("rank") <= total)
    return asked.withColumn("tier1_hit", hit).withColumn("tier", tier).filter(F.col("tier").isNotNull())


def within_budget(rank: Column, name: Column | str, dll: Column, first: int = dims.PROBE_FIRST, total: int | None = None) -> Column:
    """F9 where only the first hit matters: a plain condition, no window."""
    more = dll.isNotNull() | N.is_important(name)
    return (rank <= first) | (more if total is None else more & (rank <= total))


def first_valid(cands: DataFrame) -> DataFrame:
    """lowest rank among valid candidates (deterministic)."""
    return cands.filter("valid").groupBy("symbol").agg(
        F.min_by("url", "rank").alias("url"), F.min("rank").alias("rank"))


def predicted_urls(best: DataFrame) -> DataFrame:
    """F12 on the best header."""
    return best.withColumn("url", N.template_url("symbol", "header"))
