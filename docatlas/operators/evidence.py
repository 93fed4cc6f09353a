"""Header prediction: evidence rows, additive scores, top-k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docatlas import dims
from docatlas.functions import names as N


def expand_map(header_map: DataFrame, function_map: DataFrame | None = None) -> DataFrame:
    """(key, header), one row per key.

    ``header_map(ord, header, function)`` gives eight spellings per function, the
    last write wins; ``function_map(function, header)`` then replaces exact keys.
    ``max_by`` combines on the map side, so a header with a third of all rows
    does not matter."""
    f, low = F.col("function"), F.lower("function")
    # one row per header and function before the eight spellings: a key's last write is among them
    header_map = header_map.groupBy("header", "function").agg(F.max(F.col("ord").cast("long")).alias("ord"))
    keys = [low, f, F.concat(low, F.lit("a")), F.concat(low, F.lit("w")), F.concat(f, F.lit("A")),
            F.concat(f, F.lit("W")), F.concat(low, F.lit("ex")), F.concat(f, F.lit("Ex"))]
    rows = header_map.select(
        "header", "ord", F.posexplode(F.array(*keys)).alias("sub", "key"))
    rows = rows.withColumn("top", F.lit(0))
    if function_map is not None:
        rows = rows.unionByName(function_map.select(
            "header", F.lit(0).cast("long").alias("ord"), F.lit(0).alias("sub"),
            f.alias("key"), F.lit(1).alias("top")).distinct())
    return rows.groupBy("key").agg(
        F.max_by("header", F.struct("top", "ord", "sub")).alias("header"))


def writes(rows: DataFrame, key: str, value: str, order: str = "ord") -> DataFrame:
    """Per key the value of the last and of the first write, and the number of writes; partial aggregates, so a
    key with a third of all rows does not matter."""
    return rows.groupBy(key).agg(F.max_by(value, order).alias(f"last_{value}"), F.min_by(value, order).alias(f"first_{value}"), F.count(F.lit(1)).alias("writes"))


def header_evidence(symbols: DataFrame, key_map: DataFrame) -> DataFrame:
    """(symbol, dll, ord, source, header, score).

    Works on distinct (symbol, dll).  Every name probes the key map with up to
    three spellings in one equi join; names without a hit take the fallback
    branch and the module bonus is one more row, both without a join."""
    names = symbols.select("symbol", "dll").distinct()
    low = F.lower("symbol")
    # no filter of the array: the optimizer would repeat it below the distinct, for every row
    probes = F.array(*[
        F.struct(F.lit(i).alias("ord"), F.lit(tag).alias("source"), key.alias("key"), F.lit(s).alias("score"))
        for i, (tag, key, s) in enumerate([
            ("exact", low, dims.SCORE_EXACT), ("aw_base", N.aw_base("symbol"), dims.SCORE_AW),
            ("ex_base", N.ex_base("symbol"), dims.SCORE_EX)])
    ])
    probed = names.withColumn("p", F.explode(probes)).select("symbol", "dll", "p.*").where("key is not null")
    hits = probed.join(key_map, "key", "left").groupBy("symbol", "dll").agg(
        F.collect_list(F.when(F.col("header").isNotNull(),
                              F.struct("ord", "source", "header", "score"))).alias("hits"))
    fallback = F.transform(N.fallback_evidence("symbol"), lambda r: F.struct(
        r["ord"].alias("ord"), F.lit("pattern").alias("source"), r["header"].alias("header"),
        r["score"].alias("score")))
    bonus = N.bonus_header("dll")
    bonus_rows = F.when(bonus.isNotNull(), F.array(F.struct(
        F.lit(9).alias("ord"), F.lit("module").alias("source"), bonus.alias("header"),
        F.lit(dims.SCORE_MODULE).alias("score")))).otherwise(F.expr("array()"))
    rows = F.concat(F.when(F.size("hits") > 0, F.col("hits")).otherwise(fallback), bonus_rows)
    return hits.withColumn("e", F.explode(rows)).select("symbol", "dll", "e.*")


def best_in_row(hits: Column, symbol: Column | str, dll: Column | str) -> Column:
    """F3 inside a row: (neg, ord, header) of the best header of ``hits`` (array of ord, header, score), or of the
    fallback where there is none, with the module bonus; scores add up per header, ``neg`` is the negative sum."""
    bonus = N.bonus_header(dll)
    rows = F.concat(F.when(F.size(hits) > 0, hits).otherwise(N.fallback_evidence(symbol)), F.array_compact(F.array(
        F.when(bonus.isNotNull(), F.struct(F.lit(9).alias("ord"), bonus.alias("header"), F.lit(dims.SCORE_MODULE).alias("score"))))))

    def scored(every: Column) -> Column:
        return F.transform(every, lambda r: F.struct(
            (-F.round(F.aggregate(F.filter(every, lambda q: q["header"] == r["header"]), F.lit(0.0), lambda a, q: a + q["score"]), 6)).alias("neg"),
            r["ord"].alias("ord"), r["header"].alias("header")))

    # one evaluation of the rows: they are named by an array of one element
    return F.get(F.transform(F.array(rows), lambda every: F.array_min(scored(every))), F.lit(0))


def score_headers(evidence: DataFrame) -> DataFrame:
    """Additive score per (symbol, header); combines before the shuffle."""
    return evidence.groupBy("symbol", "dll", "header").agg(
        F.round(F.sum("score"), 6).alias("score"), F.min("ord").alias("ord"))


def top_headers(evidence: DataFrame, k: int = 5) -> DataFrame:
    """at most k headers per symbol, ties by first insertion.  The sums can
    exceed 1 (0.95 + 0.90): they are scores, not probabilities."""
    w = W.partitionBy("symbol", "dll").orderBy(F.desc("score"), "ord")
    return (score_headers(evidence).withColumn("rank", F.row_number().over(w))
            .filter(F.col("rank") <= k).drop("ord"))


def best_header(evidence: DataFrame, threshold: float = 0.3) -> DataFrame:
    """one aggregate instead of a window, since only the first row counts."""
    scored = score_headers(evidence)
    best = scored.groupBy("symbol", "dll").agg(
        F.min_by(F.struct("header", "score"), F.struct((-F.col("score")).alias("s"), "ord")).alias("b"))
    return best.select("symbol", "dll", "b.header", "b.score").filter(F.col("score") > threshold)


def map_statistics(header_map: DataFrame, key_map: DataFrame) -> DataFrame:
    """One row."""
    a = header_map.agg(F.count_distinct("header").alias("mapped_headers"))
    b = key_map.agg(F.count(F.lit(1)).alias("mapped_functions"))
    # two one-row aggregates side by side, not a product of data
    return a.crossJoin(b).withColumn("url_patterns", F.lit(len(dims.URL_TEMPLATES)).cast("long"))
