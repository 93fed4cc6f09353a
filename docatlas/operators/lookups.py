"""Equi lookups against catalogs, maps, search results, exports, labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docatlas import dims
from docatlas.functions import names as N
from docatlas.functions.text import any_word


def catalog_names(catalog: DataFrame, lang: str = "en-us") -> DataFrame:
    """(key, wanted, any): the first entry of each lower-case name in the wanted language, and in any."""
    row = F.struct("ord", "name", "url", "language")
    return catalog.filter(F.col("type").isin("function", "macro")).groupBy(F.lower("name").alias("key")).agg(
        F.min_by(row, F.when(F.col("language") == lang, F.col("ord"))).alias("wanted"), F.min_by(row, "ord").alias("any"))


def catalog_probes(name: Column) -> list[Column]:
    """Spellings under which J10 asks the catalog, in order."""
    low = F.lower(name)
    return [low, F.concat(low, F.lit("a")), F.concat(low, F.lit("w")), N.aw_base(name)]


def in_both_languages(catalog: DataFrame, name: str = "name", one: str = "en-us", other: str = "pt-br") -> DataFrame:
    """Lower-case names that the catalog has in both languages; one aggregate with a flag per language, where an
    intersection would shuffle two sides."""
    flags = [F.bool_or(F.col("language") == x).alias(f"has_{i}") for i, x in enumerate((one, other))]
    return catalog.groupBy(F.lower(name).alias("name")).agg(*flags).where("has_0 and has_1").select("name")


def lookup_catalog(symbols: DataFrame, catalog: DataFrame, lang: str = "en-us") -> DataFrame:
    """Best catalog row per symbol.

    The catalog is first reduced to one row per lower-case name (first entry in
    the wanted language, first in any), so a name with many entries costs one
    row in the join."""
    per_name = catalog_names(catalog, lang)
    probes = F.filter(F.array(*[F.struct(F.lit(i).alias("prio"), k.alias("key")) for i, k in enumerate(catalog_probes(F.col("symbol")))]),
                      lambda r: r["key"].isNotNull())
    hit = F.coalesce(F.col("wanted"), F.when(F.col("prio") == 0, F.col("any")))
    return (symbols.select("symbol").distinct().withColumn("p", F.explode(probes))
            .select("symbol", "p.*").join(per_name, "key").withColumn("hit", hit)
            .filter("hit is not null").groupBy("symbol")
            .agg(F.min_by("hit", "prio").alias("hit")).select("symbol", "hit.*"))


def direct_url(symbols: DataFrame, function_map: DataFrame, base: str) -> DataFrame:
    """Case-sensitive name, else name+W, else name+A."""
    s = F.col("symbol")
    probes = F.array(*[F.struct(F.lit(i).alias("prio"), F.concat(s, F.lit(x)).alias("function"))
                       for i, x in enumerate(["", "W", "A"])])
    url = N.win32_url(F.lit(base), F.col("hit.header"), F.lower("hit.function"))
    return (symbols.select("symbol").distinct().withColumn("p", F.explode(probes))
            .select("symbol", "p.*").join(function_map, "function").groupBy("symbol")
            .agg(F.min_by(F.struct("function", "header"), "prio").alias("hit"))
            .select("symbol", F.col("hit.function").alias("function"), url.alias("url")))


def pick_search_hit(results: DataFrame) -> DataFrame:
    """results(symbol, rank, url, title) -> one url per symbol.

    The first result in rank order in any strict class wins, classes are not
    ranked among each other; the broad pass counts only without a strict hit.
    One partial aggregate, no join: hot symbols combine on the map side."""
    titled = F.contains(F.lower("title"), F.lower("symbol"))
    strict, broad = any_word(F.col("url"), dims.HIT_PATHS), any_word(F.col("url"), dims.BROAD_PATHS)
    pass_ = F.when(strict, 1).when(broad, 2)
    # the pass test stays above the projection of url: a pushed filter would evaluate a
    # computed url once per path word
    d = results.filter(titled).withColumn("pass", pass_)
    return (d.groupBy("symbol").agg(F.min(F.when(F.col("pass").isNotNull(), F.struct("pass", "rank", "url"))).alias("m"))
            .filter("m is not null").select("symbol", "m.pass", "m.rank", "m.url"))


def resolve_calls(calls: DataFrame, exports: DataFrame) -> DataFrame:
    """calls(..., module, function, wide) + resolved export name.

    Exports fold to one row per (module, asked name) with three flags, so each
    call joins exactly one row and calls are neither multiplied nor regrouped."""
    f = F.col("function")
    stem = F.substring(f, F.lit(1), F.length(f) - 1)
    rows = F.filter(F.array(
        F.struct(f.alias("ask"), F.lit(0).alias("kind")),
        F.struct(F.when(f.endswith("W"), stem).alias("ask"), F.lit(1).alias("kind")),
        F.struct(F.when(f.endswith("A"), stem).alias("ask"), F.lit(2).alias("kind")),
    ), lambda r: r["ask"].isNotNull())
    table = (exports.select(F.col("module"), F.explode(rows).alias("r")).groupBy("module", "r.ask").agg(
        F.bool_or(F.col("r.kind") == 0).alias("has_name"), F.bool_or(F.col("r.kind") == 1).alias("has_w"),
        F.bool_or(F.col("r.kind") == 2).alias("has_a")).withColumnRenamed("ask", "function"))
    found = (F.when(F.col("wide"), F.when(F.col("has_w"), F.concat(f, F.lit("W"))))
             .when(F.col("has_name"), f).when(F.col("has_w"), F.concat(f, F.lit("W")))
             .when(F.col("has_a"), F.concat(f, F.lit("A"))))
    return (calls.join(table, ["module", "function"], "left").withColumn("resolved", found)
            .drop("has_name", "has_w", "has_a"))


def localise(df: DataFrame, lang_col: str, key_col: str, labels: dict[str, tuple],
             default: str = "us") -> DataFrame:
    """Label of (language, key); unknown language -> default, unknown key -> key."""
    dim = F.broadcast(dims.frame(df.sparkSession, dims.label_rows(labels),
                                 "label_lang string, label_key string, label string"))
    lang = F.when(F.col(lang_col).isin("us", "br"), F.col(lang_col)).otherwise(default)
    return (df.join(dim, (lang == F.col("label_lang")) & (F.col(key_col) == F.col("label_key")), "left")
            .withColumn("label", F.coalesce("label", key_col)).drop("label_lang", "label_key"))
