"""Symbol tables: validation, classification, overrides, module detection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docatlas import dims
from docatlas.functions import names as N
from docatlas.operators.rule_joins import keyword_modules


def read_symbols(df: DataFrame, col: str = "symbol") -> tuple[DataFrame, DataFrame]:
    """(valid, rejected) from one scan; rejected rows carry a reason."""
    ok = N.valid_symbol(col)
    reason = F.when(F.coalesce(F.col(col), F.lit("")) == "", "empty").otherwise("characters")
    return df.filter(ok), df.filter(~ok).withColumn("reason", reason)


def classify_symbol(df: DataFrame, col: str = "symbol") -> DataFrame:
    return df.withColumn("symbol_type", N.symbol_kind(col))


def flag_important(df: DataFrame, col: str = "symbol") -> DataFrame:
    return df.withColumn("important", N.is_important(col))


def drop_undocumented(df: DataFrame, deny: DataFrame | None = None) -> DataFrame:
    """Remove names known to have no page.  The built-in list is a constant
    predicate; a supplied list is an anti join whose strategy Spark picks by size."""
    key = F.lower("symbol")
    if deny is None:
        return df.filter(~key.isin(dims.UNDOCUMENTED))
    deny = deny.select(F.lower("symbol").alias("deny_key"))
    return df.join(deny, key == F.col("deny_key"), "left_anti")


def only_undocumented(df: DataFrame) -> DataFrame:
    return df.filter(F.lower("symbol").isin(dims.UNDOCUMENTED))


OVERRIDE_DDL = ("key string, override_name string, override_url string, override_type string, "
                "needs_page boolean")


def override_rows() -> list[tuple]:
    base = dims.SITE + "/en-us/windows/win32/api/winbase/nf-winbase-"
    rows = [("memcpy", "memcpy", dims.SITE + "/en-us/cpp/c-runtime-library/reference/memcpy-wmemcpy",
             "crt_function", False)]
    return rows + [(k, None, base + page, None, True) for k, page in dims.TRANSACTED_PAGE.items()]


def apply_overrides(df: DataFrame, dim: DataFrame | None = None) -> DataFrame:
    """Fixed pages of special names.  The built-in dimension has four rows."""
    if dim is None:
        dim = F.broadcast(dims.frame(df.sparkSession, override_rows(), OVERRIDE_DDL))
    return df.join(dim, F.lower("symbol") == F.col("key"), "left").drop("key")


def with_value(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with ``value`` as a column that is computed on the rows of ``df``, once each.  A filter on a plain
    projection would be moved below a ``distinct`` before it, and ``value`` computed for every row there."""
    return df.withColumn(name, F.explode(F.array(value)))


def expand_names(df: DataFrame, col: str = "symbol") -> DataFrame:
    """One row per (tag, key) variant."""
    return df.withColumn("v", F.explode(N.name_variants(col))).select("*", "v.tag", "v.key").drop("v")


def detect_dll(df: DataFrame, dll_rules: DataFrame | None = None, col: str = "symbol") -> DataFrame:
    """J1 + J2.  The built-in keywords are one projection; a table ``dll_rules`` (ord, key, dll) of any
    length is joined by grams of its keywords."""
    if dll_rules is None:
        return df.withColumn("dll", N.module_of(col))
    return keyword_modules(df, dll_rules, col).withColumn("dll", F.coalesce("dll", N.family_module(col)))
