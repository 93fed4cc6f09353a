"""Rules that are tables: keywords inside names, patterns over names, of any number.

Neither join tests every name against every rule.  A keyword of k characters is filed under
one *gram* of at most three of its characters, the one that the fewest keywords have; a name
sends its distinct grams, meets the keywords filed there and tests those only.  A pattern is
filed by its shape: whole names and beginnings under their literal text, which meets the
beginnings of names; all others under a gram of their longest literal part that every match must hold.
A pattern without such a part ('', ``a|b``) is filed under the empty gram and tried on every name.

Names are made distinct first and rules take the place of their first row and the value of
their last one, as an ordered map would; Spark broadcasts a short rule table and shuffles a long one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRAM = 3
WORD = r"[\p{L}\p{N}_]"


def last_write(rules: DataFrame, key: str, value: str) -> DataFrame:
    """(ord, key, value): the first place and the last value of each key; null keys go."""
    return rules.where(F.col(key).isNotNull()).groupBy(key).agg(F.min("ord").alias("ord"), F.max_by(value, "ord").alias(value))


def pieces(text: Column, size: int) -> Column:
    """All substrings of ``size`` characters, none if the text is shorter."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(text) - size + 1, F.lit(1)))
    return F.when(F.length(text) >= size, F.transform(starts, lambda i: F.substring(text, i, F.lit(size)))).otherwise(F.expr("array()"))


def name_grams(text: Column) -> Column:
    """Distinct grams of every size, the empty one included."""
    return F.array_distinct(F.concat(F.array(F.lit("")), *[pieces(text, k) for k in range(1, GRAM + 1)]))


def literal_grams(text: Column) -> Column:
    """The grams a literal can be filed under: the whole of a short one."""
    return F.when(F.length(text) < GRAM, F.array(text)).otherwise(F.array_distinct(pieces(text, GRAM)))


def filed(rules: DataFrame, key: str, literal: str) -> DataFrame:
    """``rules`` (one row per ``key``) with gram: of the grams of ``literal``, the one that the fewest rules have."""
    grams = rules.select(F.col(key), F.explode(literal_grams(F.col(literal))).alias("gram"))
    common = grams.groupBy("gram").agg(F.count("*").alias("n"))
    rare = grams.join(common, "gram").groupBy(key).agg(F.min(F.struct("n", "gram"))["gram"].alias("gram"))
    return rules.join(rare, key)


def distinct_names(symbols: DataFrame, col: str) -> DataFrame:
    return symbols.select(F.lower(col).alias("low")).where("low is not null").distinct()


def keyword_hits(names: DataFrame, rules: DataFrame) -> DataFrame:
    """(low, ord, key, dll) of every keyword inside every name; ``names`` (low), ``rules`` (ord, key, dll)."""
    at = filed(last_write(rules, "key", "dll"), "key", "key")
    sent = names.select("low", F.explode(name_grams(F.col("low"))).alias("gram"))
    return sent.join(at, "gram").where(F.contains("low", F.col("key"))).select("low", "ord", "key", "dll")


def keyword_modules(symbols: DataFrame, rules: DataFrame, col: str = "symbol") -> DataFrame:
    """J1 by a rule table (ord, key, dll): ``symbols`` with dll, the value of the longest keyword in
    the lower-cased name, ties by ord; null where no keyword is."""
    hits = keyword_hits(distinct_names(symbols, col), rules)
    best = hits.groupBy("low").agg(F.max_by("dll", F.struct(F.length("key"), -F.col("ord"))).alias("dll"))
    return symbols.withColumn("low", F.lower(col)).join(best, "low", "left").drop("low")


# ------------------------------------------------------------------ patterns


def body(pattern: Column) -> Column:
    """A pattern without its start mark and without an end that matches anything."""
    return F.regexp_replace(F.regexp_replace(pattern, r"^\^", ""), r"(\.\*)+\z", "")


def literal_part(pattern: Column) -> Column:
    """The longest run of word characters that every match must hold; '' if none is sure.

    Classes, escapes and groups with their repetition may match anything here; a character that may
    be absent breaks a run.  Patterns with flags, quoting or alternatives outside groups give none."""
    p = F.regexp_replace(pattern, r"\\.", "~")
    p = F.regexp_replace(p, r"\[\^?\]?[^\]]*\]", "~")
    p = F.regexp_replace(p, r"\{[^}]*\}", "*")
    for _ in range(3):
        p = F.regexp_replace(p, r"\([^()]*\)", "~")
    p = F.regexp_replace(p, rf"{WORD}[*?]", "~")
    runs = F.split(p, rf"[^\p{{L}}\p{{N}}_]+")
    longest = F.aggregate(runs, F.lit(""), lambda a, x: F.when(F.length(x) > F.length(a), x).otherwise(a))
    unsure = p.rlike(r"[()|\[\]]") | pattern.rlike(r"\(\?|\\Q")
    return F.when(unsure, "").otherwise(longest)


def shaped(rules: DataFrame) -> DataFrame:
    """``rules`` (ord, pattern, headers) with shape (exact, prefix, other) and literal."""
    whole = F.regexp_extract("pattern", rf"^\^?({WORD}+)\$\z", 1)
    start = F.regexp_extract(body(F.col("pattern")), rf"^({WORD}+)\z", 1)
    return last_write(rules, "pattern", "headers").select(
        "ord", "pattern", "headers", F.when(whole != "", "exact").when(start != "", "prefix").otherwise("other").alias("shape"),
        F.when(whole != "", whole).when(start != "", start).otherwise(literal_part(F.col("pattern"))).alias("literal"))


def pattern_hits(names: DataFrame, rules: DataFrame) -> DataFrame:
    """(low, ord, headers) of every pattern that matches a name from its start; ``names`` (low)."""
    r = shaped(rules)
    plain, other = r.where("shape <> 'other'"), filed(r.where("shape = 'other'"), "pattern", "literal")
    ends = F.when(F.length("low") > 0, F.sequence(F.lit(1), F.length("low"))).otherwise(F.expr("cast(array() as array<int>)"))
    starts = names.select("low", F.explode(F.transform(ends, lambda i: F.substring(F.col("low"), F.lit(1), i))).alias("literal"))
    begun = starts.join(plain, "literal").where("shape = 'prefix' or low = literal")
    sent = names.select("low", F.explode(name_grams(F.col("low"))).alias("gram"))
    tried = sent.join(other, "gram").where(F.contains("low", F.col("literal")) & F.expr("low rlike concat('^(?:', pattern, ')')"))
    return begun.select("low", "ord", "headers").unionByName(tried.select("low", "ord", "headers"))


def pattern_headers(symbols: DataFrame, rules: DataFrame, col: str = "symbol") -> DataFrame:
    """J8 by a rule table (ord, pattern, headers array): (symbol, ord, header_ord, header), every matching
    rule, for every row of ``symbols``."""
    hits = pattern_hits(distinct_names(symbols, col), rules)
    return (symbols.select(F.col(col).alias("symbol"), F.lower(col).alias("low")).join(hits, "low")
            .select("symbol", "ord", F.posexplode("headers").alias("header_ord", "header")))
