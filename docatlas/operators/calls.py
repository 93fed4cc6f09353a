"""Recorded call logs (E1-E7, G10): specs, options, typed arguments, dumps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docatlas import dims
from docatlas.functions.names import col_of
from docatlas.functions.text import once
from docatlas.operators.lookups import resolve_calls

INT = r"(?i)^\s*[+-]?(0|0(_?0)*|[1-9](_?[0-9])*|0x(_?[0-9a-f])+|0o(_?[0-7])+|0b(_?[01])+)\s*\z"


def split_specs(calls: DataFrame) -> DataFrame:
    """``module:function`` at the first colon, else at the first ``!``."""
    s = F.col("spec")
    sep = F.when(F.contains(s, F.lit(":")), ":").when(F.contains(s, F.lit("!")), "!")
    at = F.when(sep == ":", F.instr(s, ":")).otherwise(F.instr(s, "!"))
    return calls.withColumns({
        "module_spec": F.when(sep.isNotNull(), F.substring(s, F.lit(1), at - 1)),
        "function": F.when(sep.isNotNull(), F.substring(s, at + 1, F.length(s))),
        "spec_error": F.when(sep.isNull(), "no separator")})


def parse_options(calls: DataFrame) -> DataFrame:
    """E2 inside the row: options anywhere, the rest are arguments in order.

    A token is the value of ``--ret`` when an odd number of directly preceding
    ``--ret`` tokens ends right before it."""
    # matches go from left to right without overlap, so a value that looks like the option is a value
    given = r"(?<![^ ])--ret +([^ ]+)"
    d = calls.withColumns({"ret_values": F.regexp_extract_all("args", F.lit(given), F.lit(1)),
                           "tokens": F.filter(F.split(F.regexp_replace("args", given, ""), " "), lambda t: t != "")})
    d = d.withColumns({
        "arguments": F.filter("tokens", lambda t: ~t.isin("--ret", "--wide", "--show-error")),
        "wide": F.array_contains("tokens", "--wide"), "show_error": F.array_contains("tokens", "--show-error")})
    d = d.withColumn("return_type", F.coalesce(F.try_element_at("ret_values", F.lit(-1)), F.lit("u32")))
    error = F.when(F.array_contains("tokens", "--ret"), "missing return type").when(
        ~F.col("return_type").isin(dims.RETURN_TYPES), "unknown return type")
    return d.withColumn("option_error", error).drop("tokens", "ret_values")


def module_name(spec: Column | str) -> Column:
    """Abbreviation, else ``.dll`` is added when there is no dot."""
    s = col_of(spec)
    table = F.expr(dims.as_literal(dims.MODULE_ABBREV, "map<string,string>"))
    return F.coalesce(F.try_element_at(table, F.lower(s)), F.when(F.contains(s, F.lit(".")), s).otherwise(F.concat(s, F.lit(".dll"))))


def normalise_module(calls: DataFrame) -> DataFrame:
    return calls.withColumn("module", module_name("module_spec"))


#: Base -> (digits of one chunk, digits that a plain 64-bit conversion holds).  A chunk is below 10^9.
CHUNKS = {16: (7, 15), 8: (9, 20), 2: (28, 63)}
LIMB = 1000000000


def decimal_text(digits: Column, base: int) -> Column:
    """Decimal digits of a number of any length in ``base`` (16, 8, 2), by limbs of nine decimal digits:
    every chunk multiplies the limbs, lowest first, and adds itself, with a carry from limb to limb."""
    width, plain = CHUNKS[base]
    factor = F.lit(base ** width).cast("long")
    none = F.expr("cast(array() as array<bigint>)")

    def step(done: Column, limb: Column) -> Column:
        value = limb * factor + done["carry"]
        return F.struct(F.concat(done["limbs"], F.array(value % LIMB)).alias("limbs"), F.call_function("div", value, F.lit(LIMB)).alias("carry"))

    def add(limbs: Column, chunk: Column) -> Column:
        first = F.struct(none.alias("limbs"), chunk.alias("carry"))
        return F.aggregate(limbs, first, step, lambda d: F.when(d["carry"] > 0, F.concat(d["limbs"], F.array(d["carry"]))).otherwise(d["limbs"]))

    def whole(digits: Column) -> Column:
        padded = F.lpad(digits, (F.ceil(F.length(digits) / width) * width).cast("int"), F.lit("0"))
        chunks = once(padded, lambda p: F.transform(F.sequence(F.lit(1), F.length(p), F.lit(width)), lambda i: F.conv(F.substring(p, i, F.lit(width)), base, 10).cast("long")))
        text = F.array_join(F.transform(F.reverse(F.aggregate(chunks, none, add)), lambda x: F.lpad(x.cast("string"), 9, "0")), "")
        return once(F.regexp_replace(text, "^0+(?=[0-9])", ""), lambda x: F.when(x == "", "0").otherwise(x))

    return once(digits, lambda d: F.when(F.length(d) <= plain, F.conv(d, base, 10)).otherwise(whole(d)))


def magnitude(token: Column) -> Column:
    """Integer literal -> the decimal digits of its absolute value, of any length; null when it is none.  Decimal, 0x, 0o
    and 0b, signs, ``_`` between digits and blanks around are accepted, leading zeros are not."""
    def value(body: Column) -> Column:
        kind = F.substring(body, 1, 2)
        rest = F.substring(body, F.lit(3), F.length(body))
        plain = F.when(body.startswith("0"), F.lit("0")).otherwise(body)
        return F.when(kind == "0x", decimal_text(rest, 16)).when(kind == "0o", decimal_text(rest, 8)).when(kind == "0b", decimal_text(rest, 2)).otherwise(plain)

    def number(token: Column) -> Column:
        return F.when(token.rlike(INT), once(F.regexp_replace(F.lower(F.trim(token)), r"^[+-]|_", ""), value))

    return once(token, number)


def typed(df: DataFrame, col: str) -> DataFrame:
    """Add kind, width, number, digits, text, error of an argument token.  Staged, so the
    number is parsed once per token.  ``digits`` has integers of any length; ``number`` is null beyond 38 digits."""
    token = F.col(col)
    is_buffer, is_ansi = token.startswith("$b:"), token.startswith("$s:")
    quoted = (F.length(token) >= 2) & token.startswith('"') & token.endswith('"')
    digits = F.when(is_buffer, F.substring(token, F.lit(4), F.length(token))).when(~is_ansi & ~quoted, token)
    d = df.withColumn("_size", magnitude(digits))
    d = d.withColumn("_digits", F.when((F.col("_size") != "0") & F.ltrim(digits).startswith("-"), F.concat(F.lit("-"), "_size")).otherwise(F.col("_size")))
    d = d.withColumn("_n", F.col("_digits").try_cast("decimal(38,0)"))
    n, below = F.col("_n"), F.startswith(F.col("_digits"), F.lit("-"))
    error = F.when(is_buffer, F.when(F.col("_digits").isNull(), "invalid buffer size").when(below | (F.col("_digits") == "0"), "buffer size not positive")
                   .when(n.isNull() | (n > dims.MAX_BUFFER), "buffer size too large"))
    kind = (F.when(is_buffer, F.when(error.isNull(), "buffer").otherwise("error")).when(is_ansi, "str")
            .when(F.col("_digits").isNotNull(), "int").otherwise("wstr"))
    small = F.coalesce((n >= F.lit(-2147483648)) & (n < F.lit(2147483648)), F.lit(False))
    width = F.when(small, F.when(below, "i32").otherwise("u32")).otherwise(F.when(below, "i64").otherwise("u64"))
    text = F.when(is_ansi, F.substring(token, F.lit(4), F.length(token))).when(
        quoted, F.substring(token, F.lit(2), F.length(token) - 2))
    d = d.withColumns({"kind": kind, "error": error})
    return d.withColumns({
        "width": F.when(F.col("kind") == "int", width), "number": F.when(F.col("error").isNull(), n), "digits": F.when(F.col("error").isNull(), F.col("_digits")),
        "text": F.when(F.col("kind").isin("str", "wstr"), F.coalesce(text, token))}).drop("_n", "_digits", "_size")


def type_arguments(calls: DataFrame) -> DataFrame:
    """One row per argument; ``digits`` keeps every digit of an integer."""
    keys = [c for c in calls.columns if c != "arguments"]
    # the outer form: a plain explode would parse every call twice, once to filter by size
    return typed(calls.select(*keys, F.posexplode_outer("arguments").alias("arg_no", "raw")).where("raw is not null"), "raw")


def hexdump(df: DataFrame, col: str) -> DataFrame:
    """One row per 16 bytes; an empty value gives one ``(empty)`` row."""
    size = F.octet_length(col)
    starts = F.when(size > 0, F.sequence(F.lit(0), size - 1, F.lit(16))).otherwise(F.array(F.lit(0)))
    d = df.withColumn("offset", F.explode(starts)).withColumn("part", F.substring(F.col(col), F.col("offset") + 1, F.lit(16)))
    pairs = F.regexp_replace(F.lower(F.hex("part")), "(..)(?!$)", "$1 ")
    ascii_ = F.array_join(F.transform(F.filter(F.split(F.hex("part"), "(?<=\\G..)"), lambda x: x != ""), lambda h: F.when(
        h.between("20", "7E"), F.decode(F.unhex(h), "US-ASCII")).otherwise(".")), "")
    line = F.concat_ws("  ", F.lpad(F.lower(F.hex("offset")), 8, "0"), F.rpad(pairs, 47, " "), ascii_)
    return d.withColumn("line", F.when(size > 0, line).otherwise("(empty)")).drop("part")


def enrich_calls(calls: DataFrame, exports: DataFrame, docs: DataFrame) -> DataFrame:
    """Parsed, normalised and resolved calls with the page of the function.

    docs(doc_module, doc_function, ...) is reduced to one row per function, so calls
    are never multiplied; calls keep their rows and hot functions split by AQE."""
    d = resolve_calls(normalise_module(parse_options(split_specs(calls))), exports)
    one = docs.groupBy(F.lower("doc_function").alias("k")).agg(F.min("doc_page").alias("doc_page"))
    return d.join(one, F.lower(F.coalesce("resolved", "function")) == F.col("k"), "left").drop("k")


def call_profile(calls: DataFrame) -> DataFrame:
    """Calls, users and elapsed quantiles per module and function."""
    return calls.groupBy("module", "function").agg(
        F.count(F.lit(1)).alias("calls"), F.count_distinct("l_orderkey").alias("sources"),
        F.round(F.avg("elapsed"), 6).alias("mean"), F.max("elapsed").alias("longest"),
        F.percentile_approx("elapsed", 0.5).alias("median"))


# ------------------------------------------------------------------ mergeable profiles

#: Distinct counts: 2^LG_COUNT registers, relative standard error about 1.04 / sqrt(2^LG_COUNT).  Quantiles: rank error about 1.7 / K.
LG_COUNT, K = 14, 400


def profile_sketches(calls: DataFrame, *more: str) -> DataFrame:
    """G10 as sketches per module and function (and ``more`` columns, such as the day): calls, sources and elapsed
    are binary values of bounded size that merge in any order, over partitions, batches and days."""
    return calls.groupBy("module", "function", *more).agg(
        F.count(F.lit(1)).alias("calls"), F.hll_sketch_agg("l_orderkey", F.lit(LG_COUNT)).alias("sources"), F.kll_sketch_agg_double("elapsed", F.lit(K)).alias("elapsed"))


def merged_profiles(sketches: DataFrame) -> DataFrame:
    """One row of sketches per module and function over all rows of ``sketches``."""
    return sketches.groupBy("module", "function").agg(
        F.sum("calls").alias("calls"), F.hll_union_agg("sources").alias("sources"), F.kll_merge_agg_double("elapsed", F.lit(K)).alias("elapsed"))


def read_profiles(sketches: DataFrame, quantiles: tuple[float, ...] = (0.5,)) -> DataFrame:
    """module, function, calls, sources (estimate), quantiles of elapsed (estimates)."""
    at = F.array(*[F.lit(float(q)) for q in quantiles])
    return sketches.select("module", "function", "calls", F.hll_sketch_estimate("sources").alias("sources"), F.kll_sketch_get_quantile_double("elapsed", at).alias("quantiles"))
