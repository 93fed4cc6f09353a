"""Documentation records, their tables and their text forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docatlas import dims
from docatlas.functions import names as N
from docatlas.functions import text as T
from docatlas.operators import pages as P

ENTRY = "struct<value:string,meaning:string>"
VALUE_TABLE = f"struct<type:string,title:string,entries:array<{ENTRY}>>"
PARAMETER = f"struct<name:string,type:string,description:string,values:array<{VALUE_TABLE}>>"
MEMBER = "struct<name:string,type:string,description:string>"
INFO = ("struct<symbol:string,kind:string,surface:string,header:string,dll:string,library:string,"
        "api_set:string,url_pattern:string,confidence:double>")

# name -> Spark type of the record, in output order
RECORD = {
    "url": "string", "name": "string", "symbol": "string", "dll": "string", "calling_convention": "string",
    "parameters": f"array<{PARAMETER}>", "parameter_count": "int", "architectures": "array<string>",
    "signature": "string", "signature_language": "string", "return_type": "string",
    "return_description": "string", "remarks": "string", "description": "string",
    "documentation_found": "boolean", "documentation_online": "boolean",
    "documentation_language": "string", "symbol_type": "string", "fallback_used": "boolean",
    "fallback_attempts": "array<string>", "symbol_info": INFO, "kind": "string", "surface": "string",
    "header": "string", "error": "string", "members": f"array<{MEMBER}>", "member_count": "int",
}


def as_record(df: DataFrame, given: dict[str, Column], *keys: str) -> DataFrame:
    """Project to the record schema; fields not given are null."""
    cols = [given.get(n, F.lit(None)).cast(t).alias(n) for n, t in RECORD.items()]
    return df.select(*keys, *cols)


def doc_records(pages: DataFrame, *keep: str, paragraphs: int | None = None) -> DataFrame:
    """One record per page, from one exchange.  ``keep``: further columns of ``pages`` that go along;
    ``paragraphs``: at most so many in a description.

    Structures (N1 on the bare title word) get members instead of parameters;
    everything else is a function record."""
    d = P.page_facts(pages, "url", "name", "dll", "architectures", "signature", "signature_language", "return_type",
                     "parameters", "return_description", "remarks", "description", "members", "definition", paragraphs=paragraphs, keep=keep)
    bare = F.regexp_extract("name", r"(?U)^(?:(?:Função|Function|Estrutura|Structure)\s+)?(\S+)", 1)
    d = d.withColumn("is_struct", N.symbol_kind(bare) == "structure")
    d = d.withColumn("kind", F.when(F.col("is_struct"), "struct").otherwise("function"))
    struct = F.col("is_struct")
    empty = F.lit("[]")
    none_p = F.from_json(empty, f"array<{PARAMETER}>")
    has_sig = F.col("signature") != ""
    info = F.struct(
        F.col("name").alias("symbol"), "kind", N.page_surface("url").alias("surface"), F.lit("unknown").alias("header"),
        F.lit(None).cast("string").alias("dll"), F.lit(None).cast("string").alias("library"),
        F.lit(None).cast("string").alias("api_set"), N.url_pattern("url").alias("url_pattern"),
        F.lit(0.95).alias("confidence"))
    given = {
        "url": F.col("url"), "name": F.col("name"), "dll": F.col("dll"),
        "calling_convention": F.when(struct, "N/A").otherwise("__stdcall"),
        "parameters": F.when(struct, none_p).otherwise(F.col("parameters")),
        "parameter_count": F.when(struct, 0).otherwise(F.size("parameters")),
        "architectures": F.col("architectures"),
        "signature": F.when(struct & ~has_sig, F.coalesce("definition", "signature")).otherwise(F.col("signature")),
        "signature_language": F.col("signature_language"),
        "return_type": F.when(struct, "N/A").otherwise(F.col("return_type")),
        "return_description": F.when(struct, "").otherwise(F.col("return_description")),
        "remarks": F.col("remarks"), "description": F.col("description"),
        "documentation_found": F.lit(True), "documentation_online": F.lit(True),
        "documentation_language": N.url_language("url"), "symbol_type": N.symbol_kind("name"),
        "fallback_used": F.lit(False), "fallback_attempts": F.array().cast("array<string>"),
        "symbol_info": info, "kind": F.col("kind"), "surface": N.page_surface("url"), "header": F.lit("unknown"),
        "members": F.when(struct, F.col("members")), "member_count": F.when(struct, F.size("members")),
    }
    return as_record(d, given, "page_id", *keep)


def not_found_records(symbols: DataFrame, lang: str = "us") -> DataFrame:
    """DM7 record of each unresolved symbol."""
    s = F.col("symbol")
    text = dims.NOT_FOUND_ERROR.get(lang, dims.NOT_FOUND_ERROR["us"])
    return as_record(symbols, {
        "symbol": s, "name": s, "documentation_found": F.lit(False), "documentation_online": F.lit(False),
        "symbol_type": N.symbol_kind("symbol"), "fallback_used": F.lit(lang == "br"),
        "fallback_attempts": F.array().cast("array<string>"), "parameters": F.from_json(F.lit("[]"), f"array<{PARAMETER}>"),
        "parameter_count": F.lit(0), "architectures": F.array().cast("array<string>"),
        "error": F.replace(F.lit(text), F.lit("{}"), s),
    })


def memcpy_record(symbols: DataFrame) -> DataFrame:
    """The literal record of the one runtime function that needs no page."""
    params = [("dest", "void *", "Destination buffer"), ("src", "const void *", "Source buffer"),
              ("count", "size_t", "Number of bytes to copy")]
    p = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(t).alias("type"), F.lit(d).alias("description"),
                           F.lit(None).cast(f"array<{VALUE_TABLE}>").alias("values")) for n, t, d in params])
    return as_record(symbols.filter(F.lower("symbol") == "memcpy"), {
        "symbol": F.col("symbol"), "name": F.lit("memcpy"), "documentation_found": F.lit(True),
        "documentation_online": F.lit(True), "documentation_language": F.lit("us"), "symbol_type": F.lit("crt_function"),
        "fallback_used": F.lit(False), "fallback_attempts": F.array().cast("array<string>"),
        "url": F.lit(dims.SITE + "/en-us/cpp/c-runtime-library/reference/memcpy-wmemcpy"), "dll": F.lit("MSVCRT.dll"),
        "calling_convention": F.lit("__cdecl"), "parameters": p, "parameter_count": F.lit(3),
        "architectures": F.array(F.lit("x86"), F.lit("x64")),
        "signature": F.lit("void *memcpy(void *dest, const void *src, size_t count);"), "return_type": F.lit("void *"),
        "return_description": F.lit("Returns dest"),
        "description": F.lit("Copies bytes between buffers. Note: This is a banned function due to security concerns. "
                             "Consider using memcpy_s instead."),
    })


# ------------------------------------------------------------------ tables


def functions_table(records: DataFrame) -> DataFrame:
    return records.drop("parameters", "members", "symbol_info", "fallback_attempts")


# Outer explodes with a test on the position: a plain explode makes the optimizer push
# ``size(array) > 0`` below, which would evaluate the whole array expression again.


def parameters_table(records: DataFrame) -> DataFrame:
    return records.select("page_id", F.posexplode_outer("parameters").alias("param_no", "p")).filter("param_no is not null").select(
        "page_id", "param_no", "p.name", "p.type", "p.description", F.coalesce(F.size("p.values"), F.lit(0)).alias("tables"))


def param_values_table(records: DataFrame) -> DataFrame:
    t = records.select("page_id", F.posexplode_outer("parameters").alias("param_no", "p"))
    t = t.select("page_id", "param_no", F.col("p.name").alias("param"), F.posexplode("p.values").alias("table_no", "t"))
    return t.select("page_id", "param_no", "param", "table_no", "t.title", F.posexplode("t.entries").alias("entry_no", "e")
                    ).select("*", "e.value", "e.meaning").drop("e")


def members_table(records: DataFrame) -> DataFrame:
    return records.select("page_id", F.posexplode_outer("members").alias("member_no", "m")).filter("member_no is not null").select("page_id", "member_no", "m.*")


def record_counts(records: DataFrame) -> DataFrame:
    """G2."""
    tables = F.aggregate("parameters", F.lit(0), lambda a, p: a + F.coalesce(F.size(p["values"]), F.lit(0)))
    return records.select("page_id", "parameter_count", F.coalesce("member_count", F.lit(0)).alias("member_count"),
                          F.coalesce(tables, F.lit(0)).alias("value_tables"))


def constant_dictionary(values: DataFrame) -> DataFrame:
    """Constants per parameter name, with the smallest of the most frequent
    meanings and the page count.

    Counts per (param, value, meaning) combine before the shuffle, so a constant on
    a third of all pages stays cheap; pages are counted with their own key first."""
    per_page = values.groupBy("param", "value", "page_id").agg(F.lit(1).alias("one"))
    pages = per_page.groupBy("param", "value").agg(F.count(F.lit(1)).alias("pages"))
    per_meaning = values.groupBy("param", "value", "meaning").agg(F.count(F.lit(1)).alias("n"))
    top = per_meaning.groupBy("param", "value").agg(
        F.min_by("meaning", F.struct((-F.col("n")).alias("neg"), "meaning")).alias("meaning"),
        F.sum("n").alias("uses"))
    return top.join(pages, ["param", "value"])


# ------------------------------------------------------------------ text forms


def title_parts(name: Column | str) -> tuple[Column, Column]:
    """M4: (symbol, header)."""
    c = N.col_of(name)
    header = T.extract(c, r"\(([^)]+\.h)\)")
    full = F.regexp_replace(c, r"^(?:Função\s+|Function\s+|Estrutura\s+|Structure\s+)?(.+?)\s*\([^)]+\).*$", "$1")
    short = F.regexp_replace(c, r"^(?:Função\s+|Function\s+|Estrutura\s+|Structure\s+)", "")
    return F.when(header.isNotNull(), full).otherwise(short), header


def json_body(df: DataFrame, *keys: str) -> DataFrame:
    """The whole record, nulls kept, non-ASCII kept."""
    rest = [c for c in df.columns if c not in keys]
    return df.select(*keys, F.to_json(F.struct(*rest), {"ignoreNullFields": "false"}).alias("json"))


def not_found_markdown(name: Column, lang: str) -> Column:
    """M2."""
    text = dims.NOT_FOUND_MARKDOWN["br" if lang == "br" else "us"]
    return F.replace(F.lit(text), F.lit("{}"), name)


def markdown_body(lang: str = "br", show_remarks: bool = False) -> Column:
    """M1/M2 over the record columns.  Unknown languages use br; value tables are
    always shown."""
    i = 0 if lang == "us" else 1
    s = {k: v[i] for k, v in dims.MARKDOWN_LABELS.items()}

    def lit(x: str) -> Column:
        return F.lit(x)

    def cell(x: Column) -> Column:
        return F.replace(x, lit("|"), lit("\\|"))

    def table(t: Column) -> Column:
        rows = F.array_join(F.transform(t["entries"], lambda e: F.concat(
            lit("| `"), cell(e["value"]), lit("` | "), cell(e["meaning"]), lit(" |\n"))), "")
        return F.concat(lit("\n#### "), F.coalesce(t["title"], lit(s["values"])),
                        lit("\n\n| Value | Meaning |\n|-------|---------|\n"), rows, lit("\n"))

    def parameter(p: Column) -> Column:
        tables = F.coalesce(F.array_join(F.transform(p["values"], table), ""), lit(""))
        return F.concat(lit("\n### "), p["name"], lit("\n"), p["description"], lit("\n"), tables)

    body = F.concat(
        lit("# "), "name", lit(f"\n\n## {s['basic_info']}\n\n- **DLL**: "), "dll",
        lit(f"\n- **{s['calling_convention']}**: "), "calling_convention",
        lit(f"\n- **{s['parameters_field']}**: "), F.col("parameter_count").cast("string"),
        lit(f"\n- **{s['architectures']}**: "), F.array_join("architectures", ", "),
        lit(f"\n- **{s['return_type']}**: "), "return_type",
        lit(f"\n\n## {s['signature']}\n\n```"), F.coalesce("signature_language", lit("c")), lit("\n"), "signature",
        lit(f"\n```\n\n## {s['description']}\n\n"), "description", lit(f"\n\n## {s['parameters']}\n"),
        F.array_join(F.transform("parameters", parameter), ""),
        F.when(F.col("return_description") != "", F.concat(
            lit(f"\n## {s['return_value']}\n\n"), "return_description")).otherwise(""))
    if show_remarks:
        body = F.concat(body, F.when(F.col("remarks") != "", F.concat(
            lit(f"\n## {s['remarks']}\n\n"), "remarks")).otherwise(""))
    missing = not_found_markdown(F.coalesce("name", "symbol", lit("Unknown")), lang)
    return F.when(F.coalesce("documentation_found", F.lit(False)), body).otherwise(missing)
