"""Queries on pages: block table, sections, page facts, records, text forms."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docatlas import dims
from docatlas.operators import blocks as B
from docatlas.operators import pages as P
from docatlas.operators import records as R
from docatlas.plans.q_symbols import KIND_SQL
from docatlas.plans.registry import query
from docatlas.plans.views import Dialect, doc_url
from docatlas.plans.views import spark_view as view
from docatlas.plans.views import with_views
from docatlas.sources import tables as S
from docatlas.streaming.jobs import shared_folder

# ------------------------------------------------------------------ raw pages

TAGS = B.BLOCK_TAGS
HTML_SQL = r"regexp_replace(html, '(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>', '', 'g')"


def decode_sql(x: str) -> str:
    for name, char in [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "''"), ("&nbsp;", " "), ("&amp;", "&")]:
        x = f"replace({x}, '{name}', '{char}')"
    return x


BLOCKS_CTE = rf"""with h as (select page_id, url, {HTML_SQL} as html from pages)
, c1 as (select page_id, unnest(c) as chunk, unnest(range(len(c))) as i from (select page_id, string_split(
  regexp_replace(regexp_replace(html, '(?i)(<ul[\s>])', chr(1) || '\1', 'g'), '(?i)(</ul>)', '\1' || chr(1), 'g'),
  chr(1)) as c from h))
, c2 as (select page_id, i, unnest(c) as raw, unnest(range(len(c))) as j from (select page_id, i,
  case when regexp_matches(chunk, '(?i)^<ul[\s>]') then [chunk]
  else string_split(regexp_replace(chunk, '(?i)(</?(?:{TAGS})[\s/>])', chr(2) || '\1', 'g'), chr(2)) end as c from c1))
, c3 as (select page_id, row_number() over (partition by page_id order by i, j) - 1 as pos, raw from c2 where raw <> '')
, c4 as (select page_id, pos, raw, lower(regexp_extract(raw, '(?i)^<(/?(?:{TAGS}))[\s/>]', 1)) as tag from c3)
, b as (select page_id, pos::int as pos, raw, tag, {decode_sql("regexp_replace(case when tag = '' then raw else regexp_replace(raw, '^<[^>]*>?', '') end, '<[^>]*>', '', 'g')")} as text
  from c4)
"""


@query("p0_blocks", BLOCKS_CTE + "select page_id, pos, tag, md5(text) as digest from b")
def p0(spark, sf):
    return B.describe(B.raw_blocks(view(spark, sf, "pages"))).select(
        "page_id", "pos", "tag", F.md5("text").alias("digest"))


@query("w1_section", BLOCKS_CTE + """
select page_id, pos, coalesce(last_value(case when regexp_matches(tag, '^h[1-6]$') then pos end ignore nulls)
  over (partition by page_id order by pos), -1) as section_pos from b""")
def w1(spark, sf):
    b = B.with_section(B.describe(B.raw_blocks(view(spark, sf, "pages"))))
    return b.select("page_id", "pos", F.coalesce("section_pos", F.lit(-1)).alias("section_pos"))


@query("w2_islands", BLOCKS_CTE + """
select page_id, pos, sum(case when tag = 'p' then 1 else 0 end) over (partition by page_id order by pos)::bigint
  as island from b""")
def w2(spark, sf):
    b = B.with_island(B.describe(B.raw_blocks(view(spark, sf, "pages"))), F.col("tag") == "p")
    return b.select("page_id", "pos", "island")


CONTAINER_SQL = ", ".join(f"'{c}'" for c in B.CONTAINERS if c not in B.ATOMIC)


@query("w3_parent", BLOCKS_CTE + f"""
, dl as (select *, case when tag in ({CONTAINER_SQL}) then 1 when tag[1] = '/' and tag[2:] in ({CONTAINER_SQL}) then -1
  else 0 end as delta from b)
, dp as (select *, greatest(sum(delta) over (partition by page_id order by pos), 0) as depth from dl)
, lv as (select *, depth - greatest(delta, 0) as level from dp)
select lv.page_id, lv.pos, lv.level::int as level, coalesce(max(o.pos), -1) as parent from lv
left join lv o on o.page_id = lv.page_id and o.delta > 0 and o.depth = lv.level and o.pos < lv.pos
group by all""")
def w3(spark, sf):
    return B.blocks(view(spark, sf, "pages")).select("page_id", "pos", "level", "parent")


@query("w4_neighbours", BLOCKS_CTE + """
select page_id, pos, lag(tag) over w as prev_tag, lead(tag) over w as next_tag,
  coalesce(last_value(case when tag = 'p' then pos end ignore nulls) over (partition by page_id order by pos
    rows between unbounded preceding and 1 preceding), -1) as prev_p
from b window w as (partition by page_id order by pos)""")
def w4(spark, sf):
    b = B.with_neighbours(B.describe(B.raw_blocks(view(spark, sf, "pages"))))
    return b.select("page_id", "pos", "prev_tag", "next_tag", F.coalesce("prev_p", F.lit(-1)).alias("prev_p"))


@query("g1_section_text", BLOCKS_CTE + """
select page_id, tag, md5(string_agg(text, ' ' order by pos)) as digest, count(*) as blocks from b
where tag in ('p', 'h1', 'title') group by all""")
def g1(spark, sf):
    b = B.describe(B.raw_blocks(view(spark, sf, "pages"))).filter(F.col("tag").isin("p", "h1", "title"))
    return B.joined_text(b, ["page_id", "tag"], " ").withColumn("digest", F.md5("text")).drop("text")


STRIP = r"regexp_replace({0}, '^[\s\x{{a0}}]+|[\s\x{{a0}}]+\z', '', 'g')"


@query("p1_raw_page_name", BLOCKS_CTE + rf"""
, t as (select page_id, arg_min({STRIP.format('text')}, pos) as title from b where tag = 'h1' group by page_id)
select page_id, regexp_replace(title, '(?i)\s+(function|api)[^\n]*\z', '') as name from t""")
def p1_raw(spark, sf):
    return P.page_facts(view(spark, sf, "pages"), "name")


@query("p16_raw_architectures", BLOCKS_CTE + f"""
, t as (select page_id, lower({decode_sql("regexp_replace(html, '<[^>]*>', '', 'g')")}) as text from h)
select page_id, case when x64 and x86 then 'x64,x86' when x64 then 'x64' when x86 then 'x86' else 'x86,x64' end as arch
from (select page_id, regexp_matches(text, 'x64|64-bit') as x64, regexp_matches(text, 'x86|32-bit|desktop') as x86 from t)""")
def p16_raw(spark, sf):
    d = P.page_facts(view(spark, sf, "pages"), "architectures")
    return d.select("page_id", F.array_join("architectures", ",").alias("arch"))


@query("p17_raw_description", BLOCKS_CTE + rf"""
, a as (select page_id, string_split(regexp_extract(html, '(?is)</h1>(.*?)</article>', 1), '<p>')[2:] as ps from h)
, p as (select page_id, unnest(range(len(ps))) as i, {STRIP.format(decode_sql("regexp_replace(string_split(unnest(ps), '</p>')[1], '<[^>]*>', '', 'g')"))} as t from a)
, k as (select *, row_number() over (partition by page_id order by i) as rn from p where length(t) > 5
  and not regexp_matches(lower(t), '{"|".join(dims.SKIP_PHRASES)}'))
select page_id, md5(trim(regexp_replace(string_agg(t, ' ' order by i), '[\s\x{{a0}}]+', ' ', 'g'))) as digest
from k group by page_id""")
def p17_raw(spark, sf):
    d = P.page_facts(view(spark, sf, "pages"), "description")
    return d.select("page_id", F.md5("description").alias("digest"))


# ------------------------------------------------------------------ reference pages, round trip

DOC = with_views("doc_pages_v")


def docs(spark, sf):
    return view(spark, sf, "doc_pages_v")


def fact(name: str, fact_name: str, sql: str):
    @query(name, DOC + f"select sym_id as page_id, {sql} as {fact_name} from symbols_v")
    def run(spark, sf):
        return P.page_facts(docs(spark, sf), fact_name)
    return run


SIGNATURE_SQL = "concat('BOOL ', symbol, '(', chr(10), '  [in] HANDLE hItem,', chr(10), '  [in] DWORD dwDesiredAccess', chr(10), ');')"
fact("p1_page_name", "name", "concat(symbol, ' (fileapi.h)')")
fact("p2_page_module", "dll", "concat(lower(p_type), '.dll')")
fact("p3_signature", "signature", SIGNATURE_SQL)


#: Language marks on the code, on its container, two containers up, in a data attribute, or none.
MARKED = {"<pre><code class=\"lang-cpp\">": [("<pre class='lang-csharp'><code>", "csharp"), ("<div class='language-vb'><pre><code>", "vb"),
          ("<div class='x lang-js'><section class='y'><pre><code>", "js"), ("<pre data-lang='go'><code>", "go"), ("<pre><code>", "cpp")]}


@query("p4_code_language", DOC + "select sym_id as page_id, ['csharp', 'vb', 'js', 'go', 'cpp'][sym_id % 5 + 1] as signature_language from symbols_v")
def p4(spark, sf):
    (plain, ways), = MARKED.items()
    html = F.col("html")
    for k, (way, _) in enumerate(ways):
        html = F.when(F.col("page_id") % 5 == k, F.replace(F.col("html"), F.lit(plain), F.lit(way))).otherwise(html)
    return P.page_facts(docs(spark, sf).withColumn("html", html), "signature_language")


fact("p15_remarks", "remarks", "case when sym_id % 5 = 0 then '' else concat('Remark about ', p_name, ' usage.') end")
fact("p17_description", "description", "concat('Handles the ', p_name, ' object.')")


@query("p5_signature_layout", with_views("symbols_v") + """
select sym_id, concat('WINAPI BOOL ', symbol, '(', chr(10), 'int a,', chr(10), '  int b', chr(10), ');') as signature
from symbols_v""")
def p5(spark, sf):
    from docatlas.functions import text as T
    raw = F.concat(F.lit("WINAPI\n\n  BOOL "), F.col("symbol"), F.lit("(\n    int a,\n\n      int b\n    );\n"))
    return T.with_signature(view(spark, sf, "symbols_v"), raw, "signature").select("sym_id", "signature")


@query("p6_parameters", DOC + """
select sym_id as page_id, 0 as param_no, 'hItem' as name, concat('A handle to the ', p_name, ' item in use.') as description
from symbols_v union all select sym_id, 1, 'dwDesiredAccess', 'The access mode requested for the item.' from symbols_v""")
def p6(spark, sf):
    return R.parameters_table(P.page_facts(docs(spark, sf), "parameters")).select("page_id", "param_no", "name", "description")


@query("p7_parameter_types", DOC + """
select sym_id as page_id, 'hItem' as name, 'HANDLE' as type from symbols_v
union all select sym_id, 'dwDesiredAccess', 'DWORD' from symbols_v""")
def p7(spark, sf):
    return R.parameters_table(P.page_facts(docs(spark, sf), "parameters")).select("page_id", "name", "type")


@query("p8_parameter_value_tables", DOC + """
select sym_id as page_id, 1 as param_no, 'dwDesiredAccess' as param, 0 as table_no, 'Valores' as title, 0 as entry_no,
  concat(upper(p_type), '_ACCESS (0x', cast(p_size as varchar), ')') as value, concat('Access of ', p_brand) as meaning
from symbols_v""")
def p8(spark, sf):
    return R.param_values_table(P.page_facts(docs(spark, sf), "parameters"))


STRUCT = with_views("struct_pages_v")
RETURN_HTML = """concat('<h1>', symbol, ' function (x.h)</h1><h2>Return value</h2><p>The call gives a code.</p><table><caption>',
p_name, '</caption><tr><th>Return code</th><th>Description</th></tr><tr><td><dl><dt><b>ERR_', upper(p_type),
'</b></dt><dt>', cast(p_size as {t}), '</dt></dl></td><td>Reason ', p_brand, '</td></tr><tr><td>OTHER_CODE 0x1fL</td><td>Second</td></tr></table>',
'<ul><li>ALPHA_MODE: first of ', p_name, '</li><li>BETA - second of ', p_name, '</li><li>short</li></ul>')"""


def return_pages(spark, sf):
    return view(spark, sf, "symbols_v").withColumn("html", F.expr(RETURN_HTML.format(t="string"))).selectExpr(
        "sym_id as page_id", "concat('https://docs.example.com/', sym_id) as url", "html")


def value_blocks(spark, sf):
    from docatlas.functions import tables as V
    b = B.describe(B.raw_blocks(return_pages(spark, sf)))
    b = b.withColumn("rows", F.when(F.col("tag") == "table", V.rows_of(F.col("raw"))))
    return b.withColumn("entries", F.when(F.col("tag") == "table", V.value_entries(F.col("rows"))).when(
        F.col("tag") == "ul", V.list_entries(F.col("raw"))))


def value_rows(spark, sf, tag: str):
    # the outer form: a plain explode would find the entries once more, to filter by size
    b = value_blocks(spark, sf).filter(F.col("tag") == tag)
    return b.select("page_id", F.posexplode_outer("entries").alias("entry_no", "e")).where("e is not null")


@query("p9_value_tables", with_views("symbols_v") + """
select sym_id as page_id, 0 as entry_no, concat('Reason ', p_brand) as meaning from symbols_v
union all select sym_id, 1, 'Second' from symbols_v""")
def p9(spark, sf):
    return value_rows(spark, sf, "table").select("page_id", "entry_no", "e.meaning")


@query("p10_cell_values", with_views("symbols_v") + """
select sym_id as page_id, 0 as entry_no, concat('ERR_', upper(p_type), ' (', cast(p_size as varchar), ')') as value from symbols_v
union all select sym_id, 1, 'OTHER_CODE (0x1fL)' from symbols_v""")
def p10(spark, sf):
    return value_rows(spark, sf, "table").select("page_id", "entry_no", "e.value")


@query("p11_list_values", with_views("symbols_v") + """
select sym_id as page_id, 0 as entry_no, 'ALPHA_MODE' as value, concat('first of ', p_name) as meaning from symbols_v
union all select sym_id, 1, 'BETA', concat('second of ', p_name) from symbols_v""")
def p11(spark, sf):
    return value_rows(spark, sf, "ul").select("page_id", "entry_no", "e.value", "e.meaning")


@query("p12_return_table_rejection", DOC + """
select sym_id as page_id, case when p_type = 'MEDIUM' then 0 else 1 end as tables from symbols_v""")
def p12(spark, sf):
    """The value ``WIDE_...`` contains ``ID``: the table of those rows is dropped."""
    html = F.replace(F.col("html"), F.lit("MEDIUM_ACCESS"), F.lit("WIDE_ACCESS"))
    p = R.parameters_table(P.page_facts(docs(spark, sf).withColumn("html", html), "parameters"))
    return p.filter("param_no = 1").select("page_id", "tables")


TITLE_CASES = ("case sym_id % 4 when 0 then '<p>The buttons follow.</p>' when 1 then '<h3>Near heading</h3>' "
               "when 2 then '<p>Use the default one.</p>' else '<p>Plain text here.</p>' end")


@query("p13_table_titles", DOC + """
select sym_id as page_id, case sym_id % 4 when 0 then 'Botões' when 1 then 'Near heading' when 2 then 'Botão Padrão'
  else 'Valores' end as title from symbols_v""")
def p13(spark, sf):
    html = F.replace(F.col("html"), F.lit("<table>"), F.concat(F.expr(TITLE_CASES.replace("sym_id", "page_id")), F.lit("<table>")))
    p = R.param_values_table(P.page_facts(docs(spark, sf).withColumn("html", html), "parameters"))
    return p.select("page_id", "title")


@query("p14_return_info", with_views("symbols_v") + """
select sym_id as page_id, concat('- The call gives a code.', chr(10), '- ALPHA_MODE: first of ', p_name, 'BETA - second of ', p_name,
  'short', chr(10), chr(10), '- Valores de retorno possíveis:', chr(10), '  - ERR_', upper(p_type), ' (', cast(p_size as varchar), '): Reason ',
  p_brand, chr(10), '  - OTHER_CODE (0x1fL): Second') as return_description, 'BOOL' as return_type from symbols_v""")
def p14(spark, sf):
    return P.page_facts(return_pages(spark, sf), "return_description", "return_type")


@query("p16_architectures", DOC + "select sym_id as page_id, ['x86,x64', 'x64', 'x86', 'x64,x86'][sym_id % 4 + 1] as arch from symbols_v")
def p16(spark, sf):
    note = F.expr("case page_id % 4 when 0 then '' when 1 then ' on 64-bit' when 2 then ' on the desktop' else ' on X64 and 32-bit' end")
    d = docs(spark, sf).withColumn("html", F.replace(F.col("html"), F.lit(" item in use."), F.concat(F.lit(" item in use"), note, F.lit("."))))
    return P.page_facts(d, "architectures").select("page_id", F.array_join("architectures", ",").alias("arch"))


MEMBERS_SQL = """
select sym_id as page_id, 0 as member_no, 'cb' || p_size as name, 'Unknown' as type,
  concat('The size of the ', p_name, ' record in bytes.') as description from symbols_v where sym_id % 2 = 0
union all select sym_id, 1, 'Ldr', 'Unknown', concat('Loader data of ', p_brand, '.') from symbols_v where sym_id % 2 = 0
"""
CODE_MEMBERS_SQL = """
select sym_id as page_id, 0 as member_no, 'cb' || p_size as name, 'DWORD' as type, 'Membro da estrutura' as description
from symbols_v where sym_id % 2 = 1
union all select sym_id, 1, 'Reserved1', concat('BYTE[', p_size, ']'), 'Campo reservado para uso interno do sistema'
from symbols_v where sym_id % 2 = 1
union all select sym_id, 2, 'Ldr', 'LPVOID *', 'Ponteiro para dados do loader de módulos carregados'
from symbols_v where sym_id % 2 = 1"""


# every page has one of the two forms
ALL_MEMBERS_SQL = MEMBERS_SQL + " union all " + CODE_MEMBERS_SQL


def structs(spark, sf):
    return view(spark, sf, "struct_pages_v")


@query("p18_section_members", STRUCT + ALL_MEMBERS_SQL)
def p18(spark, sf):
    return R.members_table(P.page_facts(structs(spark, sf), "members"))


@query("p19_code_members", STRUCT + f"select page_id, member_no, name, type from ({ALL_MEMBERS_SQL})")
def p19(spark, sf):
    d = P.page_facts(structs(spark, sf), "members")
    return R.members_table(d).select("page_id", "member_no", "name", "type")


@query("p20_member_descriptions", STRUCT + f"select page_id, name, description from ({ALL_MEMBERS_SQL})")
def p20(spark, sf):
    d = P.page_facts(structs(spark, sf), "members")
    return R.members_table(d).select("page_id", "name", "description")


@query("p21_struct_definition", STRUCT + """
select sym_id as page_id, concat('typedef struct _INFO {', chr(10), '    DWORD cb', p_size, ';', chr(10), '    BYTE Reserved1[', p_size,
  '];', chr(10), '    LPVOID *Ldr; // loader', chr(10), '} INFO;') as definition from symbols_v""")
def p21(spark, sf):
    return P.page_facts(structs(spark, sf), "definition")


# ------------------------------------------------------------------ records

FLAT = ["page_id", "url", "name", "dll", "calling_convention", "parameter_count", "signature_language", "return_type",
        "return_description", "remarks", "description", "documentation_found", "documentation_language", "symbol_type",
        "kind", "surface"]
RECORDS_SQL = f"""
select page_id, url, concat(symbol, ' (fileapi.h)') as name, concat(lower(p_type), '.dll') as dll,
  '__stdcall' as calling_convention, 2 as parameter_count, 'cpp' as signature_language, 'BOOL' as return_type,
  '- Nonzero when the call succeeds.' as return_description,
  case when sym_id % 5 = 0 then '' else concat('Remark about ', p_name, ' usage.') end as remarks,
  concat('Handles the ', p_name, ' object.') as description, true as documentation_found,
  'en-us' as documentation_language, {KIND_SQL.format("concat(symbol, ' (fileapi.h)')")} as symbol_type,
  'function' as kind, 'win32' as surface
from doc_pages_v join symbols_v on page_id = sym_id"""


@query("p22_records", DOC + RECORDS_SQL)
def p22(spark, sf):
    return R.doc_records(docs(spark, sf)).select(*FLAT)


@query("p22_struct_records", STRUCT + """
select sym_id as page_id, 'N/A' as calling_convention, 'struct' as kind, 0 as parameter_count,
  case when sym_id % 2 = 0 then 2 else 3 end as member_count from symbols_v""")
def p22_struct(spark, sf):
    return R.doc_records(structs(spark, sf)).select("page_id", "calling_convention", "kind", "parameter_count", "member_count")


@query("f14_missing_sections", DOC + """
select sym_id as page_id, 'remarks' as section from symbols_v where sym_id % 5 = 0""")
def f14(spark, sf):
    return B.missing_sections(B.describe(B.raw_blocks(docs(spark, sf))))


@query("f13_skip_words", BLOCKS_CTE + rf"""
select page_id, pos, length({STRIP.format('text')}) as n from b where tag = 'p' and length({STRIP.format('text')}) > 5
  and not regexp_matches(lower(text), '{"|".join(dims.SKIP_PHRASES)}')""")
def f13(spark, sf):
    from docatlas.functions import text as T
    b = B.describe(B.raw_blocks(view(spark, sf, "pages"))).filter("tag = 'p'").withColumn("text", T.strip(F.col("text")))
    return b.filter((F.length("text") > 5) & ~T.any_word(F.lower("text"), dims.SKIP_PHRASES)).select(
        "page_id", "pos", F.length("text").alias("n"))


MARKDOWN_SQL = f"""concat('# ', symbol, ' (fileapi.h)', n, n, '## Basic Information', n, n, '- **DLL**: ', lower(p_type), '.dll', n,
'- **Calling Convention**: __stdcall', n, '- **Parameter Count**: 2', n, '- **Architectures**: x86, x64', n,
'- **Return Type**: BOOL', n, n, '## Signature', n, n, '```cpp', n, {SIGNATURE_SQL}, n, '```', n, n, '## Description', n, n,
'Handles the ', p_name, ' object.', n, n, '## Parameters', n, n, '### hItem', n, 'A handle to the ', p_name, ' item in use.', n, n,
'### dwDesiredAccess', n, 'The access mode requested for the item.', n, n, '#### Valores', n, n, '| Value | Meaning |', n,
'|-------|---------|', n, '| `', upper(p_type), '_ACCESS (0x', cast(p_size as varchar), ')` | Access of ', p_brand, ' |', n, n, n,
'## Return Value', n, n, '- Nonzero when the call succeeds.',
case when sym_id % 5 = 0 then '' else concat(n, '## Remarks', n, n, 'Remark about ', p_name, ' usage.') end)"""


@query("s9_markdown", DOC + f"select case when contains(url, 'en-us') then 'en-us' else 'pt-br' end as language, body from (select {doc_url(Dialect(False))} as url, {MARKDOWN_SQL} as body from (select *, chr(10) as n from symbols_v))")
def s9(spark, sf):
    """Written as text and read back whole."""
    path = shared_folder(spark, "s9")
    S.write_markdown(R.doc_records(docs(spark, sf)), path, "us", show_remarks=True)
    return S.read_markdown(spark, path)


@query("s10_functions", DOC + RECORDS_SQL.replace("select page_id, url,", "select page_id,", 1).split(",\n  concat('Handles")[0] +
       " from doc_pages_v join symbols_v on page_id = sym_id")
def s10_functions(spark, sf):
    keep = [c for c in FLAT if c not in ("url", "description", "documentation_found", "documentation_language",
                                         "symbol_type", "kind", "surface")]
    return R.functions_table(R.doc_records(docs(spark, sf))).select(*keep)


@query("s10_tables", with_views("doc_pages_v", "struct_pages_v") + f"""
select 'functions' as kind, sym_id as page_id, 0 as a, 0 as b, concat(symbol, ' (fileapi.h)') as name, '2 ' || lower(p_type) || '.dll' as text from symbols_v
union all select 'functions', sym_id + 100000000, 0, 0, upper(symbol) || '_INFO structure (fileapi.h)', '0 kernel32.dll' from symbols_v
union all select 'parameters', sym_id, i, 0, case i when 0 then 'hItem' else 'dwDesiredAccess' end, case i when 0 then 'HANDLE' else 'DWORD' end from symbols_v, range(2) r(i)
union all select 'param_values', sym_id, 1, 0, concat(upper(p_type), '_ACCESS (0x', p_size, ')'), concat('Access of ', p_brand) from symbols_v
union all select 'members', page_id + 100000000, member_no, 0, name, description from ({ALL_MEMBERS_SQL})""")
def s10(spark, sf):
    """The four tables of functions and structures, written together and read back."""
    path = shared_folder(spark, "s10")
    other = structs(spark, sf).withColumn("page_id", F.col("page_id") + 100000000)
    S.write_tables(R.doc_records(docs(spark, sf).unionByName(other)), path)
    t = S.read_tables(spark, path)
    zero = F.lit(0)

    def rows(kind, a, b, name, text):
        return t[kind].select(F.lit(kind).alias("kind"), "page_id", a.alias("a"), b.alias("b"), name.alias("name"), text.alias("text"))

    c = F.col
    return (rows("functions", zero, zero, c("name"), F.concat_ws(" ", c("parameter_count").cast("string"), "dll"))
            .unionByName(rows("parameters", c("param_no"), zero, c("name"), c("type")))
            .unionByName(rows("param_values", c("param_no"), c("entry_no"), c("value"), c("meaning")))
            .unionByName(rows("members", c("member_no"), zero, c("name"), c("description"))))


@query("g2_record_counts", with_views("doc_pages_v", "struct_pages_v") + """
select sym_id as page_id, 2 + (sym_id % 3)::int as parameter_count, 0 as member_count, 1 as value_tables from symbols_v
union all select sym_id + 100000000, 0, case when sym_id % 2 = 0 then 2 else 3 end, 0 from symbols_v""")
def g2(spark, sf):
    """Functions with two to four parameters, structures with two or three members."""
    more = F.expr("repeat('<p><code>[in] nMore</code></p><p>Another parameter of the call here.</p>', cast(page_id % 3 as int))")
    start = F.lit("<p><code>[in] hItem</code></p>")
    functions = docs(spark, sf).withColumn("html", F.replace(F.col("html"), start, F.concat(more, start)))
    other = structs(spark, sf).withColumn("page_id", F.col("page_id") + 100000000)
    return R.record_counts(R.doc_records(functions.unionByName(other)))


@query("g9_constant_dictionary", DOC + """
, v as (select sym_id as page_id, 'dwDesiredAccess' as param, concat(upper(p_type), '_ACCESS (0x', cast(p_size as varchar), ')') as value,
  concat('Access of ', p_brand) as meaning from symbols_v)
, m as (select param, value, meaning, count(*) as n from v group by all)
select param, value, arg_min(meaning, (-n, meaning)) as meaning, sum(n)::bigint as uses,
  (select count(distinct page_id) from v where v.param = m.param and v.value = m.value) as pages
from m group by param, value""")
def g9(spark, sf):
    return R.constant_dictionary(R.param_values_table(P.page_facts(docs(spark, sf), "parameters")))


@query("m1_markdown", DOC + f"select sym_id as page_id, {MARKDOWN_SQL} as body from (select *, chr(10) as n from symbols_v)")
def m1(spark, sf):
    return R.doc_records(docs(spark, sf)).select("page_id", R.markdown_body("us", show_remarks=True).alias("body"))


@query("m2_not_found_markdown", with_views("names_v") + "select distinct symbol, replace('" +
       dims.NOT_FOUND_MARKDOWN["us"].replace("'", "''") + "', '{}', symbol) as body from names_v")
def m2(spark, sf):
    missing = R.not_found_records(view(spark, sf, "names_v").select("symbol").distinct())
    return missing.select("symbol", R.markdown_body("us").alias("body"))


@query("m3_json_body", DOC + """
select sym_id as page_id, concat(symbol, ' (fileapi.h)') as name, 2 as parameter_count, p_brand as brand, true as has_error_key
from symbols_v""")
def m3(spark, sf):
    j = R.json_body(R.doc_records(docs(spark, sf)), "page_id")
    path = "$.parameters[1].values[0].entries[0].meaning"
    return j.select("page_id", F.get_json_object("json", "$.name").alias("name"),
                    F.get_json_object("json", "$.parameter_count").cast("int").alias("parameter_count"),
                    F.replace(F.get_json_object("json", path), F.lit("Access of "), F.lit("")).alias("brand"),
                    F.col("json").contains('"error":null').alias("has_error_key"))


@query("m4_title_split", with_views("symbols_v") + """
select sym_id, symbol, case when sym_id % 4 < 2 then 'fileapi.h' end as header from symbols_v""")
def m4(spark, sf):
    title = F.expr("""case sym_id % 4 when 0 then concat('Função ', symbol, ' (fileapi.h)') when 1 then concat(symbol, ' (fileapi.h)')
      when 2 then concat('Structure ', symbol) else symbol end""")
    d = view(spark, sf, "symbols_v").withColumn("title", title)
    symbol, header = R.title_parts("title")
    return d.select("sym_id", symbol.alias("symbol"), header.alias("header"))
