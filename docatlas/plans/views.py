"""Input views derived from the given tables.

One template per view, rendered for Spark SQL and for DuckDB, so a query and its
oracle start from byte-identical rows.  ``spark_view`` returns a lazy DataFrame
over the parquet scan (projection and filters push down as usual).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

VERBS = "Create Open Get Set Read Write Close Delete Nt Zw Rtl Ldr Reg Enum Query Crypt".split()
NOUNS = ("File Process Thread WindowText Key Service Event Socket Heap VirtualMemory Module "
         "Token Message Bitmap Url Widget").split()
SUFFIXES = ["", "A", "W", "Ex", ""]


class Dialect:
    def __init__(self, spark: bool):
        self.spark = spark

    def pick(self, values: list[str], index: str) -> str:
        items = ", ".join(f"'{v}'" for v in values)
        return f"element_at(array({items}), cast({index} as int) + 1)" if self.spark else \
            f"[{items}][cast({index} as int) + 1]"

    def div(self, a: str, b: int) -> str:
        return f"({a} div {b})" if self.spark else f"({a} // {b})"

    def s(self, expr: str) -> str:
        return f"cast({expr} as {'string' if self.spark else 'varchar'})"

    nl = property(lambda self: "'\\n'" if self.spark else "chr(10)")


def symbols_sql(d: Dialect) -> str:
    return f"""
select p_partkey as sym_id,
       concat({d.pick(VERBS, 'p_partkey % 16')},
              {d.pick(NOUNS, d.div('p_partkey', 16) + ' % 16')},
              {d.pick(SUFFIXES, 'p_size % 5')}) as symbol,
       p_name, p_brand, p_type, p_size
from part"""


SPECIAL = ["memcpy", "CreateFileTransacted", "CreateFileTransactedA", "LdrLoadDll",
           "NtCreateUserProcess", "URLDownloadToFile", "FtpPutFile", "peb", "TOKEN_INFO", "IUnknown",
           "GetData", "Bad Name", "", "a-b", "WSAStartup", "ENUMX", "RtlZeroMemory", "LdrUnknownX",
           "CreateProcessAsUserW", "EnumPrinters", "GetUserNameW", "RtlUnwind", "SHGetFolderPath"]


def names_sql(d: Dialect) -> str:
    """symbols_v with special names mixed in."""
    return f"""
select sym_id, case when sym_id % 50 < {len(SPECIAL)} then {d.pick(SPECIAL, f'sym_id % 50 % {len(SPECIAL)}')}
  else symbol end as symbol, p_name
from symbols_v"""


def page_html(d: Dialect, lang: str = "en") -> str:
    """A reference page as one concatenated string (en or pt headings)."""
    heads = {
        "en": ("function", "Syntax", "Parameters", "Return value", "Remarks", "Requirements",
               "Value", "Meaning"),
        "pt": ("rotina", "Sintaxe", "Parâmetros", "Valor de retorno", "Observações", "Requisitos",
               "Valor", "Significado"),
    }[lang]
    noun, syn, par, ret, rem, req, val, mea = heads
    title = f"symbol, ' {noun} (fileapi.h)'"
    return f"""concat(
'<!DOCTYPE html><html><head><title>', {title}, '</title></head><body><main><div class="content"><h1>',
{title}, '</h1><p>Handles the ', p_name, ' object.</p><h2>{syn}</h2><pre><code class="lang-cpp">BOOL ',
symbol, '(', {d.nl}, '  [in] HANDLE hItem,', {d.nl}, '  [in] DWORD dwDesiredAccess', {d.nl},
');</code></pre><h2>{par}</h2><p><code>[in] hItem</code></p><p>A handle to the ', p_name,
' item in use.</p><p><code>[in] dwDesiredAccess</code></p><p>The access mode requested for the item.</p>',
'<table><tr><th>{val}</th><th>{mea}</th></tr><tr><td><b>', upper(p_type), '_ACCESS</b> 0x',
{d.s('p_size')}, '</td><td>Access of ', p_brand, '</td></tr></table><h2>{ret}</h2>',
'<p>Nonzero when the call succeeds.</p>',
case when sym_id % 5 = 0 then '' else concat('<h2>{rem}</h2><p>Remark about ', p_name, ' usage.</p>') end,
'<h2>{req}</h2><p>Library: ', lower(p_type), '.dll</p></div></main></body></html>')"""


def doc_url(d: Dialect) -> str:
    return ("concat('https://learn.example.com/en-us/windows/win32/api/fileapi/nf-fileapi-', "
            "lower(symbol))")


def doc_pages_sql(d: Dialect) -> str:
    """Odd rows of every third symbol use the Portuguese headings."""
    return f"""
select sym_id as page_id, {doc_url(d)} as url,
       case when sym_id % 3 = 1 then {page_html(d, 'pt')} else {page_html(d, 'en')} end as html
from symbols_v"""


def struct_pages_sql(d: Dialect) -> str:
    """Structure pages: a typedef block and, for even rows, a members section."""
    return f"""
select sym_id as page_id, concat({doc_url(d)}, '-struct') as url,
concat('<html><body><div><h1>', upper(symbol), '_INFO structure (fileapi.h)</h1><p>Describes the ', p_name,
' record.</p><h2>Syntax</h2><pre><code>typedef struct _INFO {{', {d.nl}, '    DWORD cb', {d.s('p_size')}, ';', {d.nl},
'    // reserved area', {d.nl}, '    BYTE Reserved1[', {d.s('p_size')}, '];', {d.nl}, '    LPVOID *Ldr; // loader', {d.nl},
'}} INFO;</code></pre>',
case when sym_id % 2 = 0 then concat('<h2>Members</h2><p>cb', {d.s('p_size')}, '</p><p>The size of the ', p_name,
' record in bytes.</p><dl><dt>Ldr</dt><dd>Loader data of ', p_brand, '.</dd></dl>') else '' end,
'<h2>Requirements</h2><p>Header: fileapi.h</p></div></body></html>') as html
from symbols_v"""


def function_map_sql(d: Dialect) -> str:
    return """
select case when sym_id % 3 = 0 then symbol else concat('Unlisted', symbol) end as function, min(case p_type when 'SMALL' then 'fileapi' when 'MEDIUM' then 'winuser'
  when 'LARGE' then 'winreg' when 'PROMO' then 'winbase' when 'ECONOMY' then 'wingdi'
  else 'memoryapi' end) as header
from symbols_v group by 1"""


def header_map_sql(d: Dialect) -> str:
    """(ord, header, function): ordered header lists, names in mixed case."""
    return """
select sym_id as ord, case when p_size % 2 = 0 then 'handleapi' else 'heapapi' end as header,
       case when sym_id % 5 = 0 then concat(symbol, 'Item') else concat('Unlisted', symbol) end as function
from symbols_v
union all
select sym_id as ord, 'profileapi' as header, case when sym_id % 7 = 0 then symbol else concat('Unlisted', symbol, 'Ex') end as function
from symbols_v"""


def catalog_sql(d: Dialect) -> str:
    return f"""
select sym_id as ord, case when sym_id % 4 = 3 then concat('Unlisted', symbol) else symbol end as name,
  case when sym_id % 7 = 0 then 'structure' when sym_id % 7 = 1 then 'macro' else 'function' end as type,
  'fileapi' as header,
  concat('https://learn.example.com/', case when sym_id % 2 = 0 then 'en-us' else 'pt-br' end,
         '/c/', {d.s('sym_id')}) as url,
  case when sym_id % 2 = 0 then 'en-us' else 'pt-br' end as language, p_name as description
from symbols_v"""


def search_results_sql(d: Dialect) -> str:
    path = d.pick(["/windows/win32/api/x/", "/windows-hardware/drivers/ddi/x/",
                   "/cpp/c-runtime-library/", "/azure/", "/other/"], "l_suppkey % 5")
    return f"""
select symbol, l_orderkey * 10 + l_linenumber as rank,
  concat('https://docs.example.com', {path}, {d.s('l_orderkey')}, '-', {d.s('l_suppkey')}) as url,
  case when l_linenumber % 2 = 0 then concat(symbol, ' function') else 'Overview' end as title
from lineitem join symbols_v on l_partkey = sym_id"""


def crawl_sql(d: Dialect) -> str:
    """Crawled pages (key columns): candidate urls of some symbols in both
    languages, catalog urls, search hits; one url has many copies."""
    site = "https://learn.microsoft.com/"
    low = "lower(symbol)"
    return f"""
select sym_id as page_id, case sym_id % 7
  when 0 then concat('{site}en-us/windows/win32/api/fileapi/nf-fileapi-', {low})
  when 1 then concat('{site}en-us/windows-hardware/drivers/ddi/wdm/nf-wdm-', {low})
  when 2 then concat('https://learn.example.com/en-us/c/', {d.s('sym_id')})
  when 3 then concat('{site}en-us/windows/win32/api/winbase/nf-winbase-', {low}, 'w')
  when 4 then concat('{site}pt-br/windows/win32/api/winuser/nf-winuser-', {low})
  when 5 then concat('{site}en-us/windows/win32/api/winreg/nf-winreg-', {low})
  else '{site}en-us/windows/win32/api/winbase/nf-winbase-createfiletransactedw' end as url
from symbols_v
union all
select rank + 1000000 as page_id, case when symbol like 'Get%' or symbol like 'Nt%' then url else concat(url, '/moved') end as url
from search_results_v"""


def probe_log_sql(d: Dialect) -> str:
    return f"""
select event_id, concat('host', {d.s('user_id % 10')}, '.example.com') as host,
  concat('https://host', {d.s('user_id % 10')}, '.example.com/p/', {d.s('event_id % 500')}) as url,
  cast(ts as timestamp) as ts,
  case event_type when 'error' then 500 when 'signup' then 429 else 200 end as status,
  case when event_id % 3 = 0 then 'application/json' else 'text/HTML; charset=utf-8' end as content_type,
  concat('<p>', props, case when event_id % 4 = 0 then ' Syntax' when event_id % 4 = 1 then ' Routine'
         else ' none' end, '</p>') as body_head,
  concat('agent', {d.s('user_id % 15')}) as agent, value as latency
from events"""


def fetch_log_sql(d: Dialect) -> str:
    return f"""
select event_id, concat('https://docs.example.com/p/', {d.s('event_id % 500')}) as url,
  cast(ts as timestamp) as ts,
  case event_type when 'error' then 0 when 'view' then 304 else 200 end as status,
  case when event_type in ('error', 'view') then null else concat('body-', {d.s('event_id')}) end as body,
  case when event_type = 'click' then concat('etag-', {d.s('event_id')}) end as etag,
  case when event_type = 'signup' then concat('lm-', {d.s('event_id')}) end as last_modified
from events"""


def call_log_sql(d: Dialect) -> str:
    module = d.pick(["k", "u", "N", "custom"], "l_suppkey % 4")
    return f"""
select l_orderkey, l_partkey, l_suppkey, l_linenumber,
  concat({module}, case when l_linenumber % 2 = 0 then ':' else '!' end, symbol) as spec,
  concat({d.s('l_partkey')}, ' -', {d.s('l_linenumber')}, ' 0x', {d.s('l_suppkey')},
         ' $s:', l_returnflag, ' $b:', {d.s('l_linenumber * 8')},
         case when l_suppkey % 3 = 0 then ' --wide' else '' end,
         case when l_linenumber = 1 then ' --ret bool' else '' end) as args
from lineitem join symbols_v on l_partkey = sym_id"""


def exports_sql(d: Dialect) -> str:
    """Exported names per module: every second symbol as is, others as A or W."""
    module = d.pick(["kernel32.dll", "user32.dll", "ntdll.dll", "custom.dll"], "sym_id % 4")
    suffix = d.pick(["", "W", "A"], "sym_id % 3")
    return f"""
select distinct {module} as module, concat(symbol, {suffix}) as function from symbols_v"""


def dll_rules_sql(d: Dialect) -> str:
    """Keywords cut out of the symbols, in mixed case and with repeated keys."""
    return f"""
select sym_id as ord, case when sym_id % 11 = 0 then substr(symbol, 1, 4)
    else substr(lower(symbol), cast(1 + sym_id % 6 as int), cast(2 + p_size % 7 as int)) end as key,
  concat(lower(p_type), '-', {d.s('p_size % 5')}, '.dll') as dll
from symbols_v"""


def url_rules_sql(d: Dialect) -> str:
    """Patterns of all shapes over the symbols: whole names, beginnings, parts, sequences, classes and alternatives."""
    low, take = "lower(symbol)", lambda a, n: f"substr(lower(symbol), {a}, {n})"
    return f"""
select sym_id as ord, case sym_id % 9
    when 0 then concat('^', {low}, '$')
    when 1 then concat('^', {take(1, 5)}, '.*')
    when 2 then concat('.*', {take(4, 4)}, '.*')
    when 3 then concat({take(1, 3)}, '.*', {take(7, 3)}, '.*')
    when 4 then concat('(', {take(1, 4)}, '|', {take(1, 2)}, 'x)[a-z]+', {take(8, 2)}, '$')
    when 5 then concat({take(1, 4)}, 's?', {take(5, 2)}, '+')
    when 6 then concat('[', {take(1, 1)}, 'q].*', {take(6, 3)})
    when 7 then concat({take(1, 6)}, '|', {take(2, 3)})
    else concat('^', {take(1, 7)}) end as pattern,
  concat(lower(p_type), ' ', lower(p_brand)) as header_list
from symbols_v"""


VIEWS = {
    "dll_rules_v": (["symbols_v"], dll_rules_sql),
    "url_rules_v": (["symbols_v"], url_rules_sql),
    "symbols_v": (["part"], symbols_sql),
    "names_v": (["symbols_v"], names_sql),
    "doc_pages_v": (["symbols_v"], doc_pages_sql),
    "struct_pages_v": (["symbols_v"], struct_pages_sql),
    "function_map_v": (["symbols_v"], function_map_sql),
    "header_map_v": (["symbols_v"], header_map_sql),
    "catalog_v": (["symbols_v"], catalog_sql),
    "search_results_v": (["lineitem", "symbols_v"], search_results_sql),
    "crawl_v": (["symbols_v", "search_results_v"], crawl_sql),
    "probe_log_v": (["events"], probe_log_sql),
    "fetch_log_v": (["events"], fetch_log_sql),
    "call_log_v": (["lineitem", "symbols_v"], call_log_sql),
    "exports_v": (["symbols_v"], exports_sql),
}


def table(spark: SparkSession, sf_dir: str, name: str, stream: bool = False) -> DataFrame:
    path = f"{sf_dir}/{name}.parquet"
    batch = spark.read.parquet(path)
    # a glob serves a table that is one file as well as one that is a folder
    return spark.readStream.schema(batch.schema).parquet(path[:-1] + "[t]") if stream else batch


def spark_view(spark: SparkSession, sf_dir: str, name: str, stream: bool = False) -> DataFrame:
    """A table or view; ``stream`` reads the base tables as file streams."""
    if name not in VIEWS:
        return table(spark, sf_dir, name, stream)
    needs, template = VIEWS[name]
    return spark.sql(render_refs(template(Dialect(True)), needs),
                     **{n: spark_view(spark, sf_dir, n, stream) for n in needs})


def render_refs(sql: str, needs: list[str]) -> str:
    """Table names become parameters of ``spark.sql``; literal braces are doubled."""
    sql = sql.replace("{", "{{").replace("}", "}}")
    for n in needs:
        for word in ("from ", "join "):
            sql = sql.replace(f"{word}{n}", f"{word}{{{n}}}")
    return sql


def with_views(*names: str) -> str:
    """``WITH`` clause for DuckDB covering the views and what they need."""
    order: list[str] = []

    def visit(n: str) -> None:
        if n in VIEWS and n not in order:
            for m in VIEWS[n][0]:
                visit(m)
            order.append(n)

    for n in names:
        visit(n)
    return "with recursive " + ",\n".join(f"{n} as ({VIEWS[n][1](Dialect(False))})" for n in order)
