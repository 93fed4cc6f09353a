"""Queries on symbols: sources, classification, evidence, candidates, lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from docatlas import dims
from docatlas.functions import names as N
from docatlas.functions import text as T
from docatlas.operators import candidates as C
from docatlas.operators import evidence as E
from docatlas.operators import logs as G
from docatlas.operators import lookups as L
from docatlas.operators import symbols as S
from docatlas.plans.registry import query, values
from docatlas.plans.views import spark_view as view
from docatlas.plans.views import with_views

# ------------------------------------------------------------------ symbols


@query("s1_symbol_source", with_views("names_v") + """
select sym_id, symbol, case when regexp_full_match(symbol, '[A-Za-z0-9_\\-]+') then 'valid'
  when symbol = '' then 'empty' else 'characters' end as outcome from names_v""")
def s1(spark, sf):
    ok, bad = S.read_symbols(view(spark, sf, "names_v"))
    return ok.select("sym_id", "symbol", F.lit("valid").alias("outcome")).unionByName(
        bad.select("sym_id", "symbol", F.col("reason").alias("outcome")))


KIND_SQL = """case
  when regexp_matches({0}, '^(Nt|Zw|Rtl|Ldr)') then 'native_function'
  when ({0} = upper({0}) and regexp_matches({0}, '[A-Z]') and contains({0}, '_'))
    or lower({0}) in ('peb', 'teb', 'token_control') then 'structure'
  when regexp_matches(lower({0}), 'proc|callback|hook') then 'callback'
  when regexp_matches({0}, '^I[A-Z]') then 'com_interface'
  when regexp_matches({0}, '^[A-Z]') and not regexp_matches({0}[1:3], '[a-z]')
    and not contains({0}, '_') then 'enum'
  else 'win32_function' end"""


@query("n1_symbol_kind", with_views("names_v") + f"select sym_id, symbol, {KIND_SQL.format('symbol')} "
       "as symbol_type from names_v")
def n1(spark, sf):
    return S.classify_symbol(view(spark, sf, "names_v").select("sym_id", "symbol"))


@query("n2_undocumented", with_views("names_v") + """
select symbol, lower(symbol) in ('ldrloaddll', 'ldrgetdllhandle', 'ldrgetprocedureaddress',
  'ntcreateuserprocess') as denied, count(*) as n from names_v group by 1, 2""")
def n2(spark, sf):
    names = view(spark, sf, "names_v")
    kept = S.drop_undocumented(names).select("symbol", F.lit(False).alias("denied"))
    gone = S.only_undocumented(names).select("symbol", F.lit(True).alias("denied"))
    return kept.unionByName(gone).groupBy("symbol", "denied").agg(F.count(F.lit(1)).alias("n"))


@query("n3_overrides", with_views("names_v") + f"""
select sym_id, symbol, override_url, override_type from names_v left join
{values([r for r in [(k, u, t) for k, _, u, t, _ in S.override_rows()]], 't(key, override_url, override_type)')})
on lower(symbol) = key""")
def n3(spark, sf):
    return S.apply_overrides(view(spark, sf, "names_v")).select(
        "sym_id", "symbol", "override_url", "override_type")


@query("n5_name_variants", with_views("names_v") + r"""
, d as (select distinct symbol, lower(symbol) as low from names_v)
select symbol, tag, key from (
  select symbol, 'exact' as tag, low as key from d
  union all select symbol, 'aw_base', low[:-2] from d where regexp_matches(low, '[aw]\z')
  union all select symbol, 'ex_base', low[:-3] from d where regexp_matches(low, 'ex\z')
  union all select symbol, 'plus_a', low || 'a' from d
  union all select symbol, 'plus_w', low || 'w' from d
  union all select symbol, 'native_twin', case when low like 'nt%' then 'zw' else 'nt' end || low[3:]
  from d where low like 'nt%' or low like 'zw%')""")
def n5(spark, sf):
    return S.expand_names(view(spark, sf, "names_v").select("symbol").distinct())


@query("n6_importance", with_views("names_v") + """
select sym_id, regexp_matches(lower(symbol), '^(create|get|set|open|close|read|write|nt|zw)') as important
from names_v""")
def n6(spark, sf):
    return S.flag_important(view(spark, sf, "names_v")).select("sym_id", "important")


@query("n7_page_surface", """
select page_id, case when contains(u, '/win32/') then 'win32' when contains(u, '/drivers/') then 'driver'
  else 'unknown' end as surface, case when contains(u, '/nf-') then 'nf-' else '' end as url_pattern
from (select page_id, case page_id % 3 when 0 then 'https://x.example/win32/nf-a-b' when 1
  then 'https://x.example/drivers/z' else url end as u from pages)""")
def n7(spark, sf):
    u = F.when(F.col("page_id") % 3 == 0, "https://x.example/win32/nf-a-b").when(
        F.col("page_id") % 3 == 1, "https://x.example/drivers/z").otherwise(F.col("url"))
    return view(spark, sf, "pages").select(
        "page_id", N.page_surface(u).alias("surface"), N.url_pattern(u).alias("url_pattern"))


@query("n8_name_from_url", with_views("doc_pages_v") + r"""
, u as (select page_id, url from doc_pages_v union all select -page_id - 1, url from pages)
select page_id, case when n = '' then 'FunçãoDesconhecida' else upper(n[1]) || n[2:] end as name
from (select page_id, regexp_extract(url, '/nf-[^/]+-([^/]+?)/?\z', 1) as n from u)""")
def n8(spark, sf):
    urls = view(spark, sf, "doc_pages_v").select("page_id", "url").unionByName(
        view(spark, sf, "pages").select((-F.col("page_id") - 1).alias("page_id"), "url"))
    return urls.select("page_id", N.name_from_url("url").alias("name"))


@query("n9_url_language", with_views("catalog_v") + """
select ord, replace(url, '/en-us/', '/pt-br/') as br_url,
  case when contains(url, 'en-us') then 'en-us' else 'pt-br' end as language from catalog_v""")
def n9(spark, sf):
    return view(spark, sf, "catalog_v").select(
        "ord", N.localise_url("url", "br").alias("br_url"), N.url_language("url").alias("language"))


@query("n10_short_url", with_views("search_results_v") + """
select url, case when contains(url, '/api/') then 'api/' || url[strpos(url, '/api/') + 5:]
  else replace(url, 'https://learn.microsoft.com/', '') end as short, count(*) as n
from (select url from search_results_v union all select url from pages) group by 1, 2""")
def n10(spark, sf):
    urls = view(spark, sf, "search_results_v").select("url").unionByName(
        view(spark, sf, "pages").select("url"))
    return urls.groupBy("url").agg(F.count(F.lit(1)).alias("n")).withColumn("short", N.short_url("url"))


@query("n11_clean_text", r"""
select doc_id, md5(trim(regexp_replace(text, '[\s\x{0085}\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x0b]+', ' ', 'g'))) as digest
from documents""")
def n11(spark, sf):
    return view(spark, sf, "documents").select("doc_id", F.md5(T.clean_text(F.col("text"))).alias("digest"))


@query("s5_page_source", "select page_id, sha256(url) as url_key from pages")
def s5(spark, sf):
    return view(spark, sf, "pages").select("page_id", N.url_key("url").alias("url_key"))


# ------------------------------------------------------------------ modules

DLL_VALUES = values([(o, k, d) for o, k, d in dims.keyword_rules()], "r(ord, key, dll)") + ")"
DISTINCT_NAMES = with_views("names_v") + ", d as (select distinct symbol, lower(symbol) as low from names_v)\n"
KEYWORD_CTE = f""", j1 as (select symbol, arg_max(dll, length(key) * 10000 - ord) as dll
  from d join {DLL_VALUES} on contains(low, key) group by symbol)
"""
FAMILY_SQL = """case
  when regexp_matches(low, '^(nt|zw|rtl|ldr)') then 'ntdll.dll'
  when low like 'create%' then case
    when regexp_matches(low, 'processasuser|processwithlogon|processwithtoken') then 'advapi32.dll'
    when regexp_matches(low, 'process|file') then 'kernel32.dll'
    when contains(low, 'window') then 'user32.dll' when contains(low, 'service') then 'advapi32.dll' end
  when low like 'open%' then case when regexp_matches(low, 'process|thread') then 'kernel32.dll'
    when regexp_matches(low, 'key|service') then 'advapi32.dll' end
  when regexp_matches(low, '^(get|set)') then case when contains(low, 'window') then 'user32.dll'
    when contains(low, 'file') then 'kernel32.dll'
    when contains(low, 'process') then case when contains(low, 'psapi') then 'psapi.dll' else 'kernel32.dll' end end
  when low like 'enum%' then case when contains(low, 'process') then 'psapi.dll'
    when contains(low, 'window') then 'user32.dll' when contains(low, 'service') then 'advapi32.dll' end
end"""
MODULE_CTE = KEYWORD_CTE + f""", m as (select d.symbol, d.low, coalesce(j1.dll, {FAMILY_SQL}) as dll
  from d left join j1 using (symbol))
"""


def distinct_names(spark, sf):
    return view(spark, sf, "names_v").select("symbol").distinct()


def with_module(spark, sf):
    return S.detect_dll(distinct_names(spark, sf))


@query("j1_keyword_module", DISTINCT_NAMES + KEYWORD_CTE + "select symbol, dll from j1")
def j1(spark, sf):
    return S.with_value(distinct_names(spark, sf), "dll", N.keyword_module("symbol")).filter("dll is not null")


@query("j2_module_fallback", DISTINCT_NAMES + KEYWORD_CTE + f"""
select symbol, {FAMILY_SQL} as dll from d where symbol not in (select symbol from j1)""")
def j2(spark, sf):
    named = S.with_value(distinct_names(spark, sf), "keyword", N.keyword_module("symbol"))
    return named.filter("keyword is null").withColumn("dll", N.family_module("symbol")).drop("keyword")


@query("j1_module_counts", DISTINCT_NAMES + MODULE_CTE + """
select m.dll, count(*) as symbols, count(distinct n.symbol) as names
from names_v n join m on n.symbol = m.symbol group by m.dll""")
def module_counts(spark, sf):
    return S.detect_dll(view(spark, sf, "names_v")).groupBy("dll").agg(
        F.count(F.lit(1)).alias("symbols"), F.count_distinct("symbol").alias("names"))


RULE_TABLE_CTE = with_views("names_v", "dll_rules_v") + """, d as (select distinct symbol, lower(symbol) as low from names_v),
k as (select key, min(ord) as ord, arg_max(dll, ord) as dll from dll_rules_v group by key),
j1 as (select symbol, arg_max(dll, length(key) * 100000000 - ord) as dll from d join k on contains(low, key) group by symbol)
"""


@query("j1_rule_table", RULE_TABLE_CTE + f"select symbol, coalesce(j1.dll, {FAMILY_SQL}) as dll from d left join j1 using (symbol)")
def j1_rule_table(spark, sf):
    return S.detect_dll(distinct_names(spark, sf), view(spark, sf, "dll_rules_v"))


@query("j8_rule_table", with_views("names_v", "url_rules_v") + """, d as (select distinct symbol, lower(symbol) as low from names_v),
r as (select pattern, min(ord) as ord, string_split(arg_max(header_list, ord), ' ') as headers from url_rules_v group by pattern),
hits as (select symbol, ord, headers from d join r on regexp_matches(low, '^(?:' || pattern || ')'))
select symbol, ord, i::int - 1 as header_ord, headers[i] as header from (select *, unnest(range(1, len(headers) + 1)) as i from hits)""")
def j8_rule_table(spark, sf):
    rules = view(spark, sf, "url_rules_v").select("ord", "pattern", F.split("header_list", " ").alias("headers"))
    return C.match_url_rules(distinct_names(spark, sf), rules)


# ------------------------------------------------------------------ evidence

MAP_VIEWS = with_views("names_v", "header_map_v", "function_map_v")
MAP_CTE = """, ex as (
  select header, ord, sub, 0 as top, case sub when 0 then lower(function) when 1 then function
    when 2 then lower(function) || 'a' when 3 then lower(function) || 'w' when 4 then function || 'A'
    when 5 then function || 'W' when 6 then lower(function) || 'ex' else function || 'Ex' end as key
  from header_map_v, (select unnest(range(8)) as sub)
  union all select header, 0, 0, 1, function from function_map_v)
, km as (select key, arg_max(header, top * 1000000000 + ord * 10 + sub) as header from ex group by key)
"""


def key_map(spark, sf):
    return E.expand_map(view(spark, sf, "header_map_v"), view(spark, sf, "function_map_v"))


@query("n4_expand_map", MAP_VIEWS + MAP_CTE + "select key, header from km")
def n4(spark, sf):
    return key_map(spark, sf)


EVIDENCE_CTE = (", d as (select distinct symbol, lower(symbol) as low from names_v)\n" + MODULE_CTE + MAP_CTE + """
, hits as (
  select symbol, dll, 0 as ord, 'exact' as source, header, 0.95::double as score from m join km on key = low
  union all select symbol, dll, 1, 'aw_base', header, 0.90 from m join km on key = low[:-2]
    where regexp_matches(low, '[aw]\\z')
  union all select symbol, dll, 2, 'ex_base', header, 0.85 from m join km on key = low[:-3]
    where regexp_matches(low, 'ex\\z'))
, fb as (select symbol, dll, case
    when regexp_matches(symbol, '^(Nt|Zw)') then [('winternl', 0.80), ('ntddk', 0.70)]
    when regexp_matches(symbol, '^(Rtl|Ldr)') then [('winternl', 0.75)]
""" + "".join(f"    when regexp_matches(low, '{'|'.join(w.split())}') then [('{h}', {s})]\n"
              for w, h, s in dims.FALLBACK_EVIDENCE) + """
    else [('winbase', 0.40)] end as rows from m where symbol not in (select symbol from hits))
, ev as (select * from hits
  union all select symbol, dll, i::int - 1, 'pattern', rows[i][1], rows[i][2]::double
    from (select *, unnest(range(1, len(rows) + 1)) as i from fb)
  union all select symbol, dll, 9, 'module', header, 0.10 from (select symbol, dll, case
""" + "".join(f"    when contains(dll, '{p}') then '{h}'\n" for p, h in dims.MODULE_BONUS) + """
    end as header from m) where header is not null)
""")


def evidence(spark, sf):
    return E.header_evidence(with_module(spark, sf), key_map(spark, sf))


@query("j3_header_evidence", MAP_VIEWS + EVIDENCE_CTE + "select symbol, dll, ord, source, header, score from ev")
def j3(spark, sf):
    return evidence(spark, sf)


for _name, _source in [("j4_aw_base", "aw_base"), ("j5_ex_base", "ex_base"), ("j6_pattern_fallback", "pattern"),
                       ("j7_module_bonus", "module")]:
    @query(_name, MAP_VIEWS + EVIDENCE_CTE + f"select symbol, ord, header, score from ev where source = '{_source}'")
    def _evidence_part(spark, sf, source=_source):
        return evidence(spark, sf).filter(F.col("source") == source).select("symbol", "ord", "header", "score")


SCORED_CTE = """, sc as (select symbol, dll, header, round(sum(score), 6) as score, min(ord) as ord from ev group by all)
, rk as (select *, row_number() over (partition by symbol order by score desc, ord) as rank from sc)
"""


@query("g7_score_sum", MAP_VIEWS + EVIDENCE_CTE + SCORED_CTE + "select symbol, header, score from sc")
def g7(spark, sf):
    return E.score_headers(evidence(spark, sf)).select("symbol", "header", "score")


@query("f2_top_headers", MAP_VIEWS + EVIDENCE_CTE + SCORED_CTE +
       "select symbol, dll, header, score, rank from rk where rank <= 2")
def f2(spark, sf):
    return E.top_headers(evidence(spark, sf), 2)


@query("f3_best_header", MAP_VIEWS + EVIDENCE_CTE + SCORED_CTE +
       "select symbol, dll, header, score from rk where rank = 1 and score > 0.3")
def f3(spark, sf):
    return E.best_header(evidence(spark, sf))


TEMPLATE_SQL = "replace(replace(case when h in ('winternl') then '{native}' when h in ('ntddk', 'wdm') then '{driver}' " \
    "when h = 'shlobj' then '{shell}' when h in ('mmsystem', 'vfw', 'mfapi') then '{multimedia}' " \
    "when h = 'gl' then '{opengl}' else '{standard}' end, '{{header}}', h), '{{function}}', lower(symbol))"
TEMPLATE_SQL = TEMPLATE_SQL.format(**{k: v for k, v in dims.URL_TEMPLATES.items()})


@query("f12_url_template", MAP_VIEWS + EVIDENCE_CTE + SCORED_CTE +
       f"select symbol, h as header, {TEMPLATE_SQL} as url from (select symbol, header as h from rk where rank = 1)")
def f12(spark, sf):
    return C.predicted_urls(E.best_header(evidence(spark, sf))).select("symbol", "header", "url")


@query("g3_map_statistics", MAP_VIEWS + MAP_CTE + """
select (select count(distinct header) from header_map_v) as mapped_headers,
  (select count(*) from km) as mapped_functions, 9::bigint as url_patterns""")
def g3(spark, sf):
    return E.map_statistics(view(spark, sf, "header_map_v"), key_map(spark, sf))


@query("g8_last_and_first_write", with_views("header_map_v") + """
select function, arg_max(header, ord) as last_header, arg_min(header, ord) as first_header,
  count(*) as writes from header_map_v group by function""")
def g8(spark, sf):
    return E.writes(view(spark, sf, "header_map_v"), "function", "header")


# ------------------------------------------------------------------ candidates

RULE_VALUES = values([(o, s, k, i, h) for o, s, k, hs in dims.header_rules() for i, h in enumerate(hs)],
                     "r(ord, shape, literal, header_ord, header)") + ")"
RULES_CTE = f""", j8 as (select symbol, ord, header_ord, header from d join {RULE_VALUES} on case shape
  when 'exact' then low = literal when 'prefix' then starts_with(low, literal)
  when 'contains' then contains(low, literal) else regexp_matches(low, '^(?:' || literal || ')') end)
"""
MODULE_HEADER_VALUES = values(dims.module_headers(), "mh(dll, ord, header)") + ")"
PRIMARY_VALUES = values(list(dims.PRIMARY_HEADER.items()), "p(dll, header)") + ")"
J9_CTE = f""", j9 as (select symbol, m.dll, ord, header from m join {MODULE_HEADER_VALUES} mh on m.dll = mh.dll
  union all select symbol, m.dll, -1, header from m join {PRIMARY_VALUES} p on m.dll = p.dll)
"""
HEADERS_CTE = RULES_CTE + J9_CTE + f""", tiers as (
  select symbol, 0 as tier, 0 as a, 0 as b, header from j9 where ord = -1
  union all select symbol, 1, ord, header_ord, header from j8
  union all select symbol, 2, ord, 0, header from j9 where ord >= 0
  union all select symbol, 3, i, 0, header from d, {values(list(enumerate(dims.COMMON_HEADERS)), 'c(i, header)')}))
, f4 as (select symbol, header, row_number() over (partition by symbol order by pos) as rank from (
  select symbol, header, min(tier * 1000000 + a * 1000 + b) as pos from tiers group by all))
"""
BASE = C.BASE_US
URLS_CTE = f""", f5 as (
  select symbol, 1000 + rank * 10 + i as pos, '{BASE}/windows/win32/api/' || header || '/nf-' || header || '-' || n as url
  from (select f4.symbol, rank, header, unnest(v) as n, unnest(range(len(v))) as i from f4 join (
    select symbol, case when regexp_matches(low, '[aw]\\z') then [low, low[:-2]] else [low, low || 'a', low || 'w'] end as v
    from d) using (symbol)))
, f6 as (select symbol, 500 as pos, '{dims.LEGACY_DOWNLOAD_URL}' as url from d where low = 'urldownloadtofile'
  union all select symbol, 500, '{BASE}/windows/win32/api/wininet/nf-wininet-ftpputfilea' from d where low = 'ftpputfile')
, nat as (select symbol, low, case when regexp_matches(low, '^(nt|zw)') then ['nt' || low[3:], 'zw' || low[3:]] else [low] end as v
  from d where regexp_matches(low, '^(nt|zw|rtl|ke|mm)'))
, f7 as (select symbol, vi * 5 + hi as pos, '{BASE}/windows-hardware/drivers/ddi/' || h || '/nf-' || h || '-' || n as url
  from (select symbol, unnest(v) as n, unnest(range(len(v))) as vi from nat),
       {values([(0, 'ntdef'), (1, 'winternl'), (2, 'ntddk'), (3, 'ntifs'), (4, 'wdm')], 'h(hi, h)')})
  union all select symbol, 900000 + len(v) - vi, '{BASE}/windows/win32/api/winternl/nf-winternl-' || n
  from (select symbol, v, unnest(v) as n, unnest(range(len(v))) as vi from nat))
, cand as (select symbol, url, row_number() over (partition by symbol order by pos) as rank from (
  select symbol, url, min(pos) as pos from (select * from f5 union all select * from f6 union all select * from f7)
  group by all))
"""


@query("j8_header_rules", DISTINCT_NAMES + RULES_CTE + "select symbol, ord, header_ord, header from j8")
def j8(spark, sf):
    return C.match_url_rules(distinct_names(spark, sf))


@query("j9_module_headers", DISTINCT_NAMES + MODULE_CTE + J9_CTE + "select symbol, dll, ord, header from j9")
def j9(spark, sf):
    return C.module_candidates(with_module(spark, sf))


@query("x1_candidate_union", DISTINCT_NAMES + MODULE_CTE + HEADERS_CTE + """
select header, count(*) as rows, count(distinct symbol) as symbols from (
  select symbol, header from j8 union all select symbol, header from j9) group by header""")
def x1(spark, sf):
    rules = C.match_url_rules(distinct_names(spark, sf)).select("symbol", "header")
    return rules.unionByName(C.module_candidates(with_module(spark, sf)).select("symbol", "header")).groupBy(
        "header").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("symbol").alias("symbols"))


@query("f4_header_candidates", DISTINCT_NAMES + MODULE_CTE + HEADERS_CTE + "select symbol, rank, header from f4")
def f4(spark, sf):
    return C.header_candidates(with_module(spark, sf)).select("symbol", "rank", "header")


CAND_SQL = DISTINCT_NAMES + MODULE_CTE + HEADERS_CTE + URLS_CTE


@query("f5_url_candidates", CAND_SQL + "select symbol, rank, url from cand")
def f5(spark, sf):
    return C.url_candidates(with_module(spark, sf)).select("symbol", "rank", "url")


@query("t11_start_schedule", CAND_SQL + "select symbol, url, round((rank - 1) * 0.1, 6)::double as start_after from cand")
def start_schedule(spark, sf):
    return G.start_schedule(C.url_candidates(with_module(spark, sf))).select("symbol", "url", "start_after")


@query("f6_legacy_urls", CAND_SQL + "select symbol, rank, url from cand where symbol in (select symbol from f6)")
def f6(spark, sf):
    keep = F.lower("symbol").isin("urldownloadtofile", "ftpputfile")
    return C.url_candidates(with_module(spark, sf).filter(keep)).select("symbol", "rank", "url")


@query("f7_native_urls", CAND_SQL + "select symbol, rank, url from cand where symbol in (select symbol from nat)")
def f7(spark, sf):
    keep = F.lower("symbol").rlike("^(nt|zw|rtl|ke|mm)")
    return C.url_candidates(with_module(spark, sf).filter(keep)).select("symbol", "rank", "url")


@query("f8_dedupe_ranked", with_views("search_results_v") + """
select symbol, url, row_number() over (partition by symbol order by r, url) as rank from (
  select symbol, url, min(rank) as r from (
    select symbol, split_part(url, '-', 1) as url, rank * 100000 + length(url) as rank from search_results_v)
  group by all) qualify rank > 0""")
def f8(spark, sf):
    ranked = view(spark, sf, "search_results_v").select(
        "symbol", F.substring_index("url", "-", 1).alias("url"),
        (F.col("rank") * 100000 + F.length("url")).alias("rank"))
    return C.dedupe_ranked(ranked, ["symbol"], "url")


@query("x2_ordered_union", CAND_SQL + """
, u as (select symbol, url, rank from cand union all
  select symbol, 'https://learn.microsoft.com/en-us/windows/win32/api/winbase/nf-winbase-' || low, 5 from d)
select symbol, url, dense_rank() over (partition by symbol order by r, url) as rank
from (select symbol, url, min(rank) * 2 as r from u group by all)""")
def x2(spark, sf):
    cands = C.url_candidates(with_module(spark, sf)).select("symbol", "url", (F.col("rank") * 2).alias("rank"))
    extra = distinct_names(spark, sf).select(
        "symbol", N.win32_url(F.lit(BASE), F.lit("winbase"), F.lower("symbol")).alias("url"), F.lit(10).alias("rank"))
    return C.dedupe_ranked(cands.unionByName(extra), ["symbol"], "url")


VALID_SQL = ", v as (select c.*, m.dll, hash_ok as valid from (select *, (length(url) * 7 + rank * 3) % 11 = 0 as hash_ok from cand) c join m using (symbol))\n"


def flagged(spark, sf):
    return C.url_candidates(with_module(spark, sf)).withColumn(
        "valid", (F.length("url") * 7 + F.col("rank") * 3) % 11 == 0)


@query("f9_probe_budget", CAND_SQL + VALID_SQL + """
, t as (select *, bool_or(valid and rank <= 12) over (partition by symbol) as hit from v)
select symbol, rank, url, case when rank <= 12 then 1 else 2 end as tier from t
where rank <= 12 or (not hit and (dll is not null or
  regexp_matches(lower(symbol), '^(create|get|set|open|close|read|write|nt|zw)')))""")
def f9(spark, sf):
    return C.probe_budget(flagged(spark, sf)).select("symbol", "rank", "url", "tier")


@query("f9_probe_budget_limits", CAND_SQL.replace("min(tier * 1000000 + a * 1000 + b) as pos from tiers group by all))", "min(tier * 1000000 + a * 1000 + b) as pos from tiers group by all) qualify rank <= 8)") + VALID_SQL + """
, t as (select *, bool_or(valid and rank <= 12) over (partition by symbol) as hit from v)
select symbol, rank, url, case when rank <= 12 then 1 else 2 end as tier from t
where rank <= 12 or (rank <= 25 and not hit and (dll is not null or
  regexp_matches(lower(symbol), '^(create|get|set|open|close|read|write|nt|zw)')))""")
def f9_limits(spark, sf):
    """With the original's limits: 8 headers, 25 ranks."""
    cands = C.url_candidates(with_module(spark, sf), most=8).withColumn("valid", (F.length("url") * 7 + F.col("rank") * 3) % 11 == 0)
    return C.probe_budget(cands, total=25).select("symbol", "rank", "url", "tier")


@query("f10_first_valid", CAND_SQL + VALID_SQL +
       "select symbol, arg_min(url, rank) as url, min(rank) as rank from v where valid group by symbol")
def f10(spark, sf):
    return C.first_valid(flagged(spark, sf))


@query("w5_ranking", with_views("search_results_v") + """
select symbol, url, rank, row_number() over w as rn, dense_rank() over (partition by symbol order by rank) as dr
from search_results_v window w as (partition by symbol order by rank, url, title)
qualify row_number() over w <= 3""")
def w5(spark, sf):
    rows = view(spark, sf, "search_results_v").select("symbol", "url", "rank", "title")
    return C.ranked(rows, ["symbol"], ["rank", "url", "title"], 3).drop("title")


# ------------------------------------------------------------------ lookups


@query("j10_catalog_lookup", with_views("names_v", "catalog_v") + r"""
, d as (select distinct symbol, lower(symbol) as low from names_v)
, k as (select symbol, 0 as prio, low as key from d union all select symbol, 1, low || 'a' from d
  union all select symbol, 2, low || 'w' from d
  union all select symbol, 3, low[:-2] from d where regexp_matches(low, '[aw]\z'))
select symbol, arg_min(struct_pack(ord, name, url, language), pr).ord as ord,
  arg_min(name, pr) as name, arg_min(url, pr) as url, arg_min(language, pr) as language
from (select k.symbol, c.*, (prio * 10 + case when language = 'en-us' then 0 else 1 end) * 10000000 + ord as pr
  from k join catalog_v c on lower(c.name) = key
  where type in ('function', 'macro') and (language = 'en-us' or prio = 0)) group by symbol""")
def j10(spark, sf):
    return L.lookup_catalog(view(spark, sf, "names_v"), view(spark, sf, "catalog_v"), "en-us")


@query("j11_direct_url", with_views("names_v", "function_map_v") + f"""
select symbol, arg_min(function, prio) as function, arg_min('{BASE}/windows/win32/api/' || header || '/nf-' || header
  || '-' || lower(function), prio) as url
from (select symbol, i as prio, symbol || s as ask from (select distinct symbol from names_v),
  {values([(0, ''), (1, 'W'), (2, 'A')], 's(i, s)')})) join function_map_v on function = ask group by symbol""")
def j11(spark, sf):
    return L.direct_url(view(spark, sf, "names_v"), view(spark, sf, "function_map_v"), BASE)


def _any(words):
    return " or ".join(f"contains(url, '{w}')" for w in words)


HIT_CTE = f""", hit as (select symbol, min(row(pass, rank, url)) as m from (
  select *, case when {_any(dims.HIT_PATHS)} then 1 when {_any(dims.BROAD_PATHS)} then 2 end as pass
  from search_results_v where contains(lower(title), lower(symbol))) where pass is not null group by symbol)
"""


@query("j12_search_hit", with_views("search_results_v") + HIT_CTE +
       "select symbol, m[1] as pass, m[2] as rank, m[3] as url from hit")
def j12(spark, sf):
    return L.pick_search_hit(view(spark, sf, "search_results_v"))


@query("j18_labels", with_views("names_v") + f"""
, k as (select sym_id, case sym_id % 3 when 0 then 'us' when 1 then 'br' else 'fr' end as lang,
  case sym_id % 4 when 0 then 'parameters' when 1 then 'members' when 2 then 'dll' else 'nope' end as key from names_v)
select sym_id, lang, key, coalesce(label, key) as label from k left join
{values(dims.label_rows(dims.RECORD_LABELS), 'l(label_lang, label_key, label)')})
on label_lang = case when lang = 'br' then 'br' else 'us' end and label_key = key""")
def j18(spark, sf):
    keys = view(spark, sf, "names_v").selectExpr(
        "sym_id", "case sym_id % 3 when 0 then 'us' when 1 then 'br' else 'fr' end as lang",
        "case sym_id % 4 when 0 then 'parameters' when 1 then 'members' when 2 then 'dll' else 'nope' end as key")
    return L.localise(keys, "lang", "key", dims.RECORD_LABELS)


@query("x4_both_languages", with_views("catalog_v") + """
select lower(description) as name from catalog_v where language = 'en-us'
intersect select lower(description) from catalog_v where language = 'pt-br'""")
def x4(spark, sf):
    return L.in_both_languages(view(spark, sf, "catalog_v"), "description")
