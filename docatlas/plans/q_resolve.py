"""Queries that resolve symbols to crawled pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from docatlas import dims
from docatlas.functions import names as N
from docatlas.operators import candidates as C
from docatlas.operators import evidence as E
from docatlas.operators import records as R
from docatlas.operators import resolve as X
from docatlas.operators import symbols as S
from docatlas.plans import q_symbols as Q
from docatlas.plans.registry import query, values
from docatlas.plans.views import spark_view as view
from docatlas.plans.views import with_views

VIEWS = with_views("names_v", "header_map_v", "function_map_v", "catalog_v", "crawl_v")
VALID = "regexp_full_match(symbol, '[A-Za-z0-9_\\-]+')"
DENY = ", ".join(f"'{d}'" for d in dims.UNDOCUMENTED)


def resolve_sql(lang: str) -> str:
    """Oracle of the waterfall; attempts are keyed ``name|module``."""
    base = C.base_url(lang)
    want = "en-us" if lang == "us" else "pt-br"
    first = Q.MODULE_CTE.replace("from d join", "from d0 join").replace("from d left join j1", "from d0 d left join j1o j1")
    first = first.replace("j1 as (", "j1o as (").replace("m as (", "m0 as (").replace("d.symbol, d.low", "d.symbol, d.low")
    evidence = Q.EVIDENCE_CTE.split(Q.MODULE_CTE)[1]
    overrides = values([(k, u, t) for k, _, u, _, t in S.override_rows()], "ov(key, ourl, needs)") + ")"
    return VIEWS + f"""
, d0 as (select distinct symbol, lower(symbol) as low from names_v where {VALID})
{first}
, lv as (select symbol, dll, unnest(range(least(length(regexp_extract(symbol, '([AW]*)\\z', 1)), length(symbol) - 1) + 1)) as level from m0)
, at0 as (select symbol, dll, level, left(symbol, length(symbol) - level::int) as attempt from lv)
, tries as (select * from at0 a where not exists (select 1 from at0 b where b.symbol = a.symbol and b.level <= a.level
  and lower(b.attempt) in ({DENY})))
, asks as (select symbol as origin, level, attempt, attempt as asked, dll, 2 as step, 0 as off from tries
  union all select symbol, level, attempt, attempt || 'A', dll, 6, 0 from tries where not regexp_matches(attempt, '[AW]\\z')
  union all select symbol, level, attempt, attempt || 'W', dll, 6, 1000000 from tries where not regexp_matches(attempt, '[AW]\\z'))
, m as (select distinct asked || '|' || coalesce(dll, '') as symbol, lower(asked) as low, dll from asks)
, d as (select symbol, low from m)
{evidence}{Q.SCORED_CTE}{Q.HEADERS_CTE}{Q.URLS_CTE.replace(C.BASE_US + "/windows", base + "/windows")}
{Q.HIT_CTE}
, ck as (select attempt, 0 as prio, lower(attempt) as key from tries union all select attempt, 1, lower(attempt) || 'a' from tries
  union all select attempt, 2, lower(attempt) || 'w' from tries
  union all select attempt, 3, lower(attempt)[:-2] from tries where regexp_matches(lower(attempt), '[aw]\\z'))
, cat as (select attempt, arg_min(url, (prio * 10 + case when language = '{want}' then 0 else 1 end) * 10000000 + ord) as url
  from ck join catalog_v c on lower(c.name) = key where type in ('function', 'macro') and (language = '{want}' or prio = 0)
  group by attempt)
, dir as (select attempt, arg_min('{base}/windows/win32/api/' || header || '/nf-' || header || '-' || lower(function), i) as url
  from (select attempt, i, attempt || s as ask from (select distinct attempt from tries),
  {values([(0, ''), (1, 'W'), (2, 'A')], 's(i, s)')})) join function_map_v on function = ask group by attempt)
, pred as (select symbol, {"replace(" if lang == "br" else ""}{Q.TEMPLATE_SQL.replace("lower(symbol)", "split_part(lower(symbol), '|', 1)")}{", '/en-us/', '/pt-br/')" if lang == "br" else ""} as url
  from (select symbol, header as h from rk where rank = 1 and score > 0.3))
, cs as (
  select origin, level, attempt, step, rank + off as rank, url, true as needs from asks join cand on cand.symbol = asked || '|' || coalesce(dll, '')
    where rank <= 12 or ((dll is not null or regexp_matches(lower(asked), '^(create|get|set|open|close|read|write|nt|zw)')))
  union all select t.symbol, level, attempt, 1, 1, hit.m[3], true from tries t join hit on hit.symbol = attempt
  union all select t.symbol, level, attempt, 3, 1, url, true from tries t join pred on pred.symbol = attempt || '|' || coalesce(dll, '')
  union all select t.symbol, level, t.attempt, 4, 1, url, true from tries t join cat on cat.attempt = t.attempt
  union all select t.symbol, level, t.attempt, 5, 1, url, true from tries t join dir on dir.attempt = t.attempt
  union all select symbol, level, attempt, 0, 1, ourl, needs from tries join {overrides} on key = lower(attempt))
, tw as (select *, 0 as twin, url as page_url from cs union all
  select *, 1, replace(url, 'learn.microsoft.com/pt-br', 'learn.microsoft.com/en-us') from cs where contains(url, 'pt-br'))
, pk as (select url as page_url, min(page_id) as page_id from crawl_v group by url)
, hits2 as (select tw.*, page_id from tw left join pk using (page_url) where page_id is not null or not needs)
, best as (select origin as symbol, arg_min((level, step, attempt, page_url, case when needs then page_id end),
  (level, step, rank, twin)) as b from hits2 group by origin)
, resolved as (select d0.symbol, b is not null as found, b[1] as level, b[2] as step, b[3] as attempt, b[4] as url, b[5] as page_id
  from d0 left join best using (symbol))
"""


def valid_names(spark, sf):
    ok, _ = S.read_symbols(view(spark, sf, "names_v").select("symbol"))
    return ok


def resolved(spark, sf, lang="us"):
    return X.resolve(valid_names(spark, sf), view(spark, sf, "search_results_v"), Q.key_map(spark, sf),
                     view(spark, sf, "function_map_v"), view(spark, sf, "catalog_v"), view(spark, sf, "crawl_v"), lang)


def flat(df):
    """No null integers in a result that is compared by value."""
    return df.select("symbol", "found", F.coalesce("level", F.lit(-1)).alias("level"), F.coalesce("step", F.lit(-1)).alias("step"),
                     "attempt", "url", F.coalesce("page_id", F.lit(-1)).alias("page_id"))


FLAT_SQL = "select symbol, found, coalesce(level, -1) as level, coalesce(step, -1) as step, attempt, url, coalesce(page_id, -1) as page_id from resolved"


@query("f11_resolve", resolve_sql("us") + FLAT_SQL)
def f11(spark, sf):
    return flat(resolved(spark, sf))


@query("j14_language_fallback", resolve_sql("br") + FLAT_SQL)
def j14(spark, sf):
    return flat(resolved(spark, sf, "br"))


@query("j16_suffix_retry", resolve_sql("us") + "select symbol, attempt, url from resolved where level > 0 or step = 6")
def j16(spark, sf):
    return resolved(spark, sf).filter("level > 0 or step = 6").select("symbol", "attempt", "url")


@query("j15_coverage", resolve_sql("us") + f"""
select n.sym_id, n.symbol, found as documented from names_v n join resolved r on n.symbol = r.symbol""")
def j15(spark, sf):
    names = view(spark, sf, "names_v").filter(N.valid_symbol("symbol"))
    return X.coverage(names, resolved(spark, sf)).select("sym_id", "symbol", "documented")


@query("x3_not_found_records", resolve_sql("us") + f"""
select symbol, symbol as name, {Q.KIND_SQL.format('symbol')} as symbol_type, false as documentation_found,
  'Function ''' || symbol || ''' not found in Microsoft documentation' as error from resolved where not found""")
def x3(spark, sf):
    missing = X.not_found(valid_names(spark, sf), resolved(spark, sf))
    return R.not_found_records(missing).select("symbol", "name", "symbol_type", "documentation_found", "error")


@query("g4_coverage_report", resolve_sql("us") + f"""
, k as (select {Q.KIND_SQL.format('symbol')} as kind, coalesce(step, -1) as step, case when not found then 'none' when contains(url, 'en-us') then 'en-us' else 'pt-br' end as language,
  coalesce(nullif(regexp_extract(url, '/(?:api|ddi)/([^/]+)/', 1), ''), 'none') as header, found from resolved)
select coalesce(kind, '*') as kind, coalesce(step, -9) as step, coalesce(language, '*') as language, coalesce(header, '*') as header,
  grouping_id(kind, step, language, header)::int as grouping, count(*) as symbols, count_if(found)::bigint as found, round(avg(found::int::double), 6) as rate
from k group by grouping sets ((kind, step), (kind), (step), (language), (language, header), (header), ())""")
def g4(spark, sf):
    return X.coverage_report(resolved(spark, sf))


@query("j13_resolved_candidates", Q.CAND_SQL.replace(with_views("names_v"), with_views("names_v", "crawl_v"), 1) + """
select symbol, rank, cand.url, pk.page_id from cand join
  (select url, min(page_id) as page_id from crawl_v group by url) pk on cand.url = pk.url""")
def j13(spark, sf):
    cands = C.url_candidates(Q.with_module(spark, sf))
    return X.resolve_pages(cands, view(spark, sf, "crawl_v")).select("symbol", "rank", "url", "page_id")


@query("n3_literal_record", with_views("names_v") + """
select symbol, 'memcpy' as name, '__cdecl' as calling_convention, 3 as parameter_count, count(*) as n
from names_v where lower(symbol) = 'memcpy' group by symbol""")
def n3_record(spark, sf):
    return R.memcpy_record(view(spark, sf, "names_v")).groupBy(
        "symbol", "name", "calling_convention", "parameter_count").agg(F.count(F.lit(1)).alias("n"))
