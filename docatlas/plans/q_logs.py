"""Queries on fetch, probe and call logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from docatlas import dims
from docatlas.operators import calls as K
from docatlas.operators import logs as G
from docatlas.operators import lookups as L
from docatlas.operators import resolve as X
from docatlas.operators import records as R
from docatlas.plans.registry import query, values
from docatlas.plans.views import spark_view as view
from docatlas.plans.views import with_views

PROBE, FETCH, CALLS = with_views("probe_log_v"), with_views("fetch_log_v"), with_views("call_log_v")


def probes(spark, sf):
    return view(spark, sf, "probe_log_v")


def fetches(spark, sf):
    return view(spark, sf, "fetch_log_v")


@query("s7_probe_log", PROBE + """
select event_id, host, sha256(url) as url_key, epoch_us(ts) as us, status, content_type, agent, latency from probe_log_v""")
def s7(spark, sf):
    return G.read_probe_log(probes(spark, sf)).select(
        "event_id", "host", "url_key", F.unix_micros("ts").alias("us"), "status", "content_type", "agent", "latency")


@query("f1_valid_pages_head", PROBE + """
select event_id from probe_log_v where status = 200 and contains(lower(content_type), 'html')
  and regexp_matches(lower(body_head[1:20]), 'function|syntax|parameters|api')""")
def f1_head(spark, sf):
    """With a limit in bytes (the rows are ASCII)."""
    return X.valid_pages(probes(spark, sf), "fast", 20).select("event_id")


@query("f1_valid_pages", PROBE + """
, fast as (select event_id from probe_log_v where status = 200 and contains(lower(content_type), 'html')
  and regexp_matches(lower(body_head), 'function|syntax|parameters|api'))
, slow as (select event_id from probe_log_v where status = 200 and regexp_matches(lower(body_head), 'function|routine|api|syntax|parameters'))
select event_id, 'fast' as mode from fast union all select event_id, 'slow' from slow""")
def f1(spark, sf):
    log = probes(spark, sf)
    return X.valid_pages(log, "fast").select("event_id", F.lit("fast").alias("mode")).unionByName(
        X.valid_pages(log, "slow").select("event_id", F.lit("slow").alias("mode")))


RUNS = """, a as (select *, sum((status = 200)::int) over (partition by {key} order by ts, event_id rows between unbounded preceding and 1 preceding) as g,
  row_number() over (partition by {key} order by ts, event_id) as rn, lag(epoch_us(ts)) over (partition by {key} order by ts, event_id) as prev_us from {log})
, r as (select *, row_number() over (partition by {key}, coalesce(g, 0) order by ts, event_id) - 1
  - case when coalesce(g, 0) > 0 then 0 else 0 end as run_before from a)
, runs as (select *, case when status = 200 then 0 else run_before + 1 end as run from r)
"""


@query("w6_failure_runs", PROBE + RUNS.format(key="agent", log="probe_log_v") + """
select agent, max(run) as longest, count_if(run >= 3)::bigint as rotations from runs group by agent""")
def w6(spark, sf):
    return G.failure_runs(probes(spark, sf))


@query("w7_rotation_groups", PROBE + """
select event_id, agent, (row_number() over (partition by agent order by ts, event_id) - 1) // 5 as rotation from probe_log_v""")
def w7(spark, sf):
    return G.rotation_groups(probes(spark, sf))


@query("t5_agent_states", PROBE + RUNS.format(key="agent", log="probe_log_v") + """
select event_id, agent, (rn - 1) // 5 as rotation, run, rn % 5 = 0 or run >= 3 as rotate from runs""")
def t5(spark, sf):
    return G.agent_states(probes(spark, sf))


@query("g5_agent_rates", PROBE + """
select agent, count(*) as requests, count_if(status = 200)::bigint as successes, epoch_us(max(ts)) as last_used,
  round(count_if(status = 200) / count(*), 6) as rate from probe_log_v group by agent
union all select 'unseen', 0, 0, 0, 0.5""")
def g5(spark, sf):
    log = probes(spark, sf)
    agents = log.select("agent").distinct().unionByName(spark.createDataFrame([("unseen",)], "agent string"))
    return G.rates_of(agents, log).select(
        "agent", F.coalesce("requests", F.lit(0)).alias("requests"), F.coalesce("successes", F.lit(0)).alias("successes"),
        F.coalesce(F.unix_micros("last_used"), F.lit(0)).alias("last_used"), "rate")


@query("g6_top_agents", PROBE + """
select agent, round(count_if(status = 200) / count(*), 6) as rate from probe_log_v group by agent
order by rate desc, min(ts), agent limit 3""")
def g6(spark, sf):
    return G.top_agents(probes(spark, sf)).select("agent", "rate")


@query("t1_latest_snapshot", FETCH + """
select url, arg_max(body, ts) filter (status = 200 and body is not null) as body, arg_max(status, ts) as last_status,
  epoch_us(max(ts)) as last_us, count(*) as fetches from fetch_log_v group by url""")
def t1(spark, sf):
    return G.latest_snapshot(fetches(spark, sf)).select(
        "url", "body", "last_status", F.unix_micros("last_ts").alias("last_us"), "fetches")


@query("t2_freshness", FETCH + """
select url, coalesce(epoch_us(timestamp '2024-01-29 12:00:00') - epoch_us(max(ts) filter (status = 200)) < 7200 * 1000000::bigint, false) as fresh
from fetch_log_v group by url""")
def t2(spark, sf):
    now = F.to_timestamp(F.lit("2024-01-29 12:00:00"))
    return G.freshness(fetches(spark, sf), now, G.USED_TTL).select("url", "fresh")


@query("t3_revalidation", FETCH + """
select url, arg_max(coalesce(etag, ''), ts) filter (status = 200) as etag, arg_max(coalesce(last_modified, ''), ts) filter (status = 200) as last_modified,
  arg_max(etag, ts) filter (etag is not null) as last_etag, arg_max(last_modified, ts) filter (last_modified is not null) as last_last_modified
from fetch_log_v group by url""")
def t3(spark, sf):
    return G.revalidation(fetches(spark, sf))


@query("t11_retry_schedule", FETCH + RUNS.format(key="url", log="fetch_log_v") + """
, d as (select event_id, url, run_before as attempt, least(0.1 * pow(1.5, run_before - 1), 2.0) as delay,
  (epoch_us(ts) - prev_us) / 1000000.0 as gap from runs where run_before > 0)
select event_id, url, attempt, round(delay, 6) as delay, round(gap, 6) as gap, gap > delay as late from d""")
def t11(spark, sf):
    return G.retry_schedule(fetches(spark, sf))


@query("t11_fetch_schedule", FETCH + RUNS.format(key="url", log="fetch_log_v") + """
select event_id, url, ((run_before - 1) % 2)::int as tried, case when run_before % 2 = 1 then 1.0 else 2.0 end::double as delay,
  run_before % 2 = 0 as gave_up, prev_us + case when run_before % 2 = 1 then 1000000 else 2000000 end as due_us from runs where run_before > 0""")
def t11_fetch(spark, sf):
    return G.fetch_schedule(fetches(spark, sf))


AS_OF = FETCH + """, w as (select *,
  last_value(case when status = 200 then {'us': epoch_us(ts), 'e': coalesce(etag, ''), 'm': coalesce(last_modified, '')} end ignore nulls) over b as c,
  last_value(etag ignore nulls) over b as last_etag, last_value(last_modified ignore nulls) over b as last_last_modified
  from fetch_log_v window b as (partition by url order by ts, event_id rows between unbounded preceding and 1 preceding))
"""


@query("t2_freshness_per_request", AS_OF + """
select event_id, url, coalesce(c.us, -1) as cached_us, coalesce(epoch_us(ts) - c.us < 7200 * 1000000::bigint, false) as fresh from w""")
def t2_requests(spark, sf):
    return G.per_request(fetches(spark, sf), G.USED_TTL).select("event_id", "url", F.coalesce("cached_us", F.lit(-1)).alias("cached_us"), "fresh")


@query("t3_validators_per_request", AS_OF + "select event_id, url, c.e as etag, c.m as last_modified, last_etag, last_last_modified from w")
def t3_requests(spark, sf):
    return G.per_request(fetches(spark, sf)).select("event_id", "url", "etag", "last_modified", "last_etag", "last_last_modified")


@query("t6_tumbling_windows", PROBE + """
select host, epoch_us(time_bucket(interval 1 hour, ts)) as start_us, count(*) as requests, count_if(status >= 500)::bigint as failures,
  sum(case when status >= 500 then 1.0 when status = 429 then 0.5 else 0.0 end)::double as weighted from probe_log_v group by 1, 2""")
def t6(spark, sf):
    return G.outcome_windows(probes(spark, sf), "1 hour").select(
        "host", F.unix_micros("start").alias("start_us"), "requests", "failures", "weighted")


@query("t6_sliding_windows", PROBE + """
select host, epoch_us(time_bucket(interval 1 hour, ts) - o * interval 1 hour) as start_us, count(*) as requests, count_if(status >= 500)::bigint as failures,
  sum(case when status >= 500 then 1.0 when status = 429 then 0.5 else 0.0 end)::double as weighted
from probe_log_v, (select unnest([0, 1]) as o) group by 1, 2""")
def t6_sliding(spark, sf):
    return G.outcome_windows(probes(spark, sf), "2 hours", "1 hour").select(
        "host", F.unix_micros("start").alias("start_us"), "requests", "failures", "weighted")


@query("t7_client_sessions", PROBE + """
, a as (select *, lag(ts) over (partition by agent order by ts) as p from probe_log_v)
, b as (select *, sum((p is null or ts - p > interval 600 seconds)::int) over (partition by agent order by ts) as sid from a)
select agent, epoch_us(min(ts)) as start_us, epoch_us(max(ts)) as last_us, count(*) as requests from b group by agent, sid""")
def t7(spark, sf):
    return G.client_sessions(probes(spark, sf)).select(
        "agent", F.unix_micros("start").alias("start_us"), F.unix_micros("last_ts").alias("last_us"), "requests")


HEALTH_SQL = """with recursive e as (select concat('host', user_id % 10) as host, event_id, epoch_us(ts) as us,
  case when event_type in ('error', 'view', 'click') then 500 when event_type = 'signup' then 429 else 200 end as status,
  row_number() over (partition by user_id % 10 order by ts, event_id) as rn from events)
, f as (select distinct host, 0::bigint as rn, 0::bigint as event_id, 0::bigint as us, 'CLOSED' as before, 'CLOSED' as mid, 'CLOSED' as state,
    0.0::double as cnt, 1 as need, 0::bigint as failed from e
  union all
  select host, rn, event_id, us, before, mid,
    case when mid = 'OPEN' then 'OPEN' when status = 200 and mid = 'HALF_OPEN' and need <= 1 then 'CLOSED'
      when status = 500 and cnt + 1 >= 100 then 'OPEN' else mid end,
    case when mid = 'OPEN' then cnt when status = 200 then case when mid = 'HALF_OPEN' then case when need <= 1 then 0.0 else cnt end
      else greatest(cnt - 1, 0.0) end when status = 429 then cnt + 0.5 else cnt + 1 end,
    case when mid = 'HALF_OPEN' and status = 200 then case when need <= 1 then 2 else need - 1 end else need end,
    case when mid = 'OPEN' or status = 200 then failed else us end
  from (select f.host, e.rn, e.event_id, e.us, e.status, f.state as before, f.cnt, f.need, f.failed,
      case when f.state = 'OPEN' and e.us - f.failed > 1000000 then 'HALF_OPEN' else f.state end as mid
    from f join e on e.host = f.host and e.rn = f.rn + 1))
select host, event_id, us, mid as state, cnt as failure_count from f where mid <> before
union all select host, event_id, us, state, cnt from f where state <> mid"""


def health_log(events):
    """Hosts are user groups; error, view and click count as failed fetches, so that hosts open."""
    return events.selectExpr(
        "concat('host', user_id % 10) as host", "cast(ts as timestamp) as ts", "event_id",
        "case when event_type in ('error', 'view', 'click') then 500 when event_type = 'signup' then 429 else 200 end as status")


@query("t4_health_transitions", HEALTH_SQL)
def t4(spark, sf):
    d = G.health_transitions(health_log(view(spark, sf, "events")))
    return d.select("host", "event_id", F.unix_micros("ts").alias("us"), "state", "failure_count")


# ------------------------------------------------------------------ calls

KEYS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
KEY_SQL = ", ".join(KEYS)
SPLIT_SQL = """, sp as (select *, case when contains(spec, ':') then split_part(spec, ':', 1) else split_part(spec, '!', 1) end as module_spec,
  case when contains(spec, ':') then spec[strpos(spec, ':') + 1:] else spec[strpos(spec, '!') + 1:] end as function,
  l_suppkey % 3 = 0 as wide, case when l_linenumber = 1 then 'bool' else 'u32' end as return_type from call_log_v)
"""
MODULE_SQL = """, md as (select *, case lower(module_spec) when 'k' then 'kernel32.dll' when 'u' then 'user32.dll' when 'n' then 'ntdll.dll'
  else module_spec || '.dll' end as module from sp)
"""


def call_log(spark, sf):
    return view(spark, sf, "call_log_v")


@query("e1_split_specs", CALLS + SPLIT_SQL + f"select {KEY_SQL}, module_spec, function from sp")
def e1(spark, sf):
    return K.split_specs(call_log(spark, sf)).select(*KEYS, "module_spec", "function")


@query("e2_options", CALLS + SPLIT_SQL + f"""
select {KEY_SQL}, wide, return_type, trim(replace(replace(args, ' --wide', ''), ' --ret bool', '')) as plain, 5 as n from sp""")
def e2(spark, sf):
    d = K.parse_options(call_log(spark, sf))
    return d.select(*KEYS, "wide", "return_type", F.array_join("arguments", " ").alias("plain"), F.size("arguments").alias("n"))


@query("e3_modules", CALLS + SPLIT_SQL + MODULE_SQL + "select module_spec, module, count(*) as n from md group by all")
def e3(spark, sf):
    d = K.normalise_module(K.split_specs(call_log(spark, sf)))
    return d.groupBy("module_spec", "module").agg(F.count(F.lit(1)).alias("n"))


@query("e4_arguments", CALLS + f"""
, a as (select *, 0 as arg_no, 'int' as kind, 'u32' as width, l_partkey as number, '' as text from call_log_v
  union all select *, 1, 'int', 'i32', -l_linenumber, '' from call_log_v
  union all select *, 2, 'int', 'u32', ('0x' || l_suppkey)::bigint, '' from call_log_v
  union all select *, 3, 'str', '', -1, split_part(args, ' ', 4)[4:] from call_log_v
  union all select *, 4, 'buffer', '', l_linenumber * 8, '' from call_log_v)
select {KEY_SQL}, arg_no, kind, width, number, text from a""".replace("('0x' || l_suppkey)::bigint",
       "list_sum(list_transform(range(length(l_suppkey::varchar)), lambda i: (l_suppkey // pow(10, i)::bigint) % 10 * pow(16, i)::bigint))::bigint"))
def e4(spark, sf):
    d = K.type_arguments(K.parse_options(call_log(spark, sf)))
    return d.select(*KEYS, "arg_no", "kind", F.coalesce("width", F.lit("")).alias("width"),
                    F.coalesce(F.col("number").cast("long"), F.lit(-1)).alias("number"), F.coalesce("text", F.lit("")).alias("text"))


@query("e4_long_integers", CALLS + """
, t as (select l_orderkey as o, l_linenumber as l, unnest([0, 1, 2, 3]) as i from call_log_v)
select i, l, case i when 0 then '-' || repeat((o + 1)::varchar, 30 + l) when 1 then (((1::hugeint << (60 + 8 * l)) - 1))::varchar
  when 2 then ((1::hugeint << (64 + l)))::varchar else repeat('7', 1000 + l) end as digits, case when i = 0 then 'i64' else 'u64' end as width, count(*) as n from t group by all""")
def e4_long(spark, sf):
    """Negative decimals with separators, hexadecimal, binary and 1,000-digit literals of up to 64 bits and far more."""
    token = F.expr("""case i when 0 then concat('-', repeat(cast(l_orderkey + 1 as string), 30 + l_linenumber))
      when 1 then concat('0x', repeat('f', 15 + 2 * l_linenumber)) when 2 then concat('0b1', repeat('0', 64 + l_linenumber))
      else concat('  ', repeat('7', 1000 + l_linenumber), ' ') end""")
    # heavy on CPU per byte, and a small table may be one parquet row group: its narrow rows are dealt first
    log = call_log(spark, sf).select("l_orderkey", "l_linenumber").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    d = log.select("l_orderkey", "l_linenumber", F.explode(F.array(*map(F.lit, range(4)))).alias("i")).withColumn("token", token)
    # equal tokens are counted first and parsed once
    tokens = d.groupBy("i", F.col("l_linenumber").alias("l"), "token").agg(F.count(F.lit(1)).alias("n"))
    return K.typed(tokens, "token").groupBy("i", "l", "digits", "width").agg(F.sum("n").alias("n"))


@query("e5_buffer_limits", CALLS + """
, b as (select l_linenumber, l_suppkey, case l_suppkey % 4 when 0 then '$b:0' when 1 then '$b:67108865' when 2 then '$b:x' else '$b:0x10' end as token from call_log_v)
select token, case l_suppkey % 4 when 0 then 'buffer size not positive' when 1 then 'buffer size too large' when 2 then 'invalid buffer size' else '' end as error,
  case when l_suppkey % 4 = 3 then 16 else -1 end as number, count(*) as n from b group by all""")
def e5(spark, sf):
    token = F.expr("case l_suppkey % 4 when 0 then '$b:0' when 1 then '$b:67108865' when 2 then '$b:x' else '$b:0x10' end")
    d = K.typed(call_log(spark, sf).select(token.alias("token")), "token").select(
        "token", F.coalesce("error", F.lit("")).alias("error"), F.coalesce(F.col("number").cast("int"), F.lit(-1)).alias("number"))
    return d.groupBy("token", "error", "number").agg(F.count(F.lit(1)).alias("n"))


@query("e6_hexdump", with_views("symbols_v") + r"""
, p as (select sym_id, hex(encode(p_name || ' ' || symbol)) as h from symbols_v)
, o as (select sym_id, h, unnest(range(0, length(h) // 2, 16)) as off from p)
, c as (select *, h[off * 2 + 1:off * 2 + 32] as part from o)
select sym_id, off::int as offset, lower(printf('%08x', off)) || '  ' || rpad(trim(regexp_replace(lower(part), '(..)', '\1 ', 'g')), 47, ' ') || '  '
  || decode(unhex(part)) as line from c""")
def e6(spark, sf):
    d = view(spark, sf, "symbols_v").select("sym_id", F.concat_ws(" ", "p_name", "symbol").cast("binary").alias("data"))
    return K.hexdump(d, "data").select("sym_id", "offset", "line")


EXPORTS = with_views("call_log_v", "exports_v")
RESOLVED_SQL = SPLIT_SQL + MODULE_SQL + """, rs as (select md.*, case when wide then case when w.function is not null then w.function end
  else coalesce(x.function, w.function, a.function) end as resolved from md
  left join exports_v x on x.module = md.module and x.function = md.function
  left join exports_v w on w.module = md.module and w.function = md.function || 'W'
  left join exports_v a on a.module = md.module and a.function = md.function || 'A')
"""


def parsed(spark, sf):
    return K.normalise_module(K.parse_options(K.split_specs(call_log(spark, sf))))


@query("j17_resolve_calls", EXPORTS + RESOLVED_SQL + "select module, function, wide, resolved, count(*) as n from rs group by all")
def j17(spark, sf):
    d = L.resolve_calls(parsed(spark, sf), view(spark, sf, "exports_v"))
    return d.groupBy("module", "function", "wide", "resolved").agg(F.count(F.lit(1)).alias("n"))


@query("e7_enriched_calls", EXPORTS + RESOLVED_SQL + f"""
select {KEY_SQL}, rs.module, resolved, coalesce(doc_page, -1) as doc_page from rs left join
  (select lower(case when sym_id % 3 = 0 then concat('Unlisted', symbol) else symbol end) as k, min(sym_id) as doc_page from symbols_v group by 1) on k = lower(coalesce(resolved, function))""")
def e7(spark, sf):
    name = F.expr("case when sym_id % 3 = 0 then concat('Unlisted', symbol) else symbol end")
    docs = view(spark, sf, "symbols_v").select(name.alias("doc_function"), F.col("sym_id").alias("doc_page"))
    return K.enrich_calls(call_log(spark, sf), view(spark, sf, "exports_v"), docs).select(
        *KEYS, "module", "resolved", F.coalesce("doc_page", F.lit(-1)).alias("doc_page"))


@query("g10_call_profile", CALLS + SPLIT_SQL + MODULE_SQL + """
, e as (select *, (l_partkey * 7 + l_suppkey * 3) % 1000 / 1000.0 as elapsed from md)
select module, function, count(*) as calls, count(distinct l_orderkey) as sources, round(avg(elapsed), 6) as mean,
  max(elapsed)::double as longest, quantile_disc(elapsed, 0.5)::double as median from e group by module, function""")
def g10(spark, sf):
    return K.call_profile(timed(spark, sf))


def timed(spark, sf):
    return parsed(spark, sf).withColumn("elapsed", ((F.col("l_partkey") * 7 + F.col("l_suppkey") * 3) % 1000).cast("double") / 1000.0)


@query("g10_merged_profiles", CALLS + SPLIT_SQL + MODULE_SQL + """
select module, function, count(*) as calls, true as sources_close, true as median_close from md group by module, function""")
def g10_merged(spark, sf):
    """Sketches per line number, merged; their estimates against exact counts and ranks (5 and 3 percent, and one)."""
    d = timed(spark, sf)
    about = K.read_profiles(K.merged_profiles(K.profile_sketches(d, "l_linenumber")))
    key = ["module", "function"]
    exact = d.groupBy(*key).agg(F.count_distinct("l_orderkey").alias("exact"))
    times = d.groupBy(*key, "elapsed").agg(F.count(F.lit(1)).alias("rows"))  # calls meet their median after equal times are counted
    at = about.select(*key, "calls", "sources", F.get("quantiles", F.lit(0)).alias("median"))
    rows = lambda where: F.coalesce(F.sum(F.when(where, F.col("rows"))), F.lit(0))
    ranks = times.join(at, key).groupBy(*key, "calls", "sources").agg(F.sum("rows").alias("n"), rows(F.col("elapsed") < F.col("median")).alias("below"),
                                                                      rows(F.col("elapsed") <= F.col("median")).alias("upto"))
    near = F.abs(F.col("sources") - F.col("exact")) <= 0.05 * F.col("exact") + 1
    half, slack = F.col("n") / 2, 0.03 * F.col("n") + 1
    return ranks.join(exact, key).select(
        *key, "calls", near.alias("sources_close"), ((F.col("below") <= half + slack) & (F.col("upto") >= half - slack)).alias("median_close"))


# ------------------------------------------------------------------ sources and sinks as columns


@query("s6_search_results", """
select p_partkey as id, i::bigint as rank, case i when 0 then 'https://x.example/' || p_partkey else '' end as url,
  case i when 0 then '' else p_name end as title from part, (select unnest([0, 1]) as i)""")
def s6(spark, sf):
    from docatlas.sources.tables import read_search_results
    body = F.expr("""concat('{"results":[{"url":"https://x.example/', p_partkey, '"},{"title":"', p_name, '"}]}')""")
    d = view(spark, sf, "part").select(F.col("p_partkey").alias("id"), body.alias("json"))
    return read_search_results(d, "json").select("id", "rank", "url", "title")


@query("s8_json_rows", with_views("names_v") + """
select symbol, symbol as name, '0' as parameter_count, true as keeps_nulls from (select distinct symbol from names_v)""")
def s8(spark, sf):
    missing = R.not_found_records(view(spark, sf, "names_v").select("symbol").distinct(), "br")
    d = R.json_body(missing.withColumn("key", F.col("symbol")), "key")
    return d.select(F.col("key").alias("symbol"), F.get_json_object("json", "$.name").alias("name"),
                    F.get_json_object("json", "$.parameter_count").alias("parameter_count"),
                    F.col("json").contains('"url":null').alias("keeps_nulls"))
