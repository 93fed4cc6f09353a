"""Streaming jobs over the given tables, run to the end and read back."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import functions as F

from docatlas.operators import logs as G
from docatlas.plans import q_logs as QL
from docatlas.plans import q_pages as QP
from docatlas.plans import q_symbols as Q
from docatlas.plans.registry import ORACLES, query
from docatlas.plans.views import spark_view as view
from docatlas.plans.views import with_views
from docatlas.streaming import jobs as J


@contextmanager
def rocksdb(spark):
    """State store of the Python processors, restored afterwards."""
    key = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(key, None)
    spark.conf.set(key, J.ROCKSDB)
    try:
        yield
    finally:
        spark.conf.unset(key) if old is None else spark.conf.set(key, old)


def drained(spark, out, name):
    path = J.shared_folder(spark, name)
    J.run_available(out, f"{path}/out", f"{path}/checkpoint")
    return spark.read.parquet(f"{path}/out")


@query("t1_stream_snapshot", ORACLES["t1_latest_snapshot"])
def t1_stream(spark, sf):
    path = J.shared_folder(spark, "t1")
    J.snapshot_stream(view(spark, sf, "fetch_log_v", stream=True), f"{path}/out", f"{path}/checkpoint").awaitTermination()
    return J.read_snapshot(spark, f"{path}/out").select(
        "url", "body", "last_status", F.unix_micros("last_ts").alias("last_us"), "fetches")


@query("t4_stream_health", QL.HEALTH_SQL)
def t4_stream(spark, sf):
    with rocksdb(spark):
        d = drained(spark, J.health_stream(QL.health_log(view(spark, sf, "events", stream=True))), "t4")
    return d.select("host", "event_id", F.unix_micros("ts").alias("us"), "state", "failure_count")


@query("t5_stream_agents", ORACLES["t5_agent_states"])
def t5_stream(spark, sf):
    with rocksdb(spark):
        return drained(spark, J.agent_stream(view(spark, sf, "probe_log_v", stream=True)), "t5")


@query("t6_stream_windows", ORACLES["t6_tumbling_windows"])
def t6_stream(spark, sf):
    """What the stream has put out, and the windows still open in its state."""
    path = J.shared_folder(spark, "t6")
    J.run_available(G.outcome_windows(view(spark, sf, "probe_log_v", stream=True), "1 hour", delay="10 minutes"), f"{path}/out", f"{path}/checkpoint")
    every = spark.read.parquet(f"{path}/out").unionByName(J.open_windows(spark, f"{path}/checkpoint"))
    return every.select("host", F.unix_micros("start").alias("start_us"), "requests", "failures", "weighted")


@query("t7_stream_sessions", ORACLES["t7_client_sessions"])
def t7_stream(spark, sf):
    path = J.shared_folder(spark, "t7")
    J.run_available(G.client_sessions(view(spark, sf, "probe_log_v", stream=True), delay="10 minutes"), f"{path}/out", f"{path}/checkpoint")
    every = spark.read.parquet(f"{path}/out").unionByName(J.open_sessions(spark, f"{path}/checkpoint"))
    return every.select("agent", F.unix_micros("start").alias("start_us"), F.unix_micros("last_ts").alias("last_us"), "requests")


def in_files(spark, df, path, files):
    """``df`` as files in time order, so that a stream of one file at a time has as many batches."""
    ends = df.agg(F.min("ts").alias("low"), F.max("ts").alias("high")).head()
    step = (ends.high - ends.low) / files if ends.low else None
    for k in range(files if step is not None else 0):
        part = df.where((F.col("ts") >= ends.low + k * step) & ((F.col("ts") < ends.low + (k + 1) * step) if k + 1 < files else F.lit(True)))
        part.coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


@query("t8_stream_dedupe", with_views("fetch_log_v") + """
, l as (select sha256(url) as url_key, event_id, epoch_us(ts) as us from fetch_log_v)
, k as (select url_key, min(us) as us from l group by url_key
  union all select l.url_key, min(l.us) from k join l on l.url_key = k.url_key and l.us >= k.us + 3600000000 group by l.url_key, k.us)
select url_key, us, min(event_id) as event_id from k join l using (url_key, us) group by 1, 2""")
def t8_stream(spark, sf):
    """Six files: a url comes out again a ttl after it came out last, across batches."""
    path = J.shared_folder(spark, "t8")
    log = in_files(spark, view(spark, sf, "fetch_log_v").select("event_id", "url", "ts"), f"{path}/in", 6)
    with rocksdb(spark):
        J.run_available(J.dedupe_fetches(log, G.CACHE_TTL), f"{path}/out", f"{path}/checkpoint")
        waiting = J.waiting_fetches(spark, f"{path}/checkpoint", G.CACHE_TTL)
        waiting.write.parquet(f"{path}/rest")
    return spark.read.parquet(f"{path}/out").unionByName(spark.read.parquet(f"{path}/rest")).select("url_key", "us", "event_id")


@query("t9_stream_enrichment", Q.MAP_VIEWS + Q.EVIDENCE_CTE + Q.SCORED_CTE + Q.HEADERS_CTE + """
, hc as (select symbol, string_agg(header, ' ' order by rank) as candidates from f4 group by symbol)
select sym_id, n.symbol, dll, header, score, candidates from names_v n join rk on n.symbol = rk.symbol join hc on hc.symbol = n.symbol
where rk.rank = 1""")
def t9_stream(spark, sf):
    symbols = view(spark, sf, "names_v", stream=True).select("sym_id", "symbol")
    return drained(spark, J.enrich_stream(symbols, Q.key_map(spark, sf)), "t9").select(
        "sym_id", "symbol", "dll", "header", "score", F.array_join("candidates", " ").alias("candidates"))


@query("t10_stream_ingest", QP.DOC + QP.RECORDS_SQL)
def t10_stream(spark, sf):
    """Every page comes once, as the newest of its url."""
    path = J.shared_folder(spark, "t10")
    unique = F.concat("url", F.lit("?id="), F.col("page_id").cast("string"))
    pages = view(spark, sf, "doc_pages_v", stream=True).withColumn("url", unique)
    J.ingest_pages(pages, f"{path}/out", f"{path}/checkpoint").awaitTermination()
    d = J.read_records(spark, f"{path}/out")
    return d.withColumn("url", F.substring_index("url", "?", 1)).select(*QP.FLAT)
