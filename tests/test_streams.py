"""Batch = stream over several small files; late and repeated rows."""
import os
import random

import pytest
from pyspark.sql import functions as F

from docatlas.operators import logs as G
from docatlas.plans import q_logs as QL
from docatlas.plans.views import spark_view
from docatlas.streaming import jobs as J
from docatlas.streaming.upserts import Generations

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def log(spark, tmp_path_factory):
    """The probe/fetch log of the smallest scale as six files in time order."""
    folder = str(tmp_path_factory.mktemp("log"))
    probe = spark_view(spark, SF, "probe_log_v")
    fetch = spark_view(spark, SF, "fetch_log_v").select("event_id", F.col("status").alias("fetch_status"), "body", "etag", "last_modified")
    whole = probe.join(fetch, "event_id")
    total = whole.count()
    for i in range(6):
        part = whole.filter((F.col("event_id") >= i * total / 6) & (F.col("event_id") < (i + 1) * total / 6))
        part.coalesce(1).write.mode("append").parquet(folder)
    return folder


def streamed(spark, folder):
    schema = spark.read.parquet(folder).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def drain(spark, out, tmp_path):
    J.run_available(out, str(tmp_path / "out"), str(tmp_path / "cp"))
    return spark.read.parquet(str(tmp_path / "out"))


def same(a, b):
    cols = sorted(a.columns)
    left, right = (sorted(map(tuple, d.select(*cols).collect()), key=str) for d in (a, b))
    assert left == right and left


def test_snapshot(spark, log, tmp_path):
    def view(d):
        return d.withColumn("status", F.col("fetch_status"))
    q = J.snapshot_stream(view(streamed(spark, log)), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination()
    same(J.read_snapshot(spark, str(tmp_path / "out")), G.latest_snapshot(view(spark.read.parquet(log))))


def test_agent_state(spark, log, tmp_path, rocks):
    same(drain(spark, J.agent_stream(streamed(spark, log)), tmp_path), G.agent_states(spark.read.parquet(log), rows=40))


def test_health(spark, log, tmp_path, rocks):
    bad = F.when(F.col("event_id") % 400 < 300, 500).otherwise(200)
    stream = J.health_stream(streamed(spark, log).withColumn("host", F.lit("one")).withColumn("status", bad))
    batch = spark.read.parquet(log).withColumn("host", F.lit("one")).withColumn("status", bad)
    same(drain(spark, stream, tmp_path), G.health_transitions(batch, seconds=3600))


def test_windows_hold_back_open_ones(spark, log, tmp_path):
    out = drain(spark, G.outcome_windows(streamed(spark, log), "1 hour", delay="10 minutes"), tmp_path)
    batch = G.outcome_windows(spark.read.parquet(log), "1 hour")
    last = spark.read.parquet(log).agg(F.max("ts")).first()[0]
    same(out, batch.filter(F.col("end") <= F.lit(last) - F.expr("interval 10 minutes")))


def test_late_rows_are_dropped(spark, tmp_path):
    folder = str(tmp_path / "in")
    rows = [(1, "h", "2024-01-01 00:10:00", 200), (2, "h", "2024-01-01 05:00:00", 200),
            (4, "x", "2024-01-01 05:10:00", 200), (3, "h", "2024-01-01 00:20:00", 500)]  # late by the watermark of the batch before
    for row in rows:
        d = spark.createDataFrame([row], "event_id long, host string, t string, status int").withColumn("ts", F.to_timestamp("t"))
        d.coalesce(1).write.mode("append").parquet(folder)
    out = drain(spark, G.outcome_windows(streamed(spark, folder), "1 hour", delay="10 minutes"), tmp_path)
    assert [(r.requests, r.failures) for r in out.collect()] == [(1, 0)]


def in_ttl(rows, ttl):
    kept, last = [], {}
    for us, event, url in sorted(rows):
        if url not in last or us - last[url] >= ttl * 1000000:
            kept.append(event)
            last[url] = us
    return kept


def test_dedupe_expires(spark, tmp_path, rocks):
    folder = str(tmp_path / "in")
    for row in [(1, "u", "2024-01-01 00:00:00"), (2, "u", "2024-01-01 00:30:00"), (3, "v", "2024-01-01 03:00:00"),
                (5, "w", "2024-01-01 03:30:00"), (4, "u", "2024-01-01 06:00:00")]:
        d = spark.createDataFrame([row], "event_id long, url string, t string").withColumn("ts", F.to_timestamp("t"))
        d.coalesce(1).write.mode("append").parquet(folder)
    out = drain(spark, J.dedupe_fetches(streamed(spark, folder), 3600), tmp_path)
    assert sorted(r.event_id for r in out.unionByName(J.waiting_fetches(spark, str(tmp_path / "cp"), 3600)).collect()) == [1, 3, 4, 5]


def test_dedupe_is_exact_over_files(spark, tmp_path, rocks):
    """Rows within the delay may come in any file; urls come out again a ttl later, not a batch later."""
    rng = random.Random(8)
    rows = sorted((rng.randint(0, 40_000) * 1000 + 0.0, rng.choice("uuuuvw")) for _ in range(400))
    rows = [(i, u, t / 1000) for i, (t, u) in enumerate(rows)]
    late = sorted(rows, key=lambda r: r[2] + rng.choice([0, 0, 900]))
    folder = str(tmp_path / "in")
    for k in range(6):
        part = [r for i, r in enumerate(late) if i * 6 // len(late) == k]
        rng.shuffle(part)
        d = spark.createDataFrame(part, "event_id long, url string, sec double").withColumn("ts", F.timestamp_seconds("sec"))
        d.coalesce(1).write.mode("append").parquet(folder)
    us = {r.event_id: r.us for r in spark.read.parquet(folder).select("event_id", F.unix_micros("ts").alias("us")).collect()}
    out = drain(spark, J.dedupe_fetches(streamed(spark, folder), 3600, "1000 seconds"), tmp_path)
    rest = J.waiting_fetches(spark, str(tmp_path / "cp"), 3600)
    assert sorted(r.event_id for r in out.unionByName(rest).collect()) == sorted(in_ttl([(us[i], i, u) for i, u, _ in rows], 3600))
    assert out.count() > 20


def test_windows_and_sessions_are_whole_with_the_open_ones(spark, log, tmp_path):
    batch = spark.read.parquet(log)
    done = drain(spark, G.outcome_windows(streamed(spark, log), "1 hour", delay="10 minutes"), tmp_path / "w")
    same(done.unionByName(J.open_windows(spark, str(tmp_path / "w" / "cp"))), G.outcome_windows(batch, "1 hour"))
    done = drain(spark, G.client_sessions(streamed(spark, log), delay="10 minutes"), tmp_path / "s")
    same(done.unionByName(J.open_sessions(spark, str(tmp_path / "s" / "cp"))), G.client_sessions(batch))


def test_ingest_replaces_by_url(spark, tmp_path):
    """The newest fetch of a url stays, whatever batch or page_id it came with; one page_id of two urls is two pages."""
    folder = str(tmp_path / "in")
    rows = [[(9, "https://x/en-us/a", "Old", 10.0), (9, "https://x/en-us/b", "Other", 1.0)], [(1, "https://x/en-us/a", "New", 20.0), (0, "https://x/en-us/a", "Older", 5.0)],
            [(7, "https://x/en-us/a", "Late", 15.0)]]
    for part in rows:
        d = spark.createDataFrame([(i, u, f"<h1>{t} function (a.h)</h1>", s) for i, u, t, s in part], "page_id long, url string, html string, sec double")
        d.withColumn("fetched_at", F.timestamp_seconds("sec")).drop("sec").coalesce(1).write.mode("append").parquet(folder)
    q = J.ingest_pages(streamed(spark, folder), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination()
    got = {r.url[-1]: (r.page_id, r.name) for r in J.read_records(spark, str(tmp_path / "out")).collect()}
    assert got == {"a": (1, "New (a.h)"), "b": (9, "Other (a.h)")}


def files_below(path):
    return [f for _, _, names in os.walk(path) for f in names if f.endswith(".parquet")]


def test_a_hundred_batches_are_few_files(spark, tmp_path):
    path, fan = str(tmp_path / "t"), 4
    table = Generations(spark, path, lambda d: d.groupBy("k").agg(F.max_by("v", "at").alias("v"), F.max("at").alias("at")), fan)
    with pytest.raises(FileNotFoundError):
        table.read()
    most = 0
    for i in range(100):
        batch = spark.range(i % 7, i % 7 + 3, 1, 1).select((F.col("id") % 8).alias("k"), F.lit(f"v{i}").alias("v"), F.lit(i).alias("at"))
        assert table.add(batch, i)
        assert not table.add(batch, i)
        live = table.manifest()["live"]
        most = max(most, len(live))
        assert set(table.folder.names("data")) >= {n for _, n in live} and len(table.folder.names("manifest")) <= 2
    want = {}
    for i in range(100):
        want.update({k % 8: f"v{i}" for k in range(i % 7, i % 7 + 3)})
    assert {r.k: r.v for r in table.read().collect()} == want
    assert most <= (fan - 1) * 4 + 1 and len(files_below(path)) < 60


def test_a_rerun_or_dead_batch_changes_nothing(spark, tmp_path):
    table = Generations(spark, str(tmp_path / "t"), lambda d: d.groupBy("k").agg(F.sum("n").alias("n")))
    one = spark.createDataFrame([("a", 1)], "k string, n long")
    table.add(one, 0)
    before = table.manifest()
    table.written(one)  # a writer that died before its manifest
    assert not table.add(one, 0) and table.manifest() == before
    assert [tuple(r) for r in Generations(spark, table.path, table.merge).read().collect()] == [("a", 1)]
    table.add(one, 1)
    assert [tuple(r) for r in table.read().collect()] == [("a", 2)]
    assert set(table.folder.names("data")) == {n for _, n in table.manifest()["live"]}
    with pytest.raises(RuntimeError):
        table.folder.write_once(f"manifest/{table.versions()[-1]}", "{}")


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, J.ROCKSDB)
    yield
    spark.conf.unset(key)
