"""Slices of hot keys: any size gives the same history; what is shuffled and broadcast."""
import random

import pytest
from pyspark.sql import functions as F

from docatlas.operators import chunks
from docatlas.operators import logs as G


def rows_of(n, seed, keys=("hot", "hot", "hot", "a", "b", None)):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        at = None if rng.random() < 0.02 else rng.choice([rng.randint(0, 80_000), rng.randint(40_000, 40_050)]) + rng.random()
        out.append((i, rng.choice(keys), at, rng.choice([200, 500, 500, 304]), rng.choice([None, "e%d" % i]), rng.choice([None, None, "m%d" % i])))
    return out


def frame(spark, rows):
    d = spark.createDataFrame(rows, "event_id long, url string, sec double, status int, etag string, last_modified string")
    return d.withColumn("ts", F.timestamp_seconds("sec")).drop("sec").repartition(3)


def in_order(rows):
    by = {}
    for r in sorted(rows, key=lambda r: (r[2] is not None, r[2] or 0, r[0])):
        by.setdefault(r[1], []).append(r)
    return by


def us(x):
    return None if x is None else int(x * 1000000)


def collected(df):
    return {r.event_id: tuple(r) for r in df.collect()}


@pytest.mark.parametrize("size", [7, 90, 10 ** 9])
def test_history(spark, size):
    rows = rows_of(700, 1)
    d = frame(spark, rows)
    got = {r.event_id: (r.rn, r.run_before, r.run) for r in chunks.with_history(d, "url", F.col("status") == 200, rows=size).collect()}
    want = {}
    for own in in_order(rows).values():
        run = 0
        for k, r in enumerate(own):
            before, run = run, 0 if r[3] == 200 else run + 1
            want[r[0]] = (k + 1, before, run)
    assert got == want


@pytest.mark.parametrize("size", [7, 90, 10 ** 9])
def test_state_as_of_each_request(spark, size):
    rows = rows_of(700, 2)
    d = frame(spark, rows)
    got = collected(G.per_request(d, 3600, rows=size))
    at = {r.event_id: r.us for r in d.select("event_id", F.unix_micros("ts").alias("us")).collect()}
    assert len(got) == len(rows)
    for own in in_order(rows).values():
        cached, etag, modified = None, None, None
        for r in own:
            have, now = cached is not None, at[r[0]]
            fresh = bool(have and now is not None and cached[0] is not None and now - cached[0] < 3600 * 1000000)
            assert got[r[0]] == (r[0], r[1], cached[0] if have else None, fresh, cached[1] if have else None, cached[2] if have else None, etag, modified)
            cached = (now, r[4] or "", r[5] or "") if r[3] == 200 else cached
            etag, modified = r[4] or etag, r[5] or modified


def test_a_busy_day_is_many_slices(spark):
    d = spark.range(20_000).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 900).cast("string"))).alias("key"),
                                   F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") / 400).alias("ts"))
    s = chunks.sliced(d, "key", rows=200).groupBy("key", "_slice").count().collect()
    hot = [r["count"] for r in s if r.key == "hot"]
    assert len(hot) > 25 and max(hot) < 500 and sum(hot) == 6667
    assert all(r._slice == 0 for r in s if r.key != "hot")
    assert chunks.cuts_of(d, "key", F.unix_micros("ts"), 200).count() == 1


def test_the_log_is_shuffled_once(spark):
    log = frame(spark, rows_of(300, 3))
    for d in (G.failure_runs(log, "url"), G.per_request(log), G.retry_schedule(log)):
        lines = d._jdf.queryExecution().executedPlan().toString().split("\n")
        big = {line.split("Exchange ")[1].split(", ENSURE")[0].split("#")[0] + line.split("(")[1] for line in lines if "Exchange hashpartitioning(url" in line and "_slice" in line}
        assert not any("SortMergeJoin" in line for line in lines) and len(big) >= 1
        assert all("_slice" in line or "_key" in line or "url" in line for line in lines if "Exchange hashpartitioning" in line)


def test_fetch_tries(spark):
    d = frame(spark, [(k, "u", float(10 * k), s, None, None) for k, s in enumerate([500, 500, 500, 200, 500, 200])])
    got = [tuple(r) for r in G.fetch_schedule(d).orderBy("event_id").collect()]
    assert got == [(1, "u", 0, 1.0, False, 1_000_000), (2, "u", 1, 2.0, True, 12_000_000), (3, "u", 0, 1.0, False, 21_000_000), (5, "u", 0, 1.0, False, 41_000_000)]
    starts = spark.createDataFrame([("s", 1), ("s", 4)], "symbol string, rank int")
    assert [r.start_after for r in G.start_schedule(starts).collect()] == [0.0, 0.3]
