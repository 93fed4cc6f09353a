"""Ordered per-key columns over logs without one task per key.

A key may hold a third of a log, and all of that within one day.  Keys of more than ``rows``
rows are cut into slices at quantiles of their own times, so slices follow the data and not the clock;
rows are windowed per (key, slice) in one exchange, and one row per slice of the cut keys carries
what a later slice must know: row counts, failure runs, last times and last values.

What is broadcast is bounded: at most N / rows keys are cut, into at most 2 N / rows slices.
Rows of a key at the same microsecond stay in one slice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

ROWS = 1 << 20
QUANTILES = 1024
STEP = 32


def cuts_of(log: DataFrame, key: str, us: Column, rows: int) -> DataFrame:
    """_key, _grid (sorted cut times, STEP to an array) of every key that is to be cut.  Partial aggregates of two narrow columns."""
    d = log.select(F.col(key).alias("_key"), us.alias("_at"))
    hot = d.groupBy("_key").agg(F.count("*").alias("n")).where(F.col("n") > rows).withColumnRenamed("_key", "_hot_key")
    times = d.join(F.broadcast(hot), F.col("_key").eqNullSafe(F.col("_hot_key"))).where("_at is not null")
    at = F.percentile_approx("_at", [k / QUANTILES for k in range(1, QUANTILES)], 10000)
    every = F.ceil(F.lit(float(QUANTILES * rows)) / F.max("n"))
    q = times.groupBy("_key").agg(at.alias("cuts"), F.greatest(every, F.lit(1)).cast("int").alias("every"))
    thin = F.array_distinct(F.filter("cuts", lambda _, i: (i + 1) % F.col("every") == 0))
    q = q.select("_key", thin.alias("cuts")).where(F.size("cuts") > 0)
    starts = F.sequence(F.lit(1), F.size("cuts"), F.lit(STEP))
    return q.select("_key", F.transform(starts, lambda i: F.slice("cuts", i, STEP)).alias("_grid"))


def place_in(grid: Column, us: Column) -> Column:
    """Number of cuts at or before ``us``, by two short searches; 0 for null."""
    row = F.size(F.filter(grid, lambda g: F.get(g, F.lit(0)) <= us))
    inside = F.size(F.filter(F.get(grid, row - 1), lambda c: c <= us))
    return F.when(row > 0, (row - 1) * STEP + inside).otherwise(F.lit(0))


def sliced(log: DataFrame, key: str, ts: str = "ts", rows: int = ROWS) -> DataFrame:
    """``log`` with _us (time in microseconds), _slice (0 up within a key, ordered by time), _cut (the key has several slices)."""
    us = F.unix_micros(F.col(ts))
    cuts = F.broadcast(cuts_of(log, key, us, rows))
    d = log.withColumn("_us", us).join(cuts, F.col(key).eqNullSafe(F.col("_key")), "left")
    cut = F.col("_grid").isNotNull()
    return d.withColumns({"_cut": cut, "_slice": F.when(cut, place_in(F.col("_grid"), F.col("_us"))).otherwise(F.lit(0))}).drop("_key", "_grid")


def with_carry(d: DataFrame, key: str, summary: DataFrame) -> DataFrame:
    """Join one row per slice of the cut keys; null keys are a key like any other."""
    s = F.broadcast(summary.withColumnsRenamed({key: "_key_s", "_slice": "_slice_s"}))
    return d.join(s, F.col(key).eqNullSafe(F.col("_key_s")) & (F.col("_slice") == F.col("_slice_s")), "left").drop("_key_s", "_slice_s")


def last_before(log: DataFrame, key: str, values: dict[str, Column], ts: str = "ts", tie: str = "event_id", rows: int = ROWS) -> DataFrame:
    """``log`` with, for each name, the newest value of an earlier row of the key that is not null."""
    d = sliced(log, key, ts, rows).withColumns({f"_v_{n}": v for n, v in values.items()})
    order = F.struct("_us", tie)
    newest = [F.max_by(f"_v_{n}", F.when(F.col(f"_v_{n}").isNotNull(), order)).alias(f"_c_{n}") for n in values]
    s = d.where("_cut").groupBy(key, "_slice").agg(*newest)
    earlier = W.partitionBy(key).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    s = s.withColumns({f"_c_{n}": F.last(f"_c_{n}", ignorenulls=True).over(earlier) for n in values})
    before = W.partitionBy(key, "_slice").orderBy("_us", tie).rowsBetween(W.unboundedPreceding, -1)
    d = d.withColumns({f"_l_{n}": F.last(f"_v_{n}", ignorenulls=True).over(before) for n in values})
    out = with_carry(d, key, s).withColumns({n: F.coalesce(f"_l_{n}", f"_c_{n}") for n in values})
    return out.drop("_us", "_slice", "_cut", *[f"_{x}_{n}" for x in "vcl" for n in values])


def with_history(log: DataFrame, key: str, ok: Column, ts: str = "ts", tie: str = "event_id", rows: int = ROWS) -> DataFrame:
    """Add rn (row number of the key), prev_us (time before, microseconds),
    run_before and run (failures in a row before / including the row)."""
    d = sliced(log, key, ts, rows).withColumn("_ok", F.coalesce(ok, F.lit(False)))
    w = W.partitionBy(key, "_slice").orderBy("_us", tie)
    d = d.withColumns({"_rn": F.row_number().over(w), "_prev": F.lag("_us").over(w)})
    d = d.withColumn("_last_ok", F.max(F.when(F.col("_ok"), F.col("_rn"))).over(w.rowsBetween(W.unboundedPreceding, -1)))

    last_ok = F.max(F.when(F.col("_ok"), F.col("_rn")))
    s = d.where("_cut").groupBy(key, "_slice").agg(F.max("_rn").cast("long").alias("n"), last_ok.alias("last_ok"), F.max("_us").alias("end_us"))
    by_key = W.partitionBy(key).orderBy("_slice")
    before = by_key.rowsBetween(W.unboundedPreceding, -1)
    s = s.withColumn("tail", F.col("n") - F.coalesce("last_ok", F.lit(0)))
    s = s.withColumns({"cum": F.sum("tail").over(by_key), "rows_before": F.sum("n").over(before), "end_before": F.max("end_us").over(before)})
    base = F.last(F.when(F.col("last_ok").isNotNull(), F.col("cum") - F.col("tail")), ignorenulls=True).over(by_key)
    s = s.withColumn("run_end", F.col("cum") - F.coalesce(base, F.lit(0)))
    s = s.withColumn("run_carry", F.lag("run_end").over(by_key))
    d = with_carry(d, key, s.select(key, "_slice", "rows_before", "end_before", "run_carry"))

    local = F.col("_rn") - 1 - F.coalesce("_last_ok", F.lit(0))
    run_before = local + F.when(F.col("_last_ok").isNull(), F.coalesce("run_carry", F.lit(0))).otherwise(0)
    d = d.withColumns({"rn": F.col("_rn") + F.coalesce("rows_before", F.lit(0)), "prev_us": F.coalesce("_prev", "end_before"),
                       "run_before": run_before.cast("long")})
    d = d.withColumn("run", F.when(F.col("_ok"), F.lit(0)).otherwise(F.col("run_before") + 1).cast("long"))
    return d.drop("_us", "_slice", "_cut", "_ok", "_rn", "_prev", "_last_ok", "rows_before", "end_before", "run_carry")
