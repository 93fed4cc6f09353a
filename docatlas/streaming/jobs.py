"""T1, T4-T10 as Structured Streaming jobs.

Every job is a function of a streaming DataFrame.  State lives in the state store
(RocksDB for the Python processors) and in the checkpoint folder, never in a
machine-local place on a cluster; sinks are idempotent per batch id, so a batch
that runs twice after a lost executor leaves the same table."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from docatlas import dims
from docatlas.functions import names as N
from docatlas.operators import evidence as E
from docatlas.operators import logs as G
from docatlas.operators import records as R
from docatlas.streaming.upserts import Generations

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``.  Where that is unset, executors share no known
    folder: an error, except with a local master (tests), which gets a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if base is None and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{base or tempfile.mkdtemp(prefix='docatlas-')}/{name}-{uuid.uuid4().hex}"


def run_available(out: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process everything there is into a parquet folder."""
    query = (out.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start(path))
    query.awaitTermination()


# ------------------------------------------------------------------ T1


def into_table(stream: DataFrame, table: Generations, checkpoint: str, job: Callable[[DataFrame, int], DataFrame],
               available_now: bool = True) -> StreamingQuery:
    """``job(batch, id)`` of every micro-batch, upserted; a batch that runs twice is added once."""
    writer = stream.writeStream.foreachBatch(lambda batch, k: table.add(job(batch, k), k)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def snapshots(spark: SparkSession, path: str) -> Generations:
    """The newest body per url as an upserted table."""
    return Generations(spark, path, lambda d: G.merge_snapshots(d.limit(0), d))


def snapshot_stream(log: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Each batch adds its own small snapshot; batches are compacted as they gather."""
    return into_table(log, snapshots(log.sparkSession, path), checkpoint, lambda batch, _: G.latest_snapshot(batch), available_now)


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """Merge of the live snapshots (newest wins), combined before the shuffle."""
    return snapshots(spark, path).read()


# ------------------------------------------------------------------ T4, T5


def ordered(rows: Iterator[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(list(rows), ignore_index=True).sort_values(["ts", "event_id"])


class HealthProcessor(StatefulProcessor):
    """T4: constant-size state per host."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.saved = handle.getValueState("health", "count double, state string, needed int, failed_at double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        health = G.Health(*self.saved.get()) if self.saved.exists() else G.Health()
        out = []
        pdf = ordered(rows)
        for ts, event, at, status in zip(pdf["ts"], pdf["event_id"], pdf["at"], pdf["status"]):
            out += [(key[0], ts, event, s, health.count) for s in health.step(at, status)]
        self.saved.update(health.astuple())
        yield pd.DataFrame(out, columns=["host", "ts", "event_id", "state", "failure_count"])

    def close(self) -> None:
        pass


def health_stream(log: DataFrame) -> DataFrame:
    """T4: state changes per host, in event time within each batch."""
    rows = log.select("host", "ts", "event_id", (F.unix_micros("ts") / 1e6).alias("at"), "status")
    return rows.groupBy("host").transformWithStateInPandas(
        HealthProcessor(), outputStructType=G.TRANSITIONS, outputMode="Append", timeMode="None")


AGENT_STATE = "event_id long, agent string, rotation long, run long, rotate boolean"


class AgentProcessor(StatefulProcessor):
    """T5: requests so far and failures in a row per agent."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.saved = handle.getValueState("agent", "requests long, run long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        requests, run = self.saved.get() if self.saved.exists() else (0, 0)
        out = []
        pdf = ordered(rows)
        for event, status in zip(pdf["event_id"], pdf["status"]):
            requests, run = requests + 1, 0 if status == 200 else run + 1
            out.append((event, key[0], (requests - 1) // G.AGENT_REQUESTS, run,
                        requests % G.AGENT_REQUESTS == 0 or run >= G.AGENT_FAILURES))
        self.saved.update((requests, run))
        yield pd.DataFrame(out, columns=["event_id", "agent", "rotation", "run", "rotate"])

    def close(self) -> None:
        pass


def agent_stream(log: DataFrame) -> DataFrame:
    return log.select("agent", "ts", "event_id", "status").groupBy("agent").transformWithStateInPandas(
        AgentProcessor(), outputStructType=AGENT_STATE, outputMode="Append", timeMode="None")


# ------------------------------------------------------------------ T6, T7: what is still open


def open_state(spark: SparkSession, checkpoint: str, variable: str | None = None) -> DataFrame:
    """The state after the last batch: what an append-mode stream has not put out yet."""
    reader = spark.read.format("statestore")
    return (reader.option("stateVarName", variable) if variable else reader).load(checkpoint)


def open_windows(spark: SparkSession, checkpoint: str) -> DataFrame:
    """Windows after the watermark, as ``outcome_windows`` gives them.  Counters of one kind have one name in
    the state, so the counts are told apart by size: no window has more failures than requests."""
    d = open_state(spark, checkpoint).select("key", F.inline(F.array("value")).alias("a", "b", "c"))
    numbers = {c: dict(d.dtypes)[c] for c in "abc"}
    first, second = (c for c in "abc" if numbers[c] == "bigint")
    weighted = next(c for c in "abc" if numbers[c] == "double")
    return d.select("key.host", F.col("key.window.start").alias("start"), F.col("key.window.end").alias("end"),
                    F.greatest(first, second).alias("requests"), F.least(first, second).alias("failures"), F.col(weighted).alias("weighted"))


def open_sessions(spark: SparkSession, checkpoint: str) -> DataFrame:
    """Sessions after the watermark, as ``client_sessions`` gives them."""
    return open_state(spark, checkpoint).select("key.agent", F.col("value.session_window.start").alias("start"),
                                                F.col("value.max").alias("last_ts"), F.col("value.count").alias("requests"))


# ------------------------------------------------------------------ T8-T10

KEPT_FETCH = "url_key string, event_id long, us long"


def first_in_ttl(times: np.ndarray, ttl_us: int, kept: int | None) -> tuple[list[int], int | None]:
    """Places of the rows that stay among sorted ``times``: the first at least a ttl after the one kept before, and so on."""
    out, at = [], 0 if kept is None else int(np.searchsorted(times, kept + ttl_us))
    while at < len(times):
        out.append(at)
        kept = int(times[at])
        at = int(np.searchsorted(times, kept + ttl_us))
    return out, kept


class TtlProcessor(StatefulProcessor):
    """Keyed state with event-time expiry.

    Rows wait for the watermark, so that they are judged in time order whatever file they came in.
    Rows within the ttl of the last kept one never wait, so a hot url's list is short; a url that
    is not seen for a ttl leaves no state."""

    def __init__(self, ttl: int):
        self.ttl_us = ttl * 1000000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("kept", "us long")
        self.waiting = handle.getListState("waiting", "us long, event_id long")

    def remember(self, rows: list[tuple]) -> None:
        self.waiting.put(rows) if rows else self.waiting.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        kept = self.kept.get()[0] if self.kept.exists() else None
        held = list(self.waiting.get())
        low = min((r[0] for r in held), default=None)
        for pdf in rows:
            new = pdf if kept is None else pdf[pdf["us"] >= kept + self.ttl_us]
            held += zip(new["us"].tolist(), new["event_id"].tolist())
        if held:
            self.remember(held)
            least = min(r[0] for r in held)
            if low is None or least < low:
                self.handle.registerTimer(-(-least // 1000))
        yield pd.DataFrame([], columns=["url_key", "event_id", "us"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        kept = self.kept.get()[0] if self.kept.exists() else None
        now = timerValues.getCurrentWatermarkInMs() * 1000
        held = sorted((r[0], r[1]) for r in self.waiting.get())
        ripe = [r for r in held if r[0] <= now]
        chosen, kept = first_in_ttl(np.array([r[0] for r in ripe], dtype=np.int64), self.ttl_us, kept)
        rest = [r for r in held if r[0] > now and (kept is None or r[0] >= kept + self.ttl_us)]
        self.remember(rest)
        if rest:
            self.handle.registerTimer(-(-rest[0][0] // 1000))
        if kept is not None and kept + self.ttl_us <= now and not rest:
            self.kept.clear()
        elif kept is not None:
            self.kept.update((kept,))
            if not rest:
                self.handle.registerTimer(-(-(kept + self.ttl_us) // 1000))
        yield pd.DataFrame([(key[0], ripe[i][1], ripe[i][0]) for i in chosen], columns=["url_key", "event_id", "us"])

    def close(self) -> None:
        pass


def dedupe_fetches(log: DataFrame, ttl: int = G.CACHE_TTL, delay: str = "10 minutes") -> DataFrame:
    """url_key, event_id, us of the fetches that stay: per url the first one, then the first at least ``ttl`` seconds
    after that, and so on; exact for rows at most ``delay`` late, whatever the files and batches.  Ties by event_id."""
    rows = log.select(N.url_key("url").alias("url_key"), "event_id", "ts", F.unix_micros("ts").alias("us"))
    return rows.withWatermark("ts", delay).groupBy("url_key").transformWithStateInPandas(
        TtlProcessor(ttl), outputStructType=KEPT_FETCH, outputMode="Append", timeMode="EventTime")


def waiting_fetches(spark: SparkSession, checkpoint: str, ttl: int = G.CACHE_TTL) -> DataFrame:
    """What stays of the rows that still wait for the watermark, as if no row were to come."""
    def judge(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["us", "event_id"])
        kept = pdf["kept"].iloc[0]
        chosen, _ = first_in_ttl(pdf["us"].to_numpy(), ttl * 1000000, None if pd.isna(kept) else int(kept))
        return pdf.iloc[chosen][["url_key", "event_id", "us"]]

    rows = open_state(spark, checkpoint, "waiting").select(F.col("key.url_key").alias("url_key"), "list_element.*")
    kept = open_state(spark, checkpoint, "kept").select(F.col("key.url_key").alias("url_key"), F.col("value.us").alias("kept"))
    return rows.join(kept, "url_key", "left").groupBy("url_key").applyInPandas(judge, KEPT_FETCH)


def enrich_stream(symbols: DataFrame, key_map: DataFrame) -> DataFrame:
    """Module, kind, best header with score, page url and candidates of each symbol.

    Stateless: three stream-static joins on the key map, the rest inside the row."""
    d = symbols.withColumn("dll", N.module_of("symbol"))
    probes = [("exact", F.lower("symbol"), dims.SCORE_EXACT), ("aw", N.aw_base("symbol"), dims.SCORE_AW),
              ("ex", N.ex_base("symbol"), dims.SCORE_EX)]
    for tag, key, _ in probes:
        side = key_map.select(F.col("key").alias(f"k_{tag}"), F.col("header").alias(f"h_{tag}"))
        d = d.withColumn(f"p_{tag}", key).join(side, F.col(f"p_{tag}") == F.col(f"k_{tag}"), "left").drop(f"k_{tag}", f"p_{tag}")
    hits = F.array_compact(F.array(*[F.when(F.col(f"h_{t}").isNotNull(), F.struct(
        F.lit(i).alias("ord"), F.col(f"h_{t}").alias("header"), F.lit(s).alias("score")))
        for i, (t, _, s) in enumerate(probes)]))
    d = d.withColumn("best", E.best_in_row(hits, "symbol", "dll"))
    return d.select(
        *symbols.columns, "dll", N.symbol_kind("symbol").alias("symbol_type"), F.col("best.header").alias("header"),
        (-F.col("best.neg")).alias("score"), N.template_url("symbol", F.col("best.header")).alias("url"),
        N.header_candidates("symbol", "dll").alias("candidates"))


def newest_record(records: DataFrame) -> DataFrame:
    """One record per url key: the newest fetch, of one fetch time the newest batch, then the largest page_id."""
    cols = [c for c in records.columns if c != "url_key"]
    newest = F.max_by(F.struct(*cols), F.struct("fetched_at", "batch", "page_id"))
    return records.groupBy("url_key").agg(newest.alias("r")).select("url_key", "r.*")


def page_records(spark: SparkSession, path: str) -> Generations:
    """The newest record per url as an upserted table."""
    return Generations(spark, path, newest_record)


def ingest_pages(pages: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """New page files (page_id, url, html and, if known, fetched_at) -> the newest record per url.

    Of the pages of one url in a batch only the newest is parsed."""
    def job(batch: DataFrame, k: int) -> DataFrame:
        if "fetched_at" not in batch.columns:
            batch = batch.withColumn("fetched_at", F.lit(None).cast("timestamp"))
        row = F.struct("fetched_at", "page_id", "html")
        newest = batch.groupBy("url").agg(F.max(row).alias("n"))
        return R.doc_records(newest.select("url", "n.*"), "fetched_at").withColumns({"url_key": N.url_key("url"), "batch": F.lit(k).cast("long")})

    return into_table(pages, page_records(pages.sparkSession, path), checkpoint, job, available_now)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Newest record per url key over all batches."""
    return page_records(spark, path).read().drop("batch")
