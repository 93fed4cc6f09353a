"""Operator 7: exact deduplication as a stateful stream.

A streaming aggregation keyed by the text's digest keeps, in a disk-backed (RocksDB)
state store without expiry, the stable identifier of the row that stays (largest
doc_id), the number of rows and the locator of that row's content (file and row).
The state is read back through Spark's state data source.  Wherever a digest was hit
more than once, the full bytes of every row are compared with those at the locator;
rows with the same digest but other bytes form groups of their own.  Only DataFrame
operations are used.

* Equal texts are identical after no change; null counts as empty.
* Among equal texts the largest doc_id stays (null is smallest); of rows that repeat the
  same doc_id and text, the last in (file, row) order.  Exactly one row stays.
* Empty tables give empty results; other columns are carried by ``kept_rows`` only, and
  may have any names.
* Hot groups: the state combines before the shuffle; joins on the digest have one row
  per digest on one side, so that adaptive execution can split a hot one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docatlas.llm.common import BITS, boxed, located, may_be_in, shared_folder, stored, unboxed

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: While the stream starts: state on disk; no pre-allocated files, since a store is small wherever there are many of them;
#: one bound on native memory for all stores of an executor, which else is one per store and outlives the stream.
STATE = {"spark.sql.streaming.stateStore.providerClass": ROCKSDB, "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
         "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true", "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "128"}


def sha(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def remember(stream: DataFrame, checkpoint: str) -> None:
    """Run what the source has now through the keyed state (digest -> newest keeper, count); the state stays in ``checkpoint``.

    Calling it again with the same checkpoint adds only files that are new."""
    spark = stream.sparkSession
    before = {k: spark.conf.get(k, None) for k in STATE}
    for k, v in STATE.items():
        spark.conf.set(k, v)
    try:
        state = stream.groupBy("_digest").agg(F.max(F.struct("doc_id", "_file", "_row")).alias("keep"), F.count("*").alias("n"))
        (state.writeStream.format("noop").outputMode("update").option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start().awaitTermination())
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def recall(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The keyed state: _digest, keep (doc_id, _file, _row), n."""
    state = spark.read.format("statestore").load(checkpoint)
    keep, n = (state.schema["value"].dataType.fields[i].name for i in (0, 1))
    return state.select(F.col("key")["_digest"].alias("_digest"), F.col("value")[keep].alias("keep"), F.col("value")[n].alias("n"))


def prepared(docs: DataFrame, digest: Callable[[Column], Column]) -> DataFrame:
    return docs.withColumn("_digest", digest(F.coalesce("text", F.lit(""))))


class Dedup:
    """Decisions over the parquet table at ``path``, read by the stream and, for comparisons, by batch plans."""

    def __init__(self, spark: SparkSession, path: str, digest: Callable[[Column], Column] = sha, bytes_per_batch: int = 64 << 30, bits: int = BITS):
        path = path.rstrip("/")
        docs = spark.read.parquet(path)
        self.rows = prepared(boxed(docs), digest)
        source = spark.readStream.schema(docs.select("doc_id", "text").schema).option("maxBytesPerTrigger", str(bytes_per_batch))
        pattern = f"{path[:-1]}[{path[-1]}]"  # as a pattern, since a stream's plain path cannot be a single file
        stream = located(source.parquet(pattern)).select("doc_id", "text", "_file", "_row")
        checkpoint = shared_folder(spark, "exact-dedup")
        remember(prepared(stream, digest), checkpoint)
        self.state = recall(spark, checkpoint)
        self.flagged = may_be_in(self.rows, self.state.where("n > 1"), ["_digest"], bits)
        self._verified: DataFrame | None = None

    def verified(self) -> DataFrame:
        """Rows of digests that were hit: doc_id, locator, keep, n, same (full bytes equal those of the keeper), other (the text if not)."""
        if self._verified is None:
            near = self.flagged.where("_near").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "_digest", "_file", "_row")
            hits = self.state.where("n > 1")
            place = hits.select("_digest", F.col("keep._file").alias("_file"), F.col("keep._row").alias("_row"), "keep", "n")
            kept = near.join(place, ["_digest", "_file", "_row"]).select("_digest", F.col("text").alias("kept_text"), "keep", "n")
            same = F.col("text") == F.col("kept_text")
            self._verified = stored(near.join(kept, "_digest").select(
                "doc_id", "_file", "_row", "_digest", "keep", "n", same.alias("same"), F.when(~same, F.col("text")).alias("other")), "verified")
        return self._verified

    def decisions(self) -> DataFrame:
        """Every row of a digest that was hit: doc_id, _file, _row, keep, group_size."""
        v = self.verified()
        odd = v.where("not same")
        fewer = odd.groupBy("_digest").agg(F.count("*").alias("odd"))
        own = odd.groupBy("_digest", "other").agg(F.max(F.struct("doc_id", "_file", "_row")).alias("own"), F.count("*").alias("size"))
        same = v.where("same").join(fewer, "_digest", "left").select(
            "doc_id", "_file", "_row", "keep", (F.col("n") - F.coalesce("odd", F.lit(0))).alias("group_size"))
        return same.unionByName(odd.join(own, ["_digest", "other"]).select("doc_id", "_file", "_row", F.col("own").alias("keep"), F.col("size").alias("group_size")))

    def report(self) -> DataFrame:
        """One row per row of the table: doc_id, keep_id, group_size, kept, text_sha256."""
        rows = self.rows.select("doc_id", "_file", "_row", "_digest", sha(F.coalesce("text", F.lit(""))).alias("text_sha256"))
        single = rows.join(self.state.where("n = 1").select("_digest"), "_digest").select(
            "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
        kept = (F.col("_file") == F.col("keep._file")) & (F.col("_row") == F.col("keep._row"))
        groups = self.decisions().join(rows.drop("doc_id", "_digest"), ["_file", "_row"]).select(
            "doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size", kept.alias("kept"), "text_sha256")
        return single.unionByName(groups)

    def kept_rows(self) -> DataFrame:
        """The rows that stay, with all their columns.  Only rows that a hit may concern are shuffled."""
        kept = (F.col("_file") == F.col("keep._file")) & (F.col("_row") == F.col("keep._row"))
        gone = self.decisions().where(~kept).select("_file", "_row")
        rows = self.flagged.select("_file", "_row", "_near", "_user")
        near = rows.where("_near").join(gone, ["_file", "_row"], "left_anti").select("_user")
        return unboxed(rows.where("not _near").select("_user").unionByName(near))


def dedup_report(spark: SparkSession, path: str, **options) -> DataFrame:
    """Decisions for every row of the parquet table at ``path``."""
    return Dedup(spark, path, **options).report()


def dedup(docs: DataFrame, **options) -> DataFrame:
    """``docs`` without the rows whose text another kept row has.  The stream needs files: ``docs`` is stored first."""
    path = shared_folder(docs.sparkSession, "documents")
    docs.write.parquet(path)
    return Dedup(docs.sparkSession, path, **options).kept_rows()
