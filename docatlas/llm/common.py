"""Helpers shared by the operators: stored tables, id remainders, byte packing."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.errors import AnalysisException


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``; with a local master only, a temporary one where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="docatlas-")
    return f"{base}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, tidy: bool = False, batch: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here and survives lost executors.

    ``tidy``: shuffle files of this write go at its end, not when the driver collects its garbage.  ``batch``: rows that
    Python gets at a time; with long texts the usual 10,000 are much native memory on both sides of every task."""
    conf = df.sparkSession.conf
    own = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"} if tidy else {}
    if batch:
        own["spark.sql.execution.arrow.maxRecordsPerBatch"] = str(batch)
    path, old = shared_folder(df.sparkSession, name), {k: conf.get(k, None) for k in own}
    for k, v in own.items():
        conf.set(k, v)
    try:
        df.write.parquet(path)
    finally:
        for k, v in old.items():
            conf.unset(k) if v is None else conf.set(k, v)
    return df.sparkSession.read.parquet(path)


def remainder(k: int, column: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo ``k``; -1 for a null id, so that it belongs to no fold."""
    return F.coalesce((F.crc32(F.col(column).cast("string").cast("binary")) % k).cast("int"), F.lit(-1))


def texts(docs: DataFrame) -> DataFrame:
    """doc_id and text (null: empty) only, so that other columns cannot clash."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))


def share(seed: str, *columns: str) -> Column:
    """A number in [0, 1) that depends on the columns only: for repeatable samples."""
    return F.pmod(F.xxhash64(F.lit(seed), *columns), F.lit(1 << 40)) / F.lit(float(1 << 40))


def metadata(docs: DataFrame) -> Column:
    """The file metadata of ``docs``, also where a column of its own has that name; an error if it is no plain file scan."""
    return docs.metadataColumn("_metadata") if "_metadata" in docs.columns else F.col("_metadata")


def filed(docs: DataFrame) -> DataFrame:
    """``docs`` if its rows have a place in a file; else a stored copy, whose rows have."""
    try:
        docs.select(metadata(docs)["row_index"])
        return docs
    except AnalysisException:
        return stored(docs, "rows")


def located(docs: DataFrame) -> DataFrame:
    """``docs`` with the place of each row in its file (_file, _row).  What is not a plain file scan is stored first."""
    d = filed(docs)
    return d.withColumns({"_file": metadata(d)["file_path"], "_row": metadata(d)["row_index"]})


def boxed(docs: DataFrame) -> DataFrame:
    """doc_id, text, _file, _row and all columns of ``docs`` in one struct ``_user``, so that none can clash with an
    operator's own; ``unboxed`` takes them out again."""
    d = filed(docs)
    every = F.struct(*[F.col(f"`{c.replace('`', '``')}`") for c in d.columns])
    return d.select("doc_id", "text", metadata(d)["file_path"].alias("_file"), metadata(d)["row_index"].alias("_row"), every.alias("_user"))


def unboxed(d: DataFrame) -> DataFrame:
    return d.select("_user.*")


def vocabulary_file(name: str) -> str:
    """Where the installed package of public tokenizers has the file ``name``."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


#: Bits of a membership filter: at most BITS / 64 rows are broadcast, whatever the number of keys.
BITS = 1 << 22


def may_be_in(rows: DataFrame, keys: DataFrame, columns: list[str], bits: int = BITS) -> DataFrame:
    """``rows`` with ``_near``: false only if the values of ``columns`` are surely not among ``keys``.

    One bit per hash value; the filter is combined before its small shuffle.  A later join
    with ``keys`` need only shuffle the near rows."""
    slot, bit = F.pmod(F.xxhash64(*columns), F.lit(bits // 64)), F.pmod(F.xxhash64(F.lit(1), *columns), F.lit(64)).cast("int")
    words = (keys.select(slot.alias("_word"), bit.alias("_bit")).groupBy("_word")
             .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("_bit"))).alias("_bits")))
    d = rows.withColumns({"_word": slot, "_bit": bit}).join(F.broadcast(words), "_word", "left")
    return d.withColumn("_near", F.coalesce(F.getbit("_bits", F.col("_bit")) == 1, F.lit(False))).drop("_word", "_bit", "_bits")


def without(rows: DataFrame, gone: DataFrame, columns: list[str]) -> DataFrame:
    """``rows`` whose ``columns`` are not among those of ``gone``; only rows that may be gone are shuffled."""
    d = may_be_in(rows, gone, columns)
    near = d.where("_near").join(gone.select(*columns), columns, "left_anti")
    return d.where("not _near").unionByName(near).drop("_near")
