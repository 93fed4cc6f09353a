"""Joins of documents with per-key tables, with the keys of many documents packed together.

Exploding every word or fingerprint of a corpus into rows costs more than the text
itself.  Here the documents of one *chunk* (a stretch of rows of one file) ask for each
distinct key once: a *message* holds the keys of a run of rows that fall into one *bucket*
(a hash range of keys).  All messages of a bucket meet in one group, which sees every
distinct key of the bucket once, and the answers go back to the chunk, aligned with the
message by position.  Chunks are bounded in bytes and buckets in keys, both sized from
the data; a frequent key is in a message once per run, so no key makes a hot group.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docatlas.llm.common import located

CHUNK_BYTES = 4 << 20
BUCKET_BYTES = 16 << 20
MESSAGE = "bucket int, chunk long, lo long, hi long, payload binary"
#: The documents of a run travel in a message of this bucket.
DOCUMENTS = -1


def pack(*parts: bytes, level: int = 6) -> bytes:
    raw = struct.pack(f"<I{len(parts)}Q", len(parts), *map(len, parts)) + b"".join(parts)
    return struct.pack("<Q", len(raw)) + pa.Codec("zstd", compression_level=level).compress(raw, asbytes=True)


def narrow(numbers: np.ndarray) -> bytes:
    """Non-negative integers in the narrowest type that holds them."""
    kind = np.min_scalar_type(int(numbers.max())) if len(numbers) else np.dtype(np.uint8)
    return bytes([kind.itemsize]) + numbers.astype(kind).tobytes()


def widen(data: bytes) -> np.ndarray:
    return np.frombuffer(data, dtype=f"<u{data[0]}", offset=1).astype(np.int64)


def unpack(data: bytes) -> list[bytes]:
    raw = pa.decompress(memoryview(data)[8:], decompressed_size=struct.unpack_from("<Q", data)[0], codec="zstd", asbytes=True)
    n = struct.unpack_from("<I", raw)[0]
    sizes, at, out = struct.unpack_from(f"<{n}Q", raw, 4), 4 + 8 * n, []
    for size in sizes:
        out.append(raw[at:at + size])
        at += size
    return out


def word_list(words: pa.LargeBinaryArray) -> list[bytes]:
    """As ``to_pylist`` of an array without nulls, several times as fast."""
    ends = np.frombuffer(words.buffers()[1], dtype=np.int64)[words.offset:words.offset + len(words) + 1].tolist() if len(words) else [0]
    data = words.buffers()[2].to_pybytes() if words.buffers()[2] else b""
    return [data[a:b] for a, b in zip(ends, ends[1:])]


class Layout:
    """How many rows a chunk and how many buckets a table has, from its rows and bytes."""

    def __init__(self, docs: DataFrame):
        size = docs.agg(F.count("*").alias("rows"), F.sum(F.octet_length("text")).alias("bytes")).head()
        self.rows, self.bytes = size["rows"], size["bytes"] or 0
        mean = max(1, self.bytes // max(1, self.rows))
        self.chunk_rows = max(16, min(8192, CHUNK_BYTES // mean))
        self.buckets = 128
        while self.buckets * BUCKET_BYTES < self.bytes:
            self.buckets *= 2


def chunked(docs: DataFrame, layout: Layout) -> DataFrame:
    """chunk, row, doc_id, text (null: empty) of every row."""
    d = located(docs).select("doc_id", "text", "_file", "_row")
    chunk = F.xxhash64("_file", F.floor(F.col("_row") / layout.chunk_rows))
    return d.select(chunk.alias("chunk"), F.col("_row").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, int, pa.RecordBatch]]:
    """(chunk, first row, last row, rows) of neighbours of one chunk in a batch."""
    for batch in batches:
        chunks = batch.column(0).to_pylist()
        start = 0
        for i in range(1, len(chunks) + 1):
            if i == len(chunks) or chunks[i] != chunks[start]:
                part = batch.slice(start, i - start)
                yield chunks[start], part.column(1)[0].as_py(), part.column(1)[i - start - 1].as_py(), part
                start = i


def messages(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [()] * 5
    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["bucket", "chunk", "lo", "hi", "payload"])


def ask(d: DataFrame, keys: Callable[[list, list[str]], Iterator[tuple[int, bytes]]]) -> DataFrame:
    """One message per run and bucket; ``keys(doc_ids, texts)`` gives (bucket, payload)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, lo, hi, part in runs(batches):
            yield messages([(b, chunk, lo, hi, p) for b, p in keys(part.column(2).to_pylist(), part.column(3).to_pylist())])

    return d.mapInArrow(run, MESSAGE)


def answer(asked: DataFrame, reply: Callable[[list[bytes]], list[bytes]]) -> DataFrame:
    """Per bucket: one answer for each message, in the same order."""
    def group(table: pa.Table) -> pa.Table:
        out = reply(table["payload"].to_pylist())
        return table.drop_columns(["payload"]).append_column("payload", pa.array(out, pa.binary()))

    return asked.groupBy("bucket").applyInArrow(group, MESSAGE)


def documents(d: DataFrame) -> DataFrame:
    """The documents themselves as compressed messages."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, lo, hi, part in runs(batches):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, part.schema) as writer:
                writer.write_batch(pa.RecordBatch.from_arrays([pa.concat_arrays([c]) for c in part.columns], schema=part.schema))
            yield messages([(DOCUMENTS, chunk, lo, hi, pack(sink.getvalue().to_pybytes()))])

    return d.mapInArrow(run, MESSAGE)


def finish(docs: DataFrame, answers: DataFrame, work: Callable[..., pa.Table], schema: str, placed: bool = False) -> DataFrame:
    """``work(doc_ids, texts, answers by bucket)`` for every run that asked; ``placed``: its (chunk, first, last row) also,
    so that it can ask again.

    The documents of a chunk may have been split into runs differently than when they
    asked: rows are regrouped by the (first, last) row of the answers; runs without any
    answer are worked on with none."""
    def group(table: pa.Table) -> pa.Table:
        parts, asked = [], {}
        for b, lo, hi, payload in zip(*(table[c].to_pylist() for c in ("bucket", "lo", "hi", "payload"))):
            if b == DOCUMENTS:
                parts.append(pa.ipc.open_stream(unpack(payload)[0]).read_all())
            else:
                asked.setdefault((lo, hi), {})[b] = payload
        if not parts:
            return None
        rows = pa.concat_tables(parts).sort_by("row")
        number, ids, bodies = rows["row"].to_pylist(), rows["doc_id"].to_pylist(), rows["text"].to_pylist()
        place = {r: i for i, r in enumerate(number)}
        out, seen = [], set()
        for (lo, hi), got in sorted(asked.items()):
            at = [place[r] for r in range(lo, hi + 1) if r in place]
            seen.update(at)
            out.append(work([ids[i] for i in at], [bodies[i] for i in at], got, *([(table["chunk"][0].as_py(), lo, hi)] if placed else [])))
        rest = [i for i in range(len(ids)) if i not in seen]
        if rest and not placed:
            out.append(work([ids[i] for i in rest], [bodies[i] for i in rest], {}))
        return pa.concat_tables(out)

    return docs.unionByName(answers).groupBy("chunk").applyInArrow(group, schema)
