"""Operator 5: token-id shards in training order.

Documents are encoded, ended by the end-of-text id and cut into sequences of ``length``
ids (the last one filled up with that id).  All N sequences are numbered densely; a keyed
Feistel permutation with cycle-walking maps every number to its own slot in 0..N-1, so the
training order is fixed by (input, key) and needs no table.  Slots are range-partitioned
into shards of fixed stride: slot s lies in shard s // per_shard at byte
(s % per_shard) * stride, and any slot can be read, or reading resumed, by one seek.

* A shard is written by one task under a name of its own and moved to its place, so
  repeated or lost attempts leave the same file.  Shards go to the shared folder.
* Special tokens written out in a text are ordinary text here.  Null and empty texts are
  one sequence that holds only the end.  Every row is read whole; repeated rows give
  repeated sequences.  An empty table gives no shard and no row.
"""

from __future__ import annotations

import base64
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docatlas.llm.bpe import coded_words, places
from docatlas.llm.common import shared_folder, vocabulary_file
from docatlas.llm.packed import Layout, chunked, pack, runs, unpack, word_list

RANKS = "byte_bpe_50k.tiktoken"
#: Fixed value: the pre-tokenizer pattern of the public byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LENGTH = 256
SHARD_BYTES = 16 << 20
ROUNDS = 6
BROADCAST_RUNS = 100_000

_PLAIN = re.compile(r" [^\s]+")
_CODECS: dict[str, tuple] = {}


def codec(path: str):
    """(encoding, byte length of each id, end-of-text id) of a rank file."""
    if path not in _CODECS:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        sizes = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        sizes[list(ranks.values())] = list(map(len, ranks))
        _CODECS[path] = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), sizes, len(sizes)
    return _CODECS[path]


def encode_distinct(words: list[str], path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, n, ids): word i has the n[i] ids from first[i] on; plain words are encoded in one text and cut apart by their byte lengths."""
    encoding, sizes, _ = codec(path)
    first, n, parts, upto = np.zeros(len(words), dtype=np.int64), np.zeros(len(words), dtype=np.int64), [np.zeros(0, dtype=np.uint16)], 0
    plain = np.fromiter((_PLAIN.fullmatch(w) is not None for w in words), dtype=bool, count=len(words))
    for i in np.nonzero(~plain)[0].tolist():
        parts.append(np.array(encoding.encode_ordinary(words[i]), dtype=np.uint16))
        first[i], n[i] = upto, len(parts[-1])
        upto += len(parts[-1])
    plain = np.nonzero(plain)[0]
    for k in range(0, len(plain), 50_000):
        part = plain[k:k + 50_000]
        own = [words[i] for i in part.tolist()]
        ids = np.array(encoding.encode_ordinary("".join(own)), dtype=np.uint16)
        ends = np.searchsorted(np.cumsum(sizes[ids]), np.cumsum([len(w.encode()) for w in own])) + 1
        n[part] = np.diff(ends, prepend=0)
        first[part] = upto + ends - n[part]
        parts.append(ids)
        upto += len(ids)
    return first, n, np.concatenate(parts)


def permute(x: np.ndarray, n: int, key: int, inverse: bool = False) -> np.ndarray:
    """Keyed permutation of 0..n-1: Feistel rounds on the next even number of bits, walked on until inside."""
    half = np.uint64(max(1, ((max(2, n) - 1).bit_length() + 1) // 2))
    mask = (np.uint64(1) << half) - np.uint64(1)
    keys = [np.uint64((key * 0x9E3779B97F4A7C15 + r * 0xD1B54A32D192ED03 + 1) & 0xFFFFFFFFFFFFFFFF) for r in range(ROUNDS)]

    def f(v: np.ndarray, k: np.uint64) -> np.ndarray:
        v = (v ^ k) * np.uint64(0xBF58476D1CE4E5B9)
        v = (v ^ (v >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        return (v ^ (v >> np.uint64(32))) & mask

    def once(v: np.ndarray) -> np.ndarray:
        a, b = v >> half, v & mask
        for k in reversed(keys) if inverse else keys:
            a, b = (b ^ f(a, k), a) if inverse else (b, a ^ f(b, k))
        return (a << half) | b

    out = once(np.asarray(x, dtype=np.uint64))
    while (outside := out >= np.uint64(n)).any():
        out[outside] = once(out[outside])
    return out.astype(np.int64)


def sequences(docs: DataFrame, length: int, path: str) -> DataFrame:
    """Per run of documents: chunk, lo, n (sequences), payload (doc ids, tokens per document, ids)."""
    layout = Layout(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.uint16(codec(path)[2])
        for chunk, lo, _, part in runs(batches):
            per_text, codes, words = coded_words(part.column(3).to_pylist())
            first, n, flat = encode_distinct([w.decode() for w in word_list(words)], path)
            ends = np.append(0, np.cumsum(n[codes]))[np.cumsum(per_text)]
            counts = np.diff(ends, prepend=0) + 1
            tokens = np.insert(flat[places(first[codes], n[codes])], ends, end)
            ids = part.column(2)
            valid = np.array(ids.is_valid().to_pylist(), dtype=np.bool_)
            payload = pack(ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).tobytes(), valid.tobytes(), counts.tobytes(), tokens.tobytes(), level=9)
            yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([lo], pa.int64()), pa.array([int((-(-counts // length)).sum())], pa.int64()),
                                              pa.array([payload], pa.binary())], ["chunk", "lo", "n", "payload"])

    return chunked(docs, layout).mapInArrow(run, "chunk long, lo long, n long, payload binary")


def numbered(runs_: DataFrame) -> tuple[DataFrame, int]:
    """The runs with the number of their first sequence, and N.  Sums go by 4,096 ranges of chunk numbers."""
    d = runs_.withColumn("part", F.shiftrightunsigned("chunk", 52).cast("int"))
    totals = sorted((r["part"], r["n"]) for r in d.groupBy("part").agg(F.sum("n").alias("n")).collect())  # at most 4,096 rows
    firsts, at = [], 0
    for part, n in totals:
        firsts.append((part, at))
        at += n
    before = W.partitionBy("part").orderBy("chunk", "lo").rowsBetween(W.unboundedPreceding, -1)
    inside = d.select("part", "chunk", "lo", "n").withColumn("inside", F.coalesce(F.sum("n").over(before), F.lit(0)))
    starts = inside.join(F.broadcast(d.sparkSession.createDataFrame(firsts, "part int, base long")), "part").select("chunk", "lo", (F.col("base") + F.col("inside")).alias("first"))
    # a small list of runs is sent to the payloads; beyond that both are shuffled
    few = runs_.select("chunk").count() <= BROADCAST_RUNS
    return runs_.join(F.broadcast(starts) if few else starts, ["chunk", "lo"]), at


def target(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder)


def write_shards(docs: DataFrame, folder: str | None = None, key: int = 20_240_601, length: int = LENGTH, path: str | None = None) -> DataFrame:
    """Write the shards below ``folder``; one row per sequence: doc_id, seq_no, n_tokens, slot, shard, byte_offset, ids_crc32.

    ``shard`` names the file (``shard-<number>.bin``); shards are written when the result is computed."""
    spark = docs.sparkSession
    path = path or vocabulary_file(RANKS)
    folder = folder or shared_folder(spark, "shards")
    store = shared_folder(spark, "sequences")
    sequences(docs, length, path).write.option("compression", "uncompressed").parquet(store)  # payloads are compressed already
    d, total = numbered(spark.read.parquet(store))
    stride = 2 * length
    per_shard = max(1, SHARD_BYTES // stride)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fill = codec(path)[2]
        for batch in batches:
            for first, payload in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids, valid, counts, flat = unpack(payload.as_py())
                counts, tokens = np.frombuffer(counts, dtype=np.int64), np.frombuffer(flat, dtype=np.uint16)
                per_doc = -(-counts // length)
                n = int(per_doc.sum())
                owner = np.repeat(np.arange(len(counts)), per_doc)
                number = np.arange(n) - np.repeat(np.cumsum(per_doc) - per_doc, per_doc)
                starts = (np.cumsum(counts) - counts)[owner] + number * length
                held = np.minimum(length, counts[owner] - number * length)
                rows = np.full((n, length), fill, dtype=np.uint16)
                inside = np.arange(length) < held[:, None]
                rows[inside] = tokens[(starts[:, None] + np.arange(length))[inside]]
                slot = permute(np.arange(first, first + n), total, key)
                meta = np.stack([slot, np.frombuffer(ids, dtype=np.int64)[owner], np.frombuffer(valid, dtype=np.bool_)[owner].astype(np.int64), number, held], axis=1)
                shard = slot // per_shard
                order = np.argsort(shard, kind="stable")
                cuts = np.append(np.nonzero(np.diff(shard[order]))[0] + 1, n)
                out = [(int(shard[order[a]]), pack(meta[order[a:b]].tobytes(), rows[order[a:b]].tobytes(), level=9)) for a, b in zip(np.append(0, cuts[:-1]), cuts)]
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.binary())], ["shard", "payload"])

    def write(table: pa.Table) -> pa.Table:
        shard = table["shard"][0].as_py()
        parts = [unpack(p.as_py()) for p in table["payload"]]
        meta = np.concatenate([np.frombuffer(m, dtype=np.int64).reshape(-1, 5) for m, _ in parts])
        rows = np.concatenate([np.frombuffer(r, dtype=np.uint16).reshape(-1, length) for _, r in parts])
        order = np.argsort(meta[:, 0])
        meta, rows = meta[order], rows[order]
        first = shard * per_shard
        if not np.array_equal(meta[:, 0], np.arange(first, min(total, first + per_shard))):
            raise ValueError(f"shard {shard} is not complete")
        system, place = target(folder)
        system.create_dir(place, recursive=True)
        name = f"{place}/shard-{shard:08d}.bin"
        own = f"{place}/.{uuid.uuid4().hex}"
        with system.open_output_stream(own) as f:
            f.write(rows.tobytes())
        system.move(own, name)
        doc = pa.array(meta[:, 1], mask=meta[:, 2] == 0)
        return pa.table({"doc_id": doc, "seq_no": pa.array(meta[:, 3]), "n_tokens": pa.array(meta[:, 4]), "slot": pa.array(meta[:, 0]),
                         "shard": pa.array([shard] * len(meta), pa.int64()), "byte_offset": pa.array((meta[:, 0] - first) * stride)})

    return d.select("first", "payload").mapInArrow(deal, "shard long, payload binary").groupBy("shard").applyInArrow(
        write, "doc_id long, seq_no long, n_tokens long, slot long, shard long, byte_offset long")


def read(folder: str, start: int = 0, length: int = LENGTH, block: int = 1024) -> Iterator[np.ndarray]:
    """Blocks of sequences in training order from slot ``start`` on, until a shard is missing or short."""
    system, place = target(folder)
    stride = 2 * length
    per_shard = max(1, SHARD_BYTES // stride)
    while True:
        name = f"{place}/shard-{start // per_shard:08d}.bin"
        if system.get_file_info(name).type != fs.FileType.File:
            return
        with system.open_input_file(name) as f:
            f.seek(start % per_shard * stride)
            while data := f.read(block * stride):
                rows = np.frombuffer(data, dtype=np.uint16).reshape(-1, length)
                start += len(rows)
                yield rows
        if start % per_shard:
            return
