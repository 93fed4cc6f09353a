"""Operator 12: near-duplicate vectors of one label, by sorted projection passes.

In every pass a vector's key is the concatenation of ``BITS`` random hashes (the sides of random
planes).  Vectors are ordered by (label, key), lexicographically, and each is compared with its
``WINDOW`` next neighbours in that order; pairs whose cosine reaches the threshold are links, and
the links of all passes are united.  A pair is surely met in a pass if its keys agree on the
first log2(n / WINDOW) hashes of a label of n vectors, so the number of passes follows from n:
a pair at the threshold is met with probability ``RECALL`` in at least one, closer pairs more often.

* Equal vectors of a label are one vector with a weight.  The order is a range sort whose rows are
  numbered through; numbers are cut into blocks of 16 windows, each with one window of the next
  block, so that no window ends at a partition and no label makes a large task.
* A window is bounded, a group of copies is not.  A vector with over ``LINKS`` links in one block
  sends no list of them, but is marked dense, and the whole component around it is counted exactly: all
  vectors within half the threshold's angle of the component's mean link with each other, which needs no comparison;
  the others are compared with every vector of the component, block by block.  Components are connected
  by stars (a union-find inside each block), never by all pairs.  A component that is large,
  dense and wide costs the square of its vectors outside the core.

Nulls, odd rows: a null label, a vector that is null, empty, zero or that holds null or non-finite
numbers links with nothing, nor do vectors of different lengths.  Rows that repeat a vec_id are rows of their own;
a null vec_id counts as a link of others, but is nobody's component_id unless no other is
there.  Other columns are not read, so that their names cannot clash; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docatlas.llm.common import located, stored
from docatlas.llm.components import components, stars
from docatlas.llm.packed import pack, unpack

THRESHOLD = 0.93
WINDOW = 256
LINKS = 64
BITS = 62
RECALL = 0.995
SEED = 12
#: Vectors of a dense component that are compared at a time.
TILE = 512


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length 1 in double precision; scaled first, so that no square overflows or vanishes."""
    rows = rows.astype(np.float64)
    rows /= np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def planes(no: int, size: int) -> np.ndarray:
    return np.random.default_rng([SEED, no, size]).standard_normal((size, BITS))


def passes(largest: int, threshold: float = THRESHOLD, window: int = WINDOW, recall: float = RECALL) -> int:
    """Passes until a pair at the threshold, in a label of ``largest`` vectors, is met with probability ``recall``."""
    same_side = 1 - math.acos(threshold) / math.pi
    met = same_side ** max(0.0, math.log2(max(largest, 1) / window))
    return 1 if met >= 1 else math.ceil(math.log(1 - recall) / math.log(1 - met))


# ------------------------------------------------------------------ vectors


def vectors(embeddings: DataFrame) -> DataFrame:
    """vec_id, key (of label and vector; null if the vector can have no link), label, vec (doubles as bytes) of every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label, column = batch.column(1).to_pylist(), batch.column(2)
            keys, packed = [], []
            for i in range(batch.num_rows):
                x = column[i].values if label[i] is not None and column[i].is_valid else None
                x = x.to_numpy(zero_copy_only=False).astype("<f8") if x is not None and x.null_count == 0 else np.zeros(0)
                good = len(x) and np.isfinite(x).all() and x.any()
                data = x.tobytes() if good else None
                keys.append(hashlib.blake2b(data + label[i].encode(), digest_size=16).digest() if good else None)
                packed.append(data)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), batch.column(1), pa.array(packed, pa.binary())],
                                             ["vec_id", "key", "label", "vec"])

    d = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"),
                          F.col("embedding").cast("array<double>").alias("embedding"))
    return d.mapInArrow(run, "vec_id long, key binary, label string, vec binary")


def classes(v: DataFrame) -> DataFrame:
    """One row per distinct vector of a label: cid (a number), key, low (smallest vec_id), weight (rows), label, vec."""
    c = v.where("key is not null").groupBy("key").agg(F.min("vec_id").alias("low"), F.count("*").alias("weight"),
                                                     F.first("label").alias("label"), F.first("vec").alias("vec"))
    c = stored(c, "vectors")
    return stored(c.select(F.monotonically_increasing_id().alias("cid"), "*"), "vector-classes")


# ------------------------------------------------------------------ passes


def keyed(c: DataFrame, count: int) -> DataFrame:
    """cid, part (pass, label and vector length), hashes of every vector in every pass."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = 1 << np.arange(BITS - 1, -1, -1, dtype=np.int64)
        for batch in batches:
            cids, labels, vecs = (col.to_pylist() for col in batch.columns)
            sizes = np.array([len(x) // 8 for x in vecs])
            for size in np.unique(sizes).tolist():
                at = np.nonzero(sizes == size)[0]
                rows = np.frombuffer(b"".join(vecs[i] for i in at), "<f8").reshape(-1, size)
                for no in range(count):
                    hashes = ((rows @ planes(no, size)) > 0) @ powers
                    yield pa.RecordBatch.from_arrays([
                        pa.array([cids[i] for i in at], pa.int64()), pa.array([f"{no:04d} {size} {labels[i]}" for i in at]), pa.array(hashes)], ["cid", "part", "hashes"])

    return c.select("cid", "label", "vec").mapInArrow(run, "cid long, part string, hashes long")


def numbered(keys: DataFrame) -> DataFrame:
    """cid, part, place: the number of each row in the order of (part, hashes, cid)."""
    order = ["part", "hashes", "cid"]
    rows = located(stored(keys.repartitionByRange(*order).sortWithinPartitions(*order), "passes"))
    files = rows.groupBy("_file").agg(F.min(F.struct(*order)).alias("least"), F.count("*").alias("n"))
    before = F.sum("n").over(W.orderBy("least").rowsBetween(W.unboundedPreceding, -1))
    offsets = files.select("_file", F.coalesce(before, F.lit(0)).alias("offset"))
    return rows.join(F.broadcast(offsets), "_file").select("cid", "part", (F.col("offset") + F.col("_row")).alias("place"))


def linked(units: np.ndarray, places: np.ndarray, own: int, window: int, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j) of linked rows less than a window apart, i among the first ``own`` rows; rows are sorted by place."""
    for low in range(0, own, window):
        high = min(low + window, own)
        ahead = units[low + 1:high + window]
        if len(ahead):
            i, j = np.nonzero(units[low:high] @ ahead.T >= threshold)
            i, j = i + low, j + low + 1
            fits = (j > i) & (places[j] - places[i] <= window)
            yield i[fits], j[fits]


def compare(window: int, threshold: float, links: int):
    """Group function over the rows of a block: kind 0 stars, 1 links (a to b, with b's weight), 2 dense vectors."""
    def group(table: pa.Table) -> pa.Table:
        table = table.sort_by("place")
        block, places, cids, weights, parts = (table[c].to_numpy() for c in ("block", "place", "cid", "weight", "part"))
        vecs = table["vec"].to_pylist()
        out = [[np.zeros(0, np.int64)] * 4]
        starts = np.nonzero(np.append(True, parts[1:] != parts[:-1]))[0].tolist()
        for low, high in zip(starts, [*starts[1:], len(parts)]):
            own = int((places[low:high] // (16 * window) == block[low:high]).sum())
            units = unit(np.frombuffer(b"".join(vecs[low:high]), "<f8").reshape(high - low, -1))
            found = [np.concatenate(x) for x in zip(*linked(units, places[low:high], own, window, threshold))]
            if not found or not len(found[0]):
                continue
            i, j = found
            names, held = cids[low:high], weights[low:high]
            a, root = stars(names[i], names[j])
            out.append([np.zeros_like(a), a, root, a])
            i, j = np.concatenate([i, j]), np.concatenate([j, i])
            dense = np.bincount(i, minlength=high - low) > links
            marked = names[dense]
            out.append([np.full_like(marked, 2), marked, marked, marked])
            some = ~dense[i]
            out.append([np.ones(int(some.sum()), np.int64), names[i[some]], names[j[some]], held[j[some]]])
        return pa.table([pa.array(np.concatenate(x), pa.int64()) for x in zip(*out)], names=["kind", "a", "b", "weight"])

    return group


def met(c: DataFrame, count: int, window: int, threshold: float, links: int) -> DataFrame:
    """What the windows of all passes give (see ``compare``)."""
    size = 16 * window
    rows = numbered(keyed(c, count)).join(c.select("cid", "weight", "vec"), "cid")
    block, inside = F.floor(F.col("place") / size), F.col("place") % size
    blocks = F.when((inside < window) & (block > 0), F.array(block, block - 1)).otherwise(F.array(block))
    spread = rows.withColumn("block", F.explode(blocks))
    return stored(spread.groupBy("block").applyInArrow(compare(window, threshold, links), "kind long, a long, b long, weight long"), "vector-links")


# ------------------------------------------------------------------ dense components


def means(members: DataFrame) -> DataFrame:
    """root, mean (sum of the unit vectors as bytes): one row per partition and component is shuffled."""
    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for root, vec in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                x = unit(np.frombuffer(vec, "<f8")[None])[0]
                sums[root] = sums[root] + x if root in sums else x
        yield pa.RecordBatch.from_arrays([pa.array(sums.keys(), pa.int64()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["root", "mean"])

    def whole(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, "<f8") for x in table["mean"].to_pylist())
        return pa.table([table["root"][:1], pa.array([total.tobytes()], pa.binary())], names=["root", "mean"])

    return members.select("root", "vec").mapInArrow(part, "root long, mean binary").groupBy("root").applyInArrow(whole, "root long, mean binary")


def cored(members: DataFrame, threshold: float) -> DataFrame:
    """``members`` with core: within half the threshold's angle of the mean (and a margin far above rounding)."""
    least = math.cos(math.acos(threshold) / 2) + 1e-9

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            core = []
            for vec, mean in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist()):
                x, y = unit(np.frombuffer(vec, "<f8")[None])[0], np.frombuffer(mean, "<f8")
                core.append(bool(y.any() and x @ unit(y[None])[0] >= least))
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(core, pa.bool_())], ["root", "cid", "weight", "vec", "core"])

    both = members.join(means(members), "root").select("root", "cid", "weight", "vec", "mean")
    return both.mapInArrow(run, "root long, cid long, weight long, vec binary, core boolean")


def tiles(rows: DataFrame, sizes: DataFrame, size: str, name: str) -> DataFrame:
    """root and a packed tile of about TILE rows."""
    def group(table: pa.Table) -> pa.Table:
        parts = [table[c].to_numpy().astype(np.int64).tobytes() for c in ("cid", "weight", "core")]
        return pa.table([table["root"][:1], pa.array([pack(*parts, b"".join(table["vec"].to_pylist()))], pa.binary())], names=["root", name])

    no = F.pmod(F.xxhash64("cid"), F.ceil(F.col(size) / TILE)).cast("long")
    return (rows.join(sizes, "root").select("root", "cid", "weight", F.col("core").cast("long").alias("core"), "vec", no.alias("no"))
            .groupBy("root", "no").applyInArrow(lambda table: group(table), f"root long, {name} binary"))


def compared(threshold: float):
    """(tile outside the core, tile of all) -> links of the former, and of core members with the former."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pair in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                (a, wa, _, x), (b, wb, core, y) = ([np.frombuffer(p, np.int64) for p in parts[:3]] + [parts[3]] for parts in map(unpack, pair))
                x, y = (unit(np.frombuffer(v, "<f8").reshape(n, -1)) for v, n in ((x, len(a)), (y, len(b))))
                link = (x @ y.T >= threshold) & (a[:, None] != b[None])
                inner = core > 0
                names, counts = np.concatenate([a, b[inner]]), np.concatenate([link @ wb, wa @ link[:, inner]])
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(counts, pa.int64())], ["cid", "n"])

    return run


def dense_links(c: DataFrame, roots: DataFrame, found: DataFrame, threshold: float) -> DataFrame:
    """cid, n: exact links (rows) of every vector of a component that has a dense one."""
    marked = found.where("kind = 2").select(F.col("a").alias("vertex")).distinct()
    wide = roots.join(marked, "vertex").select("root").distinct()
    members = stored(roots.join(wide, "root").withColumnRenamed("vertex", "cid").join(c.select("cid", "weight", "vec"), "cid"), "dense")
    d = stored(cored(members, threshold), "dense-cores")
    sizes = d.groupBy("root").agg(F.count("*").alias("n_all"), F.sum(F.when(~F.col("core"), 1)).alias("n_out"), F.sum(F.when(F.col("core"), F.col("weight"))).alias("inner"))
    out = sizes.where("n_out > 0")
    outside = tiles(d.where("not core"), out.select("root", "n_out"), "n_out", "outside")
    every = tiles(d, out.select("root", "n_all"), "n_all", "every")
    counted = outside.join(every, "root").select("outside", "every").mapInArrow(compared(threshold), "cid long, n long").groupBy("cid").agg(F.sum("n").alias("more"))
    inner = F.when(F.col("core"), F.col("inner") - 1).otherwise(F.col("weight") - 1)
    return d.join(sizes, "root").join(counted, "cid", "left").select("cid", (inner + F.coalesce("more", F.lit(0))).alias("n"))


# ------------------------------------------------------------------ interface


def near_duplicates(embeddings: DataFrame, threshold: float = THRESHOLD, window: int = WINDOW, links: int = LINKS, recall: float = RECALL) -> DataFrame:
    """vec_id, n_links (other rows linked directly), component_id (smallest vec_id reachable), kept, one row per row of
    ``embeddings`` (vec_id, embedding, label)."""
    rows = stored(vectors(embeddings).select("vec_id", "key", "label", "vec"), "embeddings")
    c = classes(rows)
    sizes = c.groupBy("label", F.octet_length("vec").alias("size")).count()
    count = passes(sizes.agg(F.max("count")).head()[0] or 0, threshold, window, recall)
    found = met(c, count, window, threshold, links)
    roots = stored(components(found.where("kind = 0").select("a", "b")), "vector-roots")
    listed = found.where("kind = 1").dropDuplicates(["a", "b"]).groupBy(F.col("a").alias("cid")).agg(F.sum("weight").alias("listed"))
    exact = dense_links(c, roots, found, threshold)
    own = c.select("cid", "key", "low", "weight").join(roots.withColumnRenamed("vertex", "cid"), "cid", "left").join(listed, "cid", "left").join(exact, "cid", "left")
    own = stored(own.withColumn("root", F.coalesce("root", "cid")).withColumn(
        "n_links", F.coalesce("n", F.coalesce("listed", F.lit(0)) + F.col("weight") - 1)).select("key", "root", "low", "n_links"), "vector-counts")
    low = own.groupBy("root").agg(F.min("low").alias("component_id"))
    named = own.join(low, "root").select("key", "n_links", "component_id")
    single = rows.where("key is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    both = rows.where("key is not null").select("vec_id", "key").join(named, "key").select("vec_id", "n_links", "component_id")
    return both.unionByName(single).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
