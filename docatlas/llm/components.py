"""Connected components of an edge table.

Rounds of two steps, until all that is left are stars around the smallest vertices:
every vertex ties its larger neighbours to its smallest one (a join with one row per
vertex), then the edges of one partition, dealt by the larger vertex, are contracted to
stars by union-find.  A round is written to the shared folder, so lineage stays short and a
lost executor costs one round.  A task holds the edges of its partition only."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docatlas.llm.common import stored

EDGE = "a long, b long"
BLOCK = 1 << 20


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(vertex, smallest vertex of its component) for all but the smallest ones, of the graph with these edges."""
    names, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = flat[:len(a)], flat[len(a):]
    root = np.arange(len(names))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        while (up := new[new]).tobytes() != new.tobytes():
            new = up
        if (new == root).all():
            break
        root = new
    inner = np.nonzero(root != np.arange(len(names)))[0]
    return names[inner], names[root[inner]]


def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stars of the edges of a partition; held edges are contracted whenever a block of them has come."""
    a, b, more = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), 0
    for batch in batches:
        a, b = np.append(a, batch.column(0).to_numpy()), np.append(b, batch.column(1).to_numpy())
        more += batch.num_rows
        if more > BLOCK:
            (a, b), more = stars(a, b), 0
    if len(a):
        a, b = stars(a, b)
    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def components(edges: DataFrame, batch: int | None = None) -> DataFrame:
    """``edges(a long, b long)`` -> vertex, root (smallest vertex of its component), for every vertex of an edge.

    ``batch``: rows that Python gets at a time where ``edges`` are made (see ``stored``)."""
    e = stored(edges.select("a", "b").mapInArrow(contract, EDGE), "edges", batch=batch)
    while True:
        ends = e.select(F.col("a").alias("v"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
            e.select(F.col("b").alias("v"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        open_ = ends.groupBy("v").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or (up > 0 and down > 0)")
        if not open_.take(1):
            break
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        tied = both.join(low, "a").where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = stored(tied.repartition("a").mapInArrow(contract, EDGE), "edges")
    return e.select(F.col("a").alias("vertex"), F.col("b").alias("root")).unionByName(e.select(F.col("b").alias("vertex"), F.col("b").alias("root")).distinct())
