"""Operator 6: benchmark decontamination by spaced-seed hashing.

Fixed masks ignore some positions of a token window, so that substituted words do not
hide an overlap: for every length of items, each set of places that may differ is left
out by some mask at some place, so no overlap is lost.  Masked windows of the benchmark and of the documents are hashed and
joined; the two token sequences are then compared position by position on the diagonals
that have hits.  A document row is contaminated by an item if on such a diagonal some
window of ``window`` tokens (the whole item if it is shorter) agrees in at least ``share``
of its positions.  DataFrame operations only.

* Tokens are maximal runs of letters and digits, lower-cased.
* Masks for items shorter than ``window`` are added only if the benchmark has such items;
  items and documents without tokens match nothing.  Null text counts as empty.
* The hashed benchmark is broadcast only up to ``broadcast_rows`` rows; beyond that, a
  bounded bit filter thins the document windows and the rest is joined by shuffle.
* Repeated item ids are treated as one item with several texts; repeated document rows
  are judged one by one.  Long texts are read whole.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docatlas.llm.common import boxed, located, may_be_in, stored, unboxed, without

#: Fixed masks; 1 = position is compared.
MASKS = ("11101011", "110110011", "1011010101")
WINDOW = 13
SHARE = 0.8
BROADCAST_ROWS = 500_000


def covering(lengths: list[int], window: int, share: float) -> dict[str, set[int]]:
    """Masks beside MASKS, each with the lengths of items that need it: every set of places that may differ is left out by a mask."""
    more: dict[str, set[int]] = {}
    for n in lengths:
        own = [{q + k for k, bit in enumerate(m) if bit == "1"} for m in MASKS for q in range(n - len(m) + 1)]
        for gone in itertools.combinations(range(n), n - math.ceil(n * share)):
            if not any(places.isdisjoint(gone) for places in own):
                mask = "".join("0" if k in gone else "1" for k in range(n)).strip("0")
                own += [{q + k for k, bit in enumerate(mask) if bit == "1"} for q in range(n - len(mask) + 1)]
                more.setdefault(mask, set()).add(n)
    return more


def token_hashes(text: Column) -> Column:
    tokens = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda t: t != "")
    return F.transform(tokens, lambda t: F.xxhash64(t))


def masked(h: str, at: Column, number: int, mask: str) -> Column:
    """Hash of the compared positions of the window that starts at ``at``; positions behind the end are skipped."""
    return F.xxhash64(F.lit(number), *[F.get(F.col(h), at + k) for k, bit in enumerate(mask) if bit == "1"])


def window_keys(h: str, masks: list[str]) -> Column:
    """All masked hashes: position p and mask m stand at p * len(masks) + m."""
    last = F.size(h) - min(map(len, masks))
    starts = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    return F.flatten(F.transform(starts, lambda p: F.array(*[masked(h, p, k, m) for k, m in enumerate(masks)])))


def overlaps(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: float = SHARE, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(_place, _row, doc_id, item_id, matched, compared): the best overlap of each contaminated row with each item.

    ``docs`` has _file, _row, doc_id, text; _place stands for the file."""
    items = benchmark.select("item_id", token_hashes(F.col("text")).alias("g")).where(F.size("g") > 0).withColumn("item", F.xxhash64("g"))
    compared = F.least(F.lit(window), F.size("g"))
    lengths = sorted(r[0] for r in items.select(compared).distinct().collect())  # at most ``window`` numbers
    more = covering(lengths, window, share)
    masks = [*MASKS, *more]
    m = F.lit(len(masks))
    # outer explodes: plain ones would have their arrays computed twice, once to filter by size
    seeds = items.dropDuplicates(["item"]).select("item", F.size("g").alias("n"), F.posexplode_outer(window_keys("g", masks)).alias("i", "key"))
    span = F.element_at(F.array(*[F.lit(len(x)) for x in masks]), (F.col("i") % m) + 1)
    needed = F.element_at(F.array(*[F.array(*map(F.lit, sorted(more.get(x, lengths or [0])))) for x in masks]), (F.col("i") % m) + 1)
    fits = (F.floor(F.col("i") / m) + span <= F.col("n")) & F.array_contains(needed, F.least(F.lit(window), F.col("n")))
    seeds = seeds.where(F.col("key").isNotNull() & fits).select("item", "key", F.floor(F.col("i") / m).cast("int").alias("q"))

    place = docs.select(F.xxhash64("_file").alias("_place"), "_row", "doc_id", "text")
    d = place.select("_place", "_row", token_hashes(F.col("text")).alias("h"))
    d = d.select("_place", "_row", F.posexplode_outer(window_keys("h", masks)).alias("i", "key"))
    if seeds.count() <= broadcast_rows:
        hits = d.join(F.broadcast(seeds), "key")
    else:
        near = may_be_in(d, seeds, ["key"]).where("_near").drop("_near")
        hits = near.join(seeds, "key")
    # all hits of one diagonal are one comparison
    lines = stored(hits.select("_place", "_row", "item", (F.floor(F.col("i") / m).cast("int") - F.col("q")).alias("shift")).distinct(), "seed-hits")
    near = may_be_in(place, lines, ["_place", "_row"]).where("_near").select("_place", "_row", "doc_id", token_hashes(F.col("text")).alias("h"))
    pairs = lines.join(near, ["_place", "_row"]).join(items, "item")

    size = F.least(F.lit(window), F.size("g"))

    def agree(s: Column) -> Column:
        same = lambda i: F.coalesce(F.get("g", i) == F.when(i + F.col("shift") >= 0, F.get("h", i + F.col("shift"))), F.lit(False))
        return F.size(F.filter(F.sequence(s, s + size - 1), same))

    best = F.array_max(F.transform(F.sequence(F.lit(0), F.size("g") - size), agree))
    found = pairs.select("_place", "_row", "doc_id", "item_id", best.alias("matched"), size.alias("compared"))
    found = found.where(F.col("matched") >= F.ceil(F.col("compared") * F.lit(share)))
    return found.groupBy("_place", "_row", "doc_id", "item_id").agg(F.max("matched").alias("matched"), F.max("compared").alias("compared"))


def contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """doc_id, item_id, matched, compared: one row per contaminated document row and item."""
    return overlaps(located(docs.select("doc_id", "text")), benchmark, **options).select("doc_id", "item_id", "matched", "compared")


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that overlap with no item, all columns kept, whatever their names."""
    d = boxed(docs)
    gone = stored(overlaps(d, benchmark, **options).select("_place", "_row").distinct(), "contaminated")
    return unboxed(without(d.select(F.xxhash64("_file").alias("_place"), "_row", "_user"), gone, ["_place", "_row"]))
