"""Operator 11: periodic runs of words, by a dictionary of basic factors.

The basic factors of a text are its word sequences of 1, 2, 4, ... words.  Equal factors of
one length share a name; names of length 2m come from the pairs of names m words apart.  The
next occurrence (successor) of a factor that begins d <= m words later overlaps or touches it:
such occurrences lie in arithmetic progressions, and every progression proposes the period d.
A run of smallest period q, m/2 < q <= m, is found at length m: a factor of q or more words of
a run returns after exactly q words and not before, so the run's positions form one unbroken
stretch with the successor distance q.  The stretch is extended as far as words q apart are
equal and kept if it is long enough; equal (start, period) pairs are kept once.  With
``exponent`` >= 3 every run is at least m + q words long, so that none is missed.

Names are dropped as soon as a factor is alone in its text, for then all longer ones there are
too: ordinary text is done after a few lengths.  All texts of a block (about ``BLOCK`` words,
or one longer text) are named together; a name never spans texts.  Nothing is shuffled.

Nulls, odd rows: a null or empty text, or one without words, has no run, and its collapsed
text is empty; a null doc_id is kept, and is not damaged by ``damaged``; repeated rows are
rows of their own; other columns are not read, so that their names cannot clash; an empty
table gives no rows.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from docatlas.llm.common import texts

LEAST, EXPONENT = 6, 4
BLOCK = 1 << 18
#: Rows of an Arrow batch that are turned into Python texts at a time.
ROWS = 256
RUN = "array<struct<start:long,length:long,period:long>>"


def words_of(text: str) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+``: bytes.split cuts at just these six characters."""
    return text.encode().split()


def proposals(names: np.ndarray, spare: np.ndarray, top: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(first position, last position, period) of each stretch of one successor distance.

    ``names``: equal for equal words of one text; ``spare``: words from here to the end of the text; ``top``: words of the longest text."""
    at, name, m = np.arange(len(names)), names, 1
    full = np.full(len(names), -1, dtype=np.int64)
    while len(at):
        order = np.argsort(name, kind="stable")
        ranked = name[order]
        same = ranked[1:] == ranked[:-1]
        later = np.full(len(at), -1, dtype=np.int64)
        later[order[:-1][same]] = at[order[1:][same]]
        distance = np.where(later >= 0, later - at, 0)
        hit = np.nonzero((distance <= m) & (2 * distance > m))[0]
        if len(hit):
            i, d = at[hit], distance[hit]
            cut = np.nonzero((np.diff(i) != 1) | (np.diff(d) != 0))[0] + 1
            low, high = np.append(0, cut), np.append(cut, len(i)) - 1
            yield i[low], i[high] + m + d[low] - 1, d[low]
        if 4 * m > 2 * top:
            return
        shared = np.zeros(len(at), dtype=bool)
        shared[order[:-1][same]] = True
        shared[order[1:][same]] = True
        full[:] = -1
        full[at[shared]] = (np.cumsum(np.append(False, ~same)))[np.argsort(order)][shared]
        at = at[shared & (spare[at] >= 2 * m)]
        second = full[at + m] if len(at) else at
        at, second = at[second >= 0], second[second >= 0]
        name, m = full[at] * (len(names) + 1) + second, 2 * m


def find_runs(words: np.ndarray, offsets: np.ndarray, least: int = LEAST, exponent: int = EXPONENT) -> list[list[tuple[int, int, int]]]:
    """Per text the runs (start, length, period) by start, then period.  ``words``: numbers of all words, ``offsets``: where texts begin and end."""
    if exponent < 3:
        raise ValueError("runs are found from an exponent of 3 on")
    out = [[] for _ in range(len(offsets) - 1)]
    if not len(words):
        return out
    sizes = np.diff(offsets)
    text = np.repeat(np.arange(len(sizes)), sizes)
    spare = offsets[1:][text] - np.arange(len(words))
    found = set()
    for first, last, period in proposals(text * (int(words.max()) + 1) + words, spare, int(sizes.max())):
        low, high = offsets[text[first]], offsets[text[first] + 1] - 1
        while len(more := np.nonzero((first > low) & (words[first - 1] == words[np.minimum(first - 1 + period, len(words) - 1)]))[0]):
            first[more] -= 1
        while len(more := np.nonzero((last < high) & (words[np.minimum(last + 1, len(words) - 1)] == words[last + 1 - period]))[0]):
            last[more] += 1
        long_ = last - first + 1 >= np.maximum(least, exponent * period)
        found.update(zip(first[long_].tolist(), (last - first + 1)[long_].tolist(), period[long_].tolist()))
    for start, length, period in sorted(found, key=lambda r: (r[0], r[2])):
        k = text[start]
        out[k].append((int(start - offsets[k]), length, period))
    return out


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """False for words that a run holds after its first period."""
    kept = np.ones(n, dtype=bool)
    for start, length, period in runs:
        kept[start + period:start + length] = False
    return kept


def blocks(rows: Iterator[tuple], change: Callable | None, limits: dict) -> Iterator[tuple[list, list[list[bytes]], list]]:
    """(doc_ids, words, runs) of about BLOCK words at a time, of rows of (doc_id, text)."""
    def done():
        number = {}
        flat = np.array([number.setdefault(w, len(number)) for ws in held for w in ws], dtype=np.int64)
        return owners, held, find_runs(flat, np.cumsum([0, *map(len, held)]), **limits)

    owners, held, size = [], [], 0
    for i, body in rows:
        words = words_of(body)
        if change is not None:
            words = change(i, words)
        if held and size + len(words) > BLOCK:
            yield done()
            owners, held, size = [], [], 0
        owners.append(i)
        held.append(words)
        size += len(words)
    if held:
        yield done()


def over(docs: DataFrame, schema: str, row: Callable, change: Callable | None = None, **limits: int) -> DataFrame:
    """``row(doc_id, words, runs)`` of every document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (x for batch in batches for k in range(0, batch.num_rows, ROWS)
                for x in zip(*(c.to_pylist() for c in batch.slice(k, ROWS).columns)))
        for block in blocks(rows, change, limits):
            made = [row(*x) for x in zip(*block)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made), kinds)], names)

    fields = StructType.fromDDL(schema).fields
    names, kinds = [f.name for f in fields], [to_arrow_type(f.dataType) for f in fields]
    return texts(docs).mapInArrow(run, schema)


def runs(docs: DataFrame, least: int = LEAST, exponent: int = EXPONENT) -> DataFrame:
    """doc_id, runs (start, length, period by start, then period) and the text without repetitions, for every row of ``docs``."""
    def row(doc_id, words, found):
        kept = kept_words(len(words), found)
        return doc_id, [dict(zip(("start", "length", "period"), r)) for r in found], b" ".join(w for w, k in zip(words, kept) if k).decode()

    return over(docs, f"doc_id long, runs {RUN}, collapsed string", row, least=least, exponent=exponent)


def damaged(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The contract's planted runs: in a tenth of the documents a tail repeats its first p words."""
    h = -1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 or not words:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def report(docs: DataFrame) -> DataFrame:
    """Digests of the runs of every document after ``damaged``."""
    def row(doc_id, words, found):
        best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
        top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        listed = "".join(f"{s},{length},{q}\n" for s, length, q in found).encode()
        kept = words if best is None else [w for w, k in zip(words, kept_words(len(words), found)) if k]
        return doc_id, len(found), *top, hashlib.sha256(listed).hexdigest(), hashlib.sha256(b" ".join(kept)).hexdigest()

    return over(docs, "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, "
                      "runs_sha256 string, collapsed_sha256 string", row, damaged)
