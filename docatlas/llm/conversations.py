"""Operator 13: cheapest repair of the structure of conversations, by scalar big-integer weights.

A repaired conversation has the role initials ``(s?(ua)+)?``.  Rows are kept (K), given the
role user or assistant (R), deleted (D); rows of these two roles with no text are inserted (I).
Which edits are cheapest, and which of the cheapest have the least letters, is one shortest
path through a graph of (row, last initial).  Every edge weighs ONE integer: its cost in the
high digits, the letters of its edits in low digits at the place of its row, so that path
weights are plain sums and the ordinary minimum of integers decides everything.

* A row's place is three digits wide: up to two insertions before it (three would come back to
  the same last initial, at a cost), then its own letter, then zeros.  After equal letters two
  paths stand at the same digit, and a row's letters always end with D, K or R, so that comparing
  digits compares the letters one by one; the end of a shorter string is filled with zeros.
* Integers stay short: after ``BLOCK`` rows the digits so far of the four sums are replaced by
  their rank among the four, which is all that later minima can see.  The path itself is kept in two
  bytes a row.

Rows are ordered by turn (nulls first), then role, then text, so that repeated rows are
neighbours.  Both passes stream sorted rows: first only initials and faults, to find the edits,
then the texts, to apply them.  A task holds some bytes for each row of one conversation, and its
texts never at once.  The edits of one conversation are one string, and its digest one sequential
hash, so a conversation is the unit of work.

Nulls, odd rows: a null role or text is one space (so the text is blank, and the role can't be
kept), a null conv_id is one conversation, a null turn comes first and counts for no gap; in the damage's key
nulls are one space; a role '' has no initial and can't be kept; other columns are not read, so that their names
cannot clash; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import groupby, islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import LongType, StringType, StructField, StructType

#: Costs of the edits, and of an undeleted row whose text is cut off.
REROLE, DELETE, INSERT, CUT = 3, 4, 3, 3
#: Letters as digits, in their order as text; 0 fills up.
DIGIT = {"D": 1, "I": 2, "K": 3, "R": 4}
SPACE = " \t\n\x0b\x0c\r"
BLOCK = 256
SLOT = 9  # bits: three digits of three bits
RANK = 2  # bits: four states
ROWS = 256

# ------------------------------------------------------------------ the graph

#: Last initials: 0 none, 1 s, 2 u, 3 a.  Where an initial leads to, and where an inserted or new role does.
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
TURN = (2, 2, 3, 2)
ENDS = (0, 3)
INITIALS = "sua"


def kind_of(initial: str, blank_or_seen: bool, cut: bool) -> int:
    """0: must be deleted; else 1.. by initial (of none of the three: last) and cut-off text."""
    return 0 if blank_or_seen else 1 + 2 * (INITIALS.find(initial) if initial and initial in INITIALS else 3) + cut


def digits(letters: str) -> int:
    return sum(DIGIT[x] << (SLOT - 3 * (k + 1)) for k, x in enumerate(letters))


def edges(kind: int) -> dict[tuple[int, int], tuple[int, int, str]]:
    """(state before, state after) of a row of ``kind`` -> cheapest (cost, digits, letters)."""
    out = {}
    for first in range(4):
        state = first
        for inserted in range(3):
            ways = [(DELETE, "D", state)]
            if kind:
                initial, cut = INITIALS[(kind - 1) // 2:][:1], CUT * ((kind - 1) % 2)
                ways.append((REROLE + cut, "R", TURN[state]))
                if (state, initial) in NEXT:
                    ways.append((cut, "K", NEXT[state, initial]))
            for cost, letter, last in ways:
                letters = "I" * inserted + letter
                way = (cost + INSERT * inserted, digits(letters), letters)
                out[first, last] = min(way, out.get((first, last), way))
            state = TURN[state]
    return out


EDGES = [edges(kind) for kind in range(9)]


class Path:
    """The cheapest edits of the rows so far, for each last initial."""

    top = SLOT * BLOCK + RANK

    def __init__(self):
        self.sums: list[int | None] = [0, None, None, None]
        self.kinds, self.before, self.place = bytearray(), bytearray(), 0

    def add(self, kind: int) -> None:
        if self.place == BLOCK:
            self.shorten()
        shift, sums, back = SLOT * (BLOCK - 1 - self.place), [None] * 4, 0
        for (first, last), (cost, code, _) in EDGES[kind].items():
            if (held := self.sums[first]) is not None:
                held += (cost << self.top) + (code << shift)
                if sums[last] is None or held < sums[last]:
                    sums[last] = held
                    back = back & ~(3 << 2 * last) | first << 2 * last
        self.sums = sums
        self.kinds.append(kind)
        self.before.append(back)
        self.place += 1

    def shorten(self) -> None:
        """Ranks of the digits stand for them."""
        low = (1 << self.top) - 1
        order = sorted({x & low for x in self.sums if x is not None})
        self.sums = [None if x is None else x >> self.top << self.top | order.index(x & low) << SLOT * BLOCK for x in self.sums]
        self.place = 0

    def end(self) -> tuple[int, str]:
        """(cost, letters) of the cheapest whole repair."""
        self.shorten()
        ways = []
        for state, held in enumerate(self.sums):
            if held is not None:
                tail, last = "", state
                while last not in ENDS:
                    tail, last = tail + "I", TURN[last]
                ways.append((held + (INSERT * len(tail) << self.top) + (digits(tail) << SLOT * (BLOCK - 1)), state, tail))
        total, state, tail = min(ways)
        letters = [tail]
        for kind, back in zip(reversed(self.kinds), reversed(self.before)):
            first = back >> 2 * state & 3
            letters.append(EDGES[kind][first, state][2])
            state = first
        return total >> self.top, "".join(reversed(letters))


# ------------------------------------------------------------------ passes

FAULTS = ("blank", "duplicate", "truncated")
COUNTS = ("gaps", *FAULTS, "illegal", "cost")


def plans(rows: Iterable[tuple]) -> Iterator[tuple]:
    """Sorted (conv_id, gone, turn, initial, fault) -> (conv_id, counts..., audit) of each conversation."""
    for conv, group in groupby(rows, key=lambda r: r[0]):
        path, count, low, turn_before, distinct, illegal, before = Path(), [0, 0, 0], None, None, 0, 0, None
        for _, gone, turn, initial, fault in group:
            if gone:
                continue
            if turn is not None and turn != turn_before:
                low, turn_before, distinct = turn if low is None else low, turn, distinct + 1
            if fault:
                count[fault - 1] += 1
            illegal += before is not None and before + initial not in ("su", "ua", "au")
            before = initial
            path.add(kind_of(initial, fault in (1, 2), fault == 3))
        cost, audit = path.end()
        yield conv, 0 if low is None else turn_before - low + 1 - distinct, *count, illegal, cost, audit


def spoken(audit: str, rows: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str, str]]:
    """(role, text, edit) of the repaired rows; ``rows``: (role, text) before."""
    odd = (len(audit) - audit.count("D")) % 2
    made = 0
    for letter in audit:
        own = ("user", "assistant")[(made - odd) % 2]
        role, text = (own, "") if letter == "I" else next(rows)
        if letter != "D":
            made += 1
            yield (own if letter == "R" else role), text, letter


def each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    return (x for b in batches for k in range(0, b.num_rows, ROWS) for x in zip(*(c.to_pylist() for c in b.slice(k, ROWS).columns)))


def in_arrow(df: DataFrame, work, schema: StructType) -> DataFrame:
    """``work(rows) -> rows`` over the rows of each partition."""
    names, kinds = schema.names, [to_arrow_type(f.dataType) for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = work(each(batches))
        while some := list(islice(made, ROWS)):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some), kinds)], names)

    return df.mapInArrow(run, schema)


def ordered(rows: DataFrame) -> DataFrame:
    """conv_id, gone, turn, role, text, nth (of equal role and text in the conversation)."""
    d = rows.select("conv_id", "gone", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"),
                    F.coalesce("text", F.lit(" ")).alias("text"))
    same = W.partitionBy("conv_id", "gone", "role", "text").orderBy(F.asc_nulls_first("turn"))
    return d.repartition("conv_id").withColumn("nth", F.row_number().over(same))


def sorted_rows(d: DataFrame) -> DataFrame:
    return d.sortWithinPartitions("conv_id", F.desc("gone"), F.asc_nulls_first("turn"), "role", "text", "nth")


def schema_of(rows: DataFrame, *longs: str, texts: tuple[str, ...] = ()) -> StructType:
    return StructType([StructField("conv_id", rows.schema["conv_id"].dataType), *(StructField(c, LongType()) for c in longs),
                       *(StructField(c, StringType()) for c in texts)])


def fault() -> Column:
    """1 blank, 2 duplicate, 3 truncated, 0 none."""
    last = F.right(F.rtrim("text", F.lit(SPACE)), F.lit(1))
    return F.when(last == "", 1).when(F.col("nth") > 1, 2).when(~last.isin(*".!?"), 3).otherwise(0)


def with_gone(rows: DataFrame) -> DataFrame:
    return rows.select("conv_id", "turn", "role", "text", F.lit(False).alias("gone"))


def planned(rows: DataFrame) -> DataFrame:
    initials = sorted_rows(ordered(rows)).select("conv_id", "gone", "turn", F.substring("role", 1, 1).alias("initial"), fault().alias("fault"))
    return in_arrow(initials, plans, schema_of(rows, *COUNTS, texts=("audit",)))


def applied(rows: DataFrame, work, schema: StructType) -> DataFrame:
    """``work(plan, repaired rows)`` of every conversation, as rows.  The plan of a conversation comes before its rows."""
    plan = planned(rows).select("conv_id", F.lit(0).alias("mark"), *COUNTS, F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"),
                                F.col("audit").alias("text"), F.lit(0).alias("nth"))
    said = ordered(rows).where("not gone").select("conv_id", F.lit(1).alias("mark"), *(F.lit(None).cast("long").alias(c) for c in COUNTS),
                                                  "turn", "role", "text", "nth")
    both = plan.unionByName(said).repartition("conv_id").sortWithinPartitions("conv_id", "mark", F.asc_nulls_first("turn"), "role", "text", "nth")
    size = len(COUNTS)

    def run(rows: Iterable[tuple]) -> Iterator[tuple]:
        for _, group in groupby(rows, key=lambda r: r[0]):
            head = next(group)
            yield from work((head[0], *head[1:1 + size], head[-1]), spoken(head[-1], ((r[-2], r[-1]) for r in group)))

    return in_arrow(both.select("conv_id", *COUNTS, "role", "text"), run, schema)


# ------------------------------------------------------------------ interface


def audits(rows: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost and audit (the letters of the edits) of every conversation of
    ``rows`` (conv_id, turn, role, text)."""
    return planned(with_gone(rows))


def repaired(rows: DataFrame) -> DataFrame:
    """The repaired conversations: conv_id, position (from 0), role, text, edit (K, R or I)."""
    def work(plan, lines):
        return ((plan[0], k, *line) for k, line in enumerate(lines))

    return applied(with_gone(rows), work, schema_of(rows, "position", texts=("role", "text", "edit")))


def damaged(conversations: DataFrame) -> DataFrame:
    """The contract's faults, by crc32 of ``conv_id:turn`` modulo 20; dropped rows stay as ``gone``."""
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    h = F.crc32(F.concat_ws(":", text_of("conv_id"), text_of("turn")).cast("binary")) % 20
    d = conversations.select("conv_id", "turn", text_of("role").alias("role"), text_of("text").alias("text"), h.alias("h"))
    text = F.when(F.col("h") == 1, "").when(F.col("h") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("h") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("h") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return d.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("h") == 0).alias("gone"), copies.alias("copy")).drop("copy")


def report(conversations: DataFrame) -> DataFrame:
    """Counts, cost, audit and digest of the repair of every conversation after ``damaged``."""
    def work(plan, lines):
        sha, joint = hashlib.sha256(), b""
        for role, text, _ in lines:
            sha.update(joint + f"{role}:{text}".encode())
            joint = b"\n"
        yield *plan, sha.hexdigest()

    rows = damaged(conversations)
    return applied(rows, work, schema_of(rows, *COUNTS, texts=("audit", "repaired_sha256")))
