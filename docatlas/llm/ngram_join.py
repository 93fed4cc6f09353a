"""Operator 8: n-gram Jaccard join with a prefix tree.

A document's set are its distinct 5-word shingles.  Two sets link when 100 * intersection
>= 80 * union.  All tokens have one global order, rare ones first: by a table of counts of
hash slots over the whole corpus (of bounded size; it decides speed, not results), then by
hash.  Two linked sets share a token among the first  n - ceil(0.8 n) + 1  of each, so the
sets that share such a token (with sizes within 0.8 of each other) are brought together:

1. equal sets become one; copies are never paired;
2. sets meet at their leading tokens by hash range.  With m more leading tokens, linked sets
   share m + 1 of them: where few sets have a token, common tokens are counted by pair and
   pairs with too few are left (a passage that documents share is not enough); where many
   have it, they become a star of edges, not all pairs.  Connected sets form a candidate
   class that contains all their links;
3. a candidate class, or a block of a large one, is joined in one group with a prefix tree
   over the ordered sets: a probe walks the tree, shares the partial overlap of common
   beginnings and leaves a subtree when the remaining lengths cannot reach the required
   overlap; sets already known to be connected are not compared again;
   Tokens that one set alone has in its group bound its overlaps: many sets of a class that
   grew around one document are left by their counts;
4. large classes have several blocks: after connecting inside the blocks, some sets that have
   links meet all other blocks, then only the sets outside the class's largest connected part do.

Results are exact up to 64-bit hashes of words, shingles and sets.

* Words are ASCII-lower-cased and split at ASCII white space.  Fewer than five words: the
  whole sequence is one shingle.  No words, empty or null text: empty set, linked with
  nothing (component_id is the document's own id, null for a null id).
* component_id is the smallest doc_id that can be reached; repeated rows are members of
  one component.  In ``dedup`` the row with the smallest doc_id of a component stays (of
  repeated ids the first by place); rows with empty sets all stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, GroupedData
from pyspark.sql import functions as F

from docatlas.llm.common import boxed, filed, may_be_in, stored, unboxed, without
from docatlas.llm.components import components, stars
from docatlas.llm.packed import Layout, ask, chunked, narrow, pack, runs, unpack, widen

WORDS = 5
NEED, OF = 80, 100
BLOCK_SETS, BLOCK_TOKENS = 1000, 1_000_000
PAIRED = 32  # sets with a common token that are paired; more of them form a star
TOKEN_BITS = 40  # of a token that travel; others choose the bucket
SPACE = np.isin(np.arange(256), list(b" \t\n\r\x0b\x0c"))
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _B
    x = (x ^ (x >> np.uint64(32))) * _B
    return x ^ (x >> np.uint64(32))


def coded_words(bodies: list[str]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Where the words of each text end among the words of all, the words as numbers, and the distinct words."""
    bodies = [t.encode("utf-8", errors="replace").lower() for t in bodies]
    text = np.frombuffer(b"\n".join(bodies), dtype=np.uint8)
    letter = ~SPACE[text]
    first, behind = (np.nonzero(letter & ~x)[0] for x in (np.append(False, letter[:-1]), np.append(letter[1:], False)))
    ends = np.searchsorted(first, np.cumsum([len(t) + 1 for t in bodies]))
    data = text[letter]
    at = np.append(0, np.cumsum(behind + 1 - first)).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(at), pa.py_buffer(data)]).dictionary_encode()
    return ends, words.indices.to_numpy(), words.dictionary.to_pylist()


def shingle_sets(bodies: list[str]) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    if not bodies:
        return []
    ends, codes, distinct = coded_words(bodies)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, distinct), dtype=np.uint64, count=len(distinct))[codes]
    out = []
    for a, b in zip([0, *ends[:-1].tolist()], ends.tolist()):
        if a == b:
            out.append(np.zeros(0, dtype=np.uint64))
            continue
        h = hashes[a:b]
        k = min(WORDS, len(h))
        s = np.full(len(h) - k + 1, k, dtype=np.uint64)
        for i in range(k):
            s = s * _A + h[i:len(h) - k + 1 + i]
        out.append(np.unique(mix(s)))
    return out


def set_id(s: np.ndarray) -> int:
    """64-bit id of a set, as a signed number."""
    return int(mix(np.array([mix(s ^ _A).sum(dtype=np.uint64) + np.uint64(len(s))], dtype=np.uint64)).astype(np.int64)[0])


def leading(n: int) -> int:
    """How many first tokens of a set of n any linked set must meet."""
    return n - -(-NEED * n // OF) + 1


def meetings(n: int) -> int:
    """How many common tokens among its first leading(n) + meetings(n) - 1 a set of n must have with any linked set
    (the smaller number of the two sets counts)."""
    return 1 + n // 10


def shared(token: np.ndarray, owner: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, ...]:
    """(a, b, n, need): n common tokens of the pair (a, b), of the ``need`` that a linked pair has.

    The sets of a token that few sets have are paired; those of other tokens become a star
    of pairs that need nothing more.  Sets whose sizes are too far apart are not paired."""
    by = np.lexsort((owner, size, token))
    token, owner, size = token[by], owner[by], size[by]
    new = np.append(True, (token[1:] != token[:-1]) | (OF * size[:-1] < NEED * size[1:]))
    same = np.append(False, (token[1:] == token[:-1]) & (owner[1:] == owner[:-1]))  # the same set from two runs
    group = np.cumsum(new) - 1
    group, owner, size = group[~same], owner[~same], size[~same]
    first = np.append(0, np.nonzero(np.diff(group))[0] + 1)
    count = np.diff(np.append(first, len(group)))
    out = []
    for k in range(2, PAIRED + 1):
        at = first[count == k]
        if len(at):
            i, j = np.triu_indices(k, 1)
            x, y = (at[:, None] + i).ravel(), (at[:, None] + j).ravel()
            near = OF * size[x] >= NEED * size[y]  # sizes rise within a group
            out.append((owner[x[near]], owner[y[near]], np.ones(near.sum(), dtype=np.int64), 1 + size[x[near]] // 10))
    for f, k in zip(first[count > PAIRED].tolist(), count[count > PAIRED].tolist()):
        out.append((np.full(k - 1, owner[f]), owner[f + 1:f + k], np.full(k - 1, 1 << 40), np.zeros(k - 1, dtype=np.int64)))
    if not out:
        return tuple(np.zeros(0, dtype=np.int64) for _ in range(4))
    a, b, n, need = map(np.concatenate, zip(*out))
    a, b = np.minimum(a, b), np.maximum(a, b)
    by = np.lexsort((b, a))
    a, b, n, need = a[by], b[by], n[by], need[by]
    at = np.nonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])))[0]
    return a[at], b[at], np.add.reduceat(n, at), np.minimum.reduceat(need, at)


def ordered(s: np.ndarray, slots: np.ndarray) -> np.ndarray:
    return s[np.argsort(slots[(s & np.uint64(len(slots) - 1)).astype(np.int64)], kind="stable")]


# ------------------------------------------------------------------ the prefix tree


class Node:
    __slots__ = ("children", "sets", "low", "high", "parent", "token")

    def __init__(self, parent=None, token: int = -1):
        self.children, self.sets, self.low, self.high, self.parent, self.token = {}, [], 1 << 60, 0, parent, token

    def child(self, token: int) -> Node:
        """The node behind ``token``; a new one if there is none."""
        if token not in self.children:
            self.children[token] = Node(self, token)
        return self.children[token]

    def rest(self, i: int, n: int) -> None:
        self.sets.append(i)
        self.low, self.high = min(self.low, n), max(self.high, n)


class PrefixTree:
    """Ordered sets in a trie; a set rests at the first node that it has alone (or at its end).

    Tokens that no set to be compared has are in no overlap.  The others bound the overlap of a set
    with any set, and its leading tokens are the first of them.  ``left``: sets that are compared
    with all others, but not with each other; without it, all are compared."""

    def __init__(self, sets: list[np.ndarray], left: np.ndarray | None = None):
        self.root, self.leaf = Node(), {}
        # tokens by small numbers, in one array
        self.size = np.array(list(map(len, sets)), dtype=np.int64)
        self.start = np.cumsum(self.size) - self.size
        names, self.flat, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        self.flags = np.zeros(len(names), dtype=bool)
        self.sets = np.split(self.flat, self.start[1:])
        owner = np.repeat(np.arange(len(sets)), self.size)
        met = count > 1
        if left is not None:
            n = np.bincount(self.flat[left[owner]], minlength=len(names))
            met = (n > 0) & (n < count)
        met = met[self.flat]
        self.common = np.add.reduceat(met.astype(np.int64), self.start)
        token, owner = self.flat[met], owner[met]
        spare = self.common + NEED * self.size // -OF  # a linked set has all but so many of them
        lead = np.arange(len(owner)) - (np.cumsum(self.common) - self.common)[owner] <= spare[owner]
        token, owner = token[lead], owner[lead]
        self.lead = np.split(token, np.searchsorted(owner, np.arange(1, len(sets))))
        # leading token -> sets
        self.met, self.met_at = owner[np.argsort(token, kind="stable")], np.append(0, np.cumsum(np.bincount(token, minlength=len(names))))
        self.inserted, self.hits = np.zeros(len(sets), dtype=bool), np.zeros(len(sets), dtype=bool)

    def insert(self, i: int) -> None:
        """Adds set i, unless no set has enough of its tokens."""
        if not len(self.lead[i]):
            return
        self.inserted[i] = True
        own, node, depth = self.sets[i], self.root, 0
        n = len(own)
        while True:
            if depth == n or not node.children and not node.sets and node is not self.root:
                node.rest(i, n)
                self.leaf[i] = node
                return
            node.low, node.high = min(node.low, n), max(node.high, n)
            for j in [j for j in node.sets if len(self.sets[j]) > depth]:  # the set that was alone here moves down
                node.sets.remove(j)
                child = node.child(int(self.sets[j][depth]))
                child.rest(j, len(self.sets[j]))
                self.leaf[j] = child
            node = node.child(int(own[depth]))
            depth += 1

    def wanted(self, x: int, skip) -> np.ndarray:
        """Sets that meet one of the leading tokens of set x and have enough tokens to link with it."""
        first = self.met_at[self.lead[x]]
        many = self.met_at[self.lead[x] + 1] - first
        self.hits[self.met[np.repeat(first - (np.cumsum(many) - many), many) + np.arange(many.sum())]] = True
        self.hits[x] = False
        at = np.nonzero(self.hits & self.inserted)[0]
        self.hits[:] = False
        n, m = self.size[x], self.size[at]
        near = (OF * np.minimum(n, m) >= NEED * np.maximum(n, m)) & (np.minimum(self.common[x], self.common[at]) >= -(-NEED * (n + m) // (OF + NEED)))
        return at[near & np.logical_not(skip(at))]

    def probe(self, x: int, skip) -> list[int]:
        """Sets that link with set x, of those that meet one of its leading tokens; ``skip(sets)`` says which need not be compared.

        The walk gives the sets that lengths and partial overlaps cannot rule out; these are compared together."""
        n = int(self.size[x])
        wanted = set(self.wanted(x, skip).tolist())
        if not wanted:
            return []
        tokens = self.sets[x].tolist()
        below: dict[Node, list[Node]] = {}  # the part of the tree that leads to wanted sets
        for i in wanted:
            node = self.leaf[i]
            seen = node in below
            below.setdefault(node, [])
            while not seen and node.parent is not None:
                seen = node.parent in below
                below.setdefault(node.parent, []).append(node)
                node = node.parent
        place = dict(zip(tokens, range(n)))
        left = []
        stack = [(self.root, 0, 0, 0)]  # node, depth, overlap, tokens of x that are left behind
        while stack:
            node, depth, overlap, used = stack.pop()
            if OF * min(n, node.high) < NEED * max(n, node.low):
                continue  # lengths
            need = -(-NEED * (n + node.low) // (OF + NEED))
            if overlap + min(n - used, node.high - depth) < need:
                continue
            for i in node.sets:
                m = int(self.size[i])
                if i in wanted and overlap + min(n - used, m - depth) >= -(-NEED * (n + m) // (OF + NEED)):
                    left.append(i)
            for child in below[node]:
                p = place.get(child.token)
                # order is global: what x has before this token cannot follow in the subtree
                stack.append((child, depth + 1, overlap, used) if p is None else (child, depth + 1, overlap + 1, p + 1))
        if not left:
            return []
        at = np.array(left)
        size = self.size[at]
        before = np.cumsum(size) - size
        self.flags[self.sets[x]] = True
        both = np.add.reduceat(self.flags[self.flat[np.repeat(self.start[at] - before, size) + np.arange(size.sum())]].astype(np.int64), before)
        self.flags[self.sets[x]] = False
        return at[OF * both >= NEED * (n + size - both)].tolist()


def dealt(d: DataFrame, *keys: str) -> GroupedData:
    """Groups of ``d``, over the configured number of tasks: they are heavy on CPU per byte, so they are not coalesced by size."""
    return d.repartition(int(d.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys).groupBy(*keys)


def link_groups(ids: list[int], sets: list[np.ndarray], labels: list[int] | None = None, left: list[bool] | None = None) -> list[tuple[int, int]]:
    """Stars around the smallest ids that connect what links connect: among all sets, or between ``left`` sets and the others, of other labels."""
    label = np.arange(len(ids)) if labels is None else np.unique(labels, return_inverse=True)[1]
    tree = PrefixTree(sets, None if left is None else np.array(left))
    order = np.argsort(tree.size, kind="stable").tolist()
    if left is not None:
        for i in order:
            if not left[i]:
                tree.insert(i)
        order = [i for i in order if left[i]]
    out = []
    for i in order:
        for j in tree.probe(i, lambda at: label[at] == label[i]):
            if label[i] != label[j]:
                label[label == label[j]] = label[i]
                out.append((ids[i], ids[j]))
        if left is None:
            tree.insert(i)
    if not out:
        return []
    return list(zip(*(x.tolist() for x in stars(*np.array(out, dtype=np.int64).T))))


# ------------------------------------------------------------------ the join

SET = "set_id long, n long, tokens binary"
LINK = "a long, b long"


class Join:
    """Steps of the join over ``d`` (chunk, row, doc_id, text)."""

    def __init__(self, docs: DataFrame):
        self.layout = Layout(docs)
        self.docs = chunked(docs, self.layout)
        slots = 1 << 16
        while slots < (1 << 22) and slots * 128 < self.layout.bytes // 6:
            slots *= 2
        self.slots = slots
        # the sets themselves are stored (8 bytes a shingle): words are cut and hashed once, later steps read what they need
        self.first = stored(self.docs.mapInArrow(self._first, "kind int, chunk long, row long, doc_id long, set_id long, n long, tokens binary, payload binary"), "shingles",
                            batch=self.layout.chunk_rows)

    @property
    def _first(self):
        slots = self.slots

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            counts = np.zeros(slots, dtype=np.int64)
            names = ["kind", "chunk", "row", "doc_id", "set_id", "n", "tokens", "payload"]
            for *_, part in runs(batches):
                sets = shingle_sets(part.column(3).to_pylist())
                counts += np.bincount((np.concatenate(sets) & np.uint64(slots - 1)).astype(np.int64), minlength=slots)
                k = len(sets)
                yield pa.RecordBatch.from_arrays([pa.array([0] * k, pa.int32()), part.column(0), part.column(1), part.column(2), pa.array([set_id(s) for s in sets], pa.int64()),
                                                  pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary()), pa.nulls(k, pa.binary())], names)
            step = 1 << 14
            for k in range(0, slots, step):
                if counts[k:k + step].any():
                    yield pa.RecordBatch.from_arrays([pa.array([1], pa.int32()), pa.array([k], pa.int64()), *[pa.nulls(1, pa.int64())] * 4, pa.nulls(1, pa.binary()),
                                                      pa.array([pack(counts[k:k + step].astype(np.int32).tobytes())], pa.binary())], names)
        return run

    def rows(self) -> DataFrame:
        """chunk, row, doc_id, set_id, n of every document."""
        return self.first.where("kind = 0").select("chunk", "row", "doc_id", "set_id", "n")

    def order(self) -> np.ndarray:
        """Rank of each slot by its count: a table of at most 4 million small numbers."""
        def add(table: pa.Table) -> pa.Table:
            total = sum(np.frombuffer(unpack(p.as_py())[0], dtype=np.int32).astype(np.int64) for p in table["payload"])
            return pa.table({"chunk": table["chunk"][:1], "payload": pa.array([pack(total.tobytes())], pa.binary())})

        got = self.first.where("kind = 1").select("chunk", "payload").groupBy("chunk").applyInArrow(add, "chunk long, payload binary").toArrow()
        counts = np.zeros(self.slots, dtype=np.int64)
        for k, p in zip(got["chunk"].to_pylist(), got["payload"].to_pylist()):
            part = np.frombuffer(unpack(p)[0], dtype=np.int64)
            counts[k:k + len(part)] = part
        # counts beyond 2 ** 16 - 1 are equal for the order
        return np.minimum(counts, 65535).astype(np.uint16)

    def candidates(self, order) -> DataFrame:
        """vertex (set_id), root: classes of sets that meet at a leading token."""
        buckets = max(16, self.layout.buckets // 4)  # few entries per document: fewer, larger messages

        def keys(named: list[int], tokens: list[bytes]) -> Iterator[tuple[int, bytes]]:
            slots = order.value
            distinct = {i: np.frombuffer(s, dtype=np.uint64) for i, s in zip(named, tokens)}
            ids, sizes = np.array(list(distinct), dtype=np.int64), np.array(list(map(len, distinct.values())), dtype=np.int64)
            leads = [ordered(s, slots)[:leading(len(s)) + meetings(len(s)) - 1] for s in distinct.values()]
            token, owner = np.concatenate(leads), np.repeat(np.arange(len(ids)), list(map(len, leads)))
            bucket = (token >> np.uint64(TOKEN_BITS)).astype(np.int64) % buckets
            by = np.argsort(bucket, kind="stable")
            token, owner, bucket = token[by], owner[by], bucket[by]
            ends = np.append(np.nonzero(np.diff(bucket))[0] + 1, len(bucket))
            for a, b in zip(np.append(0, ends[:-1]), ends):
                mine = np.unique(owner[a:b])
                short = token[a:b].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :TOKEN_BITS // 8]
                yield int(bucket[a]), pack(short.tobytes(), narrow(np.searchsorted(mine, owner[a:b])), ids[mine].tobytes(), narrow(sizes[mine]))

        def meet(table: pa.Table) -> pa.Table:
            token, owner, size = [], [], []
            for p in table["payload"]:
                short, at, ids, sizes = unpack(p.as_py())
                wide = np.zeros((len(short) * 8 // TOKEN_BITS, 8), dtype=np.uint8)
                wide[:, :TOKEN_BITS // 8] = np.frombuffer(short, dtype=np.uint8).reshape(-1, TOKEN_BITS // 8)
                at = widen(at)
                token.append(wide.view("<u8").reshape(-1))
                owner.append(np.frombuffer(ids, dtype=np.int64)[at])
                size.append(widen(sizes)[at])
            a, b, n, need = shared(*map(np.concatenate, (token, owner, size)))
            return pa.table({"a": pa.array(a), "b": pa.array(b), "n": pa.array(n), "need": pa.array(need)})

        pairs = ask(self.first.where("kind = 0 and n > 0").select("chunk", "row", "set_id", "tokens"), keys).groupBy("bucket").applyInArrow(meet, "a long, b long, n long, need long")
        return components(pairs.groupBy("a", "b").agg(F.sum("n").alias("n"), F.min("need").alias("need")).where("n >= need").select("a", "b"), batch=self.layout.chunk_rows)

    def sets(self, order, live: DataFrame) -> DataFrame:
        """set_id, n, tokens in global order of the live sets, once each."""
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            slots = order.value
            for batch in batches:
                seen = {i: np.frombuffer(s, dtype=np.uint64) for i, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())}
                yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int64()), pa.array([len(s) for s in seen.values()], pa.int64()),
                                                  pa.array([ordered(s, slots).tobytes() for s in seen.values()], pa.binary())], ["set_id", "n", "tokens"])

        near = may_be_in(self.first.where("kind = 0 and n > 0").select("set_id", "tokens"), live, ["set_id"]).where("_near")
        near = near.select("set_id", "tokens").mapInArrow(run, SET)
        first = near.groupBy("set_id").agg(F.first("n").alias("n"), F.first("tokens").alias("tokens"))
        return first.join(live, "set_id")

    def components(self) -> DataFrame:
        """set_id, root for every set that has a link (a root itself may be left out)."""
        rank = self.order()
        order = self.docs.sparkSession.sparkContext.broadcast(rank)
        classes = self.candidates(order).select(F.col("vertex").alias("set_id"), F.col("root").alias("class"))
        sizes = self.rows().where("n > 0").groupBy("set_id").agg(F.first("n").alias("n")).join(classes, "set_id").groupBy("class").agg(
            F.greatest(F.ceil(F.sum("n") / BLOCK_TOKENS), F.ceil(F.count("*") / BLOCK_SETS)).cast("int").alias("blocks"))
        live = stored(classes.join(sizes, "class"), "classes")
        block = F.pmod(F.xxhash64("set_id"), F.col("blocks").cast("long")).cast("int")
        sets = stored(self.sets(order, live).withColumn("block", block), "sets", batch=self.layout.chunk_rows)

        def inside(table: pa.Table) -> pa.Table:
            links = link_groups(table["set_id"].to_pylist(), [np.frombuffer(x, dtype=np.uint64) for x in table["tokens"].to_pylist()])
            return pa.table({"a": pa.array([x[0] for x in links], pa.int64()), "b": pa.array([x[1] for x in links], pa.int64())})

        links = stored(dealt(sets.select("set_id", "tokens", "class", "block"), "class", "block").applyInArrow(inside, LINK), "links")
        if not live.where("blocks > 1").take(1):  # every class was joined as a whole: its stars are the components
            return links.select(F.col("a").alias("set_id"), F.col("b").alias("root"))
        split = sets.where("blocks > 1")
        links = links.unionByName(stored(self._across(split, links, some=True), "some"))
        return components(links.unionByName(self._across(split, links))).select(F.col("vertex").alias("set_id"), "root")

    @staticmethod
    def _across(split: DataFrame, links: DataFrame, some: bool = False) -> DataFrame:
        """Links between blocks: sets outside the largest connected part of their class meet all other blocks of it.

        ``some``: instead, half a block of sets that have links meet all other blocks, which connects the parts that one
        cluster has in several blocks, so that few sets are outside after."""
        known = components(links).select(F.col("vertex").alias("set_id"), "root")
        label = split.select("set_id", "class", "n").join(known, "set_id", "left").select(
            "set_id", "class", "n", F.col("root").isNotNull().alias("linked"), F.coalesce("root", "set_id").alias("label"))
        parts = label.groupBy("class", "label").agg(F.count("*").alias("size"), F.sum("n").alias("tokens"))
        largest = F.struct("size", "label")
        most = parts.groupBy("class").agg(F.max_by("label", largest).alias("most"), (F.sum("size") - F.max("size")).alias("outside"),
                                          (F.sum("tokens") - F.max_by("tokens", largest)).alias("tokens_outside"))
        d = split.join(label.drop("class", "n"), "set_id").join(most, "class").where("outside > 0")
        groups = F.lit(1) if some else F.greatest(F.ceil(F.col("outside") / BLOCK_SETS), F.ceil(F.col("tokens_outside") / BLOCK_TOKENS)).cast("int")
        meets = F.col("linked") & (F.pmod(F.xxhash64(F.lit(11), "set_id"), 2 * F.col("blocks")) == 0) if some else F.col("label") != F.col("most")
        whole = d.select("class", "set_id", "tokens", "label", "block", F.explode(F.sequence(F.lit(0), groups - 1)).alias("part"), F.lit(False).alias("left"))
        outer = d.where(meets).withColumn("own", F.col("block")).select(
            "class", "set_id", "tokens", "label", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"),
            F.pmod(F.xxhash64(F.lit(7), "set_id"), groups.cast("long")).cast("int").alias("part"), F.lit(True).alias("left")).where("block <> own").drop("own")

        def between(table: pa.Table) -> pa.Table:
            links = link_groups(table["set_id"].to_pylist(), [np.frombuffer(x, dtype=np.uint64) for x in table["tokens"].to_pylist()],
                                table["label"].to_pylist(), table["left"].to_pylist())
            return pa.table({"a": pa.array([x[0] for x in links], pa.int64()), "b": pa.array([x[1] for x in links], pa.int64())})

        return dealt(whole.unionByName(outer), "class", "block", "part").applyInArrow(between, LINK)

    def labelled(self) -> DataFrame:
        """rows() with root; null where the set is empty."""
        return self.rows().join(self.components(), "set_id", "left").withColumn("root", F.when(F.col("n") > 0, F.coalesce("root", "set_id")))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    d = stored(Join(docs).labelled(), "labelled")
    least = d.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("least"))
    return d.join(least, "root", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id"))


def dedup(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component; all columns are kept, whatever their names."""
    docs = filed(docs)
    join = Join(docs)
    d = stored(join.labelled().where("root is not null"), "labelled")
    key = F.struct(F.col("doc_id").isNull(), "doc_id", "chunk", "row")
    stay = d.groupBy("root").agg(F.min(key).alias("stay"))
    gone = d.join(stay, "root").where(key != F.col("stay")).select("chunk", "row")
    rows = boxed(docs)
    rows = rows.select(F.xxhash64("_file", F.floor(F.col("_row") / join.layout.chunk_rows)).alias("chunk"), F.col("_row").alias("row"), "_user")
    return unboxed(without(rows, gone, ["chunk", "row"]))
