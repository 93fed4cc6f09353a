"""Operator 9: language-model scores from a probabilistic suffix tree.

Tokens are ASCII-lower-cased words, then one end.  The lexicon (every distinct training
token with its count) is gathered by hash range and gives the root distribution; a token
that was not seen in training is one event, whose mass is that of the tokens seen once.
Pairs of symbols are counted in the same exchange, longer n-grams in the next.  A context of
up to ``depth`` symbols that occurs at least ``few`` times is a state of the tree if its
next-symbol distribution diverges from that of its own longest suffix (count-weighted
Kullback-Leibler test).  Every token is scored in the longest state that is a suffix of
its history; the distribution of a state is smoothed along all suffixes of its context.

* Nothing of the model is sent anywhere whole: lexicon, counts and states lie in hash
  ranges, grow with the corpus, and documents ask for their own by chunk.  The divergence
  of a context is a sum over its occurrences, so chunks send their parts of it.
* Every pair of a state and a symbol counts, also one seen once.  ``p_min``, a least share
  of all tokens for contexts, is 0 unless it is given.
* N-grams are compared by 64-bit hashes, words by their bytes.
* Texts are cut once: each run of documents is stored as numbers of its distinct words, and
  every later pass reads these and the words in place of the texts.
* Null and empty texts consist of the end token.  A null doc_id is neither learned from
  nor held out.  No training row: N = V = 0, base_score is log10(0.1 / 0.1) = 0 per token
  and the unseen event has all mass (score 0).
* Repeated rows count as often as they occur; very long texts and words are read whole.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docatlas.llm.common import stored
from docatlas.llm.packed import DOCUMENTS, MESSAGE, Layout, answer, chunked, messages, narrow, pack, runs, unpack, widen, word_list

FOLDS = 10
END = b""  # words are never empty


def tokens(text: str) -> list[bytes]:
    """Words, then the end.  bytes.lower and bytes.split know ASCII letters and white space only, as is asked for."""
    return [*text.encode("utf-8", errors="replace").lower().split(), END]


def fold(doc_id) -> int:
    return -1 if doc_id is None else zlib.crc32(str(doc_id).encode()) % FOLDS


WHITE = np.zeros(256, dtype=bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True


def joined(sizes: np.ndarray, data: np.ndarray | bytes) -> pa.LargeBinaryArray:
    """Words of these sizes that stand in ``data`` without gaps."""
    ends = np.append(0, np.cumsum(sizes)).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(ends), pa.py_buffer(data)])


def split(texts: list[str]) -> tuple[np.ndarray, pa.LargeBinaryArray]:
    """Number of tokens of each text, and the ``tokens`` of all texts."""
    raw = [t.encode("utf-8", errors="replace") for t in texts]
    data = np.frombuffer(b"".join(x + b" " for x in raw).lower(), dtype=np.uint8)
    white = WHITE[data]
    first, end = np.nonzero(~white & np.append(True, white[:-1]))[0], np.nonzero(white & np.append(False, ~white[:-1]))[0]
    upto = np.searchsorted(first, np.cumsum(np.fromiter(map(len, raw), dtype=np.int64, count=len(raw)) + 1))  # words up to the end of each text
    return np.diff(upto, prepend=0) + 1, joined(np.insert(end - first, upto, 0), data[~white])


def listed(docs: list[list[bytes]]) -> tuple[np.ndarray, pa.LargeBinaryArray]:
    """The same of texts that are given as tokens."""
    return np.fromiter(map(len, docs), dtype=np.int64, count=len(docs)), pa.array([w for d in docs for w in d], pa.large_binary())


def pack_words(words: pa.LargeBinaryArray) -> list[bytes]:
    ends = np.frombuffer(words.buffers()[1], dtype=np.int64)[words.offset:words.offset + len(words) + 1]
    data = words.buffers()[2]
    return [narrow(np.diff(ends)), data[int(ends[0]):int(ends[-1])].to_pybytes() if data else b""]


def read_words(sizes: bytes, blob: bytes) -> list[bytes]:
    return joined(widen(sizes), blob).to_pylist()


# ------------------------------------------------------------------ the tree

#: A divergence is summed as whole numbers of 1 / UNIT, so that its sum does not depend on the order.
UNIT = 1024


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """64-bit hash of two 64-bit hashes (finalizer of splitmix64)."""
    x = a * np.uint64(0x9E3779B97F4A7C15) + b
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values and the place of each value among them."""
    order = np.argsort(x)
    x = x[order]
    new = np.ones(len(x), dtype=bool)
    new[1:] = x[1:] != x[:-1]
    at = np.empty(len(x), dtype=np.int64)
    at[order] = np.cumsum(new) - 1
    return x[new], at


def pack_hashes(x: np.ndarray) -> bytes:
    """Sorted hashes as differences, bytes of equal weight together."""
    return np.diff(x, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes()


def read_hashes(data: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(data, dtype=np.uint8).reshape(8, -1).T).view(np.uint64).reshape(-1), dtype=np.uint64)


def ranges(x: np.ndarray, buckets: int) -> Iterator[tuple[int, slice]]:
    """The buckets of sorted hashes (by their first bits; ``buckets`` is a power of two) that are not empty."""
    own = (x >> np.uint64(65 - buckets.bit_length())).astype(np.int64)
    ends = np.searchsorted(own, np.arange(buckets + 1)).tolist()
    return ((b, slice(i, j)) for b, (i, j) in enumerate(zip(ends, ends[1:])) if j > i)


def hashed(words: pa.LargeBinaryArray) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, word_list(words)), dtype=np.uint64, count=len(words))


def numbers(words: pa.LargeBinaryArray) -> tuple[np.ndarray, pa.LargeBinaryArray, np.ndarray]:
    """The place of each word among the distinct words, these, and their hashes."""
    coded = words.dictionary_encode()
    # by their hashes, so that equal sets of words have one order
    own = hashed(coded.dictionary)
    order = np.argsort(own, kind="stable")
    place = np.empty(len(order), dtype=np.int64)
    place[order] = np.arange(len(order))
    return place[coded.indices.to_numpy()], coded.dictionary.take(pa.array(order)), own[order]


class Histories:
    """Hashed histories of the tokens of some documents: per depth d the d symbols before a
    token (``contexts``), these and the token (``grams``), and whether there are so many
    (``whole``).  A start mark stands before every text.  ``coded``: the ``numbers`` of the
    tokens, where they are known."""

    def __init__(self, docs: tuple[np.ndarray, pa.LargeBinaryArray | None], depth: int, coded: tuple | None = None):
        self.sizes, words = docs
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.symbols, self.words, self.hashes = coded or numbers(words)
        hashes = self.hashes
        padded = np.insert(hashes[self.symbols], self.starts, np.uint64(1))
        at = np.arange(len(self.symbols)) + np.repeat(np.arange(1, len(self.sizes) + 1), self.sizes)
        room = at - np.repeat(self.starts + np.arange(len(self.sizes)), self.sizes)  # symbols before a token, the start mark included
        self.contexts, self.grams, self.whole, run = [], [], [], padded
        for d in range(1, depth + 1):
            self.contexts.append(run[at - 1])
            run = mix(np.concatenate([run[:1], run[:-1]]), padded)
            self.grams.append(run[at])
            self.whole.append(room >= d)

    def context_sizes(self, count: np.ndarray, ends: int, grams: list[np.ndarray]) -> list[np.ndarray]:
        """How often each context occurs: as often as it does as a gram, since only an end has no next symbol."""
        before = [np.concatenate([[0], x[:-1]]) for x in (count, *grams[:-1])]
        before[0][self.starts] = ends  # start marks
        return [np.where(ok, x, 0) for ok, x in zip(self.whole, before)]


class Tree:
    """Counts of grams and, per depth, contexts that are states: the whole tree or the part that some documents need."""

    def __init__(self, prior: float, hashes: np.ndarray, counts: np.ndarray, sizes: np.ndarray, levels: list[tuple[np.ndarray]]):
        self.prior, self.hashes, self.counts, self.sizes, self.levels = prior, hashes, counts, sizes, levels

    def refine(self, docs: list[list[bytes]], root: np.ndarray) -> np.ndarray:
        """Probability of every token in its longest state; ``root`` is the root's."""
        h = Histories(listed(docs), len(self.levels))
        seen = lambda keys, values, x: np.where(keys[i := np.minimum(np.searchsorted(keys, x), len(keys) - 1)] == x, values[i], 0) if len(keys) else np.zeros(len(x), dtype=np.int64)
        states = [seen(c, np.ones(len(c), dtype=np.int64), x).astype(bool) & ok for (c,), x, ok in zip(self.levels, h.contexts, h.whole)]
        sizes = [seen(*self.sizes, x) for x in h.contexts]
        return interpolate(root, states, sizes, [seen(self.hashes, self.counts, x) for x in h.grams], self.prior)


def interpolate(root: np.ndarray, states: list[np.ndarray], sizes: list[np.ndarray], counts: list[np.ndarray], prior: float) -> np.ndarray:
    """From the root on along the suffixes of the longest state of each token."""
    longest = np.zeros(len(root), dtype=np.int64)
    for d, own in enumerate(states, 1):
        longest[own] = d
    p = root.copy()
    for d, (size, n) in enumerate(zip(sizes, counts), 1):
        at = longest >= d
        p[at] = (n[at] + prior * p[at]) / (size[at] + prior)
    return p


def learned(h: Histories, ids: list) -> np.ndarray:
    """Which tokens are learned from."""
    return np.repeat(np.fromiter((fold(i) > 0 for i in ids), dtype=bool, count=len(ids)), h.sizes)


def gather(arrays: list[np.ndarray], masks: list[np.ndarray]) -> np.ndarray:
    return np.concatenate([x[ok] for x, ok in zip(arrays, masks)])


def spread(values: np.ndarray, masks: list[np.ndarray]) -> list[np.ndarray]:
    """The reverse of ``gather``: 0 elsewhere."""
    out, start = [], 0
    for ok in masks:
        own = np.zeros(len(ok), dtype=values.dtype)
        n = int(ok.sum())
        own[ok] = values[start:start + n]
        start += n
        out.append(own)
    return out


def counting(h: Histories, ids: list, buckets: int) -> dict[int, bytes]:
    """Per bucket: distinct words and pairs of symbols with their training counts."""
    train = learned(h, ids)
    count = np.bincount(h.symbols[train], minlength=len(h.hashes))
    words = dict(ranges(h.hashes, buckets))
    grams, at = distinct(h.grams[0])
    own = np.bincount(at[train], minlength=len(grams))
    parts = dict(ranges(grams, buckets))
    nothing = slice(0, 0)
    return {b: pack(*pack_words(h.words[words.get(b, nothing)]), narrow(count[words.get(b, nothing)]),
                    pack_hashes(grams[parts.get(b, nothing)]), narrow(own[parts.get(b, nothing)])) for b in words.keys() | parts.keys()}


class Counted:
    """The documents of a run with the answers to ``counting``: training counts of tokens and pairs.

    A context of n occurrences, whose longest suffix has m, diverges by n log(m / n) at most:
    every continuation is at least as frequent behind the suffix.  Contexts that cannot reach
    ``test`` are no states, and longer grams are asked for only where a state may need them;
    whether they are depends on the gram alone, so that all its occurrences are counted."""

    def __init__(self, h: Histories, got: dict[int, bytes], buckets: int, depth: int, total: int, least: float, test: float):
        self.h = h
        self.buckets, self.total, self.least, self.test = buckets, max(1, total), least, test
        answers = {b: unpack(p) for b, p in got.items() if b < buckets}
        count = np.concatenate([np.zeros(0, dtype=np.int64), *[widen(answers[b][0]) for b in sorted(answers)]])
        self.count = count[h.symbols]
        self.ends = int(self.count[h.sizes[0] - 1]) if len(h.sizes) else 0  # every text has the same end
        pairs = np.concatenate([widen(answers[b][1]) for b in sorted(answers)])[distinct(h.grams[0])[1]]
        self.grams = [pairs]
        before = lambda x: np.concatenate([x[:1], x[:-1]])
        rarest, self.wanted = [pairs], []  # the rarest pair of a gram
        for d in range(2, depth + 1):
            rarest.append(np.minimum(pairs, before(rarest[-1])))
            suffix = before(rarest[d - 3]) if d > 2 else h.context_sizes(self.count, self.ends, self.grams)[0]
            self.wanted.append(h.whole[d - 1] & (self.may_matter(before(rarest[d - 2]), suffix) | self.may_matter(rarest[d - 1], rarest[d - 2])))
        self.longer, self.place = distinct(gather(h.grams[1:], self.wanted)) if depth > 1 else (np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64))

    def may_matter(self, most: np.ndarray, suffix: np.ndarray) -> np.ndarray:
        """Whether a context of at most ``most`` occurrences, its suffix of at most ``suffix``, or a longer one may be a state."""
        n = np.maximum(np.minimum(most, suffix / np.e), 1e-9)
        own = n * np.log(np.maximum(suffix, 1e-9) / n) + most / UNIT
        return (most >= self.least) & ((own >= self.test) | (most / np.e + most / UNIT >= self.test))

    def asks(self, ids: list) -> dict[int, bytes]:
        """Per bucket: distinct grams of three and more symbols with their training counts."""
        train = learned(self.h, ids)
        own = np.bincount(self.place[gather([train] * len(self.wanted), self.wanted)] if self.wanted else self.place, minlength=len(self.longer))
        return {self.buckets + b: pack(pack_hashes(self.longer[i]), narrow(own[i])) for b, i in ranges(self.longer, self.buckets)}

    def told(self, got: dict[int, bytes]) -> Counted:
        """With the answers to ``asks``."""
        h = self.h
        counts = np.concatenate([np.zeros(0, dtype=np.int64), *[widen(unpack(got[self.buckets + b])[0]) for b, _ in ranges(self.longer, self.buckets)]])
        self.grams += spread(counts[self.place], self.wanted)
        self.sizes = h.context_sizes(self.count, self.ends, self.grams)
        self.often, suffix = [], self.total
        for ok, n in zip(h.whole, self.sizes):
            some = np.maximum(n, 1)
            self.often.append(ok & (n >= self.least) & (n * np.log(np.maximum(suffix, 1) / some) + n / UNIT >= self.test))
            suffix = n
        self.contexts, self.at = distinct(gather(h.contexts, self.often))
        return self

    def divergence(self, ids: list) -> dict[int, bytes]:
        """Per bucket: the contexts that may be states, their counts and what their occurrences here add to the divergence."""
        train, gains, shorter = learned(self.h, ids), [], self.count / self.total
        for n, size, ok in zip(self.grams, self.sizes, self.often):
            own = n / np.maximum(size, 1)
            use = train & ok
            gain = np.zeros(len(use))
            gain[use] = np.rint(UNIT * np.log(own[use] / shorter[use]))
            gains.append(gain)
            shorter = own
        gain = np.bincount(self.at, weights=gather(gains, self.often), minlength=len(self.contexts)).astype(np.int64)
        size = np.zeros(len(self.contexts), dtype=np.int64)
        size[self.at] = gather(self.sizes, self.often)
        gain = (gain << 1) ^ (gain >> 63)  # sign last
        return {2 * self.buckets + b: pack(pack_hashes(self.contexts[i]), narrow(size[i]), narrow(gain[i])) for b, i in ranges(self.contexts, self.buckets)}

    def states(self, got: dict[int, bytes]) -> list[np.ndarray]:
        """Per depth: whether the context of a token is a state, from the answers to ``divergence``."""
        bits = [np.unpackbits(np.frombuffer(unpack(got[2 * self.buckets + b])[0], dtype=np.uint8), count=i.stop - i.start).astype(bool) for b, i in ranges(self.contexts, self.buckets)]
        return spread(np.concatenate([np.zeros(0, dtype=bool), *bits])[self.at], self.often)


def diverging(asked: list[tuple[bytes, bytes, bytes]], test: float) -> list[np.ndarray]:
    """Which contexts of the messages of one bucket are states."""
    hashes = [read_hashes(x) for x, _, _ in asked]
    _, at = distinct(np.concatenate(hashes))
    size = np.zeros(len(at), dtype=np.int64)
    size[at] = np.concatenate([widen(x) for _, x, _ in asked])
    gain = np.zeros(len(at), dtype=np.int64)
    coded = np.concatenate([widen(x) for _, _, x in asked])
    np.add.at(gain, at, (coded >> 1) ^ -(coded & 1))
    own = (gain >= UNIT * np.maximum(test, 0.01 * size))[at]
    return np.split(own, np.cumsum([len(x) for x in hashes])[:-1])


def summed(hashes: list[np.ndarray], counts: list[np.ndarray]) -> list[np.ndarray]:
    """Total count of each hash, message by message."""
    _, at = distinct(np.concatenate(hashes))
    total = np.bincount(at, weights=np.concatenate(counts)).astype(np.int64)[at] if len(at) else np.zeros(0, dtype=np.int64)
    return np.split(total, np.cumsum([len(x) for x in hashes])[:-1])


def grow(train: DataFrame, frequent: dict[bytes, int], total: int, depth: int, p_min: float, test: float, prior: float, few: int = 1) -> Tree:
    """The whole tree of a small table (chunk, row, doc_id, text), for tests; ``frequent`` has the counts of its words."""
    rows = [r for r in train.select("doc_id", "text").collect() if fold(r.doc_id) > 0]
    ids, bodies = [r.doc_id for r in rows], [r.text for r in rows]
    h = Histories(split(bodies), depth)
    asked = {b: unpack(p) for b, p in counting(h, ids, 2).items()}
    c = Counted(h, {b: pack(narrow(np.array([frequent[w] for w in read_words(x[0], x[1])], dtype=np.int64)), x[4]) for b, x in asked.items()}, 2, depth, total, max(few, p_min * total), test)
    c.told({b: pack(unpack(p)[1]) for b, p in c.asks(ids).items()})
    states = c.states({b: pack(np.packbits(diverging([tuple(unpack(p))], test)[0]).tobytes()) for b, p in c.divergence(ids).items()})
    grams, first = np.unique(gather(h.grams, h.whole), return_index=True)
    contexts, at = np.unique(gather(h.contexts, h.whole), return_index=True)
    return Tree(prior, grams, gather(c.grams, h.whole)[first], (contexts, gather(c.sizes, h.whole)[at]), [(np.unique(x[ok]),) for x, ok in zip(h.contexts, states)])


# ------------------------------------------------------------------ the operator


#: Rows of the table of coded runs (about 2 MB each) that Python gets at a time.
RUNS_AT_ONCE = 16


def planes(x: np.ndarray) -> bytes:
    """As ``narrow``, bytes of equal weight together."""
    data = narrow(x)
    return data[:1] + np.frombuffer(data, dtype=np.uint8, offset=1).reshape(-1, data[0]).T.tobytes()


def read_planes(data: bytes) -> np.ndarray:
    return widen(data[:1] + np.frombuffer(data, dtype=np.uint8, offset=1).reshape(data[0], -1).T.tobytes())


def coded_runs(d: DataFrame) -> DataFrame:
    """A message of each run of documents: ids, sizes, numbers of words, distinct words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, lo, hi, part in runs(batches):
            ids = part.column(2)
            sizes, words = split(part.column(3).to_pylist())
            symbols, words, _ = numbers(words)
            payload = pack(ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).tobytes(), np.packbits(ids.is_valid().to_numpy(zero_copy_only=False)).tobytes(),
                           narrow(sizes), planes(symbols), *pack_words(words), level=3)
            yield messages([(DOCUMENTS, chunk, lo, hi, payload)])

    return d.mapInArrow(run, MESSAGE)


def read_run(payload: bytes, depth: int) -> tuple[list, Histories]:
    """Ids and histories of a coded run."""
    ids, valid, sizes, symbols, lengths, blob = unpack(payload)
    ids = np.frombuffer(ids, dtype=np.int64)
    named = np.unpackbits(np.frombuffer(valid, dtype=np.uint8), count=len(ids))
    words = joined(widen(lengths), blob)
    return [i if ok else None for i, ok in zip(ids.tolist(), named.tolist())], Histories((widen(sizes), None), depth, (read_planes(symbols), words, hashed(words)))


def with_answers(coded: DataFrame, answers: DataFrame, work: Callable[[bytes, dict[int, bytes], tuple], pa.Table], schema: str) -> DataFrame:
    """``work(payload, answers by bucket, (chunk, first, last row))`` for every coded run; each has asked for its end token at least."""
    def group(table: pa.Table) -> pa.Table:
        chunk, own, got = table["chunk"][0].as_py(), {}, {}
        for b, lo, hi, payload in zip(*(table[c].to_pylist() for c in ("bucket", "lo", "hi", "payload"))):
            if b == DOCUMENTS:
                own[lo, hi] = payload
            else:
                got.setdefault((lo, hi), {})[b] = payload
        return pa.concat_tables([work(payload, got[at], (chunk, *at)) for at, payload in sorted(own.items())])

    return coded.unionByName(answers).groupBy("chunk").applyInArrow(group, schema)


def score(docs: DataFrame, depth: int = 3, p_min: float = 0.0, test: float = 50.0, prior: float = 20.0, few: int = 4) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row."""
    layout = Layout(docs)
    buckets = layout.buckets
    coded = stored(coded_runs(chunked(docs, layout)), "lm-documents")

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, lo, hi, payload in zip(*(batch.column(c) for c in ("chunk", "lo", "hi", "payload"))):
                ids, h = read_run(payload.as_py(), depth)
                yield messages([(b, chunk.as_py(), lo.as_py(), hi.as_py(), p) for b, p in counting(h, ids, buckets).items()])

    def merge(table: pa.Table) -> pa.Table:
        """Answers (the training counts of each word and gram asked for) and one summary row: n, v, tokens seen once."""
        asked = [unpack(p.as_py()) for p in table["payload"]]
        words = pa.chunked_array([joined(widen(sizes), blob) for sizes, blob, *_ in asked]).combine_chunks().dictionary_encode()
        at = words.indices.to_numpy()
        total = np.bincount(at, weights=np.concatenate([widen(counts) for _, _, counts, *_ in asked]), minlength=len(words.dictionary)).astype(np.int64)
        places = np.split(at, np.cumsum([len(widen(sizes)) for sizes, *_ in asked])[:-1])
        grams = summed([read_hashes(x[3]) for x in asked], [widen(x[4]) for x in asked])
        out = table.drop_columns(["payload"]).append_column("payload", pa.array([pack(narrow(total[at]), narrow(g)) for at, g in zip(places, grams)], pa.binary()))
        own = pa.table({"bucket": [table["bucket"][0].as_py()], "chunk": [None], "lo": [int(total.sum())], "hi": [int((total > 0).sum())],
                        "payload": [int((total == 1).sum()).to_bytes(8, "big")]}, schema=out.schema)
        return pa.concat_tables([out, own])

    answers = stored(coded.mapInArrow(keys, MESSAGE).groupBy("bucket").applyInArrow(merge, MESSAGE), "lm-counts", tidy=True, batch=RUNS_AT_ONCE)
    once = F.conv(F.hex("payload"), 16, 10).cast("long")
    head = answers.where("chunk is null").agg(F.sum("lo"), F.sum("hi"), F.sum(once)).head()
    counts = answers.where("chunk is not null")
    n, v, singles = head[0] or 0, head[1] or 0, max(1, head[2] or 0)
    least = max(few, p_min * n)
    per_token = np.log10(n + 0.1 * (v + 1))

    def again(keys: Callable[[Counted, list, dict[int, bytes]], dict[int, bytes]], reply: Callable[[list[bytes]], list[bytes]], name: str) -> DataFrame:
        """One more exchange: chunks ask by what they have been told."""
        def more(payload: bytes, got: dict[int, bytes], place: tuple) -> pa.Table:
            ids, h = read_run(payload, depth)
            own = keys(Counted(h, got, buckets, depth, n, least, test), ids, got)
            return pa.Table.from_batches([messages([(b, *place, p) for b, p in own.items()])])

        return stored(answer(with_answers(coded, counts, more, MESSAGE), reply), name, tidy=True)

    def total(payloads: list[bytes]) -> list[bytes]:
        asked = [unpack(p) for p in payloads]
        return [pack(narrow(x)) for x in summed([read_hashes(x) for x, _ in asked], [widen(x) for _, x in asked])]

    def judge(payloads: list[bytes]) -> list[bytes]:
        return [pack(np.packbits(x).tobytes()) for x in diverging([tuple(unpack(p)) for p in payloads], test)]

    counts = counts.unionByName(again(lambda own, ids, got: own.asks(ids), total, "lm-grams"))
    counts = counts.unionByName(again(lambda own, ids, got: own.told(got).divergence(ids), judge, "lm-states"))

    def work(payload: bytes, got: dict[int, bytes], place: tuple) -> pa.Table:
        ids, h = read_run(payload, depth)
        own = Counted(h, got, buckets, depth, n, least, test).told(got)
        c = own.count
        p = interpolate(np.where(c > 0, c, singles) / (n + singles), own.states(got), own.sizes, own.grams, prior)
        known, base, full = (np.add.reduceat(x, h.starts) for x in ((c > 0).astype(np.int64), np.log10(c + 0.1) - per_token, np.log10(p)))
        return pa.table({"doc_id": pa.array(ids, pa.int64()), "held_out": pa.array([fold(i) == 0 for i in ids], pa.bool_()), "n_tokens": pa.array(h.sizes),
                         "n_known": pa.array(known), "train_tokens": pa.array([n] * len(ids), pa.int64()), "base_score": pa.array(base), "score": pa.array(full)})

    return with_answers(coded, counts, work,
                        "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
