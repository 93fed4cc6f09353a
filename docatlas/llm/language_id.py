"""Operator 1: language identification by segmentation-marginalised unigrams.

Every language has its own probabilities over one fixed public piece vocabulary.  The
probability of a word is the sum over all its segmentations into pieces (forward
algorithm); a text is the product of its words.  The probabilities are learned by
expectation maximisation (forward-backward) on word counts that Spark gathers.

* Words are maximal runs of letters, lower-cased, with the vocabulary's word mark in
  front.  A letter that is no piece is a piece of its own with a floor probability.
* The learning sample is bounded: about ``rows_per_lang`` documents per language.
* The model has languages x pieces numbers; more than ``MAX_LANGS`` languages raise.
* Null text, empty text and text without a letter: ``und`` with score 0.  Null lang:
  not learned from.  No learned language: every text is ``und``.  Ties: first language
  in alphabetic order.  Very long texts: one pass, words are counted, long words are
  scored in rescaled steps.  Repeated rows: one result row each.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docatlas.llm.common import boxed, remainder, share, stored, unboxed, vocabulary_file, without

PIECES = "piece_bpe_32k.model"
MARK = "▁"
UNKNOWN = 1e-9
MAX_LANGS = 512
CACHE = 100_000
LEARNED = 40
BATCH = 1000  # rows that a filtering stage gets at a time
LETTERS = regex.compile(r"\p{L}+")
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def load_pieces(path: str) -> list[str]:
    """The pieces of a public sentencepiece model that can occur in marked lower-case words."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = (model.id_to_piece(i) for i in range(model.get_piece_size()))
    return sorted({p for p in pieces if p.removeprefix(MARK).isalpha() and p == p.lower()} | {MARK})


def words_of(token: str) -> list[str]:
    return [token] if token.isalpha() else LETTERS.findall(token)


class Lattice:
    """Piece lookup for many words at once."""

    def __init__(self, pieces: list[str]):
        self.longest = max(map(len, pieces))
        keys = np.array([self._key(p) for p in pieces], dtype=np.uint64)
        self.n = len(pieces)
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], order.astype(np.int32)
        size = 1 << 20
        self.first = np.full(size, -1, dtype=np.int32)
        slot = (keys >> np.uint64(44)).astype(np.int64)
        self.first[slot[::-1]] = np.arange(self.n, dtype=np.int32)[::-1]
        lost = np.nonzero(self.first[slot] != np.arange(self.n))[0]
        self.rest_keys = np.sort(keys[lost])
        self.rest_ids = lost[np.argsort(keys[lost])].astype(np.int32)
        self.piece_keys = np.append(keys, np.uint64(0))

    @staticmethod
    def _key(piece: str) -> int:
        key = 0
        for ch in piece:
            key = (key * 0x100000001B3 + ord(ch) + 1) & 0xFFFFFFFFFFFFFFFF
        return (key * int(MULTIPLIER)) & 0xFFFFFFFFFFFFFFFF

    def find(self, raw: np.ndarray) -> np.ndarray:
        """Piece number of each rolling key, or -1."""
        keys = raw * MULTIPLIER
        got = self.first[(keys >> np.uint64(44)).astype(np.int64)]
        hit = (got >= 0) & (self.piece_keys[got] == keys)
        out = np.where(hit, got, -1)
        if len(self.rest_keys):
            miss = np.nonzero(~hit & (got >= 0))
            if len(miss[0]):
                at = np.minimum(np.searchsorted(self.rest_keys, keys[miss]), len(self.rest_keys) - 1)
                out[miss] = np.where(self.rest_keys[at] == keys[miss], self.rest_ids[at], -1)
        return out

    def arcs(self, codes: np.ndarray) -> list[list[tuple[int, np.ndarray]]]:
        """By end position: (start, piece number per word); single unknown letters get number n, other misses n + 1."""
        count, length = codes.shape
        out: list[list[tuple[int, np.ndarray]]] = [[] for _ in range(length + 1)]
        wide = codes.astype(np.uint64) + np.uint64(1)
        for start in range(length):
            key = np.zeros(count, dtype=np.uint64)
            for end in range(start + 1, min(length, start + self.longest) + 1):
                key = key * np.uint64(0x100000001B3) + wide[:, end - 1]
                ids = self.find(key)
                if end == start + 1:
                    ids = np.where(ids < 0, self.n, ids)
                elif not (ids >= 0).any():
                    continue
                out[end].append((start, np.where(ids < 0, self.n + 1, ids)))
        return out


def by_length(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions, code points) of marked words of one length, in blocks of bounded size."""
    groups: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        groups.setdefault(len(w), []).append(i)
    for length, at in groups.items():
        step = max(1, 200_000 // (length + 1))
        for k in range(0, len(at), step):
            part = at[k:k + step]
            text = "".join(MARK + words[i] for i in part)
            yield np.array(part), np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32).reshape(len(part), length + 1)


class Model:
    """Languages and their piece probabilities (rows: pieces, then the unknown letter, then a zero row)."""

    def __init__(self, langs: list[str], pieces: list[str], table: np.ndarray):
        self.langs, self.pieces, self.table = langs, pieces, table
        self._lattice: Lattice | None = None

    def __getstate__(self):
        return {"langs": self.langs, "pieces": self.pieces, "table": self.table, "_lattice": None}

    @property
    def lattice(self) -> Lattice:
        if self._lattice is None:
            self._lattice = Lattice(self.pieces)
        return self._lattice

    def score(self, words: list[str]) -> np.ndarray:
        """log P(word | language): one row per word, summed over all segmentations."""
        out = np.zeros((len(words), len(self.langs)))
        for at, codes in by_length(words):
            length, arcs = codes.shape[1], self.lattice.arcs(codes)
            reach = self.lattice.longest
            alpha = {0: np.ones((len(at), len(self.langs)))}
            scale = np.zeros((len(at), len(self.langs)))
            for end in range(1, length + 1):
                alpha[end] = sum(alpha[start] * self.table[ids] for start, ids in arcs[end])
                alpha.pop(end - reach - 1, None)
                if end % 8 == 0:
                    top = alpha[end]
                    scale += np.log(top)
                    alpha = {k: v / top for k, v in alpha.items()}
            out[at] = np.log(alpha[length]) + scale
        return out

    def expected(self, words: list[str], lang: np.ndarray, times: np.ndarray) -> np.ndarray:
        """Expected piece counts, languages x pieces, by forward-backward over words of at most ``LEARNED`` letters."""
        n = self.lattice.n
        total = np.zeros(len(self.langs) * n)
        for at, codes in by_length(words):
            length, own = codes.shape[1], lang[at]
            if length > LEARNED:
                continue
            arcs = self.lattice.arcs(codes)
            probs = [[self.table[ids, own] for _, ids in ends] for ends in arcs]
            alpha, beta = np.zeros((length + 1, len(at))), np.zeros((length + 1, len(at)))
            alpha[0] = beta[length] = 1
            for end in range(1, length + 1):
                for (start, _), p in zip(arcs[end], probs[end]):
                    alpha[end] += alpha[start] * p
            for end in range(length, 0, -1):
                for (start, _), p in zip(arcs[end], probs[end]):
                    beta[start] += beta[end] * p
            flat, weight, share_of = [], [], times[at] / alpha[length]
            for end in range(1, length + 1):
                for (start, ids), p in zip(arcs[end], probs[end]):
                    known = ids < n
                    flat.append((own * n + ids)[known])
                    weight.append((alpha[start] * p * beta[end] * share_of)[known])
            total += np.bincount(np.concatenate(flat), weights=np.concatenate(weight), minlength=len(total))
        return total.reshape(len(self.langs), n)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts: Counter = Counter()
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for token, times in Counter(text.lower().split()).items():
                for word in words_of(token):
                    counts[lang, word] += times
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in counts], pa.string()), pa.array([k[1] for k in counts], pa.string()),
                                          pa.array(list(counts.values()), pa.int64())], ["lang", "word", "n"])


def train(docs: DataFrame, pieces_path: str | None = None, rows_per_lang: int = 1200, rounds: int = 4, alpha: float = 0.05) -> Model:
    """Learn from ``docs(doc_id, text, lang)``; rows with a null text or lang are left out."""
    pieces = load_pieces(pieces_path or vocabulary_file(PIECES))
    rows = docs.select("doc_id", "text", "lang").where("text is not null and lang is not null")
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    langs = sorted(sizes)
    if len(langs) > MAX_LANGS:
        raise ValueError(f"{len(langs)} languages; the model is broadcast and takes at most {MAX_LANGS}")
    k = len(pieces)
    table = np.full((k + 2, max(1, len(langs))), 1 / k)
    table[k], table[k + 1] = UNKNOWN, 0
    model = Model(langs, pieces, table)
    if not langs:
        return model
    part = F.create_map(*[x for lang in langs for x in (F.lit(lang), F.lit(min(1.0, rows_per_lang / sizes[lang])))])
    sample = rows.where(share("language-id", "doc_id", "text") < part[F.col("lang")]).select("lang", "text")
    words = sample.mapInArrow(_count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")).persist()
    index = {lang: i for i, lang in enumerate(langs)}
    spark = docs.sparkSession
    try:
        for _ in range(rounds):
            sent = spark.sparkContext.broadcast(model)

            def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                now, total = sent.value, None
                for batch in batches:
                    own = np.array([index[x] for x in batch.column(0).to_pylist()], dtype=np.int64)
                    got = now.expected(batch.column(1).to_pylist(), own, np.array(batch.column(2).to_pylist(), dtype=float))
                    total = got if total is None else total + got
                if total is not None:
                    at = np.nonzero(total)
                    yield pa.RecordBatch.from_arrays([pa.array(at[0], pa.int32()), pa.array(at[1], pa.int32()), pa.array(total[at])], ["lang", "piece", "n"])

            # at most languages x pieces rows
            sums = words.mapInArrow(step, "lang int, piece int, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n")).toArrow()
            counts = np.zeros((k, len(langs)))
            counts[sums["piece"].to_numpy(), sums["lang"].to_numpy()] = sums["n"].to_numpy()
            table = model.table.copy()
            table[:k] = (counts + alpha) / (counts.sum(axis=0) + alpha * k)
            model = Model(langs, pieces, table)
            sent.unpersist()
    finally:
        words.unpersist()
    return model


def predict(docs: DataFrame, model: Model, keep: list[str], names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``keep`` columns of ``docs`` with, under ``names``, the language and its posterior (equal priors)."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(model)
    d = docs.select(F.col("text").alias("text_to_judge"), *keep)
    schema = T.StructType(d.schema.fields[1:]).add(names[0], T.StringType()).add(names[1], T.DoubleType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, width = sent.value, max(1, len(sent.value.langs))
        known: dict[str, int] = {}
        scores = np.zeros((0, width + 1))  # per token: log probabilities, then 1 if it has a letter

        def judge(tokens: list[list[str]]) -> Iterator[tuple[str, float]]:
            nonlocal known, scores
            fresh = set().union(*tokens) - known.keys()
            if known and len(known) + len(fresh) > CACHE:
                known, scores, fresh = {}, scores[:0], set().union(*tokens)
            if fresh:
                fresh = list(fresh)
                words = [words_of(t) for t in fresh]
                owner = np.repeat(np.arange(len(fresh)), [len(ws) for ws in words])
                more = np.zeros((len(fresh), width + 1))
                if len(owner) and now.langs:
                    np.add.at(more[:, :width], owner, now.score([w for ws in words for w in ws]))
                    more[owner, width] = 1
                known.update(zip(fresh, range(len(scores), len(scores) + len(fresh))))
                scores = np.vstack([scores, more])
            for doc in tokens:
                total = scores[np.fromiter(map(known.__getitem__, doc), dtype=np.int64, count=len(doc))].sum(axis=0)
                if not total[width]:
                    yield "und", 0.0
                else:
                    best = int(total[:width].argmax())
                    yield now.langs[best], float(1 / np.exp(total[:width] - total[best]).sum())

        for batch in batches:
            out, tokens, size = [], [], 0
            for text in batch.column(0):
                text = text.as_py() or ""
                tokens.append(text.lower().split())
                size += len(text)
                if size > 1_000_000:
                    out += judge(tokens)
                    tokens, size = [], 0
            out += judge(tokens)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.float64())],
                                             [*batch.schema.names[1:], *names])

    return d.mapInArrow(run, schema)


def identify(docs: DataFrame, pieces_path: str | None = None, rows_per_lang: int = 1200) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row; learned from the rows outside the held-out fold."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    fold = remainder(4)
    model = train(d.where((fold >= 0) & (fold != 2)), pieces_path, rows_per_lang)
    out = predict(d.withColumn("held_out", fold == 2), model, ["doc_id", "held_out"])
    return out.select("doc_id", "held_out", "lang_pred", "score")


def accepted(docs: DataFrame, least: float = 0.5, **options) -> DataFrame:
    """The rows of ``docs`` that have a language: some letter, and a posterior of at least ``least``; all columns are kept,
    whatever their names.  Only texts and places go through Python; rows that are not accepted are dropped by place."""
    fold = remainder(4)
    model = train(docs.where((fold >= 0) & (fold != 2)), **options)
    rows = boxed(docs).withColumn("_place", F.xxhash64("_file"))
    judged = predict(rows, model, ["_place", "_row"])
    gone = stored(judged.where((F.col("lang_pred") == "und") | (F.col("score") < least)).select("_place", "_row"), "not-accepted", batch=BATCH)
    return unboxed(without(rows.select("_place", "_row", "_user"), gone, ["_place", "_row"]))
