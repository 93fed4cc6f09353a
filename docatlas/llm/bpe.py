"""Operator 3: BPE encoding and decoding through a table of distinct words.

Texts are cut at every single space between two non-space characters (the cut belongs to
the word behind it), where the byte-level pre-tokenizer always cuts too.  Each chunk of
documents asks for its distinct words; in the group of a hash range every distinct word
is encoded once; the ids return to the chunk and are joined to the words by position.
Decoding joins ids with the id -> piece table (a map-side join: the vocabulary is fixed)
and reads the joined bytes as UTF-8.

* Null and empty texts have no ids and decode to the empty text.
* Special tokens written out in a text become their id, as in the tokenizers library with
  its default settings.
* Very long texts and words are whole; a text without spaces is one word.
* Only doc_id and text are read; repeated rows are answered one by one.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docatlas.llm.common import vocabulary_file
from docatlas.llm.packed import Layout, answer, ask, chunked, documents, finish, narrow, pack, unpack, widen, word_list

VOCABULARY = "byte_bpe_50k.json"
_CUT = re.compile(r"(?<=\S) (?=\S)")
_RARE = re.compile(r"[^\S \n]")
_FOREIGN = re.compile(r"[^\S\x00-\x7f]")  # white space beyond ASCII
_WHITE = np.array([chr(i).isspace() and i < 128 for i in range(256)])

_ENCODERS: dict[str, object] = {}


def words_of(text: str) -> list[str]:
    """Words of a text; joined they give the text."""
    if not text:
        return []
    parts = text.split(" ")
    if "" in parts or " \n" in text or "\n " in text or _RARE.search(text):  # a space beside white space
        parts = _CUT.split(text)
    return [parts[0], *[" " + p for p in parts[1:]]]


def coded_words(texts: list[str]) -> tuple[np.ndarray, np.ndarray, pa.LargeBinaryArray]:
    """Number of words of each text, the place of each word of all texts among the distinct words, and these, as UTF-8."""
    raw = [t.encode() for t in texts]
    sizes = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
    ends = np.cumsum(sizes)
    data = np.frombuffer(b"".join(raw), dtype=np.uint8)
    white = _WHITE[data]
    first = np.zeros(len(data), dtype=bool)
    first[1:-1] = (data[1:-1] == 32) & ~white[:-2] & ~white[2:]
    first[(ends - 1)[sizes > 0]] = False  # the next byte is another text's
    starts = (ends - sizes)[sizes > 0]
    first[starts] = True
    for i in np.nonzero(sizes)[0].tolist():
        if len(texts[i]) != sizes[i] and _FOREIGN.search(texts[i]):
            own = np.cumsum([len(w.encode()) for w in words_of(texts[i])])
            first[ends[i] - sizes[i] + 1:ends[i]] = False
            first[ends[i] - sizes[i] + own[:-1]] = True
    cuts = np.append(np.nonzero(first)[0], len(data)).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(cuts), pa.py_buffer(data)]).dictionary_encode()
    return np.diff(np.searchsorted(cuts[:-1], ends), prepend=0), words.indices.to_numpy().astype(np.int64), words.dictionary


def places(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each stretch, one behind the other."""
    return np.arange(size.sum()) + np.repeat(start - (np.cumsum(size) - size), size)


def encoder(path: str):
    if path not in _ENCODERS:
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        _ENCODERS[path] = t
    return _ENCODERS[path]


def byte_alphabet() -> dict[str, int]:
    """Characters by which byte-level BPE writes the 256 bytes: printable ones stand for themselves, the rest follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {**{chr(b): b for b in plain}, **{chr(256 + i): b for i, b in enumerate(rest)}}


def pieces(path: str) -> dict[int, bytes]:
    """id -> bytes of the fixed vocabulary, added tokens included."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    alphabet = byte_alphabet()
    out = {i: bytes(alphabet[c] for c in piece) for piece, i in spec["model"]["vocab"].items()}
    return out | {t["id"]: t["content"].encode() for t in spec["added_tokens"]}


def pieces_table(spark: SparkSession, path: str | None = None) -> DataFrame:
    """id, piece (binary)."""
    rows = sorted(pieces(path or vocabulary_file(VOCABULARY)).items())
    return spark.createDataFrame(pa.table({"id": pa.array([i for i, _ in rows], pa.int32()), "piece": pa.array([p for _, p in rows], pa.binary())}))


def encode_words(words: list[str], path: str) -> tuple[np.ndarray, np.ndarray]:
    """Lengths and flat ids."""
    lengths, flat = [], []
    for i in range(0, len(words), 20_000):
        for e in encoder(path).encode_batch_fast(words[i:i + 20_000], add_special_tokens=False):  # without offsets
            ids = e.ids
            lengths.append(len(ids))
            flat.append(np.array(ids, dtype=np.int32))
    return np.array(lengths, dtype=np.int64), np.concatenate(flat) if flat else np.zeros(0, dtype=np.int32)


def by_bucket(words: pa.LargeBinaryArray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """Places of the words of each bucket, by words."""
    order = pc.array_sort_indices(words).to_numpy().astype(np.int64)
    own = np.fromiter(map(zlib.crc32, word_list(words)), dtype=np.int64, count=len(words))[order] % buckets
    by = np.argsort(own, kind="stable")
    ends = np.searchsorted(own[by], np.arange(buckets + 1)).tolist()
    return ((b, order[by[i:j]]) for b, (i, j) in enumerate(zip(ends, ends[1:])) if j > i)


def pack_words(words: pa.LargeBinaryArray) -> bytes:
    ends = np.frombuffer(words.buffers()[1], dtype=np.int64)[words.offset:words.offset + len(words) + 1]
    return pack(narrow(np.diff(ends)), words.buffers()[2][int(ends[0]):int(ends[-1])].to_pybytes())


def unpack_words(data: bytes) -> pa.LargeBinaryArray:
    sizes, blob = unpack(data)
    return pa.Array.from_buffers(pa.large_binary(), len(sizes := widen(sizes)), [None, pa.py_buffer(np.append(0, np.cumsum(sizes))), pa.py_buffer(blob)])


def encode_decode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids array<int>, decoded string of every row."""
    path = path or vocabulary_file(VOCABULARY)
    layout = Layout(docs)
    buckets = layout.buckets
    d = chunked(docs, layout)
    piece_of = d.sparkSession.sparkContext.broadcast(pieces(path))  # bounded: the fixed vocabulary

    def keys(_, bodies: list[str]) -> Iterator[tuple[int, bytes]]:
        words = coded_words(bodies)[2]
        for b, at in by_bucket(words, buckets):
            yield b, pack_words(words.take(pa.array(at)))

    def reply(payloads: list[bytes]) -> list[bytes]:
        """Per word its ids, and whether their pieces spell the word: these need not be joined again for every text."""
        asked = [unpack_words(p) for p in payloads]
        words = pa.chunked_array(asked).combine_chunks().dictionary_encode()
        distinct = word_list(words.dictionary)
        lengths, flat = encode_words([w.decode() for w in distinct], path)
        start = np.cumsum(lengths) - lengths
        parts = list(map(piece_of.value.__getitem__, flat.tolist()))
        spelt = np.array([b"".join(parts[a:a + n]) == w for w, a, n in zip(distinct, start.tolist(), lengths.tolist())], dtype=bool)
        out = []
        for at in np.split(words.indices.to_numpy(), np.cumsum(list(map(len, asked)))[:-1]):
            out.append(pack(narrow(lengths[at]), narrow(flat[places(start[at], lengths[at])]), np.packbits(spelt[at]).tobytes(), level=9))
        return out

    def work(ids: list, bodies: list[str], got: dict[int, bytes]) -> pa.Table:
        counts, codes, words = coded_words(bodies)
        size, start, spelt = np.zeros(len(words), dtype=np.int64), np.zeros(len(words), dtype=np.int64), np.ones(len(words), dtype=bool)
        parts, upto = [np.zeros(0, dtype=np.int64)], 0
        for b, at in by_bucket(words, buckets):
            sizes, flat, same = unpack(got[b])
            size[at] = sizes = widen(sizes)
            start[at] = upto + np.cumsum(sizes) - sizes
            spelt[at] = np.unpackbits(np.frombuffer(same, dtype=np.uint8), count=len(at))
            parts.append(widen(flat))
            upto += len(parts[-1])
        values = np.concatenate(parts)[places(start[codes], size[codes])].astype(np.int32)
        cuts = np.append(0, np.cumsum(counts))
        offsets = np.append(0, np.cumsum(size[codes]))[cuts].astype(np.int32)
        odd = np.append(0, np.cumsum(~spelt[codes]))[cuts]
        decoded, lookup = list(bodies), piece_of.value  # where all words are spelt by their pieces, so is the text
        for i in np.nonzero(np.diff(odd))[0].tolist():
            decoded[i] = b"".join(map(lookup.__getitem__, values[offsets[i]:offsets[i + 1]].tolist())).decode("utf-8", errors="replace")
        return pa.table({"doc_id": pa.array(ids, pa.int64()), "ids": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int32())),
                         "decoded": pa.array(decoded, pa.string())})

    return finish(documents(d), answer(ask(d, keys), reply), work, "doc_id long, ids array<int>, decoded string")


def decode(tokens: DataFrame, path: str | None = None) -> DataFrame:
    """``tokens(doc_id, ids array<int>)`` -> doc_id, decoded; an id outside the vocabulary raises."""
    piece_of = tokens.sparkSession.sparkContext.broadcast(pieces(path or vocabulary_file(VOCABULARY)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = piece_of.value
        for batch in batches:
            texts = [b"".join(map(lookup.__getitem__, x.as_py() or ())).decode("utf-8", errors="replace") for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "decoded"])

    return tokens.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, decoded string")


def report(docs: DataFrame, path: str | None = None, more: tuple[str, ...] | list[str] = ()) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row, and ``more`` of ids and decoded."""
    d = encode_decode(docs, path)
    text_of = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return d.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(text_of.cast("binary"), 256).alias("ids_sha256"),
                    F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"), *more)
