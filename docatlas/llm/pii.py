"""Operator 4: personal data by a semi-Markov conditional random field.

Base spans come from fixed patterns and always stay.  The rest of a text is decoded by a
semi-Markov CRF: a segment is a run of at most ``LONGEST`` tokens with a type (email, ip,
card, phone) or a single token outside; features look at the whole span (digit groups,
separators, Luhn sum, parts up to 255, address marks, neighbours), and a dynamic
programme chooses boundaries and types jointly.

* Only tokens near a digit group or an address mark can be in a segment with a finite
  score, so the programme runs over those windows (``REACH`` characters on either side, and on to
  the end of the word there); elsewhere every token is outside.
* Trained here without labelled data: base spans of a bounded sample of texts are the
  gold segments, together with respelled copies of them (other separators, no plus,
  ``[at]``), so that the field finds spellings that the patterns miss.
* A segment is added if it is in the best segmentation and its marginal probability is
  at least ``SURE``.  Added spans never overlap base spans.
* Null text counts as empty and has no spans.  Offsets are code points, end exclusive.
  Patterns run in linear time on long runs of one character class.  Repeated rows are
  answered one by one.  Without any base span in the sample nothing is added.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docatlas.llm.common import share, texts

KINDS = ("email", "ip", "card", "phone")
LONGEST = 24
SURE = 0.8
REACH = 40

# every quantifier is possessive or ends in a class that the next part excludes: linear time
_AT = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_TOKEN = re.compile(r"[0-9]+|[^\W\d_]+|\s+|.", re.DOTALL)
_ANCHOR = re.compile(r"[0-9]{2,}|[0-9](?=[ ().-][0-9(])|@|[\[({] ?at ?[\])}]")
_MARK = re.compile(r"@|[\[({] ?at ?[\])}]")


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum((0, 2, 4, 6, 8, 1, 3, 5, 7, 9)[int(d)] for d in even)) % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and int(part) <= 255


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) by start, then kind as listed."""
    out, free = [], 0
    if "@" in text:
        for m in _AT.finditer(text):
            start = m.start()
            while start > free and text[start - 1] in _LOCAL:
                start -= 1
            if start < m.start():
                out.append((start, m.end(), 0))
                free = m.end()
    for m in _IP.finditer(text):
        if all(map(_small, m.group().split("."))):
            out.append((m.start(), m.end(), 1))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = _NOT_DIGIT.sub("", m.group())
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), m.end(), 2))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
                out.append((m.start(), m.end(), 3))
    return [(a, b, KINDS[k]) for a, b, k in sorted(out, key=lambda s: (s[0], s[2]))]


# ------------------------------------------------------------------ the field


def windows(text: str, taken: list[tuple[int, int, str]]) -> Iterator[tuple[int, int]]:
    """Stretches around anchors outside base spans; a base span ends a stretch."""
    bars = [(a, b) for a, b, _ in taken]
    gaps, at = [], 0
    for a, b in bars:
        if a > at:
            gaps.append((at, a))
        at = max(at, b)
    gaps.append((at, len(text)))
    for lo, hi in gaps:
        start = end = None
        for m in _ANCHOR.finditer(text, lo, hi):
            a, b = max(lo, m.start() - REACH), min(hi, m.end() + REACH)
            if start is not None and a > end:
                end = word_end(text, end, hi)
                if a > end:
                    yield start, end
                    lo, start = end, None
            if start is None:
                start, end = word_start(text, a, lo), b
            else:
                end = max(end, b)
        if start is not None:
            yield start, word_end(text, end, hi)


def word_start(text: str, at: int, low: int) -> int:
    """``at``, or the start of the word that it cuts, but not before ``low``."""
    while at > low and not text[at - 1].isspace() and (at == len(text) or not text[at].isspace()):
        at -= 1
    return at


def word_end(text: str, at: int, high: int) -> int:
    while at < high and not text[at].isspace() and not text[at - 1].isspace():
        at += 1
    return at


def tokens(text: str, lo: int, hi: int) -> list[tuple[int, int]]:
    return [m.span() for m in _TOKEN.finditer(text, lo, hi)]


def _side(ch: str) -> str:
    return "none" if not ch else "space" if ch.isspace() else "digit" if ch.isdigit() else "letter" if ch.isalpha() else ch if ch in "-.+_@" else "mark"


def features(text: str, a: int, b: int, kind: str) -> list[str]:
    """Whole-span features of one candidate."""
    span = text[a:b]
    groups = re.findall(r"[0-9]+", span)
    digits = "".join(groups)
    out = ["bias", "left=" + _side(text[a - 1:a]), "right=" + _side(text[b:b + 1])]
    if kind == "email":
        local, mark, domain = re.split(r"(\s?[\[({] ?at ?[\])}]\s?|@)", span, maxsplit=1)
        labels = re.split(r"\.|\s?[\[({] ?dot ?[\])}]\s?", domain)
        out += [f"labels={min(3, len(labels))}", f"ending={labels[-1].isalpha() and len(labels[-1]) > 1}", f"local={bool(local)}"]
    else:
        seps = "".join(sorted(set(re.sub(r"[0-9]", "", span))))
        out += [f"digits={len(digits)}", f"groups={len(groups)}", "seps=" + seps, f"shape={'-'.join(str(len(g)) for g in groups[:6])}", f"first={span[0] if not span[0].isdigit() else 'd'}"]
        if kind == "card":
            out.append(f"luhn={len(digits) > 1 and luhn(digits)}")
        if kind == "ip":
            out.append(f"parts={len(groups) == 4 and all(map(_small, groups))}")
    return [f"{kind}:{x}" for x in out]


def candidates(text: str, toks: list[tuple[int, int]]) -> dict[int, list[tuple[int, str, list[str]]]]:
    """By end token (exclusive): (start token, kind, features) of segments with a finite score."""
    out = defaultdict(list)
    for i, (a, _) in enumerate(toks):
        first = text[a]
        numeric, marks = first.isdigit() or first in "+(", 0
        wordy = first.isalnum() and first.isascii()
        if not (numeric or wordy):
            continue
        count = 0
        for j in range(i, min(len(toks), i + LONGEST)):
            s, e = toks[j]
            piece = text[s:e]
            if piece.isspace() and (len(piece) > 1 or piece == "\n"):
                break
            if numeric:
                numeric = piece.isdigit() and piece.isascii() or piece in " ()+.-" and (piece != "+" or j == i)
                count += (e - s) if piece.isdigit() else 0
            if wordy and piece == "@":
                marks += 1
            if wordy and piece.isspace() and not (_MARK.match(text, e) or re.match(r"[\[({] ?dot", text[e:e + 6]) or text[s - 1:s] in "])}"):
                wordy = False
            if not numeric and not wordy:
                break
            if numeric and piece.isdigit() and 4 <= count <= 19:
                for kind in ("ip", "card", "phone"):
                    out[j + 1].append((i, kind, features(text, a, e, kind)))
            if wordy and piece.isalnum() and piece.isascii() and j > i + 1 and _MARK.search(text, a, e) and _MARK.search(text, a, e).end() <= s:
                out[j + 1].append((i, "email", features(text, a, e, "email")))
            if marks > 1:
                break
    return out


def decode(text: str, toks: list[tuple[int, int]], weights: dict[str, float]) -> list[tuple[int, int, str]]:
    """Segments of the best segmentation whose marginal probability is at least SURE."""
    cands = candidates(text, toks)
    if not cands:
        return []
    n = len(toks)
    scored = {end: [(i, k, sum(weights.get(f, 0.0) for f in fs)) for i, k, fs in own] for end, own in cands.items()}
    best, back, alpha, beta = [0.0] * (n + 1), [None] * (n + 1), *sums(n, scored)
    for end in range(1, n + 1):
        best[end] = best[end - 1]
        for i, k, s in scored.get(end, ()):
            if best[i] + s > best[end]:
                best[end], back[end] = best[i] + s, (i, k, s)
    out, at = [], n
    while at > 0:
        if back[at] is None:
            at -= 1
            continue
        i, k, s = back[at]
        if math.exp(min(0.0, alpha[i] + s + beta[at] - alpha[n])) >= SURE:
            out.append((toks[i][0], toks[at - 1][1], k))
        at = i
    return out[::-1]


def sums(n: int, scored) -> tuple[list[float], list[float]]:
    """Forward and backward log sums over all segmentations."""
    def add(xs):
        top = max(xs)
        return top + math.log(sum(math.exp(x - top) for x in xs))

    starts = defaultdict(list)
    alpha, beta = [0.0] * (n + 1), [0.0] * (n + 1)
    for end in range(1, n + 1):
        own = scored.get(end)
        alpha[end] = add([alpha[end - 1], *(alpha[i] + s for i, _, s in own)]) if own else alpha[end - 1]
        for i, k, s in own or ():
            starts[i].append((end, s))
    for at in range(n - 1, -1, -1):
        beta[at] = add([beta[at + 1], *(s + beta[e] for e, s in starts[at])]) if at in starts else beta[at + 1]
    return alpha, beta


def respelled(text: str, spans: list[tuple[int, int, str]], turn: int) -> tuple[str, list[tuple[int, int, str]]]:
    """The text with its spans written in another way."""
    out, gold, at, length = [], [], 0, 0
    for a, b, kind in spans:
        if a < at:
            continue
        span = text[a:b]
        if kind == "email":
            span = span.replace("@", (" [at] ", "(at)", " (at) ")[turn % 3], 1)
        elif kind == "phone":
            digits = _NOT_DIGIT.sub("", span)
            d = digits[-10:]
            span = (f"({d[:3]}) {d[3:6]}-{d[6:]}", f"{d[:3]}-{d[3:6]}-{d[6:]}", f"{d[:3]}.{d[3:6]}.{d[6:]}")[turn % 3] if len(d) == 10 else span
        elif kind == "card":
            digits = _NOT_DIGIT.sub("", span)
            span = (" ", "-", ".")[turn % 3].join(digits[i:i + 4] for i in range(0, len(digits), 4))
        piece = text[at:a]
        out += [piece, span]
        gold.append((length + len(piece), length + len(piece) + len(span), kind))
        length += len(piece) + len(span)
        at = b
    out.append(text[at:])
    return "".join(out), gold


def train(samples: list[str], epochs: int = 4, rate: float = 0.3) -> dict[str, float]:
    """Weights by stochastic gradient ascent on the conditional likelihood (adaptive steps, weak ridge)."""
    cases = []
    for n, text in enumerate(samples):
        spans = base_spans(text)
        for t, gold in [(text, spans)] + ([respelled(text, spans, n)] if spans else []):
            for lo, hi in windows(t, []):
                own = {(a, b): k for a, b, k in gold if a >= lo and b <= hi}
                toks = tokens(t, lo, hi)
                cands = candidates(t, toks)
                if cands:
                    cases.append((len(toks), cands, {(e, i, k) for e, cs in cands.items() for i, k, _ in cs if own.get((toks[i][0], toks[e - 1][1])) == k}))
    if not any(gold for _, _, gold in cases):
        return {"nothing": 0.0}
    weights, seen = defaultdict(float), defaultdict(lambda: 1e-6)
    for _ in range(epochs):
        for n, cands, gold in cases:
            scored = {e: [(i, k, sum(weights[f] for f in fs)) for i, k, fs in cs] for e, cs in cands.items()}
            alpha, beta = sums(n, scored)
            grad = defaultdict(float)
            for e, cs in cands.items():
                for (i, k, fs), (_, _, s) in zip(cs, scored[e]):
                    d = ((e, i, k) in gold) - math.exp(min(0.0, alpha[i] + s + beta[e] - alpha[n]))
                    if abs(d) > 1e-4:
                        for f in fs:
                            grad[f] += d
            for f, g in grad.items():
                seen[f] += g * g
                weights[f] += rate * (g - 1e-4 * weights[f]) / math.sqrt(seen[f])
    return dict(weights)


def find(text: str, weights: dict[str, float]) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """(base spans, all spans)."""
    base = base_spans(text)
    if len(weights) < 2:
        return base, base
    more = [s for lo, hi in windows(text, base) for s in decode(text, tokens(text, lo, hi), weights)]
    return base, sorted(base + more, key=lambda s: (s[0], KINDS.index(s[2])))


def learn(docs: DataFrame, rows: int = 1500) -> dict[str, float]:
    """Train on about ``rows`` texts that have an anchor, cut to the surroundings of their anchors."""
    d = texts(docs).where(F.col("text").rlike(r"[0-9@]"))
    total = d.select("doc_id").count()
    if not total:
        return {"nothing": 0.0}
    chosen = d.where(share("pii", "doc_id", "text") < min(1.0, rows / total))

    def around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0).to_pylist():
                # windows of one text stay apart by a line break that no segment crosses; the first 40 are enough to learn from
                parts = [text[lo:hi] for lo, hi in windows(text, [])][:40]
                if parts:
                    yield pa.RecordBatch.from_arrays([pa.array(["\n\n".join(parts)], pa.string())], ["text"])

    got = chosen.select("text").mapInArrow(around, "text string").toArrow()["text"].to_pylist()  # bounded by rows
    return train(sorted(got))


def digest(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


SCHEMA = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"


def scan(docs: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """doc_id, base counts and digest, and all spans of every row."""
    weights = learn(docs) if weights is None else weights
    sent = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = sent.value
        for batch in batches:
            rows = []
            for text in batch.column(1):
                base, spans = find(text.as_py(), w)
                counts = [sum(k == kind for _, _, k in base) for kind in KINDS]
                rows.append((*counts, hashlib.sha256(digest(base).encode()).hexdigest(), digest(spans), len(spans) - len(base)))
            cols = list(zip(*rows)) or [()] * 7
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, kinds))],
                                             ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"])

    return texts(docs).mapInArrow(run, "doc_id long, " + SCHEMA)
