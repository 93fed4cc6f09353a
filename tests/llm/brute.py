"""Plain Python versions of what the operators compute, and the odd table that all of them must survive."""
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, kept string, chunk string, row string, bucket string, root string, _x string"


def odd_rows():
    """Null and empty texts, null ids and languages, repeated rows, ties, long texts and words."""
    rng = random.Random(5)
    words = ["the", "of", "river", "stone", "lamp", "house", "Green", "walk", "éclair", "naïve", "10", "x.y", "(a)"]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base = prose(60)
    texts = [base, base, base + " tail", prose(40), "", None, None, "one", "two words", "  spaced   out \n lines\t", "12345 !!! ???",
             prose(3000), "a" * 5000, base.replace("river", "stream", 1), "日本語 テキスト", "<|endoftext|> x <|endoftext|>", "Ünï code space"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(0, base), (3, texts[3]), (None, base), (None, None), (40, "one"), (41, "two words")]
    langs = ["en", "fr", None]
    return [(i, t, langs[k % 3], "src0", None if t is None else len(t), *["clash"] * 7) for k, (i, t) in enumerate(rows)]


def frame(spark, rows, schema=SCHEMA):
    return spark.createDataFrame(rows, schema).repartition(3)


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def shingles(text):
    w = words_of(text)
    return frozenset(tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def near(rows):
    """rows of (id, text) -> list of (n_shingles, component_id), in order."""
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                up[find(i)] = find(j)
    low = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            low[find(i)] = min(low.get(find(i), doc), doc)
    return [(len(s), low.get(find(i)) if s else rows[i][0]) for i, s in enumerate(sets)]


def repeats(rows):
    def key(i):
        return math.inf if i is None else i

    first = {}
    data = [(i, (t or "").encode()) for i, t in rows]
    for i, b in data:
        for s in range(len(b) - 49):
            first[b[s:s + 50]] = min(first.get(b[s:s + 50], math.inf), key(i))
    out = []
    for i, b in data:
        change = np.zeros(len(b) + 1, int)
        for s in range(len(b) - 49):
            if first[b[s:s + 50]] < key(i):
                change[s] += 1
                change[s + 50] -= 1
        gone = np.cumsum(change[:-1]) > 0
        spans = int((np.diff(np.append(0, gone.astype(int))) == 1).sum())
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


def unigrams(rows):
    """(id, held_out, n_tokens, n_known, train_tokens, base_score) of rows of (id, text)."""
    fold = lambda i: None if i is None else zlib.crc32(str(i).encode()) % 10
    tokens = [[w.encode() for w in words_of(t)] + [b""] for _, t in rows]
    c = Counter(w for (i, _), ws in zip(rows, tokens) if fold(i) for w in ws)
    n, v = sum(c.values()), len(c)
    return [(i, fold(i) == 0, len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), 6))
            for (i, _), ws in zip(rows, tokens)]


def exact(rows):
    """(id, keep_id, group_size, sha) of rows of (id, text)."""
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    top = lambda g: max((i for i in g if i is not None), default=None)
    return [(i, top(groups[t or ""]), len(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows]


LUHN = lambda d: sum(int(x) if k % 2 == 0 else sum(divmod(2 * int(x), 10)) for k, x in enumerate(reversed(d))) % 10 == 0


def private(text):
    """Base spans by the patterns as they are written down."""
    text, out = text or "", []
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    out += [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m.group().split("."))]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 12 <= len(digits(m)) <= 19 and LUHN(digits(m))]
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(digits(m)) <= 15]
    return [(a, b, ("email", "ip", "card", "phone")[k]) for a, k, b in sorted(out)]


def tokens_of(text):
    return [t for t in re.split(r"[\W_]+", (text or "").lower()) if t]


def leaks(rows, items, window=13, share=0.8):
    """(id, item) with an aligned window that agrees in enough positions; no seeds, all diagonals."""
    out = set()
    for i, t in rows:
        h = tokens_of(t)
        for item, text in items:
            g = tokens_of(text)
            size = min(window, len(g))
            for shift in range(-len(g) + 1, len(h)):
                for s in range(len(g) - size + 1):
                    if size and sum(0 <= k + shift < len(h) and g[k] == h[k + shift] for k in range(s, s + size)) >= math.ceil(share * size):
                        out.add((i, item))
    return out
