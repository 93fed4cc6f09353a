"""Periodic runs against brute force: all periods of all texts, word by word."""
import hashlib
import random
import zlib

import numpy as np
import pytest

from docatlas.llm import periodic_runs, queries
from tests.llm import brute

SF = "/root/testdata/sf0.001"


def runs_of(w, least=6, exponent=4):
    out = []
    for q in range(1, len(w) // exponent + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            size, seg = j + q - i, w[i:j + q]
            if size >= max(least, exponent * q) and not any(seg[r:] == seg[:-r] for r in range(1, q)):
                out.append((i, size, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def split(text):
    import re

    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def digests(doc_id, text):
    w = split(text)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    n, g = len(w), h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
    found = runs_of(w)
    gone = {i for s, size, q in found for i in range(s + q, s + size)}
    top = max(found, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(found), *((*top, 1000 * top[1] // top[2]) if top else (None,) * 4),
            sha("".join(f"{s},{size},{q}\n" for s, size, q in found)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_runs_of_random_words():
    rng = random.Random(1)
    for _ in range(400):
        parts = []
        for _ in range(rng.randint(1, 4)):
            w = [rng.randint(0, rng.choice([1, 2, 3, 30])) for _ in range(rng.randint(0, 70))]
            for _ in range(rng.randint(0, 3)):
                if w:
                    a, p = rng.randrange(len(w)), rng.randint(1, 9)
                    for i in range(a, min(len(w), a + rng.randint(0, 60))):
                        w[i] = w[a + (i - a) % p]
            parts.append(w)
        flat, cuts = np.array([x for w in parts for x in w], dtype=np.int64), np.cumsum([0, *map(len, parts)])
        assert periodic_runs.find_runs(flat, cuts) == [runs_of(w) for w in parts]
        assert periodic_runs.find_runs(flat, cuts, 3, 3) == [runs_of(w, 3, 3) for w in parts]
    with pytest.raises(ValueError):
        periodic_runs.find_runs(flat, cuts, 2, 2)


def test_query_on_the_smallest_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = queries.QUERIES["op11_periodic_runs"](spark, SF).collect()
    want = [digests(*r) for r in docs if len(split(r.text)) < 1000]
    assert len(got) == len(docs) and len(want) > 0.8 * len(docs) and sum(x[1] > 0 for x in want) > 5
    assert set(want) <= set(map(tuple, got))


def test_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(periodic_runs, "BLOCK", 100)
    monkeypatch.setattr(periodic_runs, "ROWS", 3)
    rows = brute.odd_rows() + [(k, "\x1c a\x0bb\xa0 " * k, *["x"] * 10) for k in range(60, 75)]
    rows = [(*r[:4], None, *r[5:]) for r in rows]
    odd = brute.frame(spark, rows)
    order = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, periodic_runs.report(odd).collect()), key=order) == sorted((digests(r[0], r[1]) for r in rows), key=order)
    for r in periodic_runs.runs(odd).where("doc_id = 66").collect():
        assert [tuple(x) for x in r.runs] == [(0, 198, 3)] and r.collapsed == "\x1c a b\xa0"
    assert periodic_runs.report(spark.createDataFrame([], brute.SCHEMA)).count() == 0
