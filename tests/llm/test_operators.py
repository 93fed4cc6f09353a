"""Operators against brute force on an odd table, on empty tables and on their own special cases."""
import collections
import hashlib
import itertools
import math
import os
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docatlas.llm import bpe, decontaminate, exact_dedup, language_id, ngram_join, packed, pii, repeats, suffix_lm, toxicity, training_order
from docatlas.llm.common import may_be_in
from tests.llm import brute

SF = "/root/testdata/sf0.001"
ORDER = lambda r: tuple((x is None, x) for x in r)


@pytest.fixture(scope="module")
def odd(spark):
    return brute.frame(spark, brute.odd_rows())


@pytest.fixture(scope="module")
def pairs():
    return [(r[0], r[1]) for r in brute.odd_rows()]


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], brute.SCHEMA)


def same(got, want):
    assert sorted(map(tuple, got), key=ORDER) == sorted(map(tuple, want), key=ORDER)


# ------------------------------------------------------------------ 1


def test_language_scores_sum_over_all_segmentations():
    pieces = ["▁", "▁a", "a", "b", "ab", "▁ab", "ba"]
    table = np.vstack([np.random.default_rng(1).random((7, 2)) / 7, np.full((1, 2), 1e-9), np.zeros((1, 2))])
    model = language_id.Model(["x", "y"], pieces, table)

    def total(word, lang):
        if not word:
            return 1.0
        known = sum(table[k, lang] * total(word[len(p):], lang) for k, p in enumerate(pieces) if word.startswith(p))
        return known + (1e-9 * total(word[1:], lang) if word[0] not in pieces else 0)

    words = ["a", "ab", "abba", "bz", "a" * 50, "b"]
    want = [[np.log(total("▁" + w, lang)) for lang in (0, 1)] for w in words if len(w) < 20]
    got = model.score(words)
    assert np.allclose(got[[i for i, w in enumerate(words) if len(w) < 20]], want)
    assert np.isfinite(got).all()
    counts = model.expected(["abba"], np.array([0]), np.array([3.0]))
    eps, step = 1e-6, []
    for k in range(7):  # posterior counts are derivatives of the log sum
        t = table.copy()
        t[k, 0] *= 1 + eps
        step.append(3 * (language_id.Model(["x", "y"], pieces, t).score(["abba"])[0, 0] - model.score(["abba"])[0, 0]) / eps)
    assert np.allclose(counts[0], step, atol=1e-4)


def test_language_held_out_and_odd(spark, odd, empty, pairs):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = language_id.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (got.lang_pred == got.lang).mean() > 0.95
    out = language_id.identify(odd).collect()
    assert len(out) == len(pairs)
    und = sorted(str(r.doc_id) for r in out if r.lang_pred == "und")
    assert und == sorted(str(i) for i, t in pairs if not any(c.isalpha() for c in t or ""))
    assert all(0 <= r.score <= 1 and (r.lang_pred != "und" or r.score == 0) for r in out)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in out)
    assert language_id.identify(empty).count() == 0
    assert language_id.accepted(odd).columns == odd.columns


# ------------------------------------------------------------------ 2


def test_toxicity(spark, odd, empty, pairs):
    rng = random.Random(2)
    common = [f"w{i}" for i in range(200)]
    rows, labels = [], []
    for i in range(900):
        bad = i % 6 == 0
        rows.append((i, " ".join(rng.sample(common, 20) + (["vile", "vilest"] if bad else []))))
        if i % 5 < 3:
            labels.append((i, 1 if bad else 0))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = toxicity.detect(docs, marks).collect()
    held = [r for r in got if r.held_out]
    assert len(got) == 900 and len(held) > 100
    assert np.mean([r.predicted == (r.doc_id % 6 == 0) for r in held]) > 0.97
    odd_marks = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (2, None), (999, 1)], "doc_id long, toxic int")
    assert toxicity.detect(odd, odd_marks).count() == len(pairs)
    assert {r.score for r in toxicity.detect(odd, odd_marks.limit(0)).collect()} == {0.0}
    assert toxicity.detect(empty, odd_marks).count() == 0


# ------------------------------------------------------------------ 3


def test_bpe(spark, odd, empty, pairs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    d = bpe.encode_decode(odd)
    got = [(r.doc_id, tuple(r.ids), r.decoded) for r in d.collect()]
    same(got, [(i, tuple(t.encode(x or "", add_special_tokens=False).ids), x or "") for i, x in pairs])
    want = []
    for i, x in pairs:
        ids = t.encode(x or "", add_special_tokens=False).ids
        text = t.decode(ids, skip_special_tokens=False)
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    same(bpe.report(odd).collect(), want)
    same(bpe.decode(d.select("doc_id", "ids")).collect(), [(i, x or "") for i, x in pairs])
    assert bpe.report(empty).count() == 0
    assert bpe.pieces_table(spark).count() == 50257


# ------------------------------------------------------------------ 4


def test_base_spans():
    rng = random.Random(3)
    for _ in range(4000):
        text = "".join(rng.choice(["1", "2", "45", "255", ".", "-", " ", "+", "(", ")", "@", "a", "b.c", "4111 1111 1111 1111", "é"]) for _ in range(rng.randint(0, 30)))
        assert pii.base_spans(text) == brute.private(text), text
    assert pii.base_spans("a" * 200_000 + "1" * 200_000 + "@" * 1000) == brute.private("")


def test_field_adds_other_spellings(spark, odd, empty, pairs):
    rng = random.Random(4)
    texts = []
    for i in range(300):
        texts.append(f"words here user{i}@mail{i % 7}.example.com and then +1 ({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)} or 10.0.{i % 200}.7 in {1900 + i} pages")
    weights = pii.train(texts)
    base, spans = pii.find("please write to jane.doe (at) mail3.example.com or ring (312) 555-0187 in 1987", weights)
    assert base == []
    assert {k for _, _, k in spans} == {"email", "phone"}
    assert all(set(b) <= set(s) for b, s in (pii.find(t, weights) for t in texts))
    for size in (9, 68, 200):
        local = ("jane" * size)[:size]
        _, spans = pii.find(f"please write to {local} (at) mail3.example.com or ring", weights)
        assert (16, 16 + size + len(" (at) mail3.example.com"), "email") in spans
    cuts = list(pii.windows("x" * 90 + "@" + "y" * 90 + " z" * 60 + " 12", []))
    assert cuts[0][0] == 0 and cuts[0][1] >= 181
    got = pii.scan(odd, weights)
    assert got.count() == len(pairs)
    bases = {(r.doc_id, r.base_sha256) for r in got.collect()}
    assert bases == {(i, hashlib.sha256(pii.digest(brute.private(t)).encode()).hexdigest()) for i, t in pairs}
    assert pii.scan(empty).count() == 0


def test_segmentation_is_the_best_one():
    """The dynamic programme against all segmentations of a short text."""
    text = "call 555-01 or 02"
    toks = pii.tokens(text, 0, len(text))
    rng = random.Random(6)
    cands = pii.candidates(text, toks)
    weights = {f: rng.uniform(-1, 2) for cs in cands.values() for _, _, fs in cs for f in fs}
    flat = [(i, e, k, sum(weights[f] for f in fs)) for e, cs in cands.items() for i, k, fs in cs]
    sums = [sum(s for *_, s in pick) for n in range(4) for pick in itertools.combinations(flat, n)
            if all(a[1] <= b[0] or b[1] <= a[0] for a, b in itertools.combinations(pick, 2))]
    alpha, beta = pii.sums(len(toks), {e: [(i, k, sum(weights[f] for f in fs)) for i, k, fs in cs] for e, cs in cands.items()})
    assert np.isclose(alpha[-1], beta[0])
    if len(flat) < 60:
        assert alpha[-1] >= max(sums)


# ------------------------------------------------------------------ 5


def test_permutation():
    for n in (1, 2, 3, 17, 256, 1000):
        for key in (0, 1, 99):
            out = training_order.permute(np.arange(n), n, key)
            assert sorted(out.tolist()) == list(range(n))
            assert (training_order.permute(out, n, key, inverse=True) == np.arange(n)).all()
    assert (training_order.permute(np.arange(1000), 1000, 1) != training_order.permute(np.arange(1000), 1000, 2)).any()


def test_shards(odd, empty, pairs, tmp_path):
    folder = f"file://{tmp_path}/shards"
    got = training_order.write_shards(odd, folder, length=32).collect()
    n = len(got)
    assert sorted(r.slot for r in got) == list(range(n))
    rows = np.concatenate(list(training_order.read(folder, length=32)))
    assert rows.shape == (n, 32)
    assert np.array_equal(np.concatenate(list(training_order.read(folder, 5, length=32))), rows[5:])
    assert sorted(os.listdir(f"{tmp_path}/shards")) == ["shard-00000000.bin"]
    encoding, _, end = training_order.codec("/opt/tokenizers/byte_bpe_50k.tiktoken")
    want = sorted(tuple([*encoding.encode_ordinary(t or ""), end]) for _, t in pairs)
    firsts = sorted(tuple(rows[r.slot][:r.n_tokens].tolist()) for r in got if r.seq_no == 0)
    assert firsts == sorted(w[:32] for w in want)
    assert sum(r.n_tokens for r in got) == sum(map(len, want))
    again = training_order.write_shards(odd, folder, length=32).collect()
    assert sorted(r.slot for r in again) == list(range(n))
    assert training_order.write_shards(empty).count() == 0


# ------------------------------------------------------------------ 6


def test_decontamination(spark, odd, empty):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    items = [(k, " ".join(word() for _ in range(n))) for k, n in enumerate((30, 20, 13, 9, 8, 5, 1, 0))] + [(2, "a second text of the same item id with enough words in it to count"), (None, None)]
    docs = []
    for i in range(60):
        body = [word() for _ in range(rng.randint(0, 60))]
        part = items[i % 8][1].split()
        if i % 3 == 0:
            part = [w if k % 7 != 3 else "other" for k, w in enumerate(part)]
        at = rng.randint(0, len(body))
        docs.append((i, " ".join(body[:at] + (part if i % 4 else []) + body[at:]).upper()))
    docs += [(90, None), (91, ""), (None, items[0][1]), (92, "..."), (92, items[1][1])]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = brute.leaks(docs, items)
    for rows in (10 ** 6, 0):  # broadcast and shuffle
        got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(d, b, broadcast_rows=rows).collect()}
        # seeds tolerate substitutions but not every pattern of them: nothing but true overlaps, and nearly all of them
        assert got <= want
        assert len(want - got) <= len(want) // 10
    plain = {(i, k) for i, t in docs for k, x in items if x and len(x.split()) >= 5 and x.upper() in (t or "").upper()}
    assert plain <= got
    kept = decontaminate.decontaminate(d, b)
    assert sorted(map(tuple, kept.collect()), key=ORDER) == sorted([r for r in docs if r[0] == 92 and r[1] == "..." or r[0] not in {i for i, _ in got}], key=ORDER)
    assert decontaminate.decontaminate(odd, b).columns == odd.columns
    assert decontaminate.contaminated(empty, b).count() == 0
    assert decontaminate.contaminated(odd, b.limit(0)).count() == 0


def test_decontamination_finds_every_substitution(spark):
    """All places that may differ, for items of every length up to the window."""
    docs, items = [], []
    for n in range(1, 17):
        words = [f"t{n}x{k}" for k in range(n)]
        items.append((n, " ".join(words)))
        size = min(13, n)
        for gone in itertools.combinations(range(size), size - math.ceil(0.8 * size)):
            docs.append((len(docs), "before " + " ".join("other" if k in gone or k >= size else w for k, w in enumerate(words)) + " behind"))
    docs += [(len(docs) + k, " ".join(t.split()[2:])) for k, (_, t) in enumerate(items)]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = brute.leaks(docs, items)
    for rows in (10 ** 6, 0):
        assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(d, b, broadcast_rows=rows).collect()} == want


# ------------------------------------------------------------------ 7


def write(df, folder):
    df.write.parquet(str(folder))
    return str(folder)


def test_exact_dedup(spark, odd, empty, pairs, tmp_path):
    path = write(odd, tmp_path / "odd")
    want = brute.exact(pairs)
    for options in ({}, {"bytes_per_batch": 1}, {"digest": lambda t: F.length(t).cast("string")}, {"digest": lambda t: F.lit("same")}):
        got = exact_dedup.dedup_report(spark, path, **options).collect()
        same([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got], want)
        assert sum(r.kept for r in got) == len({t or "" for _, t in pairs})
        assert all(r.doc_id == r.keep_id for r in got if r.kept)
    kept = exact_dedup.dedup(odd)
    assert kept.columns == odd.columns
    assert sorted(r.text or "" for r in kept.collect()) == sorted({t or "" for _, t in pairs})
    assert exact_dedup.dedup_report(spark, write(empty, tmp_path / "empty")).count() == 0
    assert exact_dedup.dedup(empty).count() == 0


def test_membership_filter(spark):
    rows, keys = spark.range(2000).withColumnRenamed("id", "k"), spark.range(0, 2000, 7).withColumnRenamed("id", "k")
    d = may_be_in(rows, keys, ["k"], bits=4096)
    assert d.where("k % 7 = 0 and not _near").count() == 0
    assert d.where("k % 7 <> 0 and _near").count() < 400


# ------------------------------------------------------------------ 8


def near_rows(n=150):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(400)]
    rows, bases = [], [[rng.choice(words) for _ in range(rng.randint(3, 120))] for _ in range(6)]
    for i in range(n):
        own = list(rng.choice(bases))
        for _ in range(rng.randint(0, 3)):
            own[rng.randrange(len(own))] = rng.choice(words)
        rows.append((i, " ".join(own)))
    return rows


def test_shared_tokens():
    token = np.array([1, 1, 1, 2, 2, 3, 3, 3, 9], dtype=np.uint64)
    owner = np.array([7, 5, 6, 5, 7, 5, 5, 6, 5])
    size = np.array([100, 100, 20, 100, 100, 100, 100, 20, 100])
    got = [tuple(map(int, x)) for x in zip(*ngram_join.shared(token, owner, size))]
    assert got == [(5, 7, 2, 11)]  # 6 is too small for both
    many = np.arange(50)
    a, b, n, need = ngram_join.shared(np.ones(50, dtype=np.uint64), many, np.full(50, 100))
    assert len(a) == 49 and (n > need).all() and set(a) == {0}


@pytest.mark.parametrize("block", [2000, 4])
def test_near(spark, odd, empty, pairs, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", block)  # small blocks: links across blocks
    rows = near_rows()
    got = ngram_join.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    same(got, [(i, *x) for (i, _), x in zip(rows, brute.near(rows))])
    if block == 2000:
        same(ngram_join.report(odd).collect(), [(i, *x) for (i, _), x in zip(pairs, brute.near(pairs))])
        kept = ngram_join.dedup(odd)
        assert kept.columns == odd.columns
        groups = {x[1] for (i, t), x in zip(pairs, brute.near(pairs)) if x[0]}
        assert kept.where("text rlike '\\\\S'").count() == len(groups)
        assert kept.where("text is null or not text rlike '\\\\S'").count() == sum(not x[0] for x in brute.near(pairs))
        assert ngram_join.report(empty).count() == 0


# ------------------------------------------------------------------ 9


def test_language_model(spark, odd, empty, pairs):
    got = [tuple(r)[:5] + (round(r.base_score, 6),) for r in suffix_lm.score(odd).collect()]
    same(got, brute.unigrams(pairs))
    assert suffix_lm.score(empty).count() == 0
    rng = random.Random(9)
    rows = []
    for i in range(400):
        text = []
        while len(text) < 30:  # "ab" is followed by "cd", else independent
            w = rng.choice(["ab", "ef", "gh", "ij"])
            text += [w, "cd"] if w == "ab" else [w]
        rows.append((i, " ".join(text)))
    held = [r for r in suffix_lm.score(spark.createDataFrame(rows, "doc_id long, text string"), p_min=1e-3).collect() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held) + 50
    nothing = suffix_lm.score(spark.createDataFrame([(None, "a b")], "doc_id long, text string")).head()
    assert (nothing.n_tokens, nothing.n_known, nothing.train_tokens, nothing.base_score, nothing.score) == (3, 0, 0, 0.0, 0.0)


def test_states_are_distributions(spark):
    rows = [(i, 0, i, "a b a c a b") for i in range(50)] + [(i, 0, i, "c c b") for i in range(50, 90)]
    d = spark.createDataFrame(rows, "chunk long, row long, doc_id long, text string")
    counts: dict = {}
    for i, _, _, t in rows:
        if suffix_lm.fold(i) > 0:
            for w in suffix_lm.tokens(t):
                counts[w] = counts.get(w, 0) + 1
    n = sum(counts.values())
    tree = suffix_lm.grow(d, counts, n, 2, 1e-3, 1.0, 5.0)
    assert len(tree.levels) == 2 and len(tree.levels[0][0])
    for before in ([], [b"a"], [b"a", b"b"], [b"c", b"c"]):
        total = 0.0
        for w, c in [*counts.items(), (b"unseen", 1)]:
            p = tree.refine([before + [w]], np.array([0.5] * len(before) + [(c if w != b"unseen" else 1) / (n + 1)]))[-1]
            total += p
        assert np.isclose(total, 1)


def suffix_scores(rows, depth, test, prior, few):
    """Log10 score of each row of (id, text): counts, states and smoothing by dictionaries."""
    start, texts = b"<start>", [(i, suffix_lm.tokens(t or "")) for i, t in rows]
    c, size, gram = collections.Counter(), collections.Counter(), collections.Counter()
    histories = lambda ws, k: [tuple(([start] + ws)[k + 1 - d:k + 1]) for d in range(1, min(depth, k + 1) + 1)]
    for i, ws in texts:
        for k, w in enumerate(ws if suffix_lm.fold(i) > 0 else []):
            c[w] += 1
            for h in histories(ws, k):
                size[h] += 1
                gram[h, w] += 1
    n, singles = sum(c.values()), max(1, sum(x == 1 for x in c.values()))
    share = lambda h, w: gram[h, w] / size[h] if h else c[w] / n
    gain = collections.Counter()
    for (h, w), x in gram.items():
        gain[h] += x * math.log(share(h, w) / share(h[1:], w))
    states = {h for h, x in size.items() if x >= few and gain[h] >= max(test, 0.01 * x)}
    out = []
    for i, ws in texts:
        total = 0.0
        for k, w in enumerate(ws):
            p = (c[w] or singles) / (n + singles)
            hs = histories(ws, k)
            for h in hs[:max((len(h) for h in hs if h in states), default=0)]:
                p = (gram[h, w] + prior * p) / (size[h] + prior)
            total += math.log10(p)
        out.append((i, round(total, 6)))
    return out, len(states)


def test_suffix_tree_states(spark):
    rng = random.Random(12)
    rows = [(i, " ".join(rng.choice(["a b c d", "a b", "e a", "f", "g h", "b c e f a"]) for _ in range(rng.randint(0, 12)))) for i in range(300)] + [(None, "a b"), (7, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for depth in (1, 3, 5):
        want, n = suffix_scores(rows, depth, 5.0, 3.0, 4)
        assert n > 5
        same([(r.doc_id, round(r.score, 6)) for r in suffix_lm.score(d, depth=depth, test=5.0, prior=3.0, few=4).collect()], want)


def test_suffix_tree_grows_with_the_corpus(spark):
    """Contexts that occur five times in 300,000 tokens are states."""
    rng = random.Random(13)
    parts = [f"w{k} x{k}" for k in range(4000)] * 5
    rng.shuffle(parts)
    rows = [(i, " ".join(parts[i::1000] + ["the of and"] * 90)) for i in range(1000)]
    pairs = [(5000 + i, f"w{i} x{i}") for i in range(200) if suffix_lm.fold(5000 + i) == 0]
    got = [r for r in suffix_lm.score(spark.createDataFrame(rows + pairs, "doc_id long, text string")).collect() if r.doc_id >= 5000]
    assert got[0].train_tokens > 250_000 and np.mean([r.score - r.base_score for r in got]) > 2


# ------------------------------------------------------------------ 10


def test_repeats(spark, odd, empty, pairs):
    same(repeats.remove_repeats(odd).collect(), brute.repeats(pairs))
    rng = random.Random(10)
    parts = ["".join(rng.choice("abé") for _ in range(rng.randint(20, 120))) for _ in range(12)]
    rows = [(rng.randint(0, 80), "".join(rng.choice(parts) for _ in range(rng.randint(0, 6)))) for _ in range(90)] + [(81, "a" * 400), (82, "a" * 300 + "b"), (83, "ab" * 90), (7, "ba" * 90)]
    same(repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect(), brute.repeats(rows))
    assert repeats.remove_repeats(empty).count() == 0


def test_interval_expansion():
    rng = random.Random(11)
    base = bytes(rng.choice(b"ab") for _ in range(76))
    xs = list(dict.fromkeys([bytes(rng.choice(b"ab") for _ in range(rng.randint(50, 76))) for _ in range(40)] + [base[i:] + bytes([97 + i]) * i for i in range(25)]))
    docs = np.array([rng.randint(0, 50) for _ in xs])
    for x, v in zip(xs, repeats.smallest_docs(xs, docs)):
        assert v.tolist() == [min(d for y, d in zip(xs, docs) if x[s:s + 50] in y) for s in range(len(x) - 49)]


# ------------------------------------------------------------------ shared


def test_packing():
    assert packed.unpack(packed.pack(b"", b"abc", b"x" * 1000)) == [b"", b"abc", b"x" * 1000]
    for n in (0, 1, 255, 256, 70_000, 1 << 40):
        assert packed.widen(packed.narrow(np.array([0, n]))).tolist() == [0, n]
    assert packed.widen(packed.narrow(np.zeros(0, dtype=np.int64))).tolist() == []


def test_shingles_are_cut_once(spark, odd):
    join = ngram_join.Join(odd)
    order = spark.sparkContext.broadcast(join.order())
    live = spark.createDataFrame([(0, 0, 1)], "set_id long, class long, blocks int")
    scans = join.sets(order, live)._jdf.queryExecution().optimizedPlan().toString()
    assert "tokens" in scans and "text" not in scans and "octet_length" not in scans
    stored = {r.set_id: np.frombuffer(r.tokens, dtype=np.uint64) for r in join.first.where("kind = 0").collect()}
    assert all(ngram_join.set_id(s) == i and (np.diff(s.astype(object)) > 0).all() for i, s in stored.items() if len(s))


def test_segments_do_not_depend_on_blocks(monkeypatch):
    rng = random.Random(3)
    bodies = [bytes(rng.choice(b"ab \xc3") for _ in range(n)) for n in (0, 49, 50, 51, 400, 0, 1000)]
    whole = repeats.Segments(bodies)
    monkeypatch.setattr(repeats, "BLOCK", 64)
    cut = repeats.Segments(bodies)
    for name in ("key", "doc", "start", "count"):
        assert getattr(whole, name).tolist() == getattr(cut, name).tolist()
    covered = [(d, s + i) for d, s, n in zip(cut.doc.tolist(), cut.start.tolist(), cut.count.tolist()) for i in range(n)]
    assert covered == [(d, s) for d, x in enumerate(bodies) for s in range(len(x) - 49)]
    keys = {}
    for d, s, n, k in zip(cut.doc.tolist(), cut.start.tolist(), cut.count.tolist(), cut.key.tolist()):
        for i in range(s, s + n):
            assert keys.setdefault(bodies[d][i:i + 50], k) == k


def test_tokens_of_many_texts_at_once():
    texts = ["", " ", "a", "A\tb\x0b c\x0c\r\nD", "\x1c\x85  Ä x", "x\ud800 y", "  two  words  "]
    sizes, words = suffix_lm.split(texts)
    every = [suffix_lm.tokens(t) for t in texts]
    assert sizes.tolist() == [len(x) for x in every]
    assert words.to_pylist() == [w for x in every for w in x]
    h = suffix_lm.Histories((sizes, words), 2)
    assert h.words.take(pa.array(h.symbols)).to_pylist() == words.to_pylist()
    assert suffix_lm.read_words(*suffix_lm.pack_words(h.words[1:4])) == h.words[1:4].to_pylist()


def test_stored_gives_python_few_rows_at_a_time(spark):
    from docatlas.llm.common import stored

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(key)

    def size(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], ["n"])

    got = stored(spark.range(100, numPartitions=2).mapInArrow(size, "n long"), "few", batch=8).collect()
    assert sum(r.n for r in got) == 100 and max(r.n for r in got) == 8
    assert spark.conf.get(key) == old


def test_probe_steps_grow_with_the_depth(spark):
    """A walk down a long chain looks at each node once, not at all that is below it."""
    import sys

    base = np.arange(1500, dtype=np.uint64)
    tree = ngram_join.PrefixTree([np.append(base, np.arange(5, dtype=np.uint64) + np.uint64(10_000 + 10 * i)) for i in range(3)])
    for i in range(2):
        tree.insert(i)
    calls = 0

    def count(frame, event, arg):
        nonlocal calls
        calls += event in ("call", "c_call")

    sys.setprofile(count)
    try:
        got = tree.probe(2, lambda i: False)
    finally:
        sys.setprofile(None)
    assert sorted(got) == [0, 1] and calls < 100_000


def test_steps_that_read_sets_get_one_chunk_at_a_time(spark, monkeypatch):
    asked = {}

    def spied(f):
        def run(df, *args, batch=None, **more):
            asked[f.__name__, *args[:1]] = batch
            return f(df, *args, batch=batch, **more)
        return run

    for f in (ngram_join.stored, ngram_join.components):
        monkeypatch.setattr(ngram_join, f.__name__, spied(f))
    join = ngram_join.Join(spark.createDataFrame(near_rows(40), "doc_id long, text string"))
    join.components()
    assert asked["stored", "shingles"] == asked["stored", "sets"] == asked["components",] == join.layout.chunk_rows


def test_repeats_drop_their_first_shuffles(spark, monkeypatch):
    tidy, old = {}, repeats.stored

    def spied(df, name, **more):
        tidy[name] = more.get("tidy", False)
        return old(df, name, **more)

    monkeypatch.setattr(repeats, "stored", spied)
    assert repeats.remove_repeats(spark.createDataFrame([(1, "x" * 60), (2, "x" * 60)], "doc_id long, text string")).count() == 2
    assert tidy == {"repeats": True}


def test_coded_runs_give_texts_back():
    ids, texts = [3, None, 5], ["a B a", "", "c"]
    sizes, words = suffix_lm.split(texts)
    h = suffix_lm.Histories((sizes, words), 2)
    for size in (1, 300, 70_000):
        x = np.arange(size)[::-1].copy()
        assert (suffix_lm.read_planes(suffix_lm.planes(x)) == x).all()
    part = pa.RecordBatch.from_arrays([pa.array([7] * 3), pa.array(range(3)), pa.array(ids, pa.int64()), pa.array(texts)], ["chunk", "row", "doc_id", "text"])

    class Frame:
        def mapInArrow(self, run, schema):
            return list(run(iter([part])))

    (got,) = suffix_lm.coded_runs(Frame())
    assert got.column("lo").to_pylist() == [0] and got.column("hi").to_pylist() == [2]
    own, again = suffix_lm.read_run(got.column("payload")[0].as_py(), 2)
    assert own == ids and again.words.to_pylist() == h.words.to_pylist()
    for name in ("sizes", "symbols", "hashes"):
        assert (getattr(again, name) == getattr(h, name)).all()
    assert all((a == b).all() for a, b in zip(again.grams + again.contexts, h.grams + h.contexts))


def test_words_as_arrays_are_the_words_of_the_texts():
    rng = random.Random(3)
    texts = ["", " ", "a", " a", "a ", "a  b", "a \n b", "a\u00a0 b", "a \u2003b c", "x y\u3000z w", "ä ö", "a\x1c b \x85c", "d e", "", "<|endoftext|> f g"]
    texts += ["".join(rng.choice(["a", "bc", " ", " ", "\n", "\t", "é", "\u00a0", "\u200a", "日", "."]) for _ in range(rng.randint(0, 30))) for _ in range(300)]
    counts, codes, words = bpe.coded_words(texts)
    got, words = iter(codes.tolist()), words.to_pylist()
    assert [[words[next(got)].decode() for _ in range(n)] for n in counts.tolist()] == [bpe.words_of(t) for t in texts]
    assert next(got, None) is None and len(set(words)) == len(words)
    every = pa.array([b"", b"x", b"", b"yz"], pa.large_binary())
    assert [packed.word_list(x) for x in (every, every[1:], every[:0], every[4:], pa.array([b""], pa.large_binary()))] == [[b"", b"x", b"", b"yz"], [b"x", b"", b"yz"], [], [], [b""]]
    for part in ([], [""], ["", ""], ["", "a b"], ["a", ""]):
        assert bpe.coded_words(part)[0].tolist() == [len(bpe.words_of(t)) for t in part]


def test_distinct_words_are_encoded_apart():
    path = bpe.vocabulary_file(training_order.RANKS)
    words = ["first", " plain", " two", "\n", " x\ny", "  ", " é", " 12a", "", " don't"]
    first, n, ids = training_order.encode_distinct(words, path)
    encoding = training_order.codec(path)[0]
    assert [ids[a:a + k].tolist() for a, k in zip(first.tolist(), n.tolist())] == [encoding.encode_ordinary(w) for w in words]
    assert [len(x) for x in training_order.encode_distinct([], path)] == [0, 0, 0]


def test_sets_are_linked_by_counts_of_common_tokens():
    rng = random.Random(21)
    for _ in range(60):
        bases = [rng.sample(range(400), rng.randint(1, 60)) for _ in range(3)]
        sets = [np.array(sorted(set(rng.choice(bases)[rng.randint(0, 3):]) | {rng.randrange(500) for _ in range(rng.randint(0, 8))} | {0}), dtype=np.uint64) for _ in range(rng.randint(2, 30))]
        ids, left = rng.sample(range(10**6), len(sets)), [rng.random() < 0.4 for _ in sets]
        linked = [(i, j) for i in range(len(ids)) for j in range(i) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j]))]
        for got, want in ((ngram_join.link_groups(ids, sets), linked),
                          (ngram_join.link_groups(ids, sets, list(range(len(ids))), left), [(i, j) for i, j in linked if left[i] != left[j]])):
            a, b = np.array([(ids[i], ids[j]) for i, j in want], dtype=np.int64).reshape(-1, 2).T
            assert sorted(got) == sorted(zip(*(x.tolist() for x in ngram_join.stars(a, b))))


def test_sets_with_many_tokens_of_their_own_are_not_compared():
    """Copies of one text that have more than a fifth of own tokens, and copies that have less."""
    base = np.arange(100, dtype=np.uint64)
    sets = [np.append(base[i % 7:], np.arange(own, dtype=np.uint64) + np.uint64(1000 * (i + 1))) for i, own in enumerate([40] * 30 + [2] * 10)]
    tree = ngram_join.PrefixTree(sets)
    for i in range(len(sets)):
        tree.insert(i)
    found = [tree.wanted(i, lambda at: at < 0).tolist() for i in range(len(sets))]
    assert found == [[]] * 30 + [[j for j in range(30, 40) if j != i] for i in range(30, 40)]
    assert len(tree.leaf) == 10
    outer = np.arange(len(sets)) >= 38
    assert ngram_join.PrefixTree(sets, outer).common.tolist() == [len(set(range(i % 7, 100)) & set(range(3, 100))) if i < 38 else 100 - i % 7 for i in range(40)]


@pytest.mark.parametrize("some", [True, False])
def test_blocks_of_a_class_are_spread_over_tasks(spark, some):
    """Blocks meet other blocks only, in as many tasks as configured, however few bytes they have."""
    sets = spark.createDataFrame([(i, 3, np.arange(3, dtype=np.uint64).tobytes(), 1, 4, i % 4) for i in range(16)], "set_id long, n long, tokens binary, class long, blocks int, block int")
    links = spark.createDataFrame([(i, i % 4) for i in range(4, 12)], "a long, b long")
    plan = ngram_join.Join._across(sets, links, some=some)._jdf.queryExecution().optimizedPlan().toString()
    assert f"RepartitionByExpression [class#" in plan and f"], {spark.conf.get('spark.sql.shuffle.partitions')}" in plan
    got = ngram_join.Join._across(sets, links, some=some).collect()
    assert got and all(r.a % 4 != r.b % 4 or r.a // 4 == 3 for r in got)


def test_words_of_shingles_are_ascii_words():
    texts = ["", " ", "a", "A\tb\x0b c\x0c\r\nD", "\x1c\x85  Ä x", "x\ud800 y", "  two  words  ", "", "\x00 \x00a"]
    ends, codes, words = ngram_join.coded_words(texts)
    split = [t.encode("utf-8", errors="replace").lower().split() for t in texts]
    assert ends.tolist() == np.cumsum(list(map(len, split))).tolist()
    assert [words[c] for c in codes] == [w for x in split for w in x] and len(set(words)) == len(words)
    assert ngram_join.shingle_sets([]) == [] and [len(s) for s in ngram_join.shingle_sets(["", "a", "a b c d e f"])] == [0, 1, 2]
