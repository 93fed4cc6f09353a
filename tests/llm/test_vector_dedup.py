"""Near-duplicate vectors against all cosines."""
import numpy as np

from docatlas.llm import queries, vector_dedup

SF = "/root/testdata/sf0.01"
SCHEMA = "vec_id long, embedding array<float>, label int, key string, cid string, low string, weight string, part string, place string, block string"
ORDER = lambda r: tuple((x is None, x) for x in r)


def expected(rows, threshold=0.93):
    """(vec_id, n_links, component_id, kept) of rows of (vec_id, embedding, label)."""
    good = [r[2] is not None and r[1] is not None and len(r[1]) > 0 and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1]) for r in rows]
    n, links, root = len(rows), np.zeros(len(rows), int), list(range(len(rows)))
    groups = {}
    for i in range(n):
        if good[i]:
            groups.setdefault((rows[i][2], len(rows[i][1])), []).append(i)

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for at in groups.values():
        x = np.array([rows[i][1] for i in at], dtype=np.float32).astype(float)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        a, b = np.nonzero(np.triu(x @ x.T >= threshold, 1))
        for i, j in zip(a, b):
            links[at[i]] += 1
            links[at[j]] += 1
            root[find(at[i])] = find(at[j])
    low = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            low[find(i)] = min(low.get(find(i), r[0]), r[0])
    return [(r[0], int(links[i]), low.get(find(i)), r[0] == low.get(find(i))) for i, r in enumerate(rows)]


def frame(spark, rows):
    return spark.createDataFrame([(*r, *["clash"] * 7) for r in rows], SCHEMA).repartition(4)


def collected(df):
    return sorted(map(tuple, df.collect()), key=ORDER)


def around(rng, centre, n, spread):
    x = centre + spread * rng.standard_normal((n, len(centre)))
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def test_odd_rows(spark):
    rng = np.random.default_rng(1)
    base = around(rng, rng.standard_normal(16), 30, 0.05)
    rows = [(i, x.tolist(), i % 3) for i, x in enumerate(base)]
    rows += [(0, base[0].tolist(), 0), (None, base[0].tolist(), 0), (None, [1.0, 0.0], 7), (100, None, 1), (101, [], 1), (102, [0.0] * 16, 1),
             (103, [1.0, None] * 8, 1), (104, [float("nan")] * 16, 1), (105, [float("inf")] + [1.0] * 15, 1), (106, base[1].tolist(), None),
             (107, base[1][:8].tolist(), 1), (108, (base[1] * 1e-30).tolist(), 1), (109, (-base[1]).tolist(), 1), (110, [1e-38] * 16, 5), (111, [1e38] * 16, 5)]
    want = sorted(expected(rows), key=ORDER)
    assert collected(vector_dedup.near_duplicates(frame(spark, rows))) == want
    assert sum(r[1] > 5 for r in want) > 20
    assert vector_dedup.near_duplicates(frame(spark, rows).limit(0)).count() == 0


def test_dense_groups_are_counted_whole(spark):
    """Groups larger than all windows: tight ones by their core, wide ones by comparison; chains and copies."""
    rng = np.random.default_rng(2)
    tight = around(rng, rng.standard_normal(32), 700, 0.02)
    wide = around(rng, rng.standard_normal(32), 300, 0.33)
    chain = np.array([[np.cos(t), np.sin(t)] + [0.0] * 30 for t in np.linspace(0, 3, 200)], dtype=np.float32)
    copies = np.repeat(around(rng, rng.standard_normal(32), 2, 0.1), 90, axis=0)
    noise = around(rng, np.zeros(32), 1500, 1.0)
    rows = [(i, x.tolist(), 0 if i % 7 else 1) for i, x in enumerate(np.concatenate([tight, wide, chain, copies, noise]))]
    got = collected(vector_dedup.near_duplicates(frame(spark, rows), window=16, links=8))
    want = sorted(expected(rows), key=ORDER)
    assert [r[0] for r in got] == [r[0] for r in want] and all(a[1] <= b[1] for a, b in zip(got, want))
    assert max(r[1] for r in want) > 500
    assert sum(r[1] for r in got) >= 0.99 * sum(r[1] for r in want)
    assert np.mean([a == b for a, b in zip(got, want)]) > 0.95


def test_recall_of_pairs_at_the_threshold(spark):
    """Pairs just above and below 0.93 among 4,000 vectors of one label, in small windows."""
    rng = np.random.default_rng(3)
    x = around(rng, np.zeros(64), 4000, 1.0).astype(float)
    rows = []
    for k in range(400):
        side = rng.standard_normal(64)
        side -= (side @ x[k]) * x[k]
        angle = np.arccos(0.9301 if k % 2 else 0.9299)
        rows.append((10_000 + k, (np.cos(angle) * x[k] + np.sin(angle) * side / np.linalg.norm(side)).tolist(), 3))
    rows += [(k, v.tolist(), 3) for k, v in enumerate(x)]
    got = vector_dedup.near_duplicates(frame(spark, rows), window=64).where("n_links > 0").collect()
    want = [r for r in expected(rows) if r[1]]
    assert 390 < len(want) < 420 and set(map(tuple, got)) <= set(want) and len(got) >= 0.97 * len(want)


def test_passes_follow_the_size():
    assert vector_dedup.passes(0) == vector_dedup.passes(256) == 1
    assert vector_dedup.passes(1000) < vector_dedup.passes(100_000) < vector_dedup.passes(10 ** 9) < 200


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    assert collected(queries.QUERIES["op12_vector_dedup"](spark, SF)) == sorted(expected(rows), key=ORDER)
