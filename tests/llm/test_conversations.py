"""Repair of conversations against a search over (cost, letters) by plain comparison of strings."""
import functools
import hashlib
import itertools
import random
import re
import zlib

from docatlas.llm import conversations as conv
from docatlas.llm import queries

SF = "/root/testdata/sf0.01"
ORDER = lambda r: tuple((x is None, x) for x in r)
SCHEMA = "conv_id long, turn long, role string, text string, gone string, nth string, mark string, audit string, cost string"


def damage(rows):
    out = []
    for c, t, role, text in rows:
        show = lambda x: " " if x is None else str(x)
        role, text, h = show(role), show(text), zlib.crc32(f"{show(c)}:{show(t)}".encode()) % 20
        if h != 0:
            text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
            out += [(c, t, "user" if h == 4 else role, text)] * (2 if h == 3 else 1)
    return out


def cheapest(rows):
    """(cost, audit, repaired rows) of rows of (role, text, fault): least cost, then least string."""
    @functools.cache
    def best(i, last):
        ways = [(0, "", ())] if i == len(rows) and last in ("", "a") else []
        follow = {"": "su", "s": "u", "u": "a", "a": "u"}[last]
        names = {"u": "user", "a": "assistant"}
        for x in follow.replace("s", ""):
            # at most two insertions in a row can help; the third would repeat a state
            if depth[0] < 2:
                depth[0] += 1
                cost, letters, said = best.__wrapped__(i, x) if depth[0] else None
                depth[0] -= 1
                ways.append((cost + 3, "I" + letters, (f"{names[x]}:", *said)))
        if i < len(rows):
            held, depth[0] = depth[0], 0
            role, text, fault = rows[i]
            cost, letters, said = best(i + 1, last)
            ways.append((cost + 4, "D" + letters, said))
            if fault not in ("blank", "duplicate"):
                more = 3 * (fault == "truncated")
                for x in follow:
                    if role[:1] == x:
                        cost, letters, said = best(i + 1, x)
                        ways.append((cost + more, "K" + letters, (f"{role}:{text}", *said)))
                    if x in names:
                        cost, letters, said = best(i + 1, x)
                        ways.append((cost + more + 3, "R" + letters, (f"{names[x]}:{text}", *said)))
            depth[0] = held
        return min(ways, default=(10 ** 9, "", ()))

    depth = [0]
    return best(0, "")


def expected(rows):
    """Report rows of (conv_id, turn, role, text) rows."""
    out = []
    after = damage(rows)
    for c in {r[0] for r in rows}:
        own = sorted((r[1:] for r in after if r[0] == c), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, marked, count = set(), [], dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        for _, role, text in own:
            body = text.rstrip(" \t\n\x0b\x0c\r")
            fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                count[fault] += 1
            marked.append((role, text, fault))
        turns = [t for t, _, _ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(own))
        cost, audit, said = cheapest(tuple(marked))
        out.append((c, gaps, *count.values(), illegal, cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest()))
    return out


def some(rng, n):
    return [(rng.choice(["user", "user", "assistant", "assistant", "system", "tool", "", " "]),
             rng.choice(["a.", "b!", "c?", "cut", " ", "", "d. \n", "\x0b\x0c", "e.\x1c"])) for _ in range(n)]


def test_damage_and_repair(spark):
    rng = random.Random(3)
    rows = [(c, t, *some(rng, 1)[0]) for c in range(250) for t in range(rng.randint(1, 9)) if rng.random() < 0.9]
    rows += [(None, 1, "user", "x."), (None, None, None, None), (None, 0, "assistant", None), (300, None, "system", "s."), (300, 2, "user", "u."), (300, 9, "assistant", "a.")]
    rows += [(301, 5, "user", "same.")] * 4 + [(301, 5, "assistant", "b."), (301, -3, "system", "t.")]
    rows += [(302, t, "user", "long " * 20000 + ".") for t in range(3)]
    gone = next(c for c in range(400, 999) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows.append((gone, 0, "user", "x."))
    df = spark.createDataFrame([(*r, *["clash"] * 5) for r in rows], SCHEMA).repartition(5)
    got = sorted(map(tuple, conv.report(df).collect()), key=ORDER)
    assert got == sorted(expected(rows), key=ORDER)
    assert (gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) in got
    assert conv.report(df.limit(0)).count() == 0


def test_repaired_rows(spark):
    rows = [(1, 0, "system", "s."), (1, 1, "assistant", "a."), (1, 2, "assistant", "a."), (1, 3, "user", "cut")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    plan = conv.audits(df).collect()
    assert [(r.cost, r.audit) for r in plan] == [(11, "KIKDD")]
    assert [tuple(r) for r in conv.repaired(df).orderBy("position").collect()] == [
        (1, 0, "system", "s.", "K"), (1, 1, "user", "", "I"), (1, 2, "assistant", "a.", "K")]


def test_all_legal(spark):
    got = conv.repaired(spark.read.parquet(f"{SF}/conversations.parquet")).selectExpr("conv_id", "position", "substring(role, 1, 1) as x").collect()
    by = {}
    for r in sorted(got):
        by[r.conv_id] = by.get(r.conv_id, "") + r.x
    assert len(by) > 50 and all(re.fullmatch("s?(ua)+", x) for x in by.values())


def test_query_on_a_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = queries.QUERIES["op13_conversation_repair"](spark, SF).collect()
    assert sorted(map(tuple, got), key=ORDER) == sorted(expected(rows), key=ORDER)


def test_blocks_do_not_change_paths(monkeypatch):
    """Rows beyond a block: ranks stand for digits."""
    rng = random.Random(4)
    for size in (1, 2, 3, 7):
        monkeypatch.setattr(conv, "BLOCK", size)
        monkeypatch.setattr(conv.Path, "top", conv.SLOT * size + conv.RANK)
        for _ in range(150):
            rows = [(role, text, rng.choice([None, None, "blank", "duplicate", "truncated"])) for role, text in some(rng, rng.randint(0, 25))]
            path = conv.Path()
            for role, _, fault in rows:
                path.add(conv.kind_of(role[:1], fault in ("blank", "duplicate"), fault == "truncated"))
            want = cheapest(tuple(rows))
            assert path.end() == want[:2]
            assert tuple(f"{r}:{t}" for r, t, _ in conv.spoken(want[1], iter([r[:2] for r in rows]))) == want[2]


def test_long_conversations_take_linear_time():
    path = conv.Path()
    for k in range(200_000):
        path.add(1 + 2 * (k * 7919 % 5 % 3) + k % 2)
    cost, audit = path.end()
    assert cost > 0 and len(audit) >= 200_000 and max(x.bit_length() for x in path.sums if x) < conv.Path.top + 64
