"""Rule tables: gram joins against every rule on every name, and against the built-in rules."""
import hashlib
import random
import re

from pyspark.sql import functions as F

from docatlas import dims, rules
from docatlas.functions import names as N
from docatlas.operators import candidates, rule_joins, symbols

WORDS = ["create", "file", "get", "dc", "nt", "open", "a", "w", "ex", "proc", "text", "x1", "_y"]


def built_names(rng):
    """Names that hold every keyword and every literal of the built-in rules, alone and inside others."""
    parts = [k for _, k, _ in dims.keyword_rules()] + [k for _, s, k, _ in dims.header_rules() if s != "regex"]
    out = {w for p in parts for w in (p, p.upper(), "Zz" + p, p + "Ex", "q" + p + "w")}
    return sorted(out | {"".join(rng.choice(WORDS) for _ in range(rng.randint(1, 5))).capitalize() for _ in range(1500)})


def test_built_in_rules_as_tables(spark):
    names = spark.createDataFrame([(n,) for n in built_names(random.Random(1))], "symbol string")
    keys = dims.frame(spark, dims.keyword_rules(), "ord int, key string, dll string")
    assert symbols.detect_dll(names, keys).exceptAll(symbols.detect_dll(names)).count() == 0
    assert names.count() == symbols.detect_dll(names, keys).count() > 5000
    lines = [line.split() for line in rules.HEADER_PATTERNS.split("\n")[1:-1]]
    table = spark.createDataFrame([(i, p, hs) for i, (p, *hs) in enumerate(lines)], "ord int, pattern string, headers array<string>")
    a, b = (x.select("symbol", "ord", "header_ord", "header").distinct() for x in (candidates.match_url_rules(names, table), candidates.match_url_rules(names)))
    assert a.exceptAll(b).count() == b.exceptAll(a).count() == 0 and a.select("ord").distinct().count() > 400


def test_rule_texts_are_pinned():
    """Any change of a fixed rule shows here."""
    assert len(dims.keyword_rules()) == 489 and len(rules.HEADER_PATTERNS.split("\n")) - 2 == 467
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()[:16]
    assert digest(rules.KEYWORDS) == KEYWORDS_DIGEST and digest(rules.HEADER_PATTERNS) == PATTERNS_DIGEST


KEYWORDS_DIGEST, PATTERNS_DIGEST = "c98e9eb5a8c0d60a", "f70f062d8725ebc9"


def random_pattern(rng, depth=0):
    def atom():
        kind = rng.random()
        if kind < 0.6 or depth > 2:
            return rng.choice(["a", "b", "c", "ab", "bc", "abc", "_"])
        if kind < 0.7:
            return rng.choice(["[ab]", "[^a]", "[a-c]", r"\w", r"\.", "."])
        inner = "|".join(random_pattern(rng, depth + 1) for _ in range(rng.randint(1, 2)))
        return f"({'?:' if rng.random() < 0.2 else ''}{inner})"

    out = "".join(atom() + rng.choice(["", "", "", "*", "+", "?", "{0,2}", "{2}", ".*"]) for _ in range(rng.randint(1, 4)))
    return ("^" if depth == 0 and rng.random() < 0.3 else "") + out + ("$" if depth == 0 and rng.random() < 0.3 else "")


def test_patterns_of_any_form(spark):
    rng = random.Random(2)
    patterns = list(dict.fromkeys(random_pattern(rng) for _ in range(400))) + ["", "^", ".*", "a|b", "(a", "(?i)AB", r"\Qa.b\E"]
    patterns = [p for p in patterns if p == r"\Qa.b\E" or not p.startswith("(a") or p.count("(") == p.count(")")]
    names = ["".join(rng.choice("abc_.") for _ in range(rng.randint(0, 7))) for _ in range(250)]
    lower = sorted(set(names))
    table = spark.createDataFrame([(i, p, ["h", "g"]) for i, p in enumerate(patterns)], "ord int, pattern string, headers array<string>")
    got = {(r.symbol, r.ord) for r in candidates.match_url_rules(spark.createDataFrame([(n,) for n in names], "symbol string"), table).collect()}
    quoted = [re.escape("a.b") if p.startswith(r"\Q") else p for p in patterns]
    assert got == {(n, i) for n in lower for i, p in enumerate(quoted) if re.match(f"(?:{p})" if "(?i)" not in p else p, n)}
    shapes = {r.pattern: (r.shape, r.literal) for r in rule_joins.shaped(table).collect()}
    assert all(re.search(re.escape(lit), n) for p, (_, lit) in shapes.items() for n in lower if not p.startswith(r"\Q") and re.match(p, n))
    assert sum(lit != "" for _, lit in shapes.values()) > 0.5 * len(shapes)


def test_keywords_with_odd_rows(spark):
    rows = [(0, "Get", "never: upper case"), (1, "get", "a"), (2, "file", "b"), (3, "get", "c"), (4, None, "n"), (5, "i", "short"), (6, "fi", "two"), (7, "e.", "dot"), (7, "q", "same ord")]
    table = spark.createDataFrame(rows, "ord int, key string, dll string")
    names = spark.createDataFrame([("GetFile", 1), ("GETX", 2), ("fi", 3), (None, 4), ("", 5), ("zz", 6), ("GetFile", 7), ("fe.", 8)], "symbol string, no int")
    got = {(r.symbol, r.no): r.dll for r in rule_joins.keyword_modules(names, table).collect()}
    assert got == {("GetFile", 1): "b", ("GETX", 2): "c", ("fi", 3): "two", (None, 4): None, ("", 5): None, ("zz", 6): None, ("GetFile", 7): "b", ("fe.", 8): "dot"}
    every = table.unionByName(spark.createDataFrame([(9, "", "any")], "ord int, key string, dll string"))
    assert {r.dll for r in rule_joins.keyword_modules(names.where("symbol = 'zz'"), every).collect()} == {"any"}
    assert rule_joins.keyword_modules(names, table.limit(0)).where("dll is not null").count() == 0


def test_many_rules_without_a_nested_loop(spark):
    """100,000 keywords and as many patterns: equi joins only, and few candidates a name."""
    n = 100_000
    word = F.concat(F.lit("k"), F.lower(F.hex(F.xxhash64("id"))))
    keys = spark.range(n).select(F.col("id").cast("int").alias("ord"), F.substring(word, 2, 9).alias("key"), F.col("id").cast("string").alias("dll"))
    names = spark.range(3000).select(F.concat(F.lit("Pre"), word, F.lit("Post")).alias("symbol"), "id")
    d = rule_joins.keyword_modules(names, keys)
    assert "NestedLoop" not in d._jdf.queryExecution().toString() and "Cartesian" not in d._jdf.queryExecution().toString()
    assert d.where(F.col("dll") == F.col("id").cast("string")).count() == 3000
    patterns = spark.range(n).select(F.col("id").cast("int").alias("ord"), F.concat(F.lit(".*"), F.substring(word, 2, 9), F.lit(".*t$")).alias("pattern"), F.array(F.lit("h")).alias("headers"))
    m = candidates.match_url_rules(names.select("symbol"), patterns)
    assert "NestedLoop" not in m._jdf.queryExecution().toString() and m.count() == 3000
