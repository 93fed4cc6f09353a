"""Work that is done once: per distinct name, per table, per token, per text."""

from pyspark.sql import functions as F

from docatlas.functions import names as N
from docatlas.functions import tables as V
from docatlas.functions import text as T
from docatlas.operators import calls as K
from docatlas.operators import evidence as E
from docatlas.operators import symbols as S
from tests.test_plans import SF, plan


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def below(text, word):
    """Lines of a plan after the first one that starts with ``word``."""
    lines = text.split("\n")
    at = next(i for i, x in enumerate(lines) if x.lstrip(" :+-").startswith(word))
    return "\n".join(lines[at + 1:])


def calls_of(column, word):
    """How often the expression of ``column`` over (x, rows) names ``word``."""
    from pyspark.sql import SparkSession

    spark = SparkSession.active()
    d = spark.createDataFrame([("a", [["b"]])], "x string, rows array<array<string>>").select(column.alias("c"))
    return d._jdf.queryExecution().analyzed().toString().count(word)


def test_keywords_are_asked_for_distinct_names_only(spark):
    from docatlas.plans import q_symbols as Q

    for q in (Q.j1, Q.j2):
        p = below(optimized(q(spark, SF)), "Aggregate")
        assert "advapi32.dll" not in p and "isnotnull(get(" not in p
    d = spark.createDataFrame([("CreateFile",), ("CreateFile",), ("Zzz",), (None,)], "symbol string").distinct()
    got = S.with_value(d, "dll", N.keyword_module("symbol")).collect()
    assert len(got) == 3 and {r.symbol for r in got if r.dll is None} >= {None}


def test_map_is_reduced_before_its_spellings(spark):
    d = spark.createDataFrame([(1, "h1", "Abc"), (3, "h1", "Abc"), (2, "h2", "Abc"), (None, "h3", "Q"), (5, None, None)], "ord int, header string, function string")
    m = spark.createDataFrame([("Q", "h9"), ("Q", "h9")], "function string, header string")
    p = optimized(E.expand_map(d, m))
    assert "Aggregate" in below(p, "Generate").split("LocalRelation")[0]
    got = {r.key: r.header for r in E.expand_map(d, m).collect()}
    assert got["Abc"] == "h1" and got["abcex"] == "h1" and got["Q"] == "h9" and got["q"] == "h3"


def test_tables_are_read_once(spark):
    # every look at a cell is one replace of its tags: the nested form had hundreds
    assert calls_of(V.value_entries(F.col("rows")), "<[^>]*>") < 12
    assert calls_of(V.list_entries(F.col("x")), "<li") <= 2
    assert calls_of(K.magnitude(F.col("x")), "^[+-]|_") == 1


def test_value_entries_of_odd_tables(spark):
    def table(*rows):
        return "<table>" + "".join("<tr>" + "".join(f"<td>{c}</td>" for c in r) + "</tr>" for r in rows) + "</table>"

    head = ("Value", "Meaning")
    cases = [(None, None), (table(), None), (table(head), None), (table(head, ("", "x")), None), (table(head, ("<b>A_B</b> 12", "m")), [("A_B (12)", "m")]),
             (table(("Meaning", "x", "Value"), ("one", "y", "text\nX_1 0x2fL"), ("short",)), [("X_1 (0x2fL)", "one")]), (table(("a", "b"), ("c", "d")), None)]
    d = spark.createDataFrame([(i, h) for i, (h, _) in enumerate(cases)], "i int, h string").select("i", V.value_entries(V.rows_of(F.col("h"))).alias("e"))
    for r in d.collect():
        assert (r.e and [tuple(x) for x in r.e]) == cases[r.i][1], r.i


def test_strip_takes_every_unicode_space(spark):
    white = [chr(c) for c in range(0x10000) if not 0xd800 <= c < 0xe000]
    d = spark.createDataFrame([(c, f"{c}{c}a{c}b{c}") for c in white], "c string, s string")
    old = F.regexp_replace("s", r"(?U)^\s+|\s+\z", "")
    assert d.where(~T.strip(F.col("s")).eqNullSafe(old)).count() == 0
