"""Rows that are easily lost: null keys and times, late rows, second sections."""
from pyspark.sql import functions as F

from docatlas.operators import calls as K
from docatlas.operators import logs as G
from docatlas.operators import pages as P
from docatlas.operators import records as R


def log(spark, rows):
    d = spark.createDataFrame(rows, "event_id long, agent string, sec double, status int")
    return d.withColumn("ts", F.timestamp_seconds("sec"))


def test_null_keys_and_times_are_kept(spark):
    d = log(spark, [(1, None, 1.0, 500), (2, None, 2.0, 500), (3, "a", None, 200), (4, "a", 5.0, 500)])
    got = {r.agent: (r.longest, r.rotations) for r in G.failure_runs(d).collect()}
    assert got == {None: (2, 0), "a": (1, 0)}
    assert G.retry_schedule(d, "agent").count() == 1


def test_late_rows_do_not_win(spark):
    def part(rows):
        d = spark.createDataFrame(rows, "event_id long, url string, sec double, status int, body string")
        return G.latest_snapshot(d.withColumn("ts", F.timestamp_seconds("sec")))
    first = part([(1, "u", 10.0, 200, "new")])
    late = part([(2, "u", 5.0, 200, "old"), (3, "u", 12.0, 304, None)])
    r = G.merge_snapshots(first, late).first()
    assert (r.body, r.last_status, r.fetches) == ("new", 304, 3)


def test_only_the_first_members_section(spark):
    def section(name):
        return f"<h2>Members</h2><p>{name}</p><p>The member named {name} is described here at length.</p>"
    html = "<h1>T structure</h1>" + section("first") + "<h2>Other</h2>" + section("second")
    pages = spark.createDataFrame([(1, "u", html)], "page_id long, url string, html string")
    assert [r.name for r in R.members_table(P.page_facts(pages, "members")).collect()] == ["first"]


def test_no_cap_on_members_or_heading_depth(spark):
    items = "".join(f"<dt>m{i}</dt><dd>Description of member {i}.</dd>" for i in range(60))
    deep = "<b>" * 9 + "Remarks" + "</b>" * 9
    html = f"<h1>T structure</h1><h2>Members</h2><dl>{items}</dl><h2>{deep}</h2><p>Remark about the usage of this structure in calls.</p>"
    pages = spark.createDataFrame([(1, "u", html)], "page_id long, url string, html string")
    d = P.page_facts(pages, "members", "remarks")
    assert R.members_table(d).count() == 60
    assert d.first().remarks == "Remark about the usage of this structure in calls."


def test_option_values(spark):
    d = spark.createDataFrame([("--ret --ret bool --wide a  b",), ("x --ret",), ("--ret bool --ret i32",), ("--wide--ret y",)], "args string")
    got = [(r.arguments, r.return_type, r.wide, r.option_error) for r in K.parse_options(d).collect()]
    assert got == [(["bool", "a", "b"], "--ret", True, "unknown return type"), (["x"], "u32", False, "missing return type"),
                   ([], "i32", False, None), (["--wide--ret", "y"], "u32", False, None)]


def test_class_order(spark):
    d = spark.createDataFrame([("cpp lang-x", ""), ("highlight-lang-y", ""), ("other", "a language-z"), ("other", "")], "css string, up string")
    got = [r[0] for r in d.select(P.language_of(F.col("css"), P.marked_language(F.col("up")), F.lit("<pre>"), F.lit("?"))).collect()]
    assert got == ["cpp", "highlight-y", "z", "c"]
