"""Candidate pages -> resolved page per symbol."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docatlas import dims
from docatlas.functions import names as N
from docatlas.operators import candidates as C
from docatlas.operators import evidence as E
from docatlas.operators import lookups as L
from docatlas.operators import symbols as S

STEPS = {"override": 0, "search": 1, "patterns": 2, "predicted": 3, "catalog": 4, "direct": 5, "suffix": 6}


def page_is_valid(mode: str = "fast", first_bytes: int | None = None) -> Column:
    """status 200 and a documentation word in the body, or in its ``first_bytes`` (the original's were 2048,
    and 1024 in the slow mode)."""
    words = "function|syntax|parameters|api" if mode == "fast" else "function|routine|api|syntax|parameters"
    head = F.col("body_head")
    if first_bytes is not None:
        head = F.make_valid_utf8(F.substring(head.cast("binary"), 1, first_bytes).cast("string"))
    ok = (F.col("status") == 200) & F.lower(head).rlike(words)
    return ok & F.lower("content_type").contains("html") if mode == "fast" else ok


def valid_pages(log: DataFrame, mode: str = "fast", first_bytes: int | None = None) -> DataFrame:
    return log.filter(page_is_valid(mode, first_bytes))


def page_keys(pages: DataFrame) -> DataFrame:
    """One row per url.  Copies of a page combine before the shuffle, html stays behind."""
    return pages.groupBy("url").agg(F.min("page_id").alias("page_id"))


def resolve_pages(cands: DataFrame, pages: DataFrame) -> DataFrame:
    """Candidates whose page exists, with its id."""
    return cands.join(page_keys(pages), "url")


def twin_url(url: Column) -> Column:
    """The en-us twin of a pt-br url, else null."""
    return F.when(url.contains("pt-br"), F.replace(
        url, F.lit("learn.microsoft.com/pt-br"), F.lit("learn.microsoft.com/en-us")))


def with_language_fallback(cands: DataFrame, pages: DataFrame, how: str = "inner") -> DataFrame:
    """Page of the url, else of its twin, as one join on up to two keys per
    candidate; ``twin`` tells which, ``crawled`` whether there is such a page.  The record's url becomes the page url."""
    keys = F.array_compact(F.array(
        F.struct(F.lit(0).alias("twin"), F.col("url").alias("page_url")),
        F.when(twin_url(F.col("url")).isNotNull(), F.struct(
            F.lit(1).alias("twin"), twin_url(F.col("url")).alias("page_url")))))
    keyed = cands.withColumn("k", F.explode(keys)).select("*", "k.twin", "k.page_url").drop("k")
    known = page_keys(pages).withColumnRenamed("url", "page_url").withColumn("crawled", F.lit(True))
    return keyed.join(known, "page_url", how)


def attempts(symbols: DataFrame) -> DataFrame:
    """(symbol, dll, level, attempt, last): the name, then the name without its
    trailing A/W letters one by one (J16); nothing from a denied name on (N2)."""
    s = F.col("symbol")
    k = F.least(F.length(F.regexp_extract("symbol", r"([AW]*)\z", 1)), F.length("symbol") - 1)
    names = F.transform(F.sequence(F.lit(0), k), lambda j: F.substring(s, F.lit(1), F.length(s) - j))
    denied = F.array_position(F.transform(names, lambda n: F.lower(n).isin(dims.UNDOCUMENTED)), True)
    kept = F.when(denied > 0, F.slice(names, F.lit(1), (denied - 1).cast("int"))).otherwise(names)
    out = symbols.select("symbol", "dll", F.posexplode(kept).alias("level", "attempt"))
    return out.withColumn("last", ~F.col("attempt").rlike(r"[AW]\z"))


# ------------------------------------------------------------------ one attempt table

#: Kinds of probes: search results, header map, catalog, function map.
SEARCH, MAP, CATALOG, DIRECT = "s", "k", "c", "d"


def probes(name: Column) -> Column:
    """All lookups of one attempt as array of (kind, i, key); i is the place in the order of its kind."""
    low, keys = F.lower(name), {}
    keys[SEARCH] = [name]
    keys[MAP] = [low, N.aw_base(name), N.ex_base(name)]
    keys[CATALOG] = L.catalog_probes(name)
    keys[DIRECT] = [name, F.concat(name, F.lit("W")), F.concat(name, F.lit("A"))]
    rows = [F.struct(F.lit(kind).alias("kind"), F.lit(i).alias("i"), k.alias("key")) for kind, ks in keys.items() for i, k in enumerate(ks)]
    return F.filter(F.array(*rows), lambda r: r["key"].isNotNull())


def answers(search_results: DataFrame, key_map: DataFrame, function_map: DataFrame, catalog: DataFrame, lang: str) -> DataFrame:
    """(kind, key, header, url, other): every table that a probe may ask, one row per key and kind."""
    none = F.lit(None).cast("string")

    def rows(df: DataFrame, kind: str, key: str, header: Column = none, url: Column = none, other: Column = none) -> DataFrame:
        return df.select(F.lit(kind).alias("kind"), F.col(key).alias("key"), header.alias("header"), url.alias("url"), other.alias("other"))

    named = L.catalog_names(catalog, "en-us" if lang == "us" else "pt-br")
    return (rows(L.pick_search_hit(search_results), SEARCH, "symbol", url=F.col("url"))
            .unionByName(rows(key_map, MAP, "key", header=F.col("header")))
            .unionByName(rows(named, CATALOG, "key", url=F.col("wanted.url"), other=F.col("any.url")))
            .unionByName(rows(function_map, DIRECT, "function", header=F.col("header"))))


def looked_up(tries: DataFrame, found: DataFrame) -> DataFrame:
    """``tries`` with hits: what its probes found, from one join.  A symbol has a dozen probes a level."""
    keys = tries.columns
    asked = tries.withColumn("p", F.explode(probes(F.col("attempt")))).select(*keys, "p.kind", "p.i", "p.key")
    hit = F.when(F.coalesce("header", "url", "other").isNotNull(), F.struct("kind", "i", "key", "header", "url", "other"))
    return asked.join(found, ["kind", "key"], "left").groupBy(*keys).agg(F.collect_list(hit).alias("hits"))


def of_kind(kind: str) -> Column:
    return F.filter("hits", lambda h: h["kind"] == kind)


def with_single_urls(d: DataFrame, base: str, lang: str) -> DataFrame:
    """single: (step, rank, url, needs_page) of every step that has one url of an attempt."""
    catalog = F.filter(F.transform(of_kind(CATALOG), lambda h: F.struct(
        h["i"].alias("i"), F.coalesce(h["url"], F.when(h["i"] == 0, h["other"])).alias("url"))), lambda h: h["url"].isNotNull())
    direct = F.array_min(F.transform(of_kind(DIRECT), lambda h: F.struct(h["i"].alias("i"), h["header"].alias("header"), h["key"].alias("key"))))
    scores = F.array(*[F.lit(x) for x in (dims.SCORE_EXACT, dims.SCORE_AW, dims.SCORE_EX)])
    mapped = F.transform(of_kind(MAP), lambda h: F.struct(h["i"].alias("ord"), h["header"].alias("header"), F.get(scores, h["i"]).alias("score")))
    d = d.withColumns({"mapped": mapped, "direct": direct, "special": override(F.col("attempt"))})
    d = d.withColumn("best", E.best_in_row(F.col("mapped"), "attempt", "dll"))
    predicted = N.localise_url(N.template_url("attempt", F.col("best.header")), lang)
    urls = {"search": F.get(of_kind(SEARCH), F.lit(0))["url"], "predicted": F.when(F.col("best.neg") < -0.3, predicted), "catalog": F.array_min(catalog)["url"],
            "direct": N.win32_url(F.lit(base), F.col("direct.header"), F.lower("direct.key")), "override": F.col("special.url")}
    rows = [F.struct(F.lit(STEPS[step]).alias("step"), F.lit(1).alias("rank"), url.alias("url"),
                     (F.coalesce("special.needs_page", F.lit(True)) if step == "override" else F.lit(True)).alias("needs_page")) for step, url in urls.items()]
    return d.withColumn("single", F.filter(F.array(*rows), lambda r: r["url"].isNotNull()))


def override(name: Column) -> Column:
    """(url, needs_page) of a special name, else null."""
    out = F.when(F.lit(False), F.struct(F.lit("").alias("url"), F.lit(True).alias("needs_page")))
    for key, _, url, _, needs in S.override_rows():
        out = out.when(F.lower(name) == key, F.struct(F.lit(url).alias("url"), F.lit(needs).alias("needs_page")))
    return out


def resolution_candidates(symbols: DataFrame, search_results: DataFrame, key_map: DataFrame, function_map: DataFrame, catalog: DataFrame,
                          lang: str = "us", first: int = dims.PROBE_FIRST, total: int | None = None, most: int | None = None) -> DataFrame:
    """All candidates of the waterfall: (symbol, level, step, rank, attempt, url, needs_page).

    Lookups of all steps are probes of one array and meet one union of tables in one join; the urls of all steps are
    then one array of the attempt.  Step 2 asks the url candidates of the attempt; names without A/W also those
    of name+A, then name+W (step 6)."""
    base = C.base_url(lang)
    tries = attempts(S.detect_dll(symbols.select("symbol").distinct()))
    d = with_single_urls(looked_up(tries, answers(search_results, key_map, function_map, catalog, lang)), base, lang)

    def ask(name: Column, step: str, offset: int) -> Column:
        return F.struct(name.alias("asked"), F.lit(STEPS[step]).alias("step"), F.lit(offset).alias("offset"))

    own = ask(F.col("attempt"), "patterns", 0)
    more = F.array(own, ask(F.concat("attempt", F.lit("A")), "suffix", 0), ask(F.concat("attempt", F.lit("W")), "suffix", 1000000))
    d = d.select("symbol", "dll", "level", "attempt", "single", F.explode(F.when(F.col("last"), more).otherwise(F.array(own))).alias("a"))
    d = d.select("symbol", "dll", "level", "attempt", "single", "a.*").withColumn("headers", N.header_candidates("asked", "dll", most))
    urls = F.filter(F.transform(N.candidate_urls("asked", F.col("headers"), F.lit(base)), lambda u, i: F.struct(
        F.col("step").alias("step"), (i + 1 + F.col("offset")).alias("rank"), u.alias("url"), F.lit(True).alias("needs_page"))),
        lambda r: C.within_budget(r["rank"] - F.col("offset"), F.col("asked"), F.col("dll"), first, total))
    every = F.when(F.col("step") == STEPS["patterns"], F.concat("single", urls)).otherwise(urls)
    return d.select("symbol", "level", "attempt", F.explode(every).alias("r")).select("symbol", "level", "attempt", "r.*")


def resolve(symbols: DataFrame, search_results: DataFrame, key_map: DataFrame, function_map: DataFrame, catalog: DataFrame,
            pages: DataFrame, lang: str = "us", first: int = dims.PROBE_FIRST, total: int | None = None, most: int | None = None) -> DataFrame:
    """exactly one row per symbol, found or not.

    One join of all lookups, one join with the url keys of the crawl, one ``min_by`` per symbol on (level, step, rank);
    a row that is worse than any hit stands for every symbol, so that none needs to be joined back.
    ``first``, ``total``, ``most``: limits of F9 and F4; nothing is left out by default."""
    cands = resolution_candidates(symbols, search_results, key_map, function_map, catalog, lang, first, total, most)
    # left, for the few urls that need no page; the filter runs in the join's own stage
    hit = with_language_fallback(cands, pages, "left").filter("crawled or (not needs_page and twin = 0)").withColumn("found", F.lit(True))
    hit = hit.withColumn("page_id", F.when(F.col("needs_page"), F.col("page_id"))).drop("url", "needs_page", "crawled")
    lost = symbols.select("symbol").distinct().select(
        "symbol", F.lit(None).cast("int").alias("level"), F.lit(None).cast("string").alias("attempt"), F.lit(None).cast("int").alias("step"),
        F.lit(None).cast("int").alias("rank"), F.lit(None).cast("int").alias("twin"), F.lit(None).cast("string").alias("page_url"),
        F.lit(None).cast("long").alias("page_id"), F.lit(False).alias("found"))
    best = hit.unionByName(lost).groupBy("symbol").agg(F.min_by(
        F.struct("found", "level", "step", "attempt", "page_url", "page_id"),
        F.struct((~F.col("found")).alias("lost"), "level", "step", "rank", "twin")).alias("b"))
    return best.select("symbol", "b.found", "b.level", "b.step", "b.attempt", F.col("b.page_url").alias("url"), "b.page_id")


def coverage(symbols: DataFrame, resolved: DataFrame) -> DataFrame:
    """Every row of ``symbols`` with documented, from one evaluation of ``resolved``."""
    return symbols.join(resolved.select("symbol", F.col("found").alias("documented")), "symbol")


def not_found(symbols: DataFrame, resolved: DataFrame) -> DataFrame:
    """Symbols minus resolved."""
    return symbols.select("symbol").distinct().join(resolved.filter("found"), "symbol", "left_anti")


def documented(symbols: DataFrame, resolved: DataFrame) -> DataFrame:
    """J15."""
    return symbols.join(resolved.filter("found").select("symbol"), "symbol", "left_semi")


#: The dimensions of the report, and what is summed up over which.
DIMENSIONS = ["kind", "step", "language", "header"]
GROUPINGS = [["kind", "step"], ["kind"], ["step"], ["language"], ["language", "header"], ["header"], []]


def coverage_report(resolved: DataFrame, groupings: list[list[str]] | None = None) -> DataFrame:
    """Found rate by kind, step, language and header, with the given groupings.

    Symbols are counted per cell of all dimensions first (partial aggregates); only cells are
    expanded to the groupings.  ``grouping`` has a bit for each dimension that is summed up, the first one highest."""
    r = resolved.select(
        N.symbol_kind("symbol").alias("kind"), F.coalesce("step", F.lit(-1)).alias("step"),
        F.when(F.col("found"), N.url_language("url")).otherwise("none").alias("language"),
        F.coalesce(F.nullif(F.regexp_extract("url", r"/(?:api|ddi)/([^/]+)/", 1), F.lit("")), F.lit("none")).alias("header"), "found")
    cells = r.groupBy(*DIMENSIONS).agg(F.count(F.lit(1)).alias("n"), F.count_if("found").alias("f"))
    sets = [[F.col(c) for c in g] for g in (GROUPINGS if groupings is None else groupings)]
    out = cells.groupingSets(sets, *DIMENSIONS).agg(F.grouping_id(*DIMENSIONS).cast("int").alias("grouping"), F.sum("n").alias("symbols"), F.sum("f").alias("found"))
    return out.select(F.coalesce("kind", F.lit("*")).alias("kind"), F.coalesce("step", F.lit(-9)).alias("step"), F.coalesce("language", F.lit("*")).alias("language"),
                      F.coalesce("header", F.lit("*")).alias("header"), "grouping", "symbols", "found", F.round(F.col("found") / F.col("symbols"), 6).alias("rate"))
