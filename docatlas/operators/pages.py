"""Facts of a documentation page, all from one pass over its blocks.

Plan shape: html --exchange(page)--> blocks --windows--> one aggregate per
page.  No joins: every section is a filtered, page-bounded collection in the same
aggregate, so asking for one fact prunes the others and asking for all of them
costs no further shuffle.

What every window and sort copies is the row, so block rows are kept few and narrow:
page columns stand on the first row of a page only, html only where a later step reads
it, section heads become flags as soon as they are known, and end tags without text go
once depths are known.
"""

from __future__ import annotations

from functools import partial, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import WindowSpec
from pyspark.sql import functions as F

from docatlas import dims
from docatlas.functions import names as N
from docatlas.functions import tables as V
from docatlas.functions import text as T
from docatlas.operators import blocks as B

SECTIONS = ["syntax", "parameters", "return", "remarks", "requirements", "members"]
MODULE = r"([A-Za-z0-9]+\.(?:dll|exe))"
M1, M2, M3 = "\u0001", "\u0002", "\u0003"


def last(cond: Column, value: Column | str) -> Column:
    return F.last(F.when(cond, N.col_of(value)), ignorenulls=True).over(B.page_order())


def first(cond: Column, value: Column | str) -> Column:
    """First match so far (null before it)."""
    return F.first(F.when(cond, N.col_of(value)), ignorenulls=True).over(B.page_order())


def earlier_rows() -> WindowSpec:
    return B.page_order().rowsBetween(W.unboundedPreceding, -1)


def with_context(b: DataFrame) -> DataFrame:
    """Section, heading and start markers of every block."""
    tag, hl = F.col("tag"), F.col("hlevel")
    where = F.struct("pos", "parent", "hlevel", "level")
    cols = {f"in_{s}": last(F.col("head_text").rlike(dims.HEADINGS[s]), where) for s in SECTIONS}
    cols |= {f"stop{k}": last(hl <= k, "pos") for k in (1, 2, 3, 4)}
    cols["h1"] = first(tag == "h1", F.struct("pos", "parent"))
    cols["focus"] = first((tag == "div") & F.col("css").rlike(r"(^|\s)has-inner-focus(\s|\z)"),
                          F.struct("pos", "depth"))
    caption = T.extract(F.when(tag == "table", F.col("raw")), r"(?is)<caption\b[^>]*>(.*?)</caption\s*>")
    cols["near"] = F.last(F.when(hl.isNotNull(), F.struct(
        F.lit(None).cast("string").alias("caption"), T.strip(F.col("text")).alias("title"), "pos", "parent"))
        .when((tag == "table") & caption.isNotNull(), F.struct(
            T.strip(B.text_of(caption)).alias("caption"), F.lit(None).cast("string").alias("title"), "pos", "parent")),
        ignorenulls=True).over(earlier_rows())
    cols["prev_p"] = last(tag == "p", "text")
    b = b.withColumns(cols)
    flags = {}
    for s in SECTIONS:
        under, head = under_heading(s), F.col(f"in_{s}")
        flags |= {f"kp_{s}": F.when(under, head["pos"]), f"sib_{s}": under & (F.col("parent") == head["parent"]),
                  f"deep_{s}": under & (F.col("level") >= head["level"]),
                  f"beside_{s}": F.coalesce((F.col("pos") > head["pos"]) & (F.col("parent") == head["parent"]), F.lit(False))}
    # texts from before are read at tables and lists only
    read = tag.isin(B.ATOMIC)
    flags |= {"near": F.when(F.col("near").isNotNull(), F.struct(
        F.when(read, F.col("near.caption")).alias("caption"), F.when(read, F.col("near.title")).alias("title"), "near.pos", "near.parent")),
        "prev_p": F.when(read, F.col("prev_p"))}
    return b.withColumns(flags).drop(*(f"in_{s}" for s in SECTIONS), *(f"stop{k}" for k in (1, 2, 3, 4)))


def under_heading(section: str) -> Column:
    """Block after a section heading and before its stop heading.  Parameters stop at a heading of the same or a
    higher level, members at h1-h3, the rest at h1-h4."""
    s = F.col(f"in_{section}")
    if section == "parameters":
        stop = F.when(s["hlevel"] == 2, F.col("stop2")).when(s["hlevel"] == 3, F.col("stop3")).otherwise(F.col("stop4"))
    else:
        stop = F.col("stop3" if section == "members" else "stop4")
    return F.coalesce((F.col("pos") > s["pos"]) & (F.coalesce(stop, F.lit(-1)) <= s["pos"]), F.lit(False))


def inside(section: str, deep: bool = False) -> Column:
    """Block below a section heading; siblings of the heading only, unless ``deep``."""
    return F.col(f"deep_{section}" if deep else f"sib_{section}")


def with_markers(b: DataFrame) -> DataFrame:
    """Second window pass: things that depend on the nearest heading."""
    tag, text, pos = F.col("tag"), T.strip(F.col("text")), F.col("pos")
    opened = (tag != "") & ~tag.startswith("/")
    b = b.withColumn("bare", text).withColumn("opened", opened)
    sib_h1 = F.coalesce((F.col("parent") == F.col("h1.parent")) & (pos > F.col("h1.pos")), F.lit(False))
    b = b.withColumn("sib_h1", sib_h1)
    head = F.col("sib_h1") & (F.col("hlevel") <= 3)
    note = T.any_word(F.lower("text"), dims.NOTE_HEADINGS)
    code = F.col("code_text")
    legal = ~(code.startswith("(") & code.endswith(")")) & ~code.rlike(r"[+\-*]")
    name = T.extract(code, r"(?U)(\w+)\z")
    param_name = (F.when((tag == "p") & F.col("has_code") & legal, name)
                  .when(tag == "dt", F.regexp_replace(F.col("bare"), r"^\[.*?\]\s*", "")))
    is_desc = F.when((tag == "p") & ~F.col("has_code"), (F.length("bare") > 15) & ~F.col("bare").rlike(r"^\[.*?\]")).when(
        tag == "dd", True).otherwise(False)
    in_par = inside("parameters")
    table_stop = ((tag == "p") & F.col("has_code") & code.rlike(r"(?s)\[.*?\].*?[A-Za-z]")) | (
        (F.col("hlevel") <= 3) & F.lower("text").rlike(dims.TABLE_STOP_HEADINGS))
    b = b.withColumns({
        "stopped": F.coalesce(F.max(head & ~note).over(B.page_order()), F.lit(False)),
        "noted": F.coalesce(F.max(head & note).over(B.page_order()), F.lit(False)),
        "top_tag": last(F.col("sib_h1") & F.col("opened"), "tag"),
        "left_focus": F.max((pos > F.col("focus.pos")) & (F.col("floor") < F.col("focus.depth"))).over(B.page_order()),
        "sib_count": F.sum(F.when(F.col("opened") & (F.col("parent") == F.col("near.parent")), 1).otherwise(0)
                           ).over(B.page_order()),
        "param_name": F.when(in_par, param_name),
        "is_desc": in_par & is_desc,
        "gid": F.sum(F.when(in_par & param_name.isNotNull(), 1).otherwise(0)).over(B.page_order()),
        "bid": F.sum(F.when(table_stop, 1).otherwise(0)).over(B.page_order()),
    })
    at_head = F.last(F.when(F.col("hlevel").isNotNull(), F.col("sib_count")), ignorenulls=True).over(B.page_order())
    # the first description paragraph of each parameter
    told = F.col("is_desc") & (F.col("tag") == "p")
    before = F.last(F.when(told, F.col("gid")), ignorenulls=True).over(earlier_rows())
    return b.withColumns({"sib_at_head": at_head, "first_desc": told & ~F.coalesce(before == F.col("gid"), F.lit(False))})


def first_call(text: Column) -> Column:
    """The word before the first ``(``, unless it is a control word."""
    word = T.extract(text, r"(?U)\b(\w+)\s*\(")
    return F.when(~F.upper(word).isin("IF", "FOR", "WHILE", "SWITCH"), word)


def spelled(x: Column) -> Column:
    return F.when(F.contains(x, F.lit("lang-")), F.replace(x, F.lit("lang-"), F.lit(""))).when(
        F.contains(x, F.lit("language-")), F.replace(x, F.lit("language-"), F.lit("")))


def first_class(css: Column, name) -> Column:
    """``name`` of the first class that has one; classes are asked in their order."""
    return F.get(F.filter(F.transform(F.split(F.trim(css), r"\s+"), name), lambda x: x.isNotNull()), F.lit(0))


def marked_language(css: Column) -> Column:
    return F.when(F.contains(css, F.lit("lang")), first_class(css, spelled))


def language_around(pos: Column) -> Column:
    """The mark of the nearest container that is still open at ``pos``, over all containers.

    A container that opened at depth d is open as long as no row after it, the one at ``pos`` included, has a lower floor."""
    def still_open(m: Column) -> Column:
        return (m["pos"] < pos) & ~F.exists("depths", lambda r: (r["pos"] > m["pos"]) & (r["pos"] <= pos) & (r["floor"] < m["depth"]))

    return F.when(F.size("marks") > 0, F.try_element_at(F.filter("marks", still_open), F.lit(-1))["mark"])


def language_of(css: Column, around: Column, head: Column, content: Column) -> Column:
    """Class, mark of the containers (nearest first), data attribute, then content."""
    own = first_class(css, lambda x: F.coalesce(spelled(x), F.when(x.isin(dims.LANGUAGE_CLASSES), x)))
    data = T.extract(head, r"(?i)\sdata-lang(?:uage)?\s*=\s*[\"']?([^\"'\s>]+)")
    guess = F.when(F.lit(False), "c")
    for lang, patterns in dims.LANGUAGE_PATTERNS:
        cond = F.lit(False)
        for p in patterns:
            cond = cond | content.rlike(p)
        guess = guess.when(cond, lang)
    return F.coalesce(own, around, data, guess.otherwise("c"))


def collect(cond: Column, *fields: Column | str) -> Column:
    """Page-bounded, position-ordered collection."""
    return F.array_sort(F.collect_list(F.when(cond, F.struct("pos", *fields))))


def page_level(pages: DataFrame, need: set[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """Exchange, visible html and the facts of the whole page text (P16, P2c),
    carried through the blocks as short columns."""
    p = B.by_page(pages.select("page_id", *(["url"] if "url" in need else []), *keep, "html"))
    p = p.withColumn("no_elements", ~F.col("html").rlike(r"<[a-zA-Z]"))
    p = p.withColumn("html", B.visible_html(F.col("html")))
    if not need & {"arch", "text_dll"}:
        return p
    p = p.withColumn("page_text", B.text_of(F.col("html")))
    low = F.lower("page_text")
    arch = F.array_compact(F.array(F.when(low.rlike("x64|64-bit"), "x64"), F.when(low.rlike("x86|32-bit|desktop"), "x86")))
    text_dll = F.coalesce(*[T.extract(F.col("page_text"), r) for r in (
        rf"(?i)Library:\s*{MODULE}", rf"(?i)DLL:\s*{MODULE}", r"(?i)([A-Za-z0-9]+\.dll)")])
    p = p.withColumns({"arch": arch, "text_dll": text_dll}).drop("page_text")
    return p.withColumn("arch", F.when(F.size("arch") == 0, F.array(F.lit("x86"), F.lit("x64"))).otherwise(F.col("arch")))


def narrow(b: DataFrame) -> DataFrame:
    """Html only where a later step reads it; what is asked of it everywhere becomes ``head_text`` and ``floor``.

    ``floor`` is the lowest depth between the row before and this row, so that a container that an end tag
    closed is seen at the next row too."""
    # a heading counts when its content is one single string
    single = F.col("inner").rlike(r"^(?:<[a-zA-Z][^>]*>)*+[^<]*+(?:</[^>]*>)*+\s*\z")
    return b.withColumns({
        "head_text": F.when(F.col("hlevel").between(2, 4) & single, F.lower("text")),
        "end": F.startswith("tag", F.lit("/")) & (F.col("inner") == ""),
        "of_page": F.when(F.col("pos") == 0, F.col("of_page")),
        "raw": F.when(F.col("tag").isin(B.ATOMIC), F.col("raw")),
        "head": F.when(F.col("tag").isin("div", "pre"), F.col("head")),
        "inner": F.when(F.contains("inner", F.lit("<")), F.col("inner"))})


def context_blocks(pages: DataFrame, need: set[str] = frozenset(), keep: tuple[str, ...] = ()) -> DataFrame:
    carry = ["page_id"] + (["url"] if "url" in need else []) + ["no_elements"] + (
        ["arch", "text_dll"] if need & {"arch", "text_dll"} else []) + list(keep)
    p = page_level(pages, need, keep).select("page", "page_id", "html", F.struct(*carry).alias("of_page"))
    b = B.with_depth(narrow(B.describe(B.raw_blocks(p, ["of_page"])))).drop("page_id")
    b = b.withColumn("floor", F.greatest(F.col("level"), F.lit(0)))
    # an end tag without text only parts the texts of a section
    sections = [n for n in ("return", "remarks") if f"{n.removesuffix('s')}_rows" in need]
    gone = F.col("end") & (F.col("pos") > 0)
    if not sections:
        b = b.where(~gone)
    b = with_context(B.with_parent(b, named=False))
    if sections:
        b = b.where(~gone | reduce(Column.__or__, [inside(n, deep=True) for n in sections]))
    return with_markers(b.drop("end", "head_text"))


def best(value: Column, cond: Column | None = None) -> Column:
    """Value at the first position where it is present (and the condition holds)."""
    here = value.isNotNull() if cond is None else cond & value.isNotNull()
    return F.min_by(value, F.when(here, F.col("pos")))


def section_rows(s: str) -> Column:
    return collect(inside(s, deep=True), F.col(f"kp_{s}").alias("kp"), inside(s).alias("sib"), "tag", "text")


def code_texts() -> Column:
    """Texts of the code in a block, in order: the whole of ``pre``, else each ``code`` element."""
    inner = F.regexp_extract_all("inner", F.lit(r"(?is)<code\b[^>]*>(.*?)(?:</code\s*>|\z)"), F.lit(1))
    return F.when(F.col("tag") == "pre", F.array("text")).when(
        F.col("has_code") & F.col("inner").contains("{"), F.transform(inner, B.text_of)).otherwise(F.expr("cast(array() as array<string>)"))


def in_focus() -> Column:
    return F.coalesce((F.col("pos") >= F.col("focus.pos")) & ~F.coalesce("left_focus", F.lit(False)), F.lit(False))


def req_dll() -> Column:
    """Library/DLL line of a Requirements section, or after a bold Requirements label."""
    label = r"(?is)<(?:b|strong)\b[^>]*>[^<]*(?:Requirements?|Requisitos?)[^<]*</(?:b|strong)\s*>[^<]*(<.*)"
    line = rf"(?i)(?:Library|DLL):\s*{MODULE}"
    return F.coalesce(F.when(inside("requirements", deep=True), T.extract(F.col("text"), line)),
                      T.extract(B.text_of(F.regexp_extract("inner", label, 1)), line))


def plain_part() -> Column:
    """Paragraphs before the first other heading, also inside div and section."""
    here = (F.col("pos") > F.col("h1.pos")) & ~F.col("stopped") & ~F.col("noted")
    skip = T.any_word(F.lower("bare"), dims.SKIP_PHRASES)
    nested = ~F.col("sib_h1") & F.col("top_tag").isin("div", "section")
    return here & (F.col("tag") == "p") & (F.length("bare") > 5) & ((F.col("sib_h1") & ~skip) | nested)


def note_part() -> Column:
    here = F.col("sib_h1") & F.col("noted") & ~F.col("stopped")
    code = (F.col("tag") == "pre") & F.col("bare").contains("typedef")
    return F.when(here & code, F.concat(F.lit("Sintaxe para Windows 64-bit:\\n"), "bare")).when(
        here & (F.col("tag") == "p") & (F.length("bare") > 10), F.col("bare"))


def table_title() -> Column:
    between = F.col("sib_count") - F.col("sib_at_head") - 1
    near = F.when((F.col("near.parent") == F.col("parent")) & (between <= 3), F.col("near.title"))
    return F.when(F.col("tag") == "table", V.title_of(
        F.col("near.caption"), near, F.col("prev_p"), V.first_constants(F.col("rows")))).when(
        F.col("tag").isin("ul", "ol"), "List Items")


# columns of the page, not of its blocks
OF_PAGE = {"arch", "text_dll", "url", "no_elements"}
# aggregate name -> column builder; only the ones a fact needs are built
AGGREGATES = {
    "h1_text": lambda: best(F.col("bare"), F.col("tag") == "h1"),
    "title_text": lambda: best(F.col("bare"), F.col("tag") == "title"),
    "code_call": lambda: best(F.when(F.col("tag") == "pre", first_call(F.col("text"))).when(
        F.col("has_code"), first_call(F.col("code_text")))),
    "req_dll": lambda: best(req_dll()),
    "table_dll": lambda: best(F.when((F.col("tag") == "table") & F.col("text").rlike("(?i)Library|DLL|Minimum"),
                                     T.extract(F.col("text"), rf"(?i){MODULE}"))),
    "focus_rows": lambda: collect(in_focus(), "text"),
    "focus_at": lambda: best(F.struct("css", "pos", "head"), F.col("pos") == F.col("focus.pos")),
    "marks": lambda: collect((F.col("delta") > 0) & F.col("mark").isNotNull(), "depth", "mark"),
    "depths": lambda: collect((F.col("delta") != 0) & F.col("any_mark"), "floor"),
    "syntax": lambda: best(F.struct("bare", "css", "pos", "head"), (F.col("tag") == "pre") & F.col("bare").contains("(")
                           & F.col("bare").contains(")") & inside("syntax", deep=True)),
    "param_kp": lambda: F.min(F.when(F.col("param_name").isNotNull(), F.col("kp_parameters"))),
    "param_rows": lambda: collect(F.col("param_name").isNotNull() | F.col("is_desc"), F.col("kp_parameters").alias("kp"),
                                  "gid", "bid", "param_name", "first_desc", "tag", F.col("bare").alias("text")),
    "value_tables": lambda: collect(F.col("entries").isNotNull() & F.col("beside_parameters"),
                                    "bid", "tag", table_title().alias("title"), "entries"),
    "return_rows": lambda: section_rows("return"),
    "return_tables": lambda: collect((F.col("tag") == "table") & F.col("entries").isNotNull() & inside("return"),
                                     F.col("kp_return").alias("kp"), "entries"),
    "remark_rows": lambda: section_rows("remarks"),
    "plain_parts": lambda: collect(plain_part(), F.col("sib_h1").alias("sib"), F.col("bare").alias("text")),
    "note_parts": lambda: collect(note_part().isNotNull(), note_part().alias("text")),
    "first_p": lambda: best(F.col("bare"), (F.col("tag") == "p") & (F.col("pos") > F.col("h1.pos"))),
    "member_items": lambda: collect(
        F.col("opened") & inside("members"), F.col("kp_members").alias("kp"), "tag", F.col("bare").alias("text"), "hlevel",
        F.when(F.col("tag") == "dl", V.definition_pairs(F.col("raw"))).when(
            F.col("tag") == "table", V.table_pairs(F.col("raw"))).alias("pairs")),
    "sibling_ps": lambda: collect((F.col("tag") == "p") & F.col("beside_members"), F.col("bare").alias("text")),
    "all_ps": lambda: collect((F.col("tag") == "p") & (F.length("bare") > 0), F.col("bare").alias("text")),
    "code_members": lambda: best(F.col("coded"), F.size("coded") > 0),
    "definition_code": lambda: best(F.get(F.filter("codes", lambda c: c.rlike("typedef|struct") & c.contains("{") & c.contains("}")), F.lit(0))),
}


def raw_facts(pages: DataFrame, need: set[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """The one aggregate per page, limited to the named collections."""
    b = context_blocks(pages, need, keep)
    if need & {"value_tables", "return_tables"}:
        b = b.withColumn("rows", F.when(F.col("tag") == "table", V.rows_of(F.col("raw"))))
        b = b.withColumn("entries", F.when(F.col("tag") == "table", V.value_entries(F.col("rows"))).when(
            F.col("tag").isin("ul", "ol"), V.list_entries(F.col("raw"))))
    if "marks" in need:
        b = b.withColumn("mark", F.when(F.col("delta") > 0, marked_language(F.col("css"))))
        b = b.withColumn("any_mark", F.max(F.col("mark").isNotNull()).over(B.page_order()))
    if need & {"code_members", "definition_code"}:
        b = b.withColumn("codes", code_texts())
    if "code_members" in need:
        found = F.filter(F.transform(F.filter("codes", lambda c: c.contains("typedef") & c.contains("{") & c.contains("}")), V.code_members), lambda m: F.size(m) > 0)
        b = b.withColumn("coded", F.get(found, F.lit(0)))
    facts = [AGGREGATES[n]().alias(n) for n in sorted(need - OF_PAGE)]
    d = b.groupBy("page").agg(F.first("of_page", ignorenulls=True).alias("of_page"), *facts).drop("page")
    return d.select("of_page.*", *[c for c in d.columns if c != "of_page"])


# --------------------------------------------------------------- per-page columns


def title_name(title: Column) -> Column:
    """P1 on one title.  ``Função X (h.h)`` has no noun and stays whole."""
    full = r"(?iU)^(?:Função\s+)?(\w+)\s+(?:function|rotina)\s+\(([^)]+\.h)\)"
    header = F.regexp_extract(title, full, 2)
    cut = F.regexp_replace(title, r"(?iU)\s+(?:function|api)[^\n]*\z", "")
    return F.when(header != "", F.concat(F.regexp_extract(title, full, 1), F.lit(" ("), header, F.lit(")"))).when(
        cut != "", cut)


def section_text(rows: Column, tags: list[str], shortest: int) -> Column:
    """Array of (kp, text) of the first heading that has content.

    Siblings are contiguous, so one ordered join with start marks and one split
    group nested text under its sibling in linear time."""
    flat = F.array_join(F.transform(rows, lambda r: F.when(r["sib"], F.concat(
        F.lit(M1), r["kp"].cast("string"), F.lit(M2), r["tag"], F.lit(M2), r["text"])).otherwise(r["text"])), "")
    parts = F.transform(F.split(flat, M1), lambda x: F.struct(
        F.substring_index(x, M2, 1).alias("kp"), F.get(F.split(x, M2), F.lit(1)).alias("tag"),
        T.strip(F.get(F.split(x, M2), F.lit(2))).alias("text")))
    return F.filter(parts, lambda p: p["tag"].isin(tags) & (F.length(p["text"]) > shortest))


def type_of_name(name: Column) -> Column:
    """P7 fallback: first listed type word inside the name (``hPoint`` -> INT)."""
    types = F.array(*[F.lit(t) for t in dims.PARAM_TYPES])
    up = F.upper(name)
    return F.coalesce(F.get(F.filter(types, lambda t: F.contains(up, t)), F.lit(0)), F.lit("UNKNOWN"))


def type_in_signature(signature: Column, name: Column) -> Column:
    """Type before the name in the signature, with a direction mark if any."""
    core = r"((?:const\s+)?(?:struct\s+)?(?:\w+\s+)*\w+)\s*\*?\s*"
    marked = F.concat(F.lit(r"(?iU)\[(?:in|out|in,\s*out|optional)\]\s+" + core), name, F.lit(r"\b"))
    plain = F.concat(F.lit("(?iU)" + core), name, F.lit(r"\b"))

    def found(pattern: Column) -> Column:
        kind = T.strip(F.call_function("regexp_extract", signature, pattern, F.lit(1)))
        return T.once(F.call_function("regexp_extract", signature, pattern, F.lit(0)), lambda whole: F.when(
            whole != "", F.concat(kind, F.when(F.contains(whole, F.lit("*")), "*").otherwise(""))))

    return F.coalesce(found(marked), found(plain), type_of_name(name))


def return_type_of(signature: Column) -> Column:
    word = F.upper(F.regexp_extract(signature, r"(?mU)^\s*(?:\w+\s+)*(\w+)\s+\w+\s*\(", 1))
    return F.when(word.isin(dims.KNOWN_RETURN_TYPES), word).otherwise("BOOL")


def parameters_of(d: DataFrame) -> DataFrame:
    """Array of parameters of the first heading that has one."""
    d = d.withColumn("param_rows", F.filter("param_rows", lambda r: r["kp"] == F.col("param_kp")))
    rows = F.col("param_rows")
    starts = F.filter(rows, lambda r: r["param_name"].isNotNull())
    # descriptions per parameter: one ordered join with marks, split again, no nested scan
    flat = F.array_join(F.transform(rows, lambda r: F.when(r["param_name"].isNotNull(), F.lit(M1)).otherwise(F.concat(
        F.lit(M2), F.when(r["tag"] == "dd", T.clean_text(r["text"])).otherwise(r["text"])))), "")
    def behind_first(parts: Column) -> Column:
        return F.slice(parts, F.lit(2), F.size(parts))

    texts = F.transform(behind_first(F.split(flat, M1)), lambda x: F.array_join(behind_first(F.split(x, M2)), " "))
    d = d.withColumn("params", F.arrays_zip(starts.alias("s"), texts.alias("t")))
    # where value tables of a parameter begin: its first description paragraph
    first_at = F.map_from_entries(F.transform(F.filter(rows, lambda r: r["first_desc"]), lambda r: F.struct(
        r["gid"].alias("key"), F.struct(r["pos"].alias("pos"), r["bid"].alias("bid")).alias("value"))))
    d = d.withColumn("desc_at", first_at)
    tables = F.filter("value_tables", lambda t: (t["tag"] != "table") | ~F.exists(
        t["entries"], lambda e: F.contains(F.upper(e["value"]), F.lit("ID"))))
    d = d.withColumn("kept_tables", tables)

    def values(name: Column, gid: Column) -> Column:
        a = F.try_element_at(F.col("desc_at"), gid)
        mine = F.filter("kept_tables", lambda t: (t["bid"] == a["bid"]) & (t["pos"] > a["pos"]))
        typed = F.transform(mine, lambda t: F.struct(
            F.when(t["tag"] == "table", "values").alias("type"), t["title"].alias("title"), t["entries"].alias("entries")))
        wanted = T.any_word(F.lower(name), dims.TABLE_PARAMETERS)
        return F.when(wanted & a.isNotNull() & (F.size(typed) > 0), typed)

    def one(z: Column) -> Column:
        name, by_name = z["s"]["param_name"], type_of_name(z["s"]["param_name"])
        kind = F.when((z["s"]["tag"] == "dt") | (F.col("signature") == ""), by_name).otherwise(
            type_in_signature(F.col("signature"), name))
        return F.struct(name.alias("name"), kind.alias("type"), F.coalesce(z["t"], F.lit("")).alias("description"),
                        values(name, z["s"]["gid"]).alias("values"))

    return d.withColumn("parameters", F.transform("params", one))


def with_description(d: DataFrame, paragraphs: int | None = None) -> DataFrame:
    """Plain paragraphs, then entered note sections, joined and cleaned; all of them, or the first
    ``paragraphs`` plain ones, and notes only if there are fewer.

    A nested paragraph equal to an earlier part is dropped, a sibling one is kept."""
    keys = F.array_distinct(F.transform("plain_parts", lambda p: F.concat(
        F.when(p["sib"], p["pos"].cast("string")).otherwise(""), F.lit(M1), p["text"])))
    if paragraphs is not None:
        # of twice as many parts, at least that many survive the second test
        keys = F.slice(keys, 1, 2 * paragraphs)
    d = d.withColumn("plain", F.transform(keys, lambda k: F.struct(
        (F.substring_index(k, M1, 1) != "").alias("sib"), F.substring_index(k, M1, -1).alias("text"))))
    # texts of the siblings, nested ones blank: the first place of a text tells whether it came before
    d = d.withColumn("sibling_texts", F.transform("plain", lambda p: F.when(p["sib"], p["text"]).otherwise("")))
    kept = F.filter("plain", lambda p, i: p["sib"] | ~F.array_position("sibling_texts", p["text"]).between(1, i))
    parts, notes = F.transform(kept, lambda p: p["text"]), F.transform("note_parts", lambda p: p["text"])
    if paragraphs is None:
        d = d.withColumn("parts", F.concat(parts, notes))
    else:
        d = d.withColumn("parts", F.slice(parts, 1, paragraphs))
        d = d.withColumn("parts", F.when(F.size("parts") >= paragraphs, F.col("parts")).otherwise(F.concat("parts", notes)))
    return d.withColumn("description", F.when(F.col("h1_text").isNull(), "").when(
        F.size("parts") > 0, T.clean_text(F.array_join("parts", " "))).otherwise(F.coalesce("first_p", F.lit(""))))


def looks_like_member(line: Column) -> Column:
    plain = F.regexp_replace(line, r"[_\[\]]", "")
    bracketed = F.contains(line, F.lit("[")) & F.contains(line, F.lit("]"))
    return (F.length(line) < 50) & (bracketed | (plain.rlike(r"(?U)^[\p{L}\p{N}]+\z") & (F.length(line) > 2)))


def members_of(d: DataFrame) -> DataFrame:
    """Members from the first section with items, else from the typedef block."""
    first = F.get("member_items", F.lit(0))["kp"]
    d = d.withColumn("member_items", F.filter("member_items", lambda it: it["kp"] == first))
    items = F.col("member_items")
    ps = F.transform("sibling_ps", lambda p: p["text"])
    # the paragraph after each sibling paragraph, looked up by position
    after = F.map_from_entries(F.transform("sibling_ps", lambda p, i: F.struct(p["pos"].alias("key"), i.alias("value"))))
    d = d.withColumn("p_texts", ps).withColumn("p_index", after)

    def one(name: Column, description: Column) -> Column:
        return F.struct(name.alias("name"), F.lit("Unknown").alias("type"), description.alias("description"))

    def paragraph(it: Column) -> Column:
        line = T.strip(F.substring_index(it["text"], "\n", 1))
        i = F.try_element_at(F.col("p_index"), it["pos"])
        nxt, nxt2 = F.get(F.col("p_texts"), i + 1), F.get(F.col("p_texts"), i + 2)
        more = ((F.length(nxt) > 400) & ~nxt.endswith(".") & (F.length(nxt2) > 50)
                & ~F.regexp_replace(nxt2, r"[_\[\]]", "").rlike(r"(?U)^[\p{L}\p{N}]+\z"))
        text = F.when(more, F.concat_ws(" ", nxt, nxt2)).otherwise(nxt)
        desc = F.when(F.length(nxt) > F.length(line) + 10, text).otherwise(dims.MEMBER_DEFAULT)
        return F.when(looks_like_member(line), F.array(one(line, F.coalesce(desc, F.lit(dims.MEMBER_DEFAULT)))))

    def of_item(it: Column) -> Column:
        pairs = F.transform(it["pairs"], lambda p: one(p["name"], p["description"]))
        return F.coalesce(F.when(it["tag"] == "p", paragraph(it)), pairs,
                          F.filter(F.array(one(it["text"], it["text"])), lambda x: F.lit(False)))

    section = F.flatten(F.transform(items, of_item))
    d = d.withColumn("section_members", section)

    def default(name: Column) -> Column:
        low = F.lower(name)
        out = F.when(F.lit(False), "")
        for kind, word, text in dims.MEMBER_TEXTS:
            out = out.when(F.contains(low, F.lit(word)) if kind == "part" else low == word, text)
        return out.otherwise(dims.MEMBER_DEFAULT)

    def mention(name: Column) -> Column:
        hits = F.filter("all_ps", lambda p: F.contains(p["text"], name) & (F.length(p["text"]) > F.length(name) + 10)
                        & ~(p["text"].startswith(F.concat(name, F.lit("["))) & p["text"].endswith("]")))
        return F.get(hits, F.lit(0))["text"]

    def in_section(name: Column) -> Column:
        def found(it: Column, i: Column) -> Column:
            rest = F.filter(items, lambda x: (x["tag"] == "p") & (x["pos"] > it["pos"]))
            head = F.when(it["hlevel"].between(3, 5) & F.contains(it["text"], name), F.get(rest, F.lit(0))["text"])
            pair = F.get(F.filter(it["pairs"], lambda p: F.contains(F.lower(p["name"]), F.lower(name))), F.lit(0))
            starts = it["text"].startswith(name) | F.contains(it["text"], F.concat(F.lit("`"), name, F.lit("`")))
            tail = T.strip(F.regexp_replace(it["text"], r"(?s)^[^:]*:", ""))
            para = F.when((it["tag"] == "p") & starts, F.when(
                F.contains(it["text"], F.lit(":")) & (tail != ""), tail).when(
                F.length(it["text"]) > F.length(name) + 10, it["text"]))
            return F.coalesce(head, F.when(it["tag"] == "dl", pair["description"]), para)

        return F.get(F.filter(F.transform(items, found), lambda x: x.isNotNull()), F.lit(0))

    coded = F.transform("code_members", lambda m: F.struct(
        m["name"].alias("name"), m["type"].alias("type"),
        F.coalesce(in_section(m["name"]), mention(m["name"]), default(m["name"])).alias("description")))
    return d.withColumn("members", F.when(F.size("section_members") > 0, F.col("section_members")).otherwise(
        F.coalesce(coded, F.slice(F.col("section_members"), 1, 1))))


def with_name(d: DataFrame) -> DataFrame:
    name = F.coalesce(title_name(F.coalesce("h1_text", "title_text")), F.col("code_call"))
    return d.withColumn("name", F.coalesce(name, F.when(F.col("no_elements"), N.name_from_url("url")),
                                           F.lit(dims.UNKNOWN_NAME)))


def with_signature(d: DataFrame) -> DataFrame:
    """The focus block if it looks like a call, else the syntax section."""
    d = d.withColumn("focus_text", T.strip(F.array_join(F.transform("focus_rows", lambda x: x["text"]), "")))
    use = F.col("focus_text").contains("(") & F.col("focus_text").contains(")")
    d = d.withColumn("source", F.when(use, F.struct(
        F.col("focus_text").alias("bare"), "focus_at.css", "focus_at.pos", "focus_at.head")).otherwise(F.col("syntax")))
    d = T.with_signature(d, F.col("source.bare"), "signature")
    language = language_of(F.col("source.css"), language_around(F.col("source.pos")), F.col("source.head"), F.col("source.bare"))
    return d.withColumn("signature", F.coalesce("signature", F.lit(""))).withColumn(
        "signature_language", F.when(F.col("source").isNull(), "c").otherwise(language))


def with_remarks(d: DataFrame) -> DataFrame:
    d = d.withColumn("remark_parts", section_text(F.col("remark_rows"), ["p", "ul", "ol", "div"], 10))
    kp = F.get("remark_parts", F.lit(0))["kp"]
    return d.withColumn("remarks", F.array_join(F.transform(F.filter(
        "remark_parts", lambda p: p["kp"] == kp), lambda p: p["text"]), "\n\n"))


def with_return(d: DataFrame) -> DataFrame:
    """The first return heading with texts or value tables.  Values are also
    kept as rows (``return_values``); no terminal markup is stored."""
    d = d.withColumn("return_parts", section_text(F.col("return_rows"), ["p", "ul", "ol", "div"], 10))
    d = d.withColumn("return_kp", F.array_min(F.array_compact(F.array(
        F.get("return_parts", F.lit(0))["kp"].cast("int"), F.get("return_tables", F.lit(0))["kp"]))))
    d = d.withColumn("return_values", F.flatten(F.transform(F.filter(
        "return_tables", lambda t: t["kp"] == F.col("return_kp")), lambda t: t["entries"])))
    bullets = F.transform(F.filter("return_parts", lambda p: p["kp"].cast("int") == F.col("return_kp")),
                          lambda p: F.concat(F.lit("- "), p["text"]))
    lines = F.transform("return_values", lambda e: F.concat(F.lit("  - "), e["value"], F.lit(": "), e["meaning"]))
    extra = F.when(F.size("return_values") > 0, F.concat(
        F.array(F.lit("\n- Valores de retorno possíveis:")), lines)).otherwise(F.expr("cast(array() as array<string>)"))
    return d.withColumn("return_description", F.array_join(F.concat(bullets, extra), "\n"))


# fact -> (collections it needs, step that adds it)
NAME = {"h1_text", "title_text", "code_call", "url", "no_elements"}
SIGNATURE = {"focus_rows", "focus_at", "syntax", "marks", "depths"}
FACTS = {
    "url": ({"url"}, None),
    "name": (NAME, with_name),
    "dll": ({"req_dll", "table_dll", "text_dll"}, lambda d: d.withColumn(
        "dll", F.coalesce("req_dll", "table_dll", "text_dll", F.lit(dims.DEFAULT_MODULE)))),
    "architectures": ({"arch"}, lambda d: d.withColumn("architectures", F.col("arch"))),
    "signature": (SIGNATURE, with_signature),
    "signature_language": (SIGNATURE, with_signature),
    "return_type": (SIGNATURE, lambda d: d.withColumn("return_type", return_type_of(F.col("signature")))),
    "parameters": (SIGNATURE | {"param_kp", "param_rows", "value_tables"}, parameters_of),
    "return_description": ({"return_rows", "return_tables"}, with_return),
    "return_values": ({"return_rows", "return_tables"}, with_return),
    "remarks": ({"remark_rows"}, with_remarks),
    "description": ({"h1_text", "plain_parts", "note_parts", "first_p"}, with_description),
    "members": ({"member_items", "sibling_ps", "all_ps", "code_members"}, members_of),
    "definition": ({"definition_code"}, lambda d: d.withColumn("definition", T.clean_definition(F.col("definition_code")))),
}


def page_facts(pages: DataFrame, *facts: str, paragraphs: int | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per page with the named facts (all when none is named).  ``paragraphs``: at most so
    many in a description (the original's limit was 10); all without it.  ``keep``: further columns of
    ``pages`` that go along."""
    facts = facts or tuple(FACTS)
    need = set().union(*(FACTS[f][0] for f in facts))
    d = raw_facts(pages, need, keep)
    steps = []
    if need & SIGNATURE:
        steps.append(with_signature)
    for f in facts:
        step = partial(with_description, paragraphs=paragraphs) if f == "description" else FACTS[f][1]
        if step is not None and step not in steps:
            steps.append(step)
    for step in steps:
        d = step(d)
    return d.select("page_id", *keep, *facts)
