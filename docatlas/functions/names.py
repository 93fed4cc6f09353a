"""Symbol and url expressions: column in, column out, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docatlas import dims


def col_of(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def valid_symbol(c: Column | str) -> Column:
    """Letters, digits, underscore and hyphen only, not empty."""
    return F.coalesce(col_of(c).rlike(r"^[A-Za-z0-9_\-]+\z"), F.lit(False))


def is_upper(c: Column) -> Column:
    return (c == F.upper(c)) & c.rlike(r"\p{Lu}")


def symbol_kind(c: Column | str) -> Column:
    """N1.  The first matching branch wins, so ``CreateProcessW`` is a callback
    (it contains ``proc``): kept as is."""
    s = col_of(c)
    low = F.lower(s)
    return (
        F.when(s.rlike("^(Nt|Zw|Rtl|Ldr)"), "native_function")
        .when((is_upper(s) & F.contains(s, F.lit("_"))) | low.isin("peb", "teb", "token_control"),
              "structure")
        .when(low.rlike("proc|callback|hook"), "callback")
        .when(s.rlike(r"^I\p{Lu}"), "com_interface")
        .when(s.rlike(r"^\p{Lu}") & ~F.substring(s, 1, 3).rlike(r"\p{Ll}")
              & ~F.contains(s, F.lit("_")), "enum")
        .otherwise("win32_function")
    )


def is_important(c: Column | str) -> Column:
    """N6."""
    return F.lower(col_of(c)).rlike("^(create|get|set|open|close|read|write|nt|zw)")


def aw_base(c: Column | str) -> Column:
    """Name without one trailing a/w, else null.  Tested on lower case, so
    every name ending in that letter counts as suffixed (``GetData``)."""
    low = F.lower(col_of(c))
    return F.when(low.rlike(r"[aw]\z"), F.substring(low, F.lit(1), F.length(low) - 1))


def ex_base(c: Column | str) -> Column:
    low = F.lower(col_of(c))
    return F.when(low.rlike(r"ex\z"), F.substring(low, F.lit(1), F.length(low) - 2))


def native_twin(c: Column | str) -> Column:
    """Nt <-> Zw, else null."""
    low = F.lower(col_of(c))
    tail = F.substring(low, F.lit(3), F.length(low))
    return F.when(low.startswith("nt"), F.concat(F.lit("zw"), tail)).when(
        low.startswith("zw"), F.concat(F.lit("nt"), tail))


def name_variants(c: Column | str) -> Column:
    """Array of (tag, key) probe-side variants, nulls dropped."""
    low = F.lower(col_of(c))
    pairs = [("exact", low), ("aw_base", aw_base(c)), ("ex_base", ex_base(c)),
             ("plus_a", F.concat(low, F.lit("a"))), ("plus_w", F.concat(low, F.lit("w"))),
             ("native_twin", native_twin(c))]
    rows = F.array(*[F.struct(F.lit(t).alias("tag"), k.alias("key")) for t, k in pairs])
    return F.filter(rows, lambda r: r["key"].isNotNull())


def page_surface(url: Column | str) -> Column:
    """N7."""
    u = col_of(url)
    return F.when(F.contains(u, F.lit("/win32/")), "win32").when(
        F.contains(u, F.lit("/drivers/")), "driver").otherwise("unknown")


def url_pattern(url: Column | str) -> Column:
    return F.when(F.contains(col_of(url), F.lit("/nf-")), "nf-").otherwise("")


def name_from_url(url: Column | str) -> Column:
    """N8."""
    name = F.regexp_extract(col_of(url), r"/nf-[^/]+-([^/]+?)/?\z", 1)
    return F.when(name == "", dims.UNKNOWN_NAME).otherwise(
        F.concat(F.upper(F.substring(name, 1, 1)), F.substring(name, F.lit(2), F.length(name))))


def localise_url(url: Column | str, lang: str) -> Column:
    """Only ``br`` changes the url."""
    u = col_of(url)
    return F.replace(u, F.lit("/en-us/"), F.lit("/pt-br/")) if lang == "br" else u


def url_language(url: Column | str) -> Column:
    """En-us when the url contains it, else pt-br."""
    return F.when(F.contains(col_of(url), F.lit("en-us")), "en-us").otherwise("pt-br")


def short_url(url: Column | str) -> Column:
    """N10."""
    u = col_of(url)
    at = F.instr(u, "/api/")
    return F.when(at > 0, F.substring(u, at + 1, F.length(u))).otherwise(
        F.replace(u, F.lit(dims.SITE + "/"), F.lit("")))


def url_key(url: Column | str) -> Column:
    """S5."""
    return F.sha2(col_of(url), 256)


# --------------------------------------------------------------- module

def keyword_module(c: Column | str) -> Column:
    """J1 as a projection: the keyword table is a constant array ordered by
    (longest, first), so the first hit is the answer.  No join, no shuffle."""
    low = F.lower(col_of(c))
    rows = [{"k": k, "d": d} for _, k, d in
            sorted(dims.keyword_rules(), key=lambda r: (-len(r[1]), r[0]))]
    table = F.expr(dims.as_literal(rows, "array<struct<k:string,d:string>>"))
    return F.get(F.filter(table, lambda r: F.contains(low, r["k"])), F.lit(0))["d"]


def family_module(c: Column | str) -> Column:
    """J2, the rules a name can reach once no keyword matched."""
    low = F.lower(col_of(c))

    def has(word: str) -> Column:
        return F.contains(low, F.lit(word))

    create = (F.when(low.rlike("processasuser|processwithlogon|processwithtoken"), "advapi32.dll")
              .when(has("process") | has("file"), "kernel32.dll")
              .when(has("window"), "user32.dll").when(has("service"), "advapi32.dll"))
    open_ = (F.when(has("process") | has("thread"), "kernel32.dll")
             .when(has("key") | has("service"), "advapi32.dll"))
    get_set = (F.when(has("window"), "user32.dll").when(has("file"), "kernel32.dll")
               .when(has("process"), F.when(has("psapi"), "psapi.dll").otherwise("kernel32.dll")))
    enum = (F.when(has("process"), "psapi.dll").when(has("window"), "user32.dll")
            .when(has("service"), "advapi32.dll"))
    return (F.when(low.rlike("^(nt|zw|rtl|ldr)"), "ntdll.dll").when(low.startswith("create"), create)
            .when(low.startswith("open"), open_).when(low.rlike("^(get|set)"), get_set)
            .when(low.startswith("enum"), enum))


def module_of(c: Column | str) -> Column:
    """J1, then J2."""
    return F.coalesce(keyword_module(c), family_module(c))


# --------------------------------------------------- headers and urls

def rule_headers(c: Column | str) -> Column:
    """Matching header rules in order, as array of (ord, headers).

    Prefix and contains rules are string tests over one constant array, exact
    rules one lookup in a constant map, and only the few true patterns run a
    regular expression, each with a constant (compiled once) pattern."""
    low = F.lower(col_of(c))
    rules = dims.header_rules()

    def table(shape: str) -> Column:
        rows = [{"o": o, "k": k, "h": h} for o, s, k, h in rules if s == shape]
        return F.expr(dims.as_literal(rows, "array<struct<o:int,k:string,h:array<string>>>"))

    whole: dict[str, list] = {}
    for o, s, k, h in rules:
        if s == "exact":
            whole.setdefault(k, []).append({"o": o, "k": k, "h": h})
    exact = F.expr(dims.as_literal(whole, "map<string,array<struct<o:int,k:string,h:array<string>>>>"))
    hits = [
        F.filter(table("prefix"), lambda r: F.startswith(low, r["k"])),
        F.filter(table("contains"), lambda r: F.contains(low, r["k"])),
        F.try_element_at(exact, low),
    ]
    for o, _, k, h in (r for r in rules if r[1] == "regex"):
        row = F.expr(dims.as_literal([{"o": o, "k": k, "h": h}],
                                     "array<struct<o:int,k:string,h:array<string>>>"))
        hits.append(F.when(low.rlike(f"^(?:{k})"), row))
    nothing = F.expr("cast(array() as array<struct<o:int,k:string,h:array<string>>>)")
    found = F.concat(*[F.coalesce(x, nothing) for x in hits])
    return F.transform(F.array_sort(found), lambda r: F.struct(r["o"].alias("ord"), r["h"].alias("headers")))


def primary_header(dll: Column | str) -> Column:
    d = F.lower(col_of(dll))
    out = None
    for name, header in dims.PRIMARY_HEADER.items():
        out = (F if out is None else out).when(d == name, header)
    return out


def module_header_list(dll: Column | str) -> Column:
    """Ordered header list of a module, empty when unknown."""
    table = {d: t.split() for d, t in dims.MODULE_HEADERS.items()}
    lookup = F.expr(dims.as_literal(table, "map<string,array<string>>"))
    return F.coalesce(F.try_element_at(lookup, F.lower(col_of(dll))), F.expr("array()"))


def header_candidates(c: Column | str, dll: Column | str, most: int | None = None) -> Column:
    """primary -> pattern -> module -> common, first occurrences; all of them, or the first ``most``."""
    primary = primary_header(dll)
    tiers = F.concat(
        F.when(primary.isNotNull(), F.array(primary)).otherwise(F.expr("array()")),
        F.flatten(F.transform(rule_headers(c), lambda r: r["headers"])),
        module_header_list(dll),
        F.expr("array('" + "','".join(dims.COMMON_HEADERS) + "')"),
    )
    every = F.array_distinct(tiers)
    return every if most is None else F.slice(every, 1, most)


def win32_url(base: Column, header: Column, name: Column) -> Column:
    return F.concat(base, F.lit("/windows/win32/api/"), header, F.lit("/nf-"), header, F.lit("-"), name)


def driver_url(base: Column, header: Column, name: Column) -> Column:
    return F.concat(base, F.lit("/windows-hardware/drivers/ddi/"), header, F.lit("/nf-"), header,
                    F.lit("-"), name)


def header_urls(c: Column | str, headers: Column, base: Column) -> Column:
    """per header the plain url, then +a/+w or the stripped base."""
    low = F.lower(col_of(c))
    spellings = F.when(low.rlike(r"[aw]\z"), F.array(low, aw_base(c))).otherwise(
        F.array(low, F.concat(low, F.lit("a")), F.concat(low, F.lit("w"))))
    return F.flatten(F.transform(headers, lambda h: F.transform(spellings, lambda n: win32_url(base, h, n))))


def legacy_urls(c: Column | str, base: Column) -> Column:
    """fixed urls that go in front."""
    low = F.lower(col_of(c))
    return (F.when(low == "urldownloadtofile", F.array(F.lit(dims.LEGACY_DOWNLOAD_URL)))
            .when(low == "ftpputfile",
                  F.array(F.concat(base, F.lit("/windows/win32/api/wininet/nf-wininet-ftpputfilea"))))
            .otherwise(F.expr("array()")))


def native_urls(c: Column | str, base: Column) -> tuple[Column, Column]:
    """(front, back) url lists of nt/zw/rtl/ke/mm names.

    The front order is Nt spelling before Zw spelling and ntdef ... wdm within
    each: repeated insertion at the front reverses the written order."""
    low = F.lower(col_of(c))
    tail = F.substring(low, F.lit(3), F.length(low))
    nt, zw = F.concat(F.lit("nt"), tail), F.concat(F.lit("zw"), tail)
    front_names = F.when(low.rlike("^(nt|zw)"), F.array(nt, zw)).otherwise(F.array(low))
    back_names = F.when(low.rlike("^(nt|zw)"), F.array(zw, nt)).otherwise(F.array(low))
    headers = F.expr("array('" + "','".join(reversed(dims.DRIVER_HEADERS)) + "')")
    native = low.rlike("^(nt|zw|rtl|ke|mm)")
    front = F.flatten(F.transform(front_names, lambda n: F.transform(headers, lambda h: driver_url(base, h, n))))
    back = F.transform(back_names, lambda n: win32_url(base, F.lit("winternl"), n))
    empty = F.expr("array()")
    return F.when(native, front).otherwise(empty), F.when(native, back).otherwise(empty)


def candidate_urls(c: Column | str, headers: Column, base: Column) -> Column:
    """The whole ordered url list of a symbol, first occurrences kept."""
    front, back = native_urls(c, base)
    return F.array_distinct(F.concat(front, legacy_urls(c, base), header_urls(c, headers, base), back))


def template_url(c: Column | str, header: Column | str, is_struct: Column | None = None) -> Column:
    """F12."""
    h, low = col_of(header), F.lower(col_of(c))
    kind = F.when(is_struct, "struct") if is_struct is not None else F.when(F.lit(False), "struct")
    for name, k in dims.TEMPLATE_OF_HEADER.items():
        kind = kind.when(h == name, k)
    table = F.expr(dims.as_literal(dims.URL_TEMPLATES, "map<string,string>"))
    return F.replace(F.replace(F.try_element_at(table, kind.otherwise("standard")), F.lit("{header}"), h),
                     F.lit("{function}"), low)


# --------------------------------------------------------------- evidence

def fallback_evidence(c: Column | str) -> Column:
    """Array of (ord, header, score) of the first matching branch."""
    s = col_of(c)
    low = F.lower(s)

    def rows(*pairs: tuple[str, float]) -> Column:
        return F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(h).alias("header"),
                                  F.lit(v).alias("score")) for i, (h, v) in enumerate(pairs)])

    out = F.when(s.rlike("^(Nt|Zw)"), rows(("winternl", 0.80), ("ntddk", 0.70))).when(
        s.rlike("^(Rtl|Ldr)"), rows(("winternl", 0.75)))
    for words, header, score in dims.FALLBACK_EVIDENCE:
        out = out.when(low.rlike("|".join(words.split())), rows((header, score)))
    return out.otherwise(rows(("winbase", 0.40)))


def bonus_header(dll: Column | str) -> Column:
    """J7."""
    d = F.lower(col_of(dll))
    out = None
    for part, header in dims.MODULE_BONUS:
        out = (F if out is None else out).when(F.contains(d, F.lit(part)), header)
    return out
