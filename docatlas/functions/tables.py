"""Value tables, lists and struct bodies inside one html or code string."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docatlas import dims
from docatlas.functions import text as T


def _text(html: Column) -> Column:
    from docatlas.operators.blocks import text_of
    return text_of(html)


def rows_of(table: Column) -> Column:
    """Array of rows, each an array of cell html strings."""
    def cells(row: Column) -> Column:
        parts = F.split(row, r"(?i)(?=<t[dh][\s>])")
        return F.transform(F.slice(parts, 2, F.size(parts)), lambda c: F.regexp_replace(
            F.regexp_replace(c, r"(?i)^<t[dh][^>]*>", ""), r"(?is)</t[dh]\s*>.*", ""))

    parts = F.split(table, r"(?i)(?=<tr[\s>])")
    return F.transform(F.slice(parts, 2, F.size(parts)), cells)


def has_any(text: Column, words: list[str]) -> Column:
    return text.rlike("|".join(words))


def numeric_of(text: Column) -> Column:
    """First hex number, else first whole decimal number."""
    return F.coalesce(T.extract(text, r"0x[0-9A-Fa-f]+L?", 0), T.extract(text, r"\b(\d+)\b"))


def cell_value(cell: Column) -> Column:
    """P10: ``NAME (number)``, ``NAME`` or the first line of a value cell."""
    return T.once(cell, _cell_value)


def _cell_value(cell: Column) -> Column:
    bold = F.regexp_extract_all(cell, F.lit(r"(?is)<(?:b|strong)\b[^>]*>(.*?)</(?:b|strong)\s*>"), F.lit(1))
    name = F.get(F.filter(F.transform(bold, lambda x: T.strip(_text(x))),
                          lambda x: x.rlike(r"^[A-Z_][A-Z0-9_]*\z")), F.lit(0))
    dts = F.regexp_extract_all(cell, F.lit(r"(?is)<dt\b[^>]*>(.*?)(?:</dt\s*>|(?=<d[td]\b)|\z)"), F.lit(1))
    dt_number = F.get(F.filter(F.transform(dts, lambda x: T.strip(_text(x))),
                               lambda x: x.rlike(r"^(0x[0-9A-Fa-f]+L?|\d+)\z")), F.lit(0))

    def told(name: Column, text: Column, lines: Column) -> Column:
        number = F.coalesce(dt_number, numeric_of(text))
        word = F.get(F.filter(F.transform(lines, lambda x: F.regexp_extract(x, r"^([A-Z_][A-Z0-9_]*)", 1)),
                              lambda x: x != ""), F.lit(0))
        return T.once(F.coalesce(name, word), lambda const: F.when(const.isNotNull(), F.concat(const, F.coalesce(F.concat(F.lit(" ("), F.when(
            name.isNotNull(), number).otherwise(numeric_of(T.strip(text))), F.lit(")")), F.lit(""))))
            .otherwise(F.coalesce(F.get(lines, F.lit(0)), F.lit(""))))

    def lines_of(text: Column) -> Column:
        return F.filter(F.transform(T.lines_of(T.strip(text)), T.strip), lambda x: x != "")

    return T.once(name, lambda name: T.once(_text(cell), lambda text: T.once(lines_of(text), lambda lines: told(name, text, lines))))


def value_entries(rows: Column) -> Column:
    """Array of (value, meaning) of a value table given as ``rows_of``, else null.

    The first three cells must show a value word and a meaning word; columns come
    from the first row; rows count when both cells are not empty."""
    return T.once(rows, _value_entries)


def _value_entries(rows: Column) -> Column:
    low = F.transform(F.get(rows, F.lit(0)), lambda c: F.lower(T.strip(_text(c))))
    first3 = F.lower(F.array_join(F.transform(F.slice(F.flatten(rows), 1, 3), lambda c: T.strip(_text(c))), " "))

    def entries(vi: Column, mi: Column) -> Column:
        wide = F.filter(F.slice(rows, 2, F.greatest(F.size(rows), F.lit(1))),
                        lambda r: F.size(r) >= F.greatest(vi, mi))
        found = F.filter(F.transform(wide, lambda r: F.struct(
            cell_value(F.get(r, (vi - 1).cast("int"))).alias("value"),
            T.clean_text(_text(F.get(r, (mi - 1).cast("int")))).alias("meaning"))),
            lambda e: (e["value"] != "") & (e["meaning"] != ""))
        return F.when((vi > 0) & (mi > 0), T.once(found, lambda e: F.when(F.size(e) > 0, e)))

    def columns(low: Column) -> Column:
        vi = F.array_position(F.transform(low, lambda x: has_any(x, dims.VALUE_WORDS)), True)
        return T.once(vi, lambda vi: T.once(F.array_position(F.transform(
            low, lambda x, i: has_any(x, dims.MEANING_WORDS) & (i + 1 != vi)), True), lambda mi: entries(vi, mi)))

    ok = T.once(first3, lambda x: has_any(x, dims.VALUE_WORDS) & has_any(x, dims.MEANING_WORDS)) & (F.size(rows) >= 2)
    return F.when(ok, T.once(low, columns))


def first_constants(rows: Column) -> Column:
    """Upper-case first cells of the first two data rows."""
    firsts = F.filter(F.transform(F.slice(rows, 2, 2), lambda r: F.upper(T.strip(_text(F.get(r, F.lit(0)))))),
                      lambda x: x.isNotNull())
    return F.array_join(firsts, " ")


def title_of(caption: Column, near_heading: Column, paragraph: Column, constants: Column) -> Column:
    """Caption, near short heading, words of the paragraph before, constants."""
    low = F.lower(paragraph)
    out = F.when(caption.isNotNull(), caption).when(
        near_heading.isNotNull() & (near_heading != "") & (F.length(near_heading) < 100), near_heading)
    for words, title in dims.TITLE_BY_PARAGRAPH:
        out = out.when(low.rlike(words), title)
    for words, title in dims.TITLE_BY_CONSTANT:
        out = out.when(constants.rlike(words), title)
    return out.otherwise(dims.DEFAULT_TITLE)


def list_items(html: Column) -> Column:
    """Item texts of a list."""
    parts = F.split(html, r"(?i)(?=<li[\s>])")
    return F.transform(F.slice(parts, 2, F.size(parts)), lambda x: T.strip(_text(x)))


def list_entries(html: Column) -> Column:
    """(value, meaning) of a list with at least two items; items over 10
    characters, cut at the first ``:`` else the first `` - ``."""
    def entry(x: Column) -> Column:
        colon, dash = F.instr(x, ":"), F.instr(x, " - ")
        at = F.when(colon > 0, colon).otherwise(dash)
        width = F.when(colon > 0, 1).otherwise(3)
        return F.struct(
            F.when(at > 0, T.strip(F.substring(x, F.lit(1), at - 1))).otherwise("").alias("value"),
            F.when(at > 0, T.strip(F.substring(x, at + width, F.length(x)))).otherwise(x).alias("meaning"))

    def entries(items: Column) -> Column:
        long = F.filter(items, lambda x: F.length(x) > 10)
        found = F.filter(F.transform(long, entry), lambda e: e["meaning"] != "")
        return F.when(F.size(items) >= 2, T.once(found, lambda e: F.when(F.size(e) > 0, e)))

    return T.once(list_items(html), entries)


def definition_pairs(html: Column) -> Column:
    """(name, description) of dt/dd pairs of a definition list, at most 50."""
    parts = F.split(html, r"(?i)(?=<dt[\s>])")

    def pair(x: Column) -> Column:
        dd = F.regexp_extract(x, r"(?is)<dd\b[^>]*>(.*?)(?:</dd\s*>|\z)", 1)
        return F.struct(
            T.strip(_text(F.regexp_extract(x, r"(?is)^<dt\b[^>]*>(.*?)(?:</dt\s*>|(?=<dd\b)|\z)", 1))).alias("name"),
            F.when(x.rlike(r"(?i)<dd[\s>]"), T.strip(_text(dd))).alias("description"))

    return F.filter(F.transform(F.slice(parts, F.lit(2), F.size(parts)), pair), lambda p: p["description"].isNotNull())


def table_pairs(html: Column) -> Column:
    """(name, description) of the rows of a member table but the first."""
    rows = F.filter(rows_of(html), lambda r, i: (i > 0) & (F.size(r) >= 2))
    return F.transform(rows, lambda r: F.struct(
        T.strip(_text(r[0])).alias("name"), T.strip(_text(r[1])).alias("description")))


def code_members(code: Column) -> Column:
    """(name, type) of each ``TYPE name[n];`` line between the first braces."""
    body = F.regexp_extract(code, r"(?s)\{([^}]+)\}", 1)
    pattern = r"(?i)^([A-Z_][A-Z0-9_]*\s*\*?\s*)([a-zA-Z_][a-zA-Z0-9_]*)(\[\d+\])?"
    lines = F.transform(T.lines_of(body), T.strip)
    lines = F.filter(lines, lambda x: (x != "") & ~x.rlike(r"^(//|/\*)"))
    lines = F.transform(lines, lambda x: T.strip(F.regexp_replace(x, r";.*", "")))
    lines = F.filter(lines, lambda x: x.rlike(pattern))
    return F.transform(lines, lambda x: F.struct(
        F.regexp_extract(x, pattern, 2).alias("name"),
        F.concat(T.strip(F.regexp_extract(x, pattern, 1)), F.regexp_extract(x, pattern, 3)).alias("type")))
