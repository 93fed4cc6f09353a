"""Text helpers as column expressions (Unicode-aware, JVM side)."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The named character references decoded in page text.
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&nbsp;", " ")]


#: What ``(?U)\\s`` matches.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200b))) + "\u2028\u2029\u202f\u205f\u3000"


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f(value)`` with one evaluation of ``value``, however often ``f`` names it: it is the element of an array of one."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def strip(col: Column) -> Column:
    """Remove Unicode white space at both ends (plain ``trim`` keeps NBSP)."""
    return F.btrim(col, F.lit(WHITE))


def clean_text(col: Column) -> Column:
    """Every white-space run becomes one space, ends stripped, null -> ''."""
    return F.coalesce(strip(F.regexp_replace(col, r"(?U)\s+", " ")), F.lit(""))


def extract(col: Column, pattern: str, group: int = 1) -> Column:
    """First capture or null (``regexp_extract`` gives '' on no match)."""
    return F.nullif(F.regexp_extract(col, pattern, group), F.lit(""))


def any_word(col: Column, words: list[str]) -> Column:
    """True when the text contains one of a short fixed list of words.  A chain of
    ``contains`` stays inside generated code, a higher-order function would not."""
    return reduce(Column.__or__, [F.contains(col, F.lit(w)) for w in words])


def decode_numeric(html: Column) -> Column:
    """Numeric character references of a whole page; ``<``, ``>`` and ``&`` stay escaped."""
    parts = F.regexp_extract_all(html, F.lit(r"(?s)(&#[xX]?[0-9a-fA-F]+;|&|[^&]+)"), F.lit(1))

    def decode(part: Column) -> Column:
        hexa = F.regexp_extract(part, r"^&#[xX]([0-9a-fA-F]{1,6});\z", 1)
        deci = F.regexp_extract(part, r"^&#([0-9]{1,7});\z", 1)
        code = F.when(hexa != "", F.lpad(F.upper(hexa), 8, "0")).when(
            deci != "", F.lpad(F.hex(deci.cast("int")), 8, "0"))
        legal = code.isNotNull() & (code < "00110000") & ~code.between("0000D800", "0000DFFF")
        return (F.when(code == "0000003C", "&lt;").when(code == "0000003E", "&gt;").when(code == "00000026", "&amp;")
                .when(legal, F.decode(F.unhex(code), "UTF-32")).otherwise(part))

    return F.when(F.contains(html, F.lit("&#")), F.array_join(F.transform(parts, decode), "")).otherwise(html)


def unescape(col: Column) -> Column:
    """Decode the named character references."""
    out = col
    for name, char in ENTITIES:
        out = F.replace(out, F.lit(name), F.lit(char))
    return F.replace(out, F.lit("&amp;"), F.lit("&"))


def lines_of(col: Column) -> Column:
    return F.split(col, "\n")


def indent_of(line: Column) -> Column:
    return F.length(line) - F.length(F.regexp_replace(line, r"(?U)^\s+", ""))


def code_lines(col: Column) -> Column:
    """Non-blank lines."""
    return F.filter(lines_of(col), lambda x: strip(x) != "")


def merged_lines(lines: Column) -> Column:
    """P5, first half: a modifier-only first line joins the second one."""
    from docatlas.dims import SIGNATURE_MODIFIERS

    first = strip(F.get(lines, F.lit(0)))
    merge = (F.size(lines) > 1) & any_word(first, SIGNATURE_MODIFIERS) & ~F.contains(first, F.lit("("))
    return F.when(merge, F.concat(F.array(F.concat_ws(" ", first, strip(F.get(lines, F.lit(1))))),
                                  F.slice(lines, 3, F.greatest(F.size(lines), F.lit(1))))).otherwise(lines)


def laid_out(lines: Column) -> Column:
    """P5, second half: cut the smallest indent of lines 2..n."""
    rest = F.slice(lines, 2, F.greatest(F.size(lines), F.lit(1)))
    cut = F.coalesce(F.array_min(F.transform(rest, indent_of)), F.lit(0))
    head = F.regexp_replace(F.get(lines, F.lit(0)), r"(?U)\s+\z", "")
    body = F.transform(rest, lambda x: F.concat(
        F.repeat(F.lit(" "), indent_of(x) - cut), F.regexp_replace(x, r"(?U)^\s+", "")))
    return F.array_join(F.concat(F.array(head), body), "\n")


def with_signature(df, source: Column, out: str):
    """P5 as staged columns, so each list is computed once."""
    df = df.withColumn("_lines", merged_lines(code_lines(source)))
    return df.withColumn(out, F.when(F.size("_lines") > 0, laid_out(F.col("_lines")))).drop("_lines")


def clean_definition(col: Column) -> Column:
    """Minimum indent of all lines removed, blank and ``//`` lines dropped."""
    lines = lines_of(strip(col))
    full = F.filter(lines, lambda x: strip(x) != "")
    cut = F.coalesce(F.array_min(F.transform(full, indent_of)), F.lit(0))
    kept = F.filter(full, lambda x: ~F.startswith(strip(x), F.lit("//")))
    return F.array_join(F.transform(kept, lambda x: F.substring(x, cut + 1, F.length(x))), "\n")
