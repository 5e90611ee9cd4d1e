"""Text and path expressions. White space and word characters are Unicode ones unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Line ends as the engine sees them, and as the project scanner does.
ENGINE_LINE_END = r"\r\n|\r|\n"
SCANNER_LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
#: Where compilers and systems keep their own headers.
SYSTEM_PREFIXES = ("/usr/", "/lib/", "c:/windows/", "c:/program files")
SYSTEM_PARTS = ("/clang/", "/c++/v1/", "/include/c++/")


def strip(c: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def decode(content: Column) -> Column:
    """Bytes as text, with replacement characters for what is not UTF-8."""
    return F.make_valid_utf8(content.cast("string"))


def lines(text: Column, scanner: bool = False) -> Column:
    """The lines of a text as an array; a line end at the very end begins no further line."""
    parts = F.split(text, SCANNER_LINE_END if scanner else ENGINE_LINE_END)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def line_at(all_lines: Column, number: Column) -> Column:
    """The line of a 1-based number, '' outside."""
    return F.coalesce(F.when(number >= 1, F.get(all_lines, number - 1)), F.lit(""))


def slice_lines(all_lines: Column, first: Column, last: Column) -> Column:
    """Lines first to last as one text."""
    start = F.greatest(first, F.lit(1))
    return F.when(last < start, "").otherwise(F.array_join(F.slice(all_lines, start, F.greatest(last - start + 1, F.lit(0))), "\n"))


def extent(all_lines: Column, first: Column, last: Column, first_col: Column, last_col: Column) -> Column:
    """The text from (first, first_col) up to, not including, (last, last_col): 1-based, clamped to the lines there are."""
    sl, el = F.greatest(first, F.lit(1)), F.least(last, F.size(all_lines))
    one = strip(F.substring(line_at(all_lines, sl), first_col, last_col - first_col))
    middle = F.when(el - sl > 1, F.transform(F.slice(all_lines, sl + 1, el - sl - 1), lambda x: F.regexp_replace(x, r"(?U)\s+$", ""))).otherwise(F.array().cast("array<string>"))
    head = F.regexp_replace(F.substring(line_at(all_lines, sl), first_col, F.lit(1 << 30)), r"(?U)\s+$", "")
    tail = F.regexp_replace(F.substring(line_at(all_lines, el), F.lit(1), last_col - 1), r"(?U)\s+$", "")
    many = F.array_join(F.concat(F.array(head), middle, F.array(tail)), "\n")
    return F.when(el < sl, "").when(el == sl, one).otherwise(many)


def line_comment(line: Column) -> Column:
    """The text after the first `//` outside double quotes, without white space around it, else ''.

    A fold over quotes, slashes and what lies between them carries the place, whether a string is open, and the start of
    the comment; a quote after a backslash opens and closes nothing.
    """
    parts = F.regexp_extract_all(line, F.lit(r'//|"|/|[^"/]+'), F.lit(0))
    step = lambda s, t: F.struct(
        (s["at"] + F.length(t)).alias("at"),
        F.when((t == '"') & ~s["escaped"], ~s["open"]).otherwise(s["open"]).alias("open"),
        t.endswith("\\").alias("escaped"),
        F.when((s["from"] == 0) & (t == "//") & ~s["open"], s["at"] + 2).otherwise(s["from"]).alias("from"),
    )
    start = F.struct(F.lit(1).alias("at"), F.lit(False).alias("open"), F.lit(False).alias("escaped"), F.lit(0).alias("from"))
    found = F.aggregate(parts, start, step, lambda s: s["from"])
    return F.transform(F.array(found), lambda n: F.when(n > 0, strip(F.substring(line, n, F.lit(1 << 30)))).otherwise(""))[0]


def is_system_path(path: Column) -> Column:
    """Whether a path belongs to a compiler or to the system, whatever its case and slashes."""
    p = lower_path(path)
    out = F.lit(False)
    for x in SYSTEM_PREFIXES:
        out = out | p.startswith(x)
    for x in SYSTEM_PARTS:
        out = out | p.contains(x)
    return out


def lower_path(path: Column) -> Column:
    return F.lower(F.replace(path, F.lit("\\"), F.lit("/")))


def join_path(base: Column, path: Column) -> Column:
    """base/path; an absolute path stays."""
    return F.when(path.startswith("/") | path.rlike(r"^[A-Za-z]:[/\\]"), path).otherwise(F.concat(F.regexp_replace(base, "/+$", ""), F.lit("/"), path))


def relative_path(path: Column, base: Column) -> Column:
    """The path below base, or the path itself if it isn't below."""
    b = F.concat(F.regexp_replace(base, "/+$", ""), F.lit("/"))
    return F.when(path.startswith(b), F.substring(path, F.length(b) + 1, F.lit(1 << 30))).otherwise(path)


def plain_path(path: Column) -> Column:
    """Without `.` segments, doubled slashes, and `name/..` pairs however deep, as lower case.

    A fold over the segments keeps those that stay; `..` takes the last of them away, but neither the root nor another `..`.
    """
    p = lower_path(path)
    step = lambda kept, x: (
        F.when(x.isin(".", ""), kept)
        .when((x == "..") & (F.size(kept) > 0) & (F.coalesce(F.element_at(kept, -1), F.lit("")) != ".."), F.slice(kept, 1, F.size(kept) - 1))
        .when((x == "..") & p.startswith("/") & (F.size(kept) == 0), kept)
        .otherwise(F.concat(kept, F.array(x)))
    )
    parts = F.aggregate(F.split(p, "/"), F.array().cast("array<string>"), step)
    return F.concat(F.when(p.startswith("/"), "/").otherwise(""), F.array_join(parts, "/"))


def stem(path: Column) -> Column:
    """The last part of a path without its last extension."""
    name = F.regexp_extract(F.replace(path, F.lit("\\"), F.lit("/")), r"([^/]*)$", 1)
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def content_hash(text: Column) -> Column:
    """The first 16 hexadecimal digits of the MD5 sum."""
    return F.substring(F.md5(text), 1, 16)


def cache_name(hash16: Column) -> Column:
    return F.concat(F.lit("pkb_"), hash16, F.lit(".json"))
