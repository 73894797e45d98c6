"""Column expressions: lenient parsing, tokenising, record formats, time UUIDs. All of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def unquoted(line: Column) -> Column:
    """Every double quote removed, inner ones too."""
    return F.translate(line, '"', "")


def csv_parts(line: Column) -> Column:
    """Fields between commas that no backslash precedes; the backslash and trailing empty fields stay."""
    return F.split(unquoted(line), r"(?<!\\),", -1)


def float_or_zero(c: Column) -> Column:
    return F.coalesce(c.try_cast("float"), F.lit(0.0).cast("float"))


def strict_int(c: Column) -> Column:
    """An optional sign and digits only; anything else, or out of range, is 0."""
    return F.coalesce(F.when(c.rlike(r"^[+-]?[0-9]+$"), c.try_cast("int")), F.lit(0))


def parse_boolean(c: Column) -> Column:
    return F.coalesce(c == "t", F.lit(False))


def is_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) == ""


def substring_after(c: Column, separator: str) -> Column:
    """What follows the first separator; "" without one."""
    at = F.instr(c, separator)
    return F.when(at > 0, F.substring(c, at + len(separator), F.length(c))).otherwise(F.lit(""))


def subject_contains(c: Column, word: str) -> Column:
    """Case-insensitive substring test; NULL contains nothing."""
    return F.lower(F.coalesce(c, F.lit(""))).contains(word.lower())


def tokens(line: Column, mode: str = "java") -> Column:
    """Lower-case words of ASCII letters, by one of three rules for empty tokens.

    java: each other character is a space, split on runs of white space; trailing empty tokens go, a leading one stays,
    a blank line has none and an empty line has one.  python: runs become one space, split on it; all empty tokens stay.
    clean: no empty tokens.
    """
    if mode == "python":
        return F.split(F.lower(F.regexp_replace(line, "[^a-zA-Z]+", " ")), " ", -1)
    spaced = F.lower(F.regexp_replace(line, "[^a-zA-Z]", " "))
    if mode == "java":
        none = F.array().cast("array<string>")
        rule = lambda v: F.when(v == "", F.array(F.lit(""))).when(F.rtrim(v) == "", none).otherwise(F.split(F.rtrim(v), r"\s+", -1))
        return F.flatten(F.transform(F.array(spaced), rule))  # the line is cleaned once, not in each branch
    if mode == "clean":
        return F.filter(F.split(spaced, r"\s+", -1), lambda w: w != "")
    raise ValueError(f"unknown tokenising mode {mode!r}")


def record(columns: list[Column], present: Column | None = None) -> Column:
    """Values joined by "|"; a column of doubles is printed with two decimals. An absent side prints ``null`` for each."""
    text = F.concat_ws("|", *columns)
    return text if present is None else F.when(present, text).otherwise(F.lit("|".join(["null"] * len(columns))))


def text_or_null(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit("null"))


def two_decimals(c: Column) -> Column:
    return F.when(c.isNull(), F.lit("null")).otherwise(F.format_string("%.2f", c.cast("double")))


def uuid1_timestamp(c: Column) -> Column:
    """The time in a version-1 UUID, to the millisecond."""
    ticks = F.conv(F.concat(F.substring(c, 16, 3), F.substring(c, 10, 4), F.substring(c, 1, 8)), 16, 10).cast("bigint")
    return F.date_trunc("millisecond", F.timestamp_micros(F.floor((ticks - F.lit(122192928000000000)) / 10).cast("bigint")))


def hash_bucket(c: Column, n: int) -> Column:
    return F.pmod(F.hash(c), F.lit(n))
