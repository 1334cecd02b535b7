"""Scalars as Columns (section SC): text, paths, times and numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def words(c: Column) -> Column:
    """SC1: lower-case words, at ASCII white space."""
    return F.filter(F.split(F.lower(c), r"\s+"), lambda w: w != "")


def trim_end(c: Column) -> Column:
    """SC3: without blanks, tabs and carriage returns at the end."""
    return F.regexp_replace(c, r"[ \t\r]+\z", "")


def significant(c: Column) -> Column:
    """EX28: at least 3 bytes, not digits only."""
    return (F.octet_length(c) >= 3) & ~c.rlike(r"\A\d+\z")


def summary_line(c: Column, most: int = 300) -> Column:
    """SC5: the first line, cut with an ellipsis."""
    line = F.trim(F.substring_index(c, "\n", 1))
    return F.when(F.char_length(line) > most, F.concat(F.substring(line, 1, most), F.lit("…"))).otherwise(line)


def base_name(c: Column) -> Column:
    """SC7."""
    return F.element_at(F.split(c, "/"), -1)


def extension(c: Column) -> Column:
    return F.regexp_extract(c, r"(\.[^./]*)\z", 1)


def unquoted(c: Column) -> Column:
    """SC8: without one pair of surrounding quotes of a kind."""
    return F.regexp_replace(c, r"(?s)\A([\"'`])(.*)\1\z", "$2")


def normalise_whitespace(c: Column) -> Column:
    """EX26 without a UDF: no blanks at line ends, at most two blank lines in a row, trimmed."""
    ends = F.regexp_replace(c, r"[ \t\r]+(?=\n|\z)", "")
    return F.regexp_replace(F.regexp_replace(ends, r"\n{4,}", "\n\n\n"), r"\A\s+|\s+\z", "")


def first_argument(c: Column) -> Column:
    """SC11."""
    return F.regexp_extract(F.trim(c), r"\A[^ \t\n\r;]*", 0)


def day(c: Column) -> Column:
    """SC14."""
    return F.date_format(c, "yyyy-MM-dd")


def minute(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd-HH:mm")


def change(off: Column, on: Column) -> Column:
    """SC18: percent, with a sign and one digit; a zero baseline has none."""
    return F.when(off == 0, "(no baseline)").otherwise(F.format_string("%+.1f%%", (on - off) / off * 100))


def escape_pipes(c: Column) -> Column:
    """SC20."""
    return F.replace(c, F.lit("|"), F.lit("\\|"))


def natural_id(*parts: Column) -> Column:
    """SC22: an id that retries don't change."""
    return F.sha2(F.concat_ws("\0", *parts), 256)
