"""Small text functions as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pascal_case(name: Column) -> Column:
    """a_bc_d as ABcD: the first letter of each part in upper case, the rest as it is (FN7)."""
    return F.array_join(F.transform(F.split(name, "_"), lambda s: F.concat(F.upper(F.left(s, F.lit(1))), F.substring(s, 2, 1 << 30))), "")


def file_to_module(path: Column) -> Column:
    """The name of a file without directories and its last extension (FN7)."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?<=.)\.[^.]*$", "")


def chapter_of_path(path: Column) -> Column:
    """src/Chap3/x.rs is in Chap3, src/x.rs in x; null elsewhere (FN5)."""
    return F.when(F.startswith(path, F.lit("src/")), F.try_element_at(F.split(F.regexp_replace(path, r"\.rs$", ""), "/"), F.lit(2)))


def chapter_order(chapter: Column) -> Column:
    """A sort key: chapters by their number, then all others by name."""
    number = F.regexp_extract(chapter, r"^Chap(\d+)$", 1).try_cast("bigint")
    return F.struct(number.isNull().alias("other"), F.coalesce(number, F.lit(0).cast("bigint")).alias("number"), F.when(number.isNull(), chapter).otherwise("").alias("name"))


def duration(seconds: Column) -> Column:
    """Seconds as 12s, 3m 4s or 1h 2m (FN18)."""
    whole = F.floor(seconds)
    hours, minutes = F.floor(whole / 3600), F.floor(whole / 60)
    return (
        F.when(whole < 60, F.concat(whole.cast("string"), F.lit("s")))
        .when(whole < 3600, F.concat(minutes.cast("string"), F.lit("m "), (whole % 60).cast("string"), F.lit("s")))
        .otherwise(F.concat(hours.cast("string"), F.lit("h "), (minutes % 60).cast("string"), F.lit("m")))
    )


def count_and_percent(part: Column, whole: Column) -> Column:
    """12 (34.3%); of nothing 0.0% (FN18)."""
    return F.concat(part.cast("string"), F.lit(" ("), F.format_string("%.1f", F.when(whole == 0, 0.0).otherwise(100.0 * part / whole)), F.lit("%)"))


def spans_overlap(start: Column, end: Column, other_start: Column, other_end: Column) -> Column:
    """Whether two spans, ends exclusive, share a place (FN20)."""
    return (start < other_end) & (end > other_start)


def escape_brace(text: Column) -> Column:
    """A closing brace as backslash and brace, as in path files (FN19)."""
    return F.replace(text, F.lit("}"), F.lit("\\}"))


def unescape_brace(text: Column) -> Column:
    return F.replace(text, F.lit("\\}"), F.lit("}"))


def byte_offset(content: Column, line: Column, column: Column) -> Column:
    """The UTF-8 byte at which a 1-based line and a 0-based column in characters lie (FN9)."""
    rows = F.split(content, "\n")
    before = F.aggregate(F.slice(rows, F.lit(1), line - 1), F.lit(0), lambda n, x: n + F.octet_length(x) + 1)
    return before + F.octet_length(F.substring(F.element_at(rows, line), F.lit(1), column))


def already_formatted(comment: Column) -> Column:
    """Comments that are a bullet, a numbered item, a fence, a heading or empty (PR25)."""
    own = F.trim(comment)
    return own.rlike(r"^(- |\* |```|#)|^$") | (own.rlike(r"^[0-9]") & F.contains(own, F.lit(". ")))


def token_estimate(n_bytes: Column) -> Column:
    """Four bytes a token (AG42)."""
    return F.floor(n_bytes / 4).cast("bigint")


def trigger_annotations(groups: Column) -> Column:
    """One ``#![trigger a, b]`` for each group of expressions (FN21)."""
    return F.array_join(F.transform(groups, lambda g: F.concat(F.lit("#![trigger "), F.array_join(g, ", "), F.lit("]"))), " ")
