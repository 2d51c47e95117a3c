"""Automatic triggers: where they stand, what logs and messages recommend, and which place gets what."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import trigger_annotations
from tessera.sources.files import lines

SPAN = r"^(.+?):(\d+):(\d+): (\d+):(\d+)"


def auto_triggers(files: DataFrame) -> DataFrame:
    """(path, line_no, col, is_inner) of every ``#![auto]`` and ``#[auto]`` (EX42); columns from 1."""
    found = lines(files).where(F.col("text").rlike(r"#!?\[auto\]"))
    parts = F.split("text", r"(?=#!?\[auto\])")
    each = found.select("path", "line_no", F.posexplode(parts).alias("i", "part"), parts.alias("parts")).where(F.col("part").rlike(r"^#!?\[auto\]"))
    col = F.aggregate(F.slice("parts", F.lit(1), F.col("i")), F.lit(0), lambda n, x: n + F.length(x)) + 1
    return each.select("path", "line_no", col.alias("col"), F.startswith("part", F.lit("#!")).alias("is_inner"))


def _span(text, prefix: str) -> list:
    return [F.regexp_extract(text, SPAN, 1).alias(f"{prefix}file")] + [F.regexp_extract(text, SPAN, i).try_cast("int").alias(f"{prefix}{c}") for i, c in enumerate(("line_s", "col_s", "line_e", "col_e"), 2)]


def trigger_log(files: DataFrame) -> DataFrame:
    """(path, entry, file, line_s, col_s, line_e, col_e, groups, manual, low_confidence) of ``ChosenTriggers``
    entries in a debug log (SC15). Lines belong to the last entry that began; inside its triggers a line that
    is ``[`` begins a group, and the spans in a group are its expressions."""
    own = lines(files).withColumn("own", F.trim("text"))
    w = Window.partitionBy("path").orderBy("line_no")
    entry = F.when(F.startswith("own", F.lit("ChosenTriggers {")), F.col("line_no"))
    inside = own.withColumn("entry", F.last(entry, ignorenulls=True).over(w)).where("entry is not null")
    by = Window.partitionBy("path", "entry").orderBy("line_no")
    # brackets opened within the entry's triggers
    opened = F.regexp_count("own", F.lit(r"\[")) - F.regexp_count("own", F.lit(r"\]"))
    began = F.max(F.startswith("own", F.lit("triggers: ["))).over(by)
    deep = inside.withColumn("began", began).withColumn("depth", F.sum(F.when(F.col("began"), opened).otherwise(0)).over(by))
    group = F.sum(F.when(F.col("began") & (F.col("own") == "["), 1).otherwise(0)).over(by)
    span = F.nullif(F.regexp_extract("own", r'as_string:\s*"([^"]*)"', 1), F.lit(""))
    rows = deep.withColumn("group", group).withColumn("span", span).withColumn("in_group", F.col("began") & (F.col("depth") >= 2))
    flag = lambda name: F.bool_or(F.regexp_extract("own", rf"{name}:\s*(true|false)", 1) == "true")
    expressions = rows.where("in_group and span is not null").groupBy("path", "entry", "group").agg(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "span"))), lambda x: x["span"]).alias("of_group"))
    groups = expressions.groupBy("path", "entry").agg(F.transform(F.array_sort(F.collect_list(F.struct("group", "of_group"))), lambda x: x["of_group"]).alias("groups"))
    heads = rows.groupBy("path", "entry").agg(F.min_by("span", F.when(~F.col("began") & F.col("span").isNotNull(), F.col("line_no"))).alias("quantifier"), flag("manual").alias("manual"), flag("low_confidence").alias("low_confidence"))
    return heads.join(groups, ["path", "entry"], "left").select("path", "entry", *_span(F.col("quantifier"), ""), F.coalesce("groups", F.array().cast("array<array<string>>")).alias("groups"), "manual", "low_confidence")


def trigger_messages(files: DataFrame) -> DataFrame:
    """(path, entry, file, line_s, col_s, groups) of a compiler's messages on chosen triggers (SC16): an entry
    begins at ``automatically chose triggers``, its place is the first arrow within 4 lines, and each
    ``trigger i of n`` has the first arrow within 4 lines as its only expression, as wide as the carets."""
    own = lines(files)
    w = Window.partitionBy("path").orderBy("line_no")
    arrow = r"-->\s+(.+?):(\d+):(\d+)"
    begins = F.contains("text", F.lit("automatically chose triggers for this expression:"))
    ends = F.contains("text", F.lit("note: Verus printed one or more"))
    entry = F.last(F.when(begins, F.col("line_no")).when(ends, F.lit(-1)), ignorenulls=True).over(w)
    ahead = w.rowsBetween(1, 4)
    place = F.first(F.when(F.col("text").rlike(arrow), F.struct("line_no", F.regexp_extract("text", arrow, 1).alias("file"), F.regexp_extract("text", arrow, 2).cast("int").alias("line"), F.regexp_extract("text", arrow, 3).cast("int").alias("col"))), ignorenulls=True)
    carets = F.length(F.regexp_extract("text", r"^\s*\|?\s*(\^+)", 1))
    rows = own.withColumn("entry", entry).withColumn("place", place.over(ahead)).withColumn("carets", F.nullif(carets, F.lit(0)))
    # the first carets within 4 lines after the arrow of a trigger
    wide = rows.withColumn("width", F.first("carets", ignorenulls=True).over(w.rowsBetween(0, 8))).where("entry > 0")
    is_trigger = F.col("text").rlike(r"trigger\s+\d+\s+of\s+\d+:") & F.col("place").isNotNull()
    end = F.col("place.col") + F.coalesce("width", F.lit(0))
    told = F.format_string("%s:%d:%d: %d:%d", "place.file", "place.line", "place.col", "place.line", end)
    groups = wide.where(is_trigger).groupBy("path", "entry").agg(F.transform(F.array_sort(F.collect_list(F.struct("line_no", told.alias("x")))), lambda x: F.array(x["x"])).alias("groups"))
    heads = wide.where(begins).select("path", "entry", F.col("place.file").alias("file"), F.col("place.line").alias("line_s"), F.col("place.col").alias("col_s"))
    return heads.join(groups, ["path", "entry"], "left").withColumn("groups", F.coalesce("groups", F.array().cast("array<array<string>>")))


def recommended(places: DataFrame, entries: DataFrame) -> DataFrame:
    """(path, line_no, annotation): each entry that is not manual goes to the first automatic trigger in its
    span, a later entry over an earlier one at the same place (J10, FN21). Spans of a file are met by its
    name and by buckets of 64 lines."""
    own = entries.where("not manual").withColumn("bucket", F.explode(F.sequence(F.floor(F.col("line_s") / 64), F.floor(F.col("line_e") / 64))))
    p = places.withColumn("bucket", F.floor(F.col("line_no") / 64)).select(F.col("path").alias("file"), "line_no", "bucket")
    met = p.join(own, ["file", "bucket"]).where(F.col("line_no").between(F.col("line_s"), F.col("line_e")))
    first = met.groupBy("file", "entry").agg(F.min("line_no").alias("line_no"), F.first("groups").alias("groups"))
    return first.groupBy(F.col("file").alias("path"), "line_no").agg(F.max_by("groups", "entry").alias("groups")).select("path", "line_no", trigger_annotations(F.col("groups")).alias("annotation"))
