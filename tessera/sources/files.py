"""Sources: trees of files, their lines, inventories, logs and tables in text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Directories that no scan enters.
SKIPPED = ("attic", "target")


def scanned(rel_path: Column, path: Column, exclude: tuple[str, ...] = (), max_depth: int | None = None) -> Column:
    """Whether a scan takes a file: not below skipped and hidden directories, no excluded x as ``/x/`` in the
    path or at its end, and not deeper than ``max_depth`` (SC1 to SC4)."""
    kept = ~rel_path.rlike(r"(^|/)(" + "|".join(SKIPPED) + r"|\.[^/]*)/")
    for x in exclude:
        kept = kept & ~F.contains(path, F.lit(f"/{x}/")) & ~F.endswith(path, F.lit(x))
    return kept if max_depth is None else kept & (F.size(F.split(rel_path, "/")) <= max_depth)


def read_files(spark: SparkSession, root: str, pattern: str = "*.rs", exclude: tuple[str, ...] = (), max_depth: int | None = None) -> DataFrame:
    """(project, path, rel_path, dir, stem, content, n_bytes) of all files below ``root`` whose names
    match, without skipped and hidden directories and whatever contains ``/x/`` or ends in x for an
    excluded x. Paths and contents only: listing is Spark's, filters apply before contents are used."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    base = root.rstrip("/")
    path = F.regexp_replace("path", r"^\w+:/*", "/")
    rel = F.expr("if(endswith(clean, base), substring_index(clean, '/', -1), substring(clean, locate(base, clean) + length(base) + 1))")  # root may be one file
    out = raw.select(path.alias("clean"), F.lit(base).alias("base"), "content", "length").withColumn("rel_path", rel)
    kept = scanned(F.col("rel_path"), F.col("clean"), exclude, max_depth)
    name = F.element_at(F.split("rel_path", "/"), -1)
    return out.where(kept).select(
        F.when(F.contains("rel_path", F.lit("/")), F.split("rel_path", "/")[0]).otherwise("").alias("project"), F.col("clean").alias("path"), "rel_path",
        F.regexp_replace("rel_path", "/?[^/]*$", "").alias("dir"), F.regexp_replace(name, r"\.[^.]*$", "").alias("stem"), F.decode("content", "UTF-8").alias("content"), F.col("length").alias("n_bytes"),
    )


def lines(files: DataFrame, content: str = "content") -> DataFrame:
    """(path, line_no, text); the empty rest after a last line feed is no line."""
    parts = F.split(content, "\r?\n")
    whole = F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    return files.select("path", F.posexplode(whole).alias("at", "text")).select("path", (F.col("at") + 1).alias("line_no"), "text")


def forward_fill(df: DataFrame, keys: list[str], order: list, value: Column, name: str) -> DataFrame:
    """The last non-null value up to each row: which section, heading or type a line is under."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(name, F.last(value, ignorenulls=True).over(w))


def usage_log(files: DataFrame) -> DataFrame:
    """(path, section, owner, item, n) of a sectioned log: ``=== N.`` begins a section, ``TYPE: x`` an
    owner, and rows end in a count (SC14)."""
    own = lines(files)
    section = F.expr(r"try_cast(nullif(regexp_extract(text, r'^=== (\d+)\.', 1), '') AS int)")
    header = F.nullif(F.regexp_extract("text", r"TYPE:\s*(\S+)", 1), F.lit(""))
    filled = forward_fill(forward_fill(own, ["path"], ["line_no"], section, "section"), ["path"], ["line_no"], header, "owner")
    row = r"^\s*(?:\d+[.)]?\s+)?([A-Za-z_][\w:<>]*)\s+(\d+)\b"
    return filled.where(F.col("text").rlike(row)).select("path", "section", "owner", F.regexp_extract("text", row, 1).alias("item"), F.regexp_extract("text", row, 2).cast("bigint").alias("n"))


def spans_of_paths(files: DataFrame) -> DataFrame:
    """(path, seq, text, line_s, col_s, line_e, col_e) of ``.vp`` lines (SC17)."""
    span = r"(\d+):(\d+)-(\d+):(\d+)\s*$"
    cols = [F.regexp_extract("text", span, i + 1).cast("int").alias(c) for i, c in enumerate(("line_s", "col_s", "line_e", "col_e"))]
    return lines(files).where(F.col("text").rlike(span)).select("path", F.col("line_no").alias("seq"), F.trim(F.regexp_replace("text", span, "")).alias("text"), *cols)


def markdown_table(files: DataFrame, heading: str) -> DataFrame:
    """(path, line_no, cells) of table rows under a heading, without head and rule (SC18)."""
    title = F.nullif(F.regexp_extract("text", r"^#+\s*(.+?)\s*$", 1), F.lit(""))
    under = forward_fill(lines(files), ["path"], ["line_no"], title, "heading").where(F.contains("heading", F.lit(heading)) & F.startswith(F.trim("text"), F.lit("|")))
    cells = F.transform(F.split(F.regexp_replace(F.trim("text"), r"^\||\|$", ""), r"\|"), lambda c: F.trim(c))
    w = Window.partitionBy("path", "heading").orderBy("line_no")
    return under.withColumn("row", F.row_number().over(w)).where("row > 2").select("path", "line_no", cells.alias("cells"))


def inventory(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A nested inventory document with an explicit schema; a section is ``inline`` of its array (SC12)."""
    return spark.read.schema(schema).option("multiLine", True).json(path)
