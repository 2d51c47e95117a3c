"""What a minimizer of proofs asks for as relations: lemmas with their ranges, call sites, candidates to
remove, modules in use, and lines after insertions. Running a verifier is not part of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.files import forward_fill, lines


def in_library(path: Column, library: str) -> Column:
    return F.startswith(path, F.lit(library.rstrip("/") + "/"))


def lemma_ranges(fns: DataFrame, mode: str = "proof") -> DataFrame:
    """(path, name, first, last, impl_type) of the functions of one mode (EX29)."""
    owner = F.when(F.col("location.kind").isin("impl_trait", "impl_struct"), F.col("location.owner"))
    return fns.where(F.col("mode") == mode).select("path", "name", F.col("line").alias("first"), F.col("end_line").alias("last"), owner.alias("impl_type"))


def _code(files: DataFrame) -> DataFrame:
    """Lines that are no comments, with the name of the last function that began at or above them."""
    name = F.nullif(F.regexp_extract("text", r"(?:^|\s)fn\s+(\w+)", 1), F.lit(""))
    return forward_fill(lines(files), ["path"], ["line_no"], name, "context").where(~F.startswith(F.trim("text"), F.lit("//")))


def asserts(files: DataFrame) -> DataFrame:
    """(path, line_no, kind, context): the first assert of a line, with the function around it (EX30)."""
    kind = F.regexp_extract("text", r"(?<!\w)(assert_forall_by|assert_by|assert)(?=[(!\s])", 1)
    return _code(files).withColumn("kind", kind).where("kind <> ''").select("path", "line_no", "kind", F.coalesce("context", F.lit("unknown")).alias("context"))


def candidates(files: DataFrame, types: DataFrame) -> DataFrame:
    """(path, line_no, kind, context): asserts, admits, proof blocks and type definitions, each of which may
    turn out not to be needed (EX30)."""
    own = _code(files)
    context = F.coalesce("context", F.lit("unknown")).alias("context")
    admits = own.where(F.col("text").rlike(r"(?<!\w)admit\s*\(")).select("path", "line_no", F.lit("admit").alias("kind"), context)
    blocks = own.where(F.col("text").rlike(r"(?<!\w)proof\s*\{")).select("path", "line_no", F.lit("proof block").alias("kind"), context)
    defined = types.where("in_block").select("path", F.col("line").alias("line_no"), F.col("kind"), F.col("name").alias("context"))
    return asserts(files).unionByName(admits).unionByName(blocks).unionByName(defined)


def call_sites(files: DataFrame, names: DataFrame, library: str) -> DataFrame:
    """(name, path, line_no, in_library) of calls ``name(``, declarations and comments left out (EX31). All
    names are looked up at once: the names before parentheses are exploded and met by equality."""
    own = lines(files).where(~F.startswith(F.trim("text"), F.lit("//")))
    called = own.select("path", "line_no", "text", F.explode(F.array_distinct(F.expr(r"regexp_extract_all(text, r'(\w+)\(', 1)"))).alias("name"))
    before = F.left("text", F.instr("text", F.concat("name", F.lit("("))) - 1)
    found = called.join(names.select("name").distinct(), "name", "left_semi").where(~F.contains(before, F.lit("fn ")))
    return found.select("name", "path", "line_no", in_library(F.col("path"), library).alias("in_library"))


def used_modules(files: DataFrame, modules: DataFrame, library: str) -> DataFrame:
    """Those of ``modules`` (module, a path a/b) that files outside the library name as ``m::``, ``::m``,
    ``use m`` or ``mod m`` (J19); names are met by equality, not searched one by one."""
    outside = files.where(~in_library(F.col("path"), library))
    forms = [F.expr(f"regexp_extract_all(content, r'{p}', 1)") for p in (r"(\w+)::", r"::(\w+)", r"\buse\s+(\w+)", r"\bmod\s+(\w+)")]
    named = outside.select(F.explode(F.array_distinct(F.concat(*forms))).alias("last")).distinct()
    return modules.withColumn("last", F.element_at(F.split("module", "/"), -1)).join(named, "last", "left_semi").select("module")


def lemma_groups(ranges: DataFrame, calls: DataFrame) -> DataFrame:
    """(name, path, n_variants, n_calls): the variants of a lemma in a file as one, those with the fewest
    calls outside the library first (AG39)."""
    outside = calls.where("not in_library").groupBy("name").agg(F.count("*").alias("n_outside"))
    own = ranges.join(outside, "name", "left").groupBy("name", "path").agg(F.count("*").alias("n_variants"), F.sum(F.coalesce("n_outside", F.lit(0))).alias("n_calls"))
    return own.orderBy("n_calls", "name", "path")


def shifted(places: DataFrame, insertions: DataFrame) -> DataFrame:
    """``places`` (path, line) with new_line, their lines after the insertions (path, seq, at, n) were made one
    after another: one at or above where a place has got to moves it on (W11). The fold is over the
    insertions of one file."""
    by_file = insertions.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("seq", "at", "n"))).alias("made"))
    moved = F.aggregate(F.coalesce("made", F.array().cast("array<struct<seq:bigint,at:bigint,n:bigint>>")), F.col("line").cast("bigint"), lambda now, x: F.when(x["at"] <= now, now + x["n"]).otherwise(now))
    return places.join(by_file, "path", "left").select(*places.columns, moved.alias("new_line"))


def savings(n_source_bytes: Column, n_extract_bytes: Column) -> Column:
    """How many times fewer tokens an extract has than its sources; 0 for an empty extract (AG42)."""
    few = F.floor(n_extract_bytes / 4)
    return F.when(few > 0, F.floor(n_source_bytes / 4) / few).otherwise(0.0)


def first_places(df: DataFrame, text: str, part: str) -> DataFrame:
    """The first row, by ``seq``, of each path whose text holds ``part`` (PR29, SO12)."""
    w = Window.partitionBy("path").orderBy("seq")
    return df.where(F.contains(text, F.lit(part))).withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")
