"""The proof-hole audit: findings, dependencies, rollups and next targets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.lineage import cut
from tessera.operators.aggregates import percent_floor
from tessera.operators.extract import dependencies, facts
from tessera.operators.joins import prefix_join

#: Findings that only warn.
WARNINGS = ("assume_eq_clone_workaround", "requires_true")


def modules(files: DataFrame) -> DataFrame:
    """path with its module: ``src/a/b.rs`` is a::b, ``mod.rs`` its directory."""
    m = F.regexp_replace(F.regexp_replace(F.regexp_replace("rel_path", r"^(.*/)?src/", ""), r"\.rs$", ""), r"/mod$", "")
    return files.select("path", "project", F.regexp_replace(m, "/", "::").alias("module"))


def file_status(findings: DataFrame, files: DataFrame) -> DataFrame:
    """(path, project, module, n_holes, n_errors, n_warnings, n_info, is_holed)."""
    severity = F.col("severity")
    counts = findings.groupBy("path").agg(
        F.count_if(severity == "H").alias("n_holes"), F.count_if(severity == "E").alias("n_errors"), F.count_if(severity == "W").alias("n_warnings"), F.count_if(severity == "I").alias("n_info")
    )
    out = modules(files).join(counts, "path", "left").fillna(0, ["n_holes", "n_errors", "n_warnings", "n_info"])
    return out.withColumn("is_holed", (F.col("n_holes") > 0) | (F.col("n_errors") > 0))


def rollup(status: DataFrame) -> DataFrame:
    """Sums from file to project to all, with the share of clean files."""
    clean = F.count_if(~F.col("is_holed"))
    return status.rollup("project", "path").agg(
        F.count("*").alias("n_files"), clean.alias("n_clean"), F.sum("n_holes").alias("n_holes"), F.sum("n_errors").alias("n_errors"), percent_floor(clean, F.count("*")).alias("percent_clean"), F.grouping_id().alias("level")
    )


def holed_dependencies(status: DataFrame, files: DataFrame) -> DataFrame:
    """(path, dep, module) of dependencies on holed modules, at or below the path that is named."""
    holed = status.where("is_holed").select("module", F.col("path").alias("holed_path"))
    return prefix_join(dependencies(files), "dep", holed, "module").where(F.col("path") != F.col("holed_path")).select("path", "dep", "module").distinct()


def next_targets(status: DataFrame, files: DataFrame) -> DataFrame:
    """Holed files that depend on clean modules only, the most holes first."""
    blocked = holed_dependencies(status, files).select("path").distinct()
    return status.where("is_holed").join(blocked, "path", "left_anti").orderBy(F.desc("n_holes"), "path")


def audit(files: DataFrame) -> dict[str, DataFrame]:
    found = cut(facts(files, "findings"))
    status = cut(file_status(found, files))
    return {
        "findings": found, "status": status, "rollup": rollup(status), "by_type": found.groupBy("hole_type", "severity").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "hole_type"),
        "dependencies": holed_dependencies(status, files), "targets": next_targets(status, files),
    }


def emacs(findings: DataFrame) -> DataFrame:
    """One ``file:line: message`` a finding (SK4)."""
    return findings.select(F.format_string("%s:%d: %s %s", "path", "line", "hole_type", "context").alias("value"))
