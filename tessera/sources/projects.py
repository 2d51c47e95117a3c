"""Projects and modules as relations over listed files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Directories of a project, in the order in which a module is looked for.
KINDS = ("src", "tests", "benches")


def projects(manifests: DataFrame) -> DataFrame:
    """(dir) of the manifests (path, content) that are packages and do not lie below another hit: each
    directory's ancestors are exploded and met by equality, so nothing is compared pairwise (SC5, SC6)."""
    own = manifests.where(F.endswith("path", F.lit("/Cargo.toml")) & ~F.col("content").rlike(r"(?m)^\s*\[workspace\]")).select(F.regexp_replace("path", "/Cargo.toml$", "").alias("dir")).distinct()
    parts = F.split("dir", "/")
    above = own.withColumn("n", F.size(parts)).where("n > 2").select("dir", F.explode(F.transform(F.sequence(F.lit(2), F.col("n") - 1), lambda k: F.array_join(F.slice(parts, 1, k), "/"))).alias("ancestor"))
    nested = above.join(own.select(F.col("dir").alias("ancestor")), "ancestor", "left_semi").select("dir").distinct()
    return own.join(nested, "dir", "left_anti")


def kind_of(rel_path: Column | str) -> Column:
    """src, tests, benches, scripts or other, by the directories of the path (SC8, AG22)."""
    out = F.when(F.regexp_like(F.col(rel_path) if isinstance(rel_path, str) else rel_path, F.lit(r"\.(py|sh)$")), "scripts")
    for k in KINDS:
        out = out.when(F.regexp_like(F.col(rel_path) if isinstance(rel_path, str) else rel_path, F.lit(rf"(^|/){k}/")), k)
    return out.otherwise("other")


def module_files(files: DataFrame, modules: DataFrame) -> DataFrame:
    """(module, kind, path): for each module its source, then its tests and benches, by the first of the
    names ``test_X``, ``TestX`` and ``X`` (SC9, J16)."""
    named = modules.select("module", F.posexplode(F.array(F.concat(F.lit("test_"), "module"), F.concat(F.lit("Test"), "module"), F.col("module"))).alias("rank", "stem"))
    own = files.select("path", "stem", kind_of("rel_path").alias("kind")).where(F.col("kind").isin(*KINDS))
    found = own.join(named, "stem").where((F.col("kind") != "src") | (F.col("rank") == 2))
    w = Window.partitionBy("module", "kind").orderBy("rank", "path")
    return found.withColumn("n", F.row_number().over(w)).where("n = 1").select("module", "kind", "path")


def named_files(files: DataFrame, name: str, max_depth: int = 6, most: int | None = None) -> DataFrame:
    """Files of one name down to a depth, in order of path; ``most`` is the tool's own limit (SC10, SO9)."""
    out = files.where((F.element_at(F.split("rel_path", "/"), -1) == name) & (F.size(F.split("rel_path", "/")) <= max_depth)).orderBy("path")
    return out if most is None else out.limit(most)


def commented_modules(files: DataFrame) -> DataFrame:
    """(path, line_no, module) of ``pub mod`` lines that are commented out (SC20)."""
    from tessera.sources.files import lines

    module = F.regexp_extract("text", r"^\s*//\s*(?:pub\s+)?mod\s+(\w+)", 1)
    return lines(files).select("path", "line_no", module.alias("module")).where("module <> ''")


def gated_modules(files: DataFrame) -> DataFrame:
    """(path, line_no, feature, module, chapter): modules behind a feature, with the module whose braces
    enclose them (SC19): the last one that opened at the depth above."""
    from tessera.operators.windows import running_depth
    from tessera.sources.files import lines

    own = lines(files)
    w = Window.partitionBy("path").orderBy("line_no")
    change = F.regexp_count("text", F.lit(r"\{")) - F.regexp_count("text", F.lit(r"\}"))
    deep = running_depth(own, ["path"], ["line_no"], change, "after").withColumn("depth", F.col("after") - change)
    opens = F.regexp_extract("text", r"^\s*(?:pub\s+)?mod\s+(\w+)\s*\{", 1)
    feature = F.regexp_extract(F.lag("text").over(w), r'#\[cfg\(.*feature\s*=\s*"([^"]+)"', 1)
    module = F.regexp_extract("text", r"^\s*(?:pub\s+)?mod\s+(\w+)\s*;", 1)
    rows = deep.withColumn("opened", F.nullif(opens, F.lit(""))).withColumn("feature", feature).withColumn("module", module)
    by_depth = Window.partitionBy("path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    stack = F.array_sort(F.collect_list(F.when(F.col("opened").isNotNull(), F.struct("line_no", "depth", "opened"))).over(by_depth))
    chapter = F.try_element_at(F.filter(stack, lambda s: s["depth"] == F.col("depth") - 1), F.lit(-1))["opened"]
    return rows.withColumn("chapter", chapter).where("module <> '' and feature <> ''").select("path", "line_no", "feature", "module", "chapter")


def loc_rollup(loc: DataFrame, files: DataFrame) -> DataFrame:
    """Lines of code by project and kind of directory, split by whether a file has verified code (AG22, AG23)."""
    own = loc.join(files.select("path", "project", kind_of("rel_path").alias("dir_kind")), "path")
    verified = F.col("spec") + F.col("proof") + F.col("exec") > 0
    return own.groupBy("project", "dir_kind", verified.alias("verified")).agg(F.count("*").alias("n_files"), *(F.sum(c).alias(c) for c in ("spec", "proof", "exec", "rust", "total")))
