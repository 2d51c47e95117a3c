"""The inventory of a library: thirteen sections of items, each a plan over the fact tables, their
totals, and what usage reports take from them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.plans.search import fact_tables
from tessera.sources.files import lines

#: Names that are ghost types, with what they stand for, and names that are tracked types.
GHOST_TYPES = {"Seq": "Vec", "Set": "HashSet", "Map": "HashMap", "Multiset": "HashMap", "FnSpec": None, "Ghost": None, "int": None, "nat": None}
TRACKED_TYPES = ("Tracked", "PointsTo", "PointsToRaw", "MemContents")
#: What macros of the library are for.
MACRO_PURPOSES = {
    "seq": "Create a sequence literal", "set": "Create a set literal", "map": "Create a map literal", "assert_by": "Assert with proof block", "calc": "Calculation proof",
}
#: Modules of the types that a library wraps (FN14).
RUST_MODULES = {
    "Chars": "core::str", "str": "core::str", "String": "alloc::string", "Vec": "alloc::vec", "VecDeque": "alloc::collections", "Option": "core::option", "Result": "core::result",
    "HashMap": "std::collections", "HashSet": "std::collections", "Box": "alloc::boxed", "Rc": "alloc::rc", "Arc": "alloc::sync", "Cow": "alloc::borrow", "Range": "core::ops",
    "RangeInclusive": "core::ops", "Duration": "core::time", "Ordering": "core::cmp", "PhantomData": "core::marker", "ManuallyDrop": "core::mem", "ControlFlow": "core::ops",
    "Infallible": "core::convert", "DefaultHasher": "std::collections::hash_map", "IntoIter": "alloc::vec", "Iter": "core::slice", "Keys": "std::collections::hash_map",
    "Values": "std::collections::hash_map",
    "AtomicBool": "core::sync::atomic", "AtomicU8": "core::sync::atomic", "AtomicU16": "core::sync::atomic", "AtomicU32": "core::sync::atomic", "AtomicU64": "core::sync::atomic",
    "AtomicUsize": "core::sync::atomic", "AtomicI8": "core::sync::atomic", "AtomicI16": "core::sync::atomic", "AtomicI32": "core::sync::atomic", "AtomicI64": "core::sync::atomic",
    "AtomicIsize": "core::sync::atomic",
}
#: Types that stand for a file of the library whose impls name none (FN14).
RUST_TYPES_OF_FILES = {
    "option": ("Option", "core::option"), "result": ("Result", "core::result"), "vecdeque": ("VecDeque", "alloc::collections"), "vec.rs": ("Vec", "alloc::vec"), "slice": ("slice", "core::slice"),
    "array.rs": ("array", "core::array"), "borrow.rs": ("Cow", "alloc::borrow"), "convert.rs": ("TryFromIntError", "core::num"), "cmp.rs": ("AssertParamIsEq", "core::cmp"),
}
#: Descriptions of compiler types, by name, and of compiler traits (EX28).
BUILTIN_TYPES = {
    "int": ("Mathematical unbounded integer (can be negative)", "mathematical"), "nat": ("Natural number (non-negative integer, >= 0)", "mathematical"),
    "real": ("Mathematical real number (arbitrary precision)", "mathematical"), "FnSpec": ("Specification-only function type (ghost callable)", "function"),
    "Ghost": ("Ghost wrapper - data exists only in proofs, erased at runtime", "wrapper"), "Tracked": ("Tracked wrapper - linear/affine data for permission tracking", "wrapper"),
}
BUILTIN_TRAITS = {"Integer": "Marker trait for integer types (int, nat, u8..u128, i8..i128)", "Sealed": "Sealed trait pattern - prevents external implementations"}
#: The order in which each section is reported (SO11).
ORDER = {
    "modules": "qualified_path", "ghost_types": "name", "tracked_types": "name", "wrapped_rust_types": "name", "traits": "name", "spec_functions": "qualified_path", "proof_functions": "qualified_path",
    "axioms": "qualified_path", "broadcast_groups": "qualified_path",
}
USAGE_SCHEMA = (
    "summary struct<total_projects:bigint,total_crates:bigint,crates_with_stdlib:bigint,unique_modules:bigint,unique_types:bigint,unique_traits:bigint,unique_methods:bigint>, "
    "analysis struct<modules:struct<items:array<struct<name:string,crate_count:bigint>>>,types:struct<items:array<struct<name:string,crate_count:bigint>>>,"
    "traits:struct<items:array<struct<name:string,crate_count:bigint>>>,methods:struct<items:array<struct<name:string,crate_count:bigint>>>>"
)


def _map(of: dict[str, str | None]) -> Column:
    return F.create_map(*(x for k, v in of.items() for x in (F.lit(k), F.lit(v).cast("string"))))


def module_of(path: Column | str, root: str) -> Column:
    """The path below directory ``root`` as a::b."""
    below = F.substring_index(path, f"/{root}/", -1)
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(below, r"\.rs$", ""), "/mod$", ""), "/", "::")


def axiom_category(name: Column, path: Column) -> Column:
    """The first class whose sign the name, or for some the file, has (FN13)."""
    has = lambda c, *parts: reduce(lambda a, b: a | b, (F.contains(c, F.lit(p)) for p in parts))
    return (
        F.when(has(path, "arithmetic") | has(name, "mul", "div", "mod"), "arithmetic").when(has(name, "seq"), "sequence").when(has(name, "set"), "set").when(has(name, "map"), "map")
        .when(has(name, "multiset"), "multiset").when(has(path, "std_specs"), "rust_semantics").when(has(name, "ptr", "raw"), "memory").otherwise("other")
    )


def rust_type(impl_type: Column, path: Column) -> Column:
    """struct<rust_type, rust_module> of a type that an impl or else its file names; null fields where neither does (FN14)."""
    base = F.trim(F.regexp_replace(impl_type, r"(?s)<.*$", ""))
    of = lambda n, m: F.struct(F.lit(n).alias("rust_type"), F.lit(m).alias("rust_module"))
    out = (
        F.when(_map(RUST_MODULES)[base].isNotNull(), F.struct(base.alias("rust_type"), _map(RUST_MODULES)[base].alias("rust_module")))
        .when(F.startswith(base, F.lit("*mut")), of("*mut T", "core::ptr")).when(F.startswith(base, F.lit("*const")), of("*const T", "core::ptr"))
        .when(F.startswith(base, F.lit("[")) & F.contains(base, F.lit(";")), of("array", "core::array")).when(F.startswith(base, F.lit("[")), of("slice", "core::slice"))
    )
    for part, known in RUST_TYPES_OF_FILES.items():
        out = out.when(F.contains(path, F.lit(part)), of(*known))
    return out


def sections(files: DataFrame, root: str = "vstd", std: str = "std_specs") -> dict[str, DataFrame]:
    """The sections of the library below directory ``root``, by name; each has path, line, name and
    qualified_path (EX27)."""
    t = fact_tables(files)
    own = lines(files)
    path = lambda df: df.withColumn("module", module_of("path", root)).withColumn("qualified_path", F.concat_ws("::", F.lit(root), "module", "name"))
    free = path(t["fns"].where("location.kind = 'module' and in_block"))
    has = lambda word: F.array_contains("modifiers", word)
    key = ["path", "line", "name", "qualified_path"]
    clause = {c: (F.size(c) > 0).alias(f"has_{c}") for c in ("requires", "ensures", "recommends")}
    is_axiom = (F.col("mode") == "axiom") | F.startswith("name", F.lit("axiom_"))
    structs = path(t["types"].where("kind = 'struct'"))
    external = F.array_join("attributes", " ").rlike(r"\bverifier\b|\bexternal_body\b")
    known_ghost, known_tracked = F.col("name").isin(*GHOST_TYPES), F.col("name").isin(*TRACKED_TYPES)
    is_ghost = known_ghost | (external & ~known_tracked)
    spec_methods = t["fns"].where("location.kind in ('impl_trait', 'impl_struct') and mode = 'spec' and in_block").select(
        "path", "line", "start", F.col("location.owner").alias("owner"), F.col("name").alias("method"), has("uninterp").alias("is_uninterpreted"), has("open").alias("is_open"), clause["recommends"]
    )
    ghosts = structs.where(is_ghost)
    # the spec methods of impls in the same file whose type begins with the name
    method = F.struct("start", F.col("method").alias("name"), "is_uninterpreted", "is_open", "has_recommends")
    of_ghost = ghosts.select("path", "name").join(spec_methods.withColumnRenamed("path", "at"), (F.col("path") == F.col("at")) & F.startswith("owner", F.col("name"))).groupBy("path", "name").agg(F.array_sort(F.collect_list(method)).alias("methods"))
    wrapped = spec_methods.where(F.contains("path", F.lit(f"/{std}/"))).withColumn("x", rust_type(F.col("owner"), F.col("path"))).where("x.rust_type is not null")
    # each method once for a type, at its first place (SE6)
    first = wrapped.groupBy("x.rust_type", "x.rust_module", "method").agg(F.min(F.struct("path", "start", "line")).alias("at"))
    types_wrapped = first.groupBy("rust_type", "rust_module").agg(F.min("at").alias("at"), F.transform(F.array_sort(F.collect_list(F.struct("at", "method"))), lambda m: m["method"]).alias("methods_wrapped"))
    by_mode = lambda mode: F.array_sort(F.collect_list(F.when(mode, F.struct("start", "name"))))
    of_trait = t["fns"].where("location.kind = 'trait'").groupBy("path", F.col("location.owner").alias("name")).agg(
        by_mode(F.col("mode") == "spec").alias("s"), by_mode(F.col("mode").isin("proof", "axiom")).alias("p"), by_mode(F.col("mode") == "exec").alias("e")
    )
    names = lambda c: F.coalesce(F.transform(c, lambda m: m["name"]), F.array().cast("array<string>"))
    w = Window.partitionBy("path").orderBy("line_no")
    item = F.regexp_replace(F.array_join(F.collect_list("text").over(w.rowsBetween(0, 49)), "\n"), r"(?s);.*$", "")
    specs = own.withColumn("item", item).withColumn("found", F.regexp_extract("text", r"assume_specification[^\[]*\[\s*([^\]]+?)\s*\]", 1)).where("found <> ''")
    specs = specs.select("path", F.col("line_no").alias("line"), F.replace("found", F.lit(" "), F.lit("")).alias("name"), F.col("item").rlike(r"\brequires\b").alias("has_requires"), F.col("item").rlike(r"\bensures\b").alias("has_ensures"))

    def matched(pattern: str, group: int) -> DataFrame:
        return own.withColumn("name", F.regexp_extract("text", pattern, group)).where("name <> ''").withColumn("line", F.col("line_no"))

    members = F.transform(F.filter(F.split(F.regexp_extract("text", r"broadcast\s+group\s+\w+\s*\{([^}]*)", 1), ","), lambda m: F.trim(m) != ""), lambda m: F.trim(m))
    const = r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:(?:spec|proof|exec)\s+)?const\s+(\w+)\s*:\s*([^=;]+)"
    aliases = path(t["types"].where("kind = 'alias'"))
    params = F.transform("generics", lambda g: g["name"]).alias("type_params")
    children = own.withColumn("child", F.regexp_extract("text", r"^\s*(?:pub\s+)?mod\s+(\w+)\s*;", 1)).where("child <> ''").groupBy("path").agg(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "child"))), lambda c: c["child"]).alias("child_modules"))
    modules = files.select("path", F.lit(1).alias("line"), F.element_at(F.split(module_of("path", root), "::"), -1).alias("name"))
    return {
        "modules": path(modules).drop("qualified_path").withColumn("qualified_path", F.concat_ws("::", F.lit(root), "module")).join(children, "path", "left").select(*key, F.coalesce("child_modules", F.array().cast("array<string>")).alias("child_modules")),
        "wrapped_rust_types": types_wrapped.select(F.col("at.path").alias("path"), F.col("at.line").alias("line"), F.col("rust_type").alias("name"), F.concat_ws("::", "rust_module", "rust_type").alias("qualified_path"), "rust_module", "methods_wrapped"),
        "ghost_types": ghosts.join(of_ghost, ["path", "name"], "left").select(*key, params, _map(GHOST_TYPES)[F.col("name")].alias("rust_equivalent"), F.coalesce("methods", F.array().cast("array<struct<start:int,name:string,is_uninterpreted:boolean,is_open:boolean,has_recommends:boolean>>")).alias("methods")),
        "tracked_types": structs.where(~is_ghost & (known_tracked | has("tracked"))).select(*key),
        "spec_functions": free.where("mode = 'spec'").select(*key, has("open").alias("is_open"), has("uninterp").alias("is_uninterpreted"), clause["recommends"], "decreases", "signature"),
        "proof_functions": free.where("mode in ('proof', 'axiom')").select(*key, F.contains("name", F.lit("lemma")).alias("is_lemma"), has("broadcast").alias("is_broadcast"), clause["requires"], clause["ensures"], "signature"),
        "exec_functions": free.where("mode = 'exec'").select(*key, *clause.values()).where("has_requires or has_ensures or has_recommends"),
        "external_specs": path(specs).select(*key, F.regexp_replace(F.element_at(F.split("name", "::"), 1), "[<>]", "").alias("external_module"), "has_requires", "has_ensures"),
        "traits": path(t["traits"]).join(of_trait, ["path", "name"], "left").select(*key, F.nullif(F.array_join("bounds", " + "), F.lit("")).alias("extends_rust_trait"), names(F.col("s")).alias("spec_methods"), names(F.col("p")).alias("proof_methods"), names(F.col("e")).alias("exec_methods")),
        "axioms": free.where(is_axiom).select(*key, axiom_category(F.col("name"), F.col("path")).alias("category"), has("broadcast").alias("is_auto_broadcast")),
        "broadcast_groups": path(matched(r"broadcast\s+group\s+(\w+)", 1)).select(*key, members.alias("members"), (F.col("name") == "group_vstd_default").alias("is_default_enabled")),
        "macros": path(matched(r"macro_rules!\s*(\w+)", 1)).select(*key, _map(MACRO_PURPOSES)[F.col("name")].alias("purpose")),
        "constants": path(matched(const, 1)).select(*key, F.trim(F.regexp_extract("text", const, 2)).alias("const_type")),
        "enums": path(t["types"].where("kind = 'enum'")).select(*key, "variants", params),
        "type_aliases": aliases.select(*key, F.col("value").alias("aliased_type"), params),
    }


def ordered(found: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The sections in the order of a report, equal keys by place (SO11)."""
    return {k: df.orderBy(ORDER[k], "path", "line") if k in ORDER else df.orderBy("path", "line") for k, df in found.items()}


def totals(found: dict[str, DataFrame]) -> DataFrame:
    """(total, n): the twenty counters of the summary (AG19)."""
    count = lambda name, df: df.agg(F.lit(name).alias("total"), F.count("*").alias("n"))
    size = lambda name, df, c: df.agg(F.lit(name).alias("total"), F.coalesce(F.sum(F.size(c)), F.lit(0)).cast("bigint").alias("n"))
    f = found
    parts = [count(f"total_{k}", f[k]) for k in f]
    parts += [
        size("total_ghost_type_methods", f["ghost_types"], "methods"), size("total_wrapped_methods", f["wrapped_rust_types"], "methods_wrapped"), count("total_lemmas", f["proof_functions"].where("is_lemma")),
        count("total_broadcast_lemmas", f["proof_functions"].where("is_broadcast")), count("total_auto_broadcast_axioms", f["axioms"].where("is_auto_broadcast")),
    ]
    return reduce(DataFrame.unionByName, parts)


def specs_by_file(external_specs: DataFrame, std: str = "std_specs") -> DataFrame:
    """By source file: specifications, and those with requires and ensures (AG17)."""
    file = F.regexp_replace("path", rf"^.*/(?={std}/)|^.*/", "")
    return external_specs.groupBy(F.replace(file, F.lit(f"{std}/"), F.lit("")).alias("file")).agg(F.count("*").alias("n"), F.count_if("has_requires").alias("n_requires"), F.count_if("has_ensures").alias("n_ensures"))


def wrapped_type_totals(external_specs: DataFrame) -> DataFrame:
    """Library totals: specifications by module, with requires, ensures or neither (AG40)."""
    return external_specs.groupBy("external_module").agg(F.count("*").alias("n"), F.count_if("has_requires").alias("n_requires"), F.count_if("has_ensures").alias("n_ensures"), F.count_if(~F.col("has_requires") & ~F.col("has_ensures")).alias("n_bare"))


def usage(spark: SparkSession, path: str) -> DataFrame:
    """(kind, name, crate_count) of a usage report in JSON (SC13)."""
    raw = spark.read.schema(USAGE_SCHEMA).option("multiLine", True).json(path)
    parts = [raw.select(F.lit(k).alias("kind"), F.inline(f"analysis.{k}.items")) for k in ("modules", "types", "traits", "methods")]
    return reduce(DataFrame.unionByName, parts)


def method_totals(methods: DataFrame) -> DataFrame:
    """(kind, name, n): methods (name) by module, core and alloc ones under std as well, and by type (AG18, J20)."""
    parts = F.split("name", "::")
    some = methods.withColumn("parts", parts).where(F.size("parts") >= 2)
    module = F.array_join(F.slice("parts", 1, 2), "::")
    names = F.array_distinct(F.array(module, F.regexp_replace(module, "^(core|alloc)::", "std::")))
    by_module = some.select(F.lit("module").alias("kind"), F.explode(names).alias("name"))
    by_type = some.where(F.size("parts") >= 3).select(F.lit("type").alias("kind"), F.element_at("parts", -2).alias("name"))
    return by_module.unionByName(by_type).groupBy("kind", "name").agg(F.count("*").alias("n"))


def builtins(files: DataFrame) -> DataFrame:
    """(kind, name, description, category) of compiler types and traits in the source of the compiler's item table (EX28)."""
    kinds = F.expr(r"""regexp_extract_all(content, r'\("verus::verus_builtin::(?:private::)?[^"]+",\s*VerusItem::Builtin(Type|Trait)', 1)""")
    names = F.expr(r"""regexp_extract_all(content, r'\("verus::verus_builtin::((?:private::)?[^"]+)",\s*VerusItem::Builtin(?:Type|Trait)', 1)""")
    found = files.select(F.explode(F.arrays_zip(kinds.alias("kind"), names.alias("name"))).alias("x")).select("x.*").where((F.col("kind") == "Trait") | ~F.contains("name", F.lit("::")))
    name = F.regexp_replace("name", "^private::", "")
    described = F.when(F.col("kind") == "Trait", F.coalesce(_map(BUILTIN_TRAITS)[name], F.lit("Verus builtin trait"))).otherwise(F.coalesce(_map({k: v[0] for k, v in BUILTIN_TYPES.items()})[name], F.lit("Verus builtin type")))
    category = F.when(F.col("kind") == "Type", F.coalesce(_map({k: v[1] for k, v in BUILTIN_TYPES.items()})[name], F.lit("other")))
    shown = F.when((F.col("kind") == "Type") & name.isin("Ghost", "Tracked"), F.concat(name, F.lit("<T>"))).otherwise(name)
    return found.select(F.lower("kind").alias("kind"), shown.alias("name"), described.alias("description"), category.alias("category")).distinct()


def of_category(axioms: DataFrame, category: str) -> DataFrame:
    """The axioms of one category; a section's names are a plain select (PR30)."""
    return axioms.where(F.col("category") == category)
