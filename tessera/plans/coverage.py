"""Usage against coverage: IR text, specified methods, fallbacks, exclusions and impact."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.joins import covered_and_gaps, fallback_lookup
from tessera.sources.files import lines

#: Types that count as library usage, in the order in which a path is searched for them.
LIBRARY_TYPES = (
    "Seq", "Set", "Map", "Multiset", "Int", "Nat", "Ghost", "Tracked", "Proof", "PCell", "PPtr", "PointsTo", "AtomicBool", "AtomicU64", "AtomicU32", "View", "DeepView",
    "Vec", "Option", "Result", "String", "Box", "Rc", "Arc", "Cell", "RefCell", "Mutex", "RwLock", "HashMap", "BTreeMap", "HashSet", "BTreeSet", "VecDeque", "LinkedList",
    "BinaryHeap", "Range", "RangeInclusive", "ControlFlow",
)
#: Full names of types that specifications name shortly.
FULL_TYPES = {
    "Vec": "alloc::vec::Vec", "Option": "core::option::Option", "Result": "core::result::Result", "Box": "alloc::boxed::Box", "Arc": "alloc::sync::Arc", "Rc": "alloc::rc::Rc",
    "HashMap": "std::collections::HashMap", "HashSet": "std::collections::HashSet", "VecDeque": "alloc::collections::VecDeque", "String": "alloc::string::String",
    "Cell": "core::cell::Cell", "RefCell": "core::cell::RefCell", "IntoIter": "alloc::vec::IntoIter", "Mutex": "std::sync::Mutex", "RwLock": "std::sync::RwLock",
}
#: Prefixes under which a type is known by another crate's name.
SAME_TYPES = {
    "std::option::": "core::option::", "std::result::": "core::result::", "std::vec::": "alloc::vec::", "std::string::": "alloc::string::",
    "std::boxed::": "alloc::boxed::", "std::sync::Arc": "alloc::sync::Arc", "std::rc::Rc": "alloc::rc::Rc",
}
#: What no wrapping is wanted for: parts of method names, parts of type names, modules.
EXCLUDED_METHODS = (
    "fmt", "write", "read", "format", "display", "debug", "to_string", "to_tokens", "from_str", "parse", "print", "flush", "seek", "stdin", "stdout", "stderr", "ffi", "path", "socket", "from_raw", "unsafe", "metadata", "env", "command",
)
EXCLUDED_TYPES = (
    "File", "Formatter", "BufRead", "BufWriter", "BufReader", "TcpStream", "TcpListener", "UdpSocket", "Socket", "SocketAddr", "Path", "PathBuf", "OsStr", "OsString", "CStr", "Stdin", "Stdout", "Stderr", "UnsafeArg", "Metadata", "SystemTime", "Instant", "Command", "Child", "Placeholder", "from_raw_parts", "from_raw_parts_mut",
)
EXCLUDED_MODULES = (
    "std::io", "std::fs", "std::net", "std::ffi", "core::ffi", "alloc::ffi", "std::process", "std::thread", "std::sync", "std::env", "std::path",
)


def normalised_type(c: Column) -> Column:
    return reduce(lambda x, kv: F.replace(x, F.lit(kv[0]), F.lit(kv[1])), SAME_TYPES.items(), c)


def full_type(c: Column) -> Column:
    known = F.create_map(*(F.lit(x) for kv in FULL_TYPES.items() for x in kv))
    return F.coalesce(known[c], F.concat(F.lit("unknown::"), c))


def ir_usage(files: DataFrame) -> DataFrame:
    """(project, owner, item) from IR text: types of called functions and of datatypes, with the method
    or null. The project is the second directory above the file; library builds are skipped."""
    roots = r'((?:vstd|alloc|core)![^"]+)"'
    both = files.select(
        F.element_at(F.split("path", "/"), -3).alias("project"),
        F.explode(F.concat(
            F.transform(F.expr(rf"""regexp_extract_all(content, r'(?<!module_id )(?<!group_id )\(Fun :path "{roots}', 1)"""), lambda p: F.struct(p.alias("p"), F.lit(True).alias("call"))),
            F.transform(F.expr(rf"""regexp_extract_all(content, r'\(Typ Datatype \(Dt Path "{roots}', 1)"""), lambda p: F.struct(p.alias("p"), F.lit(False).alias("call"))),
        )).alias("x"),
    )
    p = F.col("x.p")
    known = [F.when(F.contains(p, F.lit(f".{t}.")) | F.contains(p, F.lit(f"!{t}")) | (F.contains(p, F.lit(f".{t}")) & F.endswith(p, F.lit("."))), F.lit(t)) for t in LIBRARY_TYPES]
    segments = F.filter(F.split(p, "[.!]"), lambda s: s.rlike("^[A-Z]") & ~F.startswith(s, F.lit("Ex")) & ~F.contains(s, F.lit("impl")))
    last = F.element_at(F.filter(F.split(p, "[.!]"), lambda s: F.length(s) > 0), -1)
    owner = F.coalesce(*known, F.try_element_at(segments, F.lit(1)))
    out = both.where(~F.col("project").isin("vstd", "release")).select("project", owner.alias("owner"), F.when(F.col("x.call") & last.rlike("^[a-z_]"), last).alias("item"))
    return out.where(F.col("owner").isin(*LIBRARY_TYPES)).distinct()


def specified_methods(files: DataFrame) -> DataFrame:
    """(owner, item) that ``assume_specification[...]`` lines cover, in four spellings (EX25)."""
    head = r"assume_specification[^\[]*\[\s*"
    found = None
    for body, simple in ((r"(\w+)::<[^>]*>::(\w+)\s*\]", False), (r"(\w+)::(\w+)\s*\]", True), (r"<(\w+)<[^>]*>\s+as\s+[^>]+>::(\w+)\s*\]", False), (r"<(\w+)\s+as\s+[^>]+>::(\w+)\s*\]", False)):
        pairs = F.arrays_zip(F.expr(f"regexp_extract_all(text, r'{head}{body}', 1)").alias("t"), F.expr(f"regexp_extract_all(text, r'{head}{body}', 2)").alias("m"))
        own = lines(files).where(F.contains("text", F.lit("assume_specification"))).select(F.explode(pairs).alias("x")).select(F.col("x.t").alias("t"), F.col("x.m").alias("item"))
        own = own.where(~F.col("t").rlike("^[A-Z]{1,2}$")) if simple else own
        found = own if found is None else found.unionByName(own)
    return found.select(full_type(F.col("t")).alias("owner"), "item").distinct()


def type_coverage(usage: DataFrame, specified: DataFrame) -> DataFrame:
    """(owner, n, covered, percent of all usage): ``usage`` has (owner, n)."""
    u = usage.withColumn("owner", normalised_type(F.col("owner"))).groupBy("owner").agg(F.sum("n").alias("n"))
    covered, gaps = covered_and_gaps(u, specified.select(normalised_type(F.col("owner")).alias("owner")), "owner")
    both = covered.withColumn("covered", F.lit(True)).unionByName(gaps.withColumn("covered", F.lit(False)))
    total = u.agg(F.sum("n").alias("total"))
    return both.join(F.broadcast(total)).select("owner", "n", "covered", F.try_divide(100.0 * F.col("n"), F.col("total")).alias("percent"))


def module_status(modules: DataFrame, coverage: DataFrame) -> DataFrame:
    """(module, status): by the exact name, else with std as core, else by the last segment."""
    keys = [F.col("module"), F.regexp_replace("module", "^std::", "core::"), F.element_at(F.split("module", "::"), -1)]
    return fallback_lookup(modules.select("module"), keys, coverage, "name", "status", F.lit("missing"))


def excluded(path: Column) -> Column:
    """I/O, formatting and system items, by method, type or module (PR21, PR22)."""
    parts = F.split(path, "::")
    method, owner = F.lower(F.element_at(parts, -1)), F.coalesce(F.try_element_at(parts, F.lit(-2)), F.lit(""))
    tests = [F.contains(method, F.lit(x)) for x in EXCLUDED_METHODS] + [F.contains(owner, F.lit(x)) for x in EXCLUDED_TYPES] + [F.startswith(path, F.lit(x)) for x in EXCLUDED_MODULES]
    return reduce(or_, tests)


def exact_key(path: Column) -> Column:
    """``Type::method`` without generics (FN17, status_exact of T29)."""
    parts = F.split(F.regexp_replace(F.regexp_replace(path, "::<[^>]*>", ""), "<[^>]*>", ""), "::")
    return F.array_join(F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), 2), "::")


def impact(methods: DataFrame, least: int = 2) -> DataFrame:
    """(owner, n_methods, n_uses) of what is not excluded, for types with ``least`` methods or more (AG16)."""
    own = methods.where(~excluded(F.col("path"))).withColumn("owner", F.coalesce(F.try_element_at(F.split("path", "::"), F.lit(-2)), F.lit("")))
    return own.groupBy("owner").agg(F.count("*").alias("n_methods"), F.sum("n").alias("n_uses")).where(F.col("n_methods") >= least).orderBy(F.desc("n_uses"), "owner")
