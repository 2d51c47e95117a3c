"""The small reviewers: counts over function, type and line facts, each a plain DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.aggregates import percent_floor
from tessera.sources.files import lines

#: Parts of types that mark a comparator parameter.
COMPARATORS = ("Fn(", "FnMut(", "FnOnce(", "impl Fn", "dyn Fn", "-> bool", "-> Ordering", "-> O", "-> Option", "Pred", "Cmp", "Compare")
#: Parts of axiom names by class, in the order in which they are tried.
AXIOM_CLASSES = {
    "numeric": ("arithmetic", "div_mod", "div", "mul", "power", "logarithm", "mod_internals", "div_internals", "nat", "int", "add", "sub"),
    "set_theoretic": ("seq", "multiset", "map", "set", "to_multiset"),
}
#: String literals that hold source syntax, and variables that hold source text.
SYNTAX = ("fn ", "impl ", "trait ", "struct ", "enum ", "pub ", "use ", "mod ", "let ", "mut ", "::", "->", "=>", "spec ", "proof ", "exec ", "requires", "ensures", "decreases", "broadcast", "tracked", "ghost")
SOURCE_NAMES = ("source", "src", "code", "text", "content", "body", "line", "lines")
#: Library groups that a type's use recommends.
GROUPS = {
    "Seq": ("vstd::seq::group_seq_axioms", "vstd::seq_lib::group_seq_properties", "vstd::seq_lib::group_to_multiset_ensures"),
    "Set": ("vstd::set::group_set_axioms", "vstd::set_lib::group_set_lib_default"),
    "Map": ("vstd::map::group_map_axioms", "vstd::map_lib::group_map_lib_default"),
    "Multiset": ("vstd::multiset::group_multiset_axioms",),
}


def has_any(value: Column, parts: tuple[str, ...]) -> Column:
    return reduce(or_, (F.contains(value, F.lit(p)) for p in parts))


def count_of(pattern: str, column: str | Column = "body_text") -> Column:
    return F.regexp_count(column, F.lit(pattern))


#: Gives the columns of a fact by their names: ``F.col`` for rows of facts, ``getField`` for structs in an array.
Fact = Callable[[str], Column]


def clause_coverage(fns: DataFrame) -> DataFrame:
    """By mode: functions with requires and ensures in the header, and anywhere (AG27, T24)."""
    req, ens = F.size("requires") > 0, F.size("ensures") > 0
    return fns.groupBy("mode").agg(
        F.count("*").alias("n"), F.count_if(req).alias("requires_header"), F.count_if(ens).alias("ensures_header"), F.count_if(req & ens).alias("both"),
        F.count_if(req | F.col("body_text").rlike(r"\brequires\b")).alias("requires_anywhere"), F.count_if(ens | F.col("body_text").rlike(r"\bensures\b")).alias("ensures_anywhere"),
    )


def spec_exec_ratio(fns: DataFrame) -> DataFrame:
    """By file: spec and exec functions and their ratio, 0 without exec functions (AG28)."""
    spec, ex = F.count_if(F.col("mode") == "spec"), F.count_if(F.col("mode") == "exec")
    return fns.groupBy("path").agg(spec.alias("n_spec"), ex.alias("n_exec"), F.when(ex == 0, 0.0).otherwise(spec / ex).alias("ratio"))


def proof_coverage(fns: DataFrame) -> DataFrame:
    """By file: exec functions with proof blocks, requires and ensures (AG29)."""
    return fns.where("mode = 'exec'").groupBy("path").agg(
        F.count("*").alias("n_exec"), F.count_if("has_proof_block").alias("with_proof"), F.count_if(F.size("requires") > 0).alias("with_requires"), F.count_if(F.size("ensures") > 0).alias("with_ensures"),
        percent_floor(F.count_if("has_proof_block"), F.count("*")).alias("percent_proof"),
    )


def proof_structure(fns: DataFrame) -> DataFrame:
    """By file: proof functions, lemmas, proof blocks, assert-by (AG30)."""
    return fns.groupBy("path").agg(
        F.count_if(F.col("mode") == "proof").alias("n_proof_fns"), F.count_if(F.col("name").rlike("^lemma")).alias("n_lemmas"),
        F.sum(count_of(r"\bproof\s*\{")).alias("n_proof_blocks"), F.sum(count_of(r"\bassert\b[^;{]*\bby\b")).alias("n_assert_by"),
    )


def invariants(fns: DataFrame) -> DataFrame:
    """By file: loops and those with an invariant (AG31)."""
    return fns.groupBy("path").agg(F.sum(count_of(r"\b(?:while|for|loop)\b")).alias("n_loops"), F.sum(count_of(r"\b(?:while|for|loop)\b[^{};]*\binvariant\b")).alias("n_with_invariant"))


def datatype_invariants(types: DataFrame) -> DataFrame:
    """By file and kind: datatypes, and those with an invariant as a field or as a function (AG31)."""
    return types.where("kind in ('struct', 'enum')").groupBy("path", "kind").agg(F.count("*").alias("n"), F.count_if("has_inv_field").alias("n_with_field"), F.count_if("has_inv_fn").alias("n_with_fn"))


def is_endless(f: Fact) -> Column:
    calls = F.regexp_like(f("body_text"), F.concat(F.lit(r"\b"), f("name"), F.lit(r"\s*\(")))
    return calls & ~f("decreases")


def termination(fns: DataFrame) -> DataFrame:
    """Functions that call themselves and have no decreases clause (AG32)."""
    return fns.where(is_endless(F.col)).select("path", "line", "name", "mode")


def is_view(f: Fact) -> Column:
    return f("trait_name").isin("View", "DeepView")


def base_type(f: Fact) -> Column:
    return F.regexp_replace(f("for_type"), r"<.*$", "")


def is_datatype(f: Fact) -> Column:
    return f("kind").isin("struct", "enum")


def view_coverage(types: DataFrame, impls: DataFrame) -> DataFrame:
    """Types with an impl of View in their file (AG33)."""
    views = impls.where(is_view(F.col)).select("path", base_type(F.col).alias("name")).distinct().withColumn("has_view", F.lit(True))
    return types.where(is_datatype(F.col)).join(views, ["path", "name"], "left").select("path", "line", "name", F.coalesce("has_view", F.lit(False)).alias("has_view"))


def triggers(files: DataFrame) -> DataFrame:
    """By file: quantifiers, and those with ``triggers`` or a trigger attribute in the same line (AG34, T17)."""
    own = lines(files)
    quantified = F.regexp_count("text", F.lit(r"\b(?:forall|exists)\s*\|"))
    return own.groupBy("path").agg(F.sum(quantified).alias("n_quantifiers"), F.sum(F.when(F.col("text").rlike(r"\btriggers\b|#!?\[trigger"), quantified).otherwise(0)).alias("n_with_triggers"))


def broadcast_use(files: DataFrame, top: int = 10) -> DataFrame:
    """The broadcast groups that are used most, of equals the least name (AG35, AG20)."""
    uses = files.select("path", F.explode(F.expr(r"regexp_extract_all(content, r'broadcast\s+use\s*\{?([^;}]+)[;}]', 1)")).alias("names"))
    each = uses.select("path", F.explode(F.split("names", ",")).alias("name")).select("path", F.trim("name").alias("name")).where("name <> ''")
    return each.groupBy("name").agg(F.count("*").alias("n"), F.countDistinct("path").alias("n_files")).orderBy(F.desc("n"), "name").limit(top)


def ghost_naming(files: DataFrame) -> DataFrame:
    """Ghost and tracked variables whose names do not say so (AG36, PR27)."""
    found = lines(files).select("path", "line_no", F.regexp_extract("text", r"\blet\s+(ghost|tracked)\s+(?:mut\s+)?(\w+)", 1).alias("kind"), F.regexp_extract("text", r"\blet\s+(ghost|tracked)\s+(?:mut\s+)?(\w+)", 2).alias("name"))
    fine = F.startswith("name", F.lit("_")) | F.contains(F.col("name"), F.col("kind"))
    return found.where((F.col("kind") != "") & ~fine)


def is_impure(f: Fact) -> Column:
    outside = F.regexp_replace(f("body_text"), r"proof\s*\{[^{}]*\}", "")
    return (f("mode") == "exec") & outside.rlike(r"\b(?:old|forall|exists)\b")


def exec_purity(fns: DataFrame) -> DataFrame:
    """Exec functions that use specification words outside proof blocks (AG37); signs are never found."""
    return fns.where(is_impure(F.col)).select("path", "line", "name")


def axiom_class(name: Column) -> Column:
    """Classes by substrings in order, so hint is numeric for its int (FN13, T15)."""
    out, low = None, F.lower(name)
    for kind, parts in AXIOM_CLASSES.items():
        out = F.when(has_any(low, parts), kind) if out is None else out.when(has_any(low, parts), kind)
    return out.otherwise("machine")


def axioms(fns: DataFrame, library: str = "/vstd/") -> DataFrame:
    """(name, class, in_library, n): each axiom name once, by its class (EX23, AG21, AG41, T13)."""
    own = fns.where(F.array_contains("modifiers", "axiom") | F.col("name").rlike("^axiom_"))
    return own.groupBy("name").agg(F.count("*").alias("n"), F.bool_or(F.contains("path", F.lit(library))).alias("in_library")).withColumn("class", axiom_class(F.col("name")))


def takes_comparator(f: Fact) -> Column:
    return F.exists(f("args"), lambda a: has_any(a["ty"], COMPARATORS))


def n_operators(f: Fact) -> Column:
    return count_of(r"==|!=|<=|>=", f("body_text"))


def comparators(fns: DataFrame) -> DataFrame:
    """Functions with comparator parameters and the comparisons in their bodies (EX36)."""
    return fns.where(takes_comparator(F.col)).select("path", "line", "name", n_operators(F.col).alias("n_operators"))


def has_equality(f: Fact) -> Column:
    return F.exists(f("generics"), lambda g: F.exists(g["bounds"], lambda b: b.rlike(r"\b(?:Partial)?Eq\b")))


def generic_equality(fns: DataFrame) -> DataFrame:
    """Functions with an equality bound and their ``==`` and ``!=``, at their own line (EX35, T20)."""
    return fns.where(has_equality(F.col)).select("path", "line", "name", count_of("==").alias("n_eq"), count_of("!=").alias("n_ne"))


def function_reviews(files: DataFrame) -> DataFrame:
    """(what, path, line, name, detail): :func:`termination`, :func:`exec_purity`, :func:`comparators`,
    :func:`generic_equality` and :func:`view_coverage` of ``files``, from one pass over them and without a
    shuffle, as all that a review needs lies in one file. A path stands in one row of ``files``."""
    from tessera.operators.extract import facts_by_file

    own = facts_by_file(files, fns=("line", "name", "mode", "generics", "args", "body_text", "decreases"), types=("line", "kind", "name"), impls=("trait_name", "for_type"))

    def told(f: Fact, what: str, detail: Column) -> Column:
        return F.struct(F.lit(what).alias("what"), f("line").alias("line"), f("name").alias("name"), detail.alias("detail"))

    def of_function(x: Column) -> Column:
        f = x.getField
        found = (
            F.when(is_endless(f), told(f, "termination", f("mode"))), F.when(is_impure(f), told(f, "purity", F.lit(""))), F.when(takes_comparator(f), told(f, "comparator", n_operators(f).cast("string"))),
            F.when(has_equality(f), told(f, "equality", F.concat_ws(" ", count_of("==", f("body_text")), count_of("!=", f("body_text"))))),
        )
        return F.array_compact(F.array(*found))

    viewed = F.transform(F.filter("impls", lambda x: is_view(x.getField)), lambda x: base_type(x.getField))
    datatypes = F.filter("types", lambda x: is_datatype(x.getField))
    views = F.transform(datatypes, lambda x: told(x.getField, "view", F.array_contains(F.col("viewed"), x["name"]).cast("string")))
    rows = own.withColumn("viewed", viewed).select("path", F.explode(F.concat(F.flatten(F.transform("fns", of_function)), views)).alias("row"))
    return rows.select("row.what", "path", "row.line", "row.name", "row.detail")


def default_methods(traits: DataFrame) -> DataFrame:
    """By file: traits, methods and default methods, files without any included (EX34, AG44, T19)."""
    return traits.groupBy("path").agg(F.count("*").alias("n_traits"), F.sum(F.size("body_methods")).alias("n_methods"), F.sum("n_default").alias("n_default"))


def string_manipulation(files: DataFrame) -> DataFrame:
    """Calls that search source text for syntax instead of a parse tree (EX37, PR26)."""
    call = r"(\w+)\s*\.\s*(?:contains|find|replace|split|starts_with|ends_with|trim_start_matches)\s*\(\s*\"([^\"]*)\""
    found = lines(files).select("path", "line_no", F.regexp_extract("text", call, 1).alias("receiver"), F.regexp_extract("text", call, 2).alias("literal"))
    return found.where((F.length("receiver") > 1) & (has_any(F.col("literal"), SYNTAX) | F.col("receiver").isin(*SOURCE_NAMES)))


def recommended_groups(files: DataFrame) -> DataFrame:
    """(path, group) that a file's types recommend and that it does not use yet (J15, EX32, EX33)."""
    known = F.create_map(*(x for t, gs in GROUPS.items() for x in (F.lit(t), F.array(*map(F.lit, gs)))))
    used = files.select("path", F.explode(F.array_distinct(F.expr(r"regexp_extract_all(content, r'\b(Seq|Set|Map|Multiset)\b', 1)"))).alias("t"))
    wanted = used.select("path", F.explode(known[F.col("t")]).alias("group")).distinct()
    have = files.select("path", F.explode(F.expr(r"regexp_extract_all(content, r'(vstd(?:::\w+)+::group_\w+)', 1)")).alias("group")).distinct()
    return wanted.join(have, ["path", "group"], "left_anti")


def wrapped_methods(files: DataFrame) -> DataFrame:
    """(path, line_no, method, wrapper, has_requires, has_ensures): specifications with the most recent
    wrapped type above them, and their clauses up to the end of the item (EX26, J17, AG40)."""
    own = lines(files)
    w = Window.partitionBy("path").orderBy("line_no")
    wrapper = F.nullif(F.regexp_extract("text", r"pub\s+struct\s+(\w+).*?\(([^)]+)\)", 1), F.lit(""))
    method = F.nullif(F.trim(F.regexp_extract("text", r"pub\s+assume_specification.*?\[\s*([^\]]+)\s*\]", 1)), F.lit(""))
    ahead = F.array_join(F.collect_list("text").over(w.rowsBetween(0, 49)), "\n")
    rows = own.withColumn("wrapper", F.last(wrapper, ignorenulls=True).over(w)).withColumn("method", method).withColumn("item", F.regexp_replace(ahead, r"(?s);.*$", ""))
    return rows.where(F.col("method").isNotNull()).select("path", "line_no", "method", "wrapper", F.col("item").rlike(r"\brequires\b").alias("has_requires"), F.col("item").rlike(r"\bensures\b").alias("has_ensures"))


def unused_spec_fns(fns: DataFrame, tokens: DataFrame) -> DataFrame:
    """Names of spec functions that no file uses, over all types that define the name (J18, AG38)."""
    spec = fns.where("mode = 'spec'").groupBy("name").agg(F.count("*").alias("n_defined"))
    seen = tokens.where("kind = 'word'").groupBy(F.col("text").alias("name")).agg(F.count("*").alias("n_seen"))
    return spec.join(seen, "name", "left").where(F.coalesce("n_seen", F.lit(0)) <= F.col("n_defined")).select("name", "n_defined")


def state(n_verified: Column, n_ported: Column, n_gated: Column) -> Column:
    """Empty, Blocked, Ported, Verified or Partial from a directory's counts (AG24)."""
    total = n_verified + n_ported + n_gated
    return F.when(total == 0, "Empty").when(n_gated == total, "Blocked").when(n_ported == total, "Ported").when(n_verified == total, "Verified").when(n_verified > 0, "Partial").otherwise("Blocked")


def comment_blocks(files: DataFrame) -> DataFrame:
    """Runs of comment lines: path, first, last, n (W6, ED4)."""
    from tessera.operators.windows import islands

    return islands(lines(files).where(F.trim("text").rlike("^//")), ["path"], "line_no")


def import_groups(files: DataFrame) -> DataFrame:
    """Imports by root, whether they are contiguous and followed by a blank line (W10, rules 4 to 8)."""
    own = lines(files).withColumn("root", F.nullif(F.regexp_extract("text", r"^\s*use\s+(\w+)::", 1), F.lit("")))
    w = Window.partitionBy("path").orderBy("line_no")
    following = own.withColumn("next", F.lead("text").over(w)).where(F.col("root").isNotNull())
    return following.groupBy("path", "root").agg(
        F.min("line_no").alias("first"), F.max("line_no").alias("last"), F.count("*").alias("n"), (F.max("line_no") - F.min("line_no") + 1 == F.count("*")).alias("contiguous"),
        F.max_by(F.coalesce(F.trim("next") == "", F.lit(True)), "line_no").alias("blank_after"),
    )


#: Functions that reports leave out unless told otherwise (PR17).
IGNORED_FUNCTIONS = ("clone", "into_iter", "fmt")
#: Findings that are errors of style, not holes (PR20).
STYLE_ERRORS = ("fn_missing_requires", "fn_missing_ensures", "fn_missing_requires_ensures")


def reported(fns: DataFrame, ignored: tuple[str, ...] = IGNORED_FUNCTIONS) -> DataFrame:
    """Functions of a report, by directory and then file (PR17, SO10)."""
    kept = fns.where(~F.col("name").isin(*ignored)) if ignored else fns
    return kept.orderBy(F.regexp_replace("path", "/[^/]*$", ""), F.regexp_extract("path", r"([^/]*?)(?:\.[^./]*)?$", 1), "line")


def style_errors(findings: DataFrame) -> DataFrame:
    """Findings with is_style_error and is_warning (PR20)."""
    return findings.withColumn("is_style_error", F.col("hole_type").isin(*STYLE_ERRORS)).withColumn("is_warning", F.col("hole_type").isin("assume_eq_clone_workaround", "requires_true"))


def trivial_specs(fns: DataFrame) -> DataFrame:
    """Spec functions whose body is ``true`` or ``false``, whatever their names and types (EX22)."""
    return fns.where("mode = 'spec'").withColumn("body", F.trim("body_text")).where("body in ('true', 'false')").select("path", "line", "name", "body")


def without_spec(fns: DataFrame) -> DataFrame:
    """Exec functions without requires and ensures, and whether they are external (EX22)."""
    external = F.array_join("attributes", " ").rlike(r"\bexternal_body\b")
    return fns.where("mode = 'exec' and size(requires) = 0 and size(ensures) = 0").select("path", "line", "name", external.alias("is_external"))


def collection_evidence(types: DataFrame, impls: DataFrame) -> DataFrame:
    """(path, name, by_view, by_field, by_name): what speaks for a type being a collection: a view that is one,
    a field that is one, or its name (EX40)."""
    base = F.regexp_replace("for_type", r"<.*$", "")
    viewed = impls.where("trait_name = 'View'").where(F.col("body_text").rlike(r"type\s+V\s*=\s*(?:Seq|Set|Map|Multiset)\b")).select("path", base.alias("name")).distinct().withColumn("by_view", F.lit(True))
    own = types.where("kind = 'struct'").join(viewed, ["path", "name"], "left")
    field = F.exists("field_types", lambda f: f.rlike(r"\b(?:Vec|VecDeque|HashMap|HashSet|BTreeMap|BTreeSet|LinkedList|Seq|Set|Map|Multiset)\s*<"))
    named = F.col("name").rlike(r"(?:Seq|Set|Map|Table|List|Tree|Heap|Queue|Stack|Graph)") & ~F.col("name").rlike(r"(?:Iter|Node|Entry|Error)")
    return own.select("path", "line", "name", F.coalesce("by_view", F.lit(False)).alias("by_view"), field.alias("by_field"), named.alias("by_name"))


def experiments(files: DataFrame) -> DataFrame:
    """(path, line_no, module, hypothesis, result): of each ``mod`` line, commented out or not, what the
    comments right above it say; of several the uppermost (EX45)."""
    own = lines(files)
    trimmed = F.trim("text")
    is_comment = F.startswith(trimmed, F.lit("//"))
    module = F.nullif(F.regexp_extract("text", r"^\s*(?://\s*)?(?:pub\s+)?mod\s+(\w+)", 1), F.lit(""))
    w = Window.partitionBy("path").orderBy("line_no")
    # a block of comments ends at any other line that is not empty
    block = F.sum(F.when(~is_comment & (trimmed != ""), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, -1))
    said = lambda word: F.nullif(F.trim(F.regexp_extract(F.when(is_comment, F.substring(trimmed, 3, 1 << 30)), rf"(?i){word}:\s*(.+)", 1)), F.lit(""))
    rows = own.withColumn("module", module).withColumn("block", F.coalesce(block, F.lit(0))).withColumn("h", said("hypothesis")).withColumn("r", said("result"))
    above = Window.partitionBy("path", "block").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("hypothesis", F.first("h", ignorenulls=True).over(above)).withColumn("result", F.first("r", ignorenulls=True).over(above)).where("module is not null").select("path", "line_no", "module", "hypothesis", "result")


def test_counts(files: DataFrame) -> DataFrame:
    """(path, n_tests, n_macros): ``#[test]`` attributes and macro calls, comments and strings left out (EX43)."""
    from tessera.operators.extract import facts

    toks = facts(files, "tokens", "idx", "kind", "text")
    w = Window.partitionBy("path").orderBy("idx")
    ahead = [F.lead("text", i).over(w) for i in (1, 2, 3)]
    test = (F.col("text") == "#") & (ahead[0] == "[") & (ahead[1] == "test") & (ahead[2] == "]")
    macro = (F.col("kind") == "word") & (ahead[0] == "!") & ahead[1].isin("(", "[", "{")
    return toks.withColumn("t", test).withColumn("m", macro).groupBy("path").agg(F.count_if("t").alias("n_tests"), F.count_if("m").alias("n_macros"))


def comment_patterns(files: DataFrame) -> DataFrame:
    """(module, patterns): loop patterns named in comments, in the order in which a module's files name them,
    files of ``ProveX`` counting for X (AG43, EX43)."""
    stem = F.regexp_extract("path", r"([^/]*?)(?:\.[^./]*)?$", 1)
    word = F.regexp_extract(F.trim("text"), r"^// +((?:loop|for)-[^\s:]*)", 1)
    found = lines(files).withColumn("stem", stem).withColumn("pattern", word).where("pattern <> '' and stem not in ('mod', 'common')").withColumn("module", F.regexp_replace("stem", "^Prove", ""))
    first = found.groupBy("module", "pattern").agg(F.min(F.struct("path", "line_no")).alias("at"))
    return first.groupBy("module").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "pattern"))), lambda x: x["pattern"]).alias("patterns"))


def dependency_blockers(held: DataFrame) -> DataFrame:
    """(path, chapter, blocker, is_external) of (path, module) dependencies: whether the holed module lies in
    the file's own chapter (J22), and once for each chapter."""
    chapter = F.regexp_extract("path", r"/src/([^/.]+)", 1)
    other = F.element_at(F.split("module", "::"), 1)
    return held.select(chapter.alias("chapter"), F.col("module").alias("blocker"), (other != chapter).alias("is_external")).distinct()


def top_directories(status: DataFrame) -> DataFrame:
    """(project, directory, n_files, n_holes, clean): by the first directory below src (AG3, J9)."""
    top = F.regexp_extract("path", r"/src/([^/]+)/", 1)
    return status.groupBy("project", top.alias("directory")).agg(F.count("*").alias("n_files"), F.sum("n_holes").alias("n_holes"), (F.count_if("is_holed") == 0).alias("clean"))
