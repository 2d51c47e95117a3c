"""Queries that run the extractors, the search, the audit, the style rules and the reviewers over the
tree of :mod:`tessera.plans.generated`, whole; their SQL tells the expected rows from the keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.lineage import cut
from tessera.operators import edits, fixes
from tessera.operators.extract import comments, dependencies, facts, path_lines
from tessera.plans import audit, coverage, inventory, minimize, reviews, style, triggers
from tessera.plans.generated import FILES_SQL, FINDINGS_SQL, FNS_SQL, LIBRARY_SQL, LINES_SQL, library, sources
from tessera.plans.registry import query
from tessera.plans.search import fact_tables, search
from tessera.sources.files import lines, markdown_table, scanned, spans_of_paths, usage_log
from tessera.sources.projects import commented_modules, gated_modules, kind_of, loc_rollup, module_files, projects



def wide(df: DataFrame) -> DataFrame:
    """Line numbers as long, as SQL has them."""
    return df.withColumns({c: F.col(c).cast("bigint") for c in ("line", "end_line", "line_no") if c in df.columns})


# -- extractors


@query(f"WITH {FNS_SQL} SELECT * EXCLUDE (k, project) FROM fns")
def src_functions(spark, sf_dir):
    """Functions with location, clauses, flags and line ranges (EX1, EX2, EX9, EX10, EX12, EX13, FN8, FN10, FN12, FN15, W8)."""
    return wide(facts(sources(spark, sf_dir), "fns").select(
        "path", "line", "end_line", "name", "visibility", "mode", F.array_join("modifiers", " ").alias("modifiers"), F.size("generics").alias("n_generics"),
        F.array_join(F.transform("args", lambda a: F.concat(a["name"], F.lit("="), a["ty"])), " ").alias("args"), F.coalesce("return_type", F.lit("")).alias("return_type"),
        F.size("requires").alias("n_requires"), F.size("ensures").alias("n_ensures"), "has_assume", "has_assert", "has_proof_block", "location.kind", "location.owner", "in_block",
    ))


@query(f"""WITH {FILES_SQL}
SELECT path, pad + 16 AS line, 'impl' AS kind, 'S' || (k % 9) || '<T>' AS name, 'R' || (k % 10) AS detail, 1 AS n, false AS flag FROM files
UNION ALL SELECT path, pad + 19, 'impl', 'E' || (k % 4), CASE WHEN k % 3 = 0 THEN 'Send' ELSE '' END, CASE WHEN k % 3 = 0 THEN 0 ELSE 1 END, k % 3 = 0 FROM files
UNION ALL SELECT path, pad + 34, 'impl', CASE WHEN k % 4 = 1 THEN 'E1' ELSE 'S' || (k % 9) || '<u8>' END, CASE k % 4 WHEN 0 THEN 'Debug' WHEN 1 THEN 'RwLockPredicate' ELSE 'View' END, CASE WHEN k % 4 = 0 THEN 0 ELSE 1 END, false FROM files WHERE k % 4 < 3
UNION ALL SELECT path, pad + 39, 'struct', 'Out', 'u8', 0, true FROM files WHERE k % 4 = 1 UNION ALL SELECT path, pad + 39, 'enum', 'Oe', '', 0, false FROM files WHERE k % 4 = 0
UNION ALL SELECT path, pad + 12, 'trait', 'R' || (k % 10), 'R' || (k % 10 + 1) || ' + Sized', 2, true FROM files
UNION ALL SELECT path, pad + 8, 'struct', 'S' || (k % 9), 'u64 Seq<T>', 1, k % 6 = 0 FROM files
UNION ALL SELECT path, pad + 9, 'enum', 'E' || (k % 4), 'u32 Set<nat>', 0, false FROM files
UNION ALL SELECT path, pad + 10, 'alias', 'T' || (k % 8), 'T' || (k % 8 + 1) || '<u8>', 0, false FROM files""")
def src_items(spark, sf_dir):
    """Impls, traits, structs, enums and aliases with members (EX3, EX4, EX5, EX6, EX7, EX8, EX34)."""
    files = sources(spark, sf_dir)
    return wide(reduce(DataFrame.unionByName, (
        facts(files, "impls").select("path", "line", F.lit("impl").alias("kind"), F.col("for_type").alias("name"), F.coalesce("trait_name", F.lit("")).alias("detail"), F.size("body_methods").alias("n"), F.col("is_unsafe").alias("flag")),
        facts(files, "traits").select("path", "line", F.lit("trait").alias("kind"), "name", F.array_join("bounds", " + ").alias("detail"), F.size("body_methods").alias("n"), (F.col("n_default") == 1).alias("flag")),
        facts(files, "types").select("path", "line", "kind", "name", F.array_join("field_types", " ").alias("detail"), F.size("generics").alias("n"), (F.size("attributes") > 0).alias("flag")),
    )))


@query(f"""WITH {FILES_SQL}, f AS (SELECT *, 7 - k % 2 - CASE WHEN k % 3 = 0 THEN 0 ELSE 1 END AS own FROM files),
l AS (SELECT path, project, 3 + CASE WHEN k % 4 IN (1, 2) THEN 1 ELSE 0 END + CASE WHEN k % 3 = 0 THEN own ELSE 0 END AS spec, 2 + CASE WHEN k % 3 = 1 THEN own + 1 ELSE 0 END AS proof,
 3 + CASE WHEN k % 3 = 2 THEN own + 1 ELSE 0 END AS exec, 5 + CASE k % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 0 END AS rust, pad + 39 AS total FROM f)
SELECT project, 'src' AS dir_kind, true AS verified, count(*) AS n_files, sum(spec)::BIGINT AS spec, sum(proof)::BIGINT AS proof, sum(exec)::BIGINT AS exec, sum(rust)::BIGINT AS rust, sum(total)::BIGINT AS total FROM l GROUP BY project""")
def src_loc_rollup(spark, sf_dir):
    """Lines of code by class, rolled up by project and kind of directory (EX44, PR23, AG22, AG23, SC8)."""
    files = sources(spark, sf_dir)
    return loc_rollup(facts(files, "loc"), files)


@query(f"""WITH {LINES_SQL} SELECT path, line_no, text, CASE WHEN starts_with(trim(text), '///') THEN 'doc' WHEN starts_with(trim(text), '//!') THEN 'inner' ELSE 'plain' END AS kind FROM lines WHERE starts_with(trim(text), '//')""")
def src_comments(spark, sf_dir):
    """Line comments with their kind (EX41)."""
    return wide(comments(sources(spark, sf_dir)))


@query(f"""WITH {FILES_SQL} SELECT path, 'Chap' || (k % 7) || '::m' || ((k * 3) % 100) AS dep FROM files UNION ALL SELECT path, 'g' FROM files""")
def src_dependencies(spark, sf_dir):
    """Dependencies on modules of the crate, accepted ones left out (EX21, SE4, FN6)."""
    return dependencies(sources(spark, sf_dir))


# -- search

@query(f"""WITH {FNS_SQL}
SELECT 'proof fn f_0' AS pattern, path, line, 'fn' AS kind, name, 'direct' AS how FROM fns WHERE starts_with(name, 'f_0_') AND mode = 'proof'
UNION ALL SELECT 'fn lemma_.*_len ensures forall', path, line, 'fn', name, 'direct' FROM fns WHERE starts_with(name, 'lemma_')
UNION ALL SELECT 'fn _ types seq!', path, line, 'fn', name, 'direct' FROM fns WHERE starts_with(name, 'f_') OR name = 'view'
UNION ALL SELECT 'fn generics Eq -> bool requires len', path, line, 'fn', name, 'direct' FROM fns WHERE n_generics = 1 AND n_requires = 1
UNION ALL SELECT 'open spec fn \\(inv\\|view\\)', path, line, 'fn', name, 'direct' FROM fns WHERE name IN ('inv', 'view') AND modifiers = 'open spec'
UNION ALL SELECT 'fn rec_1 args u64', path, line, 'fn', name, 'direct' FROM fns WHERE name = 'rec_1'
UNION ALL SELECT 'assume fn _', path, line, 'fn', name, 'direct' FROM fns WHERE has_assume
UNION ALL SELECT 'holes', path, line, 'fn', name, 'direct' FROM fns WHERE has_assume
UNION ALL SELECT 'holes', path, pad + 19, 'impl', 'E' || (k % 4), 'direct' FROM files WHERE k % 3 = 0
UNION ALL SELECT 'impl R4 for S4', path, pad + 16, 'impl', 'S' || (k % 9) || '<T>', 'direct' FROM files WHERE k % 10 = 4 AND k % 9 = 4
UNION ALL SELECT 'impl _ for E1', path, pad + 19, 'impl', 'E' || (k % 4), 'direct' FROM files WHERE k % 4 = 1
UNION ALL SELECT 'impl _ for E1', path, pad + 34, 'impl', 'E1', 'direct' FROM files WHERE k % 4 = 1
UNION ALL SELECT 'impl View {{ fn view -> Seq ; }}', path, pad + 34, 'impl', 'S' || (k % 9) || '<u8>', 'direct' FROM files WHERE k % 4 = 2
UNION ALL SELECT 'trait _ : R5', path, pad + 12, 'trait', 'R' || (k % 10), CASE WHEN k % 10 = 4 THEN 'direct' ELSE 'transitive' END FROM files WHERE k % 10 < 5
UNION ALL SELECT 'trait R7', path, pad + 12, 'trait', 'R' || (k % 10), 'direct' FROM files WHERE k % 10 = 7
UNION ALL SELECT 'type _ = T8', path, pad + 10, 'type', 'T' || (k % 8), CASE WHEN k % 8 = 7 THEN 'direct' ELSE 'transitive' END FROM files
UNION ALL SELECT 'struct S3 {{ : Seq }}', path, pad + 8, 'struct', 'S' || (k % 9), 'direct' FROM files WHERE k % 9 = 3
UNION ALL SELECT '#[derive(Clone)] struct _', path, pad + 8, 'struct', 'S' || (k % 9), 'direct' FROM files WHERE k % 6 = 0
UNION ALL SELECT '#[derive(Clone)] struct _', path, pad + 39, 'struct', 'Out', 'direct' FROM files WHERE k % 4 = 1
UNION ALL SELECT 'enum E2', path, pad + 9, 'enum', 'E' || (k % 4), 'direct' FROM files WHERE k % 4 = 2
UNION ALL SELECT 'def \\(R2\\|E2\\)', path, pad + 9, 'enum', 'E' || (k % 4), 'direct' FROM files WHERE k % 4 = 2
UNION ALL SELECT 'def \\(R2\\|E2\\)', path, pad + 12, 'trait', 'R' || (k % 10), 'direct' FROM files WHERE k % 10 = 2""")
def src_search(spark, sf_dir):
    """Patterns over all fact tables, bounds and aliases through their closures (PR1-PR15, J5, SE1, T1, T3, T4, SO8)."""
    patterns = (
        "proof fn f_0", "fn lemma_.*_len ensures forall", "fn _ types seq!", "fn generics Eq -> bool requires len", "open spec fn \\(inv\\|view\\)", "fn rec_1 args u64", "assume fn _", "holes", "impl R4 for S4",
        "impl _ for E1", "impl View { fn view -> Seq ; }", "trait _ : R5", "trait R7", "type _ = T8", "struct S3 { : Seq }", "#[derive(Clone)] struct _", "enum E2", "def \\(R2\\|E2\\)",
    )
    files = sources(spark, sf_dir)
    tables = fact_tables(files)
    return wide(reduce(DataFrame.unionByName, (search(files, p, tables).select(F.lit(p).alias("pattern"), "path", "line", "kind", "name", "how") for p in patterns)))


# -- the audit


@query(f"WITH {FINDINGS_SQL} SELECT path, line, severity, hole_type FROM findings")
def src_findings(spark, sf_dir):
    """Every finding of the proof-hole audit (EX14, EX16, EX17, EX18, EX19, EX20, J6, PR18, FN16, T28)."""
    return wide(facts(sources(spark, sf_dir), "findings").select("path", "line", "severity", "hole_type"))


@query(f"""WITH {FINDINGS_SQL} SELECT project, path, count(*) AS n_files, count(*) FILTER (WHERE NOT is_holed) AS n_clean, sum(n_holes)::BIGINT AS n_holes, sum(n_errors)::BIGINT AS n_errors,
floor(count(*) FILTER (WHERE NOT is_holed) * 100 / count(*))::BIGINT AS percent_clean, grouping(project, path)::BIGINT AS level FROM status GROUP BY ROLLUP (project, path)""")
def src_audit_rollup(spark, sf_dir):
    """Holes from file to project to all (AG1, AG2, AG4, AG5, AG7)."""
    files = sources(spark, sf_dir)
    return audit.rollup(audit.file_status(facts(files, "findings"), files))


@query(f"""WITH {FINDINGS_SQL}, d AS (SELECT f.path, h.module, f.k AS own FROM status f JOIN status h ON h.is_holed AND h.k = (f.k * 3) % 100 AND h.k % 7 = f.k % 7 AND h.k <> f.k)
SELECT 'dependency' AS what, path, module AS detail, 0 AS n FROM d UNION ALL SELECT 'target', path, module, n_holes FROM status WHERE is_holed AND k NOT IN (SELECT own FROM d)""")
def src_audit_targets(spark, sf_dir):
    """Dependencies on holed modules, and the holed files that have none (J7, J8, SO6, SO7, FN4)."""
    files = sources(spark, sf_dir)
    status = audit.file_status(facts(files, "findings"), files)
    held = audit.holed_dependencies(status, files).select(F.lit("dependency").alias("what"), "path", F.col("module").alias("detail"), F.lit(0).cast("bigint").alias("n"))
    return held.unionByName(audit.next_targets(status, files).select(F.lit("target").alias("what"), "path", F.col("module").alias("detail"), F.col("n_holes").alias("n")))


# -- reviewers


@query(f"""WITH {FNS_SQL} SELECT mode, count(*) AS n, count(*) FILTER (WHERE n_requires > 0) AS requires_header, count(*) FILTER (WHERE n_ensures > 0) AS ensures_header, count(*) FILTER (WHERE n_requires > 0 AND n_ensures > 0) AS both,
count(*) FILTER (WHERE n_requires > 0) AS requires_anywhere, count(*) FILTER (WHERE n_ensures > 0) AS ensures_anywhere FROM fns GROUP BY mode""")
def src_clauses(spark, sf_dir):
    """Requires and ensures by mode (AG27, T24)."""
    return reviews.clause_coverage(facts(sources(spark, sf_dir), "fns", "mode", "requires", "ensures", "body_text"))


@query(f"""WITH {FNS_SQL}, a AS (SELECT path, count(*) FILTER (WHERE mode = 'spec') AS n_spec, count(*) FILTER (WHERE mode = 'exec') AS n_exec, count(*) FILTER (WHERE mode = 'exec' AND has_proof_block) AS with_proof,
 count(*) FILTER (WHERE mode = 'exec' AND n_requires > 0) AS with_requires, count(*) FILTER (WHERE mode = 'exec' AND n_ensures > 0) AS with_ensures, count(*) FILTER (WHERE mode = 'proof') AS n_proof_fns,
 count(*) FILTER (WHERE starts_with(name, 'lemma')) AS n_lemmas, count(*) FILTER (WHERE has_proof_block) AS n_proof_blocks, count(*) FILTER (WHERE has_assert) AS n_assert_by FROM fns GROUP BY path)
SELECT *, n_spec / n_exec AS ratio, floor(with_proof * 100 / n_exec)::BIGINT AS percent_proof FROM a""")
def src_proof_metrics(spark, sf_dir):
    """Ratios, proof coverage and proof structure by file (AG28, AG29, AG30, T17)."""
    fns = facts(sources(spark, sf_dir), "fns")
    return reviews.spec_exec_ratio(fns).join(reviews.proof_coverage(fns).drop("n_exec"), "path").join(reviews.proof_structure(fns), "path")


@query(f"""WITH {FNS_SQL} SELECT 'termination' AS what, path, line, name, mode AS detail FROM fns WHERE starts_with(name, 'rec_')
UNION ALL SELECT 'purity', path, line, name, '' FROM fns WHERE name = 'main_0' UNION ALL SELECT 'comparator', path, line, name, '1' FROM fns WHERE name = 'outside'
UNION ALL SELECT 'equality', path, line, name, '1 0' FROM fns WHERE n_generics = 1 UNION ALL SELECT 'view', path, pad + 8, 'S' || (k % 9), CASE WHEN k % 4 = 2 THEN 'true' ELSE 'false' END FROM files
UNION ALL SELECT 'view', path, pad + 9, 'E' || (k % 4), 'false' FROM files UNION ALL SELECT 'view', path, pad + 39, CASE WHEN k % 4 = 1 THEN 'Out' ELSE 'Oe' END, 'false' FROM files WHERE k % 4 < 2""")
def src_function_reviews(spark, sf_dir):
    """Recursion without a measure, impure exec functions, comparators, generic equality, views (AG32, AG33, AG37, EX35, EX36, T16, T20)."""
    return wide(reviews.function_reviews(sources(spark, sf_dir)))


@query(f"""WITH {FNS_SQL} SELECT name, count(*) AS n, false AS in_library, CASE WHEN contains(name, 'mul') THEN 'numeric' WHEN contains(name, 'seq') THEN 'set_theoretic' ELSE 'machine' END AS class FROM fns WHERE mode = 'axiom' GROUP BY name""")
def src_axioms(spark, sf_dir):
    """Axioms once by name, with their classes (EX23, FN13, AG21, AG41, T13-T15)."""
    return reviews.axioms(facts(sources(spark, sf_dir), "fns", "name", "modifiers"))


@query(f"""WITH {LINES_SQL} SELECT 'ghost' AS what, path, line_no, 'ghost abc' AS detail FROM lines WHERE contains(text, 'let ghost abc')
UNION ALL SELECT 'lint', path, line_no, 'text fn ' FROM lines WHERE contains(text, 'text.replace("fn "')
UNION ALL SELECT 'group', path, 0, unnest(['vstd::seq_lib::group_seq_properties', 'vstd::seq_lib::group_to_multiset_ensures', 'vstd::set::group_set_axioms', 'vstd::set_lib::group_set_lib_default']) FROM files
UNION ALL SELECT 'import', path, pad + 2, 'vstd 1 true false' FROM files UNION ALL SELECT 'import', path, pad + 3, CASE WHEN k % 5 = 0 THEN 'crate 1 true false' ELSE 'crate 2 true false' END FROM files
UNION ALL SELECT 'import', path, pad + 4, 'std 1 true false' FROM files WHERE k % 5 = 0""")
def src_line_reviews(spark, sf_dir):
    """Ghost names, text searches for syntax, recommended groups, import groups (AG36, EX32, EX33, EX37, J15, PR26, PR27, W10)."""
    files = sources(spark, sf_dir)
    ghost = reviews.ghost_naming(files).select(F.lit("ghost").alias("what"), "path", "line_no", F.concat_ws(" ", "kind", "name").alias("detail"))
    lint = reviews.string_manipulation(files).select(F.lit("lint").alias("what"), "path", "line_no", F.concat_ws(" ", "receiver", "literal").alias("detail"))
    group = reviews.recommended_groups(files).select(F.lit("group").alias("what"), "path", F.lit(0).alias("line_no"), F.col("group").alias("detail"))
    imports = reviews.import_groups(files).select(F.lit("import").alias("what"), "path", F.col("first").alias("line_no"), F.concat_ws(" ", "root", "n", "contiguous", "blank_after").alias("detail"))
    return wide(ghost.unionByName(lint).unionByName(group).unionByName(imports))


@query(f"""WITH {FILES_SQL} SELECT path, 1::BIGINT AS n_quantifiers, CASE WHEN k % 3 = 0 THEN 1 ELSE 0 END::BIGINT AS n_with_triggers, 1::BIGINT AS n_traits, 2::BIGINT AS n_methods, 1::BIGINT AS n_default, 0::BIGINT AS n_loops FROM files""")
def src_counts(spark, sf_dir):
    """Triggers, traits with default methods, loops by file (AG31, AG34, AG44, EX34, T17, T19)."""
    files = sources(spark, sf_dir)
    fns = facts(files, "fns")
    return reviews.triggers(files).join(reviews.default_methods(facts(files, "traits")), "path").join(reviews.invariants(fns).select("path", "n_loops"), "path")


@query(f"""WITH {FILES_SQL} SELECT name, count(*) AS n, count(*) AS n_files FROM (SELECT 'vstd::seq::group_seq_axioms' AS name FROM files UNION ALL SELECT 'crate::g::group_' || (k % 5) FROM files) GROUP BY name""")
def src_broadcast_use(spark, sf_dir):
    """The most used broadcast groups (AG20, AG35, SO5)."""
    return reviews.broadcast_use(sources(spark, sf_dir))


@query(f"""WITH {FNS_SQL} SELECT name, count(*) FILTER (WHERE mode = 'spec') AS n_defined FROM fns GROUP BY name HAVING count(*) = count(*) FILTER (WHERE mode = 'spec') AND name <> 'inv'""")
def src_unused_specs(spark, sf_dir):
    """Spec functions that nothing uses, over all types that define the name (J18, AG38)."""
    files = sources(spark, sf_dir)
    return reviews.unused_spec_fns(facts(files, "fns", "name", "mode"), facts(files, "tokens", "kind", "text"))


# -- the library's inventory


@query(f"""WITH {LIBRARY_SQL}, s AS (
SELECT 'modules' AS section, path, 1 AS line, 'lib' || k AS name, 'vstd::' || module AS qualified_path, 'child_' || k AS detail FROM lib
UNION ALL SELECT 'ghost_types', path, 6, own, 'vstd::' || module || '::' || own, CASE WHEN own = 'Seq' THEN 'Vec ' ELSE '' END || 'len get' FROM lib WHERE ghost
UNION ALL SELECT 'tracked_types', path, 6, own, 'vstd::' || module || '::' || own, '' FROM lib WHERE NOT ghost AND (k % 5 = 1 OR k % 4 = 1)
UNION ALL SELECT 'spec_functions', path, 17, 'un', 'vstd::' || module || '::un', 'false true true' FROM lib
UNION ALL SELECT 'proof_functions', path, 15, 'lemma_a', 'vstd::' || module || '::lemma_a', 'true true false true' FROM lib
UNION ALL SELECT 'proof_functions', path, 14, n, 'vstd::' || module || '::' || n, 'false true false true' FROM (SELECT *, 'axiom_' || CASE k % 4 WHEN 0 THEN 'mul' WHEN 1 THEN 'seq' WHEN 2 THEN 'ptr' ELSE 'x' END || '_' || k AS n FROM lib)
UNION ALL SELECT 'proof_functions', path, 21, 'user_' || k, 'vstd::' || module || '::user_' || k, 'false false false false' FROM lib
UNION ALL SELECT 'axioms', path, 14, n, 'vstd::' || module || '::' || n, CASE k % 4 WHEN 0 THEN 'arithmetic' WHEN 1 THEN 'sequence' WHEN 2 THEN 'rust_semantics' ELSE 'other' END || ' true' FROM (SELECT *, 'axiom_' || CASE k % 4 WHEN 0 THEN 'mul' WHEN 1 THEN 'seq' WHEN 2 THEN 'ptr' ELSE 'x' END || '_' || k AS n FROM lib)
UNION ALL SELECT 'exec_functions', path, 16, 'ex', 'vstd::' || module || '::ex', 'true false false' FROM lib
UNION ALL SELECT 'external_specs', path, 9, CASE k % 3 WHEN 0 THEN 'Option::<T>::unwrap' WHEN 1 THEN 'Vec::<T>::push' ELSE 'u64::max_value' END, 'vstd::' || module || '::' || CASE k % 3 WHEN 0 THEN 'Option::<T>::unwrap' WHEN 1 THEN 'Vec::<T>::push' ELSE 'u64::max_value' END,
 CASE k % 3 WHEN 0 THEN 'Option' WHEN 1 THEN 'Vec' ELSE 'u64' END || CASE WHEN k % 2 = 0 THEN ' true false' ELSE ' false true' END FROM lib
UNION ALL SELECT 'traits', path, 20, 'Tr' || k, 'vstd::' || module || '::Tr' || k, 'View + Sized a b c' FROM lib
UNION ALL SELECT 'broadcast_groups', path, 12, n, 'vstd::' || module || '::' || n, 'lemma_a lemma_b ' || CASE WHEN k % 7 = 0 THEN 'true' ELSE 'false' END FROM (SELECT *, 'group_' || CASE WHEN k % 7 = 0 THEN 'vstd_default' ELSE 'g' || k END AS n FROM lib)
UNION ALL SELECT 'macros', path, 3, n, 'vstd::' || module || '::' || n, CASE WHEN n = 'seq' THEN 'Create a sequence literal' ELSE '' END FROM (SELECT *, CASE WHEN k % 2 = 0 THEN 'seq' ELSE 'other' END AS n FROM lib)
UNION ALL SELECT 'constants', path, 13, 'LIMIT_' || k, 'vstd::' || module || '::LIMIT_' || k, 'nat' FROM lib
UNION ALL SELECT 'enums', path, 18, 'En' || k, 'vstd::' || module || '::En' || k, 'One Two A' FROM lib
UNION ALL SELECT 'type_aliases', path, 19, 'Al' || k, 'vstd::' || module || '::Al' || k, 'Vec<A> A' FROM lib
UNION ALL SELECT 'wrapped_rust_types', min(path), 8, t, m || '::' || t, 'view ' || string_agg(DISTINCT v, ' ' ORDER BY v) FROM (SELECT *, CASE k % 3 WHEN 0 THEN 'Option' ELSE 'Vec' END AS t, CASE k % 3 WHEN 0 THEN 'core::option' ELSE 'alloc::vec' END AS m, 'v' || (k % 4) AS v FROM lib WHERE k % 2 = 0 AND k % 3 < 2) GROUP BY t, m)
SELECT section, path, line::BIGINT AS line, name, qualified_path, detail FROM s""")
def src_inventory(spark, sf_dir):
    """All sections of a library's inventory (EX27, EX33, SE6, SO11, FN13, FN14)."""
    found = inventory.ordered(inventory.sections(library(spark, sf_dir)))
    joined = lambda c: F.array_join(c, " ")
    detail = {
        "modules": joined("child_modules"), "tracked_types": F.lit(""), "spec_functions": F.concat_ws(" ", "is_open", "is_uninterpreted", "has_recommends"),
        "ghost_types": F.concat_ws(" ", "rust_equivalent", joined(F.transform("methods", lambda m: m["name"]))), "proof_functions": F.concat_ws(" ", "is_lemma", "is_broadcast", "has_requires", "has_ensures"),
        "axioms": F.concat_ws(" ", "category", "is_auto_broadcast"), "exec_functions": F.concat_ws(" ", "has_requires", "has_ensures", "has_recommends"), "external_specs": F.concat_ws(" ", "external_module", "has_requires", "has_ensures"),
        "traits": F.concat_ws(" ", "extends_rust_trait", joined("spec_methods"), joined("proof_methods"), joined("exec_methods")), "broadcast_groups": F.concat_ws(" ", joined("members"), "is_default_enabled"),
        "macros": F.coalesce("purpose", F.lit("")), "constants": F.col("const_type"), "enums": F.concat_ws(" ", joined("variants"), joined("type_params")), "type_aliases": F.concat_ws(" ", "aliased_type", joined("type_params")),
        # methods at equal places come in any order of their names
        "wrapped_rust_types": F.concat_ws(" ", F.element_at("methods_wrapped", 1), joined(F.array_sort(F.slice("methods_wrapped", F.lit(2), F.size("methods_wrapped"))))),
    }
    return wide(reduce(DataFrame.unionByName, (df.select(F.lit(k).alias("section"), "path", "line", "name", "qualified_path", detail[k].alias("detail")) for k, df in found.items())))


@query(f"""WITH {LIBRARY_SQL}, c AS (SELECT count(*) AS n, count(*) FILTER (WHERE ghost) AS g, count(*) FILTER (WHERE NOT ghost AND (k % 5 = 1 OR k % 4 = 1)) AS t,
 count(DISTINCT k % 3) FILTER (WHERE k % 2 = 0 AND k % 3 < 2) AS w, count(DISTINCT (k % 3) * 10 + k % 4) FILTER (WHERE k % 2 = 0 AND k % 3 < 2) AS v FROM lib)
SELECT unnest(['total_modules', 'total_wrapped_rust_types', 'total_ghost_types', 'total_tracked_types', 'total_spec_functions', 'total_proof_functions', 'total_exec_functions', 'total_external_specs', 'total_traits', 'total_axioms',
 'total_broadcast_groups', 'total_macros', 'total_constants', 'total_enums', 'total_type_aliases', 'total_ghost_type_methods', 'total_wrapped_methods', 'total_lemmas', 'total_broadcast_lemmas', 'total_auto_broadcast_axioms']) AS total,
 unnest([n, w, g, t, n, 3 * n, n, n, n, n, n, n, n, n, n, 2 * g, w + v, n, 2 * n, n])::BIGINT AS n FROM c""")
def src_inventory_totals(spark, sf_dir):
    """The twenty totals of an inventory (AG19)."""
    return inventory.totals(inventory.sections(library(spark, sf_dir)))


@query(f"""WITH {LIBRARY_SQL} SELECT 'file' AS kind, 'lib' || k || '.rs' AS name, 1::BIGINT AS n, CASE WHEN k % 2 = 0 THEN 1 ELSE 0 END::BIGINT AS n_requires, CASE WHEN k % 2 = 0 THEN 0 ELSE 1 END::BIGINT AS n_ensures FROM lib
UNION ALL SELECT 'module', CASE k % 3 WHEN 0 THEN 'Option' WHEN 1 THEN 'Vec' ELSE 'u64' END, count(*), count(*) FILTER (WHERE k % 2 = 0), count(*) FILTER (WHERE k % 2 <> 0) FROM lib GROUP BY k % 3""")
def src_external_specs(spark, sf_dir):
    """Specifications of external functions by file and by module (AG17, AG40, EX26)."""
    specs = inventory.sections(library(spark, sf_dir))["external_specs"]
    by_file = inventory.specs_by_file(specs).select(F.lit("file").alias("kind"), F.col("file").alias("name"), "n", "n_requires", "n_ensures")
    return by_file.unionByName(inventory.wrapped_type_totals(specs).select(F.lit("module").alias("kind"), F.col("external_module").alias("name"), "n", "n_requires", "n_ensures"))


@query("""WITH m AS (SELECT CASE p_partkey % 3 WHEN 0 THEN 'core' WHEN 1 THEN 'alloc' ELSE 'std' END AS a, replace(p_brand, '#', '') AS b, p_partkey % 4 = 0 AS short, p_type AS t FROM part),
x AS (SELECT 'module' AS kind, a || '::' || b AS name FROM m UNION ALL SELECT 'module', 'std::' || b FROM m WHERE a <> 'std' UNION ALL SELECT 'type', t FROM m WHERE NOT short)
SELECT kind, name, count(*) AS n FROM x GROUP BY ALL""")
def method_totals(spark, sf_dir):
    """Methods by module, under both names of the standard library, and by type (AG18, J20, SC13)."""
    k = F.col("p_partkey")
    crate = F.when(k % 3 == 0, "core").when(k % 3 == 1, "alloc").otherwise("std")
    brand = F.replace("p_brand", F.lit("#"), F.lit(""))
    name = F.when(k % 4 == 0, F.concat_ws("::", crate, brand)).otherwise(F.concat_ws("::", crate, brand, "p_type", F.lit("push")))
    return inventory.method_totals(spark.read.parquet(f"{sf_dir}/part.parquet").select(name.alias("name")))


# -- the minimizer's relations


@query(f"""WITH {FNS_SQL}, l AS (SELECT s_suppkey AS k, '/w/vstd/' || CASE WHEN s_suppkey % 2 = 0 THEN 'std_specs/' ELSE '' END || 'lib' || s_suppkey || '.rs' AS path FROM supplier)
SELECT 'lemma' AS what, path, line, name, end_line AS n, coalesce(CASE WHEN kind LIKE 'impl%' THEN owner END, '') AS detail FROM fns WHERE mode = 'proof'
UNION ALL SELECT 'call', path, 22, 'lemma_a', 0, 'true' FROM l
UNION ALL SELECT 'assert', path, pad + 24, 'assert', 0, name FROM (SELECT f.path, f.pad, g.name FROM files f JOIN fns g ON g.k = f.k AND starts_with(g.name, 'f_') WHERE f.k % 5 = 2)
UNION ALL SELECT 'admit', path, pad + 24, 'admit', 0, name FROM (SELECT f.path, f.pad, g.name FROM files f JOIN fns g ON g.k = f.k AND starts_with(g.name, 'f_') WHERE f.k % 5 = 1)
UNION ALL SELECT 'proof block', path, pad + 24, 'proof block', 0, name FROM (SELECT f.path, f.pad, g.name FROM files f JOIN fns g ON g.k = f.k AND starts_with(g.name, 'f_') WHERE f.k % 5 = 2)""")
def src_minimizer(spark, sf_dir):
    """Lemma ranges, call sites, asserts, admits and proof blocks (EX29, EX30, EX31)."""
    files, lib = sources(spark, sf_dir), library(spark, sf_dir)
    fns = facts(files, "fns")
    ranges = minimize.lemma_ranges(fns).select(F.lit("lemma").alias("what"), "path", F.col("first").alias("line"), "name", F.col("last").cast("bigint").alias("n"), F.coalesce("impl_type", F.lit("")).alias("detail"))
    both = files.select("path", "content").unionByName(lib.select("path", "content"))
    names = facts(both, "fns").where("mode = 'proof'").select("name")
    calls = minimize.call_sites(both, names, "/w/vstd").select(F.lit("call").alias("what"), "path", F.col("line_no").alias("line"), "name", F.lit(0).cast("bigint").alias("n"), F.col("in_library").cast("string").alias("detail"))
    found = minimize.candidates(files, facts(files, "types")).where("kind in ('assert', 'admit', 'proof block')").select(F.col("kind").alias("what"), "path", F.col("line_no").alias("line"), F.col("kind").alias("name"), F.lit(0).cast("bigint").alias("n"), F.col("context").alias("detail"))
    return wide(ranges.unionByName(calls).unionByName(found))


@query(f"""WITH {FNS_SQL}, g AS (SELECT name, path, count(*) AS n_variants, 0::BIGINT AS n_calls FROM fns WHERE mode = 'proof' GROUP BY ALL),
u AS (SELECT DISTINCT 'm' || ((k * 3) % 100) AS last FROM files)
SELECT 'group' AS what, name, path, n_variants, n_calls FROM g UNION ALL SELECT 'module', 'src/Chap' || (k % 7) || '/m' || k, '', 0, 0 FROM files WHERE 'm' || k IN (SELECT last FROM u)""")
def src_lemma_groups(spark, sf_dir):
    """Lemmas by name and file with their calls, and modules in use (AG39, J19, FN4)."""
    files = sources(spark, sf_dir)
    ranges = minimize.lemma_ranges(facts(files, "fns"))
    groups = minimize.lemma_groups(ranges, minimize.call_sites(files, ranges, "/w/vstd")).select(F.lit("group").alias("what"), "name", "path", "n_variants", "n_calls")
    modules = files.select(F.regexp_replace(F.regexp_replace("rel_path", "^[^/]*/", ""), r"\.rs$", "").alias("module"))
    used = minimize.used_modules(files, modules, "/w/vstd").select(F.lit("module").alias("what"), F.col("module").alias("name"), F.lit("").alias("path"), F.lit(0).cast("bigint").alias("n_variants"), F.lit(0).cast("bigint").alias("n_calls"))
    return groups.unionByName(used)


@query(f"""WITH {FILES_SQL}, i AS (SELECT k, path, 1 AS seq, 3 AS at, k % 3 AS n FROM files UNION ALL SELECT k, path, 2, 12, 2 FROM files UNION ALL SELECT k, path, 3, 1, 1 FROM files),
p AS (SELECT path, unnest([2, 10, 11, 20]) AS line, k FROM files), a AS (SELECT *, CASE WHEN 3 <= line THEN line + k % 3 ELSE line END AS x FROM p), b AS (SELECT *, CASE WHEN 12 <= x THEN x + 2 ELSE x END AS y FROM a)
SELECT path, line::BIGINT AS line, (y + 1)::BIGINT AS new_line FROM b""")
def src_line_shift(spark, sf_dir):
    """Lines after insertions made one after another."""
    files = sources(spark, sf_dir).select("path", F.regexp_extract("stem", r"(\d+)", 1).cast("bigint").alias("k"))
    made = files.select("path", F.explode(F.array(*(F.struct(F.lit(i).cast("bigint").alias("seq"), F.lit(at).cast("bigint").alias("at"), n.cast("bigint").alias("n")) for i, at, n in ((1, 3, F.col("k") % 3), (2, 12, F.lit(2)), (3, 1, F.lit(1)))))).alias("x")).select("path", "x.*")
    places = files.select("path", F.explode(F.array(*(F.lit(n).cast("bigint") for n in (2, 10, 11, 20)))).alias("line"))
    return minimize.shifted(places, made)


# -- smaller reviews


@query(f"""WITH {FNS_SQL} SELECT 'trivial' AS what, path, line, name, CASE WHEN name = 'inv' OR k % 4 < 2 THEN 'true' ELSE 'false' END AS detail FROM fns WHERE mode = 'spec' AND (starts_with(name, 'wf_') OR starts_with(name, 'ok_') OR (name = 'inv' AND modifiers = 'open spec'))
UNION ALL SELECT 'no spec', path, line, name, CASE WHEN k % 4 < 2 THEN 'true' ELSE 'false' END FROM fns WHERE starts_with(name, 'rec_') AND k % 4 <> 3 UNION ALL SELECT 'no spec', path, line, name, 'false' FROM fns WHERE name = 'outside' OR (starts_with(name, 'f_') AND k % 3 = 2 AND k % 2 = 1)
UNION ALL SELECT 'collection', path, pad + 8, 'S' || (k % 9), CASE WHEN k % 4 = 2 THEN 'true true false' ELSE 'false true false' END FROM files UNION ALL SELECT 'collection', path, pad + 39, 'Out', 'false false false' FROM files WHERE k % 4 = 1""")
def src_trivial_specs(spark, sf_dir):
    """Trivial spec functions, functions without a specification, evidence for collections (EX22, EX40)."""
    files = sources(spark, sf_dir)
    t = fact_tables(files, ("fns", "types", "impls"))
    trivial = reviews.trivial_specs(t["fns"]).select(F.lit("trivial").alias("what"), "path", "line", "name", F.col("body").alias("detail"))
    bare = reviews.without_spec(t["fns"]).select(F.lit("no spec").alias("what"), "path", "line", "name", F.col("is_external").cast("string").alias("detail"))
    held = reviews.collection_evidence(t["types"], t["impls"]).select(F.lit("collection").alias("what"), "path", "line", "name", F.concat_ws(" ", "by_view", "by_field", "by_name").alias("detail"))
    return wide(trivial.unionByName(bare).unionByName(held))


@query(f"""WITH {FINDINGS_SQL}, d AS (SELECT DISTINCT 'Chap' || (f.k % 7) AS chapter, h.module AS blocker FROM status f JOIN status h ON h.is_holed AND h.k = (f.k * 3) % 100 AND h.k % 7 = f.k % 7 AND h.k <> f.k)
SELECT 'directory' AS what, project AS a, 'Chap' || (k % 7) AS b, count(*) AS n, sum(n_holes)::BIGINT AS m, count(*) FILTER (WHERE is_holed) = 0 AS flag FROM status GROUP BY ALL
UNION ALL SELECT 'blocker', chapter, blocker, 0, 0, false FROM d UNION ALL SELECT 'type', hole_type, severity, count(*), 0, hole_type IN ('fn_missing_ensures', 'fn_missing_requires_ensures') FROM findings GROUP BY ALL""")
def src_audit_groups(spark, sf_dir):
    """Directories, blockers inside and outside a chapter, findings by type with the style errors (AG3, AG4, J9, J22, PR20)."""
    files = sources(spark, sf_dir)
    found = cut(facts(files, "findings"))
    status = cut(audit.file_status(found, files))
    zero = F.lit(0).cast("bigint")
    top = reviews.top_directories(status).select(F.lit("directory").alias("what"), F.col("project").alias("a"), F.col("directory").alias("b"), F.col("n_files").alias("n"), F.col("n_holes").alias("m"), F.col("clean").alias("flag"))
    held = reviews.dependency_blockers(audit.holed_dependencies(status, files)).select(F.lit("blocker").alias("what"), F.col("chapter").alias("a"), F.col("blocker").alias("b"), zero.alias("n"), zero.alias("m"), F.col("is_external").alias("flag"))
    kinds = reviews.style_errors(found).groupBy("hole_type", "severity", "is_style_error").agg(F.count("*").alias("n")).select(F.lit("type").alias("what"), F.col("hole_type").alias("a"), F.col("severity").alias("b"), "n", zero.alias("m"), F.col("is_style_error").alias("flag"))
    return top.unionByName(held).unionByName(kinds)


@query("""SELECT p_partkey, upper(left(p_name, 1)) || substr(split_part(p_name, ' ', 1), 2) || upper(left(split_part(p_name, ' ', 2), 1)) || substr(split_part(p_name, ' ', 2), 2) AS pascal, CASE WHEN p_size < 10 THEN 'Chap' || p_size ELSE p_name END AS chapter,
CASE WHEN p_size < 10 THEN 'false ' || p_size || ' ' ELSE 'true 0 ' || p_name END AS place, CASE WHEN p_partkey < 60 THEN p_partkey || 's' WHEN p_partkey < 3600 THEN (p_partkey // 60) || 'm ' || (p_partkey % 60) || 's' ELSE (p_partkey // 3600) || 'h ' || (p_partkey // 60 % 60) || 'm' END AS took,
p_size || ' (' || printf('%.1f', p_size * 100.0 / 50) || '%)' AS share, '#![trigger ' || p_name || ', ' || p_brand || '] #![trigger ' || p_type || ']' AS annotation, replace(p_name || '}', '}', '\\}') AS escaped, p_size < 20 AND p_size + 5 > 10 AS overlaps, length(p_name) // 4 AS tokens, starts_with(p_name, 'r') AS formatted FROM part""")
def text_functions(spark, sf_dir):
    """Pascal case, chapter order, durations, shares, annotations, escapes, overlaps, token estimates (FN7, FN18-FN21, W13, AG42, PR25)."""
    k, size = F.col("p_partkey"), F.col("p_size")
    chapter = F.when(size < 10, F.concat(F.lit("Chap"), size.cast("string"))).otherwise(F.col("p_name"))
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").withColumn("chapter", chapter)
    place = text.chapter_order(F.col("chapter"))
    bullet = F.concat(F.when(F.startswith("p_name", F.lit("r")), F.lit("- ")).otherwise(F.lit("")), "p_name")
    return parts.select(
        "p_partkey", text.pascal_case(F.replace("p_name", F.lit(" "), F.lit("_"))).alias("pascal"), "chapter", F.concat_ws(" ", place["other"], place["number"], place["name"]).alias("place"), text.duration(k).alias("took"), text.count_and_percent(size, F.lit(50)).alias("share"),
        text.trigger_annotations(F.array(F.array("p_name", "p_brand"), F.array("p_type"))).alias("annotation"), text.escape_brace(F.concat("p_name", F.lit("}"))).alias("escaped"),
        text.spans_overlap(size, size + 5, F.lit(10), F.lit(20)).alias("overlaps"), text.token_estimate(F.length("p_name")).alias("tokens"), text.already_formatted(bullet).alias("formatted"),
    )


# -- trigger logs, rewrites and texts by line


def _logs(spark, sf_dir) -> DataFrame:
    """A debug log and compiler messages for each supplier."""
    log = """concat('noise\\nChosenTriggers {\\n  span: Span {\\n    as_string: "/w/a', k, '.rs:', k % 50 + 1, ':3: ', k % 50 + 3, ':9 (#0)",\\n  },\\n  triggers: [\\n    [\\n      (Span {\\n as_string: "/w/a.rs:1:2: 1:', k % 7, '",\\n }, "x"),\\n    ],\\n',
      if(k % 2 = 0, '    [\\n      as_string: "second",\\n      as_string: "third",\\n    ],\\n', ''), '  ],\\n  low_confidence: ', if(k % 3 = 0, 'true', 'false'), ',\\n  manual: ', if(k % 4 = 0, 'true', 'false'), ',\\n}\\n')"""
    message = """concat('note: automatically chose triggers for this expression:\\n  --> /w/b', k, '.rs:', k, ':5\\n  |\\nnote:   trigger 1 of 1:\\n  --> /w/b', k, '.rs:', k + 1, ':7\\n  |\\n  | ^^^\\n\\nnote: Verus printed one or more\\n  trigger 2 of 2:\\n --> no.rs:1:1\\n')"""
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").selectExpr("s_suppkey AS k")
    return s.selectExpr("concat('log', k) AS path", f"{log} AS content").unionByName(s.selectExpr("concat('msg', k) AS path", f"{message} AS content"))


@query("""SELECT 'log' || s_suppkey AS path, '/w/a' || s_suppkey || '.rs' AS file, (s_suppkey % 50 + 1)::BIGINT AS line_s, (s_suppkey % 50 + 3)::BIGINT AS line_e,
 '/w/a.rs:1:2: 1:' || (s_suppkey % 7) || CASE WHEN s_suppkey % 2 = 0 THEN ' | second, third' ELSE '' END AS groups, s_suppkey % 4 = 0 AS manual, s_suppkey % 3 = 0 AS low_confidence FROM supplier
UNION ALL SELECT 'msg' || s_suppkey, '/w/b' || s_suppkey || '.rs', s_suppkey, s_suppkey, '/w/b' || s_suppkey || '.rs:' || (s_suppkey + 1) || ':7: ' || (s_suppkey + 1) || ':10', false, false FROM supplier""")
def trigger_logs(spark, sf_dir):
    """Recommended triggers from debug logs and compiler messages (SC15, SC16)."""
    logs = _logs(spark, sf_dir)
    groups = F.array_join(F.transform("groups", lambda g: F.array_join(g, ", ")), " | ").alias("groups")
    long = lambda c, as_=None: F.col(c).cast("bigint").alias(as_ or c)
    entries = triggers.trigger_log(logs.where("path like 'log%'")).select("path", "file", long("line_s"), long("line_e"), groups, "manual", "low_confidence")
    told = triggers.trigger_messages(logs.where("path like 'msg%'")).select("path", "file", long("line_s"), long("line_s", "line_e"), groups, F.lit(False).alias("manual"), F.lit(False).alias("low_confidence"))
    return entries.unionByName(told)


@query("""WITH d AS (SELECT p_partkey AS k, 'f' || (p_partkey % 40) AS path, p_partkey // 40 AS line_no FROM part),
q AS (SELECT 'f' || (s_suppkey % 40) AS path, s_suppkey AS entry, s_suppkey % 9 AS a, s_suppkey % 9 + 3 AS b, s_suppkey % 4 = 0 AS manual FROM supplier),
m AS (SELECT q.path, entry, min(line_no) AS line_no FROM q JOIN d ON d.path = q.path AND line_no BETWEEN a AND b WHERE NOT manual GROUP BY ALL)
SELECT path, line_no::BIGINT AS line_no, '#![trigger t' || max(entry) || '] #![trigger u, v]' AS annotation FROM m GROUP BY path, line_no""")
def recommended_triggers(spark, sf_dir):
    """Each quantifier's recommendation at the first automatic trigger in its span (J10, FN21)."""
    k = F.col("p_partkey")
    places = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.concat(F.lit("f"), k % 40).alias("path"), F.floor(k / 40).alias("line_no"))
    s = F.col("s_suppkey")
    groups = F.array(F.array(F.concat(F.lit("t"), s)), F.array(F.lit("u"), F.lit("v")))
    entries = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.concat(F.lit("f"), s % 40).alias("file"), s.alias("entry"), (s % 9).alias("line_s"), (s % 9 + 3).alias("line_e"), (s % 4 == 0).alias("manual"), groups.alias("groups"))
    return triggers.recommended(places, entries)


@query("""WITH x AS (SELECT p_partkey AS k, 'a' || repeat('#![auto] ', (p_partkey % 3)::INT) || CASE WHEN p_partkey % 2 = 0 THEN 'é #[auto]' ELSE '' END AS text FROM part)
SELECT 'f' || k AS path, 1::BIGINT AS line_no, (2 + 9 * i)::BIGINT AS col, true AS is_inner FROM (SELECT k, unnest(range(k % 3)) AS i FROM x) UNION ALL SELECT 'f' || k, 1, 2 + 9 * (k % 3) + 2, false FROM x WHERE k % 2 = 0""")
def auto_trigger_places(spark, sf_dir):
    """Places of automatic triggers (EX42)."""
    content = "concat('a', repeat('#![auto] ', cast(p_partkey % 3 AS int)), if(p_partkey % 2 = 0, 'é #[auto]', ''), '\\n')"
    found = triggers.auto_triggers(spark.read.parquet(f"{sf_dir}/part.parquet").selectExpr("concat('f', p_partkey) AS path", f"{content} AS content"))
    return wide(found).withColumn("col", F.col("col").cast("bigint"))


_BLOCK = (
    "'// head'", "'verus! {'", "'// of the lemma'", "'proof fn l' || k || '() { }'", "'spec fn s' || k || '() -> bool { true }'", "'// of the struct'", "'#[a]'", "'struct S' || k || ' { }'", "'broadcast use g;'", "'} // verus!'", "'fn out() { }'",
)


@query(f"""WITH t AS (SELECT s_suppkey AS k, [{', '.join(x.replace('k', 's_suppkey') if "|| k ||" in x else x for x in _BLOCK)}] AS l FROM supplier)
SELECT 'f' || k AS path, '//  Table of Contents' || chr(10) || '//' || chr(9) || chr(9) || '1. module' || chr(10) || '//' || chr(9) || chr(9) || '2. uses' || chr(10) || '//' || chr(9) || chr(9) || '3. types' || chr(10) || '//' || chr(9) || chr(9) || '5. specs' || chr(10) || '//' || chr(9) || chr(9) || '6. proofs' || chr(10)
 || array_to_string([l[1], l[2], l[9], l[6], l[7], l[8], l[5], l[3], l[4], l[10], l[11]], chr(10)) || chr(10) AS content FROM t""")
def reorder_sections(spark, sf_dir):
    """Items of a block in the order of their sections, with a table of contents (ED8, W1)."""
    text_of = "concat(concat_ws('\\n', " + ", ".join(_BLOCK) + "), '\\n')"
    files = spark.read.parquet(f"{sf_dir}/supplier.parquet").selectExpr("s_suppkey AS k").selectExpr("concat('f', k) AS path", f"{text_of} AS content")
    return fixes.reordered(files, style.sections(files), {2: "uses", 3: "types", 5: "specs", 6: "proofs"})


@query("""WITH x AS (SELECT p_partkey AS k FROM part) SELECT 'd/' || CASE WHEN k % 2 = 0 THEN 'Prove' ELSE '' END || 'M' || (k // 2) || '.rs' AS path, 4::BIGINT AS line_no, 'm' || k AS module, 'faster ' || k AS hypothesis, CASE WHEN k % 3 = 0 THEN 'yes' END AS result FROM x""")
def experiment_comments(spark, sf_dir):
    """Hypotheses and results above modules (EX45)."""
    return wide(reviews.experiments(_experiments(spark, sf_dir)))


def _experiments(spark, sf_dir) -> DataFrame:
    content = """concat('use a;\\n// Hypothesis: faster ', p_partkey, if(p_partkey % 3 = 0, '\\n// result: yes', '\\n// nothing'), '\\npub mod m', p_partkey, ';\\n// loop-', p_partkey % 5, ': one\\n// for-consume it\\n#[test]\\nfn t() { assert!(1); let x = "vec![2]"; }\\n')"""
    path = "concat('d/', if(p_partkey % 2 = 0, 'Prove', ''), 'M', cast(floor(p_partkey / 2) AS bigint), '.rs')"
    return spark.read.parquet(f"{sf_dir}/part.parquet").selectExpr(f"{path} AS path", f"{content} AS content")


@query("""WITH x AS (SELECT p_partkey AS k, p_partkey // 2 AS m FROM part) SELECT 'M' || m AS module, 'loop-' || (max(k) % 5) || ' for-consume loop-' || (min(k) % 5) AS detail, count(*) AS n, count(*)::BIGINT AS n_tests, count(*)::BIGINT AS n_macros FROM x GROUP BY m""")
def test_patterns(spark, sf_dir):
    """Patterns named in test files by module, tests and macro calls (AG43, EX43)."""
    files = _experiments(spark, sf_dir)
    counts = reviews.test_counts(files).withColumn("module", F.regexp_extract("path", r"(?:Prove)?(M\d+)\.rs$", 1)).groupBy("module").agg(F.count("*").alias("n"), F.sum("n_tests").alias("n_tests"), F.sum("n_macros").alias("n_macros"))
    return reviews.comment_patterns(files).select("module", F.array_join("patterns", " ").alias("detail")).join(counts, "module")


# -- scans and logs


@query("""WITH p AS (SELECT p_partkey AS k, 'proj' || (p_partkey % 6) || '/' || CASE p_partkey % 7 WHEN 0 THEN 'attic' WHEN 1 THEN '.git' WHEN 2 THEN 'target' WHEN 3 THEN 'src/deep/er' ELSE 'src' END || '/' || CASE WHEN p_partkey % 4 = 0 THEN 'tests/' ELSE '' END || 'm' || p_partkey || CASE WHEN p_partkey % 5 = 0 THEN '.py' ELSE '.rs' END AS rel FROM part)
SELECT rel, CASE WHEN k % 5 = 0 THEN 'scripts' WHEN k % 7 > 2 THEN 'src' WHEN k % 4 = 0 THEN 'tests' ELSE 'other' END AS kind FROM p WHERE k % 7 > 2 AND NOT contains('/r/' || rel, '/proj3/') AND NOT ends_with(rel, '9.rs') AND len(string_split(rel, '/')) <= 5""")
def scan_paths(spark, sf_dir):
    """Which files a scan takes, with exclusions and a depth, and their kinds of directory (SC1-SC4, SC7, SC8, SC11)."""
    rel = """concat('proj', k % 6, '/', CASE k % 7 WHEN 0 THEN 'attic' WHEN 1 THEN '.git' WHEN 2 THEN 'target' WHEN 3 THEN 'src/deep/er' ELSE 'src' END, '/', if(k % 4 = 0, 'tests/', ''), 'm', k, if(k % 5 = 0, '.py', '.rs'))"""
    paths = spark.read.parquet(f"{sf_dir}/part.parquet").selectExpr("p_partkey AS k").selectExpr(f"{rel} AS rel")
    kept = scanned(F.col("rel"), F.concat(F.lit("/r/"), "rel"), ("proj3", "9.rs"), 5)
    return paths.where(kept).select("rel", kind_of("rel").alias("kind"))


@query("""WITH m AS (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 3 = 0 THEN '/w/p' || s_suppkey WHEN s_suppkey % 3 = 1 THEN '/w/p' || (s_suppkey - 1) || '/sub/q' || s_suppkey ELSE '/w/ws' || s_suppkey END AS dir, s_suppkey % 3 = 2 AS ws FROM supplier)
SELECT dir FROM m WHERE NOT ws AND k % 3 = 0""")
def project_dirs(spark, sf_dir):
    """Package directories, workspaces and what lies below another hit left out (SC5, SC6)."""
    k = F.col("s_suppkey")
    folder = F.when(k % 3 == 0, F.concat(F.lit("/w/p"), k)).when(k % 3 == 1, F.concat(F.lit("/w/p"), k - 1, F.lit("/sub/q"), k)).otherwise(F.concat(F.lit("/w/ws"), k))
    content = F.when(k % 3 == 2, "[workspace]\nmembers = []\n").otherwise("[package]\nname = 'x'\n")
    return projects(spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.concat(folder, F.lit("/Cargo.toml")).alias("path"), content.alias("content")))


@query("""WITH f AS (SELECT s_suppkey AS k FROM supplier) SELECT 'M' || k AS module, 'src' AS kind, '/w/src/M' || k || '.rs' AS path FROM f
UNION ALL SELECT 'M' || k, 'tests', '/w/tests/' || CASE WHEN k % 3 = 0 THEN 'test_M' WHEN k % 3 = 1 THEN 'TestM' ELSE 'M' END || k || '.rs' FROM f UNION ALL SELECT 'M' || k, 'benches', '/w/benches/M' || k || '.rs' FROM f WHERE k % 2 = 0""")
def module_lookup(spark, sf_dir):
    """The source, test and bench of each module, by the first of its names (SC9, J16)."""
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("k"))
    k = F.col("k")
    name = lambda pre: F.concat(F.lit(pre), k)
    stems = F.array(
        F.struct(F.lit("src").alias("d"), name("M").alias("s")), F.struct(F.lit("tests").alias("d"), F.when(k % 3 == 0, name("test_M")).when(k % 3 == 1, name("TestM")).otherwise(name("M")).alias("s")),
        F.struct(F.lit("tests").alias("d"), F.when(k % 3 == 0, name("TestM")).otherwise(name("M")).alias("s")), F.struct(F.when(k % 2 == 0, "benches").otherwise("docs").alias("d"), name("M").alias("s")),
    )
    files = s.select(F.explode(stems).alias("x")).distinct().select(F.concat(F.lit("/w/"), "x.d", F.lit("/"), "x.s", F.lit(".rs")).alias("path"), F.col("x.s").alias("stem"), F.concat("x.d", F.lit("/"), "x.s", F.lit(".rs")).alias("rel_path"))
    return module_files(files, s.select(name("M").alias("module")))


@query("""WITH s AS (SELECT s_suppkey AS k FROM supplier) SELECT 'usage' AS what, 'log' || k AS path, 'T' || (k % 4) AS a, 'push' AS b, k AS n, (k % 3 + 1)::BIGINT AS m FROM s UNION ALL SELECT 'usage', 'log' || k, 'T' || (k % 4), 'pop', 7, k % 3 + 1 FROM s
UNION ALL SELECT 'span', 'vp' || k, 'Item{Fn}', '2:3-' || (k + 2) || ':9', 1, k + 2 FROM s UNION ALL SELECT 'cell', 'md' || k, 'f' || k, 'yes', 6, 2 FROM s
UNION ALL SELECT 'off', 'lib' || k, 'm' || k, '', 6, 0 FROM s UNION ALL SELECT 'gated', 'lib' || k, 'g' || k, 'feat' || (k % 2) || ' Chap' || (k % 5), 4, 0 FROM s""")
def text_logs(spark, sf_dir):
    """Sectioned logs, path files, tables under headings, gated and disabled modules (SC14, SC17-SC20, W4)."""
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").selectExpr("s_suppkey AS k")
    made = lambda name, text_of: s.selectExpr(f"concat('{name}', k) AS path", f"concat({text_of}) AS content")
    log = made("log", "'=== ', k % 3 + 1, '. Methods\\nTYPE: T', k % 4, '\\n  1. push ', k, ' uses\\npop 7\\nnothing here\\n'")
    vp = made("vp", "'Item{Fn} 2:3-', k + 2, ':9\\nno span\\n'")
    md = made("md", "'# Other\\n| a | b |\\n|-|-|\\n# Function-by-Function Detail\\n| h | i |\\n|---|---|\\n| f', k, ' | yes |\\n'").select("path", F.replace("content", F.lit("|---|---|\n|"), F.lit("|---|---|\n|")).alias("content"))
    lib = made("lib", "'pub mod Chap', k % 5, ' {\\n  #[cfg(feature = \"feat', k % 2, '\")]\\n  // between\\n'").select("path", F.regexp_replace("content", r"\n  // between\n", "").alias("content"))
    lib = lib.withColumn("k", F.regexp_extract("path", r"(\d+)", 1)).select("path", F.concat("content", F.lit("\n  pub mod g"), "k", F.lit(";\n}\n"), F.lit("// pub mod m"), "k", F.lit(";\n")).alias("content"))
    long = lambda c: F.col(c).cast("bigint") if isinstance(c, str) else c.cast("bigint")
    rows = [
        usage_log(log).select(F.lit("usage").alias("what"), "path", F.col("owner").alias("a"), F.col("item").alias("b"), long("n").alias("n"), long("section").alias("m")),
        spans_of_paths(vp).select(F.lit("span").alias("what"), "path", F.col("text").alias("a"), F.format_string("%d:%d-%d:%d", "line_s", "col_s", "line_e", "col_e").alias("b"), long("seq").alias("n"), long("line_e").alias("m")),
        markdown_table(md, "Function-by-Function Detail").select(F.lit("cell").alias("what"), "path", F.col("cells")[0].alias("a"), F.col("cells")[1].alias("b"), (long("line_no") - 1).alias("n"), long(F.size("cells")).alias("m")),
        commented_modules(lib).select(F.lit("off").alias("what"), "path", F.col("module").alias("a"), F.lit("").alias("b"), (long("line_no") + 1).alias("n"), F.lit(0).cast("bigint").alias("m")),
        gated_modules(lib).select(F.lit("gated").alias("what"), "path", F.col("module").alias("a"), F.concat_ws(" ", "feature", "chapter").alias("b"), (long("line_no") + 1).alias("n"), F.lit(0).cast("bigint").alias("m")),
    ]
    return reduce(DataFrame.unionByName, rows)


# -- usage and coverage


def _ir(spark, sf_dir) -> DataFrame:
    content = """concat('(Fun :path "vstd!seq.Seq.len.") (module_id (Fun :path "vstd!no.Set.x.") (Typ Datatype (Dt Path "alloc!vec.Vec.") x (Fun :path "core!option.Option.m', k % 3, '.") (Fun :path "core!x.Unknown.f.")', if(k % 4 = 0, '(Typ Datatype (Dt Path "vstd!map.Map.")', ''))"""
    return spark.read.parquet(f"{sf_dir}/supplier.parquet").selectExpr("s_suppkey AS k").selectExpr("concat('/ir/', if(k % 10 = 9, 'vstd', concat('p', k % 5)), '/d/c', k, '.vir') AS path", f"{content} AS content")


@query("""WITH s AS (SELECT s_suppkey AS k, 'p' || (s_suppkey % 5) AS project FROM supplier WHERE s_suppkey % 10 <> 9)
SELECT DISTINCT project, 'Seq' AS owner, 'len' AS item FROM s UNION ALL SELECT DISTINCT project, 'Vec', NULL FROM s UNION ALL SELECT DISTINCT project, 'Option', 'm' || (k % 3) FROM s UNION ALL SELECT DISTINCT project, 'Map', NULL FROM s WHERE k % 4 = 0""")
def ir_usage(spark, sf_dir):
    """Library types and methods in the verifier's intermediate texts (EX24, FN23, AG9-AG11)."""
    return coverage.ir_usage(_ir(spark, sf_dir))


@query("""WITH s AS (SELECT s_suppkey AS k FROM supplier),
u AS (SELECT owner, count(*) AS n FROM (SELECT DISTINCT 'p' || (k % 5) AS p, 'std::vec::Vec' AS owner, '' AS i FROM s WHERE k % 10 <> 9 UNION SELECT DISTINCT 'p' || (k % 5), 'core::option::Option', 'm' || (k % 3) FROM s WHERE k % 10 <> 9
 UNION SELECT DISTINCT 'p' || (k % 5), 'unknown::Seq', '' FROM s WHERE k % 10 <> 9 UNION SELECT DISTINCT 'p' || (k % 5), 'unknown::Map', '' FROM s WHERE k % 10 <> 9 AND k % 4 = 0) GROUP BY owner)
SELECT replace(owner, 'std::vec', 'alloc::vec') AS owner, n::BIGINT AS n, owner IN ('std::vec::Vec', 'core::option::Option') AS covered, round(n * 100.0 / sum(n) OVER (), 6) AS percent FROM u""")
def type_coverage(spark, sf_dir):
    """Usage of types against those that specifications cover, with shares (J1, J2, AG6, AG15, EX25, FN2, FN3, FN17)."""
    used = coverage.ir_usage(_ir(spark, sf_dir))
    owner = F.when(F.col("owner") == "Vec", "std::vec::Vec").otherwise(coverage.full_type(F.col("owner")))
    specs = coverage.specified_methods(library(spark, sf_dir))
    out = coverage.type_coverage(used.groupBy(owner.alias("owner")).agg(F.count("*").alias("n")), specs)
    return out.withColumn("percent", F.round("percent", 6))


@query(f"""WITH {LIBRARY_SQL} SELECT DISTINCT CASE k % 3 WHEN 0 THEN 'core::option::Option' WHEN 1 THEN 'alloc::vec::Vec' ELSE 'unknown::u64' END AS owner, CASE k % 3 WHEN 0 THEN 'unwrap' WHEN 1 THEN 'push' ELSE 'max_value' END AS item FROM lib""")
def specified_methods(spark, sf_dir):
    """Methods that specifications cover, under full type names (EX25, FN3)."""
    return coverage.specified_methods(library(spark, sf_dir))


@query("""SELECT CASE p_partkey % 4 WHEN 0 THEN 'std::option' WHEN 1 THEN 'core::result' WHEN 2 THEN 'a::b::vec' ELSE 'x::y' || (p_partkey % 3) END AS module, CASE p_partkey % 4 WHEN 0 THEN 'full' WHEN 1 THEN 'part' WHEN 2 THEN 'last' ELSE 'missing' END AS status FROM part""")
def module_status(spark, sf_dir):
    """A module's status by its exact name, else as core, else by its last segment."""
    k = F.col("p_partkey")
    name = F.when(k % 4 == 0, "std::option").when(k % 4 == 1, "core::result").when(k % 4 == 2, "a::b::vec").otherwise(F.concat(F.lit("x::y"), k % 3))
    known = spark.createDataFrame([("core::option", "full"), ("core::result", "part"), ("vec", "last"), ("result", "zzz")], "name string, status string")
    return coverage.module_status(spark.read.parquet(f"{sf_dir}/part.parquet").select(name.alias("module")), known)


# -- rewrites and rules


@query(f"""WITH {LINES_SQL}, e AS (SELECT path, line_no, CASE WHEN k % 5 = 0 AND line_no = pad + 24 THEN '    proof {{ accept(n > 0); }};' WHEN k % 5 = 4 AND line_no = pad + 24 THEN '    proof {{ accept(false); }};' WHEN k % 4 = 1 AND line_no = pad + 27 THEN text || ' // accept hole'
 WHEN line_no = pad + 6 THEN text || chr(10) || 'broadcast use {{vstd::seq_lib::group_seq_properties, vstd::seq_lib::group_to_multiset_ensures, vstd::set::group_set_axioms, vstd::set_lib::group_set_lib_default}};' || CASE WHEN k % 5 = 0 THEN chr(10) || 'use crate::accept::x;' ELSE '' END ELSE text END AS text FROM lines WHERE line_no <> pad + 37)
SELECT path, sha256(string_agg(text, chr(10) ORDER BY line_no) || chr(10)) AS sha FROM e GROUP BY path""")
def src_edits(spark, sf_dir):
    """Separators deleted, groups and imports inserted, holes accepted, one edit after another; then all of a file's lines are marked and restored (ED4, ED6, ED7, ED10, PR19, PR24)."""
    files = sources(spark, sf_dir).select("path", "content")
    files = edits.apply_edits(files, fixes.delete_separators(files))
    files = edits.apply_edits(files, fixes.accept_assumes(files, facts(files, "findings"), "use crate::accept::x;"))
    files = cut(edits.apply_edits(files, fixes.insert_broadcast(files, reviews.recommended_groups(files))))
    marked = edits.apply_edits(files, fixes.comment_out(files, files.select("path", F.lit(1).alias("first"), F.lit(1 << 20).alias("last"))))
    files = edits.apply_edits(marked, fixes.restore(marked))
    return files.select("path", F.sha2("content", 256).alias("sha"))


_RULES = ", ".join((
    "0", "0", "0", "0", "CASE WHEN k % 5 = 0 THEN 1 ELSE 0 END", "1", "0", "CASE WHEN k % 5 = 0 THEN 1 ELSE 2 END", "0", "0", "0", "1", "CASE WHEN k % 4 = 3 THEN 0 ELSE 1 END", "0",
    "CASE k % 4 WHEN 0 THEN 4 WHEN 1 THEN 3 ELSE 2 END", "0", "0", "CASE WHEN k % 4 = 2 THEN 1 ELSE 0 END", "4 + CASE WHEN k % 3 < 2 THEN 1 ELSE 0 END + CASE WHEN k % 4 = 2 THEN 1 ELSE 0 END", "1", "0", "0", "CASE WHEN k % 3 = 0 THEN 2 ELSE 1 END", "0", "0",
))


@query(f"""WITH {FILES_SQL}, r AS (SELECT path, unnest(range(25)) AS rule, unnest([{_RULES}]) AS n_bad FROM files) SELECT path, rule, n_bad::BIGINT AS n_bad FROM r""")
def src_style(spark, sf_dir):
    """The 25 style rules over every file: how often each fails (PR28, EX39, J21, W1, W10, SO11)."""
    rows = style.style(sources(spark, sf_dir))
    return rows.groupBy("path", F.col("rule").cast("bigint").alias("rule")).agg(F.count_if(~F.col("ok")).alias("n_bad"))


# -- paths, blocks and compiler items


@query(f"""WITH {LINES_SQL}, l AS (SELECT path, pad, k, text, line_no - pad AS b FROM lines), n AS (SELECT path, b, length(text) AS n FROM l)
, p AS (SELECT path, pad, k, 8 AS a, 8 AS z, 'struct_ident{{S' || (k % 9) || '}}' AS text FROM files UNION ALL SELECT path, pad, k, 9, 9, 'enum{{enum E' || (k % 4) || '}}' FROM files UNION ALL SELECT path, pad, k, 10, 10, 'type{{type T' || (k % 8) || '}}' FROM files
 UNION ALL SELECT path, pad, k, 12, 15, 'trait{{trait R' || (k % 10) || '}}' FROM files UNION ALL SELECT path, pad, k, 16, 18, 'impl{{}} impl_trait{{R' || (k % 10) || '}} impl_type{{S' || (k % 9) || '<T>}}' FROM files
 UNION ALL SELECT path, pad, k, 13, 13, 'trait{{trait R' || (k % 10) || '}} fn{{fn inv}}' FROM files UNION ALL SELECT path, pad, k, 14, 14, 'trait{{trait R' || (k % 10) || '}} fn{{fn size}}' FROM files
 UNION ALL SELECT path, pad, k, 17, 17, 'impl{{}} impl_trait{{R' || (k % 10) || '}} impl_type{{S' || (k % 9) || '<T>}} fn{{fn inv}}' FROM files
 UNION ALL SELECT path, pad, k, 19, 19, CASE WHEN k % 3 = 0 THEN 'impl{{}} impl_trait{{Send}} impl_type{{E' ELSE 'impl{{}} impl_type{{E' END || (k % 4) || '}}' FROM files
 UNION ALL SELECT path, pad, k, 20, 26, 'fn{{fn f_' || (k % 11) || '_' || c || '}}' FROM files UNION ALL SELECT path, pad, k, 28, 28, 'fn{{fn rec_' || (k % 12) || '}}' FROM files UNION ALL SELECT path, pad, k, 29, 29, 'fn{{fn lemma_' || (k % 6) || '_len}}' FROM files
 UNION ALL SELECT path, pad, k, 30, 30, 'fn{{fn ' || CASE WHEN k % 3 = 1 THEN 'plain' ELSE 'axiom_' || CASE WHEN k % 9 < 3 THEN 'seq' WHEN k % 9 < 6 THEN 'mul' ELSE 'zzz' END END || '_' || (k % 5) || '}}' FROM files
 UNION ALL SELECT path, pad, k, 31, 31, 'fn{{fn ' || CASE WHEN k % 2 = 0 THEN 'wf_' ELSE 'ok_' END || (k % 4) || '}}' FROM files UNION ALL SELECT path, pad, k, 33, 33, 'fn{{fn main_' || (k % 3) || '}}' FROM files)
, q AS (SELECT path, pad, k, a, z, text, CASE WHEN a IN (13, 14, 17) THEN 4 ELSE 0 END AS col_s, 0 AS less FROM p
 UNION ALL SELECT path, pad, k, 19, 19, 'impl{{}} impl_type{{E' || (k % 4) || '}} fn{{fn ' || CASE WHEN k % 3 = 1 THEN 'help' ELSE 'new' END || '}}', 10, 2 FROM files WHERE k % 3 > 0
 UNION ALL SELECT path, pad, k, 34, 34, 'impl{{}} impl_trait{{' || CASE k % 4 WHEN 0 THEN 'Debug' WHEN 1 THEN 'RwLockPredicate' ELSE 'View' END || '}} impl_type{{' || CASE WHEN k % 4 = 1 THEN 'E1' ELSE 'S' || (k % 9) || '<u8>' END || '}}', 0, 0 FROM files WHERE k % 4 < 3
 UNION ALL SELECT path, pad, k, 34, 34, 'impl{{}} impl_trait{{RwLockPredicate}} impl_type{{E1}} fn{{fn inv}}', 30, 2 FROM files WHERE k % 4 = 1
 UNION ALL SELECT path, pad, k, 34, 34, 'impl{{}} impl_trait{{View}} impl_type{{S' || (k % 9) || '<u8>}} fn{{fn view}}', 41, 2 FROM files WHERE k % 4 = 2)
SELECT q.path, text, q.pad + a - CASE WHEN a = 8 AND k % 6 = 0 THEN 1 WHEN a = 28 AND k % 4 < 2 THEN 1 ELSE 0 END AS line_s, col_s::BIGINT AS col_s, q.pad + z AS line_e, n.n - less AS col_e FROM q JOIN n ON n.path = q.path AND n.b = q.z""")
def src_paths(spark, sf_dir):
    """Paths of items with their spans, written as lines and read back (EX38, SK5, SC17, FN8, FN19)."""
    lines_of = path_lines(facts(sources(spark, sf_dir), "paths"))
    back = spans_of_paths(lines_of.select("path", F.concat("value", F.lit("\n")).alias("content")))
    item = F.regexp_replace("text", r"^file\{[^}]*\} ", "")
    return back.select("path", item.alias("text"), *(F.col(c).cast("bigint").alias(c) for c in ("line_s", "col_s", "line_e", "col_e")))


@query(f"""WITH {LINES_SQL}, s AS (SELECT path, pad, sum(CASE WHEN line_no <= pad + 5 THEN strlen(text) + 1 ELSE 0 END) + 8 AS a, sum(CASE WHEN line_no <= pad + 34 THEN strlen(text) + 1 ELSE 0 END) AS b FROM lines GROUP BY path, pad)
SELECT path, pad + 6 AS line_s, pad + 35 AS line_e, a::BIGINT - 1 AS byte_s, b::BIGINT AS byte_e, '' AS module FROM s""")
def src_blocks(spark, sf_dir):
    """Extents of blocks, as lines and UTF-8 bytes (EX10, EX11, FN8, FN9)."""
    files = sources(spark, sf_dir)
    found = facts(files, "blocks").join(files.select("path", "content"), "path")
    byte = text.byte_offset(F.col("content"), F.col("line_e"), F.lit(0))
    return found.select("path", F.col("line_s").cast("bigint").alias("line_s"), F.col("line_e").cast("bigint").alias("line_e"), (text.byte_offset(F.col("content"), F.col("line_s"), F.lit(6)) + 1).cast("bigint").alias("byte_s"), byte.cast("bigint").alias("byte_e"), F.coalesce("module", F.lit("")).alias("module"))


@query("""SELECT DISTINCT CASE WHEN s_suppkey % 3 = 2 THEN 'trait' ELSE 'type' END AS kind, CASE s_suppkey % 3 WHEN 0 THEN 'nat' WHEN 1 THEN 'Ghost<T>' ELSE 'Sealed' END AS name,
CASE s_suppkey % 3 WHEN 0 THEN 'Natural number (non-negative integer, >= 0)' WHEN 1 THEN 'Ghost wrapper - data exists only in proofs, erased at runtime' ELSE 'Sealed trait pattern - prevents external implementations' END AS description,
CASE s_suppkey % 3 WHEN 0 THEN 'mathematical' WHEN 1 THEN 'wrapper' END AS category FROM supplier""")
def compiler_items(spark, sf_dir):
    """Types and traits of the compiler from its table of items (EX28)."""
    content = """concat('  ("verus::verus_builtin::', CASE s_suppkey % 3 WHEN 0 THEN 'nat' WHEN 1 THEN 'Ghost' ELSE 'private::Sealed' END, '", VerusItem::Builtin', if(s_suppkey % 3 = 2, 'Trait', 'Type'), '(x)),\\n("verus::verus_builtin::private::Hidden", VerusItem::BuiltinType(y))')"""
    return inventory.builtins(spark.read.parquet(f"{sf_dir}/supplier.parquet").selectExpr("concat('f', s_suppkey) AS path", f"{content} AS content"))


@query("""WITH x AS (SELECT p_partkey AS k, p_name AS n FROM part) SELECT 'f' || k AS path, CASE k % 3 WHEN 0 THEN 'AAAA-cccc' || n WHEN 1 THEN 'bbbb-cccc' || n ELSE 'aXX-cccc' || n END AS content FROM x""")
def repaint_spans(spark, sf_dir):
    """Spans replaced from the largest on, what overlaps left out (ED3, FN20)."""
    files = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.concat(F.lit("f"), "p_partkey").alias("path"), F.concat(F.when(F.col("p_partkey") % 3 == 1, "bbbb-cccc").otherwise("aaaa-cccc"), "p_name").alias("content"), "p_partkey")
    spans = [(0, 4, "AAAA", 0), (2, 5, "zzz", 0), (1, 4, "XX", 2), (3, 5, "z", 2)]
    each = F.explode(F.array(*(F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"), F.lit(new).alias("text"), F.lit(m).alias("m")) for a, b, new, m in spans)))
    return fixes.repainted(files, files.select("path", "p_partkey", each.alias("x")).where("x.m = p_partkey % 3").select("path", "x.start", "x.end", "x.text"))


@query("""SELECT 'f' || p_partkey AS path, CASE WHEN p_partkey % 2 = 0 THEN 'two' || chr(10) || 'three' || chr(10) || 'ONE' ELSE 'ONE' || chr(10) || 'two' || chr(10) || 'three' END AS content FROM part""")
def move_and_transform(spark, sf_dir):
    """Lines moved behind others, then a pattern replaced in the places of a search, the first of each file (ED1, ED2, PR29, SO12)."""
    files = spark.read.parquet(f"{sf_dir}/part.parquet").selectExpr("concat('f', p_partkey) AS path", "'one\\ntwo\\nthree' AS content", "p_partkey")
    places = files.where("p_partkey % 2 = 0").select("path", F.lit(1).alias("first"), F.lit(1).alias("last"), F.lit(3).alias("target"))
    files = edits.apply_edits(files, fixes.moved(places))
    first = minimize.first_places(lines(files).select("path", F.col("line_no").alias("seq"), "text"), "text", "on")
    return edits.apply_edits(files, fixes.transformed(files, first.select("path", F.col("seq").alias("line_no")), "^one$", "ONE"))
