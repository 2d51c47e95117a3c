"""A tree of source files generated from the driver's ``part`` table, one file a row.

Every line is an expression in the common subset of Spark's and DuckDB's SQL over k, the key, and c,
the first word of the part's name, after ``k % 4`` lines of padding. Every item of a file follows from
the key, so SQL can say which facts the extractors have to find, without a look at the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LINES = (
    "'//! Module m' || k",
    "'use vstd::prelude::*;'",
    "'use crate::Chap' || (k % 7) || '::m' || ((k * 3) % 100) || '::thing;'",
    "CASE WHEN k % 5 = 0 THEN 'use std::sync::RwLock;' ELSE 'use crate::accept::x;' END",
    "'// a comment with fn hidden() { }'",
    "'verus! {'",
    "CASE WHEN k % 6 = 0 THEN '#[derive(Clone)]' ELSE '// none' END",
    "'pub struct S' || (k % 9) || '<T> { pub a: u64, b: Seq<T>, }'",
    "'pub enum E' || (k % 4) || ' { A(u32), B { x: Set<nat> }, C }'",
    "'type T' || (k % 8) || ' = T' || (k % 8 + 1) || '<u8>;'",
    "'/// doc of R' || (k % 10)",
    "'pub trait R' || (k % 10) || ': R' || (k % 10 + 1) || ' + Sized {'",
    "'    spec fn inv(&self) -> bool;'",
    "'    fn size(&self) -> (n: u64) requires self.inv()' || CASE WHEN k % 4 = 3 THEN ' ensures n == 1' ELSE '' END || ' { 1 }'",
    "'}'",
    "'impl<T> R' || (k % 10) || ' for S' || (k % 9) || '<T> {'",
    "'    open spec fn inv(&self) -> bool { true }'",
    "'}'",
    "CASE WHEN k % 3 = 0 THEN 'unsafe impl Send for E' || (k % 4) || ' { }' WHEN k % 3 = 1 THEN 'impl E' || (k % 4) || ' { proof fn help() { } }' ELSE 'impl E' || (k % 4) || ' { fn new() -> Self ensures true { E' || (k % 4) || '::C } }' END",
    "'pub ' || CASE k % 3 WHEN 0 THEN 'open spec ' WHEN 1 THEN 'proof ' ELSE '' END || 'fn f_' || (k % 11) || '_' || c || '<T: Eq + Clone>(x: &Seq<T>, n: u64) -> (r: bool)'",
    "CASE WHEN k % 2 = 0 THEN '    requires n < ' || (k % 13) || ', x.len() > 0' ELSE '    // no requires' END",
    "CASE WHEN k % 3 = 0 THEN '    ensures r == (n > 0)' ELSE '    // no ensures' END",
    "'{'",
    "'    ' || CASE k % 5 WHEN 0 THEN 'assume(n > 0);' WHEN 1 THEN 'admit();' WHEN 2 THEN 'proof { assert(n >= 0) by { } }' WHEN 3 THEN 'let s = \"assume(x) fn q() { }\"; /* fn q2() { } */' ELSE 'assume(false);' END",
    "'    n == ' || (k % 13)",
    "'}'",
    "CASE k % 4 WHEN 0 THEN '#[verifier::external_body] // accept hole: known' WHEN 1 THEN '#[verifier::external_body]' ELSE '// plain' END",
    "'pub fn rec_' || (k % 12) || '(n: u64) -> u64' || CASE WHEN k % 4 = 3 THEN ' requires n > 0 ensures true' ELSE '' END || ' { rec_' || (k % 12) || '(n) }'",
    "'proof fn lemma_' || (k % 6) || '_len() ensures forall|i: int| ' || CASE WHEN k % 3 = 0 THEN '#[trigger] g(i) == i' ELSE 'i == i' END || ' { }'",
    "CASE WHEN k % 3 = 1 THEN 'proof fn plain_' || (k % 5) || '() { }' ELSE 'axiom fn axiom_' || CASE WHEN k % 9 < 3 THEN 'seq' WHEN k % 9 < 6 THEN 'mul' ELSE 'zzz' END || '_' || (k % 5) || '();' END",
    "'spec fn ' || CASE WHEN k % 2 = 0 THEN 'wf_' ELSE 'ok_' END || (k % 4) || '() -> bool { ' || CASE WHEN k % 4 < 2 THEN 'true' ELSE 'false' END || ' }'",
    "'broadcast use { vstd::seq::group_seq_axioms, crate::g::group_' || (k % 5) || ' };'",
    "'fn main_' || (k % 3) || '() ensures true { let ghost ' || CASE WHEN k % 4 = 0 THEN 'ghost_a' ELSE 'abc' END || ' = 1;' || CASE WHEN k % 3 = 0 THEN ' old(a);' ELSE '' END || ' }'",
    "CASE k % 4 WHEN 0 THEN 'impl Debug for S' || (k % 9) || '<u8> { }' WHEN 1 THEN 'impl RwLockPredicate for E' || (k % 4) || ' { open spec fn inv(self) -> bool { true } }' WHEN 2 THEN 'impl View for S' || (k % 9) || '<u8> { type V = Seq<u8>; open spec fn view(&self) -> Seq<u8>; }' ELSE '// no view' END",
    "'} // verus!'",
    "'fn outside(cmp: impl Fn(u64) -> bool) { let t = text.replace(\"fn \", \"\"); if t == u { } }'",
    "'// ----------'",
    "CASE WHEN k % 4 = 1 THEN '#[derive(Clone)]' ELSE '// none' END",
    "CASE k % 4 WHEN 0 THEN 'enum Oe { A } // accept hole: small' WHEN 1 THEN 'struct Out { a: u8 }' ELSE '// none' END",
)


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(project, path, rel_path, dir, stem, content, n_bytes) of the generated tree."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet").selectExpr("p_partkey AS k", "split(p_name, ' ')[0] AS c")
    part = part.repartition(spark.sparkContext.defaultParallelism)  # a few keys a file of ``part`` are many files of the tree
    text = "concat(repeat('// pad\\n', cast(k % 4 AS int)), concat_ws('\\n', " + ", ".join(LINES) + "), '\\n')"
    rel = "concat('proj', k % 5, '/src/Chap', k % 7, '/m', k, '.rs')"
    out = part.selectExpr("concat('proj', k % 5) AS project", f"concat('/w/', {rel}) AS path", f"{rel} AS rel_path", "concat('proj', k % 5, '/src/Chap', k % 7) AS dir", "concat('m', k) AS stem", f"{text} AS content")
    return out.withColumn("n_bytes", F.octet_length("content").cast("bigint"))


#: Lines of a generated library file, over k, the key of a supplier.
LIBRARY_LINES = (
    "'//! Library file ' || k",
    "'pub mod child_' || k || ';'",
    "'macro_rules! ' || CASE WHEN k % 2 = 0 THEN 'seq' ELSE 'other' END || ' { () => { } }'",
    "'verus! {'",
    "CASE WHEN k % 3 = 0 THEN '#[verifier::external_body]' ELSE '// none' END",
    "'pub ' || CASE WHEN k % 4 = 1 THEN 'tracked ' ELSE '' END || 'struct ' || CASE k % 5 WHEN 0 THEN 'Seq' WHEN 1 THEN 'PointsTo' ELSE 'Own' || k END || '<A> { a: A }'",
    "'impl<A> ' || CASE k % 5 WHEN 0 THEN 'Seq' WHEN 1 THEN 'PointsTo' ELSE 'Own' || k END || '<A> { pub uninterp spec fn len(self) -> nat; pub open spec fn get(self) -> A { self.a } fn run(self) { } }'",
    "'impl<T> View for ' || CASE k % 3 WHEN 0 THEN 'Option' WHEN 1 THEN 'Vec' ELSE 'Mine' END || '<T> { open spec fn view(&self) -> int { 0 } open spec fn v' || (k % 4) || '(&self) -> int { 0 } }'",
    "'pub assume_specification<T>[ ' || CASE k % 3 WHEN 0 THEN 'Option::<T>::unwrap' WHEN 1 THEN 'Vec::<T>::push' ELSE 'u64::max_value' END || ' ](x: T) -> (r: T)'",
    "CASE WHEN k % 2 = 0 THEN '    requires x.ok(),' ELSE '    ensures r.ok(),' END",
    "';'",
    "'pub broadcast group group_' || CASE WHEN k % 7 = 0 THEN 'vstd_default' ELSE 'g' || k END || ' { lemma_a, lemma_b }'",
    "'pub spec const LIMIT_' || k || ': nat = 3;'",
    "'pub broadcast axiom fn axiom_' || CASE k % 4 WHEN 0 THEN 'mul' WHEN 1 THEN 'seq' WHEN 2 THEN 'ptr' ELSE 'x' END || '_' || k || '(i: int) ensures i == i;'",
    "'pub broadcast proof fn lemma_a() ensures true { assert(1 == 1); }'",
    "'pub exec fn ex() requires true { }'",
    "'pub uninterp spec fn un(x: int) -> bool recommends x > 0;'",
    "'pub enum En' || k || '<A> { One(A), Two }'",
    "'pub type Al' || k || '<A> = Vec<A>;'",
    "'pub trait Tr' || k || ': View + Sized { spec fn a(&self) -> int; proof fn b(&self); fn c(&self); }'",
    "'proof fn user_' || k || '()'",
    "'{ lemma_a(); assert(lemma_a()); }'",
    "'} // verus!'",
)


def library(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(project, path, rel_path, dir, stem, content): a library of one file for each supplier; even keys lie in std_specs."""
    supplier = spark.read.parquet(f"{sf_dir}/supplier.parquet").selectExpr("s_suppkey AS k")
    rel = "concat('vstd/', if(k % 2 = 0, 'std_specs/', ''), 'lib', k, '.rs')"
    return supplier.selectExpr("'vstd' AS project", f"concat('/w/', {rel}) AS path", f"{rel} AS rel_path", "if(k % 2 = 0, 'vstd/std_specs', 'vstd') AS dir", "concat('lib', k) AS stem", "concat(concat_ws('\\n', " + ", ".join(LIBRARY_LINES) + "), '\\n') AS content")


#: For SQL: the rows of ``supplier`` as library files, with the name of the struct and whether it is a ghost type.
LIBRARY_SQL = "lib AS (SELECT s_suppkey AS k, '/w/vstd/' || CASE WHEN s_suppkey % 2 = 0 THEN 'std_specs/' ELSE '' END || 'lib' || s_suppkey || '.rs' AS path, CASE WHEN s_suppkey % 2 = 0 THEN 'std_specs::' ELSE '' END || 'lib' || s_suppkey AS module, CASE s_suppkey % 5 WHEN 0 THEN 'Seq' WHEN 1 THEN 'PointsTo' ELSE 'Own' || s_suppkey END AS own, s_suppkey % 5 = 0 OR (s_suppkey % 3 = 0 AND s_suppkey % 5 <> 1) AS ghost FROM supplier)"
#: For SQL: the rows of ``part`` as files.
FILES_SQL = "files AS (SELECT p_partkey AS k, split_part(p_name, ' ', 1) AS c, p_partkey % 4 AS pad, 'proj' || (p_partkey % 5) AS project, '/w/proj' || (p_partkey % 5) || '/src/Chap' || (p_partkey % 7) || '/m' || p_partkey || '.rs' AS path FROM part)"
#: For SQL: the lines of the files, as text.
LINES_SQL = f"{FILES_SQL}, texts AS (SELECT k, path, pad, list_concat(list_transform(range(pad), lambda i: '// pad'), [{', '.join(LINES)}]) AS ls FROM files), lines AS (SELECT k, path, pad, unnest(range(1, len(ls) + 1)) AS line_no, unnest(ls) AS text FROM texts)"


def _fn(line: str, name: str, mode: str, modifiers: str, more: str, where: str = "true", visibility: str = "''", generics: str = "0", end: str | None = None, kind: str = "'module'", owner: str = "''", block: str = "true") -> str:
    return f"SELECT k, path, project, pad + {line} AS line, pad + {end or line} AS end_line, {name} AS name, {visibility} AS visibility, {mode} AS mode, {modifiers} AS modifiers, {generics} AS n_generics, {more}, {kind} AS kind, {owner} AS owner, {block} AS in_block FROM files WHERE {where}"


def _more(args: str = "''", returns: str = "''", requires: str = "0", ensures: str = "0", assume: str = "false", proof: str = "false") -> str:
    return f"{args} AS args, {returns} AS return_type, {requires} AS n_requires, {ensures} AS n_ensures, {assume} AS has_assume, {proof} AS has_assert, {proof} AS has_proof_block"


_LAST = "CASE WHEN k % 4 = 3 THEN 1 ELSE 0 END"
#: For SQL: every function of every file, from the keys alone.
FNS_SQL = (
    FILES_SQL
    + ", fns AS ("
    + " UNION ALL ".join(
        (
            _fn("13", "'inv'", "'spec'", "'spec'", _more(returns="'bool'"), kind="'trait'", owner="'R' || (k % 10)"),
            _fn("14", "'size'", "'exec'", "''", _more(returns="'(n: u64)'", requires="1", ensures=_LAST), kind="'trait'", owner="'R' || (k % 10)"),
            _fn("17", "'inv'", "'spec'", "'open spec'", _more(returns="'bool'"), kind="'impl_trait'", owner="'S' || (k % 9) || '<T>'"),
            _fn("19", "'new'", "'exec'", "''", _more(returns="'Self'", ensures="1"), "k % 3 = 2", kind="'impl_struct'", owner="'E' || (k % 4)"),
            _fn("19", "'help'", "'proof'", "'proof'", _more(), "k % 3 = 1", kind="'impl_struct'", owner="'E' || (k % 4)"),
            _fn(
                "20", "'f_' || (k % 11) || '_' || c", "CASE k % 3 WHEN 0 THEN 'spec' WHEN 1 THEN 'proof' ELSE 'exec' END", "CASE k % 3 WHEN 0 THEN 'open spec' WHEN 1 THEN 'proof' ELSE '' END",
                _more("'x=&Seq<T> n=u64'", "'(r: bool)'", "CASE WHEN k % 2 = 0 THEN 1 ELSE 0 END", "CASE WHEN k % 3 = 0 THEN 1 ELSE 0 END", "k % 5 IN (0, 4)", "k % 5 = 2"), visibility="'pub'", generics="1", end="26",
            ),
            _fn("28", "'rec_' || (k % 12)", "'exec'", "''", _more("'n=u64'", "'u64'", _LAST, _LAST), visibility="'pub'"),
            _fn("29", "'lemma_' || (k % 6) || '_len'", "'proof'", "'proof'", _more(ensures="1")),
            _fn("30", "'plain_' || (k % 5)", "'proof'", "'proof'", _more(), "k % 3 = 1"),
            _fn("30", "'axiom_' || CASE WHEN k % 9 < 3 THEN 'seq' WHEN k % 9 < 6 THEN 'mul' ELSE 'zzz' END || '_' || (k % 5)", "'axiom'", "'axiom'", _more(), "k % 3 <> 1"),
            _fn("31", "CASE WHEN k % 2 = 0 THEN 'wf_' ELSE 'ok_' END || (k % 4)", "'spec'", "'spec'", _more(returns="'bool'")),
            _fn("33", "'main_' || (k % 3)", "'exec'", "''", _more(ensures="1")),
            _fn("34", "'inv'", "'spec'", "'open spec'", _more(returns="'bool'"), "k % 4 = 1", kind="'impl_trait'", owner="'E' || (k % 4)"),
            _fn("34", "'view'", "'spec'", "'open spec'", _more(returns="'Seq<u8>'"), "k % 4 = 2", kind="'impl_trait'", owner="'S' || (k % 9) || '<u8>'"),
            _fn("36", "'outside'", "'exec'", "''", _more("'cmp=impl Fn(u64) -> bool'"), block="false"),
        )
    )
    + ")"
)


def _finding(line: str, severity: str, kind: str, where: str) -> str:
    return f"SELECT k, path, project, pad + {line} AS line, '{severity}' AS severity, {kind} AS hole_type FROM files WHERE {where}"


#: For SQL: every finding of the audit, and each file's counts.
FINDINGS_SQL = (
    FILES_SQL
    + ", findings AS ("
    + " UNION ALL ".join(
        (
            _finding("4", "E", "'rust_rwlock'", "k % 5 = 0"), _finding("14", "E", "'fn_missing_ensures'", "k % 4 <> 3"), _finding("19", "H", "'unsafe impl'", "k % 3 = 0"),
            _finding("20", "E", "CASE WHEN k % 2 = 0 THEN 'fn_missing_ensures' ELSE 'fn_missing_requires_ensures' END", "k % 3 = 2"),
            _finding("20", "E", "CASE WHEN k % 3 = 0 THEN 'spec_fn_with_holes' ELSE 'proof_fn_with_holes' END", "k % 3 < 2 AND k % 5 IN (0, 1, 4)"),
            _finding("24", "H", "CASE k % 5 WHEN 0 THEN 'assume()' WHEN 1 THEN 'admit()' ELSE 'assume(false)' END", "k % 5 IN (0, 1, 4)"),
            _finding("27", "I", "'external_body'", "k % 4 = 0"), _finding("27", "H", "'external_body'", "k % 4 = 1"), _finding("28", "E", "'fn_missing_requires_ensures'", "k % 4 = 2"),
            _finding("30", "H", "'axiom'", "k % 3 <> 1"), _finding("31", "H", "'trivial_spec_wf'", "k % 4 = 0"),
            _finding("19", "E", "'bare_impl'", "k % 3 = 2"), _finding("34", "E", "'debug_display_inside_verus'", "k % 4 = 0"), _finding("34", "E", "'dummy_rwlock_predicate'", "k % 4 = 1"),
            _finding("39", "E", "'struct_outside_verus'", "k % 4 = 1"), _finding("39", "E", "'clone_derived_outside'", "k % 4 = 1"), _finding("39", "I", "'enum_outside_verus_accept_hole'", "k % 4 = 0"),
        )
    )
    + """), status AS (SELECT f.k, f.path, f.project, 'Chap' || (f.k % 7) || '::m' || f.k AS module, count(*) FILTER (WHERE severity = 'H') AS n_holes, count(*) FILTER (WHERE severity = 'E') AS n_errors, count(*) FILTER (WHERE severity IN ('H', 'E')) > 0 AS is_holed
FROM files f LEFT JOIN findings x ON x.k = f.k GROUP BY ALL)"""
)
