"""Reviewers and coverage on small sources."""

import pytest
from pyspark.sql import functions as F

from tessera.functions.lexer import code_texts, is_text, is_word, tokens
from tessera.operators.extract import facts
from tessera.plans import coverage, reviews
from tessera.plans.registry import QUERIES

SOURCE = """use std::fmt;
use std::io;

use vstd::set::*;
verus! {
broadcast use {vstd::set::group_set_axioms, vstd::map::group_map_axioms};
pub broadcast axiom fn axiom_seq_len(s: Seq<int>) ensures true;
spec fn unused(x: int) -> int { x }
spec fn fact(n: nat) -> nat { if n == 0 { 1 } else { n * fact((n - 1) as nat) } }
proof fn lemma_a<T: PartialEq>(a: T) requires a == a ensures true { assert(a == a) by { } }
fn run(f: impl Fn(u8) -> bool, n: u64) -> u64 requires n > 0 ensures n > 0 {
    let ghost x = 1;
    let tracked tracked_y = 2;
    while i < n invariant i <= n { i = i + 1; }
    proof { assert(forall|i: int| #![trigger a[i]] a[i] > 0); }
    loop { }
    if forall { }
}
pub trait T { fn a(&self); fn b(&self) { } }
impl View for Thing { }
}
struct Thing { a: Set<u8> }
struct Other;
// one
// two
fn lint() { if source.contains("fn ") { } let y = node.contains("zzz"); }
"""
SPECS = """pub struct ExVec<T>(Vec<T>);
pub assume_specification<T>[ Vec::<T>::push ](v: &mut Vec<T>, x: T)
    ensures true;
pub assume_specification<T>[ Option::is_some ](x: T)
    requires true;
pub assume_specification<T>[ <Vec<T> as Clone>::clone ](x: T);
pub assume_specification<T>[ T::skip ](x: T);
"""


@pytest.fixture(scope="module")
def files(spark):
    return spark.createDataFrame([("/p/a.rs", SOURCE), ("/p/vstd/b.rs", SPECS)], "path string, content string").persist()


@pytest.fixture(scope="module")
def fns(files):
    return facts(files, "fns").persist()


def rows(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


def test_function_reviews(files, fns):
    assert rows(reviews.clause_coverage(fns).where("mode = 'proof'"), "n", "requires_header", "ensures_header") == [(1, 1, 1)]
    assert rows(reviews.spec_exec_ratio(fns), "n_spec", "n_exec") == [(2, 4)]
    assert rows(reviews.proof_coverage(fns), "n_exec", "with_proof") == [(4, 1)]
    assert rows(reviews.proof_structure(fns), "n_proof_fns", "n_lemmas", "n_proof_blocks", "n_assert_by") == [(1, 1, 1, 1)]
    assert rows(reviews.invariants(fns), "n_loops", "n_with_invariant") == [(2, 1)]
    assert rows(reviews.termination(fns), "name") == [("fact",)]
    assert rows(reviews.exec_purity(fns), "name") == [("run",)]
    assert rows(reviews.comparators(fns), "name") == [("run",)]
    assert rows(reviews.generic_equality(fns), "name", "line", "n_eq", "n_ne") == [("lemma_a", 10, 1, 0)]
    assert rows(reviews.axioms(fns), "name", "class", "in_library") == [("axiom_seq_len", "set_theoretic", False)]
    assert rows(reviews.unused_spec_fns(fns, facts(files, "tokens")), "name") == [("unused",)]


def test_function_reviews_in_one_pass(files, fns):
    named = ("path", "line", "name")
    expected = [("termination", *r) for r in rows(reviews.termination(fns), *named, "mode")] + [("purity", *r, "") for r in rows(reviews.exec_purity(fns), *named)]
    expected += [("comparator", *r[:3], str(r[3])) for r in rows(reviews.comparators(fns), *named, "n_operators")] + [("equality", *r[:3], f"{r[3]} {r[4]}") for r in rows(reviews.generic_equality(fns), *named, "n_eq", "n_ne")]
    expected += [("view", *r[:3], str(r[3]).lower()) for r in rows(reviews.view_coverage(facts(files, "types"), facts(files, "impls")), *named, "has_view")]
    assert {r[0] for r in expected} == {"termination", "purity", "comparator", "equality", "view"}
    assert rows(reviews.function_reviews(files), "what", *named, "detail") == sorted(expected)


def test_query_of_function_reviews_reads_sources_once(spark, sf_dir):
    plan = QUERIES["src_function_reviews"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Join" not in plan


@pytest.mark.parametrize("text", [SOURCE, SPECS, "", "a /* b */ c", "a /* b /* c */ d */ e /// f", "/*/ a */ b", "a /* left open", 'r"a \\" b', 'br#"a" b"# c', 'r#type x', "b'\"' 'a 'b' b\"c\\\"d\" e", '/// "one\nfn f() { "two /* three" } // r"four', '"left open', "\x1cx\u2003y\xa0²3 1.5 a..=b <==> ==> '"])
def test_texts_without_objects_are_those_of_tokens(text):
    every = tokens(text)
    own = [t for t in every if t.kind != "comment"]
    assert code_texts(text) == ([t.text for t in own], [t.start for t in own], [(t.text, t.start) for t in every if t.text.startswith("///")])
    assert all(t.end - t.start == len(t.text) and is_word(t.text) == (t.kind == "word") and is_text(t.text) == (t.kind == "text") for t in own)


def test_file_reviews(files):
    assert rows(reviews.triggers(files).where("n_quantifiers > 0"), "n_quantifiers", "n_with_triggers") == [(1, 1)]
    assert rows(reviews.broadcast_use(files), "name", "n") == [("vstd::map::group_map_axioms", 1), ("vstd::set::group_set_axioms", 1)]
    assert rows(reviews.ghost_naming(files), "kind", "name") == [("ghost", "x")]
    assert rows(reviews.default_methods(facts(files, "traits")), "n_traits", "n_methods", "n_default") == [(1, 2, 1)]
    assert rows(reviews.view_coverage(facts(files, "types"), facts(files, "impls")).where("path = '/p/a.rs'"), "name", "has_view") == [("Other", False), ("Thing", True)]
    assert rows(reviews.string_manipulation(files), "receiver", "literal") == [("source", "fn ")]
    assert ("vstd::set_lib::group_set_lib_default",) in rows(reviews.recommended_groups(files), "group") and ("vstd::set::group_set_axioms",) not in rows(reviews.recommended_groups(files).where("path = '/p/a.rs'"), "group")
    assert rows(reviews.wrapped_methods(files), "method", "wrapper", "has_requires", "has_ensures")[1:3] == [("Option::is_some", "ExVec", True, False), ("T::skip", "ExVec", False, False)]
    assert rows(reviews.comment_blocks(files), "n") == [(2,)]
    assert rows(reviews.import_groups(files), "root", "contiguous", "blank_after") == [("std", True, True), ("vstd", True, False)]


def test_states(spark):
    cases = [(0, 0, 0, "Empty"), (0, 0, 2, "Blocked"), (0, 2, 0, "Ported"), (2, 0, 0, "Verified"), (1, 1, 0, "Partial"), (0, 1, 1, "Blocked")]
    df = spark.createDataFrame(cases, "v int, p int, g int, s string")
    assert df.where(reviews.state(F.col("v"), F.col("p"), F.col("g")) != F.col("s")).count() == 0


def test_coverage(spark, files):
    got = rows(coverage.specified_methods(files), "owner", "item")
    assert got == [("alloc::vec::Vec", "clone"), ("alloc::vec::Vec", "push"), ("core::option::Option", "is_some")]
    usage = spark.createDataFrame([("std::vec::Vec", 3), ("std::option::Option", 1), ("x::Y", 4)], "owner string, n bigint")
    assert rows(coverage.type_coverage(usage, coverage.specified_methods(files)), "owner", "n", "covered", "percent") == [("alloc::vec::Vec", 3, True, 37.5), ("core::option::Option", 1, True, 12.5), ("x::Y", 4, False, 50.0)]
    ir = '(Fun :path "vstd!set.Set.insert.") (module_id (Fun :path "vstd!seq.Seq.x.")) (Typ Datatype (Dt Path "alloc!vec.Vec.")) (Fun :path "core!zzz.thing.")'
    used = coverage.ir_usage(spark.createDataFrame([("/r/proj/dir/crate.vir", ir), ("/r/vstd/dir/crate.vir", ir)], "path string, content string"))
    assert ("proj", "Set", "insert") in [tuple(r) for r in used.collect()] and ("proj", "Vec", None) in [tuple(r) for r in used.collect()] and {r["project"] for r in used.collect()} == {"proj"}
    status = coverage.module_status(spark.createDataFrame([("std::a",), ("x::b",), ("q",)], "module string"), spark.createDataFrame([("core::a", "wrapped"), ("b", "last")], "name string, status string"))
    assert rows(status, "module", "status") == [("q", "missing"), ("std::a", "wrapped"), ("x::b", "last")]
    paths = spark.createDataFrame([("alloc::vec::Vec::push", 5), ("alloc::vec::Vec::pop", 2), ("std::io::Read::x", 9), ("a::File::y", 1), ("a::B::to_string", 1), ("a::C::z", 1)], "path string, n bigint")
    assert rows(coverage.impact(paths), "owner", "n_methods", "n_uses") == [("Vec", 2, 7)]
    assert rows(paths.select(coverage.exact_key(F.lit("alloc::vec::Vec::<T>::push")).alias("k")).limit(1), "k") == [("Vec::push",)]
