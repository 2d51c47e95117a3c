from pyspark.sql import functions as F

from tessera.operators import edits, extract, fixes
from tessera.plans import report

TEXT = """// ======
verus! {
fn a() { assume(x); }
// --- not only
trait T { }
impl S { }
impl SIter { }
forall|i| #![auto] a[i]
}
"""


def applied(files, table):
    return edits.apply_edits(files, table).head()["content"]


def test_fixes(spark, tmp_path):
    files = spark.createDataFrame([("p", TEXT)], "path string, content string")
    assert applied(files, fixes.delete_separators(files)) == TEXT.replace("// ======\n", "")
    groups = spark.createDataFrame([("p", "b"), ("p", "a"), ("p", "a")], "path string, group string")
    assert "verus! {\nbroadcast use {a, b};\nfn a" in applied(files, fixes.insert_broadcast(files, groups))
    assert "fn a() { proof { accept(x); }; }" in applied(files, fixes.accept_assumes(files, extract.facts(files, "findings")))
    holes = """use a;
verus! {
// why
use b;
#[verifier::external_body]
fn e() { assume(f(g(1), 2) && (3)); }
fn o() { assume (
false); }
}
"""
    files2 = spark.createDataFrame([("q", holes)], "path string, content string")
    fixed = applied(files2, fixes.accept_assumes(files2, extract.facts(files2, "findings"), "use crate::accept::accept;"))
    assert fixed == holes.replace("use b;\n", "use b;\nuse crate::accept::accept;\n").replace("external_body]", "external_body] // accept hole").replace("assume(f(g(1), 2) && (3));", "proof { accept(f(g(1), 2) && (3)); };")
    again = spark.createDataFrame([("q", fixed)], "path string, content string")
    assert "accept hole // accept hole" not in applied(again, fixes.accept_assumes(again, extract.facts(again, "findings"), "use crate::accept::accept;"))
    assert fixed.count("use crate::accept") == 1
    triggers = spark.createDataFrame([("p", 8, "a[i]")], "path string, line_no int, trigger string")
    assert "#![trigger a[i]] a[i]" in applied(files, fixes.replace_triggers(files, triggers))
    off = applied(files, fixes.comment_out(files, spark.createDataFrame([("p", 3, 4)], "path string, first int, last int")))
    assert off.count(fixes.MARKER) == 2
    back = spark.createDataFrame([("p", off)], "path string, content string")
    assert applied(back, fixes.restore(back)) == TEXT
    assert [r["for_type"] for r in fixes.bare_impls(extract.facts(files, "impls"), extract.facts(files, "traits")).collect()] == ["S"]
    df = spark.range(5).orderBy("id").withColumn("x", F.lit("a|b"))
    assert report.markdown(df, "T", 2) == "# T\n\n| id | x |\n|---|---|\n| 0 | a\\|b |\n| 1 | a\\|b |\n\n+3 more\n"
    report.write_report(df, str(tmp_path / "r"))
    assert spark.read.text(str(tmp_path / "r")).count() == 5


def test_comment_fixes(spark):
    made = lambda text: spark.createDataFrame([("p", text)], "path string, content string")
    text = "//! Copyright (c) me\n//! more\n  /// one\n  /// two\n\n/// - done\n/// three\n/// alone here\n\n/// single\nfn f() { }\n"
    assert applied(made(text), fixes.doc_copyrights(made(text))).startswith("// Copyright (c) me\n//! more\n")
    assert "  /// - one\n  /// - two\n\n/// - done\n/// three\n/// alone here\n\n/// single" in applied(made(text), fixes.bullets(made(text)))
    head = lambda t: applied(made(t), fixes.headers(made(t), "Copyright x", "SPDX-License-Identifier: MIT"))
    assert head("fn a() { }\n") == "// Copyright x\nfn a() { }\n" and head("//! doc\n") == "// Copyright x\n//! doc\n" and head("// other\nfn a() { }\n") == "// other\nfn a() { }\n"
    assert head("// copyright y\nfn a() { }\n") == "// copyright y\n// SPDX-License-Identifier: MIT\nfn a() { }\n"


def test_datatype_invariants(spark):
    from tessera.plans import reviews

    text = "verus! {\nstruct A { the_inv: bool, x: u8 }\nfn a_inv(x: A) -> bool { true }\nenum B { C }\n}\n"
    rows = reviews.datatype_invariants(extract.facts(spark.createDataFrame([("p", text)], "path string, content string"), "types")).collect()
    assert {(r["kind"], r["n"], r["n_with_field"], r["n_with_fn"]) for r in rows} == {("struct", 1, 1, 1), ("enum", 1, 0, 0)}
