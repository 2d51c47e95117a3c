"""Style rules and project relations on small sources."""

import pytest

from tessera.plans.style import style
from tessera.sources import projects

GOOD = """use vstd::prelude::*;

verus! {
broadcast use {vstd::set::group_set_axioms, crate::A::group_a};
pub trait Shape { fn area(&self) -> u64 requires true, ensures true; }
impl Shape for Box1 { fn area(&self) -> (a: u64) requires true ensures true { 1 } }
}
"""
BAD = """use crate::A::thing;
use std::fmt;
use crate::B::*;
use std::io;
verus! {
broadcast use {crate::A::group_a, vstd::set::group_set_axioms};
pub trait Lonely<T: Eq> { fn area(&self) -> u64; spec fn s(&self) -> bool { true } }
spec fn free(x: int) -> (r: int) { x }
fn generic<T: Ord>(x: T) { }
impl Debug for Thing { }
}
impl Clone for Thing { }
impl Other for Thing { }
struct Thing { x: Set<u8> }
"""


@pytest.fixture(scope="module")
def failing(spark):
    files = spark.createDataFrame([("/p/good.rs", GOOD), ("/p/bad.rs", BAD), ("/p/ok.rs", BAD + "// STYLE ACCEPTED\n")], "path string, content string")
    rows = style(files).collect()
    assert {r["rule"] for r in rows} == set(range(25))
    return {p: {r["rule"] for r in rows if r["path"] == f"/p/{p}.rs" and not r["ok"]} for p in ("good", "bad", "ok")}


def test_rules(failing):
    assert failing["good"] == set() and failing["ok"] == set()
    assert failing["bad"] == {2, 4, 7, 10, 12, 13, 14, 15, 18, 19, 20, 21, 22, 23}


def test_projects(spark):
    m = [("/r/a/Cargo.toml", "[package]"), ("/r/a/sub/Cargo.toml", "[package]"), ("/r/Cargo.toml", "[workspace]\n"), ("/r/b/c/Cargo.toml", "[package]")]
    assert {r["dir"] for r in projects.projects(spark.createDataFrame(m, "path string, content string")).collect()} == {"/r/a", "/r/b/c"}
    files = spark.createDataFrame([("p1", "src/X.rs", "X"), ("p2", "tests/TestX.rs", "TestX"), ("p3", "tests/test_X.rs", "test_X"), ("p4", "benches/X.rs", "X"), ("p5", "a/b/c/X.rs", "X")], "path string, rel_path string, stem string")
    found = projects.module_files(files, spark.createDataFrame([("X",)], "module string")).collect()
    assert {(r["kind"], r["path"]) for r in found} == {("src", "p1"), ("tests", "p3"), ("benches", "p4")}
    assert [r["path"] for r in projects.named_files(files, "X.rs", max_depth=2).collect()] == ["p1", "p4"]


def test_modules_in_text(spark):
    text = 'pub mod One {\n  #[cfg(feature = "all")]\n  pub mod inner;\n  pub mod open;\n}\n// pub mod off;\n#[cfg(feature = "x")]\nmod top;\n'
    files = spark.createDataFrame([("p", text)], "path string, content string")
    assert [(r["feature"], r["module"], r["chapter"]) for r in projects.gated_modules(files).orderBy("line_no").collect()] == [("all", "inner", "One"), ("x", "top", None)]
    assert [r["module"] for r in projects.commented_modules(files).collect()] == ["off"]
