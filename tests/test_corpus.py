"""Extraction, search, audit, edits and sources over a small hand-written tree."""

import pytest

from tessera.functions.lexer import blocks, code, split_top, tokens
from tessera.operators import edits, extract
from tessera.plans import audit, search
from tessera.sources.files import lines, markdown_table, read_files, spans_of_paths, usage_log

A = """use crate::B::list::push;
// fn in_comment() {}
verus! {
/// Length of a set.
pub open spec fn set_len<T: Eq + Hash>(s: Set<T>, n: nat) -> nat recommends n > 0 { s.len() }
proof fn lemma_set(a: int) requires a > 0, ensures a >= 0 { assume(false); assert(a > 0); }
proof fn lemma_seq(a: Seq<int>) ensures a.len() >= 0 { }
pub trait Base { fn size(&self) -> nat; }
pub trait Middle: Base { }
pub trait Top: Middle + Other<u8> { type V; fn view(&self) -> Seq<u8> { seq![] } }
impl<K> Top for Store<K> { type V = u8; fn view(&self) -> Seq<u8> { seq![] } }
}
pub struct Store<K> { pub items: Vec<K>, n: u8 }
enum Kind { One(u8, Set<u8>), Two { x: i8 }, Three }
type Alias = Store<u8>;
type Second = Alias;
"""
B = """verus! {
#[verifier::external_body] // accept hole
fn push(x: u64) -> u64 requires x > 0 ensures true { unsafe { x } }
spec fn thing_wf(x: int) -> bool { true }
}
fn text() { let s = "fn fake() { unsafe { } }"; }
"""


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for name, text in {"one/src/A.rs": A, "two/src/B/list.rs": B, "two/target/x.rs": A, "two/.git/y.rs": A, "two/attic/z.rs": A, "two/src/notes.md": "x"}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    return read_files(spark, str(root)).persist()


def test_lexer():
    assert [t.text for t in code("a /* b /* c */ d */ 'e 'f' r#\"g\"h\"# // i\nj")] == ["a", "'e", "'f'", 'r#"g"h"#', "j"]
    assert [t.kind for t in tokens("x // y")] == ["word", "comment"]
    assert split_top("A<B, C>, D, fn(E) -> F") == ["A<B, C>", "D", "fn(E) -> F"]
    assert blocks('// verus! { }\nlet a = "verus! {";') == []
    assert len(blocks("verus! { a { b } } verus_! { }")) == 2
    assert tokens("/* open") and tokens('"open') and tokens("'")


def test_scan(files):
    rows = {(r["project"], r["rel_path"], r["dir"], r["stem"]) for r in files.collect()}
    assert rows == {("one", "one/src/A.rs", "one/src", "A"), ("two", "two/src/B/list.rs", "two/src/B", "list")}
    assert lines(files).where("path like '%A.rs'").count() == len(A.splitlines())


def found(files, pattern):
    return [r["name"] for r in search.search(files, pattern).collect()]


@pytest.mark.parametrize(
    ("pattern", "names"),
    [
        ("fn set", ["set_len", "lemma_set"]), ("proof fn _", ["lemma_set", "lemma_seq"]), ("fn _ generics Hash", ["set_len"]), ("requires", ["lemma_set", "push"]), ("fn _ -> u64", ["push"]),
        ("recommends n", ["set_len"]), ("fn _ ( : Seq )", ["lemma_seq"]), ("assert", ["lemma_set"]), ("holes", ["lemma_set", "push"]), ("#[external_body]", ["push"]), ("fn in_comment", []), ("fn fake", []),
        ("impl Top for Store", ["Store<K>"]), ("impl _ { fn view -> Seq }", ["Store<K>"]), ("impl Other", []), ("trait : Base", ["Middle", "Top"]), ("trait : Base + Other", ["Top"]), ("trait _ { type V }", ["Top"]),
        ("struct _ { : Vec }", ["Store"]), ("struct _ { : Set }", []), ("enum _ { : i8 }", ["Kind"]), ("type = Store", ["Alias", "Second"]), ("def Store", ["Store"]), ("def _", ["Base", "Middle", "Top", "Store", "Kind", "Alias", "Second"]),
    ],
)
def test_search(files, pattern, names):
    assert found(files, pattern) == names


def test_locations(files):
    got = {(r["name"], r["location"]["kind"], r["location"]["owner"]) for r in extract.facts(files, "fns").where("name in ('view', 'set_len')").collect()}
    assert got == {("set_len", "module", ""), ("view", "trait", "Top"), ("view", "impl_trait", "Store<K>")}


def test_audit(files):
    out = audit.audit(files)
    kinds = {(r["hole_type"], r["severity"]) for r in out["findings"].collect()}
    assert ("assume(false)", "H") in kinds and ("proof_fn_with_holes", "E") in kinds and ("trivial_spec_wf", "H") in kinds and ("external_body", "I") in kinds
    status = {r["module"]: (r["n_holes"], r["is_holed"]) for r in out["status"].collect()}
    assert status["A"] == (1, True) and status["B::list"][1]
    assert [r["path"].rsplit("/", 1)[1] for r in out["targets"].collect()] == ["list.rs"]
    assert [(r["dep"], r["module"]) for r in out["dependencies"].collect()] == [("B::list", "B::list")]
    top = out["rollup"].where("level = 3").head()
    assert (top["n_files"], top["n_clean"]) == (2, 0)
    assert audit.emacs(out["findings"]).count() == out["findings"].count()


def test_loc_and_comments(files):
    a = extract.facts(files, "loc").where("path like '%A.rs'").head()
    assert (a["proof"], a["total"]) == (2, len(A.splitlines()))
    assert {r["kind"] for r in extract.comments(files).collect()} == {"doc", "plain"}


def test_edits(spark):
    text = "a\nb\nc\nd"
    e = lambda seq, op, a, b, new=None, target=None: {"seq": seq, "op": op, "start": a, "end": b, "text": new, "target": target}
    assert edits.fold(text, [e(1, "delete", 2, 3)]) == "a\nd"
    assert edits.fold(text, [e(1, "insert_after", 1, 1, "x\ny"), e(2, "edit", 2, 2, "B")]) == "a\nx\ny\nB\nc\nd"
    assert edits.fold(text, [e(1, "move_after", 1, 1, None, 4)]) == "b\nc\nd\na"
    assert edits.fold(text, [e(2, "edit", 2, 2, "x"), e(1, "delete", 2, 2)]) == "a\nc\nd"
    files = spark.createDataFrame([("p", text), ("q", text), ("r", None)], "path string, content string")
    table = spark.createDataFrame([("p", 1, "delete", 1, 1, None, None)], "path string, seq int, op string, start int, end int, text string, target int")
    assert {r["path"]: r["content"] for r in edits.apply_edits(files, table).collect()} == {"p": "b\nc\nd", "q": text, "r": None}


def test_text_tables(spark):
    log = "=== 4. METHODS\nTYPE: Vec\n 1. push 10\n 2. pop 7\nTYPE: Set\n 1. insert 3\n=== 9. X\n"
    md = "# A\n|x|y|\n|-|-|\n|no|1|\n# Detail\n|x|y|\n|-|-|\n| f | 2 |\n"
    vp = "fn{a} 1:0-2:5\nnothing\n"
    f = lambda text: spark.createDataFrame([("p", text)], "path string, content string")
    assert [(r["section"], r["owner"], r["item"], r["n"]) for r in usage_log(f(log)).orderBy("owner", "item").collect()] == [(4, "Set", "insert", 3), (4, "Vec", "pop", 7), (4, "Vec", "push", 10)]
    assert [r["cells"] for r in markdown_table(f(md), "Detail").collect()] == [["f", "2"]]
    assert [tuple(r)[1:] for r in spans_of_paths(f(vp)).collect()] == [(1, "fn{a}", 1, 0, 2, 5)]
