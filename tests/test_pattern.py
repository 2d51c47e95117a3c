"""The pattern language as a table of inputs and the fields they set."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.functions.pattern import Pattern, parse_pattern

CASES = [
    ("set", {"name": "set"}),
    ("fn _", {"name": "_"}),
    ("fn lemma_.*_len", {"name": "lemma_.*_len"}),
    ("proof fn x", {"name": "x", "required_modifiers": ["proof"]}),
    ("PROOF fn x", {"name": "x", "required_modifiers": ["proof"]}),
    ("open spec fn x", {"name": "x", "required_modifiers": ["open", "spec"]}),
    ("pub fn x", {"name": "x"}),
    ("broadcast proof fn x", {"name": "x", "required_modifiers": ["broadcast", "proof"]}),
    ("axiom fn x", {"name": "x", "required_modifiers": ["axiom"]}),
    ("proof {} fn x", {"name": "x", "has_proof_block": True}),
    ("proof { } fn x", {"name": "x", "has_proof_block": True}),
    ("proof {", {"has_proof_block": True}),
    ("unsafe {}", {"has_unsafe_block": True}),
    ("unsafe fn x", {"name": "x", "is_unsafe": True}),
    ("unsafe impl X", {"is_unsafe": True, "is_impl_search": True, "impl_trait": "X"}),
    ("generics", {"requires_generics": True}),
    ("<_>", {"requires_generics": True}),
    ("fn <_> x", {"name": "x", "requires_generics": True}),
    ("generics View, Eq", {"generics_patterns": ["View", "Eq"]}),
    ("types Seq, int", {"types_patterns": ["Seq", "int"]}),
    ("args Seq", {"types_patterns": ["Seq"]}),
    ("Seq^+", {"types_patterns": ["Seq"]}),
    ("fn x ( : Seq , : int )", {"name": "x", "arg_type_patterns": ["Seq", "int"]}),
    ("fn x ( Seq, int )", {"name": "x", "arg_type_patterns": ["Seq", "int"]}),
    ("fn x -> bool", {"name": "x", "returns_patterns": ["bool"]}),
    ("-> Seq int", {"returns_patterns": ["Seq", "int"]}),
    ("requires", {"has_requires": True}),
    ("requires finite ensures len", {"has_requires": True, "requires_patterns": ["finite"], "has_ensures": True, "ensures_patterns": ["len"]}),
    ("recommends a b", {"has_recommends": True, "recommends_patterns": ["a", "b"]}),
    ("assert", {"has_assert": True}),
    ("assume", {"has_assume": True}),
    ("assume_new", {"has_assume_new": True}),
    ("holes", {"is_holes_search": True}),
    ("body a b", {"body_patterns": ["a", "b"]}),
    ("#[verifier::external_body]", {"attribute_patterns": ["verifier::external_body"]}),
    ("#[cfg(feature = x)] fn y", {"attribute_patterns": ["cfg(feature = x)"], "name": "y"}),
    ("impl View for Seq", {"is_impl_search": True, "impl_trait": "View", "impl_for_type": "Seq"}),
    ("impl <_> _ for Seq", {"is_impl_search": True, "impl_trait": "_", "impl_for_type": "Seq", "requires_generics": True}),
    ("for Seq", {"is_impl_search": True, "impl_for_type": "Seq"}),
    ("impl View { type V; fn view -> Seq; foo }", {"is_impl_search": True, "impl_trait": "View", "body_type_patterns": ["V"], "body_fn_name": "view", "body_fn_return": "Seq", "impl_body_patterns": ["foo"]}),
    ("impl { fn a (int) }", {"is_impl_search": True, "body_fn_name": "a", "body_fn_args": ["int"]}),
    ("trait X : A + B", {"is_trait_search": True, "name": "X", "trait_bounds": ["A", "B"]}),
    ("trait : View", {"is_trait_search": True, "trait_bounds": ["View"]}),
    ("trait X { fn y }", {"is_trait_search": True, "name": "X", "body_fn_name": "y"}),
    ("type X = Seq", {"is_type_search": True, "name": "X", "type_value": "Seq"}),
    ("type = Seq", {"is_type_search": True, "type_value": "Seq"}),
    ("struct S { : int, : u8 }", {"is_struct_search": True, "name": "S", "struct_field_patterns": ["int", "u8"]}),
    ("struct _ { int, u8 }", {"is_struct_search": True, "name": "_", "struct_field_patterns": ["int", "u8"]}),
    ("enum E { : int }", {"is_enum_search": True, "name": "E", "enum_variant_patterns": ["int"]}),
    ("def X", {"is_def_search": True, "name": "X"}),
    ("one two", {"name": "one"}),
    ("", {}),
]


@pytest.mark.parametrize(("text", "expected"), CASES)
def test_fields(text, expected):
    got = {k: v for k, v in vars(parse_pattern(text)).items() if v != getattr(Pattern(), k)}
    assert got == expected


@pytest.mark.parametrize(("text", "kind"), [("holes impl X", "holes"), ("impl X", "impl"), ("trait X", "trait"), ("type X", "type"), ("struct X", "struct"), ("enum X", "enum"), ("def X", "def"), ("fn X", "fn")])
def test_kind(text, kind):
    assert parse_pattern(text).kind == kind


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("{}();:,<>_-=#[]^+ab ")) | st.characters(), max_size=40))
def test_any_text_parses(text):
    parse_pattern(text)
