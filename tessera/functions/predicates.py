"""Patterns as Columns: matchers for names and texts, and a conjunction for each fact table.

Every matcher is one ``rlike`` or ``contains`` on the lower-case value, so Catalyst pushes and
reorders them like any filter. A name matches at word boundaries, ``_`` being one; a text matches
as a substring unless the pattern ends in ``!``.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.pattern import Pattern

TRUE = F.lit


def quoted(text: str) -> str:
    return re.sub(r"([\\.^$|?*+()\[\]{}\-&#~ ])", r"\\\1", text)


def word_regex(word: str) -> str:
    """The word between characters that are no letters or digits; ``_`` is a boundary."""
    return rf"(?<![\p{{L}}\p{{N}}]){quoted(word)}(?![\p{{L}}\p{{N}}])" if word else ""


def wildcard_regex(pattern: str) -> str:
    """Parts in order, anything between them; anchored at the start unless ``.*`` stands there."""
    body = "[\\s\\S]*?".join(quoted(p) for p in pattern.split(".*") if p)
    return body if pattern.startswith(".*") else f"^{body}"


def _wild(value: Column, pattern: str) -> Column:
    return value.rlike(wildcard_regex(pattern))


def _word(value: Column, word: str) -> Column:
    return value.rlike(word_regex(word)) if word else F.lit(True)


def _expression(inner: str, part) -> Column:
    """OR (``\\|``) of ANDs (``\\&``); empty parts are true."""
    ands = [[x.strip() for x in alternative.split("\\&")] for alternative in inner.split("\\|")]
    return reduce(or_, (reduce(and_, (part(x) if x else F.lit(True) for x in some)) for some in ands))


def name_match(value: Column, pattern: str) -> Column:
    pattern, value = pattern.strip(), F.lower(value)
    if pattern == "_":
        return F.lit(True)
    one = lambda x: _wild(value, x.lower()) if ".*" in x else _word(value, x.lower())
    if pattern.startswith("\\(") and pattern.endswith("\\)"):
        return _expression(pattern[2:-2], one)
    return one(pattern)


def text_match(value: Column, pattern: str) -> Column:
    pattern, value = pattern.strip(), F.lower(value)
    if pattern == "_":
        return F.lit(True)
    plain = lambda x: _word(value, x.rstrip("!").lower()) if x.endswith("!") else F.contains(value, F.lit(x.lower()))
    if pattern.startswith("\\(") and pattern.endswith("\\)"):
        return _expression(pattern[2:-2], plain)
    if pattern.endswith("!") or ".*" not in pattern:
        return plain(pattern)
    return _wild(value, pattern.lower())


# -- conjunctions; the columns are those of the fact tables


def _joined(array: str) -> Column:
    return F.array_join(F.coalesce(F.col(array), F.array()), " ")


def _generics() -> Column:
    return F.array_join(F.transform("generics", lambda g: F.concat_ws(" ", g["name"], F.array_join(g["bounds"], " "))), " ")


def _all(parts: list[Column]) -> Column:
    return reduce(and_, parts, F.lit(True))


def fn_filter(p: Pattern) -> Column:
    """Cheap conditions first: Spark keeps their order."""
    args = F.array_join(F.transform("args", lambda a: a["ty"]), " ")
    returned = F.coalesce("return_type", F.lit(""))
    anywhere = F.concat_ws(" ", _generics(), args, returned, _joined("recommends"), _joined("requires"), _joined("ensures"))
    parts = [F.col(flag) for flag in ("is_unsafe", "has_proof_block", "has_assert", "has_unsafe_block", "has_assume", "has_assume_new") if getattr(p, flag)]
    parts += [F.size("generics") > 0] if p.requires_generics else []
    parts += [F.array_contains("modifiers", m) for m in p.required_modifiers]
    parts += [F.size(c) > 0 for c in ("recommends", "requires", "ensures") if getattr(p, f"has_{c}")]
    parts += [name_match(F.col("name"), p.name)] if p.name is not None else []
    for patterns, value in (
        (p.generics_patterns, _generics()), (p.returns_patterns, returned), (p.types_patterns, anywhere), (p.arg_type_patterns, args),
        (p.recommends_patterns, _joined("recommends")), (p.requires_patterns, _joined("requires")), (p.ensures_patterns, _joined("ensures")),
        (p.attribute_patterns, _joined("attributes")), (p.body_patterns, F.col("body_text")),
    ):
        parts += [text_match(value, x) for x in patterns]
    return _all(parts)


def _members(p: Pattern) -> list[Column]:
    def has_type(pattern: str) -> Column:
        return F.exists("body_types", lambda t: name_match(t, pattern))

    parts = [has_type(x) for x in p.body_type_patterns]
    if p.body_fn_name or p.body_fn_args or p.body_fn_return:

        def one(m: Column) -> Column:
            own = [name_match(m["name"], p.body_fn_name)] if p.body_fn_name else []
            own += [text_match(F.array_join(m["args"], " "), a) for a in p.body_fn_args]
            own += [text_match(F.coalesce(m["return_type"], F.lit("")), p.body_fn_return)] if p.body_fn_return else []
            return _all(own)

        parts.append(F.exists("body_methods", one))
    return parts + [text_match(F.col("body_text"), x) for x in p.impl_body_patterns]


def impl_filter(p: Pattern) -> Column:
    parts = [F.col("is_unsafe")] if p.is_unsafe else []
    parts += [F.size("generics") > 0] if p.requires_generics else []
    if p.impl_trait not in (None, "_"):
        parts.append(F.col("trait_name").isNotNull() & name_match(F.col("trait_name"), p.impl_trait))
    parts += [text_match(F.col("for_type"), p.impl_for_type)] if p.impl_for_type is not None else []
    parts += [text_match(_joined("attributes"), x) for x in p.attribute_patterns]
    return _all(parts + _members(p))


def trait_filter(p: Pattern) -> Column:
    """All but the bounds, which need the closure over traits."""
    parts = [F.size("generics") > 0] if p.requires_generics else []
    parts += [name_match(F.col("name"), p.name)] if p.name is not None else []
    parts += [text_match(_joined("attributes"), x) for x in p.attribute_patterns]
    return _all(parts + _members(p))


def type_filter(p: Pattern, kind: str) -> Column:
    """Structs, enums and aliases (kind 'type'), by name, generics, attributes and field types."""
    parts = [F.col("kind") == ("alias" if kind == "type" else kind)]
    parts += [F.size("generics") > 0] if p.requires_generics else []
    parts += [name_match(F.col("name"), p.name)] if p.name is not None else []
    parts += [text_match(_joined("attributes"), x) for x in p.attribute_patterns]
    patterns = {"struct": p.struct_field_patterns, "enum": p.enum_variant_patterns}.get(kind, [])
    return _all(parts + [text_match(_joined("field_types"), x) for x in patterns])


def holes_filter() -> Column:
    return F.col("has_assume") | F.col("has_assume_new") | F.col("has_unsafe_block") | F.col("is_unsafe")
