"""The search-pattern language: a string of clauses becomes a :class:`Pattern`.

Braces and semicolons are tokens of their own and everything else is split at white space, so a
literal of several words is several patterns. Keywords are found whatever their case. Parsing
never fails: what has no meaning where it stands is skipped, and the first bare word is the name.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

#: Tokens that end a list of patterns.
KEYWORDS = frozenset((
    "proof", "fn", "args", "generics", "types", "requires", "ensures", "spec", "exec", "open", "closed", "broadcast", "pub", "axiom", "impl", "trait", "for", "recommends", "->", "type",
    "struct", "enum", "def", "=", "{", "}", ":", "assert", "body", "(", ")", "unsafe", "assume", "assume_new", "holes",
))
#: Modifiers that a function must carry.
MODIFIERS = frozenset(("spec", "exec", "open", "closed", "broadcast", "axiom"))


@dataclass
class Pattern:
    """A conjunction of optional predicates over one fact table."""

    name: str | None = None
    requires_generics: bool = False
    generics_patterns: list[str] = field(default_factory=list)
    types_patterns: list[str] = field(default_factory=list)
    arg_type_patterns: list[str] = field(default_factory=list)
    returns_patterns: list[str] = field(default_factory=list)
    recommends_patterns: list[str] = field(default_factory=list)
    requires_patterns: list[str] = field(default_factory=list)
    ensures_patterns: list[str] = field(default_factory=list)
    has_recommends: bool = False
    has_requires: bool = False
    has_ensures: bool = False
    required_modifiers: list[str] = field(default_factory=list)
    is_impl_search: bool = False
    impl_trait: str | None = None
    impl_for_type: str | None = None
    is_trait_search: bool = False
    trait_bounds: list[str] = field(default_factory=list)
    is_type_search: bool = False
    type_value: str | None = None
    is_struct_search: bool = False
    struct_field_patterns: list[str] = field(default_factory=list)
    is_enum_search: bool = False
    enum_variant_patterns: list[str] = field(default_factory=list)
    is_def_search: bool = False
    attribute_patterns: list[str] = field(default_factory=list)
    has_proof_block: bool = False
    has_assert: bool = False
    has_unsafe_block: bool = False
    has_assume: bool = False
    has_assume_new: bool = False
    body_patterns: list[str] = field(default_factory=list)
    is_unsafe: bool = False
    is_holes_search: bool = False
    body_type_patterns: list[str] = field(default_factory=list)
    body_fn_name: str | None = None
    body_fn_return: str | None = None
    body_fn_args: list[str] = field(default_factory=list)
    impl_body_patterns: list[str] = field(default_factory=list)

    @property
    def kind(self) -> str:
        """The fact table that is searched: of several kinds asked for, the first of these."""
        if self.is_holes_search:
            return "holes"
        for kind in ("impl", "trait", "type", "struct", "enum", "def"):
            if getattr(self, f"is_{kind}_search"):
                return kind
        return "fn"


class _Tokens:
    def __init__(self, text: str):
        self.items = re.sub(r"([{};])", r" \1 ", text).split()
        self.at = 0

    def now(self) -> str:
        """The token at hand, '' at the end."""
        return self.items[self.at] if self.at < len(self.items) else ""

    def next(self) -> str:
        token = self.now()
        self.at += 1
        return token

    def take(self, *wanted: str) -> bool:
        if self.now() and self.now().lower() in wanted:
            self.at += 1
            return True
        return False

    def free(self) -> bool:
        """Whether a token is at hand that is no keyword."""
        return bool(self.now()) and not is_keyword(self.now())

    def rest_of_clause(self) -> list[str]:
        out = []
        while self.free():
            out.append(self.next())
        return out


def is_keyword(token: str) -> bool:
    return token.lower() in KEYWORDS or token.startswith("#[")


def parse_pattern(text: str) -> Pattern:
    tokens, p = _Tokens(text), Pattern()
    while tokens.now():
        _clause(tokens, p)
    return p


def _generics_mark(t: _Tokens, p: Pattern) -> None:
    while t.take("<_>"):
        p.requires_generics = True


def _commas(t: _Tokens) -> list[str]:
    return [x for x in (token.strip(",") for token in t.rest_of_clause()) if x]


def _block(t: _Tokens, mark: str) -> bool:
    """Whether '{', '{}' or '{ }' follows; it is skipped."""
    if not t.take("{", "{}"):
        return False
    t.take("}")
    return True


def _types_until(t: _Tokens, end: str, skip_keywords: bool) -> list[str]:
    """Types in a list up to ``end``: each alone or after a colon, commas being optional."""
    out = []
    while t.now() and t.now() != end:
        token = t.next()
        if token.endswith(","):
            if len(token) > 1 and token.rstrip(",") and not (skip_keywords and token.rstrip(",") == ":"):
                out.append(token.rstrip(","))
        elif token == ":":
            if t.now() and t.now() not in (end, ","):
                out.append(t.next().rstrip(","))
        elif not (is_keyword(token) if skip_keywords else token.startswith("#")):
            out.append(token)
    t.take(end)
    return out


def _members(t: _Tokens, p: Pattern) -> None:
    """``{ type N ; fn M (A) -> R ; WORD }`` of an impl or a trait."""
    if not t.take("{"):
        return
    while t.now() and t.now() != "}":
        if t.take(";"):
            continue
        if t.take("type"):
            if t.now() and t.now() not in ("}", "fn", "type", ";"):
                p.body_type_patterns.append(t.next())
        elif t.take("fn"):
            if t.now() and t.now() not in ("}", "->", ";") and not t.now().startswith("("):
                p.body_fn_name = t.next()
            if t.now().startswith("("):
                argument = t.next().strip("()")
                if argument:
                    p.body_fn_args.append(argument)
            if t.take("->") and t.now() and t.now() not in ("}", ";"):
                p.body_fn_return = t.next()
        else:
            p.impl_body_patterns.append(t.next())
    t.take("}")


def _clause(t: _Tokens, p: Pattern) -> None:
    token = t.next()
    word = token.lower()
    if token.startswith("#["):
        while not token.endswith("]") and t.now():
            token += " " + t.next()
        while token.startswith("#["):
            token = token[2:]
        p.attribute_patterns.append(token.rstrip("]"))
    elif token.endswith("^+"):
        while token.endswith("^+"):
            token = token[:-2]
        p.types_patterns.append(token)
    elif token == "<_>":
        p.requires_generics = True
    elif word == "proof":
        if _block(t, word):
            p.has_proof_block = True
        else:
            p.required_modifiers.append(word)
    elif word in MODIFIERS:
        p.required_modifiers.append(word)
    elif word == "pub":
        pass
    elif word == "fn":
        _generics_mark(t, p)
        if t.free() and not t.now().startswith("("):
            p.name = t.next()
        if t.take("("):
            p.arg_type_patterns += _types_until(t, ")", True)
    elif word in ("args", "types"):
        p.types_patterns += _commas(t)
    elif word == "generics":
        found = _commas(t) if t.free() and t.now().strip(",") else []
        p.generics_patterns += found
        p.requires_generics |= not found
    elif word == "->":
        p.returns_patterns += t.rest_of_clause()
    elif word in ("recommends", "requires", "ensures"):
        setattr(p, f"has_{word}", True)
        getattr(p, f"{word}_patterns").extend(t.rest_of_clause())
    elif word in ("assert", "assume", "assume_new"):
        setattr(p, f"has_{word}", True)
    elif word == "unsafe":
        if _block(t, word):
            p.has_unsafe_block = True
        else:
            p.is_unsafe = True
    elif word == "holes":
        p.is_holes_search = True
    elif word == "body":
        p.body_patterns += t.rest_of_clause()
    elif word == "impl":
        p.is_impl_search = True
        _generics_mark(t, p)
        if t.free():
            p.impl_trait = t.next()
        if t.take("for") and t.free():
            p.impl_for_type = t.next()
        _members(t, p)
    elif word == "trait":
        p.is_trait_search = True
        _generics_mark(t, p)
        if t.free():
            p.name = t.next()
        if t.take(":"):
            p.trait_bounds += [b for b in (x.strip("+") for x in t.rest_of_clause()) if b]
        _members(t, p)
    elif word == "for":
        if t.free():
            p.impl_for_type, p.is_impl_search = t.next(), True
    elif word == "type":
        p.is_type_search = True
        _generics_mark(t, p)
        if t.free():
            p.name = t.next()
        if t.take("=") and t.free():
            p.type_value = t.next()
    elif word in ("struct", "enum"):
        setattr(p, f"is_{word}_search", True)
        _generics_mark(t, p)
        if t.free():
            p.name = t.next()
        if t.take("{"):
            (p.struct_field_patterns if word == "struct" else p.enum_variant_patterns).extend(_types_until(t, "}", False))
    elif word == "def":
        p.is_def_search = True
        if t.free():
            p.name = t.next()
    elif p.name is None and not (p.is_impl_search or p.is_trait_search or p.is_type_search or p.is_struct_search or p.is_enum_search):
        p.name = token
