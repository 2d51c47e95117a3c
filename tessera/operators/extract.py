"""Table-generating functions: a file's content becomes rows of facts.

Each extractor is a plain function from content to dictionaries, and :func:`facts` runs one over a
``files`` table (path, content), one Arrow batch at a time. An extractor makes only its own kind,
and ``needs`` is a cheap native filter on the content before any Python runs.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from tessera.functions.lexer import OPEN, Lines, Token, code, code_texts, is_text, is_word, match, match_angle, partners, split_top, tokens

GENERICS = "generics array<struct<name:string,bounds:array<string>>>"
METHODS = "body_methods array<struct<name:string,args:array<string>,return_type:string>>"
SCHEMAS = {
    "fns": "path string, line int, end_line int, name string, visibility string, modifiers array<string>, mode string, "
    + GENERICS
    + ", args array<struct<name:string,ty:string>>, return_type string, recommends array<string>, requires array<string>, ensures array<string>, "
    "decreases boolean, attributes array<string>, context array<string>, body_text string, is_unsafe boolean, has_proof_block boolean, has_assert boolean, "
    "has_unsafe_block boolean, has_assume boolean, has_assume_new boolean, in_block boolean, location struct<kind:string,owner:string>, signature string, start int",
    "impls": "path string, line int, is_unsafe boolean, " + GENERICS + ", trait_name string, for_type string, attributes array<string>, body_types array<string>, " + METHODS + ", body_text string, in_block boolean",
    "traits": "path string, line int, name string, " + GENERICS + ", bounds array<string>, attributes array<string>, body_types array<string>, " + METHODS + ", n_default int, body_text string",
    "types": "path string, line int, kind string, name string, " + GENERICS + ", value string, field_types array<string>, attributes array<string>, is_pub boolean, in_block boolean, modifiers array<string>, variants array<string>, has_inv_field boolean, has_inv_fn boolean",
    "loc": "path string, spec int, proof int, exec int, rust int, total int",
    "tokens": "path string, idx int, kind string, text string, start int, end int, depth int, in_block boolean",
    "blocks": "path string, start int, end int, line_s int, line_e int, module string",
    "paths": "path string, seq int, text string, line_s int, col_s int, line_e int, col_e int",
    "findings": "path string, line int, severity string, hole_type string, context string, countable boolean",
}
#: Words that may stand before ``fn``.
QUALIFIERS = frozenset((
    "pub", "open", "closed", "spec", "proof", "exec", "broadcast", "axiom", "uninterp", "unsafe", "const", "async", "extern", "tracked", "ghost", "default", "crate", "super", "in",
))
MODES = ("spec", "proof", "exec", "axiom")
#: Words whose places a source keeps.
SOUGHT = frozenset(("fn", "impl", "trait", "struct", "enum", "type", "union", "verus", "verus_"))
CLAUSES = ("recommends", "requires", "ensures", "decreases", "opens_invariants", "returns", "via", "when", "no_unwind")


def generics(text: str) -> list[dict]:
    out = []
    for part in split_top(text):
        name, _, bounds = part.partition(":")
        out.append({"name": name.strip(), "bounds": split_top(bounds, "+")})
    return out


class Source:
    """A file's tokens with what all extractors ask for; what several of them ask for is made once. Tokens go by
    their number in ``texts`` and ``starts``; ``toks`` has them as objects for who asks."""

    def __init__(self, text: str):
        self.text = text
        self.texts, self.starts, self.docs = code_texts(text)
        self.closes = partners(self.texts)
        self.lines = Lines(text)
        self.positions: dict[str, list[int]] = {w: [] for w in SOUGHT}
        for i, word in [(i, x) for i, x in enumerate(self.texts) if x in SOUGHT]:
            self.positions[word].append(i)
        self.blocks = self._blocks()
        self.signatures: dict[int, dict | None] = {}

    @staticmethod
    def of(text: str | Source) -> Source:
        return text if isinstance(text, Source) else Source(text)

    @cached_property
    def all(self) -> list[Token]:
        return tokens(self.text)

    @cached_property
    def toks(self) -> list[Token]:
        return [t for t in self.all if t.kind != "comment"]

    def _blocks(self) -> list[tuple[int, int]]:
        """As :func:`tessera.functions.lexer.blocks`."""
        out, end = [], -1
        for i in self.at("verus", "verus_"):
            if i > end and i + 2 < len(self.texts) and self.texts[i + 1] == "!" and self.texts[i + 2] in OPEN:
                end = self.closes[i + 2]
                out.append((self.end(i + 2), self.starts[end]))
        return out

    def end(self, i: int) -> int:
        return self.starts[i] + len(self.texts[i])

    def line(self, t: Token) -> int:
        return self.lines.line(t.start)

    def inside(self, t: Token) -> bool:
        return self.in_block(t.start)

    def in_block(self, start: int) -> bool:
        return any(a <= start < b for a, b in self.blocks)

    def at(self, *words: str) -> list[int]:
        """The tokens that are one of ``words``, which are of SOUGHT, in order."""
        return self.positions[words[0]] if len(words) == 1 else sorted(i for w in words for i in self.positions[w])

    def span(self, a: int, b: int) -> str:
        """Text from token a to before token b."""
        return self.text[self.starts[a] : self.end(b - 1)].strip() if a < b else ""

    def before(self, at: int) -> tuple[list[str], list[str], int]:
        """(qualifiers, attributes) that stand before token ``at``, and where they begin."""
        texts = self.texts
        words, attributes, i = [], [], at - 1
        while i >= 0:
            text = texts[i]
            if text in QUALIFIERS or i and texts[i - 1] == "extern" and is_text(text):
                words.insert(0, text)
            elif text == ")":
                j = i
                while j > 0 and texts[j] != "(":
                    j -= 1
                if not j or texts[j - 1] not in QUALIFIERS:
                    break
                i = j
            elif text == "]":
                j, depth = i, 0
                while j >= 0:
                    depth += (texts[j] == "]") - (texts[j] == "[")
                    if not depth:
                        break
                    j -= 1
                if j < 1 or texts[j - 1] not in "#!":
                    break
                attributes.insert(0, self.text[self.end(j) : self.starts[i]].strip())
                i = j - 1
            else:
                break
            i -= 1
        return words, attributes, i + 1

    def docs_before(self, at: int, most: int = 3) -> list[str]:
        """The last doc comments that end right before token ``at``'s line group."""
        previous = self.end(at - 1) if at else 0
        return [text for text, start in self.docs if previous <= start < self.starts[at]][-most:] if self.docs else []

    def type_parameters(self, i: int) -> tuple[list[dict], int]:
        if i < len(self.texts) and self.texts[i] == "<":
            end = match_angle(self.texts, i, self.closes)
            if end > i:
                return generics(self.text[self.end(i) : self.starts[end]]), end + 1
        return [], i

    def until(self, i: int, *ends: str) -> int:
        """The first token from ``i`` on, at depth 0, whose text is one of ``ends``."""
        texts = self.texts
        while i < len(texts):
            text = texts[i]
            if text in ends:
                return i
            if text == "<":
                j = match_angle(texts, i, self.closes)
                i = j if j > i else i
            elif text in OPEN:
                i = self.closes[i]
            elif text in ("}", ")", "]"):
                return i
            i += 1
        return i

    def signature(self, at: int) -> dict | None:
        """The function whose ``fn`` is token ``at``; not to be changed, as others get the same."""
        if at not in self.signatures:
            self.signatures[at] = self._signature(at)
        return self.signatures[at]

    def _signature(self, at: int) -> dict | None:
        texts, starts, n = self.texts, self.starts, len(self.texts)
        if at + 1 >= n or not is_word(texts[at + 1]):
            return None
        words, attributes, first = self.before(at)
        params, i = self.type_parameters(at + 2)
        if i >= n or texts[i] != "(":
            return None
        close = self.closes[i]
        args = []
        for part in split_top(self.text[self.end(i) : starts[close]]):
            name, colon, ty = part.partition(":")
            if colon and not ty.startswith(":"):
                args.append({"name": name.strip(), "ty": ty.strip()})
        i, returned = close + 1, None
        if i < n and texts[i] == "->":
            end = self.until(i + 1, "{", ";", "where", *CLAUSES)
            returned, i = self.span(i + 1, end) or None, end
        clauses: dict[str, list[str]] = {c: [] for c in CLAUSES}
        body = None
        while i < n:
            text = texts[i]
            if text in CLAUSES:
                end = self.until(i + 1, "{", ";", *CLAUSES)
                # a brace right after an operator or a comparison belongs to the clause; the body stands after a complete one
                clauses[text].append(self.span(i + 1, end))
                i = end
            elif text == "{":
                body = (i, self.closes[i])
                break
            elif text in (";", "}"):
                break
            else:
                i += 1
        inner = self.text[self.end(body[0]) : starts[body[1]]] if body else ""
        last = body[1] if body else min(i, n - 1)
        seen = texts[body[0] + 1 : body[1]] if body else []
        opened = [w for w in ("proof", "unsafe", "assume", "assume_new") if w in seen]
        pairs = set(zip(seen, seen[1:], strict=False)) if opened else ()
        modifiers = [w for w in words if w != "pub"]
        return {
            "first": first, "at": at, "end": body[1] if body else i, "has_body": body is not None, "line": self.lines.line(starts[at]), "end_line": self.lines.line(starts[last]),
            "name": texts[at + 1], "visibility": "pub" if "pub" in words else "", "modifiers": modifiers,
            "mode": next((m for m in MODES if m in words), "exec"), "generics": params, "args": args, "return_type": returned,
            **{c: [x for x in clauses[c] if x] for c in ("recommends", "requires", "ensures")}, "decreases": bool(clauses["decreases"]),
            "attributes": attributes, "context": self.docs_before(first), "body_text": inner, "is_unsafe": "unsafe" in words,
            "has_proof_block": ("proof", "{") in pairs, "has_assert": "assert" in seen or "assert_by" in seen or "assert_forall_by" in seen,
            "has_unsafe_block": ("unsafe", "{") in pairs, "has_assume": ("assume", "(") in pairs, "has_assume_new": ("assume_new", "(") in pairs,
            "in_block": self.in_block(starts[at]),
            # for display (FN22): from the line of its first word to before the body, or with the semicolon
            "start": starts[at], "signature": self.text[self.lines.offset(self.lines.line(starts[first])) : starts[body[0]] if body else self.end(last)].rstrip(),
        }

    @cached_property
    def owners(self) -> list[tuple[int, int, str, str]]:
        """(start, end, kind, owner) of impl and trait bodies, by token index."""
        out = []
        for i in self.at("impl", "trait"):
            text = self.texts[i]
            if not (i and self.texts[i - 1] in ("->", ":", "(", "<", ",", "&", "=")):
                head = self.impl_head(i) if text == "impl" else None
                if text == "trait":
                    brace = self.until(i + 1, "{", ";")
                    name, kind = (self.texts[i + 1] if i + 1 < len(self.texts) else ""), "trait"
                elif head:
                    brace, name, kind = head["brace"], head["for_type"], "impl_trait" if head["trait_name"] else "impl_struct"
                else:
                    continue
                if brace < len(self.texts) and self.texts[brace] == "{":
                    out.append((brace, self.closes[brace], kind, name))
        return out

    def impl_head(self, at: int) -> dict | None:
        params, i = self.type_parameters(at + 1)
        brace = self.until(i, "{", ";")
        if brace >= len(self.texts) or self.texts[brace] != "{":
            return None
        head = self.until(i, "where", "{")
        split = self.until(i, "for", "where", "{")
        is_trait = split < head and self.texts[split] == "for"
        return {"generics": params, "trait_name": self.span(i, split) if is_trait else None, "for_type": self.span(split + 1, head) if is_trait else self.span(i, head), "brace": brace}

    def members(self, brace: int) -> tuple[list[str], list[dict], str, int]:
        """(associated types, methods, body text, methods with a body) of an impl or a trait."""
        end = self.closes[brace]
        types, methods, default, i = [], [], 0, brace + 1
        while i < end:
            text = self.texts[i]
            if text == "type" and is_word(self.texts[i + 1]):
                types.append(self.texts[i + 1])
            elif text == "fn" and (s := self.signature(i)):
                methods.append({"name": s["name"], "args": [a["ty"] for a in s["args"]], "return_type": s["return_type"]})
                default += s["has_body"]
                i = max(i, s["end"])
            elif text == "{":
                i = self.closes[i]
            i += 1
        return types, methods, self.text[self.end(brace) : self.starts[end]], default


def fns(text: str | Source) -> Iterator[dict]:
    """Every function, with where it lives: in a trait, an impl of a trait or of a type, or a module."""
    s = Source.of(text)
    owners = s.owners
    for i in s.at("fn"):
        if f := s.signature(i):
            around = [o for o in owners if o[0] < i < o[1]]
            kind, owner = (around[-1][2], around[-1][3]) if around else ("module", "")
            yield f | {"location": {"kind": kind, "owner": owner}}


def impls(text: str | Source) -> Iterator[dict]:
    s = Source.of(text)
    for i in s.at("impl"):
        if not (i and s.texts[i - 1] in ("->", ":", "(", "<", ",", "&", "=", "+")) and (head := s.impl_head(i)):
            words, attributes, _ = s.before(i)
            types, methods, body, _ = s.members(head["brace"])
            yield {"line": s.lines.line(s.starts[i]), "is_unsafe": "unsafe" in words, **head, "attributes": attributes, "body_types": types, "body_methods": methods, "body_text": body, "in_block": s.in_block(s.starts[i])}


def traits(text: str | Source) -> Iterator[dict]:
    s = Source.of(text)
    for i in s.at("trait"):
        if i + 1 < len(s.texts) and is_word(s.texts[i + 1]):
            _, attributes, _ = s.before(i)
            params, j = s.type_parameters(i + 2)
            bounds = []
            if j < len(s.texts) and s.texts[j] == ":":
                end = s.until(j + 1, "{", "where", ";")
                bounds, j = split_top(s.span(j + 1, end), "+"), end
            brace = s.until(j, "{", ";")
            if brace < len(s.texts) and s.texts[brace] == "{":
                types, methods, body, default = s.members(brace)
                yield {"line": s.lines.line(s.starts[i]), "name": s.texts[i + 1], "generics": params, "bounds": bounds, "attributes": attributes, "body_types": types, "body_methods": methods, "n_default": default, "body_text": body}


def _fields(text: str) -> list[str]:
    """Types of named or unnamed fields."""
    out = []
    for part in split_top(re.sub(r"#\[[^\]]*\]", "", text)):
        _, colon, ty = part.partition(":")
        out.append((ty if colon and not ty.startswith(":") else part).replace("pub ", "").strip())
    return out


def types(text: str | Source) -> Iterator[dict]:
    """Structs, enums and aliases with the types they are made of."""
    s = Source.of(text)
    members, functions = [(a, b) for a, b, _, _ in s.owners], s.at("fn")
    for i in s.at("struct", "enum", "type", "union"):
        text = s.texts[i]
        if i + 1 >= len(s.texts) or not is_word(s.texts[i + 1]) or any(a < i < b for a, b in members):
            continue
        words, attributes, _ = s.before(i)
        params, j = s.type_parameters(i + 2)
        own, value, variants, fields_at = [], None, [], (i, i)
        if text == "type":
            if j >= len(s.texts) or s.texts[j] != "=":
                continue
            value = s.span(j + 1, s.until(j + 1, ";"))
            own = [value]
        else:
            j = s.until(j, "{", "(", ";", "where")
            if j < len(s.texts) and s.texts[j] == "where":
                j = s.until(j + 1, "{", ";")
            if j < len(s.texts) and s.texts[j] in "{(":
                fields_at = (j, s.closes[j])
                inner = s.text[s.end(j) : s.starts[fields_at[1]]]
                inner = "\n".join(re.sub(r"//.*", "", x) for x in inner.split("\n"))
                if text == "enum":
                    for variant in split_top(re.sub(r"#\[[^\]]*\]", "", inner)):
                        variants.append(re.match(r"\w*", variant.strip())[0])
                        m = re.match(r"\w+\s*[({](.*)[)}]\s*$", variant, re.S)
                        own += _fields(m[1]) if m else []
                else:
                    own = _fields(inner)
        # an invariant as a field, or as a function named after the type within the next 200 tokens (AG31)
        inv_field = any("inv" in x and s.texts[n + 1] == ":" and is_word(x) for n, x in enumerate(s.texts[fields_at[0] : fields_at[1]], fields_at[0]))
        low = s.texts[i + 1].lower()
        inv_fn = any(n + 1 < len(s.texts) and low in s.texts[n + 1] and "inv" in s.texts[n + 1] for n in functions[bisect_left(functions, i) : bisect_left(functions, i + 200)])
        yield {"has_inv_field": inv_field, "has_inv_fn": inv_fn, "line": s.lines.line(s.starts[i]), "kind": {"type": "alias"}.get(text, text), "name": s.texts[i + 1], "generics": params, "value": value, "field_types": own, "attributes": attributes, "is_pub": "pub" in words, "in_block": s.in_block(s.starts[i]), "modifiers": [w for w in words if w != "pub"], "variants": variants}


def loc(text: str) -> Iterator[dict]:
    """Lines by class: those of spec, proof and exec functions inside blocks, and all other code."""
    s = Source(text)
    n = {"spec": 0, "proof": 0, "exec": 0}
    lines = text.splitlines()
    code_lines = {i + 1 for i, x in enumerate(lines) if x.strip() and not x.strip().startswith(("//", "/*", "*"))}
    inside: set[int] = set()
    for a, b in s.blocks:
        inside.update(range(s.lines.line(a), s.lines.line(max(a, b - 1)) + 1))
    taken: set[int] = set()
    for i, t in enumerate(s.toks):
        if t.text == "fn" and t.kind == "word" and s.inside(t) and (f := s.signature(i)):
            own = set(range(f["line"], f["end_line"] + 1)) - taken
            n[{"axiom": "proof"}.get(f["mode"], f["mode"])] += len(own & code_lines)
            taken |= own
    yield n | {"rust": len(code_lines - inside), "total": len(lines)}


def token_rows(text: str) -> Iterator[dict]:
    s, depth = Source(text), 0
    for i, t in enumerate(s.toks):
        depth -= t.text in "})]"
        yield {"idx": i, "kind": t.kind, "text": t.text, "start": t.start, "end": t.end, "depth": depth, "in_block": s.inside(t)}
        depth += t.text in "{(["


#: Names of calls and attributes that leave a proof open.
HOLE_CALLS = {"admit": "admit()", "assume_new": "assume_new()"}
HOLE_ATTRIBUTES = ("external_body", "external_fn_specification", "external_trait_specification", "external_type_specification", "external_trait_extension", "external", "opaque")


#: Traits that are no file's own.
STANDARD_TRAITS = frozenset((
    "Clone", "Copy", "Debug", "Display", "Default", "PartialEq", "Eq", "PartialOrd", "Ord", "Hash", "Iterator", "IntoIterator", "Send", "Sync",
    "View", "DeepView", "ForLoopGhostIteratorNew", "ForLoopGhostIterator", "PartialEqSpecImpl", "Sized", "Drop", "Add", "Sub", "Mul", "Div", "Rem", "Neg",
    "From", "Into", "TryFrom", "TryInto", "AsRef", "AsMut", "Deref", "DerefMut", "Fn", "FnMut", "FnOnce",
))


def accepted(lines: list[str], line: int, ahead: int = 2) -> bool:
    """Whether the line or one of the ``ahead`` following ones has an accept-hole comment."""
    for x in lines[line - 1 : line + ahead]:
        _, mark, comment = x.partition("//")
        if mark and "accepthole" in re.sub(r"[\W_]", "", comment.lower()):
            return True
    return False


def findings(text: str) -> Iterator[dict]:
    """The proof-hole audit of one file: holes (H), errors (E), warnings (W) and notes (I)."""
    s, lines = Source(text), text.split("\n")
    toks = s.toks

    def row(t: Token, severity: str, kind: str) -> dict:
        line = s.line(t)
        around = lines[line - 1].strip()
        return {"line": line, "severity": severity, "hole_type": kind, "context": around if len(around) <= 80 else around[:77] + "...", "countable": severity == "H"}

    if not s.blocks:
        yield {"line": 1, "severity": "E", "hole_type": "not_verusified", "context": "", "countable": False}
    for n, x in enumerate(lines, 1):
        if "std::sync::RwLock" in x:
            yield {"line": n, "severity": "E", "hole_type": "rust_rwlock", "context": x.strip()[:80], "countable": False}
    functions = [f for i, t in enumerate(toks) if t.text == "fn" and t.kind == "word" and (f := s.signature(i))]
    for i, t in enumerate(toks):
        following = toks[i + 1].text if i + 1 < len(toks) else ""
        if t.text == "unsafe" and following in ("fn", "impl", "{"):
            ok = accepted(lines, s.line(t), 6 if following == "{" else 2)
            yield row(t, "I" if ok else "H", "unsafe {}" if following == "{" else f"unsafe {following}")
        if t.text == "#" and following == "[":
            end = match(toks, i + 1)
            inner = [x.text for x in toks[i + 2 : end]]
            if "verifier" in inner:
                for name in HOLE_ATTRIBUTES:
                    if name in inner:
                        ok = name != "opaque" and accepted(lines, s.line(t))
                        yield row(t, "I" if ok else "H", name + ("_accept_hole" if ok and name != "external_body" else ""))
        if not s.inside(t) or t.kind != "word":
            continue
        if t.text == "assume" and following == "(":
            end = match(toks, i + 1)
            around = next((f["name"] for f in reversed(functions) if f["at"] <= i <= f["end"]), "")
            if [x.text for x in toks[i + 2 : end]] == ["false"]:
                diverges = [x.text for x in toks[end + 1 : end + 5]][:3] == [";", "diverge", "("]
                yield row(t, "I" if diverges else "H", "assume(false); diverge()" if diverges else "assume(false)")
            elif around in ("eq", "clone", "clone_tree", "clone_link"):
                yield row(t, "W", "assume_eq_clone_workaround")
            else:
                yield row(t, "H", "assume()")
        elif t.text in HOLE_CALLS and following == "(":
            yield row(t, "H", HOLE_CALLS[t.text])
        elif t.text == "accept" and following == "(":
            yield row(t, "I", "accept()")
        elif t.text == "assume_specification":
            yield row(t, "H", "assume_specification")
    for f in functions:
        t = toks[f["at"]]
        if not s.inside(t):
            continue
        if "axiom" in f["modifiers"]:
            yield row(t, "H", "axiom")
        skipped = accepted(lines, f["line"]) or any("external_body" in a or "exec_allows_no_decreases_clause" in a for a in f["attributes"])
        if f["mode"] == "exec" and not skipped:
            # a function without parameters has nothing to require
            missing = [c for c in ("requires", "ensures") if not f[c] and (c == "ensures" or f["args"] or "self" in s.text[t.start : toks[f["end"]].start].split(")")[0])]
            if missing:
                yield row(t, "E", "fn_missing_" + "_".join(missing))
        if f["mode"] in ("spec", "proof") and (f["has_assume"] or f["has_assume_new"] or re.search(r"\badmit\s*\(", f["body_text"])):
            yield row(t, "E", f"{f['mode']}_fn_with_holes")
        if any(x.strip().rstrip(",") == "true" for c in f["requires"] for x in split_top(c)):
            yield row(t, "W", "requires_true")
        if f["mode"] == "spec" and "wf" in f["name"] and f["return_type"] == "bool" and f["body_text"].strip() == "true":
            yield row(t, "I" if accepted(lines, f["line"]) else "H", "trivial_spec_wf")


    yield from _outside_findings(s, lines, row)


def _outside_findings(s: Source, lines: list[str], row: Callable) -> Iterator[dict]:
    """Types outside the blocks of a file that has one, and impls that belong elsewhere (EX18, EX19)."""
    toks, own_traits, bare = s.toks, False, []
    for i, t in enumerate(toks):
        if t.kind != "word" or i + 1 >= len(toks):
            continue
        if t.text in ("struct", "enum") and toks[i + 1].kind == "word" and s.blocks and not s.inside(t):
            ok = accepted(lines, s.line(t))
            yield row(t, "I" if ok else "E", f"{t.text}_outside_verus" + ("_accept_hole" if ok else ""))
            derived = {x.strip() for a in s.before(i)[1] for x in re.sub(r"^derive\s*\(|\)$", "", a).split(",") if a.startswith("derive")}
            if "Clone" in derived and not ok:
                yield row(t, "E", "clone_derived_outside")
        elif t.text == "trait" and toks[i + 1].kind == "word":
            own_traits |= toks[i + 1].text not in STANDARD_TRAITS
        elif t.text == "impl" and not (i and toks[i - 1].text in ("->", ":", "(", "<", ",", "&", "=", "+")) and (head := s.impl_head(i)):
            name = re.sub(r"<.*$", "", head["trait_name"] or "", flags=re.S).split("::")[-1].strip()
            end = match(toks, head["brace"])
            inner = [f for j in range(head["brace"], end) if toks[j].text == "fn" and toks[j].kind == "word" and (f := s.signature(j))]
            if name in ("Debug", "Display") and s.inside(t):
                yield row(t, "E", "debug_display_inside_verus")
            if name == "RwLockPredicate":
                for f in inner:
                    if f["name"] == "inv" and f["body_text"].strip() == "true":
                        yield row(toks[f["at"]], "E", "dummy_rwlock_predicate")
            if head["trait_name"] is None:
                attributes = " ".join(s.before(i)[1])
                fine = "Iter" in re.sub(r"<.*$", "", head["for_type"], flags=re.S) or "external" in attributes or any(f["name"].startswith("iter") or f["name"] == "into_iter" for f in inner) or inner and all(f["mode"] != "exec" for f in inner)
                if not fine:
                    bare.append(t)
    if own_traits:
        for t in bare:
            yield row(t, "E", "bare_impl")


def block_rows(text: str) -> Iterator[dict]:
    """The extents of blocks between their braces, and the innermost module around each (EX11)."""
    s = Source(text)
    bodies = [(s.toks[i + 2].start, s.toks[match(s.toks, i + 2)].end, s.toks[i + 1].text) for i, t in enumerate(s.toks[:-2]) if t.text == "mod" and s.toks[i + 2].text == "{"]
    for a, b in s.blocks:
        around = [m for m in bodies if m[0] < a and b < m[1]]
        yield {"start": a, "end": b, "line_s": s.lines.line(a), "line_e": s.lines.line(b), "module": max(around)[2] if around else None}


def path_rows(text: str) -> Iterator[dict]:
    """One path of ``tag{value}`` segments for each item of a block, with its span: lines from 1, columns from
    0, the end after the last character (EX38). Functions stand below the trait or impl that has them; a
    closing brace in a value is escaped. Parts of functions and statements have no paths of their own."""
    s, seq = Source(text), 0
    toks, owners = s.toks, []
    modules = [(a, b, m) for r in block_rows(text) for a, b, m in [(r["start"], r["end"], r["module"])]]

    def row(segments: list[str], first: int, last: int) -> dict:
        nonlocal seq
        seq += 1
        a, b = toks[first], toks[min(last, len(toks) - 1)]
        return {"seq": seq, "text": " ".join(segments), "line_s": s.line(a), "col_s": s.lines.column(a.start), "line_e": s.lines.line(b.end - 1), "col_e": s.lines.column(b.end - 1) + 1}

    def tag(name: str, value: str) -> str:
        return name + "{" + value.replace("}", "\\}") + "}"

    for i, t in enumerate(toks):
        if t.kind != "word" or not s.inside(t) or i + 1 >= len(toks):
            continue
        around = [o for o in owners if o[0] < i < o[1]]
        base = [tag("module", "mod " + m) for a, b, m in modules if m and a <= t.start < b][:1]
        named = toks[i + 1].kind == "word"
        if t.text == "fn" and named and (f := s.signature(i)):
            yield row([*base, *(around[-1][2] if around else []), tag("fn", "fn " + f["name"])], f["first"], f["end"])
        elif t.text in ("struct", "enum", "type") and named and not around:
            end = s.until(i + 2, "{", ";")
            end = match(toks, end) if end < len(toks) and toks[end].text == "{" else end
            name = {"struct": "struct_ident", "enum": "enum", "type": "type"}[t.text]
            yield row([*base, tag(name, toks[i + 1].text if t.text == "struct" else f"{t.text} {toks[i + 1].text}")], s.before(i)[2], end)
        elif t.text == "trait" and named or t.text == "impl" and toks[i - 1].text not in ("->", ":", "(", "<", ",", "&", "=", "+"):
            head = s.impl_head(i) if t.text == "impl" else None
            brace = head["brace"] if head else s.until(i + 1, "{", ";") if t.text == "trait" else len(toks)
            if brace >= len(toks) or toks[brace].text != "{":
                continue
            if head:
                segments = ["impl{}", *([tag("impl_trait", head["trait_name"])] if head["trait_name"] else []), tag("impl_type", head["for_type"])]
            else:
                segments = [tag("trait", "trait " + toks[i + 1].text)]
            end = match(toks, brace)
            owners.append((brace, end, segments))
            yield row([*base, *segments], s.before(i)[2], end)


EXTRACTORS: dict[str, Callable[[str], Iterator[dict]]] = {"fns": fns, "impls": impls, "traits": traits, "types": types, "loc": loc, "tokens": token_rows, "findings": findings, "blocks": block_rows, "paths": path_rows}
NEEDS = {"fns": r"\bfn\b", "impls": r"\bimpl\b", "traits": r"\btrait\b"}


#: Files whose facts are held as Python values at a time.
FILES_AT_ONCE = 500


def facts(files: DataFrame, kind: str, *columns: str) -> DataFrame:
    """Rows of one kind for all of ``files`` (path, content); a null content gives none. With ``columns`` only
    those are made into Arrow columns and leave Python."""
    whole = StructType.fromDDL(SCHEMAS[kind])
    schema = StructType([f for f in whole if f.name in columns or f.name == "path"]) if columns else whole
    arrow, make = to_arrow_schema(schema), EXTRACTORS[kind]
    names = [n for n in arrow.names if n != "path"]

    def run(batches):
        for b in batches:
            paths, found = [], {n: [] for n in names}
            for path, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                n = 0
                for n, r in enumerate(make(content), 1):
                    for c in names:
                        found[c].append(r.get(c))
                paths += [path] * n
            yield pa.RecordBatch.from_arrays([pa.array(paths if f.name == "path" else found[f.name], f.type) for f in arrow], schema=arrow)

    needed = files.where(F.col("content").isNotNull())
    if kind in NEEDS:
        needed = needed.where(F.col("content").rlike(NEEDS[kind]))
    return needed.select("path", "content").mapInArrow(run, schema)


def facts_by_file(files: DataFrame, **columns: tuple[str, ...]) -> DataFrame:
    """(path, an array of structs for each kind): the facts of several kinds, with the columns named for each,
    from one pass over ``files`` and one :class:`Source` for each file. For functions, impls, traits and types."""
    fields = {kind: [f for f in StructType.fromDDL(SCHEMAS[kind]) if f.name in names] for kind, names in columns.items()}
    schema = StructType([StructField("path", StringType()), *(StructField(kind, ArrayType(StructType(own))) for kind, own in fields.items())])
    arrow, names = to_arrow_schema(schema), {kind: [f.name for f in own] for kind, own in fields.items()}

    def run(batches):
        for whole in batches:
            for first in range(0, len(whole), FILES_AT_ONCE):
                b = whole.slice(first, FILES_AT_ONCE)
                found = {kind: [] for kind in names}
                for content in b.column("content").to_pylist():
                    source = Source(content)
                    for kind, own in names.items():
                        found[kind].append([{c: r[c] for c in own} for r in EXTRACTORS[kind](source)])
                yield pa.RecordBatch.from_arrays([b.column("path"), *(pa.array(found[f.name], f.type) for f in list(arrow)[1:])], schema=arrow)

    return files.where(F.col("content").isNotNull()).select("path", "content").mapInArrow(run, schema)


# -- native extractors


def dependencies(files: DataFrame, skip: str = "accept") -> DataFrame:
    """(path, dep): ``crate::`` paths without their last segment (EX21)."""
    found = files.select("path", F.explode(F.expr(r"regexp_extract_all(content, r'crate::(\w+(?:::\w+)*)', 1)")).alias("whole"))
    parts = F.split("whole", "::")
    cut = F.when(F.size(parts) > 1, F.array_join(F.slice(parts, 1, F.size(parts) - 1), "::")).otherwise(F.col("whole"))
    return found.where(F.element_at(parts, 1) != skip).select("path", cut.alias("dep")).distinct()


def comments(files: DataFrame) -> DataFrame:
    """(path, line_no, text, kind) of line comments: doc, inner or plain (EX41)."""
    from tessera.sources.files import lines

    own = F.trim("text")
    kind = F.when(own.rlike("^///(?!/)"), "doc").when(F.startswith(own, F.lit("//!")), "inner").when(F.startswith(own, F.lit("//")), "plain")
    return lines(files).withColumn("kind", kind).where(F.col("kind").isNotNull()).select("path", "line_no", "text", "kind")


def path_lines(paths: DataFrame) -> DataFrame:
    """(path, seq, value): a line of a path file for each path (SK5); :func:`tessera.sources.files.spans_of_paths`
    reads them back."""
    value = F.format_string("file{%s} %s %d:%d-%d:%d", F.replace("path", F.lit("}"), F.lit("\\}")), "text", "line_s", "col_s", "line_e", "col_e")
    return paths.select("path", "seq", value.alias("value"))


def write_path_files(paths: DataFrame, folder: str) -> None:
    """One directory of path lines for each source, in the order of the source (SK5)."""
    path_lines(paths).repartition("path").sortWithinPartitions("path", "seq").select("path", "value").write.mode("overwrite").partitionBy("path").text(folder)
