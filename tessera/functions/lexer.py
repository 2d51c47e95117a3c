"""One tokenizer for Rust-like sources: nested comments, strings, raw strings, characters against
lifetimes, identifiers, numbers and signs. Everything that extracts facts goes by these tokens, so
a keyword in a comment or a string is never one."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Sequence
from functools import lru_cache
from itertools import accumulate, compress
from typing import NamedTuple

# One match for each token, with the white space before it. The first two ways are for speed: words and signs
# that begin nothing else, so the order of the others decides as if they stood last.
_TOKEN = re.compile(
    r"""\s*(?:(?P<plain>[^\W\dbr]\w*)|(?P<single>[{}()\[\],;\#])|(?P<line>//[^\n]*)|(?P<block>/\*)|(?P<raw>b?r(?P<hashes>\#*)")|(?P<text>b?"(?:[^"\\]|\\.)*"?)"""
    r"""|(?P<char>b?'(?:[^'\\\n]|\\(?:x[0-9a-fA-F]{2}|u\{[0-9a-fA-F_]+\}|.))')|(?P<lifetime>'[^\W\d]\w*)|(?P<word>(?:r\#)?[^\W\d]\w*)|(?P<number>\d[\w]*(?:\.\d[\w]*)?)"""
    r"""|(?P<sign>::|->|=>|==>|<==>|==|!=|<=|>=|&&|\|\||\.\.=?|[^\s\w]))""",
    re.S,
)
_KINDS = {"line": "comment", "block": "comment", "raw": "text", "plain": "word", "single": "sign"}
#: Kinds by the number of their group.
_KIND = {n: _KINDS.get(name, name) for name, n in _TOKEN.groupindex.items()}
_BLOCK, _RAW = _TOKEN.groupindex["block"], _TOKEN.groupindex["raw"]
_COMMENT_SIGN = re.compile(r"/\*|\*/")


class Token(NamedTuple):
    kind: str  #: word, number, text, char, lifetime, sign, comment
    text: str
    start: int
    end: int


def tokens(source: str) -> list[Token]:
    """All tokens but white space, comments included. What is left open reaches to the end."""
    out, at, n = [], 0, len(source)
    while at < n:
        for m in _TOKEN.finditer(source, at):
            group = m.lastindex
            start, at = m.span(group)
            if group == _BLOCK:
                depth = 1
                while depth:
                    a = _COMMENT_SIGN.search(source, at)
                    if not a:
                        at = n
                        break
                    depth += 1 if a[0] == "/*" else -1
                    at = a.end()
            elif group == _RAW:
                close = source.find('"' + m["hashes"], at)
                at = n if close < 0 else close + 1 + len(m["hashes"])
            else:
                out.append(Token(_KIND[group], m[group], start, at))
                continue
            out.append(Token(_KIND[group], source[start:at], start, at))
            break  # what the search may not see ends here
        else:
            break
    return out


# All pieces of a source, white space included, unless it holds what no expression can follow: comments that nest or
# stay open, and raw strings. Those show as pieces that are only their starts.
_PIECE = re.compile(
    r"""[^\W\dbr]\w*|\s+|[{}()\[\],;\#]|//[^\n]*|/\*(?:[^*/]++|\*(?!/)|/(?!\*))*+\*/|/\*|b?r\#*"|b?"(?:[^"\\]|\\.)*"?"""
    r"""|b?'(?:[^'\\\n]|\\(?:x[0-9a-fA-F]{2}|u\{[0-9a-fA-F_]+\}|.))'|'[^\W\d]\w*|(?:r\#)?[^\W\d]\w*|\d[\w]*(?:\.\d[\w]*)?"""
    r"""|::|->|=>|==>|<==>|==|!=|<=|>=|&&|\|\||\.\.=?|[^\s\w]""",
    re.S,
)
_RAW_START = re.compile(r'b?r#*"')
_WORD = re.compile(r"(?:r\#)?[^\W\d]\w*")
_TEXT = re.compile(r'b?"|b?r#*"')


def code_texts(source: str) -> tuple[list[str], list[int], list[tuple[str, int]]]:
    """(texts, starts) of :func:`code`, and (text, start) of the doc comments, without an object for each token
    where no comment nests and no string is raw."""
    pieces = _PIECE.findall(source)
    if "/*" in pieces or ('r"' in source or "r#" in source) and any(map(_RAW_START.fullmatch, pieces)):
        every = tokens(source)
        own = [t for t in every if t.kind != "comment"]
        return [t.text for t in own], [t.start for t in own], [(t.text, t.start) for t in every if t.text[:3] == "///"]
    starts = list(accumulate(map(len, pieces), initial=0))
    kept = [not p.isspace() and p[:2] not in ("//", "/*") for p in pieces]
    docs = [(p, at) for p, at in zip(pieces, starts, strict=False) if p[:3] == "///"] if "///" in source else []
    return list(compress(pieces, kept)), list(compress(starts, kept)), docs


def is_word(text: str) -> bool:
    """Whether a token's text is that of a word."""
    return _WORD.fullmatch(text) is not None


def is_text(text: str) -> bool:
    """Whether a token's text is that of a string."""
    return _TEXT.match(text) is not None


def code(source: str) -> list[Token]:
    return [t for t in tokens(source) if t.kind != "comment"]


class Lines:
    """Offsets to 1-based lines and back."""

    def __init__(self, source: str):
        self.starts = [0, *(m.end() for m in re.finditer("\n", source))]

    def line(self, offset: int) -> int:
        return bisect_right(self.starts, offset)

    def column(self, offset: int) -> int:
        return offset - self.starts[self.line(offset) - 1]

    def offset(self, line: int, column: int = 0) -> int:
        return self.starts[line - 1] + column


OPEN, CLOSE = {"{": "}", "(": ")", "[": "]"}, frozenset("})]")
BRACKETS = frozenset("{}()[]")


def match(toks: list[Token], at: int) -> int:
    """The index of the bracket that closes the one at ``at``; the last index if none does."""
    depth = 0
    for i in range(at, len(toks)):
        if toks[i].text in OPEN:
            depth += 1
        elif toks[i].text in CLOSE:
            depth -= 1
            if not depth:
                return i
    return len(toks) - 1


def partners(texts: Sequence[str]) -> dict[int, int]:
    """:func:`match` of all opening brackets at once, by the texts of the tokens."""
    out, left = {}, []
    for i in [i for i, text in enumerate(texts) if text in BRACKETS]:
        if texts[i] in OPEN:
            left.append(i)
        elif left:
            out[left.pop()] = i
    return out | dict.fromkeys(left, len(texts) - 1)


def match_angle(texts: Sequence[str], at: int, closes: dict[int, int]) -> int:
    """The index of the '>' that closes the '<' at ``at``; brackets inside are skipped."""
    depth, i = 0, at
    while i < len(texts):
        text = texts[i]
        if text == "<":
            depth += 1
        elif text == ">":
            depth -= 1
            if not depth:
                return i
        elif text in OPEN:
            i = closes[i]
        elif text in (";", "}"):
            break
        i += 1
    return at


_SPLITS = {separator: re.compile(f"[][<>(){{}}{re.escape(separator)}]") for separator in ",+"}


@lru_cache(4096)
def _parts(text: str, separator: str) -> tuple[str, ...]:
    parts, depth, first = [], 0, 0
    for m in _SPLITS[separator].finditer(text):
        c, at = m[0], m.start()
        if c in "<([{":
            depth += 1
        elif c in ")]}" or c == ">" and text[at - 1 : at] not in "-=":
            depth -= 1
        if c == separator and depth <= 0:
            parts.append(text[first:at])
            first = at + 1
    return tuple(p.strip() for p in [*parts, text[first:]] if p.strip())


def split_top(text: str, separator: str = ",") -> list[str]:
    """Parts at depth 0 of all brackets, angle brackets included; arrows do not close."""
    return list(_parts(text, separator))


def blocks(source: str, toks: list[Token] | None = None, names: tuple[str, ...] = ("verus", "verus_")) -> list[tuple[int, int]]:
    """(start, end) of the bodies of macro calls such as ``verus! { ... }``, outside comments and strings."""
    toks = code(source) if toks is None else toks
    out, end = [], -1
    for i in [n for n, t in enumerate(toks[:-2]) if t.text in names]:
        if i > end and toks[i + 1].text == "!" and toks[i + 2].text in OPEN:
            end = match(toks, i + 2)
            out.append((toks[i + 2].end, toks[end].start))
    return out
