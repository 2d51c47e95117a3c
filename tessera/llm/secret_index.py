"""Secrets found through a trigram inverted index, with DataFrame functions only.

From each rule's regular expression a Boolean query over trigrams is derived: runs of letters
that every match must hold, as AND of their trigrams, with OR over alternatives. The index has a
posting (gram, key) for each needed trigram of each distinct text, a text being known by a 64-bit
hash (two texts that share one only add a candidate). Postings are intersected by merging them
for each key, and the regular expression runs on candidates only. A rule without mandatory
trigrams scans all texts.

Cases: null texts count as empty and have no spans; equal rows get equal results; spans count
code points with the end exclusive; matches that fail their length rule are dropped but keep
their place, so later matches do not overlap them; an empty table gives no rows; other columns
are carried, whatever their names, but for one called spans, which is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product
from re import _constants as sre
from re import _parser

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import cut, text_or_empty


@dataclass(frozen=True)
class Rule:
    """``group`` of a match has ``least`` characters or more; what (?i: ) encloses matches in either case."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1

    def spelled(self) -> str:
        """The pattern with either-case parts as explicit ASCII classes, alike in every engine."""
        out, rest = "", self.pattern
        while "(?i:" in rest:
            head, _, rest = rest.partition("(?i:")
            depth, end = 1, 0
            while depth:
                depth += {"(": 1, ")": -1}.get(rest[end], 0)
                end += 1
            out += head + "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in rest[: end - 1])
            rest = rest[end:]
        return out + rest


#: What is looked for, in the order that breaks ties between spans.
RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]+", 0, 16),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 0, 15),
    Rule("google", r"AIza[A-Za-z0-9_-]+", 0, 39),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+[.]eyJ[A-Za-z0-9_-]+[.][A-Za-z0-9_-]+"),
    Rule("payment", r"[sr]k_(live|test)_[A-Za-z0-9]+", 0, 24),
)
BASE = ("assign", "access", "hex")

# -- trigram queries: True (no condition), a gram, ("and", ...), ("or", ...)


def _both(kind: str, parts: list) -> object:
    parts = list(dict.fromkeys(p for p in parts if p is not True)) if kind == "and" else list(dict.fromkeys(parts))
    if kind == "or" and True in parts or not parts:
        return True
    if kind == "or":  # an alternative that asks for more than another adds nothing
        parts = [p for i, p in enumerate(parts) if not any(_held(q) < _held(p) or _held(q) == _held(p) and j < i for j, q in enumerate(parts) if _simple(p) and _simple(q))]
    return parts[0] if len(parts) == 1 else (kind, *parts)


def _simple(query: object) -> bool:
    return isinstance(query, str) or query is not True and query[0] == "and" and all(isinstance(q, str) for q in query[1:])


def _held(query: object) -> set[str]:
    return {query} if isinstance(query, str) else set(query[1:])


def _literal(text: str, most: int) -> object:
    """AND over at most ``most`` trigrams of the text, evenly placed."""
    grams = [text[i : i + 3] for i in range(len(text) - 2)]
    step = max(1, -(-len(grams) // most))
    return _both("and", grams[::step])


def trigram_query(pattern: str, most_strings: int = 32, most_grams: int = 3) -> object:
    """A condition that the lower-case form of every text with a match of ``pattern`` meets."""

    def strings(node) -> list[str] | None:
        """All strings the node can match, if they are few."""
        op, arg = node
        if op is sre.LITERAL:
            return [chr(arg).lower()]
        if op is sre.IN:
            out: dict[str, None] = {}
            for kind, x in arg:
                if kind is sre.LITERAL:
                    out[chr(x).lower()] = None
                elif kind is sre.RANGE and x[1] - x[0] < 8:
                    out |= dict.fromkeys(chr(c).lower() for c in range(x[0], x[1] + 1))
                else:
                    return None
            return list(out) if len(out) <= 8 else None
        if op is sre.SUBPATTERN:
            return sequence(arg[3])
        if op is sre.BRANCH:
            found = [sequence(x) for x in arg[1]]
            return None if None in found else list(dict.fromkeys(s for f in found for s in f))
        if op is sre.MAX_REPEAT and arg[1] <= 2:
            one = sequence(arg[2])
            return None if one is None else list(dict.fromkeys("".join(x) for n in range(arg[0], arg[1] + 1) for x in product(one, repeat=n)))
        return None

    def sequence(nodes) -> list[str] | None:
        out = [""]
        for node in nodes:
            own = strings(node)
            if own is None or len(out) * len(own) > most_strings:
                return None
            out = [a + b for a in out for b in own]
        return out

    def query(nodes) -> object:
        parts, run = [], [""]

        def close():
            if run != [""]:
                parts.append(_both("or", [_literal(s, most_grams) for s in run]))

        for node in nodes:
            own = strings(node)
            if own is not None and len(run) * len(own) <= most_strings:
                run = [a + b for a in run for b in own]
                continue
            close()
            run = [""] if own is None else own
            if own is None:
                op, arg = node
                if op is sre.SUBPATTERN:
                    parts.append(query(arg[3]))
                elif op is sre.BRANCH:
                    parts.append(_both("or", [query(x) for x in arg[1]]))
                elif op is sre.MAX_REPEAT and arg[0] >= 1:
                    parts.append(query(arg[2]))
        close()
        return _both("and", parts)

    return query(list(_parser.parse(pattern)))


def grams_of(query: object) -> list[str]:
    if query is True:
        return []
    return [query] if isinstance(query, str) else list(dict.fromkeys(g for q in query[1:] for g in grams_of(q)))


# -- the index


def build_index(docs: DataFrame, grams: list[str] | None = None, text: str = "text") -> DataFrame:
    """Postings (gram, key), each once for a text, written to the shared folder in segments sorted
    by gram, one for each task. With ``grams`` only those are indexed, which is all that a known set
    of rules can ask for; else every trigram of every text."""
    if grams is None:
        every = F.transform(F.sequence(F.lit(1), F.greatest(F.length("folded") - 2, F.lit(1))), lambda i: F.substring(F.col("folded"), i, F.lit(3)))
        found = F.array_distinct(F.filter(every, lambda g: F.length(g) == 3))
    else:
        found = F.array_compact(F.array(*(F.when(F.contains("folded", F.lit(g)), F.lit(g)) for g in grams)))
    rows = docs.select(F.xxhash64(text_or_empty(text)).alias("key"), F.lower(text_or_empty(text)).alias("folded")).select("key", F.explode(found).alias("gram"))
    return cut(rows.sortWithinPartitions("gram", "key"))


def candidates(index: DataFrame, queries: dict[str, object]) -> DataFrame:
    """(key, kinds) of the texts whose postings meet at least one of the queries. Each gram has a
    bit, a key's postings are merged by bitwise OR, and a query is a test of the merged bits."""
    grams = list(dict.fromkeys(g for q in queries.values() for g in grams_of(q)))
    bit = {g: (i // 62, 1 << (i % 62)) for i, g in enumerate(grams)}
    n = len(grams) // 62 + 1
    table = F.create_map(*(x for g in grams for x in (F.lit(g), F.lit(bit[g][1]))))
    word = F.create_map(*(x for g in grams for x in (F.lit(g), F.lit(bit[g][0]))))

    def test(q: object) -> Column:
        if isinstance(q, str):
            at, b = bit[q]
            return F.col(f"m{at}").bitwiseAND(F.lit(b)) != 0
        parts = [test(x) for x in q[1:]]
        out = parts[0]
        for p in parts[1:]:
            out = out & p if q[0] == "and" else out | p
        return out

    merged = index.where(F.col("gram").isin(grams)).select("key", word[F.col("gram")].alias("w"), table[F.col("gram")].cast("bigint").alias("b")).groupBy("key").agg(
        *(F.bit_or(F.when(F.col("w") == i, F.col("b")).otherwise(F.lit(0).cast("bigint"))).alias(f"m{i}") for i in range(n))
    )
    kinds = F.array_compact(F.array(*(F.when(test(q), F.lit(k)) for k, q in queries.items())))
    return merged.select("key", kinds.alias("kinds")).where(F.size("kinds") > 0)


# -- verification


def spans(text: str, rule: Rule, order: int) -> str:
    """SQL for array<struct<start, kind, end>> of the rule's matches in column ``text``: the lengths
    of the matches and of what lies between them, summed up in blocks of 256."""
    pattern = "r'" + rule.spelled().replace("'", "\\x27") + "'"
    held = f"regexp_extract_all({text}, {pattern}, {rule.group})"
    whole = f"regexp_extract_all({text}, {pattern}, 0)"
    sizes = (
        f"transform(arrays_zip(transform(split({text}, {pattern}, -1), p -> char_length(p)), transform({whole}, m -> char_length(m)), transform({held}, m -> char_length(m))), "
        "z -> named_struct('gap', z['0'], 'size', z['1'], 'held', z['2']))"
    )
    return f"""
      CASE WHEN size({whole}) = 0 THEN array() ELSE
      element_at(transform(array(filter({sizes}, z -> z.size IS NOT NULL)), a ->
        element_at(transform(array(transform(sequence(0, (size(a) - 1) div 256), b -> slice(a, b * 256 + 1, 256))), blocks ->
          element_at(transform(array(aggregate(blocks, array(0), (s, b) -> concat(s, array(element_at(s, -1) + aggregate(b, 0, (t, z) -> t + z.gap + z.size))))), starts ->
            flatten(transform(blocks, (b, i) ->
              aggregate(b, named_struct('at', starts[i], 'out', cast(array() AS array<struct<start: int, kind: int, end: int>>)),
                (s, z) -> named_struct('at', s.at + z.gap + z.size, 'out',
                  CASE WHEN z.held >= {rule.least} THEN concat(s.out, array(named_struct('start', s.at + z.gap, 'kind', {order}, 'end', s.at + z.gap + z.size))) ELSE s.out END)).out))
          ), 1)), 1)), 1) END"""


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """``docs`` with ``spans``: array<struct<start, kind, end>>, kind being a rule's position; sorted.
    A caller's column of that name is replaced, all others are carried."""
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    indexed = {k: q for k, q in queries.items() if q is not True}
    own = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), text_or_empty(text).alias("body"))
    own = own.withColumn("key", F.xxhash64("body"))
    if indexed:
        grams = list(dict.fromkeys(g for q in indexed.values() for g in grams_of(q)))
        hits = candidates(build_index(docs, grams, text), indexed)
        own = own.join(cut(hits).hint("shuffle_hash"), "key", "left")
    none = "cast(array() AS array<struct<start: int, kind: int, end: int>>)"
    each = []
    for i, r in enumerate(rules):
        found = spans("body", r, i)
        each.append(found if r.kind not in indexed else f"CASE WHEN array_contains(coalesce(kinds, cast(array() AS array<string>)), '{r.kind}') THEN {found} ELSE {none} END")
    found = F.array_sort(F.expr(f"concat({', '.join(f'coalesce({x}, {none})' for x in each)})"))
    return own.select(*(F.col("row").getField(c).alias(c) for c in docs.columns if c != "spans"), found.alias("spans"))


def digest(found: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    kinds = "array(" + ", ".join(f"'{r.kind}'" for r in rules) + ")"
    order = {r.kind: i for i, r in enumerate(rules)}
    base = f"filter(spans, s -> s.kind IN ({', '.join(str(order[k]) for k in BASE)}))"

    def joined(of: str) -> str:
        return f"array_join(transform({of}, s -> concat_ws(':', {kinds}[s.kind], s.start, s.end)), ',')"

    return found.selectExpr(
        "doc_id", *(f"cast(size(filter(spans, s -> s.kind = {order[k]})) AS bigint) AS n_{k}" for k in BASE),
        f"sha2({joined(base)}, 256) AS base_sha256", f"{joined('spans')} AS spans",
    )


def op4_trigram_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.common import documents

    return digest(find_secrets(documents(spark, sf_dir).select("doc_id", "text")))


def _oracle() -> str:
    """All rules over all texts, without an index."""
    found = []
    for i, r in enumerate(RULES):
        p = "'" + r.spelled().replace("'", "''") + "'"
        held = f"list_transform(regexp_extract_all(text, {p}, {r.group}), lambda m: length(m) >= {r.least})"
        size = f"list_transform(regexp_extract_all(text, {p}, 0), lambda m: length(m))"
        found.append(f"SELECT n, {i} AS k, '{r.kind}' AS kind, {size} AS size, {held} AS ok, list_transform(string_split_regex(text, {p}), lambda m: length(m)) AS gap FROM d")
    found = "\n UNION ALL ".join(found)
    return f"""
WITH d AS (SELECT row_number() OVER () AS n, doc_id, coalesce(text, '') AS text FROM documents),
m AS ({found}),
e AS (SELECT n, k, kind, unnest(range(1, len(size) + 1)) AS i, size, gap, ok FROM m),
s AS (SELECT n, k, kind, list_sum(gap[1:i]) + coalesce(list_sum(size[1:i-1]), 0) AS start, size[i] AS size FROM e WHERE ok[i]),
t AS (SELECT n, k, start, kind || ':' || CAST(start AS BIGINT) || ':' || CAST(start + size AS BIGINT) AS span FROM s),
g AS (SELECT n, count(*) FILTER (WHERE k = 0) AS n_assign, count(*) FILTER (WHERE k = 1) AS n_access, count(*) FILTER (WHERE k = 2) AS n_hex,
  coalesce(string_agg(span, ',' ORDER BY start, k) FILTER (WHERE k < 3), '') AS base, string_agg(span, ',' ORDER BY start, k) AS spans FROM t GROUP BY n)
SELECT doc_id, CAST(coalesce(n_assign, 0) AS BIGINT) AS n_assign, CAST(coalesce(n_access, 0) AS BIGINT) AS n_access, CAST(coalesce(n_hex, 0) AS BIGINT) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (n)"""
