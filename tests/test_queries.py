"""Every registered relational query against its SQL, and what SQL does not cover."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from tessera.operators import aggregates, joins
from tessera.plans.registry import ORACLE_SQL, QUERIES, _usage

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(df: pd.DataFrame) -> list:
    def one(v):
        if v is None or v is pd.NaT or v is pd.NA or isinstance(v, float) and np.isnan(v):
            return "null"
        return repr(round(float(v), 6)) if isinstance(v, (int, float, np.number)) and not isinstance(v, (bool, np.bool_)) else str(v)

    return sorted(tuple(one(v) for v in row) for row in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, duck, sf_dir, name):
    got, expected = QUERIES[name](spark, sf_dir).toPandas(), duck.sql(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(expected.columns)
    assert plain(got) == plain(expected)


def test_islands_at_midnight(spark, tmp_path):
    times = [(1, "2024-01-01 23:59:58.5"), (1, "2024-01-01 23:59:59.499999"), (1, "2024-01-03 00:00:00"), (2, "2024-01-01 23:59:59.5"), (2, "2024-01-03 12:00:00"), (3, "1969-12-31 23:59:59.4"), (3, "1969-12-30 00:00:01"), (3, None), (None, "2024-01-01 23:59:59.75"), (None, "2024-01-01 00:00:00")]
    con = duckdb.connect()
    con.execute("CREATE TABLE events (user_id BIGINT, ts TIMESTAMP)")
    con.executemany("INSERT INTO events VALUES (?, ?)", times)
    con.execute(f"COPY events TO '{tmp_path}/events.parquet'")
    got = QUERIES["islands"](spark, str(tmp_path)).toPandas()
    assert plain(got) == plain(con.sql(ORACLE_SQL["islands"]).df())
    assert {(r.first, r.last, r.n) for r in got.itertuples() if r.user_id == 2} == {(19724, 19725, 2)}


def lexed(source: str) -> dict:
    """Token counts of ASCII text without raw or byte strings, one character after another."""
    n, at = dict.fromkeys("word number text char lifetime sign comment".split(), 0), 0
    while at < len(source):
        c, two = source[at], source[at : at + 2]
        if c.isspace():
            at += 1
            continue
        if two == "//":
            kind, end = "comment", (source + "\n").index("\n", at)
        elif two == "/*":
            kind, end, depth = "comment", at + 2, 1
            while depth and end < len(source):
                step = {"/*": 1, "*/": -1}.get(source[end : end + 2], 0)
                depth, end = depth + step, end + (2 if step else 1)
        elif c == '"':
            kind, end = "text", at + 1
            while end < len(source) and source[end] != '"':
                end += 2 if source[end] == "\\" else 1
            end += 1
        elif c == "'" and source[at + 2 : at + 3] == "'":
            kind, end = "char", at + 3
        elif c.isalnum() or c == "_" or c == "'" and source[at + 1 : at + 2].isalpha():
            kind, end = "number" if c.isdigit() else "lifetime" if c == "'" else "word", at + 1
            while end < len(source) and (source[end].isalnum() or source[end] == "_"):
                end += 1
        else:
            kind, end = "sign", at + (2 if two in ("::", "->", "==") else 1)
        n[kind] += 1
        at = end
    return {k: v for k, v in n.items() if k != "comment"}


def test_lexer_tokens_of_all_texts(spark, sf_dir, tmp_path):
    texts = ["plain words only", 'fn f<\'a>(x: &\'a str) -> u8 { g("a \\" // b", \'c\') } // end 1', "a /* b /* \"c\" */ d */ e 42 == x_1::y", "<a href=\"http://x\">9</a>", 'left "open', "/* left open", ""]
    spark.createDataFrame([(i, "u", x) for i, x in enumerate(texts)], "page_id bigint, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame([(i, x) for i, x in enumerate(reversed(texts))], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r["path"]: {k[2:]: v for k, v in r.asDict().items() if k != "path"} for r in QUERIES["lexer_tokens"](spark, str(tmp_path)).collect()}
    assert got == {f"pages/{i}": lexed(x) for i, x in enumerate(texts)} | {f"benchmark/{i}": lexed(x) for i, x in enumerate(reversed(texts))}
    rows = QUERIES["lexer_tokens"](spark, sf_dir).collect()
    assert len(rows) == spark.read.parquet(f"{sf_dir}/pages.parquet").count() + spark.read.parquet(f"{sf_dir}/benchmark.parquet").count()
    assert sum(r["n_text"] for r in rows if r["path"].startswith("pages/"))


def test_greedy_full_by_hand(spark):
    rows = [("p", "a"), ("p", "b"), ("q", "a"), ("r", "c"), ("r", "b"), ("s", None)]
    out = aggregates.greedy_full(spark.createDataFrame(rows, "project string, item string")).collect()
    # q needs a alone; then p needs b; then r needs c; s has no items and counts from the start
    assert [(r["item"], r["gain"], r["cumulative"]) for r in out] == [("a", 1, 2), ("b", 1, 3), ("c", 1, 4)]


def test_greedy_full_recomputed(spark, sf_dir):
    edges = {(r["project"], r["item"]) for r in _usage(spark, sf_dir).collect()}
    needs = {p: {i for q, i in edges if q == p} for p, _ in edges}
    used = {i: sum(i in n for n in needs.values()) for _, i in edges}
    taken, expected = set(), []
    while open_items := {i for n in needs.values() for i in n} - taken:
        gain = {i: sum(n - taken == {i} for n in needs.values()) for i in open_items}
        best = min(open_items, key=lambda i: (-gain[i], -used[i], i))
        taken.add(best)
        expected.append((best, gain[best]))
    got = aggregates.greedy_full(_usage(spark, sf_dir)).collect()
    assert [(r["item"], r["gain"]) for r in got] == expected


def test_milestones(spark):
    cover = spark.createDataFrame([(1, "a", 5, 5), (2, "b", 3, 8), (3, "c", 2, 10)], "rank int, item string, gain bigint, cumulative bigint")
    got = {r["target"]: r["rank"] for r in aggregates.milestones(cover, 10, (50, 70, 90, 100)).collect()}
    assert got == {50: 1, 70: 2, 90: 3, 100: 3}


def test_closure_paths(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("a", "d"), ("d", "c")], "src string, dst string")
    got = {(r["src"], r["dst"]): r["path"] for r in joins.closure(edges).collect()}
    assert got["a", "c"] == ["a", "b", "c"] and ("a", "a") not in got and got["c", "d"] == ["c", "a", "d"]


def test_prefix_join(spark):
    deps = spark.createDataFrame([("x", "a::b"), ("y", "a")], "path string, dep string")
    modules = spark.createDataFrame([("a::b",), ("a::b::c",), ("a::bc",)], "module string")
    got = {(r["path"], r["module"]) for r in joins.prefix_join(deps, "dep", modules, "module").collect()}
    assert got == {("x", "a::b"), ("x", "a::b::c"), ("y", "a::b"), ("y", "a::b::c"), ("y", "a::bc")}


def test_stream(spark, tmp_path):
    from tessera.operators.extract import facts
    from tessera.streaming.files import stream_files

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.rs").write_text("fn a() {} fn b() {}")
    q = facts(stream_files(spark, str(tmp_path / "in")), "fns").writeStream.format("memory").queryName("seen").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {r["name"] for r in spark.table("seen").collect()} == {"a", "b"}


def test_entry_imports():
    import __spark_entry__ as entry

    assert set(ORACLE_SQL) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_closure_of_a_long_chain_and_a_cycle(spark):
    edges = [(i, i + 1) for i in range(1000)] + [(2000 + i, 2000 + (i + 1) % 60) for i in range(60)]
    found = joins.closure(spark.createDataFrame(edges, "src bigint, dst bigint"), paths=False)
    chain = found.where("dst <= 1000")
    assert chain.count() == 1000 * 1001 // 2 and chain.where("depth <> dst - src").count() == 0
    cycle = found.where("src >= 2000")
    assert cycle.count() == 60 * 59 and cycle.where("depth <> pmod(dst - src, 60)").count() == 0


def test_command_line(spark, tmp_path, capsys):
    from tessera import __main__ as cli

    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.rs").write_text("verus! {\nproof fn lemma_x_len() { assume(a); }\n} // verus!\n")
    (tmp_path / "src" / "b.rs").write_text("fn plain() { }\n")
    rows = {v: cli.view(args := cli.arguments([v, *(["proof fn lemma_.*"] if v == "search" else []), "-c", str(tmp_path / "src")]), cli.sources_of(spark, args)).collect() for v in cli.VIEWS}
    assert [(r["kind"], r["name"], r["line"]) for r in rows["search"]] == [("fn", "lemma_x_len", 2)]
    assert any("assume()" in r["value"] and "a.rs:2" in r["value"] for r in rows["audit"]) and any("not_verusified" in r["value"] for r in rows["audit"])
    assert {r["content"] for r in rows["fix"]} == {"verus! {\nproof fn lemma_x_len() { proof { accept(a); }; }\n} // verus!\n", "fn plain() { }\n"}
    args = cli.arguments(["loc", "-f", str(tmp_path / "src" / "a.rs"), "-m", "a"])
    assert [r["proof"] for r in cli.view(args, cli.sources_of(spark, args)).collect()] == [1]
