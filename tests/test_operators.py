"""The operators over small folders of our own sources."""

from __future__ import annotations

import os
import random
import shutil
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from srcgraph.api import Cancelled, Engine
from srcgraph.functions.text import byte_offset, first_line, first_line_column, line_count, occurrences
from srcgraph.operators import calls, metrics, rename, symbols, text, tree, unused
from srcgraph.plans.facts import FILES, facts, innermost, nodes
from srcgraph.plans import store
from srcgraph.plans.query import InvalidQuery
from srcgraph.plans.store import forget, stored
from srcgraph.sources.walk import from_table, read_directory, read_file, read_store, walk

PRICES = """package shop

func price(kind string, n int) int {
	if kind == "a" {
		return 1
	} else if n > 3 || n < 0 && kind != "" {
		return 2
	}
	switch n {
	case 0:
	case 1, 2:
	default:
	}
	for i := 0; i < n; i++ {
		if i%2 == 0 {
			continue
		}
	}
	return 0
}

func flat() {}
"""
STOCK = """package shop

import "fmt"

type Item struct {
	count int
}

var total = weigh(3)

func weigh(n int) int {
	return n * 2
}

func pack(items []Item) {
	for _, it := range items {
		fmt.Println(weigh(it.count), weigh(1))
	}
	seal()
}

func seal() {
	label := func() int { return weigh(4) }
	label()
}
"""
CRATES = """package shop

type Crate struct{ size int }

func (c *Crate) open() bool { return weigh(c.size) > 0 && c.size < 9 }

func (c *Crate) shut() { seal() }

func orphan() { Shelf() }

func Shelf() {}
"""


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("src")
    for name, content in {"a.go": STOCK, "b/b.go": CRATES, "c.go": PRICES, ".hidden/x.go": "package x\nfunc Gone() {}\n", ".dot.py": "def f(): pass\n", "__init__.py": "v = 1\n", "notes.txt": "weigh\n", "empty.go": ""}.items():
        path = root / name
        path.parent.mkdir(exist_ok=True)
        path.write_text(content)
    return str(root)


@pytest.fixture(scope="module")
def engine(spark):
    return Engine(spark, 0)


@pytest.fixture(scope="module")
def go_facts(spark, folder):
    return facts(read_directory(spark, folder, "go")).cache()


def short(path, folder):
    return os.path.relpath(path, folder)


def test_walk(folder, tmp_path):
    found = [short(p, folder) for p, _ in walk(folder)]
    assert found == [".dot.py", "__init__.py", "a.go", "b/b.go", "c.go", "empty.go"]
    assert [l for _, l in walk(folder, "go")] == ["go"] * 4
    assert list(walk(str(tmp_path / "no"))) == []


def test_folders_of_any_store(spark, folder):
    found = read_store(spark, f"file://{folder}")
    assert sorted((os.path.relpath(r["path"].removeprefix("file:"), folder), r["language"]) for r in found.collect()) == [("a.go", "go"), ("b/b.go", "go"), ("c.go", "go")]
    assert read_store(spark, f"file://{folder}", "python").count() == 0
    assert {r["name"] for r in symbols.search_name(facts(found, ("symbols",)), "Crate").collect()} == {"Crate"}


def test_errors_don_t_stop_a_scan(spark, engine, tmp_path):
    (tmp_path / "ok.go").write_text("package p\nfunc A() {}\n")
    os.symlink(tmp_path / "nowhere.go", tmp_path / "broken.go")
    out = engine.scan_symbols_dir(str(tmp_path))
    assert [r["path"] for r in out.rows] == [str(tmp_path / "ok.go")]
    assert list(out.errors) == [str(tmp_path / "broken.go")] and out.errors[str(tmp_path / "broken.go")].startswith("reading ")
    with pytest.raises(OSError, match="reading "):
        engine.symbols_file(str(tmp_path / "none.go"))
    with pytest.raises(ValueError, match="cannot detect language"):
        engine.symbols_file(str(tmp_path / "none.xyz"))
    assert engine.scan_symbols_dir(str(tmp_path / "missing")).rows == []


def test_symbols_and_search(engine, folder):
    got = engine.symbols_file(f"{folder}/a.go", include_text=True).rows
    weigh = next(r for r in got if r["name"] == "weigh")
    assert (weigh["kind"], weigh["text"], weigh["start"], weigh["end"]) == ("functions", "func weigh(n int) int {\n\treturn n * 2\n}", {"row": 10, "col": 0}, {"row": 12, "col": 1})
    hits = engine.search_name_dir("Crate", folder, "go")
    assert [(r["kind"], r["line"], r["col"]) for r in hits.rows] == [("types", 3, 5)] and hits.total == 1
    assert engine.search_name_dir("nothing", folder).rows == []
    assert engine.search_name_dir("crate", folder, "go").rows == []
    assert len(engine.search_name_dir("total", folder, limit=1).rows) == 1


def test_scans(engine, folder):
    variables = engine.scan_variables_dir(folder).rows
    assert {(short(r["path"], folder), r["name"]) for r in variables} == {("a.go", "count"), ("a.go", "total"), ("a.go", "label"), ("b/b.go", "size"), ("c.go", "i"), ("__init__.py", "v")}
    scanned = {short(r["path"], folder): r["kinds"] for r in engine.scan_symbols_dir(folder, "go").rows}
    assert [s["name"] for s in scanned["b/b.go"]["functions"]] == ["orphan", "Shelf"]
    assert [s["name"] for s in scanned["b/b.go"]["methods"]] == ["open", "shut"]
    assert scanned["empty.go"] == {}


def test_analyze(engine, folder):
    (row,) = engine.analyze_file(f"{folder}/c.go").rows
    assert (row["lines"], row["bytes"]) == (PRICES.count("\n") + 1, len(PRICES))
    assert row["nodes"] > 50 and row["max_nesting"] > 5
    assert row["kinds"]["functions"] == {"count": 2, "avg_lines": 9.5, "max_lines": 18}
    assert row["kinds"]["types"] == {"count": 0, "avg_lines": 0.0, "max_lines": 0}
    assert set(row["kinds"]) == {"types", "functions", "methods", "imports", "variables"}


def test_complexity(engine, folder):
    got = {r["name"]: r["complexity"] for r in engine.complexity_file(f"{folder}/c.go").rows}
    # three ifs, || and &&, the switch with its three cases, the loop
    assert got == {"price": 11, "flat": 1}
    assert engine.complexity_file(f"{folder}/empty.go").rows == []


def test_nested_functions_count_twice(spark):
    source = "function a(x) { function b(y) { if (y) g(); h(); } if (x) b(); }\n"
    files = spark.createDataFrame([("n.js", "javascript", bytearray(source.encode()))], FILES)
    found = facts(files)
    assert {r["name"]: r["complexity"] for r in metrics.complexity(found).collect()} == {"a": 3, "b": 2}
    # on one row the function listed first is the innermost
    assert {r["name"]: [c["name"] for c in r["callees"]] for r in calls.call_graph(found).collect()} == {"a": ["g", "h", "b"], "b": []}
    lines = source.replace("{ function", "{\nfunction")
    found = facts(spark.createDataFrame([("n.js", "javascript", bytearray(lines.encode()))], FILES))
    graph = {r["name"]: [c["name"] for c in r["callees"]] for r in calls.call_graph(found).collect()}
    assert graph == {"a": ["b"], "b": ["g", "h"]}


def test_call_graph_and_callers(engine, folder):
    got = {r["name"]: [(c["name"], c["count"]) for c in r["callees"]] for r in engine.call_graph_file(f"{folder}/a.go").rows}
    assert got == {"weigh": [], "pack": [("weigh", 2), ("seal", 1)], "seal": [("weigh", 1), ("label", 1)]}
    found = [(short(r["file"], folder), r["name"], r["kind"], r["line"], r["count"]) for r in sorted(engine.callers_dir("weigh", folder).rows, key=lambda r: (r["file"], r["line"]))]
    assert found == [("a.go", "pack", "functions", 15, 2), ("a.go", "seal", "functions", 22, 1), ("b/b.go", "open", "methods", 5, 1)]
    assert engine.callers_dir("nobody", folder).rows == []
    assert len(engine.callers_dir("weigh", folder, limit=2).rows) == 2


def test_a_file_of_many_functions_takes_linear_time(spark):
    n = 4000
    source = "package p\n" + "".join(f"func f{i}() {{\n\tif a && b {{ g{i % 7}(); h(); f{(i + 1) % n}(); h() }}\n}}\n" for i in range(n))
    files = spark.createDataFrame([("m.go", "go", bytearray(source.encode()))], FILES)
    began = time.perf_counter()
    found = facts(files).cache()
    graph = {r["name"]: [(c["name"], c["count"]) for c in r["callees"]] for r in calls.call_graph(found).collect()}
    assert len(graph) == n and graph["f8"] == [("g1", 1), ("h", 2), ("f9", 1)]
    assert {r["complexity"] for r in metrics.complexity(found).collect()} == {3}
    assert time.perf_counter() - began < 60


def plain_innermost(spans, points):
    """The span around each point that begins on the last row, on one row the first."""
    return [max((i for i, (s, e, _) in enumerate(spans) if s <= p < e), key=lambda i: (spans[i][2], -i), default=None) for p in points]


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 1 << 30))
def test_innermost_spans(seed):
    draw = random.Random(seed)
    spans = []

    def nest(low, high, depth):
        at = low
        while at < high and depth < 4 and draw.random() < 0.8:
            s = draw.randint(at, high)
            e = draw.randint(s, high)
            if e > s:
                spans.append((s, e, s // 5))
                nest(s, e, depth + 1)
            at = e + 1

    nest(0, 60, 0)
    draw.shuffle(spans)
    points = [draw.randint(0, 62) for _ in range(30)]
    assert innermost(spans, points) == plain_innermost(spans, points)


def test_same_named_methods_are_one_caller(spark):
    source = "class A { void m() { t(); } }\nclass B { void m() { t(); t(); } }\n"
    found = facts(spark.createDataFrame([("A.java", "java", bytearray(source.encode()))], FILES))
    assert [(r["name"], r["line"], r["count"]) for r in calls.callers(found, "t").collect()] == [("m", 1, 3)]


def test_callers_are_the_inverted_call_graph(go_facts):
    edges = {(r["path"], r["name"], c["name"]): c["count"] for r in calls.call_graph(go_facts).collect() for c in r["callees"]}
    for name in ("weigh", "seal", "Shelf", "label"):
        want = {(p, n): k for (p, n, c), k in edges.items() if c == name}
        assert {(r["file"], r["name"]): r["count"] for r in calls.callers(go_facts, name).collect()} == want


def test_rename(engine, folder, go_facts):
    rows = engine.rename_preview_dir("weigh", folder, "go").rows
    assert [(short(r["file"], folder), r["line"], r["definition"]) for r in sorted(rows, key=lambda r: (r["file"], r["line"]))] == [("a.go", 9, False), ("a.go", 11, True), ("a.go", 17, False), ("a.go", 17, False), ("a.go", 23, False), ("b/b.go", 5, False)]
    assert engine.rename_preview_dir("zzz", folder).rows == []
    assert len(engine.rename_preview_dir("weigh", folder, limit=2).rows) == 2
    assert len(engine.rename_preview_dir("weigh", folder, limit=2, per_file=True).rows) == 3
    defined = {(r["path"], r["start"]["row"] + 1) for r in symbols.symbols(go_facts).where("name = 'weigh'").collect()}
    assert defined <= {(r["file"], r["line"]) for r in rename.rename_preview(go_facts, "weigh").collect()}


def test_unused(engine, folder):
    found = {(r["name"], r["kind"]) for r in engine.unused_symbols_dir(folder, "go").rows}
    assert ("orphan", "functions") in found and ("flat", "functions") in found and ("total", "variables") in found
    assert not {"Shelf", "weigh", "label", "Crate", "seal"} & {n for n, _ in found}
    assert len(engine.unused_symbols_dir(folder, "go", limit=2).rows) == 2


def test_unused_counts_text(spark):
    sources = {
        "a.go": "package p\nfunc Foo() {}\nfunc FooBar() {}\nfunc Once() {}\nfunc Aa() {}\nfunc AaAa() {}\n",
        "b.yaml": "some key: 1\nother key: some key\nlonely key: 2\nxx: lonelyx\n+++: 1\n'a-b': x\na-b: 2\nc-d.e: 3\n++: 4\n~: 5\n" + "long: " + "q1w2" * 2000 + "lastpiece\nlastpiece: 1\n- item one\n- item two\n",
    }
    files = spark.createDataFrame([(p, p.endswith(".go") and "go" or "yaml", bytearray(s.encode())) for p, s in sources.items()], FILES)
    found = {r["name"] for r in unused.unused_symbols(facts(files), files).collect()}
    everything = "".join(sources.values())
    declared = {r["name"] for r in symbols.symbols(facts(files)).where("kind <> 'imports'").select("name").collect()}
    assert found == {n for n in declared if everything.count(n) == 1}


def test_unused_sends_no_names_to_the_driver(spark):
    source = "package p\n" + "".join(f"func name_{k:06d}() {{\n}}\n" for k in range(300))
    files = spark.createDataFrame([("a.go", "go", bytearray(source.encode())), ("b.yaml", "yaml", bytearray(b"some key: 1\nother: name_000007x\n"))], FILES)
    found = unused.unused_symbols(facts(files), files)
    assert {f"name_{k:06d}" for k in range(300) if k != 7} | {"some key", "other"} == {r["name"] for r in found.collect()}
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()


def test_query(engine, folder):
    assert [r["captures"][0]["text"] for r in engine.query_ast_file(f"{folder}/b/b.go", "(pointer_type (type_identifier) @t)").rows] == ["Crate", "Crate"]
    assert len(engine.query_ast_file(f"{folder}/b/b.go", "(identifier) @i", limit=1).rows) == 1
    assert engine.query_ast_file(f"{folder}/b/b.go", "(method_declaration name: (field_identifier) @m (parameter_list (parameter_declaration type: (slice_type))))").rows == []
    with pytest.raises(InvalidQuery, match="invalid query: "):
        engine.query_ast_file(f"{folder}/a.go", "(no_such_node) @x")
    (row,) = engine.query_ast_file(f"{folder}/a.go", '((function_declaration name: (identifier) @n) @f (#eq? @n "seal"))', include_text=True).rows
    assert [c["name"] for c in row["captures"]] == ["f", "n"] and row["captures"][0]["text"].endswith("label()\n}")


def test_parse_ast(engine, spark, folder):
    (row,) = engine.parse_ast_file(f"{folder}/b/b.go", max_depth=1).rows
    assert row["has_error"] is False and row["ast"]["type"] == "source_file"
    assert all("children" not in c for c in row["ast"]["children"])
    assert row["ast"]["children"][0] == {"type": "package_clause", "named": True, "start": {"row": 0, "col": 0}, "end": {"row": 0, "col": 12}}
    files = read_file(spark, f"{folder}/b/b.go")
    assert tree.parse_ast(files, 2).agg(F.max("depth")).first()[0] == 2
    full = nodes(files).collect()
    content = CRATES.encode()
    assert all(r["leaf_text"] == content[r["start_byte"] : r["end_byte"]].decode() for r in full if r["leaf_text"] is not None)
    for r in full[:40]:  # a node's range gives its text
        part = text.get_text(files, r["start"]["row"], r["start"]["col"], r["end"]["row"], r["end"]["col"]).first()["text"]
        assert part == content[r["start_byte"] : r["end_byte"]].decode()


def test_get_text(engine, spark, folder):
    (row,) = engine.get_text_file(f"{folder}/a.go", 10, 0, 11, 0).rows
    assert row["text"] == "func weigh(n int) int {\n"
    content = "né\nab\n\nlast".encode()
    frame = spark.createDataFrame([("x", bytearray(content))], "path string, content binary")
    starts = [0, 4, 7, 8]
    at = lambda r, c: min(len(content), starts[r] + c) if r < len(starts) else len(content)
    for a in [(0, 0), (0, 3), (0, 6), (1, 9), (3, 4), (4, 0), (9, 2)]:
        assert frame.select(byte_offset(F.col("content"), F.lit(a[0]), F.lit(a[1]))).first()[0] == at(*a)
    got = lambda *range_: text.get_text(frame, *range_).first()
    assert got(1, 0, 0, 0)["text"] is None and "precedes start" in got(1, 0, 0, 0)["error"]
    # bytes decide: a column that runs on, rows past the end
    assert got(1, 0, 0, 6)["text"] == "ab" and got(50, 0, 40, 0)["text"] == ""
    with pytest.raises(ValueError, match="precedes start"):
        engine.get_text_file(f"{folder}/a.go", 3, 0, 1, 0)
    two = spark.createDataFrame([("x", bytearray(content)), ("short", bytearray(b"a"))], "path string, content binary")
    assert {r["path"]: (r["text"], r["error"]) for r in text.get_text(two, 1, 0, 1, 2).collect()} == {"x": ("ab", None), "short": ("", None)}
    with pytest.raises(ValueError, match="negative"):
        text.get_text(frame, 0, -1, 0, 0)
    assert text.get_text(frame, 1, 1, 1, 1).first()["text"] == ""


def test_text_functions(spark):
    texts = ["a  b\tc\nrest", "  wide ", "é" * 99 + "x" + "日" * 10, "x" * 200, "x" * 201, "", "日" * 70]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in frame.select(first_line_column(F.col("t"))).collect()] == [first_line(t) for t in texts]
    assert first_line("x" * 201) == "x" * 197 + "..."
    assert [r[0] for r in frame.select(line_count(F.col("t"))).collect()] == [t.count("\n") + 1 for t in texts]
    assert spark.range(1).select(occurrences(F.lit("aaaa"), F.lit("aa")), occurrences(F.lit("a"), F.lit(""))).first() == (2, 0)


def test_tables_as_sources(spark):
    frame = spark.createDataFrame([("a.py", "x = 1"), ("b.txt", "y"), ("c.PY", "z")], "path string, content string")
    assert [(r["path"], r["language"]) for r in from_table(frame).collect()] == [("a.py", "python")]
    assert from_table(frame, language="python").count() == 3
    found = facts(spark.createDataFrame([("a", "cobol", bytearray(b"")), ("b", "go", None)], FILES))
    assert {r["path"]: r["message"].split(" ")[0] for r in symbols.errors(found).collect()} == {"a": "unknown", "b": "reading"}


def test_deep_files_and_errors_of_single_files(spark, engine, tmp_path):
    deep = "package p\n\nvar x = " + "(" * 20_000 + "1" + ")" * 20_000 + "\n"
    rows = [("deep.go", "go", bytearray(deep.encode())), ("ok.go", "go", bytearray(b"package p\nvar y = (1)\n")), ("odd", "cobol", bytearray(b"x")), ("gone.go", "go", None)]
    files = spark.createDataFrame(rows, FILES)
    found = {r["path"]: r["n"] for r in tree.query_ast(files, "(parenthesized_expression) @p").where("error is null").groupBy("path").agg(F.count("*").alias("n")).collect()}
    assert found == {"deep.go": 20_000, "ok.go": 1}
    wrong = {"odd": "unknown", "gone.go": "reading"}
    for frame in (tree.query_ast(files, "(parenthesized_expression) @p"), nodes(files), symbols.errors(facts(files)).select("path", F.col("message").alias("error"))):
        assert {r["path"]: r["error"].split(" ")[0] for r in frame.where("error is not null").collect()} == wrong
    assert nodes(files).where("path = 'deep.go'").agg(F.max("depth")).first()[0] > 20_000
    assert facts(files).where("path = 'deep.go' and error is null and max_nesting > 20000").count() == 1


def test_languages(engine):
    assert [r["language"] for r in engine.list_languages().rows] == ["bash", "csharp", "go", "java", "javascript", "python", "rust", "typescript", "yaml"]


def test_time_limit(spark, folder):
    slow = Engine(spark, 0.001)
    with pytest.raises(Cancelled):
        slow.scan_symbols_dir(folder)
    assert Engine(spark, 60).scan_symbols_dir(folder).elapsed_ms > 0


def test_no_shuffle_within_files(go_facts, capsys):
    for frame in (calls.call_graph(go_facts), metrics.complexity(go_facts), metrics.analyze(go_facts), rename.rename_preview(go_facts, "weigh"), calls.callers(go_facts, "weigh"), symbols.scan_symbols(go_facts)):
        frame.explain()
        assert "Exchange" not in capsys.readouterr().out


def test_stored_tables_are_made_once(spark):
    made = []
    table = lambda: (made.append(1), spark.range(len(made)))[1]
    assert [stored(spark, "numbers", table).count() for _ in range(3)] == [1, 1, 1]
    forget(spark, "numbers")
    assert stored(spark, "numbers", table).count() == 2
    shutil.rmtree(store._paths[spark.sparkContext.applicationId, "numbers"].removeprefix("file://"))
    assert stored(spark, "numbers", table).count() == 3


def test_some_columns_of_trees(spark, folder):
    files = read_file(spark, f"{folder}/a.go")
    some = tree.parse_ast(files, -1, ("kind", "start", "error"))
    assert some.columns == ["kind", "start", "error"]
    assert sorted(map(str, some.collect())) == sorted(map(str, nodes(files).select("kind", "start", "error").collect()))


def test_streaming(spark, tmp_path):
    from srcgraph.streaming.incremental import read_files, write_facts

    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    frame = lambda n: spark.createDataFrame([(f"{n}.go", "go", bytearray(f"package p\nfunc F{n}() {{}}\n".encode()))], FILES)
    frame(1).write.parquet(source)
    for n in (2, 3):
        write_facts(read_files(spark, source), out, str(tmp_path / "state")).awaitTermination()
        frame(n).write.mode("append").parquet(source)
    write_facts(read_files(spark, source), out, str(tmp_path / "state")).awaitTermination()
    assert {r["name"] for r in symbols.symbols(spark.read.parquet(out)).collect()} == {"F1", "F2", "F3"}
