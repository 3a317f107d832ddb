"""Parsers and the catalogue: shapes, symbols of each language, errors, offsets."""

from __future__ import annotations

import ast
import random
from pathlib import Path

import pytest

from srcgraph.functions import catalog
from srcgraph.parsers.kinds import FIELDS, NODES
from srcgraph.plans.facts import facts_of, tree_of
from srcgraph.plans.query import InvalidQuery, compiled, has_name

EVERYTHING = frozenset(("symbols", "calls", "identifiers", "decisions"))


def parse(language, text):
    return tree_of(catalog.get(language), text.encode())


def kinds(language, text):
    out = {}
    for s in facts_of("x", catalog.get(language), text.encode(), EVERYTHING, None)["symbols"]:
        out.setdefault(s["kind"], []).append(s["name"])
    return out


def callees(language, text):
    return [c["callee"] for c in facts_of("x", catalog.get(language), text.encode(), EVERYTHING, None)["calls"]]


SAMPLES = {
    "bash": (
        'NAME="x $(whoami)"\ngreet() {\n  local who=$1\n  if [ -f "$who" ] && [[ $a == b || -n $c ]]; then\n    echo hi | tee log\n  elif grep -q x f; then\n    cat <<EOF\nif $x then\nEOF\n  fi\n}\nfunction other { for f in *; do echo "$f"; done; }\ncase $1 in\n  a|b) greet ;;\n  *) exit 1 ;;\nesac\n',
        "program",
        {"functions": ["greet", "other"], "variables": ["NAME", "who"]},
        ["whoami", "echo", "tee", "grep", "cat", "echo", "greet", "exit"],
    ),
    "csharp": (
        'using System;\nnamespace A.B {\n  public class C : D {\n    private int _x = 1, _y;\n    public int P { get; set; }\n    public C(int a) { _x = a; }\n    public string M(string s) { if (s != null && s.Length > 1) { return Foo(s); } var z = s?.Trim(); return $"{Bar(s)}"; }\n  }\n  interface I { void N(); }\n  struct S { }\n  enum E { X }\n}\n',
        "compilation_unit",
        {"classes": ["C"], "interfaces": ["I"], "structs": ["S"], "enums": ["E"], "methods": ["M", "N"], "properties": ["P"], "fields": ["_x", "_y"], "constructors": ["C"], "imports": ["using System;"], "namespaces": ["A.B"], "variables": ["_x", "_y", "z"]},
        ["Foo", "Bar"],
    ),
    "go": (
        'package p\n\nimport "fmt"\n\ntype T struct {\n\tA int\n}\n\nfunc (t *T) M() { fmt.Println(t.A) }\nfunc F(x int) int {\n\ta, b := 1, 2\n\tvar c int\n\treturn G(a + b + c)\n}\n',
        "source_file",
        {"types": ["T"], "functions": ["F"], "methods": ["M"], "imports": ['import "fmt"'], "variables": ["A", "a", "b", "c"]},
        ["G"],
    ),
    "java": (
        "package a.b;\nimport java.util.List;\nclass A<T> extends B {\n  private int x = 1, y;\n  A(int a) { super(a); }\n  int m(List<String> l) { int v = l.get(0).length(); for (String s : l) { n(s); } return v > 1 ? v : 0; }\n  interface I { }\n  enum E { P, Q }\n  record R(int a) { }\n}\n",
        "program",
        {"classes": ["A"], "interfaces": ["I"], "enums": ["E"], "records": ["R"], "methods": ["m"], "constructors": ["A"], "fields": ["x", "y"], "imports": ["import java.util.List;"], "variables": ["v"]},
        ["length", "get", "n"],
    ),
    "javascript": (
        "import d, { a } from 'm';\nfunction f(x) { return g(x) && o.h(); }\nclass A extends B { m() {} #p() {} }\nconst k = x => x + 1, l = `t ${q(1)}`;\nvar w = /re\\/g/.test(s);\n",
        "program",
        {"functions": ["f"], "classes": ["A"], "methods": ["m", "#p"], "imports": ["import d, { a } from 'm';", "d, { a }"], "variables": ["k", "l", "w"]},
        ["g", "o.h", "q", "/re\\/g/.test"],
    ),
    "python": (
        "import os\nfrom a import b\n\nclass A(B):\n    x = 1\n    def m(self):\n        if self.x and other():\n            return a.b(1)\n\nasync def f():\n    y: int = await g()\n    return f'{h(y)!r}'\n",
        "module",
        {"classes": ["A"], "functions": ["m", "f"], "imports": ["import os", "from a import b"], "variables": ["x", "y"]},
        ["other", "a.b", "g", "h"],
    ),
    "rust": (
        "use std::fmt;\nmod m { }\nstruct S { a: i32 }\nenum E { X }\ntrait T { fn t(&self); }\nimpl T for S { fn t(&self) { if self.a > 1 && ok() { A::f(1); } } }\ntype L = Vec<i32>;\nfn f<'a>(x: &'a str) -> usize { let y = x.len(); match y { 0 => 1, _ => g(y) } }\n",
        "source_file",
        {"functions": ["t", "f"], "structs": ["S"], "enums": ["E"], "traits": ["T"], "impls": ["T"], "modules": ["m"], "types": ["L"], "imports": ["use std::fmt;"], "variables": ["y"]},
        ["ok", "A::f", "g"],
    ),
    "typescript": (
        "import type { T } from './t';\ninterface I { a: number }\ntype U = 'a' | I[];\nenum E { A }\nclass C<T> implements I { constructor(private a: number) { f<T>(a); } }\nfunction f<T>(x: T): x is T { return g(x as T); }\nconst h = (x?: number): void => { o?.p(x!); };\n",
        "program",
        {"functions": ["f"], "classes": ["C"], "methods": ["constructor"], "interfaces": ["I"], "types": ["U"], "enums": ["E"], "imports": ["import type { T } from './t';", "{ T }"], "variables": ["h"]},
        ["f", "g", "o?.p"],
    ),
    "yaml": (
        'name: app\n"quoted": 1\nlist:\n- one\n- two: 2\nmap: {a: 1, b: [x]}\ntext: |\n  name: no\nempty:\n',
        "stream",
        {"mappings": ["name", "list", "two", "map", "text", "empty"], "sequences": ["- one", "- two: 2"]},
        ["name", "list", "two", "map", "text", "empty"],
    ),
}


@pytest.mark.parametrize("language", sorted(SAMPLES))
def test_symbols_and_calls(language):
    text, root, symbols, called = SAMPLES[language]
    tree = parse(language, text)
    assert tree.nodes[0].kind == root
    assert not tree.has_error
    assert kinds(language, text) == symbols
    assert callees(language, text) == called


@pytest.mark.parametrize("language", sorted(SAMPLES))
def test_trees_are_well_formed(language):
    draw = random.Random(language)
    text = SAMPLES[language][0]
    for cut in [text] + ["".join(draw.sample(text, len(text))) for _ in range(10)] + [text[: draw.randrange(len(text))] + draw.choice("(){}\"'`#é\n") + text[draw.randrange(len(text)) :] for _ in range(60)] + ["", "\n", "é", "(" * 300, "{" * 300, "\x00"]:
        tree = parse(language, cut)
        source = cut.encode()
        for i, n in enumerate(tree.nodes):
            assert 0 <= n.start <= n.end <= len(source)
            assert i < tree.end[i] <= len(tree.nodes)
            p = tree.parent[i]
            if p >= 0:
                assert p < i < tree.end[p] and tree.end[i] <= tree.end[p]
                assert tree.depth[i] == tree.depth[p] + 1
        facts_of("x", catalog.get(language), source, EVERYTHING, None)


@pytest.mark.parametrize("language", sorted(SAMPLES))
def test_catalogue_entries(language):
    entry = catalog.get(language)
    assert entry.extensions and entry.symbols and entry.decisions
    assert set(entry.aux) == {"identifiers", "calls"}
    for pattern in (*entry.symbols.values(), *entry.aux.values()):
        compiled(pattern, entry.parser)  # raises on a name that the parser can't make
    draw = random.Random(language)
    text = SAMPLES[language][0]
    known = has_name(entry.parser)
    for cut in [text] + ["".join(draw.sample(text, len(text))) for _ in range(20)] + [text[: draw.randrange(len(text))] + draw.choice("(){}\"'`#é\n") + text[draw.randrange(len(text)) :] for _ in range(60)]:
        for n in parse(language, cut).nodes:
            assert not n.named or known(n.kind, "node") or n.kind in ("ERROR", "_")
            assert n.field is None or known(n.field, "field")


@pytest.mark.parametrize("module", ["bash", "csharp", "ecma", "golang", "java", "python", "rust", "yaml"])
def test_names_in_the_parsers_are_declared(module):
    """Every kind that a parser's code names when it makes a node is in its language's table."""
    source = ast.parse((Path(__file__).parent.parent / "srcgraph" / "parsers" / f"{module}.py").read_text())
    languages = {"ecma": ("javascript", "typescript"), "golang": ("go",)}.get(module, (module,))
    nodes, fields = (frozenset().union(*(d[n] for n in languages)) for d in (NODES, FIELDS))
    for call in ast.walk(source):
        if isinstance(call, ast.Call) and isinstance(call.func, ast.Attribute) and call.func.attr == "make":
            kinds = [c.value for c in ast.walk(call.args[0]) if isinstance(c, ast.Constant) and isinstance(c.value, str)] if isinstance(call.args[0], (ast.Constant, ast.IfExp)) else []
            assert {k for k in kinds if k.isidentifier() and "_" in k} <= nodes
            for part in call.args[1:]:
                if isinstance(part, ast.Tuple) and isinstance(part.elts[0], ast.Constant):
                    assert part.elts[0].value in fields


def test_names_that_no_tree_has_are_invalid():
    for language, name in [("java", "foo_declaration"), ("go", "foo_statement"), ("go", "newline"), ("rust", "foo_item"), ("csharp", "foo_expression"), ("javascript", "type_alias_declaration"), *((n, "left") for n in NODES)]:
        with pytest.raises(InvalidQuery, match="impossible node"):
            compiled(f"({name}) @x", catalog.get(language).parser)
    with pytest.raises(InvalidQuery, match="impossible field"):
        compiled("(block block_mapping: (identifier)) @x", catalog.get("go").parser)
    assert compiled("(function_declaration name: (identifier) @n) @f", catalog.get("go").parser)


def test_detection_and_override():
    assert catalog.detect("a/b.tsx").name == "typescript"
    assert catalog.detect("a.GO") is None and catalog.detect("a.b/c") is None
    assert catalog.resolve("x.txt", "go").name == "go"
    with pytest.raises(ValueError, match=r'unknown language "perl" \(registered: bash, csharp, go'):
        catalog.resolve("x.go", "perl")
    with pytest.raises(ValueError, match='cannot detect language for "x.txt"'):
        catalog.resolve("x.txt")


def test_errors_still_give_symbols():
    text = "package p\nfunc A() { x := = 1 }\nfunc B() {}\n)\nfunc C() {}\n"
    assert parse("go", text).has_error
    assert {"A", "B", "C"} <= set(kinds("go", text)["functions"])


def test_positions_are_bytes():
    text = 'package p\nfunc Ä() { é := "日本" }\n'
    s = [x for x in facts_of("x", catalog.get("go"), text.encode(), EVERYTHING, None)["symbols"] if x["kind"] == "variables"][0]
    assert (s["name"], s["start"]) == ("é", {"row": 1, "col": 12})
    assert s["end"]["col"] == 12 + len('é := "日本"'.encode())


def test_a_registered_language_takes_part():
    catalog.register(catalog.Language("mini", (".mini",), "srcgraph.parsers.yaml:Yaml", {"keys": "(block_mapping_pair key: (flow_node) @name) @symbol"}, (), {}))
    try:
        assert catalog.detect("a.mini").name == "mini"
        assert kinds_of_mini() == {"keys": ["a", "b"]}
    finally:
        del catalog._registry["mini"]


def kinds_of_mini():
    out = {}
    for s in facts_of("x", catalog.get("mini"), b"a: 1\nb: 2\n", EVERYTHING, None)["symbols"]:
        out.setdefault(s["kind"], []).append(s["name"])
    return out


def test_expressions_in_markup_are_read():
    text = "function App({items}) {\n  return <ul className={cls(a > b)} {...rest()} onClick={() => go(x)}>\n    {/* note */}{}\n    {items.map(i => ok && i ? <li key={id(i)}>{show(i)}</li> : null)} text {} <b>{`a${deep(1)}`}</b>\n  </ul>;\n}\nfunction next() { return after(); }\n"
    assert callees("javascript", text) == ["cls", "rest", "go", "items.map", "id", "show", "deep", "after"]
    assert kinds("javascript", text)["functions"] == ["App", "next"]
    broken = "const a = <p>{f(1) g} and {h(2)}</p>;\nk();\n"
    assert callees("javascript", broken)[-2:] == ["h", "k"]


def test_expansions_in_here_documents_are_read():
    text = "cat <<A <<'B' <<-C\nx $(one a) `two` ${v:-$(three)} \\$(no)\nA\n$(quoted)\nB\n\t$(four\n\tC\nfive\n"
    found = callees("bash", text)
    assert {"cat", "one", "two", "three", "five"} <= set(found)
    assert not {"no", "quoted"} & set(found)
    assert "simple_expansion" in {n.kind for n in parse("bash", "cat <<A\n$v\nA\n").nodes}
