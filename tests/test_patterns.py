"""Tree patterns: syntax, bindings, predicates, errors."""

from __future__ import annotations

import pytest

from srcgraph.functions import catalog
from srcgraph.plans.facts import tree_of
from srcgraph.plans.query import InvalidQuery, compiled, parse_query

SOURCE = """package p

// about
func A(x int) { f(x); g(1, 2); o.h() }
func B() { if a && b { f(a) } }
type T struct{}
"""


def run(query, source=SOURCE, language="go"):
    tree = tree_of(catalog.get(language), source.encode())
    return [[(c, tree.text(i)) for c, i in m] for m in compiled(query).matches(tree)]


def names(query, source=SOURCE):
    return [m[-1][1] for m in run(query, source)]


@pytest.mark.parametrize(
    ("query", "found"),
    [
        ("(function_declaration name: (identifier) @n)", ["A", "B"]),
        ("(call_expression function: (identifier) @c)", ["f", "g", "f"]),
        ("(call_expression function: (_) @c)", ["f", "g", "o.h", "f"]),
        ("(call_expression function: [(identifier) (selector_expression)] @c)", ["f", "g", "o.h", "f"]),
        ('(binary_expression "&&" @o)', ["&&"]),
        ("(binary_expression operator: _ @o)", ["&&"]),
        ("(argument_list . (_) @first)", ["x", "1", "a"]),
        ("(argument_list (_) @last .)", ["x", "2", "a"]),
        ("(argument_list . (_) . (_) @second)", ["2"]),
        ("(function_declaration !result name: (identifier) @n)", ["A", "B"]),
        ("(function_declaration parameters: (parameter_list (parameter_declaration)) name: (identifier) @n)", []),
        ("(function_declaration name: (identifier) @n parameters: (parameter_list (parameter_declaration)))", ["A"]),
        ('((identifier) @i (#eq? @i "f"))', ["f", "f"]),
        ('((identifier) @i (#not-eq? @i "f") (#match? @i "^[a-h]$"))', ["g", "a", "b", "a"]),
        ('((identifier) @i (#any-of? @i "A" "B"))', ["A", "B"]),
        ("((comment) @c . (function_declaration))", ["// about"]),
        ("((comment) . (function_declaration name: (identifier) @n))", ["A"]),
        ("(source_file (comment)? (function_declaration name: (identifier) @n))", ["A", "B"]),
        ("(type_spec name: (type_identifier) @t type: (struct_type))", ["T"]),
    ],
)
def test_what_is_found(query, found):
    assert names(query) == found


def test_quantifiers_gather_siblings():
    assert run("(argument_list (int_literal)+ @n)") == [[("n", "1"), ("n", "2")]]
    assert len(run("(argument_list (int_literal)* @n)")) == 4


def test_outer_captures_come_first_and_uncaptured_parts_don_t_multiply():
    assert run("(call_expression function: (identifier) @f arguments: (argument_list (int_literal))) @c") == [[("c", "g(1, 2)"), ("f", "g")]]
    assert run("(call_expression arguments: (argument_list (int_literal) @n)) @c") == [[("c", "g(1, 2)"), ("n", "1")], [("c", "g(1, 2)"), ("n", "2")]]


def test_several_patterns_and_errors_nodes():
    assert names("(type_spec name: (_) @x) (function_declaration name: (_) @x)") == ["A", "B", "T"]
    assert names("(ERROR) @e", "package p\n) )\n") != []
    assert names("(MISSING) @e", "package p\nfunc A() { f(\n") != []


@pytest.mark.parametrize("query", ["", "(", "(identifier", "[ ]", "(identifier) @x )", '((identifier) @x (#frob? @x "a"))', '((identifier) @x (#match? @x "("))', "(#eq? @a @b)", "~", '(identifier "'])
def test_invalid_queries(query):
    with pytest.raises(InvalidQuery, match="^invalid query: "):
        parse_query(query)


def test_names_are_checked_against_a_language():
    parser = catalog.get("go").parser
    with pytest.raises(InvalidQuery, match="impossible node 'no_such_node'"):
        compiled("(no_such_node) @x", parser)
    with pytest.raises(InvalidQuery, match="impossible field 'no_such_field'"):
        compiled("(call_expression no_such_field: (identifier)) @x", parser)
    compiled("(call_expression function: (identifier)) @x", parser)
