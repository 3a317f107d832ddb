"""The language catalogue: a closed table, and a registry that takes more languages."""

from __future__ import annotations

import importlib
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Language:
    """A language: its file extensions, parser, symbol patterns by kind, decision kinds, identifier and call patterns.

    parser: module and class, "package.module:Class".
    """

    name: str
    extensions: tuple[str, ...]
    parser: str
    symbols: dict[str, str]
    decisions: tuple[str, ...]
    aux: dict[str, str] = field(default_factory=dict)

    def make_parser(self, text: str):
        module, _, name = self.parser.partition(":")
        return getattr(importlib.import_module(module), name)(text)


# What each language's symbols, identifiers, calls and decisions are. A binary expression counts as a
# decision only with && or ||.
LANGUAGES = (
    Language(
        "bash",
        (".sh", ".bash"),
        "srcgraph.parsers.bash:Bash",
        {
            "functions": "(function_definition name: (word) @name) @symbol",
            "variables": "(variable_assignment variable: (variable_name) @name) @symbol",
        },
        ("if_statement", "elif_clause", "for_statement", "c_style_for_statement", "while_statement", "case_statement", "case_item", "pipeline", "command_substitution", "test_command", "binary_expression"),
        {"identifiers": "[(word) (variable_name)] @id", "calls": "(command_name (word) @callee)"},
    ),
    Language(
        "csharp",
        (".cs",),
        "srcgraph.parsers.csharp:CSharp",
        {
            "classes": "(class_declaration name: (identifier) @name) @symbol",
            "interfaces": "(interface_declaration name: (identifier) @name) @symbol",
            "structs": "(struct_declaration name: (identifier) @name) @symbol",
            "enums": "(enum_declaration name: (identifier) @name) @symbol",
            "methods": "(method_declaration name: (identifier) @name) @symbol",
            "properties": "(property_declaration name: (identifier) @name) @symbol",
            "fields": "(field_declaration (variable_declaration (variable_declarator name: (identifier) @name))) @symbol",
            "constructors": "(constructor_declaration name: (identifier) @name) @symbol",
            "imports": "(using_directive) @symbol",
            "namespaces": "(namespace_declaration name: [(identifier) (qualified_name)] @name) @symbol",
            "variables": "(variable_declaration (variable_declarator name: (identifier) @name)) @symbol",
        },
        ("if_statement", "for_statement", "foreach_statement", "while_statement", "do_statement", "switch_statement", "switch_section", "ternary_expression", "catch_clause", "binary_expression"),
        {"identifiers": "[(identifier) (qualified_name)] @id", "calls": "(invocation_expression function: [(identifier) (member_access_expression (identifier))] @callee)"},
    ),
    Language(
        "go",
        (".go",),
        "srcgraph.parsers.golang:Go",
        {
            "types": "(type_spec name: (type_identifier) @name) @symbol",
            "functions": "(function_declaration name: (identifier) @name) @symbol",
            "methods": "(method_declaration name: (field_identifier) @name) @symbol",
            "imports": "(import_declaration) @symbol",
            "variables": "[(short_var_declaration left: (expression_list (identifier) @name)) (var_declaration (var_spec (identifier) @name)) (field_declaration name: (field_identifier) @name)] @symbol",
        },
        ("if_statement", "for_statement", "expression_switch_statement", "type_switch_statement", "select_statement", "expression_case", "type_case", "communication_case", "default_case", "binary_expression"),
        {"identifiers": "[(identifier) (type_identifier) (field_identifier)] @id", "calls": "(call_expression function: [(identifier) (field_identifier)] @callee)"},
    ),
    Language(
        "java",
        (".java",),
        "srcgraph.parsers.java:Java",
        {
            "classes": "(class_declaration name: (identifier) @name) @symbol",
            "interfaces": "(interface_declaration name: (identifier) @name) @symbol",
            "enums": "(enum_declaration name: (identifier) @name) @symbol",
            "records": "(record_declaration name: (identifier) @name) @symbol",
            "methods": "(method_declaration name: (identifier) @name) @symbol",
            "constructors": "(constructor_declaration name: (identifier) @name) @symbol",
            "fields": "(field_declaration declarator: (variable_declarator name: (identifier) @name)) @symbol",
            "imports": "(import_declaration) @symbol",
            "variables": "(local_variable_declaration declarator: (variable_declarator name: (identifier) @name)) @symbol",
        },
        ("if_statement", "for_statement", "enhanced_for_statement", "while_statement", "do_statement", "switch_expression", "switch_block_statement_group", "switch_rule", "ternary_expression", "catch_clause", "binary_expression"),
        {"identifiers": "[(identifier) (type_identifier) (scoped_identifier)] @id", "calls": "(method_invocation name: (identifier) @callee)"},
    ),
    Language(
        "javascript",
        (".js", ".jsx"),
        "srcgraph.parsers.ecma:JavaScript",
        {
            "functions": "(function_declaration name: (identifier) @name) @symbol",
            "classes": "(class_declaration name: (identifier) @name) @symbol",
            "methods": "(method_definition name: [(property_identifier) (private_property_identifier)] @name) @symbol",
            "imports": "[(import_statement) (import_clause)] @symbol",
            "variables": "[(lexical_declaration (variable_declarator name: (identifier) @name)) (variable_declaration (variable_declarator name: (identifier) @name))] @symbol",
        },
        ("if_statement", "for_statement", "for_in_statement", "while_statement", "do_statement", "switch_statement", "switch_case", "ternary_expression", "catch_clause", "binary_expression"),
        {"identifiers": "[(identifier) (property_identifier) (private_property_identifier)] @id", "calls": "(call_expression function: [(identifier) (member_expression (property_identifier))] @callee)"},
    ),
    Language(
        "python",
        (".py",),
        "srcgraph.parsers.python:Python",
        {
            "classes": "(class_definition name: (identifier) @name) @symbol",
            "functions": "(function_definition name: (identifier) @name) @symbol",
            "imports": "[(import_statement) (import_from_statement)] @symbol",
            "variables": "(assignment left: (identifier) @name) @symbol",
        },
        ("if_statement", "for_statement", "while_statement", "conditional_expression", "boolean_operator", "except_clause", "case_clause"),
        {"identifiers": "[(identifier) (attribute)] @id", "calls": "(call function: [(identifier) (attribute)] @callee)"},
    ),
    Language(
        "rust",
        (".rs",),
        "srcgraph.parsers.rust:Rust",
        {
            "functions": "(function_item name: (identifier) @name) @symbol",
            "structs": "(struct_item name: (type_identifier) @name) @symbol",
            "enums": "(enum_item name: (type_identifier) @name) @symbol",
            "traits": "(trait_item name: (type_identifier) @name) @symbol",
            "impls": "(impl_item trait: (type_identifier) @name) @symbol",
            "modules": "(mod_item name: (identifier) @name) @symbol",
            "types": "(type_item name: (type_identifier) @name) @symbol",
            "imports": "(use_declaration) @symbol",
            "variables": "(let_declaration pattern: (identifier) @name) @symbol",
        },
        ("if_expression", "if_let_expression", "for_expression", "while_expression", "loop_expression", "match_expression", "match_arm", "binary_expression"),
        {"identifiers": "[(identifier) (type_identifier) (field_identifier) (scoped_identifier)] @id", "calls": "(call_expression function: [(identifier) (field_identifier) (scoped_identifier)] @callee)"},
    ),
    Language(
        "typescript",
        (".ts", ".tsx"),
        "srcgraph.parsers.ecma:TypeScript",
        {
            "functions": "(function_declaration name: (identifier) @name) @symbol",
            "classes": "(class_declaration name: (type_identifier) @name) @symbol",
            "methods": "(method_definition name: [(property_identifier) (private_property_identifier)] @name) @symbol",
            "interfaces": "(interface_declaration name: (type_identifier) @name) @symbol",
            "types": "(type_alias_declaration name: (type_identifier) @name) @symbol",
            "enums": "(enum_declaration name: (identifier) @name) @symbol",
            "imports": "[(import_statement) (import_clause)] @symbol",
            "variables": "[(lexical_declaration (variable_declarator name: (identifier) @name)) (variable_declaration (variable_declarator name: (identifier) @name))] @symbol",
        },
        ("if_statement", "for_statement", "for_in_statement", "while_statement", "do_statement", "switch_statement", "switch_case", "ternary_expression", "catch_clause", "binary_expression"),
        {"identifiers": "[(identifier) (property_identifier) (private_property_identifier) (type_identifier)] @id", "calls": "(call_expression function: [(identifier) (member_expression (property_identifier))] @callee)"},
    ),
    Language(
        "yaml",
        (".yaml", ".yml"),
        "srcgraph.parsers.yaml:Yaml",
        {
            "mappings": "(block_mapping_pair key: (flow_node (plain_scalar (string_scalar)) @name)) @symbol",
            "sequences": "(block_sequence_entry) @symbol",
        },
        ("block_mapping_pair", "block_sequence_entry", "flow_mapping", "flow_sequence"),
        {"identifiers": "[(plain_scalar (string_scalar)) (double_quote_scalar) (single_quote_scalar)] @id", "calls": "(block_mapping_pair key: (flow_node (plain_scalar (string_scalar)) @callee))"},
    ),
)

#: Kinds of symbols that can hold calls and have a complexity, in this order.
FUNCTION_KINDS = ("functions", "methods", "constructors")

_registry: dict[str, Language] = {}


def register(language: Language) -> None:
    """Add a language, or replace one of its name."""
    _registry[language.name] = language


for _language in LANGUAGES:
    register(_language)


def names() -> list[str]:
    return sorted(_registry)


def get(name: str) -> Language:
    """The language of a name; an unknown one is an error that lists the known."""
    if name not in _registry:
        raise ValueError(f'unknown language "{name}" (registered: {", ".join(names())})')
    return _registry[name]


def detect(path: str) -> Language | None:
    """The language of a path by its last extension, case-sensitively."""
    last = path.rsplit("/", 1)[-1]
    extension = "." + last.rsplit(".", 1)[1] if "." in last else ""
    return next((l for n in names() for l in (_registry[n],) if extension and extension in l.extensions), None)


def resolve(path: str, name: str | None = None) -> Language:
    """The named language, else that of the path; an error if neither is known."""
    if name:
        return get(name)
    found = detect(path)
    if found is None:
        raise ValueError(f'cannot detect language for "{path}"; pass one of: {", ".join(names())}')
    return found


def by_extension() -> dict[str, str]:
    return {e: n for n in names() for e in _registry[n].extensions}


def list_languages(spark: SparkSession) -> DataFrame:
    """language, sorted."""
    return spark.createDataFrame([(n,) for n in names()], "language string").orderBy("language")


def catalogue(spark: SparkSession) -> DataFrame:
    """The whole table."""
    rows = [(l.name, list(l.extensions), dict(l.symbols), list(l.decisions), dict(l.aux)) for n in names() for l in (_registry[n],)]
    return spark.createDataFrame(rows, "name string, extensions array<string>, symbol_queries map<string,string>, decision_kinds array<string>, aux_queries map<string,string>").orderBy("name")
