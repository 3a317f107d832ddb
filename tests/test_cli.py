"""The command line: arguments, versions, errors."""

from __future__ import annotations

import pytest

from srcgraph.__main__ import VERSION, arguments, main, operations


def test_fourteen_operations():
    assert len(operations()) == 14


def test_arguments_become_keywords():
    known = operations()
    assert arguments(known["callers_dir"], ["f", "src", "--limit", "3"]) == {"name": "f", "path": "src", "limit": 3}
    assert arguments(known["query_ast_file"], ["a.go", "(x) @y", "--include-text", "true"]) == {"path": "a.go", "query": "(x) @y", "include_text": True}
    for words in (["f"], ["f", "src", "--frob", "1"], ["f", "src", "go", "1", "extra"]):
        with pytest.raises(SystemExit):
            arguments(known["callers_dir"], words)


def test_version_and_usage(capsys):
    assert main(["-version"]) == 0
    assert capsys.readouterr().out.strip() == VERSION
    assert main(["frobnicate"]) == 2
    assert "callers_dir" in capsys.readouterr().err
