"""From files to one row of facts each, or to rows of nodes.

A file is parsed once, in one Arrow pass, and all that the operators ask of it comes out as arrays
of structs in its row: symbols, calls, identifiers, decisions, totals. A file bounds its row, so
every question within files is answered row by row with array functions, without a shuffle; only
questions across files move data.
"""

from __future__ import annotations

import bisect
import gc
import sys
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import catalog
from ..functions.text import first_line
from ..parsers.core import Tree, place_comments
from .query import InvalidQuery, compiled, has_name, parse_query

FILES = "path string, language string, content binary"
POINT = "struct<row:int,col:int>"
SYMBOL = f"struct<kind:string,ord:int,name:string,has_name:boolean,name_start:{POINT},text:string,full_text:string,start:{POINT},end:{POINT},node_id:int,subtree_end:int>"
FACTS = (
    "path string, language string, error string, has_error boolean, lines int, bytes long, nodes int, max_nesting int, "
    f"symbols array<{SYMBOL}>, calls array<struct<ord:int,callee:string,start:{POINT},place:int>>, "
    f"functions array<struct<place:int,name:string,kind:string,start:{POINT},end:{POINT},complexity:int,callees:array<struct<name:string,count:int,first:int>>>>, "
    f"identifiers array<struct<ord:int,text:string,parent_text:string,start:{POINT}>>, decisions array<int>"
)
_POINT = pa.struct([("row", pa.int32()), ("col", pa.int32())])
_SYMBOL = pa.struct([("kind", pa.string()), ("ord", pa.int32()), ("name", pa.string()), ("has_name", pa.bool_()), ("name_start", _POINT), ("text", pa.string()), ("full_text", pa.string()), ("start", _POINT), ("end", _POINT), ("node_id", pa.int32()), ("subtree_end", pa.int32())])
_CALL = pa.struct([("ord", pa.int32()), ("callee", pa.string()), ("start", _POINT), ("place", pa.int32())])
_CALLEES = pa.list_(pa.struct([("name", pa.string()), ("count", pa.int32()), ("first", pa.int32())]))
_FUNCTION = pa.struct([("place", pa.int32()), ("name", pa.string()), ("kind", pa.string()), ("start", _POINT), ("end", _POINT), ("complexity", pa.int32()), ("callees", _CALLEES)])
_IDENTIFIER = pa.struct([("ord", pa.int32()), ("text", pa.string()), ("parent_text", pa.string()), ("start", _POINT)])
_FACTS = pa.schema([("path", pa.string()), ("language", pa.string()), ("error", pa.string()), ("has_error", pa.bool_()), ("lines", pa.int32()), ("bytes", pa.int64()), ("nodes", pa.int32()), ("max_nesting", pa.int32()), ("symbols", pa.list_(_SYMBOL)), ("calls", pa.list_(_CALL)), ("functions", pa.list_(_FUNCTION)), ("identifiers", pa.list_(_IDENTIFIER)), ("decisions", pa.list_(pa.int32()))])


#: Python frames that a parser may nest; its calls take no room on the C stack. Beyond it a file is an error.
DEEPEST = 2_000_000


def tree_of(language: catalog.Language, content: bytes) -> Tree:
    """The syntax tree of a file; whatever can't be read is in ERROR nodes.

    Trees have no cycles, so the collector would only walk their many objects in vain.
    """
    if sys.getrecursionlimit() < DEEPEST:
        sys.setrecursionlimit(DEEPEST)
    collecting = gc.isenabled()
    gc.disable()
    try:
        parser = language.make_parser(content.decode("latin-1"))
        root = parser.file()
        place_comments(root, parser.comments)
        return Tree(content, root)
    finally:
        if collecting:
            gc.enable()


def point(tree: Tree, offset: int) -> dict[str, int]:
    row, col = tree.point(offset)
    return {"row": row, "col": col}


def symbols_of(tree: Tree, language: catalog.Language, full: bool, kinds: tuple[str, ...] | None) -> list[dict]:
    out = []
    for kind, pattern in language.symbols.items():
        if kinds is not None and kind not in kinds:
            continue
        for n, match in enumerate(compiled(pattern).matches(tree)):
            symbol = next((i for c, i in match if c == "symbol"), None)
            if symbol is None:
                continue
            name = next((i for c, i in match if c == "name"), None)
            node, text = tree.nodes[symbol], tree.text(symbol)
            summary = first_line(text)
            label = first_line(tree.text(name)) if name is not None else ""
            out.append({
                "kind": kind, "ord": n, "name": label or summary, "has_name": name is not None, "name_start": point(tree, tree.nodes[name].start) if name is not None else None,
                "text": summary, "full_text": text if full else None, "start": point(tree, node.start), "end": point(tree, node.end), "node_id": symbol, "subtree_end": tree.end[symbol],
            })
    return out


def decisions_of(tree: Tree, kinds: frozenset[str]) -> list[int]:
    """Nodes that branch; a binary expression only if one of its leaves is && or ||."""
    logical = lambda i: any(not k.kids and tree.source[k.start : k.end] in (b"&&", b"||") for k in tree.nodes[i].kids)
    return sorted(i for kind in kinds for i in tree.by_kind.get(kind, ()) if kind != "binary_expression" or logical(i))


def innermost(spans: list[tuple[int, int, int]], points: list[int]) -> list[int | None]:
    """For each point the place of the span (start, end, row of the start) around it that begins on the last row; on one row the first.

    Spans are nested or apart, so one pass over both with a stack does.
    """
    out: list[int | None] = [None] * len(points)
    todo = sorted(range(len(spans)), key=lambda i: (-spans[i][0], spans[i][1], i))  # the next one at the end
    stack: list[tuple[int, int, int]] = []  # end, row, place
    for n in sorted(range(len(points)), key=points.__getitem__):
        while todo and spans[todo[-1]][0] <= points[n]:
            place = todo.pop()
            start, end, row = spans[place]
            while stack and stack[-1][0] <= start:
                stack.pop()
            best = min(place, stack[-1][2]) if stack and stack[-1][1] == row else place
            stack.append((end, row, best))
        while stack and stack[-1][0] <= points[n]:
            stack.pop()
        if stack:
            out[n] = stack[-1][2]
    return out


def functions_of(tree: Tree, symbols: list[dict], calls: list[dict] | None, decisions: list[int] | None) -> list[dict]:
    """A file's functions, methods and constructors in this order, with what lies in them; gives each call its place."""
    made = [s for kind in catalog.FUNCTION_KINDS for s in symbols if s["kind"] == kind]
    callees: list[dict[str, list[int]]] = [{} for _ in made]
    if calls is not None:
        spans = [(tree.nodes[s["node_id"]].start, tree.nodes[s["node_id"]].end, s["start"]["row"]) for s in made]
        offsets = [tree.lines[c["start"]["row"]] + c["start"]["col"] for c in calls]
        for call, place in zip(calls, innermost(spans, offsets), strict=True):
            call["place"] = place
            if place is not None:
                callees[place].setdefault(call["callee"], [0, call["ord"]])[0] += 1
    out = []
    for place, s in enumerate(made):
        inside = None if decisions is None else 1 + bisect.bisect_left(decisions, s["subtree_end"]) - bisect.bisect_left(decisions, s["node_id"])
        called = None if calls is None else [{"name": c, "count": n, "first": first} for c, (n, first) in callees[place].items()]
        out.append({"place": place, "name": s["name"], "kind": s["kind"], "start": s["start"], "end": s["end"], "complexity": inside, "callees": called})
    return out


def facts_of(path: str, language: catalog.Language, content: bytes, want: frozenset[str], kinds: tuple[str, ...] | None) -> dict:
    """One row of FACTS; parts that are not wanted are null."""
    row = dict.fromkeys(_FACTS.names) | {"path": path, "language": language.name, "lines": content.count(b"\n") + 1, "bytes": len(content)}
    try:
        tree = tree_of(language, content)
    except RecursionError:
        return row | {"error": "nested too deeply"}
    row |= {"has_error": tree.has_error, "nodes": len(tree.nodes), "max_nesting": max(tree.depth) + 1}
    if "symbols" in want:
        row["symbols"] = symbols_of(tree, language, "full_text" in want, kinds)
    if "calls" in want and "calls" in language.aux:
        calls = []
        for n, match in enumerate(compiled(language.aux["calls"]).matches(tree)):
            callee = tree.text(match[0][1])
            if callee:
                calls.append({"ord": n, "callee": callee, "start": point(tree, tree.nodes[match[0][1]].start)})
        row["calls"] = calls
    if "identifiers" in want and "identifiers" in language.aux:
        row["identifiers"] = [
            {"ord": n, "text": tree.text(i), "parent_text": first_line(tree.text(max(0, tree.parent[i]))), "start": point(tree, tree.nodes[i].start)}
            for n, i in enumerate(i for match in compiled(language.aux["identifiers"]).matches(tree) for _, i in match)
        ]
    if "decisions" in want:
        row["decisions"] = decisions_of(tree, frozenset(language.decisions))
    if row["symbols"] is not None:
        row["functions"] = functions_of(tree, row["symbols"], row["calls"], row["decisions"])
    return row


def problem(path: str, name: str, content: bytes | None, languages: dict[str, catalog.Language], error: str | None = None) -> str | None:
    """Why a file can't be parsed; None if it can."""
    if error is not None:
        return error
    if name not in languages:
        return f'unknown language "{name}" (registered: {", ".join(sorted(languages))})'
    return f"reading {path}: no content" if content is None else None


def _languages() -> dict[str, catalog.Language]:
    return {n: catalog.get(n) for n in catalog.names()}


def facts(files: DataFrame, want: Iterable[str] = ("symbols", "calls", "identifiers", "decisions"), kinds: tuple[str, ...] | None = None) -> DataFrame:
    """FACTS of files(path, language, content). kinds: the only symbol kinds to look for."""
    languages, wanted = _languages(), frozenset(want)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                rows = []
                for path, name, content in zip(*(c.to_pylist() for c in batch.slice(start, 64).columns), strict=True):
                    if wrong := problem(path, name, content, languages):
                        rows.append(dict.fromkeys(_FACTS.names) | {"path": path, "language": name, "error": wrong})
                    else:
                        rows.append(facts_of(path, languages[name], bytes(content), wanted, kinds))
                yield pa.RecordBatch.from_pylist(rows, schema=_FACTS)

    return files.select("path", "language", "content").mapInArrow(run, FACTS)


NODE_COLUMNS = (
    *"path string, language string, node_id int, parent_id int, subtree_end int, depth int, child_index int, kind string, field string, named boolean".split(", "),
    *"is_error boolean, is_missing boolean, start_byte long, end_byte long".split(", "),
    f"start {POINT}",
    f"end {POINT}",
    "leaf_text string",
    "error string",
)
_NODES = pa.schema([("path", pa.string()), ("language", pa.string())] + [(c, pa.int32()) for c in ("node_id", "parent_id", "subtree_end", "depth", "child_index")] + [("kind", pa.string()), ("field", pa.string()), ("named", pa.bool_()), ("is_error", pa.bool_()), ("is_missing", pa.bool_()), ("start_byte", pa.int64()), ("end_byte", pa.int64()), ("start", _POINT), ("end", _POINT), ("leaf_text", pa.string()), ("error", pa.string())])


def nodes(files: DataFrame, max_depth: int | None = None, columns: tuple[str, ...] | None = None) -> DataFrame:
    """One row a node, in preorder: a descendant d of a has node_id <= d.node_id < subtree_end.

    max_depth: the deepest level to give, the root being 0; no limit if None or negative. A file that can't
    be parsed is one row with an error and nothing else. columns: the only ones to make.
    """
    languages = _languages()
    schema = pa.schema([f for f in _NODES if columns is None or f.name in columns])
    of: dict[str, Callable[[Tree, list[int], list], list]] = {
        "node_id": lambda t, span, n: span,
        "parent_id": lambda t, span, n: [t.parent[i] for i in span],
        "subtree_end": lambda t, span, n: [t.end[i] for i in span],
        "depth": lambda t, span, n: [t.depth[i] for i in span],
        "child_index": lambda t, span, n: [t.place[i] for i in span],
        "kind": lambda t, span, n: [x.kind for x in n],
        "field": lambda t, span, n: [x.field for x in n],
        "named": lambda t, span, n: [x.named for x in n],
        "is_error": lambda t, span, n: [x.kind == "ERROR" for x in n],
        "is_missing": lambda t, span, n: [x.missing for x in n],
        "start_byte": lambda t, span, n: [x.start for x in n],
        "end_byte": lambda t, span, n: [x.end for x in n],
        "start": lambda t, span, n: [point(t, x.start) for x in n],
        "end": lambda t, span, n: [point(t, x.end) for x in n],
        "leaf_text": lambda t, span, n: [None if x.kids else t.text(i) for i, x in zip(span, n, strict=True)],
    }
    limit = max_depth if max_depth is not None and max_depth >= 0 else None

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, name, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                wrong = problem(path, name, content, languages)
                try:
                    tree = None if wrong else tree_of(languages[name], bytes(content))
                except RecursionError:
                    wrong = "nested too deeply"
                if wrong:
                    row = {"path": path, "language": name, "error": wrong}
                    yield pa.RecordBatch.from_pylist([{c: row.get(c) for c in schema.names}], schema=schema)
                    continue
                for s in range(0, len(tree.nodes), 20_000):
                    span = [i for i in range(s, min(s + 20_000, len(tree.nodes))) if limit is None or tree.depth[i] <= limit]
                    n = [tree.nodes[i] for i in span]
                    same = {"path": path, "language": name, "error": None}
                    yield pa.RecordBatch.from_arrays([pa.array([same[f.name]] * len(span) if f.name in same else of[f.name](tree, span, n), f.type) for f in schema], schema=schema)

    chosen = [c for c in NODE_COLUMNS if columns is None or c.split(" ")[0] in columns]
    return files.select("path", "language", "content").mapInArrow(run, ", ".join(chosen))


MATCHES = f"path string, match_id int, captures array<struct<name:string,text:string,start:{POINT},end:{POINT}>>, error string"
_MATCHES = pa.schema([("path", pa.string()), ("match_id", pa.int32()), ("captures", pa.list_(pa.struct([("name", pa.string()), ("text", pa.string()), ("start", _POINT), ("end", _POINT)]))), ("error", pa.string())])


def check_query(query: str, language: str | None = None) -> None:
    """Raise InvalidQuery unless the text is a query; with a language, unless all its names are that language's."""
    if language is not None:
        parse_query(query, has_name(catalog.get(language).parser))
        return
    tests = [has_name(catalog.get(n).parser) for n in catalog.names()]
    parse_query(query, lambda name, what: any(t(name, what) for t in tests))


def query_matches(files: DataFrame, query: str, full: bool = False, limit: int = 0) -> DataFrame:
    """All matches of a query in each file, at most `limit` a file if above 0; files of languages that lack its names have none, one that can't be parsed has a row with its error."""
    languages = _languages()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, name, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                wrong = problem(path, name, content, languages)
                try:
                    found = [] if wrong else compiled(query, languages[name].parser).matches(tree := tree_of(languages[name], bytes(content)))
                except InvalidQuery:
                    continue
                except RecursionError:
                    wrong = "nested too deeply"
                if wrong:
                    yield pa.RecordBatch.from_pylist([{"path": path, "error": wrong}], schema=_MATCHES)
                    continue
                rows = []
                for n, match in enumerate(found[:limit] if limit > 0 else found):
                    captures = sorted(match, key=lambda c: c[1])
                    shown = [{"name": c, "text": tree.text(i) if full else first_line(tree.text(i)), "start": point(tree, tree.nodes[i].start), "end": point(tree, tree.nodes[i].end)} for c, i in captures]
                    rows.append({"path": path, "match_id": n, "captures": shown})
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=_MATCHES)

    return files.select("path", "language", "content").mapInArrow(run, MATCHES)


def nested(rows: list) -> dict:
    """The tree of one file's collected node rows as nested dicts, without empty fields and children."""
    made: dict[int, dict] = {}
    root: dict = {}
    for r in sorted(rows, key=lambda r: r["node_id"]):
        node = {"type": r["kind"], "named": r["named"], "start": r["start"].asDict(), "end": r["end"].asDict()}
        if r["field"]:
            node["field"] = r["field"]
        made[r["node_id"]] = node
        if r["parent_id"] in made:
            made[r["parent_id"]].setdefault("children", []).append(node)
        else:
            root = node
    return root
