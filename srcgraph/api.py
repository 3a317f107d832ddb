"""The fourteen operations by name, with results, errors, limits and time limits.

`Engine` keeps a corpus's facts: files are parsed once and then asked many times. Operations on one
file raise on an unknown language or a missing file; operations on folders report such files in
`errors` and go on.
"""

from __future__ import annotations

import functools
import logging
import threading
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from .functions import catalog
from .operators import calls, metrics, rename, symbols, text, tree, unused
from .plans.facts import facts as parse_facts
from .sources.walk import read_directory, read_file

log = logging.getLogger("srcgraph")


class Cancelled(RuntimeError):
    """An operation went past its time limit, or was cancelled."""


@dataclass
class Result:
    """Rows of an operation, its errors by path, and how long it took."""

    rows: list[dict]
    language: str | None = None
    errors: dict[str, str] = field(default_factory=dict)
    total: int | None = None
    elapsed_ms: float = 0.0


def timed(method: Callable) -> Callable:
    """Time a method and stop its Spark jobs after the engine's time limit."""

    @functools.wraps(method)
    def run(self: Engine, *args, **kwargs) -> Result:
        began, tag, late = time.perf_counter(), f"srcgraph-{uuid.uuid4().hex}", threading.Event()

        def stop() -> None:
            late.set()
            self.spark.interruptTag(tag)

        timer = threading.Timer(self.timeout, stop) if self.timeout > 0 else None
        self.spark.addTag(tag)
        if timer:
            timer.start()
        try:
            out = method(self, *args, **kwargs)
        except Exception as e:
            if late.is_set():
                raise Cancelled(f"{method.__name__} took more than {self.timeout} s") from e
            raise
        finally:
            if timer:
                timer.cancel()
            self.spark.removeTag(tag)
            while self._kept:
                self._kept.pop().unpersist()
        if late.is_set():
            raise Cancelled(f"{method.__name__} took more than {self.timeout} s")
        out.elapsed_ms = round((time.perf_counter() - began) * 1000, 3)
        log.info("%s took %s ms", method.__name__, out.elapsed_ms)
        return out

    return run


class Engine:
    """Questions about files and folders. timeout: seconds for each, 0 for no limit."""

    def __init__(self, spark: SparkSession, timeout: float = 30.0):
        self.spark, self.timeout = spark, timeout
        self._kept: list[DataFrame] = []

    def _rows(self, df: DataFrame) -> list[dict]:
        return [r.asDict(recursive=True) for r in df.collect()]

    def _file(self, path: str, language: str | None) -> tuple[DataFrame, str]:
        return read_file(self.spark, path, language), catalog.resolve(path, language).name

    def _folder(self, path: str, language: str | None, want: tuple[str, ...], kinds: tuple[str, ...] | None = None) -> tuple[DataFrame, DataFrame, dict[str, str]]:
        """(files, facts, errors): parsed once and kept for the operation's further jobs."""
        files = read_directory(self.spark, path, language)
        found = parse_facts(files, want, kinds).cache()
        self._kept.append(found)
        wrong = {r["path"]: r["message"] for r in symbols.errors(found).collect()}
        unread = {r["path"]: r["error"] for r in files.where("error is not null").select("path", "error").collect()}
        return files, found, wrong | unread

    @timed
    def list_languages(self) -> Result:
        return Result(self._rows(catalog.list_languages(self.spark)))

    @timed
    def parse_ast_file(self, path: str, language: str | None = None, max_depth: int = 0) -> Result:
        files, name = self._file(path, language)
        known = parse_facts(files, ()).select("has_error", "error").first()
        if known["error"] is not None:
            raise ValueError(f"parsing {path}: {known['error']}")
        return Result([{"path": path, "has_error": known["has_error"], "ast": tree.ast_json(files, max_depth)[path]}], name)

    @timed
    def query_ast_file(self, path: str, query: str, language: str | None = None, limit: int = 0, include_text: bool = False) -> Result:
        files, name = self._file(path, language)
        rows = self._rows(tree.query_ast(files, query, name, limit, include_text))
        for row in rows:
            if (error := row.pop("error")) is not None:
                raise ValueError(f"parsing {path}: {error}")
        return Result(rows, name)

    @timed
    def symbols_file(self, path: str, language: str | None = None, include_text: bool = False) -> Result:
        files, name = self._file(path, language)
        want = ("symbols", "full_text") if include_text else ("symbols",)
        return Result(self._rows(symbols.symbols(parse_facts(files, want), include_text)), name)

    @timed
    def scan_symbols_dir(self, path: str, language: str | None = None) -> Result:
        _, found, wrong = self._folder(path, language, ("symbols",))
        return Result(self._rows(symbols.scan_symbols(found)), language or "auto", wrong)

    @timed
    def scan_variables_dir(self, path: str, language: str | None = None) -> Result:
        _, found, wrong = self._folder(path, language, ("symbols",), ("variables",))
        return Result(self._rows(symbols.scan_variables(found)), language or "auto", wrong)

    @timed
    def analyze_file(self, path: str, language: str | None = None) -> Result:
        files, name = self._file(path, language)
        return Result(self._rows(metrics.analyze(parse_facts(files, ("symbols",)))), name)

    @timed
    def get_text_file(self, path: str, start_row: int, start_col: int, end_row: int, end_col: int, language: str | None = None) -> Result:
        files, name = self._file(path, language)
        (row,) = self._rows(text.get_text(files, start_row, start_col, end_row, end_col))
        if row["error"] is not None:
            raise ValueError(row["error"])
        return Result([{"path": row["path"], "text": row["text"]}], name)

    @timed
    def search_name_dir(self, name: str, path: str, language: str | None = None, limit: int = 0) -> Result:
        _, found, wrong = self._folder(path, language, ("symbols",))
        rows = self._rows(symbols.search_name(found, name, limit))
        return Result(rows, None, wrong, len(rows))

    @timed
    def complexity_file(self, path: str, language: str | None = None) -> Result:
        files, name = self._file(path, language)
        return Result(self._rows(metrics.complexity(parse_facts(files, ("symbols", "decisions")))), name)

    @timed
    def unused_symbols_dir(self, path: str, language: str | None = None, limit: int = 0) -> Result:
        files, found, wrong = self._folder(path, language, ("symbols",))
        return Result(self._rows(unused.unused_symbols(found, files, limit)), language or "auto", wrong)

    @timed
    def rename_preview_dir(self, name: str, path: str, language: str | None = None, limit: int = 0, per_file: bool = False) -> Result:
        _, found, wrong = self._folder(path, language, ("symbols", "identifiers"))
        return Result(self._rows(rename.rename_preview(found, name, limit, per_file)), language or "auto", wrong)

    @timed
    def call_graph_file(self, path: str, language: str | None = None) -> Result:
        files, name = self._file(path, language)
        if "calls" not in catalog.get(name).aux:
            raise calls.no_call_query(name)
        return Result(self._rows(calls.call_graph(parse_facts(files, ("symbols", "calls"))).drop("place")), name)

    @timed
    def callers_dir(self, name: str, path: str, language: str | None = None, limit: int = 0) -> Result:
        _, found, wrong = self._folder(path, language, ("symbols", "calls"))
        return Result(self._rows(calls.callers(found, name, limit)), language or "auto", wrong)
