"""Every operator as a query over the driver's tables, and SQL that gives the same rows.

The tables hold no source code: a corpus of Go files is made from them (sources.synthetic), of which
SQL can count what the operators should find. Text operators run over documents directly.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import catalog
from .functions.text import first_line_column, line_count, occurrences
from .operators import calls, metrics, rename, symbols, text, tree, unused
from .plans.facts import facts
from .plans.store import stored
from .sources.synthetic import CALL_QUANTITY, PARTS_A_FILE, go_corpus
from .sources.walk import from_table

#: The name that the search queries look for.
PART = 42
PART_NAME = f"part_{PART:09d}"


def _corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, f"files of {sf_dir}", lambda: go_corpus(spark, sf_dir))


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus's facts, parsed once an application."""
    return stored(spark, f"facts of {sf_dir}", lambda: facts(_corpus(spark, sf_dir)))


def parse_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the parsing pass finds in each file, parsed anew: numbers of its symbols, calls, identifiers and branches."""
    found = facts(_corpus(spark, sf_dir))
    return found.select("path", F.size("symbols").cast("long").alias("n_symbols"), F.size("calls").cast("long").alias("n_calls"), F.size("identifiers").cast("long").alias("n_identifiers"), F.size("decisions").cast("long").alias("n_decisions"))


def list_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.list_languages(spark)


def parse_ast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Named nodes by kind in all files."""
    found = tree.parse_ast(_corpus(spark, sf_dir), -1, ("kind", "named"))
    return found.where("named").groupBy("kind").agg(F.count("*").alias("n"))


def has_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.has_error(_facts(spark, sf_dir))


def query_ast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls of each file by an ad-hoc pattern."""
    found = tree.query_ast(_corpus(spark, sf_dir), '((call_expression function: (identifier) @f arguments: (argument_list)) @call (#match? @f "^part_"))', "go")
    return found.groupBy("path").agg(F.count("*").alias("n_calls"))


def symbols_(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = symbols.symbols(_facts(spark, sf_dir))
    return found.select("path", "kind", "name", "text", (F.col("end.row") - F.col("start.row") + 1).cast("long").alias("n_lines"))


def scan_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of symbols of each file."""
    found = symbols.scan_symbols(_facts(spark, sf_dir))
    size = lambda k: F.coalesce(F.size(F.col("kinds")[k]), F.lit(0)).cast("long")
    return found.select("path", F.when(F.map_contains_key("kinds", "functions"), size("functions")).otherwise(0).alias("n_functions"), F.when(F.map_contains_key("kinds", "variables"), size("variables")).otherwise(0).alias("n_variables"))


def scan_variables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return symbols.scan_variables(_facts(spark, sf_dir)).select("path", "name", "text")


def analyze(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = metrics.analyze(_facts(spark, sf_dir))
    f = F.col("kinds")["functions"]
    return found.select("path", F.col("lines").cast("long").alias("lines"), "bytes", f["count"].cast("long").alias("n_functions"), F.round(f["avg_lines"], 6).alias("avg_lines"), f["max_lines"].cast("long").alias("max_lines"), F.col("kinds")["variables"]["count"].cast("long").alias("n_variables"), F.col("kinds")["types"]["count"].cast("long").alias("n_types"))


def get_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first line of every document, its end included."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("path"), F.encode("text", "UTF-8").alias("content"))
    return text.get_text(docs, 0, 0, 1, 0).select(F.col("path").alias("doc_id"), "text")


def search_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return symbols.search_name(_facts(spark, sf_dir), PART_NAME).select("file", "kind", "name", "text", F.col("col").cast("long").alias("col"))


def complexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.complexity(_facts(spark, sf_dir)).select("path", "name", F.col("complexity").cast("long").alias("complexity"))


def unused_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unused.unused_symbols(_facts(spark, sf_dir), _corpus(spark, sf_dir)).select("file", "kind", "name")


def rename_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rename.rename_preview(_facts(spark, sf_dir), PART_NAME).select("file", "text", "definition")


def call_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each function and callee; functions without calls have a null callee."""
    found = calls.call_graph(_facts(spark, sf_dir))
    return found.select("path", "name", F.explode_outer("callees").alias("c")).select("path", "name", F.col("c.name").alias("callee"), F.col("c.count").cast("long").alias("n"))


def callers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calls.callers(_facts(spark, sf_dir), PART_NAME).select("file", "name", "kind", F.col("count").cast("long").alias("n"))


def text_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines, bytes and occurrences of a word in every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", line_count(F.col("text")).cast("long").alias("lines"), F.octet_length("text").cast("long").alias("bytes"), occurrences(F.col("text"), F.lit("the")).alias("n_the"))


def first_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summaries of every document: its first line, spaces collapsed, cut at 200 bytes."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", first_line_column(F.col("text")).alias("summary"))


def detect_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages by extension of file names made from the parts, unknown ones left out."""
    parts = spark.read.parquet(f"{sf_dir}/part.parquet")
    ending = F.element_at(F.array(*map(F.lit, [".go", ".py", ".tsx", ".txt", ".GO", ".yml", ""])), (F.col("p_partkey") % 7 + 1).cast("int"))
    table = parts.select(F.concat(F.lit("a.b/part_"), F.col("p_partkey").cast("string"), ending).alias("path"), F.lit("").alias("content"))
    return from_table(table).select("path", "language")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "list_languages": list_languages,
    "parse_facts": parse_facts,
    "parse_ast": parse_ast,
    "has_error": has_error,
    "query_ast": query_ast,
    "symbols": symbols_,
    "scan_symbols": scan_symbols,
    "scan_variables": scan_variables,
    "analyze": analyze,
    "get_text": get_text,
    "search_name": search_name,
    "complexity": complexity,
    "unused_symbols": unused_symbols,
    "rename_preview": rename_preview,
    "call_graph": call_graph,
    "callers": callers,
    "text_measures": text_measures,
    "first_lines": first_lines,
    "detect_language": detect_language,
}

_CUST = "'corpus/cust_' || format('{:09d}', o_custkey) || '.go'"
_PARTS = f"'corpus/parts_' || format('{{:06d}}', p_partkey // {PARTS_A_FILE}) || '.go'"
_ORDER = "'order_' || format('{:09d}', o_orderkey)"
#: Orders with the numbers of their line items, calls and branches; file, name.
_BASE = f"""
WITH l AS (SELECT l_orderkey, count(*) AS items, count(*) FILTER (WHERE l_quantity >= {CALL_QUANTITY}) AS calls, count(*) FILTER (WHERE l_returnflag = 'R') AS rs FROM lineitem GROUP BY 1),
o AS (SELECT {_CUST} AS path, {_ORDER} AS name, o_orderkey, coalesce(items, 0) AS items, coalesce(calls, 0) AS calls, coalesce(rs, 0) AS rs FROM orders LEFT JOIN l ON l_orderkey = o_orderkey),
p AS (SELECT {_PARTS} AS path, 'part_' || format('{{:09d}}', p_partkey) AS name, p_partkey FROM part),
v AS (SELECT path, 'qty_' || format('{{:09d}}', o_orderkey) || '_' || format('{{:04d}}', unnest(range(items))) AS name FROM o WHERE items > 0),
f AS (SELECT path, name, items + calls + 2 * rs + 2 AS n_lines, items, rs,
             length('func ' || name || '() {{' || chr(10) || '}}' || chr(10)) + items * length(chr(9) || 'qty_000000000_0000 := 1' || chr(10)) + calls * length(chr(9) || 'part_000000000()' || chr(10)) + rs * length(chr(9) || 'if ready && open {{' || chr(10) || chr(9) || '}}' || chr(10)) AS bytes FROM o
      UNION ALL SELECT path, name, 2, 0, 0, length('func ' || name || '() {{' || chr(10) || '}}' || chr(10)) FROM p)
"""
_CALLED = f"(SELECT {_CUST} AS path, {_ORDER} AS name, 'part_' || format('{{:09d}}', l_partkey) AS callee, count(*) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_quantity >= {CALL_QUANTITY} GROUP BY 1, 2, 3)"
_SUM = "cast(sum({}) AS BIGINT)"

ORACLES: dict[str, str] = {
    "list_languages": "SELECT unnest(['bash', 'csharp', 'go', 'java', 'javascript', 'python', 'rust', 'typescript', 'yaml']) AS language",
    "parse_ast": _BASE
    + """
, t AS (SELECT (SELECT count(*) FROM f) AS funcs, (SELECT count(DISTINCT path) FROM f) AS files, (SELECT sum(items) FROM o) AS items, (SELECT sum(calls) FROM o) AS calls, (SELECT sum(rs) FROM o) AS rs)
SELECT kind, cast(n AS BIGINT) AS n FROM (SELECT unnest([
  {'kind': 'source_file', 'n': files}, {'kind': 'package_clause', 'n': files}, {'kind': 'package_identifier', 'n': files},
  {'kind': 'function_declaration', 'n': funcs}, {'kind': 'parameter_list', 'n': funcs}, {'kind': 'block', 'n': funcs + rs},
  {'kind': 'identifier', 'n': funcs + items + calls + 2 * rs}, {'kind': 'short_var_declaration', 'n': items}, {'kind': 'expression_list', 'n': 2 * items},
  {'kind': 'int_literal', 'n': items}, {'kind': 'expression_statement', 'n': calls}, {'kind': 'call_expression', 'n': calls}, {'kind': 'argument_list', 'n': calls},
  {'kind': 'if_statement', 'n': rs}, {'kind': 'binary_expression', 'n': rs}], recursive := true) FROM t) WHERE n > 0""",
    "parse_facts": _BASE
    + f"""
, c AS (SELECT path, {_SUM.format('calls')} AS calls FROM o GROUP BY 1)
SELECT f.path, count(*) + {_SUM.format('items')} AS n_symbols, coalesce(any_value(calls), 0) AS n_calls, count(*) + {_SUM.format('items')} + coalesce(any_value(calls), 0) + 2 * {_SUM.format('rs')} AS n_identifiers, 2 * {_SUM.format('rs')} AS n_decisions
FROM f LEFT JOIN c ON c.path = f.path GROUP BY f.path""",
    "has_error": _BASE + "SELECT DISTINCT path, false AS has_error FROM f",
    "query_ast": f"SELECT path, {_SUM.format('n')} AS n_calls FROM {_CALLED} GROUP BY 1",
    "symbols": _BASE
    + """
SELECT path, 'functions' AS kind, name, 'func ' || name || '() {' AS text, cast(n_lines AS BIGINT) AS n_lines FROM f
UNION ALL SELECT path, 'variables', name, name || ' := 1', 1 FROM v""",
    "scan_symbols": _BASE + f"SELECT path, count(*) AS n_functions, {_SUM.format('items')} AS n_variables FROM f GROUP BY 1",
    "scan_variables": _BASE + "SELECT path, name, name || ' := 1' AS text FROM v",
    "analyze": _BASE
    + f"""
SELECT path, {_SUM.format('n_lines')} + 2 AS lines, {_SUM.format('bytes')} + 15 AS bytes, count(*) AS n_functions, round(cast(sum(n_lines) AS DOUBLE) / count(*), 6) AS avg_lines,
       cast(max(n_lines) AS BIGINT) AS max_lines, {_SUM.format('items')} AS n_variables, cast(0 AS BIGINT) AS n_types FROM f GROUP BY 1""",
    "get_text": "SELECT doc_id, CASE WHEN contains(text, chr(10)) THEN left(text, instr(text, chr(10))) ELSE text END AS text FROM documents",
    "search_name": _BASE + f"SELECT path AS file, 'functions' AS kind, name, 'func ' || name || '() {{' AS text, cast(0 AS BIGINT) AS col FROM p WHERE p_partkey = {PART}",
    "complexity": _BASE + "SELECT path, name, cast(1 + 2 * rs AS BIGINT) AS complexity FROM f",
    "unused_symbols": _BASE
    + f"""
SELECT path AS file, 'functions' AS kind, name FROM o
UNION ALL SELECT path, 'variables', name FROM v
UNION ALL SELECT path, 'functions', name FROM p WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_quantity >= {CALL_QUANTITY})""",
    "rename_preview": _BASE
    + f"""
SELECT path AS file, 'func {PART_NAME}() {{' AS text, true AS definition FROM p WHERE p_partkey = {PART}
UNION ALL SELECT {_CUST}, '{PART_NAME}()', false FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_quantity >= {CALL_QUANTITY} AND l_partkey = {PART}""",
    "call_graph": _BASE + f"SELECT f.path, f.name, c.callee, cast(c.n AS BIGINT) AS n FROM f LEFT JOIN {_CALLED} c ON c.path = f.path AND c.name = f.name",
    "callers": f"SELECT path AS file, name, 'functions' AS kind, cast(n AS BIGINT) AS n FROM {_CALLED} WHERE callee = '{PART_NAME}'",
    "text_measures": "SELECT doc_id, cast(length(text) - length(replace(text, chr(10), '')) + 1 AS BIGINT) AS lines, cast(strlen(text) AS BIGINT) AS bytes, cast((length(text) - length(replace(text, 'the', ''))) // 3 AS BIGINT) AS n_the FROM documents",
    "first_lines": """
SELECT doc_id, CASE WHEN strlen(l) > 200 THEN left(l, k) || CASE WHEN strlen(left(l, k)) < 197 THEN chr(65533) ELSE '' END || '...' ELSE l END AS summary
FROM (SELECT doc_id, l, list_max(list_filter(range(0, 198), lambda n: strlen(left(l, n)) <= 197)) AS k
      FROM (SELECT doc_id, trim(regexp_replace(split_part(text, chr(10), 1), '\\s+', ' ', 'g')) AS l FROM documents))""",
    "detect_language": "SELECT 'a.b/part_' || p_partkey || e AS path, CASE e WHEN '.go' THEN 'go' WHEN '.py' THEN 'python' WHEN '.tsx' THEN 'typescript' ELSE 'yaml' END AS language FROM (SELECT p_partkey, ['.go', '.py', '.tsx', '.txt', '.GO', '.yml', ''][p_partkey % 7 + 1] AS e FROM part) WHERE e IN ('.go', '.py', '.tsx', '.yml')",
}

from . import queries_languages as _languages  # noqa: E402

QUERIES |= _languages.QUERIES
ORACLES |= _languages.ORACLES
