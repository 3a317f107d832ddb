"""The operators over files of all nine languages, with lines and columns, and SQL that gives the same rows.

The files come from templates (sources.synthetic). What is in each is stated by hand below: its
symbols by their source text, from which SQL works out positions, its calls, and its complexities.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import catalog
from .operators import calls, metrics, rename, symbols, text, tree, unused
from .plans.facts import facts
from .plans.store import stored
from .sources.synthetic import BROKEN, TEMPLATES, mixed_corpus

#: The number in the names that are searched for.
ONE = "000000007"

#: language, kind, name, source text; a symbol without a name of its own is named by its text.
SYMBOLS = [
    ("bash", "variables", "total_{n}", "total_{n}=1"),
    ("bash", "functions", "help_{n}", 'help_{n}() {\n  if [ "$1" ]; then\n    echo_{n} "$1"\n  fi\n  grow_{n} one\n}'),
    ("bash", "functions", "grow_{n}", 'grow_{n}() {\n  for i in 1 2; do\n    help_{n} "$i" | sort_{n}\n  done\n}'),
    ("csharp", "imports", "using System;", "using System;"),
    ("csharp", "namespaces", "Space_{n}", TEMPLATES["csharp"][1][len("using System;\n\n") : -1]),
    ("csharp", "classes", "Box_{n}", TEMPLATES["csharp"][1][len("using System;\n\nnamespace Space_{n}\n{\n    ") : -len("\n}\n")]),
    ("csharp", "fields", "size_{n}", "int size_{n} = 4;"),
    ("csharp", "variables", "size_{n}", "int size_{n} = 4"),
    ("csharp", "properties", "Wide_{n}", "public int Wide_{n} { get; set; }"),
    ("csharp", "constructors", "Box_{n}", "public Box_{n}(int s)\n        {\n            size_{n} = help_{n}(s);\n        }"),
    ("csharp", "methods", "help_{n}", "int help_{n}(int k)\n        {\n            foreach (var i in new int[] { k })\n            {\n                if (i > 3 && k > 4)\n                {\n                    return help_{n}(i);\n                }\n            }\n            var total_{n} = k;\n            return total_{n};\n        }"),
    ("csharp", "variables", "total_{n}", "var total_{n} = k"),
    ("go", "imports", 'import "fmt"', 'import "fmt"'),
    ("go", "types", "Box_{n}", "Box_{n} struct {\n\tsize_{n} int\n}"),
    ("go", "variables", "size_{n}", "size_{n} int"),
    ("go", "methods", "grow_{n}", "func (b Box_{n}) grow_{n}(by int) int {\n\tif by > 0 && b.size_{n} < 9 {\n\t\treturn help_{n}(by)\n\t}\n\treturn help_{n}(1)\n}"),
    ("go", "functions", "help_{n}", "func help_{n}(k int) int {\n\ttotal_{n} := k\n\tfor j := 0; j < k; j++ {\n\t\tfmt.Println(total_{n})\n\t}\n\treturn total_{n}\n}"),
    ("go", "variables", "total_{n}", "total_{n} := k"),
    ("go", "variables", "j", "j := 0"),
    ("java", "imports", "import java.util.List;", "import java.util.List;"),
    ("java", "classes", "Box_{n}", TEMPLATES["java"][1][len("package p;\n\nimport java.util.List;\n\n") : -1]),
    ("java", "fields", "size_{n}", "private int size_{n};"),
    ("java", "constructors", "Box_{n}", "public Box_{n}(int s) {\n        size_{n} = help_{n}(s);\n    }"),
    ("java", "methods", "grow_{n}", "int grow_{n}(int by) {\n        int total_{n} = by > 0 || by < -9 ? help_{n}(by) : 0;\n        return total_{n};\n    }"),
    ("java", "variables", "total_{n}", "int total_{n} = by > 0 || by < -9 ? help_{n}(by) : 0;"),
    ("java", "methods", "help_{n}", "static int help_{n}(int k) {\n        while (k > 9) {\n            k--;\n        }\n        return k;\n    }"),
    ("javascript", "imports", 'import fs from "fs";', 'import fs from "fs";'),
    ("javascript", "imports", "fs", 'fs'),
    ("javascript", "classes", "Box_{n}", "class Box_{n} {\n  grow_{n}(by) {\n    return by > 0 ? help_{n}(by) : help_{n}(1);\n  }\n}"),
    ("javascript", "methods", "grow_{n}", "grow_{n}(by) {\n    return by > 0 ? help_{n}(by) : help_{n}(1);\n  }"),
    ("javascript", "functions", "help_{n}", "function help_{n}(k) {\n  const total_{n} = k;\n  function inner_{n}(z) {\n    if (z || k) {\n      fs.log_{n}(z);\n    }\n  }\n  inner_{n}(total_{n});\n  return total_{n};\n}"),
    ("javascript", "variables", "total_{n}", "const total_{n} = k;"),
    ("javascript", "functions", "inner_{n}", "function inner_{n}(z) {\n    if (z || k) {\n      fs.log_{n}(z);\n    }\n  }"),
    ("python", "imports", "import os", "import os"),
    ("python", "classes", "Box_{n}", "class Box_{n}:\n    def grow_{n}(self, by):\n        if by > 0 and self.size < 9:\n            return help_{n}(by)\n        return help_{n}(1)"),
    ("python", "functions", "grow_{n}", "def grow_{n}(self, by):\n        if by > 0 and self.size < 9:\n            return help_{n}(by)\n        return help_{n}(1)"),
    ("python", "functions", "help_{n}", "def help_{n}(k):\n    total_{n} = k\n\n    def inner_{n}(z):\n        return other_{n}(z) if z else help_{n}(0)\n\n    for i in range(k):\n        inner_{n}(i)\n    return total_{n}"),
    ("python", "variables", "total_{n}", "total_{n} = k"),
    ("python", "functions", "inner_{n}", "def inner_{n}(z):\n        return other_{n}(z) if z else help_{n}(0)"),
    ("rust", "imports", "use std::fmt;", "use std::fmt;"),
    ("rust", "structs", "Box_{n}", "struct Box_{n} {\n    size_{n}: i32,\n}"),
    ("rust", "traits", "Grow_{n}", "trait Grow_{n} {\n    fn grow_{n}(&self) -> i32;\n}"),
    ("rust", "impls", "Grow_{n}", "impl Grow_{n} for Box_{n} {\n    fn grow_{n}(&self) -> i32 {\n        help_{n}(self.size_{n}) + help_{n}(1)\n    }\n}"),
    ("rust", "functions", "grow_{n}", "fn grow_{n}(&self) -> i32 {\n        help_{n}(self.size_{n}) + help_{n}(1)\n    }"),
    ("rust", "functions", "help_{n}", "fn help_{n}(k: i32) -> i32 {\n    let total_{n} = k;\n    match total_{n} {\n        0 => 1,\n        _ => if k > 1 && k < 9 { help_{n}(0) } else { 2 },\n    }\n}"),
    ("rust", "variables", "total_{n}", "let total_{n} = k;"),
    ("typescript", "imports", 'import { a } from "a";', 'import { a } from "a";'),
    ("typescript", "imports", "{ a }", "{ a }"),
    ("typescript", "interfaces", "Shape_{n}", "interface Shape_{n} {\n  side: number;\n}"),
    ("typescript", "types", "Size_{n}", "type Size_{n} = number;"),
    ("typescript", "enums", "Hue_{n}", "enum Hue_{n} { Red, Blue }"),
    ("typescript", "classes", "Box_{n}", "class Box_{n} implements Shape_{n} {\n  side: number = 1;\n  grow_{n}(by: Size_{n}): number {\n    return help_{n}(by) + help_{n}(this.side);\n  }\n}"),
    ("typescript", "methods", "grow_{n}", "grow_{n}(by: Size_{n}): number {\n    return help_{n}(by) + help_{n}(this.side);\n  }"),
    ("typescript", "functions", "help_{n}", "function help_{n}(k: number): number {\n  let total_{n}: number = k;\n  for (const i of [1, 2]) {\n    total_{n} += i;\n  }\n  return total_{n};\n}"),
    ("typescript", "variables", "total_{n}", "let total_{n}: number = k;"),
    ("yaml", "mappings", "name_{n}", "name_{n}: box"),
    ("yaml", "mappings", "list_{n}", "list_{n}:\n  - one_{n}\n  - two_{n}"),
    ("yaml", "sequences", "- one_{n}", "- one_{n}"),
    ("yaml", "sequences", "- two_{n}", "- two_{n}"),
    ("yaml", "mappings", "nested_{n}", "nested_{n}:\n  inner_{n}: name_{n}"),
    ("yaml", "mappings", "inner_{n}", "inner_{n}: name_{n}"),
]
#: language, function, its kind, callee, number of calls; in order of the first call.
CALLS = [
    ("bash", "help_{n}", "functions", "echo_{n}", 1),
    ("bash", "help_{n}", "functions", "grow_{n}", 1),
    ("bash", "grow_{n}", "functions", "help_{n}", 1),
    ("bash", "grow_{n}", "functions", "sort_{n}", 1),
    ("csharp", "Box_{n}", "constructors", "help_{n}", 1),
    ("csharp", "help_{n}", "methods", "help_{n}", 1),
    ("go", "grow_{n}", "methods", "help_{n}", 2),
    ("java", "Box_{n}", "constructors", "help_{n}", 1),
    ("java", "grow_{n}", "methods", "help_{n}", 1),
    ("javascript", "grow_{n}", "methods", "help_{n}", 2),
    ("javascript", "help_{n}", "functions", "inner_{n}", 1),
    ("javascript", "inner_{n}", "functions", "fs.log_{n}", 1),
    ("python", "grow_{n}", "functions", "help_{n}", 2),
    ("python", "help_{n}", "functions", "range", 1),
    ("python", "help_{n}", "functions", "inner_{n}", 1),
    ("python", "inner_{n}", "functions", "other_{n}", 1),
    ("python", "inner_{n}", "functions", "help_{n}", 1),
    ("rust", "grow_{n}", "functions", "help_{n}", 2),
    ("rust", "help_{n}", "functions", "help_{n}", 1),
    ("typescript", "grow_{n}", "methods", "help_{n}", 2),
]
#: language, function, its kind, complexity: one, and the branches and && and || within.
COMPLEXITY = [
    ("bash", "help_{n}", "functions", 3),
    ("bash", "grow_{n}", "functions", 3),
    ("csharp", "help_{n}", "methods", 4),
    ("csharp", "Box_{n}", "constructors", 1),
    ("go", "help_{n}", "functions", 2),
    ("go", "grow_{n}", "methods", 3),
    ("java", "grow_{n}", "methods", 3),
    ("java", "help_{n}", "methods", 2),
    ("java", "Box_{n}", "constructors", 1),
    ("javascript", "help_{n}", "functions", 3),
    ("javascript", "inner_{n}", "functions", 3),
    ("javascript", "grow_{n}", "methods", 2),
    ("python", "grow_{n}", "functions", 3),
    ("python", "help_{n}", "functions", 3),
    ("python", "inner_{n}", "functions", 2),
    ("rust", "grow_{n}", "functions", 1),
    ("rust", "help_{n}", "functions", 6),
    ("typescript", "help_{n}", "functions", 2),
    ("typescript", "grow_{n}", "methods", 1),
]
#: language, source text of its if statements.
IFS = [
    ("bash", 'if [ "$1" ]; then\n    echo_{n} "$1"\n  fi'),
    ("csharp", "if (i > 3 && k > 4)\n                {\n                    return help_{n}(i);\n                }"),
    ("go", "if by > 0 && b.size_{n} < 9 {\n\t\treturn help_{n}(by)\n\t}"),
    ("javascript", "if (z || k) {\n      fs.log_{n}(z);\n    }"),
    ("python", "if by > 0 and self.size < 9:\n            return help_{n}(by)"),
]
#: Ranges that are cut out: start row and column, end row and column; the third has a column that runs on, in some files past its end, the last lies past all lines.
RANGES = [(0, 0, 1, 0), (3, 2, 5, 1), (1, 30, 4, 3), (40, 0, 50, 0)]


def _corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, f"mixed files of {sf_dir}", lambda: mixed_corpus(spark, sf_dir))


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, f"mixed facts of {sf_dir}", lambda: facts(_corpus(spark, sf_dir)))


def _point(column: str) -> list:
    return [F.col(f"{column}.row").cast("long").alias(f"{column}_row"), F.col(f"{column}.col").cast("long").alias(f"{column}_col")]


def symbols_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every symbol with its extent."""
    found = symbols.symbols(_facts(spark, sf_dir))
    return found.select("path", "language", "kind", "name", *_point("start"), *_point("end"))


def call_graph_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every function, where it begins, and its callees in order."""
    found = calls.call_graph(_facts(spark, sf_dir))
    callees = F.array_join(F.transform("callees", lambda c: F.concat(c["name"], F.lit(":"), c["count"].cast("string"))), ",")
    return found.select("path", "name", "kind", callees.alias("callees"), *_point("start"))


def complexity_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.complexity(_facts(spark, sf_dir)).select("path", "name", "kind", F.col("complexity").cast("long").alias("complexity"), *_point("start"))


def callers_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who calls one function."""
    found = calls.callers(_facts(spark, sf_dir), f"help_{ONE}")
    return found.select("file", "name", "kind", F.col("line").cast("long").alias("line"), F.col("col").cast("long").alias("col"), F.col("count").cast("long").alias("n"))


def search_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where one name is declared."""
    found = symbols.search_name(_facts(spark, sf_dir), f"Box_{ONE}")
    return found.select("file", "kind", "name", F.col("line").cast("long").alias("line"), F.col("col").cast("long").alias("col"), "text")


def rename_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every place of one name."""
    found = rename.rename_preview(_facts(spark, sf_dir), f"help_{ONE}")
    return found.select("file", F.col("line").cast("long").alias("line"), F.col("col").cast("long").alias("col"), "definition")


def unused_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that occur once in all files, with places; names of several words too."""
    found = unused.unused_symbols(_facts(spark, sf_dir), _corpus(spark, sf_dir))
    return found.select("file", "kind", "name", F.col("line").cast("long").alias("line"), F.col("col").cast("long").alias("col"))


def analyze_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines, bytes and each kind's numbers, kinds without symbols included."""
    found = metrics.analyze(_facts(spark, sf_dir))
    return found.select("path", F.col("lines").cast("long").alias("lines"), "bytes", F.explode("kinds").alias("kind", "k")).select("path", "lines", "bytes", "kind", F.col("k.count").cast("long").alias("n"), F.round("k.avg_lines", 6).alias("avg_lines"), F.col("k.max_lines").cast("long").alias("max_lines"))


def query_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """If statements by a tree pattern; languages without such a node have none."""
    found = tree.query_ast(_corpus(spark, sf_dir), "(if_statement) @s")
    return found.where("error is null").select("path", F.col("match_id").cast("long").alias("match_id"), F.col("captures")[0].alias("c")).select("path", "match_id", *[F.col(f"c.{k}.{x}").cast("long").alias(f"{k}_{x}") for k in ("start", "end") for x in ("row", "col")])


def has_error_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole files and broken ones."""
    return tree.has_error(facts(mixed_corpus(spark, sf_dir, broken=True), ()))


def get_text_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several ranges of every file."""
    corpus = _corpus(spark, sf_dir)
    parts = [text.get_text(corpus, *r).select("path", F.lit(k).cast("long").alias("k"), "text") for k, r in enumerate(RANGES)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (symbols_languages, call_graph_languages, complexity_languages, callers_languages, search_languages, rename_languages, unused_languages, analyze_languages, query_languages, has_error_languages, get_text_languages)
}


def _values(rows: list[tuple]) -> str:
    shown = lambda v: str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return "(VALUES " + ", ".join("(" + ", ".join(map(shown, r)) + ")" for r in rows) + ")"


_ROW = "cast(length(left(content, {0})) - length(replace(left(content, {0}), chr(10), '')) AS BIGINT)"
_COL = "cast(length(regexp_extract(left(content, {0}), '[^\\n]*$')) AS BIGINT)"
#: f: files; s: their symbols, from a to b; the name's place is name_at.
_BASE = f"""
WITH t(language, ext, body) AS {_values([(language, ext, body) for language, (ext, body) in TEMPLATES.items()])},
f AS (SELECT 'mixed/' || language || '/f' || format('{{:09d}}', s_suppkey) || ext AS path, language, format('{{:09d}}', s_suppkey) AS num, replace(body, '{{n}}', format('{{:09d}}', s_suppkey)) AS content FROM supplier, t),
d(language, kind, label, decl) AS {_values(SYMBOLS)},
x AS (SELECT path, f.language, num, kind, content, replace(label, '{{n}}', num) AS name, replace(decl, '{{n}}', num) AS own FROM f JOIN d ON d.language = f.language),
s AS (SELECT *, instr(content, own) - 1 AS a, instr(content, own) - 1 + length(own) AS b, instr(content, own) - 2 + instr(own, name) AS name_at FROM x)
"""
_FUNCTIONS = "kind IN ('functions', 'methods', 'constructors')"
_KINDS = [(n, k) for n in TEMPLATES for k in catalog.get(n).symbols]
_OFFSET = "least(length(content), coalesce(list_sum(list_transform(string_split(content, chr(10))[1:{0}], lambda l: length(l) + 1)), 0) + CASE WHEN {0} >= len(string_split(content, chr(10))) THEN length(content) ELSE {1} END)"

ORACLES: dict[str, str] = {
    "symbols_languages": _BASE + f"SELECT path, language, kind, name, {_ROW.format('a')} AS start_row, {_COL.format('a')} AS start_col, {_ROW.format('b')} AS end_row, {_COL.format('b')} AS end_col FROM s",
    "call_graph_languages": _BASE
    + f""", c(language, fn, kind, callee, n, nth) AS {_values([(*c, i) for i, c in enumerate(CALLS)])},
g AS (SELECT language, fn, kind, string_agg(callee || ':' || n, ',' ORDER BY nth) AS callees FROM c GROUP BY 1, 2, 3)
SELECT path, name, s.kind, coalesce(replace(callees, '{{n}}', num), '') AS callees, {_ROW.format('a')} AS start_row, {_COL.format('a')} AS start_col
FROM s LEFT JOIN g ON g.language = s.language AND replace(fn, '{{n}}', num) = name AND g.kind = s.kind WHERE s.{_FUNCTIONS}""",
    "complexity_languages": _BASE
    + f""", c(language, fn, kind, complexity) AS {_values(COMPLEXITY)}
SELECT path, name, s.kind, cast(complexity AS BIGINT) AS complexity, {_ROW.format('a')} AS start_row, {_COL.format('a')} AS start_col FROM s JOIN c ON c.language = s.language AND replace(fn, '{{n}}', num) = name AND c.kind = s.kind""",
    "callers_languages": _BASE
    + f""", c(language, fn, kind, callee, n) AS {_values(CALLS)}
SELECT path AS file, name, s.kind, {_ROW.format('a')} + 1 AS line, {_COL.format('a')} AS col, cast(n AS BIGINT) AS n
FROM s JOIN c ON c.language = s.language AND replace(fn, '{{n}}', num) = name AND c.kind = s.kind AND callee = 'help_{{n}}' WHERE num = '{ONE}'""",
    "search_languages": _BASE + f"SELECT path AS file, kind, name, {_ROW.format('a')} + 1 AS line, {_COL.format('a')} AS col, split_part(own, chr(10), 1) AS text FROM s WHERE name = 'Box_{ONE}'",
    "rename_languages": _BASE
    + f""", o AS (SELECT path, content, unnest(string_split(content, 'help_{ONE}')) AS part, generate_subscripts(string_split(content, 'help_{ONE}'), 1) AS k FROM f WHERE num = '{ONE}'),
p AS (SELECT path, content, k, sum(length(part)) OVER (PARTITION BY path ORDER BY k) + (k - 1) * length('help_{ONE}') AS place, max(k) OVER (PARTITION BY path) AS n FROM o)
SELECT path AS file, {_ROW.format('cast(place AS BIGINT)')} + 1 AS line, {_COL.format('cast(place AS BIGINT)')} AS col, EXISTS (SELECT 1 FROM s WHERE s.path = p.path AND s.name = 'help_{ONE}' AND s.name_at = p.place) AS definition FROM p WHERE k < n""",
    "unused_languages": _BASE
    + f""", w AS (SELECT num, string_agg(content, chr(10)) AS every FROM f GROUP BY 1)
SELECT path AS file, kind, name, {_ROW.format('a')} + 1 AS line, {_COL.format('a')} AS col FROM s JOIN w USING (num)
WHERE kind <> 'imports' AND contains(name, num) AND (length(every) - length(replace(every, name, ''))) // length(name) = 1""",
    "analyze_languages": _BASE
    + f""", k(language, kind) AS {_values(_KINDS)},
q AS (SELECT path, kind, length(own) - length(replace(own, chr(10), '')) + 1 AS size FROM s)
SELECT f.path, cast(length(content) - length(replace(content, chr(10), '')) + 1 AS BIGINT) AS lines, cast(length(content) AS BIGINT) AS bytes, k.kind, count(size) AS n, round(coalesce(avg(size), 0), 6) AS avg_lines, cast(coalesce(max(size), 0) AS BIGINT) AS max_lines
FROM f JOIN k ON k.language = f.language LEFT JOIN q ON q.path = f.path AND q.kind = k.kind GROUP BY f.path, content, k.kind""",
    "query_languages": _BASE
    + f""", i(language, source) AS {_values(IFS)},
m AS (SELECT path, content, instr(content, replace(source, '{{n}}', num)) - 1 AS a, instr(content, replace(source, '{{n}}', num)) - 1 + length(replace(source, '{{n}}', num)) AS b FROM f JOIN i ON i.language = f.language)
SELECT path, cast(0 AS BIGINT) AS match_id, {_ROW.format('a')} AS start_row, {_COL.format('a')} AS start_col, {_ROW.format('b')} AS end_row, {_COL.format('b')} AS end_col FROM m""",
    "has_error_languages": _BASE
    + f""", e(language, tail) AS {_values(list(BROKEN.items()))}
SELECT path, false AS has_error FROM f UNION ALL SELECT replace(path, '.', '_broken.'), true FROM f JOIN e ON e.language = f.language""",
    "get_text_languages": _BASE
    + f""", r(k, sr, sc, er, ec) AS {_values([(k, *r) for k, r in enumerate(RANGES)])},
z AS (SELECT path, content, k, {_OFFSET.format('sr', 'sc')} AS a, {_OFFSET.format('er', 'ec')} AS b FROM f, r)
SELECT path, cast(k AS BIGINT) AS k, CASE WHEN b >= a THEN content[cast(a AS BIGINT) + 1:cast(b AS BIGINT)] END AS text FROM z""",
}
