"""python -m srcgraph OPERATION [ARGUMENT ...] [--option value ...]: one operation, its result as one JSON line.

Options of the operation are those of the Engine's method, with dashes. Besides: --tool-timeout
SECONDS (30; 0 for none), --verbose, --log FILE, --master, --version.
"""

from __future__ import annotations

import dataclasses
import inspect
import json
import logging
import sys

VERSION = "0.1.0"


def operations() -> dict[str, inspect.Signature]:
    from .api import Engine

    return {n: inspect.signature(f) for n, f in vars(Engine).items() if not n.startswith("_")}


def arguments(signature: inspect.Signature, words: list[str]) -> dict:
    """Keyword arguments from positional words and --options, converted to the parameters' kinds."""
    names = [n for n in signature.parameters if n != "self"]
    out: dict[str, object] = {}
    place, i = 0, 0
    while i < len(words):
        if words[i].startswith("--"):
            name, value, i = words[i][2:].replace("-", "_"), words[i + 1] if i + 1 < len(words) else "true", i + 2
        else:
            if place >= len(names):
                raise SystemExit(f"too many arguments: {words[i]}")
            name, value, i, place = names[place], words[i], i + 1, place + 1
        if name not in names:
            raise SystemExit(f"unknown option --{name.replace('_', '-')}")
        kind = str(signature.parameters[name].annotation)
        out[name] = int(value) if kind.startswith("int") else value.lower() in ("true", "1", "yes") if kind == "bool" else value
    missing = [n for n in names if n not in out and signature.parameters[n].default is inspect.Parameter.empty]
    if missing:
        raise SystemExit(f"missing: {', '.join(missing)}")
    return out


def main(words: list[str]) -> int:
    own = {"tool-timeout": "30", "log": "", "master": "local[*]"}
    flags = {"verbose", "version"}
    rest, given = [], set()
    i = 0
    while i < len(words):
        name = words[i].lstrip("-") if words[i].startswith("-") else ""
        if name in flags:
            given.add(name)
            i += 1
        elif name in own and i + 1 < len(words):
            own[name] = words[i + 1]
            i += 2
        else:
            rest.append(words[i])
            i += 1
    if "version" in given:
        print(VERSION)
        return 0
    known = operations()
    if not rest or rest[0] not in known:
        print(__doc__, "Operations: " + ", ".join(sorted(known)), sep="\n", file=sys.stderr)
        return 2
    handlers: list[logging.Handler] = ([logging.StreamHandler(sys.stderr)] if "verbose" in given else []) + ([logging.FileHandler(own["log"])] if own["log"] else [])
    logging.basicConfig(level=logging.INFO if handlers else logging.WARNING, handlers=handlers or None, format="%(asctime)s %(levelname)s %(message)s")
    keywords = arguments(known[rest[0]], rest[1:])

    from pyspark.sql import SparkSession

    from .api import Engine
    from .deploy import ship

    spark = SparkSession.builder.master(own["master"]).appName("srcgraph").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.shuffle.partitions", "8").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)
    try:
        result = getattr(Engine(spark, float(own["tool-timeout"])), rest[0])(**keywords)
        print(json.dumps(dataclasses.asdict(result), default=str))
        return 0
    except (ValueError, OSError, RuntimeError) as e:
        print(json.dumps({"error": str(e)}))
        return 1
    finally:
        spark.stop()


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
