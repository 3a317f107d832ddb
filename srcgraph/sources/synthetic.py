"""A corpus of Go files made from order tables, for tests and measurements.

One file a customer holds a function per order; the order's line items become variables, calls of
part functions and branches. One more file per thousand parts declares the parts' functions. Names
have fixed widths, so none is within another, and all counts follow from the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Line items of at least this quantity call their part.
CALL_QUANTITY = 48
PARTS_A_FILE = 1000

#: One file of each language: extension and source; {n} stands for a number of nine digits.
TEMPLATES = {
    "bash": (
        ".sh",
        """#!/bin/bash
total_{n}=1
help_{n}() {
  if [ "$1" ]; then
    echo_{n} "$1"
  fi
  grow_{n} one
}
grow_{n}() {
  for i in 1 2; do
    help_{n} "$i" | sort_{n}
  done
}
""",
    ),
    "csharp": (
        ".cs",
        """using System;

namespace Space_{n}
{
    class Box_{n}
    {
        int size_{n} = 4;

        public int Wide_{n} { get; set; }

        public Box_{n}(int s)
        {
            size_{n} = help_{n}(s);
        }

        int help_{n}(int k)
        {
            foreach (var i in new int[] { k })
            {
                if (i > 3 && k > 4)
                {
                    return help_{n}(i);
                }
            }
            var total_{n} = k;
            return total_{n};
        }
    }
}
""",
    ),
    "go": (
        ".go",
        """package p

import "fmt"

type Box_{n} struct {
	size_{n} int
}

func (b Box_{n}) grow_{n}(by int) int {
	if by > 0 && b.size_{n} < 9 {
		return help_{n}(by)
	}
	return help_{n}(1)
}

func help_{n}(k int) int {
	total_{n} := k
	for j := 0; j < k; j++ {
		fmt.Println(total_{n})
	}
	return total_{n}
}
""",
    ),
    "java": (
        ".java",
        """package p;

import java.util.List;

public class Box_{n} {
    private int size_{n};

    public Box_{n}(int s) {
        size_{n} = help_{n}(s);
    }

    int grow_{n}(int by) {
        int total_{n} = by > 0 || by < -9 ? help_{n}(by) : 0;
        return total_{n};
    }

    static int help_{n}(int k) {
        while (k > 9) {
            k--;
        }
        return k;
    }
}
""",
    ),
    "javascript": (
        ".js",
        """import fs from "fs";

class Box_{n} {
  grow_{n}(by) {
    return by > 0 ? help_{n}(by) : help_{n}(1);
  }
}

function help_{n}(k) {
  const total_{n} = k;
  function inner_{n}(z) {
    if (z || k) {
      fs.log_{n}(z);
    }
  }
  inner_{n}(total_{n});
  return total_{n};
}
""",
    ),
    "python": (
        ".py",
        """import os


class Box_{n}:
    def grow_{n}(self, by):
        if by > 0 and self.size < 9:
            return help_{n}(by)
        return help_{n}(1)


def help_{n}(k):
    total_{n} = k

    def inner_{n}(z):
        return other_{n}(z) if z else help_{n}(0)

    for i in range(k):
        inner_{n}(i)
    return total_{n}
""",
    ),
    "rust": (
        ".rs",
        """use std::fmt;

struct Box_{n} {
    size_{n}: i32,
}

trait Grow_{n} {
    fn grow_{n}(&self) -> i32;
}

impl Grow_{n} for Box_{n} {
    fn grow_{n}(&self) -> i32 {
        help_{n}(self.size_{n}) + help_{n}(1)
    }
}

fn help_{n}(k: i32) -> i32 {
    let total_{n} = k;
    match total_{n} {
        0 => 1,
        _ => if k > 1 && k < 9 { help_{n}(0) } else { 2 },
    }
}
""",
    ),
    "typescript": (
        ".ts",
        """import { a } from "a";

interface Shape_{n} {
  side: number;
}

type Size_{n} = number;

enum Hue_{n} { Red, Blue }

class Box_{n} implements Shape_{n} {
  side: number = 1;
  grow_{n}(by: Size_{n}): number {
    return help_{n}(by) + help_{n}(this.side);
  }
}

function help_{n}(k: number): number {
  let total_{n}: number = k;
  for (const i of [1, 2]) {
    total_{n} += i;
  }
  return total_{n};
}
""",
    ),
    "yaml": (
        ".yaml",
        """name_{n}: box
list_{n}:
  - one_{n}
  - two_{n}
nested_{n}:
  inner_{n}: name_{n}
""",
    ),
}
#: Ends that make a file of these languages wrong.
BROKEN = {"go": "func (", "java": "class {", "python": "def (:", "rust": "fn {", "javascript": "function ("}


def go_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, language, content, error."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    lines = read("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_returnflag")
    part = F.format_string("part_%09d", F.col("l_partkey"))
    # statements of a line item; its number among the order's sorted items names its variable
    item = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_returnflag", part.alias("part"))
    items = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(item)).alias("items"))
    orders = read("orders").select("o_orderkey", "o_custkey").join(items, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    order = F.format_string("%09d", F.col("o_orderkey"))
    body = F.array_join(
        F.transform(
            "items",
            lambda i, n: F.concat(
                F.format_string("\tqty_%s_%04d := 1\n", order, n),
                F.when(i["l_quantity"] >= CALL_QUANTITY, F.concat(F.lit("\t"), i["part"], F.lit("()\n"))).otherwise(""),
                F.when(i["l_returnflag"] == "R", F.lit("\tif ready && open {\n\t}\n")).otherwise(""),
            ),
        ),
        "",
    )
    function = F.concat(F.lit("func order_"), order, F.lit("() {\n"), F.coalesce(body, F.lit("")), F.lit("}\n"))
    # parsing is far dearer than its bytes, so the partitions must not be merged by size
    dealt = orders.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "o_custkey")
    files = dealt.select("o_custkey", "o_orderkey", function.alias("text")).groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "text"))).alias("f"))
    customers = files.select(F.format_string("corpus/cust_%09d.go", F.col("o_custkey")).alias("path"), F.concat(F.lit("package corpus\n"), F.array_join(F.col("f.text"), "")).alias("text"))
    numbered = read("part").select("p_partkey", F.floor(F.col("p_partkey") / PARTS_A_FILE).cast("long").alias("n"))
    parts = numbered.groupBy("n").agg(F.array_sort(F.collect_list("p_partkey")).alias("keys")).select(F.format_string("corpus/parts_%06d.go", F.col("n")).alias("path"), F.concat(F.lit("package corpus\n"), F.array_join(F.transform("keys", lambda k: F.format_string("func part_%09d() {\n}\n", k)), "")).alias("text"))
    both = customers.unionByName(parts)
    return both.select("path", F.lit("go").alias("language"), F.encode("text", "UTF-8").alias("content"), F.lit(None).cast("string").alias("error"))


def mixed_corpus(spark: SparkSession, sf_dir: str, broken: bool = False) -> DataFrame:
    """path, language, content, error: a file of every language for each supplier. broken: some with an end that makes them wrong too."""
    rows = [(language, ext, body, "") for language, (ext, body) in TEMPLATES.items()]
    if broken:
        rows += [(language, "_broken" + TEMPLATES[language][0], TEMPLATES[language][1], end) for language, end in BROKEN.items()]
    templates = F.broadcast(spark.createDataFrame(rows, "language string, ext string, body string, tail string"))  # a closed list
    number = F.format_string("%09d", F.col("s_suppkey"))
    # few bytes, much work: the partitions must not be merged by size
    suppliers = spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "s_suppkey")
    text = F.concat(F.replace("body", F.lit("{n}"), number), "tail")
    return suppliers.crossJoin(templates).select(F.concat(F.lit("mixed/"), "language", F.lit("/f"), number, "ext").alias("path"), "language", F.encode(text, "UTF-8").alias("content"), F.lit(None).cast("string").alias("error"))
