"""The registered queries over the driver's smallest tables."""

from __future__ import annotations

import hashlib
import os
import re
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as driver
from srcgraph.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "pages", "labels"):
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.fixture(scope="module")
def documents(duck):
    return dict(duck.execute("select doc_id, coalesce(text, '') from documents").fetchall())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_agrees_with_sql(spark, duck, name):
    got = driver.queries()[name](spark, SF)
    columns = sorted(got.columns)
    result = duck.execute(ORACLES[name])
    at = [d[0] for d in result.description]
    assert sorted(at) == columns
    shown = lambda v: f"{v:.6f}" if isinstance(v, float) else str(v)
    want = Counter(tuple(shown(r[at.index(c)]) for c in columns) for r in result.fetchall())
    assert Counter(tuple(shown(r[c]) for c in columns) for r in got.collect()) == want


def test_ten_operators_and_the_pipeline_are_registered():
    assert {int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES} == set(range(1, 11))
    assert "pipeline" in driver.queries()


@pytest.mark.parametrize(("name", "kinds"), [("op1_secrets", ("assign", "access", "hex")), ("op3_pii", ("email", "ip", "card", "phone"))])
def test_digests_of_finds(spark, documents, name, kinds):
    from tests.llm.test_text_operators import plain_pii, plain_secrets

    rows = driver.queries()[name](spark, SF).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(documents)
    for r in rows:
        text = documents[r["doc_id"]]
        if name == "op1_secrets":
            base = sorted(((s, kinds.index(k), e) for s, e, k in plain_secrets(text)))
            shown = [f"{kinds[k]}:{s}:{e}" for s, k, e in base]
        else:
            shown = [f"{kinds[k]}:{s}:{e}" for k, s, e in sorted(plain_pii(text))]
        assert r["base_sha256"] == hashlib.sha256(",".join(shown).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in kinds] == [sum(x.startswith(k + ":") for x in shown) for k in kinds]
        assert set(shown) <= set(r["spans"].split(",")) | {""}


def test_every_repeated_passage_is_found(spark, documents):
    found = {r["doc_id"] for r in driver.queries()["op2_passages"](spark, SF).collect()}
    seen: dict[tuple, set] = {}
    for i, text in documents.items():
        w = text.encode().lower().split()
        for k in range(len(w) - 50):
            seen.setdefault(tuple(w[k : k + 51]), set()).add(i)
    exact = set().union(*(ids for ids in seen.values() if len(ids) > 1))
    assert exact <= found
    # the others share a near copy of a passage: few
    assert len(found - exact) <= 0.1 * len(documents)
