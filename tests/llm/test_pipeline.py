"""The pipeline's stages, against the operators and plain recounts."""

from __future__ import annotations

import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from srcgraph.llm import bpe


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("sf"))
    draw = random.Random(21)
    words = ["".join(draw.choices("abcdefghijkl", k=draw.randint(2, 8))) for _ in range(2000)]
    texts = [" ".join(draw.choices(words, k=draw.randint(80, 160))) for _ in range(60)]
    texts[10] = texts[4]
    texts[11] = texts[4] + " tail"
    texts[12] = "short"
    texts[13] = "the same line again and again\n" * 40
    texts[14] += " reach me at kim@mail.example.com or kim at mail dot com"
    rows = [(i, t, "en", f"src{i % 3}", len(t)) for i, t in enumerate(texts)] + [(70, None, None, None, None), (71, "", "en", "src0", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(30)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


def test_stages_take_effect(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    seen = {}
    for name, stage in pipeline.STAGES[:-1]:
        docs = pipeline.settled(stage(spark, docs, tables), name)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        seen[name] = {r["doc_id"]: r for r in docs.collect()}
    assert set(range(60)) - set(seen["quality_rules"]) == {12, 13}
    assert set(seen["quality_rules"]) - set(seen["near_duplicates"]) == {10, 11}
    assert seen["personal_data"][14]["text"].endswith(" reach me at <EMAIL> or <EMAIL>")
    assert seen["personal_data"][14]["n_chars"] == len(seen["personal_data"][14]["text"])
    words = lambda rows: sum(len(r["text"].split()) for r in rows)
    assert words(docs.collect()) == pytest.approx(1.5 * words(seen["personal_data"].values()), rel=0.1)
    enc = bpe.encoding(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    out = pipeline.run(spark, tables).collect()
    assert len(out) == docs.count()
    for r in out:
        assert enc.decode(r["ids"]) == seen["personal_data"][r["doc_id"]]["text"]


def test_extra_columns_with_our_names(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet").withColumns({c: F.lit("mine") for c in ("kept", "n_words", "_text", "_id", "size", "taken", "copies", "component_id", "n_tokens", "_copy2")})
    for _, stage in pipeline.STAGES[:-1]:
        docs = pipeline.settled(stage(spark, docs, tables), "odd")
        assert docs.columns[-10:] == ["kept", "n_words", "_text", "_id", "size", "taken", "copies", "component_id", "n_tokens", "_copy2"]
        assert docs.where("kept <> 'mine' or taken <> 'mine'").count() == 0
    assert pipeline.STAGES[-1][1](spark, docs, tables).count() > 0


def test_empty_tables(spark, tables, tmp_path):
    folder = str(tmp_path / "none")
    for t in ("documents", "labels"):
        spark.read.parquet(f"{tables}/{t}.parquet").limit(0).write.parquet(f"{folder}/{t}.parquet")
    assert pipeline.run(spark, folder).count() == 0


def test_near_duplicates_with_repeated_and_missing_ids(spark, tables):
    draw = random.Random(2)
    one, two, three = (" ".join("".join(draw.choices("abcdef", k=6)) for _ in range(90)) for _ in range(3))
    rows = [(1, one), (1, one), (2, one + " tail"), (None, one), (None, one), (3, two), (3, three), (4, three), (None, None), (None, None), (5, ""), (6, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = pipeline.near_duplicates(spark, docs, tables).collect()
    # one row of each text's component, by least id; of equal rows one; texts without words are their own
    assert sorted((str(r["doc_id"]), r["text"]) for r in out if r["text"]) == sorted([("1", one), ("3", two), ("3", three)])
    assert sorted(str(r["doc_id"]) for r in out if not r["text"]) == ["5", "6", "None"]


def test_copies_of_rows_without_ids_are_mixed_by_their_texts(spark, tables):
    rows = [(None, "a b c", "s"), (None, "d e f g", "s"), (None, None, "s"), (1, "h i", "s"), (1, "j k l m n", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = pipeline.mix_copies(docs)
    assert out.columns == docs.columns
    assert {r["text"] for r in out.collect()} == {"a b c", "d e f g", "h i", "j k l m n"}
