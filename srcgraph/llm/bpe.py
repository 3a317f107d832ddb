"""Byte-level BPE encoding and decoding with a local rank file.

`encode` pre-splits a long text at safe boundaries, hands the pieces to tiktoken and joins the ids.
A boundary is safe at the first white-space character of a run: every alternative of the pattern
that holds a non-space character stops there, and no look-ahead crosses it from the left, so the
pattern matches the two sides just as it matches the whole. A run of white space longer than a
regex engine's stack allows is split by the pattern's own rule: all but its last character form one
match when more text follows, the whole run does at the end of the text.

Defined results: null and empty texts have no ids; ids of special tokens are never made; repeated
documents give repeated rows.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import per_text, text_batches

#: Texts above so many characters are split; white-space runs above RUN get a match of their own.
LONG, RUN = 1 << 16, 1 << 12
#: What the pattern's \s matches (Unicode White_Space), fixed values.
WHITE = "\t\n\x0b\x0c\r \x85\xa0                　"
_RUNS = re.compile(f"[{re.escape(WHITE)}]+")


@functools.lru_cache(maxsize=4)
def encoding(path: str, pattern: str):
    """The tiktoken encoding of a rank file: a token in base 64, then its rank, on each line."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def chunks(text: str, long: int = LONG, run: int = RUN) -> list[tuple[str, bool]]:
    """(part, whether it is one match) of a text, cut at safe boundaries only."""
    if len(text) <= min(long, run):
        return [(text, False)]
    out, start = [], 0
    for m in _RUNS.finditer(text):
        s, e = m.span()
        if e - s > run:
            if s > start:
                out.append((text[start:s], False))
            start = e if e == len(text) else e - 1
            out.append((text[s:start], True))
        elif s - start >= long:
            out.append((text[start:s], False))
            start = s
    if start < len(text):
        out.append((text[start:], False))
    return out


def encode(enc, text: str, long: int = LONG, run: int = RUN) -> list[int]:
    """Ids of a text, the same as of encode_ordinary over the whole."""
    ids: list[int] = []
    for part, single in chunks(text, long, run):
        ids += enc._encode_single_piece(part) if single else enc.encode_ordinary(part)
    return ids


def encode_documents(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), with_ids: bool = False) -> DataFrame:
    """Encode every whole text, decode the ids to bytes: id, n_tokens, ids_sha256, decoded_sha256[, ids].

    keep names further input columns to carry; one called like a result is left out. One pass, no shuffle.
    """

    def one(text: str) -> tuple:
        enc = encoding(path, pattern)
        ids = encode(enc, text)
        raw = np.asarray(ids, "<u4").tobytes()
        return (len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(enc.decode_bytes(ids)).hexdigest()) + ((ids,) if with_ids else ())

    made = {"n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()} | ({"ids": pa.list_(pa.int32())} if with_ids else {})
    rest = [c for c in dict.fromkeys((id_col, *keep)) if c not in made]  # a column called like a result gives way to it
    rows = text_batches(docs).select(*(docs[f"`{c}`"].alias(f"_c{i}") for i, c in enumerate(rest)), docs[f"`{text_col}`"].cast("string").alias("_text"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]) + ", n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    out = rows.mapInArrow(per_text(one, list(made), list(made.values())), schema)
    return out.select(*(F.col(f"_c{i}").alias(c) for i, c in enumerate(rest)), *made)
