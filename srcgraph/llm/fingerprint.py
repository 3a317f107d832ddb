"""Improbable-feature digests of documents.

Every 64-byte window of a text has an entropy; the rarer its value among windows of prose, the
lower its rank. A window that has the lowest rank of many runs of 64 neighbours is a feature. Each
feature sets five bits of a 2048-bit Bloom filter; after 160 features the next filter of the chain
begins. Two digests are compared filter by filter: the bits in common, less what chance gives,
over the most that they could have in common; the best partner of each filter counts.

Entropies are updated from window to window by how often the byte that leaves and the byte that
enters occur, for whole slices of documents in numpy. A text without features (shorter than a
window, or only of windows too uniform to tell) has one feature, the whole text.

Defined results: a null text is empty; empty texts are equal to each other; equal texts have equal
fingerprints; likeness is 1 for equal fingerprints and symmetric.
"""

from __future__ import annotations

import base64
import hashlib
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE_BYTES, partitions, sliced, text_batches
from .words import mix

WINDOW, RUN, POPULAR = 64, 64, 16
FILTER_BITS, FILTER_FEATURES, BITS = 2048, 160, 5
#: Of 1000 entropy values: the usual one of prose, and those that tell too little or are random.
USUAL, LEAST, MOST = 690, 100, 990
#: The share of the bits beyond chance that still counts as chance.
CUTOFF = 0.1

_UNIT = 1 << 16
_PLACES = [0] + [round(c * math.log2(c) * _UNIT) for c in range(1, WINDOW + 1)]
_STEP = np.array([0] + [_PLACES[c] - _PLACES[c - 1] for c in range(1, WINDOW + 1)], np.int32)
_RANK = np.array([1000 - abs(e - USUAL) if LEAST <= e <= MOST else 0 for e in range(1001)], np.int64)
_NONE = np.int64(1 << 20)
_CHUNK = 1 << 16


def ranks(data: np.ndarray) -> np.ndarray:
    """The rank of each window of the bytes, by its start; the rarer, the lower."""
    n = len(data)
    ahead, behind = np.zeros(n, np.uint8), np.zeros(n, np.uint8)
    for a in range(0, n, _CHUNK):
        b = min(a + _CHUNK, n)
        for k in range(1, WINDOW):
            e = min(b, n - k)
            if e <= a:
                break
            same = (data[a:e] == data[a + k : e + k]).view(np.uint8)
            ahead[a:e] += same
            behind[a + k : e + k] += same
    into, out = _STEP[behind + np.uint8(1)], _STEP[ahead + np.uint8(1)]
    total = np.empty(n - WINDOW + 1, np.int32)
    total[0] = into[:WINDOW].sum()
    np.subtract(into[WINDOW:], out[: n - WINDOW], out=total[1:])
    np.cumsum(total, out=total)
    whole = _PLACES[WINDOW]
    rank = _RANK[(whole - total.astype(np.int64)) * 1000 // whole]
    rank[rank == 0] = _NONE
    return rank


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, 64-bit hash) of the features of a slice's documents, in text order."""
    n = len(data)
    sizes = np.diff(offsets)
    doc, hashed = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    if n >= WINDOW:
        # the last windows of a document reach into the next; without them a run stays in its document
        valid = np.zeros(n + 1, np.int32)
        long = sizes >= WINDOW
        valid[offsets[:-1][long]] += 1
        valid[offsets[1:][long] - WINDOW + 1] -= 1
        valid = np.cumsum(valid)[: n - WINDOW + 1] > 0
        rank = ranks(data)
        rank[~valid] = _NONE
        best = (rank << 40) | np.arange(len(rank), dtype=np.int64)
        width = 1
        while width < RUN and width < len(best):
            best[:-width] = np.minimum(best[:-width], best[width:])
            width *= 2
        best = best[valid]
        best = best[best >> 40 < _NONE] & ((1 << 40) - 1)
        wins = np.bincount(best, minlength=1)
        owner = np.searchsorted(offsets, best, "right") - 1
        need = np.minimum(POPULAR, np.bincount(owner, minlength=len(sizes)))
        at = np.flatnonzero(wins)
        doc = np.searchsorted(offsets, at, "right") - 1
        chosen = wins[at] >= need[doc]
        at, doc = at[chosen], doc[chosen]
        hashed = np.zeros(len(at), np.uint64)
        for a in range(0, len(at), 1 << 16):
            rows = np.lib.stride_tricks.sliding_window_view(data, WINDOW)[at[a : a + (1 << 16)]].view("<u8")
            h = np.zeros(len(rows), np.uint64)
            for column in rows.T:
                h = mix((h ^ column) + np.uint64(0x9E3779B97F4A7C15))
            hashed[a : a + (1 << 16)] = h
    bare = np.setdiff1d(np.arange(len(sizes)), doc)
    bare = bare[sizes[bare] > 0]
    whole = [int.from_bytes(hashlib.blake2b(data[offsets[d] : offsets[d + 1]].tobytes(), digest_size=8).digest(), "little") for d in bare]
    doc, hashed = np.concatenate((doc, bare)), np.concatenate((hashed, np.array(whole, np.uint64)))
    order = np.argsort(doc, kind="stable")
    return doc[order], hashed[order]


def digests(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """The filters of each document of a slice: arrays of (filters, bytes)."""
    doc, hashed = features(data, offsets)
    count = np.bincount(doc, minlength=len(offsets) - 1)
    first = np.concatenate(([0], np.cumsum(count)))
    filters = -(-count // FILTER_FEATURES)
    start = np.concatenate(([0], np.cumsum(filters)))
    bits = np.zeros((start[-1], FILTER_BITS), bool)
    place = start[doc] + (np.arange(len(doc)) - first[doc]) // FILTER_FEATURES
    for k in range(BITS):
        bits[place, (hashed >> np.uint64(11 * k)).astype(np.int64) & (FILTER_BITS - 1)] = True
    packed = np.packbits(bits, axis=1)
    return [packed[start[d] : start[d + 1]] for d in range(len(count))]


def text_form(digest: np.ndarray) -> str:
    """A digest as text: the number of filters, then their bytes in base 64."""
    return f"{len(digest)}:{base64.b64encode(digest.tobytes()).decode()}"


def parsed(text: str) -> np.ndarray:
    """The digest of a text form."""
    return np.frombuffer(base64.b64decode(text.partition(":")[2]), np.uint8).reshape(-1, FILTER_BITS // 8)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Normalised bit overlap of two digests, 0 to 1."""
    if a.shape == b.shape and (a is b or np.array_equal(a, b)):
        return 1.0
    if not len(a) or not len(b):
        return 0.0
    x, y = np.ascontiguousarray(a).view(np.uint64), np.ascontiguousarray(b).view(np.uint64)
    return min(_towards(x, y), _towards(y, x)) if len(x) == len(y) else _towards(x, y) if len(x) < len(y) else _towards(y, x)


def _towards(x: np.ndarray, y: np.ndarray) -> float:
    ny = np.bitwise_count(y).sum(axis=1, dtype=np.int64)
    total = weight = 0.0
    for row in x:
        n = int(np.bitwise_count(row).sum(dtype=np.int64))
        common = np.bitwise_count(row & y).sum(axis=1, dtype=np.int64)
        chance = n * ny / FILTER_BITS
        room = np.maximum(np.minimum(n, ny) - chance, 1e-9)
        best = float(np.max((common - chance) / room))
        total += n * min(1.0, max(0.0, (best - CUTOFF) / (1 - CUTOFF)))
        weight += n
    return total / weight


def _blocks(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> with block and tail: blocks of neighbours in id, each with the row after its last.

    The bounds of the blocks are quantiles of the ids; driver and tasks only see one number per block.
    """
    n = 4 * partitions(docs)  # several blocks a partition even out what hashing deals
    ids = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("id"))
    found = ids.select(F.percentile_approx("id", [i / n for i in range(1, n)] or [0.5], 20 * n).alias("q")).first()["q"] or []
    cuts = np.unique(np.array(found, np.int64))

    @F.pandas_udf("int")
    def block(id: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, id.to_numpy(), "left").astype(np.int32))

    heads = sorted((r["block"], r["head"]) for r in ids.select(block("id").alias("block"), "id").groupBy("block").agg(F.max("id").alias("head")).collect())
    heads.reverse()
    head_ids = np.array([h for _, h in heads], np.int64)
    before = np.array([heads[i - 1][0] for i in range(len(heads))], np.int32)  # of the first, the last
    order = np.argsort(head_ids)

    @F.pandas_udf("int")
    def tail_of(id: pd.Series) -> pd.Series:
        v = id.to_numpy()
        at = np.minimum(np.searchsorted(head_ids[order], v), len(order) - 1)
        hit = head_ids[order][at] == v
        return pd.Series(np.where(hit, before[order][at], -1).astype(np.int32))

    rows = docs.withColumn("_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))))
    rows = rows.withColumn("block", block("_id")).withColumn("other", tail_of("_id"))
    place = F.explode(F.filter(F.array(F.struct("block", F.lit(0).alias("tail")), F.struct(F.col("other").alias("block"), F.lit(1).alias("tail"))), lambda p: p["block"] >= 0))
    return rows.select("doc_id", "_id", "text", place.alias("p")).select("doc_id", "_id", "text", "p.block", "p.tail")


OUT = "doc_id {id}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edited(text: str, following: str) -> str:
    """The text with its last third replaced by as much of the following one's beginning."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


def fingerprint_neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Digests of every whole text and of its edited form, likened to each other and to the next document's.

    The next document is the next lower id (rows of one id by text, null ids last), after the last
    the first. One shuffle of the texts into blocks of neighbouring ids.
    """
    docs = text_batches(docs).select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = _blocks(docs).repartition(partitions(docs), "block").sortWithinPartitions("block", "tail", F.desc("_id"), F.asc_nulls_first("text")).select("block", "tail", "doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def made(ids: list, texts: list[str], types: pa.DataType) -> pa.RecordBatch:
        """Rows for all texts but the last, which only follows."""
        changed = [edited(t, u) for t, u in zip(texts, texts[1:], strict=False)]
        todo = pa.array(texts + changed, pa.large_string())
        out = [d for _, _, data, offsets in sliced(todo) for d in digests(data, offsets)]
        own, other = out[: len(texts)], out[len(texts) :]
        columns = [
            pa.array(ids[: len(changed)], types),
            pa.array([len(t) for t in texts[:-1]], pa.int64()),
            pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed]),
            pa.array([text_form(d) for d in own[:-1]]),
            pa.array([text_form(d) for d in other]),
            pa.array([likeness(a, b) for a, b in zip(own, other, strict=False)], pa.float64()),
            pa.array([likeness(a, b) for a, b in zip(own, own[1:], strict=False)], pa.float64()),
        ]
        return pa.RecordBatch.from_arrays(columns, names=names)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        texts: list[str] = []
        size, now, closed, types = 0, None, False, None
        for batch in batches:
            types = batch.schema.field("doc_id").type
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                for at, tail, id, text in zip(*(part.column(i).to_pylist() for i in range(4)), strict=True):
                    if at != now:
                        now, closed, ids, texts, size = at, False, [], [], 0
                    if closed:  # further rows of the id that follows the block
                        continue
                    ids.append(id)
                    texts.append(text or "")
                    size += len(texts[-1])
                    if (tail or size > SLICE_BYTES) and len(texts) > 1:
                        yield made(ids, texts, types)
                        ids, texts, size = ids[-1:], texts[-1:], len(texts[-1])
                    closed = bool(tail)

    return rows.mapInArrow(run, OUT.format(id=kind))
