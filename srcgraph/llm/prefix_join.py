"""Grouped prefix join: documents whose sets of word n-grams have a Jaccard likeness of P % or more.

1. Each document becomes a set of 64-bit n-gram hashes. Blocks of documents send their tokens to
   buckets by hash, each token once with the documents that have it.
2. A bucket counts in how many documents a token is and returns the tokens that are in two or more.
3. Back in its block, a document's tokens stand in one global order, rarest first. Two documents of
   the wanted likeness share a token of their prefixes, the first N - ceil(P N / 100) + 1 tokens. A
   document whose prefix holds only tokens of its own has no partner and drops out here.
4. Documents with equal sets are one class; classes with equal prefixes and sizes are one group.
   Groups that share prefix tokens form candidate clusters: a star per token, never all pairs.
5. The classes of a cluster meet by size (a partner is at most 100 / P times as large) in units of
   bounded size. In a unit, pairs of groups that share prefix tokens are formed and filtered by size
   and by the places of the shared tokens; what is left is expanded, and members are verified by
   their exact overlap. A pair that is connected already needs no check.
6. A cluster of many units sends its likeliest centres, a few classes with the fewest tokens of
   their own, to all its units: near copies of one text become connected in this pass, whose rows
   grow in proportion to the cluster. Classes that are still apart from the cluster's largest
   component then meet all classes of the cluster, so no link is lost; this second pass costs
   their number times the cluster's size / UNIT.
7. Components of the links, then of the documents of each class.

A token carries 40 bits and its bucket's; both stand for the n-gram.

Defined results: texts with fewer words than n are one n-gram; texts without words and null texts
have no set, link with nothing and are their own component; rows that repeat a document id are
documents alike; a null id counts in no minimum.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, partitions, settled, sliced, spread_join, text_batches
from .words import BASE, Words, mix, windows

#: Documents of a block (a token's documents are bytes), buckets for each partition.
BLOCK_DOCS, BUCKETS_EACH = 256, 3
#: Classes of a unit, centres that all units of a cluster get, classes of half a unit of the second pass.
UNIT, CENTRES, HALF = 128, 16, 512

_C1, _C2 = np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB)


def ngrams(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of the distinct word n-grams of a slice, by document, then hash."""
    w = Words(data, offsets, lower=True)
    words = w.hashes(w.starts, w.ends)
    docs = w.documents()
    at = np.flatnonzero(w.first[1:][docs] - np.arange(len(words)) >= n)
    doc, gram = docs[at], windows(words, n)[at] if len(at) else np.zeros(0, np.uint64)
    for k in range(1, n):
        few = np.flatnonzero(w.counts == k)
        if len(few):
            h = np.full(len(few), k, np.uint64)
            for j in range(k):
                h = mix(h * np.uint64(BASE) + words[w.first[:-1][few] + j])
            doc, gram = np.concatenate((doc, few)), np.concatenate((gram, h))
    order = np.lexsort((gram, doc))
    doc, gram = doc[order], gram[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (gram[1:] != gram[:-1])
    return doc[new], gram[new]


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values)))
    return total[first[1:]] - total[first[:-1]]


def _pack(token: np.ndarray) -> bytes:
    """40-bit numbers: their lower 32 bits, then their upper 8."""
    return (token & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes() + (token >> np.uint64(32)).astype(np.uint8).tobytes()


def _unpack(raw: bytes) -> np.ndarray:
    n = len(raw) // 5
    return np.frombuffer(raw, "<u4", n).astype(np.uint64) | np.frombuffer(raw, np.uint8, n, 4 * n).astype(np.uint64) << np.uint64(32)


def _pack6(token: np.ndarray) -> bytes:
    """48 bits of each token's hash in the tokens' order: enough to tell the tokens of one unit apart."""
    token = mix(token) >> np.uint64(16)
    return (token & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes() + (token >> np.uint64(32)).astype("<u2").tobytes()


def _unpack6(raw: bytes) -> np.ndarray:
    n = len(raw) // 6
    return np.frombuffer(raw, "<u4", n).astype(np.uint64) | np.frombuffer(raw, "<u2", n, 4 * n).astype(np.uint64) << np.uint64(32)


BLOCKS = "bucket int, block long, tokens binary, counts binary, docs binary, ids array<long>, sizes array<long>, digests binary, twins array<int>"
_BLOCKS = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("tokens", pa.binary()), ("counts", pa.binary()), ("docs", pa.binary()), ("ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("digests", pa.binary()), ("twins", pa.list_(pa.int32()))])


def _blocks(n: int, buckets: int):
    """Step 1, for mapInArrow over (id, text)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            for begin in range(0, batch.num_rows, BLOCK_DOCS):
                part = batch.slice(begin, BLOCK_DOCS)
                for start, end, data, offsets in sliced(part.column(1)):
                    yield one(block, part.column(0).slice(start, end - start), data, offsets)
                    block += 1

    def one(block: int, ids: pa.Array, data: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
        doc, gram = ngrams(data, offsets, n)
        size = np.bincount(doc, minlength=len(ids))
        first = np.concatenate(([0], np.cumsum(size)))
        digest = np.stack((_sums(mix(gram ^ _C1), first), _sums(mix(gram ^ _C2), first)), 1)
        known: dict[tuple, int] = {}
        twins = [known.setdefault((int(s), int(a), int(b)), i) if s else i for i, (s, (a, b)) in enumerate(zip(size, digest, strict=True))]
        only = np.asarray(twins)[doc] == doc
        doc, gram = doc[only], gram[only]
        bucket = (gram & np.uint64(0xFFFFFF)) % np.uint64(buckets)
        token = gram >> np.uint64(24)
        order = np.lexsort((doc, token, bucket))
        doc, token, bucket = doc[order].astype(np.uint8), token[order], bucket[order]
        head = np.ones(len(doc), bool)
        head[1:] = (token[1:] != token[:-1]) | (bucket[1:] != bucket[:-1])
        at = np.flatnonzero(head)
        count = np.diff(np.append(at, len(doc)))
        own = bucket[at]
        cuts = np.flatnonzero(np.append(True, own[1:] != own[:-1])) if len(own) else np.zeros(0, np.int64)
        rows: dict[str, list] = {c: [] for c in _BLOCKS.names}
        for a, b in zip(cuts, np.append(cuts[1:], len(own))[: len(cuts)], strict=True):
            s, e = at[a], at[b] if b < len(at) else len(doc)
            for c, v in zip(rows, (int(own[a]), block, _pack(token[at[a:b]]), count[a:b].astype("<u2").tobytes(), doc[s:e].tobytes(), None, None, None, None), strict=True):
                rows[c].append(v)
        for c, v in zip(rows, (block % buckets, block, None, None, None, ids.to_pylist(), size.tolist(), digest.astype("<u8").tobytes(), twins), strict=True):
            rows[c].append(v)
        return pa.RecordBatch.from_arrays([pa.array(rows[f.name], f.type) for f in _BLOCKS], schema=_BLOCKS)

    return run


SHARED = "block long, tokens binary, common binary, docs binary, bucket int, ids array<long>, sizes array<long>, digests binary, twins array<int>"
_SHARED = pa.schema([("block", pa.int64()), ("tokens", pa.binary()), ("common", pa.binary()), ("docs", pa.binary()), ("bucket", pa.int32())] + [_BLOCKS.field(c) for c in ("ids", "sizes", "digests", "twins")])


def grouped(batches: Iterable[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[dict]]]:
    """Runs of rows with equal values in the first `keys` columns."""
    now: tuple | None = None
    rows: list[dict] = []
    for batch in batches:
        names = batch.schema.names[:keys]
        for start in range(0, batch.num_rows, 64):
            for row in batch.slice(start, 64).to_pylist():
                key = tuple(row[c] for c in names)
                if key != now:
                    if rows:
                        yield now, rows
                    now, rows = key, []
                rows.append(row)
    if rows:
        yield now, rows


def _count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Step 2, over rows sorted by bucket."""
    for (bucket,), rows in grouped(batches, 1):
        out: dict[str, list] = {c: [] for c in _SHARED.names}

        def put(*values: object, out: dict[str, list] = out) -> None:
            for c, v in zip(out, values, strict=True):
                out[c].append(v)

        for r in rows:
            if r["tokens"] is None:
                put(r["block"], None, None, None, None, r["ids"], r["sizes"], r["digests"], r["twins"])
        rows = [r for r in rows if r["tokens"] is not None]
        if rows:
            tokens = [_unpack(r["tokens"]) for r in rows]
            counts = [np.frombuffer(r["counts"], "<u2").astype(np.int64) for r in rows]
            _, place = np.unique(np.concatenate(tokens), return_inverse=True)
            total = np.bincount(place, np.concatenate(counts)).astype(np.int64)[place]
            level = np.minimum(255, 8 * np.log2(total)).astype(np.uint8)
            start = 0
            for r, t, c in zip(rows, tokens, counts, strict=True):
                shared = total[start : start + len(t)] >= 2
                if shared.any():
                    each = np.repeat(shared, c)
                    put(r["block"], _pack(np.repeat(t, c)[each]), np.repeat(level[start : start + len(t)], c)[each].tobytes(), np.frombuffer(r["docs"], np.uint8)[each].tobytes(), bucket, None, None, None, None)
                start += len(t)
        if out["block"]:
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in _SHARED], schema=_SHARED)


DOCS = "row long, doc_id long, n_shingles long, key string, prefix array<long>, shared binary"
_DOCS = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("key", pa.string()), ("prefix", pa.list_(pa.int64())), ("shared", pa.binary())])


def _prefixes(percent: int):
    """Step 3, over rows sorted by block."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (block,), rows in grouped(batches, 1):
            meta = next(r for r in rows if r["ids"] is not None)
            rows = [r for r in rows if r["tokens"] is not None]
            none = np.zeros(0, np.uint64)
            token = np.concatenate([none] + [_unpack(r["tokens"]) | np.uint64(r["bucket"] << 40) for r in rows])
            level = np.concatenate([none.astype(np.uint8)] + [np.frombuffer(r["common"], np.uint8) for r in rows])
            doc = np.concatenate([none.astype(np.uint8)] + [np.frombuffer(r["docs"], np.uint8) for r in rows])
            order = np.lexsort((token, level, doc))
            token, doc = token[order], doc[order]
            first = np.searchsorted(doc, np.arange(len(meta["ids"]) + 1))
            digests = np.frombuffer(meta["digests"], "<u8").reshape(-1, 2)
            columns: list[list] = [[] for _ in _DOCS]
            for i, (id, size, twin) in enumerate(zip(meta["ids"], meta["sizes"], meta["twins"], strict=True)):
                prefix = shared = None
                alone = size - int(first[i + 1] - first[i])
                length = size - -(-percent * size // 100) + 1
                if size and twin == i and length > alone:
                    mine = token[first[i] : first[i + 1]]
                    prefix, shared = mine[: length - alone].astype(np.int64), _pack6(mine)
                key = f"{int(digests[i, 0]):016x}{int(digests[i, 1]):016x}{size:x}" if size else None
                for c, v in zip(columns, (block * BLOCK_DOCS + i, id, size, key, prefix, shared), strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _DOCS, strict=True)], schema=_DOCS)

    return run


def group_pairs(prefixes: list[np.ndarray], sizes: np.ndarray, alone: np.ndarray, percent: int) -> list[np.ndarray]:
    """For each group the groups that it can have links with, itself included.

    prefixes: a group's prefix tokens in the global order, those that no other document has left out;
    alone: the number of those. A pair must share a token, be of like size, and the shared tokens must
    leave enough of both sets for the overlap that the likeness takes (the positional filter).
    """
    n = len(prefixes)
    lengths = np.array([len(p) for p in prefixes])
    token, owner = np.concatenate(prefixes), np.repeat(np.arange(n), lengths)
    place = np.arange(len(token)) - np.repeat(np.cumsum(lengths) - lengths, lengths) + alone[owner]
    _, token = np.unique(token, return_inverse=True)
    order = np.argsort(token, kind="stable")
    start = np.concatenate(([0], np.cumsum(np.bincount(token, minlength=1))))
    first = np.concatenate(([0], np.cumsum(lengths)))
    out = []
    for x in range(n):
        mine = token[first[x] : first[x + 1]]
        s, e = start[mine], start[mine + 1]
        at = order[np.arange((e - s).sum()) + np.repeat(s - np.concatenate(([0], np.cumsum(e - s)[:-1])), e - s)]
        common = np.bincount(owner[at], minlength=n)
        here, there = np.zeros(n, np.int64), np.zeros(n, np.int64)
        here[owner[at]] = np.repeat(place[first[x] : first[x + 1]], e - s)  # of a pair's shared tokens the last one stays
        there[owner[at]] = place[at]
        need = -(-percent * (sizes[x] + sizes) // (100 + percent))
        most = common + np.minimum(sizes[x] - here, sizes - there) - 1
        fits = (common > 0) & (most >= need) & (100 * np.minimum(sizes, sizes[x]) >= percent * np.maximum(sizes, sizes[x]))
        fits[x] = True
        out.append(np.flatnonzero(fits))
    return out


def forest(sets: list[np.ndarray], heads: np.ndarray, sizes: np.ndarray, home: np.ndarray, percent: int, lead: np.ndarray | None = None, label: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Edges that connect what links connect among sets.

    heads: how many of a set's tokens are its prefix. Pairs of two guests, or of two that don't lead,
    are left to another unit; sets with equal labels are connected already.
    """
    n = len(sets)
    lead = np.ones(n, bool) if lead is None else lead
    label = np.arange(n) if label is None else np.unique(label, return_inverse=True)[1]
    lengths = np.array([len(s) for s in sets])
    groups: dict[tuple, int] = {}
    group = np.array([groups.setdefault((int(z), s[:h].tobytes()), len(groups)) for s, h, z in zip(sets, heads, sizes, strict=True)])
    of = np.unique(group, return_index=True)[1]
    partners = group_pairs([sets[i][: heads[i]] for i in of], sizes[of], (sizes - lengths)[of], percent)
    token = np.concatenate(sets)
    owner = np.repeat(np.arange(n), lengths)
    _, token = np.unique(token, return_inverse=True)
    posting = owner[np.argsort(token, kind="stable")]
    start = np.concatenate(([0], np.cumsum(np.bincount(token))))
    first = np.concatenate(([0], np.cumsum(lengths)))
    edges: list[tuple[int, int]] = []
    left = len(np.unique(label)) - 1
    for x in np.argsort(sizes - lengths, kind="stable"):  # those with the fewest tokens of their own link to most
        if not left:
            break
        near = np.zeros(len(of), bool)
        near[partners[group[x]]] = True
        todo = near[group] & (home | home[x]) & (lead | lead[x]) & (label != label[x])
        if not todo.any():
            continue
        mine = token[first[x] : first[x + 1]]
        s, e = start[mine], start[mine + 1]
        place = np.arange((e - s).sum()) + np.repeat(s - np.concatenate(([0], np.cumsum(e - s)[:-1])), e - s)
        common = np.bincount(posting[place], minlength=n)
        for y in np.flatnonzero(todo & (100 * common >= percent * (sizes[x] + sizes - common))):
            if label[x] != label[y]:
                label = np.where(label == label[y], label[x], label)
                edges.append((int(x), int(y)))
                left -= 1
    return edges


#: What a unit's rows hold: the unit, the class and the flags that forest takes.
MEMBER = ("row", "n_shingles", "head", "home", "lead", "label", "shared")


def _verify(percent: int):
    """Steps 5 and 6, over rows (cluster, level, i, j, *MEMBER) sorted by unit."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in grouped(batches, 4):
            each: dict[int, dict] = {}
            for r in rows:  # a class may come as a member and as a centre
                if r["lead"] or r["row"] not in each:
                    each[r["row"]] = r
            rows = list(each.values())
            column = lambda c: np.array([r[c] for r in rows])  # noqa: B023, E731
            home, lead, label = column("home"), column("lead"), column("label")
            if len(rows) > 1 and home.any() and lead.any() and (label != label[0]).any():
                found = forest([_unpack6(r["shared"]) for r in rows], column("head"), column("n_shingles"), home, percent, lead, label)
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([rows[e[i]]["row"] for e in found], pa.int64()) for i in (0, 1)], names=["a", "b"])

    return run


def _stars(posts: DataFrame, salts: int = 64) -> DataFrame:
    """posts(grp, token) -> edges a, b that connect the groups of each token: a star in each part of the token, and one of the parts."""
    dealt = posts.withColumn("part", F.pmod(F.xxhash64("grp"), F.lit(salts)).cast("int"))
    tops = dealt.groupBy("token", "part").agg(F.min("grp").alias("least"))
    firsts = tops.groupBy("token").agg(F.min("least").alias("first"))
    within = dealt.join(tops, ["token", "part"]).select(F.col("grp").alias("a"), F.col("least").alias("b"))
    return within.unionByName(tops.join(firsts, "token").select(F.col("least").alias("a"), F.col("first").alias("b"))).where("a <> b")


def _units(rows: DataFrame, percent: int, p: int) -> DataFrame:
    """Edges a, b among rows (cluster, level, i, j, *MEMBER)."""
    unit = ("cluster", "level", "i", "j")
    return settled(rows.select(*unit, *MEMBER).repartition(p, *unit).sortWithinPartitions(*unit, "row").mapInArrow(_verify(percent), "a long, b long"), "ngram-links")


def _numbers(n: str, each: int = 1024) -> tuple:
    """(blocks, numbers of a block): 0 .. n - 1 as two arrays to explode one after the other, so that one task needn't make them all."""
    blocks = F.sequence(F.lit(0), F.floor((F.col(n) - 1) / each).cast("int"))
    return blocks, F.sequence(F.col("block") * each, F.least(F.col(n) - 1, F.col("block") * each + each - 1))


def _links(placed: DataFrame, sets: DataFrame, percent: int, p: int) -> DataFrame:
    """Edges a, b that connect the classes of placed(row, n_shingles, head, own, cluster, size); sets: row, shared."""
    unit = ["cluster", "level"]
    placed = placed.withColumn("more", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("home", F.col("more") == 0).withColumn("level", F.col("size") + F.col("more"))
    sizes = placed.groupBy(*unit).agg(F.count("*").alias("members"), F.max("home").alias("open")).where("members > 1 and open").select(*unit, "members", F.ceil(F.col("members") / UNIT).cast("int").alias("parts"))
    dealt = spread_join(placed, sizes, unit).select(*unit, "members", "parts", "row", "n_shingles", "head", "own", "home", F.lit(True).alias("lead"), F.col("row").alias("label"))
    dealt = settled(dealt, "ngram-units")

    # the centres: of each slot of a cluster the class with the least share of tokens of its own
    slot = F.pmod(F.xxhash64("row"), F.lit(CENTRES)).alias("slot")
    rank = F.struct((F.col("own") / F.col("n_shingles")).alias("own"), "row")
    centres = dealt.where("parts > 1").groupBy(*unit, "parts", slot).agg(F.min_by(F.struct("row", "n_shingles", "head", "home", "lead", "label"), rank).alias("c"))
    blocks, numbers = _numbers("parts")
    centres = centres.select(*unit, "parts", "c.*").join(sets, "row").withColumn("block", F.explode(blocks)).repartition(p, "row", "block").withColumn("i", F.explode(numbers))
    part = F.pmod(F.xxhash64("row", F.lit(1)), F.col("parts")).cast("int")
    members = dealt.join(sets, "row").withColumn("i", part)
    columns = [*unit, "i", F.col("i").alias("j"), *MEMBER]
    found = _units(members.select(*columns).unionByName(centres.select(*columns)), percent, p)

    # what is still apart in clusters of several units meets the whole cluster
    joined = components(found)
    roots = joined.unionByName(joined.select(F.col("root").alias("node"), "root").distinct())
    many = dealt.where("parts > 1").drop("label").join(roots, F.col("row") == F.col("node"), "left").withColumn("label", F.coalesce("root", "row")).drop("node", "root")
    counts = many.groupBy(*unit, "members", "label").agg(F.count("*").alias("n"))
    apart = counts.groupBy(*unit, "members").agg(F.max_by("label", F.struct("n", "label")).alias("top"), F.max("n").alias("n")).where("n < members")
    apart = apart.select(*unit, "top", F.ceil((F.col("members") - F.col("n")) / HALF).cast("int").alias("rests"), F.ceil(F.col("members") / HALF).cast("int").alias("alls"))
    late = settled(spread_join(many.drop("lead"), apart, unit).withColumn("lead", F.col("label") != F.col("top")), "ngram-apart")
    with_sets = late.join(sets, "row")
    half = lambda n: F.pmod(F.xxhash64("row", F.lit(2)), F.col(n)).cast("int")
    rest = with_sets.where("lead").withColumn("i", half("rests")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("alls") - 1)))
    whole = with_sets.withColumn("lead", F.lit(False)).withColumn("j", half("alls")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("rests") - 1)))
    columns = [*unit, "i", "j", *MEMBER]
    more = _units(rest.select(*columns).unionByName(whole.select(*columns)), percent, p)
    return joined.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more)


def jaccard_components(docs: DataFrame, n: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs."""
    p = partitions(docs)
    rows = text_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    blocks = rows.mapInArrow(_blocks(n, p * BUCKETS_EACH), BLOCKS).repartitionById(p, F.col("bucket") % p).sortWithinPartitions("bucket")
    shared = blocks.mapInArrow(_count, SHARED).repartition(p, "block").sortWithinPartitions("block")
    table = settled(shared.mapInArrow(_prefixes(percent), DOCS), "ngram-sets")

    classes = table.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"))
    wanted = table.where("prefix is not null")
    group = F.xxhash64("n_shingles", "prefix").alias("grp")
    # copies of a class in other blocks have the same set: its first row stands for it
    first = F.struct("row", "n_shingles", F.size("prefix").alias("head"), (F.col("n_shingles") - F.octet_length("shared") / 6).cast("long").alias("own"), group)
    chosen = settled(wanted.groupBy("key").agg(F.min(first).alias("s")).select("key", "s.*"), "ngram-classes")
    clusters = components(_stars(wanted.select(group, F.explode("prefix").alias("token"))))
    clusters = clusters.unionByName(clusters.select(F.col("root").alias("node"), "root").distinct()).select(F.col("node").alias("grp"), F.col("root").alias("cluster"))

    # groups alone in their cluster still hold classes with equal prefixes
    size = F.floor(F.log(F.col("n_shingles").cast("double")) / max(math.log(100 / percent) * 1.0001, 1e-9)).cast("long")
    placed = spread_join(chosen.drop("key"), clusters, ["grp"], "left").select("row", "n_shingles", "head", "own", F.coalesce("cluster", "grp").alias("cluster"), size.alias("size"))
    links = components(_links(placed, wanted.select("row", "shared"), percent, p))

    members = links.unionByName(links.select(F.col("root").alias("node"), "root").distinct())
    named = members.join(chosen.select("row", "key"), F.col("node") == F.col("row")).join(classes, "key").select("key", "root", "least")
    tops = named.groupBy("root").agg(F.min("least").alias("component_id"))
    # merged, as a broadcast of many members would leave a large component to one task
    linked = spread_join(named.hint("merge"), tops, ["root"], salts=32).select("key", "component_id")
    alone = classes.where("n > 1").join(linked, "key", "left_anti").select("key", F.col("least").alias("component_id"))
    out = spread_join(table.select("doc_id", "n_shingles", "key"), linked.unionByName(alone), ["key"], "left", 32)
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
