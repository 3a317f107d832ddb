"""Language-model scores from a subword lattice.

The pieces of an existing vocabulary, weighted by its scores, span a lattice over every word: each
path is a segmentation. A forward recursion in log space sums over all paths, which makes a word's
probability m the marginal over its segmentations. The words of the corpus are learnt as arcs of
the same lattice: among N training tokens, one seen c times has an arc of weight c, and the paths
through pieces share a weight of PRIOR, so its probability is (c + PRIOR m) / (N + PRIOR), the
marginal over both (a Dirichlet prior whose mean is the lattice). `score` is the log10 probability
of a text, the product over its words and one end; `lattice_score` is that of the pieces alone.

Scores of a unigram model are log probabilities and are used as they are. A vocabulary whose scores
are whole numbers has ranks for scores; its pieces get probabilities by rank, 1 / (rank + SHIFT).

Corpus counts travel packed: a block of documents sends each bucket its distinct words with
training counts; the bucket adds up the counts of all blocks, scores each word once and returns
both to the blocks that have the word; there they meet the list of which document has which word
how often. No table of words is collected or broadcast. However common a word is, a block sends it
once, and buckets are as many as the input has partitions, so a bucket's size does not follow the
size of the corpus.

Defined results: null and empty texts consist of the end alone; repeated rows count again in
training and are scored alike; without training documents every count is 0; null ids are not held
out; a word of any length is one word, scored in time linear in it; further columns of the input,
whatever their names, are not read.
"""

from __future__ import annotations

import functools
import math
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import partitions, settled, text_batches
from .prefix_join import grouped

#: The lattice's probability of the end, the weight of its paths in training tokens, what base scores add to each count.
END, PRIOR, ADDED = 0.05, 10_000, 0.1
#: Documents and bytes of a block, buckets for each partition.
BLOCK_DOCS, BLOCK_BYTES, BUCKETS_EACH = 1024, 4 << 20, 2
#: The shift of the rank-probability rule 1 / (rank + SHIFT), and the probability of ending a word's lattice in one more piece.
SHIFT, MORE = 2.7, 0.5


class Lattice:
    """Pieces with log probabilities; a byte that no piece covers costs as much as the rarest piece."""

    def __init__(self, pieces: dict[str, float], start: str):
        self.pieces, self.start = pieces, start
        self.longest = max(map(len, pieces))
        self.rare = min(pieces.values())

    def log_probability(self, word: str) -> float:
        """Of a word: the sum over its segmentations, by forward recursion."""
        text = self.start + word
        n = len(text)
        best = [-math.inf] * (n + 1)
        best[0] = 0.0
        pieces, longest = self.pieces, self.longest
        step, stop = math.log(MORE), math.log(1 - MORE)
        for end in range(1, n + 1):
            paths = []
            for begin in range(max(0, end - longest), end):
                p = pieces.get(text[begin:end])
                if p is not None:
                    paths.append(best[begin] + p)
            if text[end - 1] not in pieces:
                paths.append(best[end - 1] + self.rare * len(text[end - 1].encode()))
            top = max(paths)
            best[end] = top + math.log(sum(math.exp(p - top) for p in paths)) + step
        return best[n] - step + stop


@functools.lru_cache(maxsize=2)
def lattice(path: str) -> Lattice:
    """The lattice of a SentencePiece model file's ordinary pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    if any(model.get_score(i) % 1 for i in ids):
        return Lattice({model.id_to_piece(i): model.get_score(i) for i in ids}, "▁")
    ids.sort(key=lambda i: (-model.get_score(i), i))
    total = sum(1 / (rank + SHIFT) for rank in range(len(ids)))
    return Lattice({model.id_to_piece(i): -math.log((rank + SHIFT) * total) for rank, i in enumerate(ids)}, "▁")


def held_out(doc_id: Column) -> Column:
    """Documents kept from training: those whose id's text has a CRC-32 divisible by 10."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 10 == 0


def tokens(text: str) -> list[bytes]:
    """The words of a text, A-Z in lower case: what bytes.split and bytes.lower do."""
    return text.encode().lower().split()


BLOCKS = "bucket int, block long, words binary, counts binary, docs binary, places binary, times binary, ids array<long>, held array<boolean>, sizes array<long>"
_BLOCKS = pa.schema([("bucket", pa.int32()), ("block", pa.int64())] + [(c, pa.binary()) for c in ("words", "counts", "docs", "places", "times")] + [("ids", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())), ("sizes", pa.list_(pa.int64()))])


def _blocks(buckets: int):
    """For mapInArrow over (id, held, text): rows for each bucket, and one that describes the block."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(2)), 0).to_numpy(zero_copy_only=False)
            start = 0
            total = np.cumsum(sizes)
            while start < batch.num_rows:
                done = total[start - 1] if start else 0
                end = min(start + BLOCK_DOCS, max(start + 1, int(np.searchsorted(total, done + BLOCK_BYTES, "right"))))
                yield one(block, batch.slice(start, end - start))
                block, start = block + 1, end

    def one(block: int, part: pa.RecordBatch) -> pa.RecordBatch:
        ids, held = part.column(0).to_pylist(), part.column(1).to_pylist()
        place: dict[bytes, int] = {}
        counts: list[int] = []
        sizes, docs, places, times = [], [], [], []
        for i, (out, text) in enumerate(zip(held, part.column(2).to_pylist(), strict=True)):
            found = tokens(text or "")
            sizes.append(len(found))
            own = Counter(found)
            docs.append(np.full(len(own), i, np.uint16))
            spots = [place.setdefault(word, len(place)) for word in own]
            n = np.fromiter(own.values(), np.uint32, len(own))
            counts.extend([0] * (len(place) - len(counts)))
            places.append(np.array(spots, np.int64))
            times.append(n)
            if not out:
                for spot, k in zip(spots, own.values(), strict=True):
                    counts[spot] += k
        words = list(place)
        bucket = np.array([zlib.crc32(w) % buckets for w in words], np.int64)
        order = np.argsort(bucket, kind="stable")
        rank = np.empty(len(words), np.int64)
        rank[order] = np.arange(len(words))
        first = np.searchsorted(bucket[order], np.arange(buckets + 1))
        total = np.array(counts, "<u4")[order]
        rows: dict[str, list] = {c: [] for c in _BLOCKS.names}

        def put(*values: object) -> None:
            for c, v in zip(rows, values, strict=True):
                rows[c].append(v)

        for b in np.unique(bucket):
            s, e = first[b], first[b + 1]
            put(int(b), block, b"\n".join(words[k] for k in order[s:e]), total[s:e].tobytes(), None, None, None, None, None, None)
        joined = lambda parts, kind: np.concatenate([*parts, np.zeros(0, np.int64)]).astype(kind).tobytes()
        put(block % buckets, block, None, None, joined(docs, "<u2"), joined([rank[p] for p in places], "<u4"), joined(times, "<u4"), ids, held, sizes)
        return pa.RecordBatch.from_arrays([pa.array(rows[f.name], f.type) for f in _BLOCKS], schema=_BLOCKS)

    return run


VALUES = "block long, bucket int, vocabulary long, counts binary, logs binary, docs binary, places binary, times binary, ids array<long>, held array<boolean>, sizes array<long>"
_VALUES = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("vocabulary", pa.int64()), ("counts", pa.binary()), ("logs", pa.binary())] + [_BLOCKS.field(c) for c in ("docs", "places", "times", "ids", "held", "sizes")])


def _score(path: str):
    """Over rows sorted by bucket: for each block's words the counts in all blocks and the marginals."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = lattice(path)
        for (bucket,), rows in grouped(batches, 1):
            out: dict[str, list] = {c: [] for c in _VALUES.names}
            count: dict[bytes, int] = {}
            places = []
            for r in rows:
                if r["words"] is not None:
                    spots = []
                    for word, c in zip(r["words"].split(b"\n"), np.frombuffer(r["counts"], "<u4").tolist(), strict=True):
                        count[word] = count.get(word, 0) + c
                        spots.append(word)
                    places.append(spots)
            place = {word: i for i, word in enumerate(count)}
            total = np.fromiter(count.values(), "<u8", len(count))
            logs = np.array([model.log_probability(word.decode("utf-8", "replace")) for word in count], "<f4")
            # the words seen in training are counted once, in a bucket's first row
            known, at = int((total > 0).sum()), 0
            for r in rows:
                if r["words"] is None:
                    made = (r["block"], None, 0, None, None, *(r[c] for c in ("docs", "places", "times", "ids", "held", "sizes")))
                else:
                    spot = np.fromiter((place[w] for w in places[at]), np.int64, len(places[at]))
                    made = (r["block"], bucket, known, total[spot].tobytes(), logs[spot].tobytes(), None, None, None, None, None, None)
                    known, at = 0, at + 1
                for column, v in zip(out, made, strict=True):
                    out[column].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in _VALUES], schema=_VALUES)

    return run


SCORES = "doc_id long, held_out boolean, n_words long, log_base double, known_words long, log_model double, lattice_score double, vocabulary long"


def _gather(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows sorted by block: one row a document."""
    for _, rows in grouped(batches, 1):
        meta = next(r for r in rows if r["ids"] is not None)
        found = sorted((r for r in rows if r["counts"] is not None), key=lambda r: r["bucket"])
        c = np.concatenate([np.frombuffer(r["counts"], "<u8") for r in found] or [np.zeros(0)]).astype(float)
        log = np.concatenate([np.frombuffer(r["logs"], "<f4") for r in found] or [np.zeros(0)]).astype(float) / math.log(10)
        place, doc, times = (np.frombuffer(meta[k], t) for k, t in (("places", "<u4"), ("docs", "<u2"), ("times", "<u4")))
        per_doc = lambda value: np.bincount(doc, value[place] * times, len(meta["ids"]))
        known = c > 0
        vocabulary = [sum(r["vocabulary"] for r in rows)] + [0] * (len(meta["ids"]) - 1)
        columns = [
            pa.array(meta["ids"], pa.int64()),
            pa.array(meta["held"], pa.bool_()),
            pa.array(meta["sizes"], pa.int64()),
            pa.array(per_doc(np.log10(c + ADDED))),
            pa.array(np.rint(per_doc(known.astype(float))).astype(np.int64)),
            pa.array(per_doc(np.log10(c + PRIOR * (1 - END) * 10**log))),
            pa.array(per_doc(log + math.log10(1 - END))),
            pa.array(vocabulary, pa.int64()),
        ]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "n_words", "log_base", "known_words", "log_model", "lattice_score", "vocabulary"])


def score_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, lattice_score for every row of docs.

    path: a SentencePiece model file.
    """
    p = partitions(docs)
    rows = text_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(held_out(F.col(id_col)), F.lit(False)).alias("held"), F.col(text_col).cast("string").alias("text"))
    blocks = rows.mapInArrow(_blocks(p * BUCKETS_EACH), BLOCKS).repartitionById(p, F.col("bucket") % p).sortWithinPartitions("bucket")
    parts = blocks.mapInArrow(_score(path), VALUES).repartition(p, "block").sortWithinPartitions("block")
    table = settled(parts.mapInArrow(_gather, SCORES), "lm-sums")

    train = F.coalesce(F.sum(F.when(~F.col("held_out"), F.col("n_words") + 1)), F.lit(0))
    ends = F.count(F.when(~F.col("held_out"), 1))
    facts = table.agg(train.alias("n"), ends.alias("ends"), F.coalesce(F.sum("vocabulary"), F.lit(0)).alias("v")).first()
    n, end, v = facts["n"], facts["ends"], facts["v"] + (facts["ends"] > 0)
    own = F.col("n_words") + 1
    base_end, model_end = math.log10(end + ADDED), math.log10(end + PRIOR * END)
    return table.select(
        "doc_id",
        "held_out",
        own.alias("n_tokens"),
        (F.col("known_words") + int(end > 0)).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("log_base") + base_end - own * math.log10(n + ADDED * (v + 1))).alias("base_score"),
        (F.col("log_model") + model_end - own * math.log10(n + PRIOR)).alias("score"),
        (F.col("lattice_score") + math.log10(END)).alias("lattice_score"),
    )
