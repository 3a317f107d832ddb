"""Operators across documents: archives, fingerprints, language model, mixing, joins, passages."""

from __future__ import annotations

import gzip
import hashlib
import itertools
import math
import os
import random
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from srcgraph.llm import common, compact_windows, fingerprint, lattice_lm, mixing, prefix_join, warc
from srcgraph.llm.common import components, sliced

SCHEMA = "doc_id long, text string, source string"


def prose(draw, n, words=None):
    return " ".join(draw.choice(words) if words else "".join(draw.choices("abcdefghijklmnop", k=draw.randint(2, 9))) for _ in range(n))


# -- archives
def test_archives_round_trip(spark):
    big = "<p>" + "x" * 1500
    pages = [(1, "http://a", big), (2, "http://b", big), (3, "http://c\nd", "small"), (4, None, "small"), (5, "u", None), (6, "é", "ü" * 700), (2, "http://b", big), (None, "n", big)]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("salt", F.lit(1))
    rows = sorted(warc.archive_round_trip(frame).collect(), key=lambda r: (r["page_id"] is None, r["page_id"] or 0))
    assert [(r["page_id"], r["record_type"], r["refers_to"]) for r in rows] == [(1, "revisit", 2), (2, "response", None), (2, "response", None), (3, "response", None), (4, "response", None), (5, "response", None), (6, "response", None), (None, "revisit", 2)]
    for r in rows:
        html = next((h or "") for i, _, h in pages if i == r["page_id"])
        assert r["payload_bytes"] == len(html.encode())
        assert r["payload_digest"] == hashlib.sha1(html.encode()).hexdigest()
    assert warc.archive_round_trip(frame.limit(0)).count() == 0


def test_archives_are_closed_at_a_size(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 3000)
    monkeypatch.setattr(warc, "READ_BYTES", 2500)
    draw = random.Random(16)
    pages = [(i, f"u{i}", prose(draw, draw.choice([5, 400]))) for i in range(60)] + [(99, "big", prose(draw, 2000))]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(2)
    folder = f"file://{tmp_path}/w"
    out = warc.archive_round_trip(frame, folder).collect()
    assert {(r["page_id"], r["payload_digest"]) for r in out} == {(i, hashlib.sha1(h.encode()).hexdigest()) for i, _, h in pages}
    assert len(os.listdir(f"{tmp_path}/w")) > 10


def test_records_parse_and_ranges_coalesce():
    data = gzip.decompress(gzip.compress(warc.record(7, "http://x", b"body\r\n\r\nmore", hashlib.sha1(b"body\r\n\r\nmore").hexdigest(), None)))
    fields, http, payload = warc.parse(data)
    assert (fields["WARC-Type"], fields["Page-ID"], http["Content-Length"], payload) == ("response", "7", "12", b"body\r\n\r\nmore")
    rows = [("a", 0, 10), ("a", 10, 5), ("a", 15 + warc.GAP_BYTES + 1, 4), ("b", 0, 3)]
    assert [(x[0], x[1], x[2], len(x[3])) for x in warc.coalesced(rows)] == [("a", 0, 15, 2), ("a", 15 + warc.GAP_BYTES + 1, 15 + warc.GAP_BYTES + 5, 1), ("b", 0, 3, 1)]


# -- fingerprints
def plain_rank(window):
    counts = Counter(window)
    entropy = 6 - sum(c * math.log2(c) for c in counts.values()) / 64
    return 1000 * entropy / 6


def test_entropies_follow_the_windows():
    draw = random.Random(2)
    data = np.frombuffer("".join(draw.choices("abc def", k=400)).encode(), np.uint8)
    got = fingerprint.ranks(data)
    for i in range(0, len(got), 7):
        e = plain_rank(data[i : i + 64].tobytes())
        want = 1000 - abs(e - fingerprint.USUAL)
        assert got[i] == fingerprint._NONE if e < fingerprint.LEAST else abs(got[i] - want) <= 1.5


def test_digests_don_t_depend_on_neighbours():
    draw = random.Random(4)
    texts = [prose(draw, n) for n in (5, 40, 300, 3)] + ["", "é", "a" * 500]
    alone = [fingerprint.digests(d, o)[0] for t in texts for _, _, d, o in sliced(pa.array([t]))]
    together = [x for _, _, d, o in sliced(pa.array(texts)) for x in fingerprint.digests(d, o)]
    assert all(np.array_equal(a, b) for a, b in zip(alone, together, strict=True))
    assert np.array_equal(fingerprint.parsed(fingerprint.text_form(alone[2])), alone[2])
    assert fingerprint.likeness(alone[2], alone[2]) == 1.0
    assert fingerprint.likeness(alone[2], alone[1]) < 0.2
    assert fingerprint.likeness(alone[4], alone[2]) == 0.0


def test_neighbours(spark):
    draw = random.Random(6)
    rows = [(i * 3, prose(draw, draw.randint(0, 300)), "s") for i in range(60)] + [(5, None, "s"), (None, "last " * 50, "s"), (9, "twice", "s"), (9, "twice again", "s")]
    rows = [r for r in rows if r[0] != 9 or r[1].startswith("twice")]
    out = fingerprint.fingerprint_neighbours(spark.createDataFrame(rows, SCHEMA).withColumn("block", F.lit(1))).collect()
    assert len(out) == len(rows)
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] is not None, r[1] or ""))
    wanted = Counter()
    for r, following in zip(order, order[1:] + order[:1], strict=True):
        text = r[1] or ""
        wanted[(r[0], len(text), hashlib.sha256(fingerprint.edited(text, following[1] or "").encode()).hexdigest())] += 1
    assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in out) == wanted
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in out)
    long = [r for r in out if r["n_chars"] > 800]
    assert np.mean([r["near_edited"] for r in long]) > 0.5 > 0.1 > np.mean([r["near_next"] for r in long])
    assert fingerprint.fingerprint_neighbours(spark.createDataFrame([], SCHEMA)).count() == 0
    only = fingerprint.fingerprint_neighbours(spark.createDataFrame([(1, "one text alone", "s")], SCHEMA)).collect()
    assert len(only) == 1 and only[0]["near_next"] == 1.0


def plain_digest(text):
    """Feature by feature: windows ranked one by one, runs of neighbours compared one by one."""
    data = text.encode()
    n, windows = fingerprint.WINDOW, max(0, len(data) - fingerprint.WINDOW + 1)
    ranks = fingerprint.ranks(np.frombuffer(data, np.uint8)) if windows else []
    wins = Counter()
    for start in range(windows):  # the run of the windows from here, cut at the text's end
        run = [(int(ranks[i]), i) for i in range(start, min(start + fingerprint.RUN, windows))]
        rank, best = min(run)
        if rank < fingerprint._NONE:
            wins[best] += 1
    need = min(fingerprint.POPULAR, sum(wins.values()))
    chosen = [i for i in sorted(wins) if wins[i] >= need]
    hashed = []
    for i in chosen:
        h = np.zeros(1, np.uint64)
        for k in range(0, n, 8):
            h = fingerprint.mix((h ^ np.frombuffer(data[i + k : i + k + 8], "<u8")) + np.uint64(0x9E3779B97F4A7C15))
        hashed.append(int(h[0]))
    if not hashed and data:
        hashed = [int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little")]
    filters = []
    for k in range(0, len(hashed), fingerprint.FILTER_FEATURES):
        bits = np.zeros(fingerprint.FILTER_BITS, bool)
        for h in hashed[k : k + fingerprint.FILTER_FEATURES]:
            for b in range(fingerprint.BITS):
                bits[h >> (11 * b) & (fingerprint.FILTER_BITS - 1)] = True
        filters.append(np.packbits(bits))
    return filters


def plain_likeness(a, b):
    if len(a) == len(b) and all(np.array_equal(x, y) for x, y in zip(a, b, strict=True)):
        return 1.0
    if not len(a) or not len(b):
        return 0.0

    def towards(xs, ys):
        total = weight = 0.0
        for x in xs:
            nx, best = int(np.unpackbits(x).sum()), -9.0
            for y in ys:
                ny, common = int(np.unpackbits(y).sum()), int(np.unpackbits(x & y).sum())
                chance = nx * ny / fingerprint.FILTER_BITS
                best = max(best, (common - chance) / max(min(nx, ny) - chance, 1e-9))
            total += nx * min(1.0, max(0.0, (best - fingerprint.CUTOFF) / (1 - fingerprint.CUTOFF)))
            weight += nx
        return total / weight

    return min(towards(a, b), towards(b, a)) if len(a) == len(b) else towards(a, b) if len(a) < len(b) else towards(b, a)


def test_digests_and_likeness_are_those_of_brute_force():
    draw = random.Random(14)
    texts = [prose(draw, n) for n in (2, 30, 200, 900)] + ["", "a" * 300, "ab" * 90 + prose(draw, 40)]
    texts += [texts[3][: len(texts[3]) // 2] + prose(draw, 300), texts[2] + " tail"]
    made = [x for _, _, d, o in sliced(pa.array(texts), 700) for x in fingerprint.digests(d, o)]
    plain = [plain_digest(t) for t in texts]
    for a, b in zip(made, plain, strict=True):
        assert len(a) == len(b) and all(np.array_equal(x, y) for x, y in zip(a, b, strict=True))
    for (a, x), (b, y) in itertools.combinations(zip(made, plain, strict=True), 2):
        assert fingerprint.likeness(a, b) == pytest.approx(plain_likeness(x, y))
        assert fingerprint.likeness(a, b) == pytest.approx(fingerprint.likeness(b, a))


def test_a_text_longer_than_a_slice_has_its_digest():
    draw = random.Random(15)
    long = prose(draw, 3000) * 80
    assert len(long) > common.SLICE_BYTES
    column = pa.array(["short text", long, "another"])
    made = [x for _, _, d, o in sliced(column) for x in fingerprint.digests(d, o)]
    alone = [x for t in column.to_pylist() for _, _, d, o in sliced(pa.array([t])) for x in fingerprint.digests(d, o)]
    assert all(np.array_equal(a, b) for a, b in zip(made, alone, strict=True))


# -- language model
def test_marginal_is_the_sum_over_segmentations():
    pieces = {"_": -2.0, "a": -1.0, "b": -1.5, "ab": -0.7, "_a": -1.2, "ba": -2.2, "aba": -3.0}
    model = lattice_lm.Lattice(pieces, "_")
    for word in ("a", "ab", "abab", "ba"):
        text, total = "_" + word, 0.0
        for cuts in itertools.product([False, True], repeat=len(text) - 1):
            bounds = [0, *(i + 1 for i, c in enumerate(cuts) if c), len(text)]
            parts = [text[a:b] for a, b in itertools.pairwise(bounds)]
            if all(p in pieces for p in parts):
                total += math.exp(sum(pieces[p] for p in parts)) * lattice_lm.MORE ** (len(parts) - 1) * (1 - lattice_lm.MORE)
        assert model.log_probability(word) == pytest.approx(math.log(total))


def test_scores(spark):
    draw = random.Random(8)
    words = ["".join(draw.choices("abcdefg", k=draw.randint(1, 6))) for _ in range(300)]
    rows = [(i, prose(draw, draw.randint(0, 80), words).upper() if i % 3 else prose(draw, 30, words) + f" only{i}", "s") for i in range(200)] + [(7, None, "s"), (8, "日本 " * 5, "s"), (8, "", "s")]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    out = lattice_lm.score_documents(docs, public_tokenizers.path("piece_bpe_32k.model")).collect()
    tokens = lambda t: [*(t or "").encode().lower().split(), "END"]
    held = lambda i: zlib.crc32(str(i).encode()) % 10 == 0
    c = Counter(w for i, t, _ in rows if not held(i) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    want = Counter()
    for i, t, _ in rows:
        base = sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens(t))
        want[(i, held(i), len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), n, round(base, 6))] += 1
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in out) == want
    # the score by brute force: every segmentation of every word, and the learnt words
    model = lattice_lm.lattice(public_tokenizers.path("piece_bpe_32k.model"))

    def paths(text):
        for k in range(1, len(text) + 1):
            cost = model.pieces.get(text[:k], model.rare * len(text.encode()[: len(text[0].encode())]) if k == 1 else None)
            if cost is not None:
                yield from [math.exp(cost) * (1 - lattice_lm.MORE)] if k == len(text) else [math.exp(cost) * lattice_lm.MORE * rest for rest in paths(text[k:])]

    mean = {w: (1 - lattice_lm.END) * sum(paths("▁" + w.decode())) for w in {w for _, t, _ in rows for w in tokens(t)[:-1]}} | {"END": lattice_lm.END}
    want = sorted((i, sum(math.log10((c[w] + lattice_lm.PRIOR * mean[w]) / (n + lattice_lm.PRIOR)) for w in tokens(t)), sum(math.log10(mean[w]) for w in tokens(t))) for i, t, _ in rows)
    got = sorted((r["doc_id"], r["score"], r["lattice_score"]) for r in out)
    assert [x[0] for x in got] == [x[0] for x in want]
    assert np.array(got) == pytest.approx(np.array(want), rel=1e-5)
    assert lattice_lm.score_documents(docs.limit(0), public_tokenizers.path("piece_bpe_32k.model")).count() == 0


def test_scores_of_a_unigram_model_are_used_as_they_are(monkeypatch):
    class Model:
        pieces = [("<unk>", 0.0), ("▁a", -1.5), ("b", -0.25)]

        def __init__(self, model_file):
            pass

        get_piece_size = lambda self: len(self.pieces)
        id_to_piece = lambda self, i: self.pieces[i][0]
        get_score = lambda self, i: self.pieces[i][1]
        is_unknown = lambda self, i: i == 0
        is_control = is_byte = is_unused = lambda self, i: False

    monkeypatch.setattr("sentencepiece.SentencePieceProcessor", Model)
    assert lattice_lm.lattice.__wrapped__("any").pieces == {"▁a": -1.5, "b": -0.25}


def test_a_very_long_word_takes_linear_time():
    model = lattice_lm.lattice(public_tokenizers.path("piece_bpe_32k.model"))
    began = time.perf_counter()
    assert model.log_probability("ab1/" * 25_000) < -100_000
    assert time.perf_counter() - began < 30


# -- mixing
def plain_targets(sizes, weights):
    """Shares by weight, cut at twice the size, the excess dealt again until none is above."""
    total = 1.5 * sum(sizes)
    full: set[int] = set()
    while True:
        free = [i for i in range(len(sizes)) if i not in full]
        rest = total - sum(2 * sizes[i] for i in full)
        share = {i: rest * weights[i] / sum(weights[j] for j in free) for i in free}
        above = {i for i in free if share[i] > 2 * sizes[i]}
        if not above:
            return [2 * sizes[i] if i in full else share[i] for i in range(len(sizes))]
        full |= above


@settings(max_examples=15, deadline=None)
@given(st.lists(st.integers(0, 500), min_size=1, max_size=9))
def test_targets(spark, sizes):
    names = [f"s{i}" for i in range(len(sizes) - 1)] + [None]
    frame = spark.createDataFrame(list(zip(names, sizes, [1] * len(sizes), strict=True)), "source string, source_size long, n_docs long")
    got = {r["source"]: r["target"] for r in mixing.targets(frame).collect()}
    want = plain_targets(sizes, [(3, 1, 2)[i % 3] for i in range(len(sizes))])
    assert [got[n] for n in names] == pytest.approx(want)


def test_mix(spark):
    draw = random.Random(9)
    rows = [(i, " ".join(["w"] * draw.randint(0, 60)), draw.choice(["a", "a", "a", "b", "c", None])) for i in range(400)] + [(1, None, "b"), (2, " x ", "c")]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("bucket", F.lit(0))
    quality = spark.createDataFrame([(i, 2.0 if i % 2 else 0.5) for i in range(0, 300)] + [(3, None)], "doc_id long, weight double")
    held, mixing.BUCKET_ROWS = mixing.BUCKET_ROWS, 20
    try:
        out = mixing.mix_sources(docs, quality).collect()
        again = mixing.mix_sources(docs.repartition(7), quality).collect()
        copies = mixing.mix_copies(docs, quality)
        assert copies.columns == docs.columns
        assert 0.9 < copies.count() / sum(r["taken"] / r["size"] for r in out if r["size"]) < 1.1
    finally:
        mixing.BUCKET_ROWS = held
    assert sorted(map(str, out)) == sorted(map(str, again))
    assert Counter((r["doc_id"], r["size"]) for r in out) == Counter((i, len((t or "").split())) for i, t, _ in rows)
    for source in ("a", "b", "c", None):
        own = [r for r in out if r["source"] == source]
        assert sum(r["size"] for r in own) == own[0]["source_size"]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 1
        assert all(r["taken"] <= 2 * r["size"] for r in own)
    assert mixing.mix_sources(docs.limit(0)).count() == 0


def test_extreme_weights(spark):
    """Taken by ascending -ln(u) / weight, whatever the weights; ranges stay small."""
    rows = [(i, "w " * (i % 7), "a" if i % 3 else "b") for i in range(3000)]
    weights = {i: (1000.0, 0.001, 1.0)[i % 11 % 3] for i in range(3000)}
    docs = spark.createDataFrame(rows, SCHEMA)
    out = mixing.mix_sources(docs, spark.createDataFrame(list(weights.items()), "doc_id long, weight double")).collect()
    for source in ("a", "b"):
        own = [r for r in out if r["source"] == source]
        u = lambda i: (int(hashlib.md5(f"mix:{i}".encode()).hexdigest()[:13], 16) + 0.5) / (1 << 52)
        size, target = own[0]["source_size"], own[0]["target"]
        left = round(target - target // size * size)
        want = {}
        for r in sorted(own, key=lambda r: -math.log(u(r["doc_id"])) / weights[r["doc_id"]]):
            want[r["doc_id"]] = int(target // size) * r["size"] + min(r["size"], max(0, left))
            left -= r["size"]
        assert {r["doc_id"]: r["taken"] for r in own} == want


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Conf:
        get = staticmethod(lambda *a: None)

    class Session:
        conf = Conf

        class sparkContext:  # noqa: N801
            master = "spark://somewhere:7077"

    with pytest.raises(ValueError, match="checkpoint"):
        common.shared_dir(Session)


def test_settled_tables_can_be_deleted(spark, tmp_path):
    table = common.settled(spark.range(5), "gone")
    path = table._settled.removeprefix("file://")
    assert os.path.isdir(path)
    common.discard(table)
    assert not os.path.isdir(path)


# -- joins
def plain_components(rows, n, percent):
    sets = []
    for _, text, _ in rows:
        w = (text or "").encode().lower().split()
        sets.append(frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else []))
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
            root[top(i)] = top(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[top(i)] = min(least.get(top(i), r[0]), r[0])
    return Counter((r[0], len(sets[i]), least.get(top(i), r[0])) for i, r in enumerate(rows))


def family(draw, words, size, copies):
    base = prose(draw, size, words).split()
    for _ in range(copies):
        text = list(base)
        for _ in range(draw.randint(0, 4)):
            text[draw.randrange(len(text))] = draw.choice(words)
        yield " ".join(text)


@pytest.mark.parametrize(("n", "percent", "seed"), [(4, 85, 1), (5, 80, 2), (1, 100, 3), (2, 50, 4)])
def test_join_agrees_with_all_pairs(spark, n, percent, seed):
    draw = random.Random(seed)
    words = ["".join(draw.choices("abcdefgh", k=draw.randint(1, 4))) for _ in range(60)]
    texts = [t for _ in range(14) for t in family(draw, words, draw.randint(4, 60), draw.randint(1, 9))]
    texts += [prose(draw, draw.randint(0, 5), words) for _ in range(30)] + [texts[0].upper(), texts[0], None, "", " \n"]
    rows = [(i, t, "s") for i, t in enumerate(texts)]
    draw.shuffle(rows)
    rows += [rows[0], (None, texts[0], "s"), (None, "alone and without a number", "s")]
    held = prefix_join.UNIT, prefix_join.CENTRES, prefix_join.HALF
    prefix_join.UNIT, prefix_join.CENTRES, prefix_join.HALF = 3, 1, 4
    try:
        out = prefix_join.jaccard_components(spark.createDataFrame(rows, SCHEMA).repartition(6).withColumn("key", F.lit("k")), n, percent).collect()
    finally:
        prefix_join.UNIT, prefix_join.CENTRES, prefix_join.HALF = held
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in out) == plain_components(rows, n, percent)


def test_join_of_nothing(spark):
    assert prefix_join.jaccard_components(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("chunk", [7, 200_000])
@pytest.mark.parametrize("shape", ["path", "star", "random", "none"])
def test_components(spark, shape, chunk, monkeypatch):
    monkeypatch.setattr(common, "CHUNK", chunk)
    draw = random.Random(11)
    edges = {"path": [(i, i + 1) for i in range(60)], "star": [(99, i) for i in range(40)], "random": [(draw.randrange(80), draw.randrange(80)) for _ in range(60)], "none": [(3, 3)]}[shape]
    draw.shuffle(edges)
    out = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long").repartition(9)).collect()}
    root = {i: i for e in edges for i in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            m = min(root[a], root[b])
            changed |= root[a] != m or root[b] != m
            root[a] = root[b] = m
    assert out == {i: r for i, r in root.items() if i != r}


# -- passages
@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 40), min_size=0, max_size=60), st.integers(2, 8))
def test_compact_windows_are_those_of_the_definition(values, t):
    v = np.array([0, *values, 0], np.uint64)
    left, place, right = compact_windows.compact_windows(v, t)
    got = set(zip(left.tolist(), place.tolist(), right.tolist(), strict=True))
    want, latest = set(), {}
    for c in range(1, len(v) - 1):
        a, b = c, c
        while v[a - 1] >= v[c]:
            a -= 1
        while v[b + 1] >= v[c]:
            b += 1
        if b - a + 1 >= t:
            if c - latest.get((a, b), -100) > compact_windows.SHIFT:
                want.add((a, c, b))
            latest[a, b] = c
    assert got == want


def test_equal_passages_are_found_among_documents_that_share_less(spark):
    draw = random.Random(5)
    passage = prose(draw, 51).split()
    texts = {0: " ".join(passage) + " " + prose(draw, 20), 999: prose(draw, 20) + " " + " ".join(passage)}
    for i in range(1, 200):  # part of it, in texts of their own
        s = draw.randrange(51 - 24)
        texts[i] = prose(draw, 60) + " " + " ".join(passage[s : s + draw.randint(24, 40)]) + " " + prose(draw, 60)
    rows = [(i, t, "s") for i, t in texts.items()]
    out = {r["doc_id"]: r for r in compact_windows.repeated_passages(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert set(out) == {0, 999}
    assert out[0]["spans"] == "0:51" and out[999]["spans"] == "20:71" and out[999]["class_id"] == 0


def test_class_size_counts_all_documents_of_a_passage(spark):
    draw = random.Random(6)
    passage = prose(draw, 60)
    rows = [(i, prose(draw, 40) + " " + passage + " " + prose(draw, 40), "s") for i in range(100)] + [(200, prose(draw, 90), "s")]
    out = compact_windows.repeated_passages(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {(r["doc_id"], r["class_id"], r["class_size"]) for r in out} == {(i, 0, 100) for i in range(100)}
    assert "n_links" not in out[0]


def test_passages(spark):
    draw = random.Random(12)
    passage = prose(draw, 60)
    near = passage.split()
    near[30] = "changed"
    texts = [prose(draw, draw.randint(60, 200)) for _ in range(40)]
    texts[3] = prose(draw, 50) + " " + passage + " " + prose(draw, 80)
    texts[9] = passage.upper() + " " + prose(draw, 30)
    texts[20] = prose(draw, 90) + "\n" + " ".join(near)
    texts[21] = prose(draw, 90) + " " + " ".join(passage.split()[:30]) + " " + prose(draw, 40)
    texts[30] = texts[31] = prose(draw, 70)
    texts[34], texts[35] = prose(draw, 40) + " again" * 70 + " " + prose(draw, 9), prose(draw, 20) + " again" * 60
    rows = [(i, t, "s") for i, t in enumerate(texts)] + [(50, None, "s"), (51, "", "s"), (None, texts[3], "s"), (3, texts[3], "s")]
    out = {r["doc_id"]: r for r in compact_windows.repeated_passages(spark.createDataFrame(rows, SCHEMA).repartition(5).withColumn("a", F.lit(1))).collect()}
    assert set(out) == {3, 9, 20, 30, 31, 34, 35}
    assert out[3]["class_id"] == out[9]["class_id"] == out[20]["class_id"] == 3
    assert out[31]["class_id"] == 30 and out[31]["spans"] == "0:70"
    assert "50:110" in out[3]["spans"] and out[9]["spans"].startswith("0:60")
    assert compact_windows.repeated_passages(spark.createDataFrame([], SCHEMA)).count() == 0


def test_near_passages_are_found_as_brute_force_finds_them(spark):
    draw = random.Random(21)
    rows, family_of, n = [], {}, 0
    for f in range(60):
        passage = prose(draw, 100).split()
        for _ in range(4):
            own = list(passage)
            for _ in range(draw.randint(0, 2)):
                own[draw.randrange(len(own))] = "changed" + str(draw.randrange(999))
            text = prose(draw, draw.randint(10, 80)) + " " + " ".join(own) + " " + prose(draw, draw.randint(10, 80))
            rows.append((n, text, "s"))
            family_of[n] = f
            n += 1
    rows += [(n + i, prose(draw, 150), "s") for i in range(100)]
    grams = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t, _ in rows}
    want = {i for i in family_of for j in family_of if i != j and family_of[i] == family_of[j] and len(grams[i] & grams[j]) >= 0.8 * 96}
    out = {r["doc_id"]: r for r in compact_windows.repeated_passages(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()}
    assert set(out) <= set(family_of)
    assert len(want & set(out)) >= 0.95 * len(want)
    whole = sum(len({out[i]["class_id"] for i in family_of if family_of[i] == f and i in out and i in want}) == 1 for f in range(60))
    assert whole >= 54


def test_near_passages_are_found_among_documents_that_share_one_half(spark):
    """40 pairs of a passage: half of it is the same in all, a changed word, and half that the pair alone has."""
    draw = random.Random(1)
    half = prose(draw, 25)
    rows = []
    for k in range(40):
        own = prose(draw, 32)
        rows += [(k + 40 * side, prose(draw, 60) + f" {half} changed{side} {own} " + prose(draw, 60), "s") for side in (0, 1)]
    out = {r["doc_id"]: r["class_id"] for r in compact_windows.repeated_passages(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(out[i] == i % 40 for i in out)
    assert len(out) >= 76


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 6), max_size=12))
def test_each_is_paired_with_each(sizes):
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1])).astype(np.int64)[: len(sizes)]
    i, j = compact_windows.each_with_each(starts, np.array(sizes, np.int64))
    want = [p for s, n in zip(starts.tolist(), sizes, strict=True) for p in itertools.combinations(range(s, s + n), 2)]
    assert sorted(zip(i.tolist(), j.tolist(), strict=True)) == want


def test_equal_windows_are_sent_a_few_times_only():
    draw = random.Random(3)
    passage = prose(draw, 120)
    texts = pa.array([prose(draw, 30) + " " + passage + " " + prose(draw, 30) for _ in range(400)])
    batch = pa.RecordBatch.from_arrays([pa.array(range(400)), texts], names=["doc_id", "text"])
    sent = [b for b in compact_windows._spread(4)([batch])]
    near = [compact_windows.together(b.column("near").to_pylist(), compact_windows._NEAR) for b in sent]
    alone = compact_windows.entries(np.arange(400), *next(sliced(texts))[2:])
    assert sum(len(e["values"]) for e in near) < 0.7 * len(alone["values"])
    found = compact_windows.unpack_pairs(x for b in sent for x in b.column("found").to_pylist())
    assert len(found) and (found[:, 0] < found[:, 1]).all()


@settings(max_examples=50, deadline=None)
@given(st.lists(st.tuples(*[st.integers(0, 1 << 31)] * 4), max_size=900))
def test_packed_pairs_come_back(rows):
    x = np.array([(a, a + b, b % 9, p + 50, p, p + 90, q + 50, q, q + 60) for a, b, p, q in rows], np.int64).reshape(-1, 9)
    back = compact_windows.unpack_pairs([compact_windows.pack_pairs(x)])
    assert sorted(map(tuple, back.tolist())) == sorted(map(tuple, x.tolist()))


def test_parts_that_compress_to_their_own_length_come_back():
    draw, types, ties = np.random.default_rng(0), {"a": "<i8", "x": "<u4"}, 0
    for _ in range(20_000):
        n = int(draw.integers(1, 60))
        x = {"a": np.cumsum(draw.integers(0, 1 << int(draw.integers(1, 40)), n)), "x": draw.integers(0, 1 << int(draw.integers(1, 32)), n).astype(np.uint32)}
        blob = compact_windows.pack(x, types)
        ties += len(blob) == 8 + 12 * n
        back = compact_windows.unpack(blob, types)
        assert all(np.array_equal(back[c], x[c]) for c in types)
    assert ties


def test_an_equal_run_is_found_at_any_shift():
    draw = np.random.default_rng(1)
    x = draw.integers(1, 1 << 31, 60).astype("<u4")
    y = np.concatenate([np.concatenate((x[:k], x[k + 1 : 40])) for k in range(1, 39)] * 3 + [x, x[:30]])
    at = compact_windows.occurrence(x, y, 0)
    assert np.array_equal(y[at : at + 60], x)
    assert compact_windows.occurrence(x, y[: at + 59], 0) is None
    assert compact_windows.occurrence(x[:0], y, 3) == 3


def test_a_very_long_text_has_its_passages(spark):
    draw = random.Random(30)
    passage = prose(draw, 80)
    rows = [(1, prose(draw, 200_000) + " " + passage + " " + prose(draw, 1000), "s"), (2, prose(draw, 30) + " " + passage, "s")]
    out = {r["doc_id"]: r["spans"] for r in compact_windows.repeated_passages(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert out == {1: "200000:200080", 2: "30:110"}


def test_rows_into_verification_grow_with_the_cluster(spark):
    """Near copies of one text: twice as many give about twice as many rows, and one component."""
    counts = []
    for m in (400, 800):
        draw = random.Random(40)
        base = prose(draw, 200).split()
        rows = []
        for i in range(m):
            own = list(base)
            for _ in range(2):
                own[draw.randrange(len(own))] = f"changed{i}"
            rows.append((i, " ".join(own), "s"))
        seen = []
        units = prefix_join._units
        try:
            prefix_join._units = lambda r, *a: (seen.append(r.count()), units(r, *a))[1]
            out = prefix_join.jaccard_components(spark.createDataFrame(rows, SCHEMA)).collect()
        finally:
            prefix_join._units = units
        assert {r["component_id"] for r in out} == {0}
        counts.append(sum(seen))
    assert counts[1] < 2.5 * counts[0] and counts[1] < 4 * 800
