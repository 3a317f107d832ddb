"""Secrets by inferred grammar.

Labelled credentials of each format make a prefix tree; states whose next-symbol frequencies are
statistically compatible (Hoeffding's bound) are merged, children along with them, which leaves a
small probabilistic automaton per format (the ALERGIA scheme). Labels come from published formats
and, with `harvest`, from what fixed patterns find in the corpus itself: at most HARVEST strings a
kind, those of the least hashes.

Every candidate, a run of credential characters with a letter in it, is scored by each automaton's
likelihood against that of ordinary words. A credential may begin at the run's beginning or after a
separator in it, and end before one or at the run's end: hypotheses move along the run together, of
those in one state only the best lives on, and those that fall too low are given up, so a run takes
time linear in its length. The best finds that don't overlap count if their ratio is large enough.

Fixed patterns (an assignment to a telling name, an access key id, a long hexadecimal run) are
always found as well and never removed.

Defined results: null and empty texts have no finds; spans count code points, the end is exclusive;
repeated rows give repeated finds; finds of different kinds may overlap; of equally likely formats
the last by name counts.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import math
import random
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import per_text, text_batches

KINDS = ("assign", "access", "hex")


def _either(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_NAMES = "|".join(_either(w) for w in ("password", "passwd", "secret", "token", "api_?key"))
_ASSIGN = re.compile(rf"""(?:{_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")
#: A candidate: a maximal run of at least MIN_CANDIDATE characters; a credential in it has as many.
MIN_CANDIDATE = 20
_CANDIDATE = re.compile(rf"(?<![A-Za-z0-9+/_.-])[A-Za-z0-9+/_.-]{{{MIN_CANDIDATE},}}+")
_LETTER = re.compile(r"[A-Za-z]")
#: Characters after which a credential may begin, and before which one may end.
SEPARATORS = "/+_.-"
#: Log probabilities of characters in ordinary words: mostly small letters, the other classes rare; fixed values.
ORDINARY = {c: math.log(share / len(of)) for of, share in (("abcdefghijklmnopqrstuvwxyz", 0.90), ("0123456789", 0.05), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", 0.03), ("+/_-.=", 0.02)) for c in of}
ORDINARY_END = math.log(0.1)


class Automaton:
    """A probabilistic automaton: per state a map symbol -> (next state, log probability), and that of ending."""

    def __init__(self, moves: list[dict[str, tuple[int, float]]], ends: list[float]):
        self.moves, self.ends = moves, ends

    def log_likelihood(self, word: str, unseen: float) -> float:
        """Of a word; a symbol that the state never saw costs `unseen` and leaves the state as it is."""
        state, total = 0, 0.0
        for symbol in word:
            move = self.moves[state].get(symbol)
            if move is None:
                total += unseen
            else:
                state = move[0]
                total += move[1]
        return total + self.ends[state]


def infer(words: Iterable[str], alpha: float = 0.05) -> Automaton:
    """The automaton of a sample: prefix tree, then merging of compatible states in breadth-first order."""
    kids: list[dict[str, int]] = [{}]
    visits: list[int] = [0]
    stops: list[int] = [0]
    flows: list[dict[str, int]] = [{}]
    for word in words:
        state = 0
        visits[0] += 1
        for symbol in word:
            flows[state][symbol] = flows[state].get(symbol, 0) + 1
            if symbol not in kids[state]:
                kids[state][symbol] = len(kids)
                kids.append({})
                visits.append(0)
                stops.append(0)
                flows.append({})
            state = kids[state][symbol]
            visits[state] += 1
        stops[state] += 1
    slack = math.sqrt(0.5 * math.log(2 / alpha))

    def differ(f1: int, n1: int, f2: int, n2: int) -> bool:
        return abs(f1 / n1 - f2 / n2) > slack * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))

    def compatible(a: int, b: int) -> bool:
        todo = [(a, b)]
        while todo:
            p, q = todo.pop()
            if differ(stops[p], visits[p], stops[q], visits[q]):
                return False
            for symbol in flows[p].keys() | flows[q].keys():
                if differ(flows[p].get(symbol, 0), visits[p], flows[q].get(symbol, 0), visits[q]):
                    return False
                if symbol in kids[p] and symbol in kids[q]:
                    todo.append((kids[p][symbol], kids[q][symbol]))
        return True

    def likeness(known: int, state: int) -> float:
        """The log posterior that a state's counts come from a known one: by its visits and its smoothed frequencies."""
        total = visits[known] + 0.1 * 67
        fits = sum(n * math.log((flows[known].get(c, 0) + 0.1) / total) for c, n in flows[state].items())
        return math.log(visits[known]) + fits + stops[state] * math.log((stops[known] + 0.1) / total)

    def fold(into: int, tree: int) -> list[tuple[int, str]]:
        """Add a tree's counts to a state, and its children's to the state's; returns the edges that are new."""
        todo, new = [(into, tree)], []
        while todo:
            p, q = todo.pop()
            visits[p] += visits[q]
            stops[p] += stops[q]
            for symbol, n in flows[q].items():
                flows[p][symbol] = flows[p].get(symbol, 0) + n
                if symbol in kids[p]:
                    todo.append((kids[p][symbol], kids[q][symbol]))
                else:
                    kids[p][symbol] = kids[q][symbol]
                    new.append((p, symbol))
        return new

    settled, place = [0], {0}
    frontier = [(0, s) for s in sorted(kids[0])]
    while frontier:
        parent, symbol = frontier.pop(0)
        state = kids[parent][symbol]
        if state in place:
            continue
        # a rarely visited state is compatible with any other: it goes to the one that it resembles most
        near = [(likeness(known, state), -i) for i, known in enumerate(settled) if compatible(known, state)]
        if near:
            known = settled[-max(near)[1]]
            kids[parent][symbol] = known
            frontier += [edge for edge in sorted(fold(known, state)) if edge[0] in place]
        else:
            settled.append(state)
            place.add(state)
            frontier += [(state, s) for s in sorted(kids[state])]
    number = {s: i for i, s in enumerate(settled)}
    moves, ends = [], []
    for s in settled:
        moves.append({symbol: (number[kids[s][symbol]], math.log(n / visits[s])) for symbol, n in flows[s].items()})
        ends.append(math.log((stops[s] + 0.1) / (visits[s] + 0.1)))
    return Automaton(moves, ends)


#: Published formats: name, fixed beginning, characters of the rest, its length; fixed values.
_UPPER, _LOWER, _DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
FORMATS = (
    ("access_id", "AKIA", _UPPER + _DIGITS, (16,)),
    ("temporary_id", "ASIA", _UPPER + _DIGITS, (16,)),
    ("git_host", "ghp_", _UPPER + _LOWER + _DIGITS, (36,)),
    ("chat_bot", "xoxb-", _DIGITS + _LOWER + "-", (40, 48)),
    ("payment", "sk_live_", _UPPER + _LOWER + _DIGITS, (24, 32)),
    ("maps", "AIza", _UPPER + _LOWER + _DIGITS + "_-", (35,)),
    ("web_token", "eyJ", _UPPER + _LOWER + _DIGITS + "_-", (33, 60)),
    ("digest", "", _DIGITS + "abcdef", (20, 32, 40, 64)),
    ("repository", "glpat-", _UPPER + _LOWER + _DIGITS + "_-", (20,)),
    ("package", "npm_", _UPPER + _LOWER + _DIGITS, (36,)),
    ("mail_sender", "SG.", _UPPER + _LOWER + _DIGITS + "_-", (66,)),
    ("random", "", _UPPER + _LOWER + _DIGITS, (32, 40, 48)),
)


def labelled(per_format: int = 150, seed: int = 7) -> list[tuple[str, str]]:
    """(format, credential): a seeded sample of each published format."""
    draw = random.Random(seed)
    return [(name, head + "".join(draw.choices(rest, k=draw.choice(lengths)))) for name, head, rest, lengths in FORMATS for _ in range(per_format)]


def train(examples: Iterable[tuple[str, str]], alpha: float = 0.05) -> dict[str, Automaton]:
    """One automaton per label."""
    words: dict[str, list[str]] = {}
    for label, word in examples:
        words.setdefault(label, []).append(word)
    return {label: infer(words[label], alpha) for label in sorted(words)}


@functools.cache
def default_model() -> dict[str, Automaton]:
    return train(labelled())


#: What an unseen symbol costs, the least log likelihood ratio of a find, and the ratio at which a hypothesis is given up.
UNSEEN, THRESHOLD, GIVEN_UP = -15.0, 20.0, -12.0


def score(model: dict[str, Automaton], word: str) -> tuple[float, str]:
    """(log likelihood ratio against ordinary words, format) of the likeliest format of a whole word."""
    ordinary = sum(map(ORDINARY.__getitem__, word)) + ORDINARY_END
    return max((a.log_likelihood(word, UNSEEN) - ordinary, label) for label, a in model.items())


def scored(model: dict[str, Automaton], word: str, threshold: float = THRESHOLD) -> list[tuple[int, int, str, float]]:
    """(start, end, format, ratio) of the credentials within a run, none overlapping, by start."""
    found: list[tuple[float, int, int, str]] = []
    n = len(word)
    for label, automaton in model.items():
        moves, ends = automaton.moves, automaton.ends
        live: dict[int, tuple[float, int]] = {}  # state -> (ratio so far, minus the start)
        for i, c in enumerate(word):
            if (i == 0 or word[i - 1] in SEPARATORS) and n - i >= MIN_CANDIDATE:
                live[0] = max(live.get(0, (0.0, -i)), (0.0, -i))
            if not live:
                continue
            step: dict[int, tuple[float, int]] = {}
            usual = ORDINARY[c]
            for state, (ratio, start) in live.items():
                move = moves[state].get(c)
                into, ratio = (state, ratio + UNSEEN - usual) if move is None else (move[0], ratio + move[1] - usual)
                if ratio > GIVEN_UP and (into not in step or step[into] < (ratio, start)):
                    step[into] = (ratio, start)
            live = step
            if i + 1 == n or word[i + 1] in SEPARATORS:
                for state, (ratio, start) in live.items():
                    total = ratio + ends[state] - ORDINARY_END
                    if total >= threshold and i + 1 + start >= MIN_CANDIDATE:
                        found.append((total, -start, i + 1, label))
    taken: list[tuple[int, int, str, float]] = []
    starts: list[int] = []
    for total, s, e, label in sorted(found, key=lambda f: (-f[0], f[1], f[2])):
        at = bisect.bisect_left(starts, e)
        if not (at and taken[at - 1][1] > s):
            starts.insert(at, s)
            taken.insert(at, (s, e, label, total))
    return taken


def base_finds(text: str, candidates: list[tuple[int, int]]) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns. Access keys and hexadecimal runs lie within candidates."""
    out = []
    if "=" in text or ":" in text:
        out += [(*m.span(), "assign") for m in _ASSIGN.finditer(text) if len(m[1]) >= 6]
    for s, e in candidates:
        out += [(*m.span(), "access") for m in _ACCESS.finditer(text, s, e) if m.end() - m.start() >= 20]
        out += [(*m.span(), "hex") for m in _HEX.finditer(text, s, e) if m.end() - m.start() >= 24]
    return out


def find(text: str, model: dict[str, Automaton], threshold: float = THRESHOLD) -> list[tuple[int, int, str, bool, float]]:
    """(start, end, kind, from a fixed pattern, score) by start, then kind as listed, then format.

    A credential that a fixed pattern has found gives that find its score; others are finds of their own.
    """
    candidates = [m.span() for m in _CANDIDATE.finditer(text)]
    order = {k: i for i, k in enumerate(KINDS)}
    base = base_finds(text, candidates)
    by_kind = {kind: sorted((s, e) for s, e, k in base if k == kind) for kind in KINDS}  # disjoint within a kind
    best: dict[tuple[int, int, str], float] = {}
    out: list[tuple[int, int, str, bool, float]] = []
    for begin, stop in candidates:
        if not _LETTER.search(text, begin, stop):
            continue
        for s, e, label, ratio in scored(model, text[begin:stop], threshold):
            s, e, known = s + begin, e + begin, False
            for kind, spans in by_kind.items():
                i = bisect.bisect_left(spans, (e, 0)) - 1
                while i >= 0 and spans[i][1] > s:
                    best[*spans[i], kind] = max(ratio, best.get((*spans[i], kind), 0.0))
                    known, i = True, i - 1
            if not known:
                out.append((s, e, label, False, ratio))
    out += [(s, e, kind, True, best.get((s, e, kind), 0.0)) for s, e, kind in base]
    return sorted(out, key=lambda f: (f[0], order.get(f[2], len(order)), f[2]))


#: Labelled credentials that are taken from the corpus: at most so many a kind.
HARVEST = 200


def harvest(docs: DataFrame, bound: int = HARVEST, text_col: str = "text") -> list[tuple[str, str]]:
    """(kind, credential) of fixed patterns' finds, for each kind the `bound` ones with the least hashes.

    All texts are read; a task and the driver only see the bounded sample. Assigned values count if
    they have a digit and a letter and are as long as a candidate.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[str, dict[str, str]] = {kind: {} for kind in KINDS}  # kind -> hash -> credential
        for batch in batches:
            for text in batch.column(0).to_pylist():
                for s, e, kind in base_finds(text or "", [m.span() for m in _CANDIDATE.finditer(text or "")]):
                    word = _ASSIGN.match(text, s)[1] if kind == "assign" else text[s:e]
                    if kind != "assign" or len(word) >= MIN_CANDIDATE and any(map(str.isdigit, word)) and _LETTER.search(word):
                        kept[kind][hashlib.sha1(word.encode()).hexdigest()] = word
                for kind, words in kept.items():
                    if len(words) > 4 * bound:
                        kept[kind] = {h: words[h] for h in sorted(words)[:bound]}
        rows = [(kind, h, words[h]) for kind, words in kept.items() for h in sorted(words)[:bound]]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in (zip(*rows, strict=True) if rows else ((), (), ()))], names=["kind", "h", "word"])

    found = text_batches(docs).select(F.col(text_col).cast("string")).mapInArrow(run, "kind string, h string, word string").distinct()
    nth = F.row_number().over(Window.partitionBy("kind").orderBy("h"))
    return sorted((f"found_{r['kind']}", r["word"]) for r in found.withColumn("nth", nth).where(F.col("nth") <= bound).collect())


FINDS = "array<struct<kind:string,start:int,end:int,base:boolean,score:double>>"
_FINDS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("score", pa.float64())]))


def scan_secrets(docs: DataFrame, model: dict[str, Automaton] | None = None, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, finds of every whole text. One pass, no shuffle; the model has a few hundred states."""
    model = default_model() if model is None else model

    def one(text: str) -> tuple:
        return ([{"kind": k, "start": s, "end": e, "base": b, "score": r} for s, e, k, b, r in find(text, model, threshold)],)

    rows = text_batches(docs).select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    out = rows.mapInArrow(per_text(one, ["finds"], [_FINDS]), f"_id {rows.schema[0].dataType.simpleString()}, finds {FINDS}")
    return out.withColumnRenamed("_id", id_col)
