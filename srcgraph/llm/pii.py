"""Personal data behind disguises, with offsets in the source text.

Plain e-mail addresses, IPv4 addresses, payment cards and phone numbers are found in the text as it
is. A transducer then rewrites the disguises: look-alike characters one for one, and `[at]`,
` dot `, spelled digits and invisible characters token by token, each output character keeping the
source interval it came from. What the same detectors find in the rewritten text is mapped back to
the source. Where only characters were rewritten, a find is added unless a plain find of its kind
holds all of it, so a name that begins with a look-alike is covered whole; where words were
rewritten, unless a find of its kind overlaps it.

A bare "at" counts before a known mail provider, before a domain with a spelled dot, and in capitals
after a small letter; "look at example.com" is no address.

Every scan is linear in the text: runs are consumed whole, an address is read from its @ outwards,
and finds are looked up among sorted ones.

Defined results: null and empty texts have no finds; spans count code points, the end is exclusive;
repeated rows give repeated finds; finds of different kinds may overlap.
"""

from __future__ import annotations

import bisect
import functools
import re
import unicodedata
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import per_text, text_batches

KINDS = ("email", "ip", "card", "phone")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

Span = tuple[int, int, int]  # place of the kind, start, end


def luhn(digits: str) -> bool:
    """Does the number pass the check-digit rule of payment cards?"""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def plain(text: str) -> list[Span]:
    """Finds in a text as it is, by kind, then start."""
    out: list[Span] = []
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((0, start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    if not _DIGIT.search(text):
        return out
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in m.groups()):
            out.append((1, *m.span()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append((2, *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                out.append((3, *m.span()))
    return out


#: Letters that look like ASCII ones, fixed values; forms that Unicode itself maps to ASCII come from a rule below.
LOOK_ALIKES = {
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "ο": "o", "α": "a", "ν": "v", "ι": "i", "ρ": "p",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ӏ": "l",
    "ı": "i", "ɡ": "g", "‐": "-", "‑": "-", "‒": "-", "–": "-", "。": ".", "․": ".",
}
#: Characters that are not seen, fixed values.
INVISIBLE = "­᠎​‌‍⁠﻿"
#: Spelled digits of the four languages of the corpus, fixed values.
SPELLED = {
    word: str(digit)
    for words in (
        "zero one two three four five six seven eight nine",
        "null eins zwei drei vier fünf sechs sieben acht neun",
        "zéro un deux trois quatre cinq six sept huit neuf",
        "cero uno dos tres cuatro cinco seis siete ocho nueve",
    )
    for digit, word in enumerate(words.split())
}


@functools.cache
def _table() -> tuple[dict[int, str], frozenset[str]]:
    """Translation of look-alikes to ASCII, and all of them with the invisible characters."""
    table = {ord(a): b for a, b in LOOK_ALIKES.items()}
    for point in range(0xA1, 0x20000):
        c = chr(point)
        if unicodedata.category(c) == "Nd":
            table[point] = str(unicodedata.digit(c))
        elif len(form := unicodedata.normalize("NFKC", c)) == 1 and "!" <= form <= "~":
            table[point] = form
    return table, frozenset(map(chr, table)) | frozenset(INVISIBLE)


SPELLED["oh"] = "0"
#: Words for the at sign and the dot, fixed values.
AT_WORDS, DOT_WORDS = "at|arroba", "dot|punto|punkt|point"
#: Endings that make a bare "at ... dot ..." an address, fixed values.
ENDINGS = "com org net edu gov mil int info biz name io co ai dev app me tv uk de fr es it eu us ca ch nl be pt se no dk fi pl ru cn jp in br au example test invalid localhost"

_WORDS = "|".join(sorted(SPELLED, key=len, reverse=True))
#: Mail providers before which a bare "at" makes an address, fixed values.
PROVIDERS = "gmail googlemail yahoo ymail hotmail outlook icloud aol gmx protonmail proton yandex"
_OPEN, _CLOSE = r"\s{0,3}[\[({<]\s{0,3}", r"\s{0,3}[\])}>]\s{0,3}"
_END = rf"(?:{ENDINGS.replace(' ', '|')})(?![A-Za-z0-9-])"
_GAP = r"(?:\s{1,3}|[_-])"  # around a bare word
_LABEL = r"[A-Za-z0-9]{1,63}"
_DOT = rf"(?:{_GAP}(?:{DOT_WORDS}){_GAP}|{_OPEN}(?:{DOT_WORDS}|\.){_CLOSE}|\s{{1,2}}\.\s{{0,2}}|\.)"
_BRACKETED_AT, _BRACKETED_DOT = rf"{_OPEN}(?:{AT_WORDS}|@){_CLOSE}", rf"{_OPEN}(?:{DOT_WORDS}|\.){_CLOSE}"
_DOMAIN_AHEAD = rf"{_LABEL}(?:-{_LABEL})*?(?:{_DOT}{_LABEL}){{0,4}}?{_DOT}{_END}"
#: By what a text has to hold for it: the alternatives of a token, in the order in which they are tried.
_PARTS = {
    "at": (
        # bracketed signs always count; bare ones if an address can follow
        ("open", _BRACKETED_AT),
        ("bare", rf"(?<=[A-Za-z0-9]){_GAP}(?:{AT_WORDS}){_GAP}(?={_LABEL}(?:-{_LABEL})*?(?:{_DOT}{_LABEL}){{0,4}}?(?:{_GAP}(?:{DOT_WORDS}){_GAP}{_END}|{_BRACKETED_DOT}))"),
        # (a), the Spanish word and a capital AT count before any domain, a small one before a mail provider
        ("open", rf"(?<=[A-Za-z0-9]){_OPEN}a{_CLOSE}(?={_DOMAIN_AHEAD})"),
        ("named@", rf"(?<=[A-Za-z0-9])(?:{_GAP}arroba{_GAP}|(?<=(?-i:[a-z0-9])){_GAP}(?-i:AT){_GAP})(?={_DOMAIN_AHEAD})"),
        ("named@", rf"(?<=[A-Za-z0-9]){_GAP}at{_GAP}(?=(?:{PROVIDERS.replace(' ', '|')}){_DOT}(?:{_LABEL}{_DOT})?{_END})"),
        ("@", r"(?<=[A-Za-z0-9])\s{1,3}@\s{0,3}(?=[A-Za-z0-9])|(?<=[A-Za-z0-9])@\s{1,3}(?=[A-Za-z0-9])"),
    ),
    "dot": (
        ("open", _BRACKETED_DOT),
        ("named", rf"(?<=[A-Za-z0-9]){_GAP}(?:{DOT_WORDS}){_GAP}(?=[A-Za-z0-9])"),
        ("loose", rf"(?<=[A-Za-z0-9])\s{{1,2}}\.\s{{0,2}}(?={_LABEL}(?:\s{{0,2}}\.|{_GAP})|{_END})"),
    ),
    "plus": (("plus", rf"(?<![A-Za-z0-9])plus\s{{1,3}}(?=(?:{_WORDS}|[0-9]))"),),
    "word": (("", rf"(?<![^\W_])(?P<digit>{_WORDS})(?![^\W_])(?:[\s,-]{{1,3}}(?=(?:{_WORDS})(?![^\W_])))?"),),
    "gone": (("gone", rf"[{INVISIBLE}]"),),
}
#: What a text must hold for an alternative to match: (text, text in small letters) -> can it?
_HOLDS: dict[str, Callable[[str, str], object]] = {
    "open": lambda flat, small: any(c in flat for c in "[({<"),
    "@": lambda flat, small: "@" in flat,
    "named@": lambda flat, small: "arroba" in small or "AT" in flat or any(p in small for p in PROVIDERS.split()),
    "named": lambda flat, small: any(w in small for w in DOT_WORDS.split("|")),
    "loose": lambda flat, small: " ." in flat or _LOOSE.search(flat),
    "plus": lambda flat, small: "plus" in small,
    "gone": lambda flat, small: not flat.isascii() and _INVISIBLES.search(flat),
}
_LOOSE = re.compile(r"\s\.")


_INVISIBLES = re.compile(f"(?P<gone>[{INVISIBLE}])")


@functools.cache
def _pattern(holds: frozenset[str]) -> re.Pattern:
    parts = {name: "|".join(p for need, p in of if not need or need in holds) for name, of in _PARTS.items()}
    return re.compile("|".join(f"(?P<{name}>{p})" for name, p in parts.items() if p), re.I)


def _tokens(flat: str) -> re.Pattern:
    """The tokens that can stand in a text: an alternative is left out only if a text like this can't match it."""
    small = flat.lower()
    holds = {name for name, sign in _HOLDS.items() if sign(flat, small)}
    if "named" in holds or "open" in holds:
        holds.add("bare")
    return _pattern(frozenset(holds))


#: (place in the rewritten text, source start, source end of a replaced token, or 0 for a copied run)
Places = list[tuple[int, int, int]]


def _rewritten(flat: str, pattern: re.Pattern) -> tuple[str, Places]:
    out: list[str] = []
    spans: Places = []
    place = done = 0
    for m in pattern.finditer(flat):
        s, e = m.span()
        if s > done:
            out.append(flat[done:s])
            spans.append((place, done, 0))
            place += s - done
        new = {"at": "@", "dot": ".", "plus": "+", "gone": ""}.get(m.lastgroup or "") if m.lastgroup != "word" else SPELLED[m["digit"].lower()]
        if new:
            out.append(new)
            # a spelled digit ends with its word, not with the space after it
            spans.append((place, s, m.end("digit") if m.lastgroup == "word" else e))
            place += 1
        done = e
    out.append(flat[done:])
    spans.append((place, done, 0))
    return "".join(out), spans


def translated(text: str) -> str:
    """The text with look-alikes replaced."""
    table, odd = _table()
    return text if text.isascii() or odd.isdisjoint(text) else text.translate(table)


def flattened(flat: str) -> tuple[str, Places]:
    """A translated text without its invisible characters."""
    return _rewritten(flat, _INVISIBLES) if not flat.isascii() and _INVISIBLES.search(flat) else (flat, [(0, 0, 0)])


def normalise(flat: str) -> tuple[str, Places]:
    """A translated text with all disguises rewritten."""
    return _rewritten(flat, _tokens(flat))


class _Intervals:
    """Disjoint intervals of each kind, found by bisection; those that overlap are made one."""

    def __init__(self, spans: list[Span]):
        self.starts: dict[int, list[int]] = {}
        self.ends: dict[int, list[int]] = {}
        for kind, s, e in sorted(spans):
            starts, ends = self.starts.setdefault(kind, []), self.ends.setdefault(kind, [])
            if ends and s < ends[-1]:
                ends[-1] = max(ends[-1], e)
            else:
                starts.append(s)
                ends.append(e)

    def overlap(self, kind: int, s: int, e: int) -> bool:
        i = bisect.bisect_left(self.starts.get(kind, ()), e) - 1
        return i >= 0 and self.ends[kind][i] > s

    def hold(self, kind: int, s: int, e: int) -> bool:
        i = bisect.bisect_right(self.starts.get(kind, ()), s) - 1
        return i >= 0 and self.ends[kind][i] >= e


def find(text: str) -> tuple[list[Span], list[Span]]:
    """(plain finds, added finds), each by kind, then start."""
    base = plain(text)
    added: list[Span] = []

    def from_source(flat: str, spans: Places) -> list[Span]:
        places = [p for p, _, _ in spans]

        def source(at: int, end: bool) -> int:
            place, start, stop = spans[bisect.bisect_right(places, at) - 1]
            return (stop if end else start) if stop else start + at - place + end

        return [(kind, source(s, False), source(e - 1, True)) for kind, s, e in plain(flat)]

    same = translated(text)
    flat, spans = flattened(same)
    if flat != text:
        known = _Intervals(base)
        added = [f for f in from_source(flat, spans) if not known.hold(*f)]
    whole, spans = normalise(same)
    if whole != flat:
        known = _Intervals(base + added)
        added += [f for f in from_source(whole, spans) if not known.overlap(*f)]
    return base, sorted(set(added))


def redact(text: str) -> str:
    """The text with every find replaced by its kind in angle brackets; overlapping finds become the first's."""
    base, added = find(text)
    out, done = [], 0
    for start, end, kind in sorted((s, e, k) for k, s, e in base + added):
        if start >= done:
            out += (text[done:start], f"<{KINDS[kind].upper()}>")
        done = max(done, end)
    return "".join(out) + text[done:]


SPAN = "array<struct<kind:string,start:int,end:int,base:boolean>>"
_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, finds: every whole text's finds by kind, then start. One pass, no shuffle."""

    def one(text: str) -> tuple:
        base, added = find(text)
        rows = sorted([(*s, True) for s in base] + [(*s, False) for s in added])
        return ([{"kind": KINDS[k], "start": s, "end": e, "base": b} for k, s, e, b in rows],)

    rows = text_batches(docs).select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    out = rows.mapInArrow(per_text(one, ["finds"], [_SPAN]), f"_id {rows.schema[0].dataType.simpleString()}, finds {SPAN}")
    return out.withColumnRenamed("_id", id_col)


def redact_pii(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """docs with its texts redacted and, if given, their lengths renewed; a null text stays null."""
    rest = [c for c in docs.columns if c != text_col]
    carried = text_batches(docs).select(*(docs[f"`{c}`"].alias(f"_c{i}") for i, c in enumerate(rest)), docs[f"`{text_col}`"].cast("string").alias("_text"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in carried.schema.fields[:-1]) + ", _none boolean, _text string"
    shaped = carried.select(*carried.columns[:-1], F.col("_text").isNull().alias("_none"), "_text")
    made = shaped.mapInArrow(per_text(lambda text: (redact(text),), ["_text"], [pa.string()]), schema)
    text = F.when(~F.col("_none"), F.col("_text"))
    place = {c: F.col(f"_c{i}") for i, c in enumerate(rest)} | {text_col: text}
    if length_col in place:
        place[length_col] = F.coalesce(F.length(text).cast(docs.schema[length_col].dataType), place[length_col])
    return made.select(*(place[c].alias(c) for c in docs.columns))
