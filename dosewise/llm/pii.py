"""Personal data with offset-preserving deobfuscation.

Base kinds, leftmost and without overlap per kind: e-mail addresses, IP addresses, card numbers (12 to 19 digits passing
the Luhn test) and phone numbers (9 to 15 digits). A match that fails its test is dropped and not tried again.

Method for disguised data. A chain of transducers rewrites a text, each keeping for every output character the source span
it stands for: (1) compatibility and lookalike characters become ASCII, zero-width characters vanish; (2) spelled digits
in a row of at least ``SPELLED`` become digits, "plus" before them a plus sign; so do shorter rows among the figures of a
phone number, and one to three in each of four groups that dots join, in figures or spelled, the dots as well;
(3) "at" and "dot" in brackets become ``@`` and ``.``; so does "at" as a word where a "dot" follows in the domain, and "dot"
as a word in the local part and the domain around any at sign. The base patterns then run on the rewritten text, and each
match is mapped back to source characters. It is added if at least one of its characters was rewritten and it overlaps
no base span of its kind, so plain prose is left alone.

Offsets are code points, the end exclusive. A null or empty text has no spans. Repeated rows come out once per row; an
empty table gives an empty result; extra columns do not matter. Whole texts are searched; each pattern takes linear time.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from operator import or_

import pyarrow as pa
from pyspark.sql import DataFrame

from dosewise.llm.common import slices

KINDS = ("email", "ip", "card", "phone")
#: Spelled digits in a row that are read as a number.
SPELLED = 4

Span = tuple[int, int]

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A start inside a run of digits can only match if the run's first digit does, hence the look-behind.
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")

# Letters that look like the ASCII character given first.
LOOKALIKES = {
    "a": "аα", "c": "сϲ", "e": "еε", "h": "һ", "i": "іιı", "j": "ј", "k": "кκ", "n": "ո", "o": "оοօ", "p": "рρ",
    "s": "ѕ", "u": "υս", "v": "ν", "w": "ԝω", "x": "хχ", "y": "уγ", "A": "АΑ", "B": "ВΒ", "C": "С", "E": "ЕΕ", "H": "НΗ",
    "I": "ІΙ", "K": "КΚ", "M": "МΜ", "N": "Ν", "O": "ОΟ", "P": "РΡ", "S": "Ѕ", "T": "ТΤ", "X": "ХΧ", "Y": "Υ", "Z": "Ζ",
    "-": "‐‑‒–—−", ".": "․。", "@": "﹫", "+": "﹢",
}
# Names of the digits in the four languages of the corpora.
DIGITS = {
    "0": "zero oh null cero zéro", "1": "one eins uno un", "2": "two zwei dos deux", "3": "three drei tres trois",
    "4": "four vier cuatro quatre", "5": "five fünf cinco cinq", "6": "six sechs seis", "7": "seven sieben siete sept",
    "8": "eight acht ocho huit", "9": "nine neun nueve neuf",
}

_NAME = {name: digit for digit, names in DIGITS.items() for name in names.split()}
_ANY_NAME = "(?:" + "|".join(sorted(_NAME, key=len, reverse=True)) + ")"
_ROW = re.compile(
    rf"(?<!\w)(?:plus[ ,.-]+)?{_ANY_NAME}(?:[ ,.-]+{_ANY_NAME}){{{SPELLED - 1},}}(?!\w)", re.IGNORECASE
)
_PART = re.compile(rf"plus|{_ANY_NAME}", re.IGNORECASE)
_BRACKETED = re.compile(r" ?[\[({<] ?(at|dot|punkt|punto|point|arobase|arroba) ?[\])}>] ?", re.IGNORECASE)
_OCTET = rf"(?:[0-9]{{1,3}}(?![0-9])|{_ANY_NAME}(?:[ ,-]+{_ANY_NAME}){{0,2}}(?!\w)(?![ ,-]+{_ANY_NAME}(?!\w)))"
_JOINT = r"(?:\.| dot | ?[\[({<] ?(?:dot|punkt|punto|point) ?[\])}>] ?)"
_SPELLED_IP = re.compile(rf"(?<!\w){_OCTET}(?:{_JOINT}{_OCTET}){{3}}(?!\w)(?!{_JOINT}(?:[0-9]|{_ANY_NAME}(?!\w)))", re.IGNORECASE)
_JOINTS = re.compile(_JOINT, re.IGNORECASE)
#: What may not stand before a spelled address: it would be part of a longer number.
_LONGER = re.compile(rf"(?:(?<!\w){_ANY_NAME}|[0-9])(?: dot |\.)$", re.IGNORECASE)
_LONGER_NAMES = re.compile(rf"(?<!\w)(?:plus|{_ANY_NAME})[ ,-]+$", re.IGNORECASE)
_MIXED = re.compile(
    rf"(?:\+|(?<!\w)plus[ ,.-]+)(?:{_ANY_NAME}|[0-9]++)(?:[ ().-]+(?:{_ANY_NAME}(?!\w)|[0-9]++))+(?!\w)", re.IGNORECASE
)
_FIGURES = re.compile(rf"plus|{_ANY_NAME}|[0-9]", re.IGNORECASE)
# Words joined by "at" and "dot"; as no part can be given back, each text is read once.
_LOCAL = r"[A-Za-z0-9._%+-]++(?!\w)"
_CHAIN = re.compile(rf"(?<![A-Za-z0-9._%+-]){_LOCAL}(?:(?: at | dot |@){_LOCAL})++", re.IGNORECASE)
_BETWEEN = re.compile(r" at | dot |@", re.IGNORECASE)
_AT_NAMES = {"at", "arobase", "arroba"}

# Cheap signs, on a text in lower case, without which a step changes nothing.
_BRACKET_SIGN = re.compile(r"[\[({<] ?(?:at|dot|punkt|punto|point|arobase|arroba) ?[\])}>]").search


def _spelled_sign(lower: str) -> bool:
    """Are there three names of digits or figures in a row, and a name at all?"""
    parts = lower.replace(",", " ").replace(".", " ").replace("-", " ").replace("+", " ").split()
    named = bytes(map(_NAME.__contains__, parts))
    return 1 in named and b"\1\1\1" in bytes(map(or_, named, map(str.isdigit, parts)))


def _plain_letters() -> dict[str, str]:
    """ASCII for lookalikes and for characters that Unicode calls compatible with one, nothing for hidden ones."""
    out = {}
    for c in map(chr, [*range(0xB2, 0x2600), *range(0xFF01, 0xFF5F), *range(0x1D400, 0x1D800)]):
        plain = unicodedata.normalize("NFKC", c)
        if plain != c and len(plain) == 1 and "!" <= plain <= "~":
            out[c] = plain
    out |= {other: plain for plain, others in LOOKALIKES.items() for other in others}
    return out | dict.fromkeys("​‌‍⁠﻿­", "")


_PLAIN = _plain_letters()
_FOREIGN = re.compile("[" + "".join(map(re.escape, _PLAIN)) + "]")
# The same in two classes, which are searched much faster than one with characters on both sides of U+FFFF.
_NEAR = re.compile("[" + "".join(re.escape(c) for c in _PLAIN if c <= "\uffff") + "]").search
_FAR = re.compile("[\U0001d400-\U0001d7ff]").search


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def emails(text: str) -> list[Span]:
    """Matches of the address pattern; a search from each ``@`` outwards takes linear time."""
    found, free = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > free and (text[start - 1].isascii() and (text[start - 1].isalnum() or text[start - 1] in "._%+-")):
            start -= 1
        match = _DOMAIN.match(text, at) if start < at else None
        if match:
            found.append((start, match.end()))
            free = match.end()
        else:
            free = max(free, at + 1)
        at = text.find("@", free)
    return found


def ips(text: str) -> list[Span]:
    return [m.span() for m in _IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p) < 256 for p in m[0].split("."))]


def cards(text: str) -> list[Span]:
    out = []
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append(m.span())
    return out


def phones(text: str) -> list[Span]:
    return [m.span() for m in _PHONE.finditer(text) if 9 <= len(_DIGIT.findall(m[0])) <= 15]


def base_spans(text: str) -> dict[str, list[Span]]:
    digits = _DIGIT.search(text) is not None
    return {
        "email": emails(text) if "@" in text else [],
        "ip": ips(text) if digits else [],
        "card": cards(text) if digits else [],
        "phone": phones(text) if digits and "+" in text else [],
    }


class Tape:
    """A text being rewritten: pieces ``(start, source start, source end, rewritten)`` in order of their start.

    A piece that is not rewritten has as many characters as its source; all characters of one that is stand for the
    whole of its source.
    """

    def __init__(self, text: str, pieces: list[tuple[int, int, int, bool]]):
        self.text, self.pieces = text, pieces
        self.starts = [p[0] for p in pieces]

    @classmethod
    def of(cls, text: str) -> Tape:
        return cls(text, [(0, 0, len(text), False)])

    def _covering(self, low: int, high: int) -> list[tuple[int, int, int, bool]]:
        """The pieces of the characters ``low`` to ``high``, cut to them."""
        out = []
        for k in range(bisect_right(self.starts, low) - 1, len(self.pieces)):
            start, a, b, rewritten = self.pieces[k]
            if start >= high:
                break
            end = self.starts[k + 1] if k + 1 < len(self.starts) else len(self.text)
            first, last = max(low, start), min(high, end)
            if first < last:
                out.append((first, a, b, True) if rewritten else (first, a + first - start, a + last - start, False))
        return out

    def source(self, low: int, high: int) -> tuple[int, int, bool]:
        """Source span of a character range, and whether anything in it was rewritten."""
        found = self._covering(low, high)
        a, b = found[0][1], found[-1][2]
        return a, b, b - a != high - low or any(p[3] for p in found)

    def rewrite(self, edits: list[tuple[int, int, str]]) -> Tape:
        """The tape with character ranges, in order, replaced."""
        if not edits:
            return self
        text, pieces, at, size = [], [], 0, 0
        for low, high, new in [*edits, (len(self.text), len(self.text), None)]:
            pieces += [(size + p[0] - at, *p[1:]) for p in self._covering(at, low)]
            text.append(self.text[at:low])
            size += low - at
            if new:
                a, b, _ = self.source(low, high)
                pieces.append((size, a, b, True))
                text.append(new)
                size += len(new)
            at = high
        return Tape("".join(text), pieces)


def _lookalikes(tape: Tape) -> Tape:
    return tape.rewrite([(*m.span(), _PLAIN[m[0]]) for m in _FOREIGN.finditer(tape.text)])


def _digits(text: str, low: int, high: int) -> list[tuple[int, int, str]]:
    """Edits that make digits of the names in a stretch; what separates names goes with the one after it."""
    edits, last = [], None
    for part in _FIGURES.finditer(text, low, high):
        name = part[0].lower()
        if name in _NAME or name == "plus":
            edits.append((part.start() if last is None else last, part.end(), "+" if name == "plus" else _NAME[name]))
            last = part.end()
        else:  # a figure: what stands before it stays, unless it is the space after "plus"
            if last is not None and edits[-1][2] == "+":
                edits[-1] = (edits[-1][0], part.start(), "+")
            last = None
    return edits


def _addresses(tape: Tape) -> Tape:
    """IP addresses in four groups of figures or spelled digits, joined by dots of any form."""
    edits = []
    for m in _SPELLED_IP.finditer(tape.text):
        before = tape.text[max(0, m.start() - 40) : m.start()]
        if _LONGER.search(before) or not m[0][0].isdigit() and _LONGER_NAMES.search(before):
            continue
        low = m.start()
        for joint in [*_JOINTS.finditer(tape.text, *m.span()), None]:
            edits += _digits(tape.text, low, joint.start() if joint else m.end())
            if joint:
                edits += [(*joint.span(), ".")] if joint[0] != "." else []
                low = joint.end()
    return tape.rewrite(edits)


def _spelled(tape: Tape) -> Tape:
    """Digits for spelled ones; what separates them goes with the digit after it."""
    edits = []
    for row in _MIXED.finditer(tape.text):
        figures = _FIGURES.findall(row[0])
        if 9 <= sum(f.lower() != "plus" for f in figures) <= 15:
            edits += _digits(tape.text, *row.span())
    tape = tape.rewrite(edits)
    edits = []
    for row in _ROW.finditer(tape.text):
        last = row.start()
        for part in _PART.finditer(tape.text, *row.span()):
            edits.append((last, part.end(), "+" if part[0].lower() == "plus" else _NAME[part[0].lower()]))
            last = part.end()
    return tape.rewrite(edits)


def _at_and_dot(tape: Tape) -> Tape:
    text = tape.text
    tape = tape.rewrite([(*m.span(), "@" if m[1].lower() in _AT_NAMES else ".") for m in _BRACKETED.finditer(text)])
    edits = []
    for chain in _CHAIN.finditer(tape.text):
        joints = list(_BETWEEN.finditer(tape.text, *chain.span()))
        dots = [j[0].lower() == " dot " for j in joints]
        used = [False] * len(joints)
        low = 0  # the first joint after the last at sign
        for k, joint in enumerate(joints):
            if dots[k]:
                continue
            end = k + 1
            while end < len(joints) and dots[end]:
                end += 1
            domain = tape.text[joint.end() : joints[k + 1].start() if k + 1 < len(joints) else chain.end()]
            # The word "at" needs a dot in its domain that was not typed.
            if joint[0] == "@" or end > k + 1 or tape.source(joint.end(), joint.end() + len(domain))[2] and "." in domain:
                used[low:end] = [True] * (end - low)
            low = k + 1
        edits += [(*j.span(), "." if dot else "@") for j, dot, u in zip(joints, dots, used) if u and j[0] != "@"]
    return tape.rewrite(edits)


def added_spans(text: str, base: dict[str, list[Span]]) -> dict[str, list[Span]]:
    """Spans that only the rewritten text shows, in source characters."""
    tape = Tape.of(text)
    if not text.isascii() and (_NEAR(text) or _FAR(text)):
        tape = _lookalikes(tape)
    lower = tape.text.lower()
    spelled = _spelled_sign(lower)
    dotted = " dot " in lower or _BRACKET_SIGN(lower)
    if spelled or dotted:
        tape = _addresses(tape)
    if spelled:
        tape = _spelled(tape)
    if dotted:
        tape = _at_and_dot(tape)
    if tape.text == text:
        return {}
    out = {}
    for kind, found in base_spans(tape.text).items():
        spans = [(a, b) for a, b, rewritten in (tape.source(*span) for span in found) if rewritten]
        own = base[kind]
        firsts = [a for a, _ in own]
        # Base spans do not overlap, so only the last one that starts before the span's end can reach into it.
        spans = [(a, b) for a, b in spans if not ((k := bisect_left(firsts, b)) and own[k - 1][1] > a)]
        if spans:
            out[kind] = spans
    return out


def _joined(spans: dict[str, list[Span]]) -> str:
    rows = sorted((a, KINDS.index(kind), b, kind) for kind, found in spans.items() for a, b in found)
    return ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in rows)


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        rows = []
        for text in batch.column("text").to_pylist():
            base = base_spans(text) if text else dict.fromkeys(KINDS, [])
            added = added_spans(text, base) if text else {}
            rows.append((base, added))
        spans = [{k: b[k] + a.get(k, []) for k in KINDS} for b, a in rows]
        counts = [pa.array([len(b[k]) for b, _ in rows], pa.int64()) for k in KINDS]
        sums = [hashlib.sha256(_joined(b).encode()).hexdigest() for b, _ in rows]
        added = [sum(map(len, a.values())) for _, a in rows]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                *counts,
                pa.array(sums, pa.string()),
                pa.array(list(map(_joined, spans)), pa.string()),
                pa.array(added, pa.int64()),
            ],
            names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"],
        )


def find_personal_data(docs: DataFrame) -> DataFrame:
    """Per row: numbers of base spans, their checksum, all spans as ``kind:start:end``, and the number of added ones."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    counts = ", ".join(f"n_{k} bigint" for k in KINDS)
    schema = f"doc_id {kind}, {counts}, base_sha256 string, spans string, n_added bigint"
    return docs.select("doc_id", "text").mapInArrow(_find, schema)


def op8_disguised_pii(spark, sf_dir: str) -> DataFrame:
    """Personal data in every document; the counts are of base spans."""
    return find_personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet"))
