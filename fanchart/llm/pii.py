"""Personal data in disguise: transducers normalise a text and remember where every character came from.

A transducer rewrites a text and returns, for each character of its output, the span of source characters it stands
for. The chain of transducers turns look-alike characters into ASCII, drops invisible ones, turns spelled digits into
digits, and "at" and "dot" disguises into their signs. Detectors run over the untouched text (the identity transducer)
and over the normalised one; spans found there are mapped back to source characters. Base spans always stay; a span from
the normalised text is added if no span of its kind overlaps it.

Null and empty texts have no spans. Times grow linearly with the length of a text, so very long ones are whole.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame

from fanchart.llm.arrow import map_rows
from fanchart.llm.spans import Span, added, digest, written

KINDS = ["email", "ip", "card", "phone"]

# Look-alikes of ASCII characters, by script; the full-width forms follow from their offset.
GREEK = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧαεικνορτυχ", "ABEZHIKMNOPTYXaeiknoptux"))
CYRILLIC = dict(zip("АВЕЗКМНОРСТУХавеокмнрстухіјѕһԁԛԝ", "ABE3KMHOPCTYXaBeokMHpcTyxijshdqw"))
SIGNS = dict(zip("‐‑‒–—−．。․＠﹫﹢＋（）", "------....@@++()"))
INVISIBLE = "­​‌‍‎‏⁠﻿"
DIGIT_WORDS = dict(
    zero="0", oh="0", one="1", two="2", three="3", four="4", five="5", six="6", seven="7", eight="8", nine="9"
)


def _look_alikes() -> dict[str, str]:
    table = GREEK | CYRILLIC | SIGNS
    table |= {chr(0xFEE0 + c): chr(c) for c in range(0x21, 0x7F)}
    for first in (0x0660, 0x06F0, 0x0966, 0x1D7CE, 0x1D7D8, 0x1D7E2, 0x1D7EC, 0x1D7F6):
        table |= {chr(first + d): str(d) for d in range(10)}
    for first in (0x1D400, 0x1D434, 0x1D468, 0x1D5A0, 0x1D5D4, 0x1D608, 0x1D63C, 0x1D670):
        table |= {chr(first + i): chr(65 + i) for i in range(26)} | {chr(first + 26 + i): chr(97 + i) for i in range(26)}
    return table | {" ": " ", " ": " ", " ": " ", " ": " ", "　": " "}


LOOK_ALIKES = str.maketrans(_look_alikes())
_STRANGE = re.compile("[" + re.escape("".join(_look_alikes())) + INVISIBLE + "]")

# Spelled digits: three or more digit words or digits in a row, of which the words become digits.
_DIGIT_WORD = r"\b(?:" + "|".join(DIGIT_WORDS) + r")\b"
_DIGIT_RUN = re.compile(rf"(?:plus[ -]{{0,2}})?(?:{_DIGIT_WORD}|[0-9])(?:[ .,-]{{0,2}}(?:{_DIGIT_WORD}|[0-9])){{2,}}", re.I | re.A)
_DIGIT_TOKEN = re.compile(rf"plus[ -]{{0,2}}(?=[0-9a-z])|({_DIGIT_WORD})([ -]{{0,2}}(?={_DIGIT_WORD}|[0-9]))?", re.I | re.A)
_ANY_DIGIT_WORD = re.compile(_DIGIT_WORD, re.I | re.A)

# At and dot disguises: in brackets anywhere, bare words only where a name, "at", a name, "dot" and a name follow.
_AT = re.compile(r"[ ]?(?:\[[ ]?at[ ]?\]|\([ ]?at[ ]?\)|\{[ ]?at[ ]?\}|<at>)[ ]?|[ ](?=@[A-Za-z0-9])|(?<=@)[ ](?=[A-Za-z0-9])", re.I)
_DOT = re.compile(r"[ ]?(?:\[[ ]?dot[ ]?\]|\([ ]?dot[ ]?\)|\{[ ]?dot[ ]?\}|<dot>|\[\.\]|\(\.\))[ ]?", re.I)
_NUMBER_DOT = re.compile(r"(?<=[0-9])[ ](?:dot|point)[ ](?=[0-9])", re.I)
_BARE = re.compile(
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+(?P<at>[ ]at[ ]|@)[A-Za-z0-9-]+(?:(?:[ ]dot[ ]|\.)[A-Za-z0-9-]+)+", re.I
)
_BARE_SIGN = re.compile(r"[ ](at|dot)[ ]", re.I)
_MAY_BE_ADDRESS = re.compile(r"[\[({<][ ]?(?:at|dot)|[ ](?:dot|point)[ ]|\[\.\]|\(\.\)|[ ]@|@[ ]", re.I)


class Mapped:
    """A text with, per character, the start and end of its source; None stands for the identity."""

    def __init__(self, text: str, starts: list[int] | None = None, ends: list[int] | None = None):
        self.text, self.starts, self.ends = text, starts, ends

    def rewritten(self, edits: list[tuple[int, int, str]]) -> Mapped:
        """With each (start, end, replacement) done; every character of a replacement stands for the whole edit."""
        if not edits:
            return self
        starts = self.starts or list(range(len(self.text)))
        ends = self.ends or list(range(1, len(self.text) + 1))
        text, new_starts, new_ends, at = [], [], [], 0
        for start, end, new in edits:
            text += [self.text[at:start], new]
            new_starts += starts[at:start] + [starts[start]] * len(new)
            new_ends += ends[at:start] + [ends[end - 1]] * len(new)
            at = end
        text.append(self.text[at:])
        return Mapped("".join(text), new_starts + starts[at:], new_ends + ends[at:])

    def source(self, span: Span) -> Span:
        kind, start, end = span
        return span if self.starts is None else (kind, self.starts[start], self.ends[end - 1])


def look_alikes(mapped: Mapped) -> Mapped:
    """Look-alike characters become ASCII, invisible ones go."""
    if mapped.text.isascii() or not _STRANGE.search(mapped.text):
        return mapped
    shown = Mapped(mapped.text.translate(LOOK_ALIKES), mapped.starts, mapped.ends)
    return shown.rewritten([(m.start(), m.end(), "") for m in re.finditer(f"[{INVISIBLE}]+", shown.text)])


def spelled_digits(mapped: Mapped) -> Mapped:
    """Runs of spelled digits become digits, "plus" before them a plus sign."""
    if not _ANY_DIGIT_WORD.search(mapped.text):
        return mapped
    edits = []
    for run in _DIGIT_RUN.finditer(mapped.text):
        if _ANY_DIGIT_WORD.search(run[0]):
            for token in _DIGIT_TOKEN.finditer(mapped.text, run.start(), run.end()):
                word = token[1]
                edits.append((token.start(), token.end(), DIGIT_WORDS[word.lower()] if word else "+"))
    return mapped.rewritten(edits)


def at_and_dot(mapped: Mapped) -> Mapped:
    """[at], (dot) and bare " at " and " dot " inside addresses become their signs."""
    if not _MAY_BE_ADDRESS.search(mapped.text):
        return mapped
    text = mapped.text
    edits = [(m.start(), m.end(), "" if m[0] == " " else "@") for m in _AT.finditer(text)]
    edits += [(m.start(), m.end(), ".") for pattern in (_DOT, _NUMBER_DOT) for m in pattern.finditer(text)]
    mapped = mapped.rewritten(_without_overlaps(edits))
    edits = []
    for address in _BARE.finditer(mapped.text):
        for m in _BARE_SIGN.finditer(mapped.text, address.start(), address.end()):
            edits.append((m.start(), m.end(), "@" if m[1].lower() == "at" else "."))
    return mapped.rewritten(edits)


def _without_overlaps(edits: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    kept: list[tuple[int, int, str]] = []
    for edit in sorted(edits):
        if not kept or edit[0] >= kept[-1][1]:
            kept.append(edit)
    return kept


TRANSDUCERS: list[Callable[[Mapped], Mapped]] = [look_alikes, spelled_digits, at_and_dot]

# Detectors. Each finds the leftmost non-overlapping matches of its pattern and drops those that fail its condition.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9]++(?:[ -][0-9]++)*")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def find_emails(text: str) -> list[tuple[int, int]]:
    """Every domain after an at sign, with the run of name characters before it, back to the last match at most."""
    found, taken = [], 0
    for domain in _DOMAIN.finditer(text):
        start = domain.start()
        while start > taken and text[start - 1] in _LOCAL:
            start -= 1
        if start < domain.start():
            found.append((start, domain.end()))
            taken = domain.end()
    return found


def find_ips(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _IP.finditer(text) if all(_at_most_255(part) for part in m[0].split("."))]


def _at_most_255(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and part <= "255"


def find_cards(text: str) -> list[tuple[int, int]]:
    found = []
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and passes_luhn(digits):
                found.append(m.span())
    return found


def passes_luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(d // 5 + 2 * d % 10 for d in map(int, digits[-2::-2]))
    return total % 10 == 0


def find_phones(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _PHONE.finditer(text) if 10 <= sum(c.isdigit() for c in m[0]) <= 15]


DETECTORS = [find_emails, find_ips, find_cards, find_phones]


def detect(text: str) -> list[Span]:
    return [(kind, start, end) for kind, find in enumerate(DETECTORS) for start, end in find(text)]


def find_spans(text: str) -> tuple[list[Span], list[Span]]:
    """(base spans, added spans) of a text, both in source characters."""
    mapped = source = Mapped(text)
    base = [source.source(span) for span in detect(text)]
    for transducer in TRANSDUCERS:
        mapped = transducer(mapped)
    return base, [] if mapped is source else added(base, [mapped.source(span) for span in detect(mapped.text)])


def redact(text: str, spans: list[Span]) -> str:
    """The text with each span replaced by its kind in brackets; of overlapping spans the whole stretch goes as the first kind."""
    out, at = [], 0
    for start, kind, end in sorted((s, k, e) for k, s, e in spans):
        if start >= at:
            out += [text[at:start], f"[{KINDS[kind].upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def personal_data(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans, n_added in place of such columns."""

    def start():
        def columns(value: str | None) -> tuple:
            base, more = find_spans(value or "")
            counts = [sum(k == kind for k, _, _ in base) for kind in range(len(KINDS))]
            return (*counts, digest(written(base, KINDS)), written(base + more, KINDS), len(more))

        return columns

    outputs = {f"n_{kind}": "bigint" for kind in KINDS} | {"base_sha256": "string", "spans": "string", "n_added": "bigint"}
    return map_rows(df, [text], outputs, start)


def redact_personal_data(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with the personal data in ``text`` replaced by the kinds in brackets; null texts stay null."""

    def start():
        def redacted(value: str | None) -> tuple:
            if not value:
                return (value,)
            base, more = find_spans(value)
            return (redact(value, base + more) if base or more else value,)

        return redacted

    return map_rows(df, [text], {text: "string"}, start)
