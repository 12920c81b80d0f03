"""Secret scan with a trigram inverted index.

Every rule's regular expression gives a Boolean query over trigrams that each match must contain: AND along a sequence,
OR over alternatives. A batch of documents is one index segment: the postings of all trigrams that some rule asks for,
each a sorted list of document numbers. Postings are intersected and united as the query says, and only the candidates
are searched with the expression. A rule without mandatory trigrams searches every document. Letters are folded to
lower case in queries and postings, which can only add candidates.

Null and empty texts have no spans. Rules are linear in the length of a text. Repeated rows are judged one by one.
"""

from __future__ import annotations

import re
import re._constants as sre
import re._parser as parser
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from fanchart.llm.arrow import map_rows
from fanchart.llm.spans import Span, added, digest, written


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    flags: int = 0
    keep: Callable[[re.Match], bool] = lambda m: True


# Base rules: the leftmost non-overlapping matches that are long enough.
BASE = [
    Rule(
        "assign",
        r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        re.I,
        lambda m: m.end(2) - m.start(2) >= 8,
    ),
    Rule("access", r"AKIA[A-Z0-9]+", 0, lambda m: m.end() - m.start() >= 16),
    # Runs of 32 and more hex digits: a shorter run has no match at any start, which the look-behind skips.
    Rule("hex", r"(?<![0-9a-f])[0-9a-f]{32,}"),
]
# Further kinds, by the public formats of these credentials.
MORE = [
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("code_host", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_app", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("cloud_key", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("url_login", r"[a-z][a-z0-9+.-]{1,20}://[A-Za-z0-9._%-]{1,64}:[^\s@/:]{4,128}@"),
]
RULES = BASE + MORE
KINDS = [rule.kind for rule in RULES]

# A query is True (no condition), a trigram, or ("and" | "or", queries).
Query = bool | bytes | tuple


def trigram_query(pattern: str) -> Query:
    """What every match must contain, from the parsed expression."""
    strings, query = _required(parser.parse(pattern))
    return _simplified(("and", [query, _of_strings(strings)]))


# Sets of literal strings that a part may match as a whole are followed up to this many; beyond, they are cut off.
_MOST_STRINGS = 64


def _required(items) -> tuple[list[str] | None, Query]:
    """(all strings a sequence may match, or None if unknown; what it requires besides)."""
    exact: list[str] | None = [""]
    queries: list[Query] = []
    known = True
    for op, value in items:
        strings, query = _part(op, value)
        queries.append(query)
        if strings is not None and exact is not None and len(strings) * len(exact) <= _MOST_STRINGS:
            exact = [a + b for a in exact for b in strings]
        else:
            # The run of known strings ends here.
            if exact is not None:
                queries.append(_of_strings(exact))
            exact, known = strings if strings is not None else [""], False
    if known:
        return exact, ("and", queries)
    return None, ("and", [*queries, _of_strings(exact)])


def _part(op, value) -> tuple[list[str] | None, Query]:
    if op is sre.LITERAL:
        return [chr(value).lower()], True
    if op is sre.SUBPATTERN:
        return _required(value[-1])
    if op is sre.BRANCH:
        parts = [_required(branch) for branch in value[1]]
        if all(strings is not None for strings, _ in parts):
            return [s for strings, _ in parts for s in strings], ("or", [q for _, q in parts])
        return None, ("or", [("and", [q, _of_strings(s)]) for s, q in parts])
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
        least, most, inner = value
        strings, query = _required(inner)
        if (least, most) == (0, 1) and strings is not None:
            return ["", *strings], True
        return None, ("and", [query, _of_strings(strings)]) if least else True
    if op is sre.IN and all(kind is sre.LITERAL for kind, _ in value):
        return sorted({chr(c).lower() for _, c in value}), True
    if op in (sre.ASSERT_NOT, sre.AT):
        return [""], True
    return None, True


def _of_strings(strings: list[str] | None) -> Query:
    """One of the strings must occur."""
    if strings is None or any(len(s.encode()) < 3 for s in strings):
        return True
    return ("or", [("and", [s.encode()[i : i + 3] for i in range(len(s.encode()) - 2)]) for s in strings])


def _simplified(query: Query) -> Query:
    if not isinstance(query, tuple):
        return query
    op, parts = query[0], [_simplified(q) for q in query[1]]
    if op == "or":
        return True if any(q is True for q in parts) else parts[0] if len(parts) == 1 else (op, parts)
    parts = [q for q in parts if q is not True]
    return True if not parts else parts[0] if len(parts) == 1 else (op, parts)


def trigrams_of(query: Query) -> set[bytes]:
    if isinstance(query, bytes):
        return {query}
    return set().union(*map(trigrams_of, query[1])) if isinstance(query, tuple) else set()


class Scanner:
    """All rules, compiled, with the table that numbers the trigrams asked for."""

    def __init__(self, rules: list[Rule]):
        self.rules = rules
        self.patterns = [re.compile(rule.pattern, rule.flags | re.A) for rule in rules]
        self.queries = [trigram_query(rule.pattern) for rule in rules]
        wanted = sorted(set().union(*map(trigrams_of, self.queries)))
        self.wanted = {trigram: i + 1 for i, trigram in enumerate(wanted)}
        self.number = np.zeros(1 << 24, dtype=np.uint16)
        for trigram, i in self.wanted.items():
            self.number[int.from_bytes(trigram, "big")] = i

    def postings(self, texts: list[bytes]) -> dict[int, np.ndarray]:
        """Document numbers per wanted trigram, sorted. Texts are joined by a byte that ends every trigram."""
        joined = np.frombuffer(b"\0\0".join(texts).lower(), dtype=np.uint8)
        if len(joined) < 3:
            return {}
        ends = np.cumsum([len(t) + 2 for t in texts])
        code = joined[:-2].astype(np.uint32)
        code <<= 8
        code |= joined[1:-1]
        code <<= 8
        code |= joined[2:]
        number = self.number[code]
        at = np.flatnonzero(number)
        found = np.unique(number[at].astype(np.int64) << 32 | np.searchsorted(ends, at, side="right"))
        lists, begins = np.unique(found >> 32, return_index=True)
        return dict(zip(lists.tolist(), np.split(found & 0xFFFFFFFF, begins[1:])))

    def candidates(self, query: Query, postings: dict[int, np.ndarray], n: int) -> np.ndarray:
        if query is True:
            return np.arange(n)
        if isinstance(query, bytes):
            return postings.get(self.wanted[query], np.empty(0, dtype=np.int64))
        op, parts = query
        lists = [self.candidates(q, postings, n) for q in parts]
        out = lists[0]
        for more in lists[1:]:
            out = np.intersect1d(out, more, assume_unique=True) if op == "and" else np.union1d(out, more)
        return out

    def scan(self, texts: list[str]) -> list[list[Span]]:
        """The spans of each text, by rule."""
        # Lower-casing is of ASCII bytes only, so a zero byte inside a text cannot make a trigram that is asked for.
        postings = self.postings([t.encode() for t in texts])
        spans: list[list[Span]] = [[] for _ in texts]
        for kind, (rule, pattern, query) in enumerate(zip(self.rules, self.patterns, self.queries)):
            for i in self.candidates(query, postings, len(texts)).tolist():
                spans[i] += [(kind, *m.span()) for m in pattern.finditer(texts[i]) if rule.keep(m)]
        return spans


_SCANNER: list[Scanner] = []


def scanner() -> Scanner:
    """One scanner of the standing rules per Python worker."""
    if not _SCANNER:
        _SCANNER.append(Scanner(RULES))
    return _SCANNER[0]


def find_secrets(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with n_assign, n_access, n_hex (base spans), base_sha256, spans, n_added in place of such columns."""

    def start():
        scan = scanner().scan

        def columns(texts: list[str | None]) -> list[tuple]:
            rows = []
            for spans in scan([t or "" for t in texts]):
                base = [s for s in spans if s[0] < len(BASE)]
                more = added([], [s for s in spans if s[0] >= len(BASE)])
                counts = [sum(k == kind for k, _, _ in base) for kind in range(len(BASE))]
                rows.append((*counts, digest(written(base, KINDS)), written(base + more, KINDS), len(more)))
            return rows

        return columns

    outputs = {f"n_{r.kind}": "bigint" for r in BASE} | {"base_sha256": "string", "spans": "string", "n_added": "bigint"}
    return map_rows(df, [text], outputs, start, sliced=True)
