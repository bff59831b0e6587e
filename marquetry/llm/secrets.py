"""Secret scans: fixed patterns, and an assignment-aware lexer that scores literals by the names they reach."""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquetry.llm.common import release

#: Kinds in the order in which spans of one start are listed.
KINDS = ("assign", "access", "hex", "literal")
#: The base patterns and their least lengths.
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 6, 20, 24
_HEX_BYTES = bytes(120 if chr(c) in "0123456789abcdef" else 32 for c in range(256))
_HEX_RUN = b"x" * MIN_HEX

#: How sensitive a name is that holds these words in this order, from 0 to 1.
SENSITIVE = {
    ("password",): 1.0, ("passwd",): 1.0, ("passphrase",): 1.0, ("secret",): 1.0, ("pwd",): 0.9, ("token",): 0.9,
    ("apikey",): 1.0, ("api", "key"): 1.0, ("private", "key"): 1.0, ("access", "key"): 1.0, ("signing", "key"): 0.9,
    ("encryption", "key"): 0.9, ("credential",): 0.9, ("credentials",): 0.9, ("auth",): 0.7, ("bearer",): 0.8,
}
#: Literals that stand for a secret without being one.
PLACEHOLDERS = frozenset("changeme password secret token example placeholder undefined none null true false redacted".split())
MIN_LITERAL = 8
MIN_SCORE = 0.5

#: Words of function names that read a value by the name they are given.
READERS = frozenset("get getenv env environ read load fetch lookup find input open require".split())

_NAME = r"[A-Za-z_$][\w$.-]*+"
#: Left sides of source and configuration syntax: a name, perhaps a subscript or the type declared for it, and an operator;
#: or an element's tag; or a call that sets what its name says.
_TARGET = re.compile(
    rf"""(?<![\w$.-])["']?({_NAME})["']?(?:\[[\x20\t]*+["']([^"'\]\n]++)["'][\x20\t]*+\])?[\x20\t]*+"""
    r"""(?::=|=>|=(?!=)|:[\x20\t]*+[&*]?[A-Za-z_][\w.&*<>\[\],|?\x20]{0,60}?[\x20\t]?=(?![=>])|:(?![:/=]))[\x20\t]*+"""
    rf"""|<({_NAME})(?:\x20[^<>\n]*+)?>(?=[^<>]*+</)|(?<![A-Za-z])(?:set|with|put)_?({_NAME})[\x20\t]*+\((?=[\x20\t]*+["'`])""",
    re.ASCII,
)
_STRING = re.compile(
    r'''[rbufRBUF]{0,2}(?:"""((?:[^"\\]|\\.|"(?!""))*+)"""|\'\'\'((?:[^'\\]|\\.|'(?!\'\'))*+)\'\'\'|"((?:[^"\\\n]|\\.)*+)"|'((?:[^'\\\n]|\\.)*+)'|`([^`\n]*+)`)''', re.DOTALL
)
_REFERENCE = re.compile(rf"({_NAME})(?![\w+/=])", re.ASCII)
_BARE = re.compile(r"""[^\s"'`,;(){}\[\]<>]++""")
_BLANK = re.compile(r"(?:[\x20\t]|\\\n)*+")
_SPACE = re.compile(r"(?:\s|#[^\n]*+\n|//[^\n]*+\n)*+")
_LINE = re.compile(r"\n\s*+(?=[rbuf]{0,2}[\"'`])")
_BLOCK = re.compile(r"[|>][+-]?[\x20\t]*+\n")
MAX_NESTING = 16
_WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")

Span = tuple[int, int, str]


def base_spans(text: str) -> list[Span]:
    """Matches of the base patterns: leftmost and non-overlapping per kind, short ones dropped after matching."""
    out = []
    if ":" in text or "=" in text:
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_ASSIGN]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    if _HEX_RUN in text.encode("utf-8", "replace").translate(_HEX_BYTES):
        out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text) if m.end() - m.start() >= MIN_HEX]
    return sorted(out, key=_order)


def _order(span: Span) -> tuple[int, int, int]:
    return span[0], KINDS.index(span[2]), span[1]


def name_weight(name: str) -> float:
    """The weight of the most sensitive words in a name of snake, kebab, dotted or camel case."""
    parts = [p.lower() for p in _WORD.findall(name.rsplit(".", 1)[-1])]
    best = 0.0
    for key, weight in SENSITIVE.items():
        if any(tuple(parts[k : k + len(key)]) == key for k in range(len(parts) - len(key) + 1)):
            best = max(best, weight)
    return best


def literal_strength(value: str) -> float:
    """From 0 to 1: bits of entropy in the literal over 24, none for placeholders, references and short or spaced text."""
    if len(value) < MIN_LITERAL or value.lower() in PLACEHOLDERS or re.search(r"\s|\$\{|\{\{|^<.*>$|://[^:@/]*$", value):
        return 0.0
    counts = Counter(value)
    bits = -sum(n / len(value) * math.log2(n / len(value)) for n in counts.values())
    return min(1.0, bits * len(value) / 24 * min(1.0, bits / 2.5))


Pieces = list[tuple[int, int]]


class _Lexer:
    """Reads right sides of assignments: strings, references, brackets, calls, bare words and block scalars."""

    def __init__(self, text: str):
        self.text = text
        self.known: dict[str, list[tuple[int, Pieces]]] = {}  # by name: (indentation, literals), inner scopes last

    def assigned(self, name: str, indent: int, pieces: Pieces) -> None:
        """A name's value from here on, until the text goes back to a smaller indentation."""
        scopes = self.known.setdefault(name, [])
        while scopes and scopes[-1][0] >= indent:
            scopes.pop()
        scopes.append((indent, pieces))

    def resolved(self, name: str, indent: int) -> Pieces | None:
        scopes = self.known.get(name)
        while scopes and scopes[-1][0] > indent:
            scopes.pop()
        return scopes[-1][1] if scopes else None

    def string(self, pos: int) -> tuple[Pieces, int] | None:
        if not (m := _STRING.match(self.text, pos)):
            return None
        k = m.lastindex
        a, b = m.span(k)
        if k < 3 and "\n" in m[k]:
            return self.lines(a, b), m.end()
        return [(a, b)], m.end()

    def lines(self, a: int, b: int) -> Pieces:
        """The lines from a to b that could be a secret or a part of it: those of one word."""
        out = []
        for line in re.finditer(r"[^\n]+", self.text[a:b]):
            word = line[0].strip()
            if word and not re.search(r"\s", word):
                at = a + line.start() + line[0].index(word)
                out.append((at, at + len(word)))
        return out

    def block(self, pos: int, indent: int) -> tuple[Pieces, int]:
        """A block scalar: the lines that follow with a deeper indentation."""
        start = end = pos
        while end < len(self.text):
            stop = self.text.find("\n", end)
            stop = len(self.text) if stop < 0 else stop
            line = self.text[end:stop]
            if line.strip() and len(line) - len(line.lstrip()) <= indent:
                break
            end = min(stop + 1, len(self.text))
        return self.lines(start, end), end

    def value(self, pos: int, indent: int, nested: int = 0) -> tuple[Pieces, int] | None:
        """(literals, end) of an expression: operands joined by `+`, or side by side within brackets. None if it is none."""
        text, out, gap, read = self.text, [], _SPACE if nested else _BLANK, False
        while pos < len(text):
            got = self.operand(pos, indent, nested, bool(read))
            if got is None:
                break
            out += got[0]
            pos, read = got[1], True
            after = gap.match(text, pos).end()
            if text[after : after + 1] == "+" and text[after : after + 2] != "+=":
                pos = gap.match(text, after + 1).end()
            elif nested and _STRING.match(text, after):
                pos = after
            else:
                break
        return (out, pos) if read else None

    def operand(self, pos: int, indent: int, nested: int, more: bool) -> tuple[Pieces, int] | None:
        text = self.text
        if got := self.string(pos):
            return got
        if text[pos] in "([" and nested < MAX_NESTING:
            return self.items(pos + 1, ")" if text[pos] == "(" else "]", indent, nested + 1)
        if m := _REFERENCE.match(text, pos):
            name, end = m[1], m.end()
            if text[end : end + 1] == "(" and nested < MAX_NESTING:
                return self.call(name, end + 1, indent, nested + 1)
            found = self.resolved(name, indent)
            if found is not None:
                return found, end
            if nested or more or "." in name or not any(c.isdigit() for c in name):
                return [], end  # a reference to what is not known here
            return [m.span(1)], end
        if not nested and not more and (m := _BARE.match(text, pos)):
            return [m.span()], m.end()
        return None

    def items(self, pos: int, close: str, indent: int, nested: int) -> tuple[Pieces, int] | None:
        """Values between commas up to the closing bracket; None if anything else stands there."""
        text, out = self.text, []
        while True:
            pos = _SPACE.match(text, pos).end()
            if pos >= len(text):
                return None
            if text[pos] == close:
                return out, pos + 1
            got = self.value(pos, indent, nested)
            if got is None:
                return None
            out += got[0]
            pos = _SPACE.match(text, got[1]).end()
            if text[pos : pos + 1] == ",":
                pos += 1
            elif text[pos : pos + 1] != close:
                return None

    def call(self, name: str, pos: int, indent: int, nested: int) -> tuple[Pieces, int] | None:
        """A call's arguments count, but for the name that a reading function is given first."""
        first = _SPACE.match(self.text, pos).end()
        key = self.string(first)
        got = self.items(pos, ")", indent, nested)
        if got is None:
            return None
        words = {p.lower() for p in _WORD.findall(name)}
        pieces = [p for p in got[0] if p not in key[0]] if key and words & READERS else got[0]
        return pieces, got[1]


def literal_spans(text: str) -> list[tuple[Span, float]]:
    """Spans of literals that sensitive names receive, directly or through constants, with their scores.

    The text is lexed into name-literal pairs. A left side is a name, quoted or not, a subscript, a declared type or an
    element; a right side is strings (also of several lines), names and calls, joined or in brackets, bare words, and
    block scalars. A name stands for the literals last assigned to it above at no deeper indentation. Each literal of a right
    side gets the target's weight times the strength of the whole value; in a list each literal counts for itself.
    """
    if "=" not in text and ":" not in text and "<" not in text and "(" not in text:
        return []
    lexer = _Lexer(text)
    scores: dict[tuple[int, int], float] = {}
    at = line = seen = 0
    indent = _BLANK.match(text, 0).end()
    while m := _TARGET.search(text, at):
        at = pos = m.end()
        if (feed := text.rfind("\n", seen, m.start())) >= 0:  # only what lies behind the target before is looked through
            line = feed + 1
            indent = _BLANK.match(text, line).end() - line
        seen = max(seen, m.start())
        name = m[2] or m[1] or m[3] or m[4]
        listed = False
        if m[3]:
            end = text.find("<", pos)
            inner = text[pos:end].strip()
            got = ([(pos + text[pos:end].index(inner), pos + text[pos:end].index(inner) + len(inner))], end) if inner and text.startswith(f"</{m[3]}>", end) else None
        elif m[4]:
            got = lexer.items(pos, ")", indent, 1)
        elif block := _BLOCK.match(text, pos):
            got = lexer.block(block.end(), indent)
        else:
            if jump := _LINE.match(text, pos):
                pos = jump.end()
            listed = text[pos : pos + 1] == "["
            got = lexer.value(pos, indent)
        if got is None:
            continue
        pieces, at = got[0], max(at, got[1])
        if m[1] and not m[2]:
            lexer.assigned(m[1], indent, pieces)
        if pieces and (weight := name_weight(name)):
            whole = literal_strength("".join(text[a:b] for a, b in pieces))
            for a, b in pieces:
                score = weight * (literal_strength(text[a:b]) if listed else whole)
                if score > scores.get((a, b), 0.0) and b > a:
                    scores[a, b] = score
    return [((a, b, "literal"), s) for (a, b), s in sorted(scores.items())]


def scan_text(text: str | None, min_score: float = MIN_SCORE) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans) of a text: literals that score and that no base span covers are added."""
    text = text or ""
    base = base_spans(text)
    starts = sorted(a for a, _, _ in base)
    reach = list(accumulate((b for _, b, _ in sorted(base)), max))  # the furthest end of the spans up to each start
    covered = lambda a, b: (k := bisect_right(starts, a)) > 0 and reach[k - 1] >= b
    extra = [s for s, score in literal_spans(text) if score >= min_score and not covered(s[0], s[1])]
    return base, sorted(base + extra, key=_order)


def redacted(text: str, spans: list[Span], mark: str = "[secret]") -> str:
    """The text with each run of overlapping spans replaced by the mark."""
    out, at = [], 0
    for a, b, _ in sorted(spans):
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])


def _listed(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def secret_scan(docs: DataFrame, text_col: str = "text", redact: bool = False, min_score: float = MIN_SCORE) -> DataFrame:
    """Find secrets in each whole text; adds n_assign, n_access, n_hex, n_literal, base_sha256 and spans.

    Spans are kind:start:end in code points, end exclusive, by start, then kind. base_sha256 is the SHA-256 of the
    base spans in that form. With redact, text_col becomes the text with every span replaced. Null texts count as empty:
    no spans (and stay null). Rows are scanned one by one in Arrow batches, without a shuffle; columns of docs that
    bear the new names are replaced.
    """
    fields = "n_assign long, n_access long, n_hex long, n_literal long, base_sha256 string, spans string"
    names = [f.split()[0] for f in fields.split(", ")]
    docs = docs.drop(*[c for c in names if c in docs.columns and c != text_col])
    made = f"struct<{fields.replace(' ', ':').replace(',:', ',')}{',redacted:string' if redact else ''}>"

    @F.pandas_udf(made)
    def scanned(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            rows = []
            for text in batch:
                text = text if isinstance(text, str) else None
                base, spans = scan_text(text, min_score)
                n = Counter(kind for _, _, kind in spans)
                row = [n["assign"], n["access"], n["hex"], n["literal"], hashlib.sha256(_listed(base).encode()).hexdigest(), _listed(spans)]
                rows.append(row + [redacted(text, spans) if text else text] * redact)
            yield pd.DataFrame(rows, columns=names + ["redacted"] * redact)
            del batch, rows
            release()

    out = docs.withColumn("_s", scanned(F.col(text_col)))
    if redact:
        out = out.withColumn(text_col, F.col("_s.redacted"))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], *[F.col(f"_s.{c}") for c in names])
