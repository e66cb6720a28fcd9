"""Secret scan: three fixed patterns, then assignment-aware lexing.

The lexer cuts a text into strings, names, operators and line ends, and reads pairs of a target name and a value from
them: ``name = "x"``, ``name: type = "x"``, ``"name": "x"``, ``map["name"] = "x"``, ``setName("x")``, ``get("name", "x")``,
``<name>x</name>``, ``name="n" value="x"``, ``NAME=x`` lines. A value is what strings and names joined by ``+`` or
side by side make. A name stands for its value (constants are propagated, through chains and
cycles), so ``"abc" + REST`` is judged as a whole and all its pieces are reported. A value is scored by the words of the names
it reaches and by its own shape. Commented-out pairs count as well: they leak as much.

Scanning is per row: one Arrow pass, whole texts, no shuffle, so a lost executor costs the batch it held.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinelake.llm.common import rows_of, slices

KINDS = ("assign", "access", "hex", "literal")

# The base patterns and their least lengths. Letters of the names match in either ASCII case only.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ASSIGN_LEAST = 6
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
ACCESS_LEAST = 20
HEX = re.compile(r"[0-9a-f]{24,}")  # runs are maximal, so shorter ones need not be matched and dropped

#: Any name the assign pattern can start with holds one of these.
NAME_PARTS = ("password", "passwd", "secret", "token", "apikey", "api_key")

#: Words of a target name and what they say about its literal.
NAME_WEIGHTS = {
    "password": 3, "passwd": 3, "passphrase": 3, "pwd": 3, "pass": 2, "secret": 3, "token": 3, "apikey": 3,
    "credential": 3, "credentials": 3, "auth": 2, "bearer": 2, "private": 1, "access": 1, "api": 1, "key": 1,
    "client": 1, "signing": 1, "encryption": 1, "salt": 1,
}
SENSITIVE = re.compile("|".join((*NAME_WEIGHTS, "api_key")), re.I)
LEAST_NAME, LEAST_SCORE, LEAST_LITERAL = 2, 5, 8
PLACEHOLDER = re.compile(r"(?i)^(?:\W*|(.)\1*|x+|\*+|<.*>|\$\{.*\}|\{\{.*\}\}|%.*%|null|none|true|false|changeme|example.*"
                         r"|placeholder|your[_-].*|password|secret|token|todo|redacted)$")

# Quantifiers are possessive and no token can be started from inside another, so that scans are linear in the text.
NAME = r"[A-Za-z_][A-Za-z0-9_]*+(?:[.\-][A-Za-z0-9_]++)*+"
TOKEN = re.compile(
    r"""(?P<prose>(?:[A-Za-z]++\x20++(?=[A-Za-z_]))++)"""
    r"""|(?P<string>(?:[rbfuRBFU]{0,2}(?:"(?:[^"\\\n]|\\.)*+"|(?<![A-Za-z0-9])'(?:[^'\\\n]|\\.)*+'|`(?:[^`\\\n]|\\.)*+`))"""
    r"""|(?<![A-Za-z0-9])[rbfuRBFU]{1,2}'(?:[^'\\\n]|\\.)*+')"""
    rf"""|(?P<name>{NAME})|(?P<end>\n)|(?P<op>:=|=>|->|[=!<>]=|\+=|[=:+&,;()\[\]{{}}|<>?\#])"""
    r"""|(?P<other>[0-9][A-Za-z0-9_.\-]*+|\\.|[^\sA-Za-z0-9_]|\w)""")
CONFIG = re.compile(
    rf"^[ \t]*+(?:export[ \t]++|-[ \t]++)?(?P<name>{NAME})[ \t]*+[=:][ \t]*+(?P<bare>[^\s\"'`#;][^\s\"'`;]*+)[ \t]*+;?\r?$", re.M)
ELEMENT = re.compile(rf"<(?P<name>{NAME})(?:\s[^<>]*+)?>(?P<bare>[^<>]++)</(?P=name)\s*+>")
WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
ASSIGNS = {"=", ":=", "=>", ":", "+="}
ENDS = {"", "\n", ";", ",", ")", "}", "]", "#"}
#: First words of a call's last name that hand its argument to what the name says.
SETTERS = {"set", "with", "put", "add", "use"}
#: Lengths beyond this count as this where shares of letters are added up.
LONG = 1_000_000

Span = tuple[int, int]


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Whole matches of the base patterns, leftmost and not overlapping per kind."""
    out = []
    low = text.lower() if any(c in text for c in ":=") else ""
    if low and any(p in low for p in NAME_PARTS):
        out += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    out += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return out


def name_weight(name: str) -> int:
    words = [w.lower() for w in WORD.findall(name)]
    return sum(NAME_WEIGHTS.get(w, 0) for w in dict.fromkeys(words))


@dataclass(frozen=True)
class Shape:
    """What a value's score depends on: length, share of every character, white space."""

    size: int
    shares: dict[str, float]
    blank: bool

    @classmethod
    def of(cls, s: str) -> Shape:
        return cls(len(s), {c: k / len(s) for c, k in Counter(s).items()}, any(map(str.isspace, s)))

    def __add__(self, other: Shape) -> Shape:
        if not self.size or not other.size:
            return self if self.size else other
        a, b = min(self.size, LONG), min(other.size, LONG)
        shares = {c: (self.shares.get(c, 0.0) * a + other.shares.get(c, 0.0) * b) / (a + b) for c in self.shares | other.shares}
        return Shape(min(self.size + other.size, LONG), shares, self.blank or other.blank)

    def score(self) -> int:
        """0 for what cannot be a secret, else points for variety, length and entropy."""
        if self.size < LEAST_LITERAL or self.blank:
            return 0
        classes = sum(any(map(f, self.shares)) for f in (str.islower, str.isupper, str.isdigit))
        classes += any(not c.isalnum() for c in self.shares)
        entropy = -sum(p * math.log2(p) for p in self.shares.values())
        return (classes >= 2) + (classes >= 3) + (self.size >= 16) + (entropy >= 2.5) + (entropy >= 3.5)


NOTHING = Shape(0, {}, False)
#: A right side: spans of literals and names of constants, in order.
Value = list[Span | str]


class Lexer:
    """Name-value pairs of a text: tokens first, then bindings read from them."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.tokens = [(m.lastgroup, m.start(), m.end()) for m in TOKEN.finditer(text)]
        self.values: dict[str, list[Value]] = {}
        for k in range(len(self.tokens)):
            self.read(k)
        for m in (*CONFIG.finditer(text), *ELEMENT.finditer(text)):
            self.values.setdefault(m["name"], []).append([m.span("bare")])

    def kind(self, k: int) -> str:
        return self.tokens[k][0] if k < len(self.tokens) else "end"

    def sign(self, k: int) -> str:
        """The operator at ``k``, a line feed at the end of a line, nothing behind the last token, else a blank."""
        if k >= len(self.tokens):
            return ""
        kind, a, b = self.tokens[k]
        return self.text[a:b] if kind in ("op", "end") else " "

    def inside(self, k: int) -> Span:
        """What stands between a string's quotes."""
        _, a, b = self.tokens[k]
        while self.text[a] not in "\"'`":
            a += 1
        return a + 1, b - 1

    def label(self, k: int) -> str | None:
        """The name or key at ``k``."""
        if self.kind(k) == "name":
            return self.text[slice(*self.tokens[k][1:])]
        return self.text[slice(*self.inside(k))] if self.kind(k) == "string" else None

    def read(self, k: int) -> None:
        """Bindings whose target starts at ``k``: assignments, keys, annotated names, setters, key-value arguments."""
        target = self.label(k)
        if target is None:
            return
        at = k + 1
        if self.kind(k) == "string" and self.sign(at) == "]":  # environ["x"] = ...
            at += 1
        sign = self.sign(at)
        if sign in ASSIGNS:
            names = [target]
            if sign == ":":
                end = self.annotated(at + 1)
                if end is not None:
                    near = self.tokens[at + 1]
                    if near[0] == "name" and near[1] == self.tokens[at][2]:  # env:X = ...
                        names.append(self.text[near[1] : near[2]])
                    at = end
            value, after = self.expression(at + 1)
            if value:
                for name in names:
                    self.values.setdefault(name, []).append(value)
            self.named_value(target, value, after)
        elif self.kind(k) == "string" and sign == "," and self.kind(at + 1) == "string" and self.sign(k - 1) == "(":
            self.bind(target, at + 1)
        elif self.kind(k) == "name" and sign == "(" and self.kind(at + 1) == "string" and self.sign(at + 2) == ")":
            words = WORD.findall(target.rsplit(".", 1)[-1])
            if words and words[0].lower() in SETTERS:
                self.bind(target, at + 1)

    def bind(self, target: str, k: int) -> None:
        self.values.setdefault(target, []).append([self.inside(k)])

    def named_value(self, target: str, value: Value, after: int) -> None:
        """``name="x" value="y"`` and its like in other notations: ``y`` belongs to ``x``."""
        if target.lower() not in ("name", "key", "id") or len(value) != 1 or isinstance(value[0], str):
            return
        at = after + (self.sign(after) == ",")
        at += self.sign(at) == "\n"
        if (self.label(at) or "").lower() == "value" and self.sign(at + 1) in ("=", ":") and self.kind(at + 2) == "string":
            self.bind(self.text[slice(*value[0])], at + 2)

    def annotated(self, k: int) -> int | None:
        """Place of the ``=`` behind a type that starts at ``k``."""
        while self.kind(k) in ("name", "prose") or self.sign(k) in ("[", "]", "|", ",", "<", ">", "?"):
            k += 1
        return k if self.sign(k) == "=" else None

    def expression(self, k: int) -> tuple[Value, int]:
        """Literals and names joined from ``k`` on, and the place behind them; nothing if it is not a constant."""
        value: Value = []
        depth, joined, strings = 0, True, 0  # joined: an operand may follow
        while True:
            kind, sign = self.kind(k), self.sign(k)
            if kind == "string":
                value.append(self.inside(k))
                strings += 1
                joined = False
            elif kind == "name" and joined:
                value.append(self.text[slice(*self.tokens[k][1:])])
                joined = False
            elif sign == "(" and joined:
                depth += 1
            elif sign == ")" and depth:
                depth -= 1
            elif sign in ("+", "&") and not joined:
                joined = True
            elif sign == "\n" and (depth or (joined and value) or (strings and self.sign(k + 1) == "+")):
                pass
            else:
                break
            k += 1
        if not strings and sign not in ENDS:
            value = []
        return value, k

    def single(self, name: str) -> Value | None:
        """A constant's value: that of a name with one definition."""
        found = self.values.get(name, ())
        return found[0] if len(found) == 1 else None

    def shapes(self, value: Value, known: dict[str, Shape]) -> Shape:
        """Shape of the whole value with constants put in; each constant is worked out once, a cycle adds nothing."""
        todo = [p for p in value if isinstance(p, str)]
        while todo:
            name = todo[-1]
            inner = self.single(name) or []
            new = [p for p in inner if isinstance(p, str) and p not in known]
            if name not in known and new:
                known[name] = NOTHING  # while it is being worked out
                todo += new
                continue
            if known.get(name, NOTHING) is NOTHING:
                known[name] = self.total(inner, known)
            todo.pop()
        return self.total(value, known)

    def total(self, value: Value, known: dict[str, Shape]) -> Shape:
        out = NOTHING
        for p in value:
            out = out + (known.get(p, NOTHING) if isinstance(p, str) else Shape.of(self.text[slice(*p)]))
        return out

    def literals(self) -> set[Span]:
        return {p for values in self.values.values() for v in values for p in v if not isinstance(p, str)}

    def sensitive(self) -> set[Span]:
        """Every piece of the values that reach a sensitive name and look like secrets as a whole.

        Names are visited from those of the greatest weight on, so each counts once, with the greatest that it reaches.
        """
        out: set[Span] = set()
        told: set[str] = set()
        seen: set[str] = set()
        known: dict[str, Shape] = {}
        weights = {name: name_weight(name) for name in self.values}
        for target in sorted((n for n, w in weights.items() if w >= LEAST_NAME), key=lambda n: (-weights[n], n)):
            todo = [target]
            while todo:
                name = todo.pop()
                if name in seen:
                    continue
                seen.add(name)
                for value in self.values.get(name, ()):
                    parts = [p for p in value if isinstance(p, str)]
                    todo += parts
                    direct = "".join(self.text[slice(*p)] for p in value if not isinstance(p, str))
                    points = self.shapes(value, known).score()
                    if points and weights[target] + points >= LEAST_SCORE and (parts or not PLACEHOLDER.match(direct)):
                        self.tell(value, out, told)
        return {s for s in out if s[0] < s[1]}

    def tell(self, value: Value, out: set[Span], told: set[str]) -> None:
        """Add the value's literals and those of the constants in it."""
        todo = [value]
        while todo:
            for p in todo.pop():
                if not isinstance(p, str):
                    out.add(p)
                elif p not in told and (inner := self.single(p)):
                    told.add(p)
                    todo.append(inner)


def lexed_spans(text: str, assigned: list[Span]) -> list[Span]:
    """Pieces of values that reach a sensitive name and look like secrets, and words in which one of the ``assigned`` spans ends."""
    if not any(c in text for c in ":=(<") or not SENSITIVE.search(text):
        return []
    lexer = Lexer(text)
    ends = [e for _, e in assigned]

    def entered(a: int, b: int) -> bool:
        k = bisect_right(ends, a)
        return k < len(ends) and assigned[k][0] < a and ends[k] < b and not any(map(str.isspace, text[a:b]))

    return sorted({s for s in lexer.literals() if entered(*s)} | lexer.sensitive())


def secret_spans(text: str | None) -> list[tuple[str, int, int]]:
    """All spans by start, then kind; a literal that lies in one base span is left to that span."""
    if not text:
        return []
    base = base_spans(text)
    by_start = sorted((s, e) for _, s, e in base)
    starts, reach = [s for s, _ in by_start], [0, *accumulate((e for _, e in by_start), max)]
    lexed = lexed_spans(text, [(s, e) for k, s, e in base if k == "assign"])
    spans = base + [("literal", a, b) for a, b in lexed if reach[bisect_right(starts, a)] < b]
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``spans`` (array of kind, start, end in code points, end exclusive) of every row.

    A null or empty text has no spans. Null ids and repeated rows are kept as they are, an empty table gives an
    empty one, and other columns are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch in slices(batches):
            spans = [[{"kind": k, "start": s, "end": e} for k, s, e in secret_spans(t)] for (t,) in rows_of(batch, "text")]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, kind)], names=["id", "spans"])

    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = narrow.schema["id"].dataType.simpleString()
    out = narrow.mapInArrow(run, f"id {kind}, spans array<struct<kind:string,start:int,end:int>>")
    return out.withColumnRenamed("id", id_col)


def redact(text: str | None) -> str | None:
    """The text with every span replaced by ``<kind>``; overlapping spans become one."""
    spans = secret_spans(text)
    if not spans:
        return text
    out, at = [], 0
    for kind, start, end in spans:
        if start >= at:
            out += [text[at:start], f"<{kind}>"]
        at = max(at, end)
    return "".join(out) + text[at:]


def redacted(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """The same rows and columns with secrets cut out of the text."""
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            at = batch.schema.get_field_index(text_col)
            texts = pa.array([redact(t) for t in batch.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([texts if k == at else c for k, c in enumerate(batch.columns)], batch.schema.names)

    return docs.mapInArrow(run, schema)
