"""The RAW query language: terms, fields, phrases, booleans, grouping, wildcards, fuzzy terms, ranges, regular expressions, boosts.

A query text becomes a small tree, which becomes two Columns: whether a row matches, and its score. Terms and phrases score by
BM25; wildcards, prefixes, fuzzy terms, ranges, regular expressions and match-all score their boost. The default operator is OR and the
default field `text`; only matching clauses that aren't prohibited score."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions.analysis import SIMPLE, near_count, query_tokens
from skein.operators import bm25

TOKENS = {"text": bm25.TEXT, "heading_text": bm25.HEADING}
KEYWORDS = {"path": "path", "heading": "heading", "checksum": "checksum", "line": "start_line"}


class QueryError(ValueError):
    """An invalid RAW query."""


@dataclass(frozen=True)
class Leaf:
    kind: str  # term phrase prefix wildcard fuzzy range regex all
    name: str = "text"
    words: tuple[str, ...] = ()
    pattern: str = ""
    amount: float = 0
    low: str | None = None
    high: str | None = None
    low_in: bool = True
    high_in: bool = True
    boost: float = 1.0


@dataclass(frozen=True)
class Group:
    clauses: tuple[tuple[str, object], ...] = field(default=())  # occurrence (+, -, or empty) and node
    boost: float = 1.0


_LEXER = re.compile(
    r"""\s*(?:(?P<quoted>"(?:[^"\\]|\\.)*")|(?P<regex>/(?:[^/\\]|\\.)*/)|(?P<range>[\[{][^\]}]*[\]}])|(?P<op>&&|\|\||[()+\-!^~:])
    |(?P<word>(?:[^\s()\[\]{}"^~:/\\+\-!&|]|\\.|(?<=[^\s(])[+\-!/&|])+))""",
    re.X,
)


class _Parser:
    def __init__(self, text: str, pattern: str):
        self.pattern, self.items, at = pattern, [], 0
        text = text.rstrip()
        while at < len(text):
            m = _LEXER.match(text, at)
            if not m or m.end() == at:
                raise QueryError(f"invalid query: {text!r} at {at}")
            self.items.append((m.lastgroup, m[m.lastgroup], m.start(m.lastgroup) > at or at == 0))
            at = m.end()
        self.i = 0

    def peek(self, k: int = 0) -> tuple[str | None, str, bool]:
        return self.items[self.i + k] if self.i + k < len(self.items) else (None, "", True)

    def take(self) -> tuple[str | None, str, bool]:
        out = self.peek()
        self.i += 1
        return out

    def group(self, name: str, nested: bool) -> Group:
        clauses: list[list] = []
        joined = None
        while True:
            kind, value, _ = self.peek()
            if kind is None or (kind == "op" and value == ")"):
                break
            if (kind == "word" and value in ("AND", "OR")) or (kind == "op" and value in ("&&", "||")):
                self.take()
                if not clauses or joined:
                    raise QueryError(f"invalid query: misplaced {value}")
                joined = "AND" if value in ("AND", "&&") else "OR"
                continue
            occur = ""
            if (kind == "word" and value == "NOT") or (kind == "op" and value in "+-!"):
                self.take()
                occur = "+" if value == "+" else "-"
            node = self.clause(name)
            if joined == "AND":
                if clauses[-1][0] == "":
                    clauses[-1][0] = "+"
                occur = occur or "+"
            joined = None
            clauses.append([occur, node])
        if joined or (nested and self.peek()[1] != ")") or not clauses:
            raise QueryError("invalid query: incomplete")
        return Group(tuple((o, n) for o, n in clauses))

    def clause(self, name: str):
        kind, value, _ = self.take()
        if kind == "word" and self.peek()[:2] == ("op", ":"):
            self.take()
            field_name = unescape(value)
            if field_name == "*":
                if self.take()[1] != "*":
                    raise QueryError("invalid query: unknown field *")
                return self.boosted(Leaf("all"))
            if field_name not in TOKENS and field_name not in KEYWORDS:
                name = field_name  # an unknown field matches nothing
            name, (kind, value, _) = field_name, self.take()
        if kind == "op" and value == "(":
            node = self.group(name, True)
            self.take()
            return self.boosted(node)
        if kind == "quoted":
            words = tuple(query_tokens(unescape(value[1:-1]), self.pattern))
            node = Leaf("phrase" if len(words) != 1 else "term", name, words)
            if self.peek()[:2] == ("op", "~"):
                self.take()
                node = replace(node, amount=self.number())
            return self.boosted(node)
        if kind == "regex":
            return self.boosted(Leaf("regex", name, pattern=value[1:-1].replace("\\/", "/")))
        if kind == "range":
            m = re.fullmatch(r"([\[{])\s*(\S+)\s+TO\s+(\S+)\s*([\]}])", value)
            if not m:
                raise QueryError(f"invalid query: {value}")
            end = lambda s: None if s == "*" else unescape(s.strip('"')).lower()
            return self.boosted(Leaf("range", name, low=end(m[2]), high=end(m[3]), low_in=m[1] == "[", high_in=m[4] == "]"))
        if kind == "word":
            return self.boosted(self.word(name, value))
        raise QueryError(f"invalid query: unexpected {value or 'end'}")

    def word(self, name: str, value: str):
        magic = re.search(r"(?<!\\)[*?]", value)
        if magic:
            if magic.start() == 0:
                raise QueryError("invalid query: a wildcard can't come first")
            if re.fullmatch(r"(?:[^*?\\]|\\.)+\*", value):
                return Leaf("prefix", name, pattern=unescape(value[:-1]).lower())
            return Leaf("wildcard", name, pattern=value.lower())
        if self.peek()[:2] == ("op", "~"):
            self.take()
            amount = self.number(default=2)
            return Leaf("fuzzy", name, (unescape(value).lower(),), amount=min(2, int(amount if amount >= 1 else 2)))
        words = tuple(query_tokens(unescape(value), self.pattern))
        return Leaf("term", name, words) if len(words) == 1 else Group(tuple(("", Leaf("term", name, (w,))) for w in words)) if words else Leaf("term", name, ())

    def number(self, default: float | None = None) -> float:
        kind, value, spaced = self.peek()
        if kind == "word" and not spaced and re.fullmatch(r"\d+(\.\d+)?", value):
            self.take()
            return float(value)
        if default is None:
            raise QueryError("invalid query: a number is expected")
        return default

    def boosted(self, node):
        if self.peek()[:2] == ("op", "^"):
            self.take()
            return replace(node, boost=node.boost * self.number())
        return node


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text)


def parse(query: str, pattern: str = SIMPLE) -> Group:
    """The query's tree; an invalid one raises QueryError."""
    p = _Parser(query, pattern)
    node = p.group("text", False)
    if p.i < len(p.items):
        raise QueryError(f"invalid query: unexpected {p.peek()[1]}")
    return node


def terms_by_field(node) -> dict[str, list[str]]:
    """The terms of the token columns that need statistics."""
    out: dict[str, list[str]] = {}
    todo = [node]
    while todo:
        x = todo.pop()
        if isinstance(x, Group):
            todo += [n for _, n in x.clauses]
        elif x.kind in ("term", "phrase") and x.name in TOKENS:
            out.setdefault(TOKENS[x.name], []).extend(x.words)
    return out


def _leaf(x: Leaf, stats: dict[str, bm25.FieldStats]) -> tuple[Column, Column]:
    no = F.lit(False), F.lit(0.0)
    flat = F.lit(float(x.boost))
    if x.kind == "all":
        return F.lit(True), flat
    if x.name in KEYWORDS:
        col = F.col(KEYWORDS[x.name]).cast("string")
        tests, exact = (lambda f: f(col)), True
    elif x.name in TOKENS:
        name = TOKENS[x.name]
        tests, exact = (lambda f: F.exists(F.col(name), f)), False
    else:
        return no
    if x.kind in ("term", "phrase"):
        if not x.words:
            return no
        if exact:
            return (tests(lambda c: c == x.words[0]), flat) if len(x.words) == 1 else no
        s = stats[name]
        if x.kind == "term":
            return F.array_contains(name, x.words[0]), bm25.term_score(name, x.words[0], s, x.boost)
        found = near_count(F.col(name), list(x.words), int(x.amount))
        # Places are looked for only in rows that have all words.
        found = F.when(reduce(lambda a, b: a & b, (F.array_contains(name, w) for w in x.words)), found).otherwise(0)
        weight = reduce(lambda a, b: a + b, (bm25.idf(s, w) for w in x.words))
        return found > 0, F.when(found > 0, x.boost * weight * bm25.saturation(found, F.size(name), s.mean)).otherwise(0.0)
    if x.kind == "prefix":
        match = tests(lambda c: c.startswith(x.pattern))
    elif x.kind == "wildcard":
        rx = "".join(".*" if p == "*" else "." if p == "?" else re.escape(unescape(p)) for p in re.findall(r"\\.|.", x.pattern))
        match = tests(lambda c: c.rlike(f"^(?:{rx})$"))
    elif x.kind == "regex":
        match = tests(lambda c: c.rlike(f"^(?:{x.pattern})$"))
    elif x.kind == "fuzzy":
        match = tests(lambda c: F.levenshtein(c, F.lit(x.words[0])) <= int(x.amount))
    else:

        def inside(c: Column) -> Column:
            low = F.lit(True) if x.low is None else (c >= x.low if x.low_in else c > x.low)
            return low & (F.lit(True) if x.high is None else (c <= x.high if x.high_in else c < x.high))

        match = tests(inside)
    return match, F.when(match, flat).otherwise(0.0)


def columns(node, stats: dict[str, bm25.FieldStats]) -> tuple[Column, Column]:
    """(matches, score) of a tree."""
    if isinstance(node, Leaf):
        return _leaf(node, stats)
    parts = [(o, *columns(n, stats)) for o, n in node.clauses]
    need = [m for o, m, _ in parts if o == "+"]
    may = [m for o, m, _ in parts if o == ""]
    ban = [m for o, m, _ in parts if o == "-"]
    if not need and not may:
        return F.lit(False), F.lit(0.0)  # prohibited clauses alone match nothing
    match = reduce(lambda a, b: a & b, need) if need else reduce(lambda a, b: a | b, may)
    for m in ban:
        match = match & ~m
    score = reduce(lambda a, b: a + b, (F.when(m, s).otherwise(0.0) for o, m, s in parts if o != "-"))
    return match, score * node.boost


def compiled(chunks: DataFrame, query: str, pattern: str = SIMPLE) -> tuple[Column, Column]:
    """(matches, score) of a query text over chunks, with the collection's statistics for its terms."""
    node = parse(query, pattern)
    return columns(node, bm25.collection_stats(chunks, terms_by_field(node)))


def matching(chunks: DataFrame, match: Column, score: Column, *keep: str) -> DataFrame:
    """keep and score of the rows that match.

    Both come out of a generator, which the optimiser doesn't look through: a filter on them would be moved below the token columns, which
    would have a row's tokens made anew for every mention of them in it."""
    rows = chunks.select(*keep, F.explode(F.array(F.struct(match.alias("hit"), score.alias("score")))).alias("r"))
    return rows.where("r.hit").select(*keep, "r.score")
