"""Comments of source code as chunks: C-like languages and Pascal."""

from __future__ import annotations

from bisect import bisect_right

C_LIKE = frozenset({"java", "go", "rust", "swift"})
KINDS = {"java": "java", "pas": "pascal", "pp": "pascal", "go": "go", "rs": "rust", "swift": "swift"}


class _Lines:
    def __init__(self, text: str):
        self.starts = [0, *(i + 1 for i, c in enumerate(text) if c == "\n")]

    def of(self, offset: int) -> int:
        return bisect_right(self.starts, offset)


def clean_block(body: str) -> str:
    """Stripped lines of a block comment without one leading asterisk each; blank lines go."""
    lines = (x.strip() for x in body.split("\n"))
    return "\n".join(y for x in lines if (y := (x[1:].strip() if x.startswith("*") else x)))


class _Run:
    """Line comments that follow each other make one chunk; empty ones don't count and don't end it."""

    def __init__(self):
        self.lines: list[str] = []
        self.start = 0

    def add(self, text: str, line: int) -> None:
        if text:
            self.start = self.start or line
            self.lines.append(text)

    def flush(self, out: list) -> None:
        if self.lines:
            out.append(("\n".join(self.lines), self.start))
        self.lines, self.start = [], 0


def _skip_literal(text: str, i: int) -> int:
    """The place after the literal that begins at i; a quote ' ends at the line's end at the latest."""
    quote, i = text[i], i + 1
    while i < len(text):
        c = text[i]
        if c == "\\":
            i += 2
            continue
        if c == quote or (c == "\n" and quote == "'"):
            return i + (c == quote)
        i += 1
    return len(text)


def _c_like(text: str) -> list[tuple[str, int]]:
    out: list[tuple[str, int]] = []
    at, run, i, blank = _Lines(text), _Run(), 0, True  # blank: nothing but space in this line so far
    while i < len(text):
        c = text[i]
        if text.startswith("//", i):
            end = text.find("\n", i)
            end = len(text) if end < 0 else end
            if not blank:
                run.flush(out)
            run.add(text[i + 2 : end].strip(), at.of(i))
            i, blank = end + 1, True
            continue
        if text.startswith("/*", i):
            run.flush(out)
            end = text.find("*/", i + 2)
            body = clean_block(text[i + 2 : end if end >= 0 else len(text)])
            if body:
                out.append((body, at.of(i)))
            i = len(text) if end < 0 else end + 2
            continue
        if c == "\n":
            if blank:
                run.flush(out)
            blank = True
        elif not c.isspace():
            run.flush(out)
            blank = False
            if c in "\"'":
                i = _skip_literal(text, i)
                continue
        i += 1
    run.flush(out)
    return out


def _pascal(text: str) -> list[tuple[str, int]]:
    out: list[tuple[str, int]] = []
    at, run, i = _Lines(text), _Run(), 0
    while i < len(text):
        c = text[i]
        if text.startswith("//", i):
            end = text.find("\n", i)
            end = len(text) if end < 0 else end
            run.add(text[i + 2 : end].strip(), at.of(i))
            i = end
        elif c == "{" or text.startswith("(*", i):
            run.flush(out)
            opening, closing = (1, "}") if c == "{" else (2, "*)")
            end = text.find(closing, i + opening)
            body = clean_block(text[i + opening : end if end >= 0 else len(text)])
            if body:
                out.append((body, at.of(i)))
            i = len(text) if end < 0 else end + len(closing)
        elif c == "'":
            run.flush(out)
            end = i + 1
            while end < len(text) and text[end] != "\n":
                if text[end] == "'":
                    if not text.startswith("''", end):
                        break
                    end += 1
                end += 1
            i = end + 1
        else:
            if not c.isspace():
                run.flush(out)
            i += 1
    run.flush(out)
    return out


def extract(kind: str, text: str) -> list[tuple[str, int]]:
    """(text, start line) of the comments; an unknown kind raises ValueError."""
    kind = kind.lower()
    if kind in C_LIKE:
        return _c_like(text)
    if kind == "pascal":
        return _pascal(text)
    raise ValueError(f"unknown source kind: {kind}")
