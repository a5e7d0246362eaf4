"""Markdown as chunks: one per top-level heading section, with its breadcrumb, start line and front matter.

A small block parser: front matter, ATX and setext headings, fenced and indented code, quotes, lists, thematic breaks, HTML,
paragraphs; headings inside quotes or lists don't split. Bodies are plain text."""

from __future__ import annotations

import json
import re
from typing import Any, NamedTuple

import yaml

_ATX = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
_SETEXT = re.compile(r" {0,3}(=+|-+)[ \t]*$")
_FENCE = re.compile(r" {0,3}(`{3,}|~{3,})([^`]*)$")
_RULE = re.compile(r" {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")
_ITEM = re.compile(r" {0,3}([-+*]|\d{1,9}[.)])(?:[ \t]+|$)")
_QUOTE = re.compile(r" {0,3}>[ ]?")


class Chunk(NamedTuple):
    heading_path: list[str]
    text: str
    start_line: int
    frontmatter: dict[str, Any]


def split_frontmatter(text: str) -> tuple[str | None, str, int]:
    """(front matter, rest, lines consumed); without a closing rule all is rest."""
    lines = text.split("\n")
    if lines[0].strip() != "---":
        return None, text, 0
    for k in range(1, len(lines)):
        if lines[k].strip() == "---":
            return "\n".join(lines[1:k]), "\n".join(lines[k + 1 :]), k + 1
    return None, text, 0


def parse_frontmatter(text: str) -> dict[str, Any]:
    """The YAML mapping; anything else is an empty one, and nothing raises."""
    try:
        value = yaml.safe_load(text)
    except (yaml.YAMLError, ValueError):
        return {}
    return {str(k): v for k, v in value.items()} if isinstance(value, dict) else {}


def frontmatter_json(value: dict[str, Any]) -> str | None:
    return json.dumps(value, ensure_ascii=False, default=str) if value else None


def inline(text: str) -> str:
    """Plain text of inline Markdown: emphasis marks go, code and link texts are quoted, targets follow in brackets."""
    held: list[str] = []

    def hold(s: str) -> str:
        held.append(s)
        return f"\x00{len(held) - 1}\x00"

    # Each pattern costs tens of nanoseconds a character even where it finds nothing: it runs only where its marks stand.
    if "`" in text:
        text = re.sub(r"(`+)(?!`)(.+?)(?<!`)\1(?!`)", lambda m: hold('"' + m[2].strip().replace("\n", " ") + '"'), text, flags=re.S)
    if "\\" in text:
        text = re.sub(r"\\([!-/:-@\[-`{-~])", lambda m: hold(m[1]), text)
    if "<" in text:
        text = re.sub(r"<((?:https?|mailto|ftp):[^\s<>]*)>", lambda m: hold(f'"{m[1]}" ({m[1]})'), text)
    target = r"\(\s*<?([^\s()<>]*)>?(?:\s+[\"']([^\"']*)[\"'])?\s*\)"

    def link(m: re.Match) -> str:
        where = ": ".join(x for x in (m[3], m[2]) if x)
        return (f'"{m[1]}"' if m[1] else "") + (f" ({where})" if where else "")

    if "](" in text:
        text = re.sub(r"!?\[((?:[^\[\]]|\[[^\[\]]*\])*)\]" + target, link, text)
    for mark in ("***", "**", "*"):
        if mark in text:
            q = re.escape(mark)
            text = re.sub(q + r"(?=\S)(.+?)(?<=\S)" + q, r"\1", text, flags=re.S)
    for mark in ("___", "__", "_"):
        if mark in text:
            text = re.sub(rf"(?<!\w){mark}(?=\S)(.+?)(?<=\S){mark}(?!\w)", r"\1", text, flags=re.S)
    while "\x00" in text:
        new = re.sub("\x00(\\d+)\x00", lambda m: held[int(m[1])], text)
        if new == text:
            break
        text = new
    return unpadded(text)


def unpadded(text: str) -> str:
    """The text without blanks at line breaks, nor the backslash of a hard break: [ \\t]*\\\\?\\n[ \\t]* as a line break."""
    if "\n" not in text:
        return text
    *lines, last = text.split("\n")
    out = [(x[:-1] if x.endswith("\\") else x).rstrip(" \t") for x in (lines[0], *(x.lstrip(" \t") for x in lines[1:]))]
    return "\n".join([*out, last.lstrip(" \t")])


def blocks(lines: list[str]) -> list[tuple[str, Any, int]]:
    """(kind, content, line index): heading (level, text) or text."""
    out: list[tuple[str, Any, int]] = []
    i, n = 0, len(lines)
    while i < n:
        line = lines[i]
        if not line.strip():
            i += 1
            continue
        if m := _FENCE.match(line):
            j = i + 1
            while j < n and not re.match(rf" {{0,3}}{re.escape(m[1][0])}{{{len(m[1])},}}[ \t]*$", lines[j]):
                j += 1
            out.append(("text", "\n".join(lines[i + 1 : j]), i))
            i = j + 1
        elif line.startswith(("    ", "\t")):
            j = i
            while j < n and (lines[j].startswith(("    ", "\t")) or not lines[j].strip()):
                j += 1
            out.append(("text", "\n".join(re.sub(r"^(?: {4}|\t)", "", x) for x in lines[i:j]).rstrip(), i))
            i = j
        elif m := _ATX.match(line):
            out.append(("heading", (len(m[1]), inline((m[2] or "").strip())), i))
            i += 1
        elif _RULE.match(line):
            out.append(("text", "***", i))
            i += 1
        elif _QUOTE.match(line):
            j = i
            while j < n and lines[j].strip() and (_QUOTE.match(lines[j]) or not _starts_block(lines[j])):
                j += 1
            inner = blocks([_QUOTE.sub("", x, count=1) for x in lines[i:j]])
            out.append(("text", "«" + _plain(inner) + "»", i))
            i = j
        elif m := _ITEM.match(line):
            j, items = i, []
            while j < n:
                start = _ITEM.match(lines[j])
                if not start or (start[1][-1] != m[1][-1]):
                    break
                width, k = start.end(), j + 1
                body = [lines[j][width:]]
                while k < n and (not lines[k].strip() or lines[k].startswith(" " * min(width, 4)) or not _starts_block(lines[k]) and lines[k - 1].strip()):
                    if not lines[k].strip() and not (k + 1 < n and lines[k + 1].startswith(" " * min(width, 4))):
                        break
                    body.append(lines[k][width:] if lines[k].startswith(" " * width) else lines[k].lstrip())
                    k += 1
                items.append(f"{start[1]} " + _plain(blocks(body)))
                while k < n and not lines[k].strip():
                    k += 1
                j = k
            out.append(("text", "\n".join(items), i))
            i = j
        else:
            j = i + 1
            html = line.lstrip().startswith("<")
            while j < n and lines[j].strip() and (html or not (_starts_block(lines[j]) or _SETEXT.match(lines[j]))):
                j += 1
            if not html and j < n and (m := _SETEXT.match(lines[j])):
                out.append(("heading", (1 if m[1][0] == "=" else 2, inline("\n".join(x.strip() for x in lines[i:j]))), i))
                i = j + 1
            else:
                body = "\n".join(lines[i:j])
                out.append(("text", body if html else inline("\n".join(x.strip() for x in lines[i:j])), i))
                i = j
    return out


def _starts_block(line: str) -> bool:
    return bool(_ATX.match(line) or _FENCE.match(line) or _RULE.match(line) or _QUOTE.match(line) or _ITEM.match(line))


def _plain(parts: list[tuple[str, Any, int]]) -> str:
    return "\n".join((c[1] if k == "heading" else c).strip() for k, c, _ in parts)


def chunks(text: str) -> list[Chunk]:
    """The sections of a file in order; a blank preamble gives none, a heading without a body gives an empty one."""
    front, rest, used = split_frontmatter(text.replace("\r\n", "\n"))
    meta = parse_frontmatter(front) if front is not None else {}
    out = []
    if front is not None and front.strip():
        out.append(Chunk(["frontmatter"], front.strip(), 1, meta))
    path: list[tuple[int, str]] = []
    body: list[str] = []
    start = 1 + used

    def flush() -> None:
        joined = "\n\n".join(x for x in body if x)
        if path or joined.strip():
            out.append(Chunk([h for _, h in path], joined, start, meta))

    for kind, content, line in blocks(rest.split("\n")):
        if kind == "heading":
            flush()
            body = []
            while path and path[-1][0] >= content[0]:
                path.pop()
            path.append(content)
            start = line + 1 + used
        else:
            body.append(content.strip())
    flush()
    return out
