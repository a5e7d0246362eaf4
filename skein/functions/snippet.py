"""Snippets: the best passage of a long hit, cut to a window around its first marked term. All built-in expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Texts longer than this get a snippet; the window's width; how much of a text passages are taken from.
MIN_LENGTH, WIDTH, REACH = 900, 300, 10_000
#: Private-use marks around terms until the window is cut.
OPEN, CLOSE = "", ""


def sentences(text: Column) -> Column:
    cut = F.regexp_replace(F.substring(text, 1, REACH), r"([.!?])\s+", "$1\u0001")
    return F.split(cut, "\u0001")


def marked(text: Column, terms: list[str]) -> Column:
    """The text with whole-word occurrences of the terms between marks."""
    any_term = "|".join(re.escape(t) for t in sorted(terms, key=lambda t: (-len(t), t)))
    return F.regexp_replace(text, rf"(?iu)(?<![\p{{L}}\p{{N}}_])({any_term})(?![\p{{L}}\p{{N}}_])", f"{OPEN}$1{CLOSE}")


def best_passage(text: Column, terms: list[str]) -> Column:
    """The sentence with most marked terms, the first of equals, marked."""
    scored = F.transform(sentences(text), lambda s, i: F.struct((F.size(F.split(marked(s, terms), OPEN)) - 1).alias("n"), (-i).alias("at"), marked(s, terms).alias("s")))
    return F.array_max(scored)["s"]


def window(passage: Column) -> Column:
    """At most WIDTH characters, centred on the first mark, with dots at cut edges; marks become **."""
    n, at = F.length(passage), F.instr(passage, OPEN)
    start = F.greatest(F.lit(0), F.greatest(at, F.lit(1)) - 1 - WIDTH // 2)
    end = F.least(n, start + WIDTH)
    cut = F.concat(F.when(start > 0, "... ").otherwise(""), F.substring(passage, start + 1, end - start), F.when(end < n, " ...").otherwise(""))
    return F.regexp_replace(F.when(n <= WIDTH, passage).otherwise(cut), f"[{OPEN}{CLOSE}]", "**")


def snippet(text: Column, terms: list[str], matches_text: Column, full_text: bool = False) -> tuple[Column, Column]:
    """(shown text, truncated): long texts with a marked term within REACH are cut, all others stay whole."""
    if full_text or not terms:
        return text, F.lit(False)
    passage = best_passage(text, terms)
    cut = F.when((F.length(text) > MIN_LENGTH) & matches_text, F.instr(passage, OPEN) > 0).otherwise(False)
    return F.when(cut, window(passage)).otherwise(text), cut
