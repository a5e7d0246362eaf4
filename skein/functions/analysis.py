"""Text analysis as Column expressions, the same for indexing and queries."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Runs of letters, digits and underscores.
SIMPLE = r"[\p{L}\p{N}_]+"
#: Keeps don't, 3.14 and guide.md whole and gives one token per ideograph; close to Unicode's word rules.
WORDS = r"[\p{IsHan}\p{IsHiragana}]|[\p{L}\p{M}\p{N}_&&[^\p{IsHan}\p{IsHiragana}]]+(?:['’.:][\p{L}\p{N}_&&[^\p{IsHan}\p{IsHiragana}]]+)*"


def tokens(text: Column, pattern: str = SIMPLE) -> Column:
    """Lower-cased tokens; null text has none."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(pattern), F.lit(0))


def query_tokens(text: str, pattern: str = SIMPLE) -> list[str]:
    """The same tokens of a query text, on the driver."""
    if pattern == SIMPLE:
        return [t for t in re.findall(r"\w+", text.lower()) if t]
    ideograph = "ぁ-ゟ㐀-䶿一-鿿豈-﫿"
    word = f"(?:(?![{ideograph}])\\w)+"
    return re.findall(f"[{ideograph}]|{word}(?:['’.:]{word})*", text.lower())


def text_tokens(query: str, pattern: str = SIMPLE) -> list[str]:
    """A TEXT query's distinct terms, symbols being plain text."""
    return list(dict.fromkeys(query_tokens(query, pattern)))


def breadcrumb(heading_path: Column) -> Column:
    return F.array_join(heading_path, " / ")


def heading_split(heading: Column) -> Column:
    return F.when(heading == "", F.array().cast("array<string>")).otherwise(F.split(heading, " / "))


def location(path: Column, line: Column) -> Column:
    return F.when(line <= 0, path).otherwise(F.concat(path, F.lit(":"), line.cast("string")))


def windows(toks: Column, size: int) -> Column:
    """array<array<string>>: at every place the next `size` tokens, with null past the end.

    Lambdas over it refer to their own element alone; one that refers to the token column would have the tokens computed anew for
    every element wherever the optimiser inlines the column."""
    shifted = F.arrays_zip(*(F.slice(toks, k + 1, F.size(toks) + 1) for k in range(size)))
    return F.transform(shifted, lambda x: F.array(*(x[str(k)] for k in range(size))))


def places(found: Column) -> Column:
    """0-based places of true in an array<boolean>."""
    return F.array_compact(F.transform(found, lambda x, i: F.when(x, i)))


def phrase_positions(toks: Column, phrase: list[str]) -> Column:
    """0-based places where the tokens hold the phrase."""
    asked = F.array(*map(F.lit, phrase))
    return places(F.transform(windows(toks, len(phrase)), lambda w: w == asked))


def near_positions(toks: Column, words: list[str], slop: int) -> Column:
    """0-based places of the first word from where the others follow in order, with at most `slop` words between in all."""
    size = len(words) + slop

    def follows(w: Column) -> Column:
        end = F.lit(0)
        for word in words[1:]:
            at = F.array_position(F.slice(w, end + 2, F.lit(size)), word)
            end = F.when(at > 0, end + at.cast("int"))
        return (w[0] == words[0]) & F.coalesce(end < size, F.lit(False))

    return places(F.transform(windows(toks, size), follows))


#: Between joined tokens: a noncharacter, which no token pattern takes.
BETWEEN = "\uffff"
#: Ways to spread the words between over the places between, up to which a proximity is one regular expression.
MOST_WAYS = 500


def near_count(toks: Column, words: list[str], slop: int = 0) -> Column:
    """The number of near_positions. The joined tokens are searched by one regular expression, which costs a few nanoseconds a character instead of
    microseconds a token; a proximity with very many ways to spread its slop goes by windows."""
    if len(words) < 2 or math.comb(slop + len(words) - 2, len(words) - 2) > MOST_WAYS:
        return F.size(near_positions(toks, words, slop))
    skip = f"(?:[^{BETWEEN}]*{BETWEEN})"

    def rest(k: int, left: int) -> str:
        word = re.escape(words[k]) + BETWEEN
        if k + 1 == len(words):
            return f"{skip}{{0,{left}}}{word}"
        return "(?:" + "|".join(f"{skip}{{{g}}}{word}{rest(k + 1, left - g)}" for g in range(left + 1)) + ")"

    joined = F.concat(F.lit(BETWEEN), F.array_join(toks, BETWEEN), F.lit(BETWEEN))
    return F.regexp_count(joined, F.lit(f"(?<={BETWEEN}){re.escape(words[0])}(?={BETWEEN}{rest(1, slop)})"))
