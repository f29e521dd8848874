"""Expressions over text that follow the string rules of Python, where documents were first processed."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space of Python's str: Unicode's, and four separators.
_SPACE = r"[\s\x1c-\x1f]"
#: Length of texts in which ``difflib`` leaves frequent characters out of its search.
POPULAR_FROM = 200
LINE_END = r"\r\n|[\n\r\x0B\f\x1c-\x1e\x85\x{2028}\x{2029}]"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"(?U)^{_SPACE}+|{_SPACE}+$", "")


def first_match(text: Column, pattern: str, group: int) -> Column:
    """The group of the first match, or null. The first match takes the rest of the text with it, so it is the only one; it is sought once."""
    return F.get(F.regexp_extract_all(text, F.lit(rf"(?U)(?:{pattern})[\s\S]*+"), F.lit(group)), 0)


def normalize_text(text: Column) -> Column:
    """Lower case, white space to single spaces, then only a-z, 0-9 and spaces; null is empty."""
    spaced = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), rf"(?U){_SPACE}+", " ")
    return F.trim(F.regexp_replace(spaced, "[^a-z0-9 ]", ""))


def _matched(a: str, b: str) -> int:
    """How many characters the matching blocks of two texts have: the longest common stretch, first in a, then in b, and so on beside it.

    What ``difflib`` finds where no character of b is popular, by looks for stretches of a in b, each longer than the last found.
    """
    total, todo = 0, [(a, b, len(b))]
    while todo:
        x, y, most = todo.pop()
        n, best, at, start, end = len(x), 0, 0, 0, 1
        while end <= n:
            if x[start:end] in y:
                best, at = end - start, start
                if best == most:  # of what a longer stretch has left, none is longer than it
                    break
            else:
                start += 1
            end += 1
        if best:
            total += best
            found = y.find(x[at : at + best])
            if at and found:
                todo.append((x[:at], y[:found], best))
            if at + best < n and found + best < len(y):
                todo.append((x[at + best :], y[found + best :], best))
    return total


class Matcher:
    """Scores many claims against one text, of which the costly preparation is done once: ``difflib``'s ratio, times 100."""

    def __init__(self, text: str):
        self.text = text
        self.matcher = difflib.SequenceMatcher(None, "", text) if len(text) >= POPULAR_FROM else None

    def score(self, claim: str) -> float:
        if self.matcher is not None:
            self.matcher.set_seq1(claim)
            return self.matcher.ratio() * 100
        length = len(claim) + len(self.text)
        return 2.0 * _matched(claim, self.text) / length * 100 if length else 100.0


@F.pandas_udf(T.DoubleType())
def fuzzy_score(a: pd.Series, b: pd.Series) -> pd.Series:
    """Similarity of two texts, 0 to 100; null where either is null. Rows that follow one another with one text share its preparation."""
    matcher, out = None, []
    for x, y in zip(a, b):
        if x is None or y is None:
            out.append(None)
            continue
        if matcher is None or matcher.text != y:
            matcher = Matcher(y)
        out.append(matcher.score(x))
    return pd.Series(out, dtype="float64")


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def fuzzy_scores(claims: pd.Series, text: pd.Series) -> pd.Series:
    """The scores of some claims against one text; null for a null claim, and no text is prepared for nulls alone."""
    out = []
    for own, t in zip(claims, text):
        matcher, scores = None, []
        for c in own:
            if c is not None and matcher is None:
                matcher = Matcher(t)
            scores.append(None if c is None else matcher.score(c))
        out.append(scores)
    return pd.Series(out)
