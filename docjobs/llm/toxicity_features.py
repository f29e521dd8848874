"""Features of one text for the toxicity model: what runs in Python workers, apart from what needs Spark's library."""

from __future__ import annotations

import math
import re
from collections import Counter

import ahocorasick
import numpy as np
import pyarrow as pa

#: Lengths of the word beginnings that may enter the learned lexicon.
PREFIXES = (4, 5, 6, 8)
#: Common insults, and words of address in the languages of the corpus.
INSULTS = "idiot moron stupid scum trash loser pathetic worthless disgusting clown dumb imbecile bastard bitch asshole fuck shit retard whore vermin".split()
SECOND_PERSON = "you your yours yourself u ur du dich dir dein deine ihr euch euer tu te toi ton ta tes vous votre vos usted ustedes tú ti tus vosotros os".split()
LEET = str.maketrans("013457@$", "oieastas")

FEATURES = ("insults", "learned", "learned_weight", "most_weight", "hits_in_100_words", "near_you", "capitals", "capital_words", "exclamations", "questions", "punctuation", "digits", "leet_hits", "spaced_hits", "mixed_words", "log_words")

_LETTERS = re.compile(r"[^\W\d_]+")
_SPACED = re.compile(r"(?<!\w)\w(?:[.*_\- ]\w){3,}(?!\w)")
_MIXED = re.compile(r"[^\W\d_]+[0-9@$*]+[^\W\d_]+")
_CAPS = re.compile(r"(?<![^\W\d_])[A-Z]{3,}(?![^\W\d_])")
_YOU = re.compile(r"(?<!\w)(?:" + "|".join(SECOND_PERSON) + r")(?!\w)")


def _table(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(c) for c in chars]] = True
    return out


_ODD, _WHITE, _BETWEEN, _UPPER = _table("0123456789@$*"), _table(" \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f"), _table(".*_- "), _table("ABCDEFGHIJKLMNOPQRSTUVWXYZ")


class Lexicon:
    """Finds words that begin with an entry; an entry of a list of whole words also ends with the word."""

    def __init__(self, learned: dict[str, float]):
        self.auto = ahocorasick.Automaton()
        for w in INSULTS:
            self.auto.add_word(w, (w, 1, learned.get(w, 0.0)))
        for w, weight in learned.items():
            if w not in INSULTS:
                self.auto.add_word(w, (w, 0, weight))
        self.auto.make_automaton()

    def hits(self, low: str) -> list[tuple[int, int, float]]:
        """(start, 1 if a fixed insult, weight) of each word hit; the entry of the largest weight speaks."""
        found: dict[int, tuple[int, float]] = {}
        for end, (w, fixed, weight) in self.auto.iter(low):
            start = end - len(w) + 1
            if start and low[start - 1].isalpha():
                continue
            if fixed and end + 1 < len(low) and low[end + 1].isalpha() and not weight:
                continue
            old = found.get(start, (0, 0.0))
            found[start] = (max(old[0], fixed), max(old[1], weight))
        return [(a, *x) for a, x in sorted(found.items())]


def _odd_tokens(raw: np.ndarray, low: bytes) -> list[str]:
    """The tokens with a digit or sign that may stand for a letter: what obfuscation leaves of a text, mostly nothing."""
    at = np.flatnonzero(_ODD[raw])
    if not len(at):
        return []
    white = np.concatenate(([-1], np.flatnonzero(_WHITE[raw]), [len(raw)]))
    which = np.unique(np.searchsorted(white, at))
    return [low[a + 1 : z].decode() for a, z in zip(white[which - 1].tolist(), white[which].tolist())]


def _may_be_spaced(low: str) -> bool:
    """Whether a single character stands between separators three times in a row anywhere."""
    code = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), np.uint32)
    sep = _BETWEEN[np.minimum(code, 255)]
    return len(sep) > 4 and bool((sep[:-4] & sep[2:-2] & sep[4:]).any())


def features(text: str | None, lexicon: Lexicon) -> list[float]:
    """The dense features of one whole text, in the order of FEATURES.

    Expressions that read slowly run only where a look at the bytes does not exclude them.
    """
    text = text or ""
    low, n = text.lower(), max(1, len(text))
    words = max(1, text.count(" ") + text.count("\n") + (1 if text else 0))
    hits = lexicon.hits(low)
    near = sum(1 for a, _, _ in hits if _YOU.search(low, max(0, a - 40), min(len(low), a + 60)))
    best, left = 0, 0
    for k, (a, _, _) in enumerate(hits):
        while a - hits[left][0] > 600:
            left += 1
        best = max(best, k - left + 1)
    small = low.encode()
    odd = _odd_tokens(np.frombuffer(small, np.uint8), small)
    leet = sum(len({a for a, *_ in lexicon.hits(t.translate(LEET))} - {a for a, *_ in lexicon.hits(t)}) for t in odd)
    spaced = sum(1 for m in _SPACED.finditer(low) if lexicon.hits(re.sub(r"[.*_\- ]", "", m[0]))) if _may_be_spaced(low) else 0
    raw = np.frombuffer(text.encode(), np.uint8)
    count, upper = np.bincount(raw, minlength=256), _UPPER[raw]
    letters, capitals = count[65:91].sum() + count[97:123].sum(), count[65:91].sum()
    marks = count[33:48].sum() + count[58:65].sum() + count[91:97].sum() + count[123:127].sum()
    weights = [w for _, _, w in hits]
    return [
        sum(f for _, f, _ in hits) / words,
        sum(1 for w in weights if w > 0) / words,
        sum(weights) / words,
        max(weights, default=0.0),
        float(best),
        near / words,
        float(capitals / max(1, letters)),
        len(_CAPS.findall(text)) / words if (upper[:-2] & upper[1:-1] & upper[2:]).any() else 0.0,
        float(count[33] / n),
        float(count[63] / n),
        float(marks / n),
        float(count[48:58].sum() / n),
        leet / words,
        float(spaced),
        sum(len(_MIXED.findall(t)) for t in odd) / words,
        math.log(words),
    ]


def feature_rows(learned: dict[str, float], keep_text: bool):
    """(text, rest) -> (rest, text if kept, features)"""

    def rows(batches):
        lexicon = Lexicon(learned)
        for batch in batches:
            x = pa.array([features(t, lexicon) for t in batch.column(0).to_pylist()], pa.list_(pa.float64()))
            text = [batch.column(0)] if keep_text else []
            yield pa.RecordBatch.from_arrays([batch.column(1), *text, x], names=["rest", *(["text"] if keep_text else []), "x"])

    return rows


def term_rows(batches):
    """Documents of either label that hold a word beginning, counted per task."""
    count: dict[int, Counter] = {0: Counter(), 1: Counter()}
    for batch in batches:
        for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            words = set(_LETTERS.findall((text or "").lower()))
            terms = {w[:k] for w in words for k in PREFIXES if len(w) >= k}
            count[int(y > 0)].update(terms)
            count[int(y > 0)][""] += 1
    terms = list(count[0].keys() | count[1].keys())
    yield pa.RecordBatch.from_pydict({"term": pa.array(terms, pa.string()), "neg": pa.array([count[0][t] for t in terms], pa.int64()), "pos": pa.array([count[1][t] for t in terms], pa.int64())})
