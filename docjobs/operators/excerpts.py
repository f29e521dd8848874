"""Where in a document a claim stands that is not there word for word: the span at the smallest edit distance."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docjobs.sources.shared import small_batches

#: Length of the seeds, and the share of a claim's length that its edit distance to a span may have.
SEED, SHARE = 4, 0.2
#: Claims of one document that are sought in one row.
TOGETHER = 64

SPAN = T.StructType([T.StructField(c, T.IntegerType()) for c in ("start", "end", "distance")])


def ends(claim: str, text: str, most: int, anchored: bool = False) -> tuple[int, int] | None:
    """(distance, end) of the span of text nearest to the claim, the first to end of equal ones; None beyond most.

    Myers' bit-vector columns of the edit matrix: one bit for each character of the claim, one step for each of the text.
    Anchored spans start where the text does.
    """
    m, bits = len(claim), {}
    for i, c in enumerate(claim):
        bits[c] = bits.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score, best = full, 0, m, (m, 0)
    for at, c in enumerate(text, 1):
        eq = bits.get(c, 0)
        across = (((eq & plus) + plus) ^ plus) | eq | minus
        up, down = minus | ~(across | plus) & full, plus & across
        score += bool(up & top) - bool(down & top)
        up, down = (up << 1 | anchored) & full, down << 1 & full
        below = eq | minus
        plus, minus = down | ~(below | up) & full, up & below
        if score < best[0]:
            best = (score, at)
    return best if best[0] <= most else None


def _grams(text: str) -> np.ndarray:
    """A number for the seed at each place of a text; equal seeds have equal numbers."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n = max(0, len(codes) - SEED + 1)
    grams = np.zeros(n, np.uint64)
    for i in range(SEED):
        grams = grams * np.uint64(0x9E3779B97F4A7C15) + codes[i : i + n]
    return grams


class Seeds:
    """Where the seeds of a text stand; looked up for many claims."""

    def __init__(self, text: str):
        self.text, grams = text, _grams(text)
        self.order = np.argsort(grams)
        self.grams = grams[self.order]

    def _regions(self, claim: str, most: int, low: list[int], high: list[int]) -> list[tuple[int, int]]:
        """Stretches of the text that hold every span within most edits: of most + 1 pieces of the claim, one is left whole."""
        m, found = len(claim), set()
        for k in range(most + 1):
            lo, hi = k * m // (most + 1), (k + 1) * m // (most + 1)
            if low[lo] < high[lo]:
                piece = claim[lo:hi]
                found.update(p - lo for p in self.order[low[lo] : high[lo]].tolist() if self.text.startswith(piece, p))
        out: list[tuple[int, int]] = []
        for start in sorted(found):
            a, b = max(0, start - most), min(len(self.text), start + m + most)
            if out and a <= out[-1][1]:
                out[-1] = (out[-1][0], max(b, out[-1][1]))
            else:
                out.append((a, b))
        return out

    def span(self, claim: str, share: float = SHARE) -> tuple[int, int, int] | None:
        """start, end, distance of the nearest span; of equal ones the first to end, then the shortest. None beyond the share."""
        limit = min(int(len(claim) * share), len(claim) // SEED - 1)
        if limit < 0:
            return None
        own = _grams(claim)
        places = [np.searchsorted(self.grams, own, side).tolist() for side in ("left", "right")]
        whole = self._regions(claim, 0, *places)
        if whole:  # word for word
            return whole[0][0], whole[0][0] + len(claim), 0
        most = min(1, limit)
        while 0 < most <= limit:
            near = [(d[0], a + d[1]) for a, b in self._regions(claim, most, *places) if (d := ends(claim, self.text[a:b], limit))]
            distance, end = min(near, default=(limit + 1, 0))
            if distance <= most:  # nothing within most is outside the stretches
                back = ends(claim[::-1], self.text[max(0, end - len(claim) - distance) : end][::-1], distance, anchored=True)
                return end - back[1], end, distance
            more = limit if most < limit < 2 * most + 1 else 2 * most + 1
            most = distance if distance <= limit else more  # a span that is known bounds the nearest one
        return None


@F.pandas_udf(T.ArrayType(SPAN))
def spans(claims: pd.Series, text: pd.Series) -> pd.Series:
    """The spans of some claims in one text, whose seeds are looked up for all of them; null where there is none."""
    out = []
    for own, t in zip(claims, text):
        seeds = Seeds(t or "")
        found = [seeds.span(c) if c else None for c in own]
        out.append([None if s is None else dict(zip(("start", "end", "distance"), s)) for s in found])
    return pd.Series(out)


def with_excerpts(claims: DataFrame, docs: DataFrame) -> DataFrame:
    """claims (doc_id, ord, value) in docs (doc_id, text) -> doc_id, ord, value, start, distance, excerpt.

    The excerpt is the span of the text at the smallest edit distance to the value, of equal ones the first to end, then the
    shortest; start counts code points from 0. All three are null where the distance would exceed ``SHARE`` of the value's
    length, or leave it no seed of ``SEED`` characters, and for values and texts that are null or empty. A value that stands in
    the text word for word is found with distance 0. Claims of a document that is not in docs are not returned.

    Claims are gathered by document, ``TOGETHER`` at a time, so that a text is indexed once for them; only the stretches
    around seeds that the text shares with a claim are compared. Batches are bounded in bytes, since texts go to Python whole.
    """
    small_batches(docs.sparkSession)
    some = claims.groupBy("doc_id", F.floor(F.col("ord") / TOGETHER).alias("part")).agg(F.collect_list(F.struct("ord", "value")).alias("claims"))
    texts = docs.select("doc_id", F.make_valid_utf8(F.coalesce("text", F.lit(""))).alias("text"))
    values = F.transform("claims", lambda c: F.make_valid_utf8(c["value"]))
    found = some.join(texts, "doc_id").withColumn("spans", spans(values, F.col("text")))
    rows = found.select("doc_id", F.explode(F.transform(F.arrays_zip("claims", "spans"), lambda x: F.struct(x["claims"].alias("claim"), x["spans"].alias("span"), F.substring(F.col("text"), x["spans"]["start"] + 1, x["spans"]["end"] - x["spans"]["start"]).alias("excerpt")))).alias("x"))
    return rows.select("doc_id", "x.claim.ord", "x.claim.value", "x.span.start", "x.span.distance", "x.excerpt")
