"""Ordered differences of pages: the shortest edit script by lines, as hunks with line numbers.

Moved and repeated lines count, unlike in ``pages.compare_pages``. Pages meet by (pair_id, page_no); equal ones never reach
Python. A page that only one side has is one hunk. ``replay`` applies the hunks to the reference page with built-ins.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HUNKS = "array<struct<old_start: int, old_count: int, new_start: int, new_count: int, added: array<string>>>"


def _bend(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """A point on a shortest edit path from the start to the end of both, neither of its ends, found from both sides in linear space."""
    n, m = len(a), len(b)
    delta, most = n - m, (n + m + 1) // 2
    ahead, back = np.full(2 * most + 2, -1), np.full(2 * most + 2, -1)
    ahead[most + 1 if most + 1 < len(ahead) else 0] = back[most + 1 if most + 1 < len(back) else 0] = 0

    def run(p, q, x, y):
        while x < n and y < m and p[x] == q[y]:
            x, y = x + 1, y + 1
        return x

    ra, rb = a[::-1], b[::-1]
    for d in range(most + 1):
        for way, mine, other, p, q in ((0, ahead, back, a, b), (1, back, ahead, ra, rb)):
            for k in range(-d, d + 1, 2):
                if k < -m or k > n:
                    continue
                at = most + k
                x = mine[at + 1] if k == -d or (k != d and mine[at - 1] < mine[at + 1]) else mine[at - 1] + 1
                if x < 0 or x > n or x - k < 0 or x - k > m:
                    mine[at] = x
                    continue
                start = x
                x = run(p, q, int(x), int(x - k))
                mine[at] = x
                mirrored, reach = delta - k, d if way else d - 1
                if (delta % 2 == 1) == (way == 0) and -reach <= mirrored <= reach and other[most + mirrored] >= 0 and x + other[most + mirrored] >= n:
                    u, v = (int(start), int(start - k)) if way == 0 else (n - x, m - (x - k))
                    return u, v
    raise AssertionError("paths meet")


def matched(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of places of a longest common subsequence."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        p, q, s, t = todo.pop()
        while p < q and s < t and a[p] == b[s]:
            out.append((p, s))
            p, s = p + 1, s + 1
        while p < q and s < t and a[q - 1] == b[t - 1]:
            q, t = q - 1, t - 1
            out.append((q, t))
        if p < q and s < t:
            u, v = _bend(a[p:q], b[s:t])
            todo += [(p, p + u, s, s + v), (p + u, q, s + v, t)]
    return sorted(out)


def hunks(old: list[str], new: list[str]) -> list[tuple[int, int, int, int]]:
    """(first old line, old lines, first new line, new lines), lines from 1 on, of a shortest edit script.

    Lines that the other side lacks can't be matched, so they are left out of the search.
    """
    number: dict[str, int] = {}
    a, b = (np.array([number.setdefault(x, len(number)) for x in side], np.int64) for side in (old, new))
    in_a, in_b = np.flatnonzero(np.isin(a, b)), np.flatnonzero(np.isin(b, a))
    pairs = [(int(in_a[i]), int(in_b[j])) for i, j in matched(a[in_a], b[in_b])]
    out, i, j = [], 0, 0
    for p, q in [*pairs, (len(a), len(b))]:
        if p > i or q > j:
            out.append((i + 1, p - i, j + 1, q - j))
        i, j = p + 1, q + 1
    return out


def _hunk_rows(batches):
    for batch in batches:
        found = []
        for old, new in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            old, new = ([] if side is None else side.split("\n") for side in (old, new))
            found.append([{"old_start": i, "old_count": n, "new_start": j, "new_count": m, "added": new[j - 1 : j - 1 + m]} for i, n, j, m in hunks(old, new)])
        kind = pa.list_(pa.struct([*((c, pa.int32()) for c in ("old_start", "old_count", "new_start", "new_count")), ("added", pa.list_(pa.string()))]))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, kind)], names=["pair_id", "page_no", "hunks"])


def edit_scripts(ref: DataFrame, act: DataFrame) -> DataFrame:
    """ref, act (pair_id, page_no, text) -> pair_id, page_no, hunks, n_added, n_removed; a null text is an empty page."""
    text = lambda c: F.make_valid_utf8(F.coalesce("text", F.lit(""))).alias(c)
    both = ref.select("pair_id", "page_no", text("l")).join(act.select("pair_id", "page_no", text("r")), ["pair_id", "page_no"], "full")
    same = F.coalesce(F.col("l") == F.col("r"), F.lit(False))
    kind = dict(both.dtypes)
    changed = both.filter(~same).mapInArrow(_hunk_rows, f"pair_id {kind['pair_id']}, page_no {kind['page_no']}, hunks {HUNKS}")
    rows = changed.unionByName(both.filter(same).select("pair_id", "page_no", F.array().cast(HUNKS).alias("hunks")))
    total = lambda c: F.aggregate("hunks", F.lit(0), lambda n, h: n + h[c])
    return rows.select("pair_id", "page_no", "hunks", total("new_count").alias("n_added"), total("old_count").alias("n_removed"))


def replay(text: Column, script: Column) -> Column:
    """The page that the hunks make of a reference page (null: of none); null if no line is left."""
    old = F.coalesce(F.split(text, "\n"), F.array().cast("array<string>"))
    start = F.struct(F.lit(1).alias("at"), F.array().cast("array<string>").alias("out"))
    step = lambda s, h: F.struct((h["old_start"] + h["old_count"]).alias("at"), F.concat(s["out"], F.slice(old, s["at"], h["old_start"] - s["at"]), h["added"]).alias("out"))
    end = F.aggregate(script, start, step)
    lines = F.concat(end["out"], F.slice(old, end["at"], F.size(old)))
    return F.when(F.size(lines) > 0, F.array_join(lines, "\n"))
