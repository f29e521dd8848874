"""Chunks that follow a text's structure: paragraphs, then lines, then words, then characters.

A text is cut after its separators, from the coarsest on; only pieces that are longer than a chunk are cut by the next
one, and words by characters. Pieces are merged, in order, into chunks of at most ``size`` characters; the next chunk starts
again with as many whole pieces as fit into ``overlap``, if the piece to come still fits. So each chunk is a span of the
text, spans overlap or meet, and no character is lost. Empty and null texts give no chunk; lengths are in code points.
"""

from __future__ import annotations

import bisect
import functools

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEPARATORS = ("\n\n", "\n", " ")


def cuts(text: str, size: int, separators: tuple[str, ...] = SEPARATORS) -> list[int]:
    """Where pieces end, ascending; no piece is longer than size."""
    out, todo = [], [(0, len(text), 0)]
    while todo:
        a, b, level = todo.pop()
        if b - a <= size:
            out.append(b)
        elif level == len(separators):
            out.extend(range(a + 1, b + 1))
        else:
            sep, parts, at = separators[level], [], a
            while (hit := text.find(sep, at, b)) >= 0:
                parts.append((at, hit + len(sep), level + 1))
                at = hit + len(sep)
            if at < b:
                parts.append((at, b, level + 1))
            todo.extend(reversed(parts))
    return out


def spans(ends: list[int], size: int, overlap: int) -> list[tuple[int, int]]:
    """The spans of chunks over pieces that end there."""
    if not ends or not ends[-1]:
        return []
    starts, out, start, end = [0, *ends], [], 0, 0
    for b in ends:
        if b - start > size:
            out.append((start, end))
            start = starts[bisect.bisect_left(starts, max(end - overlap, b - size))]
        end = b
    return [*out, (start, end)]


def _chunk_rows(size, overlap, separators, batches):
    for batch in batches:
        texts = [t or "" for t in batch.column(1).to_pylist()]
        found = [spans(cuts(t, size, separators), size, overlap) for t in texts]
        at = [i for i, s in enumerate(found) for _ in s]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0).take(pa.array(at, pa.int64())), pa.array([n for s in found for n in range(len(s))], pa.int64()),
                pa.array([a for s in found for a, _ in s], pa.int64()), pa.array([t[a:b] for t, s in zip(texts, found) for a, b in s], pa.string()),
            ],
            names=["row", "chunk_no", "start", "text"],
        )


def split_documents(docs: DataFrame, size: int = 1000, overlap: int = 200, separators: tuple[str, ...] = SEPARATORS) -> DataFrame:
    """docs without text, plus chunk_no, row_id (the same), start and text of each chunk; narrow."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be smaller than size")
    added = ("text", "chunk_no", "row_id", "start")
    kept = [c for c in docs.columns if c not in added]
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in kept)).alias("row"), F.make_valid_utf8("text").alias("text"))
    out = rows.mapInArrow(functools.partial(_chunk_rows, size, overlap, separators), f"row {dict(rows.dtypes)['row']}, chunk_no long, start long, text string")
    return out.select(*(F.col(f"row.`{c}`").alias(c) for c in kept), "chunk_no", F.col("chunk_no").cast("string").alias("row_id"), "start", "text")
