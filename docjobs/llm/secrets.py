"""Secret scans: trigram inverted index.

Each rule's regular expression gives a Boolean query over trigrams that any match must contain. The documents are
indexed in shards (the batches of a task): a shard's inverted index maps the trigrams that some query names to the
sorted places of the documents that hold them; a rule's postings are intersected and united as its query says, and only
the documents left are searched with the expression itself. Rules without mandatory trigrams scan every document.
Trigrams are of the bytes of UTF-8, and A to Z are folded to lower case, which only adds candidates; in queries each byte
is written as the character of its number.

Defined results: bytes that are no UTF-8 count as U+FFFD; null and empty texts have no findings; repeated rows are searched each; offsets are code points of the
whole text, ends exclusive; an empty table gives an empty result; further columns are not looked at.
"""

from __future__ import annotations

import re
import re._constants as rc
import re._parser as rp
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docjobs.llm.common import small_batches, valid

#: Strings that a part of an expression may stand for, at most; beyond, it gives no trigrams.
MOST_STRINGS = 64


@dataclass(frozen=True)
class Rule:
    """kind, expression, and what a match must have: so many characters in so many of its group."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    any_case: bool = False
    compiled: re.Pattern = field(init=False, repr=False, compare=False)

    def __post_init__(self):
        object.__setattr__(self, "compiled", re.compile(self.pattern, re.ASCII | (re.IGNORECASE if self.any_case else 0)))

    def spans(self, text: str):
        for m in self.compiled.finditer(text):
            if m.end(self.group) - m.start(self.group) >= self.least:
                yield m.start(), m.end()


#: The expressions of the three base kinds, in their order.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}"),  # the runs of [0-9a-f]+ that have 24 or more
)
#: Further kinds, whose forms the issuers publish.
FURTHER = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("stripe", r"[sr]k_live_[0-9A-Za-z]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("pem", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
)
RULES = BASE + FURTHER


def _both(parts: list, kind: str):
    """AND or OR of queries; True is the query that every text meets."""
    if kind == "or" and True in parts:
        return True
    parts = [p for p in dict.fromkeys(parts) if p is not True]
    if not parts:
        return True
    return parts[0] if len(parts) == 1 else (kind, *parts)


def _needed(strings: frozenset) -> object:
    """What a text must hold if it holds one of these strings."""
    if min(map(len, strings)) < 3:
        return True
    return _both([_both([s[i : i + 3] for i in range(len(s) - 2)], "and") for s in sorted(strings)], "or")


def _folded(code: int) -> str:
    """The bytes of a character as the index has them."""
    return chr(code + 32 if 65 <= code <= 90 else code).encode("utf-8", "surrogatepass").decode("latin-1")


def _strings(op, arg) -> frozenset | None:
    """The few strings of bytes that a node stands for, or None."""
    if op is rc.LITERAL:
        return frozenset([_folded(arg)])
    if op is rc.IN:
        out = set()
        for kind, x in arg:
            if kind is rc.LITERAL:
                out.add(_folded(x))
            elif kind is rc.RANGE and x[1] - x[0] < MOST_STRINGS:
                out |= {_folded(c) for c in range(x[0], x[1] + 1)}
            else:
                return None
        return frozenset(out) if len(out) <= 5 else None
    if op is rc.SUBPATTERN:
        return _sequence_strings(arg[3])
    if op is rc.BRANCH:
        parts = [_sequence_strings(x) for x in arg[1]]
        return None if None in parts else frozenset().union(*parts)
    if op is rc.MAX_REPEAT and arg[1] == 1:
        own = _sequence_strings(arg[2])
        return None if own is None else own | (frozenset([""]) if arg[0] == 0 else frozenset())
    return None


def _sequence_strings(nodes) -> frozenset | None:
    out = frozenset([""])
    for op, arg in nodes:
        own = _strings(op, arg)
        if own is None or len(own) * len(out) > MOST_STRINGS:
            return None
        out = frozenset(a + b for a in out for b in own)
    return out


def _query(nodes) -> object:
    parts, run = [], frozenset([""])
    for op, arg in nodes:
        own = _strings(op, arg)
        if own is not None and len(own) * len(run) <= MOST_STRINGS:
            run = frozenset(a + b for a in run for b in own)
            continue
        parts.append(_needed(run))
        run = frozenset([""]) if own is None else own
        if own is None and op is rc.SUBPATTERN:
            parts.append(_query(arg[3]))
        elif own is None and op is rc.BRANCH:
            parts.append(_both([_query(x) for x in arg[1]], "or"))
        elif own is None and op in (rc.MAX_REPEAT, rc.MIN_REPEAT) and arg[0] > 0:
            parts.append(_query(arg[2]))
    return _both([*parts, _needed(run)], "and")


def trigram_query(pattern: str) -> object:
    """A trigram, ("and", ...), ("or", ...), or True where no trigram is mandatory."""
    return _query(rp.parse(pattern, re.ASCII))


def trigrams(query) -> set[str]:
    if query is True:
        return set()
    return {query} if isinstance(query, str) else set().union(*map(trigrams, query[1:]))


def postings_of(query, index: dict[str, np.ndarray], everything: np.ndarray) -> np.ndarray:
    """The places that meet a query, by intersection and union of postings."""
    if query is True:
        return everything
    if isinstance(query, str):
        return index.get(query, everything[:0])
    parts = [postings_of(q, index, everything) for q in query[1:]]
    out = parts[0]
    for p in parts[1:]:
        out = np.intersect1d(out, p, assume_unique=True) if query[0] == "and" else np.union1d(out, p)
    return out


class Shard:
    """The inverted index of some documents over the trigrams that the queries name."""

    fold = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)

    def __init__(self, names: list[str]):
        self.names = sorted(names)
        codes = np.array([int.from_bytes(x.encode("latin-1"), "big") for x in self.names], np.int64)
        self.number = np.full(1 << 24, -1, np.int16)
        self.number[codes] = np.arange(len(codes))

    def index(self, texts: list[bytes]) -> dict[str, np.ndarray]:
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        b = self.fold[np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)].astype(np.uint32)
        code = (b[:-2] << 16) | (b[1:-1] << 8) | b[2:]
        which = self.number[code]
        at = np.flatnonzero(which >= 0)
        doc = np.searchsorted(np.cumsum(size + 1), at, "right")
        pairs = np.unique(which[at].astype(np.int64) * len(texts) + doc)
        cut = np.searchsorted(pairs, np.arange(len(self.names) + 1) * len(texts))
        return {x: pairs[a:z] % len(texts) for x, a, z in zip(self.names, cut, cut[1:]) if z > a}


_SPAN = "array<struct<start:int,kind_no:int,kind:string,end:int>>"


def _scan(rules: tuple[Rule, ...]):
    queries = [trigram_query(r.pattern) for r in rules]

    def rows(batches):
        shard = Shard(list(set().union(*map(trigrams, queries))))
        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            everything = np.arange(len(texts))
            index = shard.index([x.encode() for x in texts]) if texts else {}
            found: list[list] = [[] for _ in texts]
            for number, (rule, query) in enumerate(zip(rules, queries)):
                for d in postings_of(query, index, everything).tolist():
                    found[d].extend({"start": a, "kind_no": number, "kind": rule.kind, "end": z} for a, z in rule.spans(texts[d]))
            for x in found:
                x.sort(key=lambda s: (s["start"], s["kind_no"], s["end"]))
            kind = pa.list_(pa.struct([("start", pa.int32()), ("kind_no", pa.int32()), ("kind", pa.string()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], names=["doc_id", "spans"])

    return rows


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, spans (start, kind_no, kind, end; by start, then the rules' order) for each row of docs."""
    small_batches(docs.sparkSession)
    kind = dict(docs.dtypes)[doc_id]
    return docs.select(F.col(doc_id).alias("doc_id"), valid(text).alias("text")).mapInArrow(_scan(rules), f"doc_id {kind}, spans {_SPAN}")


def listed(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: the secrets of each document."""
    found = find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["kind_no"] < len(BASE))
    return found.select("doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"), F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
