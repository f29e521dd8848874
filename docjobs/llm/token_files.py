"""Token-ID / binary output: flat unsigned integer files plus 64-bit document offsets, memory-mapped.

``write_token_files`` encodes texts with a public tokenizer, ranges the documents by identifier over tasks, and each
task writes shards of about ``SHARD_BYTES`` (a longer document has one of its own): ``T-N.bin`` (flat unsigned integers,
16 bits where the vocabulary fits), ``T-N.off`` (64-bit offsets into it, one more than documents) and ``T-N.doc`` (64-bit
document ids), for the N-th shard of task T. The shards' bases are the prefix sums of their token counts and stand in the
manifest (one entry per shard, the only thing that the driver sees). ``read_token_files`` maps the shards, or reads them
by ranges where the folder is no mount, and returns a row per document. Identifiers are numbers of 64 bits in the files.

Null texts count as empty and hold the end id alone. Null document ids sort first and come back as null. Rows that
share a document id stay separate documents, ordered by a hash of their text. An empty table gives no shards. Columns
other than the id and the text are not looked at. A shard is written under a temporary name and renamed, so a task
that runs twice leaves one whole file.
"""

from __future__ import annotations

import array
import json
import os
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docjobs.llm.common import shared_dir, small_batches, valid

#: Text pieces whose ids a worker remembers before it starts afresh: bounds its memory, changes no result.
CACHED_PIECES = 1_000_000
NULL_ID = -(2**63)
#: Bytes of ids after which a task begins its next shard; so many documents of a shard are read at once.
SHARD_BYTES, READ_DOCS = 256 << 20, 4096

_encoders: dict = {}


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable Latin-1 for itself, others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(other)}


class _Known(dict):
    """word -> the ids of lead + word, each distinct word encoded once until the dictionary is full."""

    def __init__(self, enc: Encoder, lead: str):
        self.enc, self.lead = enc, lead

    def __missing__(self, word: str) -> bytes:
        if word[-1:] in (".", ",") and word[:-1].isalpha():
            out = self[word[:-1]] + self.enc.marks[word[-1]]
        elif word.isalpha():
            out = self.enc.pack([t.id for t in self.enc.model.tokenize((self.lead + word).encode().decode("latin-1").translate(self.enc.letters))])
        else:
            out = self.enc.pack(self.enc.ids(self.lead + word)) if word else b""
        if len(self) >= CACHED_PIECES:
            self.clear()
        self[word] = out
        return out


class Encoder:
    """Encodes texts through the tokenizers library, each distinct piece once per worker.

    A byte-level pre-tokenizer always starts a new token at a single space or line end between two characters that are
    not white space, so a text may be cut there and its pieces encoded apart; a run of letters is one token of it, which
    its model takes as it is. Texts with other arrangements of white space, and all texts of tokenizers of other kinds,
    are encoded whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallelism
        self.tok = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tok.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4")
        spec = json.loads(self.tok.to_str())
        pre, model = spec.get("pre_tokenizer") or {}, spec.get("model") or {}
        self.by_piece = pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not spec.get("normalizer") and model.get("type") == "BPE" and not model.get("dropout")
        self.added = [x["content"] for x in spec.get("added_tokens", [])]
        if self.by_piece:
            self.model = self.tok.model
            self.model._resize_cache(0)  # rare words would only pass through it
            self.letters = str.maketrans({chr(b): c for b, c in _byte_letters().items()})
            self.marks = {x: self.pack(self.ids(x)) for x in (".", ",", "\n")}
            self.inner, self.first = _Known(self, " "), _Known(self, "")

    def ids(self, text: str) -> list[int]:
        return self.tok.encode(text, add_special_tokens=False).ids

    def pack(self, ids) -> bytes:
        return array.array("H" if self.dtype.itemsize == 2 else "I", ids).tobytes()

    def encode(self, text: str | None) -> bytes:
        text = text or ""
        single = self.by_piece and text.replace("\n", " ") == " ".join(text.split())  # no other white space
        if not single or any(x in text for x in self.added):
            return self.pack(self.ids(text))
        inner, lines = self.inner.__getitem__, []
        for line in text.split("\n"):
            words = line.split(" ")
            lines.append(self.first[words[0]] + b"".join(map(inner, words[1:])))
        return self.marks["\n"].join(lines)


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _open(folder: str):
    fs, base = pafs.FileSystem.from_uri(folder)
    return fs, base


class _Shard:
    """A shard that a task writes under a temporary name."""

    def __init__(self, fs, home: str, name: str, width: int):
        self.fs, self.home, self.name, self.width = fs, home, name, width
        self.temp = f"{home}/.{name}-{TaskContext.get().taskAttemptId()}"
        self.flat = fs.open_output_stream(f"{self.temp}.bin")
        self.offsets, self.ids = array.array("q", [0]), array.array("q")

    @property
    def tokens(self) -> int:
        return self.offsets[-1]

    def add(self, doc_id: int | None, tokens: bytes, end: bytes) -> None:
        self.flat.write(tokens + end)
        self.ids.append(NULL_ID if doc_id is None else doc_id)
        self.offsets.append(self.tokens + len(tokens) // self.width + 1)

    def close(self) -> dict:
        """Gives the files their names; the shard's entry in the manifest."""
        self.flat.close()
        for kind, data in (("off", self.offsets), ("doc", self.ids)):
            with self.fs.open_output_stream(f"{self.temp}.{kind}") as f:
                f.write(data.tobytes())
        for kind in ("bin", "off", "doc"):
            self.fs.move(f"{self.temp}.{kind}", f"{self.home}/{self.name}.{kind}")
        return {"shard": self.name, "docs": len(self.ids), "tokens": self.tokens, "width": self.width}


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 0, doc_id: str = "doc_id", text: str = "text", shard_bytes: int = SHARD_BYTES) -> dict:
    """Writes the shards of all documents in ascending id order below folder; returns the manifest."""
    spark = docs.sparkSession
    small_batches(spark)
    fs, base = _open(folder)
    fs.create_dir(base, recursive=True)

    def shards(batches):
        out, home = _open(folder)
        enc, task, n, own = encoder(tokenizer), TaskContext.get().partitionId(), 0, None
        width, done = enc.dtype.itemsize, []
        end = np.asarray([end_id], dtype=enc.dtype).tobytes()
        for batch in batches:
            for x, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                tokens = enc.encode(t)
                if own is not None and own.tokens and (own.tokens + 1) * width + len(tokens) > shard_bytes:
                    done.append(own.close())
                    n, own = n + 1, None
                own = own or _Shard(out, home, f"{task:07d}-{n:05d}", width)
                own.add(x, tokens, end)
        if own is not None:
            done.append(own.close())
        yield pa.RecordBatch.from_pylist(done, pa.schema([("shard", pa.string()), ("docs", pa.int64()), ("tokens", pa.int64()), ("width", pa.int32())]))

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(valid(text), F.lit("")).alias("text"))
    ranged = rows.withColumn("tie", F.xxhash64("text")).repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    written = ranged.select("doc_id", "text").mapInArrow(shards, "shard string, docs long, tokens long, width int").collect()
    listed, start = [], 0
    for s in sorted(written, key=lambda s: s["shard"]):
        listed.append({"shard": s["shard"], "docs": s["docs"], "tokens": s["tokens"], "base": start})
        start += s["tokens"]
    manifest = {"width": written[0]["width"] if written else 2, "end_id": end_id, "tokens": start, "shards": listed}
    with fs.open_output_stream(f"{base}/manifest.json") as f:
        f.write(json.dumps(manifest).encode())
    return manifest


class Flat:
    """A file as an array whose slices are read when asked for: memory-mapped where the folder is a mount."""

    def __init__(self, folder: str, name: str, dtype: str):
        fs, base = _open(folder)
        self.dtype, path = np.dtype(dtype), f"{base}/{name}"
        self.mapped = isinstance(fs, pafs.LocalFileSystem)
        self.file = pa.memory_map(path) if self.mapped else fs.open_input_file(path)

    def __len__(self) -> int:
        return self.file.size() // self.dtype.itemsize

    def __getitem__(self, part: slice) -> np.ndarray:
        a, b, _ = part.indices(len(self))
        size = self.dtype.itemsize
        self.file.seek(a * size)
        return np.frombuffer(self.file.read_buffer((b - a) * size), self.dtype)


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start (tokens before the document), n_tokens, ids_crc32 of the ids as little-endian 32-bit integers."""
    fs, base = _open(folder)
    with fs.open_input_stream(f"{base}/manifest.json") as f:
        manifest = json.loads(f.read())
    width = manifest["width"]

    def read(batches):
        for batch in batches:
            for name, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids, off, docs = (Flat(folder, f"{name}.{kind}", t) for kind, t in (("bin", f"<u{width}"), ("off", "<i8"), ("doc", "<i8")))
                for k in range(0, len(docs), READ_DOCS):
                    ends = off[k : k + READ_DOCS + 1]
                    crc = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
                    own = docs[k : k + READ_DOCS]
                    yield pa.RecordBatch.from_pydict({"doc_id": pa.array(own, pa.int64(), mask=own == NULL_ID), "start": pa.array(ends[:-1] + first, pa.int64()), "n_tokens": pa.array(np.diff(ends), pa.int64()), "ids_crc32": pa.array(crc, pa.int64())})

    shards = spark.createDataFrame([(s["shard"], s["base"]) for s in manifest["shards"]], "shard string, base long")
    return shards.repartition(max(1, len(manifest["shards"]))).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: the documents written as token files in the shared folder, and read back."""
    import public_tokenizers

    folder = shared_dir(spark, "tokens")
    write_token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"), folder, public_tokenizers.path("byte_bpe_50k.json"))
    return read_token_files(spark, folder)
