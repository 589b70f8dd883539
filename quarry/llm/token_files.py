"""Token ids in compressed binary files with a shared dictionary.

A shard: MAGIC, the SHA-256 of the dictionary, the width of an id in bytes, the
number of documents n, then n doc_ids, n token counts and n + 1 offsets (all
little-endian 64-bit), then one zstandard frame for each document. A document
is read with its index entry and one short range of the file. The dictionary is
trained on the serialized ids of a bounded sample of documents and lies beside
the shards; readers refuse a shard whose dictionary hash is another.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm import files
from quarry.llm.common import keep, null_id, with_id
from quarry.llm.tokens import encoder

MAGIC = b"QTOKENS1"
HEAD = struct.Struct("<8s32sQQ")


def pack_ids(ids: bytes, width: int) -> bytes:
    """Unsigned 32-bit ids in ``width`` (2 or 4) bytes each."""
    return np.frombuffer(ids, "<u4").astype("<u2").tobytes() if width == 2 else ids


def unpack_ids(data: bytes, width: int) -> bytes:
    return np.frombuffer(data, "<u2").astype("<u4").tobytes() if width == 2 else data


def train_dictionary(samples: list[bytes], size: int) -> bytes:
    """A zstandard dictionary; of samples that are too few to train on, their bytes themselves serve."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:size]


def shard(rows: list[tuple[int, int, bytes]], digest: bytes, width: int) -> list[bytes]:
    """The bytes of a shard of (doc_id, tokens, frame)."""
    ids = np.array([r[0] for r in rows], "<i8").tobytes()
    counts = np.array([r[1] for r in rows], "<u8").tobytes()
    offsets = np.concatenate([[0], np.cumsum([len(r[2]) for r in rows])]).astype("<u8").tobytes()
    return [HEAD.pack(MAGIC, digest, width, len(rows)), ids, counts, offsets, *[r[2] for r in rows]]


class Shard:
    """Reads a shard's index at once, and documents each by its own range."""

    def __init__(self, uri: str, dictionary: bytes):
        self.uri = uri
        magic, digest, self.width, n = HEAD.unpack(files.read(uri, 0, HEAD.size))
        if magic != MAGIC or digest != hashlib.sha256(dictionary).digest():
            raise ValueError(f"{uri} is no shard of this dictionary")
        index = files.read(uri, HEAD.size, 8 * (3 * n + 1))
        self.doc_ids, self.counts = np.frombuffer(index, "<i8", n), np.frombuffer(index, "<u8", n, 8 * n)
        self.offsets = np.frombuffer(index, "<u8", n + 1, 16 * n)
        self.body = HEAD.size + 8 * (3 * n + 1)
        self.zip = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary)) if dictionary else zstandard.ZstdDecompressor()

    def _ids(self, frame: bytes, i: int) -> bytes:
        return unpack_ids(self.zip.decompress(frame, max_output_size=max(1, int(self.counts[i]) * self.width)), self.width)

    def document(self, i: int) -> bytes:
        """ids of the i-th document as unsigned 32-bit numbers, from its own bytes of the file only."""
        a, b = int(self.offsets[i]), int(self.offsets[i + 1])
        return self._ids(files.read(self.uri, self.body + a, b - a), i)

    def documents(self) -> Iterator[tuple[int, int, bytes]]:
        """(doc_id, tokens, ids) of all documents, in one read."""
        data = files.read(self.uri, self.body)
        for i, doc_id in enumerate(self.doc_ids.tolist()):
            yield doc_id, int(self.counts[i]), self._ids(data[int(self.offsets[i]):int(self.offsets[i + 1])], i)


def write(docs: DataFrame, tokenizer: str, folder: str, id_col: str = "doc_id", text_col: str = "text", dictionary_rows: int = 2000,
          dictionary_chars: int = 20_000, dictionary_bytes: int = 65_536, shard_bytes: int = 16_000_000) -> DataFrame:
    """Write all documents in ascending id order; returns the manifest (part, number, path, doc_count, token_count).

    The dictionary is trained on ``dictionary_rows`` documents at most, those of
    smallest id hash with up to ``dictionary_chars`` characters. Null texts are
    empty: their end id alone. Rows that repeat an id stand side by side,
    ordered by text.
    """
    base = with_id(docs, id_col, text_col)
    picked = base.where(F.length("text") <= dictionary_chars).select("doc_id", F.xxhash64("doc_id").alias("h")).orderBy("h").limit(dictionary_rows)
    sample = base.where(F.length("text") <= dictionary_chars).join(F.broadcast(picked.select("doc_id").distinct()), "doc_id").limit(dictionary_rows)
    texts = sorted(r["text"] for r in sample.select("text").collect())
    wide = encoder(tokenizer)
    width = 2 if wide.tok.get_vocab_size() <= 65_536 else 4
    dictionary = train_dictionary([pack_ids(i, width) for i in wide.encode(texts)], dictionary_bytes)
    digest = hashlib.sha256(dictionary).digest()
    files.write(f"{folder}/dictionary", [dictionary])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = encoder(tokenizer), TaskContext.get().partitionId()
        shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        squeeze = zstandard.ZstdCompressor(level=3, dict_data=shared, write_checksum=False)
        rows, size, number = [], 0, 0

        def flush() -> pa.RecordBatch:
            path = f"{folder}/part-{part:05d}-{number:05d}.tokens"
            files.write(path, shard(rows, digest, width))
            made = [[part], [number], [path], [len(rows)], [sum(r[1] for r in rows)]]
            return pa.RecordBatch.from_arrays([pa.array(x) for x in made], ["part", "number", "path", "doc_count", "token_count"])

        for b in batches:
            for doc_id, ids in zip(b.column(0).to_pylist(), enc.encode(b.column(1).to_pylist()), strict=True):
                frame = squeeze.compress(pack_ids(ids, width))
                rows.append((doc_id, len(ids) // 4, frame))
                size += len(frame)
                if size >= shard_bytes:
                    yield flush()
                    rows, size, number = [], 0, number + 1
        if rows:
            yield flush()

    placed = base.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return keep(placed.mapInArrow(run, "part long, number long, path string, doc_count long, token_count long"), "token-manifest")


def read(manifest: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from the files of a manifest; start counts the ids of all documents before."""
    dictionary = files.read(f"{folder}/dictionary")
    # Tokens before each file: of earlier parts (one row per task), then of earlier files of the part.
    parts = manifest.groupBy("part").agg(F.sum("token_count").alias("t"))
    parts = parts.select("part", (F.sum("t").over(Window.orderBy("part")) - F.col("t")).alias("before"))
    inner = F.sum("token_count").over(Window.partitionBy("part").orderBy("number")) - F.col("token_count")
    starts = manifest.withColumn("inner", inner).join(parts, "part").select("path", (F.col("inner") + F.col("before")).alias("first"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, at in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows = []
                for doc_id, n, ids in Shard(path, dictionary).documents():
                    rows.append((doc_id, at, n, zlib.crc32(ids)))
                    at += n
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    spread = starts.repartition("path")
    return spread.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long").withColumn("doc_id", null_id("doc_id"))
