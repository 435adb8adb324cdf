"""Operator 9: token ids in word-aligned binary files (Simple-8b).

File (``.s8b``, little-endian throughout): the blocks; then the index: i64 id of each document, u64 its first id's position
in the file, and for each block u64 place, u32 words and u32 escapes; then the footer: magic ``S8BTOK2\\0``; u64 number
of documents, of those without an id (they come first), of ids and of blocks; u64 place of the index. A block holds ``BLOCK_IDS`` ids (the
last one fewer): its words, then its escapes as u32. The top four bits of a word select how many ids it packs and how wide; an id
of 2**15 - 1 or more is packed as that value, and its true value is the block's next escape. So four 15-bit ids fit a word
whatever the ids are, each block is decoded alone through its offset, and decoding handles all words of one selector at
once. A file is written once from start to end, so any store will do.

Documents are ranged by doc_id over files; ids ascend within a file and over files. Each task writes under a name of its own
attempt and renames it, so a repeated or a second task leaves one whole file.

Defined results: a null or empty text has the end id alone; equal doc_ids keep all their rows, ordered by text; null doc_ids
come first; an empty table makes no file and no rows; other columns are not read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh_path, map_arrow, read, shared_store, slices, stash
from .tokens import ENCODE_BYTES, chunk_encoder, public_vocabulary

MAGIC = b"S8BTOK2\0"
FOOT = struct.Struct("<8sQQQQQ")
BLOCK_IDS = 8192
ESCAPE = (1 << 15) - 1
#: Ids per word and bits per id, by selector. Widths above 15 are not needed: larger ids escape.
SELECTORS = ((60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15))
MOST_IDS = SELECTORS[0][0]
END_ID = 2
TOGETHER = 32  # blocks encoded together
_COUNTS = np.array([count for count, _ in SELECTORS], np.int64)
_BITS = np.maximum(1, np.frexp(np.arange(ESCAPE + 1, dtype=np.float64))[1]).astype(np.int8)


def encode_blocks(ids: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """The words and the escapes of each row of unsigned 32-bit ids (blocks, ids of a block)."""
    blocks, n = ids.shape
    values = np.minimum(ids, ESCAPE)
    bits = _BITS[values]
    # best[b, i]: the selector that packs the most of the ids from i on into a whole word (past the end zeros are packed)
    best = np.full((blocks, n), len(SELECTORS) - 1, np.int8)
    wide = np.zeros((blocks, n + 1 + MOST_IDS), np.int16)
    for s in range(len(SELECTORS) - 2, -1, -1):
        count, width = SELECTORS[s]
        np.cumsum(bits > width, axis=1, dtype=np.int16, out=wide[:, 1 : n + 1])
        wide[:, n + 1 :] = wide[:, n : n + 1]
        best[wide[:, count : count + n] == wide[:, :n]] = s
    jump = _COUNTS[best]
    at, rows, steps = np.zeros(blocks, np.int64), np.arange(blocks), []
    while (at < n).any():
        steps.append(at)
        at = at + jump[rows, np.minimum(at, n - 1)]
    starts = np.stack(steps, axis=1) if steps else np.zeros((blocks, 0), np.int64)  # block, word
    there = starts < n
    block, start = np.nonzero(there)[0], starts[there]
    chosen = best[block, start].astype(np.int64)
    words = chosen.astype(np.uint64) << np.uint64(60)
    padded = np.zeros((blocks, n + MOST_IDS), np.uint64)
    padded[:, :n] = values
    place = block * padded.shape[1] + start
    for s, (count, width) in enumerate(SELECTORS):
        own = np.flatnonzero(chosen == s)
        if len(own):
            grid = padded.ravel()[place[own][:, None] + np.arange(count)]
            words[own] |= np.bitwise_or.reduce(grid << (np.arange(count, dtype=np.uint64) * np.uint64(width)), axis=1)
    large = ids >= ESCAPE
    cuts, more = np.cumsum(there.sum(axis=1))[:-1], np.cumsum(large.sum(axis=1))[:-1]
    return list(zip(np.split(words.astype("<u8"), cuts), np.split(ids[large].astype("<u4"), more), strict=True))


def encode_block(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return encode_blocks(ids[None])[0]


def decode_block(words: np.ndarray, escapes: np.ndarray, n: int) -> np.ndarray:
    chosen = (words >> np.uint64(60)).astype(np.int64)
    counts = np.array([c for c, _ in SELECTORS], np.int64)[chosen]
    starts = np.cumsum(counts) - counts
    out = np.zeros(int(counts.sum()) if len(counts) else 0, np.uint32)
    for s, (count, width) in enumerate(SELECTORS):
        own = np.flatnonzero(chosen == s)
        if len(own):
            grid = (words[own][:, None] >> (np.arange(count, dtype=np.uint64) * np.uint64(width))) & np.uint64((1 << width) - 1)
            out[starts[own][:, None] + np.arange(count)] = grid.astype(np.uint32)
    out = out[:n]
    out[out == ESCAPE] = escapes
    return out


class TokenFileWriter:
    """Streams documents into one file; holds one block and the document index."""

    def __init__(self, sink):
        self.sink, self.place, self.ids, self.nulls = sink, 0, 0, 0
        self.docs: list[int] = []
        self.starts: list[int] = []
        self.blocks: list[tuple[int, int, int]] = []
        self.rest = np.zeros(0, np.uint32)

    def add(self, doc_ids: list[int | None], ids: np.ndarray, ends: np.ndarray) -> None:
        """Documents without an id must come before all others."""
        self.nulls += doc_ids.count(None)
        self.docs += [x or 0 for x in doc_ids]
        self.starts += (ends[:-1] + self.ids).tolist()
        self.ids += len(ids)
        self.rest = np.concatenate([self.rest, ids])
        whole = len(self.rest) // BLOCK_IDS * BLOCK_IDS
        for a in range(0, whole, BLOCK_IDS * TOGETHER):
            self._blocks(self.rest[a : min(whole, a + BLOCK_IDS * TOGETHER)].reshape(-1, BLOCK_IDS))
        self.rest = self.rest[whole:]

    def _blocks(self, ids: np.ndarray) -> None:
        for words, escapes in encode_blocks(ids):
            self.sink.write(words.tobytes() + escapes.tobytes())
            self.blocks.append((self.place, len(words), len(escapes)))
            self.place += 8 * len(words) + 4 * len(escapes)

    def close(self) -> None:
        """Finish the file with its index and footer."""
        if len(self.rest):
            self._blocks(self.rest[None])
        index = np.array(self.docs, "<i8").tobytes() + np.array(self.starts, "<u8").tobytes()
        index += np.array(self.blocks, dtype=[("p", "<u8"), ("w", "<u4"), ("e", "<u4")]).tobytes()
        self.sink.write(index + FOOT.pack(MAGIC, len(self.docs), self.nulls, self.ids, len(self.blocks), self.place))


class TokenFile:
    """Random access to a file written above."""

    def __init__(self, source):
        self.source = source
        source.seek(-FOOT.size, 2)
        magic, self.n_docs, self.n_nulls, self.n_ids, n_blocks, place = FOOT.unpack(source.read(FOOT.size))
        if magic != MAGIC:
            raise ValueError("not a token file")
        source.seek(place)
        self.doc_ids = np.frombuffer(source.read(8 * self.n_docs), "<i8")
        self.starts = np.append(np.frombuffer(source.read(8 * self.n_docs), "<u8").astype(np.int64), self.n_ids)
        self.blocks = np.frombuffer(source.read(16 * n_blocks), dtype=[("p", "<u8"), ("w", "<u4"), ("e", "<u4")])

    def ids(self, a: int, b: int) -> np.ndarray:
        """The file's ids from position a up to b; only the blocks that hold them are read."""
        if a >= b:
            return np.zeros(0, np.uint32)
        out = []
        for k in range(a // BLOCK_IDS, (b - 1) // BLOCK_IDS + 1):
            place, words, escapes = (int(x) for x in self.blocks[k])
            self.source.seek(place)
            raw = self.source.read(8 * words + 4 * escapes)
            n = min(BLOCK_IDS, self.n_ids - k * BLOCK_IDS)
            out.append(decode_block(np.frombuffer(raw, "<u8", words), np.frombuffer(raw, "<u4", escapes, 8 * words), n))
        first = a // BLOCK_IDS * BLOCK_IDS
        return np.concatenate(out)[a - first : b - first]


def write_token_files(docs: DataFrame, folder: str, vocabulary: str, end_id: int = END_ID, files: int | None = None) -> DataFrame:
    """Write ``docs`` (doc_id, text) as files below ``folder`` in ascending doc_id order; returns the manifest, a row a file."""
    spark = docs.sparkSession
    n = files or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context, encoder = TaskContext.get(), chunk_encoder(vocabulary)
        store, top = shared_store(folder)
        store.create_dir(top, recursive=True)
        part = context.partitionId()
        name, body = f"part-{part:06d}.s8b", f"{top}/.{part:06d}-{context.taskAttemptId()}"
        first = next(batches, None)
        while first is not None and first.num_rows == 0:
            first = next(batches, None)
        if first is None:
            return

        def again():
            yield first
            yield from batches

        with store.open_output_stream(body) as sink:
            writer = TokenFileWriter(sink)
            for piece in slices(again(), "text", ENCODE_BYTES):
                doc_ids = piece.column("doc_id").to_pylist()
                for lo, hi, ids, ends in encoder.encode(piece.column("text")):
                    closed = ends + np.arange(hi - lo + 1)  # an end id after each document
                    whole = np.full(closed[-1], end_id, np.uint32)
                    keep = np.ones(closed[-1], bool)
                    keep[closed[1:] - 1] = False
                    whole[keep] = ids
                    writer.add(doc_ids[lo:hi], whole, closed)
            writer.close()
        store.move(body, f"{top}/{name}")
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([name]), pa.array([writer.ids], pa.int64()), pa.array([len(writer.docs)], pa.int64())], names=["file_no", "file", "n_ids", "n_docs"])

    ordered = docs.select("doc_id", "text").repartitionByRange(n, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    return map_arrow(ordered, run, "file_no long, file string, n_ids long, n_docs long")


def read_token_files(manifest: DataFrame, folder: str) -> DataFrame:
    """One row for each document of the files of ``manifest``: place, size and checksum of its ids, decoded from the file."""
    schema = T.StructType([*(T.StructField(x, T.LongType()) for x in ("doc_id", "start", "n_tokens", "ids_crc32"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = shared_store(folder)
        for batch in batches:
            for name, before in zip(batch.column("file").to_pylist(), batch.column("before").to_pylist(), strict=True):
                with store.open_input_file(f"{top}/{name}") as source:
                    f = TokenFile(source)
                    step = 512
                    for a in range(0, f.n_docs, step):
                        b = min(f.n_docs, a + step)
                        cut = f.starts[a : b + 1]
                        ids = f.ids(int(cut[0]), int(cut[-1])).astype("<u4")
                        at = (cut - cut[0]).tolist()
                        crc = [zlib.crc32(ids[x:y].tobytes()) for x, y in zip(at, at[1:], strict=False)]
                        columns = [pa.array(f.doc_ids[a:b], mask=np.arange(a, b) < f.n_nulls), pa.array(cut[:-1] + before), pa.array(np.diff(cut)), pa.array(crc, pa.int64())]
                        yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    spark = manifest.sparkSession
    files = manifest.select("file_no", "file", "n_ids")
    # ids in earlier files: a running sum over one row a file
    rows = files.orderBy("file_no").collect()
    before, total = [], 0
    for r in rows:
        before.append((r.file, total))
        total += r.n_ids
    listed = spark.createDataFrame(before, "file string, before long")
    return map_arrow(listed.repartition(max(1, len(before)), "file") if before else listed, run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op9_simple8b(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_path(spark, "tokens")
    manifest = stash(write_token_files(read(spark, sf_dir, "documents"), folder, public_vocabulary("byte_bpe_50k.json")), "token-manifest")
    return read_token_files(manifest, folder)
