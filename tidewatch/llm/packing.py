"""Operator 1: hierarchical multi-length packing.

Documents are routed to context-size tiers (256, 512, 1024 and 2048 tokens by default): whole windows of the longest
tier leave a document first, and what remains goes to the smallest tier that holds it. Each tier is packed into
sequences of its own length; a gap that a tier's piece leaves is filled with whole pieces of shorter tiers, longest
first, and at last with a cut one, whose rest is routed anew. Finally the sequences are dealt to step groups so that the
attention cost (sum of squared piece lengths) of groups made of the same tier is alike.

Each task packs what it reads, in blocks of a fixed number of tokens, so nothing is shuffled and memory doesn't depend on
a text's share of the data beyond the text itself. Only the last sequence of a task can be short: at most one
sequence per input partition is padded. Ids of a sequence are the partition's number above 2**40 and a counter below, which a
repeated task gives again.

Defined results: a null or empty text is a document of the end id alone; repeated rows are documents of their own; a null
doc_id is carried; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from .common import map_arrow, read, slices
from .tokens import chunk_encoder, public_vocabulary

TIERS = (256, 512, 1024, 2048)
END_ID = 1
STEP_SEQUENCES = 8
BLOCK_TOKENS = 1 << 19
SLICE = 10 << 20
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long"


class TierPacker:
    """Packs the pieces of one task. Pieces are (length, serial, doc, start), kept in one list ordered by length."""

    def __init__(self, base: int, tiers: tuple[int, ...] = TIERS, per_step: int = STEP_SEQUENCES):
        self.tiers, self.longest, self.base, self.per_step = tiers, tiers[-1], base, per_step
        self.pool: list[tuple[int, int, int, int]] = []
        self.docs: list[tuple[object, np.ndarray]] = []
        self.serial = self.sequences = self.groups = self.waiting = 0

    def add(self, doc_id, ids: np.ndarray) -> None:
        self.docs.append((doc_id, ids))
        doc, whole = len(self.docs) - 1, len(ids) // self.longest * self.longest
        for a in range(0, whole, self.longest):
            self._put(doc, a, self.longest)
        if len(ids) > whole:
            self._put(doc, whole, len(ids) - whole)
        self.waiting += len(ids)

    def _put(self, doc: int, start: int, length: int) -> None:
        insort(self.pool, (length, self.serial, doc, start))
        self.serial += 1

    def _take(self, most: int) -> tuple[int, int, int, int]:
        """The longest piece of at most ``most`` tokens, or the shortest longer one cut to ``most``."""
        i = bisect_right(self.pool, (most, 1 << 62, 0, 0))
        if i:
            return self.pool.pop(i - 1)
        length, _, doc, start = self.pool.pop(0)
        self._put(doc, start + most, length - most)
        return most, 0, doc, start

    def drain(self, last: bool) -> pa.RecordBatch:
        """Sequences from what waits; unless ``last``, pieces that can't fill one more sequence of the longest tier stay."""
        made: list[tuple[int, list[tuple[int, int, int, int]]]] = []
        keep = 0 if last else self.longest
        while self.waiting > keep:
            longest_piece = self.pool[-1][0]
            tier = next(t for t in self.tiers if t >= longest_piece)
            if self.waiting < tier:  # the end: the longest tier that can still be filled, else one short sequence
                tier = next((t for t in reversed(self.tiers) if t <= self.waiting), self.waiting)
            gap, pieces = tier, []
            while gap:
                pieces.append(x := self._take(gap))
                gap -= x[0]
            self.waiting -= tier
            made.append((tier, pieces))
        out = self._rows(made)
        live = sorted({x[2] for x in self.pool})
        at = {d: i for i, d in enumerate(live)}
        self.docs = [self.docs[d] for d in live]
        self.pool = sorted((n, s, at[d], a) for n, s, d, a in self.pool)
        return out

    def _rows(self, made) -> pa.RecordBatch:
        # Balance: within a tier, by falling attention cost, dealt forth and back over the tier's step groups.
        groups = [0] * len(made)
        for tier in {t for t, _ in made}:
            own = sorted((i for i, x in enumerate(made) if x[0] == tier), key=lambda i: (-sum(p[0] ** 2 for p in made[i][1]), i))
            n = -(-len(own) // self.per_step)
            for rank, i in enumerate(own):
                lap, k = divmod(rank, n)
                groups[i] = self.base + self.groups + (k if lap % 2 == 0 else n - 1 - k)
            self.groups += n
        rows: list[tuple] = []
        for (tier, pieces), group in zip(made, groups, strict=True):
            offset = 0
            for length, _, doc, start in pieces:
                doc_id, ids = self.docs[doc]
                rows.append((doc_id, start, length, zlib.crc32(ids[start : start + length].tobytes()), len(ids), self.base + self.sequences, offset, tier, group))
                offset += length
            self.sequences += 1
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        kinds = [pa.int32() if x.split()[1] == "int" else pa.int64() for x in SCHEMA.split(", ")]
        columns = zip(*rows, strict=True) if rows else [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=names)


def pack_documents(docs: DataFrame, vocabulary: str, tiers: tuple[int, ...] = TIERS, end_id: int = END_ID, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """One row for each piece of a document of ``docs`` (doc_id, text); ``tiers`` are powers of two, rising."""
    if any(t & (t - 1) for t in tiers) or list(tiers) != sorted(set(tiers)):
        raise ValueError("tiers must be rising powers of two")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = TierPacker(TaskContext.get().partitionId() << 40, tiers)
        encoder = chunk_encoder(vocabulary)
        end = np.array([end_id], dtype="<u4")
        for part in slices(batches, "text", SLICE):
            doc_ids = part.column("doc_id").to_pylist()
            for lo, hi, ids, ends in encoder.encode(part.column("text")):
                for i in range(lo, hi):
                    packer.add(doc_ids[i], np.concatenate([ids[ends[i - lo] : ends[i - lo + 1]], end]))
                    if packer.waiting >= block_tokens:
                        yield packer.drain(False)
        yield packer.drain(True)

    return map_arrow(docs.select("doc_id", "text"), run, SCHEMA)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read(spark, sf_dir, "documents"), public_vocabulary("byte_bpe_50k.json"))
