"""Hierarchical packing of documents into training sequences of several context sizes.

A document's token ids (and a closing id) are cut at the largest context size; what remains is routed to the smallest
tier that holds it. Each tier is packed longest first. The gap that a piece leaves in its window is filled with the longest
pieces of shorter tiers that fit, and at last with the head of a piece that is cut, so that windows are full: a
window's length is its tier, a power of two. Pieces that are left at the end of a block of documents wait for the next block; at the end
of a partition they are laid end to end and cut at powers of two, so that no padding is needed at all. Step groups
hold equal numbers of tokens of one tier, so that the parallel workers of a step have equal work.

Defined cases: a null text is the empty text and has the closing id alone; rows with equal identifiers are separate documents; a
null identifier stays null; an empty table gives no pieces; other columns are ignored. A sequence's identifier is the number of its partition and
a running number, so a task that is run again gives the same rows.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from .common import batches, small_batches, table, texts_of, tidied
from .tokens import WordPieces, tokenizer_path

TIERS = (4096, 2048, 1024, 512, 256)
#: Token ids that a task holds before it packs them.
BLOCK = 1 << 20
#: Tokens in a step group.
STEP = 1 << 16
END = 2

SCHEMA = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", "step_group")])
DDL = ", ".join(f"{f.name} long" for f in SCHEMA)


class Packer:
    """Packs the documents of one partition. A piece is (length, number, start, document): document = (id, ids as bytes, tokens)."""

    def __init__(self, partition: int = 0, tiers: tuple[int, ...] = TIERS, block: int = BLOCK, step: int = STEP):
        self.base, self.tiers, self.block, self.step = partition << 40, tiers, block, step
        self.pieces: list[tuple[int, int, int, tuple]] = []
        self.held = self.number = self.sequences = 0
        self.groups: dict[int, list[int]] = {}
        self.opened = 0

    def add(self, doc_id: int | None, ids: bytes) -> Iterator[tuple]:
        n = len(ids) // 4
        doc = (doc_id, ids, n)
        most = self.tiers[0]
        for start in range(0, n - most + 1, most):
            yield from self.window(most, [(most, 0, start, doc)])
        if rest := n % most:
            self.number += 1
            self.pieces.append((rest, self.number, n - rest, doc))
            self.held += rest
        if self.held >= self.block:
            yield from self.pack()

    def window(self, tier: int, pieces: list[tuple]) -> Iterator[tuple]:
        """Rows of one sequence, which joins the open step group of its tier."""
        group = self.groups.setdefault(tier, [0, 0])
        if group[1] % max(1, self.step // tier) == 0:
            self.opened += 1
            group[0] = self.opened
        group[1] += 1
        offset = 0
        for length, _, start, (doc_id, ids, n) in pieces:
            yield doc_id, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), n, self.base + self.sequences, offset, tier, self.base + group[0]
            offset += length
        self.sequences += 1

    def pack(self) -> Iterator[tuple]:
        """Full windows of every tier; pieces for which no more full window can be made stay."""
        pool, left = sorted(self.pieces), self.held
        while pool:
            tier = next((t for t in reversed(self.tiers) if t >= pool[-1][0]), self.tiers[0])
            if left < tier:
                break
            head = pool.pop()
            inside, gap = [head], tier - head[0]
            while gap:
                at = bisect_right(pool, (gap, float("inf"))) - 1
                if at >= 0 and (pool[at][0] == gap or at > 0 or pool[at][0] * 2 > gap):
                    piece = pool.pop(at)
                else:  # every piece that is left is longer than the gap, or hardly any is short: cut one
                    at = min(at + 1, len(pool) - 1)
                    piece = pool.pop(at)
                    if piece[0] > gap:
                        length, number, start, doc = piece
                        insort(pool, (length - gap, number, start + gap, doc))
                        piece = (gap, number, start, doc)
                inside.append(piece)
                gap -= piece[0]
            left -= tier
            yield from self.window(tier, inside)
        self.pieces, self.held = pool, left

    def close(self) -> Iterator[tuple]:
        """What is left, cut at falling powers of two."""
        yield from self.pack()
        size, inside, room = self.tiers[0], [], 0
        left = self.held
        for length, number, start, doc in reversed(self.pieces):
            while length:
                if not room:
                    size = room = 1 << left.bit_length() - 1
                    left -= size
                take = min(room, length)
                inside.append((take, number, start, doc))
                length, start, room = length - take, start + take, room - take
                if not room:
                    yield from self.window(size, inside)
                    inside = []
        self.pieces, self.held = [], 0


def pack_sequences(docs: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text", tiers: tuple[int, ...] = TIERS) -> DataFrame:
    """Pieces of documents in sequences; see the module. tokenizer: the vocabulary file, the same place on every executor."""
    path = tokenizer or tokenizer_path("word_bpe_49k.json")
    if any(t & (t - 1) for t in tiers) or list(tiers) != sorted(tiers, reverse=True):
        raise ValueError("tiers are falling powers of two")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.array([END], "<u4").tobytes()
        pieces, packer = WordPieces.shared(path), Packer(TaskContext.get().partitionId(), tiers)

        def rows() -> Iterator[tuple]:
            for part in parts:
                for doc_id, ids in zip(part.column(0).to_pylist(), pieces.encode(texts_of(part, "text"))):
                    yield from packer.add(doc_id, ids + end)
            yield from packer.close()

        yield from batches(rows(), SCHEMA)

    small_batches(docs.sparkSession, 1024)  # the more texts, the fewer times a word is looked up
    return docs.selectExpr(f"cast(`{id_col}` as long) doc_id", f"`{text_col}` text").mapInArrow(tidied(run), DDL)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packs every whole text of `documents`."""
    return pack_sequences(table(spark, sf_dir, "documents"))
