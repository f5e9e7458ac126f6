"""Packing: first-fit decreasing in randomised groups of documents.

A document is its token ids and an end id. Whole windows of `capacity` ids are
sequences of their own; the rest of each document is one item. Documents are
dealt into groups by a hash, and each group of at most `group_rows` documents is
packed by itself: items in decreasing size go to the first bin that has room,
which a tournament tree over the bins' free room finds in O(log bins). No group
sees another, so there is no global sort and a lost task packs its groups anew
with the same result.

Where rows have a place in a schedule (`order`), only documents of consecutive
slots share a group: a range of so many slots as hold about `group_rows` documents. Sequence ids
rise by range and follow a random order inside a group, so any prefix of the sequences has the schedule's mixture.

Defined results: null or empty text is the end id alone; null and repeated
doc_id are packed row by row; an empty table gives no pieces; extra columns are
ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches
from .tokenizing import encode_ids

_TOKENS = "doc_id long, doc_tokens long, crcs array<long>, deal long, range long"
_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Tournament:
    """Free room of bins 0..n-1 as the leaves of a tournament: each inner node has the larger of its two."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1 << max(0, bins - 1).bit_length()
        self.room = [capacity] * (2 * self.leaves)

    def first_fit(self, size: int) -> int:
        """Put an item into the first bin with room for it; there must be one."""
        room, node = self.room, 1
        while node < self.leaves:
            node *= 2
            node += room[node] < size
        room[node] -= size
        at = node
        while node > 1:
            node //= 2
            room[node] = max(room[2 * node], room[2 * node + 1])
        return at - self.leaves


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of each item, and the number of bins; ties keep their order."""
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    tree = Tournament(max(1, len(sizes)), capacity)
    used = 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        b = tree.first_fit(size)
        bins[i], offsets[i] = b, capacity - tree.room[tree.leaves + b] - size
        used = max(used, b + 1)
    return bins, offsets, used


def _tokenized(capacity: int, path: str, end_id: int):
    """Rows (doc_id, text, range) as `_TOKENS`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 64):
                part = batch.slice(at, 64)
                doc_ids = part.column(0)
                texts = part.column(1).fill_null("").to_pylist()
                n, crcs, deal = [], [], []
                for doc_id, ids in zip(doc_ids.to_pylist(), encode_ids(texts, path)):
                    raw = np.array([*ids, end_id], "<u4")
                    own = [zlib.crc32(raw[i : i + capacity].tobytes()) for i in range(0, len(raw), capacity)]
                    n.append(len(raw))
                    crcs.append(own)
                    deal.append(zlib.crc32(f"{doc_id} {own[0]} {len(raw)}".encode()))
                yield pa.RecordBatch.from_arrays([doc_ids.cast(pa.int64()), pa.array(n, pa.int64()), pa.array(crcs, pa.list_(pa.int64())), pa.array(deal, pa.int64()), part.column(2)], names=["doc_id", "doc_tokens", "crcs", "deal", "range"])

    return run


def _packed(capacity: int, group_rows: int, ordered: bool):
    def group(table: pa.Table, high: int, base: int) -> tuple[pa.RecordBatch, int]:
        n = table["doc_tokens"].to_numpy()
        full, rest = n // capacity, n % capacity
        with_rest = np.flatnonzero(rest)
        bins, offsets, used = first_fit_decreasing(rest[with_rest], capacity)
        own = used + np.cumsum(full) - full  # the first sequence of each document's whole windows
        pieces = full + (rest > 0)
        doc = np.repeat(np.arange(len(n)), pieces)
        k = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        last = k == full[doc]
        rest_bin, rest_offset = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
        rest_bin[with_rest], rest_offset[with_rest] = bins, offsets
        sequence = np.where(last, rest_bin[doc], own[doc] + k)
        if ordered:  # first-fit decreasing puts long rests first; their order must not follow size or source
            sequence = np.random.default_rng([high, base]).permutation(used + int(full.sum()))[sequence]
        sequence = sequence + base + (high << 40)
        columns = [
            table["doc_id"].combine_chunks().take(pa.array(doc)),
            pa.array(k * capacity),
            pa.array(np.where(last, rest[doc], capacity)),
            table["crcs"].combine_chunks().flatten(),
            pa.array(n[doc]),
            pa.array(sequence),
            pa.array(np.where(last, rest_offset[doc], 0)),
        ]
        columns = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns]
        return pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in _PIECES.split(", ")]), base + used + int(full.sum())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        high, base, held, rows = None if ordered else TaskContext.get().partitionId(), 0, [], 0
        for batch in batches:
            while len(batch):
                if ordered:
                    ranges = batch.column(4).to_numpy()
                    if ranges[0] != high:
                        if rows:
                            yield group(pa.Table.from_batches(held), high, base)[0]
                        high, base, held, rows = int(ranges[0]), 0, [], 0
                    part = batch.slice(0, min(group_rows - rows, int(np.searchsorted(ranges, high, "right"))))
                else:
                    part = batch.slice(0, group_rows - rows)
                batch = batch.slice(len(part))
                held.append(part)
                rows += len(part)
                if rows == group_rows:
                    out, base = group(pa.Table.from_batches(held), high, base)
                    yield out
                    held, rows = [], 0
        if rows:
            yield group(pa.Table.from_batches(held), high, base)[0]

    return run


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 1024, end_id: int = 0, group_rows: int = 16384, order: str | None = None) -> DataFrame:
    """One row per piece: where it starts in its document and where it lies in its sequence.

    `order` names a column of slots from 0 on; sequences then follow it by ranges of slots.

    Only token counts and checksums are shuffled, not ids. `ids_crc32` is the
    checksum of the piece's ids as little-endian unsigned 32-bit integers.
    """
    small_batches(docs.sparkSession)
    place = F.lit(0)
    if order is not None:
        size = docs.agg(F.count("*").alias("rows"), F.max(order).alias("last")).first()
        place = F.floor(F.col(order) / max(1, group_rows * ((size["last"] or 0) + 1) // max(1, size["rows"])))
    tokens = docs.select("doc_id", "text", place.cast("long").alias("range")).mapInArrow(_tokenized(capacity, tokenizer_path, end_id), _TOKENS)
    dealt = tokens.repartition("deal" if order is None else "range").sortWithinPartitions("range", "deal", "doc_id", "doc_tokens")
    return dealt.mapInArrow(_packed(capacity, group_rows, order is not None), _PIECES)
