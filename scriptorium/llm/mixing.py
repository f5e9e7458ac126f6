"""Mixing sources to target weights: a Pfair schedule of source blocks.

Each source's rows, in an order given by a hash, are cut into blocks of
`block_bytes` bytes of text. With weight w a source's block i (from 0) is released at
slot floor(i / w) and due before slot ceil((i + 1) / w); in each slot the released
block with the earliest deadline runs. Weights are taken as exact fractions, so every
deadline is met and after any number of slots each source deviates from its share by less than one
block. With weights that are whole numbers out of Q the schedule repeats after Q slots and
only one period is worked out, else every slot is: on the driver, in one step a block (by default there are at
most `MOST_BLOCKS` blocks and one more a source, whatever the input's size). When a source is used up, the others' weights are scaled up
and a new phase starts; there are at most as many phases as sources.

The driver gets one row per source and holds one number per block. Ranks inside a source come from partial sums
over hash ranges of its rows, so a source with a third of all rows is dealt over
many tasks.

Defined results: every row is placed, none is dropped or repeated; null source is
a source of its own; null text has 0 bytes; repeated rows follow each other; an empty
table gives no rows; a source of no bytes has one block; other columns of the input are kept (those
named like the schedule's, `ADDED` behind the prefix, are replaced: choose a free prefix).
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from fractions import Fraction

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import document_text

ROWS_PER_RANGE = 1024
#: Columns of the schedule.
ADDED = ("n_bytes", "rank", "block", "phase", "slot")
#: Default blocks: bytes at least, and how many of all sources at most, which bounds the driver's schedule.
LEAST_BLOCK, MOST_BLOCKS = 1 << 14, 1 << 20
#: Entries of the schedule up to which it is broadcast.
BROADCAST_ENTRIES = 1 << 20
#: Blocks in one row of the schedule's table.
CHUNK = 128


def whole_shares(weights: list[Fraction], period: int) -> list[int] | None:
    """The weights as whole numbers that sum to `period`, or None where they are none."""
    exact = [w * period / sum(weights) for w in weights]
    return [int(x) for x in exact] if all(x.denominator == 1 and x >= 1 for x in exact) else None


def pfair_period(shares: list[int]) -> list[list[int]]:
    """Slots of each source's blocks in one period of sum(shares) slots, by earliest deadline among the released."""
    period = sum(shares)
    release = [[] for _ in range(period)]
    for s, c in enumerate(shares):
        for i in range(c):
            release[i * period // c].append((-((-(i + 1) * period) // c), s, i))
    slots: list[list[int]] = [[0] * c for c in shares]
    ready: list[tuple[int, int, int]] = []
    for t in range(period):
        for x in release[t]:
            heapq.heappush(ready, x)
        deadline, s, i = heapq.heappop(ready)
        slots[s][i] = t
    return slots


def pfair_until(weights: list[Fraction], blocks: list[int]) -> tuple[list[list[int]], int]:
    """Slots of each source's blocks by earliest deadline among the released, up to the slot in which a source's last block runs."""
    whole = sum(weights)
    step = [whole / w for w in weights]
    slots: list[list[int]] = [[] for _ in weights]
    coming = [(0, s, 0) for s in range(len(weights))]  # (release, source, block)
    ready: list[tuple[int, int, int]] = []
    t = 0
    while True:
        while coming and coming[0][0] <= t:
            _, s, i = heapq.heappop(coming)
            up, down = (i + 1) * step[s].numerator, step[s].denominator
            heapq.heappush(ready, (-(-up // down), s, i))
            heapq.heappush(coming, (up // down, s, i + 1))
        _, s, i = heapq.heappop(ready)
        slots[s].append(t)
        t += 1
        if i + 1 == blocks[s]:
            return slots, t


def schedule(weights: list[float], blocks: list[int], period: int = 1000) -> list[tuple[int, int, int, int, int, list[int]]]:
    """(source, phase, its first block, first slot, period, slots in the period) of every source and phase.

    Weights that are whole numbers out of `period` give one period that repeats; with others a phase is one
    period as long as itself, so that no share is rounded.
    """
    out, start, phase = [], 0, 0
    exact = [Fraction(w) for w in weights]
    left, first = list(blocks), [0] * len(blocks)
    live = [s for s, n in enumerate(blocks) if n > 0]
    while live:
        own_weights = [exact[s] for s in live]
        shares = [1] if len(live) == 1 else whole_shares(own_weights, period)
        if shares is not None:
            q, slots = sum(shares), pfair_period(shares)
            end = min((left[s] - 1) // c * q + own[(left[s] - 1) % c] for s, c, own in zip(live, shares, slots)) + 1
        else:
            slots, end = pfair_until(own_weights, [left[s] for s in live])
            q = end
        for s, own in zip(live, slots):
            if own:
                out.append((s, phase, first[s], start, q, own))
                done = end // q * len(own) + sum(x < end % q for x in own)
                first[s] += done
                left[s] -= done
        start, phase = start + end, phase + 1
        live = [s for s in live if left[s] > 0]
    return out


def placements(table: list[tuple[int, int, int, int, int, list[int]]], blocks: list[int]) -> Iterator[tuple[int, int, int, int, list[int]]]:
    """(source, block // CHUNK, phase, first block, slots of the blocks from it on) of a schedule, in rows of up to CHUNK blocks."""
    ends = dict(enumerate(blocks))
    for s, phase, first, start, q, own in reversed(table):
        at = first
        while at < ends[s]:
            to = min(ends[s], (at // CHUNK + 1) * CHUNK)
            yield s, at // CHUNK, phase, at, [start + (b - first) // len(own) * q + own[(b - first) % len(own)] for b in range(at, to)]
            at = to
        ends[s] = first


def mix(docs: DataFrame, weights: dict[str | None, float] | None = None, block_bytes: int | None = None, period: int = 1000, prefix: str = "") -> DataFrame:
    """Add `n_bytes`, `rank`, `block`, `phase` and `slot`, each with `prefix` before its name; rows in order of (slot, rank) are the mixture.

    Without `weights`, a source's weight is the square root of its bytes. A
    source without a given weight gets the smallest given one. Without `block_bytes`, blocks have
    `LEAST_BLOCK` bytes, or as many more as make at most `MOST_BLOCKS` of all bytes.
    """
    spark = docs.sparkSession
    n_bytes, rank, block, phase, slot = (prefix + c for c in ADDED)
    rows = docs.drop(n_bytes, rank, block, phase, slot)
    rows = rows.withColumn(n_bytes, F.octet_length(document_text()).cast("long")).withColumn("_mix_hash", F.xxhash64("doc_id", "text"))
    ranges = 1 << max(4, math.ceil(math.log2(max(1, docs.count()) / ROWS_PER_RANGE + 1)))
    rows = rows.withColumn("_mix_range", F.shiftrightunsigned("_mix_hash", 64 - int(math.log2(ranges))))
    # partial sums: source x range -> bytes and rows before it
    sums = rows.groupBy("source", "_mix_range").agg(F.sum(n_bytes).alias("_bytes"), F.count("*").alias("_rows"))
    # one row per source
    totals = rows.groupBy("source").agg(F.sum(n_bytes).alias("n")).orderBy("source").collect()
    names, sizes = [t["source"] for t in totals], [t["n"] for t in totals]
    size = block_bytes or max(LEAST_BLOCK, -(-sum(sizes) // MOST_BLOCKS))
    before = Window.partitionBy("source").orderBy("_mix_range").rowsBetween(Window.unboundedPreceding, -1)
    whole = F.sum("_bytes").over(Window.partitionBy("source"))
    first_of = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    # rows of no bytes behind the last byte stay in the last block
    last = F.greatest(F.lit(1), F.ceil(whole / size)) - 1
    sums = sums.select(F.col("source").alias("_mix_source"), F.col("_mix_range").alias("_mix_r"), first_of("_bytes").alias("_mix_bytes"), first_of("_rows").alias("_mix_rows"), last.alias("_mix_last"))
    inside = Window.partitionBy("source", "_mix_range").orderBy("_mix_hash", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("_mix_own", F.coalesce(F.sum(n_bytes).over(inside), F.lit(0))).withColumn("_mix_own_rows", F.coalesce(F.count("*").over(inside), F.lit(0)))
    placed = placed.join(sums.hint("merge"), placed["source"].eqNullSafe(sums["_mix_source"]) & (placed["_mix_range"] == sums["_mix_r"]))
    placed = placed.withColumn(rank, F.col("_mix_rows") + F.col("_mix_own_rows")).withColumn(block, F.least(F.floor((F.col("_mix_bytes") + F.col("_mix_own")) / size), F.col("_mix_last")).cast("long"))
    placed = placed.drop("_mix_source", "_mix_r", "_mix_own", "_mix_own_rows", "_mix_bytes", "_mix_rows", "_mix_range", "_mix_hash", "_mix_last")
    if weights is None:
        own = [math.sqrt(max(1, n)) for n in sizes]
    else:
        least = min(weights.values())
        own = [float(weights.get(x, least)) for x in names]
    blocks = [max(1, -(-n // size)) for n in sizes]
    rows_of = placements(schedule(own, blocks, period), blocks)
    plan = spark.createDataFrame([(names[k], chunk, number, first, slots) for k, chunk, number, first, slots in rows_of], "_mix_source string, _mix_chunk long, _mix_phase int, _mix_first long, _mix_slots array<long>")
    if sum(blocks) <= BROADCAST_ENTRIES:
        plan = F.broadcast(plan)
    at = F.col(block) - F.col("_mix_first")
    here = placed["source"].eqNullSafe(F.col("_mix_source")) & (F.floor(F.col(block) / CHUNK) == F.col("_mix_chunk")) & (at >= 0) & (at < F.size("_mix_slots"))
    out = placed.join(plan, here).withColumn(phase, F.col("_mix_phase")).withColumn(slot, F.element_at("_mix_slots", (at + 1).cast("int")))
    return out.drop("_mix_source", "_mix_chunk", "_mix_phase", "_mix_first", "_mix_slots")


def deviation(weights: list[int] | list[Fraction], order: list[int]) -> Fraction:
    """The largest distance, in blocks, of any source from its share after any number of slots."""
    total, done, worst = sum(weights), [0] * len(weights), Fraction(0)
    for t, s in enumerate(order, 1):
        done[s] += 1
        worst = max(worst, *(abs(Fraction(w * t, total) - d) for w, d in zip(weights, done)))
    return worst
