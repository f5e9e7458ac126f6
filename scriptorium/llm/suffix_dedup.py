"""Suffix-array dedup: difference-cover suffix sorting, one bucket of suffixes at a time.

Finds every byte that lies in a string of `length` bytes which also starts anywhere
else. The steps:

1. Anchors. Of the k-byte strings inside each window of `length` bytes, the one with the
   least hash (leftmost on ties) is the window's anchor. It depends on the
   window's bytes only, so equal windows have equal anchors at equal places: a
   suffix bucket per anchor string holds all there is to compare. An anchor
   string that occurs once in the whole input can't be in a repeated window.
2. Contexts. An anchor that occurs again gives its suffix, cut after `length` bytes, and the
   bytes before it that a window could reach. All of a context that occurs in two places is repeated; for
   the rest, equal contexts are one.
3. Buckets of up to `HOT` contexts are sorted one after the other in blocks of bounded size: suffixes by
   their first v bytes, and long ties by the precomputed ranks of the block's
   difference-cover sample (for any two positions some shift below v brings both
   into the sample). The texts before the anchors are sorted the same way,
   reversed. Common prefixes of sorted neighbours then give, for each context, how
   far the longest repeated windows reach to both sides.
4. Larger buckets are split by the bytes around the anchor, so that no task gets one (`_split_buckets`):
   the windows that contain the anchor fall into `GROUPS` ranges of their start, and contexts go to a
   sub-bucket for each range by the bytes that all its windows share (its core); sub-buckets with one context are
   done, and the others are split again by the rest of the window, until the members of a
   sub-bucket have the whole window in common. Counts combine before each shuffle.
5. Ranges are merged per text and cut out.

Texts are keyed by their MD5 digest; copies of a whole text take part once, and all
their bytes go if there are `length` or more.

Defined results: null text is empty; texts shorter than `length` lose nothing (they hold no
such string); repeated rows are copies, whatever their doc_id; null doc_id
stay; an empty table gives no rows; extra columns are ignored by `spans` and kept by
`remove`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cmp_to_key, lru_cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, document_text, lean, mix, small_batches, stash, text_slices

#: Contexts of one anchor up to which its bucket is sorted whole: a worker takes some 40 KB for each.
HOT = 8192
#: Contexts from which a block of buckets is sorted.
BLOCK = 2048
#: Ranges of window starts by which larger buckets are split.
GROUPS = 8
_M = np.uint64(0x94D049BB133111EB)


def difference_cover(r: int) -> tuple[int, list[int]]:
    """A period v and a cover of it, by the construction of Colbourn and Ling: 6r + 4 residues for v = 24r^2 + 36r + 13."""
    steps = [1] * r + [r + 1] + [2 * r + 1] * r + [4 * r + 3] * (2 * r + 1) + [2 * r + 2] * (r + 1) + [1] * r
    return 24 * r * r + 36 * r + 13, np.cumsum([0, *steps]).tolist()


@lru_cache(maxsize=4)
def _cover(r: int = 2) -> tuple[int, np.ndarray, np.ndarray]:
    """Period, which residues are sampled, and the least shift that brings two residues into the sample."""
    v, residues = difference_cover(r)
    inside = np.zeros(v, bool)
    inside[residues] = True
    shift = np.full((v, v), v, np.int32)
    for d in range(v - 1, -1, -1):
        hit = np.flatnonzero(inside[(np.arange(v) + d) % v])
        shift[np.ix_(hit, hit)] = d
    return v, inside, shift


def _anchor_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k-byte strings (k: 8 times a power of two)."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    h = mix(np.ndarray(max(0, len(data) - 7), "<u8", padded.data, strides=(1,)) + np.uint64(1))
    width = 8
    while width < k:
        h = h[:-width] * _M + h[width:]
        h ^= h >> np.uint64(29)
        width *= 2
    return mix(h)


def anchors(data: np.ndarray, offsets: np.ndarray, length: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the anchors of all windows inside the texts, and their hashes."""
    none = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    if len(data) < length:
        return none
    h = _anchor_hashes(data, k)
    bits = np.uint64(max(1, int(len(h)).bit_length()))
    low = (np.uint64(1) << bits) - np.uint64(1)
    least = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    window, width = length - k + 1, 1
    while 2 * width <= window:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if window > width:
        least = np.minimum(least[: len(least) - (window - width)], least[window - width :])
    # windows that end inside their text
    valid = np.zeros(len(least) + 1, np.int32)
    starts, ends = offsets[:-1], offsets[1:] - length + 1
    some = ends > starts
    np.add.at(valid, starts[some], 1)
    np.add.at(valid, ends[some], -1)
    at = (least[np.cumsum(valid[:-1]) > 0] & low).astype(np.int64)
    if not len(at):
        return none
    at = at[np.concatenate([[True], at[1:] != at[:-1]])]
    return at, h[at]


def _sample_ranks(rows: np.ndarray, residue: np.ndarray) -> np.ndarray:
    """Ranks of the difference-cover sample's suffixes, for each row and each shift below v (elsewhere 0).

    `rows`: texts as rows of bytes + 1, filled up with 0; `residue`: of each row's first position. Blocks of v bytes
    are ranked first, then pairs of ranks v, 2v, ... apart until a rank covers the row.
    """
    v, inside, _ = _cover()
    n, width = rows.shape
    i, j = np.nonzero(inside[(residue[:, None] + np.arange(width)[None, :]) % v])
    padded = np.zeros((n, width + v), np.uint8)
    padded[:, :width] = rows
    blocks = np.lib.stride_tricks.sliding_window_view(padded, v, axis=1)[i, j]
    _, rank = np.unique(np.ascontiguousarray(blocks).view(f"S{v}").ravel(), return_inverse=True)
    dense = np.zeros((n, width), np.int64)
    dense[i, j] = rank + 1
    step = v
    while step < width:
        after = np.zeros((n, width), np.int64)
        after[:, : width - step] = dense[:, step:]
        _, rank = np.unique(dense[i, j] * (len(i) + 2) + after[i, j], return_inverse=True)
        dense[i, j] = rank + 1
        step *= 2
    return dense[:, :v]


def _sort_buckets(rows: np.ndarray, buckets: list[range]) -> list[list[int]]:
    """The order of the suffixes (rows) of each bucket: by the first v bytes, long ties by sample ranks."""
    v, _, shift = _cover()
    residue = (np.arange(len(rows)) * (rows.shape[1] + 1)) % v
    ranks = _sample_ranks(rows, residue)
    heads = np.ascontiguousarray(rows[:, :v]).view(f"S{min(v, rows.shape[1])}").ravel().tolist()

    def compare(x: int, y: int) -> int:
        if heads[x] != heads[y]:
            return -1 if heads[x] < heads[y] else 1
        d = shift[residue[x], residue[y]]
        if d >= rows.shape[1]:  # the first v bytes are whole rows
            return 0
        return int(ranks[x, d]) - int(ranks[y, d])

    key = cmp_to_key(compare)
    return [sorted(b, key=key) for b in buckets]


def _matrix(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Texts as rows of bytes + 1 (UTF-8 has no byte 255), filled up with 0; and their lengths."""
    size = np.array([len(t) for t in texts])
    flat = np.frombuffer(b"".join(texts), np.uint8) + np.uint8(1)
    out = np.zeros((len(texts), width), np.uint8)
    out[np.arange(width)[None, :] < size[:, None]] = flat
    return out, size


def _common(rows: np.ndarray, size: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Common prefix of each sorted row and the one before it (0 for the first)."""
    out = np.zeros(len(order), np.int64)
    differs = rows[order[1:]] != rows[order[:-1]]
    first = np.where(differs.any(axis=1), differs.argmax(axis=1), rows.shape[1])
    out[1:] = np.minimum(first, np.minimum(size[order[1:]], size[order[:-1]]))
    return out


def _reach(left: list[int], left_common: np.ndarray, right: list[int], right_common: np.ndarray, base: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For each context of one bucket how far repeated windows reach before and after the anchor (0, 0: there are none)."""
    m = len(left)
    back, ahead = np.zeros(m, np.int64), np.zeros(m, np.int64)
    lo, ro = np.array(left) - base, np.array(right) - base
    if m <= 48:
        tables = []
        for order, common in ((lo, left_common), (ro, right_common)):
            t = np.zeros((m, m), np.int64)
            for p in range(m - 1):
                t[order[p], order[p + 1 :]] = np.minimum.accumulate(common[p + 1 :])
            tables.append(np.maximum(t, t.T))
        ok = tables[0] + tables[1] >= length
        np.fill_diagonal(ok, False)
        return np.where(ok, tables[0], 0).max(axis=1), np.where(ok, tables[1], 0).max(axis=1)
    depth = int(left_common.max(initial=0))
    for a in range(max(0, length - int(right_common.max(initial=0))), depth + 1):
        classes = []
        for order, common, d in ((lo, left_common, a), (ro, right_common, length - a)):
            c = np.empty(m, np.int64)
            c[order] = np.cumsum(common < d)
            classes.append(c)
        _, inverse, count = np.unique(classes[0] * (m + 1) + classes[1], return_inverse=True, return_counts=True)
        hit = count[inverse] > 1
        back[hit] = a
        ahead[hit & (ahead == 0)] = length - a
    return back, ahead


def _block(buckets: list[list[tuple]], length: int, reach: int) -> Iterator[tuple[bytes, int, int]]:
    """(text key, start, end) of repeated bytes around single contexts; a bucket is a list of (left, right, text key, position)."""
    contexts = [c for b in buckets for c in b]
    spans, at = [], 0
    for b in buckets:
        spans.append(range(at, at + len(b)))
        at += len(b)
    sides = []
    for texts, width in (([c[0][::-1] for c in contexts], reach), ([c[1] for c in contexts], length)):
        rows, size = _matrix(texts, width)
        orders = _sort_buckets(rows, spans)
        flat = np.array([x for o in orders for x in o])
        sides.append((orders, _common(rows, size, flat)))
    for k, span in enumerate(spans):
        part = slice(span.start, span.stop)
        back, ahead = _reach(sides[0][0][k], np.concatenate([[0], sides[0][1][part][1:]]), sides[1][0][k], np.concatenate([[0], sides[1][1][part][1:]]), span.start, length)
        for c, a, b in zip(buckets[k], back.tolist(), ahead.tolist()):
            if a + b >= length:
                yield c[2], c[3] - a, c[3] + b


_CONTEXT = "anchor long, ckey binary, tkey binary, pos long, before int, size int, context binary"
_RANGE = "tkey binary, start long, end long"


def _find_anchors(length: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()  # of this task's rows
        for batch in batches:
            for row, end, data, offsets in text_slices(batch.column(1)):
                at, h = anchors(data, offsets, length, k)
                of = np.searchsorted(offsets, at, "right") - 1
                keys = batch.column(0).slice(row, end - row)
                own = keys.to_pylist()
                fresh = np.array([not (x in seen or seen.add(x)) for x in own], bool)
                keep = fresh[of]
                at, h, of = at[keep], h[keep], of[keep]
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), keys.take(pa.array(of)), pa.array(at - offsets[of])], names=["anchor", "tkey", "pos"])

    return run


def _once_compressed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text of a task once, compressed for the shuffle."""
    seen: set[bytes] = set()
    compress = zstandard.ZstdCompressor(level=1).compress
    for batch in batches:
        keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        rows = [k for k, x in enumerate(keys) if not (x in seen or seen.add(x))]
        yield pa.RecordBatch.from_arrays([pa.array([keys[k] for k in rows], pa.binary()), pa.array([compress(texts[k].encode()) for k in rows], pa.binary())], names=["tkey", "packed"])


def _contexts(length: int, k: int):
    reach = length - k

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen = None, set()
        plain = zstandard.ZstdDecompressor()
        for batch in batches:
            out: list[list] = [[], [], [], [], [], [], []]
            for tkey, packed, own in zip(*(c.to_pylist() for c in batch.columns)):
                if tkey == last:  # a copy from another task
                    continue
                last = tkey
                raw = plain.decompress(packed)
                for x in own:
                    p = x["pos"]
                    a = max(0, p - reach)
                    context = raw[a : p + length]
                    ckey = xxhash.xxh3_128_digest(context, seed=p - a)
                    new = ckey not in seen
                    if new and len(seen) < 1 << 18:
                        seen.add(ckey)
                    for column, value in zip(out, (x["anchor"], ckey, tkey, p, p - a, len(context), context if new else None)):
                        column.append(value)
            kinds = (pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], names=[x.split()[0] for x in _CONTEXT.split(", ")])

    return run


def _sorted_buckets(length: int, k: int):
    reach = length - k

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[bytes, int, int]] = []
        buckets: list[list[tuple]] = []
        held = 0
        bucket: list[tuple] = []  # one entry for each different context of the current anchor
        anchor = ckey = None

        def ranges() -> pa.RecordBatch:
            nonlocal found
            columns = list(zip(*found)) or [(), (), ()]
            found = []
            return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.binary()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64())], names=["tkey", "start", "end"])

        def end_bucket() -> None:
            nonlocal held, bucket
            if len(bucket) > 1:
                buckets.append(bucket)
                held += len(bucket)
            bucket = []

        for batch in batches:
            for a, c, tkey, pos, before, context in zip(*(x.to_pylist() for x in batch.columns)):
                if a != anchor:
                    end_bucket()
                    if held >= BLOCK:
                        found.extend(_block(buckets, length, reach))
                        buckets, held = [], 0
                elif c == ckey:  # the same context from another task
                    continue
                anchor, ckey = a, c
                bucket.append((context[:before], context[before:], tkey, pos))
            if len(found) > 4096:
                yield ranges()
        end_bucket()
        if buckets:
            found.extend(_block(buckets, length, reach))
        yield ranges()

    return run


class _Rows:
    """Rows of few columns, given out in batches of bounded size."""

    def __init__(self, kinds: list[pa.DataType], names: list[str]):
        self.kinds, self.names = kinds, names
        self.columns: list[list] = [[] for _ in kinds]

    def add(self, *row) -> None:
        for column, value in zip(self.columns, row):
            column.append(value)

    def batches(self, least: int = 1) -> Iterator[pa.RecordBatch]:
        if len(self.columns[0]) >= least:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(self.columns, self.kinds)], names=self.names)
            self.columns = [[] for _ in self.kinds]


def _steps(length: int, k: int) -> list[range]:
    """How many bytes of a window stand before its anchor, in `GROUPS` ranges."""
    many = length - k + 1
    step = -(-many // GROUPS)
    return [range(at, min(at + step, many)) for at in range(0, many, step)]


def _core_keys(length: int, k: int):
    """For each context and range: the key of what its windows share (slot 2g), and of its first window (slot 2g + 1)."""
    groups = _steps(length, k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = _Rows([pa.binary(), pa.binary(), pa.int32()], ["key", "ckey", "slot"])
        for batch in batches:
            for ckey, before, context in zip(*(c.to_pylist() for c in batch.columns)):
                for g, x in enumerate(groups):
                    start, end = before - x[0], before - x[-1] + length
                    if start >= 0 and end <= len(context):
                        rows.add(xxhash.xxh3_128_digest(context[start:end], seed=2 * g), ckey, 2 * g)
                    if start >= 0 and start + length <= len(context):
                        rows.add(xxhash.xxh3_128_digest(context[start : start + length], seed=2 * g + 1), ckey, 2 * g + 1)
                yield from rows.batches(1 << 15)
        yield from rows.batches()

    return run


def _window_keys(length: int, k: int):
    """All windows of the ranges (slots) that are still open, by their first byte's distance to the anchor."""
    groups = _steps(length, k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = _Rows([pa.binary(), pa.binary(), pa.binary(), pa.int64()], ["key", "ckey", "tkey", "start"])
        for batch in batches:
            for ckey, tkey, pos, before, context, slots in zip(*(c.to_pylist() for c in batch.columns)):
                for slot in slots:
                    for x in groups[slot // 2]:
                        start = before - x
                        if start >= 0 and start + length <= len(context):
                            rows.add(xxhash.xxh3_128_digest(context[start : start + length], seed=x), ckey, tkey, pos - x)
                yield from rows.batches(1 << 15)
        yield from rows.batches()

    return run


def _in_two_places(rows: DataFrame, key: str, place: F.Column) -> DataFrame:
    """Keys of rows at more than one place."""
    ends = rows.groupBy(key).agg(F.min(place).alias("_low"), F.max(place).alias("_high"))
    return ends.where(F.col("_low") != F.col("_high")).select(key)


def _split_buckets(first: DataFrame, length: int, k: int, space: Workspace) -> DataFrame:
    """Ranges (tkey, start, end) of repeated bytes around the anchors of large buckets; `first`: their contexts with bytes."""
    own = F.xxhash64("ckey")
    cores = first.select("ckey", "before", "context").mapInArrow(lean(_core_keys(length, k)), "key binary, ckey binary, slot int")
    cores = space.stash(cores.distinct(), "cores")
    cores = space.stash(cores.join(_in_two_places(cores, "key", own), "key", "left_semi"), "cores")
    # of each context: the repeated first windows furthest to either side; what lies between them is settled
    mark = F.when(F.col("slot") % 2 == 1, F.floor(F.col("slot") / 2))
    known = cores.groupBy("ckey").agg(F.min(mark).alias("low"), F.max(mark).alias("high"))
    step = lambda g: F.element_at(F.array(*(F.lit(x[0]) for x in _steps(length, k))), g.cast("int") + 1)
    settled = first.select("ckey", "tkey", "pos").join(known.where("low is not null"), "ckey")
    settled = settled.select("tkey", (F.col("pos") - step(F.col("high"))).alias("start"), (F.col("pos") - step(F.col("low")) + length).alias("end"))
    group = F.floor(F.col("slot") / 2)
    is_open = F.col("low").isNull() | (group >= F.col("high")) | (group < F.col("low"))
    inner = cores.where(F.col("slot") % 2 == 0)
    needed = inner.join(known, "ckey").where(is_open).select("key").distinct()
    todo = inner.join(needed, "key", "left_semi").groupBy("ckey").agg(F.collect_set("slot").alias("slots"))
    windows = first.join(todo, "ckey").select("ckey", "tkey", "pos", "before", "context", "slots").mapInArrow(lean(_window_keys(length, k)), "key binary, ckey binary, tkey binary, start long")
    windows = space.stash(windows, "windows")
    found = windows.join(_in_two_places(windows, "key", own), "key", "left_semi").select("tkey", "start", (F.col("start") + length).alias("end"))
    return settled.unionByName(found)


def _key(text: F.Column) -> F.Column:
    return F.unhex(F.md5(text.cast("binary")))


def _repeated(docs: DataFrame, length: int, hot: int, space: Workspace) -> tuple[DataFrame, DataFrame]:
    """(tkey, start, end) of repeated bytes inside different places, and the packed texts that may have some."""
    spark = docs.sparkSession
    small_batches(spark)
    k = 64 if length >= 256 else 32 if length >= 96 else 8
    texts = docs.select(_key(document_text()).alias("tkey"), document_text().alias("text")).where(F.octet_length("text") >= length)
    every = space.stash(texts.mapInArrow(lean(_find_anchors(length, k)), "anchor long, tkey binary, pos long"), "anchors")
    place = F.xxhash64("tkey", "pos")
    again = space.stash(_in_two_places(every, "anchor", place), "again")
    # one row an anchor on the right: a frequent one's rows on the left can be split over tasks
    lists = every.join(again, "anchor").groupBy("tkey").agg(F.sort_array(F.collect_set(F.struct("pos", "anchor"))).alias("own"))
    packed = texts.mapInArrow(lean(_once_compressed), "tkey binary, packed binary")
    small_batches(spark, 256)
    some = space.stash(packed.join(lists, "tkey"), "texts")
    contexts = space.stash(some.mapInArrow(lean(_contexts(length, k)), _CONTEXT), "contexts")
    twice = _in_two_places(contexts, "ckey", place)
    start = F.col("pos") - F.col("before")
    ranges = contexts.where(F.col("size") >= length).join(twice, "ckey", "left_semi").select("tkey", start.alias("start"), (start + F.col("size")).alias("end"))
    first = contexts.where(F.col("context").isNotNull()).select("anchor", "ckey", "tkey", "pos", "before", "context")
    large = first.select("anchor", "ckey").distinct().groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > hot).select("anchor")
    large = space.stash(large, "large")
    dealt = first.join(large, "anchor", "left_anti").repartition("anchor").sortWithinPartitions("anchor", "ckey", "tkey", "pos")
    ranges = ranges.unionByName(space.stash(dealt.mapInArrow(lean(_sorted_buckets(length, k)), _RANGE), "ranges"))
    ranges = ranges.unionByName(_split_buckets(first.join(large, "anchor", "left_semi"), length, k, space))
    return ranges, some.select("tkey", "packed")


def _merged(ranges: list[dict], size: int) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for r in sorted((x["start"], x["end"]) for x in ranges):
        if out and r[0] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], r[1])
        else:
            out.append([max(0, r[0]), r[1]])
    return [(a, min(b, size)) for a, b in out]


def _cut(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        plain = zstandard.ZstdDecompressor()
        for batch in batches:
            rows = []
            for tkey, packed, ranges in zip(*(c.to_pylist() for c in batch.columns)):
                if tkey == last:
                    continue
                last = tkey
                raw = plain.decompress(packed)
                spans = _merged(ranges, len(raw))
                edges = [0, *(x for s in spans for x in s), len(raw)]
                kept = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2]))
                text = kept.decode(errors="ignore") if with_text else None
                rows.append((tkey, len(raw) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), text))
            columns = list(zip(*rows)) or [()] * 5
            kinds = (pa.binary(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["_tkey", "_removed", "_spans", "_sha", "_kept"])

    return run


def _results(docs: DataFrame, length: int, with_text: bool, hot: int) -> DataFrame:
    """The rows of `docs` with _key, _n (bytes), _copies, and _removed, _spans, _sha, _kept where bytes inside go."""
    space = Workspace()
    ranges, texts = _repeated(docs, length, hot, space)
    per_text = ranges.distinct().groupBy("tkey").agg(F.collect_list(F.struct("start", "end")).alias("own"))
    cut = texts.join(per_text, "tkey").mapInArrow(lean(_cut(with_text)), "_tkey binary, _removed long, _spans long, _sha string, _kept string")
    # a text whose copies come from several tasks may be there more than once
    cut = cut.groupBy("_tkey").agg(*(F.first(c, ignorenulls=True).alias(c) for c in ("_removed", "_spans", "_sha", "_kept")))
    cut = stash(cut, "cut")
    space.clear()
    rows = docs.withColumn("_key", _key(document_text())).withColumn("_n", F.octet_length(document_text()).cast("long"))
    copies = rows.where(F.col("_n") >= length).groupBy("_key").agg(F.count("*").alias("_copies")).where(F.col("_copies") > 1)
    changed = cut.join(copies.withColumnRenamed("_key", "_tkey"), "_tkey", "full_outer")
    return rows.join(changed, rows["_key"] == changed["_tkey"], "left").drop("_tkey")


def spans(docs: DataFrame, length: int = 400, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each row."""
    base = docs.select("doc_id", "text")
    out = _results(base, length, False, hot)
    whole = F.col("_copies").isNotNull()
    return out.select(
        "doc_id",
        F.col("_n").alias("n_bytes"),
        F.when(whole, F.col("_n")).otherwise(F.coalesce("_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(whole, F.lit(1)).otherwise(F.coalesce("_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(whole, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.coalesce("_sha", F.sha2(document_text().cast("binary"), 256))).alias("kept_sha256"),
    )


def remove(docs: DataFrame, length: int = 400, hot: int = HOT) -> DataFrame:
    """The same columns and rows, the repeated bytes cut out of `text` (a cut character goes whole) and `n_chars` brought up to date."""
    out = _results(docs, length, True, hot)
    text = F.when(F.col("_copies").isNotNull(), F.lit("")).otherwise(F.coalesce("_kept", "text"))
    out = out.withColumn("text", text).select(*docs.columns)
    return out.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else out
