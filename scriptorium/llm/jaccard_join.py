"""N-gram Jaccard join: a grouped prefix join over sets of word shingles.

A document's set holds 64-bit hashes of its distinct shingles. The steps:

1. A count sketch of fixed size over all documents' shingles orders them: rare
   first, then by hash. Any order gives right results; this one keeps
   frequent shingles out of prefixes.
2. Each set gives its prefix: the first n - ceil(t n) + 1 shingles in that order. Two
   sets of similarity t or more share a shingle of their prefixes.
3. Documents with equal sets are one class; classes with equal prefix and size are one
   group, and only groups go through the join.
4. Shingles of the groups' prefixes are dealt and sorted; a list (the groups
   that share one) of up to `SHORT` groups gives its pairs that pass the positional filter (what
   is left of both sets from the shared shingle on must be enough; it implies the length filter). A
   longer one only links neighbours in size, and all with a few pivots: those with the least before the shingle.
5. Group pairs are expanded to pairs of their members; marks of 128 bytes rule most
   of the unlike ones out, and the rest are verified on the whole texts' sets. Verified links give components.
6. Long lists and large groups whose members are not in one component by now are
   settled exactly: all their pairs across components that pass the positional filter are verified.
   Pairs inside a component need no look, as they cannot change it. So no pair
   within a group of copies is enumerated, and no link between components is lost.
7. Each component's links are counted in blocks of its classes (`_link_counts`), all of them, without emitting pairs.

Defined results: null or empty text has an empty set and is linked with nothing;
rows that share a doc_id are one document (linked if any of its texts is); a null
doc_id is a document of its text's own, reported without an id and never as a
component's id unless all are null; repeated rows stay; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace, document_text, lean, packed, shingle_hashes, small_batches, stash, text_slices, unpacked, word_hashes
from .components import components

#: log2 of the sketch's counters; 4 bytes each, whatever the input's size.
SKETCH_BITS = 18
_SLICES = 16
#: Groups up to which a list gives all its pairs, and members up to which a group does.
SHORT, SMALL_GROUP = 64, 16
#: Entries of a long list that all others are compared with at once.
PIVOTS = 3
#: Rows of one list that are held at once.
_HELD = 1 << 20
_NULL_ID = 1 << 62
#: Shingles of a piece of a component (a class counts as `_PIECE_ROW` more), and the sizes of the matrices that count its links.
_PIECE, _PIECE_ROW = 1 << 19, 256
_TILE, _TILE_TERMS = 512, 4096
#: Bits of a set's parity mark.
MARK_BITS = 1024


@dataclass(frozen=True)
class Likeness:
    """Shingles of `size` words; linked when 100 * intersection >= percent * union."""

    size: int = 5
    percent: int = 80
    lower: bool = False

    def prefix(self, n: int) -> int:
        return n - -(-self.percent * n // 100) + 1

    def linked(self, common: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
        return (100 * common >= self.percent * (n + m - common)) & (n > 0) & (m > 0)


def _sets(column: pa.Array, how: Likeness) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of each text."""
    for row, _, data, offsets in text_slices(column):
        words, first = word_hashes(data, offsets, how.lower)
        for k, h in enumerate(shingle_hashes(words, first, how.size)):
            yield row + k, np.unique(h)


def _node() -> F.Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL_ID).bitwiseOR(F.shiftrightunsigned(F.xxhash64("text"), 2)))


def shingle_sketch(docs: DataFrame, how: Likeness) -> np.ndarray:
    """Counters of the shingles of all documents; summed by slices in two levels, so no task gets all tasks' counters."""
    part = (1 << SKETCH_BITS) // _SLICES

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SKETCH_BITS, np.int64)
        for batch in batches:
            held, size = [], 0
            for _, h in _sets(batch.column(0), how):
                held.append(h)
                size += len(h)
                if size > 1 << 18:
                    total += np.bincount(np.concatenate(held) >> np.uint64(64 - SKETCH_BITS), minlength=len(total))
                    held, size = [], 0
            if held:
                total += np.bincount(np.concatenate(held) >> np.uint64(64 - SKETCH_BITS), minlength=len(total))
        task = TaskContext.get().partitionId()
        counts = np.minimum(total, 2**32 - 1).astype("<u4")
        yield pa.RecordBatch.from_arrays([pa.array(range(_SLICES), pa.int32()), pa.array([task] * _SLICES, pa.int32()), pa.array([counts[k * part : (k + 1) * part].tobytes() for k in range(_SLICES)], pa.binary())], names=["slice", "task", "counts"])

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(part, np.int64)
        for c in table["counts"]:
            total += np.frombuffer(c.as_buffer(), "<u4")
        return pa.table({"slice": table["slice"][:1].cast(pa.int32()), "task": pa.array([table["task"][0].as_py() % 256], pa.int32()), "counts": pa.array([np.minimum(total, 2**32 - 1).astype("<u4").tobytes()], pa.binary())})

    schema = "slice int, task int, counts binary"
    sums = docs.select(document_text().alias("text")).mapInArrow(lean(count), schema)
    sums = sums.groupBy("slice", F.col("task") % 256).applyInArrow(lambda t: add(t), schema)
    sums = sums.groupBy("slice").applyInArrow(lambda t: add(t), schema)
    rows = {r["slice"]: np.frombuffer(r["counts"], "<u4") for r in sums.collect()}  # 1 MB in all
    return np.concatenate([rows.get(k, np.zeros(part, "<u4")) for k in range(_SLICES)])


def _prefixes(docs: DataFrame, how: Likeness, sketch: np.ndarray) -> DataFrame:
    """doc_id, node, n, keys of the whole set and of prefix and size, and the prefix of each document."""
    shared = docs.sparkSession.sparkContext.broadcast(sketch)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = shared.value
        for batch in batches:
            n, sets, groups, prefixes, lengths, marks = [], [], [], [], [], []
            for _, h in _sets(batch.column(2), how):
                first = h[:0]
                if len(h):
                    at = np.argsort(counts[h >> np.uint64(64 - SKETCH_BITS)], kind="stable")
                    first = h[at[: how.prefix(len(h))]]
                n.append(len(h))
                sets.append(xxhash.xxh3_128_digest(h.tobytes()))
                groups.append(xxhash.xxh3_128_digest(len(h).to_bytes(8, "little") + first.tobytes()))
                prefixes.append(first)
                lengths.append(len(first))
                parity = np.bincount((h & np.uint64(MARK_BITS - 1)).astype(np.int64), minlength=MARK_BITS) & 1
                marks.append(np.packbits(parity.astype(np.uint8)).tobytes())
            values = np.concatenate(prefixes).view(np.int64) if prefixes else np.zeros(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)), pa.array(values))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(sets, pa.binary()), pa.array(groups, pa.binary()), lists, pa.array(marks, pa.binary())], names=["doc_id", "node", "n", "set_key", "group_key", "prefix", "mark"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _node().alias("node"), document_text().alias("text"))
    return rows.mapInArrow(lean(run), "doc_id long, node long, n long, set_key binary, group_key binary, prefix array<long>, mark binary")


def _list_pairs(how: Likeness):
    """Pairs of the sorted lists: a < b; rows of long lists come again as (member, null, list, place in its prefix)."""

    def near(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether two entries (group, size, place) can be alike with this as their first common shingle."""
        room = np.minimum(x[:, 1] - x[:, 2], y[:, 1] - y[:, 2])
        return (x[:, 0] != y[:, 0]) & (room * (100 + how.percent) >= how.percent * (x[:, 1] + y[:, 1]))

    def pairs_of(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        ok = near(x, y)
        return np.sort(np.stack([x[ok, 0], y[ok, 0]], axis=1), axis=1)

    def long_list(own: np.ndarray, known: tuple | None) -> tuple[list, tuple]:
        """Pairs with neighbours in size and with the pivots: the entries with the least before the shingle."""
        if known is None:
            known = own[np.lexsort((own[:, 0], own[:, 2]))[:PIVOTS]], own[:1]
        pivots, before = known
        chain = np.concatenate([before, own])
        pairs = [pairs_of(chain[:-1], chain[1:]), *(pairs_of(np.broadcast_to(p, own.shape), own) for p in pivots)]
        return pairs, (pivots, own[-1:])

    def settled(tok: np.ndarray, entries: np.ndarray, known: tuple | None) -> tuple[list, list, tuple | None]:
        """Pairs and long rows of whole lists, or of a part of one list (known: its pivots and last row)."""
        change = np.flatnonzero(np.concatenate([[True], tok[1:] != tok[:-1]]))
        length = np.diff(np.concatenate([change, [len(tok)]]))
        per_row = np.repeat(length, length)
        long_row = (per_row > SHORT) | (known is not None)
        pairs, rows, last = [], [], None
        mask = (per_row > 1) & ~long_row
        t, e = tok[mask], entries[mask]
        for d in range(1, SHORT):
            same = np.flatnonzero(t[d:] == t[:-d])
            if not len(same):
                break
            pairs.append(pairs_of(e[same], e[same + d]))
        if long_row.any():
            for at, size in zip(change.tolist(), length.tolist()):
                if size > SHORT or known is not None:
                    own = entries[at : at + size]
                    found, last = long_list(own, known)
                    pairs += found
                    rows.append(np.column_stack([own[:, 0], np.full(size, tok[at]), own[:, 2]]))
        return pairs, rows, last

    def batch_of(pairs: list, rows: list) -> Iterator[pa.RecordBatch]:
        found = np.unique(np.concatenate(pairs), axis=0) if pairs else np.zeros((0, 2), np.int64)
        entries = np.concatenate(rows) if rows else np.zeros((0, 3), np.int64)
        n, m = len(found), len(entries)
        if n + m:
            gap = lambda size: pa.nulls(size, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([found[:, 0], entries[:, 0]])),
                    pa.concat_arrays([pa.array(found[:, 1]), gap(m)]),
                    pa.concat_arrays([gap(n), pa.array(entries[:, 1])]),
                    pa.concat_arrays([gap(n), pa.array(entries[:, 2])]),
                ],
                names=["a", "b", "list", "place"],
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size, known = 0, None

        def flush(final: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, size, known
            tok, entries = (np.concatenate([h[k] for h in held]) for k in (0, 1))
            if known is not None and tok[0] != known[2]:
                known = None
            if known is not None:  # the rest of a list whose start is gone
                cut = int(np.searchsorted(tok, tok[0], "right"))
                pairs, rows, last = settled(tok[:cut], entries[:cut], known[:2])
                yield from batch_of(pairs, rows)
                known = (*last, tok[0]) if cut == len(tok) and not final else None
                tok, entries = tok[cut:], entries[cut:]
            end = len(tok) if final else int(np.searchsorted(tok, tok[-1])) if len(tok) else 0  # the last list may go on
            if end == 0 and len(tok) >= _HELD:
                pairs, rows, last = settled(tok, entries, None)
                yield from batch_of(pairs, rows)
                known, end = (*last, tok[0]), len(tok)
            elif end:
                pairs, rows, _ = settled(tok[:end], entries[:end], None)
                yield from batch_of(pairs, rows)
            held, size = ([(tok[end:], entries[end:])] if end < len(tok) else []), len(tok) - end

        for batch in batches:
            if len(batch):
                held.append((batch.column(0).to_numpy(), np.column_stack([batch.column(k).to_numpy() for k in (1, 2, 3)])))
                size += len(batch)
            if size >= 1 << 17:
                yield from flush(False)
        if held:
            yield from flush(True)

    return run


def _plausible(pairs: DataFrame, table: DataFrame, how: Likeness) -> DataFrame:
    """Those of the pairs (a, b) whose marks don't rule them out.

    A mark's bit is the parity of the shingles whose hash falls on it, so two marks differ in at
    most as many bits as the sets differ in shingles: an upper bound of their intersection, for 128 bytes a set.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column(2).to_numpy() + batch.column(3).to_numpy()
            x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint64).reshape(len(batch), -1) for k in (4, 5))
            differ = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)
            keep = pa.array((n - differ) // 2 * (100 + how.percent) >= how.percent * n)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    own = table.where(F.col("n") > 0).select(F.col("node").alias("_id"), "n", "mark")
    left = pairs.join(own, F.col("a") == F.col("_id")).select("a", "b", F.col("n").alias("n"), F.col("mark").alias("x"))
    right = own.select("_id", F.col("n").alias("m"), F.col("mark").alias("y"))
    both = left.join(right, F.col("b") == F.col("_id")).select("a", "b", "n", "m", "x", "y")
    return both.mapInArrow(lean(run), "a long, b long").distinct()


def _verified(pairs: DataFrame, texts: DataFrame, how: Likeness) -> DataFrame:
    """Those of the pairs (a, b) whose sets are alike enough; `texts` has _id and the packed _text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            ids = [batch.column(k).to_numpy() for k in (0, 1)]
            sets: dict[tuple[int, int], np.ndarray] = {}
            which = []
            for side in (0, 1):
                # equal texts of a batch are cut into shingles once
                coded = batch.column(2 + side).dictionary_encode()
                which.append(coded.indices.to_numpy())
                for row, h in _sets(pa.array([plain(x).decode() for x in coded.dictionary.to_pylist()], pa.string()), how):
                    sets[side, row] = h
            keep = []
            for i, j in zip(which[0].tolist(), which[1].tolist()):
                x, y = sets[0, i], sets[1, j]
                if not len(x) or not len(y):
                    keep.append(False)
                    continue
                common = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
                keep.append(bool(how.linked(np.int64(common), np.int64(len(x)), np.int64(len(y)))))
            mask = np.array(keep, bool)
            yield pa.RecordBatch.from_arrays([pa.array(ids[0][mask]), pa.array(ids[1][mask])], names=["a", "b"])

    left = pairs.join(texts, F.col("a") == F.col("_id")).select("a", "b", F.col("_text").alias("x"))
    both = left.join(texts, F.col("b") == F.col("_id")).select("a", "b", "x", F.col("_text").alias("y"))
    return both.mapInArrow(lean(run), "a long, b long").distinct()


def _one_document(table: DataFrame, classes: DataFrame, space: Workspace) -> DataFrame:
    """Links between the classes of rows that share a doc_id but not a set."""
    own = F.xxhash64("set_key")
    several = table.where(F.col("n") > 0).groupBy("node").agg(F.min(own).alias("low"), F.max(own).alias("high")).where(F.col("low") != F.col("high")).select("node")
    several = space.stash(several, "several")
    if several.isEmpty():
        return table.sparkSession.createDataFrame([], "a long, b long")
    rows = table.where(F.col("n") > 0).join(several, "node", "left_semi").select("node", "set_key").join(classes.select("set_key", "cls"), "set_key")
    first = rows.groupBy("node").agg(F.min("cls").alias("a"))
    return rows.join(first, "node").select("a", F.col("cls").alias("b")).where(F.col("a") != F.col("b")).distinct()


def _degrees(how: Likeness):
    """(set_key, links) of the classes of each block, a pair of pieces of one component: sorted by block and side."""

    def matrix(sets: list[np.ndarray], vocabulary: np.ndarray) -> np.ndarray:
        out = np.zeros((len(sets), len(vocabulary)), np.float32)
        for k, h in enumerate(sets):
            at = np.minimum(np.searchsorted(vocabulary, h), len(vocabulary) - 1)
            out[k, at[vocabulary[at] == h]] = 1
        return out

    def count(sides: tuple[list, list]) -> Iterator[pa.RecordBatch]:
        x, y = sides[0], sides[1] or sides[0]
        own = not sides[1]  # a piece with itself
        sets = [[np.frombuffer(r[1], np.uint64) for r in side] for side in (x, y)]
        n = [np.array([len(h) for h in side], np.int64) for side in sets]
        docs = [np.array([r[2] for r in side], np.int64) for side in (x, y)]
        degree = [np.zeros(len(side), np.int64) for side in (x, y)]
        every = np.unique(np.concatenate(sets[1]))
        for at in range(0, len(x), _TILE):
            a = slice(at, at + _TILE)
            vocabulary = np.intersect1d(np.unique(np.concatenate(sets[0][a])), every, assume_unique=True)
            common = np.zeros((len(sets[0][a]), len(y)), np.float32)
            for v in range(0, len(vocabulary), _TILE_TERMS):
                part = vocabulary[v : v + _TILE_TERMS]
                left = matrix(sets[0][a], part)
                for b in range(0, len(y), _TILE):
                    common[:, b : b + _TILE] += left @ matrix(sets[1][b : b + _TILE], part).T
            linked = how.linked(common.astype(np.int64), n[0][a, None], n[1][None, :])
            if own:
                linked[np.arange(len(linked)), np.arange(at, at + len(linked))] = False
            degree[0][a] += linked @ docs[1]
            degree[1] += 0 if own else docs[0][a] @ linked
        keys, links = [r[0] for r in x], [degree[0]]
        if not own:
            keys, links = keys + [r[0] for r in y], [*links, degree[1]]
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(np.concatenate(links))], names=["set_key", "links"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, sides = None, ([], [])
        for batch in batches:
            for key, side, set_key, members, documents in zip(*(c.to_pylist() for c in batch.columns)):
                if key != block and sides[0]:
                    yield from count(sides)
                    sides = ([], [])
                block = key
                sides[side].append((set_key, members, documents))
        if sides[0]:
            yield from count(sides)

    return run


def _link_counts(texts: DataFrame, how: Likeness, table: DataFrame, classes: DataFrame, labels: DataFrame, space: Workspace) -> DataFrame:
    """set_key, n_links: how many other texts (distinct doc_id and set) each class of equal sets is linked with.

    Links lie within components, so each component's classes, in order of size, are cut into pieces of
    bounded size, and each pair of pieces whose sizes may be alike is counted by itself: no pair of
    classes is emitted, and the lists that found the component don't matter. `texts` has the packed texts of
    all classes that any list paired; the others have no links but copies.
    """
    rows = table.where(F.col("n") > 0).select("set_key", "node").distinct().groupBy("set_key").agg(F.count("*").alias("docs"))
    own = classes.select("set_key", "cls", "n").join(labels.withColumnRenamed("node", "cls"), "cls", "left").join(rows, "set_key")
    own = space.stash(own.select("set_key", "cls", "n", "docs", F.coalesce("component", "cls").alias("component")), "sized")
    several = own.groupBy("component").agg(F.count("*").alias("classes")).where("classes > 1").select("component")
    before = Window.partitionBy("component").orderBy("n", "set_key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cut = own.join(several, "component", "left_semi")
    cut = space.stash(cut.withColumn("piece", F.floor(F.sum(F.col("n") + _PIECE_ROW).over(before) / _PIECE)), "pieces")
    pieces = cut.groupBy("component", "piece").agg(F.min("n").alias("least"), F.max("n").alias("most"))
    right = pieces.select("component", F.col("piece").alias("other"), F.col("least").alias("o_least"))
    blocks = pieces.join(right, "component").where((F.col("piece") <= F.col("other")) & (100 * F.col("most") >= how.percent * F.col("o_least")))
    blocks = space.stash(blocks.select("component", "piece", "other"), "blocks")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [h for _, h in _sets(batch.column(0), how)]
            yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_128_digest(h.tobytes()) for h in found], pa.binary()), pa.array([h.tobytes() for h in found], pa.binary())], names=["set_key", "members"])

    wanted = cut.select(F.col("cls").alias("_id")).distinct()
    own_texts = unpacked(texts.join(wanted, "_id", "left_semi").select("_text"), "_text")
    members = own_texts.mapInArrow(lean(sets), "set_key binary, members binary").groupBy("set_key").agg(F.first("members").alias("members"))
    members = space.stash(cut.select("set_key", "docs", "component", "piece").join(members, "set_key"), "members")
    sides = [members.join(blocks, ["component", "piece"]).select("component", "piece", "other", F.lit(0).alias("side"), "set_key", "members", "docs")]
    later = blocks.where(F.col("piece") < F.col("other")).withColumnRenamed("piece", "first").withColumnRenamed("other", "piece")
    sides.append(members.join(later, ["component", "piece"]).select("component", F.col("first").alias("piece"), F.col("piece").alias("other"), F.lit(1).alias("side"), "set_key", "members", "docs"))
    block = F.concat_ws(" ", "component", "piece", "other").alias("block")
    dealt = sides[0].unionByName(sides[1]).select(block, "side", "set_key", "members", "docs").repartition("block").sortWithinPartitions("block", "side")
    found = dealt.mapInArrow(lean(_degrees(how)), "set_key binary, links long").groupBy("set_key").agg(F.sum("links").alias("links"))
    copies = own.select("set_key", (F.col("docs") - 1).alias("copies"))
    return copies.join(found, "set_key", "left").select("set_key", (F.col("copies") + F.coalesce("links", F.lit(0))).alias("n_links"))


def join(docs: DataFrame, how: Likeness = Likeness(), count_links: bool = True) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links of every row: its set's size, its component's smallest
    doc_id, and how many other texts (distinct doc_id and set) it is linked with; null without `count_links`."""
    spark = docs.sparkSession
    small_batches(spark)
    space = Workspace()
    table = space.stash(_prefixes(docs, how, shingle_sketch(docs, how)), "prefixes")
    classes = table.where(F.col("n") > 0).groupBy("set_key", "group_key", "n").agg(F.min("node").alias("cls"))
    classes = space.stash(classes, "classes")
    groups = classes.groupBy("group_key").agg(F.min("cls").alias("gid"), F.count("*").alias("size"))
    members = space.stash(classes.join(groups, "group_key").select("cls", "gid", "n", "size"), "members")

    # lists of groups by prefix shingle
    heads = members.where(F.col("cls") == F.col("gid")).select(F.col("gid").alias("node"), "n")
    tokens = table.where(F.col("n") > 0).select("node", "prefix").join(heads, "node")
    tokens = tokens.select(F.posexplode("prefix").alias("place", "tok"), F.col("node").alias("gid"), "n")
    tokens = tokens.select("tok", "gid", "n", F.col("place").cast("long").alias("place"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "65536")
    dealt = tokens.repartition("tok").sortWithinPartitions("tok", "n", "gid")
    found = space.stash(dealt.mapInArrow(lean(_list_pairs(how)), "a long, b long, list long, place long").distinct(), "lists")
    small_batches(spark, 512)
    pairs = found.where(F.col("list").isNull()).select("a", "b")

    # expand groups to members
    of = lambda side: members.select(F.col("gid").alias(side), F.col("cls").alias(f"{side}_cls"), F.col("n").alias(f"{side}_n"), F.col("size").alias(f"{side}_size"))
    sizes = members.where(F.col("cls") == F.col("gid"))
    head = lambda side: sizes.select(F.col("gid").alias(side), F.col("size").alias(f"{side}_size"))
    sized = pairs.join(head("a"), "a").join(head("b"), "b")
    whole = F.col("a_size") * F.col("b_size") <= SHORT
    few = sized.where(whole).select("a", "b").join(of("a"), "a").join(of("b"), "b").select(F.col("a_cls").alias("a"), F.col("b_cls").alias("b"))
    many = sized.where(~whole).select("a", "b")
    stars = many.join(of("a"), "a").select(F.col("a_cls").alias("a"), "b").unionByName(many.join(of("b"), "b").select("a", F.col("b_cls").alias("b")))
    inner = members.where((F.col("size") > 1) & (F.col("size") <= SMALL_GROUP)).select("gid", "cls")
    inside = inner.select("gid", F.col("cls").alias("a")).join(inner.select("gid", F.col("cls").alias("b")), "gid").where(F.col("a") < F.col("b")).select("a", "b")
    star = members.where((F.col("size") > SMALL_GROUP) & (F.col("cls") != F.col("gid"))).select(F.col("gid").alias("a"), F.col("cls").alias("b"))
    first = few.unionByName(stars).unionByName(inside).unionByName(star).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where(F.col("a") != F.col("b")).distinct()
    first = space.stash(_plausible(first, table, how), "pairs")

    # what is still open: lists, group pairs and groups that were not looked at pair by pair
    open_lists = found.where(F.col("list").isNotNull()).select("list", F.col("a").alias("gid"), "place")
    whole_set = F.lit(0).cast("long").alias("place")
    key = F.xxhash64(F.lit("pair"), "a", "b").alias("list")
    open_lists = open_lists.unionByName(many.select(key, F.col("a").alias("gid"), whole_set)).unionByName(many.select(key, F.col("b").alias("gid"), whole_set))
    open_lists = open_lists.unionByName(sizes.where(F.col("size") > SMALL_GROUP).select(F.xxhash64(F.lit("group"), "gid").alias("list"), "gid", whole_set))
    open_rows = open_lists.join(members.select("gid", "cls", "n"), "gid").select("list", "cls", "n", (F.col("n") - F.col("place")).alias("room"))
    # entries too late in their prefix for any partner of the list
    least = open_rows.groupBy("list").agg(F.min("n").alias("least"))
    fits = lambda room, n, m: room * (100 + how.percent) >= how.percent * (n + m)
    open_rows = open_rows.join(least, "list").where(fits(F.col("room"), F.col("n"), F.col("least"))).drop("least")
    open_rows = space.stash(open_rows.distinct(), "open")

    wanted = first.select(F.col("a").alias("_id")).unionByName(first.select(F.col("b").alias("_id"))).unionByName(open_rows.select(F.col("cls").alias("_id"))).distinct()
    wanted = space.stash(wanted, "wanted")
    texts = packed(docs.select(_node().alias("_id"), document_text().alias("_text")), "_text").join(wanted, "_id", "left_semi")
    texts = space.stash(texts, "texts")
    links = space.stash(_verified(first, texts, how), "links")
    one = _one_document(table, classes, space)
    labels = space.stash(components(links.unionByName(one), space), "labels")

    rest = open_rows.join(labels.withColumnRenamed("node", "cls"), "cls", "left")
    rest = space.stash(rest.select("list", "cls", "n", "room", F.coalesce("component", "cls").alias("component")), "open")
    mixed = rest.groupBy("list").agg(F.min("component").alias("low"), F.max("component").alias("high")).where(F.col("low") != F.col("high")).select("list")
    rest = space.stash(rest.join(mixed, "list", "left_semi"), "open")
    if not rest.isEmpty():
        # alike sets lie in one band of size or in the next one
        band = F.floor(F.log("n") / (1.000001 * max(0.01, math.log(100 / how.percent))))
        x = rest.select("list", band.alias("band"), F.col("cls").alias("x"), F.col("n").alias("x_n"), F.col("room").alias("x_room"), F.col("component").alias("x_of"))
        y = x.select("list", F.explode(F.array("band", F.col("band") - 1)).alias("band"), F.col("band").alias("y_band"), F.col("x").alias("y"), F.col("x_n").alias("y_n"), F.col("x_room").alias("y_room"), F.col("x_of").alias("y_of"))
        near = fits(F.least("x_room", "y_room"), F.col("x_n"), F.col("y_n"))
        once = (F.col("x") < F.col("y")) | (F.col("y_band") > F.col("band"))
        across = x.join(y, ["list", "band"]).where(once & (F.col("x_of") != F.col("y_of")) & near)
        across = across.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        across = _plausible(across.join(first, ["a", "b"], "left_anti"), table, how)
        links = space.stash(links.unionByName(_verified(across, texts, how)), "links")
        labels = space.stash(components(links.unionByName(one), space), "labels")

    named = classes.select("set_key", "cls").join(labels.withColumnRenamed("node", "cls"), "cls", "left")
    named = named.select("set_key", F.coalesce("component", "cls").alias("component"))
    if count_links:
        small_batches(spark, 128)
        named = named.join(_link_counts(texts, how, table, classes, labels, space), "set_key")
    else:
        named = named.withColumn("n_links", F.lit(None).cast("long"))
    out = table.select("doc_id", "node", "n", "set_key").join(named, "set_key", "left")
    own = F.coalesce(F.col("component"), F.col("node"))
    result = stash(out.select("doc_id", F.col("n").alias("n_shingles"), F.when(own < _NULL_ID, own).alias("component_id"), (F.coalesce("n_links", F.lit(0)) if count_links else F.col("n_links")).alias("n_links")), "result")
    space.clear()
    return result


def keep_one(docs: DataFrame, how: Likeness = Likeness()) -> DataFrame:
    """The rows of `docs` without near copies: of each component the one with the smallest doc_id, of
    rows with equal doc_id and text one; else null doc_id stay."""
    linked = join(docs.select("doc_id", "text"), how, count_links=False)
    gone = linked.where(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct()
    small_batches(docs.sparkSession, 256)
    kept = unpacked(packed(docs, "text").join(gone, "doc_id", "left_anti").select(*docs.columns), "text")
    if linked.groupBy("doc_id").agg(F.count("*").alias("rows")).where(F.col("rows") > 1).isEmpty():
        return kept
    return kept.dropDuplicates(["doc_id", "text"])
