"""Document fingerprints: SimHash, and a search within a Hamming radius by permuted block tables.

Terms are three-word shingles (texts of few words also give their byte
five-grams); each occurrence votes with its weight, +w or -w, on each of the bits of the
term's hash, and the sign of a bit's sum is the fingerprint's bit. Equal texts have equal
fingerprints. Terms of single words give a second fingerprint for the search: in a text in which one word of
fifty is changed, a tenth of the five-word shingles differ but few of the bits of that one. A radius of 7 bits finds
0.89 of the 270 pairs of five-word similarity 0.8 or more in 10000 test documents (3 bits: 0.33; with
three-word shingles and 3 bits: below 0.01).

The search cuts fingerprints into `radius + extra` blocks. Two that differ in at
most `radius` bits agree in at least `extra` blocks, so each choice of `extra`
blocks is one table, keyed by those blocks' bits moved to the front; equal keys are
candidates, and the bits that differ are counted. Equal fingerprints are collapsed
first, so copies never meet.

Defined results: null text is empty; an empty text has the fingerprint of all
zero bits; repeated doc_id are neighbours of each other in the order of their texts'
MD5 digests; null doc_id come first in the order; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import document_text, mix, shingle_hashes, small_batches, stash, text_slices, word_hashes

BITS = 128
#: Words of a term in the fingerprints that are compared for likeness.
SHINGLE = 3
#: The bits in which fingerprints of single words may differ, and the blocks beyond these that a table's key has.
RADIUS, EXTRA = 7, 2
#: Texts with fewer words also vote with their byte five-grams.
FEW_WORDS = 24
_SALTS = np.array([0, 0xA0761D6478BD642F], dtype=np.uint64)


def _byte_grams(raw: np.ndarray) -> np.ndarray:
    padded = np.zeros(len(raw) + 8, np.uint8)
    padded[: len(raw)] = raw
    loads = np.ndarray(len(raw), "<u8", padded.data, strides=(1,))
    grams = loads[: max(1, len(raw) - 4)] & np.uint64((1 << 40) - 1)
    return mix(grams * np.uint64(0x9E3779B97F4A7C15) + np.uint64(5))


def _sign(terms: np.ndarray, weights: np.ndarray | None) -> np.ndarray:
    """The fingerprint of one text as BITS // 8 bytes."""
    if not len(terms):
        return np.zeros(BITS // 8, np.uint8)
    votes = np.zeros(BITS, np.float64)
    for a in range(0, len(terms), 4096):
        wide = mix(terms[a : a + 4096, None] ^ _SALTS[None, :])
        bits = np.unpackbits(wide.view(np.uint8).reshape(len(wide), BITS // 8), axis=1).astype(np.float32)
        w = np.ones(len(wide), np.float32) if weights is None else weights[a : a + 4096]
        votes += w @ bits * 2.0 - float(w.sum())
    return np.packbits(votes > 0)


def simhash(column: pa.Array, size: int = SHINGLE) -> np.ndarray:
    """Fingerprints of texts, one row of bytes each."""
    out = np.zeros((len(column), BITS // 8), np.uint8)
    for row, end, data, offsets in text_slices(column):
        words, first = word_hashes(data, offsets)
        for k, terms in enumerate(shingle_hashes(words, first, size)):
            weights = None
            if first[k + 1] - first[k] < FEW_WORDS and offsets[k + 1] > offsets[k]:
                grams = _byte_grams(data[offsets[k] : offsets[k + 1]])
                weights = np.concatenate([np.full(len(terms), 2.0), np.ones(len(grams))]).astype(np.float32)
                terms = np.concatenate([terms, grams])
            out[row + k] = _sign(terms, weights)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal bits."""
    return 1 - np.unpackbits(a ^ b, axis=1).sum(axis=1) / BITS


def fingerprint(docs: DataFrame) -> DataFrame:
    """doc_id and `fingerprint` (hexadecimal) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [x.tobytes().hex() for x in simhash(batch.column(1).fill_null(""))]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(fps, pa.string())], names=["doc_id", "fingerprint"])

    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fingerprint string")


def within_radius(fingerprints: DataFrame, radius: int = 3, extra: int = 2, queries: DataFrame | None = None) -> DataFrame:
    """Pairs of different fingerprints (left < right) within the radius, with their `distance`; or, with
    `queries`, pairs of one of theirs (left) and any other (right).

    Column `fingerprint` is hexadecimal of any even length; join its members for documents. A pair
    comes from the first table in which it agrees only, so large groups of near copies give each pair once. Keys are
    dealt over tasks at any size of either side.
    """
    blocks = radius + extra
    edges = [BITS * k // blocks for k in range(blocks + 1)]
    bits = F.concat(*(F.lpad(F.conv(F.substring("fingerprint", i, 1), 16, 2), 4, "0") for i in range(1, BITS // 4 + 1)))
    block = [F.substring("_bits", edges[k] + 1, edges[k + 1] - edges[k]) for k in range(blocks)]
    choices = list(combinations(range(blocks), extra))
    tables = [F.struct(F.lit(n).alias("n"), F.xxhash64(F.lit(n), *(block[k] for k in chosen)).alias("key")) for n, chosen in enumerate(choices)]

    def keyed(table: DataFrame, name: str) -> DataFrame:
        distinct = table.select("fingerprint").where(F.col("fingerprint").isNotNull()).distinct()
        rows = distinct.withColumn("_bits", bits).select("fingerprint", F.explode(F.array(*tables)).alias("_t"))
        return rows.select(F.col("_t.n").alias("_n"), F.col("_t.key").alias("_key"), F.col("fingerprint").alias(name))

    part = lambda side, i: F.conv(F.substring(side, i, 8), 16, 10).cast("long")
    differ = [part("left", i).bitwiseXOR(part("right", i)) for i in range(1, BITS // 4 + 1, 8)]
    pairs = keyed(fingerprints if queries is None else queries, "left").join(keyed(fingerprints, "right").hint("merge"), ["_n", "_key"])
    pairs = pairs.where(F.col("left") < F.col("right") if queries is None else F.col("left") != F.col("right"))
    pairs = pairs.select("_n", "left", "right", *(x.alias(f"_x{k}") for k, x in enumerate(differ)))
    distance = sum((F.bit_count(f"_x{k}") for k in range(len(differ))), F.lit(0))

    def agrees(k: int) -> F.Column:
        """Whether block k, a range of bits over words of 32, has no difference."""
        out = F.lit(True)
        for w in range(edges[k] // 32, (edges[k + 1] - 1) // 32 + 1):
            a, b = max(edges[k], 32 * w) - 32 * w, min(edges[k + 1], 32 * w + 32) - 32 * w
            out = out & (F.col(f"_x{w}").bitwiseAND(F.lit(((1 << (b - a)) - 1) << (32 - b))) == 0)
        return out

    equal = F.filter(F.array(*(F.when(agrees(k), F.lit(k)) for k in range(blocks))), lambda x: x.isNotNull())
    here = F.element_at(F.array(*(F.array(*(F.lit(k) for k in chosen)) for chosen in choices)), F.col("_n") + 1)
    return pairs.withColumn("distance", distance).where((F.col("distance") <= radius) & (F.slice(equal, 1, extra) == here)).select("left", "right", "distance")


_ROWS = "part int, borrowed boolean, doc_id long, packed binary, digest binary, own binary, words binary"
_OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, word_fingerprint string"


class Ranges:
    """Consecutive ranges of rows in the order of doc_id (null first), then digest.

    An id that many quantiles name has as many ranges, by its rows' digests; so have null ids by their share.
    """

    def __init__(self, quantiles: list[int], nulls: int):
        named = Counter(quantiles)
        self.ids = np.array(sorted(named), np.int64)
        self.widths = np.array([named[x] for x in self.ids.tolist()], np.int64)
        self.first = nulls + np.concatenate([[0], np.cumsum(self.widths)])  # ranges before each id's own
        self.nulls = nulls

    def of(self, ids: pa.Array, digests: list[bytes]) -> np.ndarray:
        null = ids.is_null().to_numpy(zero_copy_only=False)
        values = ids.cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False)
        high = np.array([int.from_bytes(d[:4], "big") for d in digests], np.int64)
        at = np.searchsorted(self.ids, values, "left")
        part = self.first[at]
        if len(self.ids):
            inside = np.minimum(at, len(self.ids) - 1)
            own = (at < len(self.ids)) & (self.ids[inside] == values)
            part = part + np.where(own, 1 + (high * self.widths[inside] >> 32), 0)
        return np.where(null, high * self.nulls >> 32, part).astype(np.int32)


def _ranges(docs: DataFrame) -> tuple[Ranges, list[tuple[int, int | None, bytes]]]:
    """Ranges, about two per shuffle partition, and (range, doc_id, digest) of the first row of each that has rows."""
    parts = 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = docs.agg(F.count("*").alias("rows"), F.count("doc_id").alias("named")).first()
    empty = counts["rows"] - counts["named"]
    nulls = -(-parts * empty // counts["rows"]) if empty else 0
    quantiles = docs.where(F.col("doc_id").isNotNull()).approxQuantile("doc_id", [k / parts for k in range(1, parts)], 1 / (4 * parts)) if parts > 1 else []
    ranges = Ranges([int(x) for x in quantiles], nulls)
    digest = F.unhex(F.md5(document_text().cast("binary")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first: dict[int, tuple] = {}
        for batch in batches:
            digests = batch.column(1).to_pylist()
            for part, doc_id, d in zip(ranges.of(batch.column(0), digests).tolist(), batch.column(0).to_pylist(), digests):
                key = (doc_id is not None, doc_id or 0, d)
                if part not in first or key < first[part]:
                    first[part] = key
        yield pa.RecordBatch.from_arrays([pa.array(first, pa.int32()), pa.array([k[1] if k[0] else None for k in first.values()], pa.int64()), pa.array([k[2] for k in first.values()], pa.binary())], names=["part", "doc_id", "digest"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest.alias("digest")).mapInArrow(run, "part int, doc_id long, digest binary")
    lows = rows.groupBy("part").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "digest")).alias("x")).orderBy("part").collect()
    return ranges, [(r["part"], r["x"]["doc_id"], bytes(r["x"]["digest"])) for r in lows]


def likeness_to_edited(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edited text, and how like they and the next document's are.

    The edited text has its last floor(n/2) characters replaced by the first as many of the next
    document in doc_id order (the last document's next is the first). Rows are dealt by ranges
    of doc_id and digest in one shuffle; the first row of a range also goes to the range before it (from each
    task that has a copy). Rows of equal doc_id and text stay in one range.
    """
    small_batches(docs.sparkSession)
    ranges, starts = _ranges(docs)
    before = {part: starts[k - 1][0] for k, (part, *_) in enumerate(starts)}  # the first range's row goes to the last
    lows = {part: low for part, *low in starts}

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compress = zstandard.ZstdCompressor(level=1).compress
        given: set[int] = set()  # ranges whose first row this task has lent
        for batch in batches:
            ids, texts = batch.column(0).cast(pa.int64()), batch.column(1).fill_null("")
            raw = [t.encode() for t in texts.to_pylist()]
            packed = pa.array([compress(t) for t in raw], pa.binary())
            hashes = [hashlib.md5(t).digest() for t in raw]
            digests = pa.array(hashes, pa.binary())
            own, words = (pa.array([x.tobytes() for x in simhash(texts, size)], pa.binary()) for size in (SHINGLE, 1))
            part = ranges.of(ids, hashes)
            lent = np.array([k for k, (p, v, d) in enumerate(zip(part.tolist(), ids.to_pylist(), hashes)) if lows[p] == [v, d] and not (p in given or given.add(p))], np.int64)
            rows = np.concatenate([np.arange(len(batch)), lent])
            to = np.concatenate([part, np.array([before[p] for p in part[lent].tolist()], np.int32)])
            take = pa.array(rows)
            yield pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), pa.array(np.arange(len(rows)) >= len(batch)), ids.take(take), packed.take(take), digests.take(take), own.take(take), words.take(take)], names=[x.split()[0] for x in _ROWS.split(", ")])

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        """(row, next row) of rows that aren't borrowed; a range's only borrowed rows are its last."""
        held, plain = None, zstandard.ZstdDecompressor()
        for batch in batches:
            for part, borrowed, doc_id, packed, _, own, words in zip(*(c.to_pylist() for c in batch.columns)):
                row = (part, borrowed, doc_id, plain.decompress(packed).decode(), own, words)
                if held is not None:
                    assert held[0] == row[0], "a range without its next row"
                    yield held, row
                held = None if row[1] else row
        assert held is None, "a range without its next row"

    def edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(rows: list[tuple]) -> pa.RecordBatch:
            texts = []
            for row, after in rows:
                half = len(row[3]) // 2
                texts.append(row[3][: len(row[3]) - half] + after[3][:half])
            mine, theirs = (np.frombuffer(b"".join(r[k][4] for r in rows), np.uint8).reshape(len(rows), -1) for k in (0, 1))
            fps = simhash(pa.array(texts, pa.large_string()))
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([r[0][2] for r in rows], pa.int64()),
                    pa.array([len(r[0][3]) for r in rows], pa.int64()),
                    pa.array([hashlib.sha256(t.encode()).hexdigest() for t in texts], pa.string()),
                    pa.array([x.tobytes().hex() for x in mine], pa.string()),
                    pa.array([x.tobytes().hex() for x in fps], pa.string()),
                    pa.array(likeness(mine, fps)),
                    pa.array(likeness(mine, theirs)),
                    pa.array([r[0][5].hex() for r in rows], pa.string()),
                ],
                names=[x.split()[0] for x in _OUT.split(", ")],
            )

        rows, size = [], 0
        for pair in pairs(batches):
            rows.append(pair)
            size += len(pair[0][3])
            if len(rows) >= 512 or size > 1 << 21:
                yield flush(rows)
                rows, size = [], 0
        if rows:
            yield flush(rows)

    dealt = docs.select("doc_id", "text").mapInArrow(deal, _ROWS)
    ordered = dealt.repartition(max(1, len(starts)), "part").sortWithinPartitions("part", "borrowed", F.asc_nulls_first("doc_id"), "digest")
    return ordered.mapInArrow(edited, _OUT)


def count_near(rows: DataFrame, radius: int = RADIUS, extra: int = EXTRA, column: str = "word_fingerprint", every: int = 100) -> DataFrame:
    """Add `near_fingerprints`: for rows whose doc_id is divisible by `every`, how many other fingerprints of the
    whole table are within the radius of their own; null for other rows.

    Copies share a fingerprint and don't count. `rows` is read several times: give a stored table.
    """
    asked = F.col("doc_id") % every == 0
    named = rows.select("doc_id", F.col(column).alias("fingerprint"))
    pairs = within_radius(named, radius, extra, named.where(asked))
    counts = pairs.groupBy(F.col("left").alias("_fp")).agg(F.count("*").alias("near_fingerprints"))
    out = rows.join(counts, asked & (F.col(column) == F.col("_fp")), "left").drop("_fp")
    return out.withColumn("near_fingerprints", F.when(asked, F.coalesce("near_fingerprints", F.lit(0))).cast("long"))


def report(docs: DataFrame, radius: int = RADIUS, every: int = 100) -> DataFrame:
    """`likeness_to_edited` with the number of near fingerprints of the texts asked for."""
    return count_near(stash(likeness_to_edited(docs), "fingerprints"), radius, every=every)
