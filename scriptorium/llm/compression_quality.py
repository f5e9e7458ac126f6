"""Quality classifier: compressed size against a good and a bad dictionary.

Two zstandard dictionaries are built from texts labelled good and bad. A text is
compressed in pieces of `piece_bytes` bytes, each once with either dictionary;
(bytes with the bad one - bytes with the good one) / bytes of the text is its
normalised compressed-size difference. A logistic curve, fitted on labelled texts
that no dictionary has seen, makes it a probability of being good.

Training uses a bounded sample (`sample_rows` labelled rows at most, the smallest
by a hash of doc_id, and at most `sample_bytes` of their text; sizes are compared before any
text moves, a row that no longer fits is passed over, and copies of a row count once): the
dictionaries and the curve have a fixed size, so the broadcast is bounded. Every
text is then scored whole, in one pass without a shuffle.

Defined results: null text is empty and gets the curve's value at difference 0;
rows are scored one by one, so null and repeated doc_id stay; without labels of
both classes the score is the share of good labels (0.5 if there are none); extra
columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import document_text, small_batches

_SCORED = "doc_id long, score double, predicted int"


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    slope: float
    intercept: float
    piece_bytes: int = 512
    level: int = 3

    def scorer(self):
        """A function from a text to its score; make one per process."""
        if not self.good or not self.bad:
            return lambda text: _sigmoid(self.intercept)
        sizes = _sizes(self.good, self.bad, self.level, self.piece_bytes)
        return lambda text: _sigmoid(self.slope * sizes(text) + self.intercept)


def _sigmoid(x: float) -> float:
    return 1 / (1 + math.exp(-max(-500.0, min(500.0, x))))


def _sizes(good: bytes, bad: bytes, level: int, piece: int):
    import zstandard

    def compressor(raw: bytes):
        d = zstandard.ZstdCompressionDict(raw)
        d.precompute_compress(level=level)
        return zstandard.ZstdCompressor(level=level, dict_data=d, write_content_size=False, write_dict_id=False, write_checksum=False).compress

    with_good, with_bad = compressor(good), compressor(bad)

    def difference(text: str) -> float:
        raw = (text or "").encode()
        total = 0
        for i in range(0, len(raw), piece):
            part = raw[i : i + piece]
            total += len(with_bad(part)) - len(with_good(part))
        return total / max(1, len(raw))

    return difference


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept by Newton steps with a small ridge on the scaled input."""
    scale = float(x.std()) or 1.0
    a = np.stack([x / scale, np.ones(len(x))], axis=1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = (a * (p * (1 - p))[:, None]).T @ a + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, a.T @ (y - p) - 1e-3 * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0] / scale), float(w[1])


def _dictionary(texts: list[bytes], size: int) -> bytes:
    """A trained dictionary; plain content where there is too little to train on."""
    import zstandard

    try:
        return zstandard.train_dictionary(size, texts).as_bytes()
    except zstandard.ZstdError:
        return b"\n".join(texts)[:size]


def train(texts: list[str], good: list[bool], dictionary_bytes: int = 112640, piece_bytes: int = 512, level: int = 3) -> Model:
    """Two thirds of the rows give the dictionaries, the rest the curve."""
    if len(set(good)) < 2:
        share = (sum(good) + 1) / (len(good) + 2)
        return Model(b"", b"", 0.0, math.log(share / (1 - share)), piece_bytes, level)
    raw = [(t or "").encode() for t in texts]
    by_class = {c: [k for k, g in enumerate(good) if g == c] for c in (True, False)}
    fit = {c: ks if len(ks) < 3 else ks[: 2 * len(ks) // 3] for c, ks in by_class.items()}
    rest = [k for c, ks in by_class.items() for k in (ks if len(ks) < 3 else ks[2 * len(ks) // 3 :])]
    a, b = (_dictionary([raw[k] for k in fit[c]], dictionary_bytes) for c in (True, False))
    if not a or not b:
        return train([], [], dictionary_bytes, piece_bytes, level)
    difference = _sizes(a, b, level, piece_bytes)
    x = np.array([difference(texts[k]) for k in rest])
    slope, intercept = _logistic(x, np.array([float(good[k]) for k in rest]))
    return Model(a, b, slope, intercept, piece_bytes, level)


def train_from(docs: DataFrame, labels: DataFrame, sample_rows: int = 6000, sample_bytes: int = 32 << 20, **how) -> Model:
    """A model from at most `sample_rows` labelled rows, as many of either class as there are up to half of it."""
    marked = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).select("doc_id", (F.col("quality") == 1).alias("_good"))
    half = [marked.where(F.col("_good") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows // 2) for c in (True, False)]
    own = docs.select("doc_id", "text").withColumn("_row", F.xxhash64("doc_id", "text")).withColumn("_size", F.octet_length(document_text()))
    order = (F.xxhash64("doc_id"), "doc_id", "_good", "_row")
    # sizes first: texts move only for rows that fit
    sizes = own.join(F.broadcast(half[0].unionByName(half[1])), "doc_id").where(F.col("_size") <= sample_bytes)
    chosen, used = set(), 0
    for r in sizes.select("doc_id", "_good", "_row", "_size").distinct().orderBy(*order).limit(sample_rows).collect():
        if used + r["_size"] <= sample_bytes:
            used += r["_size"]
            chosen.add((r["doc_id"], r["_row"], r["_good"]))
    kept = docs.sparkSession.createDataFrame(sorted(chosen), "doc_id long, _row long, _good boolean")
    some = own.join(F.broadcast(kept), ["doc_id", "_row"]).dropDuplicates(["doc_id", "_row", "_good"])
    rows = [(r["text"] or "", r["_good"]) for r in some.orderBy(*order).select("text", "_good").collect()]
    # the sample is balanced by class; the curve gets the labels' own shares back
    model = train([t for t, _ in rows], [g for _, g in rows], **how)
    counts = {r["_good"]: r["count"] for r in marked.groupBy("_good").count().collect()}
    in_sample = {c: sum(g == c for _, g in rows) for c in (True, False)}
    if all(counts.get(c) and in_sample[c] for c in (True, False)):
        shift = math.log(counts[True] / counts[False]) - math.log(in_sample[True] / in_sample[False])
        model = Model(model.good, model.bad, model.slope, model.intercept + shift, model.piece_bytes, model.level)
    return model


def score(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """Score of every row; `predicted` is 1 from `threshold` on."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = shared.value.scorer()
        for batch in batches:
            scores = np.array([of(t) for t in batch.column(1).fill_null("").to_pylist()], float)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(scores), pa.array((scores >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, _SCORED)


def held_out(column: str = "doc_id") -> F.Column:
    """Rows that training never sees: crc32 of the id as text is a multiple of 5."""
    return F.crc32(F.col(column).cast("string")) % 5 == 0


def fold(doc_id: object) -> int:
    return zlib.crc32(str(doc_id).encode()) % 5
