"""Token counts: overlap resynchronisation for huge documents.

A text of up to `chunk_chars` characters is encoded at once. A longer one is
encoded in chunks that overlap; two neighbours are spliced at a proven stable
boundary inside the overlap: a character position next to white space where a
token starts in both encodings, and from which both encodings agree to the end
of the left chunk's settled part. The vocabularies' patterns always cut there, so
what stands left of such a position cannot change what is right of it. If an overlap has no such position (one endless word), it
is widened to double its size and encoded again, up to the whole chunk, which is then
doubled itself. Memory is that of one chunk in the usual case, and of the word where one word is longer.

Texts of up to `chunk_chars` characters use the same kind of boundary: where a
vocabulary's word pattern is the known `WORD_PATTERN`, which drops white space, the tokens of a
text are those of its words between blanks and line breaks, and each different word is
encoded once per worker (a memo of at most `MEMO_WORDS` words). Other vocabularies
encode such texts whole.

Defined results: null or empty text has 0 bytes and 0 tokens; one row per row of
the input, repeated or null doc_id included; extra columns are ignored.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import small_batches
from .tokenizing import encode_spans, tokenizer

#: A word pattern without white space and without a look beyond a word's ends (fixed value, as published with its vocabulary).
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_GAP = re.compile(r"\s+")
#: Words whose counts a worker remembers.
MEMO_WORDS = 1_000_000
_SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def _stable(text: str, at: int) -> bool:
    """Whether the patterns cut here whatever stands before: after white space, or at the one space before a word."""
    if text[at - 1].isspace():
        return not text[at].isspace()
    return text[at] == " " and not text[at + 1 : at + 2].isspace()


def _splice(text: str, base: int, left: tuple, right: tuple, right_base: int) -> tuple[int, int] | None:
    """(tokens of the left chunk before the seam, of the right chunk before it), or None.

    `base` and `right_base` are the chunks' first characters. The last word that
    starts in the left chunk may be cut at the chunk's end, so the seam lies before it and the
    encodings must agree from the seam up to there.
    """
    ids_l, spans_l = left
    ids_r, spans_r = right
    starts_l, starts_r = [s + base for s, _ in spans_l], [s + right_base for s, _ in spans_r]
    end = base + (spans_l[-1][1] if spans_l else 0)
    at_r = {s: k for k, s in reversed(list(enumerate(starts_r[: bisect_left(starts_r, end)])))}
    # words of the overlap: positions where white space ends
    seams = [k for k in range(bisect_left(starts_l, right_base + 1), len(starts_l)) if _stable(text, starts_l[k])]
    if len(seams) < 2:
        return None
    settled = seams[-1]  # tokens from here on may change with what follows
    for k in reversed(seams[:-1]):
        j = at_r.get(starts_l[k])
        run = settled - k
        if j is not None and ids_l[k:settled] == ids_r[j : j + run] and starts_l[k:settled] == starts_r[j : j + run]:
            return k, j
    return None


def _has_seams(text: str, start: int, end: int) -> bool:
    """Whether two words end between the positions, as a splice needs at least."""
    found = _GAP.search(text, start + 1, end)
    return found is not None and _GAP.search(text, found.end(), end) is not None


def count_long(text: str, path: str, chunk_chars: int, overlap_chars: int) -> int:
    """Tokens of one text, by overlapping chunks; a chunk without a seam is doubled, so that its whole cost stays in proportion."""
    total, base, overlap = 0, 0, overlap_chars
    skip = 0  # tokens of the current chunk that the chunk before it has given
    end, left = min(len(text), chunk_chars), None
    while end < len(text):
        start = max(base + 1, end - overlap)
        seam = None
        if _has_seams(text, start, end):
            stop = min(len(text), end + max(chunk_chars, end - start))
            left = left or encode_spans([text[base:end]], path)[0]
            right = encode_spans([text[start:stop]], path)[0]
            seam = _splice(text, base, left, right, start)
        if seam is not None:
            total += seam[0] - skip
            base, end, left, skip, overlap = start, stop, right, seam[1], overlap_chars
        elif start > base + 1:
            overlap *= 2  # widen to the left
        else:  # the overlap is the whole chunk: grow the chunk to the right instead
            end, left = min(len(text), base + 2 * (end - base)), None
    left = left or encode_spans([text[base:end]], path)[0]
    return total + len(left[0]) - skip


@lru_cache(maxsize=8)
def words_stand_alone(path: str) -> bool:
    """Whether blanks cut a text into parts that are encoded independently: only for a pattern that is known to do so."""
    if not path.endswith(".json"):
        return False
    with open(path, encoding="utf-8") as f:
        found = json.load(f)
    steps = found.get("pre_tokenizer") or {}
    first = (steps.get("pretokenizers") or [steps])[0]
    outer = found.get("normalizer") or {}
    own = [x.get("type") for x in outer.get("normalizers", [outer])]
    plain = all(x in (None, "NFC", "Lowercase", "Replace") for x in own)
    return plain and first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert") is True and (first.get("pattern") or {}).get("Regex") == WORD_PATTERN


def _counter(path: str) -> Callable[[list[str]], list[int]]:
    """Counts of texts that are encoded at once."""
    tok = tokenizer(path)
    if path.endswith(".model"):
        return lambda texts: [len(x) for x in tok.encode(texts, num_threads=1)]
    whole = lambda texts: [len(e) for e in tok.encode_batch(texts, add_special_tokens=False)]
    if not words_stand_alone(path):
        return whole
    memo: dict[str, int] = {"": 0}

    def by_words(texts: list[str]) -> list[int]:
        parts = [t.replace("\n", " ").split(" ") for t in texts]
        new = list({w for p in parts for w in p} - memo.keys())
        if len(memo) + len(new) > MEMO_WORDS:
            memo.clear()
            memo[""] = 0
            new = list({w for p in parts for w in p} - {""})
        for at in range(0, len(new), 2048):
            some = new[at : at + 2048]
            starts = np.cumsum([0, *(len(w) + 1 for w in some[:-1])])
            offsets = tok.encode(" ".join(some), add_special_tokens=False).offsets
            of = np.searchsorted(starts, np.fromiter((a for a, _ in offsets), np.int64, len(offsets)), "right") - 1
            memo.update(zip(some, np.bincount(of, minlength=len(some)).tolist()))
        get = memo.__getitem__
        return [sum(map(get, p)) for p in parts]

    return by_words


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 2048, chunk_chars: int = 1 << 15, overlap_chars: int = 512) -> DataFrame:
    """Bytes and tokens of each text, and whether it has more than `limit` tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        short = _counter(tokenizer_path)
        for batch in batches:
            for at in range(0, len(batch), 64):
                part = batch.slice(at, 64)
                texts = part.column(1).fill_null("").to_pylist()
                few = [k for k, t in enumerate(texts) if len(t) <= chunk_chars]
                n = dict(zip(few, short([texts[k] for k in few])))
                counts = [n[k] if k in n else count_long(t, tokenizer_path, chunk_chars, overlap_chars) for k, t in enumerate(texts)]
                sizes = [len(t.encode()) for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()), pa.array([c > limit for c in counts])],
                    names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
                )

    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, _SCHEMA)
