"""Title matching and near-duplicate texts.

Candidates come from shared tokens or grams, never from a cross join; Arrow UDFs
compute the two sequence measures that have no native form.
"""

from __future__ import annotations

import functools
import math
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import rules
from ..functions import arrow_udf, once
from ..functions import text as T


#: In the search for near duplicates: reach of an anchor to both sides, and characters of the gram that starts at it.
REACH, ANCHORED = 4, 11
#: Characters of a gram for texts with few anchors.
GRAM = 8


def _common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, with one big integer per row of bits."""
    if len(a) < len(b):
        a, b = b, a
    where: dict[str, int] = {}
    for i, c in enumerate(b):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(b)) - 1
    row = full
    for c in a:
        hit = row & where.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(b) - row.bit_count()


@arrow_udf("double")
def indel_ratio(left: pd.Series, right: pd.Series) -> pd.Series:
    """2 * common subsequence / both lengths; 1 for two empty strings."""
    return pd.Series([1.0 if not len(a) + len(b) else 2 * _common_subsequence(a, b) / (len(a) + len(b)) for a, b in zip(left.fillna(""), right.fillna(""))])


@arrow_udf("double")
def matcher_ratio(left: pd.Series, right: pd.Series) -> pd.Series:
    """Ratio of matching blocks; depends on the order of its arguments."""
    return pd.Series([SequenceMatcher(None, a, b).ratio() for a, b in zip(left.fillna(""), right.fillna(""))])


@arrow_udf("double")
def matcher_ratio_from(left: pd.Series, right: pd.Series, least: pd.Series) -> pd.Series:
    """The same where it can reach `least`, else 0: two cheap upper bounds come first."""

    def one(a: str, b: str, bound: float) -> float:
        m = SequenceMatcher(None, a, b)
        return m.ratio() if m.real_quick_ratio() >= bound and m.quick_ratio() >= bound else 0.0

    return pd.Series([one(a, b, x) for a, b, x in zip(left.fillna(""), right.fillna(""), least)], dtype="float64")


def title_tokens(value: Column) -> Column:
    return F.array_distinct(F.filter(F.split(T.normalize_title(value), " "), lambda t: t != ""))


def token_jaccard(left: Column, right: Column) -> Column:
    """Jaccard similarity of two token arrays; 0 if either is empty."""
    both, either = F.size(F.array_intersect(left, right)), F.size(F.array_union(left, right))
    return F.when((F.size(left) == 0) | (F.size(right) == 0), F.lit(0.0)).otherwise(both / either)


#: So many of the most frequent tokens are ordered by their counts, all others before them by length.
FREQUENT = 4096


def _rare_tokens(titles: DataFrame, often: DataFrame, tokens: str, least: float) -> DataFrame:
    """Titles, each once (array `tokens`), a row for each of their n - ceil(least * n) + 1 rarest tokens as `token`."""
    n = F.size(tokens)
    rows = titles.withColumn("token", F.explode(tokens)).join(F.broadcast(often), "token", "left")
    place = F.struct(F.coalesce("count", F.lit(0)).alias("count"), (-F.char_length("token")).alias("length"), "token")
    others = [F.first(c).alias(c) for c in titles.columns if c != tokens]
    met = rows.groupBy(tokens).agg(F.sort_array(F.collect_list(place)).alias("_by"), *others)
    return met.withColumn("_by", F.explode(F.slice("_by", F.lit(1), (n - F.ceil(F.lit(least) * n) + 1).cast("int")))).withColumn("token", F.col("_by.token")).drop("_by")


def title_candidates(queries: DataFrame, works: DataFrame, top: int = 5, least: float = 0.0) -> DataFrame:
    """The `top` works of each query (query_id, title against work_id, title) by Jaccard similarity of their title tokens.

    Pairs that share a token are found by an equi-join on it, so no pair is compared that shares none. Ties go to the
    smaller work_id. With `least`, only pairs of that similarity count, and titles of n tokens join
    on n - ceil(least * n) + 1 of them, those in few works' titles first: two titles as similar as that share one of these, and
    common words join nothing. Then titles of the same tokens also count once, with the `top` smallest of their work_ids.
    """
    if least > 0:
        asked = queries.select("query_id", F.array_sort(title_tokens(F.col("title"))).alias("tokens")).where(F.size("tokens") > 0).distinct()
        own = works.select("work_id", F.array_sort(title_tokens(F.col("title"))).alias("others")).where(F.size("others") > 0).distinct()
        some = own.withColumn("_n", F.row_number().over(Window.partitionBy("others").orderBy("work_id"))).where(F.col("_n") <= top)
        some = some.groupBy("others").agg(F.collect_list("work_id").alias("ids"))
        counts = some.select(F.explode("others").alias("token")).groupBy("token").count().where("count > 1")
        often = counts.orderBy(F.desc("count"), "token").limit(FREQUENT)  # of fixed size
        n, m = F.size("tokens"), F.size("others")
        met = _rare_tokens(asked.select("tokens").distinct(), often, "tokens", least).join(_rare_tokens(some, often, "others", least), "token")
        near = met.where((m >= least * n) & (n >= least * m)).withColumn("jaccard", token_jaccard(F.col("tokens"), F.col("others"))).where(F.col("jaccard") >= least)
        first = Window.partitionBy("tokens").orderBy(F.desc("jaccard"), "work_id")
        few = near.select("tokens", "jaccard", F.explode("ids").alias("work_id")).distinct().withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= top)
        return asked.join(few, "tokens").select("query_id", "work_id", "jaccard", "rank")
    left = queries.select("query_id", title_tokens(F.col("title")).alias("tokens")).withColumn("n", F.size("tokens"))
    right = works.select("work_id", title_tokens(F.col("title")).alias("others")).withColumn("m", F.size("others"))
    shared = (
        left.select("query_id", "n", F.explode("tokens").alias("token"))
        .join(right.select("work_id", "m", F.explode("others").alias("token")), "token")
        .groupBy("query_id", "work_id", "n", "m")
        .agg(F.count("*").alias("both"))
    )
    scored = shared.withColumn("jaccard", F.col("both") / (F.col("n") + F.col("m") - F.col("both")))
    best = Window.partitionBy("query_id").orderBy(F.desc("jaccard"), "work_id")
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top).select("query_id", "work_id", "jaccard", "rank")


def score_candidates(pairs: DataFrame) -> DataFrame:
    """Add score and rank to pairs (query_id, query_title, work_id, title, pos): 0.7 Jaccard + 0.3 Indel ratio, six digits."""
    ratio = indel_ratio(T.normalize_title(F.col("query_title")), T.normalize_title(F.col("title")))
    jaccard = token_jaccard(title_tokens(F.col("query_title")), title_tokens(F.col("title")))
    scored = pairs.withColumn("score", F.bround(0.7 * jaccard + 0.3 * ratio, 6))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "pos")
    return scored.withColumn("rank", F.row_number().over(best))


def confident(ranked: DataFrame, score: str = "score") -> DataFrame:
    """The first candidate of each query, and whether it is good and ahead enough of the second."""
    best = Window.partitionBy("query_id").orderBy("rank")
    second = F.coalesce(F.lead(score).over(best), F.lit(0.0))
    out = ranked.withColumn("second", second).where(F.col("rank") == 1)
    return out.withColumn("confident", (F.col(score) >= rules.CONFIDENT_SCORE) & (F.col(score) - F.col("second") >= rules.CONFIDENT_MARGIN))


@functools.cache
def _grams_udf(ratio: float, band: int):
    @F.pandas_udf("array<struct<gram:long,at:long,more:int,letters:long>>")
    def grams(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: _gram_rows(t, ratio, band))

    return grams


def _hashed(codes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all grams of that size."""
    count = max(0, len(codes) - size + 1)
    h = np.full(count, size, np.uint64)
    for k in range(size):
        h = (h ^ codes[k : count + k]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


def _anchors(codes: np.ndarray) -> np.ndarray:
    """Places whose three characters hash below those of `REACH` places before and not above those of as many after; so more than `REACH` apart."""
    h, count = _hashed(codes, 3), len(codes) - ANCHORED + 1
    if count < 1:
        return np.zeros(0, np.int64)
    padded = np.concatenate([np.full(REACH, ~np.uint64(0)), h])
    lowest = np.ones(count, bool)
    for k in range(1, REACH + 1):
        lowest &= (h[:count] < padded[REACH - k : REACH - k + count]) & (h[:count] <= h[k : k + count])
    return np.flatnonzero(lowest)


def _first_grams(h: np.ndarray, places: np.ndarray, count: int) -> list[tuple[int, int, int]]:
    """The first `count` distinct hashes with their first and last places."""
    first, inverse = np.unique(h, return_inverse=True)
    near = inverse < count
    low, high = np.full(min(count, len(first)), len(h) and places.max() + 1), np.zeros(min(count, len(first)), np.int64)
    np.minimum.at(low, inverse[near], places[near])
    np.maximum.at(high, inverse[near], places[near])
    return list(zip(first[:count].tolist(), low.tolist(), high.tolist()))


def _gram_prefix(text: str, ratio: float, band: int) -> list[tuple[int, int, int]]:
    """(hash, first place, last place) of the grams of a text by which it meets its near duplicates."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    most = edits(len(codes), ratio, band)
    if not most:
        return []
    places = _anchors(codes)
    out = _first_grams(_hashed(codes, ANCHORED)[places], places, 3 * most + 1) if len(places) else []
    if len(places) <= 3 * most:
        h = _hashed(codes, min(GRAM, len(codes)))
        out += _first_grams(h, np.arange(len(h)), min(GRAM, len(codes)) * most + 1)
    return out


def _letter_counts(text: str) -> int:
    """Characters by their code modulo 8, the last eight bits of each count."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return int(np.bincount(codes % 8, minlength=8).astype(np.uint8).view("<i8")[0])


def _letter_edits(left: str, right: str) -> Column:
    """Insertions and deletions at least between texts of these counts."""
    byte = lambda c, k: F.shiftright(c, 8 * k).bitwiseAND(F.lit(255))
    apart = [F.abs(byte(left, k) - byte(right, k)) for k in range(8)]
    return functools.reduce(Column.__add__, [F.least(d, 256 - d) for d in apart])


def _gram_rows(text: str, ratio: float, band: int) -> list[dict]:
    """Rows of a text: gram with range of lengths; length and first place; distance of the last place, twice, and 1 more in the range below its own; counts."""
    n, wide = len(text), 2 * max(1, band)
    own, below = n // wide, (n - min(band, math.floor(2 * n * (1 - ratio) + 1e-9))) // wide
    mixed = lambda g, r: ((g ^ (r + 1) * 0x94D049BB133111EB) * 0xBF58476D1CE4E5B9 + (1 << 63)) % (1 << 64) - (1 << 63)
    found, letters = _gram_prefix(text, ratio, band), _letter_counts(text)
    return [{"gram": mixed(g, r), "at": n << 32 | low, "more": 2 * (high - low) + (r < own), "letters": letters} for r in range(max(0, below), own + 1) for g, low, high in found]


def edits(n: int, ratio: float, band: int) -> int:
    """Insertions and deletions at most between a text of n characters and one up to `band` longer, of at least that ratio."""
    return math.floor(min((1 - ratio) * (2 * n + band), (1 - ratio) * 2 * n / ratio) + 1e-9)


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", ratio: float = rules.NEAR_DUPLICATE_RATIO, band: int = rules.NEAR_DUPLICATE_LENGTHS) -> DataFrame:
    """Pairs of different texts (left < right by canonical text's smallest key) whose lengths differ by at most `band` and whose ratio is high enough.

    Copies are collapsed first. A ratio r leaves D = (1 - r) (n + m) insertions and deletions at most. Anchors and their grams depend on
    15 characters and lie 5 apart, so each edit takes or makes at most three; of the first 3 D + 1 distinct anchored
    grams of either text in hash order, one is in both, at places at most D apart, if either has more than 3 D anchors. Texts with
    fewer also meet on the first 8 D + 1 of all their grams of eight. No pair is lost. Texts meet by gram and range of length,
    in rows that are shuffled once for both sides of the join, and only if their counts of letters differ by D at most;
    texts move once, by a hash of key and text, and again for the few pairs that are left.
    """
    own = docs.select(F.col(key).alias("_k"), T.canonical(F.col(text)).alias("_text")).where((F.col("_text") != "") & F.col("_k").isNotNull())
    own = own.withColumn("_md5", F.md5("_text"))
    named = lambda k: F.xxhash64(k, "_md5").alias("_x")
    kept = own.groupBy("_md5").agg(F.min("_k").alias("_k")).select(named("_k"))
    own = own.select(named("_k"), "_k", "_text").join(kept, "_x", "left_semi").distinct()
    keyed = own.select("_x", F.explode(_grams_udf(ratio, band)("_text")).alias("_g")).select("_g.gram", "_x", "_g.at", "_g.more", "_g.letters").repartition("gram")
    a, b = (keyed.select("gram", F.col("_x").alias(x), F.col("at").alias(f"at_{x}"), F.col("more").alias(f"more_{x}"), F.col("letters").alias(f"letters_{x}")) for x in ("x", "y"))
    n, m = F.shiftright("at_x", 32), F.shiftright("at_y", 32)
    low, other_low = (F.col(c).bitwiseAND(F.lit((1 << 32) - 1)) for c in ("at_x", "at_y"))
    high, other_high = low + F.shiftright("more_x", 1), other_low + F.shiftright("more_y", 1)
    apart = (1 - ratio) * (n + m) + 1e-9
    # two texts of one range meet once by their names, others where the shorter is in its own range
    sides = 2 * F.col("more_x").bitwiseAND(F.lit(1)) + F.col("more_y").bitwiseAND(F.lit(1))
    once_a_pair = ((sides == 0) & (F.col("x") < F.col("y"))) | ((sides == 1) & (n < m))
    close = (F.col("x") != F.col("y")) & once_a_pair & (F.abs(n - m) <= band) & (F.abs(n - m) <= apart) & (low - other_high <= apart) & (other_low - high <= apart) & (_letter_edits("letters_x", "letters_y") <= apart)
    pairs = a.join(b, "gram").where(close).select("x", "y").distinct()
    texts = lambda side: own.select(F.col("_x").alias(side), F.col("_k").alias(f"key_{side}"), F.col("_text").alias(f"text_{side}"))
    both = pairs.join(texts("x"), "x").join(texts("y"), "y").where("key_x <> key_y")
    turned = F.col("key_x") < F.col("key_y")
    in_order = lambda c: (F.when(turned, F.col(f"{c}_x")).otherwise(F.col(f"{c}_y")), F.when(turned, F.col(f"{c}_y")).otherwise(F.col(f"{c}_x")))
    (left, right), (left_text, right_text) = in_order("key"), in_order("text")
    out = both.select(left.alias("left"), right.alias("right"), once(matcher_ratio_from(left_text, right_text, F.lit(ratio))).alias("ratio"))
    return out.where(F.col("ratio") >= ratio)


def image_matches(left: Column, right: Column) -> Column:
    """Whether two image references are one: equal, one the other's end, or of equal file name."""
    name = lambda u: F.substring_index(F.split(u, "[?#]").getItem(0), "/", -1)
    ends = F.endswith(left, F.concat(F.lit("/"), F.ltrim(right, F.lit("./")))) | F.endswith(right, F.concat(F.lit("/"), F.ltrim(left, F.lit("./"))))
    return (left == right) | ends | ((name(left) != "") & (name(left) == name(right)))
