"""Quality rules: a learned decision list of threshold conjunctions, as native Spark conditions.

Statistics of whole texts are plain SQL expressions. A bounded sample of
labelled rows (`sample_rows`, the smallest by a hash of doc_id) goes to the
driver, where sequential covering grows one conjunction after the other on two
thirds of it (each step adds the threshold with the largest gain), prunes it on
the rest, and keeps it if it is precise enough. The list becomes an ordered
`when` chain that rejects what a rule matches and keeps all else. The documents
themselves are only touched by built-in expressions; there is no shuffle.

Defined results: null or empty text has no words and fails the base test; rows
are judged one by one, so repeated or null doc_id stay; without usable labels
the list is empty and keeps what passes the base test; extra columns pass through, but `apply_rules` replaces those
named like its counts and verdicts (`keep` keeps them).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import document_text, free_prefix

_SPACES = " \t\n\x0b\x0c\r"
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: The statistics that rules may test.
FEATURE = "_feature_"
FEATURES = ("words", "word_length", "symbols_per_word", "dup_line_share", "repeat_share", "capital_share", "marks_per_word", "distinct_share")


@dataclass(frozen=True)
class Condition:
    feature: str
    at_least: bool
    threshold: float

    def column(self) -> Column:
        value = F.col(FEATURE + self.feature)
        return value >= self.threshold if self.at_least else value <= self.threshold

    def holds(self, table: dict[str, np.ndarray]) -> np.ndarray:
        return table[self.feature] >= self.threshold if self.at_least else table[self.feature] <= self.threshold


Rule = tuple[Condition, ...]


def _occurrences(text: Column, characters: str) -> Column:
    """How often any of some characters occurs; by plain replacement, which needs no regular expression."""
    total = F.lit(0)
    for c in characters:
        total = total + (F.char_length(text) - F.char_length(F.replace(text, F.lit(c), F.lit(""))))
    return total.cast("long")


def _let(value: Column, body) -> Column:
    """Evaluate an array once and use it in `body`, also inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _once(value: Column) -> Column:
    """The same value behind an expression the optimiser won't copy into filters and lambdas above it."""
    return F.when(F.monotonically_increasing_id() >= 0, value)


def _windows(words: Column, n: Column, window: int) -> Column:
    """Hashes of all windows of `window` words."""
    return _let(words, lambda w: F.transform(F.sequence(F.lit(1), n - (window - 1)), lambda i: F.xxhash64(*(F.element_at(w, i + k) for k in range(window)))))


def _covered(windows: Column, window: int) -> Column:
    """Words that lie in a window found twice or more."""

    def again(ordered: Column) -> Column:  # starts of such windows: neighbours in the sorted array have equal hashes
        same = lambda k, x: F.coalesce(F.get(ordered, k)["h"] == x["h"], F.lit(False))
        marked = F.transform(ordered, lambda x, k: F.when(same(k - 1, x) | same(k + 1, x), x["i"]))
        return F.sort_array(F.filter(marked, lambda i: i.isNotNull()))

    def words(starts: Column) -> Column:
        step = F.transform(starts, lambda i, k: F.least(F.lit(window), F.coalesce(F.get(starts, k + 1) - i, F.lit(window))))
        return F.aggregate(step, F.lit(0), lambda total, x: total + x)

    ordered = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return _let(_let(ordered, again), words)


def statistics(docs: DataFrame, window: int = 5) -> DataFrame:
    """Add the base counts and the features of each text."""
    text = document_text()
    out = docs.withColumn("_text", text)
    trimmed = F.trim(F.col("_text"), F.lit(_SPACES))
    out = out.withColumn("_words", F.when(F.col("_text") == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, "[\\x20\\x09-\\x0D]+")))
    out = out.withColumn("_words", F.when(F.size("_words").eqNullSafe(1) & (F.element_at("_words", 1) == ""), F.array().cast("array<string>")).otherwise(F.col("_words")))
    out = out.withColumn("_words", _once(F.col("_words")))
    out = out.withColumn("n_words", F.size("_words").cast("long"))
    out = out.withColumn("_windows", F.when(F.col("n_words") >= window, _windows(F.col("_words"), F.col("n_words").cast("int"), window)).otherwise(F.array().cast("array<bigint>")))
    out = out.withColumn("_windows", _once(F.col("_windows")))
    out = out.withColumn("_repeats", F.size("_windows") > F.size(F.array_distinct("_windows")))
    out = out.withColumn("n_repeat_words", _once(F.when(F.col("_repeats"), _covered(F.col("_windows"), window)).otherwise(F.lit(0)).cast("long")))
    lines = F.filter(F.split(F.col("_text"), "\n"), lambda line: F.trim(line, F.lit(_SPACES)) != "")
    out = out.withColumn("_lines", lines)
    out = out.withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
    out = out.withColumn("word_chars", F.char_length(F.array_join("_words", "")).cast("long"))
    out = out.withColumn("n_symbols", _occurrences(F.col("_text"), "#*$%&|<>"))
    n, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    out = out.withColumns(
        {
            FEATURE + "words": F.col("n_words").cast("double"),
            FEATURE + "word_length": F.col("word_chars") / n,
            FEATURE + "symbols_per_word": F.col("n_symbols") / n,
            FEATURE + "dup_line_share": F.col("n_dup_lines") / F.greatest(F.size("_lines"), F.lit(1)),
            FEATURE + "repeat_share": F.col("n_repeat_words") / n,
            FEATURE + "capital_share": F.char_length(F.regexp_replace("_text", "[^\\p{Lu}]+", "")) / chars,
            FEATURE + "marks_per_word": _occurrences(F.col("_text"), "!?") / n,
            FEATURE + "distinct_share": F.size(F.array_distinct("_words")) / n,
        }
    )
    return out.drop("_text", "_words", "_windows", "_repeats", "_lines")


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)


def _gain(p: np.ndarray, n: np.ndarray, p0: float, n0: float) -> np.ndarray:
    """Information gain of narrowing (p0 bad, n0 good) to (p, n)."""
    before = math.log2((p0 + 1e-9) / (p0 + n0 + 1e-9))
    return p * (np.log2((p + 1e-9) / (p + n + 1e-9)) - before)


def _grow(table: dict[str, np.ndarray], bad: np.ndarray, cuts: dict[str, np.ndarray], longest: int) -> Rule:
    rule: list[Condition] = []
    live = np.ones(len(bad), bool)
    while len(rule) < longest and (~bad & live).any():
        best, found = 1e-6, None
        p0, n0 = float((bad & live).sum()), float((~bad & live).sum())
        for feature, at in cuts.items():
            slot_low = np.searchsorted(at, table[feature][live], "right")  # cuts <= value
            slot_high = np.searchsorted(at, table[feature][live], "left")  # cuts < value
            for at_least in (True, False):
                counts = []
                for mask in (bad[live], ~bad[live]):
                    if at_least:  # value >= cut j: those with slot_low > j
                        c = np.bincount(slot_low[mask], minlength=len(at) + 1)
                        counts.append(c[::-1].cumsum()[::-1][1:])
                    else:  # value <= cut j: those with slot_high <= j
                        c = np.bincount(slot_high[mask], minlength=len(at) + 1)
                        counts.append(c.cumsum()[:-1])
                gain = _gain(counts[0].astype(float), counts[1].astype(float), p0, n0)
                if len(gain) and gain[k := int(gain.argmax())] > best:
                    best, found = float(gain[k]), Condition(feature, at_least, float(at[k]))
        if found is None:
            break
        rule.append(found)
        live &= found.holds(table)
    return tuple(rule)


def _matches(rule: Rule, table: dict[str, np.ndarray]) -> np.ndarray:
    out = np.ones(len(next(iter(table.values()))), bool)
    for c in rule:
        out &= c.holds(table)
    return out


def _prune(rule: Rule, table: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    """Drop last conditions while (bad - good) / all matched on the pruning rows does not fall."""

    def worth(r: Rule) -> float:
        m = _matches(r, table)
        return float((bad & m).sum() - (~bad & m).sum() + 0.0) / max(1.0, float(m.sum()))

    best = rule
    for k in range(len(rule) - 1, 0, -1):
        if worth(rule[:k]) >= worth(best):
            best = rule[:k]
    return best


def learn_rules(table: dict[str, np.ndarray], bad: np.ndarray, precision: float = 0.9, least: int = 8, longest: int = 4, most_rules: int = 16, cuts: int = 64, seed: int = 7) -> list[Rule]:
    """Sequential covering over labelled statistics; `bad` marks rows that should be rejected."""
    features = [f for f in FEATURES if f in table]
    rng = np.random.default_rng(seed)
    pruning = rng.random(len(bad)) < 1 / 3
    rules: list[Rule] = []
    left = np.ones(len(bad), bool)
    at = {f: np.unique(np.quantile(table[f], np.linspace(0, 1, cuts + 1))) if len(bad) else np.zeros(0) for f in features}
    for f in features:  # quantiles of the bad rows too: they may be few
        if bad.any():
            at[f] = np.unique(np.concatenate([at[f], np.quantile(table[f][bad], np.linspace(0, 1, cuts + 1))]))
    while len(rules) < most_rules:
        grow, prune = left & ~pruning, left & pruning
        if (bad & grow).sum() < least:
            break
        part = lambda mask: ({f: table[f][mask] for f in features}, bad[mask])
        rule = _grow(*part(grow), at, longest)
        if not rule:
            break
        rule = _prune(rule, *part(prune))
        hit = _matches(rule, {f: table[f][left] for f in features})
        own = bad[left][hit]
        if len(own) < least or own.mean() < precision:
            break
        rules.append(rule)
        rows = np.flatnonzero(left)
        left[rows[hit]] = False
    return rules


def verdict(rules: list[Rule]) -> Column:
    """The ordered conditional: false where a rule matches, else true."""
    out = None
    for rule in rules:
        condition = F.lit(True)
        for c in rule:
            condition = condition & c.column()
        out = F.when(condition, F.lit(False)) if out is None else out.when(condition, F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def learn_from(docs: DataFrame, labels: DataFrame, sample_rows: int = 20000, **how) -> list[Rule]:
    """Rules from at most `sample_rows` labelled documents (a documented bound; a broadcast of as many ids)."""
    marked = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).select("doc_id", F.col("quality").cast("int").alias("_quality"))
    sample = marked.orderBy(F.xxhash64("doc_id"), "doc_id", "_quality").limit(sample_rows)
    some = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    rows = [r for r in statistics(some).select("_quality", base_failed().alias("_failed"), *(F.col(FEATURE + f).alias(f) for f in FEATURES)).collect() if not r["_failed"]]
    table = {f: np.array([float(r[f]) for r in rows]) for f in FEATURES}
    return learn_rules(table, np.array([r["_quality"] == 0 for r in rows], bool), **how)


def apply_rules(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """Add the base counts, `base_failed` and `kept`; every row stays."""
    out = statistics(docs).withColumn("base_failed", base_failed())
    out = out.withColumn("kept", F.when(F.col("base_failed"), F.lit(False)).otherwise(verdict(rules)))
    return out.drop(*(FEATURE + f for f in FEATURES))


def keep(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """The rows that the base test and the rules keep, all columns as they are, whatever their names."""
    free = free_prefix(docs.columns, "own")
    named = docs.select(*(F.col(f"`{c}`").alias(free + c) for c in docs.columns), "doc_id", "text")
    return apply_rules(named, rules).where("kept").select(*(F.col(f"`{free}{c}`").alias(c) for c in docs.columns))
