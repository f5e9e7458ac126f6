"""Text normalisers, counts and predicates as native columns.

All regular expressions name Unicode classes explicitly, as Java's short ones are ASCII.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import rules

#: What counts as white space when text is stripped or split.
SPACE = "[\\s\\p{Z}\\x{85}\\x{1c}-\\x{1f}]"
WORD = "[\\p{L}\\p{N}_]+"
NBSP = chr(0xA0)


def text_or_empty(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit(""))


def strip(value: Column) -> Column:
    return F.regexp_replace(value, f"^{SPACE}+|{SPACE}+$", "")


def normalize_text(value: Column) -> Column:
    """NBSP to space, runs of blanks to one, no blanks or blank lines around line breaks, stripped."""
    out = F.replace(text_or_empty(value), F.lit(NBSP), F.lit(" "))
    out = F.regexp_replace(out, "[ \\t\\r\\f\\x0b]+", " ")
    out = F.regexp_replace(out, f"{SPACE}*\\n{SPACE}*", "\n")
    return strip(out)


def one_line(value: Column) -> Column:
    return strip(F.regexp_replace(text_or_empty(value), f"{SPACE}+", " "))


def normalize_markdown(value: Column) -> Column:
    """Blanks off the end of each line, at most two blank lines in a row, stripped (no fence state; see `html.normalize_markdown`)."""
    out = F.regexp_replace(F.replace(text_or_empty(value), F.lit(NBSP), F.lit(" ")), "\\r\\n?", "\n")
    out = F.regexp_replace(out, "[ \\t\\f\\x0b]+\\n", "\n")
    return strip(F.regexp_replace(out, "\\n{4,}", "\n\n\n"))


def strip_tags(value: Column) -> Column:
    return F.when(value.isNull() | (value == ""), value).otherwise(one_line(F.regexp_replace(value, "<[^>]+>", " ")))


def strip_markdown_images(value: Column) -> Column:
    return normalize_markdown(F.regexp_replace(text_or_empty(value), "!\\[[^\\]]*\\]\\([^)]*\\)", ""))


def canonical(value: Column) -> Column:
    """Lower case without anything but letters and digits: the key under which texts count as equal."""
    return F.regexp_replace(F.lower(text_or_empty(value)), "[^\\p{L}\\p{N}]+", "")


def normalize_title(value: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text_or_empty(value)), "[^a-z0-9]+", " "))


def semantic_words(value: Column) -> Column:
    """The lower-case word stream with single spaces."""
    return F.array_join(F.regexp_extract_all(F.lower(normalize_text(value)), F.lit(f"({WORD})"), F.lit(1)), " ")


def count_words(value: Column) -> Column:
    return F.regexp_count(text_or_empty(value), F.lit(WORD)).cast("long")


def count_cjk(value: Column) -> Column:
    return F.char_length(F.regexp_replace(text_or_empty(value), "[^\\x{4e00}-\\x{9fff}]+", "")).cast("long")


def estimate_tokens(normalized: Column) -> Column:
    """A quarter of the characters, rounded up."""
    return F.ceil(F.char_length(text_or_empty(normalized)) / 4).cast("long")


def truncate_to_tokens(normalized: Column, budget: Column | int) -> Column:
    """Cut to about `budget` tokens (32 characters at least) with an ellipsis; empty without a budget."""
    budget = F.lit(budget) if isinstance(budget, int) else budget
    cut = F.substring(normalized, F.lit(1), F.greatest(F.lit(32), budget * 4).cast("int"))
    cut = F.regexp_replace(cut, "[ ,;:\\n]+$", "")
    cut = F.when(F.char_length(cut) < F.char_length(normalized), F.concat(cut, F.lit("..."))).otherwise(cut)
    return F.when(budget <= 0, F.lit("")).when(estimate_tokens(normalized) <= budget, normalized).otherwise(cut)


def _alternatives(phrases: Iterable[str]) -> str:
    return "|".join(f"\\Q{p}\\E" for p in phrases)


def contains_any(value: Column, phrases: Iterable[str]) -> Column:
    """One regular expression for all phrases: long chains of conditions would outgrow a generated method."""
    phrases = tuple(phrases)
    return F.rlike(value, F.lit(_alternatives(phrases))) if phrases else F.lit(False)


def starts_with_any(value: Column, prefixes: Iterable[str]) -> Column:
    prefixes = tuple(prefixes)
    return F.rlike(value, F.lit(f"^(?:{_alternatives(prefixes)})")) if prefixes else F.lit(False)


def matching_phrases(value: Column, phrases: Iterable[str]) -> Column:
    """Those of the phrases that occur, in alphabetical order."""
    return F.filter(F.array(*(F.lit(p) for p in sorted(phrases))), lambda p: F.contains(value, p))


def access_gate_phrases(value: Column) -> Column:
    return matching_phrases(F.lower(normalize_text(value)), rules.ACCESS_GATE_PHRASES)


def has_access_gate(value: Column) -> Column:
    return contains_any(F.lower(normalize_text(value)), rules.ACCESS_GATE_PHRASES)


def access_signals(title: Column, text: Column, status: Column, redirected: Column | bool = False, paywall_text: bool = True, no_access: Column | bool = False) -> Column:
    """Signals of a challenge, missing, denied or paid page, in a fixed order, each once."""
    as_column = lambda x: F.lit(x) if isinstance(x, bool) else x
    page = F.lower(normalize_text(F.concat_ws(" ", text_or_empty(title), text_or_empty(text))))
    challenge = contains_any(page, rules.CHALLENGE_PHRASES)
    missing = F.coalesce(status == 404, F.lit(False)) | contains_any(page, rules.NOT_FOUND_PHRASES)
    denied = F.coalesce(status.isin(401, 402, 403), F.lit(False)) & ~challenge
    found = [
        F.when(as_column(redirected), F.lit("redirected_to_abstract")),
        F.when(challenge, F.lit("cloudflare_challenge")),
        F.when(missing, F.lit("publisher_not_found")),
        F.when(denied | as_column(no_access), F.lit("publisher_access_denied")),
    ]
    if paywall_text:
        found.append(F.when(contains_any(page, rules.ACCESS_GATE_PHRASES), F.lit("publisher_paywall")))
    return F.array_compact(F.array(*found))


def sentences(value: Column) -> Column:
    """How many sentences a text has."""
    return F.size(F.filter(F.split(normalize_text(value), f"(?<=[.!?]){SPACE}+"), lambda s: s != ""))


def is_substantial_prose(value: Column) -> Column:
    return (F.char_length(normalize_text(value)) >= 80) | (sentences(value) >= 2)


def ordered_distinct(values: Column) -> Column:
    """Normalised, non-empty strings, first occurrences in order."""
    return F.array_distinct(F.filter(F.transform(F.coalesce(values, F.array().cast("array<string>")), normalize_text), lambda x: x != ""))


def extend_unique(target: Column, items: Column) -> Column:
    return F.array_distinct(F.concat(target, ordered_distinct(items)))


def split_authors(value: Column) -> Column:
    return ordered_distinct(F.split(text_or_empty(value), f"{SPACE}*[;,]{SPACE}*"))


def author_key(name: Column) -> Column:
    """"Last, First" and "First Last" give one key of ASCII letters and digits."""
    plain = one_line(F.replace(text_or_empty(name), F.lit(NBSP), F.lit(" ")))
    parts = F.filter(F.transform(F.split(plain, ","), strip), lambda p: p != "")
    turned = F.when(F.size(parts) >= 2, F.concat_ws(" ", F.slice(parts, F.lit(2), F.size(parts)), F.element_at(parts, 1))).otherwise(plain)
    return F.trim(F.regexp_replace(F.lower(turned), "[^a-z0-9]+", " "))


def dedupe_authors(authors: Column) -> Column:
    """Names in order, each author key once."""
    keyed = F.filter(F.transform(authors, lambda a: F.struct(author_key(a).alias("key"), one_line(a).alias("name"))), lambda x: x["key"] != "")
    firsts = F.filter(keyed, lambda x, i: ~F.exists(F.slice(keyed, F.lit(1), i), lambda y: y["key"] == x["key"]))
    return F.transform(firsts, lambda x: x["name"])


def escape_table_cell(value: Column) -> Column:
    return F.replace(text_or_empty(value), F.lit("|"), F.lit("\\|"))


def figure_label(value: Column) -> Column:
    """"Fig. 3a" as "figure 3a"; null without a label."""
    number = F.regexp_extract(normalize_text(value), "(?i)\\bfig(?:ure)?s?\\.?\\s*([0-9]+[a-z]?)", 1)
    return F.when(number != "", F.concat(F.lit("figure "), F.lower(number)))


def last_year(value: Column) -> Column:
    years = F.regexp_extract_all(text_or_empty(value), F.lit("\\b((?:19|20)[0-9]{2})\\b"), F.lit(1))
    return F.when(F.size(years) > 0, F.element_at(years, -1))


def numeric_citations(value: Column) -> Column:
    """A comma list of numbers and ranges, tidied; null if any part is something else."""
    parts = F.transform(F.split(normalize_text(value), ","), lambda p: F.regexp_replace(strip(p), f"{SPACE}*[-‐‑‒–—−]{SPACE}*", "–"))
    ok = F.forall(parts, lambda p: p.rlike("^[0-9]+(–[0-9]+)?$"))
    return F.when(ok, F.array_join(parts, ", "))


def overlap_chunks(value: Column) -> Column:
    """Paragraphs of at least 160 characters, in lower case on one line."""
    chunks = F.transform(F.split(text_or_empty(value), f"\\n{SPACE}*\\n"), lambda p: F.lower(one_line(p)))
    return F.filter(chunks, lambda p: F.char_length(p) >= rules.OVERLAP_CHUNK)


def abstract_body_overlap(abstract: Column, body: Column) -> Column:
    """Whether one long paragraph of the abstract, or two, are in the body."""
    text = F.lower(one_line(body))
    found = F.filter(overlap_chunks(abstract), lambda c: F.contains(text, c))
    return (text != "") & (F.exists(found, lambda c: F.char_length(c) >= rules.OVERLAP_ONE_CHUNK) | (F.size(found) >= rules.OVERLAP_CHUNKS))


def inflated_abstract(abstract: Column, tokens: Column, overlap: Column) -> Column:
    chars = F.char_length(abstract)
    return (tokens >= rules.INFLATED_TOKENS) | (chars >= rules.INFLATED_CHARS) | (overlap & ((tokens >= rules.INFLATED_OVERLAP_TOKENS) | (chars >= rules.INFLATED_OVERLAP_CHARS)))


def semantic_match(left: Column, right: Column) -> Column:
    """Equal, one inside the other, or a shared prefix of words of at least max(12, a third, 24 at most) characters."""
    a, b = semantic_words(left), semantic_words(right)
    x, y = F.split(a, " "), F.split(b, " ")
    same = F.transform(x, lambda w, i: F.coalesce(w == F.get(y, i), F.lit(False)))
    first_miss = F.array_position(same, False)
    shared = F.when(first_miss == 0, F.size(x)).otherwise(first_miss - 1)
    prefix = F.char_length(F.array_join(F.slice(x, F.lit(1), shared.cast("int")), " "))
    least = F.least(F.char_length(a), F.char_length(b))
    need = F.least(F.lit(24), F.greatest(F.lit(12), F.floor(least / 3)))
    return (a != "") & (b != "") & ((a == b) | F.contains(a, b) | F.contains(b, a) | (prefix >= need))


def compose_query(title: Column, authors: Column, year: Column, raw: Column) -> Column:
    """A title with up to three authors and a year, or the raw query."""
    named = F.concat_ws(" ", title, F.array_join(F.slice(F.coalesce(authors, F.array().cast("array<string>")), 1, 3), " "), year.cast("string"))
    return F.when(normalize_text(title) != "", one_line(named)).otherwise(normalize_text(raw))


def latex(value: Column) -> Column:
    """White space, thin-space macros, upright Greek aliases and a single pair of dollars tidied away."""
    out = one_line(value)
    out = F.regexp_replace(out, "\\\\mspace\\{([^}]*?)mu\\}", "\\\\mkern$1mu")
    out = F.regexp_replace(out, "\\\\up(alpha|beta|gamma|delta|epsilon|zeta|eta|theta|iota|kappa|lambda|mu|nu|xi|pi|rho|sigma|tau|upsilon|phi|chi|psi|omega)(?![A-Za-z])", "\\\\$1")
    return strip(F.regexp_replace(out, "^\\$([^$]*)\\$$", "$1"))


def citation_sup(value: Column) -> Column:
    """Numeric citations in brackets or parentheses as superscripts, with tidy spacing around them."""
    out = F.regexp_replace(text_or_empty(value), "\\s*[\\[(](?:(?i:refs?\\.?)\\s*)?([0-9]+(?:\\s*[-–,]\\s*[0-9]+)*)[\\])]", "<sup>$1</sup>")
    out = F.regexp_replace(out, "\\s*[−—-]\\s*(?=[0-9]+[^<>]*</sup>)", "–")
    return tidy_punctuation(F.regexp_replace(out, "\\s+(<su[bp]>)", "$1"))


def tidy_punctuation(value: Column) -> Column:
    """No blanks before closing or after opening marks, at most one blank line, stripped."""
    out = F.regexp_replace(text_or_empty(value), "\\s+([,.;:!?])", "$1")
    out = F.regexp_replace(F.regexp_replace(out, "([(\\[])\\s+", "$1"), "\\s+([)\\]])", "$1")
    return strip(F.regexp_replace(F.regexp_replace(out, "\\n{3,}", "\n\n"), "[ \\t]+\\n", "\n"))


def clean_citation_markers(value: Column, unwrap_links: bool = False, join_labels: bool = False, drop_figure_lines: bool = False) -> Column:
    """Text without article links, figure lines and gaps in labels, as asked for."""
    out = text_or_empty(value)
    if drop_figure_lines:
        out = F.regexp_replace(F.regexp_replace(out, "(?im)^(?:extended data\\s+)?fig\\.\\s*[a-z0-9.-]+:.*$", ""), "(?im)^\\s*source data\\s*$", "")
    if unwrap_links:
        out = F.regexp_replace(out, "\\[([^\\]]+)\\]\\((?:/(?:article|articles)/[^)]+|#[^)]+)\\)", "$1")
    if join_labels:
        out = F.regexp_replace(out, "\\b(Extended Data|Figs?|Tabs?|Eqs?|Refs?)\\s+([0-9]+[A-Za-z]?)\\b", "$1$2")
    return tidy_punctuation(out)


def join_fragments(parts: Column) -> Column:
    """Inline fragments with a space where both edges are letters or digits."""
    start = F.lit("")
    edge = lambda s, p: s.rlike("[\\p{L}\\p{N},.;:]$") & p.rlike("^[\\p{L}\\p{N}(]")
    return F.aggregate(F.filter(parts, lambda p: strip(p) != ""), start, lambda s, p: F.when((s == "") | ~edge(s, strip(p)), F.concat(s, strip(p))).otherwise(F.concat(s, F.lit(" "), strip(p))))


def strip_title_heading(markdown: Column, title: Column) -> Column:
    """Markdown without its first line if that is a heading equal to the title."""
    first = F.regexp_extract(strip(markdown), "^#\\s+([^\\n]*)", 1)
    same = (canonical(title) != "") & (canonical(first) == canonical(title))
    return F.when(same, strip(F.regexp_replace(strip(markdown), "^#[^\\n]*\\n?", ""))).otherwise(markdown)


def strip_abstract_label(value: Column) -> Column:
    return strip(F.regexp_replace(normalize_text(value), "(?i)^(abstract|summary)\\s*[:.—–-]?\\s+", ""))


def is_lookup_title(value: Column, least: int = 0) -> Column:
    """Whether a page's title can be looked up: long enough and no sign of a redirect or gate."""
    t = F.lower(normalize_text(value))
    return (F.char_length(t) >= least) & (t != "") & ~contains_any(t, rules.TITLE_DENIALS)


def language(value: Column) -> Column:
    """Language code of a name or code; null if unknown."""
    t = F.lower(F.regexp_replace(normalize_text(value), "_", "-"))
    names = F.create_map(*(F.lit(x) for pair in rules.LANGUAGES.items() for x in pair))
    code = F.when(t.rlike("^[a-z]{2,3}(-[a-z0-9]{2,8})*$"), F.substring_index(t, "-", 1))
    return F.coalesce(F.try_element_at(names, t), code)
