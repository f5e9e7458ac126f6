"""DOIs, URLs, file names and MIME types as native columns."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import rules
from . import arrow_udf
from .text import SPACE, normalize_text, strip, text_or_empty

DOI = "(10\\.[0-9]{4,9}/[^\\s\"'<>]+)"


@arrow_udf("string")
def _nfkc(values: pd.Series) -> pd.Series:
    return values.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFKC", x))


def nfkc(value: Column) -> Column:
    """Compatibility composition; the one step here that needs Python."""
    return _nfkc(value)


def clean_doi(value: Column, compose: bool = False) -> Column:
    """Lower case, plain dashes, without resolver or label, white space and closing punctuation.

    `compose` adds Unicode compatibility composition first; leave it out for ASCII input.
    """
    out = F.lower(strip(nfkc(value) if compose else text_or_empty(value)))
    out = F.translate(out, rules.DOI_DASHES, "-" * len(rules.DOI_DASHES))
    out = F.regexp_replace(out, "^https?://(dx\\.)?doi\\.org/", "")
    out = F.regexp_replace(out, f"^doi:{SPACE}*", "")
    return F.regexp_replace(F.regexp_replace(out, f"{SPACE}+", ""), "[).,;]+$", "")


def extract_doi(value: Column) -> Column:
    """The first DOI in a text, cleaned; null without one."""
    found = F.regexp_extract(text_or_empty(value), "(?i)" + DOI, 1)
    return F.when(found != "", clean_doi(found))


def doi_needs_cleaning(value: Column) -> Column:
    """Whether a reference's DOI is not in plain form."""
    plain = normalize_text(value)
    odd = plain.rlike("[^\\x00-\\x7f]") | F.lower(plain).rlike("^(https?://|doi:)") | plain.rlike(SPACE) | ~plain.rlike("(?i)^10\\.[0-9]{4,9}/\\S+$")
    return (plain != "") & odd


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, "^([A-Za-z][A-Za-z0-9+.-]*):", 1))


def host(url: Column) -> Column:
    """Lower-case authority of a URL; empty without one."""
    return F.lower(F.regexp_extract(url, "^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1))


def path(url: Column) -> Column:
    return F.regexp_extract(url, "^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)


def is_http_url(url: Column) -> Column:
    u = normalize_text(url)
    return scheme(u).isin("http", "https") & (host(u) != "")


def is_api_like_url(url: Column) -> Column:
    u = normalize_text(url)
    h, p = host(u), F.lower(path(u))
    tokens = F.lit(False)
    for t in rules.API_PATHS:
        tokens = tokens | F.contains(p, F.lit(t))
    return (h != "") & (h.isin(*rules.API_HOSTS) | h.startswith("api.") | tokens)


def landing_page(candidates: Column) -> Column:
    """The first of the URLs that is no API's, else the first."""
    usable = F.array_distinct(F.filter(F.transform(candidates, normalize_text), is_http_url))
    return F.coalesce(F.get(F.filter(usable, lambda u: ~is_api_like_url(u)), F.lit(0)), F.get(usable, F.lit(0)))


def is_abstract_redirect(requested: Column, final: Column) -> Column:
    a, b = F.lower(text_or_empty(requested)), F.lower(text_or_empty(final))
    return F.contains(a, F.lit("/doi/full/")) & F.contains(b, F.lit("/doi/abs/")) & (a != b)


def is_access_page(url: Column) -> Column:
    u = F.lower(normalize_text(url))
    out = F.lit(False)
    for t in rules.ACCESS_URL_TOKENS:
        out = out | F.contains(u, F.lit(t))
    return out


def is_reference_anchor(href: Column) -> Column:
    fragment = F.lower(F.regexp_extract(normalize_text(href), "#(.*)$", 1))
    return fragment.rlike("(?:^|[-_/])(?:ref|bib|cite|cr)\\b")


def journal_key(value: Column, compose: bool = False) -> Column:
    """A journal or publisher name in lower-case ASCII words."""
    out = F.lower(nfkc(value) if compose else text_or_empty(value))
    out = F.replace(out, F.lit("&"), F.lit(" and "))
    out = F.translate(out, rules.JOURNAL_PUNCTUATION, " " * len(rules.JOURNAL_PUNCTUATION))
    return F.trim(F.regexp_replace(F.regexp_replace(out, "[^a-z0-9\\s]+", " "), "\\s+", " "))


def file_name(value: Column, longest: int = 180) -> Column:
    """A safe file name; long ones are cut and get the first eight digits of their SHA-1."""
    raw = text_or_empty(value)
    digest = F.substring(F.sha1(raw.cast("binary")), 1, 8)
    slug = F.regexp_replace(F.regexp_replace(raw, "[^A-Za-z0-9._-]+", "_"), "_+", "_")
    slug = F.regexp_replace(slug, "^[._-]+|[._-]+$", "")
    cut = F.regexp_replace(F.substring(slug, 1, longest), "[._-]+$", "")
    cut = F.regexp_replace(F.substring(cut, 1, longest - 9), "[._-]+$", "")
    short = F.concat(F.when(cut == "", F.lit("fulltext")).otherwise(cut), F.lit("_"), digest)
    return F.when(slug == "", F.concat(F.lit("fulltext_"), digest)).when(F.char_length(slug) <= longest, slug).otherwise(short)


def extension(content_type: Column, url: Column) -> Column:
    """File extension of a MIME type, else the URL's, else .bin."""
    kind = F.lower(F.trim(F.substring_index(text_or_empty(content_type), ";", 1)))
    known = F.create_map(*(F.lit(x) for pair in rules.EXTENSIONS.items() for x in pair))
    own = F.regexp_extract(path(text_or_empty(url)), "[^/.][^/]*?(\\.[^./]+)$", 1)
    return F.coalesce(F.try_element_at(known, kind), F.when(own != "", own), F.lit(".bin"))


def date_parts(parts: Column) -> Column:
    """[[y, m, d]] as y-m-d without padding."""
    first = F.get(parts, F.lit(0))
    return F.when(F.size(F.coalesce(first, F.array().cast("array<int>"))) > 0, F.array_join(F.transform(first, lambda x: x.cast("string")), "-"))


def image_type(body: Column) -> Column:
    """MIME type from the first bytes of an image; empty if unknown."""
    h = F.hex(F.substring(body, 1, 16))
    return (
        F.when(h.startswith("89504E470D0A1A0A"), "image/png")
        .when(h.startswith("FFD8FF"), "image/jpeg")
        .when(h.startswith("474946383761") | h.startswith("474946383961"), "image/gif")
        .when(h.startswith("52494646") & (F.substring(h, 17, 8) == "57454250"), "image/webp")
        .when(h.startswith("49492A00") | h.startswith("4D4D002A"), "image/tiff")
        .when(h.startswith("424D"), "image/bmp")
        .otherwise("")
    )


def decode_bytes(body: Column) -> Column:
    """UTF-8 (a byte order mark is kept as it is), else Latin-1."""
    return F.when(F.is_valid_utf8(body.cast("string")), F.decode(body, "UTF-8")).otherwise(F.decode(body, "ISO-8859-1"))


def image_url_from_srcset(value: Column) -> Column:
    """The URL of the highest density or width in a srcset; the last of equals."""
    items = F.filter(F.transform(F.split(text_or_empty(value), ","), strip), lambda x: x != "")
    scored = F.transform(
        items,
        lambda x, i: F.struct(
            F.coalesce(F.regexp_extract(F.lower(x), "\\s([0-9]+(?:\\.[0-9]+)?)[xw]$", 1).try_cast("double") * F.when(F.endswith(x, F.lit("x")), 1000).otherwise(1), F.lit(0.0)).alias("score"),
            i.alias("at"),
            F.regexp_extract(x, "^(\\S+)", 1).alias("url"),
        ),
    )
    return F.coalesce(F.array_max(scored)["url"], F.lit(""))


def is_full_size_image(url: Column) -> Column:
    u = F.lower(normalize_text(url))
    has = lambda tokens: F.exists(F.array(*(F.lit(t) for t in tokens)), lambda t: F.contains(u, t))
    return (u != "") & ~has(rules.PREVIEW_URLS) & has(rules.FULL_SIZE_URLS)


def acceptable_preview(width: Column, height: Column) -> Column:
    return (F.coalesce(width, F.lit(0)) >= rules.PREVIEW_SIZE[0]) & (F.coalesce(height, F.lit(0)) >= rules.PREVIEW_SIZE[1])


def url_keys(value: Column) -> Column:
    """Forms under which an image's URL or path may be written: whole, path only, without leading dots and slashes."""
    plain = F.regexp_replace(normalize_text(value), "^<|>$", "")
    forms = F.array(plain, path(plain), F.coalesce(F.try_url_decode(plain), plain), F.coalesce(F.try_url_decode(path(plain)), plain))
    clean = F.transform(forms, lambda x: F.regexp_replace(F.regexp_replace(F.replace(x, F.lit("\\"), F.lit("/")), "/+", "/"), "^\\./", ""))
    return F.array_distinct(F.filter(F.concat(clean, F.transform(clean, lambda x: F.regexp_replace(x, "^/+", ""))), lambda x: x != ""))


def asset_group(ref: Column) -> Column:
    """The code (letters and number) in an asset's file name under which its sizes belong together, else the name."""
    plain = F.lower(strip(ref))
    name = F.substring_index(F.split(plain, "[?#]").getItem(0), "/", -1)
    name = F.when(name == "", plain).otherwise(name)
    code = F.regexp_extract(name, f"((?:{'|'.join(rules.ASSET_CODES)})[0-9]+|{rules.ASSET_CODE_ALONE[0]})", 1)
    return F.when(code != "", code).otherwise(name)


def asset_kind(ref: Column, kind: Column, category: Column) -> Column:
    """What an asset is: by its code, else an image by its declared type or category, else supplementary."""
    group = asset_group(ref)
    letters = F.regexp_extract(group, f"^({'|'.join(rules.ASSET_CODES)})[0-9]+$", 1)
    coded = F.try_element_at(F.create_map(*(F.lit(x) for pair in rules.ASSET_CODES.items() for x in pair)), letters)
    image = F.startswith(F.upper(strip(text_or_empty(kind))), F.lit(rules.ASSET_IMAGE_TYPE)) | (F.lower(strip(text_or_empty(category))) == rules.ASSET_IMAGE_CATEGORY)
    return F.when(group == rules.ASSET_CODE_ALONE[0], rules.ASSET_CODE_ALONE[1]).otherwise(F.coalesce(coded, F.when(image, "image").otherwise("supplementary")))


def figure_score(page_url: Column, full_size_url: Column, url: Column, preview_url: Column, caption: Column) -> Column:
    """How much a figure's record tells; of records of one figure the highest counts."""
    urls = F.concat_ws(" ", *(F.lower(normalize_text(u)) for u in (full_size_url, url, preview_url)))
    filled = lambda c: normalize_text(c) != ""
    holds = {"page": filled(page_url), "fig": F.contains(urls, F.lit("fig")), "equation": urls.rlike(rules.EQUATION_URL), "full": filled(full_size_url), "preview": filled(preview_url), "caption": filled(caption)}
    return sum((F.when(holds[k], points).otherwise(0) for k, points in rules.FIGURE_POINTS.items()), F.lit(0))


def _dimensions(body: bytes | None) -> tuple[int, int] | None:
    raw = bytes(body or b"")
    if raw[:8] == b"\x89PNG\r\n\x1a\n" and len(raw) >= 24:
        return int.from_bytes(raw[16:20], "big"), int.from_bytes(raw[20:24], "big")
    if raw[:6] in (b"GIF87a", b"GIF89a") and len(raw) >= 10:
        return int.from_bytes(raw[6:8], "little"), int.from_bytes(raw[8:10], "little")
    if raw[:2] == b"BM" and len(raw) >= 26:
        return int.from_bytes(raw[18:22], "little"), abs(int.from_bytes(raw[22:26], "little", signed=True))
    at = 2
    while raw[:2] == b"\xff\xd8" and at + 9 < len(raw):  # JPEG: walk the segments to a frame header
        kind = raw[at + 1]
        if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            return int.from_bytes(raw[at + 7 : at + 9], "big"), int.from_bytes(raw[at + 5 : at + 7], "big")
        at += 2 + int.from_bytes(raw[at + 2 : at + 4], "big")
    return None


@arrow_udf("width int, height int")
def image_dimensions(bodies: pd.Series) -> pd.DataFrame:
    """Width and height from the header of a PNG, GIF, BMP or JPEG; nulls for others."""
    found = [_dimensions(b) or (None, None) for b in bodies]
    return pd.DataFrame({"width": pd.array([w for w, _ in found], "Int32"), "height": pd.array([h for _, h in found], "Int32")})
