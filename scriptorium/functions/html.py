"""HTML: a small tree on the standard parser, and one Arrow UDF that gives all facts of a page.

A page is parsed once per row; the UDF's struct holds its title, metadata,
blocks, references, assets and Markdown, and unused fields cost nothing more to drop.
"""

from __future__ import annotations

import html as entities
import json
import re
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import rules
from . import arrow_udf

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
BLOCK = {
    "address", "article", "aside", "blockquote", "dd", "div", "dl", "dt", "figcaption", "figure", "footer", "form", "h1", "h2",
    "h3", "h4", "h5", "h6", "header", "li", "main", "ol", "p", "pre", "section", "table", "tbody", "td", "tfoot", "th",
    "thead", "tr", "ul",
}
#: What a start tag closes if it is still open.
_CLOSES = {"p": {"p"}, "li": {"li"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}}
_CLOSES |= {t: {"p"} for t in BLOCK if t not in _CLOSES}


def squeeze(value: str | None) -> str:
    """The text normaliser of `text.normalize_text`, for strings inside UDFs."""
    out = re.sub(r"[ \t\r\f\v]+", " ", (value or "").replace("\xa0", " "))
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"\s*\n\s*", "\n", out)).strip()


class Node:
    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list[Node | str] = []

    def walk(self):
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(c for c in reversed(node.children) if isinstance(c, Node))

    def text(self, gap: str = " ") -> str:
        parts: list[str] = []
        stack: list[Node | str] = [self]
        while stack:
            x = stack.pop()
            if isinstance(x, str):
                if x.strip():
                    parts.append(x.strip())
            elif x.tag not in rules.DROP_TAGS:
                stack.extend(reversed(x.children))
        return squeeze(gap.join(parts))

    def identity(self) -> str:
        keys = ("id", "class", "property", "itemprop", "data-type", "data-title", "role", "aria-label")
        return " ".join([self.tag, *(self.attrs.get(k, "") for k in keys)]).lower()

    def find(self, *tags: str) -> list[Node]:
        return [n for n in self.walk() if n.tag in tags and n is not self]


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        closes = _CLOSES.get(tag, ())
        node = self.at
        while closes and node.parent is not None and node.tag not in ("div", "section", "article", "table", "ul", "ol", "body"):
            if node.tag in closes:
                self.at = node.parent
                break
            node = node.parent
        new = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(new)
        if tag not in VOID:
            self.at = new

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.at.children.append(Node(tag, {k: v or "" for k, v in attrs}, self.at))

    def handle_endtag(self, tag: str) -> None:
        node = self.at
        while node.parent is not None:
            if node.tag == tag:
                self.at = node.parent
                return
            node = node.parent

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)


def tree(page: str | None) -> Node:
    builder = _Builder()
    builder.feed(page or "")
    builder.close()
    return builder.root


def words(value: str) -> int:
    return len(re.findall(r"\w+", value))


def content_root(root: Node) -> Node:
    """The article or main element with the most words, the first of equals; else the whole page."""
    best, most = root, 0
    for tags in (("article",), ("main",), None):
        for n in root.walk():
            if (n.tag in tags) if tags else n.attrs.get("role") == "main":
                count = words(n.text())
                if count > most:
                    best, most = n, count
    return best


def is_noise(node: Node) -> bool:
    """Elements to leave out: by tag, hidden state, exact text, or an identity of few words."""
    if node.tag in rules.DROP_TAGS or node.tag in rules.DROP_ELEMENTS or "hidden" in node.attrs or node.attrs.get("aria-hidden") == "true":
        return True
    if re.fullmatch("h[1-6]", node.tag) or (node.tag == "a" and reference_anchor(node.attrs.get("href", ""), node)):
        return False
    text = node.text().lower()
    if text in rules.EXACT_NOISE or any(text.startswith(p) for p in rules.PREFIX_NOISE):
        return True
    named = " ".join(node.attrs.get(k, "") for k in ("id", "class", "role", "aria-label")).lower()
    return any(t in named for t in rules.NOISE_IDENTITIES) and words(text) <= 80


def reference_anchor(href: str, node: Node | None = None) -> bool:
    if node is not None and (node.attrs.get("role") == "doc-biblioref" or node.attrs.get("data-test") == "citation-ref"):
        return True
    return "#" in href and bool(re.search(r"(?:^|[-_/])(?:ref|bib|cite|cr)\b", href.lower().split("#", 1)[1]))


def prune(node: Node) -> Node:
    """Leave out noise, in place."""
    node.children = [c for c in node.children if isinstance(c, str) or not is_noise(c)]
    for c in node.children:
        if isinstance(c, Node):
            prune(c)
    return node


def container_score(node: Node) -> float:
    """Text length with bonuses for headings, paragraphs, figures and a body's identity, less for back matter's."""
    points = rules.CONTAINER_POINTS
    headings = len(node.find("h1", "h2", "h3", "h4", "h5", "h6"))
    parts = sum(1 for n in node.find("p", "div", "section", "article") if n.text())
    own = node.identity()
    bonus = float(points["body"]) if identity_class(own) == "body" else 0.0
    if any(t in own for t in rules.IDENTITY_TOKENS["references_or_back_matter"]):
        bonus += points["back_matter"]
    return len(node.text()) + points["heading"] * headings + points["part"] * parts + points["figure"] * len(node.find("figure", "table")) + bonus


def completeness(node: Node) -> int:
    """Whether a container has a title, an abstract and a body, and is an article or main element."""
    inside = [identity_class(n.identity()) for n in node.walk()]
    holds = {"title": node.tag == "h1" or bool(node.find("h1")), "abstract": "abstract" in inside, "body": "body" in inside, "article": node.tag == "article", "main": node.tag == "main"}
    return sum(points for what, points in rules.COMPLETENESS_POINTS.items() if holds[what])


def complete_ancestor(node: Node, highest: int = 8) -> Node:
    """The node or one of its next ancestors that is most complete, then scores highest; the inner one of equals."""
    best, key = node, (completeness(node), container_score(node))
    up = node.parent
    while up is not None and up.tag not in ("", "html") and highest:
        own = (completeness(up), container_score(up))
        if own > key:
            best, key = up, own
        up, highest = up.parent, highest - 1
    return best


def identity_class(identity: str) -> str:
    text = squeeze(identity).lower()
    return next((name for name, tokens in rules.IDENTITY_TOKENS.items() if any(t in text for t in tokens)), "")


def primary_language(found: list[dict], wanted: str = "en") -> list[dict]:
    """Of parallel abstracts the ones in the wanted language; all if none is."""
    own = [a for a in found if (a["language"] or "").lower().split("-")[0] == wanted]
    return own or found


def meta(root: Node) -> dict[str, list[str]]:
    found: dict[str, list[str]] = {}
    for n in root.find("meta"):
        name = (n.attrs.get("name") or n.attrs.get("property") or n.attrs.get("http-equiv") or "").lower()
        if name and n.attrs.get("content", "").strip():
            found.setdefault(name, []).append(squeeze(n.attrs["content"]))
    return found


def title(root: Node) -> str:
    for tags in (("h1",), ("title",)):
        for n in root.find(*tags):
            if n.text():
                return n.text()
        if tags == ("h1",):
            for value in meta(root).get("og:title", []):
                return value
    return ""


def metadata(root: Node) -> dict:
    """Bibliographic fields in order of the keys that may hold them."""
    m = meta(root)
    first = lambda *keys: next((v for k in keys for v in m.get(k, [])), "")
    page_title = next((n.text() for n in root.find("title")), "")
    canonical = next((n.attrs.get("href", "") for n in root.find("link") if n.attrs.get("rel", "").lower() == "canonical"), "")
    doi = first("citation_doi", "dc.identifier", "dc.identifier.doi", "prism.doi", "bepress_citation_doi")
    found = re.search(r"10\.\d{4,9}/[^\s\"'<>]+", doi, re.I)
    return {
        "title": first("citation_title", "dc.title", "og:title") or page_title,
        "doi": found[0].lower().rstrip(").,;") if found else "",
        "abstract": first("citation_abstract", "dc.description", "description", "og:description"),
        "journal": first("citation_journal_title", "prism.publicationname"),
        "published": first("citation_publication_date", "citation_date", "dc.date", "prism.publicationdate"),
        "authors": list(dict.fromkeys([*m.get("citation_author", []), *m.get("dc.creator", []), *json_authors(root)])),
        "pdf_url": first("citation_pdf_url"),
        "canonical": canonical or first("og:url", "citation_abstract_html_url"),
        "language": first("citation_language", "dc.language") or next((n.attrs.get("lang", "") for n in root.find("html")), ""),
    }


def balanced_json(text: str, start: int = 0) -> str:
    """The first brace-balanced object from a position on, aware of strings and escapes; empty if it never closes."""
    at = text.find("{", start)
    depth, quoted, escaped = 0, False, False
    for k in range(at, len(text)) if at >= 0 else ():
        c = text[k]
        if quoted:
            quoted, escaped = (c != '"' or escaped), (c == "\\" and not escaped)
        elif c == '"':
            quoted = True
        elif c in "{}":
            depth += 1 if c == "{" else -1
            if not depth:
                return text[at : k + 1]
    return ""


def json_scripts(root: Node, kind: str = r"json") -> list:
    out = []
    for n in root.find("script"):
        if re.search(kind, n.attrs.get("type", "") or n.attrs.get("id", "")):
            try:
                out.append(json.loads("".join(c for c in n.children if isinstance(c, str))))
            except ValueError:
                continue
    return out


def json_authors(root: Node) -> list[str]:
    names: list[str] = []
    stack = list(reversed(json_scripts(root, r"ld\+json")))
    while stack:
        x = stack.pop()
        if isinstance(x, list):
            stack.extend(reversed(x))
        elif isinstance(x, dict):
            if "Article" in str(x.get("@type", "")):
                authors = x.get("author") or []
                for a in authors if isinstance(authors, list) else [authors]:
                    name = a.get("name") if isinstance(a, dict) else a
                    if isinstance(name, str) and squeeze(name):
                        names.append(squeeze(name))
            stack.extend(v for v in x.values() if isinstance(v, (dict, list)))
    return list(dict.fromkeys(names))


def blocks(root: Node) -> list[dict]:
    """Headings, paragraphs, figures and tables in order, each with its text and the identities above it."""
    out: list[dict] = []

    def add(kind: str, node: Node, level: int = 0) -> None:
        text = node.text()
        if text:
            up, above = node, []
            while up is not None and up.tag:
                above.append(up.identity())
                up = up.parent
            out.append({"kind": kind, "level": level, "text": text, "identity": " ".join(above)})

    def visit(node: Node) -> None:
        for c in node.children:
            if not isinstance(c, Node) or c.tag in rules.DROP_TAGS:
                continue
            if re.fullmatch("h[1-6]", c.tag):
                add("heading", c, int(c.tag[1]))
            elif c.tag in ("figure", "table"):
                add(c.tag, c)
            elif c.tag in ("p", "li", "blockquote", "pre", "dd", "dt") and not any(n.tag in ("p", "li", "table", "figure") for n in c.walk() if n is not c):
                add("paragraph", c)
            else:
                visit(c)

    visit(root)
    return out


def inline(node: Node | str) -> str:
    """Inline Markdown of a node."""
    if isinstance(node, str):
        return re.sub(r"\s+", " ", node.replace("\xa0", " "))
    body = "".join(inline(c) for c in node.children)
    if node.tag in ("b", "strong") and body.strip():
        return f"**{body.strip()}**"
    if node.tag in ("i", "em") and body.strip():
        return f"*{body.strip()}*"
    if node.tag in ("sub", "sup") and body.strip():
        return f"<{node.tag}>{body.strip()}</{node.tag}>"
    if node.tag == "a" and body.strip() and node.attrs.get("href", "").startswith("http"):
        return f"[{body.strip()}]({node.attrs['href']})"
    if node.tag == "img" and node.attrs.get("src"):
        return f"![{node.attrs.get('alt', '')}]({node.attrs['src']})"
    return "\n" if node.tag == "br" else "" if node.tag in rules.DROP_TAGS else body


def table_rows(table: Node) -> list[list[dict]]:
    rows = []
    for tr in table.find("tr"):
        cells = [c for c in tr.children if isinstance(c, Node) and c.tag in ("td", "th")]
        number = lambda c, k: max(1, int(c.attrs[k])) if c.attrs.get(k, "").isdigit() else 1
        rows.append([{"text": squeeze(inline(c)).replace("\n", " "), "header": c.tag == "th", "rows": number(c, "rowspan"), "columns": number(c, "colspan")} for c in cells])
    return [r for r in rows if r]


def table_matrix(rows: list[list[dict]]) -> list[list[str]] | None:
    """Cells with their spans laid out on a grid; null if a place is left open."""
    taken: dict[tuple[int, int], str] = {}
    width = 0
    for y, row in enumerate(rows):
        x = 0
        for cell in row:
            while (y, x) in taken:
                x += 1
            taken |= {(y + a, x + b): cell["text"] for a in range(cell["rows"]) for b in range(cell["columns"])}
            x += cell["columns"]
            width = max(width, x)
    grid = [[taken.get((y, x)) for x in range(width)] for y in range(len(rows))]
    return grid if width and all(c is not None for r in grid for c in r) else None


def header_names(rows: list[list[str]]) -> list[str]:
    """Columns of stacked header rows joined by slashes, repeats next to each other once."""
    names = []
    for k, column in enumerate(zip(*rows)):
        parts: list[str] = []
        for c in column:
            if c and (not parts or parts[-1] != c):
                parts.append(c)
        names.append(" / ".join(parts) or f"Column {k + 1}")
    return names


def aligned_table(matrix: list[list[str]]) -> list[str]:
    """Pipe table with padded columns; the first row is the header."""
    cells = [[c.replace("|", "\\|") for c in r] for r in matrix]
    width = [max(3, *(len(r[k]) for r in cells)) for k in range(len(cells[0]))]
    line = lambda r: "| " + " | ".join(c.ljust(w) for c, w in zip(r, width)) + " |"
    return [line(cells[0]), "| " + " | ".join("-" * w for w in width) + " |", *(line(r) for r in cells[1:])]


def table_markdown(table: Node, label: str = "", caption: str = "") -> str:
    """A rectangular table as a pipe table, a ragged one as a list of its rows."""
    rows = table_rows(table)
    if not rows:
        return ""
    heads = next((k for k, r in enumerate(rows) if not all(c["header"] for c in r)), len(rows))
    grid = table_matrix(rows)
    top = [squeeze(f"**{label}** {caption}")] if squeeze(label + caption) else []
    if grid is None:
        listed = ["- " + "; ".join(c["text"] for c in r if c["text"]) for r in rows[heads:] or rows]
        return "\n".join([*top, *([""] if top else []), *listed])
    names = header_names(grid[:heads]) if heads else [f"Column {k + 1}" for k in range(len(grid[0]))]
    return "\n".join([*top, *([""] if top else []), *aligned_table([names, *grid[heads:]])])


def markdown(root: Node) -> str:
    """Markdown of the content: headings, paragraphs, lists, tables and figure captions."""
    out: list[str] = []

    def flush(held: list[str]) -> None:
        text = squeeze("".join(held))
        if text:
            out.append(text)
        held.clear()

    def visit(node: Node) -> None:
        held: list[str] = []
        for c in node.children:
            if isinstance(c, str):
                held.append(inline(c))
            elif c.tag in rules.DROP_TAGS:
                continue
            elif c.tag not in BLOCK:
                if any(n.tag in BLOCK for n in c.walk()):
                    flush(held)
                    visit(c)
                else:
                    held.append(inline(c))
            else:
                flush(held)
                if re.fullmatch("h[1-6]", c.tag):
                    if c.text():
                        out.append("#" * int(c.tag[1]) + " " + c.text())
                elif c.tag == "table":
                    out.append(table_markdown(c))
                elif c.tag == "li" and not any(n.tag in BLOCK for n in c.walk() if n is not c):
                    if c.text():
                        out.append("- " + squeeze(inline(c)))
                else:
                    visit(c)
        flush(held)

    visit(root)
    return "\n\n".join(x for x in out if x)


def references(root: Node) -> list[dict]:
    """Numbered references: items of lists in elements that are called references or bibliography."""
    found: list[dict] = []
    seen = set()
    for box in root.walk():
        if box.tag in ("ol", "ul", "section", "div") and re.search(r"reference|bibliograph", box.identity()):
            for k, item in enumerate(box.find("li"), 1):
                raw = item.text()
                years = re.findall(r"\b(?:19|20)\d{2}\b", raw)
                doi = re.search(r"10\.\d{4,9}/[^\s\"'<>]+", raw, re.I)
                row = {"label": item.attrs.get("value") or str(k), "raw": raw, "doi": doi[0].lower().rstrip(").,;") if doi else None, "year": years[-1] if years else None}
                if raw and (row["label"], raw) not in seen:
                    seen.add((row["label"], raw))
                    found.append(row)
    return found


def assets(root: Node, base: str) -> list[dict]:
    """Figures, formula images, tables and supplementary files with absolute URLs, each once."""
    out: list[dict] = []

    def add(kind: str, url: str, heading: str, caption: str) -> None:
        full = urljoin(base, url) if url else ""
        if not any(a["kind"] == kind and a["url"] == full and a["heading"] == heading for a in out):
            out.append({"kind": kind, "heading": heading, "caption": caption, "url": full})

    for n in root.walk():
        if n.tag == "figure":
            caption = next((c.text() for c in n.find("figcaption")), "")
            label = re.match(r"(?i)(fig(?:ure)?\.?\s*\d+[a-z]?)", caption)
            image = next(iter(n.find("img")), None)
            if image is not None:
                add("figure", image.attrs.get("data-src") or image.attrs.get("src", ""), label[1] if label else "Figure", caption)
        elif n.tag == "img" and re.search(r"math|formula|equation", n.identity()):
            add("formula", n.attrs.get("src", ""), "Formula", n.attrs.get("alt", ""))
        elif n.tag == "a" and re.search(r"(?i)supplement|supporting|suppl_file|/mediaobjects/|moesm", n.attrs.get("href", "") + " " + n.text()):
            if n.attrs.get("href", "").strip() and not n.attrs["href"].startswith("#"):
                add("supplementary", n.attrs["href"], n.text() or "Supplementary", "")
    return out


def pdf_links(root: Node, base: str) -> list[str]:
    urls = [metadata(root)["pdf_url"], *(n.attrs.get("href", "") for n in root.find("a", "link") if re.search(r"(?i)\.pdf(?:[?#]|$)|/pdf/|/pdfdirect/|/epdf/", n.attrs.get("href", "")))]
    return list(dict.fromkeys(urljoin(base, u) for u in urls if u))


def abstracts(root: Node) -> list[dict]:
    """Abstract elements in order with their language, equal texts once."""
    out: list[dict] = []
    for n in root.walk():
        if n.tag in ("section", "div") and re.search(r"(?:^|[\s_-])abstract", " ".join(n.attrs.get(k, "") for k in ("id", "class", "role")).lower()):
            head = next((h.text() for h in n.find("h1", "h2", "h3", "h4")), "Abstract")
            text = squeeze(" ".join(p.text() for p in n.find("p"))) or n.text()
            if text and not any(x["text"] == text for x in out):
                out.append({"heading": head, "text": text, "language": n.attrs.get("lang") or n.attrs.get("xml:lang") or None})
    return out


def page_facts(page: str | None, base: str | None) -> dict:
    root = tree(page)
    body = content_root(root)
    about = metadata(root)
    return {
        "title": title(root),
        **{f"meta_{k}": v for k, v in about.items()},
        "references": references(root),
        "assets": assets(body, base or ""),
        "pdf_urls": pdf_links(root, base or ""),
        "abstracts": abstracts(root),
        "blocks": blocks(prune(body)),
        "markdown": markdown(body),
    }


PAGE = (
    "title string, meta_title string, meta_doi string, meta_abstract string, meta_journal string, meta_published string, "
    "meta_authors array<string>, meta_pdf_url string, meta_canonical string, meta_language string, "
    "references array<struct<label:string,raw:string,doi:string,year:string>>, "
    "assets array<struct<kind:string,heading:string,caption:string,url:string>>, pdf_urls array<string>, "
    "abstracts array<struct<heading:string,text:string,language:string>>, "
    "blocks array<struct<kind:string,level:int,text:string,identity:string>>, markdown string"
)


@arrow_udf(PAGE)
def parse_page(pages: pd.Series, urls: pd.Series) -> pd.DataFrame:
    """All facts of pages: html and base URL."""
    names = [x.split()[0] for x in re.split(r", (?![^<]*>)", PAGE)]
    facts = [page_facts(p, u) for p, u in zip(pages, urls)]
    return pd.DataFrame({n: [f[n] for f in facts] for n in names}, columns=names)


@arrow_udf("string")
def unescape(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else entities.unescape(v))


def _normalize_markdown(value: str | None) -> str:
    lines, fenced, blank = [], False, 0
    for raw in (value or "").replace("\r\n", "\n").replace("\r", "\n").replace("\xa0", " ").split("\n"):
        line = raw.rstrip()
        if re.match(r"\s*(```|~~~)", line):
            lines.append(line.strip())
            fenced, blank = not fenced, 0
            continue
        if not fenced and not re.match(r"\s*([|>#-]|\d+\.)", line):
            line = re.sub(r"[ \t\f\v]+", " ", line).strip()
        if line:
            lines.append(line)
            blank = 0
        else:
            if fenced or blank < 2:
                lines.append("")
            blank += 1
    text = "\n".join(lines).strip()
    return re.sub(r"(?m)^\$\$\n+(.*?)\n+\$\$$", lambda m: "$$\n" + m[1].strip("\n") + "\n$$", text, flags=re.S)


@arrow_udf("string")
def normalize_markdown(values: pd.Series) -> pd.Series:
    """Markdown lines with the state of code fences and display formulas kept."""
    return values.map(_normalize_markdown)


def page_title(page: Column) -> Column:
    """The title element's text by a native expression; empty without one."""
    inner = F.regexp_extract(F.coalesce(page, F.lit("")), "(?is)<title[^>]*>(.*?)</title>", 1)
    return F.regexp_replace(F.regexp_replace(inner, "\\s+", " "), "^ | $", "")


def visible_text(page: Column) -> Column:
    """A page's text by native expressions: comments and scripts, navigation and asides go, tags become spaces."""
    out = F.regexp_replace(F.coalesce(page, F.lit("")), "(?s)<!--.*?-->", " ")
    for tag in ("script", "style", "nav", "footer", "aside"):
        out = F.regexp_replace(out, f"(?is)<{tag}[^>]*>.*?</{tag}>", " ")
    out = F.regexp_replace(out, "<[^>]+>", " ")
    return F.regexp_replace(F.regexp_replace(out, "\\s+", " "), "^ | $", "")
