"""XML articles and formulas, on the standard ElementTree inside Arrow UDFs."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET

import pandas as pd
from pyspark.sql import functions as F

from . import arrow_udf
from .html import squeeze

ARTICLE = (
    "title string, abstracts array<struct<heading:string,text:string,language:string>>, "
    "sections array<struct<heading:string,level:int,text:string>>, references array<struct<label:string,raw:string,doi:string,year:string>>, "
    "figures array<struct<label:string,caption:string,locator:string>>, formulas array<string>"
)
_OPERATORS = {"×": "\\times", "·": "\\cdot", "≤": "\\leq", "≥": "\\geq", "≠": "\\neq", "±": "\\pm", "→": "\\to", "∞": "\\infty", "∑": "\\sum", "∫": "\\int", "∂": "\\partial", "α": "\\alpha", "β": "\\beta", "γ": "\\gamma", "δ": "\\delta", "λ": "\\lambda", "μ": "\\mu", "π": "\\pi", "σ": "\\sigma", "θ": "\\theta"}


def name(e: ET.Element) -> str:
    return e.tag.rsplit("}", 1)[-1] if isinstance(e.tag, str) else ""


def content(e: ET.Element) -> str:
    return squeeze(re.sub(r"\s+", " ", " ".join(e.itertext())))


def mathml(e: ET.Element) -> str:
    """LaTeX of a MathML element, children first."""
    kids = [mathml(c) for c in e]
    tag = name(e)
    text = squeeze(e.text)
    if tag in ("mi", "mn", "mo", "mtext", "ms"):
        if tag == "mtext":
            return f"\\text{{{text}}}" if text else ""
        return _OPERATORS.get(text, text) + (" " if text in _OPERATORS else "")
    two, three = (kids + ["", "", ""])[:2], (kids + ["", "", ""])[:3]
    forms = {
        "mfrac": "\\frac{{{0}}}{{{1}}}", "msup": "{{{0}}}^{{{1}}}", "msub": "{{{0}}}_{{{1}}}", "mroot": "\\sqrt[{1}]{{{0}}}",
        "mover": "\\overset{{{1}}}{{{0}}}", "munder": "\\underset{{{1}}}{{{0}}}",
    }
    if tag in forms:
        return forms[tag].format(*two)
    if tag in ("msubsup", "munderover"):
        return "{{{0}}}_{{{1}}}^{{{2}}}".format(*three)
    if tag == "msqrt":
        return f"\\sqrt{{{''.join(kids)}}}"
    if tag == "mfenced":
        return "\\left" + e.get("open", "(") + ",".join(kids) + "\\right" + e.get("close", ")")
    if tag == "mtable":
        return "\\begin{matrix}" + " \\\\ ".join(kids) + "\\end{matrix}"
    if tag == "mtr":
        return " & ".join(kids)
    return "".join(kids)


def cals_matrix(table: ET.Element) -> tuple[list[list[str]], bool]:
    """Rows of a CALS table with named and vertical spans filled in, and whether a span was; no rows where cells collide."""
    names = [e.get("colname", "") for e in table.iter() if name(e) == "colspec"]
    taken: dict[tuple[int, int], str] = {}
    spanned, y, width = False, 0, len(names)
    for row in (e for e in table.iter() if name(e) == "row"):
        x = 0
        for entry in (e for e in row if name(e) == "entry"):
            while (y, x) in taken:
                x += 1
            first, last = entry.get("namest") or entry.get("colname"), entry.get("nameend")
            if first in names:
                x = names.index(first)
            wide = names.index(last) - x + 1 if last in names else 1
            tall = int(entry.get("morerows", "0") or 0) + 1
            cells = [(y + a, x + b) for a in range(tall) for b in range(max(1, wide))]
            if any(c in taken for c in cells):
                return [], spanned
            spanned |= len(cells) > 1
            taken |= dict.fromkeys(cells, content(entry))
            x += max(1, wide)
            width = max(width, x)
        y += 1
    return [[taken.get((r, c), "") for c in range(width)] for r in range(y)], spanned


@arrow_udf("markdown string, lossy boolean")
def cals_table(values: pd.Series) -> pd.DataFrame:
    """Pipe tables of CALS tables; empty where spans collide, lossy where cells were merged."""
    from .html import aligned_table

    def one(raw: str | None) -> tuple[str, bool]:
        try:
            rows, spanned = cals_matrix(ET.fromstring(raw or ""))
        except (ET.ParseError, ValueError):
            return "", False
        return ("\n".join(aligned_table(rows)) if rows and rows[0] else ""), spanned

    found = [one(v) for v in values]
    return pd.DataFrame({"markdown": [m for m, _ in found], "lossy": [s for _, s in found]})


def article_facts(raw: str | None) -> dict:
    out: dict = {"title": None, "abstracts": [], "sections": [], "references": [], "figures": [], "formulas": []}
    try:
        root = ET.fromstring(raw or "")
    except ET.ParseError:
        return out
    lang = "{http://www.w3.org/XML/1998/namespace}lang"

    def sections(e: ET.Element, level: int) -> None:
        for c in e:
            tag = name(c)
            if tag in ("section", "sec"):
                head = next((content(x) for x in c if name(x) in ("section-title", "title")), "")
                own = [content(x) for x in c if name(x) in ("para", "p", "simple-para")]
                out["sections"].append({"heading": head, "level": level, "text": "\n\n".join(t for t in own if t)})
                sections(c, level + 1)
            elif tag not in ("abstract", "tail", "back", "ref-list"):
                sections(c, level)

    for e in root.iter():
        tag = name(e)
        if tag in ("article-title", "title") and out["title"] is None:
            out["title"] = content(e)
        elif tag == "abstract":
            head = next((content(x) for x in e.iter() if name(x) in ("section-title", "title")), "Abstract")
            text = squeeze(" ".join(content(x) for x in e.iter() if name(x) in ("simple-para", "para", "p"))) or content(e)
            if text and not any(a["text"] == text for a in out["abstracts"]):
                out["abstracts"].append({"heading": head, "text": text, "language": e.get(lang)})
        elif tag in ("bib-reference", "ref"):
            text = content(e)
            years = re.findall(r"\b(?:19|20)\d{2}\b", text)
            doi = re.search(r"10\.\d{4,9}/[^\s\"'<>]+", text, re.I)
            label = next((content(x) for x in e.iter() if name(x) == "label"), str(len(out["references"]) + 1))
            out["references"].append({"label": label, "raw": text, "doi": doi[0].lower().rstrip(").,;") if doi else None, "year": years[-1] if years else None})
        elif tag in ("figure", "fig"):
            part = lambda *names: next((content(x) for x in e.iter() if name(x) in names), "")
            link = next((v for x in e.iter() if name(x) in ("link", "graphic") for k, v in x.attrib.items() if k.endswith("href") or k == "locator"), "")
            out["figures"].append({"label": part("label"), "caption": part("caption"), "locator": link})
        elif tag == "math":
            out["formulas"].append(squeeze(mathml(e)))
    sections(root, 2)
    return out


@arrow_udf(ARTICLE)
def parse_article(values: pd.Series) -> pd.DataFrame:
    """Title, abstracts, sections, references, figures and formulas of XML articles; a broken one gives none."""
    names = ["title", "abstracts", "sections", "references", "figures", "formulas"]
    facts = [article_facts(v) for v in values]
    return pd.DataFrame({n: [f[n] for f in facts] for n in names}, columns=names)


@arrow_udf("string")
def mathml_to_latex(values: pd.Series) -> pd.Series:
    def one(v: str | None) -> str | None:
        try:
            return None if v is None else squeeze(mathml(ET.fromstring(v)))
        except ET.ParseError:
            return None

    return values.map(one)
