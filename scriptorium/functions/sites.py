"""Publishers' pages: containers and noise by site rules, with the few kinds of CSS selectors that the rules use."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd

from .. import rules
from . import arrow_udf
from .html import Node, container_score, markdown, squeeze, tree

_SIMPLE = re.compile(r"(?P<tag>^[a-z][a-z0-9]*)|\.(?P<name>[\w-]+)|#(?P<id>[\w-]+)|\[(?P<key>[\w-]+)='(?P<value>[^']*)'\]")


@lru_cache(maxsize=64)
def site_rule(publisher: str | None) -> dict[str, tuple[str, ...]]:
    """The general rules with the publisher's own behind them, each value once; its noise profile replaces the general one."""
    general, own = rules.SITE_RULES[""], rules.SITE_RULES.get(squeeze(publisher).lower(), {})
    out = {k: tuple(dict.fromkeys((*v, *own.get(k, ())))) for k, v in general.items()}
    return out | {"noise": own.get("noise", general["noise"])}


@lru_cache(maxsize=512)
def _parts(selector: str) -> tuple[tuple[dict[str, str], ...], ...]:
    """A selector's steps from the outermost to the element itself, each as its conditions."""
    return tuple(tuple({k: v for k, v in m.groupdict().items() if v is not None} for m in _SIMPLE.finditer(step)) for step in selector.split())


def _fits(node: Node, step: tuple[dict[str, str], ...]) -> bool:
    for c in step:
        ok = (
            node.tag == c["tag"] if "tag" in c
            else c["name"] in node.attrs.get("class", "").split() if "name" in c
            else node.attrs.get("id") == c["id"] if "id" in c
            else node.attrs.get(c["key"]) == c["value"]
        )
        if not ok:
            return False
    return True


def matches(node: Node, selector: str) -> bool:
    """Whether the selector (tags, classes, ids, equal attributes, descendants) names the node."""
    *outer, own = _parts(selector)
    if not _fits(node, own):
        return False
    up = node.parent
    while outer and up is not None:
        if _fits(up, outer[-1]):
            outer.pop()
        up = up.parent
    return not outer


def best_container(root: Node, publisher: str | None) -> Node:
    """Of the elements that the publisher's selectors name, in their order, the first with the highest score; else the page."""
    nodes = [n for n in root.walk() if n is not root]
    found = dict.fromkeys(n for s in site_rule(publisher)["candidates"] for n in nodes if matches(n, s))
    return max(found, key=container_score, default=root)


def is_dropped(node: Node, publisher: str | None) -> bool:
    """Whether the publisher's rules leave the node out: by selector, by a word in its identity, or by its whole text."""
    rule = site_rule(publisher)
    own = node.identity()
    return any(k in own for k in rule["keywords"]) or any(matches(node, s) for s in rule["remove"]) or node.text() in rule["texts"]


def clean(node: Node, publisher: str | None) -> Node:
    """Leave out in place what the publisher's rules name."""
    node.children = [c for c in node.children if isinstance(c, str) or not is_dropped(c, publisher)]
    for c in node.children:
        if isinstance(c, Node):
            clean(c, publisher)
    return node


@arrow_udf("container string, markdown string")
def site_page(pages: pd.Series, publishers: pd.Series) -> pd.DataFrame:
    """The container that a publisher's rules choose, and its Markdown without what they leave out."""

    def one(page: str | None, publisher: str | None) -> tuple[str, str]:
        body = best_container(tree(page), publisher)
        return body.tag, markdown(clean(body, publisher))

    return pd.DataFrame([one(p, s) for p, s in zip(pages, publishers)], columns=["container", "markdown"])
