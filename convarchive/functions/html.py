"""HTML to Markdown and HTML exports, parsed with the standard library in vectorised functions."""

from __future__ import annotations

import json
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

SKIPPED = {"script", "style", "nav", "iframe", "form", "button", "head", "svg"}
#: What a head may hold; any other tag begins the body.
HEAD_ONLY = {"title", "meta", "link", "base", "script", "style", "noscript", "template", "head", "html"}
HEADINGS = {f"h{i}": "#" * i + " " for i in range(1, 7)}
BLOCKS = {"p", "div", "article", "section", "ul", "ol", "li", "blockquote", "figure", "figcaption", "br", "hr", "main", "table", "tr", *HEADINGS}


class _Markdown(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[str] = []
        self.line = ""
        self.prefix = ""
        self.skip = 0
        self.links: list[str] = []
        self.quotes = 0
        self.open: list[str] = []

    def close_block(self) -> None:
        text = " ".join(self.line.split())
        if text:
            self.blocks.append("> " * self.quotes + self.prefix + text)
        self.line, self.prefix = "", ""

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a = dict(attrs)
        if self.open == ["head"] and tag not in HEAD_ONLY:
            self.open = []  # its end tag may be left out
            self.skip = 0
        if tag in SKIPPED:
            self.skip += 1
            self.open.append(tag)
        elif self.skip:
            return
        elif tag in BLOCKS:
            self.close_block()
            self.prefix = HEADINGS.get(tag, "- " if tag == "li" else "*" if tag == "figcaption" else "")
            self.quotes += tag == "blockquote"
            if tag == "hr":
                self.blocks.append("---")
        elif tag == "img" and a.get("src"):
            self.line += f"![{a.get('alt') or ''}]({a['src']})"
        elif tag == "a":
            self.links.append(a.get("href") or "")
            self.line += "["
        elif tag in ("b", "strong"):
            self.line += "**"
        elif tag in ("i", "em"):
            self.line += "*"

    def handle_endtag(self, tag: str) -> None:
        if tag in SKIPPED:
            if tag in self.open:
                del self.open[len(self.open) - 1 - self.open[::-1].index(tag) :]
            self.skip = len(self.open)
        elif self.skip:
            return
        elif tag in BLOCKS:
            if tag == "figcaption" and self.line.strip():
                self.line = self.line.rstrip() + "*"
            self.close_block()
            self.quotes = max(0, self.quotes - (tag == "blockquote"))
        elif tag == "a" and self.links:
            self.line += f"]({self.links.pop()})"
        elif tag in ("b", "strong"):
            self.line += "**"
        elif tag in ("i", "em"):
            self.line += "*"

    def handle_data(self, data: str) -> None:
        if not self.skip:
            self.line += data


def markdown_of(html: str | None) -> str | None:
    if html is None:
        return None
    parser = _Markdown()
    parser.feed(html)
    parser.close()
    parser.close_block()
    return "\n\n".join(parser.blocks)


@F.pandas_udf(T.StringType())
def html_to_markdown(html: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Headings, lists, quotes, figures with captions, links and emphasis; widgets are dropped."""
    for s in html:
        yield s.map(markdown_of, na_action="ignore")


def export_of(html: str | None) -> list[dict]:
    """Messages of an HTML export: its embedded JSON if there is some, else sections under h2 and h3, else all paragraphs, with alternating roles."""
    html = html or ""
    at = html.find('{"conversations"')
    if at >= 0:
        try:
            found, _ = json.JSONDecoder().raw_decode(html[at:])
            return [{"title": c.get("title"), "role": m.get("role"), "content": m.get("content")} for c in found["conversations"] for m in c.get("messages") or []]
        except (ValueError, AttributeError, TypeError):
            pass
    sections: list[list[str]] = []
    blocks = [b for b in (markdown_of(html) or "").split("\n\n") if b]
    if not any(b.startswith(("## ", "### ")) for b in blocks):
        return [{"title": None, "role": ("user", "assistant")[i % 2], "content": b} for i, b in enumerate(blocks)]
    for block in blocks:
        if block.startswith(("## ", "### ")):
            sections.append([block.lstrip("# "), ""])
        elif sections:
            sections[-1][1] = (sections[-1][1] + "\n\n" + block).strip()
    return [{"title": t, "role": ("user", "assistant")[i % 2], "content": c} for i, (t, c) in enumerate(sections)]


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("title", "role", "content")])))
def parse_html_export(html: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in html:
        yield s.map(export_of)
