"""Pages: content by a cascade of strategies, metadata, dates, type, images and links.

One pass of the standard HTML parser over Arrow batches gives, for each page, the texts that the strategies may take,
the meta tags, and what the type depends on; all that follows are column expressions. Metadata, images and links are
read from the whole page, and a container inside one that is taken is not taken again.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions import scores
from siltstone.functions import text as tx

# Classes of content containers, fields of structured data, tags of link previews.
CONTENT_CLASSES = {"main-content", "content", "post-content", "entry-content", "article-content"}
JSON_TEXT = ("text", "description", "articleBody", "content")
OPEN_GRAPH = ("og:title", "og:description", "og:site_name", "og:type", "og:url")
TWITTER = ("twitter:title", "twitter:description", "twitter:card")
DATE_METAS = ("article:published_time", "publication_date", "publish_date", "date", "pubdate")
# End of the fixed values.

VOID = frozenset({"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"})
BLOCK = frozenset({"p", "div", "article", "main", "section", "header", "footer", "nav", "aside", "ul", "ol", "li", "h1", "h2", "h3", "h4", "h5", "h6", "table", "tr", "td", "th", "pre", "blockquote", "br"})
LEAST = 100

PARSED = (
    "primary string, json_text string, json_date string, generic string, minimal string, title string, meta map<string,string>, time_date string, "
    "has_article boolean, has_product boolean, has_docs boolean, images array<struct<url:string,alt:string>>, links array<struct<url:string,text:string,kind:string>>"
)


class PageParser(HTMLParser):
    """Collects texts by the container they stand in. Tags that are left open end with the one around them."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, str]] = []
        self.texts: dict[str, list[str]] = {k: [] for k in ("taken", "all", "chrome")}
        self.paragraphs: list[str] = []
        self.paragraph: list[str] | None = None
        self.title, self.meta, self.json, self.time = None, {}, [], None
        self.images, self.links, self.link = [], [], None
        self.article = self.product = self.docs = False

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        a = {k: v or "" for k, v in attrs}
        classes = set(a.get("class", "").split())
        role = ""
        if tag in ("script", "style"):
            role = "json" if a.get("type", "").lower() == "application/ld+json" else "skip"
        elif tag in ("main", "article") or a.get("role") == "main" or classes & CONTENT_CLASSES:
            role = "taken"
        elif tag in ("nav", "header", "footer", "aside"):
            role = "chrome"
        if tag == "meta":
            name = (a.get("property") or a.get("name") or "").lower()
            if name and "content" in a:
                self.meta.setdefault(name, a["content"])
                self.product |= name.startswith("product:price")
        elif tag == "img" and a.get("src"):
            self.images.append((a["src"], a.get("alt", "")))
        elif tag == "a" and a.get("href"):
            self.link = [a["href"], []]
        elif tag == "time":
            self.article = True
            self.time = self.time or a.get("datetime") or None
        self.article |= tag == "article"
        self.docs |= (tag == "nav" and "sidebar" in a.get("class", "")) or (tag == "div" and "toc" in a.get("class", ""))
        if tag in BLOCK:
            self.break_line()
        if tag == "p":
            self.end_paragraph()
            self.paragraph = []
        if tag == "br" or tag in VOID:
            return
        self.stack.append((tag, role))

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag == "p":
            self.end_paragraph()
        if tag in BLOCK:
            self.break_line()
        if tag == "a" and self.link:
            href, text = self.link
            if label := " ".join("".join(text).split()):
                self.links.append((href, label))
            self.link = None
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                del self.stack[i:]
                break

    def handle_data(self, data: str) -> None:
        roles = [r for _, r in self.stack]
        if "json" in roles:
            self.json.append(data)
            return
        if "skip" in roles:
            return
        if any(t == "title" for t, _ in self.stack):
            self.title = (self.title or "") + data
            return
        if self.link:
            self.link[1].append(data)
        if self.paragraph is not None:
            self.paragraph.append(data)
        self.texts["all"].append(data)
        if "taken" in roles:
            self.texts["taken"].append(data)
        if "chrome" in roles:
            self.texts["chrome"].append(data)

    def break_line(self) -> None:
        for parts in self.texts.values():
            parts.append("\n")

    def end_paragraph(self) -> None:
        if self.paragraph is not None:
            text = " ".join("".join(self.paragraph).split())
            if len(text) > 50:
                self.paragraphs.append(text)
        self.paragraph = None

    def structured(self, names: tuple[str, ...]) -> str | None:
        """The first of some fields in the page's JSON-LD, looked for in every object of it."""
        for raw in self.json:
            try:
                todo = [json.loads(raw)]
            except ValueError:
                continue
            while todo:
                x = todo.pop(0)
                if isinstance(x, list):
                    todo = x + todo
                elif isinstance(x, dict):
                    for n in names:
                        if isinstance(x.get(n), str) and x[n].strip():
                            return x[n]
                    todo = [v for v in x.values() if isinstance(v, dict | list)] + todo
        return None


def lines_of(parts: list[str]) -> str:
    """Texts with single spaces, a blank line between blocks."""
    lines = (" ".join(x.split()) for x in "".join(parts).split("\n"))
    return re.sub(r"\n{2,}", "\n\n", "\n\n".join(x for x in lines if x))


def parse(url: str | None, html: str | None) -> dict:
    """The fields of PARSED for one page; null and broken pages give empty ones."""
    p, url = PageParser(), url or ""
    try:
        p.feed(html or "")
        p.close()
    except (AssertionError, ValueError):
        pass  # what was read before the broken mark-up stays
    p.end_paragraph()

    def absolute(link: str) -> str:
        try:
            return urljoin(url, link)
        except ValueError:
            return link

    def host(link: str) -> str:
        try:
            return urlsplit(link).netloc.lower()
        except ValueError:
            return ""

    chrome = lines_of(p.texts["chrome"])
    whole = lines_of(p.texts["all"])
    # short chrome is left out of the generic text
    generic = whole if len(chrome) >= LEAST or not chrome else "\n\n".join(x for x in whole.split("\n\n") if x not in set(chrome.split("\n\n")))
    links = [(absolute(h), t) for h, t in p.links]
    return {
        "primary": lines_of(p.texts["taken"]) or "\n\n".join(p.paragraphs), "json_text": p.structured(JSON_TEXT), "json_date": p.structured(("datePublished",)), "generic": generic, "minimal": whole[:1000],
        "title": " ".join(p.title.split()) if p.title else None, "meta": p.meta, "time_date": p.time, "has_article": p.article, "has_product": p.product, "has_docs": p.docs,
        "images": [{"url": absolute(s), "alt": alt} for s, alt in p.images], "links": [{"url": h, "text": t, "kind": "internal" if host(h) == host(url) else "external"} for h, t in links],
    }


#: Pages whose fields are held at once.
TOGETHER = 100


def parsed_frames(batches: Iterator[pd.DataFrame], keep: list[str], url: str, html: str) -> Iterator[pd.DataFrame]:
    """The fields of PARSED next to the columns of `keep`, of TOGETHER pages a frame at most."""
    names = [f.split()[0] for f in PARSED.split(", ") if " " in f]
    for whole in batches:
        for at in range(0, len(whole), TOGETHER):
            b = whole.iloc[at : at + TOGETHER]
            rows = pd.DataFrame([parse(u, h) for u, h in zip(b[url], b[html], strict=True)], columns=names)
            yield pd.concat([b[keep].reset_index(drop=True), rows], axis=1)


def parsed(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """`pages` without the html, with the fields of PARSED."""
    keep = [c for c in pages.columns if c != html]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema.fields if f.name != html)
    return pages.mapInPandas(lambda batches: parsed_frames(batches, keep, url, html), f"{kinds}, {PARSED}")


def meta(*names: str) -> Column:
    """The first of some meta tags that is there and not empty."""
    return F.coalesce(*[F.nullif(F.try_element_at("meta", F.lit(n)), F.lit("")) for n in names])


def cascade() -> dict[str, Column]:
    """H1: the first strategy with LEAST characters; the last one in any case."""
    previews = F.coalesce(F.nullif(F.concat_ws("\n\n", *[meta(n) for n in OPEN_GRAPH]), F.lit("")), F.concat_ws("\n\n", *[meta(n) for n in TWITTER]))
    steps = (("primary", F.col("primary")), ("json_ld", F.col("json_text")), ("open_graph", previews), ("generic", F.col("generic")))
    text, method = F.col("minimal"), F.lit("minimal")
    for name, c in reversed(steps):
        enough = F.length(F.trim(F.coalesce(c, F.lit("")))) >= LEAST
        text, method = F.when(enough, c).otherwise(text), F.when(enough, name).otherwise(method)
    return {"content": text, "method": method}


def extracted(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Content, method, metadata, type, date, quality, images and links of each page."""
    out = parsed(pages, url, html).withColumns(cascade())
    keywords = F.filter(F.transform(F.split(F.coalesce(meta("keywords"), F.lit("")), ","), lambda x: F.trim(x)), lambda k: k != "")
    kind = F.when(F.col("has_article"), "article").when(F.col("has_product"), "product").when(F.col("has_docs"), "documentation").otherwise("general")
    date = F.coalesce(*[F.try_to_timestamp(c) for c in (meta(*DATE_METAS), F.col("time_date"), F.col("json_date"))])
    out = out.withColumns({
        "content": tx.clean_extracted(F.col("content")), "fallback_used": F.col("method") != "primary", "title": F.coalesce(F.nullif("title", F.lit("")), meta("og:title")),
        "description": meta("description", "og:description"), "keywords": keywords, "author": meta("author", "article:author"), "content_type": kind, "publish_date": date,
    })
    out = out.withColumn("content_quality_score", scores.extraction_quality(F.col("content"), F.col("title"), F.col("description"), F.col("author"), F.col("publish_date")))
    return out.drop("primary", "json_text", "json_date", "generic", "minimal", "meta", "time_date", "has_article", "has_product", "has_docs")
