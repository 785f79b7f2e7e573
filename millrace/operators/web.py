"""Stored pages: links, metadata, sections, importance and sessions."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Address endings that aren't pages.
ASSETS = r"(?i)\.(png|jpg|jpeg|gif|svg|webp|ico|css|js|ts|woff|woff2|ttf|eot|pdf|zip|tar|gz|mp4|mp3|wav)$"
_HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)"


def hrefs(pages: DataFrame) -> DataFrame:
    """(page_id, url, pos, href) in page order."""
    found = F.regexp_extract_all("html", F.lit(r'(?i)<a\b[^>]*?\bhref="([^"]*)"'), 1)
    return pages.select("page_id", "url", F.posexplode(found).alias("pos", "href"))


def resolve_links(pages: DataFrame) -> DataFrame:
    """(page_id, pos, link): absolute links without fragment and closing slash, the first of each."""
    root = F.regexp_extract("url", r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    folder = F.regexp_extract("url", r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(?:/[^?#]*/)?)", 1)
    h = F.col("href")
    full = F.when(h.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), h).when(h.startswith("//"), F.concat(F.regexp_extract("url", "^([A-Za-z]+:)", 1), h)).when(h.startswith("/"), F.concat(root, h))
    full = full.otherwise(F.concat(F.regexp_replace(folder, "/$", ""), F.lit("/"), h))
    rows = hrefs(pages).withColumn("link", F.regexp_replace(F.regexp_replace(full, "#.*$", ""), "(?<=.)/$", ""))
    return rows.groupBy("page_id", "link").agg(F.min("pos").alias("pos"))


def keep_links(links: DataFrame, host: Column, pattern: str | None = None, link: str = "link") -> DataFrame:
    """Links on a host that aren't assets, anchors, mail or telephone addresses, with a path that fits."""
    c = F.col(link)
    ok = (F.regexp_extract(link, _HOST, 1) == host) & ~F.regexp_replace(c, "[?#].*$", "").rlike(ASSETS) & ~c.rlike("^(?:#|mailto:|tel:)")
    return links.filter(ok & F.regexp_extract(link, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1).rlike(pattern) if pattern else ok)


def minify_html(column: str) -> Column:
    text = F.col(column)
    for tag in ("script", "style", "svg", "noscript", "iframe"):
        text = F.regexp_replace(text, rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>", "")
    text = F.regexp_replace(text, r"(?i)<(?:meta|link|path)\b[^>]*>", "")
    return F.replace(F.regexp_replace(text, r"\s+", " "), F.lit("> <"), F.lit("><"))


def page_metadata(pages: DataFrame) -> DataFrame:
    pick = lambda p: F.nullif(F.trim(F.regexp_extract("html", p, 1)), F.lit(""))
    return pages.select(
        "page_id", pick(r"(?is)<title[^>]*>(.*?)</title>").alias("title"), pick(r'(?i)<meta\s+(?:property|name)="og:title"\s+content="([^"]*)"').alias("og_title"),
        pick(r'(?i)<meta\s+(?:property="og:description"|name="description")\s+content="([^"]*)"').alias("description"), pick(r'(?i)<html[^>]*\blang="([^"]*)"').alias("lang"),
        pick(r'(?i)<link\s+rel="canonical"\s+href="([^"]*)"').alias("canonical"),
    )


# Elements by kind, and how those without a text of their own are shown below.
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
#: Elements whose text is one section, and its kind.
_WHOLE = {**{f"h{k}": "heading" for k in range(1, 7)}, **dict.fromkeys(("summary", "legend", "figcaption"), "heading"), "p": "paragraph", "blockquote": "paragraph", "pre": "code", "table": "table", "ul": "list", "ol": "list", "dl": "list", "a": "link", "button": "paragraph", "svg": "paragraph"}
#: A new block ends a paragraph that wasn't closed.
_BLOCKS = set(_WHOLE) - {"a", "button", "svg"} | {"div", "section", "article", "main", "form", "hr", "fieldset", "details", "figure", "address"}
_NEVER = {"script", "style", "noscript", "canvas", "map", "template", "object", "embed", "math"}
_AROUND = {"nav", "footer", "header", "aside"}


def _hidden(tag: str, a: dict[str, str | None]) -> bool:
    style = {k.strip(): v.strip() for k, _, v in (d.partition(":") for d in (a.get("style") or "").split(";"))}
    shown = style.get("display") != "none" and style.get("visibility") != "hidden" and style.get("opacity") != "0"
    return not shown or a.get("aria-hidden") == "true" or "hidden" in a or (tag == "dialog" and "open" not in a)


class _Sections(HTMLParser):
    """Sections of a page in order: (kind, depth of a heading, text)."""

    def __init__(self, around: bool = False):
        super().__init__()
        self.never = _NEVER if around else _NEVER | _AROUND
        self.out: list[tuple[str, int | None, str]] = []
        self.stack: list[str] = []
        self.skip_at = self.hold_at = None  # heights of the stack where a skipped part and a section begin
        self.held: tuple[str, str, dict] = ("", "", {})
        self.text: list[str] = []
        self.title: list[str] | None = None

    def _put(self, kind: str, text: str, depth: int | None = None) -> None:
        if text:
            self.out.append((kind, depth, text))

    def _settle(self) -> None:
        """Ends the open section, or stray text: that counts if it is longer than a few words."""
        text = " ".join("".join(self.text).split())
        tag, kind, a = self.held
        self.text = []
        if self.hold_at is None:
            self._put("paragraph", text if len(text) > 20 else "")
            return
        self.hold_at = None
        if tag in ("summary", "legend", "figcaption"):
            text = text and f"[{tag}: {text}]"
        elif tag == "a":
            text = text and f"{text} ({a.get('href') or ''})"
        elif tag == "button" or a.get("role") == "button":
            text = text and f"[Button: {text}]"
        elif a.get("role") == "link":
            text = text and f"{text} (link role)"
        elif tag == "svg":
            label = a.get("aria-label") or " ".join("".join(self.title or ()).split())
            text, self.title = label and f"[Icon: {label}]", None
        self._put(kind, text, int(tag[1]) if kind == "heading" and tag[0] == "h" else None)

    def _alone(self, tag: str, a: dict[str, str | None]) -> None:
        """Elements that are a section by what their attributes say."""
        of = lambda name: a.get(name) or ""
        if tag == "hr":
            self._put("paragraph", "---")
        elif tag == "img":
            label = of("alt") or of("aria-label")
            self._put("paragraph", label and f"[Image: {label}]")
        elif tag in ("input", "textarea", "select") and of("type") != "hidden":
            said = [f'{n}="{of(n)}"' for n in ("name", "id", "placeholder", "value") if of(n)]
            self._put("paragraph", f"[Form Element: {' '.join([tag, *said])}]")
        elif tag == "iframe" and of("src"):
            self._put("paragraph", f"[Iframe: {of('title')}]({of('src')})" if of("title") else f"[Iframe]({of('src')})")
        elif tag in ("video", "audio"):
            self._put("paragraph", f"[{tag}: {of('aria-label') or of('title') or tag}]" + (f"({of('src')})" if of("src") else ""))
        elif tag == "form":
            self._put("paragraph", "[Form Start]")

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if self.skip_at is None:
            if self.hold_at is not None and self.held[0] == "p" and tag in _BLOCKS:
                self.handle_endtag("p")
            inside = self.hold_at is not None
            if tag in self.never or _hidden(tag, a):
                if tag not in _VOID:
                    self.skip_at = len(self.stack)
            elif inside:
                if tag in ("li", "td", "th", "tr", "br", "dt", "dd") or tag in _BLOCKS:
                    self.text.append(" ")
                elif tag == "title" and self.held[0] == "svg":
                    self.title = []
            else:
                role = a.get("role") if tag not in ("a", "button") else None
                if tag in _WHOLE or role in ("button", "link"):
                    self._settle()
                    self.hold_at = len(self.stack)
                    self.held = (tag, {"button": "paragraph", "link": "link"}.get(role) or _WHOLE[tag], a) if role in ("button", "link") else (tag, _WHOLE[tag], {k: v for k, v in a.items() if k != "role"})
                else:
                    if tag in _BLOCKS or tag in ("img", "iframe", "video", "audio", "input", "textarea", "select", "body"):
                        self._settle()
                    self._alone(tag, a)
                    if tag in ("iframe", "video", "audio", "textarea", "select"):
                        self.skip_at = len(self.stack)
        if tag not in _VOID:
            self.stack.append(tag)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag in ("svg", "canvas", "math") or (tag not in _VOID and "svg" in self.stack):
            self.handle_endtag(tag)  # elsewhere the slash has no meaning

    def handle_endtag(self, tag):
        at = next((k for k in range(len(self.stack) - 1, -1, -1) if self.stack[k] == tag), None)
        if at is None:
            return
        if self.hold_at is not None and at < self.hold_at and self.skip_at is None and tag not in _BLOCKS and tag != "body":
            return  # an inline end that a section doesn't hold
        del self.stack[at:]
        if self.skip_at is not None and at <= self.skip_at:
            self.skip_at = None
        if self.hold_at is not None and at <= self.hold_at:
            self._settle()
        elif self.hold_at is None and self.skip_at is None and tag in _BLOCKS:
            self._settle()

    def handle_data(self, data):
        if self.skip_at is None:
            if self.title is not None and self.stack and self.stack[-1] == "title":
                self.title.append(data)
            elif self.held[0] != "svg" or self.hold_at is None:
                if "title" not in self.stack:
                    self.text.append(data)


def sections_of(html: str | None, around: bool = False) -> list[tuple[str, int | None, str]]:
    """(kind, depth of a heading, text) of one page."""
    parser = _Sections(around)
    parser.feed(html or "")
    parser.close()
    parser._settle()
    return parser.out


def _frames(parts: Iterable[pd.DataFrame], around: bool, most: int = 4096) -> Iterator[pd.DataFrame]:
    """The sections of batches of pages, a frame as soon as there are ``most``: what is held is that and the sections of one page."""
    frame = lambda rows: pd.DataFrame(rows, columns=["page_id", "pos", "kind", "depth", "text"]).astype({"depth": "Int32"})
    for part in parts:
        rows = []
        for page, html in zip(part["page_id"], part["html"]):
            rows += [(page, i, kind, depth, text) for i, (kind, depth, text) in enumerate(sections_of(html, around))]
            if len(rows) >= most:
                yield frame(rows)
                rows = []
        yield frame(rows)


def html_sections(pages: DataFrame, around: bool = False) -> DataFrame:
    """(page_id, pos, kind, depth, text): one row for each section of a page, in order.

    Headings, paragraphs, code, tables, lists and links; images, buttons, form elements, frames and media by their
    labels; text outside of these if it has more than 20 characters. Hidden parts, scripts and styles go, and menus,
    headers, footers and sidebars too unless ``around`` keeps them. Null and empty pages have no sections.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from _frames(parts, around)

    return pages.select("page_id", "html").mapInPandas(run, f"page_id {pages.schema['page_id'].dataType.simpleString()}, pos int, kind string, depth int, text string")


def page_importance(sections: DataFrame, signals: DataFrame) -> DataFrame:
    """Score of each page from its sections (page_id, kind, text) and the user's signals."""
    kinds = {"heading": 0.3, "code": 0.5, "list": 0.2}
    rich = sum((F.count_if(F.col("kind") == k) * w for k, w in kinds.items()), F.lit(0.0))
    depth = sections.groupBy("page_id").agg((F.least(F.sum(F.octet_length("text")) / 2500.0, F.lit(2.0)) + F.least(rich, F.lit(1.5))).alias("content"))
    flag = lambda c, w: F.when(F.coalesce(F.col(c), F.lit(False)), w).otherwise(0.0)
    score = F.coalesce("content", F.lit(0.0)) + flag("selection", 2.0) + flag("active", 0.5) + flag("console_errors", 1.0) + flag("network_errors", 0.5)
    score = score + F.least(F.col("dwell_ms") / 1000.0 / 40.0, F.lit(1.5)) + F.least(F.col("interactions") / 20.0, F.lit(1.0))
    return signals.join(depth, "page_id", "left").select("page_id", F.round(F.least(score, F.lit(10.0)), 6).alias("importance"))


def evict_oldest(pages: DataFrame, max_pages: int = 100, max_bytes: int = 8 << 20, size: str = "bytes") -> DataFrame:
    """The newest pages of each session within a count and a size."""
    newest = Window.partitionBy("session_id").orderBy(F.desc("ts"), F.desc("page_id"))
    rows = pages.withColumn("__place", F.row_number().over(newest)).withColumn("__running", F.sum(size).over(newest))
    return rows.filter((F.col("__place") <= max_pages) & (F.col("__running") <= max_bytes)).drop("__place", "__running")


def latest_page_per_url(pages: DataFrame) -> DataFrame:
    return pages.groupBy("session_id", "url").agg(F.max_by("page_id", F.struct("ts", "page_id")).alias("page_id"), F.count("*").alias("revision"))


def nav_history(pages: DataFrame) -> DataFrame:
    order = Window.partitionBy("session_id").orderBy("ts", "page_id")
    return pages.select("session_id", "page_id", F.row_number().over(order).alias("seq"), "url", F.lag("url").over(order).alias("referrer"))


def summary_per_session(pages: DataFrame) -> DataFrame:
    urls = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ts", "page_id", "url"))), lambda x: x["url"]), " ")
    return pages.groupBy("session_id").agg(F.min("ts").alias("started"), F.count("*").alias("pages"), urls.alias("urls"))


def minute_dedup(pages: DataFrame) -> DataFrame:
    """The last page of each (url, content, minute)."""
    key = [F.col("url"), F.sha1("html").alias("content"), F.date_trunc("minute", "ts").alias("minute")]
    return pages.groupBy(*key).agg(F.max("page_id").alias("page_id")).select("page_id", "url", "minute")


def unchanged_pages(pages: DataFrame, cache: DataFrame) -> DataFrame:
    """Pages whose content is what the cache (url, sha1) holds."""
    return pages.join(cache, "url").filter(F.sha1("html") == F.col("sha1")).select("page_id", "url")


def sync_payload(pages: DataFrame, sections: DataFrame) -> DataFrame:
    """Node rows: address, abstract, headings as overview, sections as content."""
    ordered = lambda t: F.array_join(F.transform(F.filter(F.array_sort(F.collect_list(F.struct("pos", "kind", "text"))), t), lambda x: x["text"]), "\n")
    grouped = sections.groupBy("page_id").agg(ordered(lambda x: x["kind"] == "heading").alias("overview"), ordered(lambda x: x["kind"] != "link").alias("content"))
    uri = F.concat(F.lit("node://pages/"), F.base64(F.encode("url", "UTF-8")))
    return pages.select("page_id", uri.alias("uri")).join(grouped, "page_id", "left").withColumn("abstract", F.substring("content", 1, 200))


def page_rank_lookup(ranked: DataFrame, pages: DataFrame, sections: DataFrame) -> DataFrame:
    """Title and the first section's snippet of ranked pages."""
    first = sections.groupBy("page_id").agg(F.min_by("text", "pos").alias("text"))
    return ranked.join(page_metadata(pages).select("page_id", "title"), "page_id").join(first, "page_id", "left").withColumn("snippet", F.substring("text", 1, 200)).drop("text")
