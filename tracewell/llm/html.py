"""Main text of web pages by consensus host paths."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewell.columns import col
from tracewell.llm.common import load, saved

MARKUP = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"""
    r"""|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)(?:>|\Z)"""
    r"""|<(/?)([a-zA-Z][^\s/>]*+)([^>]*)(?:>|\Z)""",
    re.S,
)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
SPACE = re.compile(r"\s+")
SIGNS = re.compile(r"[^a-z0-9]+")

RAW = {"script", "style", "title", "textarea", "xmp", "iframe", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset",
    "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "html", "legend", "li", "main", "menu", "nav",
    "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
# An open tag of the first kind ends when one of the others begins.
ENDED_BY = {
    "p": BLOCK - {"html", "body", "caption", "td", "th", "tr", "tbody", "thead", "tfoot", "legend"},
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option", "optgroup"}, "tr": {"tr", "tbody", "thead", "tfoot"},
    "td": {"td", "th", "tr", "tbody", "thead", "tfoot"}, "th": {"td", "th", "tr", "tbody", "thead", "tfoot"},
    "h1": {"p", "h1", "h2", "article", "section"}, "head": {"body"},
}
CONTAINERS = {"article", "main", "div", "section", "td", "body", "center", "details", "blockquote", "html", "root", "dd", "li"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
DROPPED_TAGS = {
    "nav", "footer", "aside", "form", "script", "style", "noscript", "iframe", "button", "select", "svg", "template", "dialog", "menu", "head", "title",
    "textarea", "object", "canvas", "audio", "video", "math", "datalist", "fieldset", "header",
}
DROPPED_NAMES = {
    "nav", "navbar", "navigation", "menu", "footer", "header", "sidebar", "aside", "ad", "ads", "adv", "advert", "adverts", "advertisement", "adsense",
    "banner", "promo", "promotion", "sponsor", "sponsored", "cookie", "cookies", "consent", "gdpr", "notice", "notices", "popup", "modal", "overlay",
    "newsletter", "subscribe", "subscription", "comment", "comments", "commentlist", "disqus", "respond", "reply", "replies", "share", "sharing", "social",
    "related", "recommended", "recommendations", "breadcrumb", "breadcrumbs", "pagination", "pager", "widget", "widgets", "login", "signin", "signup",
    "toolbar", "masthead", "topbar", "alert", "disclaimer", "skip", "search", "searchbox",
}
DROPPED_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar"}
MAIN_NAMES = {"article", "content", "main", "post", "entry", "story", "body", "text"}
BEFORE_NAME = {"has", "with", "no", "without", "not"}

WINNING_SHARE = 0.05


@dataclass
class Page:
    """Elements in page order (parallel lists) and text runs."""

    tag: list[str] = field(default_factory=lambda: ["root"])
    parent: list[int] = field(default_factory=lambda: [-1])
    path: list[str] = field(default_factory=lambda: [""])
    marked: list[bool] = field(default_factory=lambda: [False])  # named as something that is not the article
    named: list[bool] = field(default_factory=lambda: [False])  # named as the article
    end: list[int] = field(default_factory=lambda: [0])
    runs: list[tuple[int, str, bool]] = field(default_factory=list)  # element, text, inside a link
    dropped: list[bool] = field(default_factory=list)


def _marks(tag: str, attributes: str) -> tuple[str, bool, bool]:
    """(generalised tag-class step of the path, names something else, names the article)."""
    if not attributes.strip(" /\t\r\n"):
        return tag, False, False
    found: dict[str, str] = {}
    for name, a, b, c in ATTRIBUTE.findall(attributes):
        found.setdefault(name.lower(), unescape(a or b or c))
    classes = found.get("class", "").lower().split()
    step = ".".join([tag, *sorted({re.sub(r"\d+", "N", c) for c in classes})])
    other = found.get("role", "").lower() in DROPPED_ROLES or "hidden" in found or found.get("aria-hidden", "").lower() == "true"
    other |= "display:none" in found.get("style", "").lower().replace(" ", "")
    article = False
    for name in [*classes, found.get("id", "").lower()]:
        signs = [s for s in SIGNS.split(name) if s]
        if signs and signs[0] not in BEFORE_NAME:
            other |= any(s in DROPPED_NAMES for s in signs)
            article |= any(s in MAIN_NAMES for s in signs)
    return step, other, article


def parse(html: str) -> Page:
    """Read a page as browsers roughly do: open tags may stay open, comments and raw text are skipped, cut pages end early."""
    page, stack, at, links = Page(), [0], 0, 0

    def close(depth: int) -> None:
        nonlocal links
        while len(stack) > depth:
            gone = stack.pop()
            page.end[gone] = len(page.tag)
            links -= page.tag[gone] == "a"

    while at < len(html):
        found = MARKUP.search(html, at)
        upto = found.start() if found else len(html)
        if upto > at:
            page.runs.append((stack[-1], html[at:upto], links > 0))
        if not found:
            break
        at = found.end()
        tag = (found[2] or found[5] or "").lower()
        if not tag:
            continue
        if found[1] or found[4]:
            # An end tag closes the nearest open one of its name, but not across a table cell or the page's main parts.
            for depth in range(len(stack) - 1, 0, -1):
                if page.tag[stack[depth]] == tag:
                    close(depth)
                    break
                if page.tag[stack[depth]] in ("td", "th", "article", "main") and tag not in BLOCK:
                    break
            if tag in BLOCK:
                page.runs.append((stack[-1], "\0", False))
            continue
        if tag in BLOCK:
            for depth in range(len(stack) - 1, 0, -1):
                open_tag = page.tag[stack[depth]]
                if tag in ENDED_BY.get(open_tag, ()):
                    close(depth)
                elif open_tag in BLOCK and open_tag not in ENDED_BY:
                    break
                elif open_tag in ("li", "dd", "td", "th"):
                    break
            page.runs.append((stack[-1], "\0", False))
        elif tag == "br":
            page.runs.append((stack[-1], " ", links > 0))
        if tag == "a" and links:  # links do not nest
            depth = max(d for d in range(len(stack)) if page.tag[stack[d]] == "a")
            close(depth)
        if tag in VOID:
            continue
        attributes = found[3] or found[6] or ""
        step, other, article = _marks(tag, attributes)
        number, above = len(page.tag), stack[-1]
        page.tag.append(tag)
        page.parent.append(above)
        page.path.append(f"{page.path[above]}/{step}" if tag in BLOCK else page.path[above])
        page.marked.append(other or tag in DROPPED_TAGS)
        page.named.append(article)
        page.end.append(number + 1)
        if tag in RAW:
            ended = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(html, at)
            at = ended.end() if ended else len(html)
            continue
        if attributes.endswith("/") and tag in ("svg", "math", "path"):
            continue
        stack.append(number)
        links += tag == "a"
    close(0)
    page.end[0] = len(page.tag)
    _drop(page)
    return page


def _drop(page: Page) -> None:
    """Mark what is not article: by tag or name, unless it holds the page's <article> or <main>, and all below it.

    Headings in the header of an article stay.
    """
    count = len(page.tag)
    holds = [False] * count
    for n in range(count - 1, 0, -1):
        if page.tag[n] in ("article", "main") and not page.marked[n]:
            holds[n] = True
        if holds[n]:
            holds[page.parent[n]] = True
    inside = [False] * count
    page.dropped = [False] * count
    for n in range(1, count):
        above = page.parent[n]
        inside[n] = inside[above] or (page.tag[n] in ("article", "main") and not page.dropped[above])
        drop = page.marked[n] and not holds[n] and page.tag[n] not in ("html", "body")
        kept_heading = page.tag[n] in HEADINGS and page.tag[above] == "header" and inside[above] and not page.dropped[page.parent[above]]
        page.dropped[n] = (page.dropped[above] and not kept_heading) or drop


def block_texts(page: Page, tops: list[int]) -> list[str]:
    """Texts of the blocks below elements that do not hold each other, in page order, references decoded, white space made one space."""
    blocks, now, inside = [], [], [-1] * len(page.tag)
    for top in tops:
        inside[top : page.end[top]] = [top] * (page.end[top] - top)
    last = -1
    for element, text, _ in page.runs:
        if inside[element] < 0:
            continue
        if inside[element] != last:
            blocks.append("".join(now))
            now, last = [], inside[element]
        if text == "\0":
            blocks.append("".join(now))
            now = []
        elif not page.dropped[element]:
            now.append(text)
    blocks.append("".join(now))
    clean = (SPACE.sub(" ", unescape(b)).strip() for b in blocks)
    return [b for b in clean if b]


def scores(page: Page) -> dict[int, float]:
    """Score of each container: letters of its own blocks that are not links, and half of those one container deeper.

    <article>, <main> and containers named as the article count more.
    """
    own = [0.0] * len(page.tag)
    for element, text, link in page.runs:
        if text == "\0" or page.dropped[element]:
            continue
        size = len(text) - text.count(" ") - text.count("\n")
        if not size:
            continue
        while page.tag[element] not in CONTAINERS:
            element = page.parent[element]
        own[element] += -0.5 * size if link else size
    out: dict[int, float] = {}
    for n, value in enumerate(own):
        if not value:
            continue
        out[n] = out.get(n, 0.0) + value
        above = page.parent[n]
        while above >= 0 and page.tag[above] not in CONTAINERS:
            above = page.parent[above]
        if above >= 0:
            out[above] = out.get(above, 0.0) + value / 2
    lift = {"article": 3.0, "main": 2.0, "html": 0.5, "root": 0.5}
    return {n: v * lift.get(page.tag[n], 1.5 if page.named[n] else 1.0) for n, v in out.items() if not page.dropped[n]}


def best_container(page: Page) -> tuple[int, float]:
    found = scores(page)
    if not found:
        return 0, 0.0
    best = max(found, key=lambda n: (found[n], -n))
    return best, found[best]


def winning_area(page: Page, best: int) -> list[int]:
    """Elements a page is read at: all on the path of `best`, or the lowest container above that is theirs.

    A container above is theirs if it is not the page itself, most of its letters outside links lie in them, and what it
    has besides is mostly no links; the next one above is tried after it.
    """
    text, links = [0] * (len(page.tag) + 1), [0] * (len(page.tag) + 1)
    for element, run, link in page.runs:
        if run != "\0" and not page.dropped[element]:
            (links if link else text)[element] += len(run) - run.count(" ") - run.count("\n")
    text_upto, links_upto = [0, *accumulate(text)], [0, *accumulate(links)]

    def below(upto: list[int], tops: list[int]) -> int:
        return sum(upto[page.end[n]] - upto[n] for n in tops)

    area: list[int] = []
    for n, path in enumerate(page.path):
        if path == page.path[best] and page.tag[n] in CONTAINERS and not page.dropped[n] and (not area or n >= page.end[area[-1]]):
            area.append(n)
    if best not in area:
        area = [best]
    above = page.parent[best]
    while above >= 0 and page.tag[above] not in ("body", "html", "root"):
        if page.tag[above] in CONTAINERS and not page.dropped[above]:
            mine = [n for n in area if above < n < page.end[above]]
            more_text = below(text_upto, [above]) - below(text_upto, mine)
            more_links = below(links_upto, [above]) - below(links_upto, mine)
            if more_text > below(text_upto, mine) or more_links > more_text:
                break
            area = sorted([n for n in area if n not in mine] + [above])
        above = page.parent[above]
    return area


def extract(html: str, winning: list[str]) -> tuple[str, str]:
    """(text, path it was taken from)."""
    page = parse(html)
    best, _ = best_container(page)
    if winning and page.path[best] not in winning:
        found = scores(page)
        for path in winning:
            same = [n for n, p in enumerate(page.path) if p == path and page.tag[n] in CONTAINERS and not page.dropped[n] and found.get(n, 0) > 0]
            if same:
                best = max(same, key=lambda n: (found[n], -n))
                break
    return "\n\n".join(block_texts(page, winning_area(page, best))), page.path[best]


def host_paths(pages: DataFrame, share: float = WINNING_SHARE) -> DataFrame:
    """Winning paths of each host, most votes first: (host, paths). `pages` has (host, html).

    Each page votes for the generalised tag-class path of its best container. A path wins with `share` of its host's
    votes; pages without host or text have no vote. Votes are counted by host and path before any shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, paths = [], []
            for host, html in zip(batch.column(0), batch.column(1)):
                if html.is_valid:
                    page = parse(html.as_py())
                    best, score = best_container(page)
                    if score > 0:
                        hosts.append(host.as_py())
                        paths.append(page.path[best])
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(paths, pa.string())], names=["host", "path"])

    votes = pages.where("host is not null").mapInArrow(run, "host string, path string").groupBy("host", "path").agg(F.count("*").alias("n"))
    ranked = votes.withColumn("of", F.sum("n").over(Window.partitionBy("host"))).where(F.col("n") >= share * F.col("of"))
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "path")))
    return ranked.groupBy("host").agg(F.transform(ordered, lambda x: x["path"]).alias("paths"))


def extract_pages(pages: DataFrame) -> DataFrame:
    """One row per row of `pages` (page_id, url, html): page_id, url, text, n_chars, path.

    A page whose own best container lies on a winning path of its host is read there, any other at the first winning path
    that it has, or at its own best container. Null or empty html, and html without text, give an empty text; pages with a
    null url or one without host are read by themselves. Rows with equal ids or urls are pages of their own.
    """
    rows = pages.select(col("page_id").alias("page_id"), col("url").alias("url"), col("html").alias("html"))
    host = F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1))
    rows = rows.withColumn("host", F.when(host != "", host))
    # Written, so that its size is known: Spark sends it to all tasks only if it is small.
    winners = saved(host_paths(rows.select("host", "html")), "paths").withColumnRenamed("host", "of")
    joined = rows.join(winners, F.col("host") == F.col("of"), "left").select("page_id", "url", "html", "paths")
    kind = rows.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, paths = [], []
            for html, winning in zip(batch.column(2), batch.column(3)):
                text, path = extract(html.as_py() or "", winning.as_py() or [])
                texts.append(text)
                paths.append(path)
            sizes = pa.array([len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), sizes, pa.array(paths, pa.string())],
                names=["page_id", "url", "text", "n_chars", "path"],
            )

    return joined.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long, path string")


def op4(spark: SparkSession, folder: str) -> DataFrame:
    return extract_pages(load(spark, folder, "pages"))
