"""HTML extraction by tree scoring: paragraphs pass points to their ancestors, links discount them, the best container is kept.

The markup is read leniently, as browsers do where it matters here: open paragraphs and list items end where a block begins,
end tags without a start are ignored, and unclosed inline tags enclose nothing.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from hearthline.llm.frames import keep_shuffles_short, table
from hearthline.plans.catalog import query

# Element kinds of HTML.
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "noembed", "noframes", "template", "xmp"}
DROPPED = RAW | {"head", "nav", "footer", "aside", "form", "button", "select", "option", "svg", "math", "canvas", "object", "embed", "audio", "video",
                 "map", "dialog", "menu", "input", "label", "datalist", "fieldset", "legend"}
BLOCKS = {"address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption",
          "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre",
          "search", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Class and id words of parts that are no article text.
ASIDE_NAMES = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "banner", "sponsor", "sponsored", "promo", "promotion", "nav", "navbar", "navigation", "menu",
               "sidebar", "aside", "footer", "masthead", "topbar", "toolbar", "breadcrumb", "breadcrumbs", "comment", "comments", "commentlist", "disqus", "reply", "replies", "respond",
               "cookie", "cookies", "consent", "gdpr", "notice", "notices", "popup", "modal", "overlay", "newsletter", "subscribe", "subscription", "signup", "login", "share", "sharing",
               "social", "related", "recommended", "recommendations", "widget", "pagination", "pager", "search", "hidden", "skip", "copyright", "disclaimer", "alert", "paywall"}
ASIDE_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "menu", "menubar", "form", "toolbar"}
GOOD_NAMES = {"article", "content", "main", "post", "entry", "story", "body", "text", "page", "blog"}

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
_NAME_WORD = re.compile(r"[a-z0-9]+")
_SPACE = re.compile(r"\s+")
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_LISTS = {"ul", "ol", "dl", "table", "menu"}


class Node:
    __slots__ = ("tag", "up", "parts", "names", "out", "points", "chars", "linked", "paragraphs")

    def __init__(self, tag: str, up: Node | None, names: set[str], out: bool):
        self.tag, self.up, self.names, self.out = tag, up, names, out
        self.parts: list[Node | str] = []
        self.points, self.chars, self.linked, self.paragraphs = 0.0, 0, 0, 0


def _attributes(raw: str) -> tuple[set[str], bool]:
    """Words of class and id; whether the attributes say that this is no visible article text."""
    names: set[str] = set()
    out = False
    if "=" in raw or "hidden" in raw:
        for m in _ATTRIBUTE.finditer(raw):
            key, value = m[1].lower(), (m[2] or "").strip("\"'").lower()
            if key in ("class", "id"):
                names.update(_NAME_WORD.findall(value))
            elif key == "role":
                out |= value in ASIDE_ROLES
            elif key == "style":
                out |= "display:none" in value.replace(" ", "")
            elif raw[m.start() - 1:m.start()].isspace():
                out |= key == "hidden" or value == "true"
    return names, out


def parse(page: str) -> Node:
    root = Node("#root", None, set(), False)
    here, at, n = root, 0, len(page)
    while at < n:
        m = _TAG.search(page, at)
        if not m:
            here.parts.append(page[at:])
            break
        if m.start() > at:
            here.parts.append(page[at:m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            if m[0].startswith("<![CDATA["):
                here.parts.append(html.escape(m[0][9:].removesuffix("]]>")))
            continue
        if m[1]:
            if tag == "p" or tag in BLOCKS or tag in ("a",) or tag in DROPPED:
                node = here
                while node.up and node.tag != tag:
                    node = node.up
                if node.up:
                    here = node.up
            continue
        if tag in BLOCKS:
            # A block ends open inline elements and an open paragraph; a list item also ends the one before.
            node = here
            while node.up and (node.tag not in BLOCKS or node.tag == "p"):
                if node.tag in DROPPED and node.tag not in RAW:
                    break
                node = node.up
            here = node
            ends = _CLOSES.get(tag)
            if ends:
                node = here
                while node.up and node.tag not in _LISTS:
                    if node.tag in ends:
                        here = node.up
                        if tag != "tr" or node.tag == "tr":
                            break
                    node = node.up
        if tag == "a":
            node = here
            while node.up and node.tag not in BLOCKS:
                if node.tag == "a":
                    here = node.up
                    break
                node = node.up
        if tag == "br":
            here.parts.append(" ")
            continue
        if tag not in BLOCKS and tag not in DROPPED and tag != "a":
            names, out = _attributes(m[3])
            if not (out or names & ASIDE_NAMES) or tag in VOID:
                continue  # inline markup: its text belongs to what surrounds it
        else:
            names, out = _attributes(m[3])
        node = Node(tag, here, names, out or tag in DROPPED or bool(names & ASIDE_NAMES and not names & GOOD_NAMES - {"text", "page", "body"}))
        here.parts.append(node)
        if tag in RAW and not m[3].endswith("/"):
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = end.end() if end else n
        elif tag not in VOID and not (m[3].endswith("/") and tag not in BLOCKS):
            here = node
    return root


def _clean(text: str) -> str:
    return _SPACE.sub(" ", html.unescape(text)).strip()


def _blocks(node: Node) -> list[tuple[Node, str, int]]:
    """(the block element, its text, characters in links) of every run of text that no block interrupts, in page order."""
    out: list[tuple[Node, str, int]] = []
    text: list[str] = []
    links = 0

    def flush(owner: Node) -> None:
        nonlocal links
        if text:
            t = _clean("".join(text))
            if t:
                out.append((owner, t, min(links, len(t))))
            text.clear()
            links = 0

    # An explicit stack: pages nest as deep as they like.
    stack: list[tuple[Node, int, Node, bool]] = [(node, 0, node, False)]
    while stack:
        n, i, owner, in_link = stack.pop()
        while i < len(n.parts):
            p = n.parts[i]
            i += 1
            if isinstance(p, str):
                text.append(p)
                if in_link:
                    links += len(_clean(p))
                continue
            if p.out:
                if p.tag in BLOCKS:
                    flush(owner)
                continue
            if p.tag in BLOCKS:
                flush(owner)
            if p.tag == "hr":
                continue
            stack.append((n, i, owner, in_link))
            n, i, owner, in_link = p, 0, (p if p.tag in BLOCKS else owner), in_link or p.tag == "a"
        if n.tag in BLOCKS or n is node:
            flush(owner)
    return out


def main_text(page: str) -> str:
    """The article's blocks, one per line. A page without text gives an empty string."""
    root = parse(page)
    # Page headers hold site names and slogans; a header inside an article holds its title.
    stack = [(root, False)]
    while stack:
        n, inside = stack.pop()
        inside = inside or n.tag in ("article", "main")
        for p in n.parts:
            if isinstance(p, Node):
                p.out = p.out or (p.tag == "header" and not inside) or ("header" in p.names and not inside)
                if not p.out:
                    stack.append((p, inside))
    blocks = _blocks(root)
    if not blocks:
        return ""
    scored: list[Node] = []
    for owner, text, linked in blocks:
        n: Node | None = owner
        while n:
            n.chars += len(text)
            n.linked += linked
            n = n.up
        # A paragraph: a point for itself, one for each comma, one for each 100 characters up to three.
        points = (1 + text.count(",") + min(3, len(text) / 100)) * (1 - linked / len(text))
        if owner.tag in ("h1", "h2", "h3", "h4", "h5", "h6", "th", "dt"):
            points *= 0.25
        n, share = (owner.up if owner.tag in ("p", "li", "td", "th", "dd", "dt", "pre", "h1", "h2", "h3", "h4", "h5", "h6") and owner.up else owner), 1.0
        level = 0
        while n:
            if not n.points and not n.paragraphs:
                scored.append(n)
                n.points += {"article": 25, "main": 15, "section": 5}.get(n.tag, 0) + (10 if n.names & GOOD_NAMES else 0)
            n.paragraphs += 1
            n.points += points * share
            level += 1
            share, n = 1 / (2 * level) if level > 1 else 0.5, n.up
    value = {id(n): n.points * (1 - n.linked / max(1, n.chars)) for n in scored}
    best = max(scored, key=lambda n: value[id(n)])
    keep = {id(best)}
    if best.up:
        # Siblings that look like parts of the same text; an article is a whole of its own.
        bar = max(10.0, value[id(best)] * 0.2)
        for s in best.up.parts:
            if isinstance(s, Node) and not s.out and s is not best:
                density = s.linked / max(1, s.chars)
                same = value.get(id(s), 0) >= bar and (best.tag not in ("article", "main") or s.tag == best.tag)
                loose = s.tag in ("p", "h1", "h2") and best.tag not in ("article", "main") and density < 0.25 and s.chars > 0
                if same or loose:
                    keep.add(id(s))
    out = []
    for owner, text, _ in blocks:
        n = owner
        while n and id(n) not in keep:
            n = n.up
        if n:
            out.append(text)
    return "\n".join(out)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, len(b), 256):
            part = b.slice(at, 256)
            yield pa.record_batch({"page_id": part.column("page_id"), "url": part.column("url"),
                                   "text": pa.array([main_text(p) if p else "" for p in part.column("html").to_pylist()], pa.string())})


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text per row of ``pages``, from the whole markup. A missing or empty page gives an empty text."""
    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
                        F.col(html_col).cast("string").alias("html")).mapInArrow(_extract, "page_id long, url string, text string")


@query("op7_html_extraction")
def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    keep_shuffles_short(spark)
    return extract_pages(table(spark, sf_dir, "pages")).withColumn("n_chars", F.char_length("text").cast("long"))
