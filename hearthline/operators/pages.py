"""Web pages to text, links, raw fields and embedded JSON."""

from __future__ import annotations

import html as html_lib
import re
import sys
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F, types as T

from hearthline.functions.text import strip
from hearthline.functions.urls import normalize_keep_query

# Worker functions travel by value, so executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# --- fixed values: meta names worth keeping, tags without an end tag -----------------------
META_NAMES = ["description", "og:description", "og:title", "twitter:description", "twitter:title"]
VOID_TAGS = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


@F.pandas_udf(T.StringType())
def _unescape(texts: pd.Series) -> pd.Series:
    return texts.map(html_lib.unescape, na_action="ignore")


def unescape(c: Column, times: int = 1) -> Column:
    """HTML entities to characters."""
    for _ in range(times):
        c = _unescape(c)
    return c


def visible_text(html: Column) -> Column:
    """Text nodes outside script, style and noscript, one per line, entities still escaped."""
    body = F.regexp_replace(html, r"(?is)<(script|style|noscript)\b.*?</\1\s*>", "")
    body = F.regexp_replace(body, r"(?s)<!--.*?-->|<[^>]*>", "\n")
    return strip(F.regexp_replace(body, r"\s*\n\s*", "\n"))


def _attribute(tag: Column, name: str) -> Column:
    return F.nullif(F.regexp_extract(tag, rf"(?is)\s{name}\s*=\s*[\"']([^\"']*)[\"']", 1), F.lit(""))


def _tags(html: Column, name: str) -> Column:
    return F.regexp_extract_all(html, F.lit(rf"(?is)<{name}\b[^>]*>"), F.lit(0))


def meta_lines(html: Column) -> Column:
    """'name: content' of the descriptive meta tags."""
    label = lambda t: F.coalesce(_attribute(t, "name"), _attribute(t, "property"))
    wanted = F.filter(_tags(html, "meta"), lambda t: F.lower(label(t)).isin(*META_NAMES) & _attribute(t, "content").isNotNull())
    return F.transform(wanted, lambda t: F.concat(label(t), F.lit(": "), _attribute(t, "content")))


def attribute_values(html: Column, tag: str, attribute: str) -> Column:
    """Distinct non-empty attribute values in page order."""
    values = F.transform(_tags(html, tag), lambda t: _attribute(t, attribute))
    return F.array_distinct(F.filter(values, lambda v: v.isNotNull()))


def image_urls(html: Column, part: str | None = None) -> Column:
    urls = attribute_values(html, "img", "src")
    return F.filter(urls, lambda u: F.contains(u, F.lit(part))) if part else urls


def reduce_pages(pages: DataFrame, keep_chars: int | None = None, max_images: int | None = None) -> DataFrame:
    """(page_id, url, reduced): meta lines, image URLs and visible text in one string.

    Whole pages by default; a request to a text model may set ``keep_chars`` and ``max_images``.
    """
    h = F.col("html")
    images = F.slice(image_urls(h), 1, max_images) if max_images else image_urls(h)
    bundle = F.concat(F.lit("\n\n---META---\n"), F.array_join(meta_lines(h), "\n"), F.lit("\n\n---IMAGES---\n"),
                      F.array_join(images, "\n"), F.lit("\n\n---TEXT---\n"), visible_text(h))
    text = unescape(bundle)
    return pages.select("page_id", "url", (F.substring(text, 1, keep_chars) if keep_chars else text).alias("reduced"))


def page_links(pages: DataFrame, pattern: str | None = None) -> DataFrame:
    """(page_id, link): distinct links per page, resolved against the page and normalised."""
    links = pages.select("page_id", "url", F.explode(attribute_values(F.col("html"), "a", "href")).alias("href"))
    found = links.select("page_id", normalize_keep_query(unescape(F.col("href")), F.col("url")).alias("link")).distinct()
    return found.where(F.col("link").rlike(pattern)) if pattern else found


def text_links(pages: DataFrame, pattern: str) -> DataFrame:
    """(page_id, link) of every distinct URL in the markup that matches a pattern."""
    found = F.regexp_extract_all(F.col("html"), F.lit(pattern), F.lit(0))
    return pages.select("page_id", F.explode(F.array_distinct(found)).alias("link"))


@dataclass(frozen=True)
class Rule:
    """Collect text (or an attribute) of elements matching a descendant selector.

    Selectors are steps like ``div.box`` or ``a[href*=/x/]`` separated by blanks.
    """

    field: str
    selector: str
    attribute: str | None = None


_STEP = re.compile(r"([.#])([\w-]+)|\[([\w:-]+)(?:([*^]?=)['\"]?([^'\"\]]*)['\"]?)?\]|^([\w-]+)")


def _step_test(step: str):
    """Predicate over (tag, attrs) for one selector step."""
    checks = []
    for kind, name, attr, op, value, tag in _STEP.findall(step):
        if tag:
            checks.append(lambda t, a, tag=tag: t == tag)
        elif kind == ".":
            checks.append(lambda t, a, name=name: name in (a.get("class") or "").split())
        elif kind == "#":
            checks.append(lambda t, a, name=name: a.get("id") == name)
        else:
            tests = {"": lambda x, v: True, "=": lambda x, v: x == v, "^=": str.startswith, "*=": str.__contains__}
            checks.append(lambda t, a, attr=attr, test=tests[op], v=value: attr in a and test(a[attr] or "", v))
    return lambda t, a: all(c(t, a) for c in checks)


class _Collector(HTMLParser):
    """Streams one page and collects the values of all rules."""

    def __init__(self, rules: list[tuple[Rule, list]]):
        super().__init__(convert_charrefs=True)
        self.rules, self.open, self.found = rules, [], {}

    def _matches(self, steps: list) -> bool:
        path, todo = self.open, list(steps)
        if not todo.pop()(*path[-1][:2]):
            return False
        for element in reversed(path[:-1]):
            if todo and todo[-1](*element[:2]):
                todo.pop()
        return not todo

    def handle_starttag(self, tag: str, attrs: list) -> None:
        attributes = dict(attrs)
        self.open.append((tag, attributes, []))
        for rule, steps in self.rules:
            if self._matches(steps):
                values = self.found.setdefault(rule.field, [])
                if rule.attribute is None:
                    values.append([])
                    self.open[-1][2].append(values[-1])
                elif attributes.get(rule.attribute):
                    values.append([attributes[rule.attribute]])
        if tag in VOID_TAGS:
            if tag == "br":
                self.handle_data("\n")
            self.open.pop()

    def handle_endtag(self, tag: str) -> None:
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                del self.open[i:]
                return

    def handle_data(self, data: str) -> None:
        if self.open and self.open[-1][0] in ("script", "style"):
            return
        for _, _, sinks in self.open:
            for sink in sinks:
                sink.append(data)


def extract_fields(pages: DataFrame, rules: list[Rule]) -> DataFrame:
    """(page_id, url, page_text, fields): every rule's values per page as map<string, array<string>>.

    The page text is prepared in the JVM and rides along, so nothing is joined back later.
    """
    compiled = [(r, [_step_test(s) for s in r.selector.split()]) for r in rules]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fields = []
            for page in batch["html"]:
                collector = _Collector(compiled)
                collector.feed(page or "")
                collector.close()
                fields.append({k: ["".join(v).strip() for v in vs] for k, vs in collector.found.items()})
            yield batch.drop(columns="html").assign(fields=fields)

    text = unescape(visible_text(F.col("html"))).alias("page_text")
    return pages.select("page_id", "url", text, "html").mapInPandas(
        run, "page_id long, url string, page_text string, fields map<string,array<string>>"
    )


def embedded_json(c: Column, schema: str) -> Column:
    """JSON inside an attribute, entities unescaped twice."""
    return F.from_json(unescape(c, 2), schema)
