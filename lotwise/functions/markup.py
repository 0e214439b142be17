"""Saved pages read by a parser: a page's elements in document order, and functions of a batch of pages made of them."""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Callable
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = ("script", "style", "template")


class Page(HTMLParser):
    """A page's elements in document order.

    Element i has names[i] and attributes[i]; the elements within it are those
    up to stops[i], its texts those from starts[i] to ends[i].  An end tag
    closes all that is still open within its element, one without an element is
    passed over, and what never ends ends with the page.  Comments and the
    contents of scripts, styles and templates are no text.
    """

    def __init__(self, html: str | None):
        super().__init__()
        self.names: list[str] = []
        self.attributes: list[dict[str, str]] = []
        self.stops: list[int] = []
        self.starts: list[int] = []
        self.ends: list[int] = []
        self.texts: list[str] = []
        self._open: list[int] = []
        self._open_names: Counter[str] = Counter()
        self._goes_on = False
        self.feed(html or "")
        self.close()
        while self._open:
            self._end()

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self._goes_on = False
        self.names.append(tag)
        self.attributes.append({k: v or "" for k, v in attrs})
        for where, value in ((self.stops, len(self.names)), (self.starts, len(self.texts)), (self.ends, len(self.texts))):
            where.append(value)
        if tag not in VOID:
            self._open.append(len(self.names) - 1)
            self._open_names[tag] += 1

    def handle_endtag(self, tag: str) -> None:
        self._goes_on = False
        while self._open_names[tag] and self._end() != tag:
            pass

    def _end(self) -> str:
        i = self._open.pop()
        self._open_names[self.names[i]] -= 1
        self.stops[i], self.ends[i] = len(self.names), len(self.texts)
        return self.names[i]

    def handle_data(self, data: str) -> None:
        if any(self._open_names[name] for name in SILENT):
            return
        if self._goes_on:
            self.texts[-1] += data
        else:
            self.texts.append(data)
        self._goes_on = True

    def handle_comment(self, data: str) -> None:
        self._goes_on = False

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        return self.parse_bogus_comment(i, report)  # as browsers do, where the parser would raise an error

    def text(self, i: int, until: int | None = None) -> str:
        """The text of an element, white space squeezed; up to the beginning of element `until`."""
        end = self.ends[i] if until is None else min(self.ends[i], self.starts[until])
        return " ".join(word for piece in self.texts[self.starts[i] : end] for word in piece.split())

    def classes(self, i: int) -> list[str]:
        return self.attributes[i].get("class", "").split()

    def first(self, wanted: Callable[[int], bool], within: int | None = None) -> int | None:
        """The first element that is wanted, of the page or within an element."""
        span = range(len(self.names)) if within is None else range(within + 1, self.stops[within])
        return next((i for i in span if wanted(i)), None)


# fixed values: classes of a card's parts after "a-card" or "vip-card", of parts with classes of their own, and a button's text within titles
PARTS = {"title": "title", "price": "price", "description": "description", "region": "city", "date": "posted"}
OWN_PARTS = {"nb-views": "views", "thumb-gallery__count": "count", "a-card__param--date": "posted_param", "a-label__text": "labels"}
BUTTON = "Добавить в избранное"
MONTHLY = "/мес"
CARD = "array<struct<ad_id: string, href: string, title: string, price: string, description: string, city: string, views: string, posted: string, labels: array<string>, pictures: array<string>, picture_count: string, is_vip: boolean, has_monthly_price: boolean>>"


def card_list(html: str | None, marker: str, id_attribute: str, link: str) -> list[dict]:
    """The cards of a page in order; each ends with its element, or before, where the next begins."""
    if not html or marker not in html:
        return []
    page = Page(html)
    begins = [i for i in range(len(page.names)) if marker in page.classes(i)]
    monthly = [i for i, text in enumerate(page.texts) if MONTHLY in text]
    found = []
    for begin, after in zip(begins, [*begins[1:], None]):
        stop = page.stops[begin] if after is None else min(page.stops[begin], after)
        until = after if after is not None and after < page.stops[begin] else None
        own = page.attributes[begin]
        vip = any("vip-card" in c for c in page.classes(begin))
        card = dict.fromkeys(["href", "title", "price", "description", "city", "views", "posted", "picture_count"], "")
        card |= {"ad_id": own.get(id_attribute, ""), "labels": [], "pictures": [], "is_vip": vip}
        first: dict[str, int] = {}
        alt = None
        for i in range(begin + 1, stop):
            name, attributes = page.names[i], page.attributes[i]
            for c in page.classes(i):
                head, _, tail = c.rpartition("__")
                if tail in PARTS and (head == ("vip-card" if vip else "a-card") or head == "card"):
                    first.setdefault(PARTS[tail], i)
                if c in OWN_PARTS:
                    first.setdefault(OWN_PARTS[c], i)
                if OWN_PARTS.get(c) == "labels":
                    card["labels"].append(page.text(i, until))
            if attributes.get("data-test") == "region":
                first.setdefault("region", i)
            if name == "a" and not card["href"] and link in attributes.get("href", ""):
                card["href"] = attributes["href"]
            if name == "img":
                alt = alt if alt is not None else attributes.get("alt")
            card["pictures"] += [attributes[a] for a in ("src", "data-src") if attributes.get(a)] if name in ("img", "source") else []
        read = {part: page.text(i, until) for part, i in first.items() if part != "labels"}
        card |= {part: read.get(part, "") for part in ("title", "price", "description", "city", "views")}
        card |= {"title": card["title"].replace(BUTTON, "").strip(), "description": card["description"] or alt or "", "city": card["city"] or read.get("region", "")}
        card |= {"posted": read.get("posted") or read.get("posted_param", ""), "picture_count": read.get("count", "")}
        ends = page.ends[begin] if until is None else page.starts[until]
        at = bisect_left(monthly, page.starts[begin])
        card["has_monthly_price"] = at < len(monthly) and monthly[at] < ends
        found.append(card)
    return found


FACTS = "struct<terms: map<string, string>, h1: string, options_text: string, badge: string>"


def facts(html: str | None, badge: str) -> dict:
    """The terms of a listing's page (of equal ones the last counts), its heading, its options and the badge of a class ('-' without one)."""
    page = Page(html)
    terms: dict[str, str] = {}
    term = None
    for i, name in enumerate(page.names):
        if name == "dt":
            term = page.text(i, next((j for j in range(i + 1, page.stops[i]) if page.names[j] in ("dt", "dd")), None))
        elif name == "dl":
            term = None
        elif name == "dd" and term is not None:
            terms[term] = page.text(i, next((j for j in range(i + 1, page.stops[i]) if page.names[j] in ("dt", "dd")), None))
            term = None
    outer = page.first(lambda i: "offer__description" in page.classes(i))
    options = None if outer is None else page.first(lambda i: "text" in page.classes(i), outer)
    heading, mark = page.first(lambda i: page.names[i] == "h1"), page.first(lambda i: badge in page.classes(i))
    read = {k: "" if i is None else page.text(i) for k, i in (("h1", heading), ("options_text", options), ("badge", mark))}
    return read | {"terms": list(terms.items()), "badge": read["badge"] or "-"}


OUTLINE = "struct<title: string, h1: string, links: int, paragraphs: int, text_chars: long, footer: string>"


def outline(html: str | None) -> dict:
    """What stands in the first title, heading and footer, the numbers of links and paragraphs, and the length of the whole text, squeezed."""
    page = Page(html)
    at = {name: page.first(lambda i, name=name: page.names[i] == name) for name in ("title", "h1", "footer")}
    counts = Counter(page.names)
    links = sum(n == "a" and "href" in a for n, a in zip(page.names, page.attributes))
    words = [len(w) for piece in page.texts for w in piece.split()]
    return {k: None if i is None else page.text(i) for k, i in at.items()} | {"links": links, "paragraphs": counts["p"], "text_chars": sum(words) + max(len(words) - 1, 0)}


def parsed(html: Column, function: Callable, returns: str, *parameters) -> Column:
    """A function of one page over batches of pages."""
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import DataType

    kind = to_arrow_type(DataType.fromDDL(returns))

    @F.arrow_udf(returns)
    def run(pages: pa.Array) -> pa.Array:
        return pa.array((function(p.as_py(), *parameters) for p in pages), kind)

    return run(html)
