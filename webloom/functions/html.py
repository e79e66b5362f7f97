"""HTML pages as forgiving trees, and what a page says about itself.

Void elements have no content; a ``p`` or ``li`` closes another that is the innermost open
element; a close tag that fits an outer element closes those within it; one that
fits none is dropped; what is open at the end is closed there. Comments and doctypes are dropped.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser
from typing import Any
from urllib.parse import urljoin, urlsplit

from webloom.functions.bitmask import DocumentFeature, DocumentFlag

# Elements without content.
VOID = frozenset("area base br col command embed hr img input keygen link meta param source track wbr".split())
# Elements that don't nest directly.
UNNESTABLE = frozenset("p li".split())
# Elements whose text isn't content.
NOT_CONTENT = frozenset(
    "style script noscript li ul ol iframe form nav object source svg template track select option button canvas nav h1 h2 h3 h4 h5 h6 sup sub".split()
)


@dataclass
class Element:
    tag: str
    attributes: dict[str, str | None]
    children: list[Element | str] = field(default_factory=list)

    def get(self, name: str) -> str | None:
        return self.attributes.get(name)

    def has_class(self, name: str) -> bool:
        return name in (self.get("class") or "").split(" ")


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Element("", {})
        self.open = [self.root]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in UNNESTABLE and self.open[-1].tag == tag:
            self.open.pop()
        element = Element(tag, dict(reversed(attrs)))
        self.open[-1].children.append(element)
        if tag not in VOID:
            self.open.append(element)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.open[-1].children.append(Element(tag, dict(reversed(attrs))))

    def handle_endtag(self, tag: str) -> None:
        for depth in range(len(self.open) - 1, 0, -1):
            if self.open[depth].tag == tag:
                del self.open[depth:]
                return

    def handle_data(self, data: str) -> None:
        self.open[-1].children.append(data)


def parse(text: str) -> Element:
    """The tree of a page below a nameless root; any text has one."""
    builder = _Builder()
    builder.feed(text)
    builder.close()
    return builder.root


Selector = Callable[[Element], bool]


def tag(name: str) -> Selector:
    return lambda e: e.tag == name


def selector(css: str) -> Selector:
    """``div.content``, ``td.main``, ``div#comments``, ``article``, ``.MathJax``."""
    m = re.fullmatch(r"([\w-]*)(?:([.#])([\w-]+))?", css)
    if m is None:
        raise ValueError(css)
    name, kind, value = m.groups()
    return lambda e: (not name or e.tag == name) and (kind is None or (e.has_class(value) if kind == "." else e.get("id") == value))


def every(root: Element, test: Selector) -> Iterator[Element]:
    """Matching elements in document order; a match isn't searched for further ones."""
    for child in root.children:
        if isinstance(child, Element):
            if test(child):
                yield child
            else:
                yield from every(child, test)


def raw_text(e: Element) -> Iterator[str]:
    for child in e.children:
        if isinstance(child, Element):
            yield from raw_text(child)
        else:
            yield child


def flat(pieces: Iterator[str] | list[str]) -> str:
    """Stripped pieces that aren't empty, one blank between."""
    return " ".join(s for p in pieces if (s := p.strip()))


def text(e: Element) -> str:
    return flat(raw_text(e))


def content_text(e: Element) -> str:
    """Text outside NOT_CONTENT elements, the given one not counted."""

    def walk(x: Element) -> Iterator[str]:
        for child in x.children:
            if isinstance(child, str):
                yield child
            elif child.tag not in NOT_CONTENT:
                yield from walk(child)

    return flat(walk(e))


def serialise(e: Element | str) -> str:
    if isinstance(e, str):
        return e
    inner = "".join(map(serialise, e.children))
    if not e.tag:
        return inner
    attributes = "".join(f" {k}" if v is None else f' {k}="{v}"' for k, v in e.attributes.items())
    return f"<{e.tag}{attributes}>" if e.tag in VOID else f"<{e.tag}{attributes}>{inner}</{e.tag}>"


# Where the main content is looked for, in this order.
CONTENT = ["div.entry-content", "div.content", "div.pjgm-postcontent", "div.PostsPage-postContent", "div.ArticleBody-articleBody", "div#mw-content-text", "article", "main", "div#content", "td.mainsection", "body"]
# Where comments are looked for, in this order.
COMMENTS = ["div.comments-area", "div.comments-page", "div.comments", "div.PostsPage-commentsSection", "div#comments"]
# What a script that shows or counts ads contains.
AD_SIGNS = ["adsbygoogle", "pubads()", "GTM-", "googletag", "fbq(", "moatvideo", "MonsterInsights"]
# The flag of a page by its declared type.
TYPE_FLAGS = {
    "AggregateOffer": DocumentFlag.SHOPPING, "AmpStory": DocumentFlag.ANTICOMPETITIVE_TECH, "Clip": DocumentFlag.MEDIA, "Episode": DocumentFlag.MEDIA, "ItemList": DocumentFlag.LISTICLE,
    "Movie": DocumentFlag.MEDIA, "NewsArticle": DocumentFlag.NEWS, "Offer": DocumentFlag.SHOPPING, "Product": DocumentFlag.SHOPPING, "TVSeason": DocumentFlag.MEDIA, "TVSeries": DocumentFlag.MEDIA,
}


def first_filled(root: Element, selectors: list[str]) -> str:
    """Content of the first selector with any: of its first element that isn't empty."""
    for css in selectors:
        for e in every(root, selector(css)):
            if found := content_text(e):
                return found
    return ""


def headings(root: Element) -> str:
    return flat([text(e) for name in ("h1", "h2") for e in every(root, tag(name))])


def numbered_list(texts: list[str]) -> bool:
    """Whether headings count something: four numbers or more, nearly even steps, the first of one, few repeats, no years."""
    numbers: list[float] = []
    for t in texts:
        digits = re.match(r"[\d.]*", t.strip())[0]  # type: ignore[index]
        try:
            numbers.append(float(digits + "0" if digits.endswith(".") else digits))
        except ValueError:
            continue
    distinct = len(set(numbers))
    if distinct < 4:
        return False
    steps = [a - b for a, b in zip(numbers, numbers[1:], strict=False)]
    return len(set(steps)) <= min(2, max(1, distinct - 2)) and len(numbers) - distinct <= 2 and abs(steps[0]) == 1 and round(min(numbers)) <= 1600


def is_listicle(root: Element) -> bool:
    return any(numbered_list([t for e in every(root, tag(h)) if (t := text(e))]) for h in ("h1", "h2", "h3"))


def linked_data(root: Element) -> list[Any]:
    """What the page's ld+json scripts hold; broken ones are passed over."""
    out = []
    for e in every(root, lambda e: e.tag == "script" and e.get("type") == "application/ld+json"):
        try:
            out.append(json.loads("".join(raw_text(e))))
        except ValueError:
            continue
    return out


def is_free(data: Any) -> bool:
    """``isAccessibleForFree`` if it is a JSON boolean, else that of ``hasPart``, else true."""
    if not isinstance(data, dict):
        return True
    value = data.get("isAccessibleForFree")
    if isinstance(value, bool):
        return value
    part = data.get("hasPart")
    return is_free(part) if isinstance(part, dict) else True


def pollution(root: Element, host: str) -> int:
    """The page's own flags: declared type, ads, paywall, listicle."""
    mask = 0
    exempt = "substack.com" in host or "medium.com" in host
    data = linked_data(root)
    for d in data:
        kind = d.get("@type") if isinstance(d, dict) else None
        if isinstance(kind, str) and kind in TYPE_FLAGS and not (kind == "NewsArticle" and exempt):
            mask |= TYPE_FLAGS[kind]
    scripts = [(e.get("src") or "", "".join(raw_text(e))) for e in every(root, tag("script"))]
    if any(AD_SIGNS[0] in src or any(s in inner for s in AD_SIGNS) for src, inner in scripts):
        mask |= DocumentFlag.ADS
    if not all(map(is_free, data)):
        mask |= DocumentFlag.PAYWALLED
    if is_listicle(root):
        mask |= DocumentFlag.LISTICLE
    return int(mask)


def page_features(root: Element) -> int:
    mask = 0
    if next(every(root, tag("code")), None):
        mask |= DocumentFeature.CODE
    if next(every(root, selector(".MathJax")), None):
        mask |= DocumentFeature.MATH
    board = [e for e in every(root, tag("meta")) if e.get("name") == "generator" and (e.get("content") or "").startswith(("vBulletin", "Discourse"))]
    if board or any(e.get("id") == "phpbb" for e in every(root, tag("body"))):
        mask |= DocumentFeature.FORUM
    return int(mask)


def resolved(base: str, reference: str | None) -> str | None:
    """An address relative to the page; None if it is none."""
    if reference is None:
        return None
    try:
        found = urljoin(base, reference.strip().replace(" ", "%20"))
        urlsplit(found)
    except ValueError:
        return None
    return found or None


def page_signals(uri: str, page: str) -> dict[str, Any]:
    """Everything derived from one page, which is parsed once."""
    root = parse(page)
    host = urlsplit(uri).hostname or "" if uri else ""
    scripts = list(every(root, tag("script")))
    sheets = [e for e in every(root, tag("link")) if e.get("rel") == "stylesheet"]
    canonical = [e.get("href") for e in every(root, tag("link")) if e.get("rel") == "canonical" and urlsplit(e.get("href") or "").scheme]
    links = {r for e in every(root, tag("a")) if (r := resolved(uri, e.get("href")))}
    title = next(every(root, tag("title")), None)
    return {
        "title": text(title) if title else "",
        "headings": headings(root),
        "content": first_filled(root, CONTENT),
        "comments": first_filled(root, COMMENTS),
        "canonical": canonical[0] if canonical else None,
        "links": sorted(links),
        "scripts": [r for e in scripts if (r := resolved(uri, e.get("src")))],
        "styles": [r for e in sheets if (r := resolved(uri, e.get("href")))],
        "script_chars": sum(len(text(e)) for e in scripts),
        "style_chars": sum(len(text(e)) for e in every(root, tag("style"))),
        "tweets": sum(1 for _ in every(root, selector("blockquote.twitter-tweet"))),
        "gifs": sum(1 for e in every(root, tag("img")) if (e.get("src") or "").endswith(".gif")),
        "flags": pollution(root, host),
        "features": page_features(root),
    }


SIGNAL_SCHEMA = (
    "title string, headings string, content string, comments string, canonical string, links array<string>, scripts array<string>, styles array<string>, "
    "script_chars long, style_chars long, tweets int, gifs int, flags long, features long"
)
