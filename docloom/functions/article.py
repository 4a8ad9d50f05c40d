"""Main article of a page: its title and markdown, without the page's chrome.

Elements close as in HTML: a block ends an open paragraph, an item the item before it, an end tag all that its
element still holds. Text of an ``article`` is preferred, then that of ``main``, then that of the whole page.
"""

from __future__ import annotations

import re

from docloom.functions.sectioning import BLANK, DROPPED, _Markdown, tidied

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr b bdi bdo cite code del dfn em font i ins kbd label mark q s samp small span strong sub sup time tt u var".split())
ITEMS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
HOLDS = {"li": frozenset(["ul", "ol", "menu"]), "dt": frozenset(["dl"]), "dd": frozenset(["dl"])}
EDGES = frozenset("table html article main section aside nav header footer".split())
# Words of classes that name chrome; roles that do; elements that a class never makes chrome.
CHROME = "ads?|advert|adverts|advertisement|advertising|banner|breadcrumbs?|comments?|cookies?|disqus|masthead|menu|menubar|modal|nav|navbar|navigation|newsletter|pager|paginat(?:ion|or)|popup|promo|promotion|related|share|sharing|sidebar|site[-_](?:header|footer)|social|sponsor|sponsored|subscribe|subscription|teaser|toc|toolbar|widget"
WHOLE = re.compile(f"(?:{CHROME})", re.I)
PART = re.compile(f"(?!(?:has|with|without|no|is|show|hide|not)[-_])(?:(?:{CHROME})[-_].*|.*[-_](?:{CHROME}))", re.I)
ROLES = frozenset("navigation banner contentinfo complementary search".split())
KEPT = frozenset("html body main h1 h2 h3 h4 h5 h6 pre code".split())
ARTICLE, MAIN = 1, 2


def is_chrome(tag: str, attrs: dict[str, str | None]) -> bool:
    """By role or class; an article only by a whole class, as its other classes name its topics."""
    if tag in KEPT:
        return False
    names = (attrs.get("class") or "").split()
    return (attrs.get("role") or "").strip().lower() in ROLES or any(WHOLE.fullmatch(x) or tag != "article" and PART.fullmatch(x) for x in names)


class _Article(_Markdown):
    """Pieces of markdown outside chrome, each with the kinds of root that it stands in."""

    def __init__(self):
        super().__init__()
        self.open: list[list] = []  # [tag, chrome: 2 by element, 1 by class, 0, root]
        self.count: dict = {}  # open elements by tag, by ("chrome", kind) and by ("root", kind)
        self.kinds: list[int] = []
        self.weight = dict.fromkeys((0, ARTICLE, MAIN, ARTICLE | MAIN), 0)
        self.names: dict[str, str] = {}  # title by its place: og, title, h1
        self.naming: str | None = None

    def _add(self, key, n):
        self.count[key] = self.count.get(key, 0) + n

    def _hidden(self):
        return self.count.get(("chrome", 1), 0) + self.count.get(("chrome", 2), 0) > 0

    def _mark(self):
        kind = sum(k for k in (ARTICLE, MAIN) if self.count.get(("root", k)))
        self.kinds += [kind] * (len(self.out) - len(self.kinds))
        return kind

    def _leave(self, k):
        """Close the open element at k alone."""
        tag, chrome, root = self.open.pop(k)
        if not self._hidden():
            super().handle_endtag(tag)
            self._mark()
        self._add(tag, -1)
        self._add(("chrome", chrome), -1)
        self._add(("root", root), -1)
        if tag in ("title", "h1"):
            self.naming = None

    def _close(self, tags, edges):
        """Close the innermost of the tags inside the nearest edge, with all that it holds."""
        if any(self.count.get(t) for t in tags):
            for k in range(len(self.open) - 1, -1, -1):
                if self.open[k][0] in tags:
                    while len(self.open) > k:
                        self._leave(len(self.open) - 1)
                    return
                if self.open[k][0] in edges:
                    return

    def handle_starttag(self, tag, attrs):
        attrs = dict(attrs)
        if tag == "meta" and (attrs.get("property") or "").lower() == "og:title":
            self.names.setdefault("og", attrs.get("content") or "")
        if tag not in INLINE and tag not in VOID or tag == "hr":
            # A paragraph holds no block, so that the nearest one above inline elements is the only one open.
            for k in range(len(self.open) - 1, -1, -1):
                if self.open[k][0] not in INLINE:
                    if self.open[k][0] == "p":
                        self._close(("p",), ())
                    break
        if tag in ITEMS:
            self._close(ITEMS[tag], HOLDS.get(tag, frozenset()) | EDGES)
        code = self.count.get("pre") or self.count.get("code")
        chrome = 2 if tag in DROPPED else 1 if not code and is_chrome(tag, attrs) else 0
        is_main = tag == "main" or (attrs.get("role") or "").lower() == "main"
        if is_main and not self.count.get(("chrome", 2)):
            for x in self.open:  # a page's layout may be named after its menu
                self._add(("chrome", x[1]), -1)
                x[1] = 0
                self._add(("chrome", 0), 1)
        if tag in VOID:
            if not self._hidden() and not chrome:
                super().handle_starttag(tag, list(attrs.items()))
                self._mark()
            return
        if tag == "title" and not self.count.get("svg") or tag == "h1" and not self._hidden():
            self.naming = None if tag in self.names else tag
        root = 0 if self._hidden() or chrome else MAIN if is_main else ARTICLE if tag == "article" else 0
        self.open.append([tag, chrome, root])
        self._add(tag, 1)
        self._add(("chrome", chrome), 1)
        self._add(("root", root), 1)
        if not self._hidden():
            super().handle_starttag(tag, list(attrs.items()))
            self._mark()

    def handle_startendtag(self, tag, attrs):
        # A slash has no meaning but in drawings, whose content is dropped.
        if not self.count.get("svg") and tag != "svg":
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if not self.count.get(tag):
            return
        if tag not in INLINE:
            self._close((tag,), EDGES - {tag} if tag in ("p", "li", "dt", "dd") else ())
            return
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                self._leave(k)
                return

    def handle_data(self, data):
        if self.naming:
            self.names[self.naming] = self.names.get(self.naming, "") + data
        if not self._hidden():
            super().handle_data(data)
            self.weight[self._mark()] += sum(not c.isspace() for c in data)


def article(page: str) -> tuple[str | None, str | None]:
    """(title, markdown) of a page's main article; no markdown if nothing readable is left.

    The articles must hold half of the readable text of the main part, where there is one, so that teasers in it
    don't take its place.
    """
    reader = _Article()
    reader.feed(page)
    reader.close()
    while reader.open:
        reader._leave(len(reader.open) - 1)
    title = next((t for t in (" ".join(reader.names.get(k, "").split()) for k in ("og", "title", "h1")) if t), None)
    w = reader.weight
    in_article, in_main = w[ARTICLE] + w[ARTICLE | MAIN], w[MAIN] + w[ARTICLE | MAIN]
    if in_article and 2 * in_article >= in_main:
        wanted = ARTICLE
    elif in_main:
        wanted = MAIN
    elif w[0]:
        wanted = 0
    else:
        return title, None
    text = tidied("".join(x for x, k in zip(reader.out, reader.kinds, strict=True) if k & wanted == wanted))
    return title, text.strip(BLANK) or None
