"""HTML to page parts in one pass over a token pattern.

Each tag name has a row of flags; the pass looks the flags up and acts on
them, so the many tags that mean nothing cost one dictionary access.  Attributes
are parsed only for tags that need them.
"""

from __future__ import annotations

import re
from html import unescape
from urllib.parse import urljoin, urlsplit

# The element classes of the page graph.
HEADINGS = {"h1": 1, "h2": 2, "h3": 3, "h4": 4, "h5": 5, "h6": 6}
TEXT_TAGS = "p li td th dt dd blockquote figcaption caption label pre address summary legend option".split()
CONTAINER_TAGS = "div section article main header footer nav aside ul ol dl table tr tbody thead form body html figure details fieldset select".split()
REGION_TAGS = "nav footer aside header".split()
HIDDEN_TAGS = "script style noscript template svg iframe object".split()
STRONG_TAGS = "strong b em mark".split()
VOID_TAGS = "area base br col embed hr img input link meta param source track wbr".split()
APP_ROOTS = {"root", "app", "__next", "__nuxt"}
FEED_TYPES = {"application/rss+xml", "application/atom+xml", "application/feed+json"}
HEAD_RELS = {"next", "prev", "previous", "first", "last"}
DEAD_HREFS = ("javascript:", "mailto:", "tel:", "#")
HEADING_WEIGHT = {1: 4.0, 2: 3.0, 3: 2.5, 4: 2.0, 5: 2.0, 6: 2.0}
REGION_FACTOR = {"main": 1.0, "header": 0.6, "aside": 0.5, "nav": 0.3, "footer": 0.3}

_TEXT, _BOX, _REGION, _HIDDEN, _STRONG, _SPECIAL = 1, 2, 4, 8, 16, 32
_FLAGS: dict[str, int] = {}
for _names, _flag in ((HEADINGS, _TEXT), (TEXT_TAGS, _TEXT), (CONTAINER_TAGS, _BOX), (REGION_TAGS, _REGION), (HIDDEN_TAGS, _HIDDEN), (STRONG_TAGS, _STRONG), (["a", "br", "img", "meta", "link", "base", "title", "html", "tr"], _SPECIAL)):
    for _n in _names:
        _FLAGS[_n] = _FLAGS.get(_n, 0) | _flag
_VOID = frozenset(VOID_TAGS)

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""", re.S
)
#: A tag that the end of the page cuts off; it is no text.
UNFINISHED = re.compile(r"<[a-zA-Z/!?][^>]*\Z")
_ATTR = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_CLASS = re.compile(r"""\bclass\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_RAW_END = {n: re.compile(rf"</{n}\s*>", re.I) for n in ("script", "style")}


def clean(text: str) -> str:
    """Entities resolved, runs of blanks made one, ends trimmed."""
    if "&" in text:
        text = unescape(text)
    return " ".join(text.split())


def attributes(raw: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in _ATTR.finditer(raw):
        value = m[2] if m[2] is not None else m[3] if m[3] is not None else m[4] or ""
        out.setdefault(m[1].lower(), unescape(value) if "&" in value else value)
    return out


class Block:
    __slots__ = ("ancestry", "emphasis", "kind", "level", "region", "row", "section", "style", "text", "linked")


class Page:
    """What one page holds.  `style` of a block is the chain of open containers as (tag, class) pairs."""

    __slots__ = ("app_root", "blocks", "canonical", "feeds", "host", "images", "images_missing_alt", "itemprops", "lang", "links", "memo", "meta", "script_count", "scripts", "title", "url")

    def __init__(self, url: str):
        self.url, self.host = url, host_of(url)
        self.title = self.lang = self.canonical = ""
        self.meta: dict[str, str] = {}
        self.blocks: list[Block] = []
        self.links: list[tuple] = []
        self.feeds: list[str] = []
        self.scripts: list[tuple[str, str, str]] = []
        self.itemprops: list[tuple[str, str]] = []
        self.images = self.images_missing_alt = self.script_count = 0
        self.app_root = False
        #: What was found on this page before, by question.
        self.memo: dict = {}

    @property
    def text_chars(self) -> int:
        return sum(len(b.text) for b in self.blocks)


def host_of(url: str) -> str:
    try:
        return (urlsplit(url).hostname or "").lower()
    except ValueError:
        return ""


def _join(base: str, href: str) -> str:
    try:
        return urljoin(base, href)
    except ValueError:
        return href


def parse(html: str | None, url: str = "", links: bool = True, follow: bool = True) -> Page:
    """The page graph of html; with links=False only title and blocks, with follow=False all but links, for passes that need no more."""
    page = Page(url)
    if not html:
        return page
    base, blocks = url, page.blocks
    buf: list[str] = []
    kind = "text"
    linked = 0  # characters of the current buffer that lie in anchors
    sections: list[tuple[int, str]] = []
    boxes: list[tuple[str, int, str]] = []
    box_ids: tuple[int, ...] = ()
    style: tuple[tuple[str, str], ...] = ()
    boxed = rows = 0
    row: int | None = None
    depth = dict.fromkeys(REGION_TAGS, 0)
    region = "main"
    strong, strong_buf, strong_now = 0, [], []
    anchor: dict | None = None
    anchor_buf: list[str] = []
    open_props: list[tuple[str, str, list[str]]] = []
    title_buf: list[str] | None = None

    def flush() -> None:
        nonlocal buf, kind, strong_buf, linked
        if buf:
            text = clean("".join(buf))
            if text:
                b = Block()
                b.kind, b.text, b.region, b.style = kind, text, region, style
                b.section = tuple(t for _, t in sections)
                b.emphasis = [t for t in map(clean, strong_buf) if t]
                b.row = row if kind in ("td", "th") else None
                b.level = HEADINGS.get(kind)
                b.ancestry, b.linked = box_ids, linked
                blocks.append(b)
                if b.level:
                    while sections and sections[-1][0] >= b.level:
                        sections.pop()
                    sections.append((b.level, text))
            buf = []
        linked = 0
        strong_buf = []
        kind = "text"

    def text_in(data: str) -> None:
        nonlocal linked
        if title_buf is not None:
            title_buf.append(data)
            return
        buf.append(data)
        if strong:
            strong_now.append(data)
        if anchor is not None:
            anchor_buf.append(data)
            linked += len(data)
        for _, _, held in open_props:
            held.append(data)

    def close_region() -> str:
        return next((r for r in REGION_TAGS if depth[r]), "main")

    at, hidden, hidden_depth, script = 0, "", 0, None
    pos = 0
    token = _TOKEN.search
    while True:
        m = token(html, pos)
        end = m.start() if m else len(html)
        if end > at and not hidden:
            text_in(html[at:end] if m else UNFINISHED.sub("", html[at:end]))
        if m is None:
            break
        at = pos = m.end()
        name = m[2] or m[5]
        if name is None:
            continue
        name = name.lower()
        closing = (m[1] or m[4]) == "/"
        raw = (m[3] if m[2] else m[6]) or ""
        if hidden:
            if name == hidden:
                if closing:
                    hidden_depth -= 1
                    if not hidden_depth:
                        hidden = ""
                elif name not in _VOID and not raw.endswith("/"):
                    hidden_depth += 1
            continue
        flags = _FLAGS.get(name, 0)
        if not closing:
            if flags & _HIDDEN:
                if name == "script":
                    page.script_count += 1
                    if raw and ("json" in raw.lower() or "__NEXT_DATA__" in raw):
                        a = attributes(raw)
                        t = a.get("type", "").lower()
                        if t in ("application/ld+json", "application/json") or a.get("id") == "__NEXT_DATA__":
                            script = ("jsonld" if "ld+json" in t else "embedded_json", a.get("id", ""))
                if raw.endswith("/"):
                    script = None
                    continue
                if name in _RAW_END:
                    e = _RAW_END[name].search(html, pos)
                    stop = e.start() if e else len(html)
                    if script is not None:
                        if e:
                            page.scripts.append((*script, html[pos:stop]))
                        script = None
                    at = pos = e.end() if e else len(html)
                else:
                    hidden, hidden_depth = name, 1
                continue
            if flags & _SPECIAL:
                if name == "br":
                    buf.append(" ")
                    continue
                if name == "a":
                    anchor, anchor_buf = (attributes(raw) if links else {}), []
                elif name == "title" and not page.title:
                    title_buf = []
                    continue
                elif name == "img":
                    page.images += 1
                    if not attributes(raw).get("alt", "").strip():
                        page.images_missing_alt += 1
                    continue
                elif name == "html":
                    page.lang = attributes(raw).get("lang") or page.lang
                elif name in ("meta", "link"):
                    if links and (follow or name == "meta"):
                        (_meta if name == "meta" else _head_link)(page, attributes(raw), base)
                    continue
                elif name == "base":
                    href = attributes(raw).get("href")
                    if href:
                        base = _join(base, href)
                        continue
            if raw:
                if name == "div" and "id" in raw and attributes(raw).get("id") in APP_ROOTS:
                    page.app_root = True
                if "itemprop" in raw:
                    a = attributes(raw)
                    if "itemprop" in a:
                        if a.get("content"):
                            page.itemprops.append((a["itemprop"], a["content"]))
                        else:
                            open_props.append((name, a["itemprop"], []))
            if flags & (_TEXT | _BOX):
                flush()
                if flags & _REGION:
                    depth[name] += 1
                    region = close_region()
                if name == "tr":
                    rows += 1
                    row = rows
                if flags & _TEXT:
                    kind = name
                if flags & _BOX:
                    boxed += 1
                    c = _CLASS.search(raw) if raw else None
                    boxes.append((name, boxed, (c[1] or c[2] or c[3] or "") if c else ""))
                    box_ids = (*box_ids, boxed)
                    style = (*style, (name, boxes[-1][2]))
            elif flags & _STRONG:
                strong += 1
                strong_now = []
            if not (raw.endswith("/") and name not in _VOID):
                continue
        # An end tag, or the end of a tag that closes itself.
        if name == "title" and title_buf is not None:
            page.title = clean("".join(title_buf))
            title_buf = None
            continue
        if open_props and open_props[-1][0] == name:
            _, prop, held = open_props.pop()
            value = clean("".join(held))
            if value:
                page.itemprops.append((prop, value))
        if flags & _STRONG and strong:
            strong -= 1
            if not strong:
                strong_buf.append("".join(strong_now))
        if name == "a" and anchor is not None:
            if links and follow:
                _finish(page, anchor, "".join(anchor_buf), base, len(blocks))
            anchor = None
        if flags & (_TEXT | _BOX):
            flush()
        if flags & _BOX:
            for i in range(len(boxes) - 1, -1, -1):
                if boxes[i][0] == name:
                    del boxes[i:]
                    box_ids, style = box_ids[:i], style[:i]
                    break
            if name == "tr":
                row = None
            if flags & _REGION and depth[name]:
                depth[name] -= 1
                region = close_region()
    flush()
    return page


def _meta(page: Page, a: dict[str, str], base: str) -> None:
    if a.get("charset"):
        page.meta.setdefault("charset", a["charset"])
    key = (a.get("name") or a.get("property") or a.get("itemprop") or "").lower()
    if key and "content" in a:
        page.meta.setdefault(key, clean(a["content"]))
        if a.get("itemprop"):
            page.itemprops.append((a["itemprop"], a["content"]))


def _head_link(page: Page, a: dict[str, str], base: str) -> None:
    rel, href = a.get("rel", "").lower().split(), a.get("href", "")
    if not href:
        return
    target = _join(base, href)
    if "canonical" in rel:
        page.canonical = target
    if "alternate" in rel and a.get("type", "").lower() in FEED_TYPES:
        page.feeds.append(target)
    if HEAD_RELS.intersection(rel):
        page.links.append((target, "", host_of(target) == page.host, "nofollow" in rel, None, list(dict.fromkeys(rel))))


def _finish(page: Page, a: dict[str, str], text: str, base: str, block_id: int) -> None:
    href = a.get("href", "").strip()
    if not href or href.startswith(DEAD_HREFS):
        return
    target, rel = _join(base, href), list(dict.fromkeys(a.get("rel", "").lower().split()))
    page.links.append((target, clean(text), host_of(target) == page.host, "nofollow" in rel, block_id, rel))
