"""Pagination and groups of links of one page."""

from __future__ import annotations

import re
from urllib.parse import parse_qsl, urlencode, urlsplit, urlunsplit

from pageloom.functions import patterns as P
from pageloom.functions import scalars as S

_WORDS = {**dict.fromkeys(P.PREV_WORDS, "prev"), **dict.fromkeys(P.NEXT_WORDS, "next"), **dict.fromkeys(P.FIRST_WORDS, "first"), **dict.fromkeys(P.LAST_WORDS, "last")}
_RELS = [("last", "last"), ("next", "next"), ("prev", "prev"), ("previous", "prev"), ("first", "first")]
_IN_PATH = [re.compile(rf"/(?:page|seite|p){sep}(\d+)(?=/|$)", re.I) for sep in ("/", "[-_]")]


def clean_url(url: str) -> str:
    try:
        u = urlsplit(url)
    except ValueError:
        return url
    return urlunsplit((u.scheme, u.netloc, u.path or "/", u.query, ""))


def host_of(url: str) -> str:
    try:
        return (urlsplit(url).hostname or "").lower()
    except ValueError:
        return ""


def _kind(key: str) -> str | None:
    k = re.sub("[^a-z0-9]+", "", key.lower())
    if k in ("p", "pg") or "page" in k or "seite" in k:
        return "page"
    return "offset" if k in ("offset", "start", "skip") or "offset" in k or "startindex" in k else None


def marker(url: str | None) -> tuple[str, int, str] | None:
    """(kind, number, template) of the first page-like number in a URL."""
    if not url or not re.search(r"\d", url):
        return None
    try:
        u = urlsplit(url)
    except ValueError:
        return None
    pairs = parse_qsl(u.query, keep_blank_values=True)
    for i, (key, value) in enumerate(pairs):
        kind = _kind(key)
        if kind and value.isdigit():
            filled = urlencode([*pairs[:i], (key, f"{{{kind}}}"), *pairs[i + 1 :]], safe="{}[]")
            return kind, int(value), urlunsplit((u.scheme, u.netloc, u.path, filled, ""))
    for p in _IN_PATH:
        m = p.search(u.path)
        if m:
            return "page", int(m[1]), urlunsplit((u.scheme, u.netloc, f"{u.path[: m.start(1)]}{{page}}{u.path[m.end(1) :]}", u.query, ""))
    return None


def meaning(text: str, rel: list[str]) -> str | None:
    for r, what in _RELS:
        if r in rel:
            return what
    word = S.fold(text)
    tight = _WORDS.get(word.replace(" ", ""))
    both = {_WORDS.get(word), tight}
    return next((w for w in ("last", "first", "next", "prev") if w in both), None)


def paging(url: str, canonical: str | None, links: list[tuple[str, str, bool, list[str]]]) -> tuple[dict, list[dict]]:
    """Pagination and groups of a page with links (href, text, internal, rel) in document order."""
    inner = [(clean_url(h), S.normalize(t), rel) for h, t, internal, rel in links if internal]
    path, here = urlsplit(url).path if url else "", clean_url(url)
    said: dict[str, str] = {}
    numbers: dict[str, dict[int, str]] = {"page": {}, "offset": {}}
    own: dict[str, None] = {}
    by_rel = False
    for href, text, rel in inner:
        what, mark = meaning(text, rel), marker(href)
        if what:
            own[href] = None
            if what == "last" and what not in said:
                by_rel = "last" in rel
            said.setdefault(what, href)
        if mark and (what or text.isdigit() or urlsplit(href).path == path):
            own[href] = None
            numbers[mark[0]].setdefault(mark[1], href)
    pages, offsets = numbers["page"], numbers["offset"]
    now = marker(url)
    page = now[1] if now and now[0] == "page" else 1 if pages or said.get("next") or said.get("last") else None
    offset = now[1] if now and now[0] == "offset" else None
    end = marker(said.get("last"))
    last = end[1] if end and end[0] == "page" else None
    last_offset = end[1] if end and end[0] == "offset" else None
    last_url, evidence = said.get("last"), ("rel=last" if by_rel else "last-control") if "last" in said else None
    order = sorted(pages)
    if last is None and len(order) >= 3 and order[-1] > order[-2] + 1 and order[0] <= 2:
        last, last_url, evidence = order[-1], pages[order[-1]], "terminal-page-gap"
    counted = page is not None and last is not None
    nxt = said.get("next") or (pages.get(page + 1) if counted and page < last else None)
    more = page < last if counted else offset < last_offset if offset is not None and last_offset is not None else bool(nxt)
    model = last_url or nxt or (pages[order[-1]] if order else None) or (offsets[max(offsets)] if offsets else None)
    shape = marker(model)
    kinds = [k for k in ("page", "offset") if numbers[k] or (shape and shape[0] == k)]
    out = {
        "detected": bool(own), "kind": kinds[0] if kinds else None, "current_page": page, "current_offset": offset, "last_page": last, "last_offset": last_offset, "highest_visible_page": order[-1] if order else None,
        "highest_visible_offset": max(offsets) if offsets else None, "next_url": nxt, "prev_url": said.get("prev"), "first_url": said.get("first"), "last_url": last_url, "last_evidence": evidence,
        "bounded": bool(last_url) or last is not None or last_offset is not None, "has_next": more, "remaining_pages": max(0, last - page) if counted else None, "template": shape[2] if shape else None, "visible_page_numbers": order[:50],
    }
    skip = {*own, here, *([clean_url(canonical)] if canonical else [])}
    host, scope = host_of(here), S.scope_of(here)
    groups: dict[str, dict[str, str]] = {}
    for href, text, _ in inner:
        if href not in skip and host_of(href) == host:
            s = S.scope_of(href)
            if s != scope:
                groups.setdefault(s, {}).setdefault(href, text)
    shown = [
        {"scope": s, "kind": "detail_candidates" if "*" in s or len({urlsplit(h).path for h in g}) == 1 else "child_candidates", "count": len(g), "items": [{"url": h, "text": t} for h, t in g.items()]}
        for s, g in sorted(groups.items(), key=lambda x: (-len(x[1]), x[0])) if len(g) > 1
    ]
    return out, shown
