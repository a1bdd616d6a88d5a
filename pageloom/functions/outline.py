"""A lean pass over HTML: visible text blocks and the chain of styled containers that holds each.

It numbers blocks as the full page graph does, but keeps neither links nor
sections, so it costs a fraction of that.  All tags come from one findall.
"""

from __future__ import annotations

import re
from html import unescape

from pageloom.functions.markup import CONTAINER_TAGS, HEADINGS, HIDDEN_TAGS, TEXT_TAGS, UNFINISHED

_HIDDEN = re.compile(rf"<!--.*?(?:-->|\Z)|<({'|'.join(HIDDEN_TAGS)}|title)\b[^>]*>.*?(?:</\1\s*>|\Z)", re.S | re.I)
_TAG = re.compile(r"""<(/?)([a-zA-Z][a-zA-Z0-9]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+(?=>)|[^>]*+)>([^<]*+(?:<(?![a-zA-Z/!?])[^<]*+)*+)""")
_DECLARED = re.compile(r"<[!?][^>]*>")
_CLASS = re.compile(r"""\bclass\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_OPEN = {**dict.fromkeys(TEXT_TAGS, 1), **dict.fromkeys(HEADINGS, 1), **dict.fromkeys(CONTAINER_TAGS, 2), "a": 3, "br": 4}
#: Containers that only arrange items; without a class they belong to the container around them.
_ARRANGE = frozenset("ul ol dl table tr tbody thead html".split())


class Outliner:
    """Chains of styled containers as small integers, kept over the pages of a task."""

    def __init__(self) -> None:
        self._ids: dict[tuple[int, str, str], int] = {}
        self.chains: list[tuple[str, ...]] = [()]

    def _child(self, parent: int, name: str, raw: str) -> int:
        c = _CLASS.search(raw) if raw else None
        cls = (c[1] or c[2] or c[3] or "") if c else ""
        if not cls and name in _ARRANGE:
            return parent
        chain = (*self.chains[parent], f"{name}.{cls}" if cls else name)
        key = (parent, name, "\0" + cls)
        if key not in self._ids:
            self._ids[key] = len(self.chains)
            self.chains.append(chain)
        return self._ids[key]

    def blocks(self, html: str) -> list[tuple[int, str, str, int]]:
        """(chain, kind, text, characters in anchors) of each block, in document order."""
        if len(self.chains) > 200_000:
            self.__init__()
        if "<script" in html or "<noscript" in html or "<!--" in html or "<title" in html or "<style" in html or "<template" in html or "<svg" in html or "<iframe" in html or "<object" in html:
            html = _HIDDEN.sub("", html)
        out: list[tuple[int, str, str, int]] = []
        ids, opens = self._ids, _OPEN.get
        stack: list[tuple[str, int]] = []
        chain, kind, linked, anchor = 0, "text", 0, False
        opening = _TAG.search(html)
        head = html[: opening.start()] if opening else html
        if "<" in head:
            head = UNFINISHED.sub("", _DECLARED.sub("", head))
        buf = [head] if head else []
        for slash, name, raw, text in _TAG.findall(html):
            what = opens(name) or opens(name.lower(), 0)
            if what == 1 or what == 2:
                if buf:
                    t = "".join(buf)
                    if "&" in t:
                        t = unescape(t)
                    t = " ".join(t.split())
                    if t:
                        out.append((chain, kind, t, linked))
                    buf = []
                linked = 0
                kind = "text"
                if what == 1:
                    if not slash:
                        kind = name.lower()
                elif not slash:
                    stack.append((name, chain))
                    known = ids.get((chain, name, raw))
                    if known is None:
                        known = ids[chain, name, raw] = self._child(chain, name.lower(), raw)
                    chain = known
                else:
                    for i in range(len(stack) - 1, -1, -1):
                        if stack[i][0] == name:
                            chain = stack[i][1]
                            del stack[i:]
                            break
            elif what == 3:
                anchor = not slash
            elif what == 4:
                buf.append(" ")
            if text:
                buf.append(text)
                if anchor:
                    linked += len(text)
        if buf:
            t = " ".join(unescape("".join(buf)).split())
            if t:
                out.append((chain, kind, t, linked))
        return out
