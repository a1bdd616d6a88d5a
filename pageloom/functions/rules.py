"""Rules compiled from one page: a pattern that finds a field's value by what stands left of it."""

from __future__ import annotations

import re

from pageloom.functions import patterns as P
from pageloom.functions import scalars as S

# Lengths of anchors tried, matches looked at, how far left a label may be.
ANCHORS = (16, 24, 32, 48, 64, 96, 128, 160)
OCCURRENCES, LABEL_REACH = 8, 300
_TAGS = re.compile(r"<[^>]+>")
_PIECE = re.compile(r"\s+|\d+|<|>|[^\s\d<>]+")


def apply_rule(pattern: str, html: str) -> str | None:
    """What the rule finds in the page, without tags; null without a match or with a broken pattern."""
    try:
        m = re.search(pattern, html or "", re.S | re.I)
    except re.error:
        return None
    return S.normalize(_TAGS.sub(" ", m[1] if m.re.groups else m[0])) if m else None


def anchor(left: str) -> str:
    """The source left of a value as a pattern: blanks are optional, numbers in tags and long numbers are any number."""
    opened, closed = left.find("<"), left.find(">")
    in_tag = closed >= 0 and not 0 <= opened < closed
    out = []
    for piece in _PIECE.findall(left):
        if piece[0].isspace():
            out.append(r"\s*")
        elif piece[0].isdigit():
            out.append(r"\d+" if in_tag or len(piece) > 2 else piece)
        else:
            in_tag = True if piece == "<" else False if piece == ">" else in_tag
            out.append(re.escape(piece))
    return "".join(out)


def _fits(pattern: str, html: str, value: str, kind: str) -> bool:
    try:
        hits = [m[1] for m in re.finditer(pattern, html, re.S | re.I)]
    except re.error:
        return False
    return bool(hits) and S.equivalent(_TAGS.sub(" ", hits[0]), value, kind) and len(set(map(S.normalize, hits))) == 1


def compile_rule(html: str, value: str, kind: str, label: str | None = None) -> str | None:
    """A pattern whose first match on this page is `value` and whose matches all agree; null if none is found.

    Anchors that begin at the label come first, then the shortest piece of
    markup that will do."""
    spots = []
    for m in re.finditer(S.value_pattern(value), html, re.I):
        spots.append(m)
        if len(spots) == OCCURRENCES:
            break
    capture = f"({P.CAPTURES[kind]})" if kind in P.CAPTURES else r"([^<]{1,300}?)"

    def rule(start: int, spot: re.Match) -> str:
        follows = html[spot.end() : spot.end() + 1]
        ahead = rf"(?={P.SOURCE_WS}*<)" if follows in ("", "<") else "" if kind in P.CAPTURES else f"(?={re.escape(follows)})"
        return f"{anchor(html[start : spot.start()])}{P.SOURCE_WS}*{capture}{ahead}"

    def starts():
        if label:
            find = re.compile(S.value_pattern(label), re.I)
            for spot in spots:
                near = [m.start() for m in find.finditer(html, max(0, spot.start() - LABEL_REACH), spot.start())]
                if near:
                    yield near[-1], spot
        for n in ANCHORS:
            for spot in spots:
                start = max(0, spot.start() - n)
                tag = html.find("<", start, spot.start())
                # Half a window at most is given up to begin at a tag.
                if start < tag < start + (spot.start() - start) // 2:
                    start = tag
                if html[start : spot.start()].strip():
                    yield start, spot

    return next((p for p in (rule(*s) for s in starts()) if _fits(p, html, value, kind)), None)
