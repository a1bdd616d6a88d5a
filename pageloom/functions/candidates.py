"""What the structured data and the labels of one page offer for a field."""

from __future__ import annotations

from functools import lru_cache
from typing import Any

from pageloom.functions import patterns as P
from pageloom.functions import scalars as S
from pageloom.functions.markup import Page


def triples(page: Page) -> list[tuple[str, str, Any]]:
    """(source, path, value) of scripts, microdata and meta, in this order."""
    out: list[tuple[str, str, Any]] = []
    for i, (kind, _, content) in enumerate(page.scripts):
        data = S.load_json(content)
        if data is not None:
            out += [(f"{kind}[{i}]", path, v) for path, v in S.flatten(data)]
    out += [("microdata", name, v) for name, v in page.itemprops]
    out += [("meta", name, v) for name, v in page.meta.items()]
    return out[: 2 * S.MAX_FLAT]


@lru_cache(10_000)
def path_keys(path: str) -> list[str]:
    return [S.fold(k) for k in path.replace(":", ".").split(".") if k]


@lru_cache(1000)
def _asked_for(name: str, aliases: tuple[str, ...], paths: tuple[str, ...]) -> tuple[list[list[str]], set[str]]:
    names = {S.fold(a) for a in [name, *aliases]}
    return [k for k in map(path_keys, paths) if k], names | {n.replace(" ", "") for n in names}


def _asked(spec: dict) -> tuple[list[list[str]], set[str]]:
    """Keys of the field's paths, and its names."""
    return _asked_for(spec["name"], tuple(spec["aliases"]), tuple(spec["paths"]))


def _tier(keys: list[str], asked: tuple[list[list[str]], set[str]]) -> int | None:
    if not keys:
        return None
    return 0 if any(keys[-len(w) :] == w for w in asked[0]) else 1 if keys[-1] in asked[1] else None


def asks_for(path: str, spec: dict) -> bool:
    """Whether structured data at this path are for the field."""
    return _tier(path_keys(path), _asked(spec)) is not None


def structured(flat: list[tuple[str, str, Any]], spec: dict) -> list[tuple[str, str, str]]:
    """(source, path, raw) for the field: those at one of its paths, then those whose last key is an alias."""
    asked, tiers = _asked(spec), ([], [])
    for source, path, value in flat:
        tier = _tier(path_keys(path), asked)
        if tier is not None and (raw := S.normalize(value)):
            tiers[tier].append((source, path, raw))
    return tiers[0] + tiers[1]


def by_rule(flat: list[tuple[str, str, Any]], spec: dict) -> dict[str, str]:
    """What each rule from structured data for the field would find."""
    asked, out = _asked(spec), {}
    for source, path, value in flat:
        if _tier(path_keys(path), asked) is not None:
            out.setdefault(f"{source.split('[', 1)[0]}|{path}", S.normalize(value))
    return out


def lookup(flat: list[tuple[str, str, Any]], rule: str) -> str | None:
    kind, _, path = rule.partition("|")
    return next((S.normalize(v) for s, p, v in flat if p == path and s.split("[", 1)[0] == kind), None)


def labelled(page: Page, labels: list[str], kind: str) -> list[tuple[str, str, int]]:
    """(raw, label, block): values beside exact labels, then in nearby wrappers, then after a label in the same block."""
    question = (tuple(labels), kind)
    if question in page.memo:
        return page.memo[question]
    blocks = page.blocks
    low = page.memo.get("folded")
    if low is None:
        low = page.memo["folded"] = [b.text.casefold() for b in blocks]
        page.memo["all folded"] = "\n".join(low)
    whole = page.memo["all folded"]
    # Few labels are on a page at all; the others are not searched for in its blocks.
    found = [(key, S.alias_pattern(a)) for a in labels if a.strip() and (key := S.alias_key(a)) in whole]
    beside, nearby, inside = [], [], []
    main_first = sorted(range(len(blocks)), key=lambda i: (blocks[i].region != "main", i)) if found else []
    for i in main_first:
        b = blocks[i]
        if b.level and len(b.text) > P.LABEL_CHARS:
            continue
        m = next((m for key, p in found if key in low[i] and (m := p.search(b.text))), None)
        if m is None:
            continue
        rest = b.text[m.end() :]
        if len(b.text) > P.LABEL_CHARS or rest.strip(":-–— "):
            value = S.value_from(rest, kind)
            if value:
                inside.append((value, m[0], i))
            continue
        name, used = b.text.rstrip(": "), -1
        nxt = blocks[i + 1] if i + 1 < len(blocks) else None
        if nxt is not None and (nxt.row == b.row if b.row is not None else nxt.section == b.section):
            value = S.value_from(nxt.text, kind)
            if value:
                beside.append((value, name, i + 1))
                used = i + 1
        near = []
        for j in range(i + 1, min(len(blocks), i + P.LOOK_AHEAD + 1)):
            c = blocks[j]
            if c.level or c.region != b.region or c.section != b.section:
                continue
            shared = next((k for k, (x, y) in enumerate(zip(b.ancestry, c.ancestry)) if x != y), min(len(b.ancestry), len(c.ancestry)))
            if shared < max(1, min(len(b.ancestry), len(c.ancestry)) - 1) or (len(c.text) <= P.LABEL_CHARS and any(key in low[j] and p.search(c.text) for key, p in found)):
                continue
            value = S.value_from(c.text, kind)
            if value and j != used:
                near.append((-shared, j, value))
        nearby += [(value, name, j) for _, j, value in sorted(near)]
    page.memo[question] = beside + nearby + inside
    return page.memo[question]


def first_valid(options, spec: dict, typed: bool):
    """The first option whose raw value is valid: (option, normalised), and how many were seen."""
    for n, (raw, *rest) in enumerate(options, 1):
        ok, value, _ = S.validate(raw, spec, typed)
        if ok:
            return (raw, *rest), value, n
    return None, None, len(options)
