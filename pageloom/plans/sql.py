"""SQL expressions that the queries' SQL shares."""

from __future__ import annotations

from pageloom.functions.patterns import TYPED, UMLAUTS, UNI_WS


def norm(x: str) -> str:
    return f"trim(regexp_replace(coalesce({x}, ''), '{UNI_WS}+', ' ', 'g'))"


def fold(x: str) -> str:
    out = f"lower({norm(x)})"
    for a, b in UMLAUTS.items():
        out = f"replace({out}, '{a}', '{b}')"
    return out


def typed(x: str, kind: str) -> str:
    p = TYPED[kind].replace(r"\d", r"\p{Nd}").replace(r"[\p{Nd} ()/\-]", r"[\p{Nd} ()/\-]").replace(r"[^\s\"'<>]", UNI_WS.replace("[", "[^", 1)[:-1] + "\"''<>]").replace(r"\s?", f"{UNI_WS}?").replace("'", "''").replace("''''", "''")
    return f"nullif(trim(regexp_extract({norm(x)}, '{p}', 0)), '')"


_PARTS = r"^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


def part(x: str, name: str) -> str:
    return f"regexp_extract({x}, '{_PARTS}', {['', 'scheme', 'netloc', 'path', 'query', 'fragment'].index(name)})"


def host(x: str) -> str:
    return f"regexp_replace(regexp_replace(lower({part(x, 'netloc')}), '^.*@', ''), ':[0-9]*$', '')"


def scope(x: str) -> str:
    h = f"regexp_replace({host(x)}, '^www\\.', '')"
    stems = f"list_transform(list_filter(string_split({part(x, 'path')}, '/'), lambda s: s <> '')[1:4], lambda s: regexp_replace(s, '\\.[^.]*$', ''))"
    shown = f"list_transform({stems}, lambda s: CASE WHEN regexp_matches(s, '[0-9]') OR (length(s) > 24 AND contains(s, '-')) THEN '*' ELSE lower(s) END)"
    return f"CASE WHEN {h} = '' THEN 'inline' ELSE {h} || '/' || array_to_string({shown}, '/') END"


def clean(x: str) -> str:
    p, q = part(x, "path"), part(x, "query")
    return f"CASE WHEN {part(x, 'scheme')} <> '' THEN lower({part(x, 'scheme')}) || ':' ELSE '' END || CASE WHEN {part(x, 'netloc')} <> '' THEN '//' || {part(x, 'netloc')} ELSE '' END || CASE WHEN {p} = '' THEN '/' ELSE {p} END || CASE WHEN {q} <> '' THEN '?' || {q} ELSE '' END"
