"""Text, number and URL functions as Catalyst expressions; nothing here leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pageloom.functions.patterns import FIELD_TYPES, MAX_CHARS, NUMERIC, TEXT_CHARS, TYPED, UMLAUTS, UNI_WS


def let(x: Column, f) -> Column:
    """f(x) with x evaluated once, however often f names it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def normalize(c: Column) -> Column:
    """White space collapsed and trimmed; null becomes empty.  Entities are resolved where pages are parsed."""
    return F.trim(F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), f"{UNI_WS}+", " "))


def fold(c: Column) -> Column:
    out = F.lower(normalize(c))
    for a, b in UMLAUTS.items():
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(fold(c), F.lit("([a-z0-9]+)"), F.lit(1))


def _java(kind: str) -> str:
    p = TYPED[kind]
    return "(?U)" + p if not p.startswith("(?i)") else "(?iU)" + p[4:]


def find_typed(c: Column, kind: str, normal: bool = False) -> Column:
    """The first part of the text that has the shape of `kind`; null where there is none.  `normal`: the text is normalised."""
    text = c if normal else normalize(c)
    if kind == "text":
        return F.nullif(text, F.lit(""))
    if kind not in FIELD_TYPES:
        return F.lit(None).cast("string")
    return F.nullif(F.trim(F.regexp_extract(text, _java(kind), 0)), F.lit(""))


def value_from(c: Column, kind: str) -> Column:
    text = F.regexp_replace(normalize(c), r"^[:\-–—\s]+", "")
    return F.nullif(F.substring(text, 1, TEXT_CHARS), F.lit("")) if kind == "text" else find_typed(text, kind)


def parse_number(c: Column) -> Column:
    """German and English notation; the last separator of two kinds is the decimal one; null without a number."""
    # Digits of other widths and scripts count as digits.
    ascii_digits = F.translate(normalize(c), "０１２３４５６７８９٠١٢٣٤٥٦٧٨٩", "01234567890123456789")
    raw = F.regexp_extract(ascii_digits, r"-?\d[\d.,' ]*", 0)
    digits = F.regexp_replace(F.regexp_replace(raw, r"[' ]", ""), r"[.,]+$", "")

    def value(n: Column) -> Column:
        dots, commas = F.length(n) - F.length(F.replace(n, F.lit("."))), F.length(n) - F.length(F.replace(n, F.lit(",")))
        no_comma, no_dot = F.replace(n, F.lit(",")), F.replace(n, F.lit("."))
        plain = (
            F.when((dots > 0) & (commas > 0), F.when(F.length(F.substring_index(n, ".", -1)) < F.length(F.substring_index(n, ",", -1)), no_comma).otherwise(F.replace(no_dot, F.lit(","), F.lit("."))))
            .when(commas > 1, no_comma)
            .when(commas == 1, F.replace(n, F.lit(","), F.lit(".")))
            .when((dots > 0) & n.rlike(r"^-?\d{1,3}(\.\d{3})+$"), no_dot)
            .otherwise(n)
        )
        return plain.try_cast("double")

    return let(digits, value)


def validate(c: Column, kind: str, low: float | None = None, high: float | None = None, pattern: str | None = None, max_chars: int = MAX_CHARS, typed_source: bool = False) -> Column:
    """struct(ok, number, text, reason), the first reason that applies."""
    def judged(text: Column, hit: Column, number: Column) -> Column:
        reason = F.when(text == "", "EMPTY").when(F.length(text) > max_chars, "TOO_LONG")
        if pattern:
            reason = reason.when(~text.rlike(pattern), "PATTERN_MISMATCH")
        if kind not in FIELD_TYPES:
            reason = reason.when(F.lit(True), "UNKNOWN_TYPE")
        if kind != "text":
            reason = reason.when(hit == "", "TYPE_MISMATCH")
        if kind in NUMERIC:
            reason = reason.when(number.isNull() | ((number != F.floor(number)) if kind == "integer" else F.lit(False)), "TYPE_MISMATCH")
            if low is not None:
                reason = reason.when(number < low, "BELOW_MIN")
            if high is not None:
                reason = reason.when(number > high, "ABOVE_MAX")
        return let(reason.otherwise("OK"), lambda r: F.struct(
            (r == "OK").alias("ok"), F.when(r == "OK", number).alias("number"), F.when((r == "OK") & F.lit(kind not in NUMERIC), F.trim(hit)).alias("text"), r.alias("reason"),
        ))

    def found(text: Column) -> Column:
        if kind == "text":
            return text
        hit = F.regexp_extract(text, _java(kind), 0) if kind in TYPED else F.lit("")
        if typed_source and kind in ("price", "area"):
            hit = F.when(hit == "", F.regexp_extract(text, "(?U)^(?:" + TYPED["number"] + ")$", 0)).otherwise(hit)
        return hit

    number = lambda hit: parse_number(hit) if kind in NUMERIC else F.lit(None).cast("double")
    return let(normalize(c), lambda text: let(found(text), lambda hit: let(number(hit), lambda n: judged(text, hit, n))))


def equivalent(a: Column, b: Column, kind: str) -> Column:
    if kind in NUMERIC:
        return F.coalesce(F.abs(parse_number(a) - parse_number(b)) < 1e-9, F.lit(False))
    return fold(a) == fold(b)


# URLs: one pattern of five parts, for parse_url refuses hosts and queries that pages do have.
URL_PARTS = r"^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


def url_part(c: Column, part: str) -> Column:
    return F.regexp_extract(F.coalesce(c, F.lit("")), URL_PARTS, ["", "scheme", "netloc", "path", "query", "fragment"].index(part))


def host(c: Column) -> Column:
    netloc = F.lower(url_part(c, "netloc"))
    return F.regexp_replace(F.regexp_replace(netloc, "^.*@", ""), r":\d*$", "")


def scope_of(c: Column) -> Column:
    """Host without www and at most four path segments, with `*` for those that vary from page to page."""
    h = F.regexp_replace(host(c), r"^www\.", "")
    parts = F.slice(F.filter(F.split(url_part(c, "path"), "/"), lambda s: s != ""), 1, 4)
    stem = lambda s: F.when(F.instr(s, ".") > 0, F.regexp_extract(s, r"^(.*)\.[^.]*$", 1)).otherwise(s)
    shown = F.transform(parts, lambda s: F.when(stem(s).rlike(r"\d") | ((F.length(stem(s)) > 24) & stem(s).contains("-")), "*").otherwise(F.lower(stem(s))))
    return F.when(h == "", "inline").otherwise(F.concat(h, F.lit("/"), F.array_join(shown, "/")))


def _joined(scheme: Column, netloc: Column, path: Column, query: Column) -> Column:
    return F.concat(
        F.when(scheme != "", F.concat(F.lower(scheme), F.lit(":"))).otherwise(""), F.when(netloc != "", F.concat(F.lit("//"), netloc)).otherwise(""), path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")
    )


def normalize_url(c: Column) -> Column:
    """Scheme and host in lower case, an empty path as `/`, no fragment."""
    path = url_part(c, "path")
    return _joined(url_part(c, "scheme"), F.lower(url_part(c, "netloc")), F.when(path == "", "/").otherwise(path), url_part(c, "query"))


def clean_url(c: Column) -> Column:
    """As normalize_url, with the host as written."""
    path = url_part(c, "path")
    return _joined(url_part(c, "scheme"), url_part(c, "netloc"), F.when(path == "", "/").otherwise(path), url_part(c, "query"))


def same_host(a: Column, b: Column) -> Column:
    return host(a) == host(b)


def _key_kind(key: Column) -> Column:
    k = F.regexp_replace(F.lower(key), "[^a-z0-9]+", "")
    return F.when(k.isin("p", "pg") | k.rlike("page|seite"), "page").when(k.isin("offset", "start", "skip") | k.rlike("offset|startindex"), "offset")


def marker(c: Column) -> Column:
    """struct(kind, value, key, at): the first page-like number of a URL; `at` is the pair of the query (-1: in the path)."""
    query, path = url_part(c, "query"), url_part(c, "path")
    pairs = F.transform(
        F.filter(F.split(query, "&"), lambda p: p != ""),
        lambda p, i: F.struct(_key_kind(F.regexp_replace(F.substring_index(p, "=", 1), r"\+", " ")).alias("kind"), F.regexp_extract(p, r"^[^=]*=(\d+)$", 1).alias("value"), F.substring_index(p, "=", 1).alias("key"), i.alias("at")),
    )
    hit = F.get(F.filter(pairs, lambda x: x.kind.isNotNull() & (x.value != "")), F.lit(0))
    slash, dash = F.regexp_extract(path, r"(?i)/(?:page|seite|p)/(\d+)(?:/|$)", 1), F.regexp_extract(path, r"(?i)/(?:page|seite|p)[-_](\d+)(?:/|$)", 1)
    in_path = F.when(slash != "", slash).otherwise(dash)
    none = F.lit(None).cast("struct<kind:string,value:bigint,key:string,at:int>")
    return F.when(hit.isNotNull(), F.struct(hit.kind.alias("kind"), hit.value.cast("long").alias("value"), hit.key.alias("key"), hit.at.alias("at"))).when(
        in_path != "", F.struct(F.lit("page").alias("kind"), in_path.cast("long").alias("value"), F.lit("path").alias("key"), F.lit(-1).alias("at"))
    ).otherwise(none)


def template(c: Column, m: Column) -> Column:
    """The URL with `{page}` or `{offset}` in place of its marker; null without one."""
    hole = F.concat(F.lit("{"), m.kind, F.lit("}"))
    pairs = F.filter(F.split(url_part(c, "query"), "&"), lambda p: p != "")
    query = F.array_join(F.transform(pairs, lambda p, i: F.when(i == m.at, F.concat(F.substring_index(p, "=", 1), F.lit("="), hole)).otherwise(p)), "&")
    path = url_part(c, "path")
    slash = path.rlike(r"(?i)/(?:page|seite|p)/\d+(?:/|$)")
    in_path = F.when(slash, F.regexp_replace(path, r"(?i)^(.*?/(?:page|seite|p)/)\d+(/|$)", "$1{page}$2")).otherwise(F.regexp_replace(path, r"(?i)^(.*?/(?:page|seite|p)[-_])\d+(/|$)", "$1{page}$2"))
    return F.when(m.isNotNull(), F.when(m.at >= 0, _joined(url_part(c, "scheme"), url_part(c, "netloc"), path, query)).otherwise(_joined(url_part(c, "scheme"), url_part(c, "netloc"), in_path, url_part(c, "query"))))
