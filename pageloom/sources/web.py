"""Pages over HTTP: one partition a group of hosts, polite within each.

Hosts, not URLs, are spread, so the interval of a host holds over the whole
cluster.  `fetch` takes a table of URLs, the data source a short list.  An
opener is "module:function" and takes (url, headers, timeout, limit) and gives
(status, final_url, headers, body); without it urllib is used.  A renderer is
"module:function" and takes (url, timeout) and gives (html, final_url, status);
without it no page is rendered.

What can't be had has an error_code and whether to try again: URL_SCHEME_DENIED,
URL_INVALID, HOST_DENIED, ROBOTS_DISALLOWED, FETCH_FAILED, HTTP_ERROR, BLOCKED
(a challenge or a refusal; it is told, never got around), RENDER_NOT_AVAILABLE.
"""

from __future__ import annotations

import gzip
import importlib
import os
import re
import time
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import urlsplit, urlunsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from pageloom.functions import patterns as P

SCHEMA = "url string, final_url string, status int, html string, stage string, elapsed_ms long, bytes long, truncated boolean, content_type string, notes array<string>, error_code string, recoverable boolean"


@dataclass
class FetchPolicy:
    user_agent: str = "pageloom/0.1"
    respect_robots: bool = True
    timeout: float = 20.0
    max_bytes: int = 5_000_000
    interval: float = 1.0
    schemes: tuple[str, ...] = ("http", "https")
    deny_hosts: tuple[str, ...] = field(default_factory=tuple)
    ttl: float = 300.0

    @staticmethod
    def from_env(env: dict[str, str] | None = None) -> FetchPolicy:
        e = os.environ if env is None else env
        p = FetchPolicy()
        p.user_agent = e.get("PAGELOOM_USER_AGENT") or p.user_agent
        p.respect_robots = e.get("PAGELOOM_RESPECT_ROBOTS", "").strip().lower() not in ("0", "false", "no")
        p.timeout = float(e.get("PAGELOOM_TIMEOUT") or p.timeout)
        p.interval = float(e.get("PAGELOOM_MIN_INTERVAL") or p.interval)
        p.deny_hosts = tuple(h.strip().lower() for h in e.get("PAGELOOM_DENY_HOSTS", "").split(",") if h.strip())
        return p


def decompress(body: bytes, encoding: str) -> bytes:
    """gzip and deflate undone (deflate with or without its header); what can't be undone stays as it is."""
    kind = (encoding or "").strip().lower()
    tries = {"gzip": [gzip.decompress], "deflate": [zlib.decompress, lambda b: zlib.decompress(b, -zlib.MAX_WBITS)]}.get(kind, [])
    for f in tries:
        try:
            return f(body)
        except (OSError, EOFError, zlib.error):
            continue
    return body


_CHARSET = re.compile(r"charset\s*=\s*[\"']?([\w.:-]+)", re.I)


def decode(body: bytes, content_type: str) -> str:
    """Text by the header's charset, else the one in the first 4096 bytes, else UTF-8, else Windows-1252."""
    named = [m[1] for m in (_CHARSET.search(content_type or ""), _CHARSET.search(body[:4096].decode("ascii", "replace"))) if m]
    for charset in [*named, "utf-8", "cp1252"]:
        try:
            return body.decode(charset)
        except (LookupError, UnicodeDecodeError):
            continue
    return body.decode("utf-8", "replace")


def urllib_open(url: str, headers: dict, timeout: float, limit: int):
    from urllib.error import HTTPError
    from urllib.request import Request, urlopen

    try:
        with urlopen(Request(url, headers=headers), timeout=timeout) as r:
            return r.status, r.url, dict(r.headers), r.read(limit)
    except HTTPError as e:
        return e.code, e.url or url, dict(e.headers or {}), e.read(limit)


_VISIBLE = re.compile(r"(?is)<script\b.*?</script>|<style\b.*?</style>|<[^>]+>")
_TECHNICAL, _PHRASE = (re.compile("|".join(map(re.escape, words)), re.I) for words in (P.TECHNICAL_MARKERS, P.PHRASE_MARKERS))


def challenge(status: int, html: str) -> str | None:
    """As policy.challenge, of one response."""
    odd = status in P.CHALLENGE_STATUSES
    technical, phrase = _TECHNICAL.search(html), _PHRASE.search(html)
    thin = bool(technical or phrase) and len(" ".join(_VISIBLE.sub(" ", html).split())) < P.THIN_CHARS
    if status == 429:
        return "RATE_LIMITED"
    if technical and (odd or thin):
        return f"CHALLENGE:{technical[0].lower()}"
    if phrase and odd and thin:
        return f"CHALLENGE:{phrase[0].lower()}"
    return f"HTTP_{status}" if status in (401, 403) else None


def normalize_url(url: str) -> str:
    """Scheme and host in lower case, an empty path as `/`, no fragment."""
    try:
        u = urlsplit(url.strip())
    except ValueError:
        return url
    return urlunsplit((u.scheme.lower(), u.netloc.lower(), u.path or "/", u.query, "")) if u.netloc else url


def _named(name: str | None):
    return getattr(importlib.import_module(name.split(":")[0]), name.split(":")[1]) if name else None


class Fetcher:
    """Fetches the URLs of a task; keeps robots rules, times and pages of the host at hand only."""

    def __init__(self, policy: FetchPolicy, opener: str | None = None, renderer: str | None = None):
        self.policy, self.open, self.renderer = policy, _named(opener) or urllib_open, _named(renderer)
        self.headers = {"User-Agent": policy.user_agent, "Accept": "text/html,application/xhtml+xml", "Accept-Language": "de,en;q=0.8", "Accept-Encoding": "gzip, deflate"}
        self.host: str | None = None
        self._forget()

    def _forget(self) -> None:
        self.robots: dict = {}
        self.pages: dict[str, tuple[float, tuple]] = {}
        self.last = float("-inf")

    def _wait(self) -> None:
        ahead = self.last + self.policy.interval - time.monotonic()
        if ahead > 0:
            time.sleep(ahead)
        self.last = time.monotonic()

    def _get(self, url: str, limit: int):
        self._wait()
        return self.open(url, self.headers, self.policy.timeout, limit)

    def _allowed(self, url: str) -> bool:
        from urllib.robotparser import RobotFileParser

        u = urlsplit(url)
        root = f"{u.scheme}://{u.netloc}".lower()
        if root not in self.robots:
            try:
                status, _, h, body = self._get(root + "/robots.txt", 500_000)
                if status in (401, 403):
                    self.robots[root] = False
                elif status >= 400:
                    self.robots[root] = True
                else:
                    rules = RobotFileParser()
                    rules.parse(decode(decompress(body, h.get("Content-Encoding", "")), "").splitlines())
                    self.robots[root] = rules
            except Exception:
                self.robots[root] = True
        r = self.robots[root]
        return r if isinstance(r, bool) else r.can_fetch(self.policy.user_agent, url)

    def __call__(self, raw: str, render: bool = False) -> tuple:
        """A row of SCHEMA."""
        p, began, stage = self.policy, time.monotonic(), "render" if render else "http"
        took = lambda: int((time.monotonic() - began) * 1000)
        bad = lambda code, again, note=None: (raw, url, None, None, stage, took(), 0, False, None, [note[:200]] if note else [], code, again)
        url = normalize_url(raw)
        try:
            u = urlsplit(url)
            host = (u.hostname or "").lower()
        except ValueError:
            return bad("URL_INVALID", False)
        if u.scheme.lower() not in p.schemes:
            return bad("URL_SCHEME_DENIED", False)
        if not host:
            return bad("URL_INVALID", False)
        if any(host == d or host.endswith("." + d) for d in p.deny_hosts):
            return bad("HOST_DENIED", False)
        if host != self.host:
            self.host = host
            self._forget()
        if render and self.renderer is None:
            return bad("RENDER_NOT_AVAILABLE", True)
        key = f"{stage} {url}"
        if key in self.pages and time.monotonic() - self.pages[key][0] < p.ttl:
            row = self.pages[key][1]
            return (raw, *row[1:9], [*row[9], "cache_hit"], *row[10:])
        if p.respect_robots and not self._allowed(url):
            return bad("ROBOTS_DISALLOWED", False)
        try:
            if render:
                self._wait()
                html, final, status = self.renderer(url, p.timeout)
                status, kind, size, cut = int(status or 200), None, len(html.encode("utf-8", "ignore")), False
            else:
                status, final, h, body = self._get(url, p.max_bytes + 1)
                kind = h.get("Content-Type") or h.get("content-type") or ""
                size, cut = len(body), len(body) > p.max_bytes
                html = decode(decompress(body[: p.max_bytes], h.get("Content-Encoding") or h.get("content-encoding") or ""), kind)
        except Exception as e:
            return bad("FETCH_FAILED", True, str(e))
        why = challenge(status, html)
        code, again = ("BLOCKED", True) if why else ("HTTP_ERROR", status >= 500) if status >= 400 else (None, None)
        row = (raw, final or url, status, html, stage, took(), size, cut, kind, [why] if why else [], code, again)
        if code is None:
            self.pages[key] = time.monotonic(), row
        return row


def fetch(urls: DataFrame, policy: FetchPolicy | None = None, opener: str | None = None, renderer: str | None = None, render: bool = False, hosts_at_once: int | None = None) -> DataFrame:
    """Rows of SCHEMA for a table of URLs (column url).

    URLs are spread by host and sorted, so a host is one task's, one page after
    another; `hosts_at_once` is the number of tasks.  A URL that repeats is
    served from the page cache.  Null URLs are left out."""
    from pageloom.functions import native as N
    from pageloom.operators.pagegraph import arrow_schema

    policy = policy or FetchPolicy.from_env()
    schema = arrow_schema(SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = Fetcher(policy, opener, renderer)
        for b in batches:
            for i in range(0, b.num_rows, 64):
                rows = [get(u, render) for u in b.column(0).slice(i, 64).to_pylist()]
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema)

    width = hosts_at_once or max(urls.sparkSession.sparkContext.defaultParallelism, int(urls.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    by_host = urls.where("url is not null").select("url", N.host(F.col("url")).alias("host")).repartition(width, "host").sortWithinPartitions("host", "url")
    return by_host.select("url").mapInArrow(run, SCHEMA)


class _Hosts(InputPartition):
    def __init__(self, urls: list[str]):
        self.urls = urls


class WebSource(DataSource):
    """spark.read.format("web_pages").option("urls", newline-separated).load(); for a table of URLs use `fetch`."""

    @classmethod
    def name(cls) -> str:
        return "web_pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.options = dict(options)

    def partitions(self) -> list[_Hosts]:
        by_host: dict[str, list[str]] = {}
        for u in dict.fromkeys(x.strip() for x in self.options.get("urls", "").splitlines() if x.strip()):
            by_host.setdefault((urlsplit(u).hostname or "").lower(), []).append(u)
        return [_Hosts(v) for v in by_host.values()]

    def read(self, partition: _Hosts):
        policy = FetchPolicy.from_env()
        policy.interval = float(self.options.get("interval", policy.interval))
        get = Fetcher(policy, self.options.get("opener"), self.options.get("renderer"))
        yield from (get(u, self.options.get("render", "false").lower() == "true") for u in partition.urls)


def register(spark) -> None:
    spark.dataSource.register(WebSource)
