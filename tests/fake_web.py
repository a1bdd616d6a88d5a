"""An opener and a renderer for tests."""

import gzip

PAGES = {
    "/robots.txt": (200, b"User-agent: *\nDisallow: /private\n", {}),
    "/a": (200, "<p>Größe</p>".encode("latin-1"), {"Content-Type": "text/html; charset=iso-8859-1"}),
    "/gz": (200, gzip.compress("<p>Küche</p>".encode()), {"Content-Encoding": "gzip", "Content-Type": "text/html"}),
    "/gone": (404, b"gone", {}),
    "/down": (503, b"<p>down</p>", {}),
    "/much": (429, b"", {}),
    "/check": (200, b'<div class="cf-turnstile"></div>', {}),
    "/long": (200, b"x" * 400, {}),
}
ASKED: list[str] = []


def open_page(url, headers, timeout, limit):
    path = "/" + url.split("/", 3)[3]
    ASKED.append(url)
    if path == "/dead":
        raise OSError("no route")
    status, body, h = PAGES.get(path, (200, b"<p>ok</p>", {}))
    return status, url, h, body[:limit]


def render_page(url, timeout):
    return "<p>rendered</p>", url, 200
