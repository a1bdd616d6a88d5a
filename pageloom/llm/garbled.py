"""Text that was decoded with another charset than it was written in: found and put back.

A hidden Markov model labels characters.  It has one clean state and one state
for each encoding pair (written as, read as); a further state holds what a
decoder replaced and nobody can restore.  A pair state emits what the pair makes
of the letters and signs of European texts, so its tables follow from the two
codecs and a few weights.  The clean state knows which characters
stand where in sound text.  The Viterbi path's spans get their state's inverse transform.

ASCII characters are the same in all states, so only others take part; and a
page without any character or couple of characters that a pair state could win
is clean without a search.  Nothing is shuffled.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.llm.lookalike import LOOKALIKE
from pageloom.session import spread

#: (name, codec written in, codecs read with, in order).  Two readings: text that went through the same mistake twice.
PAIRS = [
    ("utf8_cp1252", "utf-8", ("cp1252",)),
    ("utf8_latin1", "utf-8", ("latin-1",)),
    ("utf8_latin9", "utf-8", ("iso8859-15",)),
    ("utf8_cp1250", "utf-8", ("cp1250",)),
    ("utf8_cp1251", "utf-8", ("cp1251",)),
    ("utf8_cp437", "utf-8", ("cp437",)),
    ("utf8_cp850", "utf-8", ("cp850",)),
    ("utf8_macroman", "utf-8", ("mac_roman",)),
    ("utf8_cp1252_twice", "utf-8", ("cp1252", "cp1252")),
    ("cp1252_macroman", "cp1252", ("mac_roman",)),
    ("cp1252_cp1251", "cp1252", ("cp1251",)),
]
LOST = "lost"

# Relative weights of characters in European texts.
_WEIGHTS = {
    "äöüé": 40, "ßèàñóíá€–²": 15, "êç’„“”·ÄÖÜ": 8, "âîôûúÉÀ£©«»…›": 4,
    "ëïùãõåìòÈÊÂÎÔÇÓÁÍÚÑÃÅœ°¡¿—‘‚§½³® ºªæøŒ": 1,
    "àáâ": 1, "ąćęłńśźżőűăâșțčďěňřšťůž": 0.1, "  ​•™†": 0.1,
}
_GREEK = "".join(chr(c) for c in range(0x386, 0x3CF) if chr(c).isalpha())
_CYRILLIC = "".join(chr(c) for c in range(0x401, 0x45F) if chr(c).isalpha())

_FLOOR = math.log(1e-9)
_ENTER, _STAY, _LEAVE, _CLEAN = math.log(1e-4), math.log(0.7), math.log(0.3), math.log(0.998)


def _misread(data: bytes, codec: str) -> str:
    """data read with codec; bytes that the codec leaves open become the control characters of their number."""
    out = []
    for b in data:
        try:
            out.append(bytes([b]).decode(codec))
        except UnicodeDecodeError:
            out.append(chr(b))
    return "".join(out)


def _bytes_of(text: str, codec: str) -> bytes | None:
    out = bytearray()
    for c in text:
        try:
            out += c.encode(codec)
        except UnicodeEncodeError:
            if ord(c) > 0xFF:
                return None
            out.append(ord(c))
    return bytes(out)


def garble(text: str, written: str, read: tuple[str, ...]) -> str:
    for codec in read:
        text = _misread(text.encode(written, "ignore"), codec)
    return text


def restore_span(text: str, written: str, read: tuple[str, ...]) -> str | None:
    """The text before the mistake; null where these characters can't come of it."""
    for codec in reversed(read):
        data = _bytes_of(text, codec)
        if data is None:
            return None
        try:
            text = data.decode(written)
        except UnicodeDecodeError:
            return None
    return text


class _State:
    """start: log weight of a first character; step: of a second after a first; stop: of an end after a character."""

    def __init__(self, name: str, written: str, read: tuple[str, ...]):
        self.name, self.written, self.read = name, written, read
        alphabet: dict[str, float] = {}
        for chars, w in _WEIGHTS.items():
            for c in chars:
                alphabet[c] = max(w, alphabet.get(c, 0))
        if written == "utf-8":
            alphabet |= dict.fromkeys(_GREEK + _CYRILLIC, 0.5)
        start: dict[str, float] = {}
        couple: dict[str, dict[str, float]] = {}
        stop: dict[str, float] = {}
        seen: dict[str, float] = {}
        for c, w in alphabet.items():
            try:
                c.encode(written)
            except UnicodeEncodeError:
                continue
            g = garble(c, written, read)
            if g == c:
                continue
            start[g[0]] = start.get(g[0], 0) + w
            for a, b in zip(g, g[1:]):
                couple.setdefault(a, {})[b] = couple.get(a, {}).get(b, 0) + w
            stop[g[-1]] = stop.get(g[-1], 0) + w
            for a in g:
                seen[a] = seen.get(a, 0) + w
        total = sum(start.values())
        self.start = {c: math.log(w / total) for c, w in start.items()}
        self.stop = {c: math.log(max(1e-6, stop.get(c, 0) / n)) for c, n in seen.items()}
        #: Of a single-byte pair: the character meant, which must suit the place where it stands.
        self.meant = {garble(c, written, read): c for c in alphabet if written != "utf-8" and garble(c, written, read)}
        self.step: dict[str, dict[str, float]] = {}
        for a, n in seen.items():
            row = {b: w / n for b, w in couple.get(a, {}).items()}
            end = stop.get(a, 0) / n
            if end:  # another character of the text follows at once
                for b, w in start.items():
                    row[b] = row.get(b, 0) + end * w / total
            self.step[a] = {b: math.log(w) for b, w in row.items()}


@lru_cache(1)
def states() -> list[_State]:
    return [_State(*p) for p in PAIRS]


_COMMON = frozenset("äöüßéèàêçñóíáúâîôûÄÖÜÉ")
_LONE = frozenset("àéáóúíèÀ")
_LONE_CYRILLIC = frozenset("авикосуяАВИКОСУЯ")
_RARE_SIGNS = frozenset("¤¦¨¬¯´¸±¶µ¢¥¼¾¹ˆ˜ˇ˘˙˚˛˝†‡‰")
_LIKE = frozenset(LOOKALIKE)
_OPENS, _CLOSES = frozenset("“„«\"'‘‹‚"), frozenset("”“»\"'’›‘")


def clean_log(c: str, p2: str, p: str, n: str) -> float:
    """Log weight of the character c in sound text, after p2 p and before n."""
    o = ord(c)
    if o < 0xA0 or c == "�":
        return -21.0
    letter_before, letter_after = p.isalpha(), n.isalpha()
    if 0x370 <= o < 0x530 and c.isalpha():
        same = [x for x in (p, n) if x.isalpha() and (0x370 <= ord(x) < 0x400) == (o < 0x400) and 0x370 <= ord(x) < 0x530]
        latin = [x for x in (p, n) if (x.isalpha() or x.isdigit()) and ord(x) < 0x370]
        if latin:
            if c not in _LIKE:
                return -17.0
            return -14.0 if c.isupper() and p.islower() or (p.isdigit() or n.isdigit()) else -6.9
        if same:
            return -4.6
        return -6.9 if c in _LIKE or c in _LONE_CYRILLIC else -13.8
    if c.isalpha() and c not in "ªºµˆˇ":
        if o >= 0x250:
            return -6.9
        if c.isupper() and p.islower():
            return -16.1
        if not letter_before and not letter_after:
            if p == " " and p2.isdigit():
                return -14.0
            return -4.6 if c in _LONE else -11.5
        return -3.9 if c in _COMMON else -5.8 if o < 0x100 else -6.9
    if c in "’":
        return -3.9 if p.isascii() or letter_before else -11.5
    if 0x2500 <= o < 0x2600 or 0x2200 <= o < 0x2300 or c in _RARE_SIGNS or c in "⌐₧":
        return -18.4 if letter_before and letter_after else -16.1
    if c in "–—":
        return -3.9 if p.isspace() or p.isdigit() else -9.2
    if c in "²³":
        return -3.9 if p == "m" or p.isdigit() else -11.5
    if c in "©":
        return -3.9 if p in ">" or p.isspace() else -11.5
    if c in "€":
        return -3.9 if p.isspace() or p.isdigit() or (n.isdigit() and not letter_before) else -13.8
    if c in "£":
        return -3.9 if n.isdigit() and not letter_before else -11.5
    if c in "„“”‘‚«»‹›…·":
        return -16.1 if letter_before and letter_after else -9.2 if not p.isascii() and p not in "„“”‘‚«»‹›…·–—’   " and not (c in "”“»…" and p in _COMMON) else -4.6
    if c in "¡¿":
        return -4.6 if not letter_before else -14.0
    if c in "ªº°½®™•×÷§":
        if letter_before and letter_after:
            return -18.4
        return -6.9 if p.isdigit() or (c in "®™" and letter_before and p.isascii()) or (not letter_before and not letter_after) else -14.5
    if not c.isalnum() and letter_before and letter_after and o < 0x2000 and o not in (0xAD, 0xB7):
        return -13.8 if o != 0xA0 else -6.2
    return -6.2


@lru_cache(1)
def _trigger() -> re.Pattern:
    """Matches wherever a pair state could win; what it does not match is clean."""
    leads = "".join(sorted({c for s in states() if s.written == "utf-8" for c in s.start}))
    single = {c for s in states() if s.written != "utf-8" for c in s.start}
    signs = "".join(sorted(c for c in single if not c.isalpha() and c not in "–—’‘“”„…·©°²³«»€£" or c in "ƒˆ˜ıﬂ"))
    upper = "".join(sorted(c for c in single if c.isupper() and ord(c) < 0x370))
    lower = "".join(sorted(c for c in single if c.islower() and ord(c) < 0x370))
    return re.compile(
        f"[\x80-\x9f�]|[{re.escape(leads)}][^\x00-\x7f]|[{re.escape(signs)}]|(?<=[a-zß-ÿ])[{re.escape(upper)}]|(?<=\\d )[{re.escape(upper)}]|(?<=[\\s>])[{re.escape(lower)}](?=[\\s<])"
        "|[A-Za-z0-9][Ѐ-ԯ]|[Ѐ-ԯ][A-Za-z0-9]|(?<=\\d )[Ѐ-ԯ]|[A-Za-z]·[A-Za-z]"
    )


def label(text: str) -> list[tuple[int, int, str]]:
    """Spans (from, to, state) of text that the Viterbi path puts in another state than clean."""
    if text.isascii() or not _trigger().search(text):
        return []
    model = states()
    k = len(model)
    places = [m.start() for m in _NON_ASCII.finditer(text)]
    size, neg = len(text), -1e18
    clean, lost, pair = 0.0, neg, [neg] * k
    back: list[tuple] = []
    last = -2
    prev = ""
    for at in places:
        c = text[at]
        joined = at == last + 1
        # What it costs to be anywhere else than where the last character was.
        ends = [v + s.stop.get(prev, _FLOOR) for v, s in zip(pair, model, strict=True)] if prev else pair
        best, b = max((v, i) for i, v in enumerate(ends))
        via = max((clean + _CLEAN, -1), (best + _LEAVE, b), (lost + _LEAVE, k))
        near = text[at - 2] if at > 1 else " ", text[at - 1] if at else " ", text[at + 1] if at + 1 < size else " "
        here = clean_log(c, *near)
        new_pair, from_pair = [], []
        for i, s in enumerate(model):
            first = s.start.get(c, _FLOOR)
            if s.meant and first > _FLOOR:
                first = min(first, clean_log(s.meant[c], *near))
            enter = via[0] + _ENTER + first
            stay = pair[i] + s.step[prev].get(c, _FLOOR) if joined and prev in s.step and not s.meant else ends[i] + _STAY + first
            if stay >= enter:
                new_pair.append(stay)
                from_pair.append(i)
            else:
                new_pair.append(enter)
                from_pair.append(via[1])
        gone = -0.7 if c == "�" else _FLOOR
        enter, stay = via[0] + _ENTER + gone, lost + _STAY + gone
        back.append((via[1], from_pair, k if stay >= enter else via[1]))
        clean, pair, lost = via[0] + here, new_pair, max(enter, stay)
        last, prev = at, c
    ends = [v + s.stop.get(prev, _FLOOR) for v, s in zip(pair, model, strict=True)]
    state = max((clean, -1), *((v, i) for i, v in enumerate(ends)), (lost, k))[1]
    spans: list[list[int]] = []
    for at, (c_from, p_from, l_from) in zip(reversed(places), reversed(back), strict=True):
        if state >= 0:
            if spans and spans[-1][0] == at + 1 and spans[-1][2] == state:
                spans[-1][0] = at
            else:
                spans.append([at, at + 1, state])
        state = c_from if state < 0 else l_from if state == k else p_from[state]
    return [(a, b, LOST if s == k else model[s].name) for a, b, s in reversed(spans)]


_NON_ASCII = re.compile(r"[^\x00-\x7f]")


def is_quoted(text: str, a: int, b: int) -> bool:
    """Whether the span is all that stands between two quotation marks: a sequence shown on purpose."""
    before, after = text[max(0, a - 3) : a].rstrip(), text[b : b + 3].lstrip()
    return bool(before) and bool(after) and before[-1] in _OPENS and after[0] in _CLOSES


def examine(text: str | None) -> tuple[list[str], int, str | None]:
    """(states met, spans that can't be restored, text with all other spans restored).

    States is empty for sound text, for null and for empty text; the text is
    null unless something was restored."""
    if not text:
        return [], 0, None
    spans = [s for s in label(text) if not is_quoted(text, s[0], s[1])]
    if not spans:
        return [], 0, None
    pairs = {s.name: s for s in states()}
    out, at, lost, done = [], 0, 0, 0
    for a, b, name in spans:
        good = None if name == LOST else restore_span(text[a:b], pairs[name].written, pairs[name].read)
        if good is None:
            lost += 1
            continue
        out += [text[at:a], good]
        at, done = b, done + 1
    return sorted({s[2] for s in spans}), lost, "".join(out) + text[at:] if done else None


def examine_pages(pages: DataFrame, with_html: bool = True) -> DataFrame:
    """(page_id, states, lost, restored) of each garbled page; restored is null where nothing could be put back.

    Each row stands for itself: repeated and cached rows are judged again, and
    null or empty html is never garbled."""
    flat = pages.where("html is not null and html <> ''").select("page_id", "html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, *e) for i, e in zip(b.column(0).to_pylist(), map(examine, b.column(1).to_pylist()), strict=True) if e[0]]
            if rows:
                ids, names, lost, html = zip(*rows, strict=True)
                cols = [pa.array(ids, pa.int64()), pa.array(names, pa.list_(pa.string())), pa.array(lost, pa.int32())]
                if with_html:
                    cols.append(pa.array(html, pa.string()))
                yield pa.RecordBatch.from_arrays(cols, ["page_id", "states", "lost", "restored"][: len(cols)])

    return spread(flat.select(F.col("page_id").cast("long").alias("page_id"), "html")).mapInArrow(run, "page_id long, states array<string>, lost int" + ", restored string" * with_html)
