"""Pages that hold template residue, filler or messages where their content should be.

Visible text blocks are the units; texts that differ only in case, numbers,
look-alikes or garbled characters are one unit.  Trusted labels come from

* notes that quote what a page said, and demands for scripts in noscript parts;
* the fetches themselves: a unit of main bodies whose pages failed (an error
  status, or a quoting note) far more often than pages do, by the lower end of
  the Wilson interval; then units most of whose pages have a message already
  known beside them, round by round until none is added;
* a few whole messages that servers and frameworks send as they are, and phrases
  of checks of the visitor;
* filler, by its vocabulary and its phrases.

Units near a trusted one are searched through tables of their sorted shingle
prints, in which every pair that is similar enough meets, verified by the Hamming
distance of their SimHashes and the Jaccard similarity of their five-word
shingles, and get its label; so on over the connected component, breadth first,
each round cut to the shared folder (a component without a trusted unit can pass
on no label).  A page is a case by the labels of its main body, which the site
style tree gives.  Placeholders are faults of a place, not of a text; they are
judged where they stand and never spread.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.llm import styletree
from pageloom.llm.lookalike import LIGATURES, LOOKALIKE
from pageloom.session import col_or_null, cut, spread

REAL, MESSAGE, FILLER, PLACEHOLDER = 0, 1, 2, 3

# Whole messages as servers, frameworks and visitor checks send them.
MESSAGES = r"""
^(error |http |http error )?(40[0-9]|410|429|50[0-9])( -|:)? (not found|forbidden|gone|unauthorized|too many requests|internal server error|bad gateway|service unavailable|gateway time-?out)$
^((the )?(requested )?(page|url|file) )?(was |could )?not (be )?found( on this server)?( \(\d+\))?[.!]?$
^(bad gateway|service unavailable|service temporarily unavailable|internal server error|access denied|forbidden|too many requests)( \(\d+\))?[.!]?$
^(die )?seite (wurde )?nicht gefunden[.!]?$|^(la )?page (est )?introuvable[.!]?$|^pgina no encontrada[.!]?$
^((please|you need to|you must) )?enable javascript to (run|use|view|continue)|^veuillez activer javascript|^(por favor,? )?active javascript para
^are you a robot
^traceback \(most recent|^(php )?(fatal|parse) error: |^(php )?warning: \w+\(|^uncaught \w+(error|exception)|^[a-z.]*exception( at|:)
"""
# Phrases of checks of the visitor and of dead links.
PHRASES = r"""
prüfen ihren browser|bestätigen sie, dass sie (ein mensch|kein roboter)|zu viele anfragen|aktivieren sie javascript|führt ins leere
checking your browser|(confirm|verify) (that )?you are (human|not a robot)|too many requests|enable javascript and reload
"""
# Phrases of filler.
FILLERS = r"""
text folgt|steht später ihr text|blindtext|musterabsatz|muster(text|absatz)|platzhalter für|beispieltext
(your|sample) text (goes )?here|text goes here|replace this paragraph|text to be supplied|sample copy|content coming soon|coming soon\.?$|please ignore|dummy text
contenido próximamente|escriba aquí su tex|texto de (ejemplo|muestra)|párrafo de muestra
contenu à venir|texte (à venir|d'exemple|de remplissage|fictif)|paragraphe (d'exemple|de démonstration|à remplacer)|votre texte ici|remplacez? ce
lorem ipsum|(\bbla\b ?){3}|qwert|asdf
"""
#: Words of the usual filler; a text mostly of these is filler.
FILLER_WORDS = frozenset(
    "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum".split()
)
_FUNCTION_WORDS = frozenset(
    "der die das den dem ein eine und oder ist sind im in zu von mit auf für nicht the a an of and or to is are at on with for le la les un une des de du et ou est sont en au aux à avec pour el los las uno una y o es son al del con por para que se och är til på i w z na po się do e em no um uma os as".split()
)
_NAME = r"[A-Za-z][A-Za-z0-9]*(?:[._][A-Za-z0-9]+)*"
_MARKS = [
    r"\{\{\{?\s*NAME\s*\}?\}\}", r"\{%-?\s*\w+[^%{}<>]{0,60}%\}", r"<%=?\s*NAME[^%<>]{0,40}%>", r"[$#]\{\s*NAME\s*\}", r"(?<![\w$#{])\{NAME\}(?!\})",
    r"%\(NAME\)[sdif]", r"%%NAME%%", r"@@NAME@@", r"__NAME__", r"###NAME###", r"(?<![\w$])\$NAME\$(?![\w$])", r"\[\[\s*NAME\s*\]\]",
    r"\[insert NAME here\]", r"\[NAME hier einsetzen\]", r"\[(?:insérer|insertar) NAME[^\]]{0,12}\]", r"«NAME»", r"\bTODO: ?NAME", r"\[object Object\]",
]
_PLACEHOLDER = re.compile("|".join(m.replace("NAME", _NAME) for m in _MARKS))
_PROGRAM_WORD = re.compile(r"(?<![\w.\-/„“\"'«‘’])(?:undefined|NaN|null|nil|None)(?![\w.\-/“”\"'»’])")
_MAYBE_MARK = re.compile(r"[{%@_#$\[«]|undefined|TODO|NaN|null|nil|None")

_FOLD = {c + 0xFEE0: chr(c) for c in range(0x21, 0x7F)} | {ord(a): b for a, b in LOOKALIKE.items()} | {ord(a): b for a, b in LIGATURES.items()} | dict.fromkeys([0xA0, 0x202F, 0x3000, *range(0x2000, 0x200B)], " ")
_FOLDED = frozenset(map(chr, _FOLD))
_DROP = re.compile(r"[^\x20-\x7e]+")


def bare(text: str) -> str:
    """text in lower case without look-alikes and without characters beyond ASCII; of other scripts the whole text."""
    if not text.isascii():
        if not _FOLDED.isdisjoint(text):
            text = text.translate(_FOLD)
        plain = text.encode("ascii", "ignore").decode()
        if 2 * len(plain) >= len(text):
            text = plain
    return " ".join(text.lower().split())


def _compiled(lines: str) -> re.Pattern:
    # A word that is one dropped letter leaves no second blank in a bare text.
    return re.compile("|".join(_DROP.sub("", line.replace("à ", "")) for line in lines.strip().split("\n")))


_MESSAGE, _PHRASE, _FILL = _compiled(MESSAGES), _compiled(PHRASES), _compiled(FILLERS)
_WORD = re.compile(r"[a-z']+")
_DIGITS = re.compile(r"\d+")


def _is_filler(text: str, plain: str, words: list[str]) -> bool:
    """By vocabulary, or words that say nothing."""
    n, distinct = len(words), set(words)
    if n < 3:
        return False
    if len(distinct) == 1 or all(len(w) > 1 and w == w[0] * len(w) for w in words):
        return True
    function = len(distinct & _FUNCTION_WORDS)
    if n >= 4 and function <= 0.25 * len(distinct) and sum(w in FILLER_WORDS for w in words) >= 0.7 * n:
        return True
    if function or n < 6 or len(distinct) == n or "," in plain or text[1:] != text[1:].lower() or _DIGITS.search(plain):
        return False
    # Invented words: long ones come again, none is a short word that sentences can't do without, no name stands out, no letter is foreign to them.
    return len(plain) == len(" ".join(text.split())) and all(len(w) > 3 for w, k in Counter(words).items() if k > 1)


# Each phrase has one of these words.
_ANCHORS = frozenset(
    _DROP.sub("", w)
    for w in """browser mensch roboter anfragen javascript leere human robot requests folgt text später blindtext musterabsatz mustertext platzhalter beispieltext sample replace supplied coming ignore dummy
contenido próximamente escriba texto párrafo contenu texte paragraphe votre remplacez remplace lorem ipsum bla asdf""".split()
)
_SENTENCE = re.compile(r"(?<=[.!?])[\"')\]]* +")


def _by_sentences(plain: str) -> int | None:
    """The label of a text in which at least half of the sentences have a phrase; None for others."""
    sentences = [x for x in _SENTENCE.split(plain) if x]
    messages = [_PHRASE.search(x) is not None for x in sentences]
    fills = sum(not m and _FILL.search(x) is not None for m, x in zip(messages, sentences, strict=True))
    if 2 * (sum(messages) + fills) < len(sentences):
        return None
    return MESSAGE if sum(messages) >= fills else FILLER


def label_text(kind: str, text: str) -> tuple[int, str]:
    """The label that a block has by itself, and its bare text."""
    plain = bare(text)
    if kind != "pre" and _MAYBE_MARK.search(text) and (_PLACEHOLDER.search(text) or _PROGRAM_WORD.search(text)):
        return PLACEHOLDER, plain
    if _MESSAGE.match(plain):
        return MESSAGE, plain
    words = _WORD.findall(plain)
    if (not _ANCHORS.isdisjoint(words) or "qwert" in plain) and (label := _by_sentences(plain)) is not None:
        return label, plain
    return (FILLER if _is_filler(text, plain, words) else REAL), plain


class Prints:
    """Prints of texts: hashes of their five-word shingles, numbers masked.  A text of fewer words is its own only shingle."""

    #: Odd multipliers of the places in a shingle.
    PLACES = [0x9E3779B97F4A7C15 + 2 * 0x632BE59BD9B4E019 * i & (1 << 64) - 1 | 1 for i in range(5)]

    def __init__(self) -> None:
        import numpy as np
        import xxhash

        self.np, self.digest, self.words = np, xxhash.xxh3_64_intdigest, {}
        self.places = [np.uint64(p) for p in self.PLACES]

    def of(self, plain: str) -> tuple[int, int, list[int]]:
        return self.of_many([plain])[0]

    def of_many(self, plains: list[str]) -> list[tuple[int, int, list[int]]]:
        """(unit, SimHash, sorted distinct prints of 31 bits) of bare texts; the unit is a hash of the whole masked text."""
        np, known, digest = self.np, self.words, self.digest
        if len(known) > 500_000:
            known.clear()
        out: list = []
        flat: list[int] = []
        long: list[tuple[int, int, int]] = []  # which text, where its words begin, how many shingles
        for k, plain in enumerate(plains):
            masked = _DIGITS.sub("0", plain)
            unit = digest(masked) & ((1 << 63) - 1)
            w = masked.split(" ")
            out.append((unit, unit, [unit & 0x7FFFFFFF] if masked else []))
            if len(w) > 5:
                long.append((k, len(flat), len(w) - 4))
                for x in w:
                    h = known.get(x)
                    if h is None:
                        h = known[x] = digest(x)
                    flat.append(h)
        if not long:
            return out
        a = np.array(flat, np.uint64)
        n = len(a) - 4
        h = a[:n] * self.places[0]
        for i in range(1, 5):
            h ^= a[i : i + n] * self.places[i]
        h = (h ^ (h >> np.uint64(31))) * self.places[0]
        short = (h >> np.uint64(33)).astype(np.int32).tolist()
        # Windows over the end of a text are computed with the rest and left out here, some texts at a time.
        for i in range(0, len(long), 2000):
            part = long[i : i + 2000]
            counts = np.array([c for _, _, c in part])
            at = np.concatenate([np.arange(s, s + c) for _, s, c in part])
            bits = np.unpackbits(h[at].view(np.uint8).reshape(-1, 8), axis=1)
            ones = np.add.reduceat(bits, np.concatenate([[0], counts.cumsum()[:-1]]), axis=0, dtype=np.int32)
            sims = np.packbits(ones * 2 > counts[:, None], axis=1).view(np.int64).ravel().tolist()
            for (k, s, c), sim in zip(part, sims, strict=True):
                out[k] = out[k][0], sim, sorted(set(short[s : s + c]))
        return out


_SHELL = re.compile(r"""(?:<(?:main|div|section|article)\b[^>]*>\s*|<div id=["']?(?:root|app|__next|__nuxt)["']?[^>]*>\s*</div>\s*)<noscript""", re.I)
_NOSCRIPT = re.compile(r"<noscript\b[^>]*>(.*?)</noscript", re.I | re.S)
_SCRIPT = re.compile("s[ck]ript", re.I)
_TITLES = frozenset(("h1", "h2"))
#: Notes that quote what the page said; hints such as `thin_page` do not.
_QUOTING_NOTE = re.compile(r"^(?:body|server said|render_failed|template error)\b[^:]*:(.*)", re.S)

_UNITS = {
    "host": "string", "page_id": "long", "address": "long", "node": "string", "chain": "string", "block_ids": "array<int>", "opening": "long", "chars": "int", "letters": "int", "linked": "int", "titles": "int", "cells": "int", "page_blocks": "int",
    "units": "array<long>", "labels": "array<int>", "heads": "array<boolean>", "sims": "array<long>", "prints": "array<array<int>>", "shell": "boolean", "quoted": "boolean", "failed": "boolean",
}
_ARROW = {
    "string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64()),
    "array<boolean>": pa.list_(pa.bool_()), "array<array<int>>": pa.list_(pa.list_(pa.int32())),
}


def _demands(html: str) -> list[str]:
    """Texts of noscript parts that ask for scripts."""
    texts = (" ".join(re.sub(r"<[^>]*>", " ", m).split()) for m in _NOSCRIPT.findall(html))
    return [t for t in texts if _SCRIPT.search(t)]


def page_units(pages: DataFrame) -> DataFrame:
    """A row for each page and style node, with label, SimHash and shingle prints of its blocks.

    Prints stand only where a task meets a text for the first time.  Pages
    without any visible block give one row without node, so that they are kept;
    texts that notes quote, and demands for scripts, one without page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        from pageloom.functions.outline import Outliner

        outline, digest, mask, prints = Outliner(), xxhash.xxh3_64_intdigest, (1 << 63) - 1, Prints()
        known: dict[tuple[bool, str], tuple[int, int, int]] = {}
        told: set[str] = set()

        # Some pages at a time: what is held of a page is several times its html.
        for b in (b.slice(i, 2000) for b in batches for i in range(0, b.num_rows, 2000)):
            if len(known) > 100_000:
                known.clear()
            pages = [(page_id, host, html, outline.blocks(html), status, notes or ()) for page_id, host, html, status, notes in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True)]
            addresses = b.column(5).to_pylist()
            new = list(dict.fromkeys(key for p in pages for _, kind, text, _ in p[3] if (key := (kind == "pre", text)) not in known))
            labels = [label_text("pre" if pre else "p", text) for pre, text in new]
            fresh = {}
            for key, (label, _), (u, sim, hashes) in zip(new, labels, prints.of_many([plain for _, plain in labels]), strict=True):
                known[key] = u, label, sim
                fresh[key] = hashes
            rows, trusted = [], set()
            for address, (page_id, host, html, blocks, status, notes) in zip(addresses, pages, strict=True):
                quotes = [m[1].strip() for n in notes if n and (m := _QUOTING_NOTE.match(n))]
                noscript = "<noscript" in html
                trusted.update(quotes, _demands(html) if noscript else ())
                shell = noscript and _SHELL.search(html) is not None
                last = shell, bool(quotes), bool(quotes) or (status or 0) >= 400
                if not blocks:
                    rows.append((host, page_id, address, None, "", [], 0, 0, 0, 0, 0, 0, 0, [], [], [], [], [], *last))
                for names_of, n in styletree.nodes_of(outline, blocks, digest, mask, False):
                    keys = [(blocks[i][1] == "pre", blocks[i][2]) for i in n[0]]
                    us = [known[k] for k in keys]
                    heads = [blocks[i][1] in _TITLES for i in n[0]]
                    rows.append((host, page_id, address, names_of[-1] if names_of else "", "\x1f".join(names_of), n[0], *n[2:], len(blocks), [u[0] for u in us], [u[1] for u in us], heads, [u[2] for u in us], [fresh.pop(k, None) for k in keys], *last))
            said = sorted(t for t in {bare(t) for t in trusted} - told if t)
            if said:
                told.update(said)
                us, sims, hashes = zip(*prints.of_many(said), strict=True)
                rows.append((None, None, None, None, "", [], 0, 0, 0, 0, 0, 0, 0, us, [MESSAGE] * len(us), [False] * len(us), sims, hashes, False, False, False))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, _ARROW[k]) for c, k in zip(zip(*rows, strict=True), _UNITS.values(), strict=True)], list(_UNITS))

    flat = pages.where("html is not null and page_id is not null").select(
        F.col("page_id").cast("long"), F.coalesce(F.col("host"), F.lit("")).alias("host"), "html", col_or_null(pages, "status", "int").alias("status"), col_or_null(pages, "notes", "array<string>").alias("notes"),
        F.xxhash64(F.coalesce(col_or_null(pages, "url", "string"), F.col("page_id").cast("string"))).alias("address"),
    )
    return spread(flat).mapInArrow(run, ", ".join(f"{k} {v}" for k, v in _UNITS.items()))


def _prefixes(df: DataFrame, similarity: float, *keep: str) -> DataFrame:
    """A row for each print of the prefix: the least prints of a set, one more than it can miss of a set as similar as that."""
    n = F.size("prints")
    return df.select(*keep, n.alias("n"), F.explode(F.slice("prints", F.lit(1), n - F.ceil(n * similarity - 1e-9).cast("int") + 1)).alias("print"))


#: Bits that the SimHashes of near-duplicates may differ in.  Of 4,176 random pairs at 0.8 or more half differed in 6 bits or fewer, one in a hundred in more than 15, none in more than 20.
HAMMING = 32


def propagate(units: DataFrame, similarity: float = 0.8) -> DataFrame:
    """(unit, label) for all units in the component of a trusted one.

    units(unit, label, sim, prints): prints sorted and distinct; a unit may be
    repeated with one label.  Two sets of prints with a Jaccard similarity of at
    least `similarity` share a print of their prefixes, so the tables of prefix
    prints hold all such pairs; the SimHashes' Hamming distance is tested before
    any print travels.  A text of one shingle is similar to its copies only,
    which are the same unit, so it has no links.  A round joins the frontier
    with the units that have no label yet; it ends when a round adds none."""
    trusted = cut(units.where(F.col("label").isin(MESSAGE, FILLER)).groupBy("unit").agg(F.min("label").alias("label"), F.first("sim").alias("sim"), F.first("prints").alias("prints")))
    units = units.where((F.col("label") == REAL) & (F.size("prints") > 1)).select("unit", "sim", "prints")
    frontier, out = trusted.where("size(prints) > 1"), [trusted.select("unit", "label")]
    while True:
        first = _prefixes(frontier, similarity, "unit", "sim").toDF("unit0", "sim0", "n0", "print")
        met = _prefixes(units, similarity, "unit", "sim").join(first, "print")
        pairs = met.where((F.least("n", "n0") + 1e-9 >= similarity * F.greatest("n", "n0")) & (F.bit_count(F.col("sim").bitwiseXOR(F.col("sim0"))) <= HAMMING)).select("unit", "unit0").distinct()
        pairs = cut(pairs.join(reduce(DataFrame.unionByName, out), "unit", "left_anti"))
        if pairs.isEmpty():
            break
        # Prints are read again for what is left.
        mine = units.join(pairs.select("unit").distinct(), "unit", "left_semi").dropDuplicates(["unit"])
        near = pairs.join(frontier.select(F.col("unit").alias("unit0"), "label", F.col("prints").alias("prints0")), "unit0").join(mine, "unit")
        both = F.size(F.array_intersect("prints", "prints0"))
        near = near.where(both + 1e-9 >= similarity * (F.size("prints") + F.size("prints0") - both))
        new = cut(near.groupBy("unit").agg(F.min("label").alias("label"), F.first("sim").alias("sim"), F.first("prints").alias("prints")))
        if new.isEmpty():
            break
        out.append(new.select("unit", "label"))
        frontier = new
    return reduce(DataFrame.unionByName, out)


def telling_units(shown: DataFrame, bad_pages: DataFrame, limit: float, z: float, least: int = 3) -> DataFrame:
    """(unit) that bad pages show out of proportion.

    shown(page_id, address, unit): units of main bodies.  A unit tells if it is
    on at least `least` addresses of bad pages and the lower end of the Wilson
    interval (z standard errors) of their share in all its addresses is over
    `limit`.  Texts that pages show whatever they are never tell."""
    bad = shown.join(bad_pages, "page_id", "left_semi").groupBy("unit").agg(F.count_distinct("address").alias("e"))
    bad = cut(bad.where(F.col("e") >= least))
    n = shown.join(bad, "unit").groupBy("unit").agg(F.count_distinct("address").alias("p"), F.first("e").alias("e"))
    p, share, zz = F.col("p"), F.col("e") / F.col("p"), z * z
    low = (share + zz / (2 * p) - z * F.sqrt(share * (1 - share) / p + zz / (4 * p * p))) / (1 + zz / p)
    return n.where(low > limit).select("unit")


def trusted_by_fetches(own: DataFrame, failed: DataFrame) -> DataFrame:
    """(unit) of messages by what became of the fetches: first by failed pages, then by the messages known so far.

    own: nodes of main bodies with their units without label and the number of
    messages; failed(page_id, failed): one row a page."""
    shown = own.where("why = ''").select("page_id", "address", F.explode(F.array_distinct(F.concat("reals", "titles"))).alias("unit"))
    base = failed.agg(F.avg(F.col("failed").cast("double"))).first()[0] or 0.0
    known = cut(telling_units(shown, failed.where("failed"), 2 * base, 3.0))
    said = own.where("why = '' and told > 0").select("page_id")
    while True:
        bad = said.unionByName(shown.join(known, "unit", "left_semi").select("page_id")).distinct()
        more = cut(telling_units(shown, bad, 0.25, 2.0).join(known, "unit", "left_anti"))
        if more.isEmpty():
            return known
        known = known.unionByName(more)


def residue_pages(pages: DataFrame, links: bool = True, evidence: bool = True) -> DataFrame:
    """(page_id, reason) of the pages to exclude.

    Null html is never a case.  A page whose main body has no text is a case if
    its notes quote a message, or if the body is the empty root of an
    application with a demand for scripts.  Repeated rows of a page_id count
    once.  `links` and `evidence` are for measuring: without them no label
    spreads over components, or none comes from the fetches."""
    units = cut(page_units(pages))
    # Texts that differ in numbers only are one text to the style tree here.
    nodes = units.where("node is not null")
    verdicts = cut(styletree.node_verdicts(nodes.withColumn("texts", F.col("units"))).select("host", "node", F.coalesce("why", F.lit("")).alias("why")).where("why in ('', 'template')"))
    body = nodes.join(verdicts, ["host", "node"])
    page = units.where("page_id is not null")
    zipped = F.arrays_zip("units", "labels", "heads")
    count = lambda f: F.size(F.filter(zipped, f)).cast("long")
    first_real = F.filter(zipped, lambda u: (u.labels == REAL) & ~u.heads)
    own = cut(body.select(
        "page_id", "address", "failed", "why", count(lambda u: u.labels.isin(MESSAGE, FILLER)).alias("bad"), F.size(first_real).cast("long").alias("real"), count(lambda u: u.labels == PLACEHOLDER).alias("placeholder"), F.size("units").cast("long").alias("all"), count(lambda u: u.labels == MESSAGE).alias("told"),
        F.transform(first_real, lambda u: u.units).alias("reals"), F.transform(F.filter(zipped, lambda u: (u.labels == REAL) & u.heads), lambda u: u.units).alias("titles"),
    ))

    met = units.select(F.explode(F.arrays_zip("units", "labels", "sims", "prints")).alias("u")).select(F.col("u.units").alias("unit"), F.col("u.labels").alias("label"), F.col("u.sims").alias("sim"), F.col("u.prints").alias("prints")).where("prints is not null")
    if evidence:
        failing = trusted_by_fetches(own, page.groupBy("page_id").agg(F.max("failed").alias("failed")))
        met = met.join(failing.withColumn("tells", F.lit(True)), "unit", "left").withColumn("label", F.when(F.col("tells") & (F.col("label") == REAL), MESSAGE).otherwise(F.col("label"))).drop("tells")
    labelled = cut(propagate(met) if links else met.where(F.col("label").isin(MESSAGE, FILLER)).select("unit", "label").distinct())

    # Blocks that have their label from elsewhere change sides.
    zero, no = F.lit(0).cast("long"), F.lit(False)
    turned = own.select("page_id", "why", F.explode("reals").alias("unit"), F.lit(-1).cast("long").alias("real")).unionByName(own.select("page_id", "why", F.explode("titles").alias("unit"), zero.alias("real")))
    turned = turned.join(labelled.select("unit"), "unit").select("page_id", "why", F.lit(1).cast("long").alias("bad"), "real", zero.alias("placeholder"), zero.alias("all"), no.alias("shell"), no.alias("quoted"))
    own = own.select("page_id", "why", "bad", "real", "placeholder", "all", no.alias("shell"), no.alias("quoted"))
    each = page.groupBy("page_id").agg(F.max("shell").alias("shell"), F.max("quoted").alias("quoted")).select("page_id", F.lit(None).cast("string").alias("why"), *[zero.alias(c) for c in ("bad", "real", "placeholder", "all")], "shell", "quoted")
    inner, outer = F.col("why") == "", F.col("why") == "template"
    total = lambda c, where: F.coalesce(F.sum(F.when(where, F.col(c))), F.lit(0))
    facts = own.unionByName(turned).unionByName(each).groupBy("page_id").agg(
        total("all", inner).alias("body"), F.sum("placeholder").alias("placeholder"), total("bad", inner).alias("bad"), total("real", inner).alias("real"),
        total("bad", outer).alias("bad_t"), total("real", outer).alias("real_t"), F.max("shell").alias("shell"), F.max("quoted").alias("quoted"),
    )
    reason = (
        F.when(F.col("placeholder") > 0, "placeholder")
        .when((F.col("body") > 0) & (F.col("bad") > 0) & (F.col("real") == 0), "residue")
        .when((F.col("body") == 0) & (F.col("bad_t") > 0) & (F.col("real_t") == 0), "residue")
        .when((F.col("body") == 0) & (F.col("real_t") == 0) & F.col("quoted"), "quoted in notes")
        .when((F.col("body") == 0) & (F.col("real_t") == 0) & F.col("shell"), "empty shell")
    )
    return facts.select("page_id", reason.alias("reason")).where("reason is not null")


def usable_pages(pages: DataFrame) -> DataFrame:
    """The pages without the excluded ones and without those that have no html at all."""
    return pages.where("html is not null and html <> ''").join(residue_pages(pages).select("page_id"), "page_id", "left_anti")
