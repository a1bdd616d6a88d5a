"""One consistent form for texts that look the same but hold different characters.

DuckDB runs inside the Arrow partitions; the whole normalisation is embedded
SQL.  Mapped are width variants, compatibility forms of letters (mathematical
alphabets, Roman numerals, ligatures, half-width kana, shaped Arabic letters),
look-alike letters of other scripts, characters that show nothing, blanks of any
width, and accents written as characters of their own.  Case, spelling, accents
as such, punctuation and digits stay as they are, and so do superscripts,
fractions and circled signs, which look different.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.session import spread

# Letters of other scripts and the Latin letters they look like, in the order of their code points.
LOOKALIKE = {
    "ı": "i", "ɡ": "g", "ɩ": "i", "ν": "v", "ο": "o", "ϲ": "c", "ϳ": "j", "Ϲ": "C",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "Ѐ": "È", "Ё": "Ë", "Ѕ": "S", "І": "I", "Ї": "Ï", "Ј": "J", "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѐ": "è", "ё": "ë", "ѕ": "s", "і": "i", "ї": "ï", "ј": "j",
    "Ү": "Y", "һ": "h", "Ӏ": "I", "ӏ": "l", "ԁ": "d", "Ԛ": "Q", "ԛ": "q", "Ԝ": "W", "ԝ": "w",
    "Ց": "S", "Օ": "O", "օ": "o", "հ": "h", "ո": "n", "ս": "u",
    "‐": "-", "‑": "-", "＇": "'", "￮": "o",
}
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st", "Ĳ": "IJ", "ĳ": "ij", "Ǆ": "DŽ", "ǆ": "dž"}
# Rarer scripts, tested for before they are mapped: small capitals, Coptic, Cherokee, Lisu.
RARE_LOOKALIKE = {
    "ɑ": "a", "ᴄ": "c", "ᴏ": "o", "ᴠ": "v", "ᴡ": "w", "ᴢ": "z", "Ꭰ": "D", "Ꭱ": "R", "Ꭲ": "T", "Ꭺ": "A", "Ꭻ": "J", "Ꭼ": "E", "Ꮃ": "W", "Ꮇ": "M", "Ꮋ": "H", "Ꮐ": "G", "Ꮓ": "Z", "Ꮩ": "V", "Ꮪ": "S", "Ꮮ": "L", "Ꮯ": "C", "Ꮲ": "P", "Ꮶ": "K", "Ᏼ": "B",
    "Ⲏ": "H", "Ⲕ": "K", "Ⲙ": "M", "Ⲛ": "N", "Ⲟ": "O", "ⲟ": "o", "Ⲣ": "P", "ⲣ": "p", "Ⲥ": "C", "ⲥ": "c", "Ⲧ": "T", "Ⲭ": "X", "ⲭ": "x", "ꓐ": "B", "ꓑ": "P", "ꓓ": "D", "ꓔ": "T", "ꓖ": "G", "ꓗ": "K", "ꓙ": "J", "ꓚ": "C", "ꓜ": "Z", "ꓝ": "F", "ꓟ": "M", "ꓠ": "N", "ꓡ": "L", "ꓢ": "S", "ꓣ": "R", "ꓦ": "V", "ꓧ": "H", "ꓪ": "W", "ꓫ": "X", "ꓬ": "Y", "ꓮ": "A", "ꓰ": "E", "ꓲ": "I", "ꓳ": "O", "ꓴ": "U",
}
#: Kinds of compatibility forms that look as the letters they stand for.
_SAME_LOOK = ("<font>", "<wide>", "<narrow>", "<initial>", "<medial>", "<final>", "<isolated>")


def compatibility_forms() -> dict[str, str]:
    """Letters and letter numbers whose compatibility form looks the same, by the Unicode tables; of general compatibility forms only those that are several letters in one."""
    out = {}
    for o in (*range(0xA0, 0x3400), *range(0xF900, 0x10000), *range(0x1D400, 0x1D800), *range(0x1EE00, 0x1EF00)):
        c = chr(o)
        how, plain = unicodedata.decomposition(c).split(" ")[0], unicodedata.normalize("NFKC", c)
        if plain == c or 0xFF00 < o < 0xFF5F or not how.startswith("<") or unicodedata.category(c) not in ("Lu", "Ll", "Lo", "Lm", "Nl", "Nd", "Mn"):
            continue
        numeral = unicodedata.category(c) == "Nl" and plain.isascii()
        if how in _SAME_LOOK or numeral or (how == "<compat>" and len(plain) > 1 and plain.isalpha()):
            out[c] = plain
    return out


INVISIBLE = r"[\x{0000}-\x{0008}\x{000E}-\x{001F}\x{007F}\x{00AD}\x{034F}\x{061C}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{180B}-\x{180E}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{206F}\x{FE00}-\x{FE0F}\x{FEFF}\x{FFF9}-\x{FFFB}\x{1D173}-\x{1D17A}\x{E0000}-\x{E01EF}]"
BLANK = r"[\s\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{2800}\x{3000}\x{3164}\x{FFA0}]+"


def _quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


@lru_cache(1)
def _rare() -> tuple[str, dict[str, str], dict[str, str]]:
    """A class of characters, and what they become: one character, or several."""
    forms = {c: p for c, p in compatibility_forms().items() if c not in LIGATURES} | RARE_LOOKALIKE
    at = sorted(map(ord, forms))
    runs: list[list[int]] = []
    for o in at:
        if runs and o == runs[-1][1] + 1:
            runs[-1][1] = o
        else:
            runs.append([o, o])
    return "[" + "".join(rf"\x{{{a:04X}}}-\x{{{b:04X}}}" for a, b in runs) + "]", {c: p for c, p in forms.items() if len(p) == 1}, {c: p for c, p in forms.items() if len(p) > 1}


def rare_sql(text: str, among: set[str] | None = None) -> str:
    """The SQL expression `text` without compatibility forms and letters of rarer scripts (those in `among`); other texts are only tested for them."""
    there, one, several = _rare()
    if among is not None:
        one, several = ({c: p for c, p in x.items() if c in among} for x in (one, several))
    x = f"translate({text}, {_quote(''.join(one))}, {_quote(''.join(one.values()))})"
    for a, b in several.items():
        x = f"replace({x}, {_quote(a)}, {_quote(b)})"
    return f"CASE WHEN regexp_matches({text}, '{there}') THEN {x} ELSE {text} END"


def canonical_sql(text: str) -> str:
    """The canonical form of the SQL expression `text`, for DuckDB; null stays null."""
    # Full-width forms are 94 code points in a row, each 0xFEE0 above the usual one.
    wide = {chr(c + 0xFEE0): chr(c) for c in range(0x21, 0x7F)}
    one = {**wide, **LOOKALIKE}
    x = f"regexp_replace({text}, '{INVISIBLE}', '', 'g')"
    x = f"translate({x}, {_quote(''.join(one))}, {_quote(''.join(one.values()))})"
    for a, b in LIGATURES.items():
        x = f"replace({x}, {_quote(a)}, {_quote(b)})"
    return f"trim(regexp_replace(nfc_normalize({x}), '{BLANK}', ' ', 'g'))"


# A text of printable ASCII with single blanks is its own canonical form; most texts are, and need no more than this test.
_PLAIN = r"^[!-~]+( [!-~]+)*$"
_SQL = f"SELECT * REPLACE (CASE WHEN regexp_matches(canon, '{_PLAIN}') THEN canon ELSE {canonical_sql('canon')} END AS canon) FROM part"


def _normalise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import duckdb

    rare_class = _rare()[0]
    con = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "256MB", "preserve_insertion_order": True})
    for b in batches:
        con.register("part", pa.Table.from_batches([b]))
        # Most parts have no rare form at all; an expression for those that occur is short.
        rare = pc.match_substring_regex(b.column("canon"), rare_class)
        if pc.any(rare).as_py():
            there = set("".join(b.column("canon").filter(pc.fill_null(rare, False)).to_pylist()))
            sql = _SQL.replace("FROM part", f"FROM (SELECT * REPLACE ({rare_sql('canon', there)} AS canon) FROM part)")
        else:
            sql = _SQL
        t = con.sql(sql).to_arrow_table().cast(b.schema)
        yield from t.combine_chunks().to_batches()
        con.unregister("part")
    con.close()


def canonical_text(df: DataFrame, text_col: str, keep: list[str], out: str = "canon") -> DataFrame:
    """The columns `keep` of df and the canonical form of text_col as `out`.

    A null text stays null, an empty one empty; a text of nothing but blanks
    and invisible characters becomes empty.  Texts of any length are done whole."""
    flat = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text_col}`").cast("string").alias("canon"))
    done = spread(flat).mapInArrow(_normalise, flat.schema)
    return done.withColumnRenamed("canon", out) if out != "canon" else done


def lookalike_pairs(blocks: DataFrame, links: DataFrame) -> DataFrame:
    """(page_id, block_id, pos): blocks and links of one page with one canonical text but different strings.

    Null and empty texts, and those that show nothing, have no partner; rows
    that are repeated pair as often as they occur, once in the result.  Only
    (page, canonical text) is shuffled; where a string is its own canonical
    form it is not carried twice."""

    def side(df: DataFrame, id_col: str, raw: str) -> DataFrame:
        keyed = df.select("page_id", id_col, F.col("text").cast("string").alias("text")).where("text is not null and text <> '' and page_id is not null")
        out = canonical_text(keyed.withColumn(raw, F.col("text")), "text", ["page_id", id_col, raw])
        return out.where("canon <> ''").withColumn(raw, F.when(F.col(raw) != F.col("canon"), F.col(raw)))

    b, k = side(blocks, "block_id", "block_raw"), side(links, "pos", "link_raw")
    pairs = b.join(k, ["page_id", "canon"]).where(
        "(block_raw is not null or link_raw is not null) and coalesce(block_raw, canon) <> coalesce(link_raw, canon)"
    )
    return pairs.select("page_id", "block_id", "pos").distinct()
