"""Encoding of texts with a public byte-level BPE tokenizer, from a local rank file.

Special tokens do not exist here: their strings are ordinary text.  A null or
an empty text has the defined ids `[]`.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.session import spread

RANK_DIR = "/opt/tokenizers"
RANK_FILE = "byte_bpe_50k.tiktoken"
#: The pre-split pattern that belongs to the public vocabulary (a fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Texts beyond this many characters are encoded in pieces.
PIECE = 1 << 14
#: No token crosses these places: a visible character before a blank; a letter next to a digit; a digit before a letter.
_SAFE = regex.compile(r"(?<=\S)(?=\s)|(?<=\p{L})(?=\p{N})|(?<=\p{N})(?=\p{L})")


def rank_path(rank_dir: str | None = None, name: str = RANK_FILE) -> str:
    return os.path.join(rank_dir or os.environ.get("PAGELOOM_TOKENIZERS", RANK_DIR), name)


_ENCODERS: dict[str, object] = {}


def encoder(path: str):
    """The encoder of a rank file, made once in a Python worker."""
    if path not in _ENCODERS:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODERS[path] = tiktoken.Encoding("local", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[path]


def pieces(text: str, size: int = PIECE) -> list[str]:
    """text cut at safe places after `size` characters or more; whole where it has no safe place."""
    if len(text) <= size:
        return [text]
    out, at = [], 0
    while len(text) - at > size:
        m = _SAFE.search(text, at + size)
        if m is None:
            break
        out.append(text[at : m.start()])
        at = m.start()
    out.append(text[at:])
    return out


def encode(enc, text: str | None) -> list[int]:
    if not text:
        return []
    if len(text) <= PIECE:
        return enc.encode_ordinary(text)
    return [i for p in pieces(text) for i in enc.encode_ordinary(p)]


def decode(enc, ids: list[int]) -> bytes:
    """The raw bytes of ids; a cut of ids may end inside a character, so text is only made of whole texts' bytes."""
    return enc.decode_bytes(ids)


def encode_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rank_dir: str | None = None, name: str = RANK_FILE) -> DataFrame:
    """(id_col, ids): one row a document; `[]` where the text is null or empty.  No shuffle."""
    path = rank_path(rank_dir, name)
    flat = df.select(F.col(f"`{id_col}`").alias(id_col), F.col(f"`{text_col}`").cast("string").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            ids = [encode(enc, t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], [id_col, "ids"])

    kind = flat.schema[id_col].dataType.simpleString()
    return spread(flat).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def count_tokens(df: DataFrame, keep: list[str], text_col: str = "text", out: str = "tokens", rank_dir: str | None = None, name: str = RANK_FILE) -> DataFrame:
    """The columns `keep` and the number of tokens of text_col (0 where null or empty)."""
    path = rank_path(rank_dir, name)
    flat = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text_col}`").cast("string").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            n = pa.array([len(encode(enc, t)) for t in b.column(len(keep)).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), n], [*keep, out])

    kinds = ", ".join(f"`{c}` {flat.schema[c].dataType.simpleString()}" for c in keep)
    return spread(flat).mapInArrow(run, f"{kinds}, `{out}` bigint")


def verify_round_trip(docs: DataFrame, encoded: DataFrame, id_col: str = "doc_id", text_col: str = "text", rank_dir: str | None = None, name: str = RANK_FILE) -> DataFrame:
    """(id_col, same): whether the ids decode to the bytes of the text."""
    path = rank_path(rank_dir, name)
    both = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("__text")).join(encoded.select(id_col, "ids"), id_col)
    kind = both.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            rows = zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([decode(enc, ids) == t.encode() for t, ids in rows])], [id_col, "same"])

    return both.mapInArrow(run, f"`{id_col}` {kind}, same boolean")
