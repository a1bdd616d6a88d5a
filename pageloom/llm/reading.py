"""Reading levels by a linear ranker learned from pairs of graded documents.

Features are of syntax (lengths of sentences, clauses and words, and their
spread) and of vocabulary (words hashed into a fixed number of weights).  The
ranker is fitted so that of two graded documents the harder one scores higher
(logistic loss on score differences); isotonic regression turns scores into
levels.  Fitting reads at most `max_graded` graded documents, taken by a hash
of their id; scoring reads every document whole and shuffles nothing.
"""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.session import spread

#: Documented bound of the fitting sample: graded documents read by the driver.
MAX_GRADED = 4000
VOCABULARY = 1 << 15
_MARKUP = re.compile(r"<[^<>]{1,200}>|&[a-z]{2,8};|https?://\S+|\S+@\S+\.\S+")
_WORD = r"[^\W\d_]+(?:[’'][^\W\d_]+)*"
#: Words, ends of sentences (also of list items and paragraphs), and marks between clauses.
_TOKEN = re.compile(_WORD + r"|[.!?…]+(?=\s|$)|\n\s*(?:\n|[-*•])\s*|[,;:–—()]")
_CLAUSE = frozenset(",;:–—()")
_UNSEEN = re.compile(r"[\xad\u200b-\u200f\u202a-\u202e\u2060-\u2064\ufeff]")
_VOWELS = re.compile(r"[aeiouyäöüàáâãåæèéêëìíîïòóôõøœùúûý]+")
_LONG = (6, 8, 10, 13, 16)
SYNTAX = ["sentence", "sentence_max", "clause", "clauses", "word", "syllables", "word_spread", *[f"over_{n}" for n in _LONG], "marks", "distinct"]


def features(text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """(syntax, hashed words, their weights); null where the text has no sentence.

    A sentence needs three different words; texts of digits, of blanks or of one
    repeated run, null and empty texts have none."""
    if not text:
        return None
    if not text.isascii():
        if not unicodedata.is_normalized("NFKC", text):
            text = unicodedata.normalize("NFKC", text)
        text = _UNSEEN.sub("", text)
    text = _MARKUP.sub(" ", text).lower()
    counts: dict[str, int] = {}
    sentences, clauses, marks, of_sentence, of_clause = [], [], 0, 0, 0
    for t in _TOKEN.findall(text):
        if t[0].isalpha():
            counts[t] = counts.get(t, 0) + 1
            of_clause += 1
            continue
        if of_clause:
            clauses.append(of_clause)
            of_sentence += of_clause
            of_clause = 0
        if t in _CLAUSE:
            marks += 1
        elif of_sentence:
            sentences.append(of_sentence)
            of_sentence = 0
    if of_clause:
        clauses.append(of_clause)
    if of_sentence + of_clause:
        sentences.append(of_sentence + of_clause)
    total = sum(sentences)
    if len(counts) < 3 or total < 4:
        return None
    often = np.fromiter(counts.values(), float, len(counts))
    lengths = np.fromiter(map(len, counts), float, len(counts))
    mean = float(lengths @ often) / total
    lg = math.log1p
    syntax = [
        lg(total / len(sentences)), lg(sorted(sentences)[int(0.9 * (len(sentences) - 1))]), lg(total / len(clauses)), len(clauses) / len(sentences), mean,
        len(_VOWELS.findall(text)) / total, math.sqrt(float((lengths - mean) ** 2 @ often) / total), *[float(often[lengths > n].sum()) / total for n in _LONG], marks / total, lg(len(counts)) / lg(total),
    ]
    at = np.fromiter((zlib.crc32(w.encode()) % VOCABULARY for w in counts), np.int64, len(counts))
    weight = np.sqrt(often)
    return np.asarray(syntax, float), at, weight / np.linalg.norm(weight)


@dataclass
class Ranker:
    mean: np.ndarray
    scale: np.ndarray
    syntax: np.ndarray
    words: np.ndarray
    #: Isotonic steps: a score of at least knots[i] has level levels[i].
    knots: np.ndarray
    levels: np.ndarray

    def score(self, f) -> float:
        return float(((f[0] - self.mean) / self.scale) @ self.syntax + self.words[f[1]] @ f[2])

    def level(self, score: float) -> float:
        return float(np.interp(score, self.knots, self.levels)) if len(self.knots) else 3.0


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: non-decreasing levels over scores, as (scores, levels)."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []  # sum, count, sum of scores
    for a, b in zip(x[order], y[order], strict=True):
        blocks.append([b, 1, a])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            s, n, t = blocks.pop()
            blocks[-1][0] += s
            blocks[-1][1] += n
            blocks[-1][2] += t
    return np.array([t / n for _, n, t in blocks]), np.array([s / n for s, n, _ in blocks])


def _rank(feats: list, grades: np.ndarray, rounds: int, penalty: float, seed: int):
    """Weights of the pairwise logistic ranker, by Adam on all pairs drawn."""
    n = len(feats)
    syn = np.stack([f[0] for f in feats])
    mean, scale = syn.mean(0), syn.std(0) + 1e-6
    syn = (syn - mean) / scale
    row = np.repeat(np.arange(n), [len(f[1]) for f in feats])
    at, val = np.concatenate([f[1] for f in feats]), np.concatenate([f[2] for f in feats])
    rng = np.random.default_rng(seed)
    a = np.repeat(np.arange(n), 40)
    b = rng.integers(0, n, len(a))
    keep = grades[a] > grades[b]
    a, b = a[keep], b[keep]
    gap = np.minimum(grades[a] - grades[b], 3.0)
    w, v = np.zeros(syn.shape[1]), np.zeros(VOCABULARY)
    state = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(v), np.zeros_like(v)]
    for t in range(1, rounds + 1 if len(a) else 0):
        s = syn @ w + np.bincount(row, v[at] * val, n)
        # The margin asked for grows with the gap of the grades.
        p = 1 / (1 + np.exp(np.clip(s[a] - s[b] - gap, -30, 30)))
        c = np.bincount(b, p, n) - np.bincount(a, p, n)
        grads = syn.T @ c / len(a) + penalty * w, np.bincount(at, c[row] * val, VOCABULARY) / len(a) + penalty * v
        for i, (x, g) in enumerate(((w, grads[0]), (v, grads[1]))):
            m, q = state[2 * i], state[2 * i + 1]
            m += 0.1 * (g - m)
            q += 0.01 * (g * g - q)
            x -= 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(q / (1 - 0.99**t)) + 1e-8)
    return mean, scale, w, v


def fit(graded: list[tuple[tuple, float]], rounds: int = 150, penalty: float = 1e-5, seed: int = 7) -> Ranker:
    """graded: features and mean grade of each document.  A quarter is held out of the ranking for the calibration where there are enough."""
    grades = np.array([g for _, g in graded], float)
    feats = [f for f, _ in graded]
    if len(feats) < 2:
        k = len(SYNTAX)
        return Ranker(np.zeros(k), np.ones(k), np.zeros(k), np.zeros(VOCABULARY), np.array([0.0]), np.array([grades.mean() if len(grades) else 3.0]))
    # By a seeded permutation, for ids may go with levels.
    held = np.random.default_rng(seed).permutation(len(feats)) % 4 == 3 if len(feats) >= 80 else np.ones(len(feats), bool)
    used = np.flatnonzero(~held) if len(feats) >= 80 else np.arange(len(feats))
    r = Ranker(*_rank([feats[i] for i in used], grades[used], rounds, penalty, seed), np.array([]), np.array([]))
    scores = np.array([r.score(feats[i]) for i in np.flatnonzero(held)])
    r.knots, r.levels = isotonic(scores, grades[held])
    return r


def graded_features(documents: DataFrame, labels: DataFrame, max_graded: int = MAX_GRADED) -> list[tuple[tuple, float]]:
    """Features and mean grade of at most max_graded documents; null levels and repeated rows don't count."""
    grades = labels.where("reading_level is not null and doc_id is not null").select("doc_id", "reading_level", "grader").distinct().groupBy("doc_id").agg(F.avg("reading_level").alias("grade"))
    some = grades.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_graded)
    # max_graded rows of two numbers are broadcast.
    chosen = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(some), "doc_id").select("doc_id", "text", "grade")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, f, g) for i, t, g in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True) if (f := features(t))]
            yield pa.RecordBatch.from_arrays(
                [pa.array([i for i, _, _ in rows], pa.int64()), *(pa.array([f[k].tolist() for _, f, _ in rows], pa.list_(pa.float64() if k != 1 else pa.int64())) for k in range(3)), pa.array([g for _, _, g in rows], pa.float64())],
                ["doc_id", "syntax", "words", "weights", "grade"],
            )

    t = chosen.mapInArrow(run, "doc_id long, syntax array<double>, words array<long>, weights array<double>, grade double").toArrow().sort_by("doc_id")
    return [
        ((np.asarray(r["syntax"]), np.asarray(r["words"], np.int64), np.asarray(r["weights"])), r["grade"]) for b in t.to_batches(500) for r in b.to_pylist()
    ]


def score_documents(documents: DataFrame, ranker: Ranker) -> DataFrame:
    """(doc_id, score, level, reading_level): level as calibrated, reading_level rounded to 1..5; null without sentences."""
    flat = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scores = [None if f is None else ranker.score(f) for f in map(features, b.column(1).to_pylist())]
            levels = [None if s is None else ranker.level(s) for s in scores]
            whole = [None if x is None else int(min(5, max(1, np.floor(x + 0.5)))) for x in levels]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores, pa.float64()), pa.array(levels, pa.float64()), pa.array(whole, pa.int32())], ["doc_id", "score", "level", "reading_level"])

    return spread(flat).mapInArrow(run, "doc_id long, score double, level double, reading_level int")


def reading_levels(documents: DataFrame, labels: DataFrame, max_graded: int = MAX_GRADED) -> DataFrame:
    """(doc_id, reading_level) of every document; null where the text has no sentences.  No labels: level 3 for all."""
    return score_documents(documents, fit(graded_features(documents, labels, max_graded))).select("doc_id", "reading_level")
