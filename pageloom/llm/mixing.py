"""Texts of several sources drawn so that each source has its share of the mix, by cube sampling.

How much each source gives follows from its share, its size in tokens and how
often its texts may be used (water filling: what a source cannot give is shared
by the others in proportion to their targets).  A text is used a whole number
of times for certain and once more with the fractional rest as probability.
The cube method moves these probabilities to 0 or 1 through the null space of
two constraints, the number of uses and the number of tokens, so both
totals of each source stay where they were until at most two texts of a source are
left, which the landing decides.

Scale: the flight runs in blocks of `block` texts, whatever source they are of,
and once more over what blocks leave (two texts each) until a source fits into
one block; a source with a third of all texts is many blocks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.llm import tokens
from pageloom.session import cut

_EPS = 1e-9
#: A text of more than this part of its source's tokens is large.
LARGE = 500


def flight(pi: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """pi moved until at most two entries are neither 0 nor 1; sum(pi) and sum(pi * size) stay."""
    p, t = pi.tolist(), size.tolist()
    open_ = [i for i, x in enumerate(p) if _EPS < x < 1 - _EPS]
    live, nxt = open_[:3], 3
    draws = iter(rng.random(len(open_) + 3).tolist())
    while len(live) == 3:
        a, b, c = live
        u, v, w = t[b] - t[c], t[c] - t[a], t[a] - t[b]
        if not (u or v or w):
            u, v, w = 1.0, -1.0, 0.0
        up = down = 1e300
        for x, d in ((p[a], u), (p[b], v), (p[c], w)):
            if d > 0:
                up, down = min(up, (1 - x) / d), min(down, x / d)
            elif d < 0:
                up, down = min(up, -x / d), min(down, (x - 1) / d)
        step = up if next(draws) * (up + down) < down else -down
        for i, d in ((a, u), (b, v), (c, w)):
            x = p[i] + step * d
            p[i] = 0.0 if x < _EPS else 1.0 if x > 1 - _EPS else x
        live = [i for i in live if 0.0 < p[i] < 1.0]
        while len(live) < 3 and nxt < len(open_):
            live.append(open_[nxt])
            nxt += 1
    return np.array(p)


def landing(pi: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """The last one or two open entries decided: the number of uses is kept where it is whole, else off by less than 1."""
    out = pi.copy()
    open_ = np.flatnonzero((pi > _EPS) & (pi < 1 - _EPS))
    if len(open_):
        total, at = pi[open_].cumsum(), rng.random()
        marks = np.floor(total - at)
        out[open_] = (np.diff(marks, prepend=np.floor(-at)) > 0).astype(float)
    return out


def give_by_source(sizes: list[tuple[str, int, int]], shares: dict[str, float], total: float) -> dict[str, float]:
    """Tokens of each source in the mix.  sizes: (source, cap, tokens of its texts with that cap)."""
    room = {s: 0.0 for s in shares}
    for s, cap, n in sizes:
        room[s] += cap * n
    give = dict.fromkeys(shares, 0.0)
    free, left = {s for s in shares if room[s] > 0 and shares[s] > 0}, total
    while free and left > _EPS:
        weight = sum(shares[s] for s in free)
        full = {s for s in free if shares[s] / weight * left >= room[s]}
        if not full:
            give |= {s: shares[s] / weight * left for s in free}
            break
        give |= {s: room[s] for s in full}
        left -= sum(room[s] for s in full)
        free -= full
    return give


def mean_uses(caps: list[tuple[int, int]], want: float) -> float:
    """Uses of a text so that texts of (cap, tokens) give `want` tokens: all rise at once, those at their cap drop out."""
    low, rest, have = 0.0, max(0.0, want), sum(n for _, n in caps)
    for cap, n in sorted(caps):
        if have <= 0 or (cap - low) * have >= rest:
            break
        rest -= (cap - low) * have
        low, have = float(cap), have - n
    return low + (rest / have if have > 0 else 0.0)


def distinct_texts(documents: DataFrame, targets: DataFrame, rank_dir: str | None = None, name: str = tokens.RANK_FILE) -> DataFrame:
    """(doc_id, source, tokens, cap): one row a text of a source with a target.

    Null and empty texts, documents without source and sources without target
    have no part.  Copies of a text count as that text: the smallest doc_id
    stands for them, and its cap is the least of the sources that hold it."""
    goals = targets.where("source is not null").groupBy("source").agg(F.min("max_repeats").alias("cap"))
    docs = documents.where("text is not null and text <> '' and source is not null and doc_id is not null").select("doc_id", "source", "text")
    # The text's digest is taken in the JVM; texts themselves are not shuffled.
    sized = tokens.count_tokens(docs.withColumn("digest", F.md5(F.col("text"))), ["doc_id", "source", "digest"], rank_dir=rank_dir, name=name)
    return sized.join(goals, "source").where("tokens > 0 and cap > 0").groupBy("digest").agg(
        F.min_by(F.struct("doc_id", "source", "tokens"), F.struct("doc_id", "source")).alias("one"), F.min("cap").alias("cap")
    ).select("one.doc_id", "one.source", "one.tokens", "cap")


def mix(documents: DataFrame, targets: DataFrame, total_tokens: float | None = None, block: int = 20_000, seed: int = 11, rank_dir: str | None = None, name: str = tokens.RANK_FILE) -> DataFrame:
    """(doc_id, source, tokens, copies): how often each text is used; texts that are not used have no row.

    total_tokens is the size of the mix, by default all tokens of the sources
    with a target.  Without documents or targets the mix is empty."""
    spark = documents.sparkSession
    units = cut(distinct_texts(documents, targets, rank_dir, name))
    # One row a source of the targets and cap.
    sizes = [(r["source"], r["cap"], r["n"], r["k"]) for r in units.groupBy("source", "cap").agg(F.sum("tokens").alias("n"), F.count("*").alias("k")).collect()]
    shares = {r["source"]: float(r["share"]) for r in targets.where("source is not null").groupBy("source").agg(F.max(F.coalesce("target_share", F.lit(0.0))).alias("share")).collect()}
    total = float(sum(n for _, _, n, _ in sizes)) if total_tokens is None else float(total_tokens)
    give = give_by_source([(s, c, n) for s, c, n, _ in sizes], shares, total)
    size_of = {s: sum(n for x, _, n, _ in sizes if x == s) for s in give}
    # Texts of more than 1/LARGE of their source (less than LARGE a source) are decided first, for what they leave open no other text could make up.
    limits = spark.createDataFrame([(s, float(n) / LARGE) for s, n in size_of.items()], "source string, limit double")
    sided = units.join(limits, "source")
    rng = np.random.default_rng(seed)
    big, blocks_of, uses = [], {}, {}
    found = sorted((r["source"], r["doc_id"], r["tokens"], r["cap"]) for r in sided.where("tokens > limit").select("source", "doc_id", "tokens", "cap").collect())
    for s, want in give.items():
        caps = [(c, n) for x, c, n, _ in sizes if x == s]
        mean = mean_uses(caps, want)
        own = [r for r in found if r[0] == s]
        each = np.array([min(mean, r[3]) for r in own])
        sure = np.floor(each + _EPS)
        tokens_of = np.array([float(r[2]) for r in own])
        copies = sure + np.round(landing(flight(np.maximum(0, each - sure), tokens_of, rng), tokens_of, rng)) if own else sure
        big += [(int(r[1]), s, int(r[2]), int(c)) for r, c in zip(own, copies, strict=True)]
        rest = {c: n for c, n in caps}
        for r in own:
            rest[r[3]] -= r[2]
        uses[s] = mean_uses(list(rest.items()), want - float(copies @ tokens_of if own else 0))
        blocks_of[s] = max(1, -(-sum(k for x, _, _, k in sizes if x == s) // block))
    plan = spark.createDataFrame([(s, float(u), blocks_of[s]) for s, u in uses.items()], "source string, uses double, blocks long")
    planned = sided.where("tokens <= limit").join(plan, "source").withColumn("each", F.least(F.col("uses"), F.col("cap").cast("double"))).withColumn("sure", F.floor(F.col("each") + _EPS).cast("int"))
    state = planned.select("doc_id", "source", "tokens", "sure", F.greatest(F.lit(0.0), F.col("each") - F.col("sure")).alias("pi"), "blocks")

    def one(key, pdf: pd.DataFrame) -> pd.DataFrame:
        rng = np.random.default_rng([seed, *key[0].encode(), int(key[1]), int(key[2])])
        pdf = pdf.sort_values("doc_id").iloc[rng.permutation(len(pdf))].reset_index(drop=True)
        p = flight(pdf["pi"].to_numpy(float), pdf["tokens"].to_numpy(float), rng)
        pdf["pi"] = landing(p, pdf["tokens"].to_numpy(float), rng) if key[2] == 1 else p
        return pdf

    done, blocks = [], max(blocks_of.values(), default=1)
    schema = "doc_id long, source string, tokens long, sure int, pi double, blocks long"
    while True:
        keyed = state.withColumn("block", F.pmod(F.xxhash64("doc_id", F.lit(int(blocks))), F.col("blocks")))
        state = cut(keyed.groupBy("source", "block", "blocks").applyInPandas(lambda key, pdf: one(key, pdf)[["doc_id", "source", "tokens", "sure", "pi", "blocks"]], schema))
        is_open = (F.col("pi") > _EPS) & (F.col("pi") < 1 - _EPS)
        done.append(state.where(~is_open))
        if blocks <= 1:
            break
        blocks = -(-2 * blocks // block)
        state = state.where(is_open).withColumn("blocks", F.ceil(2 * F.col("blocks") / block))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    first = spark.createDataFrame(big, "doc_id long, source string, tokens long, copies int")
    return out.select("doc_id", "source", "tokens", (F.col("sure") + F.round("pi").cast("int")).alias("copies")).unionByName(first).where("copies > 0")


def shares_of(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, texts, uses, tokens, actual_share) of each target; 0 where a source gave nothing."""
    sums = mixed.groupBy("source").agg(F.count("*").alias("texts"), F.sum("copies").alias("uses"), F.sum(F.col("tokens") * F.col("copies")).alias("tokens"))
    total = sums.agg(F.sum("tokens").alias("all_tokens"))
    goals = targets.where("source is not null").groupBy("source").agg(F.max("target_share").alias("target_share"))
    zero = F.lit(0).cast("long")
    # The one row of the total is the only thing that meets all rows.
    return goals.join(sums, "source", "left").join(F.broadcast(total)).select(
        "source", "target_share", *[F.coalesce(c, zero).alias(c) for c in ("texts", "uses", "tokens")], F.coalesce(F.col("tokens") / F.col("all_tokens"), F.lit(0.0)).alias("actual_share")
    )
