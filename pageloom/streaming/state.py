"""Keyed state over streams: runs of repeated values, and exact replay of rule portfolios."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def streaks(stream: DataFrame, key: str, order: str, url: str, value: str) -> DataFrame:
    """(key, order, streak) as the rows arrive; within a batch by `order`.  Arrival order is the truth, there are no watermarks."""
    kinds = {c: stream.schema[c].dataType.simpleString() for c in (key, order)}

    def step(k: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last_url, last_value, n = state.get if state.exists else (None, None, 0)
        rows = pd.concat(list(pdfs)).sort_values(order)
        out = []
        for u, v in zip(rows[url].astype(str), rows[value].astype(str), strict=True):
            n = 1 if last_value != v or last_url is None else n + (u != last_url)
            last_url, last_value = u, v
            out.append(n)
        state.update((last_url, last_value, n))
        yield pd.DataFrame({key: k[0], order: rows[order], "streak": out})

    return stream.select(key, order, url, value).groupBy(key).applyInPandasWithState(
        step, f"{key} {kinds[key]}, {order} {kinds[order]}, streak long", "last_url string, last_value string, n long", "append", GroupStateTimeout.NoTimeout
    )


def extract_stream(pages: DataFrame, specs: list, render: str = "auto") -> DataFrame:
    """Exact replay over a stream of pages, state by scope."""
    from pageloom.functions.portfolio import Portfolio
    from pageloom.operators.extraction import RESULT, _prepared, _ready, page_fields

    ready = _ready(specs)
    names = [c.strip().split(" ")[0] for c in RESULT.split(", ")]

    def step(k: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        books = {f: Portfolio.load(s) for f, s in json.loads(state.get[0] if state.exists else "{}").items()}
        for pdf in pdfs:
            rows = []
            for r in pdf.sort_values(["seq", "page_id"]).itertuples(index=False):
                rows += page_fields(books, ready, r.page_id, r.url, k[0], int(r.seq), r.html if isinstance(r.html, str) else None, r.rendered if isinstance(r.rendered, str) else None, render, True)
            yield pd.DataFrame(rows, columns=names)
        state.update((json.dumps({f: b.dump() for f, b in books.items()}),))

    return _prepared(pages, None, None).groupBy("scope").applyInPandasWithState(step, RESULT, "books string", "append", GroupStateTimeout.NoTimeout)


def drain(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Runs a stream over what there is and ends; restarting goes on where it stopped."""
    q = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()


def early_stop(stream: DataFrame, path: str, checkpoint: str, order: list[str]) -> dict:
    """Writes results batch by batch; stops after the first batch if its first rows say that the rest is not worth it."""
    from pageloom.operators.batch import PREFLIGHT, advisories

    said: dict = {"stopped": False}

    def write(df: DataFrame, epoch: int) -> None:
        if said["stopped"]:
            return
        df.persist()
        if epoch == 0:
            first = df.orderBy(*order).limit(PREFLIGHT)
            bad = advisories(first).where(F.col("code").isin("LOW_BATCH_YIELD", "HIGH_AGENT_ESCALATION")).count()
            said["stopped"] = bad > 0
            (first if bad else df).write.mode("append").parquet(path)
        else:
            df.write.mode("append").parquet(path)
        df.unpersist()

    stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start().awaitTermination()
    return said


def cache_hits(stream: DataFrame, key: str, order: str, at: str, ttl: float) -> DataFrame:
    """(key, order, hit) of requests as they arrive, in order of `at` within a batch: a request less than ttl after the last fetch is a hit.

    The state of a key is the time of its last fetch."""
    kinds = {c: stream.schema[c].dataType.simpleString() for c in (key, order)}

    def step(k: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        fetched = state.get[0] if state.exists else None
        rows, hits = pd.concat(list(pdfs)).sort_values([at, order]), []
        for t in rows[at].tolist():
            hits.append(fetched is not None and t - fetched < ttl)
            if not hits[-1]:
                fetched = t
        state.update((fetched,))
        yield pd.DataFrame({key: k[0], order: rows[order], "hit": hits})

    return stream.select(key, order, at).groupBy(key).applyInPandasWithState(step, f"{key} {kinds[key]}, {order} {kinds[order]}, hit boolean", "fetched double", "append", GroupStateTimeout.NoTimeout)
