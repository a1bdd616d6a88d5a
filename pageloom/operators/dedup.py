"""Exactly one copy of each message that was delivered at least once.

Identifiers are dictionary-encoded exactly (a code for each distinct
identifier, dense within its shard), seen codes live in compressed bitmaps,
one bitmap a shard, and a batch keeps one arrival for each bit that was not yet
set.  A batch writes the new dictionary entries and the new bits only; they
become visible all at once, when the driver creates the manifest that names
them.  A whole table is run as a few batches in order of arrival, so the first
arrival of a message is in the first batch that shows it.

Scale.  Each Arrow chunk first keeps only its own best arrival of an
identifier (every other one is certainly surplus), so an identifier that holds
a third of all rows sends one row a chunk into the shuffle.  The shuffle then
carries the survivors' keys only, spread over shards whose number follows from
the number of rows.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.session import cut, shared_dir

CHUNK = 1 << 16


class SeenBitmap:
    """A set of codes in blocks of 65,536 bits: all set, none set, or a bit array; zstd on disk."""

    def __init__(self, blocks: dict[int, np.ndarray | None] | None = None):
        #: None stands for a block in which every bit is set.
        self.blocks: dict[int, np.ndarray | None] = blocks or {}

    def contains(self, codes: np.ndarray) -> np.ndarray:
        out = np.zeros(len(codes), bool)
        high, low = codes >> 16, codes & 0xFFFF
        for h in np.unique(high):
            at = high == h
            if h in self.blocks:
                bits = self.blocks[int(h)]
                out[at] = True if bits is None else (bits[low[at] >> 3] >> (low[at] & 7).astype(np.uint8)) & 1 == 1
        return out

    def add(self, codes: np.ndarray) -> None:
        high, low = codes >> 16, codes & 0xFFFF
        for h in np.unique(high):
            bits = self.blocks.get(int(h), np.zeros(8192, np.uint8))
            if bits is None:
                continue
            flags = np.unpackbits(bits, bitorder="little")
            flags[low[high == h]] = 1
            self.blocks[int(h)] = None if flags.all() else np.packbits(flags, bitorder="little")

    def union(self, other: SeenBitmap) -> SeenBitmap:
        out = dict(self.blocks)
        for h, bits in other.blocks.items():
            mine = out.get(h, np.zeros(8192, np.uint8))
            both = None if bits is None or mine is None else mine | bits
            out[h] = None if both is None or bool((both == 255).all()) else both
        return SeenBitmap(out)

    def dumps(self) -> bytes:
        head = np.array([[h, bits is None] for h, bits in sorted(self.blocks.items())], "<i8").reshape(-1, 2)
        body = b"".join(bits.tobytes() for _, bits in sorted(self.blocks.items()) if bits is not None)
        return zstandard.compress(len(head).to_bytes(8, "little") + head.tobytes() + body)

    @staticmethod
    def loads(data: bytes | None) -> SeenBitmap:
        if not data:
            return SeenBitmap()
        raw = zstandard.decompress(data)
        n = int.from_bytes(raw[:8], "little")
        head, at, blocks = np.frombuffer(raw, "<i8", 2 * n, 8).reshape(-1, 2), 8 + 16 * n, {}
        for h, full in head.tolist():
            blocks[h] = None if full else np.frombuffer(raw, np.uint8, 8192, at).copy()
            at += 0 if full else 8192
        return SeenBitmap(blocks)


def exact_key(column: str) -> Column:
    """The identifier as it is, without blanks around it; null where it is null."""
    return F.trim(F.col(column).cast("string"))


def hex_key(column: str = "msg_id") -> Column:
    """The hexadecimal digits of an identifier; null where the identifier is null.

    An identifier without any hexadecimal digit keeps its trimmed text, with a
    mark before it that no digits can give, so that it equals only itself."""
    text = F.col(column).cast("string")
    digits = F.regexp_replace(F.lower(text), "[^0-9a-f]", "")
    return F.when(digits != "", digits).when(text.isNotNull(), F.concat(F.lit("="), F.trim(text)))


def _best_of_chunk(keys: np.ndarray, at: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Marks the first arrival of each key: least time, then least id."""
    order = np.lexsort((ids, at, keys))
    first = np.ones(len(order), bool)
    first[1:] = keys[order][1:] != keys[order][:-1]
    best = np.zeros(len(order), bool)
    best[order[first]] = True
    return best


_ARRIVALS = "key string, at long, id long, local boolean"


def arrivals(df: DataFrame, id_col: str, msg_col: str, time_col: str, key: Callable[[str], Column] = hex_key) -> DataFrame:
    """(key, at, id, local): local is false for arrivals that lose within their chunk.

    Rows with a null identifier are messages of their own and leave here; a
    null time counts as later than any time, a null id as larger than any id."""
    last = F.lit(2**63 - 1)
    flat = df.select(
        key(msg_col).alias("key"),
        F.coalesce(F.unix_micros(F.col(time_col).cast("timestamp")), last).alias("at"),
        F.coalesce(F.col(id_col).cast("long"), last).alias("id"),
    ).where("key is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0

        def out() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            codes = pc.dictionary_encode(t["key"]).combine_chunks().indices.to_numpy(zero_copy_only=False)
            best = _best_of_chunk(codes, t["at"].to_numpy(), t["id"].to_numpy())
            return pa.RecordBatch.from_arrays([*(c.combine_chunks() for c in t.columns), pa.array(best)], ["key", "at", "id", "local"])

        for b in batches:
            if b.num_rows:
                held.append(b)
                rows += b.num_rows
                if rows >= CHUNK:
                    yield out()
                    held, rows = [], 0
        if held:
            yield out()

    return flat.mapInArrow(run, _ARRIVALS)


_SHARD = "shard int, id long, kept boolean, first long, dictionary binary, bitmap binary"


def _encode(keys: pa.Array, known: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Codes of keys under the dictionary `known`, which new keys extend in order of arrival."""
    codes = pc.fill_null(pc.index_in(keys, value_set=known), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    new = codes < 0
    if new.any():
        added = pc.dictionary_encode(keys.filter(pa.array(new)))
        codes[new] = len(known) + added.indices.to_numpy(zero_copy_only=False)
        known = pa.concat_arrays([known, added.dictionary.cast(pa.string())])
    return codes, known


def _pack(known: pa.Array) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, pa.schema([("key", pa.string())])) as w:
        w.write_batch(pa.record_batch([known], ["key"]))
    return zstandard.compress(sink.getvalue().to_pybytes())


def _unpack(data: bytes | None) -> pa.Array:
    if not data:
        return pa.array([], pa.string())
    t = pa.ipc.open_stream(zstandard.decompress(data)).read_all()["key"].combine_chunks()
    return t if isinstance(t, pa.Array) else pa.concat_arrays(t.chunks)


class SeenStore:
    """Dictionaries and seen-bitmaps by shard in a shared folder.

    A batch writes what it adds to a folder of its own and then creates one
    small manifest, numbered after the newest one, that names all folders of the
    state; creating it fails if another batch has taken the number.  A reader
    follows the newest whole manifest, so a batch is seen wholly or not at all,
    and a batch that died half way leaves nothing that counts.  Every
    `compact_after` batches the state is written whole, and folders that neither
    of the last two manifests names are removed."""

    def __init__(self, spark: SparkSession, path: str, compact_after: int = 8):
        self.spark, self.path, self.compact_after = spark, path.rstrip("/"), compact_after
        jvm = spark.sparkContext._jvm
        self._p = jvm.org.apache.hadoop.fs.Path
        self._fs = self._p(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _manifests(self) -> list[tuple[int, dict | None]]:
        """(number, content) of all manifests; a content that was not written to its end is None."""
        root = self._p(f"{self.path}/manifests")
        if not self._fs.exists(root):
            return []
        numbers = sorted(int(n[:-5]) for f in self._fs.listStatus(root) if (n := f.getPath().getName()).endswith(".json") and n[:-5].isdigit())
        out: list[tuple[int, dict | None]] = []
        for n in numbers[-3:]:
            text = self.spark.read.text(f"{self.path}/manifests/{n:012d}.json", wholetext=True).first()
            try:
                out.append((n, json.loads(text[0]) if text else None))
            except ValueError:
                out.append((n, None))
        return out

    def version(self) -> tuple[int, dict | None]:
        """The newest number, and the newest whole manifest."""
        all_of = self._manifests()
        return (all_of[-1][0] if all_of else 0), next((m for _, m in reversed(all_of) if m), None)

    def state(self, shards: int) -> DataFrame | None:
        _, m = self.version()
        if m is None:
            return None
        if m["shards"] != shards:
            raise ValueError(f"the store has {m['shards']} shards, not {shards}")
        return self.spark.read.parquet(*[f"{self.path}/{d}" for d in m["data"]])

    def publish(self, data: list[str], shards: int, base: int) -> None:
        """Makes the folders `data` the newest state, unless another batch was published since `base`."""
        try:
            out = self._fs.create(self._p(f"{self.path}/manifests/{base + 1:012d}.json"), False)
        except Exception as e:
            raise RuntimeError("another batch was published meanwhile; run this batch again") from e
        out.write(bytearray(json.dumps({"data": data, "shards": shards}).encode()))
        out.close()
        named = {d for _, m in self._manifests()[-2:] if m for d in m["data"]}
        if len(data) == 1:
            for f in self._fs.listStatus(self._p(self.path)):
                name = f.getPath().getName()
                if name.startswith("state-") and name not in named and int(name[6:18]) <= base:
                    self._fs.delete(f.getPath(), True)


def select_unseen(cand: DataFrame, shards: int, state: DataFrame | None = None, whole: bool = False) -> DataFrame:
    """One kept arrival for each unseen bit of a shard, and a row a shard with what is new in its dictionary and bitmap; all of it if `whole`."""
    left = cand.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int"))
    names = ["shard", "id", "kept", "first", "dictionary", "bitmap"]

    def one(shard: int, rows: pa.Table, old: pa.Table | None) -> pa.Table:
        parts = sorted(old.select(["first", "dictionary", "bitmap"]).to_pylist(), key=lambda r: r["first"]) if old is not None else []
        known = pa.concat_arrays([pa.array([], pa.string()), *(_unpack(r["dictionary"]) for r in parts)])
        seen = SeenBitmap()
        for r in parts:
            seen = seen.union(SeenBitmap.loads(r["bitmap"]))
        before = len(known)
        keys = rows["key"].combine_chunks() if rows.num_rows else pa.array([], pa.string())
        codes, known = _encode(keys, known)
        at, ids = rows["at"].to_numpy(), rows["id"].to_numpy()
        kept = _best_of_chunk(codes, at, ids) & ~seen.contains(codes)
        new = SeenBitmap()
        new.add(codes[kept])
        n = len(ids)
        out = pa.table([pa.array(np.full(n, shard, np.int32)), pa.array(ids), pa.array(kept), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary())], names)
        first, entries, bits = (0, known, seen.union(new)) if whole else (before, known[before:], new)
        if whole or len(entries):
            out = pa.concat_tables([out, pa.table([pa.array([shard], pa.int32()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.bool_()), pa.array([first], pa.int64()), pa.array([_pack(entries)], pa.binary()), pa.array([bits.dumps()], pa.binary())], names)])
        return out

    if state is None:
        return left.groupBy("shard").applyInArrow(lambda key, t: one(key[0].as_py(), t, None), _SHARD)
    return left.groupBy("shard").cogroup(state.groupBy("shard")).applyInArrow(lambda key, a, b: one(key[0].as_py(), a, b), _SHARD)


#: Rows of a shard: its dictionary is held by one task.
SHARD_ROWS = 1_000_000


def shard_count(spark: SparkSession, rows: int) -> int:
    """At least a shard for each core, and few enough rows in each that its dictionary fits in a task."""
    return max(8, spark.sparkContext.defaultParallelism, -(-rows // SHARD_ROWS))


def _keep(store: SeenStore, cand: DataFrame, shards: int) -> DataFrame:
    """(id, kept) of a batch's candidates; the store knows them when this returns."""
    base, m = store.version()
    before = m["data"] if m else []
    whole = len(before) >= store.compact_after
    data, at = f"state-{base + 1:012d}-{uuid.uuid4().hex}", f"{store.path}/ids-{base + 1:012d}-{uuid.uuid4().hex}"
    select_unseen(cand, shards, store.state(shards), whole).write.partitionBy("kept").parquet(at)
    out = store.spark.read.schema(_SHARD).parquet(at)
    out.where("bitmap is not null").select("shard", "first", "dictionary", "bitmap").coalesce(max(1, shards // 8)).write.parquet(f"{store.path}/{data}")
    store.publish([data] if whole else [*before, data], shards, base)
    return out.where("bitmap is null").select("id", "kept")


def surplus_deliveries(df: DataFrame, id_col: str = "delivery_id", msg_col: str = "msg_id", time_col: str = "received_at", key: Callable[[str], Column] = hex_key, batches: int = 3, shards: int | None = None) -> DataFrame:
    """Ids of all arrivals but the first of each message (least time, then least id).

    The arrivals are taken in `batches` slices of time, one after another; what a
    slice has seen is in the bitmaps of a store in the shared folder when the next
    one comes.  `key` says which identifiers are the same: by default their
    hexadecimal digits, as this project's messages are written; `exact_key` where
    other characters count.  Null identifiers are never surplus; empty input gives no rows;
    further columns, whatever their names, are not read."""
    spark = df.sparkSession
    a = cut(arrivals(df, id_col, msg_col, time_col, key))
    best = a.where("local").select("key", "at", "id")
    rows, bounds = best.agg(F.count("*"), F.percentile_approx("at", [i / batches for i in range(1, batches)] or [0.5], 1000)).first()
    store, shards = SeenStore(spark, f"{shared_dir(spark)}/seen-{uuid.uuid4().hex}"), shards or shard_count(spark, rows)
    edges = sorted(set(bounds or [])) if batches > 1 else []
    lost = a.where("not local").select("id")
    for low, high in zip([None, *edges], [*edges, None], strict=True):
        part = best.where((F.lit(True) if low is None else F.col("at") > low) & (F.lit(True) if high is None else F.col("at") <= high))
        lost = lost.unionByName(_keep(store, part, shards).where("not kept").select("id"))
    return lost.select(F.col("id").alias(id_col))


def keep_new(store: SeenStore, batch: DataFrame, shards: int, id_col: str = "delivery_id", msg_col: str = "msg_id", time_col: str = "received_at", key: Callable[[str], Column] = hex_key) -> DataFrame:
    """Ids of a batch's arrivals to keep: the first of each message that no earlier batch has shown.

    The batch's new codes are unioned into the store before this returns; if it
    fails before, the store is as it was and the batch can be run again.  Rows
    with a null identifier are all kept."""
    a = arrivals(batch, id_col, msg_col, time_col, key).where("local").select("key", "at", "id")
    nulls = batch.where(key(msg_col).isNull()).select(F.col(id_col).cast("long").alias(id_col))
    return _keep(store, a, shards).where("kept").select(F.col("id").alias(id_col)).unionByName(nulls)
