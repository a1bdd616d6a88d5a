import random
from datetime import datetime, timedelta

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from pageloom.operators import batch, dedup, policy, rulebook
from pyspark.sql import functions as F

DDL = "delivery_id long, msg_id string, received_at timestamp_ntz, url string, key string, id long, local string"


def rows(n, seed, hot=0.3):
    r = random.Random(seed)
    t0, out = datetime(2031, 3, 1), []
    for i in range(n):
        m = None if r.random() < 0.05 else f"{0 if r.random() < hot else r.randrange(n // 3):032x}"
        if m and r.random() < 0.3:
            m = "{" + m.upper()[:8] + "-" + m[8:] + "}"
        out.append((i, m, t0 + timedelta(seconds=r.randrange(40)), None, "k", 1, "x"))
    return out


def brute(data):
    best, out = {}, set()
    for d in data:
        if d[1] is not None:
            k = "".join(c for c in d[1].lower() if c in "0123456789abcdef")
            best[k] = min(best.get(k, (d[2], d[0])), (d[2], d[0]))
    for d in data:
        if d[1] is not None and best["".join(c for c in d[1].lower() if c in "0123456789abcdef")] != (d[2], d[0]):
            out.add(d[0])
    return out


def test_surplus_is_what_brute_force_finds(spark):
    data = rows(3000, 1)
    df = spark.createDataFrame(data, DDL).repartition(7)
    got = [r[0] for r in dedup.surplus_deliveries(df).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(data)
    assert dedup.surplus_deliveries(df.limit(0)).count() == 0


def test_batches_keep_what_no_earlier_batch_had(spark, tmp_path):
    data = rows(600, 2)
    store = dedup.SeenStore(spark, str(tmp_path / "seen"))
    seen, kept = set(), []
    for part in (data[:250], data[250:400], [], data[400:]):
        kept += [r[0] for r in dedup.keep_new(store, spark.createDataFrame(part, DDL), 4).collect()]
    key = lambda m: "".join(c for c in m.lower() if c in "0123456789abcdef")
    want = [d[0] for d in data if d[1] is None]
    for part in (data[:250], data[250:400], data[400:]):
        best = {}
        for d in part:
            if d[1] is not None and key(d[1]) not in seen:
                best[key(d[1])] = min(best.get(key(d[1]), (d[2], d[0])), (d[2], d[0]))
        seen |= set(best)
        want += [i for _, i in best.values()]
    assert sorted(kept) == sorted(want)
    assert store.version()[0] == 4


def test_stores_compact_and_refuse_a_taken_number(spark, tmp_path):
    store = dedup.SeenStore(spark, str(tmp_path / "seen"), compact_after=2)
    ids = [sorted(r[0] for r in dedup.keep_new(store, spark.createDataFrame([(10 * n + i, f"order-{n + i}", datetime(2031, 3, 1), None, "k", 1, "x") for i in range(3)], DDL), 2, key=dedup.exact_key).collect()) for n in range(5)]
    assert ids == [[0, 1, 2], [12], [22], [32], [42]]
    assert store.version()[0] == 5 and len(store.version()[1]["data"]) == 1
    try:
        store.publish([], 2, 4)
        raise AssertionError("the number was taken")
    except RuntimeError:
        pass
    # By their hexadecimal digits alone these two were one message.
    two = spark.createDataFrame([(1, "order-12", datetime(2031, 3, 1), None, "k", 1, "x"), (2, "older-12", datetime(2031, 3, 1), None, "k", 1, "x")], DDL)
    assert dedup.surplus_deliveries(two, key=dedup.exact_key).count() == 0 and [r[0] for r in dedup.surplus_deliveries(two).collect()] == [2]


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(0, 200_000), max_size=60), st.lists(st.integers(0, 200_000), max_size=60))
def test_bitmaps(a, b):
    x, y = dedup.SeenBitmap(), dedup.SeenBitmap()
    x.add(np.array(a, np.int64))
    y.add(np.array(b, np.int64))
    z = dedup.SeenBitmap.loads(x.union(y).dumps())
    probe = np.arange(0, 200_001, 37)
    assert set(probe[z.contains(probe)].tolist()) == (set(a) | set(b)) & set(probe.tolist())


def test_cache_is_walked_in_order(spark):
    r = random.Random(3)
    data = [(r.randrange(5), i, float(r.randrange(2000))) for i in range(500)]
    got = {(x["k"], x["i"]): x["hit"] for x in policy.cache_hits(spark.createDataFrame(data, "k int, i int, at double"), ["k"], "at", ["i"], 100.0, []).collect()}
    last = {}
    for k, i, at in sorted(data, key=lambda d: (d[0], d[2], d[1])):
        hit = k in last and at - last[k] < 100
        assert got[k, i] == hit
        if not hit:
            last[k] = at


def test_robots_and_gates(spark):
    urls = spark.createDataFrame([("https://a.example/x",), ("https://a.example/private/y",), ("https://b.example/",), ("https://c.example/z",)], "url string")
    robots = spark.createDataFrame([("https://a.example", 200, "User-agent: *\nDisallow: /private"), ("https://b.example", 403, None)], "root string, status int, body string")
    got = {r["url"]: r["allowed"] for r in policy.robots_allowed(urls, robots, "pageloom").collect()}
    assert got == {"https://a.example/x": True, "https://a.example/private/y": False, "https://b.example/": False, "https://c.example/z": True}
    g = spark.createDataFrame([("ftp://a/x",), ("https:///x",), ("https://x.deny.example/",), (None,)], "u string").select(policy.url_gate(F.col("u"), ["deny.example"]).alias("g"))
    assert [r["g"] for r in g.collect()] == ["URL_SCHEME_DENIED", "URL_INVALID", "HOST_DENIED", "URL_SCHEME_DENIED"]


def test_streaks_and_advisories(spark):
    log = spark.createDataFrame([(1, i, u, v) for i, (u, v) in enumerate([("a", "x"), ("a", "x"), ("b", "x"), ("c", "y"), ("d", "y"), ("d", "z")])], "k int, i int, u string, v string")
    assert [r["streak"] for r in rulebook.streaks(log, ["k"], ["i"], "u", "v").orderBy("i").collect()] == [1, 1, 2, 1, 2, 1]
    bad = spark.createDataFrame([(i, True, "INCOMPLETE", [("f", "NEEDS_AGENT")], None) for i in range(12)], "i int, ok boolean, status string, fields array<struct<name:string,status:string>>, error struct<code:string,recoverable:boolean>")
    assert {r["code"] for r in batch.advisories(bad).collect()} == {"LOW_BATCH_YIELD", "HIGH_AGENT_ESCALATION", "SYSTEMATIC_FIELD_GAPS"}
    assert {r["code"] for r in batch.advisories(bad.limit(0)).collect()} == {"EMPTY_INPUT_SET"}
