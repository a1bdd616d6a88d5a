import json
import time

from pageloom.sources import files


def ordered(spark, path):
    return [r["url"] for r in files.url_set(spark, str(path)).orderBy("pos").collect()]


def test_url_lists_are_read_in_blocks_and_kept_in_order(spark, tmp_path):
    # 120,000 lines of one file in blocks of 64 KB, some seconds; a plan that looks at the whole text for every line takes minutes.
    urls = [f"https://list.example/{i * 7919 % 40_009}/{'x' * 80}" for i in range(60_000)]
    (tmp_path / "one.txt").write_text("﻿# first\r\n\r\n" + "".join(f" {u}\t\r\n# a note\n" for u in urls) + "https://list.example/last")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        began = time.time()
        got = files.url_set(spark, str(tmp_path / "one.txt"))
        read = spark.read.text(str(tmp_path / "one.txt"), lineSep="\n").rdd.getNumPartitions()
        assert read > 4 and [r["url"] for r in got.orderBy("pos").collect()] == [*dict.fromkeys(urls), "https://list.example/last"]
        assert time.time() - began < 60
        assert got.select("pos").distinct().count() == 40_010
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_url_lists_over_files_and_arrays(spark, tmp_path):
    at = tmp_path / "in [1] %"
    at.mkdir()
    (at / "a.txt").write_text("https://a.example/2\nhttps://a.example/1\n")
    (at / "b.json").write_text("\n " + json.dumps(["https://b.example/1", " https://a.example/1 ", "", None, "#x"], indent=1))
    (at / "c.txt").write_text("# [\nhttps://b.example/1\n[odd\nhttps://c.example/1")
    (at / "d.json").write_text('["https://d.example/1"]')
    (at / "e.txt").write_text("")
    assert ordered(spark, tmp_path / "in ?1? %") == ["https://a.example/2", "https://a.example/1", "https://b.example/1", "#x", "[odd", "https://c.example/1", "https://d.example/1"]
    (tmp_path / "none.txt").write_text("\n# none\n")
    assert ordered(spark, tmp_path / "none.txt") == []
    files.write_url_list(files.url_set(spark, str(tmp_path / "in ?1? %")), str(tmp_path / "out"), "pos")
    assert ordered(spark, tmp_path / "out")[:3] == ["https://a.example/2", "https://a.example/1", "https://b.example/1"]
