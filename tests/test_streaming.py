"""The monitor processes crawls one by one and remembers when a page was first seen."""

import datetime as dt

from rankloom.streaming.monitor import CRAWL_SCHEMA, apply_crawl, watch_crawls


def crawl(spark, folder, day, urls):
    rows = [(1, u, dt.datetime(2024, 1, day)) for u in urls]
    spark.createDataFrame(rows, CRAWL_SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def run(spark, base):
    query = watch_crawls(spark, f"{base}/crawls", f"{base}/out", f"{base}/progress")
    query.awaitTermination(120)
    assert query.exception() is None


def table(spark, path):
    return sorted(tuple(r) for r in spark.read.parquet(path).collect())


def test_monitor_over_arriving_crawls(spark, tmp_path):
    base = str(tmp_path)
    crawl(spark, f"{base}/crawls", 1, ["https://a.com/x/", "https://a.com/y"])
    run(spark, base)
    crawl(spark, f"{base}/crawls", 2, ["https://a.com/x", "https://a.com/z"])
    run(spark, base)
    assert table(spark, f"{base}/out/changes/batch=0") == [(1, "https://a.com/x", "added"), (1, "https://a.com/y", "added")]
    assert table(spark, f"{base}/out/changes/batch=1") == [(1, "https://a.com/y", "removed"), (1, "https://a.com/z", "added")]
    seen = {r.page_url: r.first_seen.day for r in spark.read.parquet(f"{base}/out/snapshot/batch=1").collect()}
    assert seen == {"https://a.com/x": 1, "https://a.com/z": 2}


def test_a_repeated_batch_gives_the_same_snapshot(spark, tmp_path):
    base = str(tmp_path)
    for day, urls in ((1, ["https://a.com/x"]), (2, ["https://a.com/x", "https://a.com/z"])):
        crawl(spark, f"{base}/c{day}", day, urls)
        apply_crawl(spark.read.parquet(f"{base}/c{day}"), day - 1, f"{base}/out")
    before = table(spark, f"{base}/out/snapshot/batch=1")
    apply_crawl(spark.read.parquet(f"{base}/c2"), 1, f"{base}/out")
    assert table(spark, f"{base}/out/snapshot/batch=1") == before
