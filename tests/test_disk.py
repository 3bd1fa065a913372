"""What is exchanged and stored on the way to the first rows, and that the results are those of a plain fold."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from rankloom import session
from rankloom.operators import link_facts, link_intel, ranking
from rankloom.plans import views

EXAMPLE = (
    "competitor_domain string, ref_domain string, source_url string, target_url string, anchor string, is_lost boolean, "
    "page_ascore double, is_nofollow boolean, is_sponsored boolean, is_ugc boolean, is_sitewide boolean"
)


def executed(df):
    return df._jdf.queryExecution().executedPlan().toString()


def below(plan, text):
    """The lines under the first line that holds ``text``."""
    lines = plan.splitlines()
    depth = lambda line: len(line) - len(line.lstrip(" :+-*()0123456789"))
    at = next(i for i, line in enumerate(lines) if text in line)
    found = []
    for line in lines[at + 1:]:
        if depth(line) <= depth(lines[at]):
            break
        found.append(line)
    return "\n".join(found)


@pytest.mark.parametrize("bits", [64, 1 << 26])
def test_first_row_wins_however_many_rows_share_a_mark(spark, monkeypatch, bits):
    monkeypatch.setattr(ranking, "MARK_BITS", bits)
    rng = random.Random(3)
    rows = [("hot" if i % 3 == 0 else f"k{rng.randrange(600)}", i, rng.random()) for i in range(900)]
    expected = {}
    for key, order, value in rows:
        expected.setdefault(key, (order, value))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, src_ord int, v double").repartition(7)
    got = ranking.first_wins_apart(df, ["k"]).collect()
    assert len(got) == len(expected) and {r.k: (r.src_ord, r.v) for r in got} == expected


def test_a_derived_key_is_not_stored(spark):
    df = spark.createDataFrame([("A", 2), ("a", 1), ("b", 3), (None, 4), (None, 5)], "k string, src_ord int").repartition(3)
    got = ranking.first_wins_apart(df, ["low"], derived={"low": F.lower("k")})
    assert got.columns == ["k", "src_ord", "low"] and "low" not in executed(got).split("ReadSchema")[1].splitlines()[0]
    assert sorted((r.src_ord, r.k, r.low) for r in got.collect()) == [(1, "a", "a"), (3, "b", "b"), (4, None, None)]


def test_only_repeated_keys_are_set_apart(spark):
    keys = spark.range(1000).select(F.when(F.col("id") < 990, F.col("id")).otherwise(F.lit(5)).alias("k"), "id")
    once, again = ranking.set_apart(session.store(keys.withColumn("d", F.xxhash64("k"))), "d")
    assert again.agg(F.count("*"), F.min("k"), F.max("k")).first()[:] == (11, 5, 5)
    assert once.count() == 989 and once.columns == ["k", "id", "d"]


def test_only_repeated_links_are_exchanged_as_a_whole(spark):
    text = "competitor_domain string, source_url string, target_url string, anchor string, src_ord int, " + ", ".join(
        f"{flag} boolean" for flag in link_facts.FINGERPRINT_FLAGS
    )
    rows = [("c", f"https://d.com/{i // 2 if i < 4 else i}", "t", "x", i, *[False] * 7) for i in range(200)]
    facts = link_facts.vendor_b_facts(spark.createDataFrame(rows, text))
    plan = executed(facts)
    assert "Union" in plan and plan.count("Exchange hashpartitioning") == 1
    assert "Filter" in below(plan, "Exchange hashpartitioning")
    assert sorted(r.src_ord for r in facts.collect()) == [0, 2, *range(4, 200)]


def test_facts_hold_the_columns_that_are_read(spark):
    keyed = spark.createDataFrame([("c", "k", "de", 1, 5.0, "u")], "competitor_domain string, keyword string, country string, src_ord int, cpc double, url string")
    assert link_facts.keyword_facts(keyed, ("url",)).columns == ["competitor_domain", "keyword", "country", "url", "src_ord"]
    assert link_facts.keyword_facts(keyed).columns == keyed.columns


def test_examples_equal_a_plain_fold(spark):
    """Links whose authority differs behind the point have the same example, which counts once."""
    rng = random.Random(4)
    rows = [
        (
            rng.choice(["c", "k", None]), rng.choice(["d.com", " D.com", "e.org"]), f"https://d.com/{rng.randrange(6)}", rng.choice(["t", None]),
            rng.choice(["", "buy", None]), rng.random() < 0.5, rng.choice([5.0, 5.2, 5.3, 6.5, None]), *[rng.random() < 0.3 for _ in range(4)],
        )
        for _ in range(400)
    ]
    links = spark.createDataFrame(rows, EXAMPLE).repartition(5)
    seen = {}
    low = lambda value: (value is not None, value if value is not None else 0)
    for competitor, domain, url, target, anchor, lost, score, nofollow, sponsored, ugc, sitewide in rows:
        marks = [m for m, on in (("Follow", not (nofollow or sponsored or ugc)), ("Nofollow", nofollow), ("Sponsored", sponsored), ("UGC", ugc), ("Sitewide", sitewide)) if on]
        shown = "null" if score is None else str(round(score))
        text = (
            f"[{competitor or 'null'}] [{'LOST' if lost else 'LIVE'}] AS {shown} | {url} --[{anchor or link_intel.rules.NO_ANCHOR}]--> "
            f"{target or 'null'} ({'/'.join(marks) or 'No special attribute'})"
        )
        order = (lost, low(None if score is None else -score), url)
        domain = domain.strip(" ").lower()
        group = seen.setdefault(domain, {})
        group[text] = min(group.get(text, order), order)
    for n in (3, 1000):
        got = {r.domain: r.examples.split("\n") for r in link_intel.domain_examples(links, n).collect()}
        assert got == {d: sorted(group, key=lambda t: (group[t], t))[:n] for d, group in seen.items()}


def test_examples_that_occur_once_are_cut_before_the_shuffle(spark):
    plan = executed(link_intel.example_rows(spark.createDataFrame([("c", "d.com", "u", "t", "a", *[False] * 1, 5.0, *[False] * 4)], EXAMPLE), 3))
    cut = below(plan, "Exchange hashpartitioning(domain")
    assert "WindowGroupLimit" in cut and "Union" in cut


def test_line_items_are_not_exchanged_by_customer(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        plan = executed(views.keywords(spark, "/root/testdata/sf0.001"))
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    moved = below(plan, "Exchange hashpartitioning(o_custkey")
    assert "orders.parquet" in moved and "lineitem.parquet" not in moved


def test_stored_tables_have_files_of_few_rows(spark, monkeypatch):
    monkeypatch.setattr(session, "ROWS_PER_FILE", 10)
    stored = session.store(spark.range(0, 100, 1, 2))
    files = [Path(f.removeprefix("file:")) for f in stored.inputFiles()]
    assert len(files) == 10 and all(".zstd." in f.name for f in files) and stored.count() == 100
