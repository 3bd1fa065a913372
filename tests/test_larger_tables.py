"""What must not be repeated per row on larger tables, read from the optimised plans."""

import pytest
from pyspark.sql import functions as F

from rankloom.functions import urls
from rankloom.operators import action_queue, imports, link_facts, link_intel, snapshots
from rankloom.plans import views


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def filters(df):
    return [line for line in plan(df).splitlines() if "Filter" in line]


@pytest.fixture
def link_rows(spark):
    text = "competitor_domain ref_domain source_url target_url source_title anchor first_seen last_seen".split()
    flags = "is_lost is_nofollow is_sponsored is_ugc is_sitewide is_image is_form is_frame is_text".split()
    row = ["c", "d.com", "https://d.com/blog/x.png", "https://t.com/", "Title", "buy", "2024-01-01", "2024-02-01"]
    rows = [(*row, *[False] * len(flags), 5.0, 1), (*row, True, *[False] * (len(flags) - 1), 7.0, 1)]
    schema = ", ".join([*(f"{c} string" for c in text), *(f"{c} boolean" for c in flags), "page_ascore double", "external_links bigint"])
    # Not folded by the optimiser as a local relation would be.
    return spark.createDataFrame(rows, schema).repartition(1)


def test_slug_phrase_is_not_evaluated_again_by_its_filter(spark):
    pages = spark.createDataFrame([(1, "https://s.example/shop/red-box_large.HTML/"), (1, "https://s.example/12")], "site_id int, page_url string")
    sites = spark.createDataFrame([(1, "https://www.s.example/sitemap.xml")], "site_id int, url string")
    found = snapshots.slug_keywords(pages.repartition(1), sites)
    assert not any("regexp" in f.lower() or "rlike" in f.lower() for f in filters(found))
    assert [tuple(r) for r in found.collect()] == [("red box large", "s.example", "https://s.example/shop/red-box_large.HTML/")]


def test_judgement_is_not_evaluated_again_by_its_filter(spark):
    rows = spark.createDataFrame([("",), ("https:///lost/",), ("https://a.com/",)], "url string").repartition(1)
    judged = imports.judged(rows, F.col("url"))
    assert not any("regexp" in f.lower() for f in filters(judged.filter("rejected")))
    assert sorted((r.url, r.reject_reason) for r in judged.collect()) == [
        ("", "no source URL"), ("https:///lost/", "no host in the source URL"), ("https://a.com/", None),
    ]


def test_patterns_are_sought_in_folded_texts(link_rows):
    assert "Contains(" not in plan(link_intel.domain_measures(link_rows))
    evidence = plan(link_intel.domain_evidence(link_rows))
    assert evidence.index("Contains(") < evidence.index("count(1) AS n")
    row = action_queue.drop_detection(link_rows).first()
    assert (row.backlinks, row.assets, row.technicals, row.is_drop) == (2, 2, 0, True)


@pytest.mark.parametrize(
    "text", ["/a/", "/a/\n", "/a/\r\n", "/a\n/", "/", "", "x", "/a;p", "/a;p/b", "/é/", None]
)
def test_guarded_patterns_equal_the_bare_ones(one, text):
    guarded = one(lambda c: F.struct(urls.path(c).alias("p"), urls._without_last_slash(c).alias("s")), [text])
    bare = one(
        lambda c: F.struct(
            F.regexp_replace(F.regexp_extract(c, urls.PATH, 1), r";[^/]*$", "").alias("p"),
            F.regexp_replace(c, "(.)/$", "$1").alias("s"),
        ),
        [text],
    )
    assert guarded == bare


def test_fingerprint_is_exchanged_as_bytes(spark, links_b_rows):
    facts = link_facts.vendor_b_facts(links_b_rows)
    window = next(line for line in plan(facts).splitlines() if "Window" in line)
    assert "unhex" in plan(facts).lower() and "sha1" not in window
    expected = links_b_rows.select(link_facts.fingerprint().alias("f")).distinct().collect()
    assert sorted(r.link_fingerprint for r in facts.collect()) == sorted(r.f for r in expected)
    assert all(len(r.f) == 40 for r in expected) and facts.schema["link_fingerprint"].dataType.simpleString() == "string"


@pytest.fixture
def links_b_rows(link_rows):
    return link_rows.withColumn("src_ord", F.monotonically_increasing_id()).unionByName(
        link_rows.withColumn("anchor", F.lit("other")).withColumn("src_ord", F.lit(9).cast("bigint"))
    )


def test_line_items_are_dealt_by_their_number_for_the_join(spark, monkeypatch):
    monkeypatch.setattr(views, "ROWS_PER_TASK", 100)
    rows = spark.range(5000).withColumnRenamed("id", "k")
    dealt = views.dealt_by(rows, "k")
    assert dealt.rdd.getNumPartitions() == 50
    keys = spark.range(5000).withColumnRenamed("id", "k").hint("merge")
    joined = dealt.join(keys, "k")
    exchanges = joined._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
    assert joined.count() == 5000 and exchanges == 2
