"""Column functions on edge values, expectations worked out by hand."""

import pytest
from pyspark.sql import functions as F

from rankloom.functions import dates, flags, ladders, numbers, scores, text, urls
from rankloom.functions.classify import (
    asset_url,
    domain_type,
    mask_words,
    page_class,
    page_plan,
    pattern_masks,
    text_type,
)
from rankloom.functions import rules

NUMBERS = ["", "1,234", "12.9", "-12.9", "abc", "nan", "inf", "  7 ", None, "1e3", "1d", "0x10", "1_000", "1e400", "9e30"]


def test_lenient_numbers(one):
    assert one(numbers.lenient_int, NUMBERS) == [0, 0, 12, -12, 0, 0, 0, 7, 0, 1000, 0, 0, 1000, 0, 0]
    assert one(lambda c: numbers.lenient_int(c, 999), ["", "5", "x"]) == [999, 5, 999]
    assert one(numbers.lenient_double, ["12.9", "", "nan", ".5", "5."]) == [12.9, 0.0, 0.0, 0.5, 5.0]
    assert one(numbers.grouped_int, NUMBERS[:5]) == [0, 1234, 12, -12, 0]
    assert one(numbers.metric_double, ["", "1,234", "45%", "n/a", "0"]) == [None, 1234.0, 45.0, None, 0.0]


def test_rounding_and_guards(one):
    assert one(lambda c: numbers.half_up(c, 1), [0.25, 0.35, 2.0, -0.25], "double") == [0.3, 0.4, 2.0, -0.3]
    assert one(numbers.whole_even, [0.5, 1.5, 2.5, 20.4], "double") == ["0", "2", "2", "20"]
    assert one(lambda c: numbers.ratio(c, F.lit(0)), [3], "int") == [0.0]
    assert one(numbers.clamp, [-1.0, 50.0, 101.0], "double") == [0.0, 50.0, 100.0]


def test_flags(one):
    words = ["TRUE", "true", "1", "yes", "", None, "no", " Y "]
    assert one(flags.strict_true, words) == [True, True, False, False, False, False, False, False]
    assert one(flags.loose_true, words) == [True, True, True, True, False, False, False, True]
    assert one(flags.dofollow, ["TRUE", "false", None]) == [False, True, True]
    assert one(flags.lost, ["", "  ", None, "2024-01-01"]) == [False, False, False, True]


def test_dates(one):
    written = ["2024-03-05", "2024/3/5", "2024-13-40", "05/03/2024", "12/31/2023", "05.03.2024", "Mar 5, 2024", "5 mar 2024", "", "junk", "2024-03-05T10:00", "31/02/2024", " 2024-3-5 "]
    assert one(dates.normalise_date, written) == [
        "2024-03-05", "2024-03-05", "2024-13-40", "2024-03-05", "2023-12-31", "2024-03-05", "2024-03-05",
        "2024-03-05", "", "junk", "2024-03-05", "31/02/2024", "2024-03-05",
    ]
    assert one(dates.year_of, ["2024-01-01", "abcd", "", "199"]) == ["2024", None, None, None]


def test_hosts(one):
    addresses = ["https://www.A.com/x", "http://u:p@b.com:80/y", "c.com/z", "", "https://www.www.d.com"]
    assert one(urls.site_host, addresses) == ["A.com", "u:p@b.com:80", "", "", "www.d.com"]
    assert one(urls.hostname, addresses) == ["a.com", "b.com", "c.com", "", "www.d.com"]


def test_canonical_url(one):
    assert one(
        urls.canonical_url,
        ["HTTP://www.A.com/Path/?q=1#f", "https://a.com", "a.com/b/", "https://a.com:8080/", "https://a.com:bad/X", "https://a.com/p;v=1", "", "https://me@a.com:0/x y"],
    ) == [
        "http://a.com/Path?q=1", "https://a.com/", "https://a.com/b", "https://a.com:8080/", "https://a.com:bad/x",
        "https://a.com/p", "", "https://a.com/x y",
    ]


def test_canonical_key(one):
    assert one(
        urls.canonical_key,
        ["https://www.A.com/B/?x=1", "https://a.com/", "https://a.com", "https://a.com/a%20b+c", "https://a.com/100%/%zz", "", None],
    ) == ["a.com/b", "a.com/", "a.com", "a.com/a b+c", "a.com/100%/%zz", "", ""]


def test_page_and_sitemap_urls(one):
    assert one(urls.page_url, ["https://a.com//x///y/?q#f", "https://a.com", "https://a.com/", "/x//y/"]) == [
        "https://a.com/x/y", "https://a.com/", "https://a.com/", "/x/y",
    ]
    assert one(urls.sitemap_url, [" a.com ", "https://a.com/x", "a.com/map.xml", "http://b.com/s.xml"]) == [
        "https://a.com/sitemap.xml", "https://a.com/sitemap.xml", "https://a.com/map.xml", "http://b.com/s.xml",
    ]
    assert one(urls.first_directory, ["https://a.com/", "https://a.com/blog/x", "https://a.com"]) == ["Home", "blog", "Home"]


def test_slug_phrase(one):
    assert one(
        urls.slug_phrase,
        ["https://a.com/x/Blue-Shoes_now.HTML", "https://a.com/", "https://a.com/123456", "https://a.com/abc", "https://a.com/a/big--sale/", "https://a.com/.php"],
    ) == ["blue shoes now", None, None, None, "big sale", None]


def test_text_forms(one):
    assert one(text.slug, ["  Best 2-in-1 Tools! ", "ÄB c"]) == ["best-2in1-tools", "b-c"]
    assert one(text.title_case, ["o'neil dropshipping-supplier 3d"]) == ["O'Neil Dropshipping-Supplier 3D"]
    assert one(text.company_name, ["uscreen.tv", "www.BIG.com", None]) == ["Uscreen", "Big", "Partner"]
    assert one(text.breadcrumb_leaf, ["a > b > c ", "x"]) == ["c", "x"]
    assert one(text.breadcrumb_root, ["a > b > c ", "x"]) == ["a", "x"]
    rows = ['{"Link anchor": "", "Anchor": "hi"}', "{}", "oops"]
    assert one(lambda c: text.anchor_text(c, rules.ANCHOR_KEYS_QUEUE, "none", "bad"), rows) == ["hi", "none", "bad"]


def test_bands(one):
    assert one(ladders.rating_band, [0, 20, 21, 80, 81], "int") == ["0-20", "0-20", "20-40", "60-80", "80-100"]
    assert one(ladders.authority_band, [20.0, 20.5, 21.0, 100.0, 101.0], "double") == ["0-20", "0-20", "21-40", "81-100", "81-100"]
    assert one(ladders.rank_band, [3, 4, 10, 20, 21], "int") == ["1-3", "4-10", "4-10", "11-20", "21+"]
    assert one(ladders.heat, [0.0, 0.5, 10.0, 999.9, 1000.0], "double") == ["", "⭐", "🌟", "🔥", "🔥🔥🔥"]
    assert one(lambda c: ladders.level(c, rules.LOSS_LEVELS), [0.09, 0.1, 0.25, 0.4], "double") == ["较低", "正常", "偏高", "很高"]


@pytest.mark.parametrize(
    "alpha, rating, traffic, dofollow, spam, v1, v2",
    [
        (7, 80, 100000, True, False, 100.0, 100.0),
        (1, 0, 0, False, False, 14.3, 10.3),
        (2, 40, 50, True, False, 53.3, 79.3),
        (7, 90, 5, True, True, -100.0, -100.0),
    ],
)
def test_link_scores(spark, alpha, rating, traffic, dofollow, spam, v1, v2):
    row = spark.createDataFrame([(alpha, rating, traffic, dofollow, spam)], "a int, d int, t int, f boolean, s boolean")
    columns = [F.col(c) for c in ("a", "d", "t", "f", "s")]
    assert row.select(scores.link_score_v1(*columns), scores.link_score_v2(*columns)).first() == (v1, v2)


@pytest.mark.parametrize(
    "volume, kd, cpc, buying, expected",
    [(29, 1, 5.0, True, 0), (30, 41, 0.0, False, 15), (30, 26, 0.5, True, 60), (300, 16, 0.0, False, 70), (1000, 5, 1.0, False, 100), (30, 4, 0.0, False, 95)],
)
def test_new_site_score(spark, volume, kd, cpc, buying, expected):
    row = spark.createDataFrame([(volume, kd, cpc, buying)], "v int, k int, c double, b boolean")
    assert row.select(scores.new_site_keyword_score(F.col("v"), F.col("k"), F.col("c"), F.col("b"))).first()[0] == expected


def test_keyword_score(spark):
    row = spark.createDataFrame([(5, 10, 10000, 2.0), (1, 71, 5, 0.0), (2, 35, 500, 0.5)], "a int, k int, v int, c double")
    got = [r[0] for r in row.select(scores.keyword_score(F.col("a"), F.col("k"), F.col("v"), F.col("c"))).collect()]
    assert got == [100.0, 7.5, 62.0]


def test_unknown_is_not_zero(one):
    assert one(scores.organic_points, [None, 0.0, 49.0, 50.0, 50000.0], "double") == [None, 0, 55, 70, 100]
    assert one(lambda c: F.round(scores.visits_points(c), 3), [None, 0.0, 99.0, 1e9], "double") == [None, 0.0, 60.0, 100.0]


def test_blends(spark):
    row = spark.createDataFrame([(80.0, None), (80.0, 50.0)], "m double, x double")
    m, x = F.col("m"), F.col("x")
    got = row.select(scores.blend_two(m, x), scores.blend_three(m, x, x), scores.blend_or_machine(m, x)).collect()
    assert [tuple(r) for r in got] == [(68.0, 64.0, 80.0), (75.5, 74.0, 77.0)]


def test_domain_types(one):
    hosts = ["apps.shopify.com", "shop.x.com", "wix.com", "mycoupons.net", "mit.edu", "plain.org", "myshopify.com"]
    assert one(lambda c: domain_type(c, rules.LINK_TYPES_V1), hosts) == [
        "App Market (应用市场/生态插件)", "Social / Video (视频社媒)", None, "Coupon Deal Site (优惠券)",
        "Education Resource (教育资源)", None, None,
    ]
    assert one(lambda c: text_type(c, rules.URL_TYPES_V1), ["https://a.com/Write-For-Us", "https://a.com/best-x", "https://a.com/p"]) == [
        "Guest Post", "Listicle (合集列表)", None,
    ]


def test_page_classes(one):
    assert one(page_class, ["https://a.com", "https://a.com/Blog/x", "https://a.com/vs/", "https://a.com/zed/1"]) == [
        "Homepage", "Blog & Content", "Comparison Pages", "Other (/zed/)",
    ]


def test_page_plans(spark):
    rows = spark.createDataFrame(
        [("crm login", False, False, False), ("chairs", True, False, False), ("tax calculator", False, False, False), ("why", False, False, False), ("x", False, False, True)],
        "k string, c boolean, t boolean, n boolean",
    )
    got = [r[0] for r in rows.select(page_plan(F.col("k"), F.col("c"), F.col("t"), F.col("n"))).collect()]
    assert got == ["integration", "hub", "tool", "blog", "integration"]


def test_masks(one):
    words = rules.OFFICIAL_ENTRY
    assert one(lambda c: mask_words(pattern_masks(c, words), words, 8), ["/contact-us", "", "suggest-a-tool"]) == [
        "contact, contact-us", "", "suggest-a-tool",
    ]
    assert one(lambda c: mask_words(pattern_masks(c, words), words, 2), ["contactus partners apply"]) == ["contact, contactus"]


def test_assets(one):
    assert one(asset_url, ["https://a.com/x.PNG?v=1", "https://a.com/.png", "https://a.com/a.b/c", "https://a.com/a.tar.zip"]) == [
        True, False, False, True,
    ]


def test_masks_of_a_list_of_any_length(one):
    words = [f"w{i:03d}" for i in range(200)]
    found = one(lambda c: mask_words(pattern_masks(c, words), words, 5), ["w199 w000 w062w063w064", "w125 w126 w188 w189", "none"])
    assert found == ["w000, w062, w063, w064, w199", "w125, w126, w188, w189", ""]


def test_registered_rules_fit_masks():
    for words in (rules.SELF_SERVE, rules.DIRECTORY_PATHS, rules.OFFICIAL_ENTRY, rules.STRATEGIC, rules.EDITORIAL):
        assert len(words) <= 63 and all(w == w.lower() for w in words)


def test_one_damaged_value_does_not_end_a_sum(spark):
    rows = spark.createDataFrame([(1.25,), (1e19,), (1e300,), (-1e300,)], "x double")
    total = rows.agg(numbers.exact_sum(F.col("x")).alias("t"), F.max(numbers.half_up(F.col("x"), 2)).alias("m")).first()
    assert float(total.t) == 1e19 + 1.25 and total.m == 1e300


def test_values_that_no_sum_holds_are_left_out_and_counted(spark):
    rows = spark.createDataFrame([(3e25,), (1.0,), (None,), (-9e23,), (float("nan"),)], "x double")
    total = rows.agg(numbers.exact_sum(F.col("x")).alias("t"), numbers.unsummed(F.col("x")).alias("n")).first()
    assert total.t == 1 - 9 * 10**23 and total.n == 2


def test_word_tables_of_any_length(spark):
    words = [f"w{i:03d}x" for i in range(100)]
    rows = spark.createDataFrame([("a W099x b",), ("none",)], "t string")
    assert [r.k for r in rows.select(text_type(F.col("t"), {"hit": words}).alias("k")).collect()] == ["hit", None]
