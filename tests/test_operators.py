"""Operators on small fixtures and against brute force in plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from rankloom.functions import rules
from rankloom.operators import (
    action_queue,
    hierarchy,
    imports,
    keywords,
    link_facts,
    link_intel,
    link_matrix,
    link_queue,
    mailing,
    pages,
    ranking,
    snapshots,
)

A_SCHEMA = (
    "competitor_domain string, ref_domain string, ref_url string, target_url string, domain_rating bigint, "
    "page_traffic bigint, page_type string, page_category string, is_dofollow boolean, is_spam boolean, "
    "links_in_group bigint, is_lost boolean, first_seen string, raw_json string, src_ord bigint"
)


def a_link(ord_, comp="c1", domain="d.com", url=None, dr=50, traffic=10, dofollow=True, spam=False, links=1, lost=False, seen="2020-01-01", raw="{}", kind="Unknown", category="Unknown"):
    return (comp, domain, url or f"https://{domain}/p", "https://t.com", dr, traffic, kind, category, dofollow, spam, links, lost, seen, raw, ord_)


def b_link(ord_, comp="c1", domain="d.com", url=None, title="", anchor="", target="https://t.com/", score=10.0, lost=False, seen="2020-01-01", **flags):
    names = ("nofollow", "sponsored", "ugc", "text", "frame", "form", "image", "sitewide", "new")
    return (comp, domain, title, url or f"https://{domain}/p", target, anchor, score, 1, *[bool(flags.get(n)) for n in names], lost, seen, seen, ord_)


B_SCHEMA = (
    "competitor_domain string, ref_domain string, source_title string, source_url string, target_url string, anchor string, "
    "page_ascore double, external_links bigint, is_nofollow boolean, is_sponsored boolean, is_ugc boolean, is_text boolean, "
    "is_frame boolean, is_form boolean, is_image boolean, is_sitewide boolean, is_new boolean, is_lost boolean, "
    "first_seen string, last_seen string, src_ord bigint"
)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def by_key(df, key):
    return {r[key]: r for r in df.collect()}


@pytest.fixture
def links_a(spark):
    return lambda *rows: spark.createDataFrame(list(rows), A_SCHEMA)


@pytest.fixture
def links_b(spark):
    return lambda *rows: spark.createDataFrame(list(rows), B_SCHEMA)


def test_first_row_wins_whatever_the_partitioning(spark):
    rng = random.Random(1)
    # one key holds a third of the rows
    rows = [("hot" if i % 3 == 0 else f"k{rng.randrange(40)}", i, rng.random()) for i in range(900)]
    expected = {}
    for key, order, value in rows:
        expected.setdefault(key, (order, value))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, src_ord int, v double").repartition(7)
    got = {r.k: (r.src_ord, r.v) for r in ranking.first_wins(df, ["k"]).collect()}
    assert got == expected


def test_numbering_matches_a_full_sort(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(5), i) for i in range(500)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "a int, b int").repartition(9)
    got = {(r.a, r.b): r.n for r in ranking.number_rows(df, [F.desc("a"), "b"], "n").collect()}
    ordered = sorted(rows, key=lambda r: (-r[0], r[1]))
    assert got == {row: i for i, row in enumerate(ordered, 1)}
    batches = ranking.with_batches(df, [F.desc("a"), "b"], 200).groupBy("batch_no").count().collect()
    assert sorted((r.batch_no, r["count"]) for r in batches) == [(1, 200), (2, 200), (3, 100)]


def test_group_totals_are_a_join_not_a_window(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 5)], "k string, v int")
    result = ranking.with_group_total(df, ["k"], "v", "t")
    assert rows_of(result) == [("a", 1, 3), ("a", 2, 3), ("b", 5, 5)]
    assert "Window" not in result._jdf.queryExecution().optimizedPlan().toString()


def test_profile_and_shares(links_a):
    links = links_a(
        a_link(1, domain="a.com", dr=20, links=3),
        a_link(2, domain="b.com", dr=41, dofollow=False, lost=True),
        a_link(3, domain="c.com", dr=81, spam=True, links=2),
        a_link(4, comp="c2", domain="a.com", lost=True),
    )
    profile = link_matrix.competitor_profile(links)
    row = by_key(profile, "competitor_domain")["c1"]
    assert (row.domains, row.links, row.dofollow, row.spam, row.dr_0_20, row.dr_40_60, row.dr_80_100) == (3, 6, 2, 1, 1, 1, 1)
    assert (row.live_domains, row.live_links, row.live_spam, row.live_dr_40_60) == (2, 5, 1, 0)
    shares = by_key(link_matrix.competitor_shares(profile), "competitor_domain")
    assert shares["c1"].lost_rate == 0.333333 and shares["c1"].high_rating_share == 0.666667
    assert shares["c2"].live_links_per_domain == 0.0


def test_years_are_filled_and_summed(links_a):
    links = links_a(a_link(1, domain="a.com", seen="2019-05-05"), a_link(2, domain="b.com", seen="2021-01-01", lost=True), a_link(3, comp="c2", domain="a.com", seen="2020"), a_link(4, comp="c2", domain="b.com", seen="n/a"))
    got = rows_of(link_matrix.cumulative_by_year(links))
    assert got == [
        ("c1", "2019", 1, 1, 1, 1), ("c1", "2020", 0, 0, 1, 1), ("c1", "2021", 1, 0, 2, 1),
        ("c2", "2019", 0, 0, 0, 0), ("c2", "2020", 1, 1, 1, 1), ("c2", "2021", 0, 0, 1, 1),
    ]


def test_matrix_labels_and_spam(links_a):
    links = links_a(
        a_link(1, kind="Web > Blog", category="Home > Sofas", raw='{"Anchor": "hi"}', spam=True),
        a_link(2, comp="c2", dr=70, kind="Web > Article", dofollow=False),
        a_link(3, domain="spam.com", spam=True),
    )
    matrix = link_matrix.overlap_matrix(links).collect()
    assert [r.ref_domain for r in matrix] == ["d.com", "spam.com"]
    first = matrix[0]
    assert (first.alpha, first.max_dr, first.industry, first.content_format, first.shared_by, first.is_spam) == (2, 70, "Home", "Article", "c1, c2", False)
    assert first.link_refs == "[c1] https://d.com/p  --[hi]-->  https://t.com\n[c2] https://d.com/p  --[无锚文本]-->  https://t.com"
    brief = link_matrix.content_briefs(link_matrix.overlap_matrix(links), "chairs").collect()[0]
    assert "DR 为 70" in brief.agent_prompt and "【chairs】" in brief.agent_prompt
    assert {r.alpha for r in link_matrix.overlap_details(links).filter("ref_domain = 'd.com'").collect()} == {2}


def test_queue_one(links_a):
    links = links_a(
        a_link(2, domain="plain.com", url="https://plain.com/best-x", raw='{"Link anchor": "buy"}'),
        a_link(1, comp="c2", domain="plain.com", url="https://plain.com/forum/1", raw="broken"),
        a_link(3, domain="g2.com", spam=True),
    )
    queue = by_key(link_queue.queue_v1(links, "Acme"), "ref_domain")
    plain = queue["plain.com"]
    assert plain.link_type == "Forum Thread"  # the first URL in order of arrival decides
    assert plain.auto_score == 0.35 * 35 + 0.3 * 60 + 0.15 * 20 + 20 + 0.05  # 53.25 rounds half up to 53.3
    assert plain.priority == "P2 (日常铺垫)" and plain.links_text == "总计:2 (c1:1, c2:1)"
    assert "(锚文本: 未知)" in plain.example_links and plain.status == rules.NOT_STARTED
    assert queue["g2.com"].auto_score == -100.0 and queue["g2.com"].priority == rules.PRIORITY_SPAM_V1


def test_queue_two_tiers(links_a):
    links = links_a(
        a_link(1, domain="zapier.com", dr=90),
        a_link(2, domain="techcrunch.com", dr=90),
        a_link(3, domain="blog.org", dr=30),
        a_link(4, domain="forum.org", dr=60, url="https://forum.org/thread/1"),
        a_link(5, domain="dead.org", dr=9, traffic=0),
        a_link(6, domain="good.org", dr=60),
        a_link(7, domain="mydeals.org", dr=60),
    )
    queue = by_key(link_queue.queue_v2(links), "ref_domain")
    label = {d: (r.tier_rank, r.type_label) for d, r in queue.items()}
    assert label["techcrunch.com"] == (1, "Media (100%)")
    assert label["zapier.com"] == (2, "General Blog (50%)")  # a pattern with a path never equals a domain
    assert label["blog.org"] == (3, "General Blog (低权重降级) (50%)")
    assert label["forum.org"] == (3, "Forum Thread (80%)")
    assert label["dead.org"][0] == 4 and label["good.org"][0] == 2
    assert label["mydeals.org"] == (3, "Coupon Deal (90%)")


K_SCHEMA = (
    "competitor_domain string, keyword string, country string, is_branded boolean, is_navigational boolean, "
    "is_informational boolean, is_commercial boolean, is_transactional boolean, volume bigint, kd bigint, cpc double, "
    "current_traffic double, current_position bigint, url string, src_ord bigint"
)


def kw(ord_, comp="kim", word="oak chair", country="us", branded=False, nav=False, info=False, com=False, tra=False, vol=1000, kd=10, cpc=1.0, traffic=10.0, pos=1, url="https://k.com/a"):
    return (comp, word, country, branded, nav, info, com, tra, vol, kd, cpc, traffic, pos, url, ord_)


def test_keyword_profile(spark):
    facts = spark.createDataFrame(
        [kw(1, info=True, com=True, traffic=9.0), kw(2, word="b", branded=True, pos=15, kd=50, traffic=3.0), kw(3, word="", traffic=0.0), kw(4, comp="zed", traffic=0.0)],
        K_SCHEMA,
    )
    profile = keywords.keyword_profile(facts)
    row = by_key(profile, "competitor_domain")["kim"]
    assert (row.n_keywords, row.traffic, row.traffic_value, row.branded_traffic) == (2, 12.0, 12.0, 3.0)
    assert (row.intent_informational, row.intent_commercial, row.pos_1_3, row.pos_11_20, row.kd_41_plus) == (4.5, 4.5, 9.0, 3.0, 3.0)
    shares = by_key(keywords.keyword_shares(profile), "competitor_domain")
    assert shares["kim"].buying_share == 0.375 and shares["zed"].branded_share == 0.0


def test_keyword_overlap_takes_the_first_row(spark):
    facts = spark.createDataFrame([kw(2, vol=50), kw(1, comp="ann", vol=70, kd=3), kw(3, comp="bob", traffic=0.0), kw(4, branded=True)], K_SCHEMA)
    row = keywords.keyword_overlap(facts).collect()[0]
    assert (row.alpha, row.volume, row.kd, row.traffic, row.shared_by) == (2, 70, 3, 20.0, "ann, kim")


def test_keyword_view_takes_the_largest_market(spark):
    facts = spark.createDataFrame([kw(1, vol=50, kd=1), kw(3, country="de", vol=900, kd=7, cpc=2.0), kw(2, country="fr", vol=900, kd=8)], K_SCHEMA)
    row = keywords.keyword_view(facts).collect()[0]
    assert (row.volume, row.kd, row.traffic, row.competitors, row.first_ord) == (900, 8, 30.0, "Kim", 1)


def test_keyword_tasks(spark):
    facts = spark.createDataFrame(
        [kw(5, word="tax calculator", com=False, traffic=1.0), kw(1, word="oak chairs", com=True), kw(2, word="hard word", kd=60), kw(3, word="why oak?", cpc=0.0)],
        K_SCHEMA,
    )
    tasks = by_key(keywords.keyword_tasks(facts, "Acme", "2024-01-01"), "keyword")
    assert set(tasks) == {"oak chairs", "tax calculator", "why oak?"}
    assert tasks["oak chairs"].task_id == "SEO-PAGE-0001" and tasks["tax calculator"].task_id == "SEO-PAGE-0003"
    assert tasks["oak chairs"].target_url == "/category/oak-chairs" and tasks["tax calculator"].target_url == "/tools/tax-calculator"
    assert tasks["why oak?"].title == "Why Oak? (2026 Guide & Top Suppliers) | Acme"
    assert tasks["oak chairs"].score == 100 and "Acme" in tasks["oak chairs"].instruction


def test_benchmarks_sum_over_countries(spark):
    facts = spark.createDataFrame([kw(1, traffic=1.25), kw(2, country="de", traffic=1.0), kw(3, comp="ann", traffic=5.0, url="https://x.com")], K_SCHEMA)
    got = keywords.ranked_benchmarks(keywords.keyword_benchmarks(facts)).collect()
    assert [r.benchmark for r in got] == ["[Ann] https://x.com (Traffic: 5.0)", "[Kim] https://k.com/a (Traffic: 2.3)"]


def test_brand_free(spark):
    facts = spark.createDataFrame([kw(1, comp="oakhouse", word="oak house sale"), kw(2, comp="oakhouse", word="oak sale")], K_SCHEMA)
    assert [r.keyword for r in keywords.brand_free(facts).collect()] == ["oak sale"]


def test_top_pages_sample_keywords(spark):
    facts = spark.createDataFrame([kw(i, word=f"w{i}", url=f"https://k.com/{i % 3}", traffic=float(i)) for i in range(1, 31)], K_SCHEMA)
    got = keywords.top_landing_pages(facts, 2, 3).orderBy(F.desc("traffic")).collect()
    assert [(r.url, r.traffic, r.n_keywords) for r in got] == [("https://k.com/0", 165.0, 10), ("https://k.com/2", 155.0, 10)]
    assert got[0].keyword_sample == "w12, w15, w18" and got[0].traffic_share == 0.354839


def merged(spark, *rows):
    return spark.createDataFrame(list(rows), "final_url string, traffic double, keywords double, top_keyword string, in_sitemap boolean")


def brute_tree(rows):
    """Subtree sums and best keywords straight from the definition."""
    nodes = {}
    for url, traffic, kws, top, _ in rows:
        parts = url.split("://")[1].split("/")
        for depth in range(1, len(parts) + 1):
            node = nodes.setdefault("/".join(parts[:depth]), [0.0, 0, 0.0, []])
            node[0] += traffic
            node[1] += 1
            node[2] += kws
            if top:
                node[3].append((-traffic, len(parts), "/".join(parts), top))
    return {k: (v[0], v[1], v[2], min(v[3])[3] if v[3] else "") for k, v in nodes.items()}


def test_tree_equals_brute_force(spark):
    rng = random.Random(3)
    seen, rows = set(), []
    for _ in range(300):
        url = "https://h.com/" + "/".join(rng.choice("abc") for _ in range(rng.randrange(1, 5)))
        if url not in seen:
            seen.add(url)
            rows.append((url, float(rng.choice([0, 0, 1, 5, 20])), 1.0, rng.choice(["", "", f"kw{len(rows)}"]), True))
    tree = hierarchy.url_tree(merged(spark, *rows).repartition(5))
    got = {r.node_id: (r.traffic, r.n_pages, r.keywords, r.best_keyword) for r in tree.collect()}
    assert got == brute_tree(rows)
    root = got["h.com"]
    assert root[0] == sum(r[1] for r in rows) and root[1] == len(rows)


def test_folded_tree_equals_brute_force(spark):
    rng = random.Random(4)
    rows = {}
    for _ in range(400):
        url = "https://h.com/" + "/".join(f"{rng.randrange(12):02d}" for _ in range(rng.randrange(1, 4)))
        rows[url] = (url, float(rng.random() < 0.05), 1.0, "", True)
    tree = hierarchy.url_tree(merged(spark, *rows.values()))
    nodes = {r.node_id: (r.parent_id, r.traffic) for r in tree.collect()}
    children = {}
    for node, (parent, _) in nodes.items():
        children.setdefault(parent, []).append(node)

    def walk(node):
        yield node
        below = sorted(children.get(node, []))
        for child in [c for c in below if nodes[c][1] > 0] + [c for c in below if nodes[c][1] == 0][:5]:
            yield from walk(child)

    assert {r.node_id for r in hierarchy.shown_nodes(tree, 5).collect()} == set(walk("h.com"))
    hidden = {r.parent_id: r.hidden_children for r in hierarchy.hidden_counts(tree, 5).collect()}
    idle = {p: sum(nodes[c][1] == 0 for c in cs) for p, cs in children.items() if p}
    assert hidden == {p: n - 5 for p, n in idle.items() if n > 5}


def test_page_that_is_also_a_directory(spark):
    tree = by_key(hierarchy.url_tree(merged(spark, ("https://www.h.com/a/", 3.0, 1.0, "x", True), ("https://h.com/a/b%20c", 9.0, 2.0, "y", False), ("https://h.com/z", 0.0, 0.0, None, False))), "node_id")
    assert (tree["h.com/a"].traffic, tree["h.com/a"].n_pages, tree["h.com/a"].best_keyword) == (12.0, 2, "y")
    assert tree["h.com/a"].page_url == "https://www.h.com/a/" and tree["h.com/a/b c"].parent_id == "h.com/a"
    assert tree["h.com/z"].is_orphan and not tree["h.com/a"].is_orphan


def test_reconcile(spark):
    sitemap = spark.createDataFrame([("h", "https://www.h.com/a/"), ("h", "https://h.com/a"), ("h", "https://h.com/b")], "domain string, sitemap_url string")
    metrics = spark.createDataFrame([("h", "https://h.com/A?x", 1.0, 1.0, "k"), ("h", "https://h.com/a", 5.0, 2.0, "m"), ("h", "https://h.com/c", 0.0, 0.0, None)], "domain string, metrics_url string, traffic double, keywords double, top_keyword string")
    both = pages.reconcile(sitemap, metrics)
    got = {r.canonical_key: (r.final_url, r.traffic, r.in_sitemap) for r in both.collect()}
    assert got == {"h.com/a": ("https://h.com/a", 5.0, True), "h.com/b": ("https://h.com/b", 0.0, True), "h.com/c": ("https://h.com/c", 0.0, False)}
    health = by_key(pages.page_health(both), "canonical_key")
    assert health["h.com/c"].is_orphan and health["h.com/b"].is_zombie
    assert rows_of(pages.directory_rollup(both)) == [("h", "a", 1, 5.0), ("h", "b", 1, 0.0), ("h", "c", 1, 0.0)]


def test_snapshots(spark):
    schema = "site_id int, page_url string, first_seen string, last_seen string"
    history = spark.createDataFrame([(1, "a", "d1", "d1"), (1, "b", "d1", "d1")], schema)
    current = spark.createDataFrame([(1, "b"), (1, "c"), (2, "b")], "site_id int, page_url string")
    assert rows_of(snapshots.added(current, history)) == [(1, "c"), (2, "b")]
    assert rows_of(snapshots.removed(current, history)) == [(1, "a")]
    assert rows_of(snapshots.changes(current, history)) == [(1, "a", "removed"), (1, "c", "added"), (2, "b", "added")]
    assert rows_of(snapshots.applied(current, history, F.lit("d2"))) == [(1, "b", "d1", "d1"), (1, "c", "d2", "d2"), (2, "b", "d2", "d2")]


def test_slug_overlap(spark):
    found = spark.createDataFrame([(1, "https://a/oak-chair"), (1, "https://a/x/oak_chair.html"), (1, "https://a/y/oak-chair"), (2, "https://b/oak-chair"), (2, "https://b/pine-desk"), (9, "https://z/pine-desk")], "site_id int, page_url string")
    sites = spark.createDataFrame([(1, "https://www.a.com/s.xml"), (2, "https://b.com/s.xml")], "site_id int, url string")
    got = [tuple(r) for r in snapshots.slug_overlap(found, sites).collect()]
    assert got[0] == ("oak chair", 2, "a.com, b.com", "[a.com] https://a/oak-chair\n[a.com] https://a/x/oak_chair.html\n[b.com] https://b/oak-chair")
    assert got[1][:3] == ("pine desk", 2, "Unknown, b.com")
    single = snapshots.slug_overlap(found.filter("site_id = 2"), sites.filter("site_id = 2"))
    assert single.count() == 2
    summary = snapshots.run_summary(found, sites, F.lit("now")).first()
    assert (summary.sites_analyzed, summary.total_keywords_extracted) == (2, 2)


def test_fingerprint_ignores_case_and_dates(links_b):
    links = links_b(b_link(2, anchor="Hi", seen="2021-01-01"), b_link(1, anchor="hi", seen="2020-01-01"), b_link(3, anchor="hi", nofollow=True))
    kept = link_facts.vendor_b_facts(links).collect()
    assert sorted(r.src_ord for r in kept) == [1, 3]


def test_registrable_domain(spark):
    hosts = spark.createDataFrame([("a.b.co.uk",), ("co.uk",), ("x.com",), ("y.x.com",), ("local",)], "host string")
    suffixes = spark.createDataFrame([("uk",), ("co.uk",), ("com",)], "suffix string")
    got = {r.host: r.registrable_domain for r in link_facts.registrable_domains(hosts, "host", suffixes).collect()}
    assert got == {"a.b.co.uk": "b.co.uk", "co.uk": "co.uk", "x.com": "x.com", "y.x.com": "x.com", "local": "local"}


def test_vendor_b_profile(links_b):
    links = links_b(
        b_link(1, domain="a.com", score=40.0, new=True), b_link(2, domain="a.com", url="https://a.com/2", lost=True, score=90.0),
        b_link(3, domain="b.com", lost=True), b_link(4, domain="c.com", nofollow=True, sitewide=True, target="", score=20.0),
    )
    row = link_intel.competitor_profile(links).first()
    assert (row.total_domains, row.live_domains, row.lost_domains, row.total_backlinks, row.live_backlinks) == (3, 2, 1, 4, 2)
    assert (row.new_flagged_backlinks, row.unique_target_pages, row.follow_rate_live, row.high_as_rate_live, row.avg_page_as_live) == (1, 1, 0.5, 0.5, 30.0)
    levels = link_intel.diagnostics(link_intel.competitor_profile(links)).first()
    assert (levels.backlink_loss_level, levels.domain_loss_level, levels.follow_level, levels.concentration_level) == ("很高", "偏高", "中等", "非常分散")


def test_cohorts(links_b):
    links = links_b(
        b_link(1, domain="a.com", seen="2019-01-01", lost=True), b_link(2, domain="a.com", seen="2021-01-01"),
        b_link(3, domain="b.com", seen=""), b_link(4, domain="b.com", seen="2021-05-05", lost=True), b_link(5, domain="z.com", seen="soon"),
    )
    assert rows_of(link_intel.cohorts(links)) == [("c1", "2019", 1, 0, 1, 1), ("c1", "2021", 2, 1, 1, 1)]


def test_examples_are_distinct_and_ordered(links_b):
    rows = [b_link(i, url=f"https://d.com/{i:02d}", score=float(i % 7), lost=i % 2 == 0) for i in range(40)]
    links = links_b(*rows, *rows[:10])
    got = link_intel.domain_examples(links, 20).first()
    lines = got.examples.split("\n")
    assert got.n_examples == 20 and len(set(lines)) == 20 and all("[LIVE]" in line for line in lines)
    assert lines[0] == "[c1] [LIVE] AS 6 | https://d.com/13 --[无锚文本]--> https://t.com/ (Follow)"


def test_type_mix_and_rates(links_b):
    links = links_b(b_link(1, text=True), b_link(2, url="https://d.com/2", text=True, sponsored=True), b_link(3, url="https://d.com/3", image=True, text=True, ugc=True, lost=True))
    row = link_intel.domain_measures(links).first()
    assert row.type_mix == "Text:2, Image:1"
    assert (round(row.live_rate, 4), row.live_follow_rate, round(row.sponsored_rate, 4), row.source_pages) == (0.6667, 0.5, 0.3333, 3)


def brute_path(domain, texts):
    blob = "\n".join([domain, *texts]).lower()
    hits = lambda words, where: [w for w in words if w in where]
    under = lambda parents: any(domain == p or domain.endswith("." + p) for p in parents)
    if under(rules.APP_DOMAINS) or under(rules.MEDIA_DOMAINS) or domain.endswith((".edu", ".gov", ".edu.au")) or hits(rules.STRATEGIC, blob):
        return "strategic"
    if hits(rules.SELF_SERVE, blob):
        return "self_serve"
    if hits(rules.DIRECTORY_PATHS, blob) or hits(rules.DIRECTORY_DOMAINS, domain):
        return "directory"
    if hits(rules.OFFICIAL_ENTRY, blob):
        return "official"
    return "editorial" if hits(rules.EDITORIAL, blob) else "unverified"


def test_acquisition_paths_equal_brute_force(links_b):
    rng = random.Random(5)
    words = [*rules.SELF_SERVE, *rules.DIRECTORY_PATHS, *rules.OFFICIAL_ENTRY, *rules.STRATEGIC, *rules.EDITORIAL, "", "plain", "shop"]
    domains = ["a.org", "b.org", "uni.edu", "x.edu.au", "sub.zapier.com", "wired.com", "hotfrog.net", *[f"d{i}.net" for i in range(30)]]
    rows, texts = [], {}
    for i in range(150):
        domain = rng.choice(domains)
        title, url, anchor = rng.choice(words).upper(), f"https://{domain}/{rng.choice(words)}", rng.choice(["", "plain", rng.choice(words)])
        rows.append(b_link(i, comp=f"c{i % 3}", domain=domain, url=url, title=title, anchor=anchor))
        texts.setdefault(domain, []).extend([title, url, anchor])
    got = {r.domain: r.path for r in action_queue.action_path(links_b(*rows).repartition(6)).collect()}
    assert got == {d: brute_path(d, t) for d, t in texts.items()}


def test_drop_reasons(links_b):
    links = links_b(
        b_link(1, domain="c1"), b_link(2, domain="bit.ly"), b_link(3, domain="x.cloudfront.net"),
        b_link(4, domain="img.org", url="https://img.org/a.png"), b_link(5, domain="img.org", url="https://img.org/b.css?v=1"),
        b_link(6, domain="tech.org", url="https://tech.org/static/a.js"), b_link(7, domain="tech.org", url="https://tech.org/static/page"),
        b_link(8, domain="ok.org", url="https://ok.org/static/a.js"), b_link(9, domain="ok.org"),
    )
    got = {r.domain: r.drop_reasons for r in action_queue.drop_detection(links).collect()}
    reasons = rules.DROP_REASONS
    assert got == {
        "c1": reasons["self"], "bit.ly": reasons["redirect"], "x.cloudfront.net": reasons["cdn"],
        "img.org": reasons["assets"], "tech.org": reasons["technical"], "ok.org": "",
    }


def test_machine_score_without_and_with_metrics(spark, links_b):
    links = links_b(b_link(1, domain="a.org", score=50.0), b_link(2, domain="b.org", score=50.0), b_link(3, domain="c.org", score=50.0, lost=True))
    rows = spark.createDataFrame(
        [("b.org", 50.0, 0.0, 0.0, None, "f1"), ("b.org", None, 0.0, None, 3.0, "f0")],
        "domain string, authority_score double, monthly_visits double, organic_traffic double, organic_keywords double, source_file string",
    )
    metrics = action_queue.merge_enrichment(rows)
    merged_row = metrics.first()
    assert (merged_row.authority_score, merged_row.organic_keywords, merged_row.source_files) == (50.0, 3.0, ["f0", "f1"])
    queue = by_key(action_queue.action_queue(links, metrics), "domain")
    # 15 + 4 + 12 + 10 + 4 + 5 of 0.85; known zeros stay in the denominator
    assert queue["a.org"].machine_score == 58.8 and queue["a.org"].traffic_status == "未补充"
    assert queue["b.org"].machine_score == 50.0 and queue["b.org"].traffic_status == "已补充"
    assert queue["c.org"].machine_score == 14.4  # 19 / 0.85 - 8
    assert queue["c.org"].score_breakdown.endswith("Penalty=-8")
    scored = action_queue.scored_domains(links, metrics)
    assert rows_of(action_queue.unenriched_batches(scored, 1)) == [(1, 1, "a.org"), (2, 2, "c.org")]
    assert rows_of(action_queue.priority_counts(scored)) == [("P2", 3, 1)]


def test_dropped_domains_score_at_most_25(links_b, spark):
    none = spark.createDataFrame([], "domain string, authority_score double, monthly_visits double, organic_traffic double, organic_keywords double, source_file string")
    row = action_queue.action_queue(links_b(b_link(1, domain="bit.ly", score=90.0)), action_queue.merge_enrichment(none)).first()
    assert row.priority == "Drop" and row.machine_score == 25.0 and row.priority_rank == 4


def test_modal_and_competitor(spark):
    rows = spark.createDataFrame(
        [("backlinks-acme_export.csv", 1, "https://a.com"), ("backlinks-acme_export.csv", 2, "https://b.com"), ("backlinks-acme_export.csv", 3, "https://c.com"),
         ("x.csv", 1, "https://b.com"), ("x.csv", 2, "https://www.a.com/1"), ("empty.csv", 1, "")],
        "src_file string, src_ord int, target_url string",
    )
    got = {r.src_file: r.competitor_domain for r in imports.competitor_of_files(rows).collect()}
    assert got == {"backlinks-acme_export.csv": "acme", "x.csv": "b.com", "empty.csv": "empty"}


def test_mail_merge(spark):
    people = spark.createDataFrame([("www.big.com", " "), (None, "a@b"), ("x.tv", "me@x.tv")], "domain string, email string")
    got = rows_of(mailing.mail_merge(people, "S", "Hi [Name], bye [Name]"))
    assert got == [("www.big.com", "", "S", "Hi Big, bye Big"), ("x.tv", "me@x.tv", "S", "Hi X, bye X")]


def test_final_scores_follow_the_written_cells(spark):
    rows = [("a.com", 50.0, "80", " 40 "), ("b.com", 50.0, "", ""), ("c.com", 50.0, "soon", "NaN")]
    queue = spark.createDataFrame(rows, "ref_domain string, auto_score double, ai_relevance string, human_difficulty string")
    assert {r.ref_domain: r.final_score for r in link_queue.final_v1(queue).collect()} == {"a.com": 54.0, "b.com": 40.0, "c.com": 40.0}
    assert {r.ref_domain: r.final_score for r in link_queue.final_v2(queue).collect()} == {"a.com": 54.5, "b.com": 42.5, "c.com": 42.5}
    by_machine = action_queue.final_score(queue.withColumnRenamed("auto_score", "machine_score"))
    assert {r.ref_domain: r.final_score for r in by_machine.collect()} == {"a.com": 53.0, "b.com": 50.0, "c.com": 50.0}


def test_answers_replace_blanks_and_move_the_final_score(spark):
    queue = link_queue.final_v2(
        spark.createDataFrame(
            [("a.com", 50.0, "", "Pending"), ("b.com", 60.0, "", "Pending")],
            "ref_domain string, auto_score double, ai_relevance string, review string",
        )
    )
    answers = spark.createDataFrame([("a.com", 90, None), ("x.com", 10, "Done")], "ref_domain string, ai_relevance int, review string")
    filled = link_queue.final_v2(link_queue.answered(queue, answers, "ref_domain"))
    assert {tuple(r) for r in filled.collect()} == {("a.com", 50.0, "90", "Pending", 56.0), ("b.com", 60.0, "", "Pending", 51.0)}
