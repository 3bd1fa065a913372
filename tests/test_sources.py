"""Readers, writers and whole runs on files written by the tests."""

import json

import pytest
from pyspark.sql import functions as F

from rankloom.operators import link_facts
from rankloom.plans import jobs
from rankloom.sinks import writers
from rankloom.sources import documents, exports, lists, overview, vendor_exports


def put(folder, name, text, encoding="utf-8"):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text.encode(encoding))
    return str(path)


A_HEADER = "Referring page URL\tTarget URL\tDomain rating\tPage traffic\tNofollow\tIs spam\tLinks in group\tLost\tFirst seen\tPage type\tAnchor"


@pytest.fixture
def vendor_a(tmp_path):
    put(
        tmp_path,
        "Acme.com-backlinks-2024.tsv",
        A_HEADER + "\nhttps://www.x.com/1\thttps://acme.com/\t55.7\t1,200\tTRUE\t\t3\t\t2020-02-02\tWeb > Blog\tfirst\n"
        "https://x.com/2\thttps://acme.com/\t10\t5\tfalse\tTRUE\tbad\tyes\t2021-01-01\t\tsecond\n"
        "\thttps://acme.com/\t1\t1\t\t\t\t\t\t\t\n",
        "utf-16",
    )
    put(
        tmp_path,
        "beta_export copy 1.csv",
        '﻿Source URL,Target URL,DR,Traffic,Anchor\nhttps://x.com/1,https://beta.com/,70,inf,"two\nlines, ""quoted"""\nhttp://y.org/a b,,,,\n',
    )
    put(tmp_path, "z-overview-competitors.csv", ",\n")
    return tmp_path


def test_vendor_a_reader(spark, vendor_a):
    rows = {r.ref_url: r for r in vendor_exports.read_vendor_a_links(spark, str(vendor_a)).collect()}
    first, second = rows["https://www.x.com/1"], rows["https://x.com/2"]
    assert (first.competitor_domain, first.ref_domain, first.domain_rating, first.page_traffic) == ("acme.com", "x.com", 55, 0)
    assert (first.is_dofollow, first.links_in_group, first.is_lost, first.page_type, first.page_category) == (False, 3, False, "Web > Blog", "Unknown")
    assert (second.is_spam, second.links_in_group, second.is_lost, second.page_type) == (True, 1, True, "")
    beta = rows["https://x.com/1"]
    assert (beta.competitor_domain, beta.domain_rating, beta.page_traffic) == ("beta", 70, 0)
    assert json.loads(beta.raw_json)["Anchor"] == 'two\nlines, "quoted"'
    assert rows["http://y.org/a b"].ref_domain == "y.org" and len(rows) == 4


def test_first_row_of_the_file_is_kept(spark, vendor_a):
    facts = link_facts.vendor_a_facts(vendor_exports.read_vendor_a_links(spark, str(vendor_a)))
    kept = {(r.competitor_domain, r.ref_domain): r.ref_url for r in facts.collect()}
    assert kept[("acme.com", "x.com")] == "https://www.x.com/1" and len(kept) == 3


def test_headers_and_details(spark, vendor_a):
    paths = [p for p in exports.list_files(spark, str(vendor_a), "*.*sv") if "overview" not in p]
    files = exports.inspect(spark, paths)
    assert [(f.encoding, f.separator) for f in files] == [("UTF-16", "\t"), ("UTF-8", ",")]
    headers = exports.all_headers(files)
    assert headers[0] == "Referring page URL" and "Source URL" in headers and headers.count("Anchor") == 1
    facts = link_facts.vendor_a_facts(vendor_exports.read_vendor_a_links(spark, str(vendor_a)))
    wide = jobs.detail_tables(facts, headers).collect()
    assert len(wide) == 3 and {r["Source URL"] for r in wide if r["competitor_domain"] == "acme.com"} == {""}


def test_split_reading_keeps_the_order(spark, tmp_path):
    lines = ["Source URL,Target URL,DR"] + [f"https://d{i % 50}.com/{i},t,{i}" for i in range(4000)]
    put(tmp_path, "big-backlinks.csv", "\n".join(lines) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16384")
    try:
        rows = vendor_exports.read_vendor_a_links(spark, str(tmp_path), multi_line=False)
        assert rows.rdd.getNumPartitions() > 3
        kept = {r.ref_domain: r.domain_rating for r in link_facts.vendor_a_facts(rows).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert kept == {f"d{i}.com": i for i in range(50)}


def test_keywords_with_an_empty_competitor(spark, tmp_path):
    put(tmp_path, "acme-organic-positions-us.csv", "Keyword,Country,Branded,Volume,KD,CPC,Traffic,Position,URL\n oak chair ,us,TRUE,100,5.9,0.5,1.5,,https://a\n,us,,,,,,,\nb,de,,,,,,7,\n")
    put(tmp_path, "ghost-organic-positions.csv", "")
    rows = {r.keyword: r for r in vendor_exports.read_keywords(spark, str(tmp_path)).collect()}
    assert (rows["oak chair"].is_branded, rows["oak chair"].kd, rows["oak chair"].current_position) == (True, 5, 999)
    assert (rows["b"].current_position, rows["b"].cpc) == (7, 0.0)
    assert (rows[""].competitor_domain, rows[""].current_position, rows[""].raw_json) == ("ghost", 999, "{}")


def test_top_pages(spark, tmp_path):
    put(tmp_path, "acme-top-pages.csv", "URL,UR,Current traffic,Current traffic value,Current # of keywords,Current top keyword,Current top keyword: Volume\nhttps://a.com/blog/x;p=1?q,12,30.9,1.5,4, oak ,70\n,1,1,1,1,x,1\n")
    put(tmp_path, "none.csv", "")
    rows = vendor_exports.read_top_pages(spark, str(tmp_path)).collect()
    row = rows[0]
    assert len(rows) == 1 and (row.competitor_domain, row.url_path, row.page_category) == ("acme", "/blog/x", "Blog & Content")
    assert (row.ur, row.current_traffic, row.current_traffic_value, row.current_keywords, row.top_keyword, row.top_keyword_volume) == (12, 30, 1.5, 4, "oak", 70)


B_ROWS = (
    "Source url,Target url,Anchor,Page ascore,External links,Nofollow,Text,Lost link,First seen\n"
    "https://www.x.com/p/,https://acme.com/a,Hi,\"1,234.5\",\"1,000\",yes,true,false,05/03/2024\n"
    "https://x.com/p,https://www.acme.com/a/,hi,1,1,1,1,0,2024-03-05\n"
    "y.org/page,https://acme.com/b,,,,,,,junk\n"
    "/relative,https://acme.com/b,,,,,,,\n"
)


def test_vendor_b_reader_and_audit(spark, tmp_path):
    put(tmp_path, "backlinks-one.csv", B_ROWS)
    put(tmp_path, "bad.csv", "Source url,Anchor\nhttps://x.com,y\n")
    put(tmp_path, "bare.csv", "Source url,Target url\n")
    put(tmp_path, "latin.csv", "Source url,Target url,Anchor\nhttps://l.com/é,https://acme.com/,caf\xe9\n", "latin-1")
    files = vendor_exports.inspect_vendor_b(spark, str(tmp_path))
    assert {f.name: f.encoding for f in files}["latin.csv"] == "ISO-8859-1"
    rows = vendor_exports.read_vendor_b_links(spark, files)
    by_url = {(r.src_file, r.source_url): r for r in rows.collect()}
    assert by_url[("latin.csv", "https://l.com/é")].anchor == "café"
    assert by_url[("backlinks-one.csv", "https://y.org/page")].ref_domain == "y.org"
    assert [r.rejected for (f, u), r in by_url.items() if u.startswith("https:///")] == [True]
    assert {r.competitor_domain for r in by_url.values()} == {"acme.com"}
    out = str(tmp_path / "out")
    jobs.link_intel_run(spark, str(tmp_path), out)
    audit = {r.src_file: r for r in spark.read.parquet(f"{out}/audit").collect()}
    one = audit["backlinks-one.csv"]
    assert (one.n_rows, one.n_rejected, one.n_inserted, one.n_duplicates) == (4, 1, 2, 1)
    assert one.note.startswith("rejected 1; duplicates 1; missing columns: form, frame")
    assert sorted(tuple(r) for r in spark.read.parquet(f"{out}/skipped_files").collect()) == [
        ("bad.csv", "SKIPPED", "missing columns: target url"), ("bare.csv", "EMPTY", "no rows"),
    ]
    kept = spark.read.parquet(f"{out}/link_facts").filter("ref_domain = 'x.com'").first()
    assert (kept.page_ascore, kept.external_links, kept.first_seen, kept.is_nofollow) == (1234.5, 1000, "2024-03-05", True)
    assert spark.read.json(f"{out}/payload").count() == 3
    details = spark.read.option("header", True).option("multiLine", True).csv(f"{out}/detail_columns")
    assert details.columns[:7] == ["competitor_domain", "ref_domain", "alpha", "state", "follow", "link_type", "authority_band"]
    assert details.count() == spark.read.parquet(f"{out}/link_facts").count()
    assert "1,234.5" in {r["Page ascore"] for r in details.filter("ref_domain = 'x.com'").collect()}


def test_action_queue_run(spark, tmp_path):
    put(tmp_path / "links", "backlinks-one.csv", B_ROWS)
    put(tmp_path / "metrics", "bulk.csv", "Root Domain,Authority Score (AS),Organic Search Traffic\nhttps://www.x.com/,45,\"1,500\"\nx.com,40,n/a\n")
    out = str(tmp_path / "out")
    jobs.link_intel_run(spark, str(tmp_path / "links"), f"{out}/intel")
    jobs.action_queue_run(spark, f"{out}/intel/link_facts", str(tmp_path / "metrics"), f"{out}/queue", "Acme")
    queue = {r.domain: r for r in spark.read.parquet(f"{out}/queue/queue").collect()}
    assert (queue["x.com"].domain_authority_score, queue["x.com"].organic_traffic, queue["x.com"].traffic_status) == (45.0, 1500.0, "已补充")
    assert queue["y.org"].traffic_status == "未补充" and queue["y.org"].domain_authority_score is None
    sheet = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(f"{out}/queue/queue_csv")
    assert len(sheet.columns) == 27 and sheet.columns[0] == "Priority" and sheet.count() == 2
    assert [tuple(r) for r in spark.read.option("header", True).csv(f"{out}/queue/open_domains").collect()] == [("1", "1", "y.org")]
    jobs.action_queue_run(spark, f"{out}/intel/link_facts", None, f"{out}/bare", "Acme")
    assert spark.read.parquet(f"{out}/bare/priority_counts").agg(F.sum("n_enriched")).first()[0] == 0


def test_stored_facts_are_checked(spark, tmp_path):
    spark.range(1).write.parquet(str(tmp_path / "facts"))
    with pytest.raises(ValueError, match="anchor"):
        lists.read_link_facts(spark, str(tmp_path / "facts"))


def test_headers_are_matched_by_alias():
    assert lists.header_words("\ufeff Authority_Score (AS) ") == ("authority", "score", "as")
    pick = lambda headers, aliases: lists.settle_headers(headers, {"m": aliases}).get("m")
    assert pick(["Foo", "Organic-Traffic"], ["organic traffic"]) == "Organic-Traffic"
    assert pick(["Authority Score (AS)"], ["as", "authority score"]) == "Authority Score (AS)"
    assert pick(["score", "AS"], ["as", "score"]) == "AS"
    assert pick(["basic"], ["as"]) is None


def test_page_headers_settle_by_rank():
    fields = lists._page_fields(["URL", "Traffic", "Current traffic", "Current # of keywords", "Keywords", "Current top keyword"])
    assert fields == {"url": "URL", "traffic": "Current traffic", "keywords": "Current # of keywords", "top_keyword": "Current top keyword"}


def test_page_metrics_of_files_with_one_name(spark, tmp_path):
    put(tmp_path / "a", "export.csv", "URL,Traffic\nhttps://a.com/x,1\n")
    put(tmp_path / "b", "export.csv", "URL,Traffic\nhttps://b.com/x,2\n")
    rows = lists.read_page_metrics(spark, str(tmp_path)).collect()
    assert sorted((r.domain, r.metrics_url) for r in rows) == [("a.com", "https://a.com/x"), ("b.com", "https://b.com/x")]


def test_batches_keep_queue_order(spark, tmp_path):
    rows = spark.createDataFrame([(1, 1, "z.com"), (2, 1, "a.com"), (3, 2, "m.com")], "row_no long, batch_no long, domain string")
    writers.write_batches(rows.orderBy("domain"), str(tmp_path / "b"))
    lines = "".join(p.read_text().split("\n", 1)[1] for p in sorted((tmp_path / "b").glob("part-*")))
    assert [line.split(",")[2].strip('"') for line in lines.split()] == ["z.com", "a.com", "m.com"]


def test_matrix_queue_and_traffic_run(spark, vendor_a, tmp_path_factory):
    wide = [["", "acme.com/ (subdomains)", "acme.com (subdomains)", "beta.com (subdomains)", "beta.com (exact)"], ["", "Organic traffic", " Organic traffic ", "Organic traffic", "Organic traffic"], [], [""] * 5,
            ["2024-01-01", "5", "7", "12.5", "9"], ["", "1", "1", "1", "1"], ["2024-01-02", "x", "8", "3", "9"]]
    put(vendor_a, "z-overview-competitors.csv", "\n".join(",".join(r) for r in wide) + "\n")
    out = str(tmp_path_factory.mktemp("out"))
    jobs.link_matrix_run(spark, str(vendor_a), out, "chairs")
    traffic = sorted(tuple(r) for r in spark.read.parquet(f"{out}/traffic").collect())
    assert traffic == [("2024-01-01", "acme.com", 5), ("2024-01-01", "beta.com", 0), ("2024-01-02", "acme.com", 0), ("2024-01-02", "beta.com", 3)]
    matrix = {r.ref_domain: r for r in spark.read.parquet(f"{out}/overlap_matrix").collect()}
    assert matrix["x.com"].alpha == 2 and matrix["x.com"].max_dr == 70
    assert spark.read.json(f"{out}/briefs").count() == 2
    details = spark.read.option("header", True).option("multiLine", True).csv(f"{out}/detail_columns")
    assert details.count() == 3 and "Source URL" in details.columns
    jobs.link_queue_run(spark, f"{out}/link_facts", f"{out}/queues", "Acme")
    assert spark.read.parquet(f"{out}/queues/queue_v2").count() == 2


def test_short_overview_gives_its_day(spark, tmp_path):
    path = put(tmp_path, "o-overview-competitors.csv", ",a.com (subdomains)\n,Organic traffic\n,\n,\n2024-01-01,5\n")
    assert [tuple(r) for r in overview.read_traffic_overview(spark, path).collect()] == [("2024-01-01", "a.com", 5)]


def test_keyword_runs(spark, tmp_path):
    put(tmp_path / "in", "acme-organic-positions.csv", "Keyword,Country,Commercial,Volume,KD,CPC,Traffic,Position,URL\noak chair,us,TRUE,1000,5,1.5,20,2,https://a/1\noak chair,us,TRUE,9,9,9,9,9,https://a/2\n")
    out = str(tmp_path / "out")
    jobs.keyword_run(spark, str(tmp_path / "in"), out)
    assert spark.read.parquet(f"{out}/keyword_facts").count() == 1
    assert spark.read.parquet(f"{out}/queue").first().auto_score == 75.5
    jobs.keyword_task_run(spark, f"{out}/keyword_facts", f"{out}/tasks", "Acme", "2024-05-05")
    task = spark.read.parquet(f"{out}/tasks/tasks").first()
    assert (task.task_id, task.discovered, task.status, task.competitors) == ("SEO-PAGE-0001", "2024-05-05", "Pending", "Acme")
    assert spark.read.parquet(f"{out}/tasks/benchmarks").first().benchmark == "[Acme] https://a/1 (Traffic: 20.0)"


def test_page_run(spark, tmp_path):
    put(tmp_path / "in", "acme_top_pages.csv", "URL,Current traffic,Current referring domains\nhttps://a.com/,10,4\nhttps://a.com/vs/b,30,1\nhttps://a.com/,99,9\n")
    jobs.page_run(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    classes = {r.page_category: r.traffic_share for r in spark.read.parquet(f"{tmp_path}/out/classes").collect()}
    assert classes == {"Comparison Pages": 0.75, "Homepage": 0.25}
    assert spark.read.parquet(f"{tmp_path}/out/profile").first().ref_domains_per_page == 2.5
    details = spark.read.option("header", True).csv(f"{tmp_path}/out/detail_columns")
    assert details.columns == ["competitor_domain", "page_url", "page_category", "page_type", "URL", "Current traffic", "Current referring domains"]
    assert sorted((r["URL"], r["Current traffic"]) for r in details.collect()) == [("https://a.com/", "10"), ("https://a.com/vs/b", "30")]


def test_original_columns_never_clash(spark):
    rows = spark.createDataFrame([("a", '{"Alpha": "1", "alpha": "2", "x y": "3"}')], "alpha string, raw_json string")
    wide = writers.with_raw_columns(rows, ["Alpha", "alpha", "x y", "X Y"], ["alpha"])
    assert wide.columns == ["alpha", "Alpha (2)", "alpha (3)", "x y", "X Y (2)"]
    assert tuple(wide.first()) == ("a", "1", "2", "3", "")


def test_site_run(spark, tmp_path):
    put(tmp_path / "m" / "deep", "h.com-top-pages.csv", "URL,Current traffic,Current # of keywords,Current top keyword\nhttps://h.com/a,7,2,oak\nhttps://www.h.com/a/,3,1,x\nhttps://h.com/only,0,0,\n")
    put(tmp_path / "m", "unnamed.csv", "url,traffic,keywords\nhttps://www.g.com/z,4,1\n")
    index = "<sitemapindex><sitemap><loc>https://h.com/1.xml</loc></sitemap><sitemap><loc>https://h.com/sitemap.xml</loc></sitemap></sitemapindex>"
    leaf = "<urlset><url><loc> https://h.com/a </loc></url><url><loc>https://h.com/b</loc></url></urlset>"
    fetched = spark.createDataFrame([("https://h.com/sitemap.xml", index), ("https://h.com/1.xml", leaf)], "url string, body string")
    robots = spark.createDataFrame([("https://h.com", "User-agent: *\n"), ("https://g.com", "SITEMAP: https://g.com/x.xml\r\n")], "site string, body string")
    roots = documents.robots_sitemaps(robots)
    assert sorted(r.sitemap_url for r in roots.collect()) == ["https://g.com/x.xml", "https://h.com/sitemap.xml"]
    jobs.site_run(spark, str(tmp_path / "m"), fetched, roots, str(tmp_path / "out"))
    found = {r.final_url: (r.domain, r.traffic, r.in_sitemap) for r in spark.read.parquet(f"{tmp_path}/out/pages").collect()}
    assert found == {
        "https://h.com/a": ("h.com", 7.0, True), "https://h.com/b": ("h.com", 0.0, True),
        "https://h.com/only": ("h.com", 0.0, False), "https://www.g.com/z": ("g.com", 4.0, False),
    }
    tree = {r.node_id: r.traffic for r in spark.read.parquet(f"{tmp_path}/out/tree").collect()}
    assert tree["h.com"] == 7.0 and tree["g.com/z"] == 4.0
    sheet = spark.read.option("header", True).csv(f"{tmp_path}/out/metrics/pages")
    assert {r.final_url for r in sheet.collect()} == {"https://h.com/a", "https://www.g.com/z"}


def test_index_depth_is_bounded(spark):
    chain = [(f"u{i}", f"<sitemapindex><sitemap><loc>u{i + 1}</loc></sitemap></sitemapindex>") for i in range(6)]
    pages = [(f"u{i}", f"<urlset><url><loc>p{i}</loc></url></urlset>") for i in range(7)]
    fetched = spark.createDataFrame(chain + pages, "url string, body string")
    roots = spark.createDataFrame([("s", "u0")], "site string, sitemap_url string")
    walk = documents.walk_sitemaps(roots, fetched, 3)
    assert sorted(r.page_url for r in walk.pages.collect()) == ["p0", "p1", "p2", "p3"]
    assert [tuple(r) for r in walk.frontier.collect()] == [("s", "u4")]
    whole = documents.walk_sitemaps(roots, fetched)
    assert sorted(r.page_url for r in whole.pages.collect()) == [f"p{i}" for i in range(7)] and whole.frontier.isEmpty()
    assert sorted((r.sitemap_url, r.depth) for r in whole.sitemaps.collect()) == [(f"u{i}", i) for i in range(7)]


def test_walk_ends_where_indexes_name_each_other(spark):
    index = lambda *locs: "<sitemapindex>" + "".join(f"<sitemap><loc>{u}</loc></sitemap>" for u in locs) + "</sitemapindex>"
    fetched = spark.createDataFrame(
        [("a", index("a", "b", "gone")), ("b", index("a", "c")), ("c", index("b")), ("c", "<urlset><url><loc>p</loc></url></urlset>")], "url string, body string"
    )
    roots = spark.createDataFrame([("s", "a"), ("t", "b"), ("s", "a"), ("v", "gone")], "site string, sitemap_url string")
    walk = documents.walk_sitemaps(roots, fetched)
    assert sorted(tuple(r) for r in walk.pages.collect()) == [("s", "p"), ("t", "p")] and walk.frontier.isEmpty()
    cut = documents.walk_sitemaps(roots, fetched, 1)
    assert sorted(tuple(r) for r in cut.frontier.collect()) == [("s", "c"), ("t", "gone")]


def test_monitor_run_chain(spark, tmp_path):
    sites = lists.read_targets(spark, put(tmp_path, "targets.txt", "a.com\n\n b.com \na.com\n"))
    assert sorted(r.url for r in sites.collect()) == ["https://a.com/sitemap.xml", "https://b.com/sitemap.xml"]
    known = sites.select(F.when(F.col("url").contains("a.com"), 1).otherwise(2).alias("site_id"), "url")
    empty = spark.createDataFrame([], "site_id int, page_url string, first_seen timestamp_ntz, last_seen timestamp_ntz")
    day1 = spark.createDataFrame([(1, "https://a.com//oak-chair/"), (1, "https://a.com/oak-chair"), (2, "https://b.com/oak-chair")], "site_id int, url string")
    jobs.monitor_run(spark, day1, known, empty, str(tmp_path / "d1"), "2024-01-01 00:00:00")
    day2 = spark.createDataFrame([(1, "https://a.com/oak-chair"), (2, "https://b.com/new-desk")], "site_id int, url string")
    jobs.monitor_run(spark, day2, known, spark.read.parquet(f"{tmp_path}/d1/snapshot"), str(tmp_path / "d2"), "2024-01-02 00:00:00")
    assert sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/d2/changes").collect()) == [(2, "https://b.com/new-desk", "added"), (2, "https://b.com/oak-chair", "removed")]
    seen = {r.page_url: r.first_seen.day for r in spark.read.parquet(f"{tmp_path}/d2/snapshot").collect()}
    assert seen == {"https://a.com/oak-chair": 1, "https://b.com/new-desk": 2}
    summary = spark.read.json(f"{tmp_path}/d1/summary").first()
    assert summary.data_summary.sites_analyzed == 2 and summary.data_summary.total_keywords_extracted == 1
    assert spark.read.parquet(f"{tmp_path}/d1/slug_overlap").first().shared_by == "a.com, b.com"


def test_mail_run(spark, tmp_path):
    template = put(tmp_path, "t.txt", "\n Hello there \n\nHi [Name],\nbye\n")
    assert lists.read_template(spark, template) == ("Hello there", "Hi [Name],\nbye\n")
    values = [""] * 31
    values[0], values[15] = "www.big.com", "x@big.com"
    bare = put(tmp_path, "bare.csv", ",".join(values) + "\n")
    names = lists.read_prospects(spark, bare).columns
    assert names[0] == "目标域名 (Domain)" and names[29:] == ["未知扩展列_29", "未知扩展列_30"]
    jobs.mail_run(spark, bare, template, str(tmp_path / "mails"))
    mail = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(f"{tmp_path}/mails").first()
    assert mail["To (收件邮箱)"] == "x@big.com" and mail["Body (邮件正文)"] == "Hi Big,\nbye\n"
    titled = put(tmp_path, "titled.csv", "Name,Domain,Email\nA,y.tv,\n")
    assert lists.contact_columns(lists.read_prospects(spark, titled).columns) == ("Domain", "Email")
    jobs.mail_run(spark, titled, template, str(tmp_path / "mails2"))
    assert spark.read.option("header", True).option("multiLine", True).csv(f"{tmp_path}/mails2").count() == 1


def test_page_links(spark):
    found = documents.page_links(spark.createDataFrame([("u", '<a href="/x">x</a><a class=1 HREF="https://y">')], "url string, html string"))
    assert sorted(r.href for r in found.collect()) == ["/x", "https://y"]


def test_facts_can_be_laid_out_by_competitor(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "competitor_domain string, v int")
    writers.write_facts(rows, str(tmp_path / "facts"), ["competitor_domain"])
    assert spark.read.parquet(str(tmp_path / "facts")).filter("competitor_domain = 'a'").count() == 1
    assert (tmp_path / "facts" / "competitor_domain=a").exists()


def jobs_of(spark, group, run):
    spark.sparkContext.setJobGroup(group, group)
    result = run()
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return result, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def test_jobs_do_not_grow_with_the_number_of_files(spark, tmp_path):
    counts, listing = [], "spark.sql.sources.parallelPartitionDiscovery.threshold"
    before = spark.conf.get(listing)
    spark.conf.set(listing, "1000")  # else Spark lists more than 32 paths by a job of its own, once per scan
    for n in (3, 200):
        folder = tmp_path / str(n)
        for i in range(n):
            wide = i % 3 == 2
            put(folder, f"f{i:03d}-backlinks.csv", "Source URL\tDR\nhttps://x.com/1\t5\n" if wide else f"Source URL,DR\nhttps://x{i}.com/é,{i}\n", ["utf-8", "latin-1", "utf-16"][i % 3])
        paths = exports.list_files(spark, str(folder), "*.csv")
        files, inspected = jobs_of(spark, f"inspect-{n}", lambda paths=paths: exports.inspect(spark, paths, latin1_fallback=True))
        rows, read = jobs_of(spark, f"read-{n}", lambda folder=folder: vendor_exports.read_vendor_a_links(spark, str(folder)))
        counts.append((inspected, read))
        assert {f.encoding for f in files} == {"UTF-8", "ISO-8859-1", "UTF-16"}
        assert all(f.headers == ("Source URL", "DR") for f in files) and rows.count() == n
    spark.conf.set(listing, before)
    assert len(set(counts)) == 1


def test_headers_of_all_encodings(spark, tmp_path):
    text = "Source URL\tÄnchor\nhttps://x.com/1\tä\n"
    put(tmp_path, "a.csv", "﻿" + text, "utf-16-le")
    put(tmp_path, "b.csv", "﻿" + text.replace("\n", "\r\n"), "utf-16-be")
    put(tmp_path, "c.csv", '"Source\nURL",B\n1,2\n')
    put(tmp_path, "d.csv", "\n1,2\n")
    put(tmp_path, "e.csv", "")
    files = exports.inspect(spark, exports.list_files(spark, str(tmp_path), "*.csv"))
    assert [f.headers for f in files] == [("Source URL", "Änchor"), ("Source URL", "Änchor"), ("Source\nURL", "B"), (), ()]


def test_jobs_of_overviews_do_not_grow_with_the_files(spark, tmp_path):
    counts = []
    for n in (1, 30):
        folder = tmp_path / str(n)
        for i in range(n):
            put(folder, f"o{i:02d}.csv", f",a.com/ (subdomains)\n,Organic traffic\n,x\n,x\n2024-01-{i % 28 + 1:02d},{i}\n")
        found, made = jobs_of(spark, f"overview-{n}", lambda folder=folder: overview.read_traffic_overviews(spark, exports.list_files(spark, str(folder), "*.csv")).collect())
        assert {(r.date, r.traffic) for r in found} == {(f"2024-01-{i + 1:02d}", i) for i in range(min(n, 28))}
        counts.append(made)
    assert counts[0] == counts[1]


def test_rejected_rows_and_suffix_rules_of_an_import(spark, tmp_path):
    head = "Source URL,Target URL,Anchor,External links,Internal links,Nofollow,First seen,Last seen,Page ascore,Source title\n"
    lines = ["https://a.b.co.uk/x", "", "  ", "https:///p", "/only/path", "www.q.ck", "w.x.z.ck", "no-scheme.com/1"]
    put(tmp_path / "in", "acme-backlinks.csv", head + "".join(f"{u},https://acme.com/,t,1,1,false,,,5,title\n" for u in lines))
    files = vendor_exports.inspect_vendor_b(spark, str(tmp_path / "in"))
    suffixes = spark.createDataFrame([("co.uk",), ("uk",), ("*.ck",), ("!www.ck",), ("com",)], "suffix string")
    rows = vendor_exports.read_vendor_b_links(spark, files, suffixes=suffixes).collect()
    assert {r.raw_source_url: r.ref_domain for r in rows if not r.rejected} == {
        "https://a.b.co.uk/x": "b.co.uk", "www.q.ck": "q.ck", "w.x.z.ck": "x.z.ck", "no-scheme.com/1": "no-scheme.com"}
    jobs.link_intel_run(spark, str(tmp_path / "in"), str(tmp_path / "out"), suffixes=suffixes)
    found = {(r.reason, r.n_rows) for r in spark.read.parquet(f"{tmp_path}/out/rejects").collect()}
    assert found == {("no source URL", 1), ("no host in the source URL", 1)} and spark.read.parquet(f"{tmp_path}/out/link_facts").count() == 4
