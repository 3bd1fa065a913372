"""Facts derived from the driver tables.

Every view uses whole tables. ``VIEW_SQL`` in :mod:`rankloom.plans.sql_views` states the same views as SQL.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.functions.urls import hostname, page_url, path

# Hosts by brand number; an empty entry takes the host of a page (view data, shared with the SQL twin).
HOSTS = (
    "g2.com", "amazon.com", "youtube.com", "coupon-hub.example", "techcrunch.com", "apps.shopify.com",
    "community.example.org", "cloudfront.net", "bit.ly", "state.edu", "comp0.example", "kompass.com",
    "best-tools.example", "zapier.com", "dsers.com", "directory.example", "medium.com", "www.yelp.com",
    "", "", "", "", "", "", "",
)
EXACT_HOSTS = ("bit.ly", "comp0.example")
# Path starts by part size and line number.
FOLDERS = (
    "", "/blog", "/directory", "/best-tools", "/contact-us", "/forum", "/wp-content/uploads", "/write-for-us",
    "/resources", "/add-listing", "/a-vs-b", "/integrations", "/tools", "/reviews", "/news",
)
# Words added to a keyword by part size.
KEYWORD_TAILS = ("", " login", " calculator", " dropshipping suppliers", " vs", " app-store", " o'neil 2-in-1")
# Competitor names by difficulty.
COMPETITOR_NAMES = ("redwidget", "ring", "small", "tool", "smallr")
# Anchors by line number.
ANCHORS = ("", "buy now", "price list", "alternative", "read the review", "write for us", "home")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(rows: DataFrame) -> DataFrame:
    """The rows dealt over the tasks. The given tables have one row group each, which one task would read and derive all facts
    from; real exports have many, so no operator of the library does this."""
    return rows.hint("rebalance")


#: Line items of a task: the facts derived from them are some 600 bytes a row, which a task then sorts in memory.
ROWS_PER_TASK = 250_000


def dealt_by(rows: DataFrame, key: str) -> DataFrame:
    """The rows dealt by the key of the join that follows, which then needs no exchange of its own, in as many tasks as their
    number asks for: a size in bytes says little, since the derived facts are ten times as wide as the rows."""
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // ROWS_PER_TASK))
    return rows.repartition(tasks, key)


def _pick(values, index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def _text(value: Column) -> Column:
    return value.cast("string")


def line_order() -> Column:
    """Total order of the line items."""
    c = F.col
    return F.struct(
        c("l_orderkey").alias("o"),
        c("l_linenumber").alias("l"),
        c("l_partkey").alias("p"),
        c("l_suppkey").alias("s"),
        c("l_shipdate").alias("d"),
        c("l_extendedprice").alias("e"),
        c("l_quantity").alias("q"),
    )


def with_sites(rows: DataFrame, key: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Add the referring site of a part: host by brand, path of one of the pages.

    Host and path are cut on the part and page side of the joins, once per part and page and not per row.
    """
    c = F.col
    url = c("url")
    host = _pick(HOSTS, F.substring("p_brand", 7, 3).cast("int") - 1)
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size", "p_type", "p_brand", host.alias("host"))
    pages = table(spark, sf_dir, "pages").select(
        "page_id", url.alias("page_url"), path(url).alias("page_path"), hostname(url).alias("page_host")
    )
    n_pages = pages.agg(F.count(F.lit(1))).scalar()
    placed = rows.join(part, c(key) == c("p_partkey")).withColumn("page_id", c("p_partkey") % n_pages)
    below = F.concat(F.lit("s"), _text(c("p_partkey")), F.lit("."), F.when(c("host") == "", c("page_host")).otherwise(c("host")))
    return (
        placed.join(pages, "page_id")
        .withColumn("ref_domain", F.when(c("host").isin(*EXACT_HOSTS), c("host")).otherwise(below))
        .drop("page_id", "host", "page_host")
    )


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One referring site per part."""
    return with_sites(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key")), "key", spark, sf_dir).drop("key")


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Link rows with the columns of both vendors."""
    c = F.col
    rows = with_sites(dealt_by(table(spark, sf_dir, "lineitem"), "l_partkey"), "l_partkey", spark, sf_dir)
    comp_no = F.least(c("l_suppkey") % 7, c("l_partkey") % 7)
    folder = _pick(FOLDERS, (c("p_size") + c("l_linenumber")) % len(FOLDERS))
    place = (
        F.when(c("p_size") == 7, F.concat(F.lit("/img/a"), _text(c("l_linenumber")), F.lit(".png")))
        .when(
            c("p_size") == 8,
            F.concat(
                F.lit("/static/x"), _text(c("l_linenumber")), F.when(c("l_linenumber") <= 4, ".css").otherwise("/")
            ),
        )
        .otherwise(F.concat(folder, c("page_path")))
    )
    authority = F.floor(2 * c("l_quantity") * (1 + c("l_partkey") % 10) / 10)
    traffic = F.when(c("l_partkey") % 5 == 0, 0).otherwise(
        (F.floor(c("l_extendedprice")) % 60) * F.element_at(F.array(*[F.lit(10**i) for i in range(4)]), (c("l_partkey") % 4 + 1).cast("int"))
    )
    anchor = _pick(ANCHORS, c("l_linenumber") - 1)
    raw = (
        F.when(c("l_linenumber") == 1, F.lit("{}"))
        .when(c("l_linenumber") == 7, F.lit("not json"))
        .when(c("l_linenumber") <= 4, F.concat(F.lit('{"Link anchor": "'), anchor, F.lit('"}')))
        .otherwise(F.concat(F.lit('{"Anchor": "'), anchor, F.lit('"}')))
    )
    host = c("ref_domain")
    nofollow = (c("l_returnflag") == "R") | (c("l_partkey") % 6 == 0)
    return rows.select(
        F.concat(F.lit("comp"), _text(comp_no), F.lit(".example")).alias("competitor_domain"),
        "ref_domain",
        F.concat(F.lit("https://"), host, place).alias("source_url"),
        F.concat(F.lit("https://"), host, place).alias("ref_url"),
        F.concat(
            F.lit("https://comp"), _text(comp_no), F.lit(".example/p/"), _text(c("l_orderkey") % 50), F.lit("/")
        ).alias("target_url"),
        c("p_name").alias("source_title"),
        anchor.alias("anchor"),
        raw.alias("raw_json"),
        authority.cast("bigint").alias("domain_rating"),
        authority.cast("double").alias("page_ascore"),
        traffic.cast("bigint").alias("page_traffic"),
        c("l_linenumber").cast("bigint").alias("links_in_group"),
        c("l_linenumber").cast("bigint").alias("external_links"),
        F.when(c("p_size") <= 10, "Unknown").otherwise(F.concat(F.lit("Web > "), F.initcap("p_type"))).alias("page_type"),
        F.when(c("p_size") <= 5, "").otherwise(F.concat(F.substring_index("p_name", " ", 1), F.lit(" > Parts"))).alias("page_category"),
        (~nofollow).alias("is_dofollow"),
        nofollow.alias("is_nofollow"),
        ((c("l_returnflag") == "A") & (c("l_linenumber") == 1)).alias("is_sponsored"),
        ((c("l_returnflag") == "N") & (c("l_linenumber") == 7)).alias("is_ugc"),
        ((c("l_linenumber") == 4) | (c("l_partkey") % 17 == 0)).alias("is_sitewide"),
        (((c("l_linenumber") == 6) & (c("l_partkey") % 13 == 0)) | (c("l_partkey") % 11 == 0)).alias("is_spam"),
        ((c("l_linestatus") == "F") | (c("l_partkey") % 9 == 0)).alias("is_lost"),
        ((c("l_returnflag") == "N") & (c("l_linestatus") == "O")).alias("is_new"),
        (c("l_quantity") > 25).alias("is_text"),
        (c("l_linenumber") == 2).alias("is_image"),
        (c("l_linenumber") == 3).alias("is_form"),
        (c("l_linenumber") == 5).alias("is_frame"),
        F.when(c("l_quantity") < 3, "").otherwise(F.date_format("l_shipdate", "yyyy-MM-dd")).alias("first_seen"),
        F.date_format(F.date_add("l_shipdate", 30), "yyyy-MM-dd").alias("last_seen"),
        F.concat(F.lit("backlinks-"), c("l_returnflag"), F.lit(".csv")).alias("src_file"),
        line_order().alias("src_ord"),
    )


def enrichment_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Domain metrics from two files; the second one knows less and covers fewer domains."""
    c = F.col
    site = sites(spark, sf_dir)
    key = c("p_partkey")
    first = site.filter(c("p_size") > 15).select(
        c("ref_domain").alias("domain"),
        (key % 101).cast("double").alias("authority_score"),
        (key * 11).cast("double").alias("monthly_visits"),
        F.when(key % 2 == 1, (key * 37).cast("double")).alias("organic_traffic"),
        (key % 7).cast("double").alias("organic_keywords"),
        F.lit("bulk-1.csv").alias("source_file"),
    )
    second = site.filter(c("p_size") > 35).select(
        c("ref_domain").alias("domain"),
        F.when(key % 3 == 0, F.lit(None)).otherwise((key % 90).cast("double")).alias("authority_score"),
        F.lit(0.0).alias("monthly_visits"),
        F.lit(None).cast("double").alias("organic_traffic"),
        F.lit(3.0).alias("organic_keywords"),
        F.lit("bulk-2.csv").alias("source_file"),
    )
    return first.unionByName(second)


def written_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Link rows with the source as an export might write it: some empty, blank, without host or without scheme."""
    c = F.col
    line = lambda n: (c("links_in_group") == n) & (c("domain_rating") % 3 == 0)
    written = (
        F.when(line(7), F.lit(""))
        .when(line(6), F.lit("  "))
        .when(line(5), F.lit("https:///lost/"))
        .when(line(4), F.lit("/only/a/path"))
        .when(line(3), F.substring(c("source_url"), 9, 1_000_000))
        .otherwise(c("source_url"))
    )
    return links(spark, sf_dir).withColumn("written_source", written)


def keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyword rows: every line item is a ranking of one competitor in one country.

    The customer is joined to the order, so no line item is exchanged by it, and what the line items take on from both is numbers:
    texts would make the exchange by part half as wide again.
    """
    c = F.col
    words = lambda *found: c("o_orderpriority").isin(*found)
    intents = (
        words("1-URGENT"),
        words("2-HIGH", "3-MEDIUM", "1-URGENT"),
        words("3-MEDIUM"),
        words("4-NOT SPECIFIED", "3-MEDIUM"),
    )
    order = (
        table(spark, sf_dir, "orders")
        .select("o_orderkey", "o_custkey", reduce(Column.__add__, [i.cast("int") * 2**n for n, i in enumerate(intents)]).alias("intents"))
        .join(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), c("o_custkey") == c("c_custkey"))
        .select("o_orderkey", (c("c_custkey") % 5).alias("buyer"), "c_nationkey", "intents")
    )
    ranked = dealt_by(table(spark, sf_dir, "lineitem"), "l_orderkey").join(order, c("l_orderkey") == c("o_orderkey"))
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    rows = with_sites(ranked, "l_partkey", spark, sf_dir).join(nation, c("c_nationkey") == c("n_nationkey"))
    intent = lambda n: c("intents").bitwiseAND(2**n) != 0
    return rows.select(
        F.concat(F.lit("k"), _text(F.least(c("buyer"), c("l_partkey") % 5))).alias("competitor_domain"),
        F.concat(
            c("p_name"), F.lit(" "), F.lower("p_type"), F.lit(" "), _text(c("p_partkey")),
            _pick(KEYWORD_TAILS, c("p_size") % len(KEYWORD_TAILS)),
        ).alias("keyword"),
        c("n_name").alias("country"),
        (c("p_brand") == "Brand#1").alias("is_branded"),
        intent(0).alias("is_navigational"),
        intent(1).alias("is_informational"),
        intent(2).alias("is_commercial"),
        intent(3).alias("is_transactional"),
        (c("p_size") * c("l_linenumber") * c("l_linenumber") * 6).cast("bigint").alias("volume"),
        F.floor(2 * c("l_quantity") * (1 + c("l_partkey") % 4) / 4).cast("bigint").alias("kd"),
        (F.abs("l_discount") * 20).alias("cpc"),
        F.floor(c("l_extendedprice") / 1000).cast("double").alias("current_traffic"),
        (c("l_linenumber") * 8).cast("bigint").alias("current_position"),
        F.when(c("l_quantity") == 50, "").otherwise(c("page_url")).alias("url"),
        line_order().alias("src_ord"),
    )


def page_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics per page from the parts that lead to it; pages with a query string are not measured."""
    c = F.col
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    n_pages = pages.agg(F.count(F.lit(1))).scalar()
    part = table(spark, sf_dir, "part").select(c("p_partkey").alias("l_partkey"), "p_name", "p_size")
    sums = (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_partkey")
        .agg(F.sum("l_quantity").alias("q"), F.count(F.lit(1)).alias("n"), F.sum(F.floor("l_extendedprice")).alias("v"))
        .join(part, "l_partkey")
        .groupBy((c("l_partkey") % n_pages).alias("page_id"))
        .agg(
            F.sum("q").alias("q"), F.sum("n").alias("n"), F.sum("v").alias("v"),
            F.max("p_name").alias("top_keyword"), F.max("p_size").alias("p_size"),
        )
    )
    measured = F.when(~F.contains(c("url"), F.lit("?")), F.lit(1)).otherwise(0)
    value = lambda name, kind: (F.coalesce(name, F.lit(0)) * measured).cast(kind)
    return pages.join(sums, "page_id", "left").select(
        hostname(c("url")).alias("competitor_domain"),
        hostname(c("url")).alias("domain"),
        c("url").alias("page_url"),
        value("q", "bigint").alias("current_traffic"),
        value("v", "double").alias("current_traffic_value"),
        value("n", "bigint").alias("current_keywords"),
        F.coalesce("p_size", F.lit(0)).cast("bigint").alias("current_ref_domains"),
        F.when(measured == 1, c("top_keyword")).alias("top_keyword"),
        F.coalesce(c("p_size") * 100, F.lit(0)).cast("bigint").alias("top_keyword_volume"),
        (c("page_id") % 30).cast("bigint").alias("top_keyword_position"),
    )


def sitemap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listed URLs: a sitemap holds no fragments, and names pages by https."""
    url = F.col("url")
    return table(spark, sf_dir, "pages").filter(~F.contains(url, F.lit("#"))).select(
        hostname(url).alias("domain"), F.regexp_replace(url, "^http://", "https://").alias("sitemap_url")
    )


def tree_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page metrics of the tree: pages and the parts offered below them, most of them without traffic."""
    c = F.col
    line = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(
        F.sum(F.when(c("l_quantity") > 48, c("l_quantity")).otherwise(0.0)).alias("q"), F.count(F.lit(1)).alias("n")
    )
    rows = sites(spark, sf_dir).join(line, c("p_partkey") == c("l_partkey"), "left")
    below = F.concat(
        F.regexp_replace(F.regexp_replace("page_url", r"[?#].*$", ""), "/$", ""), F.lit("/"),
        F.replace("p_name", F.lit(" "), F.lit("-")), F.lit("/"), _text(c("p_partkey")),
    )
    return rows.select(
        hostname(c("page_url")).alias("domain"),
        below.alias("metrics_url"),
        F.when(c("p_size") > 20, F.coalesce("q", F.lit(0.0))).otherwise(0.0).alias("traffic"),
        F.coalesce("n", F.lit(0)).cast("double").alias("keywords"),
        F.when(c("p_size") > 30, c("p_name")).alias("top_keyword"),
    )


def metrics_side(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measured URLs: every page without a tracking parameter."""
    c = F.col
    return page_metrics(spark, sf_dir).filter(~F.contains(c("page_url"), F.lit("utm_source"))).select(
        "domain",
        c("page_url").alias("metrics_url"),
        c("current_traffic").cast("double").alias("traffic"),
        c("current_keywords").cast("double").alias("keywords"),
        "top_keyword",
    )


def crawl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Current crawl: every page under the site its host belongs to."""
    return table(spark, sf_dir, "pages").select(hostname(F.col("url")).alias("site_id"), "url")


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshot from before the site moved its French and German pages to https."""
    c = F.col
    moved = c("url").rlike("/(fr|de)/")
    old = F.when(moved, F.regexp_replace("url", "^https://", "http://")).otherwise(c("url"))
    return (
        table(spark, sf_dir, "pages")
        .select(hostname(c("url")).alias("site_id"), page_url(old).alias("page_url"))
        .distinct()
        .withColumns(
            {
                "first_seen": F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"),
                "last_seen": F.lit("2024-02-01 00:00:00").cast("timestamp_ntz"),
            }
        )
    )


def slug_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shop pages of the suppliers, one per supplier and part sold, named after the part."""
    c = F.col
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type", "p_size")
    return (
        table(spark, sf_dir, "lineitem")
        .select("l_suppkey", "l_partkey")
        .distinct()
        .join(part, c("l_partkey") == c("p_partkey"))
        .select(
            c("l_suppkey").alias("site_id"),
            F.concat(
                F.lit("https://site"), _text(c("l_suppkey")), F.lit(".example/shop/"), _text(c("p_partkey")), F.lit("/"),
                F.when(c("p_size") == 1, F.lit("2024")).otherwise(
                    F.concat(F.replace("p_name", F.lit(" "), F.lit("-")), F.lit("_"), F.lower("p_type"))
                ),
                F.when(c("p_size") <= 25, ".html").otherwise("/"),
            ).alias("page_url"),
        )
        .distinct()
    )


def slug_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listed sites: suppliers with a positive balance."""
    c = F.col
    return table(spark, sf_dir, "supplier").filter(c("s_acctbal") > 0).select(
        c("s_suppkey").alias("site_id"),
        F.concat(F.lit("https://www.site"), _text(c("s_suppkey")), F.lit(".example/sitemap.xml")).alias("url"),
    )


def overview_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Traffic by day, one column per event type, as the text of a wide export."""
    c = F.col
    kinds = ("click", "error", "purchase", "signup", "view")
    return (
        table(spark, sf_dir, "events")
        .groupBy(F.date_format("ts", "yyyy-MM-dd").alias("date"))
        .agg(
            *[
                F.sum(F.when(c("event_type") == k, F.floor("value"))).cast("string").alias(k)
                for k in kinds
            ]
        )
    )


def robots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """robots.txt documents, one per page: pages with a query string name no sitemap."""
    c = F.col
    base = F.concat(F.lit("https://"), hostname(c("url")))
    return table(spark, sf_dir, "pages").select(
        "page_id",
        base.alias("site"),
        F.concat(
            F.lit("User-agent: *\nDisallow: /x\n"),
            F.when(F.contains(c("url"), F.lit("?")), "").otherwise(
                F.concat(F.lit("sitemap:  "), base, F.lit("/main.xml \nSitemap: "), base, path(c("url")), F.lit(".xml\n"))
            ),
        ).alias("body"),
    )


def sitemap_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sitemap documents: an index per host, one per language below it, leaves with the page URLs.

    The index also names itself, as broken sites do.
    """
    c = F.col
    page = table(spark, sf_dir, "pages").select(
        "url",
        F.concat(F.lit("https://"), hostname(c("url"))).alias("base"),
        F.regexp_extract(path(c("url")), "^/([a-z]+)/", 1).alias("lang"),
    )
    index = lambda *locs: F.concat(
        F.lit("<sitemapindex>"), *[F.concat(F.lit("<sitemap><loc>"), loc, F.lit("</loc></sitemap>")) for loc in locs], F.lit("</sitemapindex>")
    )
    root = F.concat(c("base"), F.lit("/sitemap.xml"))
    child = F.concat(c("base"), F.lit("/"), c("lang"), F.lit(".xml"))
    roots = page.select(root.alias("url"), index(child, root).alias("body")).distinct()
    leaves = page.select(
        child.alias("url"),
        F.concat(F.lit("<urlset><url><loc>"), c("url"), F.lit("</loc></url></urlset>")).alias("body"),
    )
    return roots.unionByName(leaves)


def prospects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prospect list: customers with a domain, some without a domain or an address."""
    c = F.col
    number = _text(c("c_custkey"))
    return table(spark, sf_dir, "customer").select(
        F.when(c("c_acctbal") < 0, F.lit(None)).otherwise(
            F.concat(F.lit("www.shop"), number, F.lit("."), F.lower("c_mktsegment"), F.lit(".example"))
        ).alias("domain"),
        F.when(c("c_mktsegment") == "BUILDING", F.lit(None))
        .when(c("c_mktsegment") == "MACHINERY", F.lit("  "))
        .otherwise(F.concat(F.lit("hello"), number, F.lit("@example.org")))
        .alias("email"),
    )


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of every document."""
    c = F.col
    return dealt(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).select(
        "doc_id", "source", F.explode(F.split(c("text"), r"[ \t\n\r]+")).alias("word")
    )

