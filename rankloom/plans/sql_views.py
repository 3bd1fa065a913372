"""SQL twins of :mod:`rankloom.plans.views` and of the URL functions, for the correctness check."""

from __future__ import annotations

import re

from rankloom.plans import views

_NAMES = re.compile(r"\b(?:v|f)_[a-z0-9_]+\b")


def quoted(value: object) -> str:
    return "'" + str(value).replace("'", "''") + "'"


def listed(values) -> str:
    return "[" + ", ".join(quoted(v) for v in values) + "]"


def grouped(values) -> str:
    return "(" + ", ".join(quoted(v) for v in values) + ")"


# --- expressions ----------------------------------------------------------------------------------------

_SCHEME = "'^([A-Za-z][A-Za-z0-9+.\\-]*):'"
_AUTH = "'^(?:[A-Za-z][A-Za-z0-9+.\\-]*:)?//([^/?#]*)'"
_PATH = "'^(?:[A-Za-z][A-Za-z0-9+.\\-]*:)?(?://[^/?#]*)?([^?#]*)'"


def authority(u: str) -> str:
    return f"regexp_extract({u}, {_AUTH}, 1)"


def path(u: str) -> str:
    return f"regexp_replace(regexp_extract({u}, {_PATH}, 1), ';[^/]*$', '')"


def query_text(u: str) -> str:
    return f"regexp_extract({u}, '^[^?#]*\\?([^#]*)', 1)"


def bare_host(u: str) -> str:
    return f"lower(regexp_replace(regexp_replace({authority(u)}, '^.*@', ''), ':.*$', ''))"


def hostname(u: str) -> str:
    full = f"(CASE WHEN contains({u}, '://') THEN {u} ELSE 'https://' || {u} END)"
    return f"regexp_replace(trim({bare_host(full)}, '.'), '^www\\.', '')"


def cut_slash(p: str) -> str:
    return f"(CASE WHEN {p} = '/' THEN {p} ELSE regexp_replace({p}, '/$', '') END)"


def canonical_key(u: str) -> str:
    low = f"lower(trim({u}))"
    decoded = f"url_decode({path(low)})"
    return f"replace({authority(low)}, 'www.', '') || {cut_slash(decoded)}"


def canonical_url(u: str) -> str:
    t = f"trim({u})"
    port = f"TRY_CAST(regexp_extract(regexp_replace({authority(t)}, '^.*@', ''), ':(.*)$', 1) AS INTEGER)"
    scheme = f"lower(regexp_extract({t}, {_SCHEME}, 1))"
    return (
        f"(CASE WHEN {scheme} = '' THEN 'https' ELSE {scheme} END) || '://' || regexp_replace({bare_host(t)}, '^www\\.', '')"
        f" || (CASE WHEN {port} > 0 THEN ':' || {port} ELSE '' END)"
        f" || (CASE WHEN {path(t)} = '' THEN '/' ELSE {cut_slash(path(t))} END)"
        f" || (CASE WHEN {query_text(t)} <> '' THEN '?' || {query_text(t)} ELSE '' END)"
    )


def page_url(u: str) -> str:
    p = f"regexp_replace(CASE WHEN {path(u)} = '' THEN '/' ELSE {path(u)} END, '/+', '/', 'g')"
    return f"lower(regexp_extract({u}, {_SCHEME}, 1)) || '://' || {authority(u)} || {cut_slash(p)}"


def first_directory(u: str) -> str:
    p = f"trim({path(u)}, '/')"
    return f"(CASE WHEN {p} = '' THEN 'Home' ELSE split_part({p}, '/', 1) END)"


def rounded(x: str, digits: int = 6) -> str:
    return f"CAST(round(CAST({x} AS DECIMAL(28,10)), {digits}) AS DOUBLE)"


def ratio(a: str, b: str) -> str:
    return f"(CASE WHEN {b} <> 0 THEN CAST({a} AS DOUBLE) / CAST({b} AS DOUBLE) ELSE 0.0 END)"


def rate(a: str, b: str, digits: int = 6) -> str:
    return rounded(ratio(a, b), digits)


def steps(x: str, op: str, table, otherwise) -> str:
    value = lambda v: quoted(v) if isinstance(v, str) else str(v)
    whens = " ".join(f"WHEN {x} {op} {bound} THEN {value(result)}" for bound, result in table)
    return f"(CASE {whens} ELSE {value(otherwise)} END)"


def big(x: str) -> str:
    return f"CAST({x} AS BIGINT)"


def total(x: str) -> str:
    return f"CAST(sum({x}) AS BIGINT)"


def count_where(test: str) -> str:
    return f"CAST(count(*) FILTER (WHERE {test}) AS BIGINT)"


# --- views ----------------------------------------------------------------------------------------------

_HOST = f"({listed(views.HOSTS)})[CAST(substr(p_brand, 7, 3) AS INTEGER)]"
_FOLDER = f"({listed(views.FOLDERS)})[(p_size + l_linenumber) % {len(views.FOLDERS)} + 1]"
_ANCHOR = f"({listed(views.ANCHORS)})[l_linenumber]"
_TAIL = f"({listed(views.KEYWORD_TAILS)})[p_size % {len(views.KEYWORD_TAILS)} + 1]"
_ORDER = (
    "struct_pack(o := l_orderkey, l := l_linenumber, p := l_partkey, s := l_suppkey, d := l_shipdate,"
    " e := l_extendedprice, q := l_quantity)"
)
_COMP = "CAST(least(l_suppkey % 7, l_partkey % 7) AS VARCHAR)"
_AUTHORITY = "floor(2 * l_quantity * (1 + l_partkey % 10) / 10)"
_PLACE = f"""(CASE WHEN p_size = 7 THEN '/img/a' || l_linenumber || '.png'
    WHEN p_size = 8 THEN '/static/x' || l_linenumber || (CASE WHEN l_linenumber <= 4 THEN '.css' ELSE '/' END)
    ELSE {_FOLDER} || page_path END)"""

VIEW_SQL = {
    "v_sites": f"""
        SELECT p_partkey, p_name, p_size, p_type, p_brand, url AS page_url, {path('url')} AS page_path,
            CASE WHEN {_HOST} IN {grouped(views.EXACT_HOSTS)} THEN {_HOST}
                ELSE 's' || p_partkey || '.' || (CASE WHEN {_HOST} = '' THEN {hostname('url')} ELSE {_HOST} END) END AS ref_domain
        FROM part JOIN pages ON page_id = p_partkey % (SELECT count(*) FROM pages)""",
    "v_links": f"""
        SELECT 'comp' || {_COMP} || '.example' AS competitor_domain, ref_domain,
            'https://' || ref_domain || {_PLACE} AS source_url,
            'https://' || ref_domain || {_PLACE} AS ref_url,
            'https://comp' || {_COMP} || '.example/p/' || (l_orderkey % 50) || '/' AS target_url,
            p_name AS source_title, {_ANCHOR} AS anchor,
            CASE WHEN l_linenumber = 1 THEN '{{}}' WHEN l_linenumber = 7 THEN 'not json'
                WHEN l_linenumber <= 4 THEN '{{"Link anchor": "' || {_ANCHOR} || '"}}'
                ELSE '{{"Anchor": "' || {_ANCHOR} || '"}}' END AS raw_json,
            {big(_AUTHORITY)} AS domain_rating, CAST({_AUTHORITY} AS DOUBLE) AS page_ascore,
            {big("CASE WHEN l_partkey % 5 = 0 THEN 0 ELSE (CAST(floor(l_extendedprice) AS BIGINT) % 60) * ([1, 10, 100, 1000])[l_partkey % 4 + 1] END")} AS page_traffic,
            {big('l_linenumber')} AS links_in_group, {big('l_linenumber')} AS external_links,
            CASE WHEN p_size <= 10 THEN 'Unknown' ELSE 'Web > ' || upper(substr(p_type, 1, 1)) || lower(substr(p_type, 2)) END AS page_type,
            CASE WHEN p_size <= 5 THEN '' ELSE split_part(p_name, ' ', 1) || ' > Parts' END AS page_category,
            NOT (l_returnflag = 'R' OR l_partkey % 6 = 0) AS is_dofollow,
            (l_returnflag = 'R' OR l_partkey % 6 = 0) AS is_nofollow,
            (l_returnflag = 'A' AND l_linenumber = 1) AS is_sponsored,
            (l_returnflag = 'N' AND l_linenumber = 7) AS is_ugc,
            (l_linenumber = 4 OR l_partkey % 17 = 0) AS is_sitewide,
            ((l_linenumber = 6 AND l_partkey % 13 = 0) OR l_partkey % 11 = 0) AS is_spam,
            (l_linestatus = 'F' OR l_partkey % 9 = 0) AS is_lost,
            (l_returnflag = 'N' AND l_linestatus = 'O') AS is_new,
            l_quantity > 25 AS is_text, l_linenumber = 2 AS is_image, l_linenumber = 3 AS is_form, l_linenumber = 5 AS is_frame,
            CASE WHEN l_quantity < 3 THEN '' ELSE strftime(l_shipdate, '%Y-%m-%d') END AS first_seen,
            strftime(l_shipdate + INTERVAL 30 DAY, '%Y-%m-%d') AS last_seen,
            'backlinks-' || l_returnflag || '.csv' AS src_file, {_ORDER} AS src_ord
        FROM lineitem JOIN v_sites ON l_partkey = p_partkey""",
    "f_links_a": """
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY competitor_domain, ref_domain ORDER BY src_ord) AS rn FROM v_links) WHERE rn = 1""",
    "v_fingerprints": """
        SELECT *, sha1(lower(concat_ws('|', source_url, target_url, anchor, CAST(is_nofollow AS INT), CAST(is_sponsored AS INT),
            CAST(is_ugc AS INT), CAST(is_text AS INT), CAST(is_frame AS INT), CAST(is_form AS INT), CAST(is_image AS INT)))) AS link_fingerprint
        FROM v_links""",
    "f_links_b": """
        SELECT *, NOT (is_nofollow OR is_sponsored OR is_ugc) AS is_follow,
            CASE WHEN is_image THEN 'Image' WHEN is_form THEN 'Form' WHEN is_frame THEN 'Frame' WHEN is_text THEN 'Text' ELSE 'Unknown' END AS kind,
            CASE WHEN page_ascore BETWEEN 0 AND 20 THEN '0-20' WHEN page_ascore BETWEEN 21 AND 40 THEN '21-40'
                WHEN page_ascore BETWEEN 41 AND 60 THEN '41-60' WHEN page_ascore BETWEEN 61 AND 80 THEN '61-80'
                WHEN page_ascore BETWEEN 81 AND 100 THEN '81-100' WHEN page_ascore > 100 THEN '81-100' ELSE '0-20' END AS band
        FROM (SELECT *, row_number() OVER (PARTITION BY competitor_domain, link_fingerprint ORDER BY src_ord) AS rn FROM v_fingerprints) WHERE rn = 1""",
    "v_enrichment": """
        SELECT ref_domain AS domain, CAST(p_partkey % 101 AS DOUBLE) AS authority_score, CAST(p_partkey * 11 AS DOUBLE) AS monthly_visits,
            CASE WHEN p_partkey % 2 = 1 THEN CAST(p_partkey * 37 AS DOUBLE) END AS organic_traffic,
            CAST(p_partkey % 7 AS DOUBLE) AS organic_keywords, 'bulk-1.csv' AS source_file
        FROM v_sites WHERE p_size > 15
        UNION ALL
        SELECT ref_domain, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE CAST(p_partkey % 90 AS DOUBLE) END, 0.0, NULL, 3.0, 'bulk-2.csv'
        FROM v_sites WHERE p_size > 35""",
    "f_enrichment": """
        SELECT domain, max(authority_score) AS authority_score, max(monthly_visits) AS monthly_visits, max(organic_traffic) AS organic_traffic,
            max(organic_keywords) AS organic_keywords, string_agg(DISTINCT source_file, ', ' ORDER BY source_file) AS source_files
        FROM v_enrichment GROUP BY domain""",
    "v_keywords": f"""
        SELECT 'k' || CAST(least(c_custkey % 5, l_partkey % 5) AS VARCHAR) AS competitor_domain,
            p_name || ' ' || lower(p_type) || ' ' || p_partkey || {_TAIL} AS keyword, n_name AS country,
            p_brand = 'Brand#1' AS is_branded, o_orderpriority = '1-URGENT' AS is_navigational,
            o_orderpriority IN ('2-HIGH', '3-MEDIUM', '1-URGENT') AS is_informational, o_orderpriority = '3-MEDIUM' AS is_commercial,
            o_orderpriority IN ('4-NOT SPECIFIED', '3-MEDIUM') AS is_transactional,
            {big('p_size * l_linenumber * l_linenumber * 6')} AS volume,
            {big('floor(2 * l_quantity * (1 + l_partkey % 4) / 4)')} AS kd, abs(l_discount) * 20 AS cpc,
            CAST(floor(l_extendedprice / 1000) AS DOUBLE) AS current_traffic, {big('l_linenumber * 8')} AS current_position,
            CASE WHEN l_quantity = 50 THEN '' ELSE page_url END AS url, {_ORDER} AS src_ord
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
            JOIN v_sites ON l_partkey = p_partkey""",
    "f_keywords": """
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY competitor_domain, keyword, country ORDER BY src_ord) AS rn FROM v_keywords) WHERE rn = 1""",
    "v_page_sums": """
        SELECT l_partkey % (SELECT count(*) FROM pages) AS page_id, sum(l_quantity) AS q, count(*) AS n, sum(floor(l_extendedprice)) AS v,
            max(p_name) AS top_keyword, max(p_size) AS p_size
        FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1""",
    "v_pages": f"""
        SELECT {hostname('url')} AS competitor_domain, {hostname('url')} AS domain, url AS page_url,
            {big("CASE WHEN contains(url, '?') THEN 0 ELSE coalesce(q, 0) END")} AS current_traffic,
            CAST(CASE WHEN contains(url, '?') THEN 0 ELSE coalesce(v, 0) END AS DOUBLE) AS current_traffic_value,
            {big("CASE WHEN contains(url, '?') THEN 0 ELSE coalesce(n, 0) END")} AS current_keywords,
            {big('coalesce(p_size, 0)')} AS current_ref_domains,
            CASE WHEN NOT contains(url, '?') THEN top_keyword END AS top_keyword,
            {big('coalesce(p_size * 100, 0)')} AS top_keyword_volume, {big('pages.page_id % 30')} AS top_keyword_position
        FROM pages LEFT JOIN v_page_sums ON pages.page_id = v_page_sums.page_id""",
    "f_pages": f"""
        SELECT *, CASE WHEN trim({path('page_url')}, '/') = '' THEN 'Homepage'
            WHEN dir IN ('blog', 'article', 'news', 'guides', 'learn') THEN 'Blog & Content'
            WHEN dir IN ('features', 'product', 'tour') THEN 'Product Features'
            WHEN dir IN ('tools', 'calculators', 'generator') THEN 'Free Tools (Engine)'
            WHEN dir IN ('pricing', 'plans') THEN 'Pricing'
            WHEN dir IN ('glossary', 'dictionary', 'wiki') THEN 'Glossary (Programmatic)'
            WHEN dir IN ('integrations', 'apps', 'plugins') THEN 'Integrations Ecosystem'
            WHEN dir IN ('vs', 'compare', 'alternatives') THEN 'Comparison Pages'
            ELSE 'Other (/' || dir || '/)' END AS page_category
        FROM (SELECT *, lower(split_part(trim({path('page_url')}, '/'), '/', 1)) AS dir FROM v_pages)""",
    "v_sitemap": f"""
        SELECT {hostname('url')} AS domain, regexp_replace(url, '^http://', 'https://') AS sitemap_url FROM pages WHERE NOT contains(url, '#')""",
    "v_metrics": """
        SELECT domain, page_url AS metrics_url, CAST(current_traffic AS DOUBLE) AS traffic, CAST(current_keywords AS DOUBLE) AS keywords, top_keyword
        FROM v_pages WHERE NOT contains(page_url, 'utm_source')""",
    "v_tree_metrics": f"""
        SELECT {hostname('page_url')} AS domain,
            regexp_replace(regexp_replace(page_url, '[?#].*$', ''), '/$', '') || '/' || replace(p_name, ' ', '-') || '/' || p_partkey AS metrics_url,
            CASE WHEN p_size > 20 THEN coalesce(q, 0.0) ELSE 0.0 END AS traffic, CAST(coalesce(n, 0) AS DOUBLE) AS keywords,
            CASE WHEN p_size > 30 THEN p_name END AS top_keyword
        FROM v_sites LEFT JOIN (SELECT l_partkey, sum(CASE WHEN l_quantity > 48 THEN l_quantity ELSE 0 END) AS q, count(*) AS n FROM lineitem GROUP BY 1)
            ON l_partkey = p_partkey""",
}


def _merged(metrics: str) -> str:
    return f"""
        SELECT coalesce(s.domain, m.domain) AS domain, coalesce(s.canonical_key, m.canonical_key) AS canonical_key,
            coalesce(metrics_url, sitemap_url) AS final_url, coalesce(traffic, 0.0) AS traffic, coalesce(keywords, 0.0) AS keywords,
            top_keyword, sitemap_url IS NOT NULL AS in_sitemap
        FROM (SELECT domain, {canonical_key('sitemap_url')} AS canonical_key, min(sitemap_url) AS sitemap_url FROM v_sitemap GROUP BY 1, 2) s
        FULL OUTER JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY domain, canonical_key ORDER BY traffic DESC, metrics_url) AS rn
            FROM (SELECT *, {canonical_key('metrics_url')} AS canonical_key FROM {metrics})) WHERE rn = 1) m
        ON s.domain = m.domain AND s.canonical_key = m.canonical_key"""


VIEW_SQL |= {
    "f_merged": _merged("v_metrics"),
    "f_merged_tree": _merged("v_tree_metrics"),
    "v_leaf_rows": f"""
        SELECT *, list_concat([replace({authority('final_url')}, 'www.', '')],
            CASE WHEN trim({path('final_url')}, '/') = '' THEN [] ELSE string_split(trim({path('final_url')}, '/'), '/') END) AS parts
        FROM f_merged_tree""",
    "v_leaves": """
        SELECT * FROM (SELECT *, array_to_string(parts, '/') AS leaf_id,
            row_number() OVER (PARTITION BY array_to_string(parts, '/') ORDER BY traffic DESC, final_url) AS rn FROM v_leaf_rows) WHERE rn = 1""",
    "v_prefixes": """
        SELECT leaf_id, final_url, traffic, keywords, coalesce(top_keyword, '') AS kw, in_sitemap, len(parts) AS leaf_depth, d AS depth,
            array_to_string(parts[1:d], '/') AS node_id
        FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS d FROM v_leaves)""",
    "v_best": """
        SELECT node_id, kw FROM (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY traffic DESC, leaf_depth, leaf_id) AS rn
            FROM v_prefixes WHERE kw <> '') WHERE rn = 1""",
    "f_tree": """
        SELECT p.node_id, CAST(any_value(p.depth) AS INTEGER) AS depth, CAST(sum(p.traffic) AS DOUBLE) AS traffic, count(*) AS n_pages,
            CAST(sum(p.keywords) AS DOUBLE) AS keywords, coalesce(any_value(b.kw), '') AS best_keyword,
            max(CASE WHEN p.depth = p.leaf_depth THEN final_url END) AS page_url,
            bool_or(CASE WHEN p.depth = p.leaf_depth THEN in_sitemap END) AS page_in_sitemap,
            list_last(string_split(p.node_id, '/')) AS label,
            CASE WHEN any_value(p.depth) > 1 THEN array_to_string(string_split(p.node_id, '/')[1:-2], '/') ELSE '' END AS parent_id
        FROM v_prefixes p LEFT JOIN v_best b ON p.node_id = b.node_id GROUP BY p.node_id""",
    "v_crawl": f"""
        SELECT DISTINCT {hostname('url')} AS site_id, {page_url('url')} AS page_url FROM pages""",
    "v_history": f"""
        SELECT DISTINCT site_id, {page_url('old')} AS page_url, TIMESTAMP '2024-01-01 00:00:00' AS first_seen, TIMESTAMP '2024-02-01 00:00:00' AS last_seen
        FROM (SELECT {hostname('url')} AS site_id,
            CASE WHEN contains(url, '/fr/') OR contains(url, '/de/') THEN regexp_replace(url, '^https://', 'http://') ELSE url END AS old FROM pages)""",
    "v_slug_pages": """
        SELECT DISTINCT l_suppkey AS site_id, 'https://site' || l_suppkey || '.example/shop/' || p_partkey || '/'
            || (CASE WHEN p_size = 1 THEN '2024' ELSE replace(p_name, ' ', '-') || '_' || lower(p_type) END)
            || (CASE WHEN p_size <= 25 THEN '.html' ELSE '/' END) AS page_url, p_name, p_type, p_size
        FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "v_slug_sites": """
        SELECT s_suppkey AS site_id, 'site' || s_suppkey || '.example' AS domain FROM supplier WHERE s_acctbal > 0""",
    "v_slugs": """
        SELECT replace(p_name, '-', ' ') || ' ' || lower(p_type) AS keyword, coalesce(domain, 'Unknown') AS domain, page_url
        FROM v_slug_pages LEFT JOIN v_slug_sites USING (site_id) WHERE p_size <> 1""",
    "v_robots": f"""
        SELECT 'https://' || {hostname('url')} AS site, contains(url, '?') AS silent, {path('url')} AS p FROM pages""",
    "v_site_pages": f"""
        SELECT 'https://' || {hostname('url')} AS base, regexp_extract({path('url')}, '^/([a-z]+)/', 1) AS lang, url FROM pages""",
    "f_measures": f"""
        SELECT ref_domain AS domain, count(DISTINCT competitor_domain) AS alpha, count(*) AS backlinks, {count_where('NOT is_lost')} AS live_backlinks,
            count(DISTINCT source_url) AS source_pages, count(DISTINCT target_url) AS target_pages, max(page_ascore) AS max_page_as,
            string_agg(DISTINCT competitor_domain, ', ' ORDER BY competitor_domain) AS competitors,
            {ratio(count_where('NOT is_lost'), 'count(*)')} AS live_rate, {ratio('sum(page_ascore)', 'count(*)')} AS avg_page_as,
            {ratio('sum(page_ascore) FILTER (WHERE NOT is_lost)', count_where('NOT is_lost'))} AS live_avg_page_as,
            {ratio(count_where('NOT is_lost AND page_ascore >= 40'), count_where('NOT is_lost'))} AS high_page_as_rate,
            {ratio(count_where('is_follow'), 'count(*)')} AS follow_rate,
            {ratio(count_where('NOT is_lost AND is_follow'), count_where('NOT is_lost'))} AS live_follow_rate,
            {ratio(count_where('is_sitewide'), 'count(*)')} AS sitewide_rate, {ratio(count_where('is_sponsored'), 'count(*)')} AS sponsored_rate,
            {ratio(count_where('is_ugc'), 'count(*)')} AS ugc_rate, {ratio('sum(external_links)', 'count(*)')} AS avg_external_links,
            coalesce(min(nullif(first_seen, '')), '') AS earliest_first_seen, coalesce(max(nullif(last_seen, '')), '') AS latest_last_seen
        FROM f_links_b GROUP BY 1""",
    "v_pairs_b": """
        SELECT ref_domain AS domain, string_agg(competitor_domain || ':' || n, ', ' ORDER BY competitor_domain) AS per_competitor
        FROM (SELECT ref_domain, competitor_domain, count(*) AS n FROM f_links_b GROUP BY 1, 2) GROUP BY 1""",
    "v_mix": """
        SELECT domain, string_agg(kind || ':' || n, ', ' ORDER BY n DESC, list_position(['Image', 'Form', 'Frame', 'Text', 'Unknown'], kind)) AS type_mix
        FROM (SELECT ref_domain AS domain, kind, count(*) AS n FROM f_links_b GROUP BY 1, 2) GROUP BY 1""",
}


def with_views(body: str) -> str:
    """``body`` with every view it needs written out as a common table expression."""
    order: list[str] = []

    def visit(text: str) -> None:
        for name in _NAMES.findall(text):
            if name in VIEW_SQL and name not in order:
                visit(VIEW_SQL[name])
                if name not in order:
                    order.append(name)

    visit(body)
    if not order:
        return body.strip()
    heads = ",\n".join(f"{name} AS MATERIALIZED ({VIEW_SQL[name]})" for name in order)
    return f"WITH {heads}\n{body.strip()}"
