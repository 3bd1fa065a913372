"""SQL twins of the registered queries, written for a plain SQL engine over the same tables."""

from __future__ import annotations

from rankloom.functions import rules, scores
from rankloom.operators import action_queue
from rankloom.plans import catalog
from rankloom.plans.sql_views import (
    big,
    canonical_key,
    canonical_url,
    count_where,
    first_directory,
    grouped,
    hostname,
    listed,
    page_url,
    path,
    quoted,
    rate,
    ratio,
    rounded,
    steps,
    total,
    with_views,
)
from rankloom.plans.views import COMPETITOR_NAMES

ORACLES: dict[str, str] = {}


def oracle(name: str, body: str) -> None:
    ORACLES[name] = with_views(body)


# --- vendor A links -------------------------------------------------------------------------------------

oracle(
    "first_wins_links",
    "SELECT competitor_domain, ref_domain, ref_url, target_url, domain_rating, src_ord.o, src_ord.l FROM f_links_a",
)

_DR = {"0_20": "<= 20", "20_40": "BETWEEN 21 AND 40", "40_60": "BETWEEN 41 AND 60", "60_80": "BETWEEN 61 AND 80", "80_100": "> 80"}


def _profile_columns(prefix: str, scope: str) -> str:
    columns = [
        f"{count_where(scope)} AS {prefix}domains",
        f"{total(f'CASE WHEN {scope} THEN links_in_group ELSE 0 END')} AS {prefix}links",
        f"{count_where(f'{scope} AND is_dofollow')} AS {prefix}dofollow",
        f"{count_where(f'{scope} AND is_spam')} AS {prefix}spam",
        *[f"{count_where(f'{scope} AND domain_rating {test}')} AS {prefix}dr_{band}" for band, test in _DR.items()],
    ]
    return ", ".join(columns)


_PROFILE = f"""SELECT competitor_domain, {_profile_columns('', 'true')}, {_profile_columns('live_', 'NOT is_lost')}
    FROM f_links_a GROUP BY 1"""
oracle("competitor_profile", _PROFILE)


def _band_shares(prefix: str) -> str:
    high = f"{prefix}dr_40_60 + {prefix}dr_60_80 + {prefix}dr_80_100"
    shares = [f"{rate(high, prefix + 'domains')} AS {prefix}high_rating_share"]
    shares += [f"{rate(f'{prefix}dr_{b}', prefix + 'domains')} AS {prefix}dr_{b}_share" for b in _DR]
    return ", ".join(shares)


oracle(
    "competitor_bands",
    f"""SELECT competitor_domain, {rate('domains - live_domains', 'domains')} AS lost_rate,
        {rate('live_dofollow', 'live_domains')} AS live_dofollow_share, {rate('links', 'domains')} AS links_per_domain,
        {rate('live_links', 'live_domains')} AS live_links_per_domain, {rate('dofollow', 'domains')} AS dofollow_share,
        {rate('spam', 'domains')} AS spam_share, {rate('live_spam', 'live_domains')} AS live_spam_share,
        {_band_shares('')}, {_band_shares('live_')}
    FROM ({_PROFILE})""",
)
_YEARLY = f"""SELECT competitor_domain, substr(first_seen, 1, 4) AS year, count(*) AS n_new, {count_where('NOT is_lost')} AS n_new_live
    FROM f_links_a WHERE first_seen <> '' GROUP BY 1, 2"""
oracle("links_by_year", _YEARLY)


def _grid(counts: str, measures) -> str:
    filled = ", ".join(f"{big(f'coalesce({m}, 0)')} AS {m}" for m in measures)
    sums = ", ".join(
        f"{big(f'sum({m}) OVER (PARTITION BY competitor_domain ORDER BY year)')} AS cum_{m}" for m in measures
    )
    return f"""SELECT *, {sums} FROM (
        SELECT c.competitor_domain, y.year, {filled}
        FROM (SELECT DISTINCT competitor_domain FROM ({counts})) c CROSS JOIN (SELECT DISTINCT year FROM ({counts})) y
        LEFT JOIN ({counts}) n ON n.competitor_domain = c.competitor_domain AND n.year = y.year)"""


oracle("cumulative_by_year", _grid(_YEARLY, ["n_new", "n_new_live"]))

_OVERLAP = f"""SELECT ref_domain, count(DISTINCT competitor_domain) AS alpha, {total('links_in_group')} AS total_links,
    greatest(max(domain_rating), 0) AS max_dr, greatest(max(page_traffic), 0) AS max_traffic,
    bool_or(is_dofollow) AS any_dofollow, bool_and(is_spam) AS all_spam FROM f_links_a GROUP BY 1"""
oracle("domain_overlap", _OVERLAP)

_MATRIX = f"""SELECT ref_domain, count(DISTINCT competitor_domain) AS alpha, {total('links_in_group')} AS total_links,
    greatest(max(domain_rating), 0) AS max_dr, greatest(max(page_traffic), 0) AS max_traffic,
    coalesce(min(CASE WHEN page_category <> '' THEN split_part(page_category, ' > ', 1) END), 'General B2B') AS industry,
    coalesce(min(CASE WHEN page_type <> 'Unknown' THEN split_part(page_type, ' > ', 2) END), 'Blog/Article') AS content_format,
    string_agg(DISTINCT competitor_domain, ', ' ORDER BY competitor_domain) AS shared_by,
    bool_and(is_spam) AS is_spam, bool_or(is_dofollow) AS is_dofollow,
    string_agg(DISTINCT detail, chr(10) ORDER BY detail) AS link_refs
    FROM (SELECT *, '[' || competitor_domain || '] ' || ref_url || '  --['
        || (CASE WHEN starts_with(raw_json, '{{"Anchor"') AND anchor <> '' THEN anchor ELSE '无锚文本' END) || ']-->  ' || target_url AS detail FROM f_links_a)
    GROUP BY 1"""
oracle("overlap_matrix", _MATRIX)
oracle(
    "overlap_matrix_topk",
    f"""SELECT ref_domain, alpha, total_links, max_dr, max_traffic, is_spam, is_dofollow FROM ({_MATRIX})
        ORDER BY is_spam, is_dofollow DESC, alpha DESC, max_dr DESC, max_traffic DESC, ref_domain LIMIT 100""",
)
oracle(
    "overlap_details",
    f"""SELECT alpha, competitor_domain, l.ref_domain, ref_url, target_url
        FROM f_links_a l JOIN ({_OVERLAP}) o ON l.ref_domain = o.ref_domain""",
)
_brief = (
    quoted(rules.BRIEF_TEXT.replace("{keyword}", catalog.BRIEF_KEYWORD))
    .replace("{industry}", "' || industry || '")
    .replace("{format}", "' || content_format || '")
    .replace("{rating}", "' || max_dr || '")
)
oracle(
    "content_briefs",
    f"""SELECT ref_domain AS target_domain, alpha AS overlap_alpha_score, max_dr AS domain_rating, {_brief} AS agent_prompt
        FROM ({_MATRIX})""",
)


def _anchor(none: str) -> str:
    return f"""(CASE WHEN NOT json_valid(raw_json) THEN '未知' WHEN raw_json = '{{}}' OR anchor = '' THEN '{none}' ELSE anchor END)"""


def _domain_case(domain: str, table) -> str:
    whens = " ".join(
        f"""WHEN len(list_filter({listed(patterns)}, lambda p: CASE WHEN contains(p, '.')
            THEN {domain} = p OR ends_with({domain}, '.' || p) ELSE contains({domain}, p) END)) > 0 THEN {quoted(category)}"""
        for category, patterns in table.items()
    )
    return f"(CASE {whens} END)"


def _text_case(text: str, table) -> str:
    whens = " ".join(
        f"WHEN len(list_filter({listed(patterns)}, lambda p: contains(lower({text}), p))) > 0 THEN {quoted(category)}"
        for category, patterns in table.items()
    )
    return f"(CASE {whens} END)"


def _stats(url_types, none: str) -> str:
    anchor = _anchor(none)
    return f"""SELECT s.*, u.url_type, a.anchor_intent, p.links_text FROM (
        SELECT ref_domain, count(DISTINCT competitor_domain) AS alpha, greatest(max(domain_rating), 0) AS max_dr,
            greatest(max(page_traffic), 0) AS max_traffic, bool_or(is_dofollow) AS any_dofollow, bool_or(is_spam) AS any_spam,
            string_agg(DISTINCT detail, chr(10) || chr(10) ORDER BY detail) AS example_links
        FROM (SELECT *, '[' || competitor_domain || '] ' || ref_url || ' ---> ' || target_url || ' (锚文本: ' || {anchor} || ')' AS detail FROM f_links_a)
        GROUP BY 1) s
    LEFT JOIN (SELECT ref_domain, url_type FROM (SELECT ref_domain, t AS url_type, row_number() OVER (PARTITION BY ref_domain ORDER BY src_ord) AS rn
        FROM (SELECT *, {_text_case('ref_url', url_types)} AS t FROM f_links_a) WHERE t IS NOT NULL) WHERE rn = 1) u ON u.ref_domain = s.ref_domain
    LEFT JOIN (SELECT ref_domain, anchor_intent FROM (SELECT ref_domain, t AS anchor_intent, row_number() OVER (PARTITION BY ref_domain ORDER BY src_ord) AS rn
        FROM (SELECT *, {_text_case(anchor, rules.ANCHOR_INTENTS)} AS t FROM f_links_a) WHERE t IS NOT NULL) WHERE rn = 1) a ON a.ref_domain = s.ref_domain
    LEFT JOIN (SELECT ref_domain, '总计:' || sum(n) || ' (' || string_agg(competitor_domain || ':' || n, ', ' ORDER BY competitor_domain) || ')' AS links_text
        FROM (SELECT ref_domain, competitor_domain, sum(links_in_group) AS n FROM f_links_a GROUP BY 1, 2) GROUP BY 1) p ON p.ref_domain = s.ref_domain"""


_STATS1 = _stats(rules.URL_TYPES_V1, rules.NO_ANCHOR_V1)
_STATS2 = _stats(rules.URL_TYPES_V2, rules.NO_ANCHOR)
_TYPED1 = f"""SELECT *, coalesce({_domain_case('lower(ref_domain)', rules.LINK_TYPES_V1)}, url_type, {quoted(rules.DEFAULT_TYPE_V1)}) AS link_type
    FROM ({_STATS1})"""
_DOMAIN2 = "replace(lower(ref_domain), 'www.', '')"
_WORDS2 = {k: v for k, v in rules.LINK_TYPES_V2.items() if not any("." in p for p in v)}
_TYPED2 = f"""SELECT * EXCLUDE (domain_type), coalesce(domain_type, url_type, 'General Blog') AS link_type,
        CASE WHEN domain_type IN {grouped(_WORDS2)} THEN 90 WHEN domain_type IS NOT NULL THEN 100 WHEN url_type IS NOT NULL THEN 80 ELSE 50 END AS confidence_pct
    FROM (SELECT * REPLACE (coalesce(anchor_intent, 'Unknown') AS anchor_intent), {_domain_case(_DOMAIN2, rules.LINK_TYPES_V2)} AS domain_type FROM ({_STATS2}))"""
oracle("link_type_v1", f"SELECT ref_domain, link_type FROM ({_TYPED1})")
oracle("link_type_v2", f"SELECT ref_domain, link_type, confidence_pct, anchor_intent FROM ({_TYPED2})")

_POINTS1 = f"""{steps('alpha', '>=', scores.OVERLAP_STEPS, 15)} * 0.35 + {steps('max_dr', '>=', scores.RATING_STEPS, 20)} * 0.30
    + {steps('max_traffic', '>=', scores.TRAFFIC_STEPS_V1, 20)} * 0.15 + CASE WHEN any_dofollow THEN 20 ELSE 0 END"""
_POINTS2 = f"""{steps('alpha', '>=', scores.OVERLAP_STEPS, 15)} * 0.15 + {steps('max_dr', '>=', scores.RATING_STEPS, 20)} * 0.40
    + CASE WHEN max_traffic = 0 THEN 0 WHEN max_traffic < 50 THEN 70 WHEN max_traffic < 500 THEN 80 WHEN max_traffic < 5000 THEN 90 ELSE 100 END * 0.25
    + CASE WHEN any_dofollow THEN 20 ELSE 0 END + CASE WHEN max_traffic > 0 THEN 10 ELSE 0 END"""
_SCORE1 = f"(CASE WHEN any_spam THEN -100.0 ELSE {rounded(_POINTS1, 1)} END)"
_SCORE2 = f"(CASE WHEN any_spam THEN -100.0 ELSE least({rounded(_POINTS2, 1)}, 100.0) END)"


def _scored(typed: str, score: str) -> str:
    return f"SELECT *, CAST({score} AS DOUBLE) AS auto_score FROM ({typed})"


_PRIORITY1 = f"""CASE WHEN auto_score >= 80 THEN 'P0 (核心狙击)' WHEN auto_score >= 60 THEN 'P1 (重点跟进)'
    WHEN auto_score >= 40 THEN 'P2 (日常铺垫)' WHEN auto_score > 0 THEN 'P3 (长尾观察)' ELSE '🗑️ SPAM (直接放弃)' END"""
_MEASURES = "ref_domain, alpha, max_dr, max_traffic, any_dofollow, any_spam, auto_score"
oracle("queue_score_v1", f"SELECT {_MEASURES}, {_PRIORITY1} AS priority FROM ({_scored(_STATS1, _SCORE1)})")
oracle("queue_score_v2", f"SELECT {_MEASURES} FROM ({_scored(_STATS2, _SCORE2)})")
_action1 = " ".join(
    f"WHEN {' OR '.join(f'contains(link_type, {quoted(k)})' for k in keys)} THEN {quoted(action.format(brand=catalog.BRAND))}"
    for keys, action in rules.ACTIONS_V1
)


def _blank(names) -> str:
    return ", ".join(f"'' AS {n}" for n in names)


oracle(
    "queue_v1",
    f"""SELECT {_PRIORITY1} AS priority, ref_domain, auto_score, link_type,
        CASE {_action1} ELSE {quoted(rules.DEFAULT_ACTION_V1)} END AS action, alpha, links_text, max_dr, max_traffic, any_dofollow, any_spam, example_links,
        {_blank(['ai_relevance', 'ai_content', 'ai_difficulty', 'human_difficulty', 'email', 'contact_url'])}, '未开始 (Not Started)' AS status,
        {rounded('auto_score * 0.8', 4)} AS final_score
    FROM ({_scored(_TYPED1, _SCORE1)})""",
)
_TIERED = f"""SELECT *, CASE WHEN any_spam OR (max_dr < 10 AND max_traffic = 0) THEN 'trash'
        WHEN link_type IN {grouped(rules.BATCHABLE_TYPES)} OR max_dr < 40 THEN 'C'
        WHEN link_type IN {grouped(rules.TOP_TIER_TYPES)} THEN 'A' ELSE 'B' END AS tier FROM ({_scored(_TYPED2, _SCORE2)})"""
_TIER_COLUMNS = f"""CASE tier WHEN 'A' THEN 1 WHEN 'B' THEN 2 WHEN 'C' THEN 3 ELSE 4 END AS tier_rank,
    CASE tier WHEN 'A' THEN '🔴 A类 (核心狙击)' WHEN 'B' THEN '🟡 B类 (半自动)' WHEN 'C' THEN '🔵 C类 (全自动批量)' ELSE '🗑️ SPAM/废弃' END AS tier_label,
    link_type || (CASE WHEN tier = 'C' AND link_type NOT IN {grouped(rules.BATCHABLE_TYPES)} THEN ' (低权重降级)' ELSE '' END) || ' (' || confidence_pct || '%)' AS type_label,
    CASE WHEN tier = 'trash' THEN {quoted(rules.ACTIONS_V2['trash'])}
        WHEN tier = 'C' AND link_type IN {grouped(rules.BATCHABLE_TYPES)} THEN {quoted(rules.ACTIONS_V2['C_batch'])}
        WHEN tier = 'C' THEN {quoted(rules.ACTIONS_V2['C_small'])} WHEN tier = 'B' THEN {quoted(rules.ACTIONS_V2['B'])}
        WHEN link_type = 'App Marketplace' THEN {quoted(rules.ACTIONS_V2['A_app'])} WHEN link_type = 'Media' THEN {quoted(rules.ACTIONS_V2['A_media'])}
        ELSE {quoted(rules.ACTIONS_V2['A_other'])} END AS action"""
oracle("tier_v2", f"SELECT ref_domain, tier, {_TIER_COLUMNS} FROM ({_TIERED})")
oracle(
    "queue_v2",
    f"""SELECT {_TIER_COLUMNS}, ref_domain, auto_score, alpha, links_text, max_dr, max_traffic, any_dofollow, any_spam, example_links,
        {_blank(['ai_relevance', 'ai_content', 'ai_difficulty', 'email', 'entry_url'])}, 'Pending' AS review, '未开始 (Not Started)' AS status,
        {rounded('auto_score * 0.85', 4)} AS final_score
    FROM ({_TIERED})""",
)
_manual = "(CASE WHEN max_dr >= 30 THEN CAST(max_dr % 50 AS DOUBLE) END)"
_hard = "(CASE WHEN alpha >= 3 THEN CAST(alpha AS DOUBLE) * 10 END)"
oracle(
    "final_score_blend",
    f"""SELECT ref_domain, {rounded(f'auto_score * 0.85 + coalesce({_manual}, 0) * 0.15', 4)} AS blend_two,
        {rounded(f'auto_score * 0.8 + coalesce({_manual}, 0) * 0.15 + coalesce({_hard}, 0) * 0.05', 4)} AS blend_three,
        CASE WHEN {_manual} IS NULL THEN auto_score ELSE {rounded(f'auto_score * 0.9 + {_manual} * 0.1', 4)} END AS blend_or_machine
    FROM ({_scored(_STATS1, _SCORE1)})""",
)

# --- keywords -------------------------------------------------------------------------------------------

_INTENTS = ("navigational", "informational", "commercial", "transactional")
_n_intents = " + ".join(f"CAST(is_{i} AS INT)" for i in _INTENTS)
_intent_sums = ", ".join(
    f"{rounded(f'sum(CASE WHEN is_{i} THEN CAST(current_traffic / ({_n_intents}) AS DECIMAL(24,6)) ELSE 0 END)', 4)} AS intent_{i}"
    for i in _INTENTS
)


def _traffic_where(test: str, name: str) -> str:
    return f"CAST(sum(CASE WHEN {test} THEN current_traffic ELSE 0 END) AS DOUBLE) AS {name}"


_KW_BANDS = {
    "pos_1_3": "current_position <= 3", "pos_4_10": "current_position BETWEEN 4 AND 10",
    "pos_11_20": "current_position BETWEEN 11 AND 20", "pos_21_plus": "current_position > 20",
    "kd_0_15": "kd <= 15", "kd_16_40": "kd BETWEEN 16 AND 40", "kd_41_plus": "kd > 40",
}
_KW_PROFILE = f"""SELECT competitor_domain, {count_where("keyword <> ''")} AS n_keywords, CAST(sum(current_traffic) AS DOUBLE) AS traffic,
    {rounded('sum(CAST(current_traffic * cpc AS DECIMAL(24,6)))', 4)} AS traffic_value,
    {_traffic_where('is_branded', 'branded_traffic')}, {_traffic_where('NOT is_branded', 'non_branded_traffic')},
    {_intent_sums}, {', '.join(_traffic_where(t, n) for n, t in _KW_BANDS.items())}
    FROM f_keywords GROUP BY 1"""
oracle("keyword_profile", _KW_PROFILE)
_whole = "(CASE WHEN traffic > 0 THEN traffic ELSE 1 END)"
_kw_shares = {
    "non_branded_share": "non_branded_traffic", "branded_share": "branded_traffic",
    "buying_share": "intent_commercial + intent_transactional",
    **{f"{n}_share": n for n in [*(f"intent_{i}" for i in _INTENTS), *_KW_BANDS]},
}
oracle(
    "keyword_shares",
    f"""SELECT competitor_domain, {', '.join(f"{rate(f'({part})', _whole)} AS {name}" for name, part in _kw_shares.items())} FROM ({_KW_PROFILE})""",
)
_KW_TOTAL = "(SELECT competitor_domain, sum(current_traffic) AS whole FROM f_keywords GROUP BY 1)"
oracle(
    "keyword_country_top5",
    f"""SELECT competitor_domain, country, traffic, {rate('traffic', 'whole')} AS traffic_share FROM (
        SELECT *, row_number() OVER (PARTITION BY competitor_domain ORDER BY traffic DESC, country) AS rn
        FROM (SELECT competitor_domain, country, CAST(sum(current_traffic) AS DOUBLE) AS traffic FROM f_keywords GROUP BY 1, 2))
        JOIN {_KW_TOTAL} USING (competitor_domain) WHERE rn <= 5""",
)
oracle(
    "keyword_page_top10",
    f"""SELECT competitor_domain, url, traffic, n_keywords, keyword_sample, {rate('traffic', 'whole')} AS traffic_share FROM (
        SELECT *, row_number() OVER (PARTITION BY competitor_domain ORDER BY traffic DESC, url) AS rn
        FROM (SELECT competitor_domain, url, CAST(sum(current_traffic) AS DOUBLE) AS traffic, count(DISTINCT keyword) AS n_keywords,
            array_to_string(list_sort(list_distinct(list(keyword)))[1:5], ', ') AS keyword_sample FROM f_keywords WHERE url <> '' GROUP BY 1, 2))
        JOIN {_KW_TOTAL} USING (competitor_domain) WHERE rn <= 10""",
)
oracle(
    "keyword_terms_top10",
    f"""SELECT competitor_domain, keyword, country, volume, kd, {rounded('cpc')} AS cpc, current_position, current_traffic, url FROM (
        SELECT *, row_number() OVER (PARTITION BY competitor_domain ORDER BY current_traffic DESC, keyword, country, src_ord) AS place
        FROM f_keywords WHERE current_traffic > 0 AND current_position <= 50 AND NOT is_branded) WHERE place <= 10""",
)
_KW_OVERLAP = """SELECT g.*, f.volume, f.kd, f.cpc, f.is_informational, f.is_commercial, f.is_transactional FROM (
        SELECT keyword, count(DISTINCT competitor_domain) AS alpha, string_agg(DISTINCT competitor_domain, ', ' ORDER BY competitor_domain) AS shared_by,
            CAST(sum(current_traffic) AS DOUBLE) AS traffic FROM f_keywords WHERE NOT is_branded AND current_traffic > 0 GROUP BY 1) g
    JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY keyword ORDER BY src_ord) AS place
        FROM f_keywords WHERE NOT is_branded AND current_traffic > 0) WHERE place = 1) f ON f.keyword = g.keyword"""
oracle("keyword_overlap", f"SELECT * REPLACE ({rounded('cpc')} AS cpc) FROM ({_KW_OVERLAP})")
oracle(
    "keyword_matrix",
    f"""SELECT keyword, alpha, shared_by, volume, kd, {rounded('cpc')} AS cpc, traffic FROM ({_KW_OVERLAP})
        ORDER BY alpha DESC, traffic DESC, kd, keyword""",
)
_KW_POINTS = f"""{steps('kd', '<=', scores.KEYWORD_DIFFICULTY_STEPS, 0)} * 0.40 + {steps('alpha', '>=', scores.KEYWORD_OVERLAP_STEPS, 15)} * 0.30
    + {steps('volume', '>=', scores.KEYWORD_VOLUME_STEPS, 10)} * 0.30 + CASE WHEN cpc >= 2 THEN 15 WHEN cpc >= 1 THEN 10 WHEN cpc >= 0.5 THEN 5 ELSE 0 END"""
_KW_SCORED = f"""SELECT *, {steps('auto_score', '>=', rules.KEYWORD_PRIORITIES, rules.KEYWORD_PRIORITY_LAST)} AS priority,
        CASE WHEN is_transactional OR is_commercial THEN {quoted(rules.KEYWORD_ACTION_BUYING)}
            WHEN is_informational THEN {quoted(rules.KEYWORD_ACTION_INFORMATION)} ELSE {quoted(rules.KEYWORD_ACTION_DEFAULT)} END AS action
    FROM (SELECT *, CAST(least({rounded(_KW_POINTS, 1)}, 100.0) AS DOUBLE) AS auto_score FROM ({_KW_OVERLAP}))"""
_KW_COLUMNS = f"keyword, alpha, volume, kd, {rounded('cpc')} AS cpc, traffic, auto_score, priority, action"
oracle("keyword_score", f"SELECT {_KW_COLUMNS} FROM ({_KW_SCORED})")
oracle(
    "keyword_queue",
    f"""SELECT {_KW_COLUMNS}, shared_by, {_blank(['ai_relevance', 'ai_title', 'ai_outline', 'editor', 'published_url'])}, '未开始 (Not Started)' AS status,
        {rounded('auto_score * 0.85', 4)} AS final_score
        FROM ({_KW_SCORED}) ORDER BY auto_score DESC, traffic DESC, keyword""",
)
_CAP_COMP = "upper(substr(competitor_domain, 1, 1)) || lower(substr(competitor_domain, 2))"
_TITLE = (
    "array_to_string(list_transform(regexp_extract_all({k}, '[a-zA-Z]+|[^a-zA-Z]+'), "
    "lambda r: upper(substr(r, 1, 1)) || lower(substr(r, 2))), '')"
)
_SLUG = "regexp_replace(trim(regexp_replace(lower({k}), '[^a-z0-9\\s]', '', 'g')), '\\s+', '-', 'g')"


def _plan_case(field: int) -> str:
    whens = " ".join(
        f"WHEN plan = {quoted(kind)} THEN {quoted(row[field].replace('{brand}', catalog.BRAND))}" for kind, row in rules.PAGE_PLANS.items()
    )
    return f"(CASE {whens} END)"


_TASK_SCORE = """CASE WHEN volume < 30 THEN 0 ELSE least(100, ease
        + CASE WHEN ease < 60 THEN 0 WHEN volume >= 5000 THEN 15 WHEN volume >= 1000 THEN 10 WHEN volume >= 300 THEN 5 ELSE 0 END
        + CASE WHEN is_commercial OR is_transactional THEN 10 ELSE 0 END + CASE WHEN cpc >= 1 THEN 10 WHEN cpc >= 0.5 THEN 5 ELSE 0 END) END"""
_TASK_BASE = f"""SELECT g.*, m.volume, m.kd, m.cpc, f.is_commercial, f.is_transactional, f.is_navigational, f.src_ord AS first_ord,
        CASE WHEN m.kd > 40 THEN 15 WHEN m.kd > 25 THEN 45 WHEN m.kd > 15 THEN 65 WHEN m.kd >= 5 THEN 85 ELSE 95 END AS ease FROM (
        SELECT keyword, CAST(sum(current_traffic) AS DOUBLE) AS traffic, string_agg(DISTINCT {_CAP_COMP}, ', ' ORDER BY {_CAP_COMP}) AS competitors
        FROM f_keywords WHERE NOT is_branded GROUP BY 1) g
    JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY keyword ORDER BY volume DESC, src_ord) AS place FROM f_keywords WHERE NOT is_branded) WHERE place = 1) m
        ON m.keyword = g.keyword
    JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY keyword ORDER BY src_ord) AS place FROM f_keywords WHERE NOT is_branded) WHERE place = 1) f
        ON f.keyword = g.keyword"""
oracle(
    "keyword_tasks",
    f"""SELECT keyword, volume, kd, {rounded('cpc')} AS cpc, {rounded('traffic', 1)} AS traffic, competitors, score,
        {_plan_case(0)} AS page_type, {_plan_case(1)} AS department, {_plan_case(2)} AS instruction,
        {_plan_case(3)} || {_SLUG.replace('{k}', 'keyword')} AS target_url,
        {_TITLE.replace('{k}', 'keyword')} || ' (2026 Guide & Top Suppliers) | {catalog.BRAND}' AS title,
        'SEO-PAGE-' || CASE WHEN n < 10000 THEN lpad(CAST(n AS VARCHAR), 4, '0') ELSE CAST(n AS VARCHAR) END AS task_id,
        '2024-03-01' AS discovered, '' AS completed, 'Pending' AS status
    FROM (SELECT *, row_number() OVER (ORDER BY first_ord, keyword) AS n,
            CASE WHEN is_navigational OR contains(lower(keyword), 'login') OR contains(lower(keyword), 'app') THEN 'integration'
                WHEN is_commercial OR is_transactional OR contains(lower(keyword), 'dropshipping suppliers') THEN 'hub'
                WHEN contains(lower(keyword), 'calculator') OR contains(lower(keyword), 'converter') OR contains(lower(keyword), 'generator') THEN 'tool'
                ELSE 'blog' END AS plan
        FROM (SELECT *, CAST({_TASK_SCORE} AS INTEGER) AS score FROM ({_TASK_BASE})) WHERE score >= 50)""",
)
oracle(
    "keyword_benchmarks",
    f"""SELECT keyword, url, competitor, traffic, '[' || competitor || '] ' || url || ' (Traffic: ' || CAST(CAST(traffic AS DECIMAL(38,1)) AS VARCHAR) || ')' AS benchmark FROM (
        SELECT keyword, url, {_CAP_COMP.replace('competitor_domain', 'first_comp')} AS competitor, traffic FROM (
            SELECT keyword, url, arg_min(competitor_domain, src_ord) AS first_comp, CAST(sum(current_traffic) AS DOUBLE) AS traffic
            FROM f_keywords WHERE NOT is_branded AND current_traffic > 0 AND url <> '' GROUP BY 1, 2))""",
)
oracle(
    "keyword_brand_free",
    f"""SELECT competitor_domain, count(*) AS n_kept, min(keyword) AS first_keyword FROM (
        SELECT keyword, ({listed(COMPETITOR_NAMES)})[kd % {len(COMPETITOR_NAMES)} + 1] AS competitor_domain FROM v_keywords)
        WHERE NOT contains(replace(keyword, ' ', ''), competitor_domain) GROUP BY 1""",
)

# --- pages ----------------------------------------------------------------------------------------------

oracle(
    "page_profile",
    f"""SELECT *, {rate('ref_domains', 'n_pages', 1)} AS ref_domains_per_page FROM (
        SELECT competitor_domain, count(*) AS n_pages, {total('current_traffic')} AS traffic, {rounded('sum(current_traffic_value)', 2)} AS traffic_value,
            {total('current_ref_domains')} AS ref_domains FROM f_pages GROUP BY 1) WHERE traffic <> 0""",
)
oracle(
    "page_category_rollup",
    f"""SELECT competitor_domain, page_category, n_pages, traffic, {rate('traffic', 'whole')} AS traffic_share, {rate('traffic', 'n_pages', 1)} AS traffic_per_page FROM (
        SELECT competitor_domain, page_category, count(*) AS n_pages, {total('current_traffic')} AS traffic,
            sum(sum(current_traffic)) OVER (PARTITION BY competitor_domain) AS whole FROM f_pages GROUP BY 1, 2) WHERE whole <> 0""",
)
oracle(
    "page_top10",
    """SELECT competitor_domain, page_url, page_category, current_traffic, current_keywords, top_keyword, top_keyword_volume, top_keyword_position FROM (
        SELECT *, row_number() OVER (PARTITION BY competitor_domain ORDER BY current_traffic DESC, page_url) AS place FROM f_pages WHERE current_traffic > 0) WHERE place <= 10""",
)
oracle(
    "page_opportunities",
    """SELECT competitor_domain, page_category, page_url, top_keyword, top_keyword_volume, top_keyword_position, current_ref_domains, current_keywords,
        current_traffic, current_traffic_value FROM f_pages ORDER BY current_traffic DESC, competitor_domain, page_url""",
)
oracle("sitemap_metrics_outer", "SELECT * FROM f_merged")
oracle(
    "orphan_zombie_pages",
    """SELECT domain, canonical_key, final_url, NOT in_sitemap AS is_orphan, in_sitemap AS is_zombie FROM f_merged WHERE traffic = 0""",
)
oracle(
    "dir_l1_rollup",
    f"""SELECT domain, {first_directory('final_url')} AS dir_l1, count(final_url) AS n_pages, CAST(sum(traffic) AS DOUBLE) AS traffic FROM f_merged GROUP BY 1, 2""",
)
oracle(
    "traffic_pages",
    """SELECT domain, final_url, traffic, keywords, in_sitemap FROM (
        SELECT *, max(traffic) OVER (PARTITION BY domain) AS best, row_number() OVER (PARTITION BY domain ORDER BY final_url) AS place FROM f_merged)
        WHERE traffic > 0 OR best = 0""",
)
_HEAT = "CASE WHEN traffic >= 1000 THEN '🔥🔥🔥' WHEN traffic >= 100 THEN '🔥' WHEN traffic >= 10 THEN '🌟' WHEN traffic > 0 THEN '⭐' ELSE '' END"
oracle(
    "url_tree_rollup",
    f"""SELECT node_id, parent_id, label, depth, traffic, n_pages, keywords, best_keyword, page_url, {_HEAT} AS heat,
        traffic = 0 AND page_in_sitemap IS NOT NULL AND NOT coalesce(page_in_sitemap, true) AS is_orphan FROM f_tree""",
)
oracle(
    "url_tree_listing",
    f"""SELECT node_id, label, parent_id, depth, traffic, keywords, CASE WHEN best_keyword = '' THEN '无' ELSE best_keyword END AS best_keyword, n_pages,
        coalesce(page_url, '[目录组] https://' || node_id) AS address, {_HEAT} AS heat FROM f_tree WHERE traffic > 0""",
)
_IDLE = """(SELECT node_id, parent_id, row_number() OVER (PARTITION BY parent_id ORDER BY node_id) AS place FROM f_tree WHERE traffic = 0 AND depth > 1)"""
oracle(
    "url_tree_zombie_cap",
    f"""SELECT node_id, parent_id, depth, traffic, n_pages FROM f_tree t
        WHERE NOT EXISTS (SELECT 1 FROM {_IDLE} h WHERE h.place > 5 AND (t.node_id = h.node_id OR starts_with(t.node_id, h.node_id || '/')))""",
)
oracle(
    "url_tree_hidden",
    """SELECT parent_id, count(*) - 5 AS hidden_children FROM f_tree WHERE traffic = 0 AND depth > 1 GROUP BY 1 HAVING count(*) > 5""",
)

# --- snapshots and slugs --------------------------------------------------------------------------------

_ADDED = "SELECT site_id, page_url FROM v_crawl EXCEPT SELECT site_id, page_url FROM v_history"
_REMOVED = "SELECT site_id, page_url FROM v_history EXCEPT SELECT site_id, page_url FROM v_crawl"
oracle("snapshot_added", _ADDED)
oracle("snapshot_removed", _REMOVED)
oracle(
    "snapshot_changes",
    f"SELECT *, 'added' AS change FROM ({_ADDED}) UNION ALL SELECT *, 'removed' AS change FROM ({_REMOVED})",
)
oracle(
    "snapshot_apply",
    f"""SELECT site_id, page_url, coalesce(first_seen, TIMESTAMP '{catalog.SEEN_AT}') AS first_seen, coalesce(last_seen, TIMESTAMP '{catalog.SEEN_AT}') AS last_seen
        FROM v_crawl LEFT JOIN v_history USING (site_id, page_url)""",
)
oracle("slug_keywords", "SELECT keyword, domain, count(*) AS n_pages FROM v_slugs GROUP BY 1, 2")
oracle(
    "slug_overlap",
    """SELECT keyword, count(DISTINCT domain) AS alpha, string_agg(DISTINCT domain, ', ' ORDER BY domain) AS shared_by,
        string_agg(line, chr(10) ORDER BY line) AS links FROM (
        SELECT keyword, domain, '[' || domain || '] ' || page_url AS line, row_number() OVER (PARTITION BY keyword, domain ORDER BY page_url) AS place
        FROM (SELECT DISTINCT keyword, domain, page_url FROM v_slugs)) WHERE place <= 2
        GROUP BY 1 HAVING count(DISTINCT domain) >= 2 OR (SELECT count(*) FROM v_slug_sites) < 2""",
)
oracle(
    "monitor_summary",
    f"""SELECT 'pseo_reverse_engineering_complete' AS event_type, '{catalog.SEEN_AT}' AS timestamp, (SELECT count(*) FROM v_slug_sites) AS sites_analyzed,
        count(DISTINCT keyword) AS total_keywords_extracted FROM v_slugs""",
)

# --- URLs and scalar functions --------------------------------------------------------------------------

_upper = "upper(' ' || url)"
_ported = "regexp_replace(url, '^https?://([^/]*)', 'http://me:pw@\\1:8080')"
oracle(
    "canonical_url",
    f"""SELECT page_id, {canonical_url('url')} AS canonical, {canonical_url(_upper)} AS from_upper, {canonical_url(_ported)} AS with_port,
        'https://' || regexp_replace(regexp_replace(regexp_replace(url, '^https?://', ''), '#.*$', ''), '/$', '') AS no_scheme FROM pages""",
)
oracle(
    "canonical_key",
    f"""SELECT page_id, {canonical_key('url')} AS key, {canonical_key('upper(url)')} AS key_from_upper,
        replace({canonical_key('url')}, '/en/', '/en+x/') AS key_decoded FROM pages""",
)
_messy = "regexp_replace(url, '([a-z])/', '\\1//', 'g')"
oracle(
    "url_forms",
    f"""SELECT page_id, regexp_replace(split_part(url, '/', 3), '^www\\.', '') AS site_host, {hostname('url')} AS hostname, {page_url('url')} AS page_url,
        {page_url(_messy)} AS page_url_messy, 'https://' || {hostname('url')} || '/sitemap.xml' AS sitemap_url,
        {first_directory('url')} AS directory FROM pages""",
)
oracle(
    "registrable_rules",
    f"""WITH h AS (SELECT page_id, {hostname('url')} AS host FROM pages),
        cut AS (SELECT *, string_split(host, '.') AS l FROM h),
        wild AS (SELECT DISTINCT l[-1] AS last FROM cut WHERE page_id % 2 = 0),
        ex AS (SELECT DISTINCT l[-2] || '.' || l[-1] AS two FROM cut WHERE page_id % 5 = 0 AND len(l) >= 2),
        n AS (SELECT *, CASE WHEN len(l) >= 2 AND l[-2] || '.' || l[-1] IN (SELECT two FROM ex) THEN 1
            WHEN l[-1] IN (SELECT last FROM wild) AND len(l) >= 2 THEN 2 ELSE 1 END AS suffix_labels FROM cut)
        SELECT page_id, host, CASE WHEN len(l) > suffix_labels THEN array_to_string(l[-(suffix_labels + 1):], '.') ELSE host END AS registrable_domain FROM n""",
)
oracle(
    "registrable_domain",
    f"""SELECT page_id, {hostname('url')} AS host, regexp_extract({hostname('url')}, '([^.]+\\.[^.]+\\.[^.]+)$', 1) AS registrable_domain FROM pages""",
)
oracle(
    "link_fingerprint_dedupe",
    "SELECT competitor_domain, link_fingerprint, source_url, anchor, src_ord.o, src_ord.l FROM f_links_b",
)
_number = "'^[+-]?(\\d+(_\\d+)*\\.?(\\d+(_\\d+)*)?|\\.\\d+(_\\d+)*)([eE][+-]?\\d+(_\\d+)*)?$'"


def _double(x: str) -> str:
    return f"(CASE WHEN regexp_matches({x}, {_number}) AND isfinite(TRY_CAST(replace({x}, '_', '') AS DOUBLE)) THEN TRY_CAST(replace({x}, '_', '') AS DOUBLE) END)"


def _whole_sum(x: str) -> str:
    return f"CAST(sum(CAST(coalesce(TRY_CAST(trunc({x}) AS BIGINT), 0) AS DECIMAL(38,0))) AS VARCHAR)"


_nocomma = "replace(word, ',', '')"
oracle(
    "lenient_numbers",
    f"""SELECT source, count(*) AS n_words, {_whole_sum('n')} AS sum_int,
        CAST(sum(CAST(TRY_CAST(coalesce(n, 0) AS DECIMAL(24,0)) AS DECIMAL(38,0))) AS VARCHAR) AS sum_double,
        {count_where("TRY_CAST(coalesce(n, 0) AS DECIMAL(24,0)) IS NULL")} AS n_unsummed,
        {_whole_sum('g')} AS sum_grouped, count(m) AS n_metric,
        {count_where("lower(word) IN ('true', '1', 'yes', 'y', 't')")} AS n_flag, {count_where("upper(word) = 'TRUE'")} AS n_strict
    FROM (SELECT *, {_double('word')} AS n, {_double(_nocomma)} AS g, {_double("replace(replace(word, ',', ''), '%', '')")} AS m
        FROM (SELECT source, unnest(string_split_regex(text, '[ \\t\\n\\r]+')) AS word FROM documents)) GROUP BY 1""",
)
oracle(
    "normalised_dates",
    """SELECT written, CASE WHEN l_linenumber = 7 THEN written
            WHEN l_linenumber = 3 AND day(d) > 12 THEN strftime(d, '%Y-%m-%d') ELSE strftime(d, '%Y-%m-%d') END AS normal,
        CASE WHEN l_linenumber = 7 THEN NULL ELSE strftime(d, '%Y') END AS year, count(*) AS n FROM (
        SELECT l_linenumber, l_shipdate AS d, CASE l_linenumber WHEN 1 THEN strftime(l_shipdate, '%Y-%m-%d')
            WHEN 2 THEN year(l_shipdate) || '/' || month(l_shipdate) || '/' || day(l_shipdate)
            WHEN 3 THEN strftime(l_shipdate, '%d/%m/%Y') WHEN 4 THEN strftime(l_shipdate, '%d.%m.%Y')
            WHEN 5 THEN strftime(l_shipdate, '%b ') || day(l_shipdate) || strftime(l_shipdate, ', %Y')
            WHEN 6 THEN day(l_shipdate) || strftime(l_shipdate, ' %b %Y') ELSE 'week ' || year(l_shipdate) END AS written FROM lineitem)
        GROUP BY 1, 2, 3""",
)
oracle(
    "word_forms",
    f"""SELECT keyword, {_SLUG.replace('{k}', 'keyword')} AS slug, {_TITLE.replace('{k}', 'keyword')} AS title,
        upper(substr(keyword, 1, 1)) || lower(substr(keyword, 2)) AS capitalised,
        upper(substr(split_part(keyword, ' ', 1), 1, 1)) || lower(substr(split_part(keyword, ' ', 1), 2)) AS company
    FROM (SELECT DISTINCT keyword FROM v_keywords)""",
)
oracle(
    "heat_tiers",
    f"SELECT {_HEAT.replace('traffic', 'current_traffic')} AS heat, count(*) AS n_pages FROM v_pages GROUP BY 1",
)

# --- vendor B links -------------------------------------------------------------------------------------

_live = count_where("NOT is_lost")


def _live_rate(test: str) -> str:
    return ratio(count_where(f"NOT is_lost AND {test}"), _live)


_LIVE_DOMAINS = "count(DISTINCT ref_domain) FILTER (WHERE NOT is_lost)"
_PROFILE_B = f"""SELECT competitor_domain, count(DISTINCT ref_domain) AS total_domains, count(*) AS total_backlinks, {_LIVE_DOMAINS} AS live_domains,
    count(DISTINCT ref_domain) - {_LIVE_DOMAINS} AS lost_domains, {_live} AS live_backlinks, count(*) - {_live} AS lost_backlinks,
    {count_where('is_new')} AS new_flagged_backlinks, count(DISTINCT nullif(target_url, '')) AS unique_target_pages,
    {_live_rate('is_follow')} AS follow_rate_live, {_live_rate('is_nofollow')} AS nofollow_rate_live, {_live_rate('is_sitewide')} AS sitewide_rate_live,
    {_live_rate('is_sponsored')} AS sponsored_rate_live, {_live_rate('is_ugc')} AS ugc_rate_live, {_live_rate('page_ascore >= 40')} AS high_as_rate_live,
    {ratio('sum(page_ascore) FILTER (WHERE NOT is_lost)', _live)} AS avg_page_as_live,
    {ratio('count(*)', 'count(DISTINCT ref_domain)')} AS link_concentration, {ratio(_live, _LIVE_DOMAINS)} AS live_link_concentration
    FROM f_links_b GROUP BY 1"""
_B_RATES = (
    "follow_rate_live", "nofollow_rate_live", "sitewide_rate_live", "sponsored_rate_live", "ugc_rate_live",
    "high_as_rate_live", "avg_page_as_live", "link_concentration", "live_link_concentration",
)


def _round_columns(source: str, columns, digits: int = 6) -> str:
    return f"SELECT * REPLACE ({', '.join(f'{rounded(c, digits)} AS {c}' for c in columns)}) FROM ({source})"


oracle("link_profile_b", _round_columns(_PROFILE_B, _B_RATES))
_BANDS_B = {"as_0_20": "0-20", "as_21_40": "21-40", "as_41_60": "41-60", "as_61_80": "61-80", "as_81_100": "81-100"}
oracle(
    "authority_bands_b",
    f"""SELECT competitor_domain, {', '.join(f"{count_where(f'band = {quoted(b)}')} AS {n}" for n, b in _BANDS_B.items())},
        {', '.join(f"{count_where(f'NOT is_lost AND band = {quoted(b)}')} AS live_{n}" for n, b in _BANDS_B.items())},
        {', '.join(f"{rate(count_where(f'NOT is_lost AND band = {quoted(b)}'), f'greatest({_live}, 1)')} AS live_{n}_share" for n, b in _BANDS_B.items())}
    FROM f_links_b GROUP BY 1""",
)
_KINDS = ("Image", "Form", "Frame", "Text", "Unknown")
oracle(
    "link_types_b",
    f"""SELECT competitor_domain, {', '.join(f"{count_where(f'kind = {quoted(k)}')} AS n_{k.lower()}" for k in _KINDS)},
        {', '.join(f"{count_where(f'NOT is_lost AND kind = {quoted(k)}')} AS live_n_{k.lower()}" for k in _KINDS)} FROM f_links_b GROUP BY 1""",
)
_COHORTS = f"""SELECT competitor_domain, year, {total('backlinks')} AS backlinks, {total('live_backlinks')} AS live_backlinks,
        {total('domains')} AS domains, {total('live_domains')} AS live_domains FROM (
        SELECT competitor_domain, substr(first_seen, 1, 4) AS year, 1 AS backlinks, CAST(NOT is_lost AS INT) AS live_backlinks, 0 AS domains, 0 AS live_domains
        FROM f_links_b WHERE first_seen <> ''
        UNION ALL
        SELECT competitor_domain, substr(seen, 1, 4), 0, 0, 1, CAST(live AS INT) FROM (
            SELECT competitor_domain, ref_domain, min(nullif(first_seen, '')) AS seen, bool_or(NOT is_lost) AS live FROM f_links_b GROUP BY 1, 2) WHERE seen IS NOT NULL)
    GROUP BY 1, 2"""
oracle("cohorts_b", _COHORTS)
oracle("cumulative_cohorts_b", _grid(_COHORTS, ["backlinks", "live_backlinks", "domains", "live_domains"]))

_RATE_COLUMNS = (
    "avg_page_as", "live_avg_page_as", "follow_rate", "live_follow_rate", "sitewide_rate", "sponsored_rate", "ugc_rate", "avg_external_links",
)
_INTEL = """SELECT domain, alpha, competitors, backlinks, live_backlinks, source_pages, target_pages, max_page_as, avg_page_as, live_avg_page_as,
    follow_rate, live_follow_rate, sitewide_rate, sponsored_rate, ugc_rate, avg_external_links, earliest_first_seen, latest_last_seen, type_mix
    FROM f_measures JOIN v_mix USING (domain)"""
oracle("domain_intel_b", _round_columns(_INTEL, _RATE_COLUMNS))


def _examples(label: str) -> str:
    marks = """concat_ws('/', CASE WHEN is_follow THEN 'Follow' END, CASE WHEN is_nofollow THEN 'Nofollow' END,
        CASE WHEN is_sponsored THEN 'Sponsored' END, CASE WHEN is_ugc THEN 'UGC' END, CASE WHEN is_sitewide THEN 'Sitewide' END)"""
    return f"""SELECT *, row_number() OVER (PARTITION BY domain ORDER BY lost, minus, url, example) AS place FROM (
        SELECT domain, example, min(lost) AS lost, min(minus) AS minus, min(url) AS url FROM (
            SELECT ref_domain AS domain, is_lost AS lost, -page_ascore AS minus, source_url AS url,
                '[' || competitor_domain || '] [' || (CASE WHEN is_lost THEN 'LOST' ELSE 'LIVE' END) || '] {label} ' || CAST(round_even(page_ascore, 0) AS BIGINT)
                || ' | ' || source_url || ' --[' || (CASE WHEN anchor = '' THEN '无锚文本' ELSE anchor END) || ']--> ' || target_url
                || ' (' || (CASE WHEN {marks} = '' THEN 'No special attribute' ELSE {marks} END) || ')' AS example FROM f_links_b)
        GROUP BY 1, 2)"""


oracle(
    "domain_examples_topn",
    f"""SELECT domain, string_agg(example, chr(10) ORDER BY place) AS examples, count(*) AS n_examples FROM ({_examples('AS')}) WHERE place <= 20 GROUP BY 1""",
)
oracle(
    "intel_payload",
    f"""SELECT domain AS ref_domain, alpha AS competitor_overlap_alpha, competitors, backlinks, live_backlinks, {rounded('max_page_as', 1)} AS max_source_page_as,
        {rounded('avg_page_as', 1)} AS avg_source_page_as, {rounded('follow_rate', 4)} AS follow_rate, {rounded('sitewide_rate', 4)} AS sitewide_rate,
        {rounded('sponsored_rate', 4)} AS sponsored_rate, {rounded('ugc_rate', 4)} AS ugc_rate, earliest_first_seen, latest_last_seen, examples
    FROM f_measures LEFT JOIN (SELECT domain, string_agg(example, chr(10) ORDER BY place) AS examples FROM ({_examples('AS')}) WHERE place <= 5 GROUP BY 1) USING (domain)""",
)
oracle(
    "link_details_b",
    """SELECT competitor_domain, l.ref_domain, source_url, alpha, CASE WHEN is_lost THEN 'LOST' ELSE 'LIVE' END AS state,
        CASE WHEN is_follow THEN 'Follow' ELSE 'Attributed' END AS follow, kind AS link_type, band AS authority_band, link_fingerprint
    FROM f_links_b l JOIN (SELECT ref_domain, count(DISTINCT competitor_domain) AS alpha FROM f_links_b GROUP BY 1) a ON a.ref_domain = l.ref_domain""",
)


oracle(
    "link_details_raw_b",
    """SELECT competitor_domain, l.ref_domain, alpha, CASE WHEN is_lost THEN 'LOST' ELSE 'LIVE' END AS state,
        CASE WHEN is_follow THEN 'Follow' ELSE 'Attributed' END AS follow, kind AS link_type, band AS authority_band,
        CASE WHEN starts_with(raw_json, '{"Link') THEN anchor ELSE '' END AS "Link anchor",
        CASE WHEN starts_with(raw_json, '{"Anchor') THEN anchor ELSE '' END AS "Anchor", '' AS "Missing"
    FROM f_links_b l JOIN (SELECT ref_domain, count(DISTINCT competitor_domain) AS alpha FROM f_links_b GROUP BY 1) a ON a.ref_domain = l.ref_domain""",
)
oracle(
    "ordered_facts_b",
    "SELECT competitor_domain, ref_domain, source_url, link_fingerprint, first_seen, is_lost FROM f_links_b",
)
oracle(
    "link_detail_columns",
    """SELECT competitor_domain, ref_domain, ref_url, CASE WHEN starts_with(raw_json, '{"Link') THEN anchor ELSE '' END AS "Link anchor",
        CASE WHEN starts_with(raw_json, '{"Anchor') THEN anchor ELSE '' END AS "Anchor", '' AS "Missing" FROM f_links_a""",
)


def _level(x: str, table) -> str:
    return steps(x, "<", table[0], table[1])


oracle(
    "diagnostic_levels",
    f"""SELECT competitor_domain, {rounded('bl')} AS backlink_loss, {_level('bl', rules.LOSS_LEVELS)} AS backlink_loss_level,
        {rounded('dl')} AS domain_loss, {_level('dl', rules.LOSS_LEVELS)} AS domain_loss_level,
        {_level('follow_rate_live', rules.FOLLOW_LEVELS)} AS follow_level, {_level('sitewide_rate_live', rules.SITEWIDE_LEVELS)} AS sitewide_level,
        {_level('high_as_rate_live', rules.AUTHORITY_LEVELS)} AS authority_level, {_level('live_link_concentration', rules.CONCENTRATION_LEVELS)} AS concentration_level
    FROM (SELECT *, {ratio('lost_backlinks', 'total_backlinks')} AS bl, {ratio('lost_domains', 'total_domains')} AS dl FROM ({_PROFILE_B}))""",
)
oracle("enrichment_merge", "SELECT * FROM f_enrichment")

_LEAF = f"regexp_extract(lower({path('source_url')}), '([^/]*)$', 1)"
_ASSET = f"regexp_matches({_LEAF}, '[^.].*\\.({'|'.join(rules.ASSET_EXTENSIONS)})$')"
_TECHNICAL = f"len(list_filter({listed(rules.TECHNICAL_PATHS)}, lambda p: contains(lower({path('source_url')}), p))) > 0"
_EVIDENCE = f"""SELECT ref_domain AS domain, count(*) AS backlinks, {count_where(_ASSET)} AS assets, {count_where(_TECHNICAL)} AS technicals,
    bool_or(ref_domain = competitor_domain) AS own,
    ref_domain || chr(10) || string_agg(lower(source_title || chr(10) || source_url || chr(10) || anchor), chr(10)) AS blob FROM f_links_b GROUP BY 1"""


def _under(domains) -> str:
    return f"len(list_filter({listed(domains)}, lambda p: domain = p OR ends_with(domain, '.' || p))) > 0"


_reasons = {
    "self": "own",
    "redirect": f"domain IN {grouped(rules.REDIRECT_HOSTS)}",
    "cdn": _under(rules.CDN_HOSTS),
    "assets": "assets = backlinks",
    "technical": "assets <> backlinks AND technicals = backlinks AND assets >= greatest(1, backlinks // 2)",
}
_DROP = f"""SELECT *, drop_reasons <> '' AS is_drop FROM (SELECT *, concat_ws('；', {', '.join(f"CASE WHEN {t} THEN {quoted(rules.DROP_REASONS[n])} END" for n, t in _reasons.items())}) AS drop_reasons FROM ({_EVIDENCE}))"""
oracle("drop_detection", f"SELECT domain, backlinks, assets, technicals, is_drop, drop_reasons FROM ({_DROP})")


def _hits(patterns, text: str) -> str:
    return f"list_filter({listed(patterns)}, lambda p: contains({text}, p))"


def _first(hits: str, n: int) -> str:
    return f"array_to_string({hits}[1:{n}], ', ')"


_CLASSED = f"""SELECT *, is_app OR is_media OR is_edu AS strategic_domain,
    CASE WHEN is_drop THEN 'drop' WHEN is_app OR is_media OR is_edu OR len(h_strategic) > 0 THEN 'strategic' WHEN len(h_self) > 0 THEN 'self_serve'
        WHEN len(h_dir) > 0 OR len(h_hint) > 0 THEN 'directory' WHEN len(h_official) > 0 THEN 'official' WHEN len(h_editorial) > 0 THEN 'editorial' ELSE 'unverified' END AS path
    FROM (SELECT * EXCLUDE (blob), {_hits(rules.SELF_SERVE, 'blob')} AS h_self, {_hits(rules.DIRECTORY_PATHS, 'blob')} AS h_dir,
        {_hits(rules.DIRECTORY_DOMAINS, 'domain')} AS h_hint, {_hits(rules.OFFICIAL_ENTRY, 'blob')} AS h_official, {_hits(rules.STRATEGIC, 'blob')} AS h_strategic,
        {_hits(rules.EDITORIAL, 'blob')} AS h_editorial, {_under(rules.APP_DOMAINS)} AS is_app, {_under(rules.MEDIA_DOMAINS)} AS is_media,
        regexp_matches(domain, '\\.(edu|gov)(\\.[a-z]{{2}})?$') AS is_edu FROM ({_DROP}))"""


def _by_path(field: int) -> str:
    whens = " ".join(f"WHEN {quoted(k)} THEN {quoted(row[field].replace('{brand}', catalog.BRAND))}" for k, row in rules.PATHS.items())
    return f"(CASE path {whens} END)"


_E = rules.EVIDENCE
_PATHS_SQL = f"""SELECT domain, path, {_by_path(0)} AS priority, {_by_path(1)} AS machine_method, {_by_path(2)} AS action_suggested,
    CAST(CASE path WHEN 'drop' THEN 0.98 WHEN 'strategic' THEN (CASE WHEN strategic_domain THEN 0.88 ELSE 0.76 END) WHEN 'self_serve' THEN 0.94
        WHEN 'directory' THEN 0.72 WHEN 'official' THEN 0.83 WHEN 'editorial' THEN 0.74 ELSE 0.55 END AS DOUBLE) AS confidence,
    CASE path WHEN 'drop' THEN drop_reasons
        WHEN 'strategic' THEN concat_ws('；', CASE WHEN is_app THEN {quoted(_E['app'])} END, CASE WHEN is_edu THEN {quoted(_E['tld'])} END,
            CASE WHEN is_media THEN {quoted(_E['media'])} END, CASE WHEN len(h_strategic) > 0 THEN {quoted(_E['strategic'])} || {_first('h_strategic', 6)} END)
        WHEN 'self_serve' THEN {quoted(_E['self_serve'])} || {_first('h_self', 8)}
        WHEN 'directory' THEN concat_ws('；', CASE WHEN len(h_dir) > 0 THEN {quoted(_E['directory'])} || {_first('h_dir', 6)} END,
            CASE WHEN len(h_hint) > 0 THEN {quoted(_E['directory_domain'])} || {_first('h_hint', 4)} END)
        WHEN 'official' THEN {quoted(_E['official'])} || {_first('h_official', 8)}
        WHEN 'editorial' THEN {quoted(_E['editorial'])} || {_first('h_editorial', 8)} ELSE {quoted(_E['none'])} END AS evidence
    FROM ({_CLASSED})"""
oracle("action_path", _PATHS_SQL)

_STATUS = """CASE WHEN authority_score IS NULL AND monthly_visits IS NULL AND organic_traffic IS NULL THEN '未补充' WHEN organic_traffic IS NULL THEN '部分补充' ELSE '已补充' END"""
_ENRICHED = f"""SELECT m.*, p.per_competitor, x.type_mix, e.authority_score AS domain_authority_score, e.monthly_visits, e.organic_traffic, e.organic_keywords,
    coalesce(e.source_files, '') AS traffic_source, {_STATUS} AS traffic_status
    FROM f_measures m JOIN v_pairs_b p USING (domain) JOIN v_mix x USING (domain) LEFT JOIN f_enrichment e USING (domain)"""
oracle(
    "action_queue_summary",
    _round_columns(
        f"""SELECT domain, alpha, per_competitor, backlinks, live_backlinks, live_rate, high_page_as_rate, domain_authority_score, monthly_visits,
            organic_traffic, organic_keywords, traffic_source, traffic_status FROM ({_ENRICHED})""",
        ("live_rate", "high_page_as_rate"),
    ),
)


def _clamp(x: str) -> str:
    return f"greatest(0.0, least(100.0, {x}))"


_PARTS = {
    "Authority": (_clamp("coalesce(domain_authority_score, max_page_as)"), "0.30", "30"),
    "Alpha": (steps("alpha", ">=", scores.ALPHA_STEPS, 20), "0.20", "20"),
    "Live": (_clamp("live_rate * 100"), "0.12", "12"),
    "Follow": (_clamp("live_follow_rate * 100"), "0.10", "10"),
    "Avg Page AS": (_clamp("live_avg_page_as"), "0.08", "8"),
    "High Page AS": (_clamp("high_page_as_rate * 100"), "0.05", "5"),
    "Organic Traffic": (
        f"CASE WHEN organic_traffic IS NULL THEN NULL WHEN organic_traffic <= 0 THEN 0 ELSE {steps('organic_traffic', '<', scores.ORGANIC_STEPS, 100)} END",
        "0.10", "10",
    ),
    "Monthly Visits": (
        f"CASE WHEN monthly_visits IS NULL THEN NULL WHEN monthly_visits <= 0 THEN 0.0 ELSE {_clamp('20 + 20 * log10(monthly_visits + 1)')} END",
        "0.05", "5",
    ),
}
_parts_sql = ", ".join(f"CAST({expr} AS DECIMAL(20,8)) AS part_{i}" for i, (expr, _, _) in enumerate(_PARTS.values()))
_sum_sql = " + ".join(f"coalesce(part_{i}, 0) * {w}" for i, (_, w, _) in enumerate(_PARTS.values()))
_weights_sql = " + ".join(f"CASE WHEN part_{i} IS NULL THEN 0.00 ELSE {w} END" for i, (_, w, _) in enumerate(_PARTS.values()))
_shown_sql = ", ".join(
    f"CASE WHEN part_{i} IS NOT NULL THEN '{name}=' || CAST(round_even(CAST(part_{i} AS DOUBLE), 0) AS BIGINT) || '×{pct}%' END"
    for i, (name, (_, _, pct)) in enumerate(_PARTS.items())
)
_SCORED_B = f"""SELECT *, CASE WHEN priority = 'Drop' THEN least(raw_score, 25.0) ELSE raw_score END AS machine_score,
        concat_ws('; ', {_shown_sql}, CASE WHEN penalty > 0 THEN 'Penalty=-' || penalty END) AS score_breakdown
    FROM (SELECT *, {rounded(_clamp(f"CAST({_sum_sql} AS DOUBLE) / CAST({_weights_sql} AS DOUBLE) - penalty"), 1)} AS raw_score
        FROM (SELECT *, {_parts_sql}, CASE WHEN sitewide_rate >= 0.5 THEN 8 WHEN sitewide_rate >= 0.2 THEN 4 ELSE 0 END
            + CASE WHEN sponsored_rate >= 0.5 THEN 6 WHEN sponsored_rate >= 0.2 THEN 3 ELSE 0 END + CASE WHEN ugc_rate >= 0.7 THEN 4 ELSE 0 END
            + CASE WHEN live_backlinks = 0 THEN 8 ELSE 0 END AS penalty
        FROM ({_ENRICHED}) JOIN ({_PATHS_SQL}) USING (domain)))"""
oracle("action_queue_score", f"SELECT domain, priority, raw_score, machine_score, score_breakdown FROM ({_SCORED_B})")
_labels = " ".join(f"WHEN {quoted(k)} THEN {quoted(v)}" for k, v in rules.PRIORITY_LABELS.items())
_ranks = " ".join(f"WHEN {quoted(k)} THEN {v}" for k, v in rules.PRIORITY_RANKS.items())
_QUEUE_RATES = (
    "live_rate", "avg_page_as", "live_avg_page_as", "high_page_as_rate", "follow_rate", "live_follow_rate", "sitewide_rate",
    "sponsored_rate", "ugc_rate", "avg_external_links",
)
oracle(
    "action_queue_full",
    _round_columns(
        f"""SELECT priority, CASE priority {_labels} END AS priority_label, CASE priority {_ranks} END AS priority_rank, domain, machine_score, score_breakdown,
        confidence, machine_method, action_suggested, evidence, alpha, competitors, '总计:' || backlinks || ' | ' || per_competitor AS total_links, backlinks,
        live_backlinks, live_rate, source_pages, target_pages, domain_authority_score, max_page_as, avg_page_as, live_avg_page_as, high_page_as_rate,
        organic_traffic, monthly_visits, organic_keywords, traffic_status, traffic_source, follow_rate, live_follow_rate, sitewide_rate, sponsored_rate,
        ugc_rate, avg_external_links, earliest_first_seen, latest_last_seen, sample_links, machine_score AS final_score,
        {_blank(action_queue.HANDOFF_BLANKS)}, {', '.join(f"{quoted(v)} AS {k}" for k, v in rules.HANDOFF_STATES_B.items())}
    FROM ({_SCORED_B}) LEFT JOIN (SELECT domain, string_agg(example, chr(10) || chr(10) ORDER BY place) AS sample_links
        FROM ({_examples('Page AS')}) WHERE place <= 10 GROUP BY 1) USING (domain)""",
        _QUEUE_RATES,
    ),
)
oracle(
    "unenriched_batches",
    f"""SELECT CAST((n - 1) // 200 + 1 AS BIGINT) AS batch_no, n AS row_no, domain FROM (SELECT domain, row_number() OVER (ORDER BY CASE priority {_ranks} END,
        machine_score DESC, max_page_as DESC, alpha DESC, domain) AS n FROM ({_SCORED_B})
        WHERE priority <> 'Drop' AND domain_authority_score IS NULL AND organic_traffic IS NULL AND monthly_visits IS NULL)""",
)
oracle(
    "priority_counts",
    f"SELECT priority, count(*) AS n_domains, {count_where(f"traffic_status <> {quoted(rules.ENRICHMENT_NONE)}")} AS n_enriched FROM ({_SCORED_B}) GROUP BY 1",
)

# --- imports and documents ------------------------------------------------------------------------------

_MODAL = f"""SELECT src_file, host AS modal_value, n AS n_modal, CAST(whole AS BIGINT) AS n_rows, {ratio('n', 'whole')} AS modal_share FROM (
    SELECT *, row_number() OVER (PARTITION BY src_file ORDER BY n DESC, first) AS place, sum(n) OVER (PARTITION BY src_file) AS whole FROM (
        SELECT src_file, {hostname('target_url')} AS host, count(*) AS n, min(src_ord) AS first FROM v_links GROUP BY 1, 2)) WHERE place = 1"""
oracle("modal_target", _round_columns(_MODAL, ("modal_share",)))
oracle(
    "import_competitors",
    f"""SELECT src_file, CASE WHEN modal_share >= 0.5 THEN modal_value ELSE lower(replace(replace(src_file, 'backlinks-', ''), '.csv', '')) END AS competitor_domain FROM ({_MODAL})""",
)
oracle(
    "file_competitors",
    """SELECT p_partkey, low AS links_named, low AS links_plain, low AS keywords_named, low AS pages_named, split_part(low, '.', 1) AS pages_plain,
        low AS domain_named, '' AS domain_plain, low AS cleaned FROM (SELECT p_partkey, replace(lower(p_name), ' ', '.') AS low FROM part)""",
)
_rejected = "domain_rating % 3 = 0 AND links_in_group IN (4, 5, 6, 7)"
_lacking = ", ".join(sorted(set(rules.LINK_EXPORT_RECOMMENDED) - {"anchor", "ugc", "first seen"}))
oracle(
    "import_audit",
    f"""SELECT src_file, n_rows, n_rejected, n_inserted, n_rows - n_rejected - n_inserted AS n_duplicates,
        CASE WHEN note = '' THEN 'OK' ELSE note END AS note FROM (
        SELECT *, concat_ws('; ', CASE WHEN n_rejected > 0 THEN 'rejected ' || n_rejected END,
            CASE WHEN n_rows - n_rejected - n_inserted > 0 THEN 'duplicates ' || (n_rows - n_rejected - n_inserted) END,
            CASE WHEN src_file = 'backlinks-A.csv' THEN 'missing columns: {_lacking}' END) AS note
        FROM (SELECT src_file, count(*) AS n_rows, {count_where(_rejected)} AS n_rejected FROM v_links GROUP BY 1)
        JOIN (SELECT src_file, count(*) AS n_inserted FROM (SELECT src_file, row_number() OVER (PARTITION BY competitor_domain, link_fingerprint ORDER BY src_ord) AS place
            FROM v_fingerprints WHERE NOT ({_rejected})) WHERE place = 1 GROUP BY 1) USING (src_file))""",
)
oracle(
    "import_rejects",
    f"""SELECT src_file, CASE WHEN links_in_group >= 6 THEN 'no source URL' ELSE 'no host in the source URL' END AS reason,
        CASE links_in_group WHEN 7 THEN '' WHEN 6 THEN '  ' WHEN 5 THEN 'https:///lost/' ELSE '/only/a/path' END AS written, count(*) AS n_rows
        FROM v_links WHERE {_rejected} GROUP BY ALL""",
)
oracle(
    "traffic_unpivot",
    f"""SELECT date, domain, {big('coalesce(v, 0)')} AS traffic FROM
        (SELECT DISTINCT strftime(ts, '%Y-%m-%d') AS date FROM events) CROSS JOIN (SELECT unnest(['click', 'error', 'purchase', 'signup', 'view']) AS domain)
        LEFT JOIN (SELECT strftime(ts, '%Y-%m-%d') AS date, event_type AS domain, sum(floor(value)) AS v FROM events GROUP BY 1, 2) USING (date, domain)""",
)
oracle(
    "href_extract",
    """SELECT url AS page_url, trim(href) AS href, count(*) AS n FROM (SELECT url, unnest(regexp_extract_all(html, '\\shref="([^"]*)"', 1)) AS href FROM pages) GROUP BY 1, 2""",
)
oracle(
    "sitemap_locations",
    """SELECT DISTINCT base || '/sitemap.xml' AS sitemap_url, true AS is_index, base || '/' || lang || '.xml' AS loc FROM v_site_pages
        UNION ALL SELECT base || '/sitemap.xml', true, base || '/sitemap.xml' FROM (SELECT DISTINCT base, lang FROM v_site_pages)
        UNION ALL SELECT base || '/' || lang || '.xml', false, url FROM v_site_pages""",
)
oracle(
    "robots_sitemaps",
    """SELECT site, sitemap_url, count(*) AS n FROM (
        SELECT site, site || '/sitemap.xml' AS sitemap_url FROM v_robots WHERE silent
        UNION ALL SELECT site, site || '/main.xml' FROM v_robots WHERE NOT silent
        UNION ALL SELECT site, site || p || '.xml' FROM v_robots WHERE NOT silent) GROUP BY 1, 2""",
)
oracle("sitemap_frontier", "SELECT DISTINCT base AS site, base || '/' || lang || '.xml' AS sitemap_url FROM v_site_pages")
oracle("sitemap_expand", "SELECT DISTINCT base AS site, url AS page_url FROM v_site_pages")
oracle(
    "mail_merge",
    """SELECT domain, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN '' ELSE 'hello' || c_custkey || '@example.org' END AS "to", 'Partnership' AS subject,
        'Hi Shop' || c_custkey || ' Team,' || chr(10) || 'regards to Shop' || c_custkey AS body
    FROM (SELECT *, 'www.shop' || c_custkey || '.' || lower(c_mktsegment) || '.example' AS domain FROM customer WHERE c_acctbal >= 0)""",
)
oracle(
    "anchor_readings",
    f"""SELECT competitor_domain, {_anchor(rules.NO_ANCHOR)} AS anchor_text, count(*) AS n, {rate('sum(links_in_group)', 'count(*)')} AS mean_links
        FROM v_links GROUP BY 1, 2""",
)
