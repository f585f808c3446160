"""Check SQL per registered query; column names equal those of the query."""

from __future__ import annotations

from harness import inputs
from harness import oracles as o
from harness.oracles import chain, round_to, upper_median

_INDEX_SCAN = f"""
SELECT url, url_host_name, CAST(NULL AS INTEGER) AS url_port, fetch_status, warc_record_offset, crawl, subset
FROM ({o.CAPTURES})
"""
_RANKED = f"SELECT CAST(page_id + 1 AS INTEGER) AS rank, {inputs.audit_domain()} AS domain FROM pages"
_CAPTURE = "url, url_host_registered_domain, url_protocol, content_digest"
_STYLESHEET = "page_id, block, rule, selector, color, background, unreadable"
_DECL = "page_id, kind, block, rule, selector, color, background, unreadable"
_RESULT = (
    "domain, status, error, total_pairings, pass_normal, fail_normal, pass_large, fail_large, "
    "pass_rate_normal, pass_rate_large, worst_ratio, best_ratio, median_ratio, mean_ratio"
)
_WORST = "worst_fg, worst_bg, worst_pair_ratio"
_PAIR = "foreground, background, ratio, pass_normal, pass_large, explicit, selector"
_PAIR_LIST = f"""
(SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY kind, block, rule) - 1 AS INTEGER) AS at, {_PAIR}
 FROM distinct_pairs WHERE page_id NOT IN (SELECT page_id FROM status WHERE status = 'error'))
"""


def _parsed(prefix: str | None, texts: str = inputs.COLOUR_TEXTS) -> str:
    code = "code" if prefix is None else f"CASE WHEN lower(value) LIKE '{prefix}%' THEN code END"
    if prefix == "":
        code = "CASE WHEN NOT regexp_matches(lower(value), '^(#|rgb|hsl)') THEN code END"
    return f"""
SELECT l_orderkey, l_linenumber, value, CASE WHEN c >= 0 THEN (c >> 16) % 256 END AS r,
       CASE WHEN c >= 0 THEN (c >> 8) % 256 END AS g, CASE WHEN c >= 0 THEN c % 256 END AS b,
       coalesce(c = -1, false) AS unreadable
FROM (SELECT *, {code} AS c FROM ({o.coded(f'({texts})', 'value', 'code')}))
"""


_WIDE = f"""
SELECT l_orderkey, l_linenumber, fg, bg
FROM ({o.coded('(' + o.coded(f'({inputs.WIDE_PAIRS})', 'fg_text', 'fg') + ')', 'bg_text', 'bg')})
"""
_SHORTHANDS = f"""
SELECT l_orderkey, l_linenumber, 'background' AS name,
       CASE WHEN l_linenumber % 2 = 0 THEN value ELSE 'url(a.png) ' || value || ' no-repeat' END AS value
FROM ({inputs.COLOUR_TEXTS})
"""
_SHORTHAND = f"""
WITH props AS ({_SHORTHANDS})
SELECT l_orderkey, l_linenumber, value, nullif(chosen, '') AS background, coalesce(whole = -1, false) AS unreadable
FROM ({o.CHOSEN})
"""
_HSL = """
SELECT l_orderkey, l_linenumber, CAST(round_even((r + m) * 255, 0) AS INTEGER) AS r,
       CAST(round_even((g + m) * 255, 0) AS INTEGER) AS g, CAST(round_even((b + m) * 255, 0) AS INTEGER) AS b
FROM (SELECT *,
        CASE WHEN h < 60 OR h >= 300 THEN c WHEN h < 120 OR h >= 240 THEN x ELSE 0 END AS r,
        CASE WHEN h < 60 THEN x WHEN h < 180 THEN c WHEN h < 240 THEN x ELSE 0 END AS g,
        CASE WHEN h < 120 THEN 0 WHEN h < 180 THEN x WHEN h < 300 THEN c ELSE x END AS b
      FROM (SELECT *, c * (1 - abs((h / 60) % 2 - 1)) AS x, l - c / 2 AS m
            FROM (SELECT *, (1 - abs(2 * l - 1)) * s AS c
                  FROM (SELECT l_orderkey, l_linenumber, CAST(l_orderkey % 720 + 0.5 AS DOUBLE) % 360 AS h,
                               l_linenumber / 8e0 AS s, l_quantity / 50e0 AS l FROM lineitem))))
"""
_DEDUP_WIDE = f"""
SELECT l_orderkey, l_linenumber, fg & 16316664 AS fg, bg, l_returnflag
FROM ({_WIDE}) w JOIN lineitem USING (l_orderkey, l_linenumber)
QUALIFY row_number() OVER (PARTITION BY l_returnflag, fg & 16316664, bg ORDER BY l_orderkey, l_linenumber) = 1
"""
_CORPUS = """
count(*) AS total_domains_in_list, count(*) FILTER (status = 'analysed') AS domains_analysed,
count(*) FILTER (status = 'analysed' AND total_pairings > 0) AS domains_with_color_data,
count(*) FILTER (status = 'analysed' AND total_pairings = 0) AS domains_no_color_data,
count(*) FILTER (status <> 'analysed') AS domains_failed
"""
_TOTALS = """
CAST(sum(total_pairings) AS BIGINT) AS total_unique_pairings, CAST(sum(fail_normal) AS BIGINT) AS total_failing_normal,
CAST(sum(fail_large) AS BIGINT) AS total_failing_large
"""


def _mean(rate: str) -> str:
    return round_to(f"sum(CAST(round({rate} * 10) AS BIGINT)) / 10e0 / count({rate})", 1)


_RATES = f"""
{_mean('pass_rate_normal')} AS mean_pass_rate_normal, {upper_median('pass_rate_normal')} AS median_pass_rate_normal,
min(pass_rate_normal) AS min_pass_rate_normal, max(pass_rate_normal) AS max_pass_rate_normal,
{_mean('pass_rate_large')} AS mean_pass_rate_large, {upper_median('pass_rate_large')} AS median_pass_rate_large
"""


def _share(condition: str) -> str:
    return round_to(f"count(*) FILTER (pass_rate_normal {condition}) / count(*) * 100", 1)


_SHARES = f"""
{_share('= 100')} AS pct_fully_compliant_normal, {_share('>= 90')} AS pct_above_90_normal,
{_share('>= 75')} AS pct_above_75_normal, {_share('< 50')} AS pct_below_50_normal
"""
_BOUNDS = ("< 25", "BETWEEN 25 AND 49.95", "BETWEEN 50 AND 74.95", "BETWEEN 75 AND 89.95", "BETWEEN 90 AND 99.95", "= 100")
_BUCKET_NAMES = ("0-25%", "25-50%", "50-75%", "75-90%", "90-99%", "100%")
_HISTOGRAM = " UNION ALL ".join(
    f"SELECT {i} AS position, '{n}' AS bucket, count(*) AS sites FROM coloured WHERE pass_rate_normal {b}"
    for i, (n, b) in enumerate(zip(_BUCKET_NAMES, _BOUNDS))
)
_CATEGORIES = f"""
SELECT {o.category('domain')} AS category, count(*) AS "count", {_mean('pass_rate_normal')} AS avg_pass_rate,
       {upper_median('pass_rate_normal')} AS median_pass_rate,
       count(*) FILTER (pass_rate_normal = 100) AS fully_compliant, count(*) FILTER (pass_rate_normal < 50) AS below_50_pct
FROM coloured GROUP BY 1
"""
_OFFENDERS = f"""
SELECT domain, pass_rate_normal, total_pairings, fail_normal, worst_ratio, {_WORST}
FROM coloured ORDER BY pass_rate_normal, domain LIMIT 20
"""
_COMPLIANT = """
SELECT domain, total_pairings, mean_ratio FROM coloured WHERE pass_rate_normal = 100
ORDER BY total_pairings DESC, domain LIMIT 30
"""
_SUMMARY = f"""
SELECT '{inputs.CRAWL}' AS crawl_id, a.*, c.*, names.*, worst.*, compliant.*
FROM (SELECT {_CORPUS} FROM results) a,
     (SELECT {_TOTALS}, {_RATES}, {_SHARES}, min(worst_ratio) AS min_worst_ratio_across_sites,
        {', '.join(f'count(*) FILTER (pass_rate_normal {b}) AS bucket_{i}' for i, b in enumerate(_BOUNDS))} FROM coloured) c,
     (SELECT string_agg(category, ',' ORDER BY category) AS category_names FROM ({_CATEGORIES})) names,
     (SELECT string_agg(domain, ',' ORDER BY pass_rate_normal, domain) AS worst_domains FROM ({_OFFENDERS})) worst,
     (SELECT coalesce(string_agg(domain, ',' ORDER BY total_pairings DESC, domain), '') AS compliant_domains
      FROM ({_COMPLIANT})) compliant
"""
_FLAGS = """
CASE WHEN pass_rate_normal = 100 THEN 'Yes' ELSE 'No' END AS fully_compliant_normal,
CASE WHEN pass_rate_large = 100 THEN 'Yes' ELSE 'No' END AS fully_compliant_large
"""
_REPORT = f"""
SELECT row_number() OVER (ORDER BY domain) AS rank, domain, {o.category('domain')} AS category, total_pairings,
       pass_normal, fail_normal, pass_rate_normal, pass_large, fail_large, pass_rate_large,
       worst_ratio, median_ratio, mean_ratio, {_FLAGS}
FROM coloured
"""
_SITE = inputs.SITE
_READ = f"NOT {inputs.UNREADABLE_RECORD}"
_BODY_DIGEST = f"SELECT {_SITE} AS domain, md5(html) AS digest FROM pages WHERE page_id % 6 = 2 AND {_READ}"

CHECKS: dict[str, str] = {
    # scans, sources, sinks
    "scan_domain_list": _RANKED,
    "scan_capture_index": _INDEX_SCAN,
    "register_capture_table": _INDEX_SCAN,
    "register_capture_partition": f"SELECT * FROM ({_INDEX_SCAN}) WHERE crawl = '{inputs.CRAWL}' AND subset = 'warc'",
    "import_capture_csv": o.INDEX,
    "write_index_json": o.INDEX,
    "slice_records": f"SELECT domain, length, md5(record) AS digest FROM ({o.RECORDS})",
    "write_pages": f"SELECT {_SITE} AS domain, html FROM pages WHERE page_id % 6 < 4 AND {_READ}",
    "scan_pages": f"SELECT replace({_SITE}, ':80/', '_80_') AS domain, html FROM pages",
    "write_fetch_log": o.FETCH_LOG,
    "write_results": chain("results", f"SELECT {_RESULT}, {_WORST} FROM results"),
    "write_results_full": chain(
        "distinct_pairs",
        f"SELECT s.domain, p.at, {_PAIR} FROM {_PAIR_LIST} p JOIN ({inputs.SITES}) s USING (page_id)",
    ),
    "audit_summary": chain("coloured", _SUMMARY),
    "write_summary_json": chain("coloured", _SUMMARY),
    "write_report_csv": chain("coloured", _REPORT),
    # captures
    "filter_homepage_captures": f"SELECT {_CAPTURE} FROM ({o.HOMEPAGES})",
    "filter_domain_in": f"SELECT {_CAPTURE} FROM ({o.CAPTURES}) WHERE url_host_registered_domain NOT LIKE '%.example.net'",
    "pick_homepage": f"SELECT {_CAPTURE} FROM ({o.PICKED})",
    "project_captures": o.LOOKUP_ROWS.replace(o.PICKED, o.CAPTURES),
    "normalise_captures": f"SELECT * REPLACE ('text/html' AS mime, '' AS digest) FROM ({o.FOUND})",
    "mark_not_found": f"SELECT status, domain, url FROM ({o.INDEX})",
    "homepage_lookup": o.INDEX,
    "bucketed_lookup": o.INDEX,
    "filter_found": f'SELECT domain, url, "offset", length FROM ({o.FOUND})',
    "lookup_counts": f"""SELECT (SELECT count(*) FROM ({o.FOUND})) AS found,
        (SELECT count(*) FROM ({o.INDEX}) WHERE status = 'not_found') AS not_found,
        (SELECT count(*) FROM ({inputs.DOMAIN_LIST})) AS listed""",
    # records
    "safe_name": f"SELECT {_SITE} AS domain, replace(replace({_SITE}, '/', '_'), ':', '_') AS name FROM pages",
    "resume_pending": f"SELECT page_id, {_SITE} AS domain FROM pages WHERE page_id % 3 <> 0",
    "join_index_to_archive": f"SELECT domain, filename, CAST(length AS INTEGER) AS size FROM ({o.RECORDS})",
    "read_records": f"""SELECT {_SITE} AS domain, CASE WHEN page_id % 43 <> 9 AND page_id % 4 <> 1 AND page_id % 41 <> 7
        THEN md5(record) END AS plain_digest, page_id % 43 = 9 AS missing
        FROM (SELECT page_id, {inputs.record('strlen')} AS record FROM pages)""",
    "fetch_pages": f"""SELECT domain, status, size, has_error, html FROM ({o.FETCH_LOG})
        JOIN (SELECT {_SITE} AS domain, CASE WHEN page_id % 6 < 4 AND {_READ} THEN html END AS html FROM pages) USING (domain)""",
    "resume_fetch": f"""SELECT domain, status, size, has_error, html FROM ({o.FETCH_LOG})
        JOIN (SELECT {_SITE} AS domain, CASE WHEN page_id % 6 < 4 AND {_READ} THEN html END AS html FROM pages) USING (domain)""",
    "decode_records": f"""SELECT {_SITE} AS domain, CASE WHEN page_id % 6 < 4 AND {_READ} THEN html END AS html,
        CASE WHEN {inputs.UNREADABLE_RECORD} THEN 'error' WHEN page_id % 6 < 4 THEN 'ok' ELSE 'failed' END AS status FROM pages""",
    "record_charset": f"""SELECT {_SITE} AS domain, CASE WHEN {inputs.UNREADABLE_RECORD} OR page_id % 6 = 5 THEN NULL
        WHEN page_id % 6 = 3 THEN 'no-such-set' ELSE 'utf-8' END AS charset FROM pages""",
    "detect_chunked": f"""SELECT {_SITE} AS domain, CASE WHEN page_id % 6 < 5 AND {_READ} THEN page_id % 6 IN (2, 4) END AS chunked
        FROM pages""",
    "detect_chunked_anchored": f"""SELECT {_SITE} AS domain, CASE WHEN page_id % 6 < 5 AND {_READ} THEN page_id % 6 = 2 END AS chunked
        FROM pages""",
    "response_headers": f"""SELECT domain, name, texts FROM (
        SELECT {_SITE} AS domain, unnest(CASE page_id % 6
            WHEN 0 THEN ['http/1.1 200 ok', 'content-type'] WHEN 1 THEN ['http/1.1 200 ok', 'content-type']
            WHEN 2 THEN ['http/1.1 200 ok', 'content-type', 'transfer-encoding'] WHEN 3 THEN ['http/1.1 200 ok', 'content-type']
            ELSE ['http/1.1 200 ok', 'x-transfer-encoding'] END) AS name, unnest(CASE page_id % 6
            WHEN 0 THEN ['', 'text/html'] WHEN 1 THEN ['', 'text/html; charset=utf-8;']
            WHEN 2 THEN ['', 'text/html; charset=utf-8', 'chunked'] WHEN 3 THEN ['', 'text/html; charset=no-such-set']
            ELSE ['', 'chunked'] END) AS texts
        FROM pages WHERE page_id % 6 < 5 AND {_READ})""",
    "dechunk_bodies": f"{_BODY_DIGEST} UNION ALL SELECT {_SITE}, NULL FROM pages WHERE page_id % 6 = 4 AND {_READ}",
    "record_status": o.FETCH_LOG,
    "fetch_counts": f"""SELECT count(*) FILTER (status = 'ok') AS fetched, count(*) FILTER (status <> 'ok') AS failed
        FROM ({o.FETCH_LOG})""",
    # styles and declarations
    "extract_style_blocks": chain("blocks", "SELECT page_id, block, css FROM blocks"),
    "extract_inline_styles": chain("inlines", "SELECT page_id, block, style FROM inlines"),
    "strip_css_comments": chain(
        "blocks",
        r"SELECT page_id, block, regexp_replace(css, '(?s)/\*.*?\*/', '', 'g') AS css FROM blocks",
    ),
    "parse_css_rules": chain("rules", "SELECT * FROM rules"),
    "parse_declarations": chain("decls", f"SELECT {_STYLESHEET} FROM decls WHERE kind = 0"),
    "filter_declarations": chain("kept", f"SELECT {_STYLESHEET} FROM kept WHERE kind = 0"),
    "inline_declarations": chain("kept", f"SELECT {_DECL} FROM kept WHERE kind = 1"),
    "union_declarations": chain("kept", f"SELECT {_DECL} FROM kept"),
    "background_shorthand": _SHORTHAND,
    # colours
    "parse_hex": _parsed("#"),
    "parse_rgb": _parsed("rgb"),
    "parse_hsl": _parsed("hsl"),
    "named_colour": _parsed(""),
    "parse_colour": _parsed(None),
    "parse_colour_once": _parsed(None, inputs.REPEATED_COLOURS),
    "hsl_to_rgb": _HSL,
    "relative_luminance": f"SELECT l_orderkey, l_linenumber, {o.luminance('fg')} AS luminance FROM ({_WIDE})",
    "contrast_ratio": f"SELECT l_orderkey, l_linenumber, {o.contrast('fg', 'bg')} AS contrast FROM ({_WIDE})",
    # pairings and pages
    "build_pairings": chain("pairs", "SELECT * FROM pairs"),
    "classify_pairs": f"""WITH pairs AS ({_WIDE}) SELECT * EXCLUDE (fg, bg) FROM ({o.CLASSIFIED})""",
    "dedup_pairings": chain("distinct_pairs", "SELECT * FROM distinct_pairs"),
    "dedup_pairings_wide": _DEDUP_WIDE,
    "filter_failing_pairings": chain(
        "distinct_pairs",
        "SELECT page_id, fg, bg, ratio, kind, block, rule FROM distinct_pairs WHERE NOT pass_normal",
    ),
    "worst_pairings_topk": chain(
        "worst", "SELECT page_id, CAST(place AS INTEGER) AS place, foreground, background, ratio, selector FROM worst"
    ),
    "page_contrast_summary": chain("page_summary", "SELECT * FROM page_summary"),
    "page_summary_empty": chain(
        "page_summary",
        "SELECT page_id, "
        + ", ".join(f"coalesce(p.{c}, 0) AS {c}" for c in ("total_pairings", "pass_normal", "fail_normal", "pass_large", "fail_large"))
        + ", pass_rate_normal, pass_rate_large, worst_ratio, best_ratio, median_ratio, mean_ratio"
        + " FROM styled LEFT JOIN page_summary p USING (page_id)",
    ),
    "page_error_status": chain("status", "SELECT * FROM status"),
    "page_pairing_list": chain("distinct_pairs", f"SELECT * FROM {_PAIR_LIST}"),
    "page_audit": chain("results", f"SELECT {_RESULT}, {_WORST} FROM results"),
    "analyse_pages_compact": chain(
        "results",
        f"SELECT {_RESULT}, CASE WHEN total_pairings > 0 THEN CAST(least(fail_normal, 5) AS INTEGER) END AS worst_listed FROM results",
    ),
    "upper_median_by_flag": f"""SELECT l_returnflag, l_linestatus, {upper_median('l_quantity')} AS median
        FROM lineitem GROUP BY ALL""",
    "half_even_rounding": f"""SELECT l_orderkey, l_linenumber, {round_to('l_extendedprice * l_discount', 1)} AS one_place,
        {round_to('l_quantity / 8e0', 2)} AS two_places FROM lineitem""",
    # report
    "filter_analysed": chain("results", "SELECT domain, total_pairings FROM results WHERE status = 'analysed'"),
    "filter_with_colours": chain("coloured", "SELECT domain, total_pairings FROM coloured"),
    "analysis_counts": chain(
        "coloured",
        """SELECT (SELECT count(*) FROM results WHERE status = 'analysed') AS analysed,
        (SELECT count(*) FROM coloured) AS with_colours""",
    ),
    "corpus_counts": chain("results", f"SELECT {_CORPUS} FROM results"),
    "pairing_totals": chain("coloured", f"SELECT {_TOTALS} FROM coloured"),
    "rate_stats": chain("coloured", f"SELECT {_RATES} FROM coloured"),
    "threshold_shares": chain("coloured", f"SELECT {_SHARES} FROM coloured"),
    "pass_rate_histogram": chain("coloured", _HISTOGRAM),
    "category_rollup": chain("coloured", _CATEGORIES),
    "sort_categories": chain("coloured", f"SELECT category, avg_pass_rate FROM ({_CATEGORIES}) ORDER BY 2 DESC, 1"),
    "worst_offenders": chain("coloured", _OFFENDERS),
    "fully_compliant_sites": chain("coloured", _COMPLIANT),
    "min_worst_ratio": chain("coloured", "SELECT min(worst_ratio) AS min_worst_ratio_across_sites FROM coloured"),
    "summary_empty_guard": chain(
        "coloured",
        """SELECT 'all' AS population, count(*) AS domains_with_color_data, CAST(NULL AS VARCHAR) AS error FROM coloured
        UNION ALL SELECT 'colourless', NULL, 'No domains with color data found'""",
    ),
    "categorise_domains": f"SELECT rank, domain, {o.category('domain')} AS category FROM ({_RANKED})",
    "compliance_flags": chain("coloured", f"SELECT domain, {_FLAGS} FROM coloured"),
    "report_rank": chain(
        "coloured", "SELECT row_number() OVER (ORDER BY domain) AS rank, domain, total_pairings FROM coloured"
    ),
    "audit_report": chain("coloured", _REPORT),
}
