"""DuckDB SQL for the registered queries.

Written relationally (unnest, group, window) and with the textbook formulas, not
as a transcript of the Spark plans.
"""

from __future__ import annotations

from harness import inputs
from huescope.functions import categories as cat
from huescope.functions.colours import NAMED_COLOURS

_TOKEN = (
    r"(?is)<!--.*?(?:--\s*>|\z)|<script(?:[\s/][^>]*)?>.*?(?:</\s*script\s*>|\z)"
    r"|(<style(?:[\s/][^>]*)?>.*?(?:</\s*style\s*>|\z)|<[a-z](?:[^\"''>]|\"[^\"]*\"|''[^'']*'')*>)"
    r"|<[!/?][^>]*>"
)
_NUM = r"[+-]?(\d+\.?\d*|\.\d+)(e[+-]?\d+)?"


def _linear(level: float) -> float:
    """The sRGB transfer function, from its definition."""
    return level / 12.92 if level <= 0.04045 else ((level + 0.055) / 1.055) ** 2.4


_LINEAR = "CAST('[" + ", ".join(repr(_linear(c / 255)) for c in range(256)) + "]' AS DOUBLE[])"
_NAMES = "MAP {" + ", ".join(f"'{n}': {v}" for n, v in NAMED_COLOURS.items()) + "}"


def round_to(value: str, places: int) -> str:
    return f"CAST(format('{{:.{places}f}}', {value}) AS DOUBLE)"


def _hex_value(h: str) -> str:
    digit = "(instr('0123456789abcdef', substr({h}, {i}, 1)) - 1)"
    return "(" + " + ".join(f"{digit.format(h=h, i=i + 1)} * {16 ** (5 - i)}" for i in range(6)) + ")"


def coded(source: str, value: str, out: str) -> str:
    """SELECT of ``source`` plus the colour code of column ``value``."""

    def number(x: str) -> str:
        return f"CASE WHEN regexp_full_match({x}, '{_NUM}') THEN TRY_CAST({x} AS DOUBLE) END"

    levels = ", ".join(
        f"CASE WHEN a_[{i}] LIKE '%\\%' ESCAPE '\\' THEN ({number(f'a_[{i}][:-2]')}) * 255 / 100 ELSE {number(f'a_[{i}]')} END AS r{i}_"
        for i in (1, 2, 3)
    )
    clamp = "CAST(trunc(greatest(0.0, least(255.0, r{0}_))) AS INTEGER)"
    channel = "CAST(greatest(0.0, least(255.0, round_even(({0} + m_) * 255, 0))) AS INTEGER)"
    mixes = [("c_", "x_", "0"), ("x_", "c_", "0"), ("0", "c_", "x_"), ("0", "x_", "c_"), ("x_", "0", "c_"), ("c_", "0", "x_")]
    hsl = "CASE " + " ".join(
        f"WHEN h_ < {60 * (i + 1)} THEN {channel.format(r)} * 65536 + {channel.format(g)} * 256 + {channel.format(b)}"
        for i, (r, g, b) in enumerate(mixes)
    ) + " END"
    hue = number("regexp_replace(a_[1], 'deg|turn|rad', '', 'g')")
    return f"""
SELECT * EXCLUDE (n_, d_, a_, r1_, r2_, r3_, h_, s_, l_, c_, x_, m_),
  CAST(CASE
    WHEN n_ LIKE '#%' THEN CASE WHEN d_ IS NULL THEN NULL
      WHEN regexp_full_match(d_, '[0-9a-f]{{6}}') THEN {_hex_value('d_')} ELSE -1 END
    WHEN n_ LIKE 'rgb%' THEN CASE WHEN r1_ IS NULL OR r2_ IS NULL OR r3_ IS NULL THEN NULL
      ELSE {clamp.format(1)} * 65536 + {clamp.format(2)} * 256 + {clamp.format(3)} END
    WHEN n_ LIKE 'hsl%' THEN CASE WHEN h_ IS NULL OR s_ IS NULL OR l_ IS NULL THEN NULL ELSE {hsl} END
    ELSE {_NAMES}[n_] END AS INTEGER) AS {out}
FROM (SELECT *, c_ * (1 - abs((h_ / 60) % 2 - 1)) AS x_, l_ - c_ / 2 AS m_
  FROM (SELECT *, (1 - abs(2 * l_ - 1)) * s_ AS c_
    FROM (SELECT *, {levels},
        (CASE WHEN a_[1] LIKE '%turn%' THEN ({hue}) * 360 WHEN a_[1] LIKE '%rad%' THEN ({hue}) * 180 / pi() ELSE {hue} END) % 360 AS h_,
        ({number("replace(a_[2], '%', '')")}) / 100 AS s_, ({number("replace(a_[3], '%', '')")}) / 100 AS l_
      FROM (SELECT *,
          CASE WHEN length(ltrim(n_, '#')) IN (3, 4) THEN regexp_replace(substr(ltrim(n_, '#'), 1, 3), '(.)', '\\1\\1', 'g')
               WHEN length(ltrim(n_, '#')) IN (6, 8) THEN substr(ltrim(n_, '#'), 1, 6) END AS d_,
          regexp_extract_all(regexp_extract(n_, '^(?:rgb|hsl)a?\\s*\\(([^)]+)\\)', 1), '[^,/\\s]+') AS a_
        FROM (SELECT *, lower(trim({value})) AS n_ FROM {source})))))
"""


def luminance(code: str) -> str:
    def linear(shift: int) -> str:
        return f"{_LINEAR}[({code} >> {shift}) % 256 + 1]"

    return f"(0.2126e0 * {linear(16)} + 0.7152e0 * {linear(8)} + 0.0722e0 * {linear(0)})"


def contrast(fg: str, bg: str) -> str:
    a, b = luminance(fg), luminance(bg)
    return f"((greatest({a}, {b}) + 0.05e0) / (least({a}, {b}) + 0.05e0))"


def rgb(code: str) -> str:
    return f"({code} >> 16) % 256, ({code} >> 8) % 256, {code} % 256"


def upper_median(value: str, where: str = "true") -> str:
    return (
        f"list_sort(list({value}) FILTER ({where} AND {value} IS NOT NULL))"
        f"[CAST(count({value}) FILTER ({where}) // 2 + 1 AS BIGINT)]"
    )


# --- pages to results, as a chain of common table expressions ---------------

TOKENS = rf"""
SELECT page_id, unnest(toks) AS tok, CAST(unnest(range(len(toks))) AS INTEGER) AS block
FROM (SELECT page_id, list_filter(regexp_extract_all(replace(replace(html, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '{_TOKEN}', 1),
        lambda t: regexp_matches(t, '(?i)^<style[\s/>]|\sstyle\s*=')) AS toks FROM styled)
"""
BLOCKS = r"""
SELECT page_id, block, regexp_extract(tok, '(?is)^<style[^>]*>(.*)</\s*style\s*>$', 1) AS css
FROM tokens WHERE regexp_matches(tok, '(?is)^<style[\s/>].*</\s*style\s*>$')
"""
INLINE = r"""
SELECT page_id, block, replace(replace(replace(replace(replace(replace(s[2:-2], '&#00000111;', 'o'), '&colon;', ':'), '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&') AS style
FROM (SELECT page_id, block, regexp_extract(tok, '(?is)\sstyle\s*=\s*("[^"]*"|''[^'']*'')', 1) AS s
      FROM tokens WHERE NOT regexp_matches(tok, '(?i)^<style'))
WHERE length(s) > 2
"""
RULES = r"""
SELECT page_id, block, CAST(unnest(range(len(sel))) AS INTEGER) AS rule, trim(unnest(sel), E' \n\t') AS selector, unnest(body) AS body
FROM (SELECT page_id, block, regexp_extract_all(css, '([^{}]+)\{([^{}]*)\}', 1) AS sel,
             regexp_extract_all(css, '([^{}]+)\{([^{}]*)\}', 2) AS body
      FROM (SELECT page_id, block, regexp_replace(css, '(?s)/\*.*?\*/', '', 'g') AS css FROM blocks))
"""
BODIES = """
SELECT page_id, 0 AS kind, block, rule, selector, body FROM rules
UNION ALL SELECT page_id, 1, block, 0, '[inline]', style FROM inlines
"""
PROPS = r"""
SELECT page_id, kind, block, rule, selector, pos, lower(trim(split_part(prop, ':', 1))) AS name,
       regexp_replace(trim(substr(prop, instr(prop, ':') + 1)), '(?i)\s*!important\s*$', '') AS value
FROM (SELECT page_id, kind, block, rule, selector, unnest(p) AS prop, unnest(range(len(p))) AS pos
      FROM (SELECT *, regexp_split_to_array(body, ';\s*') AS p FROM bodies))
WHERE instr(prop, ':') > 0
"""
_NAMED_TOKEN = f"list_filter(regexp_split_to_array(lower(value), '\\s+'), lambda t: {_NAMES}[t] IS NOT NULL)[1]"
CHOSEN = rf"""
SELECT *, CASE WHEN name = 'background' AND whole IS NULL THEN coalesce(
    nullif(regexp_extract(value, '(#[0-9a-fA-F]{{3,8}})\b', 1), ''),
    nullif(regexp_extract(value, '(?i)((?:rgb|hsl)a?\s*\([^)]+\))', 1), ''), {_NAMED_TOKEN})
  ELSE value END AS chosen
FROM ({coded("(SELECT * FROM props WHERE name IN ('color', 'background', 'background-color'))", "value", "whole")})
"""
DECLS = """
SELECT page_id, kind, block, rule, any_value(selector) AS selector,
       nullif(arg_max(chosen, pos) FILTER (name = 'color'), '') AS color,
       nullif(arg_max(chosen, pos) FILTER (name <> 'color' AND chosen IS NOT NULL), '') AS background,
       coalesce(bool_or(whole = -1) FILTER (name = 'background'), false) AS unreadable
FROM chosen GROUP BY page_id, kind, block, rule
"""
KEPT = "SELECT * FROM decls WHERE color IS NOT NULL OR background IS NOT NULL OR unreadable"
CODED = coded(f"({coded('kept', 'color', 'fg')})", "background", "bg")
STATUS = r"""
SELECT s.page_id, CASE WHEN text IS NULL THEN 'analysed' ELSE 'error' END AS status,
       'invalid literal for int() with base 16: ''' || list_filter([d[1:2], d[3:4], d[5:6]],
           lambda p: NOT regexp_full_match(p, '[0-9a-f]{2}|[\s+][0-9a-f]|[0-9a-f]\s'))[1] || '''' AS error
FROM styled s LEFT JOIN (
    SELECT page_id, text, CASE WHEN length(text) <= 5 THEN regexp_replace(text[2:4], '(.)', '\1\1', 'g') ELSE text[2:7] END AS d
    FROM (SELECT page_id, arg_min(lower(text), (stage, kind, block, rule, side)) AS text FROM (
        SELECT page_id, 0 AS stage, kind, block, rule, pos AS side, value AS text FROM chosen WHERE name = 'background' AND whole = -1
        UNION ALL SELECT page_id, 1, kind, block, rule, 0, color FROM coded WHERE fg = -1
        UNION ALL SELECT page_id, 1, kind, block, rule, 1, background FROM coded WHERE bg = -1) GROUP BY page_id)
) f USING (page_id)
"""
PAIRS = """
SELECT page_id, kind, block, rule, selector,
       CASE WHEN fg IS NULL THEN '#000000 (assumed)' ELSE color END AS foreground,
       CASE WHEN bg IS NULL THEN '#ffffff (assumed)' ELSE background END AS background,
       coalesce(fg, 0) AS fg, coalesce(bg, 16777215) AS bg, fg IS NOT NULL AND bg IS NOT NULL AS explicit
FROM coded WHERE (fg IS NOT NULL OR bg IS NOT NULL) AND page_id IN (SELECT page_id FROM status WHERE status = 'analysed')
"""
CLASSIFIED = f"""
SELECT * EXCLUDE (exact), {round_to('exact', 2)} AS ratio, exact >= 4.5 AS pass_normal, exact >= 3.0 AS pass_large
FROM (SELECT *, {contrast('fg', 'bg')} AS exact FROM pairs)
"""
DISTINCT_PAIRS = """
SELECT * FROM classified
QUALIFY row_number() OVER (PARTITION BY page_id, fg, bg ORDER BY kind, block, rule) = 1
"""
PAGE_SUMMARY = f"""
SELECT page_id, count(*) AS total_pairings,
       count(*) FILTER (pass_normal) AS pass_normal, count(*) FILTER (NOT pass_normal) AS fail_normal,
       count(*) FILTER (pass_large) AS pass_large, count(*) FILTER (NOT pass_large) AS fail_large,
       {round_to('count(*) FILTER (pass_normal) / count(*) * 100', 1)} AS pass_rate_normal,
       {round_to('count(*) FILTER (pass_large) / count(*) * 100', 1)} AS pass_rate_large,
       min(ratio) AS worst_ratio, max(ratio) AS best_ratio, {upper_median('ratio')} AS median_ratio,
       {round_to('sum(CAST(round(ratio * 100) AS BIGINT)) / 100e0 / count(*)', 2)} AS mean_ratio
FROM distinct_pairs GROUP BY page_id
"""
WORST = """
SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY ratio, kind, block, rule) AS place
FROM distinct_pairs WHERE NOT pass_normal QUALIFY place <= 5
"""
_COUNTS = ("total_pairings", "pass_normal", "fail_normal", "pass_large", "fail_large")
_STATS = ("pass_rate_normal", "pass_rate_large", "worst_ratio", "best_ratio", "median_ratio", "mean_ratio")
RESULTS = f"""
SELECT s.page_id, s.domain, coalesce(t.status, 'analysed') AS status,
       t.error, {', '.join(f"CASE WHEN t.status IS DISTINCT FROM 'error' THEN coalesce(p.{c}, 0) END AS {c}" for c in _COUNTS)},
       {', '.join(f"CASE WHEN t.status IS DISTINCT FROM 'error' THEN p.{c} END AS {c}" for c in _STATS)},
       CASE WHEN t.status IS DISTINCT FROM 'error' THEN w.foreground END AS worst_fg,
       CASE WHEN t.status IS DISTINCT FROM 'error' THEN w.background END AS worst_bg,
       CASE WHEN t.status IS DISTINCT FROM 'error' THEN w.ratio END AS worst_pair_ratio
FROM ({inputs.SITES}) s LEFT JOIN status t USING (page_id) LEFT JOIN page_summary p USING (page_id)
LEFT JOIN (SELECT * FROM worst WHERE place = 1) w USING (page_id)
"""
_CHAIN = {
    "styled": inputs.STYLED, "tokens": TOKENS, "blocks": BLOCKS, "inlines": INLINE, "rules": RULES,
    "bodies": BODIES, "props": PROPS, "chosen": CHOSEN, "decls": DECLS, "kept": KEPT, "coded": CODED,
    "status": STATUS, "pairs": PAIRS, "classified": CLASSIFIED, "distinct_pairs": DISTINCT_PAIRS,
    "page_summary": PAGE_SUMMARY, "worst": WORST, "results": RESULTS,
    "coloured": "SELECT * FROM results WHERE status = 'analysed' AND total_pairings > 0",
}


def chain(last: str, select: str) -> str:
    """``select`` over the chain up to and including ``last``."""
    parts, done = [], False
    for name, body in _CHAIN.items():
        if not done:
            parts.append(f"{name} AS MATERIALIZED ({body})")
        done = done or name == last
    return "WITH " + ",\n".join(parts) + f"\n{select}"


def category(d: str) -> str:
    def ends(suffixes: tuple[str, ...]) -> str:
        return "(" + " OR ".join(f"suffix({d}, '{s}')" for s in suffixes) + ")"

    def among(names: tuple[str, ...]) -> str:
        return f"{d} IN (" + ", ".join(f"'{n}'" for n in names) + ")"

    return f"""CASE
  WHEN {ends(cat.EDUCATION_SUFFIXES)} OR contains({d}, '.edu.') THEN 'Education'
  WHEN {ends(cat.GOVERNMENT_SUFFIXES)} OR contains({d}, '.gov') THEN 'Government'
  WHEN {among(cat.OPEN_KNOWLEDGE)} OR {ends(tuple('.' + w for w in cat.OPEN_KNOWLEDGE))} THEN 'Open Knowledge'
  WHEN {among(cat.RESEARCH)} THEN 'Research' WHEN {among(cat.TECHNOLOGY)} THEN 'Technology'
  WHEN {among(cat.HOSTING)} THEN 'Hosting/Platform' WHEN {among(cat.COMMERCE)} THEN 'E-commerce'
  WHEN {among(cat.MEDIA)} THEN 'News/Media' WHEN suffix({d}, '.eu') THEN 'EU Institutions' ELSE 'Other' END"""


CAPTURES = inputs.captures("make_timestamp")
HOMEPAGES = f"""
SELECT * FROM ({CAPTURES}) WHERE crawl = '{inputs.CRAWL}' AND subset = 'warc' AND fetch_status = 200
AND url_path = '/' AND content_mime_detected = 'text/html'
"""
PICKED = f"""
SELECT * FROM ({HOMEPAGES}) WHERE url_host_registered_domain IN (SELECT domain FROM ({inputs.DOMAIN_LIST}))
QUALIFY row_number() OVER (PARTITION BY url_host_registered_domain ORDER BY
  CASE WHEN url_host_name = url_host_registered_domain OR url_host_name = 'www.' || url_host_registered_domain THEN 0 ELSE 1 END,
  CASE WHEN url_protocol = 'https' THEN 0 ELSE 1 END, fetch_time DESC, url, warc_filename, warc_record_offset) = 1
"""
LOOKUP_ROWS = f"""
SELECT url_host_registered_domain AS domain, url, strftime(fetch_time, '%Y-%m-%d %H:%M:%S.%g') AS fetch_time,
       warc_filename, warc_record_offset, warc_record_length, content_mime_detected, content_digest
FROM ({PICKED})
"""
FOUND = f"""
SELECT 'found' AS status, domain, url, fetch_time AS timestamp, warc_filename AS filename,
       CAST(warc_record_offset AS BIGINT) AS "offset", CAST(warc_record_length AS BIGINT) AS length,
       content_mime_detected AS mime, content_digest AS digest
FROM ({LOOKUP_ROWS})
"""
INDEX = f"""
SELECT * FROM ({FOUND}) UNION ALL
SELECT 'not_found', domain, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM ({inputs.DOMAIN_LIST})
WHERE domain NOT IN (SELECT domain FROM ({FOUND}))
"""
RECORDS = f"""
SELECT {inputs.SITE} AS domain, 'seg/' || CAST(page_id AS STRING) || '.warc' AS filename, record,
       CAST(strlen(record) AS BIGINT) AS length
FROM (SELECT page_id, {inputs.record('strlen')} AS record FROM pages)
"""
# Expected outcome of decoding each record.
FETCH_LOG = f"""
SELECT 'site' || CAST(page_id AS VARCHAR) || '.example:80/x' AS domain,
       CASE WHEN {inputs.UNREADABLE_RECORD} THEN 'error' WHEN page_id % 6 < 4 THEN 'ok' ELSE 'failed' END AS status,
       CASE WHEN page_id % 6 < 4 AND NOT {inputs.UNREADABLE_RECORD} THEN CAST(length(html) AS BIGINT) END AS size,
       {inputs.UNREADABLE_RECORD} AS has_error
FROM pages
"""
