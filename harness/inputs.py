"""Inputs derived from the given tables, as SQL text both engines accept.

``pages`` has no colours of its own, so styles are woven into its html from
``page_id`` arithmetic; captures, records and archives derive from it too.
"""

from __future__ import annotations

# One domain per category rule, plus near misses.
CATEGORY_DOMAINS = (
    "adelaide.edu.au", "unt.edu", "senate.gov", "af.mil", "culture.gouv.fr", "nasa.gov", "si.edu",
    "wikipedia.org", "en.wikipedia.org", "cern.ch", "github.com", "substack.com", "amazon.com",
    "cnet.com", "europa.eu", "admin.ch", "gov.sk", "163.com",
)

CRAWL = "TEST-2026-08"


_CRLF = "chr(13) || chr(10)"
_LF = "chr(10)"


def text(e: str) -> str:
    return f"CAST({e} AS STRING)"


def hex6(e: str) -> str:
    return f"lower(lpad(hex(({e}) % 16777216), 6, '0'))"


def named(e: str) -> str:
    names = ("navy", "WhiteSmoke", "rebeccapurple", "grey", "tomato", "not-a-colour")
    whens = " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(names))
    return f"CASE ({e}) % {len(names)} {whens} END"


def any_colour(e: str) -> str:
    """A colour value in one of twelve spellings, chosen by ``e``."""
    n = f"({e})"
    cases = [
        f"'rgb(' || {text(f'{n} % 256')} || ', ' || {text(f'{n} * 53 % 256')} || ', ' || {text(f'{n} * 71 % 300')} || ')'",
        f"'rgba(' || {text(f'{n} % 101')} || '% ' || {text(f'{n} * 7 % 101')} || '% ' || {text(f'{n} * 3 % 120')} || '.5% / 0.5)'",
        f"'hsl(' || {text(f'{n} % 400')} || ', ' || {text(f'{n} % 101')} || '%, ' || {text(f'{n} * 3 % 101')} || '%)'",
        f"'HSLA(0.' || {text(f'{n} % 10')} || 'turn ' || {text(f'{n} * 11 % 101')} || '% ' || {text(f'{n} * 13 % 101')} || '% / .3)'",
        f"'#' || substr({hex6(f'{n} * 7919 + 3')}, 1, 3)",
        f"'#' || {hex6(f'{n} * 7919 + 5')} || '80'",
        f"'#' || upper({hex6(f'{n} * 104729 + 11')})",
        f"'#' || substr({hex6(f'{n} * 31337 + 1')}, 1, 4)",
        named(n),
        "'transparent'",
        f"'hsl(' || {text(f'{n} % 7')} || '.25rad, ' || {text(f'{n} % 101')} || '%, 40%)'",
        f"'#' || substr({hex6(f'{n} * 17')}, 1, 5)",
    ]
    whens = " ".join(f"WHEN {i} THEN {c}" for i, c in enumerate(cases))
    return f"CASE {n} % {len(cases)} {whens} END"


def page_css() -> str:
    """A style element of seven rules, a comment and a media block."""
    return " || ".join(
        [
            "'<style type=\"text/css\">/* .off{color:red} */ body{'",
            "pair1",
            "'} a{color:'",
            "c0",
            "';} .b { background: '",
            "c1",
            "' url(x.png) no-repeat }@media (max-width:'",
            text("page_id"),
            "'px){.m{margin:0;color:'",
            "c2",
            "' !important; BACKGROUND-COLOR : '",
            "c3",
            "'}} .dup{'",
            "pair1",
            "'} .g{background:#'",
            hex6("page_id * 97"),
            "';background:url(y.png);color:white;color:#'",
            hex6("page_id * 89"),
            "'} .t{color:#333;background-color:transparent} .e{padding:1px} .few{color:rgb(inf);color:rgb(1e999, 2)} .nl,'",
            _CRLF,
            "'.nl2{color:#123456}</style>'",
        ]
    )


_PAIR = f"'color:#' || {hex6('page_id * 7919 + 1')} || ';background-color:#' || {hex6('page_id * 104729 + 12345')}"
_COLOURS = f"""
SELECT page_id, url, html, {_PAIR} AS pair1, {any_colour('page_id')} AS c0, {named('page_id + 1')} AS c1,
       {any_colour('page_id + 5')} AS c2, {any_colour('page_id * 3 + 1')} AS c3, {any_colour('page_id + 2')} AS c4,
       {any_colour('page_id + 7')} AS c5, {any_colour('page_id + 4')} AS c6,
       CASE WHEN page_id % 23 > 0 THEN '</head>' WHEN page_id % 3 = 0 THEN '<style>.bad{{color:#ggg}}</style></head>'
            WHEN page_id % 3 = 1 THEN '<style>.bad{{color:#1h2345;background:#fff none}} .worse{{background:#"''00}}</style></head>'
            ELSE '<style>.bad{{color:#12345q;background-color:#zz0000}}</style></head>' END AS head
FROM pages
"""


# Every pair far above both thresholds; two or three pairs, so that sites tie.
_COMPLIANT_CSS = """
'<style>body{color:#111;background:#fff} .x{color:#fff;background-color:#0b0b0b}' ||
CASE WHEN page_id % 2 = 0 THEN '' ELSE ' .y{color:#000080}' END || '</style>'
"""


def _woven() -> str:
    replacements = [
        ("'<style>p{margin:0}</style>'", page_css()),
        ("'<div class=\"ad\">'", "'<div class=\"ad\" style=\"c&#00000111;lor&colon; ' || c4 || '; background: ' || c5 || '\">'"),
        (
            "'<article>'",
            "'<article title=\"a>b\" style=''font-family:&quot;x;y&quot;;COLOR:' || c6 || '''>'",
        ),
        ("'<!-- ad'", "'<!-- <p style=\"color:red\"> ad'"),
        ("'track('", "'var s=\"<i style=color:blue>\";track('"),
        ("'</head>'", "head"),
        ("'</head>'", "'<script src=/a/>\"<p style=color:red>\"</script><style media=print/>.pr{color:#765432}</style></head>'"),
    ]
    html = "html"
    for old, new in replacements:
        html = f"replace({html}, {old}, {new})"
    compliant = f"replace(html, '<style>p{{margin:0}}</style>', {_COMPLIANT_CSS})"
    return f"CASE WHEN page_id % 17 = 0 THEN html WHEN page_id % 31 = 5 THEN {compliant} ELSE {html} END"


def audit_domain(n: str = "page_id") -> str:
    """A unique domain per page that reaches every category rule."""
    count = len(CATEGORY_DOMAINS)
    whens = " ".join(f"WHEN {i} THEN '{d}'" for i, d in enumerate(CATEGORY_DOMAINS))
    literal = f"CASE {n} % {count} {whens} END"
    return f"CASE WHEN {n} < {count} THEN {literal} ELSE 'p' || {text(n)} || '.' || {literal} END"


# pages.html with styles; every 17th stays raw, every 23rd is unreadable.
STYLED = f"SELECT page_id, {_woven()} AS html FROM ({_COLOURS}) colours"
SITES = f"SELECT page_id, {audit_domain()} AS domain, html FROM ({STYLED}) styled"

# One colour value per line item, and one explicit pair.
COLOUR_TEXTS = f"""
SELECT l_orderkey, l_linenumber, {any_colour('l_orderkey * 7 + l_linenumber')} AS value FROM lineitem
"""
REPEATED_COLOURS = f"""
SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 3 = 0 THEN 'hsl(200, 30%, 40%)' WHEN l_orderkey % 7 = 1 THEN NULL
       ELSE {any_colour('(l_orderkey % 500 + l_linenumber)')} END AS value FROM lineitem
"""
WIDE_PAIRS = f"""
SELECT l_orderkey, l_linenumber, l_returnflag,
       '#' || {hex6('l_orderkey * 7919 + l_linenumber % 3 * 65793')} AS fg_text,
       '#' || {hex6('l_orderkey * 104729 + l_linenumber % 2 * 4096')} AS bg_text
FROM lineitem
"""

# Capture index rows: several captures per registered domain, and rows that each
# filter drops. Times are microseconds; each engine turns them into timestamps.
_HOST = "split_part(split_part(url, '/', 3), ':', 1)"
_REGISTERED = (
    "CASE WHEN host LIKE '%.%.%.%' THEN substr(host, instr(host, '.') + 1) ELSE host END"
)


def captures(timestamp: str, smallint: str = "SMALLINT") -> str:
    return f"""
SELECT url, host AS url_host_name, {_REGISTERED} AS url_host_registered_domain,
       split_part(url, ':', 1) AS url_protocol,
       CASE WHEN page_id % 7 = 0 THEN '/p' ELSE '/' END AS url_path,
       {timestamp}(1769904000000000 + page_id * 977 % 86400 * 7000000) AS fetch_time,
       CAST(CASE WHEN page_id % 11 = 0 THEN 404 ELSE 200 END AS {smallint}) AS fetch_status,
       'D' || CAST(page_id AS STRING) AS content_digest,
       CASE WHEN page_id % 13 = 0 THEN 'application/pdf' ELSE 'text/html' END AS content_mime_detected,
       'archive-' || CAST(page_id % 50 AS STRING) || '.warc.gz' AS warc_filename,
       CAST(page_id * 1000 AS INT) AS warc_record_offset,
       CAST(length(html) AS INT) AS warc_record_length,
       CASE WHEN page_id % 19 = 0 THEN 'OTHER' ELSE '{CRAWL}' END AS crawl,
       CASE WHEN page_id % 29 = 0 THEN 'robotstxt' ELSE 'warc' END AS subset
FROM (SELECT page_id, url, html, {_HOST} AS host FROM pages) hosts
"""


# The domain list: every registered domain seen, as often not in the crawl.
DOMAIN_LIST = f"""
SELECT DISTINCT {_REGISTERED} AS domain FROM (SELECT {_HOST} AS host FROM pages) hosts
UNION SELECT 'missing' || CAST(page_id AS STRING) || '.example' FROM pages WHERE page_id % 5 = 0
"""

# Archived records: envelope, response headers, body. page_id % 6 selects the
# framing; the last has no blank line at all. Each archive holds filler bytes
# around its record.


def _record(head: list[str], newline: str, body: str) -> str:
    lines = [f"'{h}' || {newline}" if h else newline for h in head]
    return " || ".join([*lines, body])


def record(octets: str) -> str:
    """Record text; ``octets`` is the engine's byte length function."""
    return f"""
CASE page_id % 6
  WHEN 0 THEN {_record(['WARC/1.0', 'WARC-Type: response', '', 'HTTP/1.1 200 OK', 'Content-Type: text/html', ''], _CRLF, 'html')}
  WHEN 1 THEN {_record(['WARC/1.0', '', 'HTTP/1.1 200 OK', 'Content-Type: text/html; charset=UTF-8;', ''], _LF, 'html')}
  WHEN 2 THEN {_record(['WARC/1.0', '', 'HTTP/1.1 200 OK', 'Content-Type: text/html; charset=utf-8', 'Transfer-Encoding: chunked', ''], _CRLF,
                       f"lower(hex({octets}(html))) || ';x=y' || {_CRLF} || html || {_CRLF} || '0' || {_CRLF} || {_CRLF}")}
  WHEN 3 THEN {_record(['WARC/1.0', '', 'HTTP/1.1 200 OK', 'content-type: text/html; charset=no-such-set', ''], _CRLF, 'html')}
  WHEN 4 THEN {_record(['WARC/1.0', '', 'HTTP/1.1 200 OK', 'X-Transfer-Encoding: chunked', ''], _CRLF, 'html')}
  ELSE html
END
"""


SITE = "'site' || CAST(page_id AS STRING) || '.example:80/x'"
ARCHIVES = f"""
SELECT {SITE} AS domain, 'seg/' || CAST(page_id AS STRING) || '.warc' AS filename,
       CAST(page_id % 97 AS BIGINT) AS offset, CAST(octet_length(record) AS BIGINT) AS length,
       encode(repeat('x', CAST(page_id % 97 AS INT)) || record || repeat('y', CAST(page_id % 31 AS INT)), 'UTF-8') AS archive
FROM (SELECT page_id, {record('octet_length')} AS record FROM pages) records
"""

# The same records in archive files of forty pages each. Some are gzip members, one
# in 41 is a cut-off member, one in 43 is listed under a file that does not exist.
ARCHIVED = f"""
SELECT page_id, {SITE} AS domain, 'seg/' || CAST(CAST(floor(page_id / 40) AS BIGINT) AS STRING) || '.warc' AS filename,
       encode(record, 'UTF-8') AS record, page_id % 4 = 1 AS zipped, page_id % 41 = 7 AS broken, page_id % 43 = 9 AS missing
FROM (SELECT page_id, {record('octet_length')} AS record FROM pages) records
"""
UNREADABLE_RECORD = "(page_id % 41 = 7 OR page_id % 43 = 9)"
