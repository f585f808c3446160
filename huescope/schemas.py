"""Declared schemas of the tables that pass between the jobs."""

from __future__ import annotations

# Columns of the capture index, in file order.
CAPTURE_COLUMNS = """
url_surtkey STRING
url STRING
url_host_name STRING
url_host_tld STRING
url_host_2nd_last_part STRING
url_host_3rd_last_part STRING
url_host_4th_last_part STRING
url_host_5th_last_part STRING
url_host_registry_suffix STRING
url_host_registered_domain STRING
url_host_private_suffix STRING
url_host_private_domain STRING
url_protocol STRING
url_port INT
url_path STRING
url_query STRING
fetch_time TIMESTAMP
fetch_status SMALLINT
fetch_redirect STRING
content_digest STRING
content_mime_type STRING
content_mime_detected STRING
content_charset STRING
content_languages STRING
content_truncated STRING
warc_filename STRING
warc_record_offset INT
warc_record_length INT
warc_segment STRING
"""
CAPTURE_PARTITIONS = "crawl STRING, subset STRING"


def capture_columns() -> str:
    return ", ".join(line for line in CAPTURE_COLUMNS.split("\n") if line)


def capture_schema() -> str:
    return f"{capture_columns()}, {CAPTURE_PARTITIONS}"


DOMAINS = "rank INT, domain STRING"

INDEX_RESULTS = (
    "status STRING, domain STRING, url STRING, timestamp STRING, filename STRING, "
    "offset BIGINT, length BIGINT, mime STRING, digest STRING"
)

FETCH_LOG = "domain STRING, status STRING, size BIGINT, error STRING"

PAIRING = (
    "STRUCT<foreground: STRING, background: STRING, fg_rgb: ARRAY<INT>, bg_rgb: ARRAY<INT>, "
    "ratio: DOUBLE, pass_normal: BOOLEAN, pass_large: BOOLEAN, explicit: BOOLEAN, selector: STRING>"
)

RESULTS = (
    "domain STRING, status STRING, error STRING, total_pairings BIGINT, pass_normal BIGINT, "
    "fail_normal BIGINT, pass_large BIGINT, fail_large BIGINT, pass_rate_normal DOUBLE, "
    "pass_rate_large DOUBLE, worst_ratio DOUBLE, best_ratio DOUBLE, median_ratio DOUBLE, "
    f"mean_ratio DOUBLE, worst_pairings ARRAY<{PAIRING}>"
)
RESULTS_FULL = f"{RESULTS}, pairings ARRAY<{PAIRING}>"

REPORT = (
    "rank BIGINT, domain STRING, category STRING, total_pairings BIGINT, pass_normal BIGINT, "
    "fail_normal BIGINT, pass_rate_normal DOUBLE, pass_large BIGINT, fail_large BIGINT, "
    "pass_rate_large DOUBLE, worst_ratio DOUBLE, median_ratio DOUBLE, mean_ratio DOUBLE, "
    "fully_compliant_normal STRING, fully_compliant_large STRING"
)
