"""One query per operator, each over the whole given tables."""

from __future__ import annotations

import sys
from collections.abc import Callable

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from harness import inputs
from huescope.functions import colours, css
from huescope.functions.categories import categorise_domain
from huescope.functions.numeric import round_half_even, upper_median
from huescope.operators import captures as cap
from huescope.operators import declarations as dec
from huescope.operators import pairings as pair
from huescope.operators import records as rec
from huescope.operators import report as rep
from huescope.plans import fetch
from huescope.plans.audit import analyse_pages, page_pairings
from huescope.plans.lookup import import_captures, lookup_homepages
from huescope.sources import index as idx
from huescope.sources import pages as pg
from huescope.sources import results as res
from huescope.sources.shared import fresh_path, materialised

# Workers may not have this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
KEY = "page_id"


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


# --- inputs ------------------------------------------------------------------


#: Partitions that a derived input is dealt to; None leaves what the scan gives.
PARTITIONS: int | None = None


def spread(df: DataFrame) -> DataFrame:
    return df.repartition(PARTITIONS) if PARTITIONS else df


def _sql(spark: SparkSession, folder: str, text: str, *tables: str) -> DataFrame:
    for name in tables:
        frame = spark.read.parquet(f"{folder}/{name}.parquet")
        spread(frame).createOrReplaceTempView(name)
    return spark.sql(text)


_STORED: dict[tuple[str, str, str], DataFrame] = {}


def _stored(spark, folder, name: str, build: Query) -> DataFrame:
    """A derived table, stored once per session as the jobs hand it on."""
    key = (spark.sparkContext.applicationId, folder, name)
    if key not in _STORED:
        _STORED[key] = materialised(build(spark, folder))
    return _STORED[key]


def _site_pages(spark, folder) -> DataFrame:
    return spread(_stored(spark, folder, "sites", lambda s, f: _sql(s, f, inputs.SITES, "pages")))


def _styled(spark, folder) -> DataFrame:
    return _site_pages(spark, folder).drop("domain")


def _sites(spark, folder) -> DataFrame:
    return _site_pages(spark, folder).drop(KEY)


def _captures(spark, folder) -> DataFrame:
    return _sql(spark, folder, inputs.captures("timestamp_micros"), "pages")


def _domains(spark, folder) -> DataFrame:
    return _sql(spark, folder, inputs.DOMAIN_LIST, "pages")


def _colour_texts(spark, folder) -> DataFrame:
    return _sql(spark, folder, inputs.COLOUR_TEXTS, "lineitem")


def _wide_pairs(spark, folder, *more: str) -> DataFrame:
    rows = _sql(spark, folder, inputs.WIDE_PAIRS, "lineitem")
    coded = colours.with_colour_code(colours.with_colour_code(rows, "fg_text", "fg"), "bg_text", "bg")
    return coded.select("l_orderkey", "l_linenumber", "fg", "bg", *more)


def _seq(df: DataFrame) -> DataFrame:
    """Flatten seq into its three columns."""
    rest = [c for c in df.columns if c != "seq"]
    return df.select(*rest, "seq.kind", "seq.block", "seq.rule")


def _coded(spark, folder, every_page: bool = False) -> DataFrame:
    return pair.with_codes(dec.union_declarations(_styled(spark, folder), KEY, every_page=every_page))


def _pairs(spark, folder) -> DataFrame:
    return pair.build_pairings(_coded(spark, folder), KEY)


def _distinct(spark, folder) -> DataFrame:
    return pair.classify_pairs(pair.dedup_pairings(_pairs(spark, folder), KEY))


def _results(spark, folder) -> DataFrame:
    return _stored(
        spark, folder, "results", lambda s, f: analyse_pages(_sites(s, f), "domain").drop("pairings")
    )


def _archives(spark, folder) -> DataFrame:
    return _sql(spark, folder, inputs.ARCHIVES, "pages")


def _records(spark, folder) -> DataFrame:
    """Index rows with their sliced bytes."""
    archives = _archives(spark, folder)
    index = archives.select("domain", "filename", "offset", "length")
    table = archives.select(F.col("filename").alias("path"), F.col("archive").alias("content"))
    return rec.slice_records(index, table)


def _channel_columns(code: Column) -> list[Column]:
    known = F.when(code >= 0, code)
    return [
        colours.red(known).alias("r"),
        colours.green(known).alias("g"),
        colours.blue(known).alias("b"),
        F.coalesce(code == colours.UNREADABLE, F.lit(False)).alias("unreadable"),
    ]


# --- scans, sources, sinks ---------------------------------------------------


def _ranked(spark, folder) -> DataFrame:
    text = f"SELECT CAST(page_id + 1 AS INT) AS rank, {inputs.audit_domain()} AS domain FROM pages"
    return _sql(spark, folder, text, "pages")


@query
def scan_domain_list(spark, folder):
    path = fresh_path(spark, "domains")
    _ranked(spark, folder).write.csv(path, header=True)
    return idx.scan_domain_list(spark, path)


def _index_root(spark, folder) -> str:
    path = fresh_path(spark, "captures")
    _captures(spark, folder).write.partitionBy("crawl", "subset").parquet(path)
    return path


_INDEX_COLUMNS = ("url", "url_host_name", "url_port", "fetch_status", "warc_record_offset", "crawl", "subset")


@query
def scan_capture_index(spark, folder):
    return idx.scan_capture_index(spark, _index_root(spark, folder)).select(*_INDEX_COLUMNS)


@query
def register_capture_table(spark, folder):
    name = "capture_index_all"
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    return idx.register_capture_table(spark, name, _index_root(spark, folder)).select(*_INDEX_COLUMNS)


@query
def register_capture_partition(spark, folder):
    name = "capture_index_one"
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    table = idx.register_capture_table(spark, name, _index_root(spark, folder), inputs.CRAWL)
    return table.select(*_INDEX_COLUMNS)


def _picked(spark, folder) -> DataFrame:
    listed = cap.filter_domain_in(
        cap.filter_homepage_captures(_captures(spark, folder), inputs.CRAWL), _domains(spark, folder)
    )
    return cap.pick_homepage(listed)


@query
def import_capture_csv(spark, folder):
    path = fresh_path(spark, "lookup")
    cap.project_captures(_picked(spark, folder)).write.csv(path, header=True)
    return import_captures(idx.scan_capture_csv(spark, path), _domains(spark, folder))


@query
def write_index_json(spark, folder):
    path = fresh_path(spark, "index")
    idx.write_index_json(
        lookup_homepages(_captures(spark, folder), _domains(spark, folder), inputs.CRAWL), path
    )
    return idx.scan_index_json(spark, path)


@query
def slice_records(spark, folder):
    sliced = _records(spark, folder)
    return sliced.select("domain", "length", F.md5("content").alias("digest"))


@query
def write_pages(spark, folder):
    path = fresh_path(spark, "pages")
    fetched = _decoded(spark, folder)
    pg.write_pages(fetched.unionByName(fetched.where("size > 0").withColumn("html", F.lit("!"))), path)
    return spark.read.parquet(path)


def _store_page_files(batches, folder: str):
    """Write through the path's own file system, which every executor reaches."""
    from pyarrow import fs

    system, base = fs.FileSystem.from_uri(folder)
    system.create_dir(base)
    for frame in batches:
        for name, html in zip(frame["name"], frame["html"]):
            with system.open_output_stream(f"{base}/{name}.html") as out:
                out.write(html.encode())
        yield frame[["name"]]


@query
def scan_pages(spark, folder):
    from functools import partial

    path = fresh_path(spark, "html")
    ends = "CASE page_id % 3 WHEN 0 THEN chr(13) || chr(10) WHEN 1 THEN chr(13) ELSE chr(10) END"
    text = f"SELECT replace({inputs.SITE}, ':80/', '_80_') AS name, replace(html, chr(10), {ends}) AS html FROM pages"
    files = _sql(spark, folder, text, "pages")
    files.mapInPandas(partial(_store_page_files, folder=path), "name string").count()
    return pg.scan_pages(spark, path)


@query
def write_fetch_log(spark, folder):
    path = fresh_path(spark, "log")
    pg.write_fetch_log(_decoded(spark, folder), path)
    return _with_error_flag(pg.scan_fetch_log(spark, path))


_RESULT_COLUMNS = (
    "domain", "status", "error", "total_pairings", "pass_normal", "fail_normal", "pass_large", "fail_large",
    "pass_rate_normal", "pass_rate_large", "worst_ratio", "best_ratio", "median_ratio", "mean_ratio",
)


def _with_worst(results: DataFrame) -> DataFrame:
    first = F.get("worst_pairings", F.lit(0))
    return results.select(
        *_RESULT_COLUMNS,
        first.getField("foreground").alias("worst_fg"),
        first.getField("background").alias("worst_bg"),
        first.getField("ratio").alias("worst_pair_ratio"),
    )


@query
def write_results(spark, folder):
    path = fresh_path(spark, "results")
    res.write_results(analyse_pages(_sites(spark, folder), "domain"), path)
    return _with_worst(res.scan_results(spark, path))


_PAIR_COLUMNS = ("foreground", "background", "ratio", "pass_normal", "pass_large", "explicit", "selector")


@query
def write_results_full(spark, folder):
    path = fresh_path(spark, "full")
    res.write_results_full(analyse_pages(_sites(spark, folder), "domain"), path)
    full = res.scan_results(spark, path, full=True).select("domain", F.posexplode("pairings").alias("at", "p"))
    return full.select("domain", "at", *[f"p.{c}" for c in _PAIR_COLUMNS])


def _summary(spark, folder) -> DataFrame:
    return rep.audit_summary(_results(spark, folder), inputs.CRAWL)


_SCALARS = (
    "crawl_id", "total_domains_in_list", "domains_analysed", "domains_with_color_data",
    "domains_no_color_data", "domains_failed", "total_unique_pairings", "total_failing_normal",
    "total_failing_large", "mean_pass_rate_normal", "median_pass_rate_normal",
    "min_pass_rate_normal", "max_pass_rate_normal", "mean_pass_rate_large",
    "median_pass_rate_large", "pct_fully_compliant_normal", "pct_above_90_normal",
    "pct_above_75_normal", "pct_below_50_normal", "min_worst_ratio_across_sites",
)


def _summary_columns(summary: DataFrame) -> DataFrame:
    buckets = [F.col("pass_rate_distribution")[n].alias(f"bucket_{i}") for i, (n, _) in enumerate(rep.BUCKETS)]
    names = F.array_join(F.map_keys("category_analysis"), ",")
    return summary.select(
        *_SCALARS,
        *buckets,
        names.alias("category_names"),
        F.array_join(F.col("worst_offenders.domain"), ",").alias("worst_domains"),
        F.array_join(F.col("fully_compliant_sites.domain"), ",").alias("compliant_domains"),
    )


@query
def audit_summary(spark, folder):
    return _summary_columns(_summary(spark, folder))


@query
def write_summary_json(spark, folder):
    path = fresh_path(spark, "summary")
    summary = _summary(spark, folder)
    res.write_summary_json(summary, path)
    return _summary_columns(spark.read.schema(summary.schema).json(path))


@query
def write_report_csv(spark, folder):
    path = fresh_path(spark, "report")
    res.write_report_csv(rep.audit_report(_results(spark, folder)), path)
    return res.scan_report_csv(spark, path)


# --- captures ----------------------------------------------------------------

_CAPTURE_COLUMNS = ("url", "url_host_registered_domain", "url_protocol", "content_digest")


@query
def filter_homepage_captures(spark, folder):
    return cap.filter_homepage_captures(_captures(spark, folder), inputs.CRAWL).select(*_CAPTURE_COLUMNS)


@query
def filter_domain_in(spark, folder):
    listed = _domains(spark, folder).where(~F.col("domain").like("%.example.net"))
    return cap.filter_domain_in(_captures(spark, folder), listed).select(*_CAPTURE_COLUMNS)


@query
def pick_homepage(spark, folder):
    return _picked(spark, folder).select(*_CAPTURE_COLUMNS)


@query
def project_captures(spark, folder):
    return cap.project_captures(_captures(spark, folder))


@query
def normalise_captures(spark, folder):
    rows = cap.project_captures(_picked(spark, folder))
    return cap.normalise_captures(rows.drop("content_mime_detected", "content_digest"))


@query
def mark_not_found(spark, folder):
    found = cap.normalise_captures(cap.project_captures(_picked(spark, folder)))
    return cap.mark_not_found(materialised(found), _domains(spark, folder)).select("status", "domain", "url")


def _index(spark, folder) -> DataFrame:
    return lookup_homepages(_captures(spark, folder), _domains(spark, folder), inputs.CRAWL)


@query
def bucketed_lookup(spark, folder):
    """The lookup of a long list over tables bucketed by registered domain."""
    made = []
    for name, bucket, rows in (("captures", idx.bucket_captures, _captures), ("domains", idx.bucket_domains, _domains)):
        spark.sql(f"DROP TABLE IF EXISTS bucketed_{name}")
        made.append(bucket(rows(spark, folder), f"bucketed_{name}", fresh_path(spark, f"bucketed-{name}"), 8))
    return lookup_homepages(*made, inputs.CRAWL, long_list=True)


@query
def homepage_lookup(spark, folder):
    return _index(spark, folder)


@query
def filter_found(spark, folder):
    return cap.filter_found(_index(spark, folder)).select("domain", "url", "offset", "length")


@query
def lookup_counts(spark, folder):
    return cap.lookup_counts(_index(spark, folder), _domains(spark, folder))


# --- records -----------------------------------------------------------------


@query
def safe_name(spark, folder):
    sites = _sql(spark, folder, f"SELECT {inputs.SITE} AS domain FROM pages", "pages")
    return sites.select("domain", pg.safe_name(F.col("domain")).alias("name"))


@query
def resume_pending(spark, folder):
    sites = _sql(spark, folder, f"SELECT page_id, {inputs.SITE} AS domain FROM pages", "pages")
    stored = sites.where("page_id % 3 = 0").select(pg.safe_name(F.col("domain")).alias("domain"))
    return rec.resume_pending(sites, stored)


@query
def join_index_to_archive(spark, folder):
    return _records(spark, folder).select("domain", "filename", F.octet_length("content").alias("size"))


def _store_archive(pages, root: str):
    """One archive file; returns its index rows."""
    import gzip

    from pyarrow import fs

    system, base = fs.FileSystem.from_uri(root)
    system.create_dir(f"{base}/seg")
    content, rows = b"filler bytes", []
    for page in pages.sort_values("page_id").itertuples():
        member = gzip.compress(page.record) if page.zipped or page.broken else page.record
        member = member[:-9] if page.broken else member
        rows.append((page.domain, "seg/none.warc" if page.missing else page.filename, len(content), len(member)))
        content += member
    with system.open_output_stream(f"{base}/{pages['filename'].iloc[0]}") as out:
        out.write(content)
    return pages.iloc[:0].reindex(columns=["domain", "filename", "offset", "length"]).from_records(
        rows, columns=["domain", "filename", "offset", "length"]
    )


_ARCHIVE_ROOTS: dict[tuple[str, str], str] = {}


def _archive_files(spark, folder) -> tuple[DataFrame, str]:
    """Index rows and root of archive files with several records each, written once per session."""
    from functools import partial

    key = (spark.sparkContext.applicationId, folder)
    root = _ARCHIVE_ROOTS.setdefault(key, fresh_path(spark, "archives"))

    def build(s, f) -> DataFrame:
        rows = _sql(s, f, inputs.ARCHIVED, "pages")
        schema = "domain string, filename string, offset bigint, length bigint"
        return rows.groupBy("filename").applyInPandas(partial(_store_archive, root=root), schema)

    return _stored(spark, folder, "archive-index", build), root


def _decoded(spark, folder) -> DataFrame:
    return rec.fetch_pages(*_archive_files(spark, folder))


def _with_error_flag(log: DataFrame) -> DataFrame:
    return log.withColumn("has_error", F.col("error").isNotNull()).drop("error")


@query
def read_records(spark, folder):
    index, root = _archive_files(spark, folder)
    read = rec.read_records(index, root)
    plain = ~F.substring("content", 1, 2).eqNullSafe(F.unhex(F.lit("1F8B")))
    return read.select("domain", F.when(plain, F.md5("content")).alias("plain_digest"), F.col("content").isNull().alias("missing"))


@query
def fetch_pages(spark, folder):
    return _with_error_flag(_decoded(spark, folder)).select("domain", "status", "size", "has_error", "html")


@query
def resume_fetch(spark, folder):
    """A store that knows some of the pages, brought up to date with the whole index."""
    index, root = _archive_files(spark, folder)
    store = fresh_path(spark, "fetch-store")
    fetch.resume_fetch(index.where("length % 3 <> 0"), root, store)
    fetched = fetch.resume_fetch(index, root, store)
    latest = _with_error_flag(fetch.latest_outcomes(fetched).select("domain", "status", "size", "error"))
    return latest.join(fetch.stored_pages(fetched), "domain", "left").select("domain", "status", "size", "has_error", "html")


@query
def decode_records(spark, folder):
    return _decoded(spark, folder).select("domain", "html", "status")


def _headers(spark, folder, anchored: bool = False) -> DataFrame:
    """Header columns of every readable record; the others have nulls."""
    index, root = _archive_files(spark, folder)
    return rec.response_headers(rec.unpack_records(rec.read_records(index, root)), anchored)


@query
def record_charset(spark, folder):
    return _headers(spark, folder).select("domain", "charset")


@query
def detect_chunked(spark, folder):
    return _headers(spark, folder).select("domain", "chunked")


@query
def detect_chunked_anchored(spark, folder):
    return _headers(spark, folder, anchored=True).select("domain", "chunked")


@query
def response_headers(spark, folder):
    headers = _headers(spark, folder).select("domain", F.explode("headers").alias("name", "texts"))
    texts = F.trim(F.translate(F.array_join("texts", "|"), "\r", ""))
    return headers.select("domain", F.translate("name", "\r", "").alias("name"), texts.alias("texts"))


@query
def dechunk_bodies(spark, folder):
    return _decoded(spark, folder).where("chunked").select("domain", F.md5("html").alias("digest"))


@query
def record_status(spark, folder):
    return _with_error_flag(rec.record_status(_decoded(spark, folder)))


@query
def fetch_counts(spark, folder):
    return rec.fetch_counts(_decoded(spark, folder))


# --- styles and declarations -------------------------------------------------


@query
def extract_style_blocks(spark, folder):
    return dec.extract_style_blocks(_styled(spark, folder), KEY)


@query
def extract_inline_styles(spark, folder):
    return dec.extract_inline_styles(_styled(spark, folder), KEY)


@query
def strip_css_comments(spark, folder):
    blocks = dec.extract_style_blocks(_styled(spark, folder), KEY)
    return blocks.select(KEY, "block", css.strip_comments(F.col("css")).alias("css"))


def _rules(spark, folder) -> DataFrame:
    return dec.parse_css_rules(dec.extract_style_blocks(_styled(spark, folder), KEY))


@query
def parse_css_rules(spark, folder):
    return _rules(spark, folder)


@query
def parse_declarations(spark, folder):
    rules = _rules(spark, folder).where(css.has_colour_property(F.col("body")))
    return dec.parse_declarations(rules).drop("failing")


@query
def filter_declarations(spark, folder):
    return dec.filter_declarations(dec.parse_declarations(_rules(spark, folder))).drop("failing")


@query
def inline_declarations(spark, folder):
    return _seq(dec.inline_declarations(_styled(spark, folder), KEY)).drop("failing")


@query
def union_declarations(spark, folder):
    return _seq(dec.union_declarations(_styled(spark, folder), KEY)).drop("failing")


_SHORTHANDS = """
SELECT l_orderkey, l_linenumber,
       CASE WHEN l_linenumber % 2 = 0 THEN value ELSE 'url(a.png) ' || value || ' no-repeat' END AS value
FROM ({texts}) texts
"""


@query
def background_shorthand(spark, folder):
    rows = _sql(spark, folder, _SHORTHANDS.replace("{texts}", inputs.COLOUR_TEXTS), "lineitem")
    properties = css.colour_properties(F.concat(F.lit("background:"), F.col("value")))
    found = rows.select("l_orderkey", "l_linenumber", "value", properties.alias("p"))
    return found.select(
        "l_orderkey",
        "l_linenumber",
        "value",
        css.background_colour(F.col("p")).alias("background"),
        css.unreadable(F.col("p")).alias("unreadable"),
    )


# --- colours -----------------------------------------------------------------


def _parsed(spark, folder, parse) -> DataFrame:
    rows = _colour_texts(spark, folder)
    coded = rows.withColumn("code", parse(F.col("value")))
    return coded.select("l_orderkey", "l_linenumber", "value", *_channel_columns(F.col("code")))


@query
def parse_hex(spark, folder):
    return _parsed(spark, folder, colours.parse_hex)


@query
def parse_rgb(spark, folder):
    return _parsed(spark, folder, colours.parse_rgb)


@query
def parse_hsl(spark, folder):
    return _parsed(spark, folder, colours.parse_hsl)


@query
def named_colour(spark, folder):
    return _parsed(spark, folder, colours.named_colour)


@query
def parse_colour(spark, folder):
    coded = colours.with_colour_code(_colour_texts(spark, folder), "value", "code")
    return coded.select("l_orderkey", "l_linenumber", "value", *_channel_columns(F.col("code")))


@query
def parse_colour_once(spark, folder):
    """Few different texts on many rows, one of them on a third, through the dictionary."""
    rows = _sql(spark, folder, inputs.REPEATED_COLOURS, "lineitem")
    coded = colours.with_colour_code_once(rows, "value", "code")
    return coded.select("l_orderkey", "l_linenumber", "value", *_channel_columns(F.col("code")))


@query
def hsl_to_rgb(spark, folder):
    rows = spark.read.parquet(f"{folder}/lineitem.parquet").select(
        "l_orderkey",
        "l_linenumber",
        (F.pmod(F.col("l_orderkey"), F.lit(720)) + F.lit(0.5)).alias("h"),
        (F.col("l_linenumber") / F.lit(8.0)).alias("s"),
        (F.col("l_quantity") / F.lit(50.0)).alias("l"),
    )
    coded = rows.select(
        "l_orderkey",
        "l_linenumber",
        colours.hsl_to_rgb(F.col("h").cast("double"), F.col("s"), F.col("l")).alias("code"),
    )
    return coded.select("l_orderkey", "l_linenumber", *_channel_columns(F.col("code"))[:3])


@query
def relative_luminance(spark, folder):
    pairs = _wide_pairs(spark, folder)
    return pairs.select(
        "l_orderkey", "l_linenumber", colours.relative_luminance(F.col("fg")).alias("luminance")
    )


@query
def contrast_ratio(spark, folder):
    pairs = _wide_pairs(spark, folder)
    return pairs.select(
        "l_orderkey", "l_linenumber", colours.contrast_ratio(F.col("fg"), F.col("bg")).alias("contrast")
    )


# --- pairings and pages ------------------------------------------------------


@query
def build_pairings(spark, folder):
    return _seq(_pairs(spark, folder))


@query
def classify_pairs(spark, folder):
    return pair.classify_pairs(_wide_pairs(spark, folder)).drop("fg", "bg")


@query
def dedup_pairings(spark, folder):
    return _seq(_distinct(spark, folder))


@query
def dedup_pairings_wide(spark, folder):
    """One hot group per return flag holds a third of all rows and more."""
    pairs = _wide_pairs(spark, folder, "l_returnflag")
    ordered = pairs.withColumn("seq", F.struct("l_orderkey", "l_linenumber"))
    first = pair.dedup_pairings(ordered.withColumn("fg", F.col("fg").bitwiseAND(0xF8F8F8)), "l_returnflag")
    return first.drop("seq")


@query
def filter_failing_pairings(spark, folder):
    failing = pair.filter_failing_pairings(_distinct(spark, folder))
    return _seq(failing).select(KEY, "fg", "bg", "ratio", "kind", "block", "rule")


@query
def worst_pairings_topk(spark, folder):
    return pair.worst_pairings_topk(_distinct(spark, folder), KEY).select(
        KEY, "place", "foreground", "background", "ratio", "selector"
    )


@query
def page_contrast_summary(spark, folder):
    return pair.page_contrast_summary(_distinct(spark, folder), KEY)


@query
def page_summary_empty(spark, folder):
    return pair.page_summary_empty(_coded(spark, folder, every_page=True), KEY).drop("status")


@query
def page_error_status(spark, folder):
    return pair.page_status(_coded(spark, folder, every_page=True), KEY)


@query
def page_pairing_list(spark, folder):
    """The in-row analysis, one row per pairing."""
    found = page_pairings(_styled(spark, folder), KEY).where("NOT failed")
    rows = found.select(KEY, F.posexplode("pairings").alias("at", "p"))
    return rows.select(KEY, "at", *[f"p.{c}" for c in _PAIR_COLUMNS])


@query
def page_audit(spark, folder):
    """The in-row analysis, one row per page."""
    return _with_worst(analyse_pages(_sites(spark, folder), "domain"))


@query
def analyse_pages_compact(spark, folder):
    return res.project_results_compact(analyse_pages(_sites(spark, folder), "domain")).select(
        *_RESULT_COLUMNS, F.size("worst_pairings").alias("worst_listed")
    )


@query
def upper_median_by_flag(spark, folder):
    rows = spark.read.parquet(f"{folder}/lineitem.parquet")
    return rows.groupBy("l_returnflag", "l_linestatus").agg(upper_median("l_quantity").alias("median"))


@query
def half_even_rounding(spark, folder):
    rows = spark.read.parquet(f"{folder}/lineitem.parquet")
    value = F.col("l_extendedprice") * F.col("l_discount")
    return rows.select(
        "l_orderkey",
        "l_linenumber",
        round_half_even(value, 1).alias("one_place"),
        round_half_even(F.col("l_quantity") / F.lit(8.0), 2).alias("two_places"),
    )


# --- report ------------------------------------------------------------------


@query
def filter_analysed(spark, folder):
    return rep.filter_analysed(_results(spark, folder)).select("domain", "total_pairings")


@query
def filter_with_colours(spark, folder):
    return rep.filter_with_colours(_results(spark, folder)).select("domain", "total_pairings")


@query
def analysis_counts(spark, folder):
    return rep.analysis_counts(_results(spark, folder))


@query
def corpus_counts(spark, folder):
    return rep.corpus_counts(_results(spark, folder))


@query
def pairing_totals(spark, folder):
    return rep.pairing_totals(_results(spark, folder))


@query
def rate_stats(spark, folder):
    return rep.rate_stats(_results(spark, folder))


@query
def threshold_shares(spark, folder):
    return rep.threshold_shares(_results(spark, folder))


@query
def pass_rate_histogram(spark, folder):
    return rep.pass_rate_histogram(_results(spark, folder))


@query
def category_rollup(spark, folder):
    return rep.category_rollup(_results(spark, folder))


@query
def sort_categories(spark, folder):
    return rep.sort_categories(rep.category_rollup(_results(spark, folder)), by_rate=True).select(
        "category", "avg_pass_rate"
    )


@query
def worst_offenders(spark, folder):
    worst = rep.worst_offenders(_results(spark, folder))
    return worst.select(
        "domain", "pass_rate_normal", "total_pairings", "fail_normal", "worst_ratio",
        F.col("example_failure.foreground").alias("worst_fg"),
        F.col("example_failure.background").alias("worst_bg"),
        F.col("example_failure.ratio").alias("worst_pair_ratio"),
    )


@query
def fully_compliant_sites(spark, folder):
    return rep.fully_compliant_sites(_results(spark, folder))


@query
def min_worst_ratio(spark, folder):
    return rep.min_worst_ratio(_results(spark, folder))


@query
def summary_empty_guard(spark, folder):
    """Guarded summaries of all pages and of the pages without colours."""
    results = _results(spark, folder)
    colourless = results.where(~rep.has_colours())
    guarded = [
        rep.summary_empty_guard(rep.audit_summary(r, inputs.CRAWL)).select(
            F.lit(n).alias("population"), "domains_with_color_data", "error"
        )
        for n, r in (("all", results), ("colourless", colourless))
    ]
    return guarded[0].unionByName(guarded[1])


@query
def categorise_domains(spark, folder):
    ranked = _ranked(spark, folder)
    return ranked.select("rank", "domain", categorise_domain(F.col("domain")).alias("category"))


@query
def compliance_flags(spark, folder):
    return rep.compliance_flags(rep.filter_with_colours(_results(spark, folder))).select(
        "domain", "fully_compliant_normal", "fully_compliant_large"
    )


@query
def report_rank(spark, folder):
    return rep.report_rank(rep.filter_with_colours(_results(spark, folder)).select("domain", "total_pairings"))


@query
def audit_report(spark, folder):
    return rep.audit_report(_results(spark, folder))
